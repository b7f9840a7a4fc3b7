"""Column expressions for identifiers, dates, residue classes and windows of long sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftlens.functions.codes import parse

#: The class of each residue.
RESIDUE_CLASS = {**dict.fromkeys("AILMFWVY", "hydrophobic"), **dict.fromkeys("CNQST", "polar"), **dict.fromkeys("DEHKR", "charged"), **dict.fromkeys("GP", "special")}
#: Three-letter names of the residues.
THREE = dict(zip("Ala Arg Asn Asp Cys Gln Glu Gly His Ile Leu Lys Met Phe Pro Ser Thr Trp Tyr Val".split(), "ARNDCQEGHILKMFPSTWYV", strict=True))
#: What may stand before an identifier of a publication.
DOI_PREFIX = r"^(https?://doi\.org/|https?://dx\.doi\.org/|doi\.org/|doi:)"


def literal_map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def residue_class(residue: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(RESIDUE_CLASS), residue), F.lit("other"))


def mutation_group(code: Column) -> Column:
    """Class of the reference > class of the alternate; `multiple` unless there is one substitution."""
    m = parse(code)
    return F.when(F.size(m) == 1, F.concat(residue_class(m[0]["ref"]), F.lit(">"), residue_class(m[0]["alt"]))).otherwise("multiple")


def hgvs(code: Column) -> Column:
    """struct<ref, pos, alt> of one protein substitution (p.Ala1Cys, p.Ala1Ter, p.Ala1=), null for others."""
    pattern = r"^p\.([A-Z][a-z]{2})([1-9][0-9]*)([A-Z][a-z]{2}|=)$"
    ref = F.try_element_at(literal_map(THREE), F.regexp_extract(code, pattern, 1))
    alt_text = F.regexp_extract(code, pattern, 3)
    alt = F.when(alt_text == "Ter", "*").when(alt_text == "=", ref).otherwise(F.try_element_at(literal_map(THREE), alt_text))
    return F.when(ref.isNotNull() & alt.isNotNull(), F.struct(ref.alias("ref"), F.regexp_extract(code, pattern, 2).try_cast("int").alias("pos"), alt.alias("alt")))


def flexible_code(value: Column, sequence: Column) -> Column:
    """The code of a substitution in one or three letters with blanks, _ or - in it; null if it misses the sequence."""
    bare = F.regexp_replace(value, r"[\s_\-]", "")
    pattern = r"^(?:p\.)?([A-Za-z]{3}|[A-Z])([1-9][0-9]*)([A-Za-z]{3}|[A-Z])$"
    one = lambda i: F.coalesce(F.try_element_at(literal_map(THREE), F.initcap(F.regexp_extract(bare, pattern, i))), F.regexp_extract(bare, pattern, i))
    pos = F.regexp_extract(bare, pattern, 2).try_cast("int")
    fits = F.regexp_like(one(1), F.lit("^[A-Z]$")) & F.regexp_like(one(3), F.lit("^[A-Z]$")) & (F.substr(sequence, pos, F.lit(1)) == one(1)) & (one(1) != one(3))
    return F.when(fits, F.concat(one(1), pos.cast("string"), one(3)))


def doi(value: Column) -> Column:
    """A publication identifier in lower case, without address and trailing marks."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), DOI_PREFIX, ""), r"[/.,]+$", "")


def source_id(value: Column) -> Column:
    """kind:identifier of a data set name: a structure's chain, a structure, or a protein accession; else null."""
    chain, token, accession = r"^([0-9][A-Za-z0-9]{3})_([A-Za-z])(?:_|$)", r"(?:^|_)([0-9][A-Za-z0-9]{3})(?:_|$)", r"(?:^|_)([OPQ][0-9][A-Z0-9]{3}[0-9])(?:_|$)"
    part = lambda p, i: F.nullif(F.upper(F.regexp_extract(value, p, i)), F.lit(""))
    return F.coalesce(F.concat(F.lit("chain:"), part(chain, 1), F.lit(":"), part(chain, 2)), F.concat(F.lit("structure:"), part(token, 1)), F.concat(F.lit("accession:"), part(accession, 1)))


def protein_id(gene: Column, name: Column, accession: Column, urn: Column) -> Column:
    """Gene, else the first word of the target's name, else the accession, else the record's own name."""
    filled = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(filled(gene), filled(F.split(F.trim(name), r"\s+")[0]), filled(accession), urn)


def cutoff_end(value: Column) -> Column:
    """The last day of a year or month, or the day itself; null for other texts."""
    text = F.trim(value)
    month = F.when(F.regexp_like(text, F.lit(r"^\d{4}-\d{2}$")), F.last_day(F.try_to_date(F.concat(text, F.lit("-01")))))
    year = F.when(F.regexp_like(text, F.lit(r"^\d{4}$")), F.try_to_date(F.concat(text, F.lit("-12-31"))))
    day = F.when(F.regexp_like(text, F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.try_to_date(text))
    return F.coalesce(year, month, day)


def log1p(value: Column) -> Column:
    return F.when(value >= 0, F.log1p(value))


def windows(length: Column, size: int = 1022, overlap: int = 256) -> Column:
    """array<struct<start, stop>> of zero-based half-open windows over a sequence, the last flush right."""
    last = length - size
    starts = F.sequence(F.lit(0), last, F.lit(size - overlap))
    starts = F.when(F.element_at(starts, -1) == last, starts).otherwise(F.concat(starts, F.array(last)))
    starts = F.when(length <= size, F.array(F.lit(0))).otherwise(F.when(length > size, starts))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + size, length).alias("stop")))


def window_of(position: Column, spans: Column) -> Column:
    """The window in which a one-based position stands farthest from the edges; the earlier on ties."""
    at = position - 1
    inside = F.filter(spans, lambda w: (w["start"] <= at) & (at < w["stop"]))
    ranked = F.transform(inside, lambda w: F.struct(F.least(at - w["start"], w["stop"] - 1 - at).alias("context"), (-w["start"]).alias("early"), w.alias("w")))
    return F.array_max(ranked)["w"]


def domain_unit(family: Column, clan: Column) -> Column:
    """clan:X, or pfam:Y where there is no clan (null, blank); null without a family."""
    own = F.trim(F.coalesce(clan, F.lit("")))
    return F.when(family.isNotNull(), F.when(own != "", F.concat(F.lit("clan:"), own)).otherwise(F.concat(F.lit("pfam:"), family)))
