"""Column expressions for substitution codes such as A169C, or A2C/D4E for several."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The residue letters.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
_CODE = rf"^([{RESIDUES}])([1-9][0-9]*)([{RESIDUES}*])$"


def parse(code: Column) -> Column:
    """array<struct<ref, pos, alt>>; empty for the wild type "", null if any part is no valid code."""
    parts = F.split(code, "/")
    parsed = F.transform(parts, lambda x: F.struct(F.regexp_extract(x, _CODE, 1).alias("ref"), F.regexp_extract(x, _CODE, 2).try_cast("int").alias("pos"), F.regexp_extract(x, _CODE, 3).alias("alt")))
    valid = F.forall(parsed, lambda m: m["pos"].isNotNull() & (m["ref"] != m["alt"])) & (F.size(F.array_distinct(F.transform(parsed, lambda m: m["pos"]))) == F.size(parsed))
    empty = F.array().cast("array<struct<ref:string,pos:int,alt:string>>")
    return F.when(code == "", empty).when(valid, parsed)


def positions(mutations: Column) -> Column:
    return F.array_distinct(F.transform(mutations, lambda m: m["pos"]))


def agrees(mutations: Column, sequence: Column) -> Column:
    """Whether every reference residue stands in the sequence (a final stop aside)."""
    own = F.regexp_replace(sequence, r"\*$", "")
    return F.forall(mutations, lambda m: (m["pos"] <= F.length(own)) & (F.substr(own, m["pos"], F.lit(1)) == m["ref"]))


def apply_to(mutations: Column, sequence: Column) -> Column:
    return F.aggregate(mutations, sequence, lambda s, m: F.overlay(s, m["alt"], m["pos"], F.lit(1)))


def digest(sequence: Column) -> Column:
    """sha256 of a sequence in upper case, trimmed, without one final stop."""
    return F.sha2(F.upper(F.regexp_replace(F.trim(sequence), r"\*$", "")), 256)


def draw(*parts: Column | str | int) -> Column:
    """A reproducible 32-bit draw from its parts, alike on every cluster."""
    text = F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substr(F.md5(text), F.lit(1), F.lit(8)), 16, 10).cast("long")
