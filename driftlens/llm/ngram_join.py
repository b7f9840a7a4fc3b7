"""Similarity join of texts on word shingles by vertical partitioning, and the classes that its links make.

The order of all shingles is that of their hashes. It is cut into fragments, once finely to find
candidates and once coarsely to count:

- Candidates. Texts of one size class cut the order into as many fragments as makes about one to three
  of their shingles fall into each. Two sets that differ in d shingles agree on all fragments but d at
  most, so that with more than d non-empty fragments a pair at the threshold has an equal non-empty
  fragment; equal fragments are found by their hashes. Where a set has too few non-empty fragments, and
  for small sets, the first shingles in order serve as fragments of their own (prefix filter).
- Counts. The overlap of a candidate pair is counted in each coarse fragment by itself and summed per
  pair; the exact comparison 100 * overlap >= 80 * union follows.

Texts with equal sets are one class from the start. A partner shares at least `need` fragments with a
class, so that of a class's groups (classes that share a fragment), taken from the smallest up, the last
`need` less one are not looked at: those of common passages. A class that is left with no group has no
partner. In a group, parity sketches (whose difference never exceeds the sets' true difference) rule out
pairs, and of the pairs left only a spanning forest, nearest first, is counted. The first round looks at a
few groups of each class, in tiles, which joins most near copies; the second at all groups whose classes
are still apart; the third counts every pair that the sketches leave between classes that are still apart.
In a group, classes of its commonest component are compared with the others only. So all links between
components are tried, while the pairs of a large group of near copies are never listed.

Null and empty texts, and texts without words, have no shingles and stand alone; texts of fewer words
than a shingle have their whole sequence as one; repeated ids count as one document by their smallest
place in the order; rows without an id link with nothing; an empty table gives an empty result; other
columns are dropped. Classes are named by 64-bit sums of hashed shingles, and overlaps count 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlens.llm.common import discard, parts, stored, tidy
from driftlens.llm.hashing import U, mix, pieces, shingle_sets
from driftlens.operators import graph

SHINGLE, PERCENT = 5, 80
#: Sets below this size use single shingles as fragments.
SMALL = 16
#: Coarse fragments in which overlaps are counted.
FRAGMENTS = 4
#: Members of a group that are compared at once.
TILE = 1024
#: Rows of the fine fragments for each bucket, about, and those of them that are sorted at once.
BUCKET_ROWS, SORTED_ROWS = 4_000_000, 500_000
#: Pairs whose sets meet in one bucket, about.
BUCKET_PAIRS = 1_000
#: Bits a wanted id takes in the filter of ids, and the ids up to which a filter is sent to all tasks (16 MB).
FILTER_BITS, FILTERED = 16, 1 << 23


def _class(own: np.ndarray) -> np.uint64:
    return mix(np.array([mix(own).sum(dtype=np.uint64) + U(len(own))], np.uint64))[0]


def _signed(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def most_apart(n: int) -> int:
    """Largest symmetric difference of a set of n and any partner at the threshold."""
    return n * (100 - PERCENT) // PERCENT


def signatures(own: np.ndarray) -> np.ndarray:
    """Hashes of the fragments by which a sorted set is found."""
    n = len(own)
    out = []
    low = n * PERCENT < SMALL * 100
    top = n.bit_length() - 1
    if n < SMALL:
        low = True
    else:
        classes = [top, top + 1] if n * 100 >= PERCENT * (1 << (top + 1)) else [top]
        spare = True
        for k in classes:
            parts = U((1 << (k + 1)) // 3)
            at = (own >> U(13)) % parts
            order = at.argsort(kind="stable")
            at = at[order]
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            out.append(mix(np.add.reduceat(mix(own[order] + U(k)), first) + at[first] * U(0x9E3779B97F4A7C15)))
            spare &= len(first) > most_apart(n)
        low |= not spare
    if low:
        keep = n - -(-n * PERCENT // 100) + 1
        out.append(mix(own[:keep] + U(0x5851F42D4C957F2D)))
    return np.unique(np.concatenate(out))


def least_shared(own: np.ndarray) -> int:
    """Fragments that a set has in common with any partner, at least."""
    n = len(own)
    top = n.bit_length() - 1
    classes = [top, top + 1] if n * 100 >= PERCENT * (1 << (top + 1)) else [top]
    if n < SMALL or n * PERCENT < SMALL * 100:
        return 1
    return max(1, min(int((np.bincount(((own >> U(13)) % U((1 << (k + 1)) // 3)).astype(np.int64)) > 0).sum()) for k in classes) - most_apart(n))


def sketch(own: np.ndarray, bits: int) -> np.ndarray:
    """Parity of the shingles that fall on each bit."""
    at = (mix(own) >> U(9)) % U(bits)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=bits).astype(np.uint8) & 1)


def sketch_bits(n: int) -> int:
    """Bits for a set of n: a power of four, about one to four a shingle."""
    return max(256, 1 << (2 * -(-int(n).bit_length() // 2)))


def describe(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, n, cls, need) of every row."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                flat, sizes = shingle_sets(part.column("text"), SHINGLE)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                cls = np.array([_class(flat[a:b]) if b > a else U(0) for a, b in zip(ends, ends[1:], strict=False)], np.uint64)
                need = [least_shared(flat[a:b]) if b > a else 0 for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_pydict({"id": part.column("id"), "n": pa.array(sizes), "cls": pa.array(_signed(cls), mask=sizes == 0), "need": pa.array(need, pa.int64())})

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id bigint, n bigint, cls bigint, need bigint")


def dealt(docs: DataFrame, text: str, buckets: int) -> DataFrame:
    """(bucket, low, high, owners, times): the fine fragments of each class in runs, an owner and how many are its own.

    48 bits of a fragment's hash are kept beside its bucket, an owner is named once a run: the bytes of a fragment
    are at most 15, beside a row's head, however many buckets there are. Fragments of two classes taken for one make
    a group larger, never smaller."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            for part in pieces(batch, "text"):
                flat, sizes = shingle_sets(part.column("text"), SHINGLE)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                sigs, owners = [], []
                for a, b in zip(ends, ends[1:], strict=False):
                    if b == a:
                        continue
                    cls = _class(flat[a:b])
                    if int(cls) in sent:
                        continue
                    if len(sent) > 500_000:
                        sent.clear()
                    sent.add(int(cls))
                    sigs.append(signatures(flat[a:b]))
                    owners.append(np.full(len(sigs[-1]), cls, np.uint64))
                if not sigs:
                    continue
                sig, owner = np.concatenate(sigs), np.concatenate(owners)
                bucket = ((sig >> U(20)) % U(buckets)).astype(np.int64)
                order = bucket.argsort(kind="stable")
                sig, owner, bucket = sig[order], owner[order], bucket[order]
                new = np.ones(len(sig), bool)
                new[1:] = (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])
                place = np.arange(len(sig))
                # a run's number is one byte: longer ones are several
                runs = np.flatnonzero((place - np.maximum.accumulate(np.where(new, place, 0))) % 255 == 0)
                low, high = (sig & U(0xFFFFFFFF)).astype(np.uint32), ((sig >> U(32)) & U(0xFFFF)).astype(np.uint16)
                owner, times = owner[runs], np.diff(np.append(runs, len(sig))).astype(np.uint8)
                used, first = np.unique(bucket, return_index=True)
                cuts = np.append(first, len(sig))
                spans, told = list(zip(cuts, cuts[1:], strict=False)), np.searchsorted(runs, cuts)
                told = list(zip(told, told[1:], strict=False))
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int32()), **{c: pa.array([v[a:b].tobytes() for a, b in at], pa.binary()) for c, v, at in (("low", low, spans), ("high", high, spans), ("owners", owner, told), ("times", times, told))}})

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "bucket int, low binary, high binary, owners binary, times binary")


def groups(docs: DataFrame, text: str, buckets: int) -> DataFrame:
    """(gid, cls, size, times): the distinct groups of two classes or more that share a fine fragment, and how many they share."""

    def shared(sig: np.ndarray, owner: np.ndarray) -> pa.Table:
        order = sig.argsort(kind="stable")
        sig, owner = sig[order], owner[order]
        same = np.flatnonzero(sig[1:] == sig[:-1])
        often = np.unique(np.concatenate([same, same + 1]))
        sig, owner = sig[often], owner[often]
        order = np.lexsort((owner, sig))
        sig, owner = sig[order], owner[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (owner[1:] != owner[:-1])
        sig, owner = sig[new], owner[new]
        if not len(sig):
            return pa.table({"gid": pa.array([], pa.int64()), "cls": pa.array([], pa.int64()), "size": pa.array([], pa.int64()), "times": pa.array([], pa.int64())})
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.diff(np.concatenate([first, [len(sig)]]))
        gid = mix(np.add.reduceat(mix(owner + U(3)), first) + size.astype(np.uint64))
        _, keep, which, often = np.unique(gid, return_index=True, return_inverse=True, return_counts=True)
        take = np.zeros(len(first), bool)
        take[keep] = True
        take &= size > 1
        rows = np.repeat(take, size)
        return pa.table({"gid": pa.array(_signed(np.repeat(gid, size)[rows])), "cls": pa.array(_signed(owner[rows])), "size": pa.array(np.repeat(size, size)[rows], pa.int64()), "times": pa.array(np.repeat(often[which], size)[rows], pa.int64())})

    def gather(table: pa.Table) -> pa.Table:
        low, high, owners, times = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("low", np.uint32), ("high", np.uint16), ("owners", np.uint64), ("times", np.uint8)))
        whose = np.repeat(np.arange(len(owners), dtype=np.uint32), times)
        slices = -(-len(low) // SORTED_ROWS)
        found = []
        for k in range(slices):
            at = np.flatnonzero(low % np.uint32(slices) == k)
            found.append(shared((high[at].astype(np.uint64) << U(32)) | low[at], owners[whose[at]]))
        return pa.concat_tables(found)

    return dealt(docs, text, buckets).groupBy("bucket").applyInArrow(gather, "gid bigint, cls bigint, size bigint, times bigint").groupBy("gid", "cls").agg(F.max("size").alias("size"), F.sum("times").alias("times"))


def _filter(ids: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of ids(id) of so many bits."""
    spots = F.explode(F.array(*(F.pmod(F.xxhash64(F.lit(i), "id"), F.lit(bits)) for i in range(3))))
    words = ids.select(spots.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("bits"))
    out = np.zeros(bits // 64, np.int64)
    for batch in words.toArrow().to_batches():
        out[batch.column("word").to_numpy()] = batch.column("bits").to_numpy()
    return out


def sets(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """(cls, n, sketch, own): size, sketch and sorted shingles of the documents of wanted(id), and of some others.

    Where the wanted ids are few enough, a filter of proven size is sent to all tasks; else ids are joined."""
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).filter("id IS NOT NULL")
    count = wanted.count()
    if count > FILTERED:
        docs = docs.join(wanted, "id", "left_semi").select("text")
        words, size = None, 0
    else:
        size = 64 << (count * FILTER_BITS // 64).bit_length()
        words = docs.sparkSession.sparkContext.broadcast(_filter(wanted, size))
        docs = docs.select("text", F.array(*(F.pmod(F.xxhash64(F.lit(i), "id"), F.lit(size)) for i in range(3))).alias("spots"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if words is not None:
                at = batch.column("spots").flatten().to_numpy().reshape(-1, 3)
                batch = batch.filter(pa.array(((words.value[at >> 6] >> (at & 63)) & 1).all(1)))
            for part in pieces(batch.select(["text"]), "text"):
                flat, sizes = shingle_sets(part.column("text"), SHINGLE)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                rows = {int(_signed(_class(flat[a:b]))): flat[a:b] for a, b in zip(ends, ends[1:], strict=False) if b > a}
                if rows:
                    own = list(rows.values())
                    yield pa.RecordBatch.from_pydict({"cls": pa.array(list(rows), pa.int64()), "n": pa.array(map(len, own), pa.int64()), "sketch": pa.array([sketch(x, sketch_bits(len(x))).tobytes() for x in own], pa.binary()), "own": pa.array([x.tobytes() for x in own], pa.binary())})

    return docs.mapInArrow(run, "cls bigint, n bigint, sketch binary, own binary")


def looked_at(grouped: DataFrame, needs: DataFrame) -> DataFrame:
    """(gid, cls, size): the groups of each class, smallest first, but those that hold less than its `need` together.

    The groups that two linked classes share hold `need` fragments of either at least, so that the smallest
    of them is looked at by both. Groups and classes left alone go."""
    down = Window.partitionBy("cls").orderBy(F.desc("size"), F.desc("gid")).rowsBetween(Window.unboundedPreceding, 0)
    kept = grouped.join(needs, "cls").withColumn("held", F.sum("times").over(down)).filter("held >= need").select("gid", "cls")
    return kept.join(kept.groupBy("gid").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "gid")


def common_groups(grouped: DataFrame) -> DataFrame:
    """(gid, cls, size): three groups at most of each class: the largest, and the first and last by id.

    Near copies share most of their groups, so that they mostly choose the same ones."""
    chosen = F.array_distinct(F.array(F.max_by("gid", F.struct("size", "gid")), F.min("gid"), F.max("gid")))
    picked = grouped.groupBy("cls").agg(chosen.alias("gids")).select("cls", F.explode("gids").alias("gid"))
    return picked.join(picked.groupBy("gid").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "gid")


def _forest(cls: np.ndarray, comp: np.ndarray, a: np.ndarray, b: np.ndarray, far: np.ndarray) -> Iterator[int]:
    """Of the pairs (a, b) those of a spanning forest over their components, nearest first."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in np.lexsort((cls[b], cls[a], far)):
        p, q = find(int(comp[a[i]])), find(int(comp[b[i]]))
        if p != q:
            root[p] = q
            yield i


def _pairs(cls: np.ndarray, comp: np.ndarray, n: np.ndarray, home: np.ndarray, minor: np.ndarray, sketches: list[bytes], every: bool) -> set[tuple[int, int]]:
    """Pairs of classes of different components that could be linked: all, or a spanning forest only.

    Classes of minor components are compared with those at home here."""
    left, right = np.flatnonzero(minor), np.flatnonzero(home)
    if not len(left) or not len(right):
        return set()
    # sets whose sketches differ in size may still be at the threshold: the longer one is folded
    size = min(map(len, sketches))
    rows = np.vstack([np.bitwise_xor.reduce(np.frombuffer(s, np.uint64).reshape(-1, size // 8), 0) for s in sketches])
    step = max(1, (2 << 20) // (len(right) * rows.shape[1]))
    a, b, far = [], [], []
    for start in range(0, len(left), step):
        some = left[start : start + step]
        apart = np.bitwise_count(rows[some][:, None, :] ^ rows[right][None, :, :]).sum(2, dtype=np.int64)
        total = n[some][:, None] + n[right][None, :]
        x, y = np.nonzero((apart * (100 + PERCENT) <= (100 - PERCENT) * total) & (comp[some][:, None] != comp[right][None, :]))
        a.append(some[x])
        b.append(right[y])
        far.append(apart[x, y])
    a, b, far = np.concatenate(a), np.concatenate(b), np.concatenate(far)
    chosen = range(len(a)) if every else _forest(cls, comp, a, b, far)
    return {(min(x, y), max(x, y)) for i in chosen for x, y in [(int(cls[a[i]]), int(cls[b[i]]))]}


def candidates(grouped: DataFrame, facts: DataFrame, comps: DataFrame | None, every: bool) -> DataFrame:
    """(a, b): pairs to be counted next. grouped(gid, cls, size), facts(cls, n, sketch), comps(cls, comp).

    Without comps each class is a component and each tile of a group is compared by itself; with them all
    classes outside a group's commonest component visit all its tiles."""
    if comps is None:
        spread = grouped.withColumns({"comp": F.col("cls"), "minor": F.lit(True)})
    else:
        members = grouped.join(comps, "cls")
        top = members.groupBy("gid", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("gid").agg(F.max_by("comp", F.struct("n", "comp")).alias("top"), F.count(F.lit(1)).alias("comps")).filter("comps > 1")
        spread = members.join(top.select("gid", "top"), "gid").withColumn("minor", F.col("comp") != F.col("top"))
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    own_tile = F.pmod(F.xxhash64("cls", "gid"), tiles).cast("int")
    spread = spread.withColumn("at", own_tile)
    if comps is not None:
        spread = spread.withColumn("tile", F.explode(F.when(F.col("minor"), F.sequence(F.lit(0), tiles - 1)).otherwise(F.array("at"))))
    else:
        spread = spread.withColumn("tile", F.col("at"))
    buckets = parts(facts.sparkSession)
    spread = spread.join(facts.select("cls", "n", "sketch"), "cls").select(F.pmod(F.xxhash64("gid", "tile"), F.lit(64 * buckets)).cast("int").alias("bucket"), "gid", "tile", "cls", "comp", "n", "minor", (F.col("tile") == F.col("at")).alias("home"), "sketch")

    def run(left: pa.Table) -> pa.Table:
        frame = {c: left.column(c).to_numpy() for c in ("gid", "tile", "cls", "comp", "n", "home", "minor")}
        sketches = left.column("sketch").to_pylist()
        order = np.lexsort((frame["cls"], frame["tile"], frame["gid"]))
        frame = {c: v[order] for c, v in frame.items()}
        edge = np.ones(len(order), bool)
        edge[1:] = (frame["gid"][1:] != frame["gid"][:-1]) | (frame["tile"][1:] != frame["tile"][:-1])
        starts = [*np.flatnonzero(edge).tolist(), len(order)]
        out = set()
        for a, b in zip(starts, starts[1:], strict=False):
            out |= _pairs(*(frame[c][a:b] for c in ("cls", "comp", "n", "home", "minor")), [sketches[k] for k in order[a:b]], every)
        a, b = zip(*sorted(out), strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return spread.groupBy("bucket").applyInArrow(run, "a bigint, b bigint").distinct()


def overlaps(pairs: DataFrame, facts: DataFrame, own: DataFrame) -> DataFrame:
    """(a, b, overlap, n_a, n_b): shared shingles, counted in each coarse fragment and summed per pair.

    A class with many partners is sent to several buckets, so that its partners spread."""
    buckets = max(parts(pairs.sparkSession), -(-pairs.count() // BUCKET_PAIRS))
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / 256).alias("salts"))
    salted = pairs.join(many, "a").withColumn("bucket", F.pmod(F.xxhash64("a", F.pmod(F.xxhash64("b"), "salts")), F.lit(buckets)).cast("int"))
    left = salted.select("bucket", "a").distinct().join(own.select(F.col("cls").alias("a"), "own"), "a")
    right = salted.select("bucket", "a", "b").join(own.select(F.col("cls").alias("b"), "own"), "b")

    def fragments(side: DataFrame, ids: list[str]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            edges = (np.arange(1, FRAGMENTS, dtype=np.uint64)) * U((1 << 64) // FRAGMENTS)
            for batch in batches:
                rows = []
                for *row, own in zip(*(batch.column(c).to_pylist() for c in ("bucket", *ids, "own")), strict=True):
                    for f, part in enumerate(np.split(x := np.frombuffer(own, np.uint64), np.searchsorted(x, edges))):
                        rows.append((*row, f, part.tobytes()))
                if rows:
                    yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.binary() if c == "own" else pa.int32() if c in ("bucket", "fragment") else pa.int64()) for c, v in zip(("bucket", *ids, "fragment", "own"), zip(*rows, strict=True), strict=True)})

        return side.mapInArrow(run, "bucket int, " + "".join(f"{c} bigint, " for c in ids) + "fragment int, own binary")

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        if not one.num_rows or not two.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "part": pa.array([], pa.int64())})
        own = dict(zip(one.column("a").to_pylist(), one.column("own").to_pylist(), strict=True))
        asked = dict(zip(zip(two.column("a").to_pylist(), two.column("b").to_pylist(), strict=True), two.column("own").to_pylist(), strict=True))
        by: dict[int, list[int]] = {}
        for x, y in asked:
            by.setdefault(x, []).append(y)
        rows = []
        for x, partners in by.items():
            mine = np.frombuffer(own[x], np.uint64)
            for y in partners:
                theirs = np.frombuffer(asked[x, y], np.uint64)
                part = int((mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs).sum()) if len(mine) else 0
                rows.append((x, y, part))
        a, b, part = zip(*rows, strict=True)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "part": pa.array(part, pa.int64())})

    keys = ["bucket", "fragment"]
    counted = fragments(left, ["a"]).groupBy(*keys).cogroup(fragments(right, ["a", "b"]).groupBy(*keys)).applyInArrow(run, "a bigint, b bigint, part bigint")
    summed = counted.groupBy("a", "b").agg(F.sum("part").alias("overlap"))
    n = facts.select("cls", "n")
    return summed.join(n.withColumnsRenamed({"cls": "a", "n": "n_a"}), "a").join(n.withColumnsRenamed({"cls": "b", "n": "n_b"}), "b")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, cls, least): each row's set size and class, and the smallest id that the class's links reach (null without shingles)."""
    about = stored(describe(docs, key, text))
    total = about.agg(F.sum("n")).first()[0] or 0
    buckets = max(parts(docs.sparkSession), -(-total * 6 // 10 // BUCKET_ROWS))
    named = about.filter("id IS NOT NULL AND cls IS NOT NULL").groupBy("cls").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.min("need").alias("need"))
    grouped = stored(looked_at(groups(docs.filter(F.col(key).isNotNull()), text, buckets), named.select("cls", "need")))
    facts = stored(named.join(grouped.select("cls").distinct(), "cls", "left_semi").select("cls", "id", "n"))
    own = stored(sets(docs, facts.select("id").distinct(), key, text))
    comps = links = tried = None
    done = []
    for step in ("common", "nearest", "every"):
        found = candidates(common_groups(grouped) if step == "common" else grouped, own, comps, step == "every")
        pairs = stored(found if tried is None else found.join(tried.select("a", "b"), ["a", "b"], "left_anti"))
        tested = stored(overlaps(pairs, facts, own).select("a", "b", (F.col("overlap") * 100 >= PERCENT * (F.col("n_a") + F.col("n_b") - F.col("overlap"))).alias("linked")))
        discard(pairs)
        done.append(tested)
        tried = tested if tried is None else tried.unionByName(tested)
        if comps is not None and tested.filter("linked").isEmpty():
            continue
        last, links = comps, tried.filter("linked").select("a", "b")
        comps = stored(graph.components(facts.select("cls"), links, "cls").withColumnRenamed("component", "comp"))
        discard(last)
    reach = about.filter("id IS NOT NULL AND cls IS NOT NULL").groupBy("cls").agg(F.min("id").alias("id")).join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    least = stored(reach.join(reach.groupBy("comp").agg(F.min("id").alias("least")), "comp").select("cls", "least"))
    discard(grouped, facts, own, comps, *done)
    return about.join(least, "cls", "left")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id): the set size of each document and the smallest key its links reach."""
    return classes(docs, key, text).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("least", "id")).alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one text of each group of linked documents: that of the smallest key.

    Rows without a key or without words stay; so do rows that repeat the key and the words of the one that
    stays, and rows of one key whose texts belong to different groups are judged each by its own text."""
    found = classes(docs, key, text)
    drop = found.filter("least <> id").select(F.col("id").alias("_id"), F.col("cls").alias("_cls")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = pa.RecordBatch.from_arrays([batch.column("row"), batch.column("row").field(text)], ["row", "text"])
            for part in pieces(whole, "text"):
                flat, sizes = shingle_sets(part.column("text"), SHINGLE)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                cls = np.array([_class(flat[a:b]) if b > a else U(0) for a, b in zip(ends, ends[1:], strict=False)], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(_signed(cls), mask=sizes == 0)], ["row", "cls"])

    named = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, cls bigint")
    kept = named.join(drop, (F.col(f"row.`{key}`").cast("long") == F.col("_id")) & (F.col("cls") == F.col("_cls")), "left_anti")
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
