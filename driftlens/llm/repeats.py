"""Repeated byte strings across documents by an enhanced suffix array, spread by anchors.

Every string of LENGTH bytes holds an anchor: the gram of GRAM bytes with the least hash, the leftmost
if several have it. Equal strings have the same anchor at the same place, so that all repeats of LENGTH
bytes meet if documents are dealt by anchor. The strings that share one anchor of a document are
consecutive; together they make its segment.

1. Segments that are equal as a whole are found by hash; all but the first are repeats throughout.
2. Of the different segments around one anchor, the first of each is fetched from its document. They
   are split once more by GRAM + SIDE bytes that their strings must share, left or right of the anchor.
3. Within such a group the suffixes from the anchor on are sorted into a suffix array with the common
   prefixes of neighbours. A stack scan lists the intervals of the common-prefix tree; an interval is a
   maximal repeat if what stands left of its suffixes differs, and how far its members agree to the left
   tells which strings of LENGTH bytes they share. The first occurrence of each string stays.

Nulls are empty texts; matches never cross documents; a string is earlier by (id, place), a null id
before all others, and between different texts of one id (null ids too) by the texts' hashes. A row is told
by its id and its text's hash, so that nothing found in one text is cut from another of the same id; rows
equal in both count as one place, so that a row does not repeat its own copy;
shorter texts than LENGTH have no repeats; an empty table gives an empty result; very long texts are
handled whole by one task; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import cut, parts
from driftlens.llm.hashing import _BASE, _BASE_INV, U, _powers, mix, pieces, raw

LENGTH, GRAM, SIDE = 100, 32, 34
REACH = LENGTH - GRAM  # an anchor stands at most so far from the start of a string
#: Text bytes for each bucket of anchors, and of documents, about.
ANCHOR_BYTES, TEXT_BYTES = 32 << 20, 12 << 20
#: Groups of more members are resolved by hashes of their strings, in one sort.
SCANNED = 48
_VALUE = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_PLACE = (1 << 28) - 1
NO_ID = -(1 << 63)
#: A row: its id and the hash of its text.
ROW = np.dtype([("id", "<i8"), ("tag", "<i8")])


def rows_of(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    """The columns id and tag as ROW."""
    out = np.empty(table.num_rows, ROW)
    for name in ROW.names:
        out[name] = table.column(name).to_numpy()
    return out


def numbered(*arrays: np.ndarray) -> list[np.ndarray]:
    """A number for each ROW, the same for equal ones in all arrays, in their order."""
    whole = np.concatenate(arrays)
    order = np.lexsort((whole["tag"], whole["id"]))
    new = whole[order][1:] != whole[order][:-1]
    number = np.zeros(len(whole), np.int64)
    number[order[1:]] = np.cumsum(new)
    return np.split(number, np.cumsum([len(a) for a in arrays])[:-1])


class Text:
    """Bytes with hashes of any part."""

    def __init__(self, data: np.ndarray):
        self.data, n = data, len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[data] * _powers(n, _BASE_INV), out=self.sums[1:])
        self.power = _powers(n + 1, _BASE)

    def part(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.power[start]


def segments(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Segments of concatenated documents: anchor, content (hashes), row, start, lead (bytes from start to
    the anchor), count (strings of LENGTH bytes)."""
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < LENGTH:
        return {"anchor": empty.astype(np.uint64), "content": empty.astype(np.uint64), "row": empty, "start": empty, "lead": empty, "count": empty}
    text = Text(data)
    gram = mix(text.part(np.arange(n - GRAM + 1), np.arange(GRAM, n + 1)))
    least = (gram & U(~_PLACE & (1 << 64) - 1)) | np.arange(len(gram), dtype=np.uint64)
    width = 1
    while 2 * width <= REACH + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = REACH + 1 - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    anchor = (least & U(_PLACE)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = row[: n - LENGTH + 1] == row[LENGTH - 1 :]
    new, last = inside.copy(), inside.copy()
    change = anchor[1:] != anchor[:-1]
    new[1:] &= ~inside[:-1] | change
    last[:-1] &= ~inside[1:] | change
    start, stop = np.flatnonzero(new), np.flatnonzero(last)
    at = anchor[start]
    count, lead = stop - start + 1, at - start
    content = mix(text.part(start, stop + LENGTH) + lead.astype(np.uint64) * U(0x9E3779B97F4A7C15) + count.astype(np.uint64) * U(0xD6E8FEB86659FD93))
    return {"anchor": gram[at], "content": content, "row": row[start], "start": start - offsets[row[start]], "lead": lead, "count": count}


def home(ids: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a ROW; `home_column` says the same of the columns id and tag."""
    x = (ids["id"] ^ ids["tag"]).view(np.uint64)
    return ((x ^ (x >> U(7)) ^ (x >> U(17))) & U((1 << 62) - 1)).astype(np.int64) % buckets


def home_column(buckets: int) -> Column:
    ids = F.col("id").bitwiseXOR(F.col("tag"))
    mixed = ids.bitwiseXOR(F.shiftrightunsigned(ids, 7)).bitwiseXOR(F.shiftrightunsigned(ids, 17)).bitwiseAND(F.lit((1 << 62) - 1))
    return F.pmod(mixed, F.lit(buckets).cast("long")).cast("int")


RANGES = "at int, kind int, ids binary, starts binary, stops binary, anchors binary"
_RANGES = pa.schema([("at", pa.int32()), ("kind", pa.int32()), *((n, pa.binary()) for n in ("ids", "starts", "stops", "anchors"))])


def _ranges(kind: int, ids: np.ndarray, starts: np.ndarray, stops: np.ndarray, anchors: np.ndarray | None, buckets: int) -> list[tuple]:
    """Rows of RANGES, one a home bucket. kind 0: bytes from starts to stops are repeats; kind 1: to be fetched."""
    at = home(ids, buckets)
    order = at.argsort(kind="stable")
    used, first = np.unique(at[order], return_index=True)
    cuts = [*first.tolist(), len(order)]
    return [(int(b), kind, ids[o].tobytes(), starts[o].astype(np.int64).tobytes(), stops[o].astype(np.int64).tobytes(), anchors[o].tobytes() if anchors is not None else None) for b, o in ((used[i], order[cuts[i] : cuts[i + 1]]) for i in range(len(used)))]


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table({n: [r[i] for r in rows] for i, n in enumerate(_RANGES.names)}, schema=_RANGES)


def equal_segments(docs: DataFrame, buckets: int, homes: int) -> DataFrame:
    """RANGES of the repeats among equal segments (kind 0) and of the segments to compare (kind 1)."""
    schema = pa.schema([("bucket", pa.int32()), *((n, pa.binary()) for n in ("anchor", "content", "id", "row", "start", "lead", "count"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 3 << 20):
                found = segments(*raw(part.column("text")))
                ids = rows_of(part)
                bucket = ((found["anchor"] >> U(11)) % U(buckets)).astype(np.int64)
                order = bucket.argsort(kind="stable")
                used, first = np.unique(bucket[order], return_index=True)
                cuts = [*first.tolist(), len(order)]
                rows = {n: [] for n in schema.names}
                for i, b in enumerate(used.tolist()):
                    o = order[cuts[i] : cuts[i + 1]]
                    here, row = np.unique(found["row"][o], return_inverse=True)
                    for name, value in (("bucket", b), ("anchor", found["anchor"][o].tobytes()), ("content", found["content"][o].tobytes()), ("id", ids[here].tobytes()), ("row", row.astype(np.uint32).tobytes()), ("start", found["start"][o].astype(np.uint32).tobytes()), ("lead", found["lead"][o].astype(np.uint8).tobytes()), ("count", found["count"][o].astype(np.uint8).tobytes())):
                        rows[name].append(value)
                if rows["bucket"]:
                    yield pa.RecordBatch.from_pydict(rows, schema=schema)

    def gather(table: pa.Table) -> pa.Table:
        column = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        anchor, content = column("anchor", np.uint64), column("content", np.uint64)
        ids = np.concatenate([np.frombuffer(i, ROW)[np.frombuffer(r, np.uint32)] for i, r in zip(table.column("id").to_pylist(), table.column("row").to_pylist(), strict=True)])
        start, lead, count = column("start", np.uint32), column("lead", np.uint8), column("count", np.uint8)
        order = anchor.argsort(kind="stable")
        same = np.flatnonzero(anchor[order][1:] == anchor[order][:-1])
        often = order[np.unique(np.concatenate([same, same + 1]))]
        anchor, content, ids, start, lead, count = (x[often] for x in (anchor, content, ids, start, lead, count))
        order = np.lexsort((start, ids["tag"], ids["id"], content, anchor))
        anchor, content, ids, start, lead, count = (x[order] for x in (anchor, content, ids, start, lead, count))
        if not len(anchor):
            return _table([])
        new_anchor = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        new = new_anchor | np.concatenate([[True], content[1:] != content[:-1]])
        begin = start.astype(np.int64)
        # the same place of a repeated row is no repeat of itself
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        itself = (ids == ids[first]) & (begin == begin[first])
        again = ~itself
        stop = begin + count - 1 + LENGTH
        rows = _ranges(0, ids[again], begin[again], stop[again], None, homes)
        kinds = np.bincount(np.cumsum(new_anchor) - 1, new)[np.cumsum(new_anchor) - 1]
        ask = new & (kinds > 1)
        rows += _ranges(1, ids[ask], begin[ask], stop[ask], begin[ask] + lead[ask], homes)
        return _table(rows)

    found = docs.mapInArrow(run, "bucket int, " + ", ".join(f"{n} binary" for n in schema.names[1:]))
    return found.groupBy("bucket").applyInArrow(gather, RANGES)


def _hash_rows(view: np.ndarray, rows: np.ndarray, start: int, size: int) -> np.ndarray:
    """Hash of `size` bytes from `start` on of some rows."""
    out, powers = np.zeros(len(rows), np.uint64), _powers(size, _BASE)
    for j in range(size):
        out += _VALUE[view[rows, start + j]] * powers[j]
    return out


def fetch(docs: DataFrame, asked: DataFrame, homes: int, buckets: int) -> DataFrame:
    """The bytes of the segments asked for, by the longer gram that their strings share.

    One block a bucket and home: key, id, start, lead, least and most distance of the anchor from a
    string's start, length right of the anchor, and REACH + LENGTH bytes with the anchor at REACH."""
    names = ("key", "id", "place", "lead", "low", "high", "right", "bytes")
    schema = pa.schema([("bucket", pa.int32()), *((n, pa.binary()) for n in names)])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = {n: [] for n in schema.names}
        if left.num_rows and right.num_rows:
            column = lambda name, kind=np.int64: np.frombuffer(b"".join(right.column(name).to_pylist()), kind)
            ids, start, stop, anchor = column("ids", ROW), column("starts"), column("stops"), column("anchors")
            data, offsets = raw(left.column("text"))
            own, wanted = numbered(rows_of(left), ids)
            by = own.argsort(kind="stable")
            row = by[np.searchsorted(own[by], wanted)]
            base = offsets[row]
            padded = np.concatenate([np.zeros(REACH, np.uint8), data, np.zeros(LENGTH, np.uint8)])
            lead, count = anchor - start, stop - start - LENGTH + 1
            view = np.lib.stride_tricks.sliding_window_view(padded, REACH + LENGTH)
            where = base + anchor
            for side, ok in (("R", lead - count + 1 < SIDE), ("L", lead >= SIDE)):
                w = where[ok]
                key = mix(_hash_rows(view, w, REACH if side == "R" else REACH - SIDE, GRAM + SIDE) + U(side == "R"))
                low = lead[ok] - count[ok] + 1
                low, high = (low, np.minimum(lead[ok], SIDE - 1)) if side == "R" else (np.maximum(low, SIDE), lead[ok])
                bucket = ((key >> U(13)) % U(buckets)).astype(np.int64)
                order = bucket.argsort(kind="stable")
                used, first = np.unique(bucket[order], return_index=True)
                cuts = [*first.tolist(), len(order)]
                for i, b in enumerate(used.tolist()):
                    o = order[cuts[i] : cuts[i + 1]]
                    for name, value in zip(schema.names, (b, key[o], ids[ok][o], anchor[ok][o], lead[ok][o].astype(np.uint8), low[o].astype(np.uint8), high[o].astype(np.uint8), np.minimum(stop[ok][o] - anchor[ok][o], LENGTH).astype(np.uint8), view[w[o]]), strict=True):
                        rows[name].append(value if name == "bucket" else value.tobytes())
        return pa.table(rows, schema=schema)

    return docs.groupBy("at").cogroup(asked.groupBy(F.col("at").alias("home"))).applyInArrow(run, "bucket int, " + ", ".join(f"{n} binary" for n in names))


def intervals(common: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Intervals (common prefix, first, last) of the common-prefix tree of a suffix array, by a stack scan.

    common[i]: common prefix of suffixes i and i + 1."""
    stack: list[tuple[int, int]] = []
    for i, now in enumerate([*common.tolist(), 0]):
        first = i
        while stack and stack[-1][0] > now:
            depth, first = stack.pop()
            yield depth, first, i
        if now and (not stack or stack[-1][0] < now):
            stack.append((now, first))


def _agree(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Common prefix of rows of bytes, at most `most`."""
    differ = a != b
    return np.minimum(np.where(differ.any(-1), differ.argmax(-1), a.shape[-1]), most)


def maximal_repeats(right: np.ndarray, right_size: np.ndarray, left: np.ndarray, left_size: np.ndarray, least: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(bytes right of and from the anchor, bytes left of it, members) of the repeats around one anchor.

    right: rows of bytes from the anchor on; left: rows of bytes before it, the nearest first. An interval
    of the suffix array whose members all have the same next byte to the left is widened to the left as
    far as they agree, so that it is maximal; members that agree further among themselves are its parts.
    Only repeats of `least` bytes are given."""
    order = np.array(sorted(range(len(right)), key=lambda i: right[i, : right_size[i]].tobytes()))
    common = _agree(right[order[:-1]], right[order[1:]], np.minimum(right_size[order[:-1]], right_size[order[1:]]))
    for depth, first, last in intervals(common):
        members = order[first : last + 1]
        by_left = members[np.array(sorted(range(len(members)), key=lambda i: left[members[i], : left_size[members[i]]].tobytes()))]
        back = _agree(left[by_left[:-1]], left[by_left[1:]], np.minimum(left_size[by_left[:-1]], left_size[by_left[1:]]))
        if len(back) and back.min() + depth >= least:
            yield depth, int(back.min()), by_left  # all of them, widened to where they are left-diverse
        for wide, a, b in intervals(back):
            if wide > back.min() and wide + depth >= least:
                yield depth, wide, by_left[a : b + 1]


def compare(blocks: DataFrame, homes: int) -> DataFrame:
    """RANGES (kind 0) of the strings that different segments share, except the first occurrence of each."""
    reach = REACH + LENGTH

    def run(table: pa.Table) -> pa.Table:
        column = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        key, ids, place = column("key", np.uint64), column("id", ROW), column("place", np.int64)
        lead, low, high, size = (column(n, np.uint8).astype(np.int64) for n in ("lead", "low", "high", "right"))
        order = key.argsort(kind="stable")
        same = np.flatnonzero(key[order][1:] == key[order][:-1])
        order = order[np.unique(np.concatenate([same, same + 1]))]
        order = order[np.lexsort((place[order], ids["tag"][order], ids["id"][order], key[order]))]  # members of a key by occurrence
        if not len(order):
            return _table([])
        data = column("bytes", np.uint8).reshape(-1, reach)[order]
        key, ids, place, lead, low, high, size = (x[order] for x in (key, ids, place, lead, low, high, size))
        right, left = data[:, REACH:], data[:, :REACH][:, ::-1]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        number = np.diff(np.concatenate([first, [len(key)]]))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # members, least and most distance of removed strings

        def mark(members: np.ndarray, depth: np.ndarray, back: np.ndarray) -> None:
            a, b = np.maximum(low[members], LENGTH - depth), np.minimum(high[members], back)
            some = a <= b
            out.append((members[some], a[some], b[some]))

        two = first[number == 2]
        if len(two):
            depth = _agree(right[two], right[two + 1], np.minimum(size[two], size[two + 1]))
            mark(two + 1, depth, _agree(left[two], left[two + 1], np.minimum(lead[two], lead[two + 1])))
        for a, n in zip(first[(number > 2) & (number <= SCANNED)].tolist(), number[(number > 2) & (number <= SCANNED)].tolist(), strict=True):
            for depth, back, members in maximal_repeats(right[a : a + n], size[a : a + n], left[a : a + n], lead[a : a + n], LENGTH):
                later = np.sort(members)[1:] + a
                mark(later, np.full(len(later), depth), np.full(len(later), back))
        big = np.repeat(number > SCANNED, number)
        if big.any():
            at = np.flatnonzero(big)
            for distance in range(REACH + 1):
                here = at[(low[at] <= distance) & (distance <= high[at])]
                if len(here) < 2:
                    continue
                found = _hash_rows(data, here, REACH - distance, LENGTH)
                by = np.lexsort((here, found, key[here]))
                again = by[1:][(found[by][1:] == found[by][:-1]) & (key[here][by][1:] == key[here][by][:-1])]
                out.append((here[again], np.full(len(again), distance), np.full(len(again), distance)))
        members, a, b = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        return _table(_ranges(0, ids[members], place[members] - b, place[members] - a + LENGTH, None, homes))

    return blocks.groupBy("bucket").applyInArrow(run, RANGES)


def cut_out(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """(id, n_bytes, spans, kept): maximal removed runs and the bytes left, of every document."""
    kept_schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        column = lambda name, kind=np.int64: np.frombuffer(b"".join(right.column(name).to_pylist()), kind)
        own, ids = numbered(rows_of(left), column("ids", ROW))
        start, stop = column("starts"), column("stops")
        order = np.lexsort((start, ids))
        ids, start, stop = ids[order], start[order], stop[order]
        rows = []
        first, last = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
        for i, a, b, text in zip(left.column("id").to_pylist(), first.tolist(), last.tolist(), left.column("text").to_pylist(), strict=True):
            data = (text or "").encode("utf-8")
            spans: list[list[int]] = []
            if b > a:
                s, e = start[a:b], np.minimum(np.maximum.accumulate(stop[a:b]), len(data))
                begin = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
                spans = [[x, y] for x, y in zip(s[begin].tolist(), e[np.concatenate([begin[1:], [len(e)]]) - 1].tolist(), strict=True) if x < y]
            edges = [0, *(x for span in spans for x in span), len(data)]
            rows.append((i, len(data), [{"start": x, "stop": y} for x, y in spans], b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))))
        return pa.table({n: [r[k] for r in rows] for k, n in enumerate(kept_schema.names)}, schema=kept_schema)

    return docs.groupBy("at").cogroup(ranges.groupBy(F.col("at").alias("home"))).applyInArrow(run, "id bigint, n_bytes bigint, spans array<struct<start: bigint, stop: bigint>>, kept binary")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, spans, kept) of every document, its repeats of earlier strings removed."""
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    least = parts(docs.sparkSession)
    buckets, homes = max(least, -(-size // ANCHOR_BYTES)), max(least, -(-size // TEXT_BYTES))
    own = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tag", F.xxhash64("text"))
    dealt = own.select(home_column(homes).alias("at"), "id", "tag", "text")
    found = cut(equal_segments(own, buckets, homes))
    blocks = fetch(dealt, found.filter("kind = 1"), homes, buckets)
    ranges = found.filter("kind = 0").unionByName(compare(blocks, homes))
    done = cut_out(dealt, ranges)
    return done.select(F.when(F.col("id") != NO_ID, F.col("id")).alias(key), "n_bytes", "spans", "kept")
