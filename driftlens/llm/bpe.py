"""BPE encoding by a bounded-lookahead streaming transducer, and incremental decoding.

A word is read letter by letter. For each position only the last token of the encoding of the prefix
ending there is kept (and found only where a later one asks for it): the encoding of any prefix is then a path of such tokens back to the start, and a
token is stable - it belongs to the encoding of every continuation - once the paths from all positions
that a later token can still start from pass through it. Stable tokens leave at once. The merge list
bounds how many symbols an unstable part can have (`Merges.lookahead`), so the memory does not grow
with the word.

Nulls and empty texts give no tokens; rows are independent, so ties, repeated rows, extra columns and
empty tables need no rule of their own (output columns replace input columns of the same name).
"""

from __future__ import annotations

import codecs
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from driftlens.llm.common import tidy
from driftlens.llm.hashing import pieces

END = "</w>"
#: Characters outside Latin letters and common punctuation.
FAR = regex.compile(r"[^\x00-\u024F\u2010-\u2027\u20AC]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Merges:
    """The vocabulary and merge list of one tokenizer file, with the sufficient lookahead."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.letters = byte_letters()
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.rank: dict[tuple[str, str], int] = {}
        for r, pair in enumerate(model["merges"]):
            self.rank[tuple(pair if isinstance(pair, list) else pair.split(" "))] = r
        self.made = {a + b: (a, b) for a, b in self.rank}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(pattern)
        self.library = Tokenizer.from_file(path)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.symbols = lru_cache(1 << 12)(self._symbols)
        self.longest = max(len(self._symbols(s)) for s in self.vocab)
        self.lookahead = self._lookahead()

    @staticmethod
    def _symbols(token: str) -> tuple[str, ...]:
        """A token's symbols; the last one carries the end mark if the token has it."""
        if token.endswith(END) and len(token) > len(END):
            return (*token[: -len(END) - 1], token[-len(END) - 1 :])
        return tuple(token)

    def _lookahead(self) -> int:
        """Symbols that can matter beyond a stable boundary, at most.

        A merge can disturb what stands left of it only through a merge of later rank that reaches over
        its left edge, so a disturbance travels along a chain of merges with rising ranks, each
        overlapping the next by a suffix. The longest such chain, in symbols, suffices as lookahead."""
        reach: dict[tuple[str, ...], int] = {}
        most = 0
        for a, b in self.rank:
            s = self._symbols(a + b)
            n = len(s)
            far = max([n, *(reach[s[k:]] + k for k in range(1, n) if s[k:] in reach)])
            for k in range(1, n + 1):
                if reach.get(s[:k], 0) < far:
                    reach[s[:k]] = far
            most = max(most, far)
        return most + self.longest

    @lru_cache(1 << 17)  # noqa: B019
    def fits(self, left: str, right: str) -> bool:
        """Whether the encoding of left + right is these two tokens: no merge crosses their boundary."""
        limit = 1 << 62
        while True:
            r = self.rank.get((left, right))
            if r is not None and r < limit:
                return False
            lr = self.rank[self.made[left]] if left in self.made else -1
            rr = self.rank[self.made[right]] if right in self.made else -1
            if lr < 0 and rr < 0:
                return True
            # undo the later of the two last merges: these pieces met before it
            if lr > rr:
                limit, left = lr, self.made[left][1]
            else:
                limit, right = rr + 1, self.made[right][0]


class Encoder:
    """Turns texts into token ids; holds a bounded store of words already encoded."""

    def __init__(self, merges: Merges, store: int = 200_000, longest: int = 64):
        self.m, self.store, self.longest = merges, store, longest
        self.known: dict[str, tuple[int, ...]] = {}

    def stream(self, letters: Iterable[str]) -> Iterator[int]:
        """Token ids of one word, given in pieces of byte letters, each as soon as it is stable.

        back[n] is where the last token of the encoding of the unsent part's first n letters starts (None: not
        asked for yet, -1: no encoding ends there). That token is unique: of the vocabulary's strings that end
        at n, the one that stays whole next to the token before it. Once the unsent part is twice the
        lookahead, the tokens are sent that the paths of all letters after which a later token can start have
        in common; the bound says how many these are at least."""
        vocab, fits, longest, ahead = self.m.vocab, self.m.fits, self.m.longest, self.m.lookahead
        text, held, before, mark = "", "", "", ""
        back: list[int | None] = [0]

        def state(n: int) -> int:
            end = mark if n == len(text) else ""
            for start in range(n - longest if n > longest else 0, n):
                token = text[start:n] + end
                if token in vocab:
                    if start:
                        first = back[start]
                        if first is None:
                            first = state(start)
                        if first < 0 or not fits(text[first:start], token):
                            continue
                    elif before and not fits(before, token):
                        continue
                    back[n] = start
                    return start
            back[n] = -1
            return -1

        for piece in letters:
            if piece:
                # the word's last letter carries its end: one letter is held until the next comes
                text, held = text + held + piece[:-1], piece[-1]
            if len(text) > 2 * ahead:
                back.extend([None] * (len(text) + 1 - len(back)))
                for n in range(1, len(text) + 1):
                    if back[n] is None:
                        state(n)
                common: set[int] | None = None
                for n in range(len(text) - longest + 1, len(text) + 1):
                    if back[n] >= 0:
                        path = {n}
                        while back[n]:
                            n = back[n]
                            path.add(n)
                        common = path if common is None else common & path
                stable = sorted(common or ())
                if not stable or stable[-1] < len(text) - ahead - longest:
                    raise RuntimeError("a token is not stable within the lookahead of the merge list")
                yield from [vocab[text[back[n] : n]] for n in stable]
                n = stable[-1]
                before, text, back = text[back[n] : n], text[n:], [0, *(x - n if x is not None and x >= n else -1 for x in back[n + 1 :])]
        text, mark = text + held, END
        back.extend([None] * (len(text) + 1 - len(back)))
        for n in range(256, len(text), 256):  # so that asking never goes deep
            for i in range(n - 255, n + 1):
                if back[i] is None:
                    state(i)
        n, path = len(text), []
        back[n] = state(n)
        while n:
            start = back[n]
            path.append(vocab[text[start:n] + (END if n == len(text) else "")])
            n = start
        path.reverse()
        yield from path

    def short(self, letters: str) -> list[int]:
        """`stream` for a whole word that is far shorter than the lookahead, of which nothing can leave before its
        end: its path is searched from the left, longest tokens first, taken back where they do not stay whole
        next to the token before. The last token of each prefix is unique, so no place is left twice."""
        vocab, fits, longest, n = self.m.vocab, self.m.fits, self.m.longest, len(letters)
        path: list[str] = []
        ends: list[int] = []
        dead: set[int] = set()
        at, before, end = 0, "", min(n, longest)
        while at < n:
            while end > at:
                token = letters[at:end] if end < n else letters[at:] + END
                if token in vocab and end not in dead and (not before or fits(before, token)):
                    break
                end -= 1
            if end > at:
                path.append(token)
                ends.append(end)
                at, before = end, token
                end = min(n, at + longest)
            else:
                dead.add(at)
                path.pop()
                end = ends.pop() - 1
                at, before = (ends[-1], path[-1]) if ends else (0, "")
        return [vocab[t] for t in path]

    def word(self, word: str) -> tuple[int, ...]:
        got = self.known.get(word)
        if got is None:
            letters = self.m.letters
            data = word.encode("utf-8")
            got = tuple(self.letters("".join([letters[b] for b in data])))
            if len(word) <= self.longest:
                if len(self.known) >= self.store:
                    self.known.clear()
                self.known[word] = got
        return got

    def letters(self, letters: str) -> Iterable[int]:
        """Ids of a word that is already written in byte letters."""
        if len(letters) <= 2 * self.longest:
            return self.short(letters)
        return self.stream((letters,))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text, as the tokenizer file's normalizer, split and merges define them."""
        if not text:
            return []
        out: list[int] = []
        word, special = self.word, self.m.special
        for part in self.m.specials.split(text) if self.m.specials else [text]:
            if part in special:
                out.append(special[part])
                continue
            if FAR.search(part):
                # rarer scripts: characters' classes differ between Unicode versions, so the file's own
                # normalizer and split cut the words; the transducer still encodes them
                for w, _ in self.m.library.pre_tokenizer.pre_tokenize_str(self.m.library.normalizer.normalize_str(part)):
                    out.extend(self.letters(w))
                continue
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            known = self.known
            for w in self.m.split.findall(part):
                out.extend(known.get(w) or word(w))
        return out


class Decoder:
    """Ids back to text, a piece at a time; holds at most one unfinished character."""

    def __init__(self, merges: Merges):
        byte = {c: b for b, c in enumerate(merges.letters)}
        self.strings = merges.strings
        self.bytes = {}
        for i, s in merges.strings.items():
            end = s.endswith(END) and i not in merges.special.values()
            body = s[: -len(END)] if end else s
            self.bytes[i] = s.encode() + b" " if i in merges.special.values() else bytes(byte[c] for c in body) + b" " * end

    def strings_of(self, ids: Iterable[int]) -> str:
        """The tokens' own strings joined by spaces: what a tokenizer file without a decoder defines."""
        return " ".join([self.strings[i] for i in ids])

    def text(self, ids: Iterable[int], step: int = 4096) -> Iterator[str]:
        """Plain text in pieces: a state machine carries the bytes of a character cut by a token edge."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        held: list[bytes] = []
        for i in ids:
            held.append(self.bytes[i])
            if len(held) == step:
                yield machine.decode(b"".join(held))
                held = []
        yield machine.decode(b"".join(held), final=True)


_READY: dict[str, tuple[Encoder, Decoder]] = {}


def ready(path: str) -> tuple[Encoder, Decoder]:
    """The encoder and decoder of a tokenizer file, made once in each worker."""
    if path not in _READY:
        merges = Merges(path)
        _READY[path] = Encoder(merges), Decoder(merges)
    return _READY[path]


def _append(batch: pa.RecordBatch, schema: T.StructType, new: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({f.name: new[f.name] if f.name in new else batch.column(f.name) for f in schema.fields})


def _with(df: DataFrame, fields: list[T.StructField]) -> T.StructType:
    names = {f.name for f in fields}
    return T.StructType([*(f for f in df.schema.fields if f.name not in names), *fields])


def _map(df: DataFrame, path: str, fields: list[T.StructField], make, text: str | None = None) -> DataFrame:
    """`df` with columns made by make(encoder, decoder, rows), from rows whose texts hold about a megabyte at a time
    (64 rows where no text is named)."""
    schema = _with(df, fields)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = ready(path)
        for batch in batches:
            for part in pieces(batch, text, 1 << 20) if text else (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                yield _append(part, schema, make(encoder, decoder, part))

    return df.mapInArrow(run, schema)


def _lists(lists: list[list[int]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, lists)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.fromiter((i for x in lists for i in x), np.int32, ends[-1])))


_IDS = T.ArrayType(T.IntegerType(), False)


def encode(df: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """`df` with the token ids of each whole text in column `into` (array<int>)."""
    return _map(df, path, [T.StructField(into, _IDS)], lambda e, d, part: {into: _lists([e.encode(x) for x in part.column(text).to_pylist()])}, text)


def decode(df: DataFrame, path: str, ids: str = "ids", into: str = "decoded", plain: bool = False) -> DataFrame:
    """`df` with each id list's text in column `into`.

    plain: the text itself, through the byte state machine; otherwise the tokens' strings joined by
    spaces, which is what the tokenizer file defines. Null ids give an empty text."""

    def make(_: Encoder, d: Decoder, part: pa.RecordBatch) -> dict[str, pa.Array]:
        return {into: pa.array(["".join(d.text(x or ())) if plain else d.strings_of(x or ()) for x in part.column(ids).to_pylist()], pa.string())}

    return _map(df, path, [T.StructField(into, T.StringType())], make)


def encode_decode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", plain: bool = False) -> DataFrame:
    """`encode`, then `decode`, in one pass over the rows."""

    def make(e: Encoder, d: Decoder, part: pa.RecordBatch) -> dict[str, pa.Array]:
        lists = [e.encode(x) for x in part.column(text).to_pylist()]
        return {ids: _lists(lists), decoded: pa.array(["".join(d.text(x)) if plain else d.strings_of(x) for x in lists], pa.string())}

    return _map(df, path, [T.StructField(ids, _IDS), T.StructField(decoded, T.StringType())], make, text)
