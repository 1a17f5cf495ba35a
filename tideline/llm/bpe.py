"""Byte-level BPE as a lazily determinised finite-state transducer, and its decoder.

The encoding of a piece of text is the one token sequence whose neighbours are
all compatible: (a, b) is compatible if merging the bytes of a and b gives a, b.
So for every prefix of a piece the last token is determined, and dropping that
token gives the encoding of a shorter prefix. The transducer reads bytes, keeps
the part of this tree that later bytes can still reach, and emits the tokens on
which all reachable branches agree. Its state is the last emitted token and the
bytes read since; transitions are computed when first taken and then looked up.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tideline.session import spread

DEFAULT_VOCABULARY = os.environ.get("TIDELINE_BPE", "/opt/tokenizers/byte_bpe_50k.json")
#: The split of text into pieces that belongs to this vocabulary (fixed value).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries after which the lazily filled tables start afresh; results don't depend on them.
TABLE = 1_000_000
#: Pending bytes beyond which a piece is merged directly instead of adding states.
PENDING = 256


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.token = {i: b for b, i in vocabulary.items()}
        self.id = vocabulary
        self.merge = {(vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in enumerate(merges)}
        self.single = [vocabulary[bytes([b])] for b in range(256)]
        self.longest = max(map(len, vocabulary))
        #: All proper prefixes of tokens: a token may still grow from there.
        self.prefixes = {t[:k] for t in vocabulary for k in range(1, len(t))}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.reset()

    @classmethod
    def load(cls, path: str) -> Transducer:
        """From a tokenizer file with model.vocab and model.merges over the byte alphabet."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        return cls({raw(t): i for t, i in model["vocab"].items()}, [(raw(a), raw(b)) for a, b in merges])

    def reset(self) -> None:
        self.states: dict[tuple[int, bytes], int] = {(-1, b""): 0}
        self.state_of: list[tuple[int, bytes]] = [(-1, b"")]
        self.step: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.flush: dict[int, tuple[int, ...]] = {}
        self.memo: dict[str, tuple[int, ...]] = {}

    def merged(self, data: bytes) -> list[int]:
        """The encoding by its definition: the merge of lowest rank first, leftmost first."""
        ids = [self.single[b] for b in data]
        if len(ids) > 64:
            return self._merged_long(ids)
        while len(ids) > 1:
            rank, at = min(((self.merge[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merge), default=(None, 0))
            if rank is None:
                break
            ids[at : at + 2] = [self.merge[ids[at], ids[at + 1]][1]]
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list, for long pieces."""
        import heapq

        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(self.merge[p][0], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merge]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.merge[a, b][1], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (p := (ids[k], ids[after[k]])) in self.merge:
                    heapq.heappush(heap, (self.merge[p][0], k, *p))
        return [x for x in ids if x >= 0]

    def compatible(self, a: int, b: int) -> bool:
        """Whether token b can follow token a; a = -1 is the start of a piece."""
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) > TABLE:
                self.pairs.clear()
            want = [b] if a < 0 else [a, b]
            ok = self.pairs[a, b] = self.merged(b"".join(self.token[x] for x in want)) == want
        return ok

    def _tree(self, last: int, data: bytes) -> list[int | None]:
        """The last token of each prefix of ``data`` when ``last`` stands before it; None where no branch through its start ends."""
        out: list[int | None] = [last]
        for i in range(1, len(data) + 1):
            found = None
            for k in range(max(0, i - self.longest), i):
                if out[k] is not None and (t := self.id.get(data[k:i])) is not None and self.compatible(out[k], t):
                    found = t
                    break
            out.append(found)
        return out

    def _path(self, tree: list[int | None], end: int) -> list[int]:
        """Positions from ``end`` back to the start."""
        at = [end]
        while at[-1] > 0:
            at.append(at[-1] - len(self.token[tree[at[-1]]]))
        return at

    def _advance(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        last, pending = self.state_of[state]
        data = pending + bytes([byte])
        tree = self._tree(last, data)
        n = len(data)
        alive = [n] if tree[n] is not None else []
        alive += [k for k in range(max(0, n - self.longest), n) if tree[k] is not None and data[k:] in self.prefixes]
        shared = set(self._path(tree, alive[0]))
        for k in alive[1:]:
            shared &= set(self._path(tree, k))
        cut = max(shared)
        emitted = [tree[k] for k in self._path(tree, cut)[:-1]][::-1] if cut else []
        key = (emitted[-1] if emitted else last, data[cut:])
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = len(self.state_of)
            self.state_of.append(key)
        return to, tuple(emitted)

    def _ending(self, state: int) -> tuple[int, ...]:
        last, data = self.state_of[state]
        tree = self._tree(last, data)
        return tuple(tree[k] for k in self._path(tree, len(data))[:-1])[::-1]

    def piece(self, data: bytes) -> tuple[int, ...]:
        """Token ids of one piece."""
        if len(self.step) > TABLE:
            self.reset()
        out: list[int] = []
        state, step = 0, self.step
        for b in data:
            key = state << 8 | b
            to = step.get(key)
            if to is None:
                if len(self.state_of[state][1]) > PENDING:
                    return tuple(self.merged(data))
                to = step[key] = self._advance(state, b)
            state, emitted = to
            if emitted:
                out += emitted
        rest = self.flush.get(state)
        if rest is None:
            rest = self.flush[state] = self._ending(state)
        return (*out, *rest)

    def encode(self, text: str) -> list[int]:
        import regex

        memo, out = self.memo, []
        for m in regex.finditer(PIECES, text):
            p = m.group()
            ids = memo.get(p)
            if ids is None:
                ids = self.piece(p.encode("utf-8"))
                if len(p) <= 40:
                    if len(memo) > TABLE // 4:
                        memo.clear()
                    memo[p] = ids
            out += ids
        return out


#: UTF-8 by lead byte: following bytes, and the range of the first of them (fixed values).
_LEAD = {**{b: (0, 0, 0) for b in range(0x80)}, **{b: (1, 0x80, 0xBF) for b in range(0xC2, 0xE0)}, **{b: (2, 0x80, 0xBF) for b in range(0xE0, 0xF0)}, **{b: (3, 0x80, 0xBF) for b in range(0xF0, 0xF5)}}
_LEAD |= {0xE0: (2, 0xA0, 0xBF), 0xED: (2, 0x80, 0x9F), 0xF0: (3, 0x90, 0xBF), 0xF4: (3, 0x80, 0x8F)}


class Utf8Stream:
    """Bytes to text as they come; a character may be cut anywhere. A malformed stretch gives one U+FFFD per maximal part."""

    def __init__(self) -> None:
        self.need, self.lo, self.hi, self.point = 0, 0x80, 0xBF, 0

    def feed(self, data: bytes) -> str:
        out: list[str] = []
        for b in data:
            if self.need:
                if self.lo <= b <= self.hi:
                    self.point = self.point << 6 | b & 0x3F
                    self.need -= 1
                    self.lo, self.hi = 0x80, 0xBF
                    if not self.need:
                        out.append(chr(self.point))
                    continue
                out.append("�")
                self.need = 0
            lead = _LEAD.get(b)
            if lead is None:
                out.append("�")
            elif lead[0] == 0:
                out.append(chr(b))
            else:
                self.need, self.lo, self.hi = lead
                self.point = b & (0x3F >> self.need)
        return "".join(out)

    def end(self) -> str:
        cut, self.need = self.need, 0
        return "�" if cut else ""


def decode_stream(transducer: Transducer, ids: Iterable[int]) -> Iterator[str]:
    """Text for one token after the other, as soon as its characters are whole."""
    utf8 = Utf8Stream()
    for i in ids:
        yield utf8.feed(transducer.token[i])
    yield utf8.end()


_LOADED: dict[str, Transducer] = {}


def loaded(path: str) -> Transducer:
    """One transducer per worker process, so that its tables are filled once."""
    if path not in _LOADED:
        _LOADED[path] = Transducer.load(path)
    return _LOADED[path]


def token_ids(text: Column | str, path: str = DEFAULT_VOCABULARY) -> Column:
    """Token ids of a text column, without special tokens; their strings in a text are ordinary text. Null and empty texts give an empty list."""

    def encode(batch: pd.Series) -> pd.Series:
        t = loaded(path)
        return pd.Series([t.encode(x) if isinstance(x, str) and x else [] for x in batch], dtype=object)

    return F.pandas_udf(encode, ArrayType(IntegerType()))(text)


def token_text(ids: Column | str, path: str = DEFAULT_VOCABULARY) -> Column:
    """The text of a list of ids; null gives null. An id that the vocabulary lacks is an error."""

    def decode(batch: pd.Series) -> pd.Series:
        t = loaded(path)
        return pd.Series([None if x is None else "".join(decode_stream(t, x)) for x in batch], dtype=object)

    return F.pandas_udf(decode, "string")(ids)


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """One row per row of the corpus: key and ids. A map without a shuffle; extra columns are dropped, repeated rows stay."""
    return spread(documents.select(key, F.col(text).cast("string").alias("__text"))).select(key, token_ids("__text", path).alias("ids"))
