"""Held-out passages inside a corpus, whole or in part.

Each shard of the corpus (documents of about ``SHARD_WORDS`` words) gets a suffix
array over its words, in the full order of the word suffixes. Every suffix of every
held-out item is binary-searched in it by its first ``SEED`` words; hits are
lengthened to the longest verbatim matches, whose places are told. An exact check
then grows each match to both sides through single-word edits and keeps it if the
stretch is long and clean enough.

A stretch of n >= 20 words with at most n/8 edits holds a verbatim run of at least
six words ((n - e) / (e + 1) >= 6 for e <= n/8), so a seed of five misses none.

The corpus is read and cleaned once, whatever the number of items: each shard is
searched for one block of items after the other, and a task holds one shard and
one block. Blocks travel as files, so neither driver nor executors hold all items.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.session import spread

SEED, LEAST, PER_EDIT = 5, 20, 8
#: Words of the items in one block: at most 24 MB as Python objects. A longer item is a block of its own.
BLOCK_WORDS = 60_000
#: Words after which a shard is closed.
SHARD_WORDS = 1_000_000
#: Places that are looked at together, so that a phrase common to many items and documents doesn't fill memory.
HITS = 2_000_000

#: Tags that stand inside words and lines; all others end a word.
INLINE = re.compile(r"</?(?:a|abbr|b|big|code|del|em|font|i|ins|kbd|mark|q|s|small|span|strong|sub|sup|tt|u|wbr)(?:\s[^<>]*)?/?>", re.I)
TAG = re.compile(r"<!--.*?-->|</?[a-zA-Z][^<>]*>", re.S)
#: Soft hyphens, zero-width marks, joiners, direction marks, variation selectors.
INVISIBLE = re.compile(r"[\u00ad\u034f\u061c\u115f-\u1160\u17b4-\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]")
PUNCT = re.compile(r"[^\w\s]|_")
#: A word broken at a line's end, and a space before a decimal part.
BROKEN = re.compile(r"(?<=\w)[-\u2010\u2011][ \t]*[\r\n]+[ \t>|]*(?=\w)")
LOOSE = re.compile(r"(?<=\d)\s+(?=[.,:]\d)")


def words(text: str | None) -> list[str]:
    """The words of a text, so that case, punctuation, markup, spacing and Unicode forms don't matter.

    Punctuation inside a word is dropped, not a boundary: 752,386 is one word.
    Accents are dropped too. None and blank texts have no words.
    """
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
        text = html.unescape(text) if "&" in text else text  # markup that was escaped twice
    if "<" in text:
        text = TAG.sub(" ", INLINE.sub("", text))
    if not text.isascii():
        text = INVISIBLE.sub("", text)
        text = unicodedata.normalize("NFKD", text)
        text = "".join(c for c in text if not unicodedata.combining(c))
    text = LOOSE.sub("", BROKEN.sub("", text))
    return PUNCT.sub("", text.replace("—", " ").replace("–", " ").replace("--", " ").casefold()).split()


def word_id(word: str) -> int:
    """A word's identity in 63 bits, the same in every process."""
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) >> 1


@dataclass
class Block:
    """Items as numbers of the block's own vocabulary; 0 stands between items, and for any other word."""

    ids: list[int]
    seqs: list[np.ndarray]
    #: Identities of the vocabulary, ascending; a word's number is its place here plus one.
    vocabulary: np.ndarray
    starts: np.ndarray
    keys: np.ndarray
    where: np.ndarray

    def numbers(self, words: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at + 1, 0)


def make_block(items: list[tuple[int, list[str]]]) -> Block:
    raw = [np.array([word_id(w) for w in ws], np.int64) for _, ws in items]
    vocabulary = np.unique(np.concatenate(raw)) if raw else np.zeros(0, np.int64)
    seqs = [np.searchsorted(vocabulary, x).astype(np.int64) + 1 for x in raw]
    keys = np.concatenate([np.r_[s, np.zeros(SEED, np.int64)] for s in seqs]) if seqs else np.zeros(0, np.int64)
    starts = np.cumsum([0, *(len(s) + SEED for s in seqs)])
    return Block([i for i, _ in items], seqs, vocabulary, starts, keys, np.repeat(np.arange(len(seqs)), np.diff(starts)))


def _left(known: np.ndarray) -> np.ndarray:
    """For each place how many known words follow from there on without a break."""
    n = len(known)
    stop = np.where(known, n, np.arange(n))
    return np.minimum.accumulate(stop[::-1])[::-1] - np.arange(n)


class SuffixArray:
    """Suffixes of a shard, and of a block of items, as ranks by their first 1, 2, 4, ... words.

    ``flat`` holds the block's words, then the shard's. A suffix ends at the first
    word that is in no item, as it can't match beyond. Ranks are doubled until they
    tell all suffixes apart, or cover the longest of them; ``at`` holds the shard's
    suffixes of at least ``SEED`` words in that order.
    """

    def __init__(self, flat: np.ndarray, split: int):
        n = len(flat)
        left = _left(flat > 0)
        #: Only runs of at least SEED known words matter: those of which the first place has as many.
        first = np.r_[True, flat[:-1] == 0] if n else np.zeros(0, bool)
        run = np.cumsum(first) - 1
        self.used = np.flatnonzero((flat > 0) & (left[first][run] >= SEED)) if n else np.zeros(0, np.int64)
        longest = int(left.max(initial=0))
        self.levels = [np.r_[flat, np.zeros(1, np.int64)]]
        k = 1
        while 2 * k <= longest and len(self.used):
            low = self.levels[-1]
            pair = low[self.used] * (int(low.max()) + 1) + low[np.minimum(self.used + k, n)]
            distinct, rank = np.unique(pair, return_inverse=True)
            level = np.zeros(n + 1, np.int64)
            level[self.used] = rank + 1
            self.levels.append(level)
            k *= 2
            if k >= 4 and len(distinct) == len(self.used):
                break
        self.left = np.r_[left, 0]
        long = self.used[left[self.used] >= SEED]
        shard = long[long >= split]
        self.at = shard[np.argsort(self.levels[-1][shard], kind="stable")]
        self.tests = long[long < split]
        self.keys = self.seed(self.at)

    def seed(self, at: np.ndarray) -> np.ndarray:
        """The first five words as one number, in the order of the suffixes."""
        if len(self.levels) < 3:
            return np.zeros(len(at), np.int64)
        fifth = self.levels[0]
        return self.levels[2][at] * (int(fifth.max(initial=0)) + 1) + fifth[at + 4]

    def search(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each test suffix with the range of shard suffixes that share its first five words."""
        asked = self.seed(self.tests)
        return self.tests, np.searchsorted(self.keys, asked, "left"), np.searchsorted(self.keys, asked, "right")

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest verbatim match from places a and b on."""
        n = len(self.levels[0]) - 1
        out = np.zeros(len(a), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            ranks, k = self.levels[level], 1 << level
            live = np.arange(len(a))
            while len(live):
                x = ranks[np.minimum(a[live] + out[live], n)]
                live = live[(x > 0) & (x == ranks[np.minimum(b[live] + out[live], n)])]
                out[live] += k
                if level < len(self.levels) - 1:
                    break
        #: Ranks of suffixes that end early are equal beyond their end.
        return np.minimum(out, np.minimum(self.left[a], self.left[b]))


def reach(a: list[int], b: list[int], edits: int) -> list[int]:
    """Words of ``a`` that an alignment from the start of both covers with 0..edits edits, ending on an equal word.

    Edits replace, drop or add one word. b holds 0 for words that are in no item.
    Per diagonal the furthest point is followed. Where edits stand closer than
    equal words the figure can fall short of the best; it is exact for stretches as
    sparse in edits as a leak must be.
    """
    na, nb = len(a), len(b)

    def slide(i: int, j: int) -> int:
        while i < na and j < nb and a[i] == b[j]:
            i, j = i + 1, j + 1
        return i

    best = i = slide(0, 0)
    out, front = [best], {0: i}  # by diagonal j - i
    for _ in range(edits):
        new: dict[int, int] = {}
        for d, i in front.items():
            for dd, step in ((d, 1), (d - 1, 1), (d + 1, 0)):  # replace, missing from b, added in b
                ii = i + step
                if ii <= na and ii + dd <= nb:
                    end = slide(ii, ii + dd)
                    if end > ii and end > best:
                        best = end
                    if end > new.get(dd, -1):
                        new[dd] = end
        front = new
        out.append(best)
    return out


def grown(item: list[int], doc: list[int], i: int, j: int, n: int) -> tuple[int, int]:
    """The longest stretch of the item's words through the match item[i:i+n] = doc[j:j+n], and its edits, that keeps to one edit in ``PER_EDIT``."""
    #: A stretch covers no more words than the document has, and its edits, so these are at most a seventh of the document's words.
    most = min(len(item) // PER_EDIT, len(doc) // (PER_EDIT - 1))
    wide = len(doc) + most
    right = reach(item[i + n : i + n + wide], doc[j + n : j + n + len(item) + most], most)
    left = reach(item[max(0, i - wide) : i][::-1], doc[max(0, j - len(item) - most) : j][::-1], most)
    best = (0, 0)
    for x, r in enumerate(right):
        for y, s in enumerate(left):
            if PER_EDIT * (x + y) <= n + r + s and n + r + s > best[0]:
                best = (n + r + s, x + y)
    return best


COLUMNS = ["doc_id", "item_id", "verbatim_words", "stretch_words", "edits", "doc_word", "item_word"]
SCHEMA = "doc_id long, item_id long, verbatim_words int, stretch_words int, edits int, doc_word int, item_word int"


def _parts(lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(test from, test to, hit from, hit to): ranges with about ``HITS`` hits each; one test's hits may be split."""
    total = np.cumsum(np.r_[0, hi - lo])
    a = 0
    while a < len(lo):
        b = max(a + 1, int(np.searchsorted(total, total[a] + HITS, "right")) - 1)
        for begin in range(0, int(total[b] - total[a]) if b == a + 1 else 1, HITS):
            yield a, b, begin, begin + HITS
        a = b


def search_shard(doc_ids: list[int], docs: list[np.ndarray], block: Block) -> Iterator[tuple[int, ...]]:
    """A row of ``COLUMNS`` for each pair with a stretch of ``LEAST`` words; ``docs`` hold word ids. A pair may come more than once."""
    texts = [block.numbers(x) for x in docs]
    split = len(block.keys)
    flat = np.concatenate([block.keys, *(np.r_[x, 0] for x in texts)])
    begin = split + np.cumsum([0, *(len(x) + 1 for x in texts)])
    index = SuffixArray(flat, split)
    tests, lo, hi = index.search()
    for a, b, from_, to in _parts(lo, hi):
        count = hi[a:b] - lo[a:b]
        test = np.repeat(tests[a:b], count)
        at = np.repeat(lo[a:b], count) + np.arange(len(test)) - np.repeat(np.cumsum(count) - count, count)
        place = index.at[at]
        if b == a + 1:
            test, place = test[from_:to], place[from_:to]
        #: A hit whose predecessor words agree too lies inside a longer match.
        inner = (test > 0) & (flat[test - 1] == flat[place - 1]) & (flat[test - 1] > 0)
        test, place = test[~inner], place[~inner]
        length = index.shared(test, place)
        item, doc = block.where[test], np.searchsorted(begin, place, "right") - 1
        order = np.lexsort((place, item, doc))
        item, doc, test, place, length = item[order], doc[order], test[order], place[order], length[order]
        edge = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (doc[1:] != doc[:-1])]) if len(item) else np.zeros(0, int)
        for f, g in zip(edge, np.r_[edge[1:], len(item)]):
            seq, text = block.seqs[item[f]].tolist(), texts[doc[f]].tolist()
            best = (0, 0)
            for k in range(f, g):
                best = max(best, grown(seq, text, int(test[k] - block.starts[item[k]]), int(place[k] - begin[doc[k]]), int(length[k])), key=lambda x: (x[0], -x[1]))
            if best[0] >= LEAST:
                k = f + int(np.argmax(length[f:g]))
                yield doc_ids[doc[f]], block.ids[item[f]], int(length[k]), *best, int(place[k] - begin[doc[k]]), int(test[k] - block.starts[item[k]])


def _blocks(items: DataFrame, block_words: int) -> list[Broadcast]:
    """The items, cleaned in tasks, as broadcast blocks; the driver holds one block at a time."""

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ws = batch["text"].map(words)
            keep = ws.map(len) >= LEAST
            yield pd.DataFrame({"item_id": batch["item_id"][keep], "words": ws[keep].map(" ".join)})

    spark = items.sparkSession
    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("string").alias("text")).dropna().mapInPandas(clean, "item_id long, words string")
    out: list[Broadcast] = []
    block: list[tuple[int, list[str]]] = []
    size = 0
    for i, text in rows.toLocalIterator():
        ws = text.split(" ")
        if block and size + len(ws) > block_words:
            out.append(spark.sparkContext.broadcast(make_block(block)))
            block, size = [], 0
        block.append((i, ws))
        size += len(ws)
    if block:
        out.append(spark.sparkContext.broadcast(make_block(block)))
    return out


def leaked(documents: DataFrame, items: DataFrame, text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every document that holds a stretch of an item, with that item and the place of the longest verbatim match.

    A stretch has at least 20 of the item's words in order, with at most one word
    in eight replaced, missing or added. Letter case, accents, punctuation, markup,
    spacing and invisible characters don't matter. Each item is searched in each
    shard of the corpus; a document isn't shuffled.

    Null, empty and blank texts leak nothing, and items of fewer than 20 words
    can't be leaked; an item of any length is searched whole. Rows without an id are passed over. Repeated documents or
    items count each by their own id; a repeated id gives one row, the longest
    stretch. No documents or no items give no rows. Extra columns are ignored.

    Returns: doc_id, item_id, verbatim_words, stretch_words, edits, and the words
    (from 0) of document and item at which the longest verbatim match begins.
    """
    spark = documents.sparkSession
    docs = spread(documents.select(F.col("doc_id").cast("long"), F.col(text).cast("string").alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()))
    blocks = _blocks(items, block_words)
    if not blocks:
        return spark.createDataFrame([], SCHEMA)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        ids: list[int] = []
        held: list[np.ndarray] = []
        size = 0

        def close() -> Iterator[pd.DataFrame]:
            for shared in blocks:
                yield pd.DataFrame(list(search_shard(ids, held, shared.value)), columns=COLUMNS)
                if len(blocks) > 1:
                    vars(shared).pop("_value", None)  # one block in memory at a time; its file stays

        for batch in batches:
            for i, t in zip(batch["doc_id"], batch["text"]):
                ws = words(t)
                if len(ws) < LEAST - LEAST // PER_EDIT:
                    continue
                if len(known) > 1_000_000:
                    known.clear()
                x = np.fromiter((known.get(w) or known.setdefault(w, word_id(w)) for w in ws), np.int64, len(ws))
                ids.append(i)
                held.append(x)
                size += len(x)
                if size >= SHARD_WORDS:
                    yield from close()
                    ids, held, size = [], [], 0
        if ids:
            yield from close()

    best = F.max_by(F.struct(*COLUMNS[2:]), F.struct("stretch_words", (-F.col("edits")).alias("e"), "verbatim_words"))
    return docs.mapInPandas(run, SCHEMA).groupBy("doc_id", "item_id").agg(best.alias("x")).select("doc_id", "item_id", "x.*")


def without_leaks(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The corpus without the documents that leak; the found ids are fewer than the documents, the join is planned by size."""
    return documents.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
