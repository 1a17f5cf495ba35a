"""Novelty of documents against a bounded history of those before them.

The order and the history are settled on slim rows (time, id, digest); texts are
then scored in runs of consecutive documents, each run with the history that
stands at its start, so runs are independent of each other.
"""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.session import durable

#: Documents that the reference's NoveltyIndex keeps by default, and documents scored in one group.
CAPACITY, RUN = 4096, 4096
#: Documents scored against one set of posting lists.
BLOCK = 512
TOKEN = re.compile(r"[a-z0-9]+")


def _remember(history: OrderedDict, digest: bytes, value: int, capacity: int) -> None:
    history.pop(digest, None)
    while len(history) >= capacity:
        history.popitem(last=False)
    history[digest] = value


def best_ppm(words: list[np.ndarray], first: int, low: list[int]) -> list[int]:
    """For each document k from ``first`` on: the greatest Jaccard overlap in ppm with documents low[k - first] to k - 1, rounded down."""
    size = np.array([len(w) for w in words], dtype=np.int64)
    out = []
    for a in range(first, len(words), BLOCK):
        b = min(a + BLOCK, len(words))
        base = low[a - first]
        ids = np.concatenate([*words[base:b], np.empty(0, np.int64)])
        at = np.repeat(np.arange(b - base), size[base:b])
        by = np.argsort(ids, kind="stable")
        at = at[by]
        end = np.cumsum(np.bincount(ids, minlength=1))
        for k in range(a, b):
            lists = [at[end[t - 1] if t else 0 : end[t]] for t in words[k].tolist()]
            frm, to = low[k - first] - base, k - base
            if not lists or frm >= to:
                out.append(0)
                continue
            both = np.bincount(np.concatenate(lists), minlength=b - base)[frm:to]
            out.append(int((both * 1_000_000 // (size[base + frm : k] + size[k] - both)).max()))
    return out


def novelty(documents: DataFrame, capacity: int = CAPACITY, run: int = RUN) -> DataFrame:
    """source, doc_id and novelty_ppm: a million less the greatest overlap of words (Jaccard, ppm, rounded down) with the history.

    The history is that of the reference's NoveltyIndex: the last ``capacity``
    distinct texts of all sources in order of received_at and doc_id; a text that
    comes again is scored against its copy and moves to the end. Rows without
    received_at come last. Words are runs of a to z and digits of the case-folded
    text; a text without words, or null, is wholly novel. Every row gives one row.

    The history is kept in one pass over (order, digest) in one task, which holds
    ``capacity`` digests; texts aren't in it.
    """
    rows = documents.select("source", F.col("doc_id").cast("long").alias("doc_id"), "received_at", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    docs = durable(rows.withColumn("digest", F.unhex(F.sha2("text", 256))), "novelty")

    def histories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        history: OrderedDict = OrderedDict()
        place = 0
        for batch in batches:
            told: list[tuple[int, int, int, bool]] = []
            for row, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                group = place // run
                if place % run == 0:
                    told += [(group, at, r, False) for at, r in history.values()]
                told.append((group, place, row, True))
                _remember(history, digest, (place, row), capacity)
                place += 1
            columns = zip(*told) if told else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], names=["group", "place", "own_row", "own"])

    order = (F.asc_nulls_last("received_at"), "doc_id", "digest", "row")
    slim = docs.select("row", "digest", "received_at", "doc_id").repartition(1).sortWithinPartitions(*order).select("row", "digest")
    members = durable(slim.mapInArrow(histories, "group long, place long, own_row long, own boolean"), "histories")

    def score(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        own = table.column("own").to_pylist()
        first = own.index(True)
        number: dict[str, int] = {}
        words = [np.array([number.setdefault(w, len(number)) for w in set(TOKEN.findall(t.casefold()))], dtype=np.int64) for t in table.column("text").to_pylist()]
        history: OrderedDict = OrderedDict()
        low = []
        for k, digest in enumerate(table.column("digest").to_pylist()):
            if k >= first:
                low.append(next(iter(history.values()), k))
            _remember(history, digest, k, capacity)
        told = pa.array([1_000_000 - x for x in best_ppm(words, first, low)], pa.int64())
        return pa.table([*table.slice(first).select(["source", "doc_id"]).columns, told], names=["source", "doc_id", "novelty_ppm"])

    texts = members.join(docs.select("row", "source", "doc_id", "text", "digest"), F.col("own_row") == F.col("row")).select("group", "place", "own", "source", "doc_id", "text", "digest")
    return texts.groupBy("group").applyInArrow(score, "source string, doc_id long, novelty_ppm long")
