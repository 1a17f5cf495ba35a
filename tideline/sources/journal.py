"""An append-only journal as tables: records in segments, each segment with a digest, the digests in one chain.

Records are hashed and segments digested side by side; only the chain over the
segments, one row each, is sequential. A record is found by its number through
the footer's minima and maxima, as segments are written in order.
"""

from __future__ import annotations

import hashlib
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.folds import ordered_fold
from tideline.session import durable

SEGMENT_ROWS = 1000


def records(df: DataFrame, sequence: str, payload: str, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """segment, sequence, payload, sha256 of a table with a unique bigint number; rows without number or payload drop out."""
    s = F.col(sequence).cast("long")
    return df.select(F.floor(s / segment_rows).cast("long").alias("segment"), s.alias("sequence"), F.col(payload).cast("string").alias("payload")).dropna().withColumn("sha256", F.sha2("payload", 256))


def digests(rows: DataFrame) -> DataFrame:
    """segment, first and last sequence, rows, and the digest over the record hashes, worked out from the payloads, in order; a segment's hashes (at most its rows, a parameter) are one array."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("sequence", F.sha2("payload", 256).alias("h")))), lambda x: x.h)
    return rows.groupBy("segment").agg(F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"), F.count(F.lit(1)).alias("n_rows"), F.sha2(F.array_join(listed, ""), 256).alias("digest"))


def chain(segments: DataFrame) -> DataFrame:
    """The segments with ``link``: SHA-256 over the link before and the own digest (texts in hexadecimal; empty before the first)."""

    def step(state: Any, row: tuple) -> tuple[Any, tuple]:
        segment, first, last, n, digest = row
        link = hashlib.sha256(((state or "") + digest).encode()).hexdigest()
        return link, (segment, first, last, n, digest, link)

    one = segments.withColumn("journal", F.lit(0))  # a row per segment
    out = "segment long, first_sequence long, last_sequence long, n_rows long, digest string, link string"
    return ordered_fold(one, ["journal"], ["segment"], lambda: None, step, ["segment", "first_sequence", "last_sequence", "n_rows", "digest"], out).drop("journal")


def write(df: DataFrame, sequence: str, payload: str, segment_rows: int = SEGMENT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Appends a table to a new journal in the shared folder, in order of the number; returns (records, chained segments) as read back."""
    rows = durable(records(df, sequence, payload, segment_rows).repartitionByRange("sequence").sortWithinPartitions("sequence"), "journal")
    return rows, durable(chain(digests(rows)), "links")


def verify(rows: DataFrame, links: DataFrame) -> DataFrame:
    """segment and state: OK up to the first segment whose digest, worked out anew, isn't the stored one or whose link doesn't follow; that one CORRUPT or MISSING, all later UNVERIFIED."""
    again = digests(rows).select("segment", F.col("digest").alias("found"))
    relinked = chain(links.select("segment", "first_sequence", "last_sequence", "n_rows", "digest")).select("segment", F.col("link").alias("relink"))
    j = links.join(again, "segment", "left").join(relinked, "segment", "left")
    bad = F.when(F.col("found").isNull(), "MISSING").when((F.col("found") != F.col("digest")) | (F.col("link") != F.col("relink")), "CORRUPT")
    j = j.withColumn("bad", bad)
    first = j.where("bad is not null").agg(F.min("segment").alias("first_bad"))
    j = j.join(F.broadcast(first), how="cross")  # one row
    return j.select("segment", F.when(F.col("first_bad").isNull() | (F.col("segment") < F.col("first_bad")), "OK").when(F.col("segment") == F.col("first_bad"), F.col("bad")).otherwise("UNVERIFIED").alias("state"))


def lookup(rows: DataFrame, links: DataFrame, wanted: list[int]) -> DataFrame:
    """The records of some numbers (a short list of the caller's) with OK, CORRUPT and the like of their segment, or NOT_FOUND."""
    asked = rows.sparkSession.createDataFrame([(n,) for n in sorted(set(wanted))], "sequence long")
    hit = rows.where(F.col("sequence").isin([int(n) for n in wanted])).select("sequence", "segment", "payload").join(verify(rows, links), "segment", "left")
    return asked.join(hit, "sequence", "left").select("sequence", "payload", F.coalesce("state", F.lit("NOT_FOUND")).alias("state"))


def between(rows: DataFrame, links: DataFrame, first: int, last: int) -> DataFrame:
    """The verified records of a range of numbers, both ends included, in order; records of other segments are left out."""
    ok = verify(rows, links).where("state = 'OK'").select("segment")
    return rows.where(F.col("sequence").between(first, last)).join(ok, "segment", "left_semi").select("sequence", "payload").orderBy("sequence")
