"""Stable hashes of columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def hash_bucket(value: Column | str, buckets: int) -> Column:
    """First 64 bits of SHA-256 modulo ``buckets``: the same on any engine."""
    v = F.col(value) if isinstance(value, str) else value
    head = F.conv(F.substring(F.sha2(v, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (head % buckets).cast("int")


def canonical_json(*names: str) -> Column:
    """JSON of the named columns in alphabetical order, nulls kept."""
    return F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"})


def economic_hash(*names: str) -> Column:
    """SHA-256 over the canonical JSON of the columns that carry meaning."""
    return F.sha2(canonical_json(*names), 256)


def sequence_hash(order: Column | str, digest: Column | str) -> Column:
    """Aggregate: SHA-256 over the digests of a group in order. Groups must be bounded."""
    rows = F.array_sort(F.collect_list(F.struct(order, digest)))
    return F.sha2(F.concat_ws("", F.transform(rows, lambda x: x[digest if isinstance(digest, str) else "col2"])), 256)


def hash_chain(order: Column | str, digest: Column | str) -> Column:
    """Aggregate: h = SHA-256(h + digest) folded over a group in order, from the empty text."""
    rows = F.array_sort(F.collect_list(F.struct(order, digest)))
    return F.aggregate(rows, F.lit(""), lambda h, x: F.sha2(F.concat(h, x[digest if isinstance(digest, str) else "col2"]), 256))


#: 64-bit FNV-1a (fixed values).
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


@F.pandas_udf(LongType())
def fnv1a(texts: pd.Series) -> pd.Series:
    """FNV-1a of the UTF-8 bytes as a signed 64-bit number, all texts of a batch in step."""
    data = [t.encode() if isinstance(t, str) else b"" for t in texts]
    n = np.array([len(b) for b in data])
    h = np.full(len(data), FNV_OFFSET, np.uint64)
    order = np.argsort(-n, kind="stable")
    flat = np.frombuffer(b"".join(data[i] for i in order), np.uint8).astype(np.uint64) if n.sum() else np.zeros(0, np.uint64)
    at = np.concatenate([[0], np.cumsum(n[order])[:-1]]) if len(n) else np.zeros(0, int)
    with np.errstate(over="ignore"):
        for k in range(n.max(initial=0)):
            live = np.searchsorted(-n[order], -k, "left")
            h[order[:live]] = (h[order[:live]] ^ flat[at[:live] + k]) * np.uint64(FNV_PRIME)
    out = pd.Series(h.view(np.int64)).astype("Int64")
    out[texts.isna().to_numpy()] = pd.NA
    return out


#: The multipliers and shifts are fixed values of a published 64-bit mixer.
@F.pandas_udf(LongType())
def counter_sample(seed: pd.Series, ordinal: pd.Series, upper: pd.Series) -> pd.Series:
    """A number in [0, upper) from a 64-bit counter-based generator: a function of seed and ordinal only."""
    with np.errstate(over="ignore"):
        x = seed.to_numpy(np.int64).view(np.uint64) + (ordinal.to_numpy(np.int64).view(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return pd.Series((x % np.maximum(upper.to_numpy(np.int64), 1).astype(np.uint64)).astype(np.int64))


def sampled_every(ordinal: Column | str, n: int, seed: int, first: int = 0) -> Column:
    """Every n-th row of an ordinal from ``first`` on, shifted by the seed."""
    o = F.col(ordinal) if isinstance(ordinal, str) else ordinal
    return (o >= first) & (F.pmod(o - first + seed % n, F.lit(n)) == 0)

