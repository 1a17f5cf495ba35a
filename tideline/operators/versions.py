"""Attributes as known at event time: a bitemporal as-of join."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Events of one entity that a task takes at once; a hotter entity is salted.
GROUP_ROWS = 100_000
#: Entities that can be hot at most: of N events, one is hot only beyond N / ``HOT`` of them.
HOT = 100_000
_OPEN = np.iinfo(np.int64).max


def latest_valid(t: np.ndarray, known: np.ndarray, start: np.ndarray, end: np.ndarray, available: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each event the index of the revision of highest rank with available <= known and start <= t < end; -1 for none.

    The revisions' bounds cut time into segments, over which lies a binary tree. A
    revision stands at the fewest nodes that cover its interval, at most two a level;
    at a node revisions are ordered by availability and carry the running maximum of
    rank. An event asks the nodes above its segment, each by one binary search for
    (node, availability). So n revisions take n log n cells, however they overlap.
    """
    out = np.full(len(t), -1, np.int64)
    n = len(start)
    if not n or not len(t):
        return out
    bounds = np.unique(np.r_[start, end[end != _OPEN]])
    size = 1 << int(len(bounds) - 1).bit_length()
    left, right = np.searchsorted(bounds, start) + size, np.where(end == _OPEN, len(bounds), np.searchsorted(bounds, end)) + size
    by_rank = np.argsort(rank, kind="stable")
    place = np.empty(n, np.int64)
    place[by_rank] = np.arange(n)
    nodes, holders, live = [], [], np.flatnonzero(left < right)
    while len(live):
        odd = live[left[live] % 2 == 1]
        nodes.append(left[odd])
        holders.append(odd)
        left[odd] += 1
        odd = live[right[live] % 2 == 1]
        right[odd] -= 1
        nodes.append(right[odd])
        holders.append(odd)
        left[live] //= 2
        right[live] //= 2
        live = live[left[live] < right[live]]
    node, rev = np.concatenate(nodes or [out[:0]]), np.concatenate(holders or [out[:0]])
    if not len(node):
        return out
    moments = np.unique(available)
    m = len(moments) + 1
    when = np.searchsorted(moments, available)[rev] + 1
    order = np.lexsort((when, node))
    node, rev = node[order], rev[order]
    key = node * m + when[order]
    best = np.maximum.accumulate(node * n + place[rev]) - node * n
    asked = np.searchsorted(moments, known, "right")
    at_node = np.searchsorted(bounds, t, "right") - 1 + size
    at_node[t < bounds[0]] = 0
    top = np.full(len(t), -1, np.int64)
    while (at_node > 0).any():
        at = np.searchsorted(key, at_node * m + asked, "right") - 1
        hit = (at >= 0) & (node[np.maximum(at, 0)] == at_node) & (at_node > 0)
        top[hit] = np.maximum(top[hit], best[at[hit]])
        at_node //= 2
    found = top >= 0
    out[found] = by_rank[top[found]]
    return out


def _match(key, events: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
    """One entity's events and revisions."""
    if not len(events) or not len(changes):
        return pd.DataFrame({"event_id": pd.Series(dtype=str), "change_id": pd.Series(dtype=str)})
    changes = changes.sort_values(["version", "change_id"], ascending=[True, False], kind="stable", ignore_index=True)
    hit = latest_valid(
        events["t"].to_numpy(np.int64),
        events["known"].to_numpy(np.int64),
        changes["start"].to_numpy(np.int64),
        changes["end"].to_numpy(np.int64),
        changes["available"].to_numpy(np.int64),
        np.arange(len(changes)),
    )
    ok = hit >= 0
    return pd.DataFrame({"event_id": events["event_id"].to_numpy()[ok], "change_id": changes["change_id"].to_numpy()[hit[ok]]})


def attributes_at_event(events: DataFrame, changes: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The change that was in force at each event's time and known at the event's own availability.

    ``events``: event_id, entity, t, known. ``changes``: change_id, entity, start,
    end (null = open), available, version. Among the changes that qualify the
    highest version wins, then the smallest change_id. Events and changes are
    co-grouped by entity; an entity's events are salted by a hash into groups of
    about ``group_rows``, with its changes copied to each, so no group grows with
    the hottest entity; only entities with more events are salted. The changes of
    one entity must fit into a task (80 bytes each: ten million in 1 GB).

    Entities are compared in lower case. Events or changes that lack an id,
    entity, time or availability drop out, as do changes without a version.
    Repeated event ids give one row, from the least (t, known, entity). Events
    without a matching change give no row. Returns: event_id, change_id.
    """
    ev = (
        events.select("event_id", F.lower("entity").alias("entity"), F.col("t").cast("long"), F.col("known").cast("long"))
        .dropna()
        .groupBy("event_id")
        .agg(F.min(F.struct("t", "known", "entity")).alias("e"))
        .select("event_id", "e.*")
    )
    counts = events.select(F.lower("entity").alias("entity")).dropna().groupBy("entity").count()
    total, most = counts.agg(F.sum("count"), F.max("count")).first()
    #: At most ``HOT`` entities can be hot, which bounds what is broadcast.
    limit = max(group_rows, -(-(total or 0) // HOT))
    hot = None
    if (most or 0) > limit:
        hot = F.broadcast(counts.where(F.col("count") > limit).select("entity", F.ceil(F.col("count") / limit).cast("int").alias("salts")))
    ch = (
        changes.select(
            "change_id",
            F.lower("entity").alias("entity"),
            F.col("start").cast("long"),
            F.coalesce(F.col("end").cast("long"), F.lit(int(_OPEN))).alias("end"),
            F.col("available").cast("long"),
            F.col("version").cast("long"),
        )
        .dropna()
        .distinct()
    )
    if hot is None:
        left, ch = ev.withColumn("salt", F.lit(0)), ch.withColumn("salt", F.lit(0))
    else:
        salts = F.coalesce("salts", F.lit(1))
        left = ev.join(hot, "entity", "left").withColumn("salt", F.pmod(F.xxhash64("event_id"), salts).cast("int")).drop("salts")
        ch = ch.join(hot, "entity", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return (
        left.groupBy("entity", "salt")
        .cogroup(ch.groupBy("entity", "salt"))
        .applyInPandas(_match, "event_id string, change_id string")
    )
