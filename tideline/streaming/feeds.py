"""Feeds in Structured Streaming: dedup, windows, reorder buffers, stale keys."""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tideline.session import shared_dir


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int = 16) -> DataFrame:
    """A folder of files, or one file, as a stream, so many files to a micro-batch."""
    reader = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch)
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hpath.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hpath).isFile():
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).load(folder)
    return reader.load(path)


def place(spark: SparkSession, name: str) -> str:
    """A new folder for a stream's data and checkpoint."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def run_to_table(stream: DataFrame, name: str, mode: str = "append", base: str | None = None) -> DataFrame:
    """Run a stream over what is there now into parquet in the shared folder, and read the result.

    The checkpoint lies beside the data, so a run cut short goes on where it was.
    """
    spark = stream.sparkSession
    base = base or place(spark, name)
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start(f"{base}/data")
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/data")


def windowed_counts(events: DataFrame, width: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Count and sum per window and type; a window is emitted once, when the watermark passes its end."""
    e = events.withWatermark("ts", lateness)
    g = e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("ticks"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "ticks")


def deduplicated(events: DataFrame, keys: list[str], lateness: str | None = "1 hour") -> DataFrame:
    """The first row of each key; keys are forgotten once the watermark has passed them, and rows behind it dropped.

    Where rows may come in any order of time, as from the files of a folder, give
    no ``lateness``: no row is late then, and the state keeps every key.
    """
    if lateness is None:
        return events.dropDuplicates(keys)
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)


REORDERED = "channel long, sequence long, payload string, state string"


def reordered(rows: DataFrame, hold: int = 32, arrival: Sequence[str] = ()) -> DataFrame:
    """Rows of (channel, sequence, payload) in sequence per channel.

    A micro-batch's rows of a channel are taken in order of the columns
    ``arrival``, then by sequence; a shuffle keeps no order of its own. A channel
    starts at the smallest number of its first micro-batch. Out-of-order rows wait,
    at most ``hold`` of them; beyond that the missing range is told as one GAP row
    and the sequence goes on. A row below the sequence that was never given comes
    out as LATE; duplicates are dropped. Rows that wait when the stream stops stay
    in the state, from which ``waiting`` reads them. State is the next number, the waiting rows and the open gaps; a
    channel's rows of one micro-batch must fit a task.
    """
    order = [*arrival, "sequence"]

    def run(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        expected, waiting, gaps = json.loads(state.get[0]) if state.exists else (None, {}, [])
        waiting = {int(k): v for k, v in waiting.items()}
        out: list[tuple] = []
        pdf = pd.concat(list(batches)).sort_values(order, kind="stable")
        if expected is None:
            expected = int(pdf["sequence"].min())
            gaps = [[-(2**63), expected - 1]]
        for seq, payload in zip(pdf["sequence"], pdf["payload"]):
            seq = int(seq)
            if seq < expected:
                k = bisect_right(gaps, seq, key=lambda g: g[0]) - 1
                if k >= 0 and seq <= gaps[k][1]:
                    out.append((key[0], seq, payload, "LATE"))
                    gaps[k : k + 1] = [g for g in ([gaps[k][0], seq - 1], [seq + 1, gaps[k][1]]) if g[0] <= g[1]]
                continue
            if seq in waiting:
                continue
            waiting[seq] = payload
            while expected in waiting or len(waiting) > hold:
                if expected in waiting:
                    out.append((key[0], expected, waiting.pop(expected), "OK"))
                    expected += 1
                else:
                    nxt = min(waiting)
                    out.append((key[0], expected, str(nxt - expected), "GAP"))
                    gaps.append([expected, nxt - 1])
                    expected = nxt
        state.update((json.dumps([expected, waiting, gaps]),))
        yield pd.DataFrame(out, columns=["channel", "sequence", "payload", "state"])

    return rows.groupBy("channel").applyInPandasWithState(run, REORDERED, "s string", "append", GroupStateTimeout.NoTimeout)


def waiting(spark: SparkSession, base: str) -> DataFrame:
    """The rows that still wait in the state of an ended ``reordered`` stream, as WAITING; the state is left as it is, so the stream can go on."""
    s = spark.read.format("statestore").load(f"{base}/checkpoint").select("key.channel", F.get_json_object("value.groupState.s", "$[1]").alias("held"))
    rows = s.select("channel", F.explode(F.from_json("held", "map<string,string>")).alias("sequence", "payload"))
    return rows.select("channel", F.col("sequence").cast("long").alias("sequence"), "payload", F.lit("WAITING").alias("state"))


def stale_keys(events: DataFrame, key: str, limit_ms: int, lateness: str = "1 hour") -> DataFrame:
    """Keys from which nothing has come for ``limit_ms`` of event time: an event-time timer per key."""

    def run(k: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({key: [k[0]], "last_ms": [last]})
            return
        newest = max(int(pdf["ts"].max().value // 1_000_000) for pdf in batches)
        newest = max(newest, state.get[0]) if state.exists else newest
        state.update((newest,))
        state.setTimeoutTimestamp(max(newest + limit_ms, state.getCurrentWatermarkMs() + 1))

    e = events.withWatermark("ts", lateness)
    return e.groupBy(key).applyInPandasWithState(run, f"{key} long, last_ms long", "last_ms long", "append", GroupStateTimeout.EventTimeTimeout)
