"""More sources and sinks: authenticated files, release pages, generated exchange events, late events as a stream, related mentions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import text as X
from tideline.functions.hashing import counter_sample
from tideline.operators import temporal as T
from tideline.plans.pit import AT, _sectors
from tideline.plans.problems import _P5
from tideline.plans.scans import _place
from tideline.plans.texts import TICKER, _docs
from tideline.session import table
from tideline.sources import feeds, sinks
from tideline.streaming import feeds as live
from tideline.streaming.late import late_events_stream, late_rows


def authenticated_parquet(spark: SparkSession, d: str) -> DataFrame:
    """Parquet files against a manifest of their hashes and rows, one file altered; then the rows of the authentic ones by discovery of one column.

    Hashes are worked out in tasks, one file at a time; the manifest is a table.
    """
    p = _place(spark, "authentic")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    o.repartitionByRange(4, "o_orderkey").write.parquet(p)
    manifest = feeds.file_digests(spark, p)
    place = F.row_number().over(feeds.by_name())
    manifest = manifest.withColumn("i", place).withColumn("sha256", F.when(F.col("i") == 2, F.lit("0" * 64)).otherwise(F.col("sha256"))).drop("i")
    rows = feeds.authenticated(spark, p, manifest, o.schema)
    return rows.groupBy("state").agg(F.countDistinct("file").alias("files"), (F.countDistinct("o_orderpriority") > 1).alias("many"))


def release_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a release calendar, written and read: releases per month."""
    p = _place(spark, "releases")
    o = table(spark, d, "orders").select(F.expr("o_orderkey div 1000").alias("page"), F.struct((F.col("o_custkey") % 7).alias("release_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")).alias("x"))
    o.groupBy("page").agg(F.collect_list("x").alias("release_dates")).select("release_dates").write.json(p)
    pages = spark.read.schema("release_dates array<struct<release_id bigint, date string>>").option("mode", "FAILFAST").json(p)
    return pages.select(F.inline("release_dates")).groupBy("release_id", F.substring("date", 1, 7).alias("month")).agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"))


#: Scenarios of the generated exchange, by event number.
SCENARIOS = ["ADD", "ADD", "ADD", "CANCEL", "EXECUTE", "REPLACE", "TRADE", "STATUS", "GAP", "DUPLICATE", "REORDER", "CROSS", "BURST"]


def exchange_events(spark: SparkSession, d: str) -> DataFrame:
    """A deterministic exchange: one generated event per row of the events table's count, from a linear congruence over its number, in parallel; summed per venue and scenario.

    A GAP skips a number of its venue's sequence, a DUPLICATE repeats one, a REORDER swaps two.
    """
    n = table(spark, d, "events").count()
    e = spark.range(n).withColumn("x", F.pmod(F.col("id") * 1_103_515_245 + 12_345, F.lit(2**31)))
    e = e.withColumn("venue", F.expr("x div 7 % 4")).withColumn("scenario", F.element_at(F.array(*map(F.lit, SCENARIOS)), (F.expr("x div 65536") % 13 + 1).cast("int")))
    number = F.expr("id div 4") + F.when(F.col("scenario") == "GAP", 1).when(F.col("scenario") == "DUPLICATE", -1).when(F.col("scenario") == "REORDER", F.when(F.col("id") % 2 == 0, 1).otherwise(-1)).otherwise(0)
    e = e.withColumn("sequence", number).withColumn("price", 10_000 + F.expr("x div 1024 % 201") - 100 + F.when(F.col("scenario") == "CROSS", 500).otherwise(0)).withColumn("quantity", 1 + F.expr("x div 16 % 100") * F.when(F.col("scenario") == "BURST", 10).otherwise(1))
    return e.groupBy("venue", "scenario").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("price_sum"), F.sum("quantity").alias("quantity"), F.sum("sequence").alias("sequence_sum"))


def stream_late_events(spark: SparkSession, d: str) -> DataFrame:
    """Late rows of the records as a stream that is deduplicated by key and folded into trees per key."""
    r = live.file_stream(spark, f"{d}/records.parquet", table(spark, d, "records").schema)
    rows = r.select(F.lit("records").alias("stream"), F.col("record_id").alias("row_key"), F.col("event_time_ns").alias("event"), F.col("revision_time_ns").alias("arrival"), F.col("payload.value_microunits").alias("value"))
    once = rows.where("row_key is not null and event is not null and arrival is not null").dropDuplicates(["row_key"])
    return late_rows(live.run_to_table(late_events_stream(once), "late"))


def related_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Symbols that documents name, with how many other instruments stand in the same sector: one hop from the mention."""
    ids = table(spark, d, "minute_readings").where("instrument_id is not null").groupBy(F.upper(F.trim("symbol")).alias("symbol")).agg(F.min("instrument_id").alias("instrument_id"))
    sec = T.effective_then_latest(_sectors(spark, d), AT, AT, ["instrument_id"], ["sector_id"], start="effective_from_ns", end="effective_to_ns", available="available_at_ns", version="version").select("instrument_id", "sector_id")
    size = sec.groupBy("sector_id").agg((F.count(F.lit(1)) - 1).alias("related"))
    known = ids.join(sec, "instrument_id").join(size, "sector_id").select("symbol", "sector_id", "related")
    tokens = _docs(spark, d).select("doc_id", F.explode(F.array_distinct(X.facts("text", TICKER))).alias("symbol"))
    return tokens.join(known, "symbol").select("doc_id", "symbol", "sector_id", "related")


def scan_captures(spark: SparkSession, d: str) -> DataFrame:
    """A capture file per day of the events, written in tasks; of five files one is cut and one spoiled. Packets and state per file."""
    p = _place(spark, "captures")

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        from pyarrow.fs import FileSystem

        k = int(pdf["k"].iloc[0])
        pdf = pdf.sort_values(["t", "event_id"])
        data = bytearray(feeds.capture_bytes([(t * 1000, f"{i:08d}|{e}".encode()) for t, i, e in zip(pdf["t"], pdf["event_id"], pdf["event_type"])]))
        if k % 5 == 2:
            data = data[:-40]
        if k % 5 == 3:
            data[-40] ^= 1
        fs, path = FileSystem.from_uri(p)
        fs.create_dir(path)
        with fs.open_output_stream(f"{path}/day-{k}") as out:
            out.write(bytes(data))
        return pd.DataFrame({"k": [k]})

    e = table(spark, d, "events").select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).withColumn("k", F.expr("t div 86400000000"))
    e.groupBy("k").applyInPandas(write, "k long").count()
    return feeds.scan(spark, "capture", p).groupBy("file", "state").agg(F.count("body").alias("packets"), F.min("time_ns").alias("first_ns"))


def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    """A share of five in a hundred events, drawn by a generator that is a function of seed and number only: the same rows on any cluster."""
    return table(spark, d, "events").select("event_id", counter_sample(F.lit(7), F.col("event_id"), F.lit(100)).alias("drawn")).where("drawn < 5")


def scan_replay(spark: SparkSession, d: str) -> DataFrame:
    """Binary objects with sidecars, one per symbol and session of the bars, written in tasks, some altered; authenticated and replayed in order."""
    p = _place(spark, "replay")

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        import hashlib
        import json

        from pyarrow.fs import FileSystem

        symbol, session = pdf["symbol"].iloc[0], pdf["session_id"].iloc[0]
        data = b"".join(f"{i};".encode() for i in sorted(pdf["bar_id"]))
        meta = {"symbol": symbol, "day": session[-10:], "sha256": hashlib.sha256(data if len(data) % 7 else b"").hexdigest()}
        fs, path = FileSystem.from_uri(p)
        fs.create_dir(path)
        for name, content in ((f"{symbol}-{session}.bin", data), (f"{symbol}-{session}.meta.json", json.dumps(meta).encode())):
            with fs.open_output_stream(f"{path}/{name}") as out:
                out.write(content)
        return pd.DataFrame({"n": [1]})

    b = table(spark, d, "raw_bars").select("symbol", "session_id", "bar_id").where("symbol is not null and session_id is not null")
    b.groupBy("symbol", "session_id").applyInPandas(write, "n long").count()
    return feeds.scan(spark, "replay", p).select("symbol", "day", F.element_at(F.split("name", "/"), -1).alias("name"), F.octet_length("content").alias("bytes"), "authentic")


def stream_stale(spark: SparkSession, d: str) -> DataFrame:
    """Users from whom nothing came for a day of event time when the stream's watermark had passed: an event-time timer per user."""
    e = live.file_stream(spark, f"{d}/events.parquet", table(spark, d, "events").schema).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return live.run_to_table(live.stale_keys(e, "user_id", 86_400_000), "stale")


def report_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Orders as JSON documents with their own hash, written, read and checked again."""
    p = _place(spark, "reports")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    sinks.report_json(o, "o_orderkey", "o_orderstatus").write.json(p)
    r = spark.read.schema("document string, sha256 string").json(p)
    return r.select(F.get_json_object("document", "$.o_orderkey").cast("long").alias("o_orderkey"), "sha256", (F.sha2("document", 256) == F.col("sha256")).alias("authentic"))


QUERIES = {f.__name__: f for f in (authenticated_parquet, release_pages, exchange_events, stream_late_events, related_mentions, report_hashes, scan_captures, seeded_sample, scan_replay, stream_stale)}

_X = f"""with e as (select id, (id * 1103515245 + 12345) % 2147483648 as x from range((select count(*) from events)) t(id)), s as (select *, x // 7 % 4 as venue, ({SCENARIOS})[x // 65536 % 13 + 1] as scenario from e),
f as (select venue, scenario, id // 4 + case scenario when 'GAP' then 1 when 'DUPLICATE' then -1 when 'REORDER' then case when id % 2 = 0 then 1 else -1 end else 0 end as sequence, 9900 + x // 1024 % 201 + case when scenario = 'CROSS' then 500 else 0 end as price,
  1 + x // 16 % 100 * case when scenario = 'BURST' then 10 else 1 end as quantity from s)
"""


def _U(hexadecimal: str) -> str:
    return f"cast({int(hexadecimal, 16)} as uhugeint)"


_W = f"cast({2**64} as uhugeint)"
SQL = {
    "release_pages": "select o_custkey % 7 as release_id, strftime(o_orderdate, '%Y-%m') as month, count(*) as n, strftime(min(o_orderdate), '%Y-%m-%d') as first_date from orders group by 1, 2",
    "exchange_events": _X + "select venue, scenario, count(*) as n, cast(sum(price) as bigint) as price_sum, cast(sum(quantity) as bigint) as quantity, cast(sum(sequence) as bigint) as sequence_sum from f group by 1, 2",
    "stream_late_events": _P5 + "select stream, row_key, p as period_start_ns, verdict from v where verdict <> 'on_time' and stream = 'records'",
    "authenticated_parquet": "select unnest(['AUTHENTIC', 'ALTERED']) as state, unnest([3, 1])::bigint as files, count(distinct o_orderpriority) > 1 as many from orders",
    "related_mentions": f"""with i as (select upper(trim(symbol)) as symbol, min(instrument_id) as instrument_id from minute_readings where instrument_id is not null group by 1),
s as (select instrument_id, arg_max(sector_id, version) as sector_id from sector_revisions where available_at_ns <= {AT} and effective_from_ns <= {AT} and (effective_to_ns is null or {AT} < effective_to_ns) group by 1),
z as (select sector_id, count(*) - 1 as related from s group by 1), k as (select symbol, sector_id, related from i join s using (instrument_id) join z using (sector_id)),
t as (select distinct doc_id, unnest(regexp_extract_all(text, '{TICKER}', 1)) as symbol from documents)
select doc_id, symbol, sector_id, related from t join k using (symbol)""",
    "scan_captures": """with k as (select epoch_us(ts) // 86400000000 as k, count(*) as n, min(epoch_us(ts)) * 1000 as first_ns from events group by 1)
select 'day-' || k as file, case k % 5 when 2 then 'TRUNCATED' when 3 then 'BAD_HASH' else 'OK' end as state, n - case when k % 5 = 2 then 1 else 0 end as packets, first_ns from k""",
    "seeded_sample": f"""with a as (select event_id, (cast(7 as uhugeint) + cast(event_id + 1 as uhugeint) * {_U('9e3779b97f4a7c15')}) % {_W} as x from events), b as (select event_id, (xor(x, x >> 30) * {_U('bf58476d1ce4e5b9')}) % {_W} as x from a),
c as (select event_id, (xor(x, x >> 27) * {_U('94d049bb133111eb')}) % {_W} as x from b) select event_id, cast(xor(x, x >> 31) % cast(100 as uhugeint) as bigint) as drawn from c where xor(x, x >> 31) % cast(100 as uhugeint) < 5""",
    "scan_replay": """with g as (select symbol, session_id, cast(sum(len(cast(bar_id as varchar)) + 1) as integer) as bytes from raw_bars where symbol is not null and session_id is not null group by 1, 2)
select symbol, right(session_id, 10) as day, symbol || '-' || session_id as name, bytes, bytes % 7 <> 0 as authentic from g""",
    "stream_stale": "select user_id, epoch_us(max(ts)) // 1000 as last_ms from events group by 1 having max(ts) + interval 1 day <= (select max(ts) - interval 1 hour from events)",
    "report_hashes": """select o_orderkey, sha256('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":' || case when o_orderstatus is null then 'null' else '"' || o_orderstatus || '"' end || '}') as sha256, true as authentic from orders""",
}
