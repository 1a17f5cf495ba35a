"""The queries p1 to p5 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.grid import regular_grid
from tideline.operators.intervals import coverage_spans
from tideline.operators.outliers import found_bars, score_bars
from tideline.operators.versions import attributes_at_event
from tideline.session import table
from tideline.streaming.late import first_arrivals, late_events, late_rows, period_totals


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "event_coverage").withColumn("kind", F.upper(F.regexp_replace("kind", r"^\s+|\s+$", "")))
    return coverage_spans(rows, ["source_id", "kind"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return found_bars(table(spark, d, "raw_bars"))


def p2_scores(spark: SparkSession, d: str) -> DataFrame:
    return score_bars(table(spark, d, "raw_bars")).withColumn("score", F.round("score", 6))


def p3_grid(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid(table(spark, d, "minute_readings"), table(spark, d, "session_summaries"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_grid(spark, d).where("state <> 'observed'").select("symbol", "minute_start_ns").distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "records").select(
        F.col("record_id").alias("event_id"),
        F.col("payload.instrument_id").alias("entity"),
        F.col("event_time_ns").alias("t"),
        F.coalesce("available_at_ns", F.greatest("processing_time_ns", "revision_time_ns")).alias("known"),
    )
    features = table(spark, d, "temporal_feature_events").select(
        F.col("record_id").alias("event_id"), F.col("instrument_id").alias("entity"), F.col("event_time_ns").alias("t"), F.col("available_at_ns").alias("known")
    )
    changes = table(spark, d, "sector_revisions").select(
        F.col("revision_id").alias("change_id"),
        F.col("instrument_id").alias("entity"),
        F.col("effective_from_ns").alias("start"),
        F.col("effective_to_ns").alias("end"),
        F.col("available_at_ns").alias("available"),
        "version",
    )
    return attributes_at_event(records.unionByName(features), changes).select(F.col("event_id").alias("record_id"), F.col("change_id").alias("sector_revision_id"))


def _late(spark: SparkSession, d: str) -> DataFrame:
    records = first_arrivals(table(spark, d, "records"), F.col("record_id"), "event_time_ns", "revision_time_ns", F.col("payload.value_microunits"))
    documents = first_arrivals(
        table(spark, d, "source_documents"), F.concat("provider_id", F.lit("/"), "document_id"), "provider_event_time_utc_ns", "received_wall_clock_utc_ns", F.lit(None)
    )
    return late_events(records.select(F.lit("records").alias("stream"), "*").unionByName(documents.select(F.lit("source_documents").alias("stream"), "*")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return late_rows(_late(spark, d))


def p5_hourly(spark: SparkSession, d: str) -> DataFrame:
    return period_totals(_late(spark, d)).withColumn("total", F.col("total").cast("long"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_scores, p3_found, p3_grid, p4_found, p5_found, p5_hourly)}

_P5 = """with a as (
  select 'records' as stream, record_id as row_key, event_time_ns as e, revision_time_ns as r, payload.value_microunits as x from records
  union all select 'source_documents', provider_id || '/' || document_id, provider_event_time_utc_ns, received_wall_clock_utc_ns, null from source_documents),
k as (select stream, row_key, min(r) as r, arg_min(e, r) as e, arg_min(coalesce(x, 0), r) as x, arg_min(x is null, r) as no
  from a where row_key is not null and e is not null and r is not null group by all),
h as (select *, e - e % 3600000000000 as p from k),
v as (select *, case when r < p + 3600000000000 then 'on_time' when r < p + 7 * 3600000000000 then 'corrects' else 'dropped' end as verdict from h)
"""

_P2 = """with r as (
  select bar_id, symbol || '|' || market_id || '|' || session_id as k, epoch_ns(cast(t as timestamptz)) as t, o, h, l, c, cast(v as double) as v from raw_bars),
b as (select k, t, arg_min(c, bar_id) filter (c is not null) as c, arg_min(v, bar_id) filter (v is not null) as v from r group by k, t),
cs as (select k, t, c, abs(c - lag(c) over w) as dc,
    median(c) over (partition by k order by t rows between 5 preceding and 1 preceding) as pre, median(c) over (partition by k order by t rows between 1 following and 5 following) as post,
    median(c) over (partition by k order by t rows between 4 preceding and current row) as pre_next, median(c) over (partition by k order by t rows between current row and 4 following) as post_prev
  from b where c is not null window w as (partition by k order by t)),
m as (select k, median(dc) as mdc from cs group by k),
mv as (select k, median(v) as mv from b where v > 0 group by k),
side as (
  select b.k, b.t, coalesce(x.pre, y.pre_next) as pre, coalesce(x.post, z.post_prev) as post
  from b left join cs x on b.k = x.k and b.t = x.t
  asof left join cs y on b.k = y.k and b.t > y.t and b.c is null asof left join cs z on b.k = z.k and b.t < z.t and b.c is null),
rc as (select k, t, v, sum(case when c = pc and v > 0 and pv > 0 then 0 else 1 end) over (partition by k order by t) as g from (
  select k, t, c, v, lag(c) over (partition by k order by t) as pc, lag(v) over (partition by k order by t) as pv from b where c is not null and v is not null)),
rv as (select k, t, v, sum(case when v = pv and v > 0 then 0 else 1 end) over (partition by k order by t) as g from (
  select k, t, v, lag(v) over (partition by k order by t) as pv from b where v is not null)),
stuck_c as (select k, t from (select k, t, v, count(*) over (partition by k, g) as n from rc) where n >= 10 and v > 0),
stuck_v as (select k, t from (select k, t, v, count(*) over (partition by k, g) as n from rv) where n >= 10 and v > 0)
select bar_id from r left join side using (k, t) left join m using (k) left join mv using (k)
where h <= 0 or l <= 0 or c <= 0 or v < 0 or h < o or h < l or h < c or l > o or l > c or v > 200 * mv
  or least(coalesce(abs(h - pre), abs(h - post)), coalesce(abs(h - post), abs(h - pre))) > 25 * mdc
  or least(coalesce(abs(l - pre), abs(l - post)), coalesce(abs(l - post), abs(l - pre))) > 25 * mdc
  or least(coalesce(abs(c - pre), abs(c - post)), coalesce(abs(c - post), abs(c - pre))) > 25 * mdc
  or (c is not null and exists (select 1 from stuck_c s where s.k = r.k and s.t = r.t)) or (v is not null and exists (select 1 from stuck_v s where s.k = r.k and s.t = r.t))"""

SQL = {
    "p1_found": """with v as (
  select distinct source_id, upper(trim(kind)) as kind, start_time_ns as s, end_time_ns as e from event_coverage
  where source_id is not null and kind is not null and end_time_ns > start_time_ns),
m as (select *, max(e) over (partition by source_id, kind order by s, e rows between unbounded preceding and 1 preceding) as reach from v),
g as (select *, sum(case when reach is null or s > reach then 1 else 0 end) over (partition by source_id, kind order by s, e) as island from m),
p as (select source_id, kind, island, min(s) as s, max(e) as e from g group by all)
select source_id, kind, 'covered' as span_type, s as start_time_ns, e as end_time_ns from p
union all
select source_id, kind, 'gap', e, n from (select *, lead(s) over (partition by source_id, kind order by s) as n from p) where n is not null""",
    "p2_found": _P2,
    "p3_found": """with s as (select distinct upper(trim(source_ticker)) as symbol, session_id, session_open_exchange_time_ns as a, session_close_exchange_time_ns as b from session_summaries),
g as (select symbol, a, unnest(range(a, b, 60000000000)) as m from s),
r as (select distinct upper(trim(symbol)) as symbol, t - t % 60000000000 as m from (
  select symbol, open_ticks, case when event_time_ns < 100000000000 then event_time_ns * 1000000000 when event_time_ns < 100000000000000 then event_time_ns * 1000000
    when event_time_ns < 100000000000000000 then event_time_ns * 1000 else event_time_ns end as t from minute_readings) where open_ticks > 0)
select distinct symbol, m as minute_start_ns from g anti join r using (symbol, m)""",
    "p3_grid": """with s as (select distinct upper(trim(source_ticker)) as symbol, session_id, session_open_exchange_time_ns as a, session_close_exchange_time_ns as b from session_summaries),
g as (select symbol, session_id, a, unnest(range(a, b, 60000000000)) as m from s),
r as (select upper(trim(symbol)) as symbol, open_ticks, reading_id, case when event_time_ns < 100000000000 then event_time_ns * 1000000000 when event_time_ns < 100000000000000 then event_time_ns * 1000000
    when event_time_ns < 100000000000000000 then event_time_ns * 1000 else event_time_ns end as t from minute_readings where open_ticks > 0),
o as (select g.symbol, session_id, a, m, count(t) as n, arg_max(open_ticks, (t, reading_id)) as open_ticks from g left join r on r.symbol = g.symbol and t - (t - a % 60000000000) % 60000000000 = m group by all),
f as (select *, last_value(case when n > 0 then {'m': m, 'v': open_ticks} end ignore nulls) over (partition by symbol, session_id, a order by m rows between unbounded preceding and current row) as l from o)
select symbol, session_id, m as minute_start_ns, n, open_ticks, case when m - l.m <= 300000000000 then l.v end as filled_ticks, case when n > 0 then 'observed' when m - l.m <= 300000000000 then 'filled' else 'missing' end as state from f""",
    "p4_found": """with e as (
  select record_id, lower(payload.instrument_id) as i, event_time_ns as t, coalesce(available_at_ns, greatest(processing_time_ns, revision_time_ns)) as k from records
  union select record_id, lower(instrument_id), event_time_ns, available_at_ns from temporal_feature_events)
select record_id, arg_max(revision_id, version) as sector_revision_id
from e join sector_revisions s on lower(s.instrument_id) = i and s.available_at_ns <= k and s.effective_from_ns <= t and (s.effective_to_ns is null or t < s.effective_to_ns)
group by record_id""",
    "p5_found": _P5 + "select stream, row_key, p as period_start_ns, verdict from v where verdict <> 'on_time'",
    "p5_hourly": _P5
    + """select stream, p as period_start_ns, count(*) as n, count(*) filter (verdict = 'corrects') as n_corrects, cast(coalesce(sum(case when not no then x end), 0) as bigint) as total,
  min(case when not no then x end) as low, max(case when not no then x end) as high from v where verdict <> 'dropped' group by all""",
}
