"""Queries on bars: canonical minutes, features, labels, splits, partitions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions.hashing import economic_hash
from tideline.functions.ints import fits_long, half_away_div, square_sums, squares_total, wide, wide_return_ppm, zscore_ppm
from tideline.operators import bars as B
from tideline.operators.calendar import MINUTE_HORIZONS
from tideline.session import durable, table

S = B.SERIES
#: The horizons in minutes; those in sessions are in ``reference.horizon_targets``.
HORIZONS = list(MINUTE_HORIZONS.values())


def _minutes(spark: SparkSession, d: str) -> DataFrame:
    return B.canonical_minutes(table(spark, d, "raw_bars"))


def canonical_bars(spark: SparkSession, d: str) -> DataFrame:
    return B.canonicalise(table(spark, d, "raw_bars")).drop("source_object_id", "local_receipt_time_ns")


def bar_dedup_conflict(spark: SparkSession, d: str) -> DataFrame:
    b = B.canonicalise(table(spark, d, "raw_bars")).withColumn("h", economic_hash("o_ticks", "h_ticks", "l_ticks", "c_ticks", "volume"))
    g = b.groupBy(*S, "minute_ns").agg(F.count(F.lit(1)).alias("copies"), F.countDistinct("h").alias("contents"), F.min("bar_id").alias("kept_bar_id"))
    return g.withColumn("verdict", F.when(F.col("contents") > 1, "CONFLICT").when(F.col("copies") > 1, "DUPLICATE").otherwise("UNIQUE"))


def canonical_minute_rows(spark: SparkSession, d: str) -> DataFrame:
    return _minutes(spark, d).select(*S, "minute_ns", "bar_id", "o_ticks", "h_ticks", "l_ticks", "c_ticks", "volume")


def partition_quality(spark: SparkSession, d: str) -> DataFrame:
    b = B.canonicalise(table(spark, d, "raw_bars"))
    return b.groupBy(F.substring("session_id", -10, 10).alias("trading_date"), "bucket").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("state") == "REJECTED").alias("n_rejected"),
        F.countDistinct("symbol", "market_id").alias("n_instruments"),
        F.countDistinct("symbol", "market_id", "minute_ns").alias("observed_minutes"),
        F.coalesce(F.sum("volume"), F.lit(0)).alias("total_volume"),
    )


def reason_histogram(spark: SparkSession, d: str) -> DataFrame:
    b = B.canonicalise(table(spark, d, "raw_bars")).where("reasons <> ''")
    return b.select(F.explode(F.split("reasons", ",")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def distinct_partitions(spark: SparkSession, d: str) -> DataFrame:
    b = B.canonicalise(table(spark, d, "raw_bars"))
    return b.select(F.substring("session_id", -10, 10).alias("trading_date"), "bucket").distinct().orderBy("trading_date", "bucket")


def partitioned_sink(spark: SparkSession, d: str) -> DataFrame:
    """Canonical minutes written by date and bucket, sorted within, and read back per partition."""
    from tideline.sources.sinks import read_partitions, write_partitions

    where = write_partitions(_minutes(spark, d).withColumn("trading_date", F.substring("session_id", -10, 10)), ["trading_date", "bucket"], ["symbol", "market_id", "minute_ns"])
    r = read_partitions(spark, where)
    return r.groupBy(F.col("trading_date").cast("string").alias("trading_date"), F.col("bucket").cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("c_ticks").alias("sum_close"))


def session_ohlcv(spark: SparkSession, d: str) -> DataFrame:
    return B.session_bars(_minutes(spark, d)).drop("first_ns", "last_ns")


def return_ppm_offsets(spark: SparkSession, d: str) -> DataFrame:
    return _minutes(spark, d).select("bar_id", *(B.offset_return(k).alias(f"r{k}") for k in (1, 5, 15, 30, 60)))


def contiguous_relative_volume(spark: SparkSession, d: str) -> DataFrame:
    return B.relative_volume(_minutes(spark, d)).select("bar_id", "island", "n", F.col("mean").alias("mean_volume"), "relative_volume_ppm")


def contiguous_volatility(spark: SparkSession, d: str) -> DataFrame:
    return B.realised_volatility(_minutes(spark, d)).select("bar_id", "r", "n", "volatility_ppm")


def bar_range_gap(spark: SparkSession, d: str) -> DataFrame:
    """High-low range, position of the minute in its session and the gap to the previous session's close."""
    s = B.session_bars(_minutes(spark, d))
    w = Window.partitionBy("symbol", "market_id").orderBy("first_ns")
    s = s.withColumn("prev_close", F.lag("close_ticks").over(w))
    return s.select(
        *S,
        half_away_div((F.col("high_ticks") - F.col("low_ticks")) * 1_000_000, "low_ticks").alias("range_ppm"),
        half_away_div((F.col("open_ticks") - F.col("prev_close")) * 1_000_000, "prev_close").alias("gap_ppm"),
        half_away_div(wide("minutes") * 1_000_000, F.lit(390)).alias("observed_ppm"),
    )


def rolling_session_mean(spark: SparkSession, d: str) -> DataFrame:
    return B.previous_sessions_mean(B.session_bars(_minutes(spark, d)), 5).select(*S, "r", "mean_ppm")


def market_relative_return(spark: SparkSession, d: str) -> DataFrame:
    return B.market_relative(_minutes(spark, d), []).select("bar_id", "m", "r", "n", "relative_ppm", "state")


def sector_relative_return(spark: SparkSession, d: str) -> DataFrame:
    """A bucket of instruments stands for the sector."""
    return B.market_relative(_minutes(spark, d), ["bucket"]).select("bar_id", "m", "bucket", "r", "n", "relative_ppm", "state")


def cross_section_sets(spark: SparkSession, d: str) -> DataFrame:
    """Sums per minute and per minute and bucket in one pass of grouping sets."""
    m = _minutes(spark, d).withColumn("r", B.offset_return(1)).where("r is not null")
    g = m.groupingSets([[F.col("m")], [F.col("m"), F.col("bucket")]], "m", "bucket").agg(F.count("r").alias("n"), F.sum("r").alias("s"), F.max("local_receipt_time_ns").alias("latest"), F.grouping("bucket").cast("int").alias("whole_market"))
    return g.select("m", "bucket", "n", "s", "latest", "whole_market")


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    return _minutes(spark, d).select(F.substring("session_id", -10, 10).alias("trading_date")).distinct()


def split_plan_purged(spark: SparkSession, d: str) -> DataFrame:
    return B.split_plan(_sessions(spark, d), "trading_date")


def train_normalization(spark: SparkSession, d: str) -> DataFrame:
    """Count, sum and sum of squares of one-minute returns over the training sessions.

    ``s`` and ``q`` are bigints while they fit one, as in the SQL, and beyond it
    decimal(38,0); their values are exact either way. A ``q`` of more than 38 digits
    is an error.
    """
    n, s, q, fit = _training_statistics(_returns(spark, d))
    kinds = ["long" if fits_long(x) else "decimal(38,0)" for x in (s, q)]
    row = (n, *(None if n == 0 else x if kind == "long" else Decimal(x) for x, kind in zip((s, q), kinds)), fit)
    return spark.createDataFrame([row], f"n long, s {kinds[0]}, q {kinds[1]}, fit_through_ns long")


def _returns(spark: SparkSession, d: str) -> DataFrame:
    """One-minute returns with their dates, worked out once. Prices are below 1e15 ticks, so a return has up to 22 digits."""
    m = _minutes(spark, d).withColumn("prior", B.offset_close(1))
    return durable(m.select("bar_id", "minute_ns", F.substring("session_id", -10, 10).alias("trading_date"), wide_return_ppm("c_ticks", "prior").cast("decimal(22,0)").alias("r")), "returns")


def _training_statistics(m: DataFrame) -> tuple[int, int, int, int | None]:
    """n, s, q, fit_through_ns as Python integers, as squares of returns and their sums outgrow 128 bits."""
    #: One row per trading day.
    plan = B.split_plan(m.select("trading_date").distinct(), "trading_date")
    t = m.join(plan, "trading_date").where("split = 'TRAIN' and r is not null")
    row = t.agg(F.count("r").alias("n"), F.sum("r").alias("s"), F.max("minute_ns").alias("fit"), *square_sums("r")).first()
    return row.n, int(row.s or 0), squares_total(row.hi_hi, row.hi_lo, row.lo_lo), row.fit


def train_zscore(spark: SparkSession, d: str) -> DataFrame:
    """One-minute returns of every session, normalised by the training statistics.

    ``z_ppm`` is a bigint, as in the SQL, while all scores fit one, and beyond it
    decimal(38,0); the scores are exact either way.
    """
    m = _returns(spark, d)
    n, s, q, _ = _training_statistics(m)
    bounds = tuple(int(x or 0) for x in m.agg(F.min("r"), F.max("r")).first())
    return m.where("r is not null").select("bar_id", zscore_ppm("r", n, s, q, bounds).alias("z_ppm"))


def label_horizons(spark: SparkSession, d: str) -> DataFrame:
    return B.horizon_labels(_minutes(spark, d), HORIZONS)


def label_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Every symbol and horizon, also those without a bar, with counts by validity."""
    l = B.horizon_labels(_minutes(spark, d), HORIZONS, ["symbol"])  # noqa: E741
    universe = table(spark, d, "raw_bars").select("symbol").distinct().crossJoin(spark.createDataFrame([(h,) for h in HORIZONS], "horizon int"))
    c = l.groupBy("symbol", "horizon").agg(*(F.count_if(F.col("validity") == v).alias(v.lower()) for v in ("VALID", "MISSING", "INVALID")))
    return universe.join(c, ["symbol", "horizon"], "left").select("symbol", "horizon", *(F.coalesce(v, F.lit(0)).alias(v) for v in ("valid", "missing", "invalid")))


def feature_validity(spark: SparkSession, d: str) -> DataFrame:
    """WARMUP while a feature lacks its past, else VALID; counts per series."""
    m = B.realised_volatility(B.relative_volume(_minutes(spark, d)).drop("n", "mean", "island"))
    x = m.withColumn("r60", B.offset_return(60))
    warm = F.col("r60").isNull() | F.col("relative_volume_ppm").isNull() | F.col("volatility_ppm").isNull()
    return x.withColumn("validity", F.when(warm, "WARMUP").otherwise("VALID")).groupBy(*S, "validity").agg(F.count(F.lit(1)).alias("n"))


def dataset_leakage(spark: SparkSession, d: str) -> DataFrame:
    """Per split: labels that reach beyond their session's end, and overlap with the next split's first feature."""
    m = _minutes(spark, d).withColumn("trading_date", F.substring("session_id", -10, 10))
    p = m.join(F.broadcast(B.split_plan(_sessions(spark, d), "trading_date")), "trading_date").groupBy("split").agg(F.min("m").alias("feature_start"), (F.max("m") + 60).alias("label_end"), F.count(F.lit(1)).alias("n"))
    order = F.when(F.col("split") == "TRAIN", 0).when(F.col("split") == "VALIDATION", 1).when(F.col("split") == "TEST", 2)
    q = p.where("split <> 'PURGE'").withColumn("i", order)
    w = Window.orderBy("i")
    return q.select("split", "n", "feature_start", "label_end", (F.col("label_end") <= F.lead("feature_start").over(w)).alias("clear_of_next"))


QUERIES = {
    f.__name__: f
    for f in (
        canonical_bars,
        bar_dedup_conflict,
        canonical_minute_rows,
        partition_quality,
        reason_histogram,
        distinct_partitions,
        partitioned_sink,
        session_ohlcv,
        return_ppm_offsets,
        contiguous_relative_volume,
        contiguous_volatility,
        bar_range_gap,
        rolling_session_mean,
        market_relative_return,
        sector_relative_return,
        cross_section_sets,
        split_plan_purged,
        train_normalization,
        train_zscore,
        label_horizons,
        label_coverage,
        feature_validity,
        dataset_leakage,
    )
}


def _tick(x: str) -> str:
    return f"case when abs(round({x} * 100)) < 1e15 and round({x} * 100) / 100 = {x} then cast(round({x} * 100) as bigint) end as {x}_ticks"


CANON = f"""with k as (
  select bar_id, symbol, market_id, session_id, epoch_ns(cast(t as timestamptz)) as minute_ns, {', '.join(_tick(x) for x in 'ohlc')}, v as volume, o, h, l, c, local_receipt_time_ns,
    cast(cast('0x' || substr(sha256(symbol || '|' || market_id), 1, 16) as ubigint) % 8 as integer) as bucket from raw_bars),
canon as (select *, array_to_string(list_filter([
    case when minute_ns is null or minute_ns % 60000000000 <> 0 then 'TIME' end,
    case when o is null or h is null or l is null or c is null or volume is null then 'NULL_VALUE' end,
    case when (o is not null and o_ticks is null) or (h is not null and h_ticks is null) or (l is not null and l_ticks is null) or (c is not null and c_ticks is null) then 'INEXACT_PRICE' end,
    case when o_ticks <= 0 or h_ticks <= 0 or l_ticks <= 0 or c_ticks <= 0 then 'BAD_PRICE' end,
    case when h_ticks < o_ticks or h_ticks < c_ticks or h_ticks < l_ticks or l_ticks > o_ticks or l_ticks > c_ticks then 'BAD_RANGE' end,
    case when volume < 0 then 'BAD_VOLUME' end], lambda x: x is not null), ',') as reasons from k)
"""
MIN = (
    CANON
    + """, kept as (select *, row_number() over (partition by symbol, market_id, session_id, minute_ns order by bar_id) as rn from canon where reasons = ''),
m as (select symbol, market_id, session_id, minute_ns, bar_id, o_ticks, h_ticks, l_ticks, c_ticks, volume, local_receipt_time_ns, bucket, minute_ns // 60000000000 as m,
  right(session_id, 10) as trading_date from kept where rn = 1)
"""
)
SER = "partition by symbol, market_id, session_id order by m"


def half_away(n: str, d: str) -> str:
    n, d = f"cast({n} as hugeint)", f"cast({d} as hugeint)"
    return f"cast(case when {d} = 0 then null when ({n} < 0) <> ({d} < 0) then -((abs({n}) * 2 + abs({d})) // (abs({d}) * 2)) else (abs({n}) * 2 + abs({d})) // (abs({d}) * 2) end as bigint)"


def ret(c: str, p: str) -> str:
    return half_away(f"(cast({c} as hugeint) - {p}) * 1000000", p)


_ISL = ", isl as (select *, sum(n) over (" + SER + ") as island from (select *, case when m - lag(m) over (" + SER + ") = 1 then 0 else 1 end as n from m))"
_R1 = f", r1 as (select * from (select *, {ret('c_ticks', f'max(c_ticks) over ({SER} range between 1 preceding and 1 preceding)')} as r from m) where r is not null)"
_SESS = ", s as (select symbol, market_id, session_id, arg_min(o_ticks, m) as open_ticks, max(h_ticks) as high_ticks, min(l_ticks) as low_ticks, arg_max(c_ticks, m) as close_ticks, cast(sum(volume) as bigint) as volume, count(*) as minutes, min(minute_ns) as first_ns from m group by all)"
_PLAN = """, days as (select trading_date, row_number() over (order by trading_date) as i, count(*) over () - 4 as u from (select distinct trading_date from m)),
plan as (select trading_date, case when i <= u * 70 // 100 then 'TRAIN' when i <= u * 70 // 100 + 2 then 'PURGE' when i <= u * 70 // 100 + 2 + u * 15 // 100 then 'VALIDATION'
  when i <= u * 70 // 100 + 4 + u * 15 // 100 then 'PURGE' else 'TEST' end as split from days)"""
_STATS = ", st as (select count(r) as n, sum(r) as s, sum(cast(r as hugeint) * r) as q, max(minute_ns) as fit from r1 join plan using (trading_date) where split = 'TRAIN')"
_VOL = f""", vr as (select *, {ret('c_ticks', 'lag(c_ticks) over (partition by symbol, market_id, session_id, island order by m)')} as r from isl),
vn as (select *, count(r) over w as cnt, sum(cast(r as hugeint) * r) over w as sq from vr window w as (partition by symbol, market_id, session_id, island order by m rows between 29 preceding and current row)),
vol as (select bar_id, symbol, market_id, session_id, r, cnt, case when cnt > 0 then cast(floor(sqrt({half_away('sq', 'cnt')})) as bigint) end as volatility_ppm from vn)"""
_REL = f""", rv as (select *, count(volume) over w as cnt, {half_away('sum(volume) over w', 'count(volume) over w')} as mean_volume from isl
  window w as (partition by symbol, market_id, session_id, island order by m rows between 20 preceding and 1 preceding)),
rel as (select bar_id, island, cnt, mean_volume, case when mean_volume > 0 then {half_away('cast(volume as hugeint) * 1000000', 'mean_volume')} end as relative_volume_ppm from rv)"""
_LABELS = (
    ", wide as (select *, max(m) over (partition by symbol, market_id, session_id) as last_m, "
    + ", ".join(f"max(c_ticks) over ({SER} range between {h} following and {h} following) as p{h}" for h in HORIZONS)
    + " from m), lab as ("
    + " union all ".join(f"select bar_id, symbol, m, last_m, c_ticks, {h} as horizon, p{h} as future_ticks from wide" for h in HORIZONS)
    + f"""), labels as (select bar_id, symbol, horizon, case when m + horizon > last_m then 'INVALID' when future_ticks is null then 'MISSING' else 'VALID' end as validity, future_ticks,
  case when m + horizon <= last_m and future_ticks is not null then {ret('future_ticks', 'c_ticks')} end as return_ppm from lab)"""
)


def _relative(group: str) -> str:
    g = f", {group}" if group else ""
    return (
        MIN
        + _R1
        + f""", a as (select m{g}, sum(r) as s, count(r) as n, max(local_receipt_time_ns) as latest from r1 group by all)
select bar_id, r1.m{', r1.' + group if group else ''}, r, n, case when latest <= local_receipt_time_ns then r - {half_away('s', 'n')} end as relative_ppm,
  case when latest <= local_receipt_time_ns then 'VALID' else 'LATE_CONTRIBUTOR' end as state from r1 join a on r1.m = a.m{f' and r1.{group} = a.{group}' if group else ''}"""
    )


SQL = {
    "canonical_bars": CANON
    + "select bar_id, symbol, market_id, session_id, minute_ns, o_ticks, h_ticks, l_ticks, c_ticks, volume, case when reasons = '' then 'VALID' else 'REJECTED' end as state, reasons, bucket from canon",
    "bar_dedup_conflict": CANON
    + """select symbol, market_id, session_id, minute_ns, count(*) as copies, count(distinct eh) as contents, min(bar_id) as kept_bar_id,
  case when count(distinct eh) > 1 then 'CONFLICT' when count(*) > 1 then 'DUPLICATE' else 'UNIQUE' end as verdict
from (select *, coalesce(o_ticks::varchar, '-') || '|' || coalesce(h_ticks::varchar, '-') || '|' || coalesce(l_ticks::varchar, '-') || '|' || coalesce(c_ticks::varchar, '-') || '|' || coalesce(volume::varchar, '-') as eh from canon) group by all""".replace(
        " group by all", " group by symbol, market_id, session_id, minute_ns"
    ),
    "canonical_minute_rows": MIN + "select symbol, market_id, session_id, minute_ns, bar_id, o_ticks, h_ticks, l_ticks, c_ticks, volume from m",
    "partition_quality": CANON
    + """select right(session_id, 10) as trading_date, bucket, count(*) as n_rows, count(*) filter (reasons <> '') as n_rejected, count(distinct (symbol, market_id)) as n_instruments,
  count(distinct (symbol, market_id, minute_ns)) as observed_minutes, cast(coalesce(sum(volume), 0) as bigint) as total_volume from canon group by 1, 2""",
    "reason_histogram": CANON + "select reason, count(*) as n from (select unnest(string_split(reasons, ',')) as reason from canon where reasons <> '') group by 1",
    "distinct_partitions": CANON + "select distinct right(session_id, 10) as trading_date, bucket from canon order by 1, 2",
    "partitioned_sink": MIN + "select trading_date, bucket, count(*) as n_rows, cast(sum(c_ticks) as bigint) as sum_close from m group by 1, 2",
    "session_ohlcv": MIN + _SESS + " select * exclude (first_ns) from s",
    "return_ppm_offsets": MIN + "select bar_id, " + ", ".join(f"{ret('c_ticks', f'max(c_ticks) over ({SER} range between {k} preceding and {k} preceding)')} as r{k}" for k in (1, 5, 15, 30, 60)) + " from m",
    "contiguous_relative_volume": MIN + _ISL + _REL + " select bar_id, cast(island as bigint) as island, cnt as n, mean_volume, relative_volume_ppm from rel",
    "contiguous_volatility": MIN + _ISL + _VOL + " select bar_id, r, cnt as n, volatility_ppm from vol",
    "bar_range_gap": MIN
    + _SESS
    + f""", p as (select *, lag(close_ticks) over (partition by symbol, market_id order by first_ns) as pc from s)
select symbol, market_id, session_id, {half_away('(high_ticks - low_ticks) * 1000000', 'low_ticks')} as range_ppm, {half_away('(open_ticks - pc) * 1000000', 'pc')} as gap_ppm, {half_away('minutes * 1000000', '390')} as observed_ppm from p""",
    "rolling_session_mean": MIN
    + _SESS
    + f""", p as (select *, {ret('close_ticks', 'open_ticks')} as r from s)
select symbol, market_id, session_id, r, case when count(r) over w = 5 then {half_away('sum(r) over w', '5')} end as mean_ppm from p window w as (partition by symbol, market_id order by first_ns rows between 5 preceding and 1 preceding)""",
    "market_relative_return": _relative(""),
    "sector_relative_return": _relative("bucket"),
    "cross_section_sets": MIN
    + _R1
    + " select m, bucket, count(r) as n, cast(sum(r) as bigint) as s, max(local_receipt_time_ns) as latest, cast(grouping(bucket) as integer) as whole_market from r1 group by grouping sets ((m), (m, bucket))",
    "split_plan_purged": MIN + _PLAN + " select trading_date, split from plan",
    "train_normalization": MIN + _PLAN + _R1 + _STATS + " select n, cast(s as bigint) as s, cast(q as bigint) as q, fit as fit_through_ns from st",
    "train_zscore": MIN
    + _PLAN
    + _R1
    + _STATS
    + f", sp as (select n, s, floor(sqrt(n * q - s * s))::hugeint as d from st) select bar_id, case when d = 0 then 0 else {half_away('(cast(r as hugeint) * n - s) * 1000000', 'd')} end as z_ppm from r1, sp",
    "label_horizons": MIN + _LABELS + " select bar_id, horizon, validity, future_ticks, return_ppm, cast(sign(return_ppm) as integer) as direction from labels",
    "label_coverage": MIN
    + _LABELS
    + f""", u as (select symbol, horizon from (select distinct symbol from raw_bars), (select unnest([{', '.join(map(str, HORIZONS))}]) as horizon))
select symbol, horizon, coalesce(valid, 0) as valid, coalesce(missing, 0) as missing, coalesce(invalid, 0) as invalid from u left join
 (select symbol, horizon, count(*) filter (validity = 'VALID') as valid, count(*) filter (validity = 'MISSING') as missing, count(*) filter (validity = 'INVALID') as invalid from labels group by 1, 2) using (symbol, horizon)""",
    "feature_validity": MIN
    + _ISL
    + _VOL
    + _REL
    + f""", f as (select symbol, market_id, session_id, bar_id, {ret('c_ticks', f'max(c_ticks) over ({SER} range between 60 preceding and 60 preceding)')} as r60 from m)
select f.symbol, f.market_id, f.session_id, case when r60 is null or relative_volume_ppm is null or volatility_ppm is null then 'WARMUP' else 'VALID' end as validity, count(*) as n
from f join vol using (bar_id) join rel using (bar_id) group by 1, 2, 3, 4""",
    "dataset_leakage": MIN
    + _PLAN
    + """, g as (select split, min(m) as feature_start, max(m) + 60 as label_end, count(*) as n from m join plan using (trading_date) where split <> 'PURGE' group by 1)
select split, n, feature_start, label_end, label_end <= lead(feature_start) over (order by case split when 'TRAIN' then 0 when 'VALIDATION' then 1 else 2 end) as clear_of_next from g""",
}
