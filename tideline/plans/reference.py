"""Reference data, manifests and research datasets: leakage codes, splits, calendars, identities, readiness."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions.ints import WIDE, half_even_div, mul_div, ratio_times, wide
from tideline.functions.times import DAY, MINUTE
from tideline.operators import bars as B
from tideline.operators import calendar as C
from tideline.operators import temporal as T
from tideline.operators.ranking import BUCKET_ROWS, bucket_bounds, running_total
from tideline.plans.bars import CANON, HORIZONS, MIN, _LABELS, _minutes
from tideline.plans.pit import AT, R, _records, _sectors
from tideline.session import durable, table

S = B.SERIES

# --- Leakage of manifests ------------------------------------------------------

#: Codes of the kinds of record that became known too late, by kind (fixed values); any other kind is FUTURE_RECORD.
FUTURE_CODES = {1: "FUTURE_CORPORATE_ACTION", 4: "FUTURE_CONSTITUENT", 5: "POST_EVENT_ESTIMATE", 6: "FUTURE_MACRO_REVISION"}
#: Ends of the sample manifest's training and validation spans, in ns.
TRAIN_END, VALIDATION_END = 1_483_228_800_000_000_000, 1_546_300_800_000_000_000
EMBARGO = DAY


def sample_manifest(spark: SparkSession, d: str) -> DataFrame:
    """A manifest with every kind of fault: one sample per record with an event time.

    A sample refers to its record and to another that may be unknown; some windows
    reach into the future, some samples stand in an earlier split than their time.
    """
    r = table(spark, d, "records").select("record_id", "kind", F.col("event_time_ns").alias("t"), F.coalesce("available_at_ns", F.greatest("processing_time_ns", "revision_time_ns")).alias("known")).distinct().where("t is not null")
    x = F.col("t") % 97
    start = F.greatest("t", "known")
    event = F.when(x % 3 == 0, F.col("t")).otherwise(start)
    feature_end = event + F.when(x % 11 == 0, 1000).otherwise(0)
    label_start = feature_end + F.when(x % 13 == 0, 0).otherwise(1)
    split = F.when((event < TRAIN_END) | (x == 5), "TRAIN").when(event < VALIDATION_END, "VALIDATION").otherwise("TEST")
    return r.select(
        F.concat(F.lit("s-"), "record_id").alias("sample_id"),
        event.alias("event_time_ns"),
        (event - DAY).alias("feature_start_ns"),
        feature_end.alias("feature_end_ns"),
        label_start.alias("label_start_ns"),
        (label_start + DAY).alias("label_end_ns"),
        split.alias("split"),
        F.array(F.col("record_id"), F.when(x % 17 == 0, F.concat(F.lit("gone-"), "record_id")).otherwise(F.col("record_id"))).alias("record_ids"),
    )


def manifest_leaks(samples: DataFrame, records: DataFrame, randomized: bool, embargo_ns: int) -> DataFrame:
    """All violations of samples against bitemporal records, without the universe's.

    ``records``: record_id, kind, available, valid_from, valid_to (null = open).
    A record counts as a future one if it became known after the lesser of the
    sample's feature end and event time; memberships (4) and corporate actions (1)
    must also be in force at the event. Between splits two aggregates per split
    decide. Null times violate nothing. Returns: code, sample_id, record_id.
    """
    none = F.lit(None).cast("string")
    own = samples.select(
        F.explode(
            F.filter(
                F.array(
                    F.when(F.col("feature_end_ns") > F.col("event_time_ns"), "FUTURE_FEATURE"),
                    F.when(F.col("label_start_ns") <= F.col("feature_end_ns"), "LABEL_OVERLAP"),
                ),
                lambda c: c.isNotNull(),
            )
        ).alias("code"),
        "sample_id",
        none.alias("record_id"),
    )
    refs = samples.select("sample_id", "event_time_ns", F.least("feature_end_ns", "event_time_ns").alias("cutoff"), F.explode("record_ids").alias("record_id"))
    j = refs.join(records.withColumn("found", F.lit(True)), "record_id", "left")
    late = F.col("available") > F.col("cutoff")
    code = F.lit("FUTURE_RECORD")
    for kind, name in FUTURE_CODES.items():
        code = F.when(F.col("kind") == kind, name).otherwise(code)
    off = ~T.valid_at("valid_from", "valid_to", "event_time_ns")
    codes = F.array(
        F.when(F.col("found").isNull(), "MISSING_PROVENANCE"),
        F.when(late, code),
        F.when((F.col("kind") == 4) & off, "FUTURE_CONSTITUENT"),
        F.when((F.col("kind") == 1) & off, "FUTURE_CORPORATE_ACTION"),
    )
    provenance = j.select(F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code"), "sample_id", "record_id")
    order = F.when(F.col("split") == "TRAIN", 1).when(F.col("split") == "VALIDATION", 2).when(F.col("split") == "TEST", 3)
    per = samples.groupBy(order.alias("i")).agg(
        F.max("event_time_ns").alias("last_event"),
        F.max("label_end_ns").alias("last_label"),
        F.min(F.struct("event_time_ns", "sample_id")).alias("e"),
        F.min(F.struct("feature_start_ns", "sample_id")).alias("f"),
    )
    before = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)  # at most three rows
    per = per.withColumn("pe", F.max("last_event").over(before)).withColumn("pl", F.max("last_label").over(before))
    edges = per.select(
        F.inline(
            F.filter(
                F.array(
                    F.when(F.col("pe") >= F.col("e.event_time_ns"), F.struct(F.lit("NON_CHRONOLOGICAL_SPLIT").alias("code"), F.col("e.sample_id").alias("sample_id"))),
                    F.when(F.col("pl") + embargo_ns > F.col("f.feature_start_ns"), F.struct(F.lit("LABEL_OVERLAP").alias("code"), F.col("f.sample_id").alias("sample_id"))),
                ),
                lambda x: x.isNotNull(),
            )
        )
    ).select("code", "sample_id", none.alias("record_id"))
    out = own.unionByName(provenance).unionByName(edges)
    if randomized:
        out = out.unionByName(samples.sparkSession.sql("select 'RANDOMIZED_TIME_SPLIT' as code, '' as sample_id, cast(null as string) as record_id"))
    return out


def leakage_violations(spark: SparkSession, d: str) -> DataFrame:
    """All codes but the universe's on the sample manifest, which was split at random."""
    r = _records(spark, d).groupBy("record_id").agg(F.min(F.struct("kind", "available", "valid_from", "valid_to")).alias("r")).select("record_id", "r.*")
    return manifest_leaks(sample_manifest(spark, d), r, True, EMBARGO)


def universe_bias(spark: SparkSession, d: str) -> DataFrame:
    """Months whose members of each sector, as hindsight has them, differ from those known then: SURVIVORSHIP_BIAS."""
    months = spark.sql("select unix_micros(timestamp(m)) * 1000 as t from (select explode(sequence(date'2012-01-01', date'2022-12-01', interval 1 month)) as m)")
    s = _sectors(spark, d)
    j = s.join(F.broadcast(months), T.valid_at("effective_from_ns", "effective_to_ns", "t"))
    top = lambda x: F.max_by("sector_id", F.struct("version", "revision_id")).alias(x)
    seen = j.groupBy("t", "instrument_id").agg(top("hindsight"), F.max_by(F.when(F.col("available_at_ns") <= F.col("t"), F.col("sector_id")), F.when(F.col("available_at_ns") <= F.col("t"), F.struct("version", "revision_id"))).alias("then"))
    sides = seen.select("t", F.explode(F.array(F.struct(F.col("hindsight").alias("sector"), F.lit(1).alias("now"), F.lit(0).alias("old")), F.struct(F.col("then").alias("sector"), F.lit(0).alias("now"), F.lit(1).alias("old")))).alias("x"), "instrument_id")
    member = sides.where("x.sector is not null").groupBy("t", "x.sector", "instrument_id").agg(F.sum("x.now").alias("a"), F.sum("x.old").alias("b"))
    return member.groupBy(F.col("t").alias("month_ns"), F.col("sector").alias("sector_id")).agg(F.count_if(F.col("a") > F.col("b")).alias("unexpected"), F.count_if(F.col("b") > F.col("a")).alias("missing")).where("unexpected + missing > 0")


# --- Corporate actions ---------------------------------------------------------


#: Exponents of two and three in the terms of a split's ratio, which are 1 to 4.
TWOS, THREES = (0, 1, 0, 2), (0, 0, 1, 0)
#: A price is below 2^30 and no ratio is below 1, so beyond a product of 2^33 the price rounds to 0. Up to it there are at most 56 threes.
NOTHING_LEFT, MOST_THREES = 33.0, 56


def split_adjusted(spark: SparkSession, d: str) -> DataFrame:
    """Prices of an instrument's events on the share basis of a later instant.

    A corporate action's latest known version (by version) counts if it takes effect
    after the event and not after the instant; its ratio of new to old shares is made
    from its version and value. Prices are divided by the product of the ratios,
    exactly, halves to even, however many splits there are: the product is kept as
    its exponents of two and three, which are running sums over the instrument's
    actions and events, latest first.
    """
    r = _records(spark, d)
    known = T.latest(r.where(f"kind = 1 and available <= {AT} and instrument_id is not null"), ["logical_key"], [F.col("version"), F.col("record_id")], ["instrument_id", "valid_from", "version", "value"])
    ratio = known.select("instrument_id", F.col("valid_from").alias("t"), (F.abs(F.coalesce(F.col("value"), F.lit(0))) % 3 + 2).cast("int").alias("new"), (F.col("version") % 2 + 1).cast("int").alias("old")).where(F.col("t") <= AT)
    p = r.where(f"kind <> 1 and event_time_ns < {AT} and instrument_id is not null").select("record_id", "instrument_id", F.col("event_time_ns").alias("t"), (F.pmod("event_time_ns", F.lit(10**9)) + 1).alias("price"))
    return adjusted_for_splits(p, ratio)


def adjusted_for_splits(prices: DataFrame, splits: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Prices (record_id, instrument_id, t, price up to 1e9) over the ratios of later splits (instrument_id, t, new, old; terms 1 to 4, new >= old).

    Prices without a later split are left out. Returns: record_id, price, splits, adjusted.
    """
    power = lambda of: F.element_at(F.array(*map(F.lit, of)), F.col("new")) - F.element_at(F.array(*map(F.lit, of)), F.col("old"))
    none, zero = F.lit(None), F.lit(0)
    #: The complement turns the order of time round; prices come before splits of the same instant.
    asks = prices.select("instrument_id", F.bitwise_not("t").alias("back"), zero.alias("one"), zero.alias("twos"), zero.alias("threes"), "record_id", "price")
    told = splits.select("instrument_id", F.bitwise_not("t").alias("back"), F.lit(1).alias("one"), power(TWOS).alias("twos"), power(THREES).alias("threes"), none.cast("string").alias("record_id"), none.cast("long").alias("price"))
    both = durable(asks.unionByName(told), "splits")
    bounds = bucket_bounds(both, ["instrument_id"], "back", bucket_rows)
    for name in ("one", "twos", "threes"):
        both = running_total(both, ["instrument_id"], "back", f"n_{name}", bounds, F.col(name), ["one"])
    x = both.where("price is not null and n_one > 0")
    left = F.col("n_twos") + F.col("n_threes") * math.log2(3) <= NOTHING_LEFT
    two, three = (F.when(left, F.col(c)).otherwise(0) for c in ("n_twos", "n_threes"))
    power_of = lambda base, n: F.element_at(F.array(*(F.lit(str(base**k)).cast(WIDE) for k in range(MOST_THREES + 1))), F.greatest(n, zero).cast("int") + 1)
    adjusted = half_even_div(wide("price") * power_of(2, -two), power_of(2, two) * power_of(3, three))
    return x.select("record_id", "price", F.col("n_one").cast("int").alias("splits"), F.when(left, adjusted).otherwise(zero).alias("adjusted"))


# --- Calendars -----------------------------------------------------------------


def session_calendar(spark: SparkSession, d: str) -> DataFrame:
    """Opening and closing of the New York session on each weekday with a record: local clock times, daylight saving included, early on the day before a holiday."""
    days = table(spark, d, "records").select(F.to_date(F.expr("timestamp_micros(event_time_ns div 1000)")).alias("day")).dropna().distinct().where(F.weekday("day") < 5)
    early = F.date_format("day", "MM-dd").isin("07-03", "12-24")
    zone = "America/New_York"
    return days.select(F.col("day").cast("string").alias("session_date"), C.local_ns(F.col("day"), "09:30", zone).alias("open_ns"), C.local_ns(F.col("day"), F.when(early, "13:00").otherwise("16:00"), zone).alias("close_ns"))


def _sessions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, d, "session_summaries").groupBy(F.col("trading_date").alias("session")).agg(F.min("session_open_exchange_time_ns").alias("open_ns"), F.max("session_close_exchange_time_ns").alias("close_ns"))
    day = F.substring("session", -2, 2).cast("int")
    noon = s.where(day % 5 == 0).select("session", (F.col("open_ns") + 60 * MINUTE + 5).alias("halt_start_ns"), (F.col("open_ns") + 75 * MINUTE).alias("halt_end_ns"))
    end = s.where(day % 11 == 0).select("session", (F.col("close_ns") - 3 * MINUTE).alias("halt_start_ns"), F.col("close_ns").alias("halt_end_ns"))
    return s, noon.unionByName(end)


def horizon_targets(spark: SparkSession, d: str) -> DataFrame:
    """The twelve horizons from every fifth minute, under three halt policies."""
    sessions, halts = _sessions(spark, d)
    asof = C.session_minutes(sessions, halts).where(f"endpoint_ns div {MINUTE} % 5 = 0").select(F.col("endpoint_ns").alias("as_of_ns"))
    return C.horizon_targets(asof, sessions, halts)


def known_from(spark: SparkSession, d: str) -> DataFrame:
    """Releases of which only the date is told are known from the next UTC midnight on."""
    r = table(spark, d, "records").where("kind = 6").select("record_id", F.expr("cast(timestamp_micros(publication_time_ns div 1000) as date)").alias("day")).distinct()
    return r.select("record_id", (F.unix_micros(F.date_add("day", 1).cast("timestamp")) * 1000).alias("known_ns"))


def month_batches(spark: SparkSession, d: str) -> DataFrame:
    """Month windows over the records' span by batches of ten names of the universe."""
    span = table(spark, d, "records").agg(F.min("event_time_ns").alias("a"), F.max("event_time_ns").alias("b"))
    month = lambda c: F.expr(f"cast(date_trunc('month', timestamp_micros({c} div 1000)) as date)")
    months = span.select(F.explode(F.sequence(month("a"), month("b"), F.expr("interval 1 month"))).alias("first_day"))
    names = table(spark, d, "raw_bars").select("symbol").dropna().distinct().withColumn("i", F.expr("(row_number() over (order by symbol) - 1) div 10"))
    batches = names.groupBy("i").agg(F.array_join(F.array_sort(F.collect_list("symbol")), ",").alias("names"))
    return months.crossJoin(batches).select(F.col("first_day").cast("string").alias("first_day"), F.last_day("first_day").cast("string").alias("last_day"), F.col("i").alias("batch"), "names")


# --- Identities and look-ups ---------------------------------------------------


def issuer_identity(spark: SparkSession, d: str) -> DataFrame:
    """The universe against two sources of identity: RESOLVED where each names exactly one, AMBIGUOUS where one names several, else UNRESOLVED."""
    clean = F.upper(F.trim("symbol"))
    universe = table(spark, d, "raw_bars").select("symbol").dropna().distinct()
    ids = table(spark, d, "minute_readings").where("instrument_id is not null").groupBy(clean.alias("symbol")).agg(F.countDistinct("instrument_id").alias("n_ids"), F.min("instrument_id").alias("instrument_id"))
    names = table(spark, d, "session_summaries").groupBy(F.upper(F.trim("source_ticker")).alias("symbol")).agg(F.countDistinct("instrument_id").alias("n_names"), F.min("instrument_id").alias("covered_id"))
    j = universe.join(ids, "symbol", "left").join(names, "symbol", "left")
    state = F.when((F.col("n_ids") > 1) | (F.col("n_names") > 1), "AMBIGUOUS").when(F.col("instrument_id") == F.col("covered_id"), "RESOLVED").otherwise("UNRESOLVED")
    return j.select("symbol", "instrument_id", "covered_id", state.alias("state"))


def shard_pruning(spark: SparkSession, d: str) -> DataFrame:
    """Shards (source and year) whose declared span meets a window, with their rows inside it: the spans, a small table, prune before the rows are read."""
    c = table(spark, d, "event_coverage").where("source_id is not null and start_time_ns is not null and end_time_ns > start_time_ns").withColumn("shard", F.concat("source_id", F.lit("/"), F.year(F.expr("timestamp_micros(start_time_ns div 1000)"))))
    a, b = AT, AT + 180 * DAY
    declared = c.groupBy("shard").agg(F.min("start_time_ns").alias("first"), F.max("end_time_ns").alias("last")).where((F.col("first") < b) & (F.col("last") > a))
    inside = (F.col("start_time_ns") < b) & (F.col("end_time_ns") > a)
    return c.join(declared.select("shard"), "shard").groupBy("shard").agg(F.count(F.lit(1)).alias("rows_read"), F.count_if(inside).alias("rows_kept"))


def identity_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Bars per symbol and session against six references at once: identity, session, calendar day, coverage, sector, latest record; the first that lacks is told."""
    b = table(spark, d, "raw_bars").groupBy("symbol", "session_id").agg(F.count(F.lit(1)).alias("bars"))
    ident = issuer_identity(spark, d).select("symbol", "instrument_id", F.col("state").alias("identity"))
    sess = table(spark, d, "session_summaries").groupBy(F.upper(F.trim("source_ticker")).alias("symbol"), "session_id").agg(F.min("session_open_exchange_time_ns").alias("t"), F.min("trading_date").alias("trading_date"))
    cal = _sessions(spark, d)[0].select(F.col("session").alias("trading_date"), F.col("open_ns"))
    sec = T.effective_then_latest(_sectors(spark, d), AT, AT, ["instrument_id"], ["sector_id"], start="effective_from_ns", end="effective_to_ns", available="available_at_ns", version="version").select("instrument_id", "sector_id")
    rec = T.latest(_records(spark, d).where("instrument_id is not null and event_time_ns is not null"), ["instrument_id"], [F.col("event_time_ns"), F.col("record_id")], ["record_id"])
    j = b.join(ident, "symbol", "left").join(sess, ["symbol", "session_id"], "left").join(cal, "trading_date", "left").join(sec, "instrument_id", "left").join(rec, "instrument_id", "left")
    step = (
        F.when(F.coalesce(F.col("identity"), F.lit("")) != "RESOLVED", "IDENTITY").when(F.col("t").isNull(), "SESSION").when(F.col("open_ns").isNull(), "CALENDAR")
        .when(F.col("open_ns") != F.col("t"), "HOURS").when(F.col("sector_id").isNull(), "SECTOR").when(F.col("record_id").isNull(), "RECORD").otherwise("RESOLVED")
    )
    return j.select("symbol", "session_id", "bars", step.alias("state"))


def guidance_change(spark: SparkSession, d: str) -> DataFrame:
    """Second versions of estimates against the first ones: change in ppm toward zero, or why there is none."""
    r = _records(spark, d).where("kind = 5")
    one = lambda v, name: r.where(f"version = {v}").groupBy("logical_key").agg(F.min_by("value", "record_id").alias(name))
    j = one(2, "current").withColumn("k", F.lit(True)).join(one(1, "prior").withColumn("p", F.lit(True)), "logical_key", "left")
    state = F.when(F.col("p").isNull(), "NO_PRIOR").when(F.col("current").isNull() | F.col("prior").isNull(), "MISSING_VALUE").when(F.col("prior") == 0, "ZERO_PRIOR").otherwise("OK")
    return j.select("logical_key", "current", "prior", state.alias("state"), mul_div(F.col("current") - F.col("prior"), 1_000_000, F.abs("prior")).alias("change_ppm"))


def macro_surprise(spark: SparkSession, d: str) -> DataFrame:
    """Macro releases against the first version as expectation; several values of one version are a CONFLICT."""
    r = _records(spark, d).where("kind = 6")
    g = r.groupBy("logical_key").agg(
        F.countDistinct(F.when(F.col("version") == 2, F.col("value"))).alias("values"), F.min(F.when(F.col("version") == 2, F.col("value"))).alias("official"), F.min(F.when(F.col("version") == 1, F.col("value"))).alias("expected")
    )
    state = F.when(F.col("values") > 1, "CONFLICT").when(F.col("official").isNull(), "PENDING").when(F.col("expected").isNull(), "NO_EXPECTATION").otherwise("OK")
    return g.select("logical_key", state.alias("state"), F.when(state == "OK", F.col("official") - F.col("expected")).alias("surprise"))


def same_day_share(spark: SparkSession, d: str) -> DataFrame:
    """Share of traded quantity that ships within 30 days of its order, per priority: join and conditional sum."""
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").cast("long").alias("q"), "l_shipdate")  # noqa: E741
    j = l.join(table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority"), "o_orderkey")
    near = F.datediff("l_shipdate", "o_orderdate") <= 30
    return j.groupBy("o_orderpriority").agg(mul_div(F.sum(F.when(near, F.col("q")).otherwise(0)), 1_000_000, F.sum("q")).alias("near_ppm"), F.sum("q").alias("quantity"))


def vintage_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one key and version: the first arrival is kept, another value is a CONFLICTING_VINTAGE."""
    r = table(spark, d, "records").select("record_id", "kind", "logical_key", "version", F.col("receive_time_ns").alias("t"), F.col("payload.value_microunits").alias("value"))
    g = r.groupBy("kind", "logical_key", "version").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("value").alias("values"), F.min(F.struct("t", "record_id")).alias("first"))
    state = F.when(F.col("values") > 1, "CONFLICTING_VINTAGE").when(F.col("rows") > 1, "DUPLICATE").otherwise("UNIQUE")
    return g.select("kind", "logical_key", "version", "rows", F.col("first.record_id").alias("kept"), state.alias("state"))


# --- Readiness of a training set -----------------------------------------------

#: Least valid labels and symbols that a horizon must have.
LEAST_ROWS, LEAST_SYMBOLS = 20_000, 5


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """Nine raw features of a minute as one array, with null where the past is missing."""
    w = Window.partitionBy(*S).orderBy("m")
    m = _minutes(spark, d)
    back = lambda k: F.max("c_ticks").over(w.rangeBetween(-k, -k))
    features = [F.col(c) for c in ("o_ticks", "h_ticks", "l_ticks", "c_ticks", "volume")] + [F.col("c_ticks") - back(k) for k in (1, 5, 15, 30)]
    return m.select("bar_id", *S, "m", "c_ticks", F.array(*(f.cast("long") for f in features)).alias("raw"))


def feature_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Per series how many vectors are complete, and which elements are null how often (a mask over the array's places)."""
    v = _vectors(spark, d).withColumn("mask", F.transform("raw", lambda x: F.when(x.isNull(), 1).otherwise(0)))
    nulls = [F.sum(F.element_at("mask", i)).alias(f"null_{i}") for i in range(1, 10)]
    return v.groupBy(*S).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.exists("raw", lambda x: x.isNull())).alias("complete"), *nulls)


def training_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows fit for training per horizon: all features present and the label valid."""
    complete = _vectors(spark, d).where(F.forall("raw", lambda x: x.isNotNull())).select("bar_id", "symbol")
    labels = B.horizon_labels(_minutes(spark, d), HORIZONS).where("validity = 'VALID'").select("bar_id", "horizon")
    return labels.join(complete, "bar_id").groupBy("horizon").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("symbol").alias("symbols"))


def training_readiness(spark: SparkSession, d: str) -> DataFrame:
    """Whether each horizon has enough rows and symbols, with the reasons that block it; horizons without a row are listed."""
    want = spark.createDataFrame([(h,) for h in [*HORIZONS, 600]], "horizon int")
    j = want.join(training_rows(spark, d), "horizon", "left").select("horizon", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("symbols", F.lit(0)).alias("symbols"))
    reasons = F.filter(F.array(F.when(F.col("n") == 0, "NO_ROWS"), F.when(F.col("n") < LEAST_ROWS, "TOO_FEW_ROWS"), F.when(F.col("symbols") < LEAST_SYMBOLS, "TOO_FEW_SYMBOLS")), lambda x: x.isNotNull())
    return j.select("horizon", "n", "symbols", F.array_join(reasons, ",").alias("blocked_by"), (F.size(reasons) == 0).alias("ready"))


def label_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Labels per horizon and reason: NONE for a valid one, BEYOND_SESSION, NO_TARGET_BAR."""
    l = B.horizon_labels(_minutes(spark, d), HORIZONS)  # noqa: E741
    reason = F.when(F.col("validity") == "VALID", "NONE").when(F.col("validity") == "INVALID", "BEYOND_SESSION").otherwise("NO_TARGET_BAR")
    return l.groupBy("horizon", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def partition_digests(spark: SparkSession, d: str) -> DataFrame:
    """Per date and bucket a digest of the rows in order, and expected against observed minutes.

    Each series' rows are digested in order; a partition's digest is that of its
    series' digests in order, so no partition is gathered in one task.
    """
    m = _minutes(spark, d).withColumn("trading_date", F.substring("session_id", -10, 10))
    row = F.concat_ws("|", "minute_ns", "o_ticks", "h_ticks", "l_ticks", "c_ticks", "volume")
    per = m.groupBy("trading_date", "bucket", "symbol", "market_id", "session_id").agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("minute_ns", row.alias("r")))), lambda x: x.r), "\n"), 256).alias("h"), F.count(F.lit(1)).alias("n")
    )
    listed = F.transform(F.array_sort(F.collect_list(F.struct("symbol", "market_id", "session_id", "h"))), lambda x: x.h)
    return per.groupBy("trading_date", "bucket").agg(F.sha2(F.array_join(listed, "\n"), 256).alias("digest"), F.sum("n").alias("observed"), (F.count(F.lit(1)) * 390).alias("expected"))


# --- JSON and decimals ---------------------------------------------------------


def _nested(event_id: Column) -> Column:
    """JSON of a depth that follows from the id."""
    return F.concat(F.repeat(F.lit('{"a":['), (event_id % 5).cast("int")), F.lit('{"k":'), event_id, F.lit("}"), F.repeat(F.lit("]}"), (event_id % 5).cast("int")))


def json_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Depth and size of JSON texts against bounds; depth is the most brackets open at once, counted by a fold over the text's brackets."""
    e = table(spark, d, "events").select("event_id", _nested(F.col("event_id")).alias("j"))
    marks = F.split(F.regexp_replace("j", r"[^\[\]{}]", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("top"))
    step = lambda a, c: F.struct((a.now + F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)).alias("now"), F.greatest(a.top, a.now + F.when(c.isin("{", "["), 1).otherwise(0)).alias("top"))
    depth = F.aggregate(marks, start, step, lambda a: a.top)
    return e.select("event_id", depth.alias("depth"), F.length("j").alias("size")).withColumn("state", F.when(F.col("depth") > 7, "TOO_DEEP").when(F.col("size") > 48, "TOO_LARGE").otherwise("OK"))


def structured_redaction(spark: SparkSession, d: str) -> DataFrame:
    """Values under secret names are replaced throughout a map of maps."""
    secret = lambda k: k.rlike("(?i)(?:key|token|secret|password)$")
    hide = lambda m: F.transform_values(m, lambda k, v: F.when(secret(k), F.lit("[REDACTED]")).otherwise(v))
    o = table(spark, d, "orders").select("o_orderkey", F.create_map(F.lit("head"), F.create_map(F.lit("api_key"), F.col("o_custkey").cast("string"), F.lit("status"), F.col("o_orderstatus")), F.lit("tail"), F.create_map(F.lit("note"), F.col("o_orderpriority"), F.lit("userToken"), F.lit("x"))).alias("m"))
    r = o.select("o_orderkey", F.transform_values("m", lambda _, v: hide(v)).alias("m"))
    return r.select("o_orderkey", F.col("m")["head"]["api_key"].alias("api_key"), F.col("m")["head"]["status"].alias("status"), F.col("m")["tail"]["note"].alias("note"), F.col("m")["tail"]["userToken"].alias("user_token"))


def decimal_parts(spark: SparkSession, d: str) -> DataFrame:
    """Coefficient and exponent of decimal texts; more than twelve digits are out of bounds."""
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.format_string("%.2f", "o_totalprice")).when(F.col("o_orderkey") % 3 == 1, F.format_string("-%.3f", "o_totalprice")).otherwise(F.concat("o_orderkey", F.lit("00000000000"))).alias("s"))
    digits = F.regexp_replace("s", r"[^0-9]", "")
    scale = F.length(F.regexp_extract("s", r"\.([0-9]*)$", 1))
    within = F.length(F.regexp_replace(digits, "^0+(?=.)", "")) <= 12
    sign = F.when(F.col("s").startswith("-"), -1).otherwise(1)
    return o.select("o_orderkey", F.when(within, sign * digits.cast("long")).alias("coefficient"), F.when(within, -scale).alias("exponent"))


def rational_products(spark: SparkSession, d: str) -> DataFrame:
    """Products of ratios reduced to lowest terms: line quantities over their number, applied to the price toward zero."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("a"), (F.col("l_linenumber") * 6).cast("long").alias("b"))  # noqa: E741
    p = ratio_times(F.col("a"), F.col("b"), F.lit(4).cast("long"), F.col("a") + 2)
    return l.select("l_orderkey", "l_linenumber", p.alias("p")).select("l_orderkey", "l_linenumber", "p.num", "p.den")


def event_flag_details(spark: SparkSession, d: str) -> DataFrame:
    """For each feature event the others of its instrument in force at its time: how many, the latest availability, and the first ids."""
    e = table(spark, d, "temporal_feature_events").where("instrument_id is not null").select("record_id", F.lower("instrument_id").alias("i"), F.col("event_time_ns").alias("t"), F.col("available_at_ns").alias("a"), F.col("valid_until_ns").alias("b")).distinct()
    spans = e.where("a is not null and b > a").select("i", F.col("record_id").alias("other"), "a", "b")
    hits = T.interval_stab(e.select("record_id", "i", "t"), spans, ["i"], "t", "a", "b", 10 * DAY).where("other <> record_id")
    g = hits.groupBy("record_id").agg(F.count(F.lit(1)).alias("active"), F.max("a").alias("latest_ns"), F.min("other").alias("first_id"), F.max("other").alias("last_id"))
    return e.select("record_id").distinct().join(g, "record_id", "left").select("record_id", F.coalesce("active", F.lit(0)).alias("active"), "latest_ns", "first_id", "last_id")


QUERIES = {
    f.__name__: f
    for f in (
        leakage_violations, universe_bias, split_adjusted, session_calendar, horizon_targets, known_from, month_batches, issuer_identity, shard_pruning, identity_resolve, guidance_change, macro_surprise,
        same_day_share, vintage_conflicts, feature_vectors, training_rows, training_readiness, label_reasons, partition_digests, json_bounds, structured_redaction, decimal_parts, rational_products, event_flag_details,
    )
}

_SAMPLES = R + f"""
, b as (select distinct record_id, kind, event_time_ns as t, available as known from r where event_time_ns is not null),
s0 as (select 's-' || record_id as sample_id, record_id, t % 97 as x, case when t % 97 % 3 = 0 then t else greatest(t, known) end as event from b),
s1 as (select *, event - {DAY} as feature_start, event + case when x % 11 = 0 then 1000 else 0 end as feature_end from s0),
s2 as (select *, feature_end + case when x % 13 = 0 then 0 else 1 end as label_start from s1),
s as (select *, label_start + {DAY} as label_end, case when event < {TRAIN_END} or x = 5 then 1 when event < {VALIDATION_END} then 2 else 3 end as i from s2),
refs as (select sample_id, event, least(feature_end, event) as cutoff, record_id from s union all select sample_id, event, least(feature_end, event), case when x % 17 = 0 then 'gone-' || record_id else record_id end from s),
j as (select refs.*, q.kind, q.available, q.valid_from, q.valid_to, q.record_id as found from refs left join (select distinct record_id, kind, available, valid_from, valid_to from r) q using (record_id)),
per as (select i, max(event) as last_event, max(label_end) as last_label, min(event) as e, min(feature_start) as f, arg_min(sample_id, (event, sample_id)) as es, arg_min(sample_id, (feature_start, sample_id)) as fs from s group by 1),
pb as (select *, max(last_event) over w as pe, max(last_label) over w as pl from per window w as (order by i rows between unbounded preceding and 1 preceding))
"""
_OFF = "not (valid_from <= event and (valid_to is null or event < valid_to))"
_CAL = f"""with s as (select trading_date as session, min(session_open_exchange_time_ns) as open_ns, max(session_close_exchange_time_ns) as close_ns from session_summaries group by 1),
h as (select session, open_ns + 60 * {MINUTE} + 5 as a, open_ns + 75 * {MINUTE} as b from s where cast(right(session, 2) as integer) % 5 = 0 union all select session, close_ns - 3 * {MINUTE}, close_ns from s where cast(right(session, 2) as integer) % 11 = 0),
g as (select session, unnest(generate_series(open_ns + {MINUTE}, close_ns, {MINUTE})) as e from s),
m0 as (select session, e, exists (select 1 from h where h.session = g.session and h.a < g.e and h.b > g.e - {MINUTE}) as halted from g),
m as (select *, count(*) over w as n_all, count(*) filter (not halted) over w as n_open, count(*) filter (halted) over w as n_halted from m0 window w as (order by e rows between unbounded preceding and current row)),
a as (select * from m where e // {MINUTE} % 5 = 0), pol as (select unnest(['PAUSE', 'REJECT', 'COUNT']) as policy),
mh as (select * from (values {', '.join(f"('{k}', {v})" for k, v in C.MINUTE_HORIZONS.items())}) t(horizon, n)), sh as (select * from (values {', '.join(f"('{k}', {v})" for k, v in C.SESSION_HORIZONS.items())}) t(horizon, n)),
x as (select a.e as as_of_ns, horizon, policy, a.halted, coalesce(p.e, q.e) as target_ns, coalesce(p.n_halted, q.n_halted, (select max(n_halted) from m)) > a.n_halted as on_way from a, mh, pol
  left join m p on policy = 'PAUSE' and not p.halted and p.n_open = a.n_open + n left join m q on policy <> 'PAUSE' and q.n_all = a.n_all + n),
d0 as (select session, max(e) as close_ns, arg_max(halted, e) as shut, bool_or(halted) as any_ from m group by 1),
d as (select *, row_number() over w as i, count(*) filter (shut) over w as n_shut, count(*) filter (any_) over w as n_any from d0 window w as (order by close_ns rows between unbounded preceding and current row)),
y as (select a.e as as_of_ns, horizon, policy, a.halted, coalesce(p.close_ns, q.close_ns) as target_ns, coalesce(q.n_any, (select max(n_any) from d)) > o.n_any as on_way from a join d o using (session), sh, pol
  left join d p on policy = 'PAUSE' and not p.shut and p.i - p.n_shut = o.i - o.n_shut + n left join d q on policy <> 'PAUSE' and q.i = o.i + n)
select as_of_ns, horizon, policy, state, case when state = 'OK' then target_ns end as target_ns from (select *, case when halted and policy <> 'COUNT' then 'INVALID_AS_OF_TIME' when policy = 'REJECT' and on_way then 'HALT_ENCOUNTERED'
  when target_ns is null then 'INSUFFICIENT_CALENDAR' else 'OK' end as state from (select * from x union all select * from y))
"""
_IDENT = """with u as (select distinct symbol from raw_bars where symbol is not null),
i as (select upper(trim(symbol)) as symbol, count(distinct instrument_id) as n_ids, min(instrument_id) as instrument_id from minute_readings where instrument_id is not null group by 1),
n as (select upper(trim(source_ticker)) as symbol, count(distinct instrument_id) as n_names, min(instrument_id) as covered_id from session_summaries group by 1),
ident as (select u.symbol, instrument_id, covered_id, case when n_ids > 1 or n_names > 1 then 'AMBIGUOUS' when instrument_id = covered_id then 'RESOLVED' else 'UNRESOLVED' end as state from u left join i using (symbol) left join n using (symbol))
"""
_BACK = ", ".join(f"c_ticks - max(c_ticks) over (partition by symbol, market_id, session_id order by m range between {k} preceding and {k} preceding) as b{k}" for k in (1, 5, 15, 30))
_VEC = MIN + f", v as (select *, [o_ticks, h_ticks, l_ticks, c_ticks, volume, b1, b5, b15, b30] as raw from (select *, {_BACK} from m))"
_TRAIN = _LABELS + ", tr as (select horizon, count(*) as n, count(distinct v.symbol) as symbols from labels join v using (bar_id) where validity = 'VALID' and not list_contains(list_transform(raw, lambda z: z is null), true) group by 1)"


def _half_even(n: str, d: str) -> str:
    q, r = f"({n}) // ({d})", f"({n}) % ({d})"
    return f"cast({q} + case when 2 * ({r}) > ({d}) or (2 * ({r}) = ({d}) and ({q}) % 2 = 1) then 1 else 0 end as bigint)"


SQL = {
    "leakage_violations": _SAMPLES
    + f"""select 'FUTURE_FEATURE' as code, sample_id, cast(null as varchar) as record_id from s where feature_end > event union all select 'LABEL_OVERLAP', sample_id, null from s where label_start <= feature_end
union all select 'MISSING_PROVENANCE', sample_id, record_id from j where found is null
union all select case kind when 1 then 'FUTURE_CORPORATE_ACTION' when 4 then 'FUTURE_CONSTITUENT' when 5 then 'POST_EVENT_ESTIMATE' when 6 then 'FUTURE_MACRO_REVISION' else 'FUTURE_RECORD' end, sample_id, record_id from j where available > cutoff
union all select 'FUTURE_CONSTITUENT', sample_id, record_id from j where kind = 4 and {_OFF} union all select 'FUTURE_CORPORATE_ACTION', sample_id, record_id from j where kind = 1 and {_OFF}
union all select 'NON_CHRONOLOGICAL_SPLIT', es, null from pb where pe >= e union all select 'LABEL_OVERLAP', fs, null from pb where pl + {EMBARGO} > f union all select 'RANDOMIZED_TIME_SPLIT', '', null""",
    "universe_bias": """with m as (select epoch_ns(cast(unnest(generate_series(timestamp '2012-01-01', timestamp '2022-12-01', interval 1 month)) as timestamp)) as t), s as (select distinct revision_id, instrument_id, sector_id, effective_from_ns as f, effective_to_ns as e, available_at_ns as a, version from sector_revisions),
j as (select * from s join m on f <= t and (e is null or t < e)),
x as (select t, instrument_id, arg_max(sector_id, (version, revision_id)) as now_, arg_max(sector_id, (version, revision_id)) filter (a <= t) as then_ from j group by 1, 2),
y as (select t, now_ as sector, instrument_id, 1 as p, 0 as q from x union all select t, then_, instrument_id, 0, 1 from x where then_ is not null),
z as (select t, sector, instrument_id, sum(p) as p, sum(q) as q from y group by 1, 2, 3)
select * from (select t as month_ns, sector as sector_id, count(*) filter (p > q) as unexpected, count(*) filter (q > p) as missing from z group by 1, 2) where unexpected + missing > 0""",
    "split_adjusted": R
    + f""", k as (select * from r where kind = 1 and available <= {AT} and instrument_id is not null qualify row_number() over (partition by logical_key order by version desc, record_id desc) = 1),
a as (select instrument_id, valid_from, abs(coalesce(value, 0)) % 3 + 2 as new_, version % 2 + 1 as old_ from k where valid_from <= {AT}),
p as (select record_id, instrument_id, event_time_ns, event_time_ns % 1000000000 + 1 as price from r where kind <> 1 and event_time_ns < {AT} and instrument_id is not null),
g as (select record_id, price, p.instrument_id, event_time_ns, count(*) as splits, list_reduce(list(cast(new_ as hugeint)), lambda x, y: x * y) as n, list_reduce(list(cast(old_ as hugeint)), lambda x, y: x * y) as o from p join a on a.instrument_id = p.instrument_id and a.valid_from > event_time_ns group by 1, 2, 3, 4)
select record_id, price, cast(splits as integer) as splits, {_half_even("price * o", "n")} as adjusted from g""",
    "session_calendar": """with d as (select distinct cast(make_timestamp(event_time_ns // 1000) as date) as day from records where event_time_ns is not null)
select strftime(day, '%Y-%m-%d') as session_date, epoch_us(timezone('America/New_York', day + time '09:30:00')) * 1000 as open_ns,
  epoch_us(timezone('America/New_York', day + case when strftime(day, '%m-%d') in ('07-03', '12-24') then time '13:00:00' else time '16:00:00' end)) * 1000 as close_ns from d where isodow(day) < 6""",
    "horizon_targets": _CAL,
    "known_from": "select distinct record_id, epoch_us(cast(make_timestamp(publication_time_ns // 1000) as date) + interval 1 day) * 1000 as known_ns from records where kind = 6",
    "month_batches": """with sp as (select date_trunc('month', make_timestamp(min(event_time_ns) // 1000)) as a, date_trunc('month', make_timestamp(max(event_time_ns) // 1000)) as b from records),
m as (select cast(unnest(generate_series(cast(a as timestamp), cast(b as timestamp), interval 1 month)) as date) as f from sp),
n as (select symbol, (row_number() over (order by symbol) - 1) // 10 as i from (select distinct symbol from raw_bars where symbol is not null)), g as (select i, string_agg(symbol, ',' order by symbol) as names from n group by 1)
select strftime(f, '%Y-%m-%d') as first_day, strftime(last_day(f), '%Y-%m-%d') as last_day, i as batch, names from m, g""",
    "issuer_identity": _IDENT + "select * from ident",
    "shard_pruning": f"""with c as (select source_id || '/' || year(make_timestamp(start_time_ns // 1000)) as shard, start_time_ns as a, end_time_ns as b from event_coverage where source_id is not null and end_time_ns > start_time_ns),
d as (select shard from c group by 1 having min(a) < {AT + 180 * DAY} and max(b) > {AT}) select shard, count(*) as rows_read, count(*) filter (a < {AT + 180 * DAY} and b > {AT}) as rows_kept from c join d using (shard) group by 1""",
    "identity_resolve": _IDENT
    + f""", b as (select symbol, session_id, count(*) as bars from raw_bars group by 1, 2), ss as (select upper(trim(source_ticker)) as symbol, session_id, min(session_open_exchange_time_ns) as t, min(trading_date) as trading_date from session_summaries group by 1, 2),
cal as (select trading_date, min(session_open_exchange_time_ns) as open_ns from session_summaries group by 1),
sec as (select instrument_id, arg_max(sector_id, version) as sector_id from sector_revisions where available_at_ns <= {AT} and effective_from_ns <= {AT} and (effective_to_ns is null or {AT} < effective_to_ns) group by 1),
rec as (select lower(payload.instrument_id) as instrument_id, max(record_id) as record_id from records where payload.instrument_id is not null and event_time_ns is not null group by 1)
select b.symbol, b.session_id, bars, case when coalesce(ident.state, '') <> 'RESOLVED' then 'IDENTITY' when t is null then 'SESSION' when open_ns is null then 'CALENDAR' when open_ns <> t then 'HOURS' when sector_id is null then 'SECTOR' when record_id is null then 'RECORD' else 'RESOLVED' end as state
from b left join ident on ident.symbol = b.symbol left join ss on ss.symbol = b.symbol and ss.session_id = b.session_id left join cal using (trading_date) left join sec on sec.instrument_id = ident.instrument_id left join rec on rec.instrument_id = ident.instrument_id""",
    "guidance_change": R
    + """, c as (select logical_key, arg_min_null(value, record_id) as current from r where kind = 5 and version = 2 group by 1), p as (select logical_key, arg_min_null(value, record_id) as prior, true as p from r where kind = 5 and version = 1 group by 1)
select logical_key, current, prior, case when p is null then 'NO_PRIOR' when current is null or prior is null then 'MISSING_VALUE' when prior = 0 then 'ZERO_PRIOR' else 'OK' end as state,
  cast(case when prior <> 0 then sign(current - prior) * (abs(cast(current as hugeint) - prior) * 1000000 // abs(prior)) end as bigint) as change_ppm from c left join p using (logical_key)""",
    "macro_surprise": R
    + """, g as (select logical_key, count(distinct case when version = 2 then value end) as n, min(case when version = 2 then value end) as o, min(case when version = 1 then value end) as e from r where kind = 6 group by 1),
h as (select *, case when n > 1 then 'CONFLICT' when o is null then 'PENDING' when e is null then 'NO_EXPECTATION' else 'OK' end as state from g) select logical_key, state, case when state = 'OK' then o - e end as surprise from h""",
    "same_day_share": """select o_orderpriority, cast(sum(case when date_diff('day', cast(o_orderdate as date), cast(l_shipdate as date)) <= 30 then cast(l_quantity as bigint) else 0 end) * 1000000 // sum(cast(l_quantity as bigint)) as bigint) as near_ppm,
  cast(sum(cast(l_quantity as bigint)) as bigint) as quantity from lineitem join orders on l_orderkey = o_orderkey group by 1""",
    "vintage_conflicts": """select kind, logical_key, version, count(*) as rows, arg_min(record_id, (receive_time_ns, record_id)) as kept,
  case when count(distinct payload.value_microunits) > 1 then 'CONFLICTING_VINTAGE' when count(*) > 1 then 'DUPLICATE' else 'UNIQUE' end as state from records group by 1, 2, 3""",
    "feature_vectors": _VEC
    + "select symbol, market_id, session_id, count(*) as n, count(*) filter (not list_contains(list_transform(raw, lambda z: z is null), true)) as complete, "
    + ", ".join(f"cast(count(*) filter (raw[{i}] is null) as bigint) as null_{i}" for i in range(1, 10))
    + " from v group by 1, 2, 3",
    "training_rows": _VEC + _TRAIN + " select * from tr",
    "training_readiness": _VEC
    + _TRAIN
    + f""", w as (select unnest({[*HORIZONS, 600]}) as horizon), q as (select horizon, coalesce(n, 0) as n, coalesce(symbols, 0) as symbols from w left join tr using (horizon)),
z as (select *, list_filter([case when n = 0 then 'NO_ROWS' end, case when n < {LEAST_ROWS} then 'TOO_FEW_ROWS' end, case when symbols < {LEAST_SYMBOLS} then 'TOO_FEW_SYMBOLS' end], lambda c: c is not null) as c from q)
select horizon, n, symbols, array_to_string(c, ',') as blocked_by, len(c) = 0 as ready from z""",
    "label_reasons": MIN + _LABELS + "select horizon, case validity when 'VALID' then 'NONE' when 'INVALID' then 'BEYOND_SESSION' else 'NO_TARGET_BAR' end as reason, count(*) as n from labels group by 1, 2",
    "partition_digests": MIN
    + """, per as (select trading_date, bucket, symbol, market_id, session_id, sha256(string_agg(concat_ws('|', minute_ns, o_ticks, h_ticks, l_ticks, c_ticks, volume), chr(10) order by minute_ns)) as h, count(*) as n from m group by all)
select trading_date, bucket, sha256(string_agg(h, chr(10) order by symbol, market_id, session_id)) as digest, cast(sum(n) as bigint) as observed, count(*) * 390 as expected from per group by 1, 2""",
    "json_bounds": """with e as (select event_id, repeat('{"a":[', cast(event_id % 5 as bigint)) || '{"k":' || event_id || '}' || repeat(']}', cast(event_id % 5 as bigint)) as j from events),
f as (select event_id, cast(list_max(list_transform(generate_series(1, len(j)), lambda i: len(regexp_replace(j[1:i], '[^\\[{]', '', 'g')) - len(regexp_replace(j[1:i], '[^\\]}]', '', 'g')))) as integer) as depth, cast(len(j) as integer) as size from e)
select *, case when depth > 7 then 'TOO_DEEP' when size > 48 then 'TOO_LARGE' else 'OK' end as state from f""",
    "structured_redaction": "select o_orderkey, '[REDACTED]' as api_key, o_orderstatus as status, o_orderpriority as note, '[REDACTED]' as user_token from orders",
    "decimal_parts": """with o as (select o_orderkey, case when o_orderkey % 3 = 0 then printf('%.2f', o_totalprice) when o_orderkey % 3 = 1 then printf('-%.3f', o_totalprice) else o_orderkey || '00000000000' end as s from orders),
p as (select *, len(regexp_replace(regexp_replace(s, '[^0-9]', '', 'g'), '^0+', '')) <= 12 as ok from o)
select o_orderkey, case when ok then case when s[1] = '-' then -1 else 1 end * cast(regexp_replace(s, '[^0-9]', '', 'g') as bigint) end as coefficient, cast(case when ok then -len(regexp_extract(s, '\\.([0-9]*)$', 1)) end as integer) as exponent from p""",
    "rational_products": """with l as (select l_orderkey, l_linenumber, cast(l_quantity as bigint) * 4 as n, cast(l_linenumber as bigint) * 6 * (cast(l_quantity as bigint) + 2) as d from lineitem)
select l_orderkey, l_linenumber, n // gcd(n, d) as num, d // gcd(n, d) as den from l""",
    "event_flag_details": """with e as (select distinct record_id, lower(instrument_id) as i, event_time_ns as t, available_at_ns as a, valid_until_ns as b from temporal_feature_events where instrument_id is not null),
h as (select x.record_id, y.record_id as other, y.a from e x join e y on x.i = y.i and y.a <= x.t and x.t < y.b and y.record_id <> x.record_id),
g as (select record_id, count(*) as active, max(a) as latest_ns, min(other) as first_id, max(other) as last_id from h group by 1)
select record_id, coalesce(active, 0) as active, latest_ns, first_id, last_id from (select distinct record_id from e) left join g using (record_id)""",
}
