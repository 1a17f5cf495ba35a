"""Point-in-time queries on bitemporal records and reference revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions.times import DAY, HOUR
from tideline.operators import temporal as T
from tideline.operators.grid import clean_symbol
from tideline.session import table

#: The instant that the snapshot queries ask about: 2015-01-01 UTC.
AT = 1_420_070_400_000_000_000


def _records(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "records")
    return r.select(
        "record_id",
        "logical_key",
        "kind",
        "version",
        "event_time_ns",
        "revision_time_ns",
        F.coalesce("available_at_ns", F.greatest("processing_time_ns", "revision_time_ns")).alias("available"),
        F.col("validity.valid_from_ns").alias("valid_from"),
        F.col("validity.valid_to_ns").alias("valid_to"),
        F.lower("payload.instrument_id").alias("instrument_id"),
        F.col("payload.value_microunits").alias("value"),
        F.col("source.provider").alias("provider"),
    ).distinct()


def _sectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sector_revisions").select("revision_id", "instrument_id", "sector_id", "effective_from_ns", "effective_to_ns", "available_at_ns", "version").distinct()


_KEEP = ["record_id", "version", "value"]
_SEC = ["revision_id", "sector_id", "version"]
_SECT = dict(start="effective_from_ns", end="effective_to_ns", available="available_at_ns", version="version")


def pit_as_known_at(spark: SparkSession, d: str) -> DataFrame:
    return T.as_known_at(_records(spark, d), AT, ["kind", "logical_key"], _KEEP, "available", "version")


def pit_by_availability(spark: SparkSession, d: str) -> DataFrame:
    return T.as_known_at(_records(spark, d), AT, ["kind", "logical_key"], _KEEP, "available", "version", by_availability=True)


def pit_latest_before(spark: SparkSession, d: str) -> DataFrame:
    return T.as_known_at(_records(spark, d), AT, ["kind", "logical_key"], _KEEP, "available", "version", strict=True)


def pit_known_latest_sql(spark: SparkSession, d: str) -> DataFrame:
    """The snapshot as SQL text over a registered view, parameters bound by name."""
    _records(spark, d).createOrReplaceTempView("tideline_records")
    return spark.sql(
        """with eligible as (select kind, logical_key, record_id, row_number() over (partition by kind, logical_key order by available desc, version desc) as rank
           from tideline_records where available <= :at)
           select kind, logical_key, record_id from eligible where rank = 1 order by kind, logical_key""",
        args={"at": AT},
    )


def pit_revisions_after(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).where(F.col("revision_time_ns") > AT).select("revision_time_ns", "kind", "logical_key", "version", "record_id").orderBy("revision_time_ns", "kind", "logical_key", "version")


def pit_top_version(spark: SparkSession, d: str) -> DataFrame:
    return T.latest(_records(spark, d), ["kind", "logical_key"], [F.col("version")], ["record_id", "version"])


def membership_at(spark: SparkSession, d: str) -> DataFrame:
    """Members of each sector at an instant, as a sorted list (one text per sector)."""
    cur = T.known_latest_then_effective(_sectors(spark, d), AT, AT, ["instrument_id"], ["sector_id"], **_SECT)
    return cur.groupBy("sector_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("instrument_id")), ",").alias("members"))


def asof_latest_then_filter(spark: SparkSession, d: str) -> DataFrame:
    return T.known_latest_then_effective(_sectors(spark, d), AT, AT, ["instrument_id"], _SEC, **_SECT).select("instrument_id", *_SEC)


def asof_filter_then_latest(spark: SparkSession, d: str) -> DataFrame:
    return T.effective_then_latest(_sectors(spark, d), AT, AT, ["instrument_id"], _SEC, **_SECT).select("instrument_id", *_SEC)


def asof_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Instruments for which several revisions known and in force name different sectors."""
    e = _sectors(spark, d).where((F.col("available_at_ns") <= AT) & T.valid_at("effective_from_ns", "effective_to_ns", AT))
    return e.groupBy("instrument_id").agg(F.countDistinct("sector_id").alias("sectors"), F.countDistinct("revision_id").alias("revisions")).where("sectors > 1")


def actions_history(spark: SparkSession, d: str) -> DataFrame:
    """All revisions of an instrument known and effective by an instant, in order, as one text."""
    e = _sectors(spark, d).where((F.col("available_at_ns") <= AT) & (F.col("effective_from_ns") <= AT))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("effective_from_ns", "version", "revision_id"))), lambda x: x.revision_id)
    return e.groupBy("instrument_id").agg(F.array_join(rows, ",").alias("history"))


def vintage_asof(spark: SparkSession, d: str) -> DataFrame:
    """Vintages with an expiry: a revision is known from its availability until the next one's."""
    w = Window.partitionBy("kind", "logical_key").orderBy("version")
    v = _records(spark, d).withColumn("known_through", F.lead("available").over(w))
    return v.where((F.col("available") <= AT) & (F.col("known_through").isNull() | (F.col("known_through") > AT))).select("kind", "logical_key", "record_id", "known_through")


def vintage_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Number of each vintage of a key, INITIAL or REVISION, and overlap with the one before."""
    w = Window.partitionBy("instrument_id").orderBy("effective_from_ns", "version")
    s = _sectors(spark, d).withColumn("n", F.row_number().over(w)).withColumn("prev_to", F.lag("effective_to_ns").over(w))
    kind = F.when(F.col("n") == 1, "INITIAL").otherwise("REVISION")
    return s.select("revision_id", F.col("n").alias("vintage"), kind.alias("revision_kind"), F.coalesce(F.col("prev_to") > F.col("effective_from_ns"), F.lit(False)).alias("overlaps"))


def lineage_violations(spark: SparkSession, d: str) -> DataFrame:
    return T.lineage_violations(_sectors(spark, d), ["instrument_id"], "version", "available_at_ns").select("revision_id", "violation")


def missing_parents(spark: SparkSession, d: str) -> DataFrame:
    """Second versions whose first version is not among the records (anti join)."""
    r = _records(spark, d)
    return r.where("version > 1").join(r.select("logical_key", (F.col("version") + 1).alias("version")), ["logical_key", "version"], "left_anti").select("record_id", "logical_key", "version")


def parent_links(spark: SparkSession, d: str) -> DataFrame:
    """Each later version with its parent, and whether the link is sound in time."""
    r = _records(spark, d)
    p = r.select("kind", "logical_key", (F.col("version") + 1).alias("version"), F.col("record_id").alias("parent_id"), F.col("revision_time_ns").alias("parent_time"))
    return r.where("version > 1").join(p, ["kind", "logical_key", "version"], "left").select("record_id", "parent_id", (F.col("parent_time") < F.col("revision_time_ns")).alias("sound"))


def no_future(spark: SparkSession, d: str) -> DataFrame:
    """Records known only after the cut-off, by kind: empty means that none leaks."""
    return _records(spark, d).where(F.col("available") > AT).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("available").alias("first_known"))


def leakage_report(spark: SparkSession, d: str) -> DataFrame:
    """Violations of temporal order among the records, one branch per rule, sorted."""
    r = _records(spark, d)
    rules = [
        ("AVAILABLE_BEFORE_EVENT", F.col("available") < F.col("event_time_ns")),
        ("EVENT_OUTSIDE_VALIDITY", ~T.valid_at("valid_from", "valid_to", "event_time_ns")),
        ("REVISED_BEFORE_EVENT", F.col("revision_time_ns") < F.col("event_time_ns")),
        ("UNKNOWN_INSTRUMENT", F.col("instrument_id").isNull()),
        ("NO_EVENT_TIME", F.col("event_time_ns").isNull()),
    ]
    codes = F.filter(F.array(*(F.when(cond, code) for code, cond in rules)), lambda x: x.isNotNull())
    return r.select(F.explode(codes).alias("code"), "record_id", "logical_key").orderBy("code", "record_id")


def universe_survivorship(spark: SparkSession, d: str) -> DataFrame:
    """Instruments with events but no reference revision, and the other way round."""
    a = _records(spark, d).select("instrument_id").dropna().distinct()
    b = _sectors(spark, d).select("instrument_id").distinct()
    return a.exceptAll(b).select("instrument_id", F.lit("UNEXPECTED").alias("side")).unionByName(b.exceptAll(a).select("instrument_id", F.lit("MISSING").alias("side")))


def coverage_flags(spark: SparkSession, d: str) -> DataFrame:
    """For each feature event: null where no NEWS source covers it, else 1 with another event within the hour before, 0 without."""
    events = table(spark, d, "temporal_feature_events").select("record_id", "event_time_ns", "instrument_id").distinct().withColumn("kind", F.lit("NEWS"))
    cover = table(spark, d, "event_coverage").select(F.upper(F.trim("kind")).alias("kind"), F.col("start_time_ns").alias("a"), F.col("end_time_ns").alias("b")).where("a is not null and b is not null")
    hit = T.interval_stab(events, cover, ["kind"], "event_time_ns", "a", "b", 10 * DAY).select("record_id").distinct().withColumn("covered", F.lit(True))
    w = Window.partitionBy("instrument_id").orderBy("event_time_ns").rangeBetween(-HOUR, -1)
    active = events.withColumn("near", F.when(F.col("instrument_id").isNotNull(), F.count(F.lit(1)).over(w)).otherwise(0))
    j = active.join(hit, "record_id", "left")
    return j.select("record_id", T.tristate(F.coalesce("covered", F.lit(False)), F.col("near") > 0).alias("flag"))


def active_events(spark: SparkSession, d: str) -> DataFrame:
    """Number of feature events in force at the start of each month (available and not expired), by kind."""
    e = table(spark, d, "temporal_feature_events").select("record_id", "kind", F.col("available_at_ns").alias("a"), F.col("valid_until_ns").alias("b")).distinct()
    months = spark.sql("select unix_micros(timestamp(m)) * 1000 as t from (select explode(sequence(date'2011-01-01', date'2023-01-01', interval 1 month)) as m)")
    kinds = e.select("kind").distinct()
    hits = T.interval_stab(months.crossJoin(F.broadcast(kinds)), e, ["kind"], "t", "a", "b", 10 * DAY)
    return hits.groupBy("t", "kind").agg(F.countDistinct("record_id").alias("n"))


def coverage_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of coverage rows of one source and kind that share time: how many per source."""
    c = table(spark, d, "event_coverage").select("coverage_id", F.upper(F.trim("kind")).alias("kind"), "source_id", F.col("start_time_ns").alias("s"), F.col("end_time_ns").alias("e")).dropna()
    o = c.select("kind", "source_id", F.col("coverage_id").alias("other_id"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    p = T.interval_overlap(c, o, ["kind", "source_id"], ("s", "e"), ("s2", "e2"), 30 * DAY).where("coverage_id < other_id")
    return p.groupBy("source_id", "kind").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.least("e", "e2") - F.greatest("s", "s2")).alias("shared_ns"))


def halt_free_minutes(spark: SparkSession, d: str) -> DataFrame:
    """Bars outside every session of their symbol, counted by symbol (anti join on an interval)."""
    from tideline.functions.times import rfc3339_ns

    bars = table(spark, d, "raw_bars").select("bar_id", "symbol", rfc3339_ns("t").alias("t"))
    s = table(spark, d, "session_summaries").select(clean_symbol("source_ticker").alias("symbol"), F.col("session_open_exchange_time_ns").alias("a"), F.col("session_close_exchange_time_ns").alias("b")).distinct()
    inside = T.interval_stab(bars, s, ["symbol"], "t", "a", "b", DAY).select("bar_id").distinct()
    return bars.join(inside, "bar_id", "left_anti").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


def calendar_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Each reading's session by date; readings of a date without a session are kept with a null."""
    from tideline.functions.times import instant_ns

    cal = table(spark, d, "session_summaries").groupBy("trading_date").agg(F.min("session_open_exchange_time_ns").alias("open_ns"))
    t = table(spark, d, "minute_readings").withColumn("t", instant_ns("event_time_ns"))
    r = t.select("reading_id", F.date_format(F.expr("timestamp_micros(t div 1000)"), "yyyy-MM-dd").alias("trading_date"))
    return r.join(cal, "trading_date", "left").select("reading_id", "trading_date", "open_ns")


def multiway_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Feature events resolved against sector revisions and the latest record of their instrument, in one chain; unresolved ones say at which step."""
    e = table(spark, d, "temporal_feature_events").select("record_id", F.lower("instrument_id").alias("instrument_id")).distinct()
    sec = T.effective_then_latest(_sectors(spark, d), AT, AT, ["instrument_id"], ["sector_id"], **_SECT)
    rec = T.latest(_records(spark, d).where("instrument_id is not null and event_time_ns is not null"), ["instrument_id"], [F.col("event_time_ns"), F.col("record_id")], ["record_id"]).withColumnRenamed("record_id", "latest_record")
    j = e.join(sec, "instrument_id", "left").join(rec, "instrument_id", "left")
    state = F.when(F.col("instrument_id").isNull(), "NO_INSTRUMENT").when(F.col("sector_id").isNull(), "NO_SECTOR").when(F.col("latest_record").isNull(), "NO_RECORD").otherwise("RESOLVED")
    return j.select("record_id", "sector_id", "latest_record", state.alias("state"))


QUERIES = {
    f.__name__: f
    for f in (
        pit_as_known_at,
        pit_by_availability,
        pit_latest_before,
        pit_known_latest_sql,
        pit_revisions_after,
        pit_top_version,
        membership_at,
        asof_latest_then_filter,
        asof_filter_then_latest,
        asof_conflicts,
        actions_history,
        vintage_asof,
        vintage_numbers,
        lineage_violations,
        missing_parents,
        parent_links,
        no_future,
        leakage_report,
        universe_survivorship,
        coverage_flags,
        active_events,
        coverage_overlaps,
        halt_free_minutes,
        calendar_lookup,
        multiway_resolve,
    )
}

R = """with r as (select distinct record_id, logical_key, kind, version, event_time_ns, revision_time_ns, coalesce(available_at_ns, greatest(processing_time_ns, revision_time_ns)) as available,
  validity.valid_from_ns as valid_from, validity.valid_to_ns as valid_to, lower(payload.instrument_id) as instrument_id, payload.value_microunits as value from records)
"""
SEC = "with s as (select distinct revision_id, instrument_id, sector_id, effective_from_ns as f, effective_to_ns as t, available_at_ns as a, version from sector_revisions)\n"
INFORCE = f"f <= {AT} and (t is null or {AT} < t)"


def _snapshot(cond: str, order: str) -> str:
    return R + f"select kind, logical_key, record_id, version, value from r where available {cond} {AT} qualify row_number() over (partition by kind, logical_key order by {order}) = 1"


SQL = {
    "pit_as_known_at": _snapshot("<=", "version desc"),
    "pit_by_availability": _snapshot("<=", "available desc, version desc"),
    "pit_latest_before": _snapshot("<", "version desc"),
    "pit_known_latest_sql": R + f"select kind, logical_key, record_id from r where available <= {AT} qualify row_number() over (partition by kind, logical_key order by available desc, version desc) = 1",
    "pit_revisions_after": R + f"select revision_time_ns, kind, logical_key, version, record_id from r where revision_time_ns > {AT} order by 1, 2, 3, 4",
    "pit_top_version": R + "select kind, logical_key, record_id, version from r qualify row_number() over (partition by kind, logical_key order by version desc) = 1",
    "membership_at": SEC
    + f", l as (select * from s where a <= {AT} qualify row_number() over (partition by instrument_id order by version desc) = 1) select sector_id, count(*) as n, string_agg(distinct instrument_id, ',' order by instrument_id) as members from l where {INFORCE} group by 1",
    "asof_latest_then_filter": SEC + f", l as (select * from s where a <= {AT} qualify row_number() over (partition by instrument_id order by version desc) = 1) select instrument_id, revision_id, sector_id, version from l where {INFORCE}",
    "asof_filter_then_latest": SEC + f"select instrument_id, revision_id, sector_id, version from s where a <= {AT} and {INFORCE} qualify row_number() over (partition by instrument_id order by version desc) = 1",
    "asof_conflicts": SEC + f"select instrument_id, count(distinct sector_id) as sectors, count(distinct revision_id) as revisions from s where a <= {AT} and {INFORCE} group by 1 having count(distinct sector_id) > 1",
    "actions_history": SEC + f"select instrument_id, string_agg(revision_id, ',' order by f, version, revision_id) as history from s where a <= {AT} and f <= {AT} group by 1",
    "vintage_asof": R + f", v as (select *, lead(available) over (partition by kind, logical_key order by version) as known_through from r) select kind, logical_key, record_id, known_through from v where available <= {AT} and (known_through is null or known_through > {AT})",
    "vintage_numbers": SEC + "select revision_id, cast(n as integer) as vintage, case when n = 1 then 'INITIAL' else 'REVISION' end as revision_kind, coalesce(p > f, false) as overlaps from (select *, row_number() over w as n, lag(t) over w as p from s window w as (partition by instrument_id order by f, version))",
    "lineage_violations": SEC + "select * from (select revision_id, case when version <> n then 'VERSION_GAP' when p is not null and a <= p then 'TIME_NOT_LATER' end as violation from (select *, row_number() over w as n, lag(a) over w as p from s window w as (partition by instrument_id order by version, a))) where violation is not null",
    "missing_parents": R + "select record_id, logical_key, version from r where version > 1 and not exists (select 1 from r q where q.logical_key = r.logical_key and q.version + 1 = r.version)",
    "parent_links": R + "select r.record_id, q.record_id as parent_id, q.revision_time_ns < r.revision_time_ns as sound from r left join r q on q.kind = r.kind and q.logical_key = r.logical_key and q.version + 1 = r.version where r.version > 1",
    "no_future": R + f"select kind, count(*) as n, min(available) as first_known from r where available > {AT} group by 1",
    "leakage_report": R
    + """select code, record_id, logical_key from (
  select 'AVAILABLE_BEFORE_EVENT' as code, record_id, logical_key from r where available < event_time_ns
  union all select 'EVENT_OUTSIDE_VALIDITY', record_id, logical_key from r where not (valid_from <= event_time_ns and (valid_to is null or event_time_ns < valid_to))
  union all select 'REVISED_BEFORE_EVENT', record_id, logical_key from r where revision_time_ns < event_time_ns
  union all select 'UNKNOWN_INSTRUMENT', record_id, logical_key from r where instrument_id is null
  union all select 'NO_EVENT_TIME', record_id, logical_key from r where event_time_ns is null) order by 1, 2""",
    "universe_survivorship": R
    + """, a as (select distinct instrument_id from r where instrument_id is not null), b as (select distinct instrument_id from sector_revisions)
select instrument_id, 'UNEXPECTED' as side from (select * from a except select * from b) union all select instrument_id, 'MISSING' from (select * from b except select * from a)""",
    "coverage_flags": f"""with e as (select distinct record_id, event_time_ns as t, instrument_id as i from temporal_feature_events),
c as (select distinct e.record_id from e join event_coverage v on upper(trim(v.kind)) = 'NEWS' and v.start_time_ns <= t and t < v.end_time_ns),
n as (select record_id, case when i is not null then count(*) over (partition by i order by t range between {HOUR} preceding and 1 preceding) else 0 end as near from e)
select record_id, cast(case when c.record_id is not null then case when near > 0 then 1 else 0 end end as integer) as flag from n left join c using (record_id)""",
    "active_events": """with m as (select epoch_ns(cast(unnest(generate_series(timestamp '2011-01-01', timestamp '2023-01-01', interval 1 month)) as timestamp)) as t)
select t, kind, count(distinct record_id) as n from m join temporal_feature_events e on e.available_at_ns <= t and t < e.valid_until_ns group by 1, 2""",
    "coverage_overlaps": """with c as (select coverage_id, upper(trim(kind)) as kind, source_id, start_time_ns as s, end_time_ns as e from event_coverage where kind is not null and source_id is not null and end_time_ns > start_time_ns)
select a.source_id, a.kind, count(*) as pairs, cast(sum(least(a.e, b.e) - greatest(a.s, b.s)) as bigint) as shared_ns from c a join c b on a.source_id = b.source_id and a.kind = b.kind and a.coverage_id < b.coverage_id and a.s < b.e and b.s < a.e group by 1, 2""",
    "halt_free_minutes": """select symbol, count(*) as n from raw_bars b where not exists (select 1 from session_summaries s where upper(trim(s.source_ticker)) = b.symbol
  and epoch_ns(cast(b.t as timestamptz)) >= session_open_exchange_time_ns and epoch_ns(cast(b.t as timestamptz)) < session_close_exchange_time_ns) group by 1""",
    "calendar_lookup": """with r as (select reading_id, strftime(make_timestamp((case when event_time_ns < 100000000000000 then event_time_ns * 1000000 when event_time_ns < 100000000000000000 then event_time_ns * 1000 else event_time_ns end) // 1000), '%Y-%m-%d') as trading_date from minute_readings),
c as (select trading_date, min(session_open_exchange_time_ns) as open_ns from session_summaries group by 1) select reading_id, trading_date, open_ns from r left join c using (trading_date)""",
    "multiway_resolve": R
    + f""", e as (select distinct record_id, lower(instrument_id) as i from temporal_feature_events),
s as (select instrument_id, arg_max(sector_id, version) as sector_id from sector_revisions where available_at_ns <= {AT} and effective_from_ns <= {AT} and (effective_to_ns is null or {AT} < effective_to_ns) group by 1),
l as (select instrument_id, record_id as latest_record from r where instrument_id is not null and event_time_ns is not null qualify row_number() over (partition by instrument_id order by event_time_ns desc, record_id desc) = 1)
select e.record_id, sector_id, latest_record, case when i is null then 'NO_INSTRUMENT' when sector_id is null then 'NO_SECTOR' when latest_record is null then 'NO_RECORD' else 'RESOLVED' end as state
from e left join s on s.instrument_id = i left join l on l.instrument_id = i""",
}
