"""Trading calendars: sessions with daylight saving, and targets a number of trading minutes or sessions ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.times import MINUTE

#: Labels and lengths of the horizons (fixed values): in trading minutes, and in trading sessions.
MINUTE_HORIZONS = {"5m": 5, "10m": 10, "15m": 15, "30m": 30, "60m": 60, "2h": 120, "5h": 300}
SESSION_HORIZONS = {"1d": 1, "1w": 5, "2w": 10, "1mo": 21, "2mo": 42}
POLICIES = ["PAUSE", "REJECT", "COUNT"]


def local_ns(day: Column, clock: Column | str, zone: str) -> Column:
    """The instant at which a zone's clocks show ``clock`` (HH:mm) on a day, in ns; the zone's own rules for daylight saving hold."""
    text = F.concat_ws(" ", day.cast("string"), F.lit(clock) if isinstance(clock, str) else clock)
    return F.unix_micros(F.to_utc_timestamp(F.to_timestamp(text, "yyyy-MM-dd HH:mm"), zone)) * 1000


def session_minutes(sessions: DataFrame, halts: DataFrame) -> DataFrame:
    """Every minute of every session with its place among all minutes (``n_all``), among those that aren't halted (``n_open``), and the halted ones so far.

    ``sessions``: session, open_ns, close_ns. ``halts``: session, halt_start_ns,
    halt_end_ns, half-open; several a session may overlap. A minute is named by its
    end; it is halted if a halt shares time with it. Places are counted per session
    and shifted by the sessions' totals, so only one row per session is ordered in
    one task. Returns: session, i (session's place), endpoint_ns, halted, n_all, n_open, n_halted.
    """
    m = sessions.withColumn("k", F.explode(F.expr(f"sequence(1L, greatest(1L, (close_ns - open_ns) div {MINUTE}))"))).withColumn("endpoint_ns", F.col("open_ns") + F.col("k") * MINUTE)
    m = m.where("endpoint_ns <= close_ns").select("session", "endpoint_ns")
    #: The minutes that a halt touches, by their ends counted from the session's opening.
    first = F.expr(f"greatest(0L, (halt_start_ns - open_ns) div {MINUTE})")
    last = F.expr(f"(halt_end_ns - open_ns - 1) div {MINUTE}")
    touched = halts.where("halt_end_ns > halt_start_ns").join(sessions, "session").where("halt_end_ns > open_ns and halt_start_ns < close_ns")
    touched = touched.select("session", "open_ns", F.explode(F.sequence(first, last)).alias("k")).select("session", (F.col("open_ns") + (F.col("k") + 1) * MINUTE).alias("endpoint_ns")).distinct().withColumn("halted", F.lit(True))
    m = m.join(touched, ["session", "endpoint_ns"], "left").withColumn("halted", F.coalesce("halted", F.lit(False)))
    inner = Window.partitionBy("session").orderBy("endpoint_ns").rowsBetween(Window.unboundedPreceding, 0)
    n, h = F.count(F.lit(1)).over(inner), F.count_if(F.col("halted")).over(inner)
    m = m.withColumn("a", n).withColumn("b", h)
    totals = m.groupBy("session").agg(F.count(F.lit(1)).alias("sa"), F.count_if("halted").alias("sb"))
    order = Window.orderBy("open_ns")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    offsets = sessions.join(totals, "session").select(
        "session", F.row_number().over(order).cast("long").alias("i"), F.coalesce(F.sum("sa").over(before), F.lit(0)).alias("oa"), F.coalesce(F.sum("sb").over(before), F.lit(0)).alias("ob")
    )
    j = m.join(offsets, "session")
    return j.select("session", "i", "endpoint_ns", "halted", (F.col("oa") + F.col("a")).alias("n_all"), (F.col("oa") + F.col("a") - F.col("ob") - F.col("b")).alias("n_open"), (F.col("ob") + F.col("b")).alias("n_halted"))


def horizon_targets(asof: DataFrame, sessions: DataFrame, halts: DataFrame) -> DataFrame:
    """For each as-of minute, horizon and halt policy the target instant, or why there is none.

    PAUSE passes over halted minutes (and sessions whose last minute is halted),
    COUNT counts them, REJECT gives HALT_ENCOUNTERED if one lies on the way. A
    halted as-of minute is INVALID_AS_OF_TIME unless the policy is COUNT; beyond
    the calendar is INSUFFICIENT_CALENDAR. ``asof``: as_of_ns, the end of a minute of
    a session. Targets are found by equality of places, not by walking.
    """
    m = session_minutes(sessions, halts)
    a = asof.join(m.withColumnRenamed("endpoint_ns", "as_of_ns"), "as_of_ns")
    pairs = lambda hs: F.explode(F.array(*(F.struct(F.lit(k).alias("horizon"), F.lit(v).cast("long").alias("n")) for k, v in hs.items())))
    policy = F.explode(F.array(*map(F.lit, POLICIES)))
    top = m.agg(F.max("n_halted").alias("all_halted"))

    x = a.select("*", pairs(MINUTE_HORIZONS).alias("h")).select("as_of_ns", "halted", "n_all", "n_open", "n_halted", "h.*").withColumn("policy", policy)
    x = x.withColumn("place", F.when(F.col("policy") == "PAUSE", F.col("n_open")).otherwise(F.col("n_all")) + F.col("n"))
    every = m.select(F.lit(False).alias("paused"), F.col("n_all").alias("place"), F.col("endpoint_ns").alias("target_ns"), F.col("n_halted").alias("halted_to"))
    opened = m.where("not halted").select(F.lit(True).alias("paused"), F.col("n_open").alias("place"), F.col("endpoint_ns").alias("target_ns"), F.col("n_halted").alias("halted_to"))
    x = x.withColumn("paused", F.col("policy") == "PAUSE").join(every.unionByName(opened), ["paused", "place"], "left").join(F.broadcast(top), how="cross")
    on_way = F.coalesce("halted_to", "all_halted") > F.col("n_halted")
    minutes = x.select("as_of_ns", "horizon", "policy", "halted", "target_ns", on_way.alias("on_way"))

    days = m.groupBy("session", "i").agg(F.max("endpoint_ns").alias("close_ns"), F.max_by("halted", "endpoint_ns").alias("shut"), F.max("halted").alias("any"))
    order = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumn("n_shut", F.count_if(F.col("shut")).over(order)).withColumn("n_any", F.count_if(F.col("any")).over(order))
    own = a.join(days.select("session", "n_shut", "n_any"), "session").select("as_of_ns", "halted", "i", "n_shut", "n_any", pairs(SESSION_HORIZONS).alias("h"))
    y = own.select("as_of_ns", "halted", "i", "n_shut", "n_any", "h.*").withColumn("policy", policy).withColumn("paused", F.col("policy") == "PAUSE")
    y = y.withColumn("place", F.when(F.col("paused"), F.col("i") - F.col("n_shut")).otherwise(F.col("i")) + F.col("n"))
    every = days.select(F.lit(False).alias("paused"), F.col("i").alias("place"), F.col("close_ns").alias("target_ns"), F.col("n_any").alias("any_to"))
    opened = days.where("not shut").select(F.lit(True).alias("paused"), (F.col("i") - F.col("n_shut")).alias("place"), F.col("close_ns").alias("target_ns"), F.col("n_any").alias("any_to"))
    top = days.agg(F.max("n_any").alias("all_any"))
    y = y.join(every.unionByName(opened), ["paused", "place"], "left").join(F.broadcast(top), how="cross")
    y = y.select("as_of_ns", "horizon", "policy", "halted", "target_ns", (F.coalesce("any_to", "all_any") > F.col("n_any")).alias("on_way"))

    state = (
        F.when(F.col("halted") & (F.col("policy") != "COUNT"), "INVALID_AS_OF_TIME")
        .when((F.col("policy") == "REJECT") & F.col("on_way"), "HALT_ENCOUNTERED")
        .when(F.col("target_ns").isNull(), "INSUFFICIENT_CALENDAR")
        .otherwise("OK")
    )
    return minutes.unionByName(y).withColumn("state", state).select("as_of_ns", "horizon", "policy", "state", F.when(F.col("state") == "OK", F.col("target_ns")).alias("target_ns"))
