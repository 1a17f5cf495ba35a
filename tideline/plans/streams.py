"""Queries on the event stream: time windows, gaps, folds, books."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions.ints import isqrt, mul_div, trunc_div, wide, wide_div
from tideline.functions.hashing import sampled_every
from tideline.operators import books as BOOKS
from tideline.operators import folds
from tideline.operators.ranking import BUCKET_ROWS, bucket_bounds, running_total
from tideline.operators.temporal import forward_asof, sequence_state
from tideline.operators.temporal import missing_ranges as ranges_missing
from tideline.session import table

MICRO_HOUR = 3_600_000_000
SPAN = 24 * MICRO_HOUR


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        "event_id",
        "user_id",
        "event_type",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t"),
        F.round(F.col("value") * 100).cast("long").alias("ticks"),
        F.get_json_object("props", "$.k").cast("long").alias("qty"),
        F.to_date("ts").alias("day"),
    )


def _user() -> Window:
    return Window.partitionBy("user_id").orderBy("t")


def event_ohlc_daily(spark: SparkSession, d: str) -> DataFrame:
    """Daily open, high, low, close of each user and the return on the observed day before."""
    from tideline.functions.ints import return_ppm

    g = _events(spark, d).groupBy("user_id", "day").agg(
        F.min_by("ticks", "t").alias("open"), F.max("ticks").alias("high"), F.min("ticks").alias("low"), F.max_by("ticks", "t").alias("close"), F.sum("qty").alias("volume"), F.count(F.lit(1)).alias("n")
    )
    w = Window.partitionBy("user_id").orderBy("day")
    return g.withColumn("return_ppm", return_ppm("close", F.lag("close").over(w))).withColumn("day", F.col("day").cast("string"))


def event_rates_window(spark: SparkSession, d: str) -> DataFrame:
    """Count, quantity and rate over the last 24 hours, lower bound inclusive; the rate's span is that of the rows kept, plus one."""
    w = _user().rangeBetween(-SPAN, 0)
    e = _events(spark, d).select("event_id", F.count(F.lit(1)).over(w).alias("n"), F.sum("qty").over(w).alias("q"), (F.col("t") - F.min("t").over(w) + 1).alias("span"))
    return e.select("event_id", "n", "q", mul_div("n", 1_000_000_000, "span").alias("rate_mhz"))


def event_vwap_window(spark: SparkSession, d: str) -> DataFrame:
    """Volume-weighted price of the day so far, in ppm beyond the day's first price."""
    w = Window.partitionBy("user_id", "day").orderBy("t")
    e = _events(spark, d).withColumn("anchor", F.first("ticks").over(w))
    num, den = F.sum(wide(F.col("ticks") - F.col("anchor")) * wide("qty")).over(w), F.sum("qty").over(w)
    return e.withColumn("num", num).withColumn("den", den).select("event_id", "anchor", trunc_div(wide("num") * 1_000_000, "den").alias("beyond_ppm"))


def event_return_volatility(spark: SparkSession, d: str) -> DataFrame:
    """Root mean square of returns kept in the last 24 hours; a return whose predecessor is older counts as zero."""
    lag_t, lag_x = F.lag("t").over(_user()), F.lag("ticks").over(_user())
    e = _events(spark, d).withColumn("pt", lag_t).withColumn("px", lag_x)
    r = F.when((F.col("pt") >= F.col("t") - SPAN) & (F.col("px") > 0), mul_div(F.col("ticks") - F.col("px"), 1_000_000, "px")).otherwise(F.lit(0).cast("long"))
    e = e.withColumn("r", F.coalesce(r, F.lit(0)))
    w = _user().rangeBetween(-SPAN, 0)
    e = e.withColumn("s", F.sum(wide("r") * wide("r")).over(w)).withColumn("n", F.count(F.lit(1)).over(w))
    return e.select("event_id", "r", isqrt(wide_div("s", "n")).alias("volatility_ppm"))


def event_flow_imbalance(spark: SparkSession, d: str) -> DataFrame:
    """Order-flow imbalance between one row's top of book and the next; bid = ticks, ask = ticks + quantity."""
    w = _user()
    e = _events(spark, d).withColumn("ask", F.col("ticks") + F.col("qty")).withColumn("aq", F.col("qty") + 1)
    pb, pq, pa, paq = (F.lag(c).over(w) for c in ("ticks", "qty", "ask", "aq"))
    e = e.withColumn("pb", pb).withColumn("pq", pq).withColumn("pa", pa).withColumn("paq", paq)
    part = lambda cond, x: F.when(cond, x).otherwise(0)
    ofi = part(F.col("ticks") >= F.col("pb"), F.col("qty")) - part(F.col("ticks") <= F.col("pb"), F.col("pq")) - part(F.col("ask") <= F.col("pa"), F.col("aq")) + part(F.col("ask") >= F.col("pa"), F.col("paq"))
    return e.select("event_id", F.when(F.col("pb").isNotNull(), ofi).alias("ofi"))


def consolidated_top(spark: SparkSession, d: str) -> DataFrame:
    """Best bid over venues per hour, quantity summed at the best, leader = lowest venue there; asks likewise."""
    e = _events(spark, d).withColumn("hour", F.expr(f"t div {MICRO_HOUR}"))
    venue = F.pmod("user_id", F.lit(7))
    b = e.where("event_type in ('view', 'signup')").groupBy("hour", "ticks").agg(F.sum("qty").alias("q"), F.min(venue).alias("leader"))
    a = e.where("event_type in ('click', 'purchase')").groupBy("hour", "ticks").agg(F.sum("qty").alias("q"), F.min(venue).alias("leader"))
    bid = b.groupBy("hour").agg(F.max_by(F.struct("ticks", "q", "leader"), "ticks").alias("x")).select("hour", F.col("x.ticks").alias("bid"), F.col("x.q").alias("bid_qty"), F.col("x.leader").alias("bid_leader"))
    ask = a.groupBy("hour").agg(F.min_by(F.struct("ticks", "q", "leader"), "ticks").alias("x")).select("hour", F.col("x.ticks").alias("ask"), F.col("x.q").alias("ask_qty"), F.col("x.leader").alias("ask_leader"))
    j = bid.join(ask, "hour", "full")
    return j.withColumn("imbalance_ppm", mul_div(F.col("bid_qty") - F.col("ask_qty"), 1_000_000, F.col("bid_qty") + F.col("ask_qty")))


def consolidated_depth(spark: SparkSession, d: str) -> DataFrame:
    """Quantity by price over venues, the three best levels of each side and day."""
    e = _events(spark, d).withColumn("side", F.when(F.col("event_type").isin("view", "signup"), "B").otherwise("A"))
    g = e.groupBy("day", "side", "ticks").agg(F.sum("qty").alias("qty"), F.count(F.lit(1)).alias("orders"))
    w = Window.partitionBy("day", "side").orderBy(F.when(F.col("side") == "B", -F.col("ticks")).otherwise(F.col("ticks")))
    return g.withColumn("level", F.row_number().over(w)).where("level <= 3").withColumn("day", F.col("day").cast("string"))


def book_levels(spark: SparkSession, d: str) -> DataFrame:
    """State of a price-level book: the last update of each level; quantity 0 deletes it."""
    e = _events(spark, d).withColumn("price", F.expr("ticks div 100"))
    g = e.groupBy("event_type", "price").agg(F.max_by("qty", "event_id").alias("qty"), F.max("event_id").alias("last_id"))
    return g.where("qty > 0")


def depth_validity(spark: SparkSession, d: str) -> DataFrame:
    """Depth images per hour as arrays, checked for order and positive sizes with array functions."""
    e = _events(spark, d).withColumn("hour", F.expr(f"t div {MICRO_HOUR}"))
    g = e.groupBy("hour").agg(F.array_sort(F.collect_set(F.struct("ticks", "qty"))).alias("levels"))
    px = F.transform("levels", lambda x: x.ticks)
    ordered = F.forall(F.zip_with(F.slice(px, 1, F.size(px) - 1), F.slice(px, 2, F.size(px)), lambda a, b: a < b), lambda x: F.coalesce(x, F.lit(True)))
    positive = F.forall("levels", lambda x: x.qty > 0)
    weighted = F.aggregate(F.transform("levels", lambda x, i: x.qty * (F.size("levels") - i)), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return g.select("hour", F.size("levels").alias("n"), ordered.alias("ordered"), positive.alias("positive"), weighted.alias("weighted_depth"))


def sequence_gaps(spark: SparkSession, d: str) -> DataFrame:
    """A feed that lost every 7th row and delivers every 11th late: state of each arrival."""
    e = _events(spark, d).where("event_id % 7 <> 3").withColumn("arrival", F.col("event_id") + F.when(F.col("event_id") % 11 == 0, 5).otherwise(0)).withColumn("channel", F.lit(0)).select("channel", "arrival", "event_id")
    return sequence_state(e, ["channel"], ["arrival", "event_id"], "event_id").groupBy("sequence_state").agg(F.count(F.lit(1)).alias("n"), F.sum("missing").alias("missing"))


def missing_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The ranges of sequence numbers that never came in each of four channels."""
    e = _events(spark, d).where("event_id % 7 <> 3").select((F.col("event_id") % 4).alias("channel"), F.expr("event_id div 4").alias("sequence"))
    return ranges_missing(e, ["channel"], "sequence")


def feed_arbitration(spark: SparkSession, d: str) -> DataFrame:
    """Two redundant feeds merged by sequence number: who delivered, and whether their contents agree."""
    e = _events(spark, d)
    a = e.where("event_id % 5 <> 0").select("event_id", "ticks", F.lit("A").alias("feed"))
    b = e.where("event_id % 7 <> 0").select("event_id", (F.col("ticks") + F.when(F.col("event_id") % 101 == 0, 1).otherwise(0)).alias("ticks"), F.lit("B").alias("feed"))
    g = a.unionByName(b).groupBy("event_id").agg(F.min_by("ticks", "feed").alias("ticks"), F.array_join(F.array_sort(F.collect_set("feed")), "").alias("feeds"), (F.countDistinct("ticks") > 1).alias("conflict"))
    return g


def poison_until_reset(spark: SparkSession, d: str) -> DataFrame:
    """Rows between an error and the next signup of their user are invalid."""
    w = _user().rowsBetween(Window.unboundedPreceding, 0)
    e = _events(spark, d).withColumn("epoch", F.sum(F.when(F.col("event_type") == "signup", 1).otherwise(0)).over(w))
    p = Window.partitionBy("user_id", "epoch").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return e.select("event_id", F.max(F.when(F.col("event_type") == "error", 1).otherwise(0)).over(p).alias("poisoned"))


def replenishment(spark: SparkSession, d: str) -> DataFrame:
    """Signups that follow, within 12 hours, the user's last error at the same coarse price."""
    e = _events(spark, d).withColumn("level", F.expr("ticks div 1000"))
    w = Window.partitionBy("user_id", "level").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("event_type") == "error", F.col("t")), ignorenulls=True).over(w)
    return e.withColumn("depleted", last).where("event_type = 'signup'").select("event_id", F.coalesce(F.col("t") - F.col("depleted") <= 12 * MICRO_HOUR, F.lit(False)).alias("replenished"))


def stale_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Silences of a user beyond two days."""
    e = _events(spark, d).withColumn("next_t", F.lead("t").over(_user()))
    return e.where(F.col("next_t") - F.col("t") > 2 * SPAN).select("user_id", F.col("t").alias("from_us"), F.col("next_t").alias("to_us"))


def gap_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a user separated by six idle hours."""
    new = F.when(F.col("t") - F.lag("t").over(_user()) <= 6 * MICRO_HOUR, 0).otherwise(1)
    e = _events(spark, d).withColumn("new", new)
    s = e.withColumn("session", F.sum("new").over(_user().rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("user_id", "session").agg(F.min("t").alias("start_us"), F.max("t").alias("end_us"), F.count(F.lit(1)).alias("n"), F.sum("ticks").alias("ticks"))


def tumbling_hopping(spark: SparkSession, d: str) -> DataFrame:
    """Counts over windows of one day that advance by six hours."""
    e = table(spark, d, "events")
    return e.groupBy(F.window("ts", "1 day", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.unix_micros(F.col("w.start").cast("timestamp")).alias("start_us"), "event_type", "n", "total")


def capped_window(spark: SparkSession, d: str) -> DataFrame:
    """The last 24 hours but at most eight rows; DEGRADED where the cap cut rows off."""
    w, r = _user().rangeBetween(-SPAN, 0), _user().rowsBetween(-7, 0)
    e = _events(spark, d)
    return e.select("event_id", F.least(F.count(F.lit(1)).over(w), F.lit(8)).alias("n"), F.sum("qty").over(r).alias("ring_qty"), F.when(F.count(F.lit(1)).over(w) > 8, "DEGRADED").otherwise("OK").alias("state"))


def equity_drawdown(spark: SparkSession, d: str) -> DataFrame:
    """Running equity of each user, its peak so far and the drawdown."""
    signed = F.when(F.col("event_type") == "error", -F.col("ticks")).otherwise(F.col("ticks"))
    w = _user().rowsBetween(Window.unboundedPreceding, 0)
    e = _events(spark, d).withColumn("equity", F.sum(signed).over(w))
    e = e.withColumn("peak", F.max("equity").over(w))
    return e.select("event_id", "equity", "peak", (F.col("peak") - F.col("equity")).alias("drawdown"))


def horizon_forward(spark: SparkSession, d: str) -> DataFrame:
    """First price of the user at least a day later."""
    return forward_asof(_events(spark, d), ["user_id"], "t", "ticks", SPAN, "future_ticks").select("event_id", "future_ticks")


def baseline_forecasts(spark: SparkSession, d: str) -> DataFrame:
    """Last value, moving average of four, weighted 4-3-2-1, mean difference, and the last value in the same hour of the day."""
    w = _user()
    lag = lambda k: F.lag("ticks", k).over(w)
    e = _events(spark, d)
    four = sum((lag(k) for k in (2, 3, 4)), lag(1))
    weighted = lag(1) * 4 + lag(2) * 3 + lag(3) * 2 + lag(4)
    seasonal = F.lag("ticks").over(Window.partitionBy("user_id", F.expr(f"t div {MICRO_HOUR} % 24")).orderBy("t"))
    return e.select(
        "event_id",
        lag(1).alias("last"),
        trunc_div(four, 4).alias("mean4"),
        trunc_div(weighted, 10).alias("weighted"),
        (lag(1) + trunc_div(lag(1) - lag(4), 3)).alias("drift"),
        seasonal.alias("seasonal"),
    )


def walk_forward_errors(spark: SparkSession, d: str) -> DataFrame:
    """Floored mean absolute error and root mean square error of two baselines over all users."""
    f = _events(spark, d).select("event_id", "ticks").join(baseline_forecasts(spark, d).where("mean4 is not null"), "event_id")
    e = f.select(F.inline(F.array(F.struct(F.lit("last").alias("baseline"), (F.col("ticks") - F.col("last")).alias("e")), F.struct(F.lit("mean4").alias("baseline"), (F.col("ticks") - F.col("mean4")).alias("e")))))
    g = e.groupBy("baseline").agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs("e")).alias("a"), F.sum(F.col("e") * F.col("e")).alias("q"))
    return g.select("baseline", "n", trunc_div("a", "n").alias("mae"), isqrt(trunc_div("q", "n")).alias("rmse"))


def replay_faults(spark: SparkSession, d: str) -> DataFrame:
    """The stream with every 10th row dropped, every 13th doubled, neighbours of every 17th swapped, and the clock drifting."""
    e = _events(spark, d).where(~sampled_every("event_id", 10, 3))
    e = e.withColumn("copies", F.when(sampled_every("event_id", 13, 5), 2).otherwise(1)).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    swapped = F.when(F.col("event_id") % 17 == 0, F.col("event_id") + 1).when(F.col("event_id") % 17 == 1, F.col("event_id") - 1).otherwise(F.col("event_id"))
    delay = F.lit(250) + trunc_div((F.col("t") - F.lit(1_704_067_200_000_000)) * 40, 1_000_000)
    return e.select("event_id", "copy", swapped.alias("ordinal"), (F.col("t") + delay).alias("delivered_us"))


def queue_allocation(spark: SparkSession, d: str) -> DataFrame:
    """A day's purchases fill its views in the order of price, then time: greedy by running sums."""
    e = _events(spark, d)
    supply = e.where("event_type = 'purchase'").groupBy("day").agg(F.sum("qty").alias("supply"))
    o = e.where("event_type = 'view'").select("day", "event_id", "t", "qty", (-F.col("ticks")).alias("rank"))
    o = running_total(o, ["day"], "rank", "upto", bucket_bounds(o, ["day"], "rank", BUCKET_ROWS), weight=F.col("qty"), ties=["t", "event_id"]).withColumn("before", F.col("upto") - F.col("qty"))
    return o.join(supply, "day", "left").select("event_id", F.greatest(F.lit(0).cast("long"), F.least(F.col("qty"), F.coalesce("supply", F.lit(0)) - F.col("before"))).alias("filled"))


def contradictions(spark: SparkSession, d: str) -> DataFrame:
    """Facts that differ from the latest earlier fact of the same user and kind."""
    w = Window.partitionBy("user_id", "event_type").orderBy("t")
    e = _events(spark, d).withColumn("before", F.lag("qty").over(w))
    return e.where("before is not null and before <> qty").select("event_id", F.col("before").alias("earlier"), F.col("qty").alias("later"))


def cache_latest(spark: SparkSession, d: str) -> DataFrame:
    """Latest row per user and kind as of the last event of all, a miss if older than three days."""
    e = _events(spark, d)
    now = e.agg(F.max("t").alias("now"))
    g = e.groupBy("user_id", "event_type").agg(F.max("t").alias("t"), F.max_by("ticks", "t").alias("ticks")).join(F.broadcast(now), how="cross")
    return g.select("user_id", "event_type", F.when(F.col("now") - F.col("t") <= 3 * SPAN, F.col("ticks")).alias("hit_ticks"))


def first_wins(spark: SparkSession, d: str) -> DataFrame:
    """The first event of each user and kind; the others are duplicates."""
    g = _events(spark, d).groupBy("user_id", "event_type").agg(F.min_by("event_id", "t").alias("first_id"), (F.count(F.lit(1)) - 1).alias("duplicates"))
    return g


def ema_fold(spark: SparkSession, d: str) -> DataFrame:
    return folds.ordered_fold(_events(spark, d), ["user_id"], ["t", "event_id"], lambda: None, folds.ema_step(1, 8), ["event_id", "ticks"], "event_id long, mean long, variance long")


def rate_limit_admit(spark: SparkSession, d: str) -> DataFrame:
    return folds.ordered_fold(_events(spark, d), ["user_id"], ["t", "event_id"], lambda: None, folds.admit_step(3, SPAN), ["event_id", "t"], "event_id long, admitted boolean")


def average_cost_fold(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).where("event_type in ('purchase', 'error') and qty > 0").withColumn("signed", F.when(F.col("event_type") == "purchase", F.col("qty")).otherwise(-F.col("qty"))).withColumn("notional", F.col("ticks") * F.col("qty")).withColumn("fee", F.lit(1))
    return folds.ordered_fold(e, ["user_id"], ["t", "event_id"], lambda: None, folds.average_cost_step, ["event_id", "signed", "notional", "fee"], "event_id long, position long, cost long, realised long")


def order_book_fold(spark: SparkSession, d: str) -> DataFrame:
    """All operations of a book on each user's events: adds, and operations on the order before, on levels, on the market's state, snapshots and restores."""
    k = F.col("event_id") % 40
    other = F.element_at(F.array(*map(F.lit, [*BOOKS.ORDER_OPS[1:], *BOOKS.LEVEL_OPS, *BOOKS.CONTROL_OPS, *BOOKS.STATE_OPS])), (k - 23).cast("int"))
    op = F.when(k < 24, "ADD").otherwise(other)
    before = F.lag("event_id").over(_user())
    side = F.when(F.col("event_id") % 2 == 0, "B").otherwise("A")
    price = F.when(side == "B", F.col("ticks") % 50 + 1).otherwise(F.col("ticks") % 50 + 52)
    e = _events(spark, d).withColumn("op", op).withColumn("order_id", F.when(op == "ADD", F.col("event_id")).otherwise(F.coalesce(before, F.lit(0)))).withColumn("side", side).withColumn("price", price)
    e = e.withColumn("quantity", F.when(op.startswith("PARTIAL_"), 1).otherwise(F.col("qty") + 1).cast("long"))
    return folds.ordered_fold(e, ["user_id"], ["t", "event_id"], lambda: None, BOOKS.book_step, ["event_id", "op", "order_id", "side", "price", "quantity"], BOOKS.BOOK_OUT)


def hysteresis_fold(spark: SparkSession, d: str) -> DataFrame:
    return folds.ordered_fold(_events(spark, d), ["user_id"], ["t", "event_id"], lambda: None, folds.hysteresis_step(2_000, 500, MICRO_HOUR), ["event_id", "t", "ticks"], "event_id long, state string")


QUERIES = {
    f.__name__: f
    for f in (
        event_ohlc_daily,
        event_rates_window,
        event_vwap_window,
        event_return_volatility,
        event_flow_imbalance,
        consolidated_top,
        consolidated_depth,
        book_levels,
        depth_validity,
        sequence_gaps,
        missing_ranges,
        feed_arbitration,
        poison_until_reset,
        replenishment,
        stale_gaps,
        gap_sessions,
        tumbling_hopping,
        capped_window,
        equity_drawdown,
        horizon_forward,
        baseline_forecasts,
        walk_forward_errors,
        replay_faults,
        queue_allocation,
        contradictions,
        cache_latest,
        first_wins,
        ema_fold,
        rate_limit_admit,
        average_cost_fold,
        order_book_fold,
        hysteresis_fold,
    )
}

E = "with e as (select event_id, user_id, event_type, epoch_us(ts) as t, cast(round(value * 100) as bigint) as ticks, cast(json_extract(props, '$.k') as bigint) as qty, cast(ts as date) as day, value, ts from events)\n"
U = "partition by user_id order by t"
R24 = f"range between {SPAN} preceding and current row"

SQL = {
    "event_ohlc_daily": E
    + """, g as (select user_id, day, arg_min(ticks, t) as open, max(ticks) as high, min(ticks) as low, arg_max(ticks, t) as close, cast(sum(qty) as bigint) as volume, count(*) as n from e group by 1, 2),
p as (select *, lag(close) over (partition by user_id order by day) as pc from g)
select user_id, cast(day as varchar) as day, open, high, low, close, volume, n, case when pc = 0 then null else case when close < pc then -1 else 1 end * ((abs(close - pc) * 1000000 * 2 + pc) // (2 * pc)) end as return_ppm from p""",
    "event_rates_window": E
    + f", w as (select event_id, count(*) over x as n, cast(sum(qty) over x as bigint) as q, t - min(t) over x + 1 as span from e window x as ({U} {R24})) select event_id, n, q, n * 1000000000 // span as rate_mhz from w",
    "event_vwap_window": E
    + """, a as (select *, first(ticks) over (partition by user_id, day order by t) as anchor from e),
s as (select event_id, anchor, sum((ticks - anchor) * qty) over w as num, sum(qty) over w as den from a window w as (partition by user_id, day order by t))
select event_id, anchor, cast(case when den <> 0 then num * 1000000 // den end as bigint) as beyond_ppm from s""",
    "event_return_volatility": E
    + f""", p as (select *, lag(t) over ({U}) as pt, lag(ticks) over ({U}) as px from e), r as (select *, case when pt >= t - {SPAN} and px > 0 then (ticks - px) * 1000000 // px else 0 end as r from p),
s as (select event_id, r, sum(cast(r as hugeint) * r) over w // count(*) over w as ms from r window w as ({U} {R24})) select event_id, r, cast(floor(sqrt(ms)) as bigint) as volatility_ppm from s""",
    "event_flow_imbalance": E
    + f""", x as (select *, ticks + qty as ask, qty + 1 as aq from e), p as (select *, lag(ticks) over w as pb, lag(qty) over w as pq, lag(ask) over w as pa, lag(aq) over w as paq from x window w as ({U}))
select event_id, case when pb is not null then (case when ticks >= pb then qty else 0 end) - (case when ticks <= pb then pq else 0 end) - (case when ask <= pa then aq else 0 end) + (case when ask >= pa then paq else 0 end) end as ofi from p""",
    "consolidated_top": E
    + f""", h as (select *, t // {MICRO_HOUR} as hour from e),
b as (select hour, ticks, sum(qty) as q, min(user_id % 7) as l from h where event_type in ('view', 'signup') group by 1, 2 qualify row_number() over (partition by hour order by ticks desc) = 1),
a as (select hour, ticks, sum(qty) as q, min(user_id % 7) as l from h where event_type in ('click', 'purchase') group by 1, 2 qualify row_number() over (partition by hour order by ticks) = 1)
select hour, b.ticks as bid, cast(b.q as bigint) as bid_qty, b.l as bid_leader, a.ticks as ask, cast(a.q as bigint) as ask_qty, a.l as ask_leader,
  cast(case when b.q + a.q <> 0 then (b.q - a.q) * 1000000 // (b.q + a.q) end as bigint) as imbalance_ppm from b full join a using (hour)""",
    "consolidated_depth": E
    + """, g as (select day, case when event_type in ('view', 'signup') then 'B' else 'A' end as side, ticks, cast(sum(qty) as bigint) as qty, count(*) as orders from e group by 1, 2, 3)
select cast(day as varchar) as day, side, ticks, qty, orders, cast(level as integer) as level from (select *, row_number() over (partition by day, side order by case when side = 'B' then -ticks else ticks end) as level from g) where level <= 3""",
    "book_levels": E + "select * from (select event_type, ticks // 100 as price, arg_max(qty, event_id) as qty, max(event_id) as last_id from e group by 1, 2) where qty > 0",
    "depth_validity": E
    + f""", h as (select distinct t // {MICRO_HOUR} as hour, ticks, qty from e), o as (select *, row_number() over (partition by hour order by ticks, qty) as i, count(*) over (partition by hour) as n, lag(ticks) over (partition by hour order by ticks, qty) as p from h)
select hour, cast(max(n) as integer) as n, bool_and(p is null or p < ticks) as ordered, bool_and(qty > 0) as positive, cast(sum(qty * (n - i + 1)) as bigint) as weighted_depth from o group by 1""",
    "sequence_gaps": E
    + """, a as (select event_id as s, event_id + case when event_id % 11 = 0 then 5 else 0 end as arrival from e where event_id % 7 <> 3),
x as (select s, max(s) over (order by arrival, s rows between unbounded preceding and 1 preceding) as top from a)
select case when top is null then 'FIRST' when s = top + 1 then 'NEXT' when s > top + 1 then 'GAP' when s = top then 'DUPLICATE' else 'OUT_OF_ORDER' end as sequence_state, count(*) as n, cast(sum(case when s > top + 1 then s - top - 1 else 0 end) as bigint) as missing from x group by 1""",
    "missing_ranges": E
    + "select channel, s + 1 as first_missing, n - 1 as last_missing from (select event_id % 4 as channel, event_id // 4 as s, lead(event_id // 4) over (partition by event_id % 4 order by event_id) as n from e where event_id % 7 <> 3) where n > s + 1",
    "feed_arbitration": E
    + """, u as (select event_id, ticks, 'A' as feed from e where event_id % 5 <> 0 union all select event_id, ticks + case when event_id % 101 = 0 then 1 else 0 end, 'B' from e where event_id % 7 <> 0)
select event_id, arg_min(ticks, feed) as ticks, string_agg(feed, '' order by feed) as feeds, count(distinct ticks) > 1 as conflict from u group by 1""",
    "poison_until_reset": E
    + f""", p as (select *, sum(case when event_type = 'signup' then 1 else 0 end) over ({U} rows between unbounded preceding and current row) as epoch from e)
select event_id, max(case when event_type = 'error' then 1 else 0 end) over (partition by user_id, epoch order by t rows between unbounded preceding and current row) as poisoned from p""",
    "replenishment": E
    + f""", p as (select *, last(case when event_type = 'error' then t end ignore nulls) over (partition by user_id, ticks // 1000 order by t rows between unbounded preceding and 1 preceding) as dep from e)
select event_id, coalesce(t - dep <= {12 * MICRO_HOUR}, false) as replenished from p where event_type = 'signup'""",
    "stale_gaps": E + f"select user_id, t as from_us, n as to_us from (select *, lead(t) over ({U}) as n from e) where n - t > {2 * SPAN}",
    "gap_sessions": E
    + f""", s as (select *, sum(n) over ({U} rows between unbounded preceding and current row) as session from (select *, case when t - lag(t) over ({U}) <= {6 * MICRO_HOUR} then 0 else 1 end as n from e))
select user_id, cast(session as bigint) as session, min(t) as start_us, max(t) as end_us, count(*) as n, cast(sum(ticks) as bigint) as ticks from s group by 1, 2""",
    "tumbling_hopping": E
    + f""", w as (select event_type, value, unnest([t // {6 * MICRO_HOUR} * {6 * MICRO_HOUR} - k * {6 * MICRO_HOUR} for k in [0, 1, 2, 3]]) as start_us from e)
select start_us, event_type, count(*) as n, round(sum(value), 4) as total from w group by 1, 2""",
    "capped_window": E
    + f"select event_id, least(count(*) over w, 8) as n, cast(sum(qty) over ({U} rows between 7 preceding and current row) as bigint) as ring_qty, case when count(*) over w > 8 then 'DEGRADED' else 'OK' end as state from e window w as ({U} {R24})",
    "equity_drawdown": E
    + f", q as (select *, sum(case when event_type = 'error' then -ticks else ticks end) over ({U} rows between unbounded preceding and current row) as equity from e), p as (select *, max(equity) over ({U} rows between unbounded preceding and current row) as peak from q) select event_id, cast(equity as bigint) as equity, cast(peak as bigint) as peak, cast(peak - equity as bigint) as drawdown from p",
    "horizon_forward": E + f"select event_id, first(ticks) over ({U} range between {SPAN} following and unbounded following) as future_ticks from e",
    "baseline_forecasts": E
    + f"""select event_id, l1 as last, (l1 + l2 + l3 + l4) // 4 as mean4, (4 * l1 + 3 * l2 + 2 * l3 + l4) // 10 as weighted, l1 + (l1 - l4) // 3 as drift, seasonal from (select event_id, lag(ticks, 1) over w as l1, lag(ticks, 2) over w as l2, lag(ticks, 3) over w as l3, lag(ticks, 4) over w as l4,
  lag(ticks) over (partition by user_id, t // {MICRO_HOUR} % 24 order by t) as seasonal from e window w as ({U}))""",
    "walk_forward_errors": E
    + f""", f as (select ticks, lag(ticks, 1) over w as l1, (lag(ticks, 1) over w + lag(ticks, 2) over w + lag(ticks, 3) over w + lag(ticks, 4) over w) // 4 as m4 from e window w as ({U})),
x as (select 'last' as baseline, ticks - l1 as e from f where m4 is not null union all select 'mean4', ticks - m4 from f where m4 is not null)
select baseline, count(*) as n, cast(sum(abs(e)) // count(*) as bigint) as mae, cast(floor(sqrt(sum(e * e) // count(*))) as bigint) as rmse from x group by 1""",
    "replay_faults": E
    + """, k as (select *, unnest(case when (event_id + 5) % 13 = 0 then [1, 2] else [1] end) as copy from e where (event_id + 3) % 10 <> 0)
select event_id, copy, case when event_id % 17 = 0 then event_id + 1 when event_id % 17 = 1 then event_id - 1 else event_id end as ordinal, t + 250 + (t - 1704067200000000) * 40 // 1000000 as delivered_us from k""",
    "queue_allocation": E
    + """, s as (select day, sum(qty) as supply from e where event_type = 'purchase' group by 1),
o as (select *, coalesce(sum(qty) over (partition by day order by ticks desc, t, event_id rows between unbounded preceding and 1 preceding), 0) as b from e where event_type = 'view')
select event_id, cast(greatest(0, least(qty, coalesce(supply, 0) - b)) as bigint) as filled from o left join s using (day)""",
    "contradictions": E + "select event_id, b as earlier, qty as later from (select *, lag(qty) over (partition by user_id, event_type order by t) as b from e) where b is not null and b <> qty",
    "cache_latest": E + f"select user_id, event_type, case when (select max(t) from e) - max(t) <= {3 * SPAN} then arg_max(ticks, t) end as hit_ticks from e group by 1, 2",
    "first_wins": E + "select user_id, event_type, arg_min(event_id, t) as first_id, count(*) - 1 as duplicates from e group by 1, 2",
}

_REC = E.replace("with e as", "with recursive e as", 1)
_O = "o as (select *, row_number() over (partition by user_id order by t, event_id) as i from {})"


def _tz(a: str, b: int) -> str:
    """Quotient toward zero."""
    return f"(sign({a}) * (abs({a}) // {b}))"


_SIGNED = "f as (select *, case when event_type = 'purchase' then qty else -qty end as q, ticks * qty as notional from e where event_type in ('purchase', 'error') and qty > 0)"
_CLOSING, _ALLOC = "least(abs(o.q), abs(k.position))", "(abs(k.cost) * least(abs(o.q), abs(k.position)) // greatest(1, abs(k.position)))"
_PROC = "(o.notional * least(abs(o.q), abs(k.position)) // abs(o.q))"
_SAME = "(k.position = 0 or (k.position > 0) = (o.q > 0))"
#: The folds as recursive SQL, row by row of each user.
SQL |= {
    "ema_fold": _REC
    + ", "
    + _O.format("e")
    + f""", k as (select user_id, i, event_id, cast(ticks as bigint) as mean, cast(0 as bigint) as variance from o where i = 1 union all
  select o.user_id, o.i, o.event_id, cast(k.mean + {_tz('(o.ticks - k.mean)', 8)} as bigint), cast({_tz('(7 * (k.variance + ' + _tz('((o.ticks - k.mean) * (o.ticks - k.mean))', 8) + '))', 8)} as bigint) from k join o on o.user_id = k.user_id and o.i = k.i + 1)
select user_id, event_id, mean, variance from k""",
    "rate_limit_admit": _REC
    + ", "
    + _O.format("e")
    + f""", k as (select user_id, i, event_id, true as admitted, [t] as kept from o where i = 1 union all
  select o.user_id, o.i, o.event_id, len(list_filter(k.kept, lambda x: o.t - x < {SPAN})) < 3, case when len(list_filter(k.kept, lambda x: o.t - x < {SPAN})) < 3 then list_append(list_filter(k.kept, lambda x: o.t - x < {SPAN}), o.t) else list_filter(k.kept, lambda x: o.t - x < {SPAN}) end
  from k join o on o.user_id = k.user_id and o.i = k.i + 1)
select user_id, event_id, admitted from k""",
    "hysteresis_fold": _REC
    + ", "
    + _O.format("e")
    + f""", w as (select *, case when ticks > 2000 then 'HIGH' when ticks < 500 then 'LOW' end as want from o),
k as (select user_id, i, event_id, coalesce(want, 'LOW') as state, case when want = 'HIGH' then t end as since from w where i = 1 union all
  select w.user_id, w.i, w.event_id, case when coalesce(want, state) <> state and (since is null or w.t - since >= {MICRO_HOUR}) then want else state end, case when coalesce(want, state) <> state and (since is null or w.t - since >= {MICRO_HOUR}) then w.t else since end
  from k join w on w.user_id = k.user_id and w.i = k.i + 1)
select user_id, event_id, state from k""",
    "average_cost_fold": _REC
    + f", {_SIGNED}, "
    + _O.format("f")
    + f""", k as (select user_id, i, event_id, q as position, case when q > 0 then notional else -notional end as cost, cast(-1 as bigint) as realised from o where i = 1 union all
  select o.user_id, o.i, o.event_id, k.position + o.q,
    case when {_SAME} then k.cost + case when o.q > 0 then o.notional else -o.notional end
      when abs(o.q) > {_CLOSING} then case when o.q > 0 then o.notional - {_PROC} else -(o.notional - {_PROC}) end
      when k.position + o.q = 0 then 0 when k.position > 0 then k.cost - {_ALLOC} else k.cost + {_ALLOC} end,
    cast(k.realised - 1 + case when {_SAME} then 0 when k.position > 0 then {_PROC} - {_ALLOC} else {_ALLOC} - {_PROC} end as bigint)
  from k join o on o.user_id = k.user_id and o.i = k.i + 1)
select user_id, event_id, position, cost, realised from k""",
}
