"""Aggregations, scores, exposures and set queries over the order tables and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions.hashing import economic_hash, hash_bucket, hash_chain, sequence_hash
from tideline.functions.ints import SIGMOID_PPM, floor_div, half_away_div, half_even_div, isqrt, micro_units, mul_div, sigmoid_ppm, step_lookup, trunc_div, wide, wide_div
from tideline.operators.ranking import BUCKET_ROWS, bucket_bounds, running_total
from tideline.operators.quantiles import cume_share, lower_rank
from tideline.session import table


def _fills(spark: SparkSession, d: str) -> DataFrame:
    """Line items as fills: quantity, price in cents, side by return flag."""
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("venue_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_quantity").cast("long").alias("qty"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("notional"),
        F.round(F.col("l_discount") * 1_000_000).cast("long").alias("discount_ppm"),
        F.round(F.col("l_tax") * 1_000_000).cast("long").alias("fee_ppm"),
        F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("sign"),
        F.col("l_linestatus").alias("status"),
        F.to_date("l_shipdate").alias("day"),
    )


def _positions(spark: SparkSession, d: str) -> DataFrame:
    f = _fills(spark, d)
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("account"), F.col("o_orderpriority").alias("strategy"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("part_id"), F.col("p_brand").alias("sector"))
    return f.join(o, "order_id").join(p, "part_id")


def exposures(spark: SparkSession, d: str) -> DataFrame:
    """Gross and net notional by account segment, strategy, sector and in all, in one pass of grouping sets."""
    x = _positions(spark, d).join(table(spark, d, "customer").select(F.col("c_custkey").alias("account"), F.col("c_mktsegment").alias("segment")), "account")
    g = x.groupingSets([[F.col("segment")], [F.col("strategy")], [F.col("sector")], []], "segment", "strategy", "sector").agg(F.sum("notional").alias("gross"), F.sum(F.col("notional") * F.col("sign")).alias("net"), F.count(F.lit(1)).alias("n"))
    return g.select("segment", "strategy", "sector", "gross", "net", "n")


def usage_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Totals by status, by status and flag, and overall."""
    li = table(spark, d, "lineitem")
    return li.rollup("l_linestatus", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("qty"))


def usage_cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def fill_counters(spark: SparkSession, d: str) -> DataFrame:
    """Fills matched to an order of their own status, matched otherwise, and orphans."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("order_status"))
    j = _fills(spark, d).join(o, "order_id", "left")
    return j.agg(
        F.count_if(F.col("order_status") == F.col("status")).alias("matched"),
        F.count_if(F.col("order_status") != F.col("status")).alias("unmatched"),
        F.count_if(F.col("order_status").isNull()).alias("orphans"),
        F.coalesce(F.sum("qty"), F.lit(0)).alias("qty"),
    )


def transaction_costs(spark: SparkSession, d: str) -> DataFrame:
    """Discount and fee of the fills by venue, each truncated before it is summed."""
    f = _fills(spark, d)
    return f.groupBy("venue_id").agg(F.sum(mul_div("notional", "discount_ppm", 1_000_000)).alias("slippage"), F.sum(mul_div("notional", "fee_ppm", 1_000_000)).alias("fees"), F.count(F.lit(1)).alias("n"))


def gross_pnl(spark: SparkSession, d: str) -> DataFrame:
    """Signed cash plus inventory at the part's list price."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("part_id"), F.round(F.col("p_retailprice") * 100).cast("long").alias("mark"))
    g = _fills(spark, d).groupBy("part_id").agg(F.sum(-F.col("sign") * F.col("notional")).alias("cash"), F.sum(F.col("sign") * F.col("qty")).alias("inventory"))
    return g.join(p, "part_id").select("part_id", "cash", "inventory", (F.col("cash") + F.col("inventory") * F.col("mark")).alias("pnl"))


def execution_attribution(spark: SparkSession, d: str) -> DataFrame:
    """Fills joined with their orders and customers, summed by nation and strategy."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("account"), F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return _positions(spark, d).join(c, "account").join(n, "n_nationkey").groupBy("n_name", "strategy").agg(F.sum("notional").alias("notional"), F.count(F.lit(1)).alias("fills"))


def _forecasts(spark: SparkSession, d: str) -> DataFrame:
    """Events as forecasts: a probability in ppm and an outcome."""
    e = table(spark, d, "events")
    return e.select("event_id", "user_id", F.pmod(F.col("event_id") * 7919, F.lit(1_000_000)).alias("p_ppm"), (F.round(F.col("value") * 100).cast("long") % 3 == 0).alias("hit"), F.round(F.col("value") * 100).cast("long").alias("x"))


def forecast_scores(spark: SparkSession, d: str) -> DataFrame:
    """Log loss, Brier score, precision and calibration error over ten bins."""
    f = _forecasts(spark, d)
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("p_ppm") / 1e6))
    y = F.col("hit").cast("int")
    f = f.withColumn("p", p).withColumn("y", y)
    scores = f.agg(
        F.round(F.avg(-(F.col("y") * F.log("p") + (1 - F.col("y")) * F.log(1 - F.col("p")))), 6).alias("log_loss"),
        F.round(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))), 6).alias("brier"),
        F.round(F.avg(F.when(F.col("p_ppm") != 500_000, ((F.col("p_ppm") > 500_000) == F.col("hit")).cast("int"))), 6).alias("precision"),
        F.count(F.lit(1)).alias("n"),
    )
    bins = f.groupBy(F.least(F.lit(9), F.expr("p_ppm div 100000")).alias("bin")).agg(F.count(F.lit(1)).alias("k"), F.avg("p").alias("ap"), F.avg("y").alias("ay"))
    ece = bins.agg(F.round(F.sum(F.col("k") * F.abs(F.col("ap") - F.col("ay"))) / F.sum("k"), 6).alias("ece"))
    return scores.join(F.broadcast(ece), how="cross")


def calibration_bins(spark: SparkSession, d: str) -> DataFrame:
    f = _forecasts(spark, d)
    return f.groupBy(F.least(F.lit(9), F.expr("p_ppm div 100000")).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("p_ppm").alias("p_sum"), F.count_if("hit").alias("hits"))


def quantile_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Share of values inside an interval around their user's mean, in ppm."""
    f = _forecasts(spark, d)
    m = f.groupBy("user_id").agg(trunc_div(F.sum("x"), F.count(F.lit(1))).alias("m"))
    j = f.join(m, "user_id")
    return j.groupBy("user_id").agg(mul_div(F.count_if(F.col("x").between(F.col("m") - 500, F.col("m") + 500)), 1_000_000, F.count(F.lit(1))).alias("covered_ppm"))


def portfolio_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Mean, deviation, downside deviation, worst drawdown and tail mean of each user's daily changes."""
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), (F.round(F.col("value") * 100).cast("long") - 1000).alias("x"))
    g = e.groupBy("user_id", "day").agg(F.sum("x").alias("change"))
    w = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("equity", F.sum("change").over(w))
    g = g.withColumn("peak", F.max("equity").over(w)).withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("change", "day"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("user_id")))
    tail = F.when(F.col("rank") <= F.greatest(F.lit(1), F.expr("(n + 19) div 20")), F.col("change"))
    return g.groupBy("user_id").agg(
        F.round(F.avg("change"), 6).alias("mean"),
        F.round(F.stddev_pop("change"), 6).alias("deviation"),
        F.round(F.sqrt(F.avg(F.when(F.col("change") < 0, F.col("change") * F.col("change")).otherwise(0))), 6).alias("downside"),
        F.max(F.col("peak") - F.col("equity")).alias("drawdown"),
        F.round(F.avg(tail), 6).alias("tail_mean"),
    )


def paired_mean_interval(spark: SparkSession, d: str) -> DataFrame:
    """Exact integer mean of a paired difference, its standard error and upper bound, per event type."""
    e = table(spark, d, "events").select("event_type", (F.round(F.col("value") * 100).cast("long") - F.get_json_object("props", "$.k").cast("long")).alias("x"))
    g = e.groupBy("event_type").agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(wide("x") * wide("x")).alias("q"))
    mean = trunc_div("s", "n")
    err = isqrt(wide_div(wide("n") * wide("q") - wide("s") * wide("s"), wide("n") * wide("n") * wide(F.col("n") - 1)))
    return g.select("event_type", "n", mean.alias("mean"), err.alias("standard_error")).withColumn("upper", F.col("mean") + 2 * F.col("standard_error"))


def percentile_lower_rank(spark: SparkSession, d: str) -> DataFrame:
    """Median, 90th and 99.9th percentile by lower rank of the fills' notional per status."""
    return lower_rank(_fills(spark, d), ["status"], "notional", {"p50": 500, "p90": 900, "p999": 999})


def integer_median(spark: SparkSession, d: str) -> DataFrame:
    """Median of quantity per venue, truncated mean of the two middles where the count is even."""
    return lower_rank(_fills(spark, d), ["venue_id"], "qty", {"lo": 1, "hi": (1, 1)}, per=2).select("venue_id", "n", trunc_div(F.col("lo") + F.col("hi"), 2).alias("median"))


def cume_percentile(spark: SparkSession, d: str) -> DataFrame:
    """Share of line items of their status with at most this quantity, in ppm."""
    return cume_share(_fills(spark, d), ["status"], "qty", "share_ppm")


def minmax_scale(spark: SparkSession, d: str) -> DataFrame:
    """Centre and greatest deviation of the values per event type, and the scaled values' sum."""
    e = table(spark, d, "events").select("event_type", F.round(F.col("value") * 100).cast("long").alias("x"))
    g = e.groupBy("event_type").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    g = g.withColumn("centre", trunc_div(F.col("lo") + F.col("hi"), 2)).withColumn("scale", F.greatest(F.col("hi") - F.col("centre"), F.col("centre") - F.col("lo")))
    j = e.join(F.broadcast(g), "event_type")
    return j.groupBy("event_type", "centre", "scale").agg(F.sum(mul_div(F.col("x") - F.col("centre"), 1_000_000, "scale")).alias("scaled_sum"))


def ordered_digest(spark: SparkSession, d: str) -> DataFrame:
    """Digest over the digests of an order's lines in order, and their chain. An order's lines are few."""
    f = _fills(spark, d).select("order_id", F.struct("line", "part_id", "venue_id", "day").alias("pos"), F.sha2(F.concat_ws("|", "part_id", "qty", "notional"), 256).alias("digest"))
    return f.groupBy("order_id").agg(sequence_hash("pos", "digest").alias("sequence"), hash_chain("pos", "digest").alias("chain"))


def bucket_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy(hash_bucket("c_name", 16).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def task_totals(spark: SparkSession, d: str) -> DataFrame:
    """Counters over all rows; an empty table would give zeros."""
    return table(spark, d, "orders").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")), F.lit(0)).alias("total"), F.countDistinct("o_custkey").alias("customers"))


def counts_having(spark: SparkSession, d: str) -> DataFrame:
    """Customers with at least eight orders of one status."""
    return table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n")).where("n >= 8")


def coverage_with_zeros(spark: SparkSession, d: str) -> DataFrame:
    """Orders per customer, also of customers without any."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


def surprise_join(spark: SparkSession, d: str) -> DataFrame:
    """Actual against expected value per part: surprise in ppm, or why there is none."""
    actual = _fills(spark, d).groupBy("part_id").agg(trunc_div(F.sum("notional"), F.sum("qty")).alias("actual"))
    expected = table(spark, d, "part").where("p_size <> 7").select(F.col("p_partkey").alias("part_id"), F.when(F.col("p_size") % 5 != 0, F.round(F.col("p_retailprice") * 100).cast("long")).alias("expected"))
    j = actual.join(expected.withColumn("known", F.lit(True)), "part_id", "left")
    state = F.when(F.col("known").isNull(), "MISSING").when(F.col("expected").isNull(), "INCOMPATIBLE").otherwise("OK")
    return j.select("part_id", state.alias("state"), mul_div(F.col("actual") - F.col("expected"), 1_000_000, "expected").alias("surprise_ppm"))


def mixture_moments(spark: SparkSession, d: str) -> DataFrame:
    """Mean of a mixture over an order's lines and its variance, within plus between, in integers."""
    f = _fills(spark, d).select("order_id", F.col("qty").alias("w"), trunc_div("notional", "qty").alias("m"), F.expr("discount_ppm div 10000").alias("s"))
    g = f.groupBy("order_id").agg(trunc_div(F.sum(F.col("w") * F.col("m")), F.sum("w")).alias("mean"), F.sum("w").alias("weight"))
    e = F.col("m") - F.col("mean")
    return f.join(g, "order_id").groupBy("order_id", "mean").agg(trunc_div(F.sum(wide("w") * wide(F.col("s") * F.col("s") + e * e)), F.max("weight")).alias("variance"))


#: Greatest weight of a member, in ppm.
CAP = 400_000


def capped_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights of an order's lines by quantity, in ppm, none above the cap; no weights where the caps can't make a million.

    As long as a share exceeds the cap it is capped and the rest is dealt anew by
    score. In order of falling score the capped ones come first, so one pass of
    running sums finds them; what truncation leaves over goes, one each, to the first
    lines below the cap. Lines without a score get none.
    """
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_suppkey") % 5 == 0, 0).otherwise(F.col("l_quantity").cast("long")).cast("long").alias("score"))  # noqa: E741
    own = Window.partitionBy("l_orderkey")
    order = own.orderBy(F.desc("score"), "l_linenumber", "l_partkey", "l_suppkey")
    x = l.where("score > 0").withColumn("n", F.count(F.lit(1)).over(own)).where(F.col("n") * CAP >= 1_000_000)
    x = x.withColumn("i", F.row_number().over(order)).withColumn("rest", F.sum("score").over(own) - F.coalesce(F.sum("score").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    left = F.lit(1_000_000) - (F.col("i") - 1) * CAP
    over = (mul_div(F.col("score"), left, "rest") > CAP) & (left > 0)
    x = x.withColumn("capped", F.min(over.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("k", F.sum("capped").over(own)).withColumn("s", F.sum(F.when(F.col("capped") == 0, F.col("score"))).over(own))
    x = x.withColumn("w", F.when(F.col("capped") == 1, F.lit(CAP).cast("long")).otherwise(mul_div("score", F.lit(1_000_000) - F.col("k") * CAP, "s")))
    x = x.withColumn("residue", F.lit(1_000_000) - F.sum("w").over(own)).withColumn("below", F.sum(F.when(F.col("w") < CAP, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    w = F.col("w") + F.when((F.col("w") < CAP) & (F.col("below") <= F.col("residue")), 1).otherwise(0)
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", w.alias("weight_ppm"))


def cleanup_to_target(spark: SparkSession, d: str) -> DataFrame:
    """Oldest orders of each priority until their value reaches a target."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("at"), F.round(F.col("o_totalprice") * 100).cast("long").alias("v"))
    key = ["o_orderpriority"]
    r = running_total(o, key, "at", "upto", bucket_bounds(o, key, "at", BUCKET_ROWS), weight=F.col("v"), ties=["o_orderkey"])
    return r.withColumn("before", F.col("upto") - F.col("v")).where("before < 5000000000").select("o_orderkey", "o_orderpriority", "before")


def nearest_pick(spark: SparkSession, d: str) -> DataFrame:
    """The part of each brand and type whose price is nearest to the brand's mean."""
    p = table(spark, d, "part").withColumn("price", F.round(F.col("p_retailprice") * 100).cast("long"))
    m = p.groupBy("p_brand").agg(trunc_div(F.sum("price"), F.count(F.lit(1))).alias("mean"))
    j = p.join(m, "p_brand")
    return j.groupBy("p_brand", "p_type").agg(F.min_by("p_partkey", F.struct(F.abs(F.col("price") - F.col("mean")), "p_partkey")).alias("p_partkey"))


def overflow_probe(spark: SparkSession, d: str) -> DataFrame:
    """Whether a result of at most 1,000 rows would be cut off: asks for one more."""
    n = table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey").limit(1001).groupBy().agg(F.count(F.lit(1)).alias("n"))
    return n.select((F.col("n") > 1000).alias("truncated"))


def mark_all_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Members of groups of orders with the same customer, date and priority: all of them, not all but one."""
    w = Window.partitionBy("o_custkey", "o_orderdate", "o_orderpriority")
    return table(spark, d, "orders").withColumn("n", F.count(F.lit(1)).over(w)).where("n > 1").select("o_orderkey", "n")


def integer_rounding(spark: SparkSession, d: str) -> DataFrame:
    """The four roundings of one ratio side by side."""
    o = table(spark, d, "orders").select("o_orderkey", (F.round(F.col("o_totalprice") * 100).cast("long") - 20_000_000).alias("x"))
    return o.select("o_orderkey", trunc_div("x", 1000).alias("toward_zero"), floor_div("x", 1000).alias("down"), half_away_div("x", 1000).alias("half_away"), half_even_div("x", 1000).alias("half_even"), isqrt(F.abs("x")).alias("root"))


def calibration_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Step calibration, the fixed-point logistic and a linear score of the forecasts."""
    f = _forecasts(spark, d)
    score = F.col("p_ppm") * 16 - 8_000_000
    return f.select("event_id", step_lookup("p_ppm", [200_000, 500_000, 800_000], [100_000, 450_000, 900_000]).alias("step_ppm"), sigmoid_ppm(score).alias("logistic_ppm"), F.round(1 / (1 + F.exp(-(score / 1e6))), 6).alias("platt"))


def micro_unit_parse(spark: SparkSession, d: str) -> DataFrame:
    t = F.when(F.col("o_orderkey") % 10 == 0, ".").otherwise(F.format_string("%.4f", "o_totalprice"))
    return table(spark, d, "orders").select("o_orderkey", micro_units(t).alias("micros"))


def economic_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Distinct contents of orders among equal customers and dates."""
    return table(spark, d, "orders").withColumn("price", F.round(F.col("o_totalprice") * 100).cast("long")).select("o_custkey", economic_hash("o_custkey", "o_orderstatus", "price").alias("h")).groupBy("o_custkey").agg(F.countDistinct("h").alias("contents"))


def linear_fit(spark: SparkSession, d: str) -> DataFrame:
    """Least-squares line of value on quantity per event type, from one pass of sums."""
    e = table(spark, d, "events").select("event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    return e.groupBy("event_type").agg(F.round(F.regr_slope("value", "k"), 6).alias("slope"), F.round(F.regr_intercept("value", "k"), 6).alias("intercept"), F.round(F.corr("value", "k"), 6).alias("correlation"))


def running_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Observations accumulated per type: running count, sum and whether the running mean exceeds a bound."""
    e = table(spark, d, "events").select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.round(F.col("value") * 100).cast("long").alias("x"))
    key = ["event_type"]
    bounds = bucket_bounds(e, key, "t", BUCKET_ROWS)
    e = running_total(running_total(e, key, "t", "n", bounds, ties=["event_id"]), key, "t", "s", bounds, weight=F.col("x"), ties=["event_id"])
    return e.select("event_id", "n", "s", (F.col("s") > 1000 * F.col("n")).alias("exceeds"))


def join_inner_left_full(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the seven kinds of join between customers with and orders of odd keys."""
    c = table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"))
    o = table(spark, d, "orders").where("o_custkey % 2 = 1").select(F.col("o_custkey").alias("k"))
    parts = [c.join(o, "k", how).agg(F.lit(how).alias("kind"), F.count(F.lit(1)).alias("n")) for how in ("inner", "left", "right", "full", "left_semi", "left_anti")]
    r, n = table(spark, d, "region").select("r_name"), table(spark, d, "nation").select("n_name")
    parts.append(r.crossJoin(n).agg(F.lit("cross").alias("kind"), F.count(F.lit(1)).alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Union, intersection and difference of keys, as sets and as bags."""
    a = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k"))
    b = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    ops = {"union": a.union(b).distinct(), "union_all": a.union(b), "intersect": a.intersect(b), "intersect_all": a.intersectAll(b), "except": a.subtract(b), "except_all": a.exceptAll(b)}
    out = None
    for name, x in ops.items():
        x = x.agg(F.lit(name).alias("operation"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("s"))
        out = x if out is None else out.unionByName(x)
    return out


def ranking_suite(spark: SparkSession, d: str) -> DataFrame:
    """Row number, ranks, tiles and neighbours of a supplier by balance within its nation."""
    w = Window.partitionBy("s_nationkey").orderBy("s_acctbal", "s_suppkey")
    v = Window.partitionBy("s_nationkey").orderBy(F.expr("cast(s_acctbal as bigint) div 1000"))
    s = table(spark, d, "supplier")
    return s.select("s_suppkey", F.row_number().over(w).alias("rn"), F.rank().over(v).alias("rk"), F.dense_rank().over(v).alias("dr"), F.ntile(4).over(w).alias("tile"), F.lag("s_suppkey").over(w).alias("prev"), F.lead("s_suppkey").over(w).alias("next"), F.first("s_suppkey").over(w).alias("first"))


def pivot_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orders by priority with one column per status."""
    return table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


QUERIES = {
    f.__name__: f
    for f in (
        exposures, usage_rollup, usage_cube, fill_counters, transaction_costs, gross_pnl, execution_attribution, forecast_scores, calibration_bins, quantile_coverage,
        portfolio_metrics, paired_mean_interval, percentile_lower_rank, integer_median, cume_percentile, minmax_scale, ordered_digest, bucket_counts, task_totals,
        counts_having, coverage_with_zeros, surprise_join, mixture_moments, capped_weights, cleanup_to_target, nearest_pick, overflow_probe, mark_all_duplicates,
        integer_rounding, calibration_lookup, micro_unit_parse, economic_dedup, linear_fit, running_intervals, join_inner_left_full, set_operations, ranking_suite, pivot_counts,
    )
}

F_ = """with f as (select l_orderkey as order_id, l_partkey as part_id, l_suppkey as venue_id, l_linenumber as line, cast(l_quantity as bigint) as qty, cast(round(l_extendedprice * 100) as bigint) as notional,
  cast(round(l_discount * 1000000) as bigint) as discount_ppm, cast(round(l_tax * 1000000) as bigint) as fee_ppm, case when l_returnflag = 'R' then -1 else 1 end as sign, l_linestatus as status, cast(l_shipdate as date) as day from lineitem)
"""
P_ = F_ + ", x as (select f.*, o_custkey as account, o_orderpriority as strategy, p_brand as sector from f join orders on o_orderkey = order_id join part on p_partkey = part_id)\n"
FC = "with f as (select event_id, user_id, (event_id * 7919) % 1000000 as p_ppm, cast(round(value * 100) as bigint) % 3 = 0 as hit, cast(round(value * 100) as bigint) as x from events)\n"
_LOGISTIC = "[" + ", ".join(map(str, SIGMOID_PPM)) + "]"

SQL = {
    "exposures": P_ + "select c_mktsegment as segment, strategy, sector, cast(sum(notional) as bigint) as gross, cast(sum(notional * sign) as bigint) as net, count(*) as n from x join customer on c_custkey = account group by grouping sets ((c_mktsegment), (strategy), (sector), ())",
    "usage_rollup": "select l_linestatus, l_returnflag, count(*) as n, cast(sum(cast(l_quantity as bigint)) as bigint) as qty from lineitem group by rollup (l_linestatus, l_returnflag)",
    "usage_cube": "select o_orderstatus, o_orderpriority, count(*) as n from orders group by cube (o_orderstatus, o_orderpriority)",
    "fill_counters": F_ + "select count(*) filter (o_orderstatus = status) as matched, count(*) filter (o_orderstatus <> status) as unmatched, count(*) filter (o_orderstatus is null) as orphans, cast(coalesce(sum(qty), 0) as bigint) as qty from f left join orders on o_orderkey = order_id",
    "transaction_costs": F_ + "select venue_id, cast(sum(notional * discount_ppm // 1000000) as bigint) as slippage, cast(sum(notional * fee_ppm // 1000000) as bigint) as fees, count(*) as n from f group by 1",
    "gross_pnl": F_ + ", g as (select part_id, cast(sum(-sign * notional) as bigint) as cash, cast(sum(sign * qty) as bigint) as inventory from f group by 1) select part_id, cash, inventory, cash + inventory * cast(round(p_retailprice * 100) as bigint) as pnl from g join part on p_partkey = part_id",
    "execution_attribution": P_ + "select n_name, strategy, cast(sum(notional) as bigint) as notional, count(*) as fills from x join customer on c_custkey = account join nation on n_nationkey = c_nationkey group by 1, 2",
    "forecast_scores": FC
    + """, q as (select *, greatest(1e-6, least(1 - 1e-6, p_ppm / 1e6)) as p, hit::int as y from f), b as (select least(9, p_ppm // 100000) as bin, count(*) as k, avg(p) as ap, avg(y) as ay from q group by 1)
select round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) as log_loss, round(avg((p - y) * (p - y)), 6) as brier, round(avg(case when p_ppm <> 500000 then ((p_ppm > 500000) = hit)::int end), 6) as precision, count(*) as n,
  (select round(sum(k * abs(ap - ay)) / sum(k), 6) from b) as ece from q""",
    "calibration_bins": FC + "select cast(least(9, p_ppm // 100000) as integer) as bin, count(*) as n, cast(sum(p_ppm) as bigint) as p_sum, count(*) filter (hit) as hits from f group by 1",
    "quantile_coverage": FC + ", m as (select user_id, sum(x) // count(*) as m from f group by 1) select user_id, count(*) filter (x between m - 500 and m + 500) * 1000000 // count(*) as covered_ppm from f join m using (user_id) group by 1",
    "portfolio_metrics": """with g as (select user_id, cast(ts as date) as day, cast(sum(cast(round(value * 100) as bigint) - 1000) as bigint) as change from events group by 1, 2),
e as (select *, sum(change) over w as equity, row_number() over (partition by user_id order by change, day) as rank, count(*) over (partition by user_id) as n from g window w as (partition by user_id order by day rows between unbounded preceding and current row)),
p as (select *, max(equity) over (partition by user_id order by day rows between unbounded preceding and current row) as peak from e)
select user_id, round(avg(change), 6) as mean, round(stddev_pop(change), 6) as deviation, round(sqrt(avg(case when change < 0 then change * change else 0 end)), 6) as downside, cast(max(peak - equity) as bigint) as drawdown,
  round(avg(case when rank <= greatest(1, (n + 19) // 20) then change end), 6) as tail_mean from p group by 1""",
    "paired_mean_interval": """with g as (select event_type, count(*) as n, sum(x)::hugeint as s, sum(x * x)::hugeint as q from (select event_type, cast(round(value * 100) as bigint) - cast(json_extract(props, '$.k') as bigint) as x from events) group by 1),
h as (select event_type, n, cast(s // n as bigint) as mean, cast(floor(sqrt((n * q - s * s) // (n::hugeint * n * (n - 1)))) as bigint) as standard_error from g) select *, mean + 2 * standard_error as upper from h""",
    "percentile_lower_rank": F_ + "select status, count(*) as n, " + ", ".join(f"list_sort(list(notional))[(count(*) - 1) * {k} // 1000 + 1] as {n}" for n, k in (("p50", 500), ("p90", 900), ("p999", 999))) + " from f group by 1",
    "integer_median": F_ + "select venue_id, count(*) as n, (list_sort(list(qty))[(count(*) - 1) // 2 + 1] + list_sort(list(qty))[count(*) // 2 + 1]) // 2 as median from f group by 1",
    "cume_percentile": F_ + ", g as (select status, qty, count(*) as w from f group by 1, 2) select status, qty, cast(sum(w) over (partition by status order by qty) * 1000000 // sum(w) over (partition by status) as bigint) as share_ppm from g",
    "minmax_scale": """with e as (select event_type, cast(round(value * 100) as bigint) as x from events), g as (select event_type, (min(x) + max(x)) // 2 as centre, min(x) as lo, max(x) as hi from e group by 1),
h as (select event_type, centre, greatest(hi - centre, centre - lo) as scale from g) select event_type, centre, scale, cast(sum((x - centre) * 1000000 // scale) as bigint) as scaled_sum from e join h using (event_type) group by 1, 2, 3""",
    "bucket_counts": "select cast(cast('0x' || substr(sha256(c_name), 1, 16) as ubigint) % 16 as integer) as bucket, count(*) as n from customer group by 1",
    "task_totals": "select count(*) as n, cast(coalesce(sum(cast(round(o_totalprice * 100) as bigint)), 0) as bigint) as total, count(distinct o_custkey) as customers from orders",
    "counts_having": "select o_custkey, o_orderstatus, count(*) as n from orders group by 1, 2 having count(*) >= 8",
    "coverage_with_zeros": "select c_custkey, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey group by 1",
    "surprise_join": F_
    + """, a as (select part_id, cast(sum(notional) // sum(qty) as bigint) as actual from f group by 1), e as (select p_partkey, case when p_size % 5 <> 0 then cast(round(p_retailprice * 100) as bigint) end as expected from part where p_size <> 7)
select part_id, case when p_partkey is null then 'MISSING' when expected is null then 'INCOMPATIBLE' else 'OK' end as state, (actual - expected) * 1000000 // expected as surprise_ppm from a left join e on p_partkey = part_id""",
    "mixture_moments": F_
    + """, c as (select order_id, qty as w, notional // qty as m, discount_ppm // 10000 as s from f), g as (select order_id, sum(w * m) // sum(w) as mean, sum(w) as tw from c group by 1)
select order_id, cast(mean as bigint) as mean, cast(sum(cast(w as hugeint) * (s * s + (m - mean) * (m - mean))) // max(tw) as bigint) as variance from c join g using (order_id) group by 1, 2""",
    "ordered_digest": F_
    + """, h as (select order_id, list(sha256(part_id || '|' || qty || '|' || notional) order by line, part_id, venue_id, day, sha256(part_id || '|' || qty || '|' || notional)) as l from f group by 1)
select order_id, sha256(array_to_string(l, '')) as sequence, list_reduce(l, lambda a, x: sha256(a || x), '') as chain from h""",
    "capped_weights": f"""with l as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_suppkey % 5 = 0 then 0 else cast(l_quantity as bigint) end as score from lineitem),
a as (select * from (select *, count(*) over (partition by l_orderkey) as n from l where score > 0) where n * {CAP} >= 1000000),
b as (select *, row_number() over o as i, sum(score) over (partition by l_orderkey) - coalesce(sum(score) over (partition by l_orderkey order by score desc, l_linenumber, l_partkey, l_suppkey rows between unbounded preceding and 1 preceding), 0) as rest from a window o as (partition by l_orderkey order by score desc, l_linenumber, l_partkey, l_suppkey)),
c as (select *, case when 1000000 - (i - 1) * {CAP} > 0 and score * (1000000 - (i - 1) * {CAP}) // rest > {CAP} then 1 else 0 end as over_ from b),
d as (select *, min(over_) over (partition by l_orderkey order by score desc, l_linenumber, l_partkey, l_suppkey rows between unbounded preceding and current row) as capped from c),
e as (select *, sum(capped) over (partition by l_orderkey) as k, sum(case when capped = 0 then score end) over (partition by l_orderkey) as s from d),
f as (select *, case when capped = 1 then {CAP} else score * (1000000 - k * {CAP}) // s end as w from e),
g as (select *, 1000000 - sum(w) over (partition by l_orderkey) as residue, sum(case when w < {CAP} then 1 else 0 end) over (partition by l_orderkey order by score desc, l_linenumber, l_partkey, l_suppkey rows between unbounded preceding and current row) as below from f)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(w + case when w < {CAP} and below <= residue then 1 else 0 end as bigint) as weight_ppm from g""",
    "cleanup_to_target": """select o_orderkey, o_orderpriority, cast(before as bigint) as before from (select *, coalesce(sum(cast(round(o_totalprice * 100) as bigint)) over (partition by o_orderpriority order by o_orderdate, o_orderkey rows between unbounded preceding and 1 preceding), 0) as before from orders) where before < 5000000000""",
    "nearest_pick": """with p as (select *, cast(round(p_retailprice * 100) as bigint) as price from part), m as (select p_brand, sum(price) // count(*) as mean from p group by 1)
select p_brand, p_type, p_partkey from p join m using (p_brand) qualify row_number() over (partition by p_brand, p_type order by abs(price - mean), p_partkey) = 1""",
    "overflow_probe": "select count(*) > 1000 as truncated from orders where o_orderstatus = 'P'",
    "mark_all_duplicates": "select o_orderkey, n from (select o_orderkey, count(*) over (partition by o_custkey, o_orderdate, o_orderpriority) as n from orders) where n > 1",
    "integer_rounding": """with o as (select o_orderkey, cast(round(o_totalprice * 100) as bigint) - 20000000 as x from orders)
select o_orderkey, x // 1000 as toward_zero, x // 1000 - case when x % 1000 < 0 then 1 else 0 end as down, case when x < 0 then -1 else 1 end * ((abs(x) * 2 + 1000) // 2000) as half_away,
  cast(round_even(x / 1000.0, 0) as bigint) as half_even, cast(floor(sqrt(abs(x))) as bigint) as root from o""",
    "calibration_lookup": FC
    + f""", s as (select event_id, p_ppm, p_ppm * 16 as u, least(15, p_ppm * 16 // 1000000) as i from f)
select event_id, case when p_ppm <= 200000 then 100000 when p_ppm <= 500000 then 450000 else 900000 end::bigint as step_ppm,
  {_LOGISTIC}[i + 1] + (({_LOGISTIC}[i + 2] - {_LOGISTIC}[i + 1])::bigint * (u - i * 1000000)) // 1000000 as logistic_ppm, round(1 / (1 + exp(-((u - 8000000) / 1e6))), 6) as platt from s""",
    "micro_unit_parse": "select o_orderkey, case when o_orderkey % 10 <> 0 then cast(cast(printf('%.4f', o_totalprice) as decimal(32, 6)) * 1000000 as bigint) end as micros from orders",
    "economic_dedup": "select o_custkey, count(distinct (o_orderstatus, cast(round(o_totalprice * 100) as bigint))) as contents from orders group by 1",
    "linear_fit": "select event_type, round(regr_slope(value, k), 6) as slope, round(regr_intercept(value, k), 6) as intercept, round(corr(value, k), 6) as correlation from (select event_type, value, cast(json_extract(props, '$.k') as double) as k from events) group by 1",
    "running_intervals": "select event_id, n, cast(s as bigint) as s, s > 1000 * n as exceeds from (select event_id, count(*) over w as n, sum(cast(round(value * 100) as bigint)) over w as s from events window w as (partition by event_type order by ts, event_id rows between unbounded preceding and current row))",
    "join_inner_left_full": """with c as (select c_custkey as k from customer where c_custkey % 3 <> 0), o as (select o_custkey as k from orders where o_custkey % 2 = 1)
select 'inner' as kind, count(*) as n from c join o using (k) union all select 'left', count(*) from c left join o using (k) union all select 'right', count(*) from c right join o using (k) union all select 'full', count(*) from c full join o using (k)
union all select 'left_semi', count(*) from c semi join o using (k) union all select 'left_anti', count(*) from c anti join o using (k) union all select 'cross', count(*) from region, nation""",
    "set_operations": """with a as (select o_custkey as k from orders where o_orderstatus = 'O'), b as (select o_custkey as k from orders where o_orderstatus = 'F')
"""
    + " union all ".join(
        f"select '{n}' as operation, count(*) as n, cast(coalesce(sum(k), 0) as bigint) as s from (select * from a {op} select * from b)"
        for n, op in (("union", "union"), ("union_all", "union all"), ("intersect", "intersect"), ("intersect_all", "intersect all"), ("except", "except"), ("except_all", "except all"))
    ),
    "ranking_suite": """select s_suppkey, cast(row_number() over w as integer) as rn, cast(rank() over v as integer) as rk, cast(dense_rank() over v as integer) as dr, cast(ntile(4) over w as integer) as tile, lag(s_suppkey) over w as prev, lead(s_suppkey) over w as next, first(s_suppkey) over w as first
from supplier window w as (partition by s_nationkey order by s_acctbal, s_suppkey), v as (partition by s_nationkey order by cast(trunc(s_acctbal) as bigint) // 1000)""",
    "pivot_counts": "select o_orderpriority, count(*) filter (o_orderstatus = 'F') as F, count(*) filter (o_orderstatus = 'O') as O, count(*) filter (o_orderstatus = 'P') as P from orders group by 1",
}
