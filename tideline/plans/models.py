"""Forecast gates, validation and scoring, fills, replay, clocks and the news pipeline."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions import options as O
from tideline.functions.ints import clamp, mul_div, trunc_div
from tideline.operators import folds
from tideline.operators.scoring import ordered_batches, score_batches
from tideline.plans.bars import MIN, _minutes
from tideline.plans.streams import _O, _REC, E, MICRO_HOUR, SPAN, _events
from tideline.session import table

PPM = 1_000_000
MAX_AGE = 700

# --- Ensemble gates ------------------------------------------------------------


def _experts(spark: SparkSession, d: str) -> DataFrame:
    """Events as experts' forecasts; each score follows from the id."""
    e = table(spark, d, "events")
    part = lambda k: F.pmod(F.col("event_id") * k, F.lit(PPM))
    return e.select("event_id", "user_id", "event_type", part(7919).alias("confidence"), part(31_337).alias("calibration"), part(17_011).alias("quality"), part(13_007).alias("ood"), (F.col("event_id") % 1000).alias("produced"))


def gate_scores(spark: SparkSession, d: str) -> DataFrame:
    """Freshness (linear in age, none before production or beyond the greatest age), rule-based and linear gate scores."""
    now = 800
    age = F.lit(now) - F.col("produced")
    fresh = F.when((F.col("produced") == 0) | (age < 0) | (age >= MAX_AGE), F.lit(0).cast("long")).otherwise(F.lit(PPM) - mul_div(age, PPM, MAX_AGE))
    x = _experts(spark, d).withColumn("freshness", fresh)
    rule = F.expr("(confidence + calibration + quality + (1000000 - ood) + freshness) div 5")
    linear = F.lit(-500_000) + sum((mul_div(c, k, PPM) for c, k in (("calibration", -200_000), ("quality", 300_000), ("freshness", 400_000))), mul_div("confidence", 900_000, PPM)) + mul_div(F.lit(PPM) - F.col("ood"), 250_000, PPM)
    return x.select("event_id", "freshness", rule.alias("rule_score"), clamp(linear, 0, 4 * PPM).alias("linear_score"))


def expert_order(spark: SparkSession, d: str) -> DataFrame:
    """Canonical order of a user's newest experts of each model: by model, version (the highest id), id."""
    x = _experts(spark, d).groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"))
    return x.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_type", "event_id")).alias("place"))


#: Largest plausible absolute return and volatility, in ppm (fixed values of the checks).
MAX_RETURN, MAX_VOLATILITY = 900_000, 990_000


def forecast_validation(spark: SparkSession, d: str) -> DataFrame:
    """The first check that a forecast fails, or NONE: horizon, times, expiry, return, quantiles, probabilities, volatility, scores."""
    x = _experts(spark, d).select(
        "event_id", (F.col("event_id") % 50).alias("horizon"), (F.col("event_id") % 61).alias("as_of"), F.col("produced"), (F.col("produced") + F.col("event_id") % 300).alias("expires"),
        (F.col("confidence") * 2 - PPM).alias("ret"), (F.col("calibration") - 900_000).alias("p10"), (F.col("calibration") - 300_000).alias("p50"), F.col("quality").alias("p90"),
        F.expr("confidence div 2").alias("down"), F.expr("confidence div 4").alias("flat"), F.col("ood").alias("volatility"), "calibration",
    )
    x = x.withColumn("up", F.lit(PPM) - F.col("down") - F.col("flat") + F.when(F.col("event_id") % 23 == 0, 1).otherwise(0))
    code = (
        F.when(F.col("horizon") == 0, "INVALID_HORIZON")
        .when((F.col("as_of") <= 0) | (F.col("produced") == 0) | (F.col("expires") <= F.col("produced")), "INVALID_TIMESTAMP")
        .when(F.col("expires") < 600, "EXPIRED")
        .when(F.abs("ret") > MAX_RETURN, "INVALID_RETURN")
        .when((F.col("p10") > F.col("p50")) | (F.col("p50") > F.col("p90")) | (F.col("p10") < -MAX_RETURN) | (F.col("p90") > MAX_RETURN), "INVALID_QUANTILES")
        .when(F.col("down") + F.col("flat") + F.col("up") != PPM, "INVALID_PROBABILITIES")
        .when(F.col("volatility") > MAX_VOLATILITY, "INVALID_VOLATILITY")
        .when(F.col("calibration") > 980_000, "INVALID_SCORE")
        .otherwise("NONE")
    )
    return x.select("event_id", code.alias("error"))


#: A model's features: center, scale, weight in ppm, least and greatest value of training.
TRANSFORMS = {"quantity": (25, 10, 400_000, 5, 45), "discount": (5, 3, -250_000, 0, 8), "tax": (4, 2, 150_000, 1, 7)}
REJECT_OOD = 200_000


def _model_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("quantity"), F.round(F.col("l_discount") * 100).cast("long").alias("discount"), F.round(F.col("l_tax") * 100).cast("long").alias("tax"))


def model_predict(spark: SparkSession, d: str) -> DataFrame:
    """A fixed-point linear model: normalised features by weights, truncated at each step, with the share out of the training range; rejected beyond a bound."""
    score, ood = F.lit(100_000), F.lit(0)
    terms, shares = [], []
    for name, (center, scale, weight, lo, hi) in TRANSFORMS.items():
        z = mul_div(F.col(name) - center, PPM, scale)
        terms.append(mul_div(z, weight, PPM))
        away = F.when(F.col(name) < lo, F.lit(lo) - F.col(name)).when(F.col(name) > hi, F.col(name) - hi).otherwise(0)
        shares.append(F.least(F.lit(PPM).cast("long"), mul_div(away, PPM, F.greatest(F.lit(1), F.lit(hi - lo) + away))))
    score = sum(terms, F.lit(100_000).cast("long"))
    ood = F.greatest(*shares)
    m = _model_rows(spark, d).withColumn("ood_ppm", ood).withColumn("s", score)
    return m.select("l_orderkey", "l_linenumber", "ood_ppm", F.when(F.col("ood_ppm") > REJECT_OOD, "REJECTED").otherwise("OK").alias("status"), F.when(F.col("ood_ppm") <= REJECT_OOD, F.col("s")).alias("score_ppm"))


class _Weighted:
    """A user's model for ``model_scores``: a weighted sum."""

    def predict(self, rows: pd.DataFrame) -> pd.Series:
        return rows["quantity"] * 3 - rows["discount"] * 5 + rows["tax"]


def model_scores(spark: SparkSession, d: str) -> DataFrame:
    """A Python model over whole batches, with a status per row."""
    rows = _model_rows(spark, d).withColumn("discount", F.when(F.col("discount") < 10, F.col("discount")))
    return score_batches(rows, _Weighted, ["quantity", "discount", "tax"], ["l_orderkey", "l_linenumber"], limit=120)


def trend_forecast(spark: SparkSession, d: str) -> DataFrame:
    """Trend of the last nine values of a user, three horizons ahead, adjusted by the hour's session and bounded; with an interval of the mean absolute change."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    e = _events(spark, d).withColumn("v8", F.lag("ticks", 8).over(w)).withColumn("d", F.abs(F.col("ticks") - F.lag("ticks").over(w)))
    scale = F.greatest(F.lit(1), F.expr("sum(d) over (partition by user_id order by t, event_id rows between 7 preceding and current row) div 8"))
    e = e.withColumn("trend", trunc_div(F.col("ticks") - F.col("v8"), 8)).withColumn("scale", scale).where("v8 is not null").withColumn("session", F.expr(f"t div {MICRO_HOUR} % 5 + 1"))
    halved = lambda c, k: F.floor(c / k).cast("long")
    adjust = F.when(F.col("session") == 1, halved(-F.col("trend"), 4)).when(F.col("session") == 3, -F.col("trend")).when(F.col("session") == 4, halved(F.col("trend"), 2)).when(F.col("session") == 5, halved(-F.col("trend"), 2)).otherwise(0)
    e = e.withColumn("adjust", adjust).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(3))))
    point = F.greatest(F.lit(0), F.col("ticks") + F.col("trend") * F.col("i") + F.col("adjust"))
    e = e.withColumn("point", point)
    return e.select("event_id", F.col("i").alias("horizon"), "point", F.greatest(F.lit(0), F.col("point") - F.col("scale") * F.col("i")).alias("low"), (F.col("point") + F.col("scale") * F.col("i")).alias("high"), (F.lit(800_000) - (F.col("i") - 1) * 50_000).alias("confidence_ppm"))


# --- Options -------------------------------------------------------------------

YEAR_NS = 31_536_000_000_000_000


def _contracts(spark: SparkSession, d: str) -> DataFrame:
    """Contracts with instants; the year fraction is worked out from them (365 days a year)."""
    p = table(spark, d, "part")
    as_of = 1_704_067_200_000_000_000
    expiry = F.lit(as_of) + (F.col("p_partkey") % 12 + 1) * F.lit(30 * 86_400 * 10**9)
    return p.select(
        "p_partkey", (F.col("p_partkey") % 2 == 0).alias("call"), F.lit(100.0).alias("spot"), (F.lit(70.0) + F.col("p_size")).alias("strike"), ((expiry - as_of) / F.lit(float(YEAR_NS))).alias("years"),
        F.lit(0.03).alias("rate"), F.lit(0.01).alias("dividend"), (F.lit(0.1) + (F.col("p_partkey") % 40) / 100.0).alias("vol"),
    )


def option_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Discounted no-arbitrage bounds of European options."""
    c = _contracts(spark, d)
    s, k = F.col("spot") * F.exp(-F.col("dividend") * F.col("years")), F.col("strike") * F.exp(-F.col("rate") * F.col("years"))
    lower = F.when(F.col("call"), F.greatest(F.lit(0.0), s - k)).otherwise(F.greatest(F.lit(0.0), k - s))
    return c.select("p_partkey", F.round("years", 9).alias("years"), F.round(lower, 6).alias("lower_bound"), F.round(F.when(F.col("call"), s).otherwise(k), 6).alias("upper_bound"))


def option_sensitivities(spark: SparkSession, d: str) -> DataFrame:
    """Gamma, vega, and vanna and charm by finite differences of delta."""
    c = _contracts(spark, d)
    g = O.greeks("call", "spot", "strike", "years", "rate", "dividend", "vol")
    return c.select("p_partkey", g.alias("g")).select("p_partkey", *(F.round(F.col(f"g.{x}"), 8).alias(x) for x in ("gamma", "vega", "vanna", "charm")))


# --- Replay, fills and positions ------------------------------------------------


def replay_schedule(spark: SparkSession, d: str) -> DataFrame:
    """Delivery times of a replay at four times the speed, with a pause of an hour at the tenth day and single steps for its last rows."""
    e = _events(spark, d).select("event_id", "t")
    t0, pause_at = 1_704_067_200_000_000, 1_704_067_200_000_000 + 9 * 24 * MICRO_HOUR
    run = F.lit(t0) + F.expr(f"(t - {t0}) div 4") + F.when(F.col("t") >= pause_at, MICRO_HOUR).otherwise(0)
    mode = F.when(F.col("t") >= t0 + 28 * 24 * MICRO_HOUR, "STEP").otherwise("RUN")
    return e.select("event_id", mode.alias("mode"), F.when(mode == "RUN", run).alias("deliver_us"))


#: Costs of the fill model: slippage, impact per million units, fees per unit.
SLIPPAGE, IMPACT, MAKER_FEE, TAKER_FEE = 2, 60_000, -3, 7


def fill_costs(spark: SparkSession, d: str) -> DataFrame:
    """Prices of simulated fills: slippage and impact (rounded up) against the order, not beyond a limit order's price; fees by maker or taker."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("long") * 10).alias("q"), F.expr("cast(round(l_extendedprice) as bigint) div 100").alias("raw"), (F.col("l_linenumber") % 2 == 0).alias("buy"), (F.col("l_suppkey") % 3 == 0).alias("limited"), (F.col("l_partkey") % 2 == 0).alias("maker"))  # noqa: E741
    impact = F.when(F.col("q") == 0, 0).otherwise(F.expr(f"(q * {IMPACT} - 1) div {PPM} + 1"))
    l = l.withColumn("cost", impact + SLIPPAGE)  # noqa: E741
    limit_buy, limit_sell = F.col("raw") + 5, F.col("raw") - 5
    bought = F.when(F.col("limited"), F.least(F.col("raw") + F.col("cost"), limit_buy)).otherwise(F.col("raw") + F.col("cost"))
    sold = F.when(F.col("limited"), F.greatest(F.col("raw") - F.col("cost"), limit_sell)).otherwise(F.col("raw") - F.col("cost"))
    l = l.withColumn("price", F.when(F.col("buy"), bought).otherwise(sold))  # noqa: E741
    fee = F.col("q") * F.when(F.col("maker"), MAKER_FEE).otherwise(TAKER_FEE)
    return l.select("l_orderkey", "l_linenumber", F.when(F.col("price") > 0, F.col("price")).alias("price"), fee.cast("long").alias("fee"), F.when(F.col("price") > 0, "OK").otherwise("REJECTED").alias("status"))


def aggressive_fills(spark: SparkSession, d: str) -> DataFrame:
    """Takers consume the top level that is in view, once per state of the book: running sums per user and state."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    e = _events(spark, d).where("event_type in ('view', 'purchase')").withColumn("book", F.count_if(F.col("event_type") == "view").over(w))
    level = Window.partitionBy("user_id", "book")
    e = e.withColumn("shown", F.max(F.when(F.col("event_type") == "view", F.col("qty"))).over(level))
    taken = F.sum(F.when(F.col("event_type") == "purchase", F.col("qty")).otherwise(0)).over(level.orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    e = e.withColumn("before", F.coalesce(taken, F.lit(0)))
    return e.where("event_type = 'purchase'").select("event_id", F.greatest(F.lit(0), F.least(F.col("qty"), F.coalesce("shown", F.lit(0)) - F.col("before"))).cast("long").alias("filled"))


def rebuilt_positions(spark: SparkSession, d: str) -> DataFrame:
    """Positions per part from the latest version of each fill: corrections replace, busts remove."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("q"), (F.col("l_linenumber") % 2 == 0).alias("buy"))  # noqa: E741
    first = l.withColumn("version", F.lit(1))
    fixed = l.where("l_orderkey % 5 = 0").withColumn("q", F.col("q") + 1).withColumn("version", F.lit(2))
    bust = l.where("l_orderkey % 35 = 0").withColumn("q", F.lit(0).cast("long")).withColumn("version", F.lit(3))
    latest = first.unionByName(fixed).unionByName(bust).groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.max_by(F.struct("l_partkey", "q", "buy"), F.struct("version", "q", "buy")).alias("x"))
    return latest.groupBy(F.col("x.l_partkey").alias("part_id")).agg(F.sum(F.when(F.col("x.buy"), F.col("x.q")).otherwise(-F.col("x.q"))).alias("position"), F.count_if(F.col("x.q") > 0).alias("fills"))


def backtest_equity(spark: SparkSession, d: str) -> DataFrame:
    """A strategy called per event of a user, in order: fills at the event's price, position and equity after each."""
    return folds.ordered_fold(_events(spark, d), ["user_id"], ["t", "event_id"], lambda: None, folds.strategy_step(folds.MeanReversion), ["event_id", "ticks", "qty"], "event_id long, action long, position long, equity long")


def clock_quality(spark: SparkSession, d: str) -> DataFrame:
    """States of a clock: UNSAFE or DEGRADED by its offset, else SYNCING until it was good for a day on end from one source, then HEALTHY."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    e = _events(spark, d).select("event_id", "user_id", "t", F.pmod("ticks", F.lit(1000)).alias("offset"), F.expr(f"t div {7 * SPAN}").alias("source"))
    bad = F.when(F.col("offset") >= 950, "UNSAFE").when(F.col("offset") > 850, "DEGRADED")
    e = e.withColumn("bad", bad).withColumn("changed", F.coalesce(F.lag("source").over(w) != F.col("source"), F.lit(False)))
    e = e.withColumn("spell", F.count_if(F.col("bad").isNotNull() | F.col("changed")).over(w))
    start = F.min(F.when(F.col("bad").isNull(), F.col("t"))).over(Window.partitionBy("user_id", "spell"))
    return e.withColumn("start", start).select("event_id", F.coalesce("bad", F.when(F.col("t") - F.col("start") < SPAN, "SYNCING").otherwise("HEALTHY")).alias("state"))


# --- News ----------------------------------------------------------------------

#: Kinds of event by the first rule of which a theme contains a marker (fixed values, in order).
THEMES = [
    ("CORRECTION", ("CORRECTION",)),
    ("RUMOR", ("RUMOR",)),
    ("TRADING_HALT", ("TRADING_HALT", "ECON_STOCKMARKET_HALT")),
    ("BANKRUPTCY", ("BANKRUPTCY", "ECON_BANKRUPTCY")),
    ("CYBERSECURITY_INCIDENT", ("CYBER_ATTACK", "CYBERSECURITY")),
    ("MERGER_ACQUISITION", ("MERGER", "ACQUISITION")),
    ("PRODUCT_RECALL", ("PRODUCT_RECALL",)),
    ("REGULATORY_ACTION", ("REGULATORY", "SANCTIONS")),
    ("EXECUTIVE_CHANGE", ("EXECUTIVE_CHANGE",)),
    ("GUIDANCE_UPDATE", ("GUIDANCE",)),
    ("EARNINGS_RELEASE", ("EARNINGS", "QUARTERLY_RESULTS")),
    ("FINANCING", ("FINANCING", "DEBT_OFFERING")),
    ("LITIGATION", ("LITIGATION", "LAWSUIT")),
    ("SUPPLY_CHAIN_DISRUPTION", ("SUPPLY_CHAIN", "SHORTAGE")),
]
_MARKERS = [m for _, ms in THEMES for m in ms]


def theme_classes(spark: SparkSession, d: str) -> DataFrame:
    """Rows with two themes each, classified by the first rule that any theme meets."""
    names = F.array(*map(F.lit, ["TAX_FNCACT", *_MARKERS, "WB_696"]))
    n = len(_MARKERS) + 2
    p = table(spark, d, "part").select("p_partkey", F.array(F.concat(F.lit("X_"), F.element_at(names, (F.col("p_partkey") % n + 1).cast("int"))), F.concat(F.element_at(names, (F.col("p_partkey") * 7 % n + 1).cast("int")), F.lit("_Y"))).alias("themes"))
    out = F.lit(None).cast("string")
    for label, markers in reversed(THEMES):
        out = F.when(F.exists("themes", lambda t: t.rlike("|".join(markers))), label).otherwise(out)
    return p.select("p_partkey", out.alias("event_type"))


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_documents").select("provider_id", "document_id", "content_type", F.decode("payload", "UTF-8").alias("body"), F.col("authentication.status").alias("status"), F.col("received_wall_clock_utc_ns").alias("t"))


#: Kinds of document by the first phrase of the text, or of the content type (fixed values, in order).
DOCUMENT_TYPES = [
    (("correction", "corrected"), (), "CORRECTION"),
    (("10-k", "10-q", "8-k"), ("filing",), "FILING"),
    (("regulatory notice", "enforcement notice"), (), "REGULATORY_NOTICE"),
    (("press release",), ("newswire",), "PRESS_RELEASE"),
    (("economic release", "macro release"), (), "MACRO_RELEASE"),
]


def document_types(spark: SparkSession, d: str) -> DataFrame:
    b = _bodies(spark, d)
    out = F.lit("NEWS_ARTICLE")
    text, kind = F.lower(F.coalesce("body", F.lit(""))), F.lower(F.coalesce("content_type", F.lit("")))
    for phrases, types, label in reversed(DOCUMENT_TYPES):
        hit = F.lit(False)
        for p in phrases:
            hit = hit | text.contains(p)
        for p in types:
            hit = hit | kind.contains(p)
        out = F.when(hit, label).otherwise(out)
    return b.groupBy("provider_id", out.alias("document_type")).agg(F.count(F.lit(1)).alias("n"))


def news_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Documents through the stages of a feed, with the count that each provider keeps: received, authentic, first delivery, first text."""
    b = _bodies(spark, d).withColumn("ok", F.col("status") != "INVALID")
    first = b.where("ok").groupBy("provider_id", "document_id").agg(F.min(F.struct(F.coalesce("t", F.lit(2**63 - 1)).alias("t"), F.sha2(F.coalesce("body", F.lit("")), 256).alias("h"))).alias("x"))
    texts = first.groupBy("x.h").agg(F.min(F.struct("x.t", "provider_id", "document_id")).alias("y"))
    received = b.groupBy("provider_id").agg(F.count(F.lit(1)).alias("received"), F.count_if("ok").alias("authentic"))
    j = received.join(first.groupBy("provider_id").agg(F.count(F.lit(1)).alias("deliveries")), "provider_id", "left").join(texts.groupBy("y.provider_id").agg(F.count(F.lit(1)).alias("texts")), "provider_id", "left")
    return j.select("provider_id", "received", "authentic", F.coalesce("deliveries", F.lit(0)).alias("deliveries"), F.coalesce("texts", F.lit(0)).alias("texts"))


def alias_filter(spark: SparkSession, d: str) -> DataFrame:
    """SQL text with an array parameter: rows of which any part of a delimited list is, normalised, among the aliases."""
    table(spark, d, "part").createOrReplaceTempView("tideline_part")
    return spark.sql(
        """select p_partkey, regexp_extract(p_name, '([a-z]+)$', 1) as thing from tideline_part
           where exists(split(concat_ws(';', p_type, p_name), '[; ]'), w -> array_contains(:aliases, lower(trim(regexp_replace(w, '[^A-Za-z]', ''))))) and ifnull(p_size, 0) > 10 order by p_partkey""",
        args={"aliases": F.array(*map(F.lit, ["gear", "anvil"]))},
    )


def result_batches(spark: SparkSession, d: str) -> DataFrame:
    """A result in ordered batches of 500 rows, as a cursor would give them."""
    return ordered_batches(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 500)


class _Steps:
    """A table function: the whole steps between two numbers, with their place."""

    def eval(self, first: int, last: int, width: int):
        if first is not None and last is not None and width:
            for k, x in enumerate(range(first, last + 1, width)):
                yield k, x


def table_function(spark: SparkSession, d: str) -> DataFrame:
    """A Python table function registered for SQL and called once per row (lateral join)."""
    spark.udtf.register("tideline_steps", F.udtf(_Steps, returnType="place int, step long"))
    table(spark, d, "part").createOrReplaceTempView("tideline_part")
    return spark.sql("select p_partkey, place, step from tideline_part, lateral tideline_steps(cast(p_size as bigint), cast(p_size + p_partkey % 5 * 3 as bigint), 3L)")


def aggregate_function(spark: SparkSession, d: str) -> DataFrame:
    """A Python aggregate over the minutes of a series (a session bounds them; such a function holds its whole group): the longest streak of rising closes."""

    @F.pandas_udf("long")
    def streak(size: pd.Series, price: pd.Series) -> int:
        p = price[size.argsort(kind="stable")].to_numpy()
        best = now = 1 if len(p) else 0
        for a, b in zip(p, p[1:]):
            now = now + 1 if b > a else 1
            best = max(best, now)
        return best

    return _minutes(spark, d).groupBy("symbol", "market_id", "session_id").agg(streak("m", "c_ticks").alias("streak"))


def approximate_aggregates(spark: SparkSession, d: str) -> DataFrame:
    """Approximate distinct counts and medians per status, and whether they keep to their stated error."""
    o = table(spark, d, "orders").withColumn("c", F.round(F.col("o_totalprice") * 100).cast("long"))
    g = o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("customers"), F.approx_count_distinct("o_custkey", 0.02).alias("near"), F.percentile_approx("c", 0.5, 1000).alias("mid"))
    rank = o.join(g.select("o_orderstatus", "mid"), "o_orderstatus").groupBy("o_orderstatus").agg(F.avg((F.col("c") <= F.col("mid")).cast("double")).alias("share"))
    return g.join(rank, "o_orderstatus").select("o_orderstatus", "n", "customers", (F.abs(F.col("near") - F.col("customers")) <= 0.1 * F.col("customers")).alias("count_near"), (F.abs(F.col("share") - 0.5) <= 0.01).alias("median_near"))


QUERIES = {
    f.__name__: f
    for f in (
        table_function, aggregate_function, approximate_aggregates,
        gate_scores, expert_order, forecast_validation, model_predict, model_scores, trend_forecast, option_bounds, option_sensitivities, replay_schedule, fill_costs, aggressive_fills, rebuilt_positions,
        backtest_equity, clock_quality, theme_classes, document_types, news_pipeline, alias_filter, result_batches,
    )
}

X = "with x as (select event_id, user_id, event_type, event_id * 7919 % 1000000 as confidence, event_id * 31337 % 1000000 as calibration, event_id * 17011 % 1000000 as quality, event_id * 13007 % 1000000 as ood, event_id % 1000 as produced from events)\n"
_W = "partition by user_id order by t, event_id"


def _term(name: str, center: int, scale: int, weight: int) -> str:
    z = f"(sign({name} - {center}) * (abs({name} - {center}) * 1000000 // {scale}))"
    return f"sign({z} * {weight}) * (abs({z} * {weight}) // 1000000)"


def _share(name: str, lo: int, hi: int) -> str:
    away = f"case when {name} < {lo} then {lo} - {name} when {name} > {hi} then {name} - {hi} else 0 end"
    return f"least(1000000, ({away}) * 1000000 // greatest(1, {hi - lo} + ({away})))"


_ROWS = "with m as (select l_orderkey, l_linenumber, cast(l_quantity as bigint) as quantity, cast(round(l_discount * 100) as bigint) as discount, cast(round(l_tax * 100) as bigint) as tax from lineitem)\n"
_BODY = "with b as (select provider_id, document_id, content_type, decode(payload) as body, authentication.status as status, received_wall_clock_utc_ns as t from source_documents)\n"
_CON = "with c as (select p_partkey, p_partkey % 2 = 0 as call, 100.0::double as spot, 70.0::double + p_size as strike, (p_partkey % 12 + 1) * 2592000000000000 / 31536000000000000.0::double as years from part), k as (select *, spot * exp(-0.01 * years) as s, strike * exp(-0.03 * years) as x from c)\n"
SQL = {
    "gate_scores": X
    + f""", f as (select *, case when produced = 0 or 800 - produced < 0 or 800 - produced >= {MAX_AGE} then 0 else 1000000 - (800 - produced) * 1000000 // {MAX_AGE} end as freshness from x)
select event_id, freshness, (confidence + calibration + quality + (1000000 - ood) + freshness) // 5 as rule_score,
  greatest(0, least(4000000, -500000 + confidence * 900000 // 1000000 - calibration * 200000 // 1000000 + quality * 300000 // 1000000 + freshness * 400000 // 1000000 + (1000000 - ood) * 250000 // 1000000)) as linear_score from f""",
    "table_function": "select p_partkey, cast(place as integer) as place, p_size + 3 * place as step from (select p_partkey, p_size, unnest(range(0, p_partkey % 5 + 1)) as place from part)",
    "aggregate_function": MIN
    + """, q as (select *, case when c_ticks > lag(c_ticks) over w then 0 else 1 end as new_ from m window w as (partition by symbol, market_id, session_id order by m)), r as (select *, sum(new_) over (partition by symbol, market_id, session_id order by m) as run from q),
s as (select symbol, market_id, session_id, run, count(*) as n from r group by all) select symbol, market_id, session_id, max(n) as streak from s group by all""",
    "approximate_aggregates": "select o_orderstatus, count(*) as n, count(distinct o_custkey) as customers, true as count_near, true as median_near from orders group by 1",
    "expert_order": X + "select user_id, event_id, cast(row_number() over (partition by user_id order by event_type, event_id) as integer) as place from (select user_id, event_type, max(event_id) as event_id from x group by 1, 2)",
    "forecast_validation": X
    + f""", y as (select event_id, event_id % 50 as horizon, event_id % 61 as as_of, produced, produced + event_id % 300 as expires, confidence * 2 - 1000000 as ret, calibration - 900000 as p10, calibration - 300000 as p50, quality as p90,
  confidence // 2 as down, confidence // 4 as flat, ood as volatility, calibration from x), z as (select *, 1000000 - down - flat + case when event_id % 23 = 0 then 1 else 0 end as up from y)
select event_id, case when horizon = 0 then 'INVALID_HORIZON' when as_of <= 0 or produced = 0 or expires <= produced then 'INVALID_TIMESTAMP' when expires < 600 then 'EXPIRED' when abs(ret) > {MAX_RETURN} then 'INVALID_RETURN'
  when p10 > p50 or p50 > p90 or p10 < -{MAX_RETURN} or p90 > {MAX_RETURN} then 'INVALID_QUANTILES' when down + flat + up <> 1000000 then 'INVALID_PROBABILITIES' when volatility > {MAX_VOLATILITY} then 'INVALID_VOLATILITY'
  when calibration > 980000 then 'INVALID_SCORE' else 'NONE' end as error from z""",
    "model_predict": _ROWS
    + f", o as (select *, cast(greatest({', '.join(_share(n, t[3], t[4]) for n, t in TRANSFORMS.items())}) as bigint) as ood_ppm, cast(100000 + {' + '.join(_term(n, *t[:3]) for n, t in TRANSFORMS.items())} as bigint) as s from m) "
    + f"select l_orderkey, l_linenumber, ood_ppm, case when ood_ppm > {REJECT_OOD} then 'REJECTED' else 'OK' end as status, case when ood_ppm <= {REJECT_OOD} then s end as score_ppm from o",
    "model_scores": _ROWS
    + """, s as (select l_orderkey, l_linenumber, case when discount < 10 then quantity * 3 - discount * 5 + tax end as v from m)
select l_orderkey, l_linenumber, case when abs(v) <= 120 then v end as score, case when v is null then 'INVALID_INPUT' when abs(v) <= 120 then 'OK' else 'OUT_OF_RANGE' end as status from s""",
    "trend_forecast": E
    + f""", a as (select *, lag(ticks, 8) over ({_W}) as v8, abs(ticks - lag(ticks) over ({_W})) as d from e), b as (select *, greatest(1, cast(sum(d) over ({_W} rows between 7 preceding and current row) as bigint) // 8) as scale from a),
c as (select *, cast(sign(ticks - v8) * (abs(ticks - v8) // 8) as bigint) as trend, t // {MICRO_HOUR} % 5 + 1 as session from b where v8 is not null),
f as (select *, cast(case session when 1 then floor(-trend / 4.0) when 3 then -trend when 4 then floor(trend / 2.0) when 5 then floor(-trend / 2.0) else 0 end as bigint) as adjust from c),
g as (select event_id, i as horizon, greatest(0, ticks + trend * i + adjust) as point, scale from f, (select unnest([1, 2, 3]) as i))
select event_id, horizon, point, greatest(0, point - scale * horizon) as low, point + scale * horizon as high, 800000 - (horizon - 1) * 50000 as confidence_ppm from g""",
    "option_bounds": _CON + "select p_partkey, round(years, 9) as years, round(case when call then greatest(0.0, s - x) else greatest(0.0, x - s) end, 6) as lower_bound, round(case when call then s else x end, 6) as upper_bound from k",
    "replay_schedule": E
    + f""", m as (select event_id, t, case when t >= 1704067200000000 + {28 * 24 * MICRO_HOUR} then 'STEP' else 'RUN' end as mode from e)
select event_id, mode, case when mode = 'RUN' then 1704067200000000 + (t - 1704067200000000) // 4 + case when t >= 1704067200000000 + {9 * 24 * MICRO_HOUR} then {MICRO_HOUR} else 0 end end as deliver_us from m""",
    "fill_costs": f"""with l as (select l_orderkey, l_linenumber, cast(l_quantity as bigint) * 10 as q, cast(round(l_extendedprice) as bigint) // 100 as raw, l_linenumber % 2 = 0 as buy, l_suppkey % 3 = 0 as limited, l_partkey % 2 = 0 as maker from lineitem),
c as (select *, case when q = 0 then 0 else (q * {IMPACT} - 1) // 1000000 + 1 end + {SLIPPAGE} as cost from l),
p as (select *, case when buy then case when limited then least(raw + cost, raw + 5) else raw + cost end else case when limited then greatest(raw - cost, raw - 5) else raw - cost end end as price from c)
select l_orderkey, l_linenumber, case when price > 0 then price end as price, q * case when maker then {MAKER_FEE} else {TAKER_FEE} end as fee, case when price > 0 then 'OK' else 'REJECTED' end as status from p""",
    "aggressive_fills": E
    + f""", a as (select *, count(*) filter (event_type = 'view') over ({_W} rows between unbounded preceding and current row) as book from e where event_type in ('view', 'purchase')),
b as (select *, max(case when event_type = 'view' then qty end) over (partition by user_id, book) as shown, coalesce(sum(case when event_type = 'purchase' then qty else 0 end) over (partition by user_id, book order by t, event_id rows between unbounded preceding and 1 preceding), 0) as before from a)
select event_id, cast(greatest(0, least(qty, coalesce(shown, 0) - before)) as bigint) as filled from b where event_type = 'purchase'""",
    "rebuilt_positions": """with l as (select l_orderkey, l_linenumber, l_partkey, cast(l_quantity as bigint) as q, l_linenumber % 2 = 0 as buy from lineitem),
v as (select *, 1 as v from l union all select l_orderkey, l_linenumber, l_partkey, q + 1, buy, 2 from l where l_orderkey % 5 = 0 union all select l_orderkey, l_linenumber, l_partkey, 0, buy, 3 from l where l_orderkey % 35 = 0),
x as (select * from v qualify row_number() over (partition by l_orderkey, l_linenumber, l_partkey order by v desc, q desc, buy desc) = 1)
select l_partkey as part_id, cast(sum(case when buy then q else -q end) as bigint) as position, count(*) filter (q > 0) as fills from x group by 1""",
    "backtest_equity": _REC
    + ", "
    + _O.format("e")
    + """, k as (select user_id, i, event_id, cast(0 as bigint) as action, cast(0 as bigint) as position, cast(0 as bigint) as cash, cast(ticks as bigint) as price, [ticks] as seen from o where i = 1 union all
  select user_id, i, event_id, act, position + act, cast(cash - act * ticks as bigint), ticks, list_append(seen, ticks)[-4:] from (
    select o.user_id, o.i, o.event_id, o.ticks, k.position, k.cash, k.seen, cast(case when o.ticks < list_sum(k.seen) // len(k.seen) and k.position < 3 then 1 when o.ticks > list_sum(k.seen) // len(k.seen) and k.position > -3 then -1 else 0 end as bigint) as act
    from k join o on o.user_id = k.user_id and o.i = k.i + 1))
select user_id, event_id, action, position, cast(cash + position * price as bigint) as equity from k""",
    "clock_quality": E
    + f""", a as (select event_id, user_id, t, ticks % 1000 as offset_, t // {7 * SPAN} as source from e),
b as (select *, case when offset_ >= 950 then 'UNSAFE' when offset_ > 850 then 'DEGRADED' end as bad, coalesce(lag(source) over ({_W}) <> source, false) as changed from a),
c as (select *, count(*) filter (bad is not null or changed) over ({_W} rows between unbounded preceding and current row) as spell from b),
f as (select *, min(case when bad is null then t end) over (partition by user_id, spell) as start from c)
select event_id, coalesce(bad, case when t - start < {SPAN} then 'SYNCING' else 'HEALTHY' end) as state from f""",
    "theme_classes": f"""with n as (select {['TAX_FNCACT', *_MARKERS, 'WB_696']} as names), p as (select p_partkey, ['X_' || names[p_partkey % {len(_MARKERS) + 2} + 1], names[p_partkey * 7 % {len(_MARKERS) + 2} + 1] || '_Y'] as th from part, n)
select p_partkey, case {' '.join(f"when regexp_matches(array_to_string(th, ';'), '{'|'.join(ms)}') then '{label}'" for label, ms in THEMES)} end as event_type from p""",
    "document_types": _BODY
    + "select provider_id, case "
    + " ".join("when " + " or ".join([*(f"contains(lower(body), '{p}')" for p in ps), *(f"contains(lower(content_type), '{p}')" for p in ts)]) + f" then '{label}'" for ps, ts, label in DOCUMENT_TYPES)
    + " else 'NEWS_ARTICLE' end as document_type, count(*) as n from b group by 1, 2",
    "news_pipeline": _BODY
    + """, f as (select provider_id, document_id, coalesce(t, 9223372036854775807) as t, sha256(coalesce(body, '')) as h from b where status <> 'INVALID' qualify row_number() over (partition by provider_id, document_id order by coalesce(t, 9223372036854775807), sha256(coalesce(body, ''))) = 1),
x as (select provider_id from f qualify row_number() over (partition by h order by t, provider_id, document_id) = 1)
select provider_id, received, authentic, coalesce(deliveries, 0) as deliveries, coalesce(texts, 0) as texts from (select provider_id, count(*) as received, count(*) filter (status <> 'INVALID') as authentic from b group by 1)
left join (select provider_id, count(*) as deliveries from f group by 1) using (provider_id) left join (select provider_id, count(*) as texts from x group by 1) using (provider_id)""",
    "alias_filter": """select p_partkey, regexp_extract(p_name, '([a-z]+)$', 1) as thing from part where len(list_filter(string_split_regex(p_type || ';' || p_name, '[; ]'), lambda w: list_contains(['gear', 'anvil'], lower(trim(regexp_replace(w, '[^A-Za-z]', '', 'g')))))) > 0 and coalesce(p_size, 0) > 10""",
    "result_batches": "select o_orderkey, o_orderstatus, (row_number() over (order by o_orderkey) - 1) // 500 as batch from orders",
}
