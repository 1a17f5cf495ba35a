"""Market features as of each event, and the journal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions.ints import isqrt, mul_div, return_ppm, trunc_div, wide, wide_div
from tideline.plans.bars import half_away
from tideline.plans.streams import E, MICRO_HOUR, SPAN, _events, _user
from tideline.session import table
from tideline.sources import journal as J

PPM = 1_000_000
DAY_US = 24 * MICRO_HOUR
#: Quotes in the window below which features are still warming, and the age beyond which they are stale.
LEAST_QUOTES, STALE_US = 2, 12 * MICRO_HOUR


def feature_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The 26 features of a market as of each of its events, over the last 24 hours, with their validity.

    A user stands for a market: views are bids, clicks asks 3,000 ticks above,
    purchases buys, errors sells, signups cancels; odd and even ids are two venues.
    All frames share the user's one shuffle and sort.
    """
    w = _user()
    now, back, win = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1), w.rangeBetween(-SPAN, 0)
    kind = F.col("event_type")
    bid, ask, buy, sell, cancel = kind == "view", kind == "click", kind == "purchase", kind == "error", kind == "signup"
    quote, trade, venue = bid | ask, buy | sell, F.col("event_id") % 2 + 1
    last = lambda cond, x, over=now: F.last(F.when(cond, x), ignorenulls=True).over(over)
    size = F.col("qty") + 1
    e = _events(spark, d).select("event_id", "user_id", "t", "event_type", "ticks", "qty", venue.alias("venue"))
    e = e.select(
        "*", last(bid, F.col("ticks")).alias("bp"), last(bid, size).alias("bq"), last(ask, F.col("ticks") + 3000).alias("ap"), last(ask, size).alias("aq"), last(bid, size, back).alias("pbq"), last(ask, size, back).alias("paq"),
        *(last(bid & (F.col("venue") == v), F.col("ticks")).alias(f"bv{v}") for v in (1, 2)), *(last(ask & (F.col("venue") == v), F.col("ticks")).alias(f"av{v}") for v in (1, 2)),
        last(quote, F.col("t")).alias("qt"), F.lag("event_type").over(w).alias("before"), (F.col("t") - F.min("t").over(win) + 1).alias("span"),
    )
    lead = lambda a, b, better: F.when(a.isNull() & b.isNull(), None).when(b.isNull() | better(a, b), 1).when(a.isNull() | ~better(a, b), 2).cast("long")
    flow = F.when(bid, size - F.coalesce("pbq", F.lit(0))).when(ask, F.coalesce("paq", F.lit(0)) - size).otherwise(0)
    e = e.select("*", (F.col("bp") + F.col("ap")).alias("mid2"), flow.alias("flow"), lead(F.col("bv1"), F.col("bv2"), lambda a, b: a >= b).alias("bl"), lead(F.col("av1"), F.col("av2"), lambda a, b: a <= b).alias("al"))
    e = e.withColumn("r", F.coalesce(mul_div(F.col("mid2") - F.lag("mid2").over(w), PPM, F.lag("mid2").over(w)), F.lit(0)))
    total = lambda cond, x: F.coalesce(F.sum(F.when(cond, x)).over(win), F.lit(0))
    count = lambda cond: F.count_if(cond).over(win)
    e = e.select(
        "*", total(bid, size).alias("sb"), total(ask, size).alias("sa"), F.sum("flow").over(win).alias("ofi"), total(buy, F.col("qty")).alias("bought"), total(sell, F.col("qty")).alias("sold"), total(trade, wide(F.col("ticks") * F.col("qty"))).alias("notional"),
        count(quote).alias("nq"), count(cancel).alias("nc"), count(trade).alias("nt"), count(bid & (F.col("before") == "purchase")).alias("nr"), F.first("mid2", ignorenulls=True).over(win).alias("mid0"),
        F.sum(wide("r") * wide("r")).over(win).alias("rr"), F.count(F.lit(1)).over(win).alias("n"), count(F.col("bl") == 1).alias("led"),
    )
    rate = lambda c: mul_div(c, 1_000_000_000, "span")
    crossed = F.col("ap") <= F.col("bp")
    age = F.col("t") - F.col("qt")
    sides = lambda b, a: mul_div(b - a, PPM, b + a)
    volume = F.col("bought") + F.col("sold")
    validity = F.when(F.col("mid2").isNull(), "MISSING").when(crossed, "INVALID").when(age > STALE_US, "STALE").when(F.col("nq") < LEAST_QUOTES, "WARMING").otherwise("VALID")
    values: dict[str, Column] = {
        "midpoint_half_ticks": F.col("mid2"),
        "spread_ticks": F.col("ap") - F.col("bp"),
        "relative_spread_ppm": mul_div(F.col("ap") - F.col("bp"), 2 * PPM, "mid2"),
        "microprice_ticks_ppm": trunc_div((wide("ap") * wide("bq") + wide("bp") * wide("aq")) * PPM, F.col("bq") + F.col("aq")),
        "top_level_imbalance_ppm": sides(F.col("bq"), F.col("aq")),
        "multi_level_weighted_imbalance_ppm": sides(F.col("bq") + F.col("sb"), F.col("aq") + F.col("sa")),
        "order_flow_imbalance_units": F.col("ofi"),
        "signed_trade_imbalance_ppm": mul_div(F.col("bought") - F.col("sold"), PPM, volume),
        "add_rate_millihertz": rate("nq"),
        "cancel_rate_millihertz": rate("nc"),
        "execute_rate_millihertz": rate("nt"),
        "queue_depletion_rate_units_per_second": mul_div(volume, PPM, "span"),
        "rolling_return_ppm": return_ppm("mid2", "mid0"),
        "realized_volatility_ppm": isqrt(wide_div("rr", "n")),
        "volume_units": volume,
        "vwap_ticks_ppm": trunc_div(F.col("notional") * PPM, volume),
        "trade_intensity_millihertz": rate("nt"),
        "quote_intensity_millihertz": rate("nq"),
        "cross_venue_divergence_half_ticks": (F.col("bv1") - F.col("bv2")) * 2,
        "bid_leader_venue_number": F.col("bl"),
        "ask_leader_venue_number": F.col("al"),
        "venue_leadership_share_ppm": mul_div("led", PPM, "n"),
        "replenishment_rate_millihertz": rate("nr"),
        "data_quality_code": F.when(crossed, 1).otherwise(0),
        "data_age_us": age,
        "session_progress_ppm": F.expr(f"t % {DAY_US} * 1000000 div {DAY_US}"),
    }
    return e.select("event_id", *(v.cast("long").alias(k) for k, v in values.items()), validity.alias("validity"))


def _journal(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders").select("o_orderkey", F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus").alias("payload"))
    return J.write(o, "o_orderkey", "payload")


def _spoiled(rows: DataFrame) -> DataFrame:
    return rows.withColumn("payload", F.when(F.col("sequence") == 7919, F.lit("spoiled")).otherwise(F.col("payload")))


def journal_links(spark: SparkSession, d: str) -> DataFrame:
    """Orders appended as a journal: each segment's span, digest and link in the chain."""
    return _journal(spark, d)[1]


def journal_verify(spark: SparkSession, d: str) -> DataFrame:
    """The same with one record spoiled afterwards."""
    rows, links = _journal(spark, d)
    return J.verify(_spoiled(rows), links)


def journal_point(spark: SparkSession, d: str) -> DataFrame:
    """Single records by number, before and behind the spoiled one, and one that isn't there."""
    rows, links = _journal(spark, d)
    return J.lookup(_spoiled(rows), links, [1, 999, 1000, 7919, 9000, 10**12])


def journal_range(spark: SparkSession, d: str) -> DataFrame:
    """Verified records of a range that ends behind the spoiled one."""
    rows, links = _journal(spark, d)
    return J.between(_spoiled(rows), links, 500, 9_500)


QUERIES = {f.__name__: f for f in (feature_snapshot, journal_links, journal_verify, journal_point, journal_range)}


def _td(a: str, k: int | str, b: str) -> str:
    return f"cast(case when ({b}) <> 0 then sign({a}) * (abs(cast({a} as hugeint)) * {k} // ({b})) end as bigint)"


_U = "partition by user_id order by t"
_NOW, _PREV, _WIN = f"({_U} rows between unbounded preceding and current row)", f"({_U} rows between unbounded preceding and 1 preceding)", f"({_U} range between {SPAN} preceding and current row)"


def _last(cond: str, x: str, over: str = _NOW) -> str:
    return f"last_value(case when {cond} then {x} end ignore nulls) over {over}"


def _rate(x: str) -> str:
    return f"{x} * 1000000000 // span"


_B, _A, _T, _Q = "event_type = 'view'", "event_type = 'click'", "event_type in ('purchase', 'error')", "event_type in ('view', 'click')"
_JOURNAL = """with recursive r as (select o_orderkey // 1000 as segment, o_orderkey as sequence, concat_ws('|', o_orderkey, o_custkey, o_orderstatus) as payload from orders),
g as (select segment, min(sequence) as first_sequence, max(sequence) as last_sequence, count(*) as n_rows, sha256(string_agg(sha256(payload), '' order by sequence)) as digest, row_number() over (order by segment) as i from r group by 1),
bad as (select min(segment) as b from r where sequence = 7919)
"""
SQL = {
    "feature_snapshot": E
    + f""", a as (select event_id, user_id, t, event_type, ticks, qty, event_id % 2 + 1 as venue from e),
b as (select *, {_last(_B, 'ticks')} as bp, {_last(_B, 'qty + 1')} as bq, {_last(_A, 'ticks + 3000')} as ap, {_last(_A, 'qty + 1')} as aq, {_last(_B, 'qty + 1', _PREV)} as pbq, {_last(_A, 'qty + 1', _PREV)} as paq,
  {_last(_B + ' and venue = 1', 'ticks')} as bv1, {_last(_B + ' and venue = 2', 'ticks')} as bv2, {_last(_A + ' and venue = 1', 'ticks')} as av1, {_last(_A + ' and venue = 2', 'ticks')} as av2, {_last(_Q, 't')} as qt, lag(event_type) over ({_U}) as before_, t - min(t) over {_WIN} + 1 as span from a),
c as (select *, bp + ap as mid2, case when {_B} then qty + 1 - coalesce(pbq, 0) when {_A} then coalesce(paq, 0) - qty - 1 else 0 end as flow,
  case when bv1 is null and bv2 is null then null when bv2 is null or bv1 >= bv2 then 1 else 2 end as bl, case when av1 is null and av2 is null then null when av2 is null or av1 <= av2 then 1 else 2 end as al from b),
d0 as (select *, lag(mid2) over ({_U}) as pm from c), d as (select *, coalesce({_td('mid2 - pm', 1000000, 'pm')}, 0) as r from d0),
f as (select *, coalesce(sum(case when {_B} then qty + 1 end) over {_WIN}, 0) as sb, coalesce(sum(case when {_A} then qty + 1 end) over {_WIN}, 0) as sa, sum(flow) over {_WIN} as ofi, coalesce(sum(case when event_type = 'purchase' then qty end) over {_WIN}, 0) as bought,
  coalesce(sum(case when event_type = 'error' then qty end) over {_WIN}, 0) as sold, coalesce(sum(case when {_T} then cast(ticks as hugeint) * qty end) over {_WIN}, 0) as notional, count(*) filter ({_Q}) over {_WIN} as nq, count(*) filter (event_type = 'signup') over {_WIN} as nc,
  count(*) filter ({_T}) over {_WIN} as nt, count(*) filter ({_B} and before_ = 'purchase') over {_WIN} as nr, first_value(mid2 ignore nulls) over {_WIN} as mid0, sum(cast(r as hugeint) * r) over {_WIN} as rr, count(*) over {_WIN} as n, count(*) filter (bl = 1) over {_WIN} as led from d),
g as (select event_id, mid2 as midpoint_half_ticks, ap - bp as spread_ticks, {_td('ap - bp', 2000000, 'mid2')} as relative_spread_ppm, (cast(ap as hugeint) * bq + cast(bp as hugeint) * aq) * 1000000 // (bq + aq) as microprice_ticks_ppm, {_td('bq - aq', 1000000, 'bq + aq')} as top_level_imbalance_ppm,
  {_td('bq + sb - aq - sa', 1000000, 'bq + sb + aq + sa')} as multi_level_weighted_imbalance_ppm, ofi as order_flow_imbalance_units, {_td('bought - sold', 1000000, 'bought + sold')} as signed_trade_imbalance_ppm, {_rate('nq')} as add_rate_millihertz, {_rate('nc')} as cancel_rate_millihertz,
  {_rate('nt')} as execute_rate_millihertz, (bought + sold) * 1000000 // span as queue_depletion_rate_units_per_second, {half_away('(cast(mid2 as hugeint) - mid0) * 1000000', 'mid0')} as rolling_return_ppm, floor(sqrt(rr // n)) as realized_volatility_ppm, bought + sold as volume_units,
  case when bought + sold > 0 then notional * 1000000 // (bought + sold) end as vwap_ticks_ppm, {_rate('nt')} as trade_intensity_millihertz, {_rate('nq')} as quote_intensity_millihertz, (bv1 - bv2) * 2 as cross_venue_divergence_half_ticks, bl as bid_leader_venue_number, al as ask_leader_venue_number,
  led * 1000000 // n as venue_leadership_share_ppm, {_rate('nr')} as replenishment_rate_millihertz, case when ap <= bp then 1 else 0 end as data_quality_code, t - qt as data_age_us, t % {DAY_US} * 1000000 // {DAY_US} as session_progress_ppm,
  case when mid2 is null then 'MISSING' when ap <= bp then 'INVALID' when t - qt > {STALE_US} then 'STALE' when nq < {LEAST_QUOTES} then 'WARMING' else 'VALID' end as validity from f)
select event_id, cast(columns(* exclude (event_id, validity)) as bigint), validity from g""",
    "journal_links": _JOURNAL + ", k as (select *, sha256(digest) as link from g where i = 1 union all select g.*, sha256(k.link || g.digest) from k join g on g.i = k.i + 1) select segment, first_sequence, last_sequence, n_rows, digest, link from k",
    "journal_verify": _JOURNAL + "select segment, case when b is null or segment < b then 'OK' when segment = b then 'CORRUPT' else 'UNVERIFIED' end as state from g, bad",
    "journal_point": _JOURNAL
    + """, w as (select unnest([1, 999, 1000, 7919, 9000, 1000000000000]) as sequence) select w.sequence, case when w.sequence = 7919 and payload is not null then 'spoiled' else payload end as payload,
  case when payload is null then 'NOT_FOUND' when b is null or segment < b then 'OK' when segment = b then 'CORRUPT' else 'UNVERIFIED' end as state from w left join r using (sequence), bad""",
    "journal_range": _JOURNAL + "select sequence, payload from r, bad where sequence between 500 and 9500 and (b is null or segment < b) order by 1",
}
