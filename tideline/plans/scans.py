"""Queries on sources, sinks, streams and options. Files are written from the tables into the shared folder and scanned."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions.options import implied_volatility, option_delta, option_price
from tideline.operators.grid import clean_symbol
from tideline.session import shared_dir, table
from tideline.sources import feeds, sinks
from tideline.streaming import feeds as live

CENTS = "round({} * 100)"


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _bars(spark: SparkSession, d: str) -> DataFrame:
    cents = lambda x: F.round(F.col(x) * 100).cast("long").alias(x)
    return table(spark, d, "raw_bars").select("symbol", "t", *(cents(x) for x in "ohlc"), "v")


def _summary(df: DataFrame) -> DataFrame:
    return df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c"), F.sum("v").alias("v"), F.min("t").alias("first_t"))


def scan_ndjson(spark: SparkSession, d: str) -> DataFrame:
    p = _place(spark, "ndjson")
    _bars(spark, d).write.json(p)
    return _summary(feeds.scan(spark, "ndjson", p))


def scan_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a map from symbol to bars, cut so that a page holds some hundred of them."""
    p = _place(spark, "pages")
    b = table(spark, d, "raw_bars")
    cut = F.expr("bar_id div 500")
    page = b.groupBy(cut.alias("page"), "symbol").agg(F.collect_list(F.struct("t", "o", "h", "l", "c", "v")).alias("x")).groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("symbol", "x"))).alias("bars"))
    page.select("bars").write.json(p)
    return feeds.scan(spark, "pages", p).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("c") * 100).cast("long")).alias("c"), F.sum("v").alias("v"))


def scan_columnar(spark: SparkSession, d: str) -> DataFrame:
    """Documents of parallel arrays, filtered by kind and date after the zip."""
    p = _place(spark, "columnar")
    o = table(spark, d, "orders").select(F.expr("o_orderkey div 1000").alias("g"), F.struct(F.col("o_orderkey").alias("id"), F.coalesce("o_orderstatus", F.lit("")).alias("form"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).alias("r"))
    g = o.groupBy("g").agg(F.collect_list("r").alias("r"))
    g.select(*(F.transform("r", _field(f)).alias(f) for f in ("id", "form", "day"))).write.json(p)
    rows = feeds.scan(spark, "columnar", p, fields={"id": "bigint", "form": "string", "day": "string"})
    return rows.where(F.col("form").isin("F", "O") & F.col("day").between("1997-01-01", "1999-12-31")).select("id", "form", "day")


def _field(name: str):
    return lambda x: x[name]


def scan_facts(spark: SparkSession, d: str) -> DataFrame:
    """Four levels of nested facts."""
    p = _place(spark, "facts")
    li = table(spark, d, "lineitem").select(F.expr("l_orderkey div 1000").alias("entity"), F.col("l_returnflag").alias("taxonomy"), F.col("l_linestatus").alias("concept"), F.concat(F.lit("U"), F.col("l_linenumber") % 2).alias("unit"), F.struct(F.date_format("l_shipdate", "yyyy-MM-dd").alias("end"), F.col("l_quantity").cast("decimal(38,6)").alias("val"), F.lit("2024-01-01").alias("filed")).alias("o"))
    for keep, key, val in ((["entity", "taxonomy", "concept", "unit"], None, "o"), (["entity", "taxonomy", "concept"], "unit", "o"), (["entity", "taxonomy"], "concept", "o"), (["entity"], "taxonomy", "o")):
        li = li.groupBy(*keep).agg((F.collect_list(val) if key is None else F.map_from_entries(F.collect_list(F.struct(key, val)))).alias("o"))
    li.withColumnRenamed("o", "facts").write.json(p)
    return feeds.scan(spark, "facts", p).groupBy("taxonomy", "concept", "unit").agg(F.count(F.lit(1)).alias("n"), F.sum("val").cast("long").alias("total"), F.max("end").alias("last_end"))


def scan_vintages(spark: SparkSession, d: str) -> DataFrame:
    p = _place(spark, "vintages")
    o = table(spark, d, "orders").select(F.expr("o_orderkey div 1000").alias("g"), F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.date_format(F.date_add("o_orderdate", 30), "yyyy-MM-dd").alias("realtime_start"), F.lit("9999-12-31").alias("realtime_end"), F.when(F.col("o_orderkey") % 9 == 0, ".").otherwise(F.format_string("%.2f", "o_totalprice")).alias("value")).alias("o"))
    o.groupBy("g").agg(F.collect_list("o").alias("observations")).select("observations").write.json(p)
    return feeds.scan(spark, "vintages", p).groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("present"), F.sum((F.col("value") * 100).cast("long")).alias("cents"), F.max("known_from").cast("string").alias("last_known"))


def scan_csv(spark: SparkSession, d: str) -> DataFrame:
    p = _place(spark, "csv")
    table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey").write.option("header", True).csv(p)
    return feeds.scan(spark, "csv", p, schema="s_suppkey bigint, s_name string, s_nationkey int")


def scan_symbols(spark: SparkSession, d: str) -> DataFrame:
    """A list of symbols as text with spoiled lines, by state."""
    p = _place(spark, "symbols")
    s = table(spark, d, "minute_readings").select("symbol").distinct()
    s.coalesce(1).write.text(p)
    return feeds.scan(spark, "symbols", p).groupBy("state").agg(F.countDistinct("symbol").alias("symbols"))


def scan_journal(spark: SparkSession, d: str) -> DataFrame:
    """Framed binary segments of a thousand orders each, written in tasks; of five segments one is cut and one spoiled at its end."""
    p = _place(spark, "journal")

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        from pyarrow.fs import FileSystem

        k = int(pdf["segment"].iloc[0])
        data = bytearray(feeds.journal_bytes([f"{x:08d}".encode() for x in sorted(pdf["o_orderkey"])], k * 1000))
        if k % 5 == 2:
            data = data[:-5]
        if k % 5 == 3:
            data[-1] ^= 1
        fs, path = FileSystem.from_uri(p)
        fs.create_dir(path)
        with fs.open_output_stream(f"{path}/seg-{k}") as out:
            out.write(bytes(data))
        return pd.DataFrame({"segment": [k]})

    o = table(spark, d, "orders").select("o_orderkey", F.expr("o_orderkey div 1000").alias("segment"))
    o.groupBy("segment").applyInPandas(write, "segment long").count()
    return feeds.scan(spark, "journal", p).select("segment", "sequence", "state")


def scan_verified(spark: SparkSession, d: str) -> DataFrame:
    """A parquet scan with a stated schema and checked order of all rows."""
    rows = feeds.verified_parquet(spark, f"{d}/events.parquet", "event_id bigint, user_id bigint, value double", "user_id", "event_id")
    return rows.select("event_id", "user_id")


def synthetic_source(spark: SparkSession, d: str) -> DataFrame:
    """Bars of the Python data source: sessions and minutes per symbol."""
    spark.dataSource.register(feeds.SyntheticBars)
    b = spark.read.format("synthetic_bars").options(symbols="AAA,BBB", first="2024-01-01", last="2024-01-14", minutes="30").load()
    return b.groupBy("symbol").agg(F.countDistinct("day").alias("sessions"), F.count(F.lit(1)).alias("minutes"), F.count_if((F.col("h") < F.col("c")) | (F.col("l") > F.col("c"))).alias("broken"))


def dated_universe(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "session_summaries").select(clean_symbol("source_ticker").alias("symbol")).distinct()
    return feeds.dated_universe(spark, "2011-01-01", "2011-02-15", s).select("symbol", F.col("day").cast("string").alias("day"))


def published_dataset(spark: SparkSession, d: str) -> DataFrame:
    """A data set published twice under one key: written once, its manifest returned again."""
    p = _place(spark, "published")
    df = table(spark, d, "orders")
    first = sinks.publish(df, p, {"table": "orders", "version": 1})
    again = sinks.publish(df.limit(0), p, {"table": "orders", "version": 1})
    return spark.read.parquet(f"{p}/data").agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(first["rows"]).alias("rows"), F.lit(first == again).alias("same"))


def report_sink(spark: SparkSession, d: str) -> DataFrame:
    """Parts as JSON documents with their own hash, written, read, decoded and checked."""
    p = _place(spark, "report")
    sinks.report_json(table(spark, d, "part"), "p_partkey", "p_name", "p_size").write.json(p)
    r = spark.read.schema("document string, sha256 string").json(p)
    back = F.from_json("document", "p_partkey bigint, p_name string, p_size int")
    return r.where(F.sha2("document", 256) == F.col("sha256")).select(back.alias("r")).select("r.*")


def upsert_minimum(spark: SparkSession, d: str) -> DataFrame:
    """Insert-or-keep-smallest of two batches of orders by customer and date."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    a, b = o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 = 0")
    u = a.unionByName(b).groupBy("o_custkey", "o_orderdate").agg(F.min("o_orderkey").alias("o_orderkey"), F.count(F.lit(1)).alias("seen"))
    return u.select("o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderkey", "seen")


def retention_plan(spark: SparkSession, d: str) -> DataFrame:
    """Segments that may go: all but the newest five days of each kind of event, and those only beyond 100 rows kept."""
    g = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("event_type").orderBy(F.desc("day"))
    g = g.withColumn("age", F.row_number().over(w)).withColumn("newer", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return g.where("age > 5 and newer >= 100").select("event_type", F.col("day").cast("string").alias("day"), "n")


def repaired_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The rows before the first bad one of each user: what a repair by copying keeps."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    bad = F.max(F.when((F.col("event_type") == "error") & (F.col("value") > 15), 1).otherwise(0)).over(w)
    return table(spark, d, "events").withColumn("bad", bad).where("bad = 0").groupBy("user_id").agg(F.count(F.lit(1)).alias("kept"))


def _stream(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return live.file_stream(spark, f"{d}/events.parquet", e.schema).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_window_counts(spark: SparkSession, d: str) -> DataFrame:
    """Hourly windows of the stream that the watermark has closed; the open rest is in no result yet."""
    out = live.run_to_table(live.windowed_counts(_stream(spark, d)), "windows")
    return out.select(F.unix_micros("start").alias("start_us"), "event_type", "n", "ticks")


def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    doubled = _stream(spark, d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return live.run_to_table(live.deduplicated(doubled, ["event_id"], None).select("event_id", "user_id"), "dedup")


def stream_reordered(spark: SparkSession, d: str) -> DataFrame:
    """Rows of four channels, some lost, as they came by their time; in sequence again, with the gaps told, and what still waits at the end."""
    rows = _stream(spark, d).where("event_id % 50 <> 7").select((F.col("event_id") % 4).alias("channel"), F.expr("event_id div 4").alias("sequence"), F.col("event_type").alias("payload"), "ts")
    base = live.place(spark, "reordered")
    return live.run_to_table(live.reordered(rows, arrival=["ts"]), "reordered", base=base).unionByName(live.waiting(spark, base))


QUERIES = {
    f.__name__: f
    for f in (
        scan_ndjson, scan_pages, scan_columnar, scan_facts, scan_vintages, scan_csv, scan_symbols, scan_journal, scan_verified, synthetic_source, dated_universe, published_dataset,
        report_sink, upsert_minimum, retention_plan, repaired_prefix, stream_window_counts, stream_dedup, stream_reordered,
    )
}


def _options(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", (F.col("p_partkey") % 2 == 0).alias("call"), F.lit(100.0).alias("spot"), (F.lit(70.0) + F.col("p_size")).alias("strike"), ((F.col("p_partkey") % 12 + 1) / 12.0).alias("years"), F.lit(0.03).alias("rate"), F.lit(0.01).alias("dividend"), (F.lit(0.1) + (F.col("p_partkey") % 40) / 100.0).alias("vol"))


_IN = ("call", "spot", "strike", "years", "rate", "dividend")


def option_values(spark: SparkSession, d: str) -> DataFrame:
    o = _options(spark, d)
    return o.select("p_partkey", F.round(option_price(*_IN, "vol"), 8).alias("price"), F.round(option_delta(*_IN, "vol"), 8).alias("delta"))


def option_implied(spark: SparkSession, d: str) -> DataFrame:
    """Volatility found back from the price."""
    o = _options(spark, d).withColumn("price", option_price(*_IN, "vol"))
    return o.select("p_partkey", "vol", F.round(implied_volatility("price", *_IN), 6).alias("implied"))


def calendar_variance(spark: SparkSession, d: str) -> DataFrame:
    """Points of a surface whose total variance falls with expiry for the same strike and right."""
    o = _options(spark, d).groupBy("call", "strike", "years").agg(F.max("vol").alias("vol"))
    v = F.col("vol") * F.col("vol") * F.col("years")
    w = Window.partitionBy("call", "strike").orderBy("years")
    return o.withColumn("v", v).withColumn("p", F.lag("v").over(w)).where(F.col("v") < F.col("p") - 1e-15).groupBy("call").agg(F.count(F.lit(1)).alias("breaches"))


def strike_convexity(spark: SparkSession, d: str) -> DataFrame:
    """Triples of strikes where the middle price lies above its neighbours' line."""
    o = table(spark, d, "part").groupBy(F.col("p_brand").alias("expiry"), F.col("p_size").alias("k")).agg(F.min(F.round(F.col("p_retailprice") * 100).cast("long")).alias("price"))
    w = Window.partitionBy("expiry").orderBy("k")
    o = o.select("expiry", "k", "price", F.lag("k").over(w).alias("k0"), F.lag("price").over(w).alias("p0"), F.lead("k").over(w).alias("k2"), F.lead("price").over(w).alias("p2"))
    bad = (F.col("price") - F.col("p0")) * (F.col("k2") - F.col("k")) > (F.col("p2") - F.col("price")) * (F.col("k") - F.col("k0"))
    return o.where("k0 is not null and k2 is not null").groupBy("expiry").agg(F.count_if(bad).alias("breaches"), F.count(F.lit(1)).alias("triples"))


QUERIES |= {f.__name__: f for f in (option_values, option_implied, calendar_variance, strike_convexity)}

_B = "with b as (select symbol, t, cast(round(c * 100) as bigint) as c, v from raw_bars)\n"
SQL = {
    "scan_ndjson": _B + "select symbol, count(*) as n, cast(sum(c) as bigint) as c, cast(sum(v) as bigint) as v, min(t) as first_t from b group by 1",
    "scan_pages": _B + "select symbol, count(*) as n, cast(sum(c) as bigint) as c, cast(sum(v) as bigint) as v from b group by 1",
    "scan_columnar": "select o_orderkey as id, o_orderstatus as form, strftime(o_orderdate, '%Y-%m-%d') as day from orders where o_orderstatus in ('F', 'O') and o_orderdate between '1997-01-01' and '1999-12-31'",
    "scan_facts": "select l_returnflag as taxonomy, l_linestatus as concept, 'U' || (l_linenumber % 2) as unit, count(*) as n, cast(sum(l_quantity) as bigint) as total, strftime(max(l_shipdate), '%Y-%m-%d') as last_end from lineitem group by 1, 2, 3",
    "scan_vintages": "select cast(year(o_orderdate) as integer) as year, count(*) as n, count(*) filter (o_orderkey % 9 <> 0) as present, cast(sum(case when o_orderkey % 9 <> 0 then cast(round(o_totalprice * 100) as bigint) end) as bigint) as cents, strftime(max(o_orderdate) + interval 30 day, '%Y-%m-%d') as last_known from orders group by 1",
    "scan_csv": "select s_suppkey, s_name, s_nationkey from supplier",
    "scan_symbols": """with s as (select trim(symbol) as s, count(*) as n, regexp_full_match(trim(symbol), '[A-Z][A-Z0-9.]{0,9}') as ok from (select distinct symbol from minute_readings) group by 1)
select case when ok then 'OK' else 'INVALID' end as state, count(*) as symbols from s group by 1 union all select 'DUPLICATE', count(*) from s where ok and n > 1 having count(*) > 0""",
    "scan_journal": """select 'seg-' || k as segment, k * 1000 + i - 1 as sequence, case when i < n then 'OK' when k % 5 = 2 then 'TORN' when k % 5 = 3 then 'BAD_CHECKSUM' else 'OK' end as state
  from (select o_orderkey // 1000 as k, row_number() over (partition by o_orderkey // 1000 order by o_orderkey) as i, count(*) over (partition by o_orderkey // 1000) as n from orders)""",
    "scan_verified": "select event_id, user_id from events",
    "synthetic_source": "select unnest(['AAA', 'BBB']) as symbol, 10::bigint as sessions, 300::bigint as minutes, 0::bigint as broken",
    "dated_universe": "select symbol, strftime(day, '%Y-%m-%d') as day from (select distinct upper(trim(source_ticker)) as symbol from session_summaries), (select unnest(generate_series(timestamp '2011-01-01', timestamp '2011-02-15', interval 1 day)) as day) where isodow(day) < 6",
    "published_dataset": "select count(*) as n, cast(count(*) as integer) as rows, true as same from orders",
    "report_sink": "select p_partkey, p_name, p_size from part",
    "upsert_minimum": "select o_custkey, strftime(o_orderdate, '%Y-%m-%d') as day, min(o_orderkey) as o_orderkey, count(*) as seen from (select * from orders where o_orderkey % 2 = 0 union all select * from orders where o_orderkey % 3 = 0) group by 1, 2",
    "retention_plan": """with g as (select event_type, cast(ts as date) as day, count(*) as n from events group by 1, 2)
select event_type, cast(day as varchar) as day, n from (select *, row_number() over (partition by event_type order by day desc) as age, coalesce(sum(n) over (partition by event_type order by day desc rows between unbounded preceding and 1 preceding), 0) as newer from g) where age > 5 and newer >= 100""",
    "repaired_prefix": "select user_id, count(*) as kept from (select user_id, max(case when event_type = 'error' and value > 15 then 1 else 0 end) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as bad from events) where bad = 0 group by 1",
    "stream_window_counts": "select epoch_us(date_trunc('hour', ts)) as start_us, event_type, count(*) as n, cast(sum(cast(round(value * 100) as bigint)) as bigint) as ticks from events where date_trunc('hour', ts) + interval 1 hour <= (select max(ts) - interval 1 hour from events) group by 1, 2",
    "stream_dedup": "select event_id, user_id from events",
    "stream_reordered": """with p as (select event_id % 4 as channel, event_id // 4 as s, event_type as payload from events where event_id % 50 <> 7),
n as (select *, lead(s) over (partition by channel order by s) as nx, count(*) over (partition by channel order by s desc rows between unbounded preceding and 1 preceding) as later from p),
g as (select channel, s + 1 as a, nx - s - 1 as k, later from n where nx > s + 1), stop as (select channel, min(a) as a from g where later <= 32 group by 1)
select channel, s as sequence, payload, case when s > stop.a then 'WAITING' else 'OK' end as state from p left join stop using (channel) union all select channel, a, cast(k as varchar), 'GAP' from g where later > 32""",
    "calendar_variance": """with o as (select p_partkey % 2 = 0 as call, 70.0::double + p_size as strike, (p_partkey % 12 + 1) / 12.0::double as years, max(0.1::double + (p_partkey % 40) / 100.0::double) as vol from part group by 1, 2, 3)
select call, count(*) as breaches from (select call, vol * vol * years as v, lag(vol * vol * years) over (partition by call, strike order by years) as p from o) where v < p - 1e-15 group by 1""",
    "strike_convexity": """with o as (select p_brand as expiry, p_size as k, min(cast(round(p_retailprice * 100) as bigint)) as price from part group by 1, 2),
t as (select expiry, k, price, lag(k) over w as k0, lag(price) over w as p0, lead(k) over w as k2, lead(price) over w as p2 from o window w as (partition by expiry order by k))
select expiry, count(*) filter ((price - p0) * (k2 - k) > (p2 - price) * (k - k0)) as breaches, count(*) as triples from t where k0 is not null and k2 is not null group by 1""",
}
