"""Column helpers against Python, and operators against plain folds."""

import math
import random
from fractions import Fraction

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.functions import hashing, ints, text, times
from tideline.operators import folds, quantiles, temporal
from tideline.sources import feeds, sinks


def test_divisions(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(-(10**12), 10**12), rng.choice([1, -1]) * rng.randrange(1, 10**4)) for _ in range(300)] + [(5, 2), (-5, 2), (5, -2), (7, 2), (0, 3), (3, 0), (None, 1)]
    df = spark.createDataFrame(rows, "n long, d long")
    out = df.select("n", "d", ints.trunc_div("n", "d"), ints.floor_div("n", "d"), ints.half_away_div("n", "d"), ints.half_even_div("n", "d"), ints.exact_div("n", "d")).collect()
    for n, d, tr, fl, ha, he, ex in out:
        if n is None or d == 0:
            assert (tr, fl, ha, he, ex) == (None,) * 5
            continue
        q = Fraction(n, d)
        assert tr == math.trunc(q) and fl == math.floor(q) and he == round(q)
        assert ha == (math.floor(abs(q) + Fraction(1, 2)) * (1 if q >= 0 else -1))
        assert ex == (n // d if n % d == 0 else None)


def test_wide_division(spark):
    rows = [(10**30 + 7, 13), (-(10**30) - 7, 13), (5, 2), (-5, 2), (1, 0)]
    got = [r[0] for r in spark.createDataFrame([(str(a), b) for a, b in rows], "n string, d long").select(ints.wide_div(F.col("n").cast("decimal(38,0)"), "d")).collect()]
    assert [None if x is None else int(x) for x in got] == [(10**30 + 7) // 13, -((10**30 + 7) // 13), 2, -2, None]


def test_isqrt_gcd_sigmoid(spark):
    rng = random.Random(3)
    xs = [0, 1, 2, 3, 4, 2**53 + 1, 2**62] + [rng.randrange(10**rng.randrange(1, 18)) for _ in range(100)] + [k * k + e for k in (10**8, 3037000498) for e in (-1, 0, 1)]
    for r in spark.createDataFrame([(x, 36) for x in xs], "x long, y long").select("x", ints.isqrt("x").alias("r"), ints.gcd("x", "y").alias("g")).collect():
        assert r.r == math.isqrt(r.x) and r.g == math.gcd(r.x, 36)
    for big in ((2**62) ** 2, (2**62 - 5) ** 2 - 1, 10**37 + 12345):
        got = spark.sql(f"select cast('{big}' as decimal(38,0)) as x").select(ints.isqrt("x")).first()[0]
        assert got == math.isqrt(big)
    assert spark.sql(f"select cast('{10**38 - 1}' as decimal(38,0)) as x").select(ints.isqrt("x")).first()[0] is None
    s = [r[0] for r in spark.range(-9, 10).select(ints.sigmoid_ppm(F.col("id") * 1_000_000)).collect()]
    assert s == sorted(s) and s[9] == 500_000 and s[0] == s[1]


def test_times(spark):
    rows = [("2011-01-03T14:30:00Z",), ("2011-01-03T14:30:00.000000007Z",), ("2011-01-03T08:30:00-06:00",), ("2011-01-03t14:30:00z",), (" 2011-01-03T14:30:00+00:00 ",), ("bad",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(times.rfc3339_ns("t")).collect()]
    base = 1_294_065_000 * 10**9
    assert got == [base, base + 7, base, base, base, None, None]
    u = [r[0] for r in spark.createDataFrame([(base,), (base // 1000,), (base // 10**6,), (base // 10**9,), (None,)], "t long").select(times.instant_ns("t")).collect()]
    assert u == [base] * 4 + [None]
    assert spark.createDataFrame([(-1,)], "t long").select(times.floor_to("t", 60)).first()[0] == -60


def test_text(spark):
    row = spark.createDataFrame([("ACME  Corp. /DE/ Inc", "HTTPS://Ex.Com:443/a?q#f", "http://u@h/x", "x;A_B,3; a_b,4;;", "api_key=abc&t=1")], "a string, b string, c string, d string, e string").select(
        text.entity_key("a"), text.alias_keys("a"), text.normal_url("b"), text.normal_url("c"), text.themes("d"), text.organisations("d"), text.redact("e")
    ).first()
    assert row[0] == "acme corp inc" and row[1] == ["acme corp inc", "acme"]
    assert row[2] == "https://ex.com/a" and row[3] is None
    assert row[4] == ["A_B", "X"] and row[5] == ["x", "A_B", "a_b"] and row[6] == "api_key=[REDACTED]&t=1"
    html = spark.createDataFrame([("<p>a<b>b</b></p><script>x</script>c &amp; d",), (None,), ("",)], "t string").select(text.visible_text("t")).collect()
    assert [r[0] for r in html] == ["ab c & d", None, ""]
    assert spark.createDataFrame([("ABC   240315C00012500",), ("nope",)], "s string").select(text.option_symbol("s").alias("o")).select("o.strike_milli").collect()[0][0] == 12500


def test_hashes(spark):
    def fnv(s):
        h = 0xCBF29CE484222325
        for b in s.encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        return h - 2**64 if h >= 2**63 else h

    words = ["", "a", "foobar", "é" * 40, "zz"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words] + [(None,)], "s string").coalesce(1).select(hashing.fnv1a("s")).collect()]
    assert got == [*map(fnv, words), None]
    import hashlib

    b = spark.createDataFrame([(w,) for w in words], "s string").select("s", hashing.hash_bucket("s", 8)).collect()
    assert all(r[1] == int(hashlib.sha256(r[0].encode()).hexdigest()[:16], 16) % 8 for r in b)
    n = spark.range(1000).select(hashing.counter_sample(F.lit(7), F.col("id"), F.lit(10)).alias("x")).groupBy("x").count().collect()
    assert len(n) == 10 and min(r["count"] for r in n) > 50


def test_lower_rank(spark):
    rng = random.Random(4)
    rows = [("hot" if i % 2 else str(i % 3), rng.choice([7, rng.randrange(100)])) for i in range(500)] + [("hot", None)]
    got = {r.k: r for r in quantiles.lower_rank(spark.createDataFrame(rows, "k string, x long"), ["k"], "x", {"p50": 500, "p999": 999}, bucket_rows=20).collect()}
    for k in {r[0] for r in rows}:
        xs = sorted(x for kk, x in rows if kk == k and x is not None)
        assert (got[k].n, got[k].p50, got[k].p999) == (len(xs), xs[(len(xs) - 1) * 500 // 1000], xs[(len(xs) - 1) * 999 // 1000])


def test_interval_joins(spark):
    rng = random.Random(6)
    pts = [(i, rng.choice("ab"), rng.randrange(-200, 200)) for i in range(80)]
    ivs = [(i, rng.choice("ab"), s, s + rng.choice([0, 1, 5, 150])) for i, s in enumerate(rng.randrange(-200, 200) for _ in range(60))]
    p, v = spark.createDataFrame(pts, "i long, k string, t long"), spark.createDataFrame(ivs, "j long, k string, s long, e long")
    got = {(r.i, r.j) for r in temporal.interval_stab(p, v, ["k"], "t", "s", "e", 10).collect()}
    assert got == {(i, j) for i, k, t in pts for j, q, s, e in ivs if k == q and s <= t < e}
    o = v.select(F.col("j").alias("j2"), "k", F.col("s").alias("s2"), F.col("e").alias("e2"))
    pairs = [(r.j, r.j2) for r in temporal.interval_overlap(v, o, ["k"], ("s", "e"), ("s2", "e2"), 10).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(a[0], b[0]) for a in ivs for b in ivs if a[1] == b[1] and a[2] < b[3] and b[2] < a[3] and a[3] > a[2] and b[3] > b[2]}


def test_asof_orders_differ(spark):
    rows = [("k", 1, 500), ("k", 2, 210)]
    df = spark.createDataFrame(rows, "k string, version int, available long")
    a = temporal.as_known_at(df, 1000, ["k"], ["version"], "available", "version").first()
    b = temporal.as_known_at(df, 1000, ["k"], ["version"], "available", "version", by_availability=True).first()
    assert (a.version, b.version) == (2, 1)
    assert temporal.as_known_at(df, 210, ["k"], ["version"], "available", "version", strict=True).count() == 0


def test_limiter_counts_admitted_only(spark):
    rows = [("u", i, t) for i, t in enumerate([0, 1, 2, 3, 10, 11, 12])]
    df = spark.createDataFrame(rows, "u string, i long, t long")
    got = folds.ordered_fold(df, ["u"], ["t"], lambda: None, folds.admit_step(2, 10), ["i", "t"], "i long, ok boolean").orderBy("i").collect()
    assert [r.ok for r in got] == [True, True, False, False, True, True, False]


def test_average_cost():
    state, out = None, []
    for row in [(1, 10, 1000, 1), (2, 10, 1200, 1), (3, -5, 700, 0), (4, -20, 2800, 0)]:
        state, told = folds.average_cost_step(state, row)
        out.append(told)
    assert out[1] == (2, 20, 2200, -2) and out[2] == (3, 15, 1650, 148) and out[3][1:3] == (-5, -700) and out[3][3] == 148 + 2100 - 1650


def _naive_book(state, op, oid, side, price, qty):
    """A list of orders in priority, everything worked out anew; levels set as one order without an id."""
    orders, valid, status, trade, auction, saved = state or ([], True, "OPEN", None, None, None)
    error = None
    best = lambda s, os: (max if s == "B" else min)((p for _, x, p, _ in os if x == s), default=None)
    crosses = lambda os: (o := best("A" if side == "B" else "B", os)) is not None and (price >= o if side == "B" else price <= o)
    found = [x for x in orders if x[0] == oid and oid is not None]
    if op == "CLEAR_BOOK":
        return ([], True, status, trade, auction, saved), None
    if op == "RESTORE":
        return (*(saved or ([], True, "OPEN", None, None)), saved), None
    if not valid:
        return (orders, valid, status, trade, auction, saved), "BOOK_INVALID"
    if op in ("ADD", "REPLACE", "SET_LEVEL") and (price <= 0 or qty <= 0):
        error = "INVALID_SHAPE"
    elif op == "ADD":
        error = "DUPLICATE_ORDER" if found else "CROSSED" if crosses(orders) else None
        orders = orders if error else [*orders, (oid, side, price, qty)]
    elif op in ("CANCEL", "EXECUTE", "DELETE", "PARTIAL_CANCEL", "PARTIAL_EXECUTE", "REPLACE"):
        if not found:
            error = "ORDER_NOT_FOUND"
        elif op.startswith("PARTIAL"):
            error = None if 0 < qty < found[0][3] else "QUANTITY_MISMATCH"
            orders = orders if error else [(o, s, p, q - qty) if o == oid else (o, s, p, q) for o, s, p, q in orders]
        else:
            rest = [x for x in orders if x[0] != oid]
            if op == "REPLACE":
                error = "CROSSED" if crosses(rest) else None
                rest = orders if error else [*rest, (oid, side, price, qty)]
            orders = rest
    elif op in ("SET_LEVEL", "DELETE_LEVEL"):
        rest = [x for x in orders if x[1:3] != (side, price)]
        if op == "SET_LEVEL":
            error = "CROSSED" if crosses(orders) else None
            rest.append((None, side, price, qty))
        elif len(rest) == len(orders):
            error = "LEVEL_NOT_FOUND"
        orders = orders if error else rest
    elif op == "CLEAR_SIDE":
        orders = [x for x in orders if x[1] != side]
    elif op == "TRADE":
        trade = (price, qty)
    elif op == "STATUS":
        status = ("OPEN", "HALTED", "AUCTION")[qty % 3]
        auction = auction if status == "AUCTION" else None
    elif op == "AUCTION":
        auction = qty
    elif op == "SNAPSHOT":
        saved = (list(orders), valid, status, trade, auction)
    return (orders, valid and error is None, status, trade, auction, saved), error


def test_order_book_against_a_naive_one():
    from tideline.operators import books

    ops = [*books.ORDER_OPS * 2, "ADD", "ADD", "ADD", "ADD", *books.LEVEL_OPS, *books.CONTROL_OPS, *books.STATE_OPS, "RESTORE", "CLEAR_BOOK"]
    errors = set()
    for seed in range(60):
        rng = random.Random(seed)
        state = naive = None
        for i in range(300):
            side = rng.choice("BA")
            row = (rng.choice(ops), rng.randrange(25), side, rng.randint(1, 6) + (0 if side == "B" else rng.choice([0, 6, 6])), rng.randint(0, 4))
            state, told = books.book_step(state, (i, *row))
            naive, error = _naive_book(naive, *row)
            errors.add(error)
            orders, valid, status, trade, auction, _ = naive
            want = [i, error]
            for s, pick in (("B", max), ("A", min)):
                p = pick((x[2] for x in orders if x[1] == s), default=None)
                want += [p, sum(x[3] for x in orders if x[1:3] == (s, p)) if p is not None else None]
            # within a level the naive list keeps priority; replaced and added orders stand last
            top = [x[0] for x in orders if x[1:3] == ("B", want[2]) and x[0] is not None]
            assert told == (*want, top[0] if top else None, sum(x[0] is not None for x in orders), len({x[1:3] for x in orders}), status, trade and trade[0], auction, valid)
    assert errors >= {None, "BOOK_INVALID", "CROSSED", "ORDER_NOT_FOUND", "DUPLICATE_ORDER", "QUANTITY_MISMATCH", "LEVEL_NOT_FOUND", "INVALID_SHAPE"}


def test_ratio_times(spark):
    rng = random.Random(2)
    rows = [tuple(rng.choice([1, -1]) * rng.randint(0 if k % 2 == 0 else 1, 10 ** rng.randint(1, 9)) for k in range(4)) for _ in range(300)]
    rows += [(2**62, 3, 9, 2**60), (None, 1, 1, 1), (1, 0, 1, 1), (2**61, 1, 8, 1), (0, 5, 3, -7)]
    df = spark.createDataFrame(rows, "a long, b long, c long, d long")
    for r in df.withColumn("p", ints.ratio_times("a", "b", "c", "d")).collect():
        if r.a is None or not r.b or not r.d or (r.a, r.c) == (2**61, 8):
            assert r.p.num is None and r.p.den is None
        else:
            f = Fraction(r.a, r.b) * Fraction(r.c, r.d)
            assert (r.p.num, r.p.den) == (f.numerator, f.denominator)


def test_strategy_fold():
    step = folds.strategy_step(folds.MeanReversion)
    state, out = None, []
    for i, price in enumerate([100, 90, 120, 80, 100]):
        state, told = step(state, (i, price, 1))
        out.append(told)
    assert [x[1] for x in out] == [0, 1, -1, 1, -1] and [x[2] for x in out] == [0, 1, 0, 1, 0]
    assert out[-1][3] == -90 + 120 - 80 + 100


def test_fold_keeps_nulls_and_digits(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([("u", 1, big), ("u", 2, None), ("u", 3, big + 1), (None, 1, big)], "u string, t long, x long")
    got = folds.ordered_fold(df, ["u"], ["t"], lambda: None, lambda s, r: (r[1], (r[0], r[1])), ["t", "x"], "t long, x long").orderBy("u", "t").collect()
    assert [(r.u, r.t, r.x) for r in got] == [(None, 1, big), ("u", 1, big), ("u", 2, None), ("u", 3, big + 1)]


def test_greeks_by_differences(spark):
    import math

    from tideline.functions import options

    def price(c, s, k, t, r, q, v):
        n = lambda x: 0.5 * (1 + math.erf(x / math.sqrt(2)))
        d1 = (math.log(s / k) + (r - q + v * v / 2) * t) / (v * math.sqrt(t))
        z = 1 if c else -1
        return z * (s * math.exp(-q * t) * n(z * d1) - k * math.exp(-r * t) * n(z * (d1 - v * math.sqrt(t))))

    rows = [(c, 100.0, k, t, 0.03, 0.01, v) for c in (True, False) for k in (80.0, 100.0, 125.0) for t in (0.2, 1.5) for v in (0.15, 0.4)]
    df = spark.createDataFrame(rows, "c boolean, s double, k double, t double, r double, q double, v double")
    for row in df.withColumn("g", options.greeks("c", "s", "k", "t", "r", "q", "v")).collect():
        c, s, k, t, r, q, v, g = row
        delta = lambda tt=t, vv=v: (price(c, s + 0.01, k, tt, r, q, vv) - price(c, s - 0.01, k, tt, r, q, vv)) / 0.02
        assert abs(g.gamma - (price(c, s + 0.1, k, t, r, q, v) - 2 * price(c, s, k, t, r, q, v) + price(c, s - 0.1, k, t, r, q, v)) / 0.01) < 1e-4
        assert abs(g.vega - (price(c, s, k, t, r, q, v + 1e-4) - price(c, s, k, t, r, q, v - 1e-4)) / 2e-4) < 1e-3
        assert abs(g.vanna - (delta(vv=v + 1e-3) - delta(vv=v - 1e-3)) / 2e-3) < 2e-2 and abs(g.charm - (delta(tt=t - 1e-3) - delta(tt=t + 1e-3)) / 2e-3) < 2e-2


def test_score_batches(spark):
    from tideline.operators.scoring import ordered_batches, score_batches

    class Fails:
        def predict(self, rows):
            raise ValueError("no")

    class Double:
        def predict(self, rows):
            return rows["x"] * 2

    df = spark.createDataFrame([(1, 5), (2, None), (3, 60)], "i long, x long").coalesce(1)
    assert [(r.score, r.status) for r in score_batches(df, Double, ["x"], ["i"], 100).orderBy("i").collect()] == [(10, "OK"), (None, "INVALID_INPUT"), (None, "OUT_OF_RANGE")]
    assert [r.status for r in score_batches(df, Fails, ["x"], ["i"], 100).orderBy("i").collect()] == ["FAILED", "INVALID_INPUT", "FAILED"]
    assert [r.status for r in score_batches(df, Double, ["x"], ["i"], 100, deadline_s=-1.0).orderBy("i").collect()] == ["LATE", "INVALID_INPUT", "LATE"]
    assert score_batches(df.limit(0), Double, ["x"], ["i"], 100).count() == 0
    n = spark.range(1000).selectExpr("id * id % 7919 * 1000 + id as k")
    for rows in (50, 10_000):
        got = ordered_batches(n, "k", 64, rows).orderBy("k").collect()
        assert [r.batch for r in got] == [i // 64 for i in range(1000)]


def test_ordered_fold_carries_state_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = spark.range(100).select((F.col("id") % 2).alias("k"), F.col("id").alias("t"), F.lit(1).alias("x"))
        got = folds.ordered_fold(df, ["k"], ["t"], lambda: 0, lambda s, r: (s + int(r[1]), (int(r[0]), s + int(r[1]))), ["t", "x"], "t long, total long").where("total = 50").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.t for r in got} == {98, 99}


def test_publish(spark, tmp_path):
    p = f"file://{tmp_path}/set"
    df = spark.range(5).toDF("x")
    first = sinks.publish(df, p, {"v": 1})
    assert first["rows"] == 5 and sinks.publish(df.limit(0), p, {"v": 1}) == first
    with pytest.raises(FileExistsError):
        sinks.publish(df, p, {"v": 2})


def test_columnar_lengths(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": [1, 2], "y": ["a"]}')
    with pytest.raises(Exception, match="differ in length"):
        feeds.columnar_json(spark, str(tmp_path), {"x": "long", "y": "string"}).collect()


def test_scan_kinds(spark):
    with pytest.raises(ValueError, match="no scan"):
        feeds.scan(spark, "nothing", "x")


def test_sequence_state(spark):
    df = spark.createDataFrame([(0, i, s) for i, s in enumerate([5, 6, 6, 9, 7, 10])], "c int, a int, s long")
    got = [(r.sequence_state, r.missing) for r in temporal.sequence_state(df, ["c"], ["a"], "s").orderBy("a").collect()]
    assert got == [("FIRST", 0), ("NEXT", 0), ("DUPLICATE", 0), ("GAP", 2), ("OUT_OF_ORDER", 0), ("NEXT", 0)]


def test_reordered_stream(spark, tmp_path):
    from tideline.streaming import feeds as live

    pd.DataFrame({"channel": [1] * 7, "sequence": [1, 3, 2, 2, 6, 7, 8], "payload": list("acbbfgh")}).to_parquet(tmp_path / "a.parquet")
    schema = spark.read.parquet(str(tmp_path)).schema
    out = live.run_to_table(live.reordered(live.file_stream(spark, str(tmp_path), schema), hold=2), "re").collect()
    assert [(r.sequence, r.state) for r in sorted(out, key=lambda r: r.sequence)] == [(1, "OK"), (2, "OK"), (3, "OK"), (4, "GAP"), (6, "OK"), (7, "OK"), (8, "OK")]


def test_reordered_over_files_and_arrow_batches(spark, tmp_path):
    from tideline.streaming import feeds as live

    n, lost = 24_000, range(7, 24_000, 50)
    swap = lambda k: k ^ 1 if k < n - 2 else k
    rows = pd.DataFrame([(1, swap(k), f"p{swap(k)}", k) for k in range(n) if swap(k) not in lost], columns=["channel", "sequence", "payload", "came"])
    parts = rows.sample(frac=1, random_state=3)
    for k in range(5):
        parts[k::5].to_parquet(tmp_path / f"{k}.parquet")
    schema = spark.read.parquet(str(tmp_path)).schema
    read = lambda **x: live.run_to_table(live.reordered(live.file_stream(spark, str(tmp_path), schema, **x), arrival=["came"]), "re").collect()
    out = read()
    waiting = {k for k in range(lost[-1], n)} if n - lost[-1] <= 32 else set()
    assert sorted(r.sequence for r in out if r.state == "OK") == [k for k in range(n) if k not in lost and k not in waiting]
    assert sorted(r.sequence for r in out if r.state == "GAP") == [k for k in lost if k not in waiting]
    assert {r.payload for r in out if r.state == "GAP"} == {"1"} and all(r.payload == f"p{r.sequence}" for r in out if r.state != "GAP")
    # file by file most rows come behind the gaps told: they are late, and none is lost or given twice
    out = read(files_per_batch=1)
    given = [r.sequence for r in out if r.state in ("OK", "LATE")]
    assert any(r.state == "LATE" for r in out) and len(set(given)) == len(given) and set(rows["sequence"]) - set(given) <= set(range(n - 400, n))
    assert len(given) >= len(rows) - 32


def test_dedup_of_files_in_any_order_of_time(spark, tmp_path):
    from tideline.streaming import feeds as live

    for k in range(4):
        ts = pd.to_datetime(pd.Series([86_400 * (10 - k) + j for j in range(5)]), unit="s").astype("datetime64[us]")
        pd.DataFrame({"event_id": [k * 5 + j for j in range(5)], "ts": ts}).to_parquet(tmp_path / f"{k}.parquet", coerce_timestamps="us")
    schema = spark.read.parquet(str(tmp_path)).schema
    stream = live.file_stream(spark, str(tmp_path), schema, files_per_batch=1).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    out = live.run_to_table(live.deduplicated(stream, ["event_id"], None).select("event_id"), "dd")
    assert sorted(r.event_id for r in out.collect()) == list(range(20))


def test_option_round_trip():
    import numpy as np

    from tideline.functions.options import implied_volatility, values

    n = 50
    call, spot, strike = np.arange(n) % 2 == 0, np.full(n, 100.0), np.linspace(80, 120, n)
    years, rate, div, vol = np.full(n, 0.5), np.full(n, 0.02), np.zeros(n), np.linspace(0.1, 0.6, n)
    v = values(call, spot, strike, years, rate, div, vol)
    back = implied_volatility.func(*(pd.Series(x) for x in (v["price"], call, spot, strike, years, rate, div)))
    assert np.allclose(back, vol, atol=1e-6)
    up = values(call, spot + 1e-4, strike, years, rate, div, vol)["price"]
    assert np.allclose((up - v["price"]) / 1e-4, v["delta"], atol=1e-4)


def test_novelty_against_brute_force(spark):
    import re
    from collections import OrderedDict

    from tideline.operators.novelty import novelty

    rng = random.Random(5)
    words = [f"w{k}" for k in range(30)] + ["Ünï", "STRASSE", "straße"]
    rows = [(k, rng.choice(["a", "b", None]), rng.choice([None, *range(200)]), " ".join(rng.choices(words, k=rng.randrange(9)))) for k in range(400)]
    rows += [(400 + k, "c", 300 + k, rows[k * 7][3]) for k in range(20)] + [(900, "a", 350, None), (901, "b", 351, "...")]
    rows += [(1000, "a", 1000, "one near copy of some length"), *((1001 + k, "b", 1001 + k, f"other{k} text{k}") for k in range(70)), (1100, "c", 1100, "One near copy, of same length")]

    def brute(capacity):
        index, out = OrderedDict(), {}
        for i, _, _, text in sorted(rows, key=lambda r: (r[2] is None, r[2] or 0, r[0])):
            text = text or ""
            tokens = frozenset(re.findall("[a-z0-9]+", text.casefold()))
            out[i] = 1_000_000 - max((len(tokens & o) * 1_000_000 // len(tokens | o) for o in index.values() if tokens | o), default=0)
            index.pop(text, None)
            while len(index) >= capacity:
                index.popitem(last=False)
            index[text] = tokens
        return out

    d = spark.createDataFrame(rows, "doc_id long, source string, t long, text string").withColumn("received_at", F.timestamp_seconds("t"))
    for capacity, run in ((4096, 4096), (4096, 50), (40, 64), (1, 7), (90, 13)):
        got = novelty(d, capacity, run).collect()
        assert len(got) == len(rows) and {r.doc_id: r.novelty_ppm for r in got} == brute(capacity)
    assert brute(4096)[1100] == 1_000_000 - 5 * 1_000_000 // 7
    assert novelty(d.limit(0)).count() == 0


def test_many_splits(spark):
    """Products of ratios beyond 38 digits; the bucketed way for hot instruments gives the same."""
    from tideline.plans.reference import adjusted_for_splits

    rng = random.Random(6)
    ratios = {"big": (4, 1), "thirds": (3, 2), "even": (2, 2), "halves": (2, 1), "mixed": None}
    splits = [(i, 10 * k, *(r or (rng.choice([2, 3, 4]), rng.choice([1, 2])))) for i, r in ratios.items() for k in range(1, 151)] + [("alone", 5, 2, 1)]
    prices = [(f"{i}-{k}-{j}", i, 10 * k + j, rng.choice([1, 5, 10**9, rng.randrange(1, 10**9)])) for i in ratios for k, j in [(0, 0), (1, -1), (1, 0), *((k, rng.randrange(10)) for k in range(60, 151))]] + [("none", "other", 0, 7)]
    want = {}
    for name, i, t, price in prices:
        after = [Fraction(old, new) for s, at, new, old in splits if s == i and at > t]
        if after:
            want[name, price] = (len(after), round(math.prod(after, start=Fraction(price))))
    p, s = spark.createDataFrame(prices, "record_id string, instrument_id string, t long, price long"), spark.createDataFrame(splits, "instrument_id string, t long, new int, old int")
    for rows in (40, 1_000_000):
        got = adjusted_for_splits(p, s, rows).collect()
        assert {(r.record_id, r.price): (r.splits, r.adjusted) for r in got} == want and len(got) == len(want)
    assert any(n > 100 and a > 10**5 for n, a in want.values()) and (150, 0) in want.values()


@pytest.fixture
def steep_bars(spark, tmp_path):
    """Twelve sessions whose returns have squares beyond 64 bits; the folder, returns by bar_id, and those of the training sessions."""
    rng = random.Random(7)
    rows, returns, train = [], {}, []
    for day in range(1, 13):
        closes = [rng.choice([1, 10**8, rng.randrange(1, 10**8)]) for _ in range(6)]
        for m, c in enumerate(closes):
            bar_id, x = day * 100 + m, c / 100
            rows.append((bar_id, "A", "M", f"S-2024-01-{day:02}", f"2024-01-{day:02}T10:{m:02}:00Z", x, x, x, x, 5, "s", 1))
            if m:
                n, p = (c - closes[m - 1]) * 1_000_000, closes[m - 1]
                returns[bar_id] = (abs(n) * 2 + p) // (p * 2) * (1 if n > 0 else -1)
                train += [bar_id] if day <= 5 else []  # 70 % of the eight days beside the purges
    schema = "bar_id long, symbol string, market_id string, session_id string, t string, o double, h double, l double, c double, v long, source_object_id string, local_receipt_time_ns long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/raw_bars.parquet")
    return str(tmp_path), returns, [returns[i] for i in train]


def test_training_statistics_beyond_64_bits(spark, steep_bars):
    from tideline.plans.bars import train_normalization

    folder, _, train = steep_bars
    (r,) = train_normalization(spark, folder).collect()
    assert (r.n, r.s, int(r.q)) == (len(train), sum(train), sum(x * x for x in train)) and r.q > 2**63
    assert r.fit_through_ns == 1_704_449_100 * 10**9  # the last minute of January the fifth


def test_zscores_from_statistics_beyond_64_bits(spark, steep_bars):
    from tideline.plans.bars import train_zscore

    folder, returns, train = steep_bars
    n, total = len(train), sum(train)
    spread = math.isqrt(n * sum(x * x for x in train) - total * total)
    tops = {i: (x * n - total) * 1_000_000 for i, x in returns.items()}
    want = {i: (abs(t) * 2 + spread) // (spread * 2) * (1 if t > 0 else -1) for i, t in tops.items()}
    assert {r.bar_id: r.z_ppm for r in train_zscore(spark, folder).collect()} == want


@pytest.mark.parametrize("jumps", [[(1, 4 * 10**12)] * 4, [(1, 9 * 10**12), (1, 9 * 10**12)], [(1, 9 * 10**14), (2, 3)], [(10**12, 10**12 + 10**6), (10**12, 10**12 + 10**6, 10**12)]])
def test_zscores_of_any_size(spark, tmp_path, jumps):
    """Sums of returns, their products, single returns and scores beyond 64 and 128 bits; the last session jumps too."""
    from tideline.plans.bars import train_normalization, train_zscore

    days = [*jumps, *[(100, 101, 99, 100)] * (12 - len(jumps)), (1, 9 * 10**14, 1)]
    schema = "bar_id long, symbol string, market_id string, session_id string, t string, o double, h double, l double, c double, v long, source_object_id string, local_receipt_time_ns long"
    rows, returns, train = [], {}, []
    for day, closes in enumerate(days, 1):
        for m, c in enumerate(closes):
            rows.append((day * 100 + m, "A", "M", f"S-2024-01-{day:02}", f"2024-01-{day:02}T10:{m:02}:00Z", *[c / 100] * 4, 5, "s", 1))
            if m:
                n, p = (c - closes[m - 1]) * 1_000_000, closes[m - 1]
                returns[day * 100 + m] = (abs(n) * 2 + p) // (p * 2) * (1 if n > 0 else -1)
                train += [day * 100 + m] if day <= 6 else []  # 70 % of the nine days beside the purges
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/raw_bars.parquet")
    n, total, squares = len(train), sum(returns[i] for i in train), sum(returns[i] ** 2 for i in train)
    spread = math.isqrt(n * squares - total * total)
    tops = {i: (x * n - total) * 1_000_000 for i, x in returns.items()}
    want = {i: (abs(t) * 2 + spread) // (spread * 2) * (1 if t > 0 else -1) for i, t in tops.items()}
    assert {r.bar_id: int(r.z_ppm) for r in train_zscore(spark, str(tmp_path)).collect()} == want
    if squares < 10**38:
        (r,) = train_normalization(spark, str(tmp_path)).collect()
        assert (r.n, int(r.s), int(r.q)) == (n, total, squares)
