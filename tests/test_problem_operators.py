"""The operators of p1 to p5 against brute force, with the cases that their docstrings define."""

import random
from statistics import median

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.operators import outliers
from tideline.operators.grid import regular_grid
from tideline.operators.intervals import coverage_spans
from tideline.operators.outliers import Limits, found_bars, score_bars
from tideline.operators.ranking import bucket_bounds, running_total, with_bucket
from tideline.operators.versions import attributes_at_event, latest_valid
from tideline.streaming.fiba import FingerTree
from tideline.streaming.late import HOUR, first_arrivals, late_events, late_events_stream, late_rows, period_totals

COVER = "source_id string, kind string, start_time_ns long, end_time_ns long, k0 string, s long, note string"


def spans_by_hand(rows):
    groups = {}
    for a, b, s, e in {r[:4] for r in rows}:
        if None not in (a, b, s, e) and e > s:
            groups.setdefault((a, b), []).append((s, e))
    out = set()
    for key, xs in groups.items():
        merged = []
        for s, e in sorted(xs):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(*key, "covered", s, e) for s, e in merged}
        out |= {(*key, "gap", p[1], q[0]) for p, q in zip(merged, merged[1:])}
    return out


@pytest.mark.parametrize("bucket_rows", [3, 1000])
def test_coverage_spans_random(spark, bucket_rows):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        key = ("hot", "NEWS") if i % 3 == 0 else (f"s{rng.randrange(5)}", rng.choice(["NEWS", "MACRO"]))
        s = rng.randrange(3000)
        rows.append((*key, s, s + rng.choice([0, -5, 1, 2, 3, 10, 40]), "x", 1, "y"))
    rows += [(None, "NEWS", 1, 2, "x", 1, "y"), ("a", None, 1, 2, "x", 1, "y"), ("a", "NEWS", None, 2, "x", 1, "y"), ("a", "NEWS", 1, None, "x", 1, "y")]
    rows += [("touch", "NEWS", 0, 10, "", 0, ""), ("touch", "NEWS", 10, 20, "", 0, ""), ("touch", "NEWS", 21, 22, "", 0, "")]
    got = {tuple(r) for r in coverage_spans(spark.createDataFrame(rows, COVER), ["source_id", "kind"], bucket_rows=bucket_rows).collect()}
    assert got == spans_by_hand(rows)
    assert ("touch", "NEWS", "covered", 0, 20) in got and ("touch", "NEWS", "gap", 20, 21) in got


def test_coverage_spans_empty(spark):
    assert coverage_spans(spark.createDataFrame([], COVER), ["source_id", "kind"]).count() == 0


def test_running_total_splits_a_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else str(i % 7), rng.randrange(-500, 500), i, rng.randrange(4)) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, t long, i long, w long")
    for target in (50, 10_000):
        bounds = bucket_bounds(df, ["k"], "t", target)
        assert (bounds is None) == (target == 10_000)
        got = {(r.i): r.total for r in running_total(df, ["k"], "t", "total", bounds, F.col("w"), ties=["i"]).collect()}
        for key in {r[0] for r in rows}:
            total = 0
            for _, t, i, w in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
                total += w
                assert got[i] == total


@pytest.mark.parametrize("far", [(), (0, 2**62), (-(2**62),)])
def test_buckets_hold_under_skew(spark, far):
    """Neither a stray time far off, of the hot key or another, nor a dense stretch fills one bucket."""
    n, target = 60_000, 2_000
    hot = spark.range(n).selectExpr("case when id % 3 = 0 then id * 1000 else 10 * id div 3 end as t", "'hot' as k")
    cold = spark.range(3_000).selectExpr("id * 7 as t", "concat('c', id % 40) as k")
    df = hot.unionByName(cold)
    for t in far:
        df = df.unionByName(spark.createDataFrame([(t, "hot"), (t, "c1")], "t long, k string"))
    bounds = bucket_bounds(df, ["k"], "t", target)
    placed = with_bucket(df, ["k"], "t", bounds)
    sizes = {(r.k, r["__b"]): r["count"] for r in placed.groupBy("k", "__b").count().collect()}
    assert max(sizes.values()) <= 2 * target and sum(sizes.values()) == n + 3_000 + 2 * len(far)
    assert all(b == 0 for k, b in sizes if k != "hot") and sum(k == "hot" for k, _ in sizes) >= n // target // 2
    spans = placed.where("k = 'hot'").groupBy("__b").agg(F.min("t").alias("a"), F.max("t").alias("b")).orderBy("__b").collect()
    assert all(x.b < y.a for x, y in zip(spans, spans[1:]))


def test_order_operators_split_a_hot_key(spark):
    """max_before, next_in_order and what stands on them give the same with and without cuts."""
    from tideline.operators import temporal
    from tideline.operators.ranking import max_before, next_in_order

    rng = random.Random(5)
    rows = [("hot" if i % 4 else f"k{i % 3}", rng.randrange(400) * (1 if i % 9 else 10**12), i, rng.choice([None, *range(50)])) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, t long, i long, v long")
    for target in (30, 10_000):
        bounds = bucket_bounds(df, ["k"], "t", target)
        top = {r.i: r.m for r in max_before(df, ["k"], "t", "v", "m", bounds, ["i"]).collect()}
        after = sorted((r.k, r.t, -1 if r.n is None else r.n) for r in next_in_order(df, ["k"], "t", "n", bounds).collect())
        want = []
        for key in {r[0] for r in rows}:
            own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
            for j, r in enumerate(own):
                assert top[r[2]] == max((x[3] for x in own[:j] if x[3] is not None), default=None)
                want.append((key, r[1], own[j + 1][1] if j + 1 < len(own) else -1))
        assert after == sorted(want)
    unique = df.dropDuplicates(["k", "t"])
    got = {(r.k, r.t): r.f for r in temporal.forward_asof(unique, ["k"], "t", "v", 25, "f").collect()}
    values = unique.collect()
    for r in values:
        ahead = sorted((x.t, x.v) for x in values if x.k == r.k and x.t >= r.t + 25 and x.v is not None)
        assert got[r.k, r.t] == (ahead[0][1] if ahead else None)
    seq = spark.createDataFrame([("c", n) for n in [1, 2, 5, 9, 10]] + [("d", 3)], "c string, s long")
    for n in (2, 100):
        assert {tuple(r) for r in temporal.missing_ranges(seq, ["c"], "s", n).collect()} == {("c", 3, 4), ("c", 6, 8)}
    assert temporal.missing_ranges(seq.limit(0), ["c"], "s").count() == 0


def test_horizon_targets_by_walking(spark):
    """Against a walk through the minutes, with halts that overlap, touch minutes in part and close a session."""
    from tideline.operators import calendar

    m = calendar.MINUTE
    sessions = [(f"s{i}", i * 10_000 * m, i * 10_000 * m + (40 if i % 2 else 25) * m) for i in range(30)]
    halts = [("s0", 5 * m + 1, 9 * m), ("s0", 8 * m, 12 * m - 1), ("s3", sessions[3][1] + 38 * m, sessions[3][2] + m), ("s4", sessions[4][1], sessions[4][1] + 1), ("s5", 7, 7), ("zz", 0, m)]
    s = spark.createDataFrame(sessions, "session string, open_ns long, close_ns long")
    h = spark.createDataFrame(halts, "session string, halt_start_ns long, halt_end_ns long")
    shut = lambda name, end: any(x[0] == name and x[1] < end and x[2] > end - m and x[2] > x[1] for x in halts)
    walk = [(i, name, a + k * m) for i, (name, a, b) in enumerate(sessions) for k in range(1, (b - a) // m + 1)]
    asof = [x for x in walk if x[2] // m % 7 == 0]
    got = {(r.as_of_ns, r.horizon, r.policy): (r.state, r.target_ns) for r in calendar.horizon_targets(spark.createDataFrame([(x[2],) for x in asof], "as_of_ns long"), s, h).collect()}
    assert len(got) == len(asof) * 12 * 3
    for i, name, t in asof:
        for policy in calendar.POLICIES:
            if policy != "COUNT" and shut(name, t):
                assert {got[t, hz, policy] for hz in (*calendar.MINUTE_HORIZONS, *calendar.SESSION_HORIZONS)} == {("INVALID_AS_OF_TIME", None)}
                continue
            later = [x for x in walk if x[2] > t]
            for hz, n in calendar.MINUTE_HORIZONS.items():
                want, left = ("INSUFFICIENT_CALENDAR", None), n
                for _, other, end in later:
                    if shut(other, end):
                        if policy == "REJECT":
                            want = ("HALT_ENCOUNTERED", None)
                            break
                        if policy == "PAUSE":
                            continue
                    left -= 1
                    if not left:
                        want = ("OK", end)
                        break
                assert got[t, hz, policy] == want, (t, hz, policy)
            for hz, n in calendar.SESSION_HORIZONS.items():
                want, left = ("INSUFFICIENT_CALENDAR", None), n
                for other, a, b in sessions[i + 1 :]:
                    if policy == "REJECT" and any(shut(other, e) for _, o, e in walk if o == other):
                        want = ("HALT_ENCOUNTERED", None)
                        break
                    if policy == "PAUSE" and shut(other, b):
                        continue
                    left -= 1
                    if not left:
                        want = ("OK", b)
                        break
                assert got[t, hz, policy] == want, (t, hz, policy)


def test_manifest_leaks_codes(spark):
    """Each code on its own, and nothing on a clean, empty or null manifest."""
    from tideline.plans.reference import manifest_leaks

    rec = "record_id string, kind int, available long, valid_from long, valid_to long"
    records = spark.createDataFrame([("ok", 7, 5, 0, None), ("late", 7, 60, 0, None), ("macro", 6, 60, 0, None), ("est", 5, 60, 0, None), ("member", 4, 5, 0, 40), ("action", 1, 5, 55, None)], rec)
    sam = "sample_id string, event_time_ns long, feature_start_ns long, feature_end_ns long, label_start_ns long, label_end_ns long, split string, record_ids array<string>"
    clean = ("a", 50, 10, 50, 51, 60, "TRAIN", ["ok", "ok"])
    bad = [
        ("b", 50, 10, 51, 52, 60, "TRAIN", ["late", "macro", "est", "member", "action", "gone"]),
        ("c", 50, 10, 50, 50, 60, "TRAIN", []),
        ("d", 40, 10, 40, 41, 45, "TEST", None),
        ("e", None, None, None, None, None, "VALIDATION", ["ok"]),
    ]
    got = {tuple(r) for r in manifest_leaks(spark.createDataFrame([clean, *bad], sam), records, True, 1).collect()}
    assert got == {
        ("FUTURE_FEATURE", "b", None), ("FUTURE_RECORD", "b", "late"), ("FUTURE_MACRO_REVISION", "b", "macro"), ("POST_EVENT_ESTIMATE", "b", "est"), ("FUTURE_CONSTITUENT", "b", "member"), ("FUTURE_CORPORATE_ACTION", "b", "action"),
        ("MISSING_PROVENANCE", "b", "gone"), ("LABEL_OVERLAP", "c", None), ("NON_CHRONOLOGICAL_SPLIT", "d", None), ("LABEL_OVERLAP", "d", None), ("RANDOMIZED_TIME_SPLIT", "", None),
    }
    assert manifest_leaks(spark.createDataFrame([clean], sam), records, False, 1).count() == 0
    assert manifest_leaks(spark.createDataFrame([], sam), records, False, 1).count() == 0


BARS = "bar_id long, symbol string, market_id string, session_id string, t string, o double, h double, l double, c double, v long, n long, vw double, source_object_id string, local_receipt_time_ns long, sid long, pre double"


def bar(i, m, c, v=100, symbol="AAA", h=None, l=None, o=None, t=None, session="S-1"):  # noqa: E741
    t = t if t is not None else f"2011-01-03T{14 + m // 60:02d}:{m % 60:02d}:00Z"
    h = h if h is not None or c is None else max(c, o or c) + 0.1
    l = l if l is not None or c is None else min(c, o or c) - 0.1  # noqa: E741
    return (i, symbol, "X", session, t, o if o is not None else c, h, l, c, v, 1, 1.0, "obj", i, 0, 0.0)


def bars_by_hand(rows):
    """The statement of the problem, read row by row."""
    found = set()
    series = {}
    for r in rows:
        series.setdefault(r[1:4], []).append(r)
    for rs in series.values():
        at = {}
        for r in sorted(rs):
            if r[4]:
                at.setdefault(r[4].replace(".000000000Z", "Z"), []).append(r)
        times = sorted(at)
        first = lambda t, k: next((r[k] for r in at[t] if r[k] is not None), None)
        c, v = {t: first(t, 8) for t in times}, {t: first(t, 9) for t in times}
        seq = [t for t in times if c[t] is not None]
        changes = [abs(c[a] - c[b]) for a, b in zip(seq, seq[1:])]
        mad = median(changes) if changes else None
        vs = [v[t] for t in times if v[t] is not None and v[t] > 0]
        mv = median(vs) if vs else None

        def stuck(pick, among):
            out, run = set(), []
            for t in [*among, None]:
                if run and t is not None and pick[t] == pick[run[-1]] and v[t] > 0 and v[run[-1]] > 0:
                    run.append(t)
                    continue
                if len(run) >= 10 and v[run[0]] > 0:
                    out |= set(run)
                run = [t]
            return out

        both = [t for t in times if c[t] is not None and v[t] is not None]
        hold_c, hold_v = stuck(c, both), stuck(v, [t for t in times if v[t] is not None])
        for r in rs:
            _, _, _, _, t, o, h, l, cc, vv = r[:10]  # noqa: E741
            lt = lambda a, b: a is not None and b is not None and a < b
            bad = any(lt(x, 1e-300) for x in (h, l, cc)) or lt(vv, 0) or lt(h, o) or lt(h, l) or lt(h, cc) or lt(o, l) or lt(cc, l)
            if t:
                t = t.replace(".000000000Z", "Z")
                if mv is not None and vv is not None and vv > 200 * mv:
                    bad = True
                before, after = [c[x] for x in seq if x < t][-5:], [c[x] for x in seq if x > t][:5]
                sides = [median(s) for s in (before, after) if s]
                for x in (h, l, cc):
                    if x is not None and mad is not None and sides and all(abs(x - s) > 25 * mad for s in sides):
                        bad = True
                bad |= (t in hold_c and cc is not None) or (t in hold_v and vv is not None)
            if bad:
                found.add(r[0])
    return found


def noisy_rows(seed):
    rng = random.Random(seed)
    rows, i = [], 0
    for s in range(4):
        price = 100.0
        for m in range(120):
            if rng.random() < 0.1:
                continue
            i += 1
            price = round(price + rng.choice([-0.2, -0.1, 0.1, 0.2, 0.3]), 2)
            c, v = price, rng.randrange(50, 5000)
            if 40 <= m < 53 and s == 1:
                c = 101.0
            if 60 <= m < 72 and s == 2:
                v = 777
            if rng.random() < 0.02:
                c = round(price + rng.choice([-40, 40]), 2)
            if rng.random() < 0.02:
                v = 10_000_000
            c = None if rng.random() < 0.03 else c
            v = None if rng.random() < 0.03 else v
            r = bar(i, m, c, v, symbol=f"S{s}", h=price + 1, l=price - 1, o=price)
            rows.append(r)
            if rng.random() < 0.05:
                i += 1
                rows.append((i, *r[1:4], r[4].replace("Z", ".000000000Z"), *r[5:]))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_bars_against_rules(spark, seed):
    rows = noisy_rows(seed)
    df = spark.createDataFrame(rows, BARS)
    want = bars_by_hand(rows)
    assert {r[0] for r in found_bars(df).collect()} == want and want
    cut = Limits(series_rows=20, chunk_bars=16, batch_rows=60, sample=64)
    assert {r[0] for r in found_bars(df, cut).collect()} == want
    scores = [{tuple(r) for r in score_bars(df, Limits(series_rows=n, chunk_bars=16, batch_rows=60, sample=64)).collect()} for n in (20, 45, 100_000)]
    assert scores[0] == scores[1] == scores[2] and len(scores[0]) == len(rows)


def test_forest_gates_no_case(spark):
    """The gate's recall against the rules alone: every bar that a rule hits has a score above its series' median."""
    rows = noisy_rows(3)
    got = {r.bar_id: r for r in score_bars(spark.createDataFrame(rows, BARS)).collect()}
    assert all(got[i].impossible or got[i].candidate for i in bars_by_hand(rows))
    assert 0.2 < np.mean([r.candidate for r in got.values()]) < 0.9


def test_finding_bars_grows_no_forest(spark, monkeypatch):
    """The forest has no say in the cases, so finding them must not run it, on either way."""

    def grown(*_):
        raise RuntimeError("a forest is grown")

    monkeypatch.setattr(outliers, "Forests", grown)
    rows = noisy_rows(4)
    rows += [(5000 + k, *rows[k][1:4], t, *rows[k][5:7], -1.0, *rows[k][8:]) for k, t in enumerate([None, "", "x"])]
    df = spark.createDataFrame(rows, BARS)
    want = bars_by_hand(rows)
    for lim in (Limits(), Limits(series_rows=20, chunk_bars=16, batch_rows=60, sample=64), Limits(series_rows=107, chunk_bars=16, batch_rows=60)):
        assert sorted(r[0] for r in found_bars(df, lim).collect()) == sorted(want)
        with pytest.raises(Exception, match="a forest is grown"):
            score_bars(df, lim).collect()


def test_bars_edges(spark):
    rows = [bar(1, 0, 100.0), bar(2, 0, None, None, symbol="B"), bar(3, 0, -1.0, 5, symbol="C", h=2.0, l=-2.0), bar(4, 0, 5.0, -7, symbol="D"), bar(5, 0, 10.0, symbol="E", t=""), (6, None, None, None, None, *[None] * 8, None, None, None)]
    assert sorted(r[0] for r in found_bars(spark.createDataFrame(rows, BARS)).collect()) == [3, 4]
    assert found_bars(spark.createDataFrame([], BARS)).count() == 0
    assert score_bars(spark.createDataFrame([], BARS)).columns == ["bar_id", "score", "candidate", "impossible", "stuck", "spike"]
    level = [bar(i, i, 100 + (i % 3) * 0.1 + (50 if i >= 30 else 0), 100 + i % 4) for i in range(60)]
    assert found_bars(spark.createDataFrame(level, BARS)).count() == 0  # a lasting change of level


READ = "reading_id long, symbol string, event_time_ns long, open_ticks long, n int, state string"
SESS = "source_ticker string, session_id string, session_open_exchange_time_ns long, session_close_exchange_time_ns long, symbol string"
MIN = 60_000_000_000
T0 = 1_294_065_000 * 1_000_000_000


def test_grid(spark):
    sessions = [("AA", "s", T0, T0 + 10 * MIN, "x"), ("AA", "s", T0, T0 + 10 * MIN, "x"), ("BB", "s", T0 + 5, T0 + 5 + 3 * MIN, "x"), ("CC", "s", None, T0, "x"), ("DD", "s", T0, T0, "x")]
    reads = [
        (1, " aa ", T0, 5), (2, "AA", T0 + MIN - 1, 6), (3, "AA", (T0 + 2 * MIN) // 1_000_000, 7), (4, "AA", (T0 + 3 * MIN) // 1000, 0), (5, "AA", T0 + 4 * MIN, None), (6, "AA", T0 + 9 * MIN, 8),
        (7, "AA", T0 - 1, 9), (8, "AA", T0 + 10 * MIN, 9), (9, "BB", T0 + 5 + MIN, 3), (10, None, T0, 3), (11, "AA", None, 3), (12, "AA", T0 + 9 * MIN, 8),
    ]
    df = regular_grid(spark.createDataFrame([(*r, 1, "z") for r in reads], READ), spark.createDataFrame(sessions, SESS), max_gap=3)
    got = {(r.symbol, (r.minute_start_ns - T0) // MIN): (r.n, r.open_ticks, r.filled_ticks, r.state) for r in df.collect()}
    assert len(got) == 13
    assert got["AA", 0] == (2, 6, 6, "observed") and got["AA", 1] == (0, None, 6, "filled") and got["AA", 2] == (1, 7, 7, "observed")
    assert [got["AA", m][3] for m in range(3, 10)] == ["filled"] * 3 + ["missing"] * 3 + ["observed"]
    assert got["BB", 0][3] == "missing" and got["BB", 1][3] == "observed" and got["BB", 2][3] == "filled"
    assert regular_grid(spark.createDataFrame([], READ), spark.createDataFrame(sessions, SESS)).where("state = 'missing'").count() == 13


def test_latest_valid_random():
    rng = np.random.default_rng(3)
    for trial in range(300):
        n, k, span = int(rng.integers(0, 40)), 60, (30, 300)[trial % 2]
        start = rng.integers(0, span, n)
        end = np.where(rng.random(n) < 0.3, np.iinfo(np.int64).max, start + rng.integers(-1, span // 2, n))
        avail, rank = rng.integers(0, 30, n), rng.permutation(n)
        t, known = rng.integers(-2, span + 5, k), rng.integers(-2, 35, k)
        got = latest_valid(t, known, start, end, avail, rank)
        for i in range(k):
            ok = [j for j in range(n) if avail[j] <= known[i] and start[j] <= t[i] < end[j]]
            assert got[i] == (max(ok, key=lambda j: rank[j]) if ok else -1)


def test_latest_valid_with_many_overlaps():
    """A hundred thousand revisions that all overlap, within a second or so and without a table of their pairs."""
    n = 100_000
    i = np.arange(n)
    got = latest_valid(np.array([n - 1, n, 2 * n]), np.array([n, n // 2, 0]), i, 4 * n - i, i, i)
    assert got.tolist() == [n - 1, n // 2, 0]


def test_attributes_at_event(spark):
    ev = [("e1", "A", 10, 100), ("e2", "a", 10, 4), ("e3", "a", 50, 100), ("e3", "a", 50, 100), ("e4", None, 1, 1), ("e5", "a", None, 1), ("e6", "a", 10, None), (None, "a", 10, 10), ("e7", "zz", 10, 10)]
    ch = [("c1", "a", 0, 20, 5, 1), ("c1", "a", 0, 20, 5, 1), ("c2", "A", 5, None, 50, 2), ("c3", "a", 0, 100, 200, 9), (None, "a", 0, None, 0, 99), ("c9", "a", 0, None, 0, None)]
    events = spark.createDataFrame([(*e, "x", 1) for e in ev], "event_id string, entity string, t long, known long, salt string, version int")
    changes = spark.createDataFrame([(*c, "x") for c in ch], "change_id string, entity string, start long, end long, available long, version int, salt string")
    for rows in (1, 100):
        got = {tuple(r) for r in attributes_at_event(events, changes, rows).collect()}
        assert got == {("e1", "c2"), ("e3", "c2")}
    assert attributes_at_event(events.limit(0), changes).count() == 0
    assert attributes_at_event(events, changes.limit(0)).count() == 0


def test_finger_tree_random():
    add = lambda a, b: (a[0] + b[0],)
    for seed in range(20):
        rng = random.Random(seed)
        tree, model, low = FingerTree(add), {}, None
        for _ in range(600):
            if rng.random() < 0.05:
                bound = rng.randrange(300)
                gone = tree.evict(bound)
                if low is None or bound > low:
                    low = bound
                assert gone == [(k, (model.pop(k),)) for k in sorted(k for k in model if k < low)]
            else:
                t = min(299, max(0, int(rng.gauss(150, 60))))
                assert tree.insert(t, (1,)) == (low is None or t >= low)
                if low is None or t >= low:
                    model[t] = model.get(t, 0) + 1
            a, b = sorted((rng.randrange(300), rng.randrange(300)))
            want = sum(v for k, v in model.items() if a <= k < b)
            assert (tree.range(a, b) or (0,))[0] == want
        assert list(tree.items()) == [(k, (v,)) for k, v in sorted(model.items())]
        assert tree.root.agg == ((sum(model.values()),) if model else None)


LATE = "stream string, row_key string, event long, arrival long, value long, verdict string"


def late_rows_of(n=300, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        event = rng.randrange(40) * HOUR // 2 + rng.randrange(HOUR)
        delay = rng.choice([0, 5, HOUR // 2, HOUR, 3 * HOUR, 6 * HOUR, 7 * HOUR, 20 * HOUR, -100])
        out.append(("a" if i % 3 else "b", f"k{i}", event, event + delay, None if i % 11 == 0 else rng.randrange(-50, 2**60), "x"))
    return out


@pytest.mark.parametrize("group_rows", [7, 10_000])
def test_late_events(spark, group_rows):
    rows = late_rows_of()
    told = late_events(spark.createDataFrame(rows, LATE), group_rows=group_rows).cache()
    want, totals = set(), {}
    for s, k, e, a, v, _ in rows:
        p = e - e % HOUR
        verdict = "on_time" if a < p + HOUR else "corrects" if a < p + 7 * HOUR else "dropped"
        if verdict != "on_time":
            want.add((s, k, p, verdict))
        if verdict != "dropped":
            x = totals.setdefault((s, p), [0, 0, 0])
            x[0] += 1
            x[1] += verdict == "corrects"
            x[2] += v or 0
    assert {tuple(r) for r in late_rows(told).collect()} == want
    assert {(r.stream, r.period_start_ns): [r.n, r.n_corrects, int(r.total)] for r in period_totals(told).collect()} == totals


def test_late_edges(spark):
    end = HOUR
    rows = [("a", "on", 5, end - 1, 1, ""), ("a", "first", 5, end, 1, ""), ("a", "last", 5, end + 6 * HOUR - 1, 1, ""), ("a", "gone", 5, end + 6 * HOUR, 1, ""), ("a", "early", 5, 1, None, "")]
    told = late_events(spark.createDataFrame(rows, LATE))
    assert {(r.row_key, r.verdict) for r in late_rows(told).collect()} == {("first", "corrects"), ("last", "corrects"), ("gone", "dropped")}
    assert late_events(spark.createDataFrame([], LATE)).count() == 0
    raw = spark.createDataFrame([("k", 5, 9, 1), ("k", 5, 7, 2), (None, 1, 1, 1), ("x", None, 1, 1), ("y", 1, None, 1)], "id string, e long, r long, x long")
    assert [tuple(r) for r in first_arrivals(raw, F.col("id"), "e", "r", F.col("x")).collect()] == [("k", 5, 7, 2)]


def test_late_stream_equals_batch(spark, tmp_path):
    rows = sorted(late_rows_of(200, 4), key=lambda r: r[3])
    for i in range(0, 200, 50):
        pd.DataFrame([r[:5] for r in rows[i : i + 50]], columns=["stream", "row_key", "event", "arrival", "value"]).astype({"value": "Int64"}).to_parquet(tmp_path / f"p{i:03d}.parquet")
    df = spark.read.parquet(str(tmp_path))
    from tideline.streaming.feeds import file_stream, run_to_table

    told = run_to_table(late_events_stream(file_stream(spark, str(tmp_path), df.schema, files_per_batch=1), parts=1), "late")
    assert {tuple(r) for r in late_rows(told).collect()} == {tuple(r) for r in late_rows(late_events(df)).collect()}
