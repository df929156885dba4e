import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftline.functions.ks import asymptotic_p_value, critical_h, exact_p_value
from driftline.operators import kswin as kw
from driftline.operators.eddm import eddm, eddm_run, error_distance
from driftline.operators.scan import ordered_index, prefix_scan
from driftline.operators.thin import thin
from driftline.operators.sampling import draw_sample
from tests import recurrence as rec


def frame(spark, columns, rows):
    return spark.createDataFrame(pd.DataFrame(rows, columns=columns))


def sequences(lengths, rate=0.2, seed=1):
    rng = random.Random(seed)
    return {
        k: [rng.random() > (rate if i < n // 2 else rate * 2) for i in range(n)] for k, n in lengths.items()
    }


def ok_frame(spark, data):
    rows = [(k, i, bool(ok)) for k, oks in data.items() for i, ok in enumerate(oks)]
    random.Random(3).shuffle(rows)
    return frame(spark, ["k", "t", "ok"], rows)


def check_eddm(got, data):
    by_key = {}
    for r in got.orderBy("k", "pos").collect():
        by_key.setdefault(r.k, []).append(r)
    for k, oks in data.items():
        want = rec.eddm_rows(oks)
        rows = by_key[k]
        assert len(rows) == len(want)
        for r, (n, status, ratio, errors, mean, best) in zip(rows, want):
            assert (r.pos, r.status, r.num_errors) == (n, status, errors), (k, r)
            assert r.warning == (status == "warning") and r.drift == (status == "drift")
            assert (r.ratio is None) == (ratio is None)
            assert ratio is None or r.ratio == pytest.approx(ratio, rel=1e-9)
            assert r.mean_distance == pytest.approx(mean, rel=1e-9)
            assert r.max_mean_std == pytest.approx(best, rel=1e-9)


def test_eddm_equals_recurrence_and_ignores_partitioning(spark):
    data = sequences({"hot": 3000, "a": 400, "b": 60, "one": 1})
    data["none"] = [True] * 30
    data["single"] = [True] * 5 + [False] + [True] * 4
    data["two"] = [False, True, False]
    data["gap"] = [False] + [True] * 900 + [False]
    df = ok_frame(spark, data)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # many blocks per key
    try:
        check_eddm(eddm(df, ["k"], ["t"], "ok"), data)
        check_eddm(eddm(df.repartition(7), ["k"], ["t"], "ok"), data)
        errors = eddm(df, ["k"], ["t"], "ok", errors_only=True)
        assert errors.count() == sum(not ok for oks in data.values() for ok in oks)
        distances = error_distance(df, ["k"], ["t"], "ok").join(errors, ["k", "pos"])
        assert distances.count() == errors.count()
        assert error_distance(df, ["k"], ["t"], "ok").groupBy("k").agg(
            (F.sum("distance") - F.max("pos")).alias("x")
        ).filter("x <> 0").isEmpty()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    check_eddm(eddm(df.coalesce(1), ["k"], ["t"], "ok"), data)


def test_eddm_over_one_unkeyed_sequence(spark):
    data = sequences({"x": 700})
    got = eddm(ok_frame(spark, data), [], ["t"], "ok")
    check_eddm(got, data)


def test_eddm_state_continues(spark):
    data = sequences({"hot": 1500, "a": 200})
    df = ok_frame(spark, data)
    first = eddm_run(df.filter("t < 90"), ["k"], ["t"], "ok")
    second = eddm_run(df.filter("t >= 90 and t < 700"), ["k"], ["t"], "ok", state=first.state)
    third = eddm_run(df.filter("t >= 700"), ["k"], ["t"], "ok", state=second.state)
    check_eddm(first.rows.union(second.rows).union(third.rows), data)
    assert third.state.count() == 2


def test_missing_verdict_counts_as_error(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, True)], "k string, t int, ok boolean")
    assert [r.num_errors for r in eddm(df, ["k"], ["t"], "ok").orderBy("pos").collect()] == [1, 1]


def test_null_key_is_an_error(spark):
    df = spark.createDataFrame([("a", 1, True), (None, 2, True)], "k string, t int, ok boolean")
    with pytest.raises(Exception, match="null in key column k"):
        eddm(df, ["k"], ["t"], "ok").collect()


def test_unkeyed_state_continues(spark):
    data = sequences({"x": 900})
    df = ok_frame(spark, data)
    first = eddm_run(df.filter("t < 333"), [], ["t"], "ok")
    second = eddm_run(df.filter("t >= 333"), [], ["t"], "ok", state=first.state)
    check_eddm(first.rows.union(second.rows), data)
    values = values_frame(spark, {"hot": shifted(600, 1)})
    options = dict(features=["x", "y"], reference=100, current=34)
    whole = kw.kswin(values, [], ["t"], **options)
    one = kw.kswin_run(values.filter("t < 250"), [], ["t"], **options)
    two = kw.kswin_run(values.filter("t >= 250"), [], ["t"], state=(one.totals, one.tail, one.last), **options)
    key = ["feature", "pos", "h"]
    parts = one.drifts.unionByName(two.drifts).select(key)
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.select(key).collect())) != []


def test_prefix_scan(spark):
    rng = random.Random(5)
    rows = [(k, t, rng.randint(-5, 9)) for k, n in (("hot", 2000), ("b", 30)) for t in range(n)]
    df = frame(spark, ["k", "t", "v"], rows).repartition(5)
    got = prefix_scan(df, ["k"], ["t"], {"s": F.col("v")}, {"m": F.when(F.col("v") > 7, F.col("t"))}).toPandas()
    want = pd.DataFrame(rows, columns=["k", "t", "v"])
    for k, part in got.sort_values("t").groupby("k"):
        base = want[want.k == k].sort_values("t")
        assert part.pos.tolist() == list(range(1, len(base) + 1))
        assert part.s.tolist() == base.v.cumsum().tolist()
        top = base.t.where(base.v > 7).ffill()
        assert part.m.fillna(-1).tolist() == top.fillna(-1).tolist()
    assert ordered_index(df, [], ["t", "k"]).agg(F.max("pos")).first()[0] == len(rows)


@pytest.mark.parametrize("block", [50, 73, 1000])
def test_thinning_equals_greedy(spark, block):
    rng = random.Random(block)
    groups = {
        "sparse": rng.sample(range(1, 3000), 20),
        "dense": list(range(1, 2500)),
        "mixed": rng.sample(range(1, 3000), 700),
        "exact": [10, 59, 60, 61, 109, 110, 160, 209],
    }
    rows = frame(spark, ["k", "pos"], [(k, p) for k, ps in groups.items() for p in ps])
    last = frame(spark, ["k", "pos"], [("dense", -20), ("mixed", 5), ("absent", 3)])
    for prior in (None, last):
        kept = thin(rows, ["k"], 50, last=prior, block_length=block).toPandas()
        before = {} if prior is None else {"dense": -20, "mixed": 5}
        for k, ps in groups.items():
            assert sorted(kept.pos[kept.k == k]) == rec.thinned(ps, 50, before.get(k)), k


def test_draw_equals_the_smallest_hashes(spark):
    df = spark.createDataFrame([(k, p) for k, n in (("hot", 900), ("b", 20)) for p in range(1, n + 1)], "k string, pos bigint")
    got = draw_sample(df.repartition(5), ["k"], 50)
    for k, n in (("hot", 900), ("b", 20)):
        want = sorted(range(1, n + 1), key=rec.draw)[:50]
        assert sorted(r.pos for r in got.collect() if r.k == k) == sorted(want)
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_p_values():
    assert critical_h(336, 0.005) == 45
    assert exact_p_value(44, 336) == pytest.approx(0.00624, abs=5e-6)
    assert exact_p_value(45, 336) == pytest.approx(0.00478, abs=5e-6)
    assert exact_p_value(0, 10) == 1.0
    # n = 2: the 6 orderings give D = 1 twice and D = 1/2 otherwise
    assert exact_p_value(2, 2) == pytest.approx(2 / 6)
    assert exact_p_value(1, 2) == pytest.approx(1.0)
    for n in (3, 5):
        orders = list(itertools.combinations(range(2 * n), n))
        gaps = [max(abs(2 * sum(i <= v for i in a) - v - 1) for v in range(2 * n)) for a in orders]
        for h in range(n + 1):
            assert exact_p_value(h, n) == pytest.approx(sum(g >= h for g in gaps) / len(orders))
    assert asymptotic_p_value(0.05, 4000, 5000) == pytest.approx(exact_p_value(222, 4444), rel=0.05)


def values_frame(spark, data):
    rows = [(k, t, *v) for k, seq in data.items() for t, v in enumerate(seq)]
    random.Random(2).shuffle(rows)
    return frame(spark, ["k", "t", "x", "y"], rows)


def shifted(n, seed, ties=False):
    rng = random.Random(seed)
    level, out = 0.0, []
    for i in range(n):
        if i and i % 170 == 0:
            level = rng.choice([0.0, 1.5, -2.0])
        x = rng.gauss(level, 1)
        out.append((float(round(x)) if ties else x, rng.random() if i < n - 90 else 5.0))
    return out


@pytest.mark.parametrize("ties", [False, True])
def test_kswin_equals_queue_form(spark, ties):
    data = {"hot": shifted(900, 1, ties), "b": shifted(300, 2, ties), "short": shifted(133, 3), "full": shifted(134, 4)}
    df = values_frame(spark, data)
    options = dict(reference=100, current=34, alpha=0.005)
    least = critical_h(34, 0.005)
    for block in (64, 8192):
        got = kw.kswin_run(df, ["k"], ["t"], ["x", "y"], block_length=block, **options).drifts.toPandas()
        found = 0
        for k, seq in data.items():
            for f, name in enumerate(["x", "y"]):
                want = rec.kswin_drifts([v[f] for v in seq], 100, 34, least)
                part = got[(got.k == k) & (got.feature == name)].sort_values("pos")
                assert list(zip(part.pos, part.h)) == want, (k, name, block)
                found += len(want)
        assert found > 4
    anchors = kw.kswin_anchors(df, ["k"], ["t"], ["x", "y"], **options)
    assert anchors.count() == 2 * sum(max(0, len(s) - 133) for s in data.values())
    strided = kw.kswin_anchors(df, ["k"], ["t"], ["x", "y"], stride=10, **options)
    assert strided.join(anchors, ["k", "feature", "pos", "h"]).count() == strided.count() > 0


def test_skipped_windows_could_not_have_fired():
    rng = np.random.default_rng(4)
    for trial in range(6):
        n = 1500
        x = rng.normal(size=n) + np.repeat(rng.choice([0, 0, 1.0], size=n // 100), 100)
        values = np.column_stack([x, np.round(x), np.zeros(n)])
        draws = rng.integers(0, 50 if trial % 2 else 1 << 60, n)  # also hashes with ties
        starts = np.arange(0, n - 133, 1 + trial // 3)
        whole = kw._windows(values, draws, 100, 34, starts, 0)
        pruned = kw._windows(values, draws, 100, 34, starts, 14)
        assert (whole >= 0).all() and ((whole >= 14) == (pruned >= 14)).all()
        assert (pruned[pruned >= 0] == whole[pruned >= 0]).all() and (pruned < 0).mean() > 0.1


def test_kswin_state_continues(spark):
    data = {"hot": shifted(900, 1), "b": shifted(300, 2)}
    df = values_frame(spark, data)
    options = dict(features=["x", "y"], reference=100, current=34)
    whole = kw.kswin(df, ["k"], ["t"], **options)
    state, parts = None, []
    for low, high in ((0, 50), (50, 51), (51, 400), (400, 2000)):
        run = kw.kswin_run(df.filter(f"t >= {low} and t < {high}"), ["k"], ["t"], state=state, **options)
        parts.append(run.drifts)
        state = (run.totals, run.tail, run.last)
    joined = parts[0]
    for p in parts[1:]:
        joined = joined.unionByName(p)
    key = ["k", "feature", "pos", "h"]
    assert sorted(map(tuple, joined.select(key).collect())) == sorted(map(tuple, whole.select(key).collect()))
    assert state[1].groupBy("k").count().filter("count <> 133").isEmpty()


def test_constant_feature_and_bad_values(spark):
    rows = [("a", t, 1.0, None if t == 7 else float("nan") if t == 8 else 2.0) for t in range(60)]
    df = spark.createDataFrame(rows, "k string, t int, x double, y double")
    got = kw.kswin_anchors(df, ["k"], ["t"], ["x", "y"], reference=20, current=10)
    assert got.count() == 2 * (58 - 29) and got.filter("h <> 0 or p_value <> 1").isEmpty()


def test_readiness(spark):
    df = spark.createDataFrame([("a", p, 0.0) for p in range(1, 61)], "k string, pos bigint, x double")
    drifts = spark.createDataFrame([("a", "x", 31)], "k string, feature string, pos bigint")
    rows = kw.readiness(df, drifts, ["k"], ["x"], reference=20, current=10).orderBy("pos").collect()
    fill, window = [], 0
    for p in range(1, 61):
        fill.append(window)
        window = 10 if p == 31 else min(30, window + 1)
    assert [r.fill for r in rows] == fill
    assert [r.ready for r in rows] == [f == 30 for f in fill]


def test_ks_two_sample(spark):
    rng = random.Random(9)
    groups = {"eq": (40, 40), "uneq": (50, 30), "empty": (5, 0)}
    rows, raw = [], {}
    for k, (n, m) in groups.items():
        a = [round(rng.gauss(0, 1), 1) for _ in range(n)]
        b = [round(rng.gauss(0.7, 1), 1) for _ in range(m)]
        raw[k] = (a, b)
        rows += [(k, v, True) for v in a] + [(k, v, False) for v in b]
    got = {r.k: r for r in kw.ks_two_sample(frame(spark, ["k", "v", "ref"], rows), ["k"], "v", F.col("ref")).collect()}
    a, b = raw["eq"]
    assert got["eq"].ks_statistic == pytest.approx(rec.ks_h(a, b) / 40)
    assert got["eq"].p_value == pytest.approx(exact_p_value(rec.ks_h(a, b), 40))
    a, b = raw["uneq"]
    want = max(abs(sum(x <= v for x in a) / 50 - sum(x <= v for x in b) / 30) for v in {*a, *b})
    assert got["uneq"].ks_statistic == pytest.approx(want)
    assert got["empty"].ks_statistic is None


def test_exact_p_value_of_unequal_samples():
    from itertools import combinations
    from math import comb

    from driftline.functions.ks import asymptotic_p_value, exact_p_value, exact_p_value_unequal

    for n, m in ((1, 1), (2, 5), (4, 3), (5, 6)):
        gaps = []
        for first in combinations(range(n + m), n):
            i = widest = 0
            for k in range(n + m):
                i += k in first
                widest = max(widest, abs(i * m - (k + 1 - i) * n))
            gaps.append(widest)
        for gap in set(gaps):
            assert abs(exact_p_value_unequal(gap, n, m) - sum(g >= gap for g in gaps) / comb(n + m, n)) < 1e-12
    assert abs(exact_p_value_unequal(45 * 336, 336, 336) - exact_p_value(45, 336)) < 1e-12
    small = exact_p_value_unequal(300 * 200, 300, 200)  # no overlap at all
    assert abs(small * comb(500, 200) / 2 - 1) < 1e-6
    assert abs(exact_p_value_unequal(90_000, 2000, 1500) - float(asymptotic_p_value(0.03, 2000, 1500))) < 0.02
