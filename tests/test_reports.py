import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridune.functions import stats
from veridune.operators import assets, decisions, drift, population, quality, ranks, reports


def test_running_sums_and_quantiles_of_awkward_values(spark):
    r = random.Random(3)
    xs = [0.0, -0.0, 1e-320, -1e-320, 1e308, -1e308, float("inf"), -float("inf"), 1e6, 1e6 + 1e-9, 8.0, 7.999999999999999, *[2.0**k for k in range(-60, 60)], *[r.gauss(0, 1) for _ in range(300)]] * 2
    df = spark.createDataFrame([(i % 3, x) for i, x in enumerate(xs)] + [(0, None)], "g long, x double")
    got = ranks.running(df, "x", {"c": F.lit(1).cast("long")}, ("g",)).collect()
    assert len(got) == len(xs) + 1
    for g in range(3):
        mine = [(-math.inf, 0) if x is None else (x, 1) for i, x in [(i % 3, x) for i, x in enumerate(xs)] + [(0, None)] if i == g]
        for row in got:
            if row.g == g:
                assert row.c == sum(1 for y, known in mine if not known or row.x is not None and y <= row.x)
    some = [x for x in xs if abs(x) < 1e9]
    q = ranks.quantiles(spark.createDataFrame([(x,) for x in some] + [(None,), (float("nan"),)], "x double"), "x", {"a": 0.0, "b": 0.37, "c": 1.0}).first()
    assert q.n == len(some)
    assert [q.a, q.b, q.c] == pytest.approx(np.quantile(some, [0, 0.37, 1]).tolist())


def test_nothing_runs_before_the_action(spark):
    df = spark.createDataFrame([(i, 0.001 * i) for i in range(1, 50)], "id long, p double")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("adjusted", "building")
    out = ranks.adjusted(df)
    assert list(tracker.getJobIdsForGroup("adjusted")) == []
    assert out.count() == 49


def test_harmonic(spark):
    ns = [1, 2, 63, 64, 65, 1000, 100000]
    got = spark.createDataFrame([(n,) for n in ns], "n long").select("n", stats.harmonic(F.col("n")).alias("h")).collect()
    for r in got:
        assert r.h == pytest.approx(math.fsum(1 / i for i in range(1, r.n + 1)), rel=1e-13)


def test_asset_verdict(spark):
    rows = [("bad", 1, "hue", 1e-9), ("bad", 1, "size", 0.9), ("bad", 2, "hue", None), ("bad", 2, "size", 0.4), ("fine", 3, "hue", 0.5), ("fine", 3, "size", 0.7), ("odd", 4, "hue", 0.02), ("odd", 4, "size", float("nan"))]
    got = {r.asset: r for r in reports.asset_verdict(spark.createDataFrame(rows, "asset string, item long, signal string, p double"), "asset", ["item"]).collect()}
    assert (got["bad"].verdict, got["bad"].leading, got["bad"].n_flagged) == ("compromised", "hue", 1)
    assert got["fine"].verdict == "clean" and got["fine"].leading is None
    assert got["odd"].verdict == "suspect" and got["odd"].asset_p == pytest.approx(0.04)


def test_problem_rows(spark):
    reg = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "2"), ("c", "3")], "k string, d string")
    disk = spark.createDataFrame([("a", "1"), ("b", "9"), ("e", "5")], "k string, d string")
    assert sorted(map(tuple, reports.registry_problems(reg, disk, "k", "d").collect())) == [("a", "duplicate_entry"), ("b", "digest_mismatch"), ("c", "missing_on_disk"), ("e", "not_registered")]
    cells = spark.createDataFrame([("x", "shifted", 3, "c"), ("y", "shifted", 3, "gone"), ("c", "no_shift_control", 2, None), ("z", None, 0, None), ("r", "reference", 1, None), ("r", "reference", 1, None)], "cell_id string, role string, n_images long, paired_cell string")
    assert sorted(map(tuple, reports.drift_cell_problems(cells, ["reference", "shifted", "no_shift_control"]).collect())) == [("r", "repeated_id"), ("r", "repeated_id"), ("y", "no_control"), ("z", "no_images"), ("z", "unknown_role")]
    plans = spark.createDataFrame([(1, "m", 5), (2, "n", 5), (2, "m", 6), (3, "o", 7)], "shard_id long, model_id string, seed long")
    assert sorted(map(tuple, reports.merge_plans(plans, ["o"]).collect())) == [("5", "seed_in_two_shards"), ("m", "model_id_in_two_shards"), ("o", "excluded_model")]


def test_controls_baselines_and_empty_tables(spark):
    cells = spark.createDataFrame([(1, 2, 0.0, 3.0), (2, 2, 1.0, 2.0), (3, 9, 0.0, 1.0)], "cell_id long, paired_cell long, reference double, operational double")
    got = {r.cell_id: (r.status, r.net) for r in reports.paired_control(cells).collect()}
    assert got == {1: ("ok", 2.0), 2: ("own_control", None), 3: ("no_control", None)}
    seen = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("b", 1, "z")], "asset string, t long, d string")
    assert [r.verdict for r in reports.digest_baseline(seen, "asset", "t", "d").orderBy("asset", "t").collect()] == ["abstain", "pass", "fail", "abstain"]
    none = spark.createDataFrame([], "asset string, item long, signal string, p double")
    assert reports.asset_verdict(none, "asset", ["item"]).collect() == []
    assert reports.uniformity(none, "p", ("signal",)).collect() == []


def test_paired_fingerprint(spark):
    kind = "image_id long, class_id string, box string, x1 double, y1 double, x2 double, y2 double, score double"
    a = spark.createDataFrame([(1, "c", "a1", 0.0, 0.0, 10.0, 10.0, 0.9), (1, "c", "a2", 50.0, 0.0, 60.0, 10.0, 0.8), (2, "c", "a3", 0.0, 0.0, 10.0, 10.0, 0.5)], kind)
    b = spark.createDataFrame([(1, "c", "b1", 0.0, 0.0, 10.0, 8.0, 0.6), (1, "d", "b2", 50.0, 0.0, 60.0, 10.0, 0.8), (3, "c", "b3", 0.0, 0.0, 10.0, 10.0, 0.5)], kind)
    got = {r.image_id: (r.n_reference, r.n_suspect, r.matched, r.reference_only, r.suspect_only, round(r.jaccard, 6), r.mean_iou and round(r.mean_iou, 6), r.score_gap and round(r.score_gap, 6)) for r in assets.paired_fingerprint(a, b).collect()}
    assert got == {1: (2, 2, 1, 1, 1, round(1 / 3, 6), 0.8, 0.3), 2: (1, 0, 0, 1, 0, 0.0, None, None), 3: (0, 1, 0, 0, 1, 0.0, None, None)}


def test_ks_p_against_known_values(spark):
    ks = spark.createDataFrame([(0, 200, 200, 0.136), (1, 200, 200, 0.163), (2, 200, 200, 0.0)], "dim long, n_a long, n_b long, ks double")
    p = [r.p for r in drift.ks_pvalues(ks).orderBy("dim").collect()]  # 1.36 and 1.63 are the 5 % and 1 % points
    assert abs(p[0] - 0.0494) < 1e-3 and abs(p[1] - 0.0098) < 1e-3 and p[2] == 1.0


def test_budget_without_bad_items(spark):
    q = spark.createDataFrame([(0, False), (1, False)], "rank long, bad boolean")
    assert tuple(decisions.budget_for_fraction(q, "bad").first()) == (0, None)
    assert tuple(decisions.flag_all(q, F.col("rank") < 1, F.col("bad")).first()) == (1, 0, 0, None)


def test_label_check_finds_swapped_labels(spark):
    r = random.Random(5)
    rows = [(i, "ab"[(i % 2) ^ (i % 40 == 7)], [4.0 * (i % 2) + r.gauss(0, 0.5), r.gauss(0, 1)]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, label string, x array<double>")
    assert sorted(x.id for x in quality.label_check(df, "id", "label", "x").where("flagged").collect()) == [7, 47, 87, 127, 167]
    for bad in (df.where("id < 10"), df.where("label = 'a'"), df.where("label = 'a' or id = 1")):
        with pytest.raises(ValueError):
            quality.label_check(bad, "id", "label", "x")


def test_scores_resume_where_they_stopped(spark, tmp_path):
    seen = []

    def score(d):
        seen.append(d.count())
        return d.withColumn("score", F.lit(1.0))

    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id long, part string")
    path = str(tmp_path / "scores")
    population.score_resumable(rows.where("id < 3"), score, path, ["id", "part"])
    assert population.score_resumable(rows, score, path, ["id", "part"]).count() == 3 and seen == [2, 1]


def test_asset_verdict_sorts_no_items_and_keeps_ties(spark):
    rng = random.Random(11)
    rows = [(None if i % 9 == 0 else f"a{i % 9}", i // 2, i % 2, s, rng.choice([1e-7, 1e-7, 1e-4, 0.01, 0.2, 1.0, float("nan"), None])) for i in range(600) for s in rng.sample("cabd", rng.randint(1, 4))]
    df = spark.createDataFrame(rows, "asset string, item long, part long, signal string, p double").repartition(4)
    out = reports.asset_verdict(df, "asset", ["item", "part"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "SortAggregate" in x and "item" in x]  # before: all rows were sorted by item
    items = {}
    for a, i, k, s, p in rows:
        items.setdefault((a, i, k), []).append((1.0 if p is None or math.isnan(p) else p, s))
    one = sorted((min(1.0, min(v)[0] * len(v)), k) for k, v in ((k, v) for k, v in items.items()) for k in [(str(k[0]), *k)])
    n, h = len(one), sum(1 / i for i in range(1, len(one) + 1))
    cut = max((p for r, (p, _) in enumerate(one, 1) if p * n / r * h <= 0.05), default=-1.0)
    want = {}
    for p, (_, a, i, k) in one:
        w = want.setdefault(a, [0, 0, 1.0, None])
        w[0], w[2] = w[0] + 1, min(w[2], p)
        if p <= cut:
            best = min(items[a, i, k])
            w[1], w[3] = w[1] + 1, best if w[3] is None else min(w[3], best)
    got = {r.asset: (r.n_items, r.n_flagged, r.leading) for r in out.collect()}
    assert got == {a: (w[0], w[1], w[3] and w[3][1]) for a, w in want.items()} and sum(g[1] for g in got.values()) > 20
    assert {r.asset: r.asset_p for r in out.collect()} == {a: min(1.0, w[2] * w[0]) for a, w in want.items()}


def test_running_sums_of_heavy_values(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([0.5, 0.5, 0.25, None, float("nan"), rng.random()]), rng.randint(0, 3)) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, x double, w long")
    take = lambda: sorted(map(str, ranks.running(df, "x", {"s": F.col("w")}, ("k",), descending=True).select("k", "x", "w", "s", "__all_s").collect()))
    whole = take()
    monkeypatch.setattr(ranks, "HEAVY", 20)
    assert len(whole) == 400 and take() == whole
    assert "LeftAnti" in ranks.running(df, "x", {"s": F.col("w")})._jdf.queryExecution().executedPlan().toString()  # before: a value's rows went to one task
