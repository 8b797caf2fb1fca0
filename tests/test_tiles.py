"""All pairs by cells: against pair after pair on awkward rows, and without a row a pair in the plan."""

import functools
import math
import random

import numpy as np
import pytest

from veridune.operators import drift, quality, tiles

SCHEMA = "id long, v array<double>"


def awkward():
    rng = random.Random(5)
    base = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(150)]
    base += [[3.0 * x for x in base[k]] for k in range(10)] + [list(base[k]) for k in range(12)] + [list(base[3]) for _ in range(9)]
    base += [[0.0] * 6, [math.nan] * 6, None, [1.0, None, 0.0, 0.0, 0.0, 0.0], [], [1.0, 2.0], [2.0, 4.0], [2.0, -1.0], [1e-3] * 6, [-1e-3] * 6]
    ids = list(range(len(base)))
    rng.shuffle(ids)
    return [(7 * i - 300, v) for i, v in zip(ids, base, strict=True)] + [(None, base[0])]


def pair_after_pair(rows):
    """{(a, b): cosine} in the order of sums that SQL has, NaN kept."""
    out = {}
    dot = lambda x, y: functools.reduce(lambda s, p: s + p[0] * p[1], zip(x, y, strict=True), 0.0)  # noqa: E731  (sum() compensates)
    use = [(i, v, math.sqrt(dot(v, v))) for i, v in rows if i is not None and v and None not in v]
    use = [r for r in use if not r[2] <= 0]
    for a, x, la in use:
        for b, y, lb in use:
            if a < b and len(x) == len(y):
                out[a, b] = dot(x, y) / (la * lb)
    return out


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(tiles, "ROWS", 40)
    monkeypatch.setattr(tiles, "FEW", 8)
    monkeypatch.setattr(tiles, "TILE", (7, 11))
    monkeypatch.setattr(tiles, "SOME", 5)


def joins(df):
    return "Join" in df._jdf.queryExecution().toString()


@pytest.mark.parametrize("threshold", [0.4, 0.999999999, -2.0])
def test_near_pairs(spark, small, threshold):
    df = spark.createDataFrame(awkward(), SCHEMA).repartition(5)
    got = quality.near_pairs(df, "id", "v", threshold)
    assert not joins(got)  # a row a pair before
    want = {k: c for k, c in pair_after_pair(awkward()).items() if not c < threshold}
    rows = got.collect()
    assert len(rows) == len(want) and {(r.a, r.b): str(r.cosine) for r in rows} == {k: str(c) for k, c in want.items()}


def test_nearest(spark, small):
    rows = awkward()
    for rows in (rows, [r for r in rows if r[1] and not math.isnan(r[1][0] or 0)]):
        got = quality.nearest(spark.createDataFrame(rows, SCHEMA).repartition(5), "id", "v")
        assert not joins(got)
        best = {}
        for (a, b), c in pair_after_pair(rows).items():
            for i, o in ((a, b), (b, a)):
                best.setdefault(i, []).append((math.inf if math.isnan(c) else round(c, 12), -o))
        assert {r.id: r.neighbour for r in got.collect()} == {i: -max(x)[1] for i, x in best.items()}


@pytest.mark.parametrize("threshold", [0.6, 0.95, -0.5])
def test_forest(spark, small, threshold, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    df = spark.createDataFrame(awkward(), SCHEMA).repartition(5)
    edges = quality.near_forest(df, "id", "v", threshold)
    assert not joins(edges)
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for (a, b), c in pair_after_pair(awkward()).items():
        if not c < threshold:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert {r.node: r.component for r in quality.components(edges).collect()} == {i: find(i) for i in root}


def test_equal_ids_and_text_ids(spark, small):
    v = [[1.0, 0.0], [0.9, 0.1], [0.0, 1.0], [1.0, 0.0]]
    df = spark.createDataFrame(list(zip([5, 5, 7, 5], v, strict=True)), SCHEMA)
    assert {r.id: r.neighbour for r in quality.nearest(df, "id", "v").collect()} == {5: 7, 7: 5}
    assert sorted((r.a, r.b) for r in quality.near_pairs(df, "id", "v", 0.05).collect()) == [(5, 7)]
    named = spark.createDataFrame(list(zip(["b", "é", "a", "c"], v, strict=True)), "id string, v array<float>")
    assert sorted((r.a, r.b) for r in quality.near_pairs(named, "id", "v", 0.9).collect()) == [("b", "c"), ("b", "é"), ("c", "é")]


def test_work_within_single_precision_of_the_threshold(spark):
    """Cosines that differ from the threshold by less than a float can tell."""
    t = 0.4
    angle = math.acos(t)
    rows = [(0, [1.0, 0.0])] + [(i, [math.cos(angle + (i - 50) * 1e-11), math.sin(angle + (i - 50) * 1e-11)]) for i in range(1, 100)]
    got = {r.b for r in quality.near_pairs(spark.createDataFrame(rows, SCHEMA), "id", "v", t).where("a = 0").collect()}
    assert got == {b for (a, b), c in pair_after_pair(rows).items() if a == 0 and c >= t} and 40 < len(got) < 60


def test_half_of_all_rows_one_vector(spark):
    """Copies cost no pair each: 2,000 of 4,000 rows are one vector."""
    rng = np.random.default_rng(3)
    rows = [(i, [1.0] * 8) if i % 2 else (i, rng.normal(size=8).tolist()) for i in range(4000)]
    got = {r.id: (r.neighbour, r.cosine) for r in quality.nearest(spark.createDataFrame(rows, SCHEMA), "id", "v").collect()}
    assert len(got) == 4000 and got[1] == (3, 1.0) and all(got[i] == (1, 1.0) for i in range(3, 4000, 2))


def kernel_sums(rows, sigma):
    """Per side pair after pair: {(side, side): sum}."""
    out = {}
    for k, (_, x, s) in enumerate(rows):
        for _, y, t in rows[:k]:
            d = math.dist(x, y)
            key = tuple(sorted((s, t)))
            out[key] = out.get(key, 0.0) + (d if sigma is None else math.exp(-d * d / (2 * sigma**2)))
    return out


@pytest.mark.parametrize("sigma", [None, 1.7])
def test_pair_sums(spark, small, sigma):
    rng = np.random.default_rng(9)
    rows = [(int(i), rng.normal(size=5).tolist(), bool(rng.random() < 0.4)) for i in rng.permutation(230)] + [(500, [1.0] * 5, True), (501, [1.0] * 5, False), (502, [1.0] * 5, True)]
    schema = "id long, v array<double>, side boolean"
    df = spark.createDataFrame([*rows, (600, None, True), (601, [1.0] * 5, None), (None, [1.0] * 5, True)], schema).repartition(4)
    width = spark.createDataFrame([(sigma,)], "sigma double") if sigma else None
    sums = drift.pair_sums(df, "id", "v", "side", width, 3)
    assert not joins(sums)  # before: two joins of packed blocks, once a pair of 256 rows
    got = {r.round: r for r in sums.collect()}
    want = kernel_sums(rows, sigma)
    assert len(got) == 4 and (got[0].nt, got[0].nf) == (sum(s for *_, s in rows), sum(not s for *_, s in rows))
    for have, key in ((got[0].tt, (True, True)), (got[0].ff, (False, False)), (got[0].tf, (False, True))):
        assert math.isclose(have, want[key], rel_tol=1e-7 if sigma is None else 1e-10)
    whole = sum(want.values())
    assert all(math.isclose(r.tt + r.ff + r.tf, whole, rel_tol=1e-7) and r.nt + r.nf == len(rows) for r in got.values())
    assert drift.pair_sums(df.where("id < -1"), "id", "v", "side", width, 2).collect() == []
    with pytest.raises(Exception, match="vectors of different lengths"):
        drift.pair_sums(spark.createDataFrame([(1, [1.0], True), (2, [1.0, 2.0], False)], schema), "id", "v", "side").collect()
