"""The near-copy stage against all pairs."""

import random
from itertools import combinations

import numpy as np

import corpus_pipeline
from veridune.llm import near_copies


def grams(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute(rows):
    root = list(range(len(rows)))
    s = [grams(t) for _, t in rows]
    for a, b in combinations(range(len(rows)), 2):
        if 5 * len(s[a] & s[b]) >= 4 * len(s[a] | s[b]):
            x, y = root[a], root[b]
            root = [x if r == y else r for r in root]
    best = {}
    for i, (d, t) in enumerate(rows):
        best[root[i]] = min(best.get(root[i], (1 << 63, t or "")), (1 << 62 if d is None else d, t or ""))
    return sorted(best.values())


def planted():
    r = random.Random(4)
    text = lambda n: [r.choice("abcdefghij") + str(r.randint(0, 400)) for _ in range(n)]
    rows, shared = [], text(60)
    for i in range(0, 400, 4):
        w = text(r.randint(10, 200)) + (shared if i % 3 == 0 else [])
        rows.append((i, " ".join(w)))
        for k in range(1, 1 + i % 3):
            v = list(w)
            for _ in range(r.randint(1, 1 + len(w) // 40)):
                v[r.randrange(len(v))] = "new" + str(r.randint(0, 9))
            rows.append((i + k, " ".join(v)))
    base = text(300)
    for i in range(120):
        v = list(base)
        for _ in range(r.randint(1, 6)):
            v[r.randrange(300)] = "edit" + str(i)
        rows.append((1000 + i, " ".join(v)))
    return rows


def test_near_copies_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "FREQUENT", 2)
    rows = planted()
    docs = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, __row string").withColumnRenamed("__row", "row").repartition(5)
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs, "").collect())
    assert got == brute(rows) and len(got) < 0.6 * len(rows)


def test_one_row_of_each_group_stays(spark):
    a, b = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(7, a), (7, a), (7, a + " x"), (9, b), (None, b + " x"), (None, None), (None, ""), (7, "other words that stand alone here")]
    got = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in got) == [-1, 7, 7, 9]


def test_parities_keep_every_similar_pair_and_few_others():
    r = np.random.default_rng(1)
    sets, pairs = [], []
    for n in (6, 60, 700, 6000, 40_000):
        base = r.integers(0, 1 << 63, 2 * n, np.uint64)
        for share in (n, round(0.9 * n), round(0.89 * n), n // 2, 0):
            sets += [np.unique(base[:n]), np.unique(base[n - share : 2 * n - share])]
            pairs.append((len(sets) - 2, len(sets) - 1))
    i, j = np.array(pairs).T
    keep = near_copies._possible(0.8)(np.array(list(map(len, sets))), [near_copies._parities(s) for s in sets], i, j)
    for (a, b), k in zip(pairs, keep, strict=True):
        both = len(np.intersect1d(sets[a], sets[b]))
        s = both / (len(sets[a]) + len(sets[b]) - both)
        assert k if s >= 0.8 else (not k or s > 0.75), (len(sets[a]), s)


def test_parities_are_small_and_rule_out_sets_that_share_half():
    r = np.random.default_rng(2)
    for n in (100, 511, 700, 6000):
        h = r.integers(0, 1 << 63, 3 * n // 2, np.uint64)
        sets = [np.unique(h[:n]), np.unique(h[n // 2 :])]
        data = [near_copies._parities(s) for s in sets]
        assert all(8 * len(d) <= max(128, 2 * len(s)) for d, s in zip(data, sets, strict=True))
        assert not near_copies._possible(0.8)(np.array(list(map(len, sets))), data, np.array([0]), np.array([1])).any()
