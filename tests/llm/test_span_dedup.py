"""Span removal against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from veridune.llm import grams
from veridune.llm import op01_suffix_dedup as o1
from veridune.llm import op05_automaton_dedup as o5

SCHEMA = "doc_id long, text string, kept string, block long, n_units int"


def fixture(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    passage = [" ".join(word() for _ in range(n)) for n in (15, 40, 200)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(r.randint(0, 4)):
            parts.append(r.choice(passage) if r.random() < 0.5 else " ".join(word() for _ in range(r.randint(1, 60))))
            if r.random() < 0.3:
                p = r.choice(passage)
                a = r.randrange(len(p))
                parts.append(p[a : a + r.randint(40, 120)])
        rows.append((i * 3 % 60 + (i >= 30) * 100, r.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(500, None), (501, ""), (502, "a" * 3000), (503, "a" * 120), (504, "a b " * 900), (505, "a b " * 40), (3, rows[5][1]), (None, rows[5][1]), (None, None)]
    return [(d, t, "x", 1, 2) for d, t in rows]


def ids(d):
    return 1 << 62 if d is None else d


def brute(rows, units, n):
    least = {}
    split = [units(t or "") for _, t, *_ in rows]
    for (d, *_), u in zip(rows, split, strict=True):
        for p in range(len(u) - n + 1):
            k = tuple(u[p : p + n]) if not isinstance(u, bytes) else u[p : p + n]
            least[k] = min(least.get(k, 1 << 63), ids(d))
    out = []
    for (d, *_), u in zip(rows, split, strict=True):
        gone = [False] * len(u)
        for p in range(len(u) - n + 1):
            k = tuple(u[p : p + n]) if not isinstance(u, bytes) else u[p : p + n]
            if least[k] < ids(d):
                gone[p : p + n] = [True] * n
        out.append((d, u, gone))
    return out


def sha(b):
    return hashlib.sha256(b).hexdigest()


def key(x):
    return (ids(x[0]), *x[1:])


def test_suffix_dedup(spark):
    rows = fixture()
    want = sorted(((d, len(u), sum(g), sum(1 for i, x in enumerate(g) if x and (not i or not g[i - 1])), sha(bytes(c for c, x in zip(u, g, strict=True) if not x))) for d, u, g in brute(rows, lambda t: t.encode(), 50)), key=key)
    got = o1.suffix_dedup(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), sha(r.kept)) for r in got), key=key) == want
    assert sum(r[2] for r in want) > 1000


def test_automaton_dedup(spark):
    rows = fixture(2)
    cut = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", t.encode())
    want = sorted(((d, len(u), sum(g), sha(b" ".join(c for c, x in zip(u, g, strict=True) if not x))) for d, u, g in brute(rows, cut, 13)), key=key)
    got = o5.automaton_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, sha(r.kept)) for r in got), key=key) == want
    assert sum(r[2] for r in want) > 500


@pytest.mark.parametrize("op", [o1.suffix_dedup, o5.automaton_dedup])
def test_empty_table(spark, op):
    assert op(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("letters", [1, 2, 4])
def test_suffix_order(letters):
    r = np.random.default_rng(letters)
    body = r.integers(97, 97 + letters, 3000).astype(np.uint8)
    text = np.concatenate([body, body[100:900], np.zeros(4200, np.uint8)])
    n = 3800
    got = np.concatenate(list(o1.sort_suffixes(text, n, np.arange(n), 4096)))
    raw = text.tobytes()
    assert [raw[p : p + 4096] for p in got] == sorted(raw[p : p + 4096] for p in range(n))


def test_equal_windows_have_equal_anchors():
    r = np.random.default_rng(5)
    a, b = r.integers(0, 256, 400).astype(np.uint8), r.integers(0, 256, 300).astype(np.uint8)
    buf = np.concatenate([a, b, a[50:250], b])
    off = np.array([0, 400, 700, 900, 1200])
    seq, first, count, anchor = grams.window_runs(lambda x, y: grams.byte_values(buf[x:y]), off, 50, 24)
    by = {int(f) + j: int(h) for f, c, h in zip(first, count, anchor, strict=True) for j in range(c)}
    assert len(by) == (400 - 49) + 2 * (300 - 49) + (200 - 49)
    assert all(by[50 + j] == by[700 + j] for j in range(151)) and all(by[400 + j] == by[900 + j] for j in range(251))
