import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm import oracle
from veridune.llm import op03_simhash as o3
from veridune.llm import op06_quality_rules as o6
from veridune.llm import op10_line_dedup as o10

SCHEMA = "doc_id long, text string, lang string, n_lines string, k1 int"


def test_line_dedup_brute(spark):
    r = random.Random(4)
    long = ["Line number %d of the common stock of lines, éà" % i for i in range(8)] + ["é" * 39, "é" * 40, "X" * 40]
    docs = []
    for i in range(80):
        lines = [r.choice(["", " \t", "\x0b"]) + (lambda s: s.upper() if r.random() < 0.2 and s.isascii() else s)(r.choice(long)) + r.choice(["", " ", "\r"]) if r.random() < 0.5 else "own line %d with enough letters to be long %d" % (i, r.random() * 5) for _ in range(r.randint(0, 6))]
        docs.append((i, "\n".join(lines), "en", "a", 1))
    docs += [(100, None, None, None, None), (101, "", None, None, None), (102, "\n\n", None, None, None), (3, docs[3][1], "x", "y", 1), (None, docs[5][1], None, None, None)]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(low)
    big = lambda d: 1 << 62 if d is None else d
    holders = {}
    for d, t, *_ in docs:
        for k in {key(s) for s in (t or "").split("\n")}:
            holders.setdefault(k, set()).add(big(d))
    count, top = {k: len(v) for k, v in holders.items()}, {k: max(v) for k, v in holders.items()}
    want = []
    for d, t, *_ in docs:
        lines = (t or "").split("\n")
        stay = [s for s in lines if len(key(s)) < 40 or count[key(s)] < 5 or top[key(s)] == big(d)]
        want.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    df = spark.createDataFrame(docs, SCHEMA).repartition(4)
    order = lambda x: (big(x[0]), x[3])
    got = sorted(((x.doc_id, x.n_lines, x.n_dropped, x.text) for x in o10.line_dedup(df, batches=5, fanout=2).collect()), key=order)
    assert got == sorted(want, key=order) and sum(w[2] for w in want) > 50
    kept = o10.drop_common_lines(df)
    assert kept.columns == df.columns
    assert sorted(((x.doc_id, x.text or "") for x in kept.collect()), key=lambda x: (big(x[0]), x[1])) == sorted(((w[0], w[3]) for w in want), key=lambda x: (big(x[0]), x[1]))
    assert o10.line_dedup(df.limit(0)).collect() == []


def test_rows_of_one_id_are_one_document(spark):
    line = "A line that is long enough to be one of the common lines"
    rows = [(1, line)] * 4 + [(2, line)]
    assert all(r.n_dropped == 0 for r in o10.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    rows += [(i, line) for i in (3, 4, 5)]
    assert sorted((r.doc_id, r.n_dropped) for r in o10.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [(1, 1)] * 4 + [(2, 1), (3, 1), (4, 1), (5, 0)]


def test_very_long_lines_and_texts(spark):
    rows = [(i, "x" * 1_500_000 + "\n" + ("many lines of this text which is long\n" * 20_000) + f"own {i}") for i in range(5)]
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in o10.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_chars=20).collect()}
    assert got == {i: (20_002, 20_001 if i < 4 else 0) for i in range(5)}


def test_only_keys_that_no_run_holds_are_added(spark):
    runs = o10.LineRuns(spark, 3, 4)
    batch = lambda keys: spark.createDataFrame([(k, k, 1, 10 * k) for k in keys], "k1 long, k2 long, n_docs long, holder long")
    for keys in ([1, 2, 3], [2, 3, 4], [4, 5, 1], [1, 6], [6, 7]):
        runs.add(batch(keys))
        fresh = [r.k1 for t in runs.tables() for r in t.where("not seen").collect()]
        assert len(fresh) == len(set(fresh))
    assert sorted(fresh) == list(range(1, 8)) and {k: len(v) for k, v in runs.levels.items()} == {1: 1, 0: 2}
    plan = runs.tables()[0].where("not seen").select("k1", "k2").join(batch([1]).repartition(4, "k1", "k2").hint("merge"), ["k1", "k2"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1  # the run's side is read bucket by bucket
    assert sorted((r.k1, r.n_docs) for r in runs.common(2).collect()) == [(1, 3), (2, 2), (3, 2), (4, 2), (6, 2)]


def test_line_dedup_sql(spark):
    assert oracle.rows(o10.op10_line_dedup(spark, oracle.SF)) == oracle.run(o10.SQL)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_quality_sql(spark, sf):
    got = oracle.rows(o6.op6_quality_rules(spark, f"/root/testdata/{sf}"))
    assert got == oracle.run(o6.SQL, f"/root/testdata/{sf}")


def test_quality_cases(spark):
    w = "a b c d e f g h i j k l m n o p".split()
    rows = [(1, None, "en", "", 0), (2, "", "en", "", 0), (3, " ".join(w), None, "", 0), (4, " ".join(w[:5] * 3 + w), "zz", "", 0), (5, "a " * 5000, "en", "", 0), (None, " ".join(w) + " #$\n\n#$\n#$", "en", "", 0), (3, " ".join(w), None, "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(3, 1, 0), (3, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = [(r.doc_id, *r["__quality"]) for r in o6.judge(docs, labels).collect()]
    by = {g[0]: g[1:] for g in got}
    assert by[1] == by[2] == (0, 0, 0, 0, 0, 0, True, False)
    assert by[3] == (16, 16, 0, 1, 0, 0, False, True)
    assert by[4][5] == 20 and by[4][6]
    assert by[5][5] == 5000
    assert by[None] == (19, 22, 6, 3, 1, 0, False, True)
    assert o6.quality_filter(docs, labels).columns == docs.columns
    assert o6.judge(docs.limit(0), labels.limit(0)).collect() == []


def test_quality_certifies_only_what_holds(spark):
    """2,000 good documents without symbols, 1,000 poor ones full of them: the symbol rule is certified and bites."""
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: F.concat(F.lit("w"), (F.col("doc_id") * 31 + i).cast("string"))))
    docs = spark.range(6000).withColumnRenamed("id", "doc_id").withColumn("text", text).withColumn("lang", F.lit("en"))
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" ##### $$$$$ %%%%% &&&&& |||||"))).otherwise(F.col("text")))
    labels = docs.where("doc_id < 5000").select("doc_id", F.when(F.col("doc_id") % 3 == 0, 0).otherwise(1).alias("quality"), F.lit(0).alias("toxic"))
    kept = {r.doc_id for r in o6.quality_filter(docs, labels).select("doc_id").collect()}
    assert kept == {i for i in range(6000) if i % 3}


def test_quality_cutoffs_bind_on_the_test_tables(spark):
    """Labels there suffice for a cutoff, so that the SQL's agreement covers the method; good documents stay."""
    q = o6.op6_quality_rules(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    lost = {r.quality: (r.n, r.lost) for r in q.where("not base_failed").groupBy("quality").agg(F.count("*").alias("n"), F.count_if(~F.col("kept")).alias("lost")).collect()}
    assert lost[0][1] > 0.9 * lost[0][0] and lost[1][1] < 0.05 * lost[1][0]


def test_quality_pools_small_strata_and_stops_the_path(spark):
    """en (600 good) stands alone at 1 %, fr (60) and de (50) are pooled at 5 %; a cutoff that costs good documents isn't taken."""
    row = lambda i, lang, k: (i, " ".join(f"w{i}x{j}" for j in range(100)) + " " + "#" * k, lang)
    good = [row(i, "en", 20 if i < 60 else 0) for i in range(600)] + [row(1000 + i, "fr", 0) for i in range(60)] + [row(2000 + i, "de", 0) for i in range(50)]
    poor = [row(3000 + i, "en", 200) for i in range(50)]
    docs = spark.createDataFrame(good + poor, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, int(d < 3000)) for d, *_ in good + poor], "doc_id long, quality int")
    cut = {r.stratum: r for r in o6.thresholds(o6.with_features(docs), labels).collect()}
    assert set(cut) == {"en", "fr", "de", "es", "other"}
    assert cut["en"].limit == 0.01 and cut["en"].pool == "en" and cut["en"].n_good == 600
    share = max(1000 * 20 // (sum(map(len, t.split()))) for _, t, _ in good[:60])
    assert cut["en"].cutoffs.symbols == min(c for c in o6.GRID if c >= share)
    assert cut["fr"].pool == cut["es"].pool == "" and cut["fr"].limit == 0.05 and cut["fr"].n_good == 110 and cut["fr"].cutoffs.symbols == 10
    assert cut["en"].cutoffs.repeats is None


def test_quality_counts_of_long_texts_and_clashing_columns(spark, monkeypatch):
    r = random.Random(6)
    texts = [" ".join(r.choice("abcd") for _ in range(n)) for n in (20, 40, 200)] + ["x " * 300_000, "y" * 2_000_000]
    docs = spark.createDataFrame([(i, t, "en", "t", "row", "q", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, __t string, row string, q string, __quality int")
    one = sorted(tuple(x.q) for x in o6.with_features(docs).select(F.col("q")).collect())
    monkeypatch.setattr(o6, "PACK", 4)
    assert sorted(tuple(x.q) for x in o6.with_features(docs.where("doc_id < 3")).select("q").collect()) == sorted(x for x in one if x[0] in (20, 40, 200))
    monkeypatch.undo()
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out = o6.quality_filter(docs.withColumn("text", F.lit("one two three four five six seven eight nine ten")), labels)
    assert out.columns == docs.columns and out.where("__t = 't' and row = 'row' and q = 'q' and __quality = 1").count() == len(texts)


def brute_print(t):
    w = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    ids = [1 << 62 if d is None else d for d, _ in prints]
    f = np.array([p for _, p in prints], np.uint64)
    root = list(range(len(f)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 2).tolist():
            a, b = find(i), find(j)
            if a != b:
                root[a] = b
    least = {}
    for i in range(len(f)):
        least[find(i)] = min(least.get(find(i), 1 << 63), ids[i])
    return sorted((ids[i], f"{int(f[i]):016x}", least[find(i)]) for i in range(len(f)))


def test_simhash(spark):
    r = random.Random(9)
    base = [r.choice(["the", "a", "Étoile"]) + str(r.randint(0, 900)) for _ in range(120)]
    rows = []
    for i in range(300):
        w = list(base) if i % 2 else [str(r.random()) for _ in range(r.randint(0, 6))]
        for _ in range(r.randint(0, 2)):
            if i % 2:
                w.insert(r.randrange(len(w)), str(i))
        rows.append((1000 - i, " ".join(w), "", "", 0))
    rows += [(5000, None, "", "", 0), (5001, " \n", "", "", 0), (None, rows[1][1], "", "", 0), (999, "twice", "", "", 0), (None, "alone with no other text", "", "", 0)]
    got = o3.simhash_components(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    big = lambda d: 1 << 62 if d is None else d
    assert sorted((big(x.doc_id), x.fingerprint, big(x.component_id)) for x in got) == brute_components([(d, brute_print(t)) for d, t, *_ in rows])
    assert o3.simhash_components(spark.createDataFrame([], SCHEMA)).collect() == []


def test_simhash_of_a_very_long_text(spark):
    t = " ".join(f"w{i % 7001}" for i in range(300_000))
    got = o3.simhash_components(spark.createDataFrame([(1, t), (2, t + " x"), (3, "y" * 1_000_000)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {1: f"{brute_print(t):016x}", 2: f"{brute_print(t + ' x'):016x}", 3: f"{brute_print('y' * 1_000_000):016x}"}
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3}


def test_links_in_crowded_cells_are_those_of_small_ones(monkeypatch):
    r = np.random.default_rng(3)
    f = r.integers(0, 1 << 63, 40, np.uint64)
    fp = np.unique(np.concatenate([f, *(f ^ (np.uint64(1) << np.uint64(b)) ^ (np.uint64(1) << np.uint64(b + 3)) for b in range(0, 60, 7))]))
    cell = np.zeros(len(fp), np.int64)
    got = []
    for most in (10_000, 1):
        monkeypatch.setattr(o3, "CROWDED", most)
        a, b = o3._links(cell, fp)
        n, root = o3._forest(fp[a].astype(np.int64), fp[b].astype(np.int64))
        got.append(sorted(zip(n.tolist(), root.tolist(), strict=True)))
    assert got[0] == got[1] and len(got[0]) > 100


def test_grid_never_misses_a_link():
    r = np.random.default_rng(2)
    f = r.integers(0, 1 << 63, 500, np.uint64)
    for _ in range(20):
        g = f ^ (np.uint64(1) << r.integers(0, 64, 500, np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 500, np.uint64))
        import pyarrow as pa

        cells = []
        for x in (f, g):
            b = next(o3._cells([pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(np.arange(500))], names=["fp", "doc"])]))
            cells.append({(c, d) for c, d in zip(b["cell"].to_pylist(), b["doc"].to_pylist(), strict=True)})
        assert {d for _, d in cells[0] & cells[1]} == set(range(500))
