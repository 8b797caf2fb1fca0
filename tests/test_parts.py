"""Functions, readers, streams and chains outside the registered queries."""

import json
import math

import pytest
from pyspark.sql import functions as F

from veridune.functions import stats
from veridune.operators import chains, decisions, ledger, population, quality
from veridune.plans.planner import Detector, Registry, completeness
from veridune.sources import detections
from veridune.streaming import monitor


def test_special_functions():
    for n, k, p in ((10, 3, 0.2), (40, 0, 0.05), (25, 24, 0.9), (200, 17, 0.11)):
        tail = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
        assert abs(stats.binom_tail_ge(k, n, p) - tail) < 1e-10
    u = stats.clopper_pearson_upper(3, 50)
    assert abs(sum(math.comb(50, i) * u**i * (1 - u) ** (50 - i) for i in range(4)) - 0.05) < 1e-9
    assert abs(stats.clopper_pearson_upper(0, 59) - (1 - 0.05 ** (1 / 59))) < 1e-12 and stats.clopper_pearson_upper(5, 5) == 1.0
    assert abs(stats.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-9 and abs(stats.chi2_sf(18.307038053275146, 10) - 0.05) < 1e-9
    assert stats.exact_power(50, 0.1, 0.4) > 0.99 and 0.2 < stats.minimum_detectable(50, 0.1) < 0.35
    assert decisions.mcnemar_arms(0.5, 0.8) > 30


def test_refusals(spark):
    df = spark.createDataFrame([(0, 0), (0, 19), (0, 20), (3, 100)], "k long, n long").select(stats.rate(F.col("k"), F.col("n")).alias("r"), stats.zero_hit_bound(F.col("n")).alias("b")).collect()
    assert [r.r.status for r in df] == ["insufficient_denominator"] * 2 + ["ok"] * 2
    assert df[0].r.point is None and df[2].r.point == 0.0 and df[0].b == 1.0


def test_ledger_rules(spark):
    rows = [("a", "c", "bad", True, "calibration", {"s": 1.0}), ("a", "c", "bad", True, "calibration", {"s": float("nan")}), ("", "c", "odd", False, "x", {"s": 1.0, "t": 2.0}), ("b", "c", "good", True, None, None)]
    got = {r.rule for r in ledger.problems(spark.createDataFrame(rows, ledger.RECORD), ["bad", "both"], ["good", "both"]).collect()}
    assert got == {"duplicate_key", "non_finite_score", "missing_id", "undeclared_kind", "unknown_split", "polarity_mismatch", "no_scores", "partial_signal", "kind_both_ways"}
    ok = spark.createDataFrame([(str(i), "c", "bad" if i % 2 else "good", bool(i % 2), "calibration", {"s": 1.0 * i}) for i in range(6)], ledger.RECORD)
    assert ledger.problems(ok, ["bad"], ["good"]).count() == 0
    fused = ledger.fuse_ledger(ledger.long_form(ok))
    assert {r.signal for r in fused.select("signal").distinct().collect()} == {"s", "fused_bonferroni", "fused_cauchy", "fused_by_global"}


def test_manifest_rules(spark):
    rows = [("m", "m", "k", "a" * 64, "b" * 16, 0.5), ("m", "n", "k", "A" * 64, None, 1.5), (None, "x", "k", "a" * 64, "b" * 16, float("nan"))]
    p = population.manifest_problems(spark.createDataFrame(rows, "model_id string, dir string, kind string, weights_digest string, spec_digest string, f1 double"))
    assert sorted((r.key, r.rule) for r in p.collect()) == [("", "f1_range"), ("", "missing_id"), ("m", "f1_range"), ("m", "id_is_not_directory"), ("m", "spec_digest"), ("m", "weights_digest")]
    assert population.verdict(p, ["missing_id"], []).first().code == 3


def test_no_findings_is_review(spark):
    r = quality.overall_risk(spark.createDataFrame([], "severity string")).first()
    assert (r.risk, r.disposition) == ("LOW", "REVIEW")


def test_merkle_proofs(spark):
    leaves = [f"leaf {i}" for i in range(11)]
    levels = chains.merkle_levels(spark.createDataFrame(list(enumerate(leaves)), "pos long, content string"), "pos", "content").cache()
    root = levels.orderBy(F.desc("level")).first().hash
    for i in (0, 5, 10):
        proof = [(r.hash, r.is_left) for r in chains.merkle_proof(levels, i).orderBy("level").collect()]
        assert chains.proof_holds(leaves[i], proof, root) and not chains.proof_holds("other", proof, root)
    assert chains.attestation_root([b"a", b"b", b"c"]) != chains.attestation_root([b"a", b"c", b"b"])


def test_seals(spark):
    seals = spark.createDataFrame([("k1", "h"), ("k2", "h"), ("k3", "h"), ("k4", "h")], "key_id string, alg string")
    trust = spark.createDataFrame([("k1", "h", False), ("k2", "h", True), ("k3", "e", False)], "key_id string, alg string, revoked boolean")
    assert {r.key_id: r.status for r in chains.verify_seals(seals, trust).collect()} == {"k1": "ok", "k2": "revoked", "k3": "alg_mismatch", "k4": "unknown_key"}
    assert seals.select(chains.sign("x", F.col("key_id")).alias("m")).where("length(m) = 64").count() == 4


def test_coco_yolo_round_trip(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "a.jpg", "width": 100, "height": 50}, {"id": 2, "file_name": "b.jpg", "width": 10, "height": 10}], "annotations": [{"id": 1, "image_id": 1, "category_id": 0, "bbox": [10, 10, 20, 10]}, {"id": 2, "image_id": 1, "category_id": 9, "bbox": [0, 0, 50, 25]}, {"id": 3, "image_id": 1, "category_id": 0, "bbox": [1, 2]}], "categories": [{"id": 0, "name": "car"}]}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    coco = detections.load(spark, str(tmp_path / "c.json"))
    got = {r.image_id: r.boxes for r in coco.collect()}
    assert got[2] == [] and sorted((b.x_center, b.class_name) for b in got[1]) == [(0.2, "car"), (0.25, "unknown")]
    (tmp_path / "y/images").mkdir(parents=True)
    (tmp_path / "y/labels").mkdir()
    for s in "ab":
        (tmp_path / f"y/images/{s}.jpg").write_bytes(b"x")
    (tmp_path / "y/labels/a.txt").write_text("0 0.2 0.3 0.2 0.2\n9 0.25 0.25 0.5 0.5 0.9\nbroken\n")
    yolo = detections.load(spark, str(tmp_path / "y"), names={0: "car"})
    by = {r.stem: r.boxes for r in yolo.collect()}
    assert by["b"] == [] and {b.class_name for b in by["a"]} == {"car", "class_9"} and {b.confidence for b in by["a"]} == {1.0, 0.9}
    a = coco.select(F.regexp_extract("file_name", r"^(.*)\.", 1).alias("stem"), "boxes")
    assert {r.status for r in detections.parity(a, yolo).collect()} == {"same"}
    assert detections.read_names("names:\n  0: a\n  1: b\n") == {0: "a", 1: "b"} and detections.read_names("names: [x, 'y']") == {0: "x", 1: "y"}
    with pytest.raises(ValueError):
        detections.load(spark, "x", kind="nope")


def test_nms(spark):
    df = spark.createDataFrame([(1, 0, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 0, 0.8, 1.0, 1.0, 10.0, 10.0), (1, 1, 0.7, 0.0, 0.0, 10.0, 10.0), (1, 0, 0.6, 20.0, 20.0, 30.0, 30.0)], "image_id int, class_id int, score double, x1 double, y1 double, x2 double, y2 double")
    assert sorted(r.score for r in detections.nms(df).collect()) == [0.6, 0.7, 0.9]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i % 5, i, 200.0 if i % 5 == 0 or i % 7 == 0 else 1.0) for i in range(200)] + [(9, 500, float("nan"))]
    df = spark.createDataFrame(rows, "asset long, t long, score double")
    want = {r.asset: (r.steps, round(r.log_wealth, 9), r.alarm_at, r.refused) for r in monitor.eprocess(df, "asset", "t", "score", 100.0, 0.1).collect()}
    for k in range(2):
        df.where(F.col("t") < 100 if k == 0 else F.col("t") >= 100).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = monitor.stream_monitor(s, "asset", "t", "score", 100.0, 0.1).writeStream.outputMode("update").format("memory").queryName("wealth").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {}
    for r in spark.table("wealth").orderBy("steps").collect():
        got[r.asset] = (r.steps, round(r.log_wealth, 9), int(r.alarm_at) if r.alarm_at else None, r.refused)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert got[0][2] is not None and got[9][3] and want[9][3]


def test_stream_replays(spark, tmp_path):
    rows = [("k", 1, "a", 1), ("k", 2, "b", 2), ("k", 2, "c", 3), ("k", 5, "a", 4), ("m", 9, "b", 5), ("m", 8, "d", 6)]
    kind = "key string, seq long, nonce string, arrived long"
    s = spark.readStream.schema(kind).parquet(str(tmp_path / "in" / "*"))
    for part, some in (("1", rows[3::-1]), ("2", rows[4:])):  # a batch in reverse order, then one more under another key
        spark.createDataFrame(some, kind).coalesce(1).write.parquet(str(tmp_path / "in" / part))
        q = monitor.stream_replays(s, "key", "seq", "nonce", "arrived").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    want = chains.replays(spark.createDataFrame(rows, kind), "key", "seq", "nonce").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) == [("k", 2, "c", "stale_sequence"), ("k", 5, "a", "replayed_nonce"), ("m", 8, "d", "stale_sequence"), ("m", 9, "b", "replayed_nonce")]


def test_planner(spark):
    r = Registry()
    run = lambda s, d: s.range(1)
    r.add(Detector("a", frozenset({"x"}), run, cost=1))
    r.add(Detector("b", frozenset({"x", "y"}), run, cost=2))
    r.add(Detector("c", frozenset({"z"}), lambda s, d: 1 / 0, needs=frozenset({"weights"}), cost=1))
    assert r.plan({"weights"}, {"x": 1.0, "y": 1.0, "z": 1.0}, 3) == ["b", "c"] and r.plan(set(), {"x": 1.0}, 3) == ["b"]
    out, status = r.execute(spark, "", ["b", "c"])
    assert list(out) == ["b"] and completeness(status, ["b", "c"]).first().blocking == ["c"]
    with pytest.raises(ValueError):
        r.add(Detector("a", frozenset({"x"}), run))


def test_entry_points():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_greedy_match_against_brute_force(spark):
    import random

    from veridune.operators import assets

    r = random.Random(5)
    box = lambda i: (r.randrange(6), r.choice("ab"), i, float(x := r.randrange(30)), float(y := r.randrange(30)), x + 20.0, y + 20.0)
    a, b = [box(i) for i in range(80)], [box(i) for i in range(80)]
    schema = "image_id int, class_id string, box int, x1 double, y1 double, x2 double, y2 double"
    da, db = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)

    def iou(p, q):
        w, h = max(0, min(p[5], q[5]) - max(p[3], q[3])), max(0, min(p[6], q[6]) - max(p[4], q[4]))
        return w * h / (800 - w * h)

    pairs = sorted((-iou(p, q), p[2], q[2]) for p in a for q in b if p[:2] == q[:2] and iou(p, q) >= 0.3)
    want, left, right = [], set(), set()
    for o, i, j in pairs:
        if i not in left and j not in right:
            want.append((i, j, round(-o, 9)))
            left.add(i)
            right.add(j)
    got = [(x.a, x.b, round(x.iou, 9)) for x in assets.greedy_match(da, db, threshold=0.3).collect()]
    assert sorted(got) == sorted(want) and len(want) > 10
    q = assets.detection_quality(da, db, threshold=0.3).first()
    assert (q.n_true, q.n_found, q.tp) == (80, 80, len(want)) and abs(q.f1 - len(want) / 80) < 1e-9
    none = assets.detection_quality(da.where("false"), db.where("false")).first()
    assert (none.tp, none.precision, none.f1, none.mean_iou) == (0, 0.0, 0.0, 0.0)
    lost = {x.image_id: x.unmatched for x in assets.unmatched(da, db, threshold=0.3).collect()}
    assert lost == {i: sum(p[0] == i and not any(p[:2] == q[:2] and iou(p, q) >= 0.3 for q in b) for p in a) for i in {p[0] for p in a}}


def test_standardised_counts_dead_dimensions_apart(spark):
    from veridune.operators import assets

    ref = spark.createDataFrame([(1, [0.0, 5.0]), (2, [2.0, 5.0])], "id int, v array<double>")
    got = {x.id: (x.score, x.dead_moved) for x in assets.standardised(ref, spark.createDataFrame([(3, [4.0, 5.0]), (4, [1.0, 6.0])], "id int, v array<double>"), "id", "v").collect()}
    assert got == {3: (3.0, 0), 4: (1000.0, 1)}


def test_spectral_and_mahalanobis_against_numpy(spark):
    import numpy as np

    from veridune.operators import spectral

    r = np.random.default_rng(2)
    x, y = r.normal(size=(300, 6)) * [1, 2, 3, 1, 1, 1], r.integers(0, 3, 300)
    y[:4] = 7  # a class too small to judge
    df = spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(300)] + [(900, None, [0.0] * 6), (901, 1, None)], "id int, label int, v array<double>").repartition(5)
    want = {}
    for c in range(3):
        i = np.flatnonzero(y == c)
        z = x[i] - x[i].mean(axis=0)
        p = z @ np.linalg.svd(z, full_matrices=False)[2][0]
        want |= {int(a): b for a, b in zip(i, np.abs(p - p.mean()) / (p.std() + 1e-12), strict=True) if b > 2}
    got = {q.id: q.z for q in spectral.spectral_outliers(df, "id", "label", "v").collect()}
    assert got.keys() == want.keys() and len(got) > 3 and all(abs(got[k] - want[k]) < 1e-6 for k in got)
    ref = x[:200]
    inv = np.linalg.inv(np.cov(ref.T) + 1e-6 * np.eye(6))
    far = np.sqrt(np.einsum("ij,jk,ik->i", x - ref.mean(axis=0), inv, x - ref.mean(axis=0)))
    flags = {q.id: (q.distance, q.flagged) for q in spectral.ood_flags(df.where("id < 200"), df.where("id < 300"), "id", "v").collect()}
    cut = np.quantile(far[:200], 0.95)
    assert all(abs(flags[i][0] - far[i]) < 1e-6 and flags[i][1] == (far[i] > cut + 1e-12) for i in range(300) if abs(far[i] - cut) > 1e-9)
    assert spectral.spectral_outliers(df.where("false"), "id", "label", "v").collect() == []


def test_concentration_test(spark):
    from pyspark.sql import functions as F

    from veridune.operators import spectral

    even = [(c, i % 5 == 0) for c in range(8) for i in range(40)]
    test = lambda rows: spectral.concentration_test(spark.createDataFrame(rows, "c int, f boolean"), "c", F.col("f")).first()
    assert test(even).p > 0.5
    hot = test(even + [(9, i < 25) for i in range(30)])
    assert hot.p < 0.01 and hot.contributors == 9 and abs(hot.max_rate - 25 / 30) < 1e-12
    assert test([(1, True)] * 20).p is None and test(even + [(10, True)] * 3).p is None and test([]).contributors == 0


def test_archives_and_folders(spark, tmp_path):
    import hashlib
    import io
    import tarfile

    from veridune.sources import detections

    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        for name, body in (("m1/manifest.json", b'{"model_id": "m1"}'), ("m1/weights.bin", b"\0" * 3_000_000), ("empty", b"")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    (tmp_path / "bad.tar").write_bytes(b"this is no archive")
    got = {(r.archive.rsplit("/", 1)[-1], r.name): (r.size, r.sha256, r.content) for r in detections.read_archives(spark, str(tmp_path)).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {
        ("a.tar.gz", "m1/manifest.json"): (18, sha(b'{"model_id": "m1"}'), '{"model_id": "m1"}'),
        ("a.tar.gz", "m1/weights.bin"): (3_000_000, sha(b"\0" * 3_000_000), None),
        ("a.tar.gz", "empty"): (0, sha(b""), None),
        ("bad.tar", None): (None, None, None),
    }
    wanted = spark.createDataFrame([("1.png",), ("2.png",), ("2.png",), (None,)], "file_name string")
    files = spark.createDataFrame([("x", "1.png"), ("x", "9.png"), ("y", "1.png"), ("y", "2.png"), ("y", "2.png")], "folder string, file_name string")
    assert detections.best_folder(wanted, files).collect() == [("y", 2)]
    assert detections.best_folder(wanted.where("false"), files).collect() == []


def test_islands_across_spans(spark, monkeypatch):
    top, low, span = (1 << 63) - 1, -(1 << 63), population.SPAN
    seeds = [*range(-70000, -3), *range(0, 5), 7, *range(span - 2, 3 * span + 1), 4 * span - 1, 4 * span, 5 * span, 6 * span - 1, low, low + 1, top - 1, top]
    rows = [("a", x) for x in seeds] + [("b", x) for x in (span - 1, span, span, 3)] + [(None, 2 * span), (None, 2 * span + 1), ("a", None)]
    out = population.islands(spark.createDataFrame(rows, "k string, x long"), ["k"], "x")
    want = {}
    for k, x in sorted({r for r in rows if r[1] is not None}, key=lambda r: (str(r[0]), r[1])):
        runs = want.setdefault(k, [])
        if runs and runs[-1][1] == x - 1:
            runs[-1] = (runs[-1][0], x, runs[-1][2] + 1)
        else:
            runs.append((x, x, 1))
    assert sorted((str(r.k), r.first, r.last, r.n) for r in out.select("k", F.col("first").alias("first_"), "last", "n").toDF("k", "first", "last", "n").collect()) == sorted((str(k), *x) for k, v in want.items() for x in v)
    plan = out._jdf.queryExecution().executedPlan().toString()
    runs = [line for line in plan.splitlines() if "lead(__s" in line]
    assert runs and all("__b" in line for line in runs) and "row_number()" not in plan  # before: a task sorted all of k


def test_islands_of_other_numbers(spark):
    rows = [(1, "0.5"), (1, "1.5"), (1, "65535.5"), (1, "65536.5"), (1, "9")]
    for t in ("double", "decimal(20,1)"):
        out = population.islands(spark.createDataFrame(rows, "k int, x string").withColumn("x", F.col("x").cast(t)), ["k"], "x")
        assert sorted((float(r["first"]), float(r["last"]), r["n"]) for r in out.collect()) == [(0.5, 1.5, 2), (9.0, 9.0, 1), (65535.5, 65536.5, 2)]
