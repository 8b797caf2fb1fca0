"""Whole assets and models: label patterns and gates, fingerprints, matched boxes, calibration by cell, attack success."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from . import ranks


def label_patterns(df: DataFrame, contributor: str, given: str, suggested: str, p: str, top: int = 20) -> DataFrame:
    """The ``top`` (contributor, given, suggested) disagreements by smallest p, with their counts."""
    g = df.where(F.col(given) != F.col(suggested)).groupBy(contributor, given, suggested).agg(F.count(F.lit(1)).alias("n"), F.min(p).alias("min_p"))
    return g.orderBy("min_p", contributor, given, suggested).limit(top)


def standardised(reference: DataFrame, df: DataFrame, id_col: str, vector: str, cap: float = 1e3) -> DataFrame:
    """Largest deviation in clean standard deviations over live dimensions; dimensions without spread are counted apart, each worth ``cap`` if it moved."""
    dims = reference.select(F.posexplode(vector).alias("dim", "x")).groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("mu"), F.stddev_pop(F.col("x").cast("double")).alias("sd"))
    x = df.select(id_col, F.posexplode(vector).alias("dim", "x")).join(F.broadcast(dims), "dim")  # a row a dimension
    gap, live = F.abs(F.col("x").cast("double") - F.col("mu")), F.col("sd") > 1e-12
    g = x.groupBy(id_col).agg(F.max(F.when(live, gap / F.col("sd"))).alias("live"), F.count_if(~live & (gap > 1e-12)).alias("dead_moved"))
    return g.withColumn("score", F.least(F.greatest(F.coalesce("live", F.lit(0.0)), F.when(F.col("dead_moved") > 0, cap).otherwise(0.0)), F.lit(cap)))


def agreement(a: DataFrame, b: DataFrame, id_col: str, label: str, by: str) -> DataFrame:
    """Share of common inputs with one prediction in both, by group: below .5 CRITICAL, below .8 HIGH, below 1 MEDIUM."""
    j = a.select(id_col, by, F.col(label).alias("__a")).join(b.select(id_col, F.col(label).alias("__b")), id_col)
    g = j.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("__a") == F.col("__b")).cast("double")).alias("agreement"))
    return g.withColumn("severity", F.when(F.col("agreement") < 0.5, "CRITICAL").when(F.col("agreement") < 0.8, "HIGH").when(F.col("agreement") < 1, "MEDIUM").otherwise("INFO"))


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, centroid): medians by class and dimension, a row a class."""
    m = df.select(label, F.posexplode(vector).alias("dim", "x")).groupBy(label, "dim").agg(F.percentile(F.col("x").cast("double"), 0.5).alias("x"))
    return m.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("centroid"))


def label_gate(reference: DataFrame, df: DataFrame, asset: str, label: str, vector: str, is_clean: Column) -> DataFrame:
    """Rows of an asset whose nearest centroid isn't their label's, and the count's rank among clean assets as a p-value.

    Centroids come as one row of all classes; clean counts as one sorted array, a number an asset.
    """
    all_c = centroids(reference, label, vector).agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), "centroid"))).alias("cs"))
    dist = lambda c: F.aggregate(F.zip_with(F.col(vector), c["centroid"], lambda x, y: F.pow(x.cast("double") - y, 2)), F.lit(0.0), lambda s, v: s + v)
    near = F.array_min(F.transform("cs", lambda c: F.struct(dist(c).alias("d"), c["label"].alias("label"))))["label"]
    g = df.join(F.broadcast(all_c)).groupBy(asset).agg(F.count(F.lit(1)).alias("n"), F.count_if(near != F.col(label)).alias("mismatches"))
    clean = g.where(is_clean).agg(F.collect_list("mismatches").alias("clean"))
    p = (F.lit(1.0) + F.size(F.filter("clean", lambda c: c >= F.col("mismatches")))) / (F.lit(1.0) + F.size("clean"))
    return g.join(F.broadcast(clean)).select(asset, "n", "mismatches", p.alias("p"))


def concept_drift(df: DataFrame, operational: Column, predicted: str, truth: str, covariate_signal: bool = False, most: float = 0.1) -> DataFrame:
    """Accuracy on both sides; concept drift: it falls by over ``most`` without a covariate signal."""
    right = (F.col(predicted) == F.col(truth)).cast("double")
    g = df.agg(F.avg(F.when(~operational, right)).alias("reference"), F.avg(F.when(operational, right)).alias("operational"))
    return g.withColumn("drop", F.col("reference") - F.col("operational")).withColumn("concept_drift", (F.col("drop") > most) & F.lit(not covariate_signal))


def unmatched(reference: DataFrame, suspect: DataFrame, image: str = "image_id", threshold: float = 0.5) -> DataFrame:
    """Per image: reference boxes, and those that no suspect box of their class overlaps by ``threshold``; rows (image, class_id, x1, y1, x2, y2)."""
    sides = ("x1", "y1", "x2", "y2")
    a = reference.groupBy(image, "class_id").agg(F.collect_list(F.struct(*sides)).alias("a"))
    b = suspect.groupBy(image, "class_id").agg(F.collect_list(F.struct(*sides)).alias("b"))
    hit = lambda x: F.exists("b", lambda y: stats.iou({k: x[k] for k in sides}, {k: y[k] for k in sides}) >= threshold)
    lost = F.size("a") - F.coalesce(F.size(F.filter("a", hit)), F.lit(0)) * F.col("b").isNotNull().cast("int")
    j = a.join(b, [image, "class_id"], "left")
    return j.groupBy(image).agg(F.sum(F.size("a")).alias("n"), F.sum(lost).alias("unmatched")).withColumn("divergence", F.col("unmatched") / F.col("n"))


def greedy_match(reference: DataFrame, suspect: DataFrame, image: str = "image_id", threshold: float = 0.5) -> DataFrame:
    """One-to-one pairs (image, class_id, a, b, iou) of box ids by falling IoU within class; ties to the smaller ids.

    Rows (image, class_id, box, x1, y1, x2, y2).  Boxes of one image and class meet in a task, as a detector's output bounds them.
    """
    sides = ("x1", "y1", "x2", "y2")
    a = reference.select(image, "class_id", F.col("box").alias("a"), *[F.col(s).alias(f"a{s}") for s in sides])
    b = suspect.select(image, "class_id", F.col("box").alias("b"), *[F.col(s).alias(f"b{s}") for s in sides])
    iou = stats.iou({s: F.col(f"a{s}") for s in sides}, {s: F.col(f"b{s}") for s in sides})
    pairs = a.join(b, [image, "class_id"]).withColumn("iou", iou).where(F.col("iou") >= threshold)
    listed = pairs.groupBy(image, "class_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("o"), "a", "b"))).alias("ps"))
    free = lambda s, x: ~F.exists(s, lambda y: (y["a"] == x["a"]) | (y["b"] == x["b"]))
    none = F.filter("ps", lambda _: F.lit(False))
    kept = F.aggregate("ps", none, lambda s, x: F.when(free(s, x), F.concat(s, F.array(x))).otherwise(s))
    return listed.select(image, "class_id", F.explode(kept).alias("m")).select(image, "class_id", "m.a", "m.b", (-F.col("m.o")).alias("iou"))


def detection_quality(truth: DataFrame, found: DataFrame, image: str = "image_id", threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and mean IoU of greedy matches over all images; denominators are at least 1 (F1: 1e-9)."""
    m = greedy_match(truth, found, image, threshold).agg(F.count(F.lit(1)).alias("tp"), F.avg("iou").alias("mean_iou"))
    n = truth.agg(F.count(F.lit(1)).alias("n_true")).join(found.agg(F.count(F.lit(1)).alias("n_found"))).join(m)
    p, r = F.col("tp") / F.greatest("n_found", F.lit(1)), F.col("tp") / F.greatest("n_true", F.lit(1))
    return n.select("n_true", "n_found", "tp", p.alias("precision"), r.alias("recall"), (2 * p * r / F.greatest(p + r, F.lit(1e-9))).alias("f1"), F.coalesce("mean_iou", F.lit(0.0)).alias("mean_iou"))


def paired_fingerprint(reference: DataFrame, suspect: DataFrame, image: str = "image_id", threshold: float = 0.5) -> DataFrame:
    """Per image: boxes of either side, greedy matches within class, boxes of one side only, their Jaccard index, mean IoU and mean score gap.

    Rows (image, class_id, box, x1, y1, x2, y2, score).  An image without matches has null means; one with no box on a side counts 0 there.
    """
    a = reference.groupBy(image).agg(F.count(F.lit(1)).alias("n_reference"))
    b = suspect.groupBy(image).agg(F.count(F.lit(1)).alias("n_suspect"))
    m = greedy_match(reference, suspect, image, threshold)
    m = m.join(reference.select(image, F.col("box").alias("a"), F.col("score").alias("__sa")), [image, "a"]).join(suspect.select(image, F.col("box").alias("b"), F.col("score").alias("__sb")), [image, "b"])
    m = m.groupBy(image).agg(F.count(F.lit(1)).alias("matched"), F.avg("iou").alias("mean_iou"), F.avg(F.col("__sa") - F.col("__sb")).alias("score_gap"))
    j = a.join(b, image, "full").join(m, image, "left").fillna(0, ["n_reference", "n_suspect", "matched"])
    return j.select("*", (F.col("n_reference") - F.col("matched")).alias("reference_only"), (F.col("n_suspect") - F.col("matched")).alias("suspect_only"), (F.col("matched") / (F.col("n_reference") + F.col("n_suspect") - F.col("matched"))).alias("jaccard"))


def label_nll(df: DataFrame, asset: str, image: str, p: str, share: float = 0.1) -> DataFrame:
    """Per asset: images and the mean of the largest ``share`` of their worst -log p of the given label (floor 1e-12)."""
    worst = df.groupBy(asset, image).agg(F.max(-F.log(F.greatest(F.col(p).cast("double"), F.lit(1e-12)))).alias("nll"))
    w = Window.partitionBy(asset)
    r = worst.withColumn("__k", F.row_number().over(w.orderBy(F.desc("nll"), image))).withColumn("__n", F.count(F.lit(1)).over(w))
    return r.groupBy(asset).agg(F.count(F.lit(1)).alias("n_images"), F.max("nll").alias("worst"), F.avg(F.when(F.col("__k") <= F.greatest(F.ceil(F.col("__n") * share), F.lit(1)), F.col("nll"))).alias("top_mean"))


def attack_success(df: DataFrame, kind: str, attacked: Column, success: Column, least: int = 20, implanted: float = 0.5) -> DataFrame:
    """Net success by kind: attacked rate less the clean-null rate, not below 0; too few of either: unassessable."""
    s = success.cast("double")
    g = df.groupBy(kind).agg(F.count_if(attacked).alias("n_attacked"), F.count_if(~attacked).alias("n_null"), F.avg(F.when(attacked, s)).alias("a"), F.avg(F.when(~attacked, s)).alias("b"))
    enough = F.least("n_attacked", "n_null") >= least
    net = F.when(enough, F.greatest(F.col("a") - F.col("b"), F.lit(0.0)))
    return g.select(kind, "n_attacked", "n_null", net.alias("net"), F.when(~enough, "unassessable").when(net >= implanted, "implanted").otherwise("weak").alias("status"))


def exchangeability(df: DataFrame, by: str, x: str, tests: int = 1, alpha: float = 0.05) -> DataFrame:
    """n, mean, sd, quartiles by group and what its size allows: the smallest p-value and whether that can reject among ``tests``."""
    g = df.groupBy(by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))
    g = g.join(ranks.quantiles(df, x, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, (by,)).drop("n"), by, "left")
    return g.withColumn("floor", F.lit(1.0) / (F.col("n") + 1)).withColumn("can_reject", F.col("floor") <= alpha / tests)


def score_summary(df: DataFrame, by: str, x: str) -> DataFrame:
    """Mean, 95 % quantile and largest of a group's finite scores, with how many there are of how many."""
    v = F.col(x).cast("double")
    ok = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count(ok).alias("n_finite"), F.avg(ok).alias("mean"), F.max(ok).alias("max")).join(ranks.quantiles(df.withColumn("__ok", ok), "__ok", {"q95": 0.95}, (by,)).drop("n"), by, "left")


def kind_summary(df: DataFrame, kind: str, x: str, gated: Column) -> DataFrame:
    """Mean and population spread by kind without gated rows, which are counted."""
    live = F.when(~gated, F.col(x).cast("double"))
    return df.groupBy(kind).agg(F.count(live).alias("n"), F.count_if(gated).alias("n_gated"), F.avg(live).alias("mean"), F.stddev_pop(live).alias("sd"))


def output_digest(df: DataFrame, by: str, order: list[str], values: list[str], step: float) -> DataFrame:
    """sha256 of each group's outputs, quantised to ``step``, by ``order`` and then by content."""
    cell = F.concat_ws(",", *[stats.quantized(F.col(v).cast("double"), step).cast("long").cast("string") for v in values])
    rows = F.array_sort(F.collect_list(F.struct(*order, cell.alias("__cell"))))
    return df.groupBy(by).agg(F.sha2(F.concat_ws(";", F.transform(rows, lambda r: r["__cell"])), 256).alias("digest"))
