"""Censuses of sharded populations: runs of seeds, collisions, reconciliation of plan and disk, verdicts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def problem_rows(df: DataFrame, key: Column, rules: list[tuple[str, Column, Column]]) -> DataFrame:
    """(rule, key, detail) for every rule a row breaks."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("rule"), F.coalesce(x.cast("string"), F.lit("")).alias("detail"))) for n, c, x in rules]))
    return df.select(key.cast("string").alias("key"), F.inline(broken)).select("rule", "key", "detail")


def manifest_problems(manifests: DataFrame) -> DataFrame:
    """Rules of a model manifest: (model_id, dir, kind, weights_digest, spec_digest, f1)."""
    hexes = lambda c, n: F.col(c).isNull() | ~F.col(c).rlike(f"^[0-9a-f]{{{n}}}$")
    return problem_rows(
        manifests,
        F.coalesce("model_id", F.lit("")),
        [
            ("missing_id", F.coalesce(F.col("model_id"), F.lit("")) == "", F.lit("")),
            ("id_is_not_directory", F.col("model_id") != F.col("dir"), F.col("dir")),
            ("weights_digest", hexes("weights_digest", 64), F.col("weights_digest")),
            ("spec_digest", hexes("spec_digest", 16), F.col("spec_digest")),
            ("f1_range", F.col("f1").isNull() | F.isnan("f1") | (F.col("f1") < 0) | (F.col("f1") > 1), F.col("f1")),
        ],
    )


def seed_of(model_id: Column) -> Column:
    return F.regexp_extract(model_id, r"_s(\d+)$", 1).try_cast("long") if hasattr(Column, "try_cast") else F.expr("null")


SPAN = 1 << 16


def islands(df: DataFrame, by: list[str], seed: str) -> DataFrame:
    """(by, first, last, n) of each run of consecutive distinct seeds.

    Runs are found inside spans of ``SPAN`` seed values, so that no task sorts all of a group; those that touch a border of their
    span, two a span at most, are then joined to their neighbours.
    """
    base = F.col("__s") - F.pmod(F.col("__s"), F.lit(SPAN))
    s = df.where(F.col(seed).isNotNull()).select(*by, F.col(seed).alias("__s")).distinct().withColumn("__b", base)
    w = Window.partitionBy(*by, "__b").orderBy("__s")
    s = s.withColumn("__start", F.coalesce(F.col("__s") - F.lag("__s").over(w) != 1, F.lit(True))).withColumn("__end", F.coalesce(F.lead("__s").over(w) - F.col("__s") != 1, F.lit(True)))
    ends = s.where("__start or __end").withColumn("last", F.when(F.col("__end"), F.col("__s")).otherwise(F.lead("__s").over(w)))  # in the order it has: nothing is hashed
    runs = ends.where("__start").select(*by, "__b", F.col("__s").alias("first"), "last", (F.col("last") - F.col("__s") + 1).cast("long").alias("n"))
    edge = (F.col("first") - F.col("__b") < 1) | (F.col("last") - F.col("__b") >= SPAN - 1)
    w = Window.partitionBy(*by).orderBy("first")
    follows = F.coalesce(F.lag("last").over(w) == F.try_subtract("first", F.lit(1)), F.lit(False))
    open_ = runs.where(edge).withColumn("__new", (~follows).cast("long")).withColumn("__run", F.sum("__new").over(w))
    joined = open_.groupBy(*by, "__run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    return runs.where(~edge).select(*by, "first", "last", "n").unionByName(joined.select(*by, "first", "last", "n"))


def collisions(entries: DataFrame, key: str, source: str, digest: str | None = None) -> DataFrame:
    """Keys held by two or more sources; same_digest: whether all their digests agree."""
    aggs = [F.countDistinct(source).alias("n_sources"), F.count(F.lit(1)).alias("n")]
    if digest:
        aggs.append((F.countDistinct(digest) == 1).alias("same_digest"))
    return entries.where(F.col(key).isNotNull()).groupBy(key).agg(*aggs).where("n_sources > 1")


def within_duplicates(entries: DataFrame, shard: str, key: str) -> DataFrame:
    return entries.groupBy(shard, key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def reconcile(plan: DataFrame, disk: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, status): verified, digest_mismatch, not_seen (planned only), not_planned (on disk only)."""
    a, b = plan.select(F.col(key).alias("__a"), F.col(digest).alias("__da")), disk.select(F.col(key).alias("__b"), F.col(digest).alias("__db"))
    j = a.join(b, F.col("__a") == F.col("__b"), "full_outer")
    status = F.when(F.col("__b").isNull(), "not_seen").when(F.col("__a").isNull(), "not_planned").when(F.col("__da").eqNullSafe(F.col("__db")), "verified").otherwise("digest_mismatch")
    return j.select(F.coalesce("__a", "__b").alias(key), status.alias("status"))


def pending(rows: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """rows whose key isn't done yet; a null in a key equals a null."""
    d = done.select(*[F.col(k).alias(f"__{k}") for k in key]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]
    return rows.join(d, same, "left_anti")


def score_resumable(rows: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, key: list[str]) -> DataFrame:
    """Scores what path doesn't hold yet, adds it there in one commit, and returns all that is there; to be called again after a failure."""
    spark = rows.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p.suffix("/_SUCCESS"))
    todo = pending(rows, spark.read.parquet(path), key) if there else rows
    score(todo).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def even_pick(df: DataFrame, by: str, order: str, k: int) -> DataFrame:
    """About k evenly spaced rows of each group, first included."""
    w = Window.partitionBy(by)
    r = df.withColumn("__r", F.row_number().over(w.orderBy(order)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    step = F.greatest(F.floor(F.col("__n") / k), F.lit(1))
    return r.where((F.col("__r") % step == 0) & (F.col("__r") / step < k)).drop("__r", "__n")


def census(entries: DataFrame, by: str, seed: str) -> DataFrame:
    return entries.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min(seed).alias("seed_min"), F.max(seed).alias("seed_max"), F.countDistinct(seed).alias("n_seeds"))


def counts_with_total(df: DataFrame, by: str) -> DataFrame:
    return df.rollup(by).agg(F.count(F.lit(1)).alias("n")).select(F.coalesce(F.col(by).cast("string"), F.lit("_total")).alias(by), "n")


def score_status(df: DataFrame, signals: list[str], error: str | None = None) -> DataFrame:
    """df with status: error, complete (every signal finite) or incomplete; incomplete rows are never a scored set."""
    usable = sum((F.when(F.col(s).isNotNull() & ~F.isnan(F.col(s).cast("double")), 1).otherwise(0) for s in signals), F.lit(0))
    failed = F.col(error).isNotNull() if error else F.lit(False)
    return df.withColumn("status", F.when(failed, "error").when(usable == len(signals), "complete").otherwise("incomplete"))


def verdict(problems: DataFrame, stop: list[str], warn: list[str]) -> DataFrame:
    """(verdict, code): STOP 3 if a stopping rule is broken, WARN 2 if a warning one is, PASS 0 otherwise."""
    g = problems.agg(F.count_if(F.col("rule").isin(*stop)).alias("n_stop"), F.count_if(F.col("rule").isin(*warn)).alias("n_warn"))
    return g.withColumn("verdict", F.when(F.col("n_stop") > 0, "STOP").when(F.col("n_warn") > 0, "WARN").otherwise("PASS")).withColumn("code", F.when(F.col("n_stop") > 0, 3).when(F.col("n_warn") > 0, 2).otherwise(0))


def split_overlaps(df: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that stand in more than one named split."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


def eligible(detectors: DataFrame, access: list[str], wanted: list[str]) -> DataFrame:
    """df of (name, needs array, covers array, cost) with the first reason that rules a detector out, null if none."""
    a, w = F.array(*[F.lit(x) for x in access]), F.array(*[F.lit(x) for x in wanted])
    reason = F.when(F.size(F.array_except("needs", a)) > 0, "ACCESS").when(~F.arrays_overlap("covers", w), "NO_CLASS").when(F.col("cost") < 0, "COST")
    return detectors.withColumn("reason", reason)
