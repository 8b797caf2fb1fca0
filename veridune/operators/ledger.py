"""Score ledgers: records (model_id, corpus, kind, is_positive, split, signal, score) in long form, their contract and rates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from . import ranks

RECORD = "model_id string, corpus string, kind string, is_positive boolean, split string, scores map<string,double>"


def half(key: str, seed: str = "") -> Column:
    """0 or 1 from the key's md5: a split that needs no shuffle and agrees wherever it is computed."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long") % 2).cast("int")


def stratified_half(df: DataFrame, key: str, stratum: str, seed: str = "") -> DataFrame:
    """df with split: even ranks (in md5 order within the stratum) calibrate."""
    x = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), 1, 12), 16, 10).cast("double")
    out = ranks.running(df.withColumn("order_", x), "order_", {"rank_": F.lit(1).cast("long")}, (stratum,))
    return out.withColumn("split", F.when((F.col("rank_") - 1) % 2 == 0, F.lit("calibration")).otherwise(F.lit("evaluation"))).drop("order_", "rank_", "__all_rank_")


def long_form(records: DataFrame) -> DataFrame:
    return records.select("model_id", "corpus", "kind", "is_positive", "split", F.explode("scores").alias("signal", "score"))


def problems(records: DataFrame, positive_kinds: list[str], negative_kinds: list[str]) -> DataFrame:
    """(rule, key, detail) rows; none means the ledger is valid."""
    key = F.concat_ws("/", F.coalesce("corpus", F.lit("")), F.coalesce("model_id", F.lit("")))
    declared = F.when(F.col("kind").isin(*positive_kinds), F.lit(True)).when(F.col("kind").isin(*negative_kinds), F.lit(False))
    bad = F.exists(F.map_values("scores"), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rules = [
        ("missing_id", F.coalesce(F.trim("model_id"), F.lit("")) == "", F.lit("")),
        ("missing_corpus", F.coalesce(F.trim("corpus"), F.lit("")) == "", F.lit("")),
        ("undeclared_kind", F.col("kind").isNull() | declared.isNull(), F.col("kind")),
        ("polarity_mismatch", declared.isNotNull() & (F.col("is_positive").isNull() | (declared != F.col("is_positive"))), F.col("kind")),
        ("unknown_split", ~F.coalesce(F.col("split").isin("calibration", "evaluation", "unassigned"), F.lit(False)), F.col("split")),
        ("no_scores", F.col("scores").isNull() | (F.size("scores") == 0), F.lit("")),
        ("non_finite_score", F.coalesce(bad, F.lit(False)), F.lit("")),
    ]
    per_row = records.select(key.alias("key"), F.inline(F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("rule"), F.coalesce(x, F.lit("")).alias("detail"))) for n, c, x in rules])))).select("rule", "key", "detail")
    twice = records.groupBy("corpus", "model_id").count().where("count > 1").select(F.lit("duplicate_key").alias("rule"), key.alias("key"), F.col("count").cast("string").alias("detail"))
    n = records.agg(F.count(F.lit(1)).alias("__n"))
    covered = records.select(F.explode(F.map_keys("scores")).alias("signal")).groupBy("signal").count().join(F.broadcast(n))  # one row
    partial = covered.where("count < __n").select(F.lit("partial_signal").alias("rule"), F.col("signal").alias("key"), F.concat_ws("/", F.col("count").cast("string"), F.col("__n").cast("string")).alias("detail"))
    both = sorted(set(positive_kinds) & set(negative_kinds))
    clash = records.sparkSession.createDataFrame([("kind_both_ways", k, "") for k in both], "rule string, key string, detail string")
    return reduce(DataFrame.unionByName, [per_row, twice, partial, clash])


def merge(base: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("corpus", "model_id")) -> DataFrame:
    """base and those rows of new whose key it lacks: the first answer wins."""
    return base.unionByName(new.join(base.select(*keys), list(keys), "left_anti"))


def fired(score: Column, threshold: Column, higher: bool = True) -> Column:
    return score > threshold if higher else score < threshold


def fpr_rule(ledger: DataFrame, alpha: float = 0.05, min_n: int = 20, higher: bool = True) -> DataFrame:
    """Per signal: threshold from calibration negatives, held-out false-alarm and detection counts with Wilson intervals.

    ledger: signal, score, is_positive, split ('calibration' or 'evaluation').  degenerate: the threshold is the ceiling of
    the calibration negatives.
    """
    cal = ledger.where("split = 'calibration' and not is_positive")
    cut = ranks.quantiles(cal, "score", {"threshold": 1 - alpha if higher else alpha}, ("signal",)).drop("n")
    thr = cut.join(cal.groupBy("signal").agg((F.max if higher else F.min)("score").alias("extreme"), F.count(F.lit(1)).alias("n_calibration")), "signal")
    ev = ledger.where("split = 'evaluation'").join(F.broadcast(thr), "signal")  # one row a signal
    f = fired(F.col("score"), F.col("threshold"), higher)
    g = ev.groupBy("signal", "threshold", "extreme", "n_calibration").agg(
        F.count_if(~F.col("is_positive")).alias("n_neg"), F.count_if(f & ~F.col("is_positive")).alias("false_alarms"), F.count_if(F.col("is_positive")).alias("n_pos"), F.count_if(f & F.col("is_positive")).alias("hits")
    )
    g = g.withColumn("degenerate", F.abs(F.col("threshold") - F.col("extreme")) <= 1e-9)
    return g.withColumn("fpr", stats.rate(F.col("false_alarms"), F.col("n_neg"), min_n)).withColumn("tpr", stats.rate(F.col("hits"), F.col("n_pos"), min_n)).drop("extreme")


def rate_cells(df: DataFrame, by: list[str], hit: Column, min_n: int = 20) -> DataFrame:
    """n, hits and rate of each cell; cells are never pooled."""
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"))
    return g.withColumn("rate", stats.rate(F.col("hits"), F.col("n"), min_n))


def flag_overlap(flags: DataFrame, key: str = "key", rule: str = "rule") -> DataFrame:
    """(rule_a, rule_b, both, either, jaccard) of (key, rule) rows of fired rules."""
    pair = flags.groupBy(key).agg(F.array_sort(F.collect_set(rule)).alias("r"))
    both = pair.select(F.explode("r").alias("rule_a"), "r").select("rule_a", F.explode("r").alias("rule_b")).where("rule_a < rule_b").groupBy("rule_a", "rule_b").agg(F.count(F.lit(1)).alias("both"))
    n = pair.select(F.explode("r").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    out = both.join(n.select(F.col("rule").alias("rule_a"), F.col("n").alias("na")), "rule_a").join(n.select(F.col("rule").alias("rule_b"), F.col("n").alias("nb")), "rule_b")
    return out.select("rule_a", "rule_b", "both", (F.col("na") + F.col("nb") - F.col("both")).alias("either")).withColumn("jaccard", F.col("both") / F.col("either"))


def kind_family(cells: DataFrame, alpha: float = 0.05, least: int = 3) -> DataFrame:
    """cells (signal, kind, n, hits): each against its signal's own recall by an exact test, adjusted over the family."""
    total = cells.groupBy("signal").agg(F.sum("hits").alias("__h"), F.sum("n").alias("__n"))
    t = cells.where(F.col("n") >= least).join(total, "signal").withColumn("baseline", F.col("__h") / F.col("__n")).where("baseline > 0 and baseline < 1")
    t = t.withColumn("p", stats.binomial_p("hits", "n", "baseline")).drop("__h", "__n")
    return ranks.adjusted(t, "p", alpha)


def fuse(pvalues: DataFrame, key: list[str], p: str = "p") -> DataFrame:
    """(key, bonferroni, cauchy, by_global) of each key's p-values over signals; one that could not be had counts as 1."""
    g = pvalues.groupBy(*key).agg(F.array_sort(F.collect_list(stats.finite_or_one(F.col(p)))).alias("ps"))
    return g.select(*key, stats.bonferroni(F.col("ps")).alias("bonferroni"), stats.cauchy(F.col("ps")).alias("cauchy"), stats.by_global(F.col("ps")).alias("by_global"))


def grouped_by(pvalues: DataFrame, key: list[str], group: str, p: str = "p") -> DataFrame:
    """BY within each group of signals, then BY across the groups."""
    inner = pvalues.groupBy(*key, group).agg(stats.by_global(F.collect_list(stats.finite_or_one(F.col(p)))).alias("pg"))
    return inner.groupBy(*key).agg(stats.by_global(F.collect_list("pg")).alias("p_grouped"))


def fuse_ledger(ledger: DataFrame, higher: bool = True) -> DataFrame:
    """ledger and new signals fused_* (1 - p), p-values against each signal's calibration negatives."""
    cal = ledger.withColumn("is_cal", (F.col("split") == "calibration") & ~F.col("is_positive"))
    p = ranks.conformal_pvalues(cal, "score", "is_cal", ("signal",), higher)
    key = ["model_id", "corpus", "kind", "is_positive", "split"]
    f = fuse(p, key)
    rows = f.select(*key, F.explode(F.map_from_arrays(F.array(*[F.lit(f"fused_{m}") for m in ("bonferroni", "cauchy", "by_global")]), F.array(*[1 - F.col(m) for m in ("bonferroni", "cauchy", "by_global")]))).alias("signal", "score"))
    return ledger.select(*key, "signal", "score").unionByName(rows)


def cochran_q(groups: DataFrame, k: str = "k", n: str = "n") -> DataFrame:
    """(q, df, p, status) of equal rates over groups; pooled 0 or 1 is homogeneous, under two groups not measurable."""
    live = groups.where(F.col(n) > 0)
    pool = live.agg((F.sum(k) / F.sum(n)).alias("rate"), F.count(F.lit(1)).alias("groups"))
    q = live.join(F.broadcast(pool)).groupBy("rate", "groups").agg(F.sum((F.col(k) - F.col(n) * F.col("rate")) ** 2 / (F.col(n) * F.col("rate") * (1 - F.col("rate")))).alias("q"))  # pool: one row
    flat = (F.col("rate") <= 0) | (F.col("rate") >= 1)
    out = q.select("rate", (F.col("groups") - 1).cast("int").alias("df"), F.when(flat, 0.0).otherwise(F.col("q")).alias("q"), F.when(F.col("groups") < 2, "not_measurable").when(flat, "homogeneous").otherwise("measured").alias("status"))
    return out.withColumn("p", F.when(F.col("status") == "measured", stats.chi2_p("q", "df")).when(F.col("status") == "homogeneous", 1.0))
