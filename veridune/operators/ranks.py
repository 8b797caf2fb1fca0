"""Calibrated ranks, multiple testing and ranking metrics, without a global one-task sort.

Running sums over an order are taken over distinct values, so that a value held by many rows is one row, in value buckets:
totals of the buckets before are added to a window inside the bucket.  A bucket is a power of two's range cut into ``CELLS``
equal parts, so it follows from the value alone: no pass over the data finds borders and no action runs before the query's own.
Values that agree in their first 16 binary digits share a bucket (and a task, which sorts and may spill).
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats

CELLS = 1 << 16


def bucket(x: str) -> Column:
    """The bucket of x: never less for a greater value; nulls come first, NaN last."""
    v = F.col(x).cast("double")
    a = F.abs(v)
    e = F.floor(F.log2(a))
    cell = e * CELLS + F.floor((a / F.pow(F.lit(2.0), e) - 1) * CELLS) + 1100 * CELLS
    side = F.signum(v).cast("long")
    return F.when(v.isNull(), F.lit(-(1 << 61))).when(F.isnan(v), F.lit(1 << 61)).when(v == 0, F.lit(0)).when(a == float("inf"), side * (1 << 60)).otherwise(side * cell)


def same(a: DataFrame, b: DataFrame, keys: dict[str, str]) -> Column:
    """Null-safe equality of a's columns and b's, by name."""
    return functools.reduce(lambda p, q: p & q, [a[k].eqNullSafe(b[v]) for k, v in keys.items()])


def ordered(t: DataFrame, x: str, sums: tuple[str, ...], by: tuple[str, ...] = (), descending: bool = False) -> DataFrame:
    """t, one row a (by, x), with __b, with each of sums summed over all rows that x does not put after this one, and __all_ its total."""
    b = t.withColumn("__b", bucket(x))
    side = F.col("__b").desc() if descending else F.col("__b")
    w = Window.partitionBy(*by).orderBy(side).rowsBetween(Window.unboundedPreceding, -1)
    before = b.groupBy(*by, "__b").agg(*[F.sum(n).alias(f"__t{n}") for n in sums])
    names = {k: f"__k{i}" for i, k in enumerate((*by, "__b"))}
    before = before.select(*[F.col(k).alias(v) for k, v in names.items()], *[F.coalesce(F.sum(f"__t{n}").over(w), F.lit(0)).alias(f"__o{n}") for n in sums], *[F.sum(f"__t{n}").over(Window.partitionBy(*by)).alias(f"__all_{n}") for n in sums])
    inside = Window.partitionBy(*by, "__b").orderBy(F.col(x).desc() if descending else F.col(x)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = b.withColumns({n: F.sum(n).over(inside) for n in sums})
    out = b.join(before, same(b, before, names))
    return out.withColumns({n: F.col(n) + F.col(f"__o{n}") for n in sums}).drop(*names.values(), *[f"__o{n}" for n in sums])


HEAVY = 1 << 17  # rows that make a value heavy


def running(df: DataFrame, x: str, sums: dict[str, Column], by: tuple[str, ...] = (), descending: bool = False) -> DataFrame:
    """df with, for each name in sums, the sum of its column over all rows that x does not put after this one (ties are in), and __all_ that name its total.

    Sums of heavy values, one in ``HEAVY`` rows at most, are broadcast: their rows are neither sent to one task nor sorted.
    """
    c = ordered(df.groupBy(*by, x).agg(*[F.sum(c).alias(n) for n, c in sums.items()], F.count(F.lit(1)).alias("__n")), x, tuple(sums), by, descending)
    names = {k: f"__v{i}" for i, k in enumerate((*by, x))}
    c = c.select(*[F.col(k).alias(v) for k, v in names.items()], *sums, *[f"__all_{n}" for n in sums], "__n")
    heavy, light = F.broadcast(c.where(F.col("__n") >= HEAVY).drop("__n")), c.where(F.col("__n") < HEAVY).drop("__n")
    rest = df.join(heavy, same(df, heavy, names), "left_anti")
    return df.join(heavy, same(df, heavy, names)).unionByName(rest.join(light, same(rest, light, names))).drop(*names.values())


def quantiles(df: DataFrame, x: str, q: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n, one column a name in q): exact quantiles, interpolated between the two order statistics; nulls and NaN take no part."""
    t = df.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))).groupBy(*by, x).agg(F.count(F.lit(1)).alias("__c"))
    c = ordered(t, x, ("__c",), by).withColumnRenamed("__all___c", "n")
    at = {k: (F.col("n") - 1) * v for k, v in q.items()}
    v = F.col(x).cast("double")
    g = c.groupBy(*by, "n").agg(*[F.min(F.when(F.col("__c") > f(h), v)).alias(f"__{side}{k}") for k, h in at.items() for side, f in (("lo", F.floor), ("hi", F.ceil))])
    return g.select(*by, "n", *[(F.col(f"__lo{k}") + (h - F.floor(h)) * (F.col(f"__hi{k}") - F.col(f"__lo{k}"))).alias(k) for k, h in at.items()])


def conformal_pvalues(df: DataFrame, score: str = "score", is_cal: str = "is_cal", by: tuple[str, ...] = (), higher: bool = True) -> DataFrame:
    """df with p = (1 + calibration rows at least as extreme) / (1 + calibration rows), within ``by``; null without calibration."""
    out = running(df, score, {"n_extreme": F.col(is_cal).cast("long")}, by, descending=higher).withColumnRenamed("__all_n_extreme", "n_cal")
    return out.withColumn("p", F.when(F.col("n_cal") > 0, (1.0 + F.col("n_extreme")) / (1.0 + F.col("n_cal"))))


def conditional_pvalues(df: DataFrame, by: tuple[str, ...], score: str = "score", is_cal: str = "is_cal", least: int = 19, higher: bool = True) -> DataFrame:
    """Conformal p-values against the row's own cell alone; cells with fewer calibration rows than ``least`` refuse (null p)."""
    out = conformal_pvalues(df, score, is_cal, by, higher)
    ok = F.col("n_cal") >= least
    return out.withColumn("status", F.when(ok, "ok").otherwise("refused")).withColumn("p", F.when(ok, F.col("p")))


def mixed_batch(df: DataFrame, p: str, positive: str, alpha: float = 0.05) -> DataFrame:
    """False discoveries and power of step-up flags in a mixed batch, and whether its smallest p could pass the strictest cut."""
    a = adjusted(df, p, alpha)
    g = a.agg(F.count(F.lit(1)).alias("n"), F.count_if("bh").alias("flagged"), F.count_if(F.col("bh") & F.col(positive)).alias("caught"), F.count_if(positive).alias("n_positive"), F.min(p).alias("min_p"))
    h = stats.harmonic(F.col("n"))
    share = lambda k, n: F.when(n > 0, k / n)
    return g.select("n", "flagged", share(F.col("flagged") - F.col("caught"), F.col("flagged")).alias("fdr"), share(F.col("caught"), F.col("n_positive")).alias("power"), "min_p", (F.lit(alpha) / (F.col("n") * h)).alias("strictest"), (F.col("min_p") <= F.lit(alpha) / (F.col("n") * h)).alias("can_flag"))


def conformal_threshold(df: DataFrame, score: str, alpha: float = 0.05, by: tuple[str, ...] = ()) -> DataFrame:
    """The ceil((n + 1)(1 - alpha))-th smallest score, at most the n-th, within ``by``."""
    t = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count(F.lit(1)).alias("c"))
    c = ordered(t, score, ("c",), by).withColumnRenamed("__all_c", "n")
    c = c.withColumn("k", F.least(F.greatest(F.ceil((F.col("n") + 1) * (1.0 - alpha)), F.lit(1)), F.col("n")))
    return c.where("c >= k").groupBy(*by, "n", "k").agg(F.min(score).alias("threshold"))


def _steps(live: DataFrame, p: str) -> DataFrame:
    """(__v, rank, q, __all_rank): each distinct p-value with its step-up adjusted one."""
    t = live.groupBy(p).agg(F.count(F.lit(1)).alias("rank"))
    c = ordered(t, p, ("rank",)).withColumn("__r", F.col(p) * F.col("__all_rank") / F.col("rank"))
    later = c.groupBy("__b").agg(F.min("__r").alias("__m"))
    later = later.select("__b", F.min("__m").over(Window.orderBy(F.col("__b").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("__later"))  # one row a bucket that isn't empty
    inside = Window.partitionBy("__b").orderBy(F.col(p).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = c.withColumn("__i", F.min("__r").over(inside)).join(later, "__b")
    return c.select(F.col(p).alias("__v"), "rank", F.least(F.lit(1.0), "__i", F.coalesce("__later", F.lit(float("inf")))).alias("q"), "__all_rank")


def adjusted(df: DataFrame, p: str = "p", alpha: float = 0.05) -> DataFrame:
    """df with bh, by (flags at alpha) and q (step-up adjusted p-values); rows without p go."""
    live = df.where(F.col(p).isNotNull())
    c = _steps(live, p)
    out = live.join(c, live[p].eqNullSafe(c["__v"]))
    return out.withColumn("bh", F.col("q") <= alpha).withColumn("by", F.col("q") * stats.harmonic(F.col("__all_rank")) <= alpha).drop("__v", "__all_rank")


def dependent_cut(df: DataFrame, p: str = "p", alpha: float = 0.05) -> DataFrame:
    """(cut), one row: the greatest p-value that ``adjusted`` flags in ``by``, which are all that lie at or below it; null if it flags none."""
    c = _steps(df.where(F.col(p).isNotNull()), p)
    return c.where(F.col("q") * stats.harmonic(F.col("__all_rank")) <= alpha).agg(F.max("__v").alias("cut"))


def auroc(df: DataFrame, score: str = "score", positive: str = "is_positive", by: tuple[str, ...] = ()) -> DataFrame:
    """Area under the ROC curve by average ranks; null if a class is empty."""
    y = F.col(positive).cast("long")
    t = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.sum(y).alias("pos"), F.count(F.lit(1)).alias("all_"))
    c = ordered(t.withColumn("c", F.col("all_")), score, ("c",), by)
    g = c.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum(F.col("all_") - F.col("pos")).alias("n_neg"), F.sum(F.col("pos") * (F.col("c") - F.col("all_") / 2.0 + 0.5)).alias("s"))
    return g.withColumn("auroc", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), (F.col("s") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0) / (F.col("n_pos").cast("double") * F.col("n_neg")))).drop("s")


def roc_curve(df: DataFrame, score: str = "score", positive: str = "is_positive") -> DataFrame:
    """(score, tpr, fpr) after each distinct score, from high to low; equal scores are one step."""
    y = F.col(positive).cast("long")
    t = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    c = ordered(t.select(score, F.col("pos").alias("tp"), F.col("neg").alias("fp")), score, ("tp", "fp"), descending=True)
    return c.select(score, (F.col("tp") / F.col("__all_tp")).alias("tpr"), (F.col("fp") / F.col("__all_fp")).alias("fpr"))


def tpr_at_fpr(curve: DataFrame, most: float = 0.05) -> DataFrame:
    return curve.agg(F.coalesce(F.max(F.when(F.col("fpr") <= most + 1e-12, F.col("tpr"))), F.lit(0.0)).alias("tpr"))


def reliability(df: DataFrame, prob: str, positive: str, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy); the last bin holds 1."""
    b = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1))
    return df.groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(prob).alias("confidence"), F.avg(F.col(positive).cast("double")).alias("accuracy"))


def ece(df: DataFrame, prob: str, positive: str, bins: int = 10) -> DataFrame:
    r = reliability(df, prob, positive, bins)
    return r.agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")).alias("ece"))


def f1_at(df: DataFrame, score: str, positive: str, threshold: float) -> DataFrame:
    hit, y = F.col(score) >= threshold, F.col(positive).cast("boolean")
    g = df.agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"))
    return g.withColumn("f1", F.when(F.col("tp") > 0, 2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0))


def two_sample(df: DataFrame, x: str, side: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, ks, wasserstein, n_a, n_b) of the two samples that the boolean ``side`` tells apart, exact."""
    a = F.col(side).cast("long")
    t = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.sum(a).alias("a"), F.sum(1 - a).alias("b"))
    c = ordered(t.withColumns({"ca": F.col("a"), "cb": F.col("b")}), x, ("ca", "cb"), by)
    first = c.groupBy(*by, "__b").agg(F.min(x).alias("__first"))
    nxt = first.select(*by, "__b", F.lead("__first").over(Window.partitionBy(*by).orderBy("__b")).alias("__next"))
    c = c.join(nxt, [*by, "__b"])
    c = c.withColumnsRenamed({"__all_ca": "n_a", "__all_cb": "n_b"})
    ahead = F.coalesce(F.lead(x).over(Window.partitionBy(*by, "__b").orderBy(x)), F.col("__next"))
    c = c.withColumn("gap", F.abs(F.col("ca") / F.col("n_a") - F.col("cb") / F.col("n_b"))).withColumn("step", F.coalesce(ahead - F.col(x), F.lit(0.0)))
    return c.groupBy(*by, "n_a", "n_b").agg(F.max("gap").alias("ks"), F.sum(F.col("gap") * F.col("step")).alias("wasserstein"))
