"""Decisions under stated losses: posteriors, policies, review queues, residual risk."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from . import ranks


def losses(q: Column, miss: float = 25.0, discard: float = 5.0, review: float = 1.0) -> dict[str, Column]:
    """Expected loss of accepting, quarantining and reviewing an item that is bad with probability q."""
    return {"accept": q * miss, "quarantine": (1 - q) * discard, "review": F.lit(review)}


def disposition(q: Column, **costs: float) -> Column:
    """The cheapest; ties go to review."""
    e = losses(q, **costs)
    best = F.least(*e.values())
    return F.when(e["review"] <= best, "REVIEW").when(e["quarantine"] <= best, "QUARANTINE").otherwise("ACCEPT")


def policy_loss(rates: DataFrame, prevalence: float, miss: float = 25.0, discard: float = 5.0) -> DataFrame:
    """rates (tpr, fpr): ppv, share of bad among the unflagged, expected loss of flag-and-quarantine, break-even prevalence."""
    p = F.lit(prevalence)
    loss = (1 - F.col("tpr")) * p * miss + F.col("fpr") * (1 - p) * discard
    even = F.col("fpr") * discard / (F.col("tpr") * miss + F.col("fpr") * discard)
    return rates.withColumn("ppv", stats.ppv(F.col("tpr"), F.col("fpr"), p)).withColumn("missed", stats.missed(F.col("tpr"), F.col("fpr"), p)).withColumn("loss", loss).withColumn("break_even", even)


def item_posteriors(df: DataFrame, p: str = "p", bins: int = 20, lam: float = 0.5) -> DataFrame:
    """df with q = 1 - clip(pi0 / f): histogram local false discovery rate, pi0 after Storey, no jitter."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    n = df.agg(F.count(p).alias("__n"), F.count_if(F.col(p) > lam).alias("__hi"))
    c = df.groupBy(b.alias("__bin")).agg(F.count(F.lit(1)).alias("__c"))
    out = df.withColumn("__bin", b).join(F.broadcast(c), "__bin").join(F.broadcast(n))  # bins rows; one row
    pi0 = F.least(F.lit(1.0), F.col("__hi") / (F.col("__n") * (1 - lam)))
    dens = F.col("__c") / F.col("__n") * bins
    return out.withColumn("q", 1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), pi0 / dens))).drop("__bin", "__c", "__n", "__hi")


def review_queue(df: DataFrame, key: str, q: str = "q", **costs: float) -> DataFrame:
    """df with review_value (loss saved by looking), disposition and rank from 0 (greatest value first, ties by key)."""
    e = losses(F.col(q), **costs)
    value = F.least(e["accept"], e["quarantine"]) - e["review"]
    out = df.withColumn("review_value", value).withColumn("disposition", disposition(F.col(q), **costs))
    c = ranks.running(out, "review_value", {"above": F.lit(1).cast("long")}, descending=True)
    tie = Window.partitionBy("review_value").orderBy(key)
    size = Window.partitionBy("review_value")
    return c.withColumn("rank", F.col("above") - F.count(F.lit(1)).over(size) + F.row_number().over(tie) - 1).drop("above", "__all_above")


def catch_curve(queue: DataFrame, bad: str, points: list[int]) -> DataFrame:
    """(budget, caught) for stated budgets: bad items among the first ranks."""
    b = F.array(*[F.lit(x).cast("long") for x in points])
    return queue.select(F.col(bad).cast("long").alias("y"), "rank", F.explode(b).alias("budget")).groupBy("budget").agg(F.sum(F.when(F.col("rank") < F.col("budget"), F.col("y")).otherwise(0)).alias("caught"))


def budget_for_fraction(queue: DataFrame, bad: str, fraction: float = 0.9) -> DataFrame:
    """(n_bad, budget): the fewest first ranks that hold ``fraction`` of all bad items; null where there is none."""
    c = ranks.running(queue.select("rank", F.col(bad).cast("long").alias("__y")), "rank", {"__caught": F.col("__y")})
    return c.agg(F.coalesce(F.max("__all___caught"), F.lit(0)).alias("n_bad"), F.min(F.when((F.col("__all___caught") > 0) & (F.col("__caught") >= fraction * F.col("__all___caught")), F.col("rank") + 1)).alias("budget"))


def flag_all(df: DataFrame, flagged: Column, bad: Column) -> DataFrame:
    """The one point of looking at every flagged item: (budget, caught, n_bad, caught_share)."""
    g = df.agg(F.count_if(flagged).alias("budget"), F.count_if(flagged & bad).alias("caught"), F.count_if(bad).alias("n_bad"))
    return g.withColumn("caught_share", F.when(F.col("n_bad") > 0, F.col("caught") / F.col("n_bad")))


def invert_power(curve: DataFrame, rate: str = "rate", power: str = "power", target: float = 0.8) -> DataFrame:
    return curve.agg(F.min(F.when(F.col(power) >= target, F.col(rate))).alias("r_star"))


def residual_risk(modules: DataFrame, n: int, flagged: int, most: float = 0.02) -> DataFrame:
    """modules (module, r_star): the worst floor, unbounded if any has none; prevalence bound; whether acceptance is allowed."""
    ub = stats.clopper_pearson_upper(flagged, n)
    g = modules.agg(F.count_if(F.col("r_star").isNull()).alias("unbounded"), F.max("r_star").alias("worst"))
    return g.select(F.when(F.col("unbounded") == 0, F.col("worst")).alias("r_star"), (F.col("unbounded") > 0).alias("unbounded"), F.lit(ub).alias("prevalence_upper"), ((F.col("unbounded") == 0) & (F.col("worst") <= most)).alias("accept_permitted"))


def asset_rule(df: DataFrame, asset: str, signal: str, score: str, is_clean: str, alpha: float = 0.05) -> DataFrame:
    """Per asset: Bonferroni p over signals against clean assets; abstains where clean assets are too few to reject."""
    p = ranks.conformal_pvalues(df, score, is_clean, (signal,))
    g = p.groupBy(asset).agg(F.count(F.lit(1)).alias("m"), F.min("p").alias("least"), F.min("n_cal").alias("n_cal"))
    need = F.ceil(F.col("m") / alpha) - 1
    fused = F.least(F.lit(1.0), F.col("m") * F.col("least"))
    return g.select(asset, "m", "n_cal", fused.alias("p"), F.when(F.col("n_cal") < need, "ABSTAIN").when(fused <= alpha, "FLAG").otherwise("CLEAR").alias("decision"))


def mcnemar_arms(discordant: float, win: float, alpha: float = 0.05, power: float = 0.8) -> int:
    """Paired arms needed for an exact sign test to show ``win`` among a share ``discordant`` of discordant pairs."""
    n = 5
    while n < 5000:
        if stats.exact_power(n, 0.5, win, alpha) >= power:
            return math.ceil(n / discordant)
        n += 1
    raise ValueError("no number of arms under 5,000 discordant pairs has that power")


def contributor_posterior(df: DataFrame, contributor: str, flag: Column, tau: float = 0.05, prior: tuple[float, float] = (2.0, 20.0), grid: int = 200) -> DataFrame:
    """P(contributor's rate > tau) under a Beta prior, by quadrature on a fixed grid in place of draws."""
    a0, b0 = prior
    g = df.groupBy(contributor).agg(F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("k"))
    x = F.sequence(F.lit(0), F.lit(grid - 1))
    at = lambda i: (i + 0.5) / grid
    logd = lambda i: (F.col("k") + a0 - 1) * F.log(at(i)) + (F.col("n") - F.col("k") + b0 - 1) * F.log(1 - at(i))
    g = g.withColumn("ld", F.transform(x, lambda i: F.struct(at(i).alias("x"), logd(i).alias("l")))).withColumn("top", F.array_max(F.transform("ld", lambda s: s["l"])))
    total = lambda keep: F.aggregate("ld", F.lit(0.0), lambda a, s: a + F.when(keep(s), F.exp(s["l"] - F.col("top"))).otherwise(0.0))
    return g.select(contributor, "n", "k", (total(lambda s: s["x"] > tau) / total(lambda s: F.lit(True))).alias("posterior"))
