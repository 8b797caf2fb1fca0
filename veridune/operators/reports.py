"""Whole reports and their checks: verdicts over an asset, populations of shards, plans held against what was found, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from . import ledger, ranks


def guarded_join(rows: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """rows with their registry entry and status: 'ok', or 'refused' where the registry has none (its columns are null)."""
    known = registry.withColumn("__known", F.lit(True))
    return rows.join(known, key, "left").withColumn("status", F.when(F.col("__known"), "ok").otherwise("refused")).drop("__known")


def paired_control(cells: DataFrame) -> DataFrame:
    """cells (cell_id, paired_cell, reference, operational): how far each moved, how far its control moved, and the difference.

    status: 'ok', 'no_control' where the paired cell isn't there (net is null), 'own_control' where a cell names itself.
    """
    moved = cells.withColumn("moved", F.col("operational") - F.col("reference"))
    control = moved.select(F.col("cell_id").alias("paired_cell"), F.col("moved").alias("control_moved"))
    own = F.col("paired_cell") == F.col("cell_id")
    status = F.when(own, "own_control").when(F.col("control_moved").isNull(), "no_control").otherwise("ok")
    out = moved.join(control, "paired_cell", "left").withColumn("status", status)
    return out.withColumn("net", F.when(F.col("status") == "ok", F.col("moved") - F.col("control_moved")))


def review_policies(rows: DataFrame, policy: str, asset: str, flagged: Column, bad: Column) -> DataFrame:
    """Per policy: rows looked at, caught, false positives, missed, and the asset with most false positives (ties: least name)."""
    g = rows.groupBy(policy, asset).agg(F.count_if(flagged).alias("reviewed"), F.count_if(flagged & bad).alias("caught"), F.count_if(flagged & ~bad).alias("false_positives"), F.count_if(~flagged & bad).alias("missed"))
    worst = F.min(F.struct((-F.col("false_positives")).alias("n"), F.col(asset).alias("asset"))).getField("asset")
    return g.groupBy(policy).agg(*[F.sum(c).alias(c) for c in ("reviewed", "caught", "false_positives", "missed")], worst.alias("benchmark_asset"))


def leave_one_out(df: DataFrame, by: str, hit: Column) -> DataFrame:
    """Contributors by rate (greatest first, ties by name) and the rate of all others together."""
    g = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"))
    all_ = g.agg(F.sum("n").alias("__n"), F.sum("hits").alias("__h"))
    g = g.join(F.broadcast(all_)).withColumn("rate", F.col("hits") / F.col("n"))  # one row
    g = g.withColumn("rest_rate", F.when(F.col("__n") > F.col("n"), (F.col("__h") - F.col("hits")) / (F.col("__n") - F.col("n"))))
    r = ranks.running(g, "rate", {"rank": F.lit(1).cast("long")}, descending=True)
    return r.drop("__n", "__h", "__all_rank")


def degeneracy(df: DataFrame, signal: str, score: str, alpha: float = 0.05) -> DataFrame:
    """Per signal: threshold, extreme, rows tied with the extreme, least p-value, and whether the threshold is the ceiling or can't fire."""
    t = ranks.quantiles(df, score, {"threshold": 1 - alpha}, (signal,))
    c = df.where(F.col(score).isNotNull()).groupBy(signal, score).agg(F.count(F.lit(1)).alias("c"))
    top = c.groupBy(signal).agg(F.max(F.struct(score, "c")).alias("m")).select(signal, F.col(f"m.{score}").alias("extreme"), F.col("m.c").alias("ties"))
    out = t.join(top, signal)
    return out.withColumn("p_floor", F.lit(1.0) / (F.col("n") + 1)).withColumn("at_ceiling", F.abs(F.col("threshold") - F.col("extreme")) <= 1e-9).withColumn("can_fire", (F.col("p_floor") <= alpha) & ~F.col("at_ceiling"))


def shard_rates(rows: DataFrame, shard: str, alpha: float = 0.05) -> DataFrame:
    """rows (shard, score, split, is_positive): each shard's false alarms on held-out negatives against its own calibration threshold."""
    neg = rows.where(~F.col("is_positive"))
    cut = ranks.quantiles(neg.where("split = 'calibration'"), "score", {"threshold": 1 - alpha}, (shard,)).drop("n")
    held = neg.where("split = 'evaluation'").join(cut, shard)
    return held.groupBy(shard, "threshold").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") > F.col("threshold")).alias("k"))


def nominal_rates(fused: DataFrame, methods: list[str], positive: str, alpha: float = 0.05, min_n: int = 20) -> DataFrame:
    """Per method: how often its p-value lies below alpha itself (score above 1 - alpha), for negatives and positives."""
    names = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("p")) for m in methods])).alias("x")
    x = fused.select(F.col(positive).cast("boolean").alias("y"), names).select("y", "x.*").withColumn("hit", 1 - F.col("p") > 1 - alpha)
    g = x.groupBy("method").agg(F.count_if(~F.col("y")).alias("n_neg"), F.count_if(F.col("hit") & ~F.col("y")).alias("false_alarms"), F.count_if("y").alias("n_pos"), F.count_if(F.col("hit") & F.col("y")).alias("hits"))
    return g.withColumn("fpr", stats.rate(F.col("false_alarms"), F.col("n_neg"), min_n)).withColumn("tpr", stats.rate(F.col("hits"), F.col("n_pos"), min_n))


def raw_and_grouped(pvalues: DataFrame, key: list[str], group: str, alpha: float = 0.05) -> DataFrame:
    """Alarms by the Bonferroni of all signals and by grouped step-up: both, either alone, neither."""
    both = ledger.fuse(pvalues, key).join(ledger.grouped_by(pvalues, key, group), key)
    raw, grouped = F.col("bonferroni") <= alpha, F.col("p_grouped") <= alpha
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(raw & grouped).alias("both"), F.count_if(raw & ~grouped).alias("raw_only"), F.count_if(~raw & grouped).alias("grouped_only"), F.count_if(~raw & ~grouped).alias("neither"))


def asset_verdict(pvalues: DataFrame, asset: str, item: list[str], alpha: float = 0.05) -> DataFrame:
    """pvalues (asset, item, signal, p): Bonferroni an item, step-up under dependence within the whole batch, Bonferroni an asset, and a name.

    verdict: 'compromised' where an item is flagged, 'suspect' where only the asset's own p-value lies at or below alpha, else
    'clean'.  leading: the signal with the least p-value among flagged items (ties: least name), or null.
    """
    rows = pvalues.select(asset, *item, "signal", stats.finite_or_one(F.col("p")).alias("__p"))
    one = rows.groupBy(asset, *item).agg(F.min("__p").alias("__least"), F.count(F.lit(1)).alias("__k"))  # fixed-width sums: hashed, not sorted
    one = one.select(asset, *item, F.least(F.lit(1.0), F.col("__least") * F.col("__k")).alias("p"))
    cut = F.broadcast(ranks.dependent_cut(one, "p", alpha))  # one row
    seen = one.join(cut).withColumn("by", F.coalesce(F.col("p") <= F.col("cut"), F.lit(False)))
    g = seen.groupBy(asset).agg(F.count(F.lit(1)).alias("n_items"), F.count_if("by").alias("n_flagged"), F.least(F.lit(1.0), F.min("p") * F.count(F.lit(1))).alias("asset_p"))
    low = rows.join(cut).where("__p <= cut").drop("cut")  # a flagged item's least p-value is no greater than its own
    names = {k: f"__f{i}" for i, k in enumerate((asset, *item))}
    hit = seen.where("by").select(*[F.col(k).alias(v) for k, v in names.items()])
    lead = low.join(hit, ranks.same(low, hit, names), "left_semi").groupBy(F.col(asset).alias("__a")).agg(F.min(F.struct("__p", "signal")).getField("signal").alias("leading"))
    g = g.join(lead, g[asset].eqNullSafe(lead["__a"]), "left").drop("__a")
    return g.withColumn("verdict", F.when(F.col("n_flagged") > 0, "compromised").when(F.col("asset_p") <= alpha, "suspect").otherwise("clean"))


def digest_baseline(seen: DataFrame, asset: str, order: str, digest: str) -> DataFrame:
    """seen with verdict: an asset's first sight abstains (it enrols), later ones pass with the enrolled digest and fail otherwise."""
    enrolled = seen.groupBy(asset).agg(F.min(F.struct(F.col(order).alias("o"), F.col(digest).alias("d"))).alias("__e"))
    verdict = F.when(F.col(order) == F.col("__e.o"), "abstain").when(F.col(digest) == F.col("__e.d"), "pass").otherwise("fail")
    return seen.join(enrolled, asset).withColumn("verdict", verdict).drop("__e")


def audit_sample(df: DataFrame, key: str, n: int, seed: str = "") -> DataFrame:
    """The n rows whose seeded md5 is least."""
    return df.withColumn("__h", F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))).orderBy("__h", key).limit(n).drop("__h")


def registry_problems(registry: DataFrame, disk: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, rule): entries listed twice, missing on disk, found but not listed, or with another digest."""
    g = registry.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.min(digest).alias("__r"))
    both = g.join(disk.groupBy(key).agg(F.min(digest).alias("__d"), F.lit(True).alias("__on")), key, "full")
    rules = F.array_compact(
        F.array(
            F.when(F.col("__n") > 1, F.lit("duplicate_entry")),
            F.when(F.col("__on").isNull(), F.lit("missing_on_disk")),
            F.when(F.col("__n").isNull(), F.lit("not_registered")),
            F.when(F.col("__n").isNotNull() & F.col("__on").isNotNull() & ~F.col("__r").eqNullSafe(F.col("__d")), F.lit("digest_mismatch")),
        )
    )
    return both.select(key, F.explode(rules).alias("rule"))


def drift_cell_problems(cells: DataFrame, roles: list[str]) -> DataFrame:
    """(cell_id, rule) of drift cells (cell_id, role, n_images, paired_cell): unknown roles, no images, repeated ids, a shifted cell without its control."""
    ids = cells.groupBy("cell_id").agg(F.count(F.lit(1)).alias("__n"))
    control = cells.where("role = 'no_shift_control'").select(F.col("cell_id").alias("paired_cell")).distinct().withColumn("__c", F.lit(True))
    c = cells.join(ids, "cell_id").join(control, "paired_cell", "left")
    rules = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("role").isin(roles), F.lit(False)), F.lit("unknown_role")),
            F.when(F.coalesce(F.col("n_images"), F.lit(0)) <= 0, F.lit("no_images")),
            F.when(F.col("__n") > 1, F.lit("repeated_id")),
            F.when((F.col("role") == "shifted") & F.col("__c").isNull(), F.lit("no_control")),
        )
    )
    return c.select("cell_id", F.explode(rules).alias("rule"))


def reproduction(published: DataFrame, recomputed: DataFrame, key: str, value: str, tolerance: float = 1e-9) -> DataFrame:
    """(key, published, recomputed, status): 'same' within the tolerance, 'differs', 'not_recomputed' or 'not_published'."""
    p, r = published.select(key, F.col(value).alias("published"), F.lit(True).alias("__p")), recomputed.select(key, F.col(value).alias("recomputed"), F.lit(True).alias("__r"))
    near = F.col("published").eqNullSafe(F.col("recomputed")) | F.coalesce(F.abs(F.col("published") - F.col("recomputed")) <= tolerance, F.lit(False))
    status = F.when(F.col("__r").isNull(), "not_recomputed").when(F.col("__p").isNull(), "not_published").when(near, "same").otherwise("differs")
    return p.join(r, key, "full").select(key, "published", "recomputed", status.alias("status"))


def merge_plans(plans: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """(key, rule) of models (shard_id, model_id, seed) that keep shards from being merged: a seed or a model in two shards, an excluded model."""
    excluded = excluded or []

    def twice(key):
        return plans.groupBy(F.col(key).cast("string").alias("key")).agg(F.count_distinct("shard_id").alias("n")).where("n > 1").select("key", F.lit(f"{key}_in_two_shards").alias("rule"))

    barred = plans.where(F.col("model_id").cast("string").isin(excluded)).select(F.col("model_id").cast("string").alias("key"), F.lit("excluded_model").alias("rule")).distinct()
    return twice("seed").unionByName(twice("model_id")).unionByName(barred)


def shard_consistency(plan: DataFrame, report: DataFrame, shard: str, counts: str, digest: str) -> DataFrame:
    """Per shard, the first thing that is wrong: 'no_report', 'not_planned', 'count', 'digest', or 'ok'."""
    a, b = (df.select(shard, F.col(counts).alias(f"{s}_count"), F.col(digest).alias(f"{s}_digest"), F.lit(True).alias(f"__{s}")) for df, s in ((plan, "plan"), (report, "report")))
    status = F.when(F.col("__report").isNull(), "no_report").when(F.col("__plan").isNull(), "not_planned").when(~F.col("plan_count").eqNullSafe(F.col("report_count")), "count").when(~F.col("plan_digest").eqNullSafe(F.col("report_digest")), "digest")
    return a.join(b, shard, "full").select(shard, F.coalesce(status, F.lit("ok")).alias("status"))


def fingerprints(detections: DataFrame, model: str, image: str, label: str, score: str, area: str) -> DataFrame:
    """Per model and class: detections an image, mean score, mean area; beside them mean and deviation of detections an image."""
    per = detections.groupBy(model, image).agg(F.count(F.lit(1)).alias("k"))
    m = per.groupBy(model).agg(F.count(F.lit(1)).alias("n_images"), F.avg("k").alias("n_det_mean"), F.stddev_pop("k").alias("n_det_sd"))
    c = detections.groupBy(model, label).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(area).alias("mean_area"))
    return c.join(m, model).withColumn("rate", F.col("n") / F.col("n_images"))


def coverage(plan: DataFrame, evidence: DataFrame, cell: str, measured: Column) -> DataFrame:
    """Per planned cell the best evidence: 'measured', 'unmeasured' (there is some, but none measured) or 'missing'."""
    best = evidence.groupBy(cell).agg(F.max(F.coalesce(measured, F.lit(False)).cast("int")).alias("__m"), F.count(F.lit(1)).alias("n_evidence"))
    out = plan.select(cell).distinct().join(best, cell, "left")
    state = F.when(F.col("__m") == 1, "measured").when(F.col("__m") == 0, "unmeasured").otherwise("missing")
    return out.select(cell, F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), state.alias("state"))


def uniformity(pvalues: DataFrame, p: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n, ks): greatest distance between the p-values' distribution and the uniform one."""
    t = pvalues.where(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count(F.lit(1)).alias("own")).withColumn("c", F.col("own"))
    c = ranks.ordered(t, p, ("c",), by).withColumnRenamed("__all_c", "n")
    gap = F.greatest(F.abs(F.col("c") / F.col("n") - F.col(p)), F.abs(F.col(p) - (F.col("c") - F.col("own")) / F.col("n")))
    return c.groupBy(*by, "n").agg(F.max(gap).alias("ks"))


def conditional_contrast(objects: DataFrame, arm: str, scene: str, predicate: Column, hit: Column, min_n: int = 20) -> DataFrame:
    """Per arm and group of scenes ('singleton' with one object, 'present' where some object meets the predicate, else 'absent'): hits over objects."""
    s = objects.groupBy(arm, scene).agg(F.count(F.lit(1)).alias("k"), F.count_if(predicate).alias("met"), F.count_if(hit).alias("hits"))
    group = F.when(F.col("k") == 1, "singleton").when(F.col("met") > 0, "present").otherwise("absent")
    g = s.groupBy(arm, group.alias("group")).agg(F.sum("k").alias("n"), F.sum("hits").alias("hits"))
    return g.withColumn("rate", stats.rate(F.col("hits"), F.col("n"), min_n))


def retired_figures(texts: DataFrame, key: str, text: str, retired: list[str]) -> DataFrame:
    """(key, figure) of texts that still hold a retired string."""
    found = F.explode(F.array_compact(F.array(*[F.when(F.col(text).contains(r), F.lit(r)) for r in retired])))
    return texts.select(key, found.alias("figure"))
