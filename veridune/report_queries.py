"""Queries of the reports and checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import ledger, ranks, reports
from .registry import LED, MULTI, events, multi, query, r6, read


@query("SELECT source, CASE WHEN quality IS NULL THEN 'refused' ELSE 'ok' END AS status, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def guarded_join(spark, sf):
    j = reports.guarded_join(read(spark, sf, "documents").select("doc_id", "source"), read(spark, sf, "labels"), "doc_id")
    return j.groupBy("source", "status").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT user_id % 8 AS cell_id, user_id % 8 + 2 AS paired_cell, avg(value) FILTER (event_id % 2 = 0) AS reference, avg(value) FILTER (event_id % 2 = 1) AS operational FROM events GROUP BY 1, 2)
SELECT a.cell_id, a.paired_cell, round(a.operational - a.reference, 6) AS moved, round(b.operational - b.reference, 6) AS control_moved, round(a.operational - a.reference - (b.operational - b.reference), 6) AS net, CASE WHEN b.cell_id IS NULL THEN 'no_control' ELSE 'ok' END AS status FROM c a LEFT JOIN c b ON b.cell_id = a.paired_cell""")
def paired_control(spark, sf):
    e, half = read(spark, sf, "events"), F.col("event_id") % 2
    c = e.groupBy((F.col("user_id") % 8).alias("cell_id"), (F.col("user_id") % 8 + 2).alias("paired_cell")).agg(F.avg(F.when(half == 0, F.col("value"))).alias("reference"), F.avg(F.when(half == 1, F.col("value"))).alias("operational"))
    return r6(reports.paired_control(c).select("cell_id", "paired_cell", "moved", "control_moved", "net", "status"), "moved", "control_moved", "net")


@query("""WITH g AS (SELECT event_type, user_id % 8 AS a, count(*) FILTER (value > 50) AS reviewed, count(*) FILTER (value > 50 AND event_id % 3 = 0) AS caught, count(*) FILTER (value > 50 AND event_id % 3 <> 0) AS fp, count(*) FILTER (value <= 50 AND event_id % 3 = 0) AS missed FROM events GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY fp DESC, a) AS k FROM g)
SELECT event_type, sum(reviewed)::BIGINT AS reviewed, sum(caught)::BIGINT AS caught, sum(fp)::BIGINT AS false_positives, sum(missed)::BIGINT AS missed, max(a) FILTER (k = 1) AS benchmark_asset FROM w GROUP BY event_type""")
def review_policies(spark, sf):
    e = read(spark, sf, "events").withColumn("asset", F.col("user_id") % 8)
    return reports.review_policies(e, "event_type", "asset", F.col("value") > 50, F.col("event_id") % 3 == 0)


@query("""WITH g AS (SELECT source, count(*) AS n, count(*) FILTER (quality = 0) AS hits FROM documents JOIN labels USING (doc_id) GROUP BY source), t AS (SELECT sum(n) AS tn, sum(hits) AS th FROM g)
SELECT source, n, hits, round(hits::DOUBLE / n, 6) AS rate, round(CASE WHEN tn > n THEN (th - hits)::DOUBLE / (tn - n) END, 6) AS rest_rate, (SELECT count(*) FROM g h WHERE h.hits::DOUBLE / h.n >= g.hits::DOUBLE / g.n) AS rank FROM g, t""")
def contributor_ranking(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "source").join(read(spark, sf, "labels"), "doc_id")
    return r6(reports.leave_one_out(d, "source", F.col("quality") == 0), "rate", "rest_rate")


@query("""WITH t AS (SELECT event_type, count(*) AS n, quantile_cont(value, 0.95) AS threshold, max(value) AS extreme FROM events GROUP BY event_type), c AS (SELECT event_type, count(*) AS ties FROM events JOIN t USING (event_type) WHERE value = extreme GROUP BY event_type)
SELECT event_type, n, round(threshold, 6) AS threshold, round(extreme, 6) AS extreme, ties, round(1.0::DOUBLE / (n + 1), 6) AS p_floor, abs(threshold - extreme) <= 1e-9 AS at_ceiling, 1.0::DOUBLE / (n + 1) <= 0.05 AND abs(threshold - extreme) > 1e-9 AS can_fire FROM t JOIN c USING (event_type)""")
def signal_degeneracy(spark, sf):
    return r6(reports.degeneracy(read(spark, sf, "events"), "event_type", "value"), "threshold", "extreme", "p_floor")


SHARDS = f"""{LED}, t AS (SELECT corpus, quantile_cont(score, 0.95) AS threshold FROM e WHERE split = 'calibration' AND NOT is_positive GROUP BY corpus),
s AS (SELECT corpus, threshold, count(*) AS n, count(*) FILTER (score > threshold) AS k FROM e JOIN t USING (corpus) WHERE split = 'evaluation' AND NOT is_positive GROUP BY ALL)"""


@query(f"{SHARDS} SELECT corpus, round(threshold, 6) AS threshold, n, k FROM s")
def shard_rates(spark, sf):
    return r6(reports.shard_rates(events(spark, sf), "corpus"), "threshold")


@query(f"{SHARDS}, r AS (SELECT sum(k)::DOUBLE / sum(n) AS rate, count(*) AS m FROM s) SELECT round(rate, 6) AS rate, (m - 1)::INT AS df, round(sum((k - n * rate) ** 2 / (n * rate * (1 - rate))), 6) AS q, 'measured' AS status FROM s, r GROUP BY rate, m")
def shard_heterogeneity(spark, sf):
    return r6(ledger.cochran_q(reports.shard_rates(events(spark, sf), "corpus")).drop("p"), "rate", "q")


FUSED = f"""{MULTI}, o AS (SELECT l_orderkey, signal, p, count(*) OVER (PARTITION BY l_orderkey) AS m FROM p), f AS (SELECT l_orderkey, least(1, min(m * p)) AS bonferroni FROM o GROUP BY l_orderkey)"""


@query(f"{FUSED} SELECT 'bonferroni' AS method, count(*) FILTER (l_orderkey % 10 <> 0) AS n_neg, count(*) FILTER (l_orderkey % 10 <> 0 AND 1 - bonferroni > 1 - 0.05) AS false_alarms, count(*) FILTER (l_orderkey % 10 = 0) AS n_pos, count(*) FILTER (l_orderkey % 10 = 0 AND 1 - bonferroni > 1 - 0.05) AS hits FROM f")
def nominal_rates(spark, sf):
    f = ledger.fuse(multi(spark, sf), ["l_orderkey"]).withColumn("y", F.col("l_orderkey") % 10 == 0)
    return reports.nominal_rates(f, ["bonferroni"], "y").drop("fpr", "tpr")


@query(f"""{FUSED}, o1 AS (SELECT l_orderkey, signal, p, count(*) OVER (PARTITION BY l_orderkey, signal) AS m, row_number() OVER (PARTITION BY l_orderkey, signal ORDER BY p) AS k FROM p),
g AS (SELECT l_orderkey, signal, least(1, min(p * m * (SELECT sum(1.0::DOUBLE / i) FROM range(1, 100) t(i) WHERE i <= m) / k)) AS pg FROM o1 GROUP BY ALL),
o2 AS (SELECT l_orderkey, pg, count(*) OVER (PARTITION BY l_orderkey) AS m, row_number() OVER (PARTITION BY l_orderkey ORDER BY pg) AS k FROM g),
h AS (SELECT l_orderkey, least(1, min(pg * m * (SELECT sum(1.0::DOUBLE / i) FROM range(1, 100) t(i) WHERE i <= m) / k)) AS p_grouped FROM o2 GROUP BY l_orderkey)
SELECT count(*) AS n, count(*) FILTER (bonferroni <= .05 AND p_grouped <= .05) AS both, count(*) FILTER (bonferroni <= .05 AND p_grouped > .05) AS raw_only, count(*) FILTER (bonferroni > .05 AND p_grouped <= .05) AS grouped_only, count(*) FILTER (bonferroni > .05 AND p_grouped > .05) AS neither FROM f JOIN h USING (l_orderkey)""")
def group_benchmark(spark, sf):
    return reports.raw_and_grouped(multi(spark, sf), ["l_orderkey"], "signal")


@query(f"""{MULTI}, i AS (SELECT l_orderkey % 50 AS asset, l_orderkey, l_linenumber, least(1, min(p) * count(*)) AS p, min({{'p': p, 'signal': signal}}) AS best FROM p GROUP BY ALL),
r AS (SELECT *, row_number() OVER (ORDER BY p, l_orderkey, l_linenumber) AS k, count(*) OVER () AS n FROM i), q AS (SELECT *, min(p * n / k) OVER (ORDER BY p DESC, l_orderkey DESC, l_linenumber DESC ROWS UNBOUNDED PRECEDING) AS q0 FROM r),
z AS (SELECT *, least(1, min(q0) OVER (PARTITION BY p)) * (SELECT sum(1.0::DOUBLE / i) FROM range(1, (SELECT count(*) FROM i) + 1) t(i)) <= 0.05 AS hit FROM q),
a AS (SELECT asset, count(*) AS n_items, count(*) FILTER (hit) AS n_flagged, least(1, min(p) * count(*)) AS asset_p, (min(best) FILTER (hit)).signal AS "leading" FROM z GROUP BY asset)
SELECT asset, n_items, n_flagged, round(asset_p, 6) AS asset_p, "leading", CASE WHEN n_flagged > 0 THEN 'compromised' WHEN asset_p <= 0.05 THEN 'suspect' ELSE 'clean' END AS verdict FROM a""")
def asset_verdict(spark, sf):
    p = multi(spark, sf).withColumn("asset", F.col("l_orderkey") % 50)
    return r6(reports.asset_verdict(p, "asset", ["l_orderkey", "l_linenumber"]), "asset_p")


@query("""WITH e AS (SELECT source, min(doc_id) AS o, arg_min(lang, doc_id) AS d FROM documents GROUP BY source)
SELECT source, CASE WHEN doc_id = o THEN 'abstain' WHEN lang = d THEN 'pass' ELSE 'fail' END AS verdict, count(*) AS n FROM documents JOIN e USING (source) GROUP BY ALL""")
def digest_baseline(spark, sf):
    b = reports.digest_baseline(read(spark, sf, "documents").select("source", "doc_id", "lang"), "source", "doc_id", "lang")
    return b.groupBy("source", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id FROM documents ORDER BY md5('audit' || doc_id::VARCHAR), doc_id LIMIT 59")
def audit_sample(spark, sf):
    return reports.audit_sample(read(spark, sf, "documents").select("doc_id"), "doc_id", 59, "audit")


LINES = "k AS (SELECT l_orderkey AS o_orderkey, min(l_linestatus) AS d FROM lineitem WHERE l_quantity > 10 GROUP BY 1)"


@query(f"WITH {LINES}, j AS (SELECT o.o_orderkey AS a, k.o_orderkey AS b, o.o_orderstatus AS x, k.d AS y FROM orders o FULL JOIN k USING (o_orderkey)) SELECT CASE WHEN b IS NULL THEN 'missing_on_disk' WHEN a IS NULL THEN 'not_registered' ELSE 'digest_mismatch' END AS rule, count(*) AS n FROM j WHERE a IS NULL OR b IS NULL OR x <> y GROUP BY 1")
def registry_problems(spark, sf):
    disk = read(spark, sf, "lineitem").where("l_quantity > 10").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_linestatus").alias("o_orderstatus"))
    return reports.registry_problems(read(spark, sf, "orders"), disk, "o_orderkey", "o_orderstatus").groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT c_custkey AS cell_id, CASE WHEN c_custkey % 3 = 0 THEN 'shifted' WHEN c_custkey % 3 = 1 THEN 'no_shift_control' ELSE 'other' END AS role, c_acctbal AS n_images, c_custkey + 1 + c_custkey % 2 AS paired_cell FROM customer)
SELECT rule, count(*) AS n FROM (SELECT 'unknown_role' AS rule FROM c WHERE role = 'other' UNION ALL SELECT 'no_images' FROM c WHERE n_images <= 0 UNION ALL SELECT 'no_control' FROM c WHERE role = 'shifted' AND NOT EXISTS (SELECT 1 FROM c d WHERE d.cell_id = c.paired_cell AND d.role = 'no_shift_control')) GROUP BY rule""")
def drift_cell_problems(spark, sf):
    k = F.col("c_custkey")
    c = read(spark, sf, "customer").select(k.alias("cell_id"), F.when(k % 3 == 0, "shifted").when(k % 3 == 1, "no_shift_control").otherwise("other").alias("role"), F.col("c_acctbal").alias("n_images"), (k + 1 + k % 2).alias("paired_cell"))
    return reports.drift_cell_problems(c, ["reference", "shifted", "no_shift_control"]).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT o_orderkey, round(o_totalprice::DOUBLE, 2) AS v FROM orders), b AS (SELECT l_orderkey, round(sum(l_extendedprice::DOUBLE), 2) AS v FROM lineitem GROUP BY 1)
SELECT CASE WHEN b.l_orderkey IS NULL THEN 'not_recomputed' WHEN a.o_orderkey IS NULL THEN 'not_published' WHEN abs(a.v - b.v) <= 50000 THEN 'same' ELSE 'differs' END AS status, count(*) AS n FROM a FULL JOIN b ON o_orderkey = l_orderkey GROUP BY 1""")
def reproduction(spark, sf):
    a = read(spark, sf, "orders").select("o_orderkey", F.round(F.col("o_totalprice").cast("double"), 2).alias("v"))
    b = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum(F.col("l_extendedprice").cast("double")), 2).alias("v"))
    return reports.reproduction(a, b, "o_orderkey", "v", 50000.0).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT l_suppkey % 7 AS shard_id, l_orderkey AS model_id, l_partkey AS seed FROM lineitem)
SELECT rule, count(*) AS n FROM (SELECT 'seed_in_two_shards' AS rule FROM p GROUP BY seed HAVING count(DISTINCT shard_id) > 1 UNION ALL SELECT 'model_id_in_two_shards' FROM p GROUP BY model_id HAVING count(DISTINCT shard_id) > 1 UNION ALL SELECT DISTINCT 'excluded_model' FROM p WHERE model_id = 1) GROUP BY rule""")
def merge_plans(spark, sf):
    p = read(spark, sf, "lineitem").select((F.col("l_suppkey") % 7).alias("shard_id"), F.col("l_orderkey").alias("model_id"), F.col("l_partkey").alias("seed"))
    return reports.merge_plans(p, ["1"]).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH k AS (SELECT l_orderkey AS id, count(*) % 3 AS n, min(l_linestatus) AS d FROM lineitem WHERE l_quantity > 10 GROUP BY 1)
SELECT CASE WHEN id IS NULL THEN 'no_report' WHEN o_orderkey IS NULL THEN 'not_planned' WHEN o_orderkey % 3 <> n THEN 'count' WHEN o_orderstatus <> d THEN 'digest' ELSE 'ok' END AS status, count(*) AS n FROM orders FULL JOIN k ON o_orderkey = id GROUP BY 1""")
def shard_consistency(spark, sf):
    plan = read(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 3).alias("n"), F.col("o_orderstatus").alias("d"))
    report = read(spark, sf, "lineitem").where("l_quantity > 10").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.count(F.lit(1)) % 3).alias("n"), F.min("l_linestatus").alias("d"))
    return reports.shard_consistency(plan, report, "o_orderkey", "n", "d").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH m AS (SELECT l_linestatus, count(*) AS n_images, avg(k) AS n_det_mean, stddev_pop(k) AS n_det_sd FROM (SELECT l_linestatus, l_orderkey, count(*) AS k FROM lineitem GROUP BY ALL) GROUP BY 1)
SELECT l_linestatus, l_returnflag, count(*) AS n, round(avg(l_discount::DOUBLE), 6) AS mean_score, round(avg(l_quantity::DOUBLE), 6) AS mean_area, any_value(n_images) AS n_images, round(any_value(n_det_mean), 6) AS n_det_mean, round(any_value(n_det_sd), 6) AS n_det_sd, round(count(*)::DOUBLE / any_value(n_images), 6) AS rate FROM lineitem JOIN m USING (l_linestatus) GROUP BY ALL""")
def behaviour_fingerprints(spark, sf):
    x = read(spark, sf, "lineitem").select("l_linestatus", "l_orderkey", "l_returnflag", F.col("l_discount").cast("double").alias("s"), F.col("l_quantity").cast("double").alias("a"))
    return r6(reports.fingerprints(x, "l_linestatus", "l_orderkey", "l_returnflag", "s", "a"), "mean_score", "mean_area", "n_det_mean", "n_det_sd", "rate")


@query("""WITH e AS (SELECT o_custkey AS c, max((o_totalprice > 300000)::INT) AS m, count(*) AS k FROM orders GROUP BY 1) SELECT c_custkey AS cell, coalesce(k, 0) AS n_evidence, CASE m WHEN 1 THEN 'measured' WHEN 0 THEN 'unmeasured' ELSE 'missing' END AS state FROM customer LEFT JOIN e ON c = c_custkey""")
def coverage_matrix(spark, sf):
    ev = read(spark, sf, "orders").select(F.col("o_custkey").alias("cell"), "o_totalprice")
    return reports.coverage(read(spark, sf, "customer").select(F.col("c_custkey").alias("cell")), ev, "cell", F.col("o_totalprice") > 300000)


@query(f"{MULTI}, r AS (SELECT signal, p, count(*) OVER (PARTITION BY signal ORDER BY p) AS c, count(*) OVER (PARTITION BY signal, p) AS own, count(*) OVER (PARTITION BY signal) AS n FROM p) SELECT signal, n, round(max(greatest(abs(c::DOUBLE / n - p), abs(p - (c - own)::DOUBLE / n))), 6) AS ks FROM r GROUP BY ALL")
def pvalue_uniformity(spark, sf):
    return r6(reports.uniformity(multi(spark, sf), "p", ("signal",)), "ks")


@query("""WITH s AS (SELECT l_linestatus, l_orderkey, count(*) AS k, count(*) FILTER (l_quantity > 45) AS met, count(*) FILTER (l_returnflag = 'R') AS hits FROM lineitem GROUP BY ALL)
SELECT l_linestatus, CASE WHEN k = 1 THEN 'singleton' WHEN met > 0 THEN 'present' ELSE 'absent' END AS "group", sum(k)::BIGINT AS n, sum(hits)::BIGINT AS hits, CASE WHEN sum(k) >= 20 THEN round(sum(hits)::DOUBLE / sum(k), 4) END AS point FROM s GROUP BY ALL""")
def conditional_contrast(spark, sf):
    c = reports.conditional_contrast(read(spark, sf, "lineitem"), "l_linestatus", "l_orderkey", F.col("l_quantity") > 45, F.col("l_returnflag") == "R")
    return c.select("l_linestatus", "group", "n", "hits", "rate.point")


@query("SELECT doc_id, figure FROM documents, (SELECT unnest(['http', '@', 'Copyright']) AS figure) WHERE contains(text, figure)")
def retired_figures(spark, sf):
    return reports.retired_figures(read(spark, sf, "documents"), "doc_id", "text", ["http", "@", "Copyright"])


@query("""WITH h AS (SELECT value AS x, event_id <= (SELECT (min(event_id) + max(event_id)) / 2 FROM events) AS a FROM events), c AS (SELECT x, sum(a::INT) AS a, sum((NOT a)::INT) AS b FROM h GROUP BY x),
r AS (SELECT abs(sum(a) OVER (ORDER BY x)::DOUBLE / sum(a) OVER () - sum(b) OVER (ORDER BY x)::DOUBLE / sum(b) OVER ()) AS gap FROM c) SELECT round(max(gap), 6) AS ks FROM r""")
def self_null(spark, sf):
    e = read(spark, sf, "events")
    mid = e.agg(((F.min("event_id") + F.max("event_id")) / 2).alias("mid"))
    h = e.join(F.broadcast(mid)).select(F.col("value").alias("x"), (F.col("event_id") <= F.col("mid")).alias("a"))  # one row
    return r6(ranks.two_sample(h, "x", "a").select("ks"), "ks")
