"""Queries over the test tables and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import stats
from .operators import assets, chains, decisions, drift, ledger, population, quality, ranks, spectral
from .streaming import monitor

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def events(spark, sf) -> DataFrame:
    """Events as a one-signal ledger: errors are positive, the key's md5 splits."""
    e = read(spark, sf, "events")
    split = F.when(ledger.half("event_id") == 0, "calibration").otherwise("evaluation")
    return e.select("event_id", (F.col("user_id") % 8).alias("corpus"), F.col("event_type").alias("kind"), (F.col("event_type") == "error").alias("is_positive"), split.alias("split"), F.lit("value").alias("signal"), F.col("value").alias("score"))


LED = """WITH e AS (SELECT event_id, user_id % 8 AS corpus, event_type AS kind, event_type = 'error' AS is_positive, 'value' AS signal, value AS score,
 CASE WHEN ('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8))::BIGINT % 2 = 0 THEN 'calibration' ELSE 'evaluation' END AS split FROM events)"""
PV = f"""{LED}, c AS (SELECT score FROM e WHERE split = 'calibration' AND NOT is_positive), nc AS (SELECT count(*) AS n FROM c),
w AS (SELECT *, split = 'calibration' AND NOT is_positive AS is_cal, sum((split = 'calibration' AND NOT is_positive)::INT) OVER (ORDER BY score DESC) AS ge FROM e),
p AS (SELECT event_id, corpus, kind, is_positive, score, (1.0::DOUBLE + ge) / (1.0::DOUBLE + n) AS p FROM w, nc WHERE split = 'evaluation')"""


def pvalues(spark, sf) -> DataFrame:
    e = events(spark, sf).withColumn("is_cal", (F.col("split") == "calibration") & ~F.col("is_positive"))
    return ranks.conformal_pvalues(e, "score", "is_cal").where("split = 'evaluation'")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fpr_rule(spark, sf_dir)


def _wilson(k, n):
    z = stats.Z95
    mid, den = f"({k}::DOUBLE / {n} + {z * z} / (2.0 * {n}))", f"(1 + {z * z} / {n})"
    half = f"{z} * sqrt({k}::DOUBLE / {n} * (1 - {k}::DOUBLE / {n}) / {n} + {z * z} / (4.0 * {n} * {n}))"
    return f"round(greatest(({mid} - {half}) / {den}, 0), 4)", f"round(least(({mid} + {half}) / {den}, 1), 4)"


_lo, _hi = _wilson("fa", "nn")


@query(f"""{LED}, t AS (SELECT quantile_cont(score, 0.95) AS threshold, max(score) AS extreme, count(*) AS n_calibration FROM e WHERE split = 'calibration' AND NOT is_positive),
g AS (SELECT threshold, extreme, n_calibration, count(*) FILTER (NOT is_positive) AS nn, count(*) FILTER (NOT is_positive AND score > threshold) AS fa, count(*) FILTER (is_positive) AS np, count(*) FILTER (is_positive AND score > threshold) AS hits
 FROM e, t WHERE split = 'evaluation' GROUP BY ALL)
SELECT 'value' AS signal, round(threshold, 6) AS threshold, n_calibration, nn AS n_neg, fa AS false_alarms, np AS n_pos, hits, abs(threshold - extreme) <= 1e-9 AS degenerate,
 CASE WHEN nn >= 20 THEN round(fa::DOUBLE / nn, 4) END AS fpr, CASE WHEN nn >= 20 THEN {_lo} END AS fpr_lo, CASE WHEN nn >= 20 THEN {_hi} END AS fpr_hi, CASE WHEN np >= 20 THEN round(hits::DOUBLE / np, 4) END AS tpr FROM g""")
def fpr_rule(spark, sf):
    g = ledger.fpr_rule(events(spark, sf))
    return r6(g.select("signal", "threshold", "n_calibration", "n_neg", "false_alarms", "n_pos", "hits", "degenerate", F.col("fpr.point").alias("fpr"), F.col("fpr.lo").alias("fpr_lo"), F.col("fpr.hi").alias("fpr_hi"), F.col("tpr.point").alias("tpr")), "threshold")


@query(f"{LED} SELECT split, is_positive, count(*) AS n FROM e GROUP BY ALL")
def split_half(spark, sf):
    return events(spark, sf).groupBy("split", "is_positive").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 12))::BIGINT) - 1 AS k FROM events)
SELECT event_type, CASE WHEN k % 2 = 0 THEN 'calibration' ELSE 'evaluation' END AS split, count(*) AS n, sum(event_id)::BIGINT AS ids FROM r GROUP BY ALL""")
def stratified_split(spark, sf):
    s = ledger.stratified_half(read(spark, sf, "events").select("event_id", "event_type"), "event_id", "event_type")
    return s.groupBy("event_type", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query(f"{PV} SELECT event_id, round(p, 6) AS p FROM p")
def conformal_pvalues(spark, sf):
    return r6(pvalues(spark, sf).select("event_id", "p"), "p")


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, round(value, 6) AS threshold FROM r WHERE k = least(ceil((n + 1) * 0.95), n)")
def conformal_threshold(spark, sf):
    return r6(ranks.conformal_threshold(read(spark, sf, "events"), "value", 0.05, ("event_type",)).select("event_type", "threshold"), "threshold")


@query("SELECT event_type, round(quantile_cont(value, 0.95), 6) AS threshold FROM events GROUP BY ALL")
def quantile_threshold(spark, sf):
    return r6(ranks.quantiles(read(spark, sf, "events"), "value", {"threshold": 0.95}, ("event_type",)).drop("n"), "threshold")


BHQ = f"""{PV}, r AS (SELECT event_id, p, row_number() OVER (ORDER BY p, event_id) AS k, count(*) OVER () AS n FROM p),
q AS (SELECT event_id, p, n, least(1, min(p * n / k) OVER (ORDER BY p DESC, event_id DESC ROWS UNBOUNDED PRECEDING)) AS q0, p AS pp FROM r),
qq AS (SELECT *, min(q0) OVER (PARTITION BY pp) AS q, (SELECT sum(1.0::DOUBLE / i) FROM range(1, (SELECT count(*) FROM p) + 1) t(i)) AS h FROM q)"""


@query(f"{BHQ} SELECT event_id, round(q, 6) AS q, q <= 0.05 AS bh, q * h <= 0.05 AS \"by\" FROM qq")
def adjusted_pvalues(spark, sf):
    return r6(ranks.adjusted(pvalues(spark, sf).select("event_id", "p")).select("event_id", "q", "bh", "by"), "q")


AUC = "sum(CASE WHEN y THEN rk ELSE 0 END)"


@query(f"""{LED}, r AS (SELECT corpus, is_positive AS y, rank() OVER (PARTITION BY corpus ORDER BY score) + (count(*) OVER (PARTITION BY corpus, score) - 1) / 2.0::DOUBLE AS rk FROM e)
SELECT corpus, count(*) FILTER (y) AS n_pos, count(*) FILTER (NOT y) AS n_neg, CASE WHEN count(*) FILTER (y) > 0 AND count(*) FILTER (NOT y) > 0 THEN
 round(({AUC} - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y)::DOUBLE * count(*) FILTER (NOT y)), 6) END AS auroc FROM r GROUP BY corpus""")
def auroc(spark, sf):
    return r6(ranks.auroc(events(spark, sf), by=("corpus",)), "auroc")


ROC = """d AS (SELECT score, sum(y::INT) AS pos, sum((NOT y)::INT) AS neg FROM s GROUP BY score),
roc AS (SELECT score, sum(pos) OVER (ORDER BY score DESC)::DOUBLE / sum(pos) OVER () AS tpr, sum(neg) OVER (ORDER BY score DESC)::DOUBLE / sum(neg) OVER () AS fpr FROM d)"""
LAB = "WITH s AS (SELECT n_chars::DOUBLE AS score, quality = 0 AS y FROM documents JOIN labels USING (doc_id))"


def labelled(spark, sf):
    return read(spark, sf, "documents").select("doc_id", "n_chars").join(read(spark, sf, "labels"), "doc_id").select(F.col("n_chars").cast("double").alias("score"), (F.col("quality") == 0).alias("is_positive"))


@query(f"{LAB}, {ROC} SELECT score, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM roc")
def roc_curve(spark, sf):
    return r6(ranks.roc_curve(labelled(spark, sf)), "tpr", "fpr")


@query(f"{LAB}, {ROC} SELECT round(coalesce(max(tpr) FILTER (fpr <= 0.2 + 1e-12), 0), 6) AS tpr FROM roc")
def tpr_at_fpr(spark, sf):
    return r6(ranks.tpr_at_fpr(ranks.roc_curve(labelled(spark, sf)), 0.2), "tpr")


PROB = "WITH s AS (SELECT n_chars::DOUBLE / (n_chars + 2000) AS p, quality = 0 AS y FROM documents JOIN labels USING (doc_id)), b AS (SELECT least(floor(p * 10), 9)::INT AS bin, count(*) AS n, avg(p) AS confidence, avg(y::INT) AS accuracy FROM s GROUP BY 1)"


def probs(spark, sf):
    return labelled(spark, sf).withColumn("p", F.col("score") / (F.col("score") + 2000))


@query(f"{PROB} SELECT bin, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM b")
def reliability(spark, sf):
    return r6(ranks.reliability(probs(spark, sf), "p", "is_positive"), "confidence", "accuracy")


@query(f"{PROB} SELECT round(sum(n * abs(accuracy - confidence)) / sum(n), 6) AS ece FROM b")
def ece(spark, sf):
    return r6(ranks.ece(probs(spark, sf), "p", "is_positive"), "ece")


@query(f"{LAB} SELECT count(*) FILTER (score >= 3000 AND y) AS tp, count(*) FILTER (score >= 3000 AND NOT y) AS fp, count(*) FILTER (score < 3000 AND y) AS fn, round(2.0::DOUBLE * count(*) FILTER (score >= 3000 AND y) / (2 * count(*) FILTER (score >= 3000 AND y) + count(*) FILTER (score >= 3000 AND NOT y) + count(*) FILTER (score < 3000 AND y)), 6) AS f1 FROM s")
def f1_at_threshold(spark, sf):
    return r6(ranks.f1_at(labelled(spark, sf), "score", "is_positive", 3000.0), "f1")


# -- fusion and ledgers ------------------------------------------------------------------------------------------------

MULTI = """WITH l AS (SELECT l_orderkey, l_linenumber, unnest(['qty', 'price', 'disc']) AS signal, unnest([l_quantity::DOUBLE, l_extendedprice::DOUBLE, l_discount::DOUBLE]) AS score FROM lineitem WHERE l_orderkey % 7 < 7),
w AS (SELECT *, sum((l_orderkey % 2)::INT) OVER (PARTITION BY signal ORDER BY score DESC) AS ge, sum((l_orderkey % 2)::INT) OVER (PARTITION BY signal) AS n FROM l),
p AS (SELECT l_orderkey, l_linenumber, signal, (1.0::DOUBLE + ge) / (1.0::DOUBLE + n) AS p FROM w WHERE l_orderkey % 2 = 0)""".replace(" WHERE l_orderkey % 7 < 7", "")


def multi(spark, sf):
    x = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.expr("stack(3, 'qty', cast(l_quantity as double), 'price', cast(l_extendedprice as double), 'disc', cast(l_discount as double)) as (signal, score)"))
    p = ranks.conformal_pvalues(x.withColumn("is_cal", F.col("l_orderkey") % 2 == 1), "score", "is_cal", ("signal",))
    return p.where("l_orderkey % 2 = 0").select("l_orderkey", "l_linenumber", "signal", "p")


_CP = "least(greatest(p, 1e-12), 1 - 1e-12)"


@query(f"""{MULTI}, o AS (SELECT l_orderkey, p, count(*) OVER (PARTITION BY l_orderkey) AS m, row_number() OVER (PARTITION BY l_orderkey ORDER BY p) AS k FROM p),
h AS (SELECT *, (SELECT sum(1.0::DOUBLE / i) FROM range(1, 100) t(i) WHERE i <= m) AS hm FROM o)
SELECT l_orderkey, round(least(1, min(m * p)), 6) AS bonferroni, round(least(greatest(0.5 - atan(avg(tan((0.5 - {_CP}) * pi()))) / pi(), 0), 1), 6) AS cauchy, round(least(1, min(p * m * hm / k)), 6) AS by_global FROM h GROUP BY l_orderkey""")
def fused_pvalues(spark, sf):
    return r6(ledger.fuse(multi(spark, sf), ["l_orderkey"]), "bonferroni", "cauchy", "by_global")


@query(f"""{MULTI}, o AS (SELECT l_orderkey, signal, p, count(*) OVER (PARTITION BY l_orderkey, signal) AS m, row_number() OVER (PARTITION BY l_orderkey, signal ORDER BY p) AS k FROM p),
g AS (SELECT l_orderkey, signal, least(1, min(p * m * (SELECT sum(1.0::DOUBLE / i) FROM range(1, 100) t(i) WHERE i <= m) / k)) AS pg FROM o GROUP BY ALL),
o2 AS (SELECT l_orderkey, pg, count(*) OVER (PARTITION BY l_orderkey) AS m, row_number() OVER (PARTITION BY l_orderkey ORDER BY pg) AS k FROM g)
SELECT l_orderkey, round(least(1, min(pg * m * (SELECT sum(1.0::DOUBLE / i) FROM range(1, 100) t(i) WHERE i <= m) / k)), 6) AS p_grouped FROM o2 GROUP BY l_orderkey""")
def grouped_by_fusion(spark, sf):
    return r6(ledger.grouped_by(multi(spark, sf), ["l_orderkey"], "signal"), "p_grouped")


@query(f"{LED} SELECT kind, corpus, count(*) AS n, count(*) FILTER (score > 150) AS hits, CASE WHEN count(*) >= 20 THEN 'ok' ELSE 'insufficient_denominator' END AS status, CASE WHEN count(*) >= 20 THEN round(count(*) FILTER (score > 150)::DOUBLE / count(*), 4) END AS point FROM e GROUP BY ALL")
def ladder_cells(spark, sf):
    c = ledger.rate_cells(events(spark, sf), ["kind", "corpus"], F.col("score") > 150)
    return c.select("kind", "corpus", "n", "hits", "rate.status", "rate.point")


@query("""WITH f AS (SELECT o_orderkey AS key, unnest(['big', 'urgent', 'odd']) AS rule, unnest([o_totalprice > 150000, o_orderpriority LIKE '1%', o_custkey % 2 = 1]) AS hit FROM orders), h AS (SELECT key, rule FROM f WHERE hit),
n AS (SELECT rule, count(*) AS n FROM h GROUP BY rule)
SELECT a.rule AS rule_a, b.rule AS rule_b, count(*) AS both, any_value(na.n) + any_value(nb.n) - count(*) AS either, round(count(*)::DOUBLE / (any_value(na.n) + any_value(nb.n) - count(*)), 6) AS jaccard
FROM h a JOIN h b ON a.key = b.key AND a.rule < b.rule JOIN n na ON na.rule = a.rule JOIN n nb ON nb.rule = b.rule GROUP BY ALL""")
def flag_overlap(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.expr("stack(3, 'big', o_totalprice > 150000, 'urgent', o_orderpriority like '1%', 'odd', o_custkey % 2 = 1) as (rule, hit)"))
    return r6(ledger.flag_overlap(o.where("hit")), "jaccard")


@query("""WITH c AS (SELECT 'value' AS signal, event_type AS kind, count(*) AS n, count(*) FILTER (value > 150) AS hits FROM events GROUP BY event_type), b AS (SELECT *, (SELECT sum(hits)::DOUBLE / sum(n) FROM c) AS baseline FROM c),
m AS (SELECT *, unnest(range(n + 1)) AS i FROM b WHERE n >= 3 AND baseline > 0 AND baseline < 1), d AS (SELECT *, exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(baseline) + (n - i) * ln(1 - baseline)) AS d FROM m),
p AS (SELECT signal, kind, n, hits, baseline, least(1, 2 * least(sum(d) FILTER (i >= hits), sum(d) FILTER (i <= hits))) AS p FROM d GROUP BY ALL), r AS (SELECT *, (SELECT count(*) FROM p b WHERE b.p <= a.p) AS rank, (SELECT count(*) FROM p) AS m FROM p a),
q AS (SELECT *, (SELECT least(1, min(b.p * b.m / b.rank)) FROM r b WHERE b.p >= a.p) AS q FROM r a) SELECT signal, kind, n, hits, round(baseline, 6) AS baseline, round(p, 6) AS p, rank, round(q, 6) AS q, q <= 0.05 AS bh, q * (SELECT sum(1.0::DOUBLE / i) FROM range(1, 1000) t(i) WHERE i <= m) <= 0.05 AS by FROM q""")
def kind_family(spark, sf):
    e = events(spark, sf).groupBy("signal", F.col("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") > 150).alias("hits"))
    return r6(ledger.kind_family(e), "baseline", "p", "q")


@query("""WITH r AS (SELECT event_id AS id, event_type AS kind, value, user_id FROM events)
SELECT rule, count(*) AS n FROM (SELECT 'undeclared_kind' AS rule FROM r WHERE kind NOT IN ('error', 'view', 'click') UNION ALL SELECT 'polarity_mismatch' FROM r WHERE kind IN ('error', 'view', 'click') AND (kind = 'error') <> (value > 100)) GROUP BY rule""")
def ledger_problems(spark, sf):
    e = read(spark, sf, "events").select(F.col("event_id").cast("string").alias("model_id"), F.col("user_id").cast("string").alias("corpus"), F.col("event_type").alias("kind"), (F.col("value") > 100).alias("is_positive"), F.lit("unassigned").alias("split"), F.create_map(F.lit("value"), F.col("value")).alias("scores"))
    return ledger.problems(e, ["error"], ["view", "click"]).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("WITH a AS (SELECT doc_id, 'labels' AS origin, quality AS score FROM labels), m AS (SELECT * FROM a UNION ALL SELECT doc_id, 'documents', n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM a)) SELECT origin, count(*) AS n, sum(score)::BIGINT AS total FROM m GROUP BY origin")
def ledger_merge(spark, sf):
    a = read(spark, sf, "labels").select("doc_id", F.lit("labels").alias("origin"), F.col("quality").cast("long").alias("score"))
    b = read(spark, sf, "documents").select("doc_id", F.lit("documents").alias("origin"), F.col("n_chars").cast("long").alias("score"))
    return ledger.merge(a, b, ("doc_id",)).groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"))


COQ = "WITH g AS (SELECT user_id % 8 AS c, count(*) AS n, count(*) FILTER (value > 150) AS k FROM events GROUP BY 1), r AS (SELECT sum(k)::DOUBLE / sum(n) AS rate, count(*) AS m FROM g)"


@query(f"{COQ} SELECT round(rate, 6) AS rate, (m - 1)::INT AS df, round(sum((k - n * rate) ** 2 / (n * rate * (1 - rate))), 6) AS q, 'measured' AS status FROM g, r GROUP BY rate, m")
def heterogeneity(spark, sf):
    g = events(spark, sf).groupBy("corpus").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") > 150).alias("k"))
    return r6(ledger.cochran_q(g).drop("p"), "rate", "q")


@query(None)
def heterogeneity_p(spark, sf):
    g = events(spark, sf).groupBy("corpus").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") > 150).alias("k"))
    return ledger.cochran_q(g)


@query("""WITH s AS (SELECT unnest(range(5)) AS seed), x AS (SELECT seed, event_id, value, event_type = 'error' AS pos, ('0x' || substr(md5(seed::VARCHAR || CAST(event_id AS VARCHAR)), 1, 8))::BIGINT % 2 AS h FROM events, s),
t AS (SELECT seed, quantile_cont(value, 0.95) AS thr FROM x WHERE h = 0 AND NOT pos GROUP BY seed) SELECT seed, count(*) AS n, count(*) FILTER (value > thr) AS k FROM x JOIN t USING (seed) WHERE h = 1 AND NOT pos GROUP BY seed""")
def split_stability(spark, sf):
    e = read(spark, sf, "events").where("event_type <> 'error'").select("event_id", "value", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("seed"))
    x = e.withColumn("h", F.conv(F.substring(F.md5(F.concat(F.col("seed").cast("string"), F.col("event_id").cast("string"))), 1, 8), 16, 10).cast("long") % 2)
    t = ranks.quantiles(x.where("h = 0"), "value", {"thr": 0.95}, ("seed",)).drop("n")
    return x.where("h = 1").join(F.broadcast(t), "seed").groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > F.col("thr")).alias("k"))


# -- populations -------------------------------------------------------------------------------------------------------


@query("SELECT o_orderstatus, count(*) AS n, min(o_orderkey) AS seed_min, max(o_orderkey) AS seed_max, count(DISTINCT o_orderkey) AS n_seeds FROM orders GROUP BY ALL")
def shard_census(spark, sf):
    return population.census(read(spark, sf, "orders"), "o_orderstatus", "o_orderkey")


@query("WITH d AS (SELECT DISTINCT o_orderstatus, o_orderkey FROM orders), g AS (SELECT *, o_orderkey - row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS i FROM d) SELECT o_orderstatus, min(o_orderkey) AS first, max(o_orderkey) AS last, count(*) AS n FROM g GROUP BY o_orderstatus, i")
def seed_islands(spark, sf):
    return population.islands(read(spark, sf, "orders"), ["o_orderstatus"], "o_orderkey")


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS n_sources, count(*) AS n, count(DISTINCT l_returnflag) = 1 AS same_digest FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1")
def seed_collisions(spark, sf):
    return population.collisions(read(spark, sf, "lineitem"), "l_partkey", "l_suppkey", "l_returnflag")


@query("SELECT source, text, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def within_shard_duplicates(spark, sf):
    return population.within_duplicates(read(spark, sf, "documents"), "source", "text")


@query("WITH k AS (SELECT l_orderkey, CASE WHEN min(l_linestatus) = max(l_linestatus) THEN min(l_linestatus) ELSE 'P' END AS d FROM lineitem GROUP BY 1) SELECT CASE WHEN l_orderkey IS NULL THEN 'not_seen' WHEN o_orderkey IS NULL THEN 'not_planned' WHEN o_orderstatus = d THEN 'verified' ELSE 'digest_mismatch' END AS status, count(*) AS n FROM orders FULL JOIN k ON o_orderkey = l_orderkey GROUP BY 1")
def plan_reconcile(spark, sf):
    p = read(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("d"))
    k = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.when(F.min("l_linestatus") == F.max("l_linestatus"), F.min("l_linestatus")).otherwise("P").alias("d"))
    return population.reconcile(p, k, "o_orderkey", "d").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("WITH r AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS r, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) SELECT s_nationkey, s_suppkey FROM r WHERE r % greatest(n // 3, 1) = 0 AND r // greatest(n // 3, 1) < 3")
def even_pick(spark, sf):
    return population.even_pick(read(spark, sf, "supplier").select("s_nationkey", "s_suppkey"), "s_nationkey", "s_suppkey", 3)


@query("SELECT coalesce(source, '_total') AS source, count(*) AS n FROM documents GROUP BY ROLLUP (source)")
def source_counts(spark, sf):
    return population.counts_with_total(read(spark, sf, "documents"), "source")


@query("WITH s AS (SELECT CASE WHEN l.doc_id IS NULL THEN 'incomplete' ELSE 'complete' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)) SELECT status, count(*) AS n FROM s GROUP BY status")
def score_status(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "n_chars").join(read(spark, sf, "labels"), "doc_id", "left")
    return population.score_status(d, ["n_chars", "quality"]).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lang, quality, count(*) AS n, count(*) FILTER (toxic = 1) AS hits, CASE WHEN count(*) >= 20 THEN round(count(*) FILTER (toxic = 1)::DOUBLE / count(*), 4) END AS point FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def clean_slices(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "lang").join(read(spark, sf, "labels"), "doc_id")
    return ledger.rate_cells(d, ["lang", "quality"], F.col("toxic") == 1).select("lang", "quality", "n", "hits", "rate.point")


@query("SELECT user_id, list_sort(list(DISTINCT event_type)) AS splits FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 1")
def split_overlaps(spark, sf):
    return population.split_overlaps(read(spark, sf, "events"), "user_id", "event_type")


# -- quality -----------------------------------------------------------------------------------------------------------


@query("SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf):
    return quality.exact_groups(read(spark, sf, "documents"), "doc_id", "text")


COS = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), n AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS l FROM v),
c AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.x, b.x) / (a.l * b.l) AS cosine FROM n a JOIN n b ON a.vec_id < b.vec_id)"""


@query(f"{COS} SELECT a, b, round(cosine, 6) AS cosine FROM c WHERE cosine >= 0.4")
def near_duplicates(spark, sf):
    return r6(quality.near_pairs(read(spark, sf, "embeddings"), "vec_id", "embedding", 0.4), "cosine")


@query(f"{COS}, d AS (SELECT a AS id, b AS o, round(cosine, 12) AS c FROM c UNION ALL SELECT b, a, round(cosine, 12) FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, o) AS k FROM d) SELECT id, o AS neighbour, round(c, 6) AS cosine FROM r WHERE k = 1")
def nearest_neighbour(spark, sf):
    return r6(quality.nearest(read(spark, sf, "embeddings"), "vec_id", "embedding"), "cosine")


@query(f"""{COS.replace("WITH v", "WITH RECURSIVE v")}, e AS (SELECT a, b FROM c WHERE cosine >= 0.35 UNION SELECT b, a FROM c WHERE cosine >= 0.35), r AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node) SELECT node, min(root) AS component FROM r GROUP BY node""")
def duplicate_components(spark, sf):
    return quality.components(quality.near_forest(read(spark, sf, "embeddings"), "vec_id", "embedding", 0.35))


@query("""WITH g AS (SELECT sha256(text) AS c, source, doc_id, count(*) OVER (PARTITION BY text) AS size FROM documents), o AS (SELECT c, source, count(*) AS own, any_value(size) AS size FROM g WHERE size > 1 GROUP BY c, source HAVING count(*) >= 0.5 * any_value(size)),
t AS (SELECT source, count(*) AS total FROM documents GROUP BY source) SELECT source AS contributor, sum(own)::BIGINT AS rows, count(*) AS clusters, any_value(total) AS total, round(sum(own) / any_value(total), 6) AS of_own FROM o JOIN t USING (source) GROUP BY source HAVING sum(own) >= 2""")
def contributor_flooding(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.col("source").alias("contributor"), F.sha2("text", 256).alias("cluster"))
    many = d.groupBy("cluster").count().where("count > 1").select("cluster")
    totals = d.groupBy("contributor").agg(F.count(F.lit(1)).alias("total"))
    return r6(quality.flooding(d.join(many, "cluster"), totals, 0.5, 2, 0.0), "of_own")


@query("""WITH x AS (SELECT user_id % 20 AS c, event_type AS g, CASE WHEN value > 100 THEN 'error' ELSE 'view' END AS p FROM events), t AS (SELECT c, count(*) AS total FROM x GROUP BY c),
q AS (SELECT c, g || '->' || p AS pair, count(*) AS n FROM x WHERE g <> p GROUP BY ALL), m AS (SELECT c, sum(n) AS flips, first(pair ORDER BY n DESC, pair) AS dominant FROM q GROUP BY c)
SELECT c, flips::BIGINT AS flips, dominant, total, round(flips / total, 6) AS rate, CASE WHEN flips / total > 0.3 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, round(least(2 * flips / total, 1), 6) AS confidence FROM m JOIN t USING (c) WHERE flips / total >= 0.1 AND flips >= 3""")
def contributor_flips(spark, sf):
    e = read(spark, sf, "events").select((F.col("user_id") % 20).alias("c"), F.col("event_type").alias("g"), F.when(F.col("value") > 100, "error").otherwise("view").alias("p"))
    return r6(quality.flips(e, "c", "g", "p"), "rate", "confidence")


@query("SELECT user_id, count(*) AS total, count(*) FILTER (value > 100) AS flagged, round(count(*) FILTER (value > 100)::DOUBLE / count(*), 6) AS rate FROM events GROUP BY user_id HAVING count(*) FILTER (value > 100)::DOUBLE / count(*) > 0.2 AND count(*) FILTER (value > 100) >= 3")
def contributor_concentration(spark, sf):
    return r6(quality.concentration(read(spark, sf, "events"), "user_id", F.col("value") > 100), "rate")


@query("""WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS d FROM embeddings), r AS (SELECT d, avg(v) AS mu, stddev_pop(v) + 1e-6 AS sd FROM x WHERE label = 0 GROUP BY d)
SELECT vec_id, round(sqrt(sum(((v - mu) / sd) ** 2)), 6) AS distance FROM x JOIN r USING (d) GROUP BY vec_id""")
def mahalanobis_diag(spark, sf):
    e = read(spark, sf, "embeddings")
    return r6(quality.diagonal_mahalanobis(e.where("label = 0"), e, "vec_id", "embedding"), "distance")


@query("WITH s AS (SELECT event_type, avg(value) AS mu, stddev_pop(value) AS sd FROM events GROUP BY 1) SELECT event_id, round((value - mu) / (sd + 1e-12), 6) AS z FROM events JOIN s USING (event_type) WHERE abs((value - mu) / (sd + 1e-12)) > 3")
def zscore_outliers(spark, sf):
    return r6(quality.zscore_outliers(read(spark, sf, "events"), "event_type", "value").select("event_id", "z"), "z")


@query("WITH m AS (SELECT lang, quantile_cont(n_chars, 0.5) AS med FROM documents GROUP BY 1), d AS (SELECT doc_id, lang, n_chars, med, abs(n_chars - med) AS dev FROM documents JOIN m USING (lang)), s AS (SELECT lang, quantile_cont(dev, 0.5) AS mad FROM d GROUP BY 1) SELECT doc_id, round((med - n_chars) / (1.4826 * mad), 6) AS score FROM d JOIN s USING (lang) WHERE mad >= 1e-10 AND (med - n_chars) / (1.4826 * mad) > 0.8")
def mad_outliers(spark, sf):
    return r6(quality.mad_outliers(read(spark, sf, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("n_chars")), "lang", "n_chars", 0.8).select("doc_id", "score"), "score")


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM c) SELECT user_id, event_type AS majority FROM r WHERE k = 1")
def majority_class(spark, sf):
    return quality.majority(read(spark, sf, "events"), "user_id", "event_type")


FIND = "CASE WHEN value > 300 THEN 'CRITICAL' WHEN value > 200 THEN 'HIGH' WHEN value > 100 THEN 'MEDIUM' ELSE 'LOW' END"


@query(f"WITH f AS (SELECT {FIND} AS severity, event_id % 10 / 10.0::DOUBLE AS confidence, unnest([event_id, event_id + 1]) AS id FROM events WHERE value > 50), s AS (SELECT event_id AS id, user_id % 20 AS source FROM events), n AS (SELECT source, count(*) AS n FROM s GROUP BY 1), g AS (SELECT source, count(*) AS findings, sum(CASE severity WHEN 'CRITICAL' THEN 10 WHEN 'HIGH' THEN 5 WHEN 'MEDIUM' THEN 2 ELSE 1 END * confidence) AS w FROM f JOIN s USING (id) GROUP BY 1), r AS (SELECT source, n, coalesce(findings, 0) AS findings, coalesce(w, 0) / n AS risk FROM n LEFT JOIN g USING (source)) SELECT source, n, findings, round(risk, 6) AS risk, CASE WHEN risk >= 5 THEN 'CRITICAL' WHEN risk >= 2 THEN 'HIGH' WHEN risk >= 1 THEN 'MEDIUM' WHEN risk > 0 THEN 'LOW' ELSE 'INFO' END AS band FROM r")
def source_risk(spark, sf):
    e = read(spark, sf, "events")
    f = e.where("value > 50").select(F.expr(FIND).alias("severity"), ((F.col("event_id") % 10) / 10.0).alias("confidence"), F.array("event_id", F.col("event_id") + 1).alias("affected"))
    return r6(quality.source_risk(f, e.select(F.col("event_id").alias("sample_id"), (F.col("user_id") % 20).alias("source"))), "risk")


@query(f"WITH f AS (SELECT {FIND} AS s FROM events WHERE value > 50), g AS (SELECT count(*) AS n, max(CASE s WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) AS t, count(*) FILTER (s IN ('CRITICAL', 'HIGH')) AS h FROM f) SELECT n, CASE t WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk, CASE WHEN n = 0 THEN 'REVIEW' WHEN t = 4 OR h >= 3 THEN 'QUARANTINE' WHEN h > 0 THEN 'REVIEW' ELSE 'ACCEPT' END AS disposition FROM g")
def overall_risk(spark, sf):
    return quality.overall_risk(read(spark, sf, "events").where("value > 50").select(F.expr(FIND).alias("severity")))


@query("WITH x AS (SELECT lang, n_chars > 2000 AS f, quality = 0 AS b FROM documents JOIN labels USING (doc_id)), g AS (SELECT lang, count(*) FILTER (f AND b) AS tp, count(*) FILTER (f AND NOT b) AS fp, count(*) FILTER (NOT f AND b) AS fn, count(*) FILTER (NOT f AND NOT b) AS tn FROM x GROUP BY lang) SELECT *, CASE WHEN tp + fn > 0 THEN round(tp::DOUBLE / (tp + fn), 4) END AS tpr, CASE WHEN fp + tn > 0 THEN round(fp::DOUBLE / (fp + tn), 4) END AS fpr, CASE WHEN tp + fp > 0 THEN round(tp::DOUBLE / (tp + fp), 4) END AS precision FROM g")
def item_rates(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(read(spark, sf, "labels"), "doc_id")
    return quality.item_rates(d, ["lang"], F.col("n_chars") > 2000, F.col("quality") == 0)


@query("""WITH g AS (SELECT count(*) FILTER (n_chars > 2000 AND quality = 0) AS tp, count(*) FILTER (n_chars > 2000 AND quality <> 0) AS fp, count(*) FILTER (n_chars <= 2000 AND quality = 0) AS fn, count(*) FILTER (n_chars <= 2000 AND quality <> 0) AS tn, lang = 'en' AS english FROM documents JOIN labels USING (doc_id) GROUP BY english)
SELECT *, CASE WHEN tp + fn > 0 THEN round(tp::DOUBLE / (tp + fn), 4) END AS tpr, CASE WHEN fp + tn > 0 THEN round(fp::DOUBLE / (fp + tn), 4) END AS fpr, CASE WHEN tp + fp > 0 THEN round(tp::DOUBLE / (tp + fp), 4) END AS precision FROM g""")
def pooled_rates(spark, sf):
    return quality.pooled_rates(item_rates(spark, sf).withColumn("english", F.col("lang") == "en"), ["english"])


@query(None)
def label_check(spark, sf):
    return r6(quality.label_check(read(spark, sf, "embeddings"), "vec_id", "label", "embedding"), "confidence")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def pending_rows(spark, sf):
    done = read(spark, sf, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return population.pending(read(spark, sf, "orders").select("o_orderkey"), done, ["o_orderkey"])


# -- drift -------------------------------------------------------------------------------------------------------------


@query("WITH g AS (SELECT event_type, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS sd, avg((abs(value) < 1e-6)::INT) AS sparsity, kurtosis_pop(value) AS kurt FROM events GROUP BY 1) SELECT event_type, g.n, round(g.mean, 6) AS mean, round(g.sd, 6) AS sd, round(sparsity, 6) AS sparsity, round(avg(((value - g.mean) / g.sd) ** 3), 6) AS skew, round(g.kurt, 6) AS kurt FROM events JOIN g USING (event_type) GROUP BY ALL")
def moments(spark, sf):
    return r6(drift.moments(read(spark, sf, "events"), ["event_type"], "value"), "mean", "sd", "sparsity", "skew", "kurt")


DIM = "WITH x AS (SELECT label < 5 AS s, unnest(range(len(embedding)))::INT AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)"
KS = f"""{DIM}, n AS (SELECT dim, count(*) FILTER (s) AS n_a, count(*) FILTER (NOT s) AS n_b FROM x GROUP BY dim), d AS (SELECT dim, x, sum(s::INT) AS a, sum((NOT s)::INT) AS b FROM x GROUP BY dim, x),
c AS (SELECT dim, x, abs(sum(a) OVER w::DOUBLE / n_a - sum(b) OVER w::DOUBLE / n_b) AS gap, coalesce(lead(x) OVER w - x, 0) AS step, n_a, n_b FROM d JOIN n USING (dim) WINDOW w AS (PARTITION BY dim ORDER BY x)),
ks AS (SELECT dim, n_a, n_b, max(gap) AS ks, sum(gap * step) AS wasserstein FROM c GROUP BY ALL)"""


def sides(spark, sf):
    return read(spark, sf, "embeddings").withColumn("side", F.col("label") < 5)


@query(f"{KS} SELECT dim, n_a, n_b, round(ks, 6) AS ks, round(wasserstein, 6) AS wasserstein FROM ks")
def ks_dims(spark, sf):
    return r6(drift.ks_dimensions(sides(spark, sf), "embedding", "side"), "ks", "wasserstein")


@query(f"""{KS}, l AS (SELECT dim, ks, ks * sqrt(n_a::DOUBLE * n_b / (n_a + n_b)) AS l, count(*) OVER () AS m FROM ks),
p AS (SELECT dim, m, CASE WHEN l < 0.2 THEN 1 ELSE least(1, greatest(0, (SELECT sum((CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END) * exp(-2.0::DOUBLE * k * k * l * l)) FROM range(1, 101) t(k)))) END AS p FROM l) SELECT dim, round(p, 6) AS p, p <= 0.05::DOUBLE / m AS drifted FROM p""")
def ks_pvalues(spark, sf):
    return r6(drift.ks_pvalues(drift.ks_dimensions(sides(spark, sf), "embedding", "side")).select("dim", "p", "drifted"), "p")


@query(f"{KS}, r AS (SELECT ks, row_number() OVER (ORDER BY ks DESC, dim) AS k, count(*) OVER () AS n FROM ks) SELECT round(sum(ks) FILTER (k <= greatest(1, floor(n * 0.1))) / sum(ks), 6) AS concentration FROM r")
def dim_concentration(spark, sf):
    return r6(drift.dim_concentration(drift.ks_dimensions(sides(spark, sf), "embedding", "side")), "concentration")


_Q = "[" + ", ".join(repr(i / 100) for i in range(101)) + "]"


@query(f"WITH q AS (SELECT quantile_cont(value, {_Q}) FILTER (event_id % 2 = 0) AS p, quantile_cont(value, {_Q}) FILTER (event_id % 2 = 1) AS o FROM events) SELECT round(list_sum(list_transform(range(1, 102), lambda i: abs(p[i] - o[i]))) / 101, 6) AS w1_grid FROM q")
def wasserstein_grid(spark, sf):
    return r6(drift.wasserstein_grid(read(spark, sf, "events").withColumn("side", F.col("event_id") % 2 == 0), "value", "side"), "w1_grid")


@query(f"{DIM}, g AS (SELECT dim, abs(avg(x) FILTER (s) - avg(x) FILTER (NOT s)) / greatest(sqrt((var_samp(x) FILTER (s) + var_samp(x) FILTER (NOT s)) / 2), 1e-12) AS z FROM x GROUP BY dim) SELECT round(max(z), 6) AS mean_z FROM g")
def mean_z(spark, sf):
    return r6(drift.mean_z(sides(spark, sf), "embedding", "side"), "mean_z")


@query("WITH c AS (SELECT event_type, count(*) FILTER (user_id % 2 = 0) AS a, count(*) FILTER (user_id % 2 = 1) AS b FROM events GROUP BY 1), p AS (SELECT a::DOUBLE / sum(a) OVER () AS p, b::DOUBLE / sum(b) OVER () AS q FROM c) SELECT round(sum((p + 1e-10) * ln((p + 1e-10) / (q + 1e-10))), 6) AS kl, round(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) / 2 + sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 6) AS js_bits FROM p")
def class_divergence(spark, sf):
    return r6(drift.class_divergence(read(spark, sf, "events").withColumn("side", F.col("user_id") % 2 == 0), "event_type", "side"), "kl", "js_bits")


PAIR = """WITH r AS (SELECT vec_id, label < 5 AS s, embedding::DOUBLE[] AS x, row_number() OVER (PARTITION BY label < 5 ORDER BY vec_id) AS k FROM embeddings),
d AS (SELECT a.vec_id AS i, b.vec_id AS j, a.s AS si, b.s AS sj, a.k AS ki, b.k AS kj, list_sum(list_transform(range(1, len(a.x) + 1), lambda i: (a.x[i] - b.x[i]) ** 2)) AS d2 FROM r a JOIN r b ON a.vec_id < b.vec_id)"""


@query(PAIR + """, h AS (SELECT median(sqrt(d2)) AS sigma FROM d WHERE ki <= 100 AND kj <= 100 AND d2 > 0), k AS (SELECT i, j, si, sj, exp(-d2 / (2 * sigma * sigma)) AS k FROM d, h),
share AS (SELECT avg(s::INT) AS share FROM r), deal AS (SELECT vec_id, round_, ('0x' || substr(md5('0/' || round_ || '/' || vec_id), 1, 12))::BIGINT / 281474976710656.0::DOUBLE < share AS s FROM r, share, (SELECT unnest(range(1, 101)) AS round_)
UNION ALL SELECT vec_id, 0, s FROM r), n AS (SELECT round_, count(*) FILTER (s)::DOUBLE AS nt, count(*) FILTER (NOT s)::DOUBLE AS nf FROM deal GROUP BY 1),
m AS (SELECT a.round_ AS round_, 2 * sum(k) FILTER (a.s AND b.s) / (nt * (nt - 1)) + 2 * sum(k) FILTER (NOT a.s AND NOT b.s) / (nf * (nf - 1)) - 2 * sum(k) FILTER (a.s <> b.s) / (nt * nf) AS m
  FROM k JOIN deal a ON a.vec_id = i JOIN deal b ON b.vec_id = j AND a.round_ = b.round_ JOIN n ON n.round_ = a.round_ GROUP BY a.round_, nt, nf)
SELECT round(any_value(o), 6) AS mmd2, round((count(*) FILTER (m >= o) - 1) / 100.0::DOUBLE, 6) AS p FROM m, (SELECT m AS o FROM m WHERE round_ = 0)""")
def mmd2(spark, sf):
    return r6(drift.mmd2(sides(spark, sf), "vec_id", "embedding", "side"), "mmd2", "p")


@query(PAIR + ", n AS (SELECT count(*) FILTER (s)::DOUBLE AS na, count(*) FILTER (NOT s)::DOUBLE AS nb FROM r) SELECT round(2 * sum(sqrt(d2)) FILTER (si <> sj) / (na * nb) - 2 * sum(sqrt(d2)) FILTER (si AND sj) / (na * na) - 2 * sum(sqrt(d2)) FILTER (NOT si AND NOT sj) / (nb * nb), 6) AS energy FROM d, n GROUP BY na, nb")
def energy_distance(spark, sf):
    return r6(drift.energy_distance(sides(spark, sf), "vec_id", "embedding", "side"), "energy")


@query("""WITH t AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings ORDER BY label DESC, vec_id LIMIT 25), u AS (SELECT unnest(range(len(x))) AS d, unnest(list_transform(x, lambda v: v / sqrt(list_dot_product(x, x)))) AS v FROM t), g AS (SELECT d, sum(v) AS s FROM u GROUP BY d) SELECT round((sum(s * s) - 25) / (25 * 24.0::DOUBLE), 6) AS coherence FROM g""")
def direction_coherence(spark, sf):
    return r6(drift.direction_coherence(read(spark, sf, "embeddings"), "vec_id", "embedding", "label", 25), "coherence")


@query("WITH b AS (SELECT user_id % 40 AS b, abs(avg(value) - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events) AS x FROM events GROUP BY 1), r AS (SELECT x, row_number() OVER (ORDER BY x) AS k, count(*) OVER () AS m FROM b) SELECT any_value(m) AS m, coalesce(round(CASE WHEN max(x) FILTER (k = ceil((m + 1) * 0.95)) IS NOT NULL THEN greatest(max(x) FILTER (k = ceil((m + 1) * 0.95)), 0.01) END, 6), 'infinity'::DOUBLE) AS floor FROM r")
def effect_floor(spark, sf):
    e = read(spark, sf, "events")
    a = e.agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))
    b = e.groupBy((F.col("user_id") % 40).alias("b")).agg(F.avg("value").alias("x")).join(F.broadcast(a)).select((F.abs(F.col("x") - F.col("mu")) / F.col("sd")).alias("x"))  # a: one row
    return r6(drift.effect_floor(b, "x", 0.05, 0.01), "floor")


@query("WITH v AS (SELECT user_id, count(*) FILTER (value > 100 AND event_type <> 'error') AS shape, count(*) FILTER (value > 100 AND event_type = 'error') AS \"natural\" FROM events GROUP BY 1) SELECT user_id AS case_id, shape, \"natural\", CASE WHEN shape >= 2 THEN 'suspicious' WHEN \"natural\" > 0 AND shape = 0 THEN 'natural' ELSE 'undetermined' END AS verdict FROM v")
def arbiter(spark, sf):
    e = read(spark, sf, "events").select(F.col("user_id").alias("case_id"), F.when(F.col("event_type") == "error", "natural_direction").otherwise(F.col("event_type")).alias("vote"), (F.col("value") > 100).alias("fired"))
    return drift.arbitrate(e)


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x, label < 5 AS s FROM embeddings), share AS (SELECT avg(s::INT) AS share FROM v),
deal AS (SELECT vec_id, round_, ('0x' || substr(md5('0/' || round_ || '/' || vec_id), 1, 12))::BIGINT / 281474976710656.0::DOUBLE < share AS s FROM v, share, (SELECT unnest(range(1, 201)) AS round_) UNION ALL SELECT vec_id, 0, s FROM v),
x AS (SELECT vec_id, unnest(x) AS x, unnest(range(len(x))) AS dim FROM v), g AS (SELECT round_, dim, avg(x) FILTER (s) - avg(x) FILTER (NOT s) AS e FROM x JOIN deal USING (vec_id) GROUP BY 1, 2), d AS (SELECT round_, sqrt(sum(e * e)) AS d FROM g GROUP BY 1)
SELECT round(any_value(o), 6) AS observed, round(count(*) FILTER (d >= o) / 201.0::DOUBLE, 6) AS p FROM d, (SELECT d AS o FROM d WHERE round_ = 0)""")
def permutation_p(spark, sf):
    return r6(drift.permutation_p(sides(spark, sf), "vec_id", "embedding", "side"), "observed", "p")


# -- decisions ---------------------------------------------------------------------------------------------------------

RATES = "WITH r AS (SELECT lang, count(*) FILTER (n_chars > 2000 AND quality = 0)::DOUBLE / count(*) FILTER (quality = 0) AS tpr, count(*) FILTER (n_chars > 2000 AND quality = 1)::DOUBLE / count(*) FILTER (quality = 1) AS fpr FROM documents JOIN labels USING (doc_id) GROUP BY lang HAVING count(*) FILTER (quality = 0) > 0)"


@query(f"{RATES} SELECT lang, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, CASE WHEN tpr * 0.1 + fpr * 0.9 > 0 THEN round(tpr * 0.1 / (tpr * 0.1 + fpr * 0.9), 6) END AS ppv, round((1 - tpr) * 0.1 / ((1 - tpr) * 0.1 + (1 - fpr) * 0.9), 6) AS missed, round((1 - tpr) * 0.1 * 25 + fpr * 0.9 * 5, 6) AS loss, round(fpr * 5 / (tpr * 25 + fpr * 5), 6) AS break_even FROM r")
def policy_loss(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(read(spark, sf, "labels"), "doc_id")
    f, b = F.col("n_chars") > 2000, F.col("quality") == 0
    r = d.groupBy("lang").agg((F.count_if(f & b).cast("double") / F.nullif(F.count_if(b), F.lit(0))).alias("tpr"), (F.count_if(f & ~b).cast("double") / F.nullif(F.count_if(~b), F.lit(0))).alias("fpr")).where("tpr is not null")
    return r6(decisions.policy_loss(r, 0.1), "tpr", "fpr", "ppv", "missed", "loss", "break_even")


LFDR = f"{PV}, b AS (SELECT event_id, is_positive, p, least(floor(p * 20), 19)::INT AS bin FROM p), q AS (SELECT event_id, is_positive, 1 - least(1, greatest(0, least(1, (SELECT count(*) FROM p WHERE p > 0.5) / ((SELECT count(*) FROM p) * 0.5)) / (count(*) OVER (PARTITION BY bin)::DOUBLE / (SELECT count(*) FROM p) * 20))) AS q FROM b)"


@query(f"{LFDR} SELECT event_id, round(q, 6) AS q FROM q")
def item_lfdr(spark, sf):
    return r6(decisions.item_posteriors(pvalues(spark, sf).select("event_id", "p")).select("event_id", "q"), "q")


QUEUE = f"{LFDR}, e2 AS (SELECT event_id, is_positive, q, least(q * 25, (1 - q) * 5) - 1 AS v, least(q * 25, (1 - q) * 5, 1) AS best FROM q), rq AS (SELECT *, row_number() OVER (ORDER BY v DESC, event_id) - 1 AS rank FROM e2)"


@query(f"{QUEUE} SELECT event_id, round(v, 6) AS review_value, CASE WHEN 1 <= best THEN 'REVIEW' WHEN (1 - q) * 5 <= best THEN 'QUARANTINE' ELSE 'ACCEPT' END AS disposition, rank FROM rq")
def review_queue(spark, sf):
    q = decisions.item_posteriors(pvalues(spark, sf).select("event_id", "is_positive", "p"))
    return r6(decisions.review_queue(q, "event_id").select("event_id", "review_value", "disposition", "rank"), "review_value")


@query(f"{QUEUE} SELECT b AS budget, count(*) FILTER (rank < b AND is_positive)::BIGINT AS caught FROM rq, (SELECT unnest([10, 50, 100, 500])::BIGINT AS b) GROUP BY b")
def catch_curve(spark, sf):
    q = decisions.item_posteriors(pvalues(spark, sf).select("event_id", "is_positive", "p"))
    return decisions.catch_curve(decisions.review_queue(q, "event_id"), "is_positive", [10, 50, 100, 500])


@query(f"{QUEUE}, caught AS (SELECT rank, sum(is_positive::INT) OVER (ORDER BY rank) AS c, sum(is_positive::INT) OVER () AS t FROM rq) SELECT max(t)::BIGINT AS n_bad, min(rank + 1) FILTER (c >= 0.9 * t) AS budget FROM caught")
def catch_budget(spark, sf):
    q = decisions.item_posteriors(pvalues(spark, sf).select("event_id", "is_positive", "p"))
    return decisions.budget_for_fraction(decisions.review_queue(q, "event_id"), "is_positive")


@query("SELECT count(*) FILTER (value > 100) AS budget, count(*) FILTER (value > 100 AND event_type = 'error') AS caught, count(*) FILTER (event_type = 'error') AS n_bad, round(count(*) FILTER (value > 100 AND event_type = 'error')::DOUBLE / count(*) FILTER (event_type = 'error'), 6) AS caught_share FROM events")
def flag_all(spark, sf):
    return r6(decisions.flag_all(read(spark, sf, "events"), F.col("value") > 100, F.col("event_type") == "error"), "caught_share")


@query("WITH m AS (SELECT user_id % 10 AS module, min(value) FILTER (value > 20) AS r FROM events GROUP BY 1) SELECT round(max(r) / 10000, 6) AS r_star, count(*) FILTER (r IS NULL) > 0 AS unbounded, max(r) / 10000 <= 0.02 AS accept_permitted FROM m")
def residual_risk(spark, sf):
    m = read(spark, sf, "events").groupBy((F.col("user_id") % 10).alias("module")).agg((F.min(F.when(F.col("value") > 20, F.col("value"))) / 10000).alias("r_star"))
    return r6(decisions.residual_risk(m, 1000, 3).select("r_star", "unbounded", "accept_permitted"), "r_star")


@query("""WITH l AS (SELECT l_orderkey, unnest(['qty', 'price']) AS signal, unnest([max(l_quantity)::DOUBLE, max(l_extendedprice)::DOUBLE]) AS s FROM lineitem GROUP BY l_orderkey),
w AS (SELECT *, sum((l_orderkey % 2)::INT) OVER (PARTITION BY signal ORDER BY s DESC) AS ge, sum((l_orderkey % 2)::INT) OVER (PARTITION BY signal) AS n FROM l), p AS (SELECT l_orderkey, count(*) AS m, min((1.0::DOUBLE + ge) / (1 + n)) AS p, min(n)::BIGINT AS n_cal FROM w GROUP BY 1)
SELECT l_orderkey, m, n_cal, round(least(1, m * p), 6) AS p, CASE WHEN n_cal < ceil(m / 0.05) - 1 THEN 'ABSTAIN' WHEN least(1, m * p) <= 0.05 THEN 'FLAG' ELSE 'CLEAR' END AS decision FROM p""")
def asset_rule(spark, sf):
    x = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_quantity").cast("double").alias("q"), F.max("l_extendedprice").cast("double").alias("e")).select("l_orderkey", F.expr("stack(2, 'qty', q, 'price', e) as (signal, score)")).withColumn("clean", F.col("l_orderkey") % 2 == 1)
    return r6(decisions.asset_rule(x, "l_orderkey", "signal", "score", "clean"), "p")


@query("""WITH g AS (SELECT source, count(*) AS n, count(*) FILTER (n_chars < 200) AS k FROM documents GROUP BY source), x AS (SELECT (i + 0.5::DOUBLE) / 200 AS x FROM range(200) t(i)),
l AS (SELECT source, n, k, x, (k + 1) * ln(x) + (n - k + 19) * ln(1 - x) AS l FROM g, x), m AS (SELECT *, exp(l - max(l) OVER (PARTITION BY source)) AS d FROM l)
SELECT source, n, k, round(sum(d) FILTER (x > 0.05) / sum(d), 6) AS posterior FROM m GROUP BY ALL""")
def contributor_posterior(spark, sf):
    return r6(decisions.contributor_posterior(read(spark, sf, "documents").select("source", "doc_id", "n_chars"), "source", F.col("n_chars") < 200), "posterior")


# -- chains and monitor --------------------------------------------------------------------------------------------------


def chain(spark, sf):
    c = read(spark, sf, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    body = F.concat_ws("|", F.col("turn").cast("string"), "role", "text")
    return c, body


@query("""WITH RECURSIVE c AS (SELECT conv_id, turn::BIGINT AS turn, turn::VARCHAR || '|' || role || '|' || text AS p FROM conversations), h AS (SELECT conv_id, turn, 'GENESIS' AS prev_hash, sha256('GENESIS|' || p) AS entry_hash FROM c WHERE turn = 0
UNION ALL SELECT c.conv_id, c.turn, h.entry_hash, sha256(h.entry_hash || '|' || c.p) FROM h JOIN c ON c.conv_id = h.conv_id AND c.turn = h.turn + 1) SELECT * FROM h""")
def chain_link(spark, sf):
    c, body = chain(spark, sf)
    return chains.link(c, "conv_id", "turn", body)


@query("SELECT conv_id, count(*) AS n, CASE WHEN conv_id % 3 = 0 AND count(*) > 1 THEN 1::BIGINT END AS first_break FROM conversations GROUP BY conv_id")
def chain_verify(spark, sf):
    c, body = chain(spark, sf)
    edited = F.when((F.col("conv_id") % 3 == 0) & (F.col("turn") == 1), F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    linked = c.join(chains.link(c, "conv_id", "turn", body), ["conv_id", "turn"]).withColumn("text", edited)
    return chains.chain_status(linked, "conv_id", "turn", body)


_L = "WITH l0 AS MATERIALIZED (SELECT p_partkey - (SELECT min(p_partkey) FROM part) AS pos, sha256(p_name) AS h, 0 AS depth FROM part)"
for _i in range(1, 25):
    _L += f", l{_i} AS MATERIALIZED (SELECT pos // 2 AS pos, CASE WHEN (SELECT count(*) FROM l{_i - 1}) > 1 THEN sha256(min_by(h, pos) || max_by(h, pos)) ELSE max(h) END AS h, max(depth) + ((SELECT count(*) FROM l{_i - 1}) > 1)::INT AS depth FROM l{_i - 1} GROUP BY 1)"


@query(_L + " SELECT depth, h AS root FROM l24")
def merkle_root(spark, sf):
    p = read(spark, sf, "part")
    low = p.agg(F.min("p_partkey")).first()[0]
    return chains.merkle_root(p.select((F.col("p_partkey") - low).alias("pos"), "p_name"), "pos", "p_name")


@query("WITH s AS (SELECT user_id AS key, event_id AS arrived, (value * 10)::BIGINT AS seq, 'n' || (event_id % 5000) AS nonce FROM (SELECT event_id, user_id, floor(value) AS value FROM events)), r AS (SELECT *, row_number() OVER (PARTITION BY nonce ORDER BY arrived) AS k, max(seq) OVER (PARTITION BY key ORDER BY arrived ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM s) SELECT key, CASE WHEN k > 1 THEN 'replayed_nonce' ELSE 'stale_sequence' END AS problem, count(*) AS n FROM r WHERE k > 1 OR seq <= h GROUP BY ALL")
def replay_detect(spark, sf):
    s = read(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("arrived"), (F.floor("value") * 10).alias("seq"), F.concat(F.lit("n"), (F.col("event_id") % 5000).cast("string")).alias("nonce"))
    return chains.replays(s, "key", "seq", "nonce").groupBy("key", "problem").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, o_orderkey, o_orderkey < max(o_orderkey) OVER (PARTITION BY o_custkey) AS superseded FROM orders")
def artefact_supersession(spark, sf):
    return chains.latest(read(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("""WITH h AS (SELECT sha256(text) AS h, count(*) AS c FROM documents WHERE trim(text, ' ') <> '' GROUP BY 1), a AS (SELECT h[:6] AS k, sha256(string_agg(h || ':' || c, ';' ORDER BY h)) AS d, sum(c) AS n FROM h GROUP BY 1),
b AS (SELECT k[:3] AS k, sha256(string_agg(k || ':' || d, ';' ORDER BY k)) AS d, sum(n) AS n FROM a GROUP BY 1) SELECT sum(n)::BIGINT AS n, sha256(string_agg(k || ':' || d, ';' ORDER BY k)) AS digest FROM b""")
def snapshot_digest(spark, sf):
    return chains.snapshot(read(spark, sf, "documents"), "text")


@query("""WITH s AS (SELECT k AS kind, row_number() OVER (PARTITION BY k ORDER BY p_partkey) - 1 AS pos, p_size + (k = 'attack')::INT * 15 AS v FROM part, (SELECT unnest(['clean', 'attack']) AS k)), n AS (SELECT kind, count(*) AS n FROM s GROUP BY 1),
d AS (SELECT kind, a.s AS s, b.t AS t, ('0x' || substr(md5('/' || kind || '/' || a.s || '/' || b.t), 1, 8))::BIGINT % n AS pos FROM n, range(200) a(s), range(80) b(t)), x AS (SELECT kind, s, t + 1 AS t, (v > 45)::INT AS hit FROM d JOIN s USING (kind, pos)),
r AS (SELECT kind, s, t, sum(hit) OVER w AS k, sum(ln(1 + 0.5 * (hit - 0.1))) OVER w AS l FROM x WINDOW w AS (PARTITION BY kind, s ORDER BY t)), g AS (SELECT kind, s, max(l) >= ln(1 / 0.045) AS a, max((k > 0.1 * t + 1.645 * sqrt(0.1 * 0.9 * t))::INT) AS f FROM r GROUP BY 1, 2)
SELECT kind, count(*) AS streams, round(avg(a::INT), 6) AS monitor_alarms, round(avg(f), 6) AS repeated_alarms FROM g GROUP BY kind""")
def monitor_simulation(spark, sf):
    # part keys run from the least without gaps
    p = read(spark, sf, "part")
    pos = F.col("p_partkey") - p.agg(F.min("p_partkey")).first()[0]
    both = F.explode(F.array(F.struct(F.lit("clean").alias("kind"), F.col("p_size").alias("v")), F.struct(F.lit("attack").alias("kind"), (F.col("p_size") + 15).alias("v"))))
    s = p.select(pos.cast("long").alias("pos"), both.alias("x")).select("pos", "x.*")
    return r6(monitor.simulate(s, "kind", "pos", "v", 45.0, 0.1), "monitor_alarms", "repeated_alarms")


@query("""WITH x AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, sum(ln(1 + 0.5 * ((value > 100)::INT - 0.1))) OVER (PARTITION BY user_id ORDER BY event_id) AS l FROM events)
SELECT user_id, count(*) AS steps, round(max_by(l, i), 6) AS log_wealth, round(greatest(max(l), 0), 6) AS high_water, min(i) FILTER (l >= ln(1 / 0.045))::INT AS alarm_at, false AS refused FROM x GROUP BY user_id""")
def eprocess_batch(spark, sf):
    e = monitor.eprocess(read(spark, sf, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value", 100.0, 0.1)
    return r6(e, "log_wealth", "high_water")


@query("""WITH x AS (SELECT user_id % 20 AS c, event_type AS "given", CASE WHEN value > 100 THEN 'error' ELSE 'view' END AS suggested, 1 / (1 + abs(value)) AS p FROM events), g AS (SELECT c, "given", suggested, count(*) AS n, min(p) AS min_p FROM x WHERE "given" <> suggested GROUP BY c, "given", suggested ORDER BY min(p), c, "given", suggested LIMIT 20)
SELECT c, "given", suggested, n, round(min_p, 6) AS min_p FROM g""")
def label_patterns(spark, sf):
    e = read(spark, sf, "events").select((F.col("user_id") % 20).alias("c"), F.col("event_type").alias("given"), F.when(F.col("value") > 100, "error").otherwise("view").alias("suggested"), (1 / (1 + F.abs("value"))).alias("p"))
    return r6(assets.label_patterns(e, "c", "given", "suggested", "p"), "min_p")


@query("""WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS d FROM embeddings), r AS (SELECT d, avg(v) AS mu, stddev_pop(v) AS sd FROM x WHERE label = 0 GROUP BY d)
SELECT vec_id, round(max(abs(v - mu) / sd), 6) AS score, 0::BIGINT AS dead_moved FROM x JOIN r USING (d) GROUP BY vec_id""")
def standardised_deviation(spark, sf):
    e = read(spark, sf, "embeddings")
    return r6(assets.standardised(e.where("label = 0"), e, "vec_id", "embedding").select("vec_id", "score", "dead_moved"), "score")


@query("WITH g AS (SELECT lang, count(*) AS n, avg(((n_chars > 2000)::INT = quality)::INT) AS a FROM documents JOIN labels USING (doc_id) GROUP BY lang) SELECT lang, n, round(a, 6) AS agreement, CASE WHEN a < 0.5 THEN 'CRITICAL' WHEN a < 0.8 THEN 'HIGH' WHEN a < 1 THEN 'MEDIUM' ELSE 'INFO' END AS severity FROM g")
def fingerprint_agreement(spark, sf):
    a = read(spark, sf, "documents").select("doc_id", "lang", (F.col("n_chars") > 2000).cast("int").alias("y"))
    return r6(assets.agreement(a, read(spark, sf, "labels").select("doc_id", F.col("quality").cast("int").alias("y")), "doc_id", "y", "lang"), "agreement")


CEN = """WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS d FROM embeddings), c AS (SELECT label AS y, d, quantile_cont(v, 0.5) AS m FROM x GROUP BY ALL)"""


@query(f"{CEN} SELECT y AS label, round(sum(m), 6) AS total, round(max(m), 6) AS largest FROM c GROUP BY y")
def class_medians(spark, sf):
    c = assets.centroids(read(spark, sf, "embeddings"), "label", "embedding")
    return r6(c.select("label", F.aggregate("centroid", F.lit(0.0), lambda s, v: s + v).alias("total"), F.array_max("centroid").alias("largest")), "total", "largest")


@query(f"""{CEN}, dist AS (SELECT vec_id, label, y, sum((v - m) ** 2) AS s FROM x JOIN c USING (d) GROUP BY ALL), near AS (SELECT vec_id, label, min_by(y, s) AS y FROM dist GROUP BY ALL),
g AS (SELECT vec_id % 40 AS asset, count(*) AS n, count(*) FILTER (y <> label) AS mismatches FROM near GROUP BY 1)
SELECT asset, n, mismatches, round((1.0::DOUBLE + (SELECT count(*) FROM g AS k WHERE k.asset < 30 AND k.mismatches >= g.mismatches)) / (1 + (SELECT count(*) FROM g WHERE asset < 30)), 6) AS p FROM g""")
def label_gate(spark, sf):
    e = read(spark, sf, "embeddings").withColumn("asset", F.col("vec_id") % 40)
    return r6(assets.label_gate(e, e, "asset", "label", "embedding", F.col("asset") < 30), "p")


@query("WITH g AS (SELECT avg(((n_chars > 2000)::INT = quality)::INT) FILTER (lang = 'en') AS reference, avg(((n_chars > 2000)::INT = quality)::INT) FILTER (lang <> 'en') AS operational FROM documents JOIN labels USING (doc_id)) SELECT round(reference, 6) AS reference, round(operational, 6) AS operational, round(reference - operational, 6) AS \"drop\", reference - operational > 0.1 AS concept_drift FROM g")
def concept_drift(spark, sf):
    x = read(spark, sf, "documents").join(read(spark, sf, "labels").select("doc_id", F.col("quality").cast("int").alias("y")), "doc_id").withColumn("p", (F.col("n_chars") > 2000).cast("int"))
    return r6(assets.concept_drift(x, F.col("lang") != "en", "p", "y"), "reference", "operational", "drop")


def boxes(spark, sf, moved: bool) -> DataFrame:
    """A box a line item, an image an order; moved by the discount and the tax."""
    x = F.col("l_quantity").cast("double") + (F.col("l_discount").cast("double") * 100 if moved else 0.0)
    y = F.col("l_extendedprice").cast("double") / 1000 + (F.col("l_tax").cast("double") * 100 if moved else 0.0)
    return read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_returnflag").alias("class_id"), F.concat_ws("/", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("box"), x.alias("x1"), y.alias("y1"), (x + 20.0).alias("x2"), (y + 20.0).alias("y2"))


@query("""WITH a AS MATERIALIZED (SELECT l_orderkey AS i, row_number() OVER () AS k, l_returnflag AS c, l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE / 1000 AS y FROM lineitem), b AS (SELECT l_orderkey AS i, l_returnflag AS c, l_quantity::DOUBLE + l_discount::DOUBLE * 100 AS x, l_extendedprice::DOUBLE / 1000 + l_tax::DOUBLE * 100 AS y FROM lineitem),
w AS (SELECT a.i, a.k, greatest(0, least(a.x, b.x) + 20 - greatest(a.x, b.x)) * greatest(0, least(a.y, b.y) + 20 - greatest(a.y, b.y)) AS o FROM a JOIN b USING (i, c)), h AS (SELECT DISTINCT i, k FROM w WHERE o / (800 - o) >= 0.5)
SELECT a.i AS image_id, count(*) AS n, count(*) FILTER (h.k IS NULL) AS unmatched, round(count(*) FILTER (h.k IS NULL)::DOUBLE / count(*), 6) AS divergence FROM a LEFT JOIN h ON a.i = h.i AND a.k = h.k GROUP BY a.i""")
def reference_divergence(spark, sf):
    return r6(assets.unmatched(boxes(spark, sf, False), boxes(spark, sf, True)), "divergence")


@query(None)
def paired_fingerprint(spark, sf):
    scored = lambda moved: boxes(spark, sf, moved).withColumn("score", F.col("x1") / 100)
    return r6(assets.paired_fingerprint(scored(False), scored(True)), "mean_iou", "score_gap", "jaccard")


@query(None)
def detection_quality(spark, sf):
    return r6(assets.detection_quality(boxes(spark, sf, False), boxes(spark, sf, True)), "precision", "recall", "f1", "mean_iou")


@query(f"""{LED}, w AS (SELECT *, count(*) FILTER (split = 'calibration' AND NOT is_positive) OVER (PARTITION BY corpus, kind ORDER BY score DESC) AS ge, count(*) FILTER (split = 'calibration' AND NOT is_positive) OVER (PARTITION BY corpus, kind) AS n FROM e)
SELECT event_id, CASE WHEN n >= 19 THEN 'ok' ELSE 'refused' END AS status, CASE WHEN n >= 19 THEN round((1.0::DOUBLE + ge) / (1 + n), 6) END AS p FROM w""")
def conditional_pvalues(spark, sf):
    e = events(spark, sf).withColumn("is_cal", (F.col("split") == "calibration") & ~F.col("is_positive"))
    return r6(ranks.conditional_pvalues(e, ("corpus", "kind")).select("event_id", "status", "p"), "p")


@query(f"""{BHQ}, f AS (SELECT qq.p, q <= 0.05 AS bh, h, is_positive AS y FROM qq JOIN p USING (event_id)) SELECT count(*) AS n, count(*) FILTER (bh) AS flagged, round(count(*) FILTER (bh AND NOT y)::DOUBLE / nullif(count(*) FILTER (bh), 0), 6) AS fdr, round(count(*) FILTER (bh AND y)::DOUBLE / nullif(count(*) FILTER (y), 0), 6) AS power,
 round(min(p), 6) AS min_p, round(0.05 / (count(*) * max(h)), 6) AS strictest, min(p) <= 0.05 / (count(*) * max(h)) AS can_flag FROM f""")
def mixed_batch_fdr(spark, sf):
    return r6(ranks.mixed_batch(pvalues(spark, sf).select("p", "is_positive"), "p", "is_positive"), "fdr", "power", "min_p", "strictest")


@query("""WITH w AS (SELECT event_type, user_id, max(-ln(greatest(1 / (1 + abs(value)), 1e-12))) AS nll FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY nll DESC, user_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM w)
SELECT event_type, count(*) AS n_images, round(max(nll), 6) AS worst, round(avg(nll) FILTER (k <= greatest(ceil(n * 0.1::DOUBLE), 1)), 6) AS top_mean FROM r GROUP BY event_type""")
def label_nll(spark, sf):
    e = read(spark, sf, "events").withColumn("p", 1 / (1 + F.abs("value")))
    return r6(assets.label_nll(e, "event_type", "user_id", "p"), "worst", "top_mean")


@query("""WITH g AS (SELECT user_id % 20 AS kind, count(*) FILTER (event_type = 'error') AS n_attacked, count(*) FILTER (event_type <> 'error') AS n_null, avg((value > 50)::INT) FILTER (event_type = 'error') - avg((value > 50)::INT) FILTER (event_type <> 'error') AS d FROM events GROUP BY 1)
SELECT kind, n_attacked, n_null, CASE WHEN least(n_attacked, n_null) >= 20 THEN round(greatest(d, 0), 6) END AS net, CASE WHEN least(n_attacked, n_null) < 20 THEN 'unassessable' WHEN d >= 0.5 THEN 'implanted' ELSE 'weak' END AS status FROM g""")
def attack_success(spark, sf):
    e = read(spark, sf, "events").withColumn("kind", F.col("user_id") % 20)
    return r6(assets.attack_success(e, "kind", F.col("event_type") == "error", F.col("value") > 50), "net")


@query("SELECT user_id, count(value) AS n, round(avg(value), 6) AS mean, round(CASE WHEN count(value) > 1 THEN stddev_samp(value) END, 6) AS sd, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75, round(1.0::DOUBLE / (count(value) + 1), 6) AS floor, 1.0::DOUBLE / (count(value) + 1) <= 0.05 AS can_reject FROM events GROUP BY user_id")
def exchangeability(spark, sf):
    return r6(assets.exchangeability(read(spark, sf, "events"), "user_id", "value"), "mean", "sd", "q25", "q50", "q75", "floor")


@query("SELECT user_id, count(*) AS n, count(value) AS n_finite, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.95), 6) AS q95, round(max(value), 6) AS max FROM events GROUP BY user_id")
def score_summary(spark, sf):
    return r6(assets.score_summary(read(spark, sf, "events"), "user_id", "value"), "mean", "q95", "max")


@query("SELECT lang, count(*) FILTER (toxic = 0) AS n, count(*) FILTER (toxic = 1) AS n_gated, round(avg(n_chars) FILTER (toxic = 0), 6) AS mean, round(stddev_pop(n_chars) FILTER (toxic = 0), 6) AS sd FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def kind_summary(spark, sf):
    return r6(assets.kind_summary(read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id"), "lang", "n_chars", F.col("toxic") == 1), "mean", "sd")


@query("WITH x AS (SELECT l_orderkey, l_linenumber, floor(l_quantity::DOUBLE / 0.5 + 0.5)::BIGINT || ',' || floor(l_extendedprice::DOUBLE / 0.5 + 0.5)::BIGINT AS c FROM lineitem) SELECT l_orderkey, sha256(string_agg(c, ';' ORDER BY l_linenumber, c)) AS digest FROM x GROUP BY l_orderkey")
def output_digest(spark, sf):
    return assets.output_digest(read(spark, sf, "lineitem"), "l_orderkey", ["l_linenumber"], ["l_quantity", "l_extendedprice"], 0.5)


@query(None)
def spectral_outliers(spark, sf):
    return r6(spectral.spectral_outliers(read(spark, sf, "embeddings"), "vec_id", "label", "embedding"), "z")


@query(None)
def ood_flags(spark, sf):
    e = read(spark, sf, "embeddings")
    return r6(spectral.ood_flags(e.where("label < 5"), e, "vec_id", "embedding"), "distance")


@query(None)
def contributor_concentration_p(spark, sf):
    return r6(spectral.concentration_test(read(spark, sf, "events").withColumn("c", F.col("user_id") % 20), "c", F.col("value") > 100), "max_rate", "p")
from . import report_queries  # noqa: E402,F401
