"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Labelled good documents are the holdout.  In each stratum the rules are tightened along one fixed path: rule by rule, each
from its loosest cutoff to its strictest, those before it staying at their strictest.  At every step an exact binomial test
must reject "the rules so far turn away ``limit`` or more of the good documents"; the first step that fails ends the path
(fixed-sequence testing, so a path costs one test's level), and levels are ``delta`` over the number of strata (Bonferroni).
With confidence ``1 - delta`` no stratum loses more than its limit of good documents to the rules.

A stratum's limit is the least of ``limits`` that its number of good documents can certify at all; strata with too few for
any are pooled into one, whose limit holds for them together.  At the defaults (level 0.01) that takes 459, 228 or 90 good
documents for 1, 2 or 5 %; where even the pool has fewer, only the base rules act.  Only rules that catch ``useful`` of the
labelled poor documents at their strictest cutoff are on the path: poor documents say nothing about good ones, so this
choice costs no level.  Strata are a stated list and "other", so thresholds are a table of bounded size.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store

SPACE = r"[\x20\x09-\x0D]+"
STRATA = ("en", "fr", "de", "es")
#: rule -> per-mille value; a document fails above the cutoff; in the order of the path
RULES = {
    "symbols": "1000 * n_symbols div greatest(word_chars, 1)",
    "repeats": "1000 * n_repeat_words div greatest(n_words, 1)",
    "dup_lines": "1000 * n_dup_lines div greatest(n_lines, 1)",
}
GRID = (10, 20, 30, 50, 75, 100, 150, 200, 300, 400)
LIMITS = (0.01, 0.02, 0.05)
PACK = 24


def _neighbours(col: str, bits: int) -> str:
    """Members of the sorted array col that share all but their low bits with a neighbour."""
    top = lambda x: f"shiftright({x}, {bits})"
    return f"filter({col}, (x, j) -> coalesce({top('x')} = {top(f'get({col}, j - 1)')}, false) or coalesce({top('x')} = {top(f'get({col}, j + 1)')}, false))"


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """A struct ``row`` of docs' columns and a struct ``q`` of n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed.

    Windows of five words are compared by 64-bit hashes: sorted beside their positions by the upper 40 bits, then, among
    those that agree, by the lower 40.  Texts of 2^24 words or more sort (hash, position) pairs.
    """
    mask = (1 << PACK) - 1
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    df = df.withColumn("t", F.coalesce(F.col("row")[text].cast("string"), F.lit("")))
    df = df.withColumn("w", F.array_remove(F.split("t", SPACE), ""))
    df = df.withColumn("l", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("h", F.transform("w", lambda w: F.xxhash64(w)))
    df = df.withColumn(
        "g",
        F.when(F.size("h") >= 5, F.expr("transform(sequence(0, size(h) - 5), i -> xxhash64(get(h, i), get(h, i + 1), get(h, i + 2), get(h, i + 3), get(h, i + 4)))")).otherwise(F.expr("cast(array() as array<bigint>)")),
    )
    df = df.withColumn("s", F.expr(f"case when size(g) <= {mask} then sort_array(transform(g, (x, i) -> shiftleft(shiftright(x, {PACK}), {PACK}) | cast(i as bigint))) end"))
    df = df.withColumn("c", F.expr(f"sort_array(transform({_neighbours('s', PACK)}, x -> shiftleft(get(g, cast(x & {mask} as int)), {PACK}) | (x & {mask})))"))
    df = df.withColumn("p", F.expr(f"sort_array(transform({_neighbours('c', PACK)}, x -> x & {mask}))"))
    df = df.withColumn("z", F.expr(f"case when size(g) > {mask} then sort_array(transform(g, (x, i) -> struct(x as g, cast(i as bigint) as i))) end"))
    df = df.withColumn("p", F.coalesce("p", F.expr("sort_array(transform(filter(z, (x, j) -> coalesce(x.g = get(z, j - 1).g, false) or coalesce(x.g = get(z, j + 1).g, false)), x -> x.i))")))
    df = df.withColumn("r", F.expr("aggregate(transform(p, (x, j) -> least(5L, coalesce(get(p, j + 1) - x, 5L))), 0L, (a, x) -> a + x)"))
    long = lambda c: c.cast("long")
    df = df.withColumn(
        "f",
        F.struct(
            long(F.size("w")).alias("n_words"),
            long(F.length(F.array_join("w", ""))).alias("word_chars"),
            long(F.regexp_count("t", F.lit("[#*$%&|<>]"))).alias("n_symbols"),
            long(F.size("l")).alias("n_lines"),
            long(F.size("l") - F.size(F.array_distinct("l"))).alias("n_dup_lines"),
            F.col("r").alias("n_repeat_words"),
        ),
    )
    failed = (F.col("f.n_words") < 10) | (100 * F.col("f.n_repeat_words") > 20 * F.col("f.n_words"))
    return df.select("row", F.col("f").withField("base_failed", failed).alias("q"))


def _stratum(column: str | None, strata: tuple[str, ...]):
    name = F.col("row")[column].cast("string") if column else F.lit(None)
    return F.when(name.isin(*strata), name).otherwise(F.lit("other")) if column else F.lit("other")


def thresholds(
    scored: DataFrame, labels: DataFrame, id_col: str = "doc_id", stratum: str | None = "lang", delta: float = 0.05, limits: tuple[float, ...] = LIMITS, useful: float = 0.2, strata: tuple[str, ...] = STRATA
) -> DataFrame:
    """(stratum, pool, n_good, limit, cutoffs struct<rule: int>): a row a stratum, len(strata) + 1 of them, from with_features' table.

    ``pool`` is "" where the stratum is pooled; a null cutoff never bites.  A document labelled more than once is good if
    every label says so; null labels and null ids say nothing.
    """
    steps = len(GRID)
    level = math.log(delta / (len(strata) + 1))
    said = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.min("quality") == 1).alias("good"))
    held = scored.where("not q.base_failed").select(F.col("row")[id_col].alias("id"), _stratum(stratum, strata).alias("stratum"), "q.*")
    # at(r): how many of the path's steps of rule r leave the document alone
    held = held.select("id", "stratum", *[F.expr(f"size(filter(array({', '.join(map(str, GRID))}), c -> c >= {e}))").alias(f"at_{r}") for r, e in RULES.items()])
    places = [f"at_{r}" for r in RULES]
    # at most (len(GRID) + 1) ** len(RULES) places, twice, in each stratum, whatever the input
    cells = held.join(said, "id").groupBy("stratum", "good", *places).agg(F.count(F.lit(1)).alias("m"))
    every = Window.partitionBy()
    poor = F.sum(F.when(~F.col("good"), F.col("m"))).over(every)
    for r in RULES:
        caught = F.sum(F.when(~F.col("good") & (F.col(f"at_{r}") < steps), F.col("m")).otherwise(0)).over(every)
        cells = cells.withColumn(f"use_{r}", F.coalesce(caught >= useful * poor, F.lit(False)))
    before = F.lit(0)
    for r in RULES:
        cells = cells.withColumn(f"from_{r}", before)
        before = before + F.col(f"use_{r}").cast("int") * steps
    first = [F.when(F.col(f"use_{r}") & (F.col(f"at_{r}") < steps), F.col(f"from_{r}") + F.col(f"at_{r}")) for r in RULES]
    cells = cells.withColumn("first", F.least(*first)).withColumn("all_steps", before)
    cells = cells.withColumn("own", F.sum(F.when(F.col("good"), F.col("m")).otherwise(0)).over(Window.partitionBy("stratum")))
    enough = lambda n, a: n * math.log(1 - a) <= level
    cells = cells.withColumn("pool", F.when(enough(F.col("own"), max(limits)), F.col("stratum")).otherwise(F.lit("")))
    rules = [F.struct(F.col(f"use_{r}").alias("use"), F.col(f"from_{r}").alias("start")).alias(r) for r in RULES]
    pools = cells.where("good").groupBy("pool").agg(
        F.sum("m").alias("n_good"), F.first("all_steps").alias("all_steps"), F.first(F.struct(*rules)).alias("rules"), F.collect_list(F.struct("first", "m")).alias("seen")
    )
    limit = F.coalesce(*[F.when(enough(F.col("n_good"), a), F.lit(a)) for a in sorted(limits)])
    pools = pools.withColumn("limit", limit).withColumn("ks", F.expr("transform(sequence(0, greatest(all_steps - 1, 0)), j -> aggregate(filter(seen, e -> e.first <= j), 0L, (a, e) -> a + e.m))"))
    # log P(X <= k) for X ~ Binomial(n, limit), term by term; only k below the mean can be significant
    tail = """case when k < n_good * limit then aggregate(sequence(0L, k),
        named_struct('t', n_good * ln(1D - limit), 's', cast('-Infinity' as double)),
        (a, i) -> named_struct(
          't', a.t + ln((n_good - i) / (i + 1D)) + ln(limit / (1D - limit)),
          's', greatest(a.s, a.t) + ln(1D + exp(-abs(a.s - a.t)))),
        a -> a.s) end"""
    fails = F.expr(f"array_position(transform(ks, k -> coalesce(({tail}) <= {level}D, false)), false)")
    pools = pools.withColumn("passed", F.when(F.col("all_steps") == 0, 0).when(fails == 0, F.size("ks")).otherwise(fails - 1))
    grid = F.array(*[F.lit(c) for c in sorted(GRID, reverse=True)])
    cut = [F.when(F.col(f"rules.{r}.use"), F.get(grid, F.least(F.col("passed") - F.col(f"rules.{r}.start"), F.lit(steps)).cast("int") - 1)).alias(r) for r in RULES]
    pools = pools.select("pool", "n_good", "limit", F.struct(*cut).alias("cutoffs"))
    listed = scored.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in (*strata, "other")])).alias("stratum"))
    alone = cells.where("pool <> ''").select("stratum", "pool").distinct()
    return listed.join(alone, "stratum", "left").withColumn("pool", F.coalesce("pool", F.lit(""))).join(pools, "pool", "left").select("stratum", "pool", "n_good", "limit", "cutoffs")


def _judged(docs: DataFrame, labels: DataFrame, id_col: str, text: str, stratum: str | None, **options) -> DataFrame:
    """(row, q): q with kept."""
    strata = options.get("strata", STRATA)
    scored = store.materialize(with_features(docs, text), "quality")
    found = thresholds(scored, labels, id_col, stratum, **options).select("stratum", "cutoffs")
    out = scored.withColumn("stratum", _stratum(stratum, strata)).join(F.broadcast(found), "stratum", "left")  # len(strata) + 1 rows
    bad = F.col("q.base_failed")
    for r, e in RULES.items():
        bad = bad | F.coalesce(F.expr(re.sub(r"\b(n_\w+|word_chars)", r"q.\1", e)) > F.col(f"cutoffs.{r}"), F.lit(False))
    return out.select("row", F.col("q").withField("kept", ~bad).alias("q"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", stratum: str | None = "lang", to: str = "__quality", **options) -> DataFrame:
    """docs with a struct ``to`` of the features, base_failed and kept; options are those of thresholds().

    Null text has no words and fails.  A null or unlisted stratum is "other".  Rows are judged one by one, so repeated rows
    and ties agree, and further columns pass through whatever their names (one called ``to`` is replaced).  Texts may have
    any length.  Without usable labels only the base rules turn documents away.  Empty table: empty result.
    """
    return _judged(docs, labels, id_col, text, stratum, **options).select(*[F.col("row")[c].alias(c) for c in docs.columns if c != to], F.col("q").alias(to))


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", stratum: str | None = "lang", **options) -> DataFrame:
    """docs without the documents that the rules turn away."""
    return _judged(docs, labels, id_col, text, stratum, **options).where("q.kept").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    out = judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", *[F.col(f"__quality.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


_LEVEL = 0.05 / (len(STRATA) + 1)
#: from a view docs(doc_id, text, lang) and labels: judged(doc_id, ..., kept)
SQL_CTE = rf"""
w AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM docs
), u AS (SELECT doc_id, unnest(ws) AS x, unnest(range(length(ws))) AS p FROM w
), g AS (
  SELECT doc_id, p, lead(p, 4) OVER o AS whole, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o AS gram FROM u
  WINDOW o AS (PARTITION BY doc_id ORDER BY p)
), d AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g WHERE whole IS NOT NULL) WHERE c > 1
), r AS (SELECT doc_id, sum(least(5, coalesce(nx - p, 5)))::BIGINT AS n_repeat_words FROM (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS nx FROM d) GROUP BY doc_id
), f AS (
  SELECT doc_id, CASE WHEN lang IN ('en', 'fr', 'de', 'es') THEN lang ELSE 'other' END AS stratum, length(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, length(ls)::BIGINT AS n_lines, (length(ls) - length(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, length(ws) < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * length(ws) AS base_failed FROM w LEFT JOIN r USING (doc_id)
), v AS (
  SELECT *, unnest(['symbols', 'repeats', 'dup_lines']) AS rule, unnest([1, 2, 3]) AS place, unnest([1000 * n_symbols // greatest(word_chars, 1), 1000 * n_repeat_words // greatest(n_words, 1), 1000 * n_dup_lines // greatest(n_lines, 1)]) AS val FROM f
), said AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id
), lab AS (SELECT v.*, good FROM v JOIN said USING (doc_id) WHERE NOT base_failed
), useful AS (SELECT rule, 10 * (row_number() OVER (ORDER BY place) - 1) AS start FROM (SELECT rule, place FROM lab WHERE NOT good GROUP BY ALL HAVING count(*) FILTER (val > {min(GRID)}) >= 0.2 * count(*))
), pools AS (
  SELECT s.stratum, CASE WHEN count(doc_id) * ln(1 - {max(LIMITS)}) <= ln({_LEVEL}) THEN s.stratum ELSE '' END AS pool
  FROM (SELECT unnest(['en', 'fr', 'de', 'es', 'other']) AS stratum) s LEFT JOIN (SELECT DISTINCT doc_id, stratum FROM lab WHERE good) USING (stratum) GROUP BY s.stratum
), firsts AS (
  SELECT doc_id, pool, min(CASE WHEN val > {min(GRID)} THEN start + len(list_filter({list(GRID)}, lambda c: c >= val)) END) AS first FROM lab JOIN pools USING (stratum) LEFT JOIN useful USING (rule) WHERE good GROUP BY ALL
), k AS (
  SELECT pool, j, count(*) AS n, count(*) FILTER (first <= j) AS k FROM firsts, (SELECT unnest(range(10 * (SELECT count(*) FROM useful))) AS j) GROUP BY ALL
), lim AS (SELECT *, CASE {' '.join(f'WHEN n * ln(1 - {a}) <= ln({_LEVEL}) THEN {a}' for a in LIMITS)} END AS a FROM k
), steps AS (
  SELECT pool, coalesce(min(j) FILTER (NOT ok), count(*)) AS passed FROM (
    SELECT pool, j, coalesce(k < n * a AND list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(a) + (n - i) * ln(1 - a)))) <= {_LEVEL}, false) AS ok FROM lim) GROUP BY pool
), cut AS (
  SELECT stratum, rule, {sorted(GRID, reverse=True)}[least(passed - start, 10)] AS c FROM pools JOIN steps USING (pool), useful WHERE passed > start
), judged AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(bool_or(val > c), false) AS kept
  FROM v LEFT JOIN cut USING (stratum, rule) GROUP BY doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed
)"""
SQL = f"WITH docs AS (SELECT * FROM documents), {SQL_CTE} SELECT * FROM judged"
