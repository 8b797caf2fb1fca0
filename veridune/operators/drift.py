"""Reference against operational samples: moments, distances, floors and the vote between natural and suspicious."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from . import ranks, tiles


def moments(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """mean, sd, skew, excess kurtosis (population), with zeros where a sample is too small or flat."""
    g = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.skewness(x).alias("sk"), F.kurtosis(x).alias("ku"), F.avg((F.abs(x) < 1e-6).cast("double")).alias("sparsity"))
    flat = F.col("sd") < 1e-10
    return g.withColumn("skew", F.when((F.col("n") < 3) | flat, 0.0).otherwise(F.col("sk"))).withColumn("kurt", F.when((F.col("n") < 4) | flat, 0.0).otherwise(F.col("ku"))).drop("sk", "ku")


def weight_screen(df: DataFrame, layer: str, w: str) -> DataFrame:
    """Layers with heavy tails or sparse extremes; under 10 weights are skipped."""
    live = F.when(F.abs(w) > 1e-6, F.col(w))
    g = df.groupBy(layer).agg(F.count(w).alias("n"), F.kurtosis(w).alias("kurt"), F.avg((F.abs(w) < 1e-6).cast("double")).alias("sparsity"), F.stddev_pop(w).alias("sd"), F.max(F.abs(live)).alias("top"), F.stddev_pop(live).alias("sd_live"))
    sev = F.when((F.col("sparsity") > 0.9) & (F.col("sd") > 0.5) & (F.col("top") > 5 * F.col("sd_live")), "HIGH").when(F.col("kurt") > 10, "MEDIUM")
    return g.where("n >= 10").withColumn("severity", sev).where("severity is not null").select(layer, "n", "kurt", "sparsity", "severity")


def by_dimension(df: DataFrame, vector: str, side: str) -> DataFrame:
    return df.select(side, F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def ks_dimensions(df: DataFrame, vector: str, side: str) -> DataFrame:
    return ranks.two_sample(by_dimension(df, vector, side), "x", side, ("dim",))


def ks_pvalues(ks: DataFrame, alpha: float = 0.05, terms: int = 100) -> DataFrame:
    """ks_dimensions with p (the limiting distribution, alternating series) and drifted: p at or below alpha over the number of dimensions."""
    lam = F.col("ks") * F.sqrt(F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b")))
    sign = lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda s, k: s + sign(k) * F.exp(-2 * k * k * lam * lam))
    p = F.when(lam < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))  # below 0.2: 1 - 1e-12 or more
    m = ks.agg(F.count(F.lit(1)).alias("__m"))
    return ks.withColumn("p", p).join(F.broadcast(m)).withColumn("drifted", F.col("p") <= alpha / F.col("__m")).drop("__m")  # m: one row


def dim_concentration(ks: DataFrame, share: float = 0.1) -> DataFrame:
    """Share of the summed statistics in the top tenth of dimensions (at least one)."""
    n = ks.agg(F.count(F.lit(1)).alias("n"), F.sum("ks").alias("all_"))
    r = ks.withColumn("r", F.row_number().over(Window.orderBy(F.col("ks").desc(), "dim"))).join(F.broadcast(n))  # a row a dimension
    top = F.greatest(F.lit(1), F.floor(F.col("n") * share))
    return r.agg((F.sum(F.when(F.col("r") <= top, F.col("ks"))) / F.max("all_")).alias("concentration"))


def wasserstein_grid(df: DataFrame, x: str, side: str, points: int = 101) -> DataFrame:
    """Mean absolute difference of evenly spaced quantiles."""
    q = [i / (points - 1) for i in range(points)]
    p = F.percentile(F.when(F.col(side), F.col(x)), F.array(*[F.lit(v) for v in q]))
    o = F.percentile(F.when(~F.col(side), F.col(x)), F.array(*[F.lit(v) for v in q]))
    return df.agg(p.alias("p"), o.alias("o")).select((F.aggregate(F.zip_with("p", "o", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, b: a + b) / points).alias("w1_grid"))


def mean_z(df: DataFrame, vector: str, side: str) -> DataFrame:
    """Greatest standardised difference of means over dimensions."""
    x = by_dimension(df, vector, side)
    a, b = F.when(F.col(side), F.col("x")), F.when(~F.col(side), F.col("x"))
    g = x.groupBy("dim").agg(F.abs(F.avg(a) - F.avg(b)).alias("d"), F.sqrt((F.var_samp(a) + F.var_samp(b)) / 2).alias("s"))
    return g.agg(F.max(F.col("d") / F.greatest("s", F.lit(1e-12))).alias("mean_z"))


def class_divergence(df: DataFrame, label: str, side: str) -> DataFrame:
    """(kl, js_bits) of class shares, reference (side true) against the rest."""
    c = df.groupBy(label).agg(F.count_if(F.col(side)).alias("a"), F.count_if(~F.col(side)).alias("b"))
    n = c.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    p = c.join(F.broadcast(n)).select((F.col("a") / F.col("na")).alias("p"), (F.col("b") / F.col("nb")).alias("q"))  # n: one row
    m = (F.col("p") + F.col("q")) / 2
    half = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return p.agg(F.sum((F.col("p") + 1e-10) * F.log((F.col("p") + 1e-10) / (F.col("q") + 1e-10))).alias("kl"), (F.sum(half(F.col("p"))) / 2 + F.sum(half(F.col("q"))) / 2).alias("js_bits"))


def _deals(id_col: str, share: Column, rounds: int, seed: str) -> Column:
    """Each round's side of a row, by a hash of round and id: true for about ``share`` of the rows."""
    u = lambda r: F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(seed), r.cast("string"), F.col(id_col).cast("string"))), 1, 12), 16, 10).cast("double") / float(1 << 48)
    return F.transform(F.sequence(F.lit(1), F.lit(rounds)), lambda r: u(r) < share) if rounds else F.array().cast("array<boolean>")


def bandwidth(df: DataFrame, id_col: str, vector: str, side: str, rows: int = 100) -> DataFrame:
    """(sigma): median of the positive distances between the first ``rows`` rows of each side, as the statistic defines it."""
    r = df.withColumn("__r", F.row_number().over(Window.partitionBy(side).orderBy(id_col))).where(F.col("__r") <= rows)
    r = r.select(F.col(id_col).alias("i"), F.col(vector).alias("v"), F.lit(1).alias("one"))
    d = F.zip_with("v", "w", lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2.0))
    both = r.join(F.broadcast(r.select(F.col("i").alias("j"), F.col("v").alias("w"), "one")), "one")  # 2 * rows at most
    return both.select(F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x)).alias("d")).where("d > 0").agg(F.median("d").alias("sigma"))


def pair_sums(df: DataFrame, id_col: str, vector: str, side: str, sigma: DataFrame | None = None, rounds: int = 0, seed: str = "0") -> DataFrame:
    """(round, tt, ff, tf, nt, nf): sums over all unordered pairs inside each side and across, and the sides' sizes.

    Gaussian kernel where sigma is given, distances elsewhere; round 0 has the sides as they are, others hashed ones.  Every
    row with an id, a side and a vector meets every other, by cells of two blocks of rows; a task sends on a few sums a cell.
    """
    live = df.where(F.col(id_col).isNotNull() & F.col(side).isNotNull() & F.col(vector).isNotNull())
    n, share = live.agg(F.count(F.lit(1)), F.avg(F.col(side).cast("double"))).first()
    width = sigma.first()[0] if sigma is not None else None
    width = float("nan") if sigma is not None and width is None else width  # no two rows differ: undefined
    s = F.concat(F.array(side), _deals(id_col, F.lit(share), rounds, seed))
    sums = tiles.cells(live, id_col, vector, tiles.sums_of(width), "round long, tt double, ff double, tf double, nt double, nf double", s, n, one_dim=True)
    return sums.groupBy("round").agg(*[F.sum(c).alias(c) for c in ("tt", "ff", "tf", "nt", "nf")])


def mmd2(df: DataFrame, id_col: str, vector: str, side: str, rounds: int = 100, seed: str = "0") -> DataFrame:
    """(mmd2, p): unbiased squared MMD of all rows, Gaussian kernel of median bandwidth; p is the share of re-dealt sides that reach it."""
    k = pair_sums(df, id_col, vector, side, bandwidth(df, id_col, vector, side), rounds, seed)
    m = k.select("round", (2 * F.col("tt") / (F.col("nt") * (F.col("nt") - 1)) + 2 * F.col("ff") / (F.col("nf") * (F.col("nf") - 1)) - 2 * F.col("tf") / (F.col("nt") * F.col("nf"))).alias("m"))
    own = F.max(F.when(F.col("round") == 0, F.col("m")))
    g = m.agg(own.alias("mmd2"), F.collect_list("m").alias("ms"))  # a number a round
    return g.select("mmd2", ((F.size(F.filter("ms", lambda x: x >= F.col("mmd2"))) - 1.0) / rounds).alias("p"))  # less round 0 itself


def energy_distance(df: DataFrame, id_col: str, vector: str, side: str) -> DataFrame:
    """(energy) of all rows."""
    n2 = lambda a, b: F.col(a) * F.col(b)
    e = pair_sums(df, id_col, vector, side)
    return e.select((2 * F.col("tf") / n2("nt", "nf") - 2 * F.col("tt") / n2("nt", "nt") - 2 * F.col("ff") / n2("nf", "nf")).alias("energy"))


def direction_coherence(df: DataFrame, id_col: str, vector: str, distance: str, top: int) -> DataFrame:
    """Mean pairwise cosine of the ``top`` farthest rows, from one sum: (|sum of units|^2 - n) / (n (n - 1))."""
    far = df.orderBy(F.col(distance).desc(), id_col).limit(top)
    unit = F.transform(vector, lambda x: x.cast("double") / stats.norm(F.col(vector)))
    dims = far.select(F.posexplode(unit).alias("dim", "u")).groupBy("dim").agg(F.sum("u").alias("s"), F.count(F.lit(1)).alias("n"))
    return dims.agg(((F.sum(F.col("s") ** 2) - F.max("n")) / (F.max("n") * (F.max("n") - 1.0))).alias("coherence"))


def effect_floor(effects: DataFrame, x: str, alpha: float = 0.05, minimum: float = 0.2) -> DataFrame:
    """The ceil((m + 1)(1 - alpha))-th smallest clean effect, at least ``minimum``; infinite if m is too small."""
    m = effects.agg(F.count(x).alias("m"), F.array_sort(F.collect_list(x)).alias("v"))  # clean batches: a few hundred numbers
    k = F.ceil((F.col("m") + 1) * (1.0 - alpha))
    return m.select("m", F.when(k <= F.col("m"), F.greatest(F.element_at("v", k.cast("int")), F.lit(minimum))).otherwise(float("inf")).alias("floor"))


def arbitrate(votes: DataFrame) -> DataFrame:
    """votes (case_id, vote, fired): two shape votes are suspicious; a natural direction alone is natural."""
    shape = F.count_if(F.col("fired") & (F.col("vote") != "natural_direction"))
    natural = F.count_if(F.col("fired") & (F.col("vote") == "natural_direction"))
    g = votes.groupBy("case_id").agg(shape.alias("shape"), natural.alias("natural"))
    return g.withColumn("verdict", F.when(F.col("shape") >= 2, "suspicious").when((F.col("natural") > 0) & (F.col("shape") == 0), "natural").otherwise("undetermined"))


def _dealt_sums():
    def rows(batches):
        total = held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            s, v = (np.asarray(batch[c].to_pylist(), float) for c in ("s", "v"))
            part, n = np.stack([s.T @ v, (1 - s).T @ v]), np.stack([s.sum(axis=0), (1 - s).sum(axis=0)])
            total, held = (part, n) if total is None else (total + part, held + n)
        if total is not None:
            rounds, dims = total.shape[1:]
            r, d = np.divmod(np.arange(rounds * dims), dims)
            yield pa.RecordBatch.from_pydict({"round": r, "dim": d, "t": total[0].ravel(), "f": total[1].ravel(), "nt": held[0][r], "nf": held[1][r]})

    return rows


def permutation_p(df: DataFrame, id_col: str, vector: str, side: str, rounds: int = 200, seed: str = "0") -> DataFrame:
    """(observed, p) for the length of the difference of means over all components; p = (1 + #>=) / (1 + rounds) over re-dealt sides.

    A task sends on a sum a round and component, not its rows once a round.
    """
    one = df.agg(F.avg(F.col(side).cast("double")).alias("share"))
    r = df.join(F.broadcast(one)).select(F.concat(F.array(side), _deals(id_col, F.col("share"), rounds, seed)).alias("s"), F.transform(vector, lambda x: x.cast("double")).alias("v"))  # one row
    sums = r.mapInArrow(_dealt_sums(), "round long, dim long, t double, f double, nt double, nf double").groupBy("round", "dim").agg(*[F.sum(c).alias(c) for c in ("t", "f", "nt", "nf")])
    d = sums.groupBy("round").agg(F.sqrt(F.sum(F.pow(F.col("t") / F.col("nt") - F.col("f") / F.col("nf"), 2.0))).alias("d"))
    g = d.agg(F.max(F.when(F.col("round") == 0, F.col("d"))).alias("observed"), F.collect_list("d").alias("ds"))  # a number a round
    return g.select("observed", (F.size(F.filter("ds", lambda x: x >= F.col("observed"))) / (1.0 + rounds)).alias("p"))
