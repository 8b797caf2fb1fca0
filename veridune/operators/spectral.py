"""Covariance of vectors and what follows from it: spectral outliers, full Mahalanobis distance, concentration tests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranks

SALTS = 64


def _partial(by: str, vector: str):
    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row a class and task, however many rows it reads."""
        held: dict = {}
        for part in parts:
            for label, rows in part.groupby(by, sort=False)[vector]:
                x = np.stack(rows.to_numpy()).astype(float)
                n, s, g = held.get(label, (0, 0.0, 0.0))
                held[label] = (n + len(x), s + x.sum(axis=0), g + x.T @ x)
        for label, (n, s, g) in held.items():
            yield pd.DataFrame({by: [label], "n": [n], "s": [s], "g": [np.ravel(g)]})

    return sums


def _merged(by: list[str]):
    def merge(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({**{b: [g[b].iloc[0]] for b in by}, "n": [g["n"].sum()], "s": [np.sum(g["s"].to_list(), axis=0)], "g": [np.sum(g["g"].to_list(), axis=0)]})

    return merge


def gram(df: DataFrame, by: str, vector: str) -> DataFrame:
    """(by, n, s, g): rows, sums and flat cross products by class.

    Tasks send a row a class; those are merged in SALTS groups a class and then in one, so no task holds a class's rows.
    Vectors must have one length; null vectors and classes take no part.
    """
    kind = df.schema[by].dataType.simpleString()
    schema = f"`{by}` {kind}, n long, s array<double>, g array<double>"
    part = df.where(F.col(by).isNotNull() & F.col(vector).isNotNull()).select(by, F.col(vector).cast("array<double>").alias(vector)).mapInPandas(_partial(by, vector), schema)
    part = part.withColumn("salt", F.spark_partition_id() % SALTS)
    some = part.groupBy(by, "salt").applyInPandas(_merged([by, "salt"]), f"`{by}` {kind}, salt int, n long, s array<double>, g array<double>")
    return some.drop("salt").groupBy(by).applyInPandas(_merged([by]), schema)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def spectral_outliers(df: DataFrame, id_col: str, by: str, vector: str, most: float = 2.0, least: int = 10) -> DataFrame:
    """Rows whose projection on their class's first principal axis lies over ``most`` deviations off its mean; classes under ``least`` rows are skipped.

    The projections' mean and deviation follow from the class's covariance, so the vectors are read twice and never sorted.
    """

    def fit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for label, n, s, g in part.itertuples(index=False):
                mean = s / n
                values, axes = np.linalg.eigh(g.reshape(len(s), -1) / n - np.outer(mean, mean))
                out.append((label, axes[:, -1], float(mean @ axes[:, -1]), float(np.sqrt(max(values[-1], 0.0)))))
            yield pd.DataFrame(out, columns=[by, "axis", "centre", "sd"])

    kind = df.schema[by].dataType.simpleString()
    axes = gram(df, by, vector).where(F.col("n") >= least).mapInPandas(fit, f"`{by}` {kind}, axis array<double>, centre double, sd double")
    z = F.abs(_dot(F.col(vector), F.col("axis")) - F.col("centre")) / (F.col("sd") + 1e-12)
    return df.join(axes, by).select(id_col, by, z.alias("z")).where(F.col("z") > most)


def mahalanobis(reference: DataFrame, df: DataFrame, id_col: str, vector: str, ridge: float = 1e-6) -> DataFrame:
    """Distance from the reference's mean under its covariance (ddof 1, plus ``ridge`` on the diagonal)."""

    def fit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for _, n, s, g in part.itertuples(index=False):
                mean = s / n
                cov = (g.reshape(len(s), -1) - n * np.outer(mean, mean)) / max(n - 1, 1) + ridge * np.eye(len(s))
                values, axes = np.linalg.eigh(cov)
                live = values > 1e-12 * max(values[-1], 1e-300)  # a pseudo-inverse where the matrix isn't of full rank
                white = (axes[:, live] / np.sqrt(values[live])).T
                yield pd.DataFrame({"white": [[list(r) for r in white]], "shift": [white @ mean]})

    one = gram(reference.withColumn("__all", F.lit(0)), "__all", vector).mapInPandas(fit, "white array<array<double>>, shift array<double>")
    d2 = F.aggregate(F.zip_with("white", "shift", lambda w, m: F.pow(_dot(F.col(vector), w) - m, F.lit(2.0))), F.lit(0.0), lambda s, v: s + v)
    return df.join(F.broadcast(one)).select(id_col, F.sqrt(d2).alias("distance"))  # one row of d * d numbers


def ood_flags(reference: DataFrame, df: DataFrame, id_col: str, vector: str, contamination: float = 0.05) -> DataFrame:
    """Distances and whether they lie beyond the reference's own (1 - contamination) quantile."""
    cut = ranks.quantiles(mahalanobis(reference, reference, id_col, vector), "distance", {"cut": 1 - contamination}).drop("n")
    return mahalanobis(reference, df, id_col, vector).join(F.broadcast(cut)).select(id_col, "distance", (F.col("distance") > F.col("cut")).alias("flagged"))


def concentration_test(df: DataFrame, contributor: str, flag: Column, rounds: int = 2000, least: int = 10, seed: int = 0) -> DataFrame:
    """(contributors, max_rate, p): is the highest flag rate of a contributor more than chance deals out?

    Shuffled flags give contributors multivariate hypergeometric counts, so the rounds need each one's total alone: a row
    a contributor comes to one task.  Fewer than two contributors, or one under ``least`` rows: too little power, p is null.
    """

    def test(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for pairs in part["pairs"]:
                n, k = np.array([(p["n"], p["k"]) for p in pairs], "int64").reshape(-1, 2).T
                top, p = (float((k / n).max()) if len(n) else None), None
                if len(n) > 1 and n.min() >= least:
                    draws = np.random.default_rng(seed).multivariate_hypergeometric(n, int(k.sum()), rounds, method="marginals") / n
                    p = (1 + int((draws.max(axis=1) >= top - 1e-12).sum())) / (rounds + 1)
                out.append((len(n), top, p))
            yield pd.DataFrame(out, columns=["contributors", "max_rate", "p"]).astype({"max_rate": float, "p": float})

    totals = df.groupBy(contributor).agg(F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("k"))
    return totals.agg(F.array_sort(F.collect_list(F.struct("n", "k"))).alias("pairs")).mapInPandas(test, "contributors long, max_rate double, p double")
