"""Column expressions for rates, intervals, fusion and losses, and the special functions they need (all in doubles)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

Z95 = 1.959963984540054


def d(x: Column) -> Column:
    return x.cast("double")


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson score interval; (0, 1) where n is not positive."""
    k, n = d(k), d(n)
    p = k / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    ok = n > 0
    return F.when(ok, F.greatest(mid - half, F.lit(0.0))).otherwise(0.0), F.when(ok, F.least(mid + half, F.lit(1.0))).otherwise(1.0)


def zero_hit_bound(n: Column, confidence: float = 0.95) -> Column:
    """One-sided exact upper bound of a rate with no hit in n."""
    return F.when(n > 0, 1 - F.pow(F.lit(1 - confidence), 1 / d(n))).otherwise(1.0)


def rate(k: Column, n: Column, min_n: int = 20) -> Column:
    """struct(status, point, lo, hi): below min_n the point and interval are null and the status says so."""
    lo, hi = wilson(k, n)
    ok = n >= min_n
    return F.struct(
        F.when(ok, F.lit("ok")).otherwise(F.lit("insufficient_denominator")).alias("status"),
        F.when(ok, F.round(d(k) / d(n), 4)).alias("point"),
        F.when(ok, F.round(lo, 4)).alias("lo"),
        F.when(ok, F.round(hi, 4)).alias("hi"),
    )


def cauchy(ps: Column) -> Column:
    """Cauchy combination of an array of p-values with equal weights."""
    t = F.aggregate(ps, F.lit(0.0), lambda a, p: a + F.tan((0.5 - F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))) * math.pi)) / F.size(ps)
    return F.least(F.greatest(0.5 - F.atan(t) / math.pi, F.lit(0.0)), F.lit(1.0))


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n: summed up to 64, beyond that by its asymptotic series (error below 1e-13)."""
    few = F.aggregate(F.sequence(F.lit(1), F.least(F.greatest(n, F.lit(1)), F.lit(64)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / i)
    m = d(n)
    return F.when(n <= 64, few).otherwise(F.log(m) + 0.5772156649015329 + 1 / (2 * m) - 1 / (12 * m * m) + 1 / (120 * m * m * m * m))


def bonferroni(ps: Column) -> Column:
    return F.least(F.lit(1.0), F.size(ps) * F.array_min(ps))


def by_global(ps: Column) -> Column:
    """Benjamini-Yekutieli p-value of the global null: min over ranks of p n H_n / rank."""
    n = F.size(ps)
    harmonic = F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda a, i: a + 1.0 / d(i))
    terms = F.transform(F.array_sort(ps), lambda p, i: p * n * harmonic / d(i + 1))
    return F.least(F.lit(1.0), F.array_min(terms))


def finite_or_one(p: Column) -> Column:
    """A p-value that could not be had counts as 1."""
    return F.when(p.isNull() | F.isnan(p) | (F.abs(p) == float("inf")), 1.0).otherwise(p)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: d(x) * d(y)), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def softmax(z: Column) -> Column:
    e = F.transform(z, lambda x: F.exp(d(x) - d(F.array_max(z))))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def entropy_bits(p: Column) -> Column:
    return -F.aggregate(p, F.lit(0.0), lambda s, x: s + F.when(x > 0, x * F.log2(x)).otherwise(0.0))


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Overlap of boxes given as x1, y1, x2, y2."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    area = lambda r: F.greatest(F.lit(0.0), r["x2"] - r["x1"]) * F.greatest(F.lit(0.0), r["y2"] - r["y1"])
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def quantized(x: Column, step: float) -> Column:
    return F.floor(x / step + 0.5)


def ppv(tpr: Column, fpr: Column, prevalence: Column) -> Column:
    hit, alarm = tpr * prevalence, tpr * prevalence + fpr * (1 - prevalence)
    return F.when(alarm > 0, hit / alarm)


def missed(tpr: Column, fpr: Column, prevalence: Column) -> Column:
    """P(bad | not flagged)."""
    left, all_ = (1 - tpr) * prevalence, (1 - tpr) * prevalence + (1 - fpr) * (1 - prevalence)
    return F.when(all_ > 0, left / all_)


def audit_size(q: float, miss: float, n: Column) -> Column:
    """Records to audit so that a share q of bad ones escapes with probability ``miss`` at most."""
    return F.least(n.cast("long"), F.lit(math.ceil(math.log(miss) / math.log(1 - q))).cast("long"))


# -- special functions -------------------------------------------------------------------------------------------------


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, dd = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    f = dd
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            dd = 1 / (1 + num * dd or tiny)
            c = 1 + num / c or tiny
            f *= dd * c
        if abs(dd * c - 1) < 1e-15:
            break
    return front * f


def binom_tail_ge(k: int, n: int, p: float) -> float:
    return 1.0 if k <= 0 else 0.0 if k > n else beta_cdf(p, k, n - k + 1)


def binom_two_sided(k: int, n: int, p: float) -> float:
    return min(1.0, 2 * min(binom_tail_ge(k, n, p), 1 - binom_tail_ge(k + 1, n, p)))


def clopper_pearson_upper(k: int, n: int, confidence: float = 0.95) -> float:
    if n <= 0 or k >= n:
        return 1.0
    if k == 0:
        return 1 - (1 - confidence) ** (1 / n)
    lo, hi = k / n, 1.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beta_cdf(mid, k + 1, n - k) < confidence else (lo, mid)
    return (lo + hi) / 2


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma: series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return 1 - scale * total
    b, tiny = x + 1 - a, 1e-300
    c, dd = 1 / tiny, 1 / b
    h = dd
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        dd = 1 / (an * dd + b or tiny)
        c = b + an / c or tiny
        h *= dd * c
        if abs(dd * c - 1) < 1e-15:
            break
    return scale * h


def chi2_sf(x: float, df: int) -> float:
    return gamma_q(df / 2, x / 2) if df > 0 else 1.0


def exact_power(n: int, p0: float, p1: float, alpha: float = 0.05) -> float:
    """Power of the one-sided exact binomial test for a gain from p0 to p1."""
    k = next((k for k in range(n + 1) if binom_tail_ge(k, n, p0) <= alpha), n + 1)
    return binom_tail_ge(k, n, p1)


def minimum_detectable(n: int, p0: float, alpha: float = 0.05, power: float = 0.8) -> float | None:
    lo, hi = p0, 1.0
    if exact_power(n, p0, 1.0, alpha) < power:
        return None
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if exact_power(n, p0, mid, alpha) >= power else (mid, hi)
    return hi


@pandas_udf(DoubleType())
def upper_bound(k: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([clopper_pearson_upper(int(a), int(b)) for a, b in zip(k, n, strict=True)])


@pandas_udf(DoubleType())
def binomial_p(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series([binom_two_sided(int(a), int(b), float(c)) for a, b, c in zip(k, n, p, strict=True)])


@pandas_udf(DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf(float(a), int(b)) for a, b in zip(x, df, strict=True)])
