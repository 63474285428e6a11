"""Effect sizes, error measures, seed tables and tolerance audits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def eta_squared(rows: DataFrame, value: str, group: str, min_count: int = 80) -> DataFrame:
    """(eta2, m, n): between-group over total sum of squares, over groups of at least `min_count` rows.

    Null values, null and negative groups are left out; eta2 is null without groups or without spread.
    Two levels of aggregation: moments of each group, then of the groups.
    """
    r = rows.where(F.col(value).isNotNull() & F.col(group).isNotNull() & (F.col(group) >= 0))
    g = r.groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("mu"), F.var_pop(value).alias("v")).where(F.col("n") >= max(1, min_count))
    s = g.agg(F.count("*").alias("m"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mu")).alias("s1"), F.sum(F.col("n") * F.col("mu") ** 2).alias("s2"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = F.col("s2") - F.try_divide(F.col("s1") ** 2, F.col("n"))
    return s.select(F.try_divide(between, between + F.col("within")).alias("eta2"), "m", F.coalesce("n", F.lit(0)).alias("n"))


def seed_cells(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys..., mean, std, n): over the seeds of each cell; sample std, 0 for one seed; null values skipped."""
    return runs.groupBy(*keys).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.count(value).alias("n"))


def r2(y: str, p: str) -> Column:
    """1 - SSE / SST; null for a constant truth."""
    return 1 - F.try_divide(F.sum((F.col(y) - F.col(p)) ** 2), F.var_pop(y) * F.count(y))


def mse(y: str, p: str) -> Column:
    return F.avg((F.col(y) - F.col(p)) ** 2)


def f1(scored: DataFrame, score: str, label: str, classes: str) -> DataFrame:
    """(macro_f1, micro_f1): 2 tp / (2 tp + fp + fn) at score > 0.5, 0 where undefined; classes without positives are dropped."""
    p, y = F.col(score) > 0.5, F.col(label) == 1
    c = scored.groupBy(classes).agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn")).where(F.col("tp") + F.col("fn") > 0)
    one = lambda tp, fp, fn: F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))
    return c.agg(F.avg(one(F.col("tp"), F.col("fp"), F.col("fn"))).alias("macro_f1"), one(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("micro_f1"))


def top1_hit(scored: DataFrame, item: str, score: str, label: str, classes: str) -> DataFrame:
    """(top1): share of items whose best-scored class, the first of equal ones, is a positive one."""
    best = scored.groupBy(item).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(classes).alias("c"), F.col(label).alias("y"))).alias("b"))
    return best.agg(F.avg((F.col("b.y") == 1).cast("double")).alias("top1"))


def summary(value: str) -> list[Column]:
    return [F.avg(value).alias("mean"), F.median(value).alias("median"), F.percentile(value, 0.9).alias("p90"), F.max(value).alias("max")]


def weighted_mean(value: str, weight: str) -> Column:
    return F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight))


def masked_bce(logit: str, label: str, mask: str) -> Column:
    """Binary cross-entropy of logits, summed over the unmasked rows and divided by their number."""
    x, y = F.col(logit), F.col(label)
    loss = F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
    return F.try_divide(F.sum(F.when(F.col(mask), loss)), F.count_if(F.col(mask)))


def welch(m1: str, s1: str, n1: str, m2: str, s2: str, n2: str) -> tuple[Column, Column]:
    """t and degrees of freedom of the unequal-variance test from means, stds and sizes; null without variance."""
    a, b = F.col(s1) ** 2 / F.col(n1), F.col(s2) ** 2 / F.col(n2)
    se2 = F.when(a + b > 0, a + b)
    den = a**2 / F.greatest(F.col(n1) - 1, F.lit(1)) + b**2 / F.greatest(F.col(n2) - 1, F.lit(1))
    return (F.col(m1) - F.col(m2)) / F.sqrt(se2), F.try_divide(se2**2, den)


def _beta_tail(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularized incomplete beta function by its continued fraction."""
    from math import lgamma

    flip = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    front = np.exp(np.array([lgamma(u + v) - lgamma(u) - lgamma(v) for u, v in zip(a, b)]) + a * np.log(np.maximum(x, 1e-300)) + b * np.log1p(-np.minimum(x, 1 - 1e-16))) / a
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    f = d.copy()
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            f = f * d * c
    out = np.where(x <= 0, 0.0, front * f)
    return np.where(flip, 1 - out, out)


@F.pandas_udf(DoubleType())
def t_test_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t; null where t or its degrees of freedom are."""
    ok = t.notna() & df.notna() & (df > 0)
    out = pd.Series(np.nan, index=t.index)
    if ok.any():
        tt, nu = t[ok].to_numpy(float), df[ok].to_numpy(float)
        out[ok] = _beta_tail(nu / (nu + tt**2), nu / 2, np.full_like(nu, 0.5))
    return out.where(ok, None)


def tolerance(canon_std: str, n: str) -> tuple[Column, Column]:
    """Allowed differences of mean and std: 2.5 standard errors and half a std, at least 0.002 and 0.003."""
    s = F.col(canon_std)
    return F.greatest(F.lit(0.002), 2.5 * s / F.sqrt(F.col(n))), F.greatest(F.lit(0.003), 0.5 * s)


def quality_gate(rows: DataFrame, ok: Column, least: float = 0.5) -> DataFrame:
    """`rows` where `ok`, or an error when fewer than `least` of them, or none, are ok: checked before a cache is written."""
    n, good = rows.agg(F.count("*"), F.count_if(ok)).first()
    if not good or good < least * n:
        raise ValueError(f"only {good} of {n} rows are ok; nothing is written")
    return rows.where(ok)


def status_counts(rows: DataFrame, status: str, cut: int = 12) -> DataFrame:
    """(status, n): statuses other than ok cut to `cut` characters."""
    return rows.groupBy(F.substring(status, 1, cut).alias("status")).agg(F.count("*").alias("n"))
