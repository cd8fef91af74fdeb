"""Student's t in log space, colocalization by approximate Bayes factors, and the fit of degrees of freedom."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

LN10 = float(np.log(10.0))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series after shifting the argument past 10."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(10):
        low = y < 10
        shift = np.where(low, shift - np.log(np.where(low, y, 1.0)), shift)
        y = np.where(low, y + 1, y)
    inv = 1 / y
    series = inv / 12 - inv**3 / 360 + inv**5 / 1260 - inv**7 / 1680
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series + shift


def _log_incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray, log_x: np.ndarray, log_rest: np.ndarray) -> np.ndarray:
    """log of the regularised incomplete beta for x below its mean, by its continued fraction (modified Lentz)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 200):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + term / np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-14):
            break
    return _log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * log_x + b * log_rest - np.log(a) + np.log(h)


def log_two_sided(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """Natural log of P(|T| >= |t|)."""
    t, dof = np.broadcast_arrays(np.abs(np.asarray(t, float)), np.asarray(dof, float))
    square = t * t
    log_x, log_rest = -np.log1p(square / dof), np.where(square > 0, -np.log1p(dof / np.where(square > 0, square, 1.0)), -np.inf)
    a, b = dof / 2, np.full_like(dof, 0.5)
    x = np.exp(log_x)
    low = x < (a + 1) / (a + b + 2)
    with np.errstate(all="ignore"):
        direct = _log_incomplete_beta(a, b, np.where(low, x, 0.5 * (a + 1) / (a + b + 2)), np.where(low, log_x, -0.7), np.where(low, log_rest, -0.7))
        rest = np.exp(np.where(low, 0.0, 1.0) * log_rest)
        other = _log_incomplete_beta(b, a, np.where(low, 0.1, rest), np.where(low, -0.7, log_rest), np.where(low, -0.7, log_x))
        out = np.where(low, direct, np.log1p(-np.minimum(np.exp(other), 1.0)))
    return np.where(square == 0, 0.0, np.minimum(out, 0.0))


def t_from_neglog10(nlp: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """|t| of a two-sided -log10 p, by bisection on log t; 0 for nlp <= 0, infinite for infinite nlp."""
    nlp, dof = np.broadcast_arrays(np.asarray(nlp, float), np.asarray(dof, float))
    low, high = np.full(nlp.shape, -60.0), np.full(nlp.shape, 0.0)
    goal = -nlp * LN10
    for _ in range(80):
        short = log_two_sided(np.exp(np.minimum(high, 700)), dof) > goal
        if not short.any() or high.max() > 700:
            break
        high = np.where(short, high + 10, high)
    for _ in range(80):
        mid = (low + high) / 2
        small = log_two_sided(np.exp(np.minimum(mid, 700)), dof) > goal
        low, high = np.where(small, mid, low), np.where(small, high, mid)
    out = np.exp(np.minimum((low + high) / 2, 700))
    return np.where(np.isnan(nlp) | np.isnan(dof), np.nan, np.where(nlp <= 0, 0.0, np.where(np.isinf(nlp), np.inf, out)))


@F.pandas_udf(DoubleType())
def t_quantile(nlp: pd.Series, dof: pd.Series) -> pd.Series:
    """t_from_neglog10 of columns; null if either is."""
    out = t_from_neglog10(nlp.to_numpy(float, na_value=np.nan), dof.to_numpy(float, na_value=np.nan))
    return pd.Series(out).where(~np.isnan(out), None)


@F.pandas_udf(DoubleType())
def neglog10_of_t(t: pd.Series, dof: pd.Series) -> pd.Series:
    out = -log_two_sided(t.to_numpy(float, na_value=np.nan), dof.to_numpy(float, na_value=np.nan)) / LN10
    return pd.Series(out).where(~np.isnan(out), None)


@F.pandas_udf(DoubleType())
def round_significant(x: pd.Series, digits: pd.Series) -> pd.Series:
    """The exact binary value rounded to significant digits, half to even."""
    return pd.Series([None if v is None or v != v else float(f"{v:.{int(d)}g}") for v, d in zip(x, digits, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def round_exact(x: pd.Series, digits: pd.Series) -> pd.Series:
    """The exact binary value rounded to decimals, half to even."""
    return pd.Series([None if v is None or v != v else round(v, int(d)) for v, d in zip(x, digits, strict=True)], dtype="float64")


def r_squared(t: Column, dof: Column) -> Column:
    return F.when(t.isNotNull() & (F.abs(t) == float("inf")), 1.0).otherwise(F.try_divide(t * t, t * t + dof))


# Colocalization

#: Prior variances of the effect of the two traits, and prior probabilities.
W1, W2, P1, P2, P12 = 0.15**2, 0.2**2, 1e-4, 1e-4, 1e-5


def log_bayes_factor(z: Column, se: Column, w: float) -> Column:
    r = F.lit(w) / (F.lit(w) + se * se)
    return 0.5 * (F.log1p(-r) + r * z * z)


def coloc(aligned: DataFrame, keys: Sequence[str], variant: Sequence[str], beta1: str, se1: str, beta2: str, se2: str, w1: float = W1, w2: float = W2, p1: float = P1, p2: float = P2, p12: float = P12) -> DataFrame:
    """For each key over its aligned variants: n_variants, pp0..pp4, best_<variant> and its posterior, credible95.

    Rows need finite effects and standard errors above 0. Sums of exponentials are taken from their largest term. The
    fourth hypothesis uses (sum A)(sum B) - sum AB, so no pairs of variants are formed.
    """
    from genomark.functions.expressions import finite

    ok = finite(F.col(beta1)) & finite(F.col(beta2)) & finite(F.col(se1)) & finite(F.col(se2)) & (F.col(se1) > 0) & (F.col(se2) > 0)
    rows = aligned.where(ok).select(*keys, *variant, log_bayes_factor(F.col(beta1) / F.col(se1), F.col(se1), w1).alias("_l1"), log_bayes_factor(F.col(beta2) / F.col(se2), F.col(se2), w2).alias("_l2"))
    rows = rows.withColumn("_l12", F.col("_l1") + F.col("_l2"))
    # One shuffle by key and one sort (by the joint term, so its running sum is that of the posteriors from the highest on) serve everything that follows.
    rows = rows.repartition(*keys)
    order = W.partitionBy(*keys).orderBy(F.desc("_l12"), *variant).rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy(*keys).orderBy(F.desc("_l12"), *variant).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    scaled = rows.withColumns({f"_m{k}": F.max(f"_l{k}").over(whole) for k in ("1", "2", "12")}).withColumn("_e12", F.exp(F.col("_l12") - F.col("_m12")))
    scaled = scaled.withColumns({"_before": F.sum("_e12").over(order) - F.col("_e12"), "_all": F.sum("_e12").over(whole)})
    best = F.min_by(F.struct(*variant, "_l12"), F.struct((-F.col("_l12")).alias("l"), *variant))  # the first on ties
    sums = scaled.groupBy(*keys).agg(F.count("*").alias("n_variants"), *((F.first(f"_m{k}") + F.log(F.sum(F.exp(F.col(f"_l{k}") - F.col(f"_m{k}"))))).alias(f"_s{k}") for k in ("1", "2", "12")), best.alias("_best"), F.count_if(F.col("_before") < 0.95 * F.col("_all")).alias("credible95"))
    both = F.col("_s1") + F.col("_s2")
    left = F.lit(1.0) - F.exp(F.col("_s12") - both)
    h = {"h0": F.lit(0.0), "h1": np.log(p1) + F.col("_s1"), "h2": np.log(p2) + F.col("_s2"), "h3": F.when(left > 0, np.log(p1) + np.log(p2) + both + F.log(left)).otherwise(float("-inf")), "h4": np.log(p12) + F.col("_s12")}
    top = sums.withColumns({f"_{k}": v for k, v in h.items()}).withColumn("_top", F.greatest(*(F.col(f"_{k}") for k in h)))
    norm = sum((F.exp(F.col(f"_{k}") - F.col("_top")) for k in h), F.lit(0.0))
    return top.select(*keys, "n_variants", *((F.exp(F.col(f"_h{k}") - F.col("_top")) / norm).alias(f"pp{k}") for k in range(5)), *(F.col(f"_best.{v}").alias(f"best_{v}") for v in variant), F.exp(F.col("_best._l12") - F.col("_s12")).alias("best_posterior"), "credible95")


def coloc_posteriors(aligned: DataFrame, keys: Sequence[str], beta1: str, se1: str, beta2: str, se2: str, w1: float = W1, w2: float = W2) -> DataFrame:
    """aligned with posterior: given that both traits share a variant of the key, that it is this one. They add up to 1; null without statistics."""
    from genomark.functions.expressions import finite

    ok = finite(F.col(beta1)) & finite(F.col(beta2)) & finite(F.col(se1)) & finite(F.col(se2)) & (F.col(se1) > 0) & (F.col(se2) > 0)
    joint = log_bayes_factor(F.col(beta1) / F.col(se1), F.col(se1), w1) + log_bayes_factor(F.col(beta2) / F.col(se2), F.col(se2), w2)
    key = W.partitionBy(*keys)
    scaled = aligned.withColumn("_l", F.when(ok, joint)).withColumn("_e", F.exp(F.col("_l") - F.max("_l").over(key)))
    return scaled.withColumn("posterior", F.col("_e") / F.sum("_e").over(key)).drop("_l", "_e")


# Degrees of freedom

#: Rows of a sample, largest residual, distance from an end of the grid, widenings.
DOF_ROWS, DOF_RESIDUAL, DOF_EDGE, DOF_ROUNDS = 100_000, 0.01, 3, 4
#: Rows times candidates up to which all are tried.
DOF_GRID = 10_000_000


def dof_objective(t: np.ndarray, log10p: np.ndarray, dof: int) -> float:
    found = np.maximum(log_two_sided(t, np.full_like(t, dof)) / LN10, -323.0)
    return float(np.median(np.abs(found - log10p)))


def _search(t: np.ndarray, log10p: np.ndarray, n: int | None) -> tuple[int, float, float, bool, bool]:
    """Best dof, its objective, the runner-up's, at an edge, at the model's limit: what a plain grid over all of them says, the smallest dof on ties.

    Few rows are tried at every dof: their median has steps and may have several valleys. That of many rows has one,
    perhaps with a flat floor: about 64 candidates are tried first, then all from the one before the first of the best to the one after the last of them.
    """
    low, high = (max(2, n - 200), n - 1) if n else (2, 1000)
    limit, seen = (n - 1 if n else 100_000), {}
    value = lambda d: seen.setdefault(d, dof_objective(t, log10p, d))
    for k in range(DOF_ROUNDS + 1):
        step = max(1, (high - low) // 64) if len(t) * (high - low) > DOF_GRID else 1
        coarse = sorted({*range(low, high + 1, step), high})
        least = min(map(value, coarse))
        floor = [d for d in coarse if value(d) == least]
        for d in range(max(low, floor[0] - step), min(high, floor[-1] + step) + 1):
            value(d)
        best = min(seen, key=lambda d: (seen[d], d))
        for d in (best - 1, best + 1):
            if low <= d <= high:
                value(d)
        wider = max(high - low + 1, 16)
        if k == DOF_ROUNDS:
            break
        if best - low <= DOF_EDGE and low > 2:
            low = max(2, low - wider)
        elif high - best <= DOF_EDGE and high < limit:
            high = min(limit, high + wider)
        else:
            break
    runner = min((v for d, v in seen.items() if d != best), default=np.inf)
    at_limit = limit - best <= DOF_EDGE
    return best, seen[best], runner, (best - low <= DOF_EDGE and low > 2) or (high - best <= DOF_EDGE and not at_limit), at_limit


def fit_dof(rows: DataFrame, beta: str = "beta", se: str = "se", pvalue: str = "pvalue", n_samples: int | None = None, sample: int = DOF_ROWS) -> dict:
    """The degrees of freedom that explain p from beta / se, over a sample by hash and the rows of largest |t|.

    Both samples are bounded and collected; the search runs on the driver.
    """
    from genomark.functions.expressions import finite

    b, s, p = F.col(beta), F.col(se), F.col(pvalue)
    used = rows.where(finite(b) & finite(s) & (s > 0) & (p > 1e-300) & (p < 0.5)).select((b / s).alias("t"), F.log10(p).alias("l"))
    # Few more rows than a sample needs pass a threshold first; else every task would send as many as a sample has.
    n = used.count()
    share = min(1.0, 1.2 * sample / max(n, 1) + 100 / max(n, 1))
    h = F.xxhash64("t", "l")
    some, tail = used, used
    if share < 0.5:
        some = used.where(h <= F.lit(int(-(2**63) + share * 2**64)))
        tail = used.where(F.abs(F.col("t")) >= used.agg(F.percentile_approx(F.abs(F.col("t")), F.lit(1 - share), F.lit(100_000))).first()[0])
    first = lambda x, whole, *by: found if len(found := x.orderBy(*by).limit(sample).toPandas()) == min(sample, n) else whole.orderBy(*by).limit(sample).toPandas()
    parts = [first(some, used, h), first(tail, used, F.abs(F.col("t")).desc(), "l")]
    if not len(parts[0]):
        return {"dof": None, "usable": False, "identified": False, "rows": 0}
    uniform, tail = (_search(x["t"].to_numpy(), x["l"].to_numpy(), n_samples) for x in parts)
    residual = max(uniform[1], dof_objective(parts[1]["t"].to_numpy(), parts[1]["l"].to_numpy(), uniform[0]))
    usable = residual <= DOF_RESIDUAL and not uniform[3] and not tail[3]
    identified = usable and uniform[0] == tail[0] and tail[2] >= 2 * tail[1]
    return {"dof": uniform[0] if usable else None, "fitted": uniform[0], "residual": residual, "usable": usable, "identified": identified, "at_model_limit": uniform[4] or tail[4], "implied_covariates": n_samples - uniform[0] if n_samples else None, "rows": len(parts[0])}
