"""Small dense algebra and tail probabilities for coefficient-sized results."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np


def uncentred(beta: np.ndarray, covariance: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and covariance for columns as they were before ``shift`` (terms, then outcome) was taken off."""
    terms = len(shift) - 1
    back = np.eye(len(beta))
    back[0, 1:terms + 1] = -shift[:terms]
    raw = back @ beta
    raw[0] += shift[terms]
    return raw, back @ covariance @ back.T


def sweep(full: np.ndarray, tol: float = 1e-12) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """Solve the normal equations held in ``full`` (regressors, then outcome).

    A column that the earlier ones explain is left out: its coefficient is 0 and ``kept`` is False. Columns are expected
    near their means, so that ``tol`` compares what is left of a column with its spread.
    Returns coefficients, inverse, residual sum of squares and ``kept``.
    """
    k = full.shape[0] - 1
    scale = np.sqrt(np.clip(np.diag(full), 0, None))
    scale[scale == 0] = 1.0
    a = full / np.outer(scale, scale)
    kept = np.zeros(k, dtype=bool)
    for j in range(k):
        pivot = a[j, j]
        if pivot <= tol:
            continue
        kept[j] = True
        column = a[:, j].copy()
        a[j, :] /= pivot
        others = np.arange(k + 1) != j
        a[others, :] -= np.outer(column[others], a[j, :])
        a[others, j] = -column[others] / pivot
        a[j, j] = 1.0 / pivot
    inverse = np.where(np.outer(kept, kept), a[:k, :k], 0.0) / np.outer(scale[:k], scale[:k])
    beta = inverse @ full[:k, k]
    beta = beta + inverse @ (full[:k, k] - full[:k, :k] @ beta)
    beta = np.where(kept, beta, 0.0)
    rss = float(full[k, k] - 2 * beta @ full[:k, k] + beta @ full[:k, :k] @ beta)
    return beta, inverse, max(rss, 0.0), kept


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz steps)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    total = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return total


def beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def two_sided_p(statistic: float, df: float | None) -> float:
    """Student t with ``df`` degrees of freedom, or normal when ``df`` is None."""
    if df is None:
        return math.erfc(abs(statistic) / math.sqrt(2))
    return beta_cdf(df / (df + statistic * statistic), df / 2, 0.5)


def critical_value(level: float, df: float | None) -> float:
    """Half-width multiplier of a two-sided interval."""
    if df is None:
        return NormalDist().inv_cdf(0.5 + level / 2)
    low, high = 0.0, 2.0
    while two_sided_p(high, df) > 1 - level:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if two_sided_p(mid, df) > 1 - level else (low, mid)
    return (low + high) / 2


def clustered(inverse: np.ndarray, meat: np.ndarray, clusters: float, n: float, rank: int) -> np.ndarray:
    """Sandwich with the usual factor for few clusters; nan when it is undefined."""
    factor = clusters / (clusters - 1) * (n - 1) / (n - rank) if clusters > 1 and n > rank else math.nan
    return factor * inverse @ meat @ inverse


def coefficient_rows(names, beta, covariance, kept, df: float | None, level: float) -> list[tuple]:
    """(term, estimate, std_error, statistic, p_value, conf_low, conf_high); None for dropped terms."""
    usable = df is None or df > 0
    width = critical_value(level, df) if usable else math.nan
    rows = []
    for i, name in enumerate(names):
        if not kept[i]:
            rows.append((name, *[None] * 6))
            continue
        est, var = float(beta[i]), float(covariance[i, i])
        se = math.sqrt(var) if usable and var >= 0 else None
        if not se:
            rows.append((name, est, se, *[None] * 4))
            continue
        t = est / se
        rows.append((name, est, se, t, two_sided_p(t, df), est - width * se, est + width * se))
    return rows


def combination_rows(names, combinations, beta: np.ndarray, covariance: np.ndarray, kept, df: float | None, level: float) -> list[tuple]:
    """Rows like those of coefficients for sums of coefficients, each given as term weights; the errors follow from the joint covariance.

    A combination that weighs a dropped term has no estimate.
    """
    weights = np.zeros((len(combinations), len(names)))
    for i, parts in enumerate(combinations.values()):
        for term, weight in parts.items():
            weights[i, names.index(term)] = weight
    usable = [all(kept[names.index(t)] for t, w in parts.items() if w) for parts in combinations.values()]
    return coefficient_rows(list(combinations), weights @ beta, weights @ covariance @ weights.T, usable, df, level)
