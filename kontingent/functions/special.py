"""Distribution functions in plain Python: chi-squared, non-central chi-squared, power."""

from __future__ import annotations

import math

LN2 = math.log(2.0)


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def normal_quantile(p: float) -> float:
    """Inverse of the normal distribution function, by bisection."""
    lo, hi = -40.0, 40.0
    for _ in range(120):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - normal_sf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 0.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return min(1.0, total * scale)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return max(0.0, 1 - scale * h)


def chi2_sf(x: float, df: float) -> float:
    """P(X > x); 1 where x or df is not positive."""
    if x <= 0 or df <= 0:
        return 1.0
    if x < df / 2 + 1:
        return 1 - gamma_p(df / 2, x / 2)
    return _gamma_q(df / 2, x / 2)


def _gamma_q(a: float, x: float) -> float:
    if x < a + 1:
        return 1 - gamma_p(a, x)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    log = a * math.log(x) - x - math.lgamma(a)
    return math.exp(log) * h if log > -745 else 0.0


def chi2_cdf(x: float, df: float) -> float:
    return gamma_p(df / 2, x / 2) if x > 0 and df > 0 else 0.0


def chi2_critical(alpha: float, df: float) -> float:
    """The value exceeded with probability alpha."""
    if df <= 0:
        return 0.0
    lo, hi = 0.0, df + 10.0
    while chi2_sf(hi, df) > alpha:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_sf(mid, df) > alpha else (lo, mid)
    return (lo + hi) / 2


def noncentral_chi2_cdf(x: float, df: float, shift: float) -> float:
    """Poisson mixture of central distributions, summed outwards from its mode."""
    if x <= 0:
        return 0.0
    if shift <= 0:
        return chi2_cdf(x, df)
    half = shift / 2
    mode = int(half)
    log_weight = lambda k: k * math.log(half) - half - math.lgamma(k + 1)
    total = 0.0
    for direction in (1, -1):
        k = mode if direction == 1 else mode - 1
        while k >= 0:
            w = math.exp(log_weight(k))
            total += w * chi2_cdf(x, df + 2 * k)
            if w < 1e-17 and abs(k - mode) > 10:
                break
            k += direction
    return min(1.0, total)


def power(df: float, shift: float, alpha: float = 0.05) -> float:
    """Probability to reject at level alpha under non-centrality ``shift``; 1 without degrees of freedom."""
    if df <= 0:
        return 1.0
    return 1 - noncentral_chi2_cdf(chi2_critical(alpha, df), df, max(0.0, shift))


# Model statistics over entropies in bits --------------------------------------

def likelihood_ratio(n: float, h_model: float, h_data: float) -> float:
    return 2.0 * n * LN2 * (h_model - h_data)


def aic(lr: float, df: float) -> float:
    """LR less twice the model's own degrees of freedom."""
    return lr - 2.0 * df


def aic_delta(lr: float, ddf: float) -> float:
    """LR less twice the degrees of freedom short of the saturated model."""
    return lr - 2.0 * ddf


def bic(lr: float, ddf: float, n: float) -> float:
    return lr - ddf * math.log(n) if n > 0 else lr


def uncertainty_coefficient(h_max: float, h: float) -> float:
    return (h_max - h) / h_max if h_max > 0 else 0.0


def percent_reduction(h_max: float, h: float) -> float:
    return 100.0 * uncertainty_coefficient(h_max, h)
