"""Tables of a Chinese restaurant with discount, drawn from their exact conditional.

A dish with c customers, whose parent serves it with probability ``base`` and
whose restaurant has strength plus discount * other tables = ``room``, has t
tables with a probability proportional to

    base ** t * room (room + d) ... (room + (t - 1) d) * S_d(c, t)

where S_d are the generalised Stirling numbers, S(c + 1, t) = S(c, t - 1) +
(c - t d) S(c, t).  Up to ``TABLE`` customers they are tabulated.  Beyond, they
follow from sums of t Sibuya variables, S_d(c, t) = c! / (t! d^t) P(X_1 + ... +
X_t = c): an alternating series for few tables, a saddle point otherwise.  The
mode and deviation of t are known in closed form up to one root, so only a
window around the mode is computed, however many customers there are.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

#: Customers up to which Stirling numbers are tabulated.
TABLE = 64
#: Terms of the alternating series at most; it is tried for up to 40 or ``REACH`` * c ** d tables.
SERIES, REACH = 120, 4.0
#: Half-width of the window around the mode, in deviations, and at least so many tables.
WIDTH, LEAST = 7.0, 6


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma of positive numbers, by Stirling's series after raising the argument to 8 or more."""
    x = np.array(x, np.float64)
    down = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        if not low.any():
            break
        down[low] += np.log(x[low])
        x[low] += 1
    inv = 1 / x
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + inv * (1 / 12 - inv**2 * (1 / 360 - inv**2 * (1 / 1260 - inv**2 / 1680))) - down


@lru_cache(maxsize=64)
def stirling_table(d: float) -> np.ndarray:
    """log S_d(c, t) for c, t up to TABLE; minus infinity where t > c or t = 0 < c."""
    out = np.full((TABLE + 1, TABLE + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(1, TABLE + 1)
    for c in range(TABLE):
        with np.errstate(divide="ignore"):
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], np.log(np.maximum(c - d * t, 0)) + out[c, 1:])
    return out


def _solve(f, size: int) -> np.ndarray:
    """log u in which the increasing function f of log(-log u) changes its sign, by bisection."""
    lo, hi = np.full(size, np.log(1e-13)), np.full(size, np.log(2000.0))
    for _ in range(26):
        mid = (lo + hi) / 2
        below = f(-np.exp(mid)) < 0
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return -np.exp((lo + hi) / 2)


def _mean(y: np.ndarray, d: float) -> np.ndarray:
    """Mean of a Sibuya variable tilted by x = 1 - exp(y)."""
    return d * -np.expm1(y) * np.exp((d - 1) * y) / -np.expm1(d * y)


@lru_cache(maxsize=64)
def _tilts(d: float) -> tuple[np.ndarray, np.ndarray]:
    """log of the mean, and log(-y), on a grid."""
    v = np.linspace(np.log(1e-13), np.log(700.0 / max(1 - d, 0.02)), 4096)
    with np.errstate(over="ignore"):
        return np.log(_mean(-np.exp(v), d)), v


def _tilt(m: np.ndarray, d: float) -> np.ndarray:
    """y of the tilt that gives the mean m: from the grid, then two Newton steps."""
    grid, v = _tilts(d)
    z = np.interp(np.log(m), grid, v)
    for _ in range(2):
        y = -np.exp(z)
        now = _mean(y, d)
        slope = (1 + (1 - d) * -np.expm1(y) * np.exp(-y) - now) * np.exp(y) / np.expm1(y) * y
        z = z - np.clip((np.log(now) - np.log(m)) / np.where(slope > 1e-12, slope, 1.0), -0.1, 0.1) * (slope > 1e-12)
    return -np.exp(z)


def log_sum_probability(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log P(X_1 + ... + X_t = c) of Sibuya variables of parameter d, 1 <= t <= c, c > TABLE."""
    c, t = np.asarray(c, np.float64), np.asarray(t, np.float64)
    out = c * np.log(d)  # t = c: all ones
    few = np.flatnonzero((t <= np.maximum(40, REACH * c**d)) & (t < c))
    done = np.zeros(len(c), bool)
    if len(few):
        cc, tt = c[few], t[few]
        total, size, last = np.zeros(len(few)), np.zeros(len(few)), np.ones(len(few))
        lc, on = lgamma(cc + 1), np.arange(len(few))
        ways = np.zeros(len(few))  # log of the binomial coefficient t over j
        for j in range(1, SERIES + 1):
            on = on[(tt[on] >= j) & (last[on] > 1e-10 * np.abs(total[on])) & (cc[on] > j * d)]
            if not len(on):
                break
            ways[on] += np.log((tt[on] - j + 1) / j)
            log = ways[on] + math.lgamma(1 + j * d) + lgamma(cc[on] - j * d) - lc[on]
            with np.errstate(over="ignore"):
                term = np.exp(log)
            total[on] += (-1) ** (j + 1) * np.sin(np.pi * j * d) / np.pi * term
            size[on] += term
            last[on] = np.where(tt[on] == j, 0.0, term)
        good = (total > 1e-7 * size) & (last <= 1e-5 * total) & np.isfinite(size)
        out[few[good]] = np.log(total[good])
        done[few[good]] = True
    rest = np.flatnonzero(~done & (t < c))
    if len(rest):
        m, n, tt = c[rest] / t[rest], c[rest] - t[rest], t[rest]
        y = _tilt(m, d)
        x, f = -np.expm1(y), -np.expm1(d * y)
        k2 = m * (1 + (1 - d) * x * np.exp(-y) - m)
        lattice = n * np.log(n) - n + 0.5 * np.log(2 * np.pi * n) - lgamma(n + 1)  # near t = c the sum is all but Poisson
        out[rest] = tt * np.log(f) - c[rest] * np.log(x) - 0.5 * np.log(2 * np.pi * tt * np.maximum(k2, 1e-300)) + lattice
    return out


def log_stirling(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log S_d(c, t) for 1 <= t <= c."""
    c, t = np.asarray(c, np.int64), np.asarray(t, np.int64)
    out = np.empty(len(c))
    small = c <= TABLE
    out[small] = stirling_table(d)[c[small], t[small]]
    big = np.flatnonzero(~small)
    if len(big):
        cc, tt = c[big].astype(np.float64), t[big].astype(np.float64)
        out[big] = lgamma(cc + 1) - lgamma(tt + 1) - tt * np.log(d) + log_sum_probability(cc, tt, d)
    return out


def _draw(logits: np.ndarray, first: np.ndarray, sizes: np.ndarray, rng) -> np.ndarray:
    """An index into each run of ``logits`` (runs of ``sizes`` from ``first``), drawn in proportion to exp."""
    top = np.maximum.reduceat(logits, first)
    total = np.cumsum(np.exp(logits - np.repeat(top, sizes)))
    before = np.concatenate(([0.0], total))[first]
    ends = total[first + sizes - 1]
    at = np.searchsorted(total, before + rng.random(len(first)) * (ends - before), side="right")
    return np.clip(at - first, 0, sizes - 1)


def mode_and_deviation(c: np.ndarray, base: np.ndarray, room: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """About the mode and the deviation of t, from the tilted negative binomial number of Sibuya variables."""
    share = lambda y: 1 + base * np.expm1(d * y)
    weight = room * base
    y = _solve(lambda v: np.log(weight) + np.log(-np.expm1(v)) + (d - 1) * v - np.log(share(v)) - np.log(c), len(c))
    x, f = -np.expm1(y), -np.expm1(d * y)
    t = np.clip(room / d * base * f / share(y), 1, c)
    mean = _mean(y, d)
    own = mean * (1 + (1 - d) * x * np.exp(-y) - mean)
    spread = t / share(y)
    return t, np.sqrt(np.maximum(spread * t * own / (t * own + mean**2 * spread), 0))


def draw_tables(counts: np.ndarray, base: np.ndarray, room: np.ndarray, d: float, rng) -> np.ndarray:
    """Tables of each dish, drawn anew; base: the parent's probability of the dish; room: strength + d * other tables."""
    counts = np.asarray(counts, np.int64)
    out = np.minimum(counts, 1)
    level = np.minimum(counts, TABLE + 1).astype(np.uint8)
    some = np.flatnonzero(level > 1)
    order = some[np.argsort(level[some], kind="stable")]
    cuts = np.searchsorted(level[order], np.arange(2, TABLE + 2))
    table = stirling_table(d)
    for c in range(2, TABLE + 1):
        at = order[cuts[c - 2]: cuts[c - 1]]
        if len(at):
            t = np.arange(c)
            logits = np.cumsum(np.log(room[at, None] + d * t), axis=1) + (t + 1) * np.log(base[at, None]) + table[c, 1: c + 1]
            prob = np.cumsum(np.exp(logits - logits.max(1, keepdims=True)), axis=1)
            out[at] = 1 + (prob < rng.random(len(at))[:, None] * prob[:, -1:]).sum(1).clip(max=c - 1)
    big = order[cuts[-1]:]
    big = big[np.argsort(counts[big], kind="stable")]
    for lo in range(0, len(big), 4096):
        at = big[lo: lo + 4096]
        c, b, r = counts[at].astype(np.float64), base[at], room[at]
        t, dev = mode_and_deviation(c, b, r, d)
        first = np.maximum(1, np.floor(t - WIDTH * dev - LEAST)).astype(np.int64)
        sizes = np.minimum(counts[at], np.ceil(t + WIDTH * dev + LEAST).astype(np.int64)) - first + 1
        start = np.cumsum(sizes) - sizes
        every = np.repeat(first - start, sizes) + np.arange(int(sizes.sum()))
        cc, rr = np.repeat(c, sizes), np.repeat(r / d, sizes)
        logits = every * np.repeat(np.log(b), sizes) + lgamma(rr + every) - lgamma(every + 1.0) + log_sum_probability(cc, every, d)
        out[at] = first + _draw(logits, start, sizes, rng)
    return out
