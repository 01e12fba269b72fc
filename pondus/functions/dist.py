"""Scalar distribution tails on the driver (one number per variable or pair).

Normal tails from ``math.erfc``; Student t through the regularised incomplete beta
function evaluated by its continued fraction (Lentz's method), and from ``LARGE`` degrees
of freedom on, where that loses digits, through Hill's expansion in normal deviates (CACM
algorithm 395), whose error is of the order of dof**-6, far below double precision there.
"""

from __future__ import annotations

import math


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def norm_two_sided_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


LARGE = 1e4


def _hill(t: float, dof: float) -> float:
    """The normal deviate with the same upper tail as t."""
    a = dof - 0.5
    w, b = a * math.log1p(t * t / dof), 48.0 * a * a
    root = math.sqrt(w)
    return root * (1 + (w + 3) / b - (((4 * w + 33) * w + 240) * w + 855) / (10 * b * (b + 0.8 * w * w + 100)))


def _fraction(a: float, b: float, x: float, eps: float = 3e-16) -> float:
    """The continued fraction of I_x(a, b), for x below its mean."""
    tiny = 1e-300
    off_zero = lambda v: v if abs(v) > tiny else tiny
    c, d = 1.0, 1.0 / off_zero(1.0 - (a + b) * x / (a + 1.0))
    h, m = d, 0
    while True:
        m += 1
        before = h
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / off_zero(1.0 + term * d)
            c = off_zero(1.0 + term / c)
            h *= d * c
        if abs(h - before) <= eps * abs(h) or m >= 100_000:
            return h


def _log_gamma_half_step(a: float) -> float:
    """ln Γ(a + 1/2) − ln Γ(a).  The difference of two large logarithms loses digits, so
    from a = 50 on it is the asymptotic series (next term below 1e-17 there)."""
    if a < 50:
        return math.lgamma(a + 0.5) - math.lgamma(a)
    u = 1.0 / (a * a)
    return 0.5 * math.log(a) - (1 / 8 - u * (1 / 192 - u * (1 / 640 - u * (17 / 14336 - u * 31 / 18432)))) / a


def t_sf(t: float, dof: float) -> float:
    """P(T > t) for Student t with ``dof`` degrees of freedom."""
    if math.isinf(t):
        return 0.0 if t > 0 else 1.0
    if dof >= LARGE:
        tail = norm_sf(_hill(abs(t), dof))
        return tail if t > 0 else 1.0 - tail
    a, r = dof / 2.0, t * t / dof
    x, y = 1.0 / (1.0 + r), r / (1.0 + r)
    if y == 0.0:
        return 0.5
    scale = math.exp(_log_gamma_half_step(a) - 0.5 * math.log(math.pi) - a * math.log1p(r) + 0.5 * math.log(y))
    if x < (a + 1.0) / (a + 2.5):
        tail = 0.5 * scale * _fraction(a, 0.5, x) / a
    else:
        tail = 0.5 * (1.0 - scale * _fraction(0.5, a, y) / 0.5)
    return tail if t > 0 else 1.0 - tail


def t_two_sided_p(t: float, dof: float) -> float:
    return min(1.0, 2.0 * t_sf(abs(t), dof))


def t_ppf(q: float, dof: float) -> float:
    """Quantile of Student t: the tail is bisected in a bracket widened until it holds the
    root (``dof`` below 1 has very far quantiles)."""
    if q == 0.5:
        return 0.0
    if q < 0.5:
        return -t_ppf(1.0 - q, dof)
    target, hi = 1.0 - q, 1.0
    if target <= 0.0:
        return math.inf
    while t_sf(hi, dof) > target:
        hi *= 2.0
    lo = 0.0 if hi == 1.0 else hi / 2.0
    while True:
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            return mid
        if t_sf(mid, dof) > target:
            lo = mid
        else:
            hi = mid
