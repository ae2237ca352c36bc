"""Tail probabilities for test statistics, on single numbers after the Spark work is done."""

from __future__ import annotations

import math


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def chi2_tail(x: float, df: int) -> float:
    """P(chi-squared with ``df`` degrees of freedom > x), by the finite sum for whole ``df``."""
    if df < 1:
        return 1.0
    if not x > 0:
        return 1.0
    half = x / 2.0
    if df % 2:
        total, shape = math.erfc(math.sqrt(half)), 0.5
    else:
        total, shape = math.exp(-half), 1.0
    while shape < df / 2.0:
        total += math.exp(shape * math.log(half) - half - math.lgamma(shape + 1.0))
        shape += 1.0
    return min(1.0, total)
