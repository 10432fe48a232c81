"""Closed-form statistics as columns over sufficient statistics.

Undefined values (empty groups, zero variance) are null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import special
from ..functions.special import Spark

Z95, Z90 = 1.959963984540054, 1.6448536269514722


def ratio(x, n) -> Column:
    """x / n, null for n = 0."""
    return F.try_divide(F.col(x).cast("double") if isinstance(x, str) else x.cast("double"), F.col(n).cast("double") if isinstance(n, str) else n.cast("double"))


def wilson(x: str, n: str, z: float = Z95) -> tuple[Column, Column]:
    """Wilson limits of x successes among n; (0, 1) for n = 0."""
    p, m, k = ratio(x, n), F.col(n).cast("double"), z * z
    scale = 1 + k / F.nullif(m, F.lit(0.0))
    centre = (p + k / (2 * F.nullif(m, F.lit(0.0)))) / scale
    half = z * F.sqrt(p * (1 - p) / F.nullif(m, F.lit(0.0)) + k / (4 * F.nullif(m * m, F.lit(0.0)))) / scale
    return F.coalesce(F.greatest(F.lit(0.0), centre - half), F.lit(0.0)), F.coalesce(F.least(F.lit(1.0), centre + half), F.lit(1.0))


def newcombe(xa: str, na: str, xb: str, nb: str, z: float = Z90) -> tuple[Column, Column]:
    """Newcombe limits of the difference of two proportions; (-1, 1) if either group is empty."""
    pa, pb = ratio(xa, na), ratio(xb, nb)
    (la, ua), (lb, ub) = wilson(xa, na, z), wilson(xb, nb, z)
    d = pa - pb
    low = d - F.sqrt((pa - la) * (pa - la) + (ub - pb) * (ub - pb))
    high = d + F.sqrt((ua - pa) * (ua - pa) + (pb - lb) * (pb - lb))
    return F.coalesce(low, F.lit(-1.0)), F.coalesce(high, F.lit(1.0))


def p_two_sided(z: str) -> Column:
    return F.expr(special.normal_two_sided(Spark, z))


def p_upper(z: str) -> Column:
    return F.expr(special.normal_upper(Spark, z))


def p_chi2(x: str, df: int) -> Column:
    return F.expr(special.chi2_upper(Spark, df, x))


def p_f(f: str, d1: str, d2: str) -> Column:
    return F.expr(special.f_upper(Spark, f, d1, d2))
