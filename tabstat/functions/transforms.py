"""Distribution transforms as column expressions; values outside the domain give null."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def log(x: Column) -> Column:
    return F.when(x > 0, F.log(x))


def box_cox(x: Column, lam: float) -> Column:
    return F.when(x > 0, F.log(x) if lam == 0 else (F.pow(x, F.lit(lam)) - 1) / lam)


def yeo_johnson(x: Column, lam: float) -> Column:
    up = F.log1p(x) if lam == 0 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if lam == 2 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).when(x < 0, down)


def power(x: Column, lam: float) -> Column:
    """x ** lam; null for a negative base with a fractional power, and for 0 with a negative one."""
    out = F.pow(x, F.lit(float(lam)))
    if not float(lam).is_integer():
        out = F.when(x >= 0, out)
    return F.when(x != 0, out) if lam < 0 else out


def clipped(p: Column) -> Column:
    """A probability kept off 0 and 1, for logarithms."""
    return F.greatest(F.least(p, F.lit(1 - 1e-15)), F.lit(1e-15))


LOG_2PI = math.log(2 * math.pi)
