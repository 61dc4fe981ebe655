"""Sufficient statistics: one distributed pass to a small matrix that the driver solves."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Above this many columns the sums are made block by block in NumPy: their number grows with the square.
WIDE = 40


@dataclass
class Gram:
    """Moments of columns z (features, then any target): n, means, and the centred cross products of z."""

    columns: list[str]
    n: float
    mean: np.ndarray
    centred: np.ndarray

    def __sub__(self, other: Gram) -> Gram:
        """Moments of the rows that are in self and not in other."""
        n = self.n - other.n
        if n <= 0:
            return Gram(self.columns, 0.0, self.mean * np.nan, self.centred * np.nan)
        mean = (self.n * self.mean - other.n * other.mean) / n
        d = other.mean - mean
        e = self.mean - mean
        return Gram(self.columns, n, mean, self.centred + self.n * np.outer(e, e) - other.centred - other.n * np.outer(d, d))

    def __add__(self, other: Gram) -> Gram:
        n = self.n + other.n
        mean = (self.n * self.mean + other.n * other.mean) / n
        d, e = other.mean - mean, self.mean - mean
        return Gram(self.columns, n, mean, self.centred + self.n * np.outer(e, e) + other.centred + other.n * np.outer(d, d))

    def raw(self) -> np.ndarray:
        """Cross products about 0 with a leading column of ones."""
        k = len(self.columns)
        out = np.empty((k + 1, k + 1))
        out[0, 0] = self.n
        out[0, 1:] = out[1:, 0] = self.n * self.mean
        out[1:, 1:] = self.centred + self.n * np.outer(self.mean, self.mean)
        return out


def moments(df: DataFrame, columns: Sequence[str | Column], names: Sequence[str] | None = None, by: str | Column | None = None, weight: Column | None = None, shift: Sequence[float] | None = None) -> Gram | dict:
    """Gram of the columns, or one for each value of ``by``. Rows with a null in any column are left out.

    Values are shifted by a rough centre before they are multiplied, so that a
    large mean costs no digits. by must have few values (folds): their moments go
    to the driver.
    """
    names = list(names or columns)
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    parts = [c.cast("double").alias(f"z{i}") for i, c in enumerate(cols)]
    key = (F.col(by) if isinstance(by, str) else by) if by is not None else F.lit(0)
    rows = df.select(key.alias("k"), (weight if weight is not None else F.lit(1.0)).cast("double").alias("w"), *parts).dropna(subset=["w", *(f"z{i}" for i in range(len(parts)))])
    if shift is None:
        first = rows.agg(*(F.avg(f"z{i}") for i in range(len(parts)))).first()
        shift = [x or 0.0 for x in first]
    p = len(parts)
    at = np.array(shift, float)
    if p <= WIDE:
        z = [F.col(f"z{i}") - F.lit(float(s)) for i, s in enumerate(shift)]
        sums = [F.sum("w").alias("n"), *(F.sum(F.col("w") * z[i]).alias(f"s{i}") for i in range(p)), *(F.sum(F.col("w") * z[i] * z[j]).alias(f"q{i}_{j}") for i in range(p) for j in range(i, p))]
        found = {}
        for r in rows.groupBy("k").agg(*sums).collect():
            s = np.array([r[f"s{i}"] for i in range(p)])
            q = np.empty((p, p))
            for i in range(p):
                for j in range(i, p):
                    q[i, j] = q[j, i] = r[f"q{i}_{j}"]
            found[r.k] = (r.n, s, q)
    else:

        def block(batches):
            total: dict = {}
            for b in batches:
                for k, part in b.groupby("k"):
                    z, w = part.iloc[:, 2:].to_numpy() - at, part["w"].to_numpy()
                    old = total.get(k, (0.0, 0.0, 0.0))
                    total[k] = (old[0] + w.sum(), old[1] + w @ z, old[2] + (z * w[:, None]).T @ z)
            for k, (n, s, q) in total.items():
                i, j = np.triu_indices(p)
                yield pd.DataFrame({"k": k, "i": np.r_[-2, np.full(p, -1), i], "j": np.r_[0, np.arange(p), j], "v": np.r_[n, s, q[i, j]]})

        kind = rows.schema["k"].dataType.simpleString()
        found = {}
        for r in rows.mapInPandas(block, f"k {kind}, i int, j int, v double").groupBy("k", "i", "j").agg(F.sum("v").alias("v")).collect():
            n, s, q = found.setdefault(r.k, ([0.0], np.zeros(p), np.zeros((p, p))))
            if r.i == -2:
                n[0] = r.v
            elif r.i == -1:
                s[r.j] = r.v
            else:
                q[r.i, r.j] = q[r.j, r.i] = r.v
        found = {k: (n[0], s, q) for k, (n, s, q) in found.items()}
    out = {k: Gram(names, n, at + s / n, q - np.outer(s, s) / n) for k, (n, s, q) in found.items() if n}
    if by is not None:
        return out
    return out.get(0, Gram(names, 0.0, np.full(p, np.nan), np.full((p, p), np.nan)))


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a x = b after scaling to a unit diagonal; raises on a singular matrix."""
    scale = np.sqrt(np.abs(np.diag(a)))
    if len(scale) and (not np.all(np.isfinite(scale)) or np.any(scale == 0)):
        raise ValueError("singular matrix")
    u = a / np.outer(scale, scale)
    if len(scale) and np.linalg.cond(u) > 1e14:
        raise ValueError("singular matrix")
    side = scale if b.ndim == 1 else scale[:, None]
    return np.linalg.solve(u, b / side) / side
