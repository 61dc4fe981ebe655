"""Matrices in long form (i, j, v): absent entries are 0. Small dense ones are solved on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest order of a matrix that is brought to the driver.
MOST = 4096
#: Rows and columns of a block of the product, as a power of two.
BLOCK_BITS = 7
#: Block sums that a task holds before it sends them on: 256 KB each.
HELD = 128


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def add(a: DataFrame, b: DataFrame, sign: int = 1) -> DataFrame:
    """a + b, or a - b with sign=-1: one union and a partial aggregation."""
    return a.select("i", "j", "v").union(b.select("i", "j", (F.col("v") * sign).alias("v"))).groupBy("i", "j").agg(F.sum("v").alias("v"))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return add(a, b, -1)


def _blocks(a: DataFrame, outer: str, inner: str, to: str) -> DataFrame:
    """Blocks of entries: _k (inner block), _<to> (outer block), and places and values as arrays. Null entries are absent."""
    low = (1 << BLOCK_BITS) - 1
    entry = F.struct(F.col(outer).bitwiseAND(low).cast("short").alias("o"), F.col(inner).bitwiseAND(low).cast("short").alias("n"), F.col("v").cast("double").alias("v"))
    blocks = a.where(F.col("v").isNotNull()).groupBy(F.shiftright(inner, BLOCK_BITS).alias("_k"), F.shiftright(outer, BLOCK_BITS).alias(f"_{to}")).agg(F.collect_list(entry).alias("e"))
    return blocks.select("_k", f"_{to}", *(F.col("e")[c].alias(f"{to}{c}") for c in "onv"))


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Matrix product by blocks that meet on their inner block.

    A task multiplies pairs of blocks, on the rows and columns that they have, and
    adds what falls on the same place before it is shuffled. Each place of a matrix
    has one entry at most; null entries are absent, and so are places without products.
    """
    size = 1 << BLOCK_BITS

    def sums(batches):
        held: dict[tuple[int, int], np.ndarray] = {}

        def out():
            for (p, q), (v, n) in held.items():
                i, j = np.nonzero(n)
                yield pd.DataFrame({"i": p * size + i, "j": q * size + j, "v": v[i, j]})
            held.clear()

        for batch in batches:
            for r in batch.itertuples(index=False):
                rows, ri = np.unique(r.io, return_inverse=True)
                cols, ci = np.unique(r.jo, return_inverse=True)
                x, y = np.zeros((2, len(rows), size)), np.zeros((2, size, len(cols)))
                x[0, ri, r.inn], x[1, ri, r.inn] = r.iv, 1
                y[0, r.jn, ci], y[1, r.jn, ci] = r.jv, 1
                total = held.setdefault((r.p, r.q), np.zeros((2, size, size)))
                total[:, rows[:, None], cols] += x @ y
                if len(held) >= HELD:
                    yield from out()
        yield from out()

    left, right = _blocks(a, "i", "j", "i"), _blocks(b, "j", "i", "j")
    pairs = left.join(right, "_k").select(F.col("_i").alias("p"), F.col("_j").alias("q"), "io", F.col("in").alias("inn"), "iv", "jo", "jn", "jv")
    return pairs.mapInPandas(sums, "i bigint, j bigint, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def triangular(a: DataFrame) -> DataFrame:
    """One row, ``kind``: 0 no, 1 lower, 2 upper, 3 diagonal (exact zeros)."""
    above = F.coalesce(F.max(((F.col("j") > F.col("i")) & (F.col("v") != 0)).cast("int")), F.lit(0))
    below = F.coalesce(F.max(((F.col("j") < F.col("i")) & (F.col("v") != 0)).cast("int")), F.lit(0))
    return a.agg(((1 - above) + 2 * (1 - below)).alias("kind"))


def to_array(a: DataFrame, rows: int, cols: int | None = None) -> np.ndarray:
    """Dense array on the driver, of at most MOST rows and columns."""
    cols = rows if cols is None else cols
    if max(rows, cols) > MOST:
        raise ValueError(f"more than {MOST} rows or columns")
    out = np.zeros((rows, cols))
    got = a.select("i", "j", "v").toArrow()
    out[got["i"].to_numpy(), got["j"].to_numpy()] = got["v"].to_numpy()
    return out


def from_array(spark, a: np.ndarray) -> DataFrame:
    i, j = np.indices(a.shape)
    return spark.createDataFrame(pa.table({"i": i.ravel().astype(np.int64), "j": j.ravel().astype(np.int64), "v": np.asarray(a, float).ravel()}))


def invert(a: np.ndarray) -> np.ndarray:
    """Inverse; raises ValueError for a matrix that isn't square or is singular."""
    if a.ndim != 2 or a.shape[0] != a.shape[1]:
        raise ValueError("matrix isn't square")
    scale = np.abs(a).max(initial=0.0)
    if scale == 0 or np.linalg.matrix_rank(a) < len(a):
        raise ValueError("singular matrix")
    return np.linalg.inv(a)


def inverse(a: DataFrame, n: int) -> DataFrame:
    return from_array(a.sparkSession, invert(to_array(a, n)))


def determinant(a: DataFrame, n: int) -> tuple[float, float, float]:
    """(determinant, its sign, log of its size)."""
    dense = to_array(a, n)
    sign, log = np.linalg.slogdet(dense)
    return float(np.linalg.det(dense)), float(sign), float(log)


def factors(a: DataFrame, n: int) -> tuple[float, np.ndarray | None, np.ndarray, int]:
    """(determinant, packed LU, permutation, swaps). A singular matrix has determinant 0 and no factors."""
    dense = to_array(a, n)
    try:
        packed, order, swaps = lu(dense)
    except ValueError:
        return 0.0, None, np.arange(n), 0
    return float(np.prod(np.diag(packed)) * (-1) ** swaps), packed, order, swaps


def lu(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(packed LU, permutation, swaps) with partial pivoting."""
    a, n = np.array(a, float), len(a)
    order, swaps = np.arange(n), 0
    for k in range(n):
        p = k + int(np.argmax(np.abs(a[k:, k])))
        if a[p, k] == 0:
            raise ValueError("singular matrix")
        if p != k:
            a[[k, p]], order[[k, p]], swaps = a[[p, k]], order[[p, k]], swaps + 1
        a[k + 1 :, k] /= a[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :])
    return a, order, swaps


def solve_lu(packed: np.ndarray, order: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x with A x = b, from lu(A)."""
    x = np.array(b, float)[order]
    for i in range(len(packed)):
        x[i] -= packed[i, :i] @ x[:i]
    for i in reversed(range(len(packed))):
        x[i] = (x[i] - packed[i, i + 1 :] @ x[i + 1 :]) / packed[i, i]
    return x


@dataclass(frozen=True)
class Matrix:
    """Entries with a shape. Operands whose shapes don't fit raise ValueError before any job runs."""

    entries: DataFrame
    rows: int
    cols: int

    def _alike(self, other: Matrix) -> None:
        if (self.rows, self.cols) != (other.rows, other.cols):
            raise ValueError(f"shapes differ: {self.rows} x {self.cols} and {other.rows} x {other.cols}")

    def _square(self) -> int:
        if self.rows != self.cols:
            raise ValueError("matrix isn't square")
        return self.rows

    def __add__(self, other: Matrix) -> Matrix:
        self._alike(other)
        return Matrix(add(self.entries, other.entries), self.rows, self.cols)

    def __sub__(self, other: Matrix) -> Matrix:
        self._alike(other)
        return Matrix(subtract(self.entries, other.entries), self.rows, self.cols)

    def __matmul__(self, other: Matrix) -> Matrix:
        if self.cols != other.rows:
            raise ValueError(f"{self.cols} columns meet {other.rows} rows")
        return Matrix(multiply(self.entries, other.entries), self.rows, other.cols)

    __mul__ = __matmul__

    @property
    def T(self) -> Matrix:
        return Matrix(transpose(self.entries), self.cols, self.rows)

    def inverse(self) -> Matrix:
        return Matrix(inverse(self.entries, self._square()), self.rows, self.cols)

    def det(self) -> tuple[float, np.ndarray | None, np.ndarray, int]:
        """As factors()."""
        return factors(self.entries, self._square())
