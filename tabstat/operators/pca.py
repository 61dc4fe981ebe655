"""Principal components from one covariance pass."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabstat.plans.gram import moments


class PCA:
    """k components; with k=None, as many as explain ``share`` of the variance."""

    def __init__(self, k: int | None = None, share: float = 0.95):
        self.wanted, self.share = k, share

    def fit(self, df: DataFrame, columns: Sequence[str]) -> PCA:
        g = moments(df, columns)
        values, vectors = np.linalg.eigh(g.centred / g.n)
        order = np.argsort(values)[::-1]
        values, vectors = np.maximum(values[order], 0.0), vectors[:, order]
        # The sign of a component is free: its largest loading is made positive.
        vectors *= np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
        ratio = values / values.sum()
        enough = np.flatnonzero(np.cumsum(ratio) >= self.share - 1e-12)
        self.k = self.wanted or int(enough[0]) + 1
        if not 1 <= self.k <= len(values):
            raise ValueError("k must be between 1 and the number of columns")
        self.columns, self.mean = list(columns), g.mean
        self.eigenvalues, self.ratio, self.vectors = values[: self.k], ratio[: self.k], vectors[:, : self.k]
        return self

    def transform(self, df: DataFrame, center: bool = True) -> DataFrame:
        """df with pc1..pck: projections of the columns less the training means."""
        terms = [F.col(c) - F.lit(float(m)) if center else F.col(c) for c, m in zip(self.columns, self.mean, strict=True)]
        return df.select("*", *(sum((t * F.lit(float(w)) for t, w in zip(terms, self.vectors[:, j], strict=True)), F.lit(0.0)).alias(f"pc{j + 1}") for j in range(self.k)))

    def fit_transform(self, df: DataFrame, columns: Sequence[str]) -> DataFrame:
        return self.fit(df, columns).transform(df)

    def summary(self, spark) -> DataFrame:
        """(component, eigenvalue, ratio)."""
        return spark.createDataFrame([(j + 1, float(v), float(r)) for j, (v, r) in enumerate(zip(self.eigenvalues, self.ratio, strict=True))], "component int, eigenvalue double, ratio double")
