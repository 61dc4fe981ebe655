"""Cross-validation and parameter search on the Gram matrices of the folds: one scan for any number of models."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabstat.operators.regression import Regression, RidgeRegression
from tabstat.operators.split import folds
from tabstat.plans.gram import Gram, moments

METRICS = ("mse", "mae", "r2")


@dataclass
class Scores:
    scores: list[float]
    mean: float = field(init=False)
    sd: float = field(init=False)

    def __post_init__(self):
        self.mean, self.sd = float(np.mean(self.scores)), float(np.std(self.scores, ddof=1))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, float(s)) for i, s in enumerate(self.scores)], "fold int, score double")


class Folds:
    """Rows dealt into k folds once, with the moments of each fold."""

    def __init__(self, df: DataFrame, features: Sequence[str], target: str, key: str, k: int = 5, seed: int | None = None):
        self.features, self.target, self.k = list(features), target, k
        self.rows = folds(df.dropna(subset=[*features, target]), key, k, seed)
        self.grams: dict[int, Gram] = moments(self.rows, [*features, target], by="fold")
        total = self.grams[0]
        for i in range(1, k):
            total = total + self.grams[i]
        self.total = total

    def score(self, models: Sequence[Regression], metric: str = "mse") -> list[Scores]:
        """Scores of each model. Squared errors follow from the moments; absolute ones take one more scan for all models."""
        if metric not in METRICS:
            raise ValueError(f"unknown metric {metric!r}")
        fits = [[m.from_gram(self.total - self.grams[i]) for i in range(self.k)] for m in models]
        if metric == "mae":
            return self._absolute(fits)
        out = []
        for fit in fits:
            scores = []
            for i, (a, b) in enumerate(fit):
                g = self.grams[i]
                bias = g.mean[-1] - a - g.mean[:-1] @ b
                rss = g.centred[-1, -1] - 2 * b @ g.centred[:-1, -1] + b @ g.centred[:-1, :-1] @ b + g.n * bias**2
                scores.append(rss / g.n if metric == "mse" else 1 - rss / g.centred[-1, -1])
            out.append(Scores([float(s) for s in scores]))
        return out

    def _absolute(self, fits) -> list[Scores]:
        out = []
        for low in range(0, len(fits), 50):
            part = fits[low : low + 50]
            sums = []
            for m, fit in enumerate(part):
                gap = F.lit(None).cast("double")
                for i, (a, b) in enumerate(fit):
                    guess = sum((F.col(c) * F.lit(float(w)) for c, w in zip(self.features, b, strict=True)), F.lit(float(a)))
                    gap = F.when(F.col("fold") == i, F.abs(F.col(self.target) - guess)).otherwise(gap)
                sums.append(F.avg(gap).alias(f"m{m}"))
            found = {r.fold: r for r in self.rows.groupBy("fold").agg(*sums).collect()}
            out += [Scores([found[i][f"m{m}"] for i in range(self.k)]) for m in range(len(part))]
        return out


def cross_validation(model: Regression, df: DataFrame, features: Sequence[str], target: str, key: str, k: int = 5, metric: str = "mse", seed: int | None = None) -> Scores:
    return Folds(df, features, target, key, k, seed).score([model], metric)[0]


@dataclass
class Search:
    best: dict[str, float]
    score: float
    history: list[tuple[dict[str, float], float]]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.history, "params map<string,double>, score double")


def combinations(grid: dict[str, Sequence[float]]) -> list[dict[str, float]]:
    """All combinations; the last parameter varies fastest."""
    return [dict(zip(grid, map(float, v), strict=True)) for v in itertools.product(*grid.values())]


def _search(model, points, df, features, target, key, k, metric, seed) -> Search:
    if not points:
        raise ValueError("nothing to search")
    scores = Folds(df, features, target, key, k, seed).score([model.create(p) for p in points], metric)
    history = [(p, s.mean) for p, s in zip(points, scores, strict=True)]
    better = max if metric == "r2" else min
    best = better(history, key=lambda x: x[1])
    return Search(best[0], best[1], history)


def grid_search(model: Regression, df: DataFrame, features: Sequence[str], target: str, key: str, grid: dict[str, Sequence[float]], k: int = 5, metric: str = "mse", seed: int | None = None) -> Search:
    """Best combination by mean score; the first of equals. All are compared on the same folds."""
    return _search(model, combinations(grid), df, features, target, key, k, metric, seed)


def random_search(model: Regression, df: DataFrame, features: Sequence[str], target: str, key: str, ranges: dict[str, Sequence], k: int = 5, metric: str = "mse", n_iter: int = 50, seed: int = 0, fold_seed: int | None = None) -> Search:
    """ranges: (value,), (low, high) for a uniform draw, (low, high, "log") for a log-uniform one, or (low, high, "int")."""
    rng, points = np.random.default_rng(seed), []
    for _ in range(n_iter):
        p = {}
        for name, r in ranges.items():
            if len(r) == 1:
                p[name] = float(r[0])
            elif len(r) == 3 and r[2] == "log":
                p[name] = float(10 ** rng.uniform(math.log10(r[0]), math.log10(r[1])))
            elif len(r) == 3 and r[2] == "int":
                p[name] = float(rng.integers(r[0], r[1], endpoint=True))
            else:
                p[name] = float(rng.uniform(r[0], r[1]))
        points.append(p)
    return _search(model, points, df, features, target, key, k, metric, fold_seed)


def optimal_lambda(df: DataFrame, features: Sequence[str], target: str, key: str, start: float, end: float, n: int, model: Regression | None = None, k: int = 5, seed: int | None = None) -> Search:
    """Grid search over n values of lam between start and end, evenly spaced in logarithm."""
    return grid_search(model or RidgeRegression(), df, features, target, key, {"lam": np.logspace(math.log10(start), math.log10(end), n).tolist()}, k, "mse", seed)
