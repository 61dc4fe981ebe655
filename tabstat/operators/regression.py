"""Linear, generalised, ridge, lasso, elastic-net and stepwise regression on one Gram matrix."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabstat.operators import inference, stats
from tabstat.plans import dist
from tabstat.plans.gram import Gram, moments, solve

#: Rows from which t and p values of coefficients are given.
ENOUGH = 30


def significance(p: float) -> str:
    return next((s for s, most in (("***", 0.001), ("**", 0.01), ("*", 0.05), (".", 0.1)) if p < most), "")


@dataclass
class Model:
    """Fitted coefficients: names and beta, with the intercept first if there is one."""

    features: list[str]
    target: str
    intercept: float
    coef: np.ndarray
    has_intercept: bool = True
    stderr: np.ndarray | None = None
    stats: dict[str, float] = field(default_factory=dict)
    vif: np.ndarray | None = None
    cov: np.ndarray | None = None
    iterations: int = 0

    @property
    def names(self) -> list[str]:
        return [*(["intercept"] if self.has_intercept else []), *self.features]

    @property
    def beta(self) -> np.ndarray:
        return np.append([self.intercept] if self.has_intercept else [], self.coef)

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """df with the prediction: a column expression with literal coefficients."""
        used = [(F.col(c), float(b)) for c, b in zip(self.features, self.coef, strict=True) if b != 0]
        return df.withColumn(name, sum((c * F.lit(b) for c, b in used), F.lit(float(self.intercept))))

    def _tests(self) -> list[tuple]:
        """(name, beta, stderr, t, p, stars) of each coefficient; None where a model has no such statistics."""
        rows = []
        for i, (name, b) in enumerate(zip(self.names, self.beta, strict=True)):
            se = None if self.stderr is None or math.isnan(self.stderr[i]) else float(self.stderr[i])
            t = b / se if se and self.stats.get("n", 0) > ENOUGH else None
            p = None if t is None else dist.normal_p_value(t)
            rows.append((name, float(b), se, None if t is None else float(t), p, None if p is None else significance(p)))
        return rows

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """(name, beta, stderr, t_stat, p_value, sig); null where a model has no such statistics."""
        return spark.createDataFrame(self._tests(), "name string, beta double, stderr double, t_stat double, p_value double, sig string")

    def statistics(self, spark: SparkSession) -> DataFrame:
        """(name, value) of the model's statistics, by name."""
        return spark.createDataFrame([(k, None if v is None else float(v)) for k, v in self.stats.items()], "name string, value double")

    def summary(self, detailed: bool = True) -> str:
        """The report as text: coefficients with their tests, then statistics. Without detail, coefficients of 0 are left out."""
        lines = [f"{self.target} on {', '.join(self.features)}", f"{'':>24} {'beta':>14} {'stderr':>14} {'t':>10} {'p':>10}"]
        for name, b, se, t, p, stars in self._tests():
            if detailed or b != 0:
                cells = (f"{x:{width}.{digits}g}" if x is not None else " " * width for x, width, digits in ((se, 14, 6), (t, 10, 4), (p, 10, 3)))
                lines.append(f"{name:>24} {b:14.6g} {' '.join(cells)} {stars or ''}".rstrip())
        return "\n".join([*lines, *(f"{k:>24} {v:14.6g}" for k, v in self.stats.items() if v is not None)])


class Regression:
    """fit = solve + statistics. Subclasses give coefficients of centred moments and effective degrees of freedom.

    Rows with a null in a feature or the target are left out. A subclass of one's
    own needs only ``solve_centred``; ``create`` makes searches possible.
    """

    params: tuple[str, ...] = ()

    def create(self, values: dict[str, float]) -> Regression:
        if not self.params:
            raise NotImplementedError(f"{type(self).__name__} has no parameters to search")
        return type(self)(**{k: values[k] for k in self.params})

    def solve_centred(self, g: Gram) -> np.ndarray:
        raise NotImplementedError

    def effective_df(self, g: Gram, coef: np.ndarray) -> float:
        return float(np.sum(np.abs(coef) > 1e-10))

    def from_gram(self, g: Gram) -> tuple[float, np.ndarray]:
        """(intercept, coefficients) from the moments of features and target."""
        coef = self.solve_centred(g)
        return float(g.mean[-1] - g.mean[:-1] @ coef), coef

    def gram(self, df: DataFrame, features: Sequence[str], target: str) -> Gram:
        return moments(df, [*features, target])

    def fit_without_stats(self, df: DataFrame, features: Sequence[str], target: str) -> Model:
        a, b = self.from_gram(self.gram(df, features, target))
        return Model(list(features), target, a, b)

    def fit(self, df: DataFrame, features: Sequence[str], target: str, order_by: Sequence[str] = ()) -> Model:
        g = self.gram(df, features, target)
        a, b = self.from_gram(g)
        model = Model(list(features), target, a, b)
        model.stderr = np.full(len(b) + 1, math.nan)
        rows = residuals(model, df)
        fit = fit_measures(rows, target)
        df_ = self.effective_df(g, b)
        log_lik = -g.n / 2 * (math.log(2 * math.pi * fit["mse"]) + 1)
        model.stats = {"n": g.n, "r2": fit["r2"], "r2_adj": stats.r_adjusted(fit["r2"], int(g.n), len(b)), "df": df_, "mse": fit["mse"], "rmse": fit["rmse"], "mae": fit["mae"], "aic": stats.aic(df_, log_lik), "bic": stats.bic(df_, log_lik, int(g.n)), **({"rho": durbin(rows, order_by)} if order_by else {}), **residual_stats(rows)}
        return model


def residuals(model: Model, df: DataFrame) -> DataFrame:
    """Rows that took part in the fit, with _p and _e."""
    rows = df.dropna(subset=[*model.features, model.target])
    return stats.with_residuals(model.predict(rows, "_p"), model.target, "_p", "_e")


def fit_measures(rows: DataFrame, target: str) -> dict[str, float]:
    r = rows.agg(stats.r_squared(target, "_p").alias("r2"), stats.mse(target, "_p").alias("mse"), stats.mae(target, "_p").alias("mae")).first()
    return {"r2": r.r2, "mse": r.mse, "rmse": math.sqrt(r.mse), "mae": r.mae}


def residual_stats(rows: DataFrame) -> dict[str, float]:
    r = stats.residual_summary(rows, "_e").first()
    return {f"residual_{k}": r[k] for k in ("mean", "sd", "max_abs", "q1", "q2", "q3")}


def durbin(rows: DataFrame, order_by: Sequence[str]) -> float:
    return stats.durbin_watson(rows, "_e", order_by).first()[0]


class LinearRegression(Regression):
    """Ordinary least squares; weighted by 1 / ``variance`` (a column with the diagonal of Omega) if given.

    covariance: classical, HC3, HAC (needs order_by in fit) or cluster (needs the
    column). With variance, residuals are weighted in sigma squared as well.
    """

    def __init__(self, covariance: str = "classical", cluster: str | None = None, variance: str | None = None, intercept: bool = True):
        if covariance not in inference.KINDS:
            raise ValueError(f"unknown covariance {covariance!r}")
        self.covariance, self.cluster, self.variance, self.intercept = covariance, cluster, variance, intercept

    def gram(self, df, features, target):
        return moments(df, [*features, target], weight=None if self.variance is None else 1 / F.col(self.variance))

    def solve_centred(self, g):
        k = len(g.columns) - 1
        return solve(g.centred[:k, :k], g.centred[:k, k])

    def from_gram(self, g):
        if self.intercept:
            return super().from_gram(g)
        raw = g.raw()[1:, 1:]
        return 0.0, solve(raw[:-1, :-1], raw[:-1, -1])

    def effective_df(self, g, coef):
        return float(len(coef))

    def fit_without_stats(self, df, features, target):
        a, b = self.from_gram(self.gram(df, features, target))
        return Model(list(features), target, a, b, self.intercept)

    def fit(self, df: DataFrame, features: Sequence[str], target: str, order_by: Sequence[str] = ()) -> Model:
        g = self.gram(df, features, target)
        a, b = self.from_gram(g)
        model = Model(list(features), target, a, b, self.intercept)
        rows = residuals(model, df)
        weight = F.lit(1.0) if self.variance is None else 1 / F.col(self.variance)
        n, rss = rows.agg(F.count("*"), F.sum(weight * F.col("_e") * F.col("_e"))).first()
        raw = g.raw()[:-1, :-1] if self.intercept else g.raw()[1:-1, 1:-1]
        inverse = solve(raw, np.eye(len(raw)))
        p, k = len(raw), len(features)
        if self.covariance == "classical":
            model.cov = rss / (n - p) * inverse
        else:
            model.cov = inverse @ inference.meat(rows, features, "_e", inverse, self.covariance, n=n, intercept=self.intercept, cluster=self.cluster, order_by=order_by) @ inverse
        model.stderr = np.sqrt(np.diag(model.cov))
        fit = fit_measures(rows, target)
        robust = self.covariance != "classical" and self.intercept
        f = inference.fisher_test(fit["r2"], k, n - p, model.beta, model.cov, self.covariance if robust else "classical")
        model.vif = inference.vif(moments(df.dropna(subset=[*features, target]), features) if self.variance else g, k)
        lm, lm_p = inference.breusch_pagan(rows, features, "_e")
        model.stats = {"n": n, "r2": fit["r2"], "r2_adj": stats.r_adjusted(fit["r2"], n, k) if k > 0 else -1.0, "mse": fit["mse"], "rmse": fit["rmse"], "mae": fit["mae"], "f": f, "f_p": dist.f_p_value(f, k, n - p), **({"rho": durbin(rows, order_by)} if order_by else {}), "bp_lm": lm, "bp_p": lm_p, **residual_stats(rows), **({f"vif_{c}": v for c, v in zip(features, model.vif, strict=True)} if k > 1 else {})}
        return model


class RidgeRegression(Regression):
    """Least squares with lam * |beta|**2 added; the intercept is free."""

    params = ("lam",)

    def __init__(self, lam: float = 1.0):
        self.lam = lam

    def solve_centred(self, g):
        k = len(g.columns) - 1
        return solve(g.centred[:k, :k] + self.lam * np.eye(k), g.centred[:k, k])

    def effective_df(self, g, coef):
        s = g.centred[: len(coef), : len(coef)]
        return float(np.trace(solve(s + self.lam * np.eye(len(coef)), s)))


class ElasticNetRegression(Regression):
    """RSS / (2 n) + alpha * l1_ratio * |beta|_1 + alpha * (1 - l1_ratio) / 2 * |beta|**2, by coordinate descent on the Gram matrix."""

    params = ("alpha", "l1_ratio")

    def __init__(self, alpha: float = 0.1, l1_ratio: float = 0.5, max_iter: int = 100_000, tolerance: float = 1e-10):
        self.alpha, self.l1_ratio, self.max_iter, self.tolerance = alpha, l1_ratio, max_iter, tolerance

    def solve_centred(self, g):
        k = len(g.columns) - 1
        s, c = g.centred[:k, :k] / g.n, g.centred[:k, k] / g.n
        first, second = self.alpha * self.l1_ratio, self.alpha * (1 - self.l1_ratio)
        beta, width = np.zeros(k), np.sqrt(np.diag(s))
        self.converged = False
        for _ in range(self.max_iter):
            most = 0.0
            for j in range(k):
                if s[j, j] == 0:
                    continue
                rest = c[j] - s[j] @ beta + s[j, j] * beta[j]
                new = math.copysign(max(abs(rest) - first, 0.0), rest) / (s[j, j] + second)
                most = max(most, abs(new - beta[j]) * width[j])
                beta[j] = new
            if most <= self.tolerance * max(1.0, float(np.sqrt(g.centred[k, k] / g.n))):
                self.converged = True
                break
        return beta

    def effective_df(self, g, coef):
        active = np.flatnonzero(np.abs(coef) > 1e-10)
        if not len(active):
            return 0.0
        s = g.centred[np.ix_(active, active)]
        return float(np.trace(solve(s + self.alpha * (1 - self.l1_ratio) * np.eye(len(active)), s)))


class LassoRegression(ElasticNetRegression):
    """RSS / (2 n) + lam * |beta|_1."""

    params = ("lam",)

    def __init__(self, lam: float = 0.1, max_iter: int = 100_000, tolerance: float = 1e-10):
        super().__init__(lam, 1.0, max_iter, tolerance)
        self.lam = lam

    def effective_df(self, g, coef):
        return float(np.sum(np.abs(coef) > 1e-10))


class StepwiseRegression(Regression):
    """Forward, backward or stepwise choice of features by p value (alpha), AIC or BIC.

    Every candidate model is a part of one Gram matrix, so the data are read once.
    """

    def __init__(self, method: str = "backward", criterion: str = "alpha", alpha_in: float = 0.05, alpha_out: float = 0.05):
        if method not in ("forward", "backward", "stepwise") or criterion not in ("alpha", "aic", "bic"):
            raise ValueError("unknown method or criterion")
        self.method, self.criterion, self.alpha_in, self.alpha_out = method, criterion, alpha_in, alpha_out

    def _rss(self, g: Gram, chosen: Sequence[int]) -> float:
        k = len(g.columns) - 1
        if not chosen:
            return float(g.centred[k, k])
        at = list(chosen)
        return float(g.centred[k, k] - g.centred[at, k] @ solve(g.centred[np.ix_(at, at)], g.centred[at, k]))

    def _score(self, g: Gram, chosen: Sequence[int]) -> float:
        k = len(chosen) + 1
        return g.n * math.log(self._rss(g, chosen) / g.n) + (2 * k if self.criterion == "aic" else k * math.log(g.n))

    def _partial_p(self, g: Gram, small: Sequence[int], large: Sequence[int]) -> float:
        rest = g.n - len(large) - 1
        rss = self._rss(g, large)
        return dist.f_p_value((self._rss(g, small) - rss) / (rss / rest), 1, rest)

    def _add(self, g: Gram, chosen: list[int], barred: set[int]) -> int | None:
        left = [j for j in range(len(g.columns) - 1) if j not in chosen and j not in barred]
        if not left:
            return None
        if self.criterion == "alpha":
            p, j = min((self._partial_p(g, chosen, [*chosen, j]), j) for j in left)
            return j if p < self.alpha_in else None
        score, j = min((self._score(g, [*chosen, j]), j) for j in left)
        return j if score < self._score(g, chosen) else None

    def _drop(self, g: Gram, chosen: list[int]) -> int | None:
        if not chosen:
            return None
        without = {j: [c for c in chosen if c != j] for j in chosen}
        if self.criterion == "alpha":
            p, j = max((self._partial_p(g, without[j], chosen), -j) for j in chosen)
            return -j if p > self.alpha_out else None
        score, j = min((self._score(g, without[j]), j) for j in chosen)
        return j if score < self._score(g, chosen) else None

    def choose(self, g: Gram) -> list[int]:
        if self.criterion == "alpha" and g.n <= ENOUGH:
            raise ValueError("p values need more than 30 rows")
        chosen = list(range(len(g.columns) - 1)) if self.method == "backward" else []
        barred: set[int] = set()
        while True:
            moved = False
            if self.method != "backward" and (j := self._add(g, chosen, barred)) is not None:
                chosen.append(j)
                moved = True
            if self.method != "forward" and (j := self._drop(g, chosen)) is not None:
                chosen.remove(j)
                barred.add(j)
                moved = True
            if not moved:
                return sorted(chosen)

    def solve_centred(self, g):
        k = len(g.columns) - 1
        self.chosen, coef = self.choose(g), np.zeros(k)
        if self.chosen:
            at = self.chosen
            coef[at] = solve(g.centred[np.ix_(at, at)], g.centred[at, k])
        return coef

    def effective_df(self, g, coef):
        return float(len(self.chosen))

    def fit(self, df: DataFrame, features: Sequence[str], target: str, order_by: Sequence[str] = ()) -> Model:
        """The full table of features: those not chosen have a coefficient of 0 and a VIF of 0."""
        g = self.gram(df, features, target)
        a, coef = self.from_gram(g)
        own = [features[j] for j in self.chosen]
        rows = df.dropna(subset=[*features, target])
        if not own:
            model = Model(list(features), target, a, coef)
            model.stderr, model.stats = np.full(len(coef) + 1, math.nan), {"n": g.n, "r2": 0.0, "n_features": 0}
            return model
        inner = LinearRegression().fit(rows, own, target, order_by)
        stderr, vifs = np.full(len(features) + 1, math.nan), np.zeros(len(features))
        stderr[[0, *(j + 1 for j in self.chosen)]] = inner.stderr
        vifs[self.chosen] = inner.vif
        model = Model(list(features), target, a, coef, stderr=stderr, vif=vifs)
        model.stats = {"n_features": len(own), **{k: v for k, v in inner.stats.items() if not k.startswith("vif_")}, **{f"vif_{c}": v for c, v in zip(features, vifs, strict=True)}}
        return model
