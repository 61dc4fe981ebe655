"""k-means on columns of doubles. Centres are small and travel as literals; rows stay where they are."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-4


def _distance(columns: Sequence[str], centre: Sequence[float]) -> Column:
    return sum(((F.col(c) - F.lit(float(x))) * (F.col(c) - F.lit(float(x))) for c, x in zip(columns, centre, strict=True)), F.lit(0.0))


def assign(df: DataFrame, columns: Sequence[str], centres: np.ndarray, name: str = "cluster") -> DataFrame:
    """df with the nearest centre of each row (ties to the lowest) and the squared distance to it, ``distance``.

    Distances come from an Arrow batch at a time: the product with a matrix of
    centres is faster than as many column expressions.
    """
    columns, at = list(columns), np.asarray(centres, float)

    def nearest(*parts: pd.Series) -> pd.DataFrame:
        x = np.column_stack([p.to_numpy(float) for p in parts])
        best, least = np.zeros(len(x), np.int32), np.full(len(x), np.inf)
        for c in range(len(at)):
            d = ((x - at[c]) ** 2).sum(axis=1)
            closer = d < least
            best[closer], least[closer] = c, d[closer]
        return pd.DataFrame({"c": best, "d": least})

    near = F.pandas_udf(nearest, "c int, d double")
    return df.withColumn("_near", near(*(F.col(c).cast("double") for c in columns))).select(*df.columns, F.col("_near.c").alias(name), F.col("_near.d").alias("distance"))


def update(df: DataFrame, columns: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """(cluster, n, inertia, mean of each column): one partial aggregation."""
    return df.groupBy(cluster).agg(F.count("*").alias("n"), F.sum("distance").alias("inertia"), *(F.avg(c).alias(c) for c in columns))


def _uniform(h: np.ndarray, seed: int, step: int) -> np.ndarray:
    """A number in (0, 1) for each 64-bit hash, by seed and step."""
    z = h.view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + (step + 1) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF)
    for _ in range(2):
        z = (z ^ (z >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return ((z >> np.uint64(12)).astype(float) + 0.5) / float(1 << 52)


def _gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows and centres."""
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)


def _points(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """Rows without nulls, as _h (hash of the key) and x0, x1, ..."""
    return df.dropna(subset=list(columns)).select(F.xxhash64(F.col(key)).alias("_h"), *(F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(columns)))


def plus_plus_many(points: DataFrame, starts: Sequence[tuple[int, int]]) -> list[np.ndarray]:
    """k-means++ centres for each (k, seed), drawn side by side: one pass over the points for each centre.

    The draw by squared distance takes the row with the least -ln(u) / d, u being a
    number from seed, step and the hash of the row's key.
    """
    names, centres = points.columns[1:], [[] for _ in starts]
    for step in range(max(k for k, _ in starts)):
        live = [i for i, (k, _) in enumerate(starts) if step < k and len(centres[i]) == step]

        def draw(batches, step=step, live=live):
            best: dict[int, tuple] = {}
            for b in batches:
                x, h = b[names].to_numpy(float), b["_h"].to_numpy()
                for i in live if len(x) else ():
                    gap = _gaps(x, centres[i]).min(axis=1) if step else np.ones(len(x))
                    at = np.flatnonzero(gap > 0)
                    if len(at):
                        v = -np.log(_uniform(h[at], starts[i][1], step)) / gap[at]
                        j = np.lexsort((h[at], v))[0]
                        best[i] = min(best.get(i, (np.inf,)), (v[j], h[at[j]], x[at[j]].tolist()))
            yield pd.DataFrame([(i, v, h, row) for i, (v, h, row) in best.items()], columns=["i", "v", "h", "x"])

        found = points.mapInPandas(draw, "i int, v double, h bigint, x array<double>").groupBy("i").agg(F.min_by("x", F.struct("v", "h")).alias("x"))
        for r in found.collect():
            centres[r.i].append(r.x)
    if not all(centres):
        raise ValueError("no rows")
    return [np.array(c) for c in centres]


def plus_plus(df: DataFrame, columns: Sequence[str], key: str, k: int, seed: int = 0) -> np.ndarray:
    """k-means++ centres; fewer where there are fewer different rows."""
    return plus_plus_many(_points(df, columns, key), [(k, seed)])[0]


def _sums(points: DataFrame, centres: dict[int, np.ndarray], keep=None) -> list:
    """(i, c, n, inertia, s0, s1, ...) of the clusters of each start i: one pass. keep(i, h) marks the rows that count."""
    names = points.columns[1:]

    def add(batches):
        held = {i: np.zeros((len(c), len(names) + 2)) for i, c in centres.items()}
        for b in batches:
            x, h = b[names].to_numpy(float), b["_h"].to_numpy()
            for i, c in centres.items() if len(x) else ():
                own = x if keep is None else x[keep(i, h)]
                if len(own):
                    gap = _gaps(own, c)
                    near = gap.argmin(axis=1)
                    for j in np.unique(near):
                        mine = near == j
                        held[i][j] += [mine.sum(), gap[mine, j].sum(), *own[mine].sum(axis=0)]
        rows = [(i, j, *r) for i, t in held.items() for j, r in enumerate(t.tolist()) if r[0]]
        yield pd.DataFrame(rows, columns=["i", "c", "n", "inertia", *(f"s{j}" for j in range(len(names)))])

    kinds = "i int, c int, n double, inertia double, " + ", ".join(f"s{j} double" for j in range(len(names)))
    return points.mapInPandas(add, kinds).groupBy("i", "c").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), *(F.sum(f"s{j}").alias(f"s{j}") for j in range(len(names)))).collect()


def _advance(x: np.ndarray, at: np.ndarray, seen: np.ndarray, step: int = 8) -> None:
    """Moves the centres by the rows of x in turn, as if one by one.

    Assignments are guessed with the centres at the start. They are the sequence's
    own once every row is nearest to its centre where the guesses before it have
    moved the centres. Rows that are nearer by more than twice the largest move
    need no look; the others are measured. Guesses are right up to the first one
    that fails, so each round settles more.
    """
    # Squared distances by a product, with what rounding may have done to them.
    norms, own = np.einsum("ij,ij->i", x, x), (at * at).sum(axis=1)
    gap, slack = norms[:, None] - 2 * (x @ at.T) + own, 1e-12 * (norms + own.max())[:, None]
    far, close = np.sqrt(np.maximum(gap + slack, 0)), np.sqrt(np.maximum(gap - slack, 0))
    near, rows, ones = gap.argmin(axis=1), np.arange(len(x)), np.ones((1, step))
    close[rows, near] = np.inf
    margin, reach = close.min(axis=1) - far[rows, near], np.tri(step + 1, step, -1)
    while True:
        paths, ends, most = [], at.copy(), 0.0
        for c in range(len(at)):
            # A running mean is the sum of its rows over their number: sums before each block of rows, and after all.
            mine = np.flatnonzero(near == c)
            n = np.minimum(np.arange(-(-len(mine) // step) + 1) * step, len(mine))
            blocks, lengths = np.zeros(((len(n) - 1) * step, x.shape[1])), np.zeros((len(n) - 1) * step)
            blocks[: len(mine)], lengths[: len(mine)] = x[mine], far[mine, c]
            blocks = blocks.reshape(-1, step, x.shape[1])
            sums = np.concatenate((np.zeros((1, x.shape[1])), (ones @ blocks)[:, 0].cumsum(axis=0)))
            if len(mine):
                moved = (np.sqrt(((sums - n[:, None] * at[c]) ** 2).sum(axis=1)) / np.maximum(seen[c] + n, 1)).max()
                inside = ((lengths.reshape(-1, step).sum(axis=1) + step * moved) / (seen[c] + n[:-1] + 1)).max()
                most, ends[c] = max(most, moved + inside), (at[c] * seen[c] + sums[-1]) / (seen[c] + len(mine))
            paths.append((mine, blocks, sums))
        unsure = rows[margin <= 2.001 * most]
        now = np.empty((len(unsure), len(at)))
        for c, (mine, blocks, sums) in enumerate(paths):
            k = np.searchsorted(mine, unsure)
            j = np.minimum(k // step, max(len(blocks) - 1, 0))
            part = (reach[k - j * step][:, None] @ blocks[j])[:, 0] if len(mine) else 0.0
            where = np.where((k > 0)[:, None], (at[c] * seen[c] + sums[j] + part) / np.maximum(seen[c] + k, 1)[:, None], at[c])
            now[:, c] = ((x[unsure] - where) ** 2).sum(axis=1)
        now = now.argmin(axis=1)
        if (now == near[unsure]).all():
            break
        near[unsure] = now
    at[:] = ends
    seen += [len(mine) for mine, _, _ in paths]


def _sequence(rows: np.ndarray, start: np.ndarray, seed: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres, and how many rows each has seen, after epochs of one-point running means in random orders.

    Rows go in stretches that grow as the centres come to rest: while these still move fast, guesses fail.
    """
    at, seen = start.copy(), np.zeros(len(start))
    for epoch in range(most if len(rows) else 0):
        before, order, done = at.copy(), np.random.default_rng((seed, epoch)).permutation(len(rows)), 0
        while done < len(rows):
            n = int(min(max(16, seen.sum() / 32), 2048))
            _advance(rows[order[done : done + n]], at, seen)
            done += n
        if np.sqrt(((at - before) ** 2).sum(axis=1)).max() <= TOLERANCE:
            break
    return at, seen


class KMeans:
    """Lloyd, mini-batch or online k-means, the best of n_init starts by inertia.

    k=None looks for the elbow of inertia over ``bounds``. An empty cluster keeps its centre.
    """

    def __init__(self, k: int | None = None, n_init: int = 10, max_iter: int = 300, method: str = "batch", bounds: tuple[int, int] = (2, 10), seed: int = 0, batch_size: int | None = None):
        if method not in ("batch", "minibatch", "online"):
            raise ValueError(f"unknown method {method!r}")
        self.k, self.n_init, self.max_iter, self.method, self.bounds, self.seed, self.batch_size = k, n_init, max_iter, method, bounds, seed, batch_size

    def fit(self, df: DataFrame, columns: Sequence[str], key: str) -> KMeans:
        self.columns = list(columns)
        if self.k is None:
            self.k = self.select_k(df, columns, key)
        found = self._run(df, key, [(self.k, self.seed + start) for start in range(self.n_init)])
        self.centres, self.inertia = min(found, key=lambda x: x[1])
        self._rows, self._key = df, key
        return self

    @property
    def labels(self) -> DataFrame:
        """(key, cluster) of the rows of fit that have no null."""
        return self.predict(self._rows.dropna(subset=self.columns)).select(self._key, "cluster")

    def _run(self, df: DataFrame, key: str, starts: list[tuple[int, int]]) -> list[tuple[np.ndarray, float]]:
        """(centres, inertia) of each (k, seed). All starts move side by side: one pass a step, until each has come to rest."""
        points = _points(df, self.columns, key)
        centres = dict(enumerate(plus_plus_many(points, starts)))
        if self.method == "online":
            centres = {i: self._online(points, c, starts[i][1]) for i, c in centres.items()}
        else:
            n = points.count() if self.method == "minibatch" else 0
            share = (self.batch_size or max(1, int(n**0.5))) / max(1, n)
            live, seen = dict(centres), {i: np.zeros(len(c)) for i, c in centres.items()}
            for step in range(self.max_iter):
                chosen = None if self.method == "batch" else (lambda i, h, step=step: _uniform(h, starts[i][1], 1_000_000 + step) < share)
                moved = {i: c.copy() for i, c in live.items()}
                for r in _sums(points, live, chosen):
                    # A mini-batch moves a centre by its share of all rows that the centre has seen.
                    seen[r.i][r.c] = r.n + (seen[r.i][r.c] if self.method == "minibatch" else 0)
                    moved[r.i][r.c] += (np.array(r[4:]) / r.n - moved[r.i][r.c]) * r.n / seen[r.i][r.c]
                centres |= moved
                live = {i: c for i, c in moved.items() if step < 1 or ((c - live[i]) ** 2).sum(axis=1).max() > TOLERANCE}
                if not live:
                    break
        inertia = dict.fromkeys(centres, 0.0)
        for r in _sums(points, centres):
            inertia[r.i] += r.inertia
        return [(centres[i], float(inertia[i])) for i in range(len(starts))]

    def _online(self, points: DataFrame, start: np.ndarray, seed: int) -> np.ndarray:
        """One-point running means in random orders, epoch after epoch, until no centre moves more than TOLERANCE in one.

        A sequence over all rows can't be distributed: a task holds about a million
        rows and runs its own sequence to its end; the tasks' centres are averaged by
        the rows that they saw. Below a million rows there is one sequence, as in the textbook.
        """
        names, most = points.columns[1:], self.max_iter

        def run(batches):
            # Rows come in order of _h. The array grows in place, so a task holds its rows about once.
            rows, n = np.empty((0, start.shape[1])), 0
            for b in batches:
                if n + len(b) > len(rows):
                    rows.resize((max(2 * len(rows), n + len(b)), start.shape[1]), refcheck=False)
                rows[n : n + len(b)] = b[names].to_numpy(float)
                n += len(b)
            at, seen = _sequence(rows[:n], start, seed, most)
            yield pd.DataFrame({"c": np.arange(len(at)), "n": seen, **{f"x{j}": at[:, j] for j in range(at.shape[1])}})

        rows = points.repartition(max(1, points.count() >> 20), "_h").sortWithinPartitions("_h")
        schema = "c int, n double, " + ", ".join(f"x{j} double" for j in range(start.shape[1]))
        out = rows.mapInPandas(run, schema).groupBy("c").agg(F.sum("n").alias("n"), *(F.sum(F.col("n") * F.col(f"x{j}")).alias(f"x{j}") for j in range(start.shape[1])))
        end = start.copy()
        for r in out.where("n > 0").collect():
            end[r.c] = [r[f"x{j}"] / r.n for j in range(start.shape[1])]
        return end

    def predict(self, df: DataFrame, name: str = "cluster") -> DataFrame:
        if not hasattr(self, "centres"):
            raise RuntimeError("fit first")
        return assign(df, self.columns, self.centres, name).drop("distance")

    def fit_predict(self, df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
        return self.fit(df, columns, key).predict(df)

    def select_k(self, df: DataFrame, columns: Sequence[str], key: str) -> int:
        """The elbow: the k inside the bounds (both included) where inertia bends most."""
        self.columns = list(columns)
        low, high = self.bounds
        if high - low < 2:
            raise ValueError("bounds must hold three values of k")
        found = self._run(df, key, [(k, self.seed) for k in range(low, high + 1)])
        self.elbow = {k: inertia for k, (_, inertia) in zip(range(low, high + 1), found, strict=True)}
        bend = {k: self.elbow[k - 1] - 2 * self.elbow[k] + self.elbow[k + 1] for k in range(low + 1, high)}
        return max(bend, key=lambda k: (bend[k], -k))
