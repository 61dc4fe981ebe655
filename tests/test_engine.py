"""Operators against NumPy closed forms on seeded data."""

import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabstat.functions import vectors
from tabstat.operators import frame, gls, impute, inference, kmeans, linalg, pca, regression, scale, split, stats, timeseries, validate
from tabstat.plans import dist
from tabstat.plans.gram import moments, solve
from tabstat.plans.ordered import number
from tabstat.sources import files


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    n = 600
    x = rng.normal(size=(n, 3)) @ np.array([[1, 0.4, 0], [0, 1, 0.2], [0, 0, 1]]) + [1000.0, 5.0, 0.0]
    g = np.arange(n) % 23
    y = 3 + x @ [0.5, -2.0, 0.0] + rng.normal(size=n) * (1 + 0.5 * np.abs(x[:, 1] - 5)) + rng.normal(size=23)[g]
    pdf = pd.DataFrame({"id": np.arange(n), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "g": g, "y": y})
    return pdf, spark.createDataFrame(pdf).repartition(5).cache()


def ols(pdf, cols=("a", "b", "c")):
    x = np.column_stack([np.ones(len(pdf)), pdf[list(cols)]])
    beta, *_ = np.linalg.lstsq(x, pdf["y"], rcond=None)
    return x, beta, pdf["y"].to_numpy() - x @ beta


def test_ols_classical(table):
    pdf, df = table
    x, beta, e = ols(pdf)
    m = regression.LinearRegression().fit(df, ["a", "b", "c"], "y", ["id"])
    assert np.allclose(m.beta, beta, rtol=1e-6)
    cov = e @ e / (len(x) - 4) * np.linalg.inv(x.T @ x)
    assert np.allclose(m.stderr, np.sqrt(np.diag(cov)), rtol=1e-5)
    assert m.stats["rho"] == pytest.approx(1 - np.sum(np.diff(e) ** 2) / (e @ e) / 2)
    r2 = 1 - e @ e / np.sum((pdf["y"] - pdf["y"].mean()) ** 2)
    assert m.stats["f"] == pytest.approx(r2 * (len(x) - 4) / (3 * (1 - r2)))
    corr = np.linalg.inv(np.corrcoef(pdf[["a", "b", "c"]].T))
    assert np.allclose(m.vif, np.diag(corr))
    assert "intercept" in m.summary()


def test_robust_covariances(table):
    pdf, df = table
    x, _, e = ols(pdf)
    inv, n = np.linalg.inv(x.T @ x), len(x)
    h = np.einsum("ij,jk,ik->i", x, inv, x)
    meat = (x * (e / (1 - h))[:, None] ** 2).T @ x
    assert np.allclose(regression.LinearRegression("HC3").fit(df, ["a", "b", "c"], "y").stderr, np.sqrt(np.diag(inv @ meat @ inv)), rtol=1e-4)
    u = pd.DataFrame(x * e[:, None]).groupby(pdf["g"]).sum().to_numpy()
    meat = u.T @ u * 23 / 22 * (n - 1) / (n - 4)
    assert np.allclose(regression.LinearRegression("cluster", "g").fit(df, ["a", "b", "c"], "y").stderr, np.sqrt(np.diag(inv @ meat @ inv)), rtol=1e-4)
    s, lags = x * e[:, None], int(4 * (n / 100) ** (2 / 9))
    meat = s.T @ s
    for k in range(1, lags + 1):
        gamma = s[k:].T @ s[:-k]
        meat += (1 - k / (lags + 1)) * (gamma + gamma.T)
    assert np.allclose(regression.LinearRegression("HAC").fit(df, ["a", "b", "c"], "y", ["id"]).stderr, np.sqrt(np.diag(inv @ meat @ inv)), rtol=1e-4)


def test_weighted_and_no_intercept(table):
    pdf, df = table
    x = np.column_stack([np.ones(len(pdf)), pdf[["b", "c"]]])
    w = 1 / (1 + pdf["g"].to_numpy())
    beta = np.linalg.solve((x * w[:, None]).T @ x, (x * w[:, None]).T @ pdf["y"])
    m = regression.LinearRegression(variance="v").fit(df.withColumn("v", 1.0 + F.col("g")), ["b", "c"], "y")
    assert np.allclose(m.beta, beta)
    x = pdf[["a", "b"]].to_numpy()
    m = regression.LinearRegression(intercept=False).fit_without_stats(df, ["a", "b"], "y")
    assert np.allclose(m.beta, np.linalg.lstsq(x, pdf["y"], rcond=None)[0])


def test_penalised_agree_with_ml(table):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression as Ml

    pdf, df = table
    v = VectorAssembler(inputCols=["a", "b", "c"], outputCol="f").transform(df)
    sd, n = pdf["y"].std(ddof=0), len(pdf)
    ridge = Ml(featuresCol="f", labelCol="y", standardization=False, regParam=50 * sd / n, elasticNetParam=0, solver="normal").fit(v)
    assert np.allclose(regression.RidgeRegression(50.0).fit(df, ["a", "b", "c"], "y").coef, ridge.coefficients.toArray(), rtol=1e-6)
    l1, l2 = 0.3 * 0.5, 0.3 * 0.5 * sd
    net = Ml(featuresCol="f", labelCol="y", standardization=False, regParam=l1 + l2, elasticNetParam=l1 / (l1 + l2), tol=1e-12, maxIter=1000).fit(v)
    assert np.allclose(regression.ElasticNetRegression(0.3, 0.5).fit(df, ["a", "b", "c"], "y").coef, net.coefficients.toArray(), atol=1e-5)
    lasso = Ml(featuresCol="f", labelCol="y", standardization=False, regParam=0.3, elasticNetParam=1, tol=1e-12, maxIter=1000).fit(v)
    m = regression.LassoRegression(0.3).fit(df, ["a", "b", "c"], "y")
    assert np.allclose(m.coef, lasso.coefficients.toArray(), atol=1e-5)
    assert m.stats["df"] == np.sum(np.abs(m.coef) > 1e-10)


@pytest.mark.parametrize("method", ["forward", "backward", "stepwise"])
@pytest.mark.parametrize("criterion", ["alpha", "aic", "bic"])
def test_stepwise_keeps_what_matters(table, method, criterion):
    _, df = table
    m = regression.StepwiseRegression(method, criterion).fit(df, ["a", "b", "c"], "y")
    assert m.coef[1] != 0
    assert m.vif[m.coef == 0].sum() == 0


def test_cross_validation_and_search(table):
    pdf, df = table
    got = validate.cross_validation(regression.RidgeRegression(5.0), df, ["a", "b"], "y", "id", 4, "mse")
    mae = validate.cross_validation(regression.RidgeRegression(5.0), df, ["a", "b"], "y", "id", 4, "mae")
    size = len(pdf) // 4
    for f in range(4):
        test = pdf.iloc[f * size : (f + 1) * size]
        train = pdf.drop(test.index)
        x = train[["a", "b"]] - train[["a", "b"]].mean()
        b = np.linalg.solve(x.T @ x + 5 * np.eye(2), x.T @ (train["y"] - train["y"].mean()))
        e = test["y"] - train["y"].mean() - (test[["a", "b"]] - train[["a", "b"]].mean()) @ b
        assert got.scores[f] == pytest.approx((e**2).mean(), rel=1e-6)
        assert mae.scores[f] == pytest.approx(e.abs().mean(), rel=1e-6)
    s = validate.grid_search(regression.RidgeRegression(), df, ["a", "b"], "y", "id", {"lam": [0.1, 1e9]}, seed=3)
    assert s.best == {"lam": 0.1}
    r = validate.random_search(regression.RidgeRegression(), df, ["a"], "y", "id", {"lam": (1, 10, "int")}, n_iter=4)
    assert all(p["lam"] == int(p["lam"]) for p, _ in r.history)
    with pytest.raises(NotImplementedError):
        validate.grid_search(regression.LinearRegression(), df, ["a"], "y", "id", {"lam": [1.0]})
    with pytest.raises(ValueError):
        validate.cross_validation(regression.RidgeRegression(), df, ["a"], "y", "id", 1)


def test_gram_wide_equals_narrow(table, monkeypatch):
    from tabstat.plans import gram

    _, df = table
    narrow = moments(df, ["a", "b", "c", "y"], by="g")
    monkeypatch.setattr(gram, "WIDE", 1)
    wide = moments(df, ["a", "b", "c", "y"], by="g")
    assert all(np.allclose(narrow[k].centred, wide[k].centred) and narrow[k].n == wide[k].n for k in narrow)
    part = narrow[0] + narrow[1]
    assert np.allclose((part - narrow[1]).centred, narrow[0].centred)
    with pytest.raises(ValueError):
        solve(np.ones((2, 2)), np.ones(2))


def test_tails_against_commons_math(spark):
    m = spark._jvm.org.apache.commons.math3.distribution
    for x in (0.1, 1.0, 3.7, 25.0):
        assert dist.f_p_value(x, 3, 40) == pytest.approx(1 - m.FDistribution(3.0, 40.0).cumulativeProbability(x), abs=1e-10)
        assert dist.chi2_p_value(x, 4) == pytest.approx(1 - m.ChiSquaredDistribution(4.0).cumulativeProbability(x), abs=1e-10)
        assert dist.normal_cdf(x) == pytest.approx(m.NormalDistribution(0.0, 1.0).cumulativeProbability(x), abs=1e-10)


def test_matrices(spark):
    a = np.array([[2.0, 0, 1, 3], [4, 5, 0, 2], [1, 3, 6, 0], [0, 2, 4, 1]]).T
    b = np.arange(16.0).reshape(4, 4)
    da, db = linalg.from_array(spark, a), linalg.from_array(spark, b)
    assert np.allclose(linalg.to_array(linalg.multiply(da, db), 4), a @ b)
    assert np.allclose(linalg.to_array(linalg.subtract(da, db), 4), a - b)
    assert np.allclose(linalg.to_array(linalg.transpose(da), 4), a.T)
    assert np.allclose(linalg.to_array(linalg.inverse(da, 4), 4) @ a, np.eye(4))
    assert linalg.determinant(da, 4)[0] == pytest.approx(np.linalg.det(a))
    with pytest.raises(ValueError):
        linalg.invert(np.arange(1.0, 17).reshape(4, 4))
    kinds = [linalg.triangular(linalg.from_array(spark, f(a))).first().kind for f in (lambda m: m, np.tril, np.triu, lambda m: np.diag(np.diag(m)))]
    assert kinds == [0, 1, 2, 3]
    packed, order, _ = linalg.lu(a)
    assert np.allclose(linalg.solve_lu(packed, order, b), np.linalg.solve(a, b))


def test_frames(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("k;name;x\n1;red;1.5\n2;;nan\n3;blue;\n4;red;2\n")
    df = files.read_csv(spark, str(path), sep=";", nan="nan")
    assert [r.x for r in df.orderBy("k").collect()] == [1.5, None, None, 2.0]
    codes = frame.dictionary(df, "name", ["k"])
    assert {r.label: r.code for r in codes.collect()} == {"red": 0, "blue": 1}
    coded = frame.encode(df, "name", codes)
    assert [r.name for r in coded.orderBy("k").collect()] == [0, None, 1, 0]
    assert [r.name for r in frame.decode(coded, "name", codes).orderBy("k").collect()] == ["red", None, "blue", "red"]
    hot = frame.one_hot(df, "name").orderBy("k").collect()
    assert [(r.blue, r.red) for r in hot] == [(0, 1), (0, 0), (1, 0), (0, 1)]
    flags = spark.createDataFrame([(1, "True"), (2, "false")], "k int, v string")
    assert {r.label: r.code for r in frame.dictionary(flags, "v", ["k"]).collect()} == {"True": 1, "false": 0}
    left, taken = frame.split_rows(df, "k", [1, 4])
    assert left.count() == 2 and taken.count() == 2
    with pytest.raises(ValueError):
        frame.select(df, "nope")
    with pytest.raises(IndexError):
        frame.select(df, 9)
    with pytest.raises(ValueError):
        frame.one_hot(df, "x")
    with pytest.raises(Exception):
        files.read_csv(spark, str(tmp_path / "missing.csv")).count()
    marked = frame.with_categories(coded, "name", codes)
    assert marked.select("name").schema["name"].metadata["categories"] == {"red": 0, "blue": 1}
    assert not frame.clear_categories(marked).schema["name"].metadata


def test_iris_like_gram_matches_inverse(spark):
    rng = np.random.default_rng(1)
    a = rng.uniform(0, 8, size=(150, 5))
    rows = spark.createDataFrame(pd.DataFrame(a, columns=list("pqrst")).assign(i=range(150)))
    long = frame.to_long(rows, "i", list("pqrst"))
    gram = linalg.multiply(linalg.transpose(long), long)
    assert np.allclose(linalg.to_array(gram, 5), a.T @ a)
    assert np.allclose(linalg.to_array(linalg.inverse(gram, 5), 5) @ (a.T @ a), np.eye(5), atol=1e-8)


def test_order_does_not_depend_on_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    for parts in (1, 7):
        got = number(df.repartition(parts), ["k"]).where("k <> pos").count()
        assert got == 0
    with pytest.raises(ValueError):
        number(df, [])


def test_imputation(spark):
    pdf = pd.DataFrame({"t": range(9), "v": [None, 2, None, None, 5, 2, None, 9, None]})
    df = spark.createDataFrame(pdf.astype({"v": "float"})).select("t", F.when(~F.isnan("v"), F.col("v")).alias("v")).repartition(3)
    run = lambda m: [r.v for r in impute.impute(df, "v", m, ["t"]).orderBy("t").collect()]
    assert run("forward") == [None, 2, 2, 2, 5, 2, 2, 9, 9]
    assert run("backward") == [2, 2, 5, 5, 5, 2, 9, 9, None]
    assert run("mean")[0] == 4.5 and run("median")[0] == 3.5 and run("mode")[0] == 2
    with pytest.raises(ValueError):
        impute.impute(df, "v", "guess")


def test_forward_fill_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(impute, "_STRETCH", 3)
    df = spark.range(20).select(F.col("id").alias("t"), F.when(F.col("id") % 8 == 1, F.col("id")).alias("v"))
    got = [r.v for r in impute.impute(df, "v", "forward", ["t"]).orderBy("t").collect()]
    assert got == [None] + [1] * 8 + [9] * 8 + [17] * 3


def test_knn(spark):
    rows = [(1, 0.0, 10.0), (2, 1.0, 20.5), (3, 4.0, 40.0), (4, 2.0, None), (5, 0.0, None), (6, None, 30.0)]
    got = {r.k: (r.x, r.y) for r in impute.knn_impute(spark.createDataFrame(rows, "k int, x double, y double"), "k", ["x", "y"], 2).collect()}
    assert got[5][1] == 10.0
    assert got[4][1] == pytest.approx((20.5 / 1 + 10 / 2) / 1.5)
    assert got[6][0] is not None


def test_knn_of_equal_rows_meets_once(spark, monkeypatch):
    held, write = [], impute.write_table
    monkeypatch.setattr(impute, "write_table", lambda df: held.append(write(df)) or held[-1])
    rows = [(i, float(i % 5), None if i % 7 == 0 else i + 0.5) for i in range(400)]
    got = {r.k: r.y for r in impute.knn_impute(spark.createDataFrame(rows, "k int, x double, y double"), "k", ["x", "y"], 3).collect()}
    for k, x, y in rows:
        near = min((abs(x - a), j, b) for j, a, b in rows if b is not None)
        assert got[k] == (near[2] if y is None else y)
    # 58 rows with a null and 342 donors, but five different ones of each.
    assert [t.count() for t in held] == [5, 5]


def test_scaling_and_transforms(spark):
    x = np.array([1.0, 2, 4, 8, 16])
    df = spark.createDataFrame(pd.DataFrame({"k": range(5), "v": x}))
    run = lambda d: np.array([r.v for r in d.orderBy("k").collect()], float)
    assert np.allclose(run(scale.scale(df, "v")), (x - x.mean()) / x.std(ddof=1))
    assert np.allclose(run(scale.scale(df, "v", "robust")), (x - 4) / 6)
    assert np.allclose(run(scale.scale(df, "v", "minmax", -1, 1)), (x - 1) / 15 * 2 - 1)
    assert np.allclose(run(scale.transform(df, "v", "box_cox", 0)), np.log(x))
    neg = df.withColumn("v", -F.col("v"))
    assert np.allclose(run(scale.transform(neg, "v", "yeo_johnson", 2)), -np.log1p(x))
    assert [r.v for r in scale.transform(neg, "v", "log").collect()] == [None] * 5
    with pytest.raises(ValueError):
        scale.scale(df.withColumn("v", F.lit(1.0)), "v")
    with pytest.raises(ValueError):
        scale.scale(df, "v", "odd")


def test_splits(spark):
    df = spark.range(103).select("id", (F.col("id") % 4).alias("y"))
    for seed in (None, 5):
        counts = {r.split: r["count"] for r in split.train_test_split(df, "id", [60, 20], seed).groupBy("split").count().collect()}
        assert counts == {"train": 62, "valid": 21, "test": 20}
    a = split.train_test_split(df.repartition(2), "id", 70, 9).where("split = 'train'")
    b = split.train_test_split(df.repartition(9), "id", 70, 9).where("split = 'train'")
    assert a.exceptAll(b).count() == 0
    strata = split.stratified_split(df, "id", "y", 80).where("split = 'train'").groupBy("y").count().collect()
    assert sorted(r["count"] for r in strata) == [20, 21, 21, 21]
    sizes = [r["count"] for r in split.folds(df, "id", 5).groupBy("fold").count().collect()]
    assert sizes == [20] * 5
    for bad in (0, 100, [60, 39]):
        with pytest.raises(ValueError):
            split.train_test_split(df, "id", bad)
    with pytest.raises(ValueError):
        split.stratified_split(df.where("id < 5"), "id", "y", 80)


def test_pca(table):
    pdf, df = table
    x = pdf[["a", "b", "c"]].to_numpy()
    p = pca.PCA(2).fit(df, ["a", "b", "c"])
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T, ddof=0)))[::-1]
    assert np.allclose(p.eigenvalues, values[:2])
    z = p.transform(df).orderBy("id").select("pc1", "pc2").toPandas().to_numpy()
    assert np.allclose(z, (x - x.mean(axis=0)) @ p.vectors)
    assert pca.PCA().fit(df, ["a", "b", "c"]).ratio.sum() >= 0.95


@pytest.mark.parametrize("method", ["batch", "minibatch", "online"])
def test_kmeans_finds_clusters(spark, method):
    rng = np.random.default_rng(3)
    at = np.array([[0.0, 0], [10, 0], [0, 10]])
    x = np.concatenate([c + rng.normal(scale=0.3, size=(60, 2)) for c in at])
    df = spark.createDataFrame(pd.DataFrame({"k": range(180), "x": x[:, 0], "y": x[:, 1]})).cache()
    m = kmeans.KMeans(3, n_init=3, max_iter=10, method=method, batch_size=90).fit(df, ["x", "y"], "k")
    assert all(min(np.linalg.norm(c - m.centres, axis=1)) < 0.5 for c in at)
    labels = m.predict(df).toPandas().sort_values("k")["cluster"].to_numpy()
    assert all(len(set(labels[i * 60 : (i + 1) * 60])) == 1 for i in range(3))
    if method == "batch":
        assert kmeans.KMeans(n_init=1, max_iter=5, bounds=(2, 5)).select_k(df, ["x", "y"], "k") == 3


def test_online_sequence_is_the_row_by_row_one():
    def plain(rows, start, seed, most):
        at, seen = start.copy(), np.zeros(len(start))
        for epoch in range(most):
            before = at.copy()
            for x in rows[np.random.default_rng((seed, epoch)).permutation(len(rows))]:
                c = ((at - x) ** 2).sum(axis=1).argmin()
                seen[c] += 1
                at[c] += (x - at[c]) / seen[c]
            if np.sqrt(((at - before) ** 2).sum(axis=1)).max() <= kmeans.TOLERANCE:
                break
        return at, seen

    rng = np.random.default_rng(5)
    free = rng.normal(size=(3000, 8))
    near = np.concatenate([c + rng.normal(scale=0.3, size=(700, 2)) for c in ([0.0, 0], [10, 0], [0, 10])])
    for rows, k in ((free, 3), (free, 1), (near, 5), (free[:2], 2), (np.repeat(free[:9], 80, axis=0), 4), (near + 1e6, 3), (near.round(), 6), (free[:0], 2)):
        start = near[:k] + 1e6 if rows.size and rows.max() > 1e5 else np.resize(rows if len(rows) else free, (k, rows.shape[1]))
        want, got = plain(rows, start, 3, 6), kmeans._sequence(rows, start, 3, 6)
        assert got[1].tolist() == want[1].tolist() and np.allclose(got[0], want[0], rtol=1e-9, atol=1e-9)
    free = np.tile(free, (7, 8))
    spent = []
    for run in (plain, kmeans._sequence):
        began = time.thread_time()
        run(free, free[:3].copy(), 0, 4)
        spent.append(time.thread_time() - began)
    assert spent[1] < spent[0] / 2


def test_streaming_updates(spark, tmp_path):
    from tabstat.streaming.online_kmeans import OnlineKMeans

    df = spark.createDataFrame([(0.0,), (2.0,), (10.0,), (14.0,)], "x double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    online = OnlineKMeans(np.array([[1.0], [11.0]]), ["x"])
    q = online.start(spark.readStream.schema("x double").parquet(str(tmp_path / "in")), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert online.centres.tolist() == [[1.0], [12.0]]
    online.update(df, 0)
    assert online.seen.tolist() == [2, 2]


def test_series(spark):
    rng = np.random.default_rng(11)
    t = np.arange(240)
    y = 5 * np.sin(2 * np.pi * t / 12) + 0.02 * t + rng.normal(scale=0.5, size=240)
    s = timeseries.series(spark.createDataFrame(pd.DataFrame({"t": t, "y": y})).repartition(4), "y", ["t"]).cache()
    z = y - y.mean()
    rho = np.array([z[k:] @ z[: len(z) - k] for k in range(25)]) / (z @ z)
    got = [r.rho for r in timeseries.acf(s, 24).orderBy("lag").collect()]
    assert np.allclose(got, rho)
    assert timeseries.fourier_period(s) == 12 and timeseries.acf_period(timeseries.detrend(s)) == 12
    assert timeseries.kruskal_wallis(s, 12)[1] < 0.01 and timeseries.kruskal_wallis(s, 0) == (0.0, 1.0)
    phi = timeseries.partial(rho)
    toeplitz = lambda k: np.array([[rho[abs(i - j)] for j in range(k)] for i in range(k)])
    assert np.allclose(phi[:6], [np.linalg.solve(toeplitz(k), rho[1 : k + 1])[-1] for k in range(1, 7)])
    assert timeseries.detect_sarima(s)["seasonal"]
    walk = timeseries.series(spark.createDataFrame(pd.DataFrame({"t": t, "y": np.cumsum(rng.normal(size=240))})), "y", ["t"]).cache()
    assert timeseries.detect_arima(walk)[1] >= 1
    d = [r.y for r in timeseries.difference(s, 12).orderBy("t").collect()]
    assert np.allclose(d, y[12:] - y[:-12])


def test_adf_closed_form(spark):
    rng = np.random.default_rng(2)
    y = rng.normal(size=150)
    s = timeseries.series(spark.createDataFrame(pd.DataFrame({"t": range(150), "y": y})), "y", ["t"])
    lags, dy = int(12 * 1.5**0.25), np.diff(y)
    x = np.array([[1, i, y[i], *dy[i - lags : i][::-1]] for i in range(lags, len(dy))])
    target = dy[lags:]
    beta = np.linalg.lstsq(x, target, rcond=None)[0]
    e = target - x @ beta
    se = math.sqrt(e @ e / (len(x) - x.shape[1]) * np.linalg.inv(x.T @ x)[2, 2])
    assert timeseries.adf(s) == pytest.approx(beta[2] / se, rel=1e-5)


def test_vectors_and_ranks(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 1.0), (3, 3.0), (4, None), (5, 2.0)], "k int, v double")
    got = {r.k: r["rank"] for r in vectors.with_mid_ranks(df, "v").collect()}
    assert got == {1: 3.5, 2: 1.0, 3: 3.5, 4: None, 5: 2.0}
    assert vectors.most_frequent(df, "v").first()[0] == 3.0
    assert df.agg(vectors.all_integers("v")).first()[0]
    row = spark.createDataFrame([([1.0, 2.0], [3.0])], "a array<double>, b array<double>")
    assert row.select(vectors.dot(F.col("a"), F.col("b"))).first()[0] is None


def test_quality_measures(spark):
    pdf = pd.DataFrame({"y": [0.0, 1, 1, 0], "p": [0.1, 0.8, 0.6, 0.0]})
    df = spark.createDataFrame(pdf)
    q = np.clip(pdf["p"], 1e-15, 1 - 1e-15)
    want = (pdf["y"] * np.log(q) + (1 - pdf["y"]) * np.log(1 - q)).sum()
    assert df.agg(stats.log_likelihood("y", "p", "bernoulli")).first()[0] == pytest.approx(want)
    with pytest.raises(ValueError):
        stats.r_adjusted(0.5, 2, 1)
    assert spark.createDataFrame([(1.0,)], "x double").agg(stats.variance("x")).first()[0] is None
    lm, p = inference.breusch_pagan(spark.range(50).select(F.col("id").cast("double").alias("x"), (F.col("id") % 3 - 1.0).alias("e")), ["x"], "e")
    assert lm >= 0 and 0 <= p <= 1


def test_exact_quantiles_with_ties_and_nulls(spark):
    from tabstat.plans.ordered import quantiles

    values = [5.0, 1.0, 1.0, None, 9.0, 2.5, 2.5, 2.5, -4.0]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    own = [v for v in values if v is not None]
    assert quantiles(df, "v", [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]) == pytest.approx(np.quantile(own, [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]).tolist())
    assert quantiles(df.where("v > 8"), "v", [0.5]) == [9.0] and quantiles(df.where("v > 10"), "v", [0.5]) is None


def test_online_centres_survive_a_restart(spark, tmp_path):
    from tabstat.streaming.online_kmeans import OnlineKMeans

    rng = np.random.default_rng(3)
    batches = [spark.createDataFrame([(float(x),) for x in rng.normal(c, 0.1, 20)], "x double") for c in (0, 5, 0)]
    whole, first = (OnlineKMeans(np.array([[1.0], [4.0]]), ["x"], str(tmp_path / name)) for name in "ab")
    for e, b in enumerate(batches):
        whole.update(b, e)
    first.update(batches[0], 0)
    first.update(batches[1], 1)
    again = OnlineKMeans(np.array([[1.0], [4.0]]), ["x"], str(tmp_path / "b"))
    again.update(batches[1], 1)
    again.update(batches[2], 2)
    assert again.centres == pytest.approx(whole.centres) and again.seen.tolist() == whole.seen.tolist() == [40, 20]


def test_starts_move_side_by_side(spark):
    from tabstat.operators import kmeans

    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.2, (40, 5)) for c in (0, 3, 6)])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double, d double, e double").repartition(4)
    model = kmeans.KMeans(k=3, n_init=4).fit(df, list("abcde"), "id")
    alone = [kmeans.KMeans(k=3, n_init=1, seed=s).fit(df, list("abcde"), "id").inertia for s in range(4)]
    assert model.inertia == pytest.approx(min(alone))
    want = sum(((x[i : i + 40] - x[i : i + 40].mean(axis=0)) ** 2).sum() for i in (0, 40, 80))
    assert model.inertia == pytest.approx(want)
    small = kmeans.KMeans(k=3, n_init=2, method="minibatch", batch_size=40).fit(df, list("abcde"), "id")
    assert small.inertia < 1.5 * want
    assert kmeans.KMeans(bounds=(2, 5)).select_k(df, list("abcde"), "id") == 3


def dense(df, rows, cols):
    return linalg.to_array(df, rows, cols)


def test_matrix_shapes_and_block_product(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(300, 140)), rng.normal(size=(140, 260))
    a, b = linalg.Matrix(linalg.from_array(spark, x), 300, 140), linalg.Matrix(linalg.from_array(spark, y), 140, 260)
    assert np.allclose(dense((a @ b).entries, 300, 260), x @ y)
    assert np.allclose(dense((a.T @ a).entries, 140, 140), x.T @ x)
    assert np.allclose(dense((a - a).entries, 300, 140), 0)
    for wrong in (lambda: a + b, lambda: a - b, lambda: a @ a, a.inverse, a.det):
        with pytest.raises(ValueError):
            wrong()


def test_block_product_of_sparse_entries(spark):
    rows = [(0, 5, 2.0), (1_000_000, 700, 3.0), (1_000_000, 5, 0.0), (-1, 700, 4.0), (7, 8, None)]
    a = spark.createDataFrame(rows, "i bigint, j bigint, v double")
    got = {(r.i, r.j): r.v for r in linalg.multiply(a, linalg.transpose(a)).collect()}
    want = {}
    for i, k, v in rows:
        for j, l, w in rows:
            if k == l and v is not None and w is not None:
                want[i, j] = want.get((i, j), 0) + v * w
    assert got == want
    assert linalg.multiply(a.limit(0), a).count() == 0


def test_determinant_with_factors(spark):
    x = np.array([[0.0, 2.0, 1.0], [4.0, 1.0, 0.0], [2.0, 5.0, 3.0]])
    det, packed, order, swaps = linalg.Matrix(linalg.from_array(spark, x), 3, 3).det()
    assert det == pytest.approx(np.linalg.det(x))
    lower, upper = np.tril(packed, -1) + np.eye(3), np.triu(packed)
    assert np.allclose(lower @ upper, x[order])
    assert swaps % 2 == (1 if det * np.prod(np.diag(packed)) < 0 else 0)
    assert linalg.factors(linalg.from_array(spark, np.ones((2, 2))), 2)[:2] == (0.0, None)


def test_decoded_display(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None)], "id int, kind string")
    codes = frame.dictionary(df, "kind", ["id"])
    coded = frame.with_categories(frame.encode(df, "kind", codes), "kind", codes)
    assert {r.id: r.kind for r in coded.collect()} == {1: 0, 2: 1, 3: None}
    assert {r.id: r.kind for r in frame.decoded(coded).collect()} == {1: "b", 2: "a", 3: None}
    assert "|b " in frame.display_decoded(coded) and "|b " not in frame.display(coded)
    assert frame.decoded(df).collect() == df.collect()


def test_generalised_least_squares(spark):
    rng = np.random.default_rng(5)
    n, rho = 120, 0.6
    x = rng.normal(size=(n, 2))
    y = 1 + x @ [2.0, -1.0] + rng.normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"t": np.arange(n) * 3, "a": x[:, 0], "b": x[:, 1], "y": y})).repartition(5)
    omega = rho ** np.abs(np.subtract.outer(np.arange(n), np.arange(n)))
    full, inv = np.column_stack([np.ones(n), x]), np.linalg.inv(omega)
    cov = np.linalg.inv(full.T @ inv @ full)
    beta = cov @ full.T @ inv @ y
    e = y - full @ beta
    cov *= e @ inv @ e / (n - 3)
    for model in (gls.fit_ar1(df, ["a", "b"], "y", ["t"], rho), gls.fit_dense(df, ["a", "b"], "y", ["t"], omega)):
        assert np.allclose(model.beta, beta)
        assert np.allclose(model.stderr, np.sqrt(np.diag(cov)))
    with pytest.raises(ValueError):
        gls.fit_ar1(df, ["a"], "y", ["t"], 1.0)
    with pytest.raises(ValueError):
        gls.fit_dense(df, ["a"], "y", ["t"], np.eye(7))


def test_report_and_labels(spark, table):
    _, df = table
    text = regression.LinearRegression().fit(df, ["a", "b", "c"], "y").summary()
    assert "***" in text and "stderr" in text
    lasso = regression.LassoRegression(1e9).fit(df, ["a", "b"], "y")
    assert "  a " in lasso.summary() and "  a " not in lasso.summary(detailed=False)
    rows = spark.createDataFrame([(i, float(i % 2 * 50)) for i in range(20)] + [(99, None)], "id int, x double")
    model = kmeans.KMeans(k=2).fit(rows, ["x"], "id")
    got = {r.id: model.centres[r.cluster][0] for r in model.labels.collect()}
    assert got == {i: float(i % 2 * 50) for i in range(20)}
