"""One query per operator over the whole test tables, and SQL that must return the same rows.

Sums of doubles depend on their order, so both sides round: to six digits, or to
fewer where values are large.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabstat.functions import vectors
from tabstat.operators import frame, gls, impute, inference, kmeans, linalg, pca, regression, scale, split, stats, timeseries, validate
from tabstat.plans import dist
from tabstat.plans.gram import moments, solve
from tabstat.plans.shared import shared_dir, write_table
from tabstat.sources import files
from tabstat.streaming.online_kmeans import OnlineKMeans

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder, by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return files.read_parquet(self.spark, f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def r(c, digits: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(r(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else f.name for f in df.schema))


def one(spark: SparkSession, **values) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'bigint'}" for k, v in values.items()))


ORDER = ["ts", "event_id"]
GAPS = "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END"
HOURLY = "h AS (SELECT row_number() OVER (ORDER BY date_trunc('hour', ts)) - 1 AS t, avg(value) AS y FROM events GROUP BY date_trunc('hour', ts))"


def hourly(t: Tables) -> DataFrame:
    """Mean value of each hour, as a series."""
    hours = t.events.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("value").alias("value"))
    return write_table(timeseries.series(hours, "value", ["hour"]))


def entries(t: Tables) -> DataFrame:
    """embeddings as a matrix: i = vec_id, j = place."""
    return t.embeddings.select(F.col("vec_id").cast("bigint").alias("i"), F.posexplode("embedding").alias("j", "v")).select("i", F.col("j").cast("bigint").alias("j"), F.col("v").cast("double").alias("v"))


def matrix(t: Tables) -> linalg.Matrix:
    return linalg.Matrix(entries(t), t.embeddings.count(), 64)


ENTRIES = "m AS (SELECT vec_id AS i, unnest(range(len(embedding))) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
FEATURES = ["l_quantity", "l_discount", "l_tax"]


def gaps(t: Tables) -> DataFrame:
    return t.events.select("event_id", "ts", "event_type", F.expr(GAPS).alias("value"))


# Sources, columns and rows


@query("D01_csv", "SELECT CAST(n_nationkey AS INT) AS n_nationkey, n_name, CAST(n_regionkey AS INT) AS n_regionkey FROM nation")
def _(t):
    path = f"{shared_dir(t.spark)}/{uuid.uuid4().hex}"
    files.write_csv(t.nation.select("n_nationkey", "n_name", "n_regionkey"), path, sep=";")
    return files.read_csv(t.spark, path, sep=";")


def _codes(t):
    return frame.dictionary(t.events, "event_type", ORDER)


CODES = "c AS (SELECT event_type AS label, CAST(row_number() OVER (ORDER BY min(struct_pack(ts := ts, event_id := event_id))) - 1 AS INT) AS code FROM events GROUP BY 1)"


@query("D02_label_encode", f"WITH {CODES} SELECT event_id, code AS event_type FROM events JOIN c ON event_type = label")
def _(t):
    return frame.encode(t.events.select("event_id", "event_type"), "event_type", _codes(t))


@query("D03_label_decode", "SELECT event_id, event_type FROM events")
def _(t):
    codes = _codes(t)
    return frame.decode(frame.encode(t.events.select("event_id", "event_type"), "event_type", codes), "event_type", codes)


@query("D06_clear_encoding", "SELECT event_id, event_type FROM events")
def _(t):
    return frame.clear_categories(frame.with_categories(t.events.select("event_id", "event_type"), "event_type", _codes(t)))


@query("D05_decoded", "SELECT event_id, event_type FROM events")
def _(t):
    codes = _codes(t)
    return frame.decoded(frame.with_categories(frame.encode(t.events.select("event_id", "event_type"), "event_type", codes), "event_type", codes))


@query("D10_cell", "SELECT n_name FROM nation WHERE n_nationkey = 7")
def _(t):
    return frame.cell(t.nation, "n_nationkey", 7, "n_name")


@query("D12_select", "SELECT l_tax, l_orderkey, l_linenumber FROM lineitem")
def _(t):
    return frame.select(t.lineitem, ["l_tax", 0, "l_linenumber"])


@query("D13_transfer", "SELECT s_suppkey, s_acctbal FROM supplier")
def _(t):
    return frame.transfer(t.supplier, ["s_acctbal", "s_suppkey"])[1]


@query("D14_take_rows", "SELECT * FROM nation WHERE n_regionkey IN (1, 3)")
def _(t):
    return frame.split_rows(t.nation, "n_regionkey", [1, 3])[1]


@query("D15_drop_rows", "SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey NOT IN (1, 3)")
def _(t):
    return frame.drop_columns(frame.drop_rows(t.nation, "n_regionkey", [1, 3]), "n_name")


@query("D16_one_hot", "SELECT event_id, list_transform((SELECT list(DISTINCT event_type ORDER BY event_type) FROM events), lambda c: c || '=' || CASE WHEN c = event_type THEN '1' ELSE '0' END).list_aggregate('string_agg', ',') AS hot FROM events")
def _(t):
    hot = frame.one_hot(t.events.select("event_id", "event_type"), "event_type")
    return hot.select("event_id", F.concat_ws(",", *(F.concat(F.lit(f"{c}="), F.col(c).cast("int").cast("string")) for c in sorted(x for x in hot.columns if x != "event_id"))).alias("hot"))


@query("D18_row_vector", "SELECT ps AS p_partkey, a AS total FROM (SELECT p_partkey AS ps, round(p_size + p_retailprice, 6) AS a FROM part)")
def _(t):
    return frame.row_vector(t.part, ["p_size", "p_retailprice"]).select("p_partkey", r(F.col("row")[0] + F.col("row")[1]).alias("total"))


@query("D19_shape", "SELECT count(*) AS n_rows, 7::BIGINT - 2 AS n_columns FROM orders WHERE true")
def _(t):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    n = frame.shape(rows)
    return one(t.spark, n_rows=n[0], n_columns=n[1])


# Matrices


@query("D32_transpose", f"WITH {ENTRIES} SELECT j AS i, i AS j, v FROM m")
def _(t):
    return linalg.transpose(entries(t))


@query("L01_add", f"WITH {ENTRIES} SELECT i, j, round(v + v, 6) AS v FROM m")
def _(t):
    a = matrix(t)
    return rounded((a + a).entries)


@query("L01_subtract", f"WITH {ENTRIES} SELECT i, j, round(v - 3 * v * v, 6) AS v FROM m")
def _(t):
    a = matrix(t)
    return rounded((a - linalg.Matrix(a.entries.withColumn("v", 3 * F.col("v") * F.col("v")), a.rows, a.cols)).entries)


@query("L02_multiply", f"WITH {ENTRIES} SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v), 4) AS v FROM m a JOIN m b ON a.i = b.i GROUP BY 1, 2")
def _(t):
    a = matrix(t)
    return rounded((a.T @ a).entries, 4)


def _small(t) -> DataFrame:
    """Cross products of quantity and discount: a 2 x 2 matrix."""
    g = moments(t.lineitem, ["l_quantity", "l_discount"])
    return linalg.from_array(t.spark, g.centred / g.n)


SMALL = "s AS (SELECT var_pop(l_quantity) AS a, covar_pop(l_quantity, l_discount) AS b, var_pop(l_discount) AS d FROM lineitem)"


@query("L04_inverse", f"""WITH {SMALL} SELECT i, j, round(v, 6) AS v FROM (SELECT 0::BIGINT AS i, 0::BIGINT AS j, d / (a * d - b * b) AS v FROM s
UNION ALL SELECT 0, 1, -b / (a * d - b * b) FROM s UNION ALL SELECT 1, 0, -b / (a * d - b * b) FROM s UNION ALL SELECT 1, 1, a / (a * d - b * b) FROM s)""")
def _(t):
    return rounded(linalg.inverse(_small(t), 2))


@query("L05_determinant", f"WITH {SMALL} SELECT round(a * d - b * b, 6) AS det, 1.0::DOUBLE AS sign FROM s")
def _(t):
    det, sign, _log = linalg.determinant(_small(t), 2)
    return rounded(one(t.spark, det=det, sign=sign))


@query("L05_factors", f"WITH {SMALL} SELECT i, j, round(v, 6) AS v, round(a * d - b * b, 6) AS det FROM (SELECT 0::BIGINT AS i, 0::BIGINT AS j, a AS v, * FROM s UNION ALL SELECT 0, 1, b, * FROM s UNION ALL SELECT 1, 0, b / a, * FROM s UNION ALL SELECT 1, 1, d - b * b / a, * FROM s)")
def _(t):
    det, packed, _order, _swaps = linalg.Matrix(_small(t), 2, 2).det()
    return rounded(linalg.from_array(t.spark, packed).withColumn("det", F.lit(det)))


@query("L06_triangular", f"WITH {ENTRIES} SELECT (1 - max(CAST(j > i AND v <> 0 AS INT))) + 2 * (1 - max(CAST(j < i AND v <> 0 AS INT))) AS kind FROM m")
def _(t):
    return linalg.triangular(entries(t))


@query("L07_lu", f"""WITH {SMALL} SELECT i, j, round(v, 6) AS v FROM (SELECT 0::BIGINT AS i, 0::BIGINT AS j, d / (a * d - b * b) AS v FROM s
UNION ALL SELECT 0, 1, -b / (a * d - b * b) FROM s UNION ALL SELECT 1, 0, -b / (a * d - b * b) FROM s UNION ALL SELECT 1, 1, a / (a * d - b * b) FROM s)""")
def _(t):
    packed, order, swaps = linalg.lu(linalg.to_array(_small(t), 2))
    return rounded(linalg.from_array(t.spark, linalg.solve_lu(packed, order, np.eye(2))))


# Vectors

PAIR = "p AS (SELECT a.vec_id, CAST(a.embedding AS DOUBLE[]) AS x, CAST(b.embedding AS DOUBLE[]) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = 0)"


def _pairs(t):
    e = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    first = t.embeddings.where("vec_id = 0").select(F.col("embedding").cast("array<double>").alias("y"))
    return e.join(F.broadcast(first))


def _vector(name, expression, sql):
    @query(name, f"WITH {PAIR} SELECT vec_id, round({sql}, 5) AS v FROM p")
    def _(t):
        return _pairs(t).select("vec_id", r(expression(F.col("x"), F.col("y")), 5).alias("v"))


_vector("U01_dot", vectors.dot, "list_dot_product(x, y)")
_vector("U02_scaled", lambda x, y: vectors.norm(vectors.subtract(vectors.scaled(x, 2.5), y), 1), "list_sum([abs(2.5 * x[i] - y[i]) for i in range(1, 65)])")
_vector("U03_add_subtract", lambda x, y: vectors.norm(vectors.add(x, y), 1) + vectors.norm(vectors.subtract(x, y), 1), "list_sum([abs(x[i] + y[i]) + abs(x[i] - y[i]) for i in range(1, 65)])")
_vector("U04_norm", lambda x, y: vectors.norm(x, 3, 1), "pow(list_sum([pow(abs(v), 3) for v in x]), 1.0 / 3)")
_vector("U05_distance", lambda x, y: vectors.distance(x, y), "sqrt(list_sum([pow(x[i] - y[i], 2) for i in range(1, 65)]))")
_vector("U06_distance_present", lambda x, y: vectors.distance_present(F.transform(x, lambda v: F.when(v > 0, v)), y), "sqrt(list_avg([pow(x[i] - y[i], 2) for i in range(1, 65) if x[i] > 0]))")


@query("U07_gower", "SELECT a.s_suppkey, round(((CASE WHEN a.s_nationkey <> b.s_nationkey THEN 1 ELSE 0 END) + abs(a.s_acctbal - b.s_acctbal) / (SELECT max(s_acctbal) - min(s_acctbal) FROM supplier)) / 2, 6) AS v FROM supplier a JOIN (SELECT * FROM supplier ORDER BY s_suppkey LIMIT 1) b ON true")
def _(t):
    width = vectors.value_ranges(t.supplier, ["s_acctbal"]).first()[0]
    first = t.supplier.orderBy("s_suppkey").limit(1).select(F.col("s_nationkey").alias("n0"), F.col("s_acctbal").alias("b0"))
    both = t.supplier.join(F.broadcast(first))
    return both.select("s_suppkey", r(vectors.gower([F.col("s_nationkey"), F.col("s_acctbal")], [F.col("n0"), F.col("b0")], [True, False], [0.0, width])).alias("v"))


@query("U08_range_except", "SELECT n_nationkey, CAST(n_nationkey AS BIGINT) AS size FROM nation")
def _(t):
    return t.nation.select("n_nationkey", F.size(vectors.range_except(F.col("n_nationkey"), F.col("n_nationkey"))).cast("bigint").alias("size"))


@query("U09_mode", "SELECT l_quantity AS mode FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1")
def _(t):
    return vectors.most_frequent(t.lineitem, "l_quantity")


@query("U10_mid_ranks", "SELECT p_partkey, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS rank FROM part")
def _(t):
    return vectors.with_mid_ranks(t.part.select("p_partkey", "p_size"), "p_size").select("p_partkey", "rank")


@query("U11_ranges", "SELECT max(l_quantity) - min(l_quantity) AS l_quantity, round(max(l_tax) - min(l_tax), 6) AS l_tax FROM lineitem")
def _(t):
    return rounded(vectors.value_ranges(t.lineitem, ["l_quantity", "l_tax"]))


@query("U12_all_integers", "SELECT bool_and(l_quantity = floor(l_quantity)) AS a, bool_and(l_tax = floor(l_tax)) AS b FROM lineitem")
def _(t):
    return t.lineitem.agg(vectors.all_integers("l_quantity").alias("a"), vectors.all_integers("l_tax").alias("b"))


# Aggregates and model quality

SCORED = "SELECT l_extendedprice AS y, 1500.0 * l_quantity AS p FROM lineitem"


def scored(t):
    return t.lineitem.select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("p"), "l_orderkey", "l_linenumber")


@query("S01_moments", "SELECT round(avg(l_extendedprice), 3) AS mean, round(var_samp(l_quantity), 6) AS var, round(covar_samp(l_quantity, l_extendedprice), 3) AS cov FROM lineitem")
def _(t):
    return t.lineitem.agg(r(stats.mean("l_extendedprice"), 3).alias("mean"), r(stats.variance("l_quantity")).alias("var"), r(stats.covariance("l_quantity", "l_extendedprice"), 3).alias("cov"))


@query("S04_quality", f"""SELECT round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2, round(avg(abs(y - p)), 3) AS mae, round(avg((y - p) * (y - p)) / 1e6, 4) AS mse,
round(sqrt(avg((y - p) * (y - p))), 3) AS rmse FROM ({SCORED})""")
def _(t):
    return scored(t).agg(r(stats.r_squared("y", "p")).alias("r2"), r(stats.mae("y", "p"), 3).alias("mae"), r(stats.mse("y", "p") / 1e6, 4).alias("mse"), r(stats.rmse("y", "p"), 3).alias("rmse"))


@query("S05_r_adjusted", f"SELECT round(1 - (1 - (1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)))) * (count(*) - 1) / (count(*) - 2), 6) AS r2_adj FROM ({SCORED})")
def _(t):
    row = scored(t).agg(stats.r_squared("y", "p").alias("r2"), F.count("*").alias("n")).first()
    return rounded(one(t.spark, r2_adj=stats.r_adjusted(row.r2, row.n, 1)))


def simpson(upper: str, f: str) -> str:
    """SQL: the integral of f(u) from 0 to upper."""
    return f"list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i % 2000 = 0 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * list_transform([{upper} * i / 2000], lambda u: {f})[1])) * {upper} / 6000"


DENSITY = "exp(-u * u / 2) / sqrt(2 * pi())"


@query("S09_normal_cdf", f"SELECT x, round(0.5 + sign(x) * {simpson('abs(x)', DENSITY)}, 8) AS cdf FROM (SELECT unnest(range(-8, 9)) / 2.0::DOUBLE AS x)")
def _(t):
    return t.spark.createDataFrame([(x / 2, dist.normal_cdf(x / 2)) for x in range(-8, 9)], "x double, cdf double").select("x", r("cdf", 8).alias("cdf"))


@query("S10_log_likelihood", """SELECT round(-count(*) / 2.0 * (ln(2 * pi() * sum((y - p) * (y - p)) / count(*)) + 1), 1) AS gaussian,
round(sum(b * ln(greatest(least(q, 1 - 1e-15), 1e-15)) + (1 - b) * ln(1 - greatest(least(q, 1 - 1e-15), 1e-15))), 2) AS bernoulli
FROM (SELECT l_extendedprice AS y, 1500.0 * l_quantity AS p, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS b, l_discount * 5::DOUBLE AS q FROM lineitem)""")
def _(t):
    rows = t.lineitem.select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("p"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("b"), (F.col("l_discount") * 5.0).alias("q"))
    return rows.agg(r(stats.log_likelihood("y", "p"), 1).alias("gaussian"), r(stats.log_likelihood("b", "q", "bernoulli"), 2).alias("bernoulli"))


@query("S12_residual_stats", f"""SELECT round(avg(e), 3) AS mean, round(stddev_samp(e), 3) AS sd, round(max(abs(e)), 3) AS max_abs, round(quantile_cont(e, 0.25), 3) AS q1, round(quantile_cont(e, 0.5), 3) AS q2,
round(quantile_cont(e, 0.75), 3) AS q3 FROM (SELECT y - p AS e FROM ({SCORED}))""")
def _(t):
    return rounded(stats.residual_summary(stats.with_residuals(scored(t), "y", "p"), "residual"), 3)


@query("S13_durbin_watson", "SELECT round(1 - sum((e - p) * (e - p)) / sum(e * e) / 2, 6) AS rho FROM (SELECT e, lag(e) OVER (ORDER BY ts, event_id) AS p FROM (SELECT ts, event_id, value - 100 AS e FROM events))")
def _(t):
    return rounded(stats.durbin_watson(t.events.select("ts", "event_id", (F.col("value") - 100).alias("e")), "e", ORDER))


@query("S32_information", "SELECT 2 * 3.0::DOUBLE + 2 * 1000.0 AS aic, round(3 * ln(count(*)) + 2 * 1000.0, 6) AS bic FROM lineitem")
def _(t):
    return rounded(one(t.spark, aic=float(stats.aic(3, -1000.0)), bic=stats.bic(3, -1000.0, t.lineitem.count())))


# Regression

OLS2 = """m AS (SELECT var_samp(l_quantity) AS a, covar_samp(l_quantity, l_discount) AS b, var_samp(l_discount) AS d, covar_samp(l_quantity, l_extendedprice) AS u,
covar_samp(l_discount, l_extendedprice) AS v, avg(l_quantity) AS mq, avg(l_discount) AS md, avg(l_extendedprice) AS my FROM lineitem),
k AS (SELECT (d * u - b * v) / (a * d - b * b) AS bq, (a * v - b * u) / (a * d - b * b) AS bd, mq, md, my FROM m)"""


@query("R10_ols", f"""WITH {OLS2} SELECT name, round(beta, 3) AS beta FROM (SELECT 'intercept' AS name, my - bq * mq - bd * md AS beta FROM k UNION ALL SELECT 'l_quantity', bq FROM k
UNION ALL SELECT 'l_discount', bd FROM k)""")
def _(t):
    model = regression.LinearRegression().fit_without_stats(t.lineitem, ["l_quantity", "l_discount"], "l_extendedprice")
    return rounded(model.coefficients(t.spark).select("name", "beta"), 3)


AR1 = f"""{HOURLY}, w AS (SELECT CASE WHEN t = 0 THEN sqrt(0.75) ELSE 0.5 END AS c, CASE WHEN t = 0 THEN sqrt(0.75) * x ELSE x - 0.5 * lag(x) OVER o END AS x,
CASE WHEN t = 0 THEN sqrt(0.75) * y ELSE y - 0.5 * lag(y) OVER o END AS y FROM (SELECT t, y, (t % 24)::DOUBLE AS x FROM h) WINDOW o AS (ORDER BY t)),
g AS (SELECT count(*) AS n, sum(c * c) AS cc, sum(c * x) AS cx, sum(x * x) AS xx, sum(c * y) AS cy, sum(x * y) AS xy FROM w),
k AS (SELECT *, (xx * cy - cx * xy) / (cc * xx - cx * cx) AS a, (cc * xy - cx * cy) / (cc * xx - cx * cx) AS b FROM g),
e AS (SELECT sum(pow(w.y - a * w.c - b * w.x, 2)) / (any_value(n) - 2) AS s2 FROM w, k)"""


@query("R10_gls_ar1", f"WITH {AR1} SELECT 'intercept' AS name, round(a, 6) AS beta, round(sqrt(s2 * xx / (cc * xx - cx * cx)), 6) AS stderr FROM k, e UNION ALL SELECT 'x', round(b, 6), round(sqrt(s2 * cc / (cc * xx - cx * cx)), 6) FROM k, e")
def _(t):
    rows = hourly(t).withColumn("x", (F.col("t") % 24).cast("double"))
    return gls.fit_ar1(rows, ["x"], "y", ["t"], 0.5).coefficients(t.spark).select("name", r("beta").alias("beta"), r("stderr").alias("stderr"))


@query("R11_ols_report")
def _(t):
    model = regression.LinearRegression().fit(t.lineitem, FEATURES, "l_extendedprice", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return model.statistics(t.spark)


FITTED = f"""{OLS2}, e AS (SELECT l_extendedprice AS y, l_extendedprice - my - bq * (l_quantity - mq) - bd * (l_discount - md) AS e FROM lineitem, k),
s AS (SELECT count(*) AS n, sum(e * e) AS rss, var_pop(y) * count(*) AS tss, avg(abs(e)) AS mae FROM e),
v AS (SELECT rss / (n - 3) / (n - 1) / (a * d - b * b) AS w, a, b, d FROM s, m)"""


def _two(t):
    return regression.LinearRegression().fit(t.lineitem, ["l_quantity", "l_discount"], "l_extendedprice")


@query("R11_coefficients", f"""WITH {FITTED} SELECT name, round(beta, 3) AS beta, round(se, 4) AS stderr, round(beta / se, 4) AS t_stat FROM (SELECT 'l_quantity' AS name, bq AS beta, sqrt(w * d) AS se FROM k, v
UNION ALL SELECT 'l_discount', bd, sqrt(w * a) FROM k, v UNION ALL SELECT 'intercept', my - bq * mq - bd * md, sqrt(w * (n - 1) * (a * d - b * b) / n + w * (mq * mq * d - 2 * mq * md * b + md * md * a)) FROM k, v, s)""")
def _(t):
    return _two(t).coefficients(t.spark).select("name", r("beta", 3).alias("beta"), r("stderr", 4).alias("stderr"), r("t_stat", 4).alias("t_stat"))


@query("R11_statistics", f"""WITH {FITTED}, z AS (SELECT *, 1 - rss / tss AS r2 FROM s), c AS (SELECT 1 / (1 - pow(corr(l_quantity, l_discount), 2)) AS vif FROM lineitem)
SELECT name, round(value, 3) AS value FROM (SELECT 'n' AS name, n::DOUBLE AS value FROM z UNION ALL SELECT 'r2', r2 FROM z UNION ALL SELECT 'r2_adj', 1 - (1 - r2) * (n - 1) / (n - 3) FROM z
UNION ALL SELECT 'rmse', sqrt(rss / n) FROM z UNION ALL SELECT 'mae', mae FROM z UNION ALL SELECT 'f', r2 / 2 / ((1 - r2) / (n - 3)) FROM z UNION ALL SELECT 'vif_l_quantity', vif FROM c UNION ALL SELECT 'vif_l_discount', vif FROM c)""")
def _(t):
    return rounded(_two(t).statistics(t.spark).where(F.col("name").isin("n", "r2", "r2_adj", "rmse", "mae", "f", "vif_l_quantity", "vif_l_discount")), 3)


SIMPLE = """f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, avg(l_quantity) AS m, var_pop(l_quantity) * count(*) AS sxx, count(*) AS n FROM lineitem),
e AS (SELECT l_suppkey AS g, l_quantity AS x, l_quantity - m AS z, l_extendedprice - a - b * l_quantity AS e, 1.0 / n + (l_quantity - m) * (l_quantity - m) / sxx AS h, sxx, n FROM lineitem, f)"""


def _slope_error(t, **how):
    model = regression.LinearRegression(**how).fit(t.lineitem, ["l_quantity"], "l_extendedprice")
    return rounded(one(t.spark, beta=float(model.beta[1]), stderr=float(model.stderr[1])), 4)


@query("S21_classical", f"WITH {SIMPLE} SELECT round(any_value(f.b), 4) AS beta, round(sqrt(sum(e * e) / (any_value(e.n) - 2) / any_value(e.sxx)), 4) AS stderr FROM e, f")
def _(t):
    return _slope_error(t)


@query("S22_hc3", f"WITH {SIMPLE} SELECT round(any_value(f.b), 4) AS beta, round(sqrt(sum(z * z * e * e / ((1 - h) * (1 - h))) / pow(any_value(e.sxx), 2)), 4) AS stderr FROM e, f")
def _(t):
    return _slope_error(t, covariance="HC3")


@query("S24_cluster", f"""WITH {SIMPLE}, u AS (SELECT g, sum(z * e) AS u FROM e GROUP BY 1)
SELECT round((SELECT b FROM f), 4) AS beta, round(sqrt((SELECT sum(u * u) FROM u) * (SELECT count(*) / (count(*) - 1.0) FROM u) * (n - 1) / (n - 2)) / sxx, 4) AS stderr FROM f""")
def _(t):
    return _slope_error(t, covariance="cluster", cluster="l_suppkey")


SERIES = f"""{HOURLY}, f AS (SELECT regr_slope(y, t::DOUBLE) AS b, regr_intercept(y, t::DOUBLE) AS a, avg(t) AS m, var_pop(t::DOUBLE) * count(*) AS sxx, count(*) AS n, CAST(floor(4 * pow(count(*) / 100.0, 2.0 / 9)) AS INT) AS lags FROM h)"""


@query("S23_hac", f"""WITH {SERIES}, s AS (SELECT t, (t - m) * (y - a - b * t) AS s FROM h, f),
g AS (SELECT l, sum(p.s * q.s) AS g FROM (SELECT unnest(range(0, lags + 1)) AS l FROM f) JOIN s p ON true JOIN s q ON q.t = p.t - l GROUP BY 1)
SELECT round((SELECT b FROM f), 6) AS beta, round(sqrt(sum(CASE WHEN l = 0 THEN g ELSE 2 * (1 - l / (lags + 1.0)) * g END)) / any_value(sxx), 6) AS stderr FROM g, f""")
def _(t):
    s = hourly(t).select(F.col("t").cast("double").alias("t"), "y")
    model = regression.LinearRegression("HAC").fit(s, ["t"], "y", ["t"])
    return rounded(one(t.spark, beta=float(model.beta[1]), stderr=float(model.stderr[1])))


@query("S26_fisher", "SELECT round(r2 * (n - 2) / (1 - r2), 6) AS f FROM (SELECT regr_r2(l_extendedprice, l_quantity) AS r2, count(*) AS n FROM lineitem)")
def _(t):
    model = regression.LinearRegression().fit(t.lineitem, ["l_quantity"], "l_extendedprice")
    return rounded(one(t.spark, f=float(model.stats["f"])))


BETA = "u * u * pow(1 - u * u, 19)"


@query("S27_tails", f"""SELECT x, round(1 - 2 * exp(lgamma(21.5) - lgamma(1.5) - lgamma(20)) * {simpson('sqrt(3 * x / (3 * x + 40))', BETA)}, 8) AS f,
round(1 - {simpson('sqrt(x)', 'sqrt(2 / pi()) * u * u * exp(-u * u / 2)')}, 8) AS chi2, round(1 - 2 * {simpson('x', DENSITY)}, 8) AS normal FROM (SELECT unnest(range(0, 13)) / 2.0::DOUBLE AS x)""")
def _(t):
    return rounded(t.spark.createDataFrame([(x / 2, dist.f_p_value(x / 2, 3, 40), dist.chi2_p_value(x / 2, 3), dist.normal_p_value(x / 2)) for x in range(13)], "x double, f double, chi2 double, normal double"), 8)


@query("S30_breusch_pagan", f"WITH {SIMPLE} SELECT round(count(*) * regr_r2(e * e, x), 4) AS lm FROM e")
def _(t):
    rows = regression.residuals(regression.LinearRegression().fit_without_stats(t.lineitem, ["l_quantity"], "l_extendedprice"), t.lineitem)
    return rounded(one(t.spark, lm=inference.breusch_pagan(rows, ["l_quantity"], "_e")[0]), 4)


@query("S31_vif", "SELECT round(1 / (1 - pow(corr(l_quantity, l_discount), 2)), 6) AS vif FROM lineitem")
def _(t):
    return rounded(one(t.spark, vif=float(inference.vif(moments(t.lineitem, ["l_quantity", "l_discount"]), 2)[0])))


@query("R02_predict", f"WITH {OLS2} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(my + bq * (l_quantity - mq) + bd * (l_discount - md), 2) AS prediction FROM lineitem, k")
def _(t):
    model = regression.LinearRegression().fit_without_stats(t.lineitem, ["l_quantity", "l_discount"], "l_extendedprice")
    return model.predict(t.lineitem).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r("prediction", 2).alias("prediction"))


@query("R10_weighted", "SELECT round((sum(w * x * y) - sum(w * x) * sum(w * y) / sum(w)) / (sum(w * x * x) - sum(w * x) * sum(w * x) / sum(w)), 4) AS beta FROM (SELECT 1 / (1 + l_quantity) AS w, l_quantity AS x, l_extendedprice AS y FROM lineitem)")
def _(t):
    rows = t.lineitem.withColumn("var", 1 + F.col("l_quantity"))
    model = regression.LinearRegression(variance="var").fit_without_stats(rows, ["l_quantity"], "l_extendedprice")
    return rounded(one(t.spark, beta=float(model.coef[0])), 4)


POP = "p AS (SELECT covar_pop(l_quantity, l_extendedprice) AS c, var_pop(l_quantity) AS v, count(*) AS n FROM lineitem)"


@query("R20_ridge", f"WITH {POP} SELECT round(c * n / (v * n + 1000), 4) AS beta FROM p")
def _(t):
    return rounded(one(t.spark, beta=float(regression.RidgeRegression(1000.0).fit_without_stats(t.lineitem, ["l_quantity"], "l_extendedprice").coef[0])), 4)


@query("R21_ridge_df", f"WITH {POP} SELECT round(v * n / (v * n + 1000), 6) AS df FROM p")
def _(t):
    model = regression.RidgeRegression(1000.0).fit(t.lineitem, ["l_quantity"], "l_extendedprice")
    return rounded(one(t.spark, df=float(model.stats["df"])))


@query("R30_lasso", f"WITH {POP} SELECT round(sign(c) * greatest(abs(c) - 100, 0) / v, 4) AS beta FROM p")
def _(t):
    return rounded(one(t.spark, beta=float(regression.LassoRegression(100.0).fit_without_stats(t.lineitem, ["l_quantity"], "l_extendedprice").coef[0])), 4)


@query("R40_elastic_net", f"WITH {POP} SELECT round(sign(c) * greatest(abs(c) - 40 * 0.25, 0) / (v + 40 * 0.75), 4) AS beta FROM p")
def _(t):
    return rounded(one(t.spark, beta=float(regression.ElasticNetRegression(40.0, 0.25).fit_without_stats(t.lineitem, ["l_quantity"], "l_extendedprice").coef[0])), 4)


#: Two features that go together, so that a coordinate step moves the other coefficient.
PAIRED = """r AS (SELECT l_quantity AS x, l_quantity + 5 * l_linenumber AS z, l_extendedprice AS y FROM lineitem),
m AS (SELECT var_pop(x) AS a, covar_pop(x, z) AS b, var_pop(z) AS d, covar_pop(x, y) AS u, covar_pop(z, y) AS v, count(*) AS n FROM r)"""


def _paired(t):
    return t.lineitem.select(F.col("l_quantity").alias("x"), (F.col("l_quantity") + 5 * F.col("l_linenumber")).alias("z"), F.col("l_extendedprice").alias("y"))


def _both(t, model):
    fit = model.fit_without_stats(_paired(t), ["x", "z"], "y")
    return rounded(one(t.spark, x=float(fit.coef[0]), z=float(fit.coef[1])), 2)


def _descent(alpha: float, share: float) -> str:
    """SQL of coordinate descent from 0."""
    soft = lambda c: f"sign({c}) * greatest(abs({c}) - {alpha * share}, 0)"
    return f"""WITH RECURSIVE {PAIRED}, s(i, x, z) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT i + 1, x, {soft('(v - b * x)')} / (d + {alpha * (1 - share)}) FROM
(SELECT i, z, {soft('(u - b * z)')} / (a + {alpha * (1 - share)}) AS x FROM s, m WHERE i < 400), m) SELECT round(x, 2) AS x, round(z, 2) AS z FROM s WHERE i = 400"""


@query("R20_ridge_two", f"WITH {PAIRED}, p AS (SELECT a * n + 1e5 AS a, b * n AS b, d * n + 1e5 AS d, u * n AS u, v * n AS v FROM m) SELECT round((d * u - b * v) / (a * d - b * b), 2) AS x, round((a * v - b * u) / (a * d - b * b), 2) AS z FROM p")
def _(t):
    return _both(t, regression.RidgeRegression(1e5))


@query("R30_lasso_two", _descent(50.0, 1.0))
def _(t):
    return _both(t, regression.LassoRegression(50.0))


@query("R40_elastic_net_two", _descent(40.0, 0.25))
def _(t):
    return _both(t, regression.ElasticNetRegression(40.0, 0.25))


@query("R22_optimal_lambda")
def _(t):
    return validate.optimal_lambda(t.lineitem, FEATURES, "l_extendedprice", "l_orderkey", 0.01, 1e6, 9).table(t.spark)


@query("R50_stepwise")
def _(t):
    return regression.StepwiseRegression("stepwise", "bic").fit(t.lineitem, FEATURES, "l_extendedprice").coefficients(t.spark)


@query("R51_forward")
def _(t):
    return regression.StepwiseRegression("forward", "alpha").fit(t.lineitem, FEATURES, "l_extendedprice").coefficients(t.spark)


@query("R52_backward")
def _(t):
    return regression.StepwiseRegression("backward", "aic").fit(t.lineitem, FEATURES, "l_extendedprice").coefficients(t.spark)


# Validation

FOLDED = "o AS (SELECT o_custkey::DOUBLE AS x, o_totalprice AS y, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () // 5 AS size FROM orders), d AS (SELECT x, y, i // size AS fold FROM o WHERE i < size * 5)"
FITS = "k AS (SELECT f AS fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM d JOIN (SELECT unnest(range(5)) AS f) ON fold <> f GROUP BY 1)"


def _cv(t, metric):
    rows = t.orders.select("o_orderkey", F.col("o_custkey").cast("double").alias("x"), F.col("o_totalprice").alias("y"))
    return validate.cross_validation(regression.LinearRegression(), rows, ["x"], "y", "o_orderkey", 5, metric)


@query("V01_cross_validation", f"WITH {FOLDED}, {FITS} SELECT CAST(fold AS INT) AS fold, round(avg(pow(y - a - b * x, 2)) / 1e6, 4) AS score FROM d JOIN k USING (fold) GROUP BY 1")
def _(t):
    return _cv(t, "mse").table(t.spark).select("fold", r(F.col("score") / 1e6, 4).alias("score"))


@query("V01_absolute", f"WITH {FOLDED}, {FITS} SELECT CAST(fold AS INT) AS fold, round(avg(abs(y - a - b * x)), 3) AS score FROM d JOIN k USING (fold) GROUP BY 1")
def _(t):
    return rounded(_cv(t, "mae").table(t.spark), 3)


@query("V02_grid_search")
def _(t):
    return validate.grid_search(regression.ElasticNetRegression(), t.lineitem, FEATURES, "l_extendedprice", "l_orderkey", {"alpha": [1.0, 10.0, 100.0], "l1_ratio": [0.2, 0.8]}).table(t.spark)


RIDGED = """g AS (SELECT lam, f AS fold, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) * count(*) / (var_pop(x) * count(*) + lam) AS b FROM d JOIN (SELECT unnest(range(5)) AS f) ON fold <> f, (SELECT unnest({lams}) AS lam) GROUP BY 1, 2),
h AS (SELECT lam, fold, avg(pow(y - my - b * (x - mx), 2)) AS score FROM d JOIN g USING (fold) GROUP BY 1, 2)
SELECT round(lam, 4) AS lam, round(avg(score) / 1e6, 4) AS score FROM h GROUP BY lam"""


def _searched(found, t):
    return found.table(t.spark).select(r(F.col("params")["lam"], 4).alias("lam"), r(F.col("score") / 1e6, 4).alias("score"))


def _customers(t):
    return t.orders.select("o_orderkey", F.col("o_custkey").cast("double").alias("x"), F.col("o_totalprice").alias("y"))


@query("V02_ridge_grid", f"WITH {FOLDED}, " + RIDGED.format(lams="[0.0, 1e8, 1e10]::DOUBLE[]"))
def _(t):
    return _searched(validate.grid_search(regression.RidgeRegression(), _customers(t), ["x"], "y", "o_orderkey", {"lam": [0.0, 1e8, 1e10]}), t)


@query("R22_lambda_path", f"WITH {FOLDED}, " + RIDGED.format(lams="[1e6, 1e8, 1e10]::DOUBLE[]"))
def _(t):
    return _searched(validate.optimal_lambda(_customers(t), ["x"], "y", "o_orderkey", 1e6, 1e10, 3), t)


@query("V03_random_search")
def _(t):
    return validate.random_search(regression.RidgeRegression(), t.lineitem, FEATURES, "l_extendedprice", "l_orderkey", {"lam": (0.1, 1e5, "log")}, n_iter=20).table(t.spark)


# Preprocessing


def _imputed(name, method, sql):
    @query(name, f"SELECT event_id, round(coalesce(v, {sql}), 6) AS value FROM (SELECT event_id, ts, {GAPS} AS v FROM events)")
    def _(t):
        return impute.impute(gaps(t), "value", method, ORDER).select("event_id", r("value").alias("value"))


_imputed("P01_mean", "mean", "avg(v) OVER ()")
_imputed("P02_median", "median", "quantile_cont(v, 0.5) OVER ()")
_imputed("P04_forward", "forward", "last_value(v IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
_imputed("P05_backward", "backward", "first_value(v IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")


@query("P03_mode", """WITH g AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_quantity END AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, coalesce(q, (SELECT q FROM g WHERE q IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS q FROM g""")
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.expr("CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_quantity END").alias("q"))
    return impute.impute(rows, "q", "mode")


@query("P06_knn", """WITH s AS (SELECT s_suppkey, s_nationkey::DOUBLE AS n, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_acctbal END AS b FROM supplier),
d AS (SELECT a.s_suppkey, c.b, abs(a.n - c.n) AS d, row_number() OVER (PARTITION BY a.s_suppkey ORDER BY abs(a.n - c.n), c.s_suppkey) AS r FROM s a JOIN s c ON a.b IS NULL AND c.b IS NOT NULL),
f AS (SELECT s_suppkey, CASE WHEN min(d) = 0 THEN any_value(b) FILTER (WHERE r = 1) ELSE sum(b / d) FILTER (WHERE d > 0) / sum(1 / d) FILTER (WHERE d > 0) END AS v FROM d WHERE r <= 3 GROUP BY 1)
SELECT s_suppkey, round(coalesce(b, v), 6) AS b FROM s LEFT JOIN f USING (s_suppkey)""")
def _(t):
    rows = t.supplier.select("s_suppkey", F.col("s_nationkey").cast("double").alias("n"), F.expr("CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_acctbal END").alias("b"))
    return impute.knn_impute(rows, "s_suppkey", ["n", "b"], 3).select("s_suppkey", r("b").alias("b"))


def _scaled(name, method, sql, **how):
    @query(name, f"SELECT o_orderkey, round({sql}, 6) AS v FROM (SELECT o_orderkey, o_totalprice AS x FROM orders)")
    def _(t):
        return scale.scale(t.orders.select("o_orderkey", F.col("o_totalprice").alias("v")), "v", method, **how).select("o_orderkey", r("v").alias("v"))


_scaled("P07_standard", "standard", "(x - avg(x) OVER ()) / (stddev_samp(x) OVER ())")
_scaled("P08_mean", "mean", "(x - avg(x) OVER ()) / (max(x) OVER () - min(x) OVER ())")
_scaled("P09_minmax", "minmax", "-1 + (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) * 3", low=-1.0, high=2.0)
_scaled("P10_robust", "robust", "(x - quantile_cont(x, 0.5) OVER ()) / (quantile_cont(x, 0.75) OVER () - quantile_cont(x, 0.25) OVER ())")


def _transformed(name, method, lam, sql):
    @query(name, f"SELECT c_custkey, round({sql}, 4) AS v FROM (SELECT c_custkey, c_acctbal AS x FROM customer)")
    def _(t):
        return scale.transform(t.customer.select("c_custkey", F.col("c_acctbal").alias("v")), "v", method, lam).select("c_custkey", r("v", 4).alias("v"))


_transformed("P11_log", "log", 0.0, "CASE WHEN x > 0 THEN ln(x) END")
_transformed("P12_box_cox", "box_cox", 0.5, "CASE WHEN x > 0 THEN (pow(x, 0.5) - 1) / 0.5 END")
_transformed("P13_yeo_johnson", "yeo_johnson", 0.5, "CASE WHEN x >= 0 THEN (pow(x + 1, 0.5) - 1) / 0.5 ELSE -(pow(1 - x, 1.5) - 1) / 1.5 END")
_transformed("P14_power", "power", 2.0, "pow(x, 2)")


@query("P15_split", "SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey) <= least(floor(count(*) OVER () * 0.7 + 0.5), count(*) OVER () - 1) THEN 'train' ELSE 'test' END AS split FROM orders")
def _(t):
    return split.train_test_split(t.orders.select("o_orderkey"), "o_orderkey", 70)


@query("P16_three_way", """SELECT o_orderkey, CASE WHEN i <= a THEN 'train' WHEN i <= a + b THEN 'valid' ELSE 'test' END AS split FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS i,
least(floor(count(*) OVER () * 0.6 + 0.5), count(*) OVER () - 2) AS a, greatest(floor(count(*) OVER () * 0.2 + 0.5), 1) AS b FROM orders)""")
def _(t):
    return split.train_test_split(t.orders.select("o_orderkey"), "o_orderkey", [60, 20])


@query("P17_stratified", """SELECT o_orderkey, o_orderstatus, CASE WHEN row_number() OVER w <= least(floor(count(*) OVER (PARTITION BY o_orderstatus) * 0.7 + 0.5), count(*) OVER (PARTITION BY o_orderstatus) - 1)
THEN 'train' ELSE 'test' END AS split FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderkey)""")
def _(t):
    return split.stratified_split(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", 70)


@query("P18_stratified_three_way", """SELECT o_orderkey, o_orderstatus, CASE WHEN i <= a THEN 'train' WHEN i <= a + least(greatest(floor(n * 0.2 + 0.5), 1), n - a - 1) THEN 'valid' ELSE 'test' END AS split
FROM (SELECT *, least(floor(n * 0.6 + 0.5), n - 2) AS a FROM (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders))""")
def _(t):
    return split.stratified_split(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", [60, 20])


@query("P19_pca")
def _(t):
    return rounded(pca.PCA(2).fit(t.lineitem, FEATURES).summary(t.spark))


@query("P20_pca_transform")
def _(t):
    return rounded(pca.PCA(2).fit_transform(t.lineitem.select("l_orderkey", "l_linenumber", *FEATURES), FEATURES), 4)


EIGEN = f"{PAIRED}, w AS (SELECT *, (a + d) / 2 + sqrt(pow((a - d) / 2, 2) + b * b) AS l1, (a + d) / 2 - sqrt(pow((a - d) / 2, 2) + b * b) AS l2 FROM m)"


@query("P19_pca_two", f"WITH {EIGEN} SELECT 1 AS component, round(l1, 4) AS eigenvalue, round(l1 / (a + d), 4) AS ratio FROM w UNION ALL SELECT 2, round(l2, 4), round(l2 / (a + d), 4) FROM w")
def _(t):
    return rounded(pca.PCA(2).fit(_paired(t), ["x", "z"]).summary(t.spark), 4)


@query("P20_pca_two", f"""WITH {EIGEN}, c AS (SELECT b / sqrt(b * b + pow(l1 - a, 2)) AS p, (l1 - a) / sqrt(b * b + pow(l1 - a, 2)) AS q FROM w), k AS (SELECT p * sign(CASE WHEN abs(p) > abs(q) THEN p ELSE q END) AS p,
q * sign(CASE WHEN abs(p) > abs(q) THEN p ELSE q END) AS q FROM c) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(p * (l_quantity - (SELECT avg(x) FROM r)) + q * (l_quantity + 5 * l_linenumber - (SELECT avg(z) FROM r)), 4) AS pc1 FROM lineitem, k""")
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("x"), (F.col("l_quantity") + 5 * F.col("l_linenumber")).alias("z"))
    return pca.PCA(1).fit_transform(rows, ["x", "z"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r("pc1", 4).alias("pc1"))


# Clusters

CENTRES = [(10.0, 0.02), (25.0, 0.05), (40.0, 0.08)]
ASSIGNED = "a AS (SELECT *, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS cluster FROM (SELECT *, " + ", ".join(f"pow(l_quantity - {a}, 2) + pow(l_discount - {b}, 2) AS d{i}" for i, (a, b) in enumerate(CENTRES)) + " FROM lineitem))"


@query("K06_assign", f"WITH {ASSIGNED} SELECT l_orderkey, l_linenumber, l_partkey, cluster FROM a")
def _(t):
    return kmeans.assign(t.lineitem, ["l_quantity", "l_discount"], np.array(CENTRES)).select("l_orderkey", "l_linenumber", "l_partkey", "cluster")


@query("K03_lloyd_step", f"WITH {ASSIGNED} SELECT cluster, count(*) AS n, round(sum(least(d0, d1, d2)), 3) AS inertia, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_discount), 6) AS l_discount FROM a GROUP BY 1")
def _(t):
    step = kmeans.update(kmeans.assign(t.lineitem, ["l_quantity", "l_discount"], np.array(CENTRES)), ["l_quantity", "l_discount"])
    return step.select("cluster", "n", r("inertia", 3).alias("inertia"), r("l_quantity").alias("l_quantity"), r("l_discount").alias("l_discount"))


DIMENSIONS = [f"x{i}" for i in range(64)]


def _points(t):
    return t.embeddings.select("vec_id", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(DIMENSIONS)))


def _centres(t, model):
    return t.spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(model.centres)], "cluster int, " + ", ".join(f"{c} double" for c in model.columns))


def _kmeans(name, **how):
    @query(name)
    def _(t):
        points = write_table(_points(t))
        return _centres(t, kmeans.KMeans(**how).fit(points, DIMENSIONS, "vec_id"))


_kmeans("K01_kmeans", k=3)
_kmeans("K04_minibatch", k=3, method="minibatch")
_kmeans("K05_online", k=3, n_init=1, method="online")


@query("K02_plus_plus")
def _(t):
    found = kmeans.plus_plus(_points(t), DIMENSIONS, "vec_id", 3)
    return t.spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(found)], "cluster int, " + ", ".join(f"{c} double" for c in DIMENSIONS))


GROUPS = "l_linenumber + CASE WHEN l_linenumber > 3 THEN 100 ELSE 0 END"


@query("K01_two_groups", f"SELECT count(*) AS n, round(avg({GROUPS}), 6) AS centre FROM lineitem GROUP BY l_linenumber > 3")
def _(t):
    rows = t.lineitem.select("l_orderkey", F.expr(GROUPS).cast("double").alias("x"))
    model = kmeans.KMeans(k=2).fit(rows, ["x"], "l_orderkey")
    centres = t.spark.createDataFrame([(i, float(c[0])) for i, c in enumerate(model.centres)], "cluster int, centre double")
    return model.labels.groupBy("cluster").agg(F.count("*").alias("n")).join(centres, "cluster").select("n", r("centre").alias("centre"))


@query("K02_distinct_values", "SELECT DISTINCT CAST(n_regionkey AS DOUBLE) AS x FROM nation")
def _(t):
    return t.spark.createDataFrame([(float(c[0]),) for c in kmeans.plus_plus(t.nation, ["n_regionkey"], "n_nationkey", 5)], "x double")


@query("K08_labels", "SELECT n_nationkey, CAST(n_regionkey AS DOUBLE) AS centre FROM nation")
def _(t):
    model = kmeans.KMeans(k=5).fit(t.nation, ["n_regionkey"], "n_nationkey")
    centres = t.spark.createDataFrame([(i, float(c[0])) for i, c in enumerate(model.centres)], "cluster int, centre double")
    return model.labels.join(centres, "cluster").select("n_nationkey", r("centre").alias("centre"))


@query("K05_stream_update")
def _(t):
    online = OnlineKMeans(np.array(CENTRES), ["l_quantity", "l_discount"])
    online.update(t.lineitem, 0)
    return t.spark.createDataFrame([(i, float(n), *map(float, c)) for i, (n, c) in enumerate(zip(online.seen, online.centres, strict=True))], "cluster int, seen double, l_quantity double, l_discount double")


@query("K07_elbow")
def _(t):
    model = kmeans.KMeans()
    k = model.select_k(write_table(_points(t)), DIMENSIONS, "vec_id")
    return t.spark.createDataFrame([(n, float(i), n == k) for n, i in model.elbow.items()], "k int, inertia double, chosen boolean")


# Time series


@query("T09_acf", f"WITH {HOURLY}, z AS (SELECT t, y - avg(y) OVER () AS y FROM h), c AS (SELECT l AS lag, sum(a.y * b.y) AS c FROM (SELECT unnest(range(0, 25)) AS l) JOIN z a ON true JOIN z b ON b.t = a.t - l GROUP BY 1) SELECT CAST(lag AS INT) AS lag, round(c / (SELECT c FROM c WHERE lag = 0), 6) AS rho FROM c")
def _(t):
    return rounded(timeseries.acf(hourly(t), 24))


@query("T01_difference", f"WITH {HOURLY} SELECT t - 1 AS t, round(y - p, 6) AS y FROM (SELECT t, y, lag(y) OVER (ORDER BY t) AS p FROM h) WHERE p IS NOT NULL")
def _(t):
    return rounded(timeseries.difference(hourly(t)))


@query("T06_detrend", f"WITH {HOURLY} SELECT t, round(y - (SELECT regr_intercept(y, t::DOUBLE) FROM h) - (SELECT regr_slope(y, t::DOUBLE) FROM h) * t, 6) AS y FROM h")
def _(t):
    return rounded(timeseries.detrend(hourly(t)))


@query("T03_periodogram", f"WITH {HOURLY}, n AS (SELECT count(*) AS n FROM h) SELECT k, round(pow(sum(y * cos(2 * pi() * (k * t % n) / n)), 2) + pow(sum(y * sin(2 * pi() * (k * t % n) / n)), 2), 2) AS power FROM h, n, (SELECT unnest(range(1, (SELECT n // 2 FROM n))) AS k) GROUP BY 1")
def _(t):
    return rounded(timeseries.periodogram(hourly(t)), 2)


@query("T04_kruskal_wallis", f"""WITH {HOURLY}, k AS (SELECT t % 24 AS g, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS k, count(*) OVER () AS n FROM h)
SELECT round(12.0 / (any_value(n) * (any_value(n) + 1)) * sum(s) - 3 * (any_value(n) + 1), 6) AS h FROM (SELECT g, sum(k) * sum(k) / count(*) AS s, any_value(n) AS n FROM k GROUP BY g)""")
def _(t):
    return rounded(one(t.spark, h=timeseries.kruskal_wallis(hourly(t), 24)[0]))


@query("T13_critical_value", f"WITH {HOURLY} SELECT round(-2.8621 - 2.738 / count(*) - 3.394 / pow(count(*), 2), 6) AS v FROM h")
def _(t):
    return rounded(one(t.spark, v=timeseries.critical_value(hourly(t).count())))


ORDERS = f"""WITH RECURSIVE {HOURLY}, z AS (SELECT t, y - avg(y) OVER () AS y FROM h), n AS (SELECT count(*) AS n, 1.96 / sqrt(count(*)) AS most, least(40, count(*) // 4) AS m, least(40, count(*) // 2) AS m2 FROM h),
c AS (SELECT l AS lag, sum(a.y * b.y) AS c FROM (SELECT unnest(range(0, 41)) AS l) JOIN z a ON true JOIN z b ON b.t = a.t - l GROUP BY 1),
rho AS (SELECT lag, c / (SELECT c FROM c WHERE lag = 0) AS rho FROM c),
l AS (SELECT s, m // s AS m, (SELECT list(rho ORDER BY lag) FROM rho WHERE lag % s = 0) AS r FROM n, (SELECT unnest([1, 6]) AS s)),
dl AS (SELECT s, 1::BIGINT AS k, [r[2]] AS phi FROM l WHERE m >= 1 UNION ALL SELECT s, k + 1, list_append(list_transform(range(1, k + 1), lambda j: phi[j] - w * phi[k + 1 - j]), w)
FROM (SELECT s, k, phi, (r[k + 2] - list_dot_product(phi, list_reverse(r[2:k + 1]))) / (1 - list_dot_product(phi, r[2:k + 1])) AS w FROM dl JOIN l USING (s) WHERE k < m)),
ar AS (SELECT s, bool_or(k = 1 AND big) AS first, coalesce(min(k) FILTER (WHERE k >= 2 AND NOT big), max(k) + 1) AS stop FROM (SELECT s, k, abs(phi[k]) > most AS big FROM dl, n) GROUP BY s),
ma AS (SELECT s, coalesce(min(lag // s) FILTER (WHERE abs(rho) <= most) - 1, 0) AS q FROM rho, n, (SELECT unnest([1, 6]) AS s) WHERE lag % s = 0 AND lag // s BETWEEN 1 AND m // s GROUP BY s),
up AS (SELECT lag, rho, lag(rho) OVER (ORDER BY lag) AS before, lead(rho) OVER (ORDER BY lag) AS after FROM rho),
f AS (SELECT k, pow(sum(y * cos(2 * pi() * (k * t % n) / n)), 2) + pow(sum(y * sin(2 * pi() * (k * t % n) / n)), 2) AS power FROM h, n, (SELECT unnest(range(1, (SELECT n // 2 FROM n))) AS k) GROUP BY 1)"""
LAST = "CASE WHEN stop > 2 THEN stop - 1 WHEN first THEN 1 ELSE 0 END"


@query("T07_orders", f"""{ORDERS} SELECT coalesce((SELECT min(lag) FROM up, n WHERE lag BETWEEN 4 AND m2 - 1 AND rho > before AND rho > after AND abs(rho) > most), 0) AS period,
(SELECT CAST(floor(any_value(n) / arg_max(k, power) + 0.5) AS BIGINT) FROM f, n) AS fourier, (SELECT q FROM ma WHERE s = 1) AS q, (SELECT {LAST} FROM ar WHERE s = 1) AS p,
(SELECT q FROM ma WHERE s = 6) AS seasonal_q, (SELECT {LAST} FROM ar WHERE s = 6) AS seasonal_p""")
def _(t):
    s = hourly(t)
    return one(t.spark, period=timeseries.acf_period(s), fourier=timeseries.fourier_period(s), q=timeseries.acf_order(s), p=timeseries.pacf_order(s), seasonal_q=timeseries.seasonal_acf_order(s, 6), seasonal_p=timeseries.seasonal_pacf_order(s, 6))


@query("T11_adf")
def _(t):
    return one(t.spark, t=timeseries.adf(hourly(t)))


@query("T01_arima")
def _(t):
    p, d, q = timeseries.detect_arima(hourly(t))
    return one(t.spark, p=p, d=d, q=q)


@query("T02_sarima")
def _(t):
    return one(t.spark, **{k: int(v) for k, v in ((f"seasonal_{k.lower()}" if k in "PDQ" else k, v) for k, v in timeseries.detect_sarima(hourly(t)).items())})
