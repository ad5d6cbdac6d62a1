"""The registered queries over the driver's tables, each with its SQL where SQL can express it.

Queries with SQL are exact operators; those without are trained models, whose
results tests hold against published values and invariants.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import activations as act
from brindle.functions import arrays, distances, pmf
from brindle.operators import cluster, gmm, impute, linear, measures, nn, prep, stats, trees, tune
from brindle.operators.base import Verbosity, model_load, model_save

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def query(sql: str | None = None):
    def add(f):
        name = f.__name__.rstrip("_")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r(x, n: int = 6):
    return F.round(x, n)


ITEM = ["l_quantity", "l_extendedprice", "l_discount"]

# ---------------------------------------------------------------- scalers, encoders, moments


def _scaled(spark, sf, method, inverse=False):
    df = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *ITEM)
    m = prep.Scaler(method=method, cache=False).fit(df, ITEM)
    out = m.inverse_transform(m.transform(df)) if inverse else m.transform(df)
    return out.select("l_orderkey", "l_linenumber", *[r(c, 4).alias(c) for c in ITEM])


_Z = ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 4) + 0.0 AS {c}" for c in ITEM)
_MM = ", ".join(f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 4) AS {c}" for c in ITEM)


@query(f"SELECT l_orderkey, l_linenumber, {_Z} FROM lineitem")
def zscore(spark, sf):
    return _scaled(spark, sf, prep.Standard())


@query(f"SELECT l_orderkey, l_linenumber, {_MM} FROM lineitem")
def minmax(spark, sf):
    return _scaled(spark, sf, prep.MinMax())


@query("SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({c}, 4) AS {c}" for c in ITEM) + " FROM lineitem")
def zscore_inverse(spark, sf):
    return _scaled(spark, sf, prep.Standard(), inverse=True)


def _cats(df):
    return sorted(x[0] for x in df.select("o_orderpriority").distinct().collect())


@query("""SELECT o_orderkey, list_transform((SELECT list(DISTINCT o_orderpriority ORDER BY o_orderpriority) FROM orders), lambda c: c = o_orderpriority)::VARCHAR AS encoded FROM orders""")
def onehot(spark, sf):
    df = t(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    m = prep.OneHotEncoder(categories=_cats(df), cache=False).fit(df, "o_orderpriority")
    shown = F.concat(F.lit("["), F.array_join(F.transform("encoded", lambda b: b.cast("string")), ", "), F.lit("]"))
    return m.transform(df).select("o_orderkey", shown.alias("encoded"))


@query("""SELECT o_orderkey, list_position((SELECT list(DISTINCT o_orderpriority ORDER BY o_orderpriority) FROM orders), o_orderpriority)::INT AS encoded FROM orders""")
def ordinal(spark, sf):
    df = t(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return prep.OrdinalEncoder(categories=_cats(df), cache=False).fit(df, "o_orderpriority").transform(df).select("o_orderkey", "encoded")


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END::INT AS encoded, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus ELSE 'other' END AS decoded FROM orders""")
def ordinal_infrequent_inverse(spark, sf):
    df = t(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    m = prep.OrdinalEncoder(categories=["F", "O"], handle_unknown="infrequent", other_categories_name="other", cache=False).fit(df, "o_orderstatus")
    return m.inverse_transform(m.transform(df)).select("o_orderkey", "encoded", "decoded")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'other' END AS decoded FROM orders""")
def onehot_infrequent(spark, sf):
    df = t(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    m = prep.OneHotEncoder(categories=["F"], handle_unknown="infrequent", other_categories_name="other", cache=False).fit(df, "o_orderstatus")
    return m.inverse_transform(m.transform(df)).select("o_orderkey", "decoded")


@query(" UNION ALL ".join(f"SELECT '{a}' AS i, '{b}' AS j, round(covar_pop({a}, {b}), 3) AS covariance FROM lineitem" for a in ITEM for b in ITEM))
def pca_cov(spark, sf):
    return prep.covariance(t(spark, sf, "lineitem"), ITEM).select("i", "j", r("covariance", 3).alias("covariance"))


_COV = ", ".join("[" + ", ".join(f"covar_pop({a}, {b})" for b in ITEM) + f"] AS r{k}" for k, a in enumerate(ITEM))
_TIMES = "[list_inner_product(r0, {0}), list_inner_product(r1, {0}), list_inner_product(r2, {0})]"
_UNIT = "list_transform({0}, lambda x: x / sqrt(list_inner_product({0}, {0})))"


@query(f"""WITH RECURSIVE c AS (SELECT {_COV} FROM lineitem), e AS (SELECT 0 AS n, [0.0, 1.0, 0.0]::DOUBLE[] AS v, [1.0, 0.0, 0.0]::DOUBLE[] AS w UNION ALL
SELECT n + 1, v, {_UNIT.format("w")} FROM (SELECT n, v, list_transform(range(1, 4), lambda i: w[i] - list_inner_product(v, w) * v[i]) AS w FROM (SELECT n, {_UNIT.format("v")} AS v, w FROM (SELECT n, {_TIMES.format("v")} AS v, {_TIMES.format("w")} AS w FROM e, c WHERE n < 60))))
SELECT l_orderkey, l_linenumber, round(abs(list_inner_product(v, [l_quantity, l_extendedprice, l_discount])), 3) AS first, round(abs(list_inner_product(w, [l_quantity, l_extendedprice, l_discount])), 3) AS second FROM lineitem, e WHERE n = 60""")
def pca_project(spark, sf):
    """Both coordinates without their sign, which no eigenvector fixes."""
    df = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *ITEM)
    e = prep.PCAEncoder(encoded_size=2, cache=False).fit(df, ITEM).transform(df)
    return e.select("l_orderkey", "l_linenumber", *[r(F.abs(F.get("encoded", F.lit(k))), 3).alias(n) for k, n in enumerate(("first", "second"))])


# ---------------------------------------------------------------- counts, impurity, modes


@query("SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS count FROM lineitem GROUP BY ALL")
def class_counts(spark, sf):
    return measures.class_counts(t(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("""SELECT c AS o_orderstatus, coalesce(n, 0)::BIGINT AS count FROM (VALUES ('F'), ('X'), ('O')) v(c) LEFT JOIN (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) ON c = o_orderstatus""")
def class_counts_given(spark, sf):
    return measures.class_counts(t(spark, sf, "orders"), "o_orderstatus", ["F", "X", "O"])


_SHARES = "WITH c AS (SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL), p AS (SELECT l_returnflag, n / sum(n) OVER (PARTITION BY l_returnflag) AS p FROM c) "


@query(_SHARES + "SELECT l_returnflag, round(1 - sum(p * p), 8) AS gini FROM p GROUP BY 1")
def gini(spark, sf):
    return measures.gini(t(spark, sf, "lineitem"), "l_linenumber", ["l_returnflag"]).select("l_returnflag", r("gini", 8).alias("gini"))


@query(_SHARES + "SELECT l_returnflag, round(-sum(p * log2(p)), 8) AS entropy FROM p GROUP BY 1")
def entropy(spark, sf):
    return measures.entropy(t(spark, sf, "lineitem"), "l_linenumber", ["l_returnflag"]).select("l_returnflag", r("entropy", 8).alias("entropy"))


@query("SELECT l_returnflag, round(var_pop(l_extendedprice), 2) AS variance FROM lineitem GROUP BY 1")
def variance_by_group(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_returnflag").agg(r(measures.variance("l_extendedprice"), 2).alias("variance"))


@query("SELECT event_type AS mode FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1")
def mode_label(spark, sf):
    return pmf.mode_of_labels(t(spark, sf, "events"), "event_type")


_PMF = "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT user_id, event_type, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c) "


def _user_pmf(spark, sf):
    counts = t(spark, sf, "events").groupBy("user_id", "event_type").count()
    total = counts.groupBy("user_id").agg(F.sum("count").alias("n"))
    rows = counts.join(total, "user_id").select("user_id", "event_type", (F.col("count") / F.col("n")).alias("p"))
    return rows.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "p"))).alias("pmf"))


@query(_PMF + "SELECT event_type, round(sum(p) / (SELECT count(DISTINCT user_id) FROM events), 8) AS p FROM p GROUP BY 1")
def mean_pmf(spark, sf):
    return pmf.mean_of_maps(_user_pmf(spark, sf), "pmf").select(F.explode("pmf").alias("event_type", "p")).select("event_type", r("p", 8).alias("p"))


@query(_PMF + "SELECT user_id, arg_min(event_type, (-round(p, 12), event_type)) AS mode FROM p GROUP BY 1")
def mode_pmf(spark, sf):
    return _user_pmf(spark, sf).select("user_id", pmf.mode_of_map(F.transform_values("pmf", lambda k, v: F.round(v, 12))).alias("mode"))


@query("SELECT vec_id, list_position(embedding, list_max(embedding))::BIGINT AS place FROM embeddings")
def mode_position(spark, sf):
    return t(spark, sf, "embeddings").select("vec_id", pmf.mode_of_array("embedding").alias("place"))


# ---------------------------------------------------------------- distances and kernels

_D = "list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: {}))"
_A, _B = "a.embedding[i]::DOUBLE", "b.embedding[i]::DOUBLE"
_L1, _L2Q = _D.format(f"abs({_A} - {_B})"), _D.format(f"({_A} - {_B}) * ({_A} - {_B})")
_DOT, _NA, _NB = _D.format(f"{_A} * {_B}"), _D.format(f"{_A} * {_A}"), _D.format(f"{_B} * {_B}")
_NEXT = "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def _neighbours(spark, sf):
    e = t(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")


@query(f"SELECT a.vec_id, round({_L1}, 5) AS l1, round(sqrt({_L2Q}), 5) AS l2, round({_L2Q}, 5) AS l2sq, round(1 - {_DOT} / (sqrt({_NA}) * sqrt({_NB})), 5) AS cosine {_NEXT}")
def vector_distances(spark, sf):
    d = distances
    return _neighbours(spark, sf).select("vec_id", *[r(f("x", "y"), 5).alias(n) for n, f in (("l1", d.l1_distance), ("l2", d.l2_distance), ("l2sq", d.l2squared_distance), ("cosine", d.cosine_distance))])


@query(f"SELECT a.vec_id, round(exp(-0.5 * {_L2Q}), 8) AS rbf, round(power({_DOT} + 1, 2), 5) AS poly {_NEXT}")
def kernels(spark, sf):
    return _neighbours(spark, sf).select("vec_id", r(distances.radial_kernel("x", "y"), 8).alias("rbf"), r(distances.polynomial_kernel("x", "y", 1.0), 5).alias("poly"))


@query("""SELECT a.s_suppkey AS i, b.s_suppkey AS j, round(abs(a.s_acctbal - b.s_acctbal), 4) AS distance FROM supplier a, supplier b""")
def pairwise(spark, sf):
    rows = prep.as_features(t(spark, sf, "supplier"), ["s_acctbal"])
    return measures.pairwise(rows, "s_suppkey", "features").select("i", "j", r("distance", 4).alias("distance"))


_SIL = """WITH d AS (SELECT a.s_suppkey AS i, a.s_nationkey AS own, b.s_nationkey AS other, abs(a.s_acctbal - b.s_acctbal) AS d FROM supplier a, supplier b),
g AS (SELECT i, own, other, sum(d) AS s, count(*) AS n FROM d GROUP BY ALL),
v AS (SELECT i, max(CASE WHEN own = other AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM g GROUP BY i)
SELECT i, round(CASE WHEN a IS NULL OR b IS NULL OR a = b THEN 0 WHEN a < b THEN 1 - a / b ELSE b / a - 1 END, 6) AS silhouette FROM v"""


@query(_SIL)
def silhouette(spark, sf):
    return cluster.silhouette_of(t(spark, sf, "supplier"), ["s_acctbal"], "s_nationkey", "s_suppkey").select("i", r("silhouette").alias("silhouette"))


# ---------------------------------------------------------------- clustering steps

POINTS = [[10.0, 20000.0], [25.0, 40000.0], [40.0, 60000.0]]
_KD = [f"sqrt(power(l_quantity - {a}, 2) + power(l_extendedprice - {b}, 2))" for a, b in POINTS]
_KC = f"CASE WHEN {_KD[0]} <= {_KD[1]} AND {_KD[0]} <= {_KD[2]} THEN 1 WHEN {_KD[1]} <= {_KD[2]} THEN 2 ELSE 3 END::INT"


def _items(spark, sf):
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query(f"SELECT l_orderkey, l_linenumber, {_KC} AS cluster FROM lineitem")
def kmeans_assign(spark, sf):
    return cluster.assign(_items(spark, sf), arrays.vector(["l_quantity", "l_extendedprice"]), POINTS).select("l_orderkey", "l_linenumber", "cluster")


@query(f"SELECT {_KC} AS cluster, count(*)::BIGINT AS n, round(avg(l_quantity), 5) AS l_quantity, round(avg(l_extendedprice), 3) AS l_extendedprice FROM lineitem GROUP BY 1")
def kmeans_update(spark, sf):
    rows = cluster.assign(_items(spark, sf), arrays.vector(["l_quantity", "l_extendedprice"]), POINTS)
    return cluster.kmeans_update(rows, ["l_quantity", "l_extendedprice"]).select("cluster", "n", r("l_quantity", 5).alias("l_quantity"), r("l_extendedprice", 3).alias("l_extendedprice"))


def _lloyd(n: int) -> str:
    out = ["WITH b AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer), z0 AS (SELECT k, lo + (hi - lo) / 6 + (k - 1) * (hi - lo) / 3 AS z FROM b, range(1, 4) t(k))"]
    for i in range(1, n + 1):
        out.append(f"a{i} AS (SELECT c_acctbal, arg_min(k, (abs(c_acctbal - z), k)) AS k FROM customer, z{i - 1} GROUP BY c_custkey, c_acctbal), z{i} AS (SELECT k, avg(c_acctbal) AS z FROM a{i} GROUP BY k)")
    return ", ".join(out) + f" SELECT k::INT AS cluster, round(z, 4) AS centre FROM z{n}"


def _lloyd_classes(n: int, k: int) -> str:
    """The classes after n updates from a grid of k points."""
    out = [f"WITH b AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer), z0 AS (SELECT k, lo + (hi - lo) / {2 * k} + (k - 1) * (hi - lo) / {k} AS z FROM b, range(1, {k + 1}) t(k))"]
    near = "SELECT c_custkey, c_acctbal, arg_min(k, (abs(c_acctbal - z), k)) AS k FROM customer, z{} GROUP BY c_custkey, c_acctbal"
    out += [f"a{i} AS MATERIALIZED ({near.format(i - 1)}), z{i} AS MATERIALIZED (SELECT k, avg(c_acctbal) AS z FROM a{i} GROUP BY k)" for i in range(1, n + 1)]
    return ", ".join(out) + f" SELECT c_custkey, k::INT AS prediction FROM ({near.format(n)})"


@query(_lloyd(3))
def kmeans_3iter(spark, sf):
    df = t(spark, sf, "customer").select(F.col("c_custkey").alias("_id"), "c_acctbal")
    m = cluster.KMeansClusterer(n_classes=3, max_iter=3, cache=False).fit(df, ["c_acctbal"])
    return spark.createDataFrame([(k, round(p[0], 4)) for k, p in enumerate(m.par["representatives"], 1)], "cluster int, centre double")


@query(_lloyd_classes(30, 4))
def kmeans_fit(spark, sf):
    df = t(spark, sf, "customer").withColumn("_id", F.col("c_custkey"))
    return cluster.KMeansClusterer(n_classes=4, max_iter=30).fit(df, ["c_acctbal"]).predict().select("c_custkey", "prediction")


@query("""WITH c AS (SELECT a.s_nationkey, a.s_suppkey, a.s_acctbal, sum(abs(a.s_acctbal - b.s_acctbal)) AS cost FROM supplier a JOIN supplier b USING (s_nationkey) GROUP BY ALL)
SELECT s_nationkey, arg_min(s_suppkey, (round(cost, 6), s_suppkey)) AS s_suppkey, round(min(cost), 4) AS cost FROM c GROUP BY 1""")
def kmedoids_update(spark, sf):
    rows = prep.as_features(t(spark, sf, "supplier"), ["s_acctbal"])
    return cluster.kmedoids_update(rows, "s_suppkey", "features", "s_nationkey", distances.l1_distance).select("s_nationkey", "s_suppkey", r("cost", 4).alias("cost"))


def _medoid_classes(n: int, k: int) -> str:
    out = [f"WITH b AS (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier), z0 AS (SELECT k, lo + (hi - lo) / {2 * k} + (k - 1) * (hi - lo) / {k} AS z FROM b, range(1, {k + 1}) t(k))"]
    near = "SELECT s_suppkey, s_acctbal, arg_min(k, (abs(s_acctbal - z), k)) AS k FROM supplier, z{} GROUP BY s_suppkey, s_acctbal"
    for i in range(1, n + 1):
        out.append(f"a{i} AS MATERIALIZED ({near.format(i - 1)}), c{i} AS (SELECT p.k, p.s_suppkey, p.s_acctbal, round(sum(abs(p.s_acctbal - q.s_acctbal)), 9) AS cost FROM a{i} p JOIN a{i} q USING (k) GROUP BY ALL)")
        out.append(f"z{i} AS MATERIALIZED (SELECT k, arg_min(s_acctbal, (cost, s_suppkey)) AS z FROM c{i} GROUP BY k)")
    return ", ".join(out) + f" SELECT s_suppkey, k::INT AS prediction FROM ({near.format(n)})"


@query(_medoid_classes(20, 3))
def kmedoids_fit(spark, sf):
    df = t(spark, sf, "supplier").withColumn("_id", F.col("s_suppkey"))
    return cluster.KMedoidsClusterer(n_classes=3, initialisation_strategy="grid", max_iter=20).fit(df, ["s_acctbal"]).predict().select("s_suppkey", "prediction")


def _number_splits(levels: int, source: str, columns: tuple[str, ...]) -> str:
    """Tables n0, n1, ... of the rows of ``source`` (id, the columns, y) and their nodes, level by level of a regression tree; rows without y only follow."""
    out = [f"n0 AS (SELECT *, 1 AS node FROM ({source}))"]
    value = "CASE q.f " + " ".join(f"WHEN {k} THEN n.{c}" for k, c in enumerate(columns, 1)) + " END"
    for i in range(levels):
        each = " UNION ALL ".join(f"SELECT node, {k} AS f, {c} AS x, count(*) AS n, sum(y - m) AS s FROM n{i} JOIN w{i} USING (node) WHERE y IS NOT NULL GROUP BY ALL" for k, c in enumerate(columns, 1))
        out.append(f"""w{i} AS (SELECT node, count(y)::DOUBLE AS an, avg(y) AS m FROM n{i} GROUP BY 1),
v{i} AS ({each}),
c{i} AS (SELECT node, f, x, sum(n) OVER r AS n, sum(s) OVER r AS s FROM v{i} WINDOW r AS (PARTITION BY node, f ORDER BY x DESC ROWS UNBOUNDED PRECEDING)),
g{i} AS (SELECT node, f, x, round(s * s / n / an + s * s / (an - n) / an, 9) AS gain FROM c{i} JOIN w{i} USING (node) WHERE n < an),
b{i} AS MATERIALIZED (SELECT node, arg_max(f, (gain, f, x)) AS f, arg_max(x, (gain, f, x)) AS x FROM g{i} GROUP BY node),
n{i + 1} AS MATERIALIZED (SELECT n.* EXCLUDE (node), CASE WHEN q.f IS NULL THEN n.node WHEN {value} >= q.x THEN 2 * n.node ELSE 2 * n.node + 1 END AS node FROM n{i} n LEFT JOIN b{i} q USING (node))""")
    return "WITH " + ",\n".join(out) + "\n"


# ---------------------------------------------------------------- mixtures

_MIX = [(0.5, 2000.0, 4.0e6), (0.5, 7000.0, 9.0e6)]
_LP = [f"(ln({p} + 1e-16) - 0.5 * ln(2 * pi() * {v}) - power(c_acctbal - {m}, 2) / (2 * {v}))" for p, m, v in _MIX]
_LSE = f"(greatest({_LP[0]}, {_LP[1]}) + ln(exp({_LP[0]} - greatest({_LP[0]}, {_LP[1]})) + exp({_LP[1]} - greatest({_LP[0]}, {_LP[1]}))))"


def _mixtures():
    return [gmm.DiagonalGaussian([m], [v]) for _, m, v in _MIX]


@query(f"SELECT c_custkey, round(exp({_LP[0]} - {_LSE}), 7) AS p1, round(exp({_LP[1]} - {_LSE}), 7) AS p2 FROM customer")
def gmm_estep(spark, sf):
    fit = gmm.Fit([p for p, _, _ in _MIX], _mixtures(), 0.0, 0.0, 0.0, 0)
    rows = gmm.membership(t(spark, sf, "customer"), ["c_acctbal"], fit)
    return rows.select("c_custkey", r(F.get("prediction", F.lit(0)), 7).alias("p1"), r(F.get("prediction", F.lit(1)), 7).alias("p2"))


_MSTEP = f"""WITH e AS (SELECT c_acctbal AS x, exp({_LP[0]} - {_LSE}) AS p1, exp({_LP[1]} - {_LSE}) AS p2, {_LSE} AS l FROM customer),
m AS (SELECT sum(p1) AS w1, sum(p2) AS w2, sum(p1 * x) / sum(p1) AS m1, sum(p2 * x) / sum(p2) AS m2, sum(l) AS ll, count(*) AS n FROM e)
"""


@query(_MSTEP + """SELECT 1::INT AS k, round(any_value(w1) / (any_value(w1) + any_value(w2)), 6) AS prior, round(any_value(m1), 3) AS mean, round(sum(p1 * power(x - m1, 2)) / sum(p1), 0) AS variance FROM e, m
UNION ALL SELECT 2::INT, round(any_value(w2) / (any_value(w1) + any_value(w2)), 6), round(any_value(m2), 3), round(sum(p2 * power(x - m2, 2)) / sum(p2), 0) FROM e, m""")
def gmm_mstep(spark, sf):
    fit = gmm.em(t(spark, sf, "customer"), ["c_acctbal"], _mixtures(), [p for p, _, _ in _MIX], strategy="given", max_iter=1)
    return spark.createDataFrame([(k, round(float(p), 6), round(float(m.mean[0]), 3), float(round(float(m.var[0])))) for k, (p, m) in enumerate(zip(fit.priors, fit.mixtures, strict=True), 1)], "k int, prior double, mean double, variance double")


@query(_MSTEP + "SELECT round(ll, 3) AS log_likelihood, round(5 * ln(n) - 2 * ll, 3) AS bic, round(2 * 5 - 2 * ll, 3) AS aic FROM m")
def gmm_bic(spark, sf):
    fit = gmm.em(t(spark, sf, "customer"), ["c_acctbal"], _mixtures(), [p for p, _, _ in _MIX], strategy="given", max_iter=1)
    return spark.createDataFrame([(round(fit.log_likelihood, 3), round(fit.bic, 3), round(fit.aic, 3))], "log_likelihood double, bic double, aic double")


def _em(steps: int) -> str:
    """Responsibilities of the fitted rows after so many steps of two normal densities of one variance (the second's), or when the likelihood stands."""
    score = lambda k: f"(ln(p{k} + 1e-16) - 0.5 * ln(2 * pi() * v) - power(x - m{k}, 2) / (2 * v))"
    a, b = score(1), score(2)
    near = f"SELECT id, x, z.*, 1 / (1 + exp({b} - {a})) AS r, greatest({a}, {b}) + ln(1 + exp(-abs({a} - {b}))) AS l FROM d, z{{}} z"
    out = ["""WITH d AS (SELECT c_custkey AS id, c_acctbal / 1000 AS x FROM customer),
z0 AS (SELECT 0.5::DOUBLE AS p1, 0.5::DOUBLE AS p2, min(x) + (max(x) - min(x)) / 4 AS m1, min(x) + (max(x) - min(x)) * 3 / 4 AS m2, greatest(0.05, var_samp(x)) AS v, '-infinity'::DOUBLE AS ll, false AS done FROM d)"""]
    for i in range(1, steps):
        out.append(f"""e{i} AS MATERIALIZED ({near.format(i - 1)}),
s{i} AS (SELECT sum(l) AS l, sum(r) AS w1, sum(1 - r) AS w2, sum(r * x) / sum(r) AS a1, sum((1 - r) * x) / sum(1 - r) AS a2 FROM e{i}),
q{i} AS (SELECT greatest(0.05, sum((1 - r) * power(x - a2, 2)) / any_value(w2)) AS v FROM e{i}, s{i}),
y{i} AS (SELECT z.*, z.done OR l - z.ll <= 1e-6 * abs(l) AS over, l, w1, w2, a1, a2, q.v AS u FROM z{i - 1} z, s{i}, q{i} q),
z{i} AS MATERIALIZED (SELECT CASE WHEN over THEN p1 ELSE w1 / (w1 + w2) END AS p1, CASE WHEN over THEN p2 ELSE w2 / (w1 + w2) END AS p2, CASE WHEN over THEN m1 ELSE a1 END AS m1, CASE WHEN over THEN m2 ELSE a2 END AS m2, CASE WHEN over THEN v ELSE u END AS v, l AS ll, over AS done FROM y{i})""")
    return ",\n".join(out) + f"\nSELECT id AS c_custkey, round(r, 6) AS p1, round(1 - r, 6) AS p2 FROM ({near.format(steps - 1)})"


@query(_em(8))
def gmm_fit(spark, sf):
    df = t(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("x"))
    m = gmm.GaussianMixtureClusterer(n_classes=2, initialisation_strategy="grid", maximum_iterations=8).fit(df, ["x"])
    return m.predict().select("c_custkey", r(F.get("prediction", F.lit(0))).alias("p1"), r(F.get("prediction", F.lit(1))).alias("p2"))


@query()
def gmm_regressors(spark, sf):
    df = t(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 100).alias("y"))
    kw = {"n_classes": 2, "initialisation_strategy": "grid", "maximum_iterations": 5}
    a = gmm.GaussianMixtureRegressor(**kw).fit(df, ["x"], ["y"]).predict().withColumnRenamed("prediction", "joint")
    b = gmm.GaussianMixtureRegressor2(**kw).fit(df, ["x"], ["y"])
    return b.transform(a).select("p_partkey", "joint", "prediction")


# ---------------------------------------------------------------- imputers


def _holes(spark, sf):
    return t(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), F.col("user_id").cast("double").alias("user"))


_HOLES = "(SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value, user_id::DOUBLE AS user_ FROM events)"


@query(f"SELECT event_id, round(coalesce(value, avg(value) OVER ()), 6) AS value FROM {_HOLES}")
def impute_mean(spark, sf):
    df = _holes(spark, sf)
    return impute.SimpleImputer(cache=False).fit(df, ["value"]).transform(df).select("event_id", r("value").alias("value"))


@query(f"""WITH n AS (SELECT *, (abs(coalesce(value, 0)) + abs(user_)) / ((value IS NOT NULL)::INT + 1) AS a FROM {_HOLES})
SELECT event_id, round(coalesce(value, avg(value) OVER () * a / sum(a) OVER ()), 9) AS value FROM n""")
def impute_mean_norm(spark, sf):
    df = _holes(spark, sf)
    return impute.SimpleImputer(norm=1, cache=False).fit(df, ["value", "user"]).transform(df).select("event_id", r("value", 9).alias("value"))


@query(f"SELECT unnest(CASE WHEN bool_or(value IS NULL) THEN ['value'] ELSE [] END || CASE WHEN bool_or(user_ IS NULL) THEN ['user'] ELSE [] END) AS column_name FROM {_HOLES}")
def cols_with_missing(spark, sf):
    return spark.createDataFrame([(c,) for c in prep.columns_with_missing(_holes(spark, sf), ["value", "user"])], "column_name string")


def _parts(spark, sf):
    p = t(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("_id"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_retailprice")).alias("price"), F.col("p_size").cast("double").alias("size"), F.col("p_brand").alias("brand"))


@query()
def gmm_imputer(spark, sf):
    df = _parts(spark, sf)
    return impute.GaussianMixtureImputer(n_classes=2, initialisation_strategy="grid", maximum_iterations=5).fit(df, ["price", "size"]).predict().select("_id", "price", "size")


@query()
def rf_imputer(spark, sf):
    df = _parts(spark, sf)
    return impute.RandomForestImputer(n_trees=5, max_depth=6).fit(df, ["price", "size", "brand"]).predict().select("_id", "price", "size", "brand")


@query(_number_splits(4, "SELECT p_partkey AS id, p_size::DOUBLE AS a, CASE WHEN p_partkey % 5 != 0 THEN p_retailprice END AS y FROM part", ("a",)) + "SELECT id AS _id, round(coalesce(y, avg(y) OVER (PARTITION BY node)), 6) AS price, a AS size FROM n4")
def general_imputer(spark, sf):
    df = _parts(spark, sf)
    got = impute.GeneralImputer(estimator=trees.DecisionTreeEstimator(max_depth=5)).fit(df, ["price", "size"]).predict()
    return got.select("_id", r("price").alias("price"), "size")


# ---------------------------------------------------------------- measures

_RULE = "FROM (SELECT l_extendedprice AS y, l_quantity * 1500.0 AS h FROM lineitem)"


def _rule(spark, sf):
    return t(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("h"))


@query(f"SELECT round(avg(power(y - h, 2)), 2) AS mse {_RULE}")
def mse(spark, sf):
    return measures.mse(_rule(spark, sf), "y", "h").select(r("mse", 2).alias("mse"))


@query(f"SELECT round(sum(power(y - h, 2)) / 2 / 1e6, 2) AS squared_cost {_RULE}")
def squared_cost(spark, sf):
    return measures.squared_cost(_rule(spark, sf), "y", "h").select(r(F.col("squared_cost") / 1e6, 2).alias("squared_cost"))


@query(f"""SELECT round(sum(abs(y - h)) / sum(abs(y)), 8) AS rme, round(sqrt(sum(power(y - h, 2)) / sum(power(y, 2))), 8) AS rme2, round(avg(abs(y - h) / abs(y)), 8) AS by_record {_RULE}""")
def rme(spark, sf):
    d = _rule(spark, sf)
    f = measures.relative_mean_error
    return spark.createDataFrame([tuple(round(x, 8) for x in (f(d, ["y"], ["h"]), f(d, ["y"], ["h"], p=2), f(d, ["y"], ["h"], normrec=True)))], "rme double, rme2 double, by_record double")


@query("SELECT round(avg((quality = (doc_id % 2))::INT), 8) AS accuracy, round(greatest(avg((quality = (doc_id % 2))::INT), 1 - avg((quality = (doc_id % 2))::INT)), 8) AS ignoring FROM labels")
def accuracy(spark, sf):
    d = t(spark, sf, "labels").select(F.col("quality").cast("long").alias("y"), (F.col("doc_id") % 2).alias("h"))
    return spark.createDataFrame([(round(measures.accuracy(d, "y", "h"), 8), round(measures.accuracy(d, "y", "h", ignore_labels=True), 8))], "accuracy double, ignoring double")


_BIN = "SELECT l_discount * 10 AS a, l_tax * 12 AS b FROM lineitem"


@query(f"SELECT round(sum(-(a * ln(b + 1e-15) + (1 - a) * ln(1 - b + 1e-15))), 2) AS crossentropy, round(sum(a * log2((a + 1e-15) / (b + 1e-15)) + (1 - a) * log2((1 - a + 1e-15) / (1 - b + 1e-15))), 2) AS kl FROM ({_BIN})")
def crossentropy_kl(spark, sf):
    d = t(spark, sf, "lineitem").select((F.col("l_discount") * 10).alias("a"), (F.col("l_tax") * 12).alias("b"))
    p, q = F.array("a", 1 - F.col("a")), F.array("b", 1 - F.col("b"))
    return d.agg(r(F.sum(distances.crossentropy(p, q)), 2).alias("crossentropy"), r(F.sum(distances.kl_divergence(p, q)), 2).alias("kl"))


@query(f"SELECT round(sum(power(y - h, 2)) / (var_pop(y) * count(*)), 8) AS sobol {_RULE}")
def sobol(spark, sf):
    return spark.createDataFrame([(round(measures.sobol_index(_rule(spark, sf), "y", "h"), 8),)], "sobol double")


@query("""WITH e AS (SELECT event_type, ts, event_id, value AS y, value * 0.9 AS h, avg(value) OVER (PARTITION BY event_type) AS m FROM events)
SELECT event_type, round(avg(abs(y - h)) / avg(abs(y - m)), 8) AS mase FROM e GROUP BY 1""")
def mase(spark, sf):
    d = t(spark, sf, "events").select("event_type", F.col("value").alias("y"), (F.col("value") * 0.9).alias("h"))
    return measures.mase(d, "y", "h", by=["event_type"]).select("event_type", r("mase", 8).alias("mase"))


@query("""WITH e AS (SELECT event_type, value AS y, value * 0.9 AS h, lag(value) OVER (PARTITION BY event_type ORDER BY event_id) AS b FROM events)
SELECT event_type, round(avg(abs(y - h)) / avg(abs(y - b)), 8) AS mase FROM e GROUP BY 1""")
def mase_seq(spark, sf):
    d = t(spark, sf, "events").select("event_type", "event_id", F.col("value").alias("y"), (F.col("value") * 0.9).alias("h"))
    return measures.mase(d, "y", "h", order="event_id", by=["event_type"]).select("event_type", r("mase", 8).alias("mase"))


@query("SELECT quality::INT AS y, (doc_id % 2)::INT AS y_hat, count(*)::BIGINT AS count FROM labels GROUP BY ALL")
def confusion_counts(spark, sf):
    d = t(spark, sf, "labels").select(F.col("quality").cast("int").alias("y"), (F.col("doc_id") % 2).cast("int").alias("y_hat"))
    return measures.confusion_counts(d, "y", "y_hat")


@query("""WITH d AS (SELECT quality AS y, doc_id % 2 AS h FROM labels), k AS (SELECT * FROM (VALUES (0), (1)) v(label))
SELECT label::INT AS label, round(count(*) FILTER (y = label AND h = label) / count(*) FILTER (h = label), 8) AS precision_, round(count(*) FILTER (y = label AND h = label) / count(*) FILTER (y = label), 8) AS recall,
round(count(*) FILTER (y <> label AND h <> label) / count(*) FILTER (y <> label), 8) AS specificity, round(2 * count(*) FILTER (y = label AND h = label) / (count(*) FILTER (h = label) + count(*) FILTER (y = label)), 8) AS f1 FROM d, k GROUP BY label""")
def confusion_report(spark, sf):
    d = t(spark, sf, "labels").select(F.col("quality").cast("int").alias("y"), (F.col("doc_id") % 2).cast("int").alias("y_hat"))
    m = measures.ConfusionMatrix(cache=False, verbosity=Verbosity.NONE).fit(d)
    i = m.info()
    rows = [(k, *[round(i[x][n], 8) for x in ("precision", "recall", "specificity", "f1score")]) for n, k in enumerate(m.par["labels"])]
    return spark.createDataFrame(rows, "label int, precision_ double, recall double, specificity double, f1 double")


# ---------------------------------------------------------------- functions


@query("""SELECT event_id, round(greatest(0, x), 6) + 0.0 AS relu, round(CASE WHEN x > 0 THEN x ELSE exp(x) - 1 END, 6) + 0.0 AS elu, round(greatest(0, x) + least(0, 0.5 * (exp(x / 0.5) - 1)), 6) + 0.0 AS celu, round(greatest(0.1 * (x + 1) - 1, least(0.1 * (x - 1) + 1, x)), 6) + 0.0 AS plu,
round(1 / (1 + exp(-x)), 6) + 0.0 AS sigmoid, round(ln(1 + exp(x)), 6) + 0.0 AS softplus, round(x * tanh(ln(1 + exp(x))), 6) + 0.0 AS mish, round(tanh(x), 6) + 0.0 AS tanh FROM (SELECT event_id, sin(event_id) * 4 AS x FROM events)""")
def activations(spark, sf):
    d = t(spark, sf, "events").select("event_id", (F.sin("event_id") * 4).alias("x"))
    return d.select("event_id", *[r(f).alias(n) for n, f in (("relu", act.relu("x")), ("elu", act.elu("x")), ("celu", act.celu("x", 0.5)), ("plu", act.plu("x")), ("sigmoid", act.sigmoid("x")), ("softplus", act.softplus("x")), ("mish", act.mish("x")), ("tanh", act.tanh("x")))])


@query("""SELECT event_id, CASE WHEN x <= 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS drelu, round(CASE WHEN x > 0 THEN 1 ELSE exp(x) END, 6) + 0.0 AS delu, round(CASE WHEN x >= 0 THEN 1 ELSE exp(x / 0.5) END, 6) + 0.0 AS dcelu, round(1 / power(cosh(x), 2), 6) + 0.0 AS dtanh,
round(exp(-x) / power(1 + exp(-x), 2), 6) + 0.0 AS dsigmoid, round(1 / (1 + exp(-x)), 6) + 0.0 AS dsoftplus, round(exp(x) * (exp(3 * x) + 4 * exp(2 * x) + (6 + 4 * x) * exp(x) + 4 * (1 + x)) / power(1 + power(exp(x) + 1, 2), 2), 6) + 0.0 AS dmish FROM (SELECT event_id, sin(event_id) * 4 AS x FROM events)""")
def derivatives(spark, sf):
    d = t(spark, sf, "events").select("event_id", (F.sin("event_id") * 4).alias("x"))
    return d.select("event_id", act.drelu("x").alias("drelu"), *[r(f).alias(n) for n, f in (("delu", act.delu("x")), ("dcelu", act.dcelu("x", 0.5)), ("dtanh", act.dtanh("x")), ("dsigmoid", act.dsigmoid("x")), ("dsoftplus", act.dsoftplus("x")), ("dmish", act.dmish("x")))])


@query("""SELECT vec_id, round(list_sum(list_transform(range(1, len(p) + 1), lambda i: i * p[i])), 5) AS centre, round(mx + ln(s), 5) AS lse FROM (SELECT vec_id, mx, s, list_transform(e, lambda x: x / s) AS p FROM (SELECT *, list_sum(e) AS s FROM (SELECT vec_id, mx, list_transform(z, lambda x: exp(x - mx)) AS e FROM
(SELECT vec_id, embedding::DOUBLE[] AS z, list_max(embedding)::DOUBLE AS mx FROM embeddings))))""")
def softmax_lse(spark, sf):
    e = t(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("z"))
    weighted = F.aggregate(F.transform(act.softmax("z"), lambda p, i: (i + 1) * p), F.lit(0.0), lambda a, b: a + b)
    return e.select("vec_id", r(weighted, 5).alias("centre"), r(arrays.lse("z"), 5).alias("lse"))


@query("""SELECT vec_id, round(list_sum(list_transform(range(1, len(z) - 1), lambda i: i * (z[i] + z[i + 1] + z[i + 2]) / 3)), 4) AS means, round(list_sum(list_transform(range(1, len(z) - 1), lambda i: i * greatest(z[i], z[i + 1], z[i + 2]))), 4) AS maxima FROM (SELECT vec_id, embedding::DOUBLE[] AS z FROM embeddings)""")
def pool1d(spark, sf):
    e = t(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("z"))
    weigh = lambda x: F.aggregate(F.transform(x, lambda p, i: (i + 1) * p), F.lit(0.0), lambda a, b: a + b)
    return e.select("vec_id", r(weigh(act.pool1d("z", 3)), 4).alias("means"), r(weigh(act.pool1d("z", 3, F.array_max)), 4).alias("maxima"))


# ---------------------------------------------------------------- dividing rows


def _orders(spark, sf):
    return t(spark, sf, "orders").select(F.col("o_orderkey").alias("_id"))


_N = "(SELECT o_orderkey AS _id, row_number() OVER (ORDER BY o_orderkey) - 1 AS n, count(*) OVER () AS c FROM orders)"


@query(f"SELECT _id, CASE WHEN n < round_even(0.7 * c, 0) THEN 0 WHEN n < round_even(0.9 * c, 0) THEN 1 ELSE 2 END::INT AS part FROM {_N}")
def partition_sequential(spark, sf):
    a, b, c = prep.partition(_orders(spark, sf), [0.7, 0.2, 0.1], shuffle=False)
    return a.withColumn("part", F.lit(0)).unionByName(b.withColumn("part", F.lit(1))).unionByName(c.withColumn("part", F.lit(2)))


@query(f"SELECT _id, ((n >= round_even(c / 3.0, 0))::INT + (n >= round_even(2 * c / 3.0, 0))::INT)::INT AS fold FROM {_N}")
def kfold_sequential(spark, sf):
    return prep.KFold(3, shuffle=False).folds(_orders(spark, sf))


@query(f"SELECT _id, (n // 64)::BIGINT AS batch FROM {_N} WHERE n // 64 < c // 64")
def batch_sequential(spark, sf):
    return prep.batches(_orders(spark, sf), 64, sequential=True)


# ---------------------------------------------------------------- trees


@query("""WITH v AS (SELECT l_quantity AS v, count(*) AS n, sum(l_extendedprice / 1000) AS s, sum(power(l_extendedprice / 1000, 2)) AS q FROM lineitem GROUP BY 1),
c AS (SELECT v, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(q) OVER w AS q, sum(n) OVER () AS an, sum(s) OVER () AS s_, sum(q) OVER () AS q_ FROM v WINDOW w AS (ORDER BY v DESC ROWS UNBOUNDED PRECEDING)),
g AS (SELECT v, (q_ / an - power(s_ / an, 2)) - n / an * (q / n - power(s / n, 2)) - (1 - n / an) * ((q_ - q) / (an - n) - power((s_ - s) / (an - n), 2)) AS gain FROM c WHERE n < an)
SELECT v AS value, round(gain, 4) AS gain FROM g ORDER BY gain DESC LIMIT 1""")
def best_split_variance(spark, sf):
    d = t(spark, sf, "lineitem").select(F.monotonically_increasing_id().alias("_id"), "l_quantity", (F.col("l_extendedprice") / 1000).alias("y"))
    return trees.best_splits(d, [], ["l_quantity"], [True], "y", "variance", None).select(F.col("v").alias("value"), r("gain", 4).alias("gain"))


@query("""WITH v AS (SELECT l_linestatus AS k, l_shipdate::DATE - DATE '1990-01-01' AS v, l_returnflag AS f FROM lineitem), c AS (SELECT k, v, f, count(*) AS n FROM v GROUP BY ALL),
d AS (SELECT DISTINCT k, v FROM c), t AS (SELECT d.k, d.v, c.f, sum(c.n) AS n FROM d JOIN c ON c.k = d.k AND c.v >= d.v GROUP BY ALL), a AS (SELECT k, f, sum(n) AS n FROM c GROUP BY ALL),
s AS (SELECT d.k, d.v, a.f, coalesce(t.n, 0) AS n, a.n - coalesce(t.n, 0) AS m, a.n AS w FROM d JOIN a USING (k) LEFT JOIN t ON t.k = d.k AND t.v = d.v AND t.f = a.f),
z AS (SELECT k, v, sum(n) AS n, sum(m) AS m, sum(w) AS w, sum(n * n) AS nn, sum(m * m) AS mm, sum(w * w) AS ww FROM s GROUP BY k, v)
SELECT k AS node, round(max(round((1 - ww / (w * w)) - n / w * (1 - nn / (n * n)) - m / w * (1 - mm / (m * m)), 12)), 8) AS gain FROM z WHERE n > 0 AND m > 0 GROUP BY k""")
def best_split_gini(spark, sf):
    d = t(spark, sf, "lineitem").select(F.monotonically_increasing_id().alias("_id"), F.col("l_linestatus").alias("node"), F.datediff("l_shipdate", F.lit("1990-01-01")).cast("double").alias("day"), "l_returnflag")
    classes = sorted(x[0] for x in d.select("l_returnflag").distinct().collect())
    coded = d.withColumn("y", F.array_position(F.array(*map(F.lit, classes)), F.col("l_returnflag")) - 1)
    return trees.best_splits(coded, ["node"], ["day"], [True], "y", "gini", classes).select("node", r("gain", 8).alias("gain"))


def _literal_tree() -> trees.Node:
    n = trees.Node
    leaf = lambda v: n(3, 1, prediction=v)
    low = n(2, 2, trees.Question(1, 30000.0, True), 0.5, leaf(2.0), leaf(1.0))
    high = n(2, 2, trees.Question(1, 60000.0, True), 0.5, leaf(4.0), leaf(3.0))
    return n(1, 4, trees.Question(0, 25.0, True), 0.5, high, low)


_TREE = "CASE WHEN l_quantity >= 25 THEN CASE WHEN l_extendedprice >= 60000 THEN 4.0 ELSE 3.0 END ELSE CASE WHEN l_extendedprice >= 30000 THEN 2.0 ELSE 1.0 END END"


@query(f"SELECT l_orderkey, l_linenumber, ({_TREE})::DOUBLE AS prediction FROM lineitem")
def tree_predict(spark, sf):
    c = trees.as_column(_literal_tree(), ["l_quantity", "l_extendedprice"], "double")
    return _items(spark, sf).select("l_orderkey", "l_linenumber", c.alias("prediction"))


@query(f"SELECT l_orderkey, l_linenumber, round((({_TREE}) + 3 * CASE WHEN l_quantity >= 10 THEN 2.0 ELSE 0.5 END) / 4, 6)::DOUBLE AS prediction FROM lineitem")
def forest_predict_literal(spark, sf):
    stump = trees.Node(1, 2, trees.Question(0, 10.0, True), 0.5, trees.Node(2, 1, prediction=2.0), trees.Node(2, 1, prediction=0.5))
    parts = [trees.as_column(x, ["l_quantity", "l_extendedprice"], "double") for x in (_literal_tree(), stump)]
    return _items(spark, sf).select("l_orderkey", "l_linenumber", r((parts[0] + 3 * parts[1]) / 4).alias("prediction"))


def _customers(spark, sf):
    return t(spark, sf, "customer").select(F.col("c_custkey").alias("_id"), (F.col("c_acctbal") / 1000).alias("a"), F.col("c_nationkey").cast("double").alias("b"), F.col("c_mktsegment").alias("seg"), F.when(F.col("c_acctbal") > 5000, "rich").otherwise("poor").alias("y"))


def _class_splits(levels: int, columns: tuple[str, ...] = ("a", "b", "seg")) -> str:
    """Shares of two classes in the leaves of a tree of so many levels of splits; seg splits by equality."""
    out = ["WITH n0 AS (SELECT c_custkey AS id, c_acctbal / 1000 AS a, c_nationkey AS b, c_mktsegment AS seg, (c_acctbal > 5000)::INT AS y, 1 AS node FROM customer)"]
    each = "SELECT node, {} AS f, {}::DOUBLE AS x, {}::VARCHAR AS c, count(*) AS n, sum(y) AS s, min(id) AS o FROM n{{}} GROUP BY ALL"
    values = {"a": each.format(1, "a", "NULL"), "b": each.format(2, "b", "NULL"), "seg": each.format(3, "NULL", "seg")}
    gini = "(1 - power({1} / {0}, 2) - power(1 - {1} / {0}, 2))"
    for i in range(levels):
        out.append(f"""w{i} AS (SELECT node, count(*)::DOUBLE AS an, sum(y)::DOUBLE AS ay FROM n{i} GROUP BY 1),
v{i} AS ({" UNION ALL ".join(values[c].format(i) for c in columns)}),
c{i} AS (SELECT node, f, x, c, o, CASE WHEN f < 3 THEN sum(n) OVER r ELSE n END AS n, CASE WHEN f < 3 THEN sum(s) OVER r ELSE s END AS s FROM v{i} WINDOW r AS (PARTITION BY node, f ORDER BY x DESC ROWS UNBOUNDED PRECEDING)),
g{i} AS (SELECT c.*, round({gini.format("an", "ay")} - n / an * {gini.format("n", "s")} - (1 - n / an) * {gini.format("(an - n)", "(ay - s)")}, 12) AS gain FROM c{i} c JOIN w{i} USING (node) WHERE n < an),
b{i} AS MATERIALIZED (SELECT node, arg_max(f, (gain, f, o)) AS f, arg_max(coalesce(x, 0), (gain, f, o)) AS x, arg_max(coalesce(c, ''), (gain, f, o)) AS c FROM g{i} GROUP BY node HAVING max(gain) > 0),
n{i + 1} AS MATERIALIZED (SELECT id, a, b, seg, y, CASE WHEN q.f IS NULL THEN n.node WHEN CASE q.f WHEN 1 THEN n.a >= q.x WHEN 2 THEN n.b >= q.x ELSE n.seg = q.c END THEN 2 * n.node ELSE 2 * n.node + 1 END AS node FROM n{i} n LEFT JOIN b{i} q USING (node))""")
    return ",\n".join(out) + f"\nSELECT id AS _id, round(avg(y) OVER (PARTITION BY node), 6) AS rich FROM n{levels}"


@query(_class_splits(2))
def tree_fit(spark, sf):
    got = trees.DecisionTreeEstimator(max_depth=6).fit(_customers(spark, sf), ["a", "b", "seg"], "y").predict()
    return _rich(got)


def _rich(got):
    return got.select("_id", r(F.coalesce(F.try_element_at("prediction", F.lit("rich")), F.lit(0.0))).alias("rich"))


@query(_number_splits(3, "SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity AS a, l_discount AS b, l_extendedprice / 1000 AS y FROM lineitem", ("a", "b")) + "SELECT id AS _id, round(avg(y) OVER (PARTITION BY node), 6) AS prediction FROM n3")
def tree_fit_distributed(spark, sf):
    """Split by Spark level by level, down to nodes of 2,000 rows."""
    d = t(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("_id"), "l_quantity", "l_discount", (F.col("l_extendedprice") / 1000).alias("y"))
    return trees.DecisionTreeEstimator(max_depth=4, local_rows=2000).fit(d, ["l_quantity", "l_discount"], "y").predict().select("_id", r("prediction").alias("prediction"))


@query()
def forest_fit(spark, sf):
    return trees.RandomForestEstimator(n_trees=8, max_depth=5, oob=True, beta=1.0).fit(_customers(spark, sf), ["a", "b", "seg"], "y").predict().select("_id", "prediction")


# ---------------------------------------------------------------- linear models and networks

_S = "(0.3 * c_acctbal / 1000 - 0.05 * c_nationkey - 1)"


@query(f"SELECT c_custkey AS _id, round(1 / (1 + exp(-2 * {_S})), 7) AS p_rich, CASE WHEN {_S} > 2.220446049250313e-16 THEN 1 ELSE -1 END::INT AS sign FROM customer")
def perceptron_predict(spark, sf):
    x, w = arrays.vector(["a", "b"]), ([0.3, -0.05], -1.0)
    p = linear.linear_pmf(x, [w, w], ["rich", "poor"])
    return _customers(spark, sf).select("_id", r(F.element_at(p, "rich"), 7).alias("p_rich"), linear.sign_predict(x, *w).alias("sign"))


@query("SELECT c_custkey AS _id, round(greatest(0, 0.5 * a - 0.1 * b + 0.2) * 0.7 + greatest(0, -0.2 * a + 0.3 * b - 0.1) * -0.4 + 0.05, 8) AS prediction FROM (SELECT c_custkey, c_acctbal / 1000 AS a, c_nationkey AS b FROM customer)")
def nn_forward_literal(spark, sf):
    net = nn.Network([nn.DenseLayer(2, 2, nn.relu, w=[[0.5, -0.1], [-0.2, 0.3]], wb=[0.2, -0.1]), nn.DenseLayer(2, 1, nn.identity, w=[[0.7, -0.4]], wb=[0.05])])
    return nn.score(_customers(spark, sf), net, ["a", "b"], "p").select("_id", r(F.get("p", F.lit(0)), 8).alias("prediction"))


@query(f"SELECT c_custkey AS _id, round(2 * exp(-0.5 * (power(c_acctbal / 1000 - 1, 2) + power(c_nationkey - 3, 2))) - exp(-0.5 * (power(c_acctbal / 1000 - 5, 2) + power(c_nationkey - 12, 2))), 8) + 0.0 AS score FROM customer WHERE {_S} IS NOT NULL")
def kernel_score(spark, sf):
    c = linear.kernel_score(arrays.vector(["a", "b"]), [([1.0, 3.0], 2.0), ([5.0, 12.0], -1.0)])
    return _customers(spark, sf).select("_id", r(c, 8).alias("score"))


def _passes(epochs: int, wrong: str, right: str) -> str:
    """A fold over the rows in order of their ids, pass after pass until one has no error; ``x`` is the state, ``y`` the row."""
    zero = "0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2, 0.0::DOUBLE AS c, 0::BIGINT AS bad, false AS done"
    say = lambda w: ", ".join(f"'{n}': {v}" for n, v in w.items())
    row = {k: f"y.{k}" for k in ("a", "b", "s", "t")}
    # errors of the pass before, if this row begins a new one
    over = "(x.done OR (y.t > x.t AND x.bad = 0 AND x.t > 0))"
    bad = "CASE WHEN y.t > x.t THEN 0 ELSE x.bad END"
    keep = say({**row, "w1": "x.w1", "w2": "x.w2", "c": "x.c", "bad": bad, "done": "true"})
    return f"""WITH r AS (SELECT c_custkey, c_acctbal / 1000 AS a, c_nationkey::DOUBLE AS b, CASE WHEN c_acctbal > 5000 THEN 'rich' ELSE 'poor' END AS y FROM customer),
    f AS (SELECT arg_min(y, c_custkey) AS first FROM r),
    e AS (SELECT a, b, CASE WHEN y = first THEN 1.0 ELSE -1.0 END::DOUBLE AS s, t::BIGINT AS t, {zero}, c_custkey FROM r, f, range(1, {epochs + 1}) g(t)),
    l AS (SELECT list({{'a': a, 'b': b, 's': s, 't': t, 'w1': w1, 'w2': w2, 'c': c, 'bad': bad, 'done': done}} ORDER BY t, c_custkey) AS rows FROM e),
    z AS (SELECT list_reduce(list_prepend({{'a': 0.0::DOUBLE, 'b': 0.0::DOUBLE, 's': 0.0::DOUBLE, 't': 0::BIGINT, 'w1': 0.0::DOUBLE, 'w2': 0.0::DOUBLE, 'c': 0.0::DOUBLE, 'bad': 0::BIGINT, 'done': false}}, rows),
        lambda x, y: CASE WHEN {over} THEN {{{keep}}} WHEN y.s * (x.w1 * y.a + x.w2 * y.b + x.c) <= 2.220446049250313e-16 THEN {{{wrong.format(row=say(row), bad=bad + " + 1")}}} ELSE {{{right.format(row=say(row), bad=bad)}}} END) AS m FROM l)
    SELECT c_custkey AS _id, round(1 / (1 + exp(-2 * (CASE WHEN first = 'rich' THEN 1 ELSE -1 END) * (m.w1 * a + m.w2 * b + m.c))), 6) AS rich FROM r, f, z"""


_ETA, _SHRINK = "(1 / sqrt(y.t))", "(1 - 0.5 / sqrt(y.t))"


@query(_passes(20, "{row}, 'w1': x.w1 + y.s * y.a, 'w2': x.w2 + y.s * y.b, 'c': x.c + y.s, 'bad': {bad}, 'done': false", "{row}, 'w1': x.w1, 'w2': x.w2, 'c': x.c, 'bad': {bad}, 'done': false"))
def perceptron_fit(spark, sf):
    rows = linear.PerceptronClassifier(epochs=20, shuffle=False).fit(_customers(spark, sf), ["a", "b"], "y").predict()
    return rows.select("_id", r(F.try_element_at("prediction", F.lit("rich"))).alias("rich"))


@query(
    _passes(
        10,
        f"{{row}}, 'w1': {_SHRINK} * x.w1 + {_ETA} * y.s * y.a, 'w2': {_SHRINK} * x.w2 + {_ETA} * y.s * y.b, 'c': x.c + {_ETA} * y.s, 'bad': {{bad}}, 'done': false",
        f"{{row}}, 'w1': {_SHRINK} * x.w1, 'w2': {_SHRINK} * x.w2, 'c': x.c, 'bad': {{bad}}, 'done': false",
    )
)
def pegasos_fit(spark, sf):
    rows = linear.PegasosClassifier(epochs=10, shuffle=False).fit(_customers(spark, sf), ["a", "b"], "y").predict()
    return rows.select("_id", r(F.try_element_at("prediction", F.lit("rich"))).alias("rich"))


@query()
def kernel_perceptron_fit(spark, sf):
    d = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("_id"), (F.col("s_acctbal") / 1000).alias("a"), F.col("s_nationkey").cast("double").alias("b"), F.when(F.col("s_acctbal") > 5000, "rich").when(F.col("s_acctbal") > 2000, "middle").otherwise("poor").alias("y"))
    return linear.KernelPerceptronClassifier(epochs=10, shuffle=False).fit(d, ["a", "b"], "y").predict().select("_id", "prediction")


@query()
def nn_fit(spark, sf):
    d = _customers(spark, sf).withColumn("z", F.col("a") * 0.5 + F.col("b") * 0.1)
    return nn.NeuralNetworkEstimator(epochs=10, batch_size=32).fit(d, ["a", "b"], "z").predict().select("_id", "prediction")


@query()
def nn_fit_parallel(spark, sf):
    d = _customers(spark, sf).withColumn("z", F.col("a") * 0.5 + F.col("b") * 0.1)
    return nn.NeuralNetworkEstimator(epochs=3, batch_size=32, parallel=4).fit(d, ["a", "b"], "z").predict().select("_id", "prediction")


@query()
def autoencoder(spark, sf):
    m = nn.AutoEncoder(epochs=5, encoded_size=1).fit(_customers(spark, sf), ["a", "b"])
    return m.inverse_transform(m.predict()).select("_id", "encoded", "decoded")


# ---------------------------------------------------------------- search and ranking


#: Folds are drawn, so SQL can't search; it grows the tree of the deeper setting, which the search has to find.
_TUNED = _class_splits(2, ("a", "b"))


@query(_TUNED)
def grid_search(spark, sf):
    m = trees.DecisionTreeEstimator(autotune=True, tunemethod=tune.GridSearch({"max_depth": [1, 4]}, res_share=0.3))
    return _rich(m.fit(_customers(spark, sf), ["a", "b"], "y").predict())


@query(_TUNED)
def halving(spark, sf):
    m = trees.DecisionTreeEstimator(autotune=True, tunemethod=tune.SuccessiveHalvingSearch({"max_depth": [1, 4]}, res_shares=[0.1, 0.3]))
    return _rich(m.fit(_customers(spark, sf), ["a", "b"], "y").predict())


@query()
def feature_ranker(spark, sf):
    m = tune.FeatureRanker(model=trees.DecisionTreeEstimator(max_depth=4), nsplits=2)
    ranked = m.fit(_customers(spark, sf), ["a", "b"], "y").predict()
    return spark.createDataFrame(list(enumerate(ranked)), "place int, feature string")


# ---------------------------------------------------------------- statistics


@query("""WITH p AS (SELECT * FROM (VALUES ('1-URGENT', 0.2), ('2-HIGH', 0.2), ('3-MEDIUM', 0.2), ('4-NOT SPECIFIED', 0.2), ('5-LOW', 0.2)) v(value, p)), c AS (SELECT p, coalesce(n, 0) AS n FROM p LEFT JOIN (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) ON value = o_orderpriority)
SELECT round(sum(power(n - p * s, 2) / (p * s)), 6) AS chi2 FROM c, (SELECT sum(n) AS s FROM c)""")
def chi2_statistic(spark, sf):
    expected = spark.createDataFrame([(v, 0.2) for v in PRIORITIES], "value string, p double")
    return stats.chi2_statistic(t(spark, sf, "orders"), "o_orderpriority", expected).select(r("chi2").alias("chi2"))


@query("""WITH v AS (SELECT 1 - exp(-value / 50) AS f, row_number() OVER (ORDER BY value) AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL)
SELECT any_value(n)::BIGINT AS n, round(max(greatest(abs((i - 1) / n - f), abs(i / n - f))), 8) AS distance FROM v""")
def ks_statistic(spark, sf):
    return stats.ks_distance(t(spark, sf, "events"), "value", lambda x: 1 - F.exp(-x / 50)).select("n", r("distance", 8).alias("distance"))


_LOSS = "avg(CASE WHEN abs(value - theta) < 5 THEN power(value - theta, 2) / 2 ELSE 5 * (abs(value - theta) - 2.5) END)"


@query(f"WITH c AS (SELECT theta, {_LOSS} AS loss FROM events, (SELECT unnest(range(0, 101, 10)) AS theta) GROUP BY 1) SELECT theta::DOUBLE AS theta, round(loss, 6) AS loss FROM c ORDER BY loss, theta LIMIT 1")
def huber_mean(spark, sf):
    theta, loss = stats.m_estimation(t(spark, sf, "events"), "value", list(range(0, 101, 10)), lambda x: distances.huber_loss(x, 5.0))
    return spark.createDataFrame([(theta, round(loss, 6))], "theta double, loss double")


@query("WITH c AS (SELECT theta, avg(CASE WHEN value - theta >= 0 THEN 0.75 * (value - theta) ELSE -0.25 * (value - theta) END) AS loss FROM events, (SELECT unnest(range(0, 201)) AS theta) GROUP BY 1) SELECT theta::DOUBLE AS quantile FROM c ORDER BY loss, theta LIMIT 1")
def quantile_grid(spark, sf):
    theta, _ = stats.m_estimation(t(spark, sf, "events"), "value", list(range(201)), lambda x: distances.pinball(x, 0.75))
    return spark.createDataFrame([(theta,)], "quantile double")


# ---------------------------------------------------------------- the rest of the functions


_XY = "(SELECT vec_id, embedding::DOUBLE[] AS z, list_reverse(embedding::DOUBLE[]) AS v FROM embeddings)"


@query("""SELECT event_id, 1.0::DOUBLE AS didentity, CASE WHEN x >= -1 AND x <= 1 THEN 1.0 ELSE 0.1 END::DOUBLE AS dplu, x = floor(x) AS whole FROM (SELECT event_id, event_id % 7 * 0.5 - 1.6 AS x FROM events)""")
def derivatives_of_identity(spark, sf):
    x = F.col("event_id") % 7 * F.lit(0.5) - F.lit(1.6)
    d = t(spark, sf, "events").select("event_id", x.alias("x"))
    return d.select("event_id", act.didentity("x").alias("didentity"), act.dplu("x").alias("dplu"), prep.is_integer_valued("x").alias("whole"))


@query(f"""SELECT vec_id, round(list_sum(list_transform(range(1, len(z) + 1), lambda i: -i * z[i] / (abs(v[i]) + 1 + 1e-15))), 5) AS dcrossentropy, round(list_sum(list_transform(range(1, len(z) + 1), lambda i: i * (v[i] - z[i]))), 5) AS dsquared,
round(list_sum(list_transform(range(1, len(z) + 1), lambda i: power(v[i] - z[i], 2))) / 2, 5) AS squared FROM {_XY}""")
def cost_derivatives(spark, sf):
    e = t(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("z")).withColumn("v", F.reverse("z")).withColumn("u", F.transform("v", lambda x: F.abs(x) + 1))
    weighed = lambda a: r(F.aggregate(F.transform(a, lambda x, i: (i + 1) * x), F.lit(0.0), lambda p, q: p + q), 5)
    return e.select("vec_id", weighed(distances.dcrossentropy("z", "u")).alias("dcrossentropy"), weighed(distances.dsquared_cost("z", "v")).alias("dsquared"), r(distances.squared_cost("z", "v"), 5).alias("squared"))


@query("""WITH p AS (SELECT vec_id, z, list_transform(z, lambda x: exp(x) / s) AS p FROM (SELECT vec_id, z, list_sum(list_transform(z, lambda x: exp(x))) AS s FROM (SELECT vec_id, embedding[1:4]::DOUBLE[] AS z FROM embeddings)))
SELECT vec_id, round(p[1] * (1 - p[1]), 6) AS d11, round(-p[1] * p[2], 6) AS d12, round(p[4] * (1 - p[4]), 6) AS d44, list_position(z, list_max(z))::INT AS dmax_at, round(1 / 4, 6)::DOUBLE AS dmean FROM p""")
def jacobians(spark, sf):
    e = t(spark, sf, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 4).alias("z"))
    d = e.select("vec_id", act.dsoftmax("z").alias("s"), act.dmaximum("z").alias("m"), act.dmean("z").alias("a"))
    at = lambda i, j: r(F.get(F.get("s", F.lit(i)), F.lit(j)))
    return d.select("vec_id", at(0, 0).alias("d11"), at(0, 1).alias("d12"), at(3, 3).alias("d44"), F.array_position("m", 1.0).cast("int").alias("dmax_at"), r(F.get("a", F.lit(2))).alias("dmean"))


_A, _B = "(l_quantity - 25)", "(l_extendedprice / 1000 - 30)"


@query(f"""SELECT l_orderkey, l_linenumber, round(-ln(2 * pi() * 9) - ({_A} * {_A} + {_B} * {_B}) / 18, 5) AS spherical, round(-ln(2 * pi()) - 0.5 * ln(100 * 64) - {_A} * {_A} / 200 - {_B} * {_B} / 128, 5) AS diagonal,
round(-ln(2 * pi()) - 0.5 * ln(100 * 64 - 400) - 0.5 * (64 * {_A} * {_A} - 40 * {_A} * {_B} + 100 * {_B} * {_B}) / (100 * 64 - 400), 5) AS full_ FROM lineitem""")
def gaussian_densities(spark, sf):
    d = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 1000).alias("b"))
    kinds = {"spherical": gmm.SphericalGaussian([25.0, 30.0], 9.0), "diagonal": gmm.DiagonalGaussian([25.0, 30.0], [100.0, 64.0]), "full_": gmm.FullGaussian([25.0, 30.0], [[100.0, 20.0], [20.0, 64.0]])}
    return d.select("l_orderkey", "l_linenumber", *[r(m.log_density([F.col("a"), F.col("b")], [(0, 1)]), 5).alias(n) for n, m in kinds.items()])


@query("""WITH e AS (SELECT vec_id, 1 + vec_id % 8 AS y, embedding[1:8]::DOUBLE[] AS p FROM embeddings), q AS (SELECT y, list_count(list_filter(p, lambda x: x > p[y])) AS above FROM e)
SELECT tol::INT AS tol, round(avg((above < tol)::INT), 8) AS accuracy, round(1 - avg((above < tol)::INT), 8) AS error FROM q, range(1, 9) g(tol) GROUP BY 1""")
def accuracy_by_tolerance(spark, sf):
    e = t(spark, sf, "embeddings").select((1 + F.col("vec_id") % 8).alias("y"), F.slice(F.col("embedding").cast("array<double>"), 1, 8).alias("p"))
    rows = e.select(F.inline(F.array(*[F.struct(F.lit(k).alias("tol"), pmf.accuracy_of_array("y", "p", k).alias("hit")) for k in range(1, 9)])))
    return rows.groupBy("tol").agg(r(F.avg("hit"), 8).alias("accuracy"), r(1 - F.avg("hit"), 8).alias("error"))


@query(_PMF + """, o AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY round(p, 12) DESC, event_type) AS k FROM p)
SELECT round(avg((k <= 2)::INT), 8) AS top2 FROM (SELECT u.user_id, o.k FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN o ON o.user_id = u.user_id AND o.event_type = 'click')""".replace("avg((k <= 2)::INT)", "avg(coalesce(k <= 2, false)::INT)"))
def accuracy_of_pmfs(spark, sf):
    rounded = F.transform_values("pmf", lambda k, v: F.round(v, 12))
    return _user_pmf(spark, sf).select(pmf.accuracy_of_map(F.lit("click"), rounded, 2).alias("hit")).agg(r(F.avg("hit"), 8).alias("top2"))


@query("SELECT round(avg((l_returnflag <> CASE WHEN l_linestatus = 'O' THEN 'N' ELSE 'R' END)::INT), 8) AS error FROM lineitem")
def error_rate(spark, sf):
    d = t(spark, sf, "lineitem").select("l_returnflag", F.when(F.col("l_linestatus") == "O", "N").otherwise("R").alias("guess"))
    return spark.createDataFrame([(round(measures.error(d, "l_returnflag", "guess"), 8),)], "error double")


@query("""WITH g AS (SELECT c_mktsegment AS s, var_samp(c_acctbal) AS v, count(*) AS n FROM customer GROUP BY 1), a AS (SELECT * FROM g WHERE s = 'BUILDING'), b AS (SELECT * FROM g WHERE s = 'MACHINERY')
SELECT floor(power(a.v / a.n + b.v / b.n, 2) / (power(a.v, 2) / (power(a.n, 2) * (a.n - 1)) + power(b.v, 2) / (power(b.n, 2) * (b.n - 1))))::BIGINT AS dof FROM a, b""")
def welch_degrees(spark, sf):
    g = {x[0]: x[1:] for x in t(spark, sf, "customer").groupBy("c_mktsegment").agg(F.var_samp("c_acctbal"), F.count(F.lit(1))).collect()}
    (va, na), (vb, nb) = g["BUILDING"], g["MACHINERY"]
    return spark.createDataFrame([(stats.welch_satterthwaite(va, vb, na, nb),)], "dof long")


@query("""WITH c AS (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority), x AS (SELECT sum(power(n - s / 5, 2) / (s / 5)) AS v FROM c, (SELECT sum(n) AS s FROM c))
SELECT round(v, 6) AS value, round(exp(-v / 2) * (1 + v / 2), 6) AS p_value, v > 9.487729036781154 AS rejected FROM x""")
def goodness_of_fit(spark, sf):
    got = stats.goodness_of_fit_support(t(spark, sf, "orders"), "o_orderpriority", {v: 0.2 for v in PRIORITIES})
    return spark.createDataFrame([(round(got["testValue"], 6), round(got["p_value"], 6), got["rejectedH0"])], "value double, p_value double, rejected boolean")


@query("""WITH v AS (SELECT value / 50 AS f, row_number() OVER (ORDER BY value) AS i, count(*) OVER () AS n FROM (SELECT (event_id * 7919 % 1000 + 0.5) / 20 AS value FROM events WHERE event_id % 10 = 3)), d AS (SELECT sqrt(any_value(n)) * max(greatest(abs((i - 1) / n - f), abs(i / n - f))) AS d FROM v)
SELECT round(d, 6) AS value, round(CASE WHEN d < 1.18 THEN 1 - sqrt(2 * pi()) / d * (SELECT sum(exp(-power(2 * k - 1, 2) * power(pi(), 2) / (8 * d * d))) FROM range(1, 40) g(k)) ELSE 2 * (SELECT sum((CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * k * k * d * d)) FROM range(1, 100) g(k)) END, 6) + 0.0 AS p_value FROM d""")
def ks_p_value(spark, sf):
    d = t(spark, sf, "events").where("event_id % 10 = 3").select(((F.col("event_id") * 7919 % 1000 + F.lit(0.5)) / 20).alias("v"))
    got = stats.ks_test(d, "v", lambda x: x / 50)
    return spark.createDataFrame([(round(got["testValue"], 6), round(got["p_value"], 6))], "value double, p_value double")


@query("SELECT v AS value, coalesce(n, 0)::BIGINT AS count FROM (VALUES ('purchase'), ('click'), ('nothing')) s(v) LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) ON v = event_type")
def density_on_support(spark, sf):
    support = spark.createDataFrame([("purchase",), ("click",), ("nothing",)], "value string")
    return stats.compute_density(t(spark, sf, "events"), "event_type", support)


@query("SELECT row_number() OVER (ORDER BY min(o_orderkey)) AS place, o_orderpriority AS value FROM orders GROUP BY 2")
def first_appearances(spark, sf):
    got = prep.single_unique(t(spark, sf, "orders"), "o_orderpriority", "o_orderkey").collect()  # the distinct priorities
    return spark.createDataFrame([(k, x[0]) for k, x in enumerate(got, 1)], "place long, value string")


@query("SELECT l_orderkey, l_linenumber, k AS place, CASE k WHEN 1 THEN l_quantity WHEN 2 THEN l_extendedprice ELSE l_discount END AS x FROM lineitem, range(1, 4) g(k)")
def matrix_as_column(spark, sf):
    d = prep.disallow_missing(prep.allow_missing(t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *ITEM)))
    d = prep.as_column(prep.as_features(d, ITEM), "features")
    return d.select("l_orderkey", "l_linenumber", F.col("_at").cast("long").alias("place"), "x")


@query("SELECT k::INT AS k, x::DOUBLE AS x FROM (VALUES (1, 3.5), (2, -1.0), (3, 7.25)) v(k, x)")
def vector_of_row(spark, sf):
    return prep.row_vector(spark, [3.5, -1, 7.25]).select(F.posexplode(prep.flatten(F.array("features"))).alias("k", "x")).select((F.col("k") + 1).alias("k"), "x")


@query("SELECT c_mktsegment, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY 1")
def running_mean(spark, sf):
    """Means of segments, put together from the means of nations and the sizes of both by the update rule."""
    parts = t(spark, sf, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.sum("c_acctbal").alias("s"), F.count(F.lit(1)).alias("n")).orderBy("c_mktsegment", "c_nationkey").collect()  # at most 5 x 25
    held: dict[str, tuple[float, int]] = {}
    for seg, _, s, n in parts:
        mean, m = held.get(seg, (0.0, 0))
        held[seg] = (measures.online_mean(s / n, mean, m / n), m + n)
    return spark.createDataFrame([(k, round(v, 4)) for k, (v, _) in held.items()], "c_mktsegment string, mean double")


@query("WITH RECURSIVE s AS (SELECT 0 AS n, range(0, 8) AS k, [1, 0, 0, 0, 0, 0, 0, 0]::BIGINT[] AS v UNION ALL SELECT n + 1, k, list_transform(range(1, 9), lambda j: CASE WHEN j = 1 THEN 0 ELSE (j - 1) * v[j] + v[j - 1] END) FROM s WHERE n < 7) SELECT unnest(range(1, 8))::INT AS k, unnest(v[2:8])::BIGINT AS number FROM s WHERE n = 7")
def stirling_numbers(spark, sf):
    return spark.createDataFrame([(k, stats.sterling(7, k)) for k in range(1, 8)], "k int, number long")


@query(f"SELECT l_orderkey, l_linenumber, {_Z} FROM lineitem")
def saved_model(spark, sf):
    """A scaler that was saved beside another one, reset, loaded and applied."""
    df = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *ITEM)
    path = f"{_shared(spark)}/models-{uuid.uuid4().hex}"
    m = prep.Scaler(method=prep.Standard(), cache=False).fit(df, ITEM)
    model_save(spark, path, other=prep.Scaler(method=prep.MinMax(), cache=False).fit(df, ITEM))
    model_save(spark, path, mine=m)
    m.reset()
    out = model_load(spark, path, "mine").transform(df)
    return out.select("l_orderkey", "l_linenumber", *[r(c, 4).alias(c) for c in ITEM])


def _shared(spark) -> str:
    return spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """Three clusters of lineitem: sizes and centres."""
    df = t(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("_id"), *ITEM)
    m = cluster.KMeansClusterer(n_classes=3, max_iter=30, cache=False).fit(df, ITEM)
    return cluster.kmeans_update(m.transform(df).withColumnRenamed("prediction", "cluster"), ITEM)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
