"""The library's queries over the star-schema tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tricord.functions import metrics, vectors
from tricord.operators import commuting, features, fm, mf, motifs, prep, sparse
from tricord.plans.storage import materialize
from tricord.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

RATINGS = """ratings AS (SELECT u, b, CAST(ceil(q / 10) AS DOUBLE) AS rating FROM (
  SELECT CAST(o_custkey AS BIGINT) AS u, CAST(l_partkey AS BIGINT) AS b, l_quantity AS q, row_number() OVER (PARTITION BY o_custkey, l_partkey
    ORDER BY o_orderdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_quantity DESC) AS rn
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey) t WHERE rn = 1)"""
TRUST = """trust AS (SELECT DISTINCT CAST(x.user_id AS BIGINT) AS src, CAST(y.user_id AS BIGINT) AS dst
  FROM events x JOIN events y ON y.event_id = x.event_id + 1 WHERE x.user_id <> y.user_id)"""
SPLIT = """split AS (SELECT u, b, rating, CASE WHEN rk < floor(n * CAST(0.8 AS DOUBLE)) THEN 'train'
    WHEN rk < floor(n * CAST(0.8 AS DOUBLE)) + floor(n * CAST(0.1 AS DOUBLE)) THEN 'test' ELSE 'val' END AS split
  FROM (SELECT *, row_number() OVER (ORDER BY md5('1:' || u || ':' || b), u, b) - 1 AS rk, count(*) OVER () AS n FROM ratings))"""
TRAIN = "train AS (SELECT u, b, rating FROM split WHERE split = 'train')"
U_B = """mutual AS (SELECT src AS i, dst AS j FROM trust SEMI JOIN (SELECT dst AS src, src AS dst FROM trust) t USING (src, dst)),
oneway AS (SELECT src AS i, dst AS j FROM trust ANTI JOIN (SELECT dst AS src, src AS dst FROM trust) t USING (src, dst)),
turned AS (SELECT j AS i, i AS j FROM oneway)"""


def _motif_sql(m: str) -> str:
    of = {"U": "oneway", "B": "mutual", "V": "turned"}
    terms, both = motifs.TERMS[m]
    rows = " UNION ALL ".join(f"SELECT x.i, y.j FROM {of[a]} x JOIN {of[b]} y ON x.j = y.i SEMI JOIN {of[c]} z ON z.i = x.i AND z.j = y.j" for a, b, c in terms.split())
    rows = f"SELECT i, j FROM ({rows})"
    rows = f"{rows} UNION ALL SELECT j, i FROM ({rows})" if both else rows
    return f"SELECT i, j, CAST(count(*) AS BIGINT) AS w FROM ({rows}) GROUP BY i, j"


def _all_motifs_sql() -> str:
    return " UNION ALL ".join(f"SELECT '{m}' AS motif, i, j, w FROM ({_motif_sql(m)})" for m in motifs.MOTIFS)


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _train(spark: SparkSession, d: str) -> DataFrame:
    return prep.train_of(prep.split_ratings(tables.ratings(spark, d)))


# preparation

_query("ratings_dedup_last", _with(RATINGS) + "SELECT * FROM ratings")(tables.ratings)
_query("trust_edges", _with(TRUST) + "SELECT * FROM trust")(tables.trust)
DOMAIN = "domain AS (SELECT DISTINCT id FROM (SELECT u AS id FROM ratings UNION ALL SELECT src FROM trust UNION ALL SELECT dst FROM trust))"


@_query("user_domain", _with(RATINGS, TRUST, DOMAIN) + "SELECT id FROM domain")
def user_domain(spark: SparkSession, d: str) -> DataFrame:
    return prep.user_domain(tables.ratings(spark, d), tables.trust(spark, d))


@_query("item_domain", _with(RATINGS) + "SELECT DISTINCT b AS id FROM ratings")
def item_domain(spark: SparkSession, d: str) -> DataFrame:
    return prep.item_domain(tables.ratings(spark, d))


@_query("index_encode_users", _with(RATINGS, TRUST, DOMAIN) + "SELECT id, row_number() OVER (ORDER BY id) - 1 AS ind FROM domain")
def index_encode_users(spark: SparkSession, d: str) -> DataFrame:
    return prep.encode_ids(user_domain(spark, d))


@_query("split_80_10_10", _with(RATINGS, SPLIT) + "SELECT * FROM split")
def split_80_10_10(spark: SparkSession, d: str) -> DataFrame:
    return prep.split_ratings(tables.ratings(spark, d))


@_query("split_80_20", _with(RATINGS) + """SELECT u, b, rating, CASE WHEN rk < floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (ORDER BY md5('1:' || u || ':' || b), u, b) - 1 AS rk, count(*) OVER () AS n FROM ratings)""")
def split_80_20(spark: SparkSession, d: str) -> DataFrame:
    return prep.split_ratings(tables.ratings(spark, d), shares=prep.TWO_SHARES)


@_query("index_decode_ratings", _with(RATINGS) + "SELECT * FROM ratings")
def index_decode_ratings(spark: SparkSession, d: str) -> DataFrame:
    """Users numbered and named again: the ratings as they were."""
    ratings = materialize(tables.ratings(spark, d), "ratings")
    codes = materialize(prep.encode_ids(ratings.select(F.col("u").alias("id"))), "codes")
    numbered = ratings.join(codes.withColumnRenamed("id", "u"), "u").select(F.col("ind").alias("u"), "b", "rating")
    return prep.decode_ids(numbered, codes, "u")


@_query("split_counts_5", _with(RATINGS) + """SELECT s AS split_no, split, count(*) AS n FROM (
  SELECT s, CASE WHEN rk < floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' WHEN rk < floor(n * CAST(0.8 AS DOUBLE)) + floor(n * CAST(0.1 AS DOUBLE)) THEN 'test' ELSE 'val' END AS split
  FROM (SELECT CAST(s AS INT) AS s, row_number() OVER (PARTITION BY s ORDER BY md5(s || ':' || u || ':' || b), u, b) - 1 AS rk, count(*) OVER (PARTITION BY s) AS n
        FROM ratings CROSS JOIN range(1, 6) t(s))) GROUP BY s, split""")
def split_counts_5(spark: SparkSession, d: str) -> DataFrame:
    return prep.five_splits(tables.ratings(spark, d)).groupBy("split_no", "split").agg(F.count("*").alias("n"))


@_query("social_filter_either_whole", _with(RATINGS, TRUST, SPLIT, TRAIN) + "SELECT src, dst FROM trust WHERE src IN (SELECT u FROM train) OR dst IN (SELECT u FROM train)")
def social_filter_either_whole(spark: SparkSession, d: str) -> DataFrame:
    return prep.social_filter(tables.trust(spark, d), _train(spark, d))


@_query("train_pairs", _with(RATINGS, SPLIT, TRAIN) + "SELECT u, b FROM train")
def train_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _train(spark, d).select("u", "b")


# sparse matrices

ADJ = "adj AS (SELECT CAST(l_suppkey AS BIGINT) AS i, CAST(l_partkey AS BIGINT) AS j, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS w FROM lineitem GROUP BY ALL)"


@_query("adj_weighted_sum", _with(ADJ) + "SELECT * FROM adj")
def adj_weighted_sum(spark: SparkSession, d: str) -> DataFrame:
    lines = tables.table(spark, d, "lineitem").select(F.col("l_suppkey").cast("long").alias("s"), F.col("l_partkey").cast("long").alias("p"), F.col("l_quantity").cast("long").alias("q"))
    return sparse.adjacency(lines, "s", "p", F.col("q"))


@_query("adj_transpose", _with(ADJ) + "SELECT j AS i, i AS j, w FROM adj")
def adj_transpose(spark: SparkSession, d: str) -> DataFrame:
    return sparse.transpose(adj_weighted_sum(spark, d))


@_query("mutual_edges", _with(TRUST, U_B) + "SELECT i AS src, j AS dst FROM mutual")
def mutual_edges(spark: SparkSession, d: str) -> DataFrame:
    return motifs.mutual(tables.trust(spark, d))


@_query("oneway_edges", _with(TRUST, U_B) + "SELECT i AS src, j AS dst FROM oneway")
def oneway_edges(spark: SparkSession, d: str) -> DataFrame:
    return motifs.one_way(tables.trust(spark, d))


def _unit(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(1).cast("long").alias("w"))


@_query("spgemm_uu", _with(TRUST, U_B) + "SELECT x.i, y.j, CAST(count(*) AS BIGINT) AS w FROM oneway x JOIN oneway y ON x.j = y.i GROUP BY x.i, y.j")
def spgemm_uu(spark: SparkSession, d: str) -> DataFrame:
    u = _unit(oneway_edges(spark, d))
    return sparse.multiply(u, u)


@_query("hadamard_uu", _with(TRUST) + "SELECT x.src AS i, x.dst AS j, CAST(1 AS BIGINT) AS w FROM trust x JOIN trust y ON x.src = y.dst AND x.dst = y.src")
def hadamard_uu(spark: SparkSession, d: str) -> DataFrame:
    a = _unit(tables.trust(spark, d))
    return sparse.hadamard(a, sparse.transpose(a))


@_query("subtract_uu", _with(TRUST, U_B) + "SELECT i, j, CAST(1 AS BIGINT) AS w FROM oneway")
def subtract_uu(spark: SparkSession, d: str) -> DataFrame:
    a = _unit(tables.trust(spark, d))
    return sparse.subtract(a, sparse.hadamard(a, sparse.transpose(a)))


@_query("base_uub", _with(TRUST) + "SELECT src AS i, dst AS j, CAST(1 AS BIGINT) AS w FROM trust")
def base_uub(spark: SparkSession, d: str) -> DataFrame:
    return commuting.base_matrix("UUB", tables.trust(spark, d), _train(spark, d))


UBUB = "ubub AS (SELECT x.u AS i, y.u AS j, CAST(count(*) AS BIGINT) AS w FROM train x JOIN train y ON x.b = y.b GROUP BY x.u, y.u)"


@_query("base_ubub", _with(RATINGS, SPLIT, TRAIN, UBUB) + "SELECT i, count(*) AS cells, CAST(sum(w) AS BIGINT) AS total, CAST(max(CASE WHEN i = j THEN w END) AS BIGINT) AS own FROM ubub GROUP BY i")
def base_ubub(spark: SparkSession, d: str) -> DataFrame:
    m = commuting.base_matrix("UBUB", tables.trust(spark, d), _train(spark, d))
    return m.groupBy("i").agg(F.count("*").alias("cells"), F.sum("w").alias("total"), F.max(F.when(F.col("i") == F.col("j"), F.col("w"))).alias("own"))


# motifs

for _m in motifs.MOTIFS:
    _query(f"motif_{_m}", _with(TRUST, U_B) + _motif_sql(_m))(lambda spark, d, m=_m: motifs.motif_matrix(tables.trust(spark, d), m))


@_query("motif_all_single_pass", _with(TRUST, U_B) + _all_motifs_sql())
def motif_all_single_pass(spark: SparkSession, d: str) -> DataFrame:
    return motifs.all_motifs(tables.trust(spark, d))


@_query("motif_m2_by_terms", _with(TRUST, U_B) + _motif_sql("m2"))
def motif_m2_by_terms(spark: SparkSession, d: str) -> DataFrame:
    return motifs.motif_by_terms(tables.trust(spark, d), "m2")


# similarities

def _blend_sql(base: str, m: str, step: int) -> str:
    return f"""base AS ({base}), motif AS ({_motif_sql(m)}),
blend AS (SELECT i, j, CAST(sum(w) AS BIGINT) AS w FROM (SELECT i, j, {10 - step} * w AS w FROM base UNION ALL SELECT i, j, {step} * w FROM motif) GROUP BY i, j HAVING sum(w) <> 0)"""


SCORES = "scores AS (SELECT x.i AS u, t.b, CAST(sum(w) AS BIGINT) AS w FROM blend x JOIN train t ON x.j = t.u GROUP BY x.i, t.b)"
PLAIN_BASE = "SELECT src AS i, dst AS j, CAST(1 AS BIGINT) AS w FROM trust"


def _top_sql(k: int) -> str:
    return f"SELECT u, b, w / 10.0::DOUBLE AS score, CAST(rn AS INT) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY w DESC, b) AS rn FROM scores WHERE w > 0) WHERE rn <= {k}"


def _commute(path: str, motif: str, step: int, k: int = commuting.TOP_K) -> Query:
    return lambda spark, d: commuting.commuting(path, motif, step, tables.trust(spark, d), materialize(_train(spark, d), "train"), k)


@_query("blend_uub_m4_a5", _with(TRUST, U_B, _blend_sql(PLAIN_BASE, "m4", 5)) + "SELECT * FROM blend")
def blend_uub_m4_a5(spark: SparkSession, d: str) -> DataFrame:
    trust = tables.trust(spark, d)
    return commuting.blend(_unit(trust), motifs.motif_matrix(trust, "m4"), 5)


for _name, _p, _m, _s, _k in [("commute_uub_m1_a0", "UUB", "m1", 0, 500), ("commute_uub_m3_a10", "UUB", "m3", 10, 500), ("commute_ubub_m4_a5", "UBUB", "m4", 5, commuting.TOP_K), *((f"topk_uub_{m}_a5", "UUB", m, 5, 500) for m in motifs.MOTIFS)]:
    _base = PLAIN_BASE if _p == "UUB" else "SELECT * FROM ubub"
    _query(_name, _with(RATINGS, TRUST, SPLIT, TRAIN, *[UBUB] * (_p == "UBUB"), U_B, _blend_sql(_base, _m, _s), SCORES) + _top_sql(_k))(_commute(_p, _m, _s, _k))


@_query("alpha_sweep_counts", _with(RATINGS, TRUST, SPLIT, TRAIN, U_B, f"motifs AS MATERIALIZED ({_all_motifs_sql()})", """cells AS (SELECT motif, u, b, CAST(sum(base) AS BIGINT) AS base, CAST(sum(m) AS BIGINT) AS m FROM (
  SELECT motif, i AS u, t.b, 0 AS base, w AS m FROM motifs JOIN train t ON j = t.u
  UNION ALL SELECT 'm' || k, src, t.b, 1, 0 FROM trust JOIN train t ON dst = t.u CROSS JOIN range(1, 8) r(k)) GROUP BY ALL)""", """ranked AS (SELECT motif, s, w, row_number() OVER (PARTITION BY motif, s, u ORDER BY w DESC, b) AS rn FROM (
  SELECT motif, CAST(s AS INT) AS s, u, b, (10 - s) * base + s * m AS w FROM cells CROSS JOIN range(0, 11) r(s)) WHERE w > 0)""") + "SELECT motif, s AS alpha_step, count(*) AS n, CAST(sum(w) AS BIGINT) AS total FROM ranked WHERE rn <= 500 GROUP BY motif, s")
def alpha_sweep_counts(spark: SparkSession, d: str) -> DataFrame:
    trust = materialize(tables.trust(spark, d), "trust")
    found = commuting.sweep(materialize(motifs.all_motifs(trust), "motifs"), "UUB", trust, materialize(_train(spark, d), "train"))
    return found.groupBy("motif", "alpha_step").agg(F.count("*").alias("n"), F.sum(F.round(F.col("score") * 10).cast("long")).alias("total"))


@_query("density_by_motif", _with(TRUST, U_B) + f"SELECT motif, count(*) AS nnz, round(count(*) / CAST((SELECT count(DISTINCT src) FROM trust) AS DOUBLE) / (SELECT count(DISTINCT dst) FROM trust), 9) AS density FROM ({_all_motifs_sql()}) GROUP BY motif")
def density_by_motif(spark: SparkSession, d: str) -> DataFrame:
    trust = tables.trust(spark, d)
    counts = motifs.all_motifs(trust).groupBy("motif").agg(F.count("*").alias("nnz"))
    sides = trust.agg(F.countDistinct("src").alias("n"), F.countDistinct("dst").alias("m"))  # a single row
    return counts.crossJoin(F.broadcast(sides)).select("motif", "nnz", F.round(F.col("nnz") / F.col("n") / F.col("m"), 9).alias("density"))


# metrics

@_query("global_mean_bias", _with(RATINGS, SPLIT, TRAIN) + "SELECT round(avg(rating), 6) AS bias FROM train")
def global_mean_bias(spark: SparkSession, d: str) -> DataFrame:
    return _train(spark, d).agg(F.round(F.avg("rating"), 6).alias("bias"))


@_query("mean_predictor_errors", _with(RATINGS, SPLIT, TRAIN) + "SELECT round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae FROM (SELECT rating - (SELECT avg(rating) FROM train) AS e FROM split WHERE split = 'test')")
def mean_predictor_errors(spark: SparkSession, d: str) -> DataFrame:
    split = materialize(prep.split_ratings(tables.ratings(spark, d)), "split")
    mean = metrics.global_mean(prep.train_of(split))
    found = metrics.error_metrics(split.where("split = 'test'"), F.col("rating") - mean)
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


# iterations of the solver queries but the grid's; the operators' own limits (500, of five splits 1000; 10,000) take hours here, see README
MF_ITERATIONS, FM_ITERATIONS = 20, 40
#: The whole grid: 180 points, each with the operator's own number of iterations.
GRID = {"ranks": (10, 20, 30, 40, 50), "epsilons": (0.001, 0.01, 0.1, 1.0, 10.0, 100.0), "lambdas": (0.01, 0.1, 1.0, 5.0, 10.0, 100.0), "iterations": mf.Options().iterations}
#: Iterations of the 78 graphs' factors, and of the machine in the query of the whole chain.
GRAPH_ITERATIONS, CHAIN_ITERATIONS = 2, 10

# matrix factorisation: one step from start values that SQL can write

RANK, EPS, LAMB = 3, 500.0, 10.0
INIT = "0.5 * (1 + ((id * 31 + 17 * k) % 97) / 97.0::DOUBLE)"
FACTORS = f"""uf AS (SELECT id, CAST(k AS INT) AS k, {INIT} AS x FROM (SELECT DISTINCT u AS id FROM train) CROSS JOIN range(0, {RANK}) r(k)),
bf AS (SELECT id, CAST(k AS INT) AS k, {INIT} AS x FROM (SELECT DISTINCT b AS id FROM train) CROSS JOIN range(0, {RANK}) r(k))"""
RES = "res AS (SELECT t.u, t.b, any_value(t.rating) - (SELECT avg(rating) FROM train) - sum(x.x * y.x) AS r FROM train t JOIN uf x ON x.id = t.u JOIN bf y ON y.id = t.b AND y.k = x.k GROUP BY t.u, t.b)"
GRADS = f"""gu AS (SELECT id, k, {LAMB} * any_value(x) - sum(r * y) AS g, any_value(x) AS x FROM (SELECT uf.id, uf.k, uf.x, res.r, bf.x AS y FROM res JOIN uf ON uf.id = res.u JOIN bf ON bf.id = res.b AND bf.k = uf.k) GROUP BY id, k),
gb AS (SELECT id, k, {LAMB} * any_value(x) - sum(r * y) AS g, any_value(x) AS x FROM (SELECT bf.id, bf.k, bf.x, res.r, uf.x AS y FROM res JOIN bf ON bf.id = res.b JOIN uf ON uf.id = res.u AND uf.k = bf.k) GROUP BY id, k)"""
MF = _with(RATINGS, SPLIT, TRAIN, FACTORS, RES, GRADS)


def _mf_state(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Rows above their mean, and factors of both sides."""
    train = materialize(_train(spark, d), "train")
    mean = F.broadcast(train.agg(F.avg("rating").alias("mu")))  # a single row
    rows = train.crossJoin(mean).select(F.lit("r").alias("key"), "u", "b", (F.col("rating") - F.col("mu")).alias("x"), F.lit(False).alias("held"))
    return rows, mf.factors_of(rows, RANK, 0.5)


def _side(factors: DataFrame, side: str) -> DataFrame:
    return factors.where(F.col("side") == side)


def _mf_blocks(spark: SparkSession, d: str) -> tuple[mf.Factorisation, DataFrame]:
    """The problem laid out in blocks, and the gradients of its start."""
    train = materialize(_train(spark, d), "train")
    work = mf.grouped(_as_rows(train, "r"), None, mf.Options(RANK, EPS, LAMB))
    return work, materialize(work.gradient(work.start(0.5)), "gradients")


def _long(fs: DataFrame, *columns: str) -> DataFrame:
    rows = fs.select("id", F.posexplode(F.arrays_zip(*columns)).alias("k", "z"))
    return rows.select("id", "k", *[F.round(F.col(f"z.{c}"), 6).alias(c) for c in columns])


@_query("factor_init", MF + "SELECT id, k, round(x, 6) AS features FROM uf")
def factor_init(spark: SparkSession, d: str) -> DataFrame:
    return _long(_side(_mf_state(spark, d)[1], "u"), "features")


@_query("mf_residual_init", MF + "SELECT u, b, round(r, 6) AS r FROM res")
def mf_residual_init(spark: SparkSession, d: str) -> DataFrame:
    return mf.residuals(*_mf_state(spark, d)).select("u", "b", F.round("r", 6).alias("r"))


@_query("mf_objective_init", MF + f"SELECT round(((SELECT sum(r * r) FROM res) + {LAMB} * ((SELECT sum(x * x) FROM uf) + (SELECT sum(x * x) FROM bf))) / 2, 4) AS objective")
def mf_objective_init(spark: SparkSession, d: str) -> DataFrame:
    return mf.objective(*_mf_state(spark, d), LAMB).select(F.round("objective", 4).alias("objective"))


@_query("mf_grad_user_step1", MF + "SELECT id, k, round(g, 6) AS g FROM gu")
def mf_grad_user_step1(spark: SparkSession, d: str) -> DataFrame:
    work, gradients = _mf_blocks(spark, d)
    return _long(_side(work.table(gradients, "g"), "u"), "g")


@_query("mf_grad_item_step1", MF + "SELECT id, k, round(g, 6) AS g FROM gb")
def mf_grad_item_step1(spark: SparkSession, d: str) -> DataFrame:
    work, gradients = _mf_blocks(spark, d)
    return _long(_side(work.table(gradients, "g"), "b"), "g")


@_query("mf_objective_step1", MF + f"""SELECT round(((SELECT sum(r * r) FROM (SELECT t.u, t.b, any_value(t.rating) - (SELECT avg(rating) FROM train) - sum((x.x - x.g / {EPS}) * (y.x - y.g / {EPS})) AS r FROM train t JOIN gu x ON x.id = t.u JOIN gb y ON y.id = t.b AND y.k = x.k GROUP BY t.u, t.b))
  + {LAMB} * ((SELECT sum((x - g / {EPS}) * (x - g / {EPS})) FROM gu) + (SELECT sum((x - g / {EPS}) * (x - g / {EPS})) FROM gb))) / 2, 4) AS objective""")
def mf_objective_step1(spark: SparkSession, d: str) -> DataFrame:
    """The line search's polynomial at step 1 / EPS; SQL takes the step and computes the objective anew."""
    work, gradients = _mf_blocks(spark, d)
    c = work.coefficients(gradients)
    s = F.lit(1 / EPS)
    square = F.col("rr") + 2 * s * F.col("ra") + s * s * (F.col("aa") - 2 * F.col("rc")) - 2 * s * s * s * F.col("ac") + s * s * s * s * F.col("cc")
    return c.select(F.round(square / 2 + LAMB / 2 * (F.col("n0") - 2 * s * F.col("n1") + s * s * F.col("n2")), 4).alias("objective"))


@_query("mf_factors_step1", MF + f"SELECT 'u' AS side, id, k, round(x - g / {EPS}, 6) AS x FROM gu UNION ALL SELECT 'b', id, k, round(x - g / {EPS}, 6) FROM gb")
def mf_factors_step1(spark: SparkSession, d: str) -> DataFrame:
    work, gradients = _mf_blocks(spark, d)
    moved = work.table(work.moved(gradients, {(0, 0): 1 / EPS}), "f")
    return moved.select("side", "id", F.posexplode("f").alias("k", "x")).withColumn("x", F.round("x", 6))


@_query("mf_test_errors", _with(RATINGS, SPLIT, TRAIN, FACTORS) + """SELECT round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae FROM (
  SELECT t.u, t.b, any_value(t.rating) - (SELECT avg(rating) FROM train) - coalesce(sum(x.x * y.x), 0) AS e
  FROM split t LEFT JOIN uf x ON x.id = t.u LEFT JOIN bf y ON y.id = t.b AND y.k = x.k WHERE split = 'test' GROUP BY t.u, t.b)""")
def mf_test_errors(spark: SparkSession, d: str) -> DataFrame:
    train, test = _mf_problem(spark, d)
    mean = F.broadcast(train.agg(F.avg("rating").alias("mu")))  # a single row
    rows = test.crossJoin(mean).select(F.lit("r").alias("key"), "u", "b", (F.col("rating") - F.col("mu")).alias("x"))
    found = mf.evaluate(rows, mf.factors_of(train.withColumn("key", F.lit("r")), RANK, 0.5))
    return found.select(F.round("rmse", 6).alias("rmse"), F.round("mae", 6).alias("mae"))


def _mf_problem(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    split = materialize(prep.split_ratings(tables.ratings(spark, d)), "split")
    part = lambda name: split.where(F.col("split") == name).drop("split")
    return part("train"), part("test")


def _as_rows(rows: DataFrame, key: str = "ratings_only") -> DataFrame:
    return rows.select(F.lit(key).alias("key"), "u", "b", F.col("rating").alias("x"))


@_query("mf_train_history")
def mf_train_history(spark: SparkSession, d: str) -> DataFrame:
    train, test = _mf_problem(spark, d)
    return mf.train(_as_rows(train), _as_rows(test), mf.Options(lamb=1.0, iterations=MF_ITERATIONS))[2]


@_query("mf_factors")
def mf_factors(spark: SparkSession, d: str) -> DataFrame:
    users, items, _ = mf.train(_as_rows(_train(spark, d)), None, mf.Options(iterations=MF_ITERATIONS))
    return users.withColumn("side", F.lit("user")).union(items.withColumn("side", F.lit("item")))


@_query("mf_five_splits")
def mf_five_splits(spark: SparkSession, d: str) -> DataFrame:
    every = prep.five_splits(tables.ratings(spark, d))
    bits = lambda name: F.sum(F.when(F.col("split") == name, F.element_at(F.array(*[F.lit(1 << k).cast("long") for k in range(5)]), F.col("split_no"))).otherwise(F.lit(0).cast("long"))).alias(name)
    rows = every.groupBy("u", "b", F.col("rating").alias("x")).agg(bits("train"), bits("test"))
    history = mf.train_splits(rows, 5, mf.Options(iterations=MF_ITERATIONS))
    return history.where("status = 'end'").agg(F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae"), F.count("*").alias("splits"))


@_query("mf_grid")
def mf_grid(spark: SparkSession, d: str) -> DataFrame:
    train, test = _mf_problem(spark, d)
    return mf.grid(train, test, **GRID)


# designs of two graphs' factors

L = 2
N = 2 * L * RANK
WHOLE = f"""parts AS (SELECT side, id, g, k, 0.1::DOUBLE * (1 + ((id * 31 + 17 * k + 13 * g) % 97) / 97.0::DOUBLE) AS x
  FROM (SELECT DISTINCT 'u' AS side, u AS id FROM train UNION ALL SELECT DISTINCT 'b', b FROM train) CROSS JOIN range(0, {L}) a(g) CROSS JOIN range(0, {RANK}) c(k))"""
DESIGN = "design AS (SELECT t.u, t.b, CAST((CASE WHEN side = 'b' THEN {h} ELSE 0 END) + g * {r} + k AS INT) AS n, x, rating AS y FROM train t JOIN parts ON id = CASE WHEN side = 'u' THEN t.u ELSE t.b END)".format(h=L * RANK, r=RANK)


def _representations(train: DataFrame, rank: int = RANK) -> tuple[DataFrame, DataFrame]:
    users, items = (train.select(F.col(c).alias("id")).distinct() for c in "ub")
    factors = lambda ids: [ids.select("id", mf.initial_features(rank, 0.1, 13 * g).alias("features")) for g in range(L)]
    return tuple(features.representation(ids, factors(ids), rank) for ids in (users, items))


def _design(spark: SparkSession, d: str) -> DataFrame:
    train = materialize(_train(spark, d), "train")
    return features.design_train(train, *_representations(train))


def _cells(design: DataFrame) -> DataFrame:
    rows = design.select("u", "b", "y", F.posexplode("x").alias("n", "x"))
    return rows.select("u", "b", "n", F.round("x", 6).alias("x"), "y")


@_query("maxabs_scale_x20", _with(RATINGS, SPLIT, TRAIN, FACTORS) + "SELECT id, k, round(x / max(x) OVER (PARTITION BY k) * 20, 6) AS features FROM bf")
def maxabs_scale_x20(spark: SparkSession, d: str) -> DataFrame:
    return _long(features.max_abs_scale(_side(_mf_state(spark, d)[1], "b").select("id", "features"), RANK), "features")


@_query("design_train_whole", _with(RATINGS, SPLIT, TRAIN, WHOLE, DESIGN) + "SELECT u, b, n, round(x, 6) AS x, y FROM design")
def design_train(spark: SparkSession, d: str) -> DataFrame:
    return _cells(_design(spark, d))


@_query("design_test_whole", _with(RATINGS, SPLIT, TRAIN, WHOLE) + f"""SELECT t.u, t.b, CAST((CASE WHEN s.side = 'b' THEN {L * RANK} ELSE 0 END) + a.g * {RANK} + c.k AS INT) AS n,
  round(coalesce(x, 0.0::DOUBLE), 6) AS x, rating AS y FROM split t CROSS JOIN (VALUES ('u'), ('b')) s(side) CROSS JOIN range(0, {L}) a(g) CROSS JOIN range(0, {RANK}) c(k)
  LEFT JOIN parts p ON p.id = CASE WHEN s.side = 'u' THEN t.u ELSE t.b END AND p.side = s.side AND p.g = a.g AND p.k = c.k WHERE split = 'test'""")
def design_test_whole(spark: SparkSession, d: str) -> DataFrame:
    train, test = _mf_problem(spark, d)
    return _cells(features.design_test(test, *_representations(train), L * RANK))


@_query("design_sparsity_whole", _with(RATINGS, SPLIT, TRAIN, WHOLE, DESIGN) + "SELECT round(avg(CASE WHEN x <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS filled FROM design")
def design_sparsity(spark: SparkSession, d: str) -> DataFrame:
    return metrics.sparsity(_design(spark, d)).select(F.round("filled", 6).alias("filled"))


# factorisation machine, at parameters that SQL can write

FM_RANK = 2
PARAMS = f"""w AS (SELECT CAST(n AS INT) AS n, ((n * 7) % 11 - 5) / 20.0::DOUBLE AS w FROM range(0, {N}) r(n)),
p AS (SELECT CAST(n AS INT) AS n, CAST(f AS INT) AS f, ((n * 5 + f * 3) % 13 - 6) / 20.0::DOUBLE AS p FROM range(0, {N}) r(n) CROSS JOIN range(0, {FM_RANK}) s(f))"""
XP = """xp AS (SELECT u, b, f, sum(x * p) AS s, sum(x * x * p * p) AS q FROM design JOIN p USING (n) GROUP BY u, b, f),
forward AS (SELECT l.u, l.b, l.y, (SELECT avg(rating) FROM train) + l.l + c.c AS pred FROM
  (SELECT u, b, any_value(y) AS y, sum(x * w) AS l FROM design JOIN w USING (n) GROUP BY u, b) l JOIN (SELECT u, b, sum(s * s - q) / 2 AS c FROM xp GROUP BY u, b) c USING (u, b))"""
FM = _with(RATINGS, SPLIT, TRAIN, WHOLE, DESIGN, PARAMS, XP)


def _params(bias: float) -> fm.Params:
    n, f = np.arange(N), np.arange(FM_RANK)
    return fm.Params(bias, ((n * 7) % 11 - 5) / 20, ((n[:, None] * 5 + f * 3) % 13 - 6) / 20)


def _fm_state(spark: SparkSession, d: str) -> tuple[fm.Joined, fm.Params]:
    train = materialize(_train(spark, d), "train")
    users, items = (materialize(r, "representations") for r in _representations(train))
    design = fm.joined(train, None, users, items, FM_RANK)
    return design, _params(design.mean)


@_query("fm_forward_whole", FM + "SELECT u, b, round(pred, 6) AS pred FROM forward")
def fm_forward(spark: SparkSession, d: str) -> DataFrame:
    """As column expressions; the solver's numpy form is tested against it."""
    train = materialize(_train(spark, d), "train")
    q = _params(train.agg(F.avg("rating")).first()[0] or 0.0)
    return fm.predictions(train, *_representations(train), q).select("u", "b", F.round("pred", 6).alias("pred"))


@_query("fm_error_metrics_whole", FM + "SELECT round(sqrt(avg((pred - y) * (pred - y))), 6) AS rmse, round(avg(abs(pred - y)), 6) AS mae FROM forward")
def fm_error_metrics(spark: SparkSession, d: str) -> DataFrame:
    design, q = _fm_state(spark, d)
    errors = fm.sums(design, [q])[0][0][0]
    return spark.createDataFrame([(round(errors.mean_square**0.5, 6), round(errors.absolute / errors.rows, 6))], "rmse double, mae double")


NORMS = f"""norms AS (SELECT CAST(n // {RANK} AS INT) AS g, sqrt(sum(w * w)) AS w_norm FROM w GROUP BY ALL),
pnorms AS (SELECT CAST(n // {RANK} AS INT) AS g, sqrt(sum(p * p)) AS p_norm FROM p GROUP BY ALL)"""
FM_NORMS = _with(RATINGS, SPLIT, TRAIN, WHOLE, DESIGN, PARAMS, XP, NORMS)


@_query("fm_objective_whole", FM_NORMS + "SELECT round((SELECT avg((pred - y) * (pred - y)) FROM forward) + 0.5::DOUBLE * (SELECT sum(w_norm) FROM norms) + 0.25::DOUBLE * (SELECT sum(p_norm) FROM pnorms), 6) AS objective")
def fm_objective(spark: SparkSession, d: str) -> DataFrame:
    design, q = _fm_state(spark, d)
    return spark.createDataFrame([(round(fm.objective(design, q, fm.Options(FM_RANK, RANK, reg_w=0.5, reg_p=0.25)), 6),)], "objective double")


@_query("fm_grad_w_whole", FM + "SELECT n, round(2 * avg((pred - f.y) * x), 6) AS g FROM design JOIN forward f USING (u, b) GROUP BY n")
def fm_grad_w(spark: SparkSession, d: str) -> DataFrame:
    design, q = _fm_state(spark, d)
    [(errors, _)], [g] = fm.sums(design, [q], 1)
    return spark.createDataFrame([(k, round(float(x), 6)) for k, x in enumerate(g[:, 0] * 2 / errors.rows)], "n int, g double")


@_query("fm_grad_p_whole", FM + "SELECT n, f, round(2 * avg((pred - r.y) * (x * s - p * x * x)), 6) AS g FROM design JOIN forward r USING (u, b) JOIN xp USING (u, b) JOIN p USING (n, f) GROUP BY n, f")
def fm_grad_p(spark: SparkSession, d: str) -> DataFrame:
    design, q = _fm_state(spark, d)
    [(errors, _)], [g] = fm.sums(design, [q], 1)
    return spark.createDataFrame([(k, f, round(float(g[k, 1 + f] * 2 / errors.rows), 6)) for k in range(N) for f in range(FM_RANK)], "n int, f int, g double")


@_query("fm_bias_step_whole", FM + "SELECT round((SELECT avg(rating) FROM train) - 0.1::DOUBLE * 2 * avg(pred - y), 6) AS bias FROM forward")
def fm_bias_step(spark: SparkSession, d: str) -> DataFrame:
    design, q = _fm_state(spark, d)
    e = fm.sums(design, [q])[0][0][0]
    return spark.createDataFrame([(round(q.bias - 0.1 * 2 / e.rows * e.total, 6),)], "bias double")


ETA, REG_W, REG_P = 0.05, 0.5, 0.25
FM_STEP = FM_NORMS.rstrip() + f""",
gw AS (SELECT n, any_value(w) - {ETA} * 2 * avg((pred - f.y) * x) AS v FROM design JOIN forward f USING (u, b) JOIN w USING (n) GROUP BY n),
gp AS (SELECT n, f, any_value(p) - {ETA} * 2 * avg((pred - r.y) * (x * s - p * x * x)) AS v FROM design JOIN forward r USING (u, b) JOIN xp USING (u, b) JOIN p USING (n, f) GROUP BY n, f),
lw AS (SELECT n // {RANK} AS g, sqrt(sum(v * v)) AS size FROM gw GROUP BY ALL), lp AS (SELECT n // {RANK} AS g, sqrt(sum(v * v)) AS size FROM gp GROUP BY ALL)
SELECT n, CAST(-1 AS INT) AS f, round(CASE WHEN size > {ETA * REG_W} THEN v * (1 - {ETA * REG_W} / size) ELSE 0 END, 6) AS v FROM gw JOIN lw ON g = n // {RANK}
UNION ALL SELECT n, f, round(CASE WHEN size > {ETA * REG_P} THEN v * (1 - {ETA * REG_P} / size) ELSE 0 END, 6) FROM gp JOIN lp ON g = n // {RANK}"""


@_query("fm_proximal_step_whole", FM_STEP)
def fm_proximal_step(spark: SparkSession, d: str) -> DataFrame:
    """The parameters after a step of size ETA; f is -1 for w."""
    design, q = _fm_state(spark, d)
    (s,) = fm.proximal_steps(design, [q], [ETA], fm.Options(FM_RANK, RANK, reg_w=REG_W, reg_p=REG_P, tries=0))
    if not s.accepted:
        raise ValueError("the step doesn't lower the objective")
    return spark.createDataFrame([(k, f - 1, round(float(s.params.stacked[k, f]), 6) + 0.0) for k in range(N) for f in range(1 + FM_RANK)], "n int, f int, v double")


def _fm_history(solver: str) -> Query:
    def history(spark: SparkSession, d: str) -> DataFrame:
        o = fm.Options(solver=solver, iterations=FM_ITERATIONS)
        train, test = _mf_problem(spark, d)
        users, items = (materialize(r, "representations") for r in _representations(train, o.size))
        design = fm.joined(train, test, users, items, o.rank)
        history = fm.train(design, None, o)[1]
        design.close()
        return history

    return history


for _s, _n in (("PG", "fm_pg_history"), ("mAPG", "fm_mapg_history"), ("nmAPG", "fm_nmapg_history")):
    _query(_n)(_fm_history(_s))


@_query("graph_factors_78")
def graph_factors_78(spark: SparkSession, d: str) -> DataFrame:
    """The factors of the ratings and of all 7 x 11 similarities of the trust path, all relations trained side by side."""
    from tricord import experiment

    trust, train = materialize(tables.trust(spark, d), "trust"), materialize(_train(spark, d), "train")
    relations = materialize(experiment.graph_lists(trust, train, experiment.every_graph()), "relations")
    users, items, _ = mf.train(relations, None, mf.Options(iterations=GRAPH_ITERATIONS))
    return users.withColumn("side", F.lit("user")).union(items.withColumn("side", F.lit("item"))).select(F.col("key").alias("graph"), "side", "id", "features")


@_query("whole_chain")
def whole_chain(spark: SparkSession, d: str) -> DataFrame:
    """Split, trust filter, similarities, factors, joined design and machine in one run: the machine's history."""
    from tricord import experiment

    s = experiment.Settings(meta_graphs=("ratings_only", "UUB_m1_0.5", "UUB_m4_0.5", "UUB_m7_1.0"), mf_iterations=MF_ITERATIONS, max_iters=CHAIN_ITERATIONS)
    return experiment.run(spark, tables.ratings(spark, d), tables.trust(spark, d), s)[1]


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
