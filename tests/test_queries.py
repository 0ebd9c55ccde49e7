"""Every query with SQL against DuckDB, on the smallest tables."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tests.conftest import ROOT, SF
from tricord import queries as core
from tricord.operators import commuting, motifs, prep, sparse
from tricord.sources import tables

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def rows_of(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), sorted([tuple(round(r[k], 5) if isinstance(r[k], float) else r[k] for k in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_same_rows_as_sql(spark, sf, duck, name):
    df = core.queries()[name](spark, sf)
    want = duck.execute(core.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(want.fetchall(), names)


@pytest.mark.parametrize("name", ["mf_train_history", "fm_pg_history", "fm_mapg_history", "fm_nmapg_history"])
def test_objectives_fall(spark, sf, name, monkeypatch):
    monkeypatch.setattr(core, "MF_ITERATIONS", 6)
    monkeypatch.setattr(core, "FM_ITERATIONS", 6)
    rows = core.queries()[name](spark, sf).orderBy("iter").collect()
    values = [r["objective"] for r in rows]
    assert len(values) > 3 and values[-1] < values[0] and all(r["rmse"] > 0 for r in rows)
    if name != "fm_nmapg_history":
        assert values == sorted(values, reverse=True)


def test_blocked_products_are_the_joins(spark, sf, monkeypatch):
    """The dense base as cells, and the blocks' own way with tiny blocks, packs and ranges of items."""
    trust, train = tables.trust(spark, sf), prep.train_of(prep.split_ratings(tables.ratings(spark, sf)))
    base, m4 = commuting.base_matrix("UBUB", trust, train), motifs.motif_matrix(trust, "m4")
    want = sorted(tuple(r) for r in commuting.top_k(commuting.scores(base, m4, train, 5), 7).collect())
    for name, n in (("SUM_BYTES", 40_000), ("ITEMS", 45), ("PACK", 9)):
        monkeypatch.setattr(commuting, name, n)
    assert sorted(tuple(r) for r in commuting.commuting("UBUB", "m4", 5, trust, train, 7).collect()) == want
    found = commuting.sweep(motifs.all_motifs(trust), "UBUB", trust, train, 7).where("motif = 'm4' AND alpha_step = 5").drop("motif", "alpha_step")
    assert sorted(tuple(r) for r in found.collect()) == want


def test_lists_travel_as_often_as_the_terms_need_them(spark, monkeypatch):
    """Eight copies of the tables with other ids take about eight times the rows, not the square; items that all rate are summed once."""
    monkeypatch.setattr(commuting, "ITEMS", 400)
    users = spark.range(40).select(F.col("id").alias("u"))
    items = spark.range(60).select(F.col("id").alias("b"))
    train = users.crossJoin(items).where((F.col("b") < 3) | (F.pmod(F.xxhash64("u", "b"), F.lit(9)) == 0))
    trust = users.crossJoin(users.select(F.col("u").alias("dst"))).where((F.col("u") != F.col("dst")) & (F.pmod(F.xxhash64("u", "dst"), F.lit(4)) == 0)).select(F.col("u").alias("src"), "dst")
    weights = commuting.layer_of(commuting.base_matrix("UUB", trust, train), 0)
    times = spark.range(8).select((F.col("id") * 1000).alias("x"))
    move = lambda df, *c: df.crossJoin(times).select(*[(F.col(k) + F.col("x")).alias(k) if k in c else F.col(k) for k in df.columns])
    for co_rated in (False, True):
        rows = lambda t, w: commuting.dealt(t, w, co_rated).agg(F.count("*"), F.sum(F.size("items"))).first()  # noqa: B023, E731
        one, eight = rows(train, weights), rows(move(train, "u", "b"), move(weights, "i", "j"))
        assert all(y <= 12 * x for x, y in zip(one, eight, strict=True))
    found = commuting.product_top_k(train, weights, {"a": {0: 3}}, 1, 20, True).select("u", "b", (F.col("w") / 3).cast("long").alias("w"), "rn")
    both = commuting.add(commuting.base_matrix("UBUB", trust, train), weights.drop("layer"))
    scored = commuting.multiply(both, commuting.relation(train)).select(F.col("i").alias("u"), F.col("j").alias("b"), "w")
    want = commuting.top_k(scored, 20).select("u", "b", (F.col("score") * 10).cast("long").alias("w"), "rn")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_lists_of_a_user_take_one_shuffle(spark, monkeypatch):
    """Repeated pairs count once, and a user's items are gathered in the shuffle that brings them together."""
    plans = []
    kept = commuting.materialize

    def watched(df, name):
        if name == "rows":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, name)

    monkeypatch.setattr(commuting, "materialize", watched)
    train = spark.range(600).selectExpr("id % 20 AS u", "id % 30 AS b")
    trust = spark.range(20).selectExpr("0 AS layer", "id AS i", "(id + 1) % 20 AS j", "1L AS w")
    found = commuting.product_top_k(train, trust, {"a": {0: 1}}, 1, 50).collect()
    want = {((u - 1) % 20, b) for u, b in {(k % 20, k % 30) for k in range(600)}}
    assert {(r["u"], r["b"]) for r in found} == want and len(found) == len(want) and {r["w"] for r in found} == {1}
    assert [p.count("Exchange ") for p in plans] == [1]


@pytest.mark.parametrize("at_once", [1, 7, 1 << 20])
def test_products_are_made_row_by_row_and_are_the_joins(spark, monkeypatch, at_once):
    """Rows cut at any term, weights of both signs and past 53 bits; no plan has a row for a term, so nothing is summed after a shuffle."""
    monkeypatch.setattr(sparse, "AT_ONCE", at_once)
    monkeypatch.setattr(sparse, "BLOCK_TERMS", 20)
    cell = lambda n, p, q: spark.range(n).select((F.col("id") % p).alias("i"), F.pmod(F.xxhash64("id"), F.lit(q)).alias("j"), (F.col("id") % 7 - 3).alias("w")).groupBy("i", "j").agg(F.sum("w").alias("w"))
    big = spark.createDataFrame([(100, 1, 2**55 + 1), (100, 2, -1), (101, 77, 1)], "i long, j long, w long")
    x, y = cell(60, 9, 12).union(big), cell(80, 12, 10)
    made = sparse.multiply(x, y)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, sparse.joined_multiply(x, y).collect()))
    assert "HashAggregate" not in made._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    assert sparse.multiply(x.limit(0), y).count() == 0 and sparse.multiply(x, y.limit(0)).count() == 0
    half = x.limit(5).withColumn("w", F.lit(0.5))
    assert sorted(map(tuple, sparse.multiply(half, y).collect())) == sorted(map(tuple, sparse.joined_multiply(half, y).collect()))


def test_queries_leave_no_id_out(spark, sf):
    run = lambda name: core.queries()[name](spark, sf)
    assert run("design_sparsity_whole").first()["filled"] == 1.0
    raters = {r["u"] for r in run("train_pairs").collect()}
    kept = {(r["src"], r["dst"]) for r in run("social_filter_either_whole").collect()}
    assert kept == {(r["src"], r["dst"]) for r in run("trust_edges").collect() if {r["src"], r["dst"]} & raters}


def test_solvers_run_to_their_own_limits(spark, sf, monkeypatch):
    class Called(Exception):
        pass

    def stop(*args, **more):
        raise Called(args, more)

    for name in ("train", "train_splits", "grid"):
        monkeypatch.setattr(core.mf, name, stop)
    monkeypatch.setattr(core.fm, "train", stop)

    def given(name):
        with pytest.raises(Called) as found:
            core.queries()[name](spark, sf)
        return found.value.args

    # the operators' own settings but for the number of iterations, which README gives
    assert given("mf_train_history")[0][2] == core.mf.Options(lamb=1.0, iterations=core.MF_ITERATIONS)
    assert given("mf_factors")[0][2] == core.mf.Options(iterations=core.MF_ITERATIONS)
    assert given("mf_five_splits")[0][2] == core.mf.Options(iterations=core.MF_ITERATIONS)
    assert given("mf_grid")[1] == core.GRID
    for name, solver in (("fm_pg_history", "PG"), ("fm_mapg_history", "mAPG"), ("fm_nmapg_history", "nmAPG")):
        (design, _, o), _ = given(name)
        assert o == core.fm.Options(solver=solver, iterations=core.FM_ITERATIONS)
        (errors, held), = core.fm.sums(design, [core.fm.start(design, o)])[0]
        split = {r["split"]: r["n"] for r in core.queries()["split_80_10_10"](spark, sf).groupBy("split").agg(F.count("*").alias("n")).collect()}
        assert (errors.rows, held.rows) == (split["train"], split["test"])


def test_entry_without_the_training_data_operators(tmp_path):
    for name in ("__spark_entry__.py", "tricord"):
        source = Path(ROOT) / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    count = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    run = lambda: subprocess.run([sys.executable, "-c", count], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    shutil.rmtree(tmp_path / "tricord" / "llm", ignore_errors=True)
    assert run().stdout.split() == [str(len(core.queries())), str(len(core.oracle_sql()))]
    # a broken module is an error, not a shorter list
    (tmp_path / "corpus_pipeline.py").write_text("")
    (tmp_path / "tricord" / "llm").mkdir()
    (tmp_path / "tricord" / "llm" / "__init__.py").write_text("")
    (tmp_path / "tricord" / "llm" / "queries.py").write_text("import tricord.llm.nothing")
    assert run().returncode != 0


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_grid_is_whole():
    """All points of the search, each with as many iterations as a single factorisation may take."""
    assert [len(core.GRID[k]) for k in ("ranks", "epsilons", "lambdas")] == [5, 6, 6]
    assert core.GRID["iterations"] == core.mf.Options().iterations == 500
