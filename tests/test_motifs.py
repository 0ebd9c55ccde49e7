"""Motifs against dense algebra, and their properties."""

import numpy as np
import pytest

from tricord.operators import commuting, features, motifs, prep

MICRO = {"m1": "ab bc ca", "m2": "ab ba bc ca", "m3": "ab ba bc cb ac", "m4": "ab ba bc cb ca ac", "m5": "ab bc ac", "m6": "ab ba ca cb", "m7": "ab ba ac bc"}


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def dense(a):
    b = a * a.T
    u = a - b
    v = u.T
    of = {"U": u, "B": b, "V": v}
    out = {}
    for m, (terms, both) in motifs.TERMS.items():
        c = sum((of[x] @ of[y]) * of[z] for x, y, z in terms.split())
        out[m] = c + c.T if both else c
    return out


@pytest.mark.parametrize("motif", MICRO)
def test_micro_graphs(spark, motif):
    pairs = [(ord(p[0]), ord(p[1])) for p in MICRO[motif].split()]
    rows = motifs.all_motifs(edges(spark, pairs)).collect()
    assert {r["motif"] for r in rows} == {motif} and len(rows) == 6 and {r["w"] for r in rows} == {1}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graph_is_dense_algebra(spark, seed):
    rng = np.random.default_rng(seed)
    a = (rng.random((18, 18)) < 0.3).astype(int)
    np.fill_diagonal(a, 0)
    want = dense(a)
    got = {m: np.zeros_like(a) for m in motifs.MOTIFS}
    for r in motifs.all_motifs(edges(spark, [(int(i), int(j)) for i, j in np.argwhere(a)])).collect():
        got[r["motif"]][r["i"], r["j"]] = r["w"]
    s = ((a + a.T) > 0).astype(int)
    for m in motifs.MOTIFS:
        assert (got[m] == want[m]).all() and (got[m] == got[m].T).all() and not np.diag(got[m]).any()
    assert (sum(got.values()) == (s @ s) * s).all()


def test_duplicates_loops_and_empty(spark):
    rows = [(1, 2), (1, 2), (2, 3), (3, 1), (2, 2)]
    assert motifs.clean_edges(edges(spark, rows)).count() == 3
    assert motifs.all_motifs(motifs.clean_edges(edges(spark, rows))).count() == 6
    assert motifs.all_motifs(edges(spark, [])).count() == 0


def test_names_are_checked(spark):
    e = edges(spark, [(1, 2)])
    with pytest.raises(ValueError):
        motifs.motif_matrix(e, "m8")
    with pytest.raises(ValueError):
        commuting.base_matrix("UBB", e, e)
    with pytest.raises(ValueError):
        commuting.blend(e, e, 11)


def test_top_k_clamps_and_breaks_ties_by_item(spark):
    s = spark.createDataFrame([(1, 5, 10), (1, 3, 10), (1, 4, 20), (1, 9, 0)], "u long, b long, w long")
    assert [(r["b"], r["score"]) for r in commuting.top_k(s, 2).orderBy("rn").collect()] == [(4, 2.0), (3, 1.0)]
    assert commuting.top_k(s, 50).count() == 3


def test_splits_are_exact_and_disjoint(spark):
    r = spark.range(103).selectExpr("id AS u", "id % 7 AS b", "1.0D AS rating")
    rows = prep.split_ratings(r).collect()
    assert sorted(x["split"] for x in rows).count("train") == 82 and [x["split"] for x in rows].count("test") == 10 and len(rows) == 103
    assert prep.split_ratings(r.limit(0)).count() == 0


def test_splits_by_selection_are_those_by_rank(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(prep, "ROUND", 1)
    monkeypatch.setattr(prep, "LAST", 2)
    r = spark.range(907).selectExpr("id % 31 AS u", "id AS b", "1.0D AS rating")
    got = {(x["split_no"], x["u"], x["b"]): x["split"] for x in prep.five_splits(r, [1, 7]).collect()}
    for s in (1, 7):
        order = sorted(((i % 31, i) for i in range(907)), key=lambda k, s=s: hashlib.md5(f"{s}:{k[0]}:{k[1]}".encode()).hexdigest())
        for k, (u, b) in enumerate(order):
            assert got[s, u, b] == ("train" if k < 725 else "test" if k < 725 + 90 else "val")
    # rows that repeat a pair stay together
    one = prep.split_ratings(spark.range(50).selectExpr("1L AS u", "2L AS b", "double(id) AS rating"))
    assert one.count() == 50 and one.select("split").distinct().count() == 1


def test_splits_shuffle_no_rating(spark):
    r = spark.range(100).selectExpr("id AS u", "id AS b", "1.0D AS rating")
    assert "Exchange" not in prep.five_splits(r)._jdf.queryExecution().executedPlan().toString()


def test_dedup_last_and_encoding(spark):
    r = spark.createDataFrame([(1, 1, 1, 5.0), (1, 1, 2, 3.0), (2, 1, 1, 4.0)], "u long, b long, seq int, rating double")
    assert {tuple(x) for x in prep.dedup_last(r, ["u", "b"], ["seq"], "rating").collect()} == {(1, 1, 3.0), (2, 1, 4.0)}
    ids = spark.createDataFrame([(30,), (10,), (20,), (10,)], "id long")
    assert {tuple(x) for x in prep.encode_ids(ids).collect()} == {(10, 0), (20, 1), (30, 2)}


def test_social_filter_drops_edges_without_a_rater(spark):
    trust, train = edges(spark, [(1, 2), (2, 3), (3, 4), (5, 1), (5, 6)]), spark.createDataFrame([(1, 9, 2.0), (1, 8, 1.0), (4, 9, 3.0)], "u long, b long, rating double")
    assert sorted(tuple(r) for r in prep.social_filter(trust, train).collect()) == [(1, 2), (3, 4), (5, 1)]


def test_design_of_test_rows_fills_missing_ids_with_zeros(spark):
    rows = spark.createDataFrame([(1, 7, 5.0), (2, 7, 4.0), (1, 8, 3.0)], "u long, b long, rating double")
    of = lambda k: spark.createDataFrame([(k, [1.0, 2.0])], "id long, features array<double>")
    got = {(r["u"], r["b"]): (r["x"], r["y"]) for r in features.design_test(rows, of(1), of(7), 2).collect()}
    assert got == {(1, 7): ([1, 2, 1, 2], 5), (2, 7): ([0, 0, 1, 2], 4), (1, 8): ([1, 2, 0, 0], 3)}


def test_a_star_of_mutual_edges_is_walked_from_its_leaves(spark):
    """A hub of 50,000 mutual edges and one chord: no pairs of its edges are made by any join."""
    n = 50_000
    leaves = spark.range(1, n + 1)
    star = leaves.selectExpr("0L AS src", "id AS dst").union(leaves.selectExpr("id AS src", "0L AS dst")).union(spark.createDataFrame([(5, 9)], "src long, dst long"))
    df = motifs.motif_matrix(star, "m3")
    assert {tuple(r) for r in df.collect()} == {(i, j, 1) for i in (0, 5, 9) for j in (0, 5, 9) if i != j}
    plan = df._jdf.queryExecution().executedPlan()
    rows = []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            walk(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            walk(node.plan())
        metric = node.metrics().get("numOutputRows")
        if metric.isDefined() and "Join" in name:
            rows.append(metric.get().value())
        children = node.children()
        for k in range(children.size()):
            walk(children.apply(k))

    walk(plan)
    assert rows and sum(rows) < 10**6, rows


def test_heavy_lists_in_parts_are_the_same(spark, monkeypatch):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in {tuple(x) for x in rng.integers(0, 30, (350, 2))} if a != b]
    trust = spark.createDataFrame(edges, "src long, dst long")
    monkeypatch.setattr(motifs, "HEAVY", 3)
    got = {tuple(r) for r in motifs.all_motifs(trust).collect()}
    want = {(m, *r) for m in ("m2", "m3", "m6", "m7") for r in motifs.motif_by_terms(trust, m).collect()}
    assert {r for r in got if r[0] in ("m2", "m3", "m6", "m7")} == {(m, i, j, w) for m, i, j, w in want if w}


def test_no_pair_of_an_edge_and_a_neighbour_is_a_row(spark, monkeypatch):
    """Triangles of one kind of edge: blocks of any size find the same, and no join makes a row for a pair of edges."""
    rng = np.random.default_rng(6)
    trust = spark.createDataFrame([(int(a), int(b)) for a, b in {tuple(x) for x in rng.integers(0, 60, (1400, 2))} if a < b or (a + b) % 3 == 0], "src long, dst long").where("src <> dst")
    want = {(m, *r) for m in ("m1", "m4", "m5") for r in motifs.motif_by_terms(trust, m).collect() if r["w"]}
    for pairs in (motifs.BLOCK_PAIRS, 50):
        monkeypatch.setattr(motifs, "BLOCK_PAIRS", pairs)
        df = motifs.all_motifs(trust, ("m1", "m4", "m5"))
        assert {tuple(r) for r in df.collect()} == want
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "y#" not in "".join(x for x in plan.splitlines() if "HashJoin" in x or "MergeJoin" in x)


def test_common_neighbours_are_looked_up_by_marks(monkeypatch):
    """Lists of uneven lengths, ids close together and far apart, and marks for one list at a time or for all."""
    rng = np.random.default_rng(8)
    for marks, far in ((1, 1), (1 << 25, 1), (40, 10**12)):
        monkeypatch.setattr(motifs, "MARKS", marks)
        near = {v: {int(z) * far: int(rng.integers(0, 2)) for z in rng.choice(50, size=rng.integers(1, 30), replace=False)} for v in rng.permutation(25).tolist()}
        edges = sorted({(int(x), int(y), int(x + y) % 3) for x, y in rng.integers(0, 30, (90, 2)) if x != y})  # some ends have no list
        lists = [[np.array(c) for c in zip(*[(v, len(s)) for v, s in near.items()], strict=True)] + [np.array([z for s in near.values() for z in s]), np.array([t for s in near.values() for t in s.values()], dtype=np.int8)]]
        found = [row for b in motifs._met(lists, [[np.array(c) for c in zip(*edges, strict=True)]], 64) for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        want = [(x, y, z, c, near[x][z], near[y][z]) for x, y, c in edges if x in near and y in near for z in near[x].keys() & near[y].keys()]
        assert sorted(found) == sorted(want) and want


def test_cuts_read_the_rows_twice(spark, monkeypatch):
    """However many digits a cut needs: all rows are read for the first digits, and once more for the rows near the cuts."""
    monkeypatch.setattr(prep, "ROUND", 1)
    monkeypatch.setattr(prep, "LAST", 1)
    read = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = spark.range(600).selectExpr("1 AS split_no", "md5(string(id)) AS _h").mapInArrow(run, "split_no int, _h string")
    [(_, cuts)] = prep.cut_hashes(rows, [0.5, 0.25]).items()
    hashes = sorted(r["_h"] for r in rows.collect())
    assert cuts == [hashes[300], hashes[450]] and read.value == 3 * 600
