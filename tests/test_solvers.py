"""Solvers against plain numpy and finite differences."""

import itertools
import os
from pathlib import Path

import numpy as np
import pytest

from tricord import experiment
from tricord.functions import metrics
from tricord.operators import blocks, features, fm, mf, prep, resident
from tricord.plans import states, storage
from tricord.sources import matlab, tables


def dense_mf(x, mask, u, v, mu, lamb, eps, iterations):
    objs = []
    f = lambda u, v: 0.5 * ((mask * (x - mu - u @ v.T)) ** 2).sum() + lamb / 2 * ((u**2).sum() + (v**2).sum())
    for _ in range(iterations):
        now = f(u, v)
        objs.append(now)
        r = mask * (x - mu - u @ v.T)
        du, dv = lamb * u - r @ v, lamb * v - r.T @ u
        for _ in range(20):
            nu, nv = u - du / eps, v - dv / eps
            if f(nu, nv) < now:
                u, v, eps = nu, nv, eps * 0.95
                break
            eps *= 1.5
    return u, objs


def test_mf_is_the_dense_algorithm_for_every_key(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for key in ("a", "b"):
        mask = rng.random((6, 5)) < 0.7
        mask[:, 0] = mask[0] = True
        x = rng.integers(1, 6, (6, 5)).astype(float)
        rows += [(key, int(i), int(j), float(x[i, j])) for i, j in np.argwhere(mask)]
        init = lambda n: np.array([[1e-4 * (1 + (i * 31 + 17 * k) % 97 / 97) for k in range(2)] for i in range(n)])
        want[key] = dense_mf(x, mask, init(6), init(5), x[mask].mean(), 0.1, 1.0, 4)
    df = spark.createDataFrame(rows, "key string, u long, b long, x double")
    users, items, history = mf.train(df, df, mf.Options(rank=2, eps=1.0, lamb=0.1, iterations=4))
    for key in want:
        got = np.array([r["features"] for r in users.where(f"key = '{key}'").orderBy("id").collect()])
        assert np.allclose(got, want[key][0], rtol=1e-9)
        objs = [r["objective"] for r in history.where(f"key = '{key}' AND status = 'ok'").orderBy("iter").collect()]
        assert np.allclose(objs, want[key][1])
    assert history.where("status = 'end' AND rmse IS NOT NULL").count() == 2


def test_shared_rows_are_problems_of_their_own(spark, monkeypatch):
    """Problems on the same rows, of several ranks and with parts of the rows, in many small parts."""
    monkeypatch.setattr(blocks, "PART_ROWS", 7)
    monkeypatch.setattr(blocks, "HOME_BYTES", 300)
    rng = np.random.default_rng(8)
    cells = [(i, j, float(rng.integers(1, 6)), int(rng.integers(1, 4)), int(rng.integers(0, 4))) for i in range(9) for j in range(7) if j == 0 or i == 0 or rng.random() < 0.6]
    rows = spark.createDataFrame(cells, "u long, b long, x double, train long, test long")
    problems = [mf.Problem(0, "a", mf.Options(2, 1.0, 0.1, 5), 0), mf.Problem(0, "b", mf.Options(3, 2.0, 0.5, 3), 1), mf.Problem(0, "c", mf.Options(2, 5.0, 0.0, 4), 0)]
    work = mf.shared(rows, problems)
    assert work.layout.parts.count() > 6 and work.layout.homes.count() > 4
    state, history = work.train()
    got, history = work.table(state, "f").collect(), history.collect()
    work.close()
    for p in problems:
        one = lambda k, p=p: spark.createDataFrame([("k", u, b, x) for u, b, x, *f in cells if f[k] >> p.bit & 1], "key string, u long, b long, x double")
        users, items, alone = mf.train(one(0), one(1), p.options)
        for side, table in (("u", users), ("b", items)):
            want = {r["id"]: r["features"] for r in table.collect()}
            found = {r["id"]: r["f"] for r in got if r["key"] == p.key and r["side"] == side}
            assert all(np.allclose(found[i], want[i], rtol=1e-9, atol=1e-13) for i in want)
        of = lambda rs: sorted((r["iter"], r["objective"], r["rmse"], r["mae"], r["tries"]) for r in rs)
        assert np.allclose(of(alone.collect()), of(r for r in history if r["key"] == p.key))


def test_no_rating_is_shuffled_in_an_iteration(spark):
    rows = spark.range(300).selectExpr("'k' AS key", "id % 17 AS u", "id AS b", "double(id % 5) AS x")
    work = mf.grouped(rows, rows, mf.Options(rank=2))
    gradients = work.gradient(work.start())
    assert blocks.PART_ROWS > 300
    for step in (gradients, work.coefficients(gradients)):
        step.collect()
        plan = step._jdf.queryExecution().executedPlan().toString()
        left = plan.split("FlatMapCoGroupsInArrow")[1].split("\n")[1]  # what the ratings' side comes from
        assert "InMemoryTableScan" in left or "TableCacheQueryStage" in left, left
    work.close()


def test_an_id_is_sent_to_the_parts_that_have_it_and_to_no_other(spark, monkeypatch):
    """Twenty relations that share no id: parts grow in number with them, what is sent only with ids."""
    monkeypatch.setattr(blocks, "PART_ROWS", 12)
    monkeypatch.setattr(blocks, "HOME_BYTES", 160)
    rows = spark.createDataFrame([("k", 3 * c + i, 4 * c + j, 1.0) for c in range(20) for i in range(3) for j in range(4)], "key string, u long, b long, x double")
    work = mf.grouped(rows, rows.selectExpr("key", "u + 1000 AS u", "b", "x"), mf.Options(rank=2))
    held = {(r["part"], s, int(i)) for r in work.layout.parts.collect() for s in "ub" for i in set(np.frombuffer(r[s], "<i4").tolist())}
    routes = [r for h in work.layout.routing.collect() for r in h["routes"]]
    sent = sum(len(blocks.unsqueezed(r["places"])) for r in routes)
    assert work.layout.parts.count() >= 20 and work.layout.homes.count() >= 10
    assert 140 <= sent <= len(held) - 60  # the test rows' 60 users are in parts, but nothing is known of them
    assert sent <= 4 * 140
    work.close()


def test_a_grid_of_any_size_holds_a_few_points_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(u, b, float(rng.integers(1, 6))) for u in range(9) for b in range(7) if u == b or rng.random() < 0.6], "u long, b long, rating double")
    run = lambda: [tuple(r) for r in mf.grid(rows, rows.limit(20), (2, 3), (1.0, 5.0), (0.1,), 2).collect()]
    want, widths, start = run(), [], mf.Factorisation.start
    monkeypatch.setattr(mf, "GRID_DOUBLES", 5)
    monkeypatch.setattr(mf.Factorisation, "start", lambda self, *a: widths.append(sum(sum(x["ranks"]) for x in self.specs.values())) or start(self, *a))
    got = run()
    assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3:] for r in got], [r[3:] for r in want])
    assert len(widths) > 1 and max(widths) <= 5 and sum(widths) == 10


def test_mf_takes_no_rows(spark):
    empty = spark.createDataFrame([], "key string, u long, b long, x double")
    users, _, history = mf.train(empty, None, mf.Options(rank=2, iterations=2))
    assert users.count() == 0 and history.count() == 0


@pytest.fixture(scope="module")
def problem():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 6))
    y = x[:, 0] - 0.5 * x[:, 1] * x[:, 2] + 3
    return x, y


def design_of(spark, x, y):
    return spark.createDataFrame([([float(v) for v in row], float(t)) for row, t in zip(x, y)], "x array<double>, y double")


def test_fm_forward_is_the_pairwise_sum(problem):
    x, _ = problem
    rng = np.random.default_rng(1)
    q = fm.Params(0.3, rng.normal(size=6), rng.normal(size=(6, 3)))
    want = [0.3 + r @ q.w + sum(q.p[i] @ q.p[j] * r[i] * r[j] for i, j in itertools.combinations(range(6), 2)) for r in x]
    assert np.allclose(fm.predict(x, q), want)


def test_fm_gradient_is_that_of_finite_differences(spark, problem):
    x, y = problem
    rng = np.random.default_rng(2)
    q = fm.Params(0.1, rng.normal(size=6), rng.normal(size=(6, 2)))
    [(errors, held)], [g] = fm.sums(fm.packed(design_of(spark, x, y)), [q], 1)
    assert (errors.rows, held.rows) == (40, 0)
    loss = lambda a: ((fm.predict(x, q.moved(a)) - y) ** 2).mean()
    a = q.stacked
    for i, j in ((0, 0), (3, 1), (5, 2)):
        d = np.zeros_like(a)
        d[i, j] = 1e-6
        assert abs((loss(a + d) - loss(a - d)) / 2e-6 - g[i, j] * 2 / errors.rows) < 1e-4


@pytest.mark.parametrize("solver", ["PG", "mAPG", "nmAPG"])
def test_fm_solvers_lower_the_objective(spark, problem, solver):
    d = design_of(spark, *problem)
    o = fm.Options(rank=2, size=3, initial=0.1, reg_w=0.01, reg_p=0.01, iterations=4, tries=30, eta=0.1, bias_eta=0.01, solver=solver)
    q, history = fm.train(d, d, o)
    values = [r["objective"] for r in history.orderBy("iter").collect()]
    assert values[-1] < values[0] and q.w.shape == (6,)


def dense_fm(x, y, bias, w, p, o, solver):
    """The published algorithms on whole matrices, one trial of a step size at a time: objectives and parameters."""
    def loss(bias, a):
        s = x @ a[:, 1:]
        return bias + x @ a[:, 0] + 0.5 * ((s**2).sum(axis=1) - ((x**2) @ (a[:, 1:] ** 2)).sum(axis=1)) - y

    def group(v):
        return sum(np.linalg.norm(v[i : i + o.size]) for i in range(0, len(v), o.size))

    def full(bias, a):
        return (loss(bias, a) ** 2).mean() + o.reg_w * group(a[:, 0]) + o.reg_p * group(a[:, 1:])

    def slope(bias, a):
        e = loss(bias, a)
        g = np.zeros_like(a)
        for i in range(len(x)):
            g[:, 0] += e[i] * x[i]
            for f in range(1, a.shape[1]):
                g[:, f] += e[i] * (x[i] * (x[i] @ a[:, f]) - x[i] ** 2 * a[:, f])
        return g * 2 / len(x)

    def shorten(v, eta):
        out = v.copy()
        for i in range(0, len(v), o.size):
            n = np.linalg.norm(v[i : i + o.size])
            out[i : i + o.size] *= max(0.0, 1 - eta / n) if n > 0 else 0
        return out

    def step(bias, a, eta):
        now, g = full(bias, a), slope(bias, a)
        for _ in range(o.tries + 1):
            new = np.column_stack((shorten(a[:, 0] - eta * g[:, 0], eta * o.reg_w), shorten(a[:, 1:] - eta * g[:, 1:], eta * o.reg_p)))
            if full(bias, new) < now:
                return full(bias, new), new, eta * 1.1
            eta *= 0.7
        return now, a, eta

    x0 = x1 = z = np.column_stack((w, p))
    t0, t1, eta, eta2 = 0.0, 1.0, o.eta, o.eta
    c, q = full(bias, x1), 1.0
    values = [c]
    for _ in range(o.iterations):
        if solver == "PG":
            value, x1, eta = step(bias, x1, eta)
            values.append(value)
            continue
        if solver == "nmAPG":
            bias -= o.bias_eta * 2 * loss(bias, x1).mean()
        ahead = x1 + t0 / t1 * (z - x1) + (t0 - 1) / t1 * (x1 - x0)
        fz, z, eta_z = step(bias, ahead, eta)
        if solver == "mAPG":
            fv, v, eta_v = step(bias, x1, eta)
            value, new, eta = (fz, z, eta_z) if fz < fv else (fv, v, eta_v)
        else:
            eta, value, new = eta_z, fz, z
            if not fz < c:
                fv, v, eta2 = step(bias, x1, eta2)
                if fv <= fz:
                    value, new = fv, v
            q, q_before = 0.5 * q + 1, q
            c = (0.5 * q_before * c + value) / q
        x0, x1 = x1, new
        t0, t1 = t1, (np.sqrt(4 * t1**2 + 1) + 1) / 2
        values.append(value)
    return values, bias, x1


@pytest.mark.parametrize("solver", ["PG", "mAPG", "nmAPG"])
def test_fm_is_the_published_algorithm(spark, problem, solver):
    x, y = problem
    rng = np.random.default_rng(9)
    w, p = rng.normal(size=6) * 0.1, rng.normal(size=(6, 2)) * 0.1
    o = fm.Options(rank=2, size=3, reg_w=0.02, reg_p=0.03, iterations=12, tries=30, eps=0.0, eta=0.5, bias_eta=0.05, solver=solver)
    d = design_of(spark, x, y)
    q, history = fm.train(d.repartition(3), d.limit(7), o, fm.Params(2.5, w, p))
    values, bias, a = dense_fm(x, y, 2.5, w, p, o, solver)
    rows = history.orderBy("iter").collect()
    assert np.allclose([r["objective"] for r in rows], values, rtol=1e-9) and np.allclose(q.stacked, a, rtol=1e-7) and abs(q.bias - bias) < 1e-9
    e = fm.predict(x[:7], q) - y[:7]
    assert abs(rows[-1]["rmse"] - np.sqrt((e**2).mean())) < 1e-9 and abs(rows[-1]["mae"] - np.abs(e).mean()) < 1e-9


def test_fm_literal_momentum_takes_plain_steps(spark, problem):
    o = fm.Options(rank=2, size=3, initial=0.1, reg_w=0.01, reg_p=0.01, iterations=4, tries=30, eta=0.1)
    d = design_of(spark, *problem)
    found = [[r["objective"] for r in fm.train(d, None, fm.replace(o, solver=s, literal_momentum=s == "mAPG"))[1].orderBy("iter").collect()] for s in ("mAPG", "PG")]
    assert len(found[0]) == 5 and np.allclose(found[0][:2], found[1][:2])


def test_fm_large_penalty_leaves_the_mean(spark, problem):
    d = design_of(spark, *problem)
    q, _ = fm.train(d, None, fm.Options(rank=2, size=3, reg_w=1e6, reg_p=1e6, iterations=2, eta=0.1, solver="PG"))
    assert not q.w.any() and not q.p.any() and abs(q.bias - problem[1].mean()) < 1e-9


def test_fm_refuses_what_it_can_not_do(spark, problem):
    with pytest.raises(ValueError):
        fm.train(design_of(spark, *problem), None, fm.Options(solver="SGD"))
    with pytest.raises(ValueError):
        fm.train(design_of(spark, problem[0][:0], problem[1][:0]), None, fm.Options())


def test_prox_zeroes_small_groups():
    a = np.array([0.1, 0.1, 3.0, 4.0])
    assert np.allclose(fm.prox(a, 1.0, 2), [0, 0, 3 * 0.8, 4 * 0.8])


@pytest.mark.parametrize("solver", ["PG", "mAPG", "nmAPG"])
def test_joined_design_is_the_made_one(spark, solver, monkeypatch):
    monkeypatch.setattr(blocks, "PART_ROWS", 20)
    monkeypatch.setattr(blocks, "HOME_BYTES", 1500)
    rng = np.random.default_rng(9)
    reps = [spark.createDataFrame([(i, [float(x) for x in rng.normal(size=6)]) for i in range(n)], "id long, features array<double>") for n in (11, 8)]
    rows = spark.createDataFrame([(u, b, float(rng.integers(1, 6))) for u in range(11) for b in range(8) if rng.random() < 0.8], "u long, b long, rating double")
    held = spark.createDataFrame([(1, 2, 3.0), (99, 2, 4.0), (1, 99, 2.0), (98, 99, 1.0)], "u long, b long, rating double")
    o = fm.Options(rank=2, size=3, initial=0.1, reg_w=0.01, reg_p=0.01, iterations=6, tries=30, eta=0.1, bias_eta=0.01, solver=solver)
    design = fm.joined(rows, held, *reps, rank=2)
    q, history = fm.train(design, None, o)
    want, made = fm.train(features.design_train(rows, *reps), features.design_test(held, *reps, 6), o)
    assert np.allclose(q.stacked, want.stacked) and np.isclose(q.bias, want.bias)
    of = lambda h: [(r["iter"], r["objective"], r["rmse"], r["mae"], r["step"], r["tries"]) for r in h.orderBy("iter").collect()]
    assert np.allclose(of(history), of(made))
    pred = {(r["u"], r["b"]): r["pred"] for r in fm.predictions(rows.union(held), *reps, q).collect()}
    x = np.array([r["x"] for r in features.design_test(held, *reps, 6).orderBy("u", "b").collect()])
    assert np.allclose([pred[k] for k in ((1, 2), (1, 99), (98, 99), (99, 2))], fm.predict(x, q))
    design.close()


def test_joined_design_refuses_unknown_training_ids(spark):
    reps = spark.createDataFrame([(1, [1.0, 2.0])], "id long, features array<double>")
    rows = spark.createDataFrame([(1, 1, 4.0), (2, 1, 5.0)], "u long, b long, rating double")
    with pytest.raises(Exception, match="no representation"):
        fm.train(fm.joined(rows, None, reps, reps), None, fm.Options(rank=1, size=2, iterations=1))


def test_design_train_refuses_unknown_ids_and_test_fills_zeros(spark):
    reps = spark.createDataFrame([(1, [1.0, 2.0])], "id long, features array<double>")
    r = spark.createDataFrame([(1, 1, 4.0), (2, 1, 5.0)], "u long, b long, rating double")
    with pytest.raises(Exception, match="no representation"):
        features.design_train(r, reps, reps).collect()
    got = {x["u"]: x["x"] for x in features.design_test(r, reps, reps, 2).collect()}
    assert got == {1: [1.0, 2.0, 1.0, 2.0], 2: [0.0, 0.0, 1.0, 2.0]}


def test_design_texts_round_trip(spark, tmp_path):
    d = tables.random_design(spark, 50, 4, seed=3)
    rows = [tuple(r) for r in d.collect()]
    assert len(rows) == 50 and all(len(x) == 4 and 0 <= y <= 1 for x, y in rows)
    tables.write_design(d, str(tmp_path / "X"), str(tmp_path / "Y"))
    assert sorted(tuple(r) for r in tables.read_design(spark, str(tmp_path / "X"), str(tmp_path / "Y")).collect()) == sorted(rows)
    (tmp_path / "X1").write_text("1 2\n\n3 4\n5\n")
    (tmp_path / "Y1").write_text("1\n2\n3\n")
    with pytest.raises(Exception, match="line 2"):
        tables.read_design(spark, str(tmp_path / "X1"), str(tmp_path / "Y1")).collect()


def test_synthetic_experiment_from_the_command_line(spark, tmp_path, capsys):
    for name, seed in (("train", 1), ("test", 2)):
        d = tables.random_design(spark, 60, 8, seed)
        tables.write_design(d, f"{tmp_path}/{name}_X", f"{tmp_path}/{name}_Y")
    (tmp_path / "s.yaml").write_text(f"dt: synthetic\ndata_dir: {tmp_path}/\ntrain_X: train_X\ntrain_Y: train_Y\ntest_X: test_X\ntest_Y: test_Y\nF: 4\nK: 2\nmax_iters: 3\neta: 0.01\nln: 20\n")
    experiment.main([str(tmp_path / "s.yaml"), "-reg", "0.1"])
    assert "synthetic" in capsys.readouterr().out


def test_baseline(spark, sf):
    r = mf.baseline(tables.ratings(spark, sf), mf.Options(rank=3, eps=500.0, lamb=1.0, iterations=3)).first()
    assert 0 < r["mae"] <= r["rmse"] < 3


def test_relative_decrease_and_last_average(spark):
    h = spark.createDataFrame([("a", 0, 10.0, 4.0, 2.0), ("a", 1, 8.0, 3.0, 1.0), ("a", 2, 6.0, 1.0, 0.5), ("b", 0, 1.0, 9.0, 9.0)], "key string, iter int, objective double, rmse double, mae double")
    got = {(r["key"], r["iter"]): r["decrease"] for r in metrics.relative_decrease(h, ("key",)).collect()}
    assert got == {("a", 0): None, ("a", 1): 0.2, ("a", 2): 0.25, ("b", 0): None}
    assert tuple(metrics.last_average(h.where("key = 'a'"), 2).first()) == (2.0, 0.75)


def test_factor_and_parameter_sinks(spark, tmp_path):
    f = spark.createDataFrame([(1, "g", 2, [1.0, 2.0]), (2, "h", 2, [3.0, 4.0])], "id long, graph string, rank int, features array<double>")
    tables.write_factors(f, str(tmp_path / "f"))
    back = spark.read.parquet(str(tmp_path / "f"))
    assert {(r["id"], r["graph"], r["rank"], tuple(r["features"])) for r in back.collect()} == {(1, "g", 2, (1.0, 2.0)), (2, "h", 2, (3.0, 4.0))}
    tables.write_parameters(spark, [0.5, 0.25], [[1.0, 2.0], [3.0, 4.0]], 3.5, str(tmp_path / "p"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "p")).orderBy("feature").collect()] == [(-1, 3.5, []), (0, 0.5, [1.0, 2.0]), (1, 0.25, [3.0, 4.0])]
    (tmp_path / "text").write_text("7\t0.5\t1.5\n")
    assert [tuple(r) for r in tables.read_factors(spark, str(tmp_path / "text"), 2).collect()] == [(7, [0.5, 1.5])]


def mat5(order, matrices, compressed):
    """A MATLAB file of (name, class, type number, numpy type, array) by its published format."""
    import struct
    import zlib

    def element(kind, data, small=True):
        if small and len(data) <= 4:
            return struct.pack(order + "I", len(data) << 16 | kind) + data.ljust(4, b"\0")
        return struct.pack(order + "II", kind, len(data)) + data + b"\0" * (-len(data) % 8)

    out = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack(order + "H", 0x0100) + (b"IM" if order == "<" else b"MI")
    for name, group, kind, number, a in matrices:
        body = element(6, struct.pack(order + "II", group, 0)) + element(5, struct.pack(f"{order}{a.ndim}i", *a.shape)) + element(1, name.encode())
        whole = element(14, body + element(kind, a.T.astype(order + number).tobytes()), False)
        if compressed:
            z = zlib.compress(whole)
            whole = struct.pack(order + "II", 15, len(z)) + z
        out += whole
    return out


@pytest.mark.parametrize("compressed", [True, False])
@pytest.mark.parametrize("order", ["<", ">"])
def test_matlab_source(spark, tmp_path, order, compressed, monkeypatch):
    monkeypatch.setattr(matlab, "PIECE", 128)
    rng = np.random.default_rng(1)
    rating, trust = rng.integers(0, 200, (1000, 5)), np.array([[1, 2], [3, 4]])
    path = tmp_path / "m.mat"
    path.write_bytes(mat5(order, [("x", 6, 9, "f8", rng.random((70, 3))), ("trustnetwork", 6, 2, "u1", trust), ("rating", 6, 4, "u2", rating), ("cube", 6, 9, "f8", rng.random((2, 2, 2)))], compressed))
    found = matlab.read_matrix(spark, str(path), "rating", "u long, b long, c int, rating double", rows=300)
    assert [tuple(r) for r in found.collect()] == [(*map(int, r[:3]), float(r[3])) for r in rating] and found.rdd.getNumPartitions() == 4
    m = matlab.find(f"file://{path}", "rating")
    pieces = [np.column_stack(p) for p in matlab.columns(f"file://{path}", m, 5, 10, 900)]
    assert len(pieces) > 10 and np.array_equal(np.vstack(pieces), rating[10:910])
    assert [tuple(r) for r in matlab.read_matrix(spark, f"file://{path}", "trustnetwork", "src long, dst long").collect()] == [(1, 2), (3, 4)]
    for name, schema, message in (("other", "a long", "no matrix"), ("cube", "a long", "full matrix"), ("trustnetwork", "a long, b long, c long", "columns")):
        with pytest.raises(Exception, match=message):
            matlab.read_matrix(spark, str(path), name, schema).collect()
    path.write_bytes(path.read_bytes()[:-40])
    with pytest.raises(Exception):
        matlab.read_matrix(spark, str(path), "cube", "a long").collect()


def test_every_graph_in_one_sweep(spark, sf):
    trust, train = tables.trust(spark, sf), prep.train_of(prep.split_ratings(tables.ratings(spark, sf)))
    graphs = experiment.every_graph()
    relations = experiment.graph_relations(trust, train, graphs, k=5)
    found = {r["key"] for r in relations.select("key").distinct().collect()}
    # a motif without triangles has no similarities at the end where only it counts
    assert "ratings_only" in found and {g for g in graphs if not g.endswith("_1.0")} <= found | {"ratings_only"}
    users, items, history = mf.train(relations, None, mf.Options(rank=2, iterations=1))
    assert {r["key"] for r in users.select("key").distinct().collect()} == found == {r["key"] for r in history.collect()}


def test_similarities_in_lists_give_the_factors_of_their_rows(spark, sf, monkeypatch):
    monkeypatch.setattr(experiment, "LIST", 8)
    monkeypatch.setattr(blocks, "PART_ROWS", 200)
    trust, train = tables.trust(spark, sf), prep.train_of(prep.split_ratings(tables.ratings(spark, sf)))
    train = storage.materialize(train.unionByName(train.limit(20).selectExpr("u", "b", "rating + 1 AS rating")), "train")  # pairs that repeat
    graphs = ("ratings_only", "UUB_m1_0.5", "UUB_m5_0.5")
    lists = storage.materialize(experiment.graph_lists(trust, train, graphs, k=30), "lists")
    n, longest = lists.where("key = 'ratings_only'").selectExpr("sum(size(b))", "max(size(b))").first()
    assert n == train.select("u", "b").distinct().count() and longest < 40
    assert lists.where("key <> 'ratings_only'").count() == lists.where("key <> 'ratings_only'").select("key", "u").distinct().count()
    rows = storage.materialize(experiment.graph_relations(trust, train, graphs, k=30), "rows")
    assert rows.count() == rows.select("key", "u", "b").distinct().count() == lists.selectExpr("sum(size(b))").first()[0]
    found = []
    for relations in (lists, rows):
        users, items, history = mf.train(relations, None, mf.Options(rank=2, iterations=2))
        factors = {(r["key"], side, r["id"]): r["features"] for side, t in (("u", users), ("b", items)) for r in t.collect()}
        found.append((factors, sorted((r["key"], r["iter"], r["objective"]) for r in history.collect())))
    (a, h), (b, g) = found
    assert a.keys() == b.keys() and np.allclose([a[k] for k in sorted(a)], [b[k] for k in sorted(a)], rtol=1e-9)
    assert [x[:2] for x in h] == [x[:2] for x in g] and np.allclose([x[2] for x in h], [x[2] for x in g], rtol=1e-9)
    with pytest.raises(ValueError, match="lists"):
        mf.train(lists, rows, mf.Options(rank=2, iterations=1))


class Lost(Exception):
    pass


def lost_after(states_class, monkeypatch, n):
    """A run whose driver is lost right after it has written its n-th state."""
    save = states_class.save

    def once(self, number, *rest):
        out = save(self, number, *rest)
        if number == n:
            raise Lost
        return out

    monkeypatch.setattr(states_class, "save", once)


def test_factorisation_goes_on_after_a_lost_driver(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(k, int(i), int(j), float(rng.integers(1, 6))) for k in "ab" for i in range(8) for j in range(6) if i == j or rng.random() < 0.6], "key string, u long, b long, x double")
    of = {"a": mf.Options(2, 1.0, 0.1, 6), "b": mf.Options(3, 1.0, 0.5, 2)}
    order = lambda h: [tuple(r) for r in h.orderBy("key", "iter").collect()]
    want_u, _, want = mf.train(rows, rows, of)
    with monkeypatch.context() as m:
        lost_after(states.States, m, 4)
        with pytest.raises(Lost):
            mf.train(rows, rows, of, str(tmp_path / "mf"))
    (tmp_path / "mf" / "000009" / "table").mkdir(parents=True)  # a state that was being written
    users, _, history = mf.train(rows, rows, of, str(tmp_path / "mf"))
    got, want = order(history), order(want)
    assert [r[:2] for r in got] == [r[:2] for r in want] and all(np.allclose([x for x in a[2:7] if x is not None], [x for x in b[2:7] if x is not None]) for a, b in zip(got, want, strict=True))
    flat = lambda t: np.concatenate([r["features"] for r in t.orderBy("key", "id").collect()])
    assert np.allclose(flat(users), flat(want_u))
    assert order(mf.train(rows, rows, of, str(tmp_path / "mf"))[2]) == got  # a run that had ended


@pytest.mark.parametrize("solver", ["PG", "mAPG", "nmAPG"])
def test_machine_goes_on_after_a_lost_driver(spark, problem, tmp_path, solver, monkeypatch):
    d = design_of(spark, *problem)
    o = fm.Options(rank=2, size=3, initial=0.1, reg_w=0.01, reg_p=0.01, iterations=5, tries=30, eta=0.1, bias_eta=0.01, solver=solver)
    want_q, want = fm.train(d, d, o)
    with monkeypatch.context() as m:
        lost_after(states.States, m, 3)
        with pytest.raises(Lost):
            fm.train(d, d, o, resume=str(tmp_path / solver))
    q, history = fm.train(d, d, o, resume=str(tmp_path / solver))
    assert np.allclose(q.stacked, want_q.stacked, rtol=1e-12) and len(list((tmp_path / solver).iterdir())) == 2
    of = lambda h: [tuple(r)[:6] for r in h.orderBy("iter").collect()]
    assert np.allclose(of(history), of(want), rtol=1e-12)


def test_no_local_folder_on_a_cluster():
    class Cluster:
        class sparkContext:  # noqa: N801
            master = "yarn"
            getConf = staticmethod(lambda: {})

        class conf:  # noqa: N801
            get = staticmethod(lambda name, other: other)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Cluster, "x")


def test_settings(tmp_path):
    f = tmp_path / "s.yaml"
    f.write_text("dt: x\neta: 1e-3\nmeta_graphs: ['UUB_m1_0.5']\ntheta: 10\n")
    s = experiment.override(experiment.read_settings(str(f)), {"reg": 0.0, "mg": "UUB_m2_0.1,ratings_only", "reg_W": 9, "K": None})
    assert s.eta == 1e-3 and (s.reg_W, s.reg_P) == (0.0, 0.0) and s.meta_graphs == ("UUB_m2_0.1", "ratings_only") and s.n_features == 40
    with pytest.raises(ValueError):
        experiment.Settings(meta_graphs=("UUB_m9_0.5",))
    assert len(experiment.every_graph()) == 78


def test_whole_experiment(spark, sf):
    s = experiment.Settings(meta_graphs=("ratings_only", "UUB_m4_0.5"), topK=20, K=2, F=2, max_iters=2, ln=30, eta=0.1, mf_iterations=2)
    q, history, report = experiment.run(spark, tables.ratings(spark, sf), tables.trust(spark, sf), s)
    assert len(q.w) == 8 and history.count() >= 2 and report.first()["rmse"] > 0


def test_text_round_trips(spark, tmp_path):
    r = spark.createDataFrame([(1, 2, 3.5), (2, 3, 4.0)], "u long, b long, rating double")
    tables.write_triplets(r, str(tmp_path / "t"))
    tables.write_triplets(r.limit(1), str(tmp_path / "t"), append=True)
    assert tables.read_numbers(spark, str(tmp_path / "t")).count() == 3
    tables.write_lines(r, str(tmp_path / "l"), "%d\t%d\t%.1f", "u", "b", "rating")
    assert {tuple(x) for x in tables.read_numbers(spark, str(tmp_path / "l")).collect()} == {(1, 2, 3.5), (2, 3, 4.0)}
    (tmp_path / "ids").write_text("3\n\n4.0\n")
    assert {x["id"] for x in tables.read_ids(spark, str(tmp_path / "ids")).collect()} == {3, 4}


def test_a_pass_of_the_machine_moves_sums_only(spark):
    """Neither ratings nor representations are shuffled by a pass: nothing is dealt anew above the kept parts."""
    from pyspark.sql import functions as F

    rows = spark.range(300).selectExpr("id % 20 AS u", "id AS b", "double(id % 5) AS rating")
    reps = [rows.select(F.col(c).alias("id")).distinct().withColumn("features", F.array(F.lit(0.1), F.lit(0.2))) for c in "ub"]
    design = fm.joined(rows, None, *reps, rank=2)
    plan = design.sums([fm.Params(1.0, np.ones(4), np.ones((4, 2)))], 1)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("InMemoryRelation")[0] and "CoGroup" not in plan
    design.close()


def test_parts_of_the_machine_stay_small(spark, monkeypatch):
    """A task holds a part of the design at a time: with many ratings there are more parts, not larger ones, and the sums are the same."""
    from pyspark.sql import functions as F

    rows = spark.range(3000).selectExpr("id % 50 AS u", "id % 59 AS b", "double(id % 5) AS rating")
    reps = [rows.select(F.col(c).alias("id")).distinct().withColumn("features", F.array(F.lit(0.1), F.col("id") / 100)) for c in "ub"]
    q = fm.Params(1.0, np.ones(4), np.ones((4, 2)))
    want = fm.sums(fm.joined(rows, None, *reps, rank=2), [q], 1)
    monkeypatch.setattr(fm, "PART_ROWS", 40)
    design = fm.joined(rows, None, *reps, rank=2)
    assert max(len(r["x"]) // 8 for r in design.parts.select("x").collect()) <= 3 * fm.PART_ROWS
    got = fm.sums(design, [q], 1)
    assert np.allclose(got[1][0], want[1][0]) and np.isclose(got[0][0][0].square, want[0][0][0].square)
    design.close()


def test_training_writes_its_result_only(spark, monkeypatch):
    """No factor of an iteration is written, with parts that share ids, that stand together, and as many homes of shared ids as partitions."""
    monkeypatch.setattr(blocks, "PART_ROWS", 12)
    monkeypatch.setattr(blocks, "HOME_BYTES", 64)
    monkeypatch.setattr(resident, "BLOCK_ROWS", 30)
    rows = spark.createDataFrame([("k", u, b, float((u + 2 * b) % 5)) for u in range(12) for b in range(8) if (u + b) % 3], "key string, u long, b long, x double")
    work = mf.grouped(rows, rows, mf.Options(rank=2, eps=2.0, lamb=0.1, iterations=3))
    folder = Path(storage.shared_dir(spark, "none")).parent
    before = set(os.listdir(folder))
    _, history = work.train()
    assert {n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - before} == {"mf-result"}
    assert work.layout.parts.count() >= 1 + max(work.layout.held["index"].values()) > 1
    cells = np.array([(r["u"], r["b"], r["x"]) for r in rows.collect()])
    x, mask = np.zeros((12, 8)), np.zeros((12, 8))
    u, b = cells[:, 0].astype(int), cells[:, 1].astype(int)
    x[u, b], mask[u, b] = cells[:, 2], 1
    start = lambda n: resident.initial_matrix(np.arange(n), 2)
    want = dense_mf(x, mask, start(12), start(8), cells[:, 2].mean(), 0.1, 2.0, 3)[1]
    assert np.allclose([r["objective"] for r in history.where("status = 'ok'").orderBy("iter").collect()], want)
    work.close()
