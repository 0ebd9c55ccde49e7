"""Matrix factorisation of many relations at once: mean + U.V, joint gradient steps, adaptive step 1 / eps.

Every graph, split and point of a parameter grid is a problem of its own, and all advance in the same
jobs. Ratings are laid out once, in parts by ranges of users (``blocks``); an iteration moves to each part the factors of its own
ids, and their sums back, never a rating. Problems on the same rows (grid points, splits) share them. Nothing of a problem's size comes to the driver: along a gradient the objective is a polynomial of
degree 4 in the step, so one pass gives its coefficients for each problem, and the whole line search
is decided on these few numbers.

Training keeps factors beside the ratings (``resident``), an iteration being one job that writes nothing; ``gradient``, ``coefficients``
and ``moved`` are its steps one by one, for a state in a table. ``residuals``, ``objective`` and
``evaluate`` are the same sums as joins, for factors in a table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tricord.functions.vectors import dot
from tricord.operators.blocks import SIDES, Layout, in_lists, lay_out, unsqueezed
from tricord.operators.prep import TWO_SHARES, split_ratings
from tricord.operators.resident import Resident, initial_matrix, line, slopes
from tricord.plans.states import States
from tricord.plans.storage import materialize

TRIES = 20


@dataclass(frozen=True)
class Options:
    rank: int = 10
    eps: float = 10.0
    lamb: float = 10.0
    iterations: int = 500
    tolerance: float = 1e-8


def initial_features(rank: int, scale: float = 1e-4, shift: int = 0, key: str = "id") -> Column:
    """Start values in (scale, 2 scale) from the id alone, so the order of rows plays no part."""
    return F.array(*[F.lit(scale) * (1 + F.pmod(F.col(key) * 31 + 17 * k + shift, F.lit(97)) / F.lit(97.0)) for k in range(rank)])


def factors_of(rows: DataFrame, rank: int, scale: float = 1e-4) -> DataFrame:
    """(key, side, id, features) of the distinct ids on both sides of the relations."""
    ends = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.col(side).alias("id")) for side in "ub"])).alias("e")
    return rows.select("key", ends).select("key", "e.side", "e.id").distinct().select("key", "side", "id", initial_features(rank, scale).alias("features"))


def _beside(rows: DataFrame, factors: DataFrame, *names: str) -> DataFrame:
    """Rows with columns ``u_name`` and ``b_name`` of both sides' factors; null where an id has none."""
    for side in "ub":
        own = factors.where(F.col("side") == side).select("key", F.col("id").alias(side), *[F.col(n).alias(f"{side}_{n}") for n in names])
        rows = rows.join(own, ["key", side], "left")
    return rows


def _left(x: Column) -> Column:
    return x - F.coalesce(dot(F.col("u_features"), F.col("b_features")), F.lit(0.0))


def residuals(rows: DataFrame, factors: DataFrame) -> DataFrame:
    """(key, u, b, r) of rows (key, u, b, x), x being above the key's mean: x less the product, at the observed cells only."""
    return _beside(rows, factors, "features").select("key", "u", "b", _left(F.col("x")).alias("r"))


def objective(rows: DataFrame, factors: DataFrame, lamb: float) -> DataFrame:
    """(key, objective): half the squared residuals and lambda times half the squared factors."""
    square = factors.select("key", (dot(F.col("features"), F.col("features")) * lamb).alias("o"))
    return residuals(rows, factors).select("key", (F.col("r") * F.col("r")).alias("o")).union(square).groupBy("key").agg((F.sum("o") / 2).alias("objective"))


SUMS = ("rr", "ra", "rc", "aa", "ac", "cc", "n0", "n1", "n2", "rows", "square", "absolute")


def along(c: dict, s: float, lamb: float) -> float:
    """The objective at step s."""
    square = c["rr"] + 2 * s * c["ra"] + s**2 * (c["aa"] - 2 * c["rc"]) - 2 * s**3 * c["ac"] + s**4 * c["cc"]
    return 0.5 * square + 0.5 * lamb * (c["n0"] - 2 * s * c["n1"] + s * s * c["n2"])


def search(c: dict, eps: float, lamb: float) -> tuple[float | None, float, float, int]:
    """(step or None, the next eps, objective, tries): eps grows by half until 1 / eps lowers the objective."""
    now = along(c, 0.0, lamb)
    for k in range(TRIES):
        new = along(c, 1 / eps, lamb)
        if new < now:
            return 1 / eps, eps * 0.95, new, k + 1
        eps *= 1.5
    return None, eps, now, TRIES


@dataclass(frozen=True)
class Problem:
    """A problem of a group: the rows whose ``train`` field has its bit teach it, those whose ``test`` field has it test it."""

    group: int
    key: str
    options: Options
    bit: int = 0


class Factorisation:
    """Problems by groups; those of a group share its rows, each of which is read once for all of them.

    An id has one array with its factors of all the group's problems, one after another. A state is a table
    (home, f): per home a matrix with a row of factors for each id; gradients are (home, f, g).
    """

    def __init__(self, rows: DataFrame, problems: list[Problem], resume: str | None = None, layout: Layout | None = None):
        """``rows``: (g, u, b, x, train, test). ``resume``: a folder for the states of this run; one that holds a state is gone on from.
        ``layout``: that of the same rows, made for problems of no fewer numbers an id. Where b and x are arrays of one user's rows,
        ``rows`` are of a table that is written already."""
        self.states = States(rows.sparkSession, resume) if resume else None
        self.saved = self.states.last("home long, f binary") if resume else None
        self.spark, self.problems = rows.sparkSession, {}
        for p in problems:
            self.problems.setdefault(p.group, []).append(p)
        lists = in_lists(rows)
        rows = rows if layout or lists else materialize(rows, "mf-rows")
        self.rows = rows
        bit = lambda field, k: F.shiftright(field, k).bitwiseAND(1) == 1
        means = (rows.select("g", "train", F.explode("x").alias("x")) if lists else rows).groupBy("g").agg(*[F.avg(F.when(bit("train", k), F.col("x"))).alias(f"m{k}") for k in sorted({p.bit for p in problems} | {0})])
        means = {r["g"]: r for r in means.collect()}  # a row for each group
        self.specs = {}
        for g, ps in self.problems.items():
            ranks = np.array([p.options.rank for p in ps])
            mean = np.array([means[g][f"m{p.bit}"] if g in means and means[g][f"m{p.bit}"] is not None else 0.0 for p in ps])
            self.specs[g] = {"ranks": ranks, "from": np.cumsum(ranks) - ranks, "mean": mean, "bits": np.array([p.bit for p in ps]), "lamb": np.repeat([float(p.options.lamb) for p in ps], ranks)}
        if lists:
            taught = rows.where("train <> 0")
            known = taught.select("g", F.lit("u").alias("side"), F.col("u").alias("id")).unionByName(taught.select("g", F.lit("b").alias("side"), F.explode("b").alias("id")))
        else:
            ends = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.col(side).alias("id")) for side in SIDES])).alias("e")
            known = rows.where("train <> 0").select("g", ends).select("g", "e.side", "e.id")
        self.layout = layout or lay_out(rows, known, max((len(x["lamb"]) for x in self.specs.values()), default=1), tuple(self.saved[1]["grid"]) if self.saved else None)

        width = self.layout.width
        self.group_of = lambda home: home // width // 2

    def start(self, scale: float = 1e-4) -> DataFrame:
        specs = self.specs

        def run(batches):
            for batch in batches:
                for home, g, ids in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    f = np.hstack([initial_matrix(np.array(ids), rank, scale) for rank in specs[g]["ranks"]])
                    yield pa.RecordBatch.from_arrays([pa.array([home]), pa.array([f.tobytes()], pa.binary())], ["home", "f"])

        return self.layout.homes.select("home", "g", "ids").mapInArrow(run, "home long, f binary")

    def gradient(self, state: DataFrame) -> DataFrame:
        """(home, f, g): lambda times the factors less the residuals times the other side's."""
        specs, layout, group_of = self.specs, self.layout, self.group_of

        def part_sums(part, sides):
            spec = specs[part["g"]]
            if not part["train"].any():
                return []
            sums = slopes(part, spec, {s: matrix(sides[s]["f"], spec) for s in SIDES})  # a row for each id of the part
            return [(home, places, sums[s][at].tobytes()) for s in SIDES for home, at, places in sides[s]["slices"]]

        parts = layout.meet(state.select("home", "f"), part_sums, "home long, places binary, f binary")
        every = state.select("home", F.lit(None).cast("binary").alias("places"), "f").unionByName(parts)

        def combine(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            home, f = key[0].as_py(), None
            spec = specs[group_of(home)]
            total = np.zeros((0, len(spec["lamb"])))
            for batch in batches:
                for places, data in zip(batch.column("places"), batch.column("f"), strict=True):
                    values = matrix(data.as_py(), spec)
                    if places.is_valid:
                        at = unsqueezed(places.as_py())
                        total = np.pad(total, ((0, max(0, at[-1] + 1 - len(total))), (0, 0)))
                        total[at] += values
                    else:
                        f = values
            total = np.pad(total, ((0, len(f) - len(total)), (0, 0)))
            yield pa.RecordBatch.from_arrays([pa.array([home]), pa.array([f.tobytes()], pa.binary()), pa.array([(spec["lamb"] * f - total).tobytes()], pa.binary())], ["home", "f", "g"])

        return every.groupBy("home").applyInArrow(combine, "home long, f binary, g binary")

    def coefficients(self, gradients: DataFrame) -> DataFrame:
        """(g, p, rr, ra, rc, aa, ac, cc, n0, n1, n2, rows, square, absolute) of each problem's objective along its gradient.

        With step s a residual becomes r + s a - s^2 c; n0 to n2 are the factors' inner products with
        themselves, with their gradient, and the gradient's with itself. Of the test rows the number and
        the errors' squares and absolutes are added up.
        """
        specs, layout, group_of = self.specs, self.layout, self.group_of

        def part_sums(part, sides):
            spec = specs[part["g"]]
            # an id that no home has is the last row, of zeros
            f, g = ({s: np.vstack([matrix(sides[s][c], spec) if s in sides else np.zeros((0, len(spec["lamb"]))), np.zeros((1, len(spec["lamb"])))]) for s in SIDES} for c in "fg")
            return [(part["g"], p, *map(float, v)) for p, v in enumerate(line(part, spec, f, g))]

        def norms(batches):
            for batch in batches:
                for home, f, g in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    spec = specs[group_of(home)]
                    f, g = matrix(f, spec), matrix(g, spec)
                    sums = np.zeros((len(spec["mean"]), len(SUMS)))
                    for k, v in enumerate((f * f, f * g, g * g)):
                        sums[:, 6 + k] = np.add.reduceat(v.sum(axis=0), spec["from"])
                    group = pa.array([group_of(home)] * len(sums), pa.int32())
                    yield pa.RecordBatch.from_arrays([group, pa.array(np.arange(len(sums)), pa.int32()), *[pa.array(c) for c in sums.T]], ["g", "p", *SUMS])

        schema = "g int, p int, " + ", ".join(f"{n} double" for n in SUMS)
        every = layout.meet(gradients.select("home", "f", "g"), part_sums, schema).unionByName(gradients.select("home", "f", "g").mapInArrow(norms, schema))
        return every.groupBy("g", "p").agg(*[F.sum(n).alias(n) for n in SUMS])

    def moved(self, gradients: DataFrame, steps: dict[tuple[int, int], float]) -> DataFrame:
        """The state after a step of its own along each problem's gradient."""
        specs, group_of = self.specs, self.group_of

        def run(batches):
            for batch in batches:
                for home, f, g in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    spec = specs[group_of(home)]
                    step = np.repeat([steps.get((group_of(home), p), 0.0) for p in range(len(spec["ranks"]))], spec["ranks"])
                    yield pa.RecordBatch.from_arrays([pa.array([home]), pa.array([(matrix(f, spec) - step * matrix(g, spec)).tobytes()], pa.binary())], ["home", "f"])

        return gradients.select("home", "f", "g").mapInArrow(run, "home long, f binary")

    def table(self, state: DataFrame, *columns: str) -> DataFrame:
        """(key, side, id, columns) of a state or of gradients, ``columns`` (f, g) as arrays."""
        specs, keys = self.specs, {g: [p.key for p in ps] for g, ps in self.problems.items()}

        def run(batches):
            for batch in batches:
                for side, g, ids, *data in zip(*(batch.column(k).to_pylist() for k in range(3 + len(columns))), strict=True):
                    spec, made = specs[g], [matrix(d, specs[g]) for d in data]
                    for key, at, rank in zip(keys[g], spec["from"], spec["ranks"], strict=True):
                        lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * rank), pa.array(m[:, at : at + rank].ravel())) for m in made]
                        yield pa.RecordBatch.from_arrays([pa.array([key] * len(ids)), pa.array([side] * len(ids)), pa.array(ids, pa.int64()), *lists], ["key", "side", "id", *columns])

        rows = self.layout.homes.withColumnRenamed("g", "group").join(state, "home").select("side", "group", "ids", *columns)
        return rows.mapInArrow(run, "key string, side string, id long, " + ", ".join(f"{c} array<double>" for c in columns))

    def train(self, every: int = 1, factors: bool = True) -> tuple[DataFrame | None, DataFrame]:
        """(state, history) of all problems; without ``factors`` no state. Factors stay beside the ratings (``resident``), and an iteration is
        one job. With a folder for states, factors and the search's numbers are written to it after each ``every`` iterations,
        and a lost driver repeats that many at most."""
        options = {(g, k): p.options for g, ps in self.problems.items() for k, p in enumerate(ps)}
        eps, active, before, history, steps, first_t = {k: o.eps for k, o in options.items()}, set(options), {}, [], {}, 0
        errors = lambda rows, square, absolute: (None, None) if not rows else (float(square / rows) ** 0.5, float(absolute / rows))
        if self.saved:
            first_t, told = self.saved[:2]
            eps = {tuple(k): e for *k, e in told["eps"]}
            active, before = {tuple(k) for k in told["active"]}, {tuple(k): v for *k, v in told["before"]}
            history = [(tuple(k), *rest) for k, *rest in told["history"]]
        kept = Resident(self.layout, self.specs, self.saved[2] if self.saved else self.start(), bool(self.saved))
        for t in range(first_t, max((o.iterations for o in options.values()), default=0) if active else 0):
            found, steps, done = kept.advance(steps, {g for g, _ in active}), {}, set()
            for k in sorted(found.keys() & active):
                c, o = dict(zip(SUMS, map(float, found[k]), strict=True)), options[k]
                first = along(c, 0.0, o.lamb)
                step, eps[k], new, tries = search(c, eps[k], o.lamb)
                drop = abs(first - new) / first if first else 0.0
                history.append((k, t, first, *errors(*found[k][9:]), step, tries, "failed" if step is None else "ok"))
                before[k], steps[k] = new, step or 0.0
                if step is None or drop < o.tolerance or new < o.tolerance or t + 1 >= o.iterations:
                    done.add(k)
            active -= done
            if self.states and ((t + 1) % every == 0 or not active):
                told = {"grid": self.layout.grid, "eps": [(*k, e) for k, e in eps.items()], "active": sorted(active), "before": [(*k, v) for k, v in before.items()], "history": history}
                self.states.save(t + 1, told, kept.state(steps))
            if not active:
                break
        final = materialize(kept.state(steps), "mf-result") if factors else None
        last = {k: max(h[1] for h in history if h[0] == k) + 1 for k in before}
        found = kept.errors(steps) if history else {}
        history += [(k, last[k], float(before[k]), *(errors(*found[k][9:]) if k in found else (None, None)), None, 0, "end") for k in before]
        kept.close()
        named = [(self.problems[g][p].key, *rest) for (g, p), *rest in history]
        return final, self.spark.createDataFrame(named, "key string, iter int, objective double, rmse double, mae double, step double, tries int, status string")

    def close(self) -> None:
        self.layout.close()


#: Doubles of an id that the points of a grid have which are trained side by side.
GRID_DOUBLES = 240
def matrix(data: bytes, spec: dict) -> np.ndarray:
    return np.frombuffer(data, "<f8").reshape(-1, len(spec["lamb"]))


def grouped(relations: DataFrame, test: DataFrame | None, options: Options | dict[str, Options], resume: str | None = None) -> Factorisation:
    """Every key of ``relations`` (key, u, b, x) as a group with one problem; repeated (key, u, b) are averaged, but in lists."""
    lists = in_lists(relations)
    if lists and test is not None:
        raise ValueError("test rows are none where relations are lists")
    rows = relations if lists else materialize(relations.groupBy("key", "u", "b").agg(F.avg("x").alias("x")), "mf-relations")
    keys = sorted(r["key"] for r in rows.select("key").distinct().collect())
    of = options if isinstance(options, dict) else dict.fromkeys(keys, options)
    place = F.element_at(F.create_map(*[F.lit(v) for k in enumerate(keys) for v in (k[1], k[0])]), F.col("key")) if keys else F.lit(0)
    one, no = F.lit(1).cast("long"), F.lit(0).cast("long")
    every = rows.select(place.alias("g"), "u", "b", "x", one.alias("train"), no.alias("test"))
    if test is not None:
        every = every.unionByName(test.where(F.col("key").isin(keys)).select(place.alias("g"), "u", "b", F.col("x").cast("double").alias("x"), no.alias("train"), one.alias("test")))
    return Factorisation(every, [Problem(g, k, of[k]) for g, k in enumerate(keys)], resume)


def shared(rows: DataFrame, problems: list[Problem]) -> Factorisation:
    """Problems of one group over ``rows`` (u, b, x, train, test), the two fields telling which problems a row belongs to."""
    return Factorisation(rows.select(F.lit(0).alias("g"), "u", "b", F.col("x").cast("double").alias("x"), F.col("train").cast("long").alias("train"), F.col("test").cast("long").alias("test")), problems)


def _results(work: Factorisation) -> tuple[DataFrame, DataFrame, DataFrame]:
    state, history = work.train()
    work.close()
    final = work.table(state, "f")
    side = lambda s: final.where(F.col("side") == s).select("key", "id", F.col("f").alias("features"))
    return side("u"), side("b"), history


def train(relations: DataFrame, test: DataFrame | None, options: Options | dict[str, Options], resume: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Factors of all relations: (users, items, history), factors being (key, id, features).

    ``relations`` and ``test`` are (key: string, u, b, x); a key has its own options where a dict is
    given. A history row is (key, iter, objective, rmse, mae, step, tries, status);
    rmse and mae are those on the key's test rows, null without; an id without factors leaves the
    mean, and nothing is clipped to the scale. Repeated (key, u, b) are averaged. ``resume``: a folder of this run's states.
    b and x may be arrays, of distinct items of one user; such relations are read several times, so of a table that is written already.
    """
    return _results(grouped(relations, test, options, resume))


def train_splits(ratings: DataFrame, splits: int, options: Options) -> DataFrame:
    """The history of a problem for each split: ``ratings`` (u, b, x, train, test) stand once, whatever the number of splits,
    with a bit for each split they train or test."""
    work = shared(ratings, [Problem(0, str(k + 1), options, k) for k in range(splits)])
    _, history = work.train(factors=False)
    work.close()
    return history


def evaluate(rows: DataFrame, factors: DataFrame) -> DataFrame:
    """(key, rmse, mae) of rows above their key's mean; an id without factors leaves the mean. Not clipped to the scale."""
    e = residuals(rows, factors)
    return e.groupBy("key").agg(F.sqrt(F.avg(F.col("r") * F.col("r"))).alias("rmse"), F.avg(F.abs("r")).alias("mae"))


def baseline(ratings: DataFrame, options: Options = Options(lamb=1.0), seed: int = 1) -> DataFrame:
    """(rmse, mae) of the ratings alone: trained on 80 of 100, the errors on the others after the last iteration."""
    split = materialize(split_ratings(ratings, seed, TWO_SHARES), "split")
    part = lambda name: split.where(F.col("split") == name).select(F.lit("ratings_only").alias("key"), "u", "b", F.col("rating").alias("x"))
    return train(part("train"), part("test"), options)[2].where("status = 'end'").select("rmse", "mae")


def grid(train_rows: DataFrame, test_rows: DataFrame, ranks: tuple[int, ...], epsilons: tuple[float, ...], lambdas: tuple[float, ...], iterations: int) -> DataFrame:
    """(rank, eps, lamb, rmse, mae) of every point of a grid, the mean of its last five iterations, best first.

    Ratings are laid out once. Points are trained side by side, as many as have ``GRID_DOUBLES`` factors an id together: an id has one
    array with its factors of these, and a rating is read once for all of them. So neither a task's memory nor what stands
    in the shared folder at a time grows with the grid.
    """
    points = [Problem(0, f"{r}/{e!r}/{m!r}", Options(r, e, m, iterations)) for r in ranks for e in epsilons for m in lambdas]
    one, no = F.lit(1), F.lit(0)
    rows = train_rows.groupBy("u", "b").agg(F.avg("rating").alias("x")).select("u", "b", "x", one.alias("train"), no.alias("test"))
    rows = rows.unionByName(test_rows.select("u", "b", F.col("rating").alias("x"), no.alias("train"), one.alias("test")))
    turns: list[list[Problem]] = []
    for p in points:
        if not turns or sum(q.options.rank for q in turns[-1]) + p.options.rank > GRID_DOUBLES:
            turns.append([])
        turns[-1].append(p)
    work, history = None, None
    for turn in sorted(turns, key=lambda t: -sum(p.options.rank for p in t)):  # homes and parts are those of the largest
        work = shared(rows, turn) if work is None else Factorisation(work.rows, turn, layout=work.layout)
        found = work.train(factors=False)[1]
        history = found if history is None else history.unionByName(found)
    work.close()
    h = history.join(history.groupBy("key").agg(F.max("iter").alias("end")), "key").where("iter > end - 5").groupBy("key").agg(F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae"))
    part = lambda k, kind: F.split("key", "/")[k].cast(kind)
    return h.select(part(0, "int").alias("rank"), part(1, "double").alias("eps"), part(2, "double").alias("lamb"), "rmse", "mae").orderBy("rmse", "rank", "eps", "lamb")
