"""Factorisation machine of order two with group-lasso penalties, by proximal gradient and two accelerated forms.

    y = bias + x.w + 1/2 sum_f ((x.p_f)^2 - (x^2).(p_f^2))
    objective = mean squared error + reg_w sum_g |w_g| + reg_p sum_g |p_g|

Groups are blocks of ``size`` features. A row of the design is a user's representation beside an item's, so
x.w, x.p_f and (x^2).(p_f^2) are sums of a number of the user and one of the item: ``joined`` never makes the
design. Ratings are laid out in blocks (``blocks``), each with the representations of its own ids, once; a pass computes
these numbers once for each id of a part, adds err and err (x.p_f) over its rows, and one small product
makes these the part's gradient. Only parameters and sums move. Designs that exist as tables are packed into blocks of rows instead. Parameters
(a few thousand numbers: features times rank) live on the driver. A
pass over the design returns sums only: squared errors of several parameter sets at once, on the training
and on the test rows, and gradients as one row for each number. A proximal step takes a pass for the
gradient and one or more for the step sizes, which are tried in order, a few more at a time in each pass.

The accelerated forms are those published for nonconvex programs: from x_k, x_k-1 and the last extrapolated
step z_k, y_k = x_k + t_k-1/t_k (z_k - x_k) + (t_k-1 - 1)/t_k (x_k - x_k-1), with t_k+1 = (sqrt(4 t_k^2 + 1) + 1)/2.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tricord.functions.vectors import dot
from tricord.operators.blocks import SIDES, add_runs, lay_out, rows_of
from tricord.plans.states import States
from tricord.plans.storage import materialize

#: Step sizes tried in the first passes of a search; later ones try as many as the last.
TRIED = (2, 4, 8)
BLOCK_BYTES = 4 << 20
GROW, SHRINK = 1.1, 0.7


@dataclass(frozen=True)
class Params:
    bias: float
    w: np.ndarray  # features
    p: np.ndarray  # features x rank

    @property
    def stacked(self) -> np.ndarray:
        return np.column_stack((self.w, self.p))

    def moved(self, a: np.ndarray) -> Params:
        return replace(self, w=a[:, 0].copy(), p=a[:, 1:].copy())


@dataclass(frozen=True)
class Options:
    rank: int = 10
    size: int = 10  # of a group: the rank of the factors that make up its block
    initial: float = 1e-3
    reg_w: float = 0.5
    reg_p: float = 0.5
    iterations: int = 10_000
    tries: int = 1000
    eps: float = 1e-8
    eta: float = 1e-7
    bias_eta: float | None = None  # eta where it isn't set
    solver: str = "nmAPG"
    literal_momentum: bool = False  # mAPG with a momentum that stays 0
    seed: int = 1


def predict(x: np.ndarray, q: Params) -> np.ndarray:
    xp = x @ q.p
    return q.bias + x @ q.w + 0.5 * (xp * xp - (x * x) @ (q.p * q.p)).sum(axis=1)


def group_norms(a: np.ndarray, size: int) -> np.ndarray:
    """The norm of each block of ``size`` rows."""
    if len(a) % size:
        raise ValueError(f"{len(a)} features aren't whole groups of {size}")
    return np.sqrt((a.reshape(len(a) // size, -1) ** 2).sum(axis=1))


def prox(a: np.ndarray, eta: float, size: int) -> np.ndarray:
    """Blocks are shortened by eta; those no longer than that become 0."""
    norms = group_norms(a, size)
    shrink = np.where(norms > eta, 1 - eta / np.where(norms > 0, norms, 1), 0.0)
    return a * np.repeat(shrink, size).reshape((-1,) + (1,) * (a.ndim - 1))


def penalty(q: Params, o: Options) -> float:
    return float(o.reg_w * group_norms(q.w, o.size).sum() + o.reg_p * group_norms(q.p, o.size).sum())


@dataclass(frozen=True)
class Errors:
    rows: float
    total: float
    square: float
    absolute: float

    @property
    def mean_square(self) -> float:
        return self.square / self.rows


def packed(design: DataFrame, test: DataFrame | None = None) -> DataFrame:
    """(held, n, x, y): the rows (x, y) of a design, and those of a test design as held ones, as blocks of little-endian doubles."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            if not batch.num_rows:
                continue
            width = max(1, len(batch.column(1).slice(0, 1).flatten()))
            at_once = max(1, BLOCK_BYTES // (8 * width))
            for i in range(0, batch.num_rows, at_once):
                part = batch.slice(i, at_once)
                x, y = part.column(1).flatten().to_numpy(zero_copy_only=False), part.column(2).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([part.column(0).slice(0, 1), pa.array([len(y)], pa.int32()), pa.array([x.astype("<f8").tobytes()], pa.binary()), pa.array([y.astype("<f8").tobytes()], pa.binary())], ["held", "n", "x", "y"])

    pack = lambda rows, held: rows.select(F.lit(held).alias("held"), "x", "y").mapInArrow(run, "held boolean, n int, x binary, y binary")
    return pack(design, False) if test is None else pack(design, False).unionByName(pack(test, True))


def sums(blocks: DataFrame | Joined, sets: list[Params], gradients: int = 0) -> tuple[list[tuple[Errors, Errors]], list[np.ndarray]]:
    """Errors of each set on the training and on the held rows, and the training rows' gradient sums of the first ``gradients`` sets.

    A gradient has a column for w and one for each factor, as the sums of err x and of
    err (x (x.p_f) - p_f x^2), before the factor 2 / rows.
    """
    size = sets[0].stacked.size
    if isinstance(blocks, Joined):
        rows = blocks.sums(sets, gradients).groupBy("k").agg(F.sum("v").alias("v")).collect()
    else:
        shared = blocks.sparkSession.sparkContext.broadcast(sets)  # features times rank, a few times
        rows = blocks.mapInArrow(_dense_sums(shared, gradients, size), "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
        shared.unpersist()
    every = np.zeros(8 * len(sets) + gradients * size)
    every[[r["k"] for r in rows]] = [r["v"] for r in rows]
    errors = every[: 8 * len(sets)].reshape(2, len(sets), 4)
    if not errors[0, 0, 0]:
        raise ValueError("the design has no rows")
    pairs = [tuple(Errors(*map(float, errors[held, k])) for held in (0, 1)) for k in range(len(sets))]
    return pairs, list(every[8 * len(sets) :].reshape((gradients, *sets[0].stacked.shape)))


def _dense_sums(shared, gradients: int, size: int):
    def run(batches: Iterator) -> Iterator:
        sets = shared.value
        errors, found = np.zeros((2, len(sets), 4)), np.zeros((gradients, size))
        any_rows = False
        for batch in batches:
            for held, n, x, y in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("held", "n", "x", "y")), strict=True):
                any_rows = True
                x, y = np.frombuffer(x, "<f8").reshape(n, -1), np.frombuffer(y, "<f8")
                for k, q in enumerate(sets):
                    err = predict(x, q) - y
                    errors[int(held), k] += n, err.sum(), err @ err, np.abs(err).sum()
                    if k < gradients and not held:
                        of_p = x.T @ (err[:, None] * (x @ q.p)) - q.p * ((x * x).T @ err)[:, None]
                        found[k] += np.column_stack((x.T @ err, of_p)).ravel()
        if any_rows:
            yield _numbers(np.concatenate((errors.ravel(), found.ravel())))

    return run


def _numbers(values: np.ndarray, first: int = 0) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(values))), pa.array(values)], ["k", "v"])


#: Doubles of the rows that are worked on at once, rows of a part, and parts that a task takes in a pass, one after another.
AT_ONCE, PART_ROWS, PARTS = 1 << 20, 1 << 17, 8


@dataclass(frozen=True)
class Joined:
    """A design that stays in its factors: ``parts`` (u, b, x, train, ux, bx) of ratings, u and b being places in the part's own
    representations ux and bx. A pass sends parameters to the parts and returns sums; no factor and no rating moves."""

    parts: DataFrame
    widths: dict[str, int]  # of a user's and of an item's representation
    mean: float

    @property
    def features(self) -> int:
        return sum(self.widths.values())

    def sums(self, sets: list[Params], gradients: int = 0) -> DataFrame:
        """(k, v): the numbers that ``sums`` adds up, already added up over a task's parts."""
        widths, rank, n_sets = self.widths, sets[0].p.shape[1], len(sets)
        own = {"u": slice(0, widths["u"]), "b": slice(widths["u"], None)}
        n_features = self.features

        def run(batches: Iterator) -> Iterator:
            errors, found, some = np.zeros((2, n_sets, 4)), np.zeros((gradients, n_features, 1 + rank)), False
            for batch in batches:
                for at in range(batch.num_rows):
                    some, row = True, {c: batch.column(c)[at].as_buffer() for c in batch.schema.names}  # nothing is copied
                    u, b, y, mine = (np.frombuffer(row[c], kind) for c, kind in (("u", "<i4"), ("b", "<i4"), ("x", "<f8"), ("train", "i1")))
                    mine = mine > 0
                    if np.any(mine & ((u < 0) | (b < 0))):
                        raise ValueError("a training row's user or item has no representation")
                    x = {s: np.frombuffer(row[f"{s}x"], "<f8").reshape(-1, max(1, widths[s])) for s in SIDES}
                    for k, q in enumerate(sets):
                        # of an id x.w, x.p_f, and the sum of (x^2).(p_f^2)
                        f = {s: np.column_stack([x[s] @ q.stacked[own[s]], (x[s] * x[s]) @ (q.p[own[s]] ** 2).sum(axis=1)]) for s in SIDES}
                        back = {s: np.zeros((len(x[s]), 1 + rank)) for s in SIDES}
                        at_once = max(1, AT_ONCE // (rank + 2))
                        for i in range(0, len(y), at_once):
                            at = slice(i, i + at_once)
                            v = rows_of(f["u"], u[at]) + rows_of(f["b"], b[at])
                            err = q.bias + v[:, 0] + 0.5 * ((v[:, 1:-1] ** 2).sum(axis=1) - v[:, -1]) - y[at]
                            for held in (0, 1):
                                e = err[mine[at] != bool(held)]
                                errors[held, k] += len(e), e.sum(), e @ e, np.abs(e).sum()
                            if k < gradients:
                                e = np.where(mine[at], err, 0.0)[:, None]
                                values = np.hstack([e, e * v[:, 1:-1]])
                                for s, places in (("u", u[at]), ("b", b[at])):
                                    add_runs(back[s], places, values)
                        if k < gradients:
                            for s in SIDES:
                                g = x[s].T @ back[s]
                                g[:, 1:] -= q.p[own[s]] * ((x[s] * x[s]).T @ back[s][:, 0])[:, None]
                                found[k, own[s]] += g
            if some:
                yield _numbers(np.concatenate((errors.ravel(), found.ravel())))

        return self.parts.mapInArrow(run, "k long, v double")

    def close(self) -> None:
        self.parts.unpersist()


def joined(train: DataFrame, test: DataFrame | None, users: DataFrame, items: DataFrame, rank: int = 10) -> Joined:
    """The design of ratings (u, b, rating) whose users and items have representations (id, features), as its factors.

    Every user and item of ``train`` must have one, else the first pass raises ValueError; those of ``test`` without
    one are zeros. A part of the ratings has the representations of its users and items beside it, each once.
    """
    one, no = F.lit(1).cast("long"), F.lit(0).cast("long")
    pick = lambda rows, a, b: rows.select(F.lit(0).alias("g"), "u", "b", F.col("rating").cast("double").alias("x"), a.alias("train"), b.alias("test"))
    rows = pick(train, one, no) if test is None else pick(train, one, no).unionByName(pick(test, no, one))
    tables = {"u": users.select("id", "features"), "b": items.select("id", "features")}
    heads = {s: t.agg(F.max(F.size("features"))).first()[0] or 0 for s, t in tables.items()}
    known = [t.select(F.lit(0).alias("g"), F.lit(s).alias("side"), "id") for s, t in tables.items()]
    layout = lay_out(rows, known[0].unionByName(known[1]), max(1, *heads.values()), part_rows=PART_ROWS)
    places = layout.homes.select("home", "side", F.posexplode("ids").alias("at", "id"))
    placed = None
    for s, t in tables.items():
        met = places.where(F.col("side") == s).join(t, "id").select("home", "at", "features")
        placed = met if placed is None else placed.unionByName(met)

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        x = t.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return pa.table({"home": t.column("home").slice(0, 1), "x": pa.array([x.astype("<f8").tobytes()], pa.binary())})

    sides = materialize(placed.groupBy("home").applyInArrow(pack, "home long, x binary"), "representations")

    def own(part, known):
        """A part with its own ids' representations only."""
        at, x = {}, {}
        for s in SIDES:
            ids, places = np.unique(part[s], return_inverse=True)
            missing = int(len(ids) > 0 and ids[0] < 0)
            at[s] = (places - missing).astype("<i4")
            x[s] = np.frombuffer(known[s]["x"], "<f8").reshape(-1, max(1, heads[s]))[ids[missing:]] if s in known and heads[s] else np.zeros((len(ids) - missing, heads[s]))
        return [(at["u"].tobytes(), at["b"].tobytes(), part["x"].tobytes(), (part["train"] > 0).astype("i1").tobytes(), x["u"].tobytes(), x["b"].tobytes())]

    parts = materialize(layout.meet(sides, own, "u binary, b binary, x binary, train binary, ux binary, bx binary"), "fm-parts")
    layout.close()
    tasks = max(1, train.sparkSession.sparkContext.defaultParallelism)
    parts = parts.repartition(max(tasks, -(-parts.count() // PARTS))).persist(StorageLevel.MEMORY_AND_DISK)
    mean = train.agg(F.avg("rating")).first()[0]
    return Joined(parts, heads, float(mean or 0.0))


def predictions(ratings: DataFrame, users: DataFrame, items: DataFrame, q: Params) -> DataFrame:
    """(u, b, pred) as column expressions: an id's part of every sum once, two joins, and the square of the sums."""
    n = users.agg(F.max(F.size("features"))).first()[0] or 0
    array = lambda v: F.array(*[F.lit(float(x)) for x in v])

    def part(table: DataFrame, side: str, at: slice) -> DataFrame:
        x = F.col("features")
        s = [dot(x, array(q.p[at, f])) for f in range(q.p.shape[1])]
        square = dot(F.transform(x, lambda v: v * v), array((q.p[at] ** 2).sum(axis=1)))
        return table.select(F.col("id").alias(side), dot(x, array(q.w[at])).alias(f"{side}_w"), F.array(*s).alias(f"{side}_p"), square.alias(f"{side}_q"))

    rows = ratings.select("u", "b").join(part(users, "u", slice(0, n)), "u", "left").join(part(items, "b", slice(n, None)), "b", "left")
    none = F.array_repeat(F.lit(0.0), q.p.shape[1])
    number = lambda c: F.coalesce(F.col(f"u_{c}"), F.lit(0.0)) + F.coalesce(F.col(f"b_{c}"), F.lit(0.0))
    sums_: Column = F.zip_with(F.coalesce("u_p", none), F.coalesce("b_p", none), lambda a, b: a + b)
    return rows.select("u", "b", (F.lit(q.bias) + number("w") + (dot(sums_, sums_) - number("q")) / 2).alias("pred"))


def objective(blocks: DataFrame | Joined, q: Params, o: Options) -> float:
    return sums(blocks, [q])[0][0][0].mean_square + penalty(q, o)


@dataclass(frozen=True)
class Step:
    """Parameters with their objective and errors, and how a proximal step got there; the next step size to try is ``eta``."""

    params: Params
    value: float
    errors: Errors
    held: Errors
    eta: float
    tries: int = 0
    accepted: bool = True


def proximal_steps(blocks: DataFrame | Joined, starts: list[Params], etas: list[float], o: Options) -> list[Step]:
    """A proximal step from each start, in the same passes.

    A step size shrinks until the objective falls below that at the start; if it never does, the start
    returns with its own objective.
    """
    pairs, gradients = sums(blocks, starts, len(starts))
    out = [Step(q, e.mean_square + penalty(q, o), e, h, eta, -1, False) for q, (e, h), eta in zip(starts, pairs, etas, strict=True)]
    slopes = [g * (2 / e.rows) for g, (e, _) in zip(gradients, pairs, strict=True)]
    turn = 0
    while todo := [i for i, s in enumerate(out) if not s.accepted and s.tries < o.tries]:
        sets = []
        for i in todo:
            q, g = starts[i], slopes[i]
            for k in range(min(TRIED[min(turn, len(TRIED) - 1)], o.tries - out[i].tries)):
                eta = out[i].eta * SHRINK**k
                sets.append((i, eta, replace(q, w=prox(q.w - eta * g[:, 0], eta * o.reg_w, o.size), p=prox(q.p - eta * g[:, 1:], eta * o.reg_p, o.size))))
        for (i, eta, q), (e, h) in zip(sets, sums(blocks, [q for _, _, q in sets])[0], strict=True):
            if out[i].accepted:
                continue
            value, tries = e.mean_square + penalty(q, o), out[i].tries + 1
            out[i] = Step(q, value, e, h, eta * GROW, tries) if value < out[i].value else replace(out[i], eta=eta * SHRINK, tries=tries)
        turn += 1
    return out


def start(design: DataFrame | Joined, o: Options) -> Params:
    """Bias: the mean target; parameters: uniform in (0, initial), seeded."""
    if isinstance(design, Joined):
        mean, n = design.mean, design.features
    else:
        head = design.agg(F.avg("y").alias("mean"), F.max(F.size("x")).alias("n")).first()
        if head["n"] is None:
            raise ValueError("the design has no rows")
        mean, n = float(head["mean"]), head["n"]
    rng = np.random.default_rng(o.seed)
    return Params(mean, rng.random(n) * o.initial, rng.random((n, o.rank)) * o.initial)


def train(design: DataFrame | Joined, test: DataFrame | None, o: Options, q: Params | None = None, resume: str | None = None, every: int = 1) -> tuple[Params, DataFrame]:
    """(parameters, history); history: (iter, objective, rmse, mae, step, tries, accelerated, status), iter 0 the start.

    ``design``: rows (x, y), or a joined one, which holds its test rows itself. Errors are those on ``test``, null without.
    ``resume``: a folder for the states of this run, written after each ``every`` steps; one that holds a state is gone on from.
    """
    solvers = {"PG": _plain, "mAPG": _monotone, "nmAPG": _non_monotone}
    if o.solver not in solvers:
        raise ValueError(f"no solver {o.solver!r}; there are {', '.join(solvers)}")
    spark = design.parts.sparkSession if isinstance(design, Joined) else design.sparkSession
    states = States(spark, resume) if resume else None
    saved = states.last() if states else None
    blocks = design if isinstance(design, Joined) else materialize(packed(design, test), "fm-blocks")
    history: list[tuple] = []

    def note(s: Step, accelerated: bool = False, ok: bool = True) -> bool:
        """Whether to stop."""
        found = ((s.held.mean_square) ** 0.5, s.held.absolute / s.held.rows) if s.held.rows else (None, None)
        before = history[-1][1] if history else None
        history.append((len(history), s.value, *found, s.eta, s.tries, accelerated, "ok" if ok else "failed"))
        return not ok or (before is not None and before > 0 and abs(before - s.value) / before < o.eps)

    memory, ended = None, False
    if saved:
        now, memory, ended = _told(saved[1]["step"]), saved[1]["memory"], saved[1]["ended"]
        history += [tuple(h) for h in saved[1]["history"]]
    else:
        q = start(design, o) if q is None else q
        (errors, held), = sums(blocks, [q])[0]
        now = Step(q, errors.mean_square + penalty(q, o), errors, held, o.eta)
        note(now)
    solver = solvers[o.solver](now, o, memory)
    while len(history) <= o.iterations and not ended:
        now, accelerated, ok = solver.step(blocks)
        ended = note(now, accelerated, ok)
        if states and ((len(history) - 1) % every == 0 or ended):
            states.save(len(history) - 1, {"step": _telling(now), "memory": solver.memory(), "ended": ended, "history": history})
    return now.params, spark.createDataFrame(history, "iter int, objective double, rmse double, mae double, step double, tries int, accelerated boolean, status string")


def _telling(s: Step) -> dict:
    return {"bias": float(s.params.bias), "stacked": s.params.stacked.tolist(), "value": float(s.value), "errors": [s.errors.rows, s.errors.total, s.errors.square, s.errors.absolute],
            "held": [s.held.rows, s.held.total, s.held.square, s.held.absolute], "eta": s.eta, "tries": s.tries, "accepted": bool(s.accepted)}


def _told(t: dict) -> Step:
    a = np.array(t["stacked"])
    return Step(Params(t["bias"], a[:, 0].copy(), a[:, 1:].copy()), t["value"], Errors(*t["errors"]), Errors(*t["held"]), t["eta"], t["tries"], t["accepted"])


class _plain:  # noqa: N801
    """Proximal steps, one after another. ``step`` gives (the new state, whether accelerated, whether accepted), ``memory`` what else a later step needs."""

    def __init__(self, s: Step, o: Options, memory: dict | None = None):
        self.s, self.o = s, o
        self.begin(memory)

    def begin(self, memory: dict | None) -> None:
        pass

    def memory(self) -> dict:
        return {}

    def step(self, blocks: DataFrame | Joined) -> tuple[Step, bool, bool]:
        (self.s,) = proximal_steps(blocks, [self.s.params], [self.s.eta], self.o)
        return self.s, False, self.s.accepted


@dataclass
class Momentum:
    """x_k-1, x_k, z_k, t_k-1 and t_k of the published recurrence; t_k-1 stays 0 where it is ``fixed``."""

    x: np.ndarray
    fixed: bool = False

    def __post_init__(self):
        self.x_before, self.z, self.t_before, self.t = self.x, self.x, 0.0, 1.0

    @property
    def y(self) -> np.ndarray:
        return self.x + self.t_before / self.t * (self.z - self.x) + (self.t_before - 1) / self.t * (self.x - self.x_before)

    def advance(self, x: np.ndarray, z: np.ndarray) -> None:
        self.x_before, self.x, self.z = self.x, x, z
        t = self.t
        self.t = float((np.sqrt(4 * (self.t_before if self.fixed else t) ** 2 + 1) + 1) / 2)
        self.t_before = self.t_before if self.fixed else t

    def told(self) -> dict:
        return {"x": self.x.tolist(), "x_before": self.x_before.tolist(), "z": self.z.tolist(), "t": self.t, "t_before": self.t_before}

    def restore(self, told: dict) -> None:
        self.x, self.x_before, self.z = (np.array(told[k]) for k in ("x", "x_before", "z"))
        self.t, self.t_before = told["t"], told["t_before"]


class _monotone(_plain):  # noqa: N801
    """x_k+1 is the better one of z_k+1, a step from y_k, and v_k+1, a step from x_k."""

    def begin(self, memory: dict | None) -> None:
        self.at = Momentum(self.s.params.stacked, self.o.literal_momentum)
        if memory:
            self.at.restore(memory["at"])

    def memory(self) -> dict:
        return {"at": self.at.told()}

    def step(self, blocks: DataFrame | Joined) -> tuple[Step, bool, bool]:
        s, at = self.s, self.at
        z, v = proximal_steps(blocks, [s.params.moved(at.y), s.params.moved(at.x)], [s.eta, s.eta], self.o)
        self.s = z if z.value < v.value else v
        at.advance(self.s.params.stacked, z.params.stacked)
        return self.s, self.s is z, self.s.accepted


class _non_monotone(_plain):  # noqa: N801
    """x_k+1 is z_k+1 if that falls below c_k, a mean of past objectives; only else is v_k+1 made. The bias takes a step of its own."""

    def begin(self, memory: dict | None) -> None:
        self.at, self.c, self.q = Momentum(self.s.params.stacked), self.s.value, 1.0
        self.eta_z = self.eta_v = self.o.eta
        if memory:
            self.at.restore(memory["at"])
            self.c, self.q, self.eta_z, self.eta_v = (memory[k] for k in ("c", "q", "eta_z", "eta_v"))

    def memory(self) -> dict:
        return {"at": self.at.told(), "c": float(self.c), "q": float(self.q), "eta_z": self.eta_z, "eta_v": self.eta_v}

    def step(self, blocks: DataFrame | Joined) -> tuple[Step, bool, bool]:
        s, at, o = self.s, self.at, self.o
        bias_eta = o.eta if o.bias_eta is None else o.bias_eta
        moved = replace(s.params, bias=s.params.bias - bias_eta * 2 / s.errors.rows * s.errors.total)
        (z,) = proximal_steps(blocks, [moved.moved(at.y)], [self.eta_z], o)
        self.eta_z, s, ok = z.eta, z, z.accepted
        if not z.value < self.c:
            (v,) = proximal_steps(blocks, [moved.moved(at.x)], [self.eta_v], o)
            self.eta_v, s, ok = v.eta, v if v.value <= z.value else z, ok and v.accepted
        at.advance(s.params.stacked, z.params.stacked)
        self.q, before = 0.5 * self.q + 1, self.q
        self.c = (0.5 * before * self.c + s.value) / self.q
        self.s = s
        return s, s is z, ok
