"""Operator 3: near duplicates among embeddings of one label, by an inverted multi-index.

Unit vectors are split into halves, each with a codebook of its own (k-means on a bounded sample),
so K centres a half span a grid of K x K cells. A vector lives in the cell of its nearest centres;
a search walks the grid in order of the summed distances (multi-sequence traversal over a heap)
and visits the first cells until the target recall, for which the number is measured on sampled
vectors and neighbours at all angles up to the threshold's. K is the one of the tried sizes at which
such a search costs least: visits times what a visit and the vectors in a cell cost. Every vector
is indexed and searches. What it meets is verified by cosine in double precision, so nothing below
the threshold links.

Equal vectors of a label are one point with a weight. The visitors and residents of a cell meet in
blocks of each side, so that none has to fit a task. A meeting gives no pairs: it adds up the
weights of what each point links with, and returns edges that connect what is linked there, fewer
than it has points. A pair that meets twice, each point visiting the other's cell, counts at the
smaller point's visit.

Rows: vectors that are null, empty, zero or hold null or non-finite components, and vectors without
a label, link with nothing; so do vectors of different lengths; rows that repeat an id, its vector
and label count once and are returned each; a null id takes part but speaks for no component;
other columns are ignored; an empty table gives no rows. Points go by 64-bit hashes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, small

#: Points of a side that meet at once, on average.
BLOCK = 2048
#: Vectors that codebooks are made from, at most; codebook sizes that are tried.
SAMPLE, SIZES = 20_000, (1, 2, 4, 8, 16, 32, 64, 128, 256, 512)
#: What moving a vector to a cell costs, in comparisons of two vectors.
MOVE = 200


def unit(vector: list | None) -> bytes | None:
    """A vector over its length as packed doubles; None if it can't link."""
    if not vector or None in vector:
        return None
    x = np.array(vector, dtype=np.float64)
    size = np.sqrt(x @ x) if np.isfinite(x).all() else 0.0
    if not size or not np.isfinite(size):
        scale = np.abs(x).max() if np.isfinite(x).all() else 0.0  # squares may leave the range of doubles
        if not scale:
            return None
        x = x / scale
        size = np.sqrt(x @ x)
    return (x / size).tobytes()


def k_means(x: np.ndarray, k: int, rounds: int = 6, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]]
    for _ in range(rounds):
        near = np.concatenate([nearest(x[i : i + 2048], centres).argmin(axis=1) for i in range(0, len(x), 2048)])
        n = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, weights=c, minlength=len(centres)) for c in x.T], axis=1) if x.shape[1] else np.zeros_like(centres)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances (rows, centres)."""
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)


def multi_sequence(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cells (i, j) in order of ``first[i] + second[j]``, lazily."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, pushed = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}
    while heap:
        _, i, j = heapq.heappop(heap)
        yield int(a[i]), int(b[j])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in pushed:
                pushed.add((x, y))
                heapq.heappush(heap, (first[a[x]] + second[b[y]], x, y))


class Grid:
    """Codebooks of one vector length, and how many cells a search visits."""

    def __init__(self, x: np.ndarray, k: int, threshold: float, recall: float):
        self.length, self.half = x.shape[1], x.shape[1] // 2
        self.books = [k_means(part, min(k, len(x))) if part.shape[1] else np.zeros((1, 0)) for part in (x[:, : self.half], x[:, self.half :])]
        rng = np.random.default_rng(2)
        some = x[rng.permutation(len(x))[:400]]
        # a neighbour of each, at an angle drawn up to the threshold's
        turn = rng.normal(size=some.shape)
        turn -= (turn * some).sum(axis=1, keepdims=True) * some
        turn /= np.maximum(np.linalg.norm(turn, axis=1, keepdims=True), 1e-12)
        cosine = rng.uniform(threshold, 1, size=(len(some), 1))
        there = np.stack([d.argmin(axis=1) for d in self.distances(cosine * some + np.sqrt(1 - cosine * cosine) * turn)], axis=1)
        # a cell's place in a walk: how many cells are nearer
        ranks = [int(((a[:, None] + b[None, :]) < a[i] + b[j]).sum()) for a, b, (i, j) in zip(*self.distances(some), there.tolist(), strict=True)]
        self.visits = int(np.sort(ranks)[int(np.ceil(recall * len(ranks))) - 1]) + 1

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return nearest(x[:, : self.half], self.books[0]), nearest(x[:, self.half :], self.books[1])

    def walk(self, x: np.ndarray) -> list[int]:
        """The cells that the search of a vector visits, its own first."""
        cells = multi_sequence(*(d[0] for d in self.distances(x[None, :])))
        return [self.length << 40 | i << 20 | j for _, (i, j) in zip(range(self.visits), cells, strict=False)]


def fit_grids(points: DataFrame, threshold: float, recall: float, sample: int = SAMPLE) -> dict[int, Grid]:
    """A grid for each vector length, on ``sample`` points (about) drawn by their hash."""
    n, labels = points.agg(F.count("*"), F.approx_count_distinct("label")).first()
    if not n:
        return {}
    drawn = points.where(F.pmod("pid", F.lit(1 << 30)) / float(1 << 30) < min(1.0, sample / n)).select("u").collect()
    by: dict[int, list] = {}
    for u in sorted(bytes(r["u"]) for r in drawn):
        by.setdefault(len(u) // 8, []).append(np.frombuffer(u))
    return {d: cheapest_grid(np.array(x), n / max(1, labels), threshold, recall) for d, x in by.items()}


def cheapest_grid(x: np.ndarray, rows: float, threshold: float, recall: float) -> Grid:
    """The grid of the tried sizes on which a search among ``rows`` vectors of a label costs least; larger ones aren't tried once costs rise."""
    best, least = None, np.inf
    for k in SIZES:
        if best is not None and k * 20 > len(x):
            break
        grid = Grid(x, k, threshold, recall)
        cost = grid.visits * (MOVE + rows / (len(grid.books[0]) * len(grid.books[1])))
        if cost > 2 * least:
            break
        if cost < least:
            best, least = grid, cost
    return best


def _matrix(column) -> np.ndarray:
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), dtype=np.float64).reshape(len(data), -1) if data else np.zeros((0, 1))


def spanning_edges(hits: np.ndarray) -> list[tuple[int, int]]:
    """(row, row or rows + column) edges that connect what ``hits`` (rows, columns) connects: fewer than rows and columns."""
    out, rows, columns = [], hits.any(axis=1), hits.any(axis=0)
    while rows.any():
        root = int(rows.argmax())
        rows[root], front = False, np.array([root])
        while len(front):
            reached = np.flatnonzero(hits[front].any(axis=0) & columns)
            columns[reached] = False
            front = np.flatnonzero(hits[:, reached].any(axis=1) & rows)
            rows[front] = False
            out += [(root, len(hits) + int(c)) for c in reached] + [(root, int(r)) for r in front]
    return out


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, recall: float = 0.99, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; links are pairs of one label with the threshold's cosine."""
    spark = vectors.sparkSession

    def prepare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([unit(v) for v in batch.column(3).to_pylist()], pa.binary())], ["rid", "vec_id", "label", "u"])

    source = vectors.select(F.xxhash64(id_col, label_col, vector_col).alias("rid"), F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v"))
    every = source.mapInArrow(prepare, "rid long, vec_id long, label string, u binary")
    pid = F.when(F.col("u").isNotNull() & F.col("label").isNotNull(), F.xxhash64("label", "u"))
    every = materialize(every.withColumn("pid", pid), "vectors")
    rows = every.where("pid IS NOT NULL")
    # copies are merged before the shuffle, so no vector is hot
    of_point = rows.select("pid", "rid", "vec_id").distinct().groupBy("pid").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    distinct = materialize(rows.select("pid", "label", "u").dropDuplicates(["pid"]), "distinct")
    grids = fit_grids(distinct, threshold, recall)
    shared = spark.sparkContext.broadcast(grids)  # 2 x 512 centres at most for each vector length of the sample

    def walk(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            cells = []
            for u in batch.column(batch.schema.get_field_index("u")).to_pylist():
                grid = shared.value.get(len(u) // 8)
                cells.append(grid.walk(np.frombuffer(u)) if grid else [(len(u) // 8) << 40])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c[0] for c in cells], pa.int64()), pa.array(cells, pa.list_(pa.int64()))], [*batch.schema.names, "cell", "cells"])

    points = distinct.mapInArrow(walk, "pid long, label string, u binary, cell long, cells array<long>")
    points = materialize(points.join(of_point, "pid"), "points")

    # each side of a cell in blocks, every block of the one with every block of the other; only crowded cells need more than one
    visits = points.select("label", F.explode("cells").alias("at"), F.lit(0).alias("resident")).union(points.select("label", "cell", F.lit(1)))
    crowds = visits.groupBy("label", "at").agg(F.sum("resident").alias("residents"), F.sum(1 - F.col("resident")).alias("visitors"))
    crowded = crowds.where((F.col("residents") > BLOCK) | (F.col("visitors") > BLOCK))
    crowded = materialize(crowded.select("label", "at", *[F.ceil(F.greatest(F.col(c), F.lit(1)) / BLOCK).cast("int").alias(c) for c in ("residents", "visitors")]), "crowded")
    crowded = small(crowded, 64)

    def side(rows: DataFrame, flag: bool, own: str, other: str) -> DataFrame:
        parts = [F.coalesce(F.col(c), F.lit(1)) for c in (own, other)]
        dealt = rows.join(crowded, ["label", "at"], "left").select("label", "at", F.lit(flag).alias("resident"), "pid", "weight", "u", "cell", "cells", F.pmod(F.xxhash64("pid"), parts[0]).cast("int").alias(own), F.explode(F.sequence(F.lit(0), parts[1] - 1)).alias(other))
        return dealt.select("label", "at", "residents", "visitors", "resident", "pid", "weight", "u", "cell", "cells")

    # a resident brings the cells that it visits itself, a visitor only its own cell
    residents = side(points.withColumn("at", F.col("cell")), True, "residents", "visitors")
    no_cells = F.lit(None).cast("array<long>")
    visitors = side(points.select("label", F.explode("cells").alias("at"), "pid", "weight", "u", "cell", no_cells.alias("cells")), False, "visitors", "residents")

    def meet(group):
        """(pid, linked weight) of points, and (pid, pid) of spanning edges."""
        import pyarrow as pa
        import pyarrow.compute as pc

        res, vis = group.filter(group.column("resident")), group.filter(pc.invert(group.column("resident")))
        x, y = _matrix(res.column("u")), _matrix(vis.column("u"))
        a, b = res.column("pid").to_numpy(), vis.column("pid").to_numpy()
        out = [np.zeros(0, dtype=np.int64)] * 3
        if len(x) and len(y):
            homes, home = np.unique(vis.column("cell").to_numpy(), return_inverse=True)
            walks = res.column("cells").to_pylist()
            flat = np.fromiter((c for w in walks for c in w), dtype=np.int64)
            place = np.minimum(np.searchsorted(homes, flat), len(homes) - 1)
            known = homes[place] == flat
            returns = np.zeros((len(homes), len(x)), dtype=bool)
            returns[place[known], np.repeat(np.arange(len(x)), [len(w) for w in walks])[known]] = True
            hits = np.empty((len(y), len(x)), dtype=bool)
            for i in range(0, len(y), 512):
                own = slice(i, i + 512)
                hits[own] = (y[own] @ x.T >= threshold) & ((b[own, None] < a[None, :]) | ~returns[home[own]]) & (b[own, None] != a[None, :])
            linked = np.concatenate((hits @ res.column("weight").to_numpy(), hits.T @ vis.column("weight").to_numpy()))
            ids = np.concatenate((b, a))
            some = linked > 0
            edges = np.array(spanning_edges(hits), dtype=np.int64).reshape(-1, 2)
            out = [np.concatenate((ids[some], ids[edges[:, 0]])), np.concatenate((linked[some], np.zeros(len(edges), dtype=np.int64))), np.concatenate((ids[some], ids[edges[:, 1]]))]
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["a", "linked", "b"])

    met = residents.unionByName(visitors).groupBy("label", "at", "residents", "visitors").applyInArrow(meet, "a long, linked long, b long")
    met = materialize(met, "met")
    counts = met.where("a = b").groupBy(F.col("a").alias("pid")).agg(F.sum("linked").alias("linked"))
    linked = points.select("pid", "weight", "least").join(counts, "pid", "left")
    named = linked.join(components(met.where("a <> b").select("a", "b")).select(F.col("id").alias("pid"), "component"), "pid", "left").withColumn("component", F.coalesce("component", "pid"))
    named = materialize(named, "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_row = named.join(least, "component").select("pid", "component_id", (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = every.select("vec_id", "pid").join(of_row, "pid", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
