"""Directed-triangle motifs m1 to m7 of a trust graph, per ordered pair of users.

Every triangle is found once. Those with one mutual edge are looked for around it, and those with two
around their one-way edge, from the end that has fewer neighbours of the wanted kind. Where all edges are of one kind,
they point from the end of lower to that of higher degree, so that a vertex has few of them however
large a hub it is, and pairs of edges out of one vertex are closed by a third edge. The edges' kinds
decide the motif; each triangle then counts for its six ordered pairs. ``motif_by_terms`` is the sum
of masked products that defines the same matrices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tricord.plans.storage import materialize, small

from .prep import in_blocks
from .sparse import add, masked_multiply, transpose

MOTIFS = tuple(f"m{k}" for k in range(1, 8))


def clean_edges(trust: DataFrame, keep_loops: bool = False) -> DataFrame:
    """Distinct edges (src, dst) without loops; duplicates would make one-way weights negative."""
    edges = trust.select("src", "dst").distinct()
    return edges if keep_loops else edges.where("src <> dst")


def mutual(trust: DataFrame) -> DataFrame:
    back = trust.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return trust.join(back, ["src", "dst"], "left_semi")


def one_way(trust: DataFrame) -> DataFrame:
    back = trust.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return trust.join(back, ["src", "dst"], "left_anti")


def undirected(trust: DataFrame) -> DataFrame:
    """(a, b, kind), a < b: ``m`` mutual, ``f`` a to b, ``r`` b to a."""
    ends = trust.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (F.col("src") < F.col("dst")).alias("up"))
    return ends.groupBy("a", "b").agg(F.when(F.min("up") != F.max("up"), "m").when(F.max("up"), "f").otherwise("r").alias("kind"))


def _pointed(edges: DataFrame) -> DataFrame:
    """(x, y, kind): edges (a, b, kind) from the end of lower degree to that of higher degree, ``f`` and ``r`` along them."""
    degree = edges.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("d"))
    both = edges.join(degree.select(F.col("v").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("v").alias("b"), F.col("d").alias("db")), "b")
    low = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    turned = F.when(low | (F.col("kind") == "m"), F.col("kind")).otherwise(F.translate("kind", "fr", "rf"))
    return both.select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("y"), turned.alias("kind"))


def _of_one_kind(edges: DataFrame) -> DataFrame:
    """(x, y, z, xy, xz, yz): triangles of pointed edges."""
    out = materialize(_pointed(edges), "pointed")  # read twice; of known size, so small ones are broadcast
    kind = F.when(F.col("kind") == "f", 0).when(F.col("kind") == "r", 1).otherwise(2)
    found = intersections(out.select("x", "y", kind.alias("c")), out.select(F.col("x").alias("v"), F.col("y").alias("z"), kind.alias("to")))
    name = lambda c: F.element_at(F.array(*map(F.lit, "frm")), F.col(c) + 1).alias(c)
    return found.select("x", "y", "z", name("c").alias("xy"), name("xz"), name("yz"))


#: Pairs of an edge and a neighbour of its lower end that a block of edges has.
BLOCK_PAIRS = 1 << 22


def intersections(edges: DataFrame, near: DataFrame) -> DataFrame:
    """(x, y, z, c, xz, yz): each edge (x, y, c) with every z that is ``near`` (v, z, to) both x and y, ``xz`` and ``yz`` being the ``to``.

    Neighbours travel as one array, once to each block of edges that needs them, and are met in the block: no pair of an edge and a
    neighbour is a row. For pointed edges, whose lists have no more than the root of twice the edges; an x with many is in several blocks.
    """
    lists = near.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("z", F.col("to").cast("byte").alias("to")))).alias("s"))
    lists = materialize(lists.select("v", F.col("s.z").alias("zs"), F.col("s.to").alias("tos")), "lists")
    work = lists.select(F.col("v").alias("u"), F.size("zs").cast("long").alias("d")).withColumn("n", F.col("d") * F.col("d"))
    tasks = max(1, edges.sparkSession.sparkContext.defaultParallelism)
    pairs = work.agg(F.sum("n")).first()[0] or 0
    # edges of near x together: their y are often the same
    blocks = small(in_blocks(work.select("u", "n"), max(1, min(BLOCK_PAIRS, pairs // (4 * tasks)))), 16)
    share = F.pmod(F.xxhash64("y"), F.ceil(F.col("n") / BLOCK_PAIRS).cast("long"))
    placed = edges.join(small(work.join(blocks, "u").select(F.col("u").alias("x"), "n", "block"), 24), "x")
    ends = materialize(placed.select("block", share.alias("share"), "x", "y", F.col("c").cast("byte").alias("c")), "ends")
    needs = ends.select("block", "share", F.explode(F.array("x", "y")).alias("v")).distinct()
    sent = needs.join(lists, "v").select("block", "share", F.lit(0).alias("kind"), F.col("v").alias("x"), F.lit(None).cast("long").alias("y"), F.lit(None).cast("byte").alias("c"), "zs", "tos")
    asked = ends.select("block", "share", F.lit(1).alias("kind"), "x", "y", "c", F.lit(None).cast("array<bigint>").alias("zs"), F.lit(None).cast("array<tinyint>").alias("tos"))
    parts = max(4 * tasks, -(-pairs // BLOCK_PAIRS))
    every = sent.unionByName(asked).repartition(parts, "block", "share").sortWithinPartitions("block", "share", "kind")

    def run(batches):
        key, lists, edges = None, [], []
        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy().astype(np.int64) for c in ("block", "share")])
            cuts = [0, *(np.flatnonzero(np.any(np.diff(keys, axis=0), axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if key is None or key != tuple(keys[a]):
                    yield from _met(lists, edges)
                    key, lists, edges = tuple(keys[a]), [], []
                rows = batch.slice(a, b - a)
                m = int(np.searchsorted(rows.column("kind").to_numpy(), 1))
                if m:
                    some = rows.slice(0, m)
                    lists.append([some.column("x").to_numpy(), some.column("zs").value_lengths().to_numpy(), some.column("zs").flatten().to_numpy(), some.column("tos").flatten().to_numpy()])
                if m < rows.num_rows:
                    some = rows.slice(m)
                    edges.append([some.column(c).to_numpy(zero_copy_only=False) for c in "xyc"])
        yield from _met(lists, edges)

    return every.mapInArrow(run, "x long, y long, z long, c byte, xz byte, yz byte")


#: Marks of lists that a block looks up at once.
MARKS = 1 << 25


def _met(lists: list, edges: list, at_once: int = 1 << 20):
    """The common neighbours of edges' ends: the shorter list of the two is looked up in the other.

    Edges go in the order of the end with the longer list. The lists of some of these ends stand as rows of marks, and a neighbour
    of the other end is one look at its mark.
    """
    if not lists or not edges:
        return
    v, n, z, to = (np.concatenate(c) for c in zip(*lists, strict=True))
    x, y, c = (np.concatenate(e) for e in zip(*edges, strict=True))
    names, codes = _coded(z)
    n, to, order = n.astype(np.int64), to.astype(np.int8), np.argsort(v)
    start, v_sorted = np.cumsum(n) - n, v[order]
    px, py = (np.minimum(np.searchsorted(v_sorted, e), len(v) - 1) for e in (x, y))
    both = np.flatnonzero((v_sorted[px] == x) & (v_sorted[py] == y))
    x, y, c, px, py = x[both], y[both], c[both], order[px[both]], order[py[both]]
    turned = n[px] > n[py]
    by = np.lexsort((x, np.where(turned, px, py)))
    x, y, c, turned, px, py = x[by], y[by], c[by], turned[by], px[by], py[by]
    short, long = np.where(turned, py, px), np.where(turned, px, py)
    rank = np.cumsum(np.diff(long, prepend=long[:1]) != 0)  # of the longer list among those of the edges
    rows = max(1, MARKS // max(1, len(names)))
    marks = np.zeros((min(rows, 1 + int(rank[-1])) if len(rank) else 0) * len(names), dtype=np.int8)
    m = n[short]
    ends, i = np.cumsum(m), 0
    while i < len(x):
        j = max(i + 1, min(int(np.searchsorted(ends, (ends[i - 1] if i else 0) + at_once, "right")), int(np.searchsorted(rank, rank[i] + rows))))
        row = (rank[i:j] - rank[i]) * len(names)
        first = np.flatnonzero(np.diff(row, prepend=-1))
        held = long[i:j][first]
        terms = _stretches(start[held], n[held])
        marked = np.repeat(row[first], n[held]) + codes[terms]
        marks[marked] = 1 + to[terms]
        at = _stretches(start[short[i:j]], m[i:j])
        seen = marks[np.repeat(row, m[i:j]) + codes[at]]
        hit = np.flatnonzero(seen)
        edge, at, there = np.repeat(np.arange(i, j), m[i:j])[hit], at[hit], seen[hit] - np.int8(1)
        marks[marked] = 0
        back = turned[edge]
        xz, yz = np.where(back, there, to[at]), np.where(back, to[at], there)
        if len(hit):
            yield pa.RecordBatch.from_arrays([pa.array(q) for q in (x[edge], y[edge], z[at], c[edge], xz, yz)], ["x", "y", "z", "c", "xz", "yz"])
        i = j


def _coded(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of ``z``, and the place of each of ``z`` among them; without a sort where they are close together."""
    low = int(z.min()) if len(z) else 0
    span = (int(z.max()) - low + 1) if len(z) else 0
    if span > 4 * len(z):
        return np.unique(z, return_inverse=True)
    here = np.zeros(span, dtype=bool)
    here[z - low] = True
    return np.flatnonzero(here) + low, (np.cumsum(here) - 1)[z - low]


def _stretches(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, .. of each stretch of length n, one stretch after another."""
    return np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n)


#: Neighbours of one vertex that meet an edge in one place.
HEAVY = 1 << 12


def _both_ways(edges: DataFrame) -> DataFrame:
    """(v, z, to) of both ends of edges (a, b, to, back)."""
    side = lambda v, z, to: F.struct(F.col(v).alias("v"), F.col(z).alias("z"), F.col(to).alias("to"))
    return edges.select(F.explode(F.array(side("a", "b", "to"), side("b", "a", "back"))).alias("s")).select("s.v", "s.z", "s.to")


def _closed(edges: DataFrame, near: DataFrame) -> DataFrame:
    """(x, y, z, xz, yz): each edge (a, b) with every z that is near both of its ends.

    An edge walks the list of the end that has fewer neighbours, so a hub's list is walked by no edge but to another
    hub; lists longer than ``HEAVY`` are in several parts, and an edge meets each of these in a place of its own.
    """
    near = materialize(near, "near")
    degree = materialize(near.groupBy("v").agg(F.count("*").alias("d")), "near-degree")
    of = lambda c: degree.select(F.col("v").alias(c), F.col("d").alias(f"d{c}"))
    ends = edges.select("a", "b").join(of("a"), "a").join(of("b"), "b")
    low = F.col("da") <= F.col("db")
    ends = ends.select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("y"), F.least("da", "db").alias("d"))
    parts = F.ceil(F.col("d") / HEAVY)
    ends = ends.select("x", "y", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    lists = near.join(degree, "v").select(F.col("v").alias("x"), "z", F.col("to").alias("xz"), F.pmod(F.xxhash64("z"), parts).alias("part"))
    return ends.join(lists, ["x", "part"]).join(near.select(F.col("v").alias("y"), "z", F.col("to").alias("yz")), ["y", "z"]).select("x", "y", "z", "xz", "yz")


def triangles(trust: DataFrame, motifs: tuple[str, ...] = MOTIFS) -> DataFrame:
    """(x, y, z, motif), each triangle once."""
    edges = materialize(undirected(trust), "edges")
    mutual, single = edges.where("kind = 'm'"), edges.where("kind <> 'm'")
    wanted, found = set(motifs), []
    if wanted & {"m1", "m5"}:
        cycle = ((F.col("xy") == F.col("yz")) & (F.col("xz") != F.col("xy")))
        found.append(_of_one_kind(single).select("x", "y", "z", F.when(cycle, "m1").otherwise("m5").alias("motif")))
    if "m4" in wanted:
        found.append(_of_one_kind(mutual).select("x", "y", "z", F.lit("m4").alias("motif")))
    if "m3" in wanted:
        # two mutual edges out of z, the ends of a one-way edge
        closed = _closed(single, _both_ways(mutual.select("a", "b", F.lit(True).alias("to"), F.lit(True).alias("back"))))
        found.append(closed.select("x", "y", "z", F.lit("m3").alias("motif")))
    if wanted & {"m2", "m6", "m7"}:
        # two one-way edges out of or into z, the ends of a mutual edge
        up = F.col("kind") == "f"
        closed = _closed(mutual, _both_ways(single.select("a", "b", up.alias("to"), (~up).alias("back"))))
        motif = F.when(F.col("xz") & F.col("yz"), "m7").when(~F.col("xz") & ~F.col("yz"), "m6").otherwise("m2")
        found.append(closed.select("x", "y", "z", motif.alias("motif")))
    rows = found[0]
    for f in found[1:]:
        rows = rows.union(f)
    return rows.where(F.col("motif").isin(*motifs))


def all_motifs(trust: DataFrame, motifs: tuple[str, ...] = MOTIFS) -> DataFrame:
    """(motif, i, j, w) of clean edges: w triangles of the motif hold the pair. Symmetric, no diagonal.

    A triangle's three unordered pairs are counted, and each count stands for both orders.
    """
    pair = lambda p, q: F.struct(F.least(p, q).alias("i"), F.greatest(p, q).alias("j"))
    sides = F.array(*[pair(p, q) for p, q in ("xy", "xz", "yz")])
    counts = triangles(trust, motifs).select("motif", F.explode(sides).alias("s")).groupBy("motif", "s.i", "s.j").agg(F.count("*").alias("w"))
    orders = F.explode(F.array(*[F.struct(F.col(p).alias("i"), F.col(q).alias("j")) for p, q in ("ij", "ji")])).alias("o")
    return counts.select("motif", orders, "w").select("motif", "o.i", "o.j", "w")


def motif_matrix(trust: DataFrame, motif: str) -> DataFrame:
    """(i, j, w) of one motif."""
    if motif not in MOTIFS:
        raise ValueError(f"no motif {motif!r}; there are {', '.join(MOTIFS)}")
    return all_motifs(trust, (motif,)).select("i", "j", "w")


# The definition of the motifs. Each is a sum of products (left . right) o mask, written as
# three letters: U one-way edges, B mutual edges, V the transpose of U. The second entry tells whether
# the sum is added to its transpose.
TERMS = {
    "m1": ("UUV", True),
    "m2": ("BUV UBV UUB", True),
    "m3": ("BBU BUB UBB", True),
    "m4": ("BBB", False),
    "m5": ("UUU UVU VUU", True),
    "m6": ("UBU BVV VUB", False),
    "m7": ("VBV BUU UVB", False),
}


def motif_by_terms(trust: DataFrame, motif: str) -> DataFrame:
    unit = lambda e: e.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(1).cast("long").alias("w"))
    u, b = unit(one_way(trust)), unit(mutual(trust))
    of = {"U": u, "B": b, "V": transpose(u)}
    terms, symmetric = TERMS[motif]
    c = add(*[masked_multiply(*(of[x] for x in t)) for t in terms.split()])
    return add(c, transpose(c)) if symmetric else c
