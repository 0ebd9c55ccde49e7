"""Sparse matrices as (i, j, w): a product is made row by row, in blocks of rows; a Hadamard product is a join on both."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tricord.operators.prep import in_blocks
from tricord.plans.storage import materialize, small

#: Terms of a product's sums in a block of rows, and terms that are added up at once.
BLOCK_TERMS, AT_ONCE = 1 << 22, 1 << 20


def adjacency(edges: DataFrame, i: str, j: str, weight: Column | None = None) -> DataFrame:
    """Duplicates are summed; the weight is 1 where none is given."""
    return edges.groupBy(F.col(i).alias("i"), F.col(j).alias("j")).agg(F.sum(F.lit(1).cast("long") if weight is None else weight).alias("w"))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")


def scale(m: DataFrame, factor: Column | float) -> DataFrame:
    return m.withColumn("w", F.col("w") * factor)


def add(*ms: DataFrame) -> DataFrame:
    rows = ms[0].select("i", "j", "w")
    for m in ms[1:]:
        rows = rows.union(m.select("i", "j", "w"))
    return rows.groupBy("i", "j").agg(F.sum("w").alias("w"))


def subtract(x: DataFrame, y: DataFrame) -> DataFrame:
    """Cells that come to 0 are left out."""
    return add(x, scale(y, F.lit(-1))).where("w <> 0")


def hadamard(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.join(y.withColumnRenamed("w", "w2"), ["i", "j"]).select("i", "j", (F.col("w") * F.col("w2")).alias("w"))


def multiply(x: DataFrame, y: DataFrame) -> DataFrame:
    """X.Y. Both sides should be aggregated, so a middle index meets each row and column once.

    Rows of Y travel as arrays, once to each block of rows of X that needs them, and a row of the product is summed
    where its block is: no term of a sum is a row or moves. A block has a bounded number of terms, but that one row of X isn't in several
    blocks. Matrices of other than integers are joined.
    """
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if not all(isinstance(m.schema[c].dataType, whole) for m in (x, y) for c in "ijw"):
        return joined_multiply(x, y)
    kinds = (x.schema["i"].dataType, y.schema["j"].dataType)
    x, y = (m.select(*[F.col(c).cast("long").alias(c) for c in "ijw"]).where("i IS NOT NULL AND j IS NOT NULL AND w IS NOT NULL") for m in (x, y))
    x = materialize(x, "left")
    lists = materialize(y.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "w"))).alias("s")).select(F.col("i").alias("k"), F.col("s.j").alias("js"), F.col("s.w").alias("ws")), "rows")
    lengths = lists.select(F.col("k").alias("j"), F.size("js").cast("long").alias("n"))
    work = materialize(x.join(lengths, "j").groupBy("i").agg(F.sum("n").alias("n")), "work")
    tasks, terms = max(1, x.sparkSession.sparkContext.defaultParallelism), work.agg(F.sum("n")).first()[0] or 0
    blocks = small(in_blocks(work, max(1, min(BLOCK_TERMS, terms // (4 * tasks))), ("i",)), 16)
    placed = x.join(blocks, "i").select("block", "i", F.col("j").alias("k"), "w")
    none = F.lit(None).cast("array<bigint>")
    sent = placed.select("block", "k").distinct().join(lists, "k").select("block", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("i"), "k", F.lit(0).cast("long").alias("w"), "js", "ws")
    asked = placed.select("block", F.lit(1).alias("kind"), "i", "k", "w", none.alias("js"), none.alias("ws"))
    every = sent.unionByName(asked).repartition(max(4 * tasks, -(-terms // BLOCK_TERMS)), "block").sortWithinPartitions("block", "kind", "i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lists, cells = None, [], []
        for batch in batches:
            at = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if key != at[a]:
                    yield from _rows(lists, cells)
                    key, lists, cells = at[a], [], []
                rows = batch.slice(a, b - a)
                m = int(np.searchsorted(rows.column("kind").to_numpy(), 1))
                if m:
                    some = rows.slice(0, m)
                    lists.append([some.column("k").to_numpy(), some.column("js").value_lengths().to_numpy().astype(np.int64), some.column("js").flatten().to_numpy(), some.column("ws").flatten().to_numpy()])
                if m < rows.num_rows:
                    cells.append([rows.slice(m).column(c).to_numpy() for c in "ikw"])
        yield from _rows(lists, cells)

    return every.mapInArrow(run, "i long, j long, w long").select(F.col("i").cast(kinds[0]).alias("i"), F.col("j").cast(kinds[1]).alias("j"), "w")


def _rows(lists: list, cells: list) -> Iterator[pa.RecordBatch]:
    """Rows of the product of ``cells`` (i, k, w), in the order of i, with the rows ``lists`` (k, length, j, w) of the other matrix."""
    if not lists or not cells:
        return
    k, n, j, v = (np.concatenate(c) for c in zip(*lists, strict=True))
    i, at, w = (np.concatenate(c) for c in zip(*cells, strict=True))
    start, (names, codes) = np.cumsum(n) - n, np.unique(j, return_inverse=True)
    order = np.argsort(k)
    place = order[np.minimum(np.searchsorted(k, at, sorter=order), len(k) - 1)]
    there = np.flatnonzero(k[place] == at)
    i, place, w = i[there], place[there], w[there]
    m = n[place]
    ends, low, rest = np.cumsum(m), 0, None
    while low < len(i):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + AT_ONCE, "right")))
        of, some = np.repeat(np.arange(low, high), m[low:high]), m[low:high]
        terms = np.arange(some.sum()) + np.repeat(start[place[low:high]] + some - np.cumsum(some), some)
        rows, number = np.unique(i[low:high], return_inverse=True)
        cell, value = number[of - low] * len(names) + codes[terms], w[of] * v[terms]
        size = float(np.abs(w[of].astype(float) * v[terms]).sum())
        if rest is not None:  # what the row's earlier terms came to
            cell, value, size = np.concatenate((cell, rest[0])), np.concatenate((value, rest[1])), size + float(np.abs(rest[1].astype(float)).sum())
        if size >= 2**63:
            raise OverflowError("a product's sums pass 64 bits")
        if len(rows) * len(names) <= 8 * len(cell) and size < 2**53:  # exact in doubles
            found = np.flatnonzero(np.bincount(cell, minlength=len(rows) * len(names)))
            sums = np.bincount(cell, weights=value, minlength=len(rows) * len(names))[found].astype(np.int64)
        else:
            by = np.argsort(cell, kind="stable")
            first = np.flatnonzero(np.diff(cell[by], prepend=-1))
            found, sums = cell[by][first], np.add.reduceat(value[by], first)
        rest = None
        if high < len(i) and i[high] == rows[-1]:
            cut = int(np.searchsorted(found, (len(rows) - 1) * len(names)))
            rest = found[cut:] - (len(rows) - 1) * len(names), sums[cut:]  # the next turn's first row
            found, sums = found[:cut], sums[:cut]
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(rows[found // len(names)]), pa.array(names[found % len(names)]), pa.array(sums)], ["i", "j", "w"])
        low = high


def joined_multiply(x: DataFrame, y: DataFrame) -> DataFrame:
    """X.Y as a join and a sum: a row for each term. Hot middle indices are AQE's to split."""
    left, right = x.select("i", F.col("j").alias("k"), F.col("w").alias("w1")), y.select(F.col("i").alias("k"), "j", F.col("w").alias("w2"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("w1") * F.col("w2")).alias("w"))


def masked_multiply(x: DataFrame, y: DataFrame, mask: DataFrame) -> DataFrame:
    """(X.Y) o Mask for a 0/1 mask. The mask is a semi-join below the sum, so cells outside of it are never summed."""
    left, right = x.select("i", F.col("j").alias("k"), F.col("w").alias("w1")), y.select(F.col("i").alias("k"), "j", F.col("w").alias("w2"))
    return left.join(right, "k").join(mask.select("i", "j"), ["i", "j"], "left_semi").groupBy("i", "j").agg(F.sum(F.col("w1") * F.col("w2")).alias("w"))
