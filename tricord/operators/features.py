"""Representations and design matrices: factors of several graphs side by side, users beside items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tricord.functions.vectors import zeros


def max_abs_scale(factors: DataFrame, rank: int, factor: float = 20.0) -> DataFrame:
    """Each dimension over its largest absolute value, times ``factor``; dimensions of zeros stay."""
    most = factors.agg(F.array(*[F.max(F.abs(F.get("features", F.lit(k)))) for k in range(rank)]).alias("most"))  # a single row
    scaled = F.zip_with("features", "most", lambda x, m: F.when(m > 0, x / m).otherwise(x) * factor)
    return factors.crossJoin(F.broadcast(most)).select("id", scaled.alias("features"))


def representation(domain: DataFrame, graphs: list[DataFrame], rank: int) -> DataFrame:
    """(id, features) of every id of the domain: the graphs' factors in their order, zeros where a graph has none.

    One pass: factors of all graphs are tagged with their place and meet by id, whatever the number of graphs.
    """
    tagged = [g.select("id", F.struct(F.lit(k).alias("place"), "features").alias("f")) for k, g in enumerate(graphs)]
    rows = domain.select("id", F.lit(None).cast("struct<place:int,features:array<double>>").alias("f"))
    for t in tagged:
        rows = rows.union(t)
    met = rows.groupBy("id").agg(F.max(F.col("f").isNull()).alias("known"), *[F.max(F.when(F.col("f.place") == k, F.col("f.features"))).alias(f"g{k}") for k in range(len(graphs))])
    return met.where("known").select("id", F.concat(*[F.coalesce(f"g{k}", zeros(rank)) for k in range(len(graphs))]).alias("features"))


def design_train(ratings: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """(u, b, x, y) of ratings; every user and item must have a representation, else ValueError."""
    rows = _design(ratings, users, items, "left").withColumn("_ok", F.col("uf").isNotNull() & F.col("bf").isNotNull())
    checked = F.when(F.col("_ok"), F.concat("uf", "bf")).otherwise(F.raise_error(F.lit("a training row's user or item has no representation")).cast("array<double>"))
    return rows.select("u", "b", checked.alias("x"), "y")


def design_test(ratings: DataFrame, users: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """(u, b, x, y); users and items without a representation (of ``width`` numbers) are zeros."""
    return _design(ratings, users, items, "left").select("u", "b", F.concat(F.coalesce("uf", zeros(width)), F.coalesce("bf", zeros(width))).alias("x"), "y")


def _design(ratings: DataFrame, users: DataFrame, items: DataFrame, how: str) -> DataFrame:
    rows = ratings.select("u", "b", F.col("rating").alias("y"))
    rows = rows.join(users.select(F.col("id").alias("u"), F.col("features").alias("uf")), "u", how)
    return rows.join(items.select(F.col("id").alias("b"), F.col("features").alias("bf")), "b", how)
