"""Preparation: last-wins dedup, domains, id encoding, exact random splits, the trust filter."""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tricord.plans.storage import materialize


def dedup_last(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """One row for each key, with the value of the last in order. Aggregates before the shuffle."""
    return df.groupBy(*keys).agg(F.max(F.struct(*order, value))[value].alias(value))


def user_domain(ratings: DataFrame, trust: DataFrame) -> DataFrame:
    """Raters and both ends of trust edges, of all data rather than a split's."""
    return ratings.select(F.col("u").alias("id")).union(trust.select("src")).union(trust.select("dst")).distinct()


def item_domain(ratings: DataFrame) -> DataFrame:
    return ratings.select(F.col("b").alias("id")).distinct()


def encode_ids(ids: DataFrame) -> DataFrame:
    """(id, ind): distinct ids numbered gaplessly from 0 in their order.

    Ids are dealt by ranges, numbered within a range, and moved on by the counts of the ranges before.
    """
    dealt = materialize(ids.select("id").distinct().repartitionByRange("id").withColumn("part", F.spark_partition_id()), "ids")
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    starts = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))  # a row for each partition
    rank = F.row_number().over(Window.partitionBy("part").orderBy("id"))
    return dealt.join(F.broadcast(starts), "part").select("id", (F.col("start") + rank - 1).cast("long").alias("ind"))


def in_blocks(rows: DataFrame, target: int, keys: tuple[str, ...] = ("u",)) -> DataFrame:
    """(keys, block) of ``rows`` (keys, n): ranges in the order of their keys whose n come to about ``target``. Ids near each other often share neighbours."""
    dealt = materialize(rows.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "in-ranges")
    counts = dealt.groupBy("part").agg(F.sum("n").alias("n"))
    starts = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))  # a row for each partition
    before = F.sum("n").over(Window.partitionBy("part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1))
    at = (F.col("start") + F.coalesce(before, F.lit(0))) / F.lit(target)
    return materialize(dealt.join(F.broadcast(starts), "part").select(*keys, F.floor(at).cast("int").alias("block")), "blocks")


#: Parts of a split and their shares; the last one takes the rest.
SHARES = (("train", 0.8), ("test", 0.1), ("val", 1.0))
TWO_SHARES = (("train", 0.8), ("test", 1.0))


def decode_ids(rows: DataFrame, encoded: DataFrame, column: str) -> DataFrame:
    """``rows`` with the ids for the numbers that ``encode_ids`` gave them in ``column``; numbers of no id go."""
    names = encoded.select(F.col("ind").alias(column), F.col("id").alias("_id"))
    return rows.join(names, column).select(*[F.col("_id").alias(c) if c == column else F.col(c) for c in rows.columns])


def split_ratings(ratings: DataFrame, seed: int = 1, shares: tuple[tuple[str, float], ...] = SHARES) -> DataFrame:
    """``ratings`` with ``split``: exact sizes floor(share * n) in the order of a seeded hash, the last part taking the rest."""
    return five_splits(ratings, [seed], shares).drop("split_no")


def five_splits(ratings: DataFrame, seeds: list[int] | tuple[int, ...] = (1, 2, 3, 4, 5), shares: tuple[tuple[str, float], ...] = SHARES) -> DataFrame:
    """Independent splits side by side: ``split_no`` (the seed) and ``split``.

    Sizes are exact without a rank: the hashes at which one part ends and the next begins are found by counting, and a row's
    part is a comparison with them, so no rating is sorted or shuffled. Rows that repeat (u, b) have one hash and stay together.
    """
    ratings = materialize(ratings, "ratings")
    each = ratings.withColumn("split_no", F.explode(F.array(*[F.lit(s) for s in seeds])))
    hashed = each.withColumn("_h", F.md5(F.concat_ws(":", "split_no", "u", "b")))
    cuts = cut_hashes(hashed.select("split_no", "_h"), [share for _, share in shares[:-1]])
    split = F.lit(shares[-1][0])
    for k in reversed(range(len(shares) - 1)):
        at = F.element_at(F.create_map(*[F.lit(x) for s in seeds for x in (s, cuts[s][k] if s in cuts else "")]), F.col("split_no"))
        split = F.when(F.col("_h") < at, shares[k][0]).otherwise(split)
    return hashed.select(*ratings.columns, split.alias("split"), "split_no")


#: Hexadecimal digits of a hash that a round of ``cut_hashes`` looks at, and hashes that it takes to the driver for a cut.
ROUND, LAST = 3, 1000


def cut_hashes(hashed: DataFrame, shares: list[float]) -> dict[int, list[str]]:
    """Per ``split_no`` of ``hashed`` (split_no, _h), which are few, the hashes below which the first floor(share * n) rows lie, share after share.

    Rows are counted by their hashes' first digits; those of the buckets in which cuts lie are written out, and of these the next
    digits are looked at until a bucket is small. So all rows are read twice, whatever their number. A round is an aggregation that
    is partial before its shuffle: 4096 rows for each split and cut.
    """
    found: dict[int, list[str]] = {}
    open_: dict[tuple[int, int], tuple[str, int, int]] = {}  # split, cut -> prefix, rows of the bucket, rows of it below the cut

    def count(rows: DataFrame, digits: int) -> dict[int, list[tuple[str, int]]]:
        by = defaultdict(list)
        for s, prefix, n in rows.groupBy("split_no", F.substring("_h", 1, digits)).agg(F.count("*")).collect():
            by[s].append((prefix, n))
        return by

    def narrow(by: dict[int, list[tuple[str, int]]]) -> None:
        for (s, k), (prefix, _, below) in open_.items():
            for bucket, n in sorted(x for x in by[s] if x[0].startswith(prefix)):
                if below < n:
                    open_[s, k] = (bucket, n, below)
                    break
                below -= n

    def near(rows: DataFrame, digits: int) -> DataFrame:
        wanted = {f"{s}:{prefix}" for (s, _), (prefix, _, _) in open_.items()}
        return rows.where(F.concat_ws(":", "split_no", F.substring("_h", 1, digits)).isin(*wanted))

    by = count(hashed, ROUND)
    for s, buckets in by.items():
        total, done = sum(n for _, n in buckets), 0
        found[s] = ["g"] * len(shares)  # above all digits: everything is below
        for k, share in enumerate(shares):
            done += math.floor(total * share)
            if done < total:
                open_[s, k] = ("", total, done)
    if not open_:
        return found
    narrow(by)
    digits = ROUND
    base = materialize(near(hashed, digits), "near-cuts")
    while any(size > LAST for _, size, _ in open_.values()) and digits < 32:
        digits += ROUND
        narrow(count(near(base, digits - ROUND), digits))
    last = defaultdict(list)
    for s, h, n in near(base, digits).groupBy("split_no", "_h").agg(F.count("*")).collect():
        last[s].append((h, n))
    for (s, k), (prefix, _, below) in open_.items():
        for h, n in sorted(x for x in last[s] if x[0].startswith(prefix)):
            if below < n:
                found[s][k] = h
                break
            below -= n
    return found


def train_of(split: DataFrame) -> DataFrame:
    return split.where("split = 'train'").drop("split")


def social_filter(trust: DataFrame, train: DataFrame) -> DataFrame:
    """Edges of which either end has rated in ``train``; each edge once, however many ends match."""
    users = train.select(F.col("u").alias("id")).distinct()
    marked = trust.join(users.select(F.col("id").alias("src"), F.lit(True).alias("a")), "src", "left").join(users.select(F.col("id").alias("dst"), F.lit(True).alias("b")), "dst", "left")
    return marked.where("a OR b").select("src", "dst")
