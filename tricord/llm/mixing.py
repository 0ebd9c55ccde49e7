"""Operator 13: mixing sources to target weights by hash-threshold histograms.

Sources weigh 5, 2, 1, 5, ... in their order by code point (null last) and share ``share`` of all
words by weight; no source gets more than ``repeats`` times its own words, what is over goes to the others by weight. A
document is taken as often as its source's target holds the whole source, and once more if its hash is at most the
source's threshold. A larger budget has a larger threshold, so the choices are nested. Thresholds come from histograms: words are summed by source and hash bucket, the budget ends in one
bucket of each source, and only that bucket is split further, 12 bits a round, until it holds one
hash. That last one is taken if this comes nearer to the target. Nothing is sorted or ranked but
buckets and sources.

Sums are combined before they are shuffled, so a hot source is at most 4096 rows a task; sources and
their thresholds are tables, broadcast only if small. Of any number of sources only sums come to the driver: how much
is left to share, and among which weights, until no source is above its limit.

Rows: a null text has no words; a null source is a source of its own, and so is an empty one; the hash covers id and text, so
rows that repeat both are taken alike; documents without words are never counted; very long texts are whole documents, so a
source may miss its target by half its largest document; other columns stay, those named as the
result's are replaced; an empty table gives no rows. No document is taken more than ``repeats`` times.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small

WEIGHTS = (5, 2, 1)
#: Bits of a document's hash, and how many of them a round looks at.
BITS, ROUND = 60, 12
ADDED = ("size", "source_size", "target", "copies", "taken")


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def document_hash() -> Column:
    """The first 60 bits of the MD5 of ``doc_id:text``."""
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, BITS // 4), 16, 10).cast("long")


def ranked(sizes: DataFrame) -> DataFrame:
    """(source, source_size, place): place counts sources by code point, null last; no task sorts all of them."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    dealt = per.withColumn("last", F.col("source").isNull()).repartitionByRange("last", "source").sortWithinPartitions("last", "source")
    local = F.monotonically_increasing_id()
    dealt = materialize(dealt.select("source", "source_size", F.shiftright(local, 33).alias("part"), local.bitwiseAND((1 << 33) - 1).alias("at")), "sources")
    start, so_far = {}, 0
    for part, n in sorted(dealt.groupBy("part").count().collect()):  # a row per partition
        start[part], so_far = so_far, so_far + n
    first = F.create_map(*[F.lit(x).cast("long") for pair in start.items() for x in pair]) if start else F.lit(None).cast("map<bigint,bigint>")
    return dealt.select("source", "source_size", (first[F.col("part")] + F.col("at")).alias("place"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = Fraction(3, 2), repeats: int = 2) -> DataFrame:
    """(source, source_size, target): what each source gives to the mix."""
    every = ranked(sizes)
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    every = materialize(every.select("source", "source_size", weight.alias("weight")), "weights")
    exact, long = (lambda c: c.cast("decimal(38,0)")), (lambda x: F.lit(int(x)).cast("decimal(38,0)"))
    cap = F.col("source_size") * repeats
    total, rest_weight = every.agg(F.sum("source_size"), F.sum("weight")).first()
    rest, capped, full = share.numerator * (total or 0), F.lit(False), 0
    while rest_weight:
        # above its limit: rest / denominator * weight / rest_weight > cap
        capped = exact(F.col("weight")) * long(rest) > exact(cap) * long(share.denominator * rest_weight)
        n, taken, gone = every.where(capped).agg(F.count("*"), F.sum(cap), F.sum("weight")).first()
        if n == full:
            break
        full, rest = n, share.numerator * total - share.denominator * taken
        rest_weight = every.agg(F.sum("weight")).first()[0] - gone
    # one division of exact integers
    part = (F.col("weight") * F.lit(int(rest)).cast("long")).cast("double") / F.lit(float(share.denominator * (rest_weight or 1)))
    return every.select("source", "source_size", F.when(capped | F.lit(not rest_weight), cap.cast("double")).otherwise(part).alias("target"))


def same_source(a: str, b: str) -> Column:
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def row_bytes() -> Column:
    return F.coalesce(F.octet_length("source"), F.lit(0)) + 96


def thresholds(sizes: DataFrame, aims: DataFrame) -> DataFrame:
    """(source, source_size, target, whole, threshold): every document ``whole`` times, and once more if its hash is at most ``threshold``."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = aims.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    goal = materialize(goal, "goals")
    # open: sources whose budget ends inside a bucket: its prefix, and the words below it
    open_, done = goal.where("budget > 0").select("source", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below")), None
    for seen in range(0, BITS, ROUND):
        left, right = sizes.alias("l"), small(open_, row_bytes()).alias("r")
        on = same_source("l", "r") & (F.shiftright("l.hash", BITS - seen) == F.col("r.prefix"))
        bucket = F.shiftright("l.hash", BITS - seen - ROUND)
        rows = left.join(right, on).select("r.source", "r.budget", "r.below", bucket.alias("bucket"), "l.size", "l.hash")
        counted = rows.groupBy("source", "budget", "below", "bucket").agg(F.sum("size").alias("words"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        # at most 4096 buckets a source, one after another
        counted = counted.groupBy("source", "budget", "below").agg(F.sort_array(F.collect_list(F.struct("bucket", "words", "low", "high"))).alias("b"))
        start = F.struct(F.col("below").alias("below"), F.lit(None).cast("struct<bucket:bigint,words:bigint,low:bigint,high:bigint>").alias("end"))
        fits = lambda s, x: s["end"].isNull() & (s["below"] + x["words"] <= F.col("budget"))
        step = lambda s, x: F.when(fits(s, x), F.struct((s["below"] + x["words"]).alias("below"), s["end"].alias("end"))).otherwise(F.struct(s["below"].alias("below"), F.coalesce(s["end"], x).alias("end")))
        found = counted.select("source", "budget", F.aggregate("b", start, step).alias("s")).where("s.end IS NOT NULL")  # none: all of the source
        found = materialize(found.select("source", "budget", F.col("s.end.bucket").alias("prefix"), F.col("s.below").alias("below"), F.col("s.end.words").alias("words"), F.col("s.end.low").alias("low"), F.col("s.end.high").alias("high")), "cuts")
        ended = found.where("low = high").select("source", F.when(2 * F.col("budget") > 2.0 * F.col("below") + F.col("words"), F.col("low")).otherwise(F.col("low") - 1).alias("threshold"))
        done = ended if done is None else done.unionByName(ended)
        open_ = found.where("low < high").select("source", "budget", "prefix", "below")
        if open_.isEmpty():
            break
    goal, done = goal.alias("g"), done.alias("d")
    last = F.when(F.col("g.budget") > 0, F.lit(1 << BITS)).otherwise(F.lit(-1))
    return goal.join(done, same_source("g", "d"), "left").select("g.source", "g.source_size", "g.target", "g.whole", F.coalesce("d.threshold", last).alias("threshold"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = Fraction(3, 2), repeats: int = 2) -> DataFrame:
    """All columns of ``docs`` with size, source_size, target (the source's), copies and taken (size times copies)."""
    kept = [c for c in docs.columns if c.lower() not in ADDED]
    sizes = materialize(docs.select("source", words(F.col("text")).alias("size"), document_hash().alias("hash")), "sizes")
    cuts = small(materialize(thresholds(sizes, targets(sizes, weights, share, repeats)), "thresholds"), row_bytes()).alias("t")
    rows = docs.select(F.struct(*kept).alias("row"), "source", words(F.col("text")).alias("size"), document_hash().alias("hash")).alias("d")
    rows = rows.join(cuts, same_source("d", "t"))
    copies = F.col("t.whole") + (F.col("d.hash") <= F.col("t.threshold")).cast("long")
    return rows.select("d.row.*", "d.size", "t.source_size", "t.target", copies.alias("copies"), (F.col("d.size") * copies).alias("taken"))


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its number of the copy from 0."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
