"""Operator 2: benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A mask is a short pattern of token positions that count (1) or are ignored (0). Every window of
every training text and of every benchmark item is hashed under every mask; equal hashes are hits
of an item on a diagonal (where in the text its first word would stand). Since the masks ignore
different positions, a passage with some words replaced still hits. Around each hit the whole item
is laid along its diagonal and compared word by word, ``1`` for an equal word and ``-2`` for another
one: a leak has ``min_share`` of the item's words, or a stretch that scores ``min_score``. An item of
fewer words than a mask spans has no window; it is looked for as a whole, its words one after
another (for each such length that the benchmark has, a mask of ones), so no item is left out.

A document's hits of an item come in lists of ``DIAGONALS`` at most, however often the text repeats
a phrase of it. Tables are broadcast only up to a number of bytes that is measured, else joins
shuffle.

Words are runs of letters and digits, in lower case. Rows: texts without words (null, empty) leak
nothing and items without words are not looked for; items of the same words count as one, the
smallest id; very long texts are read whole; repeated documents are judged each, and rows that
repeat an id give one row for each item; a null id takes part as an id of its own; other columns
are ignored; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small, unused

MASKS = ("1101011", "1011101", "1110011")
DIAGONALS = 1024


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def seeds(word_hashes: str, masks: tuple[str, ...]) -> Column:
    """An array of (pos, hashes) over all windows of the longest mask, hashes having one for each mask."""
    span = max(map(len, masks))
    at = lambda i, k: F.get(word_hashes, i + k)
    # a mask of its own length goes with its hash, so that masks of different lengths never meet
    one = lambda i, mask: F.xxhash64(F.lit(mask), *[at(i, k) for k, c in enumerate(mask) if c == "1"])
    windows = F.when(F.size(word_hashes) >= span, F.sequence(F.lit(0), F.size(word_hashes) - span)).otherwise(F.array().cast("array<int>"))
    return F.transform(windows, lambda i: F.struct(i.alias("pos"), F.array(*[one(i, mask) for mask in masks]).alias("hashes")))


def _seed_rows(rows: DataFrame, keys: list[str], masks: tuple[str, ...]) -> DataFrame:
    hashed = rows.select(*keys, F.transform("words", lambda w: F.xxhash64(w)).alias("w"))
    # outer: for explode() a filter on the array's size is pushed below, which makes the array once more for each of its elements
    spread = hashed.select(*keys, F.explode_outer(seeds("w", masks)).alias("s"))
    return spread.select(*keys, F.col("s.pos").alias("pos"), F.explode_outer("s.hashes").alias("seed")).where(F.col("seed").isNotNull())


def leaks(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, min_share: float = 0.7, min_score: int = 10) -> DataFrame:
    """(doc_id, item_id, position, item_words, matched, score): a row for each document and item that it leaks.

    ``position`` is the word of the document at which the item's first word stands (it may be
    negative when the passage begins inside the item), of the best of its diagonals.
    """
    span = max(map(len, masks))
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = items.groupBy("words").agg(F.min("item_id").alias("item_id"))
    items = materialize(items.select(F.xxhash64("words").alias("item"), "item_id", "words"), "items")
    lengths = sorted(r["n"] for r in items.select(F.size("words").alias("n")).where(F.col("n") < span).distinct().collect())  # span - 1 numbers at most
    of_items = _seed_rows(items, ["item"], masks)
    for n in lengths:
        of_items = of_items.unionByName(_seed_rows(items.where(F.size("words") == n), ["item"], ("1" * n,)))
    item_seeds = materialize(of_items.select("item", F.col("pos").alias("item_pos"), "seed"), "seeds")
    texts = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("words"))
    of_texts = _seed_rows(texts, ["id", "text_hash"], masks)
    for n in lengths:
        of_texts = of_texts.unionByName(_seed_rows(texts, ["id", "text_hash"], ("1" * n,)))
    found = of_texts.join(small(item_seeds, 48), "seed")
    hits = found.select("id", "text_hash", "item", (F.col("pos") - F.col("item_pos")).alias("position")).distinct()
    hits = materialize(hits, "hits")
    # every document with hits is read once more; lists of diagonals keep its words from being made once for each
    lists = hits.groupBy("id", "text_hash", "item", F.floor(F.col("position") / DIAGONALS).alias("part")).agg(F.collect_list("position").alias("at"))
    sides = materialize(lists.select(F.col("id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), "item", "at"), "diagonals")
    sides = small(sides, 96 + 4 * F.size("at").cast("long"))
    near = texts.join(sides, texts["id"].eqNullSafe(sides["hit_id"]) & (texts["text_hash"] == sides["hit_hash"])).select("id", "item", "at", "words")
    said = items.select("item", "item_id", F.col("words").alias("said"))
    near = near.join(small(said, F.aggregate("said", F.lit(64).cast("long"), lambda a, w: a + 24 + F.octet_length(w))), "item")
    # the item along each diagonal, past the document's ends equal to nothing
    equal = lambda p: F.transform("said", lambda w, k: F.when(p + k >= 0, F.get("words", p + k).eqNullSafe(w)).otherwise(False))
    laid = near.select("id", "item_id", F.size("said").alias("item_words"), F.transform("at", lambda p: F.struct(p.alias("position"), equal(p).alias("equal"))).alias("laid"))
    run = lambda e: F.aggregate(e, F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")), lambda a, x: _longer(a, x), lambda a: a["best"])
    scored = F.transform("laid", lambda x: F.struct(run(x["equal"]).alias("score"), F.size(F.filter(x["equal"], lambda e: e)).alias("matched"), (-x["position"]).alias("back")))
    leak = lambda x: (x["matched"] >= min_share * F.col("item_words")) | (x["score"] >= min_score)
    best = laid.select("id", "item_id", "item_words", scored.alias("scored")).select("id", "item_id", "item_words", F.array_max(F.filter("scored", leak)).alias("best"))
    top = best.groupBy("id", "item_id").agg(F.max("best").alias("t"), F.first("item_words").alias("item_words")).where(F.col("t").isNotNull())
    return top.select(F.col("id").alias("doc_id"), "item_id", *[c.cast("long").alias(n) for n, c in (("position", -F.col("t.back")), ("item_words", F.col("item_words")), ("matched", F.col("t.matched")), ("score", F.col("t.score")))])


def _longer(a: Column, equal: Column) -> Column:
    """The best stretch so far, one word on."""
    now = F.greatest(F.lit(0), a["now"] + F.when(equal, 1).otherwise(-2))
    return F.struct(now.alias("now"), F.greatest(a["best"], now).alias("best"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that leak no item, all columns as they are; rows without an id stay only if no such row leaks."""
    name = unused(docs, "leaking_id")
    bad = materialize(leaks(docs.select("doc_id", "text"), benchmark, **options).select(F.col("doc_id").alias(name)).distinct(), "leaks")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad[name]), "left_anti")
