"""Operator 4: n-gram Jaccard join by a grouped prefix join, exact, with components.

Texts are sets of hashed word shingles (64 bits). Two sets of at least the similarity t share a
shingle among the first ``n - ceil(t n) + 1`` of each in any common order. The order here is by
frequency, then hash: one pass counts all shingles of all texts, so that a passage which many
documents hold stands last and isn't compared. Steps:

1. equal sets are one class, its smallest document id speaking for it;
2. classes with the same prefix and size are one group;
3. postings (shingle, group) are joined by shingle. Within a shingle's list, ordered by size, each
   group is first compared with the list's first one, with its predecessor, and with the one that
   has the fewest rarer shingles, which is the middle of a swarm of near copies. That needs a few
   pairs for a list of any length and connects copies of one text;
4. then all pairs of a list whose groups aren't connected yet are compared, after the size and the
   position filter. Every such pair has one side outside the list's largest component, so a list of
   copies costs nothing more, and no pair that could change a component is left out;
5. group pairs are expanded to their classes, and each pair of classes is verified on whole sets.

The table of frequent shingles that tasks hold is bounded by ``FREQUENT`` rows: shingles past it
keep their hash's place. The order decides how much is compared, never what is found. Shingles are
counted in hash ranges of about ``PER_RANGE`` keys each, as many as the texts' length asks for.

A shingle of ``HOT`` documents or more may have a list that no task should hold, so its list is
dealt to parts: predecessors are those within a part, the first and the middle one of the whole list
come from an aggregation that is partial before its shuffle, and where pairs of a list are made (4.),
each block of the one side meets each block of the other in a task of its own.

Rows: texts without words (null, empty, blank) have an empty set and are linked with nothing; fewer
words than a shingle make one of the whole text; repeated rows and equal ids are linked by their
texts alone, a class being verified on one of its texts; very long texts are read whole; a null id is linked with nothing and gets a null component; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, components, materialize, remove, shared_dir, small, unused, written

WORDS, NUM, DEN = 5, 80, 100
FREQUENT, OFTEN, HOT = 1 << 20, 16, 4096
#: Keys of a range that are counted at once; bytes of text for a shingle, at least about; groups of a part of a hot list;
#: groups of a block; pairs of a text in one place.
PER_RANGE, TEXT_BYTES, PART, BLOCK_GROUPS, HUB = 2 << 20, 4, 1 << 16, 2048, 128
#: Hash ranges that a batch is cut into at once; more than that are made in two steps.
RANGES = 1024
PARTNERS = ("first", "last", "middle")
BLOCK = 1 << 18
PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    ones = np.ones(size, dtype=np.uint64)
    up, down = ones.copy(), ones.copy()
    up[1:], down[1:] = PRIME, INVERSE
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a text, A to Z in lower case.

    A word's hash is a polynomial of its bytes: a difference of the block's running sums, brought
    back to power 0. Long texts go in blocks that end at white space.
    """
    data, parts, at = (text or "").encode("utf-8", "surrogatepass"), [], 0
    while at < len(data):
        end = at + BLOCK
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        b = np.frombuffer(data[at:end], dtype=np.uint8)
        at = end
        b = np.where((b >= 65) & (b <= 90), b + np.uint8(32), b)
        edges = np.flatnonzero(np.diff(np.concatenate(([False], ~((b == 32) | ((b >= 9) & (b <= 13))), [False])).view(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        size = 1 << max(14, int(len(b)).bit_length())
        up, down = _powers(size)
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], dtype=np.uint64)))
        parts.append(mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    w = word_hashes(text)
    if not len(w):
        return w
    span = min(words, len(w))
    h = np.full(len(w) - span + 1, span, dtype=np.uint64)
    for k in range(span):
        h = h * PRIME + w[k : len(w) - span + 1 + k]
    return np.unique(mix(h))


def _key40(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(24)


def _packs(keys: np.ndarray, n: np.ndarray, bins: int) -> Iterator:
    """Sorted distinct keys of 40 bits and their counts as rows of a hash range each: 5 bytes a key, counts over 1 apart."""
    import pyarrow as pa

    if not len(keys):
        return
    at = (keys * np.uint64(bins)) >> np.uint64(40)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    rows = []
    for i, j in zip(first, [*first[1:], len(keys)], strict=True):
        own, more = keys[i:j], n[i:j] > 1
        rows.append((int(at[i]), own.astype("<u4").tobytes(), (own >> np.uint64(32)).astype(np.uint8).tobytes(), own[more].astype("<u8").tobytes(), (n[i:j][more] - 1).astype("<u8").tobytes()))
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), *[pa.binary()] * 4), strict=True)], ["bin", "low", "high", "again", "n"])


def _unpacked(rows) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of packs, in their order; a key may come several times."""
    join = lambda name, kind: np.frombuffer(b"".join(rows.column(name).to_pylist()), dtype=kind)
    keys = join("low", "<u4").astype(np.uint64) | (join("high", np.uint8).astype(np.uint64) << np.uint64(32))
    more = join("again", "<u8")
    return np.concatenate([keys, more]), np.concatenate([np.ones(len(keys), dtype=np.uint64), join("n", "<u8")])


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = (np.concatenate([p[k] for p in parts]) for k in range(2))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def frequent_shingles(docs: DataFrame, words: int = WORDS, limit: int = FREQUENT, often: int = OFTEN) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts), sorted by key, of the shingles in the most documents: ``limit`` at most.

    All shingles of all documents are counted, under the first 40 bits of their hash, which travel
    as packed blocks of a hash range each. Where over ``limit`` of them stand in ``often`` documents
    or more, that number is doubled until they don't.
    """
    # a range holds PER_RANGE keys (about) however many texts there are, in tasks of one range or more
    text_bytes = docs.agg(F.sum(F.octet_length(F.col("text")).cast("long"))).first()[0] or 0
    bins = max(1, -(-text_bytes // (TEXT_BYTES * PER_RANGE)))
    # many ranges: a batch is cut into few first, and what meets there is cut again, so the work of a batch doesn't grow with the corpus
    coarse = bins if bins <= RANGES else max(RANGES, math.isqrt(bins))

    def pack(batches: Iterator) -> Iterator:
        for batch in batches:
            for (texts,) in arrow_rows(batch, "text", at_once=2048):
                keys, n = np.unique(_key40(np.concatenate([shingle_set(t, words) for t in texts])), return_counts=True)
                yield from _packs(keys, n, coarse)

    def again(batches: Iterator) -> Iterator:
        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                held.append(_unpacked(batch.slice(i, 1)))
                size += len(held[-1][0])
                if size >= 2 * PER_RANGE:
                    yield from _packs(*_summed(held), bins)
                    held, size = [], 0
        if held:
            yield from _packs(*_summed(held), bins)

    def count(group):
        import pyarrow as pa

        found, n = _summed([_unpacked(group)])
        keep = n >= often
        return pa.table({"key": pa.array(found[keep].astype(np.int64)), "n": pa.array(n[keep].astype(np.int64))})

    schema = "bin long, low binary, high binary, again binary, n binary"
    packed = docs.select("text").mapInArrow(pack, schema)
    if coarse < bins:
        packed = packed.repartition(coarse, "bin").mapInArrow(again, schema)
    counted = materialize(packed.groupBy("bin").applyInArrow(count, "key long, n long"), "frequent")
    while counted.where(F.col("n") >= often).count() > limit:
        often *= 2
    rows = counted.where(F.col("n") >= often).toPandas().sort_values("key")
    return rows["key"].to_numpy(dtype=np.uint64), rows["n"].to_numpy(dtype=np.uint64)


def prefixes(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], words: int = WORDS, num: int = NUM, den: int = DEN, hot: int = HOT) -> DataFrame:
    """(doc_id, t, n, k, p, cold, prefix): hash of the text, set size, hash of the set, hash of prefix and size, and the
    first shingles in the common order, of which ``cold`` many aren't hot; hot ones stand last."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # FREQUENT rows at most

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        keys, counts = shared.value
        for batch in batches:
            for ids, hashes, texts in arrow_rows(batch, "doc_id", "t", "text"):
                rows = []
                for i, t, text in zip(ids, hashes, texts, strict=True):
                    h = shingle_set(text, words)
                    n = len(h)
                    size = n - (num * n + den - 1) // den + 1 if n else 0
                    cold = size
                    if n and len(keys):
                        at = np.minimum(np.searchsorted(keys, own := _key40(h)), len(keys) - 1)
                        often = np.where(keys[at] == own, counts[at], 0)
                        # h is sorted, and stays so within a frequency
                        order = np.argsort(often, kind="stable")
                        h, cold = h[order], int(np.searchsorted(often[order[:size]], hot))
                    prefix = h[:size].view(np.int64)
                    rows.append((i, t, n, set_key(h), int((mix(h[:size]) * np.arange(1, 2 * size, 2, dtype=np.uint64)).sum(dtype=np.uint64).view(np.int64)), cold, prefix))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (*[pa.int64()] * 5, pa.int32(), pa.list_(pa.int64())), strict=True)], ["doc_id", "t", "n", "k", "p", "cold", "prefix"])

    return with_hash(docs).mapInArrow(run, "doc_id long, t long, n long, k long, p long, cold int, prefix array<long>")


def with_hash(docs: DataFrame) -> DataFrame:
    """(doc_id, t, text): ``t`` tells the texts of a repeated id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")


def set_key(h: np.ndarray) -> int:
    """A hash of a set of hashes, in any order."""
    both = np.array([h.sum(dtype=np.uint64), mix(h ^ PRIME).sum(dtype=np.uint64), len(h)], dtype=np.uint64)
    return int(mix(mix(both) * np.array([1, 3, 5], dtype=np.uint64)).sum(dtype=np.uint64).view(np.int64))


def _may(na: str, ia: str, nb: str, ib: str, num: int, den: int):
    """Size and position filter of a pair that shares the shingle at ia and ib."""
    a, b = F.col(na), F.col(nb)
    left = 1 + F.least(a - 1 - F.col(ia), b - 1 - F.col(ib))
    return (F.least(a, b) * den >= F.greatest(a, b) * num) & (left * (num + den) >= (a + b) * num)


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """The (a, b) of ``pairs`` (class keys) whose sets have the similarity; whole sets are compared."""
    pairs = materialize(pairs, "pairs")
    chosen = pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct().join(classes.select("k", "rep"), "k")
    chosen = materialize(chosen.select("k", F.col("rep.doc_id").alias("doc_id"), F.col("rep.t").alias("t")), "chosen")

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keep = []
            for left, right in arrow_rows(batch, "ta", "tb"):
                own = {t: shingle_set(t, words) for t in {*left, *right}}
                for s, t in zip(left, right, strict=True):
                    both = len(np.intersect1d(own[s], own[t], assume_unique=True))
                    keep.append(den * both >= num * (len(own[s]) + len(own[t]) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    # texts travel rather than sets, which are larger and don't compress; one for each class, however often its row is repeated
    path = shared_dir(docs.sparkSession, "pair-texts")
    texts = written(with_hash(docs).join(small(chosen, 48), ["doc_id", "t"]).groupBy("k").agg(F.first("text").alias("text")), path)
    # what many are compared with stands in several places, so that no task gets all its pairs
    hubs = pairs.select(F.explode(F.array("a", "b")).alias("k")).groupBy("k").agg(F.ceil(F.count("*") / HUB).cast("int").alias("places")).where("places > 1")
    hubs = small(materialize(hubs, "hubs"), 48)
    places = F.coalesce("places", F.lit(1))
    texts = texts.join(hubs, "k", "left").select("k", F.explode(F.sequence(F.lit(0), places - 1)).alias("place"), "text")
    both = pairs
    for end, other in ("ab", "ba"):
        own = hubs.select(F.col("k").alias(end), "places")
        both = both.join(own, end, "left").withColumn(f"p{end}", F.pmod(F.xxhash64(other), places).cast("int")).drop("places")
    for end in "ab":
        both = both.join(texts.select(F.col("k").alias(end), F.col("place").alias(f"p{end}"), F.col("text").alias(f"t{end}")), [end, f"p{end}"])
    links = materialize(both.select("a", "b", "ta", "tb").mapInArrow(compare, "a long, b long").distinct(), "links")
    remove(docs.sparkSession, path)
    return links


def jaccard_components(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN, hot: int = HOT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document: links where ``den * |x & y| >= num * |x | y|``."""
    rows = materialize(prefixes(docs, frequent_shingles(docs, words), words, num, den, hot), "prefixes")
    known = rows.where("n > 0 AND doc_id IS NOT NULL")
    rep = F.min(F.struct("doc_id", "t")).alias("rep")
    classes = materialize(known.groupBy("k").agg(rep, F.max("n").alias("n"), F.max("p").alias("p")), "classes")
    groups = materialize(classes.groupBy("n", "p").agg(F.min(F.struct("k", "rep")).alias("s")).select(F.col("s.k").alias("g"), "s.rep.doc_id", "s.rep.t", "n", "p"), "groups")
    members = materialize(classes.select("k", "n", "p").join(groups.select("n", "p", "g"), ["n", "p"]).select("g", "k"), "members")
    # a group's prefix is that of one row
    heads = known.select(F.col("k").alias("g"), "doc_id", "t", "n", "cold", "prefix").join(groups.select("g", "doc_id", "t"), ["g", "doc_id", "t"]).dropDuplicates(["g"])

    # a hot list has parts, any other one is whole
    parts = F.lit(max(1, -(-groups.count() // PART)))
    postings = heads.select("g", "n", "cold", F.posexplode("prefix").alias("pos", "token"))
    postings = postings.select("g", "n", "pos", "token", F.when(F.col("pos") >= F.col("cold"), F.pmod(F.xxhash64("g"), parts)).alias("part"))
    listed = Window.partitionBy("token", "part")
    postings = postings.withColumn("in_list", F.count("*").over(listed)).where("in_list > 1 OR part IS NOT NULL").drop("in_list")
    postings = materialize(postings, "postings")

    at = F.struct("pos", "n", "g")
    ordered = listed.orderBy("n", "g")
    near = postings.select("token", "g", "n", "pos", F.first(at).over(ordered).alias("first_"), F.lag(at).over(ordered).alias("last"), F.min(at).over(listed).alias("middle_"))
    whole = postings.where("part IS NOT NULL").groupBy("token").agg(F.min(F.struct("n", "g", "pos")).alias("s"), F.min(at).alias("m"))
    whole = whole.select("token", F.struct("s.pos", "s.n", "s.g").alias("f"), "m")  # hot tokens: FREQUENT rows at most
    near = near.join(small(materialize(whole, "hot-lists"), 96), "token", "left").withColumns({"first": F.coalesce("f", "first_"), "middle": F.coalesce("m", "middle_")})
    near = near.select("g", "n", "pos", *[F.col(f"{x}.{c}").alias(f"{c}_{x}") for x in PARTNERS for c in ("g", "n", "pos")])
    star = [near.where(_may("n", "pos", f"n_{x}", f"pos_{x}", num, den)).select(F.least("g", f"g_{x}").alias("a"), F.greatest("g", f"g_{x}").alias("b")) for x in PARTNERS]
    own = members.select(F.least("g", "k").alias("a"), F.greatest("g", "k").alias("b"))
    links = verify(star[0].union(star[1]).union(star[2]).union(own).where("a <> b").distinct(), classes, docs, words, num, den)
    first = components(links)

    # what isn't connected yet: a group's component, or one of its own where its classes differ
    named = materialize(members.join(first, F.col("k") == F.col("id"), "left").select("g", "k", F.coalesce("component", "k").alias("c")), "named")
    of_group = named.groupBy("g").agg(F.when(F.min("c") == F.max("c"), F.struct(F.lit(False).alias("mixed"), F.min("c").alias("c"))).otherwise(F.struct(F.lit(True).alias("mixed"), F.first("g").alias("c"))).alias("c"))
    lists = postings.join(of_group, "g")
    sizes = lists.groupBy("token", "c").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("token").agg(F.max_by("c", F.struct("size", "c")).alias("most"), F.count("*").alias("kinds")).where("kinds > 1").select("token", "most")
    lists = lists.join(largest, "token").select("token", "g", "n", "pos", "c", (F.col("c") != F.col("most")).alias("left"))
    lists = materialize(lists, "lists")
    # blocks of the smaller side and of the whole list, for lists that need more than one of either
    long = lists.groupBy("token").agg(F.count("*").alias("rights"), F.sum(F.col("left").cast("int")).alias("lefts")).where(F.col("rights") > BLOCK_GROUPS)
    long = small(materialize(long.select("token", *[F.ceil(F.col(c) / BLOCK_GROUPS).cast("int").alias(c) for c in ("lefts", "rights")]), "long-lists"), 48)

    def side(rows: DataFrame, x: str, own: str, other: str) -> DataFrame:
        count = [F.coalesce(F.col(c), F.lit(1)) for c in (own, other)]
        dealt = rows.join(long, "token", "left").select("token", "g", "n", "pos", "c", F.pmod(F.xxhash64("g"), count[0]).cast("int").alias(own), F.explode(F.sequence(F.lit(0), count[1] - 1)).alias(other))
        return dealt.select("token", "lefts", "rights", *[F.col(c).alias(f"{c[0]}{x}") for c in ("g", "n", "pos", "c")])

    left, right = side(lists.where("left"), "a", "lefts", "rights"), side(lists, "b", "rights", "lefts")
    pairs = left.join(right, ["token", "lefts", "rights"]).where((F.col("ca") != F.col("cb")) & _may("na", "pa", "nb", "pb", num, den)).select(F.least("ga", "gb").alias("ga"), F.greatest("ga", "gb").alias("gb")).distinct()
    mixed = of_group.where("c.mixed").select(F.col("g").alias("ga"), F.col("g").alias("gb"))
    of = lambda x: named.select(F.col("g").alias(f"g{x}"), F.col("k").alias(x), F.col("c").alias(f"c{x}"))
    pairs = pairs.union(mixed).join(of("a"), "ga").join(of("b"), "gb").where("ca <> cb")
    more = verify(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), classes, docs, words, num, den)
    every = components(links.union(more))

    joined = classes.select("k", F.col("rep.doc_id").alias("rep")).join(every, F.col("k") == F.col("id"), "left").select("k", "rep", F.coalesce("component", "k").alias("c"))
    smallest = joined.groupBy("c").agg(F.min("rep").alias("component_id"))
    of_class = materialize(joined.join(smallest, "c").select("k", "component_id"), "class-components")
    out = rows.select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("k")).alias("k")).join(of_class, "k", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents that speak for their component, all columns; of rows that repeat an id, one stays. Rows without an id stay."""
    name = unused(docs, "kept")
    kept = jaccard_components(docs.select("doc_id", "text"), **options).where("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    kept = materialize(kept, "kept")
    with_id = docs.where("doc_id IS NOT NULL").join(kept, docs["doc_id"] == kept[name], "left_semi").dropDuplicates(["doc_id"])
    return with_id.unionByName(docs.where("doc_id IS NULL"))
