"""Operator 12: phrase collocation mining by compressed position bitmaps.

Documents of a language are cut into shards of a bounded number of bytes. A word's positions in its shard
are a bitmap, of which only blocks of 16 positions with a bit set are kept, as (block, bits). A
phrase's bitmap, of the places of its last word, is shifted by one, cleared where a piece begins, and ANDed with
the next word's; the bits left are the longer phrase's bitmap and their number its
occurrences. Whole batches of phrases take each step together, batches of first words go depth-first.
Counts are summed over shards.

Passes over the shards: words; then pairs and triples, each into a table of counters by hash; then all phrases of
frequent words whose pairs and triples fall on counters that reached the least count, exactly. Which words and counters did is a
bitmap of bounded size, so every task can hold it: what it lets through by chance costs time but can't change
the result, which only has phrases whose own sum is large enough. Words go by 64-bit codes; that no frequent word shares its code with
another word is verified over all words, else the codes are made anew with another seed. No document is cut off: a piece may
be of any length and is in one shard.

Scores are exact: products are decimals of 38 digits, enough for 10^13 words a language. A phrase inside of a longer
candidate as frequent is also inside of one that has one word more, so it is compared with these alone.

Rows: a null text is an empty one, a null language is ``und`` (as ``und`` itself), an empty language is one of its own; repeated
rows count each; very long texts are read whole; other columns are ignored; an empty table, or one without frequent phrases, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, materialize, small

LONGEST, LEAST, FIRST = 5, 100, 2000
SHARD_BYTES = 4 << 20
#: Bits of the bitmap of frequent words and counters of pairs and of triples, at most, as powers of 2; a counter for 8 words below that.
WORD_BITS, COUNTERS, WORDS_EACH = 26, 24, 8
#: Counters that travel as a row; words whose phrases are a range of hashes (4 phrases for a word at most).
CHUNK, RANGE_WORDS = 1 << 16, 1 << 19
#: Positions of a block, and how many pairs of blocks a batch compares at once.
BLOCK, AT_ONCE = 16, 1 << 19

_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_PIECE_END = b".,;:!?\n\x0b\x0c\r"
#: A-Z as a-z, ends of pieces as a newline, tabs as blanks.
FOLD = bytes.maketrans(_UPPER + _PIECE_END + b"\t", _LOWER + b"\n" * len(_PIECE_END) + b" ")


def shard_words(text: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, a word's number at each position, whether a piece begins there) of folded text."""
    import pyarrow.compute as pc

    tokens = pc.split_pattern(pa.array([text.replace(b"\n", b" \n ")], pa.large_binary()), b" ").flatten().dictionary_encode()
    names, ids = tokens.dictionary.to_pylist(), tokens.indices.to_numpy().astype(np.int64)
    place = {w: k for k, w in enumerate(names)}
    ids = ids[ids != place.get(b"", -1)]
    end = ids == place.get(b"\n", -1)
    word = ~end
    begins = np.concatenate([[True], end[:-1]])[: len(ids)] if len(ids) else np.zeros(0, dtype=bool)
    # of several ends in a row the last one is right before the word
    words = [w for w in names if w not in (b"", b"\n")]
    # common words first: small numbers take little room
    ids = ids[word]
    order = np.argsort(-np.bincount(ids, minlength=len(names)), kind="stable")
    new = np.empty(len(names), dtype=np.int64)
    new[order] = np.arange(len(names))
    # what isn't a word has no occurrence left and comes last
    return [names[k] for k in order[: len(words)]], new[ids], begins[word]


def shards(docs: DataFrame, size: int = SHARD_BYTES) -> DataFrame:
    """(shard, lang, n_words, words, counts, ids, begins): ids as integers of 16 bits, or 32 if there are more words; begins as bits."""

    def run(batches: Iterator) -> Iterator:
        held, total, made = {}, 0, 0
        part = TaskContext.get().partitionId()
        types = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), pa.binary()]

        def shard(lang: str, text: bytes):
            nonlocal made
            words, ids, begins = shard_words(text)
            made += 1
            row = ((part << 32) + made, lang, len(ids), [w.decode() for w in words], np.bincount(ids, minlength=len(words)), ids.astype("<u2" if len(words) <= 1 << 16 else "<u4").tobytes(), np.packbits(begins, bitorder="little").tobytes())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], ["shard", "lang", "n_words", "words", "counts", "ids", "begins"])

        for batch in batches:
            for langs, texts in arrow_rows(batch, "lang", "text", at_once=64):
                for lang, text in zip(langs, texts, strict=True):
                    rest = text.encode().translate(FOLD)
                    while rest:
                        # a long text is cut at the end of a piece
                        cut = len(rest) if len(rest) <= size else rest.find(b"\n", size) + 1 or len(rest)
                        piece, rest = rest[:cut], rest[cut:]
                        parts = held.setdefault(lang, [0, []])
                        parts[0] += len(piece)
                        parts[1].append(piece)
                        total += len(piece)
                        if parts[0] >= size:
                            del held[lang]
                            total -= parts[0]
                            yield shard(lang, b"\n".join(parts[1]))
                    if total >= 4 * size:  # many languages, each with little
                        for x, (_, pieces) in held.items():
                            yield shard(x, b"\n".join(pieces))
                        held, total = {}, 0
        for x, (_, pieces) in held.items():
            yield shard(x, b"\n".join(pieces))

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).where("text <> ''")
    return rows.mapInArrow(run, "shard long, lang string, n_words long, words array<string>, counts array<long>, ids binary, begins binary")


class Bitmaps:
    """The compressed bitmaps of a shard's words: entries (word, block, bits), in the order of words and in that of blocks."""

    def __init__(self, word: np.ndarray, position: np.ndarray, begins: np.ndarray, n_words: int):
        block = position // BLOCK
        self.blocks = len(begins) // BLOCK + 2
        key = word * self.blocks + block
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        bits = (1 << (position % BLOCK)).astype(np.uint16)[order]
        self.word, self.block = (x.astype(np.int32) for x in np.divmod(key[order][first], self.blocks))
        self.bits = np.bitwise_or.reduceat(bits, first) if len(first) else bits
        self.n_words = n_words
        # by block
        order = np.argsort(self.block, kind="stable")
        self.in_block, self.bits_in_block = self.word[order], self.bits[order]
        self.start = np.searchsorted(self.block[order], np.arange(self.blocks + 1))
        del key, order
        padded = np.zeros(self.blocks * BLOCK, dtype=bool)
        padded[: len(begins)] = begins
        self.inside = ~np.packbits(padded, bitorder="little").view("<u2")

    def extend(self, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, next word, block, bits) of phrases' bitmaps shifted by a position and ANDed with the words'."""
        carry = bits >> (BLOCK - 1) > 0
        phrase, block, bits = np.concatenate([phrase, phrase[carry]]), np.concatenate([block, block[carry] + 1]), np.concatenate([bits << 1, np.ones(int(carry.sum()), dtype=np.uint16)])
        bits &= self.inside[block]
        some = bits > 0
        phrase, block, bits = phrase[some], block[some], bits[some]
        n = self.start[block + 1] - self.start[block]
        row = np.repeat(np.arange(len(block), dtype=np.int32), n)
        at = np.arange(len(row), dtype=np.int32)
        at += np.repeat((self.start[block] - np.cumsum(n) + n).astype(np.int32), n)
        met = bits[row] & self.bits_in_block[at]
        some = np.flatnonzero(met)
        row, at = row[some], at[some]
        return phrase[row], self.in_block[at], block[row], met[some]

    def batches(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(word, block, bits) of whole words' entries, few enough to extend at once."""
        cost = np.cumsum(self.start[self.block + 1] - self.start[self.block])
        at = 0
        while at < len(self.word):
            end = int(np.searchsorted(cost, (cost[at - 1] if at else 0) + AT_ONCE, side="right"))
            last = self.word[max(end, at + 1) - 1]  # up to its end
            end = int(np.searchsorted(self.word, last, side="right"))
            yield self.word[at:end], self.block[at:end], self.bits[at:end]
            at = end


def _counted(keys: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the number of set bits of each, and each row's place among the keys."""
    distinct, place = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(place, weights=np.bitwise_count(bits), minlength=len(distinct)).astype(np.int64), place


def tuple_hash(codes: np.ndarray, power: int) -> np.ndarray:
    """A number of ``power`` bits for each row of codes."""
    h = np.full(len(codes), 0x9E3779B97F4A7C15, dtype=np.uint64)
    for column in codes.T:
        h = (h ^ h >> np.uint64(29) ^ column.view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ h >> np.uint64(32)) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - power)).astype(np.int64)


@dataclass(frozen=True)
class Seen:
    """A bitmap of hashes: what isn't in it isn't frequent."""

    bits: np.ndarray
    power: int

    def has(self, codes: np.ndarray) -> np.ndarray:
        h = tuple_hash(codes, self.power)
        return (self.bits[h >> 3] >> (h & 7).astype(np.uint8)) & 1 > 0


def word_bitmap(words: DataFrame) -> Seen:
    """Of the codes of ``words``: 16 bits each, no more than 2 ** WORD_BITS in all."""
    power = max(10, min(WORD_BITS, (16 * words.count()).bit_length()))

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            h = tuple_hash(batch.column(0).to_numpy().reshape(-1, 1), power)
            yield pa.RecordBatch.from_arrays([pa.array(h >> 3), pa.array(np.int64(1) << (h & 7))], ["place", "bits"])

    found = words.select("code").mapInArrow(run, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(1 << power - 3, dtype=np.uint8)
    bits[found.column("place").to_numpy()] = found.column("bits").to_numpy().astype(np.uint8)
    return Seen(bits, power)


def _read(row, frequent: Seen) -> tuple[Bitmaps, np.ndarray]:
    """Bitmaps of a shard's frequent words, and their codes."""
    n, data = row.column("n_words")[0].as_py(), row.column("ids")[0].as_buffer()
    ids = np.frombuffer(data, "<u2" if data.size == 2 * n else "<u4")
    begins = np.unpackbits(np.frombuffer(row.column("begins")[0].as_buffer(), np.uint8), count=n, bitorder="little").astype(bool)
    codes = row.column("codes")[0].values.to_numpy(zero_copy_only=False)
    some = np.flatnonzero(frequent.has(codes.reshape(-1, 1)))
    place = np.full(len(codes), -1, dtype=np.int32)
    place[some] = np.arange(len(some), dtype=np.int32)
    word = place[ids]
    position = np.flatnonzero(word >= 0)
    return Bitmaps(word[position].astype(np.int64), position, begins, len(some)), codes[some]


def walk(row, frequent: Seen, seen: dict[int, Seen], longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes of phrases, their occurrences in the shard): phrases of 2 to ``longest`` words, the first words' batches depth-first.

    ``seen`` has the bitmaps of pairs (2) and of triples (3), as far as they are known: every phrase's last two and three words must be in them.
    """
    maps, codes = _read(row, frequent)
    n = maps.n_words
    for at, block, bits in maps.batches():
        # a level's phrases: their words, and the entries of their bitmaps
        words = np.arange(n).reshape(-1, 1)
        for k in range(2, longest + 1):
            at, word, block, bits = maps.extend(at, block, bits)
            keys, counts, at = _counted(at.astype(np.int64) * n + word, bits)
            words = np.column_stack([words[keys // n], keys % n])
            kept = np.ones(len(words), dtype=bool)
            for size, bitmap in seen.items():
                if size <= k:
                    kept &= bitmap.has(codes[words[:, -size:]])
            new = np.cumsum(kept) - 1
            alive = kept[at]
            at, block, bits, words = new[at[alive]], block[alive], bits[alive], words[kept]
            if not len(at):
                break
            yield codes[words], counts[kept]


def counters(frame: DataFrame, frequent, seen, size: int, least: int, power: int) -> Seen:
    """The bitmap of phrases of ``size`` words whose counter, shared with others of the same hash, reaches ``least``."""

    def count(batches: Iterator) -> Iterator:
        table = np.zeros(1 << power, dtype=np.uint32)
        for batch in batches:
            for i in range(batch.num_rows):
                for codes, n in walk(batch.slice(i, 1), frequent.value, seen.value, size):
                    if codes.shape[1] == size:
                        np.add.at(table, tuple_hash(codes, power), n.astype(np.uint32))
        for k in range(0, len(table), CHUNK):
            chunk = table[k : k + CHUNK]
            if most := int(chunk.max()):
                # counters that are set, with their places if these are few
                places, kind = np.flatnonzero(chunk), np.min_scalar_type(most)
                few = len(places) * (kind.itemsize + 2) < len(chunk) * kind.itemsize
                data = (chunk[places] if few else chunk).astype(kind).tobytes()
                columns = [pa.array([k // CHUNK], pa.int32()), pa.array([kind.itemsize], pa.int32()), pa.array([places.astype("<u2").tobytes() if few else None], pa.binary()), pa.array([data], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "width", "places", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, chunk = np.zeros(min(CHUNK, 1 << power), dtype=np.uint64), 0
        for batch in batches:
            for chunk, width, places, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):  # noqa: B007
                total[slice(None) if places is None else np.frombuffer(places, "<u2")] += np.frombuffer(data, f"u{width}")
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], ["chunk", "bits"])

    sums = frame.mapInArrow(count, "chunk int, width int, places binary, data binary").groupBy("chunk").applyInArrow(add, "chunk int, bits binary")
    bits = np.zeros((1 << power) // 8, dtype=np.uint8)
    for r in sums.collect():  # a bitmap of 2 ** power bits
        part = np.frombuffer(r["bits"], np.uint8)
        bits[r["chunk"] * len(part) : (r["chunk"] + 1) * len(part)] = part
    return Seen(bits, power)


def _vocabulary(cut: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(shards with their words' codes, (lang, phrase, a, code) of frequent words)."""
    for seed in range(8):
        coded = cut.withColumn("codes", F.transform("words", lambda w: F.xxhash64(F.lit(seed), F.col("lang"), w)))  # noqa: B023
        local = coded.select("lang", F.explode(F.arrays_zip("codes", "words", "counts")).alias("w")).select("lang", F.col("w.codes").alias("code"), F.col("w.words").alias("phrase"), F.col("w.counts").alias("c"))
        # all words of a code meet, whether they are frequent or not
        every = local.repartition("code").groupBy("code", "lang", "phrase").agg(F.sum("c").alias("a"))
        same = F.count("*").over(Window.partitionBy("code"))
        words = materialize(every.withColumn("same", same).where(F.col("a") >= least), "words")
        if words.where("same > 1").isEmpty():
            return coded, words.drop("same")
    raise RuntimeError("frequent words share their codes with other words under every seed")


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, size: int = SHARD_BYTES, most: int = COUNTERS) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, size, a) of words and phrases with at least ``least`` occurrences, (lang, n) of all words)."""
    cut = materialize(shards(docs, size), "shards")
    totals = materialize(cut.groupBy("lang").agg(F.sum("n_words").alias("n")), "totals")
    n_words = totals.agg(F.sum("n")).first()[0] or 0
    power = max(3, min(most, (n_words // WORDS_EACH).bit_length()))
    coded, words = _vocabulary(cut, least)
    coded = coded.select("n_words", "ids", "begins", "codes")
    share = docs.sparkSession.sparkContext.broadcast  # bitmaps of bounded size
    frequent, seen = share(word_bitmap(words)), {}
    for k in range(2, min(longest, 3) + 1):
        seen[k] = counters(coded, frequent, share(dict(seen)), k, least, power)
    known, names = share(seen), [f"w{k}" for k in range(longest)]

    # counts travel in packs, of a range of hashes each: a range holds a bounded part of the phrases however many words there are
    ranges = max(1, n_words // RANGE_WORDS)

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for i in range(batch.num_rows):
                every = [(codes, n) for codes, n in walk(batch.slice(i, 1), frequent.value, known.value, longest)]
                for size in sorted({codes.shape[1] for codes, _ in every}):
                    codes = np.concatenate([c for c, _ in every if c.shape[1] == size])
                    n = np.concatenate([x for c, x in every if c.shape[1] == size])
                    at = tuple_hash(codes, 32) * ranges >> 32
                    order = np.argsort(at, kind="stable")
                    first = np.flatnonzero(np.diff(at[order], prepend=-1))
                    packs = [(int(at[p[0]]), size, codes[p].tobytes(), n[p].tobytes()) for p in np.split(order, first[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*packs, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["range", "size", "codes", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = [row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("size", "codes", "n")), strict=True)]
        size = packs[0][0]
        codes, n = np.frombuffer(b"".join(p[1] for p in packs), np.int64).reshape(-1, size), np.frombuffer(b"".join(p[2] for p in packs), np.int64)
        order = np.lexsort(codes.T)
        codes, n = codes[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]).any(axis=1)]))
        total = np.add.reduceat(n, first)
        kept = total >= least
        codes = codes[first[kept]]
        yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in codes.T], *[pa.nulls(len(codes), pa.int64())] * (longest - size), pa.array(total[kept])], [*names, "a"])

    packed = coded.mapInArrow(run, "range long, size int, codes binary, n binary")
    spelled = materialize(packed.groupBy("range", "size").applyInArrow(add, ", ".join(f"{n} long" for n in [*names, "a"])), "phrases")
    for k, name in enumerate(names):
        lexicon = words.select(F.col("code").alias(name), F.col("phrase").alias(f"s{k}"), *["lang"] * (k == 0), "phrase")
        spelled = spelled.join(small(lexicon, F.octet_length("phrase") + 64).drop("phrase"), name, "inner" if k == 0 else "left")
    # a code that let a rare word through has no word
    right = F.lit(True)
    for k, name in enumerate(names):
        right = right & (F.col(name).isNull() | F.col(f"s{k}").isNotNull())
    text, length = F.array_join(F.array(*[f"s{k}" for k in range(longest)]), " "), sum(F.col(x).isNotNull().cast("int") for x in names)
    phrases = spelled.where(right).select("lang", text.alias("phrase"), length.alias("size"), "a").unionByName(words.select("lang", "phrase", F.lit(1).alias("size"), "a"))
    return materialize(phrases, "counts"), totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, first: int = FIRST, inside: int = 100, size: int = SHARD_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``first`` phrases by score.

    ``inside``: percent of a phrase's occurrences that a longer candidate around it must have for it to be dropped.
    """
    counts, totals = phrase_counts(docs, least, longest, size)
    candidates = counts.where("size >= 2")
    rest = lambda n: F.substr("phrase", F.length(F.substring_index("phrase", " ", n)) + 2)
    cuts = [F.struct(F.lit(k).alias("k"), F.substring_index("phrase", " ", k).alias("left"), rest(k).alias("right")) for k in range(1, longest)]
    cuts = candidates.select("*", F.explode(F.slice(F.array(*cuts), F.lit(1), F.col("size") - 1)).alias("cut")).select("lang", "phrase", "a", "cut.*")
    parts = lambda side, n: counts.select("lang", F.col("phrase").alias(side), F.col("a").alias(n))
    cuts = cuts.join(parts("left", "l"), ["lang", "left"]).join(parts("right", "r"), ["lang", "right"]).join(small(totals, F.octet_length("lang") + 32), "lang")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumns({"up": F.lit(1000).cast("decimal(4,0)") * exact("a") * exact("n"), "down": exact("l") * exact("r")})
    cuts = cuts.withColumn("score", F.expr("up div down"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r", "n")).alias("s"))
    longer = candidates.where("size >= 3")
    around = longer.select("lang", F.substring_index("phrase", " ", -1).alias("last"), F.col("size"), "phrase", "a")
    shorter = F.array(F.substr("phrase", F.lit(1), F.length("phrase") - F.length("last") - 1), F.substr("phrase", F.instr("phrase", " ") + 1))
    around = around.select("lang", F.explode(shorter).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = scored.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    left = left.select("lang", "phrase", "a", "s.l", "s.r", "s.n", "s.score").withColumn("rank", rank.cast("long")).where(F.col("rank") <= first)
    return left.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
