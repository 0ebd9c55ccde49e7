"""Operator 9: best-fit packing of token pieces into sequences, online and in bounded space.

``Bins`` keeps a fixed number of open bins. A bitset has the bit f set when an open bin has f free
tokens, so the fullest bin that still takes a piece is the lowest set bit from the piece's length
on. When a new bin is needed and all are open, the fullest closes; a bin without free tokens closes
at once. A task places its pieces one after another as they come, whatever the batches they come in.

The order in which they come is the shuffle's: pieces are written first and numbered as they lie
there, so that no document, source or group of copies is hot; a hash of the number deals them to
rounds of about ``ROUND`` pieces, and within a round Spark sorts the longest first. With half as many
open bins as a round has pieces, the long ones wait for the short ones that fill them up, and what
is left when the bound is reached has hardly any room. ``fill`` measures how full sequences are.

Rows: a null or empty text is a document of the end id alone; repeated rows are pieces of their
own; other columns are ignored; an empty table gives no piece. A document longer than the capacity
is cut into full pieces, the first one taking the rest. Strings of special tokens inside a text are
ordinary text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, chunk_encoder, materialize, others, unused

CAPACITY, OPEN_BINS, ROUND = 2048, 1024, 2048


class Bins:
    """Open bins by free space; ``place`` gives (bin, offset) of a piece."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.limit = capacity, open_bins
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.opened = self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        if not 0 < length <= self.capacity:
            raise ValueError(f"a piece of {length} tokens doesn't fit a sequence of {self.capacity}")
        fitting = self.bits >> length
        if fitting:
            space = (fitting & -fitting).bit_length() - 1 + length
            name = self._take(space)
        else:
            if self.opened == self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
            name, space = self.made, self.capacity
            self.made += 1
        if space > length:
            self.free[space - length].append(name)
            self.bits |= 1 << (space - length)
            self.opened += 1
        return name, self.capacity - space

    def _take(self, space: int) -> int:
        name = self.free[space].pop()
        if not self.free[space]:
            self.bits ^= 1 << space
        self.opened -= 1
        return name


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) and, if asked for, ids as little-endian u32."""

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder, names = chunk_encoder(tokenizer), ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
        for batch in batches:
            for docs, texts in arrow_rows(batch, "id", "text"):
                rows = []
                for doc, encoded in zip(docs, encoder.encode(texts), strict=True):
                    ids = np.append(np.frombuffer(encoded, dtype=encoder.type), end_id).astype("<u4")
                    ends = [*range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                    for piece, (start, end) in enumerate(zip([0, *ends], ends, strict=False)):
                        own = ids[start:end].tobytes()
                        rows.append((doc, piece, start, end - start, zlib.crc32(own)) + (own,) * with_ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, per_round: int = ROUND) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, and more columns) with sequence_id and offset.

    A sequence's pieces stand one after another from offset 0. ``assemble`` makes its tokens.
    """
    names = others(pieces, "sequence_id", "offset")
    # written, so that neither counting nor a lost executor encodes the texts again
    rows = materialize(pieces.select(*names), "pieces")
    number, turn = unused(rows, "number"), unused(rows, "turn")
    rounds = max(1, -(-rows.count() // per_round))
    rows = rows.withColumn(number, F.monotonically_increasing_id()).withColumn(turn, F.pmod(F.xxhash64(number), F.lit(rounds)))
    rows = rows.repartition(turn).sortWithinPartitions(turn, F.desc("length"), number).select(*names)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bins, first = Bins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            lengths = batch.column(names.index("length")).to_pylist()
            placed = np.array([bins.place(n) for n in lengths], dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first + placed[:, 0]), pa.array(placed[:, 1])], [*names, "sequence_id", "offset"])

    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema}
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", sequence_id long, offset long")


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(sequences, least, filled): how many there are, the least number that could do, and the share of their room in use."""
    tokens, n = F.sum("length"), F.count_distinct("sequence_id")
    return packed.agg(n.alias("sequences"), F.ceil(tokens / capacity).alias("least"), (tokens / capacity / n).alias("filled"))


def assemble(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, lengths) of packed pieces that carry ``ids``: each sequence's tokens as
    little-endian u32 and its pieces' lengths, of which a sequence has ``capacity`` at most."""
    one = F.sort_array(F.collect_list(F.struct("offset", "ids", "length")))
    rows = packed.groupBy("sequence_id").agg(one.alias("p"))
    return rows.select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"), F.col("p.length").alias("lengths"))
