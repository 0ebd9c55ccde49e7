"""What the corpus operators share: files in the shared folder, tokenizing, components."""

from __future__ import annotations

import functools
import os
import re
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tricord.plans.storage import BROADCAST_BYTES, materialize, remove, shared_dir, small, written

__all__ = ["BROADCAST_BYTES", "ChunkEncoder", "arrow_rows", "chunk_encoder", "components", "file_system", "materialize", "others", "remove", "shared_dir", "small", "unused", "written"]

def unused(df: DataFrame, name: str) -> str:
    """``name``, or with underscores until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def others(df: DataFrame, *own: str) -> list[str]:
    """The columns of ``df`` that have none of these names, in any case."""
    taken = {c.lower() for c in own}
    return [c for c in df.columns if c.lower() not in taken]


def file_system(uri: str):
    """(pyarrow file system, path in it) of a URI or an absolute local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class ChunkEncoder(dict):
    """Whole-text encoding with a bounded memo: chunk of text -> its ids' bytes.

    Both kinds of supported tokenizer (byte-level, and word BPE that drops white space) split a
    text with a pattern whose matches never run over a chunk's ends: a chunk ends at white space,
    of which a last blank belongs to the next chunk, or between a letter and a mark of
    punctuation. So the ids of a text are those of its chunks one after another. Strings of
    special tokens inside a text are ordinary text (``encode_special_tokens``, as the vocabularies'
    own notes set it), so no document can write an end mark into the stream. Ids come as unsigned integers of ``width``
    bytes in the machine's order (dtype ``type``). The memo has two generations: what the older one holds and is used again
    moves to the younger one.
    """

    #: White space as Unicode's property has it: str.isspace() also takes 1C to 1F.
    SPACE = "\t\n\x0b\x0c\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
    LETTER = "A-Za-z" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0xFF)))
    CHUNK = re.compile(f" ?[{LETTER}]+(?![^{SPACE}.,;:!?])| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
    #: Byte-level vocabularies spell a byte as a character: printable ones as themselves, the others from 256 on.
    SPELL = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in {*range(33, 127), *range(161, 173), *range(174, 256)})}
    #: Chunks of the younger generation, about 200 bytes each: a corpus has a long tail of words that come back only after many others.
    MEMO = 200_000

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.type = np.dtype("u2" if self.width == 2 else "u4").newbyteorder("=")
        self.old: dict[str, bytes] = {}
        # words of Latin letters need neither normalizing nor splitting, if the model alone gives the same ids
        words = [" Probe", "probe", " a", "Ünïcode", " çé"]
        self.tokenize = self.tokenizer.model.tokenize
        self.lower = [t.id for t in self.tokenize(self._spelled("probe"))] == self._ids(" Probe")
        self.bare = all([t.id for t in self.tokenize(self._spelled(c.lstrip(" ").lower() if self.lower else c))] == self._ids(c) for c in words)

    def _spelled(self, chunk: str) -> str:
        return chunk.encode().decode("latin-1").translate(self.SPELL)

    def _ids(self, chunk: str) -> list[int]:
        return self.tokenizer.encode(chunk, add_special_tokens=False).ids

    def __missing__(self, chunk: str) -> bytes:
        found = self.old.get(chunk)
        if found is None:
            word = chunk.lstrip(" ")
            if not self.bare or not word.isalpha() or not (word.isascii() or max(word) <= "\xff"):
                ids = self._ids(chunk)
            elif self.lower:
                ids = [t.id for t in self.tokenize(word.lower() if word.isascii() else self._spelled(word.lower()))]
            else:
                ids = [t.id for t in self.tokenize(self._spelled(chunk))]
            found = array("H" if self.width == 2 else "I", ids).tobytes()
        self[chunk] = found
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self) > self.MEMO:
            self.old = dict(self)
            self.clear()
        return [b"".join([self[c] for c in self.CHUNK.findall(t)]) if t else b"" for t in texts]


@functools.lru_cache(maxsize=2)
def chunk_encoder(path: str) -> ChunkEncoder:
    """The encoder of this worker process: tasks that run in it one after another share the memo."""
    return ChunkEncoder(path)


def arrow_rows(batch, *names: str, at_once: int = 512):
    """Columns of an Arrow batch as Python lists, ``at_once`` rows at a time."""
    for i in range(0, batch.num_rows, at_once):
        part = batch.slice(i, at_once)
        yield [part.column(part.schema.get_field_index(n)).to_pylist() for n in names]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b: long): rows (id, component), the smallest id of each.

    Alternates large-star and small-star steps: every step re-hangs the neighbours of a vertex on
    the smallest one, so paths halve and hubs stay linear; minima are taken before the shuffle, and
    a hub's edges are rows that AQE may split. Each round is written to the shared folder and the one
    before it deleted; only a count and a checksum come to the driver. Null ends and loops are left
    out; an empty input gives an empty result.
    """
    spark, path = edges.sparkSession, shared_dir(edges.sparkSession, "edges")
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), path)
    seen = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        near = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        before, path = path, shared_dir(spark, "edges")
        edges = written(near, path)
        remove(spark, before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select("b", "b")).distinct()
