"""Operator 1: token ids as length-delimited binary records with a separate offset index.

A record is ``length (u64) | masked crc of the length (u32) | payload | masked crc of the payload
(u32)``, all little-endian. The payload is ``has id (u8) | id (i64) | id width (u8) | ids``. The
check value is CRC-32, rotated right by 15 bits plus a constant, so that the check of bytes which
hold checks themselves stays sound. Records stand in shards in ascending order of the document id;
the index is a Parquet table with a row per record (file, offset, size, id, tokens, start), so that
a reader takes any subset in any order by byte ranges.

Rows: strings of special tokens inside a text are ordinary text; a null or empty text gives only the
end id; repeated rows each give a record; a null id comes first; other columns of the input are
ignored; an empty table gives no record.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import arrow_rows, chunk_encoder, file_system, shared_dir

HEAD, CRC, PAYLOAD = "<QI", "<I", "<?qB"
HEAD_SIZE, PAYLOAD_HEAD_SIZE = struct.calcsize(HEAD), struct.calcsize(PAYLOAD)
READ_AT_ONCE, READ_PER_TASK = 8 << 20, 32 << 20


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return struct.pack(HEAD, len(payload), masked_crc(length)) + payload + struct.pack(CRC, masked_crc(payload))


def unframe(data: bytes | memoryview, at: int = 0) -> tuple[memoryview, int]:
    """The payload of the record at ``at``, and where the next one begins; ValueError if it is damaged."""
    data = memoryview(data)
    length, check = struct.unpack_from(HEAD, data, at)
    if masked_crc(data[at : at + 8]) != check:
        raise ValueError(f"record at {at}: the length doesn't match its check")
    begin = at + HEAD_SIZE
    payload = data[begin : begin + length]
    if len(payload) != length or masked_crc(payload) != struct.unpack_from(CRC, data, begin + length)[0]:
        raise ValueError(f"record at {at}: the payload doesn't match its check")
    return payload, begin + length + struct.calcsize(CRC)


def write_token_records(docs: DataFrame, out: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode every text, append ``end_id`` and write shards and their index below ``out``; returns the index's path.

    Rows are dealt by ranges of (id, hash of the text); each task writes one shard under a name of
    its own, and only shards whose rows the index's commit holds count: a lost or repeated attempt
    leaves at most an unused file.
    """

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder, fs, folder = chunk_encoder(tokenizer), *file_system(f"{out}/shards")
        fs.create_dir(folder, recursive=True)
        shard = TaskContext.get().partitionId()
        name, offset, start, sink = f"shard-{shard:06d}-{uuid.uuid4().hex}.rec", 0, 0, None
        end, kind = np.array([end_id], dtype=encoder.type).tobytes(), encoder.type.newbyteorder("<")
        try:
            for batch in batches:
                for ids, texts in arrow_rows(batch, "id", "text"):
                    rows = []
                    for i, encoded in zip(ids, encoder.encode(texts), strict=True):
                        record = frame(struct.pack(PAYLOAD, i is not None, i or 0, encoder.width) + np.frombuffer(encoded + end, dtype=encoder.type).astype(kind, copy=False).tobytes())
                        sink = sink or fs.open_output_stream(f"{folder}/{name}")
                        sink.write(record)
                        n = len(encoded) // encoder.width + 1
                        rows.append((shard, name, offset, len(record), i, n, start))
                        offset, start = offset + len(record), start + n
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), *[pa.int64()] * 5), strict=True)], ["shard", "file", "offset", "size", "id", "n_tokens", "in_shard"])
        finally:
            if sink:
                sink.close()

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    rows.mapInArrow(write, "shard int, file string, offset long, size long, id long, n_tokens long, in_shard long").write.parquet(f"{out}/rows")
    rows = spark.read.parquet(f"{out}/rows")
    before = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))  # one row for each shard
    rows.join(before, "shard").select("file", "offset", "size", "id", "n_tokens", (F.col("before") + F.col("in_shard")).alias("start")).write.parquet(f"{out}/index")
    return f"{out}/index"


def read_token_records(index: DataFrame, out: str) -> DataFrame:
    """Read the records that rows of the index name, checks verified: (id, start, n_tokens, ids), ids as little-endian u32.

    Any subset in any order will do; neighbouring records of a shard are read together.
    """

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fs, folder = file_system(f"{out}/shards")
        opened, source = None, None
        for batch in batches:
            files, offsets, sizes, starts = next(iter(arrow_rows(batch, "file", "offset", "size", "start", at_once=max(1, batch.num_rows))))
            i = 0
            while i < len(files):
                j, size = i, 0
                while j < len(files) and files[j] == files[i] and offsets[j] == offsets[i] + size and (size < READ_AT_ONCE or j == i):
                    size, j = size + sizes[j], j + 1
                if opened != files[i]:
                    if source:
                        source.close()
                    opened, source = files[i], fs.open_input_file(f"{folder}/{files[i]}")
                source.seek(offsets[i])
                data, at, rows = source.read(size), 0, []
                for k in range(i, j):
                    payload, at = unframe(data, at)
                    has, doc, width = struct.unpack_from(PAYLOAD, payload)
                    ids = np.frombuffer(payload[PAYLOAD_HEAD_SIZE :], dtype=f"<u{width}").astype("<u4")
                    rows.append((doc if has else None, starts[k], len(ids), ids.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["id", "start", "n_tokens", "ids"])
                i = j
        if source:
            source.close()

    return index.select("file", "offset", "size", "start").mapInArrow(read, "id long, start long, n_tokens long, ids binary")


def dealt(index: DataFrame, bytes_per_task: int = READ_PER_TASK) -> DataFrame:
    """The index in as many partitions as its records' bytes ask for, each a stretch of the stream in its order.

    The index itself is tiny, so that its own partitions would follow its size and not the work.
    """
    size, tokens = index.agg(F.sum("size"), F.max(F.col("start") + F.col("n_tokens"))).first()
    parts = max(1, -(-(size or 0) // bytes_per_task))
    stretch = F.floor(F.col("start") / max(1, -(-(tokens or 0) // parts)))
    return index.repartitionById(parts, stretch.cast("int")).sortWithinPartitions("start")


def token_digest(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the records of ``docs``, read them back and give (doc_id, start, n_tokens, ids_crc32)."""
    out = shared_dir(spark, "token-records")
    index = spark.read.parquet(write_token_records(docs, out, tokenizer))
    return read_token_records(dealt(index), out).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
