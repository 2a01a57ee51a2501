"""Operator 4: length-delimited binary records of token ids.

File format (all numbers little-endian)
    header   b"SLTOK\\x01", one byte id width (2 or 4), one zero byte
    record   uint64 length of the payload
             uint32 masked checksum of those eight bytes
             payload: one byte, 1 if there is a document id, else 0; int64
             document id (0 if there is none); the ids in the file's width
             uint32 masked checksum of the payload
The checksum is CRC-32; masking is rotate right by 15 plus 0xA282EAD8 (modulo
2**32), so that records stored inside records don't check themselves.

Beside the files stands an offset index, a Parquet table of
(part, path, doc_id, position, bytes, n_tokens), from which single records can
be read in any order with one seek each (:func:`read_records_at`).

Files are written under names unique to the task attempt and count only when
the index, which Spark commits as a whole, names them: a retried or speculative
task leaves at most an unnamed file behind.

Defined results for odd input: null text is an empty sequence (its end id
only); rows without a document id come last; repeated ids are written once per
row, in the order of a hash of their text, and may go to several files; an empty
table gives no files and an empty result; extra columns are ignored; texts of
any length are encoded whole.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from starloom.llm.common import as_uri, fresh_path, open_input, open_output, short_batches
from starloom.llm.tokens import encoder, tokenizer_file

MAGIC = b"SLTOK\x02"
INDEX = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("position", T.LongType()), T.StructField("bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
#: Stretch of a file that one reading task takes on.
READ_BYTES = 32 << 20


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def unframe(stream, path: str) -> bytes | None:
    """The next payload, None at the end; raises on a damaged record."""
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
        raise ValueError(f"damaged record length in {path}")
    n = struct.unpack("<Q", head[:8])[0]
    body = stream.read(n + 4)
    if len(body) < n + 4 or struct.unpack("<I", body[n:])[0] != masked(body[:n]):
        raise ValueError(f"damaged record in {path}")
    return body[:n]


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) dealt out by ranges and sorted: by id, nulls last, then by a hash of the text.

    Equal rows are told apart by their number, so a very common id is spread over several ranges.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("hash"), F.col("row")]
    ranges = rows.repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order)
    return ranges.sortWithinPartitions(*order).select("doc_id", "text")


def write_token_files(docs: DataFrame, out_dir: str, *, tokenizer: str | None = None, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts, write records in ascending id order, return the index.

    Documents are dealt out by ranges of ids and sorted within each, so file
    ``part`` holds smaller ids than file ``part + 1``. Each task streams its
    records to one file; nothing but the index passes through Spark.
    """
    spark = docs.sparkSession
    short_batches(spark)
    path = tokenizer or tokenizer_file()
    root = as_uri(out_dir).rstrip("/")
    ordered = in_order(docs, id_col, text_col)

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(path)
        width = 2 if enc.tokenizer.get_vocab_size() <= 1 << 16 else 4
        tail = b"" if end_id is None else struct.pack("<I", end_id)
        out, name, at = None, f"{root}/part-{part:06d}-{uuid.uuid4().hex}.tok", 0
        try:
            for batch in batches:
                if out is None:
                    out = open_output(name)
                    out.write(MAGIC + bytes([width, 0]))
                    at = len(MAGIC) + 2
                index = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    ids = np.frombuffer(enc.encode_bytes(text) + tail, dtype="<u4")
                    record = frame(struct.pack("<?q", doc_id is not None, doc_id or 0) + ids.astype(f"<u{width}").tobytes())
                    out.write(record)
                    index.append((part, name, doc_id, at, len(record), len(ids)))
                    at += len(record)
                yield pa.RecordBatch.from_pylist([dict(zip(INDEX.names, x, strict=True)) for x in index], schema=_arrow(INDEX))
        finally:
            if out is not None:
                out.close()

    index_dir = f"{root}/index"
    ordered.mapInArrow(write, INDEX).write.parquet(index_dir)
    return spark.read.schema(INDEX).parquet(index_dir)


def _arrow(schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def open_records(path: str, position: int | None = None):
    """Stream of records (at ``position`` if given) and the width of their ids."""
    stream = open_input(path)
    head = stream.read(len(MAGIC) + 2)
    if head[: len(MAGIC)] != MAGIC:
        raise ValueError(f"not a token file: {path}")
    if position is not None:
        stream.seek(position)
    return stream, head[len(MAGIC)]


def parse(payload: bytes, width: int) -> tuple[int | None, np.ndarray]:
    known, doc_id = struct.unpack("<?q", payload[:9])
    return doc_id if known else None, np.frombuffer(payload, dtype=f"<u{width}", offset=9).astype("<u4")


def read_token_files(index: DataFrame) -> DataFrame:
    """The records of all files the index names: (part, doc_id, n_before, ids as bytes).

    Reads the files, not the index: the index only says which stretches of
    which files there are, so that long files are read by several tasks.
    ``start`` is the number of ids in all earlier records.
    """
    short_batches(index.sparkSession)
    piece = F.floor(F.col("position") / READ_BYTES).cast("int")
    runs = index.groupBy("part", "path", piece.alias("piece")).agg(F.min("position").alias("position"), F.max(F.col("position") + F.col("bytes")).alias("end"), F.sum("n_tokens").alias("tokens"))
    # One row per file stretch of 32 MB: this window, one task, sorts some 30 thousand rows for each terabyte of ids.
    before = F.sum("tokens").over(Window.orderBy("part", "path", "piece").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("start", F.coalesce(before, F.lit(0)))
    runs = runs.select("part", "path", "position", "end", "start").repartition(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part", "position")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType())])

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for run in batch.to_pylist():
                stream, width = open_records(run["path"], run["position"])
                start, out, held = run["start"], [], 0
                with stream:
                    while stream.tell() < run["end"]:
                        doc_id, ids = parse(unframe(stream, run["path"]), width)
                        out.append({"doc_id": doc_id, "start": start, "ids": ids.tobytes()})
                        start, held = start + len(ids), held + 4 * len(ids)
                        if held >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(out, schema=_arrow(schema))
                            out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=_arrow(schema))

    return runs.mapInArrow(read, schema)


def read_records_at(spark: SparkSession, picks: DataFrame) -> DataFrame:
    """Records at the (path, position) pairs of ``picks``, in any order: one seek each."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType()))])

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for path, position in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                stream, width = open_records(path, position)
                with stream:
                    doc_id, ids = parse(unframe(stream, path), width)
                out.append({"doc_id": doc_id, "ids": ids.tolist()})
            yield pa.RecordBatch.from_pylist(out, schema=_arrow(schema))

    return picks.select("path", "position").sort("path", "position").mapInArrow(read, schema)


def token_digest(docs: DataFrame, *, out_dir: str | None = None) -> DataFrame:
    """Write ``docs``, read the files back, and digest each document's ids."""
    spark = docs.sparkSession
    index = write_token_files(docs, out_dir or fresh_path(spark, "tokens"))
    back = read_token_files(index)
    return back.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
