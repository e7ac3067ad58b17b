"""Operator 3: token ids as length-delimited binary records with a separate offset index.

A shard is a file of frames in ascending doc_id order, closed by one line end:

    length (8 bytes) | masked checksum of those 8 | doc_id (8) | flag (1: doc_id is null) | ids | masked checksum of the body

All numbers are little-endian; length counts the body (doc_id, flag, ids). Ids take 2 bytes each where the vocabulary and the
end id fit in them, else 4. A checksum is CRC-32, rotated right by 15 bits plus 0xA282EAD8, so that checksums of data that hold
checksums stay sound. The index has a row a record: shard, file, offset, size, doc_id, n_tokens, ids_crc32, and start, the
ids of all documents before it. A reader may take records in any order, each a slice of its file.

Files are written by Spark's text writer, which passes bytes on as they are, so any file system that Spark reaches will do.

Defined cases: a null or empty text is the end id alone; null doc_ids come first; equal doc_ids are ordered by a hash of the text; an
empty table gives no shards and no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from .tokens import encoder

#: Bytes of text a shard is planned for; a shard is read as one value.
SHARD_BYTES = 12 << 20


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes) -> bytes:
    body = struct.pack("<qB", doc_id or 0, doc_id is None) + ids
    head = struct.pack("<Q", len(body))
    return b"".join((head, struct.pack("<I", masked(head)), body, struct.pack("<I", masked(body))))


def frames(data: bytes | memoryview) -> Iterator[tuple[int, int, int | None, bytes]]:
    """(offset, size, doc_id, ids) of each record; raises ValueError where a checksum or length is wrong."""
    view, at = memoryview(data), 0
    while at < len(view) - 1:
        head = bytes(view[at : at + 8])
        (length,) = struct.unpack("<Q", head)
        body = bytes(view[at + 12 : at + 12 + length])
        if struct.unpack_from("<I", view, at + 8)[0] != masked(head) or len(body) != length or struct.unpack_from("<I", view, at + 12 + length)[0] != masked(body):
            raise ValueError(f"record at {at} is damaged")
        doc_id, null = struct.unpack_from("<qB", body)
        yield at, length + 16, None if null else doc_id, body[9:]
        at += length + 16
    if bytes(view[at:]) != b"\n":
        raise ValueError("the shard's end is missing")


def id_width(tokenizer: str, end_id: int) -> int:
    """Bytes of an id: 2 where all ids of the vocabulary and the end id fit in them, else 4."""
    return 2 if max(encoder(tokenizer).largest, end_id) < 1 << 16 else 4


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, width: int, shard_bytes: int = SHARD_BYTES) -> None:
    """Shards of docs (doc_id, text) under path/shard=N, in ascending doc_id order over all shards. Shards are dealt by
    ranges of doc_id and of a hash of the text, so that rows of one id need not share a shard and no text is sampled."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    if size is None:
        return
    end = np.array([end_id], "<u4").tobytes()

    def run(parts):
        enc, out = encoder(tokenizer), []
        for part in C.text_slices(parts, "text", 4_000_000):
            ids = enc.encode(part["text"].tolist())
            if width == 2:
                ids = [np.frombuffer(x + end, "<u4").astype("<u2").tobytes() for x in ids]
            else:
                ids = [x + end for x in ids]
            out += [frame(None if pd.isna(d) else int(d), x) for d, x in zip(part["doc_id"], ids, strict=True)]
        if out:
            yield pd.DataFrame({"data": [b"".join(out)]})

    dealt = docs.withColumn("hash", F.xxhash64("text")).repartitionByRange(size // shard_bytes + 1, "doc_id", "hash")
    blocks = dealt.sortWithinPartitions("doc_id", "hash", "text").drop("hash").mapInPandas(run, "data binary").select(F.spark_partition_id().alias("shard"), F.col("data").cast("string").alias("data"))
    blocks.write.partitionBy("shard").option("compression", "none").text(path)


def read(spark: SparkSession, path: str, width: int) -> DataFrame:
    """shard, file, offset, size, doc_id, n_tokens, local_start, ids_crc32 of every record, with all checksums verified."""

    def run(parts):
        for part in parts:
            for path, data in zip(part["path"], part["content"], strict=True):
                rows, before = [], 0
                for offset, size, doc_id, ids in frames(data):
                    wide = ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                    rows.append((int(path.rsplit("shard=", 1)[1].split("/")[0]), path, offset, size, doc_id, len(wide) // 4, before, zlib.crc32(wide)))
                    before += len(wide) // 4
                out = pd.DataFrame(rows, columns=["shard", "file", "offset", "size", "doc_id", "n_tokens", "local_start", "ids_crc32"])
                yield out.astype({"doc_id": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, "shard long, file string, offset long, size long, doc_id long, n_tokens long, local_start long, ids_crc32 long")


def with_starts(records: DataFrame) -> DataFrame:
    """`start` for each record, from the shards' totals (one row a shard)."""
    totals = records.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("before"))
    return records.join(before, "shard").withColumn("start", F.col("before") + F.col("local_start")).drop("before", "local_start")


def token_records(docs: DataFrame, tokenizer: str, end_id: int) -> tuple[DataFrame, str]:
    """Write the shards and their index in the shared folder; the index, and the folder of the shards."""
    spark = docs.sparkSession
    path = C.new_path(spark, "records")
    width = id_width(tokenizer, end_id)
    write(docs, path, tokenizer, end_id, width)
    schema = "shard long, file string, offset long, size long, doc_id long, n_tokens long, ids_crc32 long, start long"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        return spark.createDataFrame([], schema), path
    return C.materialize(with_starts(C.materialize(read(spark, path, width), "records-read")), "records-index"), path
