"""What the operators share: shared folders, bounded bit sets, word hashes."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOWER_SPACE = bytes(32 if i == 32 or 9 <= i <= 13 else i + 32 if 65 <= i <= 90 else i for i in range(256))
_RNG = np.random.default_rng(20240229)
_BYTE_KEYS = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


#: What operators remember in a worker from task to task; the next task of another operator may need the room.
CACHES: list[dict] = []


def release() -> None:
    """Give up what this worker remembers for other operators' tasks."""
    if any(CACHES):
        for cache in CACHES:
            cache.clear()
        give_back()
    pa.default_memory_pool().release_unused()


def give_back() -> None:
    """Give memory that Python has freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # else freed blocks stay with the process
        trim(0)


#: Bytes of the driver's heap that the last collection of relieve() left.
_left = 0


def relieve(spark: SparkSession) -> None:
    """Collect the driver's garbage where its heap has grown beyond half of what it may take: it shrinks then, and Spark deletes
    shuffles and broadcasts that no frame refers to. A heap of fixed size is left alone after the first time."""
    global _left
    runtime = spark._jvm.Runtime.getRuntime()
    total = runtime.totalMemory()
    if total > max(_left, runtime.maxMemory() // 2):
        gc.collect()
        spark._jvm.System.gc()
        total = runtime.totalMemory()
    _left = total


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new local one where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Of rows of megabytes: else Parquet looks at sizes only after 100 rows, and those are one page and read as one batch.
LONG_ROWS = {"parquet.block.row.count.limit": "2", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def materialize(df: DataFrame, name: str, batch: str = "8m", options: dict[str, str] | None = None) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder, which lost executors can't take away. While it is written,
    Python gets its rows in batches of so many bytes, so that long texts don't add up."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    path, before = new_path(spark, name), spark.conf.get(key)
    spark.conf.set(key, batch)
    try:
        df.write.options(**(options or {})).parquet(path)
    finally:
        spark.conf.set(key, before)
    relieve(spark)  # else many small jobs let the heap grow to its end
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete a table that materialize() wrote and no later result reads."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of all texts in order, A-Z lower-cased, and where each text's
    words begin (one more entry than texts)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
    data = np.frombuffer(b" " + b" ".join(raw).translate(_LOWER_SPACE) + b" ", np.uint8)
    inside = data != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, lens = edges[::2], edges[1::2] - edges[::2]
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    bounds[-1] = len(starts)
    if not len(starts):
        return np.empty(0, np.uint64), bounds
    offsets = np.cumsum(lens) - lens
    powers = np.cumprod(np.full(int(lens.max()), _BASE, np.uint64))
    place = np.arange(int(lens.sum())) - np.repeat(offsets, lens)
    return mix(np.add.reduceat(_BYTE_KEYS[data[inside]] * powers[place], offsets)), bounds


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of n words."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out = out * _BASE + words[k : len(words) - n + 1 + k]
    return mix(out)


def text_slices(frames: Iterator[pd.DataFrame], col: str, chars: int = 1_000_000) -> Iterator[pd.DataFrame]:
    """The frames again, in slices of at most so many characters (one row at least)."""
    for frame in frames:
        if not len(frame):
            continue
        slot = np.cumsum(frame[col].str.len().fillna(0).to_numpy(np.int64)) // chars
        for _, part in frame.groupby(slot, sort=False):
            yield part


def build_bits(rows: DataFrame, bits: int, positions: Callable[[pd.DataFrame], np.ndarray], held: int = 1_000_000) -> np.ndarray:
    """A bit set of fixed size (bits / 8 bytes) of the positions of all rows. Tasks send their positions by chunks of 65,536
    bits, as offsets or as a bit map, whichever is shorter; the task that owns a chunk merges them as they
    come."""

    def dense(offsets: np.ndarray) -> np.ndarray:
        chunk = np.zeros(1 << 16, np.uint8)
        chunk[offsets] = 1
        return np.packbits(chunk, bitorder="little")

    def pack(frames):
        pool, size = [], 0

        def flush():
            pos = np.unique(np.concatenate(pool)).astype(np.uint64)
            chunk, first = np.unique(pos >> np.uint64(16), return_index=True)
            parts = np.split((pos & np.uint64(0xFFFF)).astype("<u2"), first[1:])
            return pd.DataFrame({"chunk": chunk.astype(np.int64), "data": [(x if len(x) < 4096 else dense(x)).tobytes() for x in parts]})

        for f in frames:
            pool.append(positions(f))
            size += len(pool[-1])
            if size > held:
                yield flush()
                pool, size = [], 0
        if size:
            yield flush()

    def merge(frames):
        chunks: dict[int, np.ndarray] = {}
        loose: dict[int, list[np.ndarray]] = {}
        size = 0

        def add(chunk: int, bitmap: np.ndarray) -> None:
            chunks[chunk] = chunks[chunk] | bitmap if chunk in chunks else bitmap

        def fold() -> None:
            for chunk, parts in loose.items():
                add(chunk, dense(np.concatenate(parts)))
            loose.clear()

        for f in frames:
            for chunk, data in zip(f["chunk"].tolist(), f["data"], strict=True):
                if len(data) == 1 << 13:
                    add(chunk, np.frombuffer(data, np.uint8))
                else:
                    loose.setdefault(chunk, []).append(np.frombuffer(data, "<u2"))
                    size += len(data) // 2
            if size > held:
                fold()
                size = 0
        fold()
        yield pd.DataFrame({"chunk": pd.Series(list(chunks), dtype="int64"), "data": [x.tobytes() for x in chunks.values()]})

    schema = "chunk long, data binary"
    whole = rows.mapInPandas(pack, schema).repartition("chunk").mapInPandas(merge, schema).toArrow().to_pandas()
    out = np.zeros(max(bits, 1 << 16) // 64, np.uint64)
    for chunk, data in zip(whole["chunk"].tolist(), whole["data"], strict=True):
        out[chunk << 10 : (chunk + 1) << 10] = np.frombuffer(data, np.uint64)
    return out


def has_bit(bits: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return (bits[pos >> np.uint64(6)] >> (pos & np.uint64(63))) & np.uint64(1) == 1


def frequency_floor(counts: DataFrame, col: str, most: int) -> int:
    """The smallest frequency from which on at most `most` rows remain; reads a histogram of at most 512 lines."""
    level = F.floor(F.log2(F.col(col).cast("double")) * 8).cast("long")
    left, floor = most, None
    for row in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.min(col).alias("least")).collect(), key=lambda r: -r["level"]):
        left -= row["n"]
        if left < 0:
            break
        floor = row["least"]
    return int(floor) if floor is not None else (1 << 62)
