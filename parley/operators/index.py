"""A stored retrieval index: chunks, hashed vectors and postings in blocks with maxima, extended by segments.

A segment holds some documents, numbered as they are written: no text is shuffled. Postings of a term are cut by ranges of
RANGE documents (and where a batch of rows ends); a block keeps the largest term frequency and the smallest length in it,
which bound its scores whatever the mean length and the term's document frequency come to be later, so new segments leave
old ones alone. A search sums a range's bounds over the terms of a query, scores the most promising ranges first, and then
only those whose bound reaches the k-th score so far: the result is that of scoring everything. What a query asks of a range
is scored where the postings of that range are, and only its k best leave it.

A manifest names the segments of a version and swaps at once (sources.manifest): readers see all of an addition or nothing,
and of two writers one fails. Files that no manifest names are left from failed writers and are deleted by vacuum().
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from parley.functions import text as T
from parley.operators import retrieval
from parley.sources import manifest, shared
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Documents of a range, ranges that are scored first for each query, folders that postings are dealt into by term, and parts
#: that a folder is written in at most.
RANGE, FIRST, BUCKETS, PARTS = 1 << 12, 4, 32, 8
#: Query terms that postings are looked up by as a broadcast filter at most, and ids that an addition is compared with.
TERMS, IDS = 500_000, 2_000_000
K1, B = 1.5, 0.75


@dataclass(frozen=True)
class Index:
    """A version of the index at a path."""

    spark: SparkSession
    path: str
    content: dict

    @property
    def segments(self) -> list[dict]:
        return self.content["segments"]

    def part(self, name: str) -> DataFrame | None:
        """chunks (with tokens, their number and buckets) or postings of all segments, with the segment's number."""
        out = None
        for seg, own in enumerate(self.segments):
            each = self.spark.read.parquet(f"{self.path}/segments/{own['name']}/{name}").withColumn("seg", F.lit(seg))
            out = each if out is None else out.unionByName(each, allowMissingColumns=True)
        return out

    def documents(self) -> int:
        return sum(s["documents"] for s in self.segments)

    def mean(self) -> float:
        return sum(s["tokens"] for s in self.segments) / max(self.documents(), 1)


def _inverted(span: int) -> Callable:
    """Blocks of postings of rows (no, len, tokens), by term and range of `span` numbers."""

    def run(batches):
        for batch in batches:
            no, size, words = (batch.column(c) for c in ("no", "len", "tokens"))
            no, words = no.to_numpy(), words if len(words) else pa.array([], pa.list_(pa.string()))
            order = np.argsort(no, kind="stable")
            place = np.empty(len(no), np.int64)
            place[order] = np.arange(len(no))
            no, size = no[order], size.to_numpy()[order]
            coded = words.flatten().dictionary_encode()
            row = np.repeat(place, words.value_lengths().to_numpy(zero_copy_only=False))
            if not len(row):
                continue
            keys, tf = np.unique(coded.indices.to_numpy().astype(np.int64) << 32 | row, return_counts=True)
            term, row = keys >> 32, keys & 0xFFFFFFFF
            rng = no[row] // span
            first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (rng[1:] != rng[:-1])])
            ends, tf, size = np.r_[first, len(term)].astype(np.int32), tf.astype(np.int32), size[row].astype(np.int32)
            p = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array((no[row] - rng * span).astype(np.int32)), pa.array(tf), pa.array(size)], ["at", "tf", "len"]))
            own = [coded.dictionary.take(pa.array(term[first])), pa.array(rng[first]), pa.array(np.diff(ends).astype(np.int64)), pa.array(np.maximum.reduceat(tf, first)), pa.array(np.minimum.reduceat(size, first)), p]
            yield pa.RecordBatch.from_arrays(own, ["term", "rng", "n", "max_tf", "min_len", "p"])

    return run


def _segment(spark: SparkSession, path: str, corpus: DataFrame, dims: int, analysed: bool = False) -> dict | None:
    """Write the documents of corpus (doc_id, text, ...) as a new segment; null where there are none. Those of other segments are
    analysed already and keep their tokens and buckets."""
    name = uuid.uuid4().hex
    at = f"{path}/segments/{name}"
    if not analysed:
        own = corpus.drop("tokens").withColumn("text", F.coalesce("text", F.lit("")))
        corpus = retrieval.with_buckets(own.withColumn("tokens", T.tokens(F.col("text"))), dims).withColumn("len", F.size("tokens").cast("long"))
    corpus.withColumn("no", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(f"{at}/chunks")
    kept = spark.read.parquet(f"{at}/chunks")
    counts = kept.agg(F.count("*").alias("documents"), F.coalesce(F.sum("len"), F.lit(0)).alias("tokens")).first()
    if not counts["documents"]:
        manifest.delete(spark, at)
        return None
    blocks = kept.select("no", "len", "tokens").mapInArrow(_inverted(RANGE), "term string, rng long, n long, max_tf int, min_len int, p array<struct<at:int,tf:int,len:int>>")
    blocks = blocks.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
    dealt = blocks.repartition("bucket", F.pmod(F.xxhash64("term", F.lit(1)), F.lit(PARTS)))
    dealt.sortWithinPartitions("bucket", "term", "rng").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{at}/postings")
    return {"name": name, "documents": counts["documents"], "tokens": counts["tokens"], "range": RANGE}


def _commit(spark: SparkSession, path: str, before: dict | None, segments: list[dict], embedder: str, dims: int) -> Index:
    content = {"version": (before["version"] if before else 0) + 1, "embedder": embedder, "dims": dims, "segments": segments}
    manifest.commit(spark, f"{path}/manifest", content["version"], content)
    return Index(spark, path, content)


def build(corpus: DataFrame, path: str, embedder: str = "hash-512", dims: int = 512) -> Index:
    """A new version that holds the corpus (doc_id, text, ...) alone. doc_id values are distinct; an empty corpus is an error."""
    spark = corpus.sparkSession
    own = _segment(spark, path, corpus, dims)
    if own is None:
        raise ValueError("the corpus is empty")
    return _commit(spark, path, manifest.read(spark, f"{path}/manifest"), [own], embedder, dims)


def load(spark: SparkSession, path: str, embedder: str = "hash-512", version: int | None = None) -> Index:
    """The newest version (or the one given); raises ValueError where there is none or its embedder is another."""
    content = manifest.read(spark, f"{path}/manifest", version)
    if content is None:
        raise ValueError(f"there is no index at {path}")
    if content["embedder"] != embedder:
        raise ValueError(f"the index was built with {content['embedder']}, not with {embedder}")
    return Index(spark, path, content)


def append(index: Index, corpus: DataFrame) -> Index:
    """A version with the documents of corpus that the index lacks, as a segment of their own; the index itself if it has them
    all. Raises manifest.Conflict if another version came in between."""
    known = index.part("chunks").select("doc_id")
    known = F.broadcast(known) if index.documents() <= IDS else known  # else texts would be shuffled
    own = _segment(index.spark, index.path, corpus.join(known, "doc_id", "left_anti"), index.content["dims"])
    return _commit(index.spark, index.path, index.content, [*index.segments, own], index.content["embedder"], index.content["dims"]) if own else index


def compact(index: Index) -> Index:
    """A version of one segment with the same documents."""
    own = _segment(index.spark, index.path, index.part("chunks").drop("seg", "no"), index.content["dims"], analysed=True)
    return _commit(index.spark, index.path, index.content, [own], index.content["embedder"], index.content["dims"])


def vacuum(index: Index, keep: int = 1) -> list[str]:
    """Delete segments that none of the `keep` newest versions names; their names."""
    spark, folder = index.spark, f"{index.path}/manifest"
    held = {s["name"] for v in manifest.versions(spark, folder)[-keep:] for s in manifest.read(spark, folder, v)["segments"]}
    gone = [n for n in manifest.names(spark, f"{index.path}/segments") if n not in held]
    for name in gone:
        manifest.delete(spark, f"{index.path}/segments/{name}")
    return gone


def stats(index: Index) -> DataFrame:
    """source_type (null: all), chunks, docs (distinct titles) of the index's version, with embedder, dims and version."""
    c = index.part("chunks")
    return c.rollup("source_type").agg(F.count("*").alias("chunks"), F.count_distinct("title").alias("docs")).withColumns({"embedder": F.lit(index.content["embedder"]), "dims": F.lit(index.content["dims"]), "version": F.lit(index.content["version"])})


def _scored(blocks: DataFrame, postings: DataFrame, mean: float, k: int, ranges: list[int]) -> DataFrame:
    """query_id, seg, no, score over blocks (query_id, seg, rng, term, idf): of each range the k best of a query, and all that
    equal the k-th. ranges: documents of a range, by segment."""

    def score(key, asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out, own = [], own.sort_values("term")
        sizes = own["at"].str.len().to_numpy(np.int64)
        at, tf, length = (np.concatenate(own[c].tolist()) if len(own) else np.empty(0, np.int32) for c in ("at", "tf", "len"))
        weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
        ends, names = np.r_[0, np.cumsum(sizes)], own["term"].to_numpy()
        cut = np.flatnonzero(np.r_[True, names[1:] != names[:-1], True]) if len(own) else np.zeros(1, np.int64)
        spans = {names[a]: (ends[a], ends[b]) for a, b in zip(cut[:-1], cut[1:], strict=True)}
        for query, part in asked.groupby("query_id", sort=False):
            parts = [(spans[t], x) for t, x in zip(part["term"], part["idf"], strict=True) if t in spans]
            if not parts:
                continue
            found = np.round(np.bincount(np.concatenate([at[a:b] for (a, b), _ in parts]), np.concatenate([weight[a:b] * x for (a, b), x in parts])), 4)
            least = np.partition(found, -k)[-k] if len(found) > k else 0.0
            rows = np.flatnonzero((found >= least) & (found > 0))
            out.append(pd.DataFrame({"query_id": [query] * len(rows), "seg": key[0], "no": key[1] * ranges[key[0]] + rows, "score": found[rows]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "seg": [], "no": [], "score": []})

    at = blocks.select("seg", "rng").distinct()  # as many as there are documents / RANGE
    own = postings.join(F.broadcast(at), ["seg", "rng"], "left_semi").select("seg", "rng", "term", "p.at", "p.tf", "p.len")
    both = blocks.select("query_id", "seg", "rng", "term", "idf").groupBy("seg", "rng").cogroup(own.groupBy("seg", "rng"))
    return both.applyInPandas(score, f"query_id {dict(blocks.dtypes)['query_id']}, seg int, no long, score double")


def search(index: Index, queries: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """(results, reads): results query_id, rank, doc_id, score as retrieval.ranked(retrieval.bm25(...), k) gives them; reads
    query_id, blocks, read: blocks of the query's terms, and how many of them were scored."""
    n, mean, spans = index.documents(), max(index.mean(), 1e-9), [s["range"] for s in index.segments]
    asked = queries.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    wanted = asked.select("term").distinct()
    if wanted.count() <= TERMS:
        wanted = F.broadcast(wanted)
    postings = index.part("postings").drop("bucket").join(wanted, "term", "left_semi")
    each = postings.groupBy("seg", "rng", "term")
    heads = shared.written(each.agg(F.sum("n").alias("n"), F.max("max_tf").alias("max_tf"), F.min("min_len").alias("min_len")), "heads")
    df = heads.groupBy("term").agg(F.sum("n").alias("df")).withColumn("idf", retrieval.idf(F.lit(n), F.col("df")))
    bound = F.col("idf") * F.col("max_tf") * (K1 + 1) / (F.col("max_tf") + K1 * (1 - B + B * F.col("min_len") / mean))
    blocks = shared.written(asked.join(df.select("term", "idf"), "term").join(heads, "term").select("query_id", "seg", "rng", "term", "idf", bound.alias("bound")), "blocks")
    ranges = blocks.groupBy("query_id", "seg", "rng").agg((F.sum("bound") + 1e-3).alias("bound"))  # more than rounding adds
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "seg", "rng"))
    ranges = shared.written(ranges.withColumn("first", best <= FIRST), "ranges")
    at = ["query_id", "seg", "rng"]
    seeds = shared.written(_scored(blocks.join(ranges.filter("first"), at, "left_semi"), postings, mean, k, spans), "scored")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    least = seeds.withColumn("place", place).filter(F.col("place") == k).select("query_id", F.col("score").alias("least"))
    more = shared.written(ranges.filter("not first").join(least, "query_id", "left").filter("least is null or bound >= least").select(*at), "ranges")
    rest = _scored(blocks.join(more, at, "left_semi"), postings, mean, k, spans)
    tied = F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    top = seeds.unionByName(rest).withColumn("tied", tied).filter(F.col("tied") <= k).drop("tied")
    named = top.join(index.part("chunks").select("seg", "no", "doc_id"), ["seg", "no"])
    read = blocks.join(ranges.filter("first").select(*at).unionByName(more).withColumn("read", F.lit(1)), at, "left")
    reads = read.groupBy("query_id").agg(F.count("*").alias("blocks"), F.count("read").alias("read"))
    return retrieval.ranked(named, k).select("query_id", "rank", "doc_id", "score"), reads


def nearest(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, doc_id, score of the k texts with the nearest hashed vectors, from the stored buckets."""
    found = retrieval.cosine(queries, index.part("chunks"), k, dims=index.content["dims"])
    return retrieval.ranked(found, k).select("query_id", "rank", "doc_id", "score")


def corpus(index: Index) -> DataFrame:
    """The chunks with their tokens and buckets, as retrieval.hybrid() takes them: nothing is cut or analysed again."""
    return index.part("chunks").drop("seg", "no", "len", *(["b"] if index.content["dims"] != 512 else []))
