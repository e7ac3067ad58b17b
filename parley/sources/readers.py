"""Readers and writers of corpora, glossaries, mappings and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

GLOSSARY = "version string, terms array<struct<term: string, canonical: string, aliases: array<string>, definition: string, owner: string>>"


def markdown(spark: SparkSession, path: str, source_type: str) -> DataFrame:
    """doc_id (file stem), text, source_type of all *.md below a folder; a missing folder has none."""
    schema = S.StructType([S.StructField(c, S.StringType()) for c in ("doc_id", "text", "source_type")])
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    files = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.md$", "")
    return files.select(stem.alias("doc_id"), F.col("value").alias("text"), F.lit(source_type).alias("source_type"))


def corpora(spark: SparkSession, folders: list[tuple[str, str]]) -> DataFrame:
    """The union of (path, source_type) folders."""
    out = markdown(spark, *folders[0])
    for folder in folders[1:]:
        out = out.unionByName(markdown(spark, *folder))
    return out


def glossary(spark: SparkSession, path: str) -> DataFrame:
    """term, canonical, aliases, definition, owner, ord; blank terms are dropped and a broken file has none."""
    terms = spark.read.schema(GLOSSARY).option("multiLine", True).json(path).select(F.posexplode("terms").alias("ord", "t"))
    own = terms.select(F.trim("t.term").alias("term"), "t.canonical", "t.aliases", "t.definition", "t.owner", "ord")
    return own.filter("term != ''").withColumn("canonical", F.coalesce(F.nullif(F.trim("canonical"), F.lit("")), "term"))


def user_map(spark: SparkSession, path: str) -> DataFrame:
    """name (normalised), account: values are an account or an object with account and aliases."""
    from parley.functions.text import normalized

    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    each = text.select(F.explode("m").alias("name", "value"))
    who = F.from_json("value", "account string, aliases array<string>")
    each = each.select("name", F.coalesce(who["account"], "value").alias("account"), F.coalesce(who["aliases"], F.array().cast("array<string>")).alias("aliases"))
    return each.select(F.explode(F.concat(F.array("name"), "aliases")).alias("name"), "account").select(normalized(F.col("name")).alias("name"), "account")


def append_audit(records: DataFrame, path: str) -> None:
    """Append (ts, tool, actor, status, duration_ms, args, error) as JSON lines, arguments as a digest and errors cut to 500 characters."""
    digest = F.substring(F.sha2(F.coalesce("args", F.lit("")), 256), 1, 32)
    records.withColumn("args_digest", digest).withColumn("error", F.substring("error", 1, 500)).drop("args").write.mode("append").json(path)


def audit_tail(log: DataFrame, n: int) -> DataFrame:
    """The last n records, oldest first."""
    return log.orderBy(F.desc("ts"), F.desc("event_id")).limit(n).orderBy("ts", "event_id")


def write_index(postings: DataFrame, lengths: DataFrame, path: str, meta: dict) -> None:
    """Postings and lengths as Parquet with their description; read_index() checks it."""
    import json

    spark = postings.sparkSession
    postings.write.mode("overwrite").parquet(f"{path}/postings")
    lengths.write.mode("overwrite").parquet(f"{path}/lengths")
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def read_index(spark: SparkSession, path: str, embedder: str) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths); raises ValueError where the index was built with another embedder."""
    import json

    meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    if meta.get("embedder") != embedder:
        raise ValueError(f"the index was built with {meta.get('embedder')}, not with {embedder}")
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths")


#: A line of a transcript: start, end, speaker, text.
TURN = r"^\[(\d+(?:\.\d+)?)s-(\d+(?:\.\d+)?)s\] ([^:]*): (.*)$"
QUESTION = "id string, category string, question string, expected_sources array<string>, expected_terms array<string>"
TOOL_TASK = "id string, category string, request string, expected_tools array<string>, expected_args map<string,string>"
CHUNK = "chunk_id string, doc_id string, doc_title string, section string, text string, source_type string, start int, metadata map<string,string>"
GOLDEN = "meeting_id string, action_items array<struct<assignee:string,keywords:array<string>,deadline_hint:string>>"


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """meeting_id (file stem), seq, start, end, speaker, text, bad of transcript files, a row a line. Lines that are no turn have
    bad, the line and why, and no speaker; empty lines are left out."""
    files = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "")
    lines = files.select(stem.alias("meeting_id"), F.posexplode(F.split("value", r"\r?\n")).alias("seq", "line")).filter(F.trim("line") != "")
    part = lambda k: F.when(F.col("line").rlike(TURN), F.regexp_extract("line", TURN, k))
    start, end = part(1).try_cast("double"), part(2).try_cast("double")
    why = F.when(~F.col("line").rlike(TURN), "no turn").when(end < start, "it ends before it starts")
    own = lines.select("meeting_id", "seq", start.alias("start"), end.alias("end"), part(3).alias("speaker"), part(4).alias("text"), F.when(why.isNotNull(), F.struct("line", why.alias("reason"))).alias("bad"))
    return own.select("meeting_id", "seq", *[F.when(F.col("bad").isNull(), F.col(c)).alias(c) for c in ("start", "end", "speaker", "text")], "bad")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a schema (QUESTION, TOOL_TASK, CHUNK) from JSON lines, with bad: the line if it does not fit, else null."""
    own = spark.read.schema(f"{schema}, bad string").option("columnNameOfCorruptRecord", "bad").json(path)
    return own.select(*own.columns)


def golden_actions(spark: SparkSession, path: str) -> DataFrame:
    """grp (meeting), g, assignee, keywords, deadline_hint from a JSON file of expected action items, as matching.greedy() takes
    them."""
    own = spark.read.schema(GOLDEN).option("multiLine", True).json(path).select("meeting_id", F.posexplode("action_items").alias("g", "a"))
    return own.select(F.col("meeting_id").alias("grp"), F.col("g").cast("long").alias("g"), "a.assignee", "a.keywords", "a.deadline_hint")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks (chunk_id, doc_id, title, section, text, source_type, start) as JSON lines of CHUNK."""
    meta = F.col("metadata") if "metadata" in chunks.columns else F.create_map().cast("map<string,string>")
    chunks.select("chunk_id", "doc_id", F.col("title").alias("doc_title"), "section", "text", "source_type", F.col("start").cast("int").alias("start"), meta.alias("metadata")).write.option("ignoreNullFields", "false").json(path)


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks that write_chunks() wrote, as retrieval and the index take them; lines that are no chunk raise ValueError."""
    own = json_lines(spark, path, CHUNK)
    if not own.filter(F.col("bad").isNotNull() | F.col("chunk_id").isNull()).isEmpty():
        raise ValueError(f"{path} holds lines that are no chunk")
    return own.drop("bad").withColumnRenamed("doc_title", "title")


def bm25_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(postings: term, doc_id, tf; lengths: doc_id, len) of an index saved as one JSON object with doc_ids, term_freqs and
    doc_len in one order. Ids without frequencies or lengths raise ValueError."""
    schema = "doc_ids array<string>, term_freqs array<map<string,int>>, doc_len array<long>"
    whole = spark.read.schema(schema).option("multiLine", True).json(path)
    if not whole.filter("size(doc_ids) <> size(term_freqs) or size(doc_ids) <> size(doc_len) or doc_ids is null").isEmpty():
        raise ValueError(f"{path} is no index")
    each = whole.select(F.explode(F.arrays_zip("doc_ids", "term_freqs", "doc_len")).alias("d"))
    postings = each.select(F.col("d.doc_ids").alias("doc_id"), F.explode("d.term_freqs").alias("term", "tf"))
    return postings.select("term", "doc_id", "tf"), each.select(F.col("d.doc_ids").alias("doc_id"), F.col("d.doc_len").alias("len"))
