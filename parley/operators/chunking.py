"""Splitting of documents: heading sections, overlapping windows, and both together as chunks with identities."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters that end a sentence, what ends a line, and white space.
ENDS = "。！？!?；;\n"
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"
SPACE = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def _bounds(text: str, most: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Windows of at most `most` characters, cut after the last sentence end of their second half, each starting `overlap`
    before the last one's end."""
    at = 0
    while True:
        end = min(at + most, len(text))
        if end < len(text):
            cut = max(text.rfind(c, at + most // 2, end) for c in ENDS)
            end = cut + 1 if cut > at else end
        yield at, end
        if end >= len(text):
            return
        at = max(end - overlap, at + 1)


def window_list(text: Column, most: int = 420, overlap: int = 80) -> Column:
    """array<struct<start, text>>: trimmed windows without empty ones. Each start depends on the end before, which is a walk
    along the text: built-in folds would cut it from its start at each step. Null and empty texts have none."""

    def walk(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "text": own} for a, b in _bounds(t, most, overlap) if (own := t[a:b].strip() if len(t) > most else t)] if t else [] for t in texts], dtype=object)

    return F.pandas_udf(walk, "array<struct<start:int,text:string>>")(text)


def windows(docs: DataFrame, most: int = 420, overlap: int = 80) -> DataFrame:
    """doc_id, piece (from 0), start, piece_text of every text."""
    cut = docs.select("doc_id", F.posexplode(window_list(F.col("text"), most, overlap)).alias("piece", "w"))
    return cut.select("doc_id", "piece", F.col("w.start").alias("start"), F.col("w.text").alias("piece_text"))


def sections(docs: DataFrame) -> DataFrame:
    """doc_id, section_no, path ("a > b"), start, body of Markdown texts. Sections of blank lines are neither kept nor
    counted, bodies are stripped, and start is the place after the heading, one character for each line end."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", LINE_END)).alias("pos", "line"))
    heading = rf"^(#{{1,6}}){SPACE}+(.*)$"
    order = Window.partitionBy("doc_id").orderBy("pos")
    lines = lines.withColumn("level", F.length(F.regexp_extract("line", heading, 1)))
    lines = lines.withColumn("no", F.sum((F.col("level") > 0).cast("int")).over(order)).withColumn("after", F.sum(F.length("line") + 1).over(order))
    title = stripped(F.regexp_extract("line", heading, 2))
    for k in range(1, 7):
        own = F.when(F.col("level") == k, F.struct(F.col("pos").alias("p"), title.alias("t")))
        lines = lines.withColumn(f"h{k}", F.last(own, ignorenulls=True).over(order))
    live = [F.when(F.col(f"h{k}.p") > F.greatest(F.lit(-1), *[F.coalesce(F.col(f"h{j}.p"), F.lit(-1)) for j in range(1, k)], F.lit(-1)), F.col(f"h{k}.t")) for k in range(1, 7)]
    lines = lines.withColumn("path", F.concat_ws(" > ", *live))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    start = F.coalesce(F.max(F.when(F.col("level") > 0, F.col("after"))), F.lit(0)).cast("int")
    whole = lines.groupBy("doc_id", "no").agg(F.max("path").alias("path"), start.alias("start"), stripped(body).alias("body")).filter("body != ''")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("no")) - 1
    return whole.select("doc_id", rank.alias("section_no"), "path", "start", "body")


def chunk_id(doc: Column, path: Column, section: Column, piece: Column, text: Column) -> Column:
    digest = F.substring(F.sha1(F.concat_ws("|", doc, path, piece.cast("string"), F.substring(text, 1, 64))), 1, 12)
    return F.concat(doc, F.lit("#"), section.cast("string"), F.lit("-"), piece.cast("string"), F.lit("-"), digest)


def chunks(docs: DataFrame, most: int = 420, overlap: int = 80, source_type: str = "knowledge") -> DataFrame:
    """chunk_id, doc_id (as text), title, section, text, source_type, start of Markdown texts: sections, then windows of
    their bodies. docs: doc_id, text and, if it has one, title (else the id)."""
    title = F.coalesce(F.col("title"), F.col("doc_id").cast("string")) if "title" in docs.columns else F.col("doc_id").cast("string")
    named = docs.select(F.struct(F.col("doc_id").cast("string").alias("doc"), title.alias("title")).alias("doc_id"), "text")
    cut = sections(named).select("*", F.posexplode(window_list(F.col("body"), most, overlap)).alias("piece", "w"))
    own = chunk_id(F.col("doc_id.doc"), F.col("path"), F.col("section_no"), F.col("piece"), F.col("w.text"))
    return cut.select(own.alias("chunk_id"), F.col("doc_id.doc").alias("doc_id"), F.col("doc_id.title").alias("title"), F.col("path").alias("section"), F.col("w.text").alias("text"), F.lit(source_type).alias("source_type"), "start")
