"""The terminology layer: surface forms, matching by substring, expansion of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of an index gram, and forms that are looked for one after the other at most.
GRAM, LOOP = 3, 1_000


def forms(glossary: DataFrame) -> DataFrame:
    """term, ord, form: distinct non-empty forms (term, canonical, aliases) in order. glossary: term, canonical, aliases, ord."""
    every = F.array_distinct(F.filter(F.concat(F.array("term", F.coalesce("canonical", "term")), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: x.isNotNull() & (x != "")))
    return glossary.select("term", "ord", F.explode(every).alias("form"))


def _grams(low: Column, n: int) -> Column:
    """The distinct character n-grams of a text."""
    return F.when(F.length(low) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - (n - 1)), lambda i: F.substring(low, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def gram_index(forms: DataFrame) -> DataFrame:
    """form, low, gram: each non-empty form with its rarest gram of GRAM characters (fewer, if it is shorter) among all forms,
    so that few forms share one."""
    low = forms.select("form", F.lower("form").alias("low")).filter("low <> ''").distinct()
    sized = F.coalesce(*[F.when(F.least(F.length("low"), F.lit(GRAM)) == n, _grams(F.col("low"), n)) for n in range(1, GRAM + 1)])
    each = low.select("form", "low", F.explode(sized).alias("gram"))
    often = each.groupBy("gram").agg(F.count("*").alias("n"))
    return each.join(often, "gram").groupBy("form", "low").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))


def contained(texts: DataFrame, forms: DataFrame, key: str, text: str = "text", loop: int | None = None) -> DataFrame:
    """key, form: which forms (form) lie in which texts (key, text), whatever their case; each pair once if keys are distinct.
    Up to `loop` forms (LOOP) each text looks for each form; more are found by their rarest gram, an equi-join, and verified."""
    own, low = texts.select(F.col(key).alias("key"), F.lower(text).alias("low_text")), forms.select("form").filter("form <> ''").distinct()
    if low.limit((LOOP if loop is None else loop) + 1).count() <= (LOOP if loop is None else loop):
        hit = own.join(F.broadcast(low.withColumn("low", F.lower("form"))), F.col("low_text").contains(F.col("low")))
        return hit.select(F.col("key").alias(key), "form")
    index = gram_index(low)
    lengths = [r[0] for r in index.select(F.length("gram")).distinct().collect()]  # GRAM at most
    grams = F.concat(*[_grams(F.col("low_text"), n) for n in lengths]) if lengths else F.array().cast("array<string>")
    hit = own.select("key", "low_text", F.explode(grams).alias("gram")).join(index, "gram").filter(F.col("low_text").contains(F.col("low")))
    return hit.select(F.col("key").alias(key), "form")


def matches(texts: DataFrame, glossary: DataFrame, key: str, loop: int | None = None) -> DataFrame:
    """key, term, ord, longest: one row a term of which a form of two or more characters lies in the text."""
    every = forms(glossary).filter(F.length("form") >= 2)
    hit = contained(texts, every, key, loop=loop).join(every, "form")
    return hit.groupBy(key, "term", "ord").agg(F.max(F.length("form")).alias("longest"))


def expanded(queries: DataFrame, glossary: DataFrame) -> DataFrame:
    """query_id, text, changed: forms of matched terms that the query does not hold yet are appended in glossary order."""
    hit = matches(queries, glossary, "query_id").select("query_id", "term", "ord")
    more = hit.join(forms(glossary).drop("ord"), "term").join(queries.select("query_id", F.lower("text").alias("low")), "query_id")
    more = more.filter(~F.col("low").contains(F.lower("form")))
    first = F.row_number().over(Window.partitionBy("query_id", "form").orderBy("ord"))
    more = more.withColumn("k", first).filter("k = 1").groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "form"))), lambda x: x["form"]), " ").alias("more"))
    return queries.join(more, "query_id", "left").select("query_id", F.when(F.col("more").isNotNull(), F.concat_ws(" ", "text", "more")).otherwise(F.col("text")).alias("text"), F.col("more").isNotNull().alias("changed"))


def hits(texts: DataFrame, glossary: DataFrame, key: str, most: int = 3) -> DataFrame:
    return matches(texts, glossary, key).groupBy(key).agg(F.least(F.count("*"), F.lit(most)).cast("int").alias("hits"))


def chunks(glossary: DataFrame) -> DataFrame:
    """The glossary as chunks of a corpus: chunk_id, doc_id, title, section, text, source_type, start. glossary: term,
    canonical, aliases, definition, owner, ord (from 1)."""
    aliases = F.coalesce("aliases", F.array().cast("array<string>"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    # fixed values: the document's name, and the labels and marks of its lines
    name = F.lit("内部术语表")
    alias = F.when(F.size(aliases) > 0, F.concat(F.lit("别名："), F.array_join(aliases, "、"), F.lit("。"))).otherwise("")
    text = F.trim(F.concat(F.lit("术语："), "term", F.lit("\n标准说法："), F.coalesce("canonical", "term"), F.lit("\n"), alias, F.lit("定义："), blank(F.col("definition")), F.lit("\n归属："), blank(F.col("owner"))))
    return glossary.select(
        F.concat(name, F.lit("#"), (F.col("ord") - 1).cast("string")).alias("chunk_id"), name.alias("doc_id"), name.alias("title"), F.coalesce("canonical", "term").alias("section"),
        text.alias("text"), F.lit("glossary").alias("source_type"), F.lit(0).alias("start"),
    )


def lookup(needles: DataFrame, glossary: DataFrame, key: str, most: int = 5) -> DataFrame:
    """key, exact, n, matches: terms of which a form equals the needle, else those of which one holds it or lies in it, the
    first `most` in glossary order and the number of all. Needles without any have no row. needles: key, needle."""
    own = forms(glossary).select("term", "ord", F.lower("form").alias("low"))
    asked = needles.select(key, F.lower(F.trim("needle")).alias("needle"))
    held = asked.join(own, F.col("low").contains(F.col("needle")) | F.col("needle").contains(F.col("low")))
    each = held.groupBy(key, "term", "ord").agg(F.bool_or(F.col("low") == F.col("needle")).alias("same"))
    sides = each.groupBy(key).agg(F.bool_or("same").alias("exact"), *[F.array_sort(F.collect_list(F.when(x, F.struct("ord", "term")))).alias(c) for c, x in (("whole", F.col("same")), ("part", ~F.col("same")))])
    chosen = F.when(F.col("exact"), F.col("whole")).otherwise(F.col("part"))  # a row holds no more than the glossary
    return sides.select(key, "exact", F.size(chosen).cast("long").alias("n"), F.slice(chosen, 1, most).alias("matches"))


def prompt_line(canonical: Column, aliases: Column, definition: Column) -> Column:
    """A term as it stands in a prompt (marks and label are fixed values)."""
    alias = F.when(F.size(F.coalesce(aliases, F.array().cast("array<string>"))) > 0, F.concat(F.lit("（别名："), F.array_join(aliases, "、"), F.lit("）"))).otherwise("")
    return F.concat(F.lit("- "), canonical, alias, F.lit("："), definition)


#: Fixed value: the heading of the terms in a prompt.
PROMPT_HEADING = "## 公司内部术语（回答时必须使用下列标准术语，不要改写成近义词或自造说法）"


def _used(queries: DataFrame, glossary: DataFrame, results: DataFrame, corpus: DataFrame) -> DataFrame:
    own = matches(queries, glossary, "query_id").select("query_id", "term", F.lit(0).alias("k"), "ord")
    first = results.filter("rank = 1").join(corpus.filter("source_type != 'glossary'").select("doc_id", "text"), "doc_id").select("query_id", "text")
    more = matches(first, glossary, "query_id").select("query_id", "term", F.lit(1).alias("k"), "ord")
    return own.unionByName(more).groupBy("query_id", "term").agg(F.min(F.struct("k", "ord")).alias("at"))


def used(queries: DataFrame, glossary: DataFrame, results: DataFrame, corpus: DataFrame) -> DataFrame:
    """query_id, used: the terms of a query, then those of its first result (none of a glossary chunk), each once."""
    each = _used(queries, glossary, results, corpus)
    return each.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "term"))), lambda x: x["term"]), ",").alias("used"))


def prompt_blocks(queries: DataFrame, glossary: DataFrame, results: DataFrame, corpus: DataFrame) -> DataFrame:
    """query_id, terms: the used terms that have a definition, under their heading."""
    line = prompt_line(F.coalesce("canonical", "term"), F.col("aliases"), F.col("definition")).alias("line")
    named = glossary.filter(F.coalesce("definition", F.lit("")) != "").select("term", line)
    lines = _used(queries, glossary, results, corpus).join(named, "term").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]).alias("lines"))
    return lines.select("query_id", F.array_join(F.concat(F.array(F.lit(PROMPT_HEADING)), "lines"), "\n").alias("terms"))
