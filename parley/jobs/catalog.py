"""All queries of the library's own operators over the given tables, with their SQL oracles.

Where the tables lack a domain, Spark derives it from them: conversations are meetings whose seconds are text lengths / 10;
documents turn into Markdown by marking lines as headings, some of them with nothing below, a third of them with CRLF; letters
a to h become ideographs, kana and hangul; the glossary is the twenty most frequent longer words of the benchmark; orders are
action items. Retrieval runs over the chunks of that Markdown and the chunks of the glossary.
"""

from __future__ import annotations

from collections.abc import Callable

from parley.functions import text as T
from parley.operators import chunking, conversation, evaluation, ledger, matching, reports, retrieval, sequence, terms
from parley.sources import manifest, readers, shared
from parley.streaming import windows as streams
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FLAGSHIP = "hybrid_search"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        if f.__name__ in _QUERIES:
            raise ValueError(f"there is a query {f.__name__} already")
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark, d):
    return shared.spread(table(spark, d, "documents"))


def asked(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def cjk(text):
    return F.translate(text, "abcdefgh", "甲乙ひらカナ한국")


def glossary(spark, d):
    words = table(spark, d, "benchmark").select(F.explode(T.words(F.col("text"))).alias("term")).filter(F.length("term") >= 6)
    best = words.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(20)  # a glossary is twenty terms
    return best.select("term", F.col("term").alias("canonical"), F.array(F.substring("term", 1, 5)).alias("aliases"), F.concat(F.lit("about "), "term").alias("definition"), F.lit("office").alias("owner"), F.row_number().over(Window.orderBy(F.desc("n"), "term")).alias("ord"))


def segments(spark, d):
    t = table(spark, d, "conversations")
    return t.select(F.col("conv_id").alias("meeting_id"), F.col("role").alias("speaker"), F.col("turn").alias("seq"), (F.length("text") / 10.0).alias("seconds"), "text")


def items(spark, d):
    """Action items: one for each order, for two targets."""
    o = table(spark, d, "orders")
    key = T.item_key(F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.col("o_orderpriority"))
    target = F.when(F.col("o_orderkey") % 3 == 0, "tickets").otherwise("tasks")
    return o.select(key.alias("item_key"), target.alias("target"), F.concat(F.lit("X-"), F.col("o_orderkey").cast("string")).alias("external_id"), F.col("o_custkey").alias("meeting_id"), F.col("o_orderkey").cast("double").alias("created_at"), "o_orderkey", "o_orderpriority", "o_orderdate")


def written(spark, d):
    """The ledger so far: every item whose order number 4 divides."""
    return items(spark, d).filter("o_orderkey % 4 = 0").select("item_key", "target", "external_id", "meeting_id", "created_at")


# --- SQL fragments of the oracles ---
_W = "list_transform(regexp_extract_all({t}, '[A-Za-z0-9]+(?:[._\\-][A-Za-z0-9]+)*'), lambda x: lower(x))"
_RUNS = "regexp_extract_all({t}, '" + T.CJK.replace("{", "{{").replace("}", "}}") + "')"
_BI = "flatten(list_transform(" + _RUNS + ", lambda r: list_transform(range(1, greatest(length(r) - 1, 1) + 1), lambda i: substr(r, i, 2))))"
_CJK = "translate({t}, 'abcdefgh', '甲乙ひらカナ한국')"
_TOKENS = f"list_concat({_W}, {_BI})"
_NORM = "trim(regexp_replace(lower({t}), '\\s+', ' ', 'g'))"
_KEY = "substr(sha256(o_orderkey::varchar || '|' || o_custkey::varchar || '|' || " + _NORM.format(t="o_orderpriority") + "), 1, 32)"
_ITEMS = f"items as (select {_KEY} as item_key, case when o_orderkey % 3 = 0 then 'tickets' else 'tasks' end as target, 'X-' || o_orderkey as external_id, o_custkey as meeting_id, o_orderkey::double as created_at, o_orderkey, o_orderpriority, o_orderdate from orders), written as (select item_key, target, external_id, meeting_id, created_at from items where o_orderkey % 4 = 0)"
_SEG = "seg as (select conv_id as meeting_id, role as speaker, turn as seq, length(text) / 10.0::double as seconds, text from conversations)"
_STATS = _SEG + """, own as (select meeting_id, speaker, sum(seconds) as total, sum(length(text))::bigint as n_chars, count(*) as turns, min(seq) as first_seq from seg group by all),
st as (select meeting_id, speaker, round(total, 1) as duration, case when sum(total) over m > 0 then round(total / sum(total) over m, 3) else 0 end as ratio, n_chars, turns, first_seq from own window m as (partition by meeting_id)),
stats as (select meeting_id, speaker, duration, ratio, n_chars, turns, row_number() over (partition by meeting_id order by duration desc, first_seq, speaker)::int as place from st)"""
_BAL = _STATS + """, bal as (select a.meeting_id, count(distinct a.speaker) as n, case when sum(a.ratio) > 0 then sum(abs(a.ratio - b.ratio)) / (2 * sum(a.ratio)) else 0 end as g from stats a join stats b using (meeting_id) group by a.meeting_id)"""
def _tf(source: str) -> str:
    return f"tf as (select doc_id, unnest({_TOKENS.format(t='text')}) as term from {source}), post as (select term, doc_id, count(*) as tf from tf group by all)"


def _len(source: str) -> str:
    return "len as (select doc_id, len(" + _TOKENS.format(t="coalesce(text, '')") + f")::bigint as len from {source})"


def _bm25_sql(name: str, source: str, text: str = "text") -> str:
    return f"""{name}_t as (select distinct query_id, unnest({_TOKENS.format(t=text)}) as term from {source}),
{name} as (select query_id, doc_id, round(sum(greatest(ln(1 + (n - df + 0.5) / (df + 0.5)), 0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))), 4) as score
 from {name}_t join post using (term) join (select term, count(*) as df from post group by term) using (term) join len using (doc_id), (select count(*) as n, avg(len) as mean from len) group by all having score > 0)"""


def _hash_sql(name: str, source: str, key: str) -> str:
    return f"""{name}_c as (select {key}, (('0x' || substr(md5(term), 1, 8))::bigint % 512) as bucket, count(*) as c from (select {key}, unnest({_TOKENS.format(t='text')}) as term from {source}) group by all),
{name} as (select {key}, bucket, c / sqrt(sum(c * c) over (partition by {key})) as weight from {name}_c)"""


def _cosine_sql(name: str, q: str) -> str:
    return f"{name} as (select query_id, doc_id, round(sum(a.weight * b.weight), 6) as score from {q} a join dv b using (bucket) group by all having score > 0)"


_Q = "q as (select item_id as query_id, text from benchmark)"
_GL = f"gl as (select term, row_number() over (order by n desc, term) as ord, [term, substr(term, 1, 5)] as forms from (select term, count(*) as n from (select unnest({_W.format(t='text')}) as term from benchmark) where length(term) >= 6 group by term order by n desc, term limit 20))"
_FORMS = _GL + ", fo as (select term, ord, unnest(list_distinct(forms)) as form from gl)"
_QM = "qm as (select query_id, term, ord, max(length(form)) as longest from q join fo on length(form) >= 2 and contains(lower(text), lower(form)) group by all)"
_EX = _QM + """, more as (select query_id, form, min(ord) as ord from qm join (select term, form from fo) using (term) join q using (query_id) where not contains(lower(text), lower(form)) group by all),
ex as (select q.query_id, case when m.more is null then text else text || ' ' || m.more end as text, m.more is not null as changed from q left join (select query_id, string_agg(form, ' ' order by ord, form) as more from more group by query_id) m using (query_id))"""
_RANK = "row_number() over (partition by query_id order by score desc, doc_id)"
_MD = "md as (select doc_id, case when doc_id % 3 = 0 then replace(text, chr(10), chr(13) || chr(10)) else text end as text from (select doc_id, string_agg(case when (i - 1) % 5 = 0 or (i - 1) % 10 = 1 then repeat('#', (1 + (i - 1) // 5 % 3)::int) || ' ' || line else line end, chr(10) order by i) as text from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents) group by doc_id))"
_SECTIONS = _MD + r""", ln as (select doc_id, unnest(string_split_regex(text, '\r\n|\n')) as line, generate_subscripts(string_split_regex(text, '\r\n|\n'), 1) as pos from md),
lv as (select *, length(regexp_extract(line, '^(#{1,6})\s+', 1)) as level, trim(regexp_extract(line, '^#{1,6}\s+(.*)$', 1)) as title from ln),
se as (select *, sum((level > 0)::int) over o as no, sum(length(line) + 1) over o as after, last_value(case when level = 1 then pos end ignore nulls) over o as p1, last_value(case when level = 2 then pos end ignore nulls) over o as p2, last_value(case when level = 3 then pos end ignore nulls) over o as p3,
 last_value(case when level = 1 then title end ignore nulls) over o as t1, last_value(case when level = 2 then title end ignore nulls) over o as t2, last_value(case when level = 3 then title end ignore nulls) over o as t3 from lv window o as (partition by doc_id order by pos)),
pa as (select *, concat_ws(' > ', t1, case when p2 > coalesce(p1, -1) then t2 end, case when p3 > greatest(coalesce(p1, -1), coalesce(p2, -1)) then t3 end) as path from se),
bo as (select doc_id, no, max(path) as path, coalesce(max(after) filter (level > 0), 0)::int as start, regexp_replace(string_agg(line, chr(10) order by pos) filter (level = 0), '^\s+|\s+$', '', 'g') as body from pa group by doc_id, no),
sec as (select doc_id, (row_number() over (partition by doc_id order by no) - 1)::int as section_no, path, start, body from bo where body <> '')"""
_HALF = r"210 + coalesce(nullif(length(regexp_extract(substr(body, {s} + 211, 210), '(?s)^.*[。！？!?；;\n]', 0)), 0), 210)"


def _windows_sql(name: str, source: str, keys: str) -> str:
    """Windows of the column body of a CTE, keyed: (keys, piece, begin, piece_text)."""
    return f"""{name}_w as (select {keys}, body, 0 as s, case when length(body) <= 420 then length(body) else {_HALF.format(s='0')} end as e from {source} where length(body) > 0
 union all select {keys}, body, s2, case when s2 + 420 >= length(body) then length(body) else s2 + {_HALF.format(s='s2')} end from (select {keys}, body, greatest(e - 80, s + 1) as s2 from {name}_w where e < length(body))),
{name} as (select {keys}, (row_number() over (partition by {keys} order by s) - 1)::int as piece, s::int as begin, piece_text from (select *, case when length(body) <= 420 then body else regexp_replace(substr(body, s + 1, e - s), '^\\s+|\\s+$', '', 'g') end as piece_text from {name}_w) where piece_text <> '')"""


_CHUNKS = _SECTIONS + ", " + _windows_sql("pc", "sec", "doc_id, section_no") + """, ck as (select doc_id || '#' || section_no || '-' || piece || '-' || substr(sha1(doc_id || '|' || path || '|' || piece || '|' || substr(piece_text, 1, 64)), 1, 12) as chunk_id, doc_id::varchar as doc_id, doc_id::varchar as title, path as section, piece_text as text, 'knowledge' as source_type, start from sec join pc using (doc_id, section_no))"""
_GLOSSARY_CHUNKS = "gc as (select '内部术语表#' || (ord - 1) as chunk_id, '内部术语表' as doc_id, '内部术语表' as title, term as section, '术语：' || term || chr(10) || '标准说法：' || term || chr(10) || '别名：' || substr(term, 1, 5) || '。定义：about ' || term || chr(10) || '归属：office' as text, 'glossary' as source_type, 0 as start from gl)"
#: The corpus of retrieval; every chunk is a document to it.
_CORPUS = f"{_Q}, {_FORMS}, {_CHUNKS}, {_GLOSSARY_CHUNKS}, co as (select chunk_id as doc_id, title, section, text, source_type from ck union all select chunk_id, title, section, text, source_type from gc), {_tf('co')}, {_len('co')}"
_CHANNELS = f"""{_CORPUS}, {_EX}, exq as (select query_id, text from ex where changed), {_bm25_sql('b1', 'q')}, {_bm25_sql('b2', 'exq')},
{_hash_sql('dv', 'co', 'doc_id')}, {_hash_sql('qv', 'q', 'query_id')}, {_hash_sql('ev', 'exq', 'query_id')}, {_cosine_sql('v1', 'qv')}, {_cosine_sql('v2', 'ev')},
ch as (select 'bm25' as channel, 1.0::double as w, *, {_RANK} as rank from b1 union all select 'vector', 1.0, *, {_RANK} from v1 union all select 'bm25+', 0.6, *, {_RANK} from b2 union all select 'vector+', 0.4, *, {_RANK} from v2),
pool as (select * from ch where rank <= 20)"""


def _rerank_sql(name: str, fused: str, terms: bool) -> str:
    """The reranked five best of each query from a CTE of fused scores."""
    hits = "coalesce(hits, 0)::int" if terms else "0"
    return f"""{name}_r as (select f.query_id, f.doc_id, fused, case when len(toks) > 0 then round(len(list_intersect(toks, {_TOKENS.format(t='d.text')})) / len(toks), 4) else 0 end as coverage,
 (len(list_filter(list_concat(list_transform(range(1, length(bare) - 2), lambda i: substr(bare, i, 4)), list_transform(range(1, length(bare) - 4), lambda i: substr(bare, i, 6))), lambda p: contains(lower(d.text), p))) > 0)::int as phrase,
 list_has_any(toks, {_TOKENS.format(t="lower(d.title || ' ' || d.section)")})::int as section_hit, {hits} as term_hits, case when source_type = 'glossary' and {'not named' if terms else 'true'} then 0.6 else 1 end as penalty
 from {fused} f join qt using (query_id) join co d using (doc_id) left join hits using (doc_id)),
{name}_s as (select *, round(fused * (1 + 0.8 * coverage + 0.5 * phrase + 0.25 * section_hit + 0.15 * term_hits) * penalty, 6) as score from {name}_r),
{name} as (select query_id, {_RANK}::int as rank, doc_id, score, coverage, phrase, section_hit, term_hits from {name}_s qualify rank <= 5)"""


_HYBRID = _CHANNELS + f""", hits as (select doc_id, least(count(*), 3)::int as hits from (select distinct doc_id, term from co join fo on length(form) >= 2 and contains(lower(text), lower(form)) where source_type <> 'glossary') group by doc_id),
qt as (select query_id, list_distinct({_TOKENS.format(t='text')}) as toks, regexp_replace(lower(text), '\\s+', '', 'g') as bare, query_id in (select query_id from qm) as named from q),
fu as (select query_id, doc_id, sum(w / (60 + rank)) as fused from pool group by all), {_rerank_sql('hy', 'fu', True)}"""
_ABLATION = _HYBRID + f", f0 as (select query_id, doc_id, sum(w / (60 + rank)) as fused from pool where channel in ('bm25', 'vector') group by all), {_rerank_sql('h0', 'f0', False)}"
#: A query's passage is expected in the documents whose text holds it.
_EXPECTED = "ok as (select query_id, doc_id::varchar as source from q join documents d on contains(d.text, q.text))"


# --- scalar functions ---
@query(f"select doc_id, term, count(*) as tf from (select doc_id, unnest({_W.format(t='text')}) as term from documents) group by all")
def tok_words(spark, d):
    return docs(spark, d).select("doc_id", F.explode(T.words(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


@query(f"select doc_id, len({_BI.format(t=_CJK.format(t='text'))})::int as n, md5(array_to_string({_BI.format(t=_CJK.format(t='text'))}, ' ')) as digest from documents")
def tok_cjk_bigrams(spark, d):
    grams = T.bigrams(T.cjk_runs(cjk(F.col("text"))))
    return docs(spark, d).select("doc_id", F.size(grams).alias("n"), F.md5(F.array_join(grams, " ")).alias("digest"))


@query(f"select doc_id, md5(array_to_string(list_concat({_W.format(t=_CJK.format(t='text'))}, {_BI.format(t=_CJK.format(t='text'))}), ' ')) as digest from documents")
def tok_all(spark, d):
    return docs(spark, d).select("doc_id", F.md5(F.array_join(T.tokens(cjk(F.col("text"))), " ")).alias("digest"))


@query(f"select item_id, list_concat({_W.format(t=_CJK.format(t='text'))}, {_BI.format(t=_CJK.format(t='text'))}, flatten(list_transform(list_filter({_RUNS.format(t=_CJK.format(t='text'))}, lambda r: length(r) > 2), lambda r: list_transform(range(1, length(r) + 1), lambda i: substr(r, i, 1))))) as toks from benchmark")
def tok_query(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.query_tokens(cjk(F.col("text"))).alias("toks"))


@query(f"select doc_id, len(regexp_extract_all({_CJK.format(t='text')}, '{T.CJK_CHAR}'))::int as n from documents")
def is_cjk(spark, d):
    """How many characters of each text are CJK."""
    return docs(spark, d).select("doc_id", F.regexp_count(cjk(F.col("text")), F.lit(T.CJK_CHAR)).alias("n"))


_SCRIPTS = ("语义检索 v1.2", "ひらがな カタカナ", "한국어 검색", "検索エンジンを작동", "メモA1図b", "a", "。、", "")
_SCRIPT_ROWS = "(values " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(_SCRIPTS)) + ") as s(sample_id, text)"


@query(f"select doc_id, sample_id, {_TOKENS.format(t='s.text || lang')} as toks, list_concat({_TOKENS.format(t='s.text || lang')}, flatten(list_transform(list_filter({_RUNS.format(t='s.text || lang')}, lambda r: length(r) > 2), lambda r: list_transform(range(1, length(r) + 1), lambda i: substr(r, i, 1))))) as query_toks from documents, {_SCRIPT_ROWS}")
def tok_scripts(spark, d):
    """Samples of Han, kana, hangul and mixed scripts, each before the language of every document."""
    samples = F.array(*[F.struct(F.lit(i).alias("sample_id"), F.lit(t).alias("text")) for i, t in enumerate(_SCRIPTS)])
    rows = docs(spark, d).select("doc_id", "lang", F.explode(samples).alias("s"))
    text = F.concat("s.text", "lang")
    return rows.select("doc_id", "s.sample_id", T.tokens(text).alias("toks"), T.query_tokens(text).alias("query_toks"))


@query(f"select o_orderkey, {_KEY} as item_key from orders")
def item_key(spark, d):
    return items(spark, d).select("o_orderkey", "item_key")


@query(f"select c_custkey, {_NORM.format(t=chr(39) + ' ' + chr(39) + ' || c_name || ' + chr(39) + '  x ' + chr(39))} as name from customer")
def name_normalize(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.normalized(F.concat(F.lit(" "), "c_name", F.lit("  x "))).alias("name"))


@query("select page_id, substr(regexp_replace(trim(url), '[^A-Za-z0-9_.\\-]', '_', 'g'), 1, 64) as safe_id from pages")
def safe_id(spark, d):
    return table(spark, d, "pages").select("page_id", T.safe_id(F.col("url")).alias("safe_id"))


@query("select o_orderkey, case lower(substr(o_orderpriority, 3)) when 'low' then 'Low' when 'high' then 'High' when 'urgent' then 'Highest' else 'Medium' end as priority from orders")
def map_priority(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.priority(F.substring("o_orderpriority", 3, 20)).alias("priority"))


@query("select o_orderkey, case when o_orderkey % 5 = 0 then '' else strftime(o_orderdate, '%Y-%m-%d') end as deadline from orders")
def norm_deadline(spark, d):
    raw = F.when(F.col("o_orderkey") % 5 == 0, "soon").when(F.col("o_orderkey") % 5 == 1, F.date_format("o_orderdate", "yyyy-M-d")).otherwise(F.concat(F.lit(" "), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm")))
    return table(spark, d, "orders").select("o_orderkey", T.deadline(raw).alias("deadline"))


@query("select o_orderkey, epoch(o_orderdate::date::timestamp)::bigint as due from orders")
def deadline_epoch(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, d, "orders").select("o_orderkey", F.unix_timestamp(T.deadline(day), "yyyy-MM-dd").alias("due"))


@query("select event_id, substr(sha256('{\"event_type\": \"' || event_type || '\", \"k\": ' || json_extract_string(props, '$.k') || '}'), 1, 32) as digest from events")
def args_digest(spark, d):
    args = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("event_type"), F.concat(F.lit('"'), F.col("event_type"), F.lit('"')))
    pairs = F.transform(F.array_sort(F.map_entries(args)), lambda e: F.concat(F.lit('"'), e["key"], F.lit('": '), e["value"]))
    return table(spark, d, "events").select("event_id", F.substring(F.sha2(F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")), 256), 1, 32).alias("digest"))


@query("select event_id, case when event_id % 3 = 2 then null else json_extract_string(props, '$.k')::int end as k from events")
def json_salvage(spark, d):
    kind = F.col("event_id") % 3
    raw = F.when(kind == 0, F.col("props")).when(kind == 1, F.concat(F.lit("Sure: "), "props", F.lit(" - done"))).otherwise(F.concat(F.lit("{"), "props"))
    return table(spark, d, "events").select("event_id", F.get_json_object(T.salvaged_json(raw), "$.k").cast("int").alias("k"))


@query("select conv_id, turn, list_distinct(c) is not null as ok, len(list_distinct(c))::int as n, list_aggregate(c, 'min')::int as least from (select conv_id, turn, list_filter([turn, turn + 1, turn, 9], lambda x: x between 1 and 5) as c from conversations)")
def parse_citations(spark, d):
    t = F.col("turn").cast("string")
    answer = F.concat(F.lit("see ["), t, F.lit("] and ["), (F.col("turn") + 1).cast("string"), F.lit("], again ["), t, F.lit("][9]"))
    own = T.citations(answer, F.lit(5))
    return table(spark, d, "conversations").select("conv_id", "turn", own.isNotNull().alias("ok"), F.size(own).alias("n"), F.array_min(own).alias("least"))


@query("select item_id, len(list_distinct(list_concat(list_transform(range(1, length(b) - 2), lambda i: substr(b, i, 4)), list_transform(range(1, length(b) - 4), lambda i: substr(b, i, 6)))))::int as n from (select item_id, regexp_replace(text, '\\s+', '', 'g') as b from benchmark)")
def query_phrases(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.size(T.phrases(F.col("text"))).alias("n"))


@query("select doc_id, case when doc_id % 2 = 0 then doc_id::varchar else doc_id::varchar || ' / ' || source end as citation from documents")
def citation(spark, d):
    return docs(spark, d).select("doc_id", T.citation(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("source"))).alias("citation"))


@query("select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 4) as norm, round(embedding[1]::double * 3 / (3 * sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)))), 6) as first from embeddings")
def l2_normalize(spark, d):
    v = F.transform("embedding", lambda x: x.cast("double") * 3)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return table(spark, d, "embeddings").select("vec_id", F.round(norm / 3, 4).alias("norm"), F.round(v[0] / F.when(norm > 0, norm).otherwise(1.0), 6).alias("first"))


@query(f"with {_hash_sql('dv', 'documents', 'doc_id')} select doc_id, bucket, round(weight, 6) as weight from dv")
def hash_embed(spark, d):
    return retrieval.hashed(docs(spark, d), "doc_id").select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


# --- chunking ---
def markdown(spark, d):
    lines = F.split("text", "\n")
    marked = F.transform(lines, lambda x, i: F.when((i % 5 == 0) | (i % 10 == 1), F.concat(F.repeat(F.lit("#"), (1 + F.floor(i / 5) % 3).cast("int")), F.lit(" "), x)).otherwise(x))
    end = F.when(F.col("doc_id") % 3 == 0, "\r\n").otherwise("\n")
    return docs(spark, d).select("doc_id", F.concat_ws("", F.transform(marked, lambda x, i: F.when(i > 0, F.concat(end, x)).otherwise(x))).alias("text"))


def chunks(spark, d):
    return chunking.chunks(markdown(spark, d))


_CORPORA: dict[tuple[str, str], tuple[str, DataFrame]] = {}


def chunked(spark, d):
    """The chunks of all documents and of the glossary; every chunk is a document to retrieval."""
    both = chunks(spark, d).unionByName(terms.chunks(glossary(spark, d)))
    return both.select(F.col("chunk_id").alias("doc_id"), "title", "section", "text", "source_type")


def corpus(spark, d):
    """The chunks with their tokens, cut and analysed once and kept as a table, which each channel and later queries of the
    session read while the files that it comes from stay as they are."""
    key, now = (spark.sparkContext.applicationId, d), manifest.signature(spark, f"{d}/documents.parquet", f"{d}/benchmark.parquet")
    if _CORPORA.get(key, ("", None))[0] != now:
        _CORPORA[key] = now, shared.written(retrieval.analysed(chunked(spark, d)), "corpus")
    return _CORPORA[key][1]


@query(f"with {_SECTIONS} select * from sec")
def chunk_headings(spark, d):
    return chunking.sections(markdown(spark, d))


@query(f"with recursive src as (select doc_id, text as body from documents), {_windows_sql('wi', 'src', 'doc_id')} select doc_id, piece, begin as start, piece_text from wi")
def chunk_windows(spark, d):
    return chunking.windows(docs(spark, d))


@query(f"with recursive {_CHUNKS} select * from ck")
def chunk_markdown(spark, d):
    return chunks(spark, d)


@query(f"with recursive {_CHUNKS} select doc_id, count(*) as n, count(distinct chunk_id) as ids, min(chunk_id) as first from ck group by doc_id")
def chunk_id(spark, d):
    """Chunks and distinct identities of each document."""
    return chunks(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("ids"), F.min("chunk_id").alias("first"))


@query("select doc_id, pos::int as pos, (sum(length(line) + 1) over (partition by doc_id order by pos) - length(line) - 1)::bigint as start from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents)")
def running_offset(spark, d):
    lines = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    size = F.length("line") + 1
    return lines.select("doc_id", "pos", (F.sum(size).over(Window.partitionBy("doc_id").orderBy("pos")) - size).alias("start"))


# --- terminology ---
@query(f"with {_FORMS} select term, form from fo")
def term_surface_forms(spark, d):
    return terms.forms(glossary(spark, d)).select("term", "form")


@query(f"with {_FORMS} select doc_id, term, max(length(form))::int as longest from documents join fo on length(form) >= 2 and contains(lower(text), lower(form)) group by all")
def term_match(spark, d):
    return terms.matches(docs(spark, d), glossary(spark, d), "doc_id").select("doc_id", "term", "longest")


@query(f"with {_Q}, {_FORMS}, {_EX} select * from ex")
def term_expand(spark, d):
    return terms.expanded(asked(spark, d), glossary(spark, d))


@query(f"with {_FORMS} select doc_id, least(count(distinct term), 3)::int as hits from documents join fo on length(form) >= 2 and contains(lower(text), lower(form)) group by doc_id")
def term_boost(spark, d):
    return terms.hits(docs(spark, d), glossary(spark, d), "doc_id")


@query(f"with {_GL} select '{terms.PROMPT_HEADING}' || chr(10) || string_agg('- ' || term || '（别名：' || substr(term, 1, 5) || '）：about ' || term, chr(10) order by ord) as block from gl")
def term_prompt_block(spark, d):
    line = terms.prompt_line(F.col("canonical"), F.col("aliases"), F.col("definition"))
    return glossary(spark, d).agg(F.concat(F.lit(terms.PROMPT_HEADING + "\n"), reports.joined("ord", line)).alias("block"))


@query(f"with recursive {_GL}, {_GLOSSARY_CHUNKS} select * from gc")
def term_to_chunks(spark, d):
    return terms.chunks(glossary(spark, d))


@query(f"with recursive {_CORPUS} select doc_id, title, section, text, source_type from co")
def scan_corpus_union(spark, d):
    return corpus(spark, d).drop("tokens")


@query(f"with {_GL}, nd as (select o_orderkey, split_part(replace(o_clerk, '#', ' '), ' ', 1) as needle from (select o_orderkey, case when o_orderkey % 3 = 0 then (select term from gl where ord = 1 + o_orderkey % 20) when o_orderkey % 3 = 1 then (select substr(term, 1, 3) from gl where ord = 1 + o_orderkey % 20) else 'x' || o_orderkey end as o_clerk from orders)), ma as (select o_orderkey, term, ord, list_contains(forms, needle) as same from nd join gl on len(list_filter(forms, lambda f: contains(f, needle) or contains(needle, f))) > 0), be as (select *, bool_or(same) over (partition by o_orderkey) as exact from ma) select o_orderkey, exact, string_agg(term, ',' order by ord) filter (k <= 5) as terms, max(n)::bigint as n from (select *, row_number() over (partition by o_orderkey order by ord) as k, count(*) over (partition by o_orderkey) as n from be where same = exact) group by o_orderkey, exact")
def glossary_lookup(spark, d):
    """For each order a needle: a term, the beginning of one, or a word that no term holds."""
    g = glossary(spark, d)
    o = table(spark, d, "orders").select("o_orderkey", (1 + F.col("o_orderkey") % 20).cast("int").alias("pick"))
    picked = o.join(F.broadcast(g.select(F.col("ord").alias("pick"), "term")), "pick")  # a glossary is twenty terms
    kind = F.col("o_orderkey") % 3
    needle = F.when(kind == 0, F.col("term")).when(kind == 1, F.substring("term", 1, 3)).otherwise(F.concat(F.lit("x"), F.col("o_orderkey").cast("string")))
    found = terms.lookup(picked.select("o_orderkey", needle.alias("needle")), g, "o_orderkey")
    return found.select("o_orderkey", "exact", F.array_join(F.transform("matches", lambda m: m["term"]), ",").alias("terms"), "n")


# --- retrieval ---
@query(f"with {_tf('documents')} select term, count(*) as df, sum(tf)::bigint as tf from post group by term")
def agg_df(spark, d):
    return retrieval.postings(docs(spark, d)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query(f"with {_len('documents')} select count(*) as n, round(avg(len), 6) as avg_len from len")
def agg_avglen(spark, d):
    return retrieval.lengths(docs(spark, d)).agg(F.count("*").alias("n"), F.round(F.avg("len"), 6).alias("avg_len"))


@query(f"with {_tf('documents')} select term, round(greatest(ln(1 + (n - df + 0.5) / (df + 0.5)), 0), 6) as idf from (select term, count(*) as df from post group by term), (select count(*) as n from documents)")
def bm25_idf(spark, d):
    df = retrieval.postings(docs(spark, d)).groupBy("term").agg(F.count("*").alias("df"))
    n = docs(spark, d).agg(F.count("*").alias("n"))
    return df.crossJoin(F.broadcast(n)).select("term", F.round(retrieval.idf(F.col("n"), F.col("df")), 6).alias("idf"))  # one row of totals


@query(f"with {_Q}, {_tf('documents')}, {_len('documents')}, {_bm25_sql('b1', 'q')} select query_id, rank, doc_id, score from (select *, {_RANK}::int as rank from b1) where rank <= 10")
def topk_bm25(spark, d):
    return retrieval.ranked(retrieval.bm25_best(asked(spark, d), docs(spark, d), 10), 10).select("query_id", "rank", "doc_id", "score")


@query(f"with q as (select item_id as query_id, {_CJK.format(t='text')} as text from benchmark), mixed as (select doc_id, {_CJK.format(t='text')} as text from documents), {_tf('mixed')}, {_len('mixed')}, {_bm25_sql('b1', 'q')} select query_id, rank, doc_id, score from (select *, {_RANK}::int as rank from b1) where rank <= 10")
def bm25_scripts(spark, d):
    """BM25 where words are mixed with CJK runs: queries are cut as documents are, without single characters."""
    q = asked(spark, d).withColumn("text", cjk(F.col("text")))
    return retrieval.ranked(retrieval.bm25_best(q, docs(spark, d).withColumn("text", cjk(F.col("text"))), 10), 10).select("query_id", "rank", "doc_id", "score")


@query(f"with {_Q}, {_hash_sql('dv', 'documents', 'doc_id')}, {_hash_sql('qv', 'q', 'query_id')}, {_cosine_sql('v1', 'qv')} select query_id, rank, doc_id, score from (select *, {_RANK}::int as rank from v1) where rank <= 10")
def topk_vector(spark, d):
    return retrieval.ranked(retrieval.cosine(asked(spark, d), docs(spark, d), 10), 10).select("query_id", "rank", "doc_id", "score")


def _arms(spark, d):
    """The four channels over the corpus of chunks, 20 results each."""
    q, g = asked(spark, d), glossary(spark, d)
    return retrieval.channels(q, terms.expanded(q, g).filter("changed").select("query_id", "text"), corpus(spark, d), 20)


@query(f"with recursive {_CHANNELS} select query_id, doc_id, round(sum(w / (60 + rank)), 9) as fused from pool group by all")
def rrf_fuse(spark, d):
    return retrieval.fused(_arms(spark, d)).select("query_id", "doc_id", F.round("fused", 9).alias("fused"))


@query(f"with recursive {_HYBRID} select * from hy")
def hybrid_search(spark, d):
    return _searched(spark, d)[0]


def _searched(spark, d):
    """The results of all queries, and the corpus that they come from."""
    c = corpus(spark, d)
    return retrieval.hybrid(asked(spark, d), c, glossary(spark, d)), c


def expected(spark, d):
    """(query_id, source): documents that hold a query's passage. Both sides meet on the passage's rarest word, then texts
    are compared."""
    q = asked(spark, d).select("query_id", F.col("text").alias("passage"), F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("word")).filter("word != ''")
    c = docs(spark, d).select("doc_id", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("word"))
    held = c.join(q.select("word").distinct(), "word", "left_semi")
    df = held.groupBy("word").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("df", "word"))
    inner = q.filter(~F.col("passage").startswith(F.col("word")) & ~F.col("passage").endswith(F.col("word")))  # the outer words may go on in a document
    rare = inner.join(df, "word").withColumn("k", rank).filter("k = 1").select("query_id", "passage", "word")
    pairs = rare.join(held, "word").join(docs(spark, d).select("doc_id", "text"), "doc_id").filter(F.col("text").contains(F.col("passage")))
    return pairs.select("query_id", F.col("doc_id").cast("string").alias("source"))


def first_hits(spark, d, found):
    """query_id, category (of three), first_rank, hit1, hit5, reciprocal of results whose chunks belong to expected documents."""
    sources = found.withColumn("source", F.split("doc_id", "#")[0])
    q = asked(spark, d).select("query_id", (F.col("query_id") % 3).alias("category"))
    return evaluation.first_hits(sources.select("query_id", F.col("source").alias("doc_id"), "rank"), expected(spark, d).withColumnRenamed("source", "doc_id"), q)


def _hits_sql(name: str, found: str) -> str:
    return f"""{name}_f as (select query_id, min(rank) as first_rank from {found} join ok using (query_id) where split_part(doc_id, '#', 1) = source group by query_id),
{name} as (select query_id, query_id % 3 as category, first_rank, coalesce((first_rank <= 1)::int, 0) as hit1, coalesce((first_rank <= 5)::int, 0) as hit5, coalesce(1.0::double / first_rank, 0) as reciprocal from q left join {name}_f using (query_id))"""


@query(f"with recursive {_HYBRID}, {_EXPECTED}, {_hits_sql('hh', 'hy')} select count(*) as n, round(avg(hit1), 3) as recall1, round(avg(hit5), 3) as recall5, round(avg(reciprocal), 3) as mrr from hh")
def eval_recall_mrr(spark, d):
    return evaluation.recall_mrr(first_hits(spark, d, hybrid_search(spark, d)))


@query(f"with recursive {_HYBRID}, {_EXPECTED}, {_hits_sql('hh', 'hy')} select category, count(*) as n, round(avg(hit1), 3) as recall1, round(avg(hit5), 3) as recall5, round(avg(reciprocal), 3) as mrr from hh group by category")
def eval_by_category(spark, d):
    return evaluation.recall_mrr(first_hits(spark, d, hybrid_search(spark, d)), "category")


@query(f"with recursive {_ABLATION}, {_EXPECTED}, {_hits_sql('hh', 'hy')}, {_hits_sql('hz', 'h0')} select category, round(avg(a.hit1) - avg(b.hit1), 3) as recall1_delta, round(avg(a.reciprocal) - avg(b.reciprocal), 3) as mrr_delta from hh a join hz b using (query_id, category) group by rollup(category)")
def eval_ablation_delta(spark, d):
    """What the terminology layer adds: two runs of retrieval, with and without it."""
    q, c, g = asked(spark, d), corpus(spark, d), glossary(spark, d)
    arms = [first_hits(spark, d, retrieval.hybrid(q, c, g, terminology=on)).withColumn("arm", F.lit(name)) for name, on in (("on", True), ("off", False))]
    return evaluation.ablation(arms[0].unionByName(arms[1]))


@query(f"with recursive {_HYBRID}, cited as (select query_id, doc_id, rank from hy) select query_id, count(*) as cited, round(avg((co.doc_id is not null)::int), 6) as verifiable from cited left join co using (doc_id) group by query_id")
def eval_citation_verifiable(spark, d):
    """The share of each query's citations that name a chunk of the corpus."""
    return evaluation.verifiable(*_searched(spark, d))


@query(f"with recursive {_HYBRID}, tq as (select query_id, term from qm), hit as (select distinct tq.query_id, tq.term from tq join hy using (query_id) join co using (doc_id) where contains(lower(co.text), lower(tq.term))) select query_id, count(tq.term) as expected, count(hit.term) as found, round(count(hit.term) / count(tq.term), 6) as share from tq left join hit using (query_id, term) group by query_id")
def eval_term_hit(spark, d):
    """The share of a query's terms that its results hold."""
    q, g = asked(spark, d), glossary(spark, d)
    return evaluation.term_hits(terms.matches(q, g, "query_id").select("query_id", "term"), *_searched(spark, d))


_USED = "top as (select query_id, doc_id from hy where rank = 1), us as (select query_id, term, 0 as k, ord from qm union all select top.query_id, fo2.term, 1, fo2.ord from top join co using (doc_id) join (select distinct term, ord, form from fo) fo2 on length(form) >= 2 and contains(lower(co.text), lower(form)) where source_type <> 'glossary'), ut as (select query_id, term, min(k) as k, min(ord) as ord from us group by all)"
_BLOCKS = "bl as (select query_id, string_agg('[' || rank || '] ' || title || case when section <> '' then ' / ' || section else '' end || chr(10) || text, chr(10) || chr(10) order by rank) as block from hy join co using (doc_id) group by query_id)"


@query(f"with recursive {_HYBRID}, {_USED} select query_id, string_agg(term, ',' order by k, ord) as used from ut group by query_id")
def qa_used_terms(spark, d):
    """The terms that constrain an answer: those of the query, then those of the best chunk."""
    q, g = asked(spark, d), glossary(spark, d)
    return terms.used(q, g, *_searched(spark, d))


@query(f"with recursive {_HYBRID}, {_USED}, {_BLOCKS}, tb as (select query_id, string_agg('- ' || term || '（别名：' || substr(term, 1, 5) || '）：about ' || term, chr(10) order by k, ord) as terms from ut group by query_id) select query_id, concat_ws(chr(10) || chr(10), '{retrieval.SOURCES}' || chr(10) || block, '{terms.PROMPT_HEADING}' || chr(10) || terms, '{retrieval.QUESTION}' || chr(10) || text, '{retrieval.RULES}') as prompt from q join bl using (query_id) left join tb using (query_id)")
def qa_prompt(spark, d):
    """What an answering model is given for each query."""
    return retrieval.prompts(asked(spark, d), glossary(spark, d), *_searched(spark, d))


# --- conversations ---
@query(f"with {_STATS} select meeting_id, speaker, duration, ratio, n_chars, turns, place from stats")
def speaker_stats(spark, d):
    return conversation.speaker_stats(segments(spark, d))


@query(f"with {_BAL} select meeting_id, n, round(g, 6) as gini, case when n = 1 then 5.0 else round((1 - g) * 10, 6) end::double as balance from bal")
def gini_balance(spark, d):
    return conversation.balance(conversation.speaker_stats(segments(spark, d)))


@query(f"with {_BAL}, du as (select meeting_id, sum(seconds) as seconds from seg group by 1), us as (select meeting_id, sum(duration) as used from stats group by 1), f as (select meeting_id, least(used / seconds, 1) * 10 as u, case when n = 1 then 5.0 else round((1 - g) * 10, 6) end as b from du join us using (meeting_id) join bal using (meeting_id)) select meeting_id, round(u, 6) as utilization, round(0.4::double * 5 + 0.3::double * b + 0.3::double * round(u, 6), 1) as efficiency from f")
def efficiency_score(spark, d):
    s = segments(spark, d)
    return conversation.efficiency(conversation.speaker_stats(s), s.groupBy("meeting_id").agg(F.sum("seconds").alias("seconds")))


_TIMED = _SEG + ", ti as (select *, round(sum(seconds) over o, 1) as till, round(sum(seconds) over o - seconds, 1) as since from seg window o as (partition by meeting_id order by seq))"


@query(f"with {_TIMED} select meeting_id, string_agg(printf('[%.1fs-%.1fs] %s: %s', since, till, speaker, text), chr(10) order by seq) as transcript from ti group by meeting_id")
def transcript_format(spark, d):
    return reports.transcripts(reports.timed(segments(spark, d)))


@query("select distinct conv_id as meeting_id, role as speaker from conversations")
def transcript_speakers(spark, d):
    """Speakers read back from the lines of transcripts; line ends within a turn are taken out first."""
    own = segments(spark, d).withColumn("text", F.translate("text", "\n", " "))
    return reports.speakers(reports.transcripts(reports.timed(own)))


@query(f"with {_STATS} select meeting_id, '**发言统计**:' || chr(10) || string_agg(printf('- %s: %.1f%% %s (%.1fs, %d次)', speaker, ratio * 100, repeat('█', floor(ratio * 20)::int), duration, turns), chr(10) order by place) as md from stats group by meeting_id")
def insights_md(spark, d):
    return reports.statistics(conversation.speaker_stats(segments(spark, d)))


@query("select c_custkey as meeting_id, coalesce(string_agg(i || '. **P' || c_custkey % 7 || '**: order ' || o_orderkey || case when o_orderkey % 5 = 0 then '' else ' | 截止: ' || strftime(o_orderdate, '%Y-%m-%d') end || ' [' || case lower(substr(o_orderpriority, 3)) when 'low' then 'Low' when 'high' then 'High' when 'urgent' then 'Highest' else 'Medium' end || ']' || case when o_orderkey % 4 <> 0 then '' when o_orderkey % 3 = 0 then ' (Jira: X-' || o_orderkey || ')' else ' (飞书: X-' || o_orderkey || ')' end, chr(10) order by i), '*（无待办事项）*') as md from customer left join (select *, row_number() over (partition by o_custkey order by o_orderkey) as i from orders) on o_custkey = c_custkey group by c_custkey")
def actions_md(spark, d):
    """Each customer's orders as action items, with the tickets and tasks that the ledger holds."""
    o = items(spark, d)
    known = ledger.reused(o.drop("external_id"), written(spark, d))
    due = F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    own = known.select(
        "meeting_id", F.col("o_orderkey").alias("seq"), F.concat(F.lit("P"), (F.col("meeting_id") % 7).cast("string")).alias("assignee"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("task"), T.deadline(due).alias("deadline"),
        T.priority(F.substring("o_orderpriority", 3, 20)).alias("priority"), F.when(F.col("target") == "tickets", F.col("external_id")).alias("ticket"), F.when(F.col("target") == "tasks", F.col("external_id")).alias("task_id"),
    )
    return reports.action_items(table(spark, d, "customer").select(F.col("c_custkey").alias("meeting_id")), own)


# --- ledger ---
_UP = _ITEMS + ", alls as (select * from written union all select item_key, target, 'Y-' || o_orderkey, meeting_id + 1, created_at + 1 from items where o_orderkey % 6 = 0), up as (select item_key, target, arg_max(external_id, created_at) as external_id, arg_min(meeting_id, created_at) as meeting_id, max(created_at) as created_at from alls group by all)"


def updated(spark, d):
    batch = items(spark, d).filter("o_orderkey % 6 = 0").select("item_key", "target", F.concat(F.lit("Y-"), F.col("o_orderkey").cast("string")).alias("external_id"), (F.col("meeting_id") + 1).alias("meeting_id"), (F.col("created_at") + 1).alias("created_at"))
    return ledger.upserted(written(spark, d), batch)


@query(f"with {_UP} select * from up")
def ledger_upsert(spark, d):
    return updated(spark, d)


@query(f"with {_UP} select target, count(*) as n from up group by rollup(target)")
def agg_ledger_stats(spark, d):
    return ledger.stats(updated(spark, d))


@query(f"with {_ITEMS} select i.o_orderkey, i.item_key, i.target from items i where not exists (select 1 from written w where w.item_key = i.item_key and w.target = i.target)")
def join_ledger_anti(spark, d):
    return ledger.to_create(items(spark, d).select("item_key", "target", "o_orderkey"), written(spark, d)).select("o_orderkey", "item_key", "target")


@query(f"with {_ITEMS} select i.o_orderkey, w.external_id from items i left join written w using (item_key, target)")
def ledger_get(spark, d):
    return ledger.reused(items(spark, d).select("item_key", "target", "o_orderkey"), written(spark, d)).select("o_orderkey", "external_id")


@query(f"with {_ITEMS} select i.target, count(*) filter (w.item_key is null and o_orderpriority <> '1-URGENT') as created, count(*) filter (w.item_key is not null) as skipped, count(*) filter (w.item_key is null and o_orderpriority = '1-URGENT') as failed from items i left join written w on w.item_key = i.item_key and w.target = i.target group by i.target")
def agg_sync_counters(spark, d):
    all_items = ledger.reused(items(spark, d).select("item_key", "target", "o_orderpriority"), written(spark, d))
    fresh, bad = F.col("external_id").isNull(), F.col("o_orderpriority") == "1-URGENT"
    return all_items.groupBy("target").agg(F.count_if(fresh & ~bad).alias("created"), F.count_if(~fresh).alias("skipped"), F.count_if(fresh & bad).alias("failed"))


@query("select o_orderkey, c_name as account from orders left join customer on c_custkey = o_custkey and o_orderkey % 2 = 0")
def resolve_user(spark, d):
    """The account behind each order's name; every second order names nobody that is known."""
    name = F.when(F.col("o_orderkey") % 2 == 0, T.normalized(F.concat(F.lit(" Customer  "), F.col("o_custkey").cast("string")))).otherwise("nobody")
    people = table(spark, d, "customer").select(T.normalized(F.concat(F.lit("customer "), F.col("c_custkey").cast("string"))).alias("name"), F.col("c_name").alias("account"))
    return table(spark, d, "orders").select("o_orderkey", name.alias("name")).join(people, "name", "left").select("o_orderkey", "account")


@query("select event_type, count(*) filter (n > 1) as repeats from (select user_id, event_type, props, event_type as e, count(*) over (partition by user_id, event_type, props) as n from events) group by event_type")
def dedup_calls(spark, d):
    n = F.count("*").over(Window.partitionBy("user_id", "event_type", "props"))
    return table(spark, d, "events").select("event_type", n.alias("n")).groupBy("event_type").agg(F.count_if(F.col("n") > 1).alias("repeats"))


# --- scans, reports, statistics ---
@query("select source, lang, count(*) as chunks, count(distinct doc_id) as docs from documents group by grouping sets ((source, lang), (source), ())")
def agg_index_stats(spark, d):
    return docs(spark, d).rollup("source", "lang").agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("docs"))


@query("select page_id, length(html) as characters, length(html) > 6000 as truncated, substr(html, 1, 6000) as text from pages")
def scan_report_one(spark, d):
    return table(spark, d, "pages").select("page_id", F.length("html").cast("long").alias("characters"), (F.length("html") > 6000).alias("truncated"), F.substring("html", 1, 6000).alias("text"))


@query("select regexp_extract(url, '([^/]+)/?$', 1) as report, count(*) as n from pages group by 1")
def scan_reports(spark, d):
    return table(spark, d, "pages").groupBy(F.regexp_extract("url", "([^/]+)/?$", 1).alias("report")).agg(F.count("*").alias("n"))


@query("select event_id, event_type from (select * from events order by ts desc, event_id desc limit 50)")
def scan_audit_tail(spark, d):
    return readers.audit_tail(table(spark, d, "events"), 50).select("event_id", "event_type")


@query("select vec_id, label, len(embedding)::int as dims from embeddings")
def scan_vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.size("embedding").alias("dims"))


@query("select o_custkey, count(*) filter (o_orderkey % 5 <> 0) as reminders, string_agg('X-' || o_orderkey, ',' order by o_orderkey) as ids from orders group by o_custkey")
def agg_followup(spark, d):
    o = table(spark, d, "orders")
    ids = F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: F.concat(F.lit("X-"), k.cast("string")))
    return o.groupBy("o_custkey").agg(F.count_if(F.col("o_orderkey") % 5 != 0).alias("reminders"), F.array_join(ids, ",").alias("ids"))


# --- evaluation ---
@query("with c as (select lang, count(*) filter (d.n_chars > 1500 and quality = 1) as m, count(*) filter (d.n_chars > 1500) as p, count(*) filter (quality = 1) as g from documents d join labels l using (doc_id) group by lang) select lang, round(m / p, 6) as precision, round(m / g, 6) as recall, round(2 * (m / p) * (m / g) / (m / p + m / g), 6) as f1 from c")
def eval_prf1(spark, d):
    both = docs(spark, d).join(table(spark, d, "labels"), "doc_id").withColumn("p", F.col("n_chars") > 1500)
    counts = both.groupBy("lang").agg(F.count_if(F.col("p") & (F.col("quality") == 1)).alias("m"), F.count_if("p").alias("n"), F.count_if(F.col("quality") == 1).alias("g"))
    p, r, f1 = evaluation.prf(F.col("m"), F.col("n"), F.col("g"))
    return counts.select("lang", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))


@query("select event_type, median(value) as median from events group by event_type")
def eval_median(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.median("value").alias("median"))


_COLOURS, _THINGS = ("red", "blue", "small", "large", "new", "old", "hot", "cold"), ("ring", "bolt", "plate", "rod", "widget", "anvil", "gear", "gizmo")
_WANTED, _OWNERS = ("Ann", "Li", "Bo Chen", ""), ("Anna Lee", "Li", "Bo", "Chen")
_FIT = f"""gold as (select o_custkey as grp, o_orderkey as g, {list(_WANTED)}[o_orderkey % 4 + 1] as a, {list(_COLOURS)}[o_orderkey % 8 + 1] as w, {list(_THINGS)}[o_orderkey // 8 % 8 + 1] as x from orders),
pred as (select o_custkey as grp, l_orderkey * 8 + l_linenumber as p, {list(_OWNERS)}[min(l_suppkey) % 4 + 1] as a, min(p_name) as task from lineitem join orders on o_orderkey = l_orderkey join part on p_partkey = l_partkey group by 1, 2),
fit as (select grp, g, p from gold join pred using (grp) where gold.a <> '' and (contains(pred.a, gold.a) or contains(gold.a, pred.a)) and (contains(task, w) or contains(task, x))),
ranked as (select grp, g, row_number() over (partition by grp order by g) as i, list(p order by p) as ps from fit group by grp, g),
folded as (select distinct grp, 0 as i, []::bigint[] as used from ranked union all select f.grp, r.i, list_concat(used, list_filter(ps, lambda x: not list_contains(used, x))[1:1]) from folded f join ranked r on r.grp = f.grp and r.i = f.i + 1)"""


def _one_of(values: tuple[str, ...], place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), place.cast("int") + 1)


def expected_actions(spark, d):
    """Each order is an item that its customer's meeting should give: a name (some have none) and two keywords."""
    k = F.col("o_orderkey")
    words = F.array(_one_of(_COLOURS, k % 8), _one_of(_THINGS, F.floor(k / 8) % 8))
    return table(spark, d, "orders").select(F.col("o_custkey").alias("grp"), k.alias("g"), _one_of(_WANTED, k % 4).alias("assignee"), words.alias("keywords"))


def found_actions(spark, d):
    """Each line of an order is an item that was found: a longer or shorter name, and a part's name as task."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    own = lines.groupBy(F.col("o_custkey").alias("grp"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("p")).agg(F.min("l_suppkey").alias("s"), F.min("p_name").alias("task"))
    return own.select("grp", "p", _one_of(_OWNERS, F.col("s") % 4).alias("assignee"), F.initcap("task").alias("task"))


@query(f"with recursive {_FIT}, m as (select grp, max(len(used)) as n from folded group by grp), c as (select grp, coalesce(a, 0) as golden, coalesce(b, 0) as predicted, coalesce(n, 0) as matched from (select grp, count(*) as a from gold group by 1) full join (select grp, count(*) as b from pred group by 1) using (grp) left join m using (grp)), r as (select *, case when predicted > 0 then matched / predicted else 0 end as p, case when golden > 0 then matched / golden else 0 end as r from c) select grp as meeting_id, golden::bigint as golden, predicted::bigint as predicted, matched::bigint as matched, round(p, 3) as precision, round(r, 3) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 3) as f1 from r")
def join_greedy_bipartite(spark, d):
    """Expected action items against those found, matched in order: a name within the other and a keyword within the task."""
    g, p = expected_actions(spark, d), found_actions(spark, d)
    return matching.scores(g, p, matching.greedy(g, p)).withColumnRenamed("grp", "meeting_id")


@query("with c as (select user_id, list(event_type order by event_id) as called, list(event_type order by ts, event_id) as expected from events group by user_id) select user_id, (called[1] = expected[1])::int as first_ok, (called = expected)::int as exact, round(len(list_intersect(called, expected)) / len(list_distinct(expected)), 6) as set_recall, round(len(list_filter(called, lambda x: list_contains(expected, x))) / len(called), 6) as precision from c")
def eval_selection(spark, d):
    """The calls of each user by id against those by time."""
    e = table(spark, d, "events").select(F.col("user_id").alias("run_id"), "event_id", "ts", F.col("event_type").alias("tool"))
    called, expected = (sequence.numbered(e, ["run_id"], order).select("run_id", "place", "tool") for order in (["event_id"], ["ts", "event_id"]))
    return evaluation.selections(called, expected).withColumnRenamed("run_id", "user_id")


# --- events as streams, in batch ---
@query("select time_bucket(interval 1 hour, ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def stream_windows(spark, d):
    return streams.tumbling(table(spark, d, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("with g as (select *, coalesce(ts >= lag(ts) over (partition by user_id order by ts) + interval 30 minute, true)::int as fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, min(ts) as session_start, count(*) as n from s group by user_id, k")
def stream_sessions(spark, d):
    return streams.sessions(table(spark, d, "events")).withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))


@query("with r as (select *, sum((event_type = 'purchase')::int) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as k from events) select user_id, coalesce(k, 0)::bigint as frame_no, count(*) filter (event_type <> 'purchase') as frames, coalesce(sum(length(props)) filter (event_type <> 'purchase'), 0)::bigint as bytes from r group by user_id, coalesce(k, 0)")
def agg_frames(spark, d):
    e = table(spark, d, "events")
    stop = F.col("event_type") == "purchase"
    k = F.coalesce(F.sum(stop.cast("int")).over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return e.withColumn("frame_no", k).groupBy("user_id", "frame_no").agg(F.count_if(~stop).alias("frames"), F.coalesce(F.sum(F.when(~stop, F.length("props"))), F.lit(0)).cast("long").alias("bytes"))


# --- more of retrieval, joins, sets ---
def _pool(spark, d, k=20):
    """BM25 and vectors over whole documents, k results each."""
    q, c = asked(spark, d), docs(spark, d)
    both = [retrieval.ranked(scores, k).withColumn("channel", F.lit(name)) for name, scores in (("bm25", retrieval.bm25_best(q, c, k)), ("vector", retrieval.cosine(q, c, k)))]
    return both[0].unionByName(both[1])


_TWO = f"{_Q}, {_tf('documents')}, {_len('documents')}, {_bm25_sql('b1', 'q')}, {_hash_sql('dv', 'documents', 'doc_id')}, {_hash_sql('qv', 'q', 'query_id')}, {_cosine_sql('v1', 'qv')}, two as (select 'bm25' as channel, *, {_RANK}::int as rank from b1 union all select 'vector', *, {_RANK}::int from v1), pool as (select * from two where rank <= 20)"


@query(f"with {_TWO} select query_id, channel, rank, doc_id from pool where rank <= 5")
def rank_channel(spark, d):
    return _pool(spark, d).filter("rank <= 5").select("query_id", "channel", "rank", "doc_id")


@query(f"with {_TWO} select query_id, count(distinct doc_id) as candidates, count(*) as hits from pool group by query_id")
def setop_union_channels(spark, d):
    return _pool(spark, d).groupBy("query_id").agg(F.count_distinct("doc_id").alias("candidates"), F.count("*").alias("hits"))


@query(f"with {_TWO} select query_id, string_agg(distinct channel, ',' order by channel) as channels, count(distinct doc_id) as pool from pool group by query_id")
def search_debug(spark, d):
    return _pool(spark, d).groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channels"), F.count_distinct("doc_id").alias("pool"))


@query(f"with {_TWO} select query_id, doc_id, max(score) filter (channel = 'bm25') as bm25, max(score) filter (channel = 'vector') as vector from pool group by all")
def join_channels_full(spark, d):
    return _pool(spark, d).groupBy("query_id", "doc_id").agg(F.max(F.when(F.col("channel") == "bm25", F.col("score"))).alias("bm25"), F.max(F.when(F.col("channel") == "vector", F.col("score"))).alias("vector"))


@query(f"with {_TWO} select query_id, doc_id, rank as old_rank, row_number() over (partition by query_id order by rank)::int as new_rank from (select * from two where channel = 'bm25' and rank <= 9) join documents d using (doc_id) where d.lang = 'en' qualify new_rank <= 3")
def overfetch_filter(spark, d):
    """Three times k are fetched, then filtered by language, then cut to k: the filter must not move below the ranking."""
    top = retrieval.ranked(retrieval.bm25_best(asked(spark, d), docs(spark, d), 9), 9).select("query_id", "doc_id", F.col("rank").alias("old_rank"))
    kept = top.join(docs(spark, d).filter("lang = 'en'").select("doc_id"), "doc_id", "left_semi")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("old_rank"))
    return kept.withColumn("new_rank", rank).filter("new_rank <= 3").select("query_id", "doc_id", "old_rank", "new_rank")


@query(f"with {_TWO} select query_id, doc_id, min(rank)::int as rank from pool group by all")
def dedup_citations(spark, d):
    first = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("rank", "channel"))
    return _pool(spark, d).withColumn("k", first).filter("k = 1").select("query_id", "doc_id", "rank")


@query(f"with {_TWO} select query_id, len(list(doc_id)) >= 3 as answered from q left join (select * from pool where channel = 'bm25' and score > 20) using (query_id) group by query_id")
def qa_no_hit(spark, d):
    """Only queries with three strong results go on to a model."""
    strong = _pool(spark, d).filter((F.col("channel") == "bm25") & (F.col("score") > 20)).groupBy("query_id").agg(F.count("*").alias("n"))
    return asked(spark, d).join(strong, "query_id", "left").select("query_id", (F.coalesce("n", F.lit(0)) >= 3).alias("answered"))


@query(f"with recursive {_HYBRID}, {_BLOCKS} select * from bl")
def context_block(spark, d):
    """Numbered results with their citations and texts."""
    return retrieval.context_blocks(*_searched(spark, d))


@query(f"with {_Q}, {_FORMS}, {_EX} select query_id, substr(replace(text, chr(10), ' '), 1, 240) || coalesce(' ' || t, '') as context_query from q left join (select query_id, string_agg(term, ' ' order by k) filter (k <= 6) as t from (select *, row_number() over (partition by query_id order by longest desc, ord) as k from qm) group by query_id) using (query_id)")
def context_query(spark, d):
    q = asked(spark, d)
    hit = terms.matches(q, glossary(spark, d), "query_id").groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("longest")).alias("l"), "ord", "term"))), 1, 6).alias("t"))
    return q.join(hit, "query_id", "left").select("query_id", F.concat_ws(" ", F.substring(F.translate("text", "\n", " "), 1, 240), F.array_join(F.transform("t", lambda x: x["term"]), " ")).alias("context_query"))


@query("select q.vec_id as query_id, c.vec_id, round(list_inner_product(q.embedding::double[], c.embedding::double[]), 4) as score from embeddings q, embeddings c where q.vec_id % 100 = 0 and c.vec_id <> q.vec_id qualify row_number() over (partition by q.vec_id order by round(list_inner_product(q.embedding::double[], c.embedding::double[]), 4) desc, c.vec_id) <= 10")
def join_vector_cross(spark, d):
    """Ten nearest vectors of every hundredth one: a stated set of queries against all rows."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    found = retrieval.nearest(v.filter("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id"), v, 10)
    return retrieval.ranked(found, 10).select("query_id", F.col("doc_id").alias("vec_id"), "score")


@query("select a.user_id, count(*) as common, string_agg(a.event_type, ',' order by a.event_type) as tools from (select distinct user_id, event_type from events where value < 50) a join (select distinct user_id, event_type from events where value >= 50) b on a.user_id = b.user_id and a.event_type = b.event_type group by a.user_id")
def setop_intersect_tools(spark, d):
    """The tools that a user called for small and for large values alike: an intersection of two sets a user."""
    e = table(spark, d, "events")
    small, large = (e.filter(x).select("user_id", "event_type").distinct() for x in (F.col("value") < 50, F.col("value") >= 50))
    both = small.intersect(large)
    return both.groupBy("user_id").agg(F.count("*").alias("common"), F.array_join(F.array_sort(F.collect_list("event_type")), ",").alias("tools"))


@query("with r as (select conv_id, bool_or(role = 'system') as a, bool_or(role = 'user' and length(text) > 0) as b, bool_or(role = 'assistant' and length(text) > 0) as c from conversations group by conv_id) select conv_id, round((a::int + b::int + c::int) / 3, 6) as complete from r")
def eval_completeness(spark, d):
    """The share of the three parts of a conversation (system, user, assistant) that it has."""
    part = lambda x: F.coalesce(F.max(x.cast("int")), F.lit(0))
    role, filled = F.col("role"), F.length("text") > 0
    parts = part(role == "system") + part((role == "user") & filled) + part((role == "assistant") & filled)
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.round(parts / 3, 6).alias("complete"))


@query("select on_.user_id, on_.hits as on_hits, off_.hits as off_hits from (select user_id, count(*) as hits from events where event_id % 2 = 0 group by 1) on_ join (select user_id, count(*) as hits from events where event_id % 2 = 1 group by 1) off_ using (user_id) where on_.hits > off_.hits")
def join_flip(spark, d):
    """Users better off in one arm than in the other."""
    e = table(spark, d, "events")
    arms = [e.filter(F.col("event_id") % 2 == k).groupBy("user_id").agg(F.count("*").alias(n)) for k, n in ((0, "on_hits"), (1, "off_hits"))]
    return arms[0].join(arms[1], "user_id").filter("on_hits > off_hits")


@query("select event_type, round(median(value) filter (event_id % 2 = 0) / median(value) filter (event_id % 2 = 1), 6) as ratio from events group by event_type")
def eval_parallel_speedup(spark, d):
    even = F.col("event_id") % 2 == 0
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.median(F.when(even, F.col("value"))) / F.median(F.when(~even, F.col("value"))), 6).alias("ratio"))


@query("select user_id, count(*) filter (event_type = 'purchase') as errors, string_agg(event_id::varchar, ',' order by event_id) filter (event_type = 'purchase') as failed from events group by user_id")
def agg_errors_reduce(spark, d):
    bad = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    ids = F.array_sort(F.collect_list(bad))
    return table(spark, d, "events").groupBy("user_id").agg(F.count(bad).alias("errors"), F.nullif(F.array_join(F.transform(ids, lambda x: x.cast("string")), ","), F.lit("")).alias("failed"))


@query("select window_start, sum(n)::bigint as n from (select time_bucket(interval 30 minute, ts) + to_minutes(k) as window_start, 1 as n from events, (values (0), (-30)) as o(k)) group by window_start")
def stream_sliding(spark, d):
    return streams.sliding(table(spark, d, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
