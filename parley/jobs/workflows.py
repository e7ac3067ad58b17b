"""Queries over stored and running work: the index on disk, action items, agents, validation, reports. They join the catalogue."""

from __future__ import annotations

from parley.functions import text as T
from parley.jobs import catalog
from parley.jobs.catalog import asked, docs, query, table
from parley.operators import agents, conversation, evaluation, index, meetings, outbox, reports, retrieval, schemas, sequence, terms
from parley.sources import readers, report_files, shared
from parley.streaming import audit, control
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TOP = f"with {catalog._Q}, {catalog._tf('documents')}, {catalog._len('documents')}"


def _as_chunks(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("doc_id").cast("string").alias("title"), F.col("lang").alias("section"), "text", F.col("source").alias("source_type"))


def stored(spark: SparkSession, d: str) -> index.Index:
    """The documents as an index on disk: those in English first, then all that it lacks."""
    own, path = _as_chunks(docs(spark, d)), f"{shared.folder(spark)}/index-{shared.new_name()}"
    index.build(own.filter("section = 'en'"), path)
    return index.append(index.load(spark, path), own)


@query(f"{_TOP}, {catalog._bm25_sql('b1', 'q')} select query_id, rank, doc_id, score from (select *, {catalog._RANK}::int as rank from b1) where rank <= 10")
def index_search(spark, d):
    """Ten best by BM25 from the stored index, by bounds of blocks."""
    return index.search(stored(spark, d), asked(spark, d), 10)[0]


@query(f"with {catalog._Q}, {catalog._hash_sql('dv', 'documents', 'doc_id')}, {catalog._hash_sql('qv', 'q', 'query_id')}, {catalog._cosine_sql('v1', 'qv')} select query_id, rank, doc_id, score from (select *, {catalog._RANK}::int as rank from v1) where rank <= 10")
def index_nearest(spark, d):
    """Ten nearest by the hashed vectors that the stored index holds."""
    return index.nearest(index.compact(stored(spark, d)), asked(spark, d), 10)


@query("select source as source_type, count(*) as chunks, count(distinct doc_id) as docs, 'hash-512' as embedder, 512 as dims, 2 as version from documents group by rollup(source)")
def index_stats(spark, d):
    return index.stats(stored(spark, d))


@query(f"with recursive {catalog._HYBRID} select * from hy")
def index_hybrid(spark, d):
    """Hybrid retrieval over a stored index of all chunks, loaded again: nothing is cut or analysed a second time."""
    path = f"{shared.folder(spark)}/index-{shared.new_name()}"
    index.build(catalog.chunked(spark, d), path)
    return retrieval.hybrid(asked(spark, d), index.corpus(index.load(spark, path)), catalog.glossary(spark, d))


# --- action items ---
def _requests(spark, d):
    """Each order as an action item for both targets; every second name is known."""
    k, custom = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    who = F.when(k % 2 == 0, F.concat(F.lit(" Customer  "), custom)).otherwise(F.concat(F.lit("nobody "), custom))
    items = table(spark, d, "orders").select(F.col("o_custkey").alias("meeting_id"), k.alias("ord"), who.alias("assignee"), F.concat(F.lit("order "), k.cast("string")).alias("task"), F.when(k % 5 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("deadline"), F.substring("o_orderpriority", 3, 20).alias("priority"), F.lit("").alias("context"))
    people = table(spark, d, "customer").select(F.concat(F.lit("customer "), F.col("c_custkey").cast("string")).alias("name"), F.col("c_name").alias("account"))
    return outbox.requests(items, people)


@query("select o_orderkey, t.target, t.target[1] || '-' || substr(sha256(key || '|' || t.target), 1, 24) as external_id, case when t.target = 'tickets' and o_orderkey % 2 = 0 then 'Customer#' || lpad(o_custkey::varchar, 9, '0') end as account, case when o_orderkey % 5 <> 0 then strftime(o_orderdate, '%Y-%m-%d') end as due, case when o_orderkey % 5 <> 0 then epoch(o_orderdate::date::timestamp)::bigint end as due_epoch, md5(case when t.target = 'tickets' then '来源：会议 ' || o_custkey || chr(10) || '负责人：' || who || chr(10) || '上下文：' else '负责人：' || who || chr(10) || '来源会议：' || o_custkey || chr(10) || '上下文：' end) as description from (select *, case when o_orderkey % 2 = 0 then ' Customer  ' || o_custkey else 'nobody ' || o_custkey end as who, substr(sha256(o_custkey || '|' || case when o_orderkey % 2 = 0 then 'customer ' else 'nobody ' end || o_custkey || '|order ' || o_orderkey), 1, 32) as key from orders), (values ('tickets'), ('tasks')) as t(target)")
def action_requests(spark, d):
    """What would be created for each order in each target."""
    return _requests(spark, d).select(F.col("ord").alias("o_orderkey"), "target", "external_id", "account", "due", "due_epoch", F.md5("description").alias("description"))


@query("with i as (select o_orderkey, t.target, case when o_orderkey % 4 = 0 then 'skipped' when t.target = 'tickets' and o_orderpriority = '1-URGENT' then 'failed' else 'created' end as status from orders, (values ('tickets'), ('tasks')) as t(target)) select target, count(*) filter (status = 'created') as created, count(*) filter (status = 'skipped') as skipped, count(*) filter (status = 'failed') as failed, 'enabled,created=' || count(*) filter (status = 'created') || ',skipped=' || count(*) filter (status = 'skipped') || ',failed=' || count(*) filter (status = 'failed') as status from i group by target")
def pipe_actions(spark, d):
    """Two runs through the outbox: every fourth order, then all, where the tickets of urgent ones fail."""
    asked_, box = _requests(spark, d), outbox.Outbox(spark, f"{shared.folder(spark)}/outbox-{shared.new_name()}")
    box.run(asked_.filter("ord % 4 = 0"), lambda rows: rows.select("external_id", F.lit(None).cast("string").alias("error")))
    down = F.when((F.col("target") == "tickets") & (F.col("priority") == "Highest"), "is down")
    return outbox.counters(box.run(asked_, lambda rows: rows.select("external_id", down.alias("error"))))


# --- agents and arguments ---
_TRACE = "trace as (select user_id as run_id, row_number() over (partition by user_id order by ts, event_id) as step, case event_type when 'purchase' then 'final' when 'signup' then 'unknown' else 'call' end as kind, case when event_type in ('purchase', 'signup') then null else event_type || props end as signature, event_type <> 'error' as ok from events)"


def traces(spark, d):
    """Each user's events as a run: purchases are final answers, signups unknown tools, errors failed calls."""
    e = sequence.numbered(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "step")
    kind = F.when(F.col("event_type") == "purchase", "final").when(F.col("event_type") == "signup", "unknown").otherwise("call")
    signature = F.when(~F.col("event_type").isin("purchase", "signup"), F.concat("event_type", "props"))
    return e.select(F.col("user_id").alias("run_id"), "step", kind.alias("kind"), signature.alias("signature"), (F.col("event_type") != "error").alias("ok"))


@query(f"with {_TRACE} select run_id, step, kind, signature, ok from trace")
def agent_trace(spark, d):
    """Places of events in their runs, numbered over ranges."""
    return traces(spark, d)


@query(f"""with {_TRACE}, own as (select *, row_number() over (partition by run_id, signature order by step) as nth, kind = 'unknown' or (kind = 'call' and not ok) as bad from trace where step <= 12),
lagged as (select *, bad and coalesce(lag(bad) over o, false) as two from own window o as (partition by run_id order by step)),
found as (select run_id, step, 1 as why from own where kind = 'final' union all select run_id, step, 2 from own where kind = 'call' and nth > 1 union all select run_id, step, 3 from lagged where two
 union all select run_id, max(step), case when max(step) >= 12 then 4 else 5 end from own group by run_id),
stop as (select run_id, min({{'step': step, 'why': why}}) as s from found group by run_id)
select stop.run_id, ['final_answer', 'repeat_detected', 'tool_errors', 'max_steps', 'open'][s.why] as reason, s.step as step, count(own.step) as executed from stop left join own on own.run_id = stop.run_id and kind = 'call' and (own.step < s.step or (own.step = s.step and s.why > 2)) group by all""")
def agent_loop(spark, d):
    """Where each run stops: at most twelve steps, two errors in a row."""
    return agents.stops(traces(spark, d), 12, 2)


#: What arguments of each kind of event must be like.
_SCHEMAS = {
    "click": {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 89}}},
    "view": {"type": "object", "required": ["k", "page"], "properties": {"k": {"enum": list(range(0, 100, 2))}}},
    "error": {"type": "object", "additionalProperties": False, "properties": {"code": {"type": "integer"}}},
    "purchase": {"type": "object", "properties": {"k": {"type": "string"}}},
}


@query("with e as (select event_id, event_type, json_extract_string(props, '$.k')::int as k from events) select event_id, case event_type when 'click' then case when k < 10 then '$.k is less than 10' when k > 89 then '$.k is greater than 89' else '' end when 'view' then '$ lacks page' || case when k % 2 = 1 then '; $.k' else '' end when 'error' then '$.k is not known' when 'purchase' then '$.k is not of type string' else '$ the tool is not known' end as faults from e")
def schema_validate(spark, d):
    """Violations of the schema of each event's kind; a long list of values is not repeated."""
    own = schemas.validated(table(spark, d, "events"), _SCHEMAS, "event_type", "props")
    said = F.transform("violations", lambda v: F.when(v["message"].startswith("is not one of"), v["path"]).otherwise(F.concat_ws(" ", v["path"], v["message"])))
    return own.select("event_id", F.array_join(said, "; ").alias("faults"))


@query("select event_type, count(*) filter (event_type in ('view', 'click')) as allowed, case event_type when 'view' then null when 'click' then null when 'purchase' then 'write tools are disabled' when 'error' then 'unknown tool' else 'tool not in allowlist' end as reason from events group by event_type")
def policy_filter(spark, d):
    """Calls that pass: reading tools of an allowlist."""
    tools = spark.createDataFrame([("view", True), ("click", True), ("purchase", False), ("signup", True)], "tool string, readonly boolean")
    own = schemas.permitted(table(spark, d, "events"), tools, allowlist=("view", "click", "purchase"), tool="event_type")
    return own.groupBy("event_type").agg(F.count_if("allowed").alias("allowed"), F.max("reason").alias("reason"))


# --- streams, in batch ---
@query("""with m as (select user_id as conn_id, event_id as seq, epoch_ms(ts) as ms, case event_type when 'signup' then 'start' when 'click' then 'audio' when 'purchase' then 'stop' when 'view' then 'ping' else 'odd' end as kind, length(props) as size from events),
o as (select *, coalesce(ms - lag(ms) over w > 1800000, true) as opens, lead(ms) over w as later from m window w as (partition by conn_id order by ms, seq)),
p as (select *, sum(opens::int) over w + coalesce(sum((kind in ('stop', 'start'))::int) over (partition by conn_id order by ms, seq rows between unbounded preceding and 1 preceding), 0) as part from o window w as (partition by conn_id order by ms, seq)),
f as (select *, coalesce(sum((kind = 'audio')::int) over w, 0)::bigint as frames, coalesce(sum(case when kind = 'audio' then size end) over w, 0)::bigint as bytes, case when later is not null then later - ms > 1800000 else ms + 1800000 <= max(ms) over () end as silent from p window w as (partition by conn_id, part order by ms, seq))
select conn_id, seq, 'connected' as reply, 0::bigint as frames, 0::bigint as bytes from f where opens
union all select conn_id, seq, case kind when 'audio' then 'recording' when 'stop' then 'processing' when 'ping' then 'pong' when 'start' then 'started' else 'error' end, case when kind in ('audio', 'stop') then frames else 0 end, case when kind in ('audio', 'stop') then bytes else 0 end from f
union all select conn_id, seq, 'closed', case when kind in ('start', 'stop') then 0 else frames end, case when kind in ('start', 'stop') then 0 else bytes end from f where silent""")
def stream_control(spark, d):
    """Events as messages of recording connections; half an hour of silence closes one."""
    kind = F.expr("case event_type when 'signup' then 'start' when 'click' then 'audio' when 'purchase' then 'stop' when 'view' then 'ping' else 'odd' end")
    own = table(spark, d, "events").select(F.col("user_id").alias("conn_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), F.length("props").alias("size"))
    return control.in_batch(own, 1_800_000)


@query("select tool, count(*) filter (fault = '') as records, count(*) filter (fault <> '') as rejected, min(day)::varchar as first_day, max(digest) as last_digest from (select event_type as tool, case when event_id % 7 = 0 then 'not a record' when event_id % 11 = 0 then 'no time' else '' end as fault, case when event_id % 7 = 0 or event_id % 11 = 0 then null else ts::date end as day, case when event_id % 7 = 0 or event_id % 11 = 0 then null else substr(sha256(props), 1, 32) end as digest from events) group by tool")
def stream_audit(spark, d):
    """Events as lines of calls, some broken: records by tool, and what goes to the side."""
    e = table(spark, d, "events")
    seconds = F.when((F.col("event_id") % 11 != 0) | (F.col("event_id") % 7 == 0), F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    line = F.to_json(F.struct(seconds.alias("ts"), F.col("event_type").alias("tool"), F.col("value").alias("duration_ms"), F.col("props").alias("args")))
    lines = e.select("event_type", F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("{"), line)).otherwise(line).alias("value"))
    good = audit.records(lines.select("value")).groupBy("tool").agg(F.count("*").alias("records"), F.min("day").alias("first_day"), F.max("args_digest").alias("last_digest"))
    by = lines.groupBy(F.col("event_type").alias("tool")).agg(F.count("*").alias("n"))
    n = F.coalesce("records", F.lit(0))
    return by.join(good, "tool", "left").select("tool", n.alias("records"), (F.col("n") - n).alias("rejected"), F.col("first_day").cast("string").alias("first_day"), "last_digest")


# --- meetings ---
def _spoken(spark, d):
    """Conversations as transcripts, a line a turn."""
    own = catalog.segments(spark, d).withColumn("text", F.translate("text", "\n", " "))
    return reports.timed(own)


@query(f"with {catalog._TIMED} select meeting_id::varchar as meeting_id, (row_number() over (partition by meeting_id order by seq) - 1)::int as seq, since::double as start, till::double as end, speaker, md5(translate(text, chr(10), ' ')) as text from ti")
def scan_demo_transcript(spark, d):
    """Transcripts put into files, a meeting each, and read back line by line."""
    path = f"{shared.folder(spark)}/transcripts-{shared.new_name()}"
    own = reports.transcripts(_spoken(spark, d))
    report_files.write(own.select(F.concat(F.col("meeting_id").cast("string"), F.lit(".txt")).alias("name"), F.col("transcript").alias("text")), path)
    back = readers.transcripts(spark, path)
    return back.filter("bad is null").select("meeting_id", "seq", "start", "end", "speaker", F.md5("text").alias("text"))


def _answers(spark, d):
    """A model's summary of every second meeting, some within other words."""
    c = catalog.segments(spark, d).select("meeting_id").distinct().filter("meeting_id % 2 = 0")
    body = F.concat(F.lit('{"title": "M'), F.col("meeting_id").cast("string"), F.lit('", "participants": ["a", "b"], "topics": [{"title": "T", "discussion_points": ["p", "q"], "conclusion": "c"}, {"title": "U"}], "decisions": ["d"], "next_steps": []}'))
    return c.select("meeting_id", F.when(F.col("meeting_id") % 4 == 0, body).otherwise(F.concat(F.lit("Here: "), body, F.lit(" done"))).alias("answer"))


_SUMMARY = "sm as (select conv_id as meeting_id, conv_id % 2 = 1 as failed, case when conv_id % 2 = 0 then '## M' || conv_id || chr(10) || chr(10) || '**参会人**: a, b' || chr(10) || chr(10) || '### 议题1: T' || chr(10) || '- p' || chr(10) || '- q' || chr(10) || '- **结论**: c' || chr(10) || chr(10) || '### 议题2: U' || chr(10) || chr(10) || '### 会议决策' || chr(10) || '- d' || chr(10) else '## 会议纪要（自动摘要降级模式）' || chr(10) || chr(10) || '**参会人**: ' || string_agg(distinct role, ', ' order by role) || chr(10) || chr(10) || '### 议题1: 会议内容' || chr(10) || '- （LLM调用失败，请查看原始转写文本）' || chr(10) end as md from conversations group by conv_id)"


@query(f"with {_SUMMARY} select meeting_id, failed, md from sm")
def pipe_summary(spark, d):
    """Summaries from answers, and by rule where there is none, as Markdown."""
    s = meetings.summaries(reports.transcripts(_spoken(spark, d)), _answers(spark, d))
    return s.select("meeting_id", "failed", reports.summary(F.col("summary")).alias("md"))


def _insights(spark, d):
    """Every third meeting is judged, with moods known and unknown."""
    c = catalog.segments(spark, d).select("meeting_id").distinct().filter("meeting_id % 3 = 0")
    body = F.concat(F.lit('{"overall_sentiment": "'), F.when(F.col("meeting_id") % 2 == 0, "Positive").otherwise("odd"), F.lit('", "sentiment_score": 0.75, "efficiency_score": 8, "keywords": ["k", "l"], "highlights": ["h"]}'))
    return meetings.insights(catalog.segments(spark, d), c.select("meeting_id", body.alias("answer")))


_INSIGHT = catalog._BAL + """, du as (select meeting_id, sum(seconds) as seconds from seg group by 1), us as (select meeting_id, sum(duration) as used from stats group by 1),
ef as (select meeting_id, least(used / seconds, 1) * 10 as u, case when n = 1 then 5.0 else round((1 - g) * 10, 6) end as b from du join us using (meeting_id) join bal using (meeting_id)),
ins as (select meeting_id, case when meeting_id % 6 = 0 then 'positive' else 'neutral' end as sentiment, case when meeting_id % 3 = 0 then 0.75 else 0.5 end::double as score, round(0.4::double * (case when meeting_id % 3 = 0 then 8 else 5 end) + 0.3::double * b + 0.3::double * round(u, 6), 1) as efficiency, meeting_id % 3 <> 0 as failed from ef)"""


@query(f"with {_INSIGHT} select * from ins")
def pipe_insight(spark, d):
    return _insights(spark, d).select("meeting_id", "sentiment", "score", "efficiency", "failed")


def _actions(spark, d):
    """What users say are action items; those of even turns have a deadline, every third a ticket."""
    t = table(spark, d, "conversations").filter("role = 'user'")
    turn = F.col("turn")
    return t.select(F.col("conv_id").alias("meeting_id"), turn.alias("seq"), F.col("role").alias("assignee"), F.concat(F.lit("turn "), turn.cast("string")).alias("task"), F.when(turn % 2 == 0, "2024-05-01").otherwise("").alias("deadline"), F.lit("Medium").alias("priority"), F.when(turn % 3 == 0, F.concat(F.lit("t-"), turn.cast("string"))).alias("ticket"), F.lit(None).cast("string").alias("task_id"), (turn % 4 == 0).alias("skipped"))


@query(f"""with {_INSIGHT}, {_SUMMARY}, sl as (select meeting_id, '**发言统计**:' || chr(10) || string_agg(printf('- %s: %.1f%% %s (%.1fs, %d次)', speaker, ratio * 100, repeat('█', floor(ratio * 20)::int), duration, turns), chr(10) order by place) as md from stats group by meeting_id),
im as (select meeting_id, '**整体氛围**: ' || sentiment || printf(' (得分: %.2f)', score) || chr(10) || '**效率评分**: ' || efficiency || '/10' || chr(10) || chr(10) || sl.md || chr(10) || case when meeting_id % 3 = 0 then chr(10) || '**关键词**: k, l' || chr(10) || chr(10) || '**亮点**:' || chr(10) || '- h' else '' end as md from ins join sl using (meeting_id)),
ac as (select conv_id as meeting_id, row_number() over (partition by conv_id order by turn) as i, turn from conversations where role = 'user'),
am as (select meeting_id, string_agg(i || '. **user**: turn ' || turn || case when turn % 2 = 0 then ' | 截止: 2024-05-01' else '' end || ' [Medium]' || case when turn % 3 = 0 then ' (Jira: t-' || turn || ')' else '' end, chr(10) order by i) as md, count(*) filter (turn % 2 = 0) as reminders, count(*) filter (turn % 3 = 0) as tickets, count(*) filter (turn % 4 = 0) as skipped from ac group by meeting_id)
select sm.meeting_id, coalesce(reminders, 0) as reminders, coalesce(tickets, 0) as tickets, coalesce(skipped, 0) as skipped, 'meeting-report-' || sm.meeting_id || '.md' as name, md5('# 会议报告 - ' || sm.meeting_id || chr(10) || chr(10) || '生成时间: T' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## 会议纪要' || chr(10) || chr(10) || sm.md || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## 待办事项' || chr(10) || chr(10) || coalesce(am.md, '*（无待办事项）*') || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## 会议洞察' || chr(10) || chr(10) || im.md || chr(10)) as report
from sm join im using (meeting_id) left join am using (meeting_id)""")
def pipe_followup(spark, d):
    """Reports of all meetings, put into files and read back."""
    t, segments = reports.transcripts(_spoken(spark, d)), catalog.segments(spark, d)
    none = spark.createDataFrame([], "meeting_id long, history array<struct<rank:int,citation:string,text:string>>, terms array<struct<term:string>>")
    own = shared.written(meetings.followups(t, meetings.summaries(t, _answers(spark, d)), _actions(spark, d), _insights(spark, d), conversation.speaker_stats(segments), none, "T"), "followups")
    named, path = reports.file_names(own), f"{shared.folder(spark)}/reports-{shared.new_name()}"
    report_files.write(named.select("name", F.col("report").alias("text")), path)
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.md5("value").alias("report"))
    return named.drop("report").join(files, "name").select("meeting_id", "reminders", "tickets", "skipped", "name", "report")


_SPOKEN = "sp as (select conv_id as query_id, string_agg(printf('[%.1fs-%.1fs] %s: %s', since, till, speaker, translate(text, chr(10), ' ')), chr(10) order by seq) as text from (select *, meeting_id as conv_id from ti) group by conv_id)"


@query(f"with {catalog._TIMED}, {catalog._GL}, fo as (select term, ord, unnest(list_distinct(forms)) as form from gl), {_SPOKEN}, mt as (select query_id, term, ord, max(length(form)) as longest from sp join fo on length(form) >= 2 and contains(lower(text), lower(form)) group by all), pl as (select *, row_number() over (partition by query_id order by longest desc, ord) as place from mt) select query_id as meeting_id, trim(replace(substr(text, 1, 240), chr(10), ' ') || coalesce(' ' || t, '')) as query, coalesce(e, '') as terms from sp left join (select query_id, string_agg(term, ' ' order by place) filter (place <= 6) as t, string_agg(term, ',' order by place) filter (place <= 8) as e from pl group by query_id) using (query_id)")
def pipe_context(spark, d):
    """What each meeting is looked up with in the chunks of all documents, and its terms; the history itself is tested apart."""
    own = meetings.context(reports.transcripts(_spoken(spark, d)), catalog.corpus(spark, d), catalog.glossary(spark, d))
    return own.select("meeting_id", "query", F.array_join(F.transform("terms", lambda t: t["term"]), ",").alias("terms"))


@query("with p as (select vec_id as id, a.arm, vec_id % 5 <> 0 or a.arm = 'on' as answered, vec_id % 3 = 0 as bad, label % 2 = 0 as asks, vec_id % 4 = 0 as says from embeddings, (values ('on'), ('off')) as a(arm)) select arm, count(*) filter (answered) as answered, round(count(*) filter (answered and not bad) / count(*) filter (answered), 3) as citation_valid_rate, round(count(*) filter (answered and asks and says) / count(*) filter (answered and asks), 3) as term_covered_rate from p group by arm")
def eval_answer_level(spark, d):
    """Answers of two arms: citations that the table of vectors holds, and expected terms in the text."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.explode(F.array(F.lit("on"), F.lit("off"))).alias("arm"))
    own = v.select("id", "arm", F.when(F.col("id") % 4 == 0, "it says term here").otherwise("it says nothing").alias("text"), ((F.col("id") % 5 != 0) | (F.col("arm") == "on")).alias("answered"), F.when(F.col("id") % 3 == 0, F.array("id", F.lit(-1).cast("long"))).otherwise(F.array("id")).alias("citations"), F.when(F.col("label") % 2 == 0, F.array(F.lit("term"), F.lit("other"))).otherwise(F.array().cast("array<string>")).alias("terms"))
    return evaluation.answer_level(own, table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")))


@query("select count(*) as runs, count(*) filter (o_orderstatus <> 'P') as completed, round(count(*) filter (o_orderstatus <> 'P') / count(*), 3) as completed_rate, count(*) filter (o_orderkey % 3 = 0) as errors_recorded, count(*) filter (o_orderkey % 4 <> 0) as reports_written from orders")
def eval_degradation(spark, d):
    """Orders as runs without a model: how many end, record their errors and leave a report."""
    k = F.col("o_orderkey")
    runs = table(spark, d, "orders").select(k.alias("run_id"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("completed").alias("status"), F.when(k % 3 == 0, F.array(F.lit("no model"))).otherwise(F.array().cast("array<string>")).alias("errors"), F.when(k % 4 == 0, " ").otherwise("# report").alias("report"))
    return evaluation.degradation(runs).drop("error_samples")


def _found(spark, d):
    """query_id, history and terms of all queries: their results with citations, and the terms that they hold."""
    q, g = asked(spark, d), catalog.glossary(spark, d)
    results, corpus = catalog._searched(spark, d)
    own = results.select("query_id", "rank", "doc_id").join(corpus.select("doc_id", T.citation(F.col("title"), F.col("section")).alias("citation"), "text"), "doc_id")
    history = own.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "citation", "text"))).alias("history"))  # five a query
    named = terms.matches(q, g, "query_id").join(g.select("term", "canonical", "definition"), "term").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("longest")).alias("l"), "ord", "term", "canonical", "definition"))).alias("terms"))  # no more than the glossary
    return q.join(history, "query_id", "left").join(named, "query_id", "left").select("query_id", F.coalesce("history", F.array().cast("array<struct<rank:int,citation:string,text:string>>")).alias("history"), F.coalesce(F.transform("terms", lambda t: F.struct(t["term"].alias("term"), t["canonical"].alias("canonical"), t["definition"].alias("definition"))), F.array().cast("array<struct<term:string,canonical:string,definition:string>>")).alias("terms"))


_LINES = "ci as (select query_id, rank, case when section <> '' then title || ' / ' || section else title end as citation, replace(text, chr(10), ' ') as flat from hy join co using (doc_id)), tm as (select *, row_number() over (partition by query_id order by longest desc, ord) as place from qm)"


@query(f"with recursive {catalog._HYBRID}, {_LINES} select query_id, md5(h || case when t is null then '' else chr(10) || chr(10) || '命中术语：' || t end) as md from (select query_id, string_agg('- **' || citation || '**：' || substr(trim(flat), 1, 200), chr(10) order by rank) as h from ci group by query_id) left join (select query_id, string_agg(term, '、' order by place) as t from tm group by query_id) using (query_id)")
def history_md(spark, d):
    """Results as the section of earlier decisions of a report; queries without any have none."""
    md = reports.history(F.col("history"), F.transform("terms", lambda t: t["term"]))
    return _found(spark, d).select("query_id", md.alias("md")).filter("md <> ''").select("query_id", F.md5("md").alias("md"))


@query(f"with recursive {catalog._HYBRID}, {_LINES} select query_id, md5('{reports.BACKGROUND}' || chr(10) || h || case when t is null then '' else chr(10) || '{reports.TERMS}' || chr(10) || t end) as md from (select query_id, string_agg('- ' || citation || '：' || substr(flat, 1, 180), chr(10) order by rank) as h from ci group by query_id) left join (select query_id, string_agg('- ' || term || '：about ' || term, chr(10) order by place) as t from tm where place <= 6 group by query_id) using (query_id)")
def background_block(spark, d):
    """Results and terms as the background of a prompt."""
    md = reports.background(F.col("history"), F.col("terms"))
    return _found(spark, d).select("query_id", md.alias("md")).filter("md <> ''").select("query_id", F.md5("md").alias("md"))


@query(f"with recursive {catalog._CHUNKS} select * from ck")
def scan_chunks_jsonl(spark, d):
    """Chunks put into JSON lines and read back."""
    path = f"{shared.folder(spark)}/chunks-{shared.new_name()}"
    readers.write_chunks(catalog.chunks(spark, d), path)
    return readers.chunks(spark, path).drop("metadata")
