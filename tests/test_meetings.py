"""From transcript to report: Markdown, files, readers, scores of answers and runs."""

import json
import os

import pytest
from parley.operators import chunking, evaluation, meetings, reports, retrieval
from parley.sources import readers, report_files
from pyspark.sql import functions as F

HISTORY = "array<struct<rank:int,citation:string,text:string>>"
TERMS = "array<struct<term:string,canonical:string,definition:string>>"


def md(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, str) or not v.startswith("!") else F.expr(v[1:]).alias(k) for k, v in values.items()])
    return row.select(column).first()[0]


def test_summaries(spark):
    talk = spark.createDataFrame([(1, "[0.0s-1.0s] Li: hello\n[1.0s-2.0s] Bo: a: b"), (2, "x"), (3, ""), (4, None), (5, "[0s] Z: q")], "meeting_id long, transcript string")
    answer = {"title": "Plan", "participants": ["Li"], "topics": [{"title": "T", "discussion_points": ["p"], "conclusion": "c"}, {"title": "U"}], "decisions": ["d"], "next_steps": ["s"]}
    answers = spark.createDataFrame([(2, "Sure: " + json.dumps(answer)), (1, "no json"), (5, "{}")], "meeting_id long, answer string")
    out = meetings.summaries(talk, answers)
    got = {r["meeting_id"]: r for r in out.select("*", reports.summary(F.col("summary")).alias("md")).collect()}
    assert [got[k]["failed"] for k in range(1, 6)] == [True, False, False, False, False]
    assert got[1]["summary"]["participants"] == ["Bo", "Li"] and got[1]["summary"]["topics"][0]["participants"] == ["Bo", "Li"]
    assert got[2]["md"] == "## Plan\n\n**参会人**: Li\n\n### 议题1: T\n- p\n- **结论**: c\n\n### 议题2: U\n\n### 会议决策\n- d\n\n### 下一步计划\n- s"
    assert got[3]["md"] == got[4]["md"] == "## 未知会议\n" and got[5]["summary"]["title"] == "会议纪要"
    assert out.limit(1).select(reports.summary(F.when(F.lit(False), F.col("summary")))).first()[0] == reports.NO_SUMMARY


def test_insights(spark):
    talk = spark.createDataFrame([(1, "a", 1, 6.0, "xx"), (1, "b", 2, 4.0, "y"), (2, "a", 1, 0.0, "")], "meeting_id long, speaker string, seq int, seconds double, text string")
    answers = spark.createDataFrame([(1, '{"overall_sentiment": "NEGATIVE", "sentiment_score": 0.256, "efficiency_score": 9, "keywords": ["k"], "highlights": ["h"], "suggestions": ["s", "t"]}')], "meeting_id long, answer string")
    got = {r["meeting_id"]: r for r in meetings.insights(talk, answers).collect()}
    assert (got[1]["sentiment"], got[1]["score"], got[1]["efficiency"], got[1]["failed"]) == ("negative", 0.256, 9.3, False)
    assert (got[2]["sentiment"], got[2]["score"], got[2]["failed"]) == ("neutral", 0.5, True)
    text = md(spark, reports.insight(), sentiment="neutral", score=0.256, efficiency=9.3, stats_md="S", keywords="!array('k','l')", highlights="!array('h')", suggestions="!array('s','t')")
    assert text == "**整体氛围**: neutral (得分: 0.26)\n**效率评分**: 9.3/10\n\nS\n\n**关键词**: k, l\n\n**亮点**:\n- h\n\n**改进建议**:\n- s\n- t"
    bare = md(spark, reports.insight(), sentiment="neutral", score=0.5, efficiency=5.0, stats_md=None, keywords="!cast(array() as array<string>)", highlights="!cast(null as array<string>)", suggestions="!cast(array() as array<string>)")
    assert bare == "**整体氛围**: neutral (得分: 0.50)\n**效率评分**: 5.0/10\n"


def test_history_background_and_report(spark):
    df = spark.createDataFrame([([(1, "A / b", " x\ny" + "z" * 300), (2, None, "t")], [("u", "U", "means"), ("v", None, "is"), ("w", "W", "")]), ([], [])], f"h {HISTORY}, t {TERMS}")
    names = F.transform("t", lambda x: x["term"])
    rows = df.select(reports.history(F.col("h"), names).alias("h"), reports.background(F.col("h"), F.col("t")).alias("b")).collect()
    assert rows[0]["h"] == "- **A / b**：x y" + "z" * 197 + "\n- ****：t\n\n命中术语：u、v、w"
    assert rows[0]["b"].split("\n")[2:] == ["- ：t", "## 公司术语（使用标准说法）", "- U：means", "- v：is"] and len(rows[0]["b"].split("\n")[1]) == 2 + 5 + 1 + 180
    assert (rows[1]["h"], rows[1]["b"]) == ("", "")
    lit = [F.lit(x) for x in ("m", "now", "S", "A", "I")]
    whole = spark.range(1).select(reports.report(*lit, F.lit("C")).alias("c"), reports.report(*lit, F.lit("")).alias("n")).first()
    assert whole["c"] == "# 会议报告 - m\n\n生成时间: now\n\n---\n\n## 会议纪要\n\nS\n\n---\n\n## 相关历史决议\n\nC\n\n---\n\n## 待办事项\n\nA\n\n---\n\n## 会议洞察\n\nI\n"
    assert whole["n"] == whole["c"].replace("---\n\n## 相关历史决议\n\nC\n\n", "")


def test_context_of_meetings(spark):
    glossary = spark.createDataFrame([("alpha", "Alpha", ["alf"], "first letter", "o", 1)], "term string, canonical string, aliases array<string>, definition string, owner string, ord int")
    rows = [(f"c{k}", f"T{k}", "S", f"alpha budget words {'budget ' * k} number {k}", ["knowledge", "meetings", "glossary"][k % 3]) for k in range(12)]
    corpus = retrieval.analysed(spark.createDataFrame(rows, "doc_id string, title string, section string, text string, source_type string"))
    talk = spark.createDataFrame([(1, "We speak of\nthe alf and budget"), (2, " "), (3, "qwertz")], "meeting_id long, transcript string")
    got = {r["meeting_id"]: r for r in meetings.context(talk, corpus, glossary, 2).collect()}
    assert set(got) == {1, 3} and got[1]["query"] == "We speak of the alf and budget alpha" and [t["term"] for t in got[1]["terms"]] == ["alpha"]
    best = [r["doc_id"] for r in retrieval.hybrid(spark.createDataFrame([(1, got[1]["query"])], "query_id long, text string"), corpus, glossary, 6).orderBy("rank").collect()]
    want = [c for c in best if int(c[1:]) % 3 < 2][:2]
    assert [h["citation"] for h in got[1]["history"]] == [f"T{c[1:]} / S" for c in want] and [h["rank"] for h in got[1]["history"]] == [1, 2]
    assert (got[3]["history"], got[3]["terms"]) == ([], [])


def test_report_files_are_all_there_or_none(spark, tmp_path):
    own = spark.createDataFrame([(f"m/{k % 7}" if k < 14 else f"plain{k}", f"text {k}\n") for k in range(7, 20)], "meeting_id string, text string").repartition(3)
    named = reports.file_names(own)
    folder = str(tmp_path / "out")
    report_files.write(named, folder)
    assert sorted(os.listdir(folder)) == sorted([*(f"meeting-report-m_{k}.md" for k in range(7)), *(f"meeting-report-plain{k}.md" for k in range(14, 20))])
    assert {r["value"] for r in spark.read.text(folder, wholetext=True).collect()} == {f"text {k}\n" for k in range(7, 20)}
    same = reports.file_names(spark.createDataFrame([("a/b",), ("a_b",)], "meeting_id string"))
    assert len({r["name"] for r in same.collect()}) == 2
    for bad in ([("a.md", "x"), ("b.md", None)], [("a.md", "x"), ("../b.md", "y")]):
        fresh = str(tmp_path / f"none{bad[1][0][:1]}")
        with pytest.raises(Exception, match="no text|no file name"):
            report_files.write(spark.createDataFrame(bad, "name string, text string").coalesce(1), fresh)
        assert not os.path.exists(fresh) or os.listdir(fresh) == []
    uri = f"file://{tmp_path}/uri"
    report_files.write(spark.createDataFrame([("a.md", "x")], "name string, text string"), uri)
    assert os.listdir(tmp_path / "uri") == ["a.md"]


def test_transcript_files(spark, tmp_path):
    (tmp_path / "m1.txt").write_text("[0.0s-8.5s] 张总: 好的: yes\n\nnoise\n[9s-8s] Li: back\r\n[9.0s-16.2s] Li: ok", encoding="utf-8")
    (tmp_path / "m2.txt").write_text("")
    rows = readers.transcripts(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r["seq"], r["speaker"], r["text"], r["start"], r["end"]) for r in rows if r["bad"] is None] == [(0, "张总", "好的: yes", 0.0, 8.5), (4, "Li", "ok", 9.0, 16.2)]
    assert [(r["bad"]["line"], r["bad"]["reason"], r["speaker"]) for r in rows if r["bad"]] == [("noise", "no turn", None), ("[9s-8s] Li: back", "it ends before it starts", None)]


def test_json_files(spark, tmp_path):
    (tmp_path / "qa.jsonl").write_text('{"id": "q1", "category": "c", "question": "?", "expected_sources": ["s"], "expected_terms": []}\n{"id": 7, "question": [1]\n')
    good, bad = readers.json_lines(spark, str(tmp_path / "qa.jsonl"), readers.QUESTION).orderBy(F.desc("id")).collect()
    assert good["expected_sources"] == ["s"] and good["bad"] is None and bad["bad"].startswith('{"id": 7')
    (tmp_path / "golden.json").write_text('{"meeting_id": "m",\n "action_items": [{"assignee": "A", "keywords": ["x", "y"]}, {"assignee": "B", "keywords": ["z"], "deadline_hint": "d"}]}')
    assert [tuple(r) for r in readers.golden_actions(spark, str(tmp_path / "golden.json")).orderBy("g").collect()] == [("m", 0, "A", ["x", "y"], None), ("m", 1, "B", ["z"], "d")]
    (tmp_path / "bm25.json").write_text('{"k1": 1.5, "doc_ids": ["a", "b"], "term_freqs": [{"x": 2, "y": 1}, {}], "doc_len": [3, 0], "df": {"x": 1}}')
    postings, lengths = readers.bm25_json(spark, str(tmp_path / "bm25.json"))
    assert sorted(map(tuple, postings.collect())) == [("x", "a", 2), ("y", "a", 1)] and sorted(map(tuple, lengths.collect())) == [("a", 3), ("b", 0)]
    (tmp_path / "odd.json").write_text('{"doc_ids": ["a"], "term_freqs": [], "doc_len": [3]}')
    with pytest.raises(ValueError):
        readers.bm25_json(spark, str(tmp_path / "odd.json"))


def test_chunks_as_json_lines(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "# A\nbody one\n## B\nbody two"), ("d2", "plain")], "doc_id string, text string")
    made = chunking.chunks(docs)
    readers.write_chunks(made, str(tmp_path / "c"))
    back = readers.chunks(spark, str(tmp_path / "c"))
    assert sorted(map(tuple, back.select(*made.columns).collect())) == sorted(map(tuple, made.collect()))
    (tmp_path / "c" / "extra.json").write_text("{broken\n")
    with pytest.raises(ValueError):
        readers.chunks(spark, str(tmp_path / "c"))


def test_answers_and_degraded_runs(spark):
    rows = [(1, "on", "says T", True, ["a"], ["T"]), (2, "on", "x", True, ["a", "zz"], ["T"]), (3, "on", "x", True, [], []), (4, "on", "T", False, ["a"], ["T"]), (1, "off", "x", False, None, None)]
    answers = spark.createDataFrame(rows, "id long, arm string, text string, answered boolean, citations array<string>, terms array<string>")
    corpus = spark.createDataFrame([("a",), ("a",), ("b",)], "doc_id string")
    assert {r["arm"]: tuple(r[1:]) for r in evaluation.answer_level(answers, corpus).collect()} == {"on": (3, 0.333, 0.5), "off": (0, 0.0, None)}
    runs = spark.createDataFrame([(1, "completed", ["e1", "e2", "e3", "e4"], "r"), (2, "completed", [], " "), (3, "failed", ["x"], None)], "run_id long, status string, errors array<string>, report string")
    assert tuple(evaluation.degradation(runs.filter("run_id < 3")).first()) == (2, 2, 1.0, 1, 1, ["e1", "e2", "e3"])
    assert tuple(evaluation.degradation(runs).first())[:5] == (3, 2, 0.667, 2, 1)
