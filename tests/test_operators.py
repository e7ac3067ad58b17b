import json
from decimal import ROUND_HALF_UP, Decimal

import pytest
from parley.functions import text as T
from parley.operators import chunking, conversation, evaluation, ledger, retrieval, terms
from parley.sources import readers
from parley.streaming import windows
from pyspark.sql import functions as F


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "text string").select(expr(F.col("text"))).first()[0]


def test_tokens(spark):
    assert one(spark, "Ab-c v1.2 x_y!", T.words) == ["ab-c", "v1.2", "x_y"]
    assert one(spark, "a语义检索 b 图", T.tokens) == ["a", "b", "语义", "义检", "检索", "图"]
    assert one(spark, "语义检索", T.query_tokens)[-4:] == ["语", "义", "检", "索"]
    assert one(spark, "", T.tokens) == []


def test_scalar_functions(spark):
    dates = {"2024-3-5": "2024-03-05", " 2024-03-05T10:00": "2024-03-05", "2024-02-31": "", "soon": "", None: ""}
    assert {t: one(spark, t, T.deadline) for t in dates} == dates
    assert one(spark, 'Sure: {"a": 1} ok', T.salvaged_json) == '{"a": 1}'
    assert one(spark, '{"a": 1', T.salvaged_json) is None
    assert one(spark, "[2] and [1][2][9]", lambda c: T.citations(c, F.lit(3))) == [2, 1]
    assert one(spark, " a b/c ", T.safe_id) == "a_b_c"
    assert one(spark, "A  b", lambda c: T.item_key(c)) == one(spark, "a B".lower() + " ", lambda c: T.item_key(c))


def test_tokens_of_all_scripts(spark):
    assert one(spark, "ひらがな カナ 한국어 検索", T.tokens) == ["ひら", "らが", "がな", "カナ", "한국", "국어", "検索"]
    assert one(spark, "メモ1図", T.query_tokens) == ["1", "メモ", "図"]


def brute_windows(text, most=420, overlap=80):
    if len(text) <= most:
        return [text] if text else []
    out, at = [], 0
    while True:
        end = min(at + most, len(text))
        if end < len(text):
            ends = [i + 1 for i in range(at + most // 2, end) if text[i] in chunking.ENDS]
            end = ends[-1] if ends else end
        out.append(text[at:end].strip())
        if end == len(text):
            return [x for x in out if x]
        at = max(end - overlap, at + 1)


def test_windows(spark):
    texts = ["".join(f"Sentence number {i} goes on for a while.\n" for i in range(60)), "a" * 1000, "短。" * 500, " " * 900 + "x", "", None, "short "]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in chunking.windows(rows).orderBy("doc_id", "piece").collect():
        got.setdefault(r["doc_id"], []).append((r["piece"], r["piece_text"]))
        assert texts[r["doc_id"]][r["start"] :].lstrip().startswith(r["piece_text"])
    assert got == {i: list(enumerate(brute_windows(t))) for i, t in enumerate(texts) if t}


def test_headings(spark):
    md = "intro\n# A\r\none\r\n### C\n\n## B\n two \n#nohead\n# D\n"
    rows = chunking.sections(spark.createDataFrame([(1, md), (2, ""), (3, None)], "doc_id long, text string")).orderBy("section_no").collect()
    assert [(r["section_no"], r["path"], r["start"], r["body"]) for r in rows] == [(0, "", 0, "intro"), (1, "A", 10, "one"), (2, "A > B", 26, "two \n#nohead")]


def test_chunks(spark):
    md = "# A\n\n# B\n" + "x" * 500
    rows = chunking.chunks(spark.createDataFrame([("d", "T", md)], "doc_id string, title string, text string")).orderBy("chunk_id").collect()
    assert [(r["chunk_id"].rsplit("-", 1)[0], r["title"], r["section"], r["start"], len(r["text"])) for r in rows] == [("d#0-0", "T", "B", 9, 420), ("d#0-1", "T", "B", 9, 160)]


def test_retrieval(spark, monkeypatch):
    schema = "doc_id string, title string, section string, text string, source_type string"
    rows = [("1", "t", "alpha", "alpha beta beta", "knowledge"), ("2", "t", "", "beta gamma", "knowledge"), ("3", "t", "", "", "knowledge"), ("4", None, None, None, "knowledge"), ("g#0", "g", "x", "alpha alpha", "glossary")]
    docs = spark.createDataFrame(rows, schema)
    asked = spark.createDataFrame([(1, "alpha"), (2, "nothing")], "query_id long, text string")
    glossary = spark.createDataFrame([("gamma", "gamma", None, 1)], "term string, canonical string, aliases array<string>, ord int")
    scores = {(r["query_id"], r["doc_id"]): r["score"] for r in retrieval.bm25(asked, docs).collect()}
    assert set(scores) == {(1, "1"), (1, "g#0")} and scores[1, "1"] > 0
    near = sorted(map(tuple, retrieval.ranked(retrieval.cosine(asked, docs, 1), 1).drop("rank").collect()))
    assert near == sorted(map(tuple, retrieval.ranked(retrieval.cosine(asked, docs), 1).drop("rank").collect())) == [(1, "g#0", 1.0)]
    top = retrieval.hybrid(asked, docs, glossary, 3).orderBy("rank").collect()
    assert [(r["query_id"], r["doc_id"], r["section_hit"], r["term_hits"]) for r in top] == [(1, "1", 1, 0), (1, "g#0", 0, 0)]
    free = retrieval.hybrid(asked, docs, glossary.withColumn("term", F.lit("alpha")).withColumn("canonical", F.lit("alpha")), 3)
    assert free.filter("doc_id = 'g#0'").first()["score"] > 1.5 * top[1]["score"]  # a query with a term is not held off the glossary
    for name in ("BROADCAST_TERMS", "BROADCAST_QUERIES"):
        monkeypatch.setattr(retrieval, name, 0)
    assert retrieval.hybrid(asked, docs, glossary, 3).orderBy("rank").collect() == top


def test_lookup(spark):
    g = spark.createDataFrame([("rag", "retrieval", ["r2"], 1), ("drag", "drag", None, 2), ("x", "x", None, 3)], "term string, canonical string, aliases array<string>, ord int")
    needles = spark.createDataFrame([(1, " RAG "), (2, "ra"), (3, "none"), (4, "an x")], "id long, needle string")
    got = {r["id"]: (r["exact"], r["n"], [m["term"] for m in r["matches"]]) for r in terms.lookup(needles, g, "id").collect()}
    assert got == {1: (True, 1, ["rag"]), 2: (False, 2, ["rag", "drag"]), 4: (False, 1, ["x"])}


def test_terms(spark):
    g = spark.createDataFrame([("rag", "retrieval", ["r2"], 1), ("x", "x", None, 2)], "term string, canonical string, aliases array<string>, ord int")
    q = spark.createDataFrame([(1, "what is RAG"), (2, "none")], "query_id long, text string")
    once = terms.expanded(q, g)
    assert {r["query_id"]: r["text"] for r in once.collect()} == {1: "what is RAG r2 retrieval", 2: "none"}
    assert not terms.expanded(once.drop("changed"), g).filter("changed").count()


def test_conversation(spark):
    rows = [(1, "a", 1, 12.84, "xx"), (1, "b", 2, 3.2, "y"), (2, "a", 1, 4.0, "z")]
    s = conversation.speaker_stats(spark.createDataFrame(rows, "meeting_id long, speaker string, seq long, seconds double, text string"))
    assert [(r["speaker"], r["duration"], r["ratio"]) for r in s.filter("meeting_id = 1").orderBy("place").collect()] == [("a", 12.8, 0.8), ("b", 3.2, 0.2)]
    b = {r["meeting_id"]: r["balance"] for r in conversation.balance(s).collect()}
    assert b == {1: 7.0, 2: 5.0}


def test_shares_do_not_depend_on_the_order_of_rows(spark):
    """Some shares lie halfway between two digits, where the order in which seconds are added decides."""
    talks = {2458: [("user", 248), ("assistant", 921), ("user", 128), ("assistant", 626), ("user", 77)], 8598: [("system", 67), ("user", 153), ("assistant", 494), ("user", 281), ("assistant", 1444), ("user", 97), ("assistant", 1144)], 19157: [("system", 99), ("user", 163), ("assistant", 1523), ("user", 215)], 19212: [("system", 301), ("user", 49), ("assistant", 711), ("user", 203)], 20565: [("user", 329), ("assistant", 399), ("user", 94), ("assistant", 920), ("user", 258)]}
    rows = [(m, who, k, n / 10.0, "x" * n) for m, turns in talks.items() for k, (who, n) in enumerate(turns)]
    want = {}
    for m, turns in talks.items():
        own = {}
        for who, n in turns:
            own[who] = own.get(who, 0.0) + n / 10.0
        whole = 0.0
        for x in own.values():
            whole += x
        want |= {(m, who): float(Decimal(repr(x / whole)).quantize(Decimal("0.001"), ROUND_HALF_UP)) for who, x in own.items()}
    for order in (rows, rows[::-1], sorted(rows, key=lambda r: r[4]), sorted(rows, key=lambda r: (r[1], -r[2]))):
        s = conversation.speaker_stats(spark.createDataFrame(order, "meeting_id long, speaker string, seq long, seconds double, text string").coalesce(1))
        assert {(r["meeting_id"], r["speaker"]): r["ratio"] for r in s.collect()} == want


def test_ledger_is_idempotent(spark):
    schema = "item_key string, target string, external_id string, meeting_id long, created_at double"
    old = spark.createDataFrame([("k", "t", "A", 1, 1.0)], schema)
    new = spark.createDataFrame([("k", "t", "B", 2, 2.0), ("l", "t", "C", 2, 2.0)], schema)
    once = ledger.upserted(old, new)
    assert sorted(map(tuple, ledger.upserted(once, new).collect())) == sorted(map(tuple, once.collect())) == [("k", "t", "B", 1, 2.0), ("l", "t", "C", 2, 2.0)]
    assert ledger.to_create(new, old).count() == 1
    assert {r["target"]: r["n"] for r in ledger.stats(once).collect()} == {None: 2, "t": 2}


def test_readers(spark, tmp_path):
    (tmp_path / "b.md").write_text("# B")
    (tmp_path / "a.md").write_text("text")
    (tmp_path / "g.json").write_text(json.dumps({"version": "1", "terms": [{"term": " rag ", "aliases": ["r"]}, {"term": ""}]}))
    (tmp_path / "u.json").write_text(json.dumps({"Ann  B": "ann", "Bo": {"account": "bo", "aliases": ["Bob"]}}))
    out = readers.corpora(spark, [(str(tmp_path), "knowledge"), (str(tmp_path / "none"), "meeting")]).collect()
    assert sorted((r["doc_id"], r["source_type"]) for r in out) == [("a", "knowledge"), ("b", "knowledge")]
    assert [(r["term"], r["canonical"]) for r in readers.glossary(spark, str(tmp_path / "g.json")).collect()] == [("rag", "rag")]
    assert {r["name"]: r["account"] for r in readers.user_map(spark, str(tmp_path / "u.json")).collect()} == {"ann b": "ann", "bo": "bo", "bob": "bo"}


def test_index_checks_its_embedder(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    readers.write_index(retrieval.postings(docs), retrieval.lengths(docs), str(tmp_path / "i"), {"embedder": "hash-512"})
    assert readers.read_index(spark, str(tmp_path / "i"), "hash-512")[0].count() == 2
    with pytest.raises(ValueError):
        readers.read_index(spark, str(tmp_path / "i"), "other")


def test_streams(spark, tmp_path):
    rows = [(1, "chunk", 3), (1, "chunk", 4), (1, "stop", 0), (1, "chunk", 1), (2, "stop", 0)]
    spark.createDataFrame(rows, "conn_id long, kind string, size long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("conn_id long, kind string, size long").parquet(str(tmp_path / "in"))
    q = windows.frames(stream).writeStream.format("memory").queryName("frames_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("frames_out").collect())) == [(1, 2, 7), (2, 0, 0)]
    batch = spark.createDataFrame([("k", "t", "A", 1, 1.0)], "item_key string, target string, external_id string, meeting_id long, created_at double")
    write = windows.into_ledger(str(tmp_path / "ledger"))
    write(batch, 0)
    write(batch, 1)
    more = spark.createDataFrame([(f"k{i}", "t", f"B{i}", 2, 2.0) for i in range(50)] + [("k", "t", "B", 2, 2.0)], batch.schema)
    write(more, 2)
    write(more, 2)
    kept = {r["item_key"]: tuple(r)[2:] for r in windows.read_ledger(spark, str(tmp_path / "ledger")).select(*batch.columns).collect()}
    assert len(kept) == 51 and kept["k"] == ("B", 1, 2.0) and kept["k7"] == ("B7", 2, 2.0)
    write(spark.createDataFrame([("k3", "t", "C", 3, 3.0)], batch.schema), 3)
    assert sorted(len(list(x.glob("bucket=*"))) for x in (tmp_path / "ledger/data").iterdir())[:3] == [1, 1, 1] and windows.read_ledger(spark, str(tmp_path / "ledger")).count() == 51
