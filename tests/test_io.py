"""Readers, writers and the stream, on files made here."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quarry.operators import resolve, retrieval
from quarry.plans import answer as an
from quarry.plans.retrieve import Engine
from quarry.sources import files, html, sinks
from quarry.streaming import ask


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_questions(spark, tmp_path):
    put(tmp_path / "FinQA/dev/metadata.jsonl", '{"id":"a","question":"q","company_cik":12,"report_year":2015}\n{"id":"b","company_cik":null}\n')
    put(tmp_path / "ConvFinQA/turn_0.jsonl", '{"id":"c"}\n')
    put(tmp_path / "TAT-DQA/x.jsonl", "")
    rows = {r.id: r for r in files.questions(spark, str(tmp_path)).collect()}
    assert {k: v.subset_source for k, v in rows.items()} == {"a": "FinQA", "b": "FinQA", "c": "ConvFinQA"} and rows["a"].company_cik == 12
    assert files.questions(spark, str(tmp_path), "FinQA").count() == 2
    with pytest.raises(ValueError):
        files.questions(spark, str(tmp_path), "other")


def test_chunk_and_block_files(spark, tmp_path):
    assert not files.corpus_present(spark, str(tmp_path))
    put(tmp_path / "V_2015_1.json", json.dumps([{"text": "a", "n_tokens": 1, "heading": None}, {"text": "b", "n_tokens": 2, "heading": "H"}]))
    put(tmp_path / "b/W_2014_2.json", json.dumps([{"text": "t", "is_title": True}, {"rows": [["x", "1"], ["y"]]}]))
    assert files.corpus_present(spark, str(tmp_path))
    assert [(r.filing_stem, r.chunk_index, r.text, r.heading) for r in files.chunk_files(spark, str(tmp_path)).orderBy("chunk_index").collect()] == [("V_2015_1", 0, "a", None), ("V_2015_1", 1, "b", "H")]
    blocks = files.block_files(spark, str(tmp_path / "b")).orderBy("block_index").collect()
    assert [(b.kind, b.rows) for b in blocks] == [("text", None), ("table", [["x", "1"], ["y"]])]
    names = spark.createDataFrame([("V_2015_1.json",), ("W_2015_1.json",), ("._x.json",), ("A_B_2014_2.json",), ("V_2015_1.bak",)], "name string")
    assert {tuple(r) for r in files.file_index(names).collect()} == {(1, 2015, "W_2015_1"), (2, 2014, "A_B_2014_2")}


def test_ranking_lines(spark, tmp_path):
    good = '{"id":"q","split":"dev","cells":{"a":[["S_1_1",3,0.1],["S_1_1",4,0.9],["S_1_1",5,0.9]]}}\n\n{"id":"q","split":"dev","cells":{"a":[["S_1_1",7,0.5],["S_1_1",8,0.7]]}}\n'
    path = put(tmp_path / "s.jsonl", good)
    rows = files.ranking(files.score_lines(spark, path), "a").orderBy("rank").collect()
    assert [(r.chunk_index, r["rank"]) for r in rows] == [(8, 1), (7, 2)]
    for text, cell in ((good, "b"), ('{"id":"q"}\n', "a"), ('{"id":"q","cells":{"a":[["S",1]]}}\n', "a")):
        bad = put(tmp_path / "bad.jsonl", text)
        with pytest.raises(PySparkException):
            files.ranking(files.score_lines(spark, bad), cell).collect()


def test_reference_files(spark, tmp_path):
    lex, tickers = files.lexicon(spark, put(tmp_path / "lex.json", '{"aliases":{"visa":["V"],"under armour":["UAA","UA"]},"tickers":["V","UA","UAA"]}'))
    assert {(r.alias, tuple(r.tickers)) for r in lex.collect()} == {("visa", ("V",)), ("under armour", ("UA", "UAA"))} and tickers.count() == 3
    assert files.word_list(spark, ["", str(tmp_path / "none"), put(tmp_path / "w.txt", "Visa\nthe \n")]).count() == 2
    assert files.word_list(spark, [str(tmp_path / "none")]).count() == 0
    ev = files.evidence(spark, put(tmp_path / "e.json", '{"q1":{"table_rows":[["a","1"]],"sentences":["s"]}}')).first()
    assert ev.question_id == "q1" and ev.table_rows == [["a", "1"]] and files.evidence(spark, str(tmp_path / "no.json")).count() == 0
    assert files.gold_tables(spark, put(tmp_path / "g.json", '[{"question_id":"q","table_index":1},{"question_id":"q","table_index":1}]')).count() == 1
    assert files.gold_tables(spark, str(tmp_path / "no.json")).count() == 0
    assert tuple(files.summaries(spark, put(tmp_path / "s.json", '{"V_2015_1:4":"text"}')).first()) == ("V_2015_1", 4, "text")
    log = put(tmp_path / "log.jsonl", '{"stem":"a","status":"ok","n_chunks":3}\n{"stem":"b","status":"error","error":"e"}\n')
    assert {(r.stem, r.n_chunks, r.error) for r in files.ingest_log(spark, log).collect()} == {("a", 3, None), ("b", None, "e")}
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/V_2015_1.html").write_bytes(b"<p>caf\xe9</p>")
    assert files.raw_filings(spark, str(tmp_path / "raw")).first().html == "<p>caf�</p>"


def test_annual_reports(spark, tmp_path):
    block = lambda rows: dict(zip(("form", "filingDate", "accessionNumber", "primaryDocument", "reportDate"), map(list, zip(*rows))))
    recent = block([("10-K/A", "2016-03-01", "x1", "d1", "2015-12-31"), ("10-K", "2016-02-01", "x2", "d2", "2015-12-31"), ("10-K", "2016-01-01", "x3", "d3", "2015-06-30"), ("10-K", "2015-02-01", "x4", "d4", "")])
    older = block([("10-K405", "2001-02-01", "y1", "e1", "2000-12-31"), ("10-K", "2015-02-01", "y2", "e2", "2014-12-31")])
    put(tmp_path / "CIK0000000007.json", json.dumps({"filings": {"recent": recent, "files": [{"name": "old-1.json"}]}}))
    put(tmp_path / "old-1.json", json.dumps(older))
    wanted = spark.createDataFrame([(7, 2015), (7, 2014), (7, 2000)], "company_cik long, fiscal_year int")
    got = files.annual_reports(files.submissions(spark, str(tmp_path)), wanted)
    assert {(r.fiscal_year, r.accession_number) for r in got.collect()} == {(2015, "x2"), (2014, "y2")}


def test_html_blocks(spark):
    page = """<html><style>x</style><h2>Item 7</h2><p>Sales <b>rose</b>.</p><p><b>Overview</b></p><div>F-12</div><div>&nbsp;</div>
    <table><tr><td>Sales</td><td>$</td><td>6,635</td><td>(619</td><td>)</td></tr><tr><td> </td></tr></table>
    <table><tr><td><a href="#i1">Item 1</a></td></tr><tr><td><a href="#i2">Item 2</a></td></tr></table>tail"""
    rows = html.parse(spark.createDataFrame([("S", page), ("E", ""), ("N", None)], "filing_stem string, html string")).orderBy("block_index").collect()
    assert [(r.text, r.is_title, r.rows) for r in rows] == [("Item 7", True, None), ("Sales rose.", False, None), ("Overview", True, None), (None, None, [["Sales", "$6,635", "(619)"]]), ("tail", False, None)]


def test_append_is_incremental(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = lambda *stems: spark.createDataFrame([(s, i, None, 1, "t", [1.0], "A") for s in stems for i in range(2)], "filing_stem string, chunk_index int, heading string, n_tokens int, text string, embedding array<float>, variant string")
    calls = []

    def embed(df):
        calls.append(1)
        return df.withColumn("embedding", F.array(F.lit(2.0).cast("float")))

    assert sinks.append_new(rows("V_2015_1", "W_2014_2"), path, embed) == 2
    assert sinks.append_new(rows("V_2015_1", "X_2013_3"), path, embed) == 1
    assert sinks.append_new(rows("V_2015_1"), path, embed) == 0
    t = spark.read.parquet(path)
    assert t.count() == 6 and t.where("variant = 'A' AND fiscal_year = 2013 AND ticker = 'X'").count() == 2


def test_label_cache(spark, tmp_path):
    path = str(tmp_path / "labels")
    rows = lambda g: spark.createDataFrame([("dev", "a", "k", g)], "split string, id string, row_key string, gold array<int>")
    with pytest.raises(FileNotFoundError):
        sinks.read_labels(spark, path, {})
    sinks.write_labels(rows([1]), path, {"code": "x"})
    sinks.write_labels(rows([1]), path, {"code": "x"})
    with pytest.raises(sinks.LabelsMoved):
        sinks.write_labels(rows([2]), path, {"code": "x"})
    sinks.write_labels(rows([2]), path, {"code": "y"}, allow_moved=True)
    assert sinks.read_labels(spark, path, {"code": "y"}).first().gold == [2]
    with pytest.raises(RuntimeError):
        sinks.read_labels(spark, path, {"code": "x"})


def test_json_writers(spark, tmp_path):
    events = spark.createDataFrame([("a", "ok")], "stem string, status string")
    for _ in range(2):
        sinks.append_events(events, str(tmp_path / "log"))
    assert files.ingest_log(spark, str(tmp_path / "log")).count() == 2
    sinks.write_json(events, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    lex = spark.createDataFrame([("b", ["B"]), ("a", ["A", "C"])], "alias string, tickers array<string>")
    sinks.write_lexicon(lex, spark.createDataFrame([("B",), ("A",)], "ticker string"), str(tmp_path / "lex"))
    back, known = files.lexicon(spark, str(tmp_path / "lex"))
    assert {r.alias for r in back.collect()} == {"a", "b"} and known.count() == 2


def test_chunk_table(spark):
    spark.sql("DROP TABLE IF EXISTS made_chunks")
    sinks.create_chunk_table(spark, "made_chunks")
    assert spark.table("made_chunks").columns[-1] == "fiscal_year"
    spark.sql("DROP TABLE made_chunks")


# ---- serving


@pytest.fixture(scope="module")
def engine(spark):
    chunks = spark.createDataFrame([("V_2015_1403161", 3, "Net revenue $13,880M in 2015", [1.0] + [0.0] * 63), ("V_2014_1403161", 1, "Net revenue in 2014", [0.9, 0.1] + [0.0] * 62), ("W_2015_2", 0, "Boilers of 2015", [0.0, 1.0] + [0.0] * 62)], "filing_stem string, chunk_index int, text string, embedding array<float>")
    chunks = chunks.withColumn("ticker", F.split_part("filing_stem", F.lit("_"), F.lit(1)))
    companies = spark.createDataFrame([("Visa Inc.", "V")], "company_name string, company_symbol string")
    lexicon = resolve.load(resolve.build_lexicon(companies), companies.selectExpr("company_symbol AS ticker"), spark.createDataFrame([], "word string"))
    return Engine(chunks, retrieval.Bm25Index.build(chunks), lexicon, lambda q: q.withColumn("vector", F.array_repeat(F.lit(0.1), 64)))


PIECES = ["Net revenue ", "was 13,880.", "\nANSWER: 13880"]


def test_events_in_order(engine):
    got = list(ask.events(engine, "What was Visa's net revenue in 2015?", lambda prompt: iter(PIECES), include_text=True))
    assert [b["stage"] for e, b in got if e == "stage"] == ["resolve", "embed", "search", "rerank", "generate"]
    kinds = [e for e, _ in got]
    assert kinds.index("sources") < kinds.index("text") < kinds.index("answer") and kinds[-1] == "answer"
    assert [b["text"] for e, b in got if e == "text"] == PIECES
    body = got[-1][1]
    assert (body["value"], body["value_status"]) == (13880.0, "ok") and body["citations"] == dict(got)["sources"]["citations"]
    assert {c["filing_stem"] for c in body["citations"]} == {"V_2015_1403161", "V_2014_1403161"} and body["citations"][0]["text"]
    assert ask.ask(engine, "What was Visa's net revenue in 2015?", lambda p: iter(PIECES))["value"] == 13880
    frames = list(ask.frames(got))
    assert all(f.endswith("\n\n") and f.startswith("event: ") for f in frames) and json.loads(frames[-1].split("data: ")[1])["value"] == 13880


def test_stage_events_go_out_before_their_stage_runs(engine, monkeypatch):
    """A stage that cannot run is announced, and the error comes after it; the answer tells the seconds of each stage."""
    stream = ask.events(engine, "What was Visa's net revenue in 2015?", lambda prompt: iter(PIECES))
    first = next(stream)
    assert first == ("stage", {"stage": "resolve"}) and "resolve_s" not in engine.timings
    second = next(stream)
    assert second == ("stage", {"stage": "embed", "tickers": ["V"]}) and engine.timings["resolve_s"] > 0 and "embed_s" not in engine.timings
    rest = list(stream)
    answer = rest[-1][1]
    assert {"resolve_s", "embed_s", "search_s", "rerank_s", "total_s", "generation_first_text_s", "generation_s"} <= set(answer["stage_latency"])
    assert answer["latency_s"] >= answer["stage_latency"]["total_s"] and [e for e, b in rest if b.get("stage") == "rerank" and b["candidates"] > 0]
    assert engine.diagnosis["fallback_reason"] is None
    broken = Engine(engine.chunks, engine.index, engine.lexicon, lambda q: 1 / 0)
    got = list(ask.events(broken, "What was Visa's net revenue in 2015?", lambda prompt: iter(PIECES)))
    assert [b.get("stage") for e, b in got if e == "stage"] == ["resolve", "embed"] and got[-1] == ("error", {"status": 500, "detail": "ZeroDivisionError"})


def test_error_events(engine):
    class Busy(Exception):
        code = 429

    def fails(error):
        def generate(prompt):
            raise error
            yield

        return generate

    last = lambda q, g: list(ask.events(engine, q, g))[-1]
    assert last("", iter) == ("error", {"status": 422, "detail": "question must have 1 to 2000 characters and k 1 to 50"})
    assert last("visa revenue growth in total", fails(Busy()))[1]["status"] == 429
    assert last("visa revenue growth in total", fails(ValueError()))[1]["status"] == 500
    empty = Engine(engine.chunks.limit(0), retrieval.Bm25Index.build(engine.chunks.limit(0)), engine.lexicon, engine.embed)
    assert list(ask.events(empty, "visa revenue growth in total", iter))[-1] == ("error", {"status": 404, "detail": "no candidates retrieved"})
    with pytest.raises(RuntimeError):
        ask.ask(empty, "visa revenue growth in total", iter)


def test_request_stream(spark, engine, tmp_path):
    rows = [(1, "2024-01-01 10:00:00", "visa net revenue of the year"), (1, "2024-01-01 10:00:00", "visa net revenue of the year"), (2, "2024-01-01 11:30:00", "boilers of the year 2015"), (3, "2024-01-01 11:31:00", "")]
    df = spark.createDataFrame(rows, "request_id long, at string, question string").selectExpr("request_id", "timestamp(at) AS asked_at", "timestamp(at) AS received_at", "1L AS client_id", "question", "CAST(NULL AS INT) AS k", "CAST(NULL AS BOOLEAN) AS include_text")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = ask.serve(ask.requests(spark, str(tmp_path / "in")), engine, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert q.exception() is None
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {r.query_id for r in got.collect()} == {1, 2} and got.groupBy("query_id", "rank").count().where("count > 1").isEmpty()
    counts = ask.counts(ask.requests(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("request_counts").trigger(availableNow=True).start()
    counts.awaitTermination(120)
    assert sorted((r.n_requests, r.n_valid) for r in spark.table("request_counts").collect()) == [(1, 1), (2, 1)]


def test_prompt_and_citations(spark):
    res = spark.createDataFrame([(1, 2, "V_2015_1", 4, "second", 0.5), (1, 1, "V_2015_1", 3, "first", 0.9)], "query_id long, rank int, filing_stem string, chunk_index int, text string, score double")
    text = an.evidence(res).first().evidence
    assert text == "[V_2015_1 chunk 3] first\n\n[V_2015_1 chunk 4] second"
    made = res.limit(1).select(an.prompt(F.lit("Q?"), F.lit(text)).alias("p")).first().p
    assert made == an.PROMPT.format(question="Q?", evidence=text)
    assert [(c.chunk_index, c.text) for c in an.citations(res).first().citations] == [(3, None), (4, None)]
    answers = spark.createDataFrame([(1, "ANSWER: 5")], "query_id long, answer string")
    body = an.responses(spark.createDataFrame([(1, "Q?")], "query_id long, question string"), answers, an.citations(res, F.lit(True))).first()
    assert (body.value, body.value_status, body.citations[0].text) == (5.0, "ok", "first")


def test_archive_source(spark, tmp_path):
    from quarry.sources.edgar import Archive

    put(tmp_path / "CIK0000000007.json", "{}")
    spark.dataSource.register(Archive)
    read = spark.read.format("archive").option("interval", "0").option("names", "CIK0000000007.json, none.json")
    rows = read.option("contact", "me@example.org").load(f"file://{tmp_path}").collect()
    assert [(r.name, r.status, r.body and bytes(r.body)) for r in rows] == [("CIK0000000007.json", 200, b"{}"), ("none.json", None, None)]
    with pytest.raises(PySparkException):
        spark.read.format("archive").load(f"file://{tmp_path}").collect()


def test_command_line(spark, tmp_path, capsys):
    from quarry.__main__ import main

    put(tmp_path / "html/V_2015_1.html", "<h2>Item 7</h2><p>Net revenue rose.</p><table><tr><td>a</td><td>1</td></tr></table>")
    out = str(tmp_path / "out")
    assert main(["corpus", "--html", str(tmp_path / "html"), "--out", out]) == 0
    assert main(["corpus", "--out", out, "--rechunk"]) == 0
    assert spark.read.parquet(f"{out}/chunks").first().heading == "Item 7" and spark.read.json(f"{out}/log").first().n_tables == 1
    for n in (1, 0):
        assert main(["index", "--chunks", f"{out}/chunks", "--table", f"{out}/table", "--terms", f"{out}/terms"]) == 0
        assert json.loads(capsys.readouterr().out.strip().split("\n")[-1]) == {"appended": n}
    assert retrieval.Bm25Index.read(spark, f"{out}/terms").n == 1
    new = str(tmp_path / "new")
    spark.createDataFrame([("dev", "q", "V_2015_1", [3])], "split string, id string, row_key string, gold array<int>").write.parquet(new)
    common = ["--new", new, "--path", f"{out}/gold", "--fingerprint", "x"]
    assert main(["labels", "build", *common]) == 0 and main(["labels", "check", *common]) == 0
    scores = put(tmp_path / "s.jsonl", '{"id":"q","split":"dev","cells":{"a":[["V_2015_1",4,0.1],["V_2015_1",3,0.9]]}}\n')
    assert main(["evaluate", "--scores", scores, "--cell", "a", "--gold", f"{out}/gold", "--out", str(tmp_path / "report")]) == 0
    assert json.loads(capsys.readouterr().out.strip().split("\n")[-1])["mrr_mean"] == 1.0


def test_word_list_problems(spark):
    from quarry.operators.corpus import word_list_problems

    words = spark.createDataFrame([("visa",), ("visa",), ("apple",)], "word string")
    assert word_list_problems(words, 2, ("visa",)) == [] and word_list_problems(words, 3, ("gap",)) == ["2 words, 3 expected", "no 'gap'"]


def test_core_does_not_need_the_subpackage():
    import ast
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    for path in (root / "quarry").rglob("*.py"):
        if "llm" in path.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any(n.startswith("quarry.llm") for n in names), path


def test_labels_in_one_call(spark, tmp_path):
    from quarry.plans import labels

    questions = spark.createDataFrame([("a", "dev ", "V_2015_1", "c1", "page words of the filing that nobody needs here at all"), ("b", "test", "V_2015_1", "c2", None), ("c", "dev", None, "c3", "x")], "id string, split string, filing_stem string, context_id string, context string")
    chunks = spark.createDataFrame([("V_2015_1", 0, "intro"), ("V_2015_1", 1, "net sales | 1,234 | 5,678"), ("V_2015_1", 2, "we sold many more cars than in any year before this one")], "filing_stem string, chunk_index int, text string")
    evidence = spark.createDataFrame([("a", [["net sales", "1234", "5678"]], ["we sold many more cars than in any year"]), ("b", None, None)], "question_id string, table_rows array<array<string>>, sentences array<string>")
    tables, summaries = spark.createDataFrame([("b", 3)], "question_id string, table_index int"), spark.createDataFrame([("V_2015_1", 3, "intro")], "filing_stem string, table_index int, summary string")
    made = labels.build(questions, evidence, tables, summaries, chunks)
    assert {(r.split, r.id, tuple(r.gold)) for r in made.collect()} == {("dev", "a", (1, 2)), ("test", "b", (0,)), ("dev", "c", ())}
    parts = {"questions": questions, "chunks": chunks}
    marks = labels.fingerprint(parts)
    assert labels.fingerprint({"questions": questions.orderBy(F.desc("id")), "chunks": chunks}) == marks
    assert labels.fingerprint(parts | {"chunks": chunks.limit(2)})["chunks"] != marks["chunks"] and set(marks) == {"code", "questions", "chunks"}
    sinks.write_labels(made, str(tmp_path / "g"), marks)
    assert labels.cached(spark, str(tmp_path / "g"), marks, questions).count() == 3
    with pytest.raises(labels.RowsChanged):
        labels.cached(spark, str(tmp_path / "g"), marks, questions.withColumn("context", F.lit("other")))


def test_restore_checks_and_display(spark, monkeypatch, tmp_path):
    from quarry.functions import text as tx
    from quarry.operators import corpus

    chunks = spark.createDataFrame([("A", 1, [1.0]), ("A", 2, [1.0])], "variant string, chunk_index int, embedding array<float>")
    assert corpus.restore_problems(chunks, {"A": 2}, corpus.checksum(chunks.orderBy(F.desc("chunk_index")))) == []
    bad = chunks.union(spark.createDataFrame([("B", 1, None)], chunks.schema))
    assert corpus.restore_problems(bad, {"A": 3}, corpus.checksum(chunks)) == ["the checksum differs", "variant 'A': 2 rows, 2 embedded, 3 expected", "1 rows of variant 'B'"]
    df = spark.createDataFrame([("Sales were 13,880 or 13880, not 113,880.\nANSWER: 13880", 13880.0), ("x 5.25%", 5.25), (None, None)], "t string, v double")
    got = df.select(tx.without_answer_line(F.col("t")), tx.highlighted(F.col("t"), F.col("v"))).collect()
    assert got[0][0] == "Sales were 13,880 or 13880, not 113,880." and got[0][1].startswith("Sales were <mark>13,880</mark> or <mark>13880</mark>, not 113,880.")
    assert got[1][1] == "x <mark>5.25</mark>%" and got[2][1] is None
    with pytest.warns(UserWarning):
        assert files.word_list(spark, [str(tmp_path / "none")]).count() == 0
    (tmp_path / "w").write_text("Visa\n")
    monkeypatch.setenv(files.WORDS_VARIABLE, str(tmp_path / "w"))
    assert [r.word for r in files.word_list(spark, []).collect()] == ["visa"]
