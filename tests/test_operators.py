"""Operators on small fixtures, against plain versions."""

import difflib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import ann, corpus, gold, metrics, resolve, retrieval

# ---- fusion


def plain_fuse(lists, years, alpha=0.01):
    score, seen = {}, {}
    for i, ranked in enumerate(lists):
        for r, key in enumerate(ranked, 1):
            score[key] = score.get(key, 0.0) + 1 / (60 + r)
            seen.setdefault(key, (i, r))
    for key in score:
        if years:
            score[key] += alpha / (1 + min(abs(int(key[0].split("_")[1]) - y) for y in years))
    return sorted(score, key=lambda k: (-round(score[k], 12), seen[k], k))


def test_fuse_equals_plain_reading(spark):
    rng = random.Random(1)
    keys = [(f"T{i % 4}_{2010 + i % 7}_9", i) for i in range(40)]
    questions = {0: [], 1: [2012], 2: [2016, 2010]}
    lists = {q: [rng.sample(keys, 15) for _ in range(3)] for q in questions}
    frames = [spark.createDataFrame([(q, *k, r) for q in lists for r, k in enumerate(lists[q][i], 1)], "query_id long, filing_stem string, chunk_index int, rank int") for i in range(3)]
    qs = spark.createDataFrame(list(questions.items()), "query_id long, years array<int>")
    got = {}
    for r in retrieval.fuse(frames, qs).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.filing_stem, r.chunk_index))
    assert got == {q: plain_fuse(lists[q], y) for q, y in questions.items()}


def test_dense_filter_and_unusable_vectors(spark):
    chunks = spark.createDataFrame([("A_2010_1", 0, "A", [1.0, 0.0]), ("B_2010_1", 0, "B", [1.0, 0.1]), ("B_2010_1", 1, "B", None), ("B_2010_1", 2, "B", [0.0, 0.0]), ("B_2010_1", 3, "B", [float("nan"), 1.0]), ("A_2010_1", 1, "A", [2.0, 0.0])], "filing_stem string, chunk_index int, ticker string, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0], []), (2, [1.0, 0.0], ["B"]), (3, [0.0, 0.0], None), (4, [1.0, 0.0], ["none"])], "query_id long, vector array<float>, tickers array<string>")
    rows = retrieval.dense(q, chunks, 2, 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.filing_stem, r.chunk_index, r.rank) for r in rows] == [(1, "A_2010_1", 0, 1), (1, "A_2010_1", 1, 2), (2, "B_2010_1", 0, 1)]


def test_dense_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    chunks = spark.createDataFrame([("A_2010_1", i, "A", [1.0, i / 10]) for i in range(9)], "filing_stem string, chunk_index int, ticker string, embedding array<float>")
    q = spark.createDataFrame([(i, [1.0, i / 10], None) for i in range(5)], "query_id long, vector array<float>, tickers array<string>")
    assert {(r.query_id, r.chunk_index) for r in retrieval.dense(q, chunks, 1, 2).collect()} == {(i, i) for i in range(5)}


def test_dense_searches_many_splits_in_as_many_tasks_as_cores(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "SCORED_AT_ONCE", 1)  # slices of 256 rows
    rng = np.random.default_rng(4)
    vectors, asked = rng.integers(-3, 4, (3000, 4)).astype(float), rng.integers(1, 4, (6, 4)).astype(float)  # many equal cosines
    rows = [(f"{'AB'[i % 2]}_{2010 + i % 5}_1", i, "AB"[i % 2], v.tolist()) for i, v in enumerate(vectors)]
    chunks = spark.createDataFrame(rows, "filing_stem string, chunk_index int, ticker string, embedding array<float>").repartition(24)
    tickers = [["B"] if i % 3 == 0 else None for i in range(6)]
    q = spark.createDataFrame([(i, v.tolist(), tickers[i]) for i, v in enumerate(asked)], "query_id long, vector array<float>, tickers array<string>")
    got: dict = {}
    for r in retrieval.dense(q, chunks, 40, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.filing_stem, r.chunk_index))
    unit = lambda x: x / np.linalg.norm(x)
    for i, v in enumerate(asked):
        plain = sorted((-round(float(unit(e) @ unit(v)), 6), stem, n) for (stem, n, t, _), e in zip(rows, vectors) if e.any() and (not tickers[i] or t in tickers[i]))
        assert got[i] == plain[:40]
    block = [(i, v.tolist(), None) for i, v in enumerate(asked)]
    found = retrieval._dense_block(chunks.select("filing_stem", "chunk_index", "ticker", "embedding").where("exists(embedding, x -> x <> 0)"), block, 40, 4)
    assert found.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert found.count() <= 40 * 6 * spark.sparkContext.defaultParallelism  # what is shuffled


def test_index_survives_writing_and_shuffled_search(spark, tmp_path, monkeypatch):
    texts = ["alpha beta beta", "beta gamma", None, "", "delta alpha ALPHA alpha"]
    chunks = spark.createDataFrame([("A_2010_1", i, "A", t) for i, t in enumerate(texts)], "filing_stem string, chunk_index int, ticker string, text string")
    q = spark.createDataFrame([(1, "Alpha, alpha beta?", []), (2, "none", []), (3, None, None)], "query_id long, question string, tickers array<string>")
    index = retrieval.Bm25Index.build(chunks)
    index.write(str(tmp_path / "ix"), 2)
    wanted = index.search(q).orderBy("query_id", "rank").collect()
    assert retrieval.Bm25Index.read(spark, str(tmp_path / "ix")).search(q).orderBy("query_id", "rank").collect() == wanted
    half = tmp_path / "half"
    retrieval.Bm25Index.build(chunks.where("chunk_index < 2")).write(str(half), 5)
    retrieval.Bm25Index.append(chunks.where("chunk_index >= 2"), str(half))
    read = retrieval.Bm25Index.read(spark, str(half))
    assert read.search(q).orderBy("query_id", "rank").collect() == wanted
    plan = read.search(q.where("query_id = 2"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    monkeypatch.setattr(retrieval, "SENT_TERMS", 0)
    assert index.search(q).orderBy("query_id", "rank").collect() == wanted

    def score(doc, n=4, mean=9 / 4):
        words, out = doc.lower().split(), 0.0
        for t, df in (("alpha", 2), ("beta", 2)):
            tf = words.count(t)
            out += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean)) if tf else 0
        return round(out, 9)

    assert {r.chunk_index: r.score for r in wanted} == {i: score(texts[i]) for i in (0, 1, 4)}


def test_term_search_shuffles_the_best_of_each_task_only(spark, monkeypatch):
    """Pairs of question and chunk that share a term do not leave the task that scores them; ranks equal a plain reading, over blocks,
    ties, filters and many more chunks than are kept."""
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    monkeypatch.setattr(retrieval, "SCORED_AT_ONCE", 1 << 11)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    rows = [(f"T{i % 5}_{2000 + i % 3}_{i % 2}", i, f"T{i % 5}", " ".join(["the", *rng.choices(words, range(1, 41), k=rng.randrange(1, 9))])) for i in range(1500)]
    questions = [(i, " ".join(["the", *rng.sample(words, 3)]), [[], None, ["T1"], ["T2", "T4"]][i % 4]) for i in range(30)] + [(50, "the", [])]
    index = retrieval.Bm25Index.build(spark.createDataFrame(rows, "filing_stem string, chunk_index int, ticker string, text string"))
    found = index.search(spark.createDataFrame(questions, "query_id long, question string, tickers array<string>"), 12)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.filing_stem, r.chunk_index, r.score))
    texts = {(s, i, t): x.split() for s, i, t, x in rows}
    n, mean = len(rows), sum(map(len, texts.values())) / len(rows)
    df = {w: sum(w in x for x in texts.values()) for w in ["the", *words]}
    for q, question, tickers in questions:
        want = []
        for (stem, i, ticker), x in texts.items():
            if (not tickers or ticker in tickers) and any(w in x for w in question.split()):
                parts = [math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * x.count(w) * 2.2 / (x.count(w) + 1.2 * (0.25 + 0.75 * len(x) / mean)) for w in question.split() if w in x]
                want.append((-round(sum(parts), 9), stem, i))
        want = [(stem, i, -s) for s, stem, i in sorted(want)[:12]]
        assert [x[:2] for x in got[q]] == [x[:2] for x in want], q
        assert [x[2] for x in got[q]] == pytest.approx([x[2] for x in want], abs=1.1e-9)
    shuffled = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in shuffled and "Join" not in shuffled


def test_vector_index_recalls_the_exact_search(spark, tmp_path):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 16))
    x = centres[rng.integers(0, 40, 3000)] + 0.5 * rng.standard_normal((3000, 16))
    rows = [(f"F_{2000 + i % 9}_{i % 50}", i, f"T{i % 3}", v.tolist()) for i, v in enumerate(x)] + [("F_2000_1", 9000, "T1", None), ("F_2000_1", 9001, "T1", [0.0] * 16)]
    chunks = spark.createDataFrame(rows, "filing_stem string, chunk_index int, ticker string, embedding array<float>")
    q = spark.createDataFrame([(i, x[i * 7].tolist(), ["T1"] if i % 4 == 0 else []) for i in range(60)] + [(100, None, [])], "query_id long, vector array<float>, tickers array<string>")
    index = ann.VectorIndex.write(chunks, str(tmp_path / "v"), 16, 30)
    keys = lambda df: {(r.query_id, r.chunk_index) for r in df.collect()}
    want = keys(retrieval.dense(q, chunks, 10, 16))
    got = keys(index.search(q, 10))
    assert len(want & got) >= 0.9 * len(want) and keys(index.search(q, 10, 30)) == want
    assert keys(ann.VectorIndex(spark, str(tmp_path / "v")).search(q, 10)) == got
    none = ann.VectorIndex.write(chunks.where("chunk_index >= 9000"), str(tmp_path / "none"), 16)
    assert none.search(q).count() == 0


# ---- metrics


def test_metrics(spark):
    gold_rows = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, ["x"]), (4, ["z"]), (5, None)], "query_id long, relevant array<string>")
    ranks = spark.createDataFrame([(1, ["c", "a", "d"]), (2, ["a"]), (3, ["y"]), (5, ["q"])], "query_id long, retrieved array<string>")
    s = {r.query_id: r for r in metrics.scored(ranks, gold_rows).collect()}
    assert s[1].recall_10 == 0.5 and s[1].mrr == 0.5
    assert s[1].ndcg_10 == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert s[2].no_gold and s[2].recall_10 is None and s[5].no_gold and s[4].missing and s[3].mrr == 0.0
    r = metrics.report(metrics.scored(ranks, gold_rows)).first()
    assert (r.n_scored, r.n_questions, r.skipped_missing, r.skipped_no_gold) == (2, 5, 1, 2)
    assert r.mrr_mean == 0.25 and r.mrr_stderr == pytest.approx(0.25)
    lone = metrics.report(metrics.scored(ranks.where("query_id = 1"), gold_rows.where("query_id = 1"))).first()
    assert lone.mrr_stderr == 0.0
    none = metrics.report(metrics.scored(ranks, gold_rows.where("query_id = 2"))).first()
    assert none.mrr_mean is None and none.mrr_stderr is None


# ---- gold labels


def plain_cover(cells, chunks):
    import re

    def words(t):
        return re.findall(r"\d+\.\d+|[a-z0-9]+", re.sub(r"(?<=\d),(?=\d)", "", t.lower()))

    def nums(ws):
        return {w for w in ws if re.fullmatch(r"\d+(\.\d+)?", w) and len(w.replace(".", "")) >= 3 and not re.fullmatch(r"(19|20)\d\d", w)}

    freq = {}
    for _, t in chunks:
        for x in nums(words(t)):
            freq[x] = freq.get(x, 0) + 1
    want = {x for x in nums(words(" ".join(cells))) if freq.get(x, 0) <= 5}
    label = {w for w in words(cells[0]) if not re.fullmatch(r"\d+(\.\d+)?", w)}
    rows = []
    for i, t in chunks:
        got = want & nums(words(t))
        ok = bool(label) and len(label & set(words(t))) >= 0.6 * len(label)
        if got and (len(got) > 1 or ok):
            rows.append((-len(got), not ok, i, got))
    covered, hits = set(), set()
    for _, _, i, got in sorted(rows, key=lambda r: r[:3]):
        if got - covered:
            hits.add(i)
            covered |= got
    return hits if want and len(covered) >= 0.6 * len(want) else set()


def test_row_cover_equals_plain_reading(spark):
    rng = random.Random(2)
    numbers = [f"{rng.randrange(100, 9999):,}" for _ in range(25)]
    labels = ["total net sales", "interest expense", "goodwill"]
    chunks = [(i, " | ".join([rng.choice(labels), *rng.sample(numbers, 4), "2015"])) for i in range(14)]
    rows = [(f"q{k}", 1, "A_2010_1", [rng.choice(labels), *rng.sample(numbers, rng.choice([1, 2, 5])), "12"]) for k in range(25)]
    got = {}
    for r in gold.row_chunks(spark.createDataFrame(rows, "question_id string, row_no int, filing_stem string, cells array<string>"), spark.createDataFrame([("A_2010_1", *c) for c in chunks], "filing_stem string, chunk_index int, text string")).collect():
        got.setdefault(r.question_id, set()).add(r.chunk_index)
    want = {q: h for q, _, _, cells in rows if (h := plain_cover(cells, chunks))}
    assert got == want and want


def plain_align(gold_words, chunks, least):
    words = [w for _, ws in chunks for w in ws]
    place = [k for k, (_, ws) in enumerate(chunks) for _ in ws]
    blocks = [b for b in difflib.SequenceMatcher(None, words, gold_words, autojunk=False).get_matching_blocks() if b.size >= least]
    groups = []
    for b in blocks:
        if groups and place[b.a] - place[groups[-1][-1].a + groups[-1][-1].size - 1] <= 3:
            groups[-1].append(b)
        else:
            groups.append([b])
    return {chunks[place[i]][0] for g in groups if sum(b.size for b in g) >= 0.15 * len(gold_words) for b in g for i in range(b.a, b.a + b.size)}


@pytest.mark.parametrize("most", [0, 500_000])
def test_align_equals_plain_matching(spark, most, monkeypatch):
    monkeypatch.setattr(gold, "SENT_RUNS", most)
    rng = random.Random(3)
    word = [f"w{i}" for i in range(60)]
    filings = {"A": [(0, ["a"] * 30), (1, ["b"] * 5 + word[:30]), (2, word[30:] + ["c"] * 9), (3, ["d"] * 20), (4, []), (5, ["f"] * 9), (9, word[10:16] + ["g"] * 9)]}
    golds = [("q", "A", 1, word), ("p", "A", 1, []), ("r", "none", 1, word)]
    for n in range(6):
        filings[f"F{n}"] = [(i, [rng.choice("abc") for _ in range(rng.randrange(0, 14))]) for i in range(12)]
        flat = [w for _, ws in filings[f"F{n}"] for w in ws]
        golds += [(f"q{n}", f"F{n}", k, flat[k * 7 : k * 7 + 12] + [rng.choice("abc") for _ in range(12)]) for k in range(4)]
    texts = spark.createDataFrame([(q, f, k, " ".join(w)) for q, f, k, w in golds] + [("z", "A", 1, None)], "question_id string, filing_stem string, text_no int, gold string")
    chunks = spark.createDataFrame([(f, i, " ".join(w)) for f, rows in filings.items() for i, w in rows] + [("A", 20, None)], "filing_stem string, chunk_index int, text string")
    for least in (6, 4):
        want = {(q, i) for q, f, _, w in golds if f in filings for i in plain_align(w, filings[f], least)}
        got = {tuple(r) for r in gold.aligned_chunks(texts, chunks, least).collect()}
        assert got == want and len(want) > 5


def test_layers_and_diff(spark):
    frame = lambda *rows: spark.createDataFrame(list(rows), "question_id string, chunk_index int")
    out = gold.layered(frame(("q", 1)), frame(("q", 1), ("q", 2)), frame(("q", 3), ("p", 4)), frame(("q", 2), ("r", 5)))
    assert {tuple(r) for r in out.collect()} == {("q", 1, "table_row"), ("q", 2, "sentence"), ("p", 4, "context_cluster"), ("r", 5, "gold_summary")}
    labels = lambda *rows: spark.createDataFrame(list(rows), "split string, id string, row_key string, gold array<int>")
    old = labels(("dev", "a", "k", [1, 2]), ("dev", "b", "k", [1]), ("dev", "c", "k", [1]), ("dev", "d", "k", None))
    new = labels(("dev", "a", "k", [2, 1]), ("dev", "b", "k", [3]), ("dev", "c", "m", [1]), ("dev", "e", "k", [1]))
    assert {tuple(r) for r in gold.label_diff(old, new).collect()} == {("dev", "b", "gold differs"), ("dev", "c", "row differs"), ("dev", "d", "missing"), ("dev", "e", "extra")}


# ---- packing


def pack(spark, atoms):
    rows = [("F", i, t, n, k == "title", k == "table", k == "furniture") if k != "furniture" else ("F", i, t, n, True, False, True) for i, (k, t, n) in enumerate(atoms)]
    df = spark.createDataFrame(rows, "filing_stem string, atom_index int, text string, tokens int, is_title boolean, is_table boolean, is_furniture boolean")
    return corpus.pack_chunks(df).orderBy("chunk_index").collect()


def body(n, w="x"):
    return " ".join([w] * n)


def test_packer_rules(spark):
    assert pack(spark, []) == [] and pack(spark, [("title", "Alone", 1)]) == []
    one = pack(spark, [("title", "Item 1", 2), ("text", body(300), 300), ("furniture", "12", 1), ("text", body(300, "y"), 300)])
    assert len(one) == 1 and one[0].heading == "Item 1" and one[0].text.startswith("# Item 1\n\nx") and one[0].n_tokens == 603
    # a title ends a chunk of 900 tokens or more, and both headings are kept in a chunk that spans them
    two = pack(spark, [("title", "A", 1), ("text", body(900), 900), ("title", "B", 1), ("text", body(250), 250)])
    assert [c.heading for c in two] == ["A", "B"]
    span = pack(spark, [("title", "A", 1), ("text", body(300), 300), ("title", "B", 1), ("text", body(300), 300)])
    assert [c.heading for c in span] == ["A\n# B"]
    # beyond 900 a text starts anew; a table may go on to 1500 with the text after it
    assert len(pack(spark, [("text", body(800), 800), ("text", body(300), 300)])) == 2
    assert len(pack(spark, [("text", body(800), 800), ("table", body(300), 300)])) == 1
    assert len(pack(spark, [("text", body(800), 800), ("table", body(300), 300), ("text", body(500), 500)])) == 2
    # a rest of under 200 tokens folds back, if both fit
    fold = pack(spark, [("text", body(850), 850), ("text", body(100, "z"), 100)])
    assert len(fold) == 1 and fold[0].text.endswith("z") and fold[0].n_tokens == 950
    kept = pack(spark, [("text", body(1450), 1450), ("text", body(100), 100)])
    assert len(kept) == 2


def test_splits_of_oversized_blocks():
    rows = [["h", "v"]] + [[f"r{i}", body(400)] for i in range(5)]
    parts = corpus.split_table(rows)
    assert len(parts) == 2 and all(p.startswith("h | v\n") for p in parts) and corpus.split_table([]) == []
    text = " ".join(body(700, "a") + "." for _ in range(3)) + " " + body(3100, "b")
    assert [len(p.split()) for p in corpus.split_text(text)] == [1400, 700, 1500, 1500, 100]


def test_atoms(spark):
    blocks = [("F", 0, "Item 1", True, None), ("F", 1, body(150), True, None), ("F", 2, None, None, [["a", "1"], ["b", "2"]])] + [("F", 3 + i, "Table of  Contents", True, None) for i in range(10)]
    rows = corpus.atoms(spark.createDataFrame(blocks, "filing_stem string, block_index int, text string, is_title boolean, rows array<array<string>>")).orderBy("atom_index").collect()
    assert [(r.is_title, r.is_table, r.is_furniture) for r in rows[:4]] == [(True, False, False), (False, False, False), (False, True, False), (True, False, True)]
    assert rows[2].text == "a | 1\nb | 2"


def test_splits_keep_documents_together(spark):
    rows = [(f"q{i}", f"d{i % 17}", None) for i in range(400)] + [("n", None, "x")]
    df = corpus.assign_splits(spark.createDataFrame(rows, "id string, context_id string, split string"))
    by = {}
    for r in df.collect():
        by.setdefault(r.context_id, set()).add(r.split)
    assert all(len(v) == 1 for v in by.values()) and by[None] == {None}
    n = df.groupBy("split").count().collect()
    share = {r["split"]: r["count"] / 400 for r in n}
    assert 0.7 <= share["train"] <= 0.8
    assert df.exceptAll(corpus.assign_splits(spark.createDataFrame(rows, "id string, context_id string, split string"))).isEmpty()


def test_preflight_and_stats(spark):
    chunks = spark.createDataFrame([("A", "f", 0, 5, [1.0]), ("A", "f", 1, 7, None), ("B", "g", 0, None, [1.0]), ("A", "f", 2, 9, [1.0]), ("A", "f", 3, 11, [1.0])], "variant string, filing_stem string, chunk_index int, n_tokens int, embedding array<float>")
    rows = {r.variant: tuple(r)[1:] for r in corpus.preflight(chunks, {"A": 4, "C": 2}).collect()}
    assert rows == {"A": (4, 3, 0, False), "B": (1, 1, 1, False), "C": (0, 0, -2, False)}
    assert not corpus.ready(chunks, {"A": 4}) and corpus.ready(chunks.where("variant = 'B'"), {"B": 1})
    stats = {r.filing_stem: (r.n_chunks, r.median_tokens, r.max_tokens) for r in corpus.filing_stats(chunks).collect()}
    assert stats == {"f": (4, 9, 11), "g": (1, 0, 0)}


# ---- entities


@pytest.fixture(scope="module")
def lexicon(spark):
    companies = spark.createDataFrame([("Visa Inc.", "V"), ("Under Armour, Inc.", "UA"), ("Under Armour, Inc.", "UAA"), ("American Airlines Group", "AAL"), ("American Tower Corp", "AMT"), ("American Water Works", "AWK"), ("Apple Inc", "AAPL"), ("Entergy Corporation", "ETR"), ("Aon plc", "AON"), ("Berkshire Hathaway", "BRK")], "company_name string, company_symbol string")
    words = spark.createDataFrame([(w,) for w in ("visa", "apple", "american", "under", "Key", "berkshire")], "word string")
    return resolve.load(resolve.build_lexicon(companies), companies.selectExpr("company_symbol AS ticker"), words)


RESOLVED = {
    "How many visa applications were processed?": ([], "no_match"), "In 2015, Visa Inc. reported net revenue growth.": (["V"], None), "Apple prices rose 12%": ([], "no_match"), "Did the price of Apple rise?": (["AAPL"], None),
    "american": ([], "no_match"), "under armour sales": (["UA", "UAA"], None), "what was aapl's revenue": (["AAPL"], None), "BRK.B and BRK-A": (["BRK"], None), "BRKB": (["BRK"], None), "Entergy Mississippi, Inc.": (["ETR"], None),
    "American Airlines Group versus American Tower": (["AAL", "AMT"], None), "AAL, AMT, AWK and ETR": ([], "too_many"), "in Aon's leased properties": (["AON"], None), "": ([], "no_match"), None: ([], "no_match"),
}
STRIPPED = {
    "What was the total revenue of Entergy Corporation in 2015, as reported in the 2015 Form 10-K?": "What was the total revenue in 2015?", "According to the filing, what were total net sales for Apple's stores?": "what were total net sales stores?", "Entergy revenue 2015": "Entergy revenue 2015", None: None,
    "Did the Entergy Holdings, Inc. and its subsidiaries pay more interest than before?": "Did pay more interest than before?", "What did Entergyland and Visax pay for the year 2015?": "What did Entergyland and Visax pay for the year 2015?",
}


@pytest.mark.parametrize("most", [0, 500_000])
def test_resolve_and_strip(spark, lexicon, most, monkeypatch):
    monkeypatch.setattr(resolve, "SENT_ROWS", most)
    questions = [*RESOLVED, *STRIPPED]
    rows = resolve.resolved(spark.createDataFrame(list(enumerate(questions)), "query_id long, question string"), lexicon).collect()
    got = {r.query_id: r for r in rows}
    assert len(got) == len(rows) == len(questions)
    assert {q: (got[i].tickers, got[i].reason) for i, q in enumerate(RESOLVED)} == RESOLVED
    assert {q: got[len(RESOLVED) + i].stripped for i, q in enumerate(STRIPPED)} == STRIPPED


def test_alias_candidates_equal_containment(spark, lexicon):
    asked = spark.createDataFrame([(1, "visa and under armour, inc."), (2, None), (3, "entergy entergy")], "query_id long, question string")
    got = {(r.query_id, r.alias) for r in resolve.alias_candidates(asked, lexicon.aliases).collect()}
    every = [r.alias for r in lexicon.aliases.collect()]
    assert got == {(q, a) for q, t in ((1, " visa and under armour inc "), (3, " entergy entergy ")) for a in every if f" {a} " in t}


def test_gap_clusters(spark):
    m = spark.createDataFrame([("f", p) for p in (1, 2, 5, 9, 20)] + [("g", 3)], "group string, pos int")
    assert {(r["group"], r.pos, r.cluster) for r in gold.gap_clusters(m).collect()} == {("f", 1, 0), ("f", 2, 0), ("f", 5, 0), ("f", 9, 1), ("f", 20, 2), ("g", 3, 0)}


def test_upper_bound_of_frequency(spark):
    c = spark.createDataFrame([("f", i, "value 123 and 123 and 456" if i < 6 else "456") for i in range(7)], "filing_stem string, chunk_index int, text string")
    assert {(r.num, r.df) for r in gold.number_frequency(c, 6).collect()} == {("123", 6)}
    assert c.select(F.count("text")).first()[0] == 7
