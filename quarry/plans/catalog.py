"""Registered queries over the driver's tables. Each runs over its whole tables; searches take the requests whose id is
divisible by 50 as the query set, against all rows. The SQL they are compared with is in oracle.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry import model
from quarry.functions import text as tx
from quarry.lineage import cut, shared_path
from quarry.operators import ann, corpus, gold, metrics, resolve, retrieval
from quarry.plans import answer, evaluate
from quarry.plans.oracle import oracle_sql  # noqa: F401
from quarry.plans.retrieve import Engine
from quarry.sources import files

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def queries() -> dict:
    return dict(QUERIES)


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return model.served(t(spark, d, "chunks"))


def _asked(spark: SparkSession, d: str, filtered: bool = False) -> DataFrame:
    """The query set: (query_id, question, vector, tickers, years). Vectors are rows of the embeddings table, since no embedding model is at
    hand; tickers, where asked for, are those of the filings that the stored response cites."""
    asked = t(spark, d, "ask_requests").where("request_id % 50 = 0 AND question IS NOT NULL").select(F.col("request_id").alias("query_id"), "question").distinct()
    vectors = t(spark, d, "embeddings").select((F.col("vec_id") * 50).alias("query_id"), F.col("embedding").alias("vector"))
    out = asked.join(vectors, "query_id", "left").withColumn("years", tx.years(F.col("question")))
    if not filtered:
        return out.withColumn("tickers", F.array().cast("array<string>"))
    cited = t(spark, d, "ask_responses").where("request_id % 50 = 0").select(F.col("request_id").alias("query_id"), F.explode("citations").alias("c"))
    tickers = cited.groupBy("query_id").agg(F.array_sort(F.collect_set(F.split_part("c.filing_stem", F.lit("_"), F.lit(1)))).alias("tickers"))
    return out.join(tickers, "query_id", "left").withColumn("tickers", F.coalesce("tickers", F.array().cast("array<string>")))


def _place(df: DataFrame) -> DataFrame:
    return df.select("query_id", "filing_stem", "chunk_index", "score", "rank")


@query
def dense_topk(spark, d):
    return _place(retrieval.dense(_asked(spark, d), _chunks(spark, d)))


@query
def dense_topk_ticker(spark, d):
    return _place(retrieval.dense(_asked(spark, d, True), _chunks(spark, d)))


@query
def ann_topk(spark, d):
    """The ten nearest chunks of each question by an inverted file of vectors, built here and searched."""
    index = ann.VectorIndex.write(_chunks(spark, d), shared_path(spark, "vectors"))
    return _place(index.search(_asked(spark, d), 10))


@query
def bm25_topk(spark, d):
    return _place(retrieval.Bm25Index.build(_chunks(spark, d)).search(_asked(spark, d)))


@query
def bm25_topk_ticker(spark, d):
    return _place(retrieval.Bm25Index.build(_chunks(spark, d)).search(_asked(spark, d, True)))


def _two_lists(asked: DataFrame, chunks: DataFrame) -> list[DataFrame]:
    return [retrieval.dense(asked, chunks), retrieval.Bm25Index.build(chunks).search(asked)]


@query
def rrf_fuse(spark, d):
    asked, chunks = _asked(spark, d), _chunks(spark, d)
    return retrieval.fuse(_two_lists(asked, chunks), asked.withColumn("years", F.array().cast("array<int>")))


@query
def rrf_fuse_years(spark, d):
    asked, chunks = _asked(spark, d), _chunks(spark, d)
    return retrieval.fuse(_two_lists(asked, chunks), asked)


@query
def year_text_list(spark, d):
    asked, chunks = _asked(spark, d), _chunks(spark, d)
    return retrieval.year_text(cut(retrieval.fuse(_two_lists(asked, chunks), asked)), chunks, asked)  # read twice: both searches run once


@query
def first_stage(spark, d):
    chunks = _chunks(spark, d)
    return retrieval.first_stage(_asked(spark, d), chunks, retrieval.Bm25Index.build(chunks))


@query
def first_stage_ticker(spark, d):
    chunks = _chunks(spark, d)
    return retrieval.first_stage(_asked(spark, d, True), chunks, retrieval.Bm25Index.build(chunks))


@query
def chunk_text_fetch(spark, d):
    """Texts of all cited pairs, keyed by the pair."""
    pairs = t(spark, d, "ask_responses").select(F.explode("citations").alias("c")).select("c.filing_stem", "c.chunk_index").distinct()
    return retrieval.texts(pairs, _chunks(spark, d)).select("filing_stem", "chunk_index", "text")


@query
def rerank_topk(spark, d):
    asked, chunks = _asked(spark, d), _chunks(spark, d)
    pool = retrieval.texts(retrieval.Bm25Index.build(chunks).search(asked, model.POOL), chunks)
    return _place(retrieval.rerank(pool, asked))


@query
def year_extract(spark, d):
    return t(spark, d, "chunks").select("id", tx.years(F.col("text")).alias("years")).where(F.size("years") > 0).select("id", F.explode("years").alias("year"))


@query
def year_bonus(spark, d):
    """Bonus of each cited filing for the years of its question."""
    r = t(spark, d, "ask_responses").select("request_id", tx.years(F.col("question")).alias("years"), F.explode("citations").alias("c"))
    year = F.split_part("c.filing_stem", F.lit("_"), F.lit(2)).try_cast("int")
    return r.select("request_id", F.col("c.filing_stem").alias("filing_stem"), F.round(tx.year_bonus(year, F.col("years")), 9).alias("bonus")).distinct()


@query
def preflight(spark, d):
    return corpus.preflight(t(spark, d, "chunks"), {"A": 99654})


@query
def ingest_stats(spark, d):
    return corpus.filing_stats(t(spark, d, "chunks"))


@query
def block_stats(spark, d):
    return corpus.block_stats(t(spark, d, "atoms").distinct())


@query
def status_histogram(spark, d):
    return t(spark, d, "ingest_log").distinct().groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("fetch_s"), 9).alias("fetch_s"), F.round(F.avg("parse_s"), 9).alias("parse_s"))


@query
def retrieval_seconds(spark, d):
    """Mean seconds of answers and of their stages."""
    r = t(spark, d, "ask_responses").select("request_id", "latency_s", "stage_latency")
    whole = r.agg(F.lit("total").alias("stage"), F.round(F.avg("latency_s"), 6).alias("mean_s"), F.count("latency_s").alias("n"))
    stages = r.select(F.explode("stage_latency").alias("stage", "s")).groupBy("stage").agg(F.round(F.avg("s"), 6).alias("mean_s"), F.count("s").alias("n"))
    return whole.unionByName(stages)


def _gold_of_citations(spark, d) -> DataFrame:
    """Gold lists of the query set: the distinct pairs that the stored responses cite."""
    c = t(spark, d, "ask_responses").where("request_id % 50 = 0").select(F.col("request_id").alias("query_id"), F.explode_outer("citations").alias("c"))
    key = F.when(F.col("c").isNotNull(), F.concat_ws("#", "c.filing_stem", F.col("c.chunk_index").cast("string")))
    return c.groupBy("query_id").agg(F.array_sort(F.collect_set(key)).alias("relevant"))


def _key() -> F.Column:
    return F.concat_ws("#", "filing_stem", F.col("chunk_index").cast("string"))


@query
def recall_ndcg_mrr(spark, d):
    ranked = metrics.as_lists(dense_topk_ticker(spark, d), _key())
    s = metrics.scored(ranked, _gold_of_citations(spark, d))
    return s.select("query_id", "missing", "no_gold", *(F.round(m, 9).alias(m) for m in ("recall_10", "recall_50", "ndcg_10", "mrr")))


@query
def score_report(spark, d):
    return evaluate.replay(dense_topk_ticker(spark, d), _gold_of_citations(spark, d))


@query
def load_ranking(spark, d):
    """Stored citations written as score lines of one cell and read back."""
    r = t(spark, d, "ask_responses").select("request_id", "citations").distinct()
    entry = F.transform("citations", lambda c: F.array(c["filing_stem"], c["chunk_index"].cast("string"), c["score"].cast("string")))
    line = F.to_json(F.struct(F.col("request_id").cast("string").alias("id"), F.lit("dev").alias("split"), F.create_map(F.lit("base"), entry).alias("cells")))
    lines = r.select(line.alias("value"), F.col("request_id").alias("line_no"))
    return files.ranking(lines, "base")


@query
def split_assign(spark, d):
    return corpus.assign_splits(t(spark, d, "questions")).select("id", "context_id", "split").distinct()


@query
def rows_per_document(spark, d):
    return t(spark, d, "questions").groupBy("context_id").agg(F.count(F.lit(1)).alias("n"))


@query
def union_subsets(spark, d):
    """The subsets read one by one and put together by name, with their row counts by tidied split."""
    q = t(spark, d, "questions")
    out = None
    for s in files.SUBSETS:
        one = q.where(F.col("subset_source") == s).drop("subset_source").withColumn("subset_source", F.lit(s))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out.groupBy("subset_source", F.lower(F.trim("split")).alias("split")).agg(F.count(F.lit(1)).alias("n"))


def _stems(spark, d) -> DataFrame:
    return t(spark, d, "ingest_log").where("status = 'ok'").select(F.col("stem").alias("filing_stem"))


@query
def matched_questions(spark, d):
    return corpus.matched_questions(t(spark, d, "questions"), t(spark, d, "chunks").select("filing_stem")).select("id", "filing_stem", "subset_source").distinct()


@query
def targets(spark, d):
    return corpus.targets(t(spark, d, "questions"))


@query
def file_index(spark, d):
    return files.file_index(t(spark, d, "ingest_log").select(F.concat("stem", F.lit(".json")).alias("name")))


@query
def unindexed_filings(spark, d):
    """Fetched filings that have no parsed piece yet."""
    return corpus.not_loaded(t(spark, d, "ingest_log").where("stem IS NOT NULL").select(F.col("stem").alias("filing_stem")).distinct(), t(spark, d, "atoms"))


@query
def variant_filter(spark, d):
    """The served rows: the latest of each key of variant A."""
    return _chunks(spark, d).select("id", "filing_stem", "chunk_index", "ticker", "fiscal_year", "cik")


def _titles(spark, d) -> DataFrame:
    return t(spark, d, "atoms").where("is_title").select("filing_stem", "atom_id", "text").distinct()


@query
def running_headers(spark, d):
    """Headings of chunks stand for titles here: they repeat."""
    return corpus.running_headers(t(spark, d, "chunks").where("heading IS NOT NULL").select("filing_stem", F.col("heading").alias("text")))


@query
def furniture_titles(spark, d):
    return corpus.furniture(_titles(spark, d)).select("filing_stem", "atom_id", "is_furniture")


@query
def normalize_words(spark, d):
    w = tx.words(F.col("text"))
    return t(spark, d, "chunks").where("text IS NOT NULL").select("id", F.size(w).alias("n_words"), F.size(F.array_distinct(w)).alias("n_distinct"), F.md5(F.array_join(w, " ")).alias("words_md5"))


@query
def numeric_tokens(spark, d):
    return t(spark, d, "chunks").select("id", F.explode(tx.numeric_tokens(tx.words(F.col("text")))).alias("num"))


@query
def num_doc_freq(spark, d):
    return gold.number_frequency(_chunks(spark, d), gold.MAX_DOC_FREQ)


@query
def gap_clusters(spark, d):
    """Chunks of a filing that speak of goodwill, clustered by distance."""
    m = _chunks(spark, d).where(F.lower("text").contains("goodwill")).select(F.col("filing_stem").alias("group"), F.col("chunk_index").alias("pos"))
    return gold.gap_clusters(m).groupBy("group", "cluster").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count(F.lit(1)).alias("n"))


def _gold_questions(spark, d) -> DataFrame:
    """A question for each chunk, since few listed questions meet a filing of the test tables: its gold rows, texts and summary
    are the chunk's own table rows, paragraphs and heading, to be found among all chunks of the filing."""
    return _chunks(spark, d).select(F.concat_ws("#", F.lit("q"), "filing_stem", F.col("chunk_index").cast("string")).alias("question_id"), "filing_stem", "chunk_index", "heading", "text")


def _gold_rows(spark, d) -> DataFrame:
    """Gold rows: every body row of the chunks' table stretches, numbered by line."""
    q = _gold_questions(spark, d).select("question_id", "filing_stem", F.posexplode(F.filter(F.split("text", "\n"), lambda x: x.contains(" | "))).alias("row_no", "line")).where("row_no > 0")
    return q.select("question_id", "row_no", "filing_stem", F.split("line", r" \| ").alias("cells"))


@query
def row_cover(spark, d):
    return gold.row_chunks(_gold_rows(spark, d), _chunks(spark, d))


def _gold_texts(spark, d) -> DataFrame:
    """Gold texts: every line of 60 to 2000 characters of the chunks that is no table row."""
    q = _gold_questions(spark, d).select("question_id", "filing_stem", F.posexplode(F.split("text", "\n")).alias("text_no", "gold"))
    return q.where(F.length("gold").between(60, 2000) & ~F.col("gold").contains(" | "))


@query
def gold_align(spark, d):
    return gold.aligned_chunks(_gold_texts(spark, d), _chunks(spark, d), gold.MIN_SENTENCE)


def _summary_parts(spark, d):
    """The heading of each chunk stands for the summary of a table of that number."""
    q = _gold_questions(spark, d)
    summaries = q.where("heading IS NOT NULL").select("filing_stem", F.col("chunk_index").alias("table_index"), F.col("heading").alias("summary"))
    return q.select("question_id", F.col("chunk_index").alias("table_index")), summaries, q.select("question_id", "filing_stem")


@query
def summary_match(spark, d):
    return gold.summary_chunks(*_summary_parts(spark, d), _chunks(spark, d))


@query
def gold_layers(spark, d):
    chunks = _chunks(spark, d)
    rows = gold.row_chunks(_gold_rows(spark, d), chunks).select("question_id", "chunk_index")
    sentences = gold.aligned_chunks(_gold_texts(spark, d), chunks, gold.MIN_SENTENCE)
    pages = gold.aligned_chunks(_gold_texts(spark, d), chunks, gold.MIN_PAGE)
    return gold.layered(rows, sentences, pages, gold.summary_chunks(*_summary_parts(spark, d), chunks))


@query
def label_diff(spark, d):
    """Two label tables of overlapping subsets: before and after the split names were tidied."""
    q = t(spark, d, "questions").where("id IS NOT NULL").groupBy("id").agg(F.min("split").alias("s"), F.min("subset_source").alias("subset"))
    tidy = F.lower(F.trim("s")).alias("split")
    old = q.where("subset IN ('FinQA', 'ConvFinQA')").select(tidy, "id", F.col("s").alias("row_key"), F.array(F.length("s")).alias("gold"))
    new = q.where("subset IN ('ConvFinQA', 'TAT-DQA')").select(tidy, "id", F.lower("s").alias("row_key"), F.array(F.length(F.trim("s"))).alias("gold"))
    return gold.label_diff(old, new)


@query
def label_row_key(spark, d):
    q = t(spark, d, "questions").where("id IS NOT NULL").select("id", "context_id", "context").distinct()
    return q.select("id", "context_id", tx.label_row_key(F.col("id"), F.col("context_id"), F.col("context")).alias("row_key"))


@query
def company_normalize(spark, d):
    c = t(spark, d, "companies")
    return c.select("company_cik", tx.company_normal(F.col("company_name")).alias("normal"), tx.strip_legal(F.trim(tx.company_normal(F.col("company_name")))).alias("bare"))


def _lexicon(spark, d) -> DataFrame:
    return resolve.build_lexicon(t(spark, d, "companies"))


@query
def lexicon_build(spark, d):
    return _lexicon(spark, d).select("alias", F.array_join("tickers", ",").alias("tickers"))


@query
def alias_candidates(spark, d):
    asked = t(spark, d, "ask_requests").select(F.col("request_id").alias("query_id"), "question").distinct()
    return resolve.alias_candidates(asked, _lexicon(spark, d)).select("query_id", "alias", F.array_join("tickers", ",").alias("tickers"))


def _words(spark, d) -> DataFrame:
    """English words for the guard: the words of documents tagged en that occur in 20 of them or more."""
    w = t(spark, d, "documents").where("lang = 'en' AND text IS NOT NULL").select("doc_id", F.explode(F.array_distinct(tx.terms(F.col("text")))).alias("word"))
    return w.where(F.col("word").rlike("^[a-z]+$")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 20").select("word")


def _loaded(spark, d) -> resolve.Lexicon:
    c = t(spark, d, "companies")
    return resolve.load(_lexicon(spark, d), c.select(F.col("company_symbol").alias("ticker")), _words(spark, d))


@query
def resolve_tickers(spark, d):
    asked = t(spark, d, "ask_requests").select(F.col("request_id").alias("query_id"), "question").distinct()
    return resolve.resolved(asked, _loaded(spark, d)).select("query_id", F.array_join("tickers", ",").alias("tickers"), "reason")


@query
def strip_framing(spark, d):
    asked = t(spark, d, "ask_requests").where("question IS NOT NULL").select(F.col("request_id").alias("query_id"), F.concat("question", F.lit(", as reported in the 2014 Form 10-K")).alias("question")).distinct()
    return resolve.resolved(asked, _loaded(spark, d)).select("query_id", "stripped")


@query
def ticker_forms(spark, d):
    s = t(spark, d, "companies").where("company_symbol IS NOT NULL").select("company_symbol").distinct()
    written = s.select(F.explode(F.array("company_symbol", F.concat("company_symbol", F.lit(".B")), F.concat("company_symbol", F.lit("-A")))).alias("written"))
    return written.select("written", F.array_join(tx.ticker_forms(F.col("written")), ",").alias("forms"))


@query
def stem_parts(spark, d):
    return model.with_stem_parts(t(spark, d, "ingest_log").select(F.col("stem").alias("filing_stem")).distinct())


@query
def document_url(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey")
    accession = F.concat_ws("-", F.lpad(F.col("o_custkey").cast("string"), 10, "0"), F.lit("24"), F.lpad(F.col("o_orderkey").cast("string"), 6, "0"))
    return o.select("o_orderkey", tx.document_url(F.col("o_custkey"), accession, F.lit("main.htm")).alias("url"), tx.submissions_name(F.col("o_custkey")).alias("page"))


@query
def edgar_match(spark, d):
    """Orders as filings: the status gives the form, the order date the report date, the customer the filer."""
    o = t(spark, d, "orders").select(
        F.col("o_custkey").alias("company_cik"),
        F.struct(
            F.when(F.col("o_orderstatus") == "F", "10-K").when(F.col("o_orderstatus") == "O", "10-K405").otherwise("10-K/A").alias("form"),
            F.date_format(F.date_add("o_orderdate", 60), "yyyy-MM-dd").alias("filingDate"),
            F.col("o_orderkey").cast("string").alias("accessionNumber"),
            F.concat(F.lit("d"), F.col("o_orderkey").cast("string"), F.lit(".htm")).alias("primaryDocument"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("reportDate"),
        ).alias("x"),
        "o_orderkey",
    )
    page = (F.col("o_orderkey") % 2).cast("int").alias("page")
    lists = o.groupBy("company_cik", page).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "x"))).alias("xs"))
    column = lambda n: F.transform("xs", lambda v: v["x"][n]).alias(n)
    recent = F.struct(*map(column, ("form", "filingDate", "accessionNumber", "primaryDocument", "reportDate")))
    pages = lists.select("company_cik", "page", recent.alias("recent"))
    wanted = t(spark, d, "orders").select(F.col("o_custkey").alias("company_cik"), F.year("o_orderdate").alias("fiscal_year")).distinct()
    return files.annual_reports(pages, wanted)


@query
def parse_answer(spark, d):
    r = t(spark, d, "ask_responses").select("request_id", "answer").distinct()
    return r.withColumn("p", tx.parse_answer(F.col("answer"))).select("request_id", F.col("p.value").alias("value"), F.col("p.status").alias("status"))


@query
def answer_headline(spark, d):
    return t(spark, d, "ask_responses").where("answer IS NOT NULL").select("request_id", tx.answer_headline(F.col("answer")).alias("headline")).distinct()


def _results(spark, d) -> DataFrame:
    """Cited pairs of all responses as results, with texts."""
    r = t(spark, d, "ask_responses").select("request_id", "citations").distinct()
    c = r.select(F.col("request_id").alias("query_id"), F.posexplode("citations").alias("pos", "c")).select("query_id", (F.col("pos") + 1).alias("rank"), "c.filing_stem", "c.chunk_index", "c.score")
    return retrieval.texts(c, _chunks(spark, d))


@query
def evidence_text(spark, d):
    return answer.evidence(_results(spark, d)).select("query_id", F.md5("evidence").alias("evidence_md5"), F.length("evidence").alias("n_chars"))


@query
def prompts(spark, d):
    e = answer.evidence(_results(spark, d))
    asked = t(spark, d, "ask_requests").where("question IS NOT NULL").select(F.col("request_id").alias("query_id"), "question").distinct()
    p = asked.join(e, "query_id").select("query_id", answer.prompt(F.col("question"), F.col("evidence")).alias("prompt"))
    return p.select("query_id", F.md5("prompt").alias("prompt_md5"), F.length("prompt").alias("n_chars"))


@query
def citation_texts(spark, d):
    """Citations of all responses, with texts only where the request asked for them."""
    asked = t(spark, d, "ask_requests").groupBy(F.col("request_id").alias("query_id")).agg(F.max("include_text").alias("wants"))
    rows = _results(spark, d).join(asked, "query_id")
    return answer.citations(rows, F.col("wants")).select("query_id", F.posexplode("citations").alias("pos", "c")).select("query_id", "pos", "c.filing_stem", "c.chunk_index", "c.text")


@query
def request_validation(spark, d):
    return answer.valid_requests(t(spark, d, "ask_requests")).select("request_id", "k", "include_text", "valid").distinct()


@query
def cited_value(spark, d):
    return answer.cited_value(t(spark, d, "ask_responses"), _chunks(spark, d))


@query
def sse_frames(spark, d):
    r = t(spark, d, "ask_responses").select("request_id", "value_status").distinct()
    return r.select("request_id", tx.sse(F.lit("answer"), F.struct("request_id", F.coalesce("value_status", F.lit("empty")).alias("value_status"))).alias("frame"))


@query
def table_clean(spark, d):
    """Rows of table atoms as cells, with signs and brackets split off and joined again, as filings have them."""
    a = t(spark, d, "atoms").where("is_table AND text IS NOT NULL").select("atom_id", "text").distinct()
    rows = a.select("atom_id", F.posexplode(F.split("text", "\n")).alias("row_no", "line")).where(F.col("line").contains(" | "))
    return rows.select("atom_id", "row_no", F.array_join(tx.clean_row(_torn(F.col("line"))), "|").alias("cells"))


def _torn(line: F.Column) -> F.Column:
    """Cells of a table line, with closing brackets in cells of their own, as filings have them."""
    return F.flatten(F.transform(F.split(line, r" \| "), lambda c: F.when(c.rlike(r"^\([\d,.]+\)$"), F.array(F.regexp_replace(c, r"\)$", ""), F.lit(")"), F.lit(" "))).otherwise(F.array(c))))


@query
def table_text(spark, d):
    """Table atoms as rows of torn cells, cleaned and written as text again."""
    a = t(spark, d, "atoms").where("is_table AND text IS NOT NULL").select("atom_id", "text").distinct()
    return a.select("atom_id", F.md5(tx.table_text(F.transform(F.split("text", "\n"), lambda r: tx.clean_row(_torn(r))))).alias("text_md5"))


@query
def chunk_pack(spark, d):
    a = t(spark, d, "atoms").select("filing_stem", "atom_index", "text", "tokens", "is_title", "is_table", "is_furniture").distinct()
    return corpus.pack_chunks(a)


@query
def atomise(spark, d):
    """Atoms of blocks made from the atom table: table texts as rows again."""
    a = t(spark, d, "atoms").select("filing_stem", "atom_id", "atom_index", "text", "is_title", "is_table").distinct()
    rows = F.when(F.col("is_table"), F.transform(F.split("text", "\n"), lambda r: F.split(r, r" \| ")))
    blocks = a.select("filing_stem", F.col("atom_id").alias("block_index"), F.when(~F.coalesce("is_table", F.lit(False)), F.col("text")).alias("text"), F.col("is_title"), rows.alias("rows"))
    return corpus.atoms(blocks)


@query
def carried_heading(spark, d):
    return corpus.carried_heading(t(spark, d, "atoms").select("filing_stem", "atom_id", "atom_index", "text", "is_title", "is_furniture").distinct())


@query
def next_text_tokens(spark, d):
    return corpus.next_text_tokens(t(spark, d, "atoms").select("filing_stem", "atom_id", "atom_index", "tokens", "is_title", "is_table").distinct())


@query
def ordered_headings(spark, d):
    """Headings of a filing in first-seen order."""
    c = _chunks(spark, d).where("heading IS NOT NULL").groupBy("filing_stem").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "heading"))).alias("h"))
    return c.select("filing_stem", F.array_join(F.array_distinct(F.transform("h", lambda x: x["heading"])), " > ").alias("headings"))


@query
def unit_vectors(spark, d):
    """Length of each usable vector after normalisation, and its largest part."""
    c = t(spark, d, "chunks").where(retrieval.usable(F.col("embedding"), 64)).select("id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return c.select("id", F.round(norm, 6).alias("norm"), F.round(F.array_max("v") / norm, 6).alias("largest"))


def _engine(spark, d) -> Engine:
    chunks = _chunks(spark, d)
    vectors = t(spark, d, "embeddings").select((F.col("vec_id") * 50).alias("query_id"), F.col("embedding").alias("vector"))
    return Engine(chunks, retrieval.Bm25Index.build(chunks), _loaded(spark, d), lambda q: q.join(vectors, "query_id"))


@query
def retrieve(spark, d):
    """From question to ten chunks: resolve, strip, embed, search, rerank."""
    return _place(_engine(spark, d).retrieve(_asked(spark, d).select("query_id", "question")))


@query
def live_report(spark, d):
    return evaluate.live(_engine(spark, d), _asked(spark, d).select("query_id", "question"), _gold_of_citations(spark, d))


@query
def late_requests(spark, d):
    """Requests that came more than a minute after they were asked, by hour."""
    r = t(spark, d, "ask_requests").distinct()
    late = F.unix_micros("received_at") - F.unix_micros("asked_at") > 60_000_000
    return r.groupBy(F.date_trunc("hour", "asked_at").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.count_if(late).alias("n_late"))


@query
def request_sequence(spark, d):
    """Each client's requests numbered in time, with the seconds since the one before."""
    w = Window.partitionBy("client_id").orderBy("asked_at", "request_id")
    r = t(spark, d, "ask_requests").select("client_id", "request_id", "asked_at").distinct()
    gap = (F.unix_micros("asked_at") - F.unix_micros(F.lag("asked_at").over(w))) / 1e6
    return r.select("client_id", "request_id", F.row_number().over(w).alias("nth"), F.round(gap, 3).alias("gap_s"))
