"""Readers of the file forms: question lists, chunk and block files, scores, lexicons, word lists, evidence, filings."""

from __future__ import annotations

import os
import re
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException
from pyspark.sql.window import Window

from quarry.model import BLOCKS, CHUNK_FILE, EVIDENCE, INGEST_LOG, QUESTIONS, SCORES, SUBMISSION_PAGE, SUBMISSIONS, filing_stem  # noqa: F401

WORDS_VARIABLE = "QUARRY_WORDS"
SUBSETS = ("ConvFinQA", "FinQA", "TAT-DQA")


def exists(spark: SparkSession, pattern: str) -> bool:
    """Whether any file matches, on whatever file system the path names."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def questions(spark: SparkSession, root: str, subset: str = "all") -> DataFrame:
    """Question lists under root/SUBSET, one JSON object a line, tagged with subset_source."""
    if subset != "all" and subset not in SUBSETS:
        raise ValueError(f"unknown subset {subset!r}; one of {', '.join(SUBSETS)} or all")
    out = None
    for s in SUBSETS if subset == "all" else (subset,):
        one = spark.read.schema(QUESTIONS).option("recursiveFileLookup", True).json(f"{root}/{s}").withColumn("subset_source", F.lit(s))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def corpus_present(spark: SparkSession, folder: str) -> bool:
    """A folder with at least one chunk file; an empty folder is no corpus."""
    return exists(spark, f"{folder}/*.json")


def _fields(schema: str) -> str:
    """A flat DDL schema as the inside of a struct type."""
    return re.sub(r"(^|, )(\w+) ", r"\1\2:", schema)


def _stem() -> F.Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)


def _array_files(spark: SparkSession, folder: str, schema: str, index: str) -> DataFrame:
    """Files of one JSON array each, one row per element, with its position."""
    text = spark.read.text(f"{folder}/*.json", wholetext=True).withColumn("filing_stem", _stem())
    listed = F.from_json("value", f"array<struct<{_fields(schema)}>>")
    return text.select("filing_stem", F.posexplode(listed).alias(index, "x")).select("filing_stem", index, "x.*")


def chunk_files(spark: SparkSession, folder: str) -> DataFrame:
    return _array_files(spark, folder, CHUNK_FILE, "chunk_index")


def block_files(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed blocks; a block with rows is a table."""
    return _array_files(spark, folder, BLOCKS, "block_index").withColumn("kind", F.when(F.col("rows").isNotNull(), "table").otherwise("text"))


def file_index(names: DataFrame, column: str = "name") -> DataFrame:
    """(company_cik, report_year, filing_stem) of file names TICKER_YEAR_CIK.json; other names are skipped, and of several files of a
    (cik, year) the last by name counts."""
    part = lambda n: F.regexp_extract(column, r"^(.+)_([0-9]+)_([0-9]+)\.json$", n)
    rows = names.where(part(1) != "").select(part(3).cast("long").alias("company_cik"), part(2).cast("int").alias("report_year"), F.regexp_replace(column, r"\.json$", "").alias("filing_stem"))
    return rows.groupBy("company_cik", "report_year").agg(F.max("filing_stem").alias("filing_stem"))


def ranking(lines: DataFrame, cell: str) -> DataFrame:
    """(id, filing_stem, chunk_index, score, rank) of one cell of score lines (value, line_no): sorted by score, the stored order on ties; of a
    repeated id the last line counts. A line without cells or the cell, or an entry not three wide, is an error."""
    rec = lines.where(F.length(F.trim("value")) > 0).select("line_no", F.from_json("value", SCORES).alias("r")).select("line_no", "r.*")
    width = F.coalesce(F.forall(F.col("cells")[cell], lambda e: F.size(e) == 3), F.lit(True))
    problem = F.when(F.col("cells").isNull(), F.concat(F.lit("record has no cells: "), F.coalesce("id", F.lit("?")))).when(F.col("cells")[cell].isNull(), F.concat(F.lit(f"no cell {cell}: "), F.coalesce("id", F.lit("?")))).when(~width, F.concat(F.lit("entry is not three wide: "), F.coalesce("id", F.lit("?"))))
    entries = F.when(problem.isNotNull(), F.raise_error(problem).cast("array<array<string>>")).otherwise(F.col("cells")[cell])
    last = rec.groupBy("id").agg(F.max_by(F.struct(entries.alias("e")), "line_no").alias("m"))
    rows = last.select("id", F.posexplode("m.e").alias("pos", "e")).select("id", F.col("e")[0].alias("filing_stem"), F.col("e")[1].cast("int").alias("chunk_index"), F.col("e")[2].cast("double").alias("score"), "pos")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "pos"))).drop("pos")


def score_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumn("line_no", F.struct(F.col("_metadata.file_name"), F.monotonically_increasing_id()))


def lexicon(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((alias, tickers), (ticker)) of a lexicon file."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "aliases map<string,array<string>>, tickers array<string>").alias("r"))
    return raw.select(F.explode("r.aliases").alias("alias", "tickers")).withColumn("tickers", F.array_sort("tickers")), raw.select(F.explode("r.tickers").alias("ticker"))


def word_list(spark: SparkSession, candidates: list[str]) -> DataFrame:
    """(word) of the first list that exists, that of WORDS_VARIABLE in the environment before all; none gives an empty table, with a
    warning, since it switches the guard on English words off."""
    for path in [os.environ.get(WORDS_VARIABLE), *candidates]:
        if path and exists(spark, path):
            return spark.read.text(path).select(F.lower(F.trim("value")).alias("word"))
    warnings.warn("no list of English words: names that are words are not guarded", stacklevel=2)
    return spark.createDataFrame([], "word string")


def evidence(spark: SparkSession, path: str) -> DataFrame:
    """(question_id, table_rows, sentences); a missing file gives no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], "question_id string, table_rows array<array<string>>, sentences array<string>")
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", f"map<string,struct<{_fields(EVIDENCE)}>>")).alias("question_id", "e")).select("question_id", "e.*")


def gold_tables(spark: SparkSession, path: str) -> DataFrame:
    """(question_id, table_index), distinct; a missing file gives no rows."""
    schema = "question_id string, table_index int"
    return spark.read.option("multiLine", True).schema(schema).json(path).distinct() if exists(spark, path) else spark.createDataFrame([], schema)


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """(filing_stem, table_index, summary) of keys stem:table; a missing file gives no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], "filing_stem string, table_index int, summary string")
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "summary"))
    return raw.select(F.regexp_extract("k", r"^(.*):(\d+)$", 1).alias("filing_stem"), F.regexp_extract("k", r"^(.*):(\d+)$", 2).cast("int").alias("table_index"), "summary")


def ingest_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INGEST_LOG).json(path)


def raw_filings(spark: SparkSession, folder: str) -> DataFrame:
    """(filing_stem, html); bytes that are no UTF-8 become replacement characters."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.htm*").load(folder)
    return raw.select(F.regexp_extract("path", r"([^/]+)\.html?$", 1).alias("filing_stem"), F.make_valid_utf8(F.col("content").cast("string")).alias("html"))


def submissions(spark: SparkSession, folder: str) -> DataFrame:
    """(company_cik, page, recent): submission files CIK##########.json (page 0) and their older pages (page 1 and on, in their listed order)."""
    text = spark.read.text(f"{folder}/*.json", wholetext=True).withColumn("name", F.col("_metadata.file_name"))
    main = text.where(F.col("name").rlike(r"^CIK\d+\.json$")).select(F.regexp_extract("name", r"^CIK0*(\d+)\.json$", 1).cast("long").alias("company_cik"), F.from_json("value", SUBMISSIONS).alias("r"))
    older = main.select("company_cik", F.posexplode("r.filings.files").alias("at", "f")).select("company_cik", (F.col("at") + 1).alias("page"), F.col("f.name").alias("name"))
    pages = older.join(text.select("name", F.from_json("value", SUBMISSION_PAGE).alias("recent")), "name").select("company_cik", "page", "recent")
    return main.select("company_cik", F.lit(0).alias("page"), F.col("r.filings.recent").alias("recent")).unionByName(pages)


def annual_reports(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """(company_cik, fiscal_year, accession_number, primary_document, filing_date): the first filing of form 10-K, and no other form, whose report date lies in the
    wanted year (company_cik, fiscal_year), in the order of the pages and of the rows in a page."""
    zipped = F.arrays_zip("recent.form", "recent.filingDate", "recent.accessionNumber", "recent.primaryDocument", "recent.reportDate")
    rows = pages.select("company_cik", "page", F.posexplode(zipped).alias("pos", "x")).select("company_cik", "page", "pos", "x.*")
    rows = rows.where("form = '10-K'").withColumn("fiscal_year", F.left("reportDate", F.lit(4)).try_cast("int"))
    first = Window.partitionBy("company_cik", "fiscal_year").orderBy("page", "pos")
    hits = rows.join(wanted.select("company_cik", "fiscal_year").distinct(), ["company_cik", "fiscal_year"]).withColumn("n", F.row_number().over(first)).where("n = 1")
    return hits.select("company_cik", "fiscal_year", F.col("accessionNumber").alias("accession_number"), F.col("primaryDocument").alias("primary_document"), F.col("filingDate").alias("filing_date"))


def table_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)

