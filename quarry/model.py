"""Schemas of the data model, as DDL, and the keys derived from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.lineage import sent_if_small

CHUNKS = "filing_stem STRING NOT NULL, chunk_index INT NOT NULL, heading STRING, n_tokens INT, text STRING NOT NULL, embedding ARRAY<FLOAT>, variant STRING NOT NULL"
CHUNK_FILE = "text STRING, n_tokens INT, heading STRING"
BLOCKS = "text STRING, is_title BOOLEAN, rows ARRAY<ARRAY<STRING>>"
QUESTIONS = "id STRING, question STRING, context STRING, context_id STRING, split STRING, company_name STRING, company_symbol STRING, company_cik BIGINT, report_year INT, subset_source STRING"
SCORES = "id STRING, split STRING, cells MAP<STRING, ARRAY<ARRAY<STRING>>>"
INGEST_LOG = "stem STRING, cik BIGINT, year INT, status STRING, raw_bytes BIGINT, fetch_s DOUBLE, parse_s DOUBLE, chunk_s DOUBLE, n_blocks INT, n_tables INT, n_chunks INT, median_tokens INT, max_tokens INT, error STRING, traceback STRING"
SUBMISSION_PAGE = "form ARRAY<STRING>, filingDate ARRAY<STRING>, accessionNumber ARRAY<STRING>, primaryDocument ARRAY<STRING>, reportDate ARRAY<STRING>"
SUBMISSIONS = "filings STRUCT<recent: STRUCT<form: ARRAY<STRING>, filingDate: ARRAY<STRING>, accessionNumber: ARRAY<STRING>, primaryDocument: ARRAY<STRING>, reportDate: ARRAY<STRING>>, files: ARRAY<STRUCT<name: STRING>>>"
EVIDENCE = "table_rows ARRAY<ARRAY<STRING>>, sentences ARRAY<STRING>"
ANSWER = "struct<value:double,status:string>"

#: Retrieval depths, fusion and filter constants (fixed values).
POOL, READ_DEPTH, RRF_K, YEAR_BIAS, VARIANT, TOP_K, MAX_K = 50, 200, 60, 0.01, "A", 10, 50

#: Ids of replaced rows that are broadcast, at most (16 MB).
SENT_IDS = 2_000_000


def stem_parts(stem: Column) -> dict[str, Column]:
    """ticker, fiscal_year and cik of a TICKER_YEAR_CIK key; malformed parts are null."""
    part = lambda n: F.split_part(stem, F.lit("_"), F.lit(n))
    return {"ticker": part(1), "fiscal_year": part(2).try_cast("int"), "cik": part(3).try_cast("long")}


def with_stem_parts(df: DataFrame) -> DataFrame:
    return df.withColumns(stem_parts(F.col("filing_stem")))


def filing_stem(symbol: Column, year: Column, cik: Column) -> Column:
    return F.concat_ws("_", symbol, year.cast("int").cast("string"), cik.cast("long").cast("string"))


def current(chunks: DataFrame) -> DataFrame:
    """One row per (filing_stem, chunk_index, variant): the one loaded last, the larger id on a tie. Replaced rows are found on
    narrow columns and taken out by id; they are few as a rule, and then texts and vectors are not shuffled."""
    keys = ["filing_stem", "chunk_index", "variant"]
    last = F.max_by("id", F.struct(F.col("ingested_at"), F.col("id"))).alias("last")
    many = chunks.groupBy(*keys).agg(last, F.count(F.lit(1)).alias("n")).where("n > 1").select(*(F.col(k).alias(f"{k}_") for k in keys), "last")
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    replaced = chunks.select(*keys, "id").join(many, same).where("id <> last").select("id")
    return chunks.join(sent_if_small(replaced, SENT_IDS), "id", "left_anti")


def served(chunks: DataFrame, variant: str = VARIANT) -> DataFrame:
    """The current rows of one variant that have a key, with the key's parts."""
    keyed = F.col("filing_stem").isNotNull() & F.col("chunk_index").isNotNull()
    return with_stem_parts(current(chunks.where((F.col("variant") == variant) & keyed)))
