import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ.setdefault("TZ", "UTC")
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


#: Columns of the driver's tables, as DDL.
SCHEMAS = {
    "chunks": "id BIGINT, filing_stem STRING, ticker STRING, chunk_index INT, heading STRING, n_tokens INT, text STRING, embedding ARRAY<FLOAT>, variant STRING, ingested_at TIMESTAMP",
    "atoms": "atom_id BIGINT, filing_stem STRING, atom_index INT, text STRING, tokens INT, is_title BOOLEAN, is_table BOOLEAN, is_furniture BOOLEAN",
    "ask_requests": "request_id BIGINT, asked_at TIMESTAMP, received_at TIMESTAMP, client_id BIGINT, question STRING, k INT, include_text BOOLEAN",
    "ask_responses": "request_id BIGINT, question STRING, answer STRING, value DOUBLE, value_status STRING, citations ARRAY<STRUCT<filing_stem: STRING, chunk_index: INT, score: DOUBLE, text: STRING>>, latency_s DOUBLE, stage_latency MAP<STRING, DOUBLE>, answered_at TIMESTAMP",
    "ingest_log": "stem STRING, cik BIGINT, year INT, status STRING, raw_bytes BIGINT, fetch_s DOUBLE, parse_s DOUBLE, chunk_s DOUBLE, n_blocks INT, n_tables INT, n_chunks INT, median_tokens INT, max_tokens INT, error STRING, logged_at TIMESTAMP, received_at TIMESTAMP",
    "companies": "company_cik BIGINT, company_symbol STRING, company_name STRING, aliases ARRAY<STRING>",
    "questions": "id STRING, question STRING, context STRING, context_id STRING, split STRING, company_name STRING, company_symbol STRING, company_cik BIGINT, report_year INT, subset_source STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, filing_stem STRING, section STRING, loaded_at TIMESTAMP",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP, o_orderpriority STRING",
}


def _write(spark, root, rows):
    for name, ddl in SCHEMAS.items():
        spark.createDataFrame(rows.get(name, []), ddl).coalesce(1).write.parquet(f"{root}/{name}.parquet")
    return str(root)


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    return _write(spark, tmp_path_factory.mktemp("empty"), {})


@pytest.fixture(scope="session")
def null_dir(spark, tmp_path_factory):
    """Each table holds two equal rows of nulls alone, and extra columns whose names clash with inner ones."""
    root = tmp_path_factory.mktemp("nulls")
    for name, ddl in SCHEMAS.items():
        df = spark.createDataFrame([], ddl)
        row = [tuple([None] * len(df.columns))] * 2
        out = spark.createDataFrame(row, ddl)
        for extra in ("rank", "key", "source", "rep", "n", "score", "bits", "token", "gone", "piece_no", "name", "line"):
            if extra not in out.columns:
                from pyspark.sql import functions as F

                out = out.withColumn(extra, F.lit("x"))
        out.coalesce(1).write.parquet(f"{root}/{name}.parquet")
    return str(root)
