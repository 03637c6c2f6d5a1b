"""Writers: the chunk table, incremental appends, event logs, label caches and their checks."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.model import CHUNKS, stem_parts
from quarry.operators.corpus import not_loaded
from quarry.operators.gold import label_diff
from quarry.sources.files import exists


def create_chunk_table(spark: SparkSession, name: str) -> None:
    """An empty chunk table, partitioned by variant and fiscal year, so that reads of a variant skip the others."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({CHUNKS}, ticker STRING, cik BIGINT, fiscal_year INT) USING parquet PARTITIONED BY (variant, fiscal_year)")


def append_new(chunks: DataFrame, path: str, embed: Callable[[DataFrame], DataFrame] = lambda df: df) -> int:
    """Embeds and appends the filings whose stem is not in the table at path; gives their number. A second run adds nothing. New rows are
    clustered by ticker inside each file, for the filter on it."""
    spark = chunks.sparkSession
    new = chunks
    if exists(spark, f"{path}/*"):
        new = not_loaded(chunks, spark.read.parquet(path).select("filing_stem"))
    n = new.select("filing_stem").distinct().count()  # of the rows before the model reads them, which happens once
    if n:
        rows = embed(new).withColumns(stem_parts(F.col("filing_stem")))
        rows.repartition("variant", "fiscal_year", "ticker").sortWithinPartitions("ticker", "filing_stem", "chunk_index").write.mode("append").partitionBy("variant", "fiscal_year").parquet(path)
    return n


def append_events(events: DataFrame, path: str) -> None:
    """Appends events as one JSON object a line."""
    events.write.mode("append").json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_lexicon(lexicon: DataFrame, tickers: DataFrame, path: str) -> None:
    """One JSON object with sorted keys; a lexicon is a reference list, written by the driver row by row."""
    aliases = {r["alias"]: list(r["tickers"]) for r in lexicon.toLocalIterator()}
    known = sorted(r["ticker"] for r in tickers.distinct().toLocalIterator())
    text = json.dumps({"aliases": aliases, "tickers": known}, indent=1, sort_keys=True)
    lexicon.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


class LabelsMoved(RuntimeError):
    pass


def write_labels(labels: DataFrame, path: str, fingerprint: dict[str, str], allow_moved: bool = False) -> None:
    """Writes labels (split, id, row_key, gold) with a fingerprint; refuses where they differ from those at path, unless allowed."""
    spark = labels.sparkSession
    if exists(spark, f"{path}/labels") and not allow_moved and not label_diff(spark.read.parquet(f"{path}/labels"), labels).isEmpty():
        raise LabelsMoved(f"labels differ from those at {path}")
    labels.write.mode("overwrite").parquet(f"{path}/labels-new")
    spark.read.parquet(f"{path}/labels-new").write.mode("overwrite").parquet(f"{path}/labels")
    spark.createDataFrame(sorted(fingerprint.items()), "name string, sha string").coalesce(1).write.mode("overwrite").parquet(f"{path}/fingerprint")


def read_labels(spark: SparkSession, path: str, fingerprint: dict[str, str]) -> DataFrame:
    """Labels written under the same fingerprint; a stale or missing cache is an error."""
    if not exists(spark, f"{path}/labels"):
        raise FileNotFoundError(f"no labels at {path}")
    kept = {r["name"]: r["sha"] for r in spark.read.parquet(f"{path}/fingerprint").collect()}
    if stale := sorted(k for k in fingerprint if kept.get(k) != fingerprint[k]):
        raise RuntimeError(f"labels at {path} were made from other inputs: {stale}")
    return spark.read.parquet(f"{path}/labels")
