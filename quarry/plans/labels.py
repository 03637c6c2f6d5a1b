"""Gold labels in one call: from questions, evidence, tables, summaries and chunks to the cached label table, and its checks."""

from __future__ import annotations

import hashlib
import inspect

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import gold
from quarry.sources import sinks

ROW_KEY = ("id", "context_id", "context")


def keyed(questions: DataFrame) -> DataFrame:
    """questions with row_key, the hash of the fields that a label reads."""
    return questions.withColumn("row_key", tx.label_row_key(*map(F.col, ROW_KEY)))


def evidence_labels(questions: DataFrame, evidence: DataFrame, tables: DataFrame, summaries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(question_id, chunk_index, layer) for questions (id, filing_stem, context, ...): covered table rows and aligned sentences of the
    evidence (question_id, table_rows, sentences), pages for the others, and summaries of gold tables (question_id, table_index)."""
    q = questions.where("id IS NOT NULL AND filing_stem IS NOT NULL").select(F.col("id").alias("question_id"), "filing_stem", "context").dropDuplicates(["question_id"])
    own = q.select("question_id", "filing_stem").join(evidence, "question_id")
    rows = own.select("question_id", "filing_stem", F.posexplode("table_rows").alias("row_no", "cells"))
    texts = own.select("question_id", "filing_stem", F.posexplode("sentences").alias("text_no", "gold"))
    pages = q.select("question_id", "filing_stem", F.lit(0).alias("text_no"), F.col("context").alias("gold"))
    return gold.layered(
        gold.row_chunks(rows, chunks).select("question_id", "chunk_index"),
        gold.aligned_chunks(texts, chunks, gold.MIN_SENTENCE),
        gold.aligned_chunks(pages, chunks, gold.MIN_PAGE),
        gold.summary_chunks(tables, summaries, q.select("question_id", "filing_stem"), chunks),
    )


def build(questions: DataFrame, evidence: DataFrame, tables: DataFrame, summaries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(split, id, row_key, gold): the sorted chunks of each question; a question without any has an empty list."""
    labels = evidence_labels(questions, evidence, tables, summaries, chunks)
    listed = labels.groupBy(F.col("question_id").alias("id")).agg(F.array_sort(F.collect_set("chunk_index")).alias("gold"))
    one = keyed(questions.where("id IS NOT NULL")).select(F.lower(F.trim("split")).alias("split"), "id", "row_key").dropDuplicates(["split", "id"])
    return one.join(listed, "id", "left").select("split", "id", "row_key", F.coalesce("gold", F.array().cast("array<int>")).alias("gold"))


def fingerprint(inputs: dict[str, DataFrame]) -> dict[str, str]:
    """SHA-256 of the labelling code with its constants, and of the rows of each input in any order."""
    code = "".join(inspect.getsource(m) for m in (gold, tx)) + inspect.getsource(evidence_labels) + inspect.getsource(build)
    out = {"code": hashlib.sha256(code.encode()).hexdigest()}
    for name, df in inputs.items():
        row = F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns))))
        n, a, b = df.select(F.xxhash64(row).alias("h"), F.xxhash64(F.lit(1), row).alias("g")).agg(F.count(F.lit(1)), F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor("g")).first()
        out[name] = hashlib.sha256(f"{n} {a} {b}".encode()).hexdigest()
    return out


class RowsChanged(RuntimeError):
    pass


def cached(spark: SparkSession, path: str, marks: dict[str, str], questions: DataFrame) -> DataFrame:
    """The labels at path, made under the same fingerprint; an error if a label's question is not the one it was made for."""
    labels = sinks.read_labels(spark, path, marks)
    now = keyed(questions.where("id IS NOT NULL")).select("id", F.col("row_key").alias("now")).distinct()
    changed = labels.select("id", "row_key").join(now, "id").groupBy("id").agg(F.bool_or(F.col("row_key") == F.col("now")).alias("same")).where(~F.col("same"))
    if (n := changed.count()) > 0:
        raise RowsChanged(f"{n} labelled questions have changed")
    return labels
