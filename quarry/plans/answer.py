"""Evidence, prompts and answers of questions; the model that writes answers is an outside service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators.retrieval import texts

#: The prompt (fixed value).
PROMPT = """Question: {question}

Evidence gathered:
{evidence}

Answer the question using only this evidence. If the evidence is insufficient, say so
plainly rather than guessing.

Give the numeric value in the same units as the evidence -- do not expand thousands or
millions. End your response with a single line:
ANSWER: <number>
or, if the evidence does not contain the answer:
ANSWER: INSUFFICIENT"""


def evidence(results: DataFrame) -> DataFrame:
    """(query_id, evidence): the texts of a result in rank order, each headed by its place."""
    line = F.concat(F.lit("["), "filing_stem", F.lit(" chunk "), F.col("chunk_index").cast("string"), F.lit("] "), "text")
    listed = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return results.groupBy("query_id").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n\n").alias("evidence"))


def prompt(question: Column, evidence_text: Column) -> Column:
    head, rest = PROMPT.split("{question}")
    middle, tail = rest.split("{evidence}")
    return F.concat(F.lit(head), question, F.lit(middle), evidence_text, F.lit(tail))


def citations(results: DataFrame, include_text: Column | None = None) -> DataFrame:
    """(query_id, citations) in rank order; texts are null unless include_text holds for the question."""
    shown = F.when(F.coalesce(include_text, F.lit(False)), F.col("text")) if include_text is not None else F.lit(None).cast("string")
    entry = F.struct("rank", F.struct("filing_stem", "chunk_index", "score", shown.alias("text")).alias("c"))
    return results.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["c"]).alias("citations"))


def responses(asked: DataFrame, answers: DataFrame, cited: DataFrame) -> DataFrame:
    """(query_id, question, answer, value, value_status, citations) from answers (query_id, answer)."""
    parsed = tx.parse_answer(F.col("answer"))
    joined = asked.select("query_id", "question").join(answers, "query_id").join(cited, "query_id", "left")
    return joined.withColumn("p", parsed).select("query_id", "question", "answer", F.col("p.value").alias("value"), F.col("p.status").alias("value_status"), "citations")


def valid_requests(requests: DataFrame, most: int = 50) -> DataFrame:
    """requests with valid: a question of 1 to 2000 characters and k from 1 to most (10 where null); include_text is false where null."""
    k = F.coalesce("k", F.lit(10))
    ok = F.coalesce(F.length("question").between(1, 2000) & k.between(1, most), F.lit(False))
    return requests.withColumns({"k": k, "include_text": F.coalesce("include_text", F.lit(False)), "valid": ok})


def cited_value(responses_: DataFrame, chunks: DataFrame) -> DataFrame:
    """(request_id, filing_stem, chunk_index, hit): whether a cited chunk contains the answer's number. Citations are distinct pairs; those
    without a text are left out."""
    pairs = responses_.where("value IS NOT NULL").select("request_id", "value", F.explode("citations").alias("c")).select("request_id", "value", "c.filing_stem", "c.chunk_index").distinct()
    return texts(pairs, chunks).select("request_id", "filing_stem", "chunk_index", tx.mentions_value(F.col("text"), F.col("value")).alias("hit"))
