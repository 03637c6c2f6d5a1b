"""Questions as a stream: micro-batches through the batch pipeline, and the events of one question."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.plans import answer as an
from quarry.plans.retrieve import Engine

REQUESTS = "request_id BIGINT, asked_at TIMESTAMP, received_at TIMESTAMP, client_id BIGINT, question STRING, k INT, include_text BOOLEAN"


def requests(spark: SparkSession, folder: str, late: str = "1 day") -> DataFrame:
    """Requests as files arrive, repeated ones dropped within the watermark, so that the state stays bounded."""
    rows = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 16).parquet(folder)
    return rows.withWatermark("received_at", late).dropDuplicatesWithinWatermark(["request_id"])


def counts(stream: DataFrame, every: str = "1 hour") -> DataFrame:
    """(window, n_requests, n_valid) of a request stream by the time of receipt, on which the watermark lies."""
    valid = an.valid_requests(stream)
    return valid.groupBy(F.window("received_at", every)).agg(F.count(F.lit(1)).alias("n_requests"), F.count_if("valid").alias("n_valid"))


def serve(stream: DataFrame, engine: Engine, path: str, checkpoint: str):
    """Retrieves for each micro-batch and appends the results; a batch is written under its number, so that a repeat after a failure
    replaces it."""

    def each(batch: DataFrame, n: int) -> None:
        asked = an.valid_requests(batch).where("valid").select(F.col("request_id").alias("query_id"), "question")
        engine.retrieve(asked).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def events(engine: Engine, question: str, generate: Callable[[str], Iterator[str]], k: int = 10, include_text: bool = False) -> Iterator[tuple[str, dict]]:
    """Events of one question: stage (resolve, embed, search, rerank), sources, stage generate, text pieces, answer; or error with a
    status: 422 for a bad request, 404 without candidates, 429 when the model is busy, else 500."""
    spark = engine.chunks.sparkSession
    asked = spark.createDataFrame([(0, question, k, include_text)], "query_id long, question string, k int, include_text boolean")
    if not an.valid_requests(asked).first()["valid"]:
        yield "error", {"status": 422, "detail": "question must have 1 to 2000 characters and k 1 to 50"}
        return
    started = time.perf_counter()
    try:
        results = None
        for name, info, results in engine.stages(asked, k, live=True):  # each event goes out before its stage runs
            if results is None:
                yield "stage", {"stage": name, **info}
        rows = results.orderBy("rank").collect()
        if not rows:
            yield "error", {"status": 404, "detail": "no candidates retrieved"}
            return
        cited = [{"filing_stem": r["filing_stem"], "chunk_index": r["chunk_index"], "score": r["score"], "text": r["text"] if include_text else None} for r in rows]
        yield "sources", {"citations": cited}
        yield "stage", {"stage": "generate"}
        evidence = "\n\n".join(f"[{r['filing_stem']} chunk {r['chunk_index']}] {r['text']}" for r in rows)
        pieces, spent, began = [], dict(engine.timings), time.perf_counter()
        for piece in generate(an.PROMPT.format(question=question, evidence=evidence)):
            pieces.append(piece)
            spent.setdefault("generation_first_text_s", time.perf_counter() - began)
            yield "text", {"text": piece}
        spent["generation_s"] = time.perf_counter() - began
        text = "".join(pieces)
        parsed = spark.createDataFrame([(text,)], "answer string").select(tx.parse_answer(F.col("answer")).alias("p")).first()["p"]
        yield "answer", {"question": question, "answer": text, "value": parsed["value"], "value_status": parsed["status"], "citations": cited, "latency_s": time.perf_counter() - started, "stage_latency": spent}
    except Exception as e:
        busy = getattr(e, "code", None) == 429
        yield "error", {"status": 429 if busy else 500, "detail": "the model is busy" if busy else type(e).__name__}


def frames(stream: Iterator[tuple[str, dict]]) -> Iterator[str]:
    """Server-sent event frames."""
    for event, body in stream:
        yield f"event: {event}\ndata: {json.dumps(body)}\n\n"


def ask(engine: Engine, question: str, generate: Callable[[str], Iterator[str]], **how) -> dict:
    """The body of the last event; an error event is raised."""
    event, body = list(events(engine, question, generate, **how))[-1]
    if event == "error":
        raise RuntimeError(f"{body['status']}: {body['detail']}")
    return body
