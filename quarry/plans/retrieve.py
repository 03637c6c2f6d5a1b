"""Retrieval from question to ranked chunks, for a batch of questions at a time."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.lineage import cut
from quarry.model import TOP_K
from quarry.operators.resolve import Lexicon, resolved
from quarry.operators.retrieval import Bm25Index, first_stage, overlap_score, rerank, texts

Embed = Callable[[DataFrame], DataFrame]


@dataclass
class Engine:
    """The corpus, its term index, the lexicon, and the two models: embed adds `vector` to (query_id, stripped), scorer is a column
    function of question and text."""

    chunks: DataFrame
    index: Bm25Index
    lexicon: Lexicon
    embed: Embed
    scorer: Callable = overlap_score
    timings: dict[str, float] = field(default_factory=dict)
    diagnosis: dict = field(default_factory=dict)

    def understand(self, questions: DataFrame) -> DataFrame:
        """(query_id, question, tickers, reason, stripped, years) of questions (query_id, question)."""
        r = resolved(questions, self.lexicon)
        return questions.select("query_id", "question").join(r, "query_id").withColumn("years", tx.years(F.col("question")))

    def stages(self, questions: DataFrame, k: int = TOP_K, live: bool = False) -> Iterator[tuple[str, dict, DataFrame | None]]:
        """(stage, info, None) as each of resolve, embed, search and rerank begins, and last ("done", {}, result). live runs each
        stage before the next begins, with its seconds in `timings`; else the plan is one, and Spark runs it when it is read."""
        self.timings, self.diagnosis = {}, {}
        started = time.perf_counter()

        def end(name: str, began: float, df: DataFrame) -> DataFrame:
            if live:
                df = cut(df)
                self.timings[f"{name}_s"] = time.perf_counter() - began
            return df

        yield "resolve", {}, None
        began = time.perf_counter()
        asked = end("resolve", began, self.understand(questions))
        if live:  # one question, or a few
            first = asked.select("tickers", "reason", "stripped").first()
            self.diagnosis = {"tickers": list(first["tickers"]), "fallback_reason": first["reason"], "stripped": first["stripped"]} if first else {}
        yield "embed", {"tickers": self.diagnosis["tickers"]} if self.diagnosis else {}, None
        began = time.perf_counter()
        embedded = end("embed", began, asked.join(self.embed(asked.select("query_id", "stripped")).select("query_id", "vector"), "query_id", "left"))
        yield "search", {}, None
        began = time.perf_counter()
        pool = end("search", began, texts(first_stage(embedded, self.chunks, self.index), self.chunks))
        yield "rerank", {"candidates": pool.count()} if live else {}, None
        began = time.perf_counter()
        out = end("rerank", began, rerank(pool, asked.select("query_id", F.col("stripped").alias("question")), self.scorer, k))
        if live:
            self.timings["total_s"] = time.perf_counter() - started
        yield "done", {}, out

    def retrieve(self, questions: DataFrame, k: int = TOP_K, on_stage: Callable[[str, dict], None] | None = None, live: bool = False) -> DataFrame:
        """(query_id, filing_stem, chunk_index, text, score, rank). Term search reads the question as asked; vectors and the reranker
        read it stripped. on_stage is told of each stage as it begins."""
        for name, info, out in self.stages(questions, k, live):
            if out is None and on_stage is not None:
                on_stage(name, info)
        return out
