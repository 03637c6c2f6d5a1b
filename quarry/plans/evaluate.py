"""Evaluation: replay of stored rankings, and live retrieval, against gold labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import metrics
from quarry.plans.retrieve import Engine


def _key() -> F.Column:
    return F.concat_ws("#", "filing_stem", F.col("chunk_index").cast("string"))


def split_of(questions: DataFrame, split: str, limit: int | None = None) -> DataFrame:
    """Questions of a split (compared trimmed, in lower case), in id order; limit gives the first ones."""
    chosen = questions.where(F.lower(F.trim("split")) == split)
    return chosen if limit is None else chosen.orderBy("id").limit(limit)


def replay(rankings: DataFrame, gold: DataFrame) -> DataFrame:
    """Report of stored rankings (query_id, filing_stem, chunk_index, rank) against gold (query_id, relevant of 'stem#index')."""
    return metrics.report(metrics.scored(metrics.as_lists(rankings, _key()), gold))


def live(engine: Engine, questions: DataFrame, gold: DataFrame, k: int = 50) -> DataFrame:
    return replay(engine.retrieve(questions, k), gold)
