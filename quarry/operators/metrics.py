"""Ranking metrics per question and their report. Relevant chunks are arrays of one comparable type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recall_at(retrieved: Column, relevant: Column, k: int) -> Column:
    """Share of the relevant list found in the first k; null without relevant ones."""
    hit = F.size(F.array_intersect(F.slice(retrieved, 1, k), relevant))
    return F.when(F.size(relevant) > 0, hit / F.size(relevant))


def mrr(retrieved: Column, relevant: Column) -> Column:
    """1 / rank of the first relevant one in the whole list, 0 when there is none."""
    at = F.array_min(F.filter(F.transform(retrieved, lambda x, i: F.when(F.array_contains(relevant, x), i + 1)), lambda p: p.isNotNull()))
    return F.coalesce(F.lit(1.0) / at, F.lit(0.0))


def _gain(n: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda s, r: s + F.lit(1.0) / F.log2(r + 1))


def ndcg_at(retrieved: Column, relevant: Column, k: int) -> Column:
    """Binary gain discounted by log2(rank + 1), against the best order of the distinct relevant ones; null without any."""
    gains = F.transform(F.slice(retrieved, 1, k), lambda x, i: F.when(F.array_contains(relevant, x), F.lit(1.0) / F.log2(i + 2)).otherwise(0.0))
    dcg = F.aggregate(gains, F.lit(0.0), lambda s, g: s + g)
    ideal = F.least(F.size(F.array_distinct(relevant)), F.lit(k))
    return F.when(F.size(relevant) > 0, dcg / _gain(F.greatest(ideal, F.lit(1))))


def scored(rankings: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, missing, no_gold, recall_10, recall_50, ndcg_10, mrr) of every question of gold (query_id, relevant), from
    rankings (query_id, retrieved); questions without a ranking or without relevant chunks have null metrics."""
    r, g = F.col("retrieved"), F.coalesce("relevant", F.array().cast(gold.schema["relevant"].dataType))
    df = gold.select("query_id", g.alias("relevant")).join(rankings.select("query_id", "retrieved"), "query_id", "left")
    missing, none = r.isNull(), F.size("relevant") == 0
    counted = lambda c: F.when(~missing & ~none, c)
    g = F.col("relevant")
    return df.select(
        "query_id",
        missing.alias("missing"),
        (none & ~missing).alias("no_gold"),
        counted(recall_at(r, g, 10)).alias("recall_10"),
        counted(recall_at(r, g, 50)).alias("recall_50"),
        counted(ndcg_at(r, g, 10)).alias("ndcg_10"),
        counted(mrr(r, g)).alias("mrr"),
    )


def mean_and_error(value: Column) -> tuple[Column, Column]:
    """Mean and standard error, NaN and null left out; one value has the error 0, none gives null for both."""
    v = F.when(~F.isnan(value), value)
    n = F.count(v)
    return F.avg(v), F.when(n > 0, F.coalesce(F.stddev_samp(v), F.lit(0.0)) / F.sqrt(n))


def report(scores: DataFrame) -> DataFrame:
    """One row: counts, and mean and standard error of each metric, rounded to 9 decimals."""
    aggs = [
        F.count(F.when(~F.col("missing") & ~F.col("no_gold"), 1)).alias("n_scored"),
        F.count(F.lit(1)).alias("n_questions"),
        F.count_if("missing").alias("skipped_missing"),
        F.count_if("no_gold").alias("skipped_no_gold"),
    ]
    for m in ("recall_10", "recall_50", "ndcg_10", "mrr"):
        mean, error = mean_and_error(F.col(m))
        aggs += [F.round(mean, 9).alias(f"{m}_mean"), F.round(error, 9).alias(f"{m}_stderr")]
    return scores.agg(*aggs)


def as_lists(ranking: DataFrame, key: Column) -> DataFrame:
    """(query_id, retrieved) in rank order, from a ranking of one row per place."""
    return ranking.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", key.alias("key")))), lambda x: x["key"]).alias("retrieved"))
