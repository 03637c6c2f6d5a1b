"""Approximate nearest chunks by an inverted file of vectors: cells around centroids, stored as folders.

Centroids are fitted on at most SAMPLE vectors, chosen by hash; every usable vector is placed in its nearest cell. A search
reads the folders of the cells nearest to its questions only, and inside them compares each question with the cells
that it probes, exactly. Cosines are rounded to 6 decimals, ties go by key, as in the exact search.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.lineage import cores
from quarry.operators.retrieval import KEY, QUERY_BLOCK, Best, ranked, usable

#: Vectors on which centroids are fitted, and rounds of the fit.
SAMPLE, ROUNDS = 50_000, 12
#: Rows of a cell aimed at, cells at least and at most, and share of the cells that a search reads for a question.
CELL, CELLS, PROBED = 500, (8, 4096), 0.3


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    return _unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size))


def centroids(x: np.ndarray, n: int, seed: int = 3) -> np.ndarray:
    """Spherical k-means of unit vectors."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(n, len(x)), replace=False)]
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        empty = ~np.bincount(near, minlength=len(c)).astype(bool)
        sums[empty] = x[rng.choice(len(x), int(empty.sum()))]
        c = _unit(sums)
    return c


class VectorIndex:
    """Chunk vectors in cells at a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        head = json.loads(spark.read.text(f"{path}/centroids").first()[0])
        self.size, self.centroids = head["size"], np.array(head["centroids"], np.float64).reshape(-1, head["size"])

    @classmethod
    def write(cls, chunks: DataFrame, path: str, size: int = 64, cells: int | None = None) -> VectorIndex:
        """Fits and writes the index of chunks (filing_stem, chunk_index, ticker, embedding). A full cell is spread over several files."""
        spark = chunks.sparkSession
        base = chunks.where(usable(F.col("embedding"), size)).select(*KEY, "ticker", "embedding")
        sample = base.select("embedding").orderBy(F.xxhash64(*KEY)).limit(SAMPLE).toArrow()["embedding"].combine_chunks()
        n = cells or min(max(base.count() // CELL, CELLS[0]), CELLS[1])
        c = centroids(_vectors(sample, size), n) if len(sample) else np.zeros((0, size))
        sent = spark.sparkContext.broadcast(c)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near = (_vectors(batch.column(3), size) @ sent.value.T).argmax(axis=1) if batch.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32())], names=[*KEY, "ticker", "embedding", "cell"])

        placed = base.mapInArrow(place, "filing_stem string, chunk_index int, ticker string, embedding array<float>, cell int")
        placed.repartitionByRange(max(cores(spark), len(c)), "cell", "ticker", *KEY).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
        line = json.dumps({"size": size, "centroids": c.ravel().tolist()})
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/centroids")
        return cls(spark, path)

    def search(self, queries: DataFrame, k: int = 200, probes: int | None = None) -> DataFrame:
        """(query_id, filing_stem, chunk_index, score, rank) of about the k nearest chunks of each query (query_id, vector, tickers)."""
        probes = min(len(self.centroids), probes or max(8, round(PROBED * len(self.centroids))))
        rows = queries.where(usable(F.col("vector"), self.size)).select("query_id", F.col("vector").cast("array<double>"), "tickers")
        block, parts = [], []
        for r in rows.toLocalIterator():
            block.append(tuple(r))
            if len(block) == QUERY_BLOCK:
                parts.append(self._block(block, k, probes))
                block = []
        parts.append(self._block(block, k, probes))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return ranked(out, k, F.desc("score"))

    def _block(self, block: list, k: int, probes: int) -> DataFrame:
        size = self.size
        vectors = _unit(np.array([v for _, v, _ in block], np.float64).reshape(-1, size))
        nearest = np.argsort(-(vectors @ self.centroids.T), axis=1, kind="stable")[:, :probes] if len(block) and probes else np.zeros((0, 0), np.int64)
        asked = {int(c): np.flatnonzero((nearest == c).any(axis=1)) for c in np.unique(nearest)}
        sent = self.spark.sparkContext.broadcast(([q for q, *_ in block], vectors, [frozenset(t or ()) for *_, t in block], asked))
        schema = "filing_stem string, chunk_index int, ticker string, embedding array<float>, cell int"
        read = self.spark.read.schema(schema).parquet(f"{self.path}/cells").where(F.col("cell").isin(sorted(asked)) if asked else F.lit(False))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, queries, tickers, asked = sent.value
            best = Best(len(ids), k)
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, cell = _vectors(batch.column(3), size), batch.column(4).to_numpy()
                stems, index, own = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
                for c in np.unique(cell):
                    rows, of = np.flatnonzero(cell == c), asked[int(c)]
                    free = np.array([q for q in of if not tickers[q]], np.int64)
                    if len(free):
                        best.see(free, np.round(x[rows] @ queries[free].T, 6), stems[rows], index[rows])
                    for q in set(of) - set(free):
                        mine = rows[np.isin(own[rows].astype(str), list(tickers[q]))]
                        if len(mine):
                            best.see(np.array([q]), np.round(x[mine] @ queries[[q]].T, 6), stems[mine], index[mine])
            for i, q in enumerate(ids):
                s, a, b = best.best(i)
                if len(s):
                    yield pa.RecordBatch.from_arrays([pa.array([q] * len(s), pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.int32()), pa.array(s)], names=["query_id", *KEY, "score"])

        return read.mapInArrow(run, "query_id long, filing_stem string, chunk_index int, score double")
