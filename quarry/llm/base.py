"""Shared plumbing of the operators: table reads, checkpoints, word rules."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.lineage import cores, cut, released, sent_if_small, shared_path, spread, stored  # noqa: F401

#: Characters that separate tokens in the token counts (fixed values).
TOKEN_SEPARATORS = " \t\r\n\u00a0"
TOKEN_RE = re.compile(f"[^{TOKEN_SEPARATORS}]+")
TOKEN_JAVA = r"[^ \t\r\n\u00a0]+"
WORD_RE = re.compile("[a-z0-9]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_tokens(col) -> F.Column:
    """Token count in the JVM; null counts as 0."""
    return F.coalesce(F.size(F.expr(f"regexp_extract_all({_name(col)}, r'{TOKEN_JAVA}', 0)")), F.lit(0))


def _name(col: str) -> str:
    return "`" + col.replace("`", "``") + "`"


_MIX1, _MIX2, _MIX3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser (fixed constants), elementwise."""
    with np.errstate(over="ignore"):
        x = x + _MIX1
        x = (x ^ (x >> np.uint64(30))) * _MIX2
        x = (x ^ (x >> np.uint64(27))) * _MIX3
        return x ^ (x >> np.uint64(31))


class WordHasher:
    """Stable 64-bit hashes of words, remembered up to a bound."""

    def __init__(self, keep: int = 200_000):
        from xxhash import xxh3_64_intdigest

        self.digest, self.keep, self.known = xxh3_64_intdigest, keep, {}

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.keep:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = self.digest(w)
        return np.fromiter((known[w] for w in words), dtype=np.uint64, count=len(words))


def strings(column) -> list:
    """A column of an Arrow batch as Python strings, null as None."""
    return column.to_pylist()


def whole_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of rows that are equal in the first `keys` columns (numbers), of rows sorted by these, with the
    edges of the runs. What is held is a batch and the run that goes on in it."""
    held: list[pa.RecordBatch] = []
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            if batch.num_rows:
                held.append(batch)
            if not held or sum(b.num_rows for b in held) < 2 * held[0].num_rows and len(held) > 1:
                continue  # a run over many batches is looked at again when it has doubled
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        key = np.stack([t.column(k).to_numpy() for k in range(keys)], axis=1)
        edges = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(key)]])
        if batch is None:
            yield t, edges
            return
        if len(edges) > 2:
            yield t.slice(0, int(edges[-2])), edges[:-1]
            held = t.slice(int(edges[-2])).to_batches()
        else:
            held = t.to_batches()


def list_array(flat: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))
