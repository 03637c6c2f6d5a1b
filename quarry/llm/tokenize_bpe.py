"""Encoding of texts by the merge ranks of a public byte-level tokenizer.

Method: contiguous rank array. A word's part boundaries lie in one array beside the rank of the merge
that would join each part with the next; the smallest rank is looked for, its boundary deleted and the
two neighbouring ranks refreshed, until no merge is left. Words longer than SCAN_BYTES keep their
boundaries in a linked list with a heap, since the scan is quadratic; the result is the same.

Nulls and empty texts give an empty list; blank texts are encoded like others; strings that look like
special tokens are ordinary text; no text is shortened. Repeated rows give repeated rows.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.base import list_array, spread

#: Longest word, in bytes, whose boundaries are scanned rather than kept in a heap.
SCAN_BYTES = 200
#: Words whose ids a worker remembers; beyond it the memory starts anew.
REMEMBERED = 150_000
NONE = 1 << 30


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word of the splitting pattern."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if len(word) > SCAN_BYTES:
        return _encode_long(word, ranks)
    bounds = list(range(len(word) + 1))
    get = ranks.get
    joined = [get(word[i : i + 2], NONE) for i in range(len(word) - 1)]
    while joined:
        least = min(joined)
        if least == NONE:
            break
        i = joined.index(least)
        del bounds[i + 1], joined[i]
        if i < len(joined):
            joined[i] = get(word[bounds[i] : bounds[i + 2]], NONE)
        if i:
            joined[i - 1] = get(word[bounds[i - 1] : bounds[i + 1]], NONE)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def _encode_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(word)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        if i >= 0 and end[i] < n and (r := ranks.get(word[i : end[end[i]]])) is not None:
            heapq.heappush(heap, (r, i, end[end[i]]))

    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        gone = end[i]
        alive[gone], end[i] = False, stop
        if stop < n:
            before[stop] = i
        offer(i)
        offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def encode_text(text: str | None, split, ranks: dict[bytes, int], known: dict[str, list[int]]) -> list[int]:
    if not text:
        return []
    words = split(text)
    try:
        return list(chain.from_iterable([known[w] for w in words]))
    except KeyError:
        if len(known) > REMEMBERED:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = encode_word(w.encode("utf-8", "replace"), ranks)
        return list(chain.from_iterable([known[w] for w in words]))


def encode(df: DataFrame, key: str, text: str, ranks_file: str, pattern: str) -> DataFrame:
    """(key, ids ARRAY<INT>) of each row of df. The rank file is read on the driver and sent once: its size
    is that of the vocabulary (under 1 MB), whatever the corpus. No shuffle: one Arrow pass."""
    sent = df.sparkSession.sparkContext.broadcast(load_ranks(ranks_file))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        ranks, split, known = sent.value, regex.compile(pattern).findall, {}
        for batch in batches:
            ids = [encode_text(t, split, ranks, known) for t in batch.column(1).to_pylist()]
            sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(sizes.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), list_array(flat, sizes, pa.int32())], names=[key, "ids"])

    return spread(df.select(key, text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
