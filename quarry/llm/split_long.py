"""Splitting of oversized texts at natural boundaries, with an overlap between consecutive pieces.

Method: lexical-cohesion segmentation. Blocks of BLOCK tokens slide over the text; at each natural
boundary the similarity of the blocks before and after it is taken, and its depth is how far it lies
below the peaks on both sides (a valley is a change of topic). A piece ends at the deepest valley of
its window of sizes; the next piece begins `overlap` tokens before that end.

A boundary is the end of a paragraph, a sentence or a table row. A full stop ends no sentence after an abbreviation or
initials, or before a small letter or a figure; inside a window without better boundaries such a stop is taken, else
the end of a line, and without any the piece is cut at the limit. Pieces together cover the text;
texts within the limit, null and empty texts give no piece; repeated rows give one set of pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.base import TOKEN_RE, n_tokens

BLOCK = 60
#: Share of the limit that a piece should fill at least, where a boundary allows it.
FILL = 0.5
_SENTENCE_END = re.compile(r"[.!?…。！？][\"'”’»“)\]*_]*$")
_ROW = re.compile(r"\|")
#: Words that a full stop belongs to (fixed values), besides initials.
ABBREVIATIONS = {"inc", "corp", "co", "cos", "ltd", "llc", "bros", "approx", "no", "nos", "vs", "mr", "mrs", "ms", "dr", "prof", "st", "jr", "sr", "etc", "fig", "art", "sec", "est", "dept", "incl", "excl", "cf", "al", "ca", "bzw", "nr", "mio", "mrd", "tel", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec"}
_INITIALS = re.compile(r"^(?:[^\W\d_]\.)+$")


ABBREVIATED, SMALL, SENTENCE = range(3)


def kind_of_stop(token: str, following: str) -> int:
    """What a token that ends like a sentence is, given the token after it: an abbreviation, before a small letter or a figure, or a
    sentence's end."""
    bare = token.strip("\"'”’»“()[]*_")
    if not bare.endswith("."):
        return SENTENCE
    if bare[:-1].lower() in ABBREVIATIONS or _INITIALS.match(bare):
        return ABBREVIATED
    first = following.lstrip("\"'”’»“([*_")[:1]
    return SMALL if first.islower() or first.isdigit() else SENTENCE


def boundaries(text: str, spans: list[tuple[int, int]], is_table: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the gap after each token but the last: whether it is a natural boundary, whether a full stop of any kind stands before
    it, and whether a line ends."""
    n = len(spans) - 1
    natural, stop, line = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
    kind = np.full(n, -1)
    for i in range(n):
        end, start = spans[i][1], spans[i + 1][0]
        stop[i] = bool(_SENTENCE_END.search(text[max(spans[i][0], end - 8) : end]))
        if stop[i]:
            kind[i] = kind_of_stop(text[max(spans[i][0], end - 24) : end], text[start : start + 8])
    # a text whose sentences begin with small letters as a rule is read as it is written
    ends = (kind == SENTENCE) | ((kind == SMALL) & ((kind == SMALL).sum() > (kind == SENTENCE).sum()))
    line_start = 0
    for i in range(n):
        end, start = spans[i][1], spans[i + 1][0]
        sentence = ends[i]
        newlines = text.count("\n", end, start)
        if not newlines:
            natural[i] = not is_table and sentence
            continue
        line[i] = True
        natural[i] = newlines > 1 or is_table or sentence or bool(_ROW.search(text, line_start, end))
        line_start = start
    return natural, stop & ~natural if not is_table else stop & False, line


def depths(words: list[str], gaps: np.ndarray) -> np.ndarray:
    """Depth of the similarity valley at each gap (gap g lies after token g)."""
    if not len(gaps):
        return np.zeros(0)
    ids = np.unique(np.array([w.lower().strip(".,;:()|$%\"'") for w in words]), return_inverse=True)[1]
    sim = np.empty(len(gaps))
    for k, g in enumerate(gaps):
        a, ca = np.unique(ids[max(0, g + 1 - BLOCK) : g + 1], return_counts=True)
        b, cb = np.unique(ids[g + 1 : g + 1 + BLOCK], return_counts=True)
        _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        sim[k] = (ca[ia] * cb[ib]).sum() / np.sqrt((ca * ca).sum() * (cb * cb).sum())
    left, right = sim.copy(), sim.copy()
    for k in range(1, len(sim)):  # the peak reached by climbing from the gap, on either side
        if left[k - 1] >= sim[k]:
            left[k] = left[k - 1]
    for k in range(len(sim) - 2, -1, -1):
        if right[k + 1] >= sim[k]:
            right[k] = right[k + 1]
    return left + right - 2 * sim


def pieces(text: str, limit: int, overlap: int, is_table: bool = False) -> list[tuple[int, int, int]]:
    """(char_start, char_end, n_tokens) of the pieces of a text of more than limit tokens."""
    spans = [m.span() for m in TOKEN_RE.finditer(text)]
    natural, stop, line = boundaries(text, spans, is_table)
    gaps = np.flatnonzero(natural)
    depth = depths([text[a:b] for a, b in spans], gaps)
    lesser = [np.flatnonzero(stop), np.flatnonzero(line)]
    out, start = [], 0
    while len(spans) - start > limit:
        low, high = start + overlap, start + limit - 1  # the gap after token `low` leaves a new token
        low_full = max(low, start + int(limit * FILL) - 1)
        i, j = np.searchsorted(gaps, low_full), np.searchsorted(gaps, high, "right")
        if i == j:
            i = np.searchsorted(gaps, low)
            i = max(i, j - 1)  # the last boundary before the window keeps the piece as full as may be
        if i < j:
            g = int(gaps[i + np.argmax(depth[i:j])])
        else:
            g = high
            for ends in lesser:
                i, j = np.searchsorted(ends, low), np.searchsorted(ends, high, "right")
                if i < j:
                    g = int(ends[j - 1])
                    break
        out.append((spans[start][0], spans[g][1], g + 1 - start))
        start = g + 1 - overlap
    out.append((spans[start][0], spans[-1][1], len(spans) - start))
    return out


def split_oversized(df: DataFrame, limit: int = 1500, overlap: int = 100) -> DataFrame:
    """Pieces (item_kind, item_id, piece_no from 0, text, n_tokens, char_start, char_end) of the rows
    (item_kind, item_id, text, is_table) whose text has more than limit tokens, counted from the text.

    The count is taken in the JVM, behind a length test that loses nothing, so that only oversized texts
    are shuffled (to drop repeated rows, and to spread them) and reach Python."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be from 0 to below limit")
    large = df.where((F.length("text") > 2 * limit) & (n_tokens("text") > limit)).select("item_kind", "item_id", "text", F.coalesce("is_table", F.lit(False)).alias("is_table"))
    # of several texts of one id the first in order, so that the result is the same in every run
    large = large.groupBy("item_kind", "item_id").agg(F.min(F.struct("text", "is_table")).alias("t")).select("item_kind", "item_id", "t.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, item, text, table in zip(*(c.to_pylist() for c in batch.columns)):
                cuts = pieces(text, limit, overlap, table)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind] * len(cuts)), pa.array([item] * len(cuts), pa.int64()), pa.array(range(len(cuts)), pa.int32()), pa.array([text[a:b] for a, b, _ in cuts]), pa.array([n for *_, n in cuts], pa.int32()), pa.array([a for a, *_ in cuts], pa.int32()), pa.array([b for _, b, _ in cuts], pa.int32())],
                    names=["item_kind", "item_id", "piece_no", "text", "n_tokens", "char_start", "char_end"],
                )

    return large.mapInArrow(run, "item_kind string, item_id long, piece_no int, text string, n_tokens int, char_start int, char_end int")


def oversized_items(chunks: DataFrame, atoms: DataFrame) -> DataFrame:
    """Chunks and atoms as rows of split_oversized."""
    a = chunks.select(F.lit("chunk").alias("item_kind"), F.col("id").alias("item_id"), "text", F.lit(False).alias("is_table"))
    b = atoms.select(F.lit("atom").alias("item_kind"), F.col("atom_id").alias("item_id"), "text", "is_table")
    return a.unionByName(b)
