"""Passages of held-out evaluation items inside corpus documents, word for word or paraphrased.

Method: latent semantic retrieval. A randomised singular value decomposition of the TF-IDF matrix of all documents
is computed in distributed passes over all of them: the words' document counts, then the product of the matrix
with its transpose and a random test matrix, whose orthonormal basis spans the leading latent directions. Words
are hashed to FEATURES columns, so all that is gathered has a fixed size, whatever the corpus. Texts are read into
words once; the passes read 32-bit word hashes from the checkpoint folder.

`paraphrases`: passages are sentences (longer ones are cut at LONGEST words). Those of documents and items whose
latent vectors have a cosine of at least MEANT are candidates; a candidate stands if its longest common subsequence
of words reaches KEPT of the item's passage (the longest-common-subsequence check) and at least half of the words
that carry the passage's answer, its figures and the words that few items share, stand in it (the answer check).

`leaks`: runs of `least` equal words, wherever sentences begin. Documents are cut into passages of half the wanted
run and items into all windows of that length; the vectors of equal passages are equal, so a search for cosines of
at least SAME finds, for each common run, the passage that lies wholly inside it. Item windows lie in cells around
pivots, and a passage compares itself only with the cells that the triangle inequality of angles leaves. The common
run around each candidate must reach `least` words. Here the latent space only prunes: what it would
miss without equal words is left to `paraphrases`.

Words are maximal runs of ASCII letters and digits in the lower-cased text. Null and empty texts hold no
passage. Repeated items count once by id; items that share a text each give a row. Item passages are searched in
blocks of BLOCK words, one pass over the documents each, so that what is sent to the executors is bounded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.base import WORD_RE, WordHasher, cut, mix64, spread

FEATURES, RANK, EXTRA = 1 << 14, 40, 8
#: Cosine of equal passages, but for rounding; and of passages that may mean the same.
SAME, MEANT = 0.9995, 0.7
#: Share of an item's passage that a paraphrase keeps in order, and of its answer's words.
KEPT, ANSWER = 0.6, 0.5
#: Share of the item texts that may hold a word that carries an answer.
FEW = 0.05
#: Words of a passage at least and at most.
SHORTEST, LONGEST = 8, 40
PIVOTS = 384
#: Item words of one pass, at most (40 MB with their vectors).
BLOCK = 200_000
#: Passages that are compared at once.
BATCH = 8192
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+|\n+")


def _feature(hashes: np.ndarray) -> np.ndarray:
    return (mix64(hashes.astype(np.uint64)) % np.uint64(FEATURES)).astype(np.int64)


def _random(seed: int, columns: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((FEATURES, columns)).astype(np.float32)


def _hashed(texts: list[str], hasher: WordHasher) -> list[np.ndarray]:
    lists = [WORD_RE.findall(t.lower()) for t in texts]
    flat = (hasher([w for x in lists for w in x]) >> np.uint64(32)).astype(np.uint32)
    return np.split(flat, np.cumsum([len(x) for x in lists])[:-1]) if lists else []


def passages(texts: list[str], hasher: WordHasher) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Word hashes of each text, and the sizes of its passages in words, in order: sentences, long ones cut. No word lies
    across the end of a sentence, so the words are those of the whole text."""
    words, sizes = [], []
    for t in texts:
        parts = [WORD_RE.findall(x) for x in _SENTENCE.split(t.lower())]
        words.append([w for x in parts for w in x])
        sizes.append(np.array([min(LONGEST, len(x) - k) for x in parts for k in range(0, len(x), LONGEST)], np.int32))
    flat = (hasher([w for x in words for w in x]) >> np.uint64(32)).astype(np.uint32)
    return np.split(flat, np.cumsum([len(x) for x in words])[:-1]) if words else [], sizes


def tokenised(docs: DataFrame, sentences: bool = False) -> DataFrame:
    """(doc_id, words, sizes): 32-bit hashes of a document's words, and with sentences the sizes of its passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            words, sizes = passages(texts, hasher) if sentences else (_hashed(texts, hasher), [np.zeros(0, np.int32)] * len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([w.tobytes() for w in words], pa.binary()), pa.array([x.tobytes() for x in sizes], pa.binary())], names=["doc_id", "words", "sizes"])

    some = docs.select("doc_id", "text").where(F.lower("text").rlike("[a-z0-9]"))
    return cut(spread(some).mapInArrow(run, "doc_id long, words binary, sizes binary"))


def _flat(column: pa.Array, kind: type = np.uint32) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows of a binary column, and how many each row has."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind), np.fromiter(map(len, rows), np.int64, count=len(rows)) // np.dtype(kind).itemsize


def document_counts(words: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each feature, and documents in all; combined by feature before they are gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                flat, sizes = _flat(batch.column(0).slice(low, 500))
                once = np.unique(np.repeat(np.arange(len(sizes)) * FEATURES, sizes) + _feature(flat))
                total += np.bincount(once % FEATURES, minlength=FEATURES)
                n += int((sizes > 0).sum())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["at", "n"])

    rows = words.select("words").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    at, n = rows["at"].to_numpy(), rows["n"].to_numpy()
    counts = np.zeros(FEATURES, np.int64)
    counts[at[at >= 0]] = n[at >= 0]
    return counts, int(n[at < 0].sum())


def latent_directions(words: DataFrame, idf: np.ndarray) -> np.ndarray:
    """FEATURES x RANK: word vectors in the latent space, weighted by idf."""
    width = RANK + EXTRA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test, total = _random(11, width), np.zeros((FEATURES, width))
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                flat, sizes = _flat(batch.column(0).slice(low, 500))
                if not len(flat):
                    continue
                cell, count = np.unique(np.repeat(np.arange(len(sizes)) * FEATURES, sizes) + _feature(flat), return_counts=True)
                row, col = cell // FEATURES, cell % FEATURES
                weight = (1 + np.log(count)) * idf[col]
                starts = np.concatenate([[0], np.flatnonzero(row[1:] != row[:-1]) + 1])
                many = np.diff(np.append(starts, len(row)))
                norm = np.sqrt(np.add.reduceat(weight * weight, starts))
                weight = (weight / np.repeat(np.maximum(norm, 1e-9), many)).astype(np.float32)
                product = np.add.reduceat(test[col] * weight[:, None], starts, axis=0)
                back = np.repeat(product, many, axis=0) * weight[:, None]
                order = np.argsort(col, kind="stable")
                first = np.concatenate([[0], np.flatnonzero(np.diff(col[order])) + 1])
                total[col[order][first]] += np.add.reduceat(back[order], first, axis=0)
        at = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(total[at, k]) for k in range(width))], names=["at", *(f"c{k}" for k in range(width))])

    schema = "at long, " + ", ".join(f"c{k} double" for k in range(width))
    sums = words.select("words").mapInArrow(run, schema).groupBy("at").agg(*(F.sum(f"c{k}").alias(f"c{k}") for k in range(width))).toArrow()
    product = np.zeros((FEATURES, width))
    if sums.num_rows:
        product[sums["at"].to_numpy()] = np.stack([sums[f"c{k}"].to_numpy() for k in range(width)], axis=1)
    basis, _ = np.linalg.qr(product)
    # words that no leading direction holds keep a little of a random one, so that no passage vanishes
    return (idf[:, None] * (basis[:, :RANK] + 1e-3 * _random(12, RANK))).astype(np.float32)


def _project(feature: np.ndarray, starts: np.ndarray, length: int, directions: np.ndarray) -> np.ndarray:
    """Unit latent vectors of the windows of `length` words at starts."""
    x = directions[feature[starts]]
    for k in range(1, length):  # in the words' order: equal windows have equal sums
        x += directions[feature[starts + k]]
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Items:
    """Item texts as words, with their windows in cells around pivots."""

    def __init__(self, texts: list[np.ndarray], owners: list[int], length: int, directions: np.ndarray):
        self.words = np.concatenate(texts) if texts else np.zeros(0, np.uint32)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        self.end = self.begin + sizes
        self.text = np.repeat(np.arange(len(texts)), np.maximum(sizes - length + 1, 0))
        self.start = np.concatenate([b + np.arange(max(n - length + 1, 0)) for b, n in zip(self.begin, sizes)]).astype(np.int64) if texts else np.zeros(0, np.int64)
        vectors = _project(_feature(self.words), self.start, length, directions) if len(self.start) else np.zeros((0, directions.shape[1]), np.float32)
        chosen = np.random.default_rng(5).choice(len(vectors), min(PIVOTS, len(vectors)), replace=False)
        self.pivots, self.owners = vectors[chosen], np.array(owners)
        near = vectors @ self.pivots.T
        cell = near.argmax(axis=1) if len(vectors) else np.zeros(0, np.int64)
        order = np.argsort(cell, kind="stable")
        self.text, self.start, self.vectors, cell = self.text[order], self.start[order], vectors[order], cell[order]
        self.edges = np.searchsorted(cell, np.arange(len(chosen) + 1))
        angle = np.arccos(np.clip(near.max(axis=1, initial=-1.0)[order], -1, 1)) if len(vectors) else np.zeros(0)
        self.radius = np.array([angle[a:b].max(initial=0.0) for a, b in zip(self.edges, self.edges[1:])])

    def candidates(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (passage, window) with a cosine of at least SAME, cell by cell."""
        if not len(self.pivots):
            return
        to_pivot = self.pivots @ x.T
        least = np.cos(np.minimum(self.radius + np.arccos(SAME) + 1e-3, np.pi))
        for k in range(len(self.pivots)):
            rows = np.flatnonzero(to_pivot[k] >= least[k])
            a, b = self.edges[k], self.edges[k + 1]
            if len(rows) and a < b:
                p, w = np.nonzero(x[rows] @ self.vectors[a:b].T >= SAME)
                if len(p):
                    yield rows[p], a + w


def _run_reaches(doc: np.ndarray, d0: np.ndarray, d1: np.ndarray, at: np.ndarray, items: Items, window: np.ndarray, length: int, least: int) -> np.ndarray:
    """Whether the common run of document words around `at` and item words around the window reaches least;
    d0 and d1 are the ends of the documents that hold the passages."""
    i0, i1, start = items.begin[items.text[window]], items.end[items.text[window]], items.start[window]
    same = (doc[at[:, None] + np.arange(length)] == items.words[start[:, None] + np.arange(length)]).all(axis=1)
    run = np.where(same, length, 0)
    for step in (-1, 1):
        going, k = same.copy(), 1
        while going.any() and k <= least - length:
            p, q = (at - k, start - k) if step < 0 else (at + length - 1 + k, start + length - 1 + k)
            inside = going & (p >= d0) & (p < d1) & (q >= i0) & (q < i1)
            going = inside
            rows = np.flatnonzero(inside)
            equal = doc[p[rows]] == items.words[q[rows]]
            going[rows[~equal]] = False
            run[rows[equal]] += 1
            k += 1
    return run >= least


def _held_out(items: DataFrame, least: int) -> Iterator[tuple[list[str], list[list[str]]]]:
    """Texts of the items with the ids that hold each, in blocks of BLOCK words: the evaluation set is a stated query set."""
    owners: dict[str, list[str]] = {}
    for row in items.select("id", "question", "context").distinct().toLocalIterator():
        for text in (row["question"], row["context"]):
            if row["id"] is not None and text:
                owners.setdefault(text, []).append(row["id"])
    texts, ids, size = [], [], 0
    for text, own in owners.items():
        n = len(WORD_RE.findall(text.lower()))
        if n < least:
            continue
        if size and size + n > BLOCK:
            yield texts, ids
            texts, ids, size = [], [], 0
        texts.append(text)
        ids.append(sorted(set(own)))
        size += n
    yield texts, ids


def latent_space(words: DataFrame) -> np.ndarray:
    """Directions of the features."""
    counts, n = document_counts(words)
    return latent_directions(words, np.log((1 + n) / (1 + counts)) + 0.1)


def leaks(docs: DataFrame, held_out: DataFrame, least: int = 12) -> DataFrame:
    """(doc_id, question_id) of documents (doc_id, text) that hold `least` consecutive words of the question or the
    context of an item (id, question, context)."""
    length, hasher = least // 2, WordHasher()
    words = tokenised(docs)
    directions = latent_space(words)
    found = None
    for texts, ids in _held_out(held_out, least):
        items = Items(_hashed(texts, hasher), list(range(len(ids))), length, directions)
        sent = docs.sparkSession.sparkContext.broadcast((items, directions, ids))
        one = words.select("doc_id", "words").mapInArrow(_search(sent, length, least), "doc_id long, question_id string")
        found = one if found is None else found.unionByName(one)
    return found.distinct()


def _search(sent, length: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, directions, ids = sent.value
        for batch in batches:
            doc_ids = batch.column(0).to_numpy(zero_copy_only=False)
            words, sizes = _flat(batch.column(1))
            feature = _feature(words)
            end = np.cumsum(sizes)
            begin = end - sizes
            per = sizes // length
            owner = np.repeat(np.arange(len(sizes)), per)
            if not len(owner):
                continue
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
            at = begin[owner] + nth * length
            hits: set[tuple[int, int]] = set()
            for low in range(0, len(at), BATCH):
                a, o = at[low : low + BATCH], owner[low : low + BATCH]
                for p, w in items.candidates(_project(feature, a, length, directions)):
                    ok = _run_reaches(words, begin[o[p]], end[o[p]], a[p], items, w, length, least)
                    hits.update(zip(o[p[ok]].tolist(), items.text[w[ok]].tolist()))
            rows = [(doc_ids[o], i) for o, t in sorted(hits) for i in ids[t]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["doc_id", "question_id"])

    return run


# ---- paraphrases


class Passages:
    """Sentences of many texts as words, with their latent vectors."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, owner: np.ndarray, directions: np.ndarray):
        end = np.cumsum(sizes)
        long = sizes >= SHORTEST
        self.words, self.end, self.begin, self.owner = words, end[long], (end - sizes)[long], owner[long]
        self.vectors = np.zeros((len(self.begin), directions.shape[1]), np.float32)
        for low in range(0, len(self.begin), BATCH // 4):  # so that the word vectors of a batch are never held at once
            begin, many = self.begin[low : low + BATCH // 4], (self.end - self.begin)[low : low + BATCH // 4]
            starts = np.cumsum(many) - many
            x = np.add.reduceat(directions[_feature(words[np.repeat(begin - starts, many) + np.arange(many.sum())])], starts, axis=0)
            self.vectors[low : low + BATCH // 4] = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def __getitem__(self, k: int) -> list[int]:
        return self.words[self.begin[k] : self.end[k]].tolist()


def answer_words(items: Passages, texts: int, figures: set[int]) -> list[set[int]]:
    """The words of each item passage that carry its answer: figures, and names and other words that few items share."""
    own = [set(items[k]) for k in range(len(items.owner))]
    shared: dict[int, set[int]] = {}
    for k, ws in enumerate(own):
        for w in ws:
            shared.setdefault(w, set()).add(int(items.owner[k]))
    return [{w for w in ws if w in figures or len(shared[w]) <= max(2, FEW * texts)} or ws for ws in own]


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bits of a whole row at once."""
    where: dict = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        match = row & where.get(w, 0)
        row = (row + match | row - match) & full
    return len(a) - row.bit_count()


def paraphrases(docs: DataFrame, held_out: DataFrame) -> DataFrame:
    """(doc_id, question_id, kept): documents with a passage that says what a passage of an item says, in the same words or with
    some of them changed, and the largest share of an item's passage that is kept in order, rounded to 6 decimals."""
    hasher = WordHasher()
    words = tokenised(docs, sentences=True)
    directions = latent_space(words)
    found = None
    for texts, ids in _held_out(held_out, SHORTEST):
        flat, sizes = passages(texts, hasher)
        items = Passages(np.concatenate(flat) if flat else np.zeros(0, np.uint32), np.concatenate(sizes).astype(np.int64) if sizes else np.zeros(0, np.int64), np.repeat(np.arange(len(sizes)), [len(x) for x in sizes]), directions)
        answers = answer_words(items, len(texts), set(_hashed([" ".join(w for t in texts for w in WORD_RE.findall(t.lower()) if not w.isalpha())], hasher)[0].tolist()))
        sent = docs.sparkSession.sparkContext.broadcast((items, answers, directions, ids))
        one = words.mapInArrow(_compare(sent), "doc_id long, question_id string, kept double")
        found = one if found is None else found.unionByName(one)
    return found.groupBy("doc_id", "question_id").agg(F.round(F.max("kept"), 6).alias("kept"))


def _compare(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, answers, directions, ids = sent.value
        for batch in batches:
            doc_ids = batch.column(0).to_numpy(zero_copy_only=False)
            words, _ = _flat(batch.column(1))
            sizes, many = _flat(batch.column(2), np.int32)
            own = Passages(words, sizes.astype(np.int64), np.repeat(np.arange(len(many)), many), directions)
            best: dict[tuple[int, int], float] = {}
            for low in range(0, len(own.owner), BATCH // 4):
                p, q = np.nonzero(own.vectors[low : low + BATCH // 4] @ items.vectors.T >= MEANT)
                for i, j in zip((p + low).tolist(), q.tolist()):
                    mine, theirs = own[i], items[j]
                    if len(answers[j].intersection(mine)) < ANSWER * len(answers[j]):
                        continue
                    kept = common_subsequence(theirs, mine) / len(theirs)
                    key = int(own.owner[i]), int(items.owner[j])
                    if kept >= KEPT and kept > best.get(key, 0.0):
                        best[key] = kept
            rows = [(doc_ids[o], i, kept) for (o, t), kept in sorted(best.items()) for i in ids[t]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64())], names=["doc_id", "question_id", "kept"])

    return run
