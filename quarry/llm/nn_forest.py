"""Most similar vectors of every vector, by a forest of sorted hash strings.

Method: hash-prefix forest. Each tree gives a vector a string of DEPTH bits (the sides of random planes) and
keeps all strings in one sorted array. In such an array the longest-prefix matches of a string are its
neighbours, and ascending to shorter prefixes means walking further from it, in all trees by the same number
of places at once: the descent of variable length and the synchronous ascent are one window of REACH places. In a
collection n such a window covers prefixes of log2(n / REACH) bits, so the ascent ends at longer prefixes the larger the
collection is; trees are added for that, until a pair at the least similarity meets in one of them with probability
1 - MISSED. They are sorted and compared in passes of PASS trees, so that what lies on disk does not grow with them.
Rows of a window are compared in blocks on vectors quantised to 8 bits; pairs near the least similarity go on,
and are measured exactly on the full vectors.

A window does not settle a row whose window is crowded: near rows go on beyond its ends, and 8 bits cannot rank
those in it. Such rows ascend to the root: they are gathered in cells around pivots, and every row that the
triangle inequality leaves within reach of a cell is compared with all of it on the full vectors, so their
lists are exact however many rows share their prefixes. This part is quadratic in a dense group.

Usable vectors have `size` finite numbers that are not all zero; others give no row. Vectors of equal direction
form one class and are hashed once; the smallest ids stand for it. Cosines are rounded to 6 decimals, ties go to the
smaller id, and a row with fewer than k partners keeps those it has. Repeated rows of an id count once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.base import cut, sent_if_small

#: Trees at least, trees of one pass, and bits of a string.
TREES, PASS, DEPTH = 16, 16, 63
REACH = 512
#: Share of the pairs at the least similarity that all trees together may miss, by the probability of a common prefix.
MISSED = 0.05
#: Ids that are broadcast to vectors, at most (about 30 MB); more meet them by a shuffle.
SENT_IDS = 1_000_000
#: Cosine that the 8-bit vectors may be off.
SLACK = 0.01
#: A row is crowded if a tree shows it more than k + SPARE partners, or more than CROWD rows within NEAR below the least similarity.
SPARE, CROWD, NEAR = 11, 64, 0.15
#: Crowded rows of a cell on average, cells at least and at most, and crowded rows held by one task.
CELL, CELLS, HELD = 8192, (8, 128), 65_536


def usable(df: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """(id, v) of the usable vectors; tested in the JVM."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where((F.size(v) == size) & finite & F.exists(v, lambda x: x != 0)).select(F.col(key).alias("id"), v.cast("array<float>").alias("v"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64)


def _scaled(column: pa.Array, size: int) -> np.ndarray:
    x = _matrix(column, size)
    return x / np.abs(x).max(axis=1, keepdims=True)


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.round((x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1)), 6)


def _units(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def trees_for(n: int, least: float) -> int:
    """Trees for n vectors: two at the least similarity lie on one side of a random plane with probability 1 - angle / pi."""
    shared = (1 - math.acos(least) / math.pi) ** max(0.0, math.log2(max(1, n) / REACH))
    return TREES if shared >= 1 else max(TREES, math.ceil(math.log(MISSED) / math.log(1 - shared)))


def _hash(reps: DataFrame, size: int, first: int, many: int) -> DataFrame:
    """(id, q, strings): the vector in 8 bits, and its string in each of `many` trees from the first on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(7 + first).standard_normal((size, many * DEPTH)).astype(np.float32)
        weight = (1 << np.arange(DEPTH - 1, -1, -1, dtype=np.int64))
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                x = _matrix(part.column(1), size)
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                side = ((x.astype(np.float32) @ planes) > 0).reshape(len(x), many, DEPTH)
                strings = np.zeros((len(x), many), np.int64)
                for k in range(DEPTH):
                    strings |= side[:, :, k] * weight[k]
                q = np.rint(x * (127 / np.abs(x).max(axis=1, keepdims=True))).astype(np.int8)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([r.tobytes() for r in q], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(0, strings.size + 1, many, dtype=np.int32)), pa.array(strings.ravel()))],
                    names=["id", "q", "strings"],
                )

    return reps.select("id", "v").mapInArrow(run, "id long, q binary, strings array<long>")


def _windows(hashed: DataFrame, size: int, k: int, least: float) -> DataFrame:
    """Candidate (id_a, id_b) from all trees; a crowded row stands as a pair with itself. The arrays are range-partitioned by (tree, string, id); a window is
    cut only at the few edges between partitions, where the other trees stand in."""
    rows = hashed.select("id", "q", F.posexplode("strings").alias("tree", "string"))
    arrays = rows.repartitionByRange("tree", "string", "id").sortWithinPartitions("tree", "string", "id")
    keep = k + SPARE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, trees, x = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros((0, size), np.float32)

        def compare(own: int):
            """Pairs of the first `own` rows with the rows within REACH places after them."""
            a, b = [], []
            for i in range(0, own, REACH):
                hi = min(i + REACH, own)
                end = min(hi + REACH, len(ids))
                cos = x[i:hi] @ x[i:end].T
                p, q = np.nonzero(cos >= least - NEAR)
                score = cos[p, q]
                ok = (q > p) & (q - p <= REACH) & (trees[p + i] == trees[q + i]) & (ids[p + i] != ids[q + i])
                p, q, partner = p[ok], q[ok], score[ok] >= least - SLACK
                crowded = np.zeros(end - i, bool)
                for side in (p, q):
                    crowded |= np.bincount(side, minlength=end - i) > CROWD
                    crowded |= np.bincount(side[partner], minlength=end - i) > keep
                partner &= ~(crowded[p] & crowded[q])
                own_ids = ids[i:end]
                a += [own_ids[p[partner]], own_ids[crowded]]
                b += [own_ids[q[partner]], own_ids[crowded]]
            if a and sum(map(len, a)):
                m, n = np.concatenate(a), np.concatenate(b)
                pair = np.unique(np.stack([np.minimum(m, n), np.maximum(m, n)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["id_a", "id_b"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            new = np.frombuffer(b"".join(t["q"].to_pylist()), np.int8).reshape(-1, size).astype(np.float32)
            new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-9)
            ids = np.concatenate([ids, t["id"].to_numpy()])
            trees = np.concatenate([trees, t["tree"].to_numpy().astype(np.int32)])
            x = np.concatenate([x, new])
            if (own := (len(ids) - REACH) // REACH * REACH) > 0:
                yield from compare(own)
                ids, trees, x = ids[own:], trees[own:], x[own:]
        if len(ids):
            yield from compare(len(ids))

    return arrays.select("id", "q", "tree").mapInArrow(run, "id_a long, id_b long").distinct()


def _measured(pairs: DataFrame, rows: DataFrame, size: int, least: float) -> DataFrame:
    """(id_a, id_b, cosine) of the pairs that reach the least similarity on the full vectors."""
    ends = pairs.select(F.col("id_a").alias("id")).union(pairs.select(F.col("id_b").alias("id"))).distinct()
    own = cut(rows.join(ends, "id", "left_semi").select("id", "v").dropDuplicates(["id"]))  # vectors without a candidate move no further
    both = pairs.join(own.withColumnsRenamed({"id": "id_a", "v": "x"}), "id_a").join(own.withColumnsRenamed({"id": "id_b", "v": "y"}), "id_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cos = _cosines(_scaled(batch.column(2), size), _scaled(batch.column(3), size))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cos)], names=["id_a", "id_b", "cosine"]).filter(pa.array(cos >= least))

    return both.select("id_a", "id_b", "x", "y").mapInArrow(run, "id_a long, id_b long, cosine double")


class Best:
    """The `keep` most similar of all rows seen, for each of some rows; ties go to the smaller id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, keep: int, least: float):
        self.ids, self.x, self.unit, self.keep, self.least = ids, x, _units(x), keep, least
        self.floor = np.full(len(ids), least - 1e-5, np.float32)
        self.row, self.other, self.cosine = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def see(self, ids: np.ndarray, y: np.ndarray) -> None:
        unit = _units(y)
        for lo in range(0, len(self.ids), 1024):
            for at in range(0, len(ids), 4096):
                cos = self.unit[lo : lo + 1024] @ unit[at : at + 4096].T
                cos[self.ids[lo : lo + 1024, None] == ids[None, at : at + 4096]] = -2
                full = np.flatnonzero((cos >= self.floor[lo : lo + 1024, None]).sum(axis=1) > 4 * self.keep)
                if len(full):
                    kth = np.partition(cos[full], -self.keep, axis=1)[:, -self.keep]
                    # 32 bits and the rounding to 6 decimals move a cosine by less than this
                    self.floor[lo + full] = np.maximum(self.floor[lo + full], kth - np.float32(5e-6))
                p, q = np.nonzero(cos >= self.floor[lo : lo + 1024, None])
                for cut_at in range(0, len(p), 200_000):
                    self._take(p[cut_at : cut_at + 200_000] + lo, ids[q[cut_at : cut_at + 200_000] + at], y[q[cut_at : cut_at + 200_000] + at])

    def _take(self, row: np.ndarray, other: np.ndarray, y: np.ndarray) -> None:
        cosine = _cosines(self.x[row], y)
        ok = cosine >= self.least
        row, other, cosine = row[ok], other[ok], cosine[ok]
        touched = np.zeros(len(self.ids), bool)
        touched[row] = True
        mine = touched[self.row]
        row, other, cosine = np.concatenate([self.row[mine], row]), np.concatenate([self.other[mine], other]), np.concatenate([self.cosine[mine], cosine])
        order = np.lexsort((other, -cosine, row))
        row, other, cosine = row[order], other[order], cosine[order]
        begin = np.searchsorted(row, row)
        place = np.arange(len(row)) - begin
        last = place == self.keep - 1
        self.floor[row[last]] = np.maximum(self.floor[row[last]], (cosine[last] - 5e-6).astype(np.float32))
        best = place < self.keep
        self.row, self.other, self.cosine = np.concatenate([self.row[~mine], row[best]]), np.concatenate([self.other[~mine], other[best]]), np.concatenate([self.cosine[~mine], cosine[best]])


def _searched(reps: DataFrame, crowded: DataFrame, n: int, size: int, keep: int, least: float) -> DataFrame:
    """(id_a, id_b, cosine), the smaller id first: the `keep` most similar rows of each of the n crowded ones, exactly."""
    dense = cut(reps.join(crowded, "id", "left_semi").dropDuplicates(["id"]))
    pivots = np.array([r.v for r in dense.orderBy(F.xxhash64("id"), "id").limit(min(max(-(-n // CELL), CELLS[0]), CELLS[1])).collect()], np.float64)
    pivots = pivots / np.abs(pivots).max(axis=1, keepdims=True)
    pivots = pivots / np.linalg.norm(pivots, axis=1, keepdims=True)

    def angles(column: pa.Array) -> np.ndarray:
        x = _scaled(column, size)
        return np.arccos(np.clip((x / np.linalg.norm(x, axis=1, keepdims=True)) @ pivots.T, -1, 1))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = angles(batch.column(1))
            cell = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(far)), cell])], names=["id", "v", "cell", "far"])

    placed = cut(dense.select("id", "v").mapInArrow(place, "id long, v array<float>, cell int, far double"))
    cells = {r.cell: (r.far, -(-r.n // HELD)) for r in placed.groupBy("cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect()}
    numbers = np.array(sorted(cells))
    reach = np.array([cells[c][0] for c in numbers]) + np.arccos(least) + 1e-3
    parts = F.element_at(F.array(*[F.lit(cells.get(c, (0, 1))[1]) for c in range(len(pivots))]), F.col("cell") + 1)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                some = batch.slice(low, 1000)
                row, cell = np.nonzero(angles(some.column(1))[:, numbers] <= reach)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([some.column(0).take(at), some.column(1).take(at), pa.array(numbers[cell].astype(np.int32))], names=["id", "v", "cell"])

    held = placed.select("id", "v", "cell", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), F.lit(0).alias("kind"))
    seen = reps.select("id", "v").mapInArrow(route, "id long, v array<float>, cell int")
    seen = seen.select("id", "v", "cell", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))).alias("part"), F.lit(1).alias("kind"))
    sides = held.unionByName(seen).repartition("cell", "part").sortWithinPartitions("cell", "part", "kind", "id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, best = None, [], None

        def lists():
            if best is not None and len(best.row):
                own = best.ids[best.row]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(own, best.other)), pa.array(np.maximum(own, best.other)), pa.array(best.cosine)], names=["id_a", "id_b", "cosine"])

        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in (0, 1, 2)], axis=1)
            bounds = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1), len(key)]
            ids, x = batch.column(3).to_numpy(), _scaled(batch.column(4), size)
            for lo, hi in zip(bounds, bounds[1:]):
                if lo == hi:
                    continue
                if (mine := tuple(key[lo, :2])) != now:
                    yield from lists()
                    now, waiting, best = mine, [], None
                if key[lo, 2] == 0:
                    waiting.append((ids[lo:hi], x[lo:hi]))
                    continue
                if best is None:
                    best = Best(np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting]), keep, least)
                    waiting = []
                best.see(ids[lo:hi], x[lo:hi])
        yield from lists()

    return sides.select("cell", "part", "kind", "id", "v").mapInArrow(search, "id_a long, id_b long, cosine double")


def nearest(df: DataFrame, key: str = "id", vector: str = "embedding", size: int = 64, k: int = 5, least: float = 0.9) -> DataFrame:
    """(id, other, cosine, rank): the k most similar rows, of at least the similarity, of every usable row."""
    rows = usable(df, key, vector, size)
    # -0.0 and 0.0 are one number, and quotients of floats are equal as doubles only if they are equal;
    # 128-bit hashes stand for directions, so that classes are found on narrow rows
    largest = F.array_max(F.transform("v", lambda x: F.abs(x))).cast("double")
    same = F.transform(F.array(largest), lambda m: F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x.cast("double") / m)))
    both = F.transform(same, lambda s: F.struct(F.xxhash64(s).alias("h1"), F.xxhash64(F.lit(1), s).alias("h2")))[0]
    keyed = rows.select("id", both.alias("h")).select("id", "h.h1", "h.h2").distinct()
    classes = keyed.groupBy("h1", "h2").agg(F.min("id").alias("rep"))
    member = cut(keyed.join(classes, ["h1", "h2"]).select("id", "rep"))
    copies = sent_if_small(member.where("id <> rep").select("id"), SENT_IDS)
    reps = rows.join(copies, "id", "left_anti")
    all_trees = trees_for(member.where("id = rep").count(), least)
    found = None
    for first in range(0, all_trees, PASS):
        one = cut(_windows(cut(_hash(reps, size, first, min(PASS, all_trees - first))), size, k, least))
        found = one if found is None else cut(found.unionByName(one).distinct())
    close = _measured(found.where("id_a <> id_b"), rows, size, least)
    crowded = found.where("id_a = id_b").select(F.col("id_a").alias("id"))
    if n := crowded.count():
        close = cut(close.unionByName(_searched(reps, crowded, n, size, k + 1, least)).dropDuplicates(["id_a", "id_b"]))
    both = close.unionByName(close.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"), "cosine"))

    # the k + 1 smallest ids of a class stand for it: no row needs more of them
    first = Window.partitionBy("rep").orderBy("id")
    few = member.select("rep", "id").withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).drop("r")
    own = few.select("rep", F.col("id").alias("other"), F.lit(1.0).alias("cosine"))
    near = both.join(few.withColumnsRenamed({"rep": "id_b", "id": "other"}), "id_b").select(F.col("id_a").alias("rep"), "other", "cosine")
    best = Window.partitionBy("rep").orderBy(F.desc("cosine"), "other")
    listed = own.unionByName(near).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    lists = listed.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("r", "other", "cosine"))).alias("all"))
    per_row = member.select("id", "rep").join(lists, "rep").select("id", F.expr("slice(filter(all, x -> x.other <> id), 1, %d)" % k).alias("top"))
    return per_row.select("id", F.posexplode("top").alias("at", "x")).select("id", "x.other", "x.cosine", (F.col("at") + 1).alias("rank"))


def pairs(top: DataFrame) -> DataFrame:
    """Unordered distinct (id_a, id_b) of nearest()."""
    return top.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
