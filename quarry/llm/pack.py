"""Packing of items of varying length into containers of fixed capacity, group by group.

Method: pattern packing by non-negative least squares. Only a group's histogram of lengths (at most
capacity + 1 rows, however many items) is packed. Patterns, the lengths of one nearly full container, are enumerated
around each length of the histogram: random lengths fill most of a container, and a pair or a single length closes it
as exactly as may be. Their repeat counts are fitted to the histogram by non-negative least squares (an active set, so
few patterns have a count), rounded to what the histogram holds, the largest first, and patterns are enumerated and
fitted again for what is left, until none wastes little; the rest is packed best-fit. Patterns of up to PATTERN
lengths are fitted together; longer histograms are dealt into parts that each span all sizes.

The plan says which ranks of a length go into which containers, and items join it by their rank, so no group is
gathered in a task. Plain best fit is kept instead where it needs fewer containers, which happens in small groups.

Lengths of null are counted from the text, negative ones count as 0; items longer than the capacity
fill whole containers and leave one rest, packed like an item. Repeated rows count once. Items of a
null group form a group of their own.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.base import cores, cut, n_tokens

#: Share of the capacity that a pattern may leave unused.
WASTE = 0.005
#: Patterns tried around each length, and lengths whose patterns are fitted together.
TRIED, PATTERN = 4, 256
#: Share of the largest fitted count below one from which counts are rounded up.
UP = 0.5
#: Fits of one histogram at most; what they leave is packed best-fit.
FITS = 24
#: Blocks among which the rank of equal items is counted, so that no length is ranked in one task.
RANK_BLOCKS = 64


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-7) -> np.ndarray:
    """x >= 0 with the least |a x - b|, by an active set: columns enter where the gradient is steepest, several at a time while
    their number grows, and leave where the least squares solution of the set turns negative."""
    gram, target = a.T @ a, a.T @ b
    x, held, idle = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool), np.zeros(a.shape[1], bool)
    many, least = 8, float(b @ b)
    for _ in range(6 * a.shape[1] + 10):
        steep = np.where(held | idle, -np.inf, target - gram @ x)
        top = steep.max(initial=-np.inf)
        if top <= tolerance * max(1.0, np.abs(target).max()):
            break
        enter = np.argsort(-steep, kind="stable")[:many]
        enter = enter[steep[enter] >= 0.5 * top]
        held[enter] = True
        while held.any():
            own = np.flatnonzero(held)
            s = np.linalg.solve(gram[np.ix_(own, own)] + 1e-9 * np.eye(len(own)), target[own])
            if (s > 0).all():
                x[:] = 0
                x[own] = s
                break
            low = s <= 0
            step = (x[own[low]] / np.maximum(x[own[low]] - s[low], 1e-12)).min()
            x[own] += step * (s - x[own])
            held[own[low & (x[own] <= 1e-9)]] = False
            x[~held] = 0
        off = float(((a @ x - b) ** 2).sum())
        if off < least * (1 - 1e-9):
            many, least, idle[:] = 8, off, False
        else:  # columns that bring nothing now wait until another one has
            idle[enter] |= many == 1
            many = 1
    return np.maximum(x, 0)


def patterns(lengths: np.ndarray, counts: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Distinct patterns, rows of times per length, that leave at most WASTE of the capacity and hold no more than there is."""
    n, rows = len(lengths), np.repeat(np.arange(len(lengths)), TRIED)
    way = np.tile(np.arange(TRIED), n)  # 0: the largest that fits, again and again; 1: a pair at once; else random lengths, then a pair
    used = np.zeros((len(rows), n), np.int64)
    used[np.arange(len(rows)), rows] = 1
    room = capacity - lengths[rows]
    close = 2.5 * float((lengths * counts).sum() / counts.sum())
    i, j = np.triu_indices(n)
    both = i != j
    both |= counts[i] > 1
    i, j = i[both], j[both]
    order = np.argsort(lengths[i] + lengths[j], kind="stable")
    i, j, sums = i[order], j[order], (lengths[i] + lengths[j])[order]

    def add(at: np.ndarray, which: np.ndarray) -> None:
        np.add.at(used, (at, which), 1)
        np.subtract.at(room, at, lengths[which])

    weight = np.log(np.maximum(counts, 1)) + 1
    while True:
        at = np.flatnonzero((room > close) & (way > 1))
        fits = (lengths <= room[at, None]) & (used[at] < counts)
        at, fits = at[fits.any(axis=1)], fits[fits.any(axis=1)]
        if not len(at):
            break
        add(at, (rng.random(fits.shape) * weight * fits).argmax(axis=1))
    if len(sums):
        at = np.flatnonzero(way > 0)
        for back in range(4):  # the best pair that is still there
            k = np.searchsorted(sums, room[at], "right") - 1 - back
            at, k = at[k >= 0], k[k >= 0]
            free = (used[at, i[k]] + (i[k] == j[k]) < counts[i[k]]) & (used[at, j[k]] < counts[j[k]]) & (room[at] - sums[k] <= WASTE * capacity)
            add(at[free], i[k[free]])
            add(at[free], j[k[free]])
            at = at[~free]
    while True:  # and single lengths, the largest first; what is nearly full stays so, but for one way in four
        fits = (lengths <= room[:, None]) & (used < counts) & ((room > WASTE * capacity) | (way == TRIED - 1))[:, None]
        at = np.flatnonzero(fits.any(axis=1))
        if not len(at):
            break
        add(at, (fits[at] * lengths).argmax(axis=1))
    good = room <= WASTE * capacity
    return np.unique(used[good], axis=0)


def pack_histogram(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[list[tuple[dict[int, int], int]], int]:
    """Containers as (pattern, repeats) for a histogram of lengths from 1 to capacity, and how many of them are fitted patterns."""
    left, rng = counts.astype(np.int64).copy(), np.random.default_rng(len(lengths))
    out: list[tuple[dict[int, int], int]] = []
    for _ in range(FITS):
        here = np.flatnonzero(left)
        before = len(out)
        if (lengths * left).sum() <= capacity:
            break
        for part in range(-(-len(here) // PATTERN)):
            own = here[part :: -(-len(here) // PATTERN)]
            tried = patterns(lengths[own], left[own], capacity, rng)
            if not len(tried):
                continue
            fit = nnls(tried.T.astype(float), left[own].astype(float))
            whole = np.floor(fit + 1e-6)
            # counts below one are rounded up only where no other is left, the largest of them
            whole = whole if whole.any() else (fit >= UP * fit.max()).astype(float)
            for k in np.argsort(-fit, kind="stable"):
                if whole[k] < 1:
                    continue
                some = tried[k] > 0
                times = min(int(whole[k]), int((left[own][some] // tried[k][some]).min()))
                if times > 0:
                    left[own] -= tried[k] * times
                    out.append((dict(zip(lengths[own][some].tolist(), tried[k][some].tolist())), times))
        if len(out) == before:
            break
    return out + best_fit(dict(zip(lengths.tolist(), left.tolist())), capacity), len(out)


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over a histogram: each container is filled by the largest lengths that fit, and
    repeated as often as the histogram allows."""
    left = {x: n for x, n in left.items() if n > 0}
    out = []
    while left:
        room, held = capacity, {}
        for x in sorted(left, reverse=True):
            if x <= room:
                held[x] = min(room // x, left[x])
                room -= x * held[x]
        times = min(left[x] // m for x, m in held.items())
        out.append((held, times))
        for x, m in held.items():
            left[x] -= m * times
            if not left[x]:
                del left[x]
    return out


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, last rank, first container, items of the length per container)."""
    zero = int(counts[lengths == 0].sum())
    real = lengths > 0
    lengths, counts = lengths[real], counts[real]
    used = pack_histogram(lengths, counts, capacity)[0] if len(lengths) else []
    if len(lengths) and sum(t for _, t in used) > -(-int((lengths * counts).sum()) // capacity):
        plain = best_fit(dict(zip(lengths.tolist(), counts.tolist())), capacity)
        used = min(used, plain, key=lambda u: sum(t for _, t in u))
    runs, rank, container = [], dict.fromkeys(lengths.tolist(), 0), 0
    for held, times in used:
        for x, m in held.items():
            runs.append((x, rank[x], rank[x] + m * times - 1, container, m))
            rank[x] += m * times
        container += times
    return ([(0, 0, zero - 1, 0, zero)] if zero else []) + runs


def items(atoms: DataFrame, capacity: int) -> DataFrame:
    """(grp, item_id, n, whole, part): each item once, with its length, the whole containers it fills and
    the length that is left to pack (null when none)."""
    atoms = atoms.select("filing_stem", "atom_id", "tokens", "text")
    n = F.greatest(F.coalesce(F.col("tokens").cast("long"), n_tokens("text").cast("long")), F.lit(0))
    one = atoms.select(F.col("filing_stem").alias("grp"), F.col("atom_id").alias("item_id"), n.alias("n")).distinct()
    whole = F.when(F.col("n") > capacity, F.floor(F.col("n") / capacity)).otherwise(0).cast("long")
    part = F.col("n") - F.col("whole") * capacity
    return one.withColumn("whole", whole).withColumn("part", F.when((F.col("whole") == 0) | (part > 0), part).cast("int"))


def _ranked(df: DataFrame) -> DataFrame:
    """Rank from 0 of each item within (grp, part), in two steps: within a block, then the blocks' offsets."""
    keys = ["grp", "part", "block"]
    df = df.withColumn("block", F.pmod(F.xxhash64("item_id", "n"), F.lit(RANK_BLOCKS)).cast("int"))
    before = F.sum("in_block").over(Window.partitionBy("grp", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("in_block")).select(*keys, F.coalesce(before, F.lit(0)).alias("offset"))
    within = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("item_id", "n")) - 1)
    on = [within[k].eqNullSafe(offsets[k]) for k in keys]
    return within.join(offsets, on).select(within["*"], (F.col("rank") + F.col("offset")).alias("r")).drop("rank", "block")


def pack(atoms: DataFrame, capacity: int = 1500) -> DataFrame:
    """(filing_stem, atom_id, piece_no, container, n_tokens): each item, or each piece of an oversized one
    (the pieces before the last hold capacity tokens each), with its container, numbered from 0."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    one = cut(items(atoms, capacity))  # read five times below
    packed = one.where(F.col("part").isNotNull())
    histogram = packed.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("items"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        h = pdf.sort_values("part")
        runs = plan(h["part"].to_numpy(np.int64), h["items"].to_numpy(np.int64), capacity)
        out = pd.DataFrame(runs, columns=["part", "low", "high", "base", "each"])
        out.insert(0, "grp", pdf["grp"].iloc[0])
        return out

    # histograms are few bytes but much work: groups are spread over the cores, not by their size
    spread_out = histogram.repartition(4 * cores(atoms.sparkSession), "grp")
    plans = cut(spread_out.groupBy("grp").applyInPandas(solve, "grp string, part int, low long, high long, base long, each long"))
    ranked = _ranked(packed)
    fits = ranked.grp.eqNullSafe(plans.grp) & (ranked.part == plans.part) & (ranked.r >= plans.low) & (ranked.r <= plans.high)
    container = plans.base + F.floor((ranked.r - plans.low) / plans.each)
    placed = ranked.join(plans, fits).select(ranked.grp, ranked.item_id, ranked.whole.cast("int").alias("piece_no"), container.cast("long").alias("container"), ranked.part.alias("n_tokens"))

    # whole containers of oversized items come after the packed ones; their first numbers are running sums
    last = plans.groupBy("grp").agg(F.max(F.col("base") + F.ceil((F.col("high") - F.col("low") + 1) / F.col("each"))).alias("packed"))
    big = one.where("whole > 0").withColumn("block", F.pmod(F.xxhash64("item_id", "n"), F.lit(RANK_BLOCKS)).cast("int"))
    sums = big.groupBy("grp", "block").agg(F.sum("whole").alias("in_block"))
    sums = sums.withColumn("offset", F.coalesce(F.sum("in_block").over(Window.partitionBy("grp").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("in_block")
    inside = F.coalesce(F.sum("whole").over(Window.partitionBy("grp", "block").orderBy("item_id", "n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    big = big.withColumn("inside", inside)
    big = big.join(sums, big.grp.eqNullSafe(sums.grp) & (big.block == sums.block)).select(big["*"], "offset")
    big = big.join(last, big.grp.eqNullSafe(last.grp), "left").select(big["*"], "offset", F.coalesce("packed", F.lit(0)).alias("packed"))
    big = big.select("grp", "item_id", "packed", "offset", "inside", F.explode(F.sequence(F.lit(0), (F.col("whole") - 1).cast("int"))).alias("piece_no"))
    filled = big.select("grp", "item_id", "piece_no", (F.col("packed") + F.col("offset") + F.col("inside") + F.col("piece_no")).alias("container"), F.lit(capacity).alias("n_tokens"))
    return placed.unionByName(filled).withColumnsRenamed({"grp": "filing_stem", "item_id": "atom_id"})


def containers(packed: DataFrame) -> DataFrame:
    """(filing_stem, container, n_items, n_tokens) of each resulting container."""
    return packed.groupBy("filing_stem", "container").agg(F.count(F.lit(1)).alias("n_items"), F.sum("n_tokens").alias("n_tokens"))
