"""Radius joins of strings under the edit distance, by metric-space partitioning.

Each string is assigned to its nearest pivot. A form within distance r of a string of the pivot's cell lies at
most 2 r further from that pivot than from its own nearest one (triangle inequality, twice), so a form is
replicated to just these cells. A cell is divided into rings of equal distance from the pivot, and a form goes to
the rings whose distance differs from its own by at most r (triangle inequality again). Rings are counted, and one
with many strings or forms is cut into parts by hash, each pair of parts being compared on its own, so that a task
holds a bounded number of either however large both sides are. Inside a part letter sets and letter counts, in which
an edit changes two at most, leave few pairs, and these are measured by the Levenshtein distance, a true metric.

Pivots are chosen from at most SAMPLE forms; the join is exact whichever they are. Strings longer than every form by
more than the radius can be within none and are left out. Nulls and empty strings join nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.base import cores, cut, whole_runs

#: Pivots, and forms among which they are chosen.
PIVOTS, SAMPLE = 24, 2000
#: Strings and forms of a ring that are compared in one part, at most on average.
MANY_NAMES, MANY_FORMS = 8192, 4096
#: Cells of a distance table that are computed at once, and pairs measured at once.
TABLE, PAIRS = 1 << 19, 1 << 15


def coded(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Strings as rows of code points, padded with zeros, and their lengths."""
    sizes = np.fromiter(map(len, strings), np.int64, count=len(strings))
    codes = np.zeros((len(strings), int(sizes.max(initial=0))), np.int32)
    for i, s in enumerate(strings):
        codes[i, : len(s)] = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.int32)
    return codes, sizes


def _next_row(row: np.ndarray, differs: np.ndarray, i: int, steps: np.ndarray) -> np.ndarray:
    """Row i of the distance tables: replaced or deleted first, then insertions as a running minimum."""
    new = np.empty_like(row)
    new[:, 0] = i
    np.minimum(row[:, :-1] + differs, row[:, 1:] + 1, out=new[:, 1:])
    new -= steps
    np.minimum.accumulate(new, axis=1, out=new)
    new += steps
    return new


def levenshtein(codes: np.ndarray, sizes: np.ndarray, form: str) -> np.ndarray:
    """Edit distance of each coded string to a form."""
    steps = np.arange(codes.shape[1] + 1, dtype=np.int32)
    row = np.tile(steps, (len(codes), 1))
    for i, c in enumerate(map(ord, form), 1):
        row = _next_row(row, codes != c, i, steps)
    return row[np.arange(len(codes)), sizes]


def _by_bits(letter: np.ndarray, known: np.ndarray, longer: np.ndarray, form: str) -> np.ndarray:
    """Edit distances of strings to a form of up to 63 letters, a column of the distance table in the bits of a word (the method of
    Myers). letter has a row for each place of the strings, as numbers of `known` code points; longer tells how many strings,
    which are in order, go on beyond each place."""
    one, last = np.uint64(1), np.uint64(len(form) - 1)
    at: dict[int, int] = {}
    for i, c in enumerate(map(ord, form)):
        at[c] = at.get(c, 0) | 1 << i
    bits = np.array([at.get(c, 0) for c in known.tolist()], np.uint64)
    n = letter.shape[1]
    up, down, out = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64), np.full(n, len(form), np.int32)
    for i, many in enumerate(longer):
        equal, u, d = bits[letter[i, :many]], up[:many], down[:many]
        across = (((equal & u) + u) ^ u) | equal
        plus, minus = d | ~(across | u), u & across
        out[:many] += ((plus >> last) & one).astype(np.int32)
        out[:many] -= ((minus >> last) & one).astype(np.int32)
        plus, minus = (plus << one) | one, minus << one
        either = equal | d
        up[:many] = minus | ~(either | plus)
        down[:many] = plus & either
    return out


def distance(a: str, b: str) -> int:
    """Edit distance of two strings, by bits of one number."""
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, last, out = (1 << len(a)) - 1, len(a) - 1, len(a)
    up, down = full, 0
    for c in b:
        equal = at.get(c, 0)
        across = (((equal & up) + up) ^ up) | equal
        plus, minus = (down | ~(across | up)) & full, up & across
        out += (plus >> last & 1) - (minus >> last & 1)
        plus, minus, either = (plus << 1 | 1) & full, minus << 1 & full, equal | down
        up, down = (minus | ~(either | plus)) & full, plus & either
    return out


def distances(strings: list[str], forms: list[str]) -> np.ndarray:
    """Edit distances, strings x forms; strings of like lengths at once, so that padding stays small."""
    size = np.fromiter(map(len, strings), np.int64, count=len(strings))
    out = np.zeros((len(strings), len(forms)), np.int32)
    order, at = np.argsort(-size, kind="stable"), 0
    while at < len(order):
        rows = order[at : at + max(1, TABLE // (int(size[order[at]]) + 1))]
        codes, sizes = coded([strings[i] for i in rows])
        known, letter = np.unique(codes.T, return_inverse=True)
        letter = letter.reshape(codes.T.shape)
        longer = [int(np.searchsorted(-sizes, -i)) for i in range(codes.shape[1])]
        for k, f in enumerate(forms):
            out[rows, k] = _by_bits(letter, known, longer, f) if 0 < len(f) < 64 else levenshtein(codes, sizes, f)
        at += len(rows)
    return out


def pair_distances(a: list[str], b: list[str]) -> np.ndarray:
    """Edit distance of a[i] and b[i], for all i at once."""
    codes, sizes = coded(a)
    other, lengths = coded(b)
    steps = np.arange(codes.shape[1] + 1, dtype=np.int32)
    row, out, at = np.tile(steps, (len(a), 1)), sizes.astype(np.int32), np.arange(len(a))
    for i in range(1, other.shape[1] + 1):
        row = _next_row(row, codes != other[:, i - 1 : i], i, steps)
        ends = lengths == i
        out[ends] = row[at[ends], sizes[ends]]
    return out


def letters(codes: np.ndarray) -> np.ndarray:
    """Counts of characters by their code modulo 32."""
    out = np.zeros((len(codes), 32), np.int32)
    for j in range(codes.shape[1]):
        used = codes[:, j] > 0
        out[np.flatnonzero(used), codes[used, j] % 32] += 1
    return out


def choose_pivots(forms: list[str], n: int = PIVOTS) -> list[str]:
    """Forms far from each other, greedily."""
    forms = sorted(set(forms))
    if not forms:
        return []
    pivots = [forms[0]]
    least = distances(forms, pivots)[:, 0]
    while len(pivots) < min(n, len(forms)) and least.max() > 0:
        pivots.append(forms[int(least.argmax())])
        least = np.minimum(least, distances(forms, pivots[-1:])[:, 0])
    return pivots


def within(names: list[str], forms: list[str], radius: np.ndarray) -> list[tuple[str, str, int]]:
    """(name, form, distance) of all pairs within the forms' radii."""
    (codes, sizes), (form_codes, form_sizes) = coded(names), coded(forms)
    bags, form_bags = letters(codes), letters(form_codes)
    bit = np.uint32(1) << np.arange(32, dtype=np.uint32)
    masks, form_masks = ((b > 0).astype(np.uint32) @ bit for b in (bags, form_bags))
    out: list[tuple[str, str, int]] = []
    for low in range(0, len(forms), max(1, TABLE // max(1, len(names)))):
        part = slice(low, low + max(1, TABLE // max(1, len(names))))
        r = radius[part]
        near = (np.abs(sizes[:, None] - form_sizes[part]) <= r) & (np.bitwise_count(masks[:, None] ^ form_masks[part]) <= 2 * r)
        i, j = np.nonzero(near)
        for a in range(0, len(i), PAIRS):
            x, y = i[a : a + PAIRS], j[a : a + PAIRS] + low
            few = np.abs(bags[x] - form_bags[y]).sum(axis=1) <= 2 * radius[y]
            x, y = x[few], y[few]
            if len(x):
                d = pair_distances([names[k] for k in x], [forms[k] for k in y])
                out += [(names[x[k]], forms[y[k]], int(d[k])) for k in np.flatnonzero(d <= radius[y])]
    return out


_SIDES = "cell int, ring int, text string, radius int"


def radius_join(strings: DataFrame, forms: DataFrame) -> DataFrame:
    """(name, form, distance): the distinct strings `name` within the radius of each form (form, radius); of several
    radii of one form the largest counts."""
    spark = strings.sparkSession
    forms = cut(forms.where(F.length("form") > 0).groupBy("form").agg(F.max("radius").cast("int").alias("radius")))
    pivots = choose_pivots([r["form"] for r in forms.select("form").orderBy(F.xxhash64("form"), "form").limit(SAMPLE).collect()])
    schema = "name string, form string, distance int"
    if not pivots:
        return spark.createDataFrame([], schema)
    reach = forms.agg(F.max(F.length("form") + F.col("radius"))).first()[0]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d = distances(batch.column(0).to_pylist(), pivots)
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(d.min(axis=1), pa.int32()), batch.column(0), pa.nulls(batch.num_rows, pa.int32())], names=["cell", "ring", "text", "radius"])

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            r = batch.column(1).to_numpy()
            d = distances(batch.column(0).to_pylist(), pivots)
            i, c = np.nonzero(d <= (d.min(axis=1) + 2 * r)[:, None])
            wide = 2 * r[i] + 1
            ring = np.repeat(d[i, c] - r[i], wide) + np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
            i, c = np.repeat(i, wide), np.repeat(c, wide)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(ring, pa.int32()), batch.column(0).take(pa.array(i)), pa.array(r[i], pa.int32())], names=["cell", "ring", "text", "radius"])

    # names and forms are few bytes but much work: they are spread over the cores, not by their size
    tasks = 4 * cores(spark)
    names = strings.select("name").where(F.length("name").between(1, reach)).distinct().repartition(tasks)
    left = cut(names.mapInArrow(assign, _SIDES))
    right = cut(forms.repartition(tasks).mapInArrow(replicate, _SIDES).where("ring >= 0"))
    # a row for each ring: as many as pivots times lengths of forms, whatever the rows on either side
    count = lambda df, most, name: df.groupBy("cell", "ring").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
    parts = F.broadcast(cut(count(left, MANY_NAMES, "p_all").join(count(right, MANY_FORMS, "f_all"), ["cell", "ring"])))
    part = lambda n: F.pmod(F.xxhash64("text"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = ["cell", "ring", "p", "f"]
    left = left.join(parts, ["cell", "ring"]).select("*", part("p_all").alias("p"), every("f_all").alias("f"))
    right = right.join(parts, ["cell", "ring"]).select("*", part("f_all").alias("f"), every("p_all").alias("p"))
    rows = left.select(*key, "text", "radius").unionByName(right.select(*key, "text", "radius"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, edges in whole_runs(batches, 4):
            text, radius, found = t["text"].to_pylist(), t["radius"].to_numpy(zero_copy_only=False), []
            for a, b in zip(edges, edges[1:]):
                is_form = ~np.isnan(radius[a:b].astype(float))
                if is_form.any() and not is_form.all():
                    at = a + np.flatnonzero(is_form)
                    found += within([text[i] for i in a + np.flatnonzero(~is_form)], [text[i] for i in at], radius[at].astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int32()))], names=["name", "form", "distance"])

    return rows.repartition(tasks, *key).sortWithinPartitions(*key).mapInArrow(join, schema)
