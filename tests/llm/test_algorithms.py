"""Packing, near duplicates, nearest vectors and names, each against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import metric_names, name_variants, near_dupes, nn_forest, pack

# ---- packing


def first_fit(items, capacity):
    bins = []
    for x in sorted(items, reverse=True):
        at = next((i for i, v in enumerate(bins) if v + x <= capacity), None)
        if at is None:
            bins.append(x)
        else:
            bins[at] += x
    return len(bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=60))
def test_plan_places_each_item_once_within_capacity(items):
    lengths, counts = np.unique(np.array(items, np.int64), return_counts=True)
    held = defaultdict(int)
    for x, low, high, base, each in pack.plan(lengths, counts, 100):
        for r in range(low, high + 1):
            held[base + (r - low) // each] += x
    placed = sum(high - low + 1 for _, low, high, *_ in pack.plan(lengths, counts, 100))
    assert placed == len(items) and all(v <= 100 for v in held.values())
    assert sorted(held) == list(range(len(held)))
    assert len(held) <= max(first_fit(items, 100), 1)


def test_least_squares_meet_the_conditions_of_an_optimum():
    rng = np.random.default_rng(7)
    for _ in range(20):
        a, b = rng.integers(0, 4, (12, 30)).astype(float), rng.integers(0, 30, 12).astype(float)
        x = pack.nnls(a, b)
        gradient = a.T @ (a @ x - b)
        assert (x >= 0).all() and gradient.min() > -1e-4 and np.abs(gradient[x > 0]).max(initial=0) < 1e-4


def test_patterns_hold_most_items_and_waste_little():
    for low, high, many in ((1, 1500, 20), (300, 1200, 50)):
        lengths = np.arange(low, high + 1)
        used, fitted = pack.pack_histogram(lengths, np.full(len(lengths), many), 1500)
        held = defaultdict(int)
        for p, times in used:
            assert sum(x * m for x, m in p.items()) <= 1500
            for x, m in p.items():
                held[x] += m * times
        assert held == dict.fromkeys(lengths.tolist(), many)
        assert sum(t for _, t in used) <= 1.01 * -(-int(lengths.sum()) * many // 1500)
        assert sum(sum(p.values()) * t for p, t in used[:fitted]) >= 0.9 * len(lengths) * many


def test_pack_rows(spark):
    rng = random.Random(1)
    rows = [(f"f{i % 2}" if i % 5 else "f0", i, rng.choice([None, 10, 40, 60, 90, 250, -3, 0]), " ".join("x" * rng.randrange(0, 9))) for i in range(400)]
    rows += rows[:30] + [(None, 9000, 5, ""), (None, 9001, None, None)]
    got = pack.pack(spark.createDataFrame(rows, "filing_stem string, atom_id long, tokens int, text string"), 100).collect()
    need = {i: (f, max(0, n if n is not None else len((t or "").split()))) for f, i, n, t in rows}
    load, per = defaultdict(int), defaultdict(list)
    for r in got:
        assert r.filing_stem == need[r.atom_id][0]
        load[r.filing_stem, r.container] += r.n_tokens
        per[r.atom_id].append((r.piece_no, r.n_tokens))
    assert set(per) == set(need) and max(load.values()) <= 100
    for i, ps in per.items():
        n = need[i][1]
        assert sum(x for _, x in ps) == n and sorted(k for k, _ in ps) == list(range(len(ps))) and (n > 100 or len(ps) == 1)
    for f in {f for f, _ in need.values()}:
        numbers = sorted(c for g, c in load if g == f)
        own = [n for g, n in need.values() if g == f]
        plain = sum(n // 100 for n in own if n > 100) + first_fit([n % 100 if n > 100 else n for n in own if n <= 100 or n % 100], 100)
        assert numbers == list(range(len(numbers))) and len(numbers) <= max(1, plain)


# ---- near duplicates


def test_near_duplicates_in_passes_of_bands(spark, monkeypatch):
    """Beyond KEYS_AT_ONCE keys no pass holds more than its share of the bands; the links are the same."""
    rng = random.Random(5)
    base = [[rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(50)] for _ in range(5)]
    docs = []
    for i in range(60):
        w = list(base[i % 5])
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = f"x{i}"
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "id long, text string")
    pairs = lambda: {tuple(r) for r in near_dupes.row_pairs(*near_dupes.near_duplicates(df, 0.7, 3, 25)).collect()}
    whole, taken = pairs(), []
    plain = near_dupes._candidates
    monkeypatch.setattr(near_dupes, "_candidates", lambda reps, first, bands, least: taken.append((first, bands)) or plain(reps, first, bands, least))
    monkeypatch.setattr(near_dupes, "KEYS_AT_ONCE", 600)
    assert pairs() == whole and len(whole) > 50
    assert [x for first, bands in taken for x in range(first, first + bands)] == list(range(near_dupes.BANDS))
    assert len(taken) == 3 and all(len(docs) * bands <= 600 for _, bands in taken)


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dupes, "HOT", 8)
    rng = random.Random(2)
    base = [[rng.choice("abcdefghijklmnop") + str(rng.randrange(9)) for _ in range(60)] for _ in range(8)]
    docs = []
    for i in range(160):
        w = list(base[i % 8] if i % 4 else base[0])
        for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], ["new"], ["a1", "b2"]])
        docs.append((i, " ".join(w)))
    docs += [(500, None), (501, ""), (502, "few words only"), (503, docs[0][1].upper()), (504, docs[0][1])]
    df = spark.createDataFrame(docs, "id long, text string")
    links, members = near_dupes.near_duplicates(df, 0.7, 3, 25)
    got = {tuple(r) for r in near_dupes.row_pairs(links, members).collect()}
    sets = {}
    for i, t in docs:
        w = re.findall("[a-z0-9]+", (t or "").lower())
        if len(w) >= 25:
            sets[i] = set(zip(w, w[1:], w[2:]))
    ids = sorted(sets)
    want = {(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    assert got == want and len(want) > 100
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in want:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    groups = {r.id: r.group_id for r in near_dupes.groups(links, members).collect()}
    assert {(a, b) for a in ids for b in ids if a < b and groups[a] == groups[b]} == {(a, b) for a in ids for b in ids if a < b and find(a) == find(b)}


def test_pairs_at_exactly_the_least_similarity(spark):
    """45 shingles each, 40 in common: 40 / 50 is 0.8. Rows of one base make buckets under and over 8 rows."""
    docs, base = [], 0
    for base, many in enumerate([2] * 30 + [12] * 6):
        words = [f"b{base}x{k}" for k in range(44)]
        docs += [(100 * base + i, " ".join([*(f"b{base}y{i}z{k}" for k in range(5)), *words])) for i in range(many)]
    links, members = near_dupes.near_duplicates(spark.createDataFrame(docs, "id long, text string"))
    got = {tuple(r) for r in near_dupes.row_pairs(links, members).collect()}
    assert got == {(a, b) for a, _ in docs for b, _ in docs if a < b and a // 100 == b // 100}
    assert {(r.id, r.group_id) for r in near_dupes.groups(links, members).collect()} == {(a, a // 100 * 100) for a, _ in docs}


# ---- nearest vectors


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 64))
    rows = []
    for i in range(900):
        v = centres[i % 60] + rng.standard_normal(64) * rng.choice([0, 0.05, 0.2, 0.35])
        rows.append((i, [float(x) for x in (v * rng.choice([1, 3])).astype(np.float32)]))
    bad = [(2000, None), (2001, [0.0] * 64), (2002, [1.0] * 63), (2003, [float("nan")] + [1.0] * 63), (2004, [None] + [1.0] * 63), (2005, [float("inf")] * 64)]
    df = spark.createDataFrame(rows + bad, "id long, embedding array<float>")
    got = {(r.id, r.other): r.cosine for r in nn_forest.nearest(df).collect()}
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cos = np.round(x @ x.T, 6)
    want = set()
    for i in range(len(rows)):
        near = sorted((-cos[i, j], j) for j in range(len(rows)) if j != i and cos[i, j] >= 0.9)[:5]
        want |= {(i, j) for _, j in near}
    assert len(want - set(got)) <= 0.02 * len(want)
    assert len(set(got) - want) <= 0.02 * len(want)


def test_trees_grow_with_the_collection(spark, monkeypatch):
    few = [nn_forest.trees_for(n, 0.9) for n in (0, 1000, 150_000, 1_500_000, 40_000_000)]
    assert few[0] == few[1] == nn_forest.TREES and few == sorted(few) and few[-1] > 30
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, (np.ones(64) + rng.standard_normal(64)).tolist()) for i in range(60)], "id long, embedding array<float>")
    want = {tuple(r) for r in nn_forest.nearest(df, least=0.5).collect()}
    monkeypatch.setattr(nn_forest, "PASS", 5)
    assert {tuple(r) for r in nn_forest.nearest(df, least=0.5).collect()} == want and want


def test_nearest_in_a_dense_group_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    n = 12_000
    x = np.concatenate([rng.standard_normal(64) + rng.standard_normal((n - 2000, 64)) * 0.25, rng.standard_normal((2000, 64))]).astype(np.float32)
    x[1:400:4] = x[0:399:4] * 2  # equal directions of another length
    got = {}
    for r in nn_forest.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>")).collect():
        got.setdefault(r.id, {})[r.other] = r.cosine
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for i in range(0, n, 7):
        cos = np.round(u @ u[i], 6)
        cos[i] = -1
        best = [int(j) for j in np.lexsort((np.arange(n), -cos))[:5] if cos[j] >= 0.9]
        assert list(got.get(i, {})) == best
    assert len(got) >= n - 2000


# ---- names


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_distances_equal_the_plain_table():
    rng = random.Random(5)
    word = lambda most: "".join(rng.choice("abcdé日") for _ in range(rng.randrange(0, most)))
    strings, forms = [word(20) for _ in range(60)] + [word(150), ""], [word(12) or "x" for _ in range(8)] + ["a" * 63, "ab" * 40, "x"]
    got = metric_names.distances(strings, forms)
    assert got.tolist() == [[plain_distance(s, f) for f in forms] for s in strings]
    pairs = [(rng.choice(strings), rng.choice(forms)) for _ in range(50)]
    assert metric_names.pair_distances([a for a, _ in pairs], [b for _, b in pairs]).tolist() == [plain_distance(a, b) for a, b in pairs] == [metric_names.distance(a, b) for a, b in pairs]


def test_radius_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(metric_names, "MANY_NAMES", 20)
    monkeypatch.setattr(metric_names, "MANY_FORMS", 5)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(3, 9)))
    strings = sorted({word() for _ in range(300)})
    forms = [(word(), rng.choice([0, 1, 2])) for _ in range(40)]
    names = spark.createDataFrame([(s,) for s in [*strings, strings[0], "x" * 90]] + [(None,)], "name string")
    got = metric_names.radius_join(names, spark.createDataFrame(forms, "form string, radius int"))
    radius = {}
    for f, r in forms:
        radius[f] = max(r, radius.get(f, 0))
    want = {(s, f, plain_distance(s, f)) for s in strings for f, r in radius.items() if plain_distance(s, f) <= r}
    assert {tuple(r) for r in got.collect()} == want and want


COMPANIES = [
    (1, "MRM", "Marudrax Energy Corporation", ["Marudrax Energy"]),
    (2, "MRR", "Marudrax Data Systems plc", None),
    (3, "UDCS", "Ulvardquist International Aerospace Company", ["Ulvardquist", "Old Ulvas"]),
    (4, None, "Marelfane Water Works Inc.", []),
    (5, "NUL", None, None),
    (6, "GOOGL", "Alphabet Inc.", ["Google"]),
    (7, "BAC", "Bank of America Corp", ["BofA"]),
    (8, "MMM", "3M Company", None),
    (9, "AON", "Aon plc", None),
    (10, "COST", "Venelyx Wholesale Corp", ["Old Price Club House"]),
    (11, "TXV", "Marudrax Therapeutics Inc", None),
]
ASKED = {
    "What was Marudraks Energy's revenue?": {1},
    "data systems, marudrax goodwill 2022": {2},
    "Marudrax Data Sys. capital": {2},
    "Marudrax goodwill": set(),
    "net revenue of ulvardkwist in 2010": {3},
    "what did old ulvas report": {3},
    "Ulvar dquist and M.W.W. compared": {3, 4},
    "$MRM: backlog?": {1},
    "(UDCS) and maerlfane water works": {3, 4},
    "Joristholm Aerospace revenue": set(),
    "Ulvard. margin": {3},
    "what did google earn": {6},
    "gogle margin": {6},
    "googl revenue": {6},
    "bank of amrica deposits": {7},
    "bofa and america, bank of": {7},
    "the bank of the river": set(),
    "What did aon earn?": {9},
    "3m margin": {8},
    "old pric club house sales": {10},
    "the price of the old house": set(),
    "What was the cost of sales?": set(),
    "cost of COST": {10},
    "marudrax tx goodwill": {11},
    "": set(),
}


def test_named_companies(spark):
    listed = name_variants.forms(spark.createDataFrame(COMPANIES, "k long, s string, n string, a array<string>"), "k", "s", "n", "a")
    rows = [(200 + i, "what was the cost of it") for i in range(5)]
    rows += [(i, q) for i, q in enumerate(ASKED)] + [(0, next(iter(ASKED))), (99, None), (100, "x" * 200_000 + " marudrax energy")]
    got = defaultdict(set)
    for r in name_variants.named(spark.createDataFrame(rows, "request_id long, question string"), listed).collect():
        got[r.request_id].add(r.company_cik)
    assert {i: got.get(i, set()) for i in range(len(ASKED))} == dict(enumerate(ASKED.values())) and got[100] == {1}
