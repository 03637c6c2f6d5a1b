"""Corpus upkeep: preflight, ingest statistics, incremental loads, atoms, running headers and chunk packing."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import text as tx
from quarry.lineage import cut
from quarry.model import filing_stem
from quarry.sources.files import file_index

#: Token budgets and the repeats of a running header (fixed values).
MIN_TOKENS, TARGET_TOKENS, MAX_TOKENS, MAX_TITLE_TOKENS, HEADER_REPEATS = 200, 900, 1500, 100, 10

#: Contexts of a question set that are permuted on the driver, at most.
MOST_CONTEXTS = 2_000_000


def preflight(chunks: DataFrame, expected: dict[str, int]) -> DataFrame:
    """(variant, n_rows, n_embedded, delta, ok) against the expected rows; variants of one side only are listed too."""
    spark = chunks.sparkSession
    want = spark.createDataFrame(list(expected.items()) or [("", 0)], "variant string, expected long").where("variant <> ''")
    got = chunks.groupBy("variant").agg(F.count(F.lit(1)).alias("n_rows"), F.count("embedding").alias("n_embedded"))
    both = got.join(want, "variant", "full_outer").na.fill(0, ["n_rows", "n_embedded", "expected"])
    delta = F.col("n_rows") - F.col("expected")
    return both.select("variant", "n_rows", "n_embedded", delta.alias("delta"), ((delta == 0) & (F.col("n_rows") == F.col("n_embedded"))).alias("ok"))


def checksum(chunks: DataFrame) -> str:
    """A checksum of all rows in any order."""
    row = F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(chunks.columns))))
    n, total, mixed = chunks.select(F.xxhash64(row).alias("h"), F.xxhash64(F.lit(1), row).alias("g")).agg(F.count(F.lit(1)), F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor("g")).first()
    return f"{n}-{total}-{mixed}"


def restore_problems(chunks: DataFrame, expected: dict[str, int], wanted: str | None = None) -> list[str]:
    """What speaks against serving a restored chunk table: another checksum, variants that are not expected, counts or embeddings
    that differ."""
    out = ["the checksum differs"] if wanted is not None and checksum(chunks) != wanted else []
    for r in preflight(chunks, expected).orderBy("variant").collect():  # a row for each variant
        if r["variant"] not in expected:
            out.append(f"{r['n_rows']} rows of variant {r['variant']!r}")
        elif not r["ok"]:
            out.append(f"variant {r['variant']!r}: {r['n_rows']} rows, {r['n_embedded']} embedded, {expected[r['variant']]} expected")
    return out


def ready(chunks: DataFrame, expected: dict[str, int]) -> bool:
    return preflight(chunks, expected).where(~F.col("ok")).isEmpty()


def filing_stats(chunks: DataFrame) -> DataFrame:
    """(filing_stem, n_chunks, median_tokens, max_tokens): the median is the upper one, 0 where no count is known."""
    each = chunks.groupBy("filing_stem", "n_tokens").agg(F.count(F.lit(1)).alias("n"))
    known = Window.partitionBy("filing_stem")
    n = F.when(F.col("n_tokens").isNotNull(), F.col("n")).otherwise(0)
    upto = F.sum(n).over(known.orderBy(F.asc_nulls_first("n_tokens")).rowsBetween(Window.unboundedPreceding, 0))
    ranked = each.select("filing_stem", "n_tokens", "n", upto.alias("upto"), F.sum(n).over(known).alias("all"))
    middle = F.min(F.when((F.col("upto") > F.floor(F.col("all") / 2)) & F.col("n_tokens").isNotNull(), F.col("n_tokens")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return ranked.groupBy("filing_stem").agg(F.sum("n").alias("n_chunks"), zero(middle).alias("median_tokens"), zero(F.max("n_tokens")).alias("max_tokens"))


def block_stats(blocks: DataFrame) -> DataFrame:
    """(filing_stem, n_blocks, n_tables) of blocks or atoms with is_table."""
    return blocks.groupBy("filing_stem").agg(F.count(F.lit(1)).alias("n_blocks"), F.count_if(F.coalesce("is_table", F.lit(False))).alias("n_tables"))


def word_list_problems(words: DataFrame, least: int = 200_000, sentinels: tuple[str, ...] = ("visa", "target", "apple", "gap")) -> list[str]:
    """What is wrong with a list of English words (word): too short, or without words that are names as well."""
    n = words.select("word").distinct().count()
    found = {r["word"] for r in words.where(F.col("word").isin(*sentinels)).select("word").distinct().collect()}
    return [f"{n} words, {least} expected"] * (n < least) + [f"no {w!r}" for w in sentinels if w not in found]


def not_loaded(filings: DataFrame, loaded: DataFrame) -> DataFrame:
    """Filings whose stem has no chunk yet."""
    return filings.join(loaded.select("filing_stem").distinct(), "filing_stem", "left_anti")


def targets(questions: DataFrame) -> DataFrame:
    """(filing_stem, company_symbol, report_year, company_cik) of each filing asked for, the first question by id for each (cik, year)."""
    known = questions.dropna(subset=["company_cik", "report_year"])
    first = F.min_by(F.struct("company_symbol"), F.struct("id", "company_symbol")).alias("f")
    one = known.groupBy("company_cik", "report_year").agg(first).select(F.col("f.company_symbol").alias("company_symbol"), "report_year", "company_cik")
    return one.select(filing_stem(F.col("company_symbol"), F.col("report_year"), F.col("company_cik")).alias("filing_stem"), "company_symbol", "report_year", "company_cik")


def matched_questions(questions: DataFrame, stems: DataFrame, subsets: tuple[str, ...] = ("FinQA", "ConvFinQA")) -> DataFrame:
    """Questions of the subsets whose (cik, year) has a filing among stems (filing_stem), with that stem; of several stems of
    one (cik, year) the last by name counts."""
    index = file_index(stems.where("filing_stem IS NOT NULL").distinct().select(F.concat("filing_stem", F.lit(".json")).alias("name")))
    return questions.where(F.col("subset_source").isin(*subsets)).dropna(subset=["company_cik", "report_year"]).join(index, ["company_cik", "report_year"])


def running_headers(titles: DataFrame, least: int = HEADER_REPEATS) -> DataFrame:
    """(filing_stem, title, n) of titles (filing_stem, text) repeated at least that often inside one filing."""
    key = tx.title_key(F.col("text")).alias("title")
    return titles.groupBy("filing_stem", key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def furniture(titles: DataFrame) -> DataFrame:
    """titles with is_furniture by the patterns and the filing's running headers."""
    heads = running_headers(titles).select("filing_stem", F.col("title").alias("head"), F.lit(True).alias("running"))
    keyed = titles.withColumn("head", tx.title_key(F.col("text")))
    return keyed.join(heads, ["filing_stem", "head"], "left").withColumn("is_furniture", tx.is_furniture(F.col("text"), F.col("running"))).drop("head", "running")


# ---- atoms and chunks -------------------------------------------------------------------------------------------


def word_count(text: str) -> int:
    return len(text.split())


def full_runs(sizes: list[int], room: int) -> Iterator[tuple[int, int]]:
    """Consecutive runs (from, to) of sizes whose sum stays within the room, each as long as can be; a size beyond it stands alone."""
    total = np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))])
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, total[at] + room, "right")) - 1)
        yield at, end
        at = end


def split_table(rows: list[list[str]], count: Callable[[str], int] = word_count, limit: int = MAX_TOKENS) -> list[str]:
    """Row groups of a table within the limit, each under the header row; a lone row may exceed it."""
    if not rows:
        return []
    head, *lines = (" | ".join(r) for r in rows)
    runs = full_runs([count(x) for x in lines], limit - count(head)) if lines else [(0, 0)]
    return ["\n".join([head, *lines[a:b]]) for a, b in runs]


def split_text(text: str, count: Callable[[str], int] = word_count, limit: int = MAX_TOKENS) -> list[str]:
    """Sentences packed within the limit; a sentence beyond it is cut into windows of that many words."""
    sentences = re.split(r"(?<=[.!?])\s+", " ".join(text.split())) if text.strip() else []
    sizes = [count(x) for x in sentences]
    out = []
    for a, b in full_runs(sizes, limit):
        words = sentences[a].split() if sizes[a] > limit else [" ".join(sentences[a:b])]
        step = limit if sizes[a] > limit else 1
        out += [" ".join(words[i : i + step]) for i in range(0, len(words), step)]
    return out


def atoms(blocks: DataFrame, count: Callable[[str], int] = word_count) -> DataFrame:
    """(filing_stem, atom_index, text, tokens, is_title, is_table, is_furniture) of blocks (filing_stem, block_index, text, is_title, rows): a
    block is one atom, oversized ones are split, and titles over 100 tokens are text. atom_index orders the atoms of a
    filing and has gaps."""
    titles = blocks.where("rows IS NULL AND is_title")
    heads = running_headers(titles).select("filing_stem", F.col("title").alias("head"), F.lit(True).alias("running"))
    flagged = blocks.withColumn("head", tx.title_key(F.col("text"))).join(heads, ["filing_stem", "head"], "left")
    flagged = flagged.withColumn("furniture", tx.is_furniture(F.coalesce("text", F.lit("")), F.col("running")))

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for stem, index, text, title, rows, furn in zip(*(c.to_pylist() for c in batch.columns)):
                whole = "\n".join(" | ".join(r) for r in rows) if rows is not None else text or ""
                n = count(whole)
                parts = [whole] if n <= MAX_TOKENS else split_table(rows, count) if rows is not None else split_text(whole, count)
                is_title = rows is None and bool(title) and n <= MAX_TITLE_TOKENS
                out += [(stem, (index << 20) + i, p, count(p), is_title, rows is not None, is_title and furn) for i, p in enumerate(parts)]
            cols = list(zip(*out)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_()))], names=["filing_stem", "atom_index", "text", "tokens", "is_title", "is_table", "is_furniture"])

    cols = flagged.select("filing_stem", F.coalesce(F.col("block_index").cast("long"), F.lit(0)).alias("block_index"), "text", "is_title", "rows", "furniture")
    return cols.mapInArrow(divide, "filing_stem string, atom_index long, text string, tokens int, is_title boolean, is_table boolean, is_furniture boolean")


def chunk_ends(tokens: np.ndarray, title: np.ndarray, table: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """Where a filing's chunks end: for each atom the number of chunks that are closed before it. Titles take no room; a chunk is
    closed by a title once it holds TARGET_TOKENS, and by an atom that would bring it beyond MAX_TOKENS, or beyond TARGET_TOKENS
    unless that is a table which still fits with the text right after it."""
    sums = np.cumsum(np.where(title, 0, tokens))
    body, titles = np.flatnonzero(~title), np.flatnonzero(title)
    fits = sums + np.where(table, ahead, np.iinfo(np.int32).max)  # beyond any room unless it is a table
    closed = np.zeros(len(tokens), np.int64)
    at = 0  # the next body atom begins a chunk
    while at < len(body):
        first = body[at]
        base = sums[first] - tokens[first]
        end = len(tokens)
        later = titles[np.searchsorted(titles, first) :]
        full = later[np.searchsorted(sums[later], base + TARGET_TOKENS) :]
        if len(full):
            end = full[0]
        rest = body[at + 1 :]
        over = rest[np.searchsorted(sums[rest], base + TARGET_TOKENS, "right") :]
        for i in over[: np.searchsorted(over, end)]:
            if fits[i] > base + MAX_TOKENS:
                end = i
                break
        if end == len(tokens):
            break
        closed[end:] += 1
        at = int(np.searchsorted(body, end))
    return closed


def folded(sized: np.ndarray) -> np.ndarray:
    """For each chunk of a filing the chunk it ends up in: one under MIN_TOKENS joins the one before, where both fit."""
    into, held = np.arange(len(sized)), 0
    for i, n in enumerate(sized):
        if i and n < MIN_TOKENS and held + n <= MAX_TOKENS:
            into[i] = into[i - 1]
            held += n
        else:
            held = n
    return np.unique(into, return_inverse=True)[1] if len(into) else into


def _rendered(rows: DataFrame, count: Callable[[str], int], sizing: bool) -> DataFrame:
    """(filing_stem, no, heading, text, n, sized) of rows (filing_stem, no, parts, last title): headings above the bodies. sized counts the
    chunk as it would be under the title in force at its end alone."""

    def one(headings: list[str], bodies: list[str]) -> tuple[str | None, str]:
        head = "\n# ".join(headings) if headings else None
        text = "\n\n".join(bodies)
        return head, f"# {head}\n\n{text}" if headings else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for stem, no, parts, last in zip(*(c.to_pylist() for c in batch.columns)):
                bodies = [p["text"] for p in parts]
                head, text = one(list(dict.fromkeys(p["heading"] for p in parts if p["heading"])), bodies)
                n = count(text)
                out.append((stem, no, head, text, n, n if not sizing or head == last else count(one([last] if last else [], bodies)[1])))
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["filing_stem", "no", "heading", "text", "n", "sized"])

    return rows.select("filing_stem", "no", "parts", "last").mapInArrow(run, "filing_stem string, no int, heading string, text string, n int, sized int")


def pack_chunks(atom_rows: DataFrame, count: Callable[[str], int] = word_count) -> DataFrame:
    """(filing_stem, chunk_index, heading, n_tokens, text) of atoms in atom_index order. Where chunks end, and which of them fold
    into the one before, is decided for a filing on bare numbers; texts meet the decision by place and are put together
    chunk by chunk, so that no task holds a filing's texts. Null tokens are counted from the text (by words), negative ones
    are none, null flags are false."""
    fill = {"is_title": False, "is_table": False, "is_furniture": False}
    rows = atom_rows.select("filing_stem", "atom_index", F.coalesce("text", F.lit("")).alias("text"), "tokens", *fill).na.fill(fill)
    counted = F.pandas_udf(lambda s: s.map(count), "int")
    tokens = F.greatest(F.coalesce("tokens", F.when(F.col("tokens").isNull(), counted("text"))), F.lit(0))
    order = Window.partitionBy("filing_stem").orderBy("atom_index", "text")
    nxt = F.lead(F.struct("tokens", "is_title", "is_table")).over(order)
    plain = nxt.isNotNull() & ~nxt["is_title"] & ~nxt["is_table"]
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    shown = F.when(F.col("is_title") & ~F.col("is_furniture"), F.col("text"))
    placed = cut(
        rows.withColumn("tokens", tokens).select(
            "filing_stem", F.row_number().over(order).alias("pos"), "text", "tokens", "is_title", "is_table", F.when(plain, nxt["tokens"]).otherwise(0).alias("ahead"),
            F.last(shown, ignorenulls=True).over(before).alias("heading"), F.last(F.when(F.col("is_title"), F.col("text")), ignorenulls=True).over(before).alias("title"),
        )
    )

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("pos")
        closed = chunk_ends(p["tokens"].to_numpy(np.int64), p["is_title"].to_numpy(bool), p["is_table"].to_numpy(bool), p["ahead"].to_numpy(np.int64))
        return pd.DataFrame({"filing_stem": p["filing_stem"], "pos": p["pos"], "no": closed})

    ends = placed.select("filing_stem", "pos", "tokens", "is_title", "is_table", "ahead").groupBy("filing_stem").applyInPandas(decide, "filing_stem string, pos int, no int")
    e = ends.withColumnsRenamed({"filing_stem": "s", "pos": "p"})
    marked = placed.join(e, placed.filing_stem.eqNullSafe(e.s) & (placed.pos == e.p)).drop("s", "p")
    # the title in force when a chunk is closed is the last one before the atom that closes it, or the filing's last one
    final = F.when(F.col("is_title"), F.col("text")).otherwise(F.col("title"))
    last = F.max_by(F.struct(final.alias("t")), "pos")
    part = F.when(~F.col("is_title"), F.struct("pos", "text", "heading"))
    chunks = marked.groupBy("filing_stem", "no").agg(F.array_sort(F.collect_list(part)).alias("parts"), last["t"].alias("last")).where(F.size("parts") > 0)
    first = cut(chunks)
    drawn = cut(_rendered(first, count, True).select("filing_stem", "no", "sized"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("no")
        return pd.DataFrame({"filing_stem": p["filing_stem"], "no": p["no"], "into": folded(p["sized"].to_numpy(np.int64))})

    into = drawn.groupBy("filing_stem").applyInPandas(fold, "filing_stem string, no int, into int").withColumnsRenamed({"filing_stem": "s", "no": "n"})
    both = first.join(into, first.filing_stem.eqNullSafe(into.s) & (first.no == into.n))
    merged = both.groupBy("filing_stem", F.col("into").alias("no")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col("n"), F.col("parts")))), lambda x: x["parts"])).alias("parts"), F.lit(None).cast("string").alias("last"))
    return _rendered(merged, count, False).select("filing_stem", F.col("no").alias("chunk_index"), "heading", F.col("n").alias("n_tokens"), "text")


def carried_heading(atom_rows: DataFrame) -> DataFrame:
    """(filing_stem, atom_id, heading): the last title before each atom that is no furniture."""
    order = Window.partitionBy("filing_stem").orderBy("atom_index", "atom_id").rowsBetween(Window.unboundedPreceding, 0)
    title = F.when(F.coalesce("is_title", F.lit(False)) & ~F.coalesce("is_furniture", F.lit(False)), F.col("text"))
    return atom_rows.select("filing_stem", "atom_id", F.last(title, ignorenulls=True).over(order).alias("heading"))


def next_text_tokens(atom_rows: DataFrame) -> DataFrame:
    """(filing_stem, atom_id, ahead): for a table the tokens of a plain text right after it, else 0."""
    order = Window.partitionBy("filing_stem").orderBy("atom_index", "atom_id")
    flag = lambda c: F.coalesce(c, F.lit(False))
    nxt = F.lead(F.struct("tokens", "is_title", "is_table")).over(order)
    plain = nxt.isNotNull() & ~flag(nxt["is_title"]) & ~flag(nxt["is_table"])
    return atom_rows.select("filing_stem", "atom_id", F.when(flag(F.col("is_table")) & plain, F.coalesce(nxt["tokens"], F.lit(0))).otherwise(0).alias("ahead"))


def assign_splits(questions: DataFrame, seed: int = 42, ratios: tuple[float, float] = (0.8, 0.1)) -> DataFrame:
    """questions with split by context_id, so that a document's questions stay together: contexts are shuffled by a fixed
    seed, and their running row counts are cut at the ratios. The shuffle of distinct contexts is one permutation of
    numbers on the driver (a question set's contexts, MOST_CONTEXTS at most; more are refused), joined back as a table."""
    counts = questions.where("context_id IS NOT NULL").groupBy("context_id").agg(F.count(F.lit(1)).alias("n")).orderBy("context_id").limit(MOST_CONTEXTS + 1).toPandas()
    if len(counts) > MOST_CONTEXTS:
        raise ValueError(f"more than {MOST_CONTEXTS} contexts")
    ids = counts["context_id"].to_numpy().copy()
    np.random.default_rng(seed).shuffle(ids)
    rows = counts.set_index("context_id")["n"].loc[ids].cumsum()
    train = ratios[0] * counts["n"].sum()
    dev = train + ratios[1] * counts["n"].sum()
    named = [(c, "train" if x <= train else "dev" if x <= dev else "test") for c, x in zip(ids.tolist(), rows.tolist())]
    table = questions.sparkSession.createDataFrame(named, "context_id string, new_split string")
    return questions.join(table, "context_id", "left").withColumn("split", F.col("new_split")).drop("new_split")
