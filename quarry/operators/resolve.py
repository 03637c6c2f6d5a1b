"""Which companies a question names, by a lexicon of aliases and ticker symbols; and the question without them.

The lexicon, the symbols and the English words are tables. A question's runs of words meet the aliases, and its tokens the
symbols, in equi joins; what is left for each question is one pass over its word positions, in which accepted aliases take
their places. So neither list passes through the driver, whatever its size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.lineage import sent_if_small

MOST_TICKERS, SHORTEST_TICKER = 3, 2
#: Rows of a reference table that are broadcast to the questions, at most; larger ones meet them by a shuffle.
SENT_ROWS = 500_000

#: Attributions to the filing, in the order in which they are removed (fixed values).
FRAMING = [
    r",?\s*\bas\s+(?:reported|reflected|disclosed|outlined|shown|presented|stated|detailed|recorded|indicated|described|listed|set\s+forth)\b[^,.?;]*",
    r",?\s*\baccording\s+to\b[^,.?;]*",
    r",?\s*\bbased\s+on\s+(?:its|their|the\s+company'?s?)\b[^,.?;]*",
    r",?\s*\bin\s+(?:its|their|the\s+company'?s?)\s+[^,.?;]*(?:report|10-?k|filing|statements?|disclosures?)\b[^,.?;]*",
    r",?\s*\b(?:the\s+)?(?:annual\s+report|form\s+10-?k|10-?k\s+filing|financial\s+report)\b",
]
#: Prepositions that belong to a name, and legal words left beside it (fixed values).
LEADS = {"for", "of", "by", "at", "from", "in"}
ORPHANS = {"inc", "corp", "corporation", "company", "companies", "holding", "holdings", "group", "international", "llc", "ltd", "plc", "lp", "nv", "sa", "ag"}


def build_lexicon(companies: DataFrame, name: str = "company_name", symbol: str = "company_symbol") -> DataFrame:
    """(alias, tickers): sorted distinct symbols of each spelling of the names."""
    one = companies.select(F.col(name).alias("n"), F.col(symbol).alias("s")).where("n IS NOT NULL AND s IS NOT NULL").distinct()
    return one.select("s", F.explode(tx.aliases(F.col("n"))).alias("alias")).groupBy("alias").agg(F.array_sort(F.collect_set("s")).alias("tickers"))


def with_risk(lexicon: DataFrame, words: DataFrame) -> DataFrame:
    """lexicon with risky: a single word that is an English word (words.word) or has three letters at most."""
    w = words.select(F.lower(F.trim("word")).alias("alias"), F.lit(True).alias("english")).distinct()
    single = ~F.col("alias").contains(" ")
    return lexicon.join(w, "alias", "left").withColumn("risky", single & (F.coalesce("english", F.lit(False)) | (F.length("alias") <= 3))).drop("english")


@dataclass
class Lexicon:
    """aliases (alias, tickers, risky), symbols (ticker), English words (word) in lower case, and the most words of an alias."""

    aliases: DataFrame
    tickers: DataFrame
    words: DataFrame
    longest: int


def load(lexicon: DataFrame, tickers: DataFrame, words: DataFrame) -> Lexicon:
    """A lexicon (alias, tickers), symbols (ticker) and English words (word). An empty word list switches the guard off."""
    listed = sent_if_small(words.select(F.lower(F.trim("word")).alias("word")).where("word IS NOT NULL").distinct(), SENT_ROWS)
    known = sent_if_small(tickers.select("ticker").where("ticker IS NOT NULL").distinct(), SENT_ROWS)
    aliases = sent_if_small(with_risk(lexicon, listed), SENT_ROWS)
    longest = aliases.agg(F.max(F.size(F.split("alias", " ")))).first()[0]
    return Lexicon(aliases, known, listed, longest or 1)


def alias_candidates(questions: DataFrame, lexicon: DataFrame, longest: int = 12) -> DataFrame:
    """questions (question, ...) with each alias row whose words stand in the question: an equi join on the question's runs
    of up to `longest` words, instead of a comparison of all questions with all aliases."""
    w = F.split(F.trim(tx.company_normal(F.col("question"))), " ")
    runs = F.flatten(F.transform(w, lambda _, i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size(w) - i)), lambda n: F.array_join(F.slice(w, i + 1, n), " "))))
    asked = questions.where("question IS NOT NULL").withColumn("alias", F.explode(F.array_distinct(runs))).drop("question")
    return asked.join(lexicon, "alias")


def symbols(questions: DataFrame, lexicon: Lexicon) -> DataFrame:
    """questions (question, ...) with each ticker that they write: of the forms of a token the first that is a known symbol and no
    English word; small letters count for three to five of them."""
    token = lambda p: F.explode(F.array_distinct(F.regexp_extract_all("question", F.lit(p), F.lit(0)))).alias("written")
    big = questions.select("*", token(r"(?U)\b[A-Z][A-Z0-9.\-]{1,5}\b")).withColumn("forms", tx.ticker_forms(F.col("written")))
    small = questions.select("*", token(r"(?U)\b[a-z]{3,5}\b")).withColumn("forms", F.array(F.upper("written")))
    forms = big.unionByName(small).select("*", F.posexplode("forms").alias("nth", "ticker")).where(F.length("ticker") >= SHORTEST_TICKER)
    known = forms.join(lexicon.tickers, "ticker").withColumn("word", F.lower("ticker")).join(lexicon.words, "word", "left_anti")
    keys = [c for c in questions.columns if c != "question"]
    return known.groupBy(*keys, "written").agg(F.min_by("ticker", "nth").alias("ticker")).select(*keys, "ticker")


_PIECE = re.compile(r"\w+|[^\w\s]")
_PLAIN = re.compile("[A-Za-z0-9]+")


def _normal(question: str) -> list[str]:
    """Words of a question as the lexicon spells them (see functions.text.company_normal)."""
    return re.findall("[a-z0-9]+", re.sub(r"['’]s\b", "", question.lower().replace("&", " and ")))


def _inner_capitals(question: str) -> set[str]:
    """Words as written that no sentence begins with where they stand."""
    out, before = set(), ""
    for m in _PIECE.finditer(question):
        if before and before not in ".?!:;":
            out.add(m.group())
        before = m.group()[-1]
    return out


def accepted(question: str, hits: list[dict]) -> list[dict]:
    """Of the aliases (alias, tickers, risky) that a question holds those that name a company, the longest first. An accepted one
    takes its places, so that no shorter one is read in them; a risky one must mean one company and be written as a name."""
    words = _normal(question)
    free = [True] * len(words)
    names: set[str] | None = None
    out = []
    for hit in sorted(hits, key=lambda h: (-len(h["alias"]), h["alias"])):
        spelt = hit["alias"].split(" ")
        places = [i for i, w in enumerate(words) if w == spelt[0] and words[i : i + len(spelt)] == spelt and all(free[i : i + len(spelt)])]
        if not places:
            continue
        if hit["risky"]:
            names = _inner_capitals(question) if names is None else names
            if len(hit["tickers"]) > 1 or hit["alias"].capitalize() not in names:
                continue
        out.append(hit)
        for i in places:
            free[i : i + len(spelt)] = [False] * len(spelt)
    return out


def _names_at(text: str, aliases: list[str]) -> list[tuple[int, int]]:
    """Character spans of the aliases in a text, widened by a preposition before them and by the legal words on either side."""
    at = [m.span() for m in _PLAIN.finditer(text)]
    low = [text[a:b].lower() for a, b in at]
    whole = [not re.match(r"\w", text[max(0, a - 1) : a]) and not re.match(r"\w", text[b : b + 1]) for a, b in at]  # no part of a word with other letters
    between = lambda i: text[at[i][1] : at[i + 1][0]]
    used, spans = [False] * len(at), []
    for spelt in (a.split(" ") for a in aliases):
        for i in range(len(at) - len(spelt) + 1):
            j = i + len(spelt) - 1
            if low[i : j + 1] != spelt or any(used[i : j + 1]) or re.match(r"\w", text[max(0, at[i][0] - 1) : at[i][0]]):
                continue
            end = at[j][1]
            if j + 1 < len(at) and low[j + 1] == "s" and between(j) in ("'", "’"):
                j, end = j + 1, at[j + 1][1]
            if re.match(r"\w", text[end : end + 1]):
                continue
            used[i : j + 1] = [True] * (j + 1 - i)
            if i and low[i - 1] in LEADS and whole[i - 1] and between(i - 1).isspace():
                i -= 1
            spans.append([i, j])
    out = []
    for i, j in sorted(spans):
        while i and whole[i - 1] and (low[i - 1] in ORPHANS or low[i - 1] == "the") and re.fullmatch(r"\.?[\s,]*", between(i - 1)):
            i -= 1
        end = at[j][1]
        while j + 1 < len(at) and re.fullmatch(r"\.?[\s,]*", between(j)):
            if low[j + 1] in ORPHANS and whole[j + 1]:
                j += 1
            elif low[j + 1 : j + 4] == ["and", "its", "subsidiaries"]:
                j += 3
            else:
                break
            end = at[j][1] + (text[at[j][1] : at[j][1] + 1] == ".")
        if out and at[i][0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((at[i][0], end))
    return out


def without_names(question: str, aliases: list[str]) -> str:
    """The question without framing and names, in order; as it was, where under four words would be left."""
    text = question
    for pattern in FRAMING:
        text = re.sub(pattern, " ", text, flags=re.I)
    for a, b in reversed(_names_at(text, aliases)):
        text = f"{text[:a]} {text[b:]}"
    text = re.sub(r"\s{2,}", " ", re.sub(r"\s*,\s*(?=[,.?;])", "", text))
    text = re.sub(r"\s+([,.?;])", r"\1", text.strip(" ,;"))
    return text if len(text.split()) >= 4 else question


def resolved(questions: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(query_id, tickers, reason, stripped) of questions (query_id, question). reason is no_match without any ticker and too_many
    beyond three; both leave tickers empty, which means an unfiltered search."""
    asked = questions.select("query_id", "question").withColumn("q", F.xxhash64("question"))
    hits = alias_candidates(asked, lexicon.aliases, lexicon.longest).groupBy("query_id", "q").agg(F.collect_set(F.struct("alias", "tickers", "risky")).alias("hits"))
    written = symbols(asked, lexicon).groupBy("query_id", "q").agg(F.collect_set("ticker").alias("written"))
    joined = asked.join(hits, ["query_id", "q"], "left").join(written, ["query_id", "q"], "left")
    kind = questions.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named, stripped = [], []
            for question, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                chosen = accepted(question, own) if question and own else []
                named.append([t for h in chosen for t in h["tickers"]])
                stripped.append(without_names(question, [h["alias"] for h in chosen]) if question else question)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(named, pa.list_(pa.string())), batch.column(3), pa.array(stripped, pa.string())], names=["query_id", "named", "written", "stripped"])

    read = joined.select("query_id", "question", "hits", "written").mapInArrow(run, f"query_id {kind}, named array<string>, written array<string>, stripped string")
    every = F.array_sort(F.array_union("named", F.coalesce("written", F.array().cast("array<string>"))))
    out = read.select("query_id", every.alias("every"), "stripped")
    reason = F.when(F.size("every") == 0, "no_match").when(F.size("every") > MOST_TICKERS, "too_many")
    return out.select("query_id", F.when(reason.isNull(), F.col("every")).otherwise(F.array().cast("array<string>")).alias("tickers"), reason.alias("reason"), "stripped")
