"""Variant spellings of company names in typed questions, linked to a reference list.

Method: metric-space partitioning (see metric_names). Every word of a question and every two neighbouring words
written together are strings to be matched; the forms of the reference list are the leading word of each name,
its beginnings, names and aliases of any number of words written together, symbols and initials. The exact radius
join under the edit distance links both sides, which are tables. Then each question decides which hits stand: nearer
ones first, and where several companies share a leading word, or it is too short to tell alone, the one whose other
words stand beside it, spelt out, misspelt or abbreviated, in any order. So names of three words and more are joined
word by word: by their leading word, then by the others around it.

Symbols and initials count in capitals, or behind a `$`. In small letters, and in questions without any, they
count if the list's symbol is no usual word of the questions: typed so in at most USUAL of them, or not more often
than in capitals.

Null and empty questions name nothing. A leading word shared by companies that nothing tells apart gives no row;
so do beginnings, symbols or initials of several. Repeated rows give one result. Companies with a null name or key
are left out; null aliases and symbols are skipped.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.base import cores, cut, sent_if_small, spread
from quarry.llm.metric_names import distance, radius_join

#: Words of legal forms (fixed values).
LEGAL = {"inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "plc", "llc", "lp", "group", "gp", "grp", "holdings", "hldg", "hldgs", "ag", "sa", "nv", "and", "the"}
#: Short words that are never a part of a name (fixed values).
PLAIN = {"in", "of", "at", "for", "is", "did", "a", "an", "on", "to", "by", "from", "what", "which", "how", "im", "de", "en", "les", "des", "von", "was", "were", "with", "does"}
#: Shortest beginning of a leading word that counts as a name, and leading words below which others must stand beside.
BEGINNING, TELLING = 5, 5
#: Share of a company's other words that tells it apart, and that must stand beside a leading word that tells nothing alone.
TOLD, NEEDED = 0.5, 0.75
#: Share of the questions in which a symbol may stand in small letters without being taken for a usual word.
USUAL = 1e-3
#: Links, and forms, that are broadcast to the questions at most (about 30 MB); more meet them by a shuffle.
SENT_LINKS = 300_000

WHOLE, LEAD, BEGIN, SYMBOL, INITIALS = range(5)
#: How a string was typed: in small letters, in capitals or marked, as letters with dots.
SMALL, CAPITALS, DOTTED = range(3)
_DOTTED = re.compile(r"(?<![A-Za-z])(?:(?:[A-Z]\.\s?){1,6}[A-Z]|(?:[a-z]\.){1,6}[a-z])\.?(?![A-Za-z])")
_WORD = re.compile(r"\$?[A-Za-z0-9]+")


def typed(text: str) -> list[str]:
    """Words as typed, without accents, possessives and apostrophes; a `$` before a word is kept."""
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return _WORD.findall(re.sub(r"['’]", "", re.sub(r"['’][sS]\b", "", text)))


def words(text: str) -> list[str]:
    return [w.lstrip("$").lower() for w in typed(text)]


def radius_of(form: str, kind: int, many: int = 1) -> int:
    """Edits within which a form is recognised: none for short ones, whose neighbours are other words."""
    if kind in (BEGIN, SYMBOL, INITIALS) or len(form) < 4:
        return 0
    if kind == WHOLE and many > 1:
        return 2 if len(form) > 10 else 1 if len(form) > 7 else 0
    return 2 if len(form) > 6 else 1


def forms_of(symbol: str | None, name: str, aliases: list | None) -> list[tuple[int, str, int, list[str], bool]]:
    """(kind, form, radius, other words, whether these must stand beside it) of one company."""
    own = [w for w in words(name) if w not in LEGAL]
    if not own:
        return []
    other = [w for w in own[1:] if w not in PLAIN]
    out = [(LEAD, own[0], radius_of(own[0], LEAD), other, bool(other) and len(own[0]) < TELLING)]
    if symbol and (s := "".join(words(symbol))):
        out.append((SYMBOL, s, 0, other, False))
    if len(own) > 2:
        out.append((INITIALS, "".join(w[0] for w in own), 0, other, False))
    for spelt in [own, words(name), *(words(a) for a in aliases or [] if a)]:
        bare = [w for w in spelt if w not in LEGAL]
        if bare and (len(spelt) > 1 or spelt != own[:1]):
            form = "".join(spelt)
            out.append((WHOLE, form, radius_of(form, WHOLE, len(spelt)), other, False))
            if len(bare) > 2 and bare[0] != own[0]:
                out.append((LEAD, bare[0], radius_of(bare[0], LEAD), bare[1:], True))
    return out


def forms(companies: DataFrame, key: str, symbol: str, name: str, aliases: str) -> DataFrame:
    """(form, kind, radius, entries) of a reference list, entries (key, others, need) of the companies that share it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *f) for k, s, n, a in zip(*(c.to_pylist() for c in batch.columns)) for f in forms_of(s, n, a)]
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["key", "kind", "form", "radius", "others", "need"])

    listed = companies.select(F.col(key).cast("long").alias("key"), F.col(symbol).alias("symbol"), F.col(name).alias("name"), F.col(aliases).alias("aliases")).where("key IS NOT NULL AND name <> ''")
    one = listed.mapInArrow(run, "key long, kind int, form string, radius int, others array<string>, need boolean")
    entries = one.groupBy("form", "kind").agg(F.max("radius").alias("radius"), F.collect_set(F.struct("key", "others", "need")).alias("entries"))
    starts = F.explode(F.transform(F.sequence(F.lit(BEGINNING), F.length("form") - 1), lambda n: F.substring("form", F.lit(1), n))).alias("form")
    begins = entries.where((F.col("kind") == LEAD) & (F.length("form") > BEGINNING) & ~F.exists("entries", lambda e: e["need"])).select(starts, "entries")
    only = begins.groupBy("form").agg(F.count(F.lit(1)).alias("leads"), F.first("entries").alias("entries")).where("leads = 1")
    return cut(entries.unionByName(only.select("form", F.lit(BEGIN).alias("kind"), F.lit(0).alias("radius"), "entries")))


@lru_cache(maxsize=1 << 18)
def likeness(said: str, word: str) -> float:
    """How well a typed word stands for a word of a name. An abbreviation is a subsequence of the word's letters that begins
    like it; an x that the word lacks stands for any letters."""
    if said == word:
        return 1.0
    if said in PLAIN or said in LEGAL or said.isdigit():
        return 0.0
    if len(word) >= 4 and abs(len(said) - len(word)) <= 2:
        d = distance(said, word)
        if d <= (2 if len(word) >= 7 or sorted(said) == sorted(word) else 1):
            return 0.95 - 0.1 * d
    if not 2 <= len(said) < len(word):
        return 0.0
    short = said if "x" in word else said.strip("x")
    if short and short != said:
        at = 0 if said[0] != "x" else max(0, word.find(short[0]))
        rest = iter(word[at:])
        return 0.6 if (said[0] == "x" or short[0] == word[0]) and all(c in rest for c in short) else 0.0
    rest = iter(word)
    if said[0] == word[0] and all(c in rest for c in said):
        return 0.7 if word.startswith(said) or said[-1] == word[-1] or len(said) >= 3 else 0.4
    return 0.0


def beside(entry: dict, context: list[str]) -> float:
    """Share of a company's other words that stand in the context."""
    others = entry["others"]
    return sum(max((likeness(t, w) for t in context), default=0.0) for w in others) / max(1, len(others))


def choose(entries: list[dict], context: list[str]) -> int | None:
    """The company of one form: the only one, or the one whose other words stand in the context."""
    if len({e["key"] for e in entries}) == 1 and any(not e["need"] for e in entries):
        return entries[0]["key"]
    score: dict[int, float] = {}
    for e in entries:
        share = beside(e, context)
        score[e["key"]] = max(score.get(e["key"], 0.0), share if share >= (NEEDED if e["need"] else TOLD) else 0.0)
    best = max(score.values())
    first = [k for k, v in score.items() if v == best]
    return first[0] if best > 0 and len(first) == 1 else None


def candidates(question: str) -> list[tuple[int, int, str, int]]:
    """(position, words, string, how typed): single words, two neighbours together, and letters with dots."""
    w = typed(question)
    low = [x.lstrip("$").lower() for x in w]
    shouted = not any(x != x.upper() for x in w)
    how = [CAPITALS if x[0] == "$" or not shouted and x.isupper() else SMALL for x in w]
    out = [(i, 1, x, how[i]) for i, x in enumerate(low)]
    out += [(i, 2, low[i] + low[i + 1], min(how[i], how[i + 1])) for i in range(len(low) - 1) if not low[i].isdigit() and not low[i + 1].isdigit()]
    for m in _DOTTED.finditer(question):
        at, n = len(typed(question[: m.start()])), len(typed(m.group()))
        out.append((at, n, "".join(words(m.group())), DOTTED))
    return out


def decide(question: str, hits: list[dict]) -> list[int]:
    """Keys of the companies that a question names, from its hits (at, n, how, form, distance, kind, usual, entries)."""
    found: set[int] = set()
    w = words(question)
    taken: set[int] = set()
    names = [h for h in hits if h["kind"] <= BEGIN and h["how"] < DOTTED]

    def order(h: dict) -> tuple:
        """Nearer hits first, of these swapped letters; names as a whole before leading words, these before beginnings."""
        swapped = h["distance"] == 0 or sorted("".join(w[h["at"] : h["at"] + h["n"]])) == sorted(h["form"])
        return h["distance"], not swapped, h["kind"], -h["n"] if h["kind"] == WHOLE else h["n"], h["at"]

    # forms that are equally near to one place are told apart like companies that share a form
    for (*_, at), same in groupby(sorted(names, key=order), key=order):
        same = list(same)
        places = set(range(at, at + same[0]["n"]))
        if places & taken:
            continue
        entries = [e for h in same for e in h["entries"]]
        key = choose(entries, w[max(0, at - 4) : at] + w[at + same[0]["n"] : at + same[0]["n"] + 5])
        if key is None and any(e["need"] for e in entries):
            continue  # a word that means nothing by itself
        taken |= places
        if key is not None:
            found.add(key)
    spots: dict[tuple, dict[int, dict]] = {}
    for h in hits:
        if h["kind"] >= SYMBOL:
            spots.setdefault((h["at"], h["n"], h["how"]), {})[h["kind"]] = h
    for (at, n, how), kinds in spots.items():
        if how == SMALL and (n > 1 or set(range(at, at + n)) & taken):
            continue
        for kind in (INITIALS, SYMBOL) if how == DOTTED else (SYMBOL, INITIALS):
            if (h := kinds.get(kind)) is not None and (how != SMALL or not h["usual"]):
                keys = {e["key"] for e in h["entries"]}
                found |= keys if len(keys) == 1 else set()
                break
    return sorted(found)


def named(requests: DataFrame, listed: DataFrame, out: str = "company_cik") -> DataFrame:
    """(request_id, out) of every company of a reference list (see forms) that a request's question names."""
    spark = requests.sparkSession
    asked = requests.select("request_id", "question").where(F.col("question").isNotNull()).distinct().withColumn("q", F.xxhash64("question"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ = [candidates(q) for q in batch.column(1).to_pylist()]
            index = pa.array([i for i, c in enumerate(all_) for _ in c], pa.int64())
            flat = [x for c in all_ for x in c]
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(2).take(index), *(pa.array([x[k] for x in flat], t) for k, t in enumerate(kinds))], names=["request_id", "q", "at", "n", "name", "how"])

    asked = cut(asked)
    each = cut(spread(asked).mapInArrow(split, "request_id long, q long, at int, n int, name string, how int"))
    links = sent_if_small(radius_join(each.select("name"), listed.select("form", "radius")), SENT_LINKS)
    kinds = listed.select("form", "kind", "radius")
    met = cut(each.join(links, "name").join(sent_if_small(kinds, SENT_LINKS), "form").where("distance <= radius").drop("radius", "name"))
    # a symbol that is a usual word of the questions: counted over all of them
    typed_as = met.where(F.col("kind") >= SYMBOL).groupBy("form", "kind").agg(F.count_if(F.col("how") == SMALL).alias("small"), F.count_if(F.col("how") > SMALL).alias("big"))
    usual = (F.col("small") > F.col("big")) & (F.col("small") > 3 + USUAL * F.lit(asked.count())) | (F.length("form") < 3)
    meant = listed.select("form", "kind", "entries").join(typed_as.select("form", "kind", usual.alias("usual")), ["form", "kind"], "left")
    hit = F.struct("at", "n", "how", "form", "distance", "kind", "usual", "entries")
    hits = met.join(sent_if_small(meant, SENT_LINKS), ["form", "kind"]).groupBy("request_id", "q").agg(F.collect_list(hit).alias("hits"))
    known = asked.join(hits, ["request_id", "q"]).select("request_id", "question", "hits")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r, k) for r, q, hs in zip(*(c.to_pylist() for c in batch.columns)) for k in decide(q, hs)]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int64()), pa.array([k for _, k in rows], pa.int64())], names=["request_id", out])

    return known.repartition(4 * cores(spark)).mapInArrow(judge, f"request_id long, {out} long").distinct()
