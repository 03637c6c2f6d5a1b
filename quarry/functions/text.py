"""Column builders for the text rules; all stay inside generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the rules see it (fixed value).
_W = r"[\s\x1c-\x1f]"
#: Units after which a four-digit number is no year (fixed values, each with the blanks that still fit in 20 characters).
_UNITS = "|".join(f"{_W}{{0,{20 - len(u)}}}{u}" for u in ("million", "billion", "thousand", "%", "percent", "shares", "units", "bps", "basis points"))
#: Both patterns look at the first character first: what stands around it is dearer to read at each place of a text.
YEAR = rf"(?=[12])(?U)(?<!\${_W}{{0,5}})\b(19[5-9]\d|20[0-4]\d)\b(?!(?i:{_UNITS}))"
FY = r"(?=[Ff])(?U)(?i)\bFY\s?(\d{2})\b"

#: Legal forms and generic words dropped from company names (fixed values).
LEGAL = "incorporated|corporation|company|companies|holdings?|group|international|industries|enterprises|technologies|systems|solutions|services|partners|inc|corp|co|ltd|plc|llc|lp|llp|nv|sa|ag|se|spa|kk|the"

#: Titles that are page furniture (fixed values).
FURNITURE = [
    r"(?:\bZEQ\b|\bSEQ\s*=|\bCP\s*=|\bEFW\s*=)",
    r"^/s/",
    r"^[^A-Za-z]+$",
    r"(?i)^(?:page\s+)?(?:[FSABC]|I{1,3}|IV|VI{0,3})?[-–]\s?\d{1,3}$",
    r"^\d{1,3}$",
]

#: Words read as true and false (fixed values).
TRUE_WORDS = ["yes", "true", "higher", "greater", "increase", "increased", "more"]
FALSE_WORDS = ["no", "false", "lower", "less", "decrease", "decreased", "fewer"]


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def years(text: Column) -> Column:
    """Sorted distinct years that a text mentions; amounts and counts are no years, FY15 is 2015. Null for null."""
    plain = F.transform(_all(text, YEAR, 1), lambda y: y.cast("int"))
    short = F.transform(_all(text, FY, 1), lambda y: F.when(y.cast("int") > 50, y.cast("int") + 1900).otherwise(y.cast("int") + 2000))
    return F.array_sort(F.array_union(plain, short))


def year_bonus(fiscal_year: Column, query_years: Column, alpha: float = 0.01) -> Column:
    """alpha / (1 + distance to the nearest year of the question), 0 without one."""
    nearest = F.array_min(F.transform(query_years, lambda y: F.abs(fiscal_year - y)))
    return F.coalesce(F.lit(alpha) / (F.lit(1) + nearest), F.lit(0.0))


def words(text: Column) -> Column:
    """Lower-cased words with thousands separators removed; decimals are one word."""
    return _all(F.regexp_replace(F.lower(text), r"(?<=\d),(?=\d)", ""), r"\d+\.\d+|[a-z0-9]+", 0)


def numeric_tokens(word_list: Column) -> Column:
    """Distinct numbers of three or more digits that are no years."""
    number = lambda w: w.rlike(r"^\d+(\.\d+)?$") & (F.length(F.replace(w, F.lit("."), F.lit(""))) >= 3) & ~w.rlike(r"^(19|20)\d{2}$")
    return F.array_distinct(F.filter(word_list, number))


def label_words(cells: Column) -> Column:
    """Words of a row's first cell that are no numbers."""
    return F.array_distinct(F.filter(words(F.get(cells, F.lit(0))), lambda w: ~w.rlike(r"^\d+(\.\d+)?$")))


def terms(text: Column) -> Column:
    """Search terms: runs of letters and digits, lower-cased."""
    return _all(F.lower(text), r"[\p{L}\p{N}]+", 0)


def company_normal(text: Column) -> Column:
    """Lower-cased words of a company name, padded by one blank on each side."""
    t = F.regexp_replace(F.replace(F.lower(text), F.lit("&"), F.lit(" and ")), r"(?U)['’]s\b", "")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(t, "[^a-z0-9]+", " ")), F.lit(" "))


def strip_legal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, rf"(?i)\b({LEGAL})\b", " "), r"\s+", " "))


def aliases(name: Column, shortest: int = 3) -> Column:
    """Spellings of a company name: in full, without an outer 'the', without legal words, and its first word."""
    full = F.trim(company_normal(name))
    bare = strip_legal(full)
    forms = F.array(full, F.regexp_extract(full, r"^(.*) the$", 1), F.regexp_extract(full, r"^the (.*)$", 1), bare, F.split_part(bare, F.lit(" "), F.lit(1)))
    return F.array_distinct(F.filter(forms, lambda a: F.length(a) >= shortest))


def is_furniture(title: Column, running: Column | None = None) -> Column:
    """Whether a title is page furniture: empty, a running header, or of one of the fixed patterns."""
    bare = F.regexp_replace(title, r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    test = F.length(bare) == 0
    for p in FURNITURE:
        test = test | bare.rlike(p)
    return test if running is None else test | F.coalesce(running, F.lit(False))


def title_key(title: Column) -> Column:
    """A title as running headers are compared: lower-cased, blanks collapsed."""
    return F.trim(F.regexp_replace(F.lower(title), r"\s+", " "))


def clean_row(cells: Column) -> Column:
    """Cells without blanks; a currency sign joins the next cell, an open bracket's number its closing one."""
    kept = F.filter(F.transform(cells, lambda c: F.trim(c)), lambda c: F.length(c) > 0)
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("held"))
    sign = lambda c: c.isin("$", "-$")
    opens = lambda c: c.rlike(r"^\(-?[\d,]+\.?\d*$")

    def fold(state: Column, cell: Column) -> Column:
        held, out = state["held"], state["out"]
        joins = held.isNotNull() & (sign(held) | (cell == ")"))
        before = F.when(held.isNotNull(), F.concat(out, F.array(held))).otherwise(out)
        waits = sign(cell) | opens(cell)
        return F.when(joins, F.struct(F.concat(out, F.array(F.concat(held, cell))).alias("out"), F.lit(None).cast("string").alias("held"))).otherwise(
            F.struct(F.when(waits, before).otherwise(F.concat(before, F.array(cell))).alias("out"), F.when(waits, cell).alias("held"))
        )

    return F.aggregate(kept, start, fold, lambda s: F.when(s["held"].isNotNull(), F.concat(s["out"], F.array(s["held"]))).otherwise(s["out"]))


def table_text(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ")), "\n")


def parse_answer(text: Column) -> Column:
    """struct(value, status) of the answer line: ok, refused, no_number, no_answer_line or empty."""
    line = F.regexp_extract(text, r"(?imdU)ANSWER\s*:\s*(.+?)\s*$", 1)
    has_line = text.rlike(r"(?imdU)ANSWER\s*:\s*(.+?)\s*$")
    number = F.regexp_extract(line, r"-?\$?\d[\d,]*(?:\.\d+)?%?", 0)
    value = F.regexp_replace(number, "[,$%]", "").try_cast("double")
    word = F.regexp_replace(F.split_part(F.trim(F.regexp_replace(F.lower(line), r"\s+", " ")), F.lit(" "), F.lit(1)), r"^[.,;:]+|[.,;:]+$", "")
    boolean = F.when(word.isin(TRUE_WORDS), F.lit(1.0)).when(word.isin(FALSE_WORDS), F.lit(0.0))
    refused = line.rlike("(?i)insufficient|cannot|not (?:provided|available|stated|found)|unknown")
    out = lambda v, s: F.struct(v.alias("value"), F.lit(s).alias("status"))
    none = F.lit(None).cast("double")
    return (
        F.when(text.isNull() | ~text.rlike(r"[^\s]"), out(none, "empty"))
        .when(~has_line, out(none, "no_answer_line"))
        .when((number != "") & value.isNotNull(), out(value, "ok"))
        .when(number != "", out(none, "no_number"))
        .when(boolean.isNotNull(), out(boolean, "ok"))
        .when(refused, out(none, "refused"))
        .otherwise(out(none, "no_number"))
    )


def ticker_forms(token: Column) -> Column:
    """Symbols that a ticker as written may stand for."""
    bare = F.regexp_replace(token, "[.-]", "")
    classed = token.rlike("[.-]")
    head = F.split_part(F.split_part(token, F.lit("."), F.lit(1)), F.lit("-"), F.lit(1))
    return F.when(classed, F.array(bare, head)).when(F.length(bare) > 2, F.array(bare, F.left(bare, F.length(bare) - 1))).otherwise(F.array(bare))


def document_url(cik: Column, accession: Column, document: Column) -> Column:
    return F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), cik.cast("string"), F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")), F.lit("/"), document)


def submissions_name(cik: Column) -> Column:
    return F.concat(F.lit("CIK"), F.lpad(cik.cast("string"), 10, "0"), F.lit(".json"))


def sse(event: Column, body: Column) -> Column:
    """One server-sent event of a struct."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), F.to_json(body), F.lit("\n\n"))


def answer_headline(answer: Column) -> Column:
    """The value of the answer line, else the first line, for display."""
    line = F.regexp_extract(answer, r"(?im)^\W*ANSWER\s*:\s*(.+?)\W*$", 1)
    return F.when(line != "", line).otherwise(F.split_part(F.trim(answer), F.lit("\n"), F.lit(1)))


def mentions_value(text: Column, value: Column) -> Column:
    """Whether a text contains a number, with or without thousands separators, as a whole number."""
    plain = F.regexp_replace(F.regexp_replace(F.format_number(F.abs(value), 4), ",", ""), r"\.?0+$", "")
    return F.array_contains(words(text), plain)


def without_answer_line(answer: Column) -> Column:
    """The explanation alone: the answer without its answer lines."""
    return F.regexp_replace(F.regexp_replace(answer, r"(?im)^\W*ANSWER\s*:.*$\n?", ""), r"^\s+|\s+$", "")


def highlighted(text: Column, value: Column, before: str = "<mark>", after: str = "</mark>") -> Column:
    """The text with each place marked where the number stands, with or without thousands separators. Null without a number."""
    digits = F.regexp_replace(F.format_number(F.abs(value), 4), r"\.?0+$", "")
    pattern = F.concat(F.lit(r"(?<![\d.,])"), F.regexp_replace(F.replace(digits, F.lit("."), F.lit("\\.")), ",", ",?"), F.lit(r"(?![\d]|[.,]\d)"))
    return F.regexp_replace(text, pattern, F.lit(f"{before}$0{after}"))


def label_row_key(*fields: Column) -> Column:
    """First 12 hexadecimal digits of the hash of the fields that a label reads."""
    return F.left(F.sha2(F.to_json(F.array(*(f.cast("string") for f in fields))), 256), F.lit(12))
