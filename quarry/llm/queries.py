"""Registered queries of this subpackage, each over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import answer_defects, eval_leaks, mojibake, name_variants, near_dupes, nn_forest, pack, repeated_lines, split_long, tokenize_bpe
from quarry.llm.base import shared_path, stored, table

LIMIT, OVERLAP, CAPACITY, REPEATS = 1500, 100, 1500, 10


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    items = split_long.oversized_items(table(spark, d, "chunks"), table(spark, d, "atoms"))
    return split_long.split_oversized(items, LIMIT, OVERLAP)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_pieces(spark, d).where("piece_no = 0").select("item_kind", "item_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    listed = name_variants.forms(table(spark, d, "companies"), "company_cik", "company_symbol", "company_name", "aliases")
    return name_variants.named(table(spark, d, "ask_requests"), listed)


def p3_packed(spark: SparkSession, d: str) -> DataFrame:
    return pack.pack(table(spark, d, "atoms"), CAPACITY)


def p3_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack.containers(p3_packed(spark, d))


def p4_nearest(spark: SparkSession, d: str) -> DataFrame:
    return nn_forest.nearest(table(spark, d, "chunks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nn_forest.pairs(p4_nearest(spark, d))


def _merged_lines(spark: SparkSession, d: str) -> tuple[DataFrame, list[DataFrame], repeated_lines.LineCounts]:
    """The lines of all chunks with the number of their merge, what each merge newly crossed, and the state: chunks of the first
    half of the loading time are one partition, the later ones a delta to it."""
    c = table(spark, d, "chunks")
    middle = c.select(F.expr("(unix_micros(min(ingested_at)) + unix_micros(max(ingested_at))) div 2").alias("middle")).first()["middle"]
    merge = F.when(F.unix_micros("ingested_at") >= F.lit(middle), 1).otherwise(0)
    docs = c.select("id", F.col("filing_stem").alias("source"), F.col("chunk_index").alias("position"), "text", merge.alias("merge"))
    all_lines = stored(repeated_lines.lines(docs, "merge"), "lines")
    counts = repeated_lines.LineCounts(spark, shared_path(spark, "line-counts"), REPEATS)
    return all_lines, [stored(counts.merge(all_lines.where(F.col("merge") == k)), "crossed") for k in (0, 1)], counts


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    all_lines, (first, second), _ = _merged_lines(spark, d)
    return repeated_lines.occurrences(all_lines, first.unionByName(second))


def p5_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.rebuild(table(spark, d, "chunks"), p5_found(spark, d))


def p5_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Documents that the second partition's merge has rebuilt: older ones with a line that it makes cross, and its own."""
    all_lines, (_, second), counts = _merged_lines(spark, d)
    return repeated_lines.to_rebuild(all_lines, 1, second, counts.crossed())


def _near_duplicates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return near_dupes.near_duplicates(table(spark, d, "chunks").select("id", "text"), 0.7, 3, 25)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return near_dupes.row_pairs(*_near_duplicates(spark, d))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """The groups that the pairs of p6_found make, one row per record."""
    return near_dupes.groups(*_near_duplicates(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return answer_defects.defects(table(spark, d, "ask_responses"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return tokenize_bpe.encode(table(spark, d, "documents"), "doc_id", "text", ranks, public_tokenizers.PATTERN)


def _held_out(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "questions").where(F.lower(F.trim("split")) == "test")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return eval_leaks.leaks(table(spark, d, "documents"), _held_out(spark, d))


def p9_paraphrases(spark: SparkSession, d: str) -> DataFrame:
    return eval_leaks.paraphrases(table(spark, d, "documents"), _held_out(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    judged, _ = mojibake.judge(table(spark, d, "documents"))
    return judged.select(F.col("id").alias("doc_id"))


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return mojibake.restored(docs, *mojibake.judge(docs))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit()}


#: Tokens, words and usable vectors as the test data defines them.
_TOKENS = r"regexp_extract_all({x}, '[^ \t\r\n\x{{00A0}}]+')"
_WORDS = "regexp_extract_all(lower({x}), '[a-z0-9]+')"
_USABLE = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_LINES = r"""l AS (SELECT id, filing_stem, chunk_index, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, regexp_replace(trim(regexp_replace(lower(unnest(string_split(text, chr(10)))), '[^a-z0-9]+', ' ', 'g')), '[0-9]+', '#', 'g') AS k FROM chunks WHERE text IS NOT NULL AND filing_stem IS NOT NULL AND chunk_index IS NOT NULL),
f AS (SELECT filing_stem, k FROM l WHERE regexp_matches(k, '[a-z]') GROUP BY 1, 2 HAVING count(DISTINCT chunk_index) >= 10), gone AS (SELECT id, line_no FROM l JOIN f USING (filing_stem, k))"""


def oracle_sql() -> dict[str, str]:
    """SQL for the problems that it can express over whole tables; the others are tested against brute force."""
    return {
        "p1_found": f"SELECT 'chunk' AS item_kind, id AS item_id FROM chunks WHERE len({_TOKENS.format(x='text')}) > 1500 UNION SELECT 'atom', atom_id FROM atoms WHERE len({_TOKENS.format(x='text')}) > 1500",
        "p4_found": f"""WITH v AS (SELECT id, embedding::DOUBLE[] AS e FROM chunks WHERE {_USABLE}), p AS (SELECT a.id AS x, b.id AS y, round(list_cosine_similarity(a.e, b.e), 6) AS c FROM v a JOIN v b ON a.id <> b.id),
r AS (SELECT x, y, row_number() OVER (PARTITION BY x ORDER BY c DESC, y) AS n FROM p WHERE c >= 0.9) SELECT DISTINCT least(x, y) AS id_a, greatest(x, y) AS id_b FROM r WHERE n <= 5""",
        "p5_found": f"WITH {_LINES} SELECT id, line_no FROM gone",
        "p5_cleaned": f"""WITH {_LINES}, g AS (SELECT id, list(line_no) AS ns FROM gone GROUP BY id)
SELECT c.id, coalesce(array_to_string(list_filter(string_split(c.text, chr(10)), lambda x, i: NOT list_contains(g.ns, i)), chr(10)), '') AS text FROM chunks c JOIN g USING (id)""",
        "p5_incremental": f"""WITH {_LINES.replace("AS (SELECT id, filing_stem,", "AS (SELECT id, ingested_at, filing_stem,")}, m AS (SELECT (epoch_us(min(ingested_at)) + epoch_us(max(ingested_at))) // 2 AS m FROM chunks), o AS (SELECT l.*, coalesce(epoch_us(ingested_at) >= m, false) AS late FROM l, m),
f1 AS (SELECT filing_stem, k FROM o WHERE NOT late AND regexp_matches(k, '[a-z]') GROUP BY 1, 2 HAVING count(DISTINCT chunk_index) >= 10)
SELECT DISTINCT id FROM o JOIN f USING (filing_stem, k) LEFT JOIN (SELECT filing_stem, k, true AS early FROM f1) USING (filing_stem, k) WHERE late OR early IS NULL""",
        "p6_found": f"""WITH w AS (SELECT id, {_WORDS.format(x="text")} AS w FROM chunks WHERE text IS NOT NULL), s AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 25)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id), j AS (SELECT a.id AS x, b.id AS y, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2)
SELECT x AS id_a, y AS id_b FROM j JOIN n p ON p.id = x JOIN n q ON q.id = y WHERE k >= 0.7 * (p.n + q.n - k) - 1e-9""",
        "p6_groups": f"""WITH RECURSIVE w AS (SELECT id, {_WORDS.format(x="text")} AS w FROM chunks WHERE text IS NOT NULL), g AS (SELECT id, w, [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] AS s FROM w WHERE len(w) >= 25),
c AS (SELECT id, list_sort(list_distinct(s)) AS s FROM g), rep AS (SELECT s, min(id) AS rep FROM c GROUP BY s), m AS (SELECT id, rep FROM c JOIN rep USING (s)), s AS (SELECT rep AS id, unnest(s) AS x, len(s) AS n FROM rep),
j AS (SELECT a.id AS x, b.id AS y, any_value(a.n) AS p, any_value(b.n) AS q, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.id < b.id GROUP BY 1, 2), e AS (SELECT x, y FROM j WHERE k >= 0.7 * (p + q - k) - 1e-9),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e), r AS (SELECT DISTINCT x AS id, x AS o FROM b UNION SELECT b.y, r.o FROM r JOIN b ON b.x = r.id AND r.o < b.y), l AS (SELECT id, min(o) AS label FROM r GROUP BY id), d AS (SELECT x AS id, count(*) AS n FROM b GROUP BY 1)
SELECT m.id, coalesce(l.label, m.rep) AS group_id, coalesce(d.n, 0) AS n_links FROM m LEFT JOIN l ON l.id = m.rep LEFT JOIN d ON d.id = m.rep""",
        "p9_found": f"""WITH q AS (SELECT DISTINCT id, question, context FROM questions WHERE lower(trim(split)) = 'test' AND id IS NOT NULL), t AS (SELECT id, {_WORDS.format(x="question")} AS w FROM q UNION ALL SELECT id, {_WORDS.format(x="context")} FROM q),
g AS (SELECT DISTINCT id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS i FROM t WHERE len(w) >= 12)),
d AS (SELECT doc_id, {_WORDS.format(x="text")} AS w FROM documents WHERE text IS NOT NULL), h AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d WHERE len(w) >= 12))
SELECT DISTINCT doc_id, id AS question_id FROM h JOIN g USING (g)""",
    }
