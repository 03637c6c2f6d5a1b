"""SQL that each registered query is compared with, written independently for another engine."""

from __future__ import annotations

CUR = """cur AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY filing_stem, chunk_index, variant ORDER BY ingested_at DESC NULLS LAST, id DESC) AS rn
  FROM chunks WHERE variant = 'A' AND filing_stem IS NOT NULL AND chunk_index IS NOT NULL) WHERE rn = 1)"""
ASKED = "asked AS (SELECT DISTINCT request_id AS query_id, question FROM ask_requests WHERE request_id % 50 = 0 AND question IS NOT NULL)"
CITED = "cites AS (SELECT DISTINCT query_id, split_part(c.filing_stem, '_', 1) AS ticker FROM (SELECT request_id AS query_id, unnest(citations) AS c FROM ask_responses WHERE request_id % 50 = 0))"
_USABLE = "len({v}) = 64 AND len(list_filter({v}, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter({v}, lambda x: x <> 0)) > 0"
_SPACE = r"[\s\x0b\x1c-\x1f\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_YEAR = r"(?:19[5-9]\d|20[0-4]\d)"


def _dense(filtered: bool) -> str:
    own = "AND (NOT EXISTS (SELECT 1 FROM cites x WHERE x.query_id = a.query_id) OR EXISTS (SELECT 1 FROM cites x WHERE x.query_id = a.query_id AND x.ticker = split_part(c.filing_stem, '_', 1)))" if filtered else ""
    return f"""dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, filing_stem, chunk_index) AS rank FROM (
  SELECT a.query_id, c.filing_stem, c.chunk_index, round(list_cosine_similarity(c.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score
  FROM asked a JOIN embeddings e ON e.vec_id * 50 = a.query_id JOIN cur c ON {_USABLE.format(v="c.embedding")} {own} WHERE {_USABLE.format(v="e.embedding")})) WHERE rank <= 200)"""


def _bm25(filtered: bool, k: int = 200) -> str:
    own = "WHERE NOT EXISTS (SELECT 1 FROM cites x WHERE x.query_id = q.query_id) OR EXISTS (SELECT 1 FROM cites x WHERE x.query_id = q.query_id AND x.ticker = split_part(f.filing_stem, '_', 1))" if filtered else ""
    return rf"""docs AS (SELECT filing_stem, chunk_index, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS ts FROM cur WHERE text IS NOT NULL),
tf AS (SELECT filing_stem, chunk_index, term, len(ts) AS dl, count(*) AS tf FROM (SELECT filing_stem, chunk_index, ts, unnest(ts) AS term FROM docs) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
tot AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM docs),
qt AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(question), '[\p{{L}}\p{{N}}]+')) AS term FROM asked),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, filing_stem, chunk_index) AS rank FROM (
  SELECT q.query_id, f.filing_stem, f.chunk_index, round(sum(ln(1 + (t.n - d.df + 0.5) / (d.df + 0.5)) * f.tf * 2.2::DOUBLE / (f.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * f.dl / t.mean))), 9) AS score
  FROM qt q JOIN df d USING (term) JOIN tf f USING (term) CROSS JOIN tot t {own} GROUP BY ALL)) WHERE rank <= {k})"""


def years_of(text: str) -> str:
    """Years of a text: amounts and counts are deleted first, since this engine's patterns cannot look behind."""
    units = "|".join(f"{_SPACE}{{{{0,{20 - len(u)}}}}}{u}" for u in ("million", "billion", "thousand", "%", "percent", "shares", "units", "bps", "basis points")).replace("{{", "{").replace("}}", "}")
    clean = rf"regexp_replace({text}, '\${_SPACE}{{0,5}}{_YEAR}\b', ' ', 'g')"
    clean = rf"regexp_replace({clean}, '\b{_YEAR}(?i:{units})', ' ', 'g')"
    plain = rf"list_transform(regexp_extract_all({clean}, '\b({_YEAR})\b', 1), lambda y: y::INT)"
    short = rf"list_transform(regexp_extract_all({text}, '(?i)\bFY{_SPACE}?(\d\d)\b', 1), lambda y: CASE WHEN y::INT > 50 THEN 1900 + y::INT ELSE 2000 + y::INT END)"
    return f"list_sort(list_distinct(list_concat({plain}, {short})))"


_NO_YEARS = "yrs AS (SELECT query_id, []::INT[] AS ys FROM asked)"
_YEARS = f"yrs AS (SELECT query_id, {years_of('question')} AS ys FROM asked)"


def _fuse(name: str, lists: list[str], k: int | None = None) -> str:
    every = " UNION ALL ".join(f"SELECT query_id, filing_stem, chunk_index, {i} AS l, rank FROM {x}" for i, x in enumerate(lists))
    total = " + ".join(["0.0::DOUBLE", *(f"coalesce(1.0::DOUBLE / (60 + min(CASE WHEN l = {i} THEN u.rank END)), 0.0::DOUBLE)" for i in range(len(lists)))])
    bonus = "coalesce(0.01::DOUBLE / (1 + list_min(list_transform(any_value(y.ys), lambda v: abs(try_cast(split_part(u.filing_stem, '_', 2) AS INT) - v)))), 0.0::DOUBLE)"
    return f"""{name} AS (SELECT query_id, filing_stem, chunk_index, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, filing_stem, chunk_index) AS rank FROM (
  SELECT u.query_id, u.filing_stem, u.chunk_index, round({total} + {bonus}, 12) AS score, min(u.l * 100000 + u.rank) AS seen FROM ({every}) u JOIN yrs y ON y.query_id = u.query_id GROUP BY u.query_id, u.filing_stem, u.chunk_index)){f" WHERE rank <= {k}" if k else ""})"""


_YTL = f"""ytl AS (SELECT b.query_id, b.filing_stem, b.chunk_index, row_number() OVER (PARTITION BY b.query_id ORDER BY b.rank) AS rank
  FROM base b JOIN cur c USING (filing_stem, chunk_index) JOIN yrs y ON y.query_id = b.query_id WHERE c.text IS NOT NULL AND len(list_intersect({years_of("c.text")}, y.ys)) > 0)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)


_WORDS = r"regexp_extract_all(regexp_replace(regexp_replace(lower({x}), '(\d),(\d)', '\1\2', 'g'), '(\d),(\d)', '\1\2', 'g'), '\d+\.\d+|[a-z0-9]+')"
_NUMS = r"list_distinct(list_filter({w}, lambda w: regexp_full_match(w, '\d+(\.\d+)?') AND length(replace(w, '.', '')) >= 3 AND NOT regexp_full_match(w, '(19|20)\d\d')))"
_LEGAL = "incorporated|corporation|company|companies|holdings?|group|international|industries|enterprises|technologies|systems|solutions|services|partners|inc|corp|co|ltd|plc|llc|lp|llp|nv|sa|ag|se|spa|kk|the"


def words_of(x: str) -> str:
    return _WORDS.format(x=x)


def nums_of(x: str) -> str:
    return _NUMS.format(w=words_of(x))


def normal_of(x: str) -> str:
    return rf"' ' || trim(regexp_replace(regexp_replace(replace(lower({x}), '&', ' and '), '[''’]s\b', '', 'g'), '[^a-z0-9]+', ' ', 'g')) || ' '"


def bare_of(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({x}, '(?i)\b({_LEGAL})\b', ' ', 'g'), '\s+', ' ', 'g'))"


_LEX = f"""names AS (SELECT DISTINCT company_symbol AS s, trim({normal_of("company_name")}) AS f FROM companies WHERE company_name IS NOT NULL AND company_symbol IS NOT NULL),
forms AS (SELECT s, f AS a FROM names UNION SELECT s, regexp_replace(f, ' the$', '') FROM names WHERE f LIKE '% the' UNION SELECT s, substr(f, 5) FROM names WHERE f LIKE 'the %'
  UNION SELECT s, {bare_of("f")} FROM names UNION SELECT s, split_part({bare_of("f")}, ' ', 1) FROM names),
lex AS (SELECT a AS alias, string_agg(DISTINCT s, ',' ORDER BY s) AS tickers FROM forms WHERE length(a) >= 3 GROUP BY a)"""

_KEY = "filing_stem || '#' || chunk_index"
_GOLD = f"""gold AS (SELECT query_id, list(DISTINCT k) FILTER (WHERE k IS NOT NULL) AS rel FROM (SELECT request_id AS query_id, c.filing_stem || '#' || c.chunk_index AS k FROM (
  SELECT request_id, unnest(CASE WHEN len(citations) > 0 THEN citations ELSE [NULL] END) AS c FROM ask_responses WHERE request_id % 50 = 0)) GROUP BY query_id)"""
_SCORED = f"""ranks AS (SELECT query_id, {_KEY} AS k, rank FROM dense),
hits AS (SELECT r.query_id, r.rank FROM ranks r JOIN gold g ON g.query_id = r.query_id WHERE list_contains(g.rel, r.k)),
per AS (SELECT g.query_id, coalesce(len(g.rel), 0) AS n, EXISTS (SELECT 1 FROM ranks r WHERE r.query_id = g.query_id) AS has,
  (SELECT count(*) FROM hits h WHERE h.query_id = g.query_id AND h.rank <= 10) AS h10, (SELECT count(*) FROM hits h WHERE h.query_id = g.query_id AND h.rank <= 50) AS h50,
  (SELECT coalesce(sum(1 / log2(h.rank + 1)), 0) FROM hits h WHERE h.query_id = g.query_id AND h.rank <= 10) AS dcg, (SELECT min(h.rank) FROM hits h WHERE h.query_id = g.query_id) AS f FROM gold g),
sc AS (SELECT query_id, NOT has AS missing, (has AND n = 0) AS no_gold, CASE WHEN has AND n > 0 THEN h10 / n END AS recall_10, CASE WHEN has AND n > 0 THEN h50 / n END AS recall_50,
  CASE WHEN has AND n > 0 THEN dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda r: 1 / log2(r + 1))) END AS ndcg_10, CASE WHEN has AND n > 0 THEN coalesce(1.0::DOUBLE / f, 0.0::DOUBLE) END AS mrr FROM per)"""
_MEANS = ", ".join(f"round(avg({m}), 9) AS {m}_mean, round(CASE WHEN count({m}) > 0 THEN coalesce(stddev_samp({m}), 0) / sqrt(count({m})) END, 9) AS {m}_stderr" for m in ("recall_10", "recall_50", "ndcg_10", "mrr"))

_FURN = r"""(length(b) = 0 OR regexp_matches(b, '(?:\bZEQ\b|\bSEQ\s*=|\bCP\s*=|\bEFW\s*=)') OR regexp_matches(b, '^/s/') OR (regexp_full_match(b, '[^A-Za-z]+'))
  OR regexp_matches(b, '(?i)^(?:page\s+)?(?:[FSABC]|I{1,3}|IV|VI{0,3})?[-–]\s?\d{1,3}$') OR regexp_matches(b, '^\d{1,3}$'))"""
_TRUE = "'yes','true','higher','greater','increase','increased','more'"
_FALSE = "'no','false','lower','less','decrease','decreased','fewer'"
_MATCHED = """matched AS (SELECT DISTINCT q.id, s.filing_stem, q.subset_source FROM questions q JOIN (SELECT split_part(filing_stem, '_', -1)::BIGINT AS c, split_part(filing_stem, '_', -2)::INT AS y, max(filing_stem) AS filing_stem
  FROM chunks WHERE regexp_full_match(filing_stem, '.*_\\d+_\\d+') GROUP BY 1, 2) s ON s.c = q.company_cik AND s.y = q.report_year WHERE q.subset_source IN ('FinQA', 'ConvFinQA'))""".replace("\\\\", "\\")
_RESULTS = """res AS (SELECT r.query_id, r.rank, r.filing_stem, r.chunk_index, r.score, c.text FROM (SELECT query_id, rank, x.filing_stem AS filing_stem, x.chunk_index AS chunk_index, x.score AS score FROM (
  SELECT query_id, unnest(cs) AS x, unnest(range(1, len(cs) + 1)) AS rank FROM (SELECT DISTINCT request_id AS query_id, citations AS cs FROM ask_responses))) r
  JOIN cur c ON c.filing_stem = r.filing_stem AND c.chunk_index = r.chunk_index WHERE c.text IS NOT NULL)"""
_EVID = "ev AS (SELECT query_id, string_agg('[' || filing_stem || ' chunk ' || chunk_index || '] ' || text, chr(10) || chr(10) ORDER BY rank) AS evidence FROM res GROUP BY query_id)"


_GOLD_ROWS = rf"""lines AS (SELECT 'q#' || filing_stem || '#' || chunk_index AS question_id, filing_stem, list_filter(string_split(text, chr(10)), lambda x: contains(x, ' | ')) AS ls FROM cur WHERE text IS NOT NULL),
body AS (SELECT question_id, filing_stem, row_no, string_split(line, ' | ') AS cells FROM (SELECT question_id, filing_stem, unnest(range(len(ls))) AS row_no, unnest(ls) AS line FROM lines) WHERE row_no > 0),
own AS (SELECT filing_stem, chunk_index, {words_of("text")} AS ws FROM cur WHERE text IS NOT NULL), nums AS (SELECT filing_stem, chunk_index, unnest({_NUMS.format(w="ws")}) AS num FROM own),
often AS (SELECT filing_stem, num FROM nums GROUP BY 1, 2 HAVING count(*) > 5),
wanted AS (SELECT * FROM (SELECT question_id, row_no, filing_stem, list_distinct(list_filter({words_of("cells[1]")}, lambda w: NOT regexp_full_match(w, '\d+(\.\d+)?'))) AS label, unnest({nums_of("array_to_string(cells, ' ')")}) AS num FROM body) ANTI JOIN often USING (filing_stem, num)),
total AS (SELECT question_id, row_no, count(*) AS n FROM wanted GROUP BY 1, 2),
got AS (SELECT question_id, row_no, filing_stem, chunk_index, any_value(label) AS label, list(DISTINCT num) AS got FROM wanted JOIN nums USING (filing_stem, num) GROUP BY 1, 2, 3, 4),
seen AS (SELECT question_id, row_no, chunk_index, got, len(label) > 0 AND len(list_intersect(label, ws)) / len(label) >= 0.6 AS label_ok FROM got JOIN own USING (filing_stem, chunk_index))
"""


def oracle_sql() -> dict[str, str]:
    from quarry.plans.answer import PROMPT

    cols = "SELECT query_id, filing_stem, chunk_index, score, rank FROM "
    head, rest = PROMPT.split("{question}")
    middle, tail = (x.replace("'", "''") for x in rest.split("{evidence}"))
    stage = _with(CUR, ASKED, _dense(False), _bm25(False), _YEARS, _fuse("base", ["dense", "bm"]), _YTL, _fuse("pool", ["dense", "bm", "ytl"], 50))
    stage_t = _with(CUR, ASKED, CITED, _dense(True), _bm25(True), _YEARS, _fuse("base", ["dense", "bm"]), _YTL, _fuse("pool", ["dense", "bm", "ytl"], 50))
    line = r"'(?im)ANSWER\s*:\s*([^\n]+?)[ \t\r\x{00A0}]*$'"
    return {
        "dense_topk": _with(CUR, ASKED, _dense(False)) + cols + "dense",
        "dense_topk_ticker": _with(CUR, ASKED, CITED, _dense(True)) + cols + "dense",
        "bm25_topk": _with(CUR, ASKED, _bm25(False)) + cols + "bm",
        "bm25_topk_ticker": _with(CUR, ASKED, CITED, _bm25(True)) + cols + "bm",
        "rrf_fuse": _with(CUR, ASKED, _dense(False), _bm25(False), _NO_YEARS, _fuse("base", ["dense", "bm"])) + cols + "base",
        "rrf_fuse_years": _with(CUR, ASKED, _dense(False), _bm25(False), _YEARS, _fuse("base", ["dense", "bm"])) + cols + "base",
        "year_text_list": stage + "SELECT * FROM ytl",
        "first_stage": stage + cols + "pool",
        "first_stage_ticker": stage_t + cols + "pool",
        "chunk_text_fetch": _with(CUR, "pairs AS (SELECT DISTINCT c.filing_stem AS fs, c.chunk_index AS ci FROM (SELECT unnest(citations) AS c FROM ask_responses))") + "SELECT filing_stem, chunk_index, text FROM cur JOIN pairs ON fs = filing_stem AND ci = chunk_index WHERE text IS NOT NULL",
        "rerank_topk": _with(CUR, ASKED, _bm25(False, 50)) + r""", ov AS (SELECT b.query_id, b.filing_stem, b.chunk_index, b.rank, list_distinct(regexp_extract_all(lower(a.question), '[\p{L}\p{N}]+')) AS q, regexp_extract_all(lower(c.text), '[\p{L}\p{N}]+') AS d
  FROM bm b JOIN asked a USING (query_id) JOIN cur c ON c.filing_stem = b.filing_stem AND c.chunk_index = b.chunk_index WHERE c.text IS NOT NULL),
s AS (SELECT query_id, filing_stem, chunk_index, rank, round(len(list_intersect(q, d)) / greatest(len(q), 1), 9) AS score FROM ov)
SELECT query_id, filing_stem, chunk_index, score, place AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS place FROM s) WHERE place <= 10""",
        "year_extract": f"SELECT id, unnest({years_of('text')}) AS year FROM chunks WHERE text IS NOT NULL",
        "year_bonus": f"""SELECT DISTINCT request_id, c.filing_stem AS filing_stem, round(coalesce(0.01::DOUBLE / (1 + list_min(list_transform(ys, lambda v: abs(try_cast(split_part(c.filing_stem, '_', 2) AS INT) - v)))), 0.0::DOUBLE), 9) AS bonus
  FROM (SELECT request_id, {years_of("question")} AS ys, unnest(citations) AS c FROM ask_responses)""",
        "preflight": "SELECT coalesce(c.variant, e.variant) AS variant, coalesce(n, 0) AS n_rows, coalesce(m, 0) AS n_embedded, coalesce(n, 0) - coalesce(x, 0) AS delta, (coalesce(n, 0) = coalesce(x, 0) AND coalesce(n, 0) = coalesce(m, 0)) AS ok FROM (SELECT variant, count(*) AS n, count(embedding) AS m FROM chunks GROUP BY variant) c FULL JOIN (SELECT 'A' AS variant, 99654 AS x) e ON c.variant = e.variant",
        "ingest_stats": "SELECT filing_stem, count(*) AS n_chunks, coalesce((list_sort(list(n_tokens) FILTER (WHERE n_tokens IS NOT NULL)))[count(n_tokens) // 2 + 1], 0) AS median_tokens, coalesce(max(n_tokens), 0) AS max_tokens FROM chunks GROUP BY filing_stem",
        "block_stats": "SELECT filing_stem, count(*) AS n_blocks, count(*) FILTER (WHERE coalesce(is_table, false)) AS n_tables FROM (SELECT DISTINCT * FROM atoms) GROUP BY 1",
        "status_histogram": "SELECT status, count(*) AS n, round(avg(fetch_s), 9) AS fetch_s, round(avg(parse_s), 9) AS parse_s FROM (SELECT DISTINCT * FROM ingest_log) GROUP BY status",
        "retrieval_seconds": "SELECT 'total' AS stage, round(avg(latency_s), 6) AS mean_s, count(latency_s) AS n FROM ask_responses UNION ALL SELECT e.key AS stage, round(avg(e.value), 6), count(e.value) FROM (SELECT unnest(map_entries(stage_latency)) AS e FROM ask_responses) GROUP BY 1",
        "recall_ndcg_mrr": _with(CUR, ASKED, CITED, _dense(True), _GOLD, _SCORED) + "SELECT query_id, missing, no_gold, round(recall_10, 9) AS recall_10, round(recall_50, 9) AS recall_50, round(ndcg_10, 9) AS ndcg_10, round(mrr, 9) AS mrr FROM sc",
        "score_report": _with(CUR, ASKED, CITED, _dense(True), _GOLD, _SCORED) + f"SELECT count(*) FILTER (WHERE NOT missing AND NOT no_gold) AS n_scored, count(*) AS n_questions, count(*) FILTER (WHERE missing) AS skipped_missing, count(*) FILTER (WHERE no_gold) AS skipped_no_gold, {_MEANS} FROM sc",
        "load_ranking": "SELECT request_id::VARCHAR AS id, x.filing_stem AS filing_stem, x.chunk_index AS chunk_index, x.score AS score, row_number() OVER (PARTITION BY request_id ORDER BY x.score DESC, pos) AS rank FROM (SELECT request_id, unnest(citations) AS x, unnest(range(len(citations))) AS pos FROM (SELECT DISTINCT request_id, citations FROM ask_responses))",
        "rows_per_document": "SELECT context_id, count(*) AS n FROM questions GROUP BY context_id",
        "union_subsets": "SELECT subset_source, lower(trim(split)) AS split, count(*) AS n FROM questions WHERE subset_source IN ('ConvFinQA', 'FinQA', 'TAT-DQA') GROUP BY 1, 2",
        "matched_questions": _with(_MATCHED) + "SELECT * FROM matched",
        "targets": "SELECT company_symbol || '_' || report_year || '_' || company_cik AS filing_stem, company_symbol, report_year, company_cik FROM (SELECT *, row_number() OVER (PARTITION BY company_cik, report_year ORDER BY id, company_symbol) AS n FROM questions WHERE company_cik IS NOT NULL AND report_year IS NOT NULL) WHERE n = 1",
        "file_index": r"SELECT split_part(stem, '_', -1)::BIGINT AS company_cik, split_part(stem, '_', -2)::INT AS report_year, max(stem) AS filing_stem FROM ingest_log WHERE regexp_full_match(stem, '.+_\d+_\d+') GROUP BY 1, 2",
        "unindexed_filings": "SELECT DISTINCT stem AS filing_stem FROM ingest_log WHERE stem IS NOT NULL AND stem NOT IN (SELECT filing_stem FROM atoms WHERE filing_stem IS NOT NULL)",
        "variant_filter": _with(CUR) + "SELECT id, filing_stem, chunk_index, split_part(filing_stem, '_', 1) AS ticker, try_cast(split_part(filing_stem, '_', 2) AS INT) AS fiscal_year, try_cast(split_part(filing_stem, '_', 3) AS BIGINT) AS cik FROM cur",
        "running_headers": r"SELECT filing_stem, trim(regexp_replace(lower(heading), '\s+', ' ', 'g')) AS title, count(*) AS n FROM chunks WHERE heading IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 10",
        "furniture_titles": rf"""WITH tt AS (SELECT DISTINCT filing_stem, atom_id, text FROM atoms WHERE is_title), k AS (SELECT *, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t, trim(regexp_replace(text, '^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '', 'g')) AS b FROM tt)
SELECT filing_stem, atom_id, {_FURN} OR count(*) OVER (PARTITION BY filing_stem, t) >= 10 AS is_furniture FROM k""",
        "normalize_words": f"SELECT id, len(w) AS n_words, len(list_distinct(w)) AS n_distinct, md5(array_to_string(w, ' ')) AS words_md5 FROM (SELECT id, {words_of('text')} AS w FROM chunks WHERE text IS NOT NULL)",
        "numeric_tokens": f"SELECT id, unnest({nums_of('text')}) AS num FROM chunks WHERE text IS NOT NULL",
        "num_doc_freq": _with(CUR) + f"SELECT filing_stem, num, count(*) AS df FROM (SELECT filing_stem, unnest({nums_of('text')}) AS num FROM cur WHERE text IS NOT NULL) GROUP BY 1, 2 HAVING count(*) <= 5",
        "gap_clusters": _with(CUR) + """, m AS (SELECT filing_stem AS g, chunk_index AS p FROM cur WHERE contains(lower(text), 'goodwill')), l AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY g ORDER BY p) > 3 THEN 1 ELSE 0 END AS s FROM m),
c AS (SELECT *, sum(s) OVER (PARTITION BY g ORDER BY p ROWS UNBOUNDED PRECEDING) AS cluster FROM l) SELECT g AS "group", cluster::BIGINT AS cluster, min(p) AS first, max(p) AS last, count(*) AS n FROM c GROUP BY 1, 2""",
        "summary_match": _with(CUR) + ", q AS (SELECT 'q#' || filing_stem || '#' || chunk_index AS question_id, filing_stem, heading FROM cur WHERE heading IS NOT NULL) SELECT DISTINCT question_id, c.chunk_index FROM q JOIN cur c USING (filing_stem) WHERE contains(c.text, q.heading)",
        "row_cover": _with(CUR, _GOLD_ROWS) + """SELECT question_id, row_no, unnest(l.h) AS chunk_index FROM (SELECT question_id, row_no, list_reduce(list({'c': got, 'h': [chunk_index]} ORDER BY -len(got), NOT label_ok, chunk_index),
  lambda s, x: CASE WHEN len(list_filter(x.c, lambda v: NOT list_contains(s.c, v))) > 0 THEN {'c': list_distinct(list_concat(s.c, x.c)), 'h': list_concat(s.h, x.h)} ELSE s END) AS l FROM seen WHERE len(got) >= 2 OR label_ok GROUP BY 1, 2) JOIN total USING (question_id, row_no) WHERE len(l.c) / n >= 0.6""",
        "label_diff": """WITH q AS (SELECT id, min(split) AS s, min(subset_source) AS subset FROM questions WHERE id IS NOT NULL GROUP BY id),
o AS (SELECT lower(trim(s)) AS split, id, s AS rk, length(s) AS g FROM q WHERE subset IN ('FinQA', 'ConvFinQA')), n AS (SELECT lower(trim(s)) AS split, id, lower(s) AS rk, length(trim(s)) AS g FROM q WHERE subset IN ('ConvFinQA', 'TAT-DQA'))
SELECT * FROM (SELECT coalesce(o.split, n.split) AS split, coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL THEN 'missing' WHEN o.id IS NULL THEN 'extra' WHEN o.g IS DISTINCT FROM n.g THEN 'gold differs' WHEN o.rk IS DISTINCT FROM n.rk THEN 'row differs' END AS change
  FROM o FULL JOIN n ON o.id = n.id AND o.split = n.split) WHERE change IS NOT NULL""",
        "company_normalize": f"SELECT company_cik, {normal_of('company_name')} AS normal, {bare_of('trim(' + normal_of('company_name') + ')')} AS bare FROM companies",
        "lexicon_build": _with(_LEX) + "SELECT alias, tickers FROM lex",
        "alias_candidates": _with(_LEX) + f"SELECT r.query_id, l.alias, l.tickers FROM (SELECT DISTINCT request_id AS query_id, {normal_of('question')} AS t FROM ask_requests WHERE question IS NOT NULL) r JOIN lex l ON contains(r.t, ' ' || l.alias || ' ')",
        "ticker_forms": "WITH s AS (SELECT DISTINCT company_symbol AS c FROM companies WHERE company_symbol IS NOT NULL) SELECT c AS written, CASE WHEN length(c) > 2 THEN c || ',' || c[:-2] ELSE c END AS forms FROM s UNION ALL SELECT c || '.B', c || 'B,' || c FROM s UNION ALL SELECT c || '-A', c || 'A,' || c FROM s",
        "stem_parts": "SELECT DISTINCT stem AS filing_stem, split_part(stem, '_', 1) AS ticker, try_cast(split_part(stem, '_', 2) AS INT) AS fiscal_year, try_cast(split_part(stem, '_', 3) AS BIGINT) AS cik FROM ingest_log",
        "document_url": "SELECT o_orderkey, 'https://www.sec.gov/Archives/edgar/data/' || o_custkey || '/' || lpad(o_custkey::VARCHAR, 10, '0') || '24' || lpad(o_orderkey::VARCHAR, 6, '0') || '/main.htm' AS url, 'CIK' || lpad(o_custkey::VARCHAR, 10, '0') || '.json' AS page FROM orders",
        "edgar_match": "SELECT company_cik, fiscal_year, accession_number, primary_document, filing_date FROM (SELECT o_custkey AS company_cik, year(o_orderdate)::INT AS fiscal_year, o_orderkey::VARCHAR AS accession_number, 'd' || o_orderkey || '.htm' AS primary_document, strftime(o_orderdate::DATE + 60, '%Y-%m-%d') AS filing_date, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderkey % 2, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F') WHERE n = 1",
        "parse_answer": rf"""WITH r AS (SELECT DISTINCT request_id, answer FROM ask_responses), l AS (SELECT request_id, answer, regexp_matches(answer, {line}) AS has, regexp_extract(answer, {line}, 1) AS b FROM r),
n AS (SELECT *, regexp_extract(b, '-?\$?\d[\d,]*(?:\.\d+)?%?') AS num, trim(split_part(trim(regexp_replace(lower(b), '\s+', ' ', 'g')), ' ', 1), '.,;:') AS w FROM l),
v AS (SELECT *, try_cast(regexp_replace(num, '[,$%]', '', 'g') AS DOUBLE) AS f FROM n)
SELECT request_id, CASE WHEN NOT has THEN NULL WHEN num <> '' THEN f WHEN w IN ({_TRUE}) THEN 1.0 WHEN w IN ({_FALSE}) THEN 0.0 END AS value,
CASE WHEN answer IS NULL OR NOT regexp_matches(answer, '\S') THEN 'empty' WHEN NOT has THEN 'no_answer_line' WHEN num <> '' AND f IS NOT NULL THEN 'ok' WHEN num <> '' THEN 'no_number' WHEN w IN ({_TRUE}, {_FALSE}) THEN 'ok'
  WHEN regexp_matches(b, '(?i)insufficient|cannot|not (?:provided|available|stated|found)|unknown') THEN 'refused' ELSE 'no_number' END AS status FROM v""",
        "answer_headline": r"""SELECT DISTINCT request_id, CASE WHEN l <> '' THEN l ELSE split_part(trim(answer), chr(10), 1) END AS headline FROM (SELECT request_id, answer, regexp_extract(answer, '(?im)^[^A-Za-z0-9_]*ANSWER\s*:\s*(.+?)[^A-Za-z0-9_]*$', 1) AS l FROM ask_responses WHERE answer IS NOT NULL)""",
        "label_row_key": "SELECT DISTINCT id, context_id, left(sha256(to_json([id, context_id, context])), 12) AS row_key FROM questions WHERE id IS NOT NULL",
        "evidence_text": _with(CUR, _RESULTS, _EVID) + "SELECT query_id, md5(evidence) AS evidence_md5, length(evidence) AS n_chars FROM ev",
        "prompts": _with(CUR, "asked AS (SELECT DISTINCT request_id AS query_id, question FROM ask_requests WHERE question IS NOT NULL)", _RESULTS, _EVID) + f"SELECT query_id, md5(p) AS prompt_md5, length(p) AS n_chars FROM (SELECT query_id, '{head}' || question || '{middle}' || evidence || '{tail}' AS p FROM asked JOIN ev USING (query_id))",
        "citation_texts": _with(CUR, _RESULTS) + "SELECT r.query_id, row_number() OVER (PARTITION BY r.query_id ORDER BY rank) - 1 AS pos, filing_stem, chunk_index, CASE WHEN w.wants THEN text END AS text FROM res r JOIN (SELECT request_id AS query_id, bool_or(include_text) AS wants FROM ask_requests GROUP BY 1) w ON w.query_id = r.query_id",
        "request_validation": "SELECT DISTINCT request_id, coalesce(k, 10) AS k, coalesce(include_text, false) AS include_text, coalesce(length(question) BETWEEN 1 AND 2000 AND coalesce(k, 10) BETWEEN 1 AND 50, false) AS valid FROM ask_requests",
        "cited_value": _with(CUR) + rf""", p AS (SELECT DISTINCT request_id, value, c.filing_stem AS filing_stem, c.chunk_index AS chunk_index FROM (SELECT request_id, value, unnest(citations) AS c FROM ask_responses WHERE value IS NOT NULL))
SELECT request_id, filing_stem, chunk_index, list_contains({words_of("text")}, regexp_replace(printf('%.4f', abs(value)), '\.?0+$', '')) AS hit FROM p JOIN cur USING (filing_stem, chunk_index) WHERE text IS NOT NULL""",
        "sse_frames": """SELECT DISTINCT request_id, 'event: answer' || chr(10) || 'data: {"request_id":' || request_id || ',"value_status":"' || coalesce(value_status, 'empty') || '"}' || chr(10) || chr(10) AS frame FROM ask_responses""",
        "table_clean": r"""SELECT atom_id, row_no, regexp_replace(list_aggregate(list_filter(list_transform(string_split(line, ' | '), lambda c: trim(c)), lambda c: c <> ''), 'string_agg', '|'), '(^|\|)(-?\$)\|', '\1\2', 'g') AS cells
FROM (SELECT atom_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS row_no FROM (SELECT DISTINCT atom_id, text FROM atoms WHERE is_table AND text IS NOT NULL)) WHERE contains(line, ' | ')""",
        "table_text": r"""SELECT DISTINCT atom_id, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda r: coalesce(replace(regexp_replace(list_aggregate(list_filter(list_transform(string_split(r, ' | '), lambda c: trim(c)), lambda c: c <> ''), 'string_agg', chr(1)), '(^|\x01)(-?\$)\x01', '\1\2', 'g'), chr(1), ' | '), '')), chr(10))) AS text_md5
FROM atoms WHERE is_table AND text IS NOT NULL""",
        "carried_heading": "SELECT filing_stem, atom_id, last_value(CASE WHEN coalesce(is_title, false) AND NOT coalesce(is_furniture, false) THEN text END IGNORE NULLS) OVER (PARTITION BY filing_stem ORDER BY atom_index, atom_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM (SELECT DISTINCT filing_stem, atom_id, atom_index, text, is_title, is_furniture FROM atoms)",
        "next_text_tokens": "SELECT filing_stem, atom_id, CASE WHEN coalesce(is_table, false) AND nx IS NOT NULL AND NOT coalesce(nt, false) AND NOT coalesce(nb, false) THEN coalesce(nk, 0) ELSE 0 END AS ahead FROM (SELECT *, lead(atom_id) OVER w AS nx, lead(is_title) OVER w AS nt, lead(is_table) OVER w AS nb, lead(tokens) OVER w AS nk FROM (SELECT DISTINCT filing_stem, atom_id, atom_index, tokens, is_title, is_table FROM atoms) WINDOW w AS (PARTITION BY filing_stem ORDER BY atom_index, atom_id))",
        "ordered_headings": _with(CUR) + ", f AS (SELECT filing_stem, heading, min(chunk_index) AS c FROM cur WHERE heading IS NOT NULL GROUP BY 1, 2) SELECT filing_stem, string_agg(heading, ' > ' ORDER BY c) AS headings FROM f GROUP BY 1",
        "unit_vectors": f"SELECT id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm, round(list_max(v) / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS largest FROM (SELECT id, embedding::DOUBLE[] AS v FROM chunks WHERE {_USABLE.format(v='embedding')})",
        "late_requests": "SELECT date_trunc('hour', asked_at) AS hour, count(*) AS n, count(*) FILTER (WHERE epoch_us(received_at) - epoch_us(asked_at) > 60000000) AS n_late FROM (SELECT DISTINCT * FROM ask_requests) GROUP BY 1",
        "request_sequence": "SELECT client_id, request_id, row_number() OVER w AS nth, round((epoch_us(asked_at) - epoch_us(lag(asked_at) OVER w)) / 1e6, 3) AS gap_s FROM (SELECT DISTINCT client_id, request_id, asked_at FROM ask_requests) WINDOW w AS (PARTITION BY client_id ORDER BY asked_at, request_id)",
    }
