"""Splitting, tokenizer, repeated lines, answers, leaks and encodings, each against a plain version or known cases."""

import random
import re

import pytest

from quarry.llm import answer_defects as ad
from quarry.llm import eval_leaks, mojibake, repeated_lines, split_long, tokenize_bpe

# ---- splitting


def tokens(text):
    return re.findall("[^ \t\r\n ]+", text)


def test_pieces_cover_the_text_with_exact_overlap():
    rng = random.Random(1)
    for kind in range(4):
        words = [rng.choice(["alpha", "beta", "gamma", "delta"]) + (rng.choice([".", "", "", "!"]) if kind else "") for _ in range(4000)]
        text = "".join(w + rng.choice([" ", " ", "\n", "\n\n"] if kind > 1 else [" "]) for w in words)
        cuts = split_long.pieces(text, 300, 40, is_table=kind == 3)
        parts = [tokens(text[a:b]) for a, b, _ in cuts]
        assert [len(p) for p in parts] == [n for *_, n in cuts] and max(map(len, parts)) <= 300
        whole = parts[0] + [w for p in parts[1:] for w in p[40:]]
        assert whole == tokens(text)
        for p, n in zip(parts, parts[1:]):
            assert p[-40:] == n[:40]
        if kind:
            assert all(re.search(r"[.!]$", p[-1]) or text[b:].lstrip(" ").startswith("\n") for p, (_, b, _) in zip(parts[:-1], cuts))


def test_cut_prefers_the_change_of_topic():
    a, b = "cats purr and cats sleep on warm mats. ", "stocks fell while bonds and yields rose. "
    text = a * 30 + b * 30
    (_, end, _), *_ = split_long.pieces(text, 400, 0)
    assert abs(end - len(a * 30)) <= len(b)


def test_stops_that_end_no_sentence():
    text = "Visa Inc. reported that U.S. revenue of approx. 5 rose. Next, costs fell to 3. 4 more followed. End"
    spans = [m.span() for m in split_long.TOKEN_RE.finditer(text)]
    natural, stop, _ = split_long.boundaries(text, spans, False)
    words = [text[a:b] for a, b in spans]
    assert [w for w, x in zip(words, natural) if x] == ["rose.", "followed."]
    assert [w for w, x in zip(words, stop) if x] == ["Inc.", "U.S.", "approx.", "3."]
    inside = "word " * 30 + "Visa Inc. rose " + "word " * 30
    assert [inside[a:b].split()[-1] for a, b, _ in split_long.pieces(inside, 50, 0)][0] == "Inc."


def test_split_rows(spark):
    long = "word " * 3100
    rows = [("chunk", 1, long, None), ("chunk", 1, long, None), ("chunk", 2, "word " * 1500, False), ("atom", 1, "x " * 1501, True), ("atom", 3, None, None), ("atom", 4, "", True)]
    df = spark.createDataFrame(rows, "item_kind string, item_id long, text string, is_table boolean")
    got = split_long.split_oversized(df, 1500, 0).orderBy("item_kind", "item_id", "piece_no").collect()
    assert [(r.item_kind, r.item_id, r.piece_no, r.n_tokens) for r in got] == [("atom", 1, 0, 1500), ("atom", 1, 1, 1), ("chunk", 1, 0, 1500), ("chunk", 1, 1, 1500), ("chunk", 1, 2, 100)]
    with pytest.raises(ValueError):
        split_long.split_oversized(df, 100, 100)


# ---- tokenizer


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    P = pytest.importorskip("public_tokenizers")
    ranks = tokenize_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    return ranks, P.PATTERN, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_words_of_any_length_and_script(reference):
    import regex

    ranks, pattern, ref = reference
    rng, split = random.Random(2), regex.compile(pattern).findall
    alphabets = ["abc", "aé ß", "日本語 x", "0123 .", "\U0001f600a ", "xy<|endoftext|>"]
    for n in [0, 1, 2, 5, 50, 199, 201, 900]:
        for letters in alphabets:
            text = "".join(rng.choice(letters) for _ in range(n))
            assert tokenize_bpe.encode_text(text, split, ranks, {}) == ref.encode_ordinary(text)
            for word in split(text):
                assert tokenize_bpe._encode_long(word.encode(), ranks) == ref.encode_ordinary(word)


def test_encode_rows(spark, reference, tmp_path):
    import public_tokenizers as P

    _, pattern, ref = reference
    texts = ["plain text", None, "", "  \n\t ", "<|endoftext|>", "plain text", "x" * 30_000, "Ünï — ☃"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in tokenize_bpe.encode(df, "doc_id", "text", P.path("byte_bpe_50k.tiktoken"), pattern).collect()}
    assert got == {i: ref.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}


# ---- repeated lines


def test_state_is_the_same_in_one_or_many_merges(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice(["s", "t", None]), rng.randrange(14), "\n".join(rng.choice(["Share this!", "By A. B", "Page 12", "Page 9", "", "42", f"own {i}"]) for _ in range(4)), min(2, i // 60)) for i in range(150)]
    rows += [(900, "only here", 1, "one line", 2), (901, "s", 1, None, 0)]
    df = spark.createDataFrame(rows, "id long, source string, position int, text string, merge int")
    every = repeated_lines.lines(df, "merge")
    one, many = (repeated_lines.LineCounts(spark, str(tmp_path / n)) for n in ("one", "many"))
    as_set = lambda x: {tuple(r) for r in x.collect()}
    whole = as_set(one.merge(every))
    fresh = [many.merge(every.where(f"merge = {k}")) for k in (0, 1)]
    kept = as_set(many.rows())
    fresh.append(many.merge(every.where("merge = 2")))
    sets = [as_set(f) for f in fresh]
    assert whole == set().union(*sets) == as_set(many.crossed()) == as_set(one.crossed()) and sum(map(len, sets)) == len(whole) > 0
    assert len(kept) < len(as_set(many.rows())) and as_set(many.rows()) == as_set(one.rows())
    assert as_set(many.merge(every.where("merge = 1"))) == set()  # a partition that comes again adds nothing
    normal = lambda s: re.sub("[0-9]+", "#", re.sub("[^a-z0-9]+", " ", s.lower()).strip())
    seen, at = {}, {}
    for i, s, p, text, _ in rows:
        for line in (text or "").split("\n"):
            if s and re.search("[a-z]", normal(line)):
                seen.setdefault((s, normal(line)), set()).add(p)
                at.setdefault((s, normal(line)), set()).add(i)
    want = {(i, n) for i, s, _, text, _ in rows if text for n, line in enumerate(text.split("\n"), 1) if len(seen.get((s, normal(line)), ())) >= 10}
    gone = repeated_lines.occurrences(every, one.crossed())
    assert want and as_set(gone) == want
    cleaned = {r.id: r.text for r in repeated_lines.rebuild(df, gone).collect()}
    assert cleaned == {i: "\n".join(x for n, x in enumerate(text.split("\n"), 1) if (i, n) not in want) for i, _, _, text, _ in rows if any(j == i for j, _ in want)}
    rebuilt = {r.id for r in repeated_lines.to_rebuild(every, 2, fresh[2], many.crossed()).collect()}
    newly = sets[2]
    hashes = {(r.id, r.source, r.h1, r.h2) for r in every.collect()}
    late = {i for i, *_, m in rows if m == 2}
    assert rebuilt == {i for i, *k in hashes if tuple(k) in (whole if i in late else newly)}
    many.vacuum()
    assert as_set(many.rows()) == as_set(one.rows())


# ---- answers

CASES = [
    ("What was revenue in 2015?", None, "empty"),
    ("What was revenue in 2015?", " \n", "empty"),
    ("What was revenue in 2015?", "**ANSWER:** N/A.", "empty"),
    ("What was revenue in 2015?", "```\n```", "empty"),
    ("What was revenue in 2015?", "Revenue was $5 million in 2015.\nANSWER: 5", None),
    ("What was revenue in 2015?", "ANSWER: Yes", None),
    ("What was revenue in 2015?", "$5,809 million.", None),
    ("What was revenue in 2015?", "Revenue came to $5.2 million and the", "truncated"),
    ("What was revenue in 2015?", "Revenue came to $5.2 million (see note 4.", "truncated"),
    ("What was revenue in 2015?", "Revenue was $5 million.\n| Year | Amount |\n| 2014 |", "truncated"),
    ("What was revenue in 2015?", "Revenue was $5 million.\n\n1. Start from $", "truncated"),
    ("What was revenue in 2015?", "Revenue was $5 million.\n**ANSWER: 5", "truncated"),
    ("What was revenue in 2015?", "Revenue was $5 million.\n**ANSWER: 5**", None),
    ("What was revenue in 2015?", "```\ntotal = 5\n", "truncated"),
    ("What was revenue in 2015?", "I'm sorry, but I can't determine revenue from these chunks.", "refusal"),
    ("What was revenue in 2015?", "The sources are silent on this.\nANSWER: INSUFFICIENT", "refusal"),
    ("What was revenue in 2015?", "Although the evidence does not state it directly, the quarters add up to $7.1 million.\nANSWER: 7.1", None),
    ("What was revenue in 2015?", "You asked: What was revenue in 2015?", "copied"),
    ("What was revenue in 2015?", "What was revenue in 2015? It was $7.1 million, after $6 million in the year before.\nANSWER: 7.1", None),
    ("What was revenue in 2015?", "Der Anstieg wird mit der höheren Nachfrage in der Region begründet.\nANSWER: 7", "other_language"),
    ("Wie hoch waren die Erlöse im Jahr 2015?", "Der Anstieg wird mit der höheren Nachfrage in der Region begründet.\nANSWER: 7", None),
    ("What was revenue in 2015?", "Выручка выросла за год на 5 %.", "other_language"),
    ("What was revenue in 2015?", "The note quotes it: „Die Lieferung verzögert sich bis zum Frühjahr.“ Revenue of the year was $5 million.", None),
    (None, "Revenue was $5 million.", None),
    ("What drove revenue in 2015?", "Revenue drivers:\n- higher volumes\n- better mix", None),
    ("What are the main risks?", "The main risks are:\n1. Currency\n2. Litigation", None),
    ("What are the main risks?", "The main risks are:\n1. Currency\n2. Litigation and", "truncated"),
    ("What are the main risks?", "The main risks are:\n- Prices may fall.\n- Costs may", "truncated"),
    ("What are the main risks?", "The main risks are:\n- Prices may fall.\n- ", "truncated"),
    ("What pipe was used?", 'It used a 5" pipe.', None),
    ("What pipe was used?", 'It used a "long pipe.', "truncated"),
    ("What pipe was used?", "It used <b>a long pipe.</b>", None),
    ("What pipe was used?", "<ul><li>a long pipe.<li>a valve.</ul>", None),
    ("What pipe was used?", "It used <b>a long pipe.", "truncated"),
    ("What pipe was used?", "It used `pipe.", "truncated"),
    ("What was revenue in 2015?", "I ricavi della società sono aumentati rispetto all'anno precedente, come si vede nella tabella.", "other_language"),
    ("Quali sono stati i ricavi della società nel 2015?", "I ricavi della società sono aumentati rispetto all'anno precedente, come si vede nella tabella.", None),
    ("What was revenue of Venelyx Steel in 2015?", "Venelyx Steel revenue: 5.1 million.", None),
]


@pytest.mark.parametrize("question,answer,kind", CASES)
def test_defects(question, answer, kind):
    assert ad.defect(question, answer) == kind


def plain_tiling(a, q, least=2):
    """Greedy string tiling as it is defined: again and again the longest common runs of unmarked words."""
    mine, theirs = [False] * len(a), [False] * len(q)
    while True:
        best = 0
        for i in range(len(a)):
            for j in range(len(q)):
                n = 0
                while i + n < len(a) and j + n < len(q) and a[i + n] == q[j + n] and not mine[i + n] and not theirs[j + n]:
                    n += 1
                if n > best:
                    best, at = n, (i, j)
        if best < least:
            return sum(mine), sum(theirs)
        for k in range(best):
            mine[at[0] + k] = theirs[at[1] + k] = True


def test_tiles_take_each_word_once():
    rng = random.Random(6)
    same = 0
    for _ in range(60):
        a, q = ([rng.choice("abcdefgh") for _ in range(rng.randrange(2, 20))] for _ in range(2))
        mine, theirs = [False] * len(a), [False] * len(q)
        ad._tile(a, q, mine, theirs, 2)
        assert sum(mine) == sum(theirs)
        same += (sum(mine), sum(theirs)) == plain_tiling(a, q)
    assert same >= 50  # which of equally long runs is taken first may differ
    assert ad.tiling("a b a b".split(), "a b c".split()) == (1.0, 2 / 3) and ad.tiling("a b x a b".split(), "a b c d e f g h".split())[0] == 0.4
    assert ad.defect("x " * 200_000, "x " * 200_000) == "copied"
    assert ad.defect("what was the revenue in 2015", "what was the revenue in 2015 what was the revenue in 2015") == "copied"


def test_defects_by_request(spark):
    rows = [(1, "q of it?", None), (1, "q of it?", None), (2, "What is it?", "It is 5.1 million, and"), (3, "What is it?", "It is 5.1 million."), (2, "What is it?", "What is it?")]
    got = ad.defects(spark.createDataFrame(rows, "request_id long, question string, answer string")).collect()
    assert {(r.request_id, r.defect) for r in got} == {(1, "empty"), (2, "copied")}


# ---- leaks


def test_leaks_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(f"q{i}", " ".join(text(rng.choice([5, 12, 30]))), " ".join(text(80)) if i % 3 else None) for i in range(12)]
    items += [items[0], ("twin", None, items[1][2])]
    docs = []
    for i in range(80):
        w = text(rng.randrange(0, 90))
        if i % 2:
            src = rng.choice([t for it in items for t in it[1:] if t]).split()
            n = rng.choice([10, 11, 12, 13, 25])
            at = rng.randrange(0, max(1, len(src) - n + 1))
            p = rng.randrange(0, len(w) + 1)
            w[p:p] = src[at : at + n]
        docs.append((i, ", ".join(w).upper()))
    docs += [(900, None), (901, "")]
    runs = {}
    for q, *ts in items:
        for t in ts:
            w = (t or "").split()
            for k in range(len(w) - 11):
                runs.setdefault(tuple(w[k : k + 12]), set()).add(q)
    want = set()
    for i, t in docs:
        w = re.findall("[a-z0-9]+", (t or "").lower())
        for k in range(len(w) - 11):
            want |= {(i, q) for q in runs.get(tuple(w[k : k + 12]), ())}
    got = eval_leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "id string, question string, context string"))
    assert want and {tuple(r) for r in got.collect()} == want


def _topics(rng):
    """Topics of word pairs that mean the same: documents use either word of a pair."""
    topics = [[(f"t{k}a{i}", f"t{k}b{i}") for i in range(14)] for k in range(20)]
    sentence = lambda k, n: [rng.choice(topics[k])[rng.randrange(2)] for _ in range(n)]
    swap = {x: y for t in topics for a, b in t for x, y in ((a, b), (b, a))}
    return sentence, swap


def _paraphrased(spark, rng):
    """(documents, items, planted): items' sentences with two words in five exchanged for their like."""
    sentence, swap = _topics(rng)
    docs = [[" ".join(sentence(k, 16)) + "." for _ in range(6)] for k in range(20) for _ in range(12)]
    items, planted = [], set()
    for n in range(60):
        words = sentence(n % 20, 18)
        items.append((f"q{n}", " ".join(words) + "?", None))
        said = [swap[w] if i % 5 in (1, 3) else w for i, w in enumerate(words)]
        docs[n * 4].insert(3, " ".join(said).capitalize() + ".")
        planted.add((n * 4, f"q{n}"))
    rows = [(i, " ".join(x)) for i, x in enumerate(docs)] + [(900, None), (901, ""), (902, "...")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*items, (None, "x", "y"), ("q", None, "")], "id string, question string, context string"), planted


def test_paraphrases_are_found_by_the_latent_space_alone(spark, monkeypatch):
    docs, items, planted = _paraphrased(spark, random.Random(8))
    got = {(r.doc_id, r.question_id) for r in eval_leaks.paraphrases(docs, items).collect()}
    assert len(planted & got) >= 0.9 * len(planted) and len(got - planted) <= 0.1 * len(got)
    monkeypatch.setattr(eval_leaks, "latent_directions", lambda words, idf: idf[:, None].astype("f4") * eval_leaks._random(3, eval_leaks.RANK))
    blind = {(r.doc_id, r.question_id) for r in eval_leaks.paraphrases(docs, items).collect()}
    assert len(planted & blind) < 0.7 * len(planted)


def test_common_subsequence_equals_the_plain_table():
    rng = random.Random(9)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(0, 12))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0] + [max(row[j] + 1 if x == y else 0, row[j + 1]) for j, y in enumerate(b)]
            for j in range(len(b)):
                row[j + 1] = max(row[j + 1], row[j])
        assert eval_leaks.common_subsequence(a, b) == row[-1]


# ---- encodings


def test_chains_are_undone():
    for text in ["Größere Schäden – „für“ €5", "número de España", "Компания признала"]:
        for read in ["latin-1", "cp1252", "mac_roman", "cp437", "cp850"]:
            try:
                garbled = text.encode().decode(read)
            except UnicodeDecodeError:
                continue
            assert mojibake.inverse(garbled, ("utf-8", read, 1)) == text
    twice = "für".encode().decode("cp1252").encode().decode("cp1252")
    assert mojibake.inverse(twice, ("utf-8", "cp1252", 2)) == "für"
    assert mojibake.inverse("Компания".encode("koi8_r").decode("cp1251"), ("koi8_r", "cp1251", 1)) == "Компания"
    assert mojibake.inverse("für", ("utf-8", "cp1252", 1)) is None


def test_found_and_restored(spark):
    rng = random.Random(5)
    sentences = ["Die Löhne wurden für größere Verträge erhöht.", "La sociedad redujo su número de empleados en España.", "Le comité a été informé à l’avance — déjà.", "ÂGE LIMITE and Ångström units of São João apply: Ã-27.", "Компания признала убыток и обязательства."]
    docs = [(i, " ".join(rng.choice(sentences) for _ in range(4)), f"s{i % 3}") for i in range(300)]
    want = {}
    for i in range(0, 60, 2):
        text = docs[i][1]
        read = ["latin-1", "cp1252", "mac_roman"][i % 3]
        garbled = "".join(b if ord(b) < 128 else b for b in text.encode().decode(read, "replace"))
        if "�" not in garbled and garbled != text:
            want[i] = text
            docs[i] = (i, garbled, docs[i][2])
    docs += [(1000, None, None), (1001, "", "s1"), (1002, "ascii only", None), (1003, "lost caf�", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    judged, model = mojibake.judge(df)
    out = {r.doc_id: r for r in mojibake.restored(df, judged, model).collect()}
    assert set(out) == set(want) | {1003}
    assert not out[1003].whole and all(out[i].whole for i in want)
    assert sum(out[i].restored == want[i] for i in want) >= 0.95 * len(want)


def test_single_byte_garbling_of_words_with_one_accent(spark):
    rng = random.Random(6)
    words = "für über größer Löhne Verträge erhöht Prüfung Erträge Zölle Käufe Märkte Rückgang wir und die Bank".split()
    docs = [(i, " ".join(rng.choice(words) for _ in range(40)), f"s{i % 3}") for i in range(300)]
    want = {i: docs[i][1] for i in range(0, 30, 3)}
    for i, text in want.items():
        docs[i] = (i, text.encode("cp1252").decode("mac_roman"), docs[i][2])
    judged, model = mojibake.judge(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    out = {r.doc_id: r for r in mojibake.restored(spark.createDataFrame(docs, "doc_id long, text string, source string"), judged, model).collect()}
    assert set(out) == set(want)
    assert all(out[i].restored == text for i, text in want.items())


def test_wide_encodings(spark):
    rng = random.Random(7)
    for text, written in (("売上高は前年比で増加", "shift_jis"), ("營業收入同比增長", "big5"), ("营业收入同比增长", "gbk"), ("매출액이증가했다", "euc_kr")):
        garbled = "".join({ord(b): chr(c) for c, b in mojibake._bytes_of("cp1252").items()}[x] for x in text.encode(written))
        assert mojibake.inverse(garbled, (written, "cp1252", 1)) == text
    assert mojibake.inverse("Größe", ("gbk", "cp1252", 1)) is None
    words = "売上高は 前年比で 増加した 費用が 減少しました 会社の 利益を 計上する".split()
    docs = [(i, " ".join(rng.choice(words) for _ in range(30)), "s") for i in range(200)] + [(500 + i, "für größere Löhne über Verträge", "s") for i in range(200)]
    bytes_of = {ord(b): chr(c) for c, b in mojibake._bytes_of("cp1252").items()}
    docs += [(900 + i, "".join(bytes_of[x] for x in docs[i][1].encode("shift_jis")), "s") for i in range(10)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    out = {r.doc_id: r.restored for r in mojibake.restored(df, *mojibake.judge(df)).collect()}
    assert set(out) == set(range(900, 910)) and all(out[900 + i] == docs[i][1] for i in range(10))


def test_sequence_across_the_parts_of_a_long_token(spark):
    docs = [(i, "für größere Löhne über Verträge", "s") for i in range(200)]
    docs += [(900, "a" * (mojibake.LONGEST - 2) + "fÃ¼r", "s"), (901, "fÃ¼r grÃ¶ÃŸere LÃ¶hne", "s")]
    judged, _ = mojibake.judge(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    assert {r.id for r in judged.collect()} == {900, 901}
