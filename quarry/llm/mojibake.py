"""Texts decoded with the wrong character encoding: found, and restored where nothing was lost.

Method: expectation-maximization with latent encoding chains. A token with characters beyond ASCII was either
written as it stands or came about by a chain: encoded in one encoding and decoded in another, once or
repeatedly. A chain's inverse gives the token that was meant. How plausible a token is comes from a character
pair model of the corpus itself; how usual a chain is in a source comes from that source's records. Both are
unknown while the chains are, so they are estimated in turn: the E step weighs each token's readings, the M
step recounts pairs and chains by these weights. Weak evidence is thus pooled over all records of a source and
field. A record's posterior sums its tokens' evidence, each of which may also stand outside the garbled
stretch; each record is repaired by its most probable chain.

U+FFFD tells that characters were lost in decoding: such records are found, and are not restorable.
Null, empty and plain ASCII texts are no case; correct characters, however unusual, are none since no inverse
makes them more plausible. A null source pools with other null sources. Repeated rows give one result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.base import cores, cut, mix64, sent_if_small, spread

#: Encodings in which UTF-8 bytes are read by mistake (fixed values: codec names).
READ_FOR_UTF8 = ["latin-1", "cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp1254", "iso8859_15", "iso8859_2", "koi8_r", "cp866"]
#: The one of them in which the bytes of sequences are common letters, so that correct words hold such by chance.
LETTERS = "cp866"
#: Single-byte encodings taken for one another: written, read.
TAKEN_FOR = [
    ("cp1251", "latin-1"), ("cp1251", "cp1252"), ("cp1251", "koi8_r"), ("cp1251", "cp866"), ("cp1251", "mac_roman"),
    ("koi8_r", "cp1251"), ("koi8_r", "latin-1"), ("koi8_r", "cp1252"), ("koi8_r", "cp866"),
    ("cp866", "cp1251"), ("cp866", "latin-1"), ("cp866", "cp1252"), ("cp866", "koi8_r"),
    ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "cp1250"), ("cp1252", "cp1251"),
    ("mac_roman", "latin-1"), ("mac_roman", "cp1252"), ("cp437", "latin-1"), ("cp437", "cp1252"), ("cp850", "latin-1"), ("cp850", "cp1252"),
]
#: Encodings of two bytes a character (written, read), and the characters that they must give to count as a reading.
WIDE = [("shift_jis", "cp1252"), ("euc_jp", "cp1252"), ("gbk", "cp1252"), ("big5", "cp1252"), ("euc_kr", "cp1252")]
_WIDE_CHARS = re.compile("[\u3000-\u30ff\u3400-\u9fff\uac00-\ud7af\uff01-\uffee]+")
#: Characters beyond ASCII from which a token is read by the wide encodings.
LEAST_WIDE = 4
DEPTH = 3
CHAINS: list[tuple[str, str, int]] = [("utf-8", read, depth) for depth in range(1, DEPTH + 1) for read in READ_FOR_UTF8] + [(w, r, 1) for w, r in TAKEN_FOR] + [(w, r, 1) for w, r in WIDE]
CLEAN, LOST = -1, len(CHAINS)
LOST_CHAR = "�"
#: Bounded tables of the character model: hashed pairs and characters.
PAIRS, CHARS = 1 << 17, 1 << 13
ROUNDS = 3
#: Nats by which a lost character counts as a loss, and by which a reading may at first be less likely than the token.
LOSS, FAR = 12.0, 12.0
#: Weight of a token that holds a valid UTF-8 sequence, in the first model.
START = 0.02
#: Share of the tokens in a garbled record that the garbling reaches, before anything is known.
REACHED = 0.5
#: A source's records count beside this many imaginary ones, of which this share is garbled by each chain.
WEIGHT, PRIOR = 20.0, 1e-3
#: Nats by which a record's own chain is trusted beyond the character model, in its repair.
TRUST = 8.0
#: Sources whose shares of chains are broadcast, at most (about 20 MB); more meet the tokens by a shuffle.
SENT_SOURCES = 20_000
#: Tokens of a task of the estimation, at least where the cores allow.
TASK = 10_000
#: Records found that are broadcast to the corpus, at most (about 30 MB); more meet it by a shuffle.
SENT_RECORDS = 1_000_000
#: Tokens longer than this are read in parts, which overlap by so many characters that a sequence lies whole in one.
LONGEST, OVERLAP = 400, 32

_UTF8 = re.compile("[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}")
TOKEN_JAVA = r"[^ \t\r\n\f]*[^\x00-\x7f \t\r\n\f][^ \t\r\n\f]*"
TOKEN_RE = re.compile(r"[^ \t\r\n\f]*[^\x00-\x7f \t\r\n\f][^ \t\r\n\f]*")


@cache
def _bytes_of(read: str) -> dict[int, str]:
    """Each character that the encoding decodes a byte to, with that byte as a Latin-1 character. Bytes that
    it leaves undefined stay what they are, as lenient decoders have it."""
    table = {}
    for b in range(256):
        try:
            table.setdefault(ord(bytes([b]).decode(read)), chr(b))
        except UnicodeDecodeError:
            table.setdefault(b, chr(b))
    return table


def _undo_utf8(token: str, read: str) -> str:
    """Valid sequences put back, everything else left as it stands."""
    table = _bytes_of(read)
    raw = "".join(table.get(ord(c), LOST_CHAR) for c in token)
    out, at = [], 0
    for m in _UTF8.finditer(raw):
        out += token[at : m.start()], m.group().encode("latin-1").decode("utf-8")
        at = m.end()
    return "".join(out) + token[at:] if at else token


@cache
def _single(written: str, read: str) -> dict[int, str]:
    table = {}
    for c, b in _bytes_of(read).items():
        if b > "\x7f":
            try:
                table[c] = b.encode("latin-1").decode(written)
            except UnicodeDecodeError:
                pass
    return table


def _undo_wide(token: str, written: str, read: str) -> str | None:
    """The token read anew by an encoding of two bytes a character, if that gives such characters and ASCII only."""
    high = [c for c in token if c > "\x7f"]
    table = _bytes_of(read)
    if len(high) < LEAST_WIDE or any(ord(c) not in table for c in high):
        return None
    try:
        out = "".join(table.get(ord(c), c) for c in token).encode("latin-1").decode(written)
    except UnicodeDecodeError:
        return None
    return out if all(c < "\x7f" or _WIDE_CHARS.match(c) for c in out) else None


def inverse(token: str, chain: tuple[str, str, int]) -> str | None:
    """The token that the chain would have garbled into this one; None if the chain changes nothing."""
    written, read, depth = chain
    if (written, read) in WIDE:
        return _undo_wide(token, written, read)
    if written != "utf-8":
        out = token.translate(_single(written, read))
        return out if out != token else None
    for _ in range(depth):
        before, token = token, _undo_utf8(token, read)
        if token == before:
            return None
    return token


def readings(token: str) -> list[tuple[int, str]]:
    """(chain, meant) of the chains that change the token, each result under its first chain. One character
    beyond ASCII tells little by itself; the sum over a record decides."""
    if LOST_CHAR in token:
        return [(LOST, token)]
    out, seen = [], {token}
    for k, chain in enumerate(CHAINS):
        if (x := inverse(token, chain)) is not None and x not in seen:
            seen.add(x)
            out.append((k, x))
    return out


class Flat:
    """Characters of many texts at once, framed by marks: pair and character cells, and where each text begins."""

    def __init__(self, texts: list[str]):
        joined = "".join(f"\x02{t}\x03" for t in texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.size = np.fromiter((len(t) + 2 for t in texts), np.int64, count=len(texts))
        self.start = np.cumsum(self.size) - self.size
        self.chars = (mix64(codes) % np.uint64(CHARS)).astype(np.int64)
        after = np.append(codes[1:], codes[:1]) if len(codes) else codes
        self.pairs = (mix64(codes * np.uint64(1 << 21) + after) % np.uint64(PAIRS)).astype(np.int64)
        self.inside = np.ones(len(codes), bool)  # the pair of a text's last mark with the next text's first one is none
        self.inside[self.start + self.size - 1] = False

    def counts(self, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = np.repeat(weight, self.size)
        return np.bincount(self.pairs, w * self.inside, PAIRS), np.bincount(self.chars, w, CHARS)


class Model:
    """Log probability of a text's characters by the pair counts, backed by the counts of characters."""

    def __init__(self, pairs: np.ndarray, chars: np.ndarray):
        self.pairs, self.chars, self.total = pairs, chars, chars.sum()

    def many(self, flat: Flat) -> np.ndarray:
        if not len(flat.start):
            return np.zeros(0)
        c = self.chars[flat.chars]
        single = (np.append(c[1:], 0) + 0.05) / (self.total + 400)
        logs = np.log((self.pairs[flat.pairs] + 2 * single) / (c + 2)) * flat.inside
        return np.add.reduceat(logs, flat.start)

    def __call__(self, token: str) -> float:
        return float(self.many(Flat([token]))[0])


def _counts(parts: DataFrame, fixed: Model | None = None) -> Model:
    """Sums (kind, at, weight) into a model, on top of a fixed one; both tables are of a fixed size."""
    rows = parts.groupBy("kind", "at").agg(F.sum("weight").alias("weight")).toArrow()
    pairs, chars = np.zeros(PAIRS), np.zeros(CHARS)
    kind, at, weight = (rows[c].to_numpy() for c in ("kind", "at", "weight"))
    pairs[at[kind == 0]], chars[at[kind == 1]] = weight[kind == 0], weight[kind == 1]
    return Model(pairs, chars) if fixed is None else Model(pairs + fixed.pairs, chars + fixed.chars)


class Readings:
    """The tokens of a batch with their readings, laid out flat: each token as it stands, then its readings."""

    def __init__(self, tokens: list[str], chains: list, meant: list):
        self.chain = np.array([k for ks in chains for k in (CLEAN, *(ks or ()))], np.int64)
        texts = [x for t, ms in zip(tokens, meant) for x in (t, *(ms or ()))]
        self.many = np.array([len(ks or ()) + 1 for ks in chains], np.int64)
        self.first = np.cumsum(self.many) - self.many
        self.owner = np.repeat(np.arange(len(tokens)), self.many)
        self.lost = np.fromiter((LOST_CHAR in x for x in texts), bool, count=len(texts))
        self.flat = Flat(texts)

    def reads_utf8(self) -> np.ndarray:
        """Whether any reading of a token undoes UTF-8, other than those under which common letters make valid sequences."""
        telling = np.array([w == "utf-8" and r != LETTERS for w, r, _ in CHAINS] + [False, False])  # and LOST, CLEAN
        return np.maximum.reduceat(telling[self.chain], self.first) if len(self.first) else np.zeros(0, bool)

    def logs(self, model: Model) -> np.ndarray:
        """Log probabilities; a lost character is taken for much less likely as it stands than as a loss."""
        logs = model.many(self.flat)
        stands = logs[self.first][self.owner] if len(logs) else logs
        return np.where(self.chain == LOST, stands + LOSS, logs)

    def prior(self, shares: np.ndarray) -> np.ndarray:
        """How usual each reading's chain is in its token's source; CLEAN is the last column."""
        return shares[self.owner, self.chain]

    def weights(self, model: Model, shares: np.ndarray) -> np.ndarray:
        """Posterior of each reading, by the model and the chains' shares in the token's source."""
        logs = self.logs(model) + np.log(self.prior(shares))
        w = np.exp(logs - np.maximum.reduceat(logs, self.first)[self.owner])
        return w / np.add.reduceat(w, self.first)[self.owner]


def _matrix(shares: pa.Array) -> np.ndarray:
    return shares.flatten().to_numpy(zero_copy_only=False).reshape(-1, LOST + 2)


_PARTS = "kind int, at int, source string, chain int, weight double"


def _step(tokens: DataFrame, model: Model | None) -> DataFrame:
    """E step over (source, token, n, chains, meant, shares): expected counts of pairs (kind 0), characters (1) and chains
    of a source (2). Without a model every token counts as it stands, those that hold a valid UTF-8 sequence by START only:
    by chance such a sequence is rare, and counted in full it would make itself look usual."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, n, chains, meant = (batch.column(k).to_pylist() for k in (1, 2, 3, 4))
            r = Readings(tokens, chains, meant)
            w = r.weights(model, _matrix(batch.column(5))) if model is not None else (r.chain == CLEAN) * np.where(r.reads_utf8()[r.owner], START, 1.0)
            w = w * np.array(n, float)[r.owner]
            pairs, chars = r.flat.counts(np.where(r.lost | (w < 1e-6), 0, w))
            listed = batch.column(0).dictionary_encode()  # a null source is one of them
            names = [*listed.dictionary.to_pylist(), None]
            code = listed.indices.fill_null(len(names) - 1).to_numpy()
            told = np.flatnonzero(r.many[r.owner] > 1)
            keys, at = np.unique(code[r.owner[told]] * (LOST + 2) + r.chain[told] + 1, return_inverse=True)
            sums = np.bincount(at, w[told], len(keys))
            uses = {(names[k // (LOST + 2)], int(k % (LOST + 2)) - 1): x for k, x in zip(keys.tolist(), sums.tolist())}
            p, c = np.flatnonzero(pairs), np.flatnonzero(chars)
            kind = [0] * len(p) + [1] * len(c) + [2] * len(uses)
            none = [None] * (len(p) + len(c))
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind, pa.int32()), pa.array(np.concatenate([p, c, np.zeros(len(uses), np.int64)]), pa.int64()).cast(pa.int32()), pa.array(none + [s for s, _ in uses], pa.string()), pa.array(none + [k for _, k in uses], pa.int32()), pa.array(np.concatenate([pairs[p], chars[c], list(uses.values())]), pa.float64())],
                names=["kind", "at", "source", "chain", "weight"],
            )

    return tokens.select("source", "token", "n", "chains", "meant", "shares").mapInArrow(run, _PARTS)


def _plausible(tokens: DataFrame, model: Model) -> DataFrame:
    """tokens without readings that the first model holds for less likely than the token by FAR nats: later models differ
    from it by the garbled tokens' share only, which weighs less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            _, tokens, _, chains, meant = (c.to_pylist() for c in batch.columns)
            r = Readings(tokens, chains, meant)
            logs = r.logs(model)
            near = logs >= logs[r.first][r.owner] - FAR
            keep = [[j for j in range(len(ks or ())) if near[a + 1 + j]] for ks, a in zip(chains, r.first)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([[ks[j] for j in k] for ks, k in zip(chains, keep)], pa.list_(pa.int32())), pa.array([[ms[j] for j in k] for ms, k in zip(meant, keep)], pa.list_(pa.string()))], names=["source", "token", "n", "chains", "meant"])

    return tokens.select("source", "token", "n", "chains", "meant").mapInArrow(run, "source string, token string, n long, chains array<int>, meant array<string>")


def _with_shares(tokens: DataFrame, shares: DataFrame | None) -> DataFrame:
    usual = F.array(*[F.lit(PRIOR)] * (LOST + 1), F.lit(1.0))
    if shares is None:
        return tokens.withColumn("shares", usual)
    sent = sent_if_small(shares.withColumnsRenamed({"source": "s", "shares": "own"}), SENT_SOURCES)
    return tokens.join(sent, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("shares", F.coalesce("own", usual)).drop("s", "own")


def _shares(parts: DataFrame) -> DataFrame:
    """(source, shares): how usual each chain is in a source, by its number, and last how usual it is that none was at work."""
    used = parts.where("kind = 2").groupBy("source", "chain").agg(F.sum("weight").alias("w"))
    listed = used.groupBy("source").agg(F.sum("w").alias("all"), F.collect_list(F.struct("chain", "w")).alias("ws"))
    own = F.map_from_entries(F.transform(F.filter("ws", lambda x: x.chain >= 0), lambda x: F.struct(x.chain, (x.w + WEIGHT * PRIOR) / (F.col("all") + WEIGHT))))
    listed = listed.select("source", own.alias("own"))
    each = F.transform(F.sequence(F.lit(0), F.lit(LOST)), lambda k: F.coalesce(F.try_element_at("own", k), F.lit(PRIOR)))
    clean = F.greatest(F.lit(1e-9), 1 - F.aggregate(F.map_values("own"), F.lit(0.0), lambda s, x: s + x))
    return listed.select("source", F.concat(each, F.array(clean)).alias("shares"))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, Model]:
    """(id, chain, posterior) of the records found garbled, and the character model."""
    d = spread(docs.select(F.col(key).alias("id"), F.col(source).alias("source"), F.col(text).alias("text"))).where(F.col("text").rlike(r"[^\x00-\x7f]"))
    found = F.explode(F.array_distinct(F.expr(f"regexp_extract_all(text, r'{TOKEN_JAVA}', 0)"))).alias("token")
    part = F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.length("token") - 1) / LONGEST).cast("int")), lambda i: F.substring("token", i * LONGEST + 1, F.lit(LONGEST + OVERLAP)))).alias("token")
    each = cut(d.select("id", "source", found).select("id", "source", part).distinct())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_readings = [readings(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[k for k, _ in r] for r in all_readings], pa.list_(pa.int32())), pa.array([[m for _, m in r] for r in all_readings], pa.list_(pa.string()))], names=["token", "chains", "meant"])

    # tokens are few bytes but much work: they are spread over the cores, not by their size
    tasks = 4 * cores(docs.sparkSession)
    known = each.select("token").distinct().repartition(tasks).mapInArrow(read, "token string, chains array<int>, meant array<string>")
    counted = each.groupBy("source", "token").agg(F.count(F.lit(1)).alias("n"))
    tokens = cut(counted.join(known, "token").select("source", "token", "n", "chains", "meant").repartition(tasks))
    # each task carries the model and gives its sums back: no more tasks than there is work for
    tasks = max(cores(docs.sparkSession), min(tasks, tokens.count() // TASK))
    tokens = tokens.coalesce(tasks)
    model, shares = _counts(_step(_with_shares(tokens, None), None).where("kind < 2")), None
    tokens = cut(_plausible(tokens, model))
    # a token without a reading counts as it stands in every round: these are counted once
    fixed = _counts(_step(_with_shares(tokens.where(F.size("chains") == 0), None), None).where("kind < 2"))
    tokens = cut(tokens.where(F.size("chains") > 0).repartition(tasks))
    for _ in range(ROUNDS):
        parts = cut(_step(_with_shares(tokens, shares), model))
        model, shares = _counts(parts.where("kind < 2"), fixed), _shares(parts)

    suspect = _with_shares(tokens, shares)
    last = model

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Log evidence of each reading against the token as it stands, in nats, and the chain's prior log odds."""
        for batch in batches:
            if not batch.num_rows:
                continue
            sources, tokens, chains, meant = (batch.column(k).to_pylist() for k in range(4))
            r = Readings(tokens, chains, meant)
            logs = r.logs(last)
            gain = np.minimum(logs - logs[r.first][r.owner], 60.0)
            at = np.flatnonzero((r.chain != CLEAN) & (gain > -5))
            prior = np.clip(r.prior(_matrix(batch.column(4)))[at], 1e-6, 0.99)
            yield pa.RecordBatch.from_arrays(
                [pa.array([sources[r.owner[i]] for i in at], pa.string()), pa.array([tokens[r.owner[i]] for i in at], pa.string()), pa.array(r.chain[at]).cast(pa.int32()), pa.array(np.log(1 - REACHED + REACHED * np.exp(gain[at]))), pa.array(np.log(prior / (1 - prior)), pa.float64())],
                names=["source", "token", "chain", "gain", "odds"],
            )

    gains = suspect.select("source", "token", "chains", "meant", "shares").mapInArrow(weigh, "source string, token string, chain int, gain double, odds double")
    gains = gains.withColumnsRenamed({"source": "s", "token": "t"})
    joined = each.join(gains, (F.col("token") == F.col("t")) & F.col("source").eqNullSafe(F.col("s")))
    per_chain = joined.groupBy("id", "chain").agg(F.sum("gain").alias("gain"), F.max("odds").alias("odds"))
    best = per_chain.withColumn("sum", F.col("gain") + F.col("odds")).groupBy("id").agg(F.max_by(F.struct("chain", "sum"), F.struct("sum", -F.col("chain"))).alias("b"))
    return best.where("b.sum > 0").select("id", "b.chain", (1 / (1 + F.exp(-F.col("b.sum")))).alias("posterior")), model


def repairs(tokens: list[tuple[str, int]], model: Model) -> dict[tuple[str, int], str]:
    """What each (token, chain of its record) is read as: by the record's chain, or by another one that is more plausible still,
    unless the token is most plausible as it stands. All of them are weighed at once."""
    texts, trust, of = [], [], []
    for i, (token, chain) in enumerate(tokens):
        options = [(0.0, token)] + [(0.0, x) for k, x in readings(token) if k != LOST]
        if chain != LOST and (own := inverse(token, CHAINS[chain])) is not None:
            options.append((TRUST, own))
        texts += [x for _, x in options]
        trust += [t for t, _ in options]
        of += [i] * len(options)
    score = model.many(Flat(texts)) + np.array(trust)
    best: dict[int, int] = {}
    for k, i in enumerate(of):
        if i not in best or score[k] > score[best[i]]:
            best[i] = k
    return {tokens[i]: texts[k] for i, k in best.items()}


def restored(docs: DataFrame, judged: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chain, restored, whole) of the records found; whole tells that nothing was lost."""
    names = [f"{w} read as {r}" + f" {n} times" * (n > 1) for w, r, n in CHAINS] + ["lost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, chains = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            meant = repairs(sorted({(m, k) for t, k in zip(texts, chains) for m in TOKEN_RE.findall(t)}), model)
            done = [TOKEN_RE.sub(lambda m, k=k: meant[m.group(), k], t) for t, k in zip(texts, chains)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([names[k] for k in chains], pa.string()), pa.array(done, pa.string()), pa.array([LOST_CHAR not in x for x in done], pa.bool_())], names=[key, "chain", "restored", "whole"])

    # the records found go to the corpus where they are few, which then is not shuffled
    found = sent_if_small(judged.select("id", "chain"), SENT_RECORDS)
    wanted = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(found, "id").groupBy("id").agg(F.min(F.struct("text", "chain")).alias("r")).select("id", "r.text", "r.chain")
    return wanted.repartition(4 * cores(docs.sparkSession)).mapInArrow(run, f"`{key}` long, chain string, restored string, whole boolean")
