"""Operator 9: language-model scores by the subword lattice likelihood.

A word is the boundary mark and its characters; every way to cut it into pieces of a public vocabulary counts. Pieces are
drawn independently, and the probability of a word is the sum over all cuts, found by a forward recursion in log
space. A document is its words and an end. Characters that no piece holds alone are spelled in byte pieces.

The pieces' probabilities begin with the vocabulary's own scores (the merge order, read as a rank in Zipf's law) and are
fitted to the corpus by expectation maximisation: word counts of the training rows are summed over the cluster, expected
piece counts are computed on the executors for every distinct word, and only the sums by piece, as many as the
vocabulary has, reach the driver.

The base score needs the training count of every word. The counts of the most frequent words, at most ``head`` of
them, are broadcast; all other words of a document are joined with the table of counts by shuffle. Those words are never hot.

Texts are lower-cased A-Z; words end at space and \\t..\\r.

Edge cases: null and empty texts have the end alone; bytes that aren't UTF-8 count as U+FFFD in the lattice and as themselves
in the counts; without training rows the counts are 0 and the probabilities those of the vocabulary; null ids count as
an empty text in the crc; repeated rows and ids are scored each; clashing columns don't matter, as the result has only
its own; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

HEAD = 200_000
ROUNDS = 3
#: Added to each piece's expected count.
SMOOTH = 0.5
#: Words a worker remembers; then it forgets all.
REMEMBERED = 600_000
#: Characters of a word that are treated in columns with others; longer ones go one by one.
LONG = 200
MARK, PAD = 0x2581, 0x110001
_P, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class Lattice:
    """A vocabulary as tables for lattices of many words at once. Piece n is the end, n+1.. are none."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = np.zeros(256, np.int64)
        texts, scores = [], []
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                self.bytes[int(model.id_to_piece(i)[1:-1], 16)] = len(texts)
                texts.append(None)
                scores.append(None)
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                texts.append(model.id_to_piece(i))
                scores.append(model.get_score(i))
        self.end = len(texts)
        self.size = len(texts) + 1
        rank = np.array([0.0 if s is None else -s for s in scores])
        prior = np.append(1.0 / (100.0 + rank), 0.01)
        prior[[i for i, t in enumerate(texts) if t is None]] = 1e-6
        self.prior = np.log(prior / prior.sum())
        self.longest = max(len(t) for t in texts if t)
        keys = [(self._hash(t), i) for i, t in enumerate(texts) if t]
        self.by_text = {t: i for i, t in enumerate(texts) if t}
        self.bits = 20
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = np.zeros(self.size, np.uint64)
        self.probes = 1
        for h, i in keys:
            self.keys[i] = h
            at, n = self._slot(np.uint64(h)), 1
            while self.slots[at] >= 0:
                at, n = (at + 1) & ((1 << self.bits) - 1), n + 1
            self.slots[at] = i
            self.probes = max(self.probes, n)

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(_P) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _slot(self, h):
        with np.errstate(over="ignore"):
            return ((h * _M) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The pieces of hashes, -1 for none."""
        at = self._slot(h)
        out = self.slots[at]
        # most slots are empty or right; the others are looked at one by one
        wrong = np.nonzero((out >= 0) & (self.keys[out] != h))
        if len(wrong[0]):
            left, place = h[wrong], at[wrong]
            found = np.full(len(left), -1, np.int32)
            for _ in range(1, self.probes):
                place = (place + 1) & ((1 << self.bits) - 1)
                got = self.slots[place]
                hit = (got >= 0) & (self.keys[got] == left)
                found[hit] = got[hit]
            out[wrong] = found
        return out

    def spelled(self, code: int) -> np.ndarray:
        """The byte pieces of a character (of U+FFFD for a lone surrogate)."""
        return self.bytes[list(chr(code if not 0xD800 <= code < 0xE000 else 0xFFFD).encode())]


@functools.lru_cache(maxsize=2)
def lattice(vocabulary: str) -> Lattice:
    import public_tokenizers

    return Lattice(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))


def _columns(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words of like lengths as (their indexes, lengths with the mark, matrix of codes)."""
    n = np.array([len(w) + 1 for w in words])
    edges = [0, 6, 9, 12, 16, 24, 48, LONG]
    for low, high in zip(edges, edges[1:], strict=False):
        all_at = np.flatnonzero((n > low) & (n <= high))
        for k in range(0, len(all_at), 20_000):
            at = all_at[k : k + 20_000]
            width = int(n[at].max())
            text = "".join(("▁" + words[i]).ljust(width, "\x00") for i in at)
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64).reshape(len(at), width)
            codes[np.arange(width)[None, :] >= n[at][:, None]] = PAD
            yield at, n[at], codes


def _edges(lat: Lattice, codes: np.ndarray, logp: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], dict[int, np.ndarray]]:
    """For each length: the pieces that begin at each position and their log probabilities, -1 and -inf
    where none does; characters that no piece holds alone have no piece, but the probability of their bytes."""
    h = np.zeros_like(codes)
    pieces, values, spelled = [], [], {}
    width = codes.shape[1]
    for n in range(1, min(lat.longest, width) + 1):
        h = h[:, : width - n + 1] * _P + codes[:, n - 1 :] + np.uint64(1)
        got = lat.find(h)
        if n == 1:
            missing = (got < 0) & (codes != PAD)
            value = np.where(got >= 0, logp[got], -np.inf)
            if missing.any():
                for c in np.unique(codes[missing]).tolist():
                    spelled[c] = lat.spelled(c)
                    value[missing & (codes == c)] = logp[spelled[c]].sum()
        else:
            value = np.where(got >= 0, logp[got], -np.inf)
        pieces.append(got)
        values.append(value)
    return pieces, values, spelled


def _sum_of_logs(terms: list[np.ndarray]) -> np.ndarray:
    """ln of the sum of exponentials, by rows; -inf where all are."""
    if len(terms) == 1:
        return terms[0]
    top = functools.reduce(np.maximum, terms)
    safe = np.where(top > -np.inf, top, 0.0)
    total = np.zeros(len(top))
    for t in terms:
        total += np.exp(t - safe)
    with np.errstate(divide="ignore"):
        return safe + np.log(total)


def forward(values: list[np.ndarray], width: int) -> np.ndarray:
    """Log of the probability of each prefix, summed over its cuts: by position, then by word."""
    alpha = np.zeros((width + 1, values[0].shape[0]))
    for j in range(1, width + 1):
        alpha[j] = _sum_of_logs([alpha[j - n] + values[n - 1][:, j - n] for n in range(1, min(j, len(values)) + 1)])
    return alpha


def _one(lat: Lattice, word: str, logp: np.ndarray, expected: np.ndarray | None = None, weight: float = 0.0) -> float:
    """The same for one long word, with its expected counts added."""
    text = "▁" + word
    n = len(text)
    ends: list[list[tuple[int, object, float]]] = []
    alpha = [0.0] + [-np.inf] * n
    for i in range(n):
        out = []
        for k in range(1, min(lat.longest, n - i) + 1):
            p = lat.by_text.get(text[i : i + k])
            if p is not None:
                out.append((i + k, p, float(logp[p])))
            elif k == 1:
                own = lat.spelled(ord(text[i]))
                out.append((i + 1, own, float(logp[own].sum())))
        for j, _, v in out:
            a, b = alpha[j], alpha[i] + v
            alpha[j] = b if a == -np.inf else max(a, b) + np.log1p(np.exp(-abs(a - b)))
        ends.append(out)
    if expected is not None:
        beta = [-np.inf] * n + [0.0]
        for i in range(n - 1, -1, -1):
            for j, p, v in ends[i]:
                a, b = beta[i], beta[j] + v
                beta[i] = b if a == -np.inf else max(a, b) + np.log1p(np.exp(-abs(a - b)))
                np.add.at(expected, p, weight * np.exp(alpha[i] + v + beta[j] - alpha[n]))
    return alpha[n]


def log_likelihoods(lat: Lattice, words: list[str], logp: np.ndarray) -> np.ndarray:
    """The natural log of each word's probability over all its cuts."""
    out = np.empty(len(words))
    for at, n, codes in _columns(words):
        _, values, _ = _edges(lat, codes, logp)
        out[at] = forward(values, codes.shape[1])[n, np.arange(len(at))]
    for i, w in enumerate(words):
        if len(w) + 1 > LONG:
            out[i] = _one(lat, w, logp)
    return out


def expectations(lat: Lattice, words: list[str], counts: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """The pieces' expected counts in words that occur so often."""
    out = np.zeros(lat.size)
    for at, n, codes in _columns(words):
        pieces, values, spelled = _edges(lat, codes, logp)
        rows, width = codes.shape
        alpha = forward(values, width)
        beta = np.full((width + 1, rows), -np.inf)
        for i in range(width, -1, -1):
            steps = [beta[i + k] + values[k - 1][:, i] for k in range(1, min(width - i, len(values)) + 1)]
            beta[i] = np.where(n == i, 0.0, _sum_of_logs(steps) if steps else -np.inf)
        total = alpha[n, np.arange(rows)]
        weight = counts[at]
        for k, (piece, v) in enumerate(zip(pieces, values, strict=True), 1):
            r, i = np.nonzero(v > -np.inf)
            share = np.exp(alpha[i, r] + v[r, i] + beta[i + k, r] - total[r]) * weight[r]
            p = piece[r, i]
            known = p >= 0
            out += np.bincount(p[known], share[known], lat.size)
            if k == 1:
                for c, own in spelled.items():
                    np.add.at(out, own, share[~known & (codes[r, i] == c)].sum())
    for i, w in enumerate(words):
        if len(w) + 1 > LONG:
            _one(lat, w, logp, out, float(counts[i]))
    return out


def count_words(texts: DataFrame) -> DataFrame:
    """A kept table (word binary, c): how often each word occurs, the end as the empty word. texts: one column."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])
            held.clear()
            return out

        for batch in batches:
            for raw in common.as_bytes(batch.column(0)):
                held.update(raw.lower().split())
                held[b""] += 1
                if len(held) > REMEMBERED:
                    yield flush()
        if held:
            yield flush()

    return common.keep(texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "counts")


def fit(counts: DataFrame, vocabulary: str, rounds: int = ROUNDS) -> np.ndarray:
    """The pieces' log probabilities. Each round sums expected counts over all distinct words of the table."""
    lat = lattice(vocabulary)
    logp = lat.prior
    for _ in range(rounds):
        now = counts.sparkSession.sparkContext.broadcast(logp)

        def run(batches: Iterable[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            lat, total = lattice(vocabulary), None
            for batch in batches:
                words = [common.as_text(w) for w in common.as_bytes(batch.column(0))]
                c = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
                real = [i for i, w in enumerate(words) if w]
                total = np.zeros(lat.size) if total is None else total
                total += expectations(lat, [words[i] for i in real], c[real], now.value)
                total[lat.end] += c.sum() - c[real].sum()
            if total is not None:
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["piece", "e"])

        sums = counts.mapInArrow(run, "piece long, e double").groupBy("piece").agg(F.sum("e").alias("e")).toArrow()
        expected = np.full(lat.size, SMOOTH)
        expected[sums["piece"].to_numpy()] += sums["e"].to_numpy()
        if not sums.num_rows:
            return logp
        logp = np.log(expected / expected.sum())
    return logp


def frequent(counts: DataFrame, most: int = HEAD) -> dict[bytes, int]:
    """All words that occur at least so often that there are at most ``most`` of them; nothing is sorted."""
    steps = [1, *(round(1.25**k) for k in range(4, 180))]
    at_least = counts.agg(*[F.count(F.when(F.col("c") >= n, 1)).alias(f"n{i}") for i, n in enumerate(steps)]).first()
    least = next((n for n, words in zip(steps, at_least, strict=True) if words <= most), None)
    if least is None:
        return {}
    got = counts.where(F.col("c") >= least).toArrow()
    return dict(zip(got["word"].to_pylist(), got["c"].to_pylist(), strict=True))


class _Numbers(dict):
    """Words numbered as they come; new ones wait in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class _Words:
    """What a worker remembers of words, from task to task of one query: log10 likelihoods, and base scores or NaN."""

    def __init__(self, lat: Lattice, logs: np.ndarray, counts: dict[bytes, int], below: float):
        self.lat, self.logs, self.counts, self.below = lat, logs, counts, below
        self.forget()

    def forget(self) -> None:
        self.numbers = _Numbers()
        self.score = np.empty(0)
        self.base = np.empty(0)

    def number(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))

    def learn(self) -> None:
        """Score the new words."""
        new, self.numbers.new = self.numbers.new, []
        if new:
            found = log_likelihoods(self.lat, [common.as_text(w) for w in new], self.logs) / np.log(10.0)
            counts = np.array([self.counts.get(w, -1.0) for w in new], np.float64)
            base = np.where(counts < 0, np.nan, np.log10((np.maximum(counts, 0) + 0.5) / self.below))
            self.score, self.base = np.concatenate([self.score, found]), np.concatenate([self.base, base])


_worker: dict[str, _Words] = {}


def score(df: DataFrame, training: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "piece_bpe_32k.model", head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) for each row of df; training: rows to learn from."""
    spark = df.sparkSession
    common.bounded_batches(spark)
    counts = count_words(training.select(F.col(text)))
    logp = spark.sparkContext.broadcast(fit(counts, vocabulary, rounds))
    tokens, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    below = tokens + 0.5 * (types + 1)
    known_counts = spark.sparkContext.broadcast(frequent(counts, head))

    query = uuid.uuid4().hex

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if query not in _worker:
            _worker.clear()
            _worker[query] = _Words(lattice(vocabulary), logp.value, known_counts.value, below)
        known = _worker[query]
        end = float(known.logs[known.lat.end]) / np.log(10.0)
        end_base = known.counts.get(b"")
        end_base = None if end_base is None else float(np.log10((end_base + 0.5) / below))
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                texts = [raw.lower().split() for raw in common.as_bytes(batch.column(1))]
                if len(known.numbers) > REMEMBERED:
                    known.forget()
                numbered = [known.number(words) for words in texts]
                known.learn()
                n, n_known, base_sum, total, rare = [], [], [], [], []
                for words, at in zip(texts, numbered, strict=True):
                    base = known.base[at]
                    unknown = np.flatnonzero(np.isnan(base))
                    rest = Counter(words[i] for i in unknown)
                    if end_base is None:
                        rest[b""] += 1
                    n.append(len(words) + 1)
                    n_known.append(len(words) + 1 - sum(rest.values()))
                    base_sum.append(float(np.nansum(base)) + (end_base or 0.0))
                    total.append(float(known.score[at].sum()) + end)
                    rare.append([{"word": w, "k": c} for w, c in rest.items()])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base_sum, pa.float64()), pa.array(total, pa.float64()), pa.array(rare, pa.list_(pa.struct([("word", pa.binary()), ("k", pa.int64())])))],
                    ["id", "n_tokens", "n_head", "base_head", "score", "rare"],
                )

    kind = df.schema[key].dataType.simpleString()
    mapped = df.select(F.col(key).alias("id"), F.col(text)).mapInArrow(run, f"id {kind}, n_tokens long, n_head long, base_head double, score double, rare array<struct<word: binary, k: long>>")
    scored = common.keep(mapped.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.k").join(counts, "word", "left")
    c = F.coalesce("c", F.lit(0))
    sums = rare.groupBy("row").agg(F.sum(F.col("k") * F.log10((c + 0.5) / F.lit(below))).alias("base_rest"), F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("n_rest"))
    out = scored.drop("rare").join(sums, "row", "left")
    return out.select(
        F.col("id").alias(key), "n_tokens", (F.col("n_head") + F.coalesce("n_rest", F.lit(0))).alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base_head") + F.coalesce("base_rest", F.lit(0.0))).alias("base_score"), "score",
    )


def op9_lm_score(spark, sf_dir: str) -> DataFrame:
    """Scores of every document; rows whose crc32 of the id leaves 1 modulo 5 train nothing."""
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, docs.where(common.crc_mod5("doc_id") != 1))
    return out.select("doc_id", (common.crc_mod5("doc_id") == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
