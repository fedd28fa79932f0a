"""Operator 5: quality classifier from supervised subword embeddings.

A document is the average of hashed vectors: one for each word, for each character n-gram of the word between its
boundary marks, and one for a word that repeats the word before it. A softmax over two classes follows. Vectors and
output are trained together by numpy stochastic gradient descent on a bounded sample of labelled rows.

Scoring needs no vectors: the average is linear, so that each hashed feature counts with one number, its vector times the
difference of the output columns. A word's features are summed once and remembered.

Edge cases: null and empty texts have no features and get the score of the bias alone; labels other than 0 and 1 and null
labels train nothing; without any usable label, or with one class only, the score is that class's smoothed share; a
repeated doc_id trains once; clashing columns are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common


@dataclass(frozen=True)
class Settings:
    #: The most labelled rows that are learned from: those whose ids hash lowest.
    sample: int = 4000
    bits: int = 17
    dim: int = 12
    grams: tuple[int, int] = (3, 5)
    epochs: int = 6
    #: Few rows are gone through more often, up to so many steps, but at most 60 times.
    steps: int = 6000
    rate: float = 0.5
    seed: int = 7
    #: Words whose sums a worker remembers at a time.
    remembered: int = 300_000


AGAIN = b"\x00again"


def word_features(word: bytes, s: Settings) -> list[int]:
    """Hashes of the word and of its n-grams (of bytes, between boundary marks)."""
    mask, crc = (1 << s.bits) - 1, zlib.crc32
    marked = b"<" + word + b">"
    out = [crc(marked) & mask]
    for n in range(s.grams[0], s.grams[1] + 1):
        out += [crc(marked[i : i + n], n) & mask for i in range(len(marked) - n + 1)]
    return out


def document_features(raw: bytes, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of a text and how often each occurs."""
    counts: dict[bytes, int] = {}
    last, again = None, 0
    for w in raw.split():
        counts[w] = counts.get(w, 0) + 1
        again += w == last
        last = w
    ids: list[int] = []
    times: list[int] = []
    for w, k in counts.items():
        f = word_features(w, s)
        ids += f
        times += [k] * len(f)
    if again:
        ids.append(zlib.crc32(AGAIN) & ((1 << s.bits) - 1))
        times.append(8 * again)
    if not ids:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    unique, at = np.unique(np.array(ids, np.int32), return_inverse=True)
    return unique, np.bincount(at, np.array(times, np.float64)).astype(np.float32)


@dataclass
class Model:
    settings: Settings
    weights: np.ndarray  # of each feature in the log odds of class 1
    bias: float
    key: int

    def scorer(self):
        """A function from a text's bytes to the probability of class 1."""
        known, s, weights = _known(self), self.settings, self.weights
        again = 8 * float(weights[zlib.crc32(AGAIN) & ((1 << s.bits) - 1)])

        def score(raw: bytes) -> float:
            total, n, last = 0.0, 0, None
            for w in raw.split():
                got = known.get(w)
                if got is None:
                    f = word_features(w, s)
                    got = (float(weights[f].sum()), len(f))
                    if len(known) >= s.remembered:
                        known.clear()
                    if len(w) <= 64:
                        known[w] = got
                total += got[0]
                n += got[1]
                if w == last:
                    total += again
                    n += 8
                last = w
            z = self.bias + (total / n if n else 0.0)
            return 1.0 / (1.0 + np.exp(-min(max(z, -500.0), 500.0)))

        return score


_memory: dict[int, dict] = {}


def _known(model: Model) -> dict:
    if model.key not in _memory:
        _memory.clear()
        _memory[model.key] = {}
    return _memory[model.key]


def fit(features: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, s: Settings) -> Model:
    """Stochastic gradient descent, one document at a time, with a falling rate."""
    rng = np.random.default_rng(s.seed)
    n, ones = len(labels), float((labels == 1).sum())
    prior = float(np.log((ones + 0.5) / (n - ones + 0.5)))
    vectors = rng.uniform(-1 / s.dim, 1 / s.dim, (1 << s.bits, s.dim)).astype(np.float32)
    out = np.zeros((s.dim, 2), np.float32)
    bias = np.array([-prior / 2, prior / 2], np.float32)
    if 0 < ones < n:
        epochs = max(s.epochs, min(60, -(-s.steps // n)))
        steps, step = epochs * n, 0
        for _ in range(epochs):
            for i in rng.permutation(n):
                ids, times = features[i]
                rate = s.rate * (1 - step / steps)
                step += 1
                if not len(ids):
                    continue
                share = times / times.sum()
                rows = vectors[ids]
                h = share @ rows
                z = h @ out + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[labels[i]] -= 1
                back = out @ p
                out -= rate * np.outer(h, p)
                bias -= 0.1 * rate * p
                # features that are rare in the text move as far as frequent ones would with a rate for each
                vectors[ids] = rows - (rate * np.minimum(share * len(ids), 8.0))[:, None] * back
    weights = (vectors @ (out[:, 1] - out[:, 0])).astype(np.float64)
    return Model(s, weights, float(bias[1] - bias[0]), int(common.stable_hash(weights.tobytes()) >> 1))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", settings: Settings | None = None) -> Model:
    """Learn from at most settings.sample labelled rows, those of the lowest hash of the key. Features are computed on
    the executors; the driver gets only them."""
    s = settings or Settings()
    common.bounded_batches(docs.sparkSession)
    chosen = (
        labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("__key")).agg(F.max(label).cast("int").alias("__label"))
        .orderBy(F.xxhash64("__key"), "__key").limit(s.sample)
    )
    rows = docs.select(F.col(key).alias("__key"), common.text_of(text).alias("__text")).join(F.broadcast(chosen), "__key").groupBy("__key").agg(F.min("__text").alias("t"), F.max("__label").alias("y"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [document_features(raw, s) for raw in common.as_bytes(batch.column("t"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), batch.column("y"), pa.array([i.tobytes() for i, _ in got], pa.binary()), pa.array([t.tobytes() for _, t in got], pa.binary())], ["k", "y", "ids", "times"]
            )

    found = rows.select(F.col("__key").cast("string").alias("k"), "y", "t").mapInArrow(run, "k string, y int, ids binary, times binary").toArrow().sort_by("k")
    features = [(np.frombuffer(i.as_py(), np.int32), np.frombuffer(t.as_py(), np.float32)) for i, t in zip(found["ids"], found["times"], strict=True)]
    return fit(features, np.array(found["y"].to_pylist(), np.int64), s)


def apply(df: DataFrame, model: Model, text: str = "text", threshold: float = 0.3, drop_text: bool = False) -> DataFrame:
    """Add score and predicted to each row. Narrow; the model is one number for each hash bucket (1 MB)."""
    common.bounded_batches(df.sparkSession)
    rest = df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in ("score", "predicted") and not (drop_text and c == text)], df[f"`{text}`"].alias("__text"))
    schema = T.StructType([*rest.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            got = np.array([score(raw) for raw in common.as_bytes(batch.column(batch.num_columns - 1))], np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got), pa.array((got >= threshold).astype(np.int32))], [f.name for f in schema.fields])

    return rest.mapInArrow(run, schema)


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Score every document; rows whose crc32 of the id leaves 0 modulo 5 train nothing."""
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.read_table(spark, sf_dir, "labels")
    model = train(docs, labels.where(common.crc_mod5("doc_id") != 0))
    scored = apply(docs, model, drop_text=True)
    return scored.select("doc_id", (common.crc_mod5("doc_id") == 0).alias("held_out"), "score", "predicted")
