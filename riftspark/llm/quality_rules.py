"""Operator 2: quality rules from tokeniser fertility.

Counts of words, symbols, repeated lines and repeated word windows come first. Each text is encoded with two public
vocabularies, a byte-level one and one of pieces with byte fallback, and their measures are held against rejection bands
per language, or per script where the language is unknown:

- characters per token, of both: scrambled case, symbols glued to words and binary rubbish need many tokens;
- byte-fallback share: of pieces, the share that stand for single bytes; of byte-level tokens, the share that aren't whole
  characters;
- entropy of the tokens in bits, against the entropy that clean text of as many tokens has. That expectation is a
  parabola in log2 of the number of tokens; boilerplate, tables and repetition fall below it.

The bands' numbers are parameters; measure() gives those of a table of clean documents. The defaults were measured on the
clean labelled documents of four languages and widened; the bands for other languages are wide.

Edge cases: a null or empty text has no words and fails; bytes that aren't UTF-8 count as U+FFFD; a null or unlisted
language takes its script's band; clashing columns of the input are replaced by the result's; an empty table gives
an empty one; repeated rows are judged alike.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe, common

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Band:
    """What may be kept: chars per token from low to high, byte share at most, entropy at least curve - width."""

    low: float
    high: float
    byte_share: float
    #: a, b, c of the expected entropy a x² + b x + c with x = log2(tokens), x at most 13.
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    width: float = 0.0
    #: The least characters per piece and the greatest share of byte pieces.
    piece_low: float = 0.0
    piece_bytes: float = 1.0


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    vocabulary: str = "byte_bpe_multi_50k.tiktoken"
    pieces: str = "piece_bpe_32k.model"
    bands: dict[str, Band] = field(
        default_factory=lambda: {
            "en": Band(2.20, 8, 0.2, (-0.035, 0.882, 1.512), 0.42, 1.95, 0.15),
            "de": Band(2.23, 8, 0.2, (-0.033, 0.829, 1.751), 0.42, 2.0, 0.15),
            "fr": Band(2.10, 8, 0.2, (-0.027, 0.684, 2.475), 0.42, 1.75, 0.15),
            "es": Band(2.15, 8, 0.2, (-0.026, 0.689, 2.394), 0.52, 1.8, 0.15),
            "latin": Band(1.60, 10, 0.3, (-0.030, 0.771, 2.033), 0.9, 1.4, 0.3),
            "other": Band(0.25, 10, 0.95, (0.0, 0.0, 3.0), 1.0),
        }
    )


_LATIN, _LETTER = re.compile("[A-Za-zÀ-ɏ]"), re.compile(r"[^\W\d_]")


def script(text: str) -> str:
    """latin if at least half of the letters are, else other; a text without letters is latin."""
    return "latin" if 2 * sum(1 for _ in _LATIN.finditer(text)) >= sum(1 for _ in _LETTER.finditer(text)) else "other"


@functools.lru_cache(maxsize=4)
def _partial(vocabulary: str) -> np.ndarray:
    """Which ids aren't whole characters."""
    coder = bpe.codec(vocabulary)
    out = np.zeros(coder.tokens.n_vocab, bool)
    for i in coder.length:
        try:
            coder.tokens.decode_single_token_bytes(i).decode()
        except UnicodeDecodeError:
            out[i] = True
    return out


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a window of three words that the text has at least twice."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    m = len(known)
    if m == n:
        return 0
    pairs = ids[:-1] * m + ids[1:]
    if m >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, at, count = np.unique(pairs[:-1] * m + ids[2:], return_inverse=True, return_counts=True)
    hit = count[at] > 1
    cover = np.zeros(n, bool)
    for k in range(3):
        cover[k : n - 2 + k] |= hit
    return int(cover.sum())


def base_counts(raw: bytes, text: str) -> tuple[int, int, int, int, int]:
    """Words, their characters, symbols, lines with a word that equal an earlier line, words in repeated windows."""
    words = raw.split()
    chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    seen, again = set(), 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            if line in seen:
                again += 1
            else:
                seen.add(line)
    return len(words), chars, sum(text.count(c) for c in SYMBOLS), again, repeated_words(words)


@functools.lru_cache(maxsize=4)
def _pieces(vocabulary: str):
    """A model of pieces, and which of its ids are bytes."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))
    return model, np.array([model.is_byte(i) for i in range(model.get_piece_size())])


def piece_fertility(text: str, vocabulary: str) -> tuple[float, float]:
    """Characters per piece and the share of byte pieces."""
    model, is_byte = _pieces(vocabulary)
    ids = np.array(model.encode(text, num_threads=1), np.int64)
    return (len(text) / len(ids), float(is_byte[ids].mean())) if len(ids) else (0.0, 0.0)


def fertility(text: str, vocabulary: str) -> tuple[float, float, float, int]:
    """Characters per token, byte-fallback share, entropy of the tokens in bits, tokens."""
    coder = bpe.codec(vocabulary)
    # long texts by the tree: the library alone exhausts its stack on endless white space
    ids = coder.tokens.encode_to_numpy(text) if len(text) < bpe.LONG_SPACE else np.array(coder.encode(text), np.int64)
    n = len(ids)
    if not n:
        return 0.0, 0.0, 0.0, 0
    counts = np.bincount(ids)
    partial = _partial(vocabulary)
    share = float(counts[partial[: len(counts)]].sum()) / n
    p = counts[counts > 0] / n
    return len(text) / n, share, float(-(p * np.log2(p)).sum()), n


def in_band(measures: tuple[float, float, float, int], band: Band) -> bool:
    chars, share, entropy, n = measures
    x = min(math.log2(n), 13.0) if n else 0.0
    a, b, c = band.curve
    return band.low <= chars <= band.high and share <= band.byte_share and entropy >= a * x * x + b * x + c - band.width


def pieces_in_band(measures: tuple[float, float], band: Band) -> bool:
    return measures[0] >= band.piece_low and measures[1] <= band.piece_bytes


ADDED = {
    "n_words": T.LongType(), "word_chars": T.LongType(), "n_symbols": T.LongType(), "n_dup_lines": T.LongType(), "n_repeat_words": T.LongType(),
    "base_failed": T.BooleanType(), "kept": T.BooleanType(), "chars_per_token": T.DoubleType(), "byte_share": T.DoubleType(), "token_entropy": T.DoubleType(),
    "n_tokens": T.LongType(), "chars_per_piece": T.DoubleType(), "fallback_share": T.DoubleType(),
}


def judge(df: DataFrame, text: str = "text", lang: str | None = "lang", rules: Rules | None = None, drop_text: bool = False) -> DataFrame:
    """Add counts, measures and the verdict ``kept`` to each row. Narrow, one pass, no shuffle."""
    rules = rules or Rules()
    with_lang = lang is not None and lang in df.columns
    common.bounded_batches(df.sparkSession)
    own = [c for c in df.columns if c.lower() not in ADDED and c != text]
    # language (if any) and text are sent last, the text once
    rest = df.select(*[df[f"`{c}`"] for c in own], *([df[f"`{lang}`"].cast("string").alias("__lang")] if with_lang else []), df[f"`{text}`"])
    fields = [*rest.schema.fields[: len(own)], *([] if drop_text else [rest.schema.fields[-1]])]
    schema = T.StructType([*fields, *(T.StructField(k, v) for k, v in ADDED.items())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(len(own)).to_pylist() if with_lang else [None] * batch.num_rows
            out: list[list] = [[] for _ in ADDED]
            for raw, language in zip(common.as_bytes(batch.column(batch.num_columns - 1)), langs, strict=True):
                body = common.as_text(raw)
                counts = base_counts(raw, body)
                failed = counts[0] < rules.min_words or 100 * counts[4] > rules.max_repeat_percent * counts[0]
                measures, pieces = fertility(body, rules.vocabulary), piece_fertility(body, rules.pieces)
                band = rules.bands.get(language) or rules.bands[script(body)]
                kept = not failed and in_band(measures, band) and pieces_in_band(pieces, band)
                for to, x in zip(out, (*counts, failed, kept, *measures, *pieces), strict=True):
                    to.append(x)
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 3 + [pa.int64()] + [pa.float64()] * 2
            first = [*batch.columns[: len(own)], *([] if drop_text else [batch.column(batch.num_columns - 1)])]
            yield pa.RecordBatch.from_arrays([*first, *map(pa.array, out, kinds)], [f.name for f in schema.fields])

    out = rest.mapInArrow(run, schema)
    return out.select(*[f"`{c}`" for c in df.columns if c in out.columns and c.lower() not in ADDED], *ADDED)


def measure(clean: DataFrame, text: str = "text", lang: str = "lang", margin: float = 0.1, rules: Rules | None = None) -> dict[str, Band]:
    """The bands of each language of a table of clean documents: the extremes of its measures (0.1 % of the documents
    aside), widened by the margin. Sums, the parabola's normal equations among them, are formed in the cluster."""
    rules = rules or Rules()
    found = judge(clean.select(F.col(text).alias("text"), F.col(lang).alias("lang")), rules=rules).where("not base_failed").drop("text")
    found = common.keep(found.withColumn("x", F.least(F.log2("n_tokens"), F.lit(13.0))), "measured")
    powers = [F.sum(F.pow("x", F.lit(k))).alias(f"x{k}") for k in range(5)] + [F.sum(F.pow("x", F.lit(k)) * F.col("token_entropy")).alias(f"y{k}") for k in range(3)]
    at = lambda c, q: F.percentile_approx(c, q, 100_000)
    extremes = [at("chars_per_token", 0.001).alias("low"), F.max("chars_per_token").alias("high"), at("byte_share", 0.999).alias("share"), at("chars_per_piece", 0.001).alias("piece_low"), at("fallback_share", 0.999).alias("bytes")]
    out, less, more = {}, 1 - margin, 1 + margin
    for r in found.groupBy("lang").agg(*powers, *extremes).collect():
        normal = np.array([[r[f"x{i + j}"] for j in range(3)] for i in range(3)])
        c, b, a = (float(v) for v in np.linalg.lstsq(normal, np.array([r[f"y{k}"] for k in range(3)]), rcond=None)[0])
        short = F.lit(a) * F.col("x") * F.col("x") + F.lit(b) * F.col("x") + F.lit(c) - F.col("token_entropy")
        width = found.where(F.col("lang").eqNullSafe(F.lit(r["lang"]))).agg(at(short, 0.999)).first()[0]
        out[r["lang"]] = Band(r["low"] * less, max(8.0, r["high"] * more), min(1.0, max(0.2, r["share"] * more)), (a, b, c), max(0.0, width) * more + margin, r["piece_low"] * less, min(1.0, max(0.1, r["bytes"] * 2)))
    common.drop(found)
    return out


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document; clean ones are kept."""
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return judge(docs, drop_text=True).drop("lang")
