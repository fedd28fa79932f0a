import random

import public_tokenizers as P
import pytest

from riftspark.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
PARTS = ["a", "b", "'s", "'re", "'", "r", " ", "  ", "\n", "\t", "1", "23", "!", "é", "ß", "中", "　", "\xa0", "\x1c", "😀", "the", "'ll", "-", "_", "\x00", "'l", "l"]


@pytest.mark.parametrize("leaf", [2, 5, 16])
def test_tree_gives_the_tokens_of_the_whole_text(leaf):
    small = bpe.ByteBPE(PATH, P.PATTERN, leaf=leaf, window=2)
    rng = random.Random(leaf)
    for k in range(1500):
        t = "".join(rng.choice(PARTS if k % 4 else ["a", "'", "s", " "]) for _ in range(rng.randint(0, 60)))
        assert small.encode(t) == small.tokens.encode_ordinary(t)
        assert small.decode(small.encode(t)) == t.encode()


@pytest.mark.parametrize("text", ["a" * 60_000, " " * 40_000, "word " * 30_000, "中" * 40_000, "'" * 20_000 + "s"])
def test_very_long_texts(text):
    c = bpe.codec("byte_bpe_multi_50k.tiktoken")
    assert c.encode(text) == c.tokens.encode_ordinary(text)


def test_rows(spark):
    df = spark.createDataFrame([(1, "ab cd", 5), (1, "ab cd", 5), (None, None, None), (2, "", 1)], "doc_id long, text string, N_TOKENS int")
    got = bpe.encode(df)
    assert got.columns == ["doc_id", "text", "n_tokens", "ids"]
    rows = {(r.doc_id, r.text): r for r in got.collect()}
    assert got.count() == 4 and rows[(None, None)].ids == [] and rows[(2, "")].n_tokens == 0
    back = bpe.decode(got.select("doc_id", "ids")).collect()
    assert sorted(bytes(r.decoded) for r in back) == [b"", b"", b"ab cd", b"ab cd"]
    assert bpe.encode(df.limit(0)).count() == 0


def test_bytes_that_are_no_text(spark):
    df = spark.range(1).selectExpr("id AS doc_id", "CAST(unhex('61FF62') AS STRING) AS text")
    assert bpe.encode(df, digests=True).first().n_tokens > 0


@pytest.mark.parametrize(("leaf", "window"), [(7, 2), (16, 32), (64, 32)])
def test_long_runs_between_words(leaf, window):
    small = bpe.ByteBPE(PATH, P.PATTERN, leaf=leaf, window=window)
    parts = [*PARTS, " " * 40, "a" * 50, "!" * 45, "ab" * 30, "7" * 40, "the" * 20, "\n" * 35, "-" * 60, "'" * 40, "abracadabra" * 4, "文字", "，", "。"]
    rng = random.Random(leaf)
    for _ in range(600):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 50)))
        assert small.encode(t) == small.tokens.encode_ordinary(t)


@pytest.mark.parametrize("text", ["a" * 1_000_000, "x" + "a" * 300_001, "ab1" * 300_000, "文" * 100_000, "!" * 300_000 + "'s"])
def test_endless_words(text):
    c = bpe.codec("byte_bpe_multi_50k.tiktoken")
    assert c.encode(text) == c.tokens.encode_ordinary(text)


@pytest.mark.parametrize(("before", "space", "after"), [("", " ", ""), ("x", " ", "y"), ("word", "\n", "next"), ("", "　", " z"), ("a ", "\t ", "1")])
def test_ten_million_characters_of_white_space(before, space, after):
    """The library alone exhausts its stack here. A run is one match, less its last character where another follows."""
    c, n = bpe.codec("byte_bpe_multi_50k.tiktoken"), 10_000_000 // len(space.encode())
    run = space * (n // len(space))
    text = before + run + after
    want = c.tokens.encode_ordinary(before.rstrip(" "))
    run = " " * (len(before) - len(before.rstrip(" "))) + run
    if after:
        run, after = run + after[: len(after) - len(after.lstrip(" "))], after.lstrip(" ")
        want += c.tokens._core_bpe.encode_single_piece(run[:-1].encode()) + c.tokens.encode_ordinary(run[-1] + after)
    else:
        want += c.tokens._core_bpe.encode_single_piece(run.encode())
    got = c.encode(text)
    assert got == want and c.decode(got) == text.encode()
