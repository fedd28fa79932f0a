import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riftspark.llm import classifier, lm_score, quality_rules


@pytest.fixture(scope="module")
def lat():
    return lm_score.lattice("piece_bpe_32k.model")


def cuts(lat, text, logp):
    """Sum over all cuts of a short word, one by one."""
    if not text:
        return 1.0
    total = 0.0
    for k in range(1, len(text) + 1):
        p = lat.by_text.get(text[:k])
        if p is not None:
            total += math.exp(logp[p]) * cuts(lat, text[k:], logp)
        elif k == 1:
            total += math.exp(logp[lat.spelled(ord(text[0]))].sum()) * cuts(lat, text[1:], logp)
    return total


@pytest.mark.parametrize("word", ["the", "tionsh", "中文", "aéb", "\x00x", "x"])
def test_likelihood_sums_all_cuts(lat, word):
    want = math.log(cuts(lat, "▁" + word, lat.prior))
    assert lm_score.log_likelihoods(lat, [word], lat.prior)[0] == pytest.approx(want)
    assert lm_score._one(lat, word, lat.prior) == pytest.approx(want)


def test_columns_and_single_words_agree(lat):
    words = ["a", "theory", "zzzzqqq", "é" * 30, "b" * 250, "c" * 199, "x😀y"]
    one = [lm_score._one(lat, w, lat.prior) for w in words]
    assert lm_score.log_likelihoods(lat, words, lat.prior) == pytest.approx(one)
    e = np.zeros(lat.size)
    for w in words:
        lm_score._one(lat, w, lat.prior, e, 2.0)
    assert lm_score.expectations(lat, words, np.full(len(words), 2.0), lat.prior) == pytest.approx(e)


def test_fitting_raises_the_likelihood_and_sums_to_one(spark, lat):
    docs = spark.createDataFrame([(k, "the theory of the other thing " * 5) for k in range(20)], "doc_id long, text string")
    counts = lm_score.count_words(docs.select("text"))
    logp = lm_score.fit(counts, "piece_bpe_32k.model")
    assert np.exp(logp).sum() == pytest.approx(1.0)
    words = ["the", "theory", "of", "other"]
    assert (lm_score.log_likelihoods(lat, words, logp) > lm_score.log_likelihoods(lat, words, lat.prior)).all()


def test_scores_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b A"), (1, "a b A"), (None, None), (2, ""), (3, "q" * 5000)], "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("c", F.lit(2))
    for head in (200_000, 0):  # all words in the broadcast head, or all joined
        got = lm_score.score(docs, docs.where("doc_id < 3"), head=head)
        rows = {(r.doc_id, r.n_tokens): r for r in got.collect()}
        assert got.count() == 5 and rows[(None, 1)].n_known == 1 and rows[(3, 2)].n_known == 1
        n, v = 9, 3
        assert rows[(1, 4)].base_score == pytest.approx(2 * math.log10(4.5 / (n + 2)) + math.log10(2.5 / (n + 2)) + math.log10(3.5 / (n + 2)))
        assert rows[(1, 4)].train_tokens == n and v == 3
    assert lm_score.score(docs.limit(0), docs.limit(0)).count() == 0
    alone = lm_score.score(docs, docs.limit(0)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score < 0 for r in alone)


def test_classifier_learns_and_survives_odd_labels(spark):
    rows = [(k, ("good plain words here " if k % 2 else "$$$ BUY!! ### NOW!! ") * (1 + k % 5)) for k in range(120)]
    docs = spark.createDataFrame([*rows, (500, None), (501, ""), (502, "z" * 100_000), (1, rows[1][1])], "doc_id long, text string").withColumn("SCORE", F.lit("clash"))
    labels = spark.createDataFrame([*((k, k % 2) for k in range(100)), (None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    model = classifier.train(docs, labels)
    got = classifier.apply(docs, model)
    assert got.columns == ["doc_id", "text", "score", "predicted"]
    found = {r.doc_id: r for r in got.collect()}
    assert all(found[k].predicted == k % 2 for k in range(100, 120))
    assert found[500].score == found[501].score and 0 <= found[502].score <= 1
    for some in (labels.limit(0), labels.where("quality = 1")):
        assert classifier.apply(docs, classifier.train(docs, some)).where("score is null").count() == 0
    assert classifier.apply(docs.limit(0), model).count() == 0


def test_scores_are_those_of_the_vectors():
    s = classifier.Settings(bits=10, dim=4, epochs=2)
    texts = [b"one two two three", b"", b"ONE!! TWO!!", b"a a a a"]
    feats = [classifier.document_features(t, s) for t in texts]
    model = classifier.fit(feats, np.array([1, 1, 0, 0]), s)
    score = model.scorer()
    for t, (ids, times) in zip(texts, feats, strict=True):
        z = model.bias + (float((model.weights[ids] * times).sum() / times.sum()) if len(ids) else 0.0)
        assert score(t) == pytest.approx(1 / (1 + math.exp(-z)))


def test_quality_rules_on_odd_rows(spark):
    rng = np.random.default_rng(0)
    clean = " ".join("".join(rng.choice([a + b for a in "bdfghlmnprst" for b in ("a", "e", "i", "o", "un", "ar")], 1 + k % 4)) for k in range(200))
    rows = [(1, clean, "xx"), (2, None, None), (3, "", "en"), (4, "a " * 400, "en"), (5, "x" * 200_000, "en"), (6, " \t\r\n" * 100, None), (7, "!!\x00#*$%&|<> " * 80, "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("KEPT", F.lit(0))
    got = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    assert got[1].kept and not any(got[k].kept for k in range(2, 8))
    assert got[4].n_repeat_words == 400 and got[6].n_words == 0 and got[7].n_symbols == 640
    assert quality_rules.judge(df.drop("lang")).where("kept").count() == 1
    assert quality_rules.judge(df.limit(0)).count() == 0


@pytest.mark.parametrize(("words", "n"), [([], 0), (["a"], 0), (["a"] * 3, 0), (["a"] * 4, 4), (list("abcabc"), 6), (list("abcxabc"), 6), (list("abcd"), 0)])
def test_repeated_words(words, n):
    assert quality_rules.repeated_words([w.encode() for w in words]) == n


def test_measured_bands_keep_the_documents_they_were_measured_on(spark):
    rng = np.random.default_rng(4)
    known = {"en": "the of and to in that was for with his her this from they have".split(), "xx": "un des les que dans pour sur avec est pas plus mais comme tout".split()}
    rows = [(k, lang, " ".join(rng.choice(words, 60 + 7 * (k % 40))) + "\n") for lang, words in known.items() for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    bands = quality_rules.measure(df, rules=quality_rules.Rules(max_repeat_percent=100))
    assert set(bands) == {"en", "xx"} and all(0 < b.low < b.high and 0 < b.piece_low for b in bands.values())
    rules = quality_rules.Rules(max_repeat_percent=100, bands={**quality_rules.Rules().bands, **bands})
    assert quality_rules.judge(df, rules=rules).where("kept").count() >= 0.99 * len(rows)
    bad = spark.createDataFrame([(1, "en", " ".join("x#9%q" * 3 for _ in range(80)))], "doc_id long, lang string, text string")
    assert quality_rules.judge(bad, rules=rules).where("kept").count() == 0


def test_quality_of_endless_white_space(spark):
    df = spark.createDataFrame([(1, "en", "a" + " " * 2_000_000 + "b"), (2, "en", "中" * 100_000)], "doc_id long, lang string, text string")
    got = {r.doc_id: r for r in quality_rules.judge(df, drop_text=True).collect()}
    assert got[1].n_words == 2 and not got[1].kept and not got[2].kept and got[2].fallback_share <= 1
