"""The registered queries against SQL or brute force, on the driver's smallest tables."""

import hashlib
import os
import re
import zlib
from collections import Counter
from math import log10

import pytest

from riftspark.llm import queries

from .. import oracle

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def run(spark):
    done = {}

    def get(name):
        if name not in done:
            done[name] = queries.queries()[name](spark, SF).collect()
        return done[name]

    return get


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    oracle.same(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF)


def test_tokens(run, texts):
    import base64

    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    whole = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert len(run("op1_byte_bpe")) == len(texts)
    for r in run("op1_byte_bpe"):
        ids = whole.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_quality_counts_and_verdicts(spark, run, texts):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    wrong = 0
    for r in run("op2_quality_rules"):
        t = texts[r.doc_id]
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = {k for k, n in Counter(triples).items() if n > 1}
        covered = {i + d for i, x in enumerate(triples) if x in often for d in range(3)}
        want = (len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)
        if r.n_words >= 50 and r.doc_id in labels:
            wrong += r.kept != bool(labels[r.doc_id])
    assert wrong <= 0.03 * len(labels)


def test_classifier_is_right_on_rows_that_it_has_not_seen(spark, run, texts):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = run("op5_quality_classifier")
    assert len(got) == len(texts)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.9 * len(held)


def test_near_duplicates(run, texts):
    sets = {}
    for d, t in texts.items():
        w = t.encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    for r in run("op7_near_dedup"):
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)


def test_language_model(run, texts):
    words = {d: [*t.encode().lower().split(), b""] for d, t in texts.items()}
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    c = Counter(w for d, ws in words.items() if not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    for r in run("op9_lm_score"):
        ws = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(ws), sum(w in c for w in ws), n)
        assert r.base_score == pytest.approx(sum(log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        assert r.score < 0


def test_personal_data(run, texts):
    from .test_pii import base_spans

    for r in run("op10_pii"):
        base = base_spans(texts[r.doc_id])
        said = ",".join(f"{k}:{a}:{b}" for a, _, b, k in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for *_, k in base) for x in ("email", "ip", "card", "phone")]


def test_pipeline(spark, texts):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(p.STAGES):
        docs = stage(spark, docs, SF)
        if k < len(p.STAGES) - 1:
            assert docs.columns == columns
            docs = p.common.keep(docs, "test")
    rows = docs.collect()
    assert rows and {r.doc_id for r in rows} <= set(texts)
    assert all(len(r.ids) == r.n_tokens for r in rows)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline as p

    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages_are_those_of_brute_force(spark):
    """Each stage, on what the one before it kept, against plain Python."""
    import base64
    from collections import defaultdict
    from math import log2

    import public_tokenizers as P
    import sentencepiece
    import tiktoken

    import corpus_pipeline as p
    from riftspark.llm import pii, quality_rules as q

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    word = re.compile(r"[^\x20\x09-\x0D]+")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, stages = docs.collect(), dict(p.STAGES)

    def run(name, rows):
        return [r for r in stages[name](spark, spark.createDataFrame(rows, docs.schema), SF).collect()]

    def keeps(r):
        words = word.findall(r.text or "")
        n, text = len(words), r.text or ""
        windows = defaultdict(list)
        for i in range(n - 2):
            windows[tuple(words[i : i + 3])].append(i)
        again = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
        if n < 50 or 100 * len(again) > 50 * n:
            return False
        ids, band = coder.encode_ordinary(text), q.Rules().bands.get(r.lang) or q.Rules().bands[q.script(text)]
        x = min(log2(len(ids)), 13)
        entropy = -sum(c / len(ids) * log2(c / len(ids)) for c in Counter(ids).values())
        partial = sum("\ufffd" in coder.decode_single_token_bytes(i).decode("utf-8", "replace") for i in ids)
        found = pieces.encode(text)
        a, b, c = band.curve
        fits = band.low <= len(text) / len(ids) <= band.high and partial / len(ids) <= band.byte_share and entropy >= a * x * x + b * x + c - band.width
        return fits and len(text) / len(found) >= band.piece_low and sum(map(pieces.is_byte, found)) / len(found) <= band.piece_bytes

    kept = run("quality rules", rows)
    assert sorted(r.doc_id for r in kept) == sorted(r.doc_id for r in rows if keeps(r))

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for r in kept:
        w = word.findall((r.text or "").translate(lower))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    single = run("near duplicates", kept)
    assert sorted(r.doc_id for r in single) == [i for i in ids if root(i) == i]

    clean = {r.doc_id: r.text for r in run("personal data", single)}
    spans = {r.doc_id: r for r in pii.find(spark.createDataFrame(single, docs.schema)).collect()}
    from .test_pii import base_spans

    for r in single:
        base = {f"{k}:{a}:{b}" for a, _, b, k in base_spans(r.text or "")}
        every = [x.split(":") for x in spans[r.doc_id].spans.split(",") if x]
        assert base <= {":".join(x) for x in every}
        text = r.text
        for kind, a, b in sorted(every, key=lambda x: -int(x[1])):
            text = text[: int(a)] + f"[{kind.upper()}]" + text[int(b) :]
        assert clean[r.doc_id] == text

    redacted = [r.__class__(**(r.asDict() | {"text": clean[r.doc_id]})) for r in single]
    mixed = Counter(r.doc_id for r in run("mix", redacted))
    size = {r.doc_id: len(word.findall(r.text or "")) for r in redacted}
    by_source = defaultdict(list)
    for r in redacted:
        by_source[r.source].append(r.doc_id)
    order = sorted(by_source, key=lambda s: (s is None, s))
    weight, total = {s: k % 3 + 1 for k, s in enumerate(order)}, {s: sum(size[i] for i in by_source[s]) for s in order}
    held: set = set()
    while True:
        level = (sum(total.values()) - sum(3 * total[s] for s in held)) / max(1, sum(weight[s] for s in order if s not in held))
        new = {s for s in order if 3 * total[s] <= level * weight[s]}
        if new <= held:
            break
        held |= new
    for s in order:
        target = 3 * total[s] if s in held else level * weight[s]
        passes = min(3, int(target // total[s])) if total[s] else 0
        rest, want = target - passes * total[s], {i: passes for i in by_source[s]}
        for i in sorted(by_source[s], key=lambda i: hashlib.md5(str(i).encode()).hexdigest()[:15]):
            if size[i] <= rest or size[i] - rest < rest:
                want[i] += 1
            if size[i] > rest:
                break
            rest -= size[i]
        assert {i: mixed[i] for i in by_source[s] if size[i]} == {i: n for i, n in want.items() if size[i]}

    taken = [r for r in redacted for _ in range(mixed[r.doc_id])]
    done = run("tokens", taken)
    text = {r.doc_id: r.text or "" for r in redacted}
    assert len(done) == len(taken) and all(list(r.ids) == coder.encode_ordinary(text[r.doc_id]) and r.n_tokens == len(r.ids) for r in done)
