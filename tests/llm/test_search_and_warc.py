import gzip
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from riftspark.llm import topk_search, warc


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def found(spark, df, k=5, every=10):
    rows = df.where(F.col("vec_id").isNotNull() & topk_search.usable("embedding")).select("vec_id", topk_search.quantised("embedding").alias("vector"))
    out = topk_search.search(topk_search.index(rows), rows.where(f"vec_id % {every} = 0"), k)
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out.collect())


def brute(rows, k=5, every=10):
    v = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in x]) for i, x in rows if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)]
    out = []
    queries = {}
    for i, x in v:
        if i % every == 0:
            queries[i] = max(x, queries.get(i, x))
    for i, x in queries.items():
        held = lambda n: max(-(2**63) + 1, min(2**63, n))  # noqa: E731  of the negative score
        s = sorted((held(-sum(a * b for a, b in zip(x, y, strict=False))), j) for j, y in v if j != i)[:k]
        out += [(i, n, j, -score) for n, (score, j) in enumerate(s, 1)]
    return sorted(out)


def test_search_is_that_of_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(int(k), [float(np.float32(c)) for c in rng.normal(0, 0.2, 8)]) for k in range(900)]
    assert found(spark, vectors(spark, rows).repartition(3)) == brute(rows)


def test_ties_and_repeated_vectors(spark):
    rows = [(k, [1.0, 0.5]) for k in range(600)] + [(k, [0.5, -1.0]) for k in range(600, 700)] + [(10, [1.0, 0.5])]
    assert found(spark, vectors(spark, rows).repartition(2), every=100) == brute(rows, every=100)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [3.0]), (6, []), (None, [1.0, 1.0]), (7, [1e30, 1e30]), (10, [-1.0, 1e20]), (8, [0.1, 0.2])]
    got = found(spark, vectors(spark, rows))
    assert got == brute(rows)
    assert found(spark, vectors(spark, rows).limit(0)) == []
    assert found(spark, vectors(spark, [(0, [1.0])])) == []


def test_slabs(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "SLAB", 8)
    rng = np.random.default_rng(1)
    rows = [(int(k), [float(np.float32(c)) for c in rng.normal(0, 1, 4)]) for k in range(200)]
    assert found(spark, vectors(spark, rows)) == brute(rows)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


PAGES = [(1, "http://a/é b", "x" * 120), (2, "http://b", "x" * 120), (2, "http://b", "x" * 120), (3, None, None), (4, "u\r\nX: 1", ""), (5, "c", "short"), (6, "d", "short"), (None, "e", "x" * 120), (7, "f", "é\r\n\r\nWARC/1.1\r\n" * 5000), (1, "g", "x" * 120)]


def test_round_trip_and_index(spark):
    index = warc.write(warc.plan(pages(spark, PAGES)), file_bytes=500)
    got = sorted(((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read(index, index.archives).collect()), key=repr)
    want = [(1, 120, "response", None), (1, 120, "response", None), (2, 120, "revisit", 1), (2, 120, "revisit", 1), (3, 0, "response", None), (4, 0, "response", None), (5, 5, "response", None), (6, 5, "response", None), (0, 120, "revisit", 1), (7, 80000, "response", None)]
    assert got == sorted(want, key=repr)
    some = warc.read(index.where("page_id = 7"), index.archives, payloads=True).first()
    assert bytes(some.payload).decode() == PAGES[8][2]
    at = index.archives.removeprefix("file://")
    names = {r.file for r in index.select("file").distinct().collect()}
    assert len(names) > 1 and set(os.listdir(at)) == names
    for n in names:  # each archive is a valid series of gzip members
        with gzip.open(f"{at}/{n}") as f:
            assert f.read().startswith(b"WARC/1.1\r\n")
    assert warc.write(warc.plan(pages(spark, PAGES).limit(0))).count() == 0


def test_damage_is_noticed():
    raw = warc.record(1, "u", b"abc", "0" * 64, 3, "response", None)
    assert warc.parse(raw)[1:] == (3, b"abc")
    with pytest.raises(ValueError):
        warc.parse(raw[:-5])


def test_vectors_that_lean_together_are_pruned(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (24, 16))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    rows = [(int(k), [float(np.float32(c)) for c in centres[k % 24] + rng.normal(0, 0.03, 16)]) for k in range(6000)]
    df = vectors(spark, rows).repartition(3).where(topk_search.usable("embedding")).select("vec_id", topk_search.quantised("embedding").alias("vector"), F.lit(1).alias("block"), F.lit("x").alias("score"))
    out = topk_search.search(topk_search.index(df), df.where("vec_id % 50 = 0"))
    scored, every = out.visited
    assert 0 < scored < 0.25 * every
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out.collect()) == brute(rows, every=50)


def test_long_records_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(warc, "READ", 2000)
    rows = [(k, f"http://{k}", chr(97 + k) * (50 if k % 3 else 40_000)) for k in range(12)] + [(20, "http://20", "a" * 40_000)]
    df = pages(spark, rows).withColumns({"digest": F.lit(0), "payload": F.lit("x"), "file": F.lit("y"), "offset": F.lit(-1)})
    index = warc.write(warc.plan(df))
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.read(index, index.archives).collect()}
    assert got == {k: (len(h), "response", None) for k, _, h in rows[:-1]} | {20: (40_000, "revisit", 0)}
