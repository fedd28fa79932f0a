import random

import pytest

from riftspark.llm import near_dedup
from riftspark.llm.components import components


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def brute(rows):
    sets = []
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((d, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, p) in enumerate(sets):
        for b, q in sets[:i]:
            both = len(p & q)
            if a is not None and b is not None and p and q and 100 * both >= 75 * (len(p) + len(q) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted(((d, len(s), find(d) if d is not None else None) for d, s in sets), key=repr)


def result(df, **k):
    return sorted(((r.id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, **k).collect()), key=repr)


def test_a_spread_family_and_its_neighbours(spark):
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 300)}" for _ in range(120)]
    rows = []
    for k in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 9999)}"
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, " ".join(f"y{rng.randint(0, 50)}" for _ in range(60))) for k in range(60)]
    rows += [(2000 + k, rows[k % 3][1].upper()) for k in range(40)]
    rng.shuffle(rows)
    assert result(frame(spark, rows)) == brute(rows)
    assert result(frame(spark, rows), settings=near_dedup.Settings(block=16, broadcast_rows=1)) == brute(rows)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "a b c"), (None, "a b"), (7, "a b"), (7, "q r s t u v w"), (8, "q r s t u v w"), (9, "z " * 40_000), (4, "a b")]
    assert result(frame(spark, rows)) == [(r[0], r[1], {5: 4, 7: 4, 8: 4}.get(r[0], r[0])) for r in sorted(((d, n, c) for d, n, c in brute(rows)), key=repr)]
    assert result(frame(spark, rows).limit(0)) == []
    left = near_dedup.deduplicate(frame(spark, rows).selectExpr("*", "1 AS id", "2 AS key"))
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 2, 3, 4, 4, 6, 9]
    assert left.columns == ["doc_id", "text", "id", "key"]


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 30)] + [(50, 51), (51, 52), (52, 50)], [(9, 3), (3, 7), (8, 7), (2, 8), (None, 4)]])
def test_components(spark, edges):
    parent = {x: x for e in edges for x in e if x is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.id: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


def test_estimates_are_close_and_bands_find_links():
    s, known, rng = near_dedup.Settings(), near_dedup._Hashes(), random.Random(1)
    import numpy as np

    off, found = [], 0
    for _ in range(40):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(400)]
        other = list(words)
        for i in rng.sample(range(400), 11):
            other[i] = "x"
        p, q = (near_dedup.shingles(" ".join(w).encode(), known) for w in (words, other))
        true = len(np.intersect1d(p, q)) / len(np.union1d(p, q))
        (a, x), (b, y) = (near_dedup.bands_and_bits(near_dedup.minima(v, s), s) for v in (p, q))
        d = x ^ y
        d = (d | (d.view(np.uint64) >> np.uint64(1)).view(np.int64)) & 0x5555555555555555
        off.append((1 - np.bitwise_count(d).sum() / s.hashes - 0.25) / 0.75 - true)
        found += bool((a == b).any())
    assert abs(np.mean(off)) < 0.03 and np.std(off) < 0.07 and found == 40
