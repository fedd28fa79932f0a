"""Operator 7: near duplicates by b-bit MinHash.

1. Each text becomes the set of its five-word shingles (64-bit hashes), its MinHash signature of 224 minima, of which two
   bits each are kept in seven longs, and 44 band keys of five whole minima each. A link at similarity 0.75 shares
   no band with a chance of 7e-6.
2. Texts of equal sets collapse to one representative; copies are never paired.
3. Representatives that share a band key form a bucket; its smallest id is its centre. Each member is first paired with
   the smallest of its centres only, then with those centres that are still in other components.
4. A pair's packed signatures give the share c of equal 2-bit values by bit counts; (c - 1/4) / (3/4) corrects for chance
   collisions. Pairs four standard deviations below the threshold go.
5. The rest is confirmed on full shingle sets; confirmed links give components.
6. What centres can't see, a link between two members of a bucket that are still in different components, is searched
   for in the buckets that hold several components: blocks of at most 1024 x 1024 members are compared by bit counts
   within a task, pairs of different components that pass the estimate again by longer signatures, of 1024 minima. What
   passes both comes out, in the first band that the pair shares, and is confirmed like the others. Components are formed
   anew from all links.

No group is gathered in one task: buckets are counted with partial aggregation, large ones are cut into blocks. A bucket
with m members of many components costs m²/2 bit counts in (m/1024)²/2 tasks; pairs inside a component cost nothing.

Edge cases: null texts and texts without words have an empty set and no link; fewer than five words make one shingle; a
null id links with nothing and stays; rows of one id are one node, whatever their texts; clashing columns are replaced;
an empty table gives an empty one. Ids must be integers.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    percent: int = 75
    rows: int = 5
    bands: int = 44
    longs: int = 7
    #: Longs of the longer signatures.
    fine_longs: int = 32
    seed: int = 20
    #: Standard deviations of the estimate that a pair may lie below the threshold.
    margin: float = 4.0
    #: Members of a side of a block.
    block: int = 1024
    #: Rows of an (id, fingerprint) table that may be broadcast: at 24 bytes, 48 MB.
    broadcast_rows: int = 2_000_000

    @property
    def hashes(self) -> int:
        return 32 * self.longs

    def estimate_at_least(self, hashes: int) -> float:
        """The estimate that a pair at the threshold passes, but for so many standard deviations."""
        j = self.percent / 100
        c = j + (1 - j) / 4
        return j - self.margin * (c * (1 - c) / hashes) ** 0.5 / 0.75

    def equal_at_least(self, hashes: int) -> float:
        """The same as a number of equal values."""
        return (self.estimate_at_least(hashes) * 0.75 + 0.25) * hashes


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = common.stable_hash(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on each other."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(raw: bytes, known: _Hashes, k: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's k-word shingles."""
    words = raw.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    if len(known) > 200_000:
        known.clear()
    w = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    size = min(n, k)
    h = w[: n - size + 1] + np.uint64(size)
    for i in range(1, size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : n - size + 1 + i]
    return np.unique(_mix(h))


@functools.lru_cache(maxsize=4)
def _factors(seed: int, hashes: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(found: np.ndarray, s: Settings, hashes: int | None = None) -> np.ndarray:
    hashes = hashes or s.hashes
    factors, out, step = _factors(s.seed, hashes)[:, None], None, 1 + 262_144 // hashes
    for k in range(0, len(found), step):
        part = (factors * found[None, k : k + step]).min(axis=1)
        out = part if out is None else np.minimum(out, part)
    return out


def packed(least: np.ndarray) -> np.ndarray:
    """The low two bits of the (mixed) minima, 32 to a long."""
    two = ((least ^ (least >> np.uint64(32))) & np.uint64(3)).reshape(-1, 32)
    return np.bitwise_or.reduce(two << (np.arange(32, dtype=np.uint64) * np.uint64(2)), axis=1).view(np.int64)


def bands_and_bits(least: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and packed bits."""
    rows = least[: s.bands * s.rows].reshape(s.bands, s.rows)
    key = np.arange(1, s.bands + 1, dtype=np.uint64)
    for i in range(s.rows):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return key.view(np.int64), packed(least)


def _fingerprint(found: np.ndarray) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_digest(found.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _lists(parts: list[np.ndarray | None], width: int) -> pa.Array:
    flat = [p for p in parts if p is not None]
    offsets = np.cumsum([0, *(0 if p is None else width for p in parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat) if flat else np.empty(0, np.int64)))


def sign(df: DataFrame, s: Settings) -> DataFrame:
    """From (id, text): id, n, the fingerprint f1, f2 of the set, bands and bits (empty for empty sets)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            n, f1, f2, bands, bits = [], [], [], [], []
            for raw in common.as_bytes(batch.column(1)):
                found = shingles(raw, known, s.shingle)
                n.append(len(found))
                x, y = _fingerprint(found) if len(found) else (None, None)
                f1.append(x)
                f2.append(y)
                p, q = bands_and_bits(minima(found, s), s) if len(found) else (None, None)
                bands.append(p)
                bits.append(q)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), _lists(bands, s.bands), _lists(bits, s.longs)], ["id", "n", "f1", "f2", "bands", "bits"]
            )

    return df.mapInArrow(run, "id long, n long, f1 long, f2 long, bands array<long>, bits array<long>")


def estimate(x: Column, y: Column, s: Settings) -> Column:
    """The collision-corrected similarity of two packed signatures."""
    equal = F.lit(s.hashes)
    for i in range(s.longs):
        d = x[i].bitwiseXOR(y[i])
        equal = equal - F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return (equal / F.lit(s.hashes) - F.lit(0.25)) / F.lit(0.75)


def sets_of(ids: DataFrame, docs: DataFrame, reps: DataFrame, s: Settings, fine: bool = False) -> DataFrame:
    """A kept table (id, value) of representatives: their sets as bytes, or their longer signatures."""
    ids = common.keep(ids.distinct().join(reps.select("id", "f1"), "id"), "ids")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            keys, out = [], []
            for i, f1, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.as_bytes(batch.column(2)), strict=True):
                found = shingles(raw, known, s.shingle)
                # rows of one id may have other texts than the representative
                if len(found) and _fingerprint(found)[0] == f1:
                    keys.append(i)
                    out.append(packed(minima(found, s, 32 * s.fine_longs)).tobytes() if fine else found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.binary())], ["id", "value"])

    texts = docs.join(common.maybe_broadcast(ids, s.broadcast_rows), "id").select("id", "f1", "text")
    out = common.keep(texts.mapInArrow(run, "id long, value binary").groupBy("id").agg(F.first("value").alias("value")), "values")
    common.drop(ids)
    return out


def confirm(pairs: DataFrame, docs: DataFrame, reps: DataFrame, s: Settings) -> DataFrame:
    """Those pairs (a, b) of representatives whose full sets are similar enough, kept."""
    full = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("id")), docs, reps, s)

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, large = min(len(p), len(q)), max(len(p), len(q))
                if 100 * small < s.percent * large:
                    out.append(False)
                    continue
                both = len(np.intersect1d(p, q, assume_unique=True))
                out.append(100 * both >= s.percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(out, pa.bool_()))

    with_b = pairs.join(full.select(F.col("id").alias("b"), F.col("value").alias("set_b")), "b")
    with_a = with_b.join(full.select(F.col("id").alias("a"), F.col("value").alias("set_a")), "a")
    links = common.keep(with_a.select("a", "b", "set_a", "set_b").mapInArrow(check, "a long, b long"), "links")
    common.drop(full)
    return links


def across(members: DataFrame, labels: DataFrame, docs: DataFrame, reps: DataFrame, s: Settings) -> DataFrame:
    """Pairs (a, b) of a bucket whose ends lie in different components and whose estimate passes."""
    at = common.keep(members.join(labels, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp")), "labelled")
    mixed = at.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("m")).where("x <> y")
    mixed = common.keep(mixed.select("key", F.ceil(F.col("m") / s.block).cast("int").alias("parts")), "mixed")
    low = F.transform("bands", lambda k: F.shiftright(F.shiftleft(k, 32), 32).cast("int"))
    among = common.keep(at.join(mixed, "key"), "among")
    fine = sets_of(among.select("id"), docs, reps, s, fine=True)
    some = among.join(reps.select("id", "bits", low.alias("bands")), "id").join(fine.withColumnRenamed("value", "fine"), "id")
    # block (i, j) with i <= j meets part i with part j; a member of part p goes to each block with p in it
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    units = some.withColumn("part", part).select("key", "id", "comp", "bits", "bands", "fine", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    units = units.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "id", "comp", "bits", "bands", "fine")
    units = units.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    limit, fine_limit = s.equal_at_least(s.hashes), s.equal_at_least(32 * s.fine_longs)

    def unequal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        d = x ^ y
        return np.bitwise_count((d | (d >> np.uint64(1))) & np.uint64(0x5555555555555555))

    def pairs_of(key: int, i: int, j: int, part: np.ndarray, ids: np.ndarray, comp: np.ndarray, bits: np.ndarray, bands: np.ndarray, fine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if comp.min() == comp.max():
            return ids[:0], ids[:0]
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        a, b = [], []
        for k in range(0, len(left), 64):
            rows = left[k : k + 64]
            equal = np.full((len(rows), len(right)), s.hashes, np.int64)
            for w in range(s.longs):
                equal -= unequal(bits[rows, w][:, None], bits[right, w][None, :])
            p, q = np.nonzero((equal >= limit) & (comp[rows][:, None] != comp[right][None, :]))
            p, q = rows[p], right[q]
            for n in range(0, len(p), 8192):
                x, y = p[n : n + 8192], q[n : n + 8192]
                close = 32 * s.fine_longs - unequal(fine[x], fine[y]).sum(axis=1, dtype=np.int64) >= fine_limit
                x, y = x[close], y[close]
                first = bands[x, (bands[x] == bands[y]).argmax(axis=1)] == np.int64(key).astype(np.int32)
                a.append(ids[x[first]])
                b.append(ids[y[first]])
        return (np.concatenate(a), np.concatenate(b)) if a else (ids[:0], ids[:0])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
            bits = batch.column(6).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, s.longs)
            bands = batch.column(7).flatten().to_numpy(zero_copy_only=False).reshape(-1, s.bands)
            fine = np.frombuffer(b"".join(x.as_py() for x in batch.column(8)), np.uint64).reshape(-1, s.fine_longs)
            return [*(batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)), bits, bands, fine]

        def emit(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            key, i, j = cols[:3]
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            bounds = [0, *cuts.tolist(), len(key)]
            for x, y in zip(bounds, bounds[1:], strict=False):
                if y - x > 1:
                    a, b = pairs_of(int(key[x]), int(i[x]), int(j[x]), *(c[x:y] for c in cols[3:]))
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = columns(batch)
            if held:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            # the last unit may go on in the next batch
            key, i, j = cols[:3]
            same = (key == key[-1]) & (i == i[-1]) & (j == j[-1])
            cut = len(key) - int(same.sum())
            if cut:
                yield from emit([c[:cut] for c in cols])
            held = [c[cut:] for c in cols]
        if held:
            yield from emit(held)

    out = common.keep(units.mapInArrow(run, "a long, b long").distinct(), "across")
    common.drop(at, mixed, among, fine)
    return out


def likely(pairs: DataFrame, reps: DataFrame, s: Settings) -> DataFrame:
    """The pairs whose estimate passes, kept."""
    bits = reps.select("id", "bits")
    guess = pairs.join(bits.toDF("a", "bits_a"), "a").join(bits.toDF("b", "bits_b"), "b")
    return common.keep(guess.where(estimate(F.col("bits_a"), F.col("bits_b"), s) >= s.estimate_at_least(s.hashes)).select("a", "b"), "likely")


def joined(links: DataFrame, labels: DataFrame, pairs: DataFrame, docs: DataFrame, reps: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """Links and labels with those of more pairs."""
    if not pairs.count():
        return links, labels
    more = confirm(pairs, docs, reps, s)
    if not more.count():
        return links, labels
    every = common.keep(links.unionByName(more), "links")
    common.drop(links, labels, more, pairs)
    return every, components(every)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings | None = None) -> DataFrame:
    """One row for each row of df: id, n_shingles, component_id (the smallest id reachable by links) and kept."""
    s = settings or Settings()
    common.bounded_batches(df.sparkSession)
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    signed = common.keep(sign(docs, s), "signed")
    usable = signed.where("n > 0 and id is not null")
    reps = common.keep(usable.groupBy("f1", "f2").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("bits").alias("bits")), "sets")

    banded = reps.select("id", F.explode("bands").alias("key"))
    buckets = common.keep(banded.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("key", "lo"), "buckets")
    members = common.keep(banded.join(buckets, "key"), "members")
    stars = members.where("id <> lo").select(F.col("lo").alias("a"), F.col("id").alias("b"))
    tried = common.keep(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "tried")
    links = confirm(likely(tried, reps, s), docs, reps, s)

    # rows of one id with different texts tie their sets together
    twice = common.keep(usable.groupBy("id").agg(F.min(F.struct("f1", "f2")).alias("x"), F.max(F.struct("f1", "f2")).alias("y")).where("x <> y").select("id"), "twice")
    if twice.count():
        rep = usable.select("id", "f1", "f2").distinct().join(twice, "id").join(reps.select("f1", "f2", F.col("id").alias("rep")), ["f1", "f2"])
        least = common.keep(rep.groupBy("id").agg(F.min("rep").alias("a")), "least")
        tied = common.keep(links.unionByName(rep.join(least, "id").select("a", F.col("rep").alias("b")).where("a <> b").distinct()), "links")
        common.drop(least, links)
        links = tied
    common.drop(twice)

    labels = components(links)
    at = lambda c: labels.select(F.col("id").alias(c), F.col("comp").alias(f"comp_{c}"))
    others = common.keep(stars.distinct().join(tried, ["a", "b"], "left_anti"), "others")
    apart = others.join(at("a"), "a", "left").join(at("b"), "b", "left").where(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")).select("a", "b")
    links, labels = joined(links, labels, likely(apart, reps, s), docs, reps, s)
    found = across(members.select("key", "id"), labels, docs, reps, s)
    tested = tried.unionByName(others)
    links, labels = joined(links, labels, common.keep(found.join(tested, ["a", "b"], "left_anti"), "more"), docs, reps, s)
    common.drop(buckets, members, tried, others, found, links)

    # sets with copies, or in the component of a smaller id
    labelled = reps.select("f1", "f2", "copies", "id").join(labels, "id", "left")
    of_set = common.keep(labelled.where("copies > 1 or comp is not null").select("f1", "f2", F.coalesce("comp", "id").alias("comp")), "of_set")
    common.drop(reps, labels)
    out = signed.select("id", "n", "f1", "f2").join(of_set, ["f1", "f2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("comp", "id"))
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings | None = None) -> DataFrame:
    """The rows of df without those whose component has a smaller id. Rows of one id stay or go together."""
    gone = common.keep(near_duplicates(df, key, text, settings).where("not kept").select(F.col("id").alias("__gone")).distinct(), "gone")
    return df.join(gone, df[f"`{key}`"].cast("long") == gone["__gone"], "left_anti")


def op7_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Set size, component and verdict of every document."""
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).withColumnRenamed("id", "doc_id")
