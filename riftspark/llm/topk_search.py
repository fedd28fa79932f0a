"""Operator 6: exact top-k search by block-at-a-time pruning.

Rows are put into an order in which like vectors stand together: by the nearest of some pivots (rows of least hash, at most
PIVOTS of them), then by a hash. A block is a short range of that order with the rows' whole vectors (the forward index)
and, for every term, the greatest value in the block. A vector component is two terms, its positive and its negative
part, so that the sum over a query's components of the fitting term maxima bounds every score in the block. A query visits the
blocks in the order of their bounds and stops when the next bound falls below its k-th score (or equals it, where no id of
the block is smaller). A block is scored for all queries that reach it at once.

Queries come in slabs of a fixed size. Only one slab is held by the driver and broadcast at a time; its results are written
before the next one is read. For each slab, the block of the best bound is found for every query (from the maxima alone)
and scored first; the k-th scores found there are the floors from which every task begins, so that tasks share a threshold. Each
task then searches the blocks it holds and returns k rows for each query, which are ranked again by query. Blocks never meet
other blocks. How many blocks the queries reached is in the result's attribute ``visited`` (scored, all).

How much is pruned depends on the data: vectors that lean together are pruned well; random directions aren't, since the sum of
64 maxima lies far above any score.

Scores are exact integers: products are summed as doubles where no sum can reach 2^53, else as Python integers,
held within the range of a long before they are ranked.

Edge cases: null vectors and vectors with null or non-finite components are neither queries nor candidates; of vectors
of unequal lengths the shorter counts as filled with zeros; rows of the query's own id are no candidates, and an id
that has several rows is asked once, by its greatest vector; other repeated rows are candidates each; null ids take
no part; an empty table gives an empty one. The result has only its own columns, whatever the input's are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BLOCK = 256
#: Rows of a block, before the next pivot's rows begin a new one.
LEAST_BLOCK = 32
#: Queries of a slab: at 64 components, 16 MB.
SLAB = 32_768
#: Pivots that rows are ordered by; they only decide which rows share a block.
PIVOTS = 256
#: Blocks that a task holds at a time.
HELD = 64

#: Scores are held within the range of a long, before they are ranked.
EDGE = 2**63 - 1

INDEX = "least long, ids binary, width int, vectors binary, high binary, low binary"
_NAMES = [x.split()[0] for x in INDEX.split(", ")]


def usable(column: str) -> Column:
    c = F.col(column)
    return c.isNotNull() & ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def quantised(column: str, factor: float = 256.0) -> Column:
    return F.transform(F.col(column), lambda x: _floor(x.cast("double") * F.lit(factor)))


def _floor(x: Column) -> Column:
    # floor() gives a long and would overflow for large doubles, which are whole numbers anyway
    return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of doubles as a matrix, short ones filled with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = int(lengths.max()) if len(lengths) else 0
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def _fitting(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _chained(p: np.ndarray) -> np.ndarray:
    """Pivots in an order in which each is followed by the nearest of those left, so that neighbours share blocks."""
    left, out = list(range(len(p))), []
    while left:
        with np.errstate(over="ignore", invalid="ignore"):
            gap = ((p[left] - p[out[-1]]) ** 2).sum(axis=1) if out else np.zeros(len(left))
        out.append(left.pop(int(gap.argmin())))
    return p[out]


def ordered(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector, pivot) of rows, dealt out and sorted by the nearest pivot and a hash of the key, so that a pivot of many
    rows is dealt to several tasks."""
    mixed = F.xxhash64(key, vector)
    pivots = df.where(F.col(key).isNotNull()).select(vector, mixed.alias("h")).orderBy("h", vector).limit(PIVOTS).select(vector).toArrow()
    column = pivots[vector].combine_chunks() if pivots.num_rows else pa.array([], pa.list_(pa.float64()))
    p = _chained(_matrix(column))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            width = max(x.shape[1], p.shape[1])
            at, other = _fitting(x, width), _fitting(p, width)
            with np.errstate(over="ignore", invalid="ignore"):
                near = (2 * at @ other.T - (other * other).sum(axis=1)).argmax(axis=1) if len(other) else np.zeros(len(at), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32))], ["id", "v", "pivot"])

    near = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).mapInArrow(run, "id long, v array<double>, pivot int")
    return near.repartitionByRange("pivot", F.xxhash64("id")).sortWithinPartitions("pivot", F.xxhash64("id"))


def index(df: DataFrame, key: str = "vec_id", vector: str = "vector") -> DataFrame:
    """A kept table of numbered blocks of (key, array<double>) rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x, pivot = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1)), batch.column(2).to_numpy()
            if not len(ids):
                continue
            out: list[list] = [[] for _ in range(6)]
            first, changes = 0, np.append(np.flatnonzero(np.diff(pivot)) + 1, len(ids))
            while first < len(ids):
                # up to the last change of the pivot within the block, if enough rows lie before it
                last = min(first + BLOCK, len(ids))
                at = np.searchsorted(changes, last, side="right")
                if last < len(ids) and at and changes[at - 1] - first >= LEAST_BLOCK:
                    last = int(changes[at - 1])
                part = slice(first, last)
                for to, value in zip(out, (int(ids[part].min()), ids[part].tobytes(), x.shape[1], x[part].tobytes(), x[part].max(axis=0).tobytes(), x[part].min(axis=0).tobytes()), strict=True):
                    to.append(value)
                first = last
            kinds = [pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], _NAMES)

    rows = df.where(F.col(key).isNotNull())
    return common.keep(ordered(rows, key, vector).mapInArrow(run, INDEX).withColumn("block", F.monotonically_increasing_id()), "index")


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows, as doubles where these are exact, else as Python integers."""
    if len(q) and len(x) and q.shape[1] and np.abs(q).max() * np.abs(x).max() * q.shape[1] >= 2.0**53:
        to = np.frompyfunc(int, 1, 1)
        return to(q) @ to(x).T
    return q @ x.T


def bounds(queries: np.ndarray, maxima: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The greatest score that each query can have in blocks with these greatest and least values."""
    width = max([queries.shape[1], *(len(h) for h, _ in maxima)])
    q = _fitting(queries, width)
    high, low = (np.stack([_fitting(m[k][None, :], width)[0] for m in maxima]) for k in (0, 1))
    out = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    # rounding must not lower a bound
    return out + np.abs(out) * 1e-9 if np.abs(out).max(initial=0) >= 2.0**53 else out


class _Best:
    """The k best (score, id) of each query."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, floors: np.ndarray | None = None):
        self.ids, self.vectors, self.k, self.scored, self.all = ids, vectors, k, 0, 0
        self.found: list[list[tuple]] = [[] for _ in ids]  # (-score, id), sorted
        self.worst = np.full(len(ids), -np.inf) if floors is None else floors.copy()
        self.worst_id = np.full(len(ids), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        width = max(self.vectors.shape[1], vectors.shape[1])
        s = _scores(_fitting(self.vectors[rows], width), _fitting(vectors, width))
        own = self.ids[rows][:, None] == ids[None, :]
        exact = s.dtype == object
        low = s.astype(np.float64)
        low[own] = -np.inf
        floor = self.worst[rows]
        for r in np.flatnonzero((low >= floor[:, None]).any(axis=1)):
            at = np.flatnonzero((low[r] >= floor[r]) & ~own[r])
            if not exact and len(at) > 4 * self.k:
                # of many, the k best and what ties with the last of them
                cut = np.partition(low[r, at], len(at) - self.k)[len(at) - self.k]
                at = at[low[r, at] >= cut]
                above, tied = at[low[r, at] > cut], at[low[r, at] == cut]
                at = np.concatenate([above, tied[np.argsort(ids[tied], kind="stable")][: self.k]])
            got = sorted(self.found[rows[r]] + [(max(-EDGE, min(EDGE + 1, -int(s[r, c]))), int(ids[c])) for c in at])[: self.k]
            self.found[rows[r]] = got
            if len(got) == self.k:
                self.worst[rows[r]], self.worst_id[rows[r]] = float(-got[-1][0]), got[-1][1]

    def visit(self, blocks: list[tuple]) -> None:
        """Search blocks (least id, ids, vectors, high, low), each query in the order of its bounds."""
        bound = bounds(self.vectors, [(b[3], b[4]) for b in blocks])
        least = np.array([b[0] for b in blocks])
        self.all += bound.size
        order = np.argsort(-bound, axis=1, kind="stable")
        active = np.arange(len(bound))
        for step in range(len(blocks)):
            at = order[active, step]
            top = bound[active, at]
            # bounds fall from here on; a tie matters only for a smaller id, which a later block of that bound may have
            active_now = top >= self.worst[active]
            active, at, top = active[active_now], at[active_now], top[active_now]
            if not len(active):
                return
            need = (top > self.worst[active]) | (least[at] < self.worst_id[active])
            self.scored += int(need.sum())
            for b in np.unique(at[need]):
                self.add(active[need & (at == b)], blocks[b][1], blocks[b][2])


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of an index as (least id, ids, vectors, high, low, block)."""
    for least, ids, width, vectors, high, low, block in zip(*(batch.column(c) for c in (*_NAMES, "block")), strict=True):
        got = np.frombuffer(ids.as_buffer(), np.int64)
        yield least.as_py(), got, np.frombuffer(vectors.as_buffer(), np.float64).reshape(len(got), width.as_py()), np.frombuffer(high.as_buffer(), np.float64), np.frombuffer(low.as_buffer(), np.float64), block.as_py()


def _first_blocks(blocks: DataFrame, sent) -> DataFrame:
    """(row, block): the block of the best bound for each query of a slab, from the maxima alone."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, vectors = sent.value
        best, block = np.full(len(vectors), -np.inf), np.zeros(len(vectors), np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, HELD):
                part = batch.slice(k, HELD)
                found = bounds(vectors, [tuple(np.frombuffer(c.as_buffer(), np.float64) for c in pair) for pair in zip(part.column(0), part.column(1), strict=True)])
                at = found.argmax(axis=1)
                top = found[np.arange(len(vectors)), at]
                numbers = part.column(2).to_numpy()
                block, best = np.where(top > best, numbers[at], block), np.maximum(top, best)
        rows = np.flatnonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(best[rows]), pa.array(block[rows])], ["row", "bound", "block"])

    each = blocks.select("high", "low", "block").mapInArrow(run, "row long, bound double, block long")
    return each.groupBy("row").agg(F.max(F.struct("bound", "block"))["block"].alias("block"))


def _floors(blocks: DataFrame, sent, k: int) -> np.ndarray:
    """For each query of a slab, the k-th score in the block of its best bound; -inf where that has fewer rows."""
    context, (ids, _) = blocks.sparkSession.sparkContext, sent.value
    first = _first_blocks(blocks, sent).toArrow()
    row, block = first["row"].to_numpy(), first["block"].to_numpy()
    order = np.argsort(block, kind="stable")
    row, block = row[order], block[order]
    numbers, starts = np.unique(block, return_index=True)
    of = context.broadcast(dict(zip(numbers.tolist(), np.split(row, starts[1:]), strict=True)) if len(row) else {})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = sent.value
        for batch in batches:
            for _, got, rows, _, _, number in _blocks(batch):
                asked = of.value[number]
                best = _Best(ids[asked], vectors[asked], k)
                best.add(np.arange(len(asked)), got, rows)
                yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(best.worst)], ["row", "floor"])

    wanted = blocks.sparkSession.createDataFrame([(n,) for n in numbers.tolist()], "block long")
    got = blocks.join(F.broadcast(wanted), "block", "left_semi").select(*_NAMES, "block").mapInArrow(run, "row long, floor double").toArrow()
    of.destroy()
    out = np.full(len(ids), -np.inf)
    out[got["row"].to_numpy()] = got["floor"].to_numpy()
    return out


def search(blocks: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "vector") -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best rows in a table of index()."""
    spark = blocks.sparkSession
    context = spark.sparkContext
    asked = common.keep(queries.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("id")).agg(F.max(vector).alias("v")), "queries")
    slabs = max(1, -(-asked.count() // (SLAB * 3 // 4)))
    found, scored, every = None, context.accumulator(0), context.accumulator(0)
    for n in range(slabs):
        # hash parts of three quarters of a slab on average; the limit of a slab's memory has that much room
        slab = asked.where(F.pmod(F.xxhash64("id"), F.lit(slabs)) == n).toArrow().combine_chunks()
        column = slab["v"].combine_chunks() if slab.num_rows else pa.array([], pa.list_(pa.float64()))
        if not slab.num_rows and (found is not None or n + 1 < slabs):
            continue
        sent = context.broadcast((slab["id"].to_numpy().astype(np.int64), _matrix(column)))
        floors = context.broadcast(_floors(blocks, sent, k) if slab.num_rows else np.empty(0))

        def run(batches: Iterable[pa.RecordBatch], sent=sent, floors=floors) -> Iterator[pa.RecordBatch]:
            best, held = _Best(*sent.value, k, floors.value), []
            if not len(best.ids):
                return
            for batch in batches:
                for block in _blocks(batch):
                    held.append(block)
                    if len(held) == HELD:
                        best.visit(held)
                        held = []
            if held:
                best.visit(held)
            scored.add(best.scored)
            every.add(best.all)
            rows = [(int(q), i, -s) for q, got in zip(best.ids, best.found, strict=True) for s, i in got]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["query_id", "vec_id", "score"])

        part = common.keep(blocks.select(*_NAMES, "block").mapInArrow(run, "query_id long, vec_id long, score long"), "found")
        sent.destroy()
        floors.destroy()
        found = part if found is None else found.unionByName(part)
    common.drop(asked)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    out = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    out.visited = (scored.value, every.value)
    return out


def op6_topk_search(spark, sf_dir: str) -> DataFrame:
    """The five best rows for every row whose vec_id is divisible by 50."""
    rows = common.read_table(spark, sf_dir, "embeddings").where(F.col("vec_id").isNotNull() & usable("embedding")).select("vec_id", quantised("embedding").alias("vector"))
    return search(index(rows), rows.where("vec_id % 50 = 0"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (
  SELECT vec_id, max(x) AS x FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x)::BIGINT AS score FROM q JOIN v ON q.vec_id <> v.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
