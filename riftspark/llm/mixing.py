"""Operator 3: mixing sources to target weights by hash-threshold histograms.

Sources get shares of the whole in proportion to their weights, none more than ``cap`` times its own size (water
filling). A source's target is so many full passes over it and a rest. For the rest, each row has a 60-bit hash of its
key; the sizes are summed by source and the hash's first 12 bits, the bucket where the running sum passes the rest is
the boundary, and only the boundary bucket's rows are summed again by their next 12 bits, until one hash value is left.
Rows below that threshold are taken once more; the rows of the threshold's own hash are, if that comes nearer to the
rest. Rows are never sorted, and each step shuffles at most 4096 sums a source and task.

Native: DataFrame functions only.

Edge cases: a null source is a source, the last; a null text has size 0; a null key hashes as an empty text; rows of
one key share a hash and so a decision, also those of a null key, so that a source whose rows have one key or none is
taken whole or not at all in a pass; sources without words take nothing; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BITS, LEVELS = 12, 5
#: Sources up to which their thresholds are broadcast (about 100 bytes each); more are joined by shuffle.
BROADCAST_SOURCES = 50_000


def word_count(text: str) -> Column:
    return F.regexp_count(common.text_of(text), F.lit(common.WORD)).cast("long")


def key_hash(key: str) -> Column:
    """The first 60 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """Sources (a row each, column source) with their rank from 0 in the order of code points, null last. The sort is dealt out by
    ranges; only the number of rows of each part is summed in one place."""
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    sorted_ = common.keep(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("__id", F.monotonically_increasing_id()), "sorted")
    parts = sorted_.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    first = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("__part", first.alias("__first"))
    out = sorted_.withColumn("__part", part).join(F.broadcast(parts), "__part").withColumn("rank", F.col("__first") + place)
    return out.drop("__part", "__first", "__id")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, few: int = BROADCAST_SOURCES) -> DataFrame:
    """(source, source_size, target) from (source, size): shares by the weights, at most cap times the size.

    What sources above their cap leave is shared by the others, round by round, until none is above. The level of a round never
    falls, so that a source once above stays above: the sources above at the end are a prefix of the order of cap x size /
    weight, and their level is the greatest of the levels after each prefix. Up to ``few`` sources, windows over their rows find
    it in one job; more are ranked by a sort dealt out by ranges, and each round is one sum over them. Both give the same.
    """
    total = common.keep(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    small = common.small_enough(total, few)
    rank = total.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) if small else ranked(total)
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod("rank", F.lit(len(weights))).cast("int") + 1).cast("long")
    weighed = rank.select("source", "source_size", weight.alias("weight"))
    limit = F.col("source_size") * cap
    if small:
        before = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
        every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        left = F.sum("source_size").over(every) - F.coalesce(F.sum(limit).over(before), F.lit(0))
        levels = weighed.withColumn("level", left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
        return levels.select("source", "source_size", F.least(limit.cast("double"), F.max("level").over(every) * F.col("weight")).alias("target"))
    weighed = common.keep(weighed, "weighed")
    words = weighed.agg(F.sum("source_size")).first()[0]
    level, above = 0.0, -1
    while True:
        held = (limit.cast("double") <= F.lit(level) * F.col("weight")) if above >= 0 else F.lit(False)
        n, full, free = weighed.agg(F.count(F.when(held, 1)), F.coalesce(F.sum(F.when(held, limit)), F.lit(0)), F.coalesce(F.sum(F.when(~held, F.col("weight"))), F.lit(0))).first()
        if n == above or not free:
            break
        level, above = float(words - full) / float(free), n
    return weighed.select("source", "source_size", F.least(limit.cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def with_source(rows: DataFrame, state: DataFrame) -> DataFrame:
    """rows with the columns of their source's state; the sources are broadcast only if few."""
    state = state.withColumnRenamed("source", "__source")
    return rows.join(common.maybe_broadcast(state, BROADCAST_SOURCES), rows["source"].eqNullSafe(state["__source"]), "left").drop("__source")


def thresholds(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """Kept (source, source_size, target, passes, rest, threshold, inclusive) from (source, size, hash).

    A row is taken passes times, and once more if its hash is below the threshold, or equal to it where inclusive.
    """
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = targets(sizes, weights, cap).withColumn("passes", F.least(F.floor(share), F.lit(cap)))
    goal = goal.withColumn("rest", F.greatest(F.col("target") - F.col("passes") * F.col("source_size"), F.lit(0.0)))
    goal = common.keep(goal, "goal")
    # prefix: the first bits of the boundary; below: the sizes of all hashes under it
    state = common.keep(goal.select("source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below")), "state")
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        bucket = F.shiftrightunsigned("hash", shift)
        inside = with_source(sizes.where("size > 0"), state).where(F.shiftrightunsigned("hash", shift + BITS) == F.col("prefix"))
        sums = inside.groupBy("source", bucket.alias("bucket")).agg(
            F.sum("size").alias("words"), F.min("hash").alias("first"), F.max("hash").alias("last"), F.first("rest").alias("rest"), F.first("below").alias("under")
        )
        running = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        passed = sums.withColumn("upto", F.col("under") + running).where(F.col("upto") > F.col("rest"))
        first = passed.groupBy("source").agg(F.min(F.struct("bucket", F.col("upto"), "words", "first", "last", "rest")).alias("b"))
        found = common.keep(
            first.select("source", "b.rest", F.col("b.bucket").alias("prefix"), (F.col("b.upto") - F.col("b.words")).alias("below"), "b.words", "b.first", (F.col("b.first") == F.col("b.last")).alias("single")),
            "state",
        )
        common.drop(state)
        state = found
        if not state.where("not single").limit(1).count():
            break
    near = (F.col("below") + F.col("words") - F.col("rest")) < (F.col("rest") - F.col("below"))
    edge = state.select(F.col("source").alias("__s"), F.col("first").alias("threshold"), near.alias("inclusive"))
    out = goal.join(edge, goal["source"].eqNullSafe(edge["__s"]), "left").drop("__s")
    out = common.keep(out.withColumns({"threshold": F.coalesce("threshold", F.lit(0).cast("long")), "inclusive": F.coalesce("inclusive", F.lit(False))}), "thresholds")
    common.drop(goal, state)
    return out


def passes_of() -> Column:
    """How often a row with its source's thresholds is taken."""
    more = (F.col("hash") < F.col("threshold")) | (F.col("inclusive") & (F.col("hash") == F.col("threshold")))
    return F.col("passes") + more.cast("long")


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """The mixed table: each row of df as often as the mix takes it, with df's columns."""
    sizes = common.keep(df.select(F.col(source).alias("source"), word_count(text).alias("size"), key_hash(key).alias("hash")), "sizes")
    state = thresholds(sizes, weights, cap)
    common.drop(sizes)
    small = state.select(F.col("source").alias("__source"), F.col("passes").alias("__passes"), F.col("threshold").alias("__threshold"), F.col("inclusive").alias("__inclusive"))
    hashed = df.withColumn("__hash", key_hash(key))
    found = hashed.join(common.maybe_broadcast(small, BROADCAST_SOURCES), hashed[f"`{source}`"].eqNullSafe(small["__source"]), "left")
    more = (F.col("__hash") < F.col("__threshold")) | (F.col("__inclusive") & (F.col("__hash") == F.col("__threshold")))
    times = (F.col("__passes") + more.cast("long")).cast("int")
    return found.select(*[df[f"`{c}`"] for c in df.columns], times.alias("__times")).where("__times > 0").withColumn("__time", F.explode(F.sequence(F.lit(1), "__times"))).drop("__times", "__time")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    docs = common.read_table(spark, sf_dir, "documents")
    sizes = common.keep(docs.select("doc_id", "source", word_count("text").alias("size"), key_hash("doc_id").alias("hash")), "sizes")
    state = thresholds(sizes)
    return with_source(sizes, state).select("doc_id", "size", "source_size", "target", (F.col("size") * passes_of()).alias("taken"))


ORACLE_SQL = """
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash
  FROM documents
), total AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source
), weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM total
), levelled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER before, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM weighed
  WINDOW before AS (ORDER BY source_size * 3 / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goal AS (
  SELECT source, source_size, least((source_size * 3)::DOUBLE, max(level) OVER () * weight) AS target FROM levelled
), passing AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS passes FROM goal
), resting AS (
  SELECT *, greatest(target - passes * source_size, 0) AS rest FROM passing
), grouped AS (
  SELECT source, hash, sum(size)::BIGINT AS words FROM sizes GROUP BY source, hash
), running AS (
  SELECT *, sum(words) OVER (PARTITION BY source ORDER BY hash) AS upto FROM grouped
), chosen AS (
  SELECT r.source, r.hash, (upto <= rest OR (upto - words <= rest AND words > 0 AND upto - rest < rest - (upto - words))) AS more
  FROM running r JOIN resting g ON r.source IS NOT DISTINCT FROM g.source
)
SELECT s.doc_id, s.size, g.source_size, g.target, s.size * (g.passes + CASE WHEN c.more THEN 1 ELSE 0 END) AS taken
FROM sizes s
JOIN resting g ON s.source IS NOT DISTINCT FROM g.source
JOIN chosen c ON s.source IS NOT DISTINCT FROM c.source AND s.hash = c.hash
"""
