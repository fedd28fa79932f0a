"""What the operators share: tables, words, row keys and tables kept in the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: a longest run of characters other than space and \t..\r. ``bytes.split()`` cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"

_scratch: dict[str, str] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir, which all executors share.

    Only where that setting is unset (tests on one machine) a temporary folder stands in for it.
    The folder is removed when the driver program ends, or by release().
    """
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            master = spark.sparkContext.master
            if not master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="riftspark-")
        _scratch[app] = f"{base.rstrip('/')}/riftspark-{uuid.uuid4().hex}"
        atexit.register(release, spark)
    return _scratch[app]


def release(spark: SparkSession) -> None:
    """Remove every table that the operators have kept for this application."""
    try:
        path = _scratch.pop(spark.sparkContext.applicationId, None)
        if path:
            delete(spark, path)
    except Exception:  # noqa: BLE001  the JVM may have ended before the driver's Python does
        pass


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and lost executors cost nothing.

    The table's folder is in the attribute ``kept_at`` of the result, for drop().
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove tables of keep() that nothing reads any more."""
    for t in tables:
        delete(t.sparkSession, t.kept_at)


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether a kept table has at most so many rows; a count of a Parquet table reads footers only."""
    return df.count() <= rows


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast for a kept table of at most so many (narrow) rows; else Spark joins by shuffle."""
    return F.broadcast(df) if small_enough(df, rows) else df


#: Rows of an Arrow batch of texts: at 4 KB each, 8 MB, in the JVM and in Python.
BATCH_ROWS = 2000


def bounded_batches(spark: SparkSession) -> None:
    """Have Spark send texts to Python in small batches, unless the session has its own number of rows for that. Their bytes are bounded
    by spark.sql.execution.arrow.maxBytesPerBatch, 64 MB by default. The setting is read when a plan runs, so it stays set."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def text_of(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def as_bytes(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each value of a string column, null as none."""
    for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()):
        yield x.as_py() or b""


def as_text(raw: bytes) -> str:
    """Spark's strings may hold bytes that aren't UTF-8; they become U+FFFD, as in Spark's own decoding."""
    return raw.decode("utf-8", "replace")


def stable_hash(data: bytes, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(data, seed)


def crc_mod5(id_col: str) -> Column:
    """crc32 of the id as decimal text, modulo 5 (null ids: 0, as of an empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5


def fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])
