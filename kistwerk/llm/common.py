"""What several operators share: tables, written intermediates, iterating over Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_scratch: dict[str, tuple[SparkSession, str]] = {}


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 1000 rows where the session has the default of 10,000: whole texts stand in them, in the JVM and in Python at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local mode, if unset, one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="kistwerk-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def _remove_scratch() -> None:
    for spark, path in _scratch.values():
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM has gone before us: then the folder's owner clears it
            return


def _place(spark: SparkSession, tag: str) -> str:
    base = shared_dir(spark)
    if base not in _scratch:
        if not _scratch:
            atexit.register(_remove_scratch)
        _scratch[base] = (spark, f"{base}/kistwerk-{uuid.uuid4().hex}")
    return f"{_scratch[base][1]}/{tag}-{uuid.uuid4().hex[:8]}"


def written(df: DataFrame, tag: str, batch_rows: int | None = None) -> DataFrame:
    """The same rows, from a Parquet table in the shared folder. ``batch_rows``: rows in an Arrow batch meanwhile, for rows without texts, where ``small_batches`` has set it.

    It cuts the lineage: a lost executor costs the tasks it ran, not what came before, and both
    readers of an intermediate see the same rows.
    """
    small_batches(df.sparkSession)
    path, conf, key = _place(df.sparkSession, tag), df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    larger = batch_rows and conf.get(key) == "1000"
    try:
        if larger:
            conf.set(key, str(batch_rows))
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if larger:
            conf.set(key, "1000")
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kistwerk_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` gave and that nothing reads any more, and lets Spark drop the shuffle files of queries that are over."""
    for df in tables:
        _delete(df.sparkSession, df._kistwerk_path)
    if tables:
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def written_by(df: DataFrame, tag: str, buckets: int, key: str) -> DataFrame:
    """As written, in buckets by the key: what later needs the rows of a key together reads them without an exchange.

    The session's catalog knows the table by a name of its own; its files lie in the shared folder.
    """
    spark, name = df.sparkSession, f"kistwerk_{tag}_{uuid.uuid4().hex[:8]}"
    small_batches(spark)
    df.write.option("compression", "zstd").option("path", _place(spark, tag)).bucketBy(buckets, key).saveAsTable(name)
    return spark.table(name)


def row_key(*cols: str):
    """A 64-bit key of a row; rows that are equal in these columns share it."""
    return F.xxhash64(*[c for name in cols for c in (F.col(name), F.col(name).isNull())])


def pieces(batch: pa.RecordBatch, column: int, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges of the batch with about ``most`` bytes of the string column; a longer text is a range of its own."""
    off = offsets(batch.column(column))
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def offsets(col: pa.Array) -> np.ndarray:
    """Offsets into the array's data buffer, one more than rows."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    dtype = np.int64 if wide else np.int32
    if not len(col):
        return np.zeros(1, np.int64)
    return np.frombuffer(col.buffers()[1], dtype, len(col) + 1, col.offset * dtype().itemsize).astype(np.int64)


def data(col: pa.Array) -> np.ndarray:
    """The bytes that the offsets point into."""
    buf = col.buffers()[2]
    return np.frombuffer(buf, np.uint8) if buf is not None and len(buf) else np.zeros(0, np.uint8)


def text_slice(col: pa.Array, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of rows i to j; a null text has no bytes."""
    off = offsets(col)[i : j + 1]
    lengths = np.diff(off)
    if col.null_count:
        lengths = np.where(np.asarray(col.is_null())[i:j], 0, lengths)
        if lengths.sum() != off[-1] - off[0]:
            kept = [data(col)[a : a + n] for a, n in zip(off[:-1], lengths, strict=True)]
            return np.concatenate(kept) if kept else np.zeros(0, np.uint8), np.concatenate([[0], np.cumsum(lengths)])
    return data(col)[off[0] : off[-1]], off - off[0]


_M = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M[0]
    x ^= x >> np.uint64(33)
    x *= _M[1]
    x ^= x >> np.uint64(33)
    return x
