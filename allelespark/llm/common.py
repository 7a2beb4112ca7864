"""What the operators share: tables cut from their lineage, size-checked broadcasts, input columns."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes up to which a narrow table is broadcast; beyond either, joins shuffle.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; a local one is set only where none is (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoints a narrow table in the shared folder, so that lost executors cost one read."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Writes a table as Parquet in the shared folder and reads it back; it is deleted when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def row_bytes(schema: T.StructType) -> int | None:
    """Upper bound of a row's bytes where every column has a fixed width, else None."""
    fixed = (T.LongType, T.IntegerType, T.DoubleType, T.FloatType, T.BooleanType, T.ShortType, T.ByteType)
    return 16 + 8 * len(schema) if all(isinstance(f.dataType, fixed) for f in schema) else None


def small(df: DataFrame, width: int | None = None) -> DataFrame:
    """df, with a broadcast hint if its counted rows times their bounded width fit; df is a cut table, so counting is cheap.

    Beyond the bound the plain table comes back and the join shuffles, skewed keys split by adaptive execution.
    """
    width = width or row_bytes(df.schema)
    if width is None:
        width = 64 + (df.select(F.max(F.expr("+".join(f"coalesce(length(cast(`{c}` as string)),0)" for c in df.columns)))).first()[0] or 0) * 4
    n = df.limit(BROADCAST_ROWS + 1).count()
    return F.broadcast(df) if n <= BROADCAST_ROWS and n * width <= BROADCAST_BYTES else df


#: Rows and bytes of one slice of an Arrow batch; a longer row is a slice of its own.
SLICE_ROWS, SLICE_BYTES = 500, 2 << 20


def _row_ends(batch) -> np.ndarray:
    """Bytes of the strings, binaries and lists of a batch up to the end of each row."""
    import pyarrow as pa
    import pyarrow.compute as pc

    total = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
            total += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        elif pa.types.is_list(c.type):
            total += 8 * pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.cumsum(total)


def slices(batches, rows: int = SLICE_ROWS, size: int = SLICE_BYTES):
    """Arrow batches in slices of bounded rows and bytes, so that few texts are Python objects at once; freed memory goes
    back when they end.

    Python workers are reused by later stages, which would else start on top of what earlier ones have left."""
    try:
        for b in batches:
            ends, i = _row_ends(b), 0
            while i < b.num_rows:
                before = ends[i - 1] if i else 0
                n = max(1, int(np.searchsorted(ends[i : i + rows], before + size, "right")))
                yield b.slice(i, n)
                i += n
    finally:
        tidy()


def tidy() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it keeps what it holds
        pass


def doc_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named input columns, so that extra ones can't clash with what an operator adds."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def keep_columns(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*(F.col(f"`{c}`") for c in like.columns))
