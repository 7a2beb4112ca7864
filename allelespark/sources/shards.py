"""Results kept by chromosome under a digest of their inputs, so that an interrupted job goes on where it stopped."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def digest(df: DataFrame) -> str:
    """Sixteen hex digits that follow from df's rows whatever their order: sums of row hashes, formed before any shuffle."""
    h = F.xxhash64(*df.columns)
    row = df.agg(F.count("*"), F.sum((h % 2147483647).cast("decimal(20,0)")), F.sum(F.shiftrightunsigned(h, 33).cast("decimal(20,0)"))).first()
    return hashlib.sha1("|".join(map(str, [*row, *df.columns])).encode()).hexdigest()[:16]


def key(parts: Iterable[str], config: dict) -> str:
    """The folder name for digests of the inputs and the settings that change the result."""
    return hashlib.sha1(json.dumps([list(parts), sorted(config.items())]).encode()).hexdigest()[:16]


def _path(spark: SparkSession, at: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(at)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def finished(spark: SparkSession, root: str, key: str) -> set[str]:
    """Shards whose write was committed."""
    at, fs = _path(spark, f"{root}/{key}")
    if not fs.exists(at):
        return set()
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return {n[6:] for n in names if n.startswith("shard=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{key}/{n}/_SUCCESS"))}


def resume(spark: SparkSession, root: str, key: str, shards: Iterable[str], build: Callable[[str], DataFrame]) -> DataFrame:
    """build(shard) of all shards, each written once under root/key; those already committed are read, not built."""
    have, all_shards = finished(spark, root, key), list(shards)
    for shard in all_shards:
        if shard not in have:
            build(shard).write.mode("overwrite").parquet(f"{root}/{key}/shard={shard}")
    return spark.read.option("basePath", f"{root}/{key}").parquet(*(f"{root}/{key}/shard={s}" for s in all_shards)).withColumn("shard", F.col("shard").cast("string"))


def partitioned(spark: SparkSession, root: str, key: str, column: str, build: Callable[[], DataFrame]) -> DataFrame:
    """build() written once under root/key, a folder for each value of column, and read back."""
    at = f"{root}/{key}"
    done, fs = _path(spark, f"{at}/_SUCCESS")
    if not fs.exists(done):
        build().repartition(column, F.pmod(F.xxhash64("variant_idx"), F.lit(8))).write.mode("overwrite").partitionBy(column).parquet(at)
    d = spark.read.parquet(at)
    return d.withColumn(column, F.col(column).cast("string"))


def listing(spark: SparkSession, root: str) -> dict[str, set[str]]:
    """The keys under root and their committed shards."""
    at, fs = _path(spark, root)
    return {s.getPath().getName(): finished(spark, root, s.getPath().getName()) for s in fs.listStatus(at)} if fs.exists(at) else {}


def clear(spark: SparkSession, root: str, key: str) -> bool:
    at, fs = _path(spark, f"{root}/{key}")
    return fs.delete(at, True)
