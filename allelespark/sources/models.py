"""Model bundles: several tables in one folder, as Parquet, JSON lines or CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("observed", "models", "coefficients")


def coefficients(models: DataFrame) -> DataFrame:
    """One row a nonzero coefficient of models(unit_id, predictor_idx, coefficients)."""
    z = models.select("unit_id", F.posexplode(F.arrays_zip("predictor_idx", "coefficients")).alias("ord", "x"))
    return z.select("unit_id", "ord", "x.predictor_idx", F.col("x.coefficients").alias("coefficient")).filter("coefficient <> 0")


def save(bundle: dict[str, DataFrame], path: str, kind: str = "parquet") -> None:
    for name in TABLES:
        bundle[name].write.mode("overwrite").format(kind).option("header", True).save(f"{path}/{name}")


def load(spark: SparkSession, path: str, schemas: dict[str, str], kind: str = "parquet") -> dict[str, DataFrame]:
    return {name: spark.read.schema(schemas[name]).format(kind).option("header", True).load(f"{path}/{name}") for name in TABLES}
