"""Models written for other programs: tables, CSV with a companion, an Arrow container, JSON documents; and read back."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import is_ambiguous

# The columns of the two CSV tables.
COEFFICIENTS = ("target_variant_id", "predictor_variant_id", "predictor_chromosome", "predictor_position", "predictor_counted_allele", "predictor_other_allele", "predictor_allele_frequency", "coefficient")
VARIANTS = ("variant_id", "chromosome", "position", "effect_allele", "other_allele", "beta", "status", "imputation_r2", "allele_frequency", "intercept", "n_predictors")
FORMATS = ("json", "arrow", "parquet", "csv")


def coefficient_table(coefficients: DataFrame, variants: DataFrame, units: DataFrame) -> DataFrame:
    """COEFFICIENTS for coefficients(unit_id, predictor_idx, coefficient), variants(variant_idx, variant_id, chromosome,
    position, ref_allele, alt_allele, allele_frequency) and units(unit_id, variant_id). Coefficients may bring their
    predictor_allele_frequency, then variants need no allele_frequency."""
    own = [F.col("allele_frequency").alias("predictor_allele_frequency")] if "predictor_allele_frequency" not in coefficients.columns else []
    p = variants.select(
        F.col("variant_idx").alias("predictor_idx"), F.col("variant_id").alias("predictor_variant_id"), F.col("chromosome").alias("predictor_chromosome"), F.col("position").alias("predictor_position"),
        F.col("alt_allele").alias("predictor_counted_allele"), F.col("ref_allele").alias("predictor_other_allele"), *own,
    )
    return coefficients.join(units.withColumnRenamed("variant_id", "target_variant_id"), "unit_id").join(p, "predictor_idx").select(*COEFFICIENTS)


def companion(path: str) -> str:
    """The folder of a table's coefficients: name_variants.csv has name_coefficients.csv beside it."""
    return f"{path.removesuffix('.csv').removesuffix('_variants')}_coefficients.csv"


def write_csv(model, path: str, variance: bool = True, predictors: bool = False) -> str:
    """The variant table of a model as CSV under path and its coefficients beside it, both written by tasks."""
    columns = [*VARIANTS, *(["residual_variance"] if variance else []), *(["predictor_variant_ids"] if predictors else [])]
    t = model.tables
    model.variant_table().select(columns).write.mode("overwrite").option("header", True).csv(path)
    terms = t["dispositions"].select(F.col("prs_row").alias("unit_id"), "variant_id")
    c = t["coefficients"].filter("role <> 'region'")
    out = coefficient_table(c, t["variants"], terms)
    role = c.join(terms.withColumnRenamed("variant_id", "target_variant_id"), "unit_id").join(t["variants"].select(F.col("variant_idx").alias("predictor_idx"), F.col("variant_id").alias("predictor_variant_id")), "predictor_idx").select("target_variant_id", "predictor_variant_id", "role").distinct()
    out.join(role, ["target_variant_id", "predictor_variant_id"]).select(*COEFFICIENTS, "role").write.mode("overwrite").option("header", True).csv(companion(path))
    return path


def read_csv(spark: SparkSession, path: str):
    """The imputation model of write_csv(). Units are numbered by their terms; a predictor's row number stands for its index."""
    from ..model import ScoreModel

    real = dict.fromkeys(("beta", "imputation_r2", "allele_frequency", "intercept", "residual_variance", "predictor_allele_frequency", "coefficient"), "double") | dict.fromkeys(("position", "predictor_position"), "bigint") | {"n_predictors": "int"}

    def table(at: str) -> DataFrame:
        d = spark.read.csv(at, header=True)
        return d.select(*(F.expr(f"try_cast({c} AS {real[c]})").alias(c) if c in real else c for c in d.columns))

    v, c = table(path), table(companion(path))
    terms = ["variant_id", "chromosome", "position", "effect_allele", "other_allele", "beta"]
    unit = F.xxhash64(*terms)
    v = v.withColumns({"unit_id": unit, "role": F.when(F.col("status").startswith("observed_fallback"), "fallback").when(F.col("status") == "observed", "observed").otherwise("target")})
    variants = c.select(*COEFFICIENTS[1:7]).distinct().withColumn("variant_idx", F.xxhash64(*COEFFICIENTS[1:6]))
    variants = variants.toDF("variant_id", "chromosome", "position", "alt_allele", "ref_allele", "allele_frequency", "variant_idx")
    models = v.filter("role <> 'observed'")
    if "residual_variance" not in v.columns:
        models = models.withColumn("residual_variance", F.lit(None).cast("double"))
    zero = F.lit(None).cast("double")
    m = models.select("unit_id", "role", "intercept", "beta", zero.alias("cv_mse"), F.col("imputation_r2").alias("cv_r2"), "n_predictors", F.col("status").endswith("intercept_only").alias("intercept_only"), "allele_frequency", "residual_variance", zero.alias("target_variance"))
    coefficients = c.join(models.select("unit_id", F.col("variant_id").alias("target_variant_id"), "role"), ["target_variant_id", "role"]).select("unit_id", "role", F.xxhash64(*COEFFICIENTS[1:6]).alias("predictor_idx"), "coefficient")
    seen = v.filter("role = 'observed'").select("unit_id", *terms)
    d = v.filter("role <> 'fallback'").select(F.col("unit_id").alias("prs_row"), *terms, "status", F.lit(None).cast("string").alias("reason"))
    return ScoreModel({"observed": seen, "models": m, "coefficients": coefficients, "variants": variants, "dispositions": d}, {}, {"method": "imputation"})


def write_arrow(model, path: str) -> str:
    """All tables of a model in one Arrow file: a row (table_name, bytes) for each, its bytes an Arrow stream. The driver holds
    one table at a time, so this suits models of a size that a reader of one file can load."""
    import pyarrow as pa

    settings = json.dumps({"info": model.info, "calibration": model.calibration}, default=str).encode()
    schema = pa.schema([("table_name", pa.string()), ("bytes", pa.large_binary())])
    with pa.OSFile(path, "wb") as f, pa.ipc.new_file(f, schema) as w:
        w.write_batch(pa.record_batch([pa.array(["settings"]), pa.array([settings], pa.large_binary())], schema=schema))
        for name, d in model.tables.items():
            sink = pa.BufferOutputStream()
            t = d.toArrow()
            with pa.ipc.new_stream(sink, t.schema) as s:
                s.write_table(t)
            w.write_batch(pa.record_batch([pa.array([name]), pa.array([sink.getvalue().to_pybytes()], pa.large_binary())], schema=schema))
    return path


def read_arrow(spark: SparkSession, path: str):
    import pyarrow as pa

    from ..model import ScoreModel

    with pa.memory_map(path) as f:
        rows = pa.ipc.open_file(f).read_all().to_pylist()
    parts = {r["table_name"]: r["bytes"] for r in rows}
    settings = json.loads(parts.pop("settings"))
    tables = {n: spark.createDataFrame(pa.ipc.open_stream(b).read_all()) for n, b in parts.items()}
    return ScoreModel(tables, settings["calibration"], settings["info"])


def export(model, folder: str, name: str = "model", formats=("json", "parquet"), variance: bool = True) -> dict[str, str]:
    """The model in each of formats under folder, and where each stands; projections are written as JSON or Parquet only."""
    from . import scores

    unknown = set(formats) - set(FORMATS)
    if unknown or model.projected and set(formats) & {"csv", "arrow"}:
        raise ValueError(f"{', '.join(sorted(unknown or set(formats) & {'csv', 'arrow'}))} is no format of this model")
    out = {}
    for kind in formats:
        at = f"{folder}/{name}" + {"json": ".json", "arrow": ".arrow", "parquet": "_parquet", "csv": "_variants.csv"}[kind]
        if "://" not in folder:
            os.makedirs(folder, exist_ok=True)
        if kind == "json":
            scores.write_document(model, at, variance)
        elif kind == "arrow":
            write_arrow(model, at)
        elif kind == "parquet":
            model.save(at)
        else:
            write_csv(model, at, variance)
        out[kind] = at
    return out


def load(spark: SparkSession, path: str):
    """A model of any format of export(), told by the name of its path."""
    from ..model import ScoreModel
    from . import scores

    if path.endswith(".json"):
        return scores.read_document(spark, path)
    if path.endswith(".arrow"):
        return read_arrow(spark, path)
    if path.endswith(".csv"):
        return read_csv(spark, path)
    if path.endswith((".h5", ".hdf5")):
        raise ValueError("HDF5 models are not read; write the model as Parquet, Arrow, CSV or JSON")
    return ScoreModel.load(spark, path)


def accepted_ids(terms: DataFrame) -> DataFrame:
    """terms with accepted_ids and ambiguous, as a document's observed variants have them."""
    locus = F.concat_ws(":", "chromosome", "position")
    return terms.withColumns({"accepted_ids": F.array_distinct(F.array("variant_id", locus)), "ambiguous": is_ambiguous(F.col("effect_allele"), F.col("other_allele"))})
