"""Scores of a panel reduced to what a chip would have seen, held against the full panel's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import is_hard_call, render_genotype
from . import harmonize, metrics


def mask(panel: DataFrame, dosages: DataFrame, platform: DataFrame) -> DataFrame:
    """dosages, null at variants that the chip doesn't carry."""
    on = harmonize.partition_by_platform(panel, platform).select("variant_idx", F.col("matched_by").isNotNull().alias("on_chip"))
    return dosages.join(on, "variant_idx").select("sample_idx", "variant_idx", F.when(F.col("on_chip"), F.col("dosage")).alias("dosage"))


def as_uploads(panel: DataFrame, dosages: DataFrame) -> DataFrame:
    """(user_id, raw_id, chromosome, position, genotype) of samples whose dosages are hard calls; missing cells are left out."""
    d = dosages.filter("dosage is not null").join(panel, "variant_idx")
    g = render_genotype(F.col("ref_allele"), F.col("alt_allele"), F.col("dosage"))
    return d.select(F.col("sample_idx").alias("user_id"), F.col("variant_id").alias("raw_id"), "chromosome", "position", g.alias("genotype"))


def round_trip(model, panel: DataFrame, dosages: DataFrame, path: str, build: str | None = None) -> DataFrame:
    """One row, the greatest difference between scores of uploads and of the same uploads written as text and read back."""
    calls = as_uploads(panel, dosages)
    line = F.concat_ws("\t", "raw_id", "chromosome", "position", "genotype")
    calls.select(F.col("user_id").alias("user"), line.alias("value")).write.mode("overwrite").partitionBy("user").text(path)
    f = F.split("value", "\t")
    back = calls.sparkSession.read.option("basePath", path).text(path).select(F.col("user").cast("long").alias("user_id"), F.get(f, 0).alias("raw_id"), F.get(f, 1).alias("chromosome"), F.get(f, 2).cast("long").alias("position"), F.get(f, 3).alias("genotype"))
    a, b = (model.predict(c, build=build).select(F.col("user_id").cast("long").alias("user_id"), F.col("prs").alias(n)) for c, n in ((calls, "a"), (back, "b")))
    return a.join(b, "user_id").agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("max_difference"), F.count("*").cast("long").alias("n"))


def masking(model, panel: DataFrame, dosages: DataFrame, platform: DataFrame) -> DataFrame:
    """One row: agreement of masked estimates with full truth, the share of samples whose truth lies in the interval of their
    upload, and the mean standard error. Every sample is scored; only hard calls can be uploads."""
    masked = mask(panel, dosages, platform)
    scores = model.evaluate(panel, dosages).drop("estimate").join(model.panel_estimate(panel, masked), "sample_idx")
    p = model.predict(as_uploads(panel, masked))
    end = "_scaled" if "ci_lower_scaled" in p.columns else ""
    p = p.select(F.col("user_id").alias("sample_idx"), F.col(f"ci_lower{end}").alias("low"), F.col(f"ci_upper{end}").alias("high"), F.col(f"se{end}").alias("se"))
    inside = scores.join(p, "sample_idx").agg(F.avg(F.col("truth").between(F.col("low"), F.col("high")).cast("double")).alias("coverage"), F.avg("se").alias("mean_se"), F.count("*").cast("long").alias("n"))
    return metrics.agreement(scores).join(F.broadcast(inside))


def subsample(dosages: DataFrame, most: int | None, seed: int = 42) -> DataFrame:
    """The dosages of most samples at most, those whose seeded hash comes first."""
    if most is None:
        return dosages
    keep = dosages.select("sample_idx").distinct().orderBy(F.xxhash64(F.lit(seed), "sample_idx"), "sample_idx").limit(most)
    return dosages.join(keep, "sample_idx", "left_semi")


def report(model, panel: DataFrame, dosages: DataFrame, platform: DataFrame, path: str | None = None, max_samples: int | None = None, round_trip_samples: int = 50, ancestry: str | None = None, seed: int = 42) -> dict:
    """masking() as a dict, with the greatest difference of a text round trip where path is given and dosages are hard calls,
    and caveats: a panel without hard calls, an ancestry that is not the model's, a round trip beyond 1e-6."""
    dosages = subsample(dosages, max_samples, seed)
    hard = dosages.agg(F.bool_and(is_hard_call(F.col("dosage")))).first()[0]
    out, caveats = masking(model, panel, dosages, platform).first().asDict(), []
    if not hard:
        caveats.append("dosages are not hard calls, so uploads hold only those that are")
    elif path is not None:
        masked = mask(panel, subsample(dosages, round_trip_samples, seed), platform)
        out["round_trip"] = round_trip(model, panel, masked, path, model.info.get("build")).first().max_difference
        if (out["round_trip"] or 0) > 1e-6:
            caveats.append("uploads read back from text score otherwise")
    trained = model.info.get("ancestry")
    if ancestry and trained and ancestry != trained:
        caveats.append(f"the model was trained on {trained}, not {ancestry}")
    return out | {"caveats": caveats}


def write_upload(calls: DataFrame, path: str) -> None:
    """Calls as tab-delimited text with a comment and a header, a folder a user, as consumer genotype files have them."""
    head = calls.select("user_id").distinct().select("user_id", F.lit(0).alias("k"), F.explode(F.array(F.lit("# rsid, chromosome, position and genotype, by tabs"), F.lit("rsid\tchromosome\tposition\tgenotype"))).alias("value"))
    body = calls.select("user_id", F.lit(1).alias("k"), F.concat_ws("\t", "raw_id", F.coalesce("chromosome", F.lit("")), F.coalesce(F.col("position").cast("string"), F.lit("")), "genotype").alias("value"))
    head.union(body).repartition("user_id").sortWithinPartitions("user_id", "k").select(F.col("user_id").alias("user"), "value").write.mode("overwrite").partitionBy("user").text(path)
