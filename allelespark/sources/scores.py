"""Harmonised scoring files, cached score metadata and model documents."""

from __future__ import annotations

import json
import os
import re
import time
import urllib.error
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METADATA = (
    "id string, name string, trait_reported string, trait_efo array<struct<id: string, label: string>>, variants_number long, variants_genomebuild string, original_genome_build string, "
    "ftp_scoring_file string, ftp_harmonized_scoring_files map<string, struct<positions: string>>, publication struct<doi: string, PMID: string>, date_release string"
)
# Where public scoring files stand, the builds they are harmonised to and other names of these.
FILES = "https://ftp.ebi.ac.uk/pub/databases/spot/pgs/scores"
API = "https://www.pgscatalog.org/rest"
BUILDS = {"grch37": "GRCh37", "hg19": "GRCh37", "grch38": "GRCh38", "hg38": "GRCh38"}


def check_score_id(score_id: str) -> str:
    """The identifier in upper case; PGS and six digits."""
    if not re.fullmatch(r"PGS\d{6}", score_id.strip().upper()):
        raise ValueError(f"{score_id} is not PGS and six digits")
    return score_id.strip().upper()


def fetch(url: str, path: str, tries: int = 3, wait: float = 1.0, timeout: float = 30.0) -> str:
    """path, filled from url unless it exists; failures are tried again after wait, then twice that, and so on."""
    for k in range(tries):
        if os.path.exists(path):
            break
        try:
            with urllib.request.urlopen(url, timeout=timeout) as r, open(f"{path}.part", "wb") as f:
                while piece := r.read(1 << 20):
                    f.write(piece)
            os.replace(f"{path}.part", path)
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            if k == tries - 1:
                raise
            time.sleep(wait * 2**k)
    return path


def read_scoring_file(spark: SparkSession, path: str, filter_failed: bool = True) -> DataFrame:
    """prs_row, variant_id, chromosome, position, effect_allele, other_allele and beta, all strings but prs_row, of a
    tab-delimited scoring file with # comments, gzipped or not.

    Harmonised columns (hm_*) stand for the author's; rows whose harmonisation failed (hm_code below 0) go unless kept. If
    no row has an rsID, ids are chr:pos:effect.
    """
    d = spark.read.csv(path, sep="\t", header=True, comment="#", inferSchema=False)
    have = set(d.columns)
    if filter_failed and "hm_code" in have:
        d = d.filter(F.expr("try_cast(hm_code AS INT)") >= 0)
    pick = lambda *names: next((F.col(n) for n in names if n in have), F.lit(None).cast("string"))
    d = d.select(
        pick("hm_rsID", "rsID").alias("variant_id"), pick("hm_chr", "chr_name").alias("chromosome"), pick("hm_pos", "chr_position").alias("position"), pick("effect_allele").alias("effect_allele"),
        pick("hm_inferOtherAllele", "other_allele").alias("inferred"), pick("other_allele").alias("other_allele"), pick("effect_weight").alias("beta"),
    ).withColumn("other_allele", F.coalesce("other_allele", "inferred")).drop("inferred")
    if d.filter("variant_id is not null").isEmpty():
        d = d.withColumn("variant_id", F.concat_ws(":", "chromosome", "position", "effect_allele"))
    return d.select(F.monotonically_increasing_id().alias("prs_row"), "*")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A row for each cached metadata document (one JSON object a file): id, names, traits, builds, files and publication."""
    d = spark.read.schema(METADATA).option("multiLine", True).json(path)
    d = d.withColumns({"trait_efo": F.transform("trait_efo", lambda x: x["id"]), "harmonized_files": F.transform_values("ftp_harmonized_scoring_files", lambda k, v: v["positions"]), "publication_doi": F.col("publication.doi"), "publication_pmid": F.col("publication.PMID"), "genome_build": F.coalesce("original_genome_build", "variants_genomebuild")})
    return d.drop("ftp_harmonized_scoring_files", "publication", "original_genome_build")


def check_build(build: str) -> str:
    if build.strip().lower() not in BUILDS:
        raise ValueError(f"{build} is none of {', '.join(sorted(set(BUILDS.values())))}")
    return BUILDS[build.strip().lower()]


def scoring_file_path(score_id: str, build: str, cache: str) -> str:
    return os.path.join(cache, f"{check_score_id(score_id)}_{check_build(build)}.txt.gz")


def fetch_metadata(spark: SparkSession, score_id: str, cache: str) -> DataFrame:
    """The metadata row of a score, from cache or from the public service, whose answer is kept in cache."""
    i = check_score_id(score_id)
    os.makedirs(cache, exist_ok=True)
    return read_metadata(spark, fetch(f"{API}/score/{i}", os.path.join(cache, f"{i}_metadata.json")))


def download_score(spark: SparkSession, score_id: str, build: str = "GRCh37", cache: str = "scores", filter_failed: bool = True) -> tuple[DataFrame, DataFrame]:
    """The usable terms of a public score and (reason, n, examples) of the rest; the file is fetched unless cache has it."""
    from .readers import load_score

    i, b = check_score_id(score_id), check_build(build)
    os.makedirs(cache, exist_ok=True)
    path = fetch(f"{FILES}/{i}/ScoringFiles/Harmonized/{i}_hmPOS_{b}.txt.gz", scoring_file_path(i, b, cache))
    return load_score(read_scoring_file(spark, path, filter_failed))


def cache_info(cache: str) -> dict:
    """Where the cache is, how many files and bytes it holds and the scores they are of."""
    files = [f for f in os.scandir(cache) if f.is_file()] if os.path.isdir(cache) else []
    size = sum(f.stat().st_size for f in files)
    return {"path": cache, "n_files": len(files), "size_bytes": size, "size_mb": round(size / 2**20, 2), "scores": sorted({m[0] for f in files if (m := re.match(r"PGS\d{6}", f.name))})}


def clear_cache(cache: str, score_id: str | None = None) -> int:
    """Removes the cached files of one score or of all; how many went."""
    gone = 0
    for f in list(os.scandir(cache)) if os.path.isdir(cache) else []:
        if f.is_file() and re.match(r"PGS\d{6}", f.name) and (score_id is None or f.name.startswith(check_score_id(score_id))):
            os.remove(f.path)
            gone += 1
    return gone


def search(metadata: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """The first limit scores by id whose trait or name holds text, in any case."""
    low = text.strip().lower()
    return metadata.filter(F.contains(F.lower("trait_reported"), F.lit(low)) | F.contains(F.lower("name"), F.lit(low))).orderBy("id").limit(limit)


def _predictors(model, role: str) -> DataFrame:
    t = model.tables
    c = t["coefficients"].filter(F.col("role") == role).join(t["variants"].withColumnRenamed("variant_idx", "predictor_idx"), "predictor_idx")
    p = F.struct("predictor_idx", "variant_id", "chromosome", "position", F.col("alt_allele").alias("counted_allele"), F.col("ref_allele").alias("other_allele"), "allele_frequency", "coefficient")
    return c.groupBy("unit_id").agg(F.sort_array(F.collect_list(p)).alias("predictors"))


def write_document(model, path: str, variance: bool = True) -> int:
    """One JSON document of a model, and the number of bytes written.

    Rows come one partition at a time and are written as they come, so the driver never holds the model.
    """
    t = model.tables
    terms = t["dispositions"].select(F.col("prs_row").alias("unit_id"), "variant_id", "chromosome", "position", "effect_allele", "other_allele", "beta")
    measures = ["allele_frequency", F.col("cv_r2").alias("imputation_r2"), "intercept", F.col("intercept_only").alias("is_intercept_only"), *(["residual_variance"] if variance else [])]

    def models(role: str) -> DataFrame:
        m = t["models"].filter(F.col("role") == role).select("unit_id", *measures, "cv_mse", "target_variance").join(_predictors(model, role), "unit_id", "left")
        return m.withColumn("predictors", F.coalesce("predictors", F.array().cast(_predictors(model, role).schema["predictors"].dataType)))

    back = models("fallback").select("unit_id", F.struct(*(c for c in models("fallback").columns if c not in ("unit_id", "cv_mse", "target_variance"))).alias("fallback"))
    locus = F.concat_ws(":", "chromosome", "position")
    parts = {
        "observed_variants": t["observed"].select("*", F.array("variant_id", locus).alias("accepted_ids")).join(back, "unit_id", "left"),
        "imputed_variants": models("target").drop("cv_mse", "target_variance").join(terms, "unit_id"),
        "region_models": models("region"),
    }
    with open(path, "w") as f:
        f.write(json.dumps({"metadata": {"format_version": "2.0", **model.info}, "calibration_params": model.calibration})[:-1])
        for name, d in parts.items():
            f.write(f', "{name}": [')
            for i, r in enumerate(d.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator()):
                f.write((", " if i else "") + r.j)
            f.write("]")
        f.write("}")
    return os.path.getsize(path)


def read_document(spark: SparkSession, path: str):
    """The model of write_document(); dispositions hold what the document does: observed and modelled terms."""
    from ..model import ScoreModel

    pred = "array<struct<predictor_idx: bigint, variant_id: string, chromosome: string, position: bigint, counted_allele: string, other_allele: string, allele_frequency: double, coefficient: double>>"
    measure = f"allele_frequency: double, imputation_r2: double, intercept: double, is_intercept_only: boolean, residual_variance: double, predictors: {pred}"
    term = "unit_id: bigint, variant_id: string, chromosome: string, position: bigint, effect_allele: string, other_allele: string, beta: double"
    schema = f"metadata map<string, string>, calibration_params map<string, double>, observed_variants array<struct<{term}, fallback: struct<{measure}>>>, imputed_variants array<struct<{term}, {measure}>>, region_models array<struct<unit_id: bigint, {measure}, cv_mse: double, target_variance: double>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    seen, own, region = (doc.select(F.inline(c)) for c in ("observed_variants", "imputed_variants", "region_models"))
    back = seen.filter("fallback is not null").select("unit_id", "beta", "fallback.*")

    def rows(d: DataFrame, role: str) -> DataFrame:
        extra = {c: F.lit(None).cast("double") for c in ("cv_mse", "target_variance", "beta") if c not in d.columns}
        return d.withColumns(extra | {"role": F.lit(role)}) if extra else d.withColumn("role", F.lit(role))

    columns = ["unit_id", "role", "intercept", "beta", "cv_mse", "imputation_r2", "is_intercept_only", "allele_frequency", "residual_variance", "target_variance", "predictors"]
    m = rows(own, "target").select(columns).unionByName(rows(back, "fallback").select(columns)).unionByName(rows(region, "region").select(columns))
    models = m.withColumn("n_predictors", F.size("predictors")).drop("predictors").withColumnsRenamed({"imputation_r2": "cv_r2", "is_intercept_only": "intercept_only"}).withColumn("beta", F.coalesce("beta", F.lit(1.0)))
    p = m.select("unit_id", "role", F.explode("predictors").alias("p")).select("unit_id", "role", "p.*")
    variants = p.select(F.col("predictor_idx").alias("variant_idx"), "variant_id", "chromosome", "position", F.col("other_allele").alias("ref_allele"), F.col("counted_allele").alias("alt_allele"), "allele_frequency").distinct()
    observed = seen.drop("fallback")
    names = ["unit_id", "variant_id", "chromosome", "position", "effect_allele", "other_allele", "beta"]
    status = F.when(F.col("is_intercept_only"), "intercept_only").otherwise("imputed")
    d = observed.select(*names, F.lit("observed").alias("status")).unionByName(own.select(*names, status.alias("status"))).withColumnRenamed("unit_id", "prs_row").withColumn("reason", F.lit(None).cast("string"))
    head = doc.select("metadata", "calibration_params").first()
    tables = {"observed": observed, "models": models, "coefficients": p.select("unit_id", "role", "predictor_idx", "coefficient"), "variants": variants, "dispositions": d}
    return ScoreModel(tables, dict(head.calibration_params or {}), {k: v for k, v in (head.metadata or {}).items() if k != "format_version"})
