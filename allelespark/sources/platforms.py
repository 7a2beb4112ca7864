"""Chips: those that have a name, and sets of variants by list, manifest or cluster table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import id_kind


@dataclass(frozen=True)
class Platform:
    name: str
    company: str
    version: str
    technology: str
    introduced: str
    n_variants: int
    cluster: str
    build: str = "GRCh37"


# Chips with a name, and the code of each in the public table of chip clusters.
PLATFORMS = {
    p.name: p
    for p in (
        Platform("23andme_v3", "23andMe", "3", "Illumina OmniExpress Plus", "2010-12", 961811, "c4"),
        Platform("23andme_v4", "23andMe", "4", "Illumina HTS iSelect HD", "2013-12", 598426, "c1"),
        Platform("23andme_v5", "23andMe", "5", "Illumina Global Screening Array", "2017-08", 635991, "v5"),
        Platform("ancestrydna_v1", "Ancestry", "1", "Illumina OmniExpress", "2012-05", 728909, "c3"),
        Platform("ancestrydna_v2", "Ancestry", "2", "Illumina OmniExpress Plus", "2016-05", 804680, "c5"),
    )
}


def available() -> list[str]:
    return sorted(PLATFORMS)


def platform_info(name: str) -> Platform:
    """The chip of a name, whatever its case; ValueError for a name that none has."""
    key = name.strip().lower()
    if key not in PLATFORMS:
        raise ValueError(f"{name} is no platform; there are {', '.join(available())}")
    return PLATFORMS[key]


def valid_ids(ids: DataFrame, what: str = "the platform") -> DataFrame:
    """Distinct ids that are an rsID or a locus; ValueError if there is none."""
    out = ids.select(F.trim("id").alias("id")).filter(id_kind(F.col("id")) != "invalid").distinct()
    if out.isEmpty():
        raise ValueError(f"{what} has no valid variant id")
    return out


def from_list(spark: SparkSession, variants: list[str]) -> DataFrame:
    return valid_ids(spark.createDataFrame([(str(v),) for v in variants], "id string"), "the list")


def from_clusters(clusters: DataFrame, name: str) -> DataFrame:
    """The loci of a chip in a table clusters(chrom, pos, clusters), whose last column lists codes with commas."""
    code = platform_info(name).cluster
    hit = clusters.filter(F.array_contains(F.split("clusters", ","), code))
    return valid_ids(hit.select(F.concat_ws(":", F.col("chrom").cast("string"), F.col("pos").cast("string")).alias("id")), name)


def resolve(spark: SparkSession, name: str | None = None, manifest: str | None = None, variants: list[str] | None = None, clusters: DataFrame | None = None, folder: str | None = None) -> DataFrame:
    """A chip's ids from exactly one source. A named chip's come from folder/name_variants.txt(.gz) or from a cluster table."""
    from . import readers

    if sum(x is not None for x in (name, manifest, variants)) != 1:
        raise ValueError("give exactly one of a platform's name, a manifest and a list of variants")
    if manifest is not None:
        return readers.read_manifest(spark, manifest)
    if variants is not None:
        return from_list(spark, variants)
    p = platform_info(name)
    if clusters is not None:
        return from_clusters(clusters, p.name)
    if folder is None:
        raise ValueError(f"{p.name} needs a folder of variant lists or a table of chip clusters")
    return readers.read_manifest(spark, f"{folder}/{p.name}_variants.txt.gz")
