"""Text readers: VCF panels, score files, chip manifests and personal genotype uploads."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import locus_key, normalize_build, normalize_chromosome
from ..operators import harmonize
from . import bgzf, platforms

# Column names that score files and uploads use, by the name they get here; the name itself goes first.
SCORE_ALIASES = {
    "variant_id": ("variant_id", "rsid", "snp", "snp_id", "variant", "id", "marker", "markername"),
    "chromosome": ("chromosome", "chr", "chrom", "#chrom", "chr_name"),
    "position": ("position", "pos", "bp", "chr_position", "base_pair_location"),
    "effect_allele": ("effect_allele", "allele1", "a1", "alt", "effect", "ea", "risk_allele"),
    "other_allele": ("other_allele", "allele2", "a2", "ref", "non_effect_allele", "nea", "reference_allele"),
    "beta": ("beta", "effect_weight", "weight", "effect_size", "log_or"),
    "genome_build": ("genome_build", "build", "assembly", "genome_assembly"),
}
REQUIRED = ("variant_id", "chromosome", "position", "effect_allele", "beta")
BUILDS = ("GRCh37", "GRCh38")
DOSAGE_FIELDS = ("DS", "GT", "GP")


def parse_region(region: str) -> tuple[str, int, int]:
    """(contig, first, last) of contig, contig:first-last or with either end left out; both ends are inside."""
    contig, _, span = region.partition(":")
    first, _, last = span.partition("-")
    return contig, int(first or 0), int(last or 1 << 62)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a text file as value; block-gzipped files (.bgz, .vcf.gz with block headers) are split into many tasks."""
    return bgzf.read_lines(spark, path) if path.endswith((".gz", ".bgz")) and bgzf.is_blocked(path) else spark.read.text(path)


def matches_ids(variant_ids: list[str], variant_id: Column, chromosome: Column, position: Column) -> Column:
    """Whether a variant is named by an rsID, whatever its case, or by its locus; everything matches an empty list."""
    if not variant_ids:
        return F.lit(True)
    loci, names = set(), set()
    for v in variant_ids:
        parts = v.split(":")
        if len(parts) >= 2 and not v.lower().startswith("rs"):
            c = parts[0].upper().removeprefix("CHR")
            loci.add(f"{'M' if c == 'MT' else c}:{parts[1]}")
        else:
            names.add(v.lower())
    return F.lower(variant_id).isin(*names) | locus_key(chromosome, position).isin(*loci)


def read_vcf(spark: SparkSession, path: str, region: tuple[str, int, int] | str | None = None, samples: list[str] | None = None, variant_ids: list[str] | None = None, dosage_field: str = "auto") -> tuple[DataFrame, list[str]]:
    """A panel (variant_id, chromosome, position, ref_allele, alt_allele, dosage array<float>) and its sample ids.

    One row for each alternate allele. A record with one takes its dosages from one field: the first of DS, GT and GP that
    its FORMAT has, or dosage_field; a record with several counts each allele in GT. What isn't called is null, a record
    without the field is left out. Regions are told from the first two columns before the samples are split; id and sample
    filters and an unknown contig or sample are checked first. Chromosomes are normalised.
    """
    if dosage_field != "auto" and dosage_field.upper() not in DOSAGE_FIELDS:
        raise ValueError(f"{dosage_field} is none of auto, {', '.join(DOSAGE_FIELDS)}")
    lines = text_lines(spark, path)
    head = lines.filter(F.col("value").startswith("#CHROM")).first()
    if head is None:
        raise ValueError(f"{path} has no #CHROM line")
    names = head[0].rstrip("\r").split("\t")[9:]
    if not names:
        raise ValueError(f"{path} has no samples")
    keep = list(range(len(names)))
    if samples is not None:
        if missing := set(samples) - set(names):
            raise ValueError(f"{path} lacks {', '.join(sorted(missing))}")
        keep = [i for i, s in enumerate(names) if s in set(samples)]
    body = lines.filter(~F.col("value").startswith("#") & (F.col("value") != ""))
    if region:
        contig, first, last = parse_region(region) if isinstance(region, str) else region
        at = F.substring_index(F.substring_index("value", "\t", 2), "\t", -1).try_cast("long")
        body = body.filter(F.col("value").startswith(f"{contig}\t"))
        if body.isEmpty():
            raise ValueError(f"{path} has no contig {contig}")
        body = body.filter(at.between(first, last))
    f = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    d = body.select(f.alias("f")).select(name_of(F.col("f")).alias("variant_id"), normalize_chromosome(F.get("f", F.lit(0))).alias("chromosome"), F.get("f", F.lit(1)).cast("long").alias("position"), F.get("f", F.lit(3)).alias("ref_allele"), F.split(F.get("f", F.lit(4)), ",").alias("alts"), F.split(F.get("f", F.lit(8)), ":").alias("format"), F.slice("f", 10, len(names)).alias("cells"))
    if variant_ids is not None:
        d = d.filter(matches_ids(variant_ids, F.col("variant_id"), F.col("chromosome"), F.col("position")))
        if d.isEmpty():
            raise ValueError(f"{path} has none of the variants asked for")
    if len(keep) < len(names):
        d = d.withColumn("cells", F.transform(F.array(*map(F.lit, keep)), lambda i: F.get("cells", i)))
    place = {n: F.array_position("format", n) for n in DOSAGE_FIELDS}
    many = F.size("alts") > 1
    order = DOSAGE_FIELDS if dosage_field == "auto" else (dosage_field.upper(),)
    field = F.coalesce(*(F.when(place[n] > 0, n) for n in order))
    d = d.withColumn("field", F.when(many, F.when(place["GT"] > 0, "GT")).otherwise(field)).filter("field is not null")
    d = d.withColumn("at", (F.array_position("format", F.col("field")) - 1).cast("int")).select("*", F.posexplode("alts").alias("k", "alt"))

    def dosage(cell: Column) -> Column:
        text = F.get(F.split(cell, ":"), F.col("at"))
        ds = F.get(F.split(text, ","), F.lit(0)).try_cast("float")
        calls = F.slice(F.split(text, "[/|]"), 1, 2)
        gt = F.when((F.size(calls) == 2) & F.forall(calls, lambda c: c.rlike(r"^\d+$")), F.size(F.filter(calls, lambda c: c.try_cast("int") == F.col("k") + 1)).cast("float"))
        gp = F.transform(F.split(text, ","), lambda x: x.try_cast("float"))
        prob = F.when((F.size(gp) >= 3) & F.forall(gp, lambda x: x >= 0), F.get(gp, 1) + 2 * F.get(gp, 2)).cast("float")
        return F.when(F.col("field") == "DS", F.when(ds >= 0, ds)).when(F.col("field") == "GT", gt).otherwise(prob)

    alt = F.when(F.col("alt") != ".", F.col("alt"))
    return d.select("variant_id", "chromosome", "position", "ref_allele", alt.alias("alt_allele"), F.transform("cells", dosage).alias("dosage")), [names[i] for i in keep]


def name_of(f: Column) -> Column:
    """A record's id, chromosome:position where it has none."""
    i = F.get(f, F.lit(2))
    return F.when(i.isNull() | i.isin(".", ""), F.concat_ws(":", normalize_chromosome(F.get(f, F.lit(0))), F.get(f, F.lit(1)))).otherwise(i)


def missing_rate(panel: DataFrame) -> DataFrame:
    """One row: variants, cells and the share of missing ones of a panel with dosage arrays."""
    gone = F.sum(F.size(F.filter("dosage", lambda x: x.isNull())))
    cells = F.sum(F.size("dosage"))
    return panel.agg(F.count("*").cast("long").alias("n_variants"), cells.cast("long").alias("n_cells"), F.try_divide(gone, cells).alias("missing"))


def genotype_format(path: str, exists=os.path.exists) -> str:
    """vcf, plink or pgen by the suffix of a path, or by the files that stand at a prefix."""
    low = path.lower()
    if low.endswith((".vcf", ".vcf.gz", ".vcf.bgz")):
        return "vcf"
    if low.endswith(".bcf"):
        raise ValueError(f"{path} is a BCF; convert it to a block-gzipped VCF")
    for kind, suffixes in (("plink", (".bed", ".bim", ".fam")), ("pgen", (".pgen", ".pvar", ".psam"))):
        if low.endswith(suffixes) or all(exists(path + s) for s in suffixes):
            return kind
    raise ValueError(f"{path} is no VCF, PLINK1 or PLINK2 fileset")


def load_genotypes(spark: SparkSession, path: str, variant_ids: list[str] | None = None, samples: list[str] | None = None, region: tuple[str, int, int] | str | None = None, dosage_field: str = "auto") -> tuple[DataFrame, list[str]]:
    """A panel and its sample ids from a file or fileset of any format."""
    from . import pgen, plink

    kind, where = genotype_format(path), parse_region(region) if isinstance(region, str) else region
    if kind == "vcf":
        return read_vcf(spark, path, where, samples, variant_ids, dosage_field)
    prefix = re.sub(r"\.(bed|bim|fam|pgen|pvar|psam)$", "", path)
    return (plink.read_plink if kind == "plink" else pgen.read_pgen)(spark, prefix, where, samples, variant_ids)


def in_memory(panel: DataFrame, samples: list[str], keep: list[str] | None = None, region: tuple[str, int, int] | str | None = None, variant_ids: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """A panel at hand like a file's: its samples, region and ids filtered, in order of chromosome and position within tasks."""
    if keep is not None:
        if missing := set(keep) - set(samples):
            raise ValueError(f"the panel lacks {', '.join(sorted(missing))}")
        at = [i for i, s in enumerate(samples) if s in set(keep)]
        panel, samples = panel.withColumn("dosage", F.transform(F.array(*map(F.lit, at)), lambda i: F.get("dosage", i))), [samples[i] for i in at]
    if region:
        contig, first, last = parse_region(region) if isinstance(region, str) else region
        panel = panel.filter((normalize_chromosome(F.col("chromosome")) == normalize_chromosome(F.lit(contig))) & F.col("position").between(first, last))
    if variant_ids is not None:
        panel = panel.filter(matches_ids(variant_ids, F.col("variant_id"), F.col("chromosome"), F.col("position")))
    return panel.repartitionByRange("chromosome", "position").sortWithinPartitions("chromosome", "position"), samples


def sample_chunks(panel: DataFrame, samples: list[str], size: int) -> Iterator[tuple[DataFrame, list[str]]]:
    """The panel cut by samples, size at a time; each is a projection of the same plan."""
    for i in range(0, len(samples), size):
        yield panel.withColumn("dosage", F.slice("dosage", i + 1, size)), samples[i : i + size]


def long_panel(panel: DataFrame) -> DataFrame:
    """(variant_id, sample_idx, dosage) of a panel with dosage arrays."""
    return panel.select("variant_id", F.posexplode("dosage").alias("sample_idx", "dosage"))


def sniff(line: str | None) -> str:
    """The delimiter of a table's first line: tab, comma, semicolon or space, whichever parts it most; a comma without a line."""
    if line is None:
        return ","
    best = max("\t,;", key=lambda s: len(line.split(s)))
    return best if best in line else " "


def _delimited(spark: SparkSession, path: str) -> DataFrame:
    """A table of strings with a header, # comments left out; runs of blanks count as one where blanks part the columns."""
    lines = text_lines(spark, path).filter((~F.col("value").startswith("#") | F.lower("value").startswith("#chrom")) & (F.trim("value") != ""))
    first = lines.first()
    if first is None:
        raise ValueError(f"{path} has no header")
    sep = sniff(first[0])
    if sep != " " and not first[0].startswith("#") and not path.endswith(".bgz"):
        return spark.read.csv(path, sep=sep, header=True, comment="#", inferSchema=False, ignoreLeadingWhiteSpace=True)
    names = first[0].split() if sep == " " else first[0].split(sep)
    f = F.split(F.trim("value"), r"\s+" if sep == " " else sep)
    return lines.filter(F.col("value") != first[0]).select(*(F.trim(F.get(f, F.lit(i))).alias(n.strip()) for i, n in enumerate(names)))


def read_score(spark: SparkSession, path: str, allow_alt_as_effect: bool = False) -> DataFrame:
    """A score with the names of SCORE_ALIASES, all strings but prs_row; ALT as effect allele only if allowed."""
    return name_score(_delimited(spark, path), path, allow_alt_as_effect)


def name_score(d: DataFrame, what: str = "the score", allow_alt_as_effect: bool = False) -> DataFrame:
    """d's columns by the first of their aliases, whatever their case; what is required and missing raises ValueError, and so does
    a genome_build that is no known build."""
    by_name = {c.lower().strip(): c for c in reversed(d.columns)}
    found = {k: next(by_name[a] for a in aliases if a in by_name) for k, aliases in SCORE_ALIASES.items() if any(a in by_name for a in aliases)}
    if found.get("effect_allele", "").lower().strip() == "alt" and not allow_alt_as_effect:
        raise ValueError("ALT is not taken as the effect allele unless allowed")
    if missing := [k for k in REQUIRED if k not in found]:
        raise ValueError(f"{what} lacks {', '.join(missing)}")
    out = d.select(F.monotonically_increasing_id().alias("prs_row"), *(F.col(f"`{c}`").cast("string").alias(k) for k, c in found.items()))
    if "genome_build" in found:
        out = out.withColumn("genome_build", normalize_build(F.col("genome_build")))
        if bad := [r[0] for r in out.filter(F.col("genome_build").isNotNull() & ~F.col("genome_build").isin(*BUILDS)).select("genome_build").distinct().limit(5).collect()]:
            raise ValueError(f"{', '.join(sorted(bad))} is no known genome build")
    return out


def load_score(raw: DataFrame, allow_alt_as_effect: bool = False) -> tuple[DataFrame, DataFrame]:
    """The usable terms of a raw table of strings, named, cleaned and without duplicates, and (reason, n, examples) of the
    rows that went."""
    named = name_score(raw, allow_alt_as_effect=allow_alt_as_effect) if "prs_row" not in raw.columns else raw
    if "other_allele" not in named.columns:
        named = named.withColumn("other_allele", F.lit(None).cast("string"))
    cleaned = harmonize.clean_score(named)
    return harmonize.dedup_score(cleaned.filter("reason is null").drop("reason")), harmonize.drop_examples(cleaned)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Distinct valid chip ids: one a line, or the id column of a delimited table, the first column if none is named like one."""
    lines = text_lines(spark, path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    first = lines.first()
    if first is not None and ("," in first[0] or "\t" in first[0]):
        d = _delimited(spark, path)
        column = next((c for c in d.columns if c.lower().strip() in ID_COLUMNS), d.columns[0])
        ids = d.select(F.trim(F.col(f"`{column}`")).alias("id"))
    else:
        ids = lines.select(F.trim("value").alias("id"))
    return platforms.valid_ids(ids, path)


# What a manifest's and an upload's columns are called.
ID_COLUMNS = ("rsid", "variant_id", "snp", "name", "id")
UPLOAD_COLUMNS = {"raw_id": ("rsid", "variant_id", "snp", "name", "id", "raw_id"), "chromosome": ("chrom", "chromosome", "chr"), "position": ("pos", "position", "build_37_position"), "genotype": ("genotype", "result", "alleles", "call")}


def read_upload(spark: SparkSession, path: str, user_id: str) -> DataFrame:
    """(user_id, raw_id, chromosome, position, genotype) of an upload with # comments, parted by tabs, commas or blanks, its
    cells quoted or not, with one genotype column or one for each allele; by the header's names, else by place."""
    clean = text_lines(spark, path).select(F.translate(F.regexp_replace("value", "\r$", ""), '"', "").alias("value")).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    first = clean.first()
    if first is None:
        raise ValueError(f"{path} holds no genotypes")
    sep = sniff(first[0])
    names = [n.strip().lower() for n in (first[0].split() if sep == " " else first[0].split(sep))]
    headed = any(n in UPLOAD_COLUMNS["raw_id"] for n in names)
    f = F.split("value", r"\s+" if sep == " " else sep)
    at = {k: next((names.index(a) for a in aliases if a in names), None) if headed else i for i, (k, aliases) in enumerate(UPLOAD_COLUMNS.items())}
    pair = [names.index(n) for n in ("allele1", "allele2") if n in names] if headed else ([3, 4] if len(names) >= 5 else [])
    cell = lambda i: F.trim(F.get(f, F.lit(i))) if i is not None else F.lit(None).cast("string")
    genotype = F.concat(cell(pair[0]), cell(pair[1])) if len(pair) == 2 else cell(at["genotype"])
    d = clean.filter(F.col("value") != first[0]) if headed else clean
    return raw_records(d.select(F.lit(user_id).alias("user_id"), cell(at["raw_id"]).alias("raw_id"), cell(at["chromosome"]).alias("chromosome"), cell(at["position"]).alias("position"), genotype.alias("genotype")))


def raw_records(d: DataFrame) -> DataFrame:
    """Calls with their cells as they should be: blank and nan cells null, whole positions, a genotype that is missing as --."""
    text = lambda c: F.when(~F.lower(F.trim(F.col(c).cast("string"))).isin("", "nan", "none"), F.trim(F.col(c).cast("string")))
    return d.select("user_id", F.coalesce(text("raw_id"), F.lit("")).alias("raw_id"), text("chromosome").alias("chromosome"), text("position").try_cast("double").cast("long").alias("position"), F.coalesce(text("genotype"), F.lit("--")).alias("genotype"))


def uploads_of(table: DataFrame, user_id: str | None = None) -> DataFrame:
    """Calls of a table by the synonyms of UPLOAD_COLUMNS; its users by a user_id column or the one given."""
    by_name = {c.lower(): c for c in table.columns}
    pick = {k: next((by_name[a] for a in aliases if a in by_name), None) for k, aliases in UPLOAD_COLUMNS.items()}
    if pick["genotype"] is None or pick["raw_id"] is None:
        raise ValueError("an upload needs a genotype column and one of ids")
    if user_id is None and "user_id" not in by_name:
        raise ValueError("whose upload is it? user_id is missing")
    users = F.col(by_name["user_id"]) if user_id is None else F.lit(user_id)
    return raw_records(table.select(users.alias("user_id"), *((F.col(f"`{c}`") if c else F.lit(None)).cast("string").alias(k) for k, c in pick.items())))


def genotype_strings(calls: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """(user_id, raw_id, genotype), one a user and id, the last by chromosome, position and genotype; expected(variant_id)
    keeps those ids only."""
    last = F.max_by("genotype", F.struct(F.coalesce("chromosome", F.lit("")), F.coalesce("position", F.lit(-1)), "genotype"))
    d = calls.join(expected.select(F.col("variant_id").alias("raw_id")).distinct(), "raw_id", "left_semi") if expected is not None else calls
    return d.groupBy("user_id", "raw_id").agg(last.alias("genotype"))


def detect_build(spark: SparkSession, path: str) -> str | None:
    """The build that an upload's comments name, None if they name none or two."""
    notes = [r[0].lower() for r in text_lines(spark, path).filter(F.col("value").startswith("#")).limit(200).collect()]
    found = {b for n in notes for b, names in (("GRCh37", ("build 37", "build37", "grch37", "hg19", "b37")), ("GRCh38", ("build 38", "build38", "grch38", "hg38", "b38"))) if any(x in n for x in names)}
    return found.pop() if len(found) == 1 else None
