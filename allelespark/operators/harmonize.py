"""Matching score variants to a chip and to a panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import complement, id_key, is_allele, is_ambiguous, locus_key, normalize_chromosome


def clean_score(raw: DataFrame) -> DataFrame:
    """raw with reason, null where the row is usable, and its cells normalised: positions and betas cast, alleles upper
    case, malformed other alleles null. Reasons in order: id, chromosome, position, beta, effect_allele."""
    d = raw.withColumns({
        "chromosome": normalize_chromosome(F.col("chromosome")), "position": F.expr("try_cast(position AS BIGINT)"), "beta": F.expr("try_cast(beta AS DOUBLE)"),
        "effect_allele": F.upper(F.trim("effect_allele")), "other_allele": F.when(is_allele(F.col("other_allele")), F.upper(F.trim("other_allele"))),
    })
    bad_chromosome = F.col("chromosome").isNull() | F.col("chromosome").isin("", "NAN", "NONE")
    reason = F.when(F.col("variant_id").isNull(), "id").when(bad_chromosome, "chromosome").when(F.col("position").isNull(), "position").when(F.col("beta").isNull() | F.isnan("beta"), "beta").when(~is_allele(F.col("effect_allele")), "effect_allele")
    return d.withColumn("reason", reason)


def dedup_score(prs: DataFrame) -> DataFrame:
    """One row of each identity (id, locus, alleles), the first; identities with more than one beta go altogether."""
    identity = ["variant_id", "chromosome", "position", "effect_allele", "other_allele"]
    w = Window.partitionBy(*identity)
    d = prs.withColumns({"low": F.min("beta").over(w), "high": F.max("beta").over(w), "rn": F.row_number().over(w.orderBy("prs_row"))})
    return d.filter("low = high and rn = 1").drop("low", "high", "rn")


def partition_by_platform(prs: DataFrame, platform: DataFrame) -> DataFrame:
    """prs with matched_by: rsid, chrpos or null (missing from the chip); the rsID is tried first."""
    keys = platform.select(id_key(F.col("id")).alias("key")).filter("key is not null").distinct()
    by_id, by_locus = keys.withColumn("by_id", F.lit(True)), keys.select(F.col("key").alias("locus"), F.lit(True).alias("by_locus"))
    d = prs.withColumns({"key": F.lower("variant_id"), "locus": locus_key(F.col("chromosome"), F.col("position"))})
    d = d.join(by_id, "key", "left").join(by_locus, "locus", "left")
    return d.withColumn("matched_by", F.when(F.col("by_id"), "rsid").when(F.col("by_locus"), "chrpos")).drop("key", "locus", "by_id", "by_locus")


def _orientation(e: Column, o: Column, ref: Column, alt: Column) -> Column:
    """1: the effect allele is counted by the dosage, -1: by two minus the dosage, null: neither."""
    none = o.isNull() | (o == "")
    return F.when((e == alt) & ((o == ref) | none), 1).when((e == ref) & ((o == alt) | none), -1)


def resolve_alleles(prs: DataFrame, panel: DataFrame) -> DataFrame:
    """prs with variant_idx, flip and way of the panel row that holds the effect allele: direct before complement, then in
    panel order. way: direct, flip, complement, complement_flip, allele_mismatch (a locus without fit), absent."""
    p = panel.select(locus_key(F.col("chromosome"), F.col("position")).alias("locus"), "variant_idx", "ref_allele", "alt_allele")
    d = prs.withColumn("locus", locus_key(F.col("chromosome"), F.col("position"))).join(p, "locus", "left")
    e, o, ref, alt = (F.col(c) for c in ("effect_allele", "other_allele", "ref_allele", "alt_allele"))
    direct, other = _orientation(e, o, ref, alt), _orientation(complement(e), complement(o), ref, alt)
    sign = F.coalesce(direct, other)
    way = F.when(direct == 1, "direct").when(direct == -1, "flip").when(other == 1, "complement").when(other == -1, "complement_flip").when(F.col("variant_idx").isNull(), "absent").otherwise("allele_mismatch")
    rank = F.when(direct.isNotNull(), 0).when(other.isNotNull(), 1).otherwise(2)
    best = F.min_by(F.struct(F.when(sign.isNotNull(), F.col("variant_idx")).alias("variant_idx"), (sign == -1).alias("flip"), way.alias("way")), F.struct(rank, F.col("variant_idx")))
    one = d.groupBy("prs_row").agg(best.alias("b"))
    return prs.join(one, "prs_row").select(prs["*"], "b.variant_idx", "b.flip", "b.way")


def drop_reasons(prs: DataFrame, panel: DataFrame) -> DataFrame:
    """(prs_row, reason) for what the panel can't place: contig_missing, not_in_reference or allele_mismatch."""
    contigs = panel.select(normalize_chromosome(F.col("chromosome")).alias("contig")).distinct().withColumn("known", F.lit(True))
    r = resolve_alleles(prs, panel).withColumn("contig", normalize_chromosome(F.col("chromosome"))).join(F.broadcast(contigs), "contig", "left")
    reason = F.when(F.col("known").isNull(), "contig_missing").when(F.col("way") == "absent", "not_in_reference").when(F.col("way") == "allele_mismatch", "allele_mismatch")
    return r.select("prs_row", reason.alias("reason")).filter("reason is not null")


def dispositions(prs: DataFrame, platform: DataFrame, panel: DataFrame) -> DataFrame:
    """(prs_row, variant_id, status, reason): observed on the chip, imputed where the panel places it, else dropped."""
    why = drop_reasons(prs, panel)
    d = partition_by_platform(prs, platform).join(why, "prs_row", "left")
    status = F.when(F.col("matched_by").isNotNull(), "observed").when(F.col("reason").isNull(), "imputed").otherwise("dropped")
    return d.select("prs_row", "variant_id", status.alias("status"), F.when(status == "dropped", F.col("reason")).alias("reason"))


def align_by_id(prs: DataFrame, panel: DataFrame) -> DataFrame:
    """prs rows found in the panel by id, else by locus (the last panel row of several), with variant_idx, flip, ambiguous and
    matched: the older rule, which looks at the effect allele, then at its complement, then at the other allele alone."""
    last = lambda key: panel.select("variant_idx", "ref_allele", "alt_allele", key.alias("k")).groupBy("k").agg(F.max_by(F.struct("variant_idx", "ref_allele", "alt_allele"), "variant_idx").alias("r"))
    by_id, by_locus = last(F.lower("variant_id")), last(locus_key(F.col("chromosome"), F.col("position")))
    d = prs.withColumns({"_id": F.lower("variant_id"), "_locus": locus_key(F.col("chromosome"), F.col("position"))})
    d = d.join(by_id.withColumnsRenamed({"k": "_id", "r": "_a"}), "_id", "left").join(by_locus.withColumnsRenamed({"k": "_locus", "r": "_b"}), "_locus", "left")
    d = d.withColumn("_r", F.coalesce("_a", "_b")).filter("_r is not null")
    e, o, ref, alt = F.upper("effect_allele"), F.upper("other_allele"), F.upper("_r.ref_allele"), F.upper("_r.alt_allele")
    turned = F.when(e == alt, False).when(e == ref, True).when(complement(e) == alt, False).when(complement(e) == ref, True).when(o == alt, True).when(o == ref, False)
    return d.select(*(prs[c] for c in prs.columns), F.col("_r.variant_idx").alias("variant_idx"), turned.alias("flip"), is_ambiguous(ref, alt).alias("ambiguous"), turned.isNotNull().alias("matched"))


def drop_examples(cleaned: DataFrame, most: int = 5) -> DataFrame:
    """(reason, n, examples) of clean_score(): how many rows go for each reason, and the first ids of them."""
    ids = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("prs_row", "variant_id"))), lambda x: x["variant_id"]), 1, most)
    bad = cleaned.filter("reason is not null")
    n = bad.groupBy("reason").agg(F.count("*").cast("long").alias("n"))
    first = bad.withColumn("_k", F.row_number().over(Window.partitionBy("reason").orderBy("prs_row"))).filter(F.col("_k") <= most).groupBy("reason").agg(ids.alias("examples"))
    return n.join(first, "reason")


def reference_variants(panel: DataFrame, chromosomes: list[str]) -> DataFrame:
    """Only the metadata of a panel's variants on some chromosomes, however these are spelt; no dosage is read."""
    want = [c.upper().removeprefix("CHR").replace("MT", "M") for c in chromosomes]
    meta = panel.select("variant_idx", "variant_id", "chromosome", "position", "ref_allele", "alt_allele")
    return meta.filter(normalize_chromosome(F.col("chromosome")).isin(*want))


def contig_spelling(panel: DataFrame) -> DataFrame:
    """(chromosome, spelling) of each normalised chromosome in a panel."""
    return panel.select(normalize_chromosome(F.col("chromosome")).alias("chromosome"), F.col("chromosome").alias("spelling")).distinct()


def check_fit_inputs(panel: DataFrame, dosages: DataFrame, prs: DataFrame) -> None:
    """ValueError if a table of fit_model() lacks a column, or a dosage is of a variant the panel doesn't have."""
    for what, d, names in (("panel", panel, ("variant_idx", "variant_id", "chromosome", "position", "ref_allele", "alt_allele")), ("dosages", dosages, ("sample_idx", "variant_idx", "dosage")), ("score", prs, ("prs_row", "variant_id", "chromosome", "position", "effect_allele", "other_allele", "beta"))):
        if missing := [n for n in names if n not in d.columns]:
            raise ValueError(f"the {what} lacks {', '.join(missing)}")
    if not dosages.select("variant_idx").distinct().join(panel.select("variant_idx"), "variant_idx", "left_anti").isEmpty():
        raise ValueError("dosages hold variants that the panel doesn't")
