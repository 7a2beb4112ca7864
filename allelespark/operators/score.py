"""Scores of panels and of uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clip_dosage, count_called, genotype_group, hardy_weinberg_variance, id_key, locus_key, parse_genotype, zygosity_dosage
from ..functions.sizes import small


def panel_score(dosages: DataFrame, resolved: DataFrame) -> DataFrame:
    """(sample_idx, score, n_used): sum of beta times oriented dosage over resolved(variant_idx, flip, beta); missing is 0.

    resolved has a row a score term and joins before one aggregation with map-side sums."""
    r = resolved.filter("variant_idx is not null").select("variant_idx", "flip", "beta")
    oriented = F.when(F.col("flip"), 2 - F.col("dosage")).otherwise(F.col("dosage"))
    return dosages.join(small(r), "variant_idx").groupBy("sample_idx").agg(F.sum(F.coalesce(oriented * F.col("beta"), F.lit(0.0))).alias("score"), F.count(oriented).cast("long").alias("n_used"))


def _keys(*keys: tuple[int, Column]) -> Column:
    """The keys as (way, key) rows; null ones meet nothing."""
    return F.explode(F.array(*(F.struct(F.lit(w).alias("way"), k.alias("key")) for w, k in keys)))


def _matched(calls: DataFrame, terms: DataFrame) -> DataFrame:
    """A row for each call and term it could be of: the user, the term's columns, genotype, its alleles first and second, hashes
    of genotype and locus, and the way, 0 by id and 1 by locus. Calls are parsed once, before they are matched. The keys of
    the terms are broadcast where they are few, so that calls stay where they are."""
    locus = F.when(F.col("chromosome").isNotNull() & F.col("position").isNotNull(), locus_key(F.col("chromosome"), F.col("position")))
    alleles = parse_genotype(F.col("genotype"))
    c = calls.select("user_id", "raw_id", "genotype", locus.alias("locus"), alleles.alias("alleles"), F.xxhash64(genotype_group(F.col("genotype"))).alias("_g"))
    parsed = (F.get("alleles", F.lit(0)).alias("first"), F.get("alleles", F.lit(1)).alias("second"), F.when(F.col("locus").isNotNull(), F.xxhash64("locus")).alias("_l"))
    c = c.select("user_id", "genotype", "_g", *parsed, _keys((0, F.lower("raw_id")), (1, F.col("locus"))).alias("k")).select("user_id", "genotype", "_g", "first", "second", "_l", "k.*")
    by_id = F.when(F.contains("variant_id", F.lit(":")), id_key(F.col("variant_id")))
    own = [x for x in ("effect_allele", "other_allele") if x in terms.columns]
    full = F.lower(F.concat_ws(":", locus, "other_allele", "effect_allele")) if len(own) == 2 else F.lit(None).cast("string")
    t = terms.select("prs_row", *own, _keys((0, F.lower("variant_id")), (0, full), (1, locus), (1, by_id)).alias("k")).select("prs_row", *own, "k.*").filter("key is not null").distinct()
    return c.join(small(t), ["way", "key"])


def _decided(matched: DataFrame, value: Column, name: str) -> DataFrame:
    """(user_id, prs_row, same, name): of each user and term whether the calls of the way chosen agree in alleles and locus, and
    if so the least value. Alleles and loci are compared by 64-bit hashes, so that the sums stay in fixed-width rows."""
    d = matched.select("user_id", "prs_row", "way", "_g", "_l", value.alias("_v"))
    ways = []
    for w in (0, 1):
        here = F.col("way") == w
        only = lambda f, c: f(F.when(here, F.col(c)))  # noqa: B023, E731
        same = (only(F.min, "_g") == only(F.max, "_g")) & F.coalesce(only(F.min, "_l") == only(F.max, "_l"), F.lit(True))
        ways.append((F.count(F.when(here, 1)) > 0, same, only(F.min, "_v")))
    (first, s0, v0), (_, s1, v1) = ways
    d = d.groupBy("user_id", "prs_row").agg(F.when(first, s0).otherwise(s1).alias("same"), F.when(first, v0).otherwise(v1).alias(name))
    return d.withColumn(name, F.when(F.col("same"), F.col(name)))


def resolve_uploads(calls: DataFrame, terms: DataFrame, every: bool = False) -> DataFrame:
    """(user_id, prs_row, status, genotype) of users and terms(prs_row, variant_id, chromosome, position and, if known,
    effect_allele and other_allele).

    A call whose id is the term's variant_id or chromosome:position:other:effect goes before calls at the term's locus.
    Calls of the way chosen that differ in their alleles (AG, GA and A/G don't) or in their locus, where both have one, are a
    duplicate_conflict. Without every, pairs without a call are left out; with it they are not_found, a row for each user
    and term.
    """
    found = _decided(_matched(calls, terms), F.col("genotype"), "genotype").select("user_id", "prs_row", F.when(F.col("same"), "resolved").otherwise("duplicate_conflict").alias("status"), "genotype")
    if not every:
        return found
    grid = calls.select("user_id").distinct().crossJoin(small(terms.select("prs_row").distinct()))
    return grid.join(found, ["user_id", "prs_row"], "left").select("user_id", "prs_row", F.coalesce("status", F.lit("not_found")).alias("status"), "genotype")


def counted_effects(calls: DataFrame, terms: DataFrame, allow_ambiguous: bool = True) -> DataFrame:
    """(user_id, prs_row, n): how often each user has the effect allele of terms(prs_row, variant_id, chromosome, position,
    effect_allele, other_allele); what isn't found, conflicts, isn't called or doesn't fit has no row."""
    n = count_called(F.col("first"), F.col("second"), F.col("effect_allele"), F.col("other_allele"), allow_ambiguous=allow_ambiguous)
    return _decided(_matched(calls, terms.filter("other_allele is not null")), n, "n").filter("n is not null").select("user_id", "prs_row", "n")


def upload_scores(calls: DataFrame, terms: DataFrame, allow_ambiguous: bool = True) -> DataFrame:
    """(user_id, score, n_used, n_unresolved) of every user with a call; what isn't found, conflicts, isn't called, doesn't
    fit or has no other allele is unresolved, counted without a row for each user and term."""
    r = counted_effects(calls, terms, allow_ambiguous).join(small(terms.select("prs_row", "beta")), "prs_row")
    own = r.groupBy("user_id").agg(F.sum(F.col("n") * F.col("beta")).alias("score"), F.count("n").cast("long").alias("n_used"))
    d = calls.select("user_id").distinct().join(own, "user_id", "left").join(F.broadcast(terms.agg(F.count("*").cast("long").alias("n_terms"))))
    used = F.coalesce("n_used", F.lit(0).cast("long"))
    return d.select("user_id", F.coalesce("score", F.lit(0.0)).alias("score"), used.alias("n_used"), (F.col("n_terms") - used).alias("n_unresolved"))


def legacy_dosages(calls: DataFrame) -> DataFrame:
    """(user_id, variant_id, dosage): copies by zygosity, whichever allele they are of; of several calls of an id the one that
    sorts last by chromosome, position and genotype stands."""
    last = F.max_by("genotype", F.struct(F.coalesce("chromosome", F.lit("")), F.coalesce("position", F.lit(-1)), F.coalesce("genotype", F.lit(""))))
    return calls.groupBy("user_id", F.col("raw_id").alias("variant_id")).agg(last.alias("g")).select("user_id", "variant_id", zygosity_dosage(F.col("g")).alias("dosage"))


def legacy_observed(dosages: DataFrame, terms: DataFrame) -> DataFrame:
    """(user_id, score, n_used) over terms(variant_id, beta) whose id has a dosage."""
    d = dosages.filter("dosage is not null").join(terms.select("variant_id", "beta"), "variant_id")
    d = d.groupBy("user_id").agg(F.sum(F.col("dosage") * F.col("beta")).alias("score"), F.count("*").cast("long").alias("n_used"))
    return dosages.select("user_id").distinct().join(d, "user_id", "left").na.fill({"score": 0.0, "n_used": 0})


def legacy_imputed(dosages: DataFrame, models: DataFrame, coefficients: DataFrame) -> DataFrame:
    """(user_id, score, variance, n_truncated, n_models) over models(unit_id, intercept, beta, residual_variance,
    allele_frequency) and coefficients(unit_id, variant_id, coefficient), all or nothing: a model of which any predictor is
    missing predicts its intercept with the variance of the allele frequency. Sums at the intercept are formed once."""
    from .predict import truncated_variance

    full = coefficients.groupBy("unit_id").agg(F.count("*").alias("p"))
    m = models.join(full, "unit_id", "left").withColumn("p", F.coalesce("p", F.lit(0)))

    def term(d: DataFrame, raw: Column, var: Column) -> DataFrame:
        d = d.withColumns({"_r": raw, "_v": var})
        return d.withColumns({"term": clip_dosage(F.col("_r")) * F.col("beta"), "var": F.col("beta") ** 2 * truncated_variance(F.col("_r"), F.col("_v")), "cut": (clip_dosage(F.col("_r")) != F.col("_r")).cast("long")})

    at_rest = term(m, F.col("intercept"), F.when(F.col("p") == 0, F.col("residual_variance")).otherwise(hardy_weinberg_variance(F.col("allele_frequency"))))
    total = at_rest.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(f"all_{c}") for c in ("term", "var", "cut")), F.count("*").cast("long").alias("n_models"))
    d = dosages.filter("dosage is not null").join(coefficients, "variant_id").groupBy("user_id", "unit_id").agg(F.sum(F.col("dosage") * F.col("coefficient")).alias("x"), F.count("*").alias("seen"))
    d = d.join(at_rest.select("unit_id", "p", "intercept", "beta", "residual_variance", *(F.col(c).alias(f"rest_{c}") for c in ("term", "var", "cut"))), "unit_id").filter("seen = p")
    d = term(d, F.col("intercept") + F.col("x"), F.col("residual_variance"))
    own = d.groupBy("user_id").agg(*(F.sum(F.col(c) - F.col(f"rest_{c}")).alias(c) for c in ("term", "var", "cut")))
    out = dosages.select("user_id").distinct().join(own, "user_id", "left").join(F.broadcast(total))
    return out.select("user_id", *((F.coalesce(c, F.lit(0)) + F.col(f"all_{c}")).alias(a) for c, a in (("term", "score"), ("var", "variance"), ("cut", "n_truncated"))), "n_models")
