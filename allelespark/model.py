"""Score models of a chip: fitted on a panel, applied to uploads, kept as tables."""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.exprs import is_ambiguous, normalize_chromosome, residual_variance
from .functions.solver import kfold
from .operators import blocks, fit, harmonize, metrics, predict, ranges, score, stats, tiles
from .sources import shards

TABLES = ("observed", "models", "coefficients", "variants", "dispositions")
STATUSES = ("observed", "imputed", "intercept_only", "projected")


@dataclass
class ScoreModel:
    """observed(unit_id, variant_id, chromosome, position, effect_allele, other_allele, beta); models(unit_id, role, intercept,
    beta, cv_mse, cv_r2, n_predictors, intercept_only, allele_frequency, residual_variance, target_variance) with role
    target, fallback or region; coefficients(unit_id, role, predictor_idx, coefficient); variants(variant_idx, variant_id,
    chromosome, position, ref_allele, alt_allele, allele_frequency) of the predictors; dispositions, a row a score term.
    """

    tables: dict[str, DataFrame]
    calibration: dict = field(default_factory=dict)
    info: dict = field(default_factory=dict)

    @property
    def projected(self) -> bool:
        return self.info.get("method") == "projection"

    def predict(self, calls: DataFrame, build: str | None = None, platform: str | None = None, strict: bool = True, calibrate: bool = True) -> DataFrame:
        """A row a user of calls(user_id, raw_id, chromosome, position, genotype); see predict.assemble()."""
        predict.check_compatibility(self.info.get("build"), self.info.get("platform"), build, platform, strict)
        t, users = self.tables, calls.select("user_id").distinct()
        called = predict.called_dosages(calls, t["variants"])
        of = lambda name, role: t[name].filter(F.col("role") == role).drop("role")
        seen = predict.observed_component(users, calls, called, t["observed"], of("models", "fallback"), of("coefficients", "fallback"), t["variants"])
        if self.projected:
            rest = predict.projected_component(users, called, of("models", "region"), of("coefficients", "region"), t["variants"])
        else:
            rest = predict.imputed_component(users, called, of("models", "target"), of("coefficients", "target"), t["variants"])
        c = dict(self.calibration)
        if not calibrate:
            c.pop("slope", None)
        return predict.assemble(seen, rest, c)

    def panel_estimate(self, panel: DataFrame, dosages: DataFrame) -> DataFrame:
        """(sample_idx, estimate) of panel samples from observed terms and models; a missing predictor counts twice its
        frequency, a missing observed dosage nothing."""
        t = self.tables
        chip = _placed(t["variants"].withColumnsRenamed({"alt_allele": "effect_allele", "ref_allele": "other_allele", "variant_idx": "prs_row"}).withColumn("beta", F.lit(0.0)), panel)
        z = dosages.join(chip.select("variant_idx", F.col("prs_row").alias("predictor_idx"), "flip", "allele_frequency"), "variant_idx")
        z = z.select("sample_idx", "predictor_idx", (F.coalesce(F.when(F.col("flip"), 2 - F.col("dosage")).otherwise(F.col("dosage")).cast("double"), 2 * F.col("allele_frequency")) - 2 * F.col("allele_frequency")).alias("moved"))
        role = "region" if self.projected else "target"
        c = t["coefficients"].filter(F.col("role") == role).drop("role")
        based = predict.baselines(t["models"].filter(F.col("role") == role).drop("role"), c, t["variants"])
        samples = dosages.select("sample_idx").distinct()
        if self.projected:  # linear, so the coefficients of a predictor add up before they meet the samples
            w = c.groupBy("predictor_idx").agg(F.sum("coefficient").alias("w"))
            est = z.join(w, "predictor_idx").groupBy("sample_idx").agg(F.sum(F.col("moved") * F.col("w")).alias("x"))
            est = samples.join(est, "sample_idx", "left").join(F.broadcast(based.agg(F.coalesce(F.sum("base"), F.lit(0.0)).alias("c")))).select("sample_idx", (F.coalesce("x", F.lit(0.0)) + F.col("c")).alias("x"))
        else:
            d = z.join(c, "predictor_idx").groupBy("sample_idx", "unit_id").agg(F.sum(F.col("moved") * F.col("coefficient")).alias("moved")).join(based.select("unit_id", "base", "beta"), "unit_id")
            clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(2.0), x)) * F.col("beta")
            own = d.groupBy("sample_idx").agg(F.sum(clip(F.col("base") + F.col("moved")) - clip(F.col("base"))).alias("x"))
            total = based.agg(F.coalesce(F.sum(clip(F.col("base"))), F.lit(0.0)).alias("c"))
            est = samples.join(own, "sample_idx", "left").join(F.broadcast(total)).select("sample_idx", (F.coalesce("x", F.lit(0.0)) + F.col("c")).alias("x"))
        seen = score.panel_score(dosages, _placed(t["observed"].withColumn("prs_row", F.col("unit_id")), panel))
        return est.join(seen, "sample_idx", "left").select("sample_idx", (F.col("x") + F.coalesce("score", F.lit(0.0))).alias("estimate"))

    def evaluate(self, panel: DataFrame, dosages: DataFrame) -> DataFrame:
        """(sample_idx, truth, estimate): truth over the terms that the panel and the model both place."""
        terms = self.tables["dispositions"].filter(F.col("status").isin(*STATUSES))
        truth = score.panel_score(dosages, _placed(terms, panel)).select("sample_idx", F.col("score").alias("truth"))
        return truth.join(self.panel_estimate(panel, dosages), "sample_idx")

    def summary(self) -> DataFrame:
        """(outcome, n, mean_r2): terms by status or reason of the drop, r2 over models that are not intercept-only."""
        d = self.tables["dispositions"].select(F.col("prs_row").alias("unit_id"), F.coalesce("reason", "status").alias("outcome"))
        m = self.tables["models"].filter("role = 'target' and not intercept_only").select("unit_id", "cv_r2")
        return d.join(m, "unit_id", "left").groupBy("outcome").agg(F.count("*").cast("long").alias("n"), F.avg("cv_r2").alias("mean_r2"))

    def variant_table(self) -> DataFrame:
        """Observed terms, modelled terms and fallbacks of observed terms, one under the other, told apart by status."""
        t, terms = self.tables, ["variant_id", "chromosome", "position", "effect_allele", "other_allele", "beta"]
        names = t["coefficients"].join(t["variants"].select(F.col("variant_idx").alias("predictor_idx"), F.col("variant_id").alias("p")), "predictor_idx")
        names = names.groupBy("unit_id", "role").agg(F.concat_ws(";", F.array_sort(F.collect_list("p"))).alias("predictor_variant_ids"))
        m = t["models"].filter("role <> 'region'").drop("beta", "n_predictors").join(t["dispositions"].select(F.col("prs_row").alias("unit_id"), *terms), "unit_id").join(names, ["unit_id", "role"], "left")
        kind = F.when(F.col("role") == "fallback", F.when(F.col("intercept_only"), "observed_fallback_intercept_only").otherwise("observed_fallback")).otherwise(F.when(F.col("intercept_only"), "intercept_only").otherwise("imputed"))
        m = m.select(*terms, kind.alias("status"), F.col("cv_r2").alias("imputation_r2"), "allele_frequency", "intercept", F.size(F.when(F.col("predictor_variant_ids").isNull(), F.array().cast("array<string>")).otherwise(F.split("predictor_variant_ids", ";"))).alias("n_predictors"), "residual_variance", "predictor_variant_ids")
        return t["observed"].select(*terms, F.lit("observed").alias("status"), F.lit(0).alias("n_predictors")).unionByName(m, allowMissingColumns=True)

    def used_ids(self) -> DataFrame:
        """(variant_id) of all terms the model scores and all predictors: what an upload or a panel can add to a score."""
        t = self.tables
        terms = t["dispositions"].filter(F.col("status").isin(*STATUSES)).select("variant_id")
        return terms.union(t["variants"].select("variant_id")).distinct()

    def region_table(self) -> DataFrame:
        """A row a region of a projection: its intercept, fit and number of predictors."""
        return self.tables["models"].filter("role = 'region'").select("unit_id", "intercept", "cv_mse", "cv_r2", "n_predictors", "intercept_only", "target_variance")

    def save(self, path: str, kind: str = "parquet") -> None:
        """Its tables under path as parquet, json or orc, and one row of settings."""
        for name in TABLES:
            self.tables[name].write.mode("overwrite").format(kind).save(f"{path}/{name}")
        spark = self.tables["models"].sparkSession
        rows = [(k, str(v), w) for w, d in (("info", self.info), ("calibration", self.calibration)) for k, v in d.items() if v is not None]
        spark.createDataFrame([*rows, *((n, self.tables[n].schema.json(), "schemas") for n in TABLES)], "name string, value string, part string").coalesce(1).write.mode("overwrite").format(kind).save(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str, kind: str = "parquet") -> ScoreModel:
        import json

        from pyspark.sql.types import StructType

        s = spark.read.schema("name string, value string, part string").format(kind).load(f"{path}/settings").collect()
        schemas = {r.name: StructType.fromJson(json.loads(r.value)) for r in s if r.part == "schemas"}
        tables = {n: spark.read.schema(schemas[n]).format(kind).load(f"{path}/{n}") for n in TABLES}
        return cls(tables, {r.name: float(r.value) for r in s if r.part == "calibration"}, {r.name: r.value for r in s if r.part == "info"})


def _placed(terms: DataFrame, panel: DataFrame) -> DataFrame:
    return harmonize.resolve_alleles(terms, panel).filter("variant_idx is not null")


def fit_model(
    panel: DataFrame, dosages: DataFrame, prs: DataFrame, platform: DataFrame, root: str | None = None, *, method: str = "imputation", window: int = 1_000_000, max_predictors: int = 500,
    folds: int = 5, alpha: float = 0.01, l1_ratio: float = 0.5, seed: int = 42, allow_ambiguous: bool = True, build: str | None = None, platform_name: str | None = None,
) -> ScoreModel:
    """A ScoreModel of prs (cleaned, without duplicates) for a chip.

    panel(variant_idx, variant_id, chromosome, position, ref_allele, alt_allele), dosages(sample_idx, variant_idx, dosage).
    Every placed term gets a unit: the terms off the chip are targets (or, with method "projection", members of merged
    regions), those on it fallbacks. The units' moments are kept by chromosome under root (spark.checkpoint.dir if not
    given), so a lost job goes on at the next chromosome and other penalties are solved without the panel. The panel is
    packed once, by chromosome, and kept there too. No table of samples or variants comes to the driver.
    """
    harmonize.check_fit_inputs(panel, dosages, prs)
    spark = panel.sparkSession
    root = root or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("root or spark.checkpoint.dir names a shared folder")
    prs = prs.withColumn("chromosome", normalize_chromosome(F.col("chromosome")))
    panel = panel.withColumn("chromosome", normalize_chromosome(F.col("chromosome")))
    on = harmonize.partition_by_platform(prs, platform).withColumn("on_chip", F.col("matched_by").isNotNull()).drop("matched_by")
    on = on.withColumn("excluded", is_ambiguous(F.col("effect_allele"), F.col("other_allele")) if not allow_ambiguous else F.lit(False))
    chip = harmonize.partition_by_platform(panel, platform).filter("matched_by is not null").drop("matched_by")
    placed = _placed(on.filter("not excluded"), panel).select("prs_row", "variant_idx", "flip", "beta", "on_chip").join(panel.select("variant_idx", "chromosome", "position"), "variant_idx")
    terms = prs.select("prs_row", "variant_id", "chromosome", "position", "effect_allele", "other_allele", "beta")
    key = shards.key([shards.digest(terms), shards.digest(platform), shards.digest(dosages), shards.digest(panel.select("variant_idx", "variant_id", "chromosome", "position", "ref_allele", "alt_allele"))], {"method": method, "window": window, "max_predictors": max_predictors, "folds": folds, "seed": seed, "ambiguous": allow_ambiguous})
    samples = shards.resume(spark, root, f"{key}-samples", ["all"], lambda _: dosages.select("sample_idx").distinct().agg(F.array_sort(F.collect_list("sample_idx")).alias("ids")).select(F.posexplode("ids").alias("at", "sample_idx"))).drop("shard")
    # The panel is read and packed once; later jobs read the rows of one chromosome.
    packed = shards.partitioned(spark, root, f"{key}-packed", "chromosome", lambda: fit.packed(dosages).join(panel.select("variant_idx", "chromosome", "position"), "variant_idx"))
    frequencies = stats.frequencies(packed).select("variant_idx", "allele_frequency", "hwe_variance")
    n = samples.count()
    fold = spark.createDataFrame([(i, int(k)) for i, k in enumerate(kfold(n, folds, seed))], "at int, fold int")
    projection = method == "projection"
    regions = ranges.merge_windows(placed.filter("not on_chip"), window) if projection else None
    members = None
    if projection:
        members = ranges.region_predictors(regions, placed.filter("not on_chip").select("variant_idx", "chromosome", "position").distinct()).withColumnRenamed("predictor_idx", "variant_idx")

    def units(chromosome: str) -> DataFrame:
        here = placed.filter((F.col("chromosome") == chromosome) & (F.col("on_chip") if projection else F.lit(True)))
        cells = packed.filter(F.col("chromosome") == chromosome)
        near = cells.join(chip.select("variant_idx"), "variant_idx", "left_semi")
        role = F.when(F.col("on_chip"), "fallback").otherwise("target")
        ids = here.select(F.col("prs_row").cast("long").alias("unit_id"), "variant_idx", "flip")
        y = ids.join(cells, "variant_idx").select("unit_id", "variant_idx", "chromosome", "position", F.when(F.col("flip"), F.transform("d", lambda x: 2 - x)).otherwise(F.col("d")).alias("y"))
        out = tiles.collect_tiles(near, y, window, max_predictors, folds, seed)
        out = out.join(here.select(F.col("prs_row").cast("long").alias("unit_id"), role.alias("role")), "unit_id")
        if projection:
            own = members.filter(F.col("chromosome") == chromosome).join(placed.filter("not on_chip").select("variant_idx", "flip", "beta"), "variant_idx").select(F.col("region").alias("unit_id"), "variant_idx", "beta", "flip")
            inside = ranges.region_predictors(regions.filter(F.col("chromosome") == chromosome), chip.filter(F.col("chromosome") == chromosome), max_predictors).select(F.col("region").alias("unit_id"), "predictor_idx")
            r = blocks.collect_blocks(tiles.region_targets(cells, own), inside, stats.filled(near), folds, seed).withColumn("role", F.lit("region"))
            out = out.unionByName(r.withColumn("unit_id", F.xxhash64(F.lit(chromosome), "unit_id")))  # regions are numbered within a chromosome
        return out

    names = sorted(r[0] for r in placed.select("chromosome").distinct().collect())
    base = {"prs_row": F.col("prs_row"), **{c: F.col(c) for c in ("variant_id", "chromosome", "position", "effect_allele", "other_allele", "beta", "on_chip", "excluded")}}
    stored = shards.resume(spark, root, key, names, units).drop("shard")

    info = placed.select(F.col("prs_row").cast("long").alias("unit_id"), "variant_idx", "flip", "beta").join(frequencies, "variant_idx")
    info = info.select("unit_id", "beta", F.when(F.col("flip"), 1 - F.col("allele_frequency")).otherwise(F.col("allele_frequency")).alias("allele_frequency"))
    solved = blocks.solve_blocks(stored.drop("role"), (l1_ratio,), (alpha,))
    var = stored.select("unit_id", "role", *(F.aggregate(c, F.lit(0.0), lambda a, x: a + x).alias(f"_{c}") for c in ("n", "ysum", "ysq")))
    var = var.select("unit_id", "role", F.greatest(F.col("_ysq") / F.col("_n") - (F.col("_ysum") / F.col("_n")) ** 2, F.lit(0.0)).alias("target_variance"))
    m = solved.join(var, "unit_id").join(info, "unit_id", "left")
    # Standardised coefficients that vanish make a unit intercept-only, whatever its predictors.
    fields = F.explode(F.arrays_zip("predictor_idx", "coefficients")).alias("x")
    coefficients = m.filter("not intercept_only").select("unit_id", "role", fields).select("unit_id", "role", F.col("x.predictor_idx").alias("predictor_idx"), F.col("x.coefficients").alias("coefficient"))
    models = m.select("unit_id", "role", "intercept", F.coalesce("beta", F.lit(1.0)).alias("beta"), "cv_mse", "cv_r2", "n_predictors", "intercept_only", "allele_frequency", residual_variance(F.col("allele_frequency"), F.col("cv_r2")).alias("residual_variance"), "target_variance")

    def kept(name: str, d: DataFrame) -> DataFrame:
        return shards.resume(spark, root, f"{key}-{alpha}-{l1_ratio}-{name}", ["all"], lambda _: d).drop("shard")

    models, coefficients = kept("models", models), kept("coefficients", coefficients)
    variants = kept("variants", panel.join(coefficients.select(F.col("predictor_idx").alias("variant_idx")).distinct(), "variant_idx", "left_semi").join(frequencies.drop("hwe_variance"), "variant_idx"))

    tuned = models.select(F.col("unit_id").alias("prs_row"), "role", "intercept_only")
    why = harmonize.drop_reasons(prs, panel)
    d = on.select(*(v.alias(k) for k, v in base.items())).join(why, "prs_row", "left").join(tuned.filter("role <> 'region'"), "prs_row", "left")
    d = d.join(placed.filter("not on_chip").select("prs_row", F.lit(True).alias("member")), "prs_row", "left")
    lost = F.coalesce("reason", F.lit("training_failed"))
    status = F.when(F.col("excluded"), "dropped").when(F.col("on_chip"), "observed").when(F.col("member") & F.lit(projection), "projected").when(F.col("role").isNull(), "dropped").when(F.col("intercept_only"), "intercept_only").otherwise("imputed")
    d = d.withColumns({"status": status, "why": F.when(F.col("excluded"), "ambiguous_excluded").when(status == "dropped", lost)})
    d = d.withColumns({"has_fallback": (F.col("status") == "observed") & F.col("role").isNotNull()})
    d = d.withColumn("fallback_reason", F.when((F.col("status") == "observed") & ~F.col("has_fallback"), F.when(F.col("reason").isNotNull(), "no_reference_target").otherwise("no_fallback_model")))
    dispositions = kept("dispositions", d.select("prs_row", "variant_id", "chromosome", "position", "effect_allele", "other_allele", "beta", "status", F.col("why").alias("reason"), "has_fallback", "fallback_reason"))
    observed = dispositions.filter("status = 'observed'").select(F.col("prs_row").cast("long").alias("unit_id"), "variant_id", "chromosome", "position", "effect_allele", "other_allele", "beta")

    # Held-out estimates are linear: a predictor's weights add up over units before they meet the samples.
    left = blocks.leave_one_out(stored.filter("role <> 'fallback'").drop("role"), alpha, l1_ratio).join(models.select("unit_id", "beta"), "unit_id")
    w = left.select("fold", "beta", F.explode(F.arrays_zip("predictor_idx", "coefficients")).alias("x")).groupBy("fold", F.col("x.predictor_idx").alias("variant_idx")).agg(F.sum(F.col("beta") * F.col("x.coefficients")).alias("w"))
    const = left.groupBy("fold").agg(F.sum(F.col("beta") * F.col("intercept")).alias("const"))
    flat = F.lit(False).alias("flip")
    sums = [tiles.weighted_sum(packed, w.filter(F.col("fold") == k).select("variant_idx", F.col("w").alias("weight"), flat), fill=True).drop("n").withColumn("fold", F.lit(k)) for k in range(folds)]
    moved = functools.reduce(DataFrame.unionByName, sums)
    weights = placed.select("variant_idx", F.col("beta").alias("weight"), "flip", "on_chip")
    seen = tiles.weighted_sum(packed, weights.filter("on_chip"))
    held = fold.join(F.broadcast(const), "fold", "left").join(moved.withColumnRenamed("value", "x"), ["at", "fold"], "left").join(seen.select("at", F.col("value").alias("seen")), "at", "left").na.fill(0.0)
    truth = tiles.weighted_sum(packed, weights, fill=True).withColumnRenamed("value", "truth")
    c = metrics.calibration(held.select("at", (F.col("const") + F.col("x") + F.col("seen")).alias("estimate")).join(truth, "at")).first().asDict()
    c = metrics.with_theory({k: v for k, v in c.items() if v is not None}, models)
    tables = {"observed": observed, "models": models, "coefficients": coefficients, "variants": variants, "dispositions": dispositions}
    return ScoreModel(tables, c, {"method": method, "build": build, "platform": platform_name})
