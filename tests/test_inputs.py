import gzip
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from allelespark.functions import solver
from allelespark.operators import evaluate, harmonize, metrics, predict, score, tiles, tuning, validate
from allelespark.plans import catalogue
from allelespark.plans.adapter import tables
from allelespark.sources import bgzf, pgen, platforms, readers, scores

SF = "/root/testdata/sf0.001"
HEAD = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n"


def vcf(tmp_path, body):
    (tmp_path / "v.vcf").write_text(HEAD + body)
    return str(tmp_path / "v.vcf")


def test_one_field_a_record(spark, tmp_path):
    at = vcf(tmp_path, "chr1\t10\trs1\tA\tG\t.\t.\t.\tGT:DS\t1/1:.\t0/1:0.7\nchr1\t20\trs2\tA\tG,T\t.\t.\t.\tGT:DS\t1/2:0.3,1.4\t./1:0,0\nchr1\t30\t.\tA\t.\t.\t.\t.\tGP\t0.1,0.2,0.7\t-1,0,0\nMT\t5\trs4\tA\tC\t.\t.\t.\tXX\t1\t2\n")
    rows = {(r.variant_id, r.alt_allele): r.dosage for r in readers.read_vcf(spark, at)[0].collect()}
    assert rows[("rs1", "G")] == [None, pytest.approx(0.7)] and rows[("rs2", "G")] == [1.0, None] and rows[("rs2", "T")] == [1.0, None]
    assert rows[("1:30", None)] == [pytest.approx(1.6), None] and len(rows) == 4
    gt = {r.variant_id: r.dosage for r in readers.read_vcf(spark, at, dosage_field="GT", samples=["s2"])[0].filter("variant_id = 'rs1'").collect()}
    assert gt == {"rs1": [1.0]}
    assert readers.load_genotypes(spark, at, variant_ids=["RS1", "1:30"], region="chr1:5-25")[0].count() == 1
    for bad in ({"dosage_field": "XY"}, {"samples": ["zz"]}, {"region": "9:1-2"}, {"variant_ids": ["rs9"]}):
        with pytest.raises(ValueError):
            readers.read_vcf(spark, at, **bad)
    assert readers.parse_region("2:5-") == ("2", 5, 1 << 62) and readers.parse_region("2") == ("2", 0, 1 << 62)
    panel, names = readers.in_memory(*readers.read_vcf(spark, at), keep=["s2"], region="1:1-15")
    assert names == ["s2"] and panel.count() == 1 and [n for _, n in readers.sample_chunks(panel, ["a", "b", "c"], 2)] == [["a", "b"], ["c"]]


def block(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + (len(body) + 25).to_bytes(2, "little") + body + zlib.crc32(data).to_bytes(4, "little") + len(data).to_bytes(4, "little")


def test_block_gzip_is_read_in_ranges(spark, tmp_path, monkeypatch):
    r = np.random.RandomState(1)
    want = ["".join(chr(97 + x) for x in r.randint(0, 26, r.randint(0, 400))) for _ in range(3000)]
    data = "\n".join(want).encode() + b"\n"
    (tmp_path / "t.bgz").write_bytes(b"".join(block(data[i : i + 3000]) for i in range(0, len(data), 3000)) + block(b""))
    for size in (1000, 7777, 100_000, 1 << 25):
        monkeypatch.setattr(bgzf, "RANGE", size)
        (out,) = [[x for b in bgzf._lines(str(tmp_path / "t.bgz"), (tmp_path / "t.bgz").stat().st_size)([frame(n)]) for x in b["value"]] for n in [range(0, (tmp_path / "t.bgz").stat().st_size, size)]]
        assert out == want
    (tmp_path / "v.vcf.bgz").write_bytes(block((HEAD + "1\t5\trs1\tA\tG\t.\t.\t.\tGT\t0/1\t1/1\n").encode()) + block(b""))
    assert readers.load_genotypes(spark, str(tmp_path / "v.vcf.bgz"))[0].first().dosage == [1.0, 2.0]
    with gzip.open(tmp_path / "p.gz", "wt") as f:
        f.write("a\nb\n")
    assert not bgzf.is_blocked(str(tmp_path / "p.gz")) and readers.text_lines(spark, str(tmp_path / "p.gz")).count() == 2


def frame(ids):
    import pandas as pd

    return pd.DataFrame({"id": list(ids)})


def test_pgen(spark, tmp_path):
    (tmp_path / "a.psam").write_text("#FID\tIID\nf\ts1\nf\ts2\nf\ts3\n")
    (tmp_path / "a.pvar").write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\n1\t10\trs1\tA\tG\n1\t20\t.\tC\tT\n")
    calls = bytes([0b11100100, 0b00000001])  # 0 1 2; 1 0 0
    (tmp_path / "a.pgen").write_bytes(pgen.MAGIC + b"\x02" + (2).to_bytes(4, "little") + (3).to_bytes(4, "little") + b"\0" + calls)
    panel, names = readers.load_genotypes(spark, str(tmp_path / "a.pgen"))
    assert names == ["s1", "s2", "s3"] and {r.variant_id: r.dosage for r in panel.collect()} == {"rs1": [0.0, 1.0, 2.0], "1:20": [1.0, 0.0, 0.0]}
    one, _ = readers.load_genotypes(spark, str(tmp_path / "a"), samples=["s3"], region="1:15-25")
    assert [r.dosage for r in one.collect()] == [[0.0]]
    d = pgen.decode(calls[:1] + np.array([8192, 65535, 32768], "<u2").tobytes(), 3, pgen.DOSAGES)
    assert np.allclose(d, [[0.5, np.nan, 2.0]], equal_nan=True)
    (tmp_path / "a.pgen").write_bytes(pgen.MAGIC + b"\x10" + b"\0" * 20)
    with pytest.raises(ValueError):
        pgen.read_pgen(spark, str(tmp_path / "a"))


def test_score_files(spark, tmp_path):
    (tmp_path / "s.txt").write_text("## note\n#CHROM\tbase_pair_location\tMarkerName\trisk_allele\tnon_effect_allele\tlog_or\tassembly\nchr1\t5\trs1\ta\tg\t0.5\thg19\n1\t6\trs2\tN\tg\t0.5\thg19\n")
    kept, gone = readers.load_score(readers.read_score(spark, str(tmp_path / "s.txt")))
    assert [(r.variant_id, r.chromosome, r.effect_allele, r.beta, r.genome_build) for r in kept.collect()] == [("rs1", "1", "A", 0.5, "GRCh37")]
    assert [(r.reason, r.n, r.examples) for r in gone.collect()] == [("effect_allele", 1, ["rs2"])]
    (tmp_path / "b.txt").write_text("snp  chr pos effect ref beta\nrs1  1   5  A  G  0.5\n")
    assert readers.read_score(spark, str(tmp_path / "b.txt")).first().effect_allele == "A"
    (tmp_path / "c.txt").write_text("snp,chr,pos,alt,ref,beta\nrs1,1,5,A,G,0.5\n")
    with pytest.raises(ValueError):
        readers.read_score(spark, str(tmp_path / "c.txt"))
    assert readers.read_score(spark, str(tmp_path / "c.txt"), True).first().effect_allele == "A"
    (tmp_path / "d.txt").write_text("snp,chr,pos,a1,a2,beta,build\nrs1,1,5,A,G,0.5,hg17\n")
    with pytest.raises(ValueError):
        readers.read_score(spark, str(tmp_path / "d.txt"))
    assert scores.check_build("hg38") == "GRCh38" and scores.cache_info(str(tmp_path / "none"))["n_files"] == 0
    (tmp_path / "PGS000004_GRCh37.txt.gz").write_bytes(b"x")
    assert scores.cache_info(str(tmp_path))["scores"] == ["PGS000004"] and scores.clear_cache(str(tmp_path)) == 1


def test_platforms(spark, tmp_path):
    ids = lambda d: {r.id for r in d.collect()}
    assert ids(platforms.from_list(spark, ["rs1", "chr1:5", "1:5", "1:100:A:G", "1:5xyz", "X:7", "foo"])) == {"rs1", "1:5", "X:7"}
    table = spark.createDataFrame([("1", 5, "c4,v5"), ("2", 6, "c1"), ("X", 7, "v5")], "chrom string, pos int, clusters string")
    assert ids(platforms.resolve(spark, name=" 23andMe_v5 ", clusters=table)) == {"1:5", "X:7"} and platforms.platform_info("ancestrydna_v2").cluster == "c5"
    (tmp_path / "m.csv").write_text("Name,Chr\nrs5,1\nbad,2\n")
    assert ids(platforms.resolve(spark, manifest=str(tmp_path / "m.csv"))) == {"rs5"}
    for bad in ({}, {"name": "x"}, {"name": "23andme_v3", "variants": ["rs1"]}, {"variants": ["foo"]}):
        with pytest.raises(ValueError):
            platforms.resolve(spark, **bad)


def test_uploads(spark, tmp_path):
    files = {"a": "# build 37\nrsid\tchromosome\tposition\tgenotype\nrs1\t1\t5\tAG\nrs2\t1\t\t--\n", "b": "# build 37.1\nrsid\tchromosome\tposition\tallele1\tallele2\nrs1\t1\t5\tA\tG\n", "c": '"RSID","CHROMOSOME","POSITION","RESULT"\n"rs1","1","5","AG"\n', "d": "rs1\t1\t5\tAG\n"}
    for k, text in files.items():
        (tmp_path / k).write_text(text)
        r = readers.read_upload(spark, str(tmp_path / k), k).filter("raw_id = 'rs1'").first()
        assert (r.user_id, r.chromosome, r.position, r.genotype) == (k, "1", 5, "AG")
    assert readers.detect_build(spark, str(tmp_path / "a")) == "GRCh37" and readers.detect_build(spark, str(tmp_path / "d")) is None
    t = spark.createDataFrame([("rs1", "1", 5.0, "AG"), ("rs1", "1", 5.0, "GG"), ("rs3", "nan", None, None)], "variant_id string, chrom string, pos double, genotype string")
    c = readers.uploads_of(t, "u")
    assert {(r.raw_id, r.chromosome, r.position, r.genotype) for r in c.collect()} == {("rs1", "1", 5, "AG"), ("rs1", "1", 5, "GG"), ("rs3", None, None, "--")}
    assert {(r.raw_id, r.genotype) for r in readers.genotype_strings(c).collect()} == {("rs1", "GG"), ("rs3", "--")}
    legacy = score.legacy_dosages(c)
    terms = spark.createDataFrame([("rs1", 0.5), ("rs3", 1.0)], "variant_id string, beta double")
    assert [tuple(r) for r in score.legacy_observed(legacy, terms).collect()] == [("u", 1.0, 1)]
    models = spark.createDataFrame([(1, 0.1, 1.0, 0.05, 0.3), (2, 0.4, 2.0, 0.05, 0.2)], "unit_id long, intercept double, beta double, residual_variance double, allele_frequency double")
    coefs = spark.createDataFrame([(1, "rs1", 0.5), (2, "rs1", 0.5), (2, "rs3", 0.1)], "unit_id long, variant_id string, coefficient double")
    got = score.legacy_imputed(legacy, models, coefs).first()
    var = [solver.clip_and_adjust(1.1, 0.05)[1], solver.clip_and_adjust(0.4, 0.32)[1]]
    assert got.score == pytest.approx(1.1 + 0.8) and got.variance == pytest.approx(float(var[0] + 4 * var[1])) and got.n_models == 2
    validate.write_upload(c.filter("position is not null"), str(tmp_path / "w"))
    assert "rsid\tchromosome" in next((tmp_path / "w" / "user=u").glob("*.txt")).read_text()


@pytest.fixture(scope="module")
def units(spark, tmp_path_factory):
    t = tables(spark, SF.replace("0.001", "0.01"))
    at = tmp_path_factory.mktemp("units")
    chip, targets = catalogue._targets(t)
    for name, d in (("chip", chip), ("targets", targets.withColumn("beta", F.lit(0.5))), ("samples", t["samples"])):
        d.filter("variant_idx < 300" if "variant_idx" in d.columns else "true").coalesce(2).write.parquet(f"{at}/{name}")
    return [spark.read.parquet(f"{at}/{n}") for n in ("chip", "targets", "samples")]


@pytest.mark.parametrize("window,most", [(12_500, 4), (40_000, 3), (700_000, None)])
def test_tiles_fit_what_loops_fit(units, window, most):
    chip, targets, _ = (d.toPandas() for d in units)
    fill = lambda a: np.where(np.isnan(a), np.nanmean(a), a)
    got = {r.unit_id: r for r in tiles.fit_tiles(units[0], units[1], window, most).collect()}
    assert set(got) == set(targets.unit_id)
    for t in targets.iloc[:: 9 if window < 100_000 else 40].itertuples():
        off = (chip.position - t.position).abs()
        near = chip[(chip.chromosome == t.chromosome) & (off <= window)].assign(off=off).sort_values(["off", "variant_idx"]).head(most or 10**9).sort_values("variant_idx")
        y = fill(np.array(t.y, float))
        z = np.stack([fill(np.array(x, float)) for x in near.d]).T
        coef, b, mse, r2, _, empty = solver.fit_block(z, y, solver.kfold(len(y), 5, 42), 5, 0.01, 0.5)
        g = got[t.unit_id]
        assert g.predictor_idx == near.variant_idx.tolist() and np.allclose(g.coefficients, coef, atol=1e-6) and np.allclose([g.intercept, g.cv_mse, g.cv_r2], [b, mse, r2], atol=1e-6) and g.intercept_only == empty and g.failure_type is None


def test_folds_search_and_sensitivity(units):
    chip, targets, samples = units
    folds, s = evaluate.reference_folds(chip, targets, samples, 12_500, 4, F.lit(0.5))
    assert folds.count() == 5 and s.count() == 100 and evaluate.fold_summary(folds).first().mean_correlation > 0.5
    best, table = tuning.search_units(chip, targets, 12_500, 4, max_units=20, l1_ratios=(0.5,), alphas=(0.01, 0.1))
    assert table.count() == 2 and best["n_units"] <= 20 and best["mean_cv_mse"] == min(r.mean_cv_mse for r in table.collect())
    trials = tuning.trial_points(16)
    assert len(set(trials)) == 16 and all(0 <= a <= 1 and 1e-4 <= b <= 1 for a, b in trials)
    best, table = tuning.search_trials(chip, targets, 12_500, 4, n_trials=3)
    assert table.count() == 3
    rows, point = evaluate.sensitivity(chip, targets, samples, F.lit(0.5), windows=(12_500,), alphas=(0.01, 0.3))
    assert rows.count() == 2 and point["alpha"] == 0.01
    with pytest.raises(ValueError):
        tuning.grids((2.0,), None)
    assert sorted(np.bincount(evaluate.outer_folds(103, 5, 1))) == [20, 20, 20, 20, 23]
    with pytest.raises(ValueError):
        evaluate.folds_from_partition([[0, 1], [1, 2]])


def test_legacy_alignment_and_helpers(spark):
    panel = spark.createDataFrame([(0, "rs1", "1", 5, "A", "G"), (1, "rs2", "1", 6, "A", "T"), (2, "q", "1", 9, "C", "T"), (3, "q2", "1", 9, "C", "A")], "variant_idx long, variant_id string, chromosome string, position long, ref_allele string, alt_allele string")
    prs = spark.createDataFrame([(0, "RS1", "1", 5, "A", "G"), (1, "rs2", "1", 6, "T", None), (2, "zz", "chr1", 9, "A", "C"), (3, "rs1", "1", 5, "N", "G"), (4, "none", "2", 1, "A", "G")], "prs_row long, variant_id string, chromosome string, position long, effect_allele string, other_allele string")
    got = {r.prs_row: (r.variant_idx, r.flip, r.ambiguous, r.matched) for r in harmonize.align_by_id(prs, panel).collect()}
    assert got == {0: (0, True, False, True), 1: (1, False, True, True), 2: (3, False, False, True), 3: (0, True, False, True)}
    items = spark.createDataFrame([(i, "a" if i < 80 else "b") for i in range(100)], "unit_id long, stratum string")
    picked = metrics.stratified_sample(items, 10)
    assert {r.stratum: r["count"] for r in picked.groupBy("stratum").count().collect()} == {"a": 8, "b": 2}
    assert {r.unit_id for r in picked.collect()} == {r.unit_id for r in metrics.stratified_sample(items.repartition(3), 10).collect()}
    assert metrics.quantile_bins(items, "unit_id", 4, "q").groupBy("q").count().count() == 4
    same = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 2.0)], "truth double, estimate double")
    assert metrics.estimate_calibration(same)["slope"] == 1.0
    with pytest.raises(ValueError):
        metrics.estimate_calibration(same.limit(2))
    with pytest.raises(ValueError):
        solver.clip_and_adjust([1.0], [-0.1])
    assert 0 < solver.truncation_factor(1.0, 0.5) < 1 and solver.truncation_factor(1.0, 0.0) == 0
    assert predict.validate_build("hg19", "GRCh37") and not predict.validate_build("hg19", "hg38", strict=False)
    v = spark.createDataFrame([("rs1", "1", 5, "G", "A", 0.2), ("rs1", "1", 5, "G", "A", 0.3)], "variant_id string, chromosome string, position long, counted_allele string, other_allele string, allele_frequency double")
    with pytest.raises(ValueError):
        predict.chip_axis(v)
    assert predict.chip_axis(v.limit(1)).count() == 1
