import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e
from allelespark.functions import exprs as X
from allelespark.functions import solver
from allelespark.operators import harmonize, ranges, score
from allelespark.plans import catalogue, predictions  # noqa: F401
from allelespark.sources import models, readers
from allelespark.streaming.uploads import stream_scores

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in ("part", "supplier"):
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    return f"{v:.6g}" if isinstance(v, (float, int)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_sql(spark, duck, name):
    mine, sql = catalogue.QUERIES[name](spark, SF).toPandas().astype(object), duck.execute(catalogue.ORACLE[name]).df().astype(object)
    columns = sorted(mine.columns)
    assert columns == sorted(sql.columns)
    rows = [sorted(tuple(map(cell, r)) for r in d[columns].where(d[columns].notna(), None).itertuples(index=False, name=None)) for d in (mine, sql)]
    assert rows[0] == rows[1] and rows[0]


def test_entry(spark):
    assert e.entry(spark).count() > 0


def test_elastic_net_meets_kkt():
    r = np.random.RandomState(1)
    x = r.randn(200, 8)
    y = x[:, 0] - 0.5 * x[:, 3] + r.randn(200) * 0.1
    g, q, _, _, _ = solver.standardize(x.T @ x, x.T @ y, x.sum(0), y.sum(), (y**2).sum(), 200)
    w = solver.elastic_net(g, q, 200, 0.05, 0.5)
    grad = q - g @ w - 0.05 * 0.5 * 200 * w
    assert np.all(np.abs(grad[w == 0]) <= 0.05 * 0.5 * 200 + 1e-6)
    assert np.allclose(grad[w != 0], 0.05 * 0.5 * 200 * np.sign(w[w != 0]), atol=1e-6)


def test_fit_guards_and_truncation():
    assert solver.fit_block(np.zeros((10, 0)), np.arange(10.0), solver.kfold(10, 5, 1), 5, 0.1, 0.5)[5]
    assert solver.fit_block(np.ones((10, 2)), np.ones(10), solver.kfold(10, 5, 1), 5, 0.1, 0.5)[5]
    m, v = solver.truncated_normal([1.0, -50.0, 1.0], [0.3, 0.1, 0.0])
    assert abs(m[0] - 1) < 1e-9 and 0 < v[0] < 0.09 and m[1] == 0 and v[2] == 0


def test_alleles_and_calls(spark):
    d = spark.createDataFrame([("AG", "A", "G"), ("TC", "A", "G"), ("--", "A", "G"), ("A/A", "A", "G"), ("A", "A", "G"), ("AT", "A", "A"), (None, "A", "G"), ("AC", "A", "G")], "g string, c string, o string")
    assert [r[0] for r in d.select(X.count_allele(F.col("g"), F.col("c"), F.col("o"))).collect()] == [1, 1, None, 2, None, None, None, None]
    c = spark.createDataFrame([("chr7.0",), ("MT",), ("chrX",), ("CHR2",)], "c string")
    assert [r[0] for r in c.select(X.normalize_chromosome(F.col("c"))).collect()] == ["7", "M", "X", "2"]


def test_resolution_order_and_bounds(spark):
    panel = spark.createDataFrame([(0, "1", 10, "A", "G"), (1, "1", 10, "A", "C"), (2, "1", 12510, "A", "T")], "variant_idx long, chromosome string, position long, ref_allele string, alt_allele string")
    prs = spark.createDataFrame([(0, "x", "chr1", 10, "C", None, 1.0), (1, "y", "1", 10, "T", "C", 1.0), (2, "z", "9", 10, "T", "C", 1.0)], "prs_row long, variant_id string, chromosome string, position long, effect_allele string, other_allele string, beta double")
    got = {r.prs_row: (r.variant_idx, r.way) for r in harmonize.resolve_alleles(prs, panel).collect()}
    assert got == {0: (1, "direct"), 1: (0, "complement_flip"), 2: (None, "absent")}
    assert ranges.window_pairs(panel, panel, 12500).count() == 6 and ranges.window_pairs(panel, panel, 12499).count() == 2
    assert {r.reason for r in harmonize.drop_reasons(prs, panel).collect()} == {"contig_missing"}


def test_conflicting_uploads(spark):
    calls = spark.createDataFrame([("u", "rs1", "1", 5, "AA"), ("u", "rs1", "1", 5, "AG"), ("u", "zz", "2", 7, "CC")], "user_id string, raw_id string, chromosome string, position long, genotype string")
    terms = spark.createDataFrame([(0, "rs1", "1", 5), (1, "rs9", "2", 7)], "prs_row long, variant_id string, chromosome string, position long")
    assert {(r.prs_row, r.status) for r in score.resolve_uploads(calls, terms).collect()} == {(0, "duplicate_conflict"), (1, "resolved")}
    rows = [("a", "rs1", "1", 5, "AG"), ("a", "RS1", "chr1", 5, "GA"), ("b", "rs1", "1", 5, "AG"), ("b", "rs1", "1", 6, "AG"), ("c", "zz", "1", 5, "GG"), ("c", "yy", "1", 5, "AA"), ("d", "1:5:A:G", "1", 5, "AG"), ("d", "1:5:A:T", "1", 5, "TT"), ("e", "zz", "3", 1, "AA"), ("f", "rs1", None, None, "AG"), ("f", "q", "1", 5, "GG")]
    calls = spark.createDataFrame(rows, "user_id string, raw_id string, chromosome string, position long, genotype string")
    terms = spark.createDataFrame([(0, "rs1", "1", 5, "G", "A")], "prs_row long, variant_id string, chromosome string, position long, effect_allele string, other_allele string")
    got = {r.user_id: r.status for r in score.resolve_uploads(calls, terms, every=True).collect()}
    assert got == {"a": "resolved", "b": "duplicate_conflict", "c": "duplicate_conflict", "d": "resolved", "e": "not_found", "f": "resolved"}
    scored = {r.user_id: (r.score, r.n_used, r.n_unresolved) for r in score.upload_scores(calls, terms.withColumn("beta", F.lit(2.0))).collect()}
    assert scored == {"a": (2.0, 1, 0), "b": (0.0, 0, 1), "c": (0.0, 0, 1), "d": (2.0, 1, 0), "e": (0.0, 0, 1), "f": (2.0, 1, 0)}


def test_readers_and_models(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n1\t100\trs1\tA\tG,T\t.\t.\t.\tGT\t0/1\t1|2\n1\t200\t.\tC\tT\t.\t.\t.\tGT:DS\t./.:.\t0/1:1.5\n")
    panel, samples = readers.read_vcf(spark, str(tmp_path / "a.vcf"))
    assert samples == ["s1", "s2"] and {(r.variant_id, r.alt_allele, tuple(r.dosage)) for r in panel.collect()} == {("rs1", "G", (1.0, 1.0)), ("rs1", "T", (0.0, 1.0)), ("1:200", "T", (None, 1.5))}
    assert readers.read_vcf(spark, str(tmp_path / "a.vcf"), ("1", 150, 300))[0].count() == 1
    (tmp_path / "s.txt").write_text("# c\nrsid,chr,pos,a1,a2,weight\nrs1,1,100,G,A,0.5\n")
    assert readers.read_score(spark, str(tmp_path / "s.txt")).first().beta == "0.5"
    (tmp_path / "m.txt").write_text("rs1\n1:5\nrs1\n")
    assert readers.read_manifest(spark, str(tmp_path / "m.txt")).count() == 2
    (tmp_path / "u.txt").write_text("# x\nrsid\tchromosome\tposition\tgenotype\nrs1\t1\t100\tAG\n")
    assert readers.read_upload(spark, str(tmp_path / "u.txt"), "u").first().genotype == "AG"
    m = spark.createDataFrame([(1, [4, 5], [0.5, 0.0])], "unit_id long, predictor_idx array<long>, coefficients array<double>")
    c = models.coefficients(m)
    bundle = {"observed": m.select("unit_id"), "models": m.select("unit_id"), "coefficients": c}
    models.save(bundle, str(tmp_path / "b"))
    back = models.load(spark, str(tmp_path / "b"), {"observed": "unit_id long", "models": "unit_id long", "coefficients": "unit_id long, ord int, predictor_idx long, coefficient double"})
    assert back["coefficients"].collect() == c.collect()


def test_stream(spark, tmp_path):
    calls = spark.createDataFrame([("u", "rs1", "AG"), ("u", "rs2", "CC"), ("v", "rs1", "GG")], "user_id string, raw_id string, genotype string")
    calls.write.parquet(str(tmp_path / "in"))
    terms = spark.createDataFrame([("rs1", "G", "A", 0.5), ("rs2", "C", "T", 1.0)], "variant_id string, effect_allele string, other_allele string, beta double")
    q = stream_scores(spark.readStream.schema(calls.schema).parquet(str(tmp_path / "in")), terms).writeStream.outputMode("complete").format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.user_id, r.score, r.n_used) for r in spark.table("scored").collect()} == {("u", 2.5, 2), ("v", 1.0, 1)}
