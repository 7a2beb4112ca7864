"""Operators that read cells in the task, against the plans over packed panels and the SQL of the derived panel."""

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e
from allelespark.operators import cells, evaluate, ranges, stats, tiles
from allelespark.plans import adapter, catalogue
from allelespark.plans.adapter import Cells, source, tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return tables(spark, SF)


@pytest.fixture(scope="module")
def panel(t):
    rows = {r.variant_idx: [np.nan if x is None else x for x in r.d] for r in t["panel"].select("variant_idx", "d").collect()}
    ids = np.array(sorted(rows))
    return ids, np.array([rows[i] for i in ids], float)


def test_cells_are_the_sqls(spark, t, panel):
    ids, d = panel
    np.testing.assert_array_equal(source(t)(ids), d)
    far = np.array([0, 5, 119_999, 1_199_999])
    from allelespark.plans.adapter import CELL

    s = [0, 3, 52, 59_999, 1_234_567]
    got = spark.sql(f"SELECT sample_idx, variant_idx, {CELL} AS x FROM {{s}} CROSS JOIN {{v}}", s=spark.createDataFrame([(x,) for x in s], "sample_idx long"), v=spark.createDataFrame([(int(x),) for x in far], "variant_idx long"))
    by = {(r.variant_idx, r.sample_idx): np.nan if r.x is None else r.x for r in got.collect()}
    np.testing.assert_array_equal(Cells(np.array(s[::-1]))(far), [[by[v, x] for x in s] for v in far.tolist()])
    with pytest.raises(ValueError):
        Cells(np.array([1]))(np.array([-1]))


def test_products_and_fits_equal_the_packed_plan(t):
    """Queries on _single() read every panel array through the JVM twice and shuffled them; they failed by time at 6 times sf0.1."""
    pairs = ranges.nearest(catalogue._pairs(t), 1)
    want = {r.target_idx: r for r in stats.cross_products(stats.filled(t["panel"]), pairs).collect()}
    got = cells.cross_products(pairs, source(t))
    rows = got.collect()
    assert len(rows) == len(want) > 0
    for r in rows:
        w = want[r.target_idx]
        assert (r.predictor_idx, r.n) == (w.predictor_idx, w.n)
        np.testing.assert_allclose([r.product, r.ys, r.yq, r.zs, r.zq], [w.product, w.ys, w.yq, w.zs, w.zq], rtol=1e-12)


def test_frequencies_and_moments_of_missing_and_fractions(spark):
    table = {1: [np.nan] * 4, 2: [0.5, np.nan, 2.0, 1.0], 7: [0.0, 1.0, 2.0, 0.25]}  # one without calls
    gives = lambda ids: np.array([table[int(i)] for i in ids], float).reshape(len(ids), 4)
    v = spark.createDataFrame([(7,), (1,), (2,)], "variant_idx long")
    f = {r.variant_idx: (r.n_called, r.mean) for r in cells.frequencies(v, gives).collect()}
    assert f == {1: (0, 0.0), 2: (3, 3.5 / 3), 7: (4, 0.8125)}
    m = {(r.variant_idx, r.fold): (r.n, r.total, r.squares) for r in cells.fold_moments(v, gives, np.array([0, 1, 0, 3])).collect()}
    assert len(m) == 9 and m[1, 0] == (2, 0.0, 0.0) and m[2, 0] == (2, 2.5, 4.25) and m[7, 3] == (1, 0.25, 0.0625)
    np.testing.assert_allclose(m[2, 1], (1, 3.5 / 3, (3.5 / 3) ** 2))


@pytest.mark.parametrize("filled", [False, True])
def test_sums_equal_the_packed_plan(spark, t, panel, filled):
    ids = panel[0].tolist()
    w = spark.createDataFrame([(i, 0.1 * (k - 5), k % 3 == 0) for k, i in enumerate([*ids, ids[0], ids[1]])], "variant_idx long, weight double, flip boolean")
    want = {r["at"]: (r.value, r.n) for r in tiles.weighted_sum(t["panel"], w, fill=filled).collect()}
    got = {r["at"]: (r.value, r.n) for r in cells.weighted_sum(w, source(t), filled).collect()}
    assert got.keys() == want.keys() and len(got) > 0
    for k in want:
        assert got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 1e-9


def test_estimates_equal_loops(spark, t, panel):
    ids, d = panel
    z = cells.fill(d.copy())
    fold = np.arange(z.shape[1]) % 3
    rows = [(u, u % 3, 0.3 * u - 1, 0.5 - u / 7, [int(ids[u]), int(ids[u + 1])][: u % 3], [0.7, -0.4][: u % 3]) for u in range(6)]
    m = spark.createDataFrame(rows, "unit_id long, fold int, intercept double, beta double, predictor_idx array<long>, coefficients array<double>")
    m = m.union(m.filter("unit_id = 0").withColumns({"predictor_idx": m.predictor_idx.cast("array<long>"), "unit_id": m.unit_id + 9}))
    whole, left = np.zeros(z.shape[1]), np.zeros(z.shape[1])
    for u, k, b, beta, p, c in [*rows, (9, *rows[0][1:])]:
        x = beta * np.clip(b + sum((a * z[np.flatnonzero(ids == i)[0]] for i, a in zip(p, c, strict=True)), np.zeros(z.shape[1])), 0, 2)
        whole += x
        left += np.where(fold == k, x, 0)
    for f, want in ((None, whole), (fold, left)):
        got = {r["at"]: r.value for r in cells.estimates(m, source(t), m.unit_id, f).collect()}
        np.testing.assert_allclose([got[i] for i in range(len(want))], want, atol=1e-12)


@pytest.mark.parametrize("name", ["cross_products", "enet_single_predictor", "hwe_residual_variance", "imputation_quality", "impute_training_summary", "coefficients_long", "quality_tiers", "panel_imputed_score", "calibration_params", "percentile_concordance", "prs_metrics", "quintile_kappa", "panel_projected_score", "cross_validate_metrics", "fold_moments", "panel_true_score", "panel_observed_score", "truncated_variance", "train_minus_fold_moments", "gram_pairs", "grid_search_best", "impute_models", "unit_grid_search"])
def test_no_cell_is_computed_in_a_plan(spark, name):
    """These evaluated the SQL of every cell in the JVM, lambda by lambda, once or more; the time limits were passed at 6 or 60 times sf0.1."""
    assert not re.search(r"\* (cast\()?7919", e.queries()[name](spark, SF)._jdf.queryExecution().toString())


@pytest.mark.parametrize("window,most", [(12_500, 4), (40_000, 3), (700_000, None)])
def test_tiles_read_what_is_packed(t, window, most):
    """A tile's moments from the source and from packed rows, whatever span its Gram matrices cover."""
    packed, read = tiles.collect_tiles(*catalogue._targets(t), window, most), tiles.collect_tiles(*catalogue._places(t), window, most, source=source(t))
    want, got = ({r.unit_id: r for r in d.collect()} for d in (packed, read))
    assert got.keys() == want.keys() and len(got) > 0
    for k, w in want.items():
        assert got[k].predictor_idx == w.predictor_idx
        for c in ("gram", "cross", "sums", "ysum", "ysq", "n"):
            np.testing.assert_allclose(np.array(got[k][c], float), np.array(w[c], float), rtol=1e-12)


def test_folds_read_what_is_packed(t):
    """reference_folds() sent a tile's estimates as rows for every fold; cross_validate_metrics passed the driver's memory at 6 times sf0.1."""
    beta = F.expr("(unit_id % 7 - 3) / 10.0D")
    want, got = (evaluate.reference_folds(*u, t["samples"], 12_500, 4, beta, **k)[1].orderBy("sample_idx").collect() for u, k in ((catalogue._targets(t), {}), (catalogue._places(t), {"source": source(t)})))
    assert len(got) == len(want) == 10
    for g, w in zip(got, want, strict=True):
        assert (g.sample_idx, g.fold) == (w.sample_idx, w.fold)
        np.testing.assert_allclose([g.estimate, g.truth], [w.estimate, w.truth], atol=1e-10)


@pytest.mark.parametrize("n", [1, 63, 64, 65, 8193])
def test_bits_are_the_cells(monkeypatch, n):
    """Hard calls as bits, kept by shift in a worker or packed as they are read, against the cells as doubles."""
    c, ids = Cells(np.arange(n) * 3), np.array([0, 5, 7, 119_999, 1_199_999])
    want = c(ids)
    for kept in (adapter.KEPT, 0):
        monkeypatch.setattr(adapter, "KEPT", kept)
        for some in (ids, ids[:0]):
            bits = c.bits(some)
            spans = [(own, np.where(gone > 0, np.nan, z)) for own, z, gone in bits.spans()]
            np.testing.assert_array_equal(np.concatenate([z for _, z in spans], axis=1), want[: len(some)])
            assert [own.start for own, _ in spans] == list(range(0, n, cells.SPAN)) and spans[-1][0].stop == n
    with pytest.raises(ValueError):
        c.bits(np.array([-1]))


def calls(table: np.ndarray):
    """A source of hard calls that gives bits alone, defined here so that workers get it by value."""

    class Packed:
        def __call__(self, ids):
            raise AssertionError("cells were made as doubles")

        def bits(self, ids):
            z = table[np.asarray(ids, np.int64)]
            pack = lambda x: adapter._packed(x.astype(np.uint8))
            return cells.Calls(pack(z >= 1), pack(z == 2), pack(~np.isnan(z)), z.shape[1])

    return Packed()


@pytest.fixture(scope="module")
def table():
    """By row a variant: one without calls, one with all, and others with some missing."""
    rng = np.random.default_rng(3)
    z = rng.integers(0, 3, (6, 70)).astype(float)
    z[rng.random(z.shape) < 0.2] = np.nan
    z[1], z[4] = np.nan, 2.0
    return z


def test_calls_are_counted_for_products(spark, table):
    """imputation_quality and all else on _single() made two doubles of every pair of cells."""
    z = cells.fill(table.copy())
    pairs = [(0, 1), (0, 2), (2, 3), (5, 4), (1, 1), (3, 3)]
    got = {(r.target_idx, r.predictor_idx): r for r in cells.cross_products(spark.createDataFrame(pairs, "target_idx long, predictor_idx long"), calls(table)).collect()}
    assert got.keys() == set(pairs)
    for (t, p), r in got.items():
        assert r.n == 70
        np.testing.assert_allclose([r.product, r.ys, r.yq, r.zs, r.zq], [z[t] @ z[p], z[t].sum(), z[t] @ z[t], z[p].sum(), z[p] @ z[p]], rtol=1e-12)


def test_calls_are_counted_for_frequencies(spark, table):
    """truncated_variance and coefficients_long made a double of every cell."""
    got = {r.variant_idx: (r.n_called, r.mean) for r in cells.frequencies(spark.range(6).withColumnRenamed("id", "variant_idx"), calls(table)).collect()}
    n, total = (~np.isnan(table)).sum(1), np.nansum(table, axis=1)
    assert got == {i: (n[i], total[i] / max(n[i], 1)) for i in range(6)}


@pytest.mark.parametrize("filled", [False, True])
def test_sums_unpack_calls(spark, table, filled):
    """panel_observed_score made a double of every cell one sample after another; samples are unpacked a span at a time."""
    rows = [(i % 6, 0.3 * i - 1, i % 3 == 0) for i in range(9)]
    got = {r["at"]: (r.value, r.n) for r in cells.weighted_sum(spark.createDataFrame(rows, "variant_idx long, weight double, flip boolean"), calls(table), filled).collect()}
    z = cells.fill(table.copy()) if filled else table
    d = np.array([w * (2 - z[v] if flip else z[v]) for v, w, flip in rows])
    np.testing.assert_allclose([got[i][0] for i in range(70)], np.nansum(d, axis=0), atol=1e-12)
    assert [got[i][1] for i in range(70)] == (~np.isnan(d)).sum(0).tolist()


def test_estimates_unpack_calls(spark, table):
    """calibration_params and the metrics on _scores() made a double of every cell of every predictor."""
    z = cells.fill(table.copy())
    rows = [(0, 0.1, 0.5, [2, 4], [0.7, -0.4]), (1, 1.5, -0.2, [0], [0.9]), (2, -0.3, 1.0, [], []), (3, 0.2, 0.3, None, []), (4, 0.4, -1.5, [1, 3, 5], [0.2, 0.3, -0.6])]
    m = spark.createDataFrame(rows, "unit_id long, intercept double, beta double, predictor_idx array<long>, coefficients array<double>")
    want = sum(beta * np.clip(b + sum((a * z[i] for i, a in zip(p or [], c, strict=True)), np.zeros(70)), 0, 2) for _, b, beta, p, c in rows)
    got = {r["at"]: r.value for r in cells.estimates(m, calls(table), m.unit_id).collect()}
    np.testing.assert_allclose([got[i] for i in range(70)], want, atol=1e-12)


@pytest.mark.parametrize("name,maps", [("percentile_concordance", 2), ("quintile_kappa", 2)])
def test_each_score_is_counted_once_for_its_percentiles(spark, name, maps):
    """A map of all scores was kept for each percentile, 12 and 8 of them in one task."""
    from allelespark.operators import metrics

    scores = spark.range(50).selectExpr("id * 7 % 50 / 9.0D as truth", "id * 11 % 50 / 7.0D as estimate")
    d = {"percentile_concordance": metrics.concordance, "quintile_kappa": metrics.quintile_kappa}[name](scores)
    assert len(set(re.findall(r"percentile\(\w+#\d+L?, [^)]*\)", d._jdf.queryExecution().analyzed().toString()))) == maps


def test_kappa_runs_nothing_before_it_is_read(spark):
    """quintile_kappa counted the samples in a job of its own when the plan was made."""
    from allelespark.operators import metrics

    ran = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    d = metrics.quintile_kappa(spark.range(50).selectExpr("id / 9.0D as truth", "id / 7.0D as estimate"))
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == ran
    assert [tuple(r) for r in d.collect()] == [(1.0, 50)]


@pytest.mark.parametrize("name", ["impute_training_summary", "imputation_quality", "quality_tiers", "truncated_variance", "coefficients_long", "panel_observed_score", "calibration_params", "prs_metrics", "percentile_concordance", "quintile_kappa"])
def test_queries_read_bits_alone(spark, monkeypatch, name):
    """These made a double of every cell that they read, twice of those that were filled and counted."""

    def alone(t):
        c = source(t)

        class Bits:
            bits = c.bits

            def __call__(self, ids):
                raise AssertionError("cells were made as doubles")

        return Bits()

    monkeypatch.setattr(catalogue, "source", alone)
    con = duckdb.connect()
    for table in ("part", "supplier"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = e.queries()[name](spark, SF)
    if name in e.oracle_sql():
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({e.oracle_sql()[name]})").fetchall()
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert got.count() > 0


@pytest.mark.parametrize("bits", [True, False])
def test_nearest_products_equal_the_join(spark, bits):
    """Queries on _single() joined and ranked the pairs by four shuffles before their cells were read; ties by id, the variant
    itself, other chromosomes, the window's and the tile's edge, places that are null, tiles over several batches."""
    rng = np.random.default_rng(5)
    z = rng.integers(0, 3, (60, 70)).astype(float)
    z[rng.random(z.shape) < 0.1] = np.nan
    places = [(i, str(i % 3), int(x)) for i, x in enumerate(rng.integers(0, 40, 60) * 5_000 + rng.choice([0, 490_000], 60))] + [(0, None, 5), (1, "1", None), (None, "1", 5)]
    v = spark.createDataFrame(places, "variant_idx long, chromosome string, position long")
    targets, predictors = v.filter("variant_idx is null or variant_idx % 4 > 0"), v.filter("variant_idx is null or variant_idx % 4 <> 2")
    table = calls(z)
    own = table if bits else lambda ids: z[np.asarray(ids, np.int64)]
    want = sorted(map(tuple, cells.cross_products(ranges.nearest(ranges.window_pairs(targets, predictors, 12_500), 1), own).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = sorted(map(tuple, cells.nearest_products(targets, predictors, 12_500, own).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [g[:3] for g in got] == [w[:3] for w in want] and 20 < len(got) < 60
    np.testing.assert_allclose(np.array(got), np.array(want), rtol=1e-12)


def shuffles(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") + df._jdf.queryExecution().executedPlan().toString().count("Exchange SinglePartition")


@pytest.mark.parametrize("name,most", [("quality_tiers", 2), ("imputation_quality", 2)])
def test_fits_cross_one_shuffle(spark, name, most):
    """Their pairs crossed five shuffles and their fits were kept in memory, though they are read once."""
    df = e.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" not in plan and "Join" not in plan and shuffles(df) <= most


def test_a_predictors_frequency_comes_with_its_products(spark):
    """coefficients_long read the cells of all variants again for the frequencies of the predictors, and joined them."""
    plan = e.queries()["coefficients_long"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and plan.count("Join") == 2


@pytest.mark.parametrize("bits", [True, False])
def test_scores_of_single_models_equal_loops(spark, table, bits):
    """prs_metrics unpacked every call of predictors and targets to doubles, each in a pass of its own."""
    z = cells.fill(table.copy())
    rows = [(0, 2, 0.7, 0.1, 0.5), (1, 2, -1.4, 2.5, -0.2), (3, 1, 0.9, 1.5, 1.0), (5, 0, 3.0, -1.0, 0.3), (4, 4, 0.2, 0.3, -1.5), (0, 5, -0.6, 0.4, 0.7)]
    m = spark.createDataFrame(rows, "target_idx long, predictor_idx long, coefficient double, intercept double, beta double")
    est = sum(beta * np.clip(b + c * z[p], 0, 2) for _, p, c, b, beta in rows)
    true = sum(beta * z[t] for t, _, _, _, beta in rows)
    own = calls(table) if bits else lambda ids: table[np.asarray(ids, np.int64)]
    got = {r["at"]: (r.estimate, r.truth) for r in cells.single_scores(m, own).collect()}
    np.testing.assert_allclose([got[i] for i in range(70)], np.stack([est, true], 1), atol=1e-12)
    assert cells.single_scores(m.limit(0), own).collect() == []


@pytest.mark.parametrize("n", [1, 63, 65, 2 * cells.SPAN + 3])
def test_values_are_looked_up_by_call(n):
    c, ids = Cells(np.arange(n) * 3), np.array([0, 5, 7, 52, 119_999])
    rng, z = np.random.default_rng(1), c(ids)
    for k in (0, 1, 4, 5):
        v = rng.normal(size=(k, 4))
        want = v[np.arange(k)[:, None], np.where(np.isnan(z[:k]), 3, z[:k]).astype(int)].sum(0)
        np.testing.assert_allclose(c.bits(ids[:k]).looked_up(v), want, atol=1e-12)


def test_ranks_cross_no_join_by_value(spark):
    """prs_metrics counted, ranked and joined the values of each score by itself; its plan alone took most of the driver's memory."""
    from allelespark.operators import metrics

    rng = np.random.default_rng(4)
    x, y = rng.normal(size=700), rng.integers(0, 300, 700) / 7.0
    x[:300], x[300:340], y[:200] = -0.0, 0.0, np.inf
    d = spark.createDataFrame([*zip(x.tolist(), y.tolist(), strict=True)], "truth double, estimate double").repartition(5)
    rank = lambda v: np.array([(v < q).sum() + ((v == q).sum() + 1) / 2 for q in v])
    r = metrics.ranked(d, "truth", "estimate", parts=8)
    got = sorted(map(tuple, r.collect()))
    want = sorted(zip(x.tolist(), y.tolist(), rank(x).tolist(), rank(y).tolist(), strict=True))
    assert sorted(g[2:] for g in got) == sorted(w[2:] for w in want) and [g[:2] for g in got] == [w[:2] for w in want]
    assert metrics.ranked(d.limit(0), "truth", "estimate").collect() == []
    plan = metrics.agreement(d)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and not re.search(r"BroadcastHashJoin \[(knownfloatingpointnormalized\(normalizenanandzero\()?(truth|estimate)", plan)
    assert re.search(r"rank_truth", plan)
