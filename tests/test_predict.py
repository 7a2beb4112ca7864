import numpy as np
import pytest
from pyspark.sql import functions as F

from allelespark.functions import solver
from allelespark.operators import blocks, fit, predict
from allelespark.sources import shards

CALLS = "user_id string, raw_id string, chromosome string, position long, genotype string"
VARIANTS = "variant_idx long, variant_id string, chromosome string, position long, ref_allele string, alt_allele string"
MODELS = "unit_id long, intercept double, beta double, residual_variance double, allele_frequency double"


@pytest.fixture(scope="module")
def world(spark):
    r = np.random.RandomState(3)
    variants = [(i, f"rs{i}", "1", 100 + i, "A", "G") for i in range(12)]
    users = [f"u{k}" for k in range(6)]
    text = ["AA", "AG", "GG", "--", None, "TC", "AT"]  # TC is AG on the other strand; AT fits neither
    count = {"AA": 0, "AG": 1, "GG": 2, "TC": 1}
    calls, cell = [], {}
    for u in users[:5]:  # the last user has one call of no model's predictor
        for i in range(12):
            g = text[r.randint(len(text))]
            if r.rand() < 0.8:
                calls.append((u, f"rs{i}", "1", 100 + i, g))
                cell[u, i] = count.get(g)
    calls.append(("u5", "zz", "9", 1, "AA"))
    models = [(100 + j, float(r.randn()), float(r.randn()), float(r.rand() / 4), float(r.rand())) for j in range(7)]
    coefficients = [(100 + j, int(i), float(r.randn())) for j in range(6) for i in r.choice(12, 3, replace=False)]  # 106 has none
    q = {i: float(r.rand()) for i in range(12)}
    frames = (
        spark.createDataFrame([(u,) for u in users], "user_id string"), spark.createDataFrame(calls, CALLS), spark.createDataFrame(variants, VARIANTS), spark.createDataFrame(models, MODELS),
        spark.createDataFrame(coefficients, "unit_id long, predictor_idx long, coefficient double"), spark.createDataFrame(list(q.items()), "variant_idx long, allele_frequency double"),
    )
    return users, cell, models, coefficients, q, frames


def one(model, coefficients, q, cell, user):
    """A model's prediction, term by term."""
    unit, raw, beta, rv, af = model
    own = [(i, c) for m, i, c in coefficients if m == unit]
    missing = sum(cell.get((user, i)) is None for i, _ in own)
    for i, c in own:
        raw += c * (2 * q[i] if cell.get((user, i)) is None else cell[user, i])
    f = missing / len(own) if own else 0.0
    var = rv * (1 - f) + 2 * af * (1 - af) * f
    return raw, min(max(raw, 0), 2), float(solver.truncated_normal(raw, var**0.5)[1]), f


def test_imputed_component_equals_a_loop(world):
    users, cell, models, coefficients, q, (u, calls, variants, m, c, freq) = world
    got = {r.user_id: r for r in predict.imputed_component(u, predict.called_dosages(calls, variants), m, c, freq).collect()}
    assert set(got) == set(users)
    for user in users:
        p = [(*one(x, coefficients, q, cell, user), x[2]) for x in models]
        assert got[user].term == pytest.approx(sum(clip * b for _, clip, _, _, b in p))
        assert got[user].variance == pytest.approx(sum(b * b * v for _, _, v, _, b in p))
        assert got[user].truncated == sum(raw != clip for raw, clip, *_ in p) and got[user].n_models == 7


def test_observed_component_equals_a_loop(spark, world):
    users, cell, models, coefficients, q, (u, calls, variants, m, c, freq) = world
    observed = [(100 + j, f"rs{j}", "1", 100 + j, "G", None if j == 2 else "A", 0.1 * (j - 4)) for j in range(10)]
    o = spark.createDataFrame(observed, "unit_id long, variant_id string, chromosome string, position long, effect_allele string, other_allele string, beta double")
    back = spark.createDataFrame([(x[0], x[1], 0.1 * (x[0] - 104), x[3], x[4]) for x in models[1:]], MODELS)
    d = predict.observed_component(u, calls, predict.called_dosages(calls, variants), o, back, c, freq)
    got = {r.user_id: r for r in d.collect()}
    fall = {x[0]: x for x in models[1:]}
    for user in users:
        term = var = weight = 0.0
        n = [0, 0, 0]
        for unit, vid, _, _, _, other, beta in observed:
            k = cell.get((user, int(vid[2:]))) if other else None
            if k is not None:
                term, n[0] = term + k * beta, n[0] + 1
            elif unit in fall:
                _, clip, v, _ = one(fall[unit], coefficients, q, cell, user)
                term, var, weight, n[1] = term + clip * beta, var + beta * beta * v, weight + abs(beta), n[1] + 1
            else:
                n[2] += 1
        r = got[user]
        assert (r.n_direct, r.n_fallback, r.n_unresolved) == tuple(n)
        assert (r.term, r.variance, r.fallback_weight) == pytest.approx((term, var, weight))


def test_projected_component_and_intervals(spark, world):
    users, cell, models, coefficients, q, (u, calls, variants, m, c, freq) = world
    regions = m.select("unit_id", "intercept", F.lit(0.2).alias("cv_mse"), F.lit(0.5).alias("target_variance"))
    called = predict.called_dosages(calls, variants)
    mine = predict.projected_component(u, called, regions, c, freq)
    got = {r.user_id: r for r in mine.collect()}
    for user in users:
        p = [one(x, coefficients, q, cell, user) for x in models]
        assert got[user].term == pytest.approx(sum(x[0] for x in p))
        assert got[user].variance == pytest.approx(sum(0.2 * (1 - x[3]) + 0.5 * x[3] for x in p))
        assert got[user].n_substituted == sum(cell.get((user, i)) is None for _, i, _ in coefficients)
    seen = u.select("user_id", F.lit(1.0).alias("term"), F.lit(0.25).alias("variance"), F.lit(0).alias("truncated"))
    row = predict.assemble(seen, mine, {"slope": -2.0, "intercept": 1.0, "raw_residual_sd": 0.1, "residual_sd": 100.0}).filter("user_id = 'u5'").first()
    assert row.prs == pytest.approx(1 + got["u5"].term) and row.se == pytest.approx((0.25 + got["u5"].variance) ** 0.5)
    assert row.prs_scaled == pytest.approx(1 - 2 * row.prs) and row.se_scaled == 100 and row.ci_lower == pytest.approx(row.prs - 1.96 * row.se)
    bare = predict.assemble(seen, mine)
    assert bare.count() == len(users) and "prs_scaled" not in bare.columns


def test_no_users_no_models(spark, world):
    *_, (u, calls, variants, m, c, freq) = world
    called = predict.called_dosages(calls, variants)
    assert predict.imputed_component(u.limit(0), called.limit(0), m, c, freq).count() == 0
    assert {(r.term, r.variance, r.n_models) for r in predict.imputed_component(u, called, m.limit(0), c.limit(0), freq).collect()} == {(0.0, 0.0, 0)}


def test_compatibility():
    assert predict.check_compatibility("GRCh37", "chip", "hg19", "chip") == [] and predict.check_compatibility("GRCh37", None, None, "x") == []
    assert len(predict.check_compatibility("GRCh37", "a", "hg38", "b", strict=False)) == 2
    with pytest.raises(ValueError):
        predict.check_compatibility("GRCh37", None, "b38")


def test_blocks_equal_direct_fits(spark):
    r = np.random.RandomState(5)
    z = r.binomial(2, 0.3, (60, 4)).astype(float)
    y = {1: z[:, 0] + 0.3 * r.randn(60), 2: r.randn(60), 3: np.ones(60), 4: r.randn(60)}  # 4 has no predictors
    targets = spark.createDataFrame([(k, v.tolist()) for k, v in y.items()], "unit_id long, y array<double>")
    panel = spark.createDataFrame([(i, z[:, i].tolist()) for i in range(4)], "variant_idx long, d array<double>")
    pairs = spark.createDataFrame([(k, i) for k in (1, 2, 3) for i in range(4)], "unit_id long, predictor_idx long")
    b = blocks.collect_blocks(targets, pairs, panel)
    for alpha, l1 in ((0.01, 0.5), (0.2, 0.9), (0.1, 0.0)):
        want = {x.unit_id: x for x in fit.fit_units(targets, pairs, panel, 5, alpha, l1).collect()}
        for x in blocks.solve_blocks(b, (l1,), (alpha,)).collect():
            w = want[x.unit_id]
            assert x.coefficients == pytest.approx(w.coefficients, abs=1e-8) and x.intercept_only == w.intercept_only
            assert (x.intercept, x.cv_mse, x.cv_r2) == pytest.approx((w.intercept, w.cv_mse, w.cv_r2), abs=1e-8)
    fold = solver.kfold(60, 5, 42)
    left = {(x.unit_id, x.fold): x for x in blocks.leave_one_out(b).collect()}
    assert len(left) == 20
    for k in range(5):
        keep = fold != k
        m = [x.sum(0) for x in solver.moments(z[keep], y[1][keep], np.zeros(int(keep.sum()), int), 1)]
        coef, at, _ = solver.solve_moments(*m, 0.01, 0.5)
        assert left[1, k].coefficients == pytest.approx(coef) and left[1, k].intercept == pytest.approx(at)


def test_penalties_of_units_and_of_all(spark):
    d = spark.createDataFrame([(1, 0, 0.1, 0.1, 5.0, False), (1, 1, 0.1, 0.2, 3.0, False), (2, 0, 0.1, 0.1, 1.0, True), (2, 1, 0.1, 0.2, 0.5, True), (3, 0, 0.1, 0.1, 1.0, False), (3, 1, 0.1, 0.2, 3.0, False)], "unit_id long, point int, l1_ratio double, alpha double, cv_mse double, intercept_only boolean")
    assert {r.unit_id: r.point for r in blocks.unit_penalties(d).collect()} == {1: 1, 2: 0, 3: 0}
    assert {r.alpha: (r.mean_cv_mse, r.n_units, r.best) for r in blocks.best_penalties(d).collect()} == {0.1: (3.0, 2, True), 0.2: (3.0, 2, False)}


def test_shards_resume(spark, tmp_path):
    d, built = spark.range(10).withColumn("c", F.col("id") % 2), []

    def build(s):
        built.append(s)
        if s == "1" and built.count("1") == 1:
            raise RuntimeError("lost")
        return d.filter(F.col("c") == int(s))

    key = shards.key([shards.digest(d)], {"window": 5})
    assert key == shards.key([shards.digest(d.repartition(3))], {"window": 5}) != shards.key([shards.digest(d.limit(9))], {"window": 5})
    with pytest.raises(RuntimeError):
        shards.resume(spark, str(tmp_path), key, ["0", "1"], build)
    assert shards.listing(spark, str(tmp_path)) == {key: {"0"}}
    assert shards.resume(spark, str(tmp_path), key, ["0", "1"], build).count() == 10 and built == ["0", "1", "1"]
    assert shards.clear(spark, str(tmp_path), key) and shards.finished(spark, str(tmp_path), key) == set()


def test_ranks_and_agreement_with_ties(spark):
    from allelespark.operators import metrics

    r = np.random.RandomState(2)
    x = np.round(r.randn(500), 1)
    x[:200] = 0.5  # one value holds two fifths of the rows
    y = x + r.randn(500)
    d = spark.createDataFrame(list(zip(x.tolist(), y.tolist())) + [(None, 1.0), (1.0, float("nan"))], "truth double, estimate double")
    want = {v: (np.flatnonzero(np.sort(x) == v) + 1).mean() for v in set(x)}
    assert {q.truth: q.rank for q in metrics.average_rank(metrics.valid(d).select("truth"), "truth", 8).collect()} == pytest.approx(want)
    a = metrics.agreement(d).first()
    rank = lambda v: np.array([(v < t).sum() + ((v == t).sum() + 1) / 2 for t in v])
    assert a.spearman == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1]) and a.pearson == pytest.approx(np.corrcoef(x, y)[0, 1])
    c = metrics.calibration(d).first()
    slope, at = np.polyfit(y, x, 1)
    assert (c.slope, c.intercept, c.n) == pytest.approx((slope, at, 500)) and c.residual_sd == pytest.approx((x - at - slope * y).std(ddof=1))
    assert metrics.calibration(d.limit(2)).first().slope is None and metrics.agreement(d.limit(0)).first().pearson is None
    top = {q.percent: q.top for q in metrics.concordance(d, (10,)).collect()}
    est = y >= np.percentile(y, 90)
    assert top[10.0] == pytest.approx((est & (x >= np.percentile(x, 90))).sum() / est.sum())
