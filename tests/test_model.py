import json
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from allelespark import model as M
from allelespark.operators import validate
from allelespark.plans.adapter import tables
from allelespark.sources import scores

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def t(spark, tmp_path_factory):
    keep, at = "{0} < 60 or {0} between 200 and 230", tmp_path_factory.mktemp("panel")
    for k, v in tables(spark, SF).items():
        column = {"prs": "prs_row", "panel_meta": "variant_idx", "dosages": "variant_idx"}.get(k)
        v = v.filter("user_id < 20 and substr(raw_id, 3) < 300 and position % 5000 = 0") if k == "user_calls" else v
        if k in ("panel", "samples"):
            continue
        (v.filter(keep.format(column)) if column else v).coalesce(2).write.parquet(f"{at}/{k}")
    return {k: spark.read.parquet(f"{at}/{k}") for k in ("panel_meta", "dosages", "prs", "platform", "user_calls")}


@pytest.fixture(scope="module", params=["imputation", "projection"])
def fitted(request, spark, t, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("fit"))
    args = (t["panel_meta"], t["dosages"], t["prs"], t["platform"], root)
    return M.fit_model(*args, method=request.param, window=25_000, max_predictors=4, build="hg19", platform_name="chip"), args


def test_fit_predict_and_dispositions(fitted, t):
    m, _ = fitted
    d = {r.prs_row: r for r in m.tables["dispositions"].collect()}
    assert set(d) == {r.prs_row for r in t["prs"].collect()}
    assert {r.status for r in d.values()} >= {"observed", "dropped"} and all((r.reason is not None) == (r.status == "dropped") for r in d.values())
    assert any(r.has_fallback for r in d.values()) and all(r.fallback_reason for r in d.values() if r.status == "observed" and not r.has_fallback)
    assert m.calibration["n"] == 100 and m.calibration["r2"] > 0.3
    p = m.predict(t["user_calls"], build="GRCh37").toPandas()
    assert len(p) == 20 and (p.se >= m.calibration["raw_residual_sd"] - 1e-12).all() and (p.ci_lower < p.prs).all()
    with pytest.raises(ValueError):
        m.predict(t["user_calls"], build="hg38")
    assert sum(r.n for r in m.summary().collect()) == len(d)
    kinds = {r.status for r in m.variant_table().select("status").distinct().collect()}
    assert {"observed", "observed_fallback"} <= kinds


def test_uploads_score_as_the_panel_does(fitted, t):
    """Uploads of complete hard calls get the panel's estimate over the terms that uploads and the panel both place."""
    m, _ = fitted
    same = replace(m, tables=m.tables | {"observed": m.tables["observed"].filter("length(other_allele) = 1 and unit_id % 13 <> 5")})
    full = t["dosages"].na.fill({"dosage": 1}).filter("sample_idx < 12")
    p = same.predict(validate.as_uploads(t["panel_meta"], full)).toPandas().set_index("user_id")
    e = same.panel_estimate(t["panel_meta"], full).toPandas().set_index("sample_idx").estimate
    assert len(p) == 12 and (p.n_fallback == 0).all() and (p.n_unresolved == 0).all()
    assert np.allclose(p.prs, e.loc[p.index])


def test_masking_report(fitted, t):
    m, _ = fitted
    r = validate.masking(m, t["panel_meta"], t["dosages"], t["platform"]).first()
    assert r.n == 100 and 0 < r.pearson <= 1 and 0 <= r.coverage <= 1 and r.mean_se > 0


def test_text_round_trip(fitted, t, tmp_path):
    m, _ = fitted
    r = validate.round_trip(m, t["panel_meta"], t["dosages"].filter("sample_idx < 3"), str(tmp_path / "u")).first()
    assert r.n == 3 and r.max_difference <= 1e-6


def test_document(fitted, spark, t, tmp_path):
    m, _ = fitted
    at = str(tmp_path / "m.json")
    assert scores.write_document(m, at) > 1000
    json.load(open(at))
    back = scores.read_document(spark, at)
    assert back.calibration == pytest.approx(m.calibration) and back.info["method"] == m.info["method"]
    a, b = (x.predict(t["user_calls"]).select("user_id", "prs", "se", "n_fallback").toPandas().sort_values("user_id").to_numpy(float) for x in (m, back))
    assert np.allclose(a, b)


def test_exports(fitted, spark, t, tmp_path):
    from allelespark.sources import exports

    m, _ = fitted
    kinds = ("json", "parquet") if m.projected else ("json", "parquet", "arrow", "csv")
    want = m.predict(t["user_calls"], calibrate=False).select("user_id", "prs").toPandas().sort_values("user_id").prs.to_numpy()
    for kind, at in exports.export(m, str(tmp_path), formats=kinds).items():
        back = exports.load(spark, at)
        got = back.predict(t["user_calls"], calibrate=False).select("user_id", "prs").toPandas().sort_values("user_id").prs.to_numpy()
        assert np.allclose(got, want), kind
    with pytest.raises(ValueError):
        exports.export(m, str(tmp_path), formats=("hdf5",))


def test_save_load_and_resume(fitted, spark, t, tmp_path, monkeypatch):
    m, args = fitted
    for kind in ("parquet", "json"):
        m.save(str(tmp_path / kind), kind)
        back = M.ScoreModel.load(spark, str(tmp_path / kind), kind)
        assert back.calibration == pytest.approx(m.calibration) and back.info["method"] == m.info["method"]
        for name in M.TABLES:
            assert back.tables[name].schema.simpleString() == m.tables[name].schema.simpleString()
            assert back.tables[name].count() == m.tables[name].count()
    a, b = (x.predict(t["user_calls"]).select("user_id", "prs").toPandas().sort_values("user_id").prs.to_numpy() for x in (m, back))
    assert np.allclose(a, b)
    for module, name in ((M.blocks, "collect_blocks"), (M.tiles, "collect_tiles"), (M.fit, "packed")):
        monkeypatch.setattr(module, name, lambda *_: pytest.fail("moments and panel were kept"))
    again = M.fit_model(*args, method=m.info["method"], window=25_000, max_predictors=4, alpha=0.1)
    assert again.tables["models"].count() == m.tables["models"].count()
