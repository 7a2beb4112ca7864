import gzip
import json

import pytest

from allelespark.operators.harmonize import clean_score
from allelespark.sources import scores


def test_scoring_files(spark, tmp_path):
    at = str(tmp_path / "s.txt.gz")
    with gzip.open(at, "wt") as f:
        f.write("#pgs_id=x\n#genome_build=y\nrsID\tchr_name\tchr_position\teffect_allele\tother_allele\teffect_weight\thm_rsID\thm_chr\thm_pos\thm_code\nrs1\t1\t5\tA\tG\t0.5\trs11\t1\t50\t10\nrs2\t1\t6\tA\tG\t0.25\trs2\t1\t60\t-5\n")
    r = scores.read_scoring_file(spark, at).collect()
    assert [(x.variant_id, x.position, x.beta) for x in r] == [("rs11", "50", "0.5")]
    assert scores.read_scoring_file(spark, at, filter_failed=False).count() == 2
    (tmp_path / "n.txt").write_text("chr_name\tchr_position\teffect_allele\teffect_weight\n1\t5\tA\t0.5\n2\t7\tC\tx\n")
    d = scores.read_scoring_file(spark, str(tmp_path / "n.txt"))
    assert [x.variant_id for x in d.collect()] == ["1:5:A", "2:7:C"]
    assert [x.reason for x in clean_score(d).collect()] == [None, "beta"]


def test_metadata_and_ids(spark, tmp_path):
    for i, trait in enumerate(("Height", "Breast cancer", "HEIGHT at birth")):
        (tmp_path / f"{i}.json").write_text(json.dumps({"id": f"PGS00000{i}", "trait_reported": trait, "variants_number": i}, indent=1))
    m = scores.read_metadata(spark, str(tmp_path))
    assert [r.id for r in scores.search(m, " height ").collect()] == ["PGS000000", "PGS000002"] and scores.search(m, "height", 1).count() == 1
    assert scores.check_score_id("pgs000004 ") == "PGS000004"
    with pytest.raises(ValueError):
        scores.check_score_id("PGS4")


def test_fetch_keeps_what_it_has_and_tries_again(tmp_path):
    (tmp_path / "a").write_text("x")
    assert scores.fetch((tmp_path / "a").as_uri(), str(tmp_path / "b")) == str(tmp_path / "b") and (tmp_path / "b").read_text() == "x"
    assert scores.fetch("file:///nowhere/at/all", str(tmp_path / "b")) == str(tmp_path / "b")
    with pytest.raises(OSError):
        scores.fetch("file:///nowhere/at/all", str(tmp_path / "c"), tries=2, wait=0.01)
