import numpy as np
import pytest

from allelespark.sources import plink


def write(path, copies):
    """A fileset of copies (variants x samples, -1 for not called)."""
    code = {0: 0, -1: 1, 1: 2, 2: 3}
    out = bytearray(plink.MAGIC)
    for row in copies:
        for i in range(0, len(row), 4):
            out.append(sum(code[v] << (2 * k) for k, v in enumerate(row[i : i + 4])))
    (path / "p.bed").write_bytes(bytes(out))
    (path / "p.bim").write_text("".join(f"{1 + v // 50}\trs{v}\t0\t{v * 10}\tA\tG\n" for v in range(len(copies))))
    (path / "p.fam").write_text("".join(f"f s{i} 0 0 0 -9\n" for i in range(len(copies[0]))))
    return str(path / "p")


def rows(panel):
    return {r.variant_id: [-1 if x is None else int(x) for x in r.dosage] for r in panel.collect()}


def test_round_trip_over_several_splits(spark, tmp_path):
    copies = np.random.RandomState(3).randint(-1, 3, (120, 7)).tolist()
    prefix = write(tmp_path, copies)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        panel, samples = plink.read_plink(spark, prefix)
        assert panel.rdd.getNumPartitions() > 1 and samples == [f"s{i}" for i in range(7)]
        assert rows(panel) == {f"rs{v}": c for v, c in enumerate(copies)}
        some, names = plink.read_plink(spark, prefix, ("2", 600, 700), ["s5", "s1"])
        assert names == ["s1", "s5"] and rows(some) == {f"rs{v}": [copies[v][1], copies[v][5]] for v in range(60, 71)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_bad_filesets(spark, tmp_path):
    prefix = write(tmp_path, [[0, 1], [2, -1]])
    with pytest.raises(ValueError, match="lacks"):
        plink.read_plink(spark, prefix, samples=["nobody"])
    (tmp_path / "p.bed").write_bytes(plink.MAGIC + b"\x00")
    with pytest.raises(Exception, match="ends before"):
        plink.read_plink(spark, prefix)[0].collect()
    (tmp_path / "p.bed").write_bytes(b"\x6c\x1b\x00\x00")
    with pytest.raises(ValueError, match="variant-major"):
        plink.read_plink(spark, prefix)
