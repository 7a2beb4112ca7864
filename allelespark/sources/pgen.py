"""PLINK2 filesets: .pvar and .psam as text, .pgen with fixed-width records by byte ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plink import PANEL, READ_BYTES, _numbered, _open

# The first bytes, the storage modes read here (2-bit calls; calls and 16-bit dosages), the header's length, the
# copies of the alternate allele by 2-bit code, and the unit and missing value of stored dosages.
MAGIC = b"\x6c\x1b"
CALLS, DOSAGES = 0x02, 0x03
HEADER = 12
COPIES = np.array([0.0, 1.0, 2.0, np.nan], dtype=np.float32)
UNIT, MISSING = 16384.0, 65535


def decode(block: bytes, samples: int, mode: int) -> np.ndarray:
    """Copies of the alternate allele, a row for each variant of a block of whole records."""
    width = (samples + 3) // 4
    rows = np.frombuffer(block, np.uint8).reshape(-1, width + (2 * samples if mode == DOSAGES else 0))
    codes = (rows[:, :width, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3
    out = COPIES[codes.reshape(len(rows), -1)[:, :samples]]
    if mode == DOSAGES:
        stored = np.ascontiguousarray(rows[:, width:]).view("<u2")
        out = np.where(stored == MISSING, np.nan, stored / UNIT).astype(np.float32)
    return out


def _dosages(path: str, samples: int, mode: int, keep: list[int] | None):
    width = (samples + 3) // 4 + (2 * samples if mode == DOSAGES else 0)
    most = max(1, READ_BYTES // (4 * max(samples, 1)))

    def run(batches: Iterator) -> Iterator:
        with _open(path) as f:
            for pdf in batches:
                at = pdf.pop("variant_idx").to_numpy()
                for rows in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) != 1) + 1):
                    for i in range(0, len(rows), most):
                        part = rows[i : i + most]
                        block = f.read_at(len(part) * width, HEADER + int(at[part[0]]) * width)
                        if len(block) != len(part) * width:
                            raise ValueError(f"{path} ends before variant {at[part[-1]]} of its .pvar")
                        d = decode(block, samples, mode)
                        d = d if keep is None else d[:, keep]
                        yield pdf.iloc[part].assign(dosage=[np.where(np.isnan(r), None, r).tolist() for r in d])

    return run


def read_psam(spark: SparkSession, path: str) -> list[str]:
    """Sample ids: the IID column if the header has one, else the first."""
    lines = [r[0] for r in spark.read.text(path).collect() if r[0].strip()]
    head = next((x for x in reversed([x for x in lines if x.startswith("#")])), None)
    names = head.lstrip("#").split() if head else []
    at = names.index("IID") if "IID" in names else 0
    return [x.split()[at] for x in lines if not x.startswith("#")]


def read_pvar(spark: SparkSession, path: str) -> DataFrame:
    """(variant_idx, variant_id, chromosome, position, ref_allele, alt_allele) in file order, columns by the #CHROM line or, if
    there is none, as in a .bim."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    head = lines.filter(F.col("value").startswith("#CHROM")).first()
    names = head[0].lstrip("#").split("\t") if head else ["CHROM", "ID", "CM", "POS", "ALT", "REF"]
    f = F.split(F.trim("value"), "\t" if head else r"\s+")
    get = lambda n: F.get(f, F.lit(names.index(n)))
    d = _numbered(lines.filter(~F.col("value").startswith("#")))
    name = F.when(get("ID").isin(".", ""), F.concat_ws(":", get("CHROM"), get("POS"))).otherwise(get("ID"))
    return d.select("variant_idx", name.alias("variant_id"), get("CHROM").alias("chromosome"), get("POS").cast("long").alias("position"), get("REF").alias("ref_allele"), get("ALT").alias("alt_allele"))


def read_pgen(spark: SparkSession, prefix: str, region: tuple[str, int, int] | None = None, samples: list[str] | None = None, variant_ids: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """A panel like read_vcf's and its sample ids in file order. Regions and ids are chosen on the .pvar, and only the chosen
    records' bytes are read. Records of variable width (mode 0x10) are not read; convert them to fixed width."""
    from .readers import matches_ids

    ids = read_psam(spark, f"{prefix}.psam")
    with _open(f"{prefix}.pgen") as f:
        head = f.read(HEADER)
    if head[:2] != MAGIC:
        raise ValueError(f"{prefix}.pgen is no .pgen")
    if head[2] not in (CALLS, DOSAGES):
        raise ValueError(f"{prefix}.pgen has storage mode {head[2]:#04x}; 0x02 and 0x03 are read")
    if int.from_bytes(head[7:11], "little") != len(ids):
        raise ValueError(f"{prefix}.pgen and its .psam differ in their samples")
    keep = None
    if samples is not None:
        if missing := set(samples) - set(ids):
            raise ValueError(f"{prefix}.psam lacks {', '.join(sorted(missing))}")
        keep = [i for i, s in enumerate(ids) if s in set(samples)]
    v = read_pvar(spark, f"{prefix}.pvar")
    if region:
        v = v.filter((F.col("chromosome") == region[0]) & F.col("position").between(region[1], region[2]))
    if variant_ids is not None:
        v = v.filter(matches_ids(variant_ids, F.col("variant_id"), F.col("chromosome"), F.col("position")))
    return v.mapInPandas(_dosages(f"{prefix}.pgen", len(ids), head[2], keep), PANEL), ids if keep is None else [ids[i] for i in keep]
