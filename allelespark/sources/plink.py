"""PLINK1 filesets: .bim and .fam as text, .bed by byte ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The first bytes of a variant-major .bed, and the copies of the second allele by 2-bit code; 1 is not called.
MAGIC = b"\x6c\x1b\x01"
COPIES = np.array([0.0, np.nan, 1.0, 2.0], dtype=np.float32)
#: Bytes of .bed that a task holds at once.
READ_BYTES = 16 << 20
PANEL = "variant_id string, chromosome string, position long, ref_allele string, alt_allele string, dosage array<float>"


def _open(path: str):
    """A readable file at a local path or a URI, on the driver or an executor."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(at)


def decode(block: bytes, samples: int) -> np.ndarray:
    """Copies of the second allele, a row for each variant of a block of whole variants."""
    packed = np.frombuffer(block, np.uint8).reshape(-1, (samples + 3) // 4)
    codes = (packed[:, :, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3
    return COPIES[codes.reshape(len(packed), -1)[:, :samples]]


def _dosages(bed: str, samples: int, keep: list[int] | None):
    width = (samples + 3) // 4
    most = max(1, READ_BYTES // (4 * max(samples, 1)))

    def run(batches: Iterator) -> Iterator:
        with _open(bed) as f:
            for pdf in batches:
                at = pdf.pop("variant_idx").to_numpy()
                runs = np.flatnonzero(np.diff(at) != 1) + 1  # a filter leaves gaps; each run of neighbours is one read
                for rows in np.split(np.arange(len(at)), runs):
                    for i in range(0, len(rows), most):
                        part = rows[i : i + most]
                        block = f.read_at(len(part) * width, len(MAGIC) + int(at[part[0]]) * width)
                        if len(block) != len(part) * width:
                            raise ValueError(f"{bed} ends before variant {at[part[-1]]} of its .bim")
                        d = decode(block, samples) if keep is None else decode(block, samples)[:, keep]
                        yield pdf.iloc[part].assign(dosage=[np.where(np.isnan(r), None, r).tolist() for r in d])

    return run


def _numbered(d: DataFrame) -> DataFrame:
    """d with its row numbers in file order; only one count a partition reaches the driver."""
    d = d.withColumn("row", F.monotonically_increasing_id())
    before, starts = 0, {}
    for part, n in sorted(d.groupBy(F.shiftright("row", 33).alias("part")).count().collect()):
        starts[part], before = before, before + n
    if not starts:
        return d.select("*", F.col("row").alias("variant_idx")).drop("row")
    start = F.create_map(*(F.lit(x) for kv in starts.items() for x in kv))[F.shiftright("row", 33)]
    return d.withColumn("variant_idx", (start + F.col("row").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("row")


def read_plink(spark: SparkSession, prefix: str, region: tuple[str, int, int] | None = None, samples: list[str] | None = None, variant_ids: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """A panel like read_vcf's from prefix.bed, .bim and .fam, and its sample ids in file order.

    The fifth column of .bim is ref_allele, the sixth alt_allele; dosages count alt_allele and are null where not called.
    Tasks read the .bed bytes of their own .bim rows, so a region's filter keeps other bytes unread and nothing is shuffled.
    Rows keep the .bim's file order within a task. The .bed must be variant-major; unknown sample ids raise ValueError.
    """
    fam = [r[0] for r in spark.read.text(f"{prefix}.fam").filter(F.trim("value") != "").select(F.get(F.split(F.trim("value"), r"\s+"), 1)).collect()]
    with _open(f"{prefix}.bed") as f:
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{prefix}.bed is not a variant-major .bed")
    keep = None
    if samples is not None:
        if missing := set(samples) - set(fam):
            raise ValueError(f"{prefix}.fam lacks {', '.join(sorted(missing))}")
        keep = [i for i, s in enumerate(fam) if s in set(samples)]
    c = F.split(F.trim("value"), r"\s+")
    lines = _numbered(spark.read.text(f"{prefix}.bim").filter(F.trim("value") != ""))
    bim = lines.select("variant_idx", F.get(c, 1).alias("variant_id"), F.get(c, 0).alias("chromosome"), F.get(c, 3).cast("long").alias("position"), F.get(c, 4).alias("ref_allele"), F.get(c, 5).alias("alt_allele"))
    if region:
        bim = bim.filter((F.col("chromosome") == region[0]) & F.col("position").between(region[1], region[2]))
    if variant_ids is not None:
        from .readers import matches_ids

        bim = bim.filter(matches_ids(variant_ids, F.col("variant_id"), F.col("chromosome"), F.col("position")))
    return bim.mapInPandas(_dosages(f"{prefix}.bed", len(fam), keep), PANEL), fam if keep is None else [fam[i] for i in keep]
