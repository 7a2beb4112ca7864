"""Column expressions for chromosomes, alleles, genotypes and variances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a genotype call holds where nothing was called.
NO_CALL = ("", "--", "NA", "N/A", "NULL", "..", "NN", "00")


def normalize_chromosome(c: Column) -> Column:
    """Upper case without CHR, 7.0 as 7, MT as M."""
    bare = F.regexp_replace(F.regexp_replace(F.upper(F.trim(c)), "^CHR", ""), r"^(\d+)\.0$", "$1")
    return F.when(bare == "MT", "M").otherwise(bare)


def chromosome_order(c: Column) -> Column:
    """Place of a normalised chromosome: numbers, X, Y, M, then the rest."""
    number = F.when(c.rlike(r"^\d+$"), c.cast("int"))
    return F.coalesce(number, F.when(c == "X", 23).when(c == "Y", 24).when(c == "M", 25).otherwise(26))


def normalize_build(b: Column) -> Column:
    low = F.lower(F.trim(b))
    return F.when(low.isin("hg19", "b37", "grch37"), "GRCh37").when(low.isin("hg38", "b38", "grch38"), "GRCh38").otherwise(b)


def complement(a: Column) -> Column:
    """The other strand's base; longer alleles stay."""
    return F.when(F.length(a) == 1, F.translate(a, "ACGT", "TGCA")).otherwise(a)


def is_ambiguous(a: Column, b: Column) -> Column:
    return F.coalesce(F.concat(F.least(a, b), F.greatest(a, b)).isin("AT", "CG"), F.lit(False))


def is_allele(a: Column) -> Column:
    return F.coalesce(F.upper(F.trim(a)).rlike("^[ACGT]+$"), F.lit(False))


def id_kind(i: Column) -> Column:
    """rsid, chrpos or invalid: rs and digits, or a chromosome without prefix, a colon and digits, and nothing else."""
    return F.when(F.lower(F.trim(i)).rlike(r"^rs[0-9]+$"), "rsid").when(F.upper(F.trim(i)).rlike(r"^([0-9]{1,2}|X|Y|MT?):[0-9]+$"), "chrpos").otherwise("invalid")


def locus_key(chromosome: Column, position: Column) -> Column:
    return F.concat_ws(":", normalize_chromosome(chromosome), position.cast("string"))


def id_key(i: Column) -> Column:
    """The key an identifier is matched by: chr:pos from the first two parts of what holds a colon and doesn't begin with
    rs, else the identifier in lower case."""
    parts = F.split(i, ":")
    locus = F.contains(i, F.lit(":")) & ~F.lower(i).startswith("rs")
    return F.when(locus, F.concat_ws(":", normalize_chromosome(F.get(parts, 0)), F.get(parts, 1))).otherwise(F.lower(i))


def clip_dosage(d: Column) -> Column:
    return F.when(d < 0, 0.0).when(d > 2, 2.0).otherwise(d)


def hardy_weinberg_variance(q: Column) -> Column:
    return 2 * q * (1 - q)


def residual_variance(q: Column, r2: Column) -> Column:
    return 2 * q * (1 - q) * (1 - F.when(r2 < 0, 0.0).when(r2 > 1, 1.0).otherwise(r2))


def quality_tier(r2: Column) -> Column:
    return F.when(r2 > 0.8, "high").when(r2 > 0.6, "good").when(r2 > 0.4, "moderate").otherwise("low")


def predictor_bucket(n: Column) -> Column:
    return F.when(n == 0, "0").when(n == 1, "1").when(n <= 5, "2-5").when(n <= 20, "6-20").otherwise("21+")


def prs_bucket(n: Column) -> Column:
    """Bucket of a region's number of score variants."""
    return F.when(n <= 1, "1").when(n <= 3, "2-3").otherwise("4+")


def parse_genotype(g: Column) -> Column:
    """The two alleles of a call in order, null where there are none: AG, or two alleles of any length parted by / or |.

    One allele, more than two bases without a separator, symbols and no-calls (judged without separators) are null.
    """
    clean = F.upper(F.trim(g))
    bare = F.regexp_replace(clean, "[/|]", "")
    parts = F.when(clean.rlike("[/|]"), F.split(clean, "[/|]")).when(clean.rlike("^[ACGT]{2}$"), F.array(F.substring(clean, 1, 1), F.substring(clean, 2, 1)))
    return F.when(~bare.isin(*NO_CALL) & (F.size(parts) == 2) & is_allele(F.get(parts, F.lit(0))) & is_allele(F.get(parts, F.lit(1))), parts)


def genotype_group(g: Column) -> Column:
    """What two calls of one genotype have in common: AG, GA and A/G are equal, and so are equal texts that are no call."""
    alleles = parse_genotype(g)
    return F.when(alleles.isNotNull(), F.array_join(F.array_sort(alleles), "/")).otherwise(F.concat(F.lit("raw:"), F.upper(F.trim(g))))


def zygosity_dosage(g: Column) -> Column:
    """2 for a homozygous and 1 for a heterozygous call of two characters, whichever alleles; else null."""
    clean = F.upper(F.trim(g))
    sound = (F.length(clean) == 2) & ~clean.isin(*NO_CALL) & ~clean.rlike("[-N0ID]")
    return F.when(sound, F.when(F.substring(clean, 1, 1) == F.substring(clean, 2, 1), 2.0).otherwise(1.0))


def is_hard_call(d: Column) -> Column:
    """Whether a dosage is 0, 1 or 2 within 1e-9, or missing."""
    return F.coalesce((F.abs(d - F.round(d)) <= 1e-9) & F.round(d).between(0, 2), F.lit(True))


def count_allele(g: Column, counted: Column, other: Column, strand_flip: bool = True, allow_ambiguous: bool = True) -> Column:
    """How often the counted allele is called: on the strand as written if both calls fit, else on the other strand."""
    calls = parse_genotype(g)
    return count_called(F.get(calls, F.lit(0)), F.get(calls, F.lit(1)), counted, other, strand_flip, allow_ambiguous)


def count_called(first: Column, second: Column, counted: Column, other: Column, strand_flip: bool = True, allow_ambiguous: bool = True) -> Column:
    """count_allele() of a call that is parsed already; both alleles are null where there is none."""
    fits = lambda a, b: ((first == a) | (first == b)) & ((second == a) | (second == b))
    times = lambda a: (first == a).cast("int") + (second == a).cast("int")
    sound = first.isNotNull() & is_allele(counted) & is_allele(other) & (counted != other)
    if not allow_ambiguous:
        sound &= ~is_ambiguous(counted, other)
    out = F.when(sound & fits(counted, other), times(counted))
    if strand_flip:
        out = out.when(sound & fits(complement(counted), complement(other)), times(complement(counted)))
    return out


def render_genotype(ref: Column, alt: Column, dosage: Column) -> Column:
    """A call for a whole dosage, alleles joined by / where one is longer than a base; -- where it is missing."""
    k = F.round(dosage).cast("int")
    hard = dosage.isNotNull() & (F.abs(dosage - k) <= 1e-9) & k.between(0, 2)
    sep = F.when((F.length(ref) == 1) & (F.length(alt) == 1), "").otherwise("/")
    first, second = F.when(k == 2, alt).otherwise(ref), F.when(k >= 1, alt).otherwise(ref)
    return F.when(hard, F.concat(first, sep, second)).otherwise("--")
