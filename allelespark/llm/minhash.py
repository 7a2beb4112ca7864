"""Near duplicates by SuperMinHash signatures, banding, exact verification and union-find grouping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, doc_columns, slices, small, store
from .components import components

#: Bands of rows a signature is cut into: a pair at similarity 0.8 shares none with probability (1 - 0.8^5)^28 < 2e-5.
BANDS, ROWS = 28, 5
#: Members of a bucket, and about how many shingles, that are compared in one task; larger buckets go block by block.
BLOCK, BLOCK_SHINGLES = 500, 500_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), by elements."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordCodes(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: bytes | None, k: int, codes: WordCodes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text; of the whole sequence if it has fewer words."""
    words = (text or b"").lower().split()  # on bytes both touch ASCII only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
    k = min(k, len(h))
    acc = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        acc = mix(acc * np.uint64(0x100000001B3) ^ h[j : len(h) - k + 1 + j])
    return np.unique(acc)


def superminhash(elements: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signature (m doubles) of distinct 64-bit elements.

    In round j each element holds the value j + r at the j-th place of its own random permutation, so one element's
    values are negatively correlated. Rounds go on while some place holds more than the next round could offer.
    """
    h = np.full(m, np.inf)
    perm = None
    at = np.arange(len(elements))
    for j in range(m):
        x = mix(elements + np.uint64(j * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
        r = (x >> np.uint64(11)).astype(np.float64) * 2.0**-53
        k = j + (mix(x) % np.uint64(m - j)).astype(np.intp)
        if j == 0:
            place = k
        else:
            if perm is None:
                perm = np.tile(np.arange(m, dtype=np.int16), (len(elements), 1))
                perm[at, 0], perm[at, first] = first, 0
            place = perm[at, k].astype(np.intp)
            perm[at, k] = perm[:, j]
        first = k if j == 0 else first
        np.minimum.at(h, place, r + j)
        if h.max() <= j + 1:
            break
    return h


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature[: bands * rows].view(np.uint64).reshape(bands, rows)
    acc = np.arange(bands, dtype=np.uint64)
    for j in range(rows):
        acc = mix(acc * np.uint64(0x100000001B3) ^ parts[:, j])
    return acc.view(np.int64)


def _signed(k: int, bands: int, rows: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        codes = WordCodes()
        for b in slices(batches):
            n, keys, out = [], [], []
            for text in b.column(1).cast(pa.binary()).to_pylist():
                s = shingle_set(text, k, codes)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                out.append(band_hashes(superminhash(s, bands * rows), bands, rows) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_key", "bands"])

    return run


def _sets(k: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codes = WordCodes()
        for b in slices(batches):
            out = [shingle_set(t, k, codes).view(np.int64) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], ["id", "shingles"])

    return run


def _confirm(percent: int):
    """Pairs (a, b) with their sets to the links among them."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in slices(batches):
            ok = []
            for sa, sb in zip(b.column("sa"), b.column("sb"), strict=True):
                x, y = sa.values.to_numpy(), sb.values.to_numpy()
                both = np.intersect1d(x, y, assume_unique=True).size
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _bucket_links(percent: int):
    """Links that join different components within a bucket, or between a block of its odd members (those outside its
    largest component) and a block of all: compares each odd member with all that are not joined to it yet, by one pass
    over the shingles, and never writes pairs out."""

    def run(rows):
        import pyarrow as pa

        rows = rows.sort_by("id").combine_chunks()
        ids, odd = rows.column("id").to_numpy(), rows.column("odd").to_numpy()
        root = np.unique(rows.column("component").to_numpy(), return_inverse=True)[1]
        lists = pa.concat_arrays(rows.column("shingles").chunks)
        sizes = lists.value_lengths().to_numpy().astype(np.int64)
        vocabulary, flat = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        mark, a, b = np.zeros(len(vocabulary), np.int32), [], []
        for i in np.flatnonzero(odd):
            if (root == root[i]).all():
                break
            own = flat[starts[i] : starts[i] + sizes[i]]
            mark[own] = 1
            both = np.add.reduceat(mark[flat], starts)
            mark[own] = 0
            for j in np.flatnonzero((100 * both >= percent * (sizes + sizes[i] - both)) & (root != root[i])):
                if root[i] != root[j]:
                    root[root == root[j]] = root[i]
                    a.append(ids[i])
                    b.append(ids[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _blocks(members: Column, shingles: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(members / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")


def near_duplicates(docs: DataFrame, k: int = 5, similarity: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for docs(doc_id, text): documents whose sets of k-word shingles have
    100 * intersection >= similarity * union are linked; a component's id is its smallest doc_id, which is kept.

    Words are runs without ASCII white space, A-Z lower-cased. Rows with equal sets are one class, whatever their number.
    Candidates share a band of their SuperMinHash signatures. Each bucket's classes are first compared with its
    smallest; where a bucket still holds several components, all members outside its largest one are compared with all of
    it, in blocks. All links rest on full sets.
    Null or wordless texts are linked with nothing and are kept; a null doc_id takes part as a text and is never kept
    unless its text is wordless (component_id is then null); rows that share a doc_id are one document and share its
    fate; where their texts differ, the least of their sets stands for it.
    """
    docs = doc_columns(docs, "doc_id", "text")
    signed = store(docs.mapInArrow(_signed(k, bands, rows), "doc_id long, n_shingles long, set_key binary, bands array<long>"))
    classes = signed.filter("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("id"))
    classes = cut(classes)
    ids = classes.select("id").distinct()
    banded = signed.filter("set_key is not null").select(F.col("doc_id").alias("id"), "bands").join(ids, "id", "left_semi").select("id", F.posexplode("bands").alias("band", "hash")).distinct()
    buckets = banded.groupBy("band", "hash").agg(F.min("id").alias("leader"), F.count("*").alias("members")).filter("members > 1")
    shared = store(banded.join(buckets, ["band", "hash"]))
    stars = cut(shared.filter("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct())
    wanted = cut(stars.select(F.col("a").alias("id")).union(stars.select("b")).distinct())
    sets = store(docs.filter("doc_id is not null").join(small(wanted).withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").mapInArrow(_sets(k), "id long, shingles array<long>").groupBy("id").agg(F.min("shingles").alias("shingles")))
    left, right = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    links = cut(stars.join(right, "b").join(left, "a").mapInArrow(_confirm(similarity), "a long, b long"))
    found = cut(components(links))

    # buckets of three and more whose members are not yet one component: the smallest was compared, the others were not
    member = shared.filter("members > 2").join(found.withColumnRenamed("node", "id"), "id", "left").select("band", "hash", "leader", "members", "id", F.coalesce("component", "id").alias("component"))
    open_ = member.groupBy("band", "hash", "leader", "members").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("sum"), F.bit_xor(F.xxhash64("id")).alias("xor")).filter("low <> high")
    open_ = open_.groupBy("leader", "members", "sum", "xor").agg(F.min(F.struct("band", "hash")).alias("at")).select("at.band", "at.hash")
    open_ = cut(open_)
    rest = cut(member.join(small(open_), ["band", "hash"]).select("band", "hash", "id", "component"))
    if rest.limit(1).count():
        # every link that is missing has an end outside the bucket's largest component: these odd members meet all others
        at = ["band", "hash"]
        main = cut(rest.groupBy(*at, "component").agg(F.count("*").alias("n")).groupBy(*at).agg(F.max(F.struct("n", "component"))["component"].alias("main")))
        rest = cut(rest.join(small(main), at).select(*at, "id", "component", (F.col("component") != F.col("main")).alias("odd")).join(sets.select("id", F.size("shingles").alias("n")), "id"))
        many = cut(rest.groupBy(*at).agg(_blocks(F.count("*"), F.sum("n")).alias("blocks"), _blocks(F.count_if("odd"), F.sum(F.when(F.col("odd"), F.col("n")).otherwise(0))).alias("odd_blocks")))
        rest = rest.join(small(many), at).withColumns({"block": F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), "odd_block": F.pmod(F.xxhash64("id", F.lit(1)), F.col("odd_blocks")).cast("int")})
        to_all = rest.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("odd_blocks") - 1))).withColumn("odd", F.col("odd") & (F.col("i") == F.col("odd_block"))).withColumn("j", F.col("block"))
        to_odd = rest.filter("odd").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("j <> block").withColumn("i", F.col("odd_block"))
        dealt = to_all.select(*at, "i", "j", "id", "component", "odd").union(to_odd.select(*at, "i", "j", "id", "component", "odd"))
        more = cut(dealt.join(sets, "id").groupBy(*at, "i", "j").applyInArrow(_bucket_links(similarity), "a long, b long"))  # cut, so that no task needs two Python workers
        found = cut(components(links.union(more)))

    named = classes.join(found.withColumnRenamed("node", "id"), "id", "left").select("set_key", F.coalesce("component", "id").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    own = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.col("n_shingles") == 0).alias("kept"))
