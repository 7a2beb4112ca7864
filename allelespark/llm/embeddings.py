"""Embedding near-dedup: random-hyperplane signs in several tables, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, slices, store
from .components import components

#: Vectors a bucket should hold, the chance that a pair at the threshold shares no bucket, and rows compared in one task.
BUCKET, MISS, BLOCK = 128, 5e-4, 1500


def plan(n: int, cosine: float) -> tuple[int, int]:
    """Bits of a key, growing with the logarithm of n, and the tables that then keep the miss at MISS."""
    bits = min(30, max(6, math.ceil(math.log2(max(n, 1) / BUCKET + 1))))
    together = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log1p(-together))


def _matrix(lists, width: int) -> np.ndarray:
    """Lists of one width as rows of a matrix of doubles, scaled so that no square overflows."""
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    return x / np.abs(x).max(1, keepdims=True)


def _keys(bits: int, tables: int, seed: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        planes: dict[int, np.ndarray] = {}
        power = 1 << np.arange(bits, dtype=np.int64)
        for b in slices(batches):
            widths = pc.list_value_length(b.column("vector"))
            for d in pc.unique(widths).to_pylist():
                part = b.filter(pc.equal(widths, d))
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((tables * bits, d))
                x = _matrix(part.column("vector"), d)
                k = ((x @ planes[d].T > 0).reshape(len(x), tables, bits) * power).sum(2).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * tables), pa.array(k.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, keys], [*part.schema.names, "keys"])

    return run


def _join(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Smallest place of each component after the links p-q are added to the components that root names."""
    while (m := root[p] != root[q]).any():
        p, q = p[m], q[m]
        u, v = root[p], root[q]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root[root] != root).any():
            root = root[root]
    return root


def _links(cosine: float):
    """Of one bucket, or of two blocks of it: how many vectors each is linked to, and stars that join them."""

    def run(key, rows):
        import pyarrow as pa

        table, width, _, i, j = (k.as_py() for k in key)
        rows = rows.sort_by([("block", "ascending"), ("id", "ascending")]).combine_chunks()
        ids, copies, block = (rows.column(c).to_numpy() for c in ("id", "copies", "block"))
        x = _matrix(pa.concat_arrays(rows.column("vector").chunks), width)
        x /= np.sqrt((x * x).sum(1))[:, None]
        keys = pa.concat_arrays(rows.column("keys").chunks).flatten().to_numpy().reshape(len(ids), table)  # of the tables before this one
        count, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for a in range(0, len(ids), 256):
            near = x[a : a + 256] @ x[a:].T >= cosine
            r, c = np.nonzero(np.triu(near, 1))
            r, c = r + a, c + a
            if i != j:
                r, c = r[(m := block[r] != block[c])], c[m]
            for b in range(0, len(r), 200_000):
                p, q = r[b : b + 200_000], c[b : b + 200_000]
                fresh = ~(keys[p] == keys[q]).any(1)  # else an earlier table has the pair
                p, q = p[fresh], q[fresh]
                np.add.at(count, p, copies[q])
                np.add.at(count, q, copies[p])
                root = _join(root, p, q)
        has, hung = np.flatnonzero(count), np.flatnonzero(root != np.arange(len(ids)))
        ends = pa.concat_arrays([pa.nulls(len(has), pa.int64()), pa.array(ids[root[hung]], pa.int64())])
        n = np.concatenate([count[has], np.zeros(len(hung), np.int64)])
        return pa.table({"a": np.concatenate([ids[has], ids[hung]]), "b": ends, "n": n})

    return run


def near_vectors(embeddings: DataFrame, cosine: float = 0.95, seed: int = 11) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of embeddings(vec_id, embedding); other columns are ignored.

    Equal vectors are one class, whatever their number, and are linked with each other. Classes are compared where they
    share a key of any table, each pair in the first table that brings them together; large buckets in blocks. A pair is
    linked if its cosine in double precision is at least the threshold. n_links counts rows. Vectors that are null, empty,
    zero, or hold null or non-finite components, and rows with a null vec_id, are linked with nothing and kept; vectors of
    different lengths are never compared. Vectors of floats travel as floats and are compared as doubles. Rows that share a
    vec_id with different vectors are one node: their links add up.
    """
    cell = "float" if embeddings.schema["embedding"].dataType == T.ArrayType(T.FloatType(), embeddings.schema["embedding"].dataType.containsNull) else "double"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{cell}>").alias("vector"))
    finite = ~F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    sound = F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists("vector", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("sound", sound).withColumns({h: F.when(F.col("sound"), F.xxhash64(F.lit(s), "vector")) for h, s in (("h1", 1), ("h2", 2))})
    classes = rows.filter("sound").groupBy("h1", "h2").agg(F.min(F.struct("vec_id", "vector")).alias("v"), F.count("*").alias("copies"))
    classes = store(classes.select("h1", "h2", F.col("v.vec_id").alias("id"), F.col("v.vector").alias("vector"), "copies"))
    n = classes.count()
    bits, tables = plan(n, cosine)
    keyed = classes.select("id", "vector", "copies").mapInArrow(_keys(bits, tables, seed), f"id long, vector array<{cell}>, copies long, keys array<int>")
    keyed = store(keyed)
    spread = keyed.select("id", F.size("vector").alias("width"), F.posexplode("keys").alias("table", "key"))
    buckets = cut(spread.groupBy("table", "width", "key").agg(F.count("*").alias("n")).filter("n > 1").select("table", "width", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    member = keyed.select("*", F.size("vector").alias("width"), F.posexplode("keys").alias("table", "key")).join(buckets, ["table", "width", "key"])
    member = member.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    member = member.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    found = store(member.select("table", "width", "key", "i", "j", "id", "vector", "copies", F.slice("keys", F.lit(1), F.col("table")).alias("keys"), "block").groupBy("table", "width", "key", "i", "j").applyInArrow(_links(cosine), "a long, b long, n long"))
    joined = components(found.filter("b is not null").select("a", "b"))
    counts = found.filter("b is null").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "id")
    named = classes.select("h1", "h2", "id", "copies").join(counts, "id", "left").join(joined.withColumnRenamed("node", "id"), "id", "left")
    named = named.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.select("vec_id", "h1", "h2").join(named, ["h1", "h2"], "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"))
