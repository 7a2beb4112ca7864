"""Quality by hierarchical empirical Bayes: document evidence shrunk toward path, host and global posteriors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small
from .mixing import n_words
from .toxicity import held_out

#: Labelled rows the document classifier is fitted on, chosen by a hash of doc_id; the only bound on labels.
TRAIN_ROWS = 20_000
#: Bounds of the prior strengths that the moments may suggest, in documents.
STRENGTH = (2.0, 10_000.0)
SHAPES = ("symbols", "capitals", "digits", "variety", "word_length", "repeats", "length")


def shapes(text: Column) -> dict[str, Column]:
    """What the classifier sees of a text: shares of symbols, capitals and digits, how its vocabulary grows, its words'
    mean length, the share of words that repeat their predecessor, its length. Null and empty texts are all zeros."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    share = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))) / n
    words = F.split(F.lower(text), r"[\x20\x09-\x0D]+")
    count = F.size(words)
    again = F.aggregate(words, F.struct(F.lit("").alias("w"), F.lit(0).alias("n")), lambda a, w: F.struct(w.alias("w"), (a["n"] + (w == a["w"]).cast("int")).alias("n")), lambda a: a["n"])
    return {
        "symbols": F.sqrt(share("%$&#*|<>{}[]=~^@\\_+!")),
        "capitals": share("ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÇÑ"),
        "digits": F.sqrt(share("0123456789")),
        "variety": F.log(F.size(F.array_distinct(words)) + F.lit(1.0)) / F.log(count + F.lit(1.0)),
        "word_length": F.log(n / F.greatest(n_words(text), F.lit(1))),
        "repeats": F.sqrt(again / count.cast("double")),
        "length": F.log(n) / 10,
    }


@dataclass
class Shape:
    """A logistic model of the shapes and their squares, standardised."""

    mean: list[float]
    scale: list[float]
    beta: list[float]

    def logit(self) -> Column:
        z = F.lit(self.beta[0])
        for i, c in enumerate([*SHAPES, *(f"{s}*{s}" for s in SHAPES)]):
            z = z + self.beta[i + 1] * (F.expr(c) - self.mean[i]) / self.scale[i]
        return F.greatest(F.least(z, F.lit(12.0)), F.lit(-12.0))


def fit(shaped: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Shape:
    """Newton steps on train_rows labelled rows at most, held-out documents left out; without both labels all are equal. Of rows
    that share a doc_id the one whose shapes come first stands for the label, whatever the order of tasks."""
    own = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("double").alias("quality"))
    own = own.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = shaped.join(F.broadcast(own), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(*SHAPES)).alias("x"))  # one row a label
    rows = rows.select("doc_id", "quality", "x.*").toPandas().sort_values("doc_id")
    y, x = rows["quality"].to_numpy(float), rows[list(SHAPES)].to_numpy(float)
    width = 2 * len(SHAPES)
    if len(set(y)) < 2:
        return Shape([0.0] * width, [1.0] * width, [0.0] * (width + 1))
    x = np.column_stack([x, x * x])
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    beta = np.zeros(width + 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.eye(width + 1), z.T @ (y - p) - beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return Shape(mean.tolist(), scale.tolist(), beta.tolist())


def strength(sites: DataFrame, prior: Column | float) -> float:
    """Documents the prior of sites(n, s, prior) is worth, by moments: how much the sites' means vary beyond chance."""
    m = F.col("s") / F.col("n")
    v = sites.withColumn("p", F.lit(prior) if isinstance(prior, float) else prior)
    row = v.agg(F.sum("n"), F.sum(F.col("n") * (m - F.col("p")) ** 2), F.count("*"), F.sum(F.col("n") * F.col("p") * (1 - F.col("p"))), F.sum(F.col("n") * F.col("n"))).first()
    n, between, k, spread, squares = row
    if not n or k < 2:
        return STRENGTH[1]
    mean_spread = spread / n
    tau = (between - k * mean_spread) / max(n - squares / n, 1e-9)
    return float(min(STRENGTH[1], max(STRENGTH[0], mean_spread / tau - 1 if tau > 0 else STRENGTH[1])))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, doc_p, host_n, host_p, path_p, score, kept) for each row of docs(doc_id, text, host, path).

    doc_p is the classifier's probability that a text is good. Every document counts as doc_p good documents of its host
    and of its path (host and path together). Hosts shrink toward the global share and paths toward their host, each by a
    strength that the variation between sites suggests, so that sparse sites keep close to what stands above them. score
    adds a path's log-odds beyond the global ones to the document's; host_p and path_p leave the document itself out, so that
    none counts twice. kept: score >= threshold. Null hosts and paths are sites of their own. Empty and null texts have the
    evidence of no shape; rows that repeat a doc_id are documents of their own; an empty table gives an empty result. Sites are
    aggregated before they are joined.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"))
    shaped = cut(d.select("doc_id", "host", "path", *(c.alias(k) for k, c in shapes(F.col("text")).items())))
    model = fit(shaped, labels)
    p = shaped.select("doc_id", "host", "path", model.logit().alias("z")).withColumn("doc_p", 1 / (1 + F.exp(-F.col("z"))))
    paths = cut(p.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("doc_p").alias("s")))
    hosts = cut(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
    n, s = hosts.agg(F.sum("n"), F.sum("s")).first()
    overall = min(1 - 1e-6, max(1e-6, (s or 0.5) / (n or 1)))
    k = strength(hosts, overall)
    overall_k = k
    bound = lambda c: F.least(F.greatest(c, F.lit(1e-9)), F.lit(1 - 1e-9))
    of_host = lambda own, left=1: (F.col("host_s") - own + overall_k * overall) / (F.col("host_n") - left + overall_k)
    hosts = hosts.select(F.col("host").alias("h"), F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    paths = paths.join(small(cut(hosts)), F.col("host").eqNullSafe(F.col("h"))).drop("h")
    k = strength(paths, of_host(F.lit(0.0), 0))
    paths = cut(paths.select(F.col("host").alias("h"), F.col("path").alias("q"), "host_n", "host_s", F.col("n").alias("path_n"), F.col("s").alias("path_s")))
    out = p.join(small(paths), F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")), "left")
    logit = lambda c: F.log(c / (1 - c))
    out = out.withColumn("host_p", bound(of_host(F.col("doc_p"))))
    out = out.withColumn("path_p", bound((F.col("path_s") - F.col("doc_p") + k * F.col("host_p")) / (F.col("path_n") - 1 + k)))
    out = out.withColumn("score", 1 / (1 + F.exp(-(F.col("z") + logit(F.col("path_p")) - float(np.log(overall / (1 - overall)))))))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "doc_p", "host_n", "host_p", "path_p", "score", (F.col("score") >= threshold).alias("kept"))
