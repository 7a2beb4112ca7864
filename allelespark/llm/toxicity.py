"""Toxicity: a weighted lexicon, learned from labels, matched by Aho-Corasick on folded text, normalised by length."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, store, tidy

# Look-alike letters and digits, and what they are folded to.
LOOKALIKE = "аеорсухікмнтвѕјԁӏ" "αεορυικντβ" "ı"
FOLDED_TO = "aeopcyxikmhtbsjdl" "aeopuikvtb" "i"
DIGITS, LETTERS = "013457", "oieast"
FOLD = {**{ord(a): b for a, b in zip(LOOKALIKE, FOLDED_TO, strict=True)}, **{ord(a): b for a, b in zip(DIGITS, LETTERS, strict=True)}, **dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])}
FOLD |= {0xFF41 + i: chr(97 + i) for i in range(26)}
SIGNS = re.compile(r"(?<=[^\W\d_])[@$!](?=[^\W\d_])")
SIGN_LETTERS = {"@": "a", "$": "s", "!": "i"}
WORDS = re.compile(r"[^\W_]+")

# Insults known before any label is seen, each of weight SEED_WEIGHT, and phrases in which they are harmless.
SEEDS = "idiot moron stupid scum loser pathetic worthless disgusting imbecile dumbass bastard asshole bitch".split()
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "circus clown", "pond scum", "sore loser bracket")
SEED_WEIGHT = 3.0

#: Labelled rows the lexicon and the calibration are fitted on, chosen by a hash of doc_id; the only bound on labels.
TRAIN_ROWS = 20_000
#: Word beginnings that may be entries, the documents and the neighbourhoods an entry must have, the least log-odds.
PREFIXES, LEAST_DOCS, LEAST_PLACES, LEAST_ODDS = range(4, 9), 6, 5, 3.0


def fold(text: str) -> str:
    """Words of a text in lower case, homoglyphs and digits as the letters they stand for, each between single spaces."""
    t = text.lower()
    if "@" in t or "$" in t or "!" in t:
        t = SIGNS.sub(lambda m: SIGN_LETTERS[m[0]], t)
    return " " + " ".join(WORDS.findall(t.translate(FOLD))) + " "


def features(folded: str) -> dict[str, str]:
    """Entries a text could add to a lexicon, whole words as ' word ' and beginnings as ' beg', with the word before one."""
    out, before = {}, ""
    for w in folded.split():
        for n in PREFIXES:
            if len(w) > n:
                out.setdefault(" " + w[:n], before)
        if len(w) >= 3:
            out.setdefault(f" {w} ", before)
        before = w
    return out


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=lambda: {f" {w} ": SEED_WEIGHT for w in SEEDS})
    exceptions: tuple[str, ...] = EXCEPTIONS
    coefficients: tuple[float, float, float] = (-3.0, 2.0, 10.0)

    def matcher(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for k, w in self.weights.items():
            a.add_word(k, (len(k), w))
        for phrase in self.exceptions:
            a.add_word(k := fold(phrase), (len(k), None))
        a.make_automaton()
        return a

    def measure(self, text: str | None, matcher) -> tuple[float, float]:
        """Summed weight of the hits outside exception phrases, and that sum for each word; one hit a word, the heaviest."""
        t = fold(text or "")
        hits: dict[int, float] = {}
        harmless: list[tuple[int, int]] = []
        for end, (n, w) in matcher.iter(t):
            start = end - n + 1
            if w is None:
                harmless.append((start, end))
            else:
                hits[start] = max(w, hits.get(start, 0.0))
        total, at, reach = 0.0, 0, -1  # hits and phrases side by side, both by their beginnings
        harmless.sort()
        for s in sorted(hits):
            while at < len(harmless) and harmless[at][0] <= s:
                reach = max(reach, harmless[at][1])
                at += 1
            if s >= reach:
                total += hits[s]
        return math.log1p(total), total / max(1, t.count(" ") - 1)

    def probability(self, x: tuple[float, float]) -> float:
        z = self.coefficients[0] + self.coefficients[1] * x[0] + self.coefficients[2] * x[1]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _counted(only: frozenset | None):
    """Documents that have each feature, in each partition; only: the features to count."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        c: Counter = Counter()
        for pdf in batches:  # of the bounded sample
            for t in pdf["text"]:
                f = features(fold(t or ""))
                c.update(f.keys() if only is None else f.keys() & only)
                if len(c) > 150_000:
                    yield pd.DataFrame(c.items(), columns=["f", "n"])
                    c.clear()
        yield pd.DataFrame(c.items(), columns=["f", "n"])
        c.clear()
        tidy()

    return run


def _placed(only: frozenset):
    """For each document the features among only, each with the word before it."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            f = [features(fold(t or "")) for t in pdf["text"]]
            hits = [[(k, x[k]) for k in x.keys() & only] for x in f]
            yield pd.DataFrame({"hits": [[f"{k}\t{b}" for k, b in h] for h in hits]})

    return run


def _measured(lexicon: Lexicon):
    def run(batches: Iterator) -> Iterator:
        m = lexicon.matcher()
        for pdf in batches:
            x = [lexicon.measure(t, m) for t in pdf["text"]]
            yield pdf[["toxic"]].assign(a=[v[0] for v in x], b=[v[1] for v in x])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps for a logistic fit with an intercept, slopes shrunk by ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    beta, pull = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (y - p) - pull @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Lexicon:
    """A lexicon learned from labels(doc_id, toxic) of docs(doc_id, text), without the held-out documents.

    train_rows labelled rows at most, by a hash of doc_id, bound what is fitted. Entries are words and word beginnings
    that toxic documents have far more often than others; they are chosen one by one for the new places they cover, so that
    copies of one document, whose places are the same, don't make entries. Without both labels the seeds stand as they are.
    """
    own = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    own = own.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    train = store(docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").select("text", "toxic"))
    n = dict(train.groupBy("toxic").count().collect())
    if not n.get(0) or not n.get(1):
        return Lexicon()
    bad, good = train.filter("toxic = 1"), train.filter("toxic = 0")
    n1 = dict(bad.mapInPandas(_counted(None), "f string, n long").groupBy("f").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_DOCS).collect())
    only = frozenset(n1)
    n0 = dict(good.mapInPandas(_counted(only), "f string, n long").groupBy("f").agg(F.sum("n").alias("n")).collect())
    odds = {f: math.log((c + 0.5) / (n[1] + 1)) - math.log((n0.get(f, 0) + 0.5) / (n[0] + 1)) for f, c in n1.items()}
    share = {f: c / (c + n0.get(f, 0)) for f, c in n1.items()}
    only = frozenset(f for f in n1 if odds[f] >= LEAST_ODDS and share[f] >= 0.8)
    where: dict[str, dict[str, set[tuple[int, str]]]] = defaultdict(lambda: defaultdict(set))
    for d, (hits,) in enumerate(bad.mapInPandas(_placed(only), "hits array<string>").toLocalIterator()):
        for h in hits:
            f, _, before = h.partition("\t")
            where[f][before].add((d, before))
    chosen, covered = {}, set()
    while where:
        gain = {f: sum(bool(ds - covered) for ds in places.values()) for f, places in where.items()}
        best = max(gain, key=lambda f: (gain[f] * share[f] ** 4, len(f), f))
        if gain[best] < LEAST_PLACES:
            break
        chosen[best] = round(min(6.0, odds[best]), 4)
        covered.update(*where.pop(best).values())
        where = {f: p for f, p in where.items() if gain[f] >= LEAST_PLACES}
    seeds = {k: min(6.0, max(w, odds.get(k, w))) for k, w in Lexicon().weights.items() if n0.get(k, 0) == 0}
    lexicon = Lexicon(weights=seeds | chosen)
    x = train.mapInPandas(_measured(lexicon), "toxic int, a double, b double").groupBy("toxic", "a", "b").count().toPandas()
    x = x.loc[x.index.repeat(x["count"])]
    lexicon.coefficients = tuple(_logistic(x[["a", "b"]].to_numpy(), x["toxic"].to_numpy(float)))
    return lexicon


def _scored(lexicon: Lexicon, text_at: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = lexicon.matcher()
        for b in slices(batches):
            s = [lexicon.probability(lexicon.measure(t, m)) for t in b.column(text_at).to_pylist()]
            keep = [i for i in range(b.num_columns) if i != text_at]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(s, pa.float64())], [*(b.schema.names[i] for i in keep), "score"])

    return run


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs(doc_id, text); only the text is an input of the score.

    Whole texts are folded and matched. Null and empty texts have no hit and get the score of none; repeated rows have equal
    scores; an empty table gives an empty result. Nothing is shuffled.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scored(lexicon, 1), "doc_id long, score double")
    return d.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _clean(lexicon: Lexicon, text_at: int, threshold: float):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = lexicon.matcher()
        for b in slices(batches):
            yield b.filter(pa.array([lexicon.probability(lexicon.measure(t, m)) < threshold for t in b.column(text_at).to_pylist()], pa.bool_()))

    return run


def reject(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """docs without the rows whose text scores threshold or more; all columns stay as they are. Null and empty texts stay,
    repeated rows share their fate, an empty table stays empty."""
    return docs.mapInArrow(_clean(lexicon, docs.columns.index("text"), threshold), docs.schema)
