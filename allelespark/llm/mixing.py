"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small

#: Runs of anything but ASCII white space: words.
WORD = r"[^\x20\x09-\x0D]+"
#: Ranks are cut into so many bins, and the bin that holds a source's last place into so many again.
BINS = 4096


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def length_class(size: Column) -> Column:
    """Weight of a document in its source: one more than the binary digits of its size, so 1 without words, 11 from 512 on."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(0) + 1


def uniform(key: Column, seed: int) -> Column:
    """A keyed number in (0, 1) that any engine with MD5 can repeat: 48 bits, in the middle of their cell."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / 281474976710656.0


def targets(sizes: DataFrame, cycle: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes(source, source_size), one row per source, with its target.

    Sources by code point, null last, weigh as the cycle says. Together they get share of all sizes by weight; a target
    stops at most times its source's size and the excess is shared anew by weight. With sources in the order of
    size / weight the ones that stop are a prefix, so one cumulative sum finds the common level of the others.
    The windows go over one row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, cycle)), F.pmod(F.row_number().over(order) - 1, F.lit(len(cycle))) + 1)
    w = sizes.withColumn("weight", weight)
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before, everything = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    zero = F.lit(0)
    w = w.withColumns({"cum_size": F.coalesce(F.sum("source_size").over(before), zero), "cum_weight": F.coalesce(F.sum("weight").over(before), zero), "all_size": F.sum("source_size").over(everything), "all_weight": F.sum("weight").over(everything)})
    level = (share * F.col("all_size") - most * F.col("cum_size")) / (F.col("all_weight") - F.col("cum_weight"))
    w = w.withColumns({"place": F.row_number().over(fill), "level": level})
    goes_on = F.when(F.col("weight") * F.col("level") < most * F.col("source_size"), F.struct("place", "level"))
    w = w.withColumn("level", F.min(goes_on).over(everything)["level"])  # the first that doesn't stop sets it for all after it
    target = F.coalesce(F.least(F.col("weight") * F.col("level"), most * F.col("source_size")), most * F.col("source_size"))
    return w.select("source", "source_size", "weight", target.cast("double").alias("target"))


def inclusion(classes: DataFrame, goals: DataFrame, most: float = 2.0) -> DataFrame:
    """classes(source, weight, words), one row per source and weight, with source_size, target, whole, p and left.

    Every document is wanted level * weight times, most times at most, the level of a source such that the wanted words
    add up to its target. The heaviest classes are the ones that stop at most, so a running sum from the heaviest down
    finds the level. whole is the number of certain copies, p the odds of one more, left what the certain copies leave
    of the target. A source without words is wanted not at all. The windows go over the weights of one source.
    """
    c = classes.join(small(goals), classes["source"].eqNullSafe(goals["src"])).drop("src")
    own = Window.partitionBy("source")
    heavier = own.orderBy(F.desc("weight")).rowsBetween(Window.unboundedPreceding, -1)
    lighter = own.orderBy("weight").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumns({"heavy": F.coalesce(F.sum("words").over(heavier), F.lit(0)), "mass": F.sum(F.col("words") * F.col("weight")).over(lighter)})
    level = F.when(F.col("mass") > 0, (F.col("target") - most * F.col("heavy")) / F.col("mass"))
    goes_on = F.when(F.col("weight") * level < most, F.struct("weight", level.alias("level")))
    c = c.withColumn("level", F.max(goes_on).over(own)["level"])  # the heaviest that doesn't stop
    wanted = F.when(F.col("source_size") > 0, F.least(F.col("weight") * F.col("level"), F.lit(most))).otherwise(F.lit(0.0))
    c = c.withColumns({"whole": F.floor(wanted), "p": wanted - F.floor(wanted)})
    left = F.floor(F.col("target") - F.sum(F.col("whole") * F.col("words")).over(own)).cast("long")
    return c.select("source", "weight", "source_size", "target", "whole", "p", F.greatest(left, F.lit(0)).alias("left"))


def sample(docs: DataFrame, odds: DataFrame, seed: int = 1) -> DataFrame:
    """docs(doc_id, source, size, weight) with source_size, target and copies, one row for each input row.

    The certain copies of inclusion() are allotted first. For one copy more each document has the inclusion odds
    p / (1 - p) of its class; a source's documents are ranked by the odds of a keyed uniform number divided by these
    inclusion odds, and taken in that order as long as their sizes fit the source's remaining words, so the size that
    is fixed is the number of words. The place after the last goes to that later document whose size comes nearest to
    what is left, if that is nearer than none. The last place is found by two rounds of binned sums, so that no task
    sorts a source; only the rows of one bin in 16 million, ties included, are ordered together. Reruns agree. Rows that
    tie in rank are taken in the order of their size and doc_id.
    """
    u = uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), seed)
    o = odds.withColumnsRenamed({"source": "src", "weight": "class"})
    d = docs.join(small(o), docs["source"].eqNullSafe(o["src"]) & (docs["weight"] == o["class"]), "left").drop("src", "class", "weight")
    q = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    d = d.withColumn("rank", F.when(F.col("p") > 0, q / (1 + q)))
    fine = F.least(F.floor(F.col("rank") * (BINS * BINS)), F.lit(BINS * BINS - 1)).cast("long")
    d = cut(d.withColumns({"bin": F.floor(fine / BINS), "sub": F.pmod(fine, F.lit(BINS))}))
    ranked = d.filter("rank is not null")

    def last(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
        """Of each group the bin in which the running size passes what is left, and the size before it."""
        sums = rows.groupBy(*keys, by, "left").agg(F.sum("size").alias("s"))
        w = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.coalesce(F.sum("s").over(w), F.lit(0)))
        return sums.filter("before <= left and before + s > left").select(*keys, by, "before")

    same = lambda a, b, *more: F.expr(" and ".join([f"{a}.source <=> {b}.source", *(f"{a}.{c} = {b}.{c}" for c in more)]))
    one = cut(last(ranked, ["source"], "bin"))
    inner = ranked.alias("r").join(small(one).alias("o"), same("r", "o", "bin")).select("r.*", F.col("o.before"))
    inner = cut(inner.withColumn("left", F.col("left") - F.col("before")).drop("before"))
    two = last(inner, ["source", "bin"], "sub")
    final = inner.alias("r").join(F.broadcast(two).alias("o") if _few(one) else two.alias("o"), same("r", "o", "bin", "sub")).select("r.*", (F.col("r.left") - F.col("o.before")).alias("gap"))
    w = Window.partitionBy("source").orderBy("rank", "size", "doc_id")
    final = final.withColumn("cum", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min(F.struct(F.col("cum"), (F.col("gap") - (F.col("cum") - F.col("size"))).alias("rest")))
    stop = final.filter("cum > gap").groupBy("source").agg(F.min(F.struct("rank", "size", "doc_id")).alias("at"), first.alias("f")).select("source", "at.rank", F.col("at.size").alias("stop_size"), F.col("at.doc_id").alias("stop_id"), F.col("f.rest").alias("rest"))
    stop = cut(stop.withColumnRenamed("rank", "stop_rank"))

    place = F.struct(F.col("rank"), F.col("size"), F.col("doc_id"))
    d = d.alias("d").join(small(stop).alias("s"), F.expr("d.source <=> s.source"), "left").select("d.*", "s.stop_rank", "s.stop_size", "s.stop_id", "s.rest")
    fits = F.col("p") > 0
    inside = fits & (F.col("stop_rank").isNull() | (place < F.struct("stop_rank", "stop_size", "stop_id")))
    d = d.withColumn("inside", F.coalesce(inside, F.lit(False)))
    after = d.filter(fits & ~F.col("inside") & F.col("rest").isNotNull())
    nearest = after.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("rest")).alias("off"), "rank", "size", "doc_id")).alias("n"), F.min("rest").alias("rest"))
    nearest = cut(nearest.filter("n.off < rest").select("source", F.col("n.rank").alias("n_rank"), F.col("n.size").alias("n_size"), F.col("n.doc_id").alias("n_id")))
    d = d.alias("d").join(small(nearest).alias("n"), F.expr("d.source <=> n.source"), "left").select("d.*", "n.n_rank", "n.n_size", "n.n_id")
    extra = F.col("inside") | F.coalesce((F.col("rank") == F.col("n_rank")) & (F.col("size") == F.col("n_size")) & F.col("doc_id").eqNullSafe(F.col("n_id")), F.lit(False))
    return d.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + extra.cast("long")).alias("copies"))


def _few(one: DataFrame) -> bool:
    return one.limit(10_001).count() <= 10_000


def mix(docs: DataFrame, cycle: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 1) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for docs(doc_id, text, source), one row per row.

    size counts words (null text: 0); documents without words are taken as often as their ranks say and add nothing.
    Longer documents are wanted more often, by the number of binary digits of their size.
    A null source is a source, the last in order. taken = size * copies, at most `most` times the size, rounded up.
    Rows that repeat a doc_id share its rank. An empty table gives an empty result.
    """
    size = n_words(F.col("text"))
    sized = cut(docs.select("doc_id", "source", size.alias("size"), length_class(size).alias("weight")))
    classes = cut(sized.groupBy("source", "weight").agg(F.sum("size").alias("words")))
    sizes = classes.groupBy("source").agg(F.sum("words").alias("source_size"))
    goals = cut(targets(sizes, cycle, share, most).withColumnRenamed("source", "src").drop("weight"))
    return sample(sized, cut(inclusion(classes, goals, most)), seed).withColumn("taken", F.col("size") * F.col("copies"))
