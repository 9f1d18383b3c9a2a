"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

Every source has a weight and a size (its documents' words). A budget of words is shared by
weight, but no source gets more than ``max_epochs`` times its size: in rounds, sources above
their cap are clamped at it and what they leave is shared among the others by weight, until
none is above. A round is one aggregate over the table of sources.

A source's target is taken as whole repetitions of all its documents and one fractional
repetition: its documents in a seeded hash order up to the words still missing, the last of
them in part. So the words taken equal the target rounded to a word. The place where that
repetition ends is found by histograms over the hash: words per (source, hash bin), then the
bin that holds the end, cut finer while it has more than ``END_ROWS`` rows. A source that
holds a third of all rows is only ever summed in parts, never sorted in one task.

Defined results: a null or blank text has size 0 and nothing taken; a null source is a
source of its own, last in order; null and repeated ids are ordinary values; equal rows may
stand for each other, so reruns agree as a set of rows; when the budget exceeds all caps
every source gets its cap; an empty table gives an empty result; the input columns travel
in a struct, so none can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.llm.common import materialize, scratch
from ledgerlens.operators.rank import numbered

WEIGHTS = (3, 1, 2)             # by the sources' order, repeating
SHARE = 1.5                     # the budget in sizes of the whole corpus
MAX_EPOCHS = 2.0
SEED = "mix-1"
SPLIT = "[\\x20\\x09-\\x0D]+"
HASH_BITS, BIN_BITS = 60, 10    # bits of the order hash, and those resolved per round
END_ROWS = 4096                 # rows that are put in order to find a repetition's end


def n_words(text: Column) -> Column:
    """Words separated by ASCII white space; a piece between separators is empty only at
    the ends."""
    parts = F.split(text, SPLIT)
    return F.coalesce(F.when(text == "", F.lit(0)).otherwise(
        F.size(parts) - F.when(F.element_at(parts, 1) == "", 1).otherwise(0)
        - F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)), F.lit(0)).cast("long")


def order_hash(seed: str) -> Column:
    """The documents' seeded order: 60 bits of a digest of id and text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"),
                    F.coalesce(F.col("text"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """Adds ``target`` to ``source_size, weight`` rows. Each round clamps the sources above
    their cap; the scalars of a round are one row."""
    cap = F.col("source_size") * F.lit(max_epochs)
    level = None
    while True:                 # a round clamps one source more at least, or is the last
        clamped = F.lit(False) if level is None else F.lit(level) * F.col("weight") > cap
        rest = sources.agg(F.sum(F.when(clamped, F.col("source_size"))).alias("used"),
                           F.sum(F.when(~clamped, F.col("weight"))).alias("weight")).first()
        if rest.weight is None:                 # all sources are at their cap
            return sources.withColumn("target", cap)
        now = (budget - max_epochs * (rest.used or 0)) / rest.weight
        if now == level:
            return sources.withColumn("target", F.when(clamped, cap).otherwise(F.lit(level) * F.col("weight")))
        level = now


def source_table(base: DataFrame, weights: tuple[int, ...], share: float, max_epochs: float) -> DataFrame:
    """Per source: ``sid`` (its place by code point, null last, from 1), size, weight, target,
    whole repetitions and the words of the fractional one."""
    spark = base.sparkSession
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = numbered(sizes, scratch(spark, "mix-sources"), F.col("source").asc_nulls_last(), name="sid")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("sid", F.lit(len(weights))) + F.when(
        F.pmod("sid", F.lit(len(weights))) == 0, len(weights)).otherwise(0)).cast("int"))
    ranked = materialize(ranked.withColumn("weight", weight), "mix-weights")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    words = F.round("target").cast("long")
    filled = fill(ranked, share * total, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    return filled.withColumn("whole", whole).withColumn("extra", words - F.col("whole") * F.col("source_size"))


def _cut(rows: DataFrame, before: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of each source's ``rows`` (one per ``key`` value, with ``words``) that which holds the
    end of its fractional repetition, and the words taken before it."""
    w = Window.partitionBy("sid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.join(before, "sid").withColumn("taken", F.col("taken") + F.coalesce(F.sum("words").over(w), F.lit(0)))
    return summed.filter("taken < extra and taken + words >= extra").select("sid", key, "taken", "extra", "n")


def repetition_ends(rows: DataFrame, sources: DataFrame, bin_bits: int = BIN_BITS, end_rows: int = END_ROWS) -> DataFrame:
    """Per source with a fractional repetition: the order ``(h, uid)`` of the document it
    ends in and the words ``part`` taken of that document. ``rows`` has ``sid, h, uid, size``."""
    before = sources.filter("extra > 0").select("sid", "extra", F.lit(0).cast("long").alias("taken"))
    shift = HASH_BITS
    while True:
        shift = max(0, shift - bin_bits)
        binned = rows.filter("size > 0").withColumn("bin", F.shiftright("h", shift))
        sums = binned.groupBy("sid", "bin").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        ends = materialize(_cut(sums, before, "bin", ["bin"]), "mix-ends")
        most = ends.agg(F.max("n")).first()[0] or 0
        rows = binned.join(ends.select("sid", "bin"), ["sid", "bin"]).drop("bin")
        before = ends.select("sid", "extra", "taken")
        if most <= end_rows or shift == 0:
            break
        rows = materialize(rows, "mix-open")
    last = rows.select("sid", "h", "uid", F.struct("h", "uid").alias("end"), F.col("size").alias("words"), F.lit(1).alias("n"))
    found = _cut(last, before, "end", ["h", "uid"])
    return found.select("sid", "end", (F.col("extra") - F.col("taken")).alias("part"))


def mix(docs: DataFrame, keep: list[str] | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
        max_epochs: float = MAX_EPOCHS, seed: str = SEED, bin_bits: int = BIN_BITS, end_rows: int = END_ROWS) -> DataFrame:
    """Per input row: ``row`` (struct of the columns ``keep``, by default all), ``size``,
    ``source_size``, ``target`` of its source, ``epochs`` (whole repetitions) and ``taken``
    (words of all its repetitions; what exceeds ``epochs * size`` is the fractional one)."""
    names = docs.columns if keep is None else keep
    base = materialize(docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("source"), n_words(F.col("text")).alias("size"),
        order_hash(seed).alias("h"), F.monotonically_increasing_id().alias("uid")), "mix-rows")
    sources = materialize(source_table(base, weights, share, max_epochs), "mix-targets")
    with_sid = base.select("source", "size", "h", "uid").join(
        sources.filter("extra > 0").select("sid", F.col("source").alias("s")), F.col("source").eqNullSafe(F.col("s")))
    ends = repetition_ends(with_sid.select("sid", "h", "uid", "size"), sources, bin_bits, end_rows)
    plan = materialize(sources.join(ends, "sid", "left").withColumnRenamed("source", "s"), "mix-plan")
    here, end = F.struct("h", "uid"), F.col("end")
    fraction = F.when(here < end, F.col("size")).when(here == end, F.col("part")).otherwise(0)
    return base.join(plan, F.col("source").eqNullSafe(F.col("s"))).select(
        "row", "size", "source_size", "target", F.col("whole").alias("epochs"),
        (F.col("whole") * F.col("size") + F.coalesce(fraction, F.lit(0))).cast("long").alias("taken"))


def repetitions(mixed: DataFrame) -> DataFrame:
    """The mix itself: ``row``, ``epoch`` (from 0) and ``n_words`` (the leading words of the
    text that this repetition takes: all of them but in a fractional repetition's last
    document)."""
    words = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("taken") - 1) / F.col("size")).cast("long")),
                        lambda i: F.struct(i.alias("epoch"), F.least(F.col("size"), F.col("taken") - i * F.col("size"))
                                           .alias("n_words")))
    return mixed.filter("taken > 0").select("row", F.explode(words).alias("e")).select("row", "e.epoch", "e.n_words")
