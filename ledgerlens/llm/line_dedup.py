"""Line dedup over levelled sorted runs of line hashes (DataFrame functions only).

A run is a Parquet table of ``(h1, h2, n_docs)`` sorted by the 128-bit line hash: how many
documents of one or more batches hold a line with that key. A new batch is anti-joined
with the keys that a run already settles as common, so hot lines are written once, and adds
its other keys as one run of level 0; ``FANOUT`` runs of a level are compacted into one run of
the next, so a key is rewritten once per level and the number of runs stays logarithmic in the
number of batches. A corpus is dealt into ``FANOUT ** 2`` batches, which fill two levels and
end in a single run.

Only hashes and line positions are exchanged, and of the documents those that may have a
line to lose: a bitmap of their hashes, made on the executors and of a fixed size, splits the
input; all other documents pass without an exchange.

Defined results: a null or empty text is one empty line, kept; an empty key is
never dropped; every input row is a document of its own, repeated rows included
(the same line in two equal rows counts twice); null ids are ordinary values; an
empty table gives an empty result.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import let, materialize, scratch

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FANOUT = 4                    # runs of one level that are compacted into one
MIN_DOCS, MIN_CHARS = 10, 1   # a key in so many documents, of so many code points, is dropped
SIEVE_BITS = 24               # slots of the bitmap of documents with a line to lose: 2 MB in all
RUN_SCHEMA = "h1 long, h2 long, n_docs long"


def line_key(line: Column) -> Column:
    """The line without surrounding white space, A-Z folded."""
    return F.translate(F.trim(line, F.lit(WHITE)), UPPER, LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _row_keys() -> list[Column]:
    """What brings a line's verdict back to its row: id and text hash, so repeated ids
    with different texts stay apart and equal rows get equal answers."""
    return [F.xxhash64("doc_id").alias("k1"), F.xxhash64("text", F.length("text")).alias("k2")]


def line_table(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``k1, k2, uid, pos, h1, h2``: the 128-bit key hash of every line that can be dropped.
    ``uid`` tells rows apart, equal ones included; write the table before it is used twice."""
    # the row number comes before the explosion: beside it, it would number the lines
    rows = docs.select(*_row_keys(), F.monotonically_increasing_id().alias("uid"), "text")
    rows = rows.select("k1", "k2", "uid", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    long_enough = F.length(F.trim("line", F.lit(WHITE))) >= min_chars        # folding keeps lengths
    keyed = rows.filter(long_enough).select("k1", "k2", "uid", "pos", line_key(F.col("line")).alias("key"))
    return keyed.select("k1", "k2", "uid", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))


def line_counts(lines: DataFrame) -> DataFrame:
    """Documents per line hash of one batch. A document's repeats are merged first, which
    spreads a hot line over its documents; then each task adds up its part."""
    return lines.select("h1", "h2", "uid").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n_docs"))


class LineRuns:
    """The levelled runs, kept in a shared folder. ``levels[i]`` lists the paths of
    level i's runs; the listing is plain JSON, so a restarted driver goes on. A key that one
    run holds for ``min_docs`` documents is settled and not counted any further."""

    def __init__(self, spark: SparkSession, root: str | None = None, levels: list[list[str]] | None = None,
                 min_docs: int = MIN_DOCS):
        self.spark, self.root, self.min_docs = spark, root or scratch(spark, "line-runs"), min_docs
        self.levels: list[list[str]] = levels or []
        self.made = sum(len(x) for x in self.levels)

    def state(self) -> str:
        return json.dumps({"root": self.root, "levels": self.levels, "min_docs": self.min_docs})

    @classmethod
    def restore(cls, spark: SparkSession, state: str) -> LineRuns:
        return cls(spark, **json.loads(state))

    def _write(self, counts: DataFrame, level: int) -> str:
        path = f"{self.root}/level{level}-{self.made:06d}-{scratch(self.spark, 'x')[-8:]}"
        self.made += 1
        counts.sortWithinPartitions("h1", "h2").write.parquet(path)
        return path

    def _merged(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], RUN_SCHEMA)
        runs = self.spark.read.schema(RUN_SCHEMA).parquet(*paths)
        return runs if len(paths) == 1 else runs.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"))

    def add(self, lines: DataFrame) -> None:
        """Add the run of one batch's line table and compact every level that became full."""
        run, level = self._write(self.unsettled(line_counts(lines)), 0), 0
        while True:
            if len(self.levels) <= level:
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < FANOUT:
                return
            full, self.levels[level] = self.levels[level], []
            level += 1
            run = self._write(self._merged(full), level)

    def totals(self) -> DataFrame:
        return self._merged([p for level in self.levels for p in level])

    def unsettled(self, counts: DataFrame) -> DataFrame:
        """The counts of a batch without keys that some run settles: a merge anti-join on the
        line hash with the runs' common keys (a filter the runs' files are read with)."""
        paths = [p for level in self.levels for p in level]
        if not paths:
            return counts
        common = self.spark.read.schema(RUN_SCHEMA).parquet(*paths).filter(F.col("n_docs") >= self.min_docs)
        return counts.join(common.select("h1", "h2"), ["h1", "h2"], "left_anti")

    def unseen(self, lines: DataFrame) -> DataFrame:
        """Keys of a batch that no run holds: a merge anti-join on the line hash."""
        return line_counts(lines).join(self.totals(), ["h1", "h2"], "left_anti")

    def clean(self, docs: DataFrame, lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
        """The batch with ``row`` (a struct of the input columns), ``n_lines``, ``n_dropped``,
        the text's ``lines``, the kept line positions ``kept`` and their text ``kept_text``.

        Only hashes and positions travel to the runs. A hot key spreads over one row per
        line that holds it; the join is one whose large partitions Spark splits."""
        if min_docs > self.min_docs:
            raise ValueError(f"these runs count up to {self.min_docs} documents only")
        frequent = self.totals().filter(F.col("n_docs") >= min_docs).select("h1", "h2")
        hits = materialize(lines.join(frequent, ["h1", "h2"], "left_semi").groupBy("k1", "k2")
                           .agg(F.collect_set("pos").alias("dropped")), "line-hits")

        slot = F.pmod(F.xxhash64("k1", "k2"), F.lit(1 << SIEVE_BITS))
        word, bit = F.shiftright(slot, 6).alias("word"), slot.bitwiseAND(F.lit(63)).cast("int")
        sieve = hits.groupBy(word).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("mask"))
        keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_row_keys()).withColumn("word", word)
        # at most 2 ** (SIEVE_BITS - 6) rows of two numbers
        keyed = keyed.join(F.broadcast(sieve), "word", "left")
        touched = F.call_function("shiftrightunsigned", F.coalesce("mask", F.lit(0).cast("long")), bit).bitwiseAND(F.lit(1)) == 1

        text = F.coalesce(F.col("row.text"), F.lit(""))
        n_lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
        every = F.sequence(F.lit(0), (n_lines - 1).cast("int"))

        def rows(part, dropped, kept, kept_text):
            return part.select("row", n_lines.alias("n_lines"), F.coalesce(F.size(dropped), F.lit(0)).cast("long").alias("n_dropped"),
                               _lines(F.col("row.text")).alias("lines"), kept.alias("kept"), kept_text.alias("kept_text"))

        gone = F.col("dropped")
        kept = F.when(gone.isNull(), every).otherwise(F.array_except(every, gone))
        shorter = let(_lines(F.col("row.text")), lambda x: let(kept, lambda k: F.array_join(F.transform(k, lambda i: F.get(x, i)), "\n")))
        whole = rows(keyed.filter(~touched), F.array().cast("array<int>"), every, text)
        cut = rows(keyed.filter(touched).join(hits, ["k1", "k2"], "left"), F.coalesce(gone, F.array().cast("array<int>")), kept,
                   F.when(gone.isNull(), text).otherwise(shorter))
        return whole.unionByName(cut)


def drop_common_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
                      batches: list[DataFrame] | None = None) -> DataFrame:
    """Two steps over a corpus: every batch adds its run, then every document drops
    the lines whose key the runs count in ``min_docs`` documents or more. ``batches``
    lists the arrivals; by default the corpus is dealt into ``FANOUT ** 2`` of them by a hash
    of its rows."""
    spark = docs.sparkSession
    runs = LineRuns(spark, min_docs=min_docs)
    if batches:
        tables = [materialize(line_table(b, min_chars), "line-table") for b in batches]
        for t in tables:
            runs.add(t)
        return runs.clean(docs, reduce(DataFrame.unionByName, tables), min_docs)
    dealt = line_table(docs, min_chars).withColumn("batch", F.pmod("k2", F.lit(FANOUT ** 2)).cast("int"))
    path = scratch(spark, "line-table")
    dealt.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(dealt.schema).parquet(path)
    for i in range(FANOUT ** 2):
        runs.add(lines.filter(F.col("batch") == i))
    return runs.clean(docs, lines, min_docs)
