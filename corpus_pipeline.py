"""The corpus pipeline: five stages over ``documents``, each written as Parquet and
reread as the next one's input. A stage works on all its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import decontaminate, jaccard_join, line_dedup, quality, sentencepiece_scan
from ledgerlens.llm.common import materialize, read

SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80       # of the near-duplicate stage
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current quality policy rejects go."""
    return quality.keep_passing(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; ``n_chars`` follows the kept text.
    A document left without any text stays as an empty one."""
    clean = line_dedup.drop_common_lines(docs)
    cols = {c: F.col(f"row.`{c}`") for c in docs.columns}
    cols["text"] = F.when(F.col("row.text").isNotNull(), F.col("kept_text"))
    if "n_chars" in cols:
        cols["n_chars"] = F.length(cols["text"]).cast("long")
    return clean.select(*[v.alias(k) for k, v in cols.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the least id."""
    return jaccard_join.keep_one_per_component(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontaminate.remove_contaminated(docs, read(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents with their token ids, checked by decoding them again."""
    names = docs.columns
    done = sentencepiece_scan.round_trip(docs)
    kept = [F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c != "text"]
    return done.select(*kept, F.coalesce(F.size("ids"), F.lit(0)).alias("n_tokens"), "ids", "round_trip")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]

ORACLE_SQL = None   # the later stages have no SQL form; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
