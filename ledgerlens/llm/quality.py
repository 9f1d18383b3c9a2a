"""Quality rules as a bitmask ledger (DataFrame functions only).

Every rule is evaluated once per document. The ledger stores the measurements
and one failure bit per rule; versioned policies are masks over these bits, so
applying another policy or computing an ablation never touches the texts again.

Defined results: a null or empty text has zero words (it fails ``few_words``);
null ids and repeated rows are kept as rows of their own; an empty table gives an
empty ledger; extra columns of the input are not carried.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import let

WINDOW = 5                                  # words in a repeat window
WHITE = " \t\n\x0b\x0c\r"
SPLIT = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"


class Rule(NamedTuple):
    """Fails where ``factor * measure`` is below/above ``bound`` (times another measure)."""
    factor: int
    measure: str
    sign: str
    bound: int
    other: str | None = None

    def column(self, of) -> Column:
        left, right = self.factor * of(self.measure), F.lit(self.bound) * (of(self.other) if self.other else F.lit(1))
        return left < right if self.sign == "<" else left > right

    def sql(self) -> str:
        return f"{self.factor} * {self.measure} {self.sign} {self.bound}" + (f" * {self.other}" if self.other else "")


# The position of a rule is its bit.
RULES: dict[str, Rule] = {
    "few_words": Rule(1, "n_words", "<", 10),
    "repeated_words": Rule(100, "n_repeat_words", ">", 20, "n_words"),
    "symbols": Rule(10, "n_symbols", ">", 3, "n_words"),
    "duplicate_lines": Rule(100, "n_dup_lines", ">", 60, "n_lines"),
    "short_words": Rule(10, "word_chars", "<", 25, "n_words"),
    "long_words": Rule(1, "word_chars", ">", 20, "n_words"),
    "shouting": Rule(100, "n_upper", ">", 50, "word_chars"),
    "stutter": Rule(100, "n_stutter", ">", 50, "n_words"),
}
BASE = ("few_words", "repeated_words")

# Versioned policies: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "symbols", "duplicate_lines", "short_words", "long_words"),
    "v2": (*BASE, "symbols", "duplicate_lines", "short_words", "long_words", "shouting", "stutter"),
}
CURRENT = "v2"


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def policy_mask(policy: str) -> int:
    return sum(bit(r) for r in POLICIES[policy])


def _repeat_words(words: Column) -> Column:
    """Words inside a WINDOW-word window that occurs twice or more in the row."""
    def windows(w):
        return F.when(F.size(w) >= WINDOW, F.transform(
            F.sequence(F.lit(0), F.size(w) - WINDOW),
            lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WINDOW)])))

    def covered(h):
        def spans(pairs):
            same = F.filter(pairs, lambda x, k: (x["h"] == F.get(pairs, k - 1)["h"])
                            | (x["h"] == F.get(pairs, k + 1)["h"]))
            starts = F.sort_array(F.transform(same, lambda x: x["i"]))
            return let(starts, lambda q: F.aggregate(
                F.transform(q, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(q, k + 1) - p, F.lit(WINDOW)))),
                F.lit(0).cast("long"), lambda a, x: a + x))
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(ordered, spans))

    return F.coalesce(let(windows(words), covered), F.lit(0)).cast("long")


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def measures(text: Column) -> Column:
    """A struct of everything the rules read. Words and lines are bound once per row: a
    later filter on the struct cannot make Spark split the text again per element."""
    def of_words(t, w, lines):
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            _without(t, WHITE).cast("long").alias("word_chars"),
            (F.length(t) - _without(t, SYMBOLS)).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.length(t) - _without(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long").alias("n_upper"),
            F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))).cast("long").alias("n_stutter"))

    def of_text(t):
        words = F.filter(F.split(t, SPLIT), lambda w: w != "")
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
        return let(words, lambda w: let(lines, lambda x: of_words(t, w, x)))

    return let(F.coalesce(text, F.lit("")), of_text)


def fail_mask(of) -> Column:
    """Every rule evaluated once on the measurements ``of(name)``: bit i is set where rule i fails."""
    return sum((F.when(rule.column(of), F.lit(bit(r))).otherwise(F.lit(0)) for r, rule in RULES.items()),
               F.lit(0)).cast("long")


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements plus ``fail_mask``."""
    rows = docs.select("doc_id", measures(F.col("text")).alias("m")).select("doc_id", "m.*")
    return rows.withColumn("fail_mask", fail_mask(F.col))


def apply_policy(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Adds ``base_failed``, ``kept`` and ``policy`` to ledger rows."""
    hit = lambda p: F.col("fail_mask").bitwiseAND(F.lit(policy_mask(p))) != 0
    return rows.withColumns({"base_failed": hit("base"), "kept": ~(hit("base") | hit(policy)),
                             "policy": F.lit(policy)})


def ablation(rows: DataFrame) -> DataFrame:
    """Per policy and rule: documents failing the rule, rejected by this rule alone
    (what dropping it would give back), and kept by the policy. The ledger is first
    reduced to one row per distinct mask, at most 2**len(RULES)."""
    per_mask = rows.groupBy("fail_mask").agg(F.count("*").alias("n"))
    cases = F.explode(F.array(*[
        F.struct(F.lit(p).alias("policy"), F.lit(policy_mask(p)).cast("long").alias("pm"),
                 F.lit(r).alias("rule"), F.lit(bit(r)).cast("long").alias("rb"))
        for p, rules in POLICIES.items() for r in rules]))
    m, pm, rb = F.col("fail_mask"), F.col("c.pm"), F.col("c.rb")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).alias
    return (per_mask.select("*", cases.alias("c")).groupBy(F.col("c.policy").alias("policy"), F.col("c.rule").alias("rule"))
            .agg(total(m.bitwiseAND(rb) != 0)("n_failed"), total(m.bitwiseAND(pm) == rb)("n_only_this_rule"),
                 total(m.bitwiseAND(pm) == 0)("n_kept"), F.bit_or("fail_mask").alias("bits_seen")))


def keep_passing(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The input rows that pass ``policy``, all columns unchanged. The ledger's failure bits
    are a projection of the row itself, so nothing is shuffled; the policy is a mask on them."""
    bits = let(measures(F.col("text")), lambda m: fail_mask(lambda c: m[c]))
    return docs.filter(bits.bitwiseAND(F.lit(policy_mask(policy))) == 0)
