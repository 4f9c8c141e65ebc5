"""Quality rules as learned decision lists.

Sequential covering: one rule at a time is grown as a conjunction of threshold conditions on document
statistics, pruned on rows that growing did not see, and kept only if it is precise there; the rows it
covers are then set aside. The rules become one ordered conditional expression in Spark. Scoring uses
built-in functions only and needs no shuffle: one row in, one row out.

Defined cases: a null or empty text has no words, all its counts are 0, it fails the base rule. Repeated rows
are judged each on its own. An empty table gives an empty result; without labelled rows, or with labels of one
class, the list has no rule and the base rule decides alone. Other columns of the input stay untouched;
where one bears the name of a result column, ``judge`` replaces it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baseloom.llm.registry import WORD, let, once, query, table

# Bound of the labelled rows that the fit reads; chosen by hash, so reruns agree.
TRAINING_ROWS = 8192
WINDOW = 5
SYMBOLS = "#*$%&|<>"

FEATURES = {
    "words": lambda s: s["n_words"].cast("double"),
    "mean_word": lambda s: s["word_chars"] / F.greatest(s["n_words"], F.lit(1)),
    "symbol_share": lambda s: s["n_symbols"] / F.greatest(s["word_chars"], F.lit(1)),
    "dup_line_share": lambda s: s["n_dup_lines"] / F.greatest(s["n_lines"], F.lit(1)),
    "repeat_share": lambda s: s["n_repeat_words"] / F.greatest(s["n_words"], F.lit(1)),
    "distinct_share": lambda s: s["n_distinct_words"] / F.greatest(s["n_words"], F.lit(1)),
    "upper_share": lambda s: s["n_upper"] / F.greatest(s["word_chars"], F.lit(1)),
    "digit_share": lambda s: s["n_digits"] / F.greatest(s["word_chars"], F.lit(1)),
    "mark_share": lambda s: s["n_marks"] / F.greatest(s["n_words"], F.lit(1)),
}


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _repeat_words(words: Column) -> Column:
    """Words inside five-word windows that occur twice or more in the text, the first occurrence included."""

    def covered(pairs):
        twice = F.transform(
            pairs,
            lambda x, k: F.when((F.get(pairs, k - 1)["h"] == x["h"]) | (F.get(pairs, k + 1)["h"] == x["h"]), x["i"]),
        )
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(
            F.sort_array(F.filter(twice, lambda i: i.isNotNull())),
            start,
            lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")),
            lambda a: a["n"],
        )

    def by_hash(h):
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, covered))

    def windows(w):
        hashes = F.transform(
            F.sequence(F.lit(0), F.size(w) - WINDOW),
            lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]),
        )
        return F.when(F.size(w) < WINDOW + 1, F.lit(0)).otherwise(let(hashes, by_hash))

    return let(words, windows)


def statistics(text: Column) -> Column:
    """All statistics of one text, as a struct of longs."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda s: s.rlike(WORD))

    def build(words):
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
            _count(text, SYMBOLS).cast("long").alias("n_symbols"),
            let(lines, lambda v: F.size(v) - F.size(F.array_distinct(v))).cast("long").alias("n_dup_lines"),
            F.size(lines).cast("long").alias("n_lines"),
            _repeat_words(words).cast("long").alias("n_repeat_words"),
            F.size(F.array_distinct(words)).cast("long").alias("n_distinct_words"),
            _count(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_upper"),
            _count(text, "0123456789").cast("long").alias("n_digits"),
            _count(text, "!?@=_{}[]/\\~^").cast("long").alias("n_marks"),
        )

    return let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), build)


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < 10) | (100 * stats["n_repeat_words"] > 20 * stats["n_words"])


@dataclass
class Rule:
    """A conjunction: (feature, '<=' or '>', threshold) each."""

    conditions: list[tuple[str, str, float]]
    precision: float = 0.0
    covered: int = 0

    def holds(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(columns.values()))), dtype=bool)
        for name, sign, cut in self.conditions:
            out &= columns[name] <= cut if sign == "<=" else columns[name] > cut
        return out

    def expression(self, stats: Column) -> Column:
        out = F.lit(True)
        for name, sign, cut in self.conditions:
            value = FEATURES[name](stats)
            out = out & (value <= F.lit(float(cut)) if sign == "<=" else value > F.lit(float(cut)))
        return out


@dataclass
class DecisionList:
    """Ordered rules; the first that holds rejects the document, none keeps it."""

    rules: list[Rule] = field(default_factory=list)

    def fired(self, stats: Column) -> Column:
        """Number of the first rule that holds, from 1; 0 if none does."""
        out = F.lit(0)
        for number in range(len(self.rules), 0, -1):
            out = F.when(self.rules[number - 1].expression(stats), F.lit(number)).otherwise(out)
        return out


def fit_rules(
    columns: dict[str, np.ndarray],
    bad: np.ndarray,
    grow: np.ndarray,
    max_rules: int = 12,
    max_conditions: int = 4,
    cuts: int = 48,
    precision: float = 0.95,
    least: int = 8,
) -> DecisionList:
    """Sequential covering. ``grow`` marks the rows that rules are grown on; the others prune and accept them.

    A rule is accepted if at least ``least`` bad rows of the pruning part fall under it, with at least
    ``precision`` of all it covers there. Covering stops at the first rule that fails this.
    """
    left, out = np.ones(len(bad), dtype=bool), DecisionList()
    grid = {n: np.unique(np.quantile(v[grow], np.linspace(0, 1, cuts + 1))) if grow.any() else v[:0] for n, v in columns.items()}

    def gain(inside, before):
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        return -1.0 if not p else p * (np.log2(p / (p + n)) - before)

    while len(out.rules) < max_rules:
        now, conditions = grow & left, []
        if not (now & bad).any():
            break
        while len(conditions) < max_conditions and (now & ~bad).any():
            before = np.log2((now & bad).sum() / now.sum())
            best = (1e-9, None, None)
            for name, values in columns.items():
                for cut in grid[name]:
                    for sign in ("<=", ">"):
                        inside = now & (values <= cut if sign == "<=" else values > cut)
                        if (g := gain(inside, before)) > best[0]:
                            best = (g, (name, sign, float(cut)), inside)
            if best[1] is None:
                break
            conditions.append(best[1])
            now = best[2]
        if not conditions:
            break
        held, choice = ~grow & left, None
        for n in range(len(conditions), 0, -1):
            rule = Rule(conditions[:n])
            inside = held & rule.holds(columns)
            p, all_ = (inside & bad).sum(), inside.sum()
            worth = (2 * p - all_) / max(1, all_)
            if choice is None or worth > choice[0]:
                choice = (worth, rule, int(p), int(all_))
        _, rule, p, all_ = choice
        if p < least or p < precision * all_:
            break
        rule.precision, rule.covered = p / all_, all_
        out.rules.append(rule)
        left &= ~rule.holds(columns)
    return out


def learn(documents: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, id_column="doc_id", **options) -> DecisionList:
    """Fit a decision list on at most ``rows`` labelled documents; quality 0 is what rules should catch.

    Only these documents' statistics (ten numbers each) reach the driver. A document with several labels counts
    as bad if one of them is 0. Documents that the base rule rejects already are not learnt from.
    """
    sample = (
        labels.select(F.col(id_column).alias("k"), F.col("quality").alias("q"))
        .where("k is not null and q is not null")
        .groupBy("k")
        .agg(F.min("q").alias("q"))
        .orderBy(F.xxhash64("k"), "k")
        .limit(rows)
    )
    texts = documents.select(F.col(id_column).alias("k"), F.col("text").alias("t"))
    stats = (
        once(texts.join(F.broadcast(sample), "k"), "s", statistics(F.col("t")))  # at most `rows` narrow rows are sent
        .where(~base_failed(F.col("s")))
        .select("k", "q", (F.pmod(F.xxhash64("k", F.lit("part")), F.lit(3)) > 0).alias("grow"), *[f(F.col("s")).alias(n) for n, f in FEATURES.items()])
    )
    got = stats.limit(4 * rows).collect()
    if not got:
        return DecisionList()
    got.sort(key=tuple)
    columns = {n: np.array([r[n] for r in got], dtype=float) for n in FEATURES}
    bad = np.array([r["q"] == 0 for r in got])
    if bad.all() or not bad.any():
        return DecisionList()
    return fit_rules(columns, bad, np.array([r["grow"] for r in got]), **options)


def judge(documents: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """The input with its statistics, ``base_failed``, ``rule`` (0: none) and ``kept``."""
    out = once(documents, "stats", statistics(F.col(f"`{text}`")))
    stats = F.col("stats")
    return out.withColumns(
        {
            "base_failed": base_failed(stats),
            "rule": rules.fired(stats),
            "kept": ~base_failed(stats) & (rules.fired(stats) == 0),
        }
    )


@query("op5_quality_rules")
def op5_quality_rules(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    rules = learn(docs, table(spark, d, "labels"))
    return judge(docs, rules).select(
        "doc_id",
        *[F.col(f"stats.{n}").alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "base_failed",
        "kept",
        "rule",
    )
