"""Quality rules as a short-circuit cascade, in DataFrame operations only.

A sample gives each rule's cost (time over the sample) and the rows it rejects; the rules are
then put in the order of rejection per cost among the rows that the rules before leave over.
A CASE over the rules stops at the first that rejects. The order never changes which rows are
kept, only which rule is named for a row that several would reject.

Defined results
* Null text: no word, no line, all measures 0. Words are runs of anything but ASCII blanks.
* Repeated rows are judged alone and alike; every row stays one row.
* Extra columns stay; own columns named like a measure or verdict are replaced.
* Empty table or sample: the given order of rules.
* Equal windows are told by a 64-bit hash of their eight words.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import WHITESPACE, bind, indexes, written

WINDOW = 8
SAMPLE_ROWS = 1000
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """`rejects` is a condition on a text column; the rule rejects rows where it is true."""

    name: str
    rejects: Column


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITESPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), WHITESPACE, "")).cast("long")


def symbol_count(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long")


def marked_count(text: Column, pattern: str) -> Column:
    """Characters of the class `pattern`, which must match runs of all other characters."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), pattern, "")).cast("long")


def full_lines(text: Column) -> Column:
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.filter(lines, lambda line: F.regexp_like(line, F.lit(r"[^\x20\x09-\x0D]")))


def duplicate_lines(text: Column) -> Column:
    return bind(full_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def repeated_words(text: Column, width: int = WINDOW) -> Column:
    """Words inside windows of `width` words that occur more than once in the text."""

    def covered(hashes: Column) -> Column:
        order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))

        def repeats(ordered: Column) -> Column:
            same = lambda x, i: (F.get(ordered, i - 1)["h"] == x["h"]) | (F.get(ordered, i + 1)["h"] == x["h"])
            places = F.transform(ordered, lambda x, i: F.when(same(x, i), x["at"]))
            return F.sort_array(F.filter(places, lambda p: p.isNotNull()))

        def total(places: Column) -> Column:
            step = lambda p, i: F.least(F.lit(width), F.coalesce(F.get(places, i + 1), p + width) - p)
            return F.aggregate(F.transform(places, step), F.lit(0), lambda a, x: a + x)

        return bind(bind(order, repeats), total)

    def count(words: Column) -> Column:
        windows = F.transform(
            indexes(1, F.size(words) - (width - 1)), lambda i: F.xxhash64(F.slice(words, i, width))
        )
        return bind(
            windows,
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)),
        )

    return bind(words_of(text), count).cast("long")


def stutters(text: Column) -> Column:
    """Words equal to the word before them."""
    return bind(
        words_of(text), lambda w: F.size(F.filter(F.transform(w, lambda x, i: F.get(w, i - 1) == x), lambda y: y))
    ).cast("long")


def base_rules(text: Column) -> list[Rule]:
    return [
        Rule("few_words", word_count(text) < 20),
        Rule("repeats", 100 * repeated_words(text) > 30 * word_count(text)),
    ]


def style_rules(text: Column) -> list[Rule]:
    return [
        Rule("symbols", 20 * symbol_count(text) > word_chars(text)),
        Rule("shouting", 2 * marked_count(text, r"\P{Lu}+") > word_chars(text)),
        Rule("exclamations", 2 * marked_count(text, "[^!]+") > word_count(text)),
        Rule("same_lines", bind(full_lines(text), lambda x: 2 * F.size(F.array_distinct(x)) < F.size(x))),
        Rule("stutter", 10 * stutters(text) > 3 * word_count(text)),
    ]


def cascade_order(docs: DataFrame, rules: list[Rule], rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejection per cost, estimated on a sample of about `rows` rows.

    The driver gets the times and, for each combination of verdicts, its number of rows.
    """
    share = min(1.0, rows / max(1, docs.count()))
    sample = written(docs.select("text").sample(share, seed=11), "rule-sample")
    verdicts = [F.coalesce(r.rejects, F.lit(False)).alias(f"r{i}") for i, r in enumerate(rules)]

    def seconds(column: Column) -> float:
        started = time.perf_counter()
        sample.agg(F.count_if(column)).collect()
        return time.perf_counter() - started

    seconds(F.col("text").isNull())
    idle = min(seconds(F.col("text").isNull()) for _ in range(2))
    costs = [max(1e-4, min(seconds(v) for _ in range(2)) - idle) for v in verdicts]
    seen = sample.select(*verdicts).groupBy(*(f"r{i}" for i in range(len(rules)))).count().collect()
    left, order = list(range(len(rules))), []
    while left:
        gain = {i: sum(s["count"] for s in seen if s[f"r{i}"]) / costs[i] for i in left}
        best = max(left, key=lambda i: (gain[i], -costs[i]))
        order.append(rules[best])
        left.remove(best)
        seen = [s for s in seen if not s[f"r{best}"]]
    return order


def first_rejection(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects, null if none; later rules aren't evaluated."""
    out = F.when(rules[0].rejects, F.lit(rules[0].name))
    for rule in rules[1:]:
        out = out.when(rule.rejects, F.lit(rule.name))
    return out


def judge(docs: DataFrame) -> DataFrame:
    """docs with the measures, base_failed and kept."""
    text = F.col("text")
    measured = docs.drop(*MEASURES, "base_failed", "kept").withColumns(
        {
            "n_words": word_count(text),
            "word_chars": word_chars(text),
            "n_symbols": symbol_count(text),
            "n_dup_lines": duplicate_lines(text),
            "n_repeat_words": repeated_words(text),
        }
    )
    order = cascade_order(docs, style_rules(text))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rejected = F.when(failed, F.lit("base")).otherwise(first_rejection(order))
    return measured.withColumns({"base_failed": failed, "kept": rejected.isNull()})


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that no rule rejects; only the rules up to the first rejection run on a row."""
    text = F.col("text")
    return docs.filter(first_rejection(cascade_order(docs, base_rules(text) + style_rules(text))).isNull())
