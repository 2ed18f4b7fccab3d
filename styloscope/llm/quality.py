"""Operator 3: quality rules as a short-circuit cascade (DataFrame functions only).

A rule is a Column that is true when a text is rejected. On a sample the cascade measures what each rule costs (its
run time over the sample, less that of reading it) and what share it rejects, orders the rules by rejection per
cost, and evaluates them as one CASE: a document leaves at its first rejecting rule and the dear rules see only what
the cheap ones kept. The verdict does not depend on the order, only the work does.

All statistics of a document come from its own row; nothing is shuffled.

Edge cases: a null text has no words and is rejected (fewer than ten words), as is an empty one; null, equal or
repeated doc_ids do not matter, each row is judged on its own; an empty table keeps the declared rule order; columns
of any other name are carried through ``keep_good`` untouched.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from styloscope.llm.common import materialise

#: Rows (expected) that costs and rejection shares are measured on.
SAMPLE_ROWS = 2000
WINDOW = 5
SPACES = "[ \\t-\\r]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES + "+"), "")


def lines_of(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike("[^ \\t-\\r]"))


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def word_chars(text: Column) -> Column:
    for space in " \t\n\x0b\f\r":
        text = F.replace(text, F.lit(space), F.lit(""))
    return F.char_length(text).cast("long")


def n_symbols(text: Column) -> Column:
    return count_of(text, "[#*$%&|<>]")


def n_dup_lines(text: Column) -> Column:
    return let(lines_of(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _windows(words: Column) -> Column:
    """A 64-bit hash for each run of WINDOW words, in order."""
    starts = F.slice(words, 1, F.size(words) - (WINDOW - 1))
    return F.transform(starts, lambda w, k: F.xxhash64(w, *[F.get(words, k + n) for n in range(1, WINDOW)]))


def _covered(windows: Column) -> Column:
    """Words inside the windows that occur twice or more: the union of [p, p + WINDOW) over their positions p."""
    def repeated(pairs: Column) -> Column:
        same = lambda pair, k: F.coalesce(F.get(pairs, k)["h"] == pair["h"], F.lit(False))
        found = F.filter(pairs, lambda pair, k: same(pair, k - 1) | same(pair, k + 1))
        return F.array_sort(F.transform(found, lambda pair: pair["p"]))

    pairs = F.array_sort(F.transform(windows, lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
    positions = let(pairs, repeated)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(
        positions, start,
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).cast("long").alias("n"),
                                p.alias("last")),
        lambda acc: acc["n"])


def n_repeat_words(words: Column) -> Column:
    """Words in windows of five words found twice or more in the text, from the words' hashes (a stored column)."""
    counted = let(_windows(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long"))
                  .otherwise(_covered(h)))
    return F.when(F.size(words) > WINDOW, counted).otherwise(F.lit(0).cast("long"))


def n_adjacent_repeats(words: Column) -> Column:
    """Words equal to the word before them, from the words' hashes (a stored column)."""
    return F.size(F.filter(words, lambda w, k: F.coalesce(F.get(words, k - 1) == w, F.lit(False))))


#: What rules are made of: statistics of the text and of the hashes of its words (both stored columns).
STATISTICS: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda text, words: F.size(words).cast("long"),
    "word_chars": lambda text, words: word_chars(text),
    "n_symbols": lambda text, words: n_symbols(text),
    "n_lines": lambda text, words: F.size(lines_of(text)).cast("long"),
    "n_dup_lines": lambda text, words: n_dup_lines(text),
    "n_upper": lambda text, words: count_of(text, "[A-Z]"),
    "n_exclamations": lambda text, words: (F.char_length(text) - F.char_length(F.replace(
        text, F.lit("!"), F.lit("")))).cast("long"),
    "n_adjacent_repeats": lambda text, words: n_adjacent_repeats(words).cast("long"),
    "n_repeat_words": lambda text, words: n_repeat_words(words),
}


@dataclass(frozen=True)
class Rule:
    """``reject`` gets a function from a statistic's name to its Column and is true for a text to be dropped."""

    name: str
    reject: Callable[[Callable[[str], Column]], Column]


#: Ratios are compared in integers, so that every engine agrees.
RULES = [
    Rule("few_words", lambda t: t("n_words") < 10),
    Rule("symbols", lambda t: 10 * t("n_symbols") > t("n_words")),
    Rule("word_length", lambda t: (t("word_chars") < 2 * t("n_words")) | (t("word_chars") > 15 * t("n_words"))),
    Rule("upper_case", lambda t: 10 * t("n_upper") > 3 * t("word_chars")),
    Rule("exclamations", lambda t: 5 * t("n_exclamations") > t("n_words")),
    Rule("duplicate_lines", lambda t: 10 * t("n_dup_lines") > 4 * t("n_lines")),
    Rule("adjacent_repeats", lambda t: 10 * t("n_adjacent_repeats") > 3 * t("n_words")),
    Rule("repeated_windows", lambda t: 100 * t("n_repeat_words") > 20 * t("n_words")),
]


def computed(name: str) -> Column:
    """The statistic as an expression over text and words, evaluated only where a rule is reached."""
    return STATISTICS[name](F.col("text"), F.col("words"))


def with_words(docs: DataFrame) -> DataFrame:
    """The input row as ``row`` beside ``text`` (null: empty) and ``words``, its words' hashes, for the rules.

    A filter over rules would be pushed below the projection that stores the words, and they would be split anew for
    every word that a rule looks at. The row number, which is always >= 0 but not deterministic, keeps them stored.
    """
    text = F.coalesce("text", F.lit(""))
    hashes = F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w))
    return docs.select(F.struct("*").alias("row"), text.alias("text")).withColumn(
        "words", F.when(F.monotonically_increasing_id() >= 0, hashes))


def ordered_rules(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejection per cost, both measured on a random sample of about ``sample_rows`` documents."""
    rules = RULES if rules is None else rules
    total = docs.count()
    if not total:
        return list(rules)
    texts = docs.select("text").sample(fraction=min(1.0, sample_rows / total), seed=3)
    sample = with_words(materialise(texts, "quality-sample"))

    def run(verdict: Column) -> tuple[float, float]:
        seconds, share = [], 0.0
        for _ in range(2):
            began = time.monotonic()
            share = sample.agg(F.avg(verdict.cast("int"))).first()[0] or 0.0
            seconds.append(time.monotonic() - began)
        return min(seconds), share

    idle, _ = run((F.size("words") < 0) | (F.char_length("text") < 0))
    measured = {rule.name: run(rule.reject(computed)) for rule in rules}
    rank = {name: share / max(seconds - idle, 1e-3) for name, (seconds, share) in measured.items()}
    return sorted(rules, key=lambda rule: -rank[rule.name])


def accepted(rules: list[Rule], statistic: Callable[[str], Column] = computed) -> Column:
    """CASE over the rules in their order: false at the first that rejects."""
    verdict = F
    for rule in rules:
        verdict = verdict.when(rule.reject(statistic), F.lit(False))
    return verdict.otherwise(F.lit(True)) if rules else F.lit(True)


def keep_good(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Rows of ``docs`` that no rule rejects, with their columns; statistics are computed as rules are reached."""
    return with_words(docs).filter(accepted(ordered_rules(docs, rules))).select("row.*")


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def assess(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Base statistics of every document and the cascade's verdict (kept), which takes the base from its columns."""
    base = with_words(docs).select(F.col("row.doc_id").alias("doc_id"), "text", "words",
                                   *[computed(name).alias(name) for name in BASE])
    verdict = accepted(ordered_rules(docs, rules), lambda name: F.col(name) if name in BASE else computed(name))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return base.select("doc_id", *BASE, failed.alias("base_failed"), (~failed & verdict).alias("kept"))
