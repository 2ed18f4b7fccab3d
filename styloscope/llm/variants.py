"""Operator 12: spelling variant grouping by pivotal grams.

Words of the corpus are counted, and each word is joined with the words that differ from it by one inserted, deleted or
replaced code point. Grams are a word's bigrams with their positions, in the global order of (number of words' grams,
gram). The prefix of a word is its three first grams in that order, with all grams equal to the third; its pivots are the
two disjoint grams of the prefix that together are rarest, found by dynamic programming over positions.

One edit spoils at most one of two disjoint grams, so one pivot of each word is also a gram of its near words; and of two
words, the one whose prefix ends first has its pivots, if kept, in the other's prefix. So it is enough to index the
pivots and to look up the other words' prefix grams. Position limits: an edit right of a kept gram leaves its place from the
left and all text before it, an edit left of it its place from the right and all text after it. A gram is therefore
indexed twice, with the text on either side, and only words that agree there become candidates; Levenshtein distance one
is then tested on each.

A word's form is its near word of largest count, if that is ``ratio`` times its own at least; roots follow forms to the last by
pointer doubling (counts grow by the ratio at each step, so a few rounds are enough).

Scale: texts are read once; each task adds up its words in a table of bounded size before the shuffle. The order of
grams is the one thing broadcast: an alphabet of 26 + 64 letters has at most 8,100 bigrams. Candidates are joined by (gram,
text on one side); a frequent word beginning is seldom a pivot, since pivots are the rarest grams, and adaptive
execution splits a key that still has many rows.

Edge cases: null and empty texts have no words; a null doc_id is written as nothing in the hashed text; a word that
loses its only code point is none; repeated rows count again; an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from styloscope.llm.common import materialise, prepare, stream

RUN = re.compile("[a-z\u00c0-\u00ff]+")  # for texts that are lower-cased in A-Z
#: Distinct words that a task keeps before it hands its counts on.
TALLY = 200_000
SPOIL = 199
Q = 2


def spoiled(doc_id, run: str) -> str:
    """The run, without one code point where SPOIL divides the crc32 of ``<doc_id>:<run>``."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run[:h % len(run)] + run[h % len(run) + 1:] if h % SPOIL == 0 else run


def word_counts(docs: DataFrame, least_chars: int = 6, least_n: int = 5) -> DataFrame:
    """(word, n): words of ``least_chars`` code points and ``least_n`` occurrences at least."""

    def count(batches: Iterator[tuple]) -> Iterator[tuple]:
        tally: Counter = Counter()
        for ids, texts in batches:
            for doc_id, text in zip(ids, texts):
                lowered = (text or "").encode().lower().decode()  # bytes are lower-cased in A-Z only
                for run, k in Counter(RUN.findall(lowered)).items():
                    word = spoiled(doc_id, run)
                    if len(word) >= least_chars:
                        tally[word] += k
                if len(tally) > TALLY:
                    yield from tally.items()
                    tally.clear()
        yield from tally.items()

    counts = stream(docs.select("doc_id", "text"), "word string, n long", count)
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)


def grams(word: str) -> list[tuple[str, int]]:
    return [(word[p:p + Q], p) for p in range(len(word) - Q + 1)]


def prefix_grams(word: str, order: dict[str, int]) -> list[tuple[str, int]]:
    """The Q + 1 first grams in the global order, and all that equal the last of them."""
    ranked = sorted(grams(word), key=lambda g: (order[g[0]], g[1]))
    last = order[ranked[min(Q, len(ranked) - 1)][0]]
    return [g for g in ranked if order[g[0]] <= last]


def pivots(prefix: list[tuple[str, int]], cost: dict[str, int]) -> list[tuple[str, int]]:
    """Two disjoint grams of the prefix with the least sum of ``cost`` (one if no two are disjoint).

    Going through positions, ``best`` is the cheapest gram that ends before the current one begins.
    """
    by_place = sorted(prefix, key=lambda g: g[1])
    best, chosen, behind = None, None, 0
    for gram, p in by_place:
        while by_place[behind][1] + Q <= p:
            if best is None or cost[by_place[behind][0]] < cost[best[0]]:
                best = by_place[behind]
            behind += 1
        if best is not None and (chosen is None or cost[best[0]] + cost[gram] < cost[chosen[0][0]] + cost[chosen[1][0]]):
            chosen = best, (gram, p)
    return list(chosen) if chosen else by_place[:1]


def sides(word: str, p: int) -> tuple[str, str]:
    """A gram with the text before it, and with the text after it: one of them outlives an edit outside the gram."""
    return "<" + word[:p + Q], ">" + word[p:]


def gram_order(words: DataFrame) -> tuple[dict[str, int], dict[str, int]]:
    """Rank of every bigram by (number of grams, gram), and that number; at most 90 * 90 rows."""
    places = F.sequence(F.lit(1), F.char_length("word") - (Q - 1))
    counted = (words.select(F.explode(F.transform(places, lambda p: F.substring(F.col("word"), p, F.lit(Q)))).alias("gram"))
               .groupBy("gram").count().collect())
    ranked = sorted((r["count"], r.gram) for r in counted)
    return {g: k for k, (_, g) in enumerate(ranked)}, {g: c for c, g in ranked}


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b, a_n, b_n), a < b: words at Levenshtein distance one, each pair once. ``words`` has at least Q * 2 + 1 letters each."""
    order, cost = gram_order(words)

    def index(batches: Iterator[tuple]) -> Iterator[tuple]:
        for columns in batches:
            for word, n in zip(*columns):
                prefix = prefix_grams(word, order)
                last = max(order[g] for g, _ in prefix)
                chosen = set(pivots(prefix, cost))
                for g in prefix:
                    for side in sides(word, g[1]):
                        yield side, word, n, last, g in chosen

    entries = materialise(stream(words.select("word", "n"), "side string, word string, n long, last int, pivot boolean",
                                 index), "variant-grams")
    left = entries.filter("pivot").select("side", F.col("word").alias("s"), F.col("n").alias("s_n"),
                                          F.col("last").alias("s_last"))
    right = entries.select("side", F.col("word").alias("r"), F.col("n").alias("r_n"), F.col("last").alias("r_last"))
    candidates = left.join(right, "side").filter(
        (F.col("s_last") <= F.col("r_last")) & (F.abs(F.char_length("s") - F.char_length("r")) <= 1)
        & (F.col("s") != F.col("r")) & (F.levenshtein("s", "r", 1) == 1))
    first = F.col("s") < F.col("r")
    return candidates.select(F.least("s", "r").alias("a"), F.greatest("s", "r").alias("b"),
                             F.when(first, F.col("s_n")).otherwise(F.col("r_n")).alias("a_n"),
                             F.when(first, F.col("r_n")).otherwise(F.col("s_n")).alias("b_n")).distinct()


def forms(words: DataFrame, pairs: DataFrame, ratio: int = 5) -> DataFrame:
    """``words`` with n_near, form and form_n."""
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))).alias("x"))
    best = (both.select("x.*").groupBy("word")
            .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best")))
    has = -F.col("best.m") >= ratio * F.col("n")
    return words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.m")).alias("form_n"))


def roots(formed: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: forms followed to the last, twice as far in each round."""
    links = materialise(formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "variant-links")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = links.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                     F.col("further").isNotNull().alias("moved"))
        links = materialise(step, "variant-links")
        if links.filter("moved").isEmpty():
            return links.drop("moved")
        links = links.drop("moved")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for every counted word of ``docs``."""
    prepare(docs.sparkSession)
    words = materialise(word_counts(docs), "variant-words")
    formed = materialise(forms(words, near_pairs(words)), "variant-forms")
    return formed.join(roots(formed), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
