"""String scalar functions as Column expressions (JVM-side, no Python UDFs).

Regexes use explicit classes so that Java regex (Spark) and RE2 (the SQL oracle) agree:
no look-around, ``\\p{..}`` classes instead of ``\\w``/``\\s``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from styloscope.functions import lexicons as lx

# Whitespace as Python's str.isspace understands it (tab..CR, FS..US, NEL, Unicode separators).
WS_CLASS = r"[ \t\n\x0B\f\r\x1C-\x1F\x85\p{Z}]"
# Token: a run of letters/marks/digits, or any single other non-space character.
TOKEN_REGEX = r"[\p{L}\p{M}\p{N}]+|[^ \t\n\x0B\f\r\x1C-\x1F\x85\p{Z}\p{L}\p{M}\p{N}]"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Strip leading/trailing whitespace (Unicode aware; Spark's trim only strips spaces)."""
    return F.regexp_replace(col_(c), rf"^{WS_CLASS}+|{WS_CLASS}+$", "")


def casefold(c) -> Column:
    return F.regexp_replace(F.lower(col_(c)), "ß", "ss")


def tokenize(c) -> Column:
    """Array of tokens of a string, in order."""
    return F.regexp_extract_all(col_(c), F.lit(TOKEN_REGEX), 0)


def ws_words(c) -> Column:
    """Whitespace-separated words of a string (``str.split()`` semantics)."""
    return F.filter(F.split(strip_ws(c), rf"{WS_CLASS}+"), lambda w: F.length(w) > 0)


def contains_any(c, phrases) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(col_(c), F.lit(p)) for p in phrases])


def starts_any(c, prefixes) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(col_(c), F.lit(p)) for p in prefixes])


def pattern_type(sentence) -> Column:
    """Rule-ordered pattern type on the stripped, lowercased sentence (0 = none)."""
    s = F.lower(strip_ws(sentence))
    rule2 = reduce(lambda a, b: a | b, [s.rlike(p) for p in lx.PATTERN2_REGEXES])
    return (F.when(starts_any(s, lx.PATTERN1_PREFIXES) | contains_any(s, lx.PATTERN1_PHRASES), 1)
            .when(rule2, 2)
            .when(contains_any(s, lx.PATTERN3_PHRASES) | starts_any(s, lx.PATTERN3_PREFIXES), 3)
            .when(starts_any(s, lx.PATTERN4_PREFIXES), 4)
            .otherwise(0))


def pattern_flags(pt) -> list[Column]:
    pt = col_(pt)
    return [(pt == k).cast("int").alias(f"flag_pattern_{k}") for k in (1, 2, 3, 4)] + [
        (pt > 0).cast("int").alias("flag_special_meta")]


def is_upper_word(w) -> Column:
    """``str.isupper``: has a cased character and no lowercase one."""
    return (w == F.upper(w)) & (w != F.lower(w))


def discourse_count(sentence) -> Column:
    low = F.lower(col_(sentence))
    return reduce(lambda a, b: a + b,
                  [F.contains(low, F.lit(m)).cast("int") for m in lx.DISCOURSE_MARKERS])


def sarcasm_marker(sentence) -> Column:
    return contains_any(F.lower(col_(sentence)), lx.SARCASM_MARKERS).cast("int")


def has_emoji(sentence) -> Column:
    s = col_(sentence)  # the exact class has many ranges, which are tested one by one for every character
    return F.when(s.rlike(lx.EMOJI_SPAN), s.rlike(lx.EMOJI_CLASS)).when(s.isNotNull(), F.lit(False)).cast("int")


def has_non_ascii(sentence) -> Column:
    return col_(sentence).rlike(r"[^\x00-\x7F]").cast("int")


def has_quoted_text(sentence) -> Column:
    q = f"[{lx.QUOTE_CHARS}]"
    return col_(sentence).rlike(f"{q}.+{q}").cast("int")


def rhetorical_question(sentence) -> Column:
    s = strip_ws(sentence)
    first = F.lower(F.get(ws_words(s), 0))
    return (F.endswith(s, F.lit("?")) & F.coalesce(first.isin(lx.RHETORICAL_FIRST_WORDS), F.lit(False))).cast("int")


def liwc_counts(sentence) -> list[Column]:
    return liwc_counts_of_words(ws_words(F.lower(col_(sentence))))


def liwc_counts_of_words(lower_words) -> list[Column]:
    """A15 over an array of lowercased whitespace words. Pass a column reference: higher-order
    functions do not share an argument expression, so an inline expression is recomputed per count."""
    def member_of(vals):
        return lambda w: w.isin(vals)
    return [F.size(F.filter(col_(lower_words), member_of(vals))).alias(name)
            for name, vals in lx.LIWC_CATEGORIES.items()]


def all_caps_count_of_words(words) -> Column:
    return F.size(F.filter(col_(words), lambda w: is_upper_word(w) & (F.length(w) > 2)))


def repeated_punct(sentence) -> Column:
    return col_(sentence).rlike(lx.REPEATED_PUNCT_REGEX).cast("int")


def markdown_emphasis(sentence) -> Column:
    return (F.contains(col_(sentence), F.lit("*")) | F.contains(col_(sentence), F.lit("_"))).cast("int")
