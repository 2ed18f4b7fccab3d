"""Built-in token annotator as Column expressions.

A stand-in for a statistical tagger (README, "Annotations"): closed-class words are looked up in a
literal map (a JVM hash lookup, no join), open-class words get a tag from suffix rules. Every function
takes a token Column, so it works on an exploded token column and inside ``transform`` lambdas alike.
A caller with a real tagger joins its own table on ``(problem_id, sent_idx, tok_idx)`` instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from styloscope.functions import lexicons as lx

_CLOSED = lx.closed_class_rows()
_STOP = lx.stopwords()


def is_alpha(tok) -> Column:
    return tok.rlike(r"^\p{L}+$")


def is_punct(tok) -> Column:
    return tok.rlike(r"^\p{P}+$")


def is_word(tok) -> Column:
    return tok.rlike(r"^[\p{L}\p{M}\p{N}]")


def is_upper(tok) -> Column:
    return (tok == F.upper(tok)) & (tok != F.lower(tok))


def is_stop(tok) -> Column:
    return F.lower(tok).isin(_STOP)


_CLOSED_BY_TAG: dict[str, list[str]] = {}
for _w, _t in _CLOSED:
    _CLOSED_BY_TAG.setdefault(_t, []).append(_w)


# Open-class suffixes (the rules of lexicons.OPEN_CLASS_RULES written as suffix tests, so a tag costs
# one regex instead of six: the word must be all letters and longer than the suffix).
_SUFFIX_TAGS = [("ADV", ["ly"]), ("VERB", ["ing", "ed"]),
                ("ADJ", ["ous", "ful", "ive", "able", "ible", "less", "ish", "ical"])]


def _ends(low: Column, suffixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.endswith(low, F.lit(x)) & (F.length(low) > len(x)) for x in suffixes])


def upos_lower(low: Column) -> Column:
    """Universal POS tag of an already-lowercased token.

    Closed-class lookup (one ``isin`` per class, each a hash-set test; a word belongs to exactly one
    class), then the suffix rules for alphabetic words, then number / punctuation / symbol, else
    NOUN. Inside ``transform`` lambdas Spark shares no subexpressions, so callers lowercase once.
    """
    out = None
    for tag, words in _CLOSED_BY_TAG.items():
        out = F.when(low.isin(words), F.lit(tag)) if out is None else out.when(low.isin(words), F.lit(tag))
    open_class = None
    for tag, suffixes in _SUFFIX_TAGS:
        cond = _ends(low, suffixes)
        open_class = F.when(cond, F.lit(tag)) if open_class is None else open_class.when(cond, F.lit(tag))
    out = out.when(low.rlike(r"^\p{L}+$"), open_class.otherwise(F.lit("NOUN")))  # one regex per word
    out = out.when(~is_word(low), F.when(is_punct(low), F.lit("PUNCT")).otherwise(F.lit("SYM")))
    out = out.when(low.rlike(r"^\p{N}+$"), F.lit("NUM"))
    return out.otherwise(F.lit("NOUN"))


def upos(tok) -> Column:
    return upos_lower(F.lower(tok))


def lemma_lower(low: Column) -> Column:
    """Lemma of an already-lowercased token: suffix rules for alphabetic, non-stop words longer than 4."""
    out = F.when(low.isin(_STOP) | ~is_alpha(low) | (F.length(low) <= 4), low)
    for pattern, repl in lx.LEMMA_RULES:
        out = out.when(low.rlike(pattern), F.regexp_replace(low, pattern, repl))
    return out.otherwise(low)


def lemma(tok) -> Column:
    return lemma_lower(F.lower(tok))


def is_entity_token(tok, tok_idx) -> Column:
    """Capitalised alphabetic token not at sentence start (entity runs are built from these)."""
    return (tok_idx > 0) & is_alpha(tok) & tok.rlike(r"^\p{Lu}")


def entity_spans(tokens) -> Column:
    """Runs of consecutive entity tokens, joined by a space, in order (in-row, no shuffle)."""
    marked = F.transform(tokens, lambda t, i: F.when(is_entity_token(t, i), t).otherwise(F.lit("\u0001")))
    # character-class quantifiers only: Java's regex recursion on repeated groups overflows on long lines
    runs = F.split(F.array_join(marked, " "), r"[ \x{0001}]*\x{0001}[ \x{0001}]*")
    return F.filter(runs, lambda r: F.length(r) > 0)
