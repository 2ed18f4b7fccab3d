"""Operator 8: language identification by mixture inference.

A language is a distribution over hashed character trigrams, learned from the labelled rows. A document is a mixture
of languages: expectation-maximisation estimates the proportions from the trigram likelihoods, and the set of
languages grows one by one while the log-likelihood gains more than a penalty of ``PENALTY * log(trigrams)``.
A language can only raise the likelihood when its gradient at the present mixture exceeds one, which spares most runs.

Trigram counts are summed per task, then by Spark; the model has at most languages x BUCKETS numbers, whatever the
input, and travels to the tasks inside the closure.

Edge cases: null, empty and letterless texts are ``und`` with score 0 and are not learned from; rows with a null
label are not learned from; with nothing to learn from, every text is ``und``; ties go to the language that sorts
first; null doc_ids count as not held out; repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from styloscope.llm.common import held_out, prepare, stream

BUCKETS = 1 << 16
#: Added to every count.
SMOOTHING = 0.5
#: Log-likelihood that one more language must gain, times the log of the number of trigrams.
PENALTY = 3.0
ROUNDS = 30
#: Bound on the model: languages are labels, a handful to a few hundred.
MOST_LANGUAGES = 1000

_LETTER = re.compile(r"[^\W\d_]")
_PRIMES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_IS_LETTER = np.array([chr(c).isalpha() for c in range(1 << 16)])


def trigrams(text: str) -> np.ndarray:
    """Bucket of each character trigram of the lower-cased text; everything but letters is a space."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _IS_LETTER[np.minimum(codes, 0xFFFF)] | (codes > 0xFFFF)
    codes = np.where(letter, codes, np.uint32(32))
    inside = letter[:-2] | letter[1:-1] | letter[2:]
    mixed = codes[:-2] * _PRIMES[0] ^ codes[1:-1] * _PRIMES[1] ^ codes[2:] * _PRIMES[2]
    return (((mixed ^ (mixed >> 15)) * _PRIMES[0]) >> 16)[inside]


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def learn(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and the log-probabilities of buckets (BUCKETS x languages), from columns text and lang."""

    def count(batches) -> Iterator[tuple]:
        found: dict[str, np.ndarray] = {}
        for texts, langs in batches:
            for text, lang in zip(texts, langs):
                if has_letter(text):
                    if lang not in found:
                        found[lang] = np.zeros(BUCKETS, np.int64)
                    grams = trigrams(text)
                    if len(grams) > BUCKETS // 4:
                        found[lang] += np.bincount(grams, minlength=BUCKETS)
                    else:
                        np.add.at(found[lang], grams, 1)
        for lang, counts in found.items():
            for bucket in np.flatnonzero(counts).tolist():
                yield lang, bucket, int(counts[bucket])

    rows = labelled.filter("lang is not null and text is not null").select("text", "lang")
    summed = stream(rows, "lang string, bucket int, n long", count).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    langs: dict[str, np.ndarray] = {}
    for part in summed.toArrow().to_batches():  # at most MOST_LANGUAGES x BUCKETS rows
        lang, bucket, n = (c.to_numpy(zero_copy_only=False) for c in part.columns)
        for name in np.unique(lang):
            langs.setdefault(str(name), np.zeros(BUCKETS))[bucket[lang == name]] += n[lang == name]
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"{len(langs)} labels are not languages")
    names = sorted(langs)
    counts = np.array([langs[k] for k in names]).T.reshape(BUCKETS, len(names)) + SMOOTHING
    return names, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def mixture(grams: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    """Proportion of each language in a text with these buckets; languages outside the chosen set have 0."""
    if len(grams) > BUCKETS // 4:
        n_of = np.bincount(grams, minlength=BUCKETS)
        seen = np.flatnonzero(n_of)
        counts = n_of[seen].astype(np.float64)
    else:
        seen, counts = np.unique(grams, return_counts=True)
    logs = log_p[seen].astype(np.float64)
    single = counts @ logs
    best = int(np.argmax(single))
    shares = np.zeros(log_p.shape[1])
    shares[best] = 1.0
    likelihood = np.exp(logs - logs.max(axis=1, keepdims=True))
    total, penalty = counts.sum(), PENALTY * np.log(counts.sum() + 1)
    log_of = lambda density: float(counts @ np.log(density))
    density = likelihood[:, best]
    while np.count_nonzero(shares) < len(shares):
        gradient = (counts / density) @ likelihood / total
        gradient[shares > 0] = 0
        more = int(np.argmax(gradient))
        # the likelihood is concave: along this direction it can rise by total * log(gradient) at the most
        if gradient[more] <= 1 or total * np.log(gradient[more]) <= penalty:
            break
        chosen = np.flatnonzero(shares > 0).tolist() + [more]
        table = likelihood[:, chosen]
        pi = np.full(len(chosen), 1 / len(chosen))
        for _ in range(ROUNDS):
            new = pi * ((counts / (table @ pi)) @ table) / total
            moved, pi = np.abs(new - pi).max(), new
            if moved < 1e-3:
                break
        if log_of(table @ pi) - log_of(density) <= penalty:
            break
        shares[:] = 0
        shares[chosen] = pi / pi.sum()
        density = table @ pi
    return shares


def predict(docs: DataFrame, names: list[str], log_p: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score (the predicted language's share) and shares, the languages found with theirs."""

    def rows(batches) -> Iterator[tuple]:
        for doc_ids, texts in batches:
            for doc_id, text in zip(doc_ids, texts):
                grams = trigrams(text) if names and has_letter(text) else ()
                if not len(grams):
                    yield doc_id, "und", 0.0, []
                    continue
                shares = mixture(grams, log_p)
                order = np.argsort(-shares, kind="stable")
                yield (doc_id, names[order[0]], min(1.0, float(shares[order[0]])),
                       [(names[k], float(shares[k])) for k in order if shares[k] > 0])

    return stream(docs.select(F.col("doc_id").cast("long"), "text"),
                  "doc_id long, lang_pred string, score double, shares array<struct<lang:string,share:double>>", rows)


def identify(docs: DataFrame, training: Column) -> DataFrame:
    """Learn from the rows where ``training`` holds and predict every row: doc_id, lang_pred, score, shares."""
    prepare(docs.sparkSession)
    return predict(docs, *learn(docs.filter(training)))


def held_out_languages(docs: DataFrame) -> DataFrame:
    """Predictions for all documents, learned from those whose crc32(doc_id) mod 4 is not 2."""
    out = identify(docs, ~held_out(F.col("doc_id"), 4, 2))
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "shares")
