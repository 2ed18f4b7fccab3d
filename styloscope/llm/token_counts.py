"""Operator 4: token counts through a digest cache.

A cache row is (tokenizer digest, content digest, n_tokens). Documents are reduced to their distinct contents (one
pre-aggregated shuffle, so a text copied millions of times is sent once per map task), contents whose digest the
cache lacks are encoded once and appended, and every document takes its count from the cache by digest.

The normalised content is the text itself with null read as empty: any further normalisation could change a count.
The tokenizer digest is the SHA-256 of its file, so a changed vocabulary never meets old counts.

Edge cases: null and empty texts share one digest and have 0 tokens (plus what the library adds to an empty text:
nothing); null or repeated doc_ids and repeated rows each keep their own result row; an empty table appends nothing;
other columns are ignored. One writer at a time may append to a cache folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from styloscope.llm.common import prepare, scratch_path, stream
from styloscope.llm.encode import encoder

CACHE_SCHEMA = "digest binary, n_tokens long"

_SENTENCEPIECE: dict[str, object] = {}


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def count_tokens(path: str, texts: list[str]) -> list[int]:
    """Ids of each whole text, as the library for the file's kind gives them, without special tokens."""
    if path.endswith(".json"):
        return [len(ids) for ids in encoder(path).encode(texts)]
    if path not in _SENTENCEPIECE:
        import sentencepiece

        _SENTENCEPIECE[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return [len(ids) for ids in _SENTENCEPIECE[path].encode(texts, num_threads=1)]


def content_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, text, digest) with null texts read as empty."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))


def read_cache(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """Stored counts of this tokenizer version; empty when nothing was stored yet."""
    folder = f"{path}/tokenizer={tokenizer_digest(tokenizer)}"
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(jvm_path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(folder)


def append_misses(docs: DataFrame, tokenizer: str, cache: str) -> None:
    """Encode the distinct contents of ``docs`` that the cache lacks and append their counts."""
    spark = docs.sparkSession
    distinct = content_digests(docs).groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(read_cache(spark, cache, tokenizer), "digest", "left_anti")

    def encode(batches) -> Iterator[tuple]:
        for digests, texts in batches:
            yield from zip(digests, count_tokens(tokenizer, texts))

    stream(misses.select("digest", "text"), CACHE_SCHEMA, encode).write.mode("append").parquet(
        f"{cache}/tokenizer={tokenizer_digest(tokenizer)}")


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 4096) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    ``cache``: folder in a shared store that later runs pass again; without one, a fresh folder in the session's
    shared folder is used and everything is a miss.
    """
    spark = docs.sparkSession
    prepare(spark)
    cache = cache or scratch_path(spark, "token-count-cache")
    append_misses(docs, tokenizer, cache)
    contents = content_digests(docs).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    # equal digests may be most rows: adaptive execution splits such a partition of this plain equi-join
    return (contents.join(read_cache(spark, cache, tokenizer), "digest", "left")
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))


