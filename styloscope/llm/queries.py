"""Registered queries of the training-data operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from styloscope.llm.common import held_out, read_table
from styloscope.llm.decontaminate import find_leaks
from styloscope.llm.html_text import main_text
from styloscope.llm.jaccard_join import near_duplicates
from styloscope.llm.language_id import held_out_languages
from styloscope.llm.line_dedup import dedup_lines
from styloscope.llm.merkle import manifest
from styloscope.llm.packing import pack
from styloscope.llm.ppm import ppm_scores
from styloscope.llm.quality import assess
from styloscope.llm.secret_scan import scan_secrets
from styloscope.llm.token_counts import token_counts
from styloscope.llm.token_output import token_records
from styloscope.llm.variants import spelling_variants


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents through length-delimited record files."""
    docs = read_table(spark, sf_dir, "documents")
    return token_records(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated three-line windows."""
    out = dedup_lines(read_table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_lines", F.size("removed").alias("n_removed"), "row.text")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and the rule cascade's verdict for all documents."""
    return assess(read_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents through a digest cache that starts empty."""
    docs = read_table(spark, sf_dir, "documents")
    return token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by five-word shingles at a Jaccard similarity of 0.8."""
    return near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    docs = read_table(spark, sf_dir, "documents")
    return digested(pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, window=1024))


def digested(pieces: DataFrame) -> DataFrame:
    """Packed pieces with the checksum of their ids in place of the ids."""
    return pieces.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents, with span and edits."""
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents by mixture inference."""
    return held_out_languages(read_table(spark, sf_dir, "documents"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and PPM scores of all documents."""
    docs = read_table(spark, sf_dir, "documents")
    out = ppm_scores(docs, ~held_out(F.col("doc_id"), 7, 2), within_words=False)
    return out.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                      "base_score", "score")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return main_text(read_table(spark, sf_dir, "pages"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and checked proofs of all documents."""
    return merkle_columns(read_table(spark, sf_dir, "documents"))


def merkle_columns(docs: DataFrame) -> DataFrame:
    """The manifest by language, with n_chars changed where 7 divides the crc32 of doc_id."""
    out = manifest(docs, forge=held_out(F.col("doc_id"), 7, 0), forged={"n_chars": F.col("n_chars") + 1})
    return out.drop("proof")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words' most frequent form and its root."""
    return spelling_variants(read_table(spark, sf_dir, "documents"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, with linked weak candidates."""
    return scan_secrets(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q for q in (op1_token_records, op2_line_dedup, op3_quality_rules, op4_token_counts,
                            op5_jaccard_join, op6_packing, op7_decontamination, op8_language_id,
                            op9_lm_scores, op10_html_text, op11_merkle_manifest, op12_spelling_variants,
                            op13_secret_scan)}

SQL: dict[str, str] = {
    "op2_line_dedup": """
        WITH lines AS (
            SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
        numbered AS (
            SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS p FROM lines),
        trimmed AS (
            SELECT doc_id, p, line, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t FROM numbered),
        windows AS (
            SELECT doc_id, p, [t, lead(t, 1) OVER w, lead(t, 2) OVER w] AS k, lead(p, 2) OVER w AS last
            FROM trimmed WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
        marked AS (
            SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS nth
            FROM windows WHERE last IS NOT NULL AND (k[1] <> '' OR k[2] <> '' OR k[3] <> '')),
        covered AS (
            SELECT DISTINCT doc_id, p + d AS p FROM marked, (VALUES (0), (1), (2)) AS o(d) WHERE nth > 1),
        kept AS (
            SELECT n.doc_id, count(*) AS n_lines, count(c.p) AS n_removed,
                   coalesce(string_agg(n.line, chr(10) ORDER BY n.p) FILTER (WHERE c.p IS NULL), '') AS text
            FROM numbered n LEFT JOIN covered c ON n.doc_id = c.doc_id AND n.p = c.p GROUP BY n.doc_id)
        SELECT doc_id, n_lines::INT AS n_lines, n_removed::INT AS n_removed, text FROM kept""",
    "op3_quality_rules": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text,
                   list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))
                       AS ls
            FROM documents),
        words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM d),
        windows AS (
            SELECT doc_id, p, [w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o] AS k,
                   lead(p, 4) OVER o AS last, w = lag(w) OVER o AS again
            FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
        counted AS (
            SELECT doc_id, p, last IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, k, last IS NULL) > 1 AS rep, again
            FROM windows),
        covered AS (
            SELECT doc_id, count(*) FILTER (WHERE near) AS n_repeat_words, count(*) FILTER (WHERE again) AS n_again
            FROM (SELECT doc_id, again, max(rep) OVER (PARTITION BY doc_id ORDER BY p ROWS 4 PRECEDING) AS near
                  FROM counted)
            GROUP BY doc_id),
        base AS (
            SELECT d.doc_id, text, len(ws) AS n_words, len(ls) AS n_lines,
                   length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
                   length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                   len(ls) - len(list_distinct(ls)) AS n_dup_lines,
                   coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_again, 0) AS n_again,
                   length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
                   length(text) - length(replace(text, '!', '')) AS n_exclamations
            FROM d LEFT JOIN covered USING (doc_id)),
        judged AS (
            SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
        SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
               n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
               NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
                    OR 10 * n_upper > 3 * word_chars OR 5 * n_exclamations > n_words OR 10 * n_dup_lines > 4 * n_lines
                    OR 10 * n_again > 3 * n_words) AS kept
        FROM judged""",
    "op11_merkle_manifest": """
        WITH RECURSIVE crc_table AS (
            SELECT list(c ORDER BY i) AS crc_of FROM (
                SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b:
                       CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
                FROM range(256) AS r(i))),
        fields AS (
            SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS tree,
                   coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id, '-')
                   || coalesce(strlen(source)::VARCHAR || ':' || source, '-')
                   || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-') AS head,
                   coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars, '-') AS chars,
                   coalesce(strlen((n_chars + 1)::VARCHAR)::VARCHAR || ':' || (n_chars + 1), '-') AS more_chars,
                   coalesce(strlen(text)::VARCHAR || ':' || text, '-') AS body,
                   coalesce(xor(list_reduce(
                       list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
                       lambda a, b: xor(a >> 8, crc_of[(xor(a, b) & 255) + 1])), 4294967295) % 7 = 0, false) AS forged
            FROM documents, crc_table),
        hashed AS (
            SELECT doc_id, tree, sha256(head || chars || body) AS leaf,
                   sha256(head || CASE WHEN forged THEN more_chars ELSE chars END || body) AS shown
            FROM fields),
        leaves AS (
            SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM hashed),
        node AS (
            SELECT tree, 0 AS level, idx, leaf AS node FROM leaves
            UNION ALL
            SELECT tree, level + 1, idx // 2, sha256(string_agg(node, '' ORDER BY idx))
            FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS m FROM node) WHERE m > 1 GROUP BY tree, level, idx // 2),
        height AS (SELECT tree, max(level) AS height FROM node GROUP BY tree),
        subroots AS (
            SELECT tree, height, node AS subroot, row_number() OVER (ORDER BY tree) - 1 AS idx
            FROM node JOIN height USING (tree) WHERE level = height),
        top AS (
            SELECT 0 AS level, idx, subroot AS node FROM subroots
            UNION ALL
            SELECT level + 1, idx // 2, sha256(string_agg(node, '' ORDER BY idx))
            FROM (SELECT *, count(*) OVER () AS m FROM top) WHERE m > 1 GROUP BY level, idx // 2),
        root AS (SELECT level AS height, node AS root FROM top ORDER BY level DESC LIMIT 1),
        wanted AS (
            SELECT tree, idx, unnest(range(height)) AS level FROM leaves JOIN height USING (tree)),
        steps AS (
            SELECT w.tree, w.idx, list(CASE WHEN n.node IS NULL THEN '' WHEN (w.idx >> w.level) & 1 = 1 THEN '<' || n.node
                                       ELSE '>' || n.node END ORDER BY w.level) AS steps
            FROM wanted w LEFT JOIN node n
                ON n.tree = w.tree AND n.level = w.level AND n.idx = xor(w.idx >> w.level, 1::BIGINT)
            GROUP BY w.tree, w.idx),
        above AS (
            SELECT tree, subroot, root, list(CASE WHEN n.node IS NULL THEN '' WHEN (w.idx >> w.level) & 1 = 1
                   THEN '<' || n.node ELSE '>' || n.node END ORDER BY w.level) FILTER (WHERE w.level >= 0) AS steps
            FROM (SELECT s.*, root, unnest(range(-1, r.height)) AS level FROM subroots s, root r) w
            LEFT JOIN top n ON n.level = w.level AND n.idx = xor(w.idx >> greatest(w.level, 0), 1::BIGINT)
            GROUP BY tree, subroot, root),
        proved AS (
            SELECT doc_id, leaf, shown, subroot, root, l.idx,
                   list_concat(coalesce(s.steps, []), coalesce(a.steps, [])) AS steps
            FROM leaves l JOIN above a ON a.tree = l.tree LEFT JOIN steps s ON s.tree = l.tree AND s.idx = l.idx),
        folded AS (
            SELECT *, list_reduce(list_prepend(shown, steps), lambda a, s: sha256(
                   CASE WHEN s[1] = '<' THEN s[2:] || a ELSE a || s[2:] END)) AS folded_root
            FROM proved)
        SELECT doc_id, leaf, subroot, root, folded_root, folded_root = root AS verified,
               sha256(coalesce(array_to_string(list_transform(steps, lambda s: s[2:]), ''), '')) AS proof_sha256,
               idx::BIGINT AS idx, (2 * idx - bit_count(idx))::BIGINT AS position
        FROM folded""",
    "op12_spelling_variants": r"""
        WITH RECURSIVE crc_table AS (
            SELECT list(c ORDER BY i) AS crc_of FROM (
                SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b:
                       CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
                FROM range(256) AS r(i))),
        runs AS (
            SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
            FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
            GROUP BY ALL),
        hashed AS (
            SELECT run, k, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(
                       string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda x:
                       CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [195::BIGINT, ord(x)::BIGINT - 64] END))),
                       lambda a, b: xor(a >> 8, crc_of[(xor(a, b) & 255) + 1])), 4294967295) AS h
            FROM runs, crc_table),
        words AS (
            SELECT word, sum(k)::BIGINT AS n
            FROM (SELECT k, CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2)
                            ELSE run END AS word FROM hashed)
            WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
        cut AS (
            SELECT word, n, p, left(word, p) || substr(word, p + 2) AS rest
            FROM (SELECT word, n, unnest(range(length(word))) AS p FROM words)),
        near AS (
            SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b
                ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word AND length(a.word) = length(b.word)
            UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
            UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
        best AS (
            SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS form, max(other_n) AS form_n
            FROM near GROUP BY word),
        formed AS (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * w.n THEN form END AS form,
                   CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n
            FROM words w LEFT JOIN best USING (word)),
        walk AS (
            SELECT word, word AS root FROM formed
            UNION ALL
            SELECT k.word, f.form FROM walk k JOIN formed f ON f.word = k.root WHERE f.form IS NOT NULL),
        ends AS (
            SELECT k.word, k.root FROM walk k JOIN formed f ON f.word = k.root WHERE f.form IS NULL)
        SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM formed JOIN ends USING (word)""",
}
