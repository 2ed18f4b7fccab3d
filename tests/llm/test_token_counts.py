import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from styloscope.llm import token_counts as tc

PIECES, WORDS = (public_tokenizers.path(n) for n in ("piece_bpe_32k.model", "word_bpe_49k.json"))
ROWS = [(1, "the cat"), (2, None), (3, ""), (None, "the cat"), (1, "the cat"), (4, "<s> </s> <unk> ▁x\n\n\t😀"),
        (5, "long " * 9000)]


def test_counts(spark):
    docs = spark.createDataFrame([(d, t, 5, "x") for d, t in ROWS], "doc_id long, text string, n_tokens int, digest string")
    pieces, words = sentencepiece.SentencePieceProcessor(model_file=PIECES), Tokenizer.from_file(WORDS)
    count = {PIECES: lambda t: len(pieces.encode(t)), WORDS: lambda t: len(words.encode(t, add_special_tokens=False).ids)}
    for path, n_of in count.items():
        got = sorted((tuple(r) for r in tc.token_counts(docs, path).collect()), key=str)
        assert got == sorted(((d, len((t or "").encode()), n_of(t or ""), n_of(t or "") > 4096) for d, t in ROWS), key=str)


def test_cache_is_asked_first_and_grows_by_misses(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    tc.token_counts(docs, PIECES, cache).collect()
    assert tc.read_cache(spark, cache, PIECES).count() == 4
    # a stored count is taken as it is, so a changed one shows that nothing is encoded again
    stored = [(r.digest, 1000 + r.n_tokens) for r in tc.read_cache(spark, cache, PIECES).collect()]
    other = f"file://{tmp_path}/other"
    spark.createDataFrame(stored, tc.CACHE_SCHEMA).write.parquet(f"{other}/tokenizer={tc.tokenizer_digest(PIECES)}")
    more = docs.union(spark.createDataFrame([(8, "new text")], "doc_id long, text string"))
    got = {r.doc_id: r.n_tokens for r in tc.token_counts(more, PIECES, other).collect()}
    assert got[1] > 1000 and got[2] == 1000 and got[8] < 1000
    assert tc.read_cache(spark, other, PIECES).count() == 5
    assert tc.read_cache(spark, other, WORDS).count() == 0


def test_empty(spark):
    assert tc.token_counts(spark.createDataFrame([], "doc_id long, text string"), PIECES).collect() == []
