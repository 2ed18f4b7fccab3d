import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from styloscope.llm import token_output as to
from styloscope.llm.encode import encoder

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ALPHABET = "abEé'sß-.*#|<>0١ \t\n\x0b\x1c\x85 　éΣς😀<|endoftext|>"


@pytest.mark.parametrize("path", [WORD, BYTE])
@settings(max_examples=300, deadline=None)
@given(text=st.lists(st.sampled_from([*ALPHABET, "<|endoftext|>", "don't", " the", "THE***", "  ", "\r\n"]), max_size=40))
def test_encoder_equals_library(path, text):
    text = "".join(text)
    want = encoder(path).library.encode(text, add_special_tokens=False).ids
    assert encoder(path).encode([text])[0].tolist() == want


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoder_on_documents(path, spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    enc = encoder(path)
    want = [e.ids for e in enc.library.encode_batch(texts, add_special_tokens=False)]
    assert [a.tolist() for a in enc.encode(texts)] == want


def test_frame_detects_damage():
    record = to.frame(b"payload")
    assert bytes(to.unframe(memoryview(record))[0]) == b"payload"
    for k in range(len(record)):
        bad = bytearray(record)
        bad[k] ^= 4
        with pytest.raises((to.CorruptRecord, ValueError)):
            to.unframe(memoryview(bytes(bad)))


def test_round_trip_and_index(spark, tmp_path):
    rows = [(3, "the cat"), (None, "x"), (1, None), (2, ""), (2, "a b"), (9, "word " * 30000), (-4, "<|endoftext|> é")]
    docs = spark.createDataFrame([(d, t, "z", 7) for d, t in rows], "doc_id long, text string, path string, shard int")
    manifest = to.write_records(docs, f"file://{tmp_path}/out", WORD, end_id=1, partitions=3)
    got = sorted(to.read_records(manifest).collect(), key=lambda r: r.start)
    library = Tokenizer.from_file(WORD)
    want, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r)[:4] for r in got] == want
    for shard in manifest.collect():
        in_order = list(to.scan(shard.path))
        for row, (doc, ids) in reversed(list(zip(to.read_index(shard.path), in_order))):
            again = to.read_at(shard.path, int(row["offset"]))
            assert again[0] == doc and again[1].tolist() == ids.tolist()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert to.token_records(docs, WORD, 1).collect() == []
