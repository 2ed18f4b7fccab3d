"""Words of letters go to the BPE model of the byte-level tokenizer: same ids as the library's, without its other steps."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from styloscope.llm.encode import MEMO_CHARS, Encoder

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def test_library_is_asked_for_no_words(monkeypatch):
    enc, asked = Encoder(BYTES), []
    library = enc._library
    monkeypatch.setattr(enc, "_library", lambda texts: asked.extend(texts) or library(texts))
    text = "Über die Straße.\nOne word, naïve words;\nThe ÿÀÖØöø end"
    assert enc.encode([text])[0].tolist() == enc.library.encode(text, add_special_tokens=False).ids
    assert [t for t in asked if any(c.isalpha() for c in t)] == []


def test_ids_of_mixed_chunks():
    enc, library = Encoder(BYTES), Tokenizer.from_file(BYTES)
    parts = ["a", "The", "éè", "ß", "ÿ", "×", "÷", "don't", "'s", "s", ".", ",", "!?", "\n", "\n\n", " ", "  ", "\t", "\r\n",
             " ", "\u0085", "12", "²", "ª", "µ", "_", "x" * (MEMO_CHARS + 5), "日本", "İ", "é", "<|", "<|endoftext|>"]
    rng = random.Random(5)
    texts = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(3000)] + [None, "a.\nb", "a.\n b", "a\nb c", "\na"]
    for _ in range(2):  # the second time from the memo
        for t, ids in zip(texts, enc.encode(texts)):
            assert ids.tolist() == library.encode(t or "", add_special_tokens=False).ids, t
    assert all(len(c) <= MEMO_CHARS for memo in (enc.memo, enc.bare) for c in memo)
