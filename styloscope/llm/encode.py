"""Whole-text tokenisation with the ``tokenizers`` library, with a per-worker memo of words.

A BPE pre-tokenizer never lets a merge cross certain boundaries, so the ids of a text are the ids of its
chunks in order:

* word-end BPE (white space dropped): chunks are the parts between ASCII spaces and line feeds;
* byte-level BPE: a chunk starts at every space that is followed by a non-space character, because the
  pattern always breaks there and takes that one space along.

Inside a chunk, ASCII/Latin-1 letters followed by ASCII punctuation (no apostrophe) are two separate
pre-tokens. Distinct chunks are encoded by the library; the memo only avoids encoding a word again. With byte-level
BPE, letters alone are one pre-token and go straight to the library's BPE model, spelled in its byte-level alphabet;
a line feed between two words (the first with or without punctuation) is a pre-token of its own. A text
with ``<|`` could contain a special string and goes to the library whole, as does every text of a tokenizer
whose pre-tokenizer is neither of the two.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from itertools import chain

import numpy as np

#: Entries after which a worker's memo starts afresh (bounds memory, never the results).
MEMO_ENTRIES = 1_000_000
#: Longest chunk that is kept in the memo.
MEMO_CHARS = 48

_GLUED = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]+)").fullmatch
_SPACE_BEFORE_WORD = re.compile(r" (?=\S)").split
_OTHER_SPACE = re.compile(r" (?!\S)").search
#: Word, punctuation, and maybe line feed, word, punctuation.
_WORDS = re.compile(rf"{(w := "([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@[-`{-~]*)")}(?:\n{w})?").fullmatch


class Memo(dict):
    """Ids of the chunks of a byte-level BPE after ``prefix``, found when a chunk is looked up for the first time."""

    def __init__(self, owner: Encoder, prefix: str):
        super().__init__()
        self.owner, self.prefix = owner, prefix

    def __missing__(self, chunk: str) -> bytes:
        ids = self.owner.chunk_ids(self, chunk)
        if len(chunk) <= MEMO_CHARS:
            self[chunk] = ids
        return ids


class Encoder:
    """Ids of whole texts; ``width`` is the bytes per id that the vocabulary needs (2 or 4)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.vocab = self.library.get_vocab_size(with_added_tokens=True)
        self.width = 2 if self.vocab <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.kind = self._kind(spec)
        self.memo: dict[str, bytes] = Memo(self, " ") if self.kind == "byte" else {"": b""}
        #: Pieces without a leading space (byte-level BPE only; for word-end BPE the two memos coincide).
        self.bare: dict[str, bytes] = Memo(self, "") if self.kind == "byte" else self.memo
        #: Byte-level spelling of a space and Latin-1 letters (ASCII letters stand for themselves); empty if an added
        #: token could be inside a word.
        self.spelling: dict[int, str] = {}
        if self.kind == "byte" and all("<|" in t["content"] for t in spec.get("added_tokens") or []):
            from tokenizers.pre_tokenizers import ByteLevel

            spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
            self.spelling = {c: spell(chr(c))[0][0] for c in (ord(" "), *range(0xC0, 0x100))}
        self.model, self.code = self.library.model, "H" if self.width == 2 else "I"
        #: Chunks of the texts at hand that are too long to be kept.
        self.long: list[tuple[dict[str, bytes], str]] = []

    @staticmethod
    def _kind(spec: dict) -> str:
        pre = spec.get("pre_tokenizer") or {}
        parts = pre.get("pretokenizers", [pre])
        if spec.get("truncation") or spec.get("padding") or spec["model"].get("type") != "BPE":
            return "whole"
        if (len(parts) == 1 and parts[0].get("type") == "ByteLevel" and parts[0].get("use_regex")
                and not parts[0].get("add_prefix_space") and spec.get("normalizer") is None):
            return "byte"
        if (len(parts) == 2 and parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed"
                and parts[0].get("invert") and r"[^\s\p{L}\p{N}]+" in parts[0]["pattern"].get("Regex", "")):
            return "word"
        return "whole"

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in found]

    def chunk_ids(self, memo: Memo, chunk: str) -> bytes:
        """Ids of a chunk of byte-level BPE after the prefix of ``memo``."""
        found = _WORDS(chunk) if self.spelling else None
        if not found:
            return self._library([memo.prefix + chunk])[0]
        word, tail, second, last = found.groups("")
        if word == chunk:
            spelt = memo.prefix + word if word.isascii() else memo.prefix + word.translate(self.spelling)
            spelt = spelt.replace(" ", self.spelling[32])
            return array(self.code, [t.id for t in self.model.tokenize(spelt)]).tobytes()
        ids = memo[word] + self.bare[tail]
        return ids + self.bare["\n"] + self.bare[second] + self.bare[last] if second else ids

    def _fill(self, memo: dict[str, bytes], chunks: set[str], prefix: str) -> None:
        """Encode the chunks that ``memo`` lacks; letters with trailing punctuation are put together from two pieces."""
        new = chunks.difference(memo)
        if not new:
            return
        glued = {c: m.groups() for c in new if (m := _GLUED(c))}
        plain = [*new.difference(glued)]
        plain += {letters for letters, _ in glued.values()}.difference(memo, plain)
        for chunk, ids in zip(plain, self._library([prefix + c for c in plain])):
            memo[chunk] = ids
        tails = [*{tail for _, tail in glued.values()}.difference(self.bare)]
        for tail, ids in zip(tails, self._library(tails)):
            self.bare[tail] = ids
        for chunk, (letters, tail) in glued.items():
            memo[chunk] = memo[letters] + self.bare[tail]
        self.long += [(memo, c) for c in (*plain, *glued) if len(c) > MEMO_CHARS]

    def _trim(self) -> None:
        for memo in {id(m): m for m in (self.memo, self.bare)}.values():
            if len(memo) > MEMO_ENTRIES:
                memo.clear()
                memo[""] = b""

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text (null: none), as arrays of ``dtype``."""
        texts = [t or "" for t in texts]
        out: list[bytes] = [b""] * len(texts)
        whole = [i for i, t in enumerate(texts) if self.kind == "whole" or "<|" in t]
        for i, ids in zip(whole, self._library([texts[i] for i in whole])):
            out[i] = ids
        if self.kind == "whole":
            return [np.frombuffer(b, self.dtype) for b in out]
        self._trim()
        skip = set(whole)
        split: list[tuple[int, list[str]]] = []
        for i, t in enumerate(texts):
            if i in skip or not t:
                continue
            if self.kind == "word":  # the normaliser lower-cases anyway
                split.append((i, t.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
                              .replace("\n", " ").split(" ")))
            else:
                parts = iter(_SPACE_BEFORE_WORD(t) if _OTHER_SPACE(t) else t.split(" "))
                out[i] = b"".join(chain((self.bare[next(parts)],), map(self.memo.__getitem__, parts)))
        if split:
            self._fill(self.memo, set().union(*(p for _, p in split)), "")
            for i, parts in split:
                out[i] = b"".join(map(self.memo.__getitem__, parts))
        for memo, chunk in self.long:
            memo.pop(chunk, None)
        self.long.clear()
        return [np.frombuffer(b, self.dtype) for b in out]


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of the file at ``path``, loaded once."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]
