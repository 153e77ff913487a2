"""Token ids by a public tokenizer, one cached word at a time.

The word tokenizer drops white space and cuts words there before it merges, so the ids of a text are the ids of its words in order.
A word is encoded once per worker and then looked up; ids are packed into 2 bytes where the vocabulary allows it.
"""

from __future__ import annotations

import json
import re

import numpy as np

from logsift.llm.common import kept_by_worker

# Letters of Latin-1 and then ASCII punctuation: lower-cased, these are exactly the two pieces that the word tokenizer cuts.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)").fullmatch
SEPARATE = "[^\\s\\p{L}\\p{N}]+"
KEPT_WORDS = 500_000
LONGEST_KEPT = 48


def byte_characters() -> dict[int, str]:
    """Printable stand-ins for bytes, as byte-level vocabularies spell them."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(rest)}


class WordIds(dict):
    """Packed ids by the UTF-8 bytes of a word without white space. Holds at most ``most`` words, then starts anew."""

    def __init__(self, tokenizer, kind: str, most: int = KEPT_WORDS) -> None:
        self.tokenizer, self.model, self.kind, self.most = tokenizer, tokenizer.model, kind, most
        self.characters = byte_characters()
        self.pieces: dict[str, bytes] = {}

    def piece(self, text: str) -> bytes:
        if text not in self.pieces:
            if len(self.pieces) >= self.most:
                self.pieces.clear()
            spelled = text if text.isascii() else text.encode().decode("latin-1").translate(self.characters)
            self.pieces[text] = np.array([x.id for x in self.model.tokenize(spelled)], dtype=self.kind).tobytes()
        return self.pieces[text]

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode(errors="replace")
        plain = PLAIN(text) if len(word) <= LONGEST_KEPT else None
        if plain:
            packed = self.piece(plain[1].lower()) + (self.piece(plain[2]) if plain[2] else b"")
        else:
            packed = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()
        if len(word) <= LONGEST_KEPT:
            if len(self) >= self.most:
                self.clear()
            self[word] = packed
        return packed


class Encoder:
    """``encode(text as UTF-8) -> packed ids`` of a tokenizer file, without special tokens."""

    def __init__(self, path: str, most: int = KEPT_WORDS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        # The two parts alone: the whole file as Python objects, vocabulary and merges included, would stay in the worker's memory.
        layout = lambda part: json.loads(part.__getstate__()) if part else {}
        steps = [x.get("type") for x in layout(self.tokenizer.normalizer).get("normalizers", [])]
        cuts = layout(self.tokenizer.pre_tokenizer).get("pretokenizers") or [{}]
        apart = steps == ["NFC", "Replace", "Lowercase"] and cuts[0].get("invert") and str(cuts[0]["pattern"].get("Regex")).endswith(SEPARATE)
        self.words = WordIds(self.tokenizer, self.kind, most) if apart else None

    def encode(self, text: bytes) -> bytes:
        if self.words is not None:
            return b"".join(map(self.words.__getitem__, text.split()))
        ids = self.tokenizer.encode(text.decode(errors="replace"), add_special_tokens=False).ids
        return np.array(ids, dtype=self.kind).tobytes()


def encoder(path: str, most: int = KEPT_WORDS) -> Encoder:
    """The encoder of this worker process, which keeps the ids of at most ``most`` words. The tokenizer file has to lie at the same path on every worker."""
    return kept_by_worker(("encoder", path, most), lambda: Encoder(path, most))


def wide(packed: bytes, kind: str) -> bytes:
    """Packed ids as little-endian unsigned 32-bit integers."""
    return np.frombuffer(packed, dtype=kind).astype("<u4").tobytes()
