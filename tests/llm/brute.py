"""Plain Python versions of the contracts, for small tables."""

from __future__ import annotations

import re
import zlib

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

# Odd cases that every operator on documents has to survive: nulls, empty and long texts, ties, repeated rows, odd characters.
ODD = [
    (None, "a row without an id, and nothing else"),
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "One line that is shared.\nshort\nOwn line of four."),
    (5, "  ONE LINE THAT IS SHARED.\t\nshort\nOwn line of five.\n"),
    (6, "Ångström’s naïve café — ﬁne œuvre 東京 ١٢٣   x y\x1cz İstanbul ΣΑΣ été"),
    (7, "it's we'll I'd 'tis don't <|endoftext|> a<|startoftext|>b !!wow!! $$$ a_b x1y2 " + "z" * 300),
    (8, "same words again and again " * 400),
    (8, "same words again and again " * 400),
    (8, "another text under the same id"),
    (9, "Exact copy of one text.\nIt has two lines here."),
    (10, "Exact copy of one text.\nIt has two lines here."),
    (11, "word " * 30_000 + "end"),
]


def words_of(text: str | None) -> list[bytes]:
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def token_ids(text: str | None, tokenizer=Tokenizer.from_file(TOKENIZER)) -> np.ndarray:
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, dtype="<u4")


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def simhash(text: str | None, n: int) -> int:
    words = words_of(text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + n]), 42) for k in range(max(1, len(words) - n + 1))]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def component_ids(rows: list[tuple[int, int]], radius: int) -> list[int]:
    """Smallest id in the component of each (id, fingerprint) row, by comparing all rows with all."""
    fps = np.array([fp for _, fp in rows], dtype=np.uint64)
    label = list(range(len(rows)))

    def root(x: int) -> int:
        while label[x] != x:
            x = label[x]
        return x

    for k in range(len(rows)):
        for other in np.flatnonzero(np.bitwise_count(fps ^ fps[k]) <= radius):
            a, b = root(k), root(int(other))
            label[max(a, b)] = min(a, b)
    smallest: dict[int, int] = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            smallest[root(k)] = min(smallest.get(root(k), doc_id), doc_id)
    return [smallest.get(root(k)) for k in range(len(rows))]
