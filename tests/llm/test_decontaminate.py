from __future__ import annotations

import random

import numpy as np
import pytest
from brute import ODD
from pyspark.sql import functions as F

from logsift.llm import decontaminate
from logsift.llm.decontaminate import Hasher, candidates, contained, contaminated, missable, shingles, size_classes, words_of
from logsift.llm.queries import op1_decontaminate

SMALL = "/root/testdata/sf0.001"


def brute(docs, items):
    out = set()
    for doc_id, text in docs:
        held = shingles(words_of(text))
        for item_id, item in items:
            want = shingles(words_of(item))
            if want and len(want & held) >= 0.8 * len(want):
                out.add((doc_id, item_id, round(len(want & held) / len(want), 9)))
    best = {}
    for doc_id, item_id, share in out:
        best[doc_id, item_id] = max(share, best.get((doc_id, item_id), 0))
    return sorted(((*k, v) for k, v in best.items()), key=repr)


def rows_of(frame):
    return sorted(((r.doc_id, r.item_id, round(r.containment, 9)) for r in frame.collect()), key=repr)


def test_query(spark, small):
    docs = [(r.doc_id, r.text) for r in small("documents").collect()]
    items = [(r.item_id, r.text) for r in small("benchmark").collect()]
    want = brute(docs, items)
    assert want and rows_of(op1_decontaminate(spark, SMALL)) == want


@pytest.mark.parametrize("block_bytes", [16 << 20, 200])
def test_odd_rows(spark, odd, block_bytes):
    items = [
        (1, "ONE line, that is shared. Short own line of four!"), (2, None), (3, ""), (4, "..."), (5, "same words again and again same words"),
        (5, "same words again and again same words"), (6, "word word word word word word"), (7, "a row without an id, and nothing else"),
        (8, "Two words"), (9, "another text under the same id"), (None, "it has two lines here exact copy"),
    ]
    frame = spark.createDataFrame(items, "item_id long, text string").withColumns({k: F.lit(1) for k in ("same", "item_text", "containment")})
    got = contaminated(odd, frame, block_bytes)
    once = sorted({(r.doc_id, r.item_id, round(r.containment, 9)) for r in got.collect()}, key=repr)
    assert once == brute(ODD, items) and (8, 5, 1.0) in once
    assert contaminated(odd.limit(0), frame).count() == 0
    assert contaminated(odd, frame.limit(0)).count() == 0


def test_item_with_changed_words_in_a_long_document():
    random.seed(2)
    vocabulary = [f"w{k}" for k in range(3000)]
    item = random.choices(vocabulary, k=60)
    changed = [*item[:30], "other", *item[31:]]
    lost = [w if k % 4 else "other" for k, w in enumerate(item)]
    noise = random.choices(vocabulary, k=20_000)
    text = lambda middle: " ".join(noise[:9000] + middle + noise[9000:])
    texts = [" ".join(item)]
    sets, classes = [shingles(item)], size_classes(texts)
    assert [i for i, _ in contained(text(item), Hasher(), classes, sets)] == [0]
    assert [i for i, _ in contained(text(changed), Hasher(), classes, sets)] == [0]
    assert list(contained(text(lost), Hasher(), classes, sets)) == []


def test_a_sketch_cannot_be_missed_whole():
    random.seed(7)
    for size in (1, 2, 5, 9, 34, 200):
        words = [f"x{k}" for k in range(size + 4)]
        hashes = np.unique(Hasher().shingles(words))
        assert len(hashes) == size
        for _ in range(20):
            kept = np.sort(np.array(random.sample(hashes.tolist(), size - missable(size)), dtype=np.uint64))
            assert candidates(kept, size_classes([" ".join(words)])) == {0}
    assert [missable(n) for n in (1, 4, 5, 10, 33)] == [0, 0, 1, 2, 6]
    assert decontaminate.THRESHOLD == 0.8


def test_no_worker_beside_those_of_the_search(spark, monkeypatch):
    docs, items = (spark.createDataFrame([(1, "a b c d e f")], f"{k} long, text string") for k in ("doc_id", "item_id"))
    monkeypatch.setattr(type(spark), "createDataFrame", None)
    assert [tuple(r) for r in contaminated(docs, items).collect()] == [(1, 1, 1.0)]
    assert contaminated(docs, items.limit(0)).collect() == []
