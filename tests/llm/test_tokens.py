from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from brute import ODD, TOKENIZER, crc, token_ids
from pyspark.sql import functions as F

from logsift.llm.packing import hilbert, pack, powers
from logsift.llm.queries import op3_token_ids, op5_packing
from logsift.llm.tokenids import EliasFano, from_block, read_token_ids, to_block, write_token_ids
from logsift.llm.tokens import Encoder

SMALL = "/root/testdata/sf0.001"


def test_word_cache_gives_the_ids_of_whole_texts(small):
    encode = Encoder(TOKENIZER)
    assert encode.words is not None
    texts = [t for _, t in ODD] + [r.text for r in small("documents").select("text").collect()] + [r.html for r in small("pages").select("html").collect()]
    for text in texts:
        assert np.array_equal(np.frombuffer(encode.encode((text or "").encode()), encode.kind), token_ids(text)), (text or "")[:80]


def test_word_cache_keeps_to_its_bound():
    bound, free = Encoder(TOKENIZER, 50), Encoder(TOKENIZER)
    for k in range(400):
        text = f"word{k} Wörd{k}, plain{k % 7}".encode()
        assert bound.encode(text) == free.encode(text)
        assert len(bound.words) <= 50 and len(bound.words.pieces) <= 50
    assert len(free.words) > 400


@pytest.mark.parametrize("universe,n", [(0, 1), (5, 5), (1000, 3), (1 << 20, 1000), (3, 700)])
def test_elias_fano_round_trip(universe, n):
    values = np.sort(np.random.default_rng(n).integers(0, universe + 1, n))
    code = EliasFano.of(values, universe)
    assert code.all().tolist() == values.tolist() == [code.select(i) for i in range(n)]


def test_blocks_round_trip():
    ids = [np.arange(k, dtype="<u2") for k in (3, 0, 1, 700)]
    code, got = from_block(to_block([x.tobytes() for x in ids], "<u2"))
    assert code.all().tolist() == [3, 3, 4, 704] and got.tolist() == np.concatenate(ids).tolist()
    assert len(to_block([b"ab"] * 4096, "<u2")) < 2 * 4096 + 4096 * 3 / 8 + 200


def test_token_ids_of_odd_rows(spark, odd, tmp_path):
    write_token_ids(odd, str(tmp_path / "ids"), TOKENIZER, end_id=2, block_ids=500)
    got = read_token_ids(spark, str(tmp_path / "ids")).orderBy("start").collect()
    rows = sorted(ODD, key=lambda r: -1 if r[0] is None else r[0])
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    have = sorted((-1 if r.doc_id is None else r.doc_id, bytes(r.ids)) for r in got)
    assert have == sorted((-1 if i is None else i, np.append(token_ids(t), 2).astype("<u4").tobytes()) for i, t in rows)


def test_token_ids_of_no_rows(spark, none, tmp_path):
    write_token_ids(none, str(tmp_path / "ids"), TOKENIZER, end_id=2)
    assert read_token_ids(spark, str(tmp_path / "ids")).count() == 0


def test_token_id_query(spark, small):
    got = op3_token_ids(spark, SMALL).orderBy("doc_id").collect()
    docs = small("documents").orderBy("doc_id").collect()
    start = 0
    for row, doc in zip(got, docs, strict=True):
        ids = np.append(token_ids(doc.text), 2)
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc.doc_id, start, len(ids), crc(ids))
        start += len(ids)


def check_pieces(pieces, rows):
    """Every id of every row once, sequences gapless from 0, padding-free."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for held in by_sequence.values():
        at = 0
        for p in sorted(held, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 2048 and at & (at - 1) == 0
    for doc_id, text in rows:
        ids = np.append(token_ids(text), 1)
        parts = sorted(by_doc.pop(doc_id), key=lambda p: p.start)
        at = 0
        for p in parts:
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), crc(ids[at : at + p.length]))
            at += p.length
        assert at == len(ids)
    assert not by_doc


def test_packing_query(spark, small):
    check_pieces(op5_packing(spark, SMALL).collect(), [(r.doc_id, r.text) for r in small("documents").collect()])


def test_packing_ranges_follow_the_size(spark, small):
    docs = small("documents")
    pieces = pack(docs, TOKENIZER, end_id=1, range_ids=20_000).withColumn("ids_crc32", F.crc32("ids")).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check_pieces(pieces, rows)
    ranges = sum(p.length for p in pieces) // 20_000 + 1
    assert ranges > 2 and len({p.sequence_id >> 40 for p in pieces}) == ranges


def test_packing_joins_the_rows_of_a_long_document(spark):
    text = " ".join(f"word{i % 97}" for i in range(9000))
    pieces = pack(spark.createDataFrame([(1, text)], "doc_id long, text string"), TOKENIZER, end_id=1).orderBy("start").collect()
    total = len(token_ids(text)) + 1
    assert total > 4 * 2048 and [p.length for p in pieces] == [2048] * (total // 2048) + powers(total % 2048)


def test_packing_odd_rows(odd, none):
    pieces = pack(odd.where("doc_id is null or doc_id <> 8"), TOKENIZER, end_id=1).withColumn("ids_crc32", F.crc32("ids")).collect()
    check_pieces(pieces, [r for r in ODD if r[0] != 8])
    repeated = pack(odd.where("doc_id = 8"), TOKENIZER, end_id=1).agg(F.sum("length").alias("n")).first().n
    assert repeated == sum(len(token_ids(t)) + 1 for i, t in ODD if i == 8)
    assert pack(none, TOKENIZER, end_id=1).count() == 0


def test_hilbert_curve_visits_neighbours():
    points = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    places = hilbert(points, 3)
    assert sorted(places) == list(range(512))
    walk = points[np.argsort(places)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()
    assert powers(0) == [] and powers(2047) == [1024, 512, 256, 128, 64, 32, 16, 8, 4, 2, 1]


def test_the_tokenizer_file_is_not_parsed_in_python(monkeypatch):
    import json

    monkeypatch.setattr(json, "load", None)
    assert Encoder(TOKENIZER).words is not None
