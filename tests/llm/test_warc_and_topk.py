from __future__ import annotations

import base64
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from logsift.llm.queries import op8_warc, op9_top_k
from logsift.llm.topk import BallTree, search, top_k
from logsift.llm.warc import assemble, page_captures, parsed, read_warc, write_warc

SMALL = "/root/testdata/sf0.001"
PAGES = [
    (1, "https://a.test/x", "<p>same</p>"),
    (2, "https://a.test/y\r\nX-Evil: 1", "<p>same</p>"),
    (5, None, "<p>same</p>"),
    (5, None, "<p>same</p>"),
    (5, "https://b.test/other", "another payload under the same id"),
    (7, "https://c.test/ü", None),
    (8, "", ""),
    (9, "https://d.test", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n"),
    (None, "https://e.test", "<p>same</p>"),
    (11, "https://f.test", "é" * 200_000),
]


def capture_rows(pages, min_bytes):
    largest: dict[bytes, int] = {}
    for page, _, html in pages:
        data = (html or "").encode()
        if page is not None and len(data) >= min_bytes:
            largest[data] = max(page, largest.get(data, page))
    out = []
    for page, _, html in pages:
        data = (html or "").encode()
        first = largest.get(data)
        revisit = page is not None and first is not None and first != page
        sha1 = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, len(data), sha1, "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_bytes", [0, 1, 12])
def test_captures_of_odd_pages(spark, tmp_path, min_bytes):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({k: F.lit(1) for k in ("first", "sha", "kind", "value")})
    path = str(tmp_path / "warc")
    write_warc(pages.repartition(3), path, min_bytes=min_bytes, pages_per_file=2)
    got = page_captures(assemble(read_warc(spark, path)))
    rows = got.select("page_id", "payload_bytes", "payload_digest", "kind", "refers_to_page").collect()
    assert sorted((tuple(r) for r in rows), key=repr) == capture_rows(PAGES, min_bytes)
    payloads = {r.page_id: bytes(r.payload).decode() for r in got.where("kind = 'response'").collect() if r.page_id in (9, 11)}
    assert payloads == {9: PAGES[7][2], 11: PAGES[9][2]}
    assert got.where("request is null or metadata is null").count() == 0
    for file in (tmp_path / "warc").glob("part-*"):
        heads = [h for h, _ in parsed(file.read_bytes())]
        assert len(heads) <= 6 and all(h["warc-type"] in ("request", "response", "revisit", "metadata") for h in heads)


def test_no_pages(spark, tmp_path):
    write_warc(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "warc"))
    assert page_captures(assemble(read_warc(spark, str(tmp_path / "warc")))).count() == 0


def test_captures_without_neighbours(spark):
    schema = "kind string, record_id string, concurrent_to string, refers_to string, target_uri string, payload_digest string, payload_bytes bigint, payload binary, fields string"
    rows = [("response", "r1", None, None, "u", "d", 1, b"x", None), ("request", "q1", "r1", None, "u", None, None, None, "GET"), ("request", "q1", "r1", None, "u", None, None, None, "GET"), ("metadata", "m2", "gone", None, "u", None, None, None, "f")]
    got = assemble(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 1 and got[0].request.fields == "GET" and got[0].metadata is None


def test_warc_query(spark, small):
    pages = [(r.page_id, r.url, r.html) for r in small("pages").collect()]
    assert sorted((tuple(r) for r in op8_warc(spark, SMALL).collect()), key=repr) == capture_rows(pages, 0)


def nearest(rows, asks, k):
    q = [(i, np.floor(256 * np.asarray(v, dtype=np.float64)).astype(np.int64)) for i, v in rows]
    out = []
    for i, v in q:
        if asks(i):
            found = sorted((-int(v @ w), j) for j, w in q if j != i and len(w) == len(v))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found[:k])]
    return sorted(out)


def test_top_k_query(spark, small):
    rows = [(r.vec_id, r.embedding) for r in small("embeddings").collect()]
    assert sorted(tuple(r) for r in op9_top_k(spark, SMALL).collect()) == nearest(rows, lambda i: i % 50 == 0, 5)


def test_top_k_of_odd_vectors(spark):
    good = [(i, [0.5, -0.25, float(i % 3)]) for i in range(12)] + [(20, [1.0, 2.0]), (21, [3.0, 1.0]), (22, [-1.0, 0.0])]
    bad = [(30, None), (31, []), (32, [1.0, None, 2.0]), (33, [float("nan"), 1.0, 1.0]), (34, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    frame = spark.createDataFrame(good + good[:2] + bad, "vec_id long, embedding array<float>").withColumns({k: F.lit(1) for k in ("dim", "shard", "version", "score", "q", "rank")})
    got = sorted(tuple(r) for r in top_k(frame, F.col("vec_id") % 2 == 0, k=4).collect())
    assert got == nearest(good, lambda i: i % 2 == 0, 4)
    assert top_k(frame.limit(0), F.col("vec_id") % 2 == 0).count() == 0
    assert top_k(frame.where("vec_id = 20"), F.col("vec_id") % 2 == 0).count() == 0


@pytest.mark.parametrize(("shard", "groups", "held"), [(16, 4, 3), (16, 64, 16), (7, 1, 2), (1000, 64, 16)])
def test_top_k_over_groups_of_shards(spark, monkeypatch, shard, groups, held):
    """Vectors reach their group by a shuffle, however small Spark takes them to be, and groups of shards give what brute force gives."""
    from logsift.llm import topk

    for name, value in {"SHARD": shard, "BLOCK": 4, "GROUPS": groups, "HELD": held, "NUMBERS": 64 * shard}.items():
        monkeypatch.setattr(topk, name, value, raising=False)
    random = np.random.default_rng(5)
    rows = [(i, [float(x) for x in random.integers(-3, 4, 5)]) for i in range(230)] + [(1000 + i, [float(i), 1.0]) for i in range(40)]
    found = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 7 == 0, k=4)
    joins = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in line]
    assert all("query_id" in line for line in joins)
    assert sorted(tuple(r) for r in found.collect()) == nearest(rows, lambda i: i % 7 == 0, 4)


@pytest.mark.parametrize("kind", ["plain", "equal", "clustered", "huge"])
def test_tree_search_is_exact(kind):
    random = np.random.default_rng(3)
    rows = random.integers(-256, 256, (700, 16))
    if kind == "equal":
        rows[:500] = rows[0]
    if kind == "clustered":
        rows = rows // 64 + (random.integers(0, 4, 700)[:, None] * 100)
    if kind == "huge":
        rows = rows * (1 << 20)
    ids = random.permutation(700)
    queries, own = rows[:40], ids[:40]
    scores = np.where(own[:, None] == ids[None, :], np.iinfo(np.int64).min, queries @ rows.T)
    want = [sorted(zip((-s).tolist(), ids.tolist(), strict=True))[:5] for s in np.where(scores == np.iinfo(np.int64).min, -(2**62), scores)]
    for kth in (np.full(40, -np.inf), np.array([-w[-1][0] for w in want], dtype=float)):
        best, score = search(BallTree(rows), ids, queries, own, kth, 5)
        assert [[(-int(s), int(ids[b])) for s, b in zip(*x, strict=True)] for x in zip(score, best, strict=True)] == want
