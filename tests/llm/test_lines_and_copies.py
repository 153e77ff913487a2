from __future__ import annotations

import random

from brute import ODD, component_ids, simhash
from pyspark.sql import functions as F

from logsift.llm.components import components
from logsift.llm.linededup import dedup_lines
from logsift.llm.queries import op10_simhash
from logsift.llm.simhash import links, near_groups

SMALL = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\f\r"


def line_dedup(rows):
    """(id, lines, dropped, kept text) of each row."""
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(WHITE))
    holders: dict[str, set] = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if doc_id is not None and len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        held = [holders.get(key(x), set()) for x in lines]
        kept = [x for x, h in zip(lines, held, strict=True) if doc_id is None or len(h) < 2 or min(h) == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_lines_of_odd_rows(odd, none):
    got = [tuple(r) for r in dedup_lines(odd).select("doc_id", "n_lines", "n_dropped", "kept").collect()]
    assert sorted(got, key=repr) == sorted(line_dedup(ODD), key=repr)
    assert {"doc_id", "text", "id", "version", "lines", "fp"} <= set(dedup_lines(odd).columns)
    assert dedup_lines(none).count() == 0


def test_lines_of_more_documents(spark):
    rows = [(k, "a line that all share\n" + ("a line of some\n" if k % 3 == 0 else "") + f"own line {k:09}") for k in range(20)]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=10)
    assert {r.n_dropped for r in got.where("doc_id > 0").collect()} == {1}


def test_long_text_with_many_dropped_lines(spark):
    lines = [f"line number {k:09}" for k in range(50_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(lines[::2] + ["its own last line"] + lines[1::2]))]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 2").first()
    assert (got.n_lines, got.n_dropped, got.kept) == (50_001, 50_000, "its own last line")


def test_components(spark):
    random.seed(1)
    pairs = [(k, k + 1) for k in range(0, 300)] + [(1000, k) for k in range(1001, 1200)] + [(5000, 5000), (6000, None), (7, 7)] + [(3, 2)] * 3
    random.shuffle(pairs)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(301)} | {k: 1000 for k in range(1000, 1200)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_of_odd_rows(odd, none):
    got = sorted(((-1 if r.doc_id is None else r.doc_id, r.fingerprint, r.component_id) for r in near_groups(odd).collect()))
    fps = [(doc_id, simhash(text, 3)) for doc_id, text in ODD]
    ids = component_ids(fps, 2)
    assert got == sorted((-1 if i is None else i, f"{fp:016x}", c) for (i, fp), c in zip(fps, ids, strict=True))
    assert near_groups(none).count() == 0


def test_simhash_query(spark, small):
    rows = [(r.doc_id, simhash(r.text, 3)) for r in small("documents").orderBy("doc_id").collect()]
    got = op10_simhash(spark, SMALL).orderBy("doc_id").collect()
    assert [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got] == [(i, fp, c) for (i, fp), c in zip(rows, component_ids(rows, 2), strict=True)]


def test_crowded_cells_lose_no_link(spark):
    random.seed(5)
    centre = random.getrandbits(64)
    rows = {centre ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 4))) for _ in range(3000)} | {random.getrandbits(64) for _ in range(500)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(signed(x),) for x in rows], "fp long")
    got = {r.node: r.component for r in components(links(frame)).collect()}
    order = sorted(map(signed, rows))
    unsigned = [(k, x % (1 << 64)) for k, x in enumerate(order)]
    want = {order[k]: order[c] for k, c in zip(range(len(order)), component_ids(unsigned, 2), strict=True)}
    assert {k: got.get(k, k) for k in order} == want
    pairs = links(frame)
    assert pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 2).count() == 0
    assert pairs.count() < 65 * len(rows)
