from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from brute import ODD
from pyspark.sql import functions as F

from logsift.llm import lexical, scans
from logsift.llm.lexical import Search, Slice, ranked
from logsift.llm.mixing import mixed_texts, mixture, repeated, sized, water_filled
from logsift.llm.prefixtrie import prefix_trie, rebuilt
from logsift.llm.queries import op11_lexical, op13_prefix_trie
from logsift.scratch import saved

SMALL = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def brute_ranks(docs, items, k=10):
    bags = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, all_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        asked, scores = Counter(TERM.findall(lower(text))), []
        for i, bag in bags:
            m = 25 + (75 * sum(bag.values()) * n_docs) // all_terms
            score = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t, n in asked.items() if t in bag)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def test_lexical_query(spark, small):
    docs = [(r.doc_id, r.text) for r in small("documents").collect()]
    items = [(r.item_id, r.text) for r in small("benchmark").collect()]
    assert sorted(map(tuple, op11_lexical(spark, SMALL).collect()), key=repr) == brute_ranks(docs, items)


@pytest.mark.parametrize("pass_bytes", [4 << 20, 100])
def test_ranks_of_odd_rows(spark, odd, none, pass_bytes):
    items = [(1, "one line that is SHARED"), (2, "one line that is SHARED"), (3, "same words again words"), (4, None), (5, "!!"), (6, "ñandú nowhere"), (None, "東京 ångström été É"), (8, "exact copy of two texts"), (9, "word")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({k: F.lit(3) for k in ("key", "rank", "score", "query")})
    assert sorted(map(tuple, ranked(odd, asked, 3, pass_bytes).collect()), key=repr) == brute_ranks(ODD, items, 3)
    assert ranked(none, asked).count() == 0 and ranked(odd, asked.limit(0)).count() == 0


def test_blocks_are_skipped_and_nothing_is_lost(monkeypatch):
    """A search that starts with the final scores of others has to score few documents, and any search finds the same."""
    rng = np.random.default_rng(5)
    topics = [rng.choice(400, 30, replace=False) for _ in range(20)]
    rows = [Counter(rng.choice(topics[k % 20], 25).tolist()) for k in range(3000)]
    ends = np.cumsum([0] + [len(r) for r in rows])
    terms = np.array([t for r in rows for t in sorted(r)])
    counts = np.array([r[t] for r in rows for t in sorted(r)])
    lengths = np.array([sum(r.values()) for r in rows])
    df = np.bincount(terms, minlength=400)
    weights = np.floor(1000 * np.log((2 * 3000 + 2) / (2 * df + 1))).astype(np.int64)
    queries = []
    for q in range(12):
        bag = sorted(Counter(rng.choice(topics[q], 12).tolist()).items())
        queries.append((np.array([t for t, _ in bag]), np.array([n for _, n in bag])))
    part = Slice(np.arange(3000), np.zeros(3000, dtype=bool), lengths, ends, terms, counts, 3000, int(lengths.sum()))
    exact = np.zeros((12, 3000), dtype=np.int64)
    for q, (t, n) in enumerate(queries):
        factor = np.zeros(400, dtype=np.int64)
        factor[t] = n * weights[t]
        np.add.at(exact[q], part.row, factor[part.terms] * part.values)
    want = [[(int(exact[q, i]), int(i)) for i in np.lexsort((np.arange(3000), -exact[q]))[:7]] for q in range(12)]
    for cells, group in ((1 << 23, 2048), (2000, 2048), (1 << 23, 40)):
        monkeypatch.setattr(lexical, "CELLS", cells)
        monkeypatch.setattr(lexical, "GROUP_TERMS", group)
        search = Search(queries, weights, np.zeros(12, dtype=np.int64), 7)
        search.slice(part)
        assert [list(zip(s.tolist(), i.tolist(), strict=True)) for s, i, _ in search.best] == want
    warm = Search(queries, weights, np.array([w[-1][0] for w in want]), 7)
    warm.slice(part)
    assert [list(zip(s.tolist(), i.tolist(), strict=True)) for s, i, _ in warm.best] == want
    assert warm.scored < 0.6 * sum(int((exact[q] > 0).sum()) for q in range(12))


def brute_targets(sizes, weights, share, epochs):
    """Sources are clamped one by one, the excess dealt again, in exact fractions."""
    order = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: Fraction(weights[k % len(weights)]) for k, s in enumerate(order)}
    total = Fraction(share) * sum(sizes.values())
    clamped = {}
    while True:
        rest, open_ = total - sum(clamped.values()), [s for s in order if s not in clamped]
        targets = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if targets[s] > epochs * sizes[s]]
        if not above:
            return {**clamped, **targets}
        clamped[above[0]] = Fraction(epochs * sizes[above[0]])


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def mixed(rows, weights=(5, 2, 1), share=1.5):
    slim = saved(sized(rows, 7).select("doc_id", "source", "size", "slice"), "sizes")
    plan = mixture(slim, weights, share, 2)
    return plan, repeated(slim, plan)


def test_mix_of_sources(spark):
    rng = random.Random(9)
    sources = ["b", "a", "é", "Z", "😀", "ﬀ", None, ""]
    rows = [(k, " ".join(["w"] * rng.randrange(0, 60)), sources[min(rng.randrange(12), 7)]) for k in range(1500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    for share in (1.5, 0.2, 2.0):
        plan, got = mixed(frame, share=share)
        sizes = defaultdict(int)
        for _, text, source in rows:
            sizes[source] += words(text)
        want = brute_targets(sizes, (5, 2, 1), share, 2)
        targets = {r.source: r.target for r in plan.collect()}
        assert all(abs(targets[s] - float(want[s])) < 1e-6 * (1 + float(want[s])) for s in want) and len(targets) == len(want)
        taken, found = defaultdict(int), {r.doc_id: r for r in got.collect()}
        assert len(found) == len(rows)
        for k, text, source in rows:
            assert found[k].size == words(text) and 0 <= found[k].taken <= 2 * words(text) and found[k].source_size == sizes[source]
            taken[source] += found[k].taken
        assert all(abs(taken[s] - float(want[s])) <= 3 for s in want)
        assert {r.doc_id: r.taken for r in mixed(frame.repartition(7), share=share)[1].collect()} == {k: r.taken for k, r in found.items()}
    texts = mixed_texts(frame, mixed(frame)[0], 7).groupBy("doc_id").agg(F.sum(F.size(F.filter(F.split("text", " "), lambda w: w != ""))).alias("n"), F.max("repetition").alias("r"))
    assert {r.doc_id: r.n for r in texts.collect() if r.n} == {k: r.taken for k, r in ((k, r) for k, r in {x.doc_id: x for x in mixed(frame)[1].collect()}.items()) if r.taken}


def test_mix_of_odd_rows(spark, odd, none):
    frame = odd.withColumns({"source": F.when(F.col("doc_id") % 2 == 0, F.lit("even")), "size": F.lit(-1), "slice": F.lit("x"), "target": F.lit("y"), "taken": F.lit(1)})
    plan, got = mixed(frame)
    assert got.count() == len(ODD) and got.where("taken > 2 * size or taken < 0").count() == 0
    assert {r.source for r in plan.collect()} == {"even", None}
    assert mixed(frame.limit(0))[1].count() == 0
    assert {r.taken for r in mixed(frame.where("doc_id in (1, 2, 3)"))[1].collect()} == {0}


def test_all_sources_clamped(spark):
    sources = saved(spark.createDataFrame([("a", 10, 1.0), ("b", 0, 5.0), ("c", 7, 2.0)], "source string, source_size long, weight double"), "weights")
    assert {r.source: r.target for r in water_filled(sources, 100.0, 2).collect()} == {"a": 20.0, "b": 0.0, "c": 14.0}
    assert {r.target for r in water_filled(sources, 0.0, 2).collect()} == {0.0}


def brute_trie(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [x[1:] for x in sorted(held, key=lambda x: x[0])] for c, held in convs.items()}
    whole = {}
    for c, own in turns.items():
        head = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(turns.get(c - c % 5, [])[:head] + own[head:])
    members = defaultdict(list)
    for c, path in whole.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    out = []
    for node, held in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below)]
        tokens = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in held if whole[c] == node)))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(held), len(node), parent, len(held), len(children), len(leaves), tokens, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie_rows(frame):
    return sorted(map(tuple, prefix_trie(rebuilt(frame)).collect()), key=repr)


TURNS = "conv_id long, turn long, role string, text string"


def test_trie_query(spark, small):
    rows = [tuple(r) for r in small("conversations").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, op13_prefix_trie(spark, SMALL).collect()), key=repr) == brute_trie(rows)


def test_trie_of_odd_conversations(spark):
    rng, rows = random.Random(4), []
    for c in [*range(0, 60), 1000, 1003, 5004]:
        for t in range(rng.randrange(1, 12)):
            rows.append((c, t if t or c % 3 else None, rng.choice(["user", "tool", None]), rng.choice(["a", "é", None, "long text " * 20])))
    rows += [(None, 1, "user", "left out"), (70, 5, None, None)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, TURNS).withColumns({k: F.lit(1) for k in ("depth", "x", "place", "range", "n")}).repartition(3)
    assert trie_rows(frame) == brute_trie(rows)
    assert trie_rows(frame.limit(0)) == []


def test_trie_over_several_ranges(spark, monkeypatch):
    """One long conversation, many equal ones and a common first turn, all cut into ranges of a few rows."""
    monkeypatch.setattr(scans.range_sorted, "__defaults__", (40,))
    rows = [(3, t, "user", f"turn {t % 7}") for t in range(500)]
    rows += [(c, t, "user", f"same {t}") for c in range(10, 400) for t in range(3)]
    rows += [(c, 0, "user", "hello") for c in range(1000, 1100)] + [(c, 1, "tool", f"{c % 9}") for c in range(1000, 1100)]
    got = trie_rows(spark.createDataFrame(rows, TURNS).repartition(5))
    assert got == brute_trie(rows)
