"""The index and the signatures of the recall table against plain Python."""

from __future__ import annotations

from collections import defaultdict
from datetime import datetime

from pyspark.sql import functions as F

from logsift.operators import search

ROWS = [
    (1, "git log", "Full disk, full DISK; été 12"), (2, None, "no no no"), (3, "ls", None), (None, "x", ""), (4, "", "…\n--"), (1, "git log", "Full disk, full DISK; été 12"),
    *((k, "make all", " ".join(f"w{(k * j) % 13}" for j in range(k % 40))) for k in range(10, 1400)),
]


def table(spark):
    return spark.createDataFrame([(i, datetime(2024, 1, 1), c, r) for i, c, r in ROWS], "id long, ts timestamp, command string, raw string").coalesce(1)


def test_postings_sort_no_words_in_a_row(spark):
    index = search.postings(table(spark))
    assert index.columns == ["term", "id", "field", "tf", "positions", "ts"] and "sort_array" not in index._jdf.queryExecution().optimizedPlan().toString()
    want = []
    for i, command, raw in ROWS:
        for field, text in (("command", command), ("raw", raw)):
            at = defaultdict(list)
            for place, word in enumerate(search.words_of(text or "")):
                at[word].append(place)
            want += [(word, i, field, len(places), places) for word, places in at.items()]
    got = [(r.term, r.id, r.field, r.tf, r.positions) for r in index.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and index.where("ts <> '2024-01-01' OR ts IS NULL").count() == 0


def test_postings_of_nulls_in_a_column_without_nulls(spark):
    """An element at a NULL place is NULL, and Spark holds the column for one without."""
    rows = spark.createDataFrame([(1, 0, "one two"), (2, None, "two three"), (3, 1, None)], "id long, k int, raw string")
    store = rows.select("id", F.current_timestamp().alias("ts"), F.expr("element_at(array('ls', 'make all'), k + 1)").alias("command"), "raw")
    got = sorted((r.id, r.field, r.term) for r in search.postings(store).collect() if (r.id, r.field) != (2, "command"))
    assert got == [(1, "command", "ls"), (1, "raw", "one"), (1, "raw", "two"), (2, "raw", "three"), (2, "raw", "two"), (3, "command", "all"), (3, "command", "make")]


def test_signatures_are_set_without_lists_of_trigrams(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(F, "regexp_extract_all", None)
    path = str(tmp_path / "s")
    for k, (command, raw) in enumerate([("ab", "x😀yZ"), (None, None), ("Make all", "done " * 2000), ("a", "\x00\x01\x02")]):
        spark.createDataFrame([(k, datetime(2024, 1, 1), command, raw)], "id long, ts timestamp, command string, raw string").coalesce(1).write.mode("append").parquet(path)
    search.write_signatures(spark.read.parquet(path), path)
    found = lambda q: sorted(r.id for r in search.search_like_in(spark, path, q).collect())
    files = lambda q: len(search.files_with(spark, path, q))
    # The file without a trigram has no signature and is always read.
    assert found("X😀Y") == [0] and files("X😀Y") == 2 and found("MAKE") == [2] and files("e done") == 2 and files("nothing") == 1 and found("\x00\x01\x02") == [3]
