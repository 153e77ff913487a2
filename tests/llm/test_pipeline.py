from __future__ import annotations

import numpy as np
import pytest
from brute import ODD, component_ids, simhash, token_ids
from pyspark.sql import functions as F

import corpus_pipeline

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark):
    """The tables before and after every stage."""
    from logsift.scratch import saved

    tables = [spark.read.parquet(f"{SMALL}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(saved(stage(spark, tables[-1], SMALL), name.replace(" ", "-")))
    return tables


def test_stages_keep_the_columns(staged):
    assert all(t.columns == staged[0].columns and t.dtypes == staged[0].dtypes for t in staged[:-1])


def test_stages_take_effect(spark, staged, small):
    docs, good, lines, single, clean, pieces = staged
    texts = lambda t: {r.doc_id: r.text for r in t.collect()}
    before, kept, cut, unique, final = map(texts, (docs, good, lines, single, clean))
    assert set(final) <= set(unique) <= set(cut) == set(kept) < set(before)
    labels = small("labels").where("quality = 1").select("doc_id")
    assert labels.join(good, "doc_id", "left_anti").count() <= 0.05 * labels.count()
    groups = dict(zip(cut, component_ids([(i, simhash(t, 3)) for i, t in cut.items()], 2), strict=True))
    assert set(unique) == {i for i, g in groups.items() if i == g} and all(unique[i] == cut[i] for i in unique)
    import test_decontaminate

    hit = {i for i, _, _ in test_decontaminate.brute(unique.items(), [(r.item_id, r.text) for r in small("benchmark").collect()])}
    assert hit and set(final) == set(unique) - hit
    assert lines.where(F.col("n_chars") != F.char_length("text")).count() == 0
    ids = {}
    for p in pieces.orderBy("doc_id", "start").collect():
        ids.setdefault(p.doc_id, []).append(np.frombuffer(bytes(p.ids), "<u4"))
    assert set(ids) == set(final)
    assert all(np.array_equal(np.concatenate(ids[i]), np.append(token_ids(final[i]), 1)) for i in final)


def test_stages_survive_odd_rows(spark, odd, none):
    own = {k: F.lit(7) for k in ("quality_score", "n_lines", "n_dropped", "text_key", "score_", "fingerprint", "component_id")}
    frame = odd.withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.lit(0).cast("long"), **own})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, SMALL)
        assert out.columns == frame.columns and out.where("doc_id is null").count() == 1 or stage is corpus_pipeline.quality_filter
        assert {tuple(r) for r in out.select(*own, "kept", "fp", "version", "score").distinct().collect()} <= {(7,) * 11}
        assert stage(spark, frame.limit(0), SMALL).count() == 0
    assert corpus_pipeline.packing(spark, frame, SMALL).count() > 0


def test_rows_of_one_id_and_of_none(spark, small):
    item = small("benchmark").orderBy("item_id").first().text
    rows = [(None, item), (None, "a row of its own without an id"), (1, "clean text of one"), (1, item), (2, "clean text of two"), (5, "clean text of two"), (5, "another text under this id"), (6, "Clean text OF two"), (7, "clean text of two"), (7, "clean text of two")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "0L as n_chars")
    kept = lambda stage: sorted(((r.doc_id, r.text) for r in stage(spark, frame, SMALL).collect()), key=repr)
    assert kept(corpus_pipeline.decontaminate) == sorted((r for r in rows if r[0] != 1 and r[1] != item), key=repr)
    assert kept(corpus_pipeline.near_dedup) == sorted((r for r in rows if r[0] not in (6, 7)), key=repr)
