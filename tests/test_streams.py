from __future__ import annotations

from pyspark.sql import functions as F

from logsift.plans import reports
from logsift.scratch import new_path
from logsift.streaming import counters


def test_runtime_counters(spark):
    rows = [("codex", "observe", True, 0, 0, 0), ("codex", "observe", False, 0, 0, 0), ("codex", "run", True, 100, 25, 1_000_000), ("codex", "run", False, 20, 20, 2_000_000),
            ("claude-code", "input", True, 0, 0, 0), ("stranger", "run", True, 9, 9, 9), ("local", "run", True, -5, -7, -1)]
    df = spark.createDataFrame(rows, "client string, kind string, flag boolean, raw_tokens long, output_tokens long, process_ns long").withColumn("ts", F.lit(None).cast("timestamp"))
    got = {r.client: r for r in reports.runtime_efficiency(df).collect()}
    assert list(sorted(got)) == ["claude", "codex", "gemini", "local"]
    codex = got["codex"]
    assert (codex.observed, codex.auto_selected, codex.runs, codex.compressed, codex.passthrough, codex.tokens_saved, codex.reduction_pct, codex.average_process_ms) == (2, 1, 2, 1, 1, 75, 62.5, 1.5)
    assert (got["claude"].inputs_clamped_pct, got["claude"].reduction_pct, got["gemini"].average_process_ms, got["local"].tokens_in) == (100.0, None, None, 0)
    shown = {r.client: r.tokens for r in reports.efficiency_listing(reports.runtime_efficiency(df)).collect()}
    assert shown["codex"] == "120→45" and shown["gemini"] == "no data"


def results(spark):
    rows = [(100, 10, "a", False), (50, 50, "passthrough", True), (200, 150, "b", False), (1000, 1000, "passthrough", True), (100, 20, "a", False)]
    return spark.createDataFrame(rows, "raw_tokens long, comp_tokens long, label string, passthrough boolean")


def test_denominators(spark):
    got = reports.savings_lifetime(results(spark)).first()
    assert (got.outputs_seen, got.outputs_compressed, got.outputs_passthrough, got.tokens_saved, got.passthrough_tokens) == (5, 3, 2, 220, 1050)
    assert (got.reduction_on_compressed_pct, got.reduction_overall_pct, got.largest_single_saving, got.largest_share_pct) == (55.0, 15.2, 90, 40.9)
    nothing = reports.savings_lifetime(results(spark).limit(0)).first()
    assert (nothing.outputs_seen, nothing.tokens_saved, nothing.reduction_overall_pct, nothing.largest_share_pct) == (0, 0, 0.0, 0.0)
    labels = reports.savings_by_label(results(spark), 1).collect()
    assert [tuple(r) for r in labels] == [("a", 2, 170, 85.0)]
    assert sum(r.tokens_saved for r in reports.savings_by_label(results(spark)).collect()) == got.tokens_saved


def test_counters_keep_few_files(spark, tmp_path):
    source, path = str(tmp_path / "in"), new_path(spark, "counter-files")
    rows = results(spark)
    for _ in range(7):
        rows.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = counters.start_lifetime(stream, f"{path}/life", f"{path}/cp")
    query.awaitTermination()
    assert query.lastProgress["batchId"] == 6
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{path}/life")
    assert files.count() == counters.TURNS
    got = counters.lifetime_totals(spark, f"{path}/life").first()
    assert (got.outputs_seen, got.tokens_saved) == (35, 7 * 220)


def test_counters_survive_a_restart(spark, tmp_path):
    """Two runs over a growing folder, the second from the checkpoint of the first."""
    source, path = str(tmp_path / "in"), new_path(spark, "counter-test")
    rows = results(spark)
    for part in (rows.filter("label = 'a'"), rows.filter("label != 'a'")):
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        counters.start_lifetime(stream, f"{path}/life", f"{path}/cp-life").awaitTermination()
        counters.start_labels(stream, f"{path}/labels", f"{path}/cp-labels").awaitTermination()
    assert counters.lifetime_totals(spark, f"{path}/life").first() == reports.savings_lifetime(rows).first()
    want = sorted(map(tuple, reports.savings_by_label(rows).collect()))
    assert sorted(map(tuple, counters.labels(spark, f"{path}/labels").collect())) == want


def test_streams_of_a_table_in_a_folder_of_files(spark, tmp_path):
    """A table may be one file or a folder of files whose names say nothing; other tables lie beside it."""
    import checks.all  # noqa: F401, I001  (registers the queries in their order)
    from checks.streams import _stream

    rows = results(spark)
    rows.repartition(3).write.parquet(str(tmp_path / "results.parquet"))
    rows.repartition(2).write.parquet(str(tmp_path / "other_results.parquet"))
    path = new_path(spark, "folder")
    counters.start_lifetime(_stream(spark, str(tmp_path), "results"), f"{path}/life", f"{path}/cp").awaitTermination()
    assert counters.lifetime_totals(spark, f"{path}/life").first() == reports.savings_lifetime(rows).first()
    part = next((tmp_path / "results.parquet").glob("part-*.parquet"))
    part.rename(tmp_path / "single.parquet")
    held = spark.read.parquet(str(tmp_path / "single.parquet"))
    counters.start_lifetime(_stream(spark, str(tmp_path), "single"), f"{path}/one", f"{path}/cp-one").awaitTermination()
    assert counters.lifetime_totals(spark, f"{path}/one").first() == reports.savings_lifetime(held).first()


def test_a_batch_of_the_ledger_is_many_files(spark, monkeypatch):
    from pathlib import Path

    from checks import streams

    sf, paths = "/root/testdata/sf0.001", []
    whole = streams.q_ledger_batches(spark, sf)
    monkeypatch.setattr(streams, "new_path", lambda s, name: paths.append(new_path(s, name)) or paths[-1])
    monkeypatch.setattr(streams, "FILE_ROWS", 40)
    split = streams.q_ledger_batches(spark, sf)
    files = spark.read.parquet(f"{sf}/events.parquet").count() // (6 * 40) + 1
    assert files > 1 and len(list(Path(paths[0].removeprefix("file:")).glob("in/*.parquet"))) == 6 * files
    assert sorted(map(repr, split.collect())) == sorted(map(repr, whole.collect()))
