"""Savings and runtime reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.functions.labels import CLIENTS, client_label
from logsift.functions.text import tokens
from logsift.operators import store as S
from logsift.plans.compression import render


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0).cast("bigint"))


def _pct(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.bround(part * 100 / whole, 1)).otherwise(F.lit(0.0))


def savings_parts(results: DataFrame) -> DataFrame:
    """One row of counters that can be added up over batches. ``ts`` is optional in ``results``."""
    through = F.col("passthrough")
    ts = F.col("ts") if "ts" in results.columns else F.lit(None).cast("timestamp")
    return results.agg(
        F.count(F.lit(1)).alias("outputs_seen"),
        F.count_if(~through).alias("outputs_compressed"),
        _zero(F.sum(F.when(~through, F.col("raw_tokens")))).alias("raw_tokens"),
        _zero(F.sum(F.when(~through, F.col("comp_tokens")))).alias("out_tokens"),
        _zero(F.sum(F.when(through, F.col("raw_tokens")))).alias("passthrough_tokens"),
        _zero(F.max(F.when(~through, F.greatest(F.col("raw_tokens") - F.col("comp_tokens"), F.lit(0))))).alias("largest_single_saving"),
        F.min(ts).alias("first_seen"),
        F.max(ts).alias("last_seen"),
    )


def lifetime(parts: DataFrame) -> DataFrame:
    """Totals of one or more rows of counters, with two rates: of what compressed, and of all seen."""
    summed = ["outputs_seen", "outputs_compressed", "raw_tokens", "out_tokens", "passthrough_tokens"]
    total = parts.agg(
        *[_zero(F.sum(c)).alias(c) for c in summed],
        _zero(F.max("largest_single_saving")).alias("largest_single_saving"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )
    saved = F.greatest(F.col("raw_tokens") - F.col("out_tokens"), F.lit(0))
    return total.select(
        "outputs_seen",
        "outputs_compressed",
        (F.col("outputs_seen") - F.col("outputs_compressed")).alias("outputs_passthrough"),
        "raw_tokens",
        "out_tokens",
        "passthrough_tokens",
        saved.alias("tokens_saved"),
        _pct(saved, F.col("raw_tokens")).alias("reduction_on_compressed_pct"),
        _pct(saved, F.col("raw_tokens") + F.col("passthrough_tokens")).alias("reduction_overall_pct"),
        "largest_single_saving",
        _pct(F.col("largest_single_saving"), saved).alias("largest_share_pct"),
        "first_seen",
        "last_seen",
    )


def savings_lifetime(results: DataFrame) -> DataFrame:
    return lifetime(savings_parts(results))


def label_parts(results: DataFrame) -> DataFrame:
    """Counters per label, compressed outputs only."""
    done = results.filter(~F.col("passthrough"))
    return done.groupBy("label").agg(
        F.count(F.lit(1)).alias("outputs"), F.sum("raw_tokens").alias("raw_tokens"), F.sum("comp_tokens").alias("out_tokens")
    )


def by_label(parts: DataFrame, limit: int | None = None) -> DataFrame:
    total = parts.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("outputs", "raw_tokens", "out_tokens")])
    saved = F.col("raw_tokens") - F.col("out_tokens")
    report = total.select(
        "label",
        "outputs",
        F.greatest(saved, F.lit(0)).alias("tokens_saved"),
        _pct(saved, F.col("raw_tokens")).alias("reduction_pct"),
    )
    return report if limit is None else report.orderBy(F.desc("tokens_saved"), "label").limit(limit)


def savings_by_label(results: DataFrame, limit: int | None = None) -> DataFrame:
    return by_label(label_parts(results), limit)


def history(store: DataFrame, limit: int = 10) -> DataFrame:
    """Newest stored outputs with the share each one saved."""
    saved = F.col("raw_tokens") - F.col("comp_tokens")
    pct = F.when(F.col("raw_tokens") > 0, F.bround(saved * 100 / F.col("raw_tokens"), 0)).otherwise(0.0)
    return S.recent(store, limit).select("id", pct.alias("saved_pct"), "raw_tokens", "comp_tokens", "filt", F.left("command", F.lit(40)).alias("command"))


def gain_report(results: DataFrame, store: DataFrame, limit: int = 6) -> dict[str, DataFrame]:
    """Lifetime totals, where they came from, and what the store still holds: three frames, never mixed."""
    return {
        "lifetime": savings_lifetime(results),
        "by_label": savings_by_label(results, limit),
        "store": S.totals(store),
        "history": history(store, limit),
    }


def run_events(results: DataFrame) -> DataFrame:
    """Metric events of compressed runs. What left the tool includes the footer.

    Needs ``client`` and ``process_ns`` next to the columns of ``compress``.
    """
    shown = results.withColumn("_shown", render(results))
    return shown.select(
        "client",
        F.lit("run").alias("kind"),
        (~F.col("passthrough")).alias("flag"),
        "raw_tokens",
        F.expr(tokens("_shown")).alias("output_tokens"),
        "process_ns",
        "ts",
    )


def _fields(kind: str) -> tuple[Column, Column]:
    return F.count_if(F.col("kind") == kind), F.count_if((F.col("kind") == kind) & F.col("flag"))


def client_parts(events: DataFrame) -> DataFrame:
    """Counters per known runtime from events ``client, kind, flag, raw_tokens, output_tokens, process_ns, ts``.

    ``kind`` is ``observe`` (a command seen, flag: selected), ``input`` (a request seen, flag: clamped) or
    ``run`` (an output handled, flag: compressed). Negative figures count as 0. Partial aggregation leaves
    one row per runtime and task before the shuffle, so a busy runtime is no skew.
    """
    known = events.withColumn("client", client_label(F.col("client"))).filter(F.col("client").isin(CLIENTS))
    run = F.col("kind") == "run"
    observed, selected = _fields("observe")
    inputs, clamped = _fields("input")
    runs, compressed = _fields("run")

    def summed(column: str) -> Column:
        return _zero(F.sum(F.when(run, F.greatest(F.col(column), F.lit(0).cast("bigint")))))

    return known.groupBy("client").agg(
        observed.alias("observed"),
        selected.alias("selected"),
        inputs.alias("inputs_seen"),
        clamped.alias("inputs_clamped"),
        runs.alias("runs"),
        compressed.alias("compressed"),
        summed("raw_tokens").alias("raw_tokens"),
        summed("output_tokens").alias("output_tokens"),
        summed("process_ns").alias("process_ns"),
        F.max("ts").alias("updated_at"),
    )


COUNTERS = [
    "observed", "selected", "inputs_seen", "inputs_clamped", "runs", "compressed", "raw_tokens", "output_tokens", "process_ns",
]


def efficiency(parts: DataFrame) -> DataFrame:
    """The four runtimes with their counters and rates. Rates of a runtime without runs are unknown."""
    none = parts.sparkSession.createDataFrame([(c,) for c in CLIENTS], "client string")
    # A row without counters per runtime stands in for the missing ones.
    all_parts = parts.unionByName(none, allowMissingColumns=True)
    rows = all_parts.groupBy("client").agg(*[F.sum(c).alias(c) for c in COUNTERS], F.max("updated_at").alias("updated_at"))
    n = {c: _zero(F.col(c)) for c in COUNTERS}
    saved = n["raw_tokens"] - n["output_tokens"]
    return rows.select(
        "client",
        n["observed"].alias("observed"),
        n["selected"].alias("auto_selected"),
        _pct(n["selected"], n["observed"]).alias("selection_pct"),
        n["inputs_seen"].alias("inputs_seen"),
        n["inputs_clamped"].alias("inputs_clamped"),
        _pct(n["inputs_clamped"], n["inputs_seen"]).alias("inputs_clamped_pct"),
        n["runs"].alias("runs"),
        n["compressed"].alias("compressed"),
        (n["runs"] - n["compressed"]).alias("passthrough"),
        n["raw_tokens"].alias("tokens_in"),
        n["output_tokens"].alias("tokens_out"),
        saved.alias("tokens_saved"),
        F.when(n["runs"] > 0, _pct(saved, n["raw_tokens"])).alias("reduction_pct"),
        F.when(n["runs"] > 0, F.bround(n["process_ns"] / n["runs"] / 1e6, 3)).alias("average_process_ms"),
        "updated_at",
    )


def runtime_efficiency(events: DataFrame) -> DataFrame:
    return efficiency(client_parts(events))


def efficiency_listing(report: DataFrame) -> DataFrame:
    """The report as short text columns; a runtime without runs says ``no data``."""
    seen = F.concat_ws("/", F.col("observed").cast("string"), F.col("auto_selected").cast("string"))
    moved = F.concat(F.format_number("tokens_in", 0), F.lit("→"), F.format_number("tokens_out", 0))
    return report.select(
        "client",
        seen.alias("seen_auto"),
        "runs",
        "compressed",
        F.when(F.col("runs") > 0, moved).otherwise("no data").alias("tokens"),
        "reduction_pct",
        F.concat_ws("/", F.col("inputs_clamped").cast("string"), F.col("inputs_seen").cast("string")).alias("clamped"),
        F.coalesce(F.date_format("updated_at", "yyyy-MM-dd"), F.lit("-")).alias("last_update"),
    )


def as_json(report: DataFrame) -> DataFrame:
    """Any report as one JSON text per row, ready for ``write.text``."""
    return report.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
