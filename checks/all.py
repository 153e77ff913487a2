"""All queries and oracles, with the oracles' wide sums cast to the types Spark gives."""

from __future__ import annotations

from checks import rules, tables, text  # noqa: F401, I001
from checks import audit, linetables, sources, streams  # noqa: F401
from checks.registry import ORACLES as _RAW
from checks.registry import QUERIES
from logsift.plans.audit import TOKEN_KEYS

# DuckDB adds whole numbers up as HUGEINT.
_TOKENS = " ".join(TOKEN_KEYS)
_SUMS = {
    "savings_lifetime": "raw_tokens out_tokens passthrough_tokens tokens_saved",
    "savings_by_label": "tokens_saved",
    "savings_top_labels": "tokens_saved",
    "run_efficiency": "tokens_in tokens_out",
    "runtime_efficiency": "tokens_in tokens_out tokens_saved",
    "store_totals": "tokens_in tokens_out tokens_saved",
    "store_by_day": "raw_tokens bytes",
    "gain_report": "tokens_saved",
    "json_hidden": "items_hidden chars_hidden",
    "forget_epochs": "epoch",
    "repeat_reads": "epoch",
    "repeat_reads_skewed": "epoch",
    "selection_audit": "observed",
    "reference_packs": "referenced_tokens avoided_tokens",
    "audit_totals": f"{_TOKENS} {' '.join(f'subagent_{k}' for k in TOKEN_KEYS)}",
    "session_floors": _TOKENS,
    "runtime_floors": f"{_TOKENS} context_read",
    "fixed_cost": "requests floor_cost",
    "subagent_share": "context_read subagent_context_read",
    "tool_result_size": "size",
    "server_calls": "calls attributed namespaced",
    "server_report": "calls",
    "stream_counters": "tokens_in tokens_out tokens_saved",
    "stream_lifetime": "raw_tokens out_tokens passthrough_tokens tokens_saved",
    "stream_labels": "tokens_saved",
    "stream_repeat_reads": "epoch",
}
_TEXTS = {"report_json": "value", "top_tools": "runtime"}


def _cast(name: str, sql: str) -> str:
    casts = [f"CAST({c} AS BIGINT) AS {c}" for c in _SUMS.get(name, "").split()]
    casts += [f"CAST({c} AS VARCHAR) AS {c}" for c in _TEXTS.get(name, "").split()]
    return f"SELECT * REPLACE ({', '.join(casts)}) FROM ({sql}) AS q" if casts else sql


ORACLES = {name: _cast(name, sql) for name, sql in _RAW.items()}
