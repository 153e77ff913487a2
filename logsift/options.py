"""Job options. A cap of 0 (or less) is switched off."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    # compression
    min_saving: float = 0.15
    min_tokens: int = 40
    collapse_threshold: int = 3
    keep_head: int = 40
    keep_tail: int = 20
    # recall table; nothing is cut unless a cap is set
    max_store_rows: int = 0
    max_store_bytes: int = 0
    max_row_bytes: int = 0
    # request clamps
    grep_head_limit_content: int = 80
    grep_head_limit_paths: int = 200
    read_large_file_bytes: int = 131_072
    read_clamp_lines: int = 400
    # repeated reads
    dedupe_reads: bool = True
    dedupe_window_seconds: int = 7_200
    same_call_seconds: float = 1.0
    # reference packs
    context_report_words: int = 120
    # JSON views
    json_max_array: int = 8
    json_max_str: int = 200
    json_max_depth: int = 8
    # ordered work on one key is cut into blocks of about this many rows of the table, so no key is one task
    block_rows: int = 100_000


DEFAULTS = Options()
