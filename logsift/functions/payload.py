"""Stored payloads: byte cap and handles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HANDLE = "^[0-9a-f]{6,64}$"


def payload_bytes(text: Column) -> Column:
    return F.octet_length(text)


def capped(raw: Column, cap: int | None) -> Column:
    """Head of at most ``cap`` bytes, cut between characters, plus a marker with the bytes dropped."""
    if not cap or cap <= 0:
        return raw
    data = F.encode(raw, "UTF-8")

    # A character cannot start on a UTF-8 continuation byte (10xxxxxx), so step back to a lead byte.
    def starts_character(at: int) -> Column:
        lead = F.hex(F.substring(data, at + 1, 1))
        return ~lead.rlike("^[89AB]")

    keep = F.when(starts_character(cap), F.lit(cap))
    for back in range(1, min(3, cap) + 1):
        keep = keep.when(starts_character(cap - back), F.lit(cap - back))
    keep = keep.otherwise(F.lit(cap))
    marker = F.concat(
        F.lit("\n[stored head only, "),
        F.format_number(F.octet_length(raw) - keep, 0),
        F.lit(f" more bytes dropped at the {cap:,}-byte per-output cap]\n"),
    )
    head = F.decode(F.substring(data, F.lit(1), keep), "UTF-8")
    return F.when(F.octet_length(raw) <= cap, raw).otherwise(F.concat(head, marker))


def digest(id_: Column, raw: Column) -> Column:
    """Full-length name of an output; every handle is a prefix of it."""
    return F.sha2(F.concat(id_.cast("string"), F.lit("\n"), raw), 256)


def is_handle(text: Column) -> Column:
    return text.rlike(HANDLE)
