"""Reference packs: prompts that name files instead of quoting them, and what that avoids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.functions.text import fn, strip, tokens
from logsift.operators.ordered import salted_join
from logsift.options import DEFAULTS, Options

# The wording of a prompt; its length is part of the accounting.
OPENING = [
    "Start fresh with no inherited conversation.",
    "Use file paths as references; never embed or repeat their contents.",
    "Read these exact reference files before acting:",
]
OWNED = "Edit these owned paths directly:"
CHECKS = "Acceptance checks:"


def reference_packs(tasks: DataFrame, files: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """One row per task with its prompt, tokens embedded and referenced, and tokens avoided.

    ``tasks``: ``task_id, task, refs, owns, checks`` (arrays of strings) and optionally ``report_words``.
    ``files``: ``path, text``. A task with an empty text, a negative word limit or an unknown reference
    gets no prompt and says why in ``error``.
    """
    words = F.col("report_words") if "report_words" in tasks.columns else F.lit(None)
    packs = tasks.select(
        "task_id",
        F.expr(strip("coalesce(task, '')")).alias("task"),
        F.coalesce(words.cast("int"), F.lit(opts.context_report_words)).alias("report_words"),
        *[
            F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>"))).alias(c)
            for c in ("refs", "owns", "checks")
        ],
    )
    # Only sizes travel: a text is counted where it is read. One file may be named by most tasks.
    named = packs.select("task_id", F.explode("refs").alias("path"))
    sizes = files.select("path", F.expr(tokens("text")).alias("file_tokens")).join(named.select("path").distinct(), "path")
    found = salted_join(named, sizes, ["path"], F.col("task_id"))
    referenced = found.groupBy("task_id").agg(
        F.sum("file_tokens").alias("referenced_tokens"),
        F.min(F.when(F.col("file_tokens").isNull(), F.col("path"))).alias("_missing"),
    )
    packs = packs.join(referenced, "task_id", "left")

    def bullets(column: str) -> str:
        return f"transform({column}, {fn(lambda v: f"concat('- ', {v})")})"

    def section(title: str, column: str) -> str:
        return f"CASE WHEN size({column}) > 0 THEN concat(array('{title}'), {bullets(column)}) ELSE array() END"

    prompt = F.concat(
        F.array(*map(F.lit, OPENING)),
        F.expr(bullets("refs")),
        F.expr(section(OWNED, "owns")),
        F.expr(section(CHECKS, "checks")),
        F.array(F.concat(F.lit("Task: "), "task")),
        F.expr(
            "CASE WHEN report_words > 0 THEN array(concat('Return a report of no more than ', report_words, ' words.')) "
            "ELSE array() END"
        ),
    )
    error = (
        F.when(F.col("report_words") < 0, F.lit("report words must not be negative"))
        .when(F.col("task") == "", F.lit("task is empty"))
        .when(F.col("_missing").isNotNull(), F.concat(F.lit("no such file: "), "_missing"))
    )
    packs = packs.withColumn("error", error).withColumn(
        "prompt", F.when(F.col("error").isNull(), F.array_join(prompt, "\n"))
    )
    ok = F.col("error").isNull()
    return packs.select(
        "task_id",
        "refs",
        "prompt",
        F.when(ok, F.expr(tokens("prompt"))).alias("embedded_tokens"),
        F.when(ok, F.coalesce("referenced_tokens", F.lit(0))).alias("referenced_tokens"),
        F.when(
            ok, F.greatest(F.coalesce("referenced_tokens", F.lit(0)) - F.expr(tokens("prompt")), F.lit(0))
        ).alias("avoided_tokens"),
        "error",
    )
