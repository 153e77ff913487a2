"""Which logged commands a compressor would take, and why it leaves the others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.functions.text import ANY_CASE, UNICODE, fn, let, lit, search

# First words of commands that mostly print.
READERS = [
    "git", "npm", "pnpm", "yarn", "pip", "pip3", "cargo", "docker", "kubectl",
    "pytest", "make", "cmake", "ninja", "ls", "dir", "tail", "journalctl",
    "curl", "wget", "go", "gradle", "mvn", "terraform", "rg", "ripgrep",
    "get-content", "gc", "type", "select-string", "sls", "get-childitem",
    "gci", "get-process", "gps", "get-service", "get-winevent",
    "get-ciminstance", "get-command", "get-module", "tree",
    "ssh", "scp", "sftp", "pkg", "pkgin", "apt", "apt-get", "dnf", "yum",
    "brew", "python", "python3", "py", "get-vm", "get-vhd", "get-disk",
    "get-netipaddress", "get-vmswitch", "test-netconnection", "get-item",
    "get-volume", "get-partition",
]
# Words that only change the directory, joins that go on to the next command, all joins.
DIRECTORY_CHANGES = ["cd", "chdir", "sl", "set-location", "pushd", "push-location"]
CONTINUES = [";", "&&"]
JOINS = [";", "&&", "||", "&", "<", "<<"]
# Commands that change something, and output that goes to a file.
MUTATING = (
    r"(?:^|[\s;&|])(?:"
    r"remove-item|rm|del|erase|rmdir|rd|format-\w*|clear-content|"
    r"set-content|add-content|out-file|move-item|rename-item|copy-item|"
    r"stop-process|taskkill|shutdown|restart-computer|invoke-expression|iex"
    r")(?:\s|$)"
)
TO_FILE = r"(?:^|\s)[\d*]?>{1,2}(?![>&])\s*(?!&)\S"
OWN_PREFIXES = ["lg ", "logsift "]

_QUOTED = r"'[^']*'|\"[^\"]*\""
_TOKEN = r"[();<>|&]+|(?:'[^']*'|\"[^\"]*\"|[^ \t\r\n'\"();<>|&])+"


def _in(value: str, words: list[str]) -> str:
    return f"{value} IN ({', '.join(map(lit, words))})"


def shell_tokens(command: str) -> str:
    """Words and runs of ``();<>|&``, quotes respected and removed; NULL when a quote is left open."""
    words = f"regexp_extract_all({command}, {lit(_TOKEN)}, 0)"
    bare = fn(lambda w: f"regexp_replace({w}, {lit(r"'([^']*)'|\"([^\"]*)\"")}, '$1$2')")
    open_quote = f"regexp_replace({command}, {lit(_QUOTED)}, '') rlike {lit('[' + chr(39) + chr(34) + ']')}"
    return f"CASE WHEN {open_quote} THEN NULL ELSE transform({words}, {bare}) END"


def _basename(token: str) -> str:
    return f"lower(regexp_extract({token}, {lit(r'([^/\\]*)$')}, 1))"


def selection_reason(command: str = "command", powershell: str = "false") -> str:
    """``selected``, or the first reason to leave the line alone."""

    def judged(cmd: str) -> str:
        def by_tokens(toks: str) -> str:
            opener = _in(_basename(f"{toks}[0]"), DIRECTORY_CHANGES)
            joins = f"filter(transform({toks}, {fn(lambda t, i: f"named_struct('t', {t}, 'i', {i})", 2)}), {fn(lambda x: f'{x}.i > 0 AND {_in(f"{x}.t", JOINS)}')})"

            def by_start(start: str) -> str:
                rest = f"slice({toks}, {start} + 1, size({toks}))"
                chained = f"exists({rest}, {fn(lambda t: _in(t, JOINS))})"
                to_file = search(cmd, UNICODE + TO_FILE)
                return (
                    f"CASE WHEN {start} IS NULL OR {start} >= size({toks}) THEN 'unreadable' "
                    f"WHEN NOT ({_in(_basename(f'{toks}[{start}]'), READERS)}) THEN 'not a reader' "
                    f"WHEN {to_file} THEN 'to a file' "
                    f"WHEN {powershell} AND ({chained} OR {search(cmd, '[\\r\\n]')}) THEN 'chained' "
                    f"ELSE 'selected' END"
                )

            # After a directory change the next segment decides, if `;` or `&&` leads to it.
            start = let(
                joins,
                lambda js: f"CASE WHEN NOT ({opener}) THEN 0 WHEN {_in(f'get({js}, 0).t', CONTINUES)} THEN get({js}, 0).i + 1 END",
            )
            return f"CASE WHEN {toks} IS NULL OR size({toks}) = 0 THEN 'unreadable' ELSE {let(start, by_start)} END"

        wrapped = " OR ".join(f"startswith({cmd}, {lit(p)})" for p in OWN_PREFIXES)
        return (
            f"CASE WHEN {cmd} = '' THEN 'empty' WHEN {wrapped} THEN 'already wrapped' "
            f"WHEN {search(cmd, ANY_CASE + MUTATING)} THEN 'mutating' "
            f"ELSE {let(shell_tokens(cmd), by_tokens)} END"
        )

    trimmed = f"regexp_replace(coalesce({command}, ''), {lit(r'(?U)^\s+|\s+$')}, '')"
    return let(trimmed, judged)


def selection_audit(commands: DataFrame) -> DataFrame:
    """Commands per client and reason, with the share of the client's commands.

    A line that is already wrapped counts as selected in ``selected``.
    """
    powershell = "coalesce(tool, '') = 'PowerShell'" if "tool" in commands.columns else "false"
    judged = commands.withColumn("reason", F.expr(selection_reason("command", powershell)))
    counts = judged.groupBy("client", "reason").agg(F.count(F.lit(1)).alias("commands"))
    totals = counts.groupBy("client").agg(F.sum("commands").alias("observed"))
    return counts.join(totals, "client").select(
        "client",
        "reason",
        "commands",
        "observed",
        F.bround(F.col("commands") * 100 / F.col("observed"), 1).alias("share_pct"),
        F.col("reason").isin("selected", "already wrapped").alias("selected"),
    )
