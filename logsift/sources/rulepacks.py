"""Rule packs: the built-in rules, then the user's packs in file-name order."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from logsift.plans.filters import BUILTIN_FILTERS, Filter
from logsift.plans.rules import BUILTIN_RULES, Rule, rule_from_dict

try:
    import yaml
except ImportError:
    yaml = None


def _read(path: Path):
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        return json.loads(text)
    return yaml.safe_load(text) if yaml else None


def load_rules(directory: str | None = None) -> list[Rule]:
    """Built-in rules plus packs (``*.yaml``, ``*.json``). A pack that cannot be read is left out."""
    rules = list(BUILTIN_RULES)
    folder = Path(directory) if directory else None
    if folder is None or not folder.is_dir():
        return rules
    for path in sorted(p for p in folder.iterdir() if p.suffix in (".yaml", ".json")):
        try:
            pack = _read(path)
        except Exception:  # any parser's complaint means the same: not a pack
            continue
        if isinstance(pack, list):
            rules.extend(rule_from_dict(entry) for entry in pack if isinstance(entry, dict))
    return rules


def rule_table(spark: SparkSession, rules: list[Rule] = BUILTIN_RULES, filters: list[Filter] = BUILTIN_FILTERS) -> DataFrame:
    """Rules and filters as rows, in order."""
    rows = [("filter", i, f.name, f.match, False, 0) for i, f in enumerate(filters)]
    rows += [("rule", i, r.name, r.match, r.stop, len(r.actions)) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "kind string, ord int, name string, match string, stop boolean, actions int")
