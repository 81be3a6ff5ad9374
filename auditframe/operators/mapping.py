"""Label mapping: rules over axes, applied as relational division."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``target`` holds where every axis has one of its values. ``verified``: checked by a reader; ``report_as``: delta, value or none."""

    target: str
    conditions: dict[str, list[str]]
    verified: bool = True
    report_as: str = "value"
    rationale: str = "stated by the data set"


@dataclass(frozen=True)
class Rules:
    rules: list[Rule]
    version: str = "1.0.0"
    axes: frozenset[str] | None = field(default=None)

    def __post_init__(self) -> None:
        if not re.fullmatch(r"[0-9]+\.[0-9]+\.[0-9]+", self.version):
            raise ValueError(f"version must have three numbers: {self.version!r}")
        targets = [r.target for r in self.rules]
        if len(set(targets)) != len(targets):
            raise ValueError(f"targets repeat: {sorted(t for t in set(targets) if targets.count(t) > 1)}")
        for rule in self.rules:
            if not rule.conditions or not rule.rationale.strip():
                raise ValueError(f"{rule.target}: a rule needs conditions and a rationale")
            if rule.report_as not in ("value", "delta", "none"):
                raise ValueError(f"{rule.target}: unknown report_as {rule.report_as!r}")
            if self.axes is not None and set(rule.conditions) - self.axes:
                raise ValueError(f"{rule.target}: unknown axes {sorted(set(rule.conditions) - self.axes)}")

    def reportable(self) -> list[str]:
        return [r.target for r in self.rules if r.verified and r.report_as == "value"]

    def delta_only(self) -> list[str]:
        return [r.target for r in self.rules if r.verified and r.report_as == "delta"]


    def checked_delta(self, target: str) -> str:
        """``target`` if its only report is a difference between data sets, and the rule was verified; else an error."""
        known = {r.target: r for r in self.rules}
        if target not in known:
            raise ValueError(f"no rule for {target!r}")
        if known[target].report_as != "delta":
            raise ValueError(f"{target!r} is no class for a difference; report it directly")
        if target not in self.delta_only():
            raise ValueError(f"{target!r} is not verified against the source yet")
        return target


def read_rules(path: str) -> Rules:
    """Rules from a YAML or JSON file on the driver: version, axes, rules (target, conditions, verified, report_as, rationale)."""
    data = read_config(path)
    names = {"target", "conditions", "verified", "report_as", "rationale"}
    for rule in data.get("rules", []):
        if set(rule) - names:
            raise ValueError(f"unknown entries in a rule: {sorted(set(rule) - names)}")
    return Rules([Rule(**r) for r in data.get("rules", [])], str(data.get("version", "")), frozenset(data["axes"]) if data.get("axes") else None)


def read_config(path: str) -> dict:
    """A mapping from a YAML file (if that library is there) or a JSON file."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    if path.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(text) or {}
    return json.loads(text)


def classify(rows: DataFrame, rules: Rules) -> DataFrame:
    """(id, target) for each rule that holds on a row's ``axes`` map; a row may have several targets or none."""
    flags = []
    for rule in rules.rules:
        holds = F.lit(True)
        for axis, values in rule.conditions.items():
            holds = holds & F.coalesce(F.element_at("axes", F.lit(axis)).isin(values), F.lit(False))
        flags.append(F.when(holds, F.lit(rule.target)))
    return rows.select("id", F.explode(F.array_compact(F.array(*flags))).alias("target"))
