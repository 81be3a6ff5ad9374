"""Markdown and chart data of a study. Only small result tables reach the driver."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame

TITLES = {
    "split": "Split", "leakage": "Leakage", "stratified": "Rates by level", "headline": "Headline claim", "selective": "Selective prediction", "auc": "AUC by level", "calibration": "Calibration",
    "reliability": "Reliability", "subgroups": "Subgroups", "external_gap": "External gap", "ledger": "Not computable",
}
#: A result table has at most so many rows; larger ones are a mistake of the caller.
MOST_ROWS = 1000


def cell(x) -> str:
    if x is None:
        return "n/a"
    return f"{x:.3f}" if isinstance(x, float) else str(x).replace("|", "\\|")


def markdown_table(df: DataFrame) -> str:
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"not a result table: more than {MOST_ROWS} rows")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " - |" * len(df.columns)]
    return "\n".join(lines + sorted("| " + " | ".join(map(cell, r)) + " |" for r in rows))


def render(tables: dict[str, DataFrame], title: str, caveat: str | None = None) -> str:
    """One section per table, in a fixed order; a missing table is named."""
    parts = [f"# {title}"] + ([f"> {caveat}"] if caveat else [])
    for name, heading in TITLES.items():
        parts.append(f"## {heading}\n\n" + (markdown_table(tables[name]) if name in tables else "not computable on this data"))
    return "\n\n".join(parts) + "\n"


#: Headings of the tables of one data set, in order.
SET_TITLES = {
    "cohort": "Cohort", "stratified": "Rates by level", "auc": "AUC by level", "calibration": "Calibration error", "recalibration": "Recalibration", "reliability": "Reliability", "selective": "Selective prediction",
    "subgroups_age": "Subgroups by age", "subgroups_sex": "Subgroups by sex", "krippendorff": "Agreement of all readers", "fleiss": "Agreement in the complete design", "pairwise": "Agreement by pairs",
    "sweep_summary": "Model and readers over thresholds", "ceiling": "Model and the readers' ceiling",
}


def sections(title: str, parts: list[tuple[str, str, DataFrame | str]]) -> str:
    """A report of (heading, remark, table or text); a remark may be empty."""
    out = [f"# {title}"]
    for heading, remark, body in parts:
        out += [f"## {heading}", *([remark] if remark else []), body if isinstance(body, str) else markdown_table(body)]
    return "\n\n".join(out) + "\n"


def render_study(tables: dict[str, DataFrame], title: str, caveat: str | None = None) -> str:
    """The report of ``cohort.evaluate_inputs``: split, claims, each set, boxes by reader, ledger. What is missing is in the ledger.

    A ``caveat`` on the cohort stands above every section of results.
    """
    parts: list[tuple[str, str, DataFrame | str]] = []
    warning = f"> {caveat}" if caveat else ""
    for name, heading in (("split", "Split"), ("leakage", "Leakage"), ("naive_leakage", "Leakage of a split by image"), ("seen", "Test images of seen groups"), ("operating_point", "Operating point")):
        if name in tables:
            parts.append((heading, "", tables[name]))
    for name, heading in (("headline_gap", "Claim: deep minus shallow sensitivity"), ("headline_drop", "Claims: internal minus external sensitivity")):
        if name in tables:
            parts.append((heading, warning, tables[name]))
    for scope in ("internal", "external"):
        for name, heading in SET_TITLES.items():
            if f"{scope}_{name}" in tables:
                parts.append((f"{scope.capitalize()}: {heading[0].lower()}{heading[1:]}", warning, tables[f"{scope}_{name}"]))
        for name in sorted(n for n in tables if n.startswith(f"{scope}_detection_")):
            parts.append((f"{scope.capitalize()}: boxes against {name.rsplit('_', 1)[1]}", warning, tables[name]))
    parts.append(("Not computable", "", tables["ledger"]))
    return sections(title, parts)


def figures(tables: dict[str, DataFrame]) -> dict[str, str]:
    """SVG by file name, of the tables that are there: reliability, kappa over thresholds, sensitivity by depth."""
    out = {}
    for scope in ("internal", "external"):
        if f"{scope}_reliability" in tables:
            out[f"{scope}_reliability.svg"] = svg_line([(r.mean_p, r.rate) for r in tables[f"{scope}_reliability"].select("mean_p", "rate").collect()], f"{scope}: observed rate by mean probability")
        if f"{scope}_sweep" in tables:
            out[f"{scope}_sweep.svg"] = svg_line([(r.t / 100, r.kappa) for r in tables[f"{scope}_sweep"].filter("kappa IS NOT NULL").collect()], f"{scope}: mean kappa by threshold")
        if f"{scope}_stratified" in tables:
            rates = {r.statistic: r.value for r in tables[f"{scope}_stratified"].select("statistic", "value").collect()}
            out[f"{scope}_depth.svg"] = svg_line([(k / 2, rates[f"sensitivity_{k}"]) for k in (1, 2) if rates.get(f"sensitivity_{k}") is not None], f"{scope}: sensitivity by depth")
    return out


def write(folder: str, text: str, images: dict[str, str]) -> dict[str, str]:
    """Writes report.md, the figures and manifest.json (SHA-256 by file) to a folder of the driver; returns the manifest."""
    os.makedirs(folder, exist_ok=True)
    files = {"report.md": text, **images}
    manifest = {name: hashlib.sha256(body.encode()).hexdigest() for name, body in sorted(files.items())}
    for name, body in {**files, "manifest.json": json.dumps(manifest, indent=1)}.items():
        with open(os.path.join(folder, name), "w", encoding="utf-8") as file:
            file.write(body)
    return manifest


def svg_line(points: list[tuple[float, float]], label: str, size: int = 240) -> str:
    """A curve in the unit square, with its diagonal."""
    path = " ".join(f"{x * size:.1f},{(1 - y) * size:.1f}" for x, y in sorted(points))
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {size} {size}"><title>{label}</title><line x1="0" y1="{size}" x2="{size}" y2="0" stroke="#999"/><polyline fill="none" stroke="#036" points="{path}"/></svg>'
