"""A short ranked list of findings, from the small sections of a report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

KEEP = 3
FULL_CONFIDENCE_ROWS = 1000
MISSING_ALERT = 0.3
OUTLIER_ALERT = 0.05
SKEW_ALERT = 1.0
CORRELATION_ALERT = 0.6
CONCENTRATION_ALERT = 0.5
INSIGHTS = (
    "rank int, kind string, score double, text string, observation string, "
    "why_it_matters string, action string"
)


@dataclass(frozen=True)
class Insight:
    kind: str
    score: float
    text: str
    observation: str
    why_it_matters: str
    action: str


def _score(impact: float, strength: float, rows: int, factor: float = 1.0) -> float:
    """Impact times confidence; confidence grows with the row count up to 1000 rows."""
    return impact * min(1.0, strength * min(1.0, rows / FULL_CONFIDENCE_ROWS) * factor)


def _quality(rows, duplicates, missing) -> list[Insight]:
    issues = [f"{duplicates} duplicate rows"] if duplicates else []
    issues += [
        f"{m['column']} is {m['missing_ratio']:.0%} empty"
        for m in missing if m["missing_ratio"] >= MISSING_ALERT
    ]
    if not issues:
        return []
    return [Insight(
        "quality", _score(0.6, 0.9, rows),
        f"Data quality: {', '.join(issues)}.", f"{len(issues)} quality problems",
        "Repeated or absent records bias every figure drawn from the table.",
        "Drop repeated rows; fill or drop sparse columns.",
    )]


def _outliers(rows, stats) -> list[Insight]:
    found = [s for s in stats if (s["outlier_ratio"] or 0.0) > OUTLIER_ALERT]
    if not found:
        return []
    top = max(found, key=lambda s: s["outlier_ratio"])
    return [Insight(
        "outliers", _score(0.8, 0.8, rows, top["outlier_ratio"]),
        f"Outliers: {top['outlier_ratio']:.1%} of '{top['column']}' lie beyond 1.5 "
        "interquartile ranges.", f"'{top['column']}' has many extreme values",
        "Extreme values pull means and fitted lines.",
        "Prefer medians, trim, or transform the column.",
    )]


def _skew(rows, stats) -> list[Insight]:
    found = [s for s in stats if abs(s["skewness"] or 0.0) > SKEW_ALERT]
    if not found:
        return []
    top = max(found, key=lambda s: abs(s["skewness"]))
    side = "right" if top["skewness"] > 0 else "left"
    return [Insight(
        "skewness", _score(0.8, 0.9, rows, min(1.0, abs(top["skewness"]) / 5)),
        f"Skew: '{top['column']}' is strongly {side}-skewed ({top['skewness']:.2f}).",
        f"'{top['column']}' is not symmetric",
        "Methods that assume symmetry mislead here.",
        "Use a log scale or rank-based methods.",
    )]


def _correlation(rows, pairs) -> list[Insight]:
    negative = [p for p in pairs if p["sign"] == "negative"]
    positive = [p for p in pairs if p["sign"] == "positive"]
    if not pairs:
        return []
    top = (min(negative, key=lambda p: p["corr"]) if negative
           else max(positive, key=lambda p: p["corr"]))
    way = "opposite directions" if negative else "the same direction"
    return [Insight(
        "correlation", _score(0.8, 0.85, rows, abs(top["corr"])),
        f"Correlation: {top['col_a']} and {top['col_b']} move in {way} "
        f"(r={top['corr']:.2f}).",
        f"'{top['col_a']}' and '{top['col_b']}' carry similar information",
        "Related inputs make the effect of each hard to tell apart.",
        "Keep one of them, or combine them.",
    )]


def _identifiers(rows, identifiers, reasons) -> list[Insight]:
    if not identifiers:
        return []
    named = ", ".join(f"{c} ({', '.join(reasons.get(c, ()))})" for c in identifiers)
    return [Insight(
        "identifiers", _score(0.4, 0.95, rows),
        f"Identifiers left out of the analysis: {named}.", f"{len(identifiers)} identifier columns",
        "Keys name rows; they do not describe them.", "Use them for joins only.",
    )]


def _concentration(rows, dominant) -> list[Insight]:
    if not dominant:
        return []
    top = max(dominant, key=lambda d: d["ratio"])
    if top["ratio"] <= CONCENTRATION_ALERT:
        return []
    return [Insight(
        "concentration", _score(0.5, 0.8, rows, top["ratio"]),
        f"Concentration: {top['ratio']:.0%} of {top['column']} is '{top['value']}'.",
        f"'{top['column']}' is dominated by one value",
        "One group decides the totals.", "Watch that group, and analyse the others apart.",
    )]


def generate_insights(
    *,
    rows: int,
    duplicates: int = 0,
    missing: Sequence[Mapping[str, Any]] = (),
    stats: Sequence[Mapping[str, Any]] = (),
    pairs: Sequence[Mapping[str, Any]] = (),
    identifiers: Sequence[str] = (),
    identifier_reasons: Mapping[str, Sequence[str]] | None = None,
    dominant: Sequence[Mapping[str, Any]] = (),
    dataset_type: str = "unknown",
) -> list[Insight]:
    """The three highest-scored findings. Inputs have one entry per column or pair of columns.
    Identifier and concentration findings only join while fewer than three were found."""
    found = [
        *_quality(rows, duplicates, missing), *_outliers(rows, stats),
        *_skew(rows, stats), *_correlation(rows, pairs),
    ]
    if len(found) < KEEP:
        found += _identifiers(rows, identifiers, identifier_reasons or {})
    if len(found) < KEEP:
        found += _concentration(rows, dominant)
    if dataset_type == "feature_dataset":
        found.append(Insight(
            "features", 0.5,
            "The table holds features only: look at distributions and relationships.",
            "No dimension or time to group by", "Group-by views have nothing to group on.",
            "Study distributions, correlation and importance.",
        ))
    if not found:
        found.append(Insight(
            "clean", 0.1, "No notable problem was found; the table is ready for analysis.",
            "Nothing stands out", "Clean input makes results reliable.", "Carry on.",
        ))
    return sorted(found, key=lambda i: -i.score)[:KEEP]


def insight_rows(insights: Sequence[Insight]) -> list[tuple]:
    return [
        (n, i.kind, i.score, i.text, i.observation, i.why_it_matters, i.action)
        for n, i in enumerate(insights, start=1)
    ]
