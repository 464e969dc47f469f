"""Named insights and statistics: compute one or all, store results with a status per item."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from mailprism.operators import insights, stats
from mailprism.sources import store

Builder = Callable[..., DataFrame]

INSIGHTS: dict[str, Builder] = {
    "weekly_scoreboard": insights.weekly_scoreboard,
    "brand_sequences": insights.brand_sequences,
    "subject_formulas": insights.subject_formulas,
    "new_tactics": insights.new_tactics,
}

STATISTICS: dict[str, Builder] = {
    "daily_digest": stats.daily_digest,
    "weekly_digest": stats.weekly_digest,
    "brand_spotlight": stats.brand_spotlight,
    "subject_rates": stats.subject_rates,
    "archive_stats": lambda df, t: stats.archive_stats(df),
    "brand_strategy": stats.brand_strategy,
    "weekly_roundup": stats.weekly_roundup,
    "data_points": stats.data_points,
    "contrarian_points": stats.contrarian_points,
    "tip_points": stats.tip_points,
    "month_trends": stats.month_trends,
    "outlier_brands": stats.outlier_brands,
    "timing_patterns": stats.timing_patterns,
    "burst_days": stats.burst_days,
    "spotlight_candidates": stats.spotlight_candidates,
    "teardown": stats.teardown,
}


def register(name: str, fn: Builder, kind: str = "insight") -> None:
    """Add a builder ``fn(df, t, **params)`` under a name."""
    (INSIGHTS if kind == "insight" else STATISTICS)[name] = fn


def run(name: str, df: DataFrame, t, **params) -> DataFrame:
    """One insight or statistic by name."""
    known = {**STATISTICS, **INSIGHTS}
    if name not in known:
        raise ValueError(f"unknown name {name!r}; one of {sorted(known)}")
    return known[name](df, t, **params)


def compute_and_store(name: str, df: DataFrame, t, path: str, computed_at=None) -> None:
    if name not in INSIGHTS:
        raise ValueError(f"unknown insight {name!r}; one of {sorted(INSIGHTS)}")
    store.write_insight(INSIGHTS[name](df, t), name, t, path, computed_at)


def run_all(df: DataFrame, t, path: str, computed_at=None) -> dict[str, dict]:
    """Compute and store every insight; a failing one does not stop the others."""
    report = {}
    for name in INSIGHTS:
        try:
            compute_and_store(name, df, t, path, computed_at)
            report[name] = {"status": "ok"}
        except Exception as error:  # reported per item
            report[name] = {"status": "error", "error": str(error)}
    return report
