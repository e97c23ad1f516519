"""Daily learning report per run."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.gates import review_findings
from ..operators.ledger import regret_summary, require_causal
from ..operators.metrics import STABILITY_COLUMNS, stability_metrics


@dataclass(frozen=True)
class LearningReport:
    metrics: DataFrame
    findings: DataFrame


def daily_report(
    returns: DataFrame,
    counterfactuals: DataFrame,
    keys: Sequence[str],
    base_metrics: DataFrame | None = None,
    ret: str = "net_return",
    ts: str = "ts",
) -> LearningReport:
    """Stability and regret per run, and the findings they call for. Stability columns replace those of
    ``base_metrics`` (which may also carry ``regime_degradation``)."""
    keys = list(keys)
    metrics = stability_metrics(returns, keys, ret, ts)
    if base_metrics is not None:
        metrics = metrics.join(base_metrics.drop(*STABILITY_COLUMNS), keys, "left")
    regret = require_causal(regret_summary(counterfactuals, keys)).drop("lookahead_rows")
    counts = [c for c in regret.columns if c not in keys]
    whole = metrics.join(regret, keys, "left").fillna(0, counts)
    return LearningReport(metrics=whole, findings=review_findings(whole, keys))


