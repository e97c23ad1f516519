"""Panel training: models compete on purged out-of-sample folds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pricing import CostModel
from ..operators.audit import BarAudit
from ..operators.features import PANEL_COLUMNS, cross_sectional_features, require_columns
from ..operators.fingerprint import DatasetMetadata, dataset_fingerprint
from ..operators.folds import PurgedFolds, with_date_numbers
from ..operators.gates import eligible_for_promotion
from ..operators.labels import panel_labels
from ..operators.linear import coverage
from ..operators.metrics import research_score
from ..operators.panel import panel_execution, panel_metrics
from ..operators.quality import BAR_COLUMNS
from ..operators.ranking import leaderboard
from ..operators.series import DEFAULT_LAYOUT, SeriesLayout
from ..operators.trees import ModelConfig, train_oos
from ..session import interim
from ..sources.journals import experiment_artifacts

DEFAULT_MODELS = (ModelConfig("ridge"), ModelConfig("elastic_net"), ModelConfig("random_forest"), ModelConfig("hist_gb"))


@dataclass(frozen=True)
class TrainingRun:
    leaderboard: DataFrame
    predictions: DataFrame
    executed: DataFrame
    artifacts: DataFrame
    fingerprint: str
    folds: PurgedFolds
    horizon: int

    def champion_candidate(self) -> DataFrame:
        """The best-ranked eligible model (no row if none is)."""
        best = F.min(F.when(F.col("eligible"), F.struct("rank", "model")))
        return self.leaderboard.agg(best.alias("b")).where("b IS NOT NULL").select("b.model", "b.rank")


def run_training(
    bars: DataFrame,
    metadata: DatasetMetadata,
    models: Sequence[ModelConfig] = DEFAULT_MODELS,
    horizon: int = 5,
    folds: PurgedFolds | None = None,
    top_fraction: float = 0.30,
    costs: CostModel = CostModel(),
    layout: SeriesLayout = DEFAULT_LAYOUT,
) -> TrainingRun:
    """Validate, compute features and labels once, train every model, trade its predictions, rank."""
    if horizon <= 0:
        raise ValueError("horizon must be positive")
    label = f"fwd_return_{horizon}"
    require_columns(bars, BAR_COLUMNS)
    panel, audit = bars.withColumn("ts", F.col("ts").cast("timestamp")), BarAudit()
    rows = panel_labels(cross_sectional_features(panel, layout, audit), (horizon,), layout=layout)
    rows = interim(with_date_numbers(rows, "ts", layout).select("symbol", "ts", "date_idx", "close", *PANEL_COLUMNS, label))
    audit.require()
    n_dates = rows.agg(F.max("date_idx") + 1).first()[0]  # one number sizes the folds
    folds = folds or PurgedFolds.for_dates(n_dates, horizon)
    per_model = [
        train_oos(rows, PANEL_COLUMNS, label, folds, n_dates, config)
        .select(F.lit(config.name).alias("model"), "symbol", "ts", "fold", "prediction")
        for config in models
    ]
    predictions = interim(reduce(DataFrame.unionByName, per_model))
    executed = panel_execution(rows, predictions, ("model",), top_fraction, costs, layout)
    metrics = panel_metrics(executed, ("model",)).join(coverage(predictions, ("model",)), "model")
    order = F.array_position(F.array(*[F.lit(m.name) for m in models]), F.col("model"))
    scored = metrics.withColumns({
        "score": research_score(metrics.columns, F.col("robustness") * F.col("oos_coverage")),
        "grade": F.lit(metadata.grade),
        "ordinal": order,
        "board": F.lit(1),
    })
    ranked = interim(
        leaderboard(scored, ("board",)).withColumn("eligible", eligible_for_promotion()).drop("board", "ordinal")
    )
    print_of = dataset_fingerprint(rows.select("symbol", "ts", *PANEL_COLUMNS), metadata).first()["fingerprint"]
    numbers = [f.name for f in ranked.schema.fields if f.dataType.simpleString() == "double"]
    artifacts = experiment_artifacts(
        ranked, metadata, print_of, PANEL_COLUMNS, label, {m.name: dict(m.params) for m in models}, models[0].seed, numbers
    )
    return TrainingRun(ranked, predictions, executed, artifacts, print_of, folds, horizon)
