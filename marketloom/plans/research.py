"""Single-asset research for every symbol at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import signals as S
from ..operators.backtest import BacktestConfig, RiskConfig, gated_backtest, strategy_rows
from ..operators.champions import PromotionCriteria, champion_of_leaderboard
from ..operators.features import TECHNICAL_COLUMNS, technical_features
from ..operators.gates import review_findings
from ..operators.labels import supervised_rows
from ..operators.linear import walk_forward_ridge
from ..operators.metrics import baseline_robustness, full_metrics, research_score
from ..operators.ranking import leaderboard
from ..operators.series import DEFAULT_LAYOUT, SeriesLayout, latest_per_key
from ..session import interim

RISK = RiskConfig(
    max_position_weight=1.0, max_drawdown=0.10, max_daily_loss=0.04, max_data_age_seconds=300.0, abnormal_volatility=0.80
)
CRITERIA = PromotionCriteria(min_oos_samples=50, min_robustness=0.40, score_margin=0.02, max_drawdown=0.50)
SIZING = S.SizingConfig(target_volatility=0.18, max_position_weight=1.0)
ENSEMBLE, LEARNED = "ensemble", "ml_ridge"
WARM_UP = 21


@dataclass(frozen=True)
class ResearchRun:
    """Results keyed by symbol."""

    leaderboard: DataFrame
    backtests: DataFrame
    ensemble: DataFrame
    summary: DataFrame
    findings: DataFrame


def run_research(
    bars: DataFrame,
    benchmark: DataFrame | None = None,
    layout: SeriesLayout = DEFAULT_LAYOUT,
    strategies: tuple[S.Strategy, ...] = S.BASELINE_STRATEGIES,
    backtest_config: BacktestConfig = BacktestConfig(),
    risk: RiskConfig = RISK,
) -> ResearchRun:
    """Rule strategies, walk-forward ridge, gated backtests, leaderboard, champion, regime ensemble.

    ``layout`` keys name one asset's series. Features and signals are stored once, then every strategy of
    every asset runs as one series in the same jobs.
    """
    keys, ts = list(layout.keys), layout.order[0]
    names = [s.name for s in strategies]
    features = interim(technical_features(bars, layout))
    complete = supervised_rows(features.select(*keys, ts, "row_idx", "close", *TECHNICAL_COLUMNS), TECHNICAL_COLUMNS, 5, layout)
    learned = walk_forward_ridge(complete.drop("row_idx"), TECHNICAL_COLUMNS, "target", layout)
    predictions = learned.where(F.col("prediction").isNotNull()).select(*keys, ts, "prediction")

    scored = features.withColumns({s.name: s.score() for s in strategies}).withColumn("regime", S.regime())
    scored = scored.join(predictions, [*keys, ts], "left").withColumn(LEARNED, S.prediction_score("prediction"))
    every = [*names, LEARNED]
    scored = scored.withColumn("combined", S.regime_ensemble({n: F.col(n) for n in every}, "regime", S.RESEARCH_WEIGHTS))
    scored = scored.withColumn(ENSEMBLE, S.volatility_target("combined", "realized_vol_20", SIZING))
    signals = interim(scored.select(*keys, ts, "row_idx", "close", "regime", "prediction", *every, ENSEMBLE))

    run = layout.keyed(*keys, "strategy")
    long = strategy_rows(signals, {n: n for n in (*every, ENSEMBLE)}).select(
        *keys, ts, "row_idx", "close", "strategy", "signal"
    )
    tested = gated_backtest(long, config=backtest_config, risk=risk, layout=run)
    bench = None
    if benchmark is not None:
        moved = technical_features_return(benchmark, ts, layout)
        tested, bench = tested.join(moved, ts, "left"), "benchmark_return"
    tested = interim(tested)

    sizes = signals.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("bars"), F.count("prediction").alias("ml_oos_samples")
    )
    half = F.greatest(F.lit(1), F.floor(F.col("bars") / 2))
    coverage = F.when(F.col("strategy") == LEARNED, F.least(F.lit(1.0), F.col("ml_oos_samples") / half)).otherwise(F.lit(1.0))
    samples = F.when(F.col("strategy") == LEARNED, F.col("ml_oos_samples")).otherwise(
        F.greatest(F.lit(0), F.col("bars") - WARM_UP)
    )
    metrics = full_metrics(tested, run, "net_return", bench).join(sizes, keys)
    metrics = metrics.withColumn("oos_samples", samples).withColumn("robustness", baseline_robustness(coverage))
    metrics = interim(metrics.withColumn("score", research_score(metrics.columns)))
    ordinal = F.array_position(F.array(*[F.lit(n) for n in every]), F.col("strategy"))
    contenders = metrics.where(F.col("strategy") != ENSEMBLE).where(
        (F.col("strategy") != LEARNED) | (F.col("ml_oos_samples") > 0)
    )
    board = leaderboard(contenders.withColumn("ordinal", ordinal), keys)
    champion = champion_of_leaderboard(board, keys, name="strategy", criteria=CRITERIA)

    latest = latest_per_key(signals.select(*keys, ts, "regime", ENSEMBLE), keys, ts).select(
        *keys, F.col("regime").alias("latest_regime"), F.col(ENSEMBLE).alias("latest_signal")
    )
    whole = metrics.where(F.col("strategy") == ENSEMBLE).drop("strategy")
    summary = whole.join(latest, keys).join(champion, keys, "left").withColumn(
        "regime_degradation", (F.col("latest_regime") == S.BEAR) & (F.col("cagr") < 0)
    )
    return ResearchRun(
        leaderboard=board,
        backtests=tested,
        ensemble=tested.where(F.col("strategy") == ENSEMBLE),
        summary=summary,
        findings=review_findings(summary, keys),
    )


def technical_features_return(benchmark: DataFrame, ts: str, layout: SeriesLayout) -> DataFrame:
    """One-step benchmark returns on the benchmark's own calendar, 0 on its first row."""
    from ..operators.features import pct_change
    from ..operators.series import in_blocks

    own = SeriesLayout((), (ts,), layout.bucket, layout.block_rows)
    value = lambda rows, w: rows.withColumn("benchmark_return", F.coalesce(pct_change("close", 1, w), F.lit(0.0)))
    return in_blocks(benchmark.select(ts, "close"), own, value, back=1).select(ts, "benchmark_return")
