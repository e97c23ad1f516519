"""Bars, features, labels, signals, ungated backtests, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions import signals as S
from marketloom.operators import features as FE
from marketloom.operators import labels as LA
from marketloom.operators import metrics as ME
from marketloom.operators.backtest import backtest, gated_backtest, strategy_rows
from marketloom.operators.backtest import RiskConfig
from marketloom.operators.series import SeriesLayout

from . import sql
from .registry import query, r, rs, sql_round, wall_clock
from .tables import bars, benchmark_bars, daily_bars

STRATEGIES = ("trend", "momentum", "mean_reversion", "breakout")
RUN = SeriesLayout(keys=("symbol", "strategy"))


def feature_rows(spark, sf):
    return FE.technical_features(bars(spark, sf))


def signal_rows(spark, sf, daily=False):
    features = FE.technical_features((daily_bars if daily else bars)(spark, sf))
    return features.withColumns({s.name: s.score() for s in S.BASELINE_STRATEGIES})


def backtest_rows(spark, sf, daily=False):
    slim = signal_rows(spark, sf, daily).select("symbol", "ts", "row_idx", "close", *STRATEGIES)
    long = strategy_rows(slim, {s: s for s in STRATEGIES}).drop(*STRATEGIES)
    return backtest(long, layout=RUN)


@query("regime_counts", f"WITH {sql.BARS}, {sql.FEATURES}, {sql.SIGNALS} SELECT symbol, regime, count(*) AS bars FROM signals GROUP BY 1, 2")
def regime_counts(spark, sf):
    return feature_rows(spark, sf).groupBy("symbol", S.regime().alias("regime")).agg(F.count(F.lit(1)).alias("bars"))


@query("bars_hourly", f"WITH {sql.BARS} SELECT symbol, ts, {sql_round(('open','high','low','close','volume'))} FROM bars")
def bars_hourly(spark, sf):
    return bars(spark, sf).select("symbol", wall_clock(), *rs(("open", "high", "low", "close", "volume")))


@query("features_technical", f"WITH {sql.BARS}, {sql.FEATURES} SELECT symbol, ts, {sql_round(FE.TECHNICAL_COLUMNS)} FROM features")
def features_technical(spark, sf):
    return feature_rows(spark, sf).select("symbol", wall_clock(), *rs(FE.TECHNICAL_COLUMNS))


RANK_SQL = ", ".join(
    f"CASE WHEN {src} IS NOT NULL THEN (rank() OVER (PARTITION BY ts ORDER BY {src} ASC NULLS LAST)"
    f" + (count(*) OVER (PARTITION BY ts, {src}) - 1)/2.0e0)/count({src}) OVER (PARTITION BY ts) END AS {out}"
    for out, src in FE.RANKED.items()
)
PANEL_SQL = f"panel AS (SELECT *, {RANK_SQL} FROM features)"


@query("features_cross_sectional", f"WITH {sql.BARS}, {sql.FEATURES}, {PANEL_SQL} SELECT symbol, ts, {sql_round(FE.PANEL_COLUMNS)} FROM panel")
def features_cross_sectional(spark, sf):
    return FE.cross_sectional_features(bars(spark, sf)).select("symbol", wall_clock(), *rs(FE.PANEL_COLUMNS))


@query("features_long_horizon", f"""WITH {sql.BARS}
SELECT symbol, ts, round(close/lag(close, 60) OVER w - 1, 8) + 0.0 AS momentum_60,
       round(close/lag(close, 120) OVER w - 1, 8) + 0.0 AS momentum_120,
       round(CASE WHEN count(close) OVER f = 60 THEN 1 - close/max(close) OVER f END, 8) + 0.0 AS drawdown_60
FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts),
  f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""")
def features_long_horizon(spark, sf):
    return FE.long_horizon_features(bars(spark, sf)).select(
        "symbol", wall_clock(), *rs(("momentum_60", "momentum_120", "drawdown_60")))


LABEL_SQL = ", ".join(
    f"close[{h}]" for h in ())
LABELS = ", ".join(
    f"lead(close, {h}) OVER w/close - 1 AS fwd_return_{h}, "
    f"CASE WHEN count(close) OVER f{h} = {h} THEN min(close) OVER f{h}/close - 1 END AS adverse_excursion_{h}"
    for h in (1, 5, 20)
)
LABEL_WINDOWS = "WINDOW w AS (PARTITION BY symbol ORDER BY ts), " + ", ".join(
    f"f{h} AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)" for h in (1, 5, 20)
)
LABEL_COLUMNS = tuple(f"{kind}_{h}" for h in (1, 5, 20) for kind in ("fwd_return", "adverse_excursion", "fwd_excess_return"))


@query("labels_forward", f"""WITH {sql.BARS},
bench AS (SELECT ts, round(avg(close), 6) AS close FROM bars GROUP BY ts),
moved AS (SELECT ts, {", ".join(f"lead(close, {h}) OVER (ORDER BY ts)/close - 1 AS b{h}" for h in (1, 5, 20))} FROM bench),
lab AS (SELECT symbol, ts, {LABELS} FROM bars {LABEL_WINDOWS}),
ex AS (SELECT lab.*, {", ".join(f"fwd_return_{h} - b{h} AS fwd_excess_return_{h}" for h in (1, 5, 20))} FROM lab LEFT JOIN moved USING (ts))
SELECT symbol, ts, {sql_round(LABEL_COLUMNS, 7)} FROM ex""")
def labels_forward(spark, sf):
    b = bars(spark, sf)
    return LA.panel_labels(b, benchmark=benchmark_bars(b)).select("symbol", wall_clock(), *rs(LABEL_COLUMNS, 7))


@query("supervised_rows", f"""WITH {sql.BARS}, {sql.FEATURES},
t AS (SELECT *, lead(close, 5) OVER (PARTITION BY symbol ORDER BY ts)/close - 1 AS target FROM features)
SELECT symbol, ts, {sql_round((*FE.TECHNICAL_COLUMNS, 'target'))} FROM t
WHERE {" AND ".join(f"{c} IS NOT NULL" for c in (*FE.TECHNICAL_COLUMNS, 'target'))}""")
def supervised_rows(spark, sf):
    rows = LA.supervised_rows(feature_rows(spark, sf), FE.TECHNICAL_COLUMNS)
    return rows.select("symbol", wall_clock(), *rs((*FE.TECHNICAL_COLUMNS, "target")))


@query("labels_rank_hurdle", f"""WITH {sql.BARS},
t AS (SELECT *, lead(close, 5) OVER (PARTITION BY symbol ORDER BY ts)/close - 1 AS f FROM bars)
SELECT symbol, ts, round(CASE WHEN f IS NOT NULL THEN (rank() OVER (PARTITION BY ts ORDER BY f ASC NULLS LAST)
   + (count(*) OVER (PARTITION BY ts, f) - 1)/2.0e0)/count(f) OVER (PARTITION BY ts) END, 8) + 0.0 AS fwd_rank,
  CAST(f > 0.001e0 AS INTEGER) AS beats_hurdle FROM t""")
def labels_rank_hurdle(spark, sf):
    rows = LA.panel_labels(bars(spark, sf), (5,))
    rows = LA.hurdle_label(LA.rank_label(rows, "fwd_return_5", "fwd_rank"), "fwd_return_5", "beats_hurdle", 0.0003, 0.0007)
    return rows.select("symbol", wall_clock(), r("fwd_rank"), "beats_hurdle")


@query("signals_ensemble_sizing", f"""WITH {sql.BARS}, {sql.FEATURES}, {sql.SIGNALS},
c AS (SELECT *, {sql.ensemble(S.LIVE_WEIGHTS, STRATEGIES)} AS combined FROM signals),
z AS (SELECT *, CASE WHEN realized_vol_20 > 0 THEN least(1.0e0, combined*least(1.5e0, 0.15e0/realized_vol_20)) ELSE 0.0e0 END AS weight FROM c)
SELECT symbol, ts, regime, {sql_round((*STRATEGIES, 'combined', 'weight'))} FROM z""")
def signals_ensemble_sizing(spark, sf):
    rows = signal_rows(spark, sf).withColumn("regime", S.regime())
    combined = S.regime_ensemble({s: F.col(s) for s in STRATEGIES}, "regime", S.LIVE_WEIGHTS)
    rows = rows.withColumn("combined", combined)
    rows = rows.withColumn("weight", S.volatility_target("combined", "realized_vol_20"))
    return rows.select("symbol", wall_clock(), "regime", *rs((*STRATEGIES, "combined", "weight")))


BACKTEST_COLUMNS = ("asset_return", "position", "turnover", "cost_rate", "net_return")


@query("backtest_ungated", f"""WITH {sql.BARS}, {sql.FEATURES}, {sql.SIGNALS}, {sql.LONG}, {sql.BACKTEST}
SELECT symbol, strategy, ts, {sql_round(BACKTEST_COLUMNS)}, {sql_round(('equity', 'cost'), 5)} FROM backtest""")
def backtest_ungated(spark, sf):
    return backtest_rows(spark, sf).select(
        "symbol", "strategy", wall_clock(), *rs(BACKTEST_COLUMNS), *rs(("equity", "cost"), 5))


@query("drawdown_curve", f"""WITH {sql.BARS}, {sql.FEATURES}, {sql.SIGNALS}, {sql.LONG}, {sql.BACKTEST}, {sql.metrics("backtest", "symbol, strategy")}
SELECT symbol, strategy, ts, {sql_round(('wealth', 'dd'), 7)} FROM m1""".replace("AS dd FROM m1", "AS drawdown FROM m1"))
def drawdown_curve(spark, sf):
    return ME.drawdown_curve(backtest_rows(spark, sf), RUN).select(
        "symbol", "strategy", wall_clock(), *rs(("wealth", "drawdown"), 7))


BT_DAILY = f"WITH {sql.DAILY}, {sql.FEATURES}, {sql.SIGNALS}, {sql.LONG}, {sql.BACKTEST}"


@query("performance_metrics", f"""{BT_DAILY},
bench AS (SELECT ts, avg(asset_return) AS bench_return FROM backtest WHERE strategy = 'trend' GROUP BY ts),
rows_ AS (SELECT backtest.*, bench_return FROM backtest LEFT JOIN bench USING (ts)),
{sql.metrics("rows_", "symbol, strategy", bench="bench_return")}
SELECT symbol, strategy, {sql_round(ME.PERFORMANCE_COLUMNS, 6)} FROM metrics""")
def performance_metrics(spark, sf):
    rows = backtest_rows(spark, sf, daily=True)
    bench = rows.where("strategy = 'trend'").groupBy("ts").agg(F.avg("asset_return").alias("bench_return"))
    out = ME.performance_metrics(rows.join(bench, "ts", "left"), RUN, benchmark_ret="bench_return")
    return out.select("symbol", "strategy", *rs(ME.PERFORMANCE_COLUMNS, 6))


@query("monthly_returns", f"""{BT_DAILY}, {sql.metrics("backtest", "symbol, strategy")}
SELECT symbol, strategy, month, {sql_round(('month_return',))} FROM months""")
def monthly_returns(spark, sf):
    rows = ME.monthly_returns(backtest_rows(spark, sf, daily=True), ("symbol", "strategy"))
    return rows.select("symbol", "strategy", wall_clock("month"), r("month_return"))


@query("stability_metrics", f"""{BT_DAILY}, {sql.metrics("backtest", "symbol, strategy")}
SELECT symbol, strategy, {sql_round(ME.STABILITY_COLUMNS)} FROM stability""")
def stability_metrics(spark, sf):
    rows = ME.stability_metrics(backtest_rows(spark, sf, daily=True), ("symbol", "strategy"))
    return rows.select("symbol", "strategy", *rs(ME.STABILITY_COLUMNS))


LEADERBOARD_SQL = f"""{BT_DAILY}, {sql.metrics("backtest", "symbol, strategy")},
costs AS (SELECT symbol, strategy, sum(turnover) AS turnover, sum(cost_rate) AS cost_ratio FROM backtest GROUP BY 1, 2),
full_ AS (SELECT * FROM metrics JOIN stability USING (symbol, strategy) JOIN costs USING (symbol, strategy)),
rob AS (SELECT *, greatest(0.0e0, least(1.0e0, (1 - max_drawdown)*(1 - negative_month_rate))) AS robustness FROM full_),
scored AS (SELECT *, {sql.SCORE} AS score FROM rob)"""


def leaderboard_rows(spark, sf):
    rows = ME.full_metrics(backtest_rows(spark, sf, daily=True), RUN)
    rows = rows.withColumn("robustness", ME.baseline_robustness())
    return rows.withColumn("score", ME.research_score(rows.columns))


@query("research_score", f"""{LEADERBOARD_SQL}
SELECT symbol, strategy, {sql_round(('turnover', 'cost_ratio', 'robustness', 'score'), 6)} FROM scored""")
def research_score(spark, sf):
    return leaderboard_rows(spark, sf).select(
        "symbol", "strategy", *rs(("turnover", "cost_ratio", "robustness", "score"), 6))
