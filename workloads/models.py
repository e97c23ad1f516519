"""Folds, linear and tree models, panel execution, gated backtests, analogues, data joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions import signals as S
from marketloom.operators import analogue as AN
from marketloom.operators import champions as CH
from marketloom.operators import features as FE
from marketloom.operators import folds as FO
from marketloom.operators import labels as LA
from marketloom.operators import linear as LI
from marketloom.operators import panel as PA
from marketloom.operators import ranking as RA
from marketloom.operators.asof import as_of_join
from marketloom.operators.backtest import BacktestConfig, RiskConfig, gated_backtest, strategy_rows
from marketloom.operators.series import SeriesLayout, last_rows
from marketloom.operators.boosting import BoostConfig, boosted_oos
from marketloom.operators.trees import ModelConfig, tree_oos
from marketloom.operators.gates import advance_experiments, eligible_for_promotion, review_findings
from marketloom.session import interim

from . import sql
from .registry import query, r, rs, sql_round, wall_clock
from .research import BT_DAILY, LEADERBOARD_SQL, PANEL_SQL, RUN, STRATEGIES, leaderboard_rows, signal_rows
from .tables import bars, table

c = F.col
PURGED = FO.PurgedFolds(126, 21, 5, 5)
DATES_SQL = "dates AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS date_idx FROM (SELECT DISTINCT ts FROM bars))"
FOLDS_SQL = """folds AS (SELECT k, k*26 AS train_from, k*26 + 126 AS train_to, 131 + k*26 AS test_from, 131 + k*26 + 21 AS test_to
  FROM (SELECT unnest(range(0, 1000)) AS k) WHERE 131 + k*26 + 21 <= (SELECT count(*) FROM dates))"""


def n_dates(df):
    return df.select("ts").distinct().count()


@query("folds_purged", f"""WITH {sql.BARS}, {DATES_SQL}, {FOLDS_SQL}, p AS (SELECT symbol, date_idx FROM bars JOIN dates USING (ts))
SELECT k AS fold, count(*) FILTER (WHERE date_idx < train_to) AS train_rows, count(*) FILTER (WHERE date_idx >= test_from) AS test_rows,
  min(date_idx) AS first_train, max(date_idx) AS last_test
FROM p JOIN folds ON (date_idx >= train_from AND date_idx < train_to) OR (date_idx >= test_from AND date_idx < test_to) GROUP BY 1""")
def folds_purged(spark, sf):
    b = bars(spark, sf)
    total = PURGED.count(n_dates(b))
    rows = FO.with_date_numbers(b, "ts").select("symbol", "date_idx")
    train = rows.select(F.explode(PURGED.train_folds(c("date_idx"), total)).alias("fold"), "date_idx", F.lit(1).alias("train"))
    test = rows.select(PURGED.test_fold(c("date_idx"), total).alias("fold"), "date_idx", F.lit(0).alias("train"))
    return train.unionByName(test).where("fold IS NOT NULL").groupBy("fold").agg(
        F.count_if(c("train") == 1).alias("train_rows"), F.count_if(c("train") == 0).alias("test_rows"),
        F.min("date_idx").alias("first_train"), F.max("date_idx").alias("last_test"))


@query("folds_expanding", f"""WITH {sql.BARS}, p AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
f AS (SELECT unnest(range(0, 1000)) AS k)
SELECT symbol, k AS fold, count(*) FILTER (WHERE pos < 126 + k*26) AS train_rows, count(*) FILTER (WHERE pos >= 131 + k*26 AND pos < 152 + k*26) AS test_rows
FROM p JOIN f ON 152 + k*26 <= n GROUP BY 1, 2""")
def folds_expanding(spark, sf):
    """Train sizes add up from segments, test rows are counted directly."""
    from marketloom.operators.series import index_rows
    from pyspark.sql import Window

    folds = FO.ExpandingFolds(126, 21, 5)
    rows = index_rows(bars(spark, sf)).withColumn("pos", c("row_idx") - 1)
    sizes = rows.groupBy("symbol").agg(folds.count(F.count(F.lit(1))).alias("total"))
    seg = rows.groupBy("symbol", folds.segment(c("pos")).alias("fold")).agg(F.count(F.lit(1)).alias("n"))
    test = rows.groupBy("symbol", folds.test_fold(c("pos")).alias("fold")).agg(F.count(F.lit(1)).alias("test_rows"))
    upto = Window.partitionBy("symbol").orderBy("fold")
    train = seg.withColumn("train_rows", F.sum("n").over(upto)).drop("n")
    return train.join(test, ["symbol", "fold"]).join(sizes, "symbol").where(c("fold") < c("total")).select(
        "symbol", "fold", "train_rows", "test_rows")


def labelled_panel(spark, sf):
    """Panel features with the five-bar label and calendar numbers."""
    b = bars(spark, sf)
    rows = LA.panel_labels(FE.cross_sectional_features(b), (5,))
    return FO.with_date_numbers(rows, "ts")


LABELLED = f"""{sql.BARS}, {sql.FEATURES}, {PANEL_SQL}, {DATES_SQL}, {FOLDS_SQL},
lab AS (SELECT panel.*, date_idx, lead(close, 5) OVER (PARTITION BY symbol ORDER BY panel.ts)/close - 1 AS y FROM panel JOIN dates USING (ts))"""


@query("ridge_gram_sums", f"""WITH {LABELLED},
ok AS (SELECT * FROM lab WHERE y IS NOT NULL AND {" AND ".join(f"{x} IS NOT NULL" for x in FE.PANEL_COLUMNS)})
SELECT k AS fold, CAST(count(*) AS DOUBLE) AS n, round(sum(y), 7) + 0.0 AS y, round(sum(momentum_20*y), 7) + 0.0 AS xy1,
  round(sum(momentum_20*realized_vol_20), 7) + 0.0 AS x1x2, round(sum(momentum_rank*volume_rank), 6) + 0.0 AS x4x6
FROM ok JOIN folds ON date_idx >= train_from AND date_idx < train_to GROUP BY 1""")
def ridge_gram_sums(spark, sf):
    df = labelled_panel(spark, sf)
    total = PURGED.count(n_dates(df))
    terms = LI.gram_columns(FE.PANEL_COLUMNS, "fwd_return_5")
    usable = df.where(LI.known(FE.PANEL_COLUMNS) & c("fwd_return_5").isNotNull())
    train = usable.withColumn("fold", F.explode(PURGED.train_folds(c("date_idx"), total)))
    wanted = {"n": 7, "y": 7, "xy1": 7, "x1x2": 7, "x4x6": 6}
    return train.groupBy("fold").agg(*[r(F.sum(terms[k]), d).alias(k) for k, d in wanted.items()])


@query("ridge_single_feature", f"""WITH {LABELLED},
ok AS (SELECT * FROM lab WHERE y IS NOT NULL AND momentum_20 IS NOT NULL),
fit AS (SELECT k, count(*) AS n, avg(momentum_20) AS mx, avg(y) AS my, stddev_pop(momentum_20) AS sd, covar_pop(momentum_20, y) AS cov
        FROM ok JOIN folds ON date_idx >= train_from AND date_idx < train_to GROUP BY 1 HAVING count(*) >= 10),
t AS (SELECT lab.symbol, lab.ts, k AS fold, my + (n*cov/sd/(n + 1.0e0))/sd*(momentum_20 - mx) AS prediction
      FROM lab JOIN folds ON date_idx >= test_from AND date_idx < test_to JOIN fit USING (k) WHERE momentum_20 IS NOT NULL)
SELECT lab.symbol, lab.ts, t.fold, round(t.prediction, 9) + 0.0 AS prediction FROM lab LEFT JOIN t ON t.symbol = lab.symbol AND t.ts = lab.ts""")
def ridge_single_feature(spark, sf):
    df = labelled_panel(spark, sf)
    out = LI.purged_oos(df, ("momentum_20",), "fwd_return_5", PURGED, n_dates(df))
    return out.select("symbol", wall_clock(), "fold", r("prediction", 9))


@query("walk_forward_single_feature", f"""WITH {sql.BARS}, {sql.FEATURES},
t AS (SELECT *, lead(close, 5) OVER (PARTITION BY symbol ORDER BY ts)/close - 1 AS y FROM features),
ok AS (SELECT symbol, ts, momentum_20, y, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n
  FROM t WHERE y IS NOT NULL AND momentum_20 IS NOT NULL),
f AS (SELECT unnest(range(0, 1000)) AS k),
fit AS (SELECT symbol, k, count(*) AS m, avg(momentum_20) AS mx, avg(y) AS my, stddev_pop(momentum_20) AS sd, covar_pop(momentum_20, y) AS cov
  FROM ok JOIN f ON pos < 126 + 26*k AND 152 + 26*k <= n GROUP BY 1, 2),
p AS (SELECT ok.symbol, ok.ts, my + (m*cov/sd/(m + 1.0e0))/sd*(momentum_20 - mx) AS prediction
  FROM ok JOIN fit ON fit.symbol = ok.symbol AND pos >= 131 + 26*k AND pos < 152 + 26*k)
SELECT ok.symbol, ok.ts, round(prediction, 9) + 0.0 AS prediction FROM ok LEFT JOIN p ON p.symbol = ok.symbol AND p.ts = ok.ts""")
def walk_forward_single_feature(spark, sf):
    features = FE.technical_features(bars(spark, sf))
    rows = LA.supervised_rows(features, ("momentum_20",)).drop("row_idx")
    out = LI.walk_forward_ridge(rows, ("momentum_20",), "target", SeriesLayout())
    return out.select("symbol", wall_clock(), r("prediction", 9))


@query("elastic_net_oos_predictions")
def elastic_net_oos_predictions(spark, sf):
    df = interim(labelled_panel(spark, sf))
    return LI.purged_oos(df, FE.PANEL_COLUMNS, "fwd_return_5", PURGED, n_dates(df), "elastic_net").select(
        "symbol", wall_clock(), "fold", r("prediction", 9))


@query("oos_coverage", f"""WITH {LABELLED}
SELECT symbol, round(avg(CASE WHEN k IS NOT NULL THEN 1.0e0 ELSE 0.0e0 END), 8) + 0.0 AS oos_coverage, count(DISTINCT k) AS fold_count, count(k) AS oos_samples
FROM lab LEFT JOIN folds ON date_idx >= test_from AND date_idx < test_to AND momentum_20 IS NOT NULL GROUP BY 1""")
def oos_coverage(spark, sf):
    df = labelled_panel(spark, sf)
    out = LI.purged_oos(df, ("momentum_20",), "fwd_return_5", PURGED, n_dates(df))
    return LI.coverage(out, ("symbol",)).select("symbol", r("oos_coverage"), "fold_count", "oos_samples")


@query("information_coefficient", f"""WITH {sql.BARS}, {sql.FEATURES}, {sql.SIGNALS},
t AS (SELECT regime, momentum_20 AS p, lead(close, 5) OVER (PARTITION BY symbol ORDER BY ts)/close - 1 AS y FROM signals)
SELECT regime, round(corr(p, y), 8) + 0.0 AS information_coefficient, round(avg(CASE WHEN sign(p) = sign(y) THEN 1.0e0 ELSE 0.0e0 END), 8) + 0.0 AS directional_accuracy,
  count(*) AS samples FROM t WHERE p IS NOT NULL AND y IS NOT NULL GROUP BY 1""")
def information_coefficient(spark, sf):
    rows = LA.panel_labels(FE.technical_features(bars(spark, sf)), (5,)).withColumn("regime", S.regime())
    out = LI.information_coefficient(rows, "momentum_20", "fwd_return_5", ("regime",))
    return out.select("regime", *rs(("information_coefficient", "directional_accuracy")), "samples")


TREE_FOLDS = FO.PurgedFolds(360, 150, 5, 5)


@query("random_forest_oos_predictions")
def random_forest_oos_predictions(spark, sf):
    df = interim(labelled_panel(spark, sf))
    out = tree_oos(df, FE.PANEL_COLUMNS, "fwd_return_5", TREE_FOLDS, n_dates(df), ModelConfig("random_forest"))
    return out.select("symbol", wall_clock(), "fold", r("prediction", 9))


@query("boosted_trees_oos_predictions")
def boosted_trees_oos_predictions(spark, sf):
    df = interim(labelled_panel(spark, sf))
    out = boosted_oos(df, FE.PANEL_COLUMNS, "fwd_return_5", PURGED, n_dates(df), BoostConfig(max_iter=10))
    return out.select("symbol", wall_clock(), "fold", r("prediction", 9))


TOP = f"""pred AS (SELECT 'momentum' AS model, symbol, ts, momentum_20 AS prediction FROM features),
ranked AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY prediction DESC, symbol ASC) AS rk,
  greatest(1, CAST(ceil(count(*) OVER (PARTITION BY ts)*0.30e0) AS BIGINT)) AS n,
  count(*) FILTER (WHERE prediction > 0) OVER (PARTITION BY ts) AS pos FROM pred WHERE prediction IS NOT NULL),
weights AS (SELECT model, ts, symbol, 1.0e0/least(n, pos) AS weight FROM ranked WHERE prediction > 0 AND rk <= n)"""


def momentum_predictions(spark, sf):
    return FE.technical_features(bars(spark, sf)).select(
        F.lit("momentum").alias("model"), "symbol", "ts", c("momentum_20").alias("prediction"))


@query("top_fraction_weights", f"WITH {sql.BARS}, {sql.FEATURES}, {TOP} SELECT model, ts, symbol, {sql_round(('weight',))} FROM weights")
def top_fraction_weights(spark, sf):
    return PA.top_fraction_weights(momentum_predictions(spark, sf), ("model",)).select("model", wall_clock(), "symbol", r("weight"))


GRID = f"""{DATES_SQL},
grid AS (SELECT date_idx, dates.ts, s.symbol FROM dates, (SELECT DISTINCT symbol FROM bars) s),
rets AS (SELECT symbol, ts, coalesce(close/lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1, 0) AS ret FROM bars),
cells AS (SELECT g.*, coalesce(r.ret, 0) AS ret, coalesce(lag(coalesce(w.weight, 0)) OVER (PARTITION BY g.symbol ORDER BY date_idx), 0) AS executed
  FROM grid g LEFT JOIN rets r ON r.symbol = g.symbol AND r.ts = g.ts LEFT JOIN weights w ON w.symbol = g.symbol AND w.ts = g.ts),
moves AS (SELECT *, abs(executed - coalesce(lag(executed) OVER (PARTITION BY symbol ORDER BY date_idx), 0)) AS moved FROM cells),
net AS (SELECT ts, sum(executed*ret) AS gross_return, sum(moved) AS turnover, sum(executed*executed) AS concentration FROM moves
  WHERE ts >= (SELECT min(ts) FROM pred WHERE prediction IS NOT NULL) GROUP BY 1),
panel_net AS (SELECT 'momentum' AS model, *, turnover*3.0e0/10000 AS cost_rate, gross_return - turnover*3.0e0/10000 AS net_return FROM net)"""
NET = ("gross_return", "turnover", "cost_rate", "net_return", "concentration")


@query("panel_execution", f"WITH {sql.BARS}, {sql.FEATURES}, {TOP}, {GRID} SELECT model, ts, {sql_round(NET)} FROM panel_net")
def panel_execution(spark, sf):
    return PA.panel_execution(bars(spark, sf), momentum_predictions(spark, sf)).select("model", wall_clock(), *rs(NET))


PM = ("cagr", "sharpe", "max_drawdown", "cvar_95", "turnover", "cost_ratio", "negative_month_rate", "concentration", "instability", "robustness")


@query("panel_metrics", f"""WITH {sql.BARS}, {sql.FEATURES}, {TOP}, {GRID}, {sql.metrics("panel_net", "model")},
k AS (SELECT model, sum(turnover) AS turnover, sum(cost_rate) AS cost_ratio, avg(concentration) AS concentration FROM panel_net GROUP BY 1),
z AS (SELECT *, greatest(0.0e0, least(1.0e0, monthly_return_volatility)) AS instability FROM metrics JOIN stability USING (model) JOIN k USING (model)),
zz AS (SELECT *, greatest(0.0e0, least(1.0e0, (1 - max_drawdown)*(1 - instability)*(1 - negative_month_rate))) AS robustness FROM z)
SELECT model, {sql_round(PM, 6)} FROM zz""")
def panel_metrics(spark, sf):
    executed = PA.panel_execution(bars(spark, sf), momentum_predictions(spark, sf))
    return PA.panel_metrics(executed).select("model", *rs(PM, 6))


@query("panel_densified", f"""WITH {sql.BARS}, {DATES_SQL},
g AS (SELECT date_idx, dates.ts, s.symbol FROM dates, (SELECT DISTINCT symbol FROM bars) s)
SELECT g.symbol, g.ts, g.date_idx, b.close IS NOT NULL AS observed, round(b.volume, 1) + 0.0 AS volume,
  round(last_value(b.close IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.date_idx ROWS UNBOUNDED PRECEDING), 8) + 0.0 AS close
FROM g LEFT JOIN bars b ON b.symbol = g.symbol AND b.ts = g.ts""")
def panel_densified(spark, sf):
    rows = PA.densify(bars(spark, sf).select("symbol", "ts", "close", "volume"), fill=("close",))
    return rows.select("symbol", wall_clock(), "date_idx", "observed", r("volume", 1), r("close"))


GATED = ("position", "turnover", "net_return")
RISK = RiskConfig(max_drawdown=0.10, max_daily_loss=0.04, abnormal_volatility=0.80)


@query("backtest_risk_gated", f"""WITH RECURSIVE {sql.BARS}, {sql.FEATURES}, {sql.SIGNALS}, {sql.LONG},
e0 AS (SELECT *, coalesce(close/lag(close) OVER w - 1, 0) AS ret, coalesce(lag(signal) OVER w, 0.0e0) AS q, row_number() OVER w AS k
  FROM long WINDOW w AS (PARTITION BY symbol, strategy ORDER BY ts)),
e AS (SELECT *, CASE WHEN count(ret) OVER p >= 5 THEN stddev_pop(ret) OVER p*sqrt(252.0e0) ELSE 0.0e0 END >= 0.80e0 AS wild
  FROM e0 WINDOW p AS (PARTITION BY symbol, strategy ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
walk AS (
  SELECT symbol, strategy, NULL::TIMESTAMP AS ts, 0::BIGINT AS k, 10000.0e0 AS equity, 10000.0e0 AS peak, 0.0e0 AS position, 0.0e0 AS turnover, 0.0e0 AS net_return FROM e WHERE k = 1
  UNION ALL
  SELECT symbol, strategy, ts, k, equity*(1 + net), greatest(peak, equity*(1 + net)), w, turn, net FROM (
    SELECT *, w*ret - turn*3.0e0/10000.0e0 AS net FROM (
      SELECT *, abs(w - before) AS turn FROM (
        SELECT e.symbol, e.strategy, e.ts, e.k, e.ret, walk.equity, walk.peak, walk.position AS before,
          CASE WHEN walk.net_return <= -0.04e0 OR greatest(0.0e0, 1 - walk.equity/walk.peak) >= 0.10e0 OR e.wild THEN 0.0e0 ELSE e.q END AS w
        FROM walk JOIN e ON e.symbol = walk.symbol AND e.strategy = walk.strategy AND e.k = walk.k + 1))))
SELECT symbol, strategy, ts, {sql_round(GATED)}, {sql_round(('equity',), 5)} FROM walk WHERE k > 0""")
def backtest_risk_gated(spark, sf):
    slim = signal_rows(spark, sf).select("symbol", "ts", "row_idx", "close", *STRATEGIES)
    long = strategy_rows(slim, {s: s for s in STRATEGIES}).drop(*STRATEGIES)
    out = gated_backtest(long, config=BacktestConfig(), risk=RISK, layout=RUN)
    return out.select("symbol", "strategy", wall_clock(), *rs(GATED), r("equity", 5))


def combined_rows(spark, sf):
    rows = signal_rows(spark, sf).withColumn("regime", S.regime())
    combined = S.regime_ensemble({s: c(s) for s in STRATEGIES}, "regime", S.LIVE_WEIGHTS)
    return rows.withColumn("combined", combined)


EDGE = ("expected_return", "downside_risk", "uncertainty", "confidence")
ANALOGUE = f"""{sql.BARS}, {sql.FEATURES}, {sql.SIGNALS},
cmb AS (SELECT *, {sql.ensemble(S.LIVE_WEIGHTS, STRATEGIES)} AS combined, lead(close) OVER (PARTITION BY symbol ORDER BY ts)/close - 1 AS nxt FROM signals),
cur AS (SELECT symbol, arg_max(combined, ts) AS now, arg_max(regime, ts) AS regime, max(ts) AS last_ts FROM cmb GROUP BY 1),
st AS (SELECT cur.symbol, any_value(now) AS now, any_value(cur.regime) AS regime, any_value(last_ts) AS last_ts, count(nxt) AS n, avg(nxt) AS mean, stddev_pop(nxt)/sqrt(count(nxt)) AS unc,
    sqrt(avg(nxt*nxt) FILTER (WHERE nxt < 0)) AS down
  FROM cur LEFT JOIN cmb ON cmb.symbol = cur.symbol AND abs(combined - now) <= 0.10e0 AND nxt IS NOT NULL GROUP BY 1),
edge AS (SELECT symbol, regime, last_ts, n AS sample_count, CASE WHEN n >= 12 THEN mean*(n/(n + 20.0e0)) - 0.5e0*unc ELSE 0.0e0 END AS edge,
    CASE WHEN n >= 12 THEN coalesce(down, 0) ELSE 0.0e0 END AS downside_risk, CASE WHEN n >= 12 THEN unc ELSE 1.0e0 END AS uncertainty,
    CASE WHEN n >= 12 THEN least(1.0e0, n/50.0e0)*now ELSE 0.0e0 END AS confidence FROM st),
edges AS (SELECT *, greatest(0.0e0, edge) AS expected_return, edge > 0 AND confidence > 0 AS eligible FROM edge)"""


@query("analogue_edges", f"WITH {ANALOGUE} SELECT symbol, regime, sample_count, eligible, {sql_round(EDGE)} FROM edges")
def analogue_edges(spark, sf):
    out = AN.analogue_edges(combined_rows(spark, sf), SeriesLayout())
    return out.select("symbol", "regime", "sample_count", "eligible", *rs(EDGE))


@query("last_bars", f"""WITH {sql.BARS}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k, count(*) OVER (PARTITION BY symbol) AS total FROM bars)
SELECT symbol, ts, least(250, total) AS bar_count, least(250, total) >= 80 AS enough_bars FROM n WHERE k <= 250""")
def last_bars(spark, sf):
    out = last_rows(bars(spark, sf), SeriesLayout(), 250, minimum=80)
    return out.select("symbol", wall_clock(), c("bar_count").cast("bigint").alias("bar_count"), "enough_bars")


@query("as_of_join", f"""WITH {sql.BARS},
obs AS (SELECT event_type AS symbol, ts + INTERVAL 90 MINUTE AS available_time, value FROM events),
d AS (SELECT symbol, ts FROM bars)
SELECT d.symbol, d.ts, o.value FROM d ASOF LEFT JOIN obs o ON o.symbol = d.symbol AND o.available_time <= d.ts""")
def point_in_time_join(spark, sf):
    obs = table(spark, sf, "events").select(
        c("event_type").alias("symbol"), (c("ts").cast("timestamp") + F.expr("INTERVAL 90 MINUTES")).alias("available_time"), "value")
    return as_of_join(bars(spark, sf).select("symbol", "ts"), obs).select("symbol", wall_clock(), "value")


# --- arena -----------------------------------------------------------------------------------------

CRIT = CH.PromotionCriteria(min_oos_samples=50, min_robustness=0.20, score_margin=0.02, max_drawdown=0.80,
                            max_negative_month_rate=0.80, max_drawdown_deterioration=0.05, max_negative_month_deterioration=0.05)
ARENA_SQL = f"""{LEADERBOARD_SQL},
arena AS (SELECT *, CASE strategy WHEN 'trend' THEN 0 WHEN 'momentum' THEN 1 WHEN 'mean_reversion' THEN 2 ELSE 3 END AS ordinal FROM scored),
board AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, ordinal) AS rank FROM arena)"""
QUALIFIES = "robustness >= 0.20e0 AND max_drawdown <= 0.80e0 AND negative_month_rate <= 0.80e0 AND monthly_observations >= 6"


def arena_rows(spark, sf):
    order = F.when(c("strategy") == "trend", 0).when(c("strategy") == "momentum", 1).when(c("strategy") == "mean_reversion", 2).otherwise(3)
    return leaderboard_rows(spark, sf).withColumns({"ordinal": order, "name": c("strategy"), "oos_samples": F.lit(500),
                                                    "oos_coverage": F.lit(0.5), "grade": F.lit("research_grade")})


@query("leaderboard_rank", f"{ARENA_SQL} SELECT symbol, strategy, rank FROM board")
def leaderboard_rank(spark, sf):
    return RA.leaderboard(arena_rows(spark, sf), ("symbol",)).select("symbol", "strategy", "rank")


@query("leaderboard_champion", f"{ARENA_SQL} SELECT symbol, arg_min(strategy, rank) FILTER (WHERE {QUALIFIES}) AS champion FROM board GROUP BY 1")
def leaderboard_champion(spark, sf):
    ranked = RA.leaderboard(arena_rows(spark, sf), ("symbol",))
    return CH.champion_of_leaderboard(ranked, ("symbol",), criteria=CRIT)


@query("champion_promotions", f"""{ARENA_SQL.replace('WITH ', 'WITH RECURSIVE ', 1)},
q AS (SELECT symbol, strategy, ordinal, score, max_drawdown AS dd, negative_month_rate AS nm, {QUALIFIES} AS good FROM arena),
walk AS (
  SELECT symbol, NULL::VARCHAR AS strategy, -1 AS ordinal, NULL::DOUBLE AS cs, NULL::DOUBLE AS cd, NULL::DOUBLE AS cn, false AS promoted FROM q WHERE ordinal = 0
  UNION ALL
  SELECT symbol, strategy, ordinal, CASE WHEN won THEN score ELSE cs END, CASE WHEN won THEN dd ELSE cd END, CASE WHEN won THEN nm ELSE cn END, won
  FROM (SELECT q.*, w.cs, w.cd, w.cn, good AND (w.cs IS NULL OR (score >= w.cs + 0.02e0 AND dd <= w.cd + 0.05e0 AND nm <= w.cn + 0.05e0)) AS won
        FROM walk w JOIN q ON q.symbol = w.symbol AND q.ordinal = w.ordinal + 1))
SELECT symbol, strategy, promoted FROM walk WHERE ordinal >= 0""")
def champion_promotions(spark, sf):
    return CH.promote_in_order(arena_rows(spark, sf), ("symbol",), criteria=CRIT).select("symbol", "strategy", "promoted")


@query("promotion_eligibility", f"""{LEADERBOARD_SQL}
SELECT symbol, strategy, score > 0 AND robustness >= 0.50e0 AND max_drawdown <= 0.30e0 AND turnover <= 100 AND negative_month_rate <= 0.50e0
  AND monthly_observations >= 6 AS eligible FROM scored""")
def promotion_eligibility(spark, sf):
    return arena_rows(spark, sf).select("symbol", "strategy", eligible_for_promotion().alias("eligible"))


STAGE_CASE = "CASE l_linenumber WHEN 1 THEN 'proposed' WHEN 2 THEN 'backtest' WHEN 3 THEN 'shadow' WHEN 4 THEN 'micro' WHEN 5 THEN 'micro' WHEN 6 THEN 'promoted' ELSE 'rejected' END"


@query("experiment_stages", f"""WITH ev AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {STAGE_CASE} AS stage, CASE WHEN l_tax < 0.01e0 THEN NULL ELSE l_extendedprice/50000 END AS score,
    0.5e0 + l_discount*3 AS robustness, CAST(l_quantity*4 AS INTEGER) AS n, l_tax*3 AS dd, l_discount*6 AS nm,
    CASE WHEN l_returnflag = 'R' THEN 1.0e0 END AS cs, 0.1e0 AS cd, 0.3e0 AS cn FROM lineitem),
f AS (SELECT *, concat_ws(',', CASE WHEN robustness < 0.60e0 THEN 'LOW_ROBUSTNESS' END, CASE WHEN dd > 0.20e0 THEN 'MAX_DRAWDOWN' END,
    CASE WHEN nm > 0.50e0 THEN 'NEGATIVE_MONTH_RATE' END, CASE WHEN cs IS NOT NULL AND dd > cd + 0.02e0 THEN 'DRAWDOWN_WORSE_THAN_CHAMPION' END,
    CASE WHEN cs IS NOT NULL AND nm > cn + 0.02e0 THEN 'MONTH_STABILITY_WORSE_THAN_CHAMPION' END) AS failures,
    CASE stage WHEN 'backtest' THEN 126 ELSE 20 END AS needed FROM ev),
g AS (SELECT *, CASE WHEN stage IN ('promoted', 'rejected') THEN 'TERMINAL_STAGE' WHEN stage = 'proposed' THEN '' WHEN score IS NULL THEN 'MISSING_EVIDENCE'
    WHEN failures <> '' THEN failures WHEN n < needed THEN 'INSUFFICIENT_SAMPLES' WHEN stage = 'micro' AND score < cs + 0.03e0 THEN 'INSUFFICIENT_SCORE_MARGIN' ELSE '' END AS why FROM f)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, why AS stage_reasons,
  CASE WHEN why = '' THEN CASE stage WHEN 'proposed' THEN 'backtest' WHEN 'backtest' THEN 'shadow' WHEN 'shadow' THEN 'micro' ELSE 'promoted' END
       WHEN why = failures AND stage NOT IN ('promoted', 'rejected') THEN 'rejected' ELSE stage END AS next_stage, why = '' AS advanced FROM g""")
def experiment_stages(spark, sf):
    names = ("proposed", "backtest", "shadow", "micro", "micro", "promoted")
    stage = F.lit("rejected")
    for i, name in reversed(list(enumerate(names, 1))):
        stage = F.when(c("l_linenumber") == i, name).otherwise(stage)
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", stage.alias("stage"),
        F.when(c("l_tax") >= 0.01, c("l_extendedprice") / 50000).alias("score"), (0.5 + c("l_discount") * 3).alias("robustness"),
        (c("l_quantity") * 4).cast("int").alias("sample_count"), (c("l_tax") * 3).alias("max_drawdown"),
        (c("l_discount") * 6).alias("negative_month_rate"), F.when(c("l_returnflag") == "R", F.lit(1.0)).alias("champion_score"),
        F.lit(0.1).alias("champion_max_drawdown"), F.lit(0.3).alias("champion_negative_month_rate"))
    out = advance_experiments(rows)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "next_stage", "advanced",
                      F.array_join("stage_reasons", ",").alias("stage_reasons"))


@query("review_findings", f"""{LEADERBOARD_SQL},
x AS (SELECT symbol, strategy, unnest([CASE WHEN cost_ratio >= 0.10e0 THEN 'execution_costs' END, CASE WHEN negative_month_rate >= 0.30e0 THEN 'monthly_stability' END,
    CASE WHEN max_drawdown >= 0.08e0 THEN 'regime_risk' END,
    CASE WHEN cost_ratio < 0.10e0 AND negative_month_rate < 0.30e0 AND max_drawdown < 0.08e0 THEN 'machine_learning' END]) AS category FROM scored)
SELECT symbol, strategy, category FROM x WHERE category IS NOT NULL""")
def findings(spark, sf):
    return review_findings(leaderboard_rows(spark, sf), ["symbol", "strategy"]).select("symbol", "strategy", "category")
