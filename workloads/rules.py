"""Row rules, gates and scores that no other query reaches, and the seven-feature ridge solved in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions import signals as S
from marketloom.operators import features as FE
from marketloom.operators import linear as LI
from marketloom.operators import quality as QU
from marketloom.operators.backtest import RiskConfig, risk_gate
from marketloom.sources import journals as SJ
from marketloom.session import interim
from marketloom.streaming import feeds as FD

from . import sql
from .decisions import QUOTES, latest_quotes
from .models import LABELLED, PURGED, labelled_panel, n_dates
from .registry import query, r, wall_clock
from .tables import bars, table

c = F.col


def counted(rows, rules, *keys):
    return rows.groupBy(*keys, F.array_join(rules, ",").alias("reasons")).agg(F.count(F.lit(1)).alias("rows"))


@query("row_rules_signals", """WITH t AS (
  SELECT 'signal' AS kind, c_acctbal/9000.0e0 AS score, (c_custkey % 9)/7.0e0 AS confidence, CASE WHEN c_custkey % 11 = 0 THEN ' ' ELSE c_mktsegment END AS symbol,
         CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 'desk' END AS source FROM customer),
u AS (SELECT kind, concat_ws(',', CASE WHEN score < 0 OR score > 1 THEN 'SCORE_RANGE' END, CASE WHEN confidence > 1 THEN 'CONFIDENCE_RANGE' END,
        CASE WHEN trim(symbol) = '' THEN 'SYMBOL_REQUIRED' END, CASE WHEN source IS NULL THEN 'SOURCE_REQUIRED' END) AS reasons FROM t
  UNION ALL SELECT 'target', concat_ws(',', CASE WHEN score < 0 OR score > 1 THEN 'WEIGHT_RANGE' END, CASE WHEN trim(symbol) = '' THEN 'SYMBOL_REQUIRED' END) FROM t)
SELECT kind, reasons, count(*) AS rows FROM u GROUP BY 1, 2""")
def row_rules_signals(spark, sf):
    key = c("c_custkey")
    rows = table(spark, sf, "customer").select(
        (c("c_acctbal") / 9000.0).alias("score"), (c("c_acctbal") / 9000.0).alias("weight"), ((key % 9) / 7.0).alias("confidence"),
        F.when(key % 11 == 0, " ").otherwise(c("c_mktsegment")).alias("symbol"), F.when(key % 13 != 0, "desk").alias("source"))
    return counted(rows, QU.signal_rules(), F.lit("signal").alias("kind")).unionByName(
        counted(rows, QU.target_rules(), F.lit("target").alias("kind")))


@query("row_rules_intents", """WITH t AS (
  SELECT CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS id, CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE c_mktsegment END AS symbol,
    c_acctbal AS risk, c_acctbal + 500 AS notional, c_acctbal - 2000 AS fee, c_acctbal AS equity, c_acctbal + 300 AS peak FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT concat_ws(',', CASE WHEN id = '' THEN 'DECISION_ID_REQUIRED' END, CASE WHEN symbol IS NULL THEN 'SYMBOL_REQUIRED' END, CASE WHEN risk < 0 THEN 'ESTIMATED_RISK' END,
  CASE WHEN notional < 0 THEN 'NOTIONAL' END, CASE WHEN fee < 0 THEN 'EXPECTED_COST' END, CASE WHEN equity <= 0 THEN 'EQUITY_NOT_POSITIVE' END,
  CASE WHEN peak <= 0 THEN 'PEAK_NOT_POSITIVE' END) AS reasons, count(*) AS rows FROM t GROUP BY 1""")
def row_rules_intents(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), c("o_custkey") == c("c_custkey"))
    key, value = c("o_orderkey"), c("c_acctbal")
    rows = rows.select(
        F.when(key % 17 == 0, "").otherwise(key.cast("string")).alias("decision_id"), F.when(key % 19 != 0, c("c_mktsegment")).alias("symbol"),
        value.alias("estimated_risk_usd"), (value + 500).alias("notional_usd"), (value - 2000).alias("expected_cost_usd"),
        value.alias("expected_gross_edge_usd"), value.alias("equity_usd"), (value + 300).alias("equity_peak_usd"))
    return counted(rows, QU.intent_rules())


@query("row_rules_events", """WITH t AS (
  SELECT CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE CAST(l_orderkey AS VARCHAR) END AS id, CASE WHEN l_partkey % 23 = 0 THEN '' ELSE CAST(l_partkey AS VARCHAR) END AS symbol,
    CASE WHEN l_linenumber = 7 THEN ' ' ELSE l_returnflag END AS strategy, l_discount*12 AS score, l_tax*13 AS confidence,
    CASE l_returnflag WHEN 'A' THEN 'OPEN' WHEN 'N' THEN 'CLOSE' ELSE l_returnflag END AS event_type, CASE WHEN l_linenumber <> 6 THEN l_shipdate END AS ts FROM lineitem)
SELECT 'decision' AS kind, concat_ws(',', CASE WHEN id IS NULL THEN 'DECISION_ID_REQUIRED' END, CASE WHEN symbol = '' THEN 'SYMBOL_REQUIRED' END,
    CASE WHEN trim(strategy) = '' THEN 'STRATEGY_REQUIRED' END, CASE WHEN score > 1 THEN 'SIGNAL_SCORE_RANGE' END, CASE WHEN confidence > 1 THEN 'CONFIDENCE_RANGE' END,
    CASE WHEN ts IS NULL THEN 'TIMESTAMP_REQUIRED' END) AS reasons, count(*) AS rows FROM t GROUP BY 2
UNION ALL SELECT 'lifecycle', concat_ws(',', CASE WHEN trim(strategy) = '' THEN 'EVENT_ID_REQUIRED' END, CASE WHEN id IS NULL THEN 'DECISION_ID_REQUIRED' END,
    CASE WHEN event_type NOT IN ('OPEN', 'CLOSE') THEN 'EVENT_TYPE' END, CASE WHEN symbol = '' THEN 'SYMBOL_REQUIRED' END,
    CASE WHEN ts IS NULL THEN 'TIMESTAMP_REQUIRED' END), count(*) FROM t GROUP BY 2""")
def row_rules_events(spark, sf):
    flag, strategy = c("l_returnflag"), F.when(c("l_linenumber") == 7, " ").otherwise(c("l_returnflag"))
    rows = table(spark, sf, "lineitem").select(
        F.when(c("l_orderkey") % 7 != 0, c("l_orderkey").cast("string")).alias("decision_id"),
        F.when(c("l_partkey") % 23 == 0, "").otherwise(c("l_partkey").cast("string")).alias("symbol"),
        strategy.alias("strategy"), strategy.alias("event_id"), (c("l_discount") * 12).alias("signal_score"), (c("l_tax") * 13).alias("confidence"),
        F.when(flag == "A", "OPEN").when(flag == "N", "CLOSE").otherwise(flag).alias("event_type"),
        F.when(c("l_linenumber") != 6, c("l_shipdate")).alias("ts"))
    return counted(rows, QU.decision_event_rules(), F.lit("decision").alias("kind")).unionByName(
        counted(rows, QU.lifecycle_event_rules(), F.lit("lifecycle").alias("kind")))


@query("risk_gate_codes", """WITH t AS (
  SELECT l_discount*12 AS weight, 100.0e0 AS equity, 100.0e0 + l_linenumber*2 AS peak, -l_tax/2 AS pnl, l_quantity*7 AS age, l_quantity/48.0e0 AS vol, l_suppkey % 10 = 0 AS kill FROM lineitem),
g AS (SELECT *, concat_ws(',', CASE WHEN kill THEN 'KILL_SWITCH' END, CASE WHEN age > 300 THEN 'STALE_DATA' END, CASE WHEN pnl <= -0.035e0 THEN 'DAILY_LOSS_LIMIT' END,
    CASE WHEN greatest(0.0e0, 1.0e0 - equity/peak) >= 0.10e0 THEN 'MAX_DRAWDOWN' END, CASE WHEN vol >= 1 THEN 'ABNORMAL_VOLATILITY' END) AS hard FROM t)
SELECT CASE WHEN hard = '' AND weight > 0.5e0 THEN 'POSITION_CAPPED' ELSE hard END AS reasons, hard = '' AS approved, count(*) AS rows,
  round(sum(CASE WHEN hard = '' THEN least(weight, 0.5e0) ELSE 0 END), 4) + 0.0 AS approved_weight FROM g GROUP BY 1, 2""")
def risk_gate_codes(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        (c("l_discount") * 12).alias("weight"), F.lit(100.0).alias("equity"), (100.0 + c("l_linenumber") * 2).alias("equity_peak"),
        (-c("l_tax") / 2).alias("daily_pnl_pct"), (c("l_quantity") * 7).alias("data_age_seconds"),
        (c("l_quantity") / 48.0).alias("realized_volatility"), (c("l_suppkey") % 10 == 0).alias("kill_switch"))
    out = risk_gate(rows, RiskConfig(max_position_weight=0.5, max_daily_loss=0.035))
    return out.groupBy(F.array_join("risk_reasons", ",").alias("reasons"), "approved").agg(
        F.count(F.lit(1)).alias("rows"), r(F.sum("approved_weight"), 4).alias("approved_weight"))


@query("prediction_scores", f"""WITH {sql.BARS}, {sql.FEATURES}
SELECT symbol, ts, CASE WHEN momentum_20 IS NULL THEN 0.0e0 ELSE round(1/(1 + exp(-momentum_20/0.015e0)), 8) + 0.0 END AS score FROM features""")
def prediction_scores(spark, sf):
    rows = FE.technical_features(bars(spark, sf))
    return rows.select("symbol", wall_clock(), r(S.prediction_score("momentum_20")).alias("score"))


@query("fresh_quotes", f"""WITH {QUOTES},
j AS (SELECT symbol, epoch_us(TIMESTAMP '1998-12-01') - epoch_us(ts) AS age FROM latest)
SELECT CASE WHEN age > 30*86400e6 THEN 'STALE_QUOTE' ELSE '' END AS reasons, age <= 30*86400e6 AS ok, count(*) AS rows FROM j GROUP BY 1, 2""")
def fresh_quotes(spark, sf):
    limits = QU.LiveLimits(max_quote_age_seconds=30 * 86_400.0, max_spread_fraction=0.5)
    out = FD.fresh_quotes(latest_quotes(spark, sf), F.lit("1998-12-01").cast("timestamp"), limits)
    return out.groupBy(F.array_join("reasons", ",").alias("reasons"), "ok").agg(F.count(F.lit(1)).alias("rows"))


@query("lifecycle_journal", """WITH t AS (SELECT l_returnflag AS account, CASE WHEN l_linestatus = 'O' THEN 'OPEN' ELSE 'CLOSE' END AS event_type,
    CAST(round(l_extendedprice*100) AS BIGINT) AS cents, l_linestatus = 'F' AS priced, l_shipdate FROM lineitem)
SELECT account, event_type, count(*) AS events, sum(CASE WHEN priced THEN cents ELSE 0 END)::BIGINT AS pnl_cents, min(l_shipdate) AS first_ts FROM t GROUP BY 1, 2""")
def lifecycle_journal(spark, sf):
    """Journal lines written as JSON and read back."""
    status = F.when(c("l_linestatus") == "O", "OPEN").otherwise("CLOSE")
    event = F.struct(
        F.concat_ws(":", "l_orderkey", "l_linenumber").alias("event_id"), c("l_orderkey").cast("string").alias("decision_id"), status.alias("event_type"),
        F.date_format(c("l_shipdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("timestamp"), c("l_partkey").cast("string").alias("symbol"),
        c("l_quantity").cast("double").alias("price"), F.when(c("l_linestatus") == "F", c("l_extendedprice").cast("double")).alias("pnl_usd"))
    lines = table(spark, sf, "lineitem").select(
        c("l_returnflag").alias("account"),
        F.to_json(F.struct(c("l_linenumber").alias("sequence"), F.lit("0").alias("previous_hash"), F.lit("1").alias("entry_hash"), event.alias("event"))).alias("value"))
    out = SJ.lifecycle_events(lines)
    return out.groupBy("account", "event_type").agg(
        F.count(F.lit(1)).alias("events"), F.sum(F.round(c("pnl_usd") * 100).cast("bigint")).alias("pnl_cents"), F.min("ts").cast("timestamp_ntz").alias("first_ts"))


def _ridge_sql() -> str:
    """Gauss elimination of every fold's scaled normal equations in a recursive query."""
    x, p = FE.PANEL_COLUMNS, len(FE.PANEL_COLUMNS)
    known = " AND ".join(f"{f} IS NOT NULL" for f in x)
    cells = [f"avg({f}) AS m{i}, stddev_pop({f}) AS s{i}, covar_pop({f}, y) AS cy{i}" for i, f in enumerate(x)]
    cells += [f"covar_pop({x[i]}, {x[j]}) AS c{i}_{j}" for i in range(p) for j in range(i, p)]
    rows = ", ".join(
        "[" + ", ".join(f"n*c{min(i, j)}_{max(i, j)}/s{i}/s{j}" + (" + 1.0e0" if i == j else "") for j in range(p)) + f", n*cy{i}/s{i}]" for i in range(p))
    value = " + ".join(f"M[{i + 1}][{p + 1}]/s{i}*({f} - m{i})" for i, f in enumerate(x))
    return f"""WITH RECURSIVE {LABELLED},
ok AS (SELECT * FROM lab WHERE y IS NOT NULL AND {known}),
stats AS (SELECT k, count(*) AS n, avg(y) AS my, {", ".join(cells)} FROM ok JOIN folds ON date_idx >= train_from AND date_idx < train_to GROUP BY 1 HAVING count(*) >= 10),
g AS (SELECT k, 0 AS step, [{rows}] AS M FROM stats
  UNION ALL SELECT k, step + 1, list_transform(M, lambda row, i: CASE WHEN i = step + 1 THEN list_transform(row, lambda v: v/row[step + 1])
    ELSE list_transform(row, lambda v, j: v - row[step + 1]*M[step + 1][j]/M[step + 1][step + 1]) END) FROM g WHERE step < {p}),
t AS (SELECT lab.symbol, lab.ts, k AS fold, my + {value} AS prediction
  FROM lab JOIN folds ON date_idx >= test_from AND date_idx < test_to JOIN stats USING (k) JOIN (SELECT k, M FROM g WHERE step = {p}) USING (k) WHERE {known})
SELECT lab.symbol, lab.ts, t.fold, round(t.prediction, 8) + 0.0 AS prediction FROM lab LEFT JOIN t ON t.symbol = lab.symbol AND t.ts = lab.ts"""


@query("ridge_oos_predictions", _ridge_sql())
def ridge_oos_predictions(spark, sf):
    df = interim(labelled_panel(spark, sf))
    return LI.purged_oos(df, FE.PANEL_COLUMNS, "fwd_return_5", PURGED, n_dates(df)).select(
        "symbol", wall_clock(), "fold", r("prediction"))
