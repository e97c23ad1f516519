"""Snapshots, vendor tables, research and training runs, live planning, cycles, streams."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from marketloom.functions import signals as S
from marketloom.operators.fingerprint import DatasetMetadata
from marketloom.operators.gates import SafeguardConfig
from marketloom.operators.ranking import Tie
from marketloom.plans.cycle import paper_cycle, refresh_books, shadow_cycle
from marketloom.plans.learning import daily_report
from marketloom.plans.live import analyse, plan_trades
from marketloom.plans.research import run_research
from marketloom.plans.sequence import run_cycles
from marketloom.plans.training import run_training
from marketloom.operators.quality import LiveLimits
from marketloom.operators.trees import ModelConfig
from marketloom.sources import bars as SB
from marketloom.sources import journals as SJ
from marketloom.sources import provider as PV
from marketloom.sources import snapshots as SN
from marketloom.sources import vendor as SV
from marketloom.streaming import feeds as FD
from marketloom.streaming.late import bars_and_late_ticks
from marketloom.streaming.exits import exit_stream, settle_late
from marketloom.session import shared_dir
from marketloom.streaming.sinks import drain, journal_stream

from . import sql
from .decisions import ADMISSION, EXITS, INTENTS, PLANS, POSITIONS, QUOTES, journal_lines, latest_quotes, plans, positions, quotes, specs
from .models import ANALOGUE, EDGE
from .registry import query, r, rs, sql_round, wall_clock
from .research import BT_DAILY, STRATEGIES, backtest_rows
from .tables import bars, benchmark_bars, daily_bars, table

c = F.col


@query("bars_selected", f"WITH {sql.BARS} SELECT symbol, ts, {sql_round(('close',))} FROM bars WHERE symbol IN ('view', 'click') AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'")
def bars_selected(spark, sf):
    out = SB.select_bars(bars(spark, sf), ["view", "click"], "2024-01-05 00:00:00", "2024-01-20 00:00:00")
    return out.select("symbol", wall_clock(), r("close"))


@query("provider_bars", f"WITH {sql.BARS} SELECT symbol, ts, {sql_round(('close', 'volume'))} FROM bars WHERE symbol = 'purchase' AND ts >= TIMESTAMP '2024-01-10'")
def provider_bars(spark, sf):
    """Stored bars through a provider, whose row groups are chosen by the filters."""
    path = f"{shared_dir(spark).rstrip('/')}/bars-{uuid.uuid4().hex}"
    bars(spark, sf).sortWithinPartitions("symbol", "ts").write.parquet(path)
    out = PV.provider_bars(spark, path).where("symbol = 'purchase' AND ts >= TIMESTAMP '2024-01-10'")
    return out.select("symbol", wall_clock(), r("close"), r("volume"))


VIEW_DAYS = """SELECT CAST(ts AS DATE) FROM events GROUP BY 1
  HAVING count(*) FILTER (event_type = 'view') > count(*) FILTER (event_type = 'click')"""


@query("bars_on_view_days", f"WITH {sql.BARS} SELECT symbol, ts, {sql_round(('close', 'volume'))} FROM bars WHERE CAST(ts AS DATE) IN ({VIEW_DAYS})")
def bars_on_view_days(spark, sf):
    """A date-partitioned bar table, read only on the days that saw more views than clicks."""
    path = f"{shared_dir(spark).rstrip('/')}/bars-{uuid.uuid4().hex}"
    SB.write_bars(bars(spark, sf), path)
    days = table(spark, sf, "events").groupBy(F.to_date(c("ts").cast("timestamp")).alias("dt")).agg(
        F.count_if(c("event_type") == "view").alias("views"), F.count_if(c("event_type") == "click").alias("clicks"))
    out = SB.bars_on_dates(SB.read_bars(spark, path), days.where("views > clicks"))
    return out.select("symbol", wall_clock(), r("close"), r("volume"))


def snapshot_texts(spark, sf):
    """A JSON document per order: the customer's account and one symbol per line, with two bars each. Documents of
    pending orders lack the account, those of urgent orders end too early."""
    # What makes an entry is collected per order as plain numbers; documents are put together after the shuffle.
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", F.struct(
            "l_partkey", "l_suppkey", "l_linenumber", (c("l_extendedprice") / c("l_quantity")).alias("price"), c("l_quantity").alias("quantity"),
            F.unix_seconds(c("l_shipdate").cast("timestamp")).alias("at"), F.coalesce(c("l_tax") > 0.01, F.lit(False)).alias("known"),
            F.when(c("l_tax") > 0.01, c("l_discount") > 0.02).alias("enabled")).alias("line"))

    def bar(ts, close, quantity):
        return F.struct(ts.alias("timestamp"), close.alias("open"), (close * 1.01).alias("high"), (close * 0.99).alias("low"),
                        close.alias("close"), quantity.alias("volume"))

    def entry(x):
        stamp, price = F.date_format(F.timestamp_seconds(x["at"]), "yyyy-MM-dd'T'HH:mm:ss'Z'"), x["price"]
        return F.struct(
            F.concat_ws(":", x["l_partkey"], x["l_suppkey"], x["l_linenumber"]).alias("key"),
            F.struct(
                F.struct(price.alias("bid"), (price * 1.001).alias("ask"), stamp.alias("timestamp")).alias("quote"),
                F.when(x["known"], F.struct(
                    F.lit(0.01).alias("tick_size"), F.lit(0.01).alias("volume_min"), x["quantity"].alias("volume_max"),
                    F.lit(0.01).alias("volume_step"), x["enabled"].alias("trade_enabled"))).alias("spec"),
                F.array(bar(F.lit("1990-01-01T00:00:00+00:00"), price * 0.5, x["quantity"]), bar(stamp, price, x["quantity"])).alias("bars"),
            ).alias("value"))

    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), c("o_custkey") == c("c_custkey"))
    own = ("l_orderkey", "o_orderstatus", "o_orderpriority", "c_acctbal")
    symbols = lines.join(orders, c("l_orderkey") == c("o_orderkey")).groupBy(*own).agg(F.collect_set("line").alias("_l"))
    account = F.when(c("o_orderstatus") != "P", F.struct(
        c("c_acctbal").alias("balance"), c("c_acctbal").alias("equity"), c("c_acctbal").alias("free_margin"),
        F.lit("2024-01-01T00:00:00Z").alias("timestamp")))
    doc = F.to_json(F.struct(account.alias("account"), F.map_from_entries(F.transform("_l", entry)).alias("symbols")))
    cut = F.when(c("o_orderpriority") == "1-URGENT", F.substring(doc, 1, 40)).otherwise(doc)
    return symbols.select(c("l_orderkey").alias("snapshot_id"), cut.alias("value"))


GOOD = "o_orderpriority <> '1-URGENT'"
SYMBOLS = f"""syms AS (SELECT DISTINCT l_orderkey AS snapshot_id, concat_ws(':', l_partkey, l_suppkey, l_linenumber) AS symbol, l_extendedprice/l_quantity AS bid,
  l_quantity, l_tax, l_discount, l_shipdate AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {GOOD})"""


@query("snapshot_accounts", f"""SELECT o_orderkey AS snapshot_id, c_acctbal AS balance, c_acctbal AS equity, c_acctbal AS free_margin, TIMESTAMP '2024-01-01' AS ts, 'USD' AS currency
FROM orders JOIN customer ON o_custkey = c_custkey WHERE {GOOD} AND o_orderstatus <> 'P' AND o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def snapshot_accounts(spark, sf):
    out = SN.snapshot_accounts(SN.parse_snapshots(snapshot_texts(spark, sf)))
    return out.withColumn("ts", c("ts").cast("timestamp_ntz"))


@query("snapshot_errors", f"""WITH {SYMBOLS}, docs AS (SELECT * FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))
SELECT o_orderkey AS snapshot_id, NULL AS symbol, CASE WHEN NOT ({GOOD}) THEN 'SNAPSHOT_FILE_INVALID' ELSE 'SNAPSHOT_ACCOUNT_MISSING' END AS error FROM docs
  WHERE NOT ({GOOD}) OR o_orderstatus = 'P'
UNION ALL SELECT snapshot_id, symbol, 'SNAPSHOT_SPEC_MISSING' FROM syms WHERE NOT l_tax > 0.01e0""")
def snapshot_errors(spark, sf):
    return SN.snapshot_errors(SN.parse_snapshots(snapshot_texts(spark, sf)))


@query("snapshot_quotes", f"WITH {SYMBOLS} SELECT snapshot_id, symbol, bid, bid*1.001e0 AS ask, ts, 'mt5_snapshot' AS source FROM syms")
def snapshot_quotes(spark, sf):
    out = SN.snapshot_quotes(SN.parse_snapshots(snapshot_texts(spark, sf)))
    return out.withColumn("ts", c("ts").cast("timestamp_ntz"))


@query("snapshot_specs", f"""WITH {SYMBOLS} SELECT snapshot_id, symbol, 0.01e0 AS tick_size, 0.0e0 AS tick_value, 0.01e0 AS volume_min, l_quantity AS volume_max,
  0.01e0 AS volume_step, l_discount > 0.02e0 AS trade_enabled FROM syms WHERE l_tax > 0.01e0""")
def snapshot_specs(spark, sf):
    return SN.snapshot_specs(SN.parse_snapshots(snapshot_texts(spark, sf)))


@query("snapshot_last_bar", f"WITH {SYMBOLS} SELECT snapshot_id, symbol, ts, bid AS open, bid*1.01e0 AS high, bid*0.99e0 AS low, bid AS close, l_quantity AS volume FROM syms")
def snapshot_last_bar(spark, sf):
    out = SN.snapshot_bars(SN.parse_snapshots(snapshot_texts(spark, sf)), count=1)
    return out.withColumn("ts", c("ts").cast("timestamp_ntz"))


@query("vendor_tables", """SELECT CAST(l_partkey AS VARCHAR) AS symbol, l_extendedprice AS bid, l_extendedprice + 1 AS ask, l_suppkey, l_orderkey, l_linenumber,
  CASE WHEN l_returnflag = 'A' THEN l_shipdate + INTERVAL 250 MILLISECOND WHEN l_returnflag = 'N' THEN l_shipdate END AS ts, 'mt5' AS source,
  CASE WHEN l_returnflag = 'R' THEN 'TICK_TIME_MISSING' END AS error, l_tax AS tick_size, l_linenumber > 1 AS trade_enabled FROM lineitem""")
def vendor_tables(spark, sf):
    """Raw ticks with millisecond, second or no time, and raw symbol rows, normalised."""
    ids = ("l_suppkey", "l_orderkey", "l_linenumber")
    secs = F.unix_seconds(c("l_shipdate").cast("timestamp"))
    raw = table(spark, sf, "lineitem").select(
        c("l_partkey").cast("string").alias("symbol"), c("l_extendedprice").alias("bid"), (c("l_extendedprice") + 1).alias("ask"),
        F.when(c("l_returnflag") == "A", secs * 1000 + 250).otherwise(F.lit(0)).alias("time_msc"),
        F.when(c("l_returnflag") == "N", secs).alias("time"),
        F.when(c("l_tax") > 1, c("l_tax")).alias("trade_tick_size"), c("l_tax").alias("point"),
        (c("l_linenumber") - 1).alias("trade_mode"), F.struct(*ids).alias("id"))
    # Both readers are projections of one raw table, so their rows line up by line id.
    q = SV.vendor_quotes(raw.withColumn("symbol", F.struct("symbol", "id")))
    s = SV.vendor_specs(raw.withColumn("symbol", F.struct("symbol", "id")))
    both = q.join(s.select("symbol", "tick_size", "trade_enabled").distinct(), "symbol")
    return both.select(c("symbol.symbol").alias("symbol"), "bid", "ask", *[c(f"symbol.id.{x}").alias(x) for x in ids],
                       c("ts").cast("timestamp_ntz").alias("ts"), "source", "error", "tick_size", "trade_enabled")


@query("journal_events", """SELECT l_orderkey AS journal_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS sequence,
  concat_ws(':', l_linenumber, l_partkey, l_suppkey) AS decision_id FROM lineitem QUALIFY l_quantity <> 1""")
def journal_events(spark, sf):
    return SJ.decision_events(journal_lines(spark, sf)).select("journal_id", "sequence", "decision_id")


# --- runs ------------------------------------------------------------------------------------------

BOARD = ("score", "robustness", "cagr", "max_drawdown", "excess_return", "turnover")


@query("research_leaderboard")
def research_leaderboard(spark, sf):
    b = daily_bars(spark, sf)
    run = run_research(b, benchmark_bars(b))
    return run.leaderboard.select("symbol", "strategy", "rank", *rs(BOARD, 6))


RULE_BOARD = ("score", "robustness", "cagr", "max_drawdown", "excess_return", "beta", "turnover", "negative_month_rate")
GATED_DAILY = f"""WITH RECURSIVE {sql.DAILY}, {sql.FEATURES}, {sql.SIGNALS}, {sql.LONG},
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
        FROM walk JOIN e ON e.symbol = walk.symbol AND e.strategy = walk.strategy AND e.k = walk.k + 1)))),
bp AS (SELECT ts, round(avg(close), 6) AS close FROM bars GROUP BY ts),
bench AS (SELECT ts, coalesce(close/lag(close) OVER (ORDER BY ts) - 1, 0) AS bench_return FROM bp),
gated AS (SELECT walk.*, bench_return FROM walk LEFT JOIN bench USING (ts) WHERE k > 0),
{sql.metrics("gated", "symbol, strategy", bench="bench_return")},
costs AS (SELECT symbol, strategy, sum(turnover) AS turnover FROM gated GROUP BY 1, 2),
rob AS (SELECT *, greatest(0.0e0, least(1.0e0, (1 - max_drawdown)*(1 - negative_month_rate))) AS robustness
  FROM metrics JOIN stability USING (symbol, strategy) JOIN costs USING (symbol, strategy)),
scored AS (SELECT *, {sql.SCORE} AS score FROM rob)"""


@query("research_rule_strategies", f"{GATED_DAILY} SELECT symbol, strategy, {sql_round(RULE_BOARD, 6)} FROM scored")
def research_rule_strategies(spark, sf):
    """The rule strategies of a whole research run; the learned one has no SQL twin."""
    b = daily_bars(spark, sf)
    board = run_research(b, benchmark_bars(b)).leaderboard
    return board.where(c("strategy").isin(*STRATEGIES)).select("symbol", "strategy", *rs(RULE_BOARD, 6))


@query("research_summary")
def research_summary(spark, sf):
    run = run_research(bars(spark, sf))
    out = run.summary.select("symbol", "latest_regime", "latest_signal", "champion", "ml_oos_samples", "cagr", "max_drawdown")
    return SJ.run_summary(out).withColumn("latest_signal", r("latest_signal"))


@query("training_leaderboard")
def training_leaderboard(spark, sf):
    meta = DatasetMetadata("hourly-events", "events", "research_grade")
    run = run_training(bars(spark, sf), meta, (ModelConfig("ridge"), ModelConfig("elastic_net")))
    return run.leaderboard.select("model", "rank", "eligible", "fold_count", *rs(("score", "robustness", "oos_coverage", "turnover"), 6))


@query("training_artifacts")
def training_artifacts(spark, sf):
    meta = DatasetMetadata("hourly-events", "events", "demo")
    out = run_training(bars(spark, sf), meta, (ModelConfig("ridge", {"alpha": 2.0}),)).artifacts
    return out.withColumns({"metrics": F.to_json("metrics"), "model_params": F.to_json("model_params")})


RECENT = f"""{sql.DAILY.replace("bars AS (", "all_bars AS (")},
bars AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM all_bars) WHERE back <= 250)"""
LIVE = ANALOGUE.replace(sql.BARS, RECENT)


@query("live_analysis", f"WITH {LIVE} SELECT symbol, regime, sample_count, eligible, {sql_round(EDGE)} FROM edges")
def live_analysis(spark, sf):
    return analyse(daily_bars(spark, sf)).select("symbol", "regime", "sample_count", "eligible", *rs(EDGE))


@query("live_plans", f"""WITH {LIVE} SELECT concat_ws(':', 'live-v1', symbol, CAST(epoch(last_ts) AS BIGINT)) AS decision_id, symbol, regime AS market_regime,
  {sql_round(EDGE)}, 0.003e0 AS risk_fraction, 0.25e0 AS notional_fraction FROM edges WHERE eligible""")
def live_plans(spark, sf):
    return plan_trades(analyse(daily_bars(spark, sf))).select(
        "decision_id", "symbol", "market_regime", *rs(EDGE), "risk_fraction", "notional_fraction")


@query("daily_learning_report", f"""{BT_DAILY}, {sql.metrics("backtest", "symbol, strategy")},
facts AS (SELECT c_mktsegment AS symbol, l_discount - l_tax AS real, l_discount - 0.03e0 AS alt FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
reg AS (SELECT symbol, count(*) AS n, coalesce(sum(greatest(0.0e0, alt)) FILTER (WHERE real = 0), 0) AS gain, coalesce(sum(-real) FILTER (WHERE real < 0 AND alt >= 0), 0) AS loss FROM facts GROUP BY 1),
x AS (SELECT s.symbol, negative_month_rate >= 0.30e0 AS m, n >= 3 AND (gain > 0 OR loss > 0) AS d FROM stability s JOIN reg USING (symbol) WHERE strategy = 'trend'),
y AS (SELECT symbol, unnest([CASE WHEN m THEN 'monthly_stability' END, CASE WHEN d THEN 'decision_regret' END, CASE WHEN NOT m AND NOT d THEN 'machine_learning' END]) AS category FROM x)
SELECT symbol, category FROM y WHERE category IS NOT NULL""")
def daily_learning_report(spark, sf):
    rows = backtest_rows(spark, sf, daily=True)
    facts = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), c("l_orderkey") == c("o_orderkey")).join(
        table(spark, sf, "customer"), c("o_custkey") == c("c_custkey")).select(
        c("c_mktsegment").alias("symbol"), (c("l_discount") - c("l_tax")).alias("realized_net_return"),
        (c("l_discount") - 0.03).alias("alternative_policy_return"), F.lit(True).alias("alternative_available_at_decision"),
        (c("l_tax") / 10).alias("execution_cost_return"))
    return daily_report(rows.where("strategy = 'trend'"), facts, ("symbol",)).findings.select("symbol", "category")


def cycles(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.select(
        c("o_orderkey").alias("account_id"), F.lit("c1").alias("cycle_id"), F.lit("2001-06-01").cast("timestamp").alias("ts"),
        F.lit("neutral_chop").alias("regime"), F.lit(None).cast("double").alias("equity_peak_usd"), F.lit(0.0).alias("daily_pnl_usd"),
        F.lit(0).alias("orders_last_minute"), (c("o_orderpriority") == "5-LOW").alias("kill_switch"))


LONG_LIMITS = LiveLimits(max_quote_age_seconds=400 * 86_400.0, max_account_age_seconds=120.0)
CYCLE_SQL = f"""WITH {PLANS}, {QUOTES},
pl AS (SELECT *, row_number() OVER (PARTITION BY account_id, decision_id ORDER BY ordinal) AS copy FROM plans),
g AS (SELECT p.*, o_totalprice AS equity, o_orderpriority = '5-LOW' AS kill, q.bid, q.ask, (q.ask - q.bid)/((q.ask + q.bid)/2) AS sf,
    epoch_us(TIMESTAMP '2001-06-01') - epoch_us(q.ts) > 34560000e6 AS stale, q.ts AS quote_ts, p_size, copy > 1 AS dup
  FROM pl p JOIN orders ON o_orderkey = account_id LEFT JOIN latest q USING (symbol) LEFT JOIN part ON CAST(p_partkey AS VARCHAR) = p.symbol),
h AS (SELECT *, greatest(expected_cost, sf) AS cost, confidence*(expected_return - greatest(expected_cost, sf) - downside_risk - uncertainty) AS edge2 FROM g),
k AS (SELECT *, CASE WHEN dup THEN 'DUPLICATE_DECISION_ID' WHEN bid IS NULL OR p_size IS NULL THEN 'MARKET_DATA_UNAVAILABLE'
    WHEN stale OR p_size <= 2 THEN concat_ws(',', CASE WHEN stale THEN 'STALE_QUOTE' END, CASE WHEN p_size <= 2 THEN 'SYMBOL_DISABLED' END)
    WHEN NOT edge2 > 0 THEN 'BELOW_MINIMUM_NET_EDGE' END AS gate FROM h)
"""


@query("shadow_cycle_gates", f"{CYCLE_SQL} SELECT account_id, ordinal, gate AS reasons FROM k WHERE gate IS NOT NULL")
def shadow_cycle_gates(spark, sf):
    out = shadow_decisions(spark, sf)
    return out.where("rank IS NULL").select("account_id", "ordinal", F.array_join("reasons", ",").alias("reasons"))


@query("shadow_cycle_counts", f"""{CYCLE_SQL.replace("WITH ", "WITH RECURSIVE ", 1)},
sized AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY edge2 DESC, confidence DESC, expected_return DESC, ordinal ASC) AS rank,
    equity*risk_fraction AS risk, equity*notional_fraction AS notional, expected_return*(equity*notional_fraction) AS gain, cost*(equity*notional_fraction) AS fee,
    greatest(0.0e0, (epoch_us(TIMESTAMP '2001-06-01') - epoch_us(quote_ts))/1e6) AS age FROM k WHERE gate IS NULL),
walk AS (
  SELECT account_id, 0::BIGINT AS rank, 0.0e0 AS open_risk, 0.0e0 AS gross, '' AS reasons FROM sized WHERE rank = 1
  UNION ALL
  SELECT x.account_id, x.rank, CASE WHEN x.reasons = '' THEN x.open_risk + x.risk ELSE x.open_risk END,
    CASE WHEN x.reasons = '' THEN x.gross + x.notional ELSE x.gross END, x.reasons
  FROM (SELECT s.*, w.open_risk, w.gross, concat_ws(',', CASE WHEN s.kill THEN 'KILL_SWITCH' END, CASE WHEN s.age > 30 THEN 'STALE_DATA' END,
        CASE WHEN s.risk/s.equity > 0.005e0 THEN 'ORDER_RISK_LIMIT' END, CASE WHEN (w.open_risk + s.risk)/s.equity > 0.02e0 THEN 'TOTAL_OPEN_RISK_LIMIT' END,
        CASE WHEN (w.gross + s.notional)/s.equity > 2.0e0 THEN 'GROSS_EXPOSURE_LIMIT' END, CASE WHEN s.gain - s.fee <= 0 THEN 'NO_POSITIVE_NET_EDGE' END,
        CASE WHEN s.gain > 0 AND s.fee >= s.gain THEN 'COST_CONSUMES_EDGE' END) AS reasons
    FROM walk w JOIN sized s ON s.account_id = w.account_id AND s.rank = w.rank + 1) x)
SELECT reasons, reasons = '' AS approved, count(*) AS plans FROM (SELECT reasons FROM walk WHERE rank > 0 UNION ALL SELECT gate FROM k WHERE gate IS NOT NULL) GROUP BY 1, 2""")
def shadow_cycle_counts(spark, sf):
    out = shadow_decisions(spark, sf)
    return out.groupBy(F.array_join("reasons", ",").alias("reasons"), "approved").agg(F.count(F.lit(1)).alias("plans"))


def shadow_decisions(spark, sf):
    cyc = cycles(spark, sf)
    equity = table(spark, sf, "orders").select(
        c("o_orderkey").alias("account_id"), c("o_totalprice").alias("balance"), c("o_totalprice").alias("equity"),
        c("o_totalprice").alias("free_margin"), F.lit("2001-06-01").cast("timestamp").alias("ts"), F.lit("USD").alias("currency"))
    none = positions(spark, sf).where(F.lit(False)).withColumn("account_id", F.lit(None).cast("bigint"))
    states = equity.select("account_id", c("equity").alias("base_equity_usd"), F.lit(0.0).alias("realized_pnl_usd"),
                           c("equity").alias("equity_peak_usd"), F.lit(0.0).alias("realized_today_usd"))
    q = latest_quotes(spark, sf)
    books, _ = refresh_books(cyc, equity, none.drop("ask", "valid"), q, states, LONG_LIMITS)
    p = plans(spark, sf).drop("ts", "status").withColumns({"cycle_id": F.lit("c1"), "market_regime": F.lit(None).cast("string")})
    return shadow_cycle(p, books, q, specs(spark, sf), limits=LONG_LIMITS)


@query("shadow_cycle_positions", f"""WITH {QUOTES}, {POSITIONS},
m AS (SELECT CAST(split_part(decision_id, ':', 1) AS BIGINT) AS account_id, p.*  EXCLUDE (account_id), q.bid,
    epoch_us(TIMESTAMP '2001-06-01') - epoch_us(q.ts) > 34560000e6 AS stale FROM positions p LEFT JOIN latest q USING (symbol)),
n AS (SELECT *, NOT stale AND (bid <= stop_loss OR bid >= take_profit) AS closed, CASE WHEN NOT stale THEN quantity*(bid - entry_price) END AS mark FROM m),
s AS (SELECT account_id, count(*) FILTER (WHERE stale) AS mark_issue_count, count(*) FILTER (WHERE closed) AS exits,
    coalesce(sum(risk) FILTER (WHERE NOT closed), 0) AS open_risk_usd, coalesce(sum(mark), 0) AS pnl, coalesce(sum(mark) FILTER (WHERE closed), 0) AS realized FROM n GROUP BY 1)
SELECT o_orderkey AS account_id, coalesce(mark_issue_count, 0) AS mark_issue_count, coalesce(exits, 0) AS exits, round(coalesce(open_risk_usd, 0), 4) + 0.0 AS open_risk_usd,
  round(coalesce(realized, 0), 4) + 0.0 AS realized_total_usd, round(o_totalprice + coalesce(pnl, 0), 4) + 0.0 AS shadow_equity_usd,
  CASE WHEN coalesce(mark_issue_count, 0) > 0 THEN 'PORTFOLIO_MARK_UNAVAILABLE' WHEN o_totalprice + coalesce(pnl, 0) <= 0 THEN 'SHADOW_EQUITY_NONPOSITIVE' ELSE '' END AS reasons
FROM orders LEFT JOIN s ON account_id = o_orderkey""")
def shadow_cycle_positions(spark, sf):
    """Books of cycles whose accounts hold a position per order line."""
    held = positions(spark, sf).withColumn("account_id", F.split_part("decision_id", F.lit(":"), F.lit(1)).cast("bigint"))
    equity = table(spark, sf, "orders").select(
        c("o_orderkey").alias("account_id"), c("o_totalprice").alias("balance"), c("o_totalprice").alias("equity"),
        c("o_totalprice").alias("free_margin"), F.lit("2001-06-01").cast("timestamp").alias("ts"), F.lit("USD").alias("currency"))
    states = equity.select("account_id", c("equity").alias("base_equity_usd"), F.lit(0.0).alias("realized_pnl_usd"),
                           c("equity").alias("equity_peak_usd"), F.lit(0.0).alias("realized_today_usd"))
    books, _ = refresh_books(cycles(spark, sf), equity, held.drop("ask", "valid"), latest_quotes(spark, sf), states, LONG_LIMITS)
    return books.select(
        "account_id", "mark_issue_count", "exits",
        *rs(("open_risk_usd", "realized_total_usd", "shadow_equity_usd"), 4), F.array_join("cycle_reasons", ",").alias("reasons"))


PAPER_SQL = ADMISSION.replace("o_totalprice AS equity,", "o_totalprice AS equity, o_orderpriority = '5-LOW' AS live,", 1).replace(
    "concat_ws(',', CASE WHEN w.n_orders", "concat_ws(',', CASE WHEN s.live THEN 'LIVE_EXECUTION_DISABLED' END, CASE WHEN w.n_orders")


@query("paper_cycle", PAPER_SQL + """SELECT account_id, ordinal, rank, reasons = '' AS accepted, reasons FROM walk WHERE rank > 0""")
def paper_cycle_decisions(spark, sf):
    """Paper decisions of every order's lines; orders of low priority ask for live execution, which is off."""
    own = plans(spark, sf).drop("ts", "status").withColumns({
        "cycle_id": F.lit("c1"), "source": c("ordinal").cast("string"), "market_regime": F.lit(None).cast("string")})
    money = c("o_totalprice")
    states = table(spark, sf, "orders").select(
        c("o_orderkey").alias("account_id"), F.lit("c1").alias("cycle_id"),
        F.when(c("o_orderpriority") == "5-LOW", "live").otherwise("paper").alias("mode"), money.alias("equity_usd"), money.alias("equity_peak_usd"),
        F.lit(0.0).alias("daily_pnl_usd"), (money * 0.005).alias("open_risk_usd"), F.lit(0.0).alias("gross_notional_usd"),
        F.lit(0.0).alias("data_age_seconds"), F.lit(7).alias("orders_last_minute"), F.lit(False).alias("kill_switch"))
    out = paper_cycle(own, states)
    return out.select("account_id", "ordinal", "rank", "accepted", F.array_join("reasons", ",").alias("reasons"))


def desk(spark, sf):
    """Every customer trades at each of its orders: the order is a cycle, its lines are the plans, lines quote parts."""
    orders = table(spark, sf, "orders")
    base = orders.join(table(spark, sf, "customer"), c("o_custkey") == c("c_custkey"))
    money = (c("c_acctbal") + 20_000.0)
    accounts = base.select(c("o_custkey").alias("account_id"), money.alias("balance"), money.alias("equity"), money.alias("free_margin"),
                           c("o_orderdate").cast("timestamp").alias("ts"), F.lit("USD").alias("currency"))
    cyc = orders.select(
        c("o_custkey").alias("account_id"), c("o_orderkey").cast("string").alias("cycle_id"), c("o_orderdate").cast("timestamp").alias("ts"),
        F.lit("neutral_chop").alias("regime"), F.lit(None).cast("double").alias("equity_peak_usd"), F.lit(0.0).alias("daily_pnl_usd"),
        F.lit(0).alias("orders_last_minute"), (c("o_orderpriority") == "5-LOW").alias("kill_switch"))
    # Lines are joined as they are, so that what plans are made of is shuffled, not what is made of it.
    lines = table(spark, sf, "lineitem").join(orders.select("o_orderkey", "o_custkey"), c("l_orderkey") == c("o_orderkey"))
    own = plans(spark, sf, lines, carry=("o_custkey",)).withColumnRenamed("account_id", "o_orderkey").drop("ts", "status")
    own = own.select("*", c("o_custkey").alias("account_id"), c("o_orderkey").cast("string").alias("cycle_id"),
                     F.lit(None).cast("string").alias("market_regime")).drop("o_orderkey", "o_custkey")
    return cyc, accounts, quotes(spark, sf), specs(spark, sf), own


DESK_LIMITS = LiveLimits(max_quote_age_seconds=400 * 86_400.0, max_account_age_seconds=120.0)
DESK_SAFEGUARD = SafeguardConfig(max_data_age_seconds=400 * 86_400.0, max_drawdown_pct=0.5, max_gross_notional_multiple=4.0)
DESK_SQL = f"""WITH RECURSIVE {PLANS}, {QUOTES},
cyc AS (SELECT o_custkey AS account_id, CAST(o_orderkey AS VARCHAR) AS cycle_id, CAST(o_orderdate AS TIMESTAMP) AS now, o_orderpriority = '5-LOW' AS kill,
    c_acctbal + 20000.0e0 AS equity FROM orders JOIN customer ON o_custkey = c_custkey),
own AS (SELECT p.* EXCLUDE (account_id), cyc.account_id, cyc.cycle_id, cyc.now FROM plans p JOIN cyc ON cyc.cycle_id = CAST(p.account_id AS VARCHAR)),
marked AS (SELECT DISTINCT c.account_id, c.cycle_id, c.now, s.symbol FROM cyc c JOIN (SELECT account_id, symbol, min(now) AS since FROM own GROUP BY ALL) s
    ON s.account_id = c.account_id AND c.now >= s.since),
asked AS (SELECT DISTINCT symbol, now FROM marked),
known AS MATERIALIZED (SELECT symbol, now, ts, bid, ask FROM (SELECT a.now, q.*, row_number() OVER (PARTITION BY a.symbol, a.now ORDER BY q.ts DESC, q.seq DESC, q.bid DESC) AS rn
    FROM asked a JOIN quotes q ON q.symbol = a.symbol AND q.ts <= a.now) WHERE rn = 1),
marks AS MATERIALIZED (SELECT account_id, cycle_id, map_from_entries(list({{'k': symbol, 'v': {{'bid': bid, 'day': CAST(ts AS DATE), 'stale': epoch_us(now) - epoch_us(ts) > 34560000e6}}}})) AS marks
  FROM (SELECT m.*, k.ts, k.bid FROM marked m JOIN known k USING (symbol, now)) GROUP BY ALL),
g AS (SELECT o.*, k.bid, k.ask, epoch_us(o.now) - epoch_us(k.ts) > 34560000e6 AS stale, (k.ask - k.bid)/((k.ask + k.bid)/2) AS sf, p_size,
    row_number() OVER (PARTITION BY o.account_id, decision_id ORDER BY o.now, o.cycle_id, ordinal) > 1 AS dup
  FROM own o LEFT JOIN known k USING (symbol, now) LEFT JOIN part ON CAST(p_partkey AS VARCHAR) = o.symbol),
h AS (SELECT *, greatest(expected_cost, sf) AS cost, confidence*(expected_return - greatest(expected_cost, sf) - downside_risk - 0.0e0 - uncertainty) AS edge2 FROM g),
k AS (SELECT *, CASE WHEN dup THEN 'DUPLICATE_DECISION_ID' WHEN bid IS NULL OR p_size IS NULL THEN 'MARKET_DATA_UNAVAILABLE'
    WHEN stale OR p_size <= 2 THEN concat_ws(',', CASE WHEN stale THEN 'STALE_QUOTE' END, CASE WHEN p_size <= 2 THEN 'SYMBOL_DISABLED' END)
    WHEN NOT edge2 > 0 THEN 'BELOW_MINIMUM_NET_EDGE' ELSE '' END AS gate FROM h),
steps AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY now, cycle_id, kind, seq) AS step FROM (
  SELECT account_id, cycle_id, now, kill, equity, 0 AS kind, 0 AS seq, marks, NULL AS ordinal, NULL AS decision_id, NULL AS symbol, NULL AS gate, NULL AS ask,
    NULL AS risk_fraction, NULL AS notional_fraction, NULL AS expected_return, NULL AS cost FROM cyc LEFT JOIN marks USING (account_id, cycle_id)
  UNION ALL SELECT account_id, cycle_id, now, NULL, NULL, 1, row_number() OVER (PARTITION BY account_id, cycle_id ORDER BY gate <> '', edge2 DESC, confidence DESC, expected_return DESC, ordinal),
    NULL, ordinal, decision_id, symbol, gate, ask, risk_fraction, notional_fraction, expected_return, cost FROM k)),
walk AS (
  SELECT account_id, 0::BIGINT AS step, NULL::VARCHAR AS cycle_id, NULL::BIGINT AS ordinal, NULL::VARCHAR AS reasons, NULL::DOUBLE AS base, 0.0e0 AS realized, NULL::DOUBLE AS peak,
    0.0e0 AS equity, 0.0e0 AS top, 0.0e0 AS daily, false AS kill, '' AS stop, 0::BIGINT AS exits, 0.0e0 AS gross_before,
    []::STRUCT(id VARCHAR, symbol VARCHAR, notional DOUBLE, risk DOUBLE, quantity DOUBLE, entry DOUBLE, stop DOUBLE, target DOUBLE)[] AS book,
    []::STRUCT(day DATE, gain DOUBLE)[] AS closed FROM (SELECT DISTINCT account_id FROM cyc)
  UNION ALL
  SELECT account_id, step, cycle_id, ordinal, reasons, base, realized, peak, equity, top, daily, kill, stop, exits, gross_before,
    CASE WHEN kind = 1 AND reasons = '' THEN list_append(book, {{'id': decision_id, 'symbol': symbol, 'notional': notional, 'risk': risk, 'quantity': notional/ask, 'entry': ask,
      'stop': ask*(1.0e0 - risk/notional), 'target': ask*(1.0e0 + 2.0e0*(risk/notional))}}) ELSE book END, closed
  FROM (SELECT *, CASE WHEN kind = 0 THEN NULL WHEN gate = 'DUPLICATE_DECISION_ID' THEN gate WHEN stop <> '' THEN stop WHEN gate <> '' THEN gate ELSE
      concat_ws(',', CASE WHEN kill THEN 'KILL_SWITCH' END, CASE WHEN risk/equity > 0.005e0 THEN 'ORDER_RISK_LIMIT' END,
        CASE WHEN (coalesce(list_sum(list_transform(book, lambda p: p.risk)), 0) + risk)/equity > 0.02e0 THEN 'TOTAL_OPEN_RISK_LIMIT' END,
        CASE WHEN greatest(0.0e0, -daily/equity) >= 0.02e0 THEN 'DAILY_LOSS_LIMIT' END,
        CASE WHEN greatest(0.0e0, 1.0e0 - equity/greatest(top, equity)) >= 0.5e0 THEN 'MAX_DRAWDOWN' END,
        CASE WHEN (coalesce(list_sum(list_transform(book, lambda p: p.notional)), 0) + notional)/equity > 4.0e0 THEN 'GROSS_EXPOSURE_LIMIT' END,
        CASE WHEN expected_return*notional - cost*notional <= 0 THEN 'NO_POSITIVE_NET_EDGE' END,
        CASE WHEN expected_return > 0 AND cost*notional >= expected_return*notional THEN 'COST_CONSUMES_EDGE' END) END AS reasons
    FROM (SELECT * EXCLUDE (equity), equity, equity*risk_fraction AS risk, equity*notional_fraction AS notional FROM (
      SELECT account_id, step, cycle_id, ordinal, decision_id, symbol, gate, ask, risk_fraction, notional_fraction, expected_return, cost, kind, kill, base, realized, stop, exits, gross_before, book, closed,
        CASE WHEN kind = 0 AND stop <> 'PORTFOLIO_MARK_UNAVAILABLE' THEN greatest(peak, shadow) ELSE peak END AS peak,
        CASE WHEN kind = 0 THEN least(own, shadow) ELSE equity END AS equity,
        CASE WHEN kind = 0 THEN greatest(CASE WHEN stop <> 'PORTFOLIO_MARK_UNAVAILABLE' THEN greatest(peak, shadow) ELSE peak END, least(own, shadow)) ELSE top END AS top,
        CASE WHEN kind = 0 THEN least(0.0e0, coalesce(list_sum(list_transform(list_filter(closed, lambda x: x.day = CAST(now AS DATE)), lambda x: x.gain)), 0)) ELSE daily END AS daily
      FROM (SELECT * EXCLUDE (stop), base + realized + coalesce(list_sum(list_transform(list_filter(book, lambda p: NOT coalesce(marks[p.symbol].stale, true)), lambda p: p.quantity*(marks[p.symbol].bid - p.entry))), 0) AS shadow,
          CASE WHEN kind = 1 THEN stop WHEN len(list_filter(book, lambda p: coalesce(marks[p.symbol].stale, true))) > 0 THEN 'PORTFOLIO_MARK_UNAVAILABLE'
            WHEN base + realized + coalesce(list_sum(list_transform(book, lambda p: p.quantity*(marks[p.symbol].bid - p.entry))), 0) <= 0 THEN 'SHADOW_EQUITY_NONPOSITIVE' ELSE '' END AS stop
        FROM (SELECT * EXCLUDE (book, closed, realized, exits, gross_before),
            CASE WHEN kind = 1 THEN book ELSE list_filter(book, lambda p: NOT coalesce(NOT marks[p.symbol].stale AND (marks[p.symbol].bid <= p.stop OR marks[p.symbol].bid >= p.target), false)) END AS book,
            CASE WHEN kind = 1 THEN closed ELSE list_concat(closed, list_transform(gone, lambda p: {{'day': marks[p.symbol].day, 'gain': p.quantity*(marks[p.symbol].bid - p.entry)}})) END AS closed,
            CASE WHEN kind = 1 THEN realized ELSE realized + coalesce(list_sum(list_transform(gone, lambda p: p.quantity*(marks[p.symbol].bid - p.entry))), 0) END AS realized,
            CASE WHEN kind = 1 THEN exits ELSE len(gone) END AS exits, CASE WHEN kind = 1 THEN gross_before ELSE coalesce(list_sum(list_transform(list_filter(book, lambda p: NOT list_contains(list_transform(gone, lambda x: x.id), p.id)), lambda p: p.notional)), 0) END AS gross_before
          FROM (SELECT s.account_id, s.step, s.cycle_id, s.now, s.ordinal, s.decision_id, s.symbol, s.gate, s.ask, s.risk_fraction, s.notional_fraction, s.expected_return, s.cost, s.kind, s.marks,
              s.equity AS own, w.equity, w.top, w.daily, w.stop, w.exits, w.gross_before, w.book, w.closed, w.realized, coalesce(w.base, s.equity) AS base, coalesce(w.peak, s.equity) AS peak,
              CASE WHEN s.kind = 0 THEN s.kill ELSE w.kill END AS kill,
              CASE WHEN s.kind = 0 THEN list_filter(w.book, lambda p: coalesce(NOT s.marks[p.symbol].stale AND (s.marks[p.symbol].bid <= p.stop OR s.marks[p.symbol].bid >= p.target), false)) END AS gone
            FROM walk w JOIN steps s ON s.account_id = w.account_id AND s.step = w.step + 1) a) b) d) e) f) x)
"""


@query("shadow_cycle_sequence", f"{DESK_SQL} SELECT account_id, cycle_id, ordinal, reasons FROM walk WHERE ordinal IS NOT NULL")
def shadow_cycle_sequence(spark, sf):
    """Decisions of all cycles of all customers, each on the book that the cycles before it left."""
    run = run_cycles(*desk(spark, sf), limits=DESK_LIMITS, safeguard=DESK_SAFEGUARD, quote_tie="seq")
    return run.decisions.select("account_id", "cycle_id", "ordinal", F.array_join("reasons", ",").alias("reasons"))


@query("shadow_cycle_books", f"""{DESK_SQL} SELECT account_id, cycle_id, exits, round(realized, 4) + 0.0 AS realized,
  round(gross_before, 4) + 0.0 AS gross, round(equity, 4) + 0.0 AS equity, stop AS reasons FROM walk WHERE ordinal IS NULL AND step > 0""")
def shadow_cycle_books(spark, sf):
    """The book of every cycle after its marks: exits, what is still open, equity."""
    run = run_cycles(*desk(spark, sf), limits=DESK_LIMITS, safeguard=DESK_SAFEGUARD, quote_tie="seq")
    return run.books.select(
        "account_id", "cycle_id", "exits", r(c("realized_total_usd"), 4).alias("realized"), r(c("gross_notional_usd"), 4).alias("gross"),
        r(c("equity_usd"), 4).alias("equity"), F.array_join("cycle_reasons", ",").alias("reasons"))


@query("lifecycle_events", f"""{DESK_SQL} SELECT account_id, cycle_id, 'OPEN' AS event_type, count(*) AS events FROM walk WHERE ordinal IS NOT NULL AND reasons = '' GROUP BY ALL
UNION ALL SELECT account_id, cycle_id, 'CLOSE', exits FROM walk WHERE ordinal IS NULL AND step > 0 AND exits > 0""")
def lifecycle_events(spark, sf):
    """OPEN and CLOSE events per cycle, each position's once."""
    run = run_cycles(*desk(spark, sf), limits=DESK_LIMITS, safeguard=DESK_SAFEGUARD, quote_tie="seq")
    return run.events.groupBy("account_id", "cycle_id", "event_type").agg(F.countDistinct("event_id").alias("events"))


# --- streams ---------------------------------------------------------------------------------------


def stream(spark, sf, name, time=None, parts=3, columns=("*",)):
    """The whole table as a stream of ``parts`` micro-batches: in order of ``time``, or dealt at random without it. A micro-batch is
    several files, so that no task writes or reads a whole one."""
    rows = table(spark, sf, name).select(*columns)
    base = f"{shared_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"
    files = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // parts)
    if time is None:
        rows.repartition(parts * files).write.parquet(base)
    else:
        moment = F.unix_micros(c(time).cast("timestamp"))
        cuts = rows.select(F.percentile_approx(moment, [k / parts for k in range(1, parts)])).first()[0] or []
        part = sum((F.when(moment > x, 1).otherwise(0) for x in cuts), F.lit(0))
        for k in range(parts):  # files are read in the order they were written
            rows.where(part == k).coalesce(files).write.mode("append").parquet(base)
            # A task without rows leaves no file; empty ones make the number of files that a micro-batch is.
            for _ in range((k + 1) * files - len(spark.read.schema(rows.schema).parquet(base).inputFiles())):
                rows.limit(0).coalesce(1).write.mode("append").parquet(base)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(base)


@query("stream_closed_bars", """WITH t AS (SELECT event_type AS symbol, ts, value FROM events),
b AS (SELECT symbol, date_trunc('hour', ts) AS start, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume FROM t GROUP BY 1, 2)
SELECT symbol, start AS ts, open, high, low, close, volume FROM b WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM t) - INTERVAL 10 MINUTE""")
def stream_closed_bars(spark, sf):
    ticks = stream(spark, sf, "events", "ts").select(c("event_type").alias("symbol"), c("ts").cast("timestamp").alias("ts"), c("value").alias("price"))
    return drain(FD.closed_bars(ticks, "1 hour", "10 minutes"), "bars").withColumn("ts", c("ts").cast("timestamp_ntz"))


@query("stream_late_ticks", """WITH m AS (SELECT min(ts) + (max(ts) - min(ts))/2 AS mid FROM events),
t AS (SELECT event_type AS symbol, ts, value, CASE WHEN ts > mid THEN 1 ELSE 0 END + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS delivery, date_trunc('hour', ts) AS start FROM events, m),
w AS (SELECT d.delivery, (SELECT max(ts) FROM t WHERE t.delivery < d.delivery) - INTERVAL 10 MINUTE AS mark FROM (SELECT unnest([0, 1, 2, 3]) AS delivery) d),
k AS (SELECT t.*, coalesce(start + INTERVAL 1 HOUR <= mark, false) AS late FROM t JOIN w USING (delivery)),
b AS (SELECT symbol, 'bar' AS kind, start AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume FROM k WHERE NOT late GROUP BY symbol, start)
SELECT * FROM b WHERE ts + INTERVAL 1 HOUR <= (SELECT mark FROM w WHERE delivery = 3)
UNION ALL SELECT symbol, 'late', ts, value, value, value, value, 1.0e0 FROM k WHERE late""")
def stream_late_ticks(spark, sf):
    """Ticks in three deliveries, every seventh one delivery late: closed bars, and the ticks that came after their bar."""
    events = table(spark, sf, "events").withColumn("at", c("ts").cast("timestamp"))
    half = events.agg((F.min(F.unix_micros("at")) + F.max(F.unix_micros("at"))) / 2).first()[0] or 0.0
    delivery = (F.unix_micros("at") > half).cast("int") + (c("event_id") % 7 == 0).cast("int")
    base = f"{shared_dir(spark).rstrip('/')}/ticks-{uuid.uuid4().hex}"
    for k in range(3):
        events.where(delivery == k).select(c("event_type").alias("symbol"), c("at").alias("ts"), c("value").alias("price")).write.mode("append").parquet(f"{base}/ticks")
        ticks = spark.readStream.schema("symbol string, ts timestamp, price double").parquet(f"{base}/ticks")
        rows = bars_and_late_ticks(ticks, timedelta(hours=1), "10 minutes")
        rows.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}/state").format("parquet").start(f"{base}/out").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/out").withColumn("ts", c("ts").cast("timestamp_ntz"))


@query("stream_provider_quotes", f"WITH {SYMBOLS} SELECT CAST(snapshot_id AS VARCHAR) AS snapshot_id, symbol, bid, ts FROM syms")
def stream_provider_quotes(spark, sf):
    """Snapshot documents that arrive in three deliveries, read by one query that is started again after each."""
    base = f"{shared_dir(spark).rstrip('/')}/snapshots-{uuid.uuid4().hex}"
    docs = snapshot_texts(spark, sf).select(c("snapshot_id").cast("string").alias("snapshot_id"), "value")
    for k in range(3):  # the choice of documents is one of orders and lines, so each delivery makes its own documents only
        docs.where(F.pmod(F.xxhash64("snapshot_id"), F.lit(3)) == k).write.mode("append").option("compression", "zstd").parquet(f"{base}/docs")
        rows = SN.snapshot_quotes(SN.parse_snapshots(PV.provider_snapshots(spark, f"{base}/docs", stream=True)))
        rows.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}/state").format("parquet").start(f"{base}/out").awaitTermination()
    out = spark.read.schema(rows.schema).parquet(f"{base}/out")
    return out.select("snapshot_id", "symbol", "bid", wall_clock())


@query("stream_unique_decisions", "SELECT DISTINCT concat_ws(':', l_orderkey, l_linenumber) AS decision_id FROM lineitem")
def stream_unique_decisions(spark, sf):
    rows = stream(spark, sf, "lineitem", columns=("l_orderkey", "l_linenumber", "l_shipdate")).select(
        F.concat_ws(":", "l_orderkey", "l_linenumber").alias("decision_id"), F.date_trunc("month", c("l_shipdate").cast("timestamp")).alias("ts"))
    base = f"{shared_dir(spark).rstrip('/')}/decisions-{uuid.uuid4().hex}"
    journal_stream(rows, f"{base}/journal", f"{base}/checkpoint", order=("ts",)).awaitTermination()
    return SJ.read_decisions(spark, f"{base}/journal", rows.withColumn("dt", F.to_date("ts")).schema).select("decision_id")


@query("stream_daily_pnl", """WITH t AS (SELECT o_orderstatus AS account_id, CAST(o_orderdate AS DATE) AS day, sum(CAST(round(o_totalprice*100) AS BIGINT)) AS cents, max(o_orderdate) AS ts FROM orders GROUP BY 1, 2)
SELECT account_id, day, round(cents/100.0e0, 2) + 0.0 AS realized_pnl_usd FROM t WHERE day + INTERVAL 1 DAY <= (SELECT max(o_orderdate) FROM orders) - INTERVAL 1 HOUR""")
def stream_daily_pnl(spark, sf):
    events = stream(spark, sf, "orders", "o_orderdate").select(
        c("o_orderstatus").alias("account_id"), F.lit("CLOSE").alias("event_type"), c("o_orderdate").cast("timestamp").alias("ts"),
        F.round(c("o_totalprice") * 100).cast("bigint").alias("pnl_usd"))
    out = drain(FD.daily_pnl(events), "pnl")
    return out.select("account_id", "day", r(c("realized_pnl_usd") / 100.0, 2).alias("realized_pnl_usd"))


@query("stream_barrier_exits", f"WITH {QUOTES}, {POSITIONS}, {EXITS} SELECT decision_id, exit_reason, closed_at, exit_price, realized_pnl_usd FROM exits")
def stream_barrier_exits(spark, sf):
    lines = stream(spark, sf, "lineitem", "l_shipdate", columns=(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate"))
    live_positions, live_quotes = positions(spark, sf, lines), quotes(spark, sf, lines)
    out = drain(exit_stream(live_positions, live_quotes, tie="seq", salts=4), "exits")
    out = settle_late(out, positions(spark, sf), quotes(spark, sf), tie="seq")
    return out.select("decision_id", "exit_reason", wall_clock("closed_at"), "exit_price", "realized_pnl_usd")
