"""Plans, quotes, gates, admission, exits, books, journals over the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions import pricing as PR
from marketloom.functions.reasons import reason_codes
from marketloom.operators import admission as AD
from marketloom.operators import exits as EX
from marketloom.operators import gates as GA
from marketloom.operators import journal as JO
from marketloom.operators import ledger as LE
from marketloom.operators import quality as QU
from marketloom.operators import ranking as RA
from marketloom.operators.audit import RULES, BarAudit
from marketloom.operators.features import technical_features
from marketloom.operators.fingerprint import DatasetMetadata, dataset_fingerprint
from marketloom.operators.series import latest_per_key
from marketloom.session import interim

from .registry import query, r, rs, sql_round, wall_clock
from .tables import bars, table
from . import sql

c = F.col
CYCLE = ("account_id",)


def plans(spark, sf, lines=None, carry=()):
    """A plan per order line; the order is account and cycle. The ordinal encodes the line's sort keys,
    so numbering needs no window. Made from ``lines`` where these are joined already, with their columns ``carry``."""
    return (table(spark, sf, "lineitem") if lines is None else lines).select(
        *carry,
        c("l_orderkey").alias("account_id"),
        ((c("l_linenumber").cast("bigint") * 10_000_000 + c("l_partkey")) * 1_000_000 + c("l_suppkey")).alias("ordinal"),
        F.concat_ws(":", "l_orderkey", "l_linenumber").alias("decision_id"),
        c("l_partkey").cast("string").alias("symbol"),
        F.lit("lines").alias("source"),
        c("l_discount").alias("expected_return"),
        (c("l_tax") / 10).alias("expected_cost"),
        (c("l_quantity") / 5000).alias("downside_risk"),
        F.lit(0.0).alias("correlation_penalty"),
        F.lit(0.001).alias("uncertainty"),
        (1 - c("l_tax")).alias("confidence"),
        (0.001 * (1 + c("l_linenumber") % 5)).alias("risk_fraction"),
        (c("l_quantity") / 25).alias("notional_fraction"),
        F.lit(2.0).alias("reward_risk"),
        c("l_linestatus").alias("status"),
        c("l_shipdate").cast("timestamp").alias("ts"),
    )


PLANS = """
plans AS (
  SELECT l_orderkey AS account_id,
    (CAST(l_linenumber AS BIGINT)*10000000 + l_partkey)*1000000 + l_suppkey AS ordinal,
    concat_ws(':', l_orderkey, l_linenumber) AS decision_id, CAST(l_partkey AS VARCHAR) AS symbol,
    l_discount AS expected_return, l_tax/10 AS expected_cost, l_quantity/5000 AS downside_risk,
    0.001e0 AS uncertainty, 1 - l_tax AS confidence, 0.001e0*(1 + l_linenumber % 5) AS risk_fraction,
    l_quantity/25 AS notional_fraction, 2.0e0 AS reward_risk, l_linestatus AS status, l_shipdate AS ts
  FROM lineitem),
edges AS (SELECT *, confidence*(expected_return - expected_cost - downside_risk - 0.0e0 - uncertainty) AS net_edge FROM plans)"""


def ranked_sql(partition: str, where: str = "net_edge > 0") -> str:
    over = f"{partition} ORDER BY net_edge DESC, confidence DESC, expected_return DESC, ordinal ASC"
    return f"ranked AS (SELECT *, row_number() OVER ({over}) AS rank FROM edges WHERE {where})"


@query("opportunity_ranking", f"WITH {PLANS}, {ranked_sql('PARTITION BY account_id')} SELECT account_id, ordinal, {sql_round(('net_edge',))}, rank FROM ranked")
def opportunity_ranking(spark, sf):
    return RA.rank_opportunities(plans(spark, sf), CYCLE).select("account_id", "ordinal", r("net_edge"), "rank")


@query("opportunity_ranking_hot_group", f"WITH {PLANS}, {ranked_sql('PARTITION BY status')} SELECT status, account_id, ordinal, rank FROM ranked")
def opportunity_ranking_hot_group(spark, sf):
    """Two groups hold the whole table: ranks come from bins, no group meets in a task."""
    return RA.rank_opportunities(plans(spark, sf), ("status",)).select("status", "account_id", "ordinal", "rank")


@query("opportunity_top_k", f"WITH {PLANS}, {ranked_sql('PARTITION BY status', 'net_edge > 0.01e0')} SELECT status, account_id, ordinal, rank FROM ranked WHERE rank <= 20")
def opportunity_top_k(spark, sf):
    policy = RA.OpportunityPolicy(minimum_net_edge=0.01, max_opportunities=20)
    return RA.rank_opportunities(plans(spark, sf), ("status",), policy).select("status", "account_id", "ordinal", "rank")


def intents(spark, sf):
    """Order lines as intents against the customer's balance as equity."""
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), c("o_custkey") == c("c_custkey"))
    lines = table(spark, sf, "lineitem").join(orders, c("l_orderkey") == c("o_orderkey"))
    return lines.where(c("c_acctbal") > 0).select(
        F.concat_ws(":", "l_orderkey", "l_linenumber").alias("decision_id"),
        c("l_partkey").cast("string").alias("symbol"),
        F.when(c("l_returnflag") == "R", "live").when(c("l_returnflag") == "A", "paper").otherwise("shadow").alias("mode"),
        (c("c_acctbal") * c("l_quantity") / 5000).alias("estimated_risk_usd"),
        (c("c_acctbal") * c("l_quantity") / 20).alias("notional_usd"),
        (c("c_acctbal") * c("l_discount")).alias("expected_gross_edge_usd"),
        (c("c_acctbal") * c("l_tax")).alias("expected_cost_usd"),
        c("c_acctbal").alias("equity_usd"),
        (c("c_acctbal") * (1 + c("l_tax") * 2)).alias("equity_peak_usd"),
        (-c("c_acctbal") * c("l_discount") / 4).alias("daily_pnl_usd"),
        (c("c_acctbal") * c("l_discount") / 5).alias("open_risk_usd"),
        c("c_acctbal").alias("gross_notional_usd"),
        (c("l_linenumber") * 6.0).alias("data_age_seconds"),
        (c("l_quantity") / 4).cast("int").alias("orders_last_minute"),
        (c("o_orderstatus") == "P").alias("kill_switch"),
        "l_orderkey", "l_suppkey",
    )


INTENTS = """
intents AS (
  SELECT l_orderkey, l_suppkey, concat_ws(':', l_orderkey, l_linenumber) AS decision_id,
    CASE WHEN l_returnflag = 'R' THEN 'live' WHEN l_returnflag = 'A' THEN 'paper' ELSE 'shadow' END AS mode,
    c_acctbal*l_quantity/5000 AS risk, c_acctbal*l_quantity/20 AS notional, c_acctbal*l_discount AS edge,
    c_acctbal*l_tax AS cost, c_acctbal AS equity, c_acctbal*(1 + l_tax*2) AS peak, -c_acctbal*l_discount/4 AS pnl,
    c_acctbal*l_discount/5 AS open_risk, c_acctbal AS gross, l_linenumber*6.0e0 AS age,
    CAST(trunc(l_quantity/4) AS INTEGER) AS n_orders, o_orderstatus = 'P' AS kill
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0),
gated AS (
  SELECT *, edge - cost AS net_edge_usd, risk/equity AS order_risk_pct, (open_risk + risk)/equity AS total_open_risk_pct_after,
    concat_ws(',', CASE WHEN kill THEN 'KILL_SWITCH' END, CASE WHEN mode = 'live' THEN 'LIVE_EXECUTION_DISABLED' END,
      CASE WHEN age > 30 THEN 'STALE_DATA' END, CASE WHEN n_orders >= 10 THEN 'ORDER_RATE_LIMIT' END,
      CASE WHEN risk/equity > 0.005e0 THEN 'ORDER_RISK_LIMIT' END,
      CASE WHEN (open_risk + risk)/equity > 0.02e0 THEN 'TOTAL_OPEN_RISK_LIMIT' END,
      CASE WHEN greatest(0.0e0, -pnl/equity) >= 0.02e0 THEN 'DAILY_LOSS_LIMIT' END,
      CASE WHEN greatest(0.0e0, 1.0e0 - equity/greatest(peak, equity)) >= 0.10e0 THEN 'MAX_DRAWDOWN' END,
      CASE WHEN (gross + notional)/equity > 2.0e0 THEN 'GROSS_EXPOSURE_LIMIT' END,
      CASE WHEN edge - cost <= 0 THEN 'NO_POSITIVE_NET_EDGE' END,
      CASE WHEN edge > 0 AND cost >= edge THEN 'COST_CONSUMES_EDGE' END) AS reasons FROM intents)"""


@query("safeguard_gate", f"""WITH {INTENTS} SELECT decision_id, l_suppkey, reasons = '' AS approved, reasons,
  {sql_round(('net_edge_usd', 'order_risk_pct', 'total_open_risk_pct_after'), 6)} FROM gated""")
def safeguard_gate(spark, sf):
    return GA.safeguard(intents(spark, sf)).select(
        "decision_id", "l_suppkey", "approved", F.array_join("reasons", ",").alias("reasons"),
        *rs(("net_edge_usd", "order_risk_pct", "total_open_risk_pct_after"), 6))


def _admission_input(spark, sf):
    equity = table(spark, sf, "orders").select(c("o_orderkey").alias("account_id"), c("o_totalprice").alias("equity_usd"))
    # Only what admission reads, so that no other column is shuffled.
    own = plans(spark, sf).withColumn("net_edge", RA.net_edge()).where("net_edge > 0").select(
        *CYCLE, "ordinal", *RA.RANKED_BY, "expected_cost", "risk_fraction", "notional_fraction")
    sized = AD.intents(own.join(equity, "account_id")).drop("risk_fraction", "notional_fraction", "expected_cost")
    return sized.withColumns({
        "mode": F.lit("paper"), "equity_peak_usd": c("equity_usd"), "daily_pnl_usd": F.lit(0.0),
        "open_risk_usd": c("equity_usd") * 0.005, "gross_notional_usd": F.lit(0.0), "data_age_seconds": F.lit(0.0),
        "orders_last_minute": F.lit(7), "kill_switch": F.lit(False),
    })


ADMISSION = f"""WITH RECURSIVE {PLANS}, {ranked_sql('PARTITION BY account_id')},
sized AS (
  SELECT ranked.*, o_totalprice AS equity, o_totalprice*risk_fraction AS risk, o_totalprice*notional_fraction AS notional,
    expected_return*(o_totalprice*notional_fraction) AS edge, expected_cost*(o_totalprice*notional_fraction) AS cost
  FROM ranked JOIN orders ON o_orderkey = account_id),
walk AS (
  SELECT account_id, 0::BIGINT AS rank, equity, equity*0.005e0 AS open_risk, 0.0e0 AS gross, 7 AS n_orders, '' AS reasons, NULL::BIGINT AS ordinal
  FROM sized WHERE rank = 1
  UNION ALL
  SELECT x.account_id, x.rank, x.equity,
    CASE WHEN x.reasons = '' THEN x.open_risk + x.risk ELSE x.open_risk END,
    CASE WHEN x.reasons = '' THEN x.gross + x.notional ELSE x.gross END,
    CASE WHEN x.reasons = '' THEN x.n_orders + 1 ELSE x.n_orders END, x.reasons, x.ordinal
  FROM (SELECT s.*, w.open_risk, w.gross, w.n_orders,
      concat_ws(',', CASE WHEN w.n_orders >= 10 THEN 'ORDER_RATE_LIMIT' END,
        CASE WHEN s.risk/s.equity > 0.005e0 THEN 'ORDER_RISK_LIMIT' END,
        CASE WHEN (w.open_risk + s.risk)/s.equity > 0.02e0 THEN 'TOTAL_OPEN_RISK_LIMIT' END,
        CASE WHEN (w.gross + s.notional)/s.equity > 2.0e0 THEN 'GROSS_EXPOSURE_LIMIT' END,
        CASE WHEN s.edge - s.cost <= 0 THEN 'NO_POSITIVE_NET_EDGE' END,
        CASE WHEN s.edge > 0 AND s.cost >= s.edge THEN 'COST_CONSUMES_EDGE' END) AS reasons
    FROM walk w JOIN sized s ON s.account_id = w.account_id AND s.rank = w.rank + 1) x)
"""


@query("budget_admission", ADMISSION + "SELECT account_id, ordinal, rank, reasons = '' AS approved, reasons FROM walk WHERE rank > 0")
def budget_admission(spark, sf):
    out = AD.admit(_admission_input(spark, sf), CYCLE, by=RA.RANKED_BY)
    return out.select("account_id", "ordinal", "rank", "approved", F.array_join("reasons", ",").alias("reasons"))


@query("cycle_counts", ADMISSION.replace("w.n_orders + 1", "w.n_orders").replace("x.n_orders + 1", "x.n_orders") + """
SELECT account_id, count(*) FILTER (WHERE reasons = '') AS accepted, count(*) FILTER (WHERE reasons <> '') AS rejected FROM walk WHERE rank > 0 GROUP BY 1""")
def cycle_counts(spark, sf):
    return AD.cycle_counts(AD.admit(_admission_input(spark, sf), CYCLE, count_orders=False, by=RA.RANKED_BY), CYCLE)


@query("duplicate_decisions", f"""WITH {PLANS},
firsts AS (SELECT decision_id, min(ordinal) AS first FROM plans WHERE status = 'O' GROUP BY 1),
seen AS (SELECT DISTINCT decision_id FROM plans WHERE status = 'F')
SELECT p.decision_id, p.ordinal, p.ordinal <> f.first OR s.decision_id IS NOT NULL AS duplicate
FROM plans p JOIN firsts f USING (decision_id) LEFT JOIN seen s USING (decision_id) WHERE status = 'O'""")
def duplicate_decisions(spark, sf):
    """Open lines are the batch, filled lines the journal."""
    p = plans(spark, sf)
    flagged = AD.flag_duplicates(p.where("status = 'O'"), p.where("status = 'F'"))
    return flagged.select("decision_id", "ordinal", "duplicate")


@query("new_journal_rows", f"""WITH {PLANS}
SELECT decision_id, min(ordinal) AS ordinal FROM plans WHERE status = 'O'
  AND decision_id NOT IN (SELECT decision_id FROM plans WHERE status = 'F') GROUP BY 1""")
def new_journal_rows(spark, sf):
    p = plans(spark, sf)
    return AD.new_decisions(p.where("status = 'O'"), p.where("status = 'F'"), ("ordinal",)).select("decision_id", "ordinal")


def quotes(spark, sf, lines=None):
    bid = c("l_extendedprice") / c("l_quantity")
    lines = table(spark, sf, "lineitem") if lines is None else lines
    return lines.select(
        c("l_partkey").cast("string").alias("symbol"), bid.alias("bid"), (bid * 1.001).alias("ask"),
        c("l_shipdate").cast("timestamp").alias("ts"), c("l_orderkey").alias("seq"), F.lit("lines").alias("source"),
    )


def specs(spark, sf):
    return table(spark, sf, "part").select(
        c("p_partkey").cast("string").alias("symbol"), F.lit(0.01).alias("tick_size"), F.lit(0.0).alias("tick_value"),
        F.lit(0.01).alias("volume_min"), c("p_size").cast("double").alias("volume_max"), F.lit(0.01).alias("volume_step"),
        (c("p_size") > 2).alias("trade_enabled"),
    )


QUOTES = """
quotes AS (
  SELECT CAST(l_partkey AS VARCHAR) AS symbol, l_extendedprice/l_quantity AS bid, l_extendedprice/l_quantity*1.001e0 AS ask,
         l_shipdate AS ts, l_orderkey AS seq FROM lineitem),
latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, seq DESC) AS rn FROM quotes) WHERE rn = 1)"""


def latest_quotes(spark, sf):
    q = quotes(spark, sf).withColumn("_o", F.struct("ts", "seq"))
    return latest_per_key(q, ["symbol"], "_o").drop("_o")


@query("quotes_latest", f"WITH {QUOTES} SELECT symbol, ts, seq, bid, ask FROM latest")
def quotes_latest(spark, sf):
    return latest_quotes(spark, sf).select("symbol", wall_clock(), "seq", "bid", "ask")


@query("market_checks", f"""WITH {PLANS}, {QUOTES},
j AS (SELECT p.*, q.bid, q.ask, q.ts AS quote_ts, CAST(p_size AS DOUBLE) AS vmax, p_size > 2 AS enabled, p_partkey,
        (q.ask - q.bid)/((q.ask + q.bid)/2) AS spread_fraction
      FROM plans p LEFT JOIN latest q USING (symbol) LEFT JOIN part ON CAST(p_partkey AS VARCHAR) = p.symbol),
k AS (SELECT *, CASE WHEN bid IS NULL OR p_partkey IS NULL THEN 'MARKET_DATA_UNAVAILABLE' ELSE
   concat_ws(',', CASE WHEN epoch_us(ts) - epoch_us(quote_ts) > 86400e6 THEN 'STALE_QUOTE' END,
     CASE WHEN spread_fraction > 0.0005e0 THEN 'EXCESSIVE_SPREAD' END, CASE WHEN NOT enabled THEN 'SYMBOL_DISABLED' END,
     CASE WHEN vmax < 0.01e0 THEN 'INVALID_VOLUME_RANGE' END) END AS reasons FROM j)
SELECT reasons, count(*) AS plans, round(sum(greatest(expected_cost, spread_fraction)), 6) + 0.0 AS effective_cost FROM k GROUP BY 1""")
def market_checks(spark, sf):
    joined = AD.with_market(plans(spark, sf), latest_quotes(spark, sf), specs(spark, sf))
    limits = QU.LiveLimits(max_quote_age_seconds=86_400.0, max_spread_fraction=0.0005)
    checks = F.concat(QU.live_quote_rules("ts", limits, "quote_ts"), QU.live_symbol_rules())
    reasons = F.when(c("market_missing"), F.array(F.lit("MARKET_DATA_UNAVAILABLE"))).otherwise(checks)
    return joined.groupBy(F.array_join(reasons, ",").alias("reasons")).agg(
        F.count(F.lit(1)).alias("plans"),
        r(F.sum(PR.effective_cost("expected_cost", PR.spread_fraction())), 6).alias("effective_cost"))


def positions(spark, sf, lines=None):
    """Every line opens a position at its own quote."""
    ask = c("l_extendedprice") / c("l_quantity") * 1.001
    lines = table(spark, sf, "lineitem") if lines is None else lines
    base = lines.select(
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("decision_id"),
        c("l_partkey").cast("string").alias("symbol"), ask.alias("ask"), c("l_shipdate").cast("timestamp").alias("opened_at"),
        (c("l_quantity") * 100).alias("notional_usd"),
        (c("l_quantity") * 100 * (0.05 + c("l_discount") * 4)).alias("estimated_risk_usd"),
        c("l_returnflag").alias("account_id"),
    )
    g = PR.long_geometry("ask", "notional_usd", "estimated_risk_usd", F.lit(2.0))
    return base.withColumns({
        "quantity": g.quantity, "entry_price": g.entry_price, "stop_loss": g.stop_loss, "take_profit": g.take_profit,
        "valid": g.valid,
    })


POSITIONS = """
pos0 AS (
  SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS decision_id, CAST(l_partkey AS VARCHAR) AS symbol,
    l_extendedprice/l_quantity*1.001e0 AS entry_price, l_shipdate AS opened_at, l_quantity*100 AS notional,
    l_quantity*100*(0.05e0 + l_discount*4) AS risk, l_returnflag AS account_id FROM lineitem),
positions AS (
  SELECT *, notional/entry_price AS quantity, entry_price*(1 - risk/notional) AS stop_loss,
    entry_price*(1 + 2.0e0*(risk/notional)) AS take_profit FROM pos0)"""


@query("position_geometry", f"WITH {POSITIONS} SELECT decision_id, quantity, entry_price, stop_loss, take_profit FROM positions")
def position_geometry(spark, sf):
    return positions(spark, sf).select("decision_id", "quantity", "entry_price", "stop_loss", "take_profit")


EXITS = """
touch AS (
  SELECT p.decision_id, min(struct_pack(ts := q.ts, seq := q.seq, bid := q.bid)) AS x
  FROM positions p JOIN quotes q ON q.symbol = p.symbol AND q.ts >= p.opened_at
    AND (q.bid <= p.stop_loss OR q.bid >= p.take_profit) GROUP BY 1),
exits AS (
  SELECT p.decision_id, account_id, CASE WHEN x.bid <= stop_loss THEN 'STOP_LOSS' ELSE 'TAKE_PROFIT' END AS exit_reason, x.bid AS exit_price,
    x.ts AS closed_at, quantity*(x.bid - entry_price) AS realized_pnl_usd FROM positions p JOIN touch USING (decision_id))"""


@query("barrier_exits", f"WITH {QUOTES}, {POSITIONS}, {EXITS} SELECT decision_id, exit_reason, closed_at, exit_price, realized_pnl_usd FROM exits")
def barrier_exits(spark, sf):
    out = EX.first_exits(positions(spark, sf), quotes(spark, sf), tie="seq")
    return out.select("decision_id", "exit_reason", wall_clock("closed_at"), "exit_price", "realized_pnl_usd")


@query("daily_realized_pnl", f"""WITH {QUOTES}, {POSITIONS}, {EXITS}
SELECT account_id, CAST(closed_at AS DATE) AS day, round(sum(realized_pnl_usd), 3) + 0.0 AS realized_pnl_usd FROM exits GROUP BY 1, 2""")
def daily_realized_pnl(spark, sf):
    exits = EX.first_exits(positions(spark, sf), quotes(spark, sf), tie="seq", carry=("account_id",))
    events = exits.select("account_id", F.lit("CLOSE").alias("event_type"), c("closed_at").alias("ts"),
                          c("realized_pnl_usd").alias("pnl_usd"))
    return LE.daily_realized_pnl(events, ("account_id",)).select("account_id", "day", r("realized_pnl_usd", 3))


@query("book_marks", f"""WITH {QUOTES}, {POSITIONS},
m AS (SELECT p.account_id, risk, notional, quantity*(q.bid - entry_price) AS pnl, epoch_us(TIMESTAMP '2001-06-01') - epoch_us(q.ts) > 2592000e6 AS stale
      FROM positions p LEFT JOIN latest q USING (symbol)),
t AS (SELECT account_id, sum(risk) AS open_risk_usd, sum(notional) AS gross_notional_usd,
        coalesce(sum(CASE WHEN NOT stale THEN pnl END), 0) AS unrealized_pnl_usd, count(*) FILTER (WHERE stale) AS mark_issue_count FROM m GROUP BY 1)
SELECT account_id, {sql_round(('open_risk_usd', 'gross_notional_usd', 'unrealized_pnl_usd'), 3)}, mark_issue_count,
  round(1e9 + 5e0 + unrealized_pnl_usd, 3) + 0.0 AS shadow_equity_usd FROM t""")
def book_marks(spark, sf):
    limits = QU.LiveLimits(max_quote_age_seconds=30 * 86_400.0)
    p = positions(spark, sf).withColumn("now", F.lit("2001-06-01").cast("timestamp"))
    book = LE.book_totals(LE.mark_positions(p, latest_quotes(spark, sf), "now", limits), ("account_id",))
    book = LE.shadow_equity(book.withColumns({
        "base_equity_usd": F.lit(1e9), "realized_pnl_usd": F.lit(5.0), "equity_peak_usd": F.lit(1e9)}))
    return book.select("account_id", *rs(("open_risk_usd", "gross_notional_usd", "unrealized_pnl_usd"), 3),
                       "mark_issue_count", r("shadow_equity_usd", 3))


REGRET = ("total_regret", "mean_regret", "missed_gain", "avoidable_loss", "execution_cost_drag")


@query("regret_summary", f"""WITH f AS (
  SELECT l_returnflag AS key, l_discount - l_tax AS realized, l_discount - 0.03e0 AS alt, l_tax/10 AS cost FROM lineitem),
s AS (SELECT key, count(*) AS observations, sum(greatest(0.0e0, alt - realized)) AS total_regret,
  avg(greatest(0.0e0, alt - realized)) AS mean_regret,
  coalesce(sum(greatest(0.0e0, alt)) FILTER (WHERE realized = 0), 0) AS missed_gain,
  coalesce(sum(-realized) FILTER (WHERE realized < 0 AND alt >= 0), 0) AS avoidable_loss,
  sum(greatest(0.0e0, cost)) AS execution_cost_drag FROM f GROUP BY 1)
SELECT key, observations, {sql_round(REGRET, 6)} FROM s""")
def regret_summary(spark, sf):
    facts = table(spark, sf, "lineitem").select(
        c("l_returnflag").alias("key"), (c("l_discount") - c("l_tax")).alias("realized_net_return"),
        (c("l_discount") - 0.03).alias("alternative_policy_return"),
        F.lit(True).alias("alternative_available_at_decision"), (c("l_tax") / 10).alias("execution_cost_return"))
    return LE.require_causal(LE.regret_summary(facts, ("key",))).select("key", "observations", *rs(REGRET, 6))


LEDGER = ("gross_profit_above_hwm", "withdrawal", "retained_profit", "ending_equity_after_withdrawal", "next_high_water_mark")


@query("capital_ledger", f"""WITH RECURSIVE m AS (
  SELECT o_custkey AS account_id, date_trunc('month', o_orderdate) AS month,
    sum(CAST(round(o_totalprice*100) AS BIGINT))/100.0e0 AS ending, count(*)*1000.0e0 - 2000.0e0 AS contribution FROM orders GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY month) AS k FROM m),
walk AS (
  SELECT account_id, 0::BIGINT AS k, NULL::TIMESTAMP AS month, 0.0e0 AS gross_profit_above_hwm, 0.0e0 AS withdrawal, 0.0e0 AS retained_profit,
    0.0e0 AS ending_equity_after_withdrawal, 0.0e0 AS next_high_water_mark FROM n WHERE k = 1
  UNION ALL
  SELECT account_id, k, month, profit, profit*0.2e0, profit - profit*0.2e0, ending - profit*0.2e0, greatest(hwm, ending - profit*0.2e0)
  FROM (SELECT *, greatest(0.0e0, ending - hwm) AS profit FROM (
    SELECT n.account_id, n.k, n.month, n.ending, greatest(0.0e0, w.next_high_water_mark + n.contribution) AS hwm
    FROM walk w JOIN n ON n.account_id = w.account_id AND n.k = w.k + 1)))
SELECT account_id, CAST(month AS DATE) AS month, {sql_round(LEDGER, 3)} FROM walk WHERE k > 0""")
def capital_ledger(spark, sf):
    months = table(spark, sf, "orders").groupBy(
        c("o_custkey").alias("account_id"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("month")
    ).agg((F.sum(F.round(c("o_totalprice") * 100).cast("bigint")) / 100.0).alias("ending_equity"),
          (F.count(F.lit(1)) * 1000.0 - 2000.0).alias("net_contribution"))
    return LE.capital_ledger(months, ("account_id",)).select("account_id", "month", *rs(LEDGER, 3))


def journal_lines(spark, sf):
    """A hash-chained journal per order, later tampered with: lines of quantity 50 were edited, lines of
    quantity 1 removed. An order's lines are few, so its chain is built inside one row."""
    lines = table(spark, sf, "lineitem").select(
        c("l_orderkey").alias("journal_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("x"))
    per = lines.groupBy("journal_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))

    def event(x, extra=""):
        return F.concat(F.lit('{"decision_id":"'), x["l_linenumber"].cast("string"), F.lit(":"), x["l_partkey"].cast("string"),
                        F.lit(":"), x["l_suppkey"].cast("string"), F.lit('","note":"' + extra + '"}'))

    def add(state, x):
        n = (F.size(state["rows"]) + 1).cast("string")
        tail = F.concat(F.lit(',"previous_hash":"'), state["prev"], F.lit('","sequence":'), n, F.lit("}"))
        digest = F.sha2(F.concat(F.lit('{"event":'), event(x), tail), 256)
        shown = F.when(x["l_quantity"] == 50, event(x, "edited")).otherwise(event(x))
        line = F.concat(F.lit('{"entry_hash":"'), digest, F.lit('","event":'), shown, tail)
        kept = F.struct(line.alias("value"), x["l_quantity"].alias("q"))
        return F.struct(digest.alias("prev"), F.concat(state["rows"], F.array(kept)).alias("rows"))

    empty = F.struct(F.lit(JO.GENESIS_HASH).alias("prev"), F.array().cast("array<struct<value:string,q:double>>").alias("rows"))
    built = per.select("journal_id", F.explode(F.aggregate("xs", empty, add, lambda s: s["rows"])).alias("l"))
    return built.where("l.q <> 1").select("journal_id", "l.value")


AUDIT = """
n AS (SELECT l_orderkey AS journal_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS sequence,
        l_quantity AS q, lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS before FROM lineitem),
audit AS (SELECT journal_id, sequence, CASE WHEN before = 1 THEN 'SEQUENCE' WHEN q = 50 THEN 'ENTRY' END AS failure FROM n WHERE q <> 1)"""


@query("journal_audit", f"WITH {AUDIT} SELECT journal_id, sequence, failure FROM audit")
def journal_audit(spark, sf):
    return JO.audit_journal(journal_lines(spark, sf)).select("journal_id", "sequence", "failure")


@query("journal_summary", f"""WITH {AUDIT},
b AS (SELECT journal_id, count(*) AS entries, max(sequence) AS last_sequence, min(sequence) FILTER (WHERE failure IS NOT NULL) AS first_bad_sequence FROM audit GROUP BY 1)
SELECT b.*, a.failure, first_bad_sequence IS NULL AS intact FROM b LEFT JOIN audit a ON a.journal_id = b.journal_id AND a.sequence = b.first_bad_sequence""")
def journal_summary(spark, sf):
    return JO.journal_summary(JO.audit_journal(journal_lines(spark, sf)))


META = DatasetMetadata("hourly-events", "events", "research_grade", "1")


@query("dataset_fingerprint", """WITH t AS (
  SELECT sha256('{"event_type":"' || event_type || '","event_id":' || event_id || ',"user_id":' || user_id || ',"micros":' || epoch_us(ts)
    || ',"cents":' || CAST(round(value*100) AS BIGINT) || '}') AS h FROM events),
s AS (SELECT count(*) AS rows, sum(CAST('0x' || substr(h, 1, 14) AS BIGINT)) AS a, sum(CAST('0x' || substr(h, 15, 14) AS BIGINT)) AS b FROM t)
SELECT sha256('""" + META.stable_json() + """|[["event_type","string"],["event_id","bigint"],["user_id","bigint"],["micros","bigint"],["cents","bigint"]]|'
  || rows || '|' || a || '|' || b) AS fingerprint, rows FROM s""")
def fingerprint(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_type", "event_id", "user_id", F.unix_micros(c("ts").cast("timestamp")).alias("micros"),
        F.round(c("value") * 100).cast("bigint").alias("cents"))
    return dataset_fingerprint(rows, META)


# --- row rules -------------------------------------------------------------------------------------


def reason_counts(df, rules):
    return df.groupBy(F.array_join(rules, ",").alias("reasons")).agg(F.count(F.lit(1)).alias("rows"))


def sql_reason_counts(rules: dict[str, str], source: str) -> str:
    cases = ", ".join(f"CASE WHEN {cond} THEN '{code}' END" for code, cond in rules.items())
    return f"SELECT concat_ws(',', {cases}) AS reasons, count(*) AS rows FROM {source} GROUP BY 1"


@query("table_rules_bars", """WITH b AS (SELECT l_partkey, l_shipdate, l_extendedprice - 5000 AS close, l_quantity - 2 AS volume FROM lineitem)
SELECT 'CLOSE_NOT_POSITIVE' AS rule, count(*) AS rows FROM b WHERE close <= 0 HAVING count(*) > 0
UNION ALL SELECT 'VOLUME_NEGATIVE', count(*) FROM b WHERE volume < 0 HAVING count(*) > 0
UNION ALL SELECT 'DUPLICATE_KEY', CAST(sum(n) AS BIGINT) FROM (SELECT count(*) AS n FROM b GROUP BY l_partkey, l_shipdate HAVING count(*) > 1) HAVING sum(n) > 0""")
def table_rules_bars(spark, sf):
    close = c("l_extendedprice") - 5000
    return QU.bar_violations(table(spark, sf, "lineitem").select(
        c("l_partkey").alias("symbol"), c("l_shipdate").alias("ts"), close.alias("open"), close.alias("high"),
        close.alias("low"), close.alias("close"), (c("l_quantity") - 2).alias("volume")))


@query("table_rules_in_passing", """WITH b AS (SELECT l_partkey, l_shipdate, l_extendedprice - 5000 AS close, l_quantity - 2 AS volume FROM lineitem)
SELECT count(*) AS n, count_if(close <= 0) AS close_not_positive, count_if(volume < 0) AS volume_negative,
  (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM b GROUP BY l_partkey, l_shipdate HAVING count(*) > 1)) AS duplicate_key FROM b""")
def table_rules_in_passing(spark, sf):
    """The rules as the job that stores the features sees them."""
    close, audit = c("l_extendedprice") - 5000, BarAudit()
    bars = table(spark, sf, "lineitem").select(
        c("l_partkey").alias("symbol"), c("l_shipdate").alias("ts"), close.alias("high"), close.alias("low"), close.alias("close"), (c("l_quantity") - 2).alias("volume"))
    features, broken = interim(technical_features(bars, audit=audit)), audit.violations()
    return features.agg(F.count(F.lit(1)).alias("n"), *[F.lit(broken.get(rule, 0)).cast("bigint").alias(rule.lower()) for rule in RULES[1:]])


@query("row_rules_bars", sql_reason_counts({
    "INVALID_PRICE": "l_extendedprice - 5000 <= 0",
    "HIGH_INCONSISTENT": "(l_extendedprice - 5000)*(0.95e0 + l_discount) < l_extendedprice - 5000",
    "LOW_INCONSISTENT": "l_extendedprice - 5000 > (l_extendedprice - 5000)*(0.95e0 + l_discount)",
    "INVALID_VOLUME": "l_quantity - 2 < 0"}, "lineitem").replace(
        "l_extendedprice - 5000 <= 0", "(l_extendedprice - 5000 <= 0 OR (l_extendedprice - 5000)*(0.95e0 + l_discount) <= 0)"))
def row_rules_bars(spark, sf):
    close = c("l_extendedprice") - 5000
    return reason_counts(table(spark, sf, "lineitem").select(
        c("l_partkey").cast("string").alias("symbol"), c("l_shipdate").alias("ts"), close.alias("open"),
        (close * (0.95 + c("l_discount"))).alias("high"), close.alias("low"), close.alias("close"),
        (c("l_quantity") - 2).alias("volume")), QU.bar_rules())


@query("row_rules_quotes", sql_reason_counts({
    "PRICE_NOT_POSITIVE": "l_extendedprice - 3000 <= 0 OR (l_extendedprice - 3000)*(0.95e0 + l_tax) <= 0",
    "CROSSED_QUOTE": "(l_extendedprice - 3000)*(0.95e0 + l_tax) < l_extendedprice - 3000"}, "lineitem"))
def row_rules_quotes(spark, sf):
    bid = c("l_extendedprice") - 3000
    return reason_counts(table(spark, sf, "lineitem").select(
        c("l_partkey").cast("string").alias("symbol"), bid.alias("bid"), (bid * (0.95 + c("l_tax"))).alias("ask"),
        c("l_shipdate").alias("ts")), QU.quote_rules())


@query("row_rules_specs", sql_reason_counts({
    "TICK_SIZE": "p_retailprice - 1000 <= 0", "VOLUME_MIN": "p_size - 5 <= 0", "VOLUME_RANGE": "10 < p_size - 5"}, "part"))
def row_rules_specs(spark, sf):
    return reason_counts(table(spark, sf, "part").select(
        c("p_name").alias("symbol"), (c("p_retailprice") - 1000).alias("tick_size"), F.lit(0.0).alias("tick_value"),
        (c("p_size") - 5.0).alias("volume_min"), F.lit(10.0).alias("volume_max"), F.lit(1.0).alias("volume_step"),
    ), QU.spec_rules())


@query("row_rules_accounts", sql_reason_counts({
    "NEGATIVE_BALANCE": "c_acctbal + 100 < 0", "EQUITY_NOT_POSITIVE": "c_acctbal <= 0", "NEGATIVE_FREE_MARGIN": "c_acctbal - 500 < 0",
    "STALE_ACCOUNT": "c_nationkey*10 > 120", "INVALID_EQUITY": "c_acctbal <= 0", "INVALID_FREE_MARGIN": "c_acctbal - 500 < 0"}, "customer"))
def row_rules_accounts(spark, sf):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    rows = table(spark, sf, "customer").select(
        (c("c_acctbal") + 100).alias("balance"), c("c_acctbal").alias("equity"), (c("c_acctbal") - 500).alias("free_margin"),
        F.lit("USD").alias("currency"), now.alias("now"), (now - F.make_dt_interval(secs=c("c_nationkey") * 10)).alias("ts"))
    return reason_counts(rows, F.concat(QU.account_rules(), QU.live_account_rules("now")))


@query("row_rules_plans", f"WITH {PLANS} " + sql_reason_counts({
    "EXPECTED_COST": "expected_cost - 0.002e0 < 0", "CONFIDENCE_RANGE": "confidence + 0.05e0 > 1",
    "RISK_FRACTION": "risk_fraction - 0.001e0 <= 0", "NOTIONAL_FRACTION": "notional_fraction - 0.2e0 <= 0"}, "plans"))
def row_rules_plans(spark, sf):
    rows = plans(spark, sf).withColumns({
        "expected_cost": c("expected_cost") - 0.002, "confidence": c("confidence") + 0.05,
        "risk_fraction": c("risk_fraction") - 0.001, "notional_fraction": c("notional_fraction") - 0.2})
    return reason_counts(rows, F.concat(QU.opportunity_rules(), QU.plan_rules("shadow")))


ORDER_WORDS = r"\b(execute|place|send)\s+(a\s+)?(live\s+)?(order|trade)\b|\b(buy|sell)\s+[A-Z]{1,6}\s+now\b"


@query("text_guard", f"""WITH t AS (
  SELECT 'documents' AS origin, text FROM documents UNION ALL SELECT 'conversations', text FROM conversations),
u AS (SELECT origin, text FROM t UNION ALL SELECT origin || '+order', text || ' then Place a live ORDER' FROM t)
SELECT origin, concat_ws(',', CASE WHEN length(text) < 5 THEN 'HYPOTHESIS_TOO_SHORT' END,
   CASE WHEN regexp_matches(text, '{ORDER_WORDS}', 'i') THEN 'DIRECT_ORDER' END) AS reasons, count(*) AS rows FROM u GROUP BY 1, 2""")
def text_guard(spark, sf):
    """Whole texts through the hypothesis rules, plain and with an order instruction appended."""
    docs = table(spark, sf, "documents").select(F.lit("documents").alias("origin"), "text")
    both = docs.unionByName(table(spark, sf, "conversations").select(F.lit("conversations").alias("origin"), "text"))
    ordered = both.select(F.concat("origin", F.lit("+order")).alias("origin"),
                          F.concat("text", F.lit(" then Place a live ORDER")).alias("text"))
    one = F.array(F.lit("known"))
    rows = both.unionByName(ordered).select(
        "origin", c("text").alias("hypothesis"), F.lit("unchanged").alias("proposed_change"), one.alias("evidence"),
        one.alias("validation_plan"), one.alias("invalidation_criteria"))
    return rows.groupBy("origin", F.array_join(QU.hypothesis_rules(), ",").alias("reasons")).agg(F.count(F.lit(1)).alias("rows"))


@query("as_of_bars", f"WITH {sql.BARS} SELECT symbol, count(*) AS bars FROM bars WHERE ts + INTERVAL 2 HOUR <= TIMESTAMP '2024-01-15' GROUP BY 1")
def as_of_bars(spark, sf):
    rows = bars(spark, sf).withColumn("available_time", c("ts") + F.expr("INTERVAL 2 HOURS"))
    return QU.as_of(rows, "2024-01-15 00:00:00").groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"))


@query("cost_and_id_functions", """SELECT concat_ws(':', 'live-v1', l_partkey, CAST(epoch(l_shipdate) AS BIGINT)) AS decision_id, l_orderkey, l_linenumber, l_suppkey,
  concat_ws(':', l_orderkey, 'OPEN') AS event_id,
  round(abs(l_extendedprice)*abs(l_discount)*3.0e0/10000.0e0, 8) + 0.0 AS cost,
  round(greatest(0.0e0, least(1.0e0, 0.5e0 + (l_discount - l_tax)*10.0e0)), 8) + 0.0 AS signal_score FROM lineitem""")
def cost_and_id_functions(spark, sf):
    return table(spark, sf, "lineitem").select(
        PR.decision_id("live-v1", c("l_partkey").cast("string"), c("l_shipdate").cast("timestamp")).alias("decision_id"),
        "l_orderkey", "l_linenumber", "l_suppkey",
        PR.event_id(c("l_orderkey").cast("string"), "OPEN").alias("event_id"),
        r(PR.CostModel().estimate("l_extendedprice", "l_discount")).alias("cost"),
        r(PR.signal_score(c("l_discount") - c("l_tax"))).alias("signal_score"))
