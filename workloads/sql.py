"""SQL fragments (common table expressions) shared by the oracle queries."""

BARS = """
cents AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS ts,
         CAST(sum(CAST(round(value*100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS volume
  FROM events GROUP BY 1, 2),
priced AS (
  SELECT symbol, ts, CAST(volume AS DOUBLE) AS volume,
         100*exp(sum((cents - 5000.0e0*volume)/(200000.0e0*volume))
                 OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS close
  FROM cents),
opened AS (
  SELECT *, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY ts), close) AS open FROM priced),
bars AS (
  SELECT symbol, ts, open, greatest(open, close)*1.001e0 AS high, least(open, close)*0.999e0 AS low,
         close, volume FROM opened)"""

DAILY = """
cents AS (
  SELECT c_mktsegment AS symbol, o_orderdate AS ts,
         CAST(sum(CAST(round(o_totalprice*100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS volume
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
priced AS (
  SELECT symbol, ts, CAST(volume AS DOUBLE) AS volume,
         100*exp(sum((cents - 25000000.0e0*volume)/(1000000000.0e0*volume))
                 OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS close
  FROM cents),
opened AS (
  SELECT *, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY ts), close) AS open FROM priced),
bars AS (
  SELECT symbol, ts, open, greatest(open, close)*1.001e0 AS high, least(open, close)*0.999e0 AS low,
         close, volume FROM opened)"""

FEATURES = """
lagged AS (
  SELECT *, close/lag(close) OVER w - 1 AS return_1, close/lag(close, 5) OVER w - 1 AS momentum_5,
         close/lag(close, 20) OVER w - 1 AS momentum_20
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
features AS (
  SELECT *,
    CASE WHEN count(close) OVER w20 = 20 THEN close/avg(close) OVER w20 - 1 END AS sma_20_dist,
    CASE WHEN count(return_1) OVER w20 = 20 THEN stddev_pop(return_1) OVER w20 * sqrt(252.0e0) END AS realized_vol_20,
    CASE WHEN count(volume) OVER w20 = 20
         THEN (volume - avg(volume) OVER w20)/nullif(stddev_pop(volume) OVER w20, 0) END AS volume_z_20,
    CASE WHEN count(high) OVER p20 = 20 THEN close/max(high) OVER p20 - 1 END AS breakout_20
  FROM lagged
  WINDOW w20 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
         p20 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"""

VOL = "greatest(coalesce(realized_vol_20, 0.20e0), 0.05e0)"


def sigmoid(x: str) -> str:
    return f"1.0e0/(1.0e0 + exp(-greatest(-20.0e0, least(20.0e0, {x}))))"


REGIME = """CASE WHEN coalesce(realized_vol_20, 0.20e0) >= 0.55e0
       OR (coalesce(momentum_20, 0) <= -0.04e0 AND coalesce(sma_20_dist, 0) <= -0.02e0) THEN 'bear_stress'
     WHEN coalesce(momentum_20, 0) >= 0.03e0 AND coalesce(sma_20_dist, 0) >= 0.015e0
       AND coalesce(realized_vol_20, 0.20e0) < 0.45e0 THEN 'bull_trend'
     ELSE 'neutral_chop' END"""

SIGNALS = f"""
signals AS (
  SELECT *,
    {sigmoid(f"8.0e0*((0.65e0*coalesce(momentum_20,0) + 0.35e0*coalesce(sma_20_dist,0))/{VOL})")} AS trend,
    {sigmoid(f"7.0e0*coalesce(momentum_20,0)/{VOL}")} AS momentum,
    {sigmoid(f"-5.0e0*coalesce(momentum_5,0)/{VOL}")} AS mean_reversion,
    {sigmoid(f"8.0e0*coalesce(breakout_20,0)/{VOL}")} AS breakout,
    {REGIME} AS regime
  FROM features)"""


def weight_table(table) -> str:
    rows = ", ".join(
        f"('{regime}', '{name}', {value}e0)" for regime, weights in table.items() for name, value in weights.items()
    )
    return f"weights(regime, strategy, weight) AS (VALUES {rows})"


def regime_weight(table, strategy: str, col: str = "regime") -> str:
    whens = " ".join(f"WHEN {col} = '{k}' THEN {v.get(strategy, 0.0)}e0" for k, v in table.items())
    return f"(CASE {whens} ELSE 0.0e0 END)"


def ensemble(table, strategies) -> str:
    total = " + ".join(f"{s}*{regime_weight(table, s)}" for s in strategies)
    active = " + ".join(regime_weight(table, s) for s in strategies)
    return f"greatest(0.0e0, least(1.0e0, ({total})/greatest(1.0e0, {active})))"


LONG = """
long AS (
  SELECT symbol, ts, close, 'trend' AS strategy, trend AS signal FROM signals
  UNION ALL SELECT symbol, ts, close, 'momentum', momentum FROM signals
  UNION ALL SELECT symbol, ts, close, 'mean_reversion', mean_reversion FROM signals
  UNION ALL SELECT symbol, ts, close, 'breakout', breakout FROM signals)"""

# Ungated backtest of long(symbol, ts, close, strategy, signal) with 3 bps of cost.
BACKTEST = """
bt0 AS (
  SELECT *, coalesce(close/lag(close) OVER w - 1, 0) AS asset_return,
         coalesce(lag(greatest(0.0e0, least(1.0e0, signal))) OVER w, 0.0e0) AS position
  FROM long WINDOW w AS (PARTITION BY symbol, strategy ORDER BY ts)),
bt1 AS (
  SELECT *, abs(position - coalesce(lag(position) OVER w, 0.0e0)) AS turnover
  FROM bt0 WINDOW w AS (PARTITION BY symbol, strategy ORDER BY ts)),
bt2 AS (
  SELECT *, turnover*3.0e0/10000.0e0 AS cost_rate, position*asset_return - turnover*3.0e0/10000.0e0 AS net_return
  FROM bt1),
bt3 AS (
  SELECT *, 10000.0e0*product(1.0e0 + net_return) OVER w AS equity
  FROM bt2 WINDOW w AS (PARTITION BY symbol, strategy ORDER BY ts ROWS UNBOUNDED PRECEDING)),
backtest AS (
  SELECT *, coalesce(lag(equity) OVER w, 10000.0e0)*cost_rate AS cost
  FROM bt3 WINDOW w AS (PARTITION BY symbol, strategy ORDER BY ts))"""


def metrics(rows: str, keys: str, ret: str = "net_return", bench: str | None = None) -> str:
    """CTEs metrics(keys…, 13 columns) and stability(keys…, 5 columns) over ``rows``."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    b = f"coalesce({bench}, 0.0e0)" if bench else "0.0e0"
    return f"""
m0 AS (
  SELECT {keys}, ts, coalesce({ret}, 0.0e0) AS r, {b} AS b,
         product(1.0e0 + coalesce({ret}, 0.0e0)) OVER (PARTITION BY {keys} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS wealth
  FROM {rows}),
m1 AS (
  SELECT *, 1.0e0 - wealth/nullif(max(wealth) OVER (PARTITION BY {keys} ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) AS dd
  FROM m0),
m2 AS (
  SELECT {keys}, count(*) AS n, product(1.0e0 + r) AS w, avg(r)*252 AS annual_return,
         stddev_pop(r)*sqrt(252.0e0) AS volatility,
         coalesce(stddev_pop(r) FILTER (WHERE r < 0), 0)*sqrt(252.0e0) AS down,
         greatest(0.0e0, coalesce(max(dd), 0)) AS max_drawdown, quantile_cont(r, 0.05) AS q,
         avg(CASE WHEN r > 0 THEN 1.0e0 ELSE 0.0e0 END) AS hit_rate,
         coalesce(sum(r) FILTER (WHERE r > 0), 0) AS wins, coalesce(abs(sum(r) FILTER (WHERE r < 0)), 0) AS losses,
         product(1.0e0 + b) AS bw, avg(b) AS bmean, var_pop(b) AS bvar, covar_pop(r, b) AS cov
  FROM m1 GROUP BY {keys}),
m3 AS (
  SELECT a.*, greatest(0.0e0, -coalesce((SELECT avg(r) FROM m1 b WHERE {on} AND b.r <= a.q), 0)) AS cvar_95 FROM m2 a),
m4 AS (
  SELECT *, CASE WHEN w <= 0 THEN -1.0e0 ELSE pow(w, 252.0e0/n) - 1 END AS cagr,
         CASE WHEN bw <= 0 THEN -1.0e0 ELSE pow(bw, 252.0e0/n) - 1 END AS bcagr,
         CASE WHEN bvar > 1e-12 THEN cov/bvar ELSE 0.0e0 END AS beta FROM m3),
metrics AS (
  SELECT {keys}, cagr, annual_return, volatility,
         CASE WHEN volatility > 1e-12 THEN annual_return/volatility ELSE 0.0e0 END AS sharpe,
         CASE WHEN down > 1e-12 THEN annual_return/down ELSE 0.0e0 END AS sortino, max_drawdown,
         CASE WHEN max_drawdown > 1e-12 THEN cagr/max_drawdown ELSE 0.0e0 END AS calmar, cvar_95, hit_rate,
         CASE WHEN losses > 1e-12 THEN wins/losses ELSE 0.0e0 END AS profit_factor,
         {"cagr - bcagr" if bench else "0.0e0"} AS excess_return, {"beta" if bench else "0.0e0"} AS beta,
         {"annual_return - beta*(bmean*252)" if bench else "0.0e0"} AS alpha FROM m4),
months AS (
  SELECT {keys}, date_trunc('month', ts) AS month, product(1.0e0 + coalesce({ret}, 0.0e0)) - 1 AS month_return
  FROM {rows} GROUP BY ALL),
stability AS (
  SELECT {keys}, avg(CASE WHEN month_return < 0 THEN 1.0e0 ELSE 0.0e0 END) AS negative_month_rate,
         CAST(count(*) AS DOUBLE) AS monthly_observations, min(month_return) AS worst_month,
         stddev_pop(month_return) AS monthly_return_volatility,
         coalesce(-avg(month_return) FILTER (WHERE month_return < 0), 0.0e0) AS average_loss_month
  FROM months GROUP BY {keys})"""


SCORE = """3.0e0*cagr + 1.2e0*sharpe + 0.8e0*sortino + 0.7e0*calmar + 1.0e0*excess_return
  + 1.5e0*greatest(0.0e0, least(1.0e0, robustness))
  - (4.0e0*max_drawdown + 5.0e0*cvar_95 + 0.08e0*turnover + 2.5e0*negative_month_rate + 1.5e0*average_loss_month)"""
