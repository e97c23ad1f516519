"""Declared schemas; nothing in this package infers one."""

from __future__ import annotations

BARS_DDL = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"
QUOTES_DDL = "symbol string, bid double, ask double, ts timestamp, source string"
SPECS_DDL = (
    "symbol string, tick_size double, tick_value double, volume_min double, volume_max double, "
    "volume_step double, trade_enabled boolean"
)
ACCOUNTS_DDL = (
    "account_id string, balance double, equity double, free_margin double, ts timestamp, currency string"
)
PLANS_DDL = (
    "account_id string, cycle_id string, ordinal int, decision_id string, symbol string, source string, "
    "expected_return double, expected_cost double, downside_risk double, correlation_penalty double, "
    "uncertainty double, confidence double, risk_fraction double, notional_fraction double, "
    "reward_risk double, market_regime string"
)
POSITION_DDL = (
    "decision_id string, symbol string, side string, notional_usd double, estimated_risk_usd double, "
    "quantity double, entry_price double, stop_loss double, take_profit double, opened_at timestamp"
)

# Documents as they lie in JSON: times stay text until the strict time parser has looked at them.
SNAPSHOT_DDL = (
    "account struct<balance:double,equity:double,free_margin:double,currency:string,timestamp:string>, "
    "symbols map<string, struct<"
    "quote:struct<bid:double,ask:double,timestamp:string>,"
    "spec:struct<tick_size:double,tick_value:double,volume_min:double,volume_max:double,"
    "volume_step:double,trade_enabled:boolean>,"
    "bars:array<struct<timestamp:string,open:double,high:double,low:double,close:double,volume:double>>>>"
)
DECISION_EVENT_DDL = (
    "decision_id string, timestamp string, symbol string, strategy string, regime string, "
    "signal_score double, confidence double, expected_return double, expected_cost double, "
    "expected_risk double, approved boolean, reasons array<string>, metadata string"
)
LIFECYCLE_EVENT_DDL = (
    "event_id string, decision_id string, event_type string, timestamp string, symbol string, "
    "price double, pnl_usd double, metadata string"
)
PORTFOLIO_STATE_DDL = (
    "schema_version int, base_equity_usd double, realized_pnl_usd double, equity_peak_usd double, "
    "updated_at string, positions array<struct<decision_id:string,symbol:string,side:string,"
    "notional_usd:double,estimated_risk_usd:double,quantity:double,entry_price:double,"
    "stop_loss:double,take_profit:double,opened_at:string>>"
)


def journal_ddl(event_ddl: str) -> str:
    fields = ",".join(part.strip().replace(" ", ":", 1) for part in event_ddl.split(", "))
    return f"sequence bigint, previous_hash string, entry_hash string, event struct<{fields}>"
