"""Many decision cycles per account: what a cycle opens and closes is what the next one finds.

Everything that does not depend on an account's book is settled by columns for all cycles at once: accounts and quotes as
of each cycle, duplicates, market gates, costs, net edges, ranks. What is left is a walk over each account's cycles
with its book as state. Spark deals accounts to tasks and sorts their rows; a task streams them through a
:class:`Book`, which holds open positions and four numbers. An account's decisions build on each other, so an account
is one walk, however long; its memory is its open positions.

The batch walk (:func:`run_cycles`) and the stream (:func:`marketloom.streaming.books.book_stream`) feed the same
rows to the same :class:`Book`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pricing import effective_cost, signal_score, spread_fraction
from ..functions.reasons import passes
from ..operators.asof import as_of_join, fill_forward
from ..operators.fold import ordered_fold
from ..operators.gates import SafeguardConfig
from ..operators.ledger import daily_realized_pnl
from ..operators.quality import LiveLimits, account_rules, live_account_rules, live_quote_rules, live_symbol_rules, quote_rules, spec_rules
from ..operators.ranking import RANKED_BY, OpportunityPolicy, Tie, net_edge
from ..operators.series import join_keys
from ..session import interim

c = F.col
KEYS = ["account_id", "cycle_id"]
#: Kinds of rows of a walk, in the order in which a cycle's rows are met.
STATE, DAY, POSITION, CYCLE, MARK, PLAN, END = range(7)
#: Kinds of rows that a walk gives.
DECISION, EVENT, BOOK, HELD, LAST = range(10, 15)

HELD_FIELDS = ("decision_id", "symbol", "notional_usd", "estimated_risk_usd", "quantity", "entry_price", "stop_loss", "take_profit", "opened_at")
STATE_FIELDS = ("base_equity_usd", "realized_pnl_usd", "peak_usd")
CYCLE_FIELDS = ("equity", "kill_switch", "orders_last_minute", "daily_pnl_usd", "equity_peak_usd", "day", "gate")
MARK_FIELDS = ("symbol", "bid", "quote_at", "gate")
PLAN_FIELDS = (
    "decision_id", "symbol", "gate", "ask", "quote_at", "risk_fraction", "notional_fraction", "reward_risk", "expected_return", "expected_cost")
#: What a plan keeps to be reported, untouched by the walk.
CARRIED = ("ordinal", "source", "confidence", "net_edge", "rank", "regime")
OPENED = ("quantity", "entry_price", "stop_loss", "take_profit", "notional_usd", "estimated_risk_usd")


class Book:
    """One account's open positions, equity base, realised profit, peak and realised profit per day.

    Rows of :data:`STATE` to :data:`END` come in order; ``out`` gets tuples (kind, cycle_id, fields) in the order of
    :data:`EVENTS`, :data:`BOOKS` and :data:`HELD_FIELDS`. A cycle is refreshed when its marks are known, that is before its
    first plan or after its last mark.
    """

    EVENTS = ("decision_id", "event_type", "at", "symbol", "price", "pnl_usd", "reason", *OPENED[2:])
    BOOKS = (
        "mark_issue_count", "exits", "open_risk_usd", "gross_notional_usd", "unrealized_pnl_usd", "realized_total_usd",
        "shadow_equity_usd", "equity_usd", "equity_peak_usd", "daily_pnl_usd", "gate")

    def __init__(self, limits: SafeguardConfig) -> None:
        self.limits = limits
        self.held: dict[str, list] = {}
        self.base = self.realized = self.peak = None
        self.days: dict[int, float] = {}
        self.cycle: dict | None = None
        self.fresh = True

    def start(self, base, realized, peak) -> None:
        self.base, self.realized, self.peak = base, realized or 0.0, peak if peak is not None else base

    def begin(self, cycle_id, at: int, fields: dict) -> None:
        self.cycle = {"id": cycle_id, "at": at, **fields}
        self.marks: dict[str, tuple] = {}
        self.fresh = False

    def mark(self, symbol, bid, quote_at, gate) -> None:
        self.marks[symbol] = (bid, quote_at, gate)

    def refresh(self, out: list) -> None:
        """Close what its quote lets close, value the rest, and say whether the cycle may decide."""
        if self.fresh:
            return
        self.fresh, cycle = True, self.cycle
        cycle["stop"] = cycle["gate"]
        if len(cycle["gate"]):  # an account in doubt leaves its book as it is
            out.append((BOOK, cycle["id"], (0, 0, *self._sums(), None, self.realized, None, None, self.peak, None, cycle["gate"])))
            return
        if self.base is None:
            self.start(cycle["equity"], 0.0, cycle["equity"])
        unrealized, delta, issues, exits = 0.0, 0.0, 0, 0
        for name, p in list(self.held.items()):
            bid, quote_at, gate = self.marks.get(p[0], (None, None, ()))
            if bid is None or len(gate):
                issues += 1
                continue
            gain = p[3] * (bid - p[4])
            reason = "STOP_LOSS" if bid <= p[5] else "TAKE_PROFIT" if bid >= p[6] else None
            if reason is None:
                unrealized += gain
                continue
            exits += 1
            delta += gain
            day = quote_at // 86_400_000_000
            self.days[day] = self.days.get(day, 0.0) + gain
            del self.held[name]
            out.append((EVENT, cycle["id"], (name, "CLOSE", quote_at, p[0], bid, gain, reason, None, None, None, None)))
        self.realized += delta
        shadow = self.base + self.realized + unrealized
        if not issues:
            self.peak = max(self.peak, shadow)
        self.risk, self.gross = self._sums()
        self.equity = min(cycle["equity"], shadow)
        self.top = max(self.peak, cycle["equity_peak_usd"] or 0.0, self.equity)
        self.daily = min(cycle["daily_pnl_usd"] or 0.0, self.days.get(cycle["day"], 0.0))
        cycle["stop"] = ["PORTFOLIO_MARK_UNAVAILABLE"] if issues else ["SHADOW_EQUITY_NONPOSITIVE"] if shadow <= 0.0 else []
        out.append((BOOK, cycle["id"], (
            issues, exits, self.risk, self.gross, unrealized, self.realized, shadow, self.equity, self.peak, self.daily, cycle["stop"])))

    def _sums(self) -> tuple[float, float]:
        # Added one by one, as plans that open add theirs: Python's sum() rounds otherwise (since 3.12), which decides at a limit.
        risk = gross = 0.0
        for p in self.held.values():
            risk, gross = risk + p[2], gross + p[1]
        return risk, gross

    def decide(self, plan: dict, out: list) -> tuple:
        """Reasons, what was opened (:data:`OPENED` and the time) or nulls, and whether the plan came to its rank."""
        nothing = (None,) * (len(OPENED) + 1)
        gate = list(plan["gate"])
        if gate in (["DUPLICATE_DECISION_ID"], ["ACCOUNT_DATA_UNAVAILABLE"]):
            return (gate, *nothing, False)
        if self.cycle["stop"] is not None and len(self.cycle["stop"]):
            return (list(self.cycle["stop"]), *nothing, False)
        if gate:
            return (gate, *nothing, False)
        risk, notional = self.equity * plan["risk_fraction"], self.equity * plan["notional_fraction"]
        reasons = self._reasons(risk, notional, plan)
        if reasons:
            return (reasons, *nothing, True)
        entry, reward = plan["ask"], plan["reward_risk"]
        if not (0.0 < risk < notional and 0.0 < reward < float("inf")):
            return (["SHADOW_PERSISTENCE_FAILED"], *nothing, True)
        share = risk / notional
        opened = (notional / entry, entry, entry * (1.0 - share), entry * (1.0 + reward * share), notional, risk)
        self.held[plan["decision_id"]] = [plan["symbol"], notional, risk, *opened[:4], plan["quote_at"]]
        self.risk, self.gross = self.risk + risk, self.gross + notional
        out.append((EVENT, self.cycle["id"], (plan["decision_id"], "OPEN", plan["quote_at"], plan["symbol"], entry, 0.0, None, *opened[2:])))
        return ([], *opened, plan["quote_at"], True)

    def _reasons(self, risk: float, notional: float, plan: dict) -> list[str]:
        limits, cycle = self.limits, self.cycle
        equity = max(self.equity, 1e-12)
        gain, cost = plan["expected_return"] * notional, plan["expected_cost"] * notional
        age = max(0.0, (cycle["at"] - plan["quote_at"]) / 1e6)
        rules = (
            (cycle["kill_switch"], "KILL_SWITCH"),
            (age > limits.max_data_age_seconds, "STALE_DATA"),
            (cycle["orders_last_minute"] >= limits.max_orders_per_minute, "ORDER_RATE_LIMIT"),
            (risk / equity > limits.max_order_risk_pct, "ORDER_RISK_LIMIT"),
            ((self.risk + risk) / equity > limits.max_total_open_risk_pct, "TOTAL_OPEN_RISK_LIMIT"),
            (max(0.0, -self.daily / equity) >= limits.max_daily_loss_pct, "DAILY_LOSS_LIMIT"),
            (max(0.0, 1.0 - equity / max(self.top, equity)) >= limits.max_drawdown_pct, "MAX_DRAWDOWN"),
            ((self.gross + notional) / equity > limits.max_gross_notional_multiple, "GROSS_EXPOSURE_LIMIT"),
            (gain - cost <= limits.minimum_net_edge_usd, "NO_POSITIVE_NET_EDGE"),
            (gain > 0.0 and cost >= gain, "COST_CONSUMES_EDGE"),
        )
        return [code for broken, code in rules if broken]

    def feed(self, columns: dict[str, list], first: int, last: int, made: list, plans: list[int], results: list[tuple]) -> None:
        """Walk rows ``first`` to ``last`` of one account; what they give is appended, with the row it is given at."""
        def fields(names, i):
            return [None if isinstance(v := columns[x][i], float) and v != v else v for x in names]

        out: list[tuple] = []
        for i in range(first, last):
            kind = columns["kind"][i]
            if kind == PLAN:
                self.refresh(out)
                plans.append(i)
                results.append(self.decide(dict(zip(PLAN_FIELDS, fields(PLAN_FIELDS, i))), out))
            elif kind == MARK:
                self.mark(*fields(MARK_FIELDS, i))
            elif kind == CYCLE:
                self.refresh(out)
                self.begin(columns["cycle_id"][i], columns["at"][i], dict(zip(CYCLE_FIELDS, fields(CYCLE_FIELDS, i))))
            elif kind == STATE:
                self.start(*fields(STATE_FIELDS, i))
            elif kind == DAY:
                self.days[columns["day"][i]] = fields(("realized_pnl_usd",), i)[0] or 0.0
            elif kind == POSITION:
                name, *rest = fields(HELD_FIELDS, i)
                self.held[name] = rest
            else:
                self.refresh(out)
                out += [(HELD, None, (name, *p)) for name, p in self.held.items()]
                out.append((LAST, None, (self.base, self.realized, self.peak)))
            if out:
                made += [(*x, columns["account_id"][i]) for x in out]
                out.clear()


#: Columns of a batch that a walk looks at.
READ = tuple(dict.fromkeys((
    "account_id", "kind", "cycle_id", "at", *HELD_FIELDS, *STATE_FIELDS, *CYCLE_FIELDS, *MARK_FIELDS, *PLAN_FIELDS)))


def walked_table(rows: pd.DataFrame, made: list, plans: list[int], results: list[tuple]) -> pd.DataFrame:
    """What a walk over ``rows`` gave, as one table of :data:`WALKED`."""
    names = {EVENT: Book.EVENTS, BOOK: Book.BOOKS, HELD: HELD_FIELDS, LAST: ("base_equity_usd", "realized_total_usd", "equity_peak_usd")}
    parts = []
    for kind, fields in names.items():
        some = [x for x in made if x[0] == kind]
        part = pd.DataFrame([x[2] for x in some], columns=list(fields), dtype=object)
        parts.append(part.assign(kind=kind, cycle_id=[x[1] for x in some], account_id=[x[3] for x in some]))
    decided = rows.iloc[plans][["account_id", "cycle_id", "decision_id", "symbol", "expected_return", "expected_cost", "risk_fraction", *CARRIED]]
    found = pd.DataFrame(results, columns=["gate", *OPENED, "opened_at", "ranked"], dtype=object)
    decided = decided.reset_index(drop=True).astype(object).assign(kind=DECISION, **{x: found[x] for x in found})
    parts.append(decided.assign(rank=decided["rank"].where(decided["ranked"].astype(bool))))
    columns = ["account_id", *WALKED]
    out = pd.concat([p.reindex(columns=columns).astype(object) for p in parts if len(p)] or [pd.DataFrame(columns=columns, dtype=object)], ignore_index=True)
    out = out.where(out.notna(), None)
    for x in ("at", "opened_at", "rank", "mark_issue_count", "exits"):  # nullable whole numbers come as floats
        out[x] = pd.Series([None if v is None else int(v) for v in out[x]], dtype=object)
    return out


WALK_TYPES = {
    "kind": "int", "cycle_id": "string", "decision_id": "string", "symbol": "string", "event_type": "string", "reason": "string", "at": "bigint",
    "gate": "array<string>", "ordinal": "string", "rank": "bigint", "source": "string", "regime": "string", "mark_issue_count": "bigint",
    "exits": "bigint", "opened_at": "bigint", **{x: "double" for x in (
        "price", "pnl_usd", *OPENED, *Book.BOOKS[2:10], "base_equity_usd", "expected_return", "expected_cost", "risk_fraction", "confidence",
        "net_edge")},
}
WALKED = list(WALK_TYPES)
ROW_TYPES = {
    "cycle_id": "string", "at": "bigint", "kind": "int", "seq": "bigint", "decision_id": "string", "symbol": "string", "source": "string",
    "regime": "string", "gate": "array<string>", "kill_switch": "boolean", "orders_last_minute": "int", "day": "bigint", "quote_at": "bigint",
    "opened_at": "bigint", "ordinal": "string", "rank": "bigint", **{x: "double" for x in (
        *HELD_FIELDS[2:8], *STATE_FIELDS, "equity", "daily_pnl_usd", "equity_peak_usd", "bid", "ask", "risk_fraction", "notional_fraction",
        "reward_risk", "expected_return", "expected_cost", "confidence", "net_edge")},
}
ORDER = ["at", "cycle_id", "kind", "seq"]
FIRST, LATEST = -(2**63), 2**63 - 1


def walk_rows(
    cycles: DataFrame, accounts: DataFrame, quotes: DataFrame, specs: DataFrame, plans: DataFrame, positions: DataFrame | None = None,
    states: DataFrame | None = None, history: DataFrame | None = None, journal: DataFrame | None = None,
    policy: OpportunityPolicy = OpportunityPolicy(), limits: LiveLimits = LiveLimits(), tie: Tie = Tie(), quote_tie: str | None = None,
    last: bool = True,
) -> DataFrame:
    """The rows that an account's :class:`Book` walks through, dealt by account; see :func:`run_cycles` for the tables.

    Plans are shuffled by account to meet their cycle and their duplicates, by symbol to meet their quote and specification
    (where they are stored), and by account to be ranked and walked. Symbols are marked only where a position may be open.
    """
    sound = accounts.withColumn("sound", passes(account_rules())).withColumn("account_ts", c("ts"))
    cyc = as_of_join(
        cycles.select(*KEYS, "ts", "regime", "equity_peak_usd", "daily_pnl_usd", "orders_last_minute", "kill_switch"), sound, ("account_id",),
        available="ts", values=("balance", "equity", "free_margin", "account_ts", "sound"))
    doubt = F.when(F.coalesce("sound", F.lit(False)), live_account_rules("ts", limits, "account_ts")).otherwise(F.array(F.lit("ACCOUNT_DATA_UNAVAILABLE")))
    along = Window.partitionBy("account_id").orderBy("ts", "cycle_id")
    cyc = cyc.withColumn("gate", doubt).withColumn("moment", F.struct("ts", "cycle_id", (F.size("gate") == 0).alias("free")))
    cyc = interim(cyc.withColumns({"after": F.lead("moment").over(along), "first": F.row_number().over(along) == 1}).drop(
        "balance", "free_margin", "account_ts", "sound"))

    # A plan's cycle comes first of its (account, cycle); both windows lie within an account, which is one task of the walk too.
    beside = cyc.select(*KEYS, F.struct(
        c("ts").alias("now"), c("regime").alias("cycle_regime"), c("gate").alias("doubt"), c("kill_switch").alias("kill"), "after").alias("_cycle"))
    own = plans.withColumn("_plan", F.lit(True)).unionByName(beside, allowMissingColumns=True).repartition("account_id")
    inside = Window.partitionBy(*KEYS).orderBy(c("_plan").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("_cycle", F.first("_cycle", True).over(inside)).where("_plan").select(*plans.columns, "_cycle.*")
    uses = Window.partitionBy("account_id", "decision_id").orderBy(c("now").isNull(), "now", "cycle_id", tie.column)
    own = own.withColumn("duplicate", F.rank().over(uses) > 1)
    if journal is not None:
        seen = journal.select("account_id", "decision_id").distinct().withColumn("_seen", F.lit(True))
        own = join_keys(own, seen, ["account_id", "decision_id"], "left")
        own = own.withColumn("duplicate", c("duplicate") | F.coalesce("_seen", F.lit(False))).drop("_seen")

    # Per symbol: the specification, which holds at any time, then quotes and plans in order of time.
    seen = quotes.withColumn("sound", passes(quote_rules())).select(
        "symbol", c("ts").alias("_at"), F.lit(1).alias("_kind"), F.struct("bid", "ask", c("ts").alias("quote_ts"), "sound").alias("_quote"),
        (c(quote_tie) if quote_tie else F.struct("bid", "ask")).alias("_tie"))
    spec = specs.where(passes(spec_rules())).select("symbol", F.lit(0).alias("_kind"), F.struct(live_symbol_rules().alias("off")).alias("_spec"))
    wanted = dict.fromkeys((
        *KEYS, "now", "after", "kill", "doubt", "duplicate", "cycle_regime", "market_regime", *[x for x in PLAN_FIELDS if x in plans.columns],
        *[x for x in CARRIED if x in plans.columns], tie.column, "downside_risk", "correlation_penalty", "uncertainty"))
    asked = own.select(*wanted, c("now").alias("_at"), F.lit(2).alias("_kind"))
    both = asked.unionByName(seen, allowMissingColumns=True).unionByName(spec, allowMissingColumns=True).withColumn("_plan", c("_kind") == 2)
    rows = fill_forward(both, ["symbol"], ("_at", "_kind", "_tie"), ("_quote", "_spec"), "_plan", spread=("account_id", tie.column))
    rows = rows.withColumns({x: F.when(c("_quote.sound"), c(f"_quote.{x}")) for x in ("bid", "ask", "quote_ts")})
    none = F.array().cast("array<string>")
    market = F.when(c("bid").isNull() | c("_spec").isNull(), F.array(F.lit("MARKET_DATA_UNAVAILABLE"))).otherwise(
        F.concat(live_quote_rules("now", limits, "quote_ts"), c("_spec.off")))
    rows = rows.withColumn("gate", F.when(c("duplicate"), F.array(F.lit("DUPLICATE_DECISION_ID"))).when(
        c("now").isNull(), F.array(F.lit("ACCOUNT_DATA_UNAVAILABLE"))).when(F.size("doubt") > 0, c("doubt")).when(F.size(market) > 0, market))
    rows = rows.withColumn("regime", F.coalesce("market_regime", "cycle_regime"))
    priced = F.when(c("gate").isNull(), effective_cost("expected_cost", spread_fraction())).otherwise(c("expected_cost"))
    rows = rows.withColumn("expected_cost", priced).withColumn("net_edge", net_edge(policy))
    below = c("gate").isNull() & ~F.coalesce(c("net_edge") > policy.minimum_net_edge, F.lit(False))
    few = F.array(F.lit("BELOW_MINIMUM_NET_EDGE"))
    rows = rows.withColumn("gate", F.when(below, few).otherwise(c("gate")))

    moment = F.unix_micros("ts")
    marks = _marks(cyc, rows, positions, seen, limits)
    parts = [
        cyc.select(*KEYS, moment.alias("at"), F.lit(CYCLE).alias("kind"), F.unix_date(F.to_date("ts")).alias("day"), "equity", "kill_switch",
                   F.coalesce("orders_last_minute", F.lit(0)).alias("orders_last_minute"), "daily_pnl_usd", "equity_peak_usd", "gate"),
        marks.select(*KEYS, moment.alias("at"), F.lit(MARK).alias("kind"), "symbol", "bid", F.unix_micros("quote_ts").alias("quote_at"), none.alias("gate")),
        rows.select(*dict.fromkeys((*KEYS, *[x for x in PLAN_FIELDS if x != "quote_at"], *[x for x in CARRIED if x != "rank"], tie.column)),
                    F.coalesce(F.unix_micros("now"), F.lit(LATEST)).alias("at"), F.lit(PLAN).alias("kind"), F.unix_micros("quote_ts").alias("quote_at")),
    ]
    names = cyc.select("account_id").unionByName(rows.select("account_id"))
    if states is not None:
        parts.append(states.select("account_id", F.lit(FIRST).alias("at"), F.lit(STATE).alias("kind"), "base_equity_usd", "realized_pnl_usd",
                                   c("equity_peak_usd").alias("peak_usd")))
        names = names.unionByName(states.select("account_id"))
    if history is not None:
        parts.append(daily_realized_pnl(history, ["account_id"]).select(
            "account_id", F.lit(FIRST).alias("at"), F.lit(DAY).alias("kind"), F.unix_date("day").alias("day"), "realized_pnl_usd"))
    if positions is not None:
        parts.append(positions.select("account_id", F.lit(FIRST).alias("at"), F.lit(POSITION).alias("kind"), F.unix_micros("opened_at").alias("seq"),
                                      *HELD_FIELDS[:-1], F.unix_micros("opened_at").alias("opened_at")))
        names = names.unionByName(positions.select("account_id"))
    if last:
        parts.append(names.distinct().select("account_id", F.lit(LATEST).alias("at"), F.lit(END).alias("kind")))
    tied = {"_tie": rows.schema[tie.column].dataType.simpleString()}
    types = {"account_id": cycles.schema["account_id"].dataType.simpleString(), **ROW_TYPES}
    parts[2] = parts[2].withColumn("_tie", c(tie.column))

    def shaped(part: DataFrame) -> DataFrame:
        return part.select(*[(c(x) if x in part.columns else F.lit(None)).cast(t).alias(x) for x, t in (types | tied).items()])

    out = shaped(parts[0])
    for part in parts[1:]:
        out = out.unionByName(shaped(part))
    free = (c("kind") == PLAN) & c("gate").isNull()
    ranks = Window.partitionBy(*KEYS, "kind", c("gate").isNull()).orderBy(*[F.desc(x) for x in RANKED_BY], F.asc("_tie"))
    out = out.repartition("account_id").withColumn("rank", F.when(free, F.row_number().over(ranks)).cast("bigint"))
    over = c("rank") > policy.max_opportunities if policy.max_opportunities else F.lit(False)
    return out.withColumns({
        "seq": F.when(c("kind") == PLAN, c("rank")).otherwise(c("seq")), "gate": F.when(free, F.when(over, few).otherwise(none)).otherwise(c("gate")),
    }).select(*types)


#: By how much of its price a barrier known before the walk may differ from the one that the walk computes.
SLACK = 1e-12


def _marks(cyc: DataFrame, rows: DataFrame, positions: DataFrame | None, seen: DataFrame, limits: LiveLimits) -> DataFrame:
    """Quotes of symbols in the cycles in which a position may be open; no row where there is none to be used.

    A plan that no gate stops may open a position, whose barriers are known but for rounding. It is marked in the cycle after;
    where the quote there closes it for sure it needs no more. What may stay open is marked in all later cycles.
    """
    share = c("risk_fraction") / c("notional_fraction")
    held = rows.where(c("gate").isNull() & c("after").isNotNull() & ~F.coalesce("kill", F.lit(False))).select(
        "account_id", "symbol", "after.*", (c("ask") * (1 - share - SLACK)).alias("low"), (c("ask") * (1 + c("reward_risk") * share) * (1 + SLACK)).alias("high"))
    if positions is not None:
        first = cyc.where("first").select("account_id", "moment.*")
        held = held.unionByName(join_keys(positions.select("account_id", "symbol", c("stop_loss").alias("low"), c("take_profit").alias("high")), first, ["account_id"]))

    def quoted(asked: DataFrame) -> DataFrame:
        asked = asked.where("ts IS NOT NULL").withColumns({"_at": c("ts"), "_kind": F.lit(2)})
        both = asked.unionByName(seen, allowMissingColumns=True).withColumn("_ask", c("_kind") == 2)
        known = fill_forward(both, ["symbol"], ("_at", "_kind", "_tie"), ("_quote",), "_ask", spread=("account_id",))
        known = known.select(*asked.drop("_at", "_kind").columns, "_quote.*")
        usable = F.coalesce(c("sound") & (F.size(live_quote_rules("ts", limits, "quote_ts")) == 0), F.lit(False))
        return known.withColumn("usable", usable)

    next_ones = quoted(held)
    closed = c("usable") & c("free") & ((c("bid") <= c("low")) | (c("bid") >= c("high")))
    since = next_ones.where(~F.coalesce(closed, F.lit(False))).groupBy("account_id", "symbol").agg(F.min(F.struct("ts", "cycle_id")).alias("since"))
    later = join_keys(since, cyc.select(*KEYS, "ts"), ["account_id"]).where(F.struct("ts", "cycle_id") > c("since"))
    marked = [x.where("usable").select(*KEYS, "ts", "symbol", "bid", "quote_ts") for x in (next_ones, quoted(later.select(*KEYS, "ts", "symbol")))]
    return marked[0].unionByName(marked[1])


def walker(safeguard: SafeguardConfig) -> Callable:
    """Step of an ordered fold: one book at a time, kept from batch to batch of one account."""
    def make_step():
        book = Book(safeguard)

        def step(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
            nonlocal book
            columns = {x: pdf[x].tolist() for x in READ}
            made, plans, results = [], [], []
            cuts = np.flatnonzero(starts)
            for first, last in zip(np.r_[0, cuts], np.r_[cuts, len(pdf)]):
                if last > first:
                    if starts[first]:
                        book = Book(safeguard)
                    book.feed(columns, int(first), int(last), made, plans, results)
            return walked_table(pdf, made, plans, results)

        return step

    return make_step


@dataclass(frozen=True)
class CycleRun:
    """Tables of a run: decisions, OPEN and CLOSE events, one book per cycle, and what the next run starts from."""

    decisions: DataFrame
    events: DataFrame
    books: DataFrame
    positions: DataFrame
    states: DataFrame


def split_walk(walked: DataFrame) -> CycleRun:
    def part(kind: int) -> DataFrame:
        return walked.where(c("kind") == kind)

    at = F.timestamp_micros("at").alias("ts")
    opened = F.timestamp_micros("opened_at").alias("opened_at")
    detail = F.when(c("event_type") == "CLOSE", F.to_json(F.struct("reason"))).otherwise(
        F.to_json(F.struct("stop_loss", "take_profit", "notional_usd", "estimated_risk_usd")))
    return CycleRun(
        decisions=part(DECISION).select(
            *KEYS, c("ordinal").cast("bigint").alias("ordinal"), "decision_id", "symbol", (F.size("gate") == 0).alias("approved"), c("gate").alias("reasons"), "rank", "net_edge",
            "expected_cost", signal_score("expected_return").alias("signal_score"), "source", "confidence", "expected_return", "risk_fraction",
            "regime", opened, *OPENED),
        events=part(EVENT).select(
            *KEYS, F.concat_ws(":", "decision_id", "event_type").alias("event_id"), "decision_id", "event_type", at, "symbol", "price", "pnl_usd",
            detail.alias("metadata")),
        books=part(BOOK).select(*KEYS, *Book.BOOKS[:-1], c("gate").alias("cycle_reasons")),
        positions=part(HELD).select("account_id", *HELD_FIELDS[:-1], opened),
        states=part(LAST).where("base_equity_usd IS NOT NULL").select(
            "account_id", "base_equity_usd", c("realized_total_usd").alias("realized_pnl_usd"), "equity_peak_usd"),
    )


def run_cycles(
    cycles: DataFrame, accounts: DataFrame, quotes: DataFrame, specs: DataFrame, plans: DataFrame, positions: DataFrame | None = None,
    states: DataFrame | None = None, history: DataFrame | None = None, journal: DataFrame | None = None,
    policy: OpportunityPolicy = OpportunityPolicy(), safeguard: SafeguardConfig = SafeguardConfig(), limits: LiveLimits = LiveLimits(),
    tie: Tie = Tie(), quote_tie: str | None = None,
) -> CycleRun:
    """Run every account's cycles in order of (ts, cycle_id).

    ``cycles``: account_id, cycle_id (unique per account), ts, regime, equity_peak_usd, daily_pnl_usd, orders_last_minute,
    kill_switch; ``accounts``: snapshots, several per account; ``quotes``: several per symbol (``quote_tie`` orders equal
    times). A cycle sees the last snapshot and the last quotes at or before its time; where the last one is no valid one, it
    counts as unavailable. ``positions``, ``states``, ``history`` (events) and ``journal`` (decision ids) are what an earlier
    run left; accounts without a cycle keep theirs. Plans without a cycle are refused. Null ids, symbols and sources lose no
    row: a null decision id is an id like any other, a null symbol has no market.
    """
    rows = walk_rows(cycles, accounts, quotes, specs, plans, positions, states, history, journal, policy, limits, tie, quote_tie)
    types = {"account_id": rows.schema["account_id"].dataType.simpleString(), **WALK_TYPES}
    ddl = ", ".join(f"{x} {t}" for x, t in types.items())
    return split_walk(interim(ordered_fold(rows, ["account_id"], ORDER, walker(safeguard), ddl, dealt=True)))
