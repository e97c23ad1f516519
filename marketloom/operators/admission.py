"""From plans to decisions: duplicates, market data, safeguard, budget admission."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.reasons import passes, reason_codes
from ..session import interim
from .fold import GreedyLayout, greedy, state_met, walk_pieces
from .gates import ORDER_DEPENDENT, SafeguardConfig, safeguard_rules, safeguard_values
from .ranking import Tie
from .series import join_keys


def repeated(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Every row whose ``ids`` occur more than once, and no others but those that share a hash.

    What is shuffled is a hash per row, not the ids: few ids are used again as a rule.
    """
    own = F.xxhash64(*ids)
    twice = df.groupBy(own.alias("_hash")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_hash")
    return df.join(interim(twice), own == F.col("_hash"), "left_semi")


def flag_duplicates(
    plans: DataFrame,
    journal: DataFrame | None = None,
    order: Sequence[str] = ("ordinal",),
    scope: Sequence[str] = (),
    decision: str = "decision_id",
) -> DataFrame:
    """Add ``duplicate``: the id is already journalled, or an earlier plan of the batch used it.

    The first use per id is a map-side combined minimum, so many copies of one id are no burden. Ids are compared as
    one struct: a null id is an id like any other, so no row is lost, and the minimum's shuffle serves the join too.
    """
    ids = [*scope, decision]
    own = plans.withColumn("_id", F.struct(*ids))
    first = own.groupBy("_id").agg(F.min(F.struct(*order)).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    again = F.coalesce(F.struct(*order) != F.col("_first"), F.lit(False))
    out = own.join(first.drop("_n"), "_id", "left").withColumn("duplicate", again).drop("_first", "_id")
    if journal is not None:
        seen = journal.select(*ids).distinct().withColumn("_seen", F.lit(True))
        out = join_keys(out, seen, ids, "left")
        out = out.withColumn("duplicate", F.col("duplicate") | F.coalesce("_seen", F.lit(False))).drop("_seen")
    return out.select(*plans.columns, "duplicate")


def new_decisions(batch: DataFrame, journal: DataFrame, order: Sequence[str], decision: str = "decision_id") -> DataFrame:
    """Rows that may be appended to the journal: unseen ids, first use only."""
    return flag_duplicates(batch, journal, order, decision=decision).where(~F.col("duplicate")).drop("duplicate")


def with_market(plans: DataFrame, quotes: DataFrame, specs: DataFrame) -> DataFrame:
    """Attach the latest quote and the specification per symbol; ``market_missing`` marks gaps."""
    q = quotes.select("symbol", "bid", "ask", F.col("ts").alias("quote_ts")).withColumn("_q", F.lit(True))
    s = specs.withColumn("_s", F.lit(True))
    joined = plans.join(q, "symbol", "left").join(s, "symbol", "left")
    return joined.withColumn("market_missing", F.col("_q").isNull() | F.col("_s").isNull()).drop("_q", "_s")


def intents(df: DataFrame, equity: str = "equity_usd", cost: str = "expected_cost") -> DataFrame:
    """Dollar amounts of plans from equity fractions."""
    notional = F.col(equity) * F.col("notional_fraction")
    return df.withColumns({
        "estimated_risk_usd": F.col(equity) * F.col("risk_fraction"),
        "notional_usd": notional,
        "expected_gross_edge_usd": F.col("expected_return") * notional,
        "expected_cost_usd": F.col(cost) * notional,
    })


def admit(
    ranked: DataFrame,
    keys: Sequence[str],
    config: SafeguardConfig = SafeguardConfig(),
    count_orders: bool = True,
    extra_ok: str | None = None,
    fail_reason: str | None = "SHADOW_PERSISTENCE_FAILED",
    layout: GreedyLayout = GreedyLayout(),
    by: Sequence[str] | None = None,
    tie: Tie = Tie(),
    dealt: bool = False,
) -> DataFrame:
    """Walk ranked intents per cycle; accepted ones use up risk, gross and (paper) order budget.

    Input: ``rank``, the intent and state columns of :func:`gates.safeguard`, where open risk, gross
    notional and orders are the values before the cycle. Output: those columns as seen by each row, plus
    the safeguard values, ``reasons`` and ``approved``. Every rule that does not depend on order is settled
    beforehand by columns. Cycles are walked side by side in sorted pieces (:func:`fold.walk_pieces`): rows are shuffled and
    stored once. Of the few cycles that are cut by a piece's end, which a cycle of any size may be, passes drop the plans that
    no later budget can hold and walk the others in order (:func:`fold.greedy`). ``rank`` is unique per cycle.
    With ``by`` rows have no ``rank`` yet: the same pass ranks them by these columns, all descending, then by ``tie``.
    ``extra_ok`` names a boolean column a row also needs to use up budget; ``fail_reason`` is reported
    where only that is missing. Rows that are ``dealt`` by keys already are walked where they lie, a cycle in one task.
    """
    fixed = [rule for rule in safeguard_rules(config) if rule[1] not in ORDER_DEPENDENT]
    flagged = ranked.withColumn("_open", passes(reason_codes(fixed)))
    if extra_ok:
        flagged = flagged.withColumn("_open", F.col("_open") & F.col(extra_ok))
    flagged = flagged.withColumns({
        "open_risk_usd": F.col("open_risk_usd").cast("double"), "gross_notional_usd": F.col("gross_notional_usd").cast("double"),
        "orders_last_minute": F.col("orders_last_minute").cast("int"),
    })
    columns = ranked.columns if by is None else [*ranked.columns, "rank"]
    order = [F.asc("rank")] if by is None else [*[F.desc(x) for x in by], F.asc(tie.column)]

    def make_pass():
        risk = gross = orders = None
        sound = False

        def walk(batch: pa.RecordBatch, starts: np.ndarray) -> dict[str, pa.Array]:
            nonlocal risk, gross, orders, sound
            met = [], [], []
            columns = [batch.column(x).to_pylist() for x in ("_open", "equity_usd", "estimated_risk_usd", "notional_usd", *BUDGET)]
            for first, ok, equity, cost, size, risk0, gross0, orders0 in zip(starts.tolist(), *columns):
                if first:
                    risk, gross, orders = risk0, gross0, orders0
                    sound = risk is not None and gross is not None and orders is not None
                for values, value in zip(met, (risk, gross, orders)):
                    values.append(value)
                if ok and sound and cost is not None and size is not None:
                    eq = 1e-12 if equity is None else max(equity, 1e-12)
                    if (
                        orders < config.max_orders_per_minute
                        and (risk + cost) / eq <= config.max_total_open_risk_pct
                        and (gross + size) / eq <= config.max_gross_notional_multiple
                    ):
                        risk, gross = risk + cost, gross + size
                        orders += 1 if count_orders else 0
            return {x: pa.array(v, batch.schema.field(x).type) for x, v in zip(BUDGET, met)}

        return walk

    whole, cut = walk_pieces(flagged, keys, order, make_pass, "_number" if by is None else "rank", dealt)
    walked = whole.select(*columns)
    if cut is not None:
        walked = walked.unionByName(_admit_cut(interim(cut), keys, config, count_orders, layout).select(*columns))
    decided = walked.withColumns(safeguard_values()).withColumn("reasons", reason_codes(safeguard_rules(config)))
    if extra_ok and fail_reason:
        failed = passes(F.col("reasons")) & ~F.col(extra_ok)
        decided = decided.withColumn("reasons", F.when(failed, F.array(F.lit(fail_reason))).otherwise(F.col("reasons")))
    return decided.withColumn("approved", passes(F.col("reasons")))


def _admit_cut(
    stored: DataFrame, keys: Sequence[str], config: SafeguardConfig, count_orders: bool, layout: GreedyLayout
) -> DataFrame:
    """Budgets as met by the rows of cycles of any size, in passes over chunks; ``_open`` rows may use them up."""

    def make_walk():
        risk = gross = 0.0
        orders = 0

        def walk(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
            nonlocal risk, gross, orders
            equity = np.maximum(pdf["equity_usd"].to_numpy(), 1e-12).tolist()
            columns = [pdf[x].tolist() for x in ("_risk", "_size", *BUDGET)]
            at, met = [], []
            for i, (first, eq, cost, size, risk0, gross0, orders0) in enumerate(zip(starts.tolist(), equity, *columns)):
                if first:
                    risk, gross, orders = risk0, gross0, orders0
                if (
                    orders < config.max_orders_per_minute
                    and (risk + cost) / eq <= config.max_total_open_risk_pct
                    and (gross + size) / eq <= config.max_gross_notional_multiple
                ):
                    risk, gross = risk + cost, gross + size
                    orders += 1 if count_orders else 0
                    at.append(i)
                    met.append((risk, gross, orders))
            taken = pdf.iloc[at][[*keys, "rank", *BUDGET, "_back_risk", "_back_size"]]
            return taken.assign(**{x: [m[k] for m in met] for k, x in enumerate(BUDGET)})

        return walk

    # What plans of negative size could still give back to a cycle's budget; zero where there are none.
    back = {
        name: F.coalesce(F.sum(F.when(F.col("_open"), F.least(F.col(x), F.lit(0.0)))), F.lit(0.0)) * (1 + 1e-9)
        for name, x in (("_back_risk", "estimated_risk_usd"), ("_back_size", "notional_usd"))
    }
    start = interim(stored.groupBy(*keys).agg(
        *[F.min_by(x, "rank").alias(x) for x in BUDGET], *[v.alias(k) for k, v in back.items()]
    ))
    plan = stored.where("_open").select(
        *keys, "rank", F.col("estimated_risk_usd").alias("_risk"), F.col("notional_usd").alias("_size"), "equity_usd"
    )
    equity = F.greatest("equity_usd", F.lit(1e-12))
    possible = (
        (F.col("orders_last_minute") < config.max_orders_per_minute)
        & ((F.col("open_risk_usd") + F.col("_back_risk") + F.col("_risk")) / equity <= config.max_total_open_risk_pct)
        & ((F.col("gross_notional_usd") + F.col("_back_size") + F.col("_size")) / equity <= config.max_gross_notional_multiple)
    )
    accepted = greedy(plan, keys, "rank", start, possible, make_walk, layout)
    start, accepted = (x.drop("_back_risk", "_back_size") for x in (start, accepted))
    return state_met(stored, keys, "rank", start, accepted, layout)


BUDGET = ("open_risk_usd", "gross_notional_usd", "orders_last_minute")


def cycle_counts(decisions: DataFrame, keys: Sequence[str]) -> DataFrame:
    return decisions.groupBy(*keys).agg(
        F.count_if(F.col("approved")).alias("accepted"), F.count_if(~F.col("approved")).alias("rejected")
    )
