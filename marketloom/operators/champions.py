"""Champion selection among ranked or time-ordered nominations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import finite
from ..session import interim
from .series import join_keys
from .fold import GreedyLayout, greedy
from .ranking import Tie, row_numbers


@dataclass(frozen=True)
class PromotionCriteria:
    min_oos_samples: int = 126
    min_robustness: float = 0.60
    score_margin: float = 0.05
    max_drawdown: float = 0.30
    max_negative_month_rate: float = 0.50
    min_monthly_observations: int = 6
    max_drawdown_deterioration: float = 0.02
    max_negative_month_deterioration: float = 0.02


def qualifies(criteria: PromotionCriteria = PromotionCriteria()) -> Column:
    """The thresholds that do not depend on the reigning champion; missing metrics fail."""
    verdict = (
        (F.col("oos_samples") >= criteria.min_oos_samples)
        & finite("score").isNotNull()
        & (F.col("robustness") >= criteria.min_robustness)
        & (finite("max_drawdown") <= criteria.max_drawdown)
        & (finite("negative_month_rate") <= criteria.max_negative_month_rate)
        & (finite("monthly_observations") >= criteria.min_monthly_observations)
    )
    return F.coalesce(verdict, F.lit(False))


def champion_of_leaderboard(
    df: DataFrame, keys: Sequence[str], name: str = "name", criteria: PromotionCriteria = PromotionCriteria(), rank: str = "rank"
) -> DataFrame:
    """Champion when nominations come best first: later ones cannot beat it by a positive margin, so it
    is the best-ranked qualified row. A plain aggregate."""
    if criteria.score_margin <= 0:
        raise ValueError("needs a positive score margin; use promote_in_order")
    best = F.min(F.when(qualifies(criteria), F.struct(F.col(rank), F.col(name))))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col(f"_b.{name}").alias("champion"))


def promote_in_order(
    df: DataFrame,
    keys: Sequence[str],
    order: str = "ordinal",
    criteria: PromotionCriteria = PromotionCriteria(),
    layout: GreedyLayout = GreedyLayout(),
) -> DataFrame:
    """Walk nominations in order and add ``promoted``: thresholds, a score margin over the champion, and no
    worse drawdown or month-loss rate than allowed.

    Rows that fail the thresholds never touch the champion. Of the others, those that score too low for the champion
    reached so far are dropped side by side before each chunk is walked (:func:`fold.greedy`); drawdown and month-loss
    rates may get worse again by promotion, so they decide only in the walk. ``order`` is unique per family.
    """
    keys = list(keys)

    def make_walk():
        champion: list[float] | None = None

        def walk(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
            nonlocal champion
            score, dd, months, held = (pdf[x].to_numpy() for x in ("score", "max_drawdown", "negative_month_rate", "_score"))
            at = []
            for i in range(len(pdf)):
                if starts[i]:
                    champion = None if np.isnan(held[i]) else [held[i], pdf["_dd"].iloc[i], pdf["_months"].iloc[i]]
                if champion is None or (
                    score[i] >= champion[0] + criteria.score_margin
                    and dd[i] <= champion[1] + criteria.max_drawdown_deterioration
                    and months[i] <= champion[2] + criteria.max_negative_month_deterioration
                ):
                    champion = [score[i], dd[i], months[i]]
                    at.append(i)
            return pdf.iloc[at][[*keys, "_no"]].assign(_score=score[at], _dd=dd[at], _months=months[at])

        return walk

    numbered = interim(row_numbers(df.withColumn("_qualified", qualifies(criteria)), keys, (), "_no", Tie(order)))
    metrics = ("score", "max_drawdown", "negative_month_rate")
    slim = numbered.where("_qualified").select(*keys, "_no", *[F.col(x).cast("double").alias(x) for x in metrics])
    none = F.lit(None).cast("double")
    start = slim.select(*keys).distinct().select(*keys, *[none.alias(x) for x in ("_score", "_dd", "_months")])
    rising = criteria.score_margin >= 0
    possible = F.col("_score").isNull() | (F.col("score") >= F.col("_score") + criteria.score_margin) if rising else F.lit(True)
    won = greedy(slim, keys, "_no", start, possible, make_walk, layout)
    winners = won.select(*keys, "_no").withColumn("promoted", F.lit(True))
    return join_keys(numbered, winners, [*keys, "_no"], "left").select(
        *df.columns, F.coalesce("promoted", F.lit(False)).alias("promoted")
    )


def reigning_champion(promoted: DataFrame, keys: Sequence[str], name: str = "name", order: str = "ordinal") -> DataFrame:
    last = F.max(F.when(F.col("promoted"), F.struct(F.col(order), F.col(name))))
    return promoted.groupBy(*keys).agg(last.alias("_b")).select(*keys, F.col(f"_b.{name}").alias("champion"))
