"""Small frames and plain-Python loops the operators are compared with."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

START = datetime(2024, 1, 1)


def bar_rows(symbol, closes, step=timedelta(hours=1), start=START, volume=100.0):
    out, prev = [], closes[0]
    for i, close in enumerate(closes):
        out.append((symbol, start + i * step, prev, max(prev, close) * 1.001, min(prev, close) * 0.999, close, volume + i % 7))
        prev = close
    return out


def walk(n, seed, vol=0.03, drift=0.0, start=100.0):
    rng, price, out = random.Random(seed), start, []
    for _ in range(n):
        price *= math.exp(drift + vol * rng.gauss(0, 1))
        out.append(price)
    return out


def bars_frame(spark, series, step=timedelta(hours=1)):
    from marketloom.schemas import BARS_DDL

    rows = [row for symbol, closes in series.items() for row in bar_rows(symbol, closes, step)]
    return spark.createDataFrame(rows, BARS_DDL)


def loop_backtest(closes, signals, *, capital=10_000.0, bps=3.0, max_weight=1.0, risk=None):
    """One bar after the other, the obvious way."""
    rets = [0.0] + [b / a - 1.0 for a, b in zip(closes, closes[1:])]
    wanted = [0.0] + [min(max_weight, max(0.0, s)) if s is not None else 0.0 for s in signals[:-1]]
    equity = peak = capital
    weight = last_net = 0.0
    out = []
    for i, (ret, target) in enumerate(zip(rets, wanted)):
        desired = target
        if risk is not None:
            prior = rets[max(0, i - 20):i]
            vol = 0.0
            if len(prior) >= 5:
                mean = sum(prior) / len(prior)
                vol = math.sqrt(sum((x - mean) ** 2 for x in prior) / len(prior)) * math.sqrt(252)
            stop = (
                last_net <= -risk.max_daily_loss
                or max(0.0, 1.0 - equity / peak) >= risk.max_drawdown
                or vol >= risk.abnormal_volatility
            )
            desired = 0.0 if stop else min(target, risk.max_position_weight)
        turnover = abs(desired - weight)
        rate = turnover * bps / 10_000.0
        net = desired * ret - rate
        cost = equity * rate
        equity *= 1.0 + net
        peak = max(peak, equity)
        out.append((desired, turnover, net, equity, cost))
        weight, last_net = desired, net
    return out
