import math
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import START, bars_frame, walk
from marketloom.operators import features as FE
from marketloom.operators import labels as LA
from marketloom.operators.series import SeriesLayout, compound, index_rows, last_rows, running_sum

SERIES = {"A": walk(60, 1), "B": walk(45, 2), "C": walk(9, 3)}


def table(df, columns):
    return {
        (r["symbol"], r["ts"]): tuple(None if r[c] is None else round(r[c], 10) for c in columns)
        for r in df.select("symbol", "ts", *columns).collect()
    }


def test_blocks_repartitioning_and_order_do_not_matter(spark):
    bars = bars_frame(spark, SERIES)
    want = table(FE.technical_features(bars), FE.TECHNICAL_COLUMNS)
    for df, rows in ((bars.repartition(17), 7), (bars.orderBy(F.rand(3)).repartition(1), 13)):
        assert table(FE.technical_features(df, SeriesLayout(block_rows=rows)), FE.TECHNICAL_COLUMNS) == want


def test_features_are_causal(spark):
    short = {k: v[:-5] for k, v in SERIES.items()}
    full = table(FE.technical_features(bars_frame(spark, SERIES), SeriesLayout(block_rows=10)), FE.TECHNICAL_COLUMNS)
    past = table(FE.technical_features(bars_frame(spark, short), SeriesLayout(block_rows=10)), FE.TECHNICAL_COLUMNS)
    assert past == {k: full[k] for k in past}


def test_feature_values(spark):
    closes = np.array(SERIES["A"])
    rows = FE.technical_features(bars_frame(spark, {"A": SERIES["A"]})).orderBy("ts").collect()
    rets = np.diff(closes) / closes[:-1]
    assert rows[19].realized_vol_20 is None and rows[19].sma_20_dist is not None
    assert rows[20].realized_vol_20 == pytest.approx(np.std(rets[:20]) * math.sqrt(252))
    assert rows[30].momentum_20 == pytest.approx(closes[30] / closes[10] - 1)
    highs = [max(a, b) * 1.001 for a, b in zip(np.r_[closes[0], closes[:-1]], closes)]
    assert rows[30].breakout_20 == pytest.approx(closes[30] / max(highs[10:30]) - 1)


def test_cross_sectional_rank_averages_ties_and_skips_null(spark):
    rows = [("a", 0, 1.0), ("b", 0, 2.0), ("c", 0, 2.0), ("d", 0, None), ("a", 1, 5.0)]
    df = spark.createDataFrame(rows, "symbol string, ts int, x double").withColumn("r", FE.percentile_rank("x"))
    got = {(r.symbol, r.ts): r.r for r in df.collect()}
    assert got == {("a", 0): pytest.approx(1 / 3), ("b", 0): pytest.approx(2.5 / 3), ("c", 0): pytest.approx(2.5 / 3),
                   ("d", 0): None, ("a", 1): 1.0}


def test_constant_volume_has_no_z_score(spark):
    df = bars_frame(spark, {"A": walk(30, 5)}).withColumn("volume", F.lit(7.0))
    assert FE.technical_features(df).where("volume_z_20 IS NOT NULL").count() == 0


def test_forward_labels(spark):
    df = bars_frame(spark, {"A": [100.0 + i for i in range(6)], "B": [100.0, 90.0, 110.0, 120.0]})
    out = LA.panel_labels(df, (1, 2, 5), layout=SeriesLayout(block_rows=2)).orderBy("symbol", "ts").collect()
    a, b = [r for r in out if r.symbol == "A"], [r for r in out if r.symbol == "B"]
    assert a[0].fwd_return_1 == pytest.approx(0.01) and a[0].fwd_return_5 == pytest.approx(0.05)
    assert [r.fwd_return_1 is None for r in a] == [False] * 5 + [True]
    assert sum(r.fwd_return_5 is None for r in a) == 5
    assert b[0].adverse_excursion_2 == pytest.approx(-0.10) and b[3].adverse_excursion_2 is None
    with pytest.raises(ValueError):
        LA.panel_labels(df, (0,))


def test_excess_label_moves_benchmark_on_its_own_calendar(spark):
    bars = bars_frame(spark, {"A": [100.0, 110.0]})
    bench = bars_frame(spark, {"X": [50.0, 60.0, 66.0]}).select("ts", "close")
    first = LA.panel_labels(bars, (1,), bench).orderBy("ts").first()
    assert first.fwd_excess_return_1 == pytest.approx(0.10 - 0.20)


def test_supervised_rows_drop_incomplete(spark):
    df = bars_frame(spark, {"A": walk(10, 1)}).withColumn("x", F.lit(1.0))
    assert LA.supervised_rows(df, ("x",), horizon=2).count() == 8


def test_index_running_and_last_rows(spark):
    layout = SeriesLayout(block_rows=4, bucket="hour")
    bars = bars_frame(spark, SERIES)
    idx = index_rows(bars, layout).groupBy("symbol").agg(F.max("row_idx").alias("m"), F.count_distinct("row_idx").alias("d"))
    assert {r.symbol: (r.m, r.d) for r in idx.collect()} == {"A": (60, 60), "B": (45, 45), "C": (9, 9)}
    run = running_sum(bars, layout, {"total": "close"}).where("symbol = 'B'").orderBy("ts").collect()
    assert [r.total for r in run] == pytest.approx(list(np.cumsum(SERIES["B"])))
    rates = bars.withColumn("r", F.when(F.col("close") > 100, 0.1).otherwise(-0.1))
    got = compound(rates, layout, "r", before="was").where("symbol = 'A'").orderBy("ts").collect()
    wealth = np.cumprod([1.1 if x > 100 else 0.9 for x in SERIES["A"]])
    assert [r.equity for r in got] == pytest.approx(list(wealth))
    assert [r.equity_peak for r in got] == pytest.approx(list(np.maximum.accumulate(wealth)))
    assert [r.was for r in got] == pytest.approx([1.0, *wealth[:-1]])
    tail = last_rows(bars, layout, 20, minimum=10).groupBy("symbol").agg(F.count("*").alias("n"), F.min("enough_bars").alias("ok"))
    assert {r.symbol: (r.n, r.ok) for r in tail.collect()} == {"A": (20, True), "B": (20, True), "C": (9, False)}


def test_rows_without_key_or_time_are_kept(spark):
    from marketloom.operators.quantile import exact_quantile
    from marketloom.operators.series import ROW, index_rows, running_sum

    rows = [("A", START, 1.0), ("A", None, 2.0), (None, START, 3.0), ("A", START + timedelta(days=2), 4.0)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, x double")
    got = index_rows(df).collect()
    assert len(got) == 4
    assert {r["x"]: r[ROW] for r in got if r["symbol"] == "A"} == {2.0: 1, 1.0: 2, 4.0: 3}
    summed = {r["x"]: r["s"] for r in running_sum(df, SeriesLayout(block_rows=1), {"s": "x"}).collect()}
    assert len(summed) == 4 and summed[4.0] == 7.0
    half = {r["symbol"]: r["q"] for r in exact_quantile(df, ["symbol"], "x", 0.5, "q").collect()}
    assert half == {"A": 2.0, None: 3.0}
