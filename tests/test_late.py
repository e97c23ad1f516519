import random
from collections import Counter
from datetime import timedelta

from helpers import START
from marketloom.streaming.late import bars_and_late_ticks

WIDTH = timedelta(minutes=5)


def loop(batches, delay):
    """Tick after tick: bars closed at the end of a batch, ticks whose bar was closed before theirs."""
    mark, open_bars, bars, late = None, {}, [], []
    for batch in batches:
        for symbol, ts, price in batch:
            if ts is None:
                late.append((symbol, "undated", None, price))
                continue
            start = START + (ts - START) // WIDTH * WIDTH
            if mark is not None and start + WIDTH <= mark:
                late.append((symbol, "late", ts, price))
            else:
                open_bars.setdefault((symbol, start), []).append((ts, price))
        seen = [ts for _, ts, _ in batch if ts is not None]
        if seen:
            mark = max([*([mark] if mark else []), max(seen) - delay])
        for key in [k for k in open_bars if mark is not None and k[1] + WIDTH <= mark]:
            rows = sorted(open_bars.pop(key))
            prices = [p for _, p in rows]
            bars.append((*key, rows[0][1], max(prices), min(prices), rows[-1][1], float(len(rows))))
    return bars, late, sum(len(x) for x in open_bars.values())


def test_every_tick_is_in_a_bar_or_late_or_open(spark, tmp_path):
    rng = random.Random(3)
    batches = []
    for k in range(4):  # each later by half an hour, with stragglers from long ago, ties and ticks without a time
        at = START + timedelta(minutes=30 * k)
        rows = [(rng.choice("AB"), at + timedelta(seconds=rng.randrange(1800)), round(rng.uniform(1, 9), 2)) for _ in range(150)]
        rows += [("A", START + timedelta(seconds=rng.randrange(1, 1800 * (k + 1))), 5.0) for _ in range(40)] + [("B", None, 2.0), (None, at, 1.0)]
        batches.append(rows)
    ticks = str(tmp_path / "ticks")
    for rows in batches:
        spark.createDataFrame(rows, "symbol string, ts timestamp, price double").coalesce(1).write.mode("append").parquet(ticks)
    source = spark.readStream.schema("symbol string, ts timestamp, price double").option("maxFilesPerTrigger", 1).parquet(ticks)
    out = bars_and_late_ticks(source, WIDTH, "1 minute")
    query = (out.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state"))
             .format("parquet").start(str(tmp_path / "out")))
    query.awaitTermination()
    got = spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()
    bars, late, left = loop(batches, timedelta(minutes=1))
    assert Counter((r.symbol, r.ts, r.open, r.high, r.low, r.close, r.volume) for r in got if r.kind == "bar") == Counter(bars)
    assert Counter((r.symbol, r.kind, r.ts, r.open) for r in got if r.kind != "bar") == Counter(late)
    assert len(late) > 20 and left > 0
    assert sum(r.volume for r in got) + left == sum(map(len, batches))
