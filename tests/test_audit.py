import pytest
from pyspark.sql import functions as F

from helpers import bars_frame, walk
from marketloom.operators.audit import BarAudit
from marketloom.operators.features import cross_sectional_features, technical_features
from marketloom.operators.quality import bar_violations
from marketloom.operators.series import SeriesLayout


def audited(bars, layout=SeriesLayout(block_rows=7), features=technical_features):
    audit = BarAudit()
    out = features(bars, layout, audit)
    assert "_same_key" not in out.columns
    return out.collect(), audit


@pytest.mark.parametrize("features", [technical_features, cross_sectional_features])
def test_audit_in_passing_equals_the_scan(spark, features):
    good = bars_frame(spark, {s: walk(40, i) for i, s in enumerate("AB")})
    again = good.where("symbol = 'A' AND hour(ts) % 5 = 0")  # pairs, some across the edge of a block
    nameless = good.limit(3).withColumn("symbol", F.lit(None).cast("string"))
    timeless = good.limit(2).withColumn("ts", F.lit(None).cast("timestamp"))
    wrong = good.limit(4).withColumns({"symbol": F.lit("W"), "close": F.when(F.hour("ts") > 1, 0.0), "volume": F.lit(-1.0)})
    bad = good.unionByName(again).unionByName(nameless).unionByName(nameless).unionByName(timeless).unionByName(wrong)
    rows, audit = audited(bad, features=features)
    assert len(rows) == bad.count()
    assert audit.violations() == {r.rule: r.rows for r in bar_violations(bad).collect()}
    with pytest.raises(ValueError, match="CLOSE_NOT_POSITIVE.*DUPLICATE_KEY.*VOLUME_NEGATIVE"):
        audit.require()


def test_audit_changes_no_feature(spark):
    good = bars_frame(spark, {s: walk(60, i) for i, s in enumerate("AB")})
    rows, audit = audited(good)
    assert audit.violations() == {} and audit.require() is None
    assert sorted(map(str, rows)) == sorted(map(str, technical_features(good, SeriesLayout(block_rows=7)).collect()))


def test_audit_of_an_empty_table(spark):
    rows, audit = audited(bars_frame(spark, {"A": walk(3, 1)}).where("false"))
    assert rows == [] and audit.violations() == {"EMPTY": 1}


def test_audit_costs_no_job_and_no_exchange(spark, tmp_path):
    path = str(tmp_path / "bars")
    bars_frame(spark, {"A": walk(60, 1)}).write.parquet(path)
    bars = spark.read.parquet(path)

    def shape(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return plan.count("FileScan"), plan.count("Exchange"), plan.count("Window ")

    plain, watched = technical_features(bars), technical_features(bars, audit=BarAudit())
    assert shape(plain)[:2] == shape(watched)[:2]  # as many scans and shuffles as without it
