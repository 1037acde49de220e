"""Bars and quotes at tick resolution: results and what enters the shuffle."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.sources.bars import bars_from_trades
from tidepanel.streaming import quotes


@pytest.fixture(scope="module")
def ticks(spark):
    """Ticks all over the day, many of equal time, dealt to partitions at random."""
    rows = spark.range(0, 60_000, 1, 6).select((F.col("id") % 5).alias("symbol"), (F.col("id") * 7919 % 60_000).alias("event_id"), F.rand(3).alias("price"), F.lit(1.0).alias("quantity"))
    at = F.timestamp_micros((F.floor(F.col("event_id") / 3) * 3 * 60_000_000 + F.col("event_id") % 2 - 86_400_000_000).cast("long"))
    return rows.withColumn("ts", at)


@pytest.fixture()
def plain(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def nodes(plan):
    children, out = plan.children(), [plan]
    for i in range(children.size()):
        out += nodes(children.apply(i))
    return out


def exchanged(df):
    """Rows that entered each exchange, after a run; no raw row may be sorted."""
    df.collect()
    found = nodes(df._jdf.queryExecution().executedPlan())
    assert not [n for n in found if "Sort" in n.nodeName()]
    return [n.metrics().apply("shuffleRecordsWritten").value() for n in found if n.nodeName() == "Exchange"]


def brute(pdf, by):
    pdf = pdf.sort_values(["ts", "event_id"])
    g = pdf.groupby(["symbol", by])
    return pd.DataFrame({"open": g.price.first(), "high": g.price.max(), "low": g.price.min(), "close": g.price.last(), "volume": g.quantity.sum()}).reset_index()


def test_daily_bars_of_intraday_ticks(spark, ticks, plain):
    df = bars_from_trades(ticks, "day", F.col("event_id"))
    got = df.orderBy("symbol", "date").toPandas()
    pdf = ticks.toPandas()
    want = brute(pdf.assign(date=pdf.ts.dt.floor("D")), "date")
    pd.testing.assert_frame_equal(got, want.astype({"symbol": got.symbol.dtype, "date": got.date.dtype}), check_exact=False)
    rows = exchanged(df)
    assert len(rows) == 1 and rows[0] <= 6 * len(want)


def test_minute_bars_and_latest_quotes(spark, ticks, plain):
    pdf = ticks.toPandas()
    df = quotes.bars(ticks, "30 minutes")
    got = df.orderBy("symbol", "date").toPandas()
    want = brute(pdf.assign(date=pdf.ts.dt.floor("30min")), "date")
    pd.testing.assert_frame_equal(got, want.astype({"symbol": got.symbol.dtype, "date": got.date.dtype}), check_exact=False)
    assert len(exchanged(df)) == 1
    last = quotes.latest_price(ticks)
    got = {r["symbol"]: (r["ts"], r["price"]) for r in last.collect()}
    top = pdf.sort_values(["ts", "event_id"]).groupby("symbol").last()
    assert got == {s: (r.ts.to_pydatetime(), r.price) for s, r in top.iterrows()}
    rows = exchanged(last)
    assert len(rows) == 1 and rows[0] <= 5 * 6


def test_equal_times_null_and_negative_ties(spark):
    rows = [("a", "2024-01-01 10:00:00", t, p) for t, p in ((5, 1.0), (-3, 2.0), (None, 3.0), (2**62, 4.0))] + [("a", "1960-01-01 10:00:00", 1, 9.0), ("a", None, 1, 7.0)]
    df = spark.createDataFrame(rows, "symbol string, t string, event_id long, price double").withColumn("ts", F.col("t").cast("timestamp")).withColumn("quantity", F.lit(1.0))
    got = {str(r["date"]): (r["open"], r["close"]) for r in bars_from_trades(df, "day", F.col("event_id")).collect()}
    assert got["2024-01-01 00:00:00"] == (2.0, 4.0) and got["1960-01-01 00:00:00"] == (9.0, 9.0)
