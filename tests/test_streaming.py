import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.streaming import monitor, quotes

TICK = "symbol string, ts timestamp, price double, quantity double, event_id long"
POINT = "symbol string, date timestamp, price double, volume double"


def ticks(spark, sf):
    from tidepanel.sources import domain
    return domain.ticks(spark, sf).select("symbol", "ts", "price", "quantity", "event_id")


def drain(query):
    query.awaitTermination(180)
    assert query.exception() is None


def test_streamed_bars_equal_batch(spark, sf, tmp_path):
    src = str(tmp_path / "in")
    # the last tick closes every window before it; only windows the watermark passed are emitted
    late = spark.createDataFrame([("zz", "2030-01-01 00:00:00", 1.0, 1.0, 0)], "symbol string, t string, price double, quantity double, event_id long")
    ticks(spark, sf).coalesce(1).write.parquet(src)
    late.select("symbol", F.col("t").cast("timestamp").alias("ts"), "price", "quantity", "event_id").coalesce(1).write.mode("append").parquet(src)
    stream = quotes.bars(quotes.read_ticks(spark, src, TICK))
    drain(quotes.to_parquet(stream, str(tmp_path / "out"), str(tmp_path / "ck")))
    got = spark.read.parquet(str(tmp_path / "out")).where("symbol <> 'zz'").orderBy("symbol", "date").toPandas()
    want = quotes.bars(ticks(spark, sf)).orderBy("symbol", "date").toPandas()
    pd.testing.assert_frame_equal(got, want)


def test_latest_price_handler(spark, sf, tmp_path):
    src = str(tmp_path / "in")
    ticks(spark, sf).coalesce(1).write.parquet(src)
    seen = {}

    def handler(df, _):
        for r in df.limit(100).collect():
            seen[r.symbol] = r.price

    drain(quotes.to_handler(quotes.latest_price(quotes.read_ticks(spark, src, TICK)), handler, str(tmp_path / "ck")))
    assert seen == {r.symbol: r.price for r in quotes.latest_price(ticks(spark, sf)).collect()}


def test_filter_stream_equals_batch_across_restarts(spark, tmp_path):
    rng = np.random.default_rng(7)
    n = 60
    pdf = pd.concat([pd.DataFrame({"symbol": s, "date": pd.date_range("2024-01-01", periods=n, freq="h"), "price": 50 * np.exp(np.cumsum(rng.normal(0, 0.05, n))),
                                   "volume": rng.integers(1, 9, n).astype(float)}) for s in ("a", "b")])
    sdf = spark.createDataFrame(pdf)
    src, out, ck = (str(tmp_path / k) for k in ("in", "out", "ck"))
    cut = "date < '2024-01-02 06:00:00'"
    for part in (sdf.where(cut), sdf.where(f"not ({cut})")):
        part.coalesce(1).write.mode("append").parquet(src)
        stream = monitor.filter_stream(spark.readStream.schema(POINT).parquet(src))
        drain(quotes.to_parquet(stream, out, ck))  # second start resumes from the checkpoint
    got = spark.read.parquet(out).orderBy("symbol", "date").toPandas()
    want = monitor.filter_batch(sdf).orderBy("symbol", "date").toPandas()
    assert len(got) == len(want) == 2 * (n - 10)
    np.testing.assert_allclose(np.vstack(got["probs"]), np.vstack(want["probs"]), rtol=1e-12)
    np.testing.assert_allclose(np.vstack(got["probs"]).sum(axis=1), 1.0)
    np.testing.assert_allclose(np.vstack(got["features"]), np.vstack(want["features"]), rtol=1e-9)


def test_feature_fold_equals_windows(spark, sf):
    from tidepanel.sources import domain
    from tidepanel.streaming import history
    p = domain.points(spark, sf)
    a = monitor.filter_batch(p).orderBy("symbol", "date").toPandas()
    b = history.buffer_features(p).where("f_mean is not null").orderBy("symbol", "date").toPandas()
    np.testing.assert_allclose(np.vstack(a["features"]), b[["f_mean", "f_std", "f_skew", "f_kurt", "f_volume", "f_volatility"]].values, rtol=1e-6, atol=1e-9)
