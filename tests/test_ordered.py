import numpy as np
import pandas as pd
import pytest

from tests.test_streaming import POINT, drain
from tidepanel.streaming import monitor, ordered, quotes


@pytest.fixture()
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ordered.ROCKSDB)
    yield
    spark.conf.set(key, before)


def points(n=60):
    rng = np.random.default_rng(7)
    return pd.concat([pd.DataFrame({"symbol": s, "date": pd.date_range("2024-01-01", periods=n, freq="h"), "price": 50 * np.exp(np.cumsum(rng.normal(0, 0.05, n))),
                                    "volume": rng.integers(1, 9, n).astype(float)}) for s in ("a", "b")], ignore_index=True)


def feed(spark, src, frames):
    for f in frames:
        spark.createDataFrame(f, POINT).coalesce(1).write.mode("append").parquet(src)


def run(spark, src, out, ck, late="12 hours"):
    stream = spark.readStream.schema(POINT).option("maxFilesPerTrigger", 1).parquet(src)
    drain(quotes.to_parquet(ordered.filter_ordered(stream, late), out, ck))


def test_shuffled_batches_give_the_ordered_result_across_a_restart(spark, tmp_path, rocksdb):
    pdf = points()
    src, out, ck = (str(tmp_path / k) for k in ("in", "out", "ck"))
    # dealt by time with up to ten hours of disorder, b silent after hour 30; the last row moves the watermark past everything
    pdf = pdf[(pdf.symbol == "a") | (pdf.date < "2024-01-02 06:00")]
    rng = np.random.default_rng(3)
    order = pdf.assign(k=pdf.date + pd.to_timedelta(rng.uniform(0, 10, len(pdf)), unit="h")).sort_values("k").drop(columns="k").reset_index(drop=True)
    parts = np.array_split(np.arange(len(order)), 6)
    feed(spark, src, [order.iloc[p] for p in parts[:3]])
    run(spark, src, out, ck)
    first = spark.read.parquet(out).count()
    feed(spark, src, [order.iloc[p] for p in parts[3:]] + [pd.DataFrame({"symbol": ["zz"], "date": [pd.Timestamp("2030-01-01")], "price": [1.0], "volume": [1.0]})])
    run(spark, src, out, ck)
    rows = spark.read.parquet(out)
    got = ordered.results(rows).orderBy("symbol", "date").toPandas()
    want = monitor.filter_batch(spark.createDataFrame(pdf)).orderBy("symbol", "date").toPandas()
    assert 0 < first < len(got) == len(want) == 50 + 20
    assert got["date"].tolist() == want["date"].tolist() and ordered.late_counts(rows).count() == 0
    np.testing.assert_allclose(np.vstack(got["probs"]), np.vstack(want["probs"]), rtol=1e-12)


def test_late_points_are_reported_and_change_nothing(spark, tmp_path, rocksdb):
    pdf = points(40)
    src, out, ck = (str(tmp_path / k) for k in ("in", "out", "ck"))
    late = pdf[(pdf.symbol == "a") & (pdf.date < "2024-01-01 03:00")]
    rest = pdf.drop(late.index)
    end = pd.DataFrame({"symbol": ["zz"], "date": [pd.Timestamp("2030-01-01")], "price": [1.0], "volume": [1.0]})
    feed(spark, src, [rest.iloc[:10], rest.iloc[10:], pd.concat([late, end])])
    run(spark, src, out, ck, "1 hour")
    rows = spark.read.parquet(out)
    assert {r["symbol"]: r["late"] for r in ordered.late_counts(rows).collect()} == {"a": len(late)}
    got = ordered.results(rows).orderBy("symbol", "date").toPandas()
    want = monitor.filter_batch(spark.createDataFrame(rest)).orderBy("symbol", "date").toPandas()
    assert got["date"].tolist() == want["date"].tolist()
    np.testing.assert_allclose(np.vstack(got["probs"]), np.vstack(want["probs"]), rtol=1e-12)
