"""Edge fixtures: short, constant, gapped, duplicated and late rows under ANSI arithmetic."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import bars_frame, walk
from tidepanel.operators import cleaning as c, cross_section as cs, joins as j, quality as q, technical as t

STEPS = [t.returns, t.price_ratios, t.rsi, t.rsi_wilder, t.macd, t.bollinger, t.momentum, t.williams_r, t.stochastic, t.hist_vol, t.parkinson, t.garch_like,
         t.true_range_atr, t.vol_clustering, t.ewm_vol, t.vol_of_vol, t.downside_vol, t.volume_ma, t.obv, t.vpt, t.ad_line, t.vwap, t.ease_of_movement, t.candles,
         t.engulfing_gaps, t.higher_moments, t.cvar, t.autocorr, t.hl_spread, t.amihud, t.roll_spread, t.close_position, t.zscore_roll, t.robust_roll, t.minmax_roll,
         t.mean_reversion, t.rolling_rank, t.drawdown]


def test_constant_and_single_row_symbols_never_fail(spark):
    rows = [("C", f"2020-{m:02d}-{d:02d}", 5.0, 5.0, 5.0, 5.0, 0.0) for m in (1, 2, 3) for d in range(1, 21)] + [("ONE", "2020-01-01", 1.0, 2.0, 0.5, 1.5, 10.0)]
    df = bars_frame(spark, rows)
    for step in STEPS:
        df = step(df).select("symbol", "date", "open", "high", "low", "close", "volume", *[x for x in ("ret",) if x in step(df).columns])
        out = step(df) if "ret" in df.columns else df
        assert out.count() == 61
    rsi = t.rsi(bars_frame(spark, rows)).where("symbol = 'C' and rsi_14 is not null").count()
    assert rsi == 0  # no movement at all: undefined


def test_forward_fill_limit(spark):
    rows = [("A", f"2020-01-{d:02d}", None, None, None, 1.0 if d in (1, 7, 14) else None, 1.0) for d in range(1, 15)]
    df = bars_frame(spark, rows)
    got = [r.close for r in c.ffill(df, ["close"], 5).orderBy("date").collect()]
    assert got[5] == 1.0 and got[11] == 1.0 and got[12] is None  # run of 5 filled, sixth missing day stays null
    assert all(v == 1.0 for v in [r.close for r in c.ffill(df, ["close"]).collect()])


def test_splits_then_dividends(spark):
    df = bars_frame(spark, [("A", f"2020-01-0{d}", 10.0, 10.0, 10.0, 10.0, 100.0) for d in (1, 2, 3)])
    acts = spark.createDataFrame([("A", "2020-01-03", "split", 0.5), ("A", "2020-01-02", "dividend", 1.0), ("A", "2020-01-10", "split", 1.0)],
                                 "symbol string, d string, action string, value double").withColumn("date", F.col("d").cast("timestamp"))
    got = {r.date.day: (r.close, r.volume) for r in c.adjust_actions(df, acts).collect()}
    assert got == {1: (4.0, 200.0), 2: (5.0, 200.0), 3: (10.0, 100.0)}


def test_asof_is_inclusive_and_never_looks_ahead(spark):
    p = spark.createDataFrame([("A", d) for d in ("2020-05-14", "2020-05-15", "2020-05-16")], "symbol string, d string").withColumn("date", F.col("d").cast("timestamp"))
    f = spark.createDataFrame([("A", "2020-03-31", 1.0), ("A", "2020-06-30", 2.0)], "symbol string, d string, revenue double").withColumn("fiscal_date", F.col("d").cast("timestamp"))
    got = [r.revenue for r in j.asof_lag(p, f, ["revenue"]).orderBy("date").collect()]
    assert got == [None, 1.0, 1.0]  # visible from the 45th day on


@pytest.mark.parametrize("forward", [False, True])
def test_bucketed_asof_equals_pandas(spark, forward):
    rng = np.random.default_rng(5)
    day = lambda n: pd.to_datetime("2020-01-01") + pd.to_timedelta(rng.integers(0, 900, n), "D")
    left = pd.DataFrame({"k": np.where(rng.random(800) < 0.4, 0, rng.integers(1, 5, 800)), "t": day(800), "id": np.arange(800)})
    right = pd.DataFrame({"k": rng.integers(0, 5, 60), "u": day(60)}).drop_duplicates(["k", "u"])
    right["v"] = np.arange(len(right), dtype=float)
    want = pd.merge_asof(left.sort_values("t"), right.sort_values("u"), left_on="t", right_on="u", by="k", direction="forward" if forward else "backward").set_index("id").sort_index()["v"]
    for bucket in (None, "month", "year"):
        got = j.asof(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "t", "u", ["v"], bucket=bucket, forward=forward).toPandas().set_index("id").sort_index()["v"]
        np.testing.assert_allclose(got.astype(float), want, err_msg=str(bucket))


def test_later_rows_never_change_earlier_features(spark):
    sdf, _ = walk(spark, 150)
    cut = sdf.where("date < '2020-04-20'")
    build = lambda d: t.higher_moments(t.hist_vol(t.macd(t.rsi(t.returns(d)))))
    a = build(sdf).where("date < '2020-04-20'").orderBy("symbol", "date").toPandas()
    b = build(cut).orderBy("symbol", "date").toPandas()
    pd.testing.assert_frame_equal(a, b[a.columns])


def test_result_does_not_depend_on_partitioning(spark):
    sdf, _ = walk(spark, 60, symbols=[f"S{i}" for i in range(12)])
    f = lambda d: cs.cs_rank(t.returns(d), "ret").orderBy("symbol", "date").toPandas()
    pd.testing.assert_frame_equal(f(sdf.repartition(7, "date")), f(sdf.coalesce(1)))


def test_duplicates_and_unknown_method(spark):
    df = bars_frame(spark, [("A", "2020-01-01", 1.0, 1.0, 1.0, 1.0, 1.0)] * 2 + [("A", "2020-01-02", 1.0, 1.0, 1.0, 2.0, 1.0)])
    r = q.duplicates(df, ["symbol", "date"], ["close"]).first()
    assert (r.duplicate_keys, r.duplicate_rows) == (1, 1)
    with pytest.raises(ValueError):
        q.flag(df, ["close"], "isolation_forest")


def test_business_day_arithmetic(spark):
    pdf = pd.DataFrame({"lo": pd.date_range("2021-01-01", periods=40).repeat(3), "k": [0, 5, 23] * 40})
    pdf["hi"] = pdf["lo"] + pd.to_timedelta(pdf["k"], "D")
    got = spark.createDataFrame(pdf).select(q.business_days(F.col("lo"), F.col("hi")).alias("n")).toPandas()["n"]
    assert list(got) == [len(pd.bdate_range(a, b)) for a, b in zip(pdf["lo"], pdf["hi"])]


def test_bars_without_close_survive_adjustments(spark):
    from tidepanel.operators import cleaning as cl
    from pyspark.sql import functions as F
    b = bars_frame(spark, [("A", "2020-01-01", 1.0, 2.0, 0.5, None, 10.0), ("A", "2020-01-02", 1.0, 2.0, 0.5, 1.5, 10.0)])
    a = spark.createDataFrame([("A", "2020-01-02", 2.0), ("A", "2020-01-05", 3.0)], "symbol string, d string, value double").select("symbol", F.col("d").cast("timestamp").alias("date"), "value")
    got = {str(r["date"])[:10]: (r["open"], r["close"]) for r in cl.adjust_splits(b, a).collect()}
    assert got == {"2020-01-01": (6.0, None), "2020-01-02": (3.0, 4.5)}
    assert cl.adjust_dividends(b, a).count() == 2


def test_total_loss_ends_wealth(spark):
    from tidepanel.operators import backtest as bt, technical as t
    from pyspark.sql import functions as F
    d = spark.createDataFrame([("A", i, r) for i, r in enumerate([0.1, -1.0, 0.1])] + [("B", i, r) for i, r in enumerate([-1.5, 0.2])], "symbol string, date int, ret double")
    got = [(r["symbol"], round(r["wealth"], 6), round(r["drawdown"], 6)) for r in t.drawdown(d).orderBy("symbol", "date").collect()]
    assert got == [("A", 1.1, 0.0), ("A", 0.0, -1.0), ("A", 0.0, -1.0), ("B", 0.0, -1.0), ("B", 0.0, -1.0)]
    b = bt.bootstrap_ci(d.where("symbol = 'B'").select(F.col("symbol").alias("series"), "date", "ret"), 20).where("metric = 'max_drawdown'").first()
    assert b["q05"] == -1.0


def test_ewm_with_nulls_inside_like_pandas(spark):
    import numpy as np
    import pandas as pd
    from tidepanel.functions import smoothing as sm
    x = [None, 1.0, None, 3.0, 2.0, None, None, 5.0, 1.0]
    d = spark.createDataFrame([("A", i, v) for i, v in enumerate(x)], "symbol string, date int, x double")
    s = pd.Series(x, dtype=float)
    got = sm.ewm_mean(d, {"m": ("x", 3)}).orderBy("date").toPandas()["m"]
    np.testing.assert_allclose(got, s.ewm(span=3).mean(), rtol=1e-12)
    got = sm.ewm_std(d, {"m": ("x", 3)}).orderBy("date").toPandas()["m"]
    np.testing.assert_allclose(got, s.ewm(span=3).std(), rtol=1e-9)
    got = sm.ewm_recursive(d, {"m": ("x", 3)}).orderBy("date").toPandas()["m"]
    np.testing.assert_allclose(got, s.ewm(span=3, adjust=False, ignore_na=True).mean(), rtol=1e-12)


def test_duplicates_tell_null_columns_apart(spark):
    from tidepanel.operators import quality as q
    d = spark.createDataFrame([(1, None, 1.0), (1, 1.0, None), (1, None, 1.0)], "k int, a double, b double")
    assert q.duplicates(d, ["k"], ["a", "b"]).first().asDict() == {"duplicate_keys": 2, "duplicate_rows": 1}


def test_slices_add_up_to_the_order(spark):
    from pyspark.sql import functions as F
    from tidepanel.operators import execution as ex
    o = spark.createDataFrame([(1, "A", "2020-01-01 09:00:00", 100.0, 2), (2, "A", "2020-01-01 09:00:00", 1e6, 2)], "order_id int, symbol string, t string, quantity double, regime int").withColumn("order_time", F.col("t").cast("timestamp"))
    adv = spark.createDataFrame([("A", 6500.0)], "symbol string, adv double")
    for r in ex.slice_schedule(o, adv).groupBy("order_id").agg(F.sum("slice_quantity").alias("s"), F.max("unfilled").alias("u")).collect():
        assert abs(r["s"] + r["u"] - (100.0 if r["order_id"] == 1 else 1e6)) < 1e-6


def test_raw_trades_are_not_sorted(spark, sf):
    from tidepanel.sources import domain as d
    plan = d.bars(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "ObjectHash" not in plan
    plan = d.bars(spark, sf, "1996-03-01", "1997-08-31")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan


def test_staging_refuses_a_machine_folder_on_a_cluster(spark, monkeypatch):
    import pytest
    from tidepanel.core import scratch

    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda k, default=None: default)

    with pytest.raises(ValueError):
        scratch.shared_dir(Session())


def test_slices_follow_from_their_orders_row(spark):
    from pyspark.sql import functions as F
    from tidepanel.operators import execution as ex
    rows = [(1, "A", "2020-01-01 09:30:00", 100.0, 0), (2, "A", "2020-01-01 22:00:00", 5000.0, 1), (3, "B", "2020-01-01 10:00:00", 10.0, None), (4, "B", "2020-01-01 10:00:00", None, 2)]
    o = spark.createDataFrame(rows, "order_id long, symbol string, t string, quantity double, regime int").withColumn("order_time", F.col("t").cast("timestamp")).drop("t")
    adv = spark.createDataFrame([("A", 650.0)], "symbol string, adv double")
    d = ex.slice_schedule(o, adv)
    plan = d._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "Window" not in plan and "Generate" not in plan
    got = d.orderBy("order_id", "slice_id").toPandas()
    assert got.groupby("order_id").size().to_dict() == {1: 24, 2: 16, 3: 20, 4: 20}
    two = got[got["order_id"] == 2]
    assert str(two["scheduled_time"].iloc[-1]) == "2020-01-02 03:37:30" and (two["slice_quantity"] == 20.0).all() and (two["unfilled"] == 4680.0).all()
    three = got[got["order_id"] == 3]
    assert abs(three["slice_quantity"].sum() - 10.0) > 0 and (three["unfilled"] >= 0).all() and three["max_participation"].isna().all()
    assert three["slice_quantity"].iloc[0] == 0.75 and (got[got["order_id"] == 4]["slice_quantity"] == 0.0).all()


def test_survivors_are_found_without_making_the_bars_twice(spark):
    from pyspark.sql import functions as F
    from tidepanel.operators import cleaning
    days = spark.range(10).select(F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit(None).cast("string"))).alias("symbol"), F.expr("timestamp'2020-01-01' + id * interval 1 day").alias("date"), F.lit(1.0).alias("close"))
    rows = days.where("symbol is null or symbol <> 'b' or date > '2020-01-03'").withColumn("close", F.expr("if(symbol = 'c' and date > '2020-01-05', null, close)"))
    kept = cleaning.survivorship_filter(rows, "2020-01-02", 6)
    assert [r["symbol"] for r in kept.collect()] == ["a"] * 10 and kept.columns == rows.columns
    assert "Join" not in kept._jdf.queryExecution().executedPlan().toString()
