import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import walk
from tidepanel.core.ordering import grouped_quantiles, grouped_rank, positions
from tidepanel.functions.smoothing import ewm_mean, ewm_recursive, ewm_std


@pytest.fixture(scope="module")
def hot(spark):
    """One key holds a third of the rows, another column is mostly one value."""
    rng = np.random.default_rng(3)
    n = 6000
    pdf = pd.DataFrame({"k": np.where(rng.random(n) < 0.34, 0, rng.integers(1, 9, n)), "x": np.round(rng.normal(size=n), 2)})
    pdf.loc[rng.random(n) < 0.3, "x"] = 0.5
    pdf["id"] = np.arange(n)
    pdf.loc[::97, "x"] = np.nan
    sdf = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    return sdf, pdf


@pytest.mark.parametrize("limit", [10**6, 100])
@pytest.mark.parametrize("method", ["average", "min", "max"])
def test_grouped_rank_is_exact_under_skew_and_ties(hot, method, limit):
    sdf, pdf = hot
    got = grouped_rank(sdf, ["k"], "x", "r", method, limit=limit).toPandas().set_index("id").sort_index()["r"]
    want = pdf.set_index("id").groupby("k")["x"].rank(method=method, pct=False) / pdf.set_index("id").groupby("k")["x"].transform("count")
    np.testing.assert_allclose(got, want)


def test_a_large_group_is_spread_over_many_tasks_and_a_small_one_costs_one_exchange(spark):
    rows = spark.range(20_000).select(F.lit(1).alias("k"), (F.col("id") * 7919 % 20_011).cast("double").alias("x"))
    p = positions(rows, ["k"], "x", limit=1000)
    assert len(p.inputFiles()) >= 40 and p.where("below = 0").count() == 1 and p.where("n <> 20000").isEmpty()
    df = rows.limit(50)
    plan = grouped_rank(df, ["k"], "x", "r", base=df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1


@pytest.mark.parametrize("limit", [10**6, 100])
def test_grouped_quantiles_are_exact(hot, limit):
    sdf, pdf = hot
    got = grouped_quantiles(sdf, ["k"], "x", {"a": 0.05, "m": 0.5, "z": 0.99}, limit=limit).toPandas().set_index("k").sort_index()
    for name, p in (("a", 0.05), ("m", 0.5), ("z", 0.99)):
        np.testing.assert_allclose(got[name], pdf.groupby("k")["x"].quantile(p))
    whole = grouped_quantiles(sdf, [], "x", {"m": 0.37}, limit=limit).first()
    assert abs(whole["m"] - pdf["x"].quantile(0.37)) < 1e-12


@pytest.mark.parametrize("span", [3, 12, 50])
def test_ewm_matches_pandas(spark, span):
    sdf, pdf = walk(spark, 700)
    d = ewm_mean(sdf, {"m": ("close", span)})
    d = ewm_recursive(d, {"r": ("close", span)})
    d = ewm_std(d, {"s": ("close", span)})
    got = d.toPandas().sort_values(["symbol", "date"])
    for out, f in (("m", lambda s: s.ewm(span=span).mean()), ("r", lambda s: s.ewm(span=span, adjust=False).mean()), ("s", lambda s: s.ewm(span=span).std())):
        want = pdf.sort_values(["symbol", "date"]).groupby("symbol")["close"].transform(f)
        np.testing.assert_allclose(got[out].astype(float).values, want.values, rtol=1e-7, atol=1e-9, err_msg=out)


def test_smoothing_needs_one_sort_however_many_spans(spark):
    from tidepanel.operators import technical as t
    sdf, _ = walk(spark, 60)
    for d in (t.ewm_vol(t.returns(sdf)), t.macd(sdf), t.ema(sdf), t.price_to_ma(sdf)):
        plan = d._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert plan.count("Sort [") <= 2 and plan.count("Exchange hashpartitioning") <= 2


def test_tail_and_memory_windows_like_numpy(spark):
    from tidepanel.operators import technical as t
    from pyspark.sql import functions as F
    rng = np.random.default_rng(8)
    x = rng.normal(size=160)
    x[40], x[60:115] = np.nan, 0.25  # a gap, then equal values
    rows = [("A", i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)] + [("B", i, 0.1) for i in range(30)]
    sdf = spark.createDataFrame(rows[::-1], "symbol string, date int, ret double")
    d = t.hurst(t.autocorr(t.cvar(sdf), 50, (1, 5)), 30, 5)
    plan = t.hurst(sdf)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "sliding" not in plan
    got = d.where("symbol = 'A'").orderBy("date").toPandas()
    for n in (20, 50):
        for p, tag in ((0.05, "5"), (0.01, "1")):
            q = pd.Series(x).rolling(n).quantile(p)
            np.testing.assert_allclose(got[f"var_{tag}_{n}"].astype(float), q, rtol=1e-9)
            tail = [np.nan if np.isnan(q[i]) else (lambda w: w[w <= np.quantile(w, p)].mean())(x[i + 1 - n:i + 1]) for i in range(len(x))]
            np.testing.assert_allclose(got[f"cvar_{tag}_{n}"].astype(float), tail, rtol=1e-9)
    for k in (1, 5):
        want = [np.nan] * len(x)
        for i in range(49, len(x)):
            w = x[i - 49:i + 1]
            if not np.isnan(w).any() and np.ptp(w[k:]) > 0 and np.ptp(w[:-k]) > 0:
                want[i] = np.corrcoef(w[k:], w[:-k])[0, 1]
        np.testing.assert_allclose(got[f"autocorr_lag_{k}"].astype(float), want, rtol=1e-7, atol=1e-12)
    w = x[120:150]
    want = 2 * np.polyfit(np.log([2, 3, 4]), [np.log(np.std(w[k:] - w[:-k])) / 2 for k in (2, 3, 4)], 1)[0]
    assert abs(got["hurst"][149] - want) < 1e-9 and np.isnan(got["hurst"][100])
    assert d.where("symbol = 'B' and (var_5_20 is null) = (date < 19) and hurst is null and autocorr_lag_1 is null").count() == 30


def test_rounding_by_arithmetic_equals_duckdb(spark):
    from tidepanel.core.frames import rnd
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=20000) * 10.0 ** rng.integers(-9, 9, 20000), [0.0, -0.0, 8323560225.3850565, 0.1234565, -2.5e-7, 0.5, -0.5]])
    d = spark.createDataFrame(pd.DataFrame({"i": np.arange(len(x)), "x": x}))
    for n in (2, 4, 6):
        got = rnd(d, n).orderBy("i").toPandas()["x"]
        want = _duck(x).sql(f"SELECT round(x + {3.7 * 10.0 ** -(n + 3)!r}::DOUBLE, {n}) + 0.0::DOUBLE AS x FROM d ORDER BY i").df()["x"]
        assert (got.to_numpy() == want.to_numpy()).all() and not np.signbit(got[got == 0]).any()
    rest = rnd(spark.createDataFrame([(1e300,), (float("inf"),), (None,), (-1e17 / 3,), (1e305,)], "x double"))
    assert [r[0] for r in rest.collect()] == [1e300 * 1e6 / 1e6, float("inf"), None, -1e17 / 3 * 1e6 / 1e6, 1e305]
    assert "round(" not in rest._jdf.queryExecution().optimizedPlan().toString().lower()


def _duck(x):
    import duckdb
    con = duckdb.connect()
    con.execute("CREATE TABLE d AS SELECT unnest(?::BIGINT[]) AS i, unnest(?::DOUBLE[]) AS x", [list(range(len(x))), [float(v) for v in x]])
    return con


def test_shuffles_start_with_partitions_that_follow_the_input(spark, sf):
    from tidepanel.core import session
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    paths = [f"{sf}/lineitem.parquet", f"{sf}/none.parquet"]
    try:
        session.spread(spark, paths, 1000)
        many = int(spark.conf.get(key))
        assert many > 50
        session.spread(spark, paths)
        assert int(spark.conf.get(key)) == int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.conf.set(key, "7")
        session.spread(spark, paths, 1000)
        assert spark.conf.get(key) == "7"
    finally:
        spark.conf.unset(key)


def test_profile_keeps_few_figures_a_day(spark):
    from tidepanel.operators import quality as q
    d = spark.createDataFrame([("A", 1, None, -1.0, 0.0), ("A", 1, float("inf"), 2.0, 3.0), ("A", 2, 1.0, None, None)], "symbol string, date int, x double, y double, volume double")
    p = q.profile(d, ["x", "y", "volume"])
    r = p.first()
    assert (r["rows"], r["missing"], r["infinite"], r["negative"], r["zero_volume"], r["duplicate_dates"], r["first_date"], r["last_date"]) == (3, 3, 1, 1, 1, 1, 1, 2)
    assert len(p._jdf.queryExecution().analyzed().child().output().mkString(",").split(",")) <= 7


def test_both_ranks_of_an_information_coefficient_come_from_one_stored_table(spark, monkeypatch):
    from tidepanel.core import ordering
    from tidepanel.operators import aggregates
    stored = []
    for module in (ordering, aggregates):
        keep = module.materialise
        monkeypatch.setattr(module, "materialise", lambda df, name="stage", keep=keep: stored.append(name) or keep(df, name))
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"x": rng.integers(0, 40, 600).astype(float), "z": rng.normal(size=600)})
    pdf["y"] = pdf["x"] + rng.integers(0, 30, 600)
    sdf = spark.createDataFrame(pdf)
    got = {r["feature"]: r["ic"] for r in aggregates.information_coefficient(sdf, ["x", "z"], "y").collect()}
    np.testing.assert_allclose([got["x"], got["z"]], [pdf[c].rank().corr(pdf["y"].rank()) for c in ("x", "z")], rtol=1e-9)
    assert stored.count("rank") == 1


def test_features_are_neither_stored_nor_made_for_nobody(spark, monkeypatch):
    from tidepanel.core import ordering
    from tidepanel.plans import pipelines
    stored = []
    for module in (ordering, pipelines):
        keep = module.materialise
        monkeypatch.setattr(module, "materialise", lambda df, name="stage", keep=keep: stored.append(name) or keep(df, name))
    _, pdf = walk(spark, 40, list("ABCDE"))
    pdf = pd.concat([pdf, pdf[pdf["symbol"] == "A"].assign(symbol="F"), pdf[pdf["symbol"] == "B"].iloc[30:].assign(symbol="G")])  # a tie, a short history
    sdf = spark.createDataFrame(pdf)
    sectors = spark.createDataFrame([(s, "x" if s in "ABF" else "y") for s in "ABCDEFG"], "symbol string, sector string")
    wanted = ["symbol", "date", "sector", "ret", "sma_20", "momentum_20", "momentum_20_cs_rank", "momentum_20_cs_zscore", "momentum_20_sector_rank"]
    got = pipelines.engineer(sdf, sectors)
    plan = got.select(*wanted)._jdf.queryExecution().executedPlan().toString()
    assert not stored and plan.count("Exchange hashpartitioning(date") == 1 and "obv" not in plan and "_gain" not in plan
    frame = got.toPandas().sort_values(["symbol", "date"], ignore_index=True)
    x = frame["momentum_20"]
    np.testing.assert_allclose(x, frame.groupby("symbol")["close"].pct_change(20), rtol=1e-9)
    day, part = x.groupby(frame["date"]), x.groupby([frame["date"], frame["sector"]])
    np.testing.assert_allclose(frame["momentum_20_cs_rank"], day.rank(method="min") / day.transform("count"))
    np.testing.assert_allclose(frame["momentum_20_sector_rank"], part.rank() / part.transform("count"))
    spread = day.transform("std")
    np.testing.assert_allclose(frame["momentum_20_cs_zscore"], ((x - day.transform("mean")) / spread).where(spread > 0, 0.0), atol=1e-9)
    # dates beyond the limit: stored features and joined ranks, the same figures
    monkeypatch.setattr(pipelines, "LIMIT", 3)
    large = pipelines.engineer(sdf, sectors).toPandas().sort_values(["symbol", "date"], ignore_index=True)
    assert stored == ["features"] and set(large.columns) == set(frame.columns)
    pd.testing.assert_frame_equal(large[frame.columns], frame)


def test_a_bound_beyond_the_limit_is_counted_again(hot):
    sdf, pdf = hot
    got = grouped_rank(sdf, ["k"], "x", "r", limit=100, most=len(pdf)).toPandas().set_index("id").sort_index()["r"]
    want = pdf.set_index("id").groupby("k")["x"].rank() / pdf.set_index("id").groupby("k")["x"].transform("count")
    np.testing.assert_allclose(got, want)
