"""Point-in-time ranks and scaling against plain counting; later rows change nothing."""
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.core import history
from tidepanel.operators.selection import normal_score


def plain(pdf, keys, time, value):
    out = []
    for _, r in pdf.iterrows():
        if pd.isna(r[value]):
            continue
        known = pdf[(pdf[keys] == r[keys]).all(axis=1) & (pdf[time] <= r[time]) & pdf[value].notna()][value] if keys else pdf[(pdf[time] <= r[time]) & pdf[value].notna()][value]
        out.append((*r[keys], r[time], r[value], int((known < r[value]).sum()), int((known == r[value]).sum()), len(known)))
    return sorted(set(out))


@pytest.fixture(scope="module")
def panel():
    rng = np.random.default_rng(5)
    n = 700
    pdf = pd.DataFrame({"g": rng.choice(["hot", "hot", "hot", "b", "c"], n), "date": pd.to_datetime("2020-01-01") + pd.to_timedelta(rng.integers(0, 90, n), unit="D"),
                        "x": np.round(rng.normal(size=n), 1), "n": 1})
    pdf.loc[rng.choice(n, 40, False), "x"] = np.nan
    return pdf


def frame(spark, pdf):
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "g string, date timestamp, x double, n int")


def test_dominance_is_counting():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 17, 64, 300):
        t, v, w = rng.integers(0, 9, n), rng.integers(0, 7, n).astype(float), rng.integers(1, 5, n)
        for strict in (False, True):
            got = history.dominance(t, v, w, strict)
            for i in range(n):
                seen = t < t[i] if strict else t <= t[i]
                assert [g[i] for g in got] == [w[seen & (v < v[i])].sum(), w[seen & (v == v[i])].sum(), w[seen].sum()]


@pytest.mark.parametrize("block", [1 << 17, 40])
@pytest.mark.parametrize("keys", [["g"], []])
def test_positions(spark, panel, block, keys):
    got = history.expanding_positions(frame(spark, panel), keys, "date", "x", block).toPandas()
    assert sorted(got.itertuples(index=False, name=None)) == plain(panel, keys, "date", "x")


def test_later_rows_change_no_past_figure(spark, panel):
    cut = pd.Timestamp("2020-02-10")
    whole, part = frame(spark, panel), frame(spark, panel[panel.date < cut])
    rank = lambda df: history.expanding_rank(df, ["g"], "date", "x", "r", 50).where(F.col("date") < cut).toPandas().sort_values(["g", "date", "x"], ignore_index=True)
    scale = lambda df: history.expanding_uniform(history.expanding_standard(df, "date", ["x"]), "date", ["x"], block=50).where(F.col("date") < cut).toPandas().sort_values(["g", "date", "x"], ignore_index=True)
    for f in (rank, scale):
        pd.testing.assert_frame_equal(f(whole), f(part))
    got = rank(whole)
    assert len(got) == (panel.date < cut).sum() and got["r"].isna().sum() == panel[panel.date < cut]["x"].isna().sum() and got["r"].max() == 1


def test_empty_and_single(spark, panel):
    none, one = frame(spark, panel.iloc[:0]), frame(spark, panel[panel.x.notna()].iloc[:1])
    assert history.expanding_rank(none, ["g"], "date", "x", "r").count() == 0
    assert history.expanding_rank(one, ["g"], "date", "x", "r").first()["r"] == 1.0
    assert history.expanding_uniform(one, "date", ["x"]).first()["x_uniform"] is None


def test_normal_scores(spark):
    ps = [1e-9, 1e-7, 1e-4, 0.02, 0.074, 0.076, 0.3, 0.5, 0.77, 0.95, 0.9999, 1.0]
    got = [r["z"] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(normal_score(F.col("p")).alias("z")).collect()]
    np.testing.assert_allclose(got, [statistics.NormalDist().inv_cdf(min(max(p, 1e-7), 1 - 1e-7)) for p in ps], rtol=1e-12, atol=1e-15)
