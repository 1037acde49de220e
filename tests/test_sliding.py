"""Order statistics of sliding windows against sorting every window."""
import numpy as np
import pandas as pd
import pytest

from tests.conftest import walk
from tidepanel.core import sliding
from tidepanel.operators import technical


def test_order_statistics_of_runs():
    rng = np.random.default_rng(4)
    for n, span in ((1, 1), (2, 3), (50, 6), (333, 1000), (64, 1)):
        x = rng.integers(0, span, n) / 4
        lo = rng.integers(0, n, 200)
        hi = np.minimum(n, lo + rng.integers(1, n + 1, 200))
        r, k, limit = sliding.Ranks(x), rng.integers(0, hi - lo), rng.normal(span / 8, span, 200)
        np.testing.assert_array_equal(r.kth(lo, hi, k), [np.sort(x[a:b])[c] for a, b, c in zip(lo, hi, k, strict=True)])
        np.testing.assert_array_equal(r.up_to(lo, hi, limit), [(x[a:b] <= v).sum() for a, b, v in zip(lo, hi, limit, strict=True)])
        m, d = sliding.median_and_deviation(x, lo, hi)
        want = [(np.median(x[a:b]), np.median(np.abs(x[a:b] - np.median(x[a:b])))) for a, b in zip(lo, hi, strict=True)]
        np.testing.assert_allclose(np.stack([m, d], 1), want, rtol=1e-13, atol=1e-14)


@pytest.mark.parametrize("window", [None, 15, 4])
def test_robust_roll(spark, window):
    sdf, pdf = walk(spark, 150)
    pdf.loc[pdf.index % 7 == 3, "close"] = np.nan
    pdf.loc[(pdf.symbol == "B") & (pdf.index % 150 > 100), "close"] = 5.0
    sdf = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), sdf.schema)
    out = technical.robust_roll(sdf, "close", window, 4, "r")
    assert "collect_list" not in out._jdf.queryExecution().toString()
    got = out.orderBy("symbol", "date").toPandas()["r"].to_numpy(float)

    def one(s):
        frames = [s.iloc[max(0, i + 1 - window) if window else 0:i + 1].dropna() for i in range(len(s))]
        spread = [np.median(np.abs(f - f.median())) if len(f) >= 4 else np.nan for f in frames]
        return pd.Series([(v - f.median()) / d if d and d > 0 else np.nan for v, f, d in zip(s, frames, spread, strict=True)], index=s.index)

    want = pdf.sort_values(["symbol", "date"]).groupby("symbol")["close"].transform(one).to_numpy(float)
    np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-12)
    assert technical.robust_roll(sdf.limit(0), "close", window).count() == 0
