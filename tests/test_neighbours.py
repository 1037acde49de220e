"""Imputation from nearest rows against exact neighbours."""
import numpy as np
import pandas as pd
import pytest

from tidepanel.operators import neighbours


def exact(pdf, target, features, k):
    x = pdf[features].to_numpy(float)
    x = (x - np.nanmean(x, 0)) / np.where(np.nanstd(x, 0) > 0, np.nanstd(x, 0), 1)
    full = ~np.isnan(x).any(1)
    y = pdf[target].to_numpy(float)
    donors = np.flatnonzero(full & ~np.isnan(y))
    out, near = y.copy(), {}
    for i in np.flatnonzero(np.isnan(y)):
        if not full[i] or not len(donors):
            out[i] = np.nanmean(y)
            continue
        d = np.sqrt(((x[donors] - x[i]) ** 2).sum(1))
        best = donors[np.lexsort((pdf["date"].to_numpy()[donors], pdf["symbol"].to_numpy()[donors], d))[:k]]
        out[i], near[i] = y[best].mean(), set(best)
    return out, near


def data(n, d, seed):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({f"x{i}": rng.normal(size=n) * (i + 1) for i in range(d)})
    pdf.insert(0, "symbol", rng.choice(["a", "b"], n))
    pdf.insert(1, "date", pd.date_range("2020-01-01", periods=n))
    pdf["y"] = pdf["x0"] * 2 + rng.normal(size=n)
    pdf.loc[rng.choice(n, n // 12, False), "y"] = np.nan
    return pdf


def run(spark, pdf, features, bucket, k=5):
    sdf = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "symbol string, date timestamp, " + ", ".join(f"{f} double" for f in features) + ", y double")
    return neighbours.impute(sdf, "y", features, k, bucket=bucket).toPandas().sort_values("date")["y"].to_numpy(float)


@pytest.mark.parametrize(("d", "bucket"), [(1, 50), (2, 40), (3, 100)])
def test_equal_to_exact_neighbours(spark, d, bucket):
    pdf = data(900, d, d)
    features = [f"x{i}" for i in range(d)]
    pdf.loc[5, "x0"] = np.nan
    pdf.loc[[6, 7, 8], "y"] = np.nan
    pdf.loc[6, "x0"] = np.nan
    np.testing.assert_allclose(run(spark, pdf, features, bucket), exact(pdf, "y", features, 5)[0], rtol=1e-9)


def test_recall_without_proof_and_equal_rows(spark, monkeypatch):
    from pyspark.sql import functions as F
    pdf = data(1500, 6, 4)
    features = [f"x{i}" for i in range(6)]
    _, near = exact(pdf, "y", features, 5)
    z = pdf[features].to_numpy()
    z = (z - z.mean(0)) / z.std(0)
    rows = [(i, *map(float, v), str(s), t.to_pydatetime(), None if np.isnan(y) else float(y)) for i, (v, s, t, y) in enumerate(zip(z, pdf["symbol"], pdf["date"], pdf["y"], strict=True))]
    sdf = spark.createDataFrame(rows, "id long, " + ", ".join(f"z{i} double" for i in range(6)) + ", symbol string, date timestamp, _y double")
    zs = [f"z{i}" for i in range(6)]
    place = {t.to_pydatetime(): i for i, t in enumerate(pdf["date"])}
    got = neighbours.nearest(sdf.where("_y is null"), sdf.where("_y is not null"), zs, ["symbol", "date"], 5, bucket=150, rounds=0).collect()
    recall = np.mean([len(near[r["id"]] & {place[s["date"]] for s in r["near"]}) / 5 for r in got])
    assert len(got) == len(near) and recall > 0.9 and not all(r["proven"] for r in got)
    assert all({place[s["date"]] for s in r["near"]} == near[r["id"]] for r in got if r["proven"])
    same = pdf.assign(x0=1.0, x1=2.0)[["symbol", "date", "x0", "x1", "y"]]
    np.testing.assert_allclose(run(spark, same, ["x0", "x1"], 60), exact(same, "y", ["x0", "x1"], 5)[0], rtol=1e-9)


def test_nothing_complete_and_empty(spark):
    pdf = data(20, 2, 1).assign(x1=np.nan)
    np.testing.assert_allclose(run(spark, pdf, ["x0", "x1"], 10), pdf["y"].fillna(pdf["y"].mean()))
    assert len(run(spark, pdf.iloc[:0], ["x0", "x1"], 10)) == 0


def test_one_more_look_proves_all(spark, monkeypatch):
    """Rows far from all others, too, and complete rows are not dealt more than twice."""
    deals = []
    dealt = neighbours._dealt
    monkeypatch.setattr(neighbours, "_dealt", lambda *a: deals.append(a[5]) or dealt(*a))
    pdf = data(2000, 3, 9)
    pdf.loc[[3, 4], "x1"] = [40.0, -60.0]
    pdf.loc[[3, 4], "y"] = np.nan
    features = ["x0", "x1", "x2"]
    np.testing.assert_allclose(run(spark, pdf, features, 30), exact(pdf, "y", features, 5)[0], rtol=1e-9)
    assert len([keep for keep in deals if "_y" in keep]) <= 2
