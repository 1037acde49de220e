import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.models import factors as fm, gram as g, sparse_bayes as sb
from tidepanel.core.session import ship
from tidepanel.operators import cross_section as cs, pairs


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    n = 600
    x = rng.normal(size=(n, 4))
    y = 1.5 * x[:, 0] - 0.7 * x[:, 2] + rng.normal(0, 0.5, n)
    p = rng.dirichlet([1, 1, 1], n)
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(y=y, key="K", date=pd.date_range("2020-01-01", periods=n), fold=np.arange(n) % 5)
    sdf = spark.createDataFrame(pdf.assign(p0=p[:, 0], p1=p[:, 1], p2=p[:, 2])).withColumn("probs", F.array("p0", "p1", "p2"))
    return sdf, pdf, x, y, p


def direct(x, y, iters):
    """Laplace-prior updates on the raw rows, as an independent check of the Gram form."""
    d = x.shape[1]
    m, s = np.zeros(d), np.eye(d)
    for _ in range(iters):
        a = np.sqrt(2) / np.sqrt(m ** 2 + np.diag(s))
        s = np.linalg.inv(x.T @ x + np.diag(a))
        m = s @ x.T @ y
    return m, s, np.clip(1 - a * np.diag(s), 0, 1)


def test_sparse_fit_from_gram(rows):
    sdf, _, x, y, _ = rows
    r = sb.fit(sdf, ["key"], list("abcd"), "y").first()
    m, s, gamma = direct(x, y, r["iterations"])
    np.testing.assert_allclose(r["coef"], m, rtol=1e-8)
    np.testing.assert_allclose(r["cov"], s, rtol=1e-7)
    np.testing.assert_allclose(r["gamma"], gamma, rtol=1e-6)
    pred = sb.predict(sdf, sb.fit(sdf, ["key"], list("abcd"), "y"), ["key"], list("abcd")).orderBy("date").toPandas()
    np.testing.assert_allclose(pred["prediction"], x @ m, rtol=1e-7, atol=1e-9)
    np.testing.assert_allclose(pred["uncertainty"], np.sqrt(np.einsum("ij,jk,ik->i", x, s, x) + 1), rtol=1e-7)


@pytest.mark.parametrize("prior", sb.PRIORS)
def test_every_prior_converges(rows, prior):
    r = sb.fit(rows[0], ["key"], list("abcd"), "y", prior).first()
    assert np.isfinite(r["elbo"]) and r["converged"] and abs(r["coef"][0] - 1.5) < 0.2
    assert not sb.fit(rows[0], ["key"], list("abcd"), "y", prior, max_iter=2).first()["converged"]


@pytest.mark.parametrize("prior", sb.PRIORS[:2])
def test_the_bound_never_falls(rows, prior):
    _, _, x, y, _ = rows
    args = (x.T @ x, x.T @ y, float(y @ y), len(y), prior)
    bounds = [sb.solve(*args, max_iter=k)["elbo"] for k in range(2, 12)]
    if prior == "horseshoe":  # every factor maximises the same bound
        assert all(b >= a - 1e-7 for a, b in zip(bounds, bounds[1:]))
    assert np.isfinite(bounds).all()


def test_regime_fit_and_predictions(rows):
    sdf, _, x, y, p = rows
    fits = sb.fit_regimes(sdf, ["key"], list("abcd"), "y")
    f = {r["regime"]: np.array(r["coef"]) for r in fits.collect()}
    assert set(f) == {0, 1, 2}
    w = p[:, 1] * len(y) / p[:, 1].sum()
    m, _, _ = direct(x * np.sqrt(w)[:, None], y * np.sqrt(w), 200)
    np.testing.assert_allclose(f[1], m, rtol=1e-4, atol=1e-5)
    pred = sb.predict_regimes(sdf, fits, ["key"], list("abcd")).orderBy("date").toPandas()
    np.testing.assert_allclose(pred["prediction"], sum(p[:, k] * (x @ f[k]) for k in f), rtol=1e-7, atol=1e-9)
    best = sb.predict_regimes(sdf, fits, ["key"], list("abcd"), "best_regime").orderBy("date").toPandas()
    np.testing.assert_allclose(best["prediction"], [x[i] @ f[int(np.argmax(p[i]))] for i in range(len(x))], rtol=1e-7, atol=1e-9)
    cv = sb.cross_validate(sdf, ["key"], list("abcd"), "y").collect()
    assert all(r["folds"] == 5 and 0.15 < r["mean_cv_score"] < 0.4 for r in cv)
    w = sb.ensemble_weights(fits, sb.cross_validate(sdf, ["key"], list("abcd"), "y"), ["key"]).toPandas()
    assert abs(w["weight"].sum() - 1) < 1e-9


def test_dynamic_selection_windows(rows):
    out = sb.dynamic_selection(rows[0], ["key"], list("abcd"), "y", window=120, step=30, least_p=0.1).toPandas()
    assert (out.groupby("regime").size() == 17).all() and out["n"].eq(120).all()


def test_orthogonal_residuals(spark):
    rng = np.random.default_rng(2)
    f = rng.normal(size=(300, 3)) @ np.array([[1, .5, .2], [0, 1, .3], [0, 0, 1]])
    sdf = spark.createDataFrame(pd.DataFrame(f, columns=["m", "s", "h"]))
    got = fm.orthogonalise(sdf, ["m", "s", "h"]).toPandas()
    x = f[:, :2] - f[:, :2].mean(0)
    y = f[:, 2] - f[:, 2].mean()
    b = np.linalg.solve(x.T @ x + 0.01 * np.eye(2), x.T @ y)
    np.testing.assert_allclose(got["h_orth"], y - x @ b, atol=1e-9)


def test_rolling_rank_correlation(spark):
    rng = np.random.default_rng(4)
    n = 90
    pdf = pd.DataFrame({"series": "S", "date": pd.date_range("2020-01-01", periods=n), "x": rng.integers(0, 9, n).astype(float), "y": rng.normal(size=n)})
    r = cs.rolling_ic(spark.createDataFrame(pdf), ["x"], "y", lookback=30).first()
    ics = [pdf["x"][i - 30:i].rank().corr(pdf["y"][i - 30:i].rank()) for i in range(30, n)]
    assert r["windows"] == len(ics)
    np.testing.assert_allclose([r["ic_mean"], r["ic_std"]], [np.mean(ics), np.std(ics)], rtol=1e-9)


def test_blocked_pairs_equal_pandas(spark):
    rng = np.random.default_rng(6)
    wide = pd.DataFrame(rng.normal(size=(60, 23)), index=pd.date_range("2020-01-01", periods=60), columns=[f"s{i:02d}" for i in range(23)])
    wide = wide.mask(rng.random(wide.shape) < 0.3)
    long = wide.stack().rename("ret").reset_index().set_axis(["date", "symbol", "ret"], axis=1)
    for block in (128, 5):
        got = pairs.covariance(pairs.pair_moments(spark.createDataFrame(long), block=block)).toPandas()
        assert len(got) == 23 * 24 // 2 and (got["a"] <= got["b"]).all()
        cov, cor = wide.cov(), wide.corr()
        np.testing.assert_allclose(got["cov"], [cov.loc[a, b] for a, b in zip(got["a"], got["b"])], atol=1e-12)
        np.testing.assert_allclose(got["corr"], [cor.loc[a, b] for a, b in zip(got["a"], got["b"])], atol=1e-12)


def test_pairs_summarised_in_their_blocks_equal_pandas(spark):
    rng = np.random.default_rng(16)
    wide = pd.DataFrame(rng.normal(size=(50, 19)), index=pd.date_range("2020-01-01", periods=50), columns=[f"s{i:02d}" for i in range(19)])
    wide = wide.mask(rng.random(wide.shape) < 0.3)
    wide["s05"] = 1.0
    long = wide.stack().rename("ret").reset_index().set_axis(["date", "symbol", "ret"], axis=1).assign(g=1)
    book = pd.Series(rng.normal(size=12), index=wide.columns[3:15])
    sdf, cor, cov = spark.createDataFrame(long), wide.corr(min_periods=20), wide.cov()
    seen = [(a, b) for i, a in enumerate(wide.columns) for b in wide.columns[i + 1:]]
    enough = {(a, b) for a, b in seen if (wide[a].notna() & wide[b].notna()).sum() >= 20}
    for block in (128, 4):
        got = pairs.correlation_totals(sdf, True, 20, block=block).toPandas().set_index("a")
        for a, row in got.iterrows():
            c = np.array([cor.loc[p] for p in enough if p[0] == a])
            assert row["pairs"] == len(c) and row["known"] == (~np.isnan(c)).sum()
            if row["known"]:
                np.testing.assert_allclose([row["s"], row["top"]], [np.nansum(c), np.nanmax(np.abs(c))], rtol=1e-9)
        total = pairs.correlation_totals(sdf, False, 20, ["g"], block=block).first()
        assert total["pairs"] == len(enough)
        got = pairs.marginal_risk(sdf, spark.createDataFrame(book.rename("weight").rename_axis("symbol").reset_index()), block=block).toPandas().set_index("symbol")["marginal"]
        np.testing.assert_allclose(got.sort_index(), (cov[book.index] @ book).loc[sorted(got.index)], atol=1e-12)
    assert pairs.correlation_totals(sdf.limit(0), True, 20).count() == 0 and pairs.correlation_totals(sdf.limit(0), False, 20).first()["pairs"] is None


def _pca(wide, k):
    x = wide.fillna(0.0)
    x = ((x - x.mean()) / x.std()).to_numpy()
    _, s, v = np.linalg.svd(x, full_matrices=False)
    v = v[:k] * np.sign(v[:k][np.arange(k), np.abs(v[:k]).argmax(1)])[:, None]
    left = x - x @ v.T @ v
    return v.T, s[:k] ** 2 / (s ** 2).sum(), left.var(axis=0, ddof=1)


@pytest.mark.parametrize(("assets", "dates", "block"), [(4, 60, 32), (25, 40, 32), (1000, 80, 12)])
def test_components_of_narrow_and_wide_universes_match_numpy(spark, assets, dates, block):
    from tidepanel.models.components import principal_components
    rng = np.random.default_rng(assets)
    r = rng.normal(size=(dates, 3)) * [3.0, 2.0, 1.2] @ rng.normal(size=(3, assets)) + rng.normal(size=(dates, assets)) * 0.5
    wide = pd.DataFrame(r, index=pd.date_range("2024-01-01", periods=dates), columns=[f"a{i:04d}" for i in range(assets)])
    wide = wide.mask(rng.random(wide.shape) < 0.05)
    long = wide.rename_axis("date").reset_index().melt("date", var_name="asset", value_name="ret")
    out = principal_components(spark.createDataFrame(long.astype(object).where(long.notna(), None), "date timestamp, asset string, ret double"), 2, block=block)
    got = out.toPandas().pivot(index="asset", columns="factor", values=["exposure", "explained", "specific_var"]).sort_index()
    load, share, left = _pca(wide, 2)
    np.testing.assert_allclose(got["exposure"].to_numpy(), load, atol=1e-5)
    np.testing.assert_allclose(got["explained"].iloc[0], share, rtol=1e-6)
    np.testing.assert_allclose(got["specific_var"][0], left, atol=1e-5)


def test_cross_sectional_regression(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"date": np.repeat(pd.date_range("2020-01-01", periods=3), 40), "e": rng.normal(size=120)})
    pdf["ret"] = 0.3 + 2.0 * pdf["e"]
    got = fm.cross_sectional_factors(spark.createDataFrame(pdf), ["e"]).toPandas()
    np.testing.assert_allclose(got[["intercept", "e"]].values, [[0.3, 2.0]] * 3, atol=1e-5)


def _em(x, k, rounds):
    """Plain mixture from quantile ranges of the last column; weights, means, covariances and log likelihoods."""
    cuts = np.quantile(x[:, -1], [c / k for c in range(1, k)])
    r = np.eye(k)[(x[:, -1][:, None] > cuts).sum(1)]
    for i in range(rounds + 1):
        n = r.sum(0)
        w, m = n / len(x), (r.T @ x) / n[:, None]
        v = [((r[:, c:c + 1] * (x - m[c])).T @ (x - m[c])) / n[c] + 1e-6 * np.eye(x.shape[1]) for c in range(k)]
        g = np.stack([np.log(w[c]) - 0.5 * (np.einsum("ni,ij,nj->n", x - m[c], np.linalg.inv(v[c]), x - m[c]) + np.linalg.slogdet(v[c])[1] + x.shape[1] * np.log(2 * np.pi)) for c in range(k)], 1)
        top = g.max(1, keepdims=True)
        e = np.exp(g - top)
        r = e / e.sum(1, keepdims=True)
    return w, m, v, float((top[:, 0] + np.log(e.sum(1))).sum()), r


def test_mixtures_of_all_keys_match_plain_em_and_do_not_depend_on_partitions(spark):
    from tidepanel.models import mixtures
    rng = np.random.default_rng(1)
    frames = []
    for s, n in (("A", 300), ("B", 90), ("C", 1)):
        z = rng.normal(size=(n, 3)) * np.where(np.arange(n) % 3 == 0, 3.0, 0.5)[:, None]
        frames.append(pd.DataFrame({"series": s, "date": pd.date_range("2020-01-01", periods=n), "x": z[:, 0], "y": z[:, 0] * 0.5 + z[:, 1], "z": np.abs(z[:, 2])}))
    pdf = pd.concat(frames)
    sdf = spark.createDataFrame(pdf)
    features = ["x", "y", "z"]
    fits = [mixtures.fit(d, features, 2, 6).toPandas().set_index("series") for d in (sdf.coalesce(1), sdf.repartition(7))]
    np.testing.assert_allclose(fits[0].astype(float), fits[1].loc[fits[0].index].astype(float), rtol=1e-8, atol=1e-10)
    got = mixtures.criteria(sdf, mixtures.fit(sdf, features, 2, 6), features, 2).toPandas().set_index(["series", "component"])
    for s in ("A", "B"):
        w, m, v, ll, _ = _em(pdf.loc[pdf.series == s, features].to_numpy(), 2, 6)
        for place, c in enumerate(np.argsort([np.trace(c) for c in v])):
            g = got.loc[(s, place)]
            np.testing.assert_allclose([g["weight"], *g["mean"], *g["cov"]], [w[c], *m[c], *v[c][np.tril_indices(3)]], rtol=1e-6, atol=1e-9)
            np.testing.assert_allclose(g["log_likelihood"], ll, rtol=1e-8)
    assert len(got) == 6 and np.isfinite(got.loc["C"]["weight"].astype(float)).all()
    empty = sdf.limit(0)
    assert mixtures.criteria(empty, mixtures.fit(empty, features, 2, 2), features, 2).count() == 0


def test_gmm_likelihood_and_probabilities(spark):
    from tidepanel.operators import regimes_ml as rm
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(0, 0.1, 150), rng.normal(0, 1.5, 150)])
    pdf = pd.DataFrame({"series": "S", "date": pd.date_range("2020-01-01", periods=300), "x": v, "z": np.abs(v)})
    sdf = spark.createDataFrame(pdf)
    out = rm.gmm(sdf, ["x", "z"], 2).toPandas()
    np.testing.assert_allclose([sum(p) for p in out["probs"]], 1.0)
    calm = out.sort_values("date")["regime"].values
    assert (calm[:150] == 0).mean() > 0.8 and (calm[150:] == 1).mean() > 0.6
    c = rm.gmm_criteria(sdf, ["x", "z"], 2).first()
    assert c["n_params"] == 11 and c["bic"] > c["aic"]


def test_break_states_and_lengths(spark):
    from tidepanel.operators import regimes_ml as rm
    days = pd.date_range("2020-01-01", periods=30)
    rows = spark.createDataFrame(pd.DataFrame({"series": ["a"] * 30 + ["b"] * 5, "date": [*days, *days[:5]], "v": 1.0}))
    breaks = spark.createDataFrame([("a", i, days[i].to_pydatetime()) for i in (10, 22, 28)], "series string, position long, date timestamp")
    got = {r["series"]: (r["n_breaks"], r["regime_lengths"]) for r in rm.break_statistics(breaks, rows).collect()}
    assert got == {"a": (3, [10, 12, 6, 2]), "b": (0, [5])}
    s = rm.break_states(rows, breaks).where("series = 'a'").orderBy("date").toPandas()["regime"].tolist()
    assert s == [0] * 10 + [1] * 12 + [2] * 8


def test_histories_are_sent_to_few_blocks(spark, monkeypatch):
    assert [pairs.block_count(n) for n in (0, 5, 1000, 60_000, 360_000, 1_000_000)] == [1, 1, 8, 32, 32, 62]
    rng = np.random.default_rng(26)
    wide = pd.DataFrame(rng.normal(size=(40, 17)), index=pd.date_range("2020-01-01", periods=40), columns=list(range(100, 117))).mask(rng.random((40, 17)) < 0.3)
    long = wide.stack().rename("ret").reset_index().set_axis(["date", "symbol", "ret"], axis=1)
    monkeypatch.setattr(pairs, "SPREAD", 2)
    monkeypatch.setattr(pairs, "TILE", 3)
    sent = pairs.asset_covariance(spark.createDataFrame(long), block=1)
    got = sent.toPandas()
    assert len(got) == 17 * 18 // 2 and (got["a"] <= got["b"]).all() and got.duplicated(["a", "b"]).sum() == 0
    np.testing.assert_allclose(got["cov"], [wide.cov().loc[a, b] for a, b in zip(got["a"], got["b"])], atol=1e-12)


def test_histories_are_sent_to_fewer_bands_with_short_days(spark):
    assert [pairs.band_count(n) for n in (0, 5, 1000, 60_000, 360_000, 1_000_000)] == [1, 1, 8, 12, 22, 62]
    rng = np.random.default_rng(27)
    wide = pd.DataFrame(rng.normal(size=(30, 15)), columns=[f"s{i:02d}" for i in range(15)]).mask(rng.random((30, 15)) < 0.3)
    # whole days, days far apart, odd hours, dates, plain numbers
    for index, short in ((pd.date_range("1969-12-20", periods=30), True), (pd.date_range("1900-01-01", periods=30, freq="1500D"), False),
                         (pd.date_range("2020-01-01", periods=30, freq="7h"), False), (pd.date_range("2020-01-01", periods=30).date, False), (range(30), False)):
        long = wide.set_axis(index).stack().rename("ret").reset_index().set_axis(["date", "symbol", "ret"], axis=1)
        moments = pairs.pair_moments(spark.createDataFrame(long), block=2)
        assert ("as smallint" in moments._jdf.queryExecution().toString()) == short
        got = pairs.covariance(moments).toPandas()
        assert len(got) == 15 * 16 // 2 and (got["a"] <= got["b"]).all()
        np.testing.assert_allclose(got["cov"], [wide.cov().loc[a, b] for a, b in zip(got["a"], got["b"])], atol=1e-12)


def test_many_pairs_leave_a_task_in_small_batches(spark):
    days = pd.date_range("2020-01-01", periods=3)
    rng = np.random.default_rng(28)
    wide = pd.DataFrame(rng.normal(size=(3, 1100)), index=days)
    long = wide.stack().rename("ret").reset_index().set_axis(["date", "symbol", "ret"], axis=1)
    ship(spark)
    got = pairs.asset_covariance(spark.createDataFrame(long), block=550)
    got.write.format("noop").mode("overwrite").save()
    assert got.where("n = 3 and cov is not null").count() == 1100 * 1101 // 2


def test_bands_meet_on_one_line(spark, monkeypatch):
    for order in (0, 2, 3, 5, 7, 11, 13):
        size, line = order * order + order + 1, pairs.plane_line(order)
        met = [sorted(((a + s) % size, (b + s) % size)) for s in range(size) for a in line for b in line if a < b]
        assert len(line) == order + 1 and line[0] == 0 and len(met) == len({tuple(m) for m in met}) == size * (size - 1) // 2
    # 60,000 and 360,000 assets of 533 days: 6 and 8 copies of a history, 12 and 22 before
    assert [pairs.plane_order(b, n) for b, n in ((1, 10**6), (2, 10**6), (8, 533_000), (12, 32 * 10**6), (22, 192 * 10**6))] == [0, 2, 5, 5, 7]
    assert 10**9 * (pairs.plane_order(22, 10**9) + 1) <= pairs.HELD * (pairs.plane_order(22, 10**9) ** 2 + pairs.plane_order(22, 10**9) + 1)
    monkeypatch.setattr(pairs, "TILE", 3)
    monkeypatch.setattr(pairs, "CELLS", 150)
    rng = np.random.default_rng(29)
    wide = pd.DataFrame(rng.normal(size=(40, 50)), index=pd.date_range("2020-01-01", periods=40), columns=[f"s{i:02d}" for i in range(50)]).mask(rng.random((40, 50)) < 0.3)
    weight = pd.Series(rng.random(40), wide.index)
    long = wide.stack().rename("ret").reset_index().set_axis(["date", "symbol", "ret"], axis=1)
    long["w"] = long["date"].map(weight)
    unknown = long[long["symbol"] == "s07"].assign(symbol=None)
    df = spark.createDataFrame(pd.concat([long, unknown]))
    x, k, w = wide.fillna(0.0).to_numpy(), wide.notna().to_numpy().astype(float), weight.to_numpy()[:, None]
    for block in (1, 20, 128):
        sent = pairs.pair_moments(df, weight="w", block=block)
        got = sent.toPandas()
        assert len(got) == 50 * 51 // 2 and got["a"].notna().all()
        a, b = got["a"].str[1:].astype(int), got["b"].str[1:].astype(int)
        for name, want in (("n", (k * w).T @ k), ("sx", (x * w).T @ k), ("sy", (k * w).T @ x), ("sxx", (x * x * w).T @ k), ("syy", (k * w).T @ (x * x)), ("sxy", (x * w).T @ x)):
            np.testing.assert_allclose(got[name], want[a, b], atol=1e-12)


def test_book_is_made_once_and_multiplied_alone(spark, sf):
    from tidepanel.plans.cat_risk import agg_risk_attribution, last_book
    from tidepanel.sources import domain as d
    got = agg_risk_attribution(spark, sf)
    assert got.inputFiles() and not any("lineitem" in path for path in got.inputFiles())
    book, rets = last_book(spark, sf), d.rets(spark, sf)
    every, inside = (pairs.marginal_risk(rets, book, inside=i).toPandas().set_index("symbol")["marginal"] for i in (False, True))
    held = book.toPandas()["symbol"]
    assert set(inside.index) == set(every.index) & set(held)
    np.testing.assert_allclose(inside, every[inside.index], atol=1e-12)
    dates = book.join(d.weights(spark, sf), ["symbol", "weight"]).groupBy("date").count().toPandas()
    assert dates["count"].max() == len(held)


def test_orthogonal_factors_are_made_once(spark, sf):
    from tidepanel.plans.cat_models import m_factor_orthogonalise
    got = m_factor_orthogonalise(spark, sf)
    assert got.inputFiles() and all("/factors-" in path for path in got.inputFiles())
    pdf = got.toPandas()
    assert len(pdf) > 100 and abs(pdf["smb_orth"].mean()) < 1e-9
