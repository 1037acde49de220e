"""Sparse Bayesian regression on Gram sums.

Coordinate-ascent updates use the data only through X'X, X'y and y'y, so after one
grouped aggregate every fit - per key, per regime, per fold, per window - is a d-by-d
iteration on one row. The noise precision stays at its prior.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tidepanel.core.frames import div, ordered
from tidepanel.functions.moments import argmax, dot, quad_form
from tidepanel.models.gram import gram, key_schema, per_row, square

PRIORS = ("laplace", "horseshoe", "spike_slab")
FIT = "n bigint, coef array<double>, cov array<array<double>>, gamma array<double>, selected array<int>, elbo double, iterations int, converged boolean, mse double"
#: Smallest second moment or precision, and the relevance above which a weight counts as selected.
FLOOR, RELEVANT = 1e-8, 0.1


class Laplace:
    """Normal scale mixture of the double exponential with rate ``rate`` (Park and Casella 2008).

    Under an exponential mixing density the mean inverse scale is rate / sqrt(E w^2). The expected log prior needs E|w|,
    the mean of a folded normal.
    """
    rate = math.sqrt(2.0)

    def __init__(self, d: int):
        self.d = d

    def update(self, second: np.ndarray) -> np.ndarray:
        return self.rate / np.sqrt(np.maximum(second, FLOOR))

    def bound(self, m: np.ndarray, v: np.ndarray) -> float:
        sd = np.sqrt(v)
        folded = sd * math.sqrt(2 / math.pi) * np.exp(-0.5 * (m / sd) ** 2) + m * np.array([math.erf(z) for z in m / (sd * math.sqrt(2))])
        return float(self.d * math.log(self.rate / 2) - self.rate * folded.sum())


class Horseshoe:
    """Half-Cauchy scales written as inverse gammas with inverse-gamma auxiliaries (Makalic and Schmidt 2016).

    Mean-field factors are inverse gamma throughout, q(x) = IG(a, b) with E[1/x] = a / b. In the evidence bound the log means
    cancel against the entropies, which leaves the rates.
    """

    def __init__(self, d: int):
        self.d, self.shape = d, (d + 1) / 2
        self.local, self.total = np.ones(d), 1.0  # E[1/lambda_j^2], E[1/tau^2]

    def update(self, second: np.ndarray) -> np.ndarray:
        self.rate_nu = 1.0 + self.local
        self.rate_local = 1.0 / self.rate_nu + 0.5 * second * self.total
        self.local = 1.0 / self.rate_local
        self.rate_xi = 1.0 + self.total
        self.rate_total = 1.0 / self.rate_xi + 0.5 * float(second @ self.local)
        self.total = self.shape / self.rate_total
        return np.maximum(self.local * self.total, FLOOR)

    def bound(self, m: np.ndarray, v: np.ndarray) -> float:
        second = m * m + v
        fit = -0.5 * self.d * math.log(2 * math.pi) - 0.5 * self.total * float(second @ self.local)
        per = (1 - np.log(self.rate_local)) + (1 - np.log(self.rate_nu)) - math.log(math.pi) - self.local / self.rate_nu - 1 / self.rate_nu
        whole = self.shape + math.lgamma(self.shape) - self.shape * math.log(self.rate_total) + 1 - math.log(self.rate_xi)
        return float(fit + per.sum() + whole - math.log(math.pi) - self.total / self.rate_xi - 1 / self.rate_xi)


class SpikeSlab:
    """Two normals around zero, a narrow one of fixed variance and a wide one, with Bernoulli membership (George and McCulloch 1993).

    Responsibilities are the usual mixture posterior; weight share and wide variance maximise the bound.
    """
    narrow = 1e-6

    def __init__(self, d: int):
        self.d, self.share, self.wide = d, 0.5, 1.0

    def update(self, second: np.ndarray) -> np.ndarray:
        odds = math.log(self.share / (1 - self.share)) + 0.5 * math.log(self.narrow / self.wide) + 0.5 * second * (1 / self.narrow - 1 / self.wide)
        self.member = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        self.share = float(np.clip(self.member.mean(), 0.01, 0.99))
        self.wide = max(float(self.member @ second) / max(self.member.sum(), FLOOR), 10 * self.narrow)
        return (1 - self.member) / self.narrow + self.member / self.wide

    def bound(self, m: np.ndarray, v: np.ndarray) -> float:
        second, r = m * m + v, self.member
        normal = lambda var: -0.5 * (math.log(2 * math.pi * var) + second / var)
        mix = np.clip(np.array([r, 1 - r]), 1e-300, 1)
        choice = mix[0] * (math.log(self.share) - np.log(mix[0])) + mix[1] * (math.log(1 - self.share) - np.log(mix[1]))
        return float(np.sum(r * normal(self.wide) + (1 - r) * normal(self.narrow) + choice))


PRIOR = dict(zip(PRIORS, (Laplace, Horseshoe, SpikeSlab), strict=True))


def solve(xx: np.ndarray, xy: np.ndarray, yy: float, n: float, prior: str = "laplace", beta: float = 1.0,
          max_iter: int = 1000, tol: float = 1e-6) -> dict:
    """Mean-field posterior of the weights from sums: mean, covariance, relevance and evidence bound.

    The relevance of a weight is the share of its precision that the data supply (MacKay 1992). ``converged`` tells whether
    the bound settled within ``max_iter`` rounds. The posterior precision is positive definite because every prior
    precision is, so it is factorised by Cholesky.
    """
    d = len(xy)
    state, eye = PRIOR[prior](d), np.eye(d)
    second, bounds, rounds = np.ones(d), [-math.inf], 0
    m, s, precision = np.zeros(d), eye, np.ones(d)
    while rounds < max_iter and (rounds < 2 or abs(bounds[-1] - bounds[-2]) >= tol):
        rounds += 1
        precision = state.update(second)
        root = np.linalg.inv(np.linalg.cholesky(beta * xx + np.diag(precision)))
        s = root.T @ root
        m = beta * s @ xy
        v = np.diag(s)
        second = m * m + v
        misfit = yy - 2 * m @ xy + m @ xx @ m + float((s * xx).sum())
        bounds.append(0.5 * (n * math.log(beta / (2 * math.pi)) - beta * misfit) + state.bound(m, v)
                      + 0.5 * d * math.log(2 * math.pi * math.e) + float(np.log(np.diag(root)).sum()))
    relevance = np.clip(1 - precision * np.diag(s), 0, 1)
    return {"coef": m, "cov": s, "gamma": relevance, "elbo": float(bounds[-1]), "iterations": rounds, "selected": np.flatnonzero(relevance > RELEVANT),
            "converged": rounds >= 2 and bool(abs(bounds[-1] - bounds[-2]) < tol)}


def _record(r: dict, keys: list[str], scale: float, **kw) -> dict:
    xx, xy, yy = square(r["xx"]) * scale, np.asarray(r["xy"]) * scale, r["yy"] * scale
    f = solve(xx, xy, yy, r["n"], **kw)
    mse = (yy - 2 * f["coef"] @ xy + f["coef"] @ xx @ f["coef"]) / max(r["sw"] * scale, 1e-300)
    return {**{k: r[k] for k in keys}, "n": r["n"], "coef": f["coef"].tolist(), "cov": f["cov"].tolist(), "gamma": f["gamma"].tolist(),
            "selected": f["selected"].tolist(), "elbo": f["elbo"], "iterations": f["iterations"], "converged": f["converged"], "mse": float(mse)}


def fit(df: DataFrame, keys: list[str], xs: list[str], y: str, prior: str = "laplace", **kw) -> DataFrame:
    """One sparse Bayesian fit per key."""
    g = gram(df, keys, xs, y, intercept=False)
    return per_row(g, lambda r: _record(r, keys, 1.0, prior=prior, **kw), f"{key_schema(df, keys)}, {FIT}")


def importance(fits: DataFrame, keys: list[str], xs: list[str]) -> DataFrame:
    """(keys, feature, importance, weight, selected)."""
    names = F.array(*[F.lit(x) for x in xs])
    z = F.arrays_zip(names.alias("feature"), F.col("gamma"), F.col("coef"))
    d = fits.select(*keys, "selected", F.posexplode(F.arrays_zip(names.alias("f"), "gamma", "coef")).alias("i", "z"))
    return d.select(*keys, F.col("z.f").alias("feature"), F.col("z.gamma").alias("importance"), F.col("z.coef").alias("weight"),
                    F.array_contains("selected", F.col("i")).alias("selected"))


def predict(df: DataFrame, fits: DataFrame, keys: list[str], xs: list[str], beta: float = 1.0, selected_only: bool = False) -> DataFrame:
    """Posterior mean and deviation per row; the fit table has one row per key."""
    d = df.join(fits.select(*keys, "coef", "cov", "selected"), keys)
    x = F.array(*[F.col(c) for c in xs])
    if selected_only:
        x = F.transform(x, lambda v, i: F.when(F.array_contains(F.col("selected"), i.cast("int")), v).otherwise(0.0))
    d = d.withColumn("_x", x)
    return d.withColumns({"prediction": dot(F.col("_x"), F.col("coef")),
                          "uncertainty": F.sqrt(quad_form(F.col("_x"), F.col("cov")) + 1.0 / beta)}).drop("_x", "coef", "cov", "selected")


# ---- regime-conditional models ----

def by_regime(df: DataFrame) -> DataFrame:
    """One row per (row, regime) with its probability; the fan-out is the number of regimes."""
    keep = [c for c in df.columns if c not in ("probs", "regime")]
    return df.select(*keep, F.posexplode("probs").alias("regime", "p"))


def _regime_gram(df: DataFrame, keys: list[str], xs, y) -> DataFrame:
    d = by_regime(df)
    g = gram(d, [*keys, "regime"], xs, y, "p", intercept=False)
    eff = d.groupBy(*keys, "regime").agg(F.sum((F.col("p") > 0.1).cast("long")).alias("effective"))
    return g.join(eff, [*keys, "regime"])


def fit_regimes(df: DataFrame, keys: list[str], xs: list[str], y: str, prior="laplace", least=10, **kw) -> DataFrame:
    """One fit per (key, regime) on probability-weighted sums scaled to the row count; thin regimes are left out."""
    k = [*keys, "regime"]
    g = _regime_gram(df, keys, xs, y).where(F.col("effective") >= least)
    out = per_row(g, lambda r: {**_record(r, k, r["n"] / r["sw"], prior=prior, **kw), "effective": r["effective"]},
                  f"{key_schema(g, k)}, {FIT}, effective bigint")
    return out


def couple(fits: DataFrame, keys: list[str], penalty: float = 0.1) -> DataFrame:
    """Priors shared across a key's regimes: weighted importance, and the dissimilarity penalty of each regime."""
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("regime")
        w = pdf["effective"] / pdf["effective"].sum()
        imp = np.average(np.vstack(pdf["gamma"]), axis=0, weights=w)
        sets = [set(s) for s in pdf["selected"]]
        pen = []
        for i, a in enumerate(sets):
            total = 0.0
            for b in sets[i + 1:]:
                u = len(a | b)
                sim = len(a & b) / u if u else 0.0
                total += penalty * (1 - sim) if sim < 0.5 else 0.0
            pen.append(total)
        return pd.DataFrame({**{k: pdf[k] for k in keys}, "regime": pdf["regime"], "alpha_prior": float(np.mean(imp + 0.1)),
                             "beta_prior": float(np.mean(1 / (imp + 0.1))), "penalty": pen, "global_importance": [imp.tolist()] * len(pdf)})

    return fits.groupBy(*keys).applyInPandas(
        one, f"{key_schema(fits, keys)}, regime int, alpha_prior double, beta_prior double, penalty double, global_importance array<double>")


def cross_validate(df: DataFrame, keys: list[str], xs: list[str], y: str, fold: str = "fold", prior="laplace", least=5) -> DataFrame:
    """Weighted validation error per (key, regime): training sums are the total minus the fold's sums."""
    d = by_regime(df)
    k = [*keys, "regime"]
    g = gram(d, [*k, fold], xs, y, "p", intercept=False)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        xx, xy = [square(v) for v in pdf["xx"]], [np.asarray(v) for v in pdf["xy"]]
        tot = sum(xx), sum(xy), pdf["yy"].sum(), pdf["n"].sum(), pdf["sw"].sum()
        score = []
        for i in range(len(pdf)):
            sw, n = tot[4] - pdf["sw"].iloc[i], tot[3] - pdf["n"].iloc[i]
            if sw < least * 0.1 or pdf["sw"].iloc[i] <= 0:
                continue
            c = n / sw
            b = solve((tot[0] - xx[i]) * c, (tot[1] - xy[i]) * c, (tot[2] - pdf["yy"].iloc[i]) * c, n, prior=prior)["coef"]
            score.append((pdf["yy"].iloc[i] - 2 * b @ xy[i] + b @ xx[i] @ b) / pdf["sw"].iloc[i])
        return pd.DataFrame([{**{c: pdf[c].iloc[0] for c in k}, "folds": len(score), "mean_cv_score": float(np.mean(score)) if score else None,
                              "std_cv_score": float(np.std(score)) if score else None}])

    # at most one row per fold reaches a task
    return g.groupBy(*k).applyInPandas(one, f"{key_schema(g, k)}, folds bigint, mean_cv_score double, std_cv_score double")


def ensemble_weights(fits: DataFrame, cv: DataFrame, keys: list[str]) -> DataFrame:
    """Softmax of the negative combined score (0.7 validation + 0.3 training), in units of its deviation."""
    k = [*keys, "regime"]
    d = fits.select(*k, "mse").join(cv.select(*k, "mean_cv_score"), k)
    d = d.withColumn("score", 0.7 * F.col("mean_cv_score") + 0.3 * F.col("mse"))
    w = Window.partitionBy(*keys)
    sd = F.stddev_pop("score").over(w)
    e = F.exp(-(F.col("score") - F.min("score").over(w)) / F.when(sd > 0, sd).otherwise(1.0))
    return d.withColumn("_e", e).withColumn("weight", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def _model_map(fits: DataFrame, keys: list[str], weights: DataFrame | None) -> DataFrame:
    k = [*keys, "regime"]
    d = fits.select(*k, "coef", "cov")
    d = d.join(weights.select(*k, "weight"), k, "left") if weights is not None else d.withColumn("weight", F.lit(1.0))
    # one entry per regime
    return d.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("regime", "coef", "cov", "weight"))).alias("models"))


def predict_regimes(df: DataFrame, fits: DataFrame, keys: list[str], xs: list[str], method: str = "regime_weighted",
                    weights: DataFrame | None = None, beta: float = 1.0) -> DataFrame:
    """regime_weighted, best_regime or ensemble prediction, with the mixture deviation."""
    d = df.join(_model_map(fits, keys, weights), keys).withColumn("_x", F.array(*[F.col(c) for c in xs]))
    p = lambda m: F.col("probs")[m["regime"]]
    fold = lambda f: F.aggregate("models", F.lit(0.0), lambda a, m: a + f(m))
    value = lambda m: dot(F.col("_x"), m["coef"])
    if method == "regime_weighted":
        pred = fold(lambda m: p(m) * value(m))
    elif method == "best_regime":
        best = argmax(F.col("probs"))
        pred = fold(lambda m: F.when(m["regime"] == best, value(m)).otherwise(0.0))
    elif method == "ensemble":
        pred = fold(lambda m: p(m) * m["weight"] * value(m)) / F.nullif(fold(lambda m: m["weight"]), F.lit(0.0))
    else:
        raise ValueError(f"unknown prediction method {method!r}")
    total = fold(p)
    first = div(fold(lambda m: p(m) * value(m)), total)
    second = div(fold(lambda m: p(m) * (quad_form(F.col("_x"), m["cov"]) + 1.0 / beta + value(m) * value(m))), total)
    return d.withColumns({"prediction": pred, "uncertainty": F.sqrt(F.greatest(second - first * first, F.lit(0.0)))}).drop("_x", "models")


def feature_consistency(fits: DataFrame, keys: list[str], xs: list[str]) -> DataFrame:
    """Per feature: mean importance and weight, regimes selecting it and the selected share."""
    i = importance(fits, [*keys, "regime"], xs)
    return i.groupBy(*keys, "feature").agg(F.avg("importance").alias("mean_importance"), F.avg("weight").alias("mean_weight"),
                                           F.sum(F.col("selected").cast("long")).alias("regimes_selected"), F.avg(F.col("selected").cast("int")).alias("consistency"))


def dynamic_selection(df: DataFrame, keys: list[str], xs: list[str], y: str, window=252, step=63, least_p=0.3, prior="laplace", time="date") -> DataFrame:
    """Refits over rolling windows built from step-sized blocks of sums, with the Jaccard similarity to the window before."""
    pos = F.row_number().over(ordered(keys, time)) - 1
    d = by_regime(df.withColumn("block", F.floor(pos / step).cast("int")))
    k = [*keys, "regime"]
    g = gram(d, [*k, "block"], xs, y, "p", intercept=False)
    span = window // step

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block").reset_index(drop=True)
        out, prev = [], None
        for e in range(span - 1, len(pdf)):
            w = pdf.iloc[e - span + 1:e + 1]
            n, sw = w["n"].sum(), w["sw"].sum()
            if sw / n < least_p:
                continue
            c = n / sw
            r = solve(sum(square(v) for v in w["xx"]) * c, sum(np.asarray(v) for v in w["xy"]) * c, w["yy"].sum() * c, n, prior=prior)
            cur = {int(i) for i in r["selected"]}
            union = len(cur | prev) if prev is not None else 0
            jac = (len(cur & prev) / union if union else 0.0) if prev is not None else None
            out.append({**{q: pdf[q].iloc[0] for q in k}, "block": int(pdf["block"].iloc[e]), "n": int(n), "selected": sorted(cur), "jaccard": jac})
            prev = cur
        return pd.DataFrame(out, columns=[*k, "block", "n", "selected", "jaccard"])

    return g.groupBy(*k).applyInPandas(one, f"{key_schema(g, k)}, block int, n bigint, selected array<int>, jaccard double")


def switch_turnover(df: DataFrame, keys: list[str], xs: list[str], y: str, span=20, prior="laplace", time="date") -> DataFrame:
    """Fits on the rows before and after each regime switch and the turnover of selected features.

    Rows meet switches by an equi-join on span-sized position buckets.
    """
    w = ordered(keys, time)
    d = df.withColumns({"_i": F.row_number().over(w), "_prev": F.lag("regime").over(w)})
    sw = d.where(F.col("_prev") != F.col("regime")).select(*keys, F.col("_i").alias("switch"), F.col(time).alias("switch_time"),
                                                           F.col("_prev").alias("from_regime"), F.col("regime").alias("to_regime"))
    lo, hi = F.floor((F.col("switch") - span) / span), F.floor((F.col("switch") + span - 1) / span)
    sw = sw.withColumn("_b", F.explode(F.sequence(lo, hi)))
    j = d.withColumn("_b", F.floor(F.col("_i") / span)).select(*keys, *xs, y, "_i", "_b").join(sw, [*keys, "_b"])
    j = j.where((F.col("_i") >= F.col("switch") - span) & (F.col("_i") < F.col("switch") + span))
    j = j.withColumn("side", F.when(F.col("_i") < F.col("switch"), "before").otherwise("after"))
    k = [*keys, "switch", "switch_time", "from_regime", "to_regime", "side"]
    f = per_row(gram(j, k, xs, y, intercept=False).where(F.col("n") >= span // 2), lambda r: _record(r, k, 1.0, prior=prior), f"{key_schema(j, k)}, {FIT}")
    g = f.groupBy(*k[:-1]).agg(F.max(F.when(F.col("side") == "before", F.col("selected"))).alias("b"), F.max(F.when(F.col("side") == "after", F.col("selected"))).alias("a"))
    g = g.where("a is not null and b is not null")
    union = F.size(F.array_union("a", "b"))
    return g.withColumns({"n_before": F.size("b"), "n_after": F.size("a"), "turnover": F.when(union > 0, 1 - F.size(F.array_intersect("a", "b")) / union).otherwise(0.0)}).drop("a", "b")


def adaptive(df: DataFrame, keys: list[str], xs: list[str], y: str, base_penalty=0.1, prior="laplace") -> DataFrame:
    """Refit with a ridge penalty scaled by each regime's mean assignment uncertainty."""
    from tidepanel.functions.moments import entropy
    d = by_regime(df.withColumn("_h", entropy(F.col("probs"))))
    k = [*keys, "regime"]
    h = d.groupBy(*k).agg((F.sum(F.col("p") * F.col("_h")) / F.nullif(F.sum("p"), F.lit(0.0))).alias("uncertainty"))
    g = gram(d, k, xs, y, "p", intercept=False).join(h, k)

    def one(r: dict) -> dict | None:
        if not r["sw"] or r["sw"] <= 0:
            return None
        pen = base_penalty * (1 + (r["uncertainty"] or 0.0))
        d_ = len(r["xy"])
        diag = np.cumsum([0, *range(d_, 1, -1)])
        xx = np.asarray(r["xx"], float).copy()
        xx[diag] += pen * r["sw"] / r["n"]
        return {**_record({**r, "xx": xx}, k, r["n"] / r["sw"], prior=prior), "penalty": pen}

    return per_row(g, one, f"{key_schema(g, k)}, {FIT}, penalty double")
