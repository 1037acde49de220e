"""Factor models: ridge loadings, alpha, attribution and risk decomposition inputs."""
from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from tidepanel.core.frames import attach, div
from tidepanel.functions.moments import dot
from tidepanel.models.gram import gram, gram_columns, key_schema, per_row, ridge, square

LOADING = "n bigint, alpha double, loadings array<double>, r_squared double"


def orthogonalise(df: DataFrame, factors: list[str], alpha: float = 0.01) -> DataFrame:
    """Residual of each factor on all factors before it (ridge, first one kept).

    The coefficients come from one Gram row of k*k numbers; the residuals are one projection.
    """
    g = gram(df, [], factors, factors[0]).first()
    xx, n = square(g["xx"]), float(g["n"])
    out = {}
    for j in range(1, len(factors)):
        a, b = ridge(xx[:j + 1, :j + 1], xx[:j + 1, j + 1], n, alpha)
        e = F.col(factors[j]) - F.lit(a)
        for c, f in zip(b, factors[:j]):
            e = e - F.lit(float(c)) * F.col(f)
        out[f"{factors[j]}_orth"] = e
    return df.withColumns(out)


def loadings(panel: DataFrame, factors: list[str], key="symbol", value="ret", alpha=0.01, least=50) -> DataFrame:
    """Ridge loadings, alpha and R-squared per asset: one grouped pass, one k-by-k solve per asset row."""
    def one(r: dict) -> dict | None:
        xx, xy, n = square(r["xx"]), np.asarray(r["xy"]), float(r["n"])
        a, b = ridge(xx, xy, n, alpha)
        beta = np.concatenate([[a], b])
        rss, tss = r["yy"] - 2 * beta @ xy + beta @ xx @ beta, r["yy"] - xy[0] ** 2 / n
        return {key: r[key], "n": r["n"], "alpha": a, "loadings": b.tolist(), "r_squared": 1 - rss / tss if tss > 0 else None}

    g = gram(panel, [key], factors, value).where(F.col("n") >= least)
    return per_row(g, one, f"{key_schema(panel, [key])}, {LOADING}")


def loadings_regime(panel: DataFrame, factors: list[str], key="symbol", value="ret", alpha=0.01, least=30) -> DataFrame:
    """Weighted ridge per (asset, regime): rows scaled by sqrt(p), intercept fitted on the scaled rows; weighted R-squared."""
    d = panel.where(" and ".join(f"{c} is not null" for c in [*factors, value])).select(key, value, *factors, F.posexplode("probs").alias("regime", "p"))
    s = F.sqrt(F.col("p") + 1e-8)
    one_, xs = F.lit(1.0), [F.col(f) for f in factors]
    g = d.groupBy(key, "regime").agg(*gram_columns([one_, *[s * x for x in xs]], s * F.col(value)),
                                     *gram_columns([one_, *xs], F.col(value), F.col("p"), "w_")).where(F.col("n") >= least)

    def one(r: dict) -> dict:
        a, b = ridge(square(r["xx"]), np.asarray(r["xy"]), float(r["n"]), alpha)
        wxx, wxy, beta = square(r["w_xx"]), np.asarray(r["w_xy"]), np.concatenate([[a], b])
        rss = r["w_yy"] - 2 * beta @ wxy + beta @ wxx @ beta
        tss = r["w_yy"] - wxy[0] ** 2 / r["w_sw"] if r["w_sw"] > 0 else 0.0
        return {key: r[key], "regime": r["regime"], "n": r["n"], "alpha": a, "loadings": b.tolist(), "r_squared": 1 - rss / (tss + 1e-8), "effective": r["w_sw"]}

    return per_row(g, one, f"{key_schema(panel, [key])}, regime int, {LOADING}, effective double")


def alpha_components(panel: DataFrame, fitted: DataFrame, factors: list[str], key="symbol", value="ret") -> DataFrame:
    """Residual after factor returns: mean, deviation, Sharpe and variance shares per asset."""
    d = panel.join(fitted.select(key, "loadings"), key).where(F.col(value).isNotNull())
    fx = dot(F.array(*[F.coalesce(F.col(f), F.lit(0.0)) for f in factors]), F.col("loadings"))
    d = d.withColumn("_f", fx).withColumn("_a", F.col(value) - F.col("_f"))
    return d.groupBy(key).agg(F.avg("_a").alias("alpha_mean"), F.stddev_samp("_a").alias("alpha_vol"), (F.avg("_a") / (F.stddev_samp("_a") + 1e-8)).alias("alpha_sharpe"),
                              F.var_samp("_f").alias("factor_explained_var"), F.var_samp("_a").alias("alpha_var"), F.var_samp(value).alias("total_var"))


def alpha_components_regime(panel: DataFrame, fitted: DataFrame, factors: list[str], key="symbol", value="ret") -> DataFrame:
    """Probability-weighted residual statistics per (asset, regime); variance from shifted weighted sums."""
    d = panel.where(F.col(value).isNotNull()).select(key, value, *factors, F.posexplode("probs").alias("regime", "p"))
    d = d.join(fitted.select(key, "regime", "loadings"), [key, "regime"])
    a = F.col(value) - dot(F.array(*[F.coalesce(F.col(f), F.lit(0.0)) for f in factors]), F.col("loadings"))
    d = d.withColumn("_a", a)
    g = d.groupBy(key, "regime").agg(F.sum("p").alias("_w"), F.sum(F.col("p") * F.col("_a")).alias("_s"), F.sum(F.col("p") * F.col("_a") * F.col("_a")).alias("_q"), F.avg("p").alias("regime_weight"))
    m = div("_s", "_w")
    v = F.sqrt(F.greatest(div("_q", "_w") - m * m, F.lit(0.0)))
    return g.select(key, "regime", m.alias("alpha_mean"), v.alias("alpha_vol"), (m / (v + 1e-8)).alias("alpha_sharpe"), "regime_weight")


def attribution(fitted: DataFrame, factor_table: DataFrame, factors: list[str], key="symbol") -> DataFrame:
    """(asset, factor, loading, factor_return, contribution, volatility_contribution) from mean factor returns (one row)."""
    m = factor_table.agg(*[F.avg(f).alias(f"m_{f}") for f in factors], *[F.var_samp(f).alias(f"v_{f}") for f in factors])
    d = attach(fitted, m)
    z = F.array(*[F.struct(F.lit(f).alias("factor"), F.col("loadings")[i].alias("loading"), F.col(f"m_{f}").alias("factor_return"), F.col(f"v_{f}").alias("v"))
                  for i, f in enumerate(factors)])
    d = d.select(key, "alpha", F.explode(z).alias("z"))
    ld = F.col("z.loading")
    return d.select(key, F.col("z.factor").alias("factor"), ld.alias("loading"), F.col("z.factor_return").alias("factor_return"),
                    (ld * F.col("z.factor_return")).alias("contribution"), (ld * ld * F.col("z.v")).alias("volatility_contribution"), "alpha")


def portfolio_attribution(attr: DataFrame) -> DataFrame:
    """Equal-weight portfolio: mean contribution per factor over assets."""
    return attr.groupBy("factor").agg(F.avg("loading").alias("loading"), F.avg("contribution").alias("contribution"), F.avg("alpha").alias("alpha"), F.count(F.lit(1)).alias("assets"))


def predict_alpha(new_rows: DataFrame, fitted: DataFrame, factors: list[str], key="symbol", include_intercept=True) -> DataFrame:
    """Prediction of every asset for each new factor row (one per future date: a calendar-sized list)."""
    rows = new_rows.agg(F.collect_list(F.struct(*new_rows.columns)).alias("_n"))
    d = attach(fitted, rows).withColumn("_n", F.explode("_n")).select(*fitted.columns, "_n.*")
    x = dot(F.array(*[F.col(f) for f in factors]), F.col("loadings"))
    return d.select(key, *[c for c in new_rows.columns if c not in factors], (x + F.col("alpha") if include_intercept else x).alias("prediction"))


def summaries(fitted: DataFrame, components: DataFrame, factors: list[str], key="symbol") -> DataFrame:
    """Alpha and loading columns side by side, best alpha Sharpe first."""
    l = fitted.select(key, "alpha", "r_squared", *[F.col("loadings")[i].alias(f"loading_{f}") for i, f in enumerate(factors)])
    return l.join(components.select(key, "alpha_mean", "alpha_vol", "alpha_sharpe"), key).orderBy(F.col("alpha_sharpe").desc(), key)


def cross_sectional_factors(panel: DataFrame, exposures: list[str], value="ret", time="date", eps=1e-8, least=10) -> DataFrame:
    """Factor returns per date: regression of returns on exposures, sums grouped by date."""
    def one(r: dict) -> dict:
        xx, xy = square(r["xx"]), np.asarray(r["xy"])
        b = np.linalg.lstsq(xx + eps * np.diag(np.diag(xx)), xy, rcond=None)[0]
        return {time: r[time], "n": r["n"], "coef": b.tolist()}

    g = gram(panel, [time], exposures, value).where(F.col("n") >= least)
    out = per_row(g, one, f"{time} timestamp, n bigint, coef array<double>")
    return out.select(time, "n", F.col("coef")[0].alias("intercept"), *[F.col("coef")[i + 1].alias(e) for i, e in enumerate(exposures)])


def factor_covariance(factor_table: DataFrame, factors: list[str], regime: bool = False) -> DataFrame:
    """Long factor covariance, optionally probability-weighted per regime, from grouped sums."""
    d = factor_table.where(" and ".join(f"{f} is not null" for f in factors))
    d = d.select(*factors, *([F.posexplode("probs").alias("regime", "p")] if regime else [F.lit(0).alias("regime"), F.lit(1.0).alias("p")]))
    p = F.col("p")
    g = d.groupBy("regime").agg(F.sum(p).alias("sw"), F.count(F.lit(1)).alias("n"), *[F.sum(p * F.col(f)).alias(f"s_{f}") for f in factors],
                                *[F.sum(p * F.col(a) * F.col(b)).alias(f"q_{a}__{b}") for i, a in enumerate(factors) for b in factors[i:]])
    sw = F.col("sw")
    cells = [F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"),
                      ((F.col(f"q_{min(a, b, key=factors.index)}__{max(a, b, key=factors.index)}") / sw - F.col(f"s_{a}") / sw * F.col(f"s_{b}") / sw)
                       * (F.lit(1.0) if regime else F.col("n") / (F.col("n") - 1))).alias("cov")) for a in factors for b in factors]
    return g.where(sw > 0).select("regime", F.explode(F.array(*cells)).alias("c")).select("regime", "c.*")


def mix_regimes(cov: DataFrame, current: DataFrame) -> DataFrame:
    """Covariance mixed by current probabilities: ``current`` is (regime, p)."""
    return cov.join(current, "regime").groupBy("f1", "f2").agg((F.sum(F.col("p") * F.col("cov")) / F.sum("p")).alias("cov"))
