"""Portfolio risk from long tables: weights (symbol, weight), exposures, factor covariance, returns."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidepanel.core.frames import attach, corr, div, whole

# fixed values: one-sided normal quantiles
Z = {0.95: -1.6449, 0.99: -2.3263}


def exposures(weights: DataFrame, betas: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sum of weight times beta per factor: ``betas`` is (symbol, factor, beta)."""
    keys = keys or []
    return weights.join(betas, "symbol").groupBy(*keys, "factor").agg(F.sum(F.col("weight") * F.col("beta")).alias("exposure"))


def variance_split(weights: DataFrame, betas: DataFrame, cov: DataFrame, specific: DataFrame) -> DataFrame:
    """Factor and specific variance: b'Fb + sum w^2 s^2. Factor tables have one row per factor (pair)."""
    b = exposures(weights, betas)
    s = (cov.join(b.withColumnRenamed("factor", "f1").withColumnRenamed("exposure", "e1"), "f1")
         .join(b.withColumnRenamed("factor", "f2").withColumnRenamed("exposure", "e2"), "f2")
         .agg(F.sum(F.col("e1") * F.col("e2") * F.col("cov")).alias("factor_variance")))
    i = weights.join(specific, "symbol").agg(F.sum(F.col("weight") * F.col("weight") * F.col("specific_var")).alias("specific_variance"))
    out = attach(s, i).withColumn("total_variance", F.col("factor_variance") + F.col("specific_variance"))
    return out.withColumns({"volatility": F.sqrt("total_variance"), "factor_share": div("factor_variance", "total_variance")})


def contributions(weights: DataFrame, betas: DataFrame, cov: DataFrame, specific: DataFrame) -> DataFrame:
    """Marginal and component contribution to variance per asset, with its share."""
    b = exposures(weights, betas).withColumnRenamed("factor", "f2")
    fb = cov.join(b, "f2").groupBy(F.col("f1").alias("factor")).agg(F.sum(F.col("cov") * F.col("exposure")).alias("v"))
    m = betas.join(fb, "factor").groupBy("symbol").agg(F.sum(F.col("beta") * F.col("v")).alias("systematic"))
    d = weights.join(m, "symbol").join(specific, "symbol")
    d = d.withColumn("marginal", F.col("systematic") + F.col("weight") * F.col("specific_var")).withColumn("component", F.col("weight") * F.col("marginal"))
    total = d.agg(F.sum("component").alias("_t"))
    return attach(d, total).select("symbol", "weight", "marginal", "component", div("component", "_t").alias("share"))


def marginal_attribution(weights: DataFrame, marginal: DataFrame) -> DataFrame:
    """The same from the marginal risk (symbol, marginal) of each asset."""
    d = weights.join(marginal.select("symbol", "marginal"), "symbol").withColumn("component", F.col("weight") * F.col("marginal"))
    total = d.agg(F.sum("component").alias("_t"))
    return attach(d, total).select("symbol", "weight", "marginal", "component", div("component", "_t").alias("share"))


def concentration(contrib: DataFrame) -> DataFrame:
    return contrib.agg(F.sum(F.col("share") * F.col("share")).alias("herfindahl"), (1 / F.sum(F.col("share") * F.col("share"))).alias("effective_bets"))


def portfolio_returns(weights: DataFrame, rets: DataFrame) -> DataFrame:
    """Sum of fixed weights times returns per date; an untraded asset contributes nothing."""
    return rets.where("ret is not null").join(weights, "symbol").groupBy("date").agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"))


def var_cvar(port: DataFrame, levels=(0.95, 0.99)) -> DataFrame:
    """Historical VaR and CVaR and parametric VaR; the series has one row per date."""
    d = port.withColumn("_k", F.lit(0))
    d = d.withColumn("_q", F.percentile("ret", F.array(*[F.lit(1 - p) for p in levels])).over(whole("_k")))
    aggs = []
    for i, p in enumerate(levels):
        t = int(round(p * 100))
        aggs += [F.max(F.col("_q")[i]).alias(f"var_{t}"), F.avg(F.when(F.col("ret") <= F.col("_q")[i], F.col("ret"))).alias(f"cvar_{t}"),
                 (F.avg("ret") + Z[p] * F.stddev_samp("ret")).alias(f"parametric_var_{t}")]
    return d.agg(*aggs)


def component_var(weights: DataFrame, rets: DataFrame, level=0.95, least=5) -> DataFrame:
    """Weight times mean asset return on the portfolio's tail dates."""
    port = portfolio_returns(weights, rets).withColumn("_k", F.lit(0))
    tail = port.withColumn("_q", F.percentile("ret", F.lit(1 - level)).over(whole("_k"))).where(F.col("ret") <= F.col("_q"))
    n = tail.agg(F.count(F.lit(1)).alias("n"))
    m = rets.where("ret is not null").join(tail.select("date"), "date", "left_semi").groupBy("symbol").agg(F.avg("ret").alias("m"))
    return attach(weights.join(m, "symbol"), n).where(F.col("n") > least).select("symbol", (F.col("weight") * F.col("m")).alias("component_var"))


def marginal_var(weights: DataFrame, rets: DataFrame, level=0.95, eps=1e-6) -> DataFrame:
    """Numerical derivative of VaR with respect to each weight, weights renormalised.

    A bump of eps moves a date's return by at most eps * max|r|, so only dates that close to
    the quantile can change their rank around it. Those few candidate dates and the number
    of dates below them give every asset's perturbed quantile exactly, without an
    asset-by-date product.
    """
    port = portfolio_returns(weights, rets).withColumn("_k", F.lit(0))
    w = whole("_k")
    big = rets.agg(F.max(F.abs("ret")).alias("_big"))
    tot = weights.agg(F.sum("weight").alias("_w"))
    p = port.withColumns({"_n": F.count(F.lit(1)).over(w), "_r": F.row_number().over(Window.partitionBy("_k").orderBy("ret", "date")) - 1})
    pos = F.lit(1 - level) * (F.col("_n") - 1)
    p = p.withColumns({"_lo": F.floor(pos), "_hi": F.ceil(pos), "_f": pos - F.floor(pos)})
    p = p.withColumns({"_vlo": F.max(F.when(F.col("_r") == F.col("_lo"), F.col("ret"))).over(w), "_vhi": F.max(F.when(F.col("_r") == F.col("_hi"), F.col("ret"))).over(w)})
    p = attach(p, big)
    band = 2.000001 * eps * F.col("_big")
    c = p.where((F.col("ret") >= F.col("_vlo") - band) & (F.col("ret") <= F.col("_vhi") + band))
    box = c.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("date", "ret"))).alias("_c"), F.min("_r").alias("_below"), F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"),
                              F.max("_f").alias("_f"), F.max(F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_f")).alias("_base"))
    box = attach(box, tot)
    own = rets.where("ret is not null").join(c.select("date"), "date", "left_semi").groupBy("symbol").agg(
        F.map_from_entries(F.collect_list(F.struct("date", "ret"))).alias("_own"))
    d = attach(weights.join(own, "symbol", "left"), box)
    bumped = F.array_sort(F.transform("_c", lambda e: (e["ret"] + eps * F.coalesce(F.col("_own")[e["date"]], F.lit(0.0))) / (F.col("_w") + eps)))
    d = d.withColumn("_b", bumped)
    at = lambda k: F.element_at("_b", (F.col(k) - F.col("_below") + 1).cast("int"))
    new = at("_lo") + (at("_hi") - at("_lo")) * F.col("_f")
    return d.select("symbol", ((new - F.col("_base")) / eps).alias("marginal_var"))


def factor_shocks(exposure: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Impact of (scenario, factor, shock) rows on factor exposures."""
    d = exposure.join(scenarios, "factor")
    return d.select("scenario", "factor", "exposure", "shock", (F.col("exposure") * F.col("shock")).alias("impact"))


def historical_stress(weights: DataFrame, rets: DataFrame, dates: DataFrame) -> DataFrame:
    """Asset impacts on the given scenario dates, with the portfolio's total per date."""
    d = rets.where("ret is not null").join(dates.select("date"), "date", "left_semi").join(weights, "symbol")
    d = d.select("symbol", "date", (F.col("weight") * F.col("ret")).alias("impact"))
    return d.join(d.groupBy("date").agg(F.sum("impact").alias("portfolio_impact")), "date")


def hedge_ratios(port: DataFrame, instruments: DataFrame, key="series", least=50) -> DataFrame:
    """Minus beta, R-squared and variance reduction per hedge instrument."""
    d = port.select("date", F.col("ret").alias("p")).join(instruments.where("ret is not null").select(key, "date", "ret"), "date")
    hedged = F.var_samp("p") - F.pow(F.covar_samp("p", "ret"), 2) / F.var_samp("ret")
    g = d.groupBy(key).agg(F.count(F.lit(1)).alias("n"), (-F.regr_slope("p", "ret")).alias("hedge_ratio"), F.pow(corr("p", "ret"), 2).alias("r_squared"),
                           (1 - hedged / F.var_samp("p")).alias("variance_reduction"))
    return g.where(F.col("n") > least)


def regime_attribution(weights: DataFrame, betas: DataFrame, cov: DataFrame, current: DataFrame) -> DataFrame:
    """Factor variance under each regime's covariance and its probability-weighted contribution."""
    b = exposures(weights, betas)
    d = (cov.join(b.withColumnRenamed("factor", "f1").withColumnRenamed("exposure", "e1"), "f1")
         .join(b.withColumnRenamed("factor", "f2").withColumnRenamed("exposure", "e2"), "f2"))
    g = d.groupBy("regime").agg(F.sum(F.col("e1") * F.col("e2") * F.col("cov")).alias("variance")).join(current, "regime")
    return g.select("regime", "p", "variance", (F.col("p") * F.col("variance")).alias("contribution"))


def summary(**tables: DataFrame) -> DataFrame:
    """Single-row tables as (section, metric, value) rows."""
    out = None
    for name, t in tables.items():
        cols = [c for c in t.columns]
        part = t.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "metric", "value").withColumn("section", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.select("section", "metric", "value")
