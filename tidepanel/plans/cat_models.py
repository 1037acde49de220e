"""Queries for feature selection, sparse Bayesian models and factor models."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.core import history
from tidepanel.core.frames import change, ordered, roll
from tidepanel.core.scratch import materialise
from tidepanel.models.components import principal_components
from tidepanel.models import factors as fm, gram as g, sparse_bayes as sb
from tidepanel.operators import aggregates as a, fundamentals as fu, joins as j, selection as se
from tidepanel.plans.cat_aggregates import _FAC
from tidepanel.plans.registry import query
from tidepanel.sources import domain as d

XS = ["ret", "lag1", "mom5", "vol", "vratio"]


def design(sp, sf):
    """Regression rows of the sector indices: five features, next return, regime probabilities, fold."""
    w = ordered("series")
    x = d.regimes(sp, sf).withColumns({"lag1": F.lag("ret").over(w), "mom5": change("close", 5, "series"), "y": F.lead("ret").over(w),
                                       "vratio": F.col("volume") / roll(F.avg, "volume", 20, "series") - 1})
    x = x.where(" and ".join(f"{c} is not null" for c in [*XS, "y"]))
    return x.withColumn("fold", F.pmod(F.unix_date(F.col("date").cast("date")), F.lit(5)))


_DS = """ds AS (SELECT * FROM (SELECT series, date, ret, lag(ret) OVER s AS lag1, close/nullif(lag(close,5) OVER s,0)-1 AS mom5, vol, volume/CASE WHEN count(volume) OVER w=20 THEN avg(volume) OVER w END-1 AS vratio, lead(ret) OVER s AS y, p0, p1, p2, regime
 FROM reg WINDOW s AS (PARTITION BY series ORDER BY date), w AS (PARTITION BY series ORDER BY date ROWS 19 PRECEDING)) WHERE ret IS NOT NULL AND lag1 IS NOT NULL AND mom5 IS NOT NULL AND vol IS NOT NULL AND vratio IS NOT NULL AND y IS NOT NULL)"""
_DSR = _DS + ", dr AS (SELECT *, unnest([0,1,2])::INT AS rg, unnest([p0,p1,p2])::DOUBLE AS p FROM ds)"


@query("m_gram", f"WITH {_DSR} SELECT series, rg AS regime, count(*) AS n, R(sum(p)) AS sw, " + ", ".join(f"R(sum(p*{x}*{y})) AS g_{x}_{y}" for i, x in enumerate(XS) for y in XS[i:]) + ", " + ", ".join(f"R(sum(p*{x}*y)) AS xy_{x}" for x in XS) + ", R(sum(p*y*y)) AS yy FROM dr GROUP BY ALL")
def m_gram(sp, sf):
    r = g.gram(sb.by_regime(design(sp, sf)), ["series", "regime"], XS, "y", "p", intercept=False)
    pairs = [(x, y) for i, x in enumerate(XS) for y in XS[i:]]
    return r.select("series", "regime", "n", "sw", *[F.col("xx")[k].alias(f"g_{x}_{y}") for k, (x, y) in enumerate(pairs)], *[F.col("xy")[k].alias(f"xy_{x}") for k, x in enumerate(XS)], "yy")


def flat(df, *keys):
    """Array results as columns."""
    return df.select(*keys, *[F.col("coef")[i].alias(f"w_{x}") for i, x in enumerate(XS)], *[F.col("gamma")[i].alias(f"g_{x}") for i, x in enumerate(XS)], "n", "elbo", "iterations", "converged")


@query("m_sbl_fit")
def m_sbl_fit(sp, sf):
    return flat(sb.fit(design(sp, sf), ["series"], XS, "y"), "series")


@query("m_sbl_elbo")
def m_sbl_elbo(sp, sf):
    out = None
    x = design(sp, sf)
    for p in sb.PRIORS:
        r = sb.fit(x, ["series"], XS, "y", p).select("series", F.lit(p).alias("prior"), "elbo", "iterations", "converged", F.size("selected").alias("n_selected"))
        out = r if out is None else out.unionByName(r)
    return out


@query("m_sbl_select")
def m_sbl_select(sp, sf):
    return sb.importance(sb.fit(design(sp, sf), ["series"], XS, "y"), ["series"], XS)


@query("m_sbl_predict")
def m_sbl_predict(sp, sf):
    x = design(sp, sf)
    return sb.predict(x, sb.fit(x, ["series"], XS, "y"), ["series"], XS).select("series", "date", "prediction", "uncertainty")


@query("m_rsbl_fit")
def m_rsbl_fit(sp, sf):
    return flat(sb.fit_regimes(design(sp, sf), ["series"], XS, "y"), "series", "regime")


@query("m_rsbl_couple")
def m_rsbl_couple(sp, sf):
    return sb.couple(sb.fit_regimes(design(sp, sf), ["series"], XS, "y"), ["series"]).drop("global_importance")


@query("m_rsbl_cv")
def m_rsbl_cv(sp, sf):
    x = design(sp, sf)
    return sb.ensemble_weights(sb.fit_regimes(x, ["series"], XS, "y"), sb.cross_validate(x, ["series"], XS, "y"), ["series"])


@query("m_rsbl_predict")
def m_rsbl_predict(sp, sf):
    x = design(sp, sf)
    return sb.predict_regimes(x, sb.fit_regimes(x, ["series"], XS, "y"), ["series"], XS).select("series", "date", "prediction", "uncertainty")


@query("m_rsbl_features")
def m_rsbl_features(sp, sf):
    return sb.feature_consistency(sb.fit_regimes(design(sp, sf), ["series"], XS, "y"), ["series"], XS)


@query("m_dynamic_selection")
def m_dynamic_selection(sp, sf):
    return sb.dynamic_selection(design(sp, sf), ["series"], XS, "y").withColumn("selected", F.array_join(F.col("selected").cast("array<string>"), ","))


@query("m_switch_turnover")
def m_switch_turnover(sp, sf):
    return sb.switch_turnover(design(sp, sf), ["series"], XS, "y")


@query("m_adaptive_reg")
def m_adaptive_reg(sp, sf):
    x = sb.adaptive(design(sp, sf), ["series"], XS, "y")
    return flat(x, "series", "regime", "penalty")


FX = ["market", "smb"]


def _factors(sp, sf):
    return a.factor_series(d.rets(sp, sf)).select("date", *FX)


def _panel(sp, sf):
    r = d.rets(sp, sf).where("ret is not null").select("symbol", "date", "ret")
    return r.join(_factors(sp, sf), "date").where("smb is not null")


_PF = _FAC + ", pf AS (SELECT r.symbol, r.date, r.ret, f.market, f.smb FROM rets r JOIN fac f USING (date) WHERE r.ret IS NOT NULL AND f.smb IS NOT NULL)"
_LD = _PF + """, l0 AS (SELECT symbol, count(*)::DOUBLE AS n, avg(market) AS m1, avg(smb) AS m2, avg(ret) AS my, count(*)*var_pop(market) AS c11, count(*)*var_pop(smb) AS c22, count(*)*covar_pop(market,smb) AS c12,
  count(*)*covar_pop(market,ret) AS s1, count(*)*covar_pop(smb,ret) AS s2, count(*)*var_pop(ret) AS syy FROM pf GROUP BY symbol HAVING count(*)>=50),
 l1 AS (SELECT *, ((c22+0.01)*s1-c12*s2)/((c11+0.01)*(c22+0.01)-c12*c12) AS b1, ((c11+0.01)*s2-c12*s1)/((c11+0.01)*(c22+0.01)-c12*c12) AS b2 FROM l0),
 ld AS (SELECT *, my-b1*m1-b2*m2 AS al, 1-(syy-2*(b1*s1+b2*s2)+b1*b1*c11+2*b1*b2*c12+b2*b2*c22)/syy AS r2 FROM l1)"""


@query("m_factor_ridge", f"WITH {_LD} SELECT symbol, n::BIGINT AS n, R(al) AS alpha, R(b1) AS loading_market, R(b2) AS loading_smb, R(r2) AS r_squared FROM ld")
def m_factor_ridge(sp, sf):
    f = fm.loadings(_panel(sp, sf), FX)
    return f.select("symbol", "n", "alpha", F.col("loadings")[0].alias("loading_market"), F.col("loadings")[1].alias("loading_smb"), "r_squared")


@query("m_alpha_components", f"""WITH {_LD}, x AS (SELECT pf.symbol, ret, b1*market+b2*smb AS f, ret-b1*market-b2*smb AS a FROM pf JOIN ld USING (symbol))
 SELECT symbol, R(avg(a)) AS alpha_mean, R(stddev_samp(a)) AS alpha_vol, R(avg(a)/(stddev_samp(a)+1e-8)) AS alpha_sharpe, R(var_samp(f)) AS factor_explained_var, R(var_samp(a)) AS alpha_var, R(var_samp(ret)) AS total_var FROM x GROUP BY symbol""")
def m_alpha_components(sp, sf):
    p = _panel(sp, sf)
    return fm.alpha_components(p, fm.loadings(p, FX), FX)


_AT = f"""WITH {_LD}, fx AS (SELECT market, smb FROM fac WHERE smb IS NOT NULL), m AS (SELECT avg(market) AS m1, avg(smb) AS m2, var_samp(market) AS v1, var_samp(smb) AS v2 FROM fx),
 at AS (SELECT symbol, unnest(['market','smb']) AS factor, unnest([b1,b2]) AS loading, unnest([m.m1,m.m2]) AS fr, unnest([v1,v2]) AS v, al FROM ld, m)""".replace(" at AS", " atr AS")


def _attr(sp, sf):
    return fm.attribution(fm.loadings(_panel(sp, sf), FX), _factors(sp, sf).where("smb is not null"), FX)


@query("m_attribution", _AT + " SELECT symbol, factor, R(loading) AS loading, R(fr) AS factor_return, R(loading*fr) AS contribution, R(loading*loading*v) AS volatility_contribution, R(al) AS alpha FROM atr")
def m_attribution(sp, sf):
    return _attr(sp, sf)


@query("m_attribution_portfolio", _AT + " SELECT factor, R(avg(loading)) AS loading, R(avg(loading*fr)) AS contribution, R(avg(al)) AS alpha, count(*) AS assets FROM atr GROUP BY factor")
def m_attribution_portfolio(sp, sf):
    return fm.portfolio_attribution(_attr(sp, sf))


@query("m_alpha_predict", f"WITH {_LD}, z AS (SELECT date, market, smb FROM fac WHERE smb IS NOT NULL ORDER BY date DESC LIMIT 1) SELECT symbol, date, R(al+b1*market+b2*smb) AS prediction FROM ld, z")
def m_alpha_predict(sp, sf):
    newest = _factors(sp, sf).where("smb is not null").agg(F.max_by(F.struct("date", *FX), "date").alias("r")).select("r.*")
    return fm.predict_alpha(newest, fm.loadings(_panel(sp, sf), FX), FX)


@query("m_alpha_summaries", f"""WITH {_LD}, x AS (SELECT pf.symbol, ret-b1*market-b2*smb AS a FROM pf JOIN ld USING (symbol)), c AS (SELECT symbol, avg(a) AS am, stddev_samp(a) AS av FROM x GROUP BY symbol)
 SELECT symbol, R(al) AS alpha, R(r2) AS r_squared, R(b1) AS loading_market, R(b2) AS loading_smb, R(am) AS alpha_mean, R(av) AS alpha_vol, R(am/(av+1e-8)) AS alpha_sharpe FROM ld JOIN c USING (symbol)""")
def m_alpha_summaries(sp, sf):
    p = _panel(sp, sf)
    l = fm.loadings(p, FX)
    return fm.summaries(l, fm.alpha_components(p, l, FX), FX)


def _panel_probs(sp, sf):
    m = d.market_regimes(sp, sf).select("date", "probs")
    return _panel(sp, sf).join(m, "date")


_RG = _PF + """, pr AS (SELECT pf.*, rg, p, sqrt(p+1e-8) AS s FROM pf JOIN (SELECT date, unnest([0,1,2])::INT AS rg, unnest([p0,p1,p2])::DOUBLE AS p FROM mreg) USING (date)),
 l0 AS (SELECT symbol, rg, count(*)::DOUBLE AS n, avg(s*market) AS m1, avg(s*smb) AS m2, avg(s*ret) AS my, count(*)*var_pop(s*market) AS c11, count(*)*var_pop(s*smb) AS c22, count(*)*covar_pop(s*market,s*smb) AS c12,
  count(*)*covar_pop(s*market,s*ret) AS s1, count(*)*covar_pop(s*smb,s*ret) AS s2, sum(p) AS sw FROM pr GROUP BY symbol, rg HAVING count(*)>=30),
 l1 AS (SELECT *, ((c22+0.01)*s1-c12*s2)/((c11+0.01)*(c22+0.01)-c12*c12) AS b1, ((c11+0.01)*s2-c12*s1)/((c11+0.01)*(c22+0.01)-c12*c12) AS b2 FROM l0),
 ld AS (SELECT *, my-b1*m1-b2*m2 AS al FROM l1)"""


@query("m_factor_ridge_regime", f"""WITH {_RG}, q AS (SELECT symbol, rg, sum(p*power(ret-al-b1*market-b2*smb,2)) AS rss, sum(p*ret*ret)-sum(p*ret)*sum(p*ret)/nullif(sum(p),0) AS tss FROM pr JOIN ld USING (symbol, rg) GROUP BY ALL)
 SELECT symbol, rg AS regime, n::BIGINT AS n, R(al) AS alpha, R(b1) AS loading_market, R(b2) AS loading_smb, R(1-rss/(coalesce(tss,0)+1e-8)) AS r_squared, R(sw) AS effective FROM ld JOIN q USING (symbol, rg)""", 4)
def m_factor_ridge_regime(sp, sf):
    f = fm.loadings_regime(_panel_probs(sp, sf), FX)
    return f.select("symbol", "regime", "n", "alpha", F.col("loadings")[0].alias("loading_market"), F.col("loadings")[1].alias("loading_smb"), "r_squared", "effective")


@query("m_alpha_components_regime", f"""WITH {_RG}, x AS (SELECT symbol, rg, p, ret-b1*market-b2*smb AS a FROM pr JOIN ld USING (symbol, rg)), c AS (SELECT symbol, rg, sum(p*a)/nullif(sum(p),0) AS m, sum(p*a*a)/nullif(sum(p),0) AS q, avg(p) AS w FROM x GROUP BY ALL)
 SELECT symbol, rg AS regime, R(m) AS alpha_mean, R(sqrt(greatest(q-m*m,0))) AS alpha_vol, R(m/(sqrt(greatest(q-m*m,0))+1e-8)) AS alpha_sharpe, R(w) AS regime_weight FROM c""", 4)
def m_alpha_components_regime(sp, sf):
    p = _panel_probs(sp, sf)
    return fm.alpha_components_regime(p, fm.loadings_regime(p, FX), FX)


@query("m_factor_orthogonalise")
def m_factor_orthogonalise(sp, sf):
    fs = ["market", "smb", "momentum_1m", "momentum_3m", "volatility"]
    # a row per date, read for the coefficients and again for the residuals
    x = materialise(a.factor_series(d.rets(sp, sf)).select("date", *fs).na.fill(0.0), "factors")
    return fm.orthogonalise(x, fs).select("date", "market", *[f"{f}_orth" for f in fs[1:]])




@query("m_pca_risk")
def m_pca_risk(sp, sf):
    t = d.trades(sp, sf).join(d.sectors(sp, sf).select("symbol", "industry"), "symbol")
    p = t.groupBy("industry", F.date_trunc("week", "ts").alias("date")).agg((F.sum(F.col("price") * F.col("quantity")) / F.sum("quantity")).alias("close"))
    return principal_components(p.select(F.col("industry").alias("asset"), "date", change("close", 1, "industry").alias("ret")), 3)


@query("m_stat_factor_risk")
def m_stat_factor_risk(sp, sf):
    fs = ["market", "smb", "momentum_1m", "volatility"]
    fac = a.factor_series(d.rets(sp, sf)).select("date", *fs)
    p = d.rets(sp, sf).where("ret is not null").select("symbol", "date", "ret").join(fac, "date").na.drop()
    l = fm.loadings(p, fs, alpha=1e-8)
    c = fm.alpha_components(p, l, fs).select("symbol", F.col("alpha_vol").alias("specific_risk"))
    return l.select("symbol", "n", *[F.col("loadings")[i].alias(f"b_{f}") for i, f in enumerate(fs)], "r_squared").join(c, "symbol")


@query("m_fund_factor_risk")
def m_fund_factor_risk(sp, sf):
    r = fu.ratio_columns()
    f = d.fundamentals(sp, sf).select("symbol", "fiscal_date", r["roe"].alias("roe"), r["debt_to_equity"].alias("leverage"), F.log("revenue").alias("size"))
    p = j.asof_lag(d.rets(sp, sf).where("ret is not null").select("symbol", "date", "ret"), f, ["roe", "leverage", "size"])
    return fm.cross_sectional_factors(p, ["roe", "leverage", "size"])


@query("m_regime_risk", f"""WITH {_FAC}, x AS (SELECT market, smb, rg, p FROM fac JOIN (SELECT date, unnest([0,1,2])::INT AS rg, unnest([p0,p1,p2])::DOUBLE AS p FROM mreg) USING (date) WHERE smb IS NOT NULL),
 g AS (SELECT rg, sum(p) AS sw, sum(p*market)/sum(p) AS m1, sum(p*smb)/sum(p) AS m2, sum(p*market*market)/sum(p) AS q11, sum(p*market*smb)/sum(p) AS q12, sum(p*smb*smb)/sum(p) AS q22 FROM x GROUP BY rg),
 c AS (SELECT rg, unnest(['market','market','smb','smb']) AS f1, unnest(['market','smb','market','smb']) AS f2, unnest([q11-m1*m1,q12-m1*m2,q12-m1*m2,q22-m2*m2]) AS cov FROM g),
 cur AS (SELECT unnest([0,1,2])::INT AS rg, unnest(arg_max([p0,p1,p2],date))::DOUBLE AS p FROM mreg) SELECT f1, f2, R(sum(p*cov)/sum(p)) AS cov FROM c JOIN cur USING (rg) GROUP BY ALL""")
def m_regime_risk(sp, sf):
    m = d.market_regimes(sp, sf).select("date", "probs")
    cov = fm.factor_covariance(_factors(sp, sf).join(m, "date"), FX, regime=True)
    cur = m.agg(F.max_by("probs", "date").alias("p")).select(F.posexplode("p").alias("regime", "p"))
    return fm.mix_regimes(cov, cur)


@query("fs_univariate", f"""WITH {_DS}, c AS (SELECT unnest(['ret','lag1','mom5','vol','vratio']) AS feature, unnest([corr(ret,y),corr(lag1,y),corr(mom5,y),corr(vol,y),corr(vratio,y)]) AS r, unnest([count(*),count(*),count(*),count(*),count(*)]) AS n FROM ds),
 f AS (SELECT feature, r*r/(1-r*r)*(n-2) AS f FROM c) SELECT feature, R(f) AS f_stat FROM f ORDER BY f DESC LIMIT 3""")
def fs_univariate(sp, sf):
    return se.univariate(design(sp, sf), XS, "y", 3)


_MI_AT = ",".join(str(i / 8) for i in range(1, 8))
_MI = " UNION ALL ".join(f"SELECT '{x}' AS feature, {'+'.join(f'(q_{x}[{i}]<{x})::INT' for i in range(1, 8))} AS bx, {'+'.join(f'(q_y[{i}]<y)::INT' for i in range(1, 8))} AS y8 FROM ds, q" for x in XS)


@query("fs_mutual_information", f"""WITH {_DS}, q AS (SELECT {', '.join(f'quantile_cont({x},[{_MI_AT}]) AS q_{x}' for x in [*XS, 'y'])} FROM ds),
 b AS ({_MI}), k AS (SELECT feature, bx, y8, count(*)::DOUBLE AS c FROM b GROUP BY ALL), n AS (SELECT feature, c, sum(c) OVER (PARTITION BY feature, bx) AS cx, sum(c) OVER (PARTITION BY feature, y8) AS cy, sum(c) OVER (PARTITION BY feature) AS t FROM k)
 SELECT feature, R(sum(c/t*ln(c*t/(cx*cy)))) AS mi FROM n GROUP BY feature""")
def fs_mutual_information(sp, sf):
    return se.mutual_information(design(sp, sf), XS, "y", 8)


@query("fs_pca")
def fs_pca(sp, sf):
    return se.pca_ranking(design(sp, sf), XS, 3)


_SC = ["ret", "mom5", "vol"]


def _horner(x: str, coefficients) -> str:
    out = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out}*{x}+{c!r}::DOUBLE)"
    return out


def _normal(u: str) -> str:
    """SQL of the inverse normal of ``u``."""
    side = f"{_horner('z.s', se.SIDES[0])}/{_horner('z.s', se.SIDES[1])}"
    return (f"(SELECT CASE WHEN {u} IS NULL THEN NULL WHEN abs(z.q)<=0.425 THEN z.q*{_horner('z.r', se.CENTRE[0])}/{_horner('z.r', se.CENTRE[1])} WHEN z.q<0 THEN -{side} ELSE {side} END FROM "
            f"(SELECT y.p-0.5 AS q, 0.180625::DOUBLE-(y.p-0.5)*(y.p-0.5) AS r, sqrt(-ln(least(y.p,1-y.p)))-1.6::DOUBLE AS s FROM (SELECT least(greatest({u},1e-7::DOUBLE),1-1e-7::DOUBLE) AS p) y) z)")


_STD = ", ".join(f"({c}-avg({c}) OVER w)/nullif(sqrt(greatest(var_pop({c}) OVER w,0)),0) AS {c}_standard" for c in _SC)


@query("fs_scale", f"""WITH {_DS}, b AS (SELECT x.series, x.date, {", ".join(f"((count(*) FILTER (y.{c}<x.{c}))+((count(*) FILTER (y.{c}=x.{c}))-1)/2.0::DOUBLE)/nullif(count(y.{c})-1,0) AS {c}_uniform" for c in _SC)}
   FROM ds x JOIN ds y ON y.date<=x.date GROUP BY x.series, x.date, x.ret, x.mom5, x.vol),
 s AS (SELECT series, date, {_STD} FROM ds WINDOW w AS (ORDER BY date RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
 SELECT series, date, {", ".join(f"R({c}_uniform) AS {c}_uniform, R({_normal(f'b.{c}_uniform')}) AS {c}_normal, R(CASE WHEN abs({c}_standard)<1e6 THEN {c}_standard END) AS {c}_standard" for c in _SC)} FROM b JOIN s USING (series, date)""")
def fs_scale(sp, sf):
    """Scaling by what was known at each date."""
    x = design(sp, sf).select("series", "date", *_SC)
    x = history.expanding_uniform(history.expanding_standard(x, "date", _SC), "date", _SC)
    return x.select("series", "date", *[f"{c}_standard" for c in _SC], *[f"{c}_uniform" for c in _SC], *[se.normal_score(F.col(f"{c}_uniform")).alias(f"{c}_normal") for c in _SC])


@query("fs_scale_full", f"""WITH {_DS}, q AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}, quantile_cont({c},0.25) AS a_{c}, quantile_cont({c},0.5) AS d_{c}, quantile_cont({c},0.75) AS b_{c}" for c in _SC)} FROM ds),
 u AS (SELECT *, {", ".join(f"(rank() OVER (ORDER BY {c})-1+(count(*) OVER (PARTITION BY {c})-1)/2.0::DOUBLE)/(count(*) OVER ()-1) AS u_{c}" for c in _SC)} FROM ds)
 SELECT series, date, {", ".join(f"R(({c}-m_{c})/s_{c}) AS {c}_standard, R(({c}-d_{c})/(b_{c}-a_{c})) AS {c}_robust, R(u_{c}) AS {c}_uniform, R({_normal(f'u.u_{c}')}) AS {c}_normal" for c in _SC)} FROM u, q""")
def fs_scale_full(sp, sf):
    """Scaling by the whole table, later rows included."""
    base = materialise(design(sp, sf).select("series", "date", *_SC), "scale")
    x = se.robust(se.standard(base, _SC), _SC, base)
    for c in _SC:
        x = se.quantile_uniform(x, c, base)
    return x.select("series", "date", *[f"{c}_{k}" for c in _SC for k in ("standard", "robust", "uniform")], *[se.normal_score(F.col(f"{c}_uniform")).alias(f"{c}_normal") for c in _SC])


@query("fs_engineer_all", """WITH r AS (SELECT *, close/nullif(lag(close,20) OVER s,0)-1 AS m20, CASE WHEN count(close) OVER w=20 THEN avg(close) OVER w END AS sma FROM rets WINDOW s AS (PARTITION BY symbol ORDER BY date), w AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)),
 k AS (SELECT r.*, sector FROM r JOIN sectors USING (symbol)) SELECT symbol, date, sector, R(ret) AS ret, R4(sma) AS sma_20, R(m20) AS momentum_20,
 R(CASE WHEN m20 IS NOT NULL THEN rank() OVER (PARTITION BY date ORDER BY m20 NULLS LAST)::DOUBLE/count(m20) OVER (PARTITION BY date) END) AS momentum_20_cs_rank,
 R(CASE WHEN stddev_samp(m20) OVER (PARTITION BY date)>0 THEN (m20-avg(m20) OVER (PARTITION BY date))/stddev_samp(m20) OVER (PARTITION BY date) ELSE 0 END) AS momentum_20_cs_zscore,
 R(CASE WHEN m20 IS NOT NULL THEN (rank() OVER (PARTITION BY sector, date ORDER BY m20 NULLS LAST)+(count(*) OVER (PARTITION BY sector, date, m20)-1)/2.0)/count(m20) OVER (PARTITION BY sector, date) END) AS momentum_20_sector_rank FROM k""", sma_20=4)
def fs_engineer_all(sp, sf):
    from tidepanel.plans.pipelines import engineer
    x = engineer(d.bars(sp, sf).drop("adj_close"), d.sectors(sp, sf))
    return x.select("symbol", "date", "sector", "ret", "sma_20", "momentum_20", "momentum_20_cs_rank", "momentum_20_cs_zscore", "momentum_20_sector_rank")
