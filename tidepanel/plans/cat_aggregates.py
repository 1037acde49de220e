"""Queries for grouped summaries."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.core.frames import div
from tidepanel.operators import aggregates as a, execution as ex, fundamentals as fu, joins as j, pairs, quality as q
from tidepanel.plans.cat_regimes import _EP
from tidepanel.plans.registry import query
from tidepanel.sources import domain as d


@query("agg_market_summary", """WITH k AS (SELECT symbol, date, close, volume, ret, close/max(close) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)-1 AS dd FROM rets),
 g AS (SELECT symbol, min(date) AS start_date, max(date) AS end_date, arg_max(close,date)/arg_min(close,date)-1 AS tr, count(*) AS n, stddev_samp(ret)*sqrt(252.0::DOUBLE) AS v, min(dd) AS dd, arg_max(close,date) AS lp, arg_max(volume,date) AS lv FROM k GROUP BY symbol)
 SELECT symbol, start_date, end_date, R(tr) AS total_return, R(power(1+tr,252.0::DOUBLE/n)-1) AS annual_return, R(v) AS volatility, R((power(1+tr,252.0::DOUBLE/n)-1)/nullif(v,0)) AS sharpe, R(dd) AS max_drawdown, R(lp) AS last_price, R(lv) AS last_volume, n FROM g""")
def agg_market_summary(sp, sf):
    return a.market_summary(d.rets(sp, sf))


@query("agg_feature_stats", """WITH l AS (SELECT 'ret' AS feature, ret AS value FROM rets UNION ALL SELECT 'close', close FROM rets UNION ALL SELECT 'volume', volume FROM rets)
 SELECT feature, count(value) AS count, R(avg(value)) AS mean, R(stddev_samp(value)) AS std, R(min(value)) AS min, R(max(value)) AS max, R(quantile_cont(value,0.5)) AS median, R(skewness(value)) AS skewness, R(kurtosis(value)) AS kurtosis, R(avg((value IS NULL)::INT)) AS missing FROM l GROUP BY feature""", 5)
def agg_feature_stats(sp, sf):
    return a.feature_stats(d.rets(sp, sf), ["ret", "close", "volume"])


_REGDD = """w AS (SELECT series, regime, date, exp(sum(ln(1+ret)) OVER (PARTITION BY series, regime ORDER BY date ROWS UNBOUNDED PRECEDING)) AS wl FROM reg WHERE ret IS NOT NULL),
 dd AS (SELECT series, regime, min(x) AS dd FROM (SELECT series, regime, wl/max(wl) OVER (PARTITION BY series, regime ORDER BY date ROWS UNBOUNDED PRECEDING)-1 AS x FROM w) GROUP BY ALL)"""


@query("agg_regime_stats", _EP + f""", el AS (SELECT series, regime, avg(len) AS el FROM e GROUP BY ALL), {_REGDD}, n AS (SELECT series, count(*) AS n FROM reg GROUP BY series),
 g AS (SELECT series, regime, count(*) AS days, avg(ret)*252 AS m, stddev_samp(ret)*sqrt(252.0::DOUBLE) AS v, skewness(ret) AS sk, kurtosis(ret) AS ku FROM reg GROUP BY ALL)
 SELECT series, regime, days, R(days::DOUBLE/n) AS frequency, R(m) AS mean, R(v) AS volatility, R(m/nullif(v,0)) AS sharpe, R(sk) AS skewness, R(ku) AS kurtosis, R(dd) AS max_drawdown, R(el) AS episode_length
 FROM g JOIN n USING (series) JOIN dd USING (series, regime) JOIN el USING (series, regime)""", 5)
def agg_regime_stats(sp, sf):
    return a.regime_stats(d.regimes(sp, sf))


@query("agg_regime_characterise", """SELECT series, regime, count(*) AS n, R(avg(ret)) AS mean, R(stddev_samp(ret)) AS std, R(avg((ret>0)::INT)) AS hit_rate, R(skewness(ret)) AS skewness, R(quantile_cont(ret,0.05)) AS var_95, R(quantile_cont(ret,0.01)) AS var_99, R(quantile_cont(ret,0.5)) AS median
 FROM reg WHERE ret IS NOT NULL GROUP BY ALL HAVING count(*)>5""")
def agg_regime_characterise(sp, sf):
    return a.regime_characterise(d.regimes(sp, sf))


def _panel(sp, sf):
    """Symbol returns with the market return and market regime of the day."""
    m = d.market_regimes(sp, sf).select("date", F.col("ret").alias("market"), "regime", "probs")
    return d.rets(sp, sf).select("symbol", "date", "close", "ret").join(m, "date")


_PN = "pn AS (SELECT r.symbol, r.date, r.close, r.ret, m.ret AS market, m.regime, p0, p1, p2 FROM rets r JOIN mreg m USING (date))"


@query("agg_regime_asset_vol", f"""WITH {_PN}, v AS (SELECT regime, symbol, stddev_pop(ret)*sqrt(252.0::DOUBLE) AS vol FROM pn GROUP BY ALL)
 SELECT regime, R(avg(vol)) AS mean_vol, R(stddev_pop(vol)) AS std_vol, R(min(vol)) AS min_vol, R(max(vol)) AS max_vol, R(quantile_cont(vol,0.5)) AS median_vol FROM v WHERE vol IS NOT NULL GROUP BY regime""")
def agg_regime_asset_vol(sp, sf):
    return a.regime_asset_vol(_panel(sp, sf))


@query("agg_regime_correlation", f"""WITH {_PN}, x AS (SELECT regime, symbol, date, ret FROM pn WHERE ret IS NOT NULL), c AS (SELECT p.regime, p.symbol AS a, q.symbol AS b, corr(p.ret,q.ret) AS c FROM x p JOIN x q ON p.date=q.date AND p.symbol<q.symbol GROUP BY ALL HAVING count(*)>=10)
 SELECT regime, count(c) AS pairs, R(avg(c)) AS mean_corr, R(stddev_pop(c)) AS std_corr, R(min(c)) AS min_corr, R(max(c)) AS max_corr FROM c WHERE NOT isnan(c) GROUP BY regime""")
def agg_regime_correlation(sp, sf):
    c = pairs.correlation_totals(_panel(sp, sf), False, 10, ["regime"]).where("known > 0")
    mean = F.col("s") / F.col("known")
    return c.select("regime", F.col("known").alias("pairs"), mean.alias("mean_corr"), F.sqrt(F.greatest(F.col("q") / F.col("known") - mean * mean, F.lit(0.0))).alias("std_corr"),
                    F.col("lo").alias("min_corr"), F.col("hi").alias("max_corr"))


_BETA = f"""WITH {_PN}, b AS (SELECT regime, symbol, regr_slope(ret,market) AS beta FROM pn WHERE ret IS NOT NULL AND market IS NOT NULL GROUP BY ALL HAVING count(*)>10)"""


@query("agg_regime_beta", _BETA + """ SELECT regime, count(*) AS assets, R(avg(beta)) AS mean_beta, R(stddev_pop(beta)) AS dispersion, sum((beta>1.2)::INT)::BIGINT AS high_beta, sum((beta<0.8)::INT)::BIGINT AS low_beta FROM b WHERE beta IS NOT NULL GROUP BY regime""")
def agg_regime_beta(sp, sf):
    return a.regime_beta_summary(a.regime_beta(_panel(sp, sf)))


@query("agg_regime_beta_assets", _BETA + " SELECT regime, symbol, R(beta) AS beta, CASE WHEN beta>1.2 THEN 'high' WHEN beta<0.8 THEN 'low' ELSE 'neutral' END AS label FROM b")
def agg_regime_beta_assets(sp, sf):
    return a.regime_beta(_panel(sp, sf)).drop("n")


@query("agg_regime_momentum", f"""WITH {_PN}, m AS (SELECT regime, symbol, arg_max(close,date)/arg_min(close,date)-1 AS m FROM pn GROUP BY ALL) SELECT regime, count(m) AS assets, R(avg(m)) AS mean_momentum, R(avg((m>0)::INT)) AS share_positive, sum((m>0.1)::INT)::BIGINT AS strong FROM m GROUP BY regime""")
def agg_regime_momentum(sp, sf):
    return a.regime_momentum(_panel(sp, sf))


@query("agg_regime_reversion", f"""WITH {_PN}, l AS (SELECT regime, symbol, ret, lag(ret) OVER (PARTITION BY regime, symbol ORDER BY date) AS p FROM pn WHERE ret IS NOT NULL), c AS (SELECT regime, symbol, corr(ret,p) AS ac FROM l GROUP BY ALL HAVING count(p)>10)
 SELECT regime, count(*) AS assets, R(avg(ac)) AS mean_autocorr, R(avg((ac<0)::INT)) AS share_reverting FROM c WHERE ac IS NOT NULL GROUP BY regime""")
def agg_regime_reversion(sp, sf):
    return a.regime_reversion(_panel(sp, sf))


MACRO = ["urgent", "high", "medium", "unspecified", "low"]


@query("agg_regime_macro", """WITH x AS (SELECT m.date, m.regime, w.urgent, w.high, w.medium, w.unspecified, w.low FROM mreg m ASOF JOIN macro_fill w ON m.date>=w.date), l AS (SELECT date, regime, 'urgent' AS indicator, urgent AS value FROM x WHERE urgent IS NOT NULL UNION ALL SELECT date, regime, 'high' AS indicator, high AS value FROM x WHERE high IS NOT NULL UNION ALL SELECT date, regime, 'medium' AS indicator, medium AS value FROM x WHERE medium IS NOT NULL UNION ALL SELECT date, regime, 'unspecified' AS indicator, unspecified AS value FROM x WHERE unspecified IS NOT NULL UNION ALL SELECT date, regime, 'low' AS indicator, low AS value FROM x WHERE low IS NOT NULL)
 SELECT regime, indicator, R(avg(value)) AS mean, R(quantile_cont(value,0.5)) AS median, R(stddev_samp(value)) AS std, R(min(value)) AS min, R(max(value)) AS max, CASE WHEN arg_max(value,date)>arg_min(value,date) THEN 'increasing' ELSE 'decreasing' END AS trend FROM l GROUP BY ALL""")
def agg_regime_macro(sp, sf):
    m = d.market_regimes(sp, sf).select("date", "regime")
    x = j.macro_reindex(m, d.macro_wide(sp, sf), MACRO).join(m, "date")
    return a.regime_macro(x.unpivot(["date", "regime"], MACRO, "indicator", "value").where("value is not null"))


@query("agg_cross_regime", """WITH g AS (SELECT series, regime, count(*)::DOUBLE AS n, avg(ret) AS m, var_samp(ret) AS v FROM reg WHERE ret IS NOT NULL GROUP BY ALL),
 t AS (SELECT series, count(*) AS k, sum(n) AS n, sum(n*m)/sum(n) AS gm, sum(n*m*m) AS nm2, sum((n-1)*v) AS wi, max(sqrt(v)) AS hi, min(sqrt(v)) AS lo FROM g GROUP BY series),
 f AS (SELECT *, ((nm2-n*gm*gm)/(k-1))/(wi/(n-k)) AS f FROM t) SELECT series, k, R(n) AS n, R(f) AS f_stat, R(CASE WHEN k=3 THEN power(1+2*greatest(f,0)/(n-k),-(n-k)/2) END) AS p_value, R(hi/nullif(lo,0)) AS vol_ratio FROM f""")
def agg_cross_regime(sp, sf):
    return a.cross_regime(d.regimes(sp, sf))


@query("agg_performance", """WITH x AS (SELECT r.symbol, r.date, r.ret, m.ret AS b FROM rets r JOIN mkt m USING (date) WHERE r.ret IS NOT NULL AND m.ret IS NOT NULL),
 w AS (SELECT *, sum(ln(1+ret)) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS lw FROM x), v AS (SELECT *, exp(lw)/exp(max(lw) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING))-1 AS dd FROM w),
 g AS (SELECT symbol, count(*) AS n, sum(ln(1+ret)) AS l, stddev_samp(ret)*sqrt(252.0::DOUBLE) AS vol, stddev_samp(ret) FILTER (ret<0)*sqrt(252.0::DOUBLE) AS dv, min(dd) AS dd, avg(ret-b) AS em, stddev_samp(ret-b)*sqrt(252.0::DOUBLE) AS te,
  regr_slope(ret,b) AS bt, regr_intercept(ret,b) AS al, avg((ret>0)::INT) AS wr, max(ret) AS bd, min(ret) AS wd, skewness(ret) AS sk, kurtosis(ret) AS ku FROM v GROUP BY symbol),
 h AS (SELECT *, exp(l*252.0::DOUBLE/n)-1 AS ar FROM g)
 SELECT symbol, n, R(exp(l)-1) AS total_return, R(ar) AS annualized_return, R(vol) AS annualized_volatility, R((ar-0.02::DOUBLE)/nullif(vol,0)) AS sharpe_ratio, R(coalesce((ar-0.02::DOUBLE)/nullif(dv,0),0)) AS sortino_ratio,
 R(coalesce(ar/nullif(abs(dd),0),0)) AS calmar_ratio, R(dd) AS max_drawdown, R(coalesce(em*sqrt(252.0::DOUBLE)/nullif(te,0),0)) AS information_ratio, R(te) AS tracking_error, R(al*252) AS alpha, R(bt) AS beta, R(wr) AS win_rate, R(bd) AS best_day, R(wd) AS worst_day, R(sk) AS skewness, R(ku) AS kurtosis FROM h""")
def agg_performance(sp, sf):
    m = d.market(sp, sf).select("date", F.col("ret").alias("bench"))
    return a.performance(d.rets(sp, sf).select("symbol", "date", "ret").join(m, "date"), ["symbol"])


@query("agg_risk_metrics", """WITH v AS (SELECT series, date, ret, CASE WHEN count(ret) OVER w=21 THEN stddev_samp(ret) OVER w*sqrt(252.0::DOUBLE) END AS rv FROM idx WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY series ORDER BY date ROWS 20 PRECEDING)),
 q AS (SELECT series, quantile_cont(ret,0.05) AS q5, quantile_cont(ret,0.01) AS q1 FROM v GROUP BY series)
 SELECT series, R(max(q5)) AS var_95, R(max(q1)) AS var_99, R(avg(ret) FILTER (ret<=q5)) AS cvar_95, R(avg(ret) FILTER (ret<=q1)) AS cvar_99, R(stddev_samp(rv)) AS volatility_of_volatility, R(stddev_samp(ret) FILTER (ret<0)*sqrt(252.0::DOUBLE)) AS downside_deviation,
 R(min(ret)) AS max_daily_loss, R(max(ret)) AS max_daily_gain FROM v JOIN q USING (series) GROUP BY series""")
def agg_risk_metrics(sp, sf):
    return a.risk_metrics(d.index(sp, sf))


_L = "l AS (SELECT series, date, ret, unnest([0,1,2])::INT AS regime, unnest([p0,p1,p2])::DOUBLE AS p FROM reg WHERE ret IS NOT NULL)"


@query("agg_regime_attribution", f"WITH {_L} SELECT series, regime, R(sum(p*ret)) AS contribution, R(sum(p*ret)/nullif(sum(p),0)) AS mean_return, R(stddev_samp(p*ret)*sqrt(252.0::DOUBLE)) AS volatility, R(avg(p)) AS mean_weight FROM l GROUP BY ALL")
def agg_regime_attribution(sp, sf):
    return a.regime_attribution(d.regimes(sp, sf))


@query("agg_weighted_stats", f"WITH {_L}, m AS (SELECT series, regime, sum(p*ret)/nullif(sum(p),0) AS m FROM l GROUP BY ALL) SELECT series, regime, R(max(m)) AS mean, R(sum(p*(ret-m)*(ret-m))/nullif(sum(p),0)) AS variance FROM l JOIN m USING (series, regime) GROUP BY ALL")
def agg_weighted_stats(sp, sf):
    return a.weighted_stats(d.regimes(sp, sf))


_MP = """WITH x AS (SELECT series, i.date, i.ret, regime, p FROM idx i JOIN (SELECT date, unnest([0,1,2])::INT AS regime, unnest([p0,p1,p2])::DOUBLE AS p FROM mreg) USING (date) WHERE i.ret IS NOT NULL AND p>0),
 mp AS (SELECT regime, a.series AS a, b.series AS b, sum(a.p*a.ret*b.ret)/sum(a.p)-sum(a.p*a.ret)/sum(a.p)*(sum(a.p*b.ret)/sum(a.p)) AS cov, sum(a.p*a.ret)/sum(a.p) AS ma, sum(a.p*b.ret)/sum(a.p) AS mb FROM x a JOIN x b USING (regime, date) WHERE a.series<=b.series GROUP BY ALL)"""


def _regime_params(sp, sf):
    p = d.market_regimes(sp, sf).select("date", F.posexplode("probs").alias("regime", "p")).where("p > 0")
    x = d.index(sp, sf).select("series", "date", "ret").join(p, "date")
    m = pairs.pair_moments(x, "series", keys=["regime"], weight="p")
    n = F.col("n")
    return m.select("regime", "a", "b", (F.col("sxy") / n - F.col("sx") / n * (F.col("sy") / n)).alias("cov"), (F.col("sx") / n).alias("ma"), (F.col("sy") / n).alias("mb"))


@query("agg_regime_market_params", _MP + " SELECT regime, a, b, R(cov) AS cov, R(ma) AS ma, R(mb) AS mb FROM mp")
def agg_regime_market_params(sp, sf):
    return _regime_params(sp, sf)


@query("agg_regime_mixture_cov", _MP + """, c AS (SELECT unnest([0,1,2])::INT AS regime, unnest(arg_max([p0,p1,p2],date))::DOUBLE AS p FROM mreg),
 g AS (SELECT a, b, sum(p*(cov+ma*mb)) AS e2, sum(p*ma) AS ea, sum(p*mb) AS eb FROM mp JOIN c USING (regime) GROUP BY ALL) SELECT a, b, R(e2-ea*eb) AS cov, R(ea) AS mean_a, R(eb) AS mean_b FROM g""")
def agg_regime_mixture_cov(sp, sf):
    """Moments of the assets under the regime probabilities of the latest date."""
    now = d.market_regimes(sp, sf).agg(F.max_by("probs", "date").alias("probs")).select(F.posexplode("probs").alias("regime", "p"))
    g = _regime_params(sp, sf).join(now, "regime").groupBy("a", "b").agg(
        F.sum(F.col("p") * (F.col("cov") + F.col("ma") * F.col("mb"))).alias("e2"), F.sum(F.col("p") * F.col("ma")).alias("mean_a"), F.sum(F.col("p") * F.col("mb")).alias("mean_b"))
    return g.select("a", "b", (F.col("e2") - F.col("mean_a") * F.col("mean_b")).alias("cov"), "mean_a", "mean_b")


_RATIO = {"gross_margin": "gross_profit/nullif(revenue,0)", "operating_margin": "operating_income/nullif(revenue,0)", "net_margin": "net_income/nullif(revenue,0)", "roa": "net_income/nullif(total_assets,0)",
          "roe": "net_income/nullif(total_equity,0)", "current_ratio": "current_assets/nullif(current_liabilities,0)", "quick_ratio": "(current_assets-inventory)/nullif(current_liabilities,0)",
          "cash_ratio": "cash/nullif(current_liabilities,0)", "debt_to_assets": "total_debt/nullif(total_assets,0)", "debt_to_equity": "total_debt/nullif(total_equity,0)", "asset_turnover": "revenue/nullif(total_assets,0)",
          "inventory_turnover": "(revenue-gross_profit)/nullif(inventory,0)", "pe_ratio": "price*shares/nullif(net_income,0)", "pb_ratio": "price*shares/nullif(total_equity,0)", "ps_ratio": "price*shares/nullif(revenue,0)",
          "ev_revenue": "(price*shares+total_debt-cash)/nullif(revenue,0)", "ev_operating": "(price*shares+total_debt-cash)/nullif(operating_income,0)",
          "ebitda_margin": "ebitda/nullif(revenue,0)", "ev_ebitda": "(price*shares+total_debt-cash)/nullif(ebitda,0)",
          "forward_pe": "price*shares/nullif(net_income*(1+CASE WHEN prior_income>0 THEN net_income/prior_income-1 END),0)",
          "peg_ratio": "price*shares/nullif(net_income,0)/nullif(100*CASE WHEN prior_income>0 THEN net_income/prior_income-1 END,0)",
          "dividend_yield": "dividends/nullif(price*shares,0)", "payout_ratio": "dividends/nullif(net_income,0)"}
_LATEST = "lt AS (SELECT *, lag(net_income) OVER (PARTITION BY symbol ORDER BY fiscal_date) AS prior_income FROM fund QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY fiscal_date DESC)=1)"


@query("agg_fundamental_ratios", f"WITH {_LATEST} SELECT symbol, " + ", ".join(f"R({e}) AS {n}" for n, e in _RATIO.items()) + " FROM lt", 5)
def agg_fundamental_ratios(sp, sf):
    return fu.ratios(d.fundamentals(sp, sf))


def _gr(l):
    return f"R(max({l}) FILTER (i_{l}=1)) AS {l}_growth_1y, R(CASE WHEN count({l})>=3 THEN avg({l}) FILTER (i_{l}<=3) END) AS {l}_growth_3y_avg, R(CASE WHEN count({l})>=5 THEN avg({l}) END) AS {l}_growth_5y_avg, R(CASE WHEN count({l})>1 THEN stddev_pop({l}) END) AS {l}_growth_volatility"


def _growth(lines):
    return ("g0 AS (SELECT symbol, fiscal_date, " + ", ".join(f"{l}/nullif(lag({l}) OVER s,0)-1 AS {l}" for l in lines) + " FROM fund_y WINDOW s AS (PARTITION BY symbol ORDER BY fiscal_date)),"
            " g1 AS (SELECT *, " + ", ".join(f"count({l}) OVER (PARTITION BY symbol ORDER BY fiscal_date DESC) AS i_{l}" for l in lines) + " FROM g0)")


@query("agg_growth_metrics", "WITH " + _growth(fu.GROWTH_LINES) + " SELECT symbol, " + ", ".join(_gr(l) for l in fu.GROWTH_LINES) + " FROM g1 GROUP BY symbol", 5)
def agg_growth_metrics(sp, sf):
    return fu.growth(d.fundamentals(sp, sf, "year"))


@query("agg_valuation", f"""WITH {_LATEST}, v AS (SELECT *, price*shares AS cap, price*shares+total_debt-cash AS ev FROM lt) SELECT symbol, R2(cap) AS market_cap, R2(ev) AS enterprise_value, R(cap/nullif(total_equity,0)) AS price_to_book, R(cap/nullif(revenue,0)) AS price_to_sales,
 R(ev/nullif(operating_income,0)) AS ev_to_operating, R(ev/nullif(revenue,0)) AS ev_to_revenue, R(price/nullif(total_equity/nullif(shares,0),0)) AS price_to_book_calculated FROM v""", market_cap=2, enterprise_value=2)
def agg_valuation(sp, sf):
    return fu.valuation(d.fundamentals(sp, sf))


_QUAL = """q0 AS (SELECT symbol, avg((net_income>0)::INT) AS pos, stddev_samp(net_income/nullif(total_equity,0)) AS vol FROM fund GROUP BY symbol),
 q1 AS (SELECT symbol, (pos+coalesce(1/(1+vol),0))/2 AS pq, (coalesce(1-least(total_debt/nullif(total_assets,0),1),0)+coalesce(least(current_assets/nullif(current_liabilities,0)/2,1),0))/2 AS fs,
  CASE WHEN net_income>0 THEN least(operating_cash_flow/net_income,2)/2 ELSE 0 END AS eq FROM q0 JOIN lt USING (symbol)),
 q2 AS (SELECT *, (pq*0.4::DOUBLE+fs*0.4::DOUBLE+eq*0.2::DOUBLE)/3 AS oq FROM q1)"""


@query("agg_quality_scores", f"WITH {_LATEST}, {_QUAL} SELECT symbol, R(pq) AS profitability_quality, R(fs) AS financial_strength, R(eq) AS earnings_quality, R(oq) AS overall_quality FROM q2")
def agg_quality_scores(sp, sf):
    return fu.quality(d.fundamentals(sp, sf))


_MXR = ["pe_ratio", "pb_ratio", "ps_ratio", "roe", "roa", "debt_to_equity", "current_ratio", "gross_margin", "operating_margin", "net_margin"]
_MX = f"""WITH {_LATEST}, {_QUAL}, {_growth(['revenue', 'net_income'])},
 gg AS (SELECT symbol, max(revenue) FILTER (i_revenue=1) AS revenue_growth_1y, CASE WHEN count(revenue)>=3 THEN avg(revenue) FILTER (i_revenue<=3) END AS revenue_growth_3y_avg, max(net_income) FILTER (i_net_income=1) AS net_income_growth_1y,
  CASE WHEN count(net_income)>=3 THEN avg(net_income) FILTER (i_net_income<=3) END AS net_income_growth_3y_avg FROM g1 GROUP BY symbol),
 mx AS (SELECT symbol, sector, industry, price*shares AS market_cap, {', '.join(f'{_RATIO[k]} AS {k}' for k in _MXR)}, revenue_growth_1y, revenue_growth_3y_avg, net_income_growth_1y, net_income_growth_3y_avg, pq AS profitability_quality, fs AS financial_strength, oq AS overall_quality
  FROM sectors JOIN lt USING (symbol) JOIN gg USING (symbol) JOIN q2 USING (symbol))"""
_MXC = _MXR + ["revenue_growth_1y", "revenue_growth_3y_avg", "net_income_growth_1y", "net_income_growth_3y_avg", "profitability_quality", "financial_strength", "overall_quality"]


@query("agg_fundamental_matrix", _MX + " SELECT symbol, sector, industry, R2(market_cap) AS market_cap, " + ", ".join(f"R({c}) AS {c}" for c in _MXC) + " FROM mx", 5, market_cap=2)
def agg_fundamental_matrix(sp, sf):
    return fu.matrix(d.fundamentals(sp, sf), d.fundamentals(sp, sf, "year"), d.sectors(sp, sf))


def _sc(c):
    e = f"({c}-min({c}) OVER ())/nullif(max({c}) OVER ()-min({c}) OVER (),0)"
    return f"{'1-' if c in fu.INVERSE else ''}{e} AS {c}_score"


def _rm(cols):
    return "(" + "+".join(f"coalesce({c},0)" for c in cols) + ")/nullif(" + "+".join(f"({c} IS NOT NULL)::INT" for c in cols) + ",0)"


@query("agg_fundamental_scores", _MX + ", s AS (SELECT symbol, sector, " + ", ".join(_sc(c) for c in fu.SCORES + fu.INVERSE) + " FROM mx), g AS (SELECT *, "
       + ", ".join(f"{_rm([c + '_score' for c in cs])} AS {k}_composite" for k, cs in fu.GROUPS.items()) + " FROM s) SELECT symbol, sector, "
       + ", ".join(f"R({c}_score) AS {c}_score" for c in fu.SCORES + fu.INVERSE) + ", " + ", ".join(f"R({k}_composite) AS {k}_composite" for k in fu.GROUPS)
       + f", R({_rm([k + '_composite' for k in fu.GROUPS])}) AS overall_score FROM g")
def agg_fundamental_scores(sp, sf):
    return fu.scores(fu.matrix(d.fundamentals(sp, sf), d.fundamentals(sp, sf, "year"), d.sectors(sp, sf)))


_FAC = """f0 AS (SELECT symbol, date, ret, lag(ret) OVER (PARTITION BY symbol ORDER BY date) AS p FROM rets),
 f1 AS (SELECT symbol, date, ret, """ + ", ".join(f"CASE WHEN count(ret) OVER w{n}={n} THEN {f}(ret) OVER w{n} END AS {k}" for n, f, k in ((21, "avg", "m21"), (63, "avg", "m63"), (252, "avg", "m252"), (21, "stddev_samp", "s21"), (63, "stddev_samp", "s63"))) + \
    ", CASE WHEN count(ret) OVER w21=21 THEN corr(ret,p) OVER w20 END AS ac FROM f0 WINDOW " + ", ".join(f"w{n} AS (PARTITION BY symbol ORDER BY date ROWS {n - 1} PRECEDING)" for n in (20, 21, 63, 252)) + """),
 f2 AS (SELECT date, avg(ret) AS market, stddev_samp(ret) AS sd, avg(m21) AS m21, avg(m63) AS m63, avg(m252) AS m252, avg(s21) AS s21, avg(s63) AS s63, avg(ac) AS ac FROM f1 GROUP BY date HAVING avg(ret) IS NOT NULL),
 fac AS (SELECT date, market, -sd AS smb, m252-m21 AS hml, m21 AS momentum_1m, m63 AS momentum_3m, m252 AS momentum_12m, m252-m21 AS momentum, -s63 AS profitability, -ac AS investment_quality, s21 AS volatility, -s21 AS low_volatility,
  s21-CASE WHEN count(s21) OVER w=252 THEN avg(s21) OVER w END AS volatility_risk_premium FROM f2 WINDOW w AS (ORDER BY date ROWS 251 PRECEDING))"""
FACTORS = "market smb hml momentum_1m momentum_3m momentum_12m momentum profitability investment_quality volatility low_volatility volatility_risk_premium".split()


@query("agg_factor_series", f"WITH {_FAC} SELECT date, " + ", ".join(f"R({c}) AS {c}" for c in FACTORS) + " FROM fac")
def agg_factor_series(sp, sf):
    return a.factor_series(d.rets(sp, sf))


@query("agg_resample", """WITH x AS (SELECT series, date_trunc('month',date)::TIMESTAMP AS m, last(close ORDER BY date) AS close FROM (SELECT series, date AS date, close FROM idx) GROUP BY ALL) SELECT series, last_day(m)::TIMESTAMP AS date, R(close) AS close FROM x""")
def agg_resample(sp, sf):
    return a.resample_last(d.index(sp, sf), "month", "series", "close")


_CV = "WITH x AS (SELECT symbol, date, ret FROM rets WHERE ret IS NOT NULL), c AS (SELECT p.symbol AS a, q.symbol AS b, count(*)::DOUBLE AS n, covar_samp(p.ret,q.ret) AS cov, corr(p.ret,q.ret) AS corr FROM x p JOIN x q ON p.date=q.date AND p.symbol<=q.symbol GROUP BY ALL)"


@query("agg_covariance", _CV + " SELECT a, b, R(n) AS n, R(cov) AS cov FROM c")
def agg_covariance(sp, sf):
    return pairs.asset_covariance(d.rets(sp, sf))


@query("agg_correlation", _CV + " SELECT a, R(max(abs(corr))) AS max_abs_corr, R(avg(corr)) AS mean_corr, count(*) AS pairs FROM c WHERE a<>b AND n>=10 GROUP BY a")
def agg_correlation(sp, sf):
    c = pairs.correlation_totals(d.rets(sp, sf), True, 10)
    return c.select("a", F.col("top").alias("max_abs_corr"), (F.col("s") / F.nullif("known", F.lit(0))).alias("mean_corr"), "pairs")


@query("agg_cov_ledoit_wolf", """WITH x AS (SELECT series, date, ret FROM idx WHERE ret IS NOT NULL), t AS (SELECT count(DISTINCT date)::DOUBLE AS t FROM x), g AS (SELECT s.series, dd.date, coalesce(x.ret,0) AS r FROM (SELECT DISTINCT series FROM x) s CROSS JOIN (SELECT DISTINCT date FROM x) dd LEFT JOIN x ON x.series=s.series AND x.date=dd.date),
 c AS (SELECT series, date, r-avg(r) OVER (PARTITION BY series) AS r FROM g), s AS (SELECT p.series AS a, q.series AS b, avg(p.r*q.r) AS s FROM c p JOIN c q USING (date) GROUP BY ALL),
 n2 AS (SELECT sum(v*v) AS beta_ FROM (SELECT sum(r*r) AS v FROM c GROUP BY date)), k AS (SELECT sum(s*s) AS delta_, sum(s) FILTER (a=b) AS tr, count(*) FILTER (a=b)::DOUBLE AS p FROM s),
 z AS (SELECT t, tr/p AS mu, (beta_/t-delta_)/(p*t) AS beta, (delta_-2*(tr/p)*tr+p*(tr/p)*(tr/p))/p AS delta FROM k, n2, t), h AS (SELECT mu, greatest(least(beta,delta),0)/delta AS sh FROM z)
 SELECT a, b, R((1-sh)*s+CASE WHEN a=b THEN sh*mu ELSE 0 END) AS cov, R(sh) AS shrinkage FROM s, h WHERE a<=b""")
def agg_cov_ledoit_wolf(sp, sf):
    return pairs.ledoit_wolf(d.index(sp, sf), "series")


@query("agg_ic", """WITH b AS (SELECT ret, volume, close, lead(ret) OVER (PARTITION BY symbol ORDER BY date) AS fwd FROM rets), l AS (SELECT unnest(['ret','volume','close']) AS feature, unnest([ret,volume,close]) AS x, fwd FROM b),
 k AS (SELECT * FROM l WHERE x IS NOT NULL AND fwd IS NOT NULL), r AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY x)+(count(*) OVER (PARTITION BY feature, x)-1)/2.0::DOUBLE AS rx, rank() OVER (PARTITION BY feature ORDER BY fwd)+(count(*) OVER (PARTITION BY feature, fwd)-1)/2.0::DOUBLE AS ry FROM k)
 SELECT feature, R(corr(rx,ry)) AS ic, count(*) AS n FROM r GROUP BY feature""")
def agg_ic(sp, sf):
    from tidepanel.operators.technical import forward_return
    return a.information_coefficient(forward_return(d.rets(sp, sf)), ["ret", "volume", "close"], "fwd_ret_1")


@query("agg_portfolio_metrics", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY abs(weight) DESC, symbol) AS rk FROM weights) SELECT date, R(sum(abs(weight))) AS gross, R(sum(weight)) AS net, R(sum(greatest(weight,0))) AS long, R(sum(least(weight,0))) AS short,
 sum((abs(weight)>1e-6)::INT)::BIGINT AS positions, R(max(abs(weight))) AS max_weight, R(sum(weight*weight)) AS hhi, R(sum(abs(weight)) FILTER (rk<=5)) AS top5 FROM r GROUP BY date""")
def agg_portfolio_metrics(sp, sf):
    return a.portfolio_metrics(d.weights(sp, sf))


@query("agg_turnover", """WITH dd AS (SELECT date, lead(date) OVER (ORDER BY date) AS nx FROM (SELECT DISTINCT date FROM weights)), u AS (SELECT symbol, date, weight FROM weights UNION ALL SELECT symbol, nx, -weight FROM weights JOIN dd USING (date) WHERE nx IS NOT NULL),
 w AS (SELECT symbol, date, sum(weight) AS dw FROM u GROUP BY ALL) SELECT date, R(sum(abs(dw))) AS turnover, R(sum(abs(dw))*10) AS cost_bps, sum((abs(dw)>1e-6)::INT)::BIGINT AS trades, sum((dw>1e-6)::INT)::BIGINT AS buys, sum((dw< -1e-6)::INT)::BIGINT AS sells FROM w GROUP BY date""")
def agg_turnover(sp, sf):
    return a.turnover(d.weights(sp, sf))


_EX = """fl AS (SELECT l_orderkey AS order_id, l_suppkey AS symbol, sum(l_quantity) AS q, sum(l_extendedprice) AS v, sum(l_extendedprice*l_tax*0.01::DOUBLE) AS c, count(*) AS fills FROM lineitem GROUP BY ALL),
 np AS (SELECT o.*, (order_id%2*2-1)::INT AS side, b.date AS pd, b.close AS pc FROM pord o ASOF LEFT JOIN bars b ON o.symbol=b.symbol AND o.order_time>=b.date), nn AS (SELECT np.*, b.date AS nd, b.close AS nc FROM np ASOF LEFT JOIN bars b ON np.symbol=b.symbol AND np.order_time<=b.date),
 ar AS (SELECT order_id, symbol, side, CASE WHEN pd IS NULL THEN nc WHEN nd IS NULL THEN pc WHEN order_time-pd<=nd-order_time THEN pc ELSE nc END AS ap, nc AS cp FROM nn),
 ec AS (SELECT order_id, symbol, q AS total_quantity, v/q AS vwap, ap AS arrival_price, side*(v/q-ap)/ap*10000 AS isf, c/v*10000 AS cm, coalesce(side*(cp-ap)/ap*10000,0) AS tr, fills FROM fl JOIN ar USING (order_id, symbol))"""


def _costs(sp, sf):
    po = d.parent_orders(sp, sf)
    o = j.nearest_price(po, d.bars(sp, sf), keep_next=True).withColumnsRenamed({"market_price": "arrival_price", "next_price": "completion_price"})
    o = o.withColumn("side", (F.col("order_id") % 2 * 2 - 1).cast("int"))
    li = d.table(sp, sf, "lineitem")
    f = li.select(F.col("l_orderkey").alias("order_id"), F.col("l_suppkey").alias("symbol"), div("l_extendedprice", "l_quantity").alias("price"),
                  F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") * F.col("l_tax") * 0.01).alias("commission"))
    return ex.costs(o.select("order_id", "symbol", "side", "arrival_price", "completion_price"), f), po


@query("agg_exec_costs", f"WITH {_EX} SELECT order_id, symbol, R(total_quantity) AS total_quantity, R(vwap) AS vwap, R(arrival_price) AS arrival_price, R(isf) AS implementation_shortfall_bps, R(cm) AS commission_bps, R(tr) AS timing_risk_bps, R(isf+cm) AS total_cost_bps, fills FROM ec", 4)
def agg_exec_costs(sp, sf):
    return _costs(sp, sf)[0]


@query("agg_exec_summary", f"WITH {_EX} SELECT count(*) AS completed_orders, sum(fills)::BIGINT AS total_fills, R(avg(isf)) AS avg_implementation_shortfall_bps, R(avg(cm)) AS avg_commission_bps, R(avg(isf+cm)) AS avg_total_cost_bps, (SELECT count(*) FROM pord) AS total_orders FROM ec", 4)
def agg_exec_summary(sp, sf):
    c, po = _costs(sp, sf)
    return ex.summary(c, po)


@query("agg_dq_cross", """WITH r AS (SELECT min(date) AS lo, max(date) AS hi FROM bars UNION ALL SELECT min(fiscal_date), max(fiscal_date) FROM fund UNION ALL SELECT min(date), max(date) FROM weights),
 k AS (SELECT symbol, count(*) AS c FROM (SELECT DISTINCT symbol FROM bars UNION ALL SELECT DISTINCT symbol FROM fund UNION ALL SELECT DISTINCT symbol FROM weights) GROUP BY symbol), x AS (SELECT count(*) AS symbols, sum((c=3)::INT)::BIGINT AS common FROM k), y AS (SELECT date_diff('day',min(lo),max(lo))::INT AS start_spread, date_diff('day',min(hi),max(hi))::INT AS end_spread FROM r)
 SELECT start_spread, end_spread, symbols, common, R(common::DOUBLE/symbols) AS overlap, CASE WHEN start_spread>30 OR end_spread>30 THEN 'WARNING' ELSE 'PASS' END AS status FROM x, y""")
def agg_dq_cross(sp, sf):
    f = d.fundamentals(sp, sf).select("symbol", F.col("fiscal_date").alias("date"))
    return q.cross_dataset({"bars": d.bars(sp, sf), "fund": f, "weights": d.weights(sp, sf)})
