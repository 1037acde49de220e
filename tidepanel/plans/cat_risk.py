"""Queries for risk, portfolio construction inputs, backtests and execution."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.core.scratch import materialise
from tidepanel.core.frames import change, div, ordered
from tidepanel.models import factors as fm
from tidepanel.operators import backtest as bt, execution as ex, pairs, risk as rk, sets
from tidepanel.plans.cat_models import FX, _LD, _factors, _panel
from tidepanel.plans.registry import query
from tidepanel.sources import domain as d


def last_book(sp, sf, daily=None):
    # sides of all months feed the last date, its counts and its rows: trades are read once, or not at all if daily bars are given
    m = materialise(d.momentum_sides(d.bars(sp, sf) if daily is None else daily), "sides")
    return d.book(m.join(m.agg(F.max("date").alias("date")), "date")).select("symbol", "weight")


def model(sp, sf):
    """(betas long, factor covariance, specific variance) of the two-factor model."""
    # the panel and the loadings feed several branches: write each once instead of recomputing
    p = materialise(_panel(sp, sf), "panel")
    l = materialise(fm.loadings(p, FX), "loadings")
    spec = fm.alpha_components(p, l, FX).select("symbol", F.col("alpha_var").alias("specific_var"))
    betas = l.select("symbol", F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col("loadings")[i].alias("beta")) for i, f in enumerate(FX)])).alias("b")).select("symbol", "b.*")
    return betas, fm.factor_covariance(_factors(sp, sf), FX).drop("regime"), spec


_WL = "wl AS (SELECT symbol, weight FROM weights WHERE date=(SELECT max(date) FROM weights))"
_MD = f"""WITH {_LD}, {_WL}, fc AS (SELECT var_samp(market) AS f11, covar_samp(market,smb) AS f12, var_samp(smb) AS f22 FROM fac WHERE smb IS NOT NULL),
 sv AS (SELECT symbol, var_samp(ret-b1*market-b2*smb) AS sv FROM pf JOIN ld USING (symbol) GROUP BY symbol), ep AS (SELECT sum(weight*b1) AS e1, sum(weight*b2) AS e2 FROM wl JOIN ld USING (symbol)),
 vs AS (SELECT e1*e1*f11+2*e1*e2*f12+e2*e2*f22 AS fv, (SELECT sum(weight*weight*sv) FROM wl JOIN sv USING (symbol)) AS iv FROM ep, fc),
 cb AS (SELECT symbol, weight, b1*(e1*f11+e2*f12)+b2*(e1*f12+e2*f22)+weight*sv AS mg FROM wl JOIN ld USING (symbol) JOIN sv USING (symbol), ep, fc),
 cs AS (SELECT symbol, weight, mg, weight*mg AS cp, weight*mg/sum(weight*mg) OVER () AS sh FROM cb)"""


@query("risk_variance_split", _MD + " SELECT R(fv) AS factor_variance, R(iv) AS specific_variance, R(fv+iv) AS total_variance, R(sqrt(fv+iv)) AS volatility, R(fv/(fv+iv)) AS factor_share FROM vs")
def risk_variance_split(sp, sf):
    return rk.variance_split(last_book(sp, sf), *model(sp, sf))


@query("risk_concentration", _MD + " SELECT R(sum(sh*sh)) AS herfindahl, R(1/sum(sh*sh)) AS effective_bets FROM cs", 5)
def risk_concentration(sp, sf):
    return rk.concentration(rk.contributions(last_book(sp, sf), *model(sp, sf)))


@query("agg_risk_attribution", f"""WITH {_WL}, x AS (SELECT symbol, date, ret FROM rets WHERE ret IS NOT NULL), c AS (SELECT p.symbol AS a, q.symbol AS b, covar_samp(p.ret,q.ret) AS cov FROM x p JOIN x q USING (date) GROUP BY ALL HAVING count(*)>1),
 m AS (SELECT a AS symbol, sum(cov*weight) AS mg FROM c JOIN wl ON c.b=wl.symbol GROUP BY a) SELECT symbol, R(weight) AS weight, R(mg) AS marginal, R(weight*mg) AS component, R(weight*mg/sum(weight*mg) OVER ()) AS share FROM wl JOIN m USING (symbol)""", 5)
def agg_risk_attribution(sp, sf):
    daily = materialise(d.bars(sp, sf).select("symbol", "date", "close"), "closes")
    book = materialise(last_book(sp, sf, daily), "book")
    # only the book's assets are asked for; their marginals feed both the shares and the total
    marginal = materialise(pairs.marginal_risk(d.with_returns(daily.join(book, "symbol", "left_semi")), book, inside=True), "marginal")
    return rk.marginal_attribution(book, marginal)


_PR = f"{_WL}, pr AS (SELECT date, sum(weight*ret) AS ret FROM rets JOIN wl USING (symbol) WHERE ret IS NOT NULL GROUP BY date)"


@query("risk_var_cvar", f"WITH {_PR}, q AS (SELECT quantile_cont(ret,0.05) AS a, quantile_cont(ret,0.01) AS b FROM pr) SELECT R(max(a)) AS var_95, R(avg(ret) FILTER (ret<=a)) AS cvar_95, R(avg(ret)-1.6449::DOUBLE*stddev_samp(ret)) AS parametric_var_95, R(max(b)) AS var_99, R(avg(ret) FILTER (ret<=b)) AS cvar_99, R(avg(ret)-2.3263::DOUBLE*stddev_samp(ret)) AS parametric_var_99 FROM pr, q")
def risk_var_cvar(sp, sf):
    return rk.var_cvar(rk.portfolio_returns(last_book(sp, sf), d.rets(sp, sf)))


@query("risk_component_var", f"""WITH {_PR}, t AS (SELECT date FROM pr WHERE ret<=(SELECT quantile_cont(ret,0.05) FROM pr)), m AS (SELECT symbol, avg(ret) AS m FROM rets WHERE ret IS NOT NULL AND date IN (SELECT date FROM t) GROUP BY symbol)
 SELECT symbol, R(weight*m) AS component_var FROM wl JOIN m USING (symbol) WHERE (SELECT count(*) FROM t)>5""")
def risk_component_var(sp, sf):
    return rk.component_var(last_book(sp, sf), d.rets(sp, sf))


@query("risk_marginal_var", f"""WITH {_PR}, w AS (SELECT sum(weight) AS w FROM wl), z AS (SELECT s.symbol, p.date, (p.ret+1e-6::DOUBLE*coalesce(r.ret,0))/(w.w+1e-6::DOUBLE) AS v FROM wl s CROSS JOIN pr p CROSS JOIN w LEFT JOIN rets r ON r.symbol=s.symbol AND r.date=p.date)
 SELECT symbol, R((quantile_cont(v,0.05)-(SELECT quantile_cont(ret,0.05) FROM pr))/1e-6::DOUBLE) AS marginal_var FROM z GROUP BY symbol""", 4)
def risk_marginal_var(sp, sf):
    return rk.marginal_var(last_book(sp, sf), d.rets(sp, sf))


def scenarios(sp):
    # fixed values: default factor shocks
    return sp.createDataFrame([("crash", "market", -0.2), ("crash", "smb", -0.1), ("rally", "market", 0.15), ("dispersion", "smb", -0.3)], "scenario string, factor string, shock double")


@query("risk_factor_shock", _MD + """, sc AS (SELECT * FROM (VALUES ('crash','market',-0.2::DOUBLE),('crash','smb',-0.1::DOUBLE),('rally','market',0.15::DOUBLE),('dispersion','smb',-0.3::DOUBLE)) t(scenario,factor,shock)), el AS (SELECT 'market' AS factor, e1 AS e FROM ep UNION ALL SELECT 'smb', e2 FROM ep)
 SELECT scenario, factor, R(e) AS exposure, R(shock) AS shock, R(e*shock) AS impact FROM el JOIN sc USING (factor)""")
def risk_factor_shock(sp, sf):
    return rk.factor_shocks(rk.exposures(last_book(sp, sf), model(sp, sf)[0]), scenarios(sp))


@query("risk_historical_stress", f"""WITH {_PR}, t AS (SELECT date FROM (SELECT date, avg(ret) AS r FROM rets WHERE ret IS NOT NULL GROUP BY date) ORDER BY r, date LIMIT 3), x AS (SELECT symbol, date, weight*ret AS i FROM rets JOIN wl USING (symbol) WHERE ret IS NOT NULL AND date IN (SELECT date FROM t))
 SELECT symbol, date, R(i) AS impact, R(sum(i) OVER (PARTITION BY date)) AS portfolio_impact FROM x""")
def risk_historical_stress(sp, sf):
    r = d.rets(sp, sf)
    worst = sets.top(bt.benchmark(r), 3, F.col("ret"), F.col("date"))
    return rk.historical_stress(last_book(sp, sf), r, worst)


@query("risk_hedge_ratio", f"""WITH {_PR}, x AS (SELECT i.series, pr.ret AS p, i.ret AS r FROM pr JOIN idx i USING (date) WHERE i.ret IS NOT NULL)
 SELECT series, count(*) AS n, R(-regr_slope(p,r)) AS hedge_ratio, R(power(corr(p,r),2)) AS r_squared, R(1-(var_samp(p)-power(covar_samp(p,r),2)/var_samp(r))/var_samp(p)) AS variance_reduction FROM x GROUP BY series HAVING count(*)>50""")
def risk_hedge_ratio(sp, sf):
    return rk.hedge_ratios(rk.portfolio_returns(last_book(sp, sf), d.rets(sp, sf)), d.index(sp, sf))


def _regime_model(sp, sf):
    m = d.market_regimes(sp, sf).select("date", "probs")
    cov = fm.factor_covariance(_factors(sp, sf).join(m, "date"), FX, regime=True)
    cur = m.agg(F.max_by("probs", "date").alias("p")).select(F.posexplode("p").alias("regime", "p"))
    return cov, cur


@query("risk_regime_attribution", _MD + """, x AS (SELECT market, smb, rg, p FROM fac JOIN (SELECT date, unnest([0,1,2])::INT AS rg, unnest([p0,p1,p2])::DOUBLE AS p FROM mreg) USING (date) WHERE smb IS NOT NULL),
 g AS (SELECT rg, sum(p*market)/sum(p) AS m1, sum(p*smb)/sum(p) AS m2, sum(p*market*market)/sum(p) AS q11, sum(p*market*smb)/sum(p) AS q12, sum(p*smb*smb)/sum(p) AS q22 FROM x GROUP BY rg),
 cur AS (SELECT unnest([0,1,2])::INT AS rg, unnest(arg_max([p0,p1,p2],date))::DOUBLE AS p FROM mreg), v AS (SELECT rg, e1*e1*(q11-m1*m1)+2*e1*e2*(q12-m1*m2)+e2*e2*(q22-m2*m2) AS v FROM g, ep)
 SELECT rg AS regime, R(p) AS p, R(v) AS variance, R(p*v) AS contribution FROM v JOIN cur USING (rg)""")
def risk_regime_attribution(sp, sf):
    cov, cur = _regime_model(sp, sf)
    return rk.regime_attribution(last_book(sp, sf), model(sp, sf)[0], cov, cur)


@query("risk_summary", _MD + f""", pr AS (SELECT date, sum(weight*ret) AS ret FROM rets JOIN wl USING (symbol) WHERE ret IS NOT NULL GROUP BY date), u AS (SELECT 'variance' AS section, unnest(['factor_variance','specific_variance','total_variance','volatility','factor_share']) AS metric, unnest([fv,iv,fv+iv,sqrt(fv+iv),fv/(fv+iv)]) AS v FROM vs
 UNION ALL SELECT 'tail', unnest(['var_95','cvar_95']), unnest([max(q), avg(ret) FILTER (ret<=q)]) FROM pr, (SELECT quantile_cont(ret,0.05) AS q FROM pr) UNION ALL SELECT 'concentration', unnest(['herfindahl','effective_bets']), unnest([sum(sh*sh),1/sum(sh*sh)]) FROM cs) SELECT section, metric, R(v) AS value FROM u""", 5)
def risk_summary(sp, sf):
    w, m, r = last_book(sp, sf), model(sp, sf), d.rets(sp, sf)
    return rk.summary(variance=rk.variance_split(w, *m), tail=rk.var_cvar(rk.portfolio_returns(w, r)).select("var_95", "cvar_95"),
                      concentration=rk.concentration(rk.contributions(w, *m)))


@query("port_factor_exposure", f"WITH {_LD} SELECT date, unnest(['market','smb']) AS factor, R(unnest([sum(weight*b1),sum(weight*b2)])) AS exposure FROM weights JOIN ld USING (symbol) GROUP BY date")
def port_factor_exposure(sp, sf):
    return rk.exposures(d.weights(sp, sf), model(sp, sf)[0], ["date"])


@query("port_expected_returns", """WITH r AS (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM rets WHERE ret IS NOT NULL), g AS (SELECT symbol, count(*) AS n, avg(ret) FILTER (k<=63) AS a, avg(ret) FILTER (k<=126) AS b, avg(ret) AS c FROM r WHERE k<=252 GROUP BY symbol HAVING count(*)>=50),
 p AS (SELECT arg_max([p0,p1,p2],date)::DOUBLE[] AS p FROM mreg) SELECT symbol, n, R(p[1]*a+p[2]*b+p[3]*c) AS expected_return FROM g, p""")
def port_expected_returns(sp, sf):
    cur = d.market_regimes(sp, sf).agg(F.max_by("probs", "date").alias("probs"))
    return bt.expected_returns(d.rets(sp, sf), cur)


@query("port_equal_weight", "SELECT symbol, date, R(1.0::DOUBLE/count(*) OVER (PARTITION BY date)) AS weight FROM weights")
def port_equal_weight(sp, sf):
    return bt.equal_weight(d.weights(sp, sf).select("symbol", "date"))


@query("bt_rebalance_dates", """SELECT 'weekly' AS frequency, max(date) AS date FROM mkt GROUP BY date_trunc('week',date) UNION ALL SELECT 'monthly', max(date) FROM mkt GROUP BY date_trunc('month',date) UNION ALL SELECT 'quarterly', max(date) FROM mkt GROUP BY date_trunc('quarter',date)
 UNION ALL SELECT 'monthly_strict', date FROM mkt WHERE date=(last_day(date)-greatest(isodow(last_day(date))-5,0)::INT)""")
def bt_rebalance_dates(sp, sf):
    m = d.market(sp, sf)
    out = [bt.rebalance_dates(m, f).select(F.lit(f).alias("frequency"), "date") for f in ("weekly", "monthly", "quarterly")]
    out.append(bt.rebalance_dates(m, "monthly", strict=True).select(F.lit("monthly_strict").alias("frequency"), "date"))
    return sets.stack(out)


@query("bt_walk_forward", """WITH x AS (SELECT series, date, ret AS x, lead(ret) OVER (PARTITION BY series ORDER BY date) AS y FROM idx), k AS (SELECT series, date_trunc('month',date)::TIMESTAMP AS m, x, y FROM x WHERE x IS NOT NULL AND y IS NOT NULL), mm AS (SELECT DISTINCT series, m FROM k),
 f AS (SELECT mm.series, mm.m, count(*) AS n, regr_slope(y,x) AS b, regr_intercept(y,x) AS a FROM mm JOIN k ON k.series=mm.series AND k.m<mm.m AND k.m>=mm.m-INTERVAL 12 MONTH GROUP BY ALL HAVING count(*)>=50)
 SELECT f.series, f.m AS rebalance_date, n AS n_train, count(*) AS n_test, R(b) AS slope, R(a) AS intercept, R(avg(power(y-a-b*x,2))) AS test_mse FROM f JOIN k ON k.series=f.series AND k.m=f.m GROUP BY f.series, f.m, n, a, b""")
def bt_walk_forward(sp, sf):
    return bt.walk_forward(d.index(sp, sf).withColumn("y", F.lead("ret").over(ordered("series"))))


@query("bt_portfolio_returns", """WITH bk AS (SELECT DISTINCT date AS rb FROM weights), dd AS (SELECT x.date, bk.rb FROM (SELECT DISTINCT date FROM rets) x ASOF JOIN bk ON x.date>bk.rb)
 SELECT r.date, R(sum(w.weight*r.ret)) AS ret, R(sum(w.weight)) AS invested, count(*) AS positions FROM rets r JOIN dd USING (date) JOIN weights w ON w.symbol=r.symbol AND w.date=dd.rb WHERE r.ret IS NOT NULL GROUP BY r.date""")
def bt_portfolio_returns(sp, sf):
    return bt.portfolio_returns(d.weights(sp, sf), d.rets(sp, sf))


@query("bt_trades_costs", """WITH lw AS (SELECT symbol, date, weight FROM weights), gr AS (SELECT symbol, last_day(month)::TIMESTAMP AS date, lead(close) OVER (PARTITION BY symbol ORDER BY month)/close AS g FROM wmonth),
 j AS (SELECT lw.symbol, lw.date, weight, coalesce(g,1) AS g FROM lw LEFT JOIN gr USING (symbol, date)), pg AS (SELECT date, 1+sum(weight*(g-1)) AS pg FROM j GROUP BY date), dd AS (SELECT date, lead(date) OVER (ORDER BY date) AS nx FROM pg),
 u AS (SELECT symbol, date, weight AS t FROM lw UNION ALL SELECT symbol, nx, -weight*g/pg FROM j JOIN pg USING (date) JOIN dd USING (date) WHERE nx IS NOT NULL), s AS (SELECT symbol, date, sum(t) AS t FROM u GROUP BY ALL), tr AS (SELECT date, count(*) AS trades, sum(abs(t)) AS tv FROM s WHERE abs(t)>1e-6 GROUP BY date),
 c AS (SELECT pg.date, trades, tv, coalesce(tv,0)*16.0::DOUBLE/1e4 AS cost, pg FROM pg LEFT JOIN tr USING (date)) SELECT date, trades, R(tv) AS turnover, R(cost) AS cost, R(pg) AS gross_growth, R(CASE WHEN min(least(pg,1-cost)) OVER (ORDER BY date)>0 THEN sum(CASE WHEN pg>0 AND cost<1 THEN ln(pg)+ln(1-cost) END) OVER (ORDER BY date) END) AS log_wealth, min(least(pg,1-cost)) OVER (ORDER BY date)<=0 AS ruined FROM c""")
def bt_trades_costs(sp, sf):
    m = d.bars(sp, sf).groupBy("symbol", F.date_trunc("month", "date").alias("month")).agg(F.max_by("close", "date").alias("close"))
    g = m.select("symbol", F.last_day("month").cast("timestamp").alias("date"), div(F.lead("close").over(ordered("symbol", "month")), "close").alias("growth"))
    return bt.trades_costs(d.weights(sp, sf), g)


@query("bt_benchmark", "SELECT date, R(avg(ret)) AS ret, count(*) AS assets FROM rets WHERE ret IS NOT NULL GROUP BY date")
def bt_benchmark(sp, sf):
    return bt.benchmark(d.rets(sp, sf))


@query("bt_bootstrap_ci", """WITH s AS (SELECT series, ret AS r, row_number() OVER (PARTITION BY series ORDER BY date)-1 AS pos FROM idx WHERE ret IS NOT NULL), n AS (SELECT series, count(*) AS n FROM s GROUP BY series),
 dr AS (SELECT series, n, sim, unnest(range(n)) AS i FROM n, (SELECT unnest(range(1,101)) AS sim)), dp AS (SELECT series, sim, i, ('0x'||substr(md5('42-'||sim||'-'||i),1,8))::BIGINT % n AS pos FROM dr),
 x AS (SELECT dp.series, sim, i, r, sum(ln(1+r)) OVER (PARTITION BY dp.series, sim ORDER BY i ROWS UNBOUNDED PRECEDING) AS l FROM dp JOIN s ON s.series=dp.series AND s.pos=dp.pos), y AS (SELECT *, exp(l-max(l) OVER (PARTITION BY series, sim ORDER BY i ROWS UNBOUNDED PRECEDING))-1 AS dd FROM x),
 m AS (SELECT series, sim, exp(sum(ln(1+r))*252.0::DOUBLE/count(*))-1 AS ar, stddev_samp(r)*sqrt(252.0::DOUBLE) AS v, min(dd) AS dd FROM y GROUP BY ALL), k AS (SELECT series, unnest(['annual_return','volatility','max_drawdown','sharpe']) AS metric, unnest([ar,v,dd,ar/nullif(v,0)]) AS value FROM m)
 SELECT series, metric, R(avg(value)) AS mean, R(quantile_cont(value,0.05)) AS q05, R(quantile_cont(value,0.95)) AS q95 FROM k GROUP BY ALL""", 3)
def bt_bootstrap_ci(sp, sf):
    return bt.bootstrap_ci(d.index(sp, sf), 100)


_IC = """c0 AS (SELECT symbol, date, ret, volume, CASE WHEN count(volume) OVER w=20 THEN avg(volume) OVER w END AS m FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)),
 c1 AS (SELECT *, volume/m AS ratio, abs(ret) AS ab, quantile_cont(abs(ret),0.95) OVER (PARTITION BY symbol) AS q, count(*) OVER (PARTITION BY symbol) AS n FROM c0 WHERE ret IS NOT NULL)"""
_ICS = _IC + """, ci AS (SELECT symbol, max(n) AS rows, count(*) FILTER (ratio>0 AND ab<q) AS used, regr_intercept(CASE WHEN ratio>0 AND ab<q THEN ln(ab+1e-6) END, CASE WHEN ratio>0 AND ab<q THEN ln(ratio) END) AS i FROM c1 GROUP BY symbol), co AS (SELECT symbol, rows, used, CASE WHEN rows>100 AND used>50 THEN coalesce(exp(i),0.1) ELSE 0.1 END AS coefficient FROM ci)"""


@query("ex_impact_calibrate", f"WITH {_ICS} SELECT symbol, rows, used, R(coefficient) AS coefficient FROM co")
def ex_impact_calibrate(sp, sf):
    return ex.impact_calibrate(d.rets(sp, sf))


@query("ex_impact_calibrate_regime", f"""WITH {_IC}, k AS (SELECT symbol, rg, p, ln(ratio) AS x, ln(ab+1e-6) AS y FROM c1 JOIN (SELECT date, unnest([0,1,2])::INT AS rg, unnest([p0,p1,p2])::DOUBLE AS p FROM mreg) USING (date) WHERE ratio>0 AND ab<q AND n>50 AND p>0.1),
 g AS (SELECT symbol, rg, count(*) AS used, sum(p) AS sw, sum(p*x) AS sx, sum(p*y) AS sy, sum(p*x*x) AS sxx, sum(p*x*y) AS sxy FROM k GROUP BY ALL)
 SELECT symbol, rg AS regime, used, R(CASE WHEN used>20 THEN exp((sy-(sw*sxy-sx*sy)/(sw*sxx-sx*sx)*sx)/sw) ELSE 0.1 END) AS coefficient FROM g""")
def ex_impact_calibrate_regime(sp, sf):
    m = d.market_regimes(sp, sf).select("date", "probs")
    return ex.impact_calibrate_regime(d.rets(sp, sf).join(m, "date"))


_ADV = "av AS (SELECT symbol, avg(volume) AS adv FROM (SELECT symbol, volume, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS r FROM bars) WHERE r<=20 GROUP BY symbol)"


@query("ex_impact_apply", f"WITH {_ICS}, {_ADV} SELECT order_id, pord.symbol, R(quantity) AS quantity, R(coalesce(least(coefficient*sqrt(quantity/coalesce(nullif(adv,0),1e6)),0.05),0.001)) AS impact FROM pord LEFT JOIN av USING (symbol) LEFT JOIN co USING (symbol)")
def ex_impact_apply(sp, sf):
    b = d.rets(sp, sf)
    return ex.impact_apply(d.parent_orders(sp, sf), ex.adv(b), ex.impact_calibrate(b)).select("order_id", "symbol", "quantity", "impact")


@query("ex_slice_schedule", f"""WITH {_ADV}, o AS (SELECT order_id, symbol, order_time+INTERVAL 9 HOUR AS ot, quantity, (order_id%3)::INT AS rg FROM pord), k AS (SELECT *, 4.0::DOUBLE*CASE rg WHEN 0 THEN 0.8::DOUBLE WHEN 1 THEN 1.5::DOUBLE ELSE 1 END AS dh, floor(20*CASE rg WHEN 0 THEN 1.2::DOUBLE WHEN 1 THEN 0.8::DOUBLE ELSE 1 END)::INT AS ns FROM o LEFT JOIN av USING (symbol)),
 s AS (SELECT *, unnest(range(ns))::INT AS i FROM k), t AS (SELECT *, ot+to_microseconds(round(dh/ns*3600*i*1e6)::BIGINT) AS st FROM s), h AS (SELECT *, CASE WHEN hour(st) IN (9,10,15,16) THEN 1.5::DOUBLE WHEN hour(st) BETWEEN 11 AND 14 THEN 0.7::DOUBLE ELSE 1 END AS w FROM t)
 SELECT order_id, symbol, slice_id, scheduled_time, R(greatest(least(want, quantity-coalesce(done,0)),0)) AS slice_quantity, R(greatest(quantity-total,0)) AS unfilled, R(w) AS weight, R(cap) AS max_participation FROM (SELECT *, sum(want) OVER (PARTITION BY order_id, symbol ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done, sum(want) OVER (PARTITION BY order_id, symbol) AS total FROM (SELECT order_id, symbol, i, i+1 AS slice_id, st AS scheduled_time, quantity, w, adv/6.5*0.2 AS cap, least(quantity/ns*w, adv/6.5*0.2) AS want FROM h))""")
def ex_slice_schedule(sp, sf):
    o = d.parent_orders(sp, sf).withColumns({"order_time": F.col("order_time") + F.expr("INTERVAL 9 HOURS"), "regime": (F.col("order_id") % 3).cast("int")})
    return ex.slice_schedule(o, ex.adv(d.bars(sp, sf)))
