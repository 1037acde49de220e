"""Queries for regime operators on the five sector indices."""
from __future__ import annotations

import numpy as _np
from pyspark.sql import functions as F

from tidepanel.functions.moments import argmax
from tidepanel.operators import regimes as r, regimes_ml as rm
from tidepanel.plans.mixture_sql import CRITERIA, SMOOTHED
from tidepanel.plans.registry import query
from tidepanel.sources import domain as d

KT = ["series", "date"]


def probs(df, *keep):
    return df.select(*keep, *[F.col("probs")[i].alias(f"p{i}") for i in range(3)])


@query("reg_prepare", """WITH a AS (SELECT series, date, ret, volume, close FROM idx WHERE ret IS NOT NULL AND volume IS NOT NULL AND close IS NOT NULL)
 SELECT series, date, R(ret) AS ret, R((volume-avg(volume) OVER w)/nullif(stddev_pop(volume) OVER w,0)) AS volume,
 R((close-avg(close) OVER w)/nullif(stddev_pop(close) OVER w,0)) AS close FROM a WINDOW w AS (PARTITION BY series)""")
def reg_prepare(sp, sf):
    return r.prepare(d.index(sp, sf).select("series", "date", "ret", "volume", "close"), ["volume", "close"], "ret")


@query("reg_threshold", "SELECT series, date, R(vol) AS vol, R(p0) AS p0, R(p1) AS p1, R(p2) AS p2, regime FROM reg")
def reg_threshold(sp, sf):
    return probs(d.regimes(sp, sf), "series", "date", "vol", "regime")


def _mixture_rows(sp, sf):
    return r.prepare(d.regimes(sp, sf).select("series", "date", "ret", "vol", F.col("ret").alias("target")), ["ret", "vol"], "target")


@query("reg_gmm", f"WITH RECURSIVE {SMOOTHED} SELECT series, date, CASE WHEN p0>=p1 AND p0>=p2 THEN 0 WHEN p1>=p2 THEN 1 ELSE 2 END AS regime, R(p0) AS p0, R(p1) AS p1, R(p2) AS p2 FROM gmm")
def reg_gmm(sp, sf):
    return probs(rm.gmm(_mixture_rows(sp, sf), ["ret", "vol"]), "series", "date", "regime")


_TV = "WITH l AS (SELECT series, date, ret AS y, vol, lag(ret,1) OVER s AS x1, lag(ret,2) OVER s AS x2 FROM reg WINDOW s AS (PARTITION BY series ORDER BY date))," \
      " k AS (SELECT * FROM l WHERE y IS NOT NULL AND vol IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL)," \
      " g AS (SELECT series, unnest(range(20))::INT AS point, unnest(quantile_cont(vol, [" + ",".join(repr(float(v) / 100) + "::DOUBLE" for v in _np.linspace(10, 90, 20)) + "])) AS thr FROM k GROUP BY series)," \
      """ m AS (SELECT series, point, thr, vol>thr AS high, count(*) AS n, var_pop(y) AS yy, var_pop(x1) AS aa, var_pop(x2) AS bb, covar_pop(x1,x2) AS ab,
 covar_pop(y,x1) AS ya, covar_pop(y,x2) AS yb FROM k JOIN g USING (series) GROUP BY ALL HAVING count(*)>12),
 a AS (SELECT *, ln(yy-(ya*ya*bb-2*ya*yb*ab+yb*yb*aa)/(aa*bb-ab*ab))+6.0::DOUBLE/n AS aic FROM m),
 t AS (SELECT series, point, thr, avg(aic) AS aic, sum(CASE WHEN NOT high THEN n END)::BIGINT AS n_low, sum(CASE WHEN high THEN n END)::BIGINT AS n_high FROM a GROUP BY ALL)
 SELECT series, R(arg_min(thr,aic)) AS threshold, R(min(aic)) AS aic, arg_min(n_low,aic) AS n_low, arg_min(n_high,aic) AS n_high FROM t GROUP BY series"""


@query("reg_tvar_grid", _TV)
def reg_tvar_grid(sp, sf):
    return rm.tvar_best(rm.tvar_grid(d.regimes(sp, sf)))


_KS = "(CASE WHEN stat<=0.04 THEN 1 ELSE greatest(0,least(1,2*list_sum(list_transform(range(1,101), lambda k: CASE WHEN k%2=1 THEN 1 ELSE -1 END*exp(-2.0::DOUBLE*k*k*stat*stat))))) END)"


_BREAKS = f"""b AS MATERIALIZED (SELECT series, date, vol AS close, row_number() OVER (PARTITION BY series ORDER BY date)-1 AS i, count(*) OVER (PARTITION BY series) AS n, greatest(50, count(*) OVER (PARTITION BY series)//10) AS h FROM reg WHERE vol IS NOT NULL),
 w AS (SELECT a.series, a.i AS c, x.close AS y, (x.i-a.i)::DOUBLE AS t FROM b a JOIN b x ON a.series=x.series AND x.i BETWEEN a.i-a.h AND a.i+a.h-1 WHERE a.i>=a.h AND a.i<a.n-a.h),
 f AS (SELECT series, c, regr_slope(y,t) AS s, regr_intercept(y,t) AS k0 FROM w GROUP BY ALL),
 q AS (SELECT w.series, w.c, t, y-k0-s*t AS e FROM w JOIN f USING (series, c)),
 p AS (SELECT series, c, abs(sum(e) OVER (PARTITION BY series, c ORDER BY t ROWS UNBOUNDED PRECEDING)) AS cs, e FROM q),
 z AS (SELECT series, c, max(cs)/sqrt(sum(e*e)) AS stat FROM p GROUP BY ALL),
 sg AS MATERIALIZED (SELECT series, c, stat FROM z WHERE {_KS}<0.05),
 g AS (SELECT series, min(c) AS c FROM sg GROUP BY series UNION ALL SELECT g.series, (SELECT min(s2.c) FROM sg s2 WHERE s2.series=g.series AND s2.c>g.c+20) FROM g WHERE g.c IS NOT NULL)"""


def _breaks(sp, sf):
    return rm.spaced_breaks(rm.break_windows(d.regimes(sp, sf), "vol"))


@query("reg_breaks_window", f"""WITH RECURSIVE {_BREAKS}
 SELECT g.series, g.c AS position, b.date, R(sg.stat) AS statistic FROM g JOIN b ON g.series=b.series AND g.c=b.i JOIN sg ON sg.series=g.series AND sg.c=g.c""")
def reg_breaks_window(sp, sf):
    return _breaks(sp, sf)


@query("reg_break_states", f"""WITH RECURSIVE {_BREAKS},
 fl AS (SELECT b.series, b.date, (g.c IS NOT NULL)::INT AS k FROM b LEFT JOIN g ON g.series=b.series AND g.c=b.i),
 sm AS (SELECT series, date, least(2, sum(k) OVER (PARTITION BY series ORDER BY date ROWS UNBOUNDED PRECEDING)) AS s FROM fl),
 pr AS (SELECT series, date, s, avg((s=0)::INT) OVER c AS p0, avg((s=1)::INT) OVER c AS p1, avg((s=2)::INT) OVER c AS p2 FROM sm WINDOW c AS (PARTITION BY series ORDER BY date ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
 SELECT series, date, s::INT AS break_regime, CASE WHEN p0>=p1 AND p0>=p2 THEN 0 WHEN p1>=p2 THEN 1 ELSE 2 END AS regime, R(p0) AS p0, R(p1) AS p1, R(p2) AS p2 FROM pr""")
def reg_break_states(sp, sf):
    rows = d.regimes(sp, sf).where("vol is not null").select("series", "date", "vol")
    s = rm.break_states(rows, rm.spaced_breaks(rm.break_windows(rows, "vol")))
    out = r.smooth_centered(s.withColumn("probs", r.one_hot(F.col("regime"), 3)).withColumnRenamed("regime", "break_regime"))
    return probs(out.withColumn("regime", argmax(F.col("probs"))), "series", "date", "break_regime", "regime")


@query("reg_information_criteria", f"""WITH RECURSIVE {CRITERIA}, {_BREAKS},
 fr AS (SELECT series, unnest([0,1,2]) AS component, unnest([avg((regime=0)::INT), avg((regime=1)::INT), avg((regime=2)::INT)]) AS threshold_frequency FROM reg GROUP BY series),
 bk AS (SELECT series, list(c ORDER BY c) AS c FROM g WHERE c IS NOT NULL GROUP BY series),
 ln AS (SELECT series, coalesce(len(c), 0)::INT AS n_breaks, array_to_string(list_transform(range(1, coalesce(len(c), 0)+2), lambda i: coalesce(c[i], n)-CASE WHEN i=1 THEN 0 ELSE c[i-1] END), ',') AS regime_lengths
   FROM (SELECT series, count(*) AS n FROM b GROUP BY series) LEFT JOIN bk USING (series))
 SELECT series, component, R(weight) AS weight, R(mean_0) AS mean_0, R(mean_1) AS mean_1, R(cov_00) AS cov_00, R(cov_10) AS cov_10, R(cov_11) AS cov_11, n_params, n_rows, R(log_likelihood) AS log_likelihood, R(aic) AS aic, R(bic) AS bic, converged,
 R(threshold_frequency) AS threshold_frequency, n_breaks, regime_lengths FROM gmm_crit JOIN fr USING (series, component) JOIN ln USING (series)""")
def reg_information_criteria(sp, sf):
    states = d.regimes(sp, sf)
    shares = r.threshold_stats(states).select("series", F.posexplode(F.array("freq_0", "freq_1", "freq_2")).alias("component", "threshold_frequency"))
    rows = states.where("vol is not null")
    lengths = rm.break_statistics(rm.spaced_breaks(rm.break_windows(rows, "vol")), rows).withColumn("regime_lengths", F.array_join(F.col("regime_lengths").cast("array<string>"), ","))
    fit = rm.gmm_criteria(_mixture_rows(sp, sf), ["ret", "vol"])
    fit = fit.select("*", *[F.col("mean")[i].alias(f"mean_{i}") for i in range(2)], *[F.col("cov")[i].alias(f"cov_{n}") for i, n in enumerate(("00", "10", "11"))]).drop("mean", "cov")
    return fit.join(shares, ["series", "component"]).join(lengths, "series")


_CU = """WITH l AS (SELECT series, date, close, lag(close) OVER (PARTITION BY series ORDER BY date) AS x FROM idx),
 f AS (SELECT series, regr_slope(close,x) AS b, regr_intercept(close,x) AS a FROM l WHERE x IS NOT NULL GROUP BY series),
 e AS (SELECT l.series, date, close-a-b*x AS e FROM l JOIN f USING (series) WHERE x IS NOT NULL),
 c AS (SELECT series, date, sum(e) OVER (PARTITION BY series ORDER BY date ROWS UNBOUNDED PRECEDING)/sqrt(sum(e*e) OVER (PARTITION BY series)) AS cusum FROM e)"""


@query("reg_cusum", _CU + f""", s AS (SELECT series, max(abs(cusum)) AS stat, count(*) FILTER (abs(cusum)>0.5) AS candidates FROM c GROUP BY series)
 SELECT series, R(stat) AS statistic, candidates, R({_KS}) AS p_value, candidates>0 AND {_KS}<0.05 AS significant FROM s""")
def reg_cusum(sp, sf):
    return r.cusum_summary(r.cusum(d.index(sp, sf)))


@query("reg_cusum_path", _CU + " SELECT series, date, R(cusum) AS cusum, abs(cusum)>0.5 AS candidate FROM c")
def reg_cusum_path(sp, sf):
    return r.cusum(d.index(sp, sf)).select("series", "date", "cusum", "candidate")


def _rss(n, y2, y, ty, t, tt):
    return f"(({y2})-({y})*({y})/({n})-power(({ty})-({t})*({y})/({n}),2)/(({tt})-({t})*({t})/({n})))"


_CH = """WITH a AS (SELECT series, date, close-avg(close) OVER (PARTITION BY series) AS y, count(*) OVER (PARTITION BY series)::DOUBLE AS n,
  (row_number() OVER (PARTITION BY series ORDER BY date)-1)::BIGINT AS m FROM idx), b AS (SELECT *, m-(n-1)/2 AS t FROM a),
 c AS (SELECT *, sum(y*y) OVER p AS ay2, sum(y) OVER p AS ay, sum(t*y) OVER p AS aty, sum(t) OVER p AS a_t, sum(t*t) OVER p AS att,
  sum(y*y) OVER w AS zy2, sum(y) OVER w AS zy, sum(t*y) OVER w AS zty, sum(t) OVER w AS zt, sum(t*t) OVER w AS ztt FROM b
  WINDOW p AS (PARTITION BY series ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), w AS (PARTITION BY series)),
 d AS (SELECT *, """ + _rss("n", "zy2", "zy", "zty", "zt", "ztt") + " AS rf, " + _rss("m", "ay2", "ay", "aty", "a_t", "att") + "+" + \
      _rss("n-m", "zy2-ay2", "zy-ay", "zty-aty", "zt-a_t", "ztt-att") + """ AS ru FROM c WHERE m>=floor(0.2*n) AND m<floor(0.8*n) AND m>5 AND n-m>5),
 e AS (SELECT series, date, m, n, ((rf-ru)/2)/(ru/(n-4)) AS f FROM d)"""


@query("reg_chow", _CH + " SELECT series, date, m AS split, R(f) AS f_stat, R(power(1+2*greatest(f,0)/(n-4),-(n-4)/2)) AS p_value FROM e")
def reg_chow(sp, sf):
    df = r.chow(d.index(sp, sf))
    return df.withColumn("split", F.col("split").cast("long"))


@query("reg_recursive_resid", """WITH a AS (SELECT series, date, close, (row_number() OVER (PARTITION BY series ORDER BY date)-1)::DOUBLE AS t FROM idx),
 b AS (SELECT series, date, t, close-regr_intercept(close,t) OVER p-regr_slope(close,t) OVER p*t AS e FROM a WINDOW p AS (PARTITION BY series ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 c AS (SELECT *, e/nullif(stddev_pop(e) OVER (PARTITION BY series),0) AS z FROM b WHERE t>=20)
 SELECT series, date, R(e) AS residual, R(z) AS standardised, abs(z)>2 AS candidate FROM c""", 4)
def reg_recursive_resid(sp, sf):
    return r.recursive_residuals(d.index(sp, sf)).select("series", "date", "residual", "standardised", "candidate")


@query("reg_smooth_centered", """WITH a AS (SELECT series, date, avg((regime=0)::INT) OVER c AS s0, avg((regime=1)::INT) OVER c AS s1, avg((regime=2)::INT) OVER c AS s2 FROM reg
 WINDOW c AS (PARTITION BY series ORDER BY date ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) SELECT series, date, R(s0/(s0+s1+s2)) AS p0, R(s1/(s0+s1+s2)) AS p1, R(s2/(s0+s1+s2)) AS p2 FROM a""")
def reg_smooth_centered(sp, sf):
    df = d.regimes(sp, sf).withColumn("probs", r.one_hot(F.col("regime"), 3))
    return probs(r.smooth_centered(df), "series", "date")


@query("reg_smooth_ewm", """WITH RECURSIVE bn AS MATERIALIZED (SELECT series, date, p0, p1, p2, row_number() OVER (PARTITION BY series ORDER BY date) AS rn FROM reg),
 e AS (SELECT series, date, rn, p0::DOUBLE AS a, p1::DOUBLE AS b, p2::DOUBLE AS c FROM bn WHERE rn=1 UNION ALL
 SELECT n.series, n.date, n.rn, e.a*0.9::DOUBLE+n.p0, e.b*0.9::DOUBLE+n.p1, e.c*0.9::DOUBLE+n.p2 FROM e JOIN bn n ON n.series=e.series AND n.rn=e.rn+1)
 SELECT series, date, R(a/(a+b+c)) AS p0, R(b/(a+b+c)) AS p1, R(c/(a+b+c)) AS p2 FROM e""")
def reg_smooth_ewm(sp, sf):
    return probs(r.smooth_ewm(d.regimes(sp, sf)), "series", "date")


def _methods(sp, sf):
    """Volatility and volume threshold labels as two methods."""
    base = d.index(sp, sf)
    a = r.threshold(base).select("series", "date", F.lit("returns").alias("method"), "probs")
    b = r.threshold(base, "volume").select("series", "date", F.lit("volume").alias("method"), "probs")
    return a.unionByName(b)


_ENS = """WITH v0 AS (SELECT series, date, CASE WHEN count(volume) OVER w=20 THEN stddev_samp(volume) OVER w END AS vol FROM idx WINDOW w AS (PARTITION BY series ORDER BY date ROWS 19 PRECEDING)),
 v1 AS (SELECT v0.*, CASE WHEN vol>q2 THEN 2 WHEN vol>q1 THEN 1 ELSE 0 END AS st FROM v0 JOIN (SELECT series, quantile_cont(vol,1.0::DOUBLE/3) AS q1, quantile_cont(vol,2.0::DOUBLE/3) AS q2 FROM v0 GROUP BY series) USING (series)),
 v2 AS (SELECT series, date, avg((st=0)::INT) OVER c AS v0p, avg((st=1)::INT) OVER c AS v1p, avg((st=2)::INT) OVER c AS v2p FROM v1 WINDOW c AS (PARTITION BY series, vol IS NOT NULL ORDER BY date ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
 lb AS (SELECT series, date, 'returns' AS method, regime FROM reg UNION ALL SELECT series, date, 'volume', CASE WHEN v0p>=v1p AND v0p>=v2p THEN 0 WHEN v1p>=v2p THEN 1 ELSE 2 END FROM v2),
 gr AS (SELECT series, method, regime, count(*) AS n, greatest(var_pop(ret),1e-12::DOUBLE) AS v FROM lb JOIN idx USING (series, date) WHERE ret IS NOT NULL GROUP BY ALL),
 sc AS (SELECT series, method, sum(n*(ln(2*pi()*v)+1))+8*ln(sum(n)) AS bic FROM gr GROUP BY ALL),
 kw AS (SELECT series, method, exp(-(bic-min(bic) OVER (PARTITION BY series))/1000) AS w FROM sc),
 k AS (SELECT series, sum(w) FILTER (method='returns')/sum(w) AS wa, sum(w) FILTER (method='volume')/sum(w) AS wb FROM kw GROUP BY series),
 e AS (SELECT series, date, p0*wa+v0p*wb AS p0, p1*wa+v1p*wb AS p1, p2*wa+v2p*wb AS p2 FROM reg JOIN v2 USING (series, date) JOIN k USING (series))"""


def _ensemble(sp, sf):
    m = _methods(sp, sf)
    return r.ensemble(m, r.regime_scores(m, d.index(sp, sf).select("series", "date", "ret")))


@query("reg_ensemble", _ENS + " SELECT series, date, R(p0) AS p0, R(p1) AS p1, R(p2) AS p2 FROM e")
def reg_ensemble(sp, sf):
    return probs(_ensemble(sp, sf), "series", "date")


@query("reg_ensemble_stats", _ENS + """ SELECT series, R(avg(-(p0*ln(p0+1e-8)+p1*ln(p1+1e-8)+p2*ln(p2+1e-8)))) AS mean_entropy, R(avg(1-greatest(p0,p1,p2))) AS mean_uncertainty FROM e GROUP BY series""")
def reg_ensemble_stats(sp, sf):
    return r.ensemble_stats(_ensemble(sp, sf))


_TR = """WITH t0 AS (SELECT series, regime AS f, lead(regime) OVER (PARTITION BY series ORDER BY date) AS t FROM reg),
 tr AS (SELECT series, f, t, count(*) AS n, count(*)::DOUBLE/sum(count(*)) OVER (PARTITION BY series, f) AS prob FROM t0 WHERE t IS NOT NULL GROUP BY series, f, t)"""


@query("reg_transitions", _TR + " SELECT series, f AS from_regime, t AS to_regime, n, R(prob) AS prob FROM tr")
def reg_transitions(sp, sf):
    return r.transitions(d.regimes(sp, sf))


@query("reg_transition_returns", """WITH a AS (SELECT series, ret, regime, lead(regime) OVER (PARTITION BY series ORDER BY date) AS nx FROM reg)
 SELECT series, count(*) AS switches, R(avg(ret)) AS mean_ret, R(stddev_pop(ret)) AS std_ret, R(avg((coalesce(abs(ret)>0.02,false))::INT)) AS share_large FROM a WHERE nx<>regime GROUP BY series""")
def reg_transition_returns(sp, sf):
    return r.transition_returns(d.regimes(sp, sf))


_EP = """WITH a AS (SELECT series, date, regime, CASE WHEN lag(regime) OVER s IS NULL OR lag(regime) OVER s<>regime THEN 1 ELSE 0 END AS st FROM reg WINDOW s AS (PARTITION BY series ORDER BY date)),
 b AS (SELECT *, sum(st) OVER (PARTITION BY series ORDER BY date ROWS UNBOUNDED PRECEDING) AS ep FROM a), e AS (SELECT series, ep, regime, count(*) AS len FROM b GROUP BY ALL)"""


@query("reg_durations", _EP + """ SELECT series, regime, count(*) AS episodes, R(avg(len)) AS mean, R(quantile_cont(len,0.5)) AS median, min(len) AS shortest, max(len) AS longest FROM e GROUP BY series, regime""")
def reg_durations(sp, sf):
    return r.durations(d.regimes(sp, sf))


@query("reg_persistence", """WITH a AS (SELECT series, regime, (coalesce(lag(regime) OVER (PARTITION BY series ORDER BY date)=regime,false))::INT AS same FROM reg)
 SELECT series, regime, count(*) AS rows, R(sum(same)/nullif(count(*)-1.0,0)) AS persistence FROM a GROUP BY series, regime""")
def reg_persistence(sp, sf):
    return r.persistence(d.regimes(sp, sf))


_CUR = """, cur AS (SELECT series, arg_max([p0,p1,p2],date) AS p FROM reg GROUP BY series),
 m AS (SELECT series, """ + ", ".join(f"coalesce(sum(prob) FILTER (f={i} AND t={j}), 0) AS a{i}{j}" for i in range(3) for j in range(3)) + " FROM tr GROUP BY series)"


def _mul(ps):
    return ", ".join(f"{ps[0]}*a0{j}+{ps[1]}*a1{j}+{ps[2]}*a2{j} AS x{j}" for j in range(3))


@query("reg_forecast", _TR.replace("WITH ", "WITH RECURSIVE ", 1) + _CUR + f""", f AS (SELECT series, 0 AS h, p[1] AS x0, p[2] AS x1, p[3] AS x2 FROM cur UNION ALL
 SELECT f.series, h+1, {_mul(['x0', 'x1', 'x2'])} FROM f JOIN m ON f.series=m.series WHERE h<5)
 SELECT series, h AS horizon, R(x0) AS p0, R(x1) AS p1, R(x2) AS p2 FROM f WHERE h>0""")
def reg_forecast(sp, sf):
    df = d.regimes(sp, sf)
    return probs(r.forecast(r.current(df), r.transitions(df)), "series", "horizon")


@query("reg_steady_state", _TR.replace("WITH ", "WITH RECURSIVE ", 1) + _CUR + f""", f AS (SELECT series, 0 AS h, 1.0::DOUBLE/3 AS x0, 1.0::DOUBLE/3 AS x1, 1.0::DOUBLE/3 AS x2 FROM cur UNION ALL
 SELECT f.series, h+1, {_mul(['x0', 'x1', 'x2'])} FROM f JOIN m ON f.series=m.series WHERE h<1024)
 SELECT series, R(x0) AS p0, R(x1) AS p1, R(x2) AS p2 FROM f WHERE h=1024""")
def reg_steady_state(sp, sf):
    return probs(r.steady_state(r.transitions(d.regimes(sp, sf))), "series")


@query("reg_current", """SELECT series, max(date) AS date, arg_max(regime,date) AS regime, R(arg_max(greatest(p0,p1,p2),date)) AS probability, arg_max(greatest(p0,p1,p2),date)>=0.7 AS confident FROM reg GROUP BY series""")
def reg_current(sp, sf):
    return r.current(d.regimes(sp, sf)).drop("probs")


@query("reg_triggers", """WITH a AS (SELECT series, date, regime, lag(regime) OVER s AS f, avg(ret) OVER w AS m, stddev_samp(ret) OVER w AS sd, row_number() OVER s AS pos FROM reg
 WINDOW s AS (PARTITION BY series ORDER BY date), w AS (PARTITION BY series ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
 SELECT series, f AS from_regime, regime AS to_regime, count(*) AS n, R(avg(m)) AS mean_before, R(avg(sd)) AS vol_before, R(quantile_cont(sd,0.95)) AS vol_95, R(quantile_cont(m,0.95)) AS mean_95,
 min(date) AS first_switch, max(date) AS last_switch FROM a WHERE f<>regime AND pos>20 GROUP BY series, f, regime""")
def reg_triggers(sp, sf):
    return r.triggers(d.regimes(sp, sf))


@query("reg_stability", """WITH l AS (SELECT series, date, 0 AS regime, p0 AS p FROM reg UNION ALL SELECT series, date, 1, p1 FROM reg UNION ALL SELECT series, date, 2, p2 FROM reg),
 a AS (SELECT *, lag(p) OVER (PARTITION BY series, regime ORDER BY date) AS q FROM l),
 g AS (SELECT series, regime, avg(p) AS m, stddev_pop(p) AS s, avg((p>0.5)::INT) AS sh, corr(p,q) AS c FROM a GROUP BY ALL)
 SELECT series, regime, R(m) AS mean_p, R(s) AS std_p, R(sh) AS persistence, R(coalesce(c,0)) AS autocorrelation, R(m*coalesce(c,0)/(s+1e-8)) AS score FROM g""")
def reg_stability(sp, sf):
    return r.stability(d.regimes(sp, sf))


@query("reg_switching", """WITH a AS (SELECT series, (coalesce(lag(regime) OVER (PARTITION BY series ORDER BY date)<>regime,false))::INT AS s, greatest(p0,p1,p2)>0.7 AS st FROM reg)
 SELECT series, sum(s)::BIGINT AS switches, count(*) AS rows, R(avg(st::INT)) AS stable_share, R(sum(s)/count(*)) AS frequency, R(count(*)/(sum(s)+1.0)) AS mean_duration FROM a GROUP BY series""")
def reg_switching(sp, sf):
    return r.switching(d.regimes(sp, sf))


_LB = "+".join(f"power(c{k}/c0,2)/(n-{k})" for k in range(1, 11))


@query("reg_arch_test", "WITH a AS (SELECT series, date, ret*ret-avg(ret*ret) OVER (PARTITION BY series) AS e FROM idx WHERE ret IS NOT NULL), b AS (SELECT series, e, "
       + ", ".join(f"lag(e,{k}) OVER s AS l{k}" for k in range(1, 11)) + " FROM a WINDOW s AS (PARTITION BY series ORDER BY date)), c AS (SELECT series, count(*) AS n, corr(e,l1) AS r, sum(e*e) AS c0, "
       + ", ".join(f"sum(e*l{k}) AS c{k}" for k in range(1, 11)) + f" FROM b GROUP BY series), q AS (SELECT series, n, r, n*(n+2)*({_LB}) AS x FROM c)"
       + " SELECT series, n, R(r) AS corr, R(x) AS ljung_box, R(exp(-x/2)*(1+x/2+power(x/2,2)/2+power(x/2,3)/6+power(x/2,4)/24)) AS p_value FROM q")
def reg_arch_test(sp, sf):
    return r.arch_test(d.index(sp, sf))
