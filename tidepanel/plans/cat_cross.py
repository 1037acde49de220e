"""Queries for cross-sectional, macro and fundamental window features."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.core.frames import change, roll
from tidepanel.operators import cross_section as cs, fundamentals as fu, macro as ma, technical as t
from tidepanel.plans.cat_windows import W, rl
from tidepanel.plans.registry import query
from tidepanel.sources import domain as d

_M = f"m AS (SELECT symbol, date, close/lag(close,20) OVER s-1 AS mom FROM bars {W()})"


def _mom(sp, sf):
    return d.bars(sp, sf).withColumn("mom", change("close", 20)).select("symbol", "date", "mom")


@query("w_relative_strength", f"""WITH u AS (SELECT date, avg(ret) AS u FROM rets GROUP BY date),
 v AS (SELECT date, {', '.join(f"CASE WHEN count(u) OVER u{n}={n} THEN avg(u) OVER u{n} END AS u{n}" for n in (10, 20, 50))} FROM u
  WINDOW {', '.join(f"u{n} AS (ORDER BY date ROWS {n - 1} PRECEDING)" for n in (10, 20, 50))}),
 a AS (SELECT symbol, date, {', '.join(f"{rl(n, 'ret')} AS a{n}" for n in (10, 20, 50))} FROM rets {W(10, 20, 50)})
 SELECT symbol, date, {', '.join(f"R(a{n}-u{n}) AS relative_strength_{n}" for n in (10, 20, 50))} FROM a JOIN v USING (date)""")
def w_relative_strength(sp, sf):
    return cs.relative_strength(d.rets(sp, sf)).select("symbol", "date", *[f"relative_strength_{n}" for n in (10, 20, 50)])


@query("w_cs_rank", f"""WITH {_M} SELECT symbol, date, R(CASE WHEN mom IS NOT NULL THEN
 rank() OVER (PARTITION BY date ORDER BY mom NULLS LAST)::DOUBLE/count(mom) OVER (PARTITION BY date) END) AS mom_cs_rank FROM m""")
def w_cs_rank(sp, sf):
    return cs.cs_rank(_mom(sp, sf), "mom").select("symbol", "date", "mom_cs_rank")


@query("w_cs_zscore", f"""WITH {_M} SELECT symbol, date, R(CASE WHEN stddev_samp(mom) OVER (PARTITION BY date)>0 THEN
 (mom-avg(mom) OVER (PARTITION BY date))/stddev_samp(mom) OVER (PARTITION BY date) ELSE 0 END) AS mom_cs_zscore FROM m""")
def w_cs_zscore(sp, sf):
    return cs.cs_zscore(_mom(sp, sf), "mom").select("symbol", "date", "mom_cs_zscore")


@query("w_sector_rank", f"""WITH {_M}, j AS (SELECT m.*, sector FROM m JOIN sectors USING (symbol)) SELECT symbol, date, sector,
 R(CASE WHEN mom IS NOT NULL THEN (rank() OVER (PARTITION BY sector, date ORDER BY mom NULLS LAST)+(count(*) OVER (PARTITION BY sector, date, mom)-1)/2.0)
 /count(mom) OVER (PARTITION BY sector, date) END) AS mom_sector_rank FROM j""")
def w_sector_rank(sp, sf):
    df = _mom(sp, sf).join(d.sectors(sp, sf).select("symbol", "sector"), "symbol")
    return cs.sector_rank(df, "mom").select("symbol", "date", "sector", "mom_sector_rank")


@query("w_macro_derived", f"""WITH a AS (SELECT indicator, date, value, value/lag(value) OVER s-1 AS mom, value/lag(value,4) OVER s-1 AS qoq,
 value/lag(value,12) OVER s-1 AS yoy, value-lag(value) OVER s AS diff FROM macro {W(key='indicator')})
 SELECT indicator, date, R(value) AS value, R(mom) AS mom, R(qoq) AS qoq, R(yoy) AS yoy, R(diff) AS diff, R({rl(20, 'mom', 'stddev_samp')}) AS vol_20 FROM a {W(20, key='indicator')}""")
def w_macro_derived(sp, sf):
    return ma.derived(d.macro(sp, sf))


_MF = """SELECT *, urgent-low AS slope FROM macro_wide"""


_MF_SQL = """WITH b AS (SELECT *, last_value(high IGNORE NULLS) OVER x AS c1, last_value(medium IGNORE NULLS) OVER x AS c2 FROM macro_wide WINDOW x AS (ORDER BY date ROWS UNBOUNDED PRECEDING)),
 f AS (SELECT *, CASE WHEN count(urgent) OVER w4=4 THEN avg(urgent) OVER w4 END AS tr, (c1-avg(c1) OVER ())/nullif(stddev_samp(c1) OVER (),0) AS z1,
 (c2-avg(c2) OVER ())/nullif(stddev_samp(c2) OVER (),0) AS z2, CASE WHEN count(low) OVER w6=6 THEN avg(low) OVER w6 END AS it, CASE WHEN count(low) OVER w12=12 THEN stddev_samp(low) OVER w12 END AS iv,
 medium/nullif(lag(medium,3) OVER o,0)-1 AS m3, medium/nullif(lag(medium,6) OVER o,0)-1 AS m6
 FROM b WINDOW o AS (ORDER BY date), w4 AS (ORDER BY date ROWS 3 PRECEDING), w6 AS (ORDER BY date ROWS 5 PRECEDING), w12 AS (ORDER BY date ROWS 11 PRECEDING))
 SELECT date, R(tr) AS growth_trend, R(urgent-tr) AS growth_cycle, R(urgent-low) AS curve_slope, R(it) AS inflation_trend, R(iv) AS inflation_volatility,
 R(CASE WHEN z1 IS NOT NULL OR z2 IS NOT NULL THEN (coalesce(z1,0)+coalesce(z2,0))/((z1 IS NOT NULL)::INT+(z2 IS NOT NULL)::INT) END) AS financial_conditions_index,
 R(m3) AS medium_momentum_3, R(m6) AS medium_momentum_6 FROM f"""
_KNOWN = _MF_SQL.replace("OVER ()", "OVER x").replace("FROM b WINDOW o AS", "FROM b WINDOW x AS (ORDER BY date ROWS UNBOUNDED PRECEDING), o AS")


def _macro_features(sp, sf, full_sample: bool):
    df = ma.features(d.macro_wide(sp, sf), "urgent", "urgent", "low", "low", ["high", "medium"], ["medium"], full_sample=full_sample)
    return df.select("date", "growth_trend", "growth_cycle", "curve_slope", "inflation_trend", "inflation_volatility",
                     "financial_conditions_index", "medium_momentum_3", "medium_momentum_6")


@query("w_macro_features", _KNOWN)
def w_macro_features(sp, sf):
    """By what was known at each date."""
    return _macro_features(sp, sf, False)


@query("w_macro_features_full", _MF_SQL)
def w_macro_features_full(sp, sf):
    """By the moments of the whole history."""
    return _macro_features(sp, sf, True)


@query("w_regime_indicators", """WITH q AS (SELECT quantile_cont(high,0.75) AS q FROM macro_wide) SELECT date, coalesce(urgent-low<0,false)::INT AS recession_signal,
 coalesce(high>q,false)::INT AS high_volatility_regime FROM macro_wide, q""")
def w_regime_indicators(sp, sf):
    df = ma.spreads(d.macro_wide(sp, sf), {"slope": ("urgent", "low")})
    return ma.regime_indicators(df, "slope", "high").select("date", "recession_signal", "high_volatility_regime")


def _hr(c):
    return f"R({c}) AS fundamental_{c}, R({c}/nullif(lag({c}) OVER s,0)-1) AS fundamental_{c}_trend, " \
           f"R((rank() OVER (PARTITION BY symbol ORDER BY {c})+(count(*) OVER (PARTITION BY symbol, {c})-1)/2.0)/count({c}) OVER (PARTITION BY symbol)) AS fundamental_{c}_rank"


@query("w_fundamental_features", f"""WITH a AS (SELECT symbol, fiscal_date, net_income/nullif(revenue,0) AS net_margin, net_income/nullif(total_equity,0) AS roe, net_income/nullif(total_assets,0) AS roa FROM fund)
 SELECT symbol, fiscal_date, {_hr('net_margin')}, {_hr('roe')}, {_hr('roa')} FROM a WINDOW s AS (PARTITION BY symbol ORDER BY fiscal_date)""", 5)
def w_fundamental_features(sp, sf):
    return fu.ratio_features(d.fundamentals(sp, sf))


@query("w_fundamental_signals", """WITH g AS (SELECT symbol, fiscal_date, (revenue-lag(revenue) OVER s)/nullif(lag(revenue) OVER s,0) AS rg,
 (net_income-lag(net_income) OVER s)/nullif(abs(lag(net_income) OVER s),0) AS eg FROM fund WINDOW s AS (PARTITION BY symbol ORDER BY fiscal_date)),
 h AS (SELECT symbol, arg_max(coalesce(rg,-1e300),fiscal_date) AS rg, arg_max(coalesce(eg,-1e300),fiscal_date) AS eg FROM g GROUP BY symbol)
 SELECT symbol, R(nullif(rg,-1e300)) AS revenue_growth, R(nullif(eg,-1e300)) AS earnings_growth, R(s_acctbal) AS balance, try_cast(s_name AS DOUBLE) AS code
 FROM h LEFT JOIN supplier ON symbol=s_suppkey""")
def w_fundamental_signals(sp, sf):
    s = d.table(sp, sf, "supplier").select(F.col("s_suppkey").alias("symbol"), F.col("s_acctbal").cast("string").alias("balance"), F.col("s_name").alias("code"))
    return fu.signals(d.fundamentals(sp, sf), s, ["balance", "code"])


@query("w_rolling_ic", """WITH b AS (SELECT series, date, ret, volume, lead(ret) OVER (PARTITION BY series ORDER BY date) AS fwd, row_number() OVER (PARTITION BY series ORDER BY date) AS i,
 count(*) OVER (PARTITION BY series) AS n FROM idx), l AS (SELECT series, i, n, fwd, 'ret' AS feature, ret AS x FROM b UNION ALL SELECT series, i, n, fwd, 'volume', volume FROM b),
 p AS (SELECT a.series, a.feature, a.i AS e, w.x, w.fwd FROM l a JOIN l w ON a.series=w.series AND a.feature=w.feature AND w.i BETWEEN a.i-252 AND a.i-1
   WHERE a.i>252 AND w.x IS NOT NULL AND w.fwd IS NOT NULL),
 k AS (SELECT series, feature, e, rank() OVER (PARTITION BY series,feature,e ORDER BY x)+(count(*) OVER (PARTITION BY series,feature,e,x)-1)/2.0::DOUBLE AS rx,
  rank() OVER (PARTITION BY series,feature,e ORDER BY fwd)+(count(*) OVER (PARTITION BY series,feature,e,fwd)-1)/2.0::DOUBLE AS ry FROM p),
 c AS (SELECT series, feature, e, corr(rx,ry) AS ic FROM k GROUP BY ALL HAVING count(*)>10),
 s AS (SELECT series, feature, count(*) AS windows, avg(ic) AS m, stddev_pop(ic) AS sd FROM c WHERE NOT isnan(ic) GROUP BY ALL)
 SELECT series, feature, windows, R(m) AS ic_mean, R(sd) AS ic_std, R(abs(m)/(sd+1e-8)) AS stability, abs(m)>=0.02 AND abs(m)/(sd+1e-8)>1 AS selected FROM s""")
def w_rolling_ic(sp, sf):
    df = d.index(sp, sf).select("series", "date", "ret", "volume", F.lead("ret").over(t.ordered("series")).alias("fwd"))
    return cs.rolling_ic(df, ["ret", "volume"], "fwd")
