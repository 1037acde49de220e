"""Queries for the per-symbol window features (weekly bars where candles matter)."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidepanel.core.frames import roll
from tidepanel.core.history import expanding_rank
from tidepanel.operators import technical as t
from tidepanel.plans.registry import query
from tidepanel.sources import domain as d

K = ["symbol", "date"]
S = "PARTITION BY symbol ORDER BY date"


def W(*ns: int, key: str = "symbol") -> str:
    parts = [f"s AS (PARTITION BY {key} ORDER BY date)",
             f"x AS (PARTITION BY {key} ORDER BY date ROWS UNBOUNDED PRECEDING)"]
    parts += [f"w{n} AS (PARTITION BY {key} ORDER BY date ROWS {n - 1} PRECEDING)" for n in ns]
    return "WINDOW " + ", ".join(parts)


def rl(n: int, x: str, agg: str = "avg") -> str:
    return f"CASE WHEN count({x}) OVER w{n}={n} THEN {agg}({x}) OVER w{n} END"


def pick(df, *cols):
    return df.select(*K, *cols)


@query("w_returns", f"SELECT symbol, date, R(ret) AS ret, R(log_ret) AS log_ret FROM rets")
def w_returns(sp, sf):
    return pick(t.returns(d.bars(sp, sf)), "ret", "log_ret")


@query("w_price_ratios", """SELECT symbol, date, R(high/nullif(low,0)) AS high_low_ratio, R(close/nullif(open,0)) AS close_open_ratio,
  R(high/nullif(close,0)) AS high_close_ratio, R(low/nullif(close,0)) AS low_close_ratio FROM bars_w""")
def w_price_ratios(sp, sf):
    return pick(t.price_ratios(d.bars_w(sp, sf)), "high_low_ratio", "close_open_ratio", "high_close_ratio", "low_close_ratio")


_P = (5, 10, 20, 50, 100, 252)


@query("w_sma", "SELECT symbol, date, " + ", ".join(f"R({rl(n, 'close')}) AS sma_{n}" for n in _P) + f" FROM bars {W(*_P)}", 4)
def w_sma(sp, sf):
    return pick(t.sma(d.bars(sp, sf), _P), *[f"sma_{n}" for n in _P])


_EMA = """WITH RECURSIVE bn AS MATERIALIZED (SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM bars),
 e AS (SELECT symbol, date, rn, {init} FROM bn WHERE rn=1 UNION ALL
 SELECT b.symbol, b.date, b.rn, {step} FROM e JOIN bn b ON b.symbol=e.symbol AND b.rn=e.rn+1)"""


def _ema_sql(*spans):
    init = ", ".join(f"close AS n{n}, 1.0::DOUBLE AS d{n}" for n in spans)
    step = ", ".join(f"e.n{n}*(1-2.0::DOUBLE/({n}+1))+b.close, e.d{n}*(1-2.0::DOUBLE/({n}+1))+1" for n in spans)
    return _EMA.format(init=init, step=step)


_ES = (5, 10, 20, 50)


@query("w_ema", _ema_sql(*_ES) + " SELECT symbol, date, " + ", ".join(f"R(n{n}/d{n}) AS ema_{n}" for n in _ES) + " FROM e", 4)
def w_ema(sp, sf):
    return pick(t.ema(d.bars(sp, sf), _ES), *[f"ema_{n}" for n in _ES])


@query("w_price_to_ma", _ema_sql(5, 20) + f""", m AS (SELECT symbol, date, close, {rl(5, 'close')} AS s5, {rl(20, 'close')} AS s20 FROM bars {W(5, 20)})
 SELECT m.symbol, m.date, R(close/s5) AS price_to_sma_5, R(close/s20) AS price_to_sma_20,
 R(s5/lag(s5,5) OVER s-1) AS sma_slope_5, R(s20/lag(s20,5) OVER s-1) AS sma_slope_20,
 R(close/(n5/d5)) AS price_to_ema_5, R(close/(n20/d20)) AS price_to_ema_20
 FROM m JOIN e ON m.symbol=e.symbol AND m.date=e.date WINDOW s AS (PARTITION BY m.symbol ORDER BY m.date)""")
def w_price_to_ma(sp, sf):
    return pick(t.price_to_ma(d.bars(sp, sf), (5, 20)), *[f"{k}_{n}" for n in (5, 20) for k in ("price_to_sma", "sma_slope", "price_to_ema")])


@query("w_bollinger", f"""WITH b AS (SELECT symbol, date, close, {rl(20, 'close')} AS m, {rl(20, 'close', 'stddev_samp')} AS sd FROM bars {W(20)})
 SELECT symbol, date, R(m) AS bb_mid_20, R(m+2*sd) AS bb_upper_20, R(m-2*sd) AS bb_lower_20, R(4*sd/nullif(m,0)) AS bb_width_20,
 R((close-(m-2*sd))/nullif(4*sd,0)) AS bb_position_20 FROM b""", 4)
def w_bollinger(sp, sf):
    return pick(t.bollinger(d.bars(sp, sf)), "bb_mid_20", "bb_upper_20", "bb_lower_20", "bb_width_20", "bb_position_20")


@query("w_channel", "SELECT symbol, date, " + ", ".join(
    f"R((close-({rl(n, 'low', 'min')}))/nullif(({rl(n, 'high', 'max')})-({rl(n, 'low', 'min')}),0)) AS channel_position_{n}"
    for n in (20, 50)) + f" FROM bars {W(20, 50)}")
def w_channel(sp, sf):
    return pick(t.channel(d.bars(sp, sf)), "channel_position_20", "channel_position_50")


def _sr(n):
    h, l = f"({rl(n, 'high', 'max')})", f"({rl(n, 'low', 'min')})"
    return f"R({h}) AS high_{n}, R({l}) AS low_{n}, R((close-{h})/{h}) AS high_distance_{n}, R((close-{l})/{l}) AS low_distance_{n}"


@query("w_support_resistance", f"SELECT symbol, date, {_sr(20)}, {_sr(50)} FROM bars {W(20, 50)}")
def w_support_resistance(sp, sf):
    return pick(t.support_resistance(d.bars(sp, sf)), *[f"{k}_{n}" for n in (20, 50) for k in ("high", "low", "high_distance", "low_distance")])


def _rsi(n):
    g, l = f"({rl(n, 'g')})", f"({rl(n, 'l')})"
    return f"R(CASE WHEN {l}=0 AND {g}>0 THEN 100 ELSE 100-100/(1+{g}/nullif({l},0)) END) AS rsi_{n}"


@query("w_rsi", f"""WITH a AS (SELECT symbol, date, coalesce(close-lag(close) OVER ({S}),0) AS dl FROM bars),
 b AS (SELECT symbol, date, greatest(dl,0) AS g, greatest(-dl,0) AS l FROM a)
 SELECT symbol, date, {_rsi(14)}, {_rsi(30)} FROM b {W(14, 30)}""")
def w_rsi(sp, sf):
    return pick(t.rsi(d.bars(sp, sf)), "rsi_14", "rsi_30")


@query("w_macd", """WITH RECURSIVE bn AS MATERIALIZED (SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM bars),
 e AS (SELECT symbol, date, rn, close AS a, 1.0::DOUBLE AS ad, close AS b, 1.0::DOUBLE AS bd, 0.0::DOUBLE AS g, 1.0::DOUBLE AS gd FROM bn WHERE rn=1
 UNION ALL SELECT q.symbol, q.date, q.rn, q.a, q.ad, q.b, q.bd, q.g0*(1-2.0::DOUBLE/10)+(q.a/q.ad-q.b/q.bd), q.gd0*(1-2.0::DOUBLE/10)+1 FROM
 (SELECT n.symbol, n.date, n.rn, e.a*(1-2.0::DOUBLE/13)+n.close AS a, e.ad*(1-2.0::DOUBLE/13)+1 AS ad, e.b*(1-2.0::DOUBLE/27)+n.close AS b,
  e.bd*(1-2.0::DOUBLE/27)+1 AS bd, e.g AS g0, e.gd AS gd0 FROM e JOIN bn n ON n.symbol=e.symbol AND n.rn=e.rn+1) q)
 SELECT symbol, date, R(a/ad-b/bd) AS macd_line, R(g/gd) AS macd_signal, R(a/ad-b/bd-g/gd) AS macd_histogram FROM e""", 4)
def w_macd(sp, sf):
    return pick(t.macd(d.bars(sp, sf)), "macd_line", "macd_signal", "macd_histogram")


@query("w_momentum", "SELECT symbol, date, " + ", ".join(
    f"R(close/nullif(lag(close,{n}) OVER s,0)-1) AS momentum_{n}, R(100*(close/nullif(lag(close,{n}) OVER s,0)-1)) AS roc_{n}" for n in (5, 10, 20)) + f" FROM bars {W()}")
def w_momentum(sp, sf):
    return pick(t.momentum(d.bars(sp, sf)), *[f"{k}_{n}" for n in (5, 10, 20) for k in ("momentum", "roc")])


@query("w_williams_r", "SELECT symbol, date, " + ", ".join(
    f"R(-100*(({rl(n, 'high', 'max')})-close)/nullif(({rl(n, 'high', 'max')})-({rl(n, 'low', 'min')}),0)) AS williams_r_{n}" for n in (14, 28)) + f" FROM bars_w {W(14, 28)}")
def w_williams_r(sp, sf):
    return pick(t.williams_r(d.bars_w(sp, sf)), "williams_r_14", "williams_r_28")


@query("w_stochastic", "WITH k AS (SELECT symbol, date, " + ", ".join(
    f"100*(close-({rl(n, 'low', 'min')}))/nullif(({rl(n, 'high', 'max')})-({rl(n, 'low', 'min')}),0) AS k{n}" for n in (14, 21)) + f""" FROM bars_w {W(14, 21)})
 SELECT symbol, date, R(k14) AS stoch_k_14, R({rl(3, 'k14')}) AS stoch_d_14, R(k21) AS stoch_k_21, R({rl(3, 'k21')}) AS stoch_d_21 FROM k {W(3)}""")
def w_stochastic(sp, sf):
    return pick(t.stochastic(d.bars_w(sp, sf)), "stoch_k_14", "stoch_d_14", "stoch_k_21", "stoch_d_21")


@query("w_hist_vol", "WITH v AS (SELECT symbol, date, " + ", ".join(f"({rl(n, 'ret', 'stddev_samp')})*sqrt(252.0::DOUBLE) AS v{n}" for n in (5, 10, 20, 50)) + f" FROM rets {W(5, 10, 20, 50)}) SELECT symbol, date, "
       + ", ".join(f"R(v{n}) AS volatility_{n}, R(v{n}/nullif({rl(2 * n, f'v{n}')},0)) AS volatility_ratio_{n}" for n in (5, 10, 20, 50)) + f" FROM v {W(10, 20, 40, 100)}")
def w_hist_vol(sp, sf):
    return pick(t.hist_vol(d.rets(sp, sf)), *[f"{k}_{n}" for n in (5, 10, 20, 50) for k in ("volatility", "volatility_ratio")])


@query("w_parkinson", "WITH h AS (SELECT symbol, date, power(ln(high/nullif(low,0)),2) AS hl FROM bars_w) SELECT symbol, date, " + ", ".join(
    f"R(sqrt(({rl(n, 'hl')})*252/(4*ln(2.0::DOUBLE)))) AS parkinson_{n}" for n in (5, 10, 20)) + f" FROM h {W(5, 10, 20)}")
def w_parkinson(sp, sf):
    return pick(t.parkinson(d.bars_w(sp, sf)), "parkinson_5", "parkinson_10", "parkinson_20")


@query("w_garch_like", f"SELECT symbol, date, R(sqrt(0.94::DOUBLE*({rl(20, 'ret', 'var_samp')})+0.06::DOUBLE*ret*ret)) AS volatility_garch FROM rets {W(20)}")
def w_garch_like(sp, sf):
    return pick(t.garch_like(d.rets(sp, sf)), "volatility_garch")


@query("w_true_range_atr", f"""WITH r AS (SELECT symbol, date, close, CASE WHEN lag(close) OVER s IS NOT NULL THEN
 greatest(high-low, abs(high-lag(close) OVER s), abs(low-lag(close) OVER s)) END AS tr FROM bars_w {W()}),
 a AS (SELECT *, {rl(14, 'tr')} AS a14, {rl(21, 'tr')} AS a21 FROM r {W(14, 21)})
 SELECT symbol, date, R(tr) AS true_range, R(a14) AS atr_14, R(a21) AS atr_21, R(a14/nullif(close,0)) AS atr_ratio_14, R(a21/nullif(close,0)) AS atr_ratio_21 FROM a""", 5)
def w_true_range_atr(sp, sf):
    return pick(t.true_range_atr(d.bars_w(sp, sf)), "true_range", "atr_14", "atr_21", "atr_ratio_14", "atr_ratio_21")


@query("w_vol_clustering", f"""WITH a AS (SELECT symbol, date, ret*ret AS r2, lag(ret*ret) OVER ({S}) AS l2 FROM rets)
 SELECT symbol, date, R(CASE WHEN count(l2) OVER w20=20 THEN corr(r2,l2) OVER w20 END) AS volatility_clustering FROM a {W(20)}""")
def w_vol_clustering(sp, sf):
    return pick(t.vol_clustering(d.rets(sp, sf)), "volatility_clustering")


def _ewv(*ns):
    init = ", ".join(f"1.0::DOUBLE AS w{n}, 1.0::DOUBLE AS q{n}, ret AS m{n}, 0.0::DOUBLE AS s{n}" for n in ns)
    step = ", ".join(
        f"e.w{n}*k{n}+1, e.q{n}*k{n}*k{n}+1, e.m{n}+(b.ret-e.m{n})/(e.w{n}*k{n}+1), e.s{n}*k{n}+(b.ret-e.m{n})*(b.ret-(e.m{n}+(b.ret-e.m{n})/(e.w{n}*k{n}+1)))"
        .replace(f"k{n}", f"(1-2.0::DOUBLE/({n}+1))") for n in ns)
    out = ", ".join(f"R(CASE WHEN rn>=2 THEN sqrt(s{n}/w{n}*w{n}*w{n}/(w{n}*w{n}-q{n})*252) END) AS ewm_vol_{n}" for n in ns)
    return f"""WITH RECURSIVE bn AS MATERIALIZED (SELECT symbol, date, ret, row_number() OVER ({S}) AS rn FROM rets WHERE ret IS NOT NULL),
 e AS (SELECT symbol, date, rn, {init} FROM bn WHERE rn=1 UNION ALL SELECT b.symbol, b.date, b.rn, {step} FROM e JOIN bn b ON b.symbol=e.symbol AND b.rn=e.rn+1)
 SELECT r.symbol, r.date, {out} FROM rets r LEFT JOIN e ON r.symbol=e.symbol AND r.date=e.date"""


@query("w_ewm_vol", _ewv(10, 20, 50))
def w_ewm_vol(sp, sf):
    return pick(t.ewm_vol(d.rets(sp, sf)), "ewm_vol_10", "ewm_vol_20", "ewm_vol_50")


@query("w_vol_of_vol", "WITH v AS (SELECT symbol, date, " + ", ".join(f"{rl(n, 'ret', 'stddev_samp')} AS v{n}" for n in (10, 20, 50)) + f" FROM rets {W(10, 20, 50)}) SELECT symbol, date, "
       + ", ".join(f"R({rl(n, f'v{n}', 'stddev_samp')}) AS vol_of_vol_{n}" for n in (10, 20, 50)) + f" FROM v {W(10, 20, 50)}")
def w_vol_of_vol(sp, sf):
    return pick(t.vol_of_vol(d.rets(sp, sf)), "vol_of_vol_10", "vol_of_vol_20", "vol_of_vol_50")


@query("w_downside_vol", f"""WITH a AS (SELECT symbol, date, ret, coalesce(ret<0,false) AS neg FROM rets) SELECT symbol, date, """ + ", ".join(
    f"R(CASE WHEN neg THEN sqrt(({rl(n, 'ret', 'var_samp')})*252) END) AS downside_vol_{n}" for n in (10, 20, 50)) + f" FROM a {W(10, 20, 50, key='symbol, neg')}")
def w_downside_vol(sp, sf):
    return pick(t.downside_vol(d.rets(sp, sf)), "downside_vol_10", "downside_vol_20", "downside_vol_50")


@query("w_volume_ma", "SELECT symbol, date, " + ", ".join(f"R({rl(n, 'volume')}) AS volume_ma_{n}, R(volume/nullif({rl(n, 'volume')},0)) AS volume_ratio_{n}" for n in (10, 20, 50)) + f" FROM bars {W(10, 20, 50)}")
def w_volume_ma(sp, sf):
    return pick(t.volume_ma(d.bars(sp, sf)), *[f"{k}_{n}" for n in (10, 20, 50) for k in ("volume_ma", "volume_ratio")])


@query("w_obv", f"""WITH a AS (SELECT symbol, date, coalesce(sign(close-lag(close) OVER ({S}))*volume,0) AS sv FROM bars),
 b AS (SELECT symbol, date, sum(sv) OVER x AS obv FROM a {W()}) SELECT symbol, date, R(obv) AS obv, R({rl(20, 'obv')}) AS obv_ma FROM b {W(20)}""")
def w_obv(sp, sf):
    return pick(t.obv(d.bars(sp, sf)), "obv", "obv_ma")


@query("w_vpt", f"SELECT symbol, date, R(sum(ret*volume) OVER x) AS vpt FROM rets {W()}", 4)
def w_vpt(sp, sf):
    return pick(t.vpt(d.rets(sp, sf)), "vpt")


@query("w_ad_line", f"SELECT symbol, date, R(sum(coalesce((2*close-low-high)/nullif(high-low,0),0)*volume) OVER x) AS ad_line FROM bars_w {W()}", 4)
def w_ad_line(sp, sf):
    return pick(t.ad_line(d.bars_w(sp, sf)), "ad_line")


@query("w_vwap", f"""WITH a AS (SELECT symbol, date, volume, close*volume AS pv, (high+low+close)/3*volume AS tv FROM bars)
 SELECT symbol, date, R(({rl(20, 'pv', 'sum')})/nullif({rl(20, 'volume', 'sum')},0)) AS vwap_20,
 R(({rl(14, 'tv', 'sum')})/nullif({rl(14, 'volume', 'sum')},0)) AS vwap_typical_14 FROM a {W(14, 20)}""", 4)
def w_vwap(sp, sf):
    return pick(t.vwap(d.bars(sp, sf)), "vwap_20", "vwap_typical_14")


@query("w_ease_of_movement", f"""WITH a AS (SELECT symbol, date, ((high+low)/2-(lag(high) OVER s+lag(low) OVER s)/2)*(high-low)/nullif(volume,0)*1e8 AS eom FROM bars_w {W()})
 SELECT symbol, date, R(eom/1e8) AS eom, R(({rl(14, 'eom')})/1e8) AS eom_sma_14 FROM a {W(14)}""", 3)
def w_ease_of_movement(sp, sf):
    df = t.ease_of_movement(d.bars_w(sp, sf))
    return df.select(*K, (F.col("eom") / 1e8).alias("eom"), (F.col("eom_sma_14") / 1e8).alias("eom_sma_14"))


@query("w_candles", """SELECT symbol, date, R(abs(close-open)/nullif(high-low,0)) AS body_size,
 R((high-greatest(open,close))/nullif(high-low,0)) AS upper_shadow_ratio, R((least(open,close)-low)/nullif(high-low,0)) AS lower_shadow_ratio,
 coalesce(abs(close-open)/nullif(high-low,0)<0.1::DOUBLE,false)::INT AS doji,
 (least(open,close)-low>2*abs(close-open) AND high-greatest(open,close)<0.1::DOUBLE*(high-low))::INT AS hammer FROM bars_w""")
def w_candles(sp, sf):
    return pick(t.candles(d.bars_w(sp, sf)), "body_size", "upper_shadow_ratio", "lower_shadow_ratio", "doji", "hammer")


@query("w_engulfing_gaps", f"""SELECT symbol, date,
 coalesce(close>open AND lag(close) OVER s<lag(open) OVER s AND close>lag(open) OVER s AND open<lag(close) OVER s,false)::INT AS bullish_engulfing,
 coalesce(close<open AND lag(close) OVER s>lag(open) OVER s AND close<lag(open) OVER s AND open>lag(close) OVER s,false)::INT AS bearish_engulfing,
 coalesce(open>lag(high) OVER s,false)::INT AS gap_up, coalesce(open<lag(low) OVER s,false)::INT AS gap_down FROM bars_w {W()}""")
def w_engulfing_gaps(sp, sf):
    return pick(t.engulfing_gaps(d.bars_w(sp, sf)), "bullish_engulfing", "bearish_engulfing", "gap_up", "gap_down")


@query("w_higher_moments", "SELECT symbol, date, " + ", ".join(
    f"R({rl(n, 'ret', 'skewness')}) AS skewness_{n}, R({rl(n, 'ret', 'kurtosis')}) AS kurtosis_{n}" for n in (10, 20, 50)) + f" FROM rets {W(10, 20, 50)}")
def w_higher_moments(sp, sf):
    return pick(t.higher_moments(d.rets(sp, sf)), *[f"{k}_{n}" for n in (10, 20, 50) for k in ("skewness", "kurtosis")])


@query("w_var_quantile", "SELECT symbol, date, " + ", ".join(
    f"R(CASE WHEN count(ret) OVER w{n}={n} THEN quantile_cont(ret,{p}) OVER w{n} END) AS var_{int(p * 100)}_{n}" for n in (20, 50) for p in (0.05, 0.01)) + f" FROM rets {W(20, 50)}")
def w_var_quantile(sp, sf):
    return pick(t.var_quantile(d.rets(sp, sf)), *[f"var_{p}_{n}" for n in (20, 50) for p in (5, 1)])


@query("w_cvar", "WITH a AS (SELECT symbol, date, " + ", ".join(
    f"CASE WHEN count(ret) OVER w{n}={n} THEN quantile_cont(ret,{p}) OVER w{n} END AS q{int(p * 100)}_{n}, list(ret) OVER w{n} AS l{int(p * 100)}_{n}" for n in (20, 50) for p in (0.05, 0.01))
    + f" FROM rets {W(20, 50)}) SELECT symbol, date, " + ", ".join(
    f"R(CASE WHEN q{p}_{n} IS NOT NULL THEN list_avg(list_filter(l{p}_{n}, lambda v: v<=q{p}_{n})) END) AS cvar_{p}_{n}" for n in (20, 50) for p in (5, 1)) + " FROM a")
def w_cvar(sp, sf):
    return pick(t.cvar(d.rets(sp, sf)), *[f"cvar_{p}_{n}" for n in (20, 50) for p in (5, 1)])


@query("w_autocorr", "WITH a AS (SELECT symbol, date, ret, " + ", ".join(f"lag(ret,{k}) OVER s AS p{k}" for k in (1, 5, 10)) + f" FROM rets {W()}) SELECT symbol, date, "
       + ", ".join(f"R(CASE WHEN count(ret) OVER w50=50 THEN corr(ret,p{k}) OVER w{50 - k} END) AS autocorr_lag_{k}" for k in (1, 5, 10)) + f" FROM a {W(50, 49, 45, 40)}")
def w_autocorr(sp, sf):
    return pick(t.autocorr(d.rets(sp, sf)), "autocorr_lag_1", "autocorr_lag_5", "autocorr_lag_10")


_HL = range(2, 20)
_HX = [math.log(k) for k in _HL]
_HC = [(x - sum(_HX) / len(_HX)) / sum((v - sum(_HX) / len(_HX)) ** 2 for v in _HX) for x in _HX]


@query("w_hurst", "WITH a AS (SELECT symbol, date, ret, " + ", ".join(f"ret-lag(ret,{k}) OVER s AS d{k}" for k in _HL) + f" FROM rets {W()}), b AS (SELECT symbol, date, count(ret) OVER w100 AS c, "
       + ", ".join(f"stddev_pop(d{k}) OVER w{100 - k} AS t{k}" for k in _HL) + f" FROM a {W(100, *[100 - k for k in _HL])}) SELECT symbol, date, R(CASE WHEN c=100 THEN "
       + "+".join(f"ln(nullif(t{k},0))*({c!r}::DOUBLE)" for k, c in zip(_HL, _HC)) + " END) AS hurst FROM b")
def w_hurst(sp, sf):
    return pick(t.hurst(d.rets(sp, sf)), "hurst")


@query("w_hl_spread", f"""WITH a AS (SELECT symbol, date, (high-low)/nullif(close,0) AS sp FROM bars_w) SELECT symbol, date, R(sp) AS hl_spread, R({rl(20, 'sp')}) AS hl_spread_ma FROM a {W(20)}""")
def w_hl_spread(sp, sf):
    return pick(t.hl_spread(d.bars_w(sp, sf)), "hl_spread", "hl_spread_ma")


@query("w_amihud", f"""WITH a AS (SELECT symbol, date, ret, volume, abs(ret)/nullif(volume*close,0) AS am FROM rets)
 SELECT symbol, date, R(am) AS amihud, R({rl(20, 'am')}) AS amihud_ma, R(ret/(volume+1e-8)) AS price_impact,
 R(({rl(20, 'volume', 'stddev_samp')})/nullif({rl(20, 'volume')},0)) AS volume_cv FROM a {W(20)}""", 9)
def w_amihud(sp, sf):
    return pick(t.amihud(d.rets(sp, sf)), "amihud", "amihud_ma", "price_impact", "volume_cv")


@query("w_roll_spread", f"""WITH a AS (SELECT symbol, date, ret, lag(ret) OVER ({S}) AS p FROM rets), b AS (SELECT symbol, date,
 CASE WHEN count(p) OVER w20=20 THEN covar_samp(ret,p) OVER w20 END AS cv FROM a {W(20)})
 SELECT symbol, date, R(CASE WHEN cv IS NOT NULL THEN 2*sqrt(-least(cv,0)) END) AS roll_spread FROM b""")
def w_roll_spread(sp, sf):
    return pick(t.roll_spread(d.rets(sp, sf)), "roll_spread")


@query("w_close_position", "SELECT symbol, date, R((close-low)/nullif(high-low,0)) AS close_position, R(high/nullif(low,0)) AS high_low_ratio FROM bars_w")
def w_close_position(sp, sf):
    return pick(t.close_position(d.bars_w(sp, sf)), "close_position", "high_low_ratio")


@query("w_zscore_roll", f"""SELECT symbol, date, R(CASE WHEN count(ret) OVER w60>=10 THEN (ret-avg(ret) OVER w60)/nullif(stddev_samp(ret) OVER w60,0) END) AS z_roll,
 R(CASE WHEN count(ret) OVER x>=10 THEN (ret-avg(ret) OVER x)/nullif(stddev_samp(ret) OVER x,0) END) AS z_exp FROM rets {W(60)}""")
def w_zscore_roll(sp, sf):
    df = t.zscore_roll(d.rets(sp, sf), window=60, out="z_roll")
    return pick(t.zscore_roll(df, out="z_exp"), "z_roll", "z_exp")


@query("w_robust_roll", f"""WITH a AS (SELECT symbol, date, ret, list(ret) OVER w60 AS l, count(ret) OVER w60 AS c, quantile_cont(ret,0.5) OVER w60 AS m FROM rets {W(60)})
 SELECT symbol, date, R(CASE WHEN c>=10 THEN (ret-m)/nullif(list_aggregate(list_transform(list_filter(l, lambda q: q IS NOT NULL), lambda v: abs(v-m)),'median'),0) END) AS robust FROM a""")
def w_robust_roll(sp, sf):
    return pick(t.robust_roll(d.rets(sp, sf), window=60), "robust")


@query("w_minmax_roll", f"""SELECT symbol, date, R(CASE WHEN count(ret) OVER w60>=10 THEN (ret-min(ret) OVER w60)/nullif(max(ret) OVER w60-min(ret) OVER w60,0) END) AS mm_roll,
 R(CASE WHEN count(ret) OVER x>=10 THEN (ret-min(ret) OVER x)/nullif(max(ret) OVER x-min(ret) OVER x,0) END) AS mm_exp FROM rets {W(60)}""")
def w_minmax_roll(sp, sf):
    df = t.minmax_roll(d.rets(sp, sf), window=60, out="mm_roll")
    return pick(t.minmax_roll(df, out="mm_exp"), "mm_roll", "mm_exp")


@query("w_mean_reversion", "SELECT symbol, date, " + ", ".join(f"R(-(ret-({rl(n, 'ret')}))/nullif({rl(n, 'ret', 'stddev_samp')},0)) AS mean_reversion_{n}" for n in (5, 10)) + f" FROM rets {W(5, 10)}")
def w_mean_reversion(sp, sf):
    return pick(t.mean_reversion(d.rets(sp, sf)), "mean_reversion_5", "mean_reversion_10")


@query("w_roll_rank", "WITH a AS (SELECT symbol, date, " + ", ".join(f"{rl(n, 'ret')} AS m{n}" for n in (10, 20)) + f""" FROM rets {W(10, 20)}),
 b AS (SELECT symbol, date, m10, m20, list(m10) OVER w10 AS l10, list(m20) OVER w20 AS l20, count(m10) OVER w10 AS c10, count(m20) OVER w20 AS c20 FROM a {W(10, 20)})
 SELECT symbol, date, """ + ", ".join(f"R(CASE WHEN c{n}={n} THEN (len(list_filter(l{n}, lambda v: v<m{n}))+(len(list_filter(l{n}, lambda v: v=m{n}))+1)/2.0)/{n} END) AS percentile_rank_{n}" for n in (10, 20)) + " FROM b")
def w_roll_rank(sp, sf):
    return pick(t.rolling_rank(d.rets(sp, sf)), "percentile_rank_10", "percentile_rank_20")


_HM = f"WITH a AS (SELECT symbol, date, {rl(20, 'ret')} AS m FROM rets {W(20)})"


def _rolling_mean(sp, sf):
    return d.rets(sp, sf).select("symbol", "date", roll(F.avg, "ret", 20).alias("m"))


@query("w_hist_rank", _HM + """, r AS (SELECT x.symbol, x.date, ((count(*) FILTER (y.m<x.m))+((count(*) FILTER (y.m=x.m))+1)/2.0::DOUBLE)/count(y.m) AS k FROM a x JOIN a y ON x.symbol=y.symbol AND y.date<=x.date WHERE x.m IS NOT NULL GROUP BY x.symbol, x.date)
 SELECT symbol, date, R(k) AS momentum_rank FROM a LEFT JOIN r USING (symbol, date)""")
def w_hist_rank(sp, sf):
    """Rank among the values known at the time."""
    return pick(expanding_rank(_rolling_mean(sp, sf), ["symbol"], "date", "m", "momentum_rank"), "momentum_rank")


@query("w_hist_rank_full", _HM + """ SELECT symbol, date, R(CASE WHEN m IS NOT NULL THEN (rank() OVER (PARTITION BY symbol ORDER BY m NULLS LAST)+(count(*) OVER (PARTITION BY symbol, m)-1)/2.0)/count(m) OVER (PARTITION BY symbol) END) AS momentum_rank FROM a""")
def w_hist_rank_full(sp, sf):
    """Rank among the whole history, later values included."""
    return pick(t.history_rank(_rolling_mean(sp, sf), "m", "momentum_rank"), "momentum_rank")


_DD = f"""WITH a AS (SELECT series AS symbol, date, exp(sum(ln(1+coalesce(ret,0))) OVER (PARTITION BY series ORDER BY date ROWS UNBOUNDED PRECEDING)) AS wealth FROM idx),
 b AS (SELECT *, max(wealth) OVER ({S} ROWS UNBOUNDED PRECEDING) AS peak FROM a)"""


@query("w_drawdown", _DD + " SELECT symbol AS series, date, R(wealth) AS wealth, R(peak) AS peak, R(wealth/peak-1) AS drawdown FROM b")
def w_drawdown(sp, sf):
    return t.drawdown(d.index(sp, sf), "series").select("series", "date", "wealth", "peak", "drawdown")


@query("w_drawdown_periods", _DD + f""", c AS (SELECT *, wealth/peak-1 AS dd, wealth/peak-1<-1e-12 AS u FROM b),
 f AS (SELECT *, CASE WHEN u AND NOT coalesce(lag(u) OVER ({S}),false) THEN 1 ELSE 0 END AS st FROM c),
 g AS (SELECT *, sum(st) OVER ({S} ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM f)
 SELECT symbol AS series, island, min(date) AS start, max(date) AS "end", R(min(dd)) AS depth, count(*) AS rows, date_diff('day', min(date), max(date))::INT AS days FROM g WHERE u GROUP BY symbol, island""")
def w_drawdown_periods(sp, sf):
    return t.drawdown_periods(d.index(sp, sf), "series")


@query("w_forward_return", f"SELECT symbol, date, R(lead(ret) OVER s) AS fwd_ret_1 FROM rets {W()}")
def w_forward_return(sp, sf):
    return pick(t.forward_return(d.rets(sp, sf)), "fwd_ret_1")
