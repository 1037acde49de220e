"""Queries for the streaming operators, run as batch folds of the same functions."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.plans.registry import query
from tidepanel.sources import domain as d
from tidepanel.streaming import history as h, monitor, quotes


@query("st_latest_price", "SELECT symbol, max(ts) AS ts, R(last(price ORDER BY ts, event_id)) AS price, R(last(quantity ORDER BY ts, event_id)) AS quantity FROM (SELECT symbol, ts AS ts, price, quantity, event_id FROM ticks) GROUP BY symbol")
def st_latest_price(sp, sf):
    return quotes.latest_price(d.ticks(sp, sf))


@query("st_bars", "SELECT symbol, date_trunc('minute',ts)::TIMESTAMP AS date, R(first(price ORDER BY ts, event_id)) AS open, R(max(price)) AS high, R(min(price)) AS low, R(last(price ORDER BY ts, event_id)) AS close, R(sum(quantity)) AS volume FROM ticks GROUP BY ALL")
def st_bars(sp, sf):
    return quotes.bars(d.ticks(sp, sf))


@query("st_buffer_features", """WITH a AS (SELECT symbol, date, price/nullif(lag(price) OVER (PARTITION BY symbol ORDER BY date),0)-1 AS ret, volume FROM points), b AS (SELECT *, CASE WHEN ret IS NOT NULL THEN volume END AS v FROM a)
 SELECT symbol, date, R(CASE WHEN count(ret) OVER w>=10 THEN avg(ret) OVER w END) AS f_mean, R(CASE WHEN count(ret) OVER w>=10 THEN stddev_samp(ret) OVER w END) AS f_std, R(CASE WHEN count(ret) OVER w>=10 THEN skewness(ret) OVER w END) AS f_skew,
 R(CASE WHEN count(ret) OVER w>=10 THEN kurtosis(ret) OVER w END) AS f_kurt, R(CASE WHEN count(ret) OVER w>=10 THEN avg(v) OVER w END) AS f_volume, R(CASE WHEN count(ret) OVER w>=10 THEN avg(abs(ret)) OVER w END) AS f_volatility FROM b WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 251 PRECEDING)""", 5)
def st_buffer_features(sp, sf):
    return h.buffer_features(d.points(sp, sf)).drop("price", "volume", "ret")


@query("st_bayes_filter")
def st_bayes_filter(sp, sf):
    return monitor.filter_batch(d.points(sp, sf)).select("symbol", "date", "regime", "max_change", "alert", *[F.col("probs")[i].alias(f"p{i}") for i in range(3)])


@query("st_online_params")
def st_online_params(sp, sf):
    x = monitor.filter_batch(d.points(sp, sf)).groupBy("symbol").agg(F.max_by("mean", "date").alias("m"), F.count(F.lit(1)).alias("updates"))
    return x.select("symbol", "updates", F.posexplode("m").alias("i", "value")).select(
        "symbol", "updates", F.floor(F.col("i") / monitor.DIM).alias("regime"), (F.col("i") % monitor.DIM).alias("feature"), "value")


def _history(sp, sf):
    return d.regimes(sp, sf)


@query("st_transition_alerts", """WITH a AS (SELECT series, date, regime, p0, p1, p2, lag(regime) OVER s AS f, lag(p0) OVER s AS q0, lag(p1) OVER s AS q1, lag(p2) OVER s AS q2 FROM reg WINDOW s AS (PARTITION BY series ORDER BY date)), b AS (SELECT *, greatest(abs(p0-q0),abs(p1-q1),abs(p2-q2)) AS c FROM a WHERE q0 IS NOT NULL)
 SELECT series, date, f AS from_regime, regime AS to_regime, R(c) AS change FROM b WHERE c>0.25""")
def st_transition_alerts(sp, sf):
    return h.transition_alerts(_history(sp, sf), 0.25)


_H = """a AS (SELECT series, date, regime, p0, p1, p2, ret, vol, -(p0*ln(p0+1e-8)+p1*ln(p1+1e-8)+p2*ln(p2+1e-8)) AS h, (coalesce(regime<>lag(regime) OVER (PARTITION BY series ORDER BY date),false))::INT AS c FROM reg)"""


@query("st_stability", f"""WITH {_H} SELECT series, date, R(CASE WHEN count(*) OVER w=20 THEN 1-sum(c) OVER w1/19.0 END) AS consistency, R(CASE WHEN count(*) OVER w=20 THEN (stddev_pop(p0) OVER w+stddev_pop(p1) OVER w+stddev_pop(p2) OVER w)/3 END) AS avg_probability_volatility,
 R(CASE WHEN count(*) OVER w=20 THEN avg(h) OVER w END) AS avg_entropy, R(CASE WHEN count(*) OVER w=20 THEN stddev_pop(h) OVER w END) AS entropy_volatility FROM a WINDOW w AS (PARTITION BY series ORDER BY date ROWS 19 PRECEDING), w1 AS (PARTITION BY series ORDER BY date ROWS 18 PRECEDING)""")
def st_stability(sp, sf):
    return h.stability(_history(sp, sf))


_ST = f"""{_H}, st AS (SELECT series, date, count(*) OVER w AS n, greatest(stddev_pop(p0) OVER w, stddev_pop(p1) OVER w, stddev_pop(p2) OVER w) AS pv, avg(h) OVER w/ln(3.0::DOUBLE) AS un, sum(c) OVER w1/9.0::DOUBLE AS tf,
  sqrt(power(avg(ret) OVER wn-avg(ret) OVER wo,2)+power(avg(volume) OVER wn-avg(volume) OVER wo,2)) AS fd FROM (SELECT a.*, r.volume FROM a JOIN reg r ON a.series=r.series AND a.date=r.date) WINDOW w AS (PARTITION BY series ORDER BY date ROWS 9 PRECEDING), w1 AS (PARTITION BY series ORDER BY date ROWS 8 PRECEDING),
  wn AS (PARTITION BY series ORDER BY date ROWS 4 PRECEDING), wo AS (PARTITION BY series ORDER BY date ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING))"""


@query("st_stress", f"""WITH {_ST} SELECT series, date, R(CASE WHEN n=10 THEN pv END) AS probability_volatility, R(CASE WHEN n=10 THEN un END) AS uncertainty, R(CASE WHEN n=10 THEN tf END) AS transition_frequency, R(CASE WHEN n=10 THEN fd END) AS feature_drift,
 coalesce(n=10 AND pv>0.3,false) AS probability_volatility_alert, coalesce(n=10 AND un>0.8,false) AS uncertainty_alert, coalesce(n=10 AND tf>0.5,false) AS transition_frequency_alert, coalesce(n=10 AND fd>2.0,false) AS feature_drift_alert FROM st""")
def st_stress(sp, sf):
    return h.stress(_history(sp, sf), ["ret", "volume"])


_EW = f"""{_ST}, lg AS (SELECT series, date, row_number() OVER (PARTITION BY series ORDER BY date)::DOUBLE AS i, unnest([0,1,2]) AS rg, unnest([p0,p1,p2])::DOUBLE AS p FROM reg), tr AS (SELECT series, date, rg, CASE WHEN count(p) OVER w=5 THEN regr_slope(p,i) OVER w END AS sl, CASE WHEN count(p) OVER w=5 THEN corr(p,i) OVER w END AS r FROM lg WINDOW w AS (PARTITION BY series, rg ORDER BY date ROWS 4 PRECEDING)),
 ew AS (SELECT series, date, unnest(['probability_volatility','uncertainty','transition_frequency','feature_drift']) AS indicator, unnest([pv,un,tf,fd]) AS level, unnest([pv>0.3,un>0.8,tf>0.5,fd>2.0]) AS al FROM st WHERE n=10),
 aw AS (SELECT series, date, indicator, level, CASE WHEN level>0.8 THEN 'high' ELSE 'medium' END AS severity FROM ew WHERE al UNION ALL SELECT series, date, 'trend_'||rg, sl, 'medium' FROM tr WHERE sl>0.1 AND r>0.7 AND (r*r>=1-1e-12 OR abs(r)*sqrt(3.0::DOUBLE)>2.3534::DOUBLE*sqrt(greatest(1-r*r,0))))"""


@query("st_early_warning", f"WITH {_EW} SELECT series, date, indicator, R(level) AS level, severity FROM aw")
def st_early_warning(sp, sf):
    return h.early_warnings(_history(sp, sf), ["ret", "volume"])


@query("st_status", f"""WITH {_EW}, tc AS (SELECT series, p0, p1, p2, lag(p0) OVER s AS q0, lag(p1) OVER s AS q1, lag(p2) OVER s AS q2 FROM reg WINDOW s AS (PARTITION BY series ORDER BY date)), al AS (SELECT series, count(*) AS alerts FROM tc WHERE greatest(abs(p0-q0),abs(p1-q1),abs(p2-q2))>0.25 GROUP BY series),
 wn AS (SELECT series, count(*) AS warnings FROM aw GROUP BY series) SELECT r.series, count(*) AS updates, max(date) AS last_update, arg_max(regime,date) AS current_regime, R(arg_max(greatest(p0,p1,p2),date)) AS confidence, coalesce(max(alerts),0) AS alerts, coalesce(max(warnings),0) AS warnings FROM reg r LEFT JOIN al USING (series) LEFT JOIN wn USING (series) GROUP BY r.series""")
def st_status(sp, sf):
    x = _history(sp, sf)
    return h.status(x, h.transition_alerts(x, 0.25), h.early_warnings(x, ["ret", "volume"]))
