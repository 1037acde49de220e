"""Queries for data-quality rules and outlier handling."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tidepanel.core.frames import attach
from tidepanel.operators import fundamentals as fu, quality as q
from tidepanel.plans.registry import query
from tidepanel.sources import domain as d


@query("dq_missing", """WITH a AS (SELECT count(*) AS n, count(*)-count(open) AS o, count(*)-count(high) AS h, count(*)-count(low) AS w, count(*)-count(close) AS c, count(*)-count(volume) AS v FROM cal), l AS (SELECT n, unnest(['open','high','low','close','volume','*']) AS "column", unnest([o,h,w,c,v,o+h+w+c+v]) AS missing, unnest([1,1,1,1,1,5]) AS k FROM a)
 SELECT "column", missing, R(missing::DOUBLE/(n*k)) AS share, CASE WHEN missing::DOUBLE/(n*k)>0.05 THEN 'WARNING' ELSE 'PASS' END AS status FROM l""")
def dq_missing(sp, sf):
    return q.missing(d.calendar_bars(sp, sf), ["open", "high", "low", "close", "volume"])


def _oc(c):
    return f"""(SELECT '{c}' AS "column", count(*) AS n, sum(coalesce(abs((x-m)/nullif(sd,0))>3,false)::INT)::BIGINT AS zscore, sum((x<a-1.5*(b-a) OR x>b+1.5*(b-a))::INT)::BIGINT AS iqr,
 sum(coalesce(abs(0.6745::DOUBLE*(x-md)/nullif(mad,0))>3.5,false)::INT)::BIGINT AS modified_zscore FROM (SELECT {c} AS x FROM rets WHERE {c} IS NOT NULL),
 (SELECT avg({c}) AS m, stddev_pop({c}) AS sd, quantile_cont({c},0.25) AS a, quantile_cont({c},0.5) AS md, quantile_cont({c},0.75) AS b FROM rets),
 (SELECT quantile_cont(abs({c}-z),0.5) AS mad FROM rets, (SELECT quantile_cont({c},0.5) AS z FROM rets)))"""


@query("dq_outliers", f"""WITH u AS ({_oc('ret')} UNION ALL {_oc('close')}) SELECT *, R(greatest(zscore,iqr,modified_zscore)::DOUBLE/n) AS share, CASE WHEN greatest(zscore,iqr,modified_zscore)::DOUBLE/n>0.05 THEN 'WARNING' ELSE 'PASS' END AS status FROM u""")
def dq_outliers(sp, sf):
    r = d.rets(sp, sf)
    return q.outlier_counts(r, "ret").unionByName(q.outlier_counts(r, "close"))


@query("dq_price_anomalies", """WITH a AS (SELECT symbol, close, close/nullif(lag(close) OVER (PARTITION BY symbol ORDER BY date),0) AS r FROM bars)
 SELECT symbol, sum(coalesce(abs(r-1)>0.5,false)::INT)::BIGINT AS extreme_moves, sum((close<=0)::INT)::BIGINT AS non_positive, sum(coalesce(r>2 OR r<0.5,false)::INT)::BIGINT AS ratio_breaks FROM a GROUP BY symbol""")
def dq_price_anomalies(sp, sf):
    return q.price_anomalies(d.bars(sp, sf))


@query("dq_volume_anomalies", """WITH a AS (SELECT symbol, volume-1 AS v, date FROM bars), b AS (SELECT *, CASE WHEN count(v) OVER w=20 THEN avg(v) OVER w END AS m FROM a WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING))
 SELECT symbol, sum((v=0)::INT)::BIGINT AS zero, sum((v<0)::INT)::BIGINT AS negative, sum(coalesce(v>10*m,false)::INT)::BIGINT AS spikes FROM b GROUP BY symbol""")
def dq_volume_anomalies(sp, sf):
    return q.volume_anomalies(d.bars(sp, sf).withColumn("volume", F.col("volume") - 1))


@query("dq_continuity", """WITH a AS (SELECT symbol, date, date_diff('day', lag(date) OVER (PARTITION BY symbol ORDER BY date), date) AS g FROM bars),
 b AS (SELECT symbol, min(date) AS lo, max(date) AS hi, sum((isodow(date)<6)::INT) AS have, sum(coalesce(g>7,false)::INT)::BIGINT AS gaps, max(g)::INT AS largest_gap FROM a GROUP BY symbol)
 SELECT symbol, (len(list_filter(generate_series(lo,hi,INTERVAL 1 DAY), lambda d: isodow(d)<6))-have)::BIGINT AS missing_days, gaps, largest_gap FROM b""")
def dq_continuity(sp, sf):
    return q.continuity(d.bars(sp, sf))


@query("dq_duplicates", """WITH a AS (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber), b AS (SELECT c FROM (SELECT *, count(*) AS c FROM lineitem GROUP BY ALL))
 SELECT (SELECT sum(c-1)::BIGINT FROM a) AS duplicate_keys, (SELECT sum(c-1)::BIGINT FROM b) AS duplicate_rows""")
def dq_duplicates(sp, sf):
    li = d.table(sp, sf, "lineitem")
    keys = ["l_orderkey", "l_linenumber"]
    return q.duplicates(li, keys, [c for c in li.columns if c not in keys])


@query("dq_dates", """WITH a AS (SELECT o_custkey AS symbol, o_orderdate AS date, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders)
 SELECT symbol, sum(coalesce(date<p,false)::INT)::BIGINT AS unsorted, sum((date>TIMESTAMP '2001-01-01')::INT)::BIGINT AS future, sum((year(date)<1900)::INT)::BIGINT AS ancient FROM a GROUP BY symbol""")
def dq_dates(sp, sf):
    o = d.table(sp, sf, "orders").select(F.col("o_custkey").alias("symbol"), F.col("o_orderdate").alias("date"), F.col("o_orderkey").alias("seq"))
    return q.dates(o, now="2001-01-01", span=1000)


@query("dq_business_rules", """WITH f AS (SELECT net_income/nullif(revenue,0) AS net_margin, price*shares/nullif(net_income,0) AS pe_ratio FROM fund)
 SELECT (SELECT sum((high<low)::INT)::BIGINT FROM bars) AS high_below_low, (SELECT sum((adj_close>high OR adj_close<low)::INT)::BIGINT FROM bars) AS close_outside, (SELECT sum((open>high OR open<low)::INT)::BIGINT FROM bars) AS open_outside,
 (SELECT sum(coalesce(abs(net_margin)>10,false)::INT)::BIGINT FROM f) AS net_margin_outside, (SELECT sum(coalesce(abs(pe_ratio)>10,false)::INT)::BIGINT FROM f) AS pe_ratio_outside,
 (SELECT sum(coalesce(urgent< -10 OR urgent>50,false)::INT)::BIGINT FROM macro_wide) AS urgent_outside""")
def dq_business_rules(sp, sf):
    m = q.business_rules(d.bars(sp, sf).withColumn("close", F.col("adj_close")), "market")
    r = fu.ratio_columns()
    f = q.business_rules(d.fundamentals(sp, sf).select(r["net_margin"].alias("net_margin"), r["pe_ratio"].alias("pe_ratio")), "fundamental")
    x = q.business_rules(d.macro_wide(sp, sf).select("date", "urgent"), "macro")
    return attach(attach(m, f), x)


@query("dq_summary", """WITH r AS (SELECT 'bars' AS dataset, CASE WHEN (SELECT max(c) FROM (SELECT count(*) AS c FROM bars GROUP BY symbol, date))>1 THEN 'FAIL' ELSE 'PASS' END AS status
 UNION ALL SELECT 'bars', CASE WHEN (SELECT count(*)-count(close) FROM cal)::DOUBLE/(SELECT count(*) FROM cal)>0.05 THEN 'WARNING' ELSE 'PASS' END
 UNION ALL SELECT 'orders', CASE WHEN (SELECT sum((o_totalprice<=0)::INT) FROM orders)>0 THEN 'FAIL' ELSE 'PASS' END)
 SELECT dataset, count(*) AS rules, sum((status='PASS')::INT)::BIGINT AS pass, sum((status='WARNING')::INT)::BIGINT AS warning, sum((status='FAIL')::INT)::BIGINT AS fail,
 CASE WHEN max((status='FAIL')::INT)=1 THEN 'FAIL' WHEN max((status='WARNING')::INT)=1 THEN 'WARNING' ELSE 'PASS' END AS overall FROM r GROUP BY dataset""")
def dq_summary(sp, sf):
    b = d.bars(sp, sf)
    dup = q.duplicates(b.select("symbol", "date", "close"), ["symbol", "date"], ["close"])
    mis = q.missing(d.calendar_bars(sp, sf), ["close"]).where(F.col("column") == "close")
    neg = d.table(sp, sf, "orders").agg(F.sum((F.col("o_totalprice") <= 0).cast("long")).alias("n"))
    rules = [q.rule_row(dup, "bars", "duplicates", F.when(F.col("duplicate_keys") > 0, q.FAIL).otherwise(q.PASS), F.col("duplicate_keys")),
             q.rule_row(mis, "bars", "missing", F.col("status"), F.col("share")),
             q.rule_row(neg, "orders", "positive", F.when(F.col("n") > 0, q.FAIL).otherwise(q.PASS), F.col("n"))]
    return q.summary(reduce(lambda a, b_: a.unionByName(b_), rules))


@query("dq_profile", """WITH p AS (SELECT symbol, date, count(*) AS r, sum((open IS NULL)::INT)+sum((high IS NULL)::INT)+sum((low IS NULL)::INT)+sum((close IS NULL)::INT)+sum((volume IS NULL)::INT) AS m, sum(coalesce(open<0,false)::INT)+sum(coalesce(high<0,false)::INT)+sum(coalesce(low<0,false)::INT)+sum(coalesce(close<0,false)::INT)+sum(coalesce(volume<0,false)::INT) AS n, sum(coalesce(volume=0,false)::INT) AS z FROM cal GROUP BY ALL)
 SELECT symbol, sum(r)::BIGINT AS rows, sum(m)::BIGINT AS missing, 0::BIGINT AS infinite, sum(n)::BIGINT AS negative, sum(z)::BIGINT AS zero_volume, sum(r-1)::BIGINT AS duplicate_dates, min(date) AS first_date, max(date) AS last_date FROM p GROUP BY symbol""")
def dq_profile(sp, sf):
    return q.profile(d.calendar_bars(sp, sf), ["open", "high", "low", "close", "volume"])


_OF = """a AS (SELECT symbol, date, close, avg(close) OVER w AS m, stddev_pop(close) OVER w AS sp, stddev_samp(close) OVER w AS ss, quantile_cont(close,0.25) OVER w AS q1, quantile_cont(close,0.5) OVER w AS md, quantile_cont(close,0.75) OVER w AS q3,
  quantile_cont(close,0.01) OVER w AS lo, quantile_cont(close,0.99) OVER w AS hi FROM bars WINDOW w AS (PARTITION BY symbol)),
 b AS (SELECT *, quantile_cont(abs(close-md),0.5) OVER (PARTITION BY symbol) AS mad FROM a),
 f AS (SELECT *, coalesce(abs((close-m)/nullif(sp,0))>3,false) AS fz, close<q1-1.5*(q3-q1) OR close>q3+1.5*(q3-q1) AS fi, coalesce(abs(0.6745::DOUBLE*(close-md)/nullif(mad,0))>3.5,false) AS fm FROM b)"""


@query("outlier_flag", f"WITH {_OF} SELECT symbol, date, fz AS zscore, fi AS iqr, fm AS modified FROM f")
def outlier_flag(sp, sf):
    df = d.bars(sp, sf).select("symbol", "date", "close")
    for m, n in (("zscore", "zscore"), ("iqr", "iqr"), ("modified_zscore", "modified")):
        df = q.flag(df, ["close"], m).withColumnRenamed("close_outlier", n)
    return df.drop("close")


@query("outlier_treat", f"WITH {_OF} SELECT symbol, date, R(CASE WHEN fi THEN greatest(lo,least(hi,close)) ELSE close END) AS winsorized, R(CASE WHEN fi THEN greatest(m-3*ss,least(m+3*ss,close)) ELSE close END) AS capped, R(CASE WHEN NOT fi THEN close END) AS removed FROM f", 5)
def outlier_treat(sp, sf):
    df = q.flag(d.bars(sp, sf).select("symbol", "date", "close"), ["close"], "iqr")
    df = df.withColumns({n: F.col("close") for n in ("winsorized", "capped", "removed")}
                        | {f"{n}_outlier": F.col("close_outlier") for n in ("winsorized", "capped", "removed")})
    for n, m in (("winsorized", "winsorize"), ("capped", "cap"), ("removed", "remove")):
        df = q.treat(df, [n], m)
    return df.select("symbol", "date", "winsorized", "capped", "removed")
