"""Queries for sorts, top-k and set operations."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.core.frames import corr, div, ordered
from tidepanel.operators import sets as s
from tidepanel.plans.registry import query
from tidepanel.sources import domain as d


@query("topk_features", """WITH a AS (SELECT ret, volume, ln(close) AS log_close, abs(ret) AS abs_ret, volume*close AS value, lead(ret) OVER (PARTITION BY series ORDER BY date) AS fwd FROM idx),
 l AS (SELECT unnest(['ret','volume','log_close','abs_ret','value']) AS feature, unnest([abs(corr(ret,fwd)), abs(corr(volume,fwd)), abs(corr(log_close,fwd)), abs(corr(abs_ret,fwd)), abs(corr(value,fwd))]) AS importance FROM a)
 SELECT feature, R(importance) AS importance FROM l ORDER BY importance DESC, feature LIMIT 3""")
def topk_features(sp, sf):
    x = d.index(sp, sf).withColumns({"log_close": F.log("close"), "abs_ret": F.abs("ret"), "value": F.col("volume") * F.col("close"),
                                     "fwd": F.lead("ret").over(ordered("series"))})
    names = ["ret", "volume", "log_close", "abs_ret", "value"]
    g = x.agg(*[F.abs(corr(n, "fwd")).alias(n) for n in names])
    long = g.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("importance")) for n in names])).alias("e")).select("e.*")
    return s.top(long, 3, F.col("importance").desc(), F.col("feature"))


@query("topk_positions", """WITH a AS (SELECT symbol, date, weight, row_number() OVER (PARTITION BY date ORDER BY abs(weight) DESC, symbol) AS rank FROM weights) SELECT symbol, date, R(weight) AS weight, rank::INT AS rank FROM a WHERE rank<=10""")
def topk_positions(sp, sf):
    return s.top_per_group(d.weights(sp, sf), ["date"], 10, [F.abs("weight").desc(), F.col("symbol")])


@query("topk_worst_days", "WITH a AS (SELECT date, avg(ret) AS ret FROM rets WHERE ret IS NOT NULL GROUP BY date), b AS (SELECT *, row_number() OVER (ORDER BY ret, date) AS rn FROM a) SELECT date, R(ret) AS ret, rn<=3 AS scenario FROM b WHERE rn<=10")
def topk_worst_days(sp, sf):
    m = d.rets(sp, sf).where("ret is not null").groupBy("date").agg(F.avg("ret").alias("ret"))
    t10 = s.top(m, 10, F.col("ret"), F.col("date"))
    # ten rows by construction: the rank needs no partitioning
    r = F.row_number().over(ordered("_k", "ret"))
    return t10.withColumn("_k", F.lit(0)).withColumn("scenario", r <= 3).drop("_k")


@query("sort_alpha_summary", "SELECT symbol, R(avg(ret)) AS mean, R(stddev_samp(ret)) AS vol, R(avg(ret)/(stddev_samp(ret)+1e-8)) AS sharpe FROM rets GROUP BY symbol ORDER BY avg(ret)/(stddev_samp(ret)+1e-8) DESC, symbol")
def sort_alpha_summary(sp, sf):
    g = d.rets(sp, sf).groupBy("symbol").agg(F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("vol"))
    return g.withColumn("sharpe", F.col("mean") / (F.col("vol") + 1e-8)).orderBy(F.col("sharpe").desc(), "symbol")


@query("tail_lookback", "WITH a AS (SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS r FROM bars) SELECT symbol, date, R(close) AS close FROM a WHERE r<=63")
def tail_lookback(sp, sf):
    return s.tail(d.bars(sp, sf).select("symbol", "date", "close"), 63)


@query("union_symbols", "SELECT symbol, date, R(close) AS close, R(high) AS high FROM bars_w UNION ALL SELECT symbol, date, R(close), NULL FROM bars")
def union_symbols(sp, sf):
    return s.stack([d.bars_w(sp, sf).select("symbol", "date", "close", "high"), d.bars(sp, sf).select("symbol", "date", "close")])


@query("union_dates", "SELECT DISTINCT date FROM (SELECT date FROM mkt UNION SELECT date FROM bars_w)")
def union_dates(sp, sf):
    return s.union_dates([d.market(sp, sf), d.bars_w(sp, sf)])


@query("intersect_dates", "SELECT date FROM mkt INTERSECT SELECT o_orderdate FROM orders")
def intersect_dates(sp, sf):
    return s.intersect_dates([d.market(sp, sf), d.table(sp, sf, "orders").select(F.col("o_orderdate").alias("date"))])


@query("intersect_symbols", "WITH a AS (SELECT DISTINCT symbol FROM weights UNION ALL SELECT DISTINCT symbol FROM fund UNION ALL SELECT symbol FROM sectors) SELECT symbol, count(*) AS datasets, count(*)=3 AS common FROM a GROUP BY symbol")
def intersect_symbols(sp, sf):
    return s.symbol_overlap([d.weights(sp, sf), d.fundamentals(sp, sf), d.sectors(sp, sf)])


@query("except_features", """WITH a AS (SELECT symbol, year(date)::INT AS year, list_sort(list_distinct(list(month(date)::INT))) AS m FROM bars GROUP BY ALL),
 b AS (SELECT symbol, year, m, lag(m) OVER (PARTITION BY symbol ORDER BY year) AS p FROM a)
 SELECT symbol, year, array_to_string(list_sort(list_filter(m, lambda x: NOT list_contains(p,x))),',') AS added, array_to_string(list_sort(list_filter(p, lambda x: NOT list_contains(m,x))),',') AS removed,
 (len(list_filter(m, lambda x: NOT list_contains(p,x)))+len(list_filter(p, lambda x: NOT list_contains(m,x))))::INT AS n_changed,
 R(len(list_filter(m, lambda x: list_contains(p,x)))::DOUBLE/len(list_distinct(list_concat(m,p)))) AS jaccard FROM b WHERE p IS NOT NULL""")
def except_features(sp, sf):
    a = d.bars(sp, sf).groupBy("symbol", F.year("date").alias("year")).agg(F.collect_set(F.month("date")).alias("m"))
    a = a.withColumn("p", F.lag("m").over(ordered("symbol", "year"))).where("p is not null")
    c = s.set_change(F.col("p"), F.col("m"))
    c["added"], c["removed"] = F.array_join(c["added"], ","), F.array_join(c["removed"], ",")
    return a.select("symbol", "year", *[e.alias(n) for n, e in c.items()])
