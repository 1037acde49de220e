"""DuckDB text of the mixtures per series: fixed rounds of expectation and maximisation as a recursive query over two features."""
from __future__ import annotations

import math

from tidepanel.models.mixtures import RIDGE, ROUNDS, TINY

K = range(3)
LOWER = [(0, 0), (1, 0), (1, 1)]
NAMES = [n for c in K for n in (f"w{c}", f"m{c}_0", f"m{c}_1", *[f"v{c}_{i}_{j}" for i, j in LOWER], *[f"i{c}_{i}_{j}" for i, j in LOWER])]


def _maximise(rows: str) -> str:
    each = lambda make: ", ".join(make(c) for c in K)
    sums = each(lambda c: f"sum(r{c}) AS n{c}, sum(r{c}*x0) AS s{c}_0, sum(r{c}*x1) AS s{c}_1, sum(r{c}*x0*x0) AS s{c}_0_0, sum(r{c}*x1*x0) AS s{c}_1_0, sum(r{c}*x1*x1) AS s{c}_1_1")
    means = each(lambda c: f"n{c}/n AS w{c}, s{c}_0/(n{c}+{TINY}::DOUBLE) AS m{c}_0, s{c}_1/(n{c}+{TINY}::DOUBLE) AS m{c}_1")
    covs = each(lambda c: ", ".join(f"s{c}_{i}_{j}/(n{c}+{TINY}::DOUBLE)-m{c}_{i}*m{c}_{j}+{RIDGE if i == j else 0}::DOUBLE AS v{c}_{i}_{j}" for i, j in LOWER))
    roots = each(lambda c: f"sqrt(greatest(v{c}_0_0,{TINY}::DOUBLE)) AS l{c}_0_0, v{c}_1_0/sqrt(greatest(v{c}_0_0,{TINY}::DOUBLE)) AS l{c}_1_0")
    roots2 = each(lambda c: f"sqrt(greatest(v{c}_1_1-l{c}_1_0*l{c}_1_0,{TINY}::DOUBLE)) AS l{c}_1_1")
    inverse = each(lambda c: f"1/l{c}_0_0 AS i{c}_0_0, 1/l{c}_1_1 AS i{c}_1_1, -l{c}_1_0/l{c}_0_0/l{c}_1_1 AS i{c}_1_0")
    return (f"SELECT *, {inverse} FROM (SELECT *, {roots2} FROM (SELECT *, {roots} FROM (SELECT *, {covs} FROM (SELECT *, {means} FROM "
            f"(SELECT it, series, count(*) AS n, sum(ll) AS ll, {sums} FROM ({rows}) GROUP BY it, series)))))")


def _expect(source: str, keep: str) -> str:
    log = lambda c: (f"ln(greatest(w{c},1e-300::DOUBLE))+ln(i{c}_0_0)+ln(i{c}_1_1)-0.5::DOUBLE*(power(i{c}_0_0*(x0-m{c}_0),2)+power(i{c}_1_0*(x0-m{c}_0)+i{c}_1_1*(x1-m{c}_1),2)"
                     f"+{2 * math.log(2 * math.pi)!r}::DOUBLE) AS g{c}")
    tops = f"SELECT *, greatest(g0,g1,g2) AS top FROM (SELECT *, {', '.join(log(c) for c in K)} FROM ({source}))"
    return f"SELECT {keep}, e0/t AS r0, e1/t AS r1, e2/t AS r2, top+ln(t) AS ll FROM (SELECT *, e0+e1+e2 AS t FROM (SELECT *, {', '.join(f'exp(g{c}-top) AS e{c}' for c in K)} FROM ({tops})))"


def _ctes(source: str) -> str:
    start = ", ".join(f"CASE WHEN (x1>q1)::INT+(x1>q2)::INT={c} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS r{c}" for c in K)
    first = f"SELECT 0 AS it, series, x0, x1, {start}, 0.0::DOUBLE AS ll FROM gx JOIN (SELECT series, quantile_cont(x1,1.0::DOUBLE/3) AS q1, quantile_cont(x1,2.0::DOUBLE/3) AS q2 FROM gx GROUP BY series) USING (series)"
    cols = ", ".join(["it", "series", "n", "ll", *NAMES])
    joined = f"SELECT p.*, x0, x1 FROM pr p JOIN gx USING (series) WHERE it<{ROUNDS}"
    last = f"SELECT p.* EXCLUDE (ll), p.ll AS before, date, x0, x1 FROM pr p JOIN gx USING (series) WHERE it={ROUNDS}"
    order = "list_transform(list_sort([{'v': v0_0_0+v0_1_1, 'c': 0}, {'v': v1_0_0+v1_1_1, 'c': 1}, {'v': v2_0_0+v2_1_1, 'c': 2}]), lambda s: s.c)"
    return f"""gx AS MATERIALIZED (SELECT * FROM ({source}) WHERE x0 IS NOT NULL AND x1 IS NOT NULL),
 pr AS (SELECT {cols} FROM ({_maximise(first)}) UNION ALL SELECT it+1, {cols[4:]} FROM ({_maximise(_expect(joined, 'it, series, x0, x1'))})),
 gmm_rows AS MATERIALIZED ({_expect(last, 'series, date')}),
 gmm_order AS (SELECT *, {order} AS ord FROM pr WHERE it={ROUNDS})"""


#: Standardised returns and volatility per series, with their mixtures: gmm_rows (series, date, r0.., ll), gmm_order (parameters, ord).
MIXTURES = _ctes("""SELECT series, date, (ret-avg(ret) OVER w)/nullif(stddev_pop(ret) OVER w,0) AS x0, (vol-avg(vol) OVER w)/nullif(stddev_pop(vol) OVER w,0) AS x1
 FROM reg WHERE ret IS NOT NULL AND vol IS NOT NULL WINDOW w AS (PARTITION BY series)""")
#: Smoothed and normalised probabilities of the ordered components.
SMOOTHED = MIXTURES + """,
 gmm_probs AS (SELECT series, date, [r0,r1,r2][ord[1]+1] AS u0, [r0,r1,r2][ord[2]+1] AS u1, [r0,r1,r2][ord[3]+1] AS u2 FROM gmm_rows JOIN (SELECT series, ord FROM gmm_order) USING (series)),
 gmm_mean AS (SELECT series, date, avg(u0) OVER c AS s0, avg(u1) OVER c AS s1, avg(u2) OVER c AS s2 FROM gmm_probs WINDOW c AS (PARTITION BY series ORDER BY date ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
 gmm AS (SELECT series, date, s0/(s0+s1+s2) AS p0, s1/(s0+s1+s2) AS p1, s2/(s0+s1+s2) AS p2 FROM gmm_mean)"""
CRITERIA = MIXTURES + """,
 gmm_fit AS (SELECT series, sum(ll) AS log_likelihood, count(*) AS n_rows FROM gmm_rows GROUP BY series),
 gmm_parts AS (SELECT series, ll AS before, unnest([0,1,2]) AS component, unnest(list_transform(ord, lambda c: [[w0,m0_0,m0_1,v0_0_0,v0_1_0,v0_1_1],[w1,m1_0,m1_1,v1_0_0,v1_1_0,v1_1_1],[w2,m2_0,m2_1,v2_0_0,v2_1_0,v2_1_1]][c+1])) AS p FROM gmm_order),
 gmm_crit AS (SELECT series, component, p[1] AS weight, p[2] AS mean_0, p[3] AS mean_1, p[4] AS cov_00, p[5] AS cov_10, p[6] AS cov_11, 17 AS n_params, n_rows, log_likelihood, 34-2*log_likelihood AS aic, 17*ln(n_rows)-2*log_likelihood AS bic,
  abs(log_likelihood-before)<0.001::DOUBLE*n_rows AS converged FROM gmm_parts JOIN gmm_fit USING (series))"""
