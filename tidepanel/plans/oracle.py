"""Named DuckDB fragments for the domain tables; a query lists only its own body."""
from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "trades": """SELECT l_suppkey AS symbol, l_shipdate AS ts, l_extendedprice/l_quantity AS price,
      l_quantity AS quantity, l_discount AS discount, l_orderkey AS seq1, l_linenumber AS seq2 FROM lineitem""",
    "bars": """SELECT symbol, date_trunc('day', ts) AS date, first(price ORDER BY ts,seq1,seq2,price) AS open,
      max(price) AS high, min(price) AS low, last(price ORDER BY ts,seq1,seq2,price) AS close,
      sum(quantity) AS volume, last(price*(1-discount) ORDER BY ts,seq1,seq2,price) AS adj_close
      FROM trades GROUP BY ALL""",
    "bars_w": """SELECT symbol, date_trunc('week', date)::TIMESTAMP AS date, first(open ORDER BY date) AS open,
      max(high) AS high, min(low) AS low, last(close ORDER BY date) AS close, sum(volume) AS volume
      FROM (SELECT symbol, date AS date, open, high, low, close, volume FROM bars) GROUP BY symbol, date_trunc('week', date)""",
    "rets": """SELECT *, close/nullif(lag(close) OVER s,0)-1 AS ret, ln(close/nullif(lag(close) OVER s,0)) AS log_ret
      FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY date)""",
    "cal": """SELECT g.symbol, g.date, open, high, low, close, volume FROM
      (SELECT symbol, date FROM (SELECT DISTINCT symbol FROM bars), (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS date
        FROM (SELECT min(date) AS lo, max(date) AS hi FROM bars)) WHERE isodow(date)<6) g
      LEFT JOIN bars b ON b.symbol=g.symbol AND b.date=g.date""",
    "pord": """SELECT l_orderkey AS order_id, l_suppkey AS symbol, o_orderdate AS order_time, sum(l_quantity) AS quantity
      FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY ALL""",
    "sectors": """SELECT s_suppkey AS symbol, r_name AS sector, n_name AS industry FROM supplier
      JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey""",
    "idx0": """SELECT sector AS series, ts AS date, sum(price*quantity)/sum(quantity) AS close, sum(quantity) AS volume
      FROM trades JOIN sectors USING (symbol) GROUP BY ALL""",
    "idx": """SELECT *, close/nullif(lag(close) OVER s,0)-1 AS ret, ln(close/nullif(lag(close) OVER s,0)) AS log_ret
      FROM idx0 WINDOW s AS (PARTITION BY series ORDER BY date)""",
    "mkt0": "SELECT ts AS date, sum(price*quantity)/sum(quantity) AS close, sum(quantity) AS volume FROM trades GROUP BY ALL",
    "mkt": """SELECT *, close/nullif(lag(close) OVER s,0)-1 AS ret, ln(close/nullif(lag(close) OVER s,0)) AS log_ret
      FROM mkt0 WINDOW s AS (ORDER BY date)""",
    "macro": """SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS date, o_orderpriority AS indicator,
      sum(o_totalprice)/1e6 AS value FROM orders GROUP BY ALL""",
    "macro_wide": """SELECT date, max(CASE WHEN indicator='1-URGENT' THEN value END) AS urgent,
      max(CASE WHEN indicator='2-HIGH' THEN value END) AS high, max(CASE WHEN indicator='3-MEDIUM' THEN value END) AS medium,
      max(CASE WHEN indicator='4-NOT SPECIFIED' THEN value END) AS unspecified,
      max(CASE WHEN indicator='5-LOW' THEN value END) AS low FROM macro GROUP BY date""",
    "macro_fill": """SELECT date, last_value(urgent IGNORE NULLS) OVER w AS urgent, last_value(high IGNORE NULLS) OVER w AS high, last_value(medium IGNORE NULLS) OVER w AS medium, last_value(unspecified IGNORE NULLS) OVER w AS unspecified, last_value(low IGNORE NULLS) OVER w AS low
      FROM macro_wide WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)""",
    "ticks": "SELECT event_type AS symbol, ts, value AS price, 1.0::DOUBLE AS quantity, event_id, user_id FROM events",
    "points": """SELECT symbol, date_trunc('hour', ts)::TIMESTAMP AS date, avg(price) AS price, sum(quantity) AS volume
      FROM ticks GROUP BY ALL""",
    "wmonth": """SELECT symbol, date_trunc('month', date)::TIMESTAMP AS month, last(close ORDER BY date) AS close
      FROM bars GROUP BY ALL""",
    "wmom": """SELECT symbol, last_day(month)::TIMESTAMP AS date,
      close/lag(close) OVER (PARTITION BY symbol ORDER BY month)-1 AS mom FROM wmonth""",
    "weights": """SELECT symbol, date, CASE WHEN mom>0 THEN 1.3 ELSE -0.3 END::DOUBLE
      / count(*) OVER (PARTITION BY date, mom>0) AS weight FROM wmom WHERE mom IS NOT NULL""",
}

for _n, _src, _key in (("reg", "idx", "series"), ("mreg", "(SELECT *, 0 AS series FROM mkt)", "series")):
    VIEWS[f"{_n}0"] = f"""SELECT *, CASE WHEN count(ret) OVER w=20 THEN stddev_samp(ret) OVER w END AS vol FROM {_src}
      WINDOW w AS (PARTITION BY {_key} ORDER BY date ROWS 19 PRECEDING)"""
    VIEWS[f"{_n}1"] = f"""SELECT a.*, CASE WHEN vol>q2 THEN 2 WHEN vol>q1 THEN 1 ELSE 0 END AS st FROM {_n}0 a JOIN
      (SELECT series, quantile_cont(vol,1.0::DOUBLE/3) AS q1, quantile_cont(vol,2.0::DOUBLE/3) AS q2 FROM {_n}0 GROUP BY series) q USING (series)"""
    VIEWS[f"{_n}2"] = f"""SELECT * EXCLUDE (st), avg((st=0)::INT) OVER c AS p0, avg((st=1)::INT) OVER c AS p1, avg((st=2)::INT) OVER c AS p2
      FROM {_n}1 WINDOW c AS (PARTITION BY series, vol IS NOT NULL ORDER BY date ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"""
    VIEWS[_n] = f"SELECT *, CASE WHEN p0>=p1 AND p0>=p2 THEN 0 WHEN p1>=p2 THEN 1 ELSE 2 END AS regime FROM {_n}2"

_LINES = """sum(e) AS revenue, sum(e*(1-d)) AS gross_profit, sum(e*(0.06::DOUBLE-d)) AS operating_income,
      sum(e*(0.05::DOUBLE-d)*(1-t)) AS net_income, sum(e*(0.09::DOUBLE-d)) AS ebitda, sum(e*t*0.1::DOUBLE) AS dividends, sum(e*(1+t)*2) AS total_assets, sum(e*(0.5::DOUBLE+d)) AS total_equity,
      sum(e*(0.4::DOUBLE+t)) AS current_assets, sum(e*(0.2::DOUBLE+d)) AS current_liabilities, sum(e*t) AS inventory,
      sum(e*d*0.5::DOUBLE) AS cash, sum(e*(0.3::DOUBLE+t-d)) AS total_debt,
      sum(e*(0.05::DOUBLE-d+t)) AS operating_cash_flow, sum(q) AS shares, last(e/q ORDER BY dt,k,n,e/q) AS price"""
for _name, _unit, _months in (("fund", "quarter", 3), ("fund_y", "year", 12)):
    VIEWS[_name] = f"""SELECT symbol, {_LINES},
      last_day((start + INTERVAL {_months - 1} MONTH)::DATE)::TIMESTAMP AS fiscal_date FROM
      (SELECT l_suppkey AS symbol, date_trunc('{_unit}', l_shipdate) AS start, l_shipdate AS dt, l_orderkey AS k,
       l_linenumber AS n, l_extendedprice AS e, l_discount AS d, l_tax AS t, l_quantity AS q FROM lineitem)
      GROUP BY symbol, start"""


def _rounding(text: str, digits: int) -> str:
    """Expand R(expr) / R4(expr) into a rounding call with the given digits."""
    while True:
        m = re.search(r"\bR(\d?)\(", text)
        if not m:
            return text
        depth, i = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(text[i], 0)
            i += 1
        inner, n = text[m.end():i - 1], int(m.group(1) or digits)
        text = f"{text[:m.start()]}(round(({inner})::DOUBLE + 3.7e-{n + 3}::DOUBLE, {n}) + 0.0::DOUBLE){text[i:]}"


def oracle(body: str, digits: int = 6) -> str:
    """Prefix a SELECT with the views it (transitively) mentions."""
    body = _rounding(body, digits)
    need: list[str] = []

    def visit(text: str):
        for name in VIEWS:
            if name not in need and re.search(rf"(?i)\b(from|join|,)\s+{name}\b", text):
                visit(VIEWS[name])
                if name not in need:
                    need.append(name)

    visit(body)
    body = body.strip()
    own = body.upper().startswith("WITH ")
    if own:
        body = body[5:]
    recursive = ""
    if body.upper().startswith("RECURSIVE "):
        body, recursive = body[10:], "RECURSIVE "
    if not need:
        return ("WITH " + recursive if own else "") + body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in need)
    return f"WITH {recursive}{ctes}" + (",\n" if own else "\n") + body
