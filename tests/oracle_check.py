"""Run registered queries against their DuckDB SQL: python tests/oracle_check.py [-m module] [names...]"""
from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(pdf):
    import pandas as pd
    pdf = pdf[sorted(pdf.columns)].copy()
    for col in pdf.columns:
        s = pdf[col]
        if str(s.dtype).startswith("datetime"):
            pdf[col] = s.astype("datetime64[us]").astype(str)
        elif s.dtype == object:
            pdf[col] = s.map(lambda v: repr(list(v)) if hasattr(v, "__iter__") and not isinstance(v, (str, dict)) else v)
        elif pd.api.types.is_bool_dtype(s):
            pdf[col] = s.astype(object)
    return pdf


def compare(a, b):
    """Empty string when equal, else a short reason. Values must match exactly."""
    import numpy as np
    import pandas as pd
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} != {sorted(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    a, b = canonical(a), canonical(b)
    kinds = lambda d: [("f" if pd.api.types.is_float_dtype(t) else "i" if pd.api.types.is_integer_dtype(t) else "o") for t in d.dtypes]
    note = "" if kinds(a) == kinds(b) else f"dtype {dict(a.dtypes)} vs {dict(b.dtypes)} "
    order = [c for c in a.columns if a[c].dtype == object] + [c for c in a.columns if a[c].dtype != object]
    key = lambda d: d.sort_values(order, key=lambda s: s.astype(str) if s.dtype == object else s, kind="stable").reset_index(drop=True)
    try:
        a, b = key(a), key(b)
    except Exception as e:
        return f"sort {e}"
    bad = []
    for c in a.columns:
        if a[c].dtype == object or b[c].dtype == object:
            x, y = a[c].astype(str).replace({"None": "nan", "NaT": "nan", "<NA>": "nan"}), b[c].astype(str).replace({"None": "nan", "NaT": "nan", "<NA>": "nan"})
            d = (x != y)
            if d.any():
                i = int(np.argmax(d.values)); bad.append(f"{c}: {int(d.sum())} e.g. {x[i]!r} / {y[i]!r}")
        else:
            x, y = a[c].astype(float).values, b[c].astype(float).values
            d = ~((x == y) | (np.isnan(x) & np.isnan(y)))
            if d.any():
                i = int(np.argmax(d)); bad.append(f"{c}: {int(d.sum())} maxdiff {np.nanmax(np.abs(x - y)):.3g} e.g. {x[i]!r} / {y[i]!r}")
    return note + "; ".join(bad)


def main(argv):
    import __spark_entry__ as entry
    from tidepanel.core.session import build_session
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    from tidepanel.plans import registry
    names = []
    if argv and argv[0] == "-m":
        import importlib
        only = [a for a in argv[1:] if not a.startswith("cat_")]
        for m in [a for a in argv[1:] if a.startswith("cat_")]:
            before = set(registry.QUERIES)
            importlib.import_module(f"tidepanel.plans.{m}")
            names += [n for n in registry.QUERIES if n not in before]
        names = only or names
        qs, sqls = registry.QUERIES, registry.ORACLES
    else:
        qs, sqls = entry.queries(), entry.oracle_sql()
        names = argv or list(qs)
    spark = build_session("oracle-check", "local[8]", **{"spark.ui.showConsoleProgress": "false"})
    con = connect(sf)
    ok = fail = 0
    for n in names:
        t = time.time()
        try:
            got = qs[n](spark, sf).toPandas()
            dt = time.time() - t
            if n in sqls:
                t = time.time()
                want = con.execute(sqls[n]).df()
                msg = compare(got, want)
                dd = time.time() - t
            else:
                msg, dd = "", 0.0
        except Exception as e:
            msg, dt, dd = f"{type(e).__name__}: {str(e)[:600]}", time.time() - t, 0
            got = []
        ok, fail = (ok + 1, fail) if not msg else (ok, fail + 1)
        tag = "OK  " if not msg else "FAIL"
        if msg or dt > 4 or os.environ.get("V"):
            print(f"{tag} {n} rows={len(got)} spark={dt:.1f}s sql={dd:.1f}s {'' if n in sqls else '(no sql)'} {msg}", flush=True)
    print(f"{ok} ok, {fail} failed of {len(names)}")
    return 1 if fail else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
