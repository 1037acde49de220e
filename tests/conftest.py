import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from tidepanel.core.session import build_session
    s = build_session("tests", "local[8]", **{"spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "4"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def bars_frame(spark, rows):
    """rows: (symbol, 'yyyy-mm-dd', open, high, low, close, volume)"""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, "symbol string, d string, open double, high double, low double, close double, volume double")
    return df.withColumn("date", F.col("d").cast("timestamp")).drop("d")


def walk(spark, n=120, symbols=("A", "B"), seed=1):
    """Random-walk bars on consecutive days."""
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(seed)
    out = []
    for s in symbols:
        c = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        o = c * (1 + rng.normal(0, 0.01, n))
        out.append(pd.DataFrame({"symbol": s, "date": pd.date_range("2020-01-01", periods=n), "open": o, "high": np.maximum(o, c) * 1.01,
                                 "low": np.minimum(o, c) * 0.99, "close": c, "volume": rng.integers(100, 1000, n).astype(float)}))
    pdf = pd.concat(out, ignore_index=True)
    return spark.createDataFrame(pdf), pdf
