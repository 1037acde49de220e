"""Online regime filter.

``advance`` folds one observation into a small fixed-size state. The same fold runs per
key over ordered rows of a table (batch) and inside keyed streaming state. Raw ticks are
reduced to calendar points first, so a key's sequence length depends on elapsed time only.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WINDOW, LEAST, REGIMES, DIM = 252, 10, 3, 6
FORGET, RATE, JITTER, ALERT = 0.95, 0.01, 1e-6, 0.8
# starting spread of the regimes around the first feature vector, and a sticky transition table
LEVELS = np.array([0.5, 1.0, 2.0])
TRANSITION = np.full((REGIMES, REGIMES), 0.05) + 0.85 * np.eye(REGIMES)

STATE = "last double, rets array<double>, vols array<double>, probs array<double>, mean array<double>, cov array<double>, seen bigint"
OUTPUT = ("symbol string, date timestamp, features array<double>, probs array<double>, regime int, max_change double, alert boolean, "
          "mean array<double>")


def features(rets, vols) -> np.ndarray:
    """Mean, deviation, skewness, kurtosis of returns, mean volume, mean absolute return of the buffer."""
    r = np.asarray(rets, float)
    n = len(r)
    d = r - r.mean()
    m2 = (d ** 2).mean()
    sk = ku = 0.0
    if m2 > 0:
        if n > 2:
            sk = (d ** 3).mean() / m2 ** 1.5 * math.sqrt(n * (n - 1)) / (n - 2)
        if n > 3:
            ku = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * ((d ** 4).mean() / m2 ** 2 - 3) + 6)
    return np.array([r.mean(), r.std(ddof=1), sk, ku, float(np.mean(vols)), np.abs(r).mean()])


def fresh() -> dict:
    return {"last": None, "rets": [], "vols": [], "probs": None, "mean": None, "cov": None, "seen": 0}


def _posterior(f, s) -> np.ndarray:
    logs = np.empty(REGIMES)
    for i in range(REGIMES):
        diff = f - s["mean"][i]
        sign, logdet = np.linalg.slogdet(s["cov"][i])
        logs[i] = -0.5 * (diff @ np.linalg.solve(s["cov"][i], diff) + logdet + DIM * math.log(2 * math.pi))
    w = np.exp(logs - logs.max()) * s["probs"]
    post = w / w.sum() if w.sum() > 0 else s["probs"]
    out = FORGET * (TRANSITION.T @ s["probs"]) + (1 - FORGET) * post
    return out / out.sum()


def advance(s: dict, price: float, volume: float) -> tuple[dict, dict | None]:
    """Fold one point; returns the new state and, once enough points are buffered, the result."""
    s = dict(s)
    if s["last"] is not None and s["last"] != 0:
        s["rets"] = [*s["rets"], price / s["last"] - 1][-WINDOW:]
        s["vols"] = [*s["vols"], volume][-WINDOW:]
    s["last"], s["seen"] = price, s["seen"] + 1
    if len(s["rets"]) < LEAST:
        return s, None
    f = features(s["rets"], s["vols"])
    if s["probs"] is None:
        new, change = np.full(REGIMES, 1.0 / REGIMES), 0.0
        spread = np.ones((REGIMES, DIM))
        spread[:, [1, 5]] = LEVELS[:, None]
        s["mean"], s["cov"] = f * spread, np.stack([np.eye(DIM) * 0.1] * REGIMES)
    else:
        new = _posterior(f, s)
        change = float(np.abs(new - s["probs"]).max())
        mean, cov = s["mean"].copy(), s["cov"].copy()
        for i in range(REGIMES):
            w = RATE * new[i]
            mean[i] = (1 - w) * mean[i] + w * f
            diff = f - mean[i]
            cov[i] = (1 - w) * cov[i] + w * np.outer(diff, diff) + JITTER * np.eye(DIM)
        s["mean"], s["cov"] = mean, cov
    s["probs"] = new
    return s, {"features": f.tolist(), "probs": new.tolist(), "regime": int(np.argmax(new)), "max_change": change,
               "alert": change > ALERT, "mean": s["mean"].ravel().tolist()}


def _fold(pdf: pd.DataFrame, s: dict) -> tuple[list[dict], dict]:
    out = []
    for sym, t, p, v in pdf.sort_values("date")[["symbol", "date", "price", "volume"]].itertuples(index=False):
        s, res = advance(s, p, v)
        if res is not None:
            out.append({"symbol": sym, "date": t, **res})
    return out, s


_COLUMNS = ["symbol", "date", "features", "probs", "regime", "max_change", "alert", "mean"]


def filter_batch(points: DataFrame) -> DataFrame:
    """The filter over a table of (symbol, date, price, volume) points."""
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_fold(pdf, fresh())[0], columns=_COLUMNS)

    return points.select("symbol", "date", "price", "volume").groupBy("symbol").applyInPandas(one, OUTPUT)


def _pack(s: dict) -> tuple:
    arr = lambda v: None if v is None else [float(x) for x in np.ravel(v)]
    return (s["last"], [float(x) for x in s["rets"]], [float(x) for x in s["vols"]], arr(s["probs"]), arr(s["mean"]), arr(s["cov"]), int(s["seen"]))


def _unpack(t: tuple) -> dict:
    last, rets, vols, probs, mean, cov, seen = t
    return {"last": last, "rets": list(rets), "vols": list(vols), "probs": None if probs is None else np.array(probs),
            "mean": None if mean is None else np.array(mean).reshape(REGIMES, DIM),
            "cov": None if cov is None else np.array(cov).reshape(REGIMES, DIM, DIM), "seen": seen}


def filter_stream(points: DataFrame, idle: str | None = None) -> DataFrame:
    """The filter on a stream of points; state per symbol is two 252-value buffers and the regime parameters.

    With ``idle`` (milliseconds as text) state of a silent symbol is dropped after that time.
    """
    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        s = _unpack(state.get) if state.exists else fresh()
        rows = pd.concat(list(batches))
        out, s = _fold(rows, s)
        state.update(_pack(s))
        if idle:
            state.setTimeoutDuration(int(idle))
        yield pd.DataFrame(out, columns=_COLUMNS)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return points.groupBy("symbol").applyInPandasWithState(update, OUTPUT, STATE, "append", timeout)
