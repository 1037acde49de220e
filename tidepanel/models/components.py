"""Principal components of a panel in long form, for any number of assets.

Block subspace iteration: a block of orthonormal vectors with one row per asset is multiplied by the returns and by their transpose, each a join and a
grouped sum over the long table. Only block-by-block products (a few hundred figures) reach the driver. There is no column per asset, and no list of
assets outside the cluster.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tidepanel.core.frames import attach
from tidepanel.core.scratch import materialise

#: Vectors of the block; a universe of no more assets is solved exactly by the first product.
BLOCK, ROUNDS, TOLERANCE = 32, 60, 1e-9


def _line(names: list[str], weights) -> Column:
    out = F.lit(0.0)
    for n, w in zip(names, weights, strict=True):
        out = out + F.col(n) * float(w)
    return out


def _gram(df: DataFrame, names: list[str]) -> np.ndarray:
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    row = df.agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"g{i}_{j}") for i, j in pairs]).first()
    g = np.zeros((len(names), len(names)))
    for (i, j), v in zip(pairs, row, strict=True):
        g[i, j] = g[j, i] = v or 0.0
    return g


def _orthonormal(g: np.ndarray) -> np.ndarray:
    """Weights of an orthonormal basis of vectors with product table ``g``; directions without extent are left out."""
    value, vector = np.linalg.eigh(g)
    keep = value > max(value.max(), 0) * 1e-13
    return vector[:, keep] / np.sqrt(value[keep])


def principal_components(returns: DataFrame, k: int = 3, asset: str = "asset", time: str = "date", value: str = "ret", block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """(asset, factor, exposure, explained, specific_var) of returns standardised per asset (sample deviation, a missing return counts as 0).

    ``explained`` is the factor's share of variance, ``specific_var`` the sample variance of what the k factors leave; signs are fixed by the
    largest exposure. Assets without spread have exposure 0. Stops when the k shares change by less than TOLERANCE a round.
    """
    rows = materialise(returns.where(F.col(value).isNotNull()).groupBy(F.col(asset).alias("asset"), F.col(time).alias("time")).agg(F.first(F.col(value).cast("double")).alias("r")), "returns")
    dates = materialise(returns.select(F.col(time).alias("time")).distinct(), "dates")
    t = dates.count()
    known = returns.select(F.col(asset).alias("asset")).distinct()
    stats = known.join(rows.groupBy("asset").agg(F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q")), "asset", "left").na.fill(0.0, ["s", "q"])
    spread = F.sqrt(F.greatest((F.col("q") - F.col("s") * F.col("s") / t) / max(t - 1, 1), F.lit(0.0)))
    stats = stats.select("asset", (F.col("s") / max(t, 1)).alias("m"), F.when(spread > 1e-12, 1 / spread).otherwise(0.0).alias("inv"))
    noise = [(F.xxhash64("asset", F.lit(j)) / float(1 << 63)) for j in range(block)]
    stats = materialise(stats, "stats")
    n = stats.count()
    width = min(block, max(n, 1))
    names = [f"v{j}" for j in range(width)]
    basis = materialise(stats.select("*", *[noise[j].alias(v) for j, v in enumerate(names)]), "basis")
    total = float(stats.where("inv > 0").count())
    before = None

    def scores(basis: DataFrame, names: list[str]) -> DataFrame:
        """Standardised returns times the block: one row per date."""
        inside = rows.join(basis.select("asset", *[(F.col(v) * F.col("inv")).alias(v) for v in names]), "asset")
        y = dates.join(inside.groupBy("time").agg(*[F.sum(F.col("r") * F.col(v)).alias(v) for v in names]), "time", "left").na.fill(0.0, names)
        shift = basis.agg(*[F.sum(F.col(v) * F.col("m") * F.col("inv")).alias(f"c_{v}") for v in names])
        return materialise(attach(y, shift).select("time", *[(F.col(v) - F.col(f"c_{v}")).alias(v) for v in names]), "scores")

    def back(y: DataFrame, names: list[str]) -> DataFrame:
        """The transposed product: one row per asset."""
        z = rows.join(y, "time").groupBy("asset").agg(*[F.sum(F.col("r") * F.col(v)).alias(v) for v in names])
        level = y.agg(*[F.sum(v).alias(f"c_{v}") for v in names])
        z = attach(stats.join(z, "asset", "left").na.fill(0.0, names), level)
        return materialise(z.select("asset", "m", "inv", *[((F.col(v) - F.col("m") * F.col(f"c_{v}")) * F.col("inv")).alias(v) for v in names]), "basis")

    for _ in range(rounds):
        w = _orthonormal(_gram(basis, names))
        basis = materialise(basis.select("asset", "m", "inv", *[_line(names, w[:, j]).alias(f"v{j}") for j in range(w.shape[1])]), "basis")
        names = [f"v{j}" for j in range(w.shape[1])]
        y = scores(basis, names)
        value_, turn = np.linalg.eigh(_gram(y, names))
        value_, turn = value_[::-1], turn[:, ::-1]
        share = value_[:k] / max(t - 1, 1) / max(total, 1.0)
        if before is not None and len(before) == len(share) and np.abs(share - before).max(initial=0) < TOLERANCE or width >= n and before is not None:
            break
        before = share
        basis = back(y, names)
    use = min(k, len(names))
    load = [f"f{j}" for j in range(use)]
    basis = basis.select("asset", "m", "inv", *[_line(names, turn[:, j]).alias(f) for j, f in enumerate(load)])
    ends = basis.agg(*[F.max_by(f, F.abs(F.col(f))).alias(f) for f in load]).first()
    sign = [1.0 if (e or 0.0) >= 0 else -1.0 for e in ends]
    basis = materialise(basis.select("asset", "m", "inv", *[(F.col(f) * s).alias(f) for f, s in zip(load, sign, strict=True)]), "loadings")
    # variance of what is left: of a standardised return, less the squared exposures times the factors' variances and cross terms
    y = scores(basis, load)
    z = back(y, load)
    g = _gram(y, load) / max(t - 1, 1)
    both = basis.select("asset", "inv", *load).join(z.select("asset", *[F.col(f).alias(f"z_{f}") for f in load]), "asset")
    cross = sum((F.col(f) * F.col(f"z_{f}") for f in load), F.lit(0.0)) / max(t - 1, 1)
    own = sum((F.col(a) * F.col(b) * float(g[i, j]) for i, a in enumerate(load) for j, b in enumerate(load)), F.lit(0.0))
    left = F.when(F.col("inv") > 0, 1.0).otherwise(0.0) - 2 * cross + own
    cells = F.array(*[F.struct(F.lit(j).alias("factor"), F.col(f).alias("exposure"), F.lit(float(share[j])).alias("explained")) for j, f in enumerate(load)])
    return both.select("asset", F.explode(cells).alias("c"), F.greatest(left, F.lit(0.0)).alias("specific_var")).select("asset", "c.*", "specific_var")
