"""Window specs and the small expressions every operator is built from."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

KEY, TIME = "symbol", "date"
ANNUAL = 252


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ordered(key=KEY, time=TIME) -> WindowSpec:
    keys = [key] if isinstance(key, str) else list(key)
    return Window.partitionBy(*keys).orderBy(time)


def trailing(n: int, key=KEY, time=TIME) -> WindowSpec:
    """The last n rows, current row included."""
    return ordered(key, time).rowsBetween(-(n - 1), 0)


def expanding(key=KEY, time=TIME) -> WindowSpec:
    return ordered(key, time).rowsBetween(Window.unboundedPreceding, 0)


def ahead(key=KEY, time=TIME) -> WindowSpec:
    """Current row and everything later, written as a running frame over descending time:
    a frame that ends in UNBOUNDED FOLLOWING would be re-evaluated from scratch per row.
    The nearest later row is the *last* one of this frame."""
    keys = [key] if isinstance(key, str) else list(key)
    return Window.partitionBy(*keys).orderBy(F.col(time).desc()).rowsBetween(Window.unboundedPreceding, 0)


def whole(key=KEY) -> WindowSpec:
    keys = [key] if isinstance(key, str) else list(key)
    return Window.partitionBy(*keys)


def div(a, b) -> Column:
    """Null instead of an ANSI error when the divisor is zero."""
    b = c(b) if not isinstance(b, (int, float)) else F.lit(b)
    a = c(a) if not isinstance(a, (int, float)) else F.lit(a)
    return a / F.nullif(b, F.lit(0.0))


def full(n: int, x, value: Column, key=KEY, time=TIME, least: int | None = None) -> Column:
    """``value`` only where the trailing window holds enough non-null rows."""
    return F.when(F.count(c(x)).over(trailing(n, key, time)) >= (least or n), value)


def roll(fn, x, n: int, key=KEY, time=TIME, least: int | None = None) -> Column:
    """Rolling aggregate with the min_periods = window rule."""
    return full(n, x, fn(c(x)).over(trailing(n, key, time)), key, time, least)


def corr(x, y, w: WindowSpec | None = None) -> Column:
    """Correlation of the complete pairs; null instead of an ANSI error when either side is constant."""
    x, y = c(x), c(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    o = (lambda e: e.over(w)) if w is not None else (lambda e: e)
    return o(F.covar_pop(x, y)) / F.nullif(o(F.stddev_pop(x)) * o(F.stddev_pop(y)), F.lit(0.0))


def attach(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a single-row frame to every row as one scalar subquery: no join, no collect.

    The subquery runs once; more than one row is a runtime error, none gives nulls.
    """
    packed = row.select(F.struct(*[F.col(n) for n in row.columns]).alias("r")).scalar()
    tmp = "_row_" + "_".join(row.columns)[:40]
    out = df.withColumn(tmp, packed)
    return out.select(*df.columns, *[F.col(f"`{tmp}`.`{n}`").alias(n) for n in row.columns])


def moment(time, tie=None) -> Column:
    """One number that sorts like (time, tie) for a long ``tie``, null ties as 0.

    As it is a single fixed-width value, first and last of a group by it stay hash aggregations that combine before the shuffle.
    """
    at = F.unix_micros(c(time)).cast("decimal(18,0)") * F.lit(str(1 << 64)).cast("decimal(20,0)")
    tie = F.coalesce(c(tie).cast("long"), F.lit(0)) if tie is not None else F.lit(0)
    return (at + tie.cast("decimal(19,0)")).cast("decimal(38,0)")


def change(x, k: int = 1, key=KEY, time=TIME) -> Column:
    return div(x, F.lag(c(x), k).over(ordered(key, time))) - 1


def log_growth(x) -> Column:
    """log(1 + x), minus infinity for a loss of everything or more: wealth stays 0 from there on."""
    x = c(x)
    return F.when(x > -1, F.log1p(x)).when(x <= -1, F.lit(float("-inf")))


def no_inf(x) -> Column:
    """NaN and infinities become null."""
    x = c(x)
    return F.when(~(F.isnan(x) | (F.abs(x) == F.lit(float("inf")))), x)


def rounded(x: Column, digits: int) -> Column:
    """Round a double by arithmetic, halves away from zero, as DuckDB does; F.round turns every value into a decimal text and back.

    Beyond 2**52 units a double has nothing left to round.
    """
    unit = F.lit(10.0 ** digits)
    units = x * unit
    whole_units = F.when(F.abs(units) < F.lit(2.0 ** 52), F.signum(units) * F.floor(F.abs(units) + 0.5)).otherwise(units)
    return F.when(F.abs(units) < F.lit(float("inf")), whole_units / unit).otherwise(x)


def rnd(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double column; ``special`` overrides digits per column.

    Prices are short decimals, so means of a few of them hit exact decimal ties whose
    rounding would hang on summation order; a fixed offset far below the last digit
    moves every such tie to the same side.
    """
    cols = []
    for f in df.schema.fields:
        if f.dataType.simpleString() == "double":
            # adding 0.0 turns a rounded -0.0 into 0.0
            n = special.get(f.name, digits)
            cols.append((rounded(F.col(f.name) + F.lit(3.7 * 10.0 ** -(n + 3)), n) + 0.0).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
