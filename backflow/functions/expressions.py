"""Column expressions shared by the operators (all evaluated in the JVM)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

ID = "customer_emailid"


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` as double; NULL where the denominator is zero or NULL."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def or_zero(col: Column) -> Column:
    return F.coalesce(col, F.lit(0))


def flag(cond: Column) -> Column:
    """1 where the condition holds, else 0 (also for NULL)."""
    return F.when(cond, 1).otherwise(0)


def long_sum(col: Column) -> Column:
    return F.sum(col).cast("bigint")


def day_number(ts: Column) -> Column:
    """Calendar day as an integer, for bucketing and range frames."""
    return F.datediff(ts, F.lit("1970-01-01").cast("date"))


def calendar_days(start: Column, end: Column) -> Column:
    """Calendar-day boundaries crossed from ``start`` to ``end``."""
    return F.datediff(end, start).cast("bigint")


def whole_days(start: Column, end: Column) -> Column:
    """Complete 24-hour periods from ``start`` to ``end``, towards zero."""
    return F.timestamp_diff("DAY", start, end).cast("bigint")


def season(ts: Column) -> Column:
    month = F.month(ts)
    return (
        F.when(month.between(10, 12), "Fall")
        .when(month.between(1, 3), "Winter")
        .when(month.between(4, 6), "Spring")
        .otherwise("Summer")
    )


def banded(value: Column, bounds: list[tuple[float, object]], default: object) -> Column:
    """First label whose upper bound (inclusive) holds the value, else ``default``."""
    steps = [(value <= F.lit(limit), label) for limit, label in bounds]
    return first_match(steps, default)


def first_match(steps: list[tuple[Column, object]], default: object) -> Column:
    """CASE chain from (condition, value) pairs; values may be literals or columns."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    head, *rest = steps
    chain = F.when(head[0], as_col(head[1]))
    for cond, value in rest:
        chain = chain.when(cond, as_col(value))
    return chain.otherwise(as_col(default))


def guarded_corr(x: Column, y: Column) -> Column:
    """Pearson correlation, 0 where either side is constant.

    The built-in ``corr`` raises a division error under ANSI for a constant
    side, so the same value is taken from covariance and deviations.
    """
    x, y = x.cast("double"), y.cast("double")
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.coalesce(F.try_divide(F.covar_pop(x, y), spread), F.lit(0.0))


def joined_flags(flags: list[tuple[Column, str]], sep: str = ";") -> Column:
    """Names of all flags that hold, joined by ``sep``; '' when none does."""
    return F.concat_ws(sep, *[F.when(cond, F.lit(name)) for cond, name in flags])


def clean_email(col: Column) -> Column:
    return F.lower(F.trim(col))


def round_to(col: Column, digits: int) -> Column:
    """Round half away from zero on the scaled double, as numpy-style engines do."""
    step = float(10**digits)
    return F.round(col * step) / step


def rounded(df: DataFrame, digits: int = 6, only: list[str] | None = None) -> DataFrame:
    """Round every double column; -0.0 becomes 0.0."""
    names = only or [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({n: round_to(F.col(n), digits) + F.lit(0.0) for n in names})


def all_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def unpivot(df: DataFrame, keys: list[str], cols: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Long form (keys, feature, value) of numeric columns; NULLs are kept."""
    wide = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
    return wide.unpivot(keys, cols, name, value)


def with_row(df: DataFrame, row: DataFrame, name: str = "_row") -> DataFrame:
    """Attach a one-row frame to every row as struct ``name``.

    One uncorrelated scalar subquery, so the row is computed once and no join
    is planned; ``row`` must be a global aggregate.
    """
    return df.withColumn(name, row.select(F.struct(*row.columns)).scalar())
