"""Scalar expression builders shared by all operators.

Everything here returns a ``Column``; nothing is evaluated on the driver.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A plain decimal number (optionally signed, optional exponent).  Spark's
# try_cast also accepts forms such as "1.0d", "1f" and "Infinity", which a
# pandas-style numeric coercion does not, so strings are guarded first.
PLAIN_NUMBER = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def col(name: str) -> Column:
    """Reference a column by its exact name (dots and spaces allowed)."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def is_categorical_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.BooleanType))


def is_datetime_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType))


def num_expr(name: str, dt: T.DataType) -> Column:
    """Coerce one column to double; anything not a number becomes NULL."""
    c = col(name)
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        x = c.cast("double")
        return F.when(~F.isnan(x), x)
    if isinstance(dt, T.NumericType) or isinstance(dt, T.BooleanType):
        return c.cast("double")
    if isinstance(dt, T.StringType):
        return F.when(c.rlike(PLAIN_NUMBER), F.trim(c).try_cast("double"))
    return F.lit(None).cast("double")


def num(df: DataFrame, name: str) -> Column:
    return num_expr(name, df.schema[name].dataType)


def row_mean(cells: list[Column]) -> Column:
    """Null-skipping mean across columns of one row (NULL when all are NULL)."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cells])
    count = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), 1).otherwise(0) for c in cells])
    return F.when(count > 0, total / count)


def clip(value: Column, low: float, high: float) -> Column:
    """The value within [low, high]; a null stays null (``least`` and ``greatest`` skip nulls)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def greatest_of(cols: list[Column]) -> Column:
    return cols[0] if len(cols) == 1 else F.greatest(*cols)


def scale_factor(max_value) -> float:
    """Multiplier that turns a score on a 0-1 / 0-20 / 0-100 scale into percent."""
    if max_value is None or max_value != max_value:
        return 1.0
    if max_value <= 1.5:
        return 100.0
    if max_value <= 20:
        return 5.0
    return 1.0


def pass_mark(max_value, ratio_aware: bool = True) -> float:
    """Pass threshold on the score's own scale (0.6 / 10 / 60)."""
    if max_value is None or max_value != max_value:
        return 60.0
    if ratio_aware and max_value <= 1.5:
        return 0.6
    if max_value <= 20:
        return 10.0
    return 60.0


_NAME_STRIP = re.compile(r"[ _/\-]")


def normalize_name(name: str, keep_slash: bool = False) -> str:
    """trim, lower, drop spaces, underscores, hyphens (and slashes)."""
    text = str(name).strip().lower()
    for ch in (" ", "_", "-") + (() if keep_slash else ("/",)):
        text = text.replace(ch, "")
    return text


def normalize_name_col(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "[ _/-]", "")


def r6(c: Column) -> Column:
    """Round a double to 6 decimals and fold -0.0 into 0.0 (stable value hashes)."""
    return F.round(c.cast("double"), 6) + F.lit(0.0)
