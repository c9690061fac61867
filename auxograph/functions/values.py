"""Null, NaN and ordering rules that all operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: str | Column) -> Column:
    """True for numbers; false for null, NaN and the infinities."""
    c = col(c).cast("double")
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def finite(c: str | Column) -> Column:
    """The value if it is finite, else null."""
    return F.when(is_finite(c), col(c).cast("double"))


def normalise(df: DataFrame) -> DataFrame:
    """NaN becomes null in all floating-point columns, so that aggregates skip it."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def number(c: str | Column) -> Column:
    """Text to double; what isn't a finite number is null."""
    return finite(F.trim(col(c).cast("string")).try_cast("double"))


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def strip(c: str | Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(col(c), r"^[\s\u00a0\u2009]+|[\s\u00a0\u2009]+$", "")


def no_blank(c: str | Column) -> Column:
    """The stripped text, or null if nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def extracted(c: str | Column, pattern: str) -> Column:
    """The first match of ``pattern`` as a whole, or null."""
    return F.nullif(F.regexp_extract(col(c).cast("string"), f"({pattern})", 1), F.lit(""))


def require(df: DataFrame, columns: Sequence[str], what: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing columns {', '.join(missing)}")


def known(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Those of ``columns`` that ``df`` has, in their order."""
    return [c for c in columns if c in df.columns]


def without_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with a null in a grouping column belong to no group."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df


def first_non_null(value: str, order: Column) -> Column:
    """Aggregate: the first non-null value by ``order``."""
    return F.min_by(F.col(value), F.when(F.col(value).isNotNull(), order))


def joined_distinct(c: str | Column, separator: str = ",") -> Column:
    """Aggregate: the distinct values in lexicographic order, as one text."""
    return F.array_join(F.array_sort(F.collect_set(col(c).cast("string"))), separator)


def suffix_removed(name: str, suffix: str | None) -> str:
    """``name`` without ``suffix`` at its end (and only there)."""
    return name[: -len(suffix)] if suffix and name.endswith(suffix) else name
