"""Joins with checked cardinality, resolved duplicate columns, and lookups by either of two keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auxograph.functions.values import require
from auxograph.operators.ranking import ranked

def many_to_one(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """A join in which a key may come once on the right; a key that comes twice is an error."""
    doubled = right.groupBy(*on).count().where("count > 1").limit(5).collect()
    if doubled:
        raise ValueError(f"keys are not unique on the right: {', '.join(str(tuple(r[:-1])) for r in doubled)}")
    return left.join(right, list(on), how)


def smart_join(left: DataFrame, right: DataFrame, on: Sequence[str] = ("well",), how: str = "inner", differing: Sequence[str] | None = None) -> DataFrame:
    """Equi-join; a column that both sides have comes once if it agrees in all rows, else also as ``_right``.

    Null agrees with null, NaN with NaN. One aggregate over the joined rows, which reads the columns
    in question only, decides about all of them; ``differing`` names them instead, and no row is read.
    """
    require(left, on, "smart_join, left")
    require(right, on, "smart_join, right")
    both = [c for c in right.columns if c in left.columns and c not in on]
    joined = left.join(right.withColumnsRenamed({c: f"{c}_right" for c in both}), list(on), how)
    if not both:
        return joined
    if differing is None:
        agree = joined.agg(*[F.coalesce(F.bool_and(F.col(c).eqNullSafe(F.col(f"{c}_right"))), F.lit(True)).alias(c) for c in both]).first()
        differing = [c for c in both if not agree[c]]
    return joined.drop(*[f"{c}_right" for c in both if c not in differing])


def smart_join_drop_right(left: DataFrame, right: DataFrame, on: Sequence[str] = ("well",), how: str = "inner") -> DataFrame:
    """Equi-join that keeps the left side of columns that both sides have."""
    return left.join(right.drop(*[c for c in right.columns if c in left.columns and c not in on]), list(on), how)


def first_match(left: DataFrame, right: DataFrame, on: Sequence[str], order: Sequence[str | Column], how: str = "left") -> DataFrame:
    """Join each left row with the first of its matches on the right."""
    w = Window.partitionBy(*on).orderBy(*order)
    return left.join(right.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n"), list(on), how)


def top_by(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key, numbered from 1; rows beyond are dropped before the exchange."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key."""
    return top_by(df, keys, order, 1, "_n").drop("_n")


def last_wins(df: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """(key, value) with the last row's value of each key."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def by_either_key(left: DataFrame, key: str, right: DataFrame, keys: Sequence[str], order: Sequence[str], how: str = "inner") -> DataFrame:
    """Join where ``key`` equals any of the right side's ``keys``; each right row matches once.

    The right side is unpivoted to (key, row), so the join is an equi-join and not a nested loop.
    """
    tall = right.select("*", F.explode(F.array_distinct(F.array(*keys))).alias("_key")).where(F.col("_key").isNotNull() & (F.col("_key") != ""))
    return left.join(tall, left[key] == tall["_key"], how).drop("_key").orderBy(*order) if order else left.join(tall, left[key] == tall["_key"], how).drop("_key")


def missing_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The distinct keys of the left side that the right side lacks."""
    return left.select(key).where(F.col(key).isNotNull()).distinct().join(right.select(key).distinct(), key, "left_anti")


def paired_by_rank(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """Pair the n-th of one side with the n-th of the other; what is left over is dropped."""
    return ranked(left.select(left_key), [left_key]).join(ranked(right.select(right_key), [right_key]), "rank")


def union_by_name(*frames: DataFrame) -> DataFrame:
    """All rows; columns that a frame lacks are null in its rows."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
