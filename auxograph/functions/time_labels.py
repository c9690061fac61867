"""Durations written as labels, such as ``3 h 15 min``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auxograph.functions.values import col

_LABEL = r"^\s*(?:(\d+)\s*h)?\s*(?:(\d+)\s*min)?\s*$"


def label_parts(label: str | Column) -> tuple[Column, Column, Column]:
    """(hours as double, whole hours, minutes) of a label; minutes carry over into hours.

    No-break and thin spaces count as spaces. Null is zero; what is no label gives nulls.
    """
    text = F.translate(col(label), "\u2009\xa0", "  ")
    matched = text.rlike(_LABEL)
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(text, _LABEL, i), F.lit("")).try_cast("int"), F.lit(0))
    minutes = part(1) * 60 + part(2)
    zero = F.when(text.isNull(), F.lit(0))
    whole = F.coalesce(zero, F.when(matched, F.floor(minutes / 60))).cast("int")
    rest = F.coalesce(zero, F.when(matched, minutes % 60)).cast("int")
    return whole + rest / F.lit(60.0), whole, rest


def with_time(df, label: str = "time_label"):
    """Add time_h, time_h_int, time_min_int and time_min."""
    hours, whole, rest = label_parts(label)
    return df.withColumns(
        {"time_h": hours, "time_h_int": whole, "time_min_int": rest, "time_min": F.round(hours * 60, 3)}
    )
