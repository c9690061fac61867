"""Table functions: classes that take the rows of a group one by one, called from plans, DataFrames and SQL by one name.

A class has ``eval`` (a row of the table and the options), ``terminate`` (at the end of a group), and a static
``analyze`` that checks the arguments and says what columns come out, from those of the table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


class RisingRuns:
    """Runs of rows in which ``value`` never falls: series, run (from 1), n, first_value, last_value.

    Rows come in the order of the call, the rows of a series (column ``key``) as one group; rows without
    a value belong to no run.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, value: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("rising_runs needs a table")
        names = {f.name: f.dataType for f in rows.dataType.fields}
        if wrong := [a.value for a in (key, value) if a.value not in names]:
            raise ValueError(f"rising_runs: the table has no column {', '.join(map(str, wrong))}")
        columns = T.StructType().add("series", names[key.value]).add("run", T.IntegerType()).add("n", T.LongType())
        return AnalyzeResult(columns.add("first_value", T.DoubleType()).add("last_value", T.DoubleType()))

    def __init__(self) -> None:
        self.series, self.run, self.n, self.first, self.last = None, 0, 0, None, None

    def eval(self, rows: Row, key: str, value: str) -> Iterator[tuple]:
        now = rows[value]
        if now is None:
            return
        now = float(now)
        if self.n and not now >= self.last:
            yield self.series, self.run, self.n, self.first, self.last
            self.n = 0
        if not self.n:
            self.run, self.first = self.run + 1, now
        self.series, self.n, self.last = rows[key], self.n + 1, now

    def terminate(self) -> Iterator[tuple]:
        if self.n:
            yield self.series, self.run, self.n, self.first, self.last


TABLE_FUNCTIONS: dict[str, type] = {"rising_runs": RisingRuns}


def register_table_function(name: str, function: type) -> None:
    """Make a class known to plans; ``use_table_functions`` makes it known to the SQL of a session."""
    if not hasattr(function, "eval") or not hasattr(function, "analyze"):
        raise TypeError(f"{name}: a table function needs eval and analyze")
    TABLE_FUNCTIONS[name] = function


def use_table_functions(spark: SparkSession) -> None:
    for name, function in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, F.udtf(function))


def table_function(df: DataFrame, function: str, partition_by: Sequence[str], order_by: Sequence[str] = (), **options) -> DataFrame:
    """Call a table function on the rows of each group of ``partition_by``, in the order of ``order_by``."""
    if function not in TABLE_FUNCTIONS:
        raise ValueError(f"no table function {function!r}; there are {', '.join(sorted(TABLE_FUNCTIONS))}")
    table = df.asTable().partitionBy(*partition_by)
    table = table.orderBy(*order_by) if order_by else table
    return F.udtf(TABLE_FUNCTIONS[function])(table, **{k: F.lit(v) for k, v in options.items()})
