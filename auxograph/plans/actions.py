"""Actions that run at once: their jobs share the cluster, each in a scheduler pool of its own.

With ``spark.scheduler.mode=FAIR`` the pools take turns; without it, jobs that come later get what the
earlier ones leave free.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

POOL = "spark.scheduler.pool"


@dataclass(frozen=True)
class Outcome:
    """What an action gave, or the error that it ended with."""

    value: Any = None
    error: Exception | None = None


def run_actions(spark: SparkSession, actions: Mapping[str, Callable[[], Any]], at_once: int = 4) -> dict[str, Outcome]:
    """Run every action, ``at_once`` at a time, and give their outcomes in the order of ``actions``.

    An action that fails stops none of the others. With ``at_once`` 1 they run one after the other, in the
    calling thread and its pool.
    """
    if at_once < 1:
        raise ValueError("at_once must be 1 at least")

    def outcome(do: Callable[[], Any]) -> Outcome:
        try:
            return Outcome(do())
        except Exception as error:  # noqa: BLE001  failures of any kind are reported with the others' results
            return Outcome(error=error)

    if at_once == 1:
        return {name: outcome(do) for name, do in actions.items()}

    def in_pool(name: str, do: Callable[[], Any]) -> Outcome:
        spark.sparkContext.setLocalProperty(POOL, name)
        try:
            return outcome(do)
        finally:
            spark.sparkContext.setLocalProperty(POOL, None)

    with ThreadPoolExecutor(at_once) as threads:
        started = {name: threads.submit(inheritable_thread_target(spark)(in_pool), name, do) for name, do in actions.items()}
    return {name: future.result() for name, future in started.items()}
