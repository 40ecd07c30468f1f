"""Run independent Spark actions at the same time, so their stages fill each other's gaps."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

MAX_JOBS = 6


def run_together(spark: SparkSession, *actions: Callable[[], Any]) -> list[Any]:
    """Results of the actions, in order; the first failure is raised."""
    if len(actions) < 2:
        return [action() for action in actions]
    inherit = inheritable_thread_target(spark)
    with ThreadPoolExecutor(max_workers=min(MAX_JOBS, len(actions))) as pool:
        futures = [pool.submit(inherit(action)) for action in actions]
        return [future.result() for future in futures]
