"""Registered runs of the single-operator plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from starmill.operators import aggregates, joining, scalars
from starmill.sources.star import Star


def operator_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plans = scalars.PLANS | joining.PLANS | aggregates.PLANS

    def run(plan: Callable[[Star], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, path: plan(Star(spark, path, idle_customers=True))

    return {name: run(plan) for name, plan in plans.items()}
