"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tenure.operators import features, survival
from tenure.plans import analytics, base, certificates, modeling, relational  # noqa: F401  (registration)
from tenure.plans.base import ORACLES, QUERIES, with_ctes  # noqa: F401


def oracles() -> dict[str, str]:
    return {name: with_ctes(body) for name, body in ORACLES.items()}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    tx = base.capped(spark, sf)
    return survival.km(survival.dataset(tx, features.observation_end(tx)))
