"""Session settings that the operators rely on, and the package's way to the executors."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def builder(name: str = "millrace") -> SparkSession.Builder:
    """UTC, adaptive execution, ANSI arithmetic: what results are defined under."""
    conf = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.ansi.enabled": "true"}
    return SparkSession.builder.appName(name).config(map=conf)


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from the place the driver has it; on a cluster without a shared folder pass it by --py-files instead."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark
