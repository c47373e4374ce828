"""Session helpers."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, whatever folder they start in.

    That is enough where executors see the driver's files (local mode, a shared installation); elsewhere the
    package comes with spark-submit's --py-files.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark
