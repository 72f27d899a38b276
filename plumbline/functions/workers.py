"""What Python workers need to know of the driver."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: The folder that holds this package.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def find_package(spark: SparkSession) -> None:
    """Let workers find this package where the driver did; on a cluster it is installed or shipped there."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
