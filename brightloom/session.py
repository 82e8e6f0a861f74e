"""A local session for tests and the benchmark; on a cluster the caller brings its own."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, partitions: int | None = None, **conf: str) -> SparkSession:
    root = str(Path(__file__).resolve().parent.parent)
    if root not in os.environ.get("PYTHONPATH", "").split(os.pathsep):  # Python workers import the package too
        os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (root, os.environ.get("PYTHONPATH")) if x)
    settings = {
        "spark.sql.shuffle.partitions": str(partitions or cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        **conf,
    }
    spark = SparkSession.builder.master(f"local[{cores}]").appName("brightloom").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
