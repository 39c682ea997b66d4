"""The Spark session that tests and the bench use; on a cluster, pass your own."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def get_spark(cpus: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session in UTC with adaptive execution; workers find this package through PYTHONPATH."""
    root = str(Path(__file__).resolve().parent.parent)
    os.environ["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([root, *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]))
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("candlewick").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
