"""A Spark session for one machine: tests, the benchmark, trying things out."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """local[cpus]; on a cluster the session is the cluster's own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("tessera")
    given = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": memory,
        "spark.driver.host": "127.0.0.1",
        "spark.sql.adaptive.enabled": "true",
        "spark.local.dir": tempfile.mkdtemp(prefix="spark-"),
        "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="spark-"),
    } | conf
    for key, value in given.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
