"""A session with the settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

PINNED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(app: str = "metrika", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for k, v in {**PINNED, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
