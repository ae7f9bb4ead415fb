"""Session settings that the library's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(master: str | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI and adaptive execution; everything else is the cluster's business."""
    builder = SparkSession.builder.appName("dayloom")
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true"} | conf
    return builder.config(map=settings).getOrCreate()
