"""A local session with the settings that the library's results assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local(cores: str = "*", partitions: int = 8, **more: str) -> SparkSession:
    conf = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.ansi.enabled": "true",
        "spark.ui.enabled": "false",
    }
    return SparkSession.builder.master(f"local[{cores}]").config(map=conf | more).getOrCreate()
