"""Spark session settings the jobs are written against.

The jobs never hard-code a partition count: on a cluster the caller's
``spark.sql.shuffle.partitions`` holds and AQE coalesces small stages and
splits skewed join partitions at run time.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings every job assumes. AQE re-plans joins from run-time sizes: a join
# side is broadcast only when its measured (shuffle) size is under the
# adaptive threshold, and a skewed shuffle partition (one hot key) is split
# across several tasks. The static, plan-time threshold stays at Spark's
# 10 MiB default: it is judged from compressed file sizes, which can be far
# below the in-memory size, so it is not trusted with more.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    master: str = "local[8]",
    app_name: str = "salesloom",
    shuffle_partitions: int | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """Session for tests, the bench and local runs."""
    builder = SparkSession.builder.master(master).appName(app_name)
    settings = dict(RECOMMENDED_CONF)
    if shuffle_partitions is not None:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
