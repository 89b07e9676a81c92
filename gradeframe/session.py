"""Session settings the library is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# The JVM only interprets methods above 8000 bytes of byte code. Long chains of
# text expressions fuse into such methods; with this limit Spark runs the chain
# operator by operator instead, each compiled in small pieces.
METHOD_LIMIT = ("spark.sql.codegen.hugeMethodLimit", "8000")

SETTINGS = {
    METHOD_LIMIT[0]: METHOD_LIMIT[1],
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the method limit to a session that has not chosen its own."""
    if spark.conf.get(METHOD_LIMIT[0], "65535") == "65535":
        spark.conf.set(*METHOD_LIMIT)
    return spark


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g",
                  name: str = "gradeframe", **extra: str) -> SparkSession:
    """A single-machine session for tests and benchmarks.

    On a cluster, create the session as usual and apply ``SETTINGS``; leave
    ``spark.sql.shuffle.partitions`` to the cluster, AQE coalesces from there.
    """
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName(name)
               .config("spark.ui.enabled", "false")
               .config("spark.driver.memory", memory)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
