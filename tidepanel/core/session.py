"""Session settings shared by tests, benchmark and applications."""
from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
_SPREAD: dict[str, str] = {}
#: Bytes of an Arrow batch on its way to or from a Python worker, unless the session sets its own.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Limit Arrow batches by bytes: by default only their rows are, so long texts make batches of any size in both processes."""
    for key in ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxBytesPerOutputBatch"):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(size))


#: Bytes of input for each partition that a shuffle starts with, and shuffled bytes up to which partitions are joined.
SPLIT_BYTES, JOINED_BYTES = 4 << 20, 16 << 20


def spread(spark: SparkSession, paths: list[str], split: int = SPLIT_BYTES) -> None:
    """Let shuffles start with a number of partitions that follows the input, unless the session sets its own; adaptive execution joins small ones again,
    up to a size that leaves room for rows that shuffle much smaller than they are in memory.

    With a fixed number, what a task sorts or aggregates grows with the table.
    """
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    joined = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if spark.conf.get(joined, None) is None:
        spark.conf.set(joined, str(JOINED_BYTES))
    app, now = spark.sparkContext.applicationId, spark.conf.get(key, None)
    if now is not None and now != _SPREAD.get(app):
        return
    size = 0
    for path in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(path):
            size += files.getContentSummary(path).getLength()
    _SPREAD[app] = str(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // split)))
    spark.conf.set(key, _SPREAD[app])


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, so that their workers can import it from any folder; batches to them are bounded."""
    bounded_batches(spark)
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "tidepanel.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def build_session(app: str = "tidepanel", master: str | None = None, **conf: str) -> SparkSession:
    """UTC session with adaptive execution.

    On a cluster the caller leaves ``master`` and shuffle partitions to
    spark-submit; locally one partition per core is enough.
    """
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if master:
        builder = builder.master(master)
        settings.update({
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("SPARK_DRIVER_MEMORY", "12g"),
            "spark.driver.host": "127.0.0.1",
            "spark.driver.bindAddress": "127.0.0.1",
            "spark.sql.shuffle.partitions": "8",
        })
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
