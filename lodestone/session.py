"""Session settings."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows and bytes of a batch that goes to a Python worker.
BATCH_ROWS, BATCH_BYTES = "1000", "16m"


def prepare(spark: SparkSession) -> SparkSession:
    """Settings that queries rely on, whoever made the session."""
    # Unions of frames that are partitioned alike may fail at run time when adaptive execution changes one of them.
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    # Texts may be long: a Python worker holds a batch, and what it makes of it, at once.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def local(app: str = "lodestone", cores: str = "*", **conf: str) -> SparkSession:
    """A session for one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())
