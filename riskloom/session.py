"""Session settings the library is tuned for. Everything is a plain Spark conf."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # top-k windows below this rank are cut before their shuffle
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000",
}


def build_session(name: str = "riskloom", master: str | None = None, **conf: str) -> SparkSession:
    """Create or reuse a session. On a cluster leave `master` to spark-submit."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for k, v in {**DEFAULTS, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
