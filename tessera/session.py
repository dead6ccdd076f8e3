"""Session construction with the settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: What every operator assumes; none depends on the size of the data.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the package defaults; keyword arguments use ``__`` for the dots of a key."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()
