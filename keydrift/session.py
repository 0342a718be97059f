"""Session settings the engine profits from."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# The JVM never compiles methods above this many bytes of bytecode, and Spark's own
# limit is far higher. Past it, running operators one by one is several times faster.
SMALL_METHODS = {"spark.sql.codegen.hugeMethodLimit": "8000"}

RECOMMENDED = {
    **SMALL_METHODS,
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


@contextmanager
def scoped_conf(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Change session settings for a while and put the previous ones back."""
    previous = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in previous.items():
            spark.conf.set(name, value)
