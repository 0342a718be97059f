"""Cutting lineage in a place that outlives executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _checkpoint_folder(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names, known to the context as well.

    Only a local session, where every task sees this machine's disk, may do
    without the setting.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="keydrift-checkpoints-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the checkpoint folder, for tables between two steps."""
    return f"{_checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, into the cluster's checkpoint folder, and read from there."""
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def stored(*frames: DataFrame) -> Iterator[list[DataFrame]]:
    """The same rows from files in the checkpoint folder, written once; the files go at the end.

    What is computed from these frames reads the columns it needs, and nothing is parsed again. Frames that cannot be
    computed or stored are given as they are, so that their error comes up where they are used.
    """
    spark, places = frames[0].sparkSession, []
    try:
        try:
            found = []
            for df in frames:
                places.append(shared_path(spark, "stored"))
                found.append(_written(df, places[-1]))
        except Exception:
            found = list(frames)
        yield found
    finally:
        for place in places:
            path = spark._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _written(df: DataFrame, place: str) -> DataFrame:
    """Columns are stored under their places, as files may not take every name, and structs are null only if they could be."""
    names = [f"c{i}" for i in range(len(df.columns))]
    df.toDF(*names).write.option("compression", "zstd").parquet(place)
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, df.schema)])

    def column(name: str, field: T.StructField) -> Column:
        if isinstance(field.dataType, T.StructType) and not field.nullable:
            return F.struct(*[F.col(name).getField(part).alias(part) for part in field.dataType.names])
        return F.col(name)

    rows = df.sparkSession.read.schema(schema).parquet(place)
    return rows.select(*[column(n, f).alias(f.name) for n, f in zip(names, df.schema)])
