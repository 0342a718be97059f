"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a longest run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """The number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data, ``spark.checkpoint.dir``, which a cluster must name.

    Only a local session may leave it unset and gets a temporary folder.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = context.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp()
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def durable(frame: DataFrame) -> DataFrame:
    """The same rows with the lineage cut, from files in the shared folder."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def replace(frame: DataFrame, **columns: Column) -> DataFrame:
    """The frame with these columns; a column of the same name, in any case, goes."""
    taken = {name.lower() for name in columns}
    kept = [F.col(f"`{name}`") for name in frame.columns if name.lower() not in taken]
    return frame.select(*kept, *(column.alias(name) for name, column in columns.items()))


def numbered(frame: DataFrame, name: str) -> DataFrame:
    """The rows with a number of their own, which tells rows with one id, or none, apart.

    They are written to the shared folder, so that a row has the same number whenever it is read.
    """
    place = f"{shared_folder(frame.sparkSession)}/numbered-{uuid.uuid4()}"
    frame.withColumn(name, F.monotonically_increasing_id()).write.parquet(place)
    return frame.sparkSession.read.parquet(place)


def free_name(frame: DataFrame, name: str) -> str:
    """A column name that the frame does not have, in any case."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name
