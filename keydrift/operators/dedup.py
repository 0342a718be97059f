"""The last row of every key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keydrift.functions.keys import named


def last_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str] = ()) -> DataFrame:
    """One row per key: the greatest by ``order_by``, then by the other columns.

    A plain aggregate, so each task first reduces its own rows; a key that holds
    a large part of the table still sends only one row per task to the shuffle.
    Comparing the remaining columns last makes ties, and a missing ``order_by``,
    come out the same on every run.
    """
    rest = [c for c in df.columns if c not in keys and c not in order_by]
    row = F.struct(*[named(c) for c in (*order_by, *rest)])
    last = df.groupBy(*[named(k) for k in keys]).agg(F.max(row).alias("_last"))
    fields = [F.col("_last")[c].alias(c) for c in (*order_by, *rest)]
    return last.select(*[named(k) for k in keys], *fields).select(*[named(c) for c in df.columns])
