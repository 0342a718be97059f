"""The diffs a user asks for, read off the ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keydrift.functions.keys import joined_key, named, require_columns
from keydrift.operators.ledgers import DELETE, INSERT, UPDATE, ledger, presence_ledger
from keydrift.operators.normalize import drop_deleted, with_key_parts
from keydrift.options import DiffOptions

DIFF_COLUMNS = ("key", "status", "changed_columns")

# How many copies of a diff row one task writes out before the next chunk starts.
REPEAT_CHUNK = 1 << 16


def expand(entries: DataFrame, ordered: bool = False) -> DataFrame:
    """The diff rows behind ledger entries, each repeated ``n_rows`` times.

    Repeats go out in chunks, which are dealt out (or sorted) before any row is
    repeated: however often one key repeats, its rows spread over many partitions.
    """
    wanted = entries.where(F.col("status").isNotNull())
    last_chunk = F.expr(f"(n_rows - 1) div {REPEAT_CHUNK}").cast("bigint")
    partitions = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = wanted.select(
        *DIFF_COLUMNS,
        "n_rows",
        F.explode(F.sequence(F.lit(0).cast("bigint"), last_chunk)).alias("_chunk"),
    )
    if ordered:
        chunks = chunks.orderBy("key", "status", "_chunk")
    else:
        chunks = chunks.repartition(partitions, "key", "status", "_chunk")
    left = F.col("n_rows") - F.col("_chunk") * REPEAT_CHUNK
    copies = F.array_repeat(F.lit(0), F.least(left, F.lit(REPEAT_CHUNK)).cast("int"))
    return chunks.select(*DIFF_COLUMNS, F.explode(copies).alias("_copy")).select(*DIFF_COLUMNS)


def diff(
    before: DataFrame,
    after: DataFrame,
    mode: str = "normalized",
    options: DiffOptions = DiffOptions(),
    ordered: bool = False,
) -> DataFrame:
    """The differing keys as ``key, status, changed_columns``; lazy, but for a count of keys in the normalized mode."""
    entries = ledger(before, after, mode, options)
    if mode != "normalized":
        return expand(entries, ordered)
    found = entries.where(F.col("status").isNotNull()).select(*DIFF_COLUMNS)
    return order_by_key(found) if ordered else found


def diff_counts(
    before: DataFrame, after: DataFrame, mode: str = "normalized", options: DiffOptions = DiffOptions()
) -> DataFrame:
    """The differing keys with ``n_rows`` in place of repeated rows."""
    entries = ledger(before, after, mode, options)
    return entries.where(F.col("status").isNotNull()).select(*DIFF_COLUMNS, "n_rows")


def order_by_key(found: DataFrame, stored: bool = False) -> DataFrame:
    """Diff rows in code-point order of their key.

    A sort reads its input twice, to sample it first. So that the diff is not computed twice its rows are dealt out before,
    unless they are ``stored``.
    """
    if not stored:
        found = found.repartition(*[named(c) for c in found.columns])
    return found.orderBy("key", "status")


def tally(entries: DataFrame) -> DataFrame:
    """Ledger entries with all keys that do not differ folded into one row.

    About as large as the diff, yet complete enough for all totals.
    """
    differs = F.col("status").isNotNull()
    return (
        entries.select(
            F.when(differs, F.col("key")).alias("key"),
            "status",
            "changed_columns",
            "n_rows",
            "rows_before",
            "rows_after",
        )
        .groupBy("key", "status", "changed_columns")
        .agg(
            F.sum("n_rows").alias("n_rows"),
            F.sum("rows_before").alias("rows_before"),
            F.sum("rows_after").alias("rows_after"),
        )
    )


def totals(entries: DataFrame) -> DataFrame:
    """One row: ``rows_before, rows_after, rows_diff`` of a ledger or a tally."""

    def total(column) -> Column:
        return F.coalesce(F.sum(column), F.lit(0).cast("bigint"))

    found = F.when(F.col("status").isNotNull(), F.col("n_rows"))
    return entries.agg(
        total("rows_before").alias("rows_before"),
        total("rows_after").alias("rows_after"),
        total(found).alias("rows_diff"),
    )


def row_counts(before: DataFrame, after: DataFrame, options: DiffOptions = DiffOptions()) -> DataFrame:
    """One row: ``rows_before, rows_after``, the live rows of each side; reads the operation only."""
    old = drop_deleted(before, options).select(F.lit(1).alias("b"), F.lit(0).alias("a"))
    new = drop_deleted(after, options).select(F.lit(0).alias("b"), F.lit(1).alias("a"))
    counted = old.union(new).agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    zero = F.lit(0).cast("bigint")
    return counted.select(F.coalesce("b", zero).alias("rows_before"), F.coalesce("a", zero).alias("rows_after"))


def diff_summary(entries: DataFrame) -> DataFrame:
    """Diff rows per status and set of changed columns."""
    return (
        entries.where(F.col("status").isNotNull())
        .groupBy("status", "changed_columns")
        .agg(F.sum("n_rows").alias("rows_diff"))
    )


def _by_presence(before, after, options: DiffOptions, status: str) -> DataFrame:
    return expand(presence_ledger(before, after, options).where(F.col("status") == status))


def inserted(before: DataFrame, after: DataFrame, options: DiffOptions = DiffOptions()) -> DataFrame:
    """After rows whose key is not in before."""
    return _by_presence(before, after, options, INSERT)


def deleted(before: DataFrame, after: DataFrame, options: DiffOptions = DiffOptions()) -> DataFrame:
    """Before rows whose key is not in after."""
    return _by_presence(before, after, options, DELETE)


def common(before: DataFrame, after: DataFrame, options: DiffOptions = DiffOptions()) -> DataFrame:
    """One row for each pair of a before and an after row with the same key."""
    return _by_presence(before, after, options, UPDATE)


def all_keys(before: DataFrame, after: DataFrame, options: DiffOptions = DiffOptions()) -> DataFrame:
    """The distinct normalized keys of the two sides together."""

    def keys(df: DataFrame, side: str) -> DataFrame:
        require_columns(df, options.primary_keys, side)
        rows, parts = with_key_parts(drop_deleted(df, options), options)
        return rows.select(joined_key(parts).alias("key"))

    return keys(before, "before").union(keys(after, "after")).distinct()
