"""Row normalization and alignment of two sides' columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keydrift.functions.keys import named
from keydrift.functions.text import (
    clean_text,
    is_deleted,
    operation_code,
    sort_tidy_integers,
    sort_tidy_text,
    tidy_list,
)
from keydrift.options import DiffOptions


def drop_deleted(df: DataFrame, options: DiffOptions = DiffOptions()) -> DataFrame:
    """Rows whose operation code does not say deleted; all of them without such a column."""
    if options.op_column not in df.columns:
        return df
    return df.where(~is_deleted(named(options.op_column)))


def add_missing_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with every absent column of ``columns`` added as blank text."""
    absent = [c for c in columns if c not in df.columns]
    return df.select("*", *[F.lit("").alias(c) for c in absent])


def compared_columns(before: DataFrame, after: DataFrame, options: DiffOptions) -> list[str]:
    """The union of both sides' columns, in name order, without bookkeeping."""
    expected = (*options.list_columns, *options.text_list_columns, options.op_column)
    return sorted({*before.columns, *after.columns, *expected} - set(options.order_by))


# One step of normalization: the expression for a column's text, given its name.
Rule = Callable[[str, Column], Column]


def normalization_steps(options: DiffOptions) -> list[Rule]:
    """The rules that turn raw values into comparable text, to be applied in turn.

    First everything becomes clean text and the operation code gets its own rule,
    then lists become tidy, then they are sorted. Give each step a projection of
    its own: a later step uses its input several times, and Catalyst keeps apart
    projections whose merging would compute that again.
    """
    lists = set(options.list_columns)
    text_lists = set(options.text_list_columns) - lists
    separator = options.item_separator
    sort_items = sort_tidy_integers if options.strictness == "B" else sort_tidy_text

    def clean(name: str, value: Column) -> Column:
        return operation_code(value) if name == options.op_column else clean_text(value)

    def tidy(name: str, value: Column) -> Column:
        return tidy_list(value, separator) if name in lists | text_lists else value

    def ordered(name: str, value: Column) -> Column:
        if name in lists:
            return sort_items(value, separator)
        return sort_tidy_text(value, separator) if name in text_lists else value

    return [clean, tidy, ordered]


def normalize_rows(
    df: DataFrame, options: DiffOptions = DiffOptions(), columns: Sequence[str] | None = None
) -> DataFrame:
    """All rows of ``df`` in comparable form.

    Columns the options expect are added if absent; ``order_by`` columns pass
    through untouched.
    """
    if columns is None:
        columns = compared_columns(df, df, options)
    df = add_missing_columns(df, columns)
    kept = [named(c) for c in options.order_by if c in df.columns]
    for step in normalization_steps(options):
        df = df.select(*kept, *[step(c, named(c)).alias(c) for c in columns])
    return df


def with_key_parts(df: DataFrame, options: DiffOptions) -> tuple[DataFrame, list[Column]]:
    """The rows, and their key columns normalized, as everything that is compared."""
    slots = {k: f"_key_{i}" for i, k in enumerate(options.primary_keys)}
    df = df.select("*", *[named(k).alias(slot) for k, slot in slots.items()])
    for step in normalization_steps(options):
        df = df.withColumns({slot: step(k, F.col(slot)) for k, slot in slots.items()})
    return df, [F.col(slot).alias(k) for k, slot in slots.items()]
