"""DataFrame to DataFrame operators."""

from keydrift.operators.dedup import last_per_key
from keydrift.operators.diffs import (
    all_keys,
    common,
    deleted,
    diff,
    diff_counts,
    diff_summary,
    expand,
    inserted,
    order_by_key,
    row_counts,
    tally,
    totals,
)
from keydrift.operators.ledgers import LEDGERS, ledger
from keydrift.operators.normalize import add_missing_columns, drop_deleted, normalize_rows

__all__ = [
    "LEDGERS",
    "add_missing_columns",
    "all_keys",
    "common",
    "deleted",
    "diff",
    "diff_counts",
    "diff_summary",
    "drop_deleted",
    "expand",
    "inserted",
    "last_per_key",
    "ledger",
    "normalize_rows",
    "order_by_key",
    "row_counts",
    "tally",
    "totals",
]
