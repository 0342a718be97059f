"""Scalar column expressions."""

from keydrift.functions.keys import fingerprint, joined_key, named, nullable_key, require_columns
from keydrift.functions.text import (
    clean_text,
    integer_sort_key,
    is_deleted,
    operation_code,
    sort_tidy_integers,
    sort_tidy_text,
    sorted_integer_list,
    sorted_text_list,
    tidy_list,
)

__all__ = [
    "clean_text",
    "fingerprint",
    "integer_sort_key",
    "is_deleted",
    "joined_key",
    "named",
    "nullable_key",
    "operation_code",
    "require_columns",
    "sort_tidy_integers",
    "sort_tidy_text",
    "sorted_integer_list",
    "sorted_text_list",
    "tidy_list",
]
