"""Key expressions over one or several columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keydrift.options import KEY_SEPARATOR


def named(column: str) -> Column:
    """The column of exactly this name, even if the name has dots in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def require_columns(df: DataFrame, keys: Sequence[str], side: str = "snapshot") -> None:
    """Fail early, before any job runs, if key columns are absent."""
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise ValueError(f"{side} is missing primary-key columns: {', '.join(missing)}")


def joined_key(parts: Sequence[Column]) -> Column:
    """The parts joined to one text; a null part counts as blank."""
    return F.concat_ws(KEY_SEPARATOR, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def nullable_key(parts: Sequence[Column]) -> Column:
    """The parts joined to one text; null as soon as one part is null."""
    pieces: list[Column] = []
    for i, part in enumerate(parts):
        if i:
            pieces.append(F.lit(KEY_SEPARATOR))
        pieces.append(part.cast("string"))
    return F.concat(*pieces)


def fingerprint(values: dict[str, Column], wide: bool = False) -> Column:
    """A hash over (column, value) pairs, independent of column order: 64 bits, or with ``wide`` 256 (SHA-2).

    Null is hashed as blank: xxhash64 skips nulls, so rows that differ only in
    which column is null would collide otherwise. The wide hash takes each value
    with its length, so that no two rows spell the same text.
    """
    names = sorted(values)
    texts = [F.coalesce(values[n].cast("string"), F.lit("")) for n in names]
    if not wide:
        return F.xxhash64(F.lit("\x1f".join(names)), *texts)
    sized = [F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in [*map(F.lit, names), *texts]]
    return F.unhex(F.sha2(F.concat(*sized).cast("binary"), 256))
