"""Settings for comparisons and for the test-data generator."""

from __future__ import annotations

from dataclasses import dataclass, replace

# The column names and separators of the table format.
DEFAULT_KEYS = ("user_id",)
DEFAULT_LIST_COLUMNS = ("tags", "levels")
DEFAULT_TEXT_LIST_COLUMNS = ("timestamps",)
DEFAULT_OP_COLUMN = "op_type"
KEY_SEPARATOR = "||"
ITEM_SEPARATOR = "|"

STRICTNESS_LEVELS = ("A", "B")
KEY_MODES = ("text", "struct")


@dataclass(frozen=True)
class DiffOptions:
    """How two snapshots are compared.

    ``list_columns`` hold separator-joined items that strictness B reads as
    integers where it can; ``text_list_columns`` are lists whose items always
    stay text. ``order_by`` names the columns that say which of several rows of
    one key is the last; they are bookkeeping and are not compared. With
    ``unique_keys`` the caller vouches that no key repeats on a side, which
    saves the per-key reduction. ``key_mode="struct"`` keeps apart composite keys
    that read the same once joined to text. ``wide_fingerprint`` makes the fingerprint
    mode compare 256-bit hashes, which rows that differ do not share in practice.
    """

    primary_keys: tuple[str, ...] = DEFAULT_KEYS
    strictness: str = "A"
    list_columns: tuple[str, ...] = DEFAULT_LIST_COLUMNS
    text_list_columns: tuple[str, ...] = DEFAULT_TEXT_LIST_COLUMNS
    op_column: str = DEFAULT_OP_COLUMN
    item_separator: str = ITEM_SEPARATOR
    order_by: tuple[str, ...] = ()
    unique_keys: bool = False
    key_mode: str = "text"
    wide_fingerprint: bool = False

    def __post_init__(self) -> None:
        for name in ("primary_keys", "list_columns", "text_list_columns", "order_by"):
            value = getattr(self, name)
            if isinstance(value, str):
                raise ValueError(f"{name} must be a list of column names, got {value!r}")
            object.__setattr__(self, name, tuple(value))
        level = str(self.strictness).upper()
        if level not in STRICTNESS_LEVELS:
            raise ValueError(f"strictness must be one of {STRICTNESS_LEVELS}, got {self.strictness!r}")
        object.__setattr__(self, "strictness", level)
        if self.key_mode not in KEY_MODES:
            raise ValueError(f"key_mode must be one of {KEY_MODES}, got {self.key_mode!r}")
        if not self.primary_keys:
            raise ValueError("at least one primary-key column is needed")
        if not self.item_separator:
            raise ValueError("item_separator must not be empty")

    def with_(self, **changes) -> DiffOptions:
        return replace(self, **changes)


# How the generator separates date and time.
TIME_STYLES = ("mixed", "space", "t")


@dataclass(frozen=True)
class GeneratorOptions:
    """What the deterministic before/after generator produces."""

    rows: int = 15_000_000
    num_files: int = 100
    seed: int = 42
    mismatch_rate: float = 0.01
    missing_rate: float = 0.01
    optype_ratio: str = "U:0.9,I:0.08,D:0.02"
    avg_tags: int = 3
    avg_levels: int = 3
    avg_ts: int = 2
    shuffle_rows: bool = True
    shuffle_list_elements: bool = True
    gzip: bool = False
    timestyle: str = "mixed"

    def __post_init__(self) -> None:
        if self.timestyle not in TIME_STYLES:
            raise ValueError(f"timestyle must be one of {TIME_STYLES}, got {self.timestyle!r}")
        if self.rows < 0 or self.num_files < 1:
            raise ValueError("rows must not be negative and num_files must be at least 1")

    def with_(self, **changes) -> GeneratorOptions:
        return replace(self, **changes)
