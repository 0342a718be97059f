"""Column expressions that bring snapshot text to a comparable form.

Everything here is a built-in expression, so it stays inside the JVM.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from keydrift.options import ITEM_SEPARATOR

# Fixed value: the longest digit string that still counts as an integer.
MAX_INTEGER_DIGITS = 4300


@lru_cache(maxsize=None)
def whitespace_characters() -> str:
    """Every character Unicode calls white space, as ``str.isspace`` sees it."""
    return "".join(c for c in map(chr, range(0x3001)) if c.isspace())


@lru_cache(maxsize=None)
def _decimal_digits() -> tuple[str, str]:
    """All non-ASCII decimal digits and, position by position, their ASCII form."""
    pairs = [
        (chr(code), str(unicodedata.decimal(chr(code))))
        for code in range(0x80, sys.maxunicode + 1)
        if unicodedata.decimal(chr(code), None) is not None
    ]
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


def literal_pattern(text: str) -> str:
    """A Java regex for ``text`` itself; one character keeps split's fast path."""
    if len(text) == 1:
        return text if text.isalnum() or ord(text) > 127 else "\\" + text
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def _strip(column: Column) -> Column:
    return F.btrim(column, F.lit(whitespace_characters()))


def clean_text(column: Column) -> Column:
    """Null becomes blank, anything else becomes text without outer white space."""
    return _strip(F.coalesce(column.cast("string"), F.lit("")))


def tidy_list(cleaned: Column, separator: str = ITEM_SEPARATOR) -> Column:
    """A cleaned list text with its items stripped and the blank ones dropped.

    In printable ASCII only blanks and separators next to a separator need to go,
    which a search, and if it finds some a replacement, can do. The row-wise
    lambdas that handle everything else are several times slower.
    """
    sep = literal_pattern(separator)
    printable = cleaned.rlike(r"\A[ -~]*\z")
    tidy = ~cleaned.startswith(separator) & ~cleaned.endswith(separator)
    for neighbours in (separator * 2, separator + " ", " " + separator):
        tidy = tidy & ~cleaned.contains(neighbours)
    items = F.filter(F.transform(F.split(cleaned, sep), _strip), lambda item: item != "")
    general = F.array_join(items, separator)
    if len(separator) > 1:
        return F.when(printable & tidy, cleaned).otherwise(general)
    collapsed = F.btrim(F.regexp_replace(cleaned, f" *{sep}[ {sep}]*", separator), F.lit(separator))
    return F.when(~printable, general).when(tidy, cleaned).otherwise(collapsed)


def sort_tidy_text(tidy: Column, separator: str = ITEM_SEPARATOR) -> Column:
    """A tidy list text with its items in code-point order, duplicates kept."""
    return F.array_join(F.sort_array(F.split(tidy, literal_pattern(separator))), separator)


def sort_tidy_integers(tidy: Column, separator: str = ITEM_SEPARATOR) -> Column:
    """A tidy list text with integers first, by value and canonical, then text.

    Two shapes cover most data without row-wise lambdas: lists of integers that
    fit a bigint, and lists without a single digit. The rest takes the general way.
    """
    sep = literal_pattern(separator)
    general = F.array_join(
        F.transform(F.sort_array(_integer_sort_keys(F.split(tidy, sep))), lambda key: key["shown"]),
        separator,
    )
    general = F.when(tidy == "", F.lit("")).otherwise(general)
    foreign, _ = _decimal_digits()
    if any(c in "+-_" or c.isdecimal() for c in separator):
        # Such a separator can be part of a number, so the shortcuts would misread it.
        return general
    # The bound on the item count keeps the regex engine's stack small.
    small_integers = tidy.rlike(rf"\A[+-]?[0-9]{{1,18}}(?:{sep}[+-]?[0-9]{{1,18}}){{0,200}}\z")
    numbers = F.sort_array(F.split(tidy, sep).cast("array<bigint>")).cast("array<string>")
    has_digit = tidy.rlike(f"[0-9{foreign}]")
    return (
        F.when(small_integers, F.array_join(numbers, separator))
        .when(~has_digit, sort_tidy_text(tidy, separator))
        .otherwise(general)
    )


def sorted_text_list(column: Column, separator: str = ITEM_SEPARATOR) -> Column:
    """A list text with its items stripped, blanks dropped, sorted by code point."""
    return sort_tidy_text(tidy_list(clean_text(column), separator), separator)


def sorted_integer_list(column: Column, separator: str = ITEM_SEPARATOR) -> Column:
    """Like :func:`sorted_text_list`, but integers first, by value and canonical."""
    return sort_tidy_integers(tidy_list(clean_text(column), separator), separator)


def integer_sort_key(token: Column) -> Column:
    """A struct that orders integers by value ahead of text by code point.

    The fields compare one after the other: kind (0 integer, 1 text), sign,
    signed digit count, then the digits (complemented for negatives). No field
    is numeric in the token's value, so integers of any length compare exactly.
    ``shown`` is the token's canonical spelling.
    """
    return _integer_sort_keys(F.array(token))[0]


def _integer_sort_keys(tokens: Column) -> Column:
    """:func:`integer_sort_key` of each token.

    One transform per step, as a lambda computes a shared part once only if an
    earlier step has put it in a field.
    """
    foreign, ascii_form = _decimal_digits()
    folded = F.transform(
        tokens,
        lambda token: F.struct(
            token.alias("token"),
            F.when(token.rlike(r"\A[ -~]*\z"), token)
            .otherwise(F.translate(token, foreign, ascii_form))
            .alias("folded"),
        ),
    )
    parsed = F.transform(
        folded,
        lambda t: F.struct(
            t["token"].alias("token"),
            F.when(
                t["folded"].rlike(r"\A[+-]?[0-9][0-9_]*\z")
                & ~t["folded"].contains("__")
                & ~t["folded"].endswith("_")
                & (F.length(F.translate(t["folded"], "+-_", "")) <= MAX_INTEGER_DIGITS),
                F.ltrim(F.translate(t["folded"], "+-_", ""), F.lit("0")),
            ).alias("magnitude"),
            t["folded"].startswith("-").alias("minus"),
        ),
    )

    def key(t: Column) -> Column:
        magnitude, size = t["magnitude"], F.length(t["magnitude"])
        return (
            F.when(magnitude.isNull(), _sort_key(1, 0, F.lit(0), F.lit(""), t["token"]))
            .when(size == 0, _sort_key(0, 1, F.lit(0), F.lit(""), F.lit("0")))
            .when(t["minus"], _sort_key(0, -1, -size, _complement(magnitude), F.concat(F.lit("-"), magnitude)))
            .otherwise(_sort_key(0, 1, size, magnitude, magnitude))
        )

    return F.transform(parsed, key)


def _complement(digits: Column) -> Column:
    return F.translate(digits, "0123456789", "9876543210")


def _sort_key(kind: int, sign: int, size: Column, digits: Column, shown: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        F.lit(sign).alias("sign"),
        size.alias("size"),
        digits.alias("digits"),
        shown.alias("shown"),
    )


def operation_code(column: Column) -> Column:
    """The upper-case operation code, with an insert counted as an update."""
    code = F.upper(clean_text(column))
    return F.when(code == "I", F.lit("U")).otherwise(code)


def is_deleted(column: Column) -> Column:
    """True where the operation code says the row is gone."""
    return clean_text(column).isin("D", "d")
