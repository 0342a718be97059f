"""Counter-based random numbers: a number depends on seed, row and stream only.

The values are those of the public splitmix64 generator, so any engine can
reproduce them, and rows can be made in any order on any executor.
"""

from __future__ import annotations

from contextlib import AbstractContextManager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keydrift.session import scoped_conf

# The increment and multipliers of splitmix64, and the odd numbers
# that spread rows and streams over its states.
INCREMENT = 0x9E3779B97F4A7C15
FIRST_MULTIPLIER = 0xBF58476D1CE4E5B9
SECOND_MULTIPLIER = 0x94D049BB133111EB
INDEX_MULTIPLIER = 0x9E3779B185EBCA87
STREAM_MULTIPLIER = 0xD1B54A32D192ED03

# The mixing: fold the bits over themselves by a distance, then multiply.
STEPS = ((30, FIRST_MULTIPLIER), (27, SECOND_MULTIPLIER), (31, 1))

WORD = 1 << 64


def _signed(value: int) -> Column:
    """The 64-bit pattern of ``value`` as a bigint literal."""
    value %= WORD
    return F.lit(value - WORD if value >= WORD // 2 else value).cast("bigint")


def wrapping_arithmetic(spark: SparkSession) -> AbstractContextManager[None]:
    """Let bigint products wrap around in DataFrames that are built inside.

    Expressions take their overflow behaviour from the session when the DataFrame
    is built, so the session's own setting is back before anything runs.
    """
    return scoped_conf(spark, {"spark.sql.ansi.enabled": "false"})


def u64(seed: int, index: Column, stream: int | Column) -> Column:
    """64 random bits as a bigint; build the DataFrame in :func:`wrapping_arithmetic`."""
    mixed = _start(seed, index, stream)
    for distance, factor in STEPS:
        mixed = _fold(mixed, distance) * _signed(factor)
    return mixed


def with_draws(rows: DataFrame, seed: int, index: Column, draws: dict[str, int]) -> DataFrame:
    """``rows`` with one column of 64 random bits per name and stream in ``draws``.

    A mixing step uses its input twice. One projection per step keeps that a
    reference to a column, where nested expressions would double in size each time.
    """
    with wrapping_arithmetic(rows.sparkSession):
        rows = rows.withColumns({name: _start(seed, index, stream) for name, stream in draws.items()})
        for distance, factor in STEPS:
            rows = rows.withColumns({n: _fold(F.col(n), distance) * _signed(factor) for n in draws})
    return rows


def _start(seed: int, index: Column, stream: int | Column) -> Column:
    state = index * _signed(INDEX_MULTIPLIER)
    if isinstance(stream, int):
        state = state.bitwiseXOR(_signed(seed ^ (stream * STREAM_MULTIPLIER)))
    else:
        state = state.bitwiseXOR(_signed(seed)).bitwiseXOR(stream * _signed(STREAM_MULTIPLIER))
    return state + _signed(INCREMENT)


def _fold(bits: Column, distance: int) -> Column:
    return bits.bitwiseXOR(F.shiftrightunsigned(bits, distance))


def unsigned_mod(bits: Column, divisor: int | Column) -> Column:
    """``bits`` read as unsigned, modulo a divisor below 2**61."""
    halved = F.shiftrightunsigned(bits, 1) % divisor
    return (halved * 2 + bits.bitwiseAND(F.lit(1).cast("bigint"))) % divisor


def unit_double(bits: Column) -> Column:
    """``bits`` read as unsigned, over 2**64, rounded once.

    The upper half of the range is halved with its last bit kept sticky, which
    rounds as the whole number would.
    """
    one = F.lit(1).cast("bigint")
    sticky = F.shiftrightunsigned(bits, 1).bitwiseOR(bits.bitwiseAND(one))
    value = F.when(bits >= 0, bits.cast("double")).otherwise(sticky.cast("double") * 2.0)
    return value / F.lit(float(WORD))


def u64_of(seed: int, index: int, stream: int) -> int:
    """One number of the same sequence on the driver."""
    bits = (seed ^ (index * INDEX_MULTIPLIER) ^ (stream * STREAM_MULTIPLIER)) + INCREMENT
    for distance, factor in STEPS:
        bits %= WORD
        bits = (bits ^ (bits >> distance)) * factor
    return bits % WORD
