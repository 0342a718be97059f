"""Before/after snapshots made from the given tables, one snapshot row per table row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keydrift.options import DiffOptions

LINE_OPTIONS = DiffOptions(order_by=("seq",))
COMPOSITE_OPTIONS = LINE_OPTIONS.with_(primary_keys=("order_id", "line_no"))
EVENT_OPTIONS = LINE_OPTIONS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def _every(n: int, column: str = "l_orderkey", rest: int = 0) -> Column:
    return F.col(column) % n == rest


# Rows that tie in this order are equal, so the last one is well defined.
LINE_ORDER = ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")


def line_snapshots(
    spark: SparkSession, sf_dir: str, composite: bool = False, ordered: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Two states of the line items: lists in another order and spelling, some really changed.

    With ``ordered`` the rows come in the order of ``seq``; the given columns are sorted, before any text is made of them.
    """
    lines = table(spark, sf_dir, "lineitem")
    if ordered:
        lines = lines.orderBy(*LINE_ORDER)
    quantity, line = _text(F.col("l_quantity").cast("bigint")), _text("l_linenumber")
    part, supplier = _text("l_partkey"), _text("l_suppkey")
    letter = F.when(_every(13), F.col("l_returnflag"))
    shipped = _text("l_shipdate")
    later = _text(F.col("l_shipdate") + F.expr("INTERVAL 3 DAYS"))
    seq = F.struct(*LINE_ORDER).alias("seq")
    if composite:
        keys = [_text("l_orderkey").alias("order_id"), line.alias("line_no")]
    else:
        keys = [F.concat_ws("-", _text("l_orderkey"), line).alias("user_id")]

    before = lines.where(~_every(101)).select(
        *keys,
        F.concat_ws("|", part, letter, supplier).alias("tags"),
        F.concat_ws(" | ", quantity, line, F.lit("10")).alias("levels"),
        F.concat_ws("|", shipped, later).alias("timestamps"),
        F.when(_every(50), "D").when(_every(10, rest=1), "i").otherwise("U").alias("op_type"),
        seq,
    )
    zero = F.when(_every(7), F.lit("0")).otherwise(F.lit(""))
    spelled = F.when(_every(89), F.replace(later, F.lit(" "), F.lit("T"))).otherwise(later)
    after = lines.where(~_every(103)).select(
        *keys,
        F.concat_ws("|", supplier, letter, F.when(_every(97), "99999999").otherwise(part)).alias("tags"),
        F.concat_ws("|", F.lit("10"), F.concat(zero, line), quantity).alias("levels"),
        F.concat_ws("|", spelled, shipped).alias("timestamps"),
        F.when(_every(50), "d").otherwise("U").alias("op_type"),
        seq,
    )
    return before, after


def event_snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the events keyed by user: every key repeats, some keys are null."""
    events = table(spark, sf_dir, "events").select(
        F.when(~_every(20, "user_id"), _text("user_id")).alias("user_id"),
        "event_type",
        _text(F.floor("value")).alias("value"),
        F.col("event_id").alias("seq"),
    )
    present_before = ~_every(3, "seq") & ~(F.col("user_id").isNotNull() & _every(17, "user_id"))
    present_after = ~_every(3, "seq", rest=1) & ~(F.col("user_id").isNotNull() & _every(19, "user_id"))
    return events.where(present_before), events.where(present_after)


def order_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as text columns, for round trips through files."""
    return table(spark, sf_dir, "orders").select(
        _text("o_orderkey").alias("order_id"),
        F.when(~_every(9, "o_orderkey"), _text("o_custkey")).alias("customer"),
        F.when(_every(5, "o_orderkey"), F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit('", \\')))
        .otherwise(F.col("o_orderpriority"))
        .alias("priority"),
        F.col("o_orderstatus").alias("status"),
    )


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with padded, blank, null and oddly spelled text made from their own values."""
    k = F.col("o_orderkey")
    customer, status = _text("o_custkey"), F.col("o_orderstatus")
    pick = k % 8
    padded = (
        F.when(pick == 0, F.concat(F.lit(" \t"), F.col("o_orderpriority"), F.lit("　\n")))
        .when(pick == 1, F.lit(None))
        .when(pick == 2, F.lit(" \x1f "))
        .when(pick == 3, F.concat(F.lit(" "), status))
        .otherwise(F.col("o_orderpriority"))
    )
    items = (
        F.when(pick == 0, F.concat_ws("|", customer, F.lit(" 007 "), status, F.lit("-12")))
        .when(pick == 1, F.concat_ws(" | ", F.lit("é"), F.lit(""), status, F.lit("1__0"), F.lit("1_000")))
        .when(pick == 2, F.lit(None))
        .when(pick == 3, F.concat_ws("|", _text(k), F.concat(F.lit("123456789012345678901"), customer), F.lit("+5")))
        .when(pick == 4, F.concat_ws("|", status, F.lit("　b "), F.lit("a"), status, F.lit("|")))
        .when(pick == 5, F.concat_ws("|", customer, _text(k), F.lit("-0"), F.concat(F.lit("-"), customer)))
        .otherwise(F.concat_ws("|", _text(k), customer, F.lit("10")))
    )
    code = (
        F.when(pick == 0, F.lit(" i"))
        .when(pick == 1, F.lit("d\t"))
        .when(pick == 2, F.lit(None))
        .when(pick == 3, F.lit("U"))
        .when(pick == 4, F.lit("D"))
        .otherwise(F.lower(status))
    )
    return table(spark, sf_dir, "orders").select(
        k.alias("o_orderkey"), padded.alias("padded"), items.alias("items"), code.alias("code"),
        F.concat_ws("|", F.replace(_text("o_orderdate"), F.lit(" "), F.lit("T")), _text("o_orderdate"), F.lit(" x ")).alias("times"),
    )


def order_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order keys as row indices for the generator."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"))
