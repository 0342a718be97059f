"""Mixing sources to target weights by capped water-filling, with DataFrame operations only.

Targets. The mix has ``share`` times the words of all sources, dealt by weight; no source gives more than
``epochs`` times its size. What a clamped source cannot give is dealt to the others by weight, again and
again, until no target is above its cap. The fixed point is computed at once: with sources in order of
cap / weight, the water level is the largest (budget - caps of earlier sources) / (weights from here on).

Sample. With target = whole * size + rest, each document is taken ``whole`` times and documents in a seeded
order once more, as long as at least half of the document lies within the rest. So a source's taken words
miss its target by half of one document at most, and a rerun takes the same documents.

Scale. One narrow row per document is shuffled, never the text. Running totals come in two steps, sums of
4096 hash buckets per source and rows within a bucket, so a source with a third of all rows is spread over
4096 groups; rows that share a doc_id, or have none, are in one of them. Only the list of sources itself, one
row each, is ordered in one task: sources are few, unlike hosts. To mix, rows are written once with a number of their own and meet their plan by it.

Rows. A null source is a source of its own, last in order. Null or empty texts have size 0 and are never
taken; sources of size 0 have target 0. Repeated rows count one by one. An empty table gives an empty one.
Columns named like the operator's own are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.shared import durable, free_name, n_words, numbered, replace

WEIGHTS = (5, 2, 1)


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """From one row (source, source_size) for each source: those columns and ``target``.

    Sources, by code point and null last, have the weights in turn.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place + 1).cast("int"))
    known = sizes.select("source", "source_size", weight.alias("weight")).withColumn("cap", epochs * F.col("source_size"))
    everything = Window.partitionBy()
    budget = F.least(share * F.sum("source_size").over(everything), F.sum("cap").over(everything))
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda name: F.coalesce(F.sum(name).over(by_need), F.lit(0.0))
    level = (budget - before("cap")) / (F.sum("weight").over(everything) - before("weight"))
    return known.withColumn("level", level).select(
        "source", "source_size", F.least("cap", F.max("level").over(everything) * F.col("weight")).alias("target")
    )


def seeded_key(row_id: Column, seed: int) -> Column:
    """The seeded order of documents, as hex digits."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit(""))).cast("binary"))


def plan_mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, epochs: float = 2.0, seed: int = 17
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, repeats (times taken) and taken (words)."""
    return _plan(docs, [], weights, share, epochs, seed)


def _plan(docs: DataFrame, more: list[str], weights: Sequence[float], share: float, epochs: float, seed: int) -> DataFrame:
    """The plan, with further columns of the documents."""
    size = n_words(F.col("text"))
    rows = durable(docs.select("doc_id", "source", size.alias("size"), seeded_key(F.col("doc_id"), seed).alias("key"), *more))
    rows = rows.withColumn("bucket", F.substring("key", 1, 3))
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sources = targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, epochs)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    b = buckets.select("source", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("before_bucket")).alias("b")
    s = sources.alias("s")
    b = b.join(s, F.col("b.source").eqNullSafe(F.col("s.source"))).select("b.*", "source_size", "target").alias("b")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", *more).rowsBetween(Window.unboundedPreceding, -1)
    r = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("r")
    joined = r.join(b, F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.bucket") == F.col("b.bucket")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - whole * F.col("source_size")
    extra = (F.col("before_bucket") + F.col("before") + F.col("size") / 2 <= rest) & (F.col("size") > 0)
    repeats = F.when(F.col("size") > 0, whole + extra.cast("long")).otherwise(0).cast("long")
    return joined.select("doc_id", "size", "source_size", "target", repeats.alias("repeats"), *more).withColumn(
        "taken", F.col("repeats") * F.col("size")
    )


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """The mixed documents themselves: each as often as it is taken, with ``size``, ``target`` and ``copy`` (from 1).

    Each row is taken as its own plan says, also if it shares its doc_id or has none.
    """
    row = free_name(docs, "row_number")
    rows = numbered(docs, row)
    plan = _plan(rows, [row], weights, share, epochs, seed).where("repeats > 0")
    taken = plan.select(F.col(row), *(F.col(c).alias(f"_{c}") for c in ("size", "source_size", "target", "repeats")))
    out = replace(
        rows.join(taken, row),
        size=F.col("_size"),
        source_size=F.col("_source_size"),
        target=F.col("_target"),
        copy=F.explode(F.sequence(F.lit(1), F.col("_repeats").cast("int"))),
    )
    return out.drop(row, "_size", "_source_size", "_target", "_repeats")
