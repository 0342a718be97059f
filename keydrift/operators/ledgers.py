"""What happened to every key, in one row per key.

Each comparison mode boils down to a *ledger*: ``key, status, changed_columns,
n_rows, rows_before, rows_after``. ``status`` is null for a key without a
difference, ``n_rows`` says how many rows of the diff the key stands for, and the
last two columns say how many input rows of each side it covers, so totals come
out of the same pass.

All modes union the two sides and aggregate by key instead of joining them. An
aggregate reduces a hot key inside each task before the shuffle, whereas a join
would send all its rows to one task and pair them there. The normalized mode,
whose rows are wide, does so for crowded buckets of keys only. Only where the caller
vouches for unique keys, and no key can be hot, is the plain full outer join
used: it saves the sort in front of the first reduction.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keydrift.functions.keys import fingerprint, joined_key, named, nullable_key, require_columns
from keydrift.operators.normalize import (
    add_missing_columns,
    compared_columns,
    drop_deleted,
    normalization_steps,
    with_key_parts,
)
from keydrift.options import ITEM_SEPARATOR, KEY_SEPARATOR, DiffOptions

# The states a differing key can have.
INSERT, DELETE, UPDATE = "INSERT", "DELETE", "UPDATE"

# The type of ``n_rows`` where pairs are counted.
PAIRS = "decimal(38,0)"

# A count stays below this, so that an order and a count fit in one decimal; null is before every 64-bit order.
COUNT_RANGE = "CAST(4611686018427387904 AS decimal(19,0))"
NULL_ORDER = "CAST('-9223372036854775809' AS decimal(20,0))"

# Keys fall into so many buckets; one of more than so many rows may hold a hot key.
BUCKETS = 1 << 16
CROWDED = 1 << 20
# Parts of a crowded bucket.
SALTS = 256

LEDGER_COLUMNS = ("key", "status", "changed_columns", "n_rows", "rows_before", "rows_after")


def diff_status(in_before: Column, in_after: Column, differs: Column) -> Column:
    """INSERT, DELETE or UPDATE by presence; null if both sides agree."""
    return (
        F.when(~in_before, F.lit(INSERT)).when(~in_after, F.lit(DELETE)).when(differs, F.lit(UPDATE))
    )


def normalized_ledger(before: DataFrame, after: DataFrame, options: DiffOptions) -> DataFrame:
    """Keep the last row per key, normalize both sides, compare column by column.

    Only keys and operation codes are normalized ahead of the shuffle. The rest
    waits until both sides of a key have met: by then superseded rows are gone,
    and a value that is on one side only, or spelled the same on both, needs no
    normalization at all.
    """
    require_columns(before, options.primary_keys, "before")
    require_columns(after, options.primary_keys, "after")
    columns = compared_columns(before, after, options)
    return _compared(_last_rows(before, after, columns, options), columns, options)


def _compared(keyed: DataFrame, columns: list[str], options: DiffOptions) -> DataFrame:
    both = F.col("_before").isNotNull() & F.col("_after").isNotNull()
    sides = {"b": F.col("_before")["row"], "a": F.col("_after")["row"]}
    kept = ["key", "_in_before", "_in_after", "rows_before", "rows_after"]

    def slot(side: str, i: int) -> str:
        return f"_{side}{i}"

    # A pair of equal raw values becomes null and stays null in all steps.
    compared = keyed.select(
        F.col("_key").alias("key") if options.key_mode == "text" else _joined_parts(options).alias("key"),
        F.col("_before").isNotNull().alias("_in_before"),
        F.col("_after").isNotNull().alias("_in_after"),
        "rows_before",
        "rows_after",
        *[
            F.when(both & ~sides["b"][c].eqNullSafe(sides["a"][c]), F.coalesce(row[c], F.lit(""))).alias(slot(s, i))
            for i, c in enumerate(columns)
            for s, row in sides.items()
        ],
    )
    for step in normalization_steps(options):
        compared = compared.select(
            *kept,
            *[
                F.when(F.col(slot(s, i)).isNotNull(), step(c, F.col(slot(s, i)))).alias(slot(s, i))
                for i, c in enumerate(columns)
                for s in sides
            ],
        )
    changed = F.concat_ws(
        ITEM_SEPARATOR,
        *[F.when(F.col(slot("b", i)) != F.col(slot("a", i)), F.lit(c)) for i, c in enumerate(columns)],
    )
    # Without a fence, a filter on the outcome would be pushed below every step and
    # spell out the whole normalization again. The metric itself is of no use.
    compared = compared.select(*kept, changed.alias("changed_columns")).observe(
        f"fence-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("keys")
    )
    status = diff_status(F.col("_in_before"), F.col("_in_after"), F.col("changed_columns") != "")
    return compared.select(
        "key",
        status.alias("status"),
        "changed_columns",
        status.isNotNull().cast("bigint").alias("n_rows"),
        "rows_before",
        "rows_after",
    )


def _joined_parts(options: DiffOptions) -> Column:
    return joined_key([F.col("_key")[k] for k in options.primary_keys])


def _last_rows(before: DataFrame, after: DataFrame, columns: list[str], options: DiffOptions) -> DataFrame:
    """Per normalized key the last raw row of each side, null if there is none, and row counts.

    Whole rows make Spark sort in front of an aggregate, and what a task reads is as large as the input's files make it.
    So rows are dealt by key first; those of crowded buckets are dealt over several tasks, reduced there, and dealt again.
    Rows are shuffled and sorted flat, a key column's text only where it is not what the key says; structs are made of them afterwards.
    """
    orders = _order_slots(before, after, options)

    def rows(df: DataFrame, old: bool) -> DataFrame:
        live = add_missing_columns(drop_deleted(df, options), columns)
        live, parts = with_key_parts(live, options)
        live = live.withColumn("_key", joined_key(parts) if options.key_mode == "text" else F.struct(*parts))
        texts = {c: named(c).cast("string") for c in columns}
        for i, k in enumerate(options.primary_keys):
            if k in texts:
                texts[k] = F.when(~texts[k].eqNullSafe(_key_part(options, i)), F.struct(texts[k].alias("raw")))
        return live.select(
            "_key",
            F.lit(old).alias("_old"),
            *[column.alias(slot) for slot, column in orders[old].items()],
            *[text.alias(f"_text{i}") for i, text in enumerate(texts.values())],
        )

    def last(old: bool) -> Column:
        texts = {c: F.col(f"_text{i}") for i, c in enumerate(columns)}
        for i, k in enumerate(options.primary_keys):
            if k in texts:
                texts[k] = F.when(texts[k].isNotNull(), texts[k]["raw"]).otherwise(_key_part(options, i))
        order = F.struct(*[F.col(slot) for slot in orders[old]]) if options.order_by else F.lit(0)
        return F.struct(order.alias("order"), F.struct(*[text.alias(c) for c, text in texts.items()]).alias("row"))

    old, new = rows(before, True), rows(after, False)
    if options.unique_keys:
        return old.select("_key", last(True).alias("_before")).join(new.select("_key", last(False).alias("_after")), "_key", "full_outer").select(
            "*",
            F.col("_before").isNotNull().cast("bigint").alias("rows_before"),
            F.col("_after").isNotNull().cast("bigint").alias("rows_after"),
        )
    both = old.unionByName(new, allowMissingColumns=True)

    def reduced(part: DataFrame, *by: str) -> DataFrame:
        return part.groupBy(*by).agg(
            F.max(F.when(F.col("_old"), last(True))).alias("_before"),
            F.max(F.when(~F.col("_old"), last(False))).alias("_after"),
            F.sum(F.col("_old").cast("bigint")).alias("rows_before"),
            F.sum((~F.col("_old")).cast("bigint")).alias("rows_after"),
        )

    if not _any_crowded(both, "_key"):
        return reduced(both.repartition("_key"), "_key")
    salt = _salt(both, "_key", F.xxhash64(*both.columns))
    few, many = _dealt(both.select("*", salt.alias("_salt")), "_key")
    return reduced(few, "_key", "_salt").drop("_salt").unionByName(_reduced(reduced(many, "_key", "_salt"), "_key"))


def _key_part(options: DiffOptions, i: int) -> Column:
    """What ``_key`` says of a key column: its normalized text, unless there is a separator in a part."""
    if options.key_mode != "text":
        return F.col("_key")[options.primary_keys[i]]
    if len(options.primary_keys) == 1:
        return F.col("_key")
    return F.substring_index(F.substring_index("_key", KEY_SEPARATOR, i + 1), KEY_SEPARATOR, -1)


def _order_slots(before: DataFrame, after: DataFrame, options: DiffOptions) -> dict[bool, dict[str, Column]]:
    """For either side (true: before) the columns that carry a row's order, one for each field of structs that are never null.

    Sides whose order columns have other types have columns of their own.
    """
    sides = {True: before, False: after}
    fields = {old: [df.select(named(c)).schema[0] for c in options.order_by] for old, df in sides.items()}
    shared = [f.dataType.simpleString() for f in fields[True]] == [f.dataType.simpleString() for f in fields[False]]
    slots: dict[bool, dict[str, Column]] = {True: {}, False: {}}
    for old in sides:
        prefix = "_order" if shared else f"_order_{'before' if old else 'after'}"
        for i, (c, both) in enumerate(zip(options.order_by, zip(*fields.values()))):
            if all(isinstance(f.dataType, T.StructType) and not f.nullable for f in both):
                parts = [named(c)[name] for name in fields[old][i].dataType.names]
            else:
                parts = [named(c)]
            slots[old] |= {f"{prefix}{i}_{j}": part for j, part in enumerate(parts)}
    return slots


def _bucket_counts(rows: DataFrame, key: str) -> DataFrame:
    """The crowded buckets of the key as it is compared, so that all rows of a key are of one; reads the keys only."""
    counted = rows.groupBy(_bucket(key).alias("_bucket")).agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") > CROWDED)


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS))


def _any_crowded(rows: DataFrame, key: str) -> bool:
    """Whether there are crowded buckets, counted right away: without any, what is shuffled need not be read twice.

    An error of the input is left to the action that reads it.
    """
    try:
        return not _bucket_counts(rows, key).isEmpty()
    except Exception:
        return True


def _salt(rows: DataFrame, key: str, spread: Column) -> Column:
    """Null, or for rows of crowded buckets a number that spreads a key's rows, those that are equal by their task."""
    crowded = _bucket_counts(rows, key).agg(F.collect_list("_bucket").alias("_buckets"))
    number = F.pmod(F.hash(spread, F.spark_partition_id()), F.lit(SALTS))
    return F.when(F.array_contains(crowded.scalar(), _bucket(key)), number)


def _dealt(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows of crowded buckets apart from the others, dealt by key and ``_salt`` in one shuffle that both read."""
    shuffled = rows.repartition(key, "_salt")
    few, many = (_fenced(shuffled) for _ in range(2))
    return few.where(F.col("_salt").isNull()), many.where(F.col("_salt").isNotNull())


def _fenced(shuffled: DataFrame) -> DataFrame:
    """The metric is of no use, but keeps what follows from being pushed below the shuffle, so that others can read it too."""
    every = F.max(F.xxhash64(*[named(c) for c in shuffled.columns])).alias("every")
    return shuffled.observe(f"fence-{uuid.uuid4().hex}", every)


def _reduced(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.max("_before").alias("_before"),
        F.max("_after").alias("_after"),
        F.sum("rows_before").alias("rows_before"),
        F.sum("rows_after").alias("rows_after"),
    )


def raw_ledger(before: DataFrame, after: DataFrame, options: DiffOptions) -> DataFrame:
    """What a full outer join on the key columns as they are would report.

    Key columns that are null match nothing. Repeated keys pair up, and each
    pair of unequal rows counts. The pairs are never formed: a key with b rows
    before and a rows after has b * a pairs, less those of equal rows.
    """
    return _raw_entries(_both_sides(before, after, options), options)


def _raw_entries(rows: DataFrame, options: DiffOptions, dealt: Sequence[str] = ()) -> DataFrame:
    """``dealt``: columns by which the rows lie in their partitions already, each key in one."""
    keys = list(options.primary_keys)
    rows = rows.drop(*options.order_by)
    lone = _any_null([named(k) for k in keys])
    grouping = [named(c) for c in rows.columns if c not in ("_old", "_new", *dealt)]
    distinct_rows = (
        rows.groupBy(*dealt, *grouping, F.when(lone, F.col("_old")).alias("_lone"))
        .agg(F.sum("_old").alias("_old"), F.sum("_new").alias("_new"))
    )
    per_key = distinct_rows.groupBy(*dealt, *[named(k) for k in keys], "_lone").agg(
        F.sum("_old").alias("rows_before"),
        F.sum("_new").alias("rows_after"),
        F.sum(_pairs("_old", "_new")).alias("_equal"),
    )
    pairs = (_pairs("rows_before", "rows_after") - F.col("_equal")).cast(PAIRS)
    return _counted(per_key, joined_key([named(k) for k in keys]), pairs)


def presence_ledger(before: DataFrame, after: DataFrame, options: DiffOptions) -> DataFrame:
    """Keys on one side only, and every pair of rows with a common key.

    Reads nothing but the key columns. A key with a null part matches nothing.
    """
    return _presence_entries(_both_sides(before, after, options), options)


def _presence_entries(rows: DataFrame, options: DiffOptions, dealt: Sequence[str] = ()) -> DataFrame:
    rows = rows.select(*dealt, nullable_key([named(k) for k in options.primary_keys]).alias("_key"), "_old", "_new")
    per_key = rows.groupBy(*dealt, "_key", F.when(F.col("_key").isNull(), F.col("_old")).alias("_lone")).agg(
        F.sum("_old").alias("rows_before"), F.sum("_new").alias("rows_after")
    )
    return _counted(per_key, F.col("_key"), _pairs("rows_before", "rows_after"))


def fingerprint_ledger(before: DataFrame, after: DataFrame, options: DiffOptions) -> DataFrame:
    """Each after row against the fingerprint of its key's last before row.

    Only the key, 8 bytes of hash (32 with ``wide_fingerprint``) and the order columns are shuffled. The first
    aggregate counts equal rows, the second finds the last before row's count. Of several last rows the one that
    the most after rows share counts. If the order is one column of whole numbers, dates or times (or there is none), it
    is carried as a number, and nothing is sorted.
    """
    require_columns(before, options.primary_keys, "before")
    require_columns(after, options.primary_keys, "after")
    packed = packed_order(before, options)

    def hashed(df: DataFrame, old: int) -> DataFrame:
        values = {c: named(c) for c in df.columns if c not in options.order_by}
        order = packed if packed is not None else F.struct(F.lit(0), *[named(c) for c in options.order_by])
        return df.select(
            joined_key([named(k) for k in options.primary_keys]).alias("_key"),
            fingerprint(values, options.wide_fingerprint).alias("_print"),
            (order if old else F.lit(None)).alias("_order"),
            F.lit(old).cast("bigint").alias("_old"),
            F.lit(1 - old).cast("bigint").alias("_new"),
        )

    return _fingerprint_entries(hashed(before, 1).unionByName(hashed(after, 0)), packed is not None)


def _fingerprint_entries(hashed: DataFrame, packed: bool, dealt: Sequence[str] = ()) -> DataFrame:
    distinct_rows = hashed.groupBy(*dealt, "_key", "_print").agg(
        F.max("_order").alias("_order"), F.sum("_old").alias("_old"), F.sum("_new").alias("_new")
    )
    if packed:
        equal = _count_of(F.max(_order_and_count("_order", "_new")))
    else:
        equal = F.max(F.when(F.col("_order").isNotNull(), F.struct("_order", F.col("_new").alias("equal"))))["equal"]
    per_key = distinct_rows.groupBy(*dealt, "_key").agg(
        F.sum("_old").alias("rows_before"), F.sum("_new").alias("rows_after"), equal.alias("_equal")
    )
    unequal = F.col("rows_after") - F.col("_equal")
    return _counted(per_key, F.col("_key"), unequal, deletes=F.lit(1).cast("bigint"))


def packed_order(df: DataFrame, options: DiffOptions) -> Column | None:
    """The order of rows as a number, null first; None if it cannot be had from the order columns' types.

    A number can be aggregated in place, whereas texts and structs make Spark sort in front of every aggregate.
    """
    if not options.order_by:
        return F.lit(0).cast("decimal(20,0)")
    if len(options.order_by) > 1:
        return None
    column, kind = named(options.order_by[0]), df.schema[options.order_by[0]].dataType
    if isinstance(kind, T.DateType):
        column = F.unix_date(column)
    elif isinstance(kind, T.TimestampType):
        column = F.unix_micros(column)
    elif not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return None
    return F.coalesce(column.cast("decimal(20,0)"), F.expr(NULL_ORDER))


def _order_and_count(order: str, count: str) -> Column:
    """A number that sorts by order, then count; null without an order."""
    return (F.col(order) * F.expr(COUNT_RANGE) + F.col(count).cast("decimal(19,0)")).cast(PAIRS)


def _count_of(packed: Column) -> Column:
    return F.pmod(packed, F.expr(COUNT_RANGE)).cast("bigint")


# The modes whose totals can come from one pass.
SHARED_MODES = ("raw", "fingerprint", "presence")


def shared_totals(before: DataFrame, after: DataFrame, modes: Sequence[str], options: DiffOptions) -> DataFrame:
    """``mode, rows_before, rows_after, rows_diff`` of several of ``SHARED_MODES`` from one scan of each side.

    Every row goes into one aggregate once for each mode, with the mode and what the mode tells rows apart by as its
    group: equal rows meet before the shuffle, as in the modes' own ledgers, with which the totals agree.
    """
    unknown = set(modes) - set(SHARED_MODES)
    packed = packed_order(before, options)
    if unknown or ("fingerprint" in modes and packed is None):
        raise ValueError(f"no shared pass for {', '.join(sorted(unknown)) or 'an order that is not one number'}")
    keys = [named(k) for k in options.primary_keys]
    prints = {
        id(df): fingerprint({c: named(c) for c in df.columns if c not in options.order_by}, options.wide_fingerprint)
        for df in (before, after)
    }
    # fingerprints are of the columns and types that a side has itself
    hashed = [
        df.select("*", prints[id(df)].alias("_print"), order.alias("_order"))
        for df, order in ((before, packed if packed is not None else F.lit(None)), (after, F.lit(None)))
    ]
    rows = _both_sides(*hashed, options).drop(*options.order_by)
    values = [named(c) for c in rows.columns if c not in ("_old", "_new", "_print", "_order")]
    columns = {"_raw_key": F.struct(*keys), "_row": F.struct(*values), "_key": joined_key(keys), "_print": F.col("_print")}
    lone = F.when(_any_null(keys), F.col("_old"))
    told_apart = {
        "raw": {"_raw_key": columns["_raw_key"], "_row": columns["_row"], "_lone": lone},
        "fingerprint": {"_key": columns["_key"], "_print": columns["_print"], "_order": F.col("_order")},
        "presence": {"_key": nullable_key(keys), "_lone": lone},
    }
    slots = {**columns, "_lone": lone, "_order": F.col("_order")}
    none = {name: F.when(F.lit(False), column) for name, column in slots.items()}
    entries = rows.select(
        "_old",
        "_new",
        F.explode(
            F.array(*[
                F.struct(F.lit(m).alias("_mode"), *[told_apart[m].get(n, none[n]).alias(n) for n in slots]) for m in modes
            ])
        ).alias("_entry"),
    ).select("_old", "_new", "_entry.*")
    distinct_rows = entries.groupBy("_mode", "_raw_key", "_key", "_lone", "_row", "_print").agg(
        F.sum("_old").alias("_old"), F.sum("_new").alias("_new"), F.max("_order").alias("_order")
    )
    per_key = distinct_rows.groupBy("_mode", "_raw_key", "_key", "_lone").agg(
        F.sum("_old").alias("rows_before"),
        F.sum("_new").alias("rows_after"),
        F.sum(F.when(F.col("_mode") == "raw", _pairs("_old", "_new"))).alias("_equal_pairs"),
        _count_of(F.max(_order_and_count("_order", "_new"))).alias("_equal_last"),
    )
    by_print = F.col("_mode") == "fingerprint"
    pairs = _pairs("rows_before", "rows_after") - F.coalesce("_equal_pairs", F.lit(0).cast(PAIRS))
    updates = F.when(by_print, (F.col("rows_after") - F.col("_equal_last")).cast(PAIRS)).otherwise(pairs.cast(PAIRS))
    deletes = F.when(by_print, F.lit(1).cast("bigint")).otherwise(F.col("rows_before"))
    counted = _counted(per_key, F.col("_mode"), updates, deletes)
    wanted = {"rows_before": F.col("rows_before"), "rows_after": F.col("rows_after"), "rows_diff": F.when(F.col("status").isNotNull(), F.col("n_rows"))}
    # a mode has its row even if there are no rows at all
    sums = counted.agg(
        *[F.coalesce(F.sum(F.when(F.col("key") == m, c)), F.lit(0)).alias(f"{m}_{n}") for m in modes for n, c in wanted.items()]
    )
    per_mode = F.array(*[F.struct(F.lit(m).alias("mode"), *[F.col(f"{m}_{n}").alias(n) for n in wanted]) for m in modes])
    return sums.select(F.explode(per_mode).alias("_totals")).select("_totals.*")


def one_shuffle(before: DataFrame, after: DataFrame, options: DiffOptions) -> bool:
    """Whether :func:`dealt_ledgers` can be had: rows that any mode gives one key must have one normalized key."""
    kinds = [{f.name: f.dataType for f in df.schema} for df in (before, after)]
    names = {n for kind in kinds for n in kind}
    key = options.primary_keys[0]
    return (
        len(options.primary_keys) == 1
        and not options.unique_keys
        and all(kind.get(key) == T.StringType() for kind in kinds)
        and all(c in kind for c in options.order_by for kind in kinds)
        and all(kinds[0][n] == kinds[1][n] for n in names if n in kinds[0] and n in kinds[1])
        and len({n.lower() for n in names}) == len(names) == len(set(before.columns) | set(after.columns))
        and all(len(df.columns) == len(set(df.columns)) for df in (before, after))
    )


def dealt_ledgers(before: DataFrame, after: DataFrame, modes: Sequence[str], options: DiffOptions) -> dict[str, list[DataFrame]]:
    """For each mode two ledgers, of the crowded buckets of keys, if there are any, and of the others, all from one shuffle of the rows.

    Rows are dealt by normalized key, which follows from every other mode's key, so each mode finds its keys whole in a
    partition; only rows of crowded buckets, dealt over several, are reduced and shuffled again by each mode.
    """
    rows = _both_sides(before, after, options)
    keyed, parts = with_key_parts(rows, options)
    key = joined_key(parts) if options.key_mode == "text" else F.struct(*parts)
    keyed = keyed.select(*[named(c) for c in rows.columns], key.alias("_deal"))
    spread = F.xxhash64(*[named(c) for c in rows.columns])
    columns = compared_columns(before, after, options)
    old, packed = F.col("_old") > 0, packed_order(before, options)
    prints = [
        fingerprint({c: named(c) for c in df.columns if c not in options.order_by}, options.wide_fingerprint) for df in (before, after)
    ]
    crowded = _any_crowded(keyed, "_deal")
    dealt = ("_deal", "_salt") if crowded else ("_deal",)

    def last(part: DataFrame, whole: bool) -> DataFrame:
        live = add_missing_columns(drop_deleted(part, options), columns)
        order = F.struct(*[named(c) for c in options.order_by]) if options.order_by else F.lit(0)
        row = F.struct(order.alias("order"), F.struct(*[named(c).cast("string").alias(c) for c in columns]).alias("row"))
        sides = [F.when(old, row).alias("_before"), F.when(~old, row).alias("_after")]
        live = live.select(*dealt, *sides, F.col("_old").alias("rows_before"), F.col("_new").alias("rows_after"))
        found = _reduced(live, *dealt) if whole else _reduced(_reduced(live, *dealt), "_deal")
        return _compared(found.withColumnRenamed("_deal", "_key"), columns, options)

    def hashed(part: DataFrame) -> DataFrame:
        order = packed if packed is not None else F.struct(F.lit(0), *[named(c) for c in options.order_by])
        return part.select(
            *dealt,
            joined_key([named(k) for k in options.primary_keys]).alias("_key"),
            F.when(old, prints[0]).otherwise(prints[1]).alias("_print"),
            F.when(old, order).alias("_order"),
            "_old",
            "_new",
        )

    def entries(mode: str, part: DataFrame, whole: bool) -> DataFrame:
        by = dealt if whole else ()
        if mode == "normalized":
            return last(part, whole)
        if mode == "fingerprint":
            return _fingerprint_entries(hashed(part), packed is not None, by)
        build = {"raw": _raw_entries, "presence": _presence_entries}[mode]
        return build(part if whole else part.drop(*dealt), options, by)

    if not crowded:
        shuffled = keyed.repartition("_deal")
        return {mode: [entries(mode, _fenced(shuffled), True)] for mode in modes}
    salted = keyed.select("*", _salt(keyed, "_deal", spread).alias("_salt"))
    return {
        mode: [entries(mode, few, True), entries(mode, many, False)] for mode in modes for few, many in [_dealt(salted, "_deal")]
    }


def _both_sides(before: DataFrame, after: DataFrame, options: DiffOptions) -> DataFrame:
    require_columns(before, options.primary_keys, "before")
    require_columns(after, options.primary_keys, "after")
    old = before.select("*", F.lit(1).cast("bigint").alias("_old"), F.lit(0).cast("bigint").alias("_new"))
    new = after.select("*", F.lit(0).cast("bigint").alias("_old"), F.lit(1).cast("bigint").alias("_new"))
    return old.unionByName(new, allowMissingColumns=True)


def _pairs(old: str, new: str) -> Column:
    """The product of two counts: a hot key has more pairs than 64 bits can hold."""
    return (F.col(old).cast("decimal(19,0)") * F.col(new).cast("decimal(19,0)")).cast(PAIRS)


def _any_null(columns: list[Column]) -> Column:
    lone = columns[0].isNull()
    for column in columns[1:]:
        lone = lone | column.isNull()
    return lone


def _counted(per_key: DataFrame, key: Column, updates: Column, deletes: Column | None = None) -> DataFrame:
    old, new = F.col("rows_before"), F.col("rows_after")
    status = diff_status(old > 0, new > 0, updates > 0)
    n_rows = F.when(old == 0, new).when(new == 0, old if deletes is None else deletes).otherwise(updates)
    return per_key.select(
        key.alias("key"),
        status.alias("status"),
        F.lit("").alias("changed_columns"),
        n_rows.alias("n_rows"),
        "rows_before",
        "rows_after",
    )


# The names under which a mode is asked for.
LEDGERS = {
    "normalized": normalized_ledger,
    "raw": raw_ledger,
    "fingerprint": fingerprint_ledger,
    "presence": presence_ledger,
}


def ledger(before: DataFrame, after: DataFrame, mode: str, options: DiffOptions) -> DataFrame:
    if mode not in LEDGERS:
        raise ValueError(f"unknown comparison mode {mode!r}, expected one of {', '.join(LEDGERS)}")
    return LEDGERS[mode](before, after, options)
