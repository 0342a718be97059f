"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keydrift.functions import (
    clean_text,
    integer_sort_key,
    joined_key,
    named,
    operation_code,
    sorted_integer_list,
    sorted_text_list,
)
from keydrift.functions.rng import unit_double, unsigned_mod, with_draws, wrapping_arithmetic
from keydrift.operators import (
    all_keys,
    deleted,
    diff,
    diff_counts,
    diff_summary,
    drop_deleted,
    inserted,
    last_per_key,
    ledger,
    normalize_rows,
    order_by_key,
    totals,
)
from keydrift.operators import row_counts as live_rows
from keydrift.options import DiffOptions, GeneratorOptions
from keydrift.plans.comparison import read_pair, strategy_matrix
from keydrift.plans.durable import shared_path
from keydrift.plans.generator import (
    MUTATIONS,
    SHUFFLES,
    base_lists,
    bits_of,
    file_of_rank,
    mutated,
    operation,
    permuted_index,
    plan_counts,
    presence,
    shuffle_lists,
    side_rows,
)
from keydrift.plans.job import run_job
from keydrift.sinks import publish_dataset, read_diff, write_delimited, write_diff
from keydrift.sources import read_delimited
from registry.snapshots import (
    COMPOSITE_OPTIONS,
    EVENT_OPTIONS,
    LINE_OPTIONS,
    dirty_orders,
    event_snapshots,
    line_snapshots,
    order_indices,
    order_text,
    table,
)

Query = Callable[[SparkSession, str], DataFrame]
GENERATOR = GeneratorOptions(missing_rate=0.05, mismatch_rate=0.1)
# Packed files are not split, so that each is one task's to write and to read.
ROWS_OF_FILE = 100_000
STRICT = LINE_OPTIONS.with_(strictness="B")


# --- sources and sinks -------------------------------------------------------------------


def scan_tsv(spark, sf_dir):
    path = write_delimited(order_text(spark, sf_dir), shared_path(spark, "scan_tsv"))
    return read_delimited(spark, path)


def scan_csv_comma(spark, sf_dir):
    path = write_delimited(order_text(spark, sf_dir), shared_path(spark, "scan_csv"), delimiter=",")
    return read_delimited(spark, path, delimiter=",")


def scan_gzip(spark, sf_dir):
    rows = order_text(spark, sf_dir)
    root = shared_path(spark, "scan_gzip")
    write_delimited(rows.where(F.col("status") == "F"), f"{root}/packed", gzip=True)
    write_delimited(rows.where(F.col("status") != "F"), f"{root}/plain")
    return read_delimited(spark, f"{root}/*/part-*")


def scan_glob_union(spark, sf_dir):
    rows = order_text(spark, sf_dir)
    root = shared_path(spark, "scan_glob")
    write_delimited(rows.where(F.col("status") == "F").drop("priority"), f"{root}/a")
    write_delimited(
        rows.where(F.col("status") != "F").select("status", "priority", "order_id", "customer"), f"{root}/b"
    )
    found = read_delimited(spark, f"{root}/*/part-*", headers="by_name")
    return found.select("order_id", "customer", "priority", "status")


def scan_tolerant(spark, sf_dir):
    lines = order_text(spark, sf_dir).select(
        F.when(F.col("order_id") % 4 == 0, F.col("order_id"))
        .when(F.col("order_id") % 4 == 1, F.concat_ws(";", "order_id", "status", "status", "status"))
        .otherwise(F.concat_ws(";", "order_id", F.coalesce("customer", F.lit("")), "status"))
        .alias("order_id;customer;status")
    )
    path = shared_path(spark, "scan_tolerant")
    write_delimited(lines, path)
    return read_delimited(spark, path, delimiter=";", corrupt_column="bad_line")


def scan_header_only(spark, sf_dir):
    """A folder of a file with nothing but a header and of files with rows."""
    rows = order_text(spark, sf_dir)
    root = shared_path(spark, "scan_header_only")
    write_delimited(rows.limit(0), f"{root}/a")
    write_delimited(rows, f"{root}/b")
    return read_delimited(spark, f"{root}/*/part-*")


def scan_blank_rows(spark, sf_dir):
    """Every sixth row has blank fields only: that is, nothing but delimiters."""
    k = F.col("order_id").cast("bigint")
    lines = order_text(spark, sf_dir).select(
        F.when(k % 6 == 0, "\t").otherwise(F.concat_ws("\t", "order_id", "status")).alias("value")
    )
    path = shared_path(spark, "scan_blank_rows")
    lines = lines.withColumnRenamed("value", "order_id\tstatus")
    # the header's tabs stay as they are
    lines.write.mode("overwrite").options(header=True, sep="\x01", quote="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return read_delimited(spark, path)


def scan_repeated_names(spark, sf_dir):
    """Two columns of one name, of which the last has it, and one without a name."""
    lines = order_text(spark, sf_dir).select(F.concat_ws("\t", "order_id", "status", F.lit("x"), F.reverse("order_id")).alias("id\tstatus\t\tID"))
    path = shared_path(spark, "scan_repeated")
    # the header's tabs stay as they are
    lines.write.mode("overwrite").options(header=True, sep="\x01", quote="").csv(path)
    return read_delimited(spark, path)


def scan_many_headers(spark, sf_dir):
    """Files of three headers that share some columns, in other orders, read as one table; a row says what it had."""
    rows = order_text(spark, sf_dir)
    root = shared_path(spark, "scan_headers")
    k = F.col("order_id").cast("bigint") % 3
    kinds = [["order_id", "customer", "status"], ["status", "order_id"], ["priority", "status", "order_id"]]
    for place, names in enumerate(kinds):
        write_delimited(rows.where(k == place).repartition(8).select(names), f"{root}/{place}")
    return read_delimited(spark, f"{root}/*", headers="by_name").select("order_id", "customer", "priority", "status")


def sink_overwrite(spark, sf_dir):
    """What is written last is all that is there."""
    rows = order_text(spark, sf_dir)
    path = shared_path(spark, "sink_overwrite")
    write_delimited(rows.where(F.col("status") == "F").repartition(7), path)
    return read_delimited(spark, write_delimited(rows.where(F.col("status") != "F"), path))


def publish_roundtrip(spark, sf_dir):
    """The totals of the diff between a dataset and its published copy; the last row of a customer counts."""
    root = shared_path(spark, "publish")
    files = max(4, -(-_order_count(spark, sf_dir) // ROWS_OF_FILE))
    rows = order_text(spark, sf_dir).repartition(files, "order_id")
    write_delimited(rows.where(F.col("status") != "F"), f"{root}/source/before")
    write_delimited(rows, f"{root}/source/after", gzip=True)
    publish_dataset(spark, f"{root}/source", f"{root}/target")
    options = DiffOptions(primary_keys=("customer",), list_columns=(), text_list_columns=())
    sides = [
        totals(ledger(*compared[:2], "normalized", compared[2])).select(F.lit(side).alias("side"), "*")
        for side in ("before", "after")
        for compared in [read_pair(spark, f"{root}/source/{side}", f"{root}/target/{side}", options)]
    ]
    return sides[0].union(sides[1])


def publish_bytes(spark, sf_dir):
    """Of each side of a published dataset: files, those whose name, length and hash are the source's, and rows by its own pattern."""
    root = shared_path(spark, "publish_bytes")
    rows = order_text(spark, sf_dir).repartition(4, "order_id")
    write_delimited(rows.where(F.col("status") != "F"), f"{root}/source/before")
    write_delimited(rows, f"{root}/source/after", gzip=True)
    publish_dataset(spark, f"{root}/source", f"{root}/target")

    def files(place: str) -> DataFrame:
        found = spark.read.format("binaryFile").load(f"{root}/{place}/*/part-*.tsv*")
        parts = F.split("path", "/")
        return found.select(F.element_at(parts, -2).alias("side"), F.element_at(parts, -1).alias("name"), "length", F.sha2("content", 256).alias("hash"))

    both = files("source").withColumn("here", F.lit(1)).join(files("target").withColumn("there", F.lit(1)), ["side", "name", "length", "hash"], "full")
    copied = both.groupBy("side").agg(F.count("*").alias("n_files"), F.count(F.col("here") + F.col("there")).alias("n_same"))
    sides = [read_delimited(spark, f"{root}/target/{side}/part-*.tsv*").agg(F.count("*").alias("n_rows")).select(F.lit(side).alias("side"), "n_rows") for side in ("before", "after")]
    return copied.join(sides[0].union(sides[1]), "side")


def _stored_lines(spark, sf_dir) -> dict:
    """The two snapshots as files whose line order is the order of the rows, and the settings to compare them."""
    root = shared_path(spark, "lines")
    for side, rows in zip(("before", "after"), line_snapshots(spark, sf_dir, ordered=True)):
        write_delimited(rows.drop("seq"), f"{root}/{side}", gzip=True)
    return {"before": f"{root}/before", "after": f"{root}/after", "out": f"{root}/out"}


def job_compare(spark, sf_dir):
    summary = run_job(spark, {**_stored_lines(spark, sf_dir), "strictness": "B"})
    return read_diff(spark, summary["result"]["diff_path"])


def job_benchmark(spark, sf_dir):
    """The report file of a job that compares in all modes and in one that there is not."""
    conf = _stored_lines(spark, sf_dir)
    run_job(spark, {**conf, "action": "benchmark", "modes": "normalized,raw,fingerprint,presence,unknown"})
    report = spark.read.json(f"{conf['out']}/benchmark.json", multiLine=True)
    return report.select("mode", "success", "rows_before", "rows_after", "rows_diff")


def sink_diff_csv(spark, sf_dir):
    before, after = line_snapshots(spark, sf_dir)
    path = write_diff(diff(before, after, options=LINE_OPTIONS), shared_path(spark, "sink_diff"))
    return read_diff(spark, path)


# --- scalar functions --------------------------------------------------------------------


def _per_order(**columns) -> Query:
    def query(spark, sf_dir):
        rows = dirty_orders(spark, sf_dir)
        return rows.select("o_orderkey", *[build().alias(name) for name, build in columns.items()])

    return query


def norm_list_documents(spark, sf_dir):
    words = sorted_text_list(F.col("text"), " ")
    return table(spark, sf_dir, "documents").select("doc_id", words.alias("words"))


def parse_int_or_str(spark, sf_dir):
    tokens = dirty_orders(spark, sf_dir).select("o_orderkey", F.posexplode(F.split("items", "\\|")).alias("pos", "token"))
    key = integer_sort_key(clean_text(F.col("token")))
    return tokens.select(
        "o_orderkey",
        F.col("pos").cast("bigint").alias("pos"),
        key["kind"].cast("bigint").alias("kind"),
        key["shown"].alias("shown"),
    )


def _normalized(strictness):
    def query(spark, sf_dir):
        before, _ = line_snapshots(spark, sf_dir)
        return normalize_rows(before.drop("seq"), DiffOptions(strictness=strictness))

    return query


def composite_key(spark, sf_dir):
    before, _ = line_snapshots(spark, sf_dir, composite=True)
    parts = [named(k) for k in COMPOSITE_OPTIONS.primary_keys]
    return before.select(joined_key(parts).alias("key"))


def exclude_deleted(spark, sf_dir):
    rows = dirty_orders(spark, sf_dir)
    return drop_deleted(rows, DiffOptions(op_column="code")).select("o_orderkey")


# --- diffs -------------------------------------------------------------------------------


def _line_diff(mode="normalized", options=LINE_OPTIONS, **kw) -> Query:
    def query(spark, sf_dir):
        before, after = line_snapshots(spark, sf_dir, composite=options is COMPOSITE_OPTIONS)
        return diff(before, after, mode, options, **kw)

    return query


def _as_bigint(counts: DataFrame) -> DataFrame:
    """Counts of pairs are decimals; those of these tables fit."""
    return counts.withColumn("n_rows", F.col("n_rows").cast("bigint"))


def _line_counts(mode, options=LINE_OPTIONS) -> Query:
    """Keys repeat in the line items, so pairs of rows are counted, not listed."""

    def query(spark, sf_dir):
        sides = line_snapshots(spark, sf_dir, composite=options is COMPOSITE_OPTIONS)
        return _as_bigint(diff_counts(*sides, mode, options))

    return query


def _event_diff(mode, options=EVENT_OPTIONS) -> Query:
    def query(spark, sf_dir):
        return _as_bigint(diff_counts(*event_snapshots(spark, sf_dir), mode, options))

    return query


def diff_repeated(spark, sf_dir):
    before, after = event_snapshots(spark, sf_dir)
    options = EVENT_OPTIONS.with_(primary_keys=("user_id", "event_type"), list_columns=(), text_list_columns=())
    return diff(before, after, options=options)


def _status_of_keys(columns) -> Query:
    def query(spark, sf_dir):
        before, after = line_snapshots(spark, sf_dir)
        return ledger(before, after, "normalized", STRICT).where("status IS NOT NULL").select("key", *columns)

    return query


def _order_keys(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("user_id"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("user_id"))
    return lines.where(F.col("user_id") % 5 != 0), orders.where(F.col("user_id") % 3 != 0)


def presence_inserts(spark, sf_dir):
    return inserted(*_order_keys(spark, sf_dir))


def presence_deletes(spark, sf_dir):
    return deleted(*_order_keys(spark, sf_dir))


def presence_common(spark, sf_dir):
    return _as_bigint(diff_counts(*_order_keys(spark, sf_dir), "presence")).where(F.col("status") == "UPDATE")


def diff_schema_drift(spark, sf_dir):
    before, after = line_snapshots(spark, sf_dir)
    drifted = after.drop("timestamps").withColumn("note", F.when(F.col("tags").contains("7"), F.lit("seven")))
    return diff(before, drifted, options=LINE_OPTIONS)


def diff_sorted(spark, sf_dir):
    before, after = line_snapshots(spark, sf_dir)
    return order_by_key(diff(before, after, options=STRICT))


def key_union(spark, sf_dir):
    return all_keys(*line_snapshots(spark, sf_dir), LINE_OPTIONS)


def dedup_last(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return last_per_key(events, ["user_id"], ["event_id"])


def row_counts(spark, sf_dir):
    return live_rows(*line_snapshots(spark, sf_dir), LINE_OPTIONS)


def summary(spark, sf_dir):
    return diff_summary(ledger(*line_snapshots(spark, sf_dir), "normalized", STRICT))


def matrix(spark, sf_dir):
    before, after = line_snapshots(spark, sf_dir)
    found = strategy_matrix(before, after, ("normalized", "raw", "fingerprint", "presence", "unknown"), LINE_OPTIONS)
    return found.select("mode", "success", "rows_before", "rows_after", F.col("rows_diff").cast("bigint").alias("rows_diff"))


# --- generator ---------------------------------------------------------------------------


def _over_orders(*columns) -> Query:
    """Generator columns for each order; a column is ``(name, build(bits))``."""

    def query(spark, sf_dir):
        with wrapping_arithmetic(spark):
            bits = bits_of(GENERATOR, F.col("idx"))
            return order_indices(spark, sf_dir).select("idx", *[build(bits).alias(n) for n, build in columns])

    return query


def gen_rand(spark, sf_dir):
    rows = with_draws(order_indices(spark, sf_dir), GENERATOR.seed, F.col("idx"), {"bits": 7})
    return rows.select("idx", F.lpad(F.hex("bits"), 16, "0").alias("bits"), unit_double(F.col("bits")).alias("unit"))


def gen_presence(spark, sf_dir):
    with wrapping_arithmetic(spark):
        flags = presence(GENERATOR, bits_of(GENERATOR, F.col("idx")))
        names = ("in_before", "in_after", "mismatch")
        return order_indices(spark, sf_dir).select("idx", *[f.cast("bigint").alias(n) for f, n in zip(flags, names)])


def _with_lists(spark, sf_dir) -> DataFrame:
    lists = base_lists(GENERATOR, bits_of(GENERATOR, F.col("idx")))
    return order_indices(spark, sf_dir).select("idx", *[c.alias(n) for n, c in lists.items()])


def _as_text(rows: DataFrame) -> DataFrame:
    return rows.select("idx", *[F.array_join(n, "|").alias(n) for n in ("tags", "levels", "ts")])


def gen_lists(spark, sf_dir):
    with wrapping_arithmetic(spark):
        return _as_text(_with_lists(spark, sf_dir))


def gen_shuffle(spark, sf_dir):
    with wrapping_arithmetic(spark):
        bits = bits_of(GENERATOR, F.col("idx"))
        return _as_text(shuffle_lists(_with_lists(spark, sf_dir), GENERATOR, bits, SHUFFLES["before"]))


def gen_mutate(spark, sf_dir):
    with wrapping_arithmetic(spark):
        bits = bits_of(GENERATOR, F.col("idx"))
        rows = _with_lists(spark, sf_dir)
        changed = {
            n: mutated(F.col(n), unsigned_mod(bits(stream), F.size(n).cast("bigint")), value)
            for n, (stream, value) in MUTATIONS.items()
        }
        return _as_text(rows.withColumns(changed))


def _order_count(spark, sf_dir) -> int:
    return table(spark, sf_dir, "orders").count()


def gen_permute(spark, sf_dir):
    options = GENERATOR.with_(rows=_order_count(spark, sf_dir))
    position = F.col("idx") % options.rows
    columns = [permuted_index(options, side, position).alias(f"{side}_idx") for side in ("before", "after")]
    return order_indices(spark, sf_dir).select(position.alias("position"), *columns)


def gen_quotas(spark, sf_dir):
    total = _order_count(spark, sf_dir)
    file = file_of_rank(F.col("idx") % total, total, 7)
    return order_indices(spark, sf_dir).select("idx", file.cast("bigint").alias("file"))


def gen_manifest(spark, sf_dir):
    return plan_counts(order_indices(spark, sf_dir), GENERATOR)


def gen_write(spark, sf_dir):
    """The rows of all orders, written to several files, more of them for more rows, and read back."""
    files = max(5, -(-_order_count(spark, sf_dir) // ROWS_OF_FILE))
    rows = side_rows(order_indices(spark, sf_dir).repartition(files, "idx"), GENERATOR, "after")
    path = write_delimited(rows, shared_path(spark, "gen_write"), gzip=True)
    return read_delimited(spark, path)


def _generated_side(side) -> Query:
    def query(spark, sf_dir):
        return side_rows(order_indices(spark, sf_dir), GENERATOR, side)

    return query


QUERIES: dict[str, Query] = {
    "diff_a": _line_diff(),
    "diff_b": _line_diff(options=STRICT),
    "diff_composite_key": _line_diff(options=COMPOSITE_OPTIONS),
    "diff_key_op": _line_diff(options=LINE_OPTIONS.with_(primary_keys=("user_id", "op_type"))),
    "diff_key_list": _line_diff(options=LINE_OPTIONS.with_(primary_keys=("user_id", "levels"))),
    "diff_raw_full_outer": _line_counts("raw"),
    "diff_raw_composite": _line_counts("raw", COMPOSITE_OPTIONS),
    "diff_fingerprint": _line_diff("fingerprint"),
    "diff_fingerprint_wide": _line_diff("fingerprint", LINE_OPTIONS.with_(wide_fingerprint=True)),
    "diff_presence": _line_counts("presence"),
    "diff_repeated": diff_repeated,
    "diff_raw_repeated": _event_diff("raw"),
    "diff_fingerprint_repeated": _event_diff("fingerprint"),
    "diff_presence_repeated": _event_diff("presence"),
    "diff_schema_drift": diff_schema_drift,
    "diff_sorted": diff_sorted,
    "diff_status": _status_of_keys(["status"]),
    "changed_columns": _status_of_keys(["changed_columns"]),
    "presence_inserts": presence_inserts,
    "presence_deletes": presence_deletes,
    "presence_common": presence_common,
    "key_union": key_union,
    "dedup_last": dedup_last,
    "row_counts": row_counts,
    "diff_summary": summary,
    "strategy_matrix": matrix,
    "norm_null": _per_order(cleaned=lambda: clean_text(F.col("padded"))),
    "norm_list_compat": _per_order(items=lambda: sorted_text_list(F.col("items"))),
    "norm_list_strict": _per_order(items=lambda: sorted_integer_list(F.col("items"))),
    "norm_list_documents": norm_list_documents,
    "norm_timestamps": _per_order(times=lambda: sorted_text_list(F.col("times"))),
    "norm_op_type": _per_order(code=lambda: operation_code(F.col("code"))),
    "parse_int_or_str": parse_int_or_str,
    "normalize_a": _normalized("A"),
    "normalize_b": _normalized("B"),
    "composite_key": composite_key,
    "exclude_deleted": exclude_deleted,
    "scan_tsv": scan_tsv,
    "scan_csv_comma": scan_csv_comma,
    "scan_gzip": scan_gzip,
    "scan_glob_union": scan_glob_union,
    "scan_tolerant": scan_tolerant,
    "scan_header_only": scan_header_only,
    "scan_blank_rows": scan_blank_rows,
    "scan_repeated_names": scan_repeated_names,
    "scan_many_headers": scan_many_headers,
    "sink_overwrite": sink_overwrite,
    "publish_roundtrip": publish_roundtrip,
    "publish_bytes": publish_bytes,
    "job_compare": job_compare,
    "job_benchmark": job_benchmark,
    "sink_diff_csv": sink_diff_csv,
    "gen_rand": gen_rand,
    "gen_op_type": _over_orders(("op_type", partial(operation, GENERATOR))),
    "gen_presence": gen_presence,
    "gen_lists": gen_lists,
    "gen_shuffle": gen_shuffle,
    "gen_mutate": gen_mutate,
    "gen_permute": gen_permute,
    "gen_quotas": gen_quotas,
    "gen_manifest": gen_manifest,
    "gen_write": gen_write,
    "gen_before": _generated_side("before"),
    "gen_after": _generated_side("after"),
}
