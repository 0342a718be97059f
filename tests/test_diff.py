import random
from collections import Counter

import model
import pytest
from keydrift.operators import (
    all_keys,
    common,
    deleted,
    diff,
    diff_counts,
    expand,
    inserted,
    last_per_key,
    ledger,
    order_by_key,
    tally,
    totals,
)
from keydrift.options import DiffOptions
from keydrift.plans.comparison import strategy_matrix
from pyspark.sql import functions as F

COLUMNS = ("user_id", "tags", "levels", "timestamps", "op_type")


def frame(spark, rows, columns=COLUMNS, seq=True):
    data = [(i, *[r.get(c) for c in columns]) for i, r in enumerate(rows)]
    schema = "seq int, " + ", ".join(f"`{c}` string" for c in columns)
    df = spark.createDataFrame(data, schema)
    return df if seq else df.drop("seq")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


ORDERED = DiffOptions(order_by=("seq",))
GOLDEN_BEFORE = [
    dict(user_id="u1", tags="2|1", levels="10|2", timestamps="2026-01-07 00:00:00", op_type="U"),
    dict(user_id="u2", tags="B|A", levels="X|3", timestamps="2026-01-08 00:00:00", op_type="D"),
]
GOLDEN_AFTER = [
    dict(user_id="u1", tags="1|2", levels="2|10", timestamps="2026-01-07T00:00:00", op_type="U"),
    dict(user_id="u3", tags="A|C", levels="3|X", timestamps="2026-01-08 00:00:00", op_type="I"),
]


@pytest.mark.parametrize("strictness", ["A", "B"])
@pytest.mark.parametrize("unique", [False, True])
def test_golden_pair(spark, strictness, unique):
    options = ORDERED.with_(strictness=strictness, unique_keys=unique)
    b, a = frame(spark, GOLDEN_BEFORE), frame(spark, GOLDEN_AFTER)
    assert rows_of(diff(b, a, options=options, ordered=True)) == [
        ("u1", "UPDATE", "timestamps"),
        ("u3", "INSERT", ""),
    ]
    entries = ledger(b, a, "normalized", options)
    assert rows_of(totals(entries)) == [(1, 2, 2)]
    assert rows_of(totals(tally(entries))) == [(1, 2, 2)]


def case(spark, before, after, columns=("user_id", "tags"), keys=("user_id",), **kw):
    options = ORDERED.with_(primary_keys=keys, **kw)
    got = rows_of(diff(frame(spark, before, columns), frame(spark, after, columns), options=options, ordered=True))
    assert got == model.normalized_diff(before, after, options.strictness, keys)
    return got


def test_mixed_changes_in_key_order(spark):
    before = [dict(user_id=u, tags=t) for u, t in [("user1", "a"), ("user2", "b"), ("user3", "c")]]
    after = [dict(user_id=u, tags=t) for u, t in [("user4", "d"), ("user3", "x"), ("user1", "a")]]
    assert case(spark, before, after) == [
        ("user2", "DELETE", ""),
        ("user3", "UPDATE", "tags"),
        ("user4", "INSERT", ""),
    ]


def test_several_changed_columns_in_name_order(spark):
    columns = ("user_id", "tags", "levels", "timestamps")
    before = [dict(user_id="u", tags="a", levels="1", timestamps="t")]
    after = [dict(user_id="u", tags="b", levels="2", timestamps="t")]
    assert case(spark, before, after, columns) == [("u", "UPDATE", "levels|tags")]


@pytest.mark.parametrize("sides", [([], []), ([dict(user_id="u", tags="")], []), ([], [dict(user_id="u", tags="")])])
def test_empty_sides(spark, sides):
    case(spark, *sides)


def test_composite_keys_and_blank_parts(spark):
    columns, keys = ("user_id", "region", "tags"), ("user_id", "region")
    before = [dict(user_id="user1", region="us-east", tags="a"), dict(user_id="", region="us-east", tags="a")]
    after = [
        dict(user_id="user1", region="us-east", tags="b"),
        dict(user_id="user1", region="us-west", tags="a"),
        dict(user_id=None, region=" us-east", tags="a"),
    ]
    assert case(spark, before, after, columns, keys) == [
        ("user1||us-east", "UPDATE", "tags"),
        ("user1||us-west", "INSERT", ""),
    ]


def test_keys_with_the_separator_inside(spark):
    columns, keys = ("k1", "k2", "tags"), ("k1", "k2")
    before = [dict(k1="a||b", k2="c", tags="x")]
    after = [dict(k1="a", k2="b||c", tags="x")]
    assert case(spark, before, after, columns, keys) == [("a||b||c", "UPDATE", "k1|k2")]
    options = ORDERED.with_(primary_keys=keys, key_mode="struct")
    got = rows_of(diff(frame(spark, before, columns), frame(spark, after, columns), options=options, ordered=True))
    assert got == [("a||b||c", "DELETE", ""), ("a||b||c", "INSERT", "")]


@pytest.mark.parametrize("mode", ["normalized", "raw", "fingerprint", "presence"])
def test_missing_key_column_is_refused(spark, mode):
    df = frame(spark, [], ("user_id",))
    with pytest.raises(ValueError, match="missing primary-key columns: region, zone"):
        diff(df, df, mode, ORDERED.with_(primary_keys=("user_id", "region", "zone")))


def test_blank_equals_null_and_insert_code_equals_update(spark):
    before = [dict(user_id="u", tags=None, levels="", timestamps=" ", op_type="I")]
    after = [dict(user_id="u", tags="", levels=None, timestamps=None, op_type="u")]
    assert case(spark, before, after, COLUMNS) == []


def test_columns_on_one_side_only(spark):
    before = [dict(user_id="u1", tags="a"), dict(user_id="u2", tags="a")]
    after = [dict(user_id="u1", tags="a", note="n"), dict(user_id="u2", tags="a", note=" ")]
    got = rows_of(
        diff(frame(spark, before, ("user_id", "tags")), frame(spark, after, ("user_id", "tags", "note")), options=ORDERED)
    )
    assert got == [("u1", "UPDATE", "note")]


def test_a_deleted_row_does_not_hide_an_earlier_one(spark):
    before = [dict(user_id="u", tags="a", op_type="U"), dict(user_id="u", tags="b", op_type="D")]
    after = [dict(user_id="u", tags="a", op_type="U")]
    assert case(spark, before, after, COLUMNS) == []


def random_rows(rng, n, keys=6):
    def items():
        pool = ["1", "01", " 2", "10", "a", "B ", "", "-3", "+4", "1_0", "９", "é"]
        return "|".join(rng.choice(pool) for _ in range(rng.randint(0, 4))) or None

    return [
        dict(
            user_id=rng.choice(["k%d" % rng.randrange(keys), " k1 ", None, ""]),
            tags=items(),
            levels=items(),
            timestamps=rng.choice([None, "2026-01-01 00:00:00|2025-01-01T00:00:00", "x"]),
            op_type=rng.choice(["I", "u", "U", " d", "D", None]),
        )
        for _ in range(n)
    ]


@pytest.mark.parametrize("seed", range(3))
def test_normalized_diff_agrees_with_the_model(spark, seed):
    rng = random.Random(seed)
    before, after = random_rows(rng, 40, 30), random_rows(rng, 40, 30)
    for strictness in "AB":
        case(spark, before, after, COLUMNS, strictness=strictness)


@pytest.mark.parametrize("keys", [("user_id",), ("user_id", "op_type")])
@pytest.mark.parametrize("seed", range(2))
def test_counting_modes_agree_with_the_model(spark, keys, seed):
    rng = random.Random(100 + seed)
    before, after = random_rows(rng, 40, 5), random_rows(rng, 30, 5)
    after += [dict(r) for r in before[:12]]
    options = ORDERED.with_(primary_keys=keys)
    b, a = frame(spark, before), frame(spark, after)
    for mode, expected in [
        ("raw", model.raw_diff(before, after, keys)),
        ("fingerprint", model.fingerprint_diff(before, after, keys)),
        ("presence", model.presence_diff(before, after, keys)),
    ]:
        got = rows_of(diff(b, a, mode, options, ordered=True))
        assert Counter(got) == expected, mode
        assert [r[0] or "" for r in got] == sorted(r[0] or "" for r in got)
        counted = Counter()
        for *row, n in rows_of(diff_counts(b, a, mode, options)):
            counted[tuple(row)] += n
        assert counted == expected
        counts = rows_of(totals(tally(ledger(b, a, mode, options))))
        assert counts == [(len(before), len(after), sum(expected.values()))]
    expected = model.presence_diff(before, after, keys)
    for fn, status in [(inserted, "INSERT"), (deleted, "DELETE"), (common, "UPDATE")]:
        assert Counter(rows_of(fn(b, a, options))) == Counter({k: v for k, v in expected.items() if k[1] == status})


def test_expand_splits_long_repeats(spark):
    entries = spark.createDataFrame(
        [("a", "UPDATE", "", 150_000), ("b", "DELETE", "", 1), ("c", None, "", 0)],
        "key string, status string, changed_columns string, n_rows bigint",
    )
    got = {r["key"]: r["count"] for r in expand(entries, ordered=True).groupBy("key").count().collect()}
    assert got == {"a": 150_000, "b": 1}


def test_diff_of_a_snapshot_with_itself_is_empty(spark):
    df = frame(spark, random_rows(random.Random(7), 50))
    for strictness in "AB":
        assert diff(df, df, options=ORDERED.with_(strictness=strictness)).count() == 0


def test_swapping_sides_swaps_inserts_and_deletes(spark):
    rng = random.Random(8)
    b, a = frame(spark, random_rows(rng, 40, 30)), frame(spark, random_rows(rng, 40, 30))
    swap = {"INSERT": "DELETE", "DELETE": "INSERT", "UPDATE": "UPDATE"}
    there = [(k, swap[s], c) for k, s, c in rows_of(diff(b, a, options=ORDERED, ordered=True))]
    assert there == rows_of(diff(a, b, options=ORDERED, ordered=True))


def test_partitioning_does_not_matter(spark):
    rng = random.Random(9)
    b, a = frame(spark, random_rows(rng, 60, 20)), frame(spark, random_rows(rng, 60, 20))
    want = rows_of(diff(b, a, options=ORDERED, ordered=True))
    got = rows_of(diff(b.repartition(7), a.repartition(3), options=ORDERED, ordered=True))
    assert got == want


def test_last_per_key(spark):
    df = spark.createDataFrame(
        [("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), ("b", None, "only"), ("b", None, "nothing")],
        "k string, seq int, v string",
    )
    assert sorted(rows_of(last_per_key(df, ["k"], ["seq"]))) == [("a", 3, "y"), ("b", None, "only")]


def test_all_keys(spark):
    b, a = frame(spark, GOLDEN_BEFORE), frame(spark, GOLDEN_AFTER)
    assert sorted(rows_of(all_keys(b, a, ORDERED))) == [("u1",), ("u3",)]


def test_no_join_and_no_python_in_the_plans(spark):
    df = frame(spark, random_rows(random.Random(1), 5))
    for mode in ("normalized", "raw", "fingerprint", "presence"):
        plan = diff(df, df, mode, ORDERED)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Python" not in plan
    plan = diff(df, df, options=ORDERED.with_(unique_keys=True))._jdf.queryExecution().executedPlan().toString()
    assert "FullOuter" in plan
    assert plan.count("Exchange hashpartitioning") == 2


def test_dotted_column_names(spark):
    b = spark.createDataFrame([("u", "1")], "user_id string, `a.b` string")
    a = spark.createDataFrame([("u", "2")], "user_id string, `a.b` string")
    assert rows_of(diff(b, a)) == [("u", "UPDATE", "a.b")]
    assert rows_of(diff(b, a, "raw")) == [("u", "UPDATE", "")]
    assert rows_of(diff(b, a, "fingerprint")) == [("u", "UPDATE", "")]


@pytest.mark.parametrize("key_mode", ["text", "struct"])
@pytest.mark.parametrize(("keys", "before", "after"), [
    (("user_id", "op_type"), {"op_type": "I"}, {"op_type": "U"}),
    (("user_id", "tags"), {"tags": "b|a"}, {"tags": " a |b"}),
])
def test_keys_are_built_from_normalized_values(spark, key_mode, keys, before, after):
    row = {"user_id": "u1", "tags": "x", "levels": "1", "timestamps": "t", "op_type": "U"}
    options = DiffOptions(primary_keys=keys, key_mode=key_mode, order_by=("seq",))
    old, new = frame(spark, [row | before]), frame(spark, [row | after])
    assert diff(old, new, options=options).count() == 0
    assert all_keys(old, new, options).count() == 1


def test_repeats_spread_over_partitions_before_they_are_written_out(spark):
    entry = "'k' AS key, 'INSERT' AS status, '' AS changed_columns, {} AS n_rows, 0L AS rows_before, 0L AS rows_after"
    rows = expand(spark.range(1).selectExpr(*entry.format("1000000L").split(", ")))
    sizes = rows.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in sizes) == 1_000_000 and len(sizes) > 1
    assert all(r["count"] < 1_000_000 for r in sizes)


def test_pairs_beyond_64_bits(spark):
    from keydrift.operators.ledgers import _pairs

    many = spark.range(1).select(F.lit(4_000_000_000).alias("b"), F.lit(4_000_000_000).alias("a"))
    assert int(many.select(_pairs("b", "a")).first()[0]) == 16 * 10**18


@pytest.mark.parametrize("keys", [("user_id", "op_type"), ("tags",)])
def test_keys_of_normalized_columns(spark, keys):
    options = ORDERED.with_(primary_keys=keys)
    rows = [dict(user_id="u1", tags="b|a", levels="1", timestamps="t", op_type="I")]
    other = [dict(rows[0], tags="a|b", op_type="U")]
    b, a = frame(spark, rows), frame(spark, other)
    assert rows_of(diff(b, a, options=options)) == model.normalized_diff(rows, other, "A", keys) == []
    assert all_keys(b, a, options).count() == 1


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("order, extra", [((), True), (("at",), False), (("seq",), True)])
def test_modes_that_share_a_pass_agree_with_their_ledgers(spark, order, extra):
    rng = random.Random(len(order) + extra)

    def side(more):
        rows = [
            (rng.choice([None, "", "a", "b", "c", "d||e"]), rng.choice([None, "", "x", "||x"]), rng.choice([None, "", "1", "2"]),
             rng.choice([None, 3, 4]), rng.choice([None, *range(-2, 6)]), "s%d" % rng.randint(0, 9))
            for _ in range(rng.randint(60, 90))
        ]
        df = spark.createDataFrame(rows, "k1 string, k2 string, v string, n int, at int, seq string")
        return df.withColumn("more", F.col("v")).withColumn("n", F.col("n").cast("bigint")) if more else df

    before, after = side(False), side(extra)
    options = DiffOptions(primary_keys=("k1", "k2"), order_by=order)
    none = spark.createDataFrame([], before.schema)
    for sides in ((before, after), (none, none), (before, before)):
        got = {r.mode: tuple(map(int, r[1:4])) for r in strategy_matrix(*sides, ("raw", "fingerprint", "presence", "what"), options).collect()}
        want = {m: tuple(map(int, totals(ledger(*sides, m, options)).first())) for m in ("raw", "fingerprint", "presence")}
        assert got == {**want, "what": (0, 0, 0)}


def test_a_shared_pass_scans_once_and_does_not_sort(spark, tmp_path):
    rows = spark.range(50).selectExpr("cast(id % 7 as string) AS user_id", "cast(id as string) AS v", "id AS seq")
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    options = DiffOptions(order_by=("seq",))
    plan = _plan(strategy_matrix(rows, rows.where("seq > 3"), ("raw", "fingerprint", "presence"), options))
    assert plan.count("FileScan parquet") == 2 and "SortAggregate" not in plan and "Join" not in plan
    assert "SortAggregate" not in _plan(ledger(rows, rows, "fingerprint", options))


@pytest.mark.parametrize("kind", ["tinyint", "int", "bigint", "date", "timestamp"])
def test_the_last_row_by_a_packed_order(spark, kind):
    """A null order comes first, the least number after it; the last before row is the one that counts."""
    low = {"tinyint": "-128", "int": "-2147483648", "bigint": "-9223372036854775808", "date": "DATE'0001-01-01'", "timestamp": "TIMESTAMP'0001-01-01'"}[kind]
    high = {"tinyint": "127", "int": "2147483647", "bigint": "9223372036854775807", "date": "DATE'9999-12-31'", "timestamp": "TIMESTAMP'9999-12-31'"}[kind]
    spark_rows = lambda *rows: spark.sql(" UNION ALL ".join(f"SELECT '{k}' user_id, '{v}' v, CAST({o} AS {kind}) seq" for k, v, o in rows))
    before = spark_rows(("a", "old", "NULL"), ("a", "new", low), ("b", "old", low), ("b", "new", high), ("c", "x", "NULL"))
    after = spark_rows(("a", "new", low), ("b", "new", low), ("b", "old", high), ("b", "new", low), ("c", "x", high))
    found = diff_counts(before, after, "fingerprint", DiffOptions(order_by=("seq",))).collect()
    assert [(r.key, r.status, r.n_rows) for r in found] == [("b", "UPDATE", 1)]


def test_rows_are_not_sorted_ahead_of_the_shuffle(spark, tmp_path):
    """Only those of crowded buckets are: 200 rows of a key leave their task as one, 200 keys of one row are dealt as they are."""
    rows = spark.range(400).selectExpr("if(id < 200, 'hot', concat('k', id)) AS user_id", "cast(id as string) AS tags", "id AS seq")
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    lines = _plan(ledger(rows, rows, "normalized", DiffOptions(order_by=("seq",)))).splitlines()
    dealt = next(i for i, line in enumerate(lines) if "REPARTITION_BY_COL" in line)
    under = lines[dealt + 1 : next(i for i, line in enumerate(lines) if i > dealt and "FileScan" in line)]
    assert not [line for line in under if "Sort" in line]


@pytest.mark.parametrize("crowded", [0, 1, 5])
def test_crowded_buckets_are_reduced_first(spark, monkeypatch, crowded):
    monkeypatch.setattr("keydrift.operators.ledgers.CROWDED", crowded)
    rng = random.Random(crowded)
    before, after = random_rows(rng, 60, 12), random_rows(rng, 60, 12)
    case(spark, before, after, COLUMNS)
    options = ORDERED.with_(key_mode="struct", primary_keys=("user_id", "op_type"))
    live = lambda rows: sum(model.op(r["op_type"]) != "D" for r in rows)
    entries = ledger(frame(spark, before), frame(spark, after), "normalized", options)
    assert rows_of(totals(entries))[0][:2] == (live(before), live(after))


@pytest.mark.parametrize("crowded", [0, 2, 1 << 20])
@pytest.mark.parametrize("order", ["seq int", "seq struct<a: string, b: int>"])
def test_all_modes_take_one_shuffle_of_the_rows(spark, monkeypatch, tmp_path, crowded, order):
    """Repeated, null and blank keys, a column of one side only; totals as those of the modes' own ledgers."""
    monkeypatch.setattr("keydrift.operators.ledgers.CROWDED", crowded)
    rng = random.Random(crowded)
    column = F.col("seq") if order == "seq int" else F.struct(F.lpad(F.col("seq").cast("string"), 4, "0").alias("a"), F.col("seq").alias("b"))
    sides = []
    for side in ("before", "after"):
        rows = random_rows(rng, 40, 9)
        rows += [{**r, "user_id": k} for r, k in zip(rng.sample(rows, 6), (None, None, "", " ", "K ", "K"))] + rng.sample(rows, 5)
        df = frame(spark, rows).withColumn("seq", column).withColumn(f"only_{side}", F.lit("x"))
        df.repartition(3).write.parquet(str(tmp_path / side))
        sides.append(spark.read.parquet(str(tmp_path / side)))
    modes = ("normalized", "raw", "fingerprint", "presence")
    found = strategy_matrix(*sides, (*modes, "what"), ORDERED)
    got = {r.mode: tuple(map(int, r[1:4])) for r in found.collect()}
    want = {m: tuple(map(int, totals(ledger(*sides, m, ORDERED)).first())) for m in modes}
    assert got == want | {"what": (0, 0, 0)}
    ran = _plan(found).split("Initial Plan")[0]
    assert sum("REPARTITION_BY_COL" in line and "ReusedExchange" not in line for line in ran.splitlines()) == 1


def test_a_diff_that_is_sorted_is_computed_once(spark):
    computed = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            computed.add(batch.num_rows)
            yield batch

    found = spark.createDataFrame([(f"u{i}", "INSERT", "") for i in range(50, 0, -1)], "key string, status string, changed_columns string")
    kept = order_by_key(found.mapInArrow(run, found.schema)).collect()
    assert [r.key for r in kept] == sorted(r.key for r in kept) and len(kept) == 50
    assert computed.value == 50


@pytest.mark.parametrize("keys", [("user_id",), ("user_id", "op_type")])
def test_a_shuffle_without_crowded_buckets_is_read_once(spark, tmp_path, keys):
    """Nor does it carry the text of a key column beside the key, or counts."""
    rows = spark.range(400).selectExpr("concat('k', id) AS user_id", "cast(id as string) AS tags", "'U' AS op_type", "id AS seq")
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    found = diff(rows, rows.where("seq > 3"), options=ORDERED.with_(primary_keys=keys))
    planned = _plan(found)  # the plan that ran leaves out what was read and found empty
    assert planned.count("REPARTITION_BY_COL") == 1 and planned.count("FileScan parquet") == 2
    assert "rows_before" not in planned.split("REPARTITION_BY_COL")[1] and len(found.collect()) == 4


@pytest.mark.parametrize("crowded", [0, 1 << 20])
@pytest.mark.parametrize("key_mode", ["text", "struct"])
def test_ties_are_told_by_the_raw_text_of_keys(spark, monkeypatch, crowded, key_mode):
    """Without an order the last row is the greatest by its raw values in name order, null first; the key column comes before the value."""
    monkeypatch.setattr("keydrift.operators.ledgers.CROWDED", crowded)
    frame_of = lambda *rows: spark.createDataFrame(rows, "id string, part string, value string")
    before = frame_of((" k ", "p", "z"), ("k", "p", "y"), (None, "q", "z"), ("", "q", "y"), (" ", "r||s", "y"), (None, "r||s", "z"), ("a||b", "c", "1"))
    after = frame_of(("k", "p", "y"), ("", "q", "y"), ("", "r||s", "y"), ("a||b", "c", "2"), ("a||b", "c", "1"))
    for keys in (("id", "part"), ("part", "id")):
        found = diff(before, after, options=DiffOptions(primary_keys=keys, key_mode=key_mode), ordered=True)
        assert rows_of(found) == [("||".join({"id": "a||b", "part": "c"}[k] for k in keys), "UPDATE", "value")]
    found = diff(before.drop("part"), after.drop("part"), options=DiffOptions(primary_keys=("id",), key_mode=key_mode), ordered=True)
    assert rows_of(found) == [("a||b", "UPDATE", "value")]


@pytest.mark.parametrize("kinds", [("int", "string"), ("struct<a: int, b: string>",) * 2, ("struct<a: int>", "struct<a: string>")])
def test_the_last_row_by_orders_of_any_type(spark, kinds):
    """Structs, null or not, and other types on the two sides: numbers go by value, texts by code point."""

    def side(kind, rows):
        of = {"int": "seq", "string": "cast(seq as string)", "struct<a: int, b: string>": "if(seq = 0, null, struct(seq AS a, v AS b))",
              "struct<a: int>": "struct(seq AS a)", "struct<a: string>": "struct(cast(seq as string) AS a)"}[kind]
        return spark.createDataFrame(rows, "user_id string, v string, seq int").selectExpr("user_id", "v", f"{of} AS seq")

    rows = [("a", "nine", 9), ("a", "ten", 10), ("b", "none", 0), ("b", "one", 1), ("c", "none", 0)]
    before, after = side(kinds[0], rows), side(kinds[1], rows)
    text_last = "string" in kinds[1].replace(", b: string", "")
    assert rows_of(diff(before, after, options=ORDERED)) == ([("a", "UPDATE", "v")] if text_last else [])


def test_an_error_of_the_input_is_left_to_the_action(spark):
    rows = spark.range(3).selectExpr("if(id < 5, raise_error('broken row'), 'u') AS user_id", "id AS seq")
    found = diff(rows, rows, options=ORDERED)
    with pytest.raises(Exception, match="broken row"):
        found.collect()
