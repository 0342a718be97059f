import gzip
import json
import random
from pathlib import Path

import keydrift.plans.generator as gen
import pytest
from keydrift.functions.rng import u64, u64_of, unit_double, unsigned_mod, with_draws, wrapping_arithmetic
from keydrift.operators import diff
from keydrift.options import DiffOptions, GeneratorOptions
from keydrift.plans.comparison import read_pair
from pyspark.sql import functions as F


def test_published_values():
    """The first number of splitmix64 for two published seeds."""
    assert u64_of(1234567, 0, 0) == 6457827717110365317
    assert u64_of(0, 0, 0) == 0xE220A8397B1DCDAF


def test_columns_agree_with_the_driver(spark):
    rng = random.Random(5)
    indices = [0, 1, 2, 10**6, 10**12] + [rng.randrange(1 << 40) for _ in range(200)]
    rows = spark.createDataFrame([(i,) for i in indices], "idx bigint")
    for seed in (42, 0, -3, (1 << 64) - 5):
        with wrapping_arithmetic(spark):
            column = u64(seed, F.col("idx"), 7)
            df = with_draws(rows, seed, F.col("idx"), {"staged": 7}).select(
                "idx",
                "staged",
                column.alias("direct"),
                u64(seed, F.col("idx"), F.lit(7)).alias("dynamic"),
                unit_double(column).alias("unit"),
                unsigned_mod(column, 90_000_000).alias("rest"),
            )
        for r in df.collect():
            bits = u64_of(seed, r["idx"], 7)
            assert r["staged"] % (1 << 64) == r["direct"] % (1 << 64) == r["dynamic"] % (1 << 64) == bits
            assert r["unit"] == bits / float(1 << 64)
            assert r["rest"] == bits % 90_000_000


def test_the_session_keeps_its_own_overflow_setting(spark):
    before = spark.conf.get("spark.sql.ansi.enabled")
    with pytest.raises(RuntimeError), wrapping_arithmetic(spark):
        raise RuntimeError
    assert spark.conf.get("spark.sql.ansi.enabled") == before


def test_operation_shares():
    assert gen.parse_optype_ratio("u:1, I:1 ,D:2") == [("U", 0.25), ("I", 0.5), ("D", 1.0)]
    with pytest.raises(ValueError, match="unknown op_type"):
        gen.parse_optype_ratio("U:1,X:1")
    with pytest.raises(ValueError, match="more than 0"):
        gen.parse_optype_ratio("U:0,I:0")
    with pytest.raises(ValueError, match="timestyle"):
        GeneratorOptions(timestyle="iso")


@pytest.mark.parametrize("n", [2, 9, 100, 101])
def test_row_order_is_one_to_one(spark, n):
    options = GeneratorOptions(rows=n)
    for side in gen.SIDES:
        rows = spark.range(n).select(gen.permuted_index(options, side, F.col("id")).alias("i")).collect()
        assert sorted(r["i"] for r in rows) == list(range(n))


def test_row_order_of_very_many_rows(spark):
    n = 5_000_000_000
    options = GeneratorOptions(rows=n)
    factor, shift = gen.permutation(options, "after")
    assert factor * n > 1 << 63
    positions = [0, 1, n // 2, n - 1]
    df = spark.createDataFrame([(p,) for p in positions], "p bigint")
    got = df.select("p", gen.permuted_index(options, "after", F.col("p")).alias("i")).collect()
    assert {r["p"]: r["i"] for r in got} == {p: (factor * p + shift) % n for p in positions}


@pytest.mark.parametrize("total, files", [(10, 3), (3, 5), (12, 4), (1, 1)])
def test_files_take_near_equal_runs(spark, total, files):
    got = spark.range(total).select("id", gen.file_of_rank(F.col("id"), total, files).alias("f")).orderBy("id")
    assigned = [r["f"] for r in got.collect()]
    sizes = [assigned.count(f) for f in range(files)]
    assert assigned == sorted(assigned) and sum(sizes) == total
    assert sizes == sorted(sizes, reverse=True) and sizes[0] - sizes[-1] <= 1


def test_long_lists_follow_the_same_rule(spark, monkeypatch):
    options = GeneratorOptions(missing_rate=0.2, mismatch_rate=0.5)
    indices = spark.range(40).withColumnRenamed("id", "idx")
    for side in gen.SIDES:
        spelled = sorted(gen.side_rows(indices, options, side).collect())
        monkeypatch.setattr(gen, "SPELLED_OUT", 0)
        assert sorted(gen.side_rows(indices, options, side).collect()) == spelled
        monkeypatch.undo()
    long = gen.side_rows(indices, options.with_(avg_tags=20), "after").select(F.size(F.split("tags", "\\|")).alias("n"))
    assert {r["n"] for r in long.collect()} <= {19, 20, 21}


def parts(folder):
    return sorted(p for p in Path(folder).iterdir() if p.name.startswith("part-"))


@pytest.mark.parametrize("packed", [False, True])
def test_generate_and_compare(spark, tmp_path, packed):
    options = GeneratorOptions(
        rows=700, num_files=4, gzip=packed, missing_rate=0.1, mismatch_rate=0.2, optype_ratio="U:0.9,I:0.1"
    )
    manifest = gen.generate(spark, str(tmp_path / "d"), options)
    assert json.loads((tmp_path / "d/manifest.json").read_text()) == manifest
    opener = gzip.open if packed else open
    for side in gen.SIDES:
        texts = []
        for part in parts(tmp_path / "d" / side):
            assert part.name.endswith(".tsv.gz" if packed else ".tsv")
            with opener(part, "rt") as f:
                texts.append(f.read())
        assert len(texts) == 4 == len(manifest[f"{side}_files"])
        assert all(t.startswith("user_id\ttags\tlevels\tts\top_type\n") for t in texts)
        counts = [t.count("\n") - 1 for t in texts]
        assert sum(counts) == manifest[f"rows_{side}"] and max(counts) - min(counts) <= 1
        assert sum(len(t.encode()) for t in texts) == manifest[f"{side}_uncompressed_est_bytes"]
    # Rows stand in the side's order, file after file.
    order = [(f * k + s) % 700 for f, s in [gen.permutation(options, "after")] for k in range(700)]
    ids = [int(line[2:11]) for t in texts for line in t.splitlines()[1:]]
    assert ids == [i for i in order if i in set(ids)]

    rules = DiffOptions(strictness="B", text_list_columns=("ts",))
    before, after, rules = read_pair(spark, f"{tmp_path}/d/before/part-*", f"{tmp_path}/d/after/part-*", rules)
    found = {r["key"]: (r["status"], r["changed_columns"]) for r in diff(before, after, options=rules).collect()}
    with wrapping_arithmetic(spark):
        flags = gen.presence(options, gen.bits_of(options, F.col("id")))
        plan = spark.range(700).select("id", *[f.alias(n) for f, n in zip(flags, ("b", "a", "m"))]).collect()
    expected = {}
    for i, in_before, in_after, mismatch in plan:
        if not in_before:
            expected[f"a.{i:09d}"] = "INSERT"
        elif not in_after:
            expected[f"a.{i:09d}"] = "DELETE"
        elif mismatch:
            expected[f"a.{i:09d}"] = "UPDATE"
    assert {k: s for k, (s, _) in found.items()} == expected
    assert {c for s, c in found.values() if s == "UPDATE"} == {"tags", "levels", "ts"}
    assert manifest["mismatch_rows"] == sum(s == "UPDATE" for s in expected.values())


def test_written_files_grow_with_the_rows(spark, tmp_path, monkeypatch):
    from registry import queries

    spark.range(1000).selectExpr("id AS o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    counted = []
    write = queries.write_delimited
    monkeypatch.setattr(queries, "write_delimited", lambda rows, *a, **k: counted.append(rows.rdd.getNumPartitions()) or write(rows, *a, **k))
    few = sorted(map(tuple, queries.gen_write(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(queries, "ROWS_OF_FILE", 120)
    assert sorted(map(tuple, queries.gen_write(spark, str(tmp_path)).collect())) == few
    assert counted == [5, 9]
