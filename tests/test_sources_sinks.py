import csv
import gzip
import json
from pathlib import Path

import pytest
from keydrift.operators import diff, last_per_key
from keydrift.options import DiffOptions
from keydrift.plans.comparison import benchmark, compare, read_pair, resolve_modes, strategy_matrix
from keydrift.plans.durable import stored
from keydrift.plans.job import run_job
from keydrift.sinks import publish_dataset, read_diff, write_diff
from keydrift.sources import ROW_ORDER, read_delimited
from pyspark.sql import functions as F

HEADER = "user_id\ttags\tlevels\ttimestamps\top_type\n"
BEFORE = HEADER + "u1\t2|1\t10|2\t2026-01-07 00:00:00\tU\nu2\tB|A\tX|3\t2026-01-08 00:00:00\tD\n"
AFTER = HEADER + "u1\t1|2\t2|10\t2026-01-07T00:00:00\tU\nu3\tA|C\t3|X\t2026-01-08 00:00:00\tI\n"


@pytest.fixture
def pair(tmp_path):
    (tmp_path / "before.tsv").write_text(BEFORE)
    (tmp_path / "after.tsv").write_text(AFTER)
    return str(tmp_path / "before.tsv"), str(tmp_path / "after.tsv")


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_delimiters_and_text_only(spark, tmp_path):
    (tmp_path / "x.csv").write_text('col1,col2,col3\n1,"a,""b""",2026-01-01\n02,,c\\\n')
    df = read_delimited(spark, str(tmp_path / "x.csv"), ",")
    assert [t for _, t in df.dtypes] == ["string"] * 3
    assert df.collect() == [("1", 'a,"b"', "2026-01-01"), ("02", None, "c\\")]


def test_header_only(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("col1\tcol2\tcol3\n")
    df = read_delimited(spark, str(tmp_path / "x.tsv"))
    assert df.columns == ["col1", "col2", "col3"] and df.count() == 0


@pytest.mark.parametrize("headers", ["same", "by_name"])
def test_nothing_matches(spark, tmp_path, headers):
    with pytest.raises(FileNotFoundError, match="no files match"):
        read_delimited(spark, str(tmp_path / "*.tsv"), headers=headers)


def test_ragged_rows(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("a\tb\tc\n1\n1\t2\t3\t4\n\n1\t2\t3\n")
    df = read_delimited(spark, str(tmp_path / "x.tsv"), corrupt_column="bad")
    assert df.collect() == [("1", None, None, "1"), ("1", "2", "3", "1\t2\t3\t4"), ("1", "2", "3", None)]


@pytest.mark.parametrize("headers", ["same", "by_name"])
def test_rows_of_large_packed_files_are_dealt(spark, tmp_path, headers):
    lines = [f"u{i}\t{i * 7919 % 1000003}\n" for i in range(3000)]
    with gzip.open(tmp_path / "a.tsv.gz", "wt") as out:
        out.write("user_id\tv\n" + "".join(lines))
    (tmp_path / "b.tsv").write_text("user_id\tv\nu1\tlast\n")
    size = (tmp_path / "a.tsv.gz").stat().st_size
    path = f"{tmp_path}/*.tsv*"
    plain = read_delimited(spark, path, headers=headers, row_order=True)
    dealt = read_delimited(spark, path, headers=headers, row_order=True, packed_part=size // 4)
    assert dealt.rdd.getNumPartitions() == 5
    counts = [r[0] for r in dealt.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(counts) == 5 and max(counts) < 1000
    assert rows_of(dealt.drop(ROW_ORDER)) == rows_of(plain.drop(ROW_ORDER))
    last = lambda df: {r.user_id: r.v for r in last_per_key(df, ["user_id"], [ROW_ORDER]).collect()}
    assert last(dealt) == last(plain) and last(dealt)["u1"] == "last"
    # small files, plain ones and an absent setting leave the scan as it is
    for where, part in ((path, size), (f"{tmp_path}/b.tsv", 1), (path, None)):
        assert "RoundRobin" not in read_delimited(spark, where, headers=headers, packed_part=part)._jdf.queryExecution().toString()


def test_line_breaks_in_quotes(spark, tmp_path):
    (tmp_path / "x.tsv").write_text('a\tb\n"1\n2"\tx\n')
    assert read_delimited(spark, str(tmp_path / "x.tsv"), multi_line=True).collect() == [("1\n2", "x")]


def test_plain_and_gzip_files_together(spark, tmp_path):
    (tmp_path / "part-0.tsv").write_text("a\tb\n1\tx\n")
    with gzip.open(tmp_path / "part-1.tsv.gz", "wt") as f:
        f.write("a\tb\n2\ty\n")
    for headers in ("same", "by_name"):
        df = read_delimited(spark, str(tmp_path / "part-*"), headers=headers)
        assert rows_of(df) == [("1", "x"), ("2", "y")]


def test_differing_headers(spark, tmp_path):
    (tmp_path / "1.tsv").write_text("a\tb\n1\tx\n")
    (tmp_path / "2.tsv").write_text("b\ta\ny\t2\n")
    (tmp_path / "3.tsv").write_text("a\tc\n3\tz\n")
    df = read_delimited(spark, str(tmp_path / "*.tsv"), headers="by_name", row_order=True)
    assert df.columns == ["a", "b", ROW_ORDER, "c"]
    assert df.orderBy(ROW_ORDER).select("a", "b", "c").collect() == [
        ("1", "x", None),
        ("2", "y", None),
        ("3", None, "z"),
    ]
    with pytest.raises(Exception, match="header"):
        read_delimited(spark, str(tmp_path / "*.tsv")).collect()


@pytest.mark.parametrize("headers", ["same", "by_name"])
@pytest.mark.parametrize("multi_line", [False, True])
def test_repeated_and_blank_names(spark, tmp_path, headers, multi_line):
    (tmp_path / "x.tsv").write_text('a\t\tA\t"a"\t_c1\n1\t2\t3\t4\t5\n\t\t\t\t6\n')
    df = read_delimited(spark, str(tmp_path / "x.tsv"), headers=headers, multi_line=multi_line)
    assert df.columns == ["a0", "_c1_", "A2", "a", "_c1"]  # the last one has the name
    assert df.orderBy("_c1").collect() == [("1", "2", "3", "4", "5"), (None, None, None, None, "6")]


def test_headers_that_repeat_a_name_line_up(spark, tmp_path):
    (tmp_path / "1.tsv").write_text("k\tv\tv\n1\tx\ty\n")
    (tmp_path / "2.tsv").write_text("v\tk\nz\t2\n")
    df = read_delimited(spark, str(tmp_path), headers="by_name", row_order=True)
    assert df.orderBy(ROW_ORDER).select("k", "v1", "v").collect() == [("1", "x", "y"), ("2", None, "z")]


def test_headers_take_as_many_jobs_for_many_files_as_for_few(spark, tmp_path):
    counts = []
    for n in (100, 200):
        folder = tmp_path / str(n)
        folder.mkdir()
        for i in range(n):
            (folder / f"{i:03}.tsv").write_text(("\n  \n" if i % 2 else "") + ("a\tb\n1\t2\n" if i % 3 else "b\tc\n2\t3\n"))
        (folder / "empty.tsv").write_text("")
        spark.sparkContext.setJobGroup(f"headers-{n}", "")
        df = read_delimited(spark, str(folder), headers="by_name")
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"headers-{n}")))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert df.groupBy("a", "b", "c").count().orderBy("c").collect() == [("1", "2", None, n - -(-n // 3)), (None, "2", "3", -(-n // 3))]
    assert counts[0] == counts[1] <= 6  # the listing of many paths is a job, too


def test_count_and_single_columns_pass_the_header_check(spark, pair):
    df = read_delimited(spark, pair[0])
    assert df.count() == 2
    assert rows_of(df.select("op_type")) == [("D",), ("U",)]


@pytest.mark.parametrize("headers", ["same", "by_name"])
@pytest.mark.parametrize("pattern", ["d/*.tsv", "d", "*/*.tsv", "*"])
def test_the_last_file_wins_whatever_its_size(spark, tmp_path, headers, pattern):
    folder = tmp_path / "d"
    folder.mkdir()
    (folder / "1.tsv").write_text("k\tv\n" + "a\tfirst\n" * 3000 + "a\tfirst-end\nb\tonly\n")
    (folder / "2.tsv").write_text("k\tv\na\tlast\n")
    df = read_delimited(spark, str(tmp_path / pattern), headers=headers, row_order=True)
    assert rows_of(last_per_key(df, ["k"], [ROW_ORDER]).select("k", "v")) == [("a", "last"), ("b", "only")]
    (folder / "2.tsv").write_text("k\tv\nc\tnew\n")
    df = read_delimited(spark, str(tmp_path / pattern), headers=headers, row_order=True)
    assert ("a", "first-end") in rows_of(last_per_key(df, ["k"], [ROW_ORDER]).select("k", "v"))


def test_line_order_across_splits(spark, tmp_path):
    """Small splits: one file is read by many tasks, and its last line still wins."""
    (tmp_path / "x.tsv").write_text("k\tv\n" + "".join(f"k{i % 3}\t{i}\n" for i in range(20_000)))
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    df = read_delimited(session, str(tmp_path / "x.tsv"), row_order=True)
    assert df.rdd.getNumPartitions() > 4
    got = rows_of(last_per_key(df, ["k"], [ROW_ORDER]).select("k", "v"))
    assert got == [("k0", "19998"), ("k1", "19999"), ("k2", "19997")]


def files(path, suffix):
    return sorted(p for p in Path(path).iterdir() if p.name.startswith("part-") and p.name.endswith(suffix))


def test_diff_file_reads_like_ordinary_csv(spark, tmp_path):
    rows = [('b"q', "INSERT", ""), (" lead", "DELETE", ""), ("c,d", "UPDATE", "x|y"), ("back\\", "INSERT", "")]
    found = spark.createDataFrame(rows, "key string, status string, changed_columns string")
    out = str(tmp_path / "diff")
    write_diff(found, out, single_file=True)
    write_diff(found, out, single_file=True)
    (part,) = files(out, ".csv")
    with part.open(newline="") as f:
        assert list(csv.reader(f)) == [["key", "status", "changed_columns"], *map(list, sorted(rows))]
    assert rows_of(read_diff(spark, out)) == sorted(rows)
    write_diff(found, out, single_file=True, line_separator="\r\n")
    (part,) = files(out, ".csv")
    assert part.read_bytes().startswith(b"key,status,changed_columns\r\n lead,DELETE,\r\n")


def test_compare_writes_and_counts(spark, pair, tmp_path):
    before, after, options = read_pair(spark, *pair)
    result = compare(before, after, str(tmp_path / "out"), options=options)
    assert (result.rows_before, result.rows_after, result.rows_diff) == (1, 2, 2)
    assert result.diff_path == str(tmp_path / "out/diff/normalized")
    assert rows_of(read_diff(spark, result.diff_path)) == [("u1", "UPDATE", "timestamps"), ("u3", "INSERT", "")]


def test_an_empty_diff_is_written_too(spark, pair, tmp_path):
    before, after, options = read_pair(spark, pair[0], pair[0])
    for mode, expanded in (("normalized", False), ("fingerprint", False), ("fingerprint", True)):
        result = compare(before, after, str(tmp_path / "out"), mode, options, expanded=expanded)
        assert result.rows_diff == 0
        counted = ",n_rows" if mode == "fingerprint" and not expanded else ""
        assert files(result.diff_path, ".csv")[0].read_text() == f"key,status,changed_columns{counted}\n"


def test_benchmark_reports_failures(spark, pair, tmp_path):
    before, after, options = read_pair(spark, *pair)
    out = tmp_path / "out"
    results = benchmark(before, after, str(out), ["normalized", "nonsense", "presence"], options)
    assert [(r.mode, r.success, r.rows_diff) for r in results] == [
        ("normalized", True, 2),
        ("nonsense", False, 0),
        ("presence", True, 3),
    ]
    stored = json.loads((out / "benchmark.json").read_text())
    assert [r["mode"] for r in stored] == ["normalized", "nonsense", "presence"]
    text = (out / "benchmark.md").read_text()
    assert "|presence|True|" in text and "unknown comparison mode" in text
    matrix = strategy_matrix(before, after, ["normalized", "nonsense"], options).collect()
    assert [(r["mode"], r["success"], r["rows_diff"]) for r in matrix] == [
        ("normalized", True, 2),
        ("nonsense", False, 0),
    ]


@pytest.mark.parametrize(
    ("old", "new"),
    [("ab", "abb"), ("aab", "b"), ("b", "baa"), ("aab", "aab")],
)
def test_unique_keys_are_checked(spark, tmp_path, old, new):
    def side(keys):
        return spark.createDataFrame([(k, "x") for k in keys], "user_id string, tags string")

    options = DiffOptions(unique_keys=True)
    assert compare(side("ab"), side("bc"), str(tmp_path), options=options).rows_diff == 2
    with pytest.raises(ValueError, match="repeats"):
        compare(side(old), side(new), str(tmp_path), options=options)


def test_modes_and_aliases():
    assert resolve_modes("duckdb, duckdb-opt,polars") == ["normalized", "raw"]
    assert resolve_modes(" ALL ") == ["normalized", "raw", "fingerprint", "presence"]
    assert resolve_modes(["presence", "polars-opt"]) == ["presence"]


def test_job(spark, pair, tmp_path):
    out = "file://" + str(tmp_path / "out")
    conf = {"before": "file://" + pair[0], "after": "file://" + pair[1], "out": out, "strictness": "b"}
    summary = run_job(spark, conf)
    assert summary["result"]["rows_diff"] == 2
    assert json.loads((tmp_path / "out/summary.json").read_text()) == summary
    summary = run_job(spark, {**conf, "action": "benchmark", "engines": "duckdb,polars-opt"})
    assert [r["mode"] for r in summary["results"]] == ["normalized", "presence"]
    with pytest.raises(ValueError, match="strictness"):
        run_job(spark, {**conf, "strictness": "C"})
    with pytest.raises(ValueError, match="action"):
        run_job(spark, {**conf, "action": "wipe"})
    with pytest.raises(ValueError, match="unknown comparison mode"):
        run_job(spark, {**conf, "modes": "other"})
    with pytest.raises(ValueError, match="unknown settings: headres"):
        run_job(spark, {**conf, "headres": "same"})
    with pytest.raises(KeyError, match="out_prefix"):
        run_job(spark, {"bucket": "b", "before_key": "x", "after_key": "y"})


def test_benchmark_job_reads_its_files_once(spark, pair, tmp_path, monkeypatch):
    from keydrift.plans import job

    taken, run = [], job.benchmark

    def looked_at(before, after, *args, **kw):
        for df in (before, after):
            plan = df._jdf.queryExecution().executedPlan().toString()
            taken.append(("FileScan text" in plan or "MapInArrow" in plan, df.schema[ROW_ORDER].nullable, df.inputFiles()))
        return run(before, after, *args, **kw)

    monkeypatch.setattr(job, "benchmark", looked_at)
    conf = {"before": pair[0], "after": pair[1], "out": str(tmp_path / "out"), "modes": "all"}
    results = run_job(spark, {**conf, "action": "benchmark"})["results"]
    assert [(parsed, nullable) for parsed, nullable, _ in taken] == [(False, False)] * 2
    assert not any(Path(f.removeprefix("file://")).exists() for *_, files in taken for f in files)
    totals = ("mode", "rows_before", "rows_after", "rows_diff", "success")
    alone = [run_job(spark, {**conf, "modes": r["mode"]})["result"] for r in results]
    assert [[r[n] for n in totals] for r in results] == [[r[n] for n in totals] for r in alone]


def test_benchmark_job_reports_files_that_cannot_be_read(spark, pair, tmp_path):
    (tmp_path / "odd").mkdir()
    for name, text in (("a.tsv", "user_id\ttags\n1\tx\n"), ("b.tsv", "other\ttags\n2\ty\n")):
        (tmp_path / "odd" / name).write_text(text)
    conf = {"before": str(tmp_path / "odd"), "after": pair[1], "out": str(tmp_path / "out"), "action": "benchmark", "modes": "all"}
    results = run_job(spark, conf)["results"]
    assert [(r["mode"], r["success"], "header" in r["reason"]) for r in results] == [(m, False, True) for m in resolve_modes("all")]


def test_stored_rows_keep_names_types_and_nulls(spark):
    rows = [("a", None, 1, (1, "x")), (None, "b", None, (None, "y"))]
    df = spark.createDataFrame(rows, "`a b,;{}` string, `A=` string, n int, s struct<`i j`: int, t: string>")
    whole = df.select("*", F.struct("n", F.lit("z").alias("odd name")).alias("order"))
    with stored(whole, df) as (first, second):
        assert sorted(first.collect(), key=str) == sorted(whole.collect(), key=str)
        assert first.columns == whole.columns and not first.schema["order"].nullable and second.schema["s"].nullable
        assert [f.dataType.simpleString() for f in first.schema] == [f.dataType.simpleString() for f in whole.schema]
        assert second.count() == 2


def test_publish(spark, pair, tmp_path):
    for side, text in (("before", BEFORE), ("after", AFTER)):
        (tmp_path / "src" / side).mkdir(parents=True)
        (tmp_path / "src" / side / "part-00000.tsv").write_text(text)
    (tmp_path / "src" / "manifest.json").write_text('{"rows_before": 2}')
    target = "file://" + str(tmp_path / "dst")
    written = publish_dataset(spark, str(tmp_path / "src"), target)
    assert written == [f"{target}/before", f"{target}/after", f"{target}/manifest.json"]
    before, after, options = read_pair(spark, f"{target}/before", f"{target}/after")
    assert diff(before, after, options=options).count() == 2
    assert json.loads((tmp_path / "dst/manifest.json").read_text()) == {"rows_before": 2}
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError, match="nothing to publish"):
        publish_dataset(spark, str(tmp_path / "empty"), target)


def test_headers_are_checked_with_a_corrupt_column_too(spark, tmp_path):
    (tmp_path / "1.tsv").write_text("k\tv\n1\tx\n")
    (tmp_path / "2.tsv").write_text("v\tk\ny\t2\n")
    with pytest.raises(Exception, match="header"):
        read_delimited(spark, str(tmp_path), corrupt_column="bad").collect()


def test_rows_of_blank_fields_are_rows(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("\n \nk\tv\n\t\n1\tx\n\n \t \n")
    (tmp_path / "b.tsv").write_text("k\tv\n")
    (tmp_path / "c.tsv").write_text("")
    (tmp_path / "d.tsv").write_text("k\tv\nk\tv\n   \n")
    df = read_delimited(spark, str(tmp_path), row_order=True)
    got = [(r.k, r.v) for r in df.orderBy(ROW_ORDER).collect()]
    assert got == [(None, None), ("1", "x"), (" ", " "), ("k", "v"), ("   ", None)]


def test_headers_of_split_files(spark, tmp_path):
    for name, n in (("a", 3000), ("b", 2), ("c", 2500)):
        (tmp_path / f"{name}.tsv").write_text("k\tv\n" + "".join(f"{name}{i:04}\t\n" for i in range(n)))
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    session.conf.set("spark.sql.files.openCostInBytes", "1")
    df = read_delimited(session, str(tmp_path), row_order=True)
    assert df.rdd.getNumPartitions() > 5
    want = [f"{name}{i:04}" for name, n in (("a", 3000), ("b", 2), ("c", 2500)) for i in range(n)]
    assert [r.k for r in df.orderBy(ROW_ORDER).collect()] == want


def test_empty_files_and_bracketed_names(spark, tmp_path):
    (tmp_path / "a[1].tsv").write_text("k\tv\n1\tx\n")
    (tmp_path / "b.tsv").write_text("v\tk\ny\t2\n")
    (tmp_path / "c.tsv").write_text("")
    df = read_delimited(spark, str(tmp_path), headers="by_name")
    assert rows_of(df.select("k", "v")) == [("1", "x"), ("2", "y")]


@pytest.mark.parametrize("direct", [True, False])
def test_publishing_keeps_names_and_bytes(spark, tmp_path, monkeypatch, direct):
    folder = tmp_path / "src" / "after"
    folder.mkdir(parents=True)
    held = {"part-00000.tsv": b"k\tv\r\n1\t\xff\r\n", "part-00001.tsv.gz": gzip.compress(b"k\n"), "part-x=%41.tsv": b"", "part-2.tsv": b"no end"}
    for name, content in held.items():
        (folder / name).write_bytes(content)
    (folder / "_SUCCESS").write_text("")
    stale = tmp_path / "dst" / "after"
    stale.mkdir(parents=True)
    (stale / "part-9.tsv").write_text("old")
    if not direct:
        monkeypatch.setattr("keydrift.sinks.publish._DIRECT", {})
    publish_dataset(spark, str(tmp_path / "src"), str(tmp_path / "dst"))
    copied = {p.name: p.read_bytes() for p in stale.iterdir() if not p.name.startswith(".")}
    assert copied == held
    with pytest.raises(ValueError, match="nothing to publish"):
        publish_dataset(spark, str(tmp_path / "nowhere"), str(tmp_path / "dst"))


def test_publishing_keeps_every_line_in_order(spark, tmp_path):
    folder = tmp_path / "src" / "before"
    folder.mkdir(parents=True)
    texts = ["k\tv\n" + "".join(f"{i}\t{n}\n" for i in range(n)) + "\t\n\n" for n in (2000, 3, 900)]
    (folder / "part-0.tsv").write_text(texts[0])
    with gzip.open(folder / "part-1.tsv.gz", "wt") as f:
        f.write(texts[1])
    (folder / "part-2.tsv").write_text(texts[2])
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    (target,) = publish_dataset(session, str(tmp_path / "src"), str(tmp_path / "dst"))
    parts = sorted(p for p in Path(target).iterdir() if p.name.startswith("part-") and p.stat().st_size)
    got = [(gzip.open(p, "rt") if p.suffix == ".gz" else p.open()).read() for p in parts]
    assert [t for t in got if t] == texts


def test_lines_without_quotes_have_the_parser_s_fields(spark, tmp_path):
    pieces = ["", " ", "a", "é|", "\\", "\x01", "\x1f ", "#", ",", "　", "-"]
    lines = ["\t".join(pieces[(i * k + i // 7) % len(pieces)] for k in range(1, 2 + i % 6)) for i in range(400)]
    lines += ['"x\ty"\tz', 'a"b\tc', '"', "\x00a\tb", "a\x00\tb\tc\td", '""\t""']
    (tmp_path / "x.tsv").write_bytes("\n".join(["p\tq\tr", *lines]).encode() + b"\n\xff\xfe\ta\n")
    df = read_delimited(spark, str(tmp_path / "x.tsv"), row_order=True)
    text = spark.read.text(str(tmp_path / "x.tsv")).where("value <> 'p\tq\tr' AND value <> ''")
    parsed = text.select(F.from_csv("value", "p STRING, q STRING, r STRING", {"sep": "\t", "quote": '"', "escape": '"'}).alias("f"))
    key = lambda row: tuple("" if v is None else f"={v}" for v in row)
    assert sorted(map(key, df.drop(ROW_ORDER).collect())) == sorted(map(key, parsed.select("f.*").collect()))
    assert "split(" in df._jdf.queryExecution().optimizedPlan().toString()
    assert df.schema[ROW_ORDER].dataType.names == ["file", "block", "line"]


def test_ordered_snapshots_sort_the_given_columns(spark, tmp_path):
    from registry.snapshots import line_snapshots

    schema = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_returnflag string, l_shipdate timestamp_ntz"
    rows = spark.range(300).selectExpr(
        "id div 3 AS l_orderkey", "CAST(id % 3 AS int) AS l_linenumber", "id * 37 % 11 AS l_partkey", "id % 5 AS l_suppkey",
        "IF(id % 7 = 0, NULL, CAST(id % 9 AS double)) AS l_quantity", "IF(id % 2 = 0, 'R', 'N') AS l_returnflag",
        "IF(id % 11 = 0, NULL, CAST(CAST('2020-01-01' AS date) + CAST(id * 13 % 17 AS int) AS timestamp_ntz)) AS l_shipdate",
    )
    rows.to(spark.createDataFrame([], schema).schema).write.parquet(str(tmp_path / "lineitem.parquet"))
    for plain, ordered in zip(line_snapshots(spark, str(tmp_path)), line_snapshots(spark, str(tmp_path), ordered=True)):
        wanted = plain.orderBy("seq").select("seq").collect()
        assert ordered.select("seq").collect() == wanted
        assert sorted(map(str, ordered.collect())) == sorted(map(str, plain.collect()))
