"""Delimited text as all-text DataFrames."""

from __future__ import annotations

import csv
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keydrift.functions.keys import named
from keydrift.functions.text import literal_pattern

# Quoting as in ordinary CSV, where a quote inside quotes is doubled.
DIALECT = {"quote": '"', "escape": '"'}

ROW_ORDER = "_row_order"
HEADER_MODES = ("same", "by_name")

# Endings of packed files that a scan cannot split.
UNSPLIT = r"(?i)\.(gz|deflate|snappy|lz4|zst)$"

# A task that has read the header of a file up to this size reads on to its end, so that its Python worker can be used again.
SMALL_FILE = 4 << 20


def read_delimited(
    spark: SparkSession,
    path: str | Sequence[str],
    delimiter: str = "\t",
    headers: str = "same",
    multi_line: bool = False,
    row_order: bool = False,
    corrupt_column: str | None = None,
    packed_part: int | None = None,
) -> DataFrame:
    """All columns as text, named by the header line; blank fields are null.

    Of a repeated name (in any case) the last column has it, the others are called after it and their place, which
    counts from 0; a column without a name is called ``_c`` and its place.

    ``path`` is a file, a directory, a glob or a list of them, plain or gzip, on
    any file system Spark reaches. With ``headers="same"`` every file must have
    one header, which the scan itself checks. ``"by_name"`` looks at the headers
    up front, all in one job, and lines the columns up by name; absent ones
    are null. ``row_order`` adds a column that sorts rows by file, then by their
    place in it. Short rows are filled with null, surplus fields are dropped;
    ``corrupt_column`` receives the text of such rows. The scan splits files at
    line breaks unless ``multi_line`` allows line breaks inside quotes. A row of
``corrupt_column`` receives the text of such rows. and blank ones before the
    header, are skipped.

    One task reads a file that cannot be split (packed, or with ``multi_line``), and goes on with its rows. With
    ``packed_part``, if such a file is larger than so many bytes, the rows are dealt over partitions, one for so many
    bytes of these files as they are stored. What a query does not read of them is not dealt.
    """
    if headers not in HEADER_MODES:
        raise ValueError(f"headers must be one of {HEADER_MODES}, got {headers!r}")
    paths = [path] if isinstance(path, str) else list(path)
    options = {**DIALECT, "sep": delimiter, "header": True, "multiLine": multi_line}
    try:
        if headers == "by_name":
            rows = _read_by_name(spark, paths, options, row_order, corrupt_column)
        else:
            rows = _scan(spark, paths, options, _one_header(spark, paths, options), row_order, corrupt_column)
        parts = _parts_of_unsplit(spark, paths, multi_line, packed_part) if packed_part else 0
        return rows.repartition(parts) if parts > 1 else rows
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no files match: {', '.join(paths)}") from exc
        raise


def _parts_of_unsplit(spark: SparkSession, paths: list[str], multi_line: bool, packed_part: int) -> int:
    """How many parts of this size the files make that a scan cannot split; 0 if none of them is larger than a part.

    Looks at lengths only, in one job, and brings two numbers to the driver.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", "length")
    unsplit = files if multi_line else files.where(F.col("path").rlike(UNSPLIT))
    sizes = unsplit.agg(F.max("length").alias("largest"), F.sum("length").alias("total")).first()
    return -(-sizes.total // packed_part) if (sizes.largest or 0) > packed_part else 0


def column_names(header: Sequence[str | None]) -> list[str]:
    """Distinct names, in any case, for the fields of a header."""
    left = Counter((h or "").lower() for h in header)
    wanted, taken = [], set()
    for place, name in enumerate(header):
        left[(name or "").lower()] -= 1
        if not name:
            name = f"_c{place}"
        elif left[name.lower()]:
            name = f"{name}{place}"
        wanted.append(name)
    # a plain name goes before one that was made up
    order = sorted(range(len(header)), key=lambda i: wanted[i] != header[i])
    for i in order:
        while wanted[i].lower() in taken:
            wanted[i] += "_"
        taken.add(wanted[i].lower())
    return wanted


def _fields(line: str, delimiter: str) -> list[str]:
    return next(csv.reader([line], delimiter=delimiter), [])


def _one_header(spark: SparkSession, paths: list[str], options: dict) -> list[str | None]:
    """The header of some file; no names if all are empty."""
    if options["multiLine"]:
        first = spark.read.options(**{**options, "header": False}).csv(paths).head(1)
        return list(first[0]) if first else []
    lines = spark.read.text(paths)
    first = lines.where((F.col("_metadata.file_block_start") == 0) & lines.value.rlike(r"\S")).select("value").head(1)
    return _fields(first[0].value, options["sep"]) if first else []


def header_index(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(header, files): each header line that there is, and the files that have it, in one job.

    A task opens one file and reads its beginning: files are not split, and the task of a large one ends with the first line
    that is not blank. Files without such a line are left out.
    """
    session = spark.newSession()
    own = {
        "spark.sql.files.maxPartitionBytes": str(1 << 50),
        "spark.sql.files.openCostInBytes": str(1 << 50),
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    }
    for name, value in {**spark.conf.getAll, **own}.items():
        if session.conf.isModifiable(name):
            session.conf.set(name, value)
    session.conf.unset("spark.sql.files.maxPartitionNum")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = False
        for batch in batches:
            place = 0
            while not found and place < batch.num_rows:
                if found := bool(batch.column(0)[place].as_py().strip()):
                    yield batch.slice(place, 1).select([0, 1])
                    if not batch.column(2)[0].as_py():
                        return
                place += 1

    small = (F.col("_metadata.file_size") <= SMALL_FILE).alias("small")
    lines = session.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("file"), small)
    found = lines.mapInArrow(run, "header string, file string")
    return found.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files"))


def _scan(
    spark: SparkSession,
    paths: list[str],
    options: dict,
    columns: Sequence[str | None],
    row_order: bool,
    corrupt_column: str | None,
    whole_path: bool = False,
) -> DataFrame:
    header = [c or "" for c in columns]
    names = column_names(columns)
    if corrupt_column:
        names.append(corrupt_column)
    schema = ", ".join("`" + n.replace("`", "``") + "` STRING" for n in names)
    parsing = {"sep": options["sep"], **DIALECT}
    if corrupt_column:
        parsing["columnNameOfCorruptRecord"] = corrupt_column
    if options["multiLine"]:
        # the reader checks headers against the columns' names, which are not the header's if some had to be made up
        made_up = names[: len(header)] != header
        df = spark.read.options(**{**options, **parsing}).option("enforceSchema", made_up).schema(schema).csv(paths)
        partitions = df.columns[len(names) :]
    else:
        df = spark.read.text(paths)
        partitions = df.columns[1:]
    file = F.col("_metadata.file_path")
    if len(paths) == 1 and not partitions and not whole_path:
        # One pattern and no partition directories: the fixed head of the path can go.
        file = F.substring_index(file, "/", -_varying_components(paths[0]))
    position = F.struct(
        file.alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        # Only ever compared within one block, and a block is read by one task.
        F.monotonically_increasing_id().alias("line"),
    )
    if options["multiLine"]:
        return df.select("*", *([position.alias(ROW_ORDER)] if row_order else []))
    # A struct is slow to pass through Arrow, its fields are not.
    place = {f"{ROW_ORDER}_{n}": n for n in ("file", "block", "line")} if row_order else {}
    lines = _data_lines(df, [*map(named, partitions), *[position[n].alias(c) for c, n in place.items()]], header, options["sep"])
    kept = [named(c) for c in lines.columns[1 : 1 + len(partitions)]]
    if place:
        kept.append(F.struct(*[F.col(c).alias(n) for c, n in place.items()]).alias(ROW_ORDER))
    parsed = F.from_csv("value", schema, parsing)
    if corrupt_column or len(options["sep"]) > 1:
        return lines.select(parsed.alias("_fields"), *kept).select("_fields.*", *map(named, partitions), *place and [ROW_ORDER])
    # Without a quote a line's fields are what its delimiters part, for which the parser is several times slower.
    plain = ~F.col("value").contains('"') & ~F.col("value").contains("\0")
    split = F.split("value", literal_pattern(options["sep"]))
    fields = lines.select(F.when(plain, split).alias("_parts"), F.when(~plain, parsed).alias("_fields"), *kept)
    return fields.select(
        *[
            F.when(F.col("_parts").isNotNull(), F.nullif(F.get("_parts", F.lit(i)), F.lit("")))
            .otherwise(F.col("_fields")[n])
            .alias(n)
            for i, n in enumerate(names)
        ],
        *map(named, partitions),
        *place and [ROW_ORDER],
    )


def _data_lines(lines: DataFrame, kept: list[Column], header: list[str], delimiter: str) -> DataFrame:
    """The lines without each file's header, which must be ``header`` but for case, and without empty ones.

    A header is the first line of its file that is not blank. Built-in expressions cannot tell the first line of a
    file, as a task may read several files and parts of files, so the lines pass through Arrow batches. (The CSV
    reader can, but it takes rows of blank fields for no rows.)
    """
    wanted = [c.lower() for c in header]

    def names(line: str) -> list[str]:
        return [n.lower() for n in next(csv.reader([line], delimiter=delimiter), [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, headless = None, False
        for batch in batches:
            values, parts = batch.column(0), batch.column(1)
            keep = pc.greater(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).copy()
            runs = pc.run_end_encode(parts)
            begin = 0
            for end, part in zip(runs.run_ends.to_pylist(), runs.values.to_pylist()):
                if part != now:
                    now, headless = part, part >= 0
                at = begin
                while headless and at < end:
                    line = values[at].as_py()
                    if line.strip():
                        if names(line) != wanted:
                            raise ValueError(f"a file has another header than {wanted}: {line[:1000]!r}")
                        headless = False
                    keep[at] = False
                    at += 1
                begin = end
            yield batch.filter(pa.array(keep)).select([0, *range(2, batch.num_columns)])

    # of a file's first part its hash, without sign; of later parts, which have no header, -1
    file = F.xxhash64("_metadata.file_path").bitwiseAND(F.lit((1 << 63) - 1))
    part = F.when(F.col("_metadata.file_block_start") == 0, file).otherwise(F.lit(-1).cast("bigint"))
    rows = lines.select("value", part.alias("_part"), *kept)
    return rows.mapInArrow(run, rows.drop("_part").schema)


def _varying_components(path: str) -> int:
    """How many trailing path components tell the files of ``path`` apart.

    Row order carries this part of the file's path with every row. A pattern may
    match directories, so the part may reach one component further down.
    """
    components = path.rstrip("/").split("/")
    globbed = [i for i, c in enumerate(components) if re.search(r"[*?\[{]", c)]
    return len(components) - globbed[0] + 1 if globbed else 1


def _read_by_name(
    spark: SparkSession, paths: list[str], options: dict, row_order: bool, corrupt_column: str | None
) -> DataFrame:
    groups: dict[tuple[str | None, ...], list[str]] = {}
    if options["multiLine"]:
        groups = _headers_of_blocks(spark, paths, options)
    else:
        for row in sorted(header_index(spark, paths).collect(), key=lambda row: row.files):
            groups.setdefault(tuple(_fields(row.header, options["sep"])), []).extend(map(_literal, row.files))
    if len(groups) <= 1:
        return _scan(spark, paths, options, list(*groups), row_order, corrupt_column)  # also if no file has a header
    scans = [
        _scan(spark, members, options, list(names), row_order, corrupt_column, whole_path=True)
        for names, members in groups.items()
    ]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), scans)


def _literal(file: str) -> str:
    """A listed file as a path: the listed names are names, not patterns."""
    return re.sub(r"([*?\[\]{}\\])", r"\\\1", unquote(file))


def _headers_of_blocks(spark: SparkSession, paths: list[str], options: dict) -> dict[tuple[str | None, ...], list[str]]:
    """The files of each header that may go over several lines: a look at one file after the other."""
    groups: dict[tuple[str | None, ...], list[str]] = {}
    for file in map(_literal, sorted(spark.read.text(paths).inputFiles())):
        if header := _one_header(spark, [file], options):
            groups.setdefault(tuple(header), []).append(file)
    return groups
