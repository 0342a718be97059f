"""The same answers as plain SQL over the given tables.

Written for DuckDB, from the rules rather than from the Spark plans.
"""

from __future__ import annotations

from registry.queries import GENERATOR

# Fixed values, stated here once more so that these queries check the engine's.
SPACE_CODES = (*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)
SPACE = "'" + "".join(map(chr, SPACE_CODES)) + "'"
WORD = 1 << 64
INDEX_MULTIPLIER = 0x9E3779B185EBCA87
STREAM_MULTIPLIER = 0xD1B54A32D192ED03
INCREMENT = 0x9E3779B97F4A7C15
FIRST_MULTIPLIER = 0xBF58476D1CE4E5B9
SECOND_MULTIPLIER = 0x94D049BB133111EB
OPERATIONS = (("U", 0.9), ("I", 0.98), ("D", 1.0))
SHUFFLES = {"before": {"tags": 700, "levels": 710, "ts": 720}, "after": {"tags": 730, "levels": 740, "ts": 750}}
MUTATIONS = {"tags": (761, "99999999"), "levels": (762, "99"), "ts": (763, "2026-02-01 00:00:00")}


# --- text --------------------------------------------------------------------------------


def clean(x: str) -> str:
    return f"trim(coalesce(CAST({x} AS VARCHAR), ''), {SPACE})"


def items(x: str, sep: str = "|") -> str:
    parts = f"list_transform(string_split({clean(x)}, '{sep}'), lambda t: trim(t, {SPACE}))"
    return f"list_filter({parts}, lambda t: t <> '')"


def text_list(x: str, sep: str = "|") -> str:
    return f"coalesce(array_to_string(list_sort({items(x, sep)}), '{sep}'), '')"


def is_int(t: str) -> str:
    return f"regexp_full_match({t}, '[+-]?[0-9]+(_[0-9]+)*')"


def int_value(t: str) -> str:
    return f"CASE WHEN {is_int(t)} THEN CAST(replace({t}, '_', '') AS HUGEINT) ELSE 0 END"


def shown(t: str) -> str:
    return f"CASE WHEN {is_int(t)} THEN CAST({int_value(t)} AS VARCHAR) ELSE {t} END"


def int_list(x: str) -> str:
    keyed = (
        f"list_transform({items(x)}, lambda t: struct_pack(k := CASE WHEN {is_int('t')} THEN 0 ELSE 1 END, "
        f"n := {int_value('t')}, s := {shown('t')}))"
    )
    return f"coalesce(array_to_string(list_transform(list_sort({keyed}), lambda e: e.s), '|'), '')"


def op_code(x: str) -> str:
    return f"CASE WHEN upper({clean(x)}) = 'I' THEN 'U' ELSE upper({clean(x)}) END"


# The order that tells the last line of a key; ties in it are equal rows.
SEQUENCE = ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
SEQUENCE_COLUMNS = ", ".join(SEQUENCE)
LAST_LINE = ", ".join(f"{c} DESC" for c in SEQUENCE)


# --- snapshots ---------------------------------------------------------------------------


def line_snapshots(composite: bool = False) -> str:
    keys = (
        "CAST(l_orderkey AS VARCHAR) AS order_id, CAST(l_linenumber AS VARCHAR) AS line_no"
        if composite
        else "l_orderkey || '-' || l_linenumber AS user_id"
    )
    shipped = "strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')"
    later = "strftime(l_shipdate + INTERVAL 3 DAYS, '%Y-%m-%d %H:%M:%S')"
    letter = "CASE WHEN l_orderkey % 13 = 0 THEN l_returnflag END"
    return f"""
    before_s AS (
      SELECT {keys}, concat_ws('|', l_partkey, {letter}, l_suppkey) AS tags,
        CAST(l_quantity AS BIGINT) || ' | ' || l_linenumber || ' | 10' AS levels,
        {shipped} || '|' || {later} AS timestamps,
        CASE WHEN l_orderkey % 50 = 0 THEN 'D' WHEN l_orderkey % 10 = 1 THEN 'i' ELSE 'U' END AS op_type,
        {SEQUENCE_COLUMNS}
      FROM lineitem WHERE l_orderkey % 101 <> 0),
    after_s AS (
      SELECT {keys},
        concat_ws('|', l_suppkey, {letter}, CASE WHEN l_orderkey % 97 = 0 THEN 99999999 ELSE l_partkey END) AS tags,
        '10|' || CASE WHEN l_orderkey % 7 = 0 THEN '0' ELSE '' END || l_linenumber || '|' || CAST(l_quantity AS BIGINT)
          AS levels,
        CASE WHEN l_orderkey % 89 = 0 THEN replace({later}, ' ', 'T') ELSE {later} END || '|' || {shipped} AS timestamps,
        CASE WHEN l_orderkey % 50 = 0 THEN 'd' ELSE 'U' END AS op_type,
        {SEQUENCE_COLUMNS}
      FROM lineitem WHERE l_orderkey % 103 <> 0)"""


def normalized(source: str, strictness: str, keys: list[str], extra: str = "") -> str:
    number_list = int_list if strictness == "B" else text_list
    key_columns = ", ".join(f"{clean(k)} AS {k}" for k in keys)
    return f"""SELECT {key_columns}, {number_list('tags')} AS tags, {number_list('levels')} AS levels,
      {text_list('timestamps')} AS timestamps, {op_code('op_type')} AS op_type{extra}
      FROM {source}"""


def line_diff(strictness: str, composite: bool = False, more: tuple[str, ...] = ()) -> str:
    """CTEs up to ``keyed``: the last normalized row of every key, both sides side by side; ``more`` are further key columns."""
    keys = ["order_id", "line_no"] if composite else ["user_id"]
    key = " || '||' || ".join([*keys, *more])
    compared = ["levels", "op_type", "tags", "timestamps"]
    sides = []
    for side, source in (("b", "before_s"), ("a", "after_s")):
        rows = normalized(source, strictness, keys, f", {SEQUENCE_COLUMNS}")
        sides.append(f"""{side}_rows AS ({rows} WHERE upper({clean('op_type')}) <> 'D'),
        {side} AS (SELECT *, {key} AS key, TRUE AS present FROM {side}_rows
          QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {LAST_LINE}) = 1)""")
    changed = ", ".join(f"CASE WHEN b.{c} <> a.{c} THEN '{c}' END" for c in compared)
    return f"""WITH {line_snapshots(composite)}, {', '.join(sides)},
      keyed AS (SELECT coalesce(b.key, a.key) AS key,
          CASE WHEN b.present IS NULL THEN 'INSERT' WHEN a.present IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS status,
          CASE WHEN b.present AND a.present THEN concat_ws('|', {changed}) ELSE '' END AS changed_columns
        FROM b FULL JOIN a ON b.key = a.key),
      found AS (SELECT * FROM keyed WHERE status <> 'UPDATE' OR changed_columns <> '')"""


def counted_pairs(before: str, after: str, key: str, row: str | None) -> str:
    """Rows of the full join on ``key`` that are unequal in ``row``, counted per key and status."""
    equal = (
        f""", same AS (SELECT b.k, sum(b.n * a.n) AS n FROM
          (SELECT {key} AS k, {row} AS r, count(*) AS n FROM {before} GROUP BY ALL) b JOIN
          (SELECT {key} AS k, {row} AS r, count(*) AS n FROM {after} GROUP BY ALL) a
          ON b.k = a.k AND b.r = a.r GROUP BY b.k)"""
        if row
        else ", same AS (SELECT NULL AS k, 0 AS n)"
    )
    return f""", bk AS (SELECT {key} AS k, count(*) AS n FROM {before} GROUP BY ALL),
      ak AS (SELECT {key} AS k, count(*) AS n FROM {after} GROUP BY ALL){equal},
      pairs AS (SELECT coalesce(bk.k, ak.k) AS key,
          CASE WHEN bk.n IS NULL THEN 'INSERT' WHEN ak.n IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS status,
          CAST(coalesce(bk.n * ak.n - coalesce(same.n, 0), bk.n, ak.n) AS BIGINT) AS n_rows
        FROM bk FULL JOIN ak ON bk.k = ak.k LEFT JOIN same ON same.k = bk.k AND ak.n IS NOT NULL)"""


def fingerprints(before: str, after: str, key: str, row: str, last: str) -> str:
    """Every after row against its key's last before row, counted per key and status."""
    return f""", bl AS (SELECT {key} AS k, {row} AS r FROM {before}
        QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {last}) = 1),
      al AS (SELECT {key} AS k, {row} AS r FROM {after}),
      prints AS (
        SELECT al.k AS key, CASE WHEN bl.k IS NULL THEN 'INSERT' ELSE 'UPDATE' END AS status, count(*) AS n_rows
        FROM al LEFT JOIN bl ON al.k = bl.k WHERE bl.k IS NULL OR bl.r <> al.r GROUP BY ALL
        UNION ALL
        SELECT k, 'DELETE', 1 FROM bl WHERE k NOT IN (SELECT k FROM al))"""


LINE_ROW = "tags || chr(1) || levels || chr(1) || timestamps || chr(1) || op_type"
LINES = f"WITH {line_snapshots()}"
COMPOSITE_KEY = "order_id || '||' || line_no"
RAW_LINES = LINES + counted_pairs("before_s", "after_s", "user_id", LINE_ROW)
PRESENT_LINES = LINES + counted_pairs("before_s", "after_s", "user_id", None)

EVENTS = """WITH e AS (
      SELECT CASE WHEN user_id % 20 <> 0 THEN CAST(user_id AS VARCHAR) END AS user_id, event_type,
        CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS value, event_id, user_id AS uid FROM events),
    before_e AS (SELECT * FROM e WHERE event_id % 3 <> 0 AND NOT (user_id IS NOT NULL AND uid % 17 = 0)),
    after_e AS (SELECT * FROM e WHERE event_id % 3 <> 1 AND NOT (user_id IS NOT NULL AND uid % 19 = 0))"""
EVENT_ROW = "event_type || chr(1) || value"

ORDER_KEYS = """WITH b AS (SELECT CAST(l_orderkey AS VARCHAR) AS user_id FROM lineitem WHERE l_orderkey % 5 <> 0),
    a AS (SELECT CAST(o_orderkey AS VARCHAR) AS user_id FROM orders WHERE o_orderkey % 3 <> 0)"""

ORDER_TEXT = """SELECT CAST(o_orderkey AS VARCHAR) AS order_id,
    CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS customer,
    CASE WHEN o_orderkey % 5 = 0 THEN '"' || o_orderpriority || '", \\' ELSE o_orderpriority END AS priority,
    o_orderstatus AS status FROM orders"""

DIRTY = """WITH d AS (SELECT o_orderkey,
    CASE o_orderkey % 8 WHEN 0 THEN ' ' || chr(9) || o_orderpriority || chr(12288) || chr(10) WHEN 1 THEN NULL
      WHEN 2 THEN ' ' || chr(31) || ' ' WHEN 3 THEN ' ' || o_orderstatus ELSE o_orderpriority END AS padded,
    CASE o_orderkey % 8
      WHEN 0 THEN o_custkey || '| 007 |' || o_orderstatus || '|-12'
      WHEN 1 THEN 'é |  | ' || o_orderstatus || ' | 1__0 | 1_000'
      WHEN 2 THEN NULL
      WHEN 3 THEN o_orderkey || '|123456789012345678901' || o_custkey || '|+5'
      WHEN 4 THEN o_orderstatus || '|' || chr(12288) || 'b |a|' || o_orderstatus || '||'
      WHEN 5 THEN o_custkey || '|' || o_orderkey || '|-0|-' || o_custkey
      ELSE o_orderkey || '|' || o_custkey || '|10' END AS items,
    CASE o_orderkey % 8 WHEN 0 THEN ' i' WHEN 1 THEN 'd' || chr(9) WHEN 2 THEN NULL WHEN 3 THEN 'U' WHEN 4 THEN 'D'
      ELSE lower(o_orderstatus) END AS code,
    strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '|' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '| x ' AS times
    FROM orders)"""

def schema_drift() -> str:
    """Mode A, with ``timestamps`` absent and ``note`` added on the after side."""
    changed = (
        "concat_ws('|', CASE WHEN b.levels <> a.levels THEN 'levels' END, "
        "CASE WHEN a.note <> '' THEN 'note' END, CASE WHEN b.op_type <> a.op_type THEN 'op_type' END, "
        "CASE WHEN b.tags <> a.tags THEN 'tags' END, CASE WHEN b.timestamps <> '' THEN 'timestamps' END)"
    )
    rows = {}
    for side, note in (("before_s", "''"), ("after_s", "CASE WHEN contains(tags, '7') THEN 'seven' ELSE '' END")):
        stamps = "timestamps" if side == "before_s" else "''"
        source = f"(SELECT * REPLACE ({stamps} AS timestamps), {note} AS note FROM {side})"
        rows[side] = normalized(source, "A", ["user_id"], f", note, {SEQUENCE_COLUMNS}")
    pick = f"QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {LAST_LINE}) = 1"
    live = f"WHERE upper({clean('op_type')}) <> 'D'"
    return f"""WITH {line_snapshots()}, b_rows AS ({rows['before_s']} {live}), a_rows AS ({rows['after_s']} {live}),
      b AS (SELECT *, TRUE AS present FROM b_rows {pick}), a AS (SELECT *, TRUE AS present FROM a_rows {pick}),
      keyed AS (SELECT coalesce(b.user_id, a.user_id) AS key,
          CASE WHEN b.present IS NULL THEN 'INSERT' WHEN a.present IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS status,
          CASE WHEN b.present AND a.present THEN {changed} ELSE '' END AS changed_columns
        FROM b FULL JOIN a ON b.user_id = a.user_id)
      SELECT * FROM keyed WHERE status <> 'UPDATE' OR changed_columns <> ''"""


def matrix() -> str:
    raw = counted_pairs("before_s", "after_s", "user_id", LINE_ROW)
    prints = fingerprints("before_s", "after_s", "user_id", LINE_ROW, LAST_LINE)
    present = PRESENT_LINES.replace("WITH", "", 1)
    sources = {
        "raw": f"SELECT sum(n_rows) FROM (WITH x AS (SELECT 1){raw} SELECT n_rows FROM pairs)",
        "fingerprint": f"SELECT sum(n_rows) FROM (WITH x AS (SELECT 1){prints} SELECT n_rows FROM prints)",
        "presence": f"SELECT sum(n_rows) FROM (WITH {present} SELECT n_rows FROM pairs)",
    }
    rows = [
        f"""SELECT '{mode}' AS mode, TRUE AS success, (SELECT count(*) FROM before_s) AS rows_before,
          (SELECT count(*) FROM after_s) AS rows_after, CAST(({found}) AS BIGINT) AS rows_diff"""
        for mode, found in sources.items()
    ]
    return f"""{line_diff('A')}
      SELECT 'normalized' AS mode, TRUE AS success, (SELECT count(*) FROM b_rows) AS rows_before,
        (SELECT count(*) FROM a_rows) AS rows_after, (SELECT count(*) FROM found) AS rows_diff
      UNION ALL {' UNION ALL '.join(rows)}
      UNION ALL SELECT 'unknown', FALSE, 0, 0, 0"""


# --- generator ---------------------------------------------------------------------------


def bits(stream: int | str, index: str = "idx") -> str:
    """splitmix64 in 128-bit arithmetic."""
    if isinstance(stream, int):
        salt = str((GENERATOR.seed ^ (stream * STREAM_MULTIPLIER)) % WORD)
    else:
        salt = f"xor({GENERATOR.seed}::UHUGEINT, ({stream})::UHUGEINT * {STREAM_MULTIPLIER}::UHUGEINT % {WORD}::UHUGEINT)"
    x = f"((xor(({index})::UHUGEINT * {INDEX_MULTIPLIER}::UHUGEINT % {WORD}::UHUGEINT, {salt}::UHUGEINT) + {INCREMENT}::UHUGEINT) % {WORD}::UHUGEINT)"
    x = f"[{x}]"
    for distance, factor in ((30, FIRST_MULTIPLIER), (27, SECOND_MULTIPLIER), (31, 1)):
        # A one-item list binds the number to a name, so it is computed once.
        x = (
            f"list_transform({x}, lambda x: "
            f"xor(x, x // {1 << distance}::UHUGEINT) * {factor}::UHUGEINT % {WORD}::UHUGEINT)"
        )
    return f"{x}[1]"


def mod(stream: int | str, n: int | str) -> str:
    return f"CAST({bits(stream)} % ({n})::UHUGEINT AS BIGINT)"


def unit(stream: int) -> str:
    return f"(CAST({bits(stream)} AS DOUBLE) / 18446744073709551616.0::DOUBLE)"


def count(stream: int, average: int) -> str:
    return f"({average - 1} + {mod(stream, 3)})"


def base_items() -> dict[str, str]:
    day = f"((1 + {mod(5, 27)} + i) % 28 + 1)"
    clock = " || ':' || ".join(
        f"lpad(CAST({mod(f'{base} + i', size)} AS VARCHAR), 2, '0')" for base, size in ((100, 24), (200, 60), (300, 60))
    )
    gap = f"CASE WHEN {mod('400 + i', 2)} = 0 THEN 'T' ELSE ' ' END"
    stamp = f"'2026-01-' || lpad(CAST({day} AS VARCHAR), 2, '0') || {gap} || {clock}"
    return {
        "tags": f"list_transform(range({count(10, 3)}), lambda i: CAST(10000000 + {mod('500 + i', 90000000)} AS VARCHAR))",
        "levels": f"list_transform(range({count(20, 3)}), lambda i: CAST(1 + {mod('600 + i', 9)} AS VARCHAR))",
        "ts": f"list_transform(range({count(30, 2)}), lambda i: {stamp})",
    }


def presence() -> tuple[str, str, str]:
    missing, first = f"({unit(1)} < {GENERATOR.missing_rate})", f"({unit(2)} < 0.5)"
    return (
        f"(NOT {missing} OR {first})",
        f"(NOT {missing} OR NOT {first})",
        f"(NOT {missing} AND {unit(3)} < {GENERATOR.mismatch_rate})",
    )


def operation() -> str:
    steps = OPERATIONS
    cases = " ".join(f"WHEN {unit(4)} <= {reached!r} THEN '{code}'" for code, reached in steps[:-1])
    return f"CASE {cases} ELSE '{steps[-1][0]}' END"


def shuffled(source: str, side: str) -> str:
    """CTEs from ``source`` (idx and list columns) to ``shuffled``, trading one position at a time."""
    widths = {"tags": 4, "levels": 4, "ts": 3}
    first = []
    for name, width in widths.items():
        first.append(f"len({name}) AS {name}_n")
        first += [f"{name}[{i + 1}] AS {name}_{i}" for i in range(width)]
        first += [f"{mod(SHUFFLES[side][name] + i, i + 1)} AS {name}_j{i}" for i in range(1, width)]
    ctes = [f"step_4 AS (SELECT *, {', '.join(first)} FROM {source})"]
    for i in (3, 2, 1):
        changes = []
        for name, width in widths.items():
            if i >= width:
                continue
            active = f"{name}_n > {i} AND {name}_j{i}"
            for k in range(i):
                changes.append(f"CASE WHEN {active} = {k} THEN {name}_{i} ELSE {name}_{k} END AS {name}_{k}")
            arms = " ".join(f"WHEN {active} = {k} THEN {name}_{k}" for k in range(i))
            changes.append(f"CASE {arms} ELSE {name}_{i} END AS {name}_{i}")
        ctes.append(f"step_{i} AS (SELECT * REPLACE ({', '.join(changes)}) FROM step_{i + 1})")
    final = ", ".join(
        f"list_slice([{', '.join(f'{n}_{i}' for i in range(w))}], 1, {n}_n) AS {n}" for n, w in widths.items()
    )
    ctes.append(f"shuffled AS (SELECT * REPLACE ({final}) FROM step_1)")
    return ", ".join(ctes)


def replaced(name: str) -> str:
    stream, value = MUTATIONS[name]
    position = mod(stream, f"len({name})")
    return f"list_transform({name}, lambda x, spot: CASE WHEN spot - 1 = {position} THEN '{value}' ELSE x END)"


def list_texts() -> str:
    return ", ".join(f"array_to_string({n}, '|') AS {n}" for n in ("tags", "levels", "ts"))


ORDER_INDICES = "SELECT o_orderkey AS idx FROM orders"
LISTS = f"lists AS (SELECT idx, {', '.join(f'{x} AS {n}' for n, x in base_items().items())} FROM ({ORDER_INDICES}))"


def side_rows(side: str) -> str:
    present = presence()[0 if side == "before" else 1]
    changed = "shuffled"
    extra = ""
    if side == "after":
        picks = ", ".join(
            f"CASE WHEN {presence()[2]} AND {mod(760, 3)} = {i} THEN {replaced(n)} ELSE {n} END AS {n}"
            for i, n in enumerate(MUTATIONS)
        )
        extra, changed = f", changed AS (SELECT * REPLACE ({picks}) FROM shuffled)", "changed"
    return f"""WITH {LISTS}, {shuffled('lists', side)}{extra}
      SELECT 'a.' || CASE WHEN idx < 1000000000 THEN lpad(CAST(idx AS VARCHAR), 9, '0') ELSE CAST(idx AS VARCHAR) END
        AS user_id, {list_texts()}, {operation()} AS op_type FROM {changed} WHERE {present}"""


def permuted(side: str) -> str:
    """The coprime factor is found by search, as the rule says, among the first 200 candidates."""
    factor_stream, shift_stream = (901, 903) if side == "before" else (902, 904)
    start = f"({bits(factor_stream, 'n')} // 2::UHUGEINT * 2::UHUGEINT + 1::UHUGEINT)"
    return f"""(SELECT CAST(min_by((f % n::UHUGEINT), try_no) AS BIGINT) FROM (
        SELECT n, i AS try_no, ({start} + 2::UHUGEINT * i::UHUGEINT) AS f FROM sizes, range(200) r(i))
        WHERE gcd(CAST(f % n::UHUGEINT AS BIGINT), n) = 1), (SELECT CAST({bits(shift_stream, 'n')} % n::UHUGEINT AS BIGINT) FROM sizes)"""


def oracles() -> dict[str, str]:
    found = "SELECT key, status, changed_columns FROM found"
    pairs = "SELECT key, status, '' AS changed_columns, n_rows FROM pairs WHERE n_rows > 0"
    per_order = {
        "norm_null": f"{clean('padded')} AS cleaned",
        "norm_list_compat": f"{text_list('items')} AS items",
        "norm_list_strict": f"{int_list('items')} AS items",
        "norm_timestamps": f"{text_list('times')} AS times",
        "norm_op_type": f"{op_code('code')} AS code",
    }
    event_key = "coalesce(user_id, '')"
    lone_events = """ SELECT key, status, '' AS changed_columns, n_rows FROM pairs WHERE key IS NOT NULL AND n_rows > 0
      UNION ALL SELECT {k}, 'DELETE', '', count(*) FROM before_e WHERE user_id IS NULL HAVING count(*) > 0
      UNION ALL SELECT {k}, 'INSERT', '', count(*) FROM after_e WHERE user_id IS NULL HAVING count(*) > 0"""
    known = EVENTS + """, before_k AS (SELECT * FROM before_e WHERE user_id IS NOT NULL),
      after_k AS (SELECT * FROM after_e WHERE user_id IS NOT NULL)"""
    event_last = "ORDER BY event_id DESC"
    event_sides = ", ".join(
        f"""{s} AS (SELECT coalesce(user_id, '') || '||' || event_type AS key, value, TRUE AS present FROM {t}
          QUALIFY row_number() OVER (PARTITION BY user_id, event_type {event_last}) = 1)"""
        for s, t in (("b", "before_e"), ("a", "after_e"))
    )
    in_before, in_after, mismatch = presence()
    result = {
        "diff_a": f"{line_diff('A')} {found}",
        "diff_b": f"{line_diff('B')} {found}",
        "diff_composite_key": f"{line_diff('A', composite=True)} {found}",
        "diff_key_op": f"{line_diff('A', more=('op_type',))} {found}",
        "diff_key_list": f"{line_diff('A', more=('levels',))} {found}",
        "diff_raw_full_outer": f"{RAW_LINES} {pairs}",
        "diff_fingerprint": f"""{LINES}{fingerprints('before_s', 'after_s', 'user_id', LINE_ROW, LAST_LINE)}
          SELECT key, status, '' AS changed_columns FROM prints, range(n_rows)""",
        "diff_raw_composite": f"WITH {line_snapshots(True)}{counted_pairs('before_s', 'after_s', COMPOSITE_KEY, LINE_ROW)} {pairs}",
        "diff_presence": f"{PRESENT_LINES} {pairs}",
        "diff_repeated": f"""{EVENTS}, {event_sides}
          SELECT coalesce(b.key, a.key) AS key,
            CASE WHEN b.present IS NULL THEN 'INSERT' WHEN a.present IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS status,
            CASE WHEN b.value <> a.value THEN 'value' ELSE '' END AS changed_columns
          FROM b FULL JOIN a ON b.key = a.key
          WHERE b.present IS NULL OR a.present IS NULL OR b.value <> a.value""",
        "diff_raw_repeated": known + counted_pairs("before_k", "after_k", "user_id", EVENT_ROW)
        + lone_events.format(k="''"),
        "diff_fingerprint_repeated": EVENTS
        + fingerprints("before_e", "after_e", event_key, EVENT_ROW, "event_id DESC")
        + " SELECT key, status, '' AS changed_columns, CAST(n_rows AS BIGINT) AS n_rows FROM prints",
        "diff_presence_repeated": known + counted_pairs("before_k", "after_k", "user_id", None)
        + lone_events.format(k="NULL"),
        "diff_schema_drift": schema_drift(),
        "diff_sorted": f"{line_diff('B')} {found} ORDER BY key",
        "diff_status": f"{line_diff('B')} SELECT key, status FROM found",
        "changed_columns": f"{line_diff('B')} SELECT key, changed_columns FROM found",
        "presence_inserts": f"""{ORDER_KEYS} SELECT user_id AS key, 'INSERT' AS status, '' AS changed_columns
          FROM a ANTI JOIN b USING (user_id)""",
        "presence_deletes": f"""{ORDER_KEYS} SELECT user_id AS key, 'DELETE' AS status, '' AS changed_columns
          FROM b ANTI JOIN a USING (user_id)""",
        "presence_common": f"""{ORDER_KEYS} SELECT user_id AS key, 'UPDATE' AS status, '' AS changed_columns,
          count(*) AS n_rows FROM b JOIN a USING (user_id) GROUP BY user_id""",
        "key_union": f"{line_diff('A')} SELECT key FROM keyed",
        "dedup_last": """SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id
          FROM events GROUP BY user_id""",
        "row_counts": f"""{line_diff('A')} SELECT (SELECT count(*) FROM b_rows) AS rows_before,
          (SELECT count(*) FROM a_rows) AS rows_after""",
        "diff_summary": f"{line_diff('B')} SELECT status, changed_columns, count(*) AS rows_diff FROM found GROUP BY ALL",
        "strategy_matrix": matrix(),
        **{name: f"{DIRTY} SELECT o_orderkey, {column} FROM d" for name, column in per_order.items()},
        "norm_list_documents": f"SELECT doc_id, {text_list('text', ' ')} AS words FROM documents",
        "parse_int_or_str": f"""{DIRTY}, t AS (SELECT o_orderkey, unnest(string_split(items, '|')) AS raw,
            unnest(range(len(string_split(items, '|')))) AS pos FROM d WHERE items IS NOT NULL),
          c AS (SELECT o_orderkey, pos, {clean('raw')} AS token FROM t)
          SELECT o_orderkey, pos, CAST(CASE WHEN {is_int('token')} THEN 0 ELSE 1 END AS BIGINT) AS kind,
            {shown('token')} AS shown FROM c""",
        "normalize_a": f"{LINES} {normalized('before_s', 'A', ['user_id'])}",
        "normalize_b": f"{LINES} {normalized('before_s', 'B', ['user_id'])}",
        "composite_key": "SELECT l_orderkey || '||' || l_linenumber AS key FROM lineitem WHERE l_orderkey % 101 <> 0",
        "exclude_deleted": f"{DIRTY} SELECT o_orderkey FROM d WHERE upper({clean('code')}) <> 'D'",
        "scan_tsv": ORDER_TEXT,
        "scan_csv_comma": ORDER_TEXT,
        "scan_gzip": ORDER_TEXT,
        "scan_glob_union": f"""SELECT order_id, customer, CASE WHEN status <> 'F' THEN priority END AS priority, status
          FROM ({ORDER_TEXT})""",
        "scan_tolerant": f"""SELECT order_id,
            CASE CAST(order_id AS BIGINT) % 4 WHEN 0 THEN NULL WHEN 1 THEN status ELSE customer END AS customer,
            CASE WHEN CAST(order_id AS BIGINT) % 4 <> 0 THEN status END AS status,
            CASE CAST(order_id AS BIGINT) % 4 WHEN 0 THEN order_id
              WHEN 1 THEN order_id || ';' || status || ';' || status || ';' || status END AS bad_line
          FROM ({ORDER_TEXT})""",
        "scan_header_only": ORDER_TEXT,
        "scan_blank_rows": f"""SELECT CASE WHEN CAST(order_id AS BIGINT) % 6 <> 0 THEN order_id END AS order_id,
          CASE WHEN CAST(order_id AS BIGINT) % 6 <> 0 THEN status END AS status FROM ({ORDER_TEXT})""",
        "scan_repeated_names": f"""SELECT order_id AS "id0", status, 'x' AS "_c2", reverse(order_id) AS "ID" FROM ({ORDER_TEXT})""",
        "scan_many_headers": f"""SELECT order_id, CASE WHEN CAST(order_id AS BIGINT) % 3 = 0 THEN customer END AS customer,
          CASE WHEN CAST(order_id AS BIGINT) % 3 = 2 THEN priority END AS priority, status FROM ({ORDER_TEXT})""",
        "sink_overwrite": f"SELECT * FROM ({ORDER_TEXT}) WHERE status <> 'F'",
        "publish_roundtrip": """SELECT side, n AS rows_before, n AS rows_after, CAST(0 AS BIGINT) AS rows_diff FROM (
          SELECT 'before' AS side, count_if(o_orderstatus <> 'F') AS n FROM orders
          UNION ALL SELECT 'after', count(*) FROM orders)""",
        "publish_bytes": """SELECT side, CAST(4 AS BIGINT) AS n_files, CAST(4 AS BIGINT) AS n_same, n AS n_rows FROM (
          SELECT 'before' AS side, count_if(o_orderstatus <> 'F') AS n FROM orders
          UNION ALL SELECT 'after', count(*) FROM orders)""",
        "job_compare": f"{line_diff('B')} {found}",
        "job_benchmark": matrix(),
        "sink_diff_csv": f"{line_diff('A')} {found}",
        "gen_rand": f"""SELECT idx, upper(printf('%016x', CAST({bits(7)} AS UBIGINT))) AS bits, {unit(7)} AS unit
          FROM ({ORDER_INDICES})""",
        "gen_op_type": f"SELECT idx, {operation()} AS op_type FROM ({ORDER_INDICES})",
        "gen_presence": f"""SELECT idx, CAST({in_before} AS BIGINT) AS in_before, CAST({in_after} AS BIGINT) AS in_after,
          CAST({mismatch} AS BIGINT) AS mismatch FROM ({ORDER_INDICES})""",
        "gen_lists": f"WITH {LISTS} SELECT idx, {list_texts()} FROM lists",
        "gen_shuffle": f"WITH {LISTS}, {shuffled('lists', 'before')} SELECT idx, {list_texts()} FROM shuffled",
        "gen_mutate": f"""WITH {LISTS}, changed AS (SELECT idx, {', '.join(f'{replaced(n)} AS {n}' for n in MUTATIONS)}
          FROM lists) SELECT idx, {list_texts()} FROM changed""",
        "gen_permute": f"""WITH sizes AS (SELECT count(*) AS n FROM orders),
          steps AS (SELECT n, {permuted('before').replace('), (SELECT', ') AS bf, (SELECT')} AS bs,
            {permuted('after').replace('), (SELECT', ') AS af, (SELECT')} AS ash FROM sizes)
          SELECT o_orderkey % n AS position,
            CAST((bf::HUGEINT * (o_orderkey % n) + bs) % n AS BIGINT) AS before_idx,
            CAST((af::HUGEINT * (o_orderkey % n) + ash) % n AS BIGINT) AS after_idx FROM orders, steps""",
        "gen_quotas": """WITH sizes AS (SELECT count(*) AS n FROM orders),
          bounds AS (SELECT f, f * (n // 7) + least(f, n % 7) AS lo, (f + 1) * (n // 7) + least(f + 1, n % 7) AS hi
            FROM sizes, range(7) r(f))
          SELECT o_orderkey AS idx, f AS file FROM orders, sizes, bounds WHERE o_orderkey % n >= lo AND o_orderkey % n < hi""",
        "gen_manifest": f"""SELECT count(*) AS rows_requested, count_if({in_before}) AS rows_before,
          count_if({in_after}) AS rows_after, count_if({mismatch}) AS mismatch_rows FROM ({ORDER_INDICES})""",
        "gen_before": side_rows("before"),
        "gen_after": side_rows("after"),
        "gen_write": side_rows("after"),
    }
    result["diff_fingerprint_wide"] = result["diff_fingerprint"]
    return result
