"""Secret scans through a trigram inverted index, with DataFrame operations only.

Index. From each rule's regular expression a Boolean query over lower-case trigrams is derived that every
match must satisfy (an AND of ORs of ANDs, or nothing). The index holds, for blocks of documents, the posting
list of each trigram that some query names; queries are intersections and unions of posting lists, and yield
the candidates, which are then searched with the expression itself. Rules without a mandatory trigram, such
as hex digits, scan every text.

Scale. Postings are rows of ids; a block of ids hashes together some ``BLOCK_ROWS`` documents, whatever the
table's size, so no list grows with the data. Texts are shuffled once, to meet their candidate rules. All
matches of one rule in one text are found in one pass.

Rows. Null texts are empty and have no secrets. A null doc_id is no key of the index; such rows are searched
for every rule. Rows that share a doc_id share candidates, and each is searched itself. An empty table gives
an empty result. Without rules nothing is found; without a rule that has a trigram there is no index. Input columns named
like the result's are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from re import _parser as regex_parser  # the standard library's own parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.shared import replace

BLOCK_ROWS = 4096
#: Alternatives that are spelled out before the parts that they come from are queried one by one.
MAX_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """``pattern`` works alike in Java and Python; its group ``group`` (0: all) needs ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),
)
_KEY_LINE = r"-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----"
_KEY_HEADERS = r"(?:[\x20\t\r\n]*[A-Za-z]+-[A-Za-z]+:[^\r\n]*){0,4}"
#: A key from its first line to its last one; without that, to the end of its lines of base64 (400 at most, of which no key has
#: half), or the first line alone. Line breaks may be spelled \\n.
PRIVATE_KEY = (
    _KEY_LINE
    + "(?:"
    + (_KEY_HEADERS + r"[A-Za-z0-9+/=\x20\t\r\n\x5C]*-----END\x20[A-Z\x20]*PRIVATE\x20KEY-----|")
    + (_KEY_HEADERS + r"(?:[\r\n]{1,2}[A-Za-z0-9+/=]{20,}){1,400}(?:[\r\n]{1,2}[A-Za-z0-9+/=]{1,19})?|")
    + ")"
)
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("private", PRIVATE_KEY),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + ADDED

# ---- Boolean trigram queries: a set of clauses, each a set of alternatives, each a set of trigrams

Query = frozenset[frozenset[frozenset[str]]]


def trigram_query(pattern: str) -> Query:
    """What every match of the pattern must hold, in lower-case trigrams; empty if nothing is known."""
    exact, clauses = _walk(list(regex_parser.parse(pattern)))
    return frozenset(clauses | _clause(exact))


def _clause(strings: set[str]) -> set[frozenset[frozenset[str]]]:
    sets = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings]
    weakest = [a for a in sets if not any(b < a for b in sets)]
    return {frozenset(weakest)} if weakest and all(weakest) else set()


def _walk(items: list) -> tuple[set[str], set]:
    """The strings that a match ends with since the last part that is not spelled out, and the clauses before."""
    exact, clauses = {""}, set()
    for op, arg in items:
        strings, inner, closed = _item(str(op), arg)
        clauses |= inner
        if strings is not None and len(exact) * len(strings) <= MAX_STRINGS:
            exact = {a + b for a in exact for b in strings}
        else:
            clauses |= _clause(exact)
            exact = strings if strings is not None and len(strings) <= MAX_STRINGS else {""}
        if not closed:
            clauses |= _clause(exact)
            exact = {""}
    return exact, clauses


def _item(op: str, arg) -> tuple[set[str] | None, set, bool]:
    """The strings of one part (None: not spelled out), clauses that it brings, whether it ends with them."""
    if op == "LITERAL":
        return {chr(arg).lower()}, set(), True
    if op == "IN" and all(str(kind) == "LITERAL" for kind, _ in arg):
        return {chr(c).lower() for _, c in arg}, set(), True
    if op == "SUBPATTERN":
        exact, clauses = _walk(list(arg[-1]))
        return (exact, clauses, True) if not clauses else (None, clauses | _clause(exact), True)
    if op == "BRANCH":
        branches = [_walk(list(b)) for b in arg[1]]
        if all(not clauses for _, clauses in branches):
            return set().union(*(exact for exact, _ in branches)), set(), True
        return None, set(), True
    if op in ("MAX_REPEAT", "MIN_REPEAT"):
        least, most, body = arg
        exact, clauses = _walk(list(body))
        if least == 0:
            return ({"", *exact}, set(), True) if int(most) == 1 and not clauses else (None, set(), True)
        if clauses:
            return None, clauses | _clause(exact), True
        return exact, set(), least == most == 1
    return None, set(), True


# ---- index and search


def _candidates(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(doc_id, kinds) of the documents that satisfy the query of some rule."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    if not queries:
        return docs.select("doc_id", F.array(F.lit("")).alias("kinds")).where(F.lit(False))
    grams = sorted({g for q in queries.values() for clause in q for alternative in clause for g in alternative})
    blocks = F.greatest(F.lit(1), F.ceil(F.lit(docs.count() / BLOCK_ROWS)))
    held = F.array_compact(F.array(*(F.when(F.contains(F.col("low"), F.lit(g)), F.lit(g)) for g in grams)))
    postings = (
        docs.where("doc_id is not null and text is not null")
        .select("doc_id", F.lower("text").alias("low"))
        .select("doc_id", F.pmod(F.xxhash64("doc_id"), blocks).alias("block"), F.explode(held).alias("gram"))
        .groupBy("block")
        .agg(*(F.collect_set(F.when(F.col("gram") == g, F.col("doc_id"))).alias(g) for g in grams))
    )

    def all_of(lists: list[Column], meet) -> Column:
        out = lists[0]
        for other in lists[1:]:
            out = meet(out, other)
        return out

    def ids(query: Query) -> Column:
        alternatives = lambda clause: [all_of([F.col(f"`{g}`") for g in sorted(a)], F.array_intersect) for a in sorted(clause, key=sorted)]
        return all_of([all_of(alternatives(c), F.array_union) for c in sorted(query, key=str)], F.array_intersect)

    found = F.array(*(F.struct(F.lit(kind).alias("kind"), ids(q).alias("ids")) for kind, q in queries.items()))
    return (
        postings.select(F.explode(found).alias("f"))
        .select("f.kind", F.explode("f.ids").alias("doc_id"))
        .groupBy("doc_id")
        .agg(F.collect_set("kind").alias("kinds"))
    )


def find(text: Column, rule: Rule) -> Column:
    """Spans of the rule's leftmost non-overlapping matches, as array<struct<start, end>> in code points.

    The pieces between matches and the matches, both in order, give the positions by their lengths.
    """
    pieces = F.split(text, rule.pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches
    lengths = F.transform(
        F.arrays_zip(pieces.alias("piece"), matches.alias("match"), values.alias("value")),
        lambda x: F.struct(
            F.length(x.piece).alias("gap"),
            F.coalesce(F.length(x.match), F.lit(0)).alias("n"),
            F.coalesce(F.length(x.value), F.lit(0)).alias("value"),
        ),
    )
    start = F.struct(F.lit(0).alias("at"), F.expr("array_repeat(struct(0 AS start, 0 AS end), 0)").alias("spans"))

    def step(seen: Column, x: Column) -> Column:
        begin = seen.at + x.gap
        span = F.array(F.struct(begin.alias("start"), (begin + x.n).alias("end")))
        fits = (x.n > 0) & (x.value >= rule.least)
        return F.struct((begin + x.n).alias("at"), F.when(fits, F.concat(seen.spans, span)).otherwise(seen.spans).alias("spans"))

    return F.aggregate(lengths, start, step, lambda seen: seen.spans)


def _marked(spans: Column, place: int, kind: str) -> Column:
    return F.transform(
        spans, lambda s: F.struct(s.start.alias("start"), F.lit(place).alias("place"), s.end.alias("end"), F.lit(kind).alias("kind"))
    )


NO_SPANS = "array_repeat(struct(0 AS start, 0 AS end), 0)"


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents with ``secrets``: array<struct<start, place, end, kind>> by start, then the rules' order.

    Positions are code points, the end exclusive. The column ``text`` is as it was.
    """
    found = _candidates(docs.select("doc_id", "text"), rules).select(F.col("doc_id").alias("_id"), F.col("kinds").alias("_kinds"))
    rows = docs.join(found, F.col("doc_id") == F.col("_id"), "left")
    text = F.coalesce(F.col("text"), F.lit(""))
    lists = []
    for place, rule in enumerate(rules):
        wanted = F.lit(True)
        if trigram_query(rule.pattern):
            wanted = F.col("doc_id").isNull() | F.coalesce(F.array_contains("_kinds", rule.kind), F.lit(False))
        wanted = wanted & (text.rlike(rule.pattern))
        spans = F.when(wanted, find(text, rule)).otherwise(F.expr(NO_SPANS))
        lists.append(_marked(spans, place, rule.kind))
    none = F.expr("array_repeat(struct(0 AS start, 0 AS place, 0 AS end, '' AS kind), 0)")
    return replace(rows.withColumn("_secrets", F.array_sort(F.concat(none, *lists))), secrets=F.col("_secrets")).drop("_id", "_kinds", "_secrets")


def spelled(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def redact(docs: DataFrame, rules: Sequence[Rule] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """The documents with each secret (overlapping ones as one) replaced by ``mark`` and n_chars set anew."""
    rows = scan(docs.withColumn("_all", F.struct(*docs.columns)).select("doc_id", "text", "_all"), rules)
    start = F.struct(F.lit(0).alias("at"), F.expr("array_repeat('', 0)").alias("parts"))

    def step(seen: Column, s: Column) -> Column:
        part = F.when(s.start >= seen.at, F.concat(F.substring(F.col("text"), seen.at + 1, s.start - seen.at), F.lit(mark)))
        return F.struct(
            F.greatest(seen.at, s.end).alias("at"),
            F.when(part.isNotNull(), F.concat(seen.parts, F.array(part))).otherwise(seen.parts).alias("parts"),
        )

    whole = F.aggregate(
        "secrets", start, step, lambda seen: F.concat(F.array_join(seen.parts, ""), F.substring(F.col("text"), seen.at + 1, F.length(F.col("text"))))
    )
    clean = F.when(F.size("secrets") > 0, whole).otherwise(F.col("text"))
    out = rows.select("_all", clean.alias("_clean"), F.size("secrets").alias("_n")).select("_all.*", "_clean", "_n")
    values = {"text": F.col("_clean"), "n_chars": F.when(F.col("_n") > 0, F.length("_clean").cast("long")).otherwise(F.col("n_chars"))}
    return out.select(*(values.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


def python_spans(text: str, rules: Sequence[Rule] = RULES) -> list[tuple[int, int, str]]:
    """The same spans by brute force, for tests."""
    found = []
    for place, rule in enumerate(rules):
        found += [
            (m.start(), place, m.end(), rule.kind) for m in re.finditer(rule.pattern, text or "", re.ASCII) if len(m.group(rule.group)) >= rule.least
        ]
    return [(s, e, k) for s, _, e, k in sorted(found)]
