import random
import sys

import model
import pytest
from keydrift.functions import (
    clean_text,
    integer_sort_key,
    is_deleted,
    operation_code,
    sorted_integer_list,
    sorted_text_list,
)
from keydrift.functions.text import whitespace_characters
from pyspark.sql import functions as F

TOKENS = [
    "007", "+5", "-0", "-12", "-3", "5", "a", "B", "10", "2", " ", " 7 ", "　８", "٣", "1_000", "1__0",
    "_1", "1_", "9" * 45, "-" + "9" * 45, "é", "\U0001f600", "Ａ", "00", "1.0", "--5", "+ 5", "​1",
    "9" * 4300, "9" * 4301, "0" * 4301, "", "\x1c4", "\x85q", "ab c", "\U0001fbf5", "-", "+", "\t3",
]


def values(spark, texts, *functions):
    columns = [f(F.col("x")).alias(f"c{i}") for i, f in enumerate(functions)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]



def test_whitespace_covers_everything_python_strips():
    assert set(whitespace_characters()) == {c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace()}


def test_clean_text(spark):
    texts = [None, "", "  ", "\t a b \n", "　x\x1f", "\x85", "​x", "null"]
    assert values(spark, texts, clean_text) == [((t or "").strip(),) for t in texts]


@pytest.mark.parametrize("strict", [False, True])
def test_lists_agree_with_python(spark, strict):
    rng = random.Random(3)
    pools = [TOKENS, ["1", "22", "3", "-4", "+05"], ["a", "b", " c ", ""], ["2026-01-01 00:00:00", "x y"]]
    texts = [None, "", "|", " | ", "||1"]
    texts += ["|".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 6))) for _ in range(300)]
    texts += ["|".join(str(rng.randrange(1000)) for _ in range(n)) for n in (200, 201, 202, 5000)]
    function = sorted_integer_list if strict else sorted_text_list
    got = values(spark, texts, function)
    assert [g for (g,) in got] == [model.list_text(t, strict) for t in texts]


@pytest.mark.parametrize("sep", [",", "::", ".", "_", "1", " ", "-"])
def test_other_item_separators(spark, sep):
    texts = [sep.join(parts) for parts in (["10", "9", "a"], [" 2", "", "b "], ["", "3"], ["30", "4"], ["x", "a"])]
    got = values(spark, texts, lambda x: sorted_text_list(x, sep), lambda x: sorted_integer_list(x, sep))
    assert got == [(model.list_text(t, False, sep), model.list_text(t, True, sep)) for t in texts]


def test_timestamp_spelling_is_kept(spark):
    texts = ["2026-01-07T00:00:00", "2026-01-07 00:00:00"]
    got = values(spark, texts, sorted_text_list, sorted_integer_list)
    assert got == [(t, t) for t in texts]


def test_integer_order_and_spelling(spark):
    tokens = ["-10", "-9", "-1", "0", "1", "9", "10", "1" * 30, "2" * 30, "a"]
    got = values(spark, tokens, integer_sort_key)
    assert sorted(got) == got
    assert [k[0]["shown"] for k in got] == tokens
    assert [k[0]["kind"] for k in values(spark, ["1", "x"], integer_sort_key)] == [0, 1]


def test_operation_codes(spark):
    texts = ["I", " i", "u", "D ", "d", None, "", "x", "ß"]
    got = values(spark, texts, operation_code, is_deleted)
    assert got == [(model.op(t), model.op(t) == "D") for t in texts]
