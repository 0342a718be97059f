"""Chat formatting in budgeted windows, with DataFrame operations only.

Template. A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. In texts and roles a backslash is written ``\\s``,
``<|`` is written ``<\\p``, and in roles a line feed ``\\n``, so a marker in a text is never read as one and
every text can be read back (``unescape``).

Windows. Turns are counted in tokens (words and ``OVERHEAD`` for the markers). The prefix sum of a conversation
cuts it into cells, of the budget less what history or the system turn may take: a turn belongs to the cell in which it starts,
whole, so only the last turn of a cell reaches beyond it. A cell is a window if it fits in the budget with the system turn; if not,
its last turn has a window of its own. So each turn is new in exactly one window, whole. Each window starts with the
conversation's first system turn (unless new there), of which ``system`` tokens are repeated at most, and then repeats the turns before
it that fit in ``history`` tokens and in what is left of the budget. A window thus keeps ``budget``, unless its one
new turn alone is larger; what such a window repeats is bounded all the same. A system turn is left out of a window that fits only
without it. The loss mask has the texts of new assistant turns only: repeated ones are masked.

Scale. Prefix sums come in two steps, blocks of ``BLOCK`` turn numbers and turns within a block, so one
conversation with a third of all rows is spread over its blocks. Cells group at most a budget of tokens and one turn, and get the
end of the cell before by its number. The system turn is joined by conversation and ``SPREAD`` cells, so that the windows of one
conversation do not meet in a task.

Rows. Null texts and roles are empty. Rows are ordered by turn, then role and text; repeated rows
are turns of their own. Null conv_ids make one conversation, null turns come first. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.shared import WORD, durable, n_words

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
OVERHEAD = 4
BLOCK = 128
SPREAD = 64


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<|"), F.lit("<\\p"))


def unescape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("\\p"), F.lit("|")), F.lit("\\n"), F.lit("\n"))
    return F.replace(text, F.lit("\\s"), F.lit("\\"))


def _spans(conversations: DataFrame, step: int) -> DataFrame:
    """Turns with ``start`` and ``stop`` (tokens before and after) and the number of the cell in which they start."""
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    turns = conversations.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), (n_words(text) + OVERHEAD).alias("tokens"),
        F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**62))).alias("block"),
    )
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = turns.groupBy("conv_id", "block").agg(F.sum("tokens").alias("sum"))
    blocks = blocks.select("conv_id", "block", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("earlier")).alias("b")
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = turns.withColumn("sum", F.sum("tokens").over(inside)).alias("t")
    rows = rows.join(blocks, F.col("t.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("t.block") == F.col("b.block")))
    stop = F.col("earlier") + F.col("sum")
    rows = rows.select("t.conv_id", "turn", "role", "text", (stop - F.col("tokens")).alias("start"), stop.alias("stop"))
    return rows.withColumn("cell", F.floor(F.col("start") / step))


def _systems(cells: DataFrame, allowance: int) -> DataFrame:
    """The first system turn of each conversation, cut to the allowance, once for every ``SPREAD`` cells."""
    first = F.get(F.filter("turns", lambda t: t.role == "system"), F.lit(0))
    space = WORD.replace("[^", "[")[:-1]
    words = rf"^{space}*+(?:{WORD}+{space}*+){{0,{allowance - OVERHEAD}}}"
    found = cells.select("conv_id", "cell", first.alias("system")).select(
        "conv_id", "cell", F.when(F.col("system").isNotNull(), F.struct(
            "system.start", "system.stop", "system.role", F.regexp_extract("system.text", words, 0).alias("text")
        )).alias("system")
    )
    found = found.groupBy(F.col("conv_id").alias("s_conv")).agg(F.min("system").alias("system"), F.max("cell").alias("cell"))
    places = F.sequence(F.lit(0).cast("long"), F.floor(F.col("cell") / SPREAD))
    return found.where(F.col("system").isNotNull()).select("s_conv", "system", F.explode(places).alias("s_cells"))


def windows(conversations: DataFrame, budget: int = 1024, history: int = 128, system: int = 128) -> DataFrame:
    """One row per training window: conv_id, window, formatted, n_repeated, loss.

    ``window`` rises within a conversation, with gaps. ``n_repeated`` turns at the front are repeated; ``loss`` is
    array<struct<start, length>> of code points in ``formatted``.
    """
    step = budget - max(history, system)
    if system < OVERHEAD or history < 0 or step < 1:
        raise ValueError(f"a budget of {budget} tokens leaves no room beside {history} of history and {system} for the system turn")
    turn = F.struct("start", "stop", "role", "text")
    cells = durable(_spans(conversations, step).groupBy("conv_id", "cell").agg(F.sort_array(F.collect_list(turn)).alias("turns")))
    near_end = lambda t: (t.start >= (F.col("cell") + 1) * step - history) & (t.stop - t.start <= history)
    tails = cells.select(F.col("conv_id").alias("t_conv"), (F.col("cell") + 1).alias("t_cell"), F.filter("turns", near_end).alias("tail"))
    systems = _systems(cells, system)
    rows = cells.join(
        tails.where(F.size("tail") > 0), F.col("conv_id").eqNullSafe(F.col("t_conv")) & (F.col("cell") == F.col("t_cell")), "left"
    ).join(systems, F.col("conv_id").eqNullSafe(F.col("s_conv")) & (F.floor(F.col("cell") / SPREAD) == F.col("s_cells")), "left")

    none = F.filter("turns", lambda t: F.lit(False))
    tail = F.coalesce("tail", none)
    first, last = F.element_at("turns", 1), F.element_at("turns", -1)
    within = F.slice("turns", F.lit(1), F.size("turns") - 1)
    window = lambda rest, new, past: F.struct((2 * F.col("cell") + rest).alias("window"), new.alias("new"), past.alias("past"))
    system_size = F.least(F.col("system.stop") - F.col("system.start"), F.lit(system))
    repeated = F.when(F.col("system.start") < first.start, system_size).otherwise(0)
    alone = (F.size("turns") > 1) & (last.stop - first.start + repeated > budget)
    pieces = F.when(alone, F.array(window(0, within, tail), window(1, F.array(last), F.concat(tail, within)))).otherwise(
        F.array(window(0, F.col("turns"), tail))
    )
    rows = rows.select("conv_id", "system", F.explode(pieces).alias("w")).select("conv_id", "system", "w.*")

    begin = F.element_at("new", 1).start
    size = F.element_at("new", -1).stop - begin
    keep_system = F.col("system").isNotNull() & (F.col("system.start") < begin) & ((size + system_size <= budget) | (size > budget))
    left = F.when(size > budget, history).otherwise(budget - size - F.when(keep_system, system_size).otherwise(0))
    past = F.filter("past", lambda t: t.start >= begin - F.least(left, F.lit(history)))
    past = F.when(keep_system, F.concat(F.array("system"), F.filter(past, lambda t: t.start != F.col("system.start")))).otherwise(past)
    rows = rows.select("conv_id", "window", "new", past.alias("past"))

    head = lambda t: F.concat(F.lit(OPEN), F.replace(escape(t.role), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    parts = F.transform(
        F.concat("past", "new"), lambda t: F.struct(t.role.alias("role"), head(t).alias("head"), escape(t.text).alias("body"))
    )
    rows = rows.select("conv_id", "window", F.size("past").alias("n_repeated"), parts.alias("parts"))
    formatted = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    lengths = F.transform(
        "parts",
        lambda p, i: F.struct(
            F.length(p["head"]).alias("head"),
            F.length(p["body"]).alias("body"),
            ((p["role"] == "assistant") & (i >= F.col("n_repeated"))).alias("target"),
        ),
    )
    start = F.struct(F.lit(0).alias("at"), F.expr("array_repeat(struct(0 AS start, 0 AS length), 0)").alias("loss"))

    def add(seen: Column, p: Column) -> Column:
        body = seen.at + p["head"]
        span = F.array(F.struct(body.alias("start"), p["body"].alias("length")))
        return F.struct(
            (body + p["body"] + len(CLOSE)).alias("at"), F.when(p["target"], F.concat(seen.loss, span)).otherwise(seen.loss).alias("loss")
        )

    return rows.select(
        "conv_id", "window", formatted.alias("formatted"), "n_repeated", F.aggregate(lengths, start, add, lambda s: s.loss).alias("loss")
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted window: array<struct<role, text>>."""
    pieces = F.slice(F.split(formatted, r"<\|im_end\|>\n", -1), F.lit(1), F.size(F.split(formatted, r"<\|im_end\|>\n", -1)) - 1)

    def turn(piece: Column) -> Column:
        body = F.substring(piece, F.lit(len(OPEN) + 1), F.length(piece))
        cut = F.instr(body, "\n")
        return F.struct(
            unescape(F.substring(body, F.lit(1), cut - 1)).alias("role"), unescape(F.substring(body, cut + 1, F.length(body))).alias("text")
        )

    return F.transform(pieces, turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """The unescaped texts under the loss mask."""
    return F.transform(loss, lambda s: unescape(F.substring(formatted, s.start + 1, s.length)))
