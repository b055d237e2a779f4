"""Chat formatting with budgeted windows (native expressions only).

A turn becomes ``<|turn|>role<|body|>text<|end|>``.  Inside roles and texts every
backslash is doubled and every control string (of this and of common other templates)
gets a backslash after its first character, so no control string is left, and
dropping one backslash before each character it guards gives the text back.

Windows: a turn costs its tokens: pieces of up to five letters or three digits, and every other
mark that is not white space (``tokens`` takes another count, as an expression).  Prefix sums
of the costs say where a turn begins and ends.  With room for system turn and history taken
off the budget, a conversation whose largest turn takes at most half of what is left is cut into strides of
the room less that turn: turns that begin in one stride form a window.  Otherwise the prefix
sums are cut into blocks of the room: turns wholly in a block form a window, a turn
that reaches over a block's end has one of its own.  So a window never cuts a turn and
keeps within the budget wherever each of its turns does so beside the system turn.  Each window begins with the
system turn and with as many of the preceding window's last turns as fit the history
allowance and the budget; these repeats are context, never loss targets.

Null text and role: empty.  Turns order by turn, then role and text; repeated rows
are turns of their own.  A conversation meets in one task for its running
sums (sorted on disk where it is long); what is held is one window (and for the digests, one conversation).
An empty table gives no windows; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: Where a backslash goes, between the first character and the rest of a control string.
CONTROL = r"(?<=[<\[])(?=\||/?s>|</?SYS>>|/?INST\])"
UNGUARD = r"(?s)\\(.)"
TOKEN = r"\p{L}{1,5}|\p{N}{1,3}|[^\s\p{L}\p{N}]"


def count_tokens(c: Column) -> Column:
    return F.regexp_count(c, F.lit(TOKEN))


def escape(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), CONTROL, r"\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, UNGUARD, "$1")


def turns_of(conversations: DataFrame, tokens: Callable[[Column], Column] = count_tokens) -> DataFrame:
    """(conv_id, turn, role, text, _block, _cost): turns formatted and costed."""
    t = conversations.select(
        "conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    t = t.withColumn("_block", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY), escape(F.col("text")), F.lit(END)))
    return t.withColumn("_cost", tokens(F.col("_block")).cast("long"))


def windows(conversations: DataFrame, budget: int = 2048, history: int = 256, tokens: Callable[[Column], Column] = count_tokens) -> DataFrame:
    """One row a window: conv_id, window, n_context (leading repeated turns), formatted,
    loss_spans (start and length, in characters, of the assistant texts that count), cost."""
    conv = Window.partitionBy("conv_id")
    order = conv.orderBy("turn", "role", "text")
    t = turns_of(conversations, tokens)
    t = t.withColumn("_pos", F.row_number().over(order))
    system = (F.col("_pos") == 1) & (F.col("role") == "system")
    t = t.withColumn("_sys", system)
    upto = conv.orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.when(F.col("_sys"), F.lit(0)).otherwise(F.col("_cost"))
    t = t.withColumns(
        {
            "_own": own,
            "_end": F.sum(own).over(upto),
            "_room": F.lit(budget) - F.sum(F.when(F.col("_sys"), F.col("_cost")).otherwise(F.lit(0))).over(conv),
            "_most": F.max(own).over(conv),
            "_head": F.first(F.when(F.col("_sys"), F.struct("role", "text", "_block", "_cost"))).over(upto),
        }
    )
    left = F.col("_room") - F.lit(history)
    small = F.col("_most") * 2 <= left
    pitch = F.greatest(F.when(small, left - F.col("_most")).otherwise(left), F.lit(1))
    t = t.withColumn("_start", F.col("_end") - F.col("_own"))
    block = F.floor(F.col("_start") / pitch)
    over = ~small & (F.floor(F.greatest(F.col("_end") - 1, F.col("_start")) / pitch) > block)
    t = t.withColumn("_win", (block * 2 + F.when(over, 1).otherwise(0)).cast("long"))
    # What of the preceding window may be repeated: the history, as far as the budget goes.
    t = t.withColumn("_allow", F.least(F.lit(history), F.col("_room") - F.sum("_own").over(Window.partitionBy("conv_id", "_win"))))
    # The start of the next window that has turns: the least start among later windows.
    later = conv.orderBy(F.col("_win").desc()).rangeBetween(Window.unboundedPreceding, -1)
    nxt = F.min(F.struct(F.col("_start").alias("s"), F.col("_win").alias("w"), F.col("_allow").alias("a"))).over(later)
    t = t.withColumn("_next", nxt)
    again = (~F.col("_sys")) & F.col("_next").isNotNull() & (F.col("_next.s") - F.col("_start") <= F.col("_next.a"))
    places = F.array_compact(
        F.array(F.struct(F.col("_win").alias("w"), F.lit(True).alias("fresh")), F.when(again, F.struct(F.col("_next.w").alias("w"), F.lit(False).alias("fresh"))))
    )
    t = t.select("conv_id", "_pos", "role", "text", "_block", "_cost", "_head", "_sys", F.explode(places).alias("_p"))
    body = F.col("role") == "assistant"
    item = F.struct("_pos", F.col("_block").alias("b"), (body & F.col("_p.fresh")).alias("loss"), F.col("_p.fresh").alias("fresh"), F.char_length(F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY))).alias("at"), "_cost")
    w = t.groupBy("conv_id", F.col("_p.w").alias("window")).agg(
        F.sort_array(F.collect_list(item)).alias("items"), F.first("_head", ignorenulls=True).alias("head"), F.bool_or("_sys").alias("own_head")
    )
    head = F.when(F.col("head").isNotNull() & ~F.col("own_head"), F.col("head._block")).otherwise(F.lit(""))
    w = w.withColumns({"_h": head, "_texts": F.transform("items", lambda x: x["b"])})
    w = w.withColumn("formatted", F.concat(F.col("_h"), F.array_join("_texts", "")))
    # Prefix sums of block lengths give each assistant text its place.
    spans = F.aggregate(
        "items",
        F.struct(F.char_length("_h").alias("n"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("s")),
        lambda a, x: F.struct(
            (a["n"] + F.char_length(x["b"])).alias("n"),
            F.when(
                x["loss"],
                F.concat(a["s"], F.array(F.struct((a["n"] + x["at"]).alias("start"), (F.char_length(x["b"]) - x["at"] - len(END)).alias("length")))),
            ).otherwise(a["s"]).alias("s"),
        ),
    )["s"]
    repeats = F.size(F.filter("items", lambda x: ~x["fresh"])) + F.when(F.col("_h") != "", 1).otherwise(0)
    cost = F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x["_cost"]) + F.when(F.col("_h") != "", F.col("head._cost")).otherwise(F.lit(0))
    return w.select("conv_id", "window", repeats.alias("n_context"), "formatted", spans.alias("loss_spans"), cost.alias("cost"))


def read_back(w: DataFrame) -> DataFrame:
    """The digests of each conversation, from its windows alone."""
    blocks = F.expr(f"filter(split(formatted, '<\\\\|turn\\\\|>'), x -> x <> '')")
    fresh = F.slice(blocks, F.col("n_context") + 1, F.greatest(F.size(blocks) - F.col("n_context"), F.lit(0)))
    turn = F.transform(fresh, lambda b: F.concat(unescape(F.substring_index(b, BODY, 1)), F.lit("\n"), unescape(F.regexp_replace(b, r"(?s)^.*?<\|body\|>|<\|end\|>$", "")), F.lit("\n")))
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    per = w.select(
        "conv_id",
        F.struct("window", F.size(fresh).alias("n"), F.array_join(turn, "").alias("t"), F.array_join(loss, "").alias("l"), F.char_length("formatted").cast("long").alias("f")).alias("x"),
    )
    g = per.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    joined = lambda k: F.array_join(F.transform("x", lambda y: y[k]), "")
    total = lambda k: F.aggregate("x", F.lit(0).cast("long"), lambda a, y: a + y[k])
    g = g.select("conv_id", total("n").alias("n_turns"), joined("t").alias("t"), joined("l").alias("l"), total("f").alias("formatted_chars"))
    return g.select(
        "conv_id", "n_turns", F.sha2(F.col("t").cast("binary"), 256).alias("turns_sha256"), F.char_length("l").cast("long").alias("loss_chars"),
        F.sha2(F.col("l").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


def op4_chat(conversations: DataFrame) -> DataFrame:
    """All conversations and conversation -1, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    more = conversations.sparkSession.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    return read_back(windows(conversations.select("conv_id", "turn", "role", "text").unionByName(more)))
