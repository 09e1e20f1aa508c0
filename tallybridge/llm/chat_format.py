"""Multi-party perspective rotation of dialogues.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and all others as named users; the mask
marks what the assistant says. Turns are gathered once into blocks of bounded numbers of turns, whatever the number of participants, and blocks in order are the
dialogue. Offsets come from lengths alone: a participant's view of a turn differs from the others' in its heading only, so lengths and numbers
of turns per block and speaker are enough, and no text is moved for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common as C

#: Turns in a block.
BLOCK_TURNS = 256
#: Blocks whose offsets are summed up together.
SPAN = 1024
#: A speaker of this role never answers as an assistant: it gives instructions.
INSTRUCTOR = "system"
END = "<|end|>\n"
ASSISTANT, SYSTEM = "<|assistant|>\n", "<|system|>\n"
#: What stands for a character in a name, so that a name can end no marker and two names never become one.
NAME_ESCAPES = {"%": "%25", "<": "%3C", "|": "%7C", ">": "%3E", "\n": "%0A"}
#: What stands for the beginning of a marker in a text, so that a text can forge none; taking one bar after every "<|" away gives the text back.
MARK, MARK_ESCAPED = "<|", "<||"


def _user_head(speaker: Column) -> Column:
    name = speaker
    for plain, escaped in NAME_ESCAPES.items():
        name = F.replace(name, F.lit(plain), F.lit(escaped))
    return F.concat(F.lit("<|user name="), name, F.lit("|>\n"))


def _head(speaker: Column, perspective: Column, instructor: str) -> Column:
    return F.when(speaker == instructor, F.lit(SYSTEM)).when(speaker == perspective, F.lit(ASSISTANT)).otherwise(_user_head(speaker))


def _running(rows: DataFrame, group: list[str], order: str, sums: dict[str, str]) -> DataFrame:
    """Sums of earlier rows of a group by a whole-number order: over spans of ``SPAN`` numbers first, then within each span. Groups are not null."""
    fine = rows.withColumn("_span", F.floor(F.col(order) / SPAN))
    before = Window.partitionBy(*group).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    coarse = fine.groupBy(*group, "_span").agg(*(F.sum(a).alias(f"_{b}") for a, b in sums.items()))
    coarse = coarse.select(*group, "_span", *(F.coalesce(F.sum(f"_{b}").over(before), F.lit(0)).alias(f"_{b}") for b in sums.values()))
    within = Window.partitionBy(*group, "_span").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = fine.join(coarse, [*group, "_span"])
    for a, b in sums.items():
        out = out.withColumn(b, F.coalesce(F.sum(a).over(within), F.lit(0)) + F.col(f"_{b}")).drop(f"_{b}")
    return out.drop("_span")


def rotate(turns: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", instructor: str = INSTRUCTOR, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per conversation, perspective and block of turns:

    conv_id, perspective, block, first_turn (rank of its first turn), n_turns, start (its offset in the dialogue, in characters), rendered, spans (start and
    stop within ``rendered`` of what is learned), n_masked (their characters).

    Turns are ranked by turn, then speaker and text, so ties have an order and repeated rows stay; a null turn comes first. A null speaker is called
    ``unknown``, a null text is empty; the rows of a null conversation are one conversation. A conversation where only the instructor speaks gives no rows, as
    does an empty table. Other columns are not read. A marker within a text or a name is escaped (``MARK_ESCAPED``, ``NAME_ESCAPES``), so neither can forge a turn
    and no two speakers become one.

    Ranks and offsets are running sums over blocks first and within blocks second: blocks are ranges of the turn number, so one endless
    conversation never meets in one task. Only where more than ``block_turns`` rows share one turn number, or have none, does a block get longer.
    """
    kind = turns.schema[conversation].dataType
    t = turns.select(
        F.coalesce(F.col(conversation).cast("string"), F.lit("")).alias("_conv"), F.col(conversation).isNull().alias("_none"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(speaker).cast("string"), F.lit("unknown")).alias("speaker"), F.replace(F.coalesce(F.col(text), F.lit("")), F.lit(MARK), F.lit(MARK_ESCAPED)).alias("text"),
    ).withColumn("block", F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(-1)).cast("long"))
    conv, place = ["_conv", "_none"], ["_conv", "_none", "block"]
    # without texts: turns and characters of every speaker in every block
    said = C.materialize(t.groupBy(*place, "speaker").agg(F.count("*").alias("turns"), F.sum(F.length("text")).cast("long").alias("chars")), "said")
    people = said.where(F.col("speaker") != instructor).select(*conv, F.col("speaker").alias("perspective")).distinct()
    others = F.length(_head(F.col("speaker"), F.lit(None), instructor)) + len(END)
    totals = said.groupBy(*place).agg(F.sum("turns").alias("n_turns"), F.sum(F.col("chars") + F.col("turns") * others).alias("length"))
    views = _running(totals, conv, "block", {"length": "_start", "n_turns": "first_turn"}).select(*place, "_start", "first_turn", "n_turns").join(people, conv)
    own = said.select(*place, F.col("speaker").alias("perspective"), F.col("turns").alias("_own"))
    views = _running(views.join(own, [*place, "perspective"], "left").fillna(0, ["_own"]), [*conv, "perspective"], "block", {"_own": "_before"})
    start = F.col("_start") + F.col("_before") * (F.lit(len(ASSISTANT)) - F.length(_user_head(F.col("perspective"))))
    views = views.select(*place, "perspective", "first_turn", "n_turns", start.alias("start"))
    # the only move of texts; the views of a block come to where it is
    blocks = t.groupBy(*place).agg(F.array_sort(F.collect_list(F.struct("turn", "speaker", "text"))).alias("_turns"))

    def rendered(x: Column) -> Column:
        head = _head(x["speaker"], F.col("perspective"), instructor)
        return F.struct(F.length(head).alias("head"), F.concat(head, x["text"], F.lit(END)).alias("piece"), (x["speaker"] == F.col("perspective")).alias("own"))

    out = blocks.join(views, place).withColumn("_said", F.transform("_turns", rendered)).drop("_turns")
    ends = F.aggregate("_said", F.expr("cast(array(0L) as array<bigint>)"), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x["piece"]))))
    out = out.withColumn("_ends", ends)
    spans = F.filter(
        F.transform("_said", lambda x, i: F.when(x["own"], F.struct((F.get("_ends", i) + x["head"]).alias("start"), F.get("_ends", i + 1).alias("stop")))), lambda s: s.isNotNull()
    )
    out = out.withColumn("rendered", F.array_join("_said.piece", "")).withColumn("spans", spans).withColumn("conv_id", F.when(~F.col("_none"), F.col("_conv").cast(kind)))
    masked = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return out.select("conv_id", "perspective", "block", "first_turn", "n_turns", "start", "rendered", "spans", masked.alias("n_masked"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations from every participant's view."""
    r = rotate(C.table(spark, sf_dir, "conversations"))
    marks = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return r.select("conv_id", "perspective", "block", "first_turn", "n_turns", "start", F.length("rendered").cast("long").alias("n_chars"), F.sha2("rendered", 256).alias("rendered_sha256"), marks.alias("mask"), "n_masked")
