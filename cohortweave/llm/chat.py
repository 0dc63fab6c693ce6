"""Multi-party perspective rotation of dialogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BLOCK = 512  # messages that stand together in one row between the two shuffles
PREFIX = 64
OWN = "<|assistant|>\n"


def rotate_perspectives(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per message and perspective: conv_id, perspective, seq, turn, speaker, text, body_start, body_end, learn.

    For every participant the dialogue is rendered with that speaker as `assistant` and the others as users named by role.
    `text` is the rendered message; a dialogue's texts, joined in order of seq (from 0), are the whole rendering, in which
    body_start and body_end (code points, end exclusive) bound the message's own words, and `learn` marks those that
    the assistant said, which a trainer learns from. Messages go by turn, then role and text; equal ones are each rendered.
    Null role is `unknown`, null text empty, null turn -1; all messages without a conv_id are one conversation.

    A dialogue may hold most of the table: messages are ranged over all partitions by conversation, turn, role and the first PREFIX
    code points, so the bounds that the driver samples hold no whole texts; equal short ones spread too. They are cut into blocks of at most `block`. Running offsets come from one row per block: of all messages in users' form, and of each
    speaker's own, whose heading has another length. Texts meet the participants block by block.
    """
    c = conversations.select(
        F.struct("conv_id").alias("conv"), F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"),
    )
    order = ["conv", "turn", "role", "text", "row"]
    short = F.when(F.length("text") <= PREFIX, F.col("row"))  # of equal prefixes of longer texts the rest decides, inside their partition
    c = written(c.repartitionByRange("conv", "turn", "role", F.substring("text", 1, PREFIX), short).sortWithinPartitions(*order).select("conv", "turn", "role", "text", F.monotonically_increasing_id().alias("pos")))
    c = c.withColumn("block", F.floor(F.col("pos") / block))
    head = F.concat(F.lit("<|user:"), F.col("role"), F.lit("|>\n"))
    size = F.length(head) + F.length("text") + 1
    sizes = c.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("size"))
    earlier = lambda x, *by: F.coalesce(F.sum(x).over(Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    sizes = sizes.select("conv", "block", earlier("n", "conv").alias("seq"), earlier("size", "conv").alias("at"))
    spoke = c.groupBy("conv", "block", "role").agg(F.count(F.lit(1)).alias("k")).withColumnRenamed("role", "perspective")
    who = c.select("conv", F.col("role").alias("perspective")).distinct()
    grid = sizes.join(who, "conv").join(spoke, ["conv", "block", "perspective"], "left")
    shift = len(OWN) - F.length(F.concat(F.lit("<|user:"), F.col("perspective"), F.lit("|>\n")))
    grid = grid.select("conv", "block", "perspective", "seq", (F.col("at") + shift * earlier(F.coalesce("k", F.lit(0)), "conv", "perspective")).alias("at"))
    said = c.groupBy("conv", "block").agg(F.array_sort(F.collect_list(F.struct("pos", "turn", "role", "text"))).alias("said"))
    both = grid.join(said, ["conv", "block"])
    zero = F.struct(F.col("at").alias("at"), F.array().cast("array<struct<turn:bigint,role:string,text:string,lo:bigint,hi:bigint,learn:boolean>>").alias("out"))

    def render(a, s):
        own = s["role"] == F.col("perspective")
        top = F.when(own, F.lit(OWN)).otherwise(F.concat(F.lit("<|user:"), s["role"], F.lit("|>\n")))
        lo = a["at"] + F.length(top)
        hi = lo + F.length(s["text"])
        row = F.struct(s["turn"].alias("turn"), s["role"].alias("role"), F.concat(top, s["text"], F.lit("\n")).alias("text"), lo.alias("lo"), hi.alias("hi"), own.alias("learn"))
        return F.struct((hi + 1).alias("at"), F.concat(a["out"], F.array(row)).alias("out"))

    shown = both.select("conv", "perspective", "seq", F.posexplode(F.aggregate("said", zero, render)["out"]).alias("i", "m"))
    return shown.select(
        "conv.conv_id", "perspective", (F.col("seq") + F.col("i")).alias("seq"), "m.turn", F.col("m.role").alias("speaker"), "m.text",
        F.col("m.lo").alias("body_start"), F.col("m.hi").alias("body_end"), "m.learn",
    )
