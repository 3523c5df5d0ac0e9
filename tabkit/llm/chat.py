"""Chat formatting by prefix-target expansion, in built-in functions only.

Each assistant turn becomes an example of its own: all turns up to and with it, formatted, and a mask over that reply alone.
A conversation that does not end with an assistant turn has one more example with all turns and nothing under the mask, so that
the output always holds the whole conversation. Examples are prefixes of one formatted text, cut by running lengths.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. Inside roles and texts a backslash is doubled and ``<|`` is written
``<\\|``; in roles a line break is written ``<\\-``. No text can then hold a mark, and reading back restores every text.

Turns are ordered by turn, then role and text; repeated turns each count. Null roles and texts are empty; a null conversation id is a conversation like
others. Only the role ``assistant`` (exactly) is trained. A conversation is one row and so one task's work, as its digests are of one text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabkit.llm.common import name

# The marks of the template.
START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text, role: bool = False):
    text = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(text, F.lit("\n"), F.lit("<\\-")) if role else text


def unescape(text, role: bool = False):
    text = F.replace(text, F.lit("<\\-"), F.lit("\n")) if role else text
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, example (from 0), formatted, loss (array of start and end in code points), whole (holds all turns)."""
    empty = lambda c: F.coalesce(name(c).cast("string"), F.lit(""))
    rows = turns.select(name(conv).alias("conv_id"), name(turn).alias("turn"), empty(role).alias("role"), empty(text).alias("text"))
    rows = rows.withColumns({"escaped": escape(F.col("text")), "head": F.concat(F.lit(START), escape(F.col("role"), True), F.lit("\n"))})
    part = F.concat("head", "escaped", F.lit(END))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select(
        "conv_id",
        F.row_number().over(order).alias("place"),
        part.alias("part"),
        (F.col("role") == "assistant").alias("target"),
        F.sum(F.length(part).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("end"),
        F.length("escaped").cast("long").alias("size"),
    )
    joined = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "part", "target", "end", "size"))).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: t["part"]), "")
    last = F.element_at("turns", -1)
    joined = joined.withColumns({"body": whole, "length": last["end"]})
    targets = F.filter("turns", lambda t: t["target"] | (t["place"] == F.size("turns")))
    joined = joined.select("conv_id", "body", "length", F.posexplode(F.transform(targets, lambda t: F.struct(t["target"], t["end"], t["size"]))).alias("example", "t"))
    stop = F.col("t.end") - len(END)
    span = F.struct((stop - F.col("t.size")).alias("start"), stop.alias("end"))
    return joined.select(
        "conv_id",
        "example",
        F.col("body").substr(F.lit(1), F.col("t.end").cast("int")).alias("formatted"),
        F.when(F.col("t.target"), F.array(span)).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("loss"),
        (F.col("t.end") == F.col("length")).alias("whole"),
    )


def read_turns(formatted):
    """The turns of a formatted text as array of (role, text)."""
    parts = F.split(formatted, "<\\|im_end\\|>\n")
    parts = F.slice(parts, 1, F.size(parts) - 1)
    role = lambda p: F.substring_index(p.substr(F.lit(len(START) + 1), F.length(p)), "\n", 1)
    return F.transform(
        parts,
        lambda p: F.struct(unescape(role(p), True).alias("role"), unescape(p.substr(F.length(role(p)) + len(START) + 2, F.length(p))).alias("text")),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """What the examples hold, read from ``formatted`` and ``loss`` alone: one row per conversation."""
    masked = F.transform("loss", lambda s: unescape(F.col("formatted").substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    turns = F.when(F.col("whole"), read_turns(F.col("formatted")))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = examples.select("conv_id", "example", F.length("formatted").cast("long").alias("chars"), F.array_join(masked, "").alias("masked"), turns.alias("turns"))
    rows = rows.select("conv_id", "example", "chars", "masked", F.size("turns").cast("long").alias("n"), F.sha2(spoken.cast("binary"), 256).alias("sha"), F.col("turns").isNotNull().alias("whole"))
    rows = rows.groupBy("conv_id").agg(
        F.max(F.when(F.col("whole"), F.col("n"))).alias("n_turns"),
        F.max(F.when(F.col("whole"), F.col("sha"))).alias("turns_sha256"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "masked"))), lambda x: x["masked"]), "").alias("loss_text"),
        F.sum("chars").alias("formatted_chars"),
    )
    return rows.select("conv_id", "n_turns", "turns_sha256", F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
