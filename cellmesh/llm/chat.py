"""Chat formatting with Spark expressions alone.

A conversation's turns are collected as structs, sorted, adjacent turns of one role become one block, and
the blocks are concatenated.  The template's control strings mark block, role and turn borders; the same
strings inside a text get an escape mark after their first character, so the output can be read back whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Turns that one fold over a conversation takes.
FOLD = 256


@dataclass(frozen=True)
class Template:
    """Control strings.  Each begins with one of ``<[`` and has neither of these later on, so none can begin
    in one piece of the output and end in another."""

    block: str = "<s>[ROLE]"
    role_end: str = "[/ROLE]"
    turn: str = "[TURN]"
    block_end: str = "</s>"
    #: Further strings that must not appear in an output as text.
    reserved: tuple[str, ...] = ("<s>", "[ROLE]", "[INST]", "[/INST]")
    mark: str = "␛"

    def controls(self) -> list[str]:
        return sorted({self.role_end, self.turn, self.block_end, *self.reserved})

    def escape(self, text: Column) -> Column:
        """Double each mark, then put one behind the first character of each control string."""
        doubled = F.replace(F.coalesce(text, F.lit("")), F.lit(self.mark), F.lit(self.mark * 2))
        return reduce(lambda t, x: F.replace(t, F.lit(x), F.lit(x[0] + self.mark + x[1:])), self.controls(), doubled)

    def unescape(self, text: Column) -> Column:
        """Undo :meth:`escape`: a doubled mark is one, a single one goes."""
        return F.regexp_replace(text, f"{self.mark}({self.mark}?)", "$1")


def format_conversations(
    turns: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: tuple[str, ...] = ("assistant",)
) -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, n_blocks, formatted, loss_spans``.

    ``loss_spans`` are ``(start, length)`` in code points of ``formatted``, from 0: the escaped text of each turn
    of a role in ``learn``.  Turns are ordered by turn number (null first), then role, then text, so ties and
    repeated rows have one result; each repeated row is a turn.  A null role or text is empty; rows whose
    conversation is null form one conversation.  Other columns are left out.  An empty table gives no rows.
    """
    t = template
    rows = turns.select(F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), t.escape(F.col(text)).alias("body")).alias("t"))
    sorted_turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    # Where a role begins: positions from 0 whose role differs from the one before.  Slices between them are blocks.
    begins = F.filter(F.sequence(F.lit(0), F.size("ts") - 1), lambda i: (i == 0) | (F.get("ts", i)["role"] != F.get("ts", F.greatest(i - 1, F.lit(0)))["role"]))
    merged = sorted_turns.withColumn("begins", begins).withColumn(
        "blocks",
        F.transform("begins", lambda b, k: F.slice("ts", b + 1, F.coalesce(F.get("begins", k + 1), F.size("ts")) - b)),
    )
    length = F.char_length
    head = lambda block: F.concat(F.lit(t.block), t.escape(block[0]["role"]), F.lit(t.role_end))
    pieces = merged.withColumn(
        "pieces",
        F.transform("blocks", lambda b: F.struct(head(b).alias("head"), F.transform(b, lambda x: x["body"]).alias("bodies"), b[0]["role"].isin(*learn).alias("learn"))),
    )
    # One entry per turn: what stands before its text, and the text.
    parts = pieces.withColumn(
        "parts",
        F.flatten(
            F.transform(
                "pieces",
                lambda p, k: F.transform(
                    p["bodies"],
                    lambda x, i: F.struct(
                        F.when(i > 0, F.lit(t.turn)).when(k > 0, F.concat(F.lit(t.block_end), p["head"])).otherwise(p["head"]).alias("lead"),
                        x.alias("body"),
                        p["learn"].alias("learn"),
                    ),
                ),
            )
        ),
    )
    # Where learned texts stand: within parts of FOLD turns first, each then moved by what stands before it.  An append copies its array, so
    # one fold over all turns would take their square.
    size = lambda p: (length(p["lead"]) + length(p["body"])).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:int>>").alias("spans"))
    span = lambda at, p: F.struct((at + length(p["lead"])).alias("start"), length(p["body"]).cast("int").alias("length"))
    step = lambda acc, p: F.struct(
        (acc["at"] + size(p)).alias("at"),
        F.when(p["learn"], F.array_append(acc["spans"], span(acc["at"], p))).otherwise(acc["spans"]).alias("spans"),
    )
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("parts") - 1) / FOLD).cast("int")), lambda i: F.aggregate(F.slice("parts", i * FOLD + 1, F.lit(FOLD)), start, step))
    before = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts"))
    shifts = F.aggregate("cut", before, lambda acc, c: F.struct((acc["at"] + c["at"]).alias("at"), F.array_append(acc["starts"], acc["at"]).alias("starts")))["starts"]
    moved = lambda c, at: F.transform(c["spans"], lambda s: F.struct((s["start"] + at).cast("int").alias("start"), s["length"].alias("length")))
    parts = parts.withColumn("cut", cut).withColumn("spans", F.flatten(F.zip_with("cut", shifts, moved)))
    return parts.select(
        "conv_id",
        F.size("ts").cast("long").alias("n_turns"),
        F.size("blocks").cast("long").alias("n_blocks"),
        F.concat(F.array_join(F.transform("parts", lambda p: F.concat(p["lead"], p["body"])), ""), F.lit(t.block_end)).alias("formatted"),
        F.col("spans").alias("loss_spans"),
    )


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The array of ``(role, text)`` that an output holds."""
    t = template
    # Each block ends with block_end; what follows the last is empty.
    blocks = F.filter(F.split(formatted, f"\\Q{t.block_end}\\E", -1), lambda b: b != "")
    body = lambda b: F.substring(b, F.lit(len(t.block) + 1), F.char_length(b))
    parted = F.transform(blocks, lambda b: F.split(body(b), f"\\Q{t.role_end}\\E", -1))
    return F.flatten(
        F.transform(
            parted,
            lambda p: F.transform(F.split(p[1], f"\\Q{t.turn}\\E", -1), lambda x: F.struct(t.unescape(p[0]).alias("role"), t.unescape(x).alias("text"))),
        )
    )


def masked_text(formatted: Column, spans: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: template.unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")
