"""Chat formatting of ordered turns with Spark expressions only.

The project's records have roles and an order within a key, but no prose; this operator is general: any table
of conversation, turn, role and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statewatch.functions.arrays import let

#: Fixed values of the template. A turn after one of the same role is set off by SEP inside the same block.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: Escapes inside roles and texts: what opens a mark, and the escape character itself. A role also ends at a line break.
MARK, ESCAPE = "<|", "\\"


def escape(text: Column, line: bool = False) -> Column:
    """Reversible: afterwards no mark can occur. ``line`` also takes out line breaks."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0"))
    out = F.replace(out, F.lit(MARK), F.lit(ESCAPE + "1"))
    return F.replace(out, F.lit("\n"), F.lit(ESCAPE + "2")) if line else out


def unescape(text: Column) -> Column:
    out = F.replace(text, F.lit(ESCAPE + "2"), F.lit("\n"))
    out = F.replace(out, F.lit(ESCAPE + "1"), F.lit(MARK))
    return F.replace(out, F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def merged_turns(turns: Column) -> Column:
    """Blocks ``(role, texts)`` of the sorted turns: neighbours of one role share a block. Linear in the turns."""

    def blocks(t: Column) -> Column:
        positions = F.sequence(F.lit(0), F.size(t) - 1)
        opens = F.filter(positions, lambda i: (i == 0) | (F.get(t, i)["role"] != F.get(t, i - 1)["role"]))

        def cut(starts: Column) -> Column:
            return F.transform(
                starts,
                lambda s, j: F.struct(
                    F.get(t, s)["role"].alias("role"),
                    F.slice(t["text"], s + 1, F.coalesce(F.get(starts, j + 1), F.size(t)) - s).alias("texts"),
                ),
            )

        return let(opens, cut)

    return let(turns, blocks)


def segments(block: Column, learn: str) -> Column:
    """The block as ``(piece, loss)`` in output order; ``loss`` marks the texts of the role to learn."""
    mark = lambda piece: F.struct(piece.alias("piece"), F.lit(False).alias("loss"))
    head = F.concat(F.lit(START), escape(block["role"], line=True), F.lit("\n"))
    body = F.transform(
        block["texts"],
        lambda t, i: F.array(
            mark(F.when(i == 0, head).otherwise(F.lit(SEP))),
            F.struct(escape(t).alias("piece"), (block["role"] == learn).alias("loss")),
        ),
    )
    return F.concat(F.flatten(body), F.array(mark(F.lit(END))))


def format_conversations(
    turns: DataFrame, conversation: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant"
) -> DataFrame:
    """One row per conversation: ``conversation, segments, formatted``.

    ``formatted`` is the concatenation of ``segments`` (``piece``, ``loss``), whose flag is the loss mask: the texts of role
    ``learn``, each once and in order. Turns sort by ``order``, then role and text, so ties and repeated rows have one
    defined place and all stay. NULL text or role counts as empty, NULL order comes first, NULL conversations form
    one conversation. Adjacent turns of one role share a block, with a separator, so ``read_turns`` gets every turn back. An empty
    table gives no rows; other columns are not read. A conversation is one output row, so it has to fit one.
    """
    row = F.struct(F.col(order).alias("order"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    held = turns.groupBy(F.col(conversation).alias("conversation")).agg(F.sort_array(F.collect_list(row)).alias("turns"))
    cut = held.select("conversation", F.flatten(F.transform(merged_turns(F.col("turns")), lambda b: segments(b, learn))).alias("segments"))
    return cut.withColumn("formatted", F.array_join(F.col("segments.piece"), ""))


def read_turns(formatted: Column) -> Column:
    """The turns ``(role, text)`` of a formatted conversation, as they were."""
    parts = F.split(formatted, r"\Q" + END + r"\E")
    blocks = F.slice(parts, 1, F.size(parts) - 1)

    def turns(block: Column) -> Column:
        opened = F.substr(block, F.lit(len(START) + 1))
        role = F.substring_index(opened, "\n", 1)
        body = F.substr(opened, F.length(role) + 2)
        return F.transform(F.split(body, r"\Q" + SEP + r"\E"), lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    kept = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(kept, lambda s: unescape(s["piece"])), "")
