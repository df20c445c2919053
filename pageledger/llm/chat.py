"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs, sorted by ``(turn, role, text)``, adjacent turns of one role are merged
into one block, and the blocks are concatenated::

    ### role: text</part>text</turn>\n

Control strings inside roles and texts are escaped: a backslash becomes ``\\b``, ``###`` ``\\h``, ``</turn>`` ``\\t`` and
``</part>`` ``\\p``; in roles a colon becomes ``\\c``.  Every backslash of the output is followed by its letter, so this
is undone by plain replacement.  The loss mask is a list of code point spans, one for each assistant turn's escaped text.

Defined cases: null text or role is empty; null turns sort first; repeated rows are turns of their own; a null ``conv_id`` is
a conversation like any other; an empty table gives no rows; other columns are passed over.  A conversation is one
output value, so its turns meet in one task, as one array of about the size of that value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, MIDDLE, PART, TURN = "### ", ": ", "</part>", "</turn>\n"
CONTROL = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"), ("</part>", "\\p"))


def escape(text: Column) -> Column:
    for plain, marked in CONTROL:
        text = F.replace(text, F.lit(plain), F.lit(marked))
    return text


def unescape(text: Column) -> Column:
    for plain, marked in reversed(CONTROL):
        text = F.replace(text, F.lit(marked), F.lit(plain))
    return text


def _role(text: Column) -> Column:
    return F.replace(escape(text), F.lit(":"), F.lit("\\c"))


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``conv_id, formatted, loss_spans array<struct<from, length>>, n_blocks``."""
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    # Collected structs sort by turn, role and text; everything after this one exchange works on the array.
    sorted_turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    pieces = sorted_turns.select("conv_id", F.transform("turns", _piece).alias("pieces"))
    placed = pieces.select("conv_id", "pieces", _placed(loss_role).alias("placed"))
    return placed.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("formatted"),
        F.flatten("placed.spans").alias("loss_spans"),
        F.aggregate("pieces", F.lit(0).cast("bigint"), lambda n, p: n + p["opens"].cast("bigint")).alias("n_blocks"),
    )


def _piece(turn: Column, at: Column) -> Column:
    """A turn's part of its block: a role that differs from a neighbour's opens or closes the block, else the texts are merged."""
    opens = (at == 0) | (F.get(F.col("turns"), at - 1)["role"] != turn["role"])
    closes = (at == F.size("turns") - 1) | (F.get(F.col("turns"), at + 1)["role"] != turn["role"])
    head = F.when(opens, F.concat(F.lit(HEAD), _role(turn["role"]), F.lit(MIDDLE))).otherwise(F.lit(PART))
    tail = F.when(closes, F.lit(TURN)).otherwise(F.lit(""))
    return F.struct(turn["role"].alias("role"), opens.alias("opens"), head.alias("head"), escape(turn["text"]).alias("body"), tail.alias("tail"))


def _placed(loss_role: str) -> Column:
    """The loss spans, ``struct<at, spans array<array<struct<from, length>>>>``.

    An aggregate copies the array that it appends to, so the pieces are folded in stretches of the root of their number, each from its
    own start, and the stretches are folded after that.
    """
    span = "array<struct<from:bigint,length:bigint>>"
    width = F.ceil(F.sqrt(F.size("pieces"))).cast("int")
    stretches = F.transform(F.sequence(F.lit(1), F.size("pieces"), width), lambda start: F.slice("pieces", start, width))

    def add(state: Column, piece: Column) -> Column:
        start = state["at"] + F.length(piece["head"])
        length = F.length(piece["body"]).cast("bigint")
        found = F.array(F.struct(start.alias("from"), length.alias("length")))
        spans = F.when(piece["role"] == loss_role, F.concat(state["spans"], found)).otherwise(state["spans"])
        return F.struct((start + length + F.length(piece["tail"])).alias("at"), spans.alias("spans"))

    def append(state: Column, stretch: Column) -> Column:
        moved = F.transform(stretch["spans"], lambda s: F.struct((s["from"] + state["at"]).alias("from"), s["length"].alias("length")))
        return F.struct((state["at"] + stretch["at"]).alias("at"), F.concat(state["spans"], F.array(moved)).alias("spans"))

    def empty(kind: str) -> Column:
        return F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(kind).alias("spans"))

    folded = F.transform(stretches, lambda stretch: F.aggregate(stretch, empty(span), add))
    return F.aggregate(folded, empty(f"array<{span}>"), append)


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, ``array<struct<role, text>>``."""
    blocks = F.filter(F.split(formatted, TURN, -1), lambda b: F.startswith(b, F.lit(HEAD)))

    def of(block: Column) -> Column:
        role = F.substring_index(block, MIDDLE, 1)
        body = F.substr(block, F.length(role) + F.lit(len(MIDDLE) + 1))
        plain = unescape(F.replace(F.substr(role, F.lit(len(HEAD) + 1)), F.lit("\\c"), F.lit(":")))
        return F.transform(F.split(body, PART, -1), lambda text: F.struct(plain.alias("role"), unescape(text).alias("text")))

    return F.flatten(F.transform(blocks, of))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped, in order."""
    pieces = F.transform(spans, lambda s: unescape(F.substr(formatted, (s["from"] + 1).cast("int"), s["length"].cast("int"))))
    return F.array_join(pieces, "")
