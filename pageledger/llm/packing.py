"""Best-fit packing of token sequences by sums of squares.

A document's ids end with a closing id.  Only documents longer than a sequence are cut, into full pieces after a first one
that may be shorter.  Full pieces are sequences by themselves.  The others are packed by the sum-of-squares rule, longest
first: a piece goes to the open bin for which the sum over gaps of the squared number of open bins with that gap becomes
least; ties take the smaller gap; a new bin is opened only if no open one has room.

Pieces are dealt evenly into blocks of a bounded number, packed independently, each by one task.  A block is left with at most one
sequence that is no more than half full, as a new one is opened only if no other has room.  These, and as many of the others with the
largest gaps, are then packed again as units, over blocks as before, until one block holds them all: there are at most twice as many
units as blocks, so few rounds follow whatever the number of pieces, and in the end at most one sequence is half empty.

Ids are written with the pieces, numbered by row, and do not go through the blocks: the places are joined to them by that number at the end, by
one shuffle and merge at every size, and full pieces do not move.  Between rounds the slim tables are written to the shared folder; the dealing
uses the row number within a file part of them, so it is the same when a task is repeated.

Defined cases: a null text is empty; an empty text is one piece of the closing id; repeated rows are packed as rows of their own; null ids
are kept; an empty table gives no rows.  Columns other than ``doc_id`` and ``text`` are passed over.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageledger.llm.byte_bpe import encoder
from pageledger.llm.common import Scratch

SEQUENCE, CLOSING_ID = 1024, 2
#: Pieces, or units of later rounds, of a block.
BLOCK_PIECES = 65_536


def pieces_of(docs: DataFrame, sequence: int = SEQUENCE, closing: int = CLOSING_ID, ranks: str | None = None, with_ids: bool = True) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32[, ids]``; ids are little-endian unsigned 32-bit numbers.

    Without ``ids`` their checksum is all that leaves the task, as packing needs lengths only.
    """

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = encoder(ranks)
        end = np.array([closing], "<u4").tobytes()
        for batch in batches:
            doc, piece, start, length, crc, ids = [], [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                body = find.encode(text.as_py()) + end
                n = len(body) // 4
                edges = [0, *range(n % sequence or sequence, n + 1, sequence)]
                for at, (a, b) in enumerate(zip(edges, edges[1:])):
                    doc.append(doc_id)
                    piece.append(at)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(body[4 * a : 4 * b]))
                    if with_ids:
                        ids.append(body[4 * a : 4 * b])
            columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    return rows.mapInArrow(cut, schema + (", ids binary" if with_ids else ""))


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, taken in the given order, and how full each bin is in the end."""
    open_bins = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, filled = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    never = np.int64(1) << 60
    for at, size in enumerate(lengths.tolist()):
        here = open_bins[size:capacity]
        growth = np.where(here > 0, 2 * (open_bins[: capacity - size] - here) + 2, never)
        growth[:1] -= 1  # a bin that becomes full leaves the sum
        found = int(growth.argmin()) if len(growth) else 0
        if len(growth) and here[found] > 0:
            gap = found + size
            chosen = stacks[gap].pop()
            open_bins[gap] -= 1
        else:
            gap, chosen = capacity, len(filled)
            filled.append(0)
        bins[at], offsets[at] = chosen, filled[chosen]
        filled[chosen] += size
        if gap > size:
            open_bins[gap - size] += 1
            stacks[gap - size].append(chosen)
    return bins, offsets, np.array(filled, np.int64)


def _packer(turn: int, sequence: int, order: list[str]):
    def packed(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), *((name, "ascending") for name in order)]).drop_columns(["_block"])
        bins, offsets, filled = place(rows.column("length").to_numpy(), sequence)
        made = (bins + (turn << 56) + (key[0].as_py() << 24), offsets, (sequence - filled)[bins])
        for name, values in zip(("sequence_id", "offset", "gap"), made):
            rows = rows.append_column(name, pa.array(values, pa.int64()))
        return rows

    return packed


def _round(rows: DataFrame, turn: int, blocks: int, sequence: int, order: list[str]) -> DataFrame:
    """The rows with the sequence, offset and gap that they get in their block."""
    schema = ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes) + ", sequence_id bigint, offset bigint, gap bigint"
    dealt = rows.withColumn("_block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks)))
    return dealt.groupBy("_block").applyInArrow(_packer(turn, sequence, order), schema)


def pack(pieces: DataFrame, sequence: int = SEQUENCE, block: int = BLOCK_PIECES) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``; needs ``length``, from 1 to ``sequence``.

    Binary columns, as ``ids``, are written with the pieces and stay there while these are placed.
    """
    scratch = Scratch(pieces.sparkSession, "packing")
    whole = pieces.columns
    pieces = scratch.keep(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    full = pieces.filter(F.col("length") >= sequence)
    full = full.select(*whole, F.col("_row").bitwiseOR(F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    wide = [name for name, kind in pieces.dtypes if kind == "binary"]
    slim = pieces.filter(F.col("length") < sequence).select(*[name for name in pieces.columns if name not in wide])
    blocks = max(1, -(-slim.count() // block))
    order = [name for name in slim.columns if name not in ("length", "_row")] + ["_row"]
    made = scratch.keep(_round(slim, 0, blocks, sequence, order), "round-0")
    placed = made.select("_row", "sequence_id", "offset")
    turn = 0
    while blocks > 1:
        open_ones = made.filter(F.col("offset") == 0).select(F.col("sequence_id").alias("unit"), "gap")
        short = open_ones.filter(2 * F.col("gap") >= sequence)
        n_short, turn = short.count(), turn + 1  # at most one in each block
        roomy = open_ones.filter(2 * F.col("gap") < sequence).orderBy(F.desc("gap"), "unit").limit(n_short)
        units = short.unionByName(roomy).select("unit", (F.lit(sequence) - F.col("gap")).alias("length"))
        blocks = max(1, -(-2 * n_short // block))
        made = scratch.keep(_round(units, turn, blocks, sequence, ["unit"]), f"round-{turn}")
        moves = made.select("unit", F.col("sequence_id").alias("_to"), F.col("offset").alias("_by"))
        placed = placed.join(moves, F.col("sequence_id") == F.col("unit"), "left")
        placed = placed.select("_row", F.coalesce("_to", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("_by", F.lit(0))).alias("offset"))
    rest = pieces.filter(F.col("length") < sequence).join(placed.hint("merge"), "_row")
    return full.unionByName(rest.select(*full.columns))
