"""Byte-level BPE encoding and decoding by a monoid tree reduction.

A text is halved down to leaves, leaves are encoded by themselves, and neighbours are joined on the way up.  Only the ids around a
border can change, so a join encodes a window around it anew and keeps the ids outside.  The window grows until these are proved
to stay:

* **Between matches of the split pattern.**  Some pairs of neighbouring characters are never inside one match, whatever stands around
  them: a blank after what is no blank, a letter or digit before what is none, a sign before a letter or digit (not an apostrophe, as
  ``'s`` is one match).  The pattern looks at nothing before a match, so ids on either side of such a place are those of the sides alone.
  A window grows, character by character, to the nearest such place on each side of the border.
* **Inside one long match**, which has no such place, the same is done with bytes.  A sequence of ids is the encoding of its bytes
  exactly when each neighbouring pair is the encoding of its own bytes: the first merge across two neighbours would also happen
  between these two alone.  A window of ids around the border is encoded anew, doubled until the pairs at both its edges hold.

Long matches are found before their surroundings are halved and are encoded once.  A text longer than ``SEGMENT`` characters is cut
into segments that are rows, encoded by different tasks, and its segments' ids are joined pair by pair by the same rule; the
ids of a text are one row at the end, as its text was at the start.  Decoding splits ids the same way and concatenates the bytes.

Defined cases: null and empty texts have no ids; repeated rows are encoded alike; null ids are kept; an empty table gives no
rows; columns other than ``doc_id`` and ``text`` are passed over by ``encode`` and kept by ``decode``.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from pageledger.llm.common import buffers, slices

RANKS = "byte_bpe_50k.tiktoken"
#: Characters of a leaf; bytes of a match, or characters of a window, that are encoded in one go; ids that are decoded in one go.
LEAF, WINDOW, DECODED = 1_024, 256, 4_096
#: Characters of a segment, a row of its own; bytes of text that a task works on before it hands over its ids.
SEGMENT, TEXT_BYTES = 1 << 18, 1 << 20


@lru_cache(1 << 16)
def _kind(character: str) -> str:
    """Blank, letter, number or sign as the split pattern sees it; ``?`` where Unicode versions may differ."""
    if character in "\t\n\x0b\x0c\r \x85\xa0" or unicodedata.category(character) in ("Zs", "Zl", "Zp"):
        return " "
    category = unicodedata.category(character)
    if category == "Cn":
        return "?"
    return category[0] if category[0] in "LN" else "'" if character == "'" else "."


@lru_cache(1 << 16)
def parted(before: str, after: str) -> bool:
    """Whether no match of the split pattern holds these two characters side by side, whatever is around them."""
    left, right = _kind(before), _kind(after)
    if "?" in (left, right) or left == " ":
        return False
    return right == " " or (left != right and (left in "LN" or right in "LN") and (left, right) != ("'", "L"))


class Encoder:
    def __init__(self, ranks: str | None = None, leaf: int = LEAF, window: int = WINDOW):
        with open(ranks or public_tokenizers.path(RANKS), "rb") as lines:
            known = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
        self.encoding = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})
        self.plain = self.encoding.encode_ordinary
        self.piece = self.encoding._encode_single_piece
        self.bytes = {rank: token for token, rank in known.items()}
        self.sizes = {rank: len(token) for token, rank in known.items()}
        self.split = regex.compile(public_tokenizers.PATTERN)
        self.leaf, self.window = leaf, window
        self.holds = lru_cache(1 << 16)(self._holds)

    # --- between matches

    def encode(self, text: str, start: int = 0, end: int | None = None) -> list[int]:
        """The ids of ``text[start:end]``."""
        end = len(text) if end is None else end
        if end - start <= self.leaf:
            return self.plain(text[start:end])
        middle = (start + end) // 2
        before, after = self.around(text, start, middle, end)
        if after - before > self.leaf:  # one or two long matches; their surroundings end where they do
            between = self.window_ids(text[before:after])
            left = self.encode(text, start, before) if before > start else []
            return left + between + (self.encode(text, after, end) if after < end else [])
        return self.join(text, before, middle, after, self.encode(text, start, middle), self.encode(text, middle, end))

    def around(self, text: str, start: int, middle: int, end: int) -> tuple[int, int]:
        """The window around a border: the nearest places on either side where no match goes on, or the ends."""
        before = middle
        while before > start and not (before < end and parted(text[before - 1], text[before])):
            before -= 1
        after = middle
        while after < end and not (after > start and parted(text[after - 1], text[after])):
            after += 1
        return before, after

    def join(self, text: str, before: int, middle: int, after: int, left: list[int], right: list[int]) -> list[int]:
        """The ids of two neighbours; what lies in ``text[before:after]`` is encoded anew."""
        if before == middle == after:
            return left + right
        kept = len(left) - self.count_back(left, len(text[before:middle].encode()))
        return left[:kept] + self.window_ids(text[before:after]) + right[self.count(right, len(text[middle:after].encode())) :]

    def count(self, ids: list[int], n_bytes: int) -> int:
        """How many ids from the first on hold the given bytes, which end between matches and so between ids."""
        at = 0
        while n_bytes > 0 and at < len(ids):
            n_bytes -= self.sizes[ids[at]]
            at += 1
        return at

    def count_back(self, ids: list[int], n_bytes: int) -> int:
        return self.count(ids[::-1] if n_bytes > 4 * self.window else ids[: -n_bytes - 1 : -1], n_bytes)

    def window_ids(self, text: str) -> list[int]:
        """The ids of a window between two places where no match goes on."""
        if len(text) <= self.window:
            return self.plain(text)
        if any(_kind(character) == "?" for character in set(text)):
            return self.plain(text)
        ids: list[int] = []
        for match in self.split.finditer(text):
            ids += self.match_ids(match.group().encode())
        return ids

    # --- inside one match

    def _holds(self, left: int, right: int) -> bool:
        return self.piece(self.bytes[left] + self.bytes[right]) == [left, right]

    def match_ids(self, data: bytes) -> list[int]:
        """The ids of one match of the pattern, by halves."""
        if len(data) <= self.window:
            return self.piece(data)
        middle = len(data) // 2
        return self.join_match(self.match_ids(data[:middle]), self.match_ids(data[middle:]))

    def join_match(self, left: list[int], right: list[int]) -> list[int]:
        a = b = 0  # ids of the window on either side
        while True:
            between = self.piece(b"".join(self.bytes[t] for t in left[len(left) - a :] + right[:b])) if a + b else []
            outer = left[: len(left) - a], right[b:]
            whole = [*outer[0][-1:], *between, *outer[1][:1]]
            first = not outer[0] or len(whole) < 2 or self.holds(whole[0], whole[1])
            last = not outer[1] or len(whole) < 2 or self.holds(whole[-2], whole[-1])
            if first and last:
                return outer[0] + between + outer[1]
            a = a if first and a else min(len(left), max(4, 2 * a))
            b = b if last and b else min(len(right), max(4, 2 * b))

    # --- back

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= DECODED:
            return b"".join(map(self.bytes.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


_ENCODERS: dict[str | None, Encoder] = {}


def encoder(ranks: str | None = None) -> Encoder:
    """This worker's encoder, built once."""
    if ranks not in _ENCODERS:
        _ENCODERS[ranks] = Encoder(ranks)
    return _ENCODERS[ranks]


def _joined_segments(coder: Encoder, texts: list[str], ids: list[list[int]]) -> list[int]:
    """The ids of segments that follow one another, joined in pairs up to one."""
    while len(ids) > 1:
        up_texts, up_ids = [], []
        for at in range(0, len(ids) - 1, 2):
            text, middle = texts[at] + texts[at + 1], len(texts[at])
            before, after = coder.around(text, 0, middle, len(text))
            up_ids.append(coder.join(text, before, middle, after, ids[at], ids[at + 1]))
            up_texts.append(text)
        texts, ids = up_texts + texts[len(texts) - len(texts) % 2 :], up_ids + ids[len(ids) - len(ids) % 2 :]
    return ids[0] if ids else []


def encode(docs: DataFrame, ranks: str | None = None, segment: int = SEGMENT) -> DataFrame:
    """``doc_id, ids array<int>``."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(ranks)
        for batch in batches:
            _, offsets = buffers(batch.column("text"))
            kept = [name for name in batch.schema.names if name != "text"]
            for a, b in slices(offsets, TEXT_BYTES):
                made = pa.array([coder.encode(text) for text in batch.column("text")[a:b].to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(name)[a:b] for name in kept), made], [*kept, "ids"])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, row, value in zip(*(batch.column(k).to_pylist() for k in (0, 1)), batch.column(2)):
                text = value.as_py()
                for at, start in enumerate(range(0, len(text), segment)):
                    part = text[start : start + segment]
                    yield pa.RecordBatch.from_pylist([{"doc_id": doc_id, "row": row, "at": at, "said": part, "text": part}], pieces)

    def whole(key: tuple, parts: pa.Table) -> pa.Table:
        parts = parts.sort_by("at")
        ids = _joined_segments(encoder(ranks), parts.column("said").to_pylist(), parts.column("ids").to_pylist())
        return pa.table({"doc_id": parts.column("doc_id")[:1], "ids": pa.array([ids], pa.list_(pa.int32()))})

    pieces = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("at", pa.int32()), ("said", pa.string()), ("text", pa.string())])
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    short = rows.filter(F.length("text") <= segment).mapInArrow(of, "doc_id bigint, ids array<int>")
    long = rows.filter(F.length("text") > segment).select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    parts = long.mapInArrow(cut, "doc_id bigint, row bigint, at int, said string, text string").repartition("row", "at")
    found = parts.mapInArrow(of, "doc_id bigint, row bigint, at int, said string, ids array<int>")
    return short.unionByName(found.groupBy("row").applyInArrow(whole, "doc_id bigint, ids array<int>"))


def decode(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """All columns with ``decoded``, the bytes, in the place of ``ids``."""
    kept = [F.col("`" + name.replace("`", "``") + "`") for name in encoded.columns if name not in ("ids", "decoded")]
    # one struct, as names of any kind can be in a row but not among the columns that leave for Python
    rows = encoded.select(F.struct(*kept, F.lit(0).alias("__")).alias("row"), F.col("ids").cast("array<int>").alias("ids"))

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(ranks)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                made = [coder.decode(value or []) for value in batch.column(1)[at : at + 256].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + 256], pa.array(made, pa.binary())], ["row", "decoded"])

    found = rows.mapInArrow(of, StructType([rows.schema["row"], StructField("decoded", BinaryType())]))
    return found.select("row.*", "decoded").drop("__")
