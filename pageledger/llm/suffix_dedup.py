"""Removal of repeated passages by bucket-pointer refinement of suffixes.

A byte goes if a string of ``MATCH`` bytes that covers it also starts in a document with a smaller id.  Sorting all suffixes to that
depth would move every byte of the corpus many times over, so the suffixes are refined in two steps.

*Initial q-gram buckets.*  Every string of ``MATCH`` bytes holds the same first least ``Q``-gram (by hash) wherever it occurs, its anchor.
Each batch of texts sends its distinct anchor hashes to their buckets; a bucket that one document alone is in is done.  What is left
is a small part of the corpus.

*Refinement.*  The strings around the remaining anchors are gathered by bucket, as runs of consecutive starts that share an anchor.  All
suffixes of the runs get the identifier of their 8-byte bucket; these are refined to 16, 32 and ``MATCH`` bytes by sorting on
the pair of a suffix's identifier and that of the suffix 8, 16 and ``MATCH - 32`` bytes later, each round using the identifiers that the
round before has updated.  Equal identifiers at the end mean equal strings, byte by byte; hashes only choose buckets.  The least document
of each identifier decides, and the answer, a bit per start, goes back to the batch.

Within a batch equal anchors and equal runs are combined before they are sent, so a passage that a third of all documents hold costs an entry per
batch.  Buckets of very many different runs are dealt by the strings themselves.

Defined cases: a null text is empty; texts shorter than ``MATCH`` lose nothing; a null id counts as larger than all others; rows
with equal ids do not take from each other; repeated rows get equal results; an empty table gives no rows; columns other than
``doc_id`` and ``text`` are passed over.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageledger.llm.common import Scratch, buffers, freed_shuffles, mixed, packed, part_of, powers, slices, text_bytes, unpacked

MATCH, Q = 50, 18
#: Starts of strings that have the same least q-gram lie within this many bytes.
REACH = MATCH - Q + 1
#: Bytes of text in a batch, those hashed at once, and those of runs refined at once.
BATCH_BYTES, HASH_BYTES, REFINED_BYTES = 6 << 20, 1 << 18, 1 << 19
#: Compressed bytes of text per partition of buckets, and uses of a bucket from which its strings are dealt one by one.
PARTITION_BYTES, HOT_USES = 2 << 20, 20_000
_LAST = np.iinfo(np.int64).max
_ALL = np.uint64((1 << 64) - 1)


def _batches(docs: DataFrame) -> DataFrame:
    """Texts end to end, compressed, with their ids and sizes."""

    def of(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for part in parts:
            body, offsets = buffers(part.column(1))
            for a, b in slices(offsets, BATCH_BYTES):
                text = zstandard.ZstdCompressor(level=3).compress(body[offsets[a] : offsets[b]].tobytes())
                row = [number, part.column(0)[a:b].to_pylist(), packed(np.diff(offsets[a : b + 1])), text]
                number += 1
                types = (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], ["batch", "doc_ids", "sizes", "text"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("body"))
    return rows.mapInArrow(of, "batch bigint, doc_ids array<bigint>, sizes binary, text binary")


class Batch:
    """A batch's texts and its runs: stretches of starts whose strings share an anchor."""

    def __init__(self, doc_ids: list, sizes: bytes, text: bytes):
        self.doc_ids = doc_ids
        self.ids = np.array([_LAST if x is None else x for x in doc_ids], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(unpacked(sizes).astype(np.int64))])
        self.body = np.frombuffer(zstandard.ZstdDecompressor().decompress(text, max_output_size=max(1, int(self.offsets[-1]))), np.uint8)
        first, size, anchor = [], [], []
        for at in range(0, len(self.body), HASH_BYTES):
            for found, into in zip(self._runs(at), (first, size, anchor)):
                into.append(found)
        empty = np.zeros(0, np.int64)
        self.first, self.size = np.concatenate([empty, *first]), np.concatenate([empty, *size])
        self.anchor = np.concatenate([np.zeros(0, np.uint64), *anchor])
        self.doc = np.searchsorted(self.offsets, self.first, "right") - 1

    def _runs(self, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First start, number of starts and anchor hash of the runs among the ``HASH_BYTES`` starts from ``at``."""
        to = min(at + HASH_BYTES, len(self.body) - MATCH + 1)
        if to <= at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        text = self.body[at : to + MATCH - 1]
        up, down = powers(1 << (HASH_BYTES + MATCH).bit_length())
        sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[: len(text)], out=sums[1:])
        hashes = mixed((sums[Q:] - sums[:-Q]) * down[: len(text) - Q + 1])
        # The least hash of each window, the first of equals: the place is kept in the low bits.
        place = np.arange(len(hashes), dtype=np.uint64)
        least = hashes >> np.uint64(24) << np.uint64(24) | place
        for step in (1, 2, 4, 8, 16):
            least = np.minimum(least[:-step], least[step:])
        least = np.minimum(least[: to - at], (hashes >> np.uint64(24) << np.uint64(24) | place)[REACH - 1 :][: to - at])
        where = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        starts = np.arange(at, to)
        fine = starts + MATCH <= self.offsets[np.searchsorted(self.offsets, starts, "right")]
        starts, where = starts[fine], where[fine]
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        fresh = np.ones(len(starts), bool)
        fresh[1:] = (where[1:] != where[:-1]) | (starts[1:] != starts[:-1] + 1)
        first = np.flatnonzero(fresh)
        return starts[first], np.diff(np.append(first, len(starts))), hashes[where[first]]

    def anchors(self, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchors in order: hash, least document, whether several documents have it, uses; and each run's place among them."""
        heads, place = np.unique(self.anchor, return_inverse=True)
        order = np.lexsort((self.ids[self.doc], place))
        begins = np.searchsorted(place[order], np.arange(len(heads)))
        ends = np.append(begins[1:], len(order)) - 1
        ids = self.ids[self.doc[order]]
        return heads, ids[begins] if len(heads) else ids, (ids[begins] != ids[ends]) if len(heads) else np.zeros(0, bool), ends - begins + 1, place

    def strings(self, flags: np.ndarray, place: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct runs in buckets with several documents.

        Returns their strings, bucket keys and least documents, and the kept runs (index, place among the distinct).
        """
        chosen = np.flatnonzero(flags[place] > 0)
        data = self.body.tobytes()
        number: dict[bytes, int] = {}
        key, member, index = [], [], []
        hot = flags[place] > 1
        for at, first, size, anchor, split in zip(chosen.tolist(), self.first[chosen].tolist(), self.size[chosen].tolist(), self.anchor[chosen].tolist(), hot[chosen].tolist()):
            pieces = [data[first : first + size + MATCH - 1]] if not split else [data[x : x + MATCH] for x in range(first, first + size)]
            for piece in pieces:
                found = number.setdefault(piece, len(key))
                if found == len(key):
                    key.append(xxhash.xxh64_intdigest(piece) if split else anchor)
                member.append(found)
                index.append(at)
        member, index, key = np.array(member, np.int64), np.array(index, np.int64), np.array(key, np.uint64)
        least = np.full(len(key), _LAST)
        np.minimum.at(least, member, self.ids[self.doc[index]])
        return list(number), key, least, index, member


def _ask_anchors(batches: DataFrame, parts: int) -> DataFrame:
    def of(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows_ in rows:
            for row in rows_.to_pylist():
                batch = Batch(row["doc_ids"], row["sizes"], row["text"])
                heads, least, several, uses, _ = batch.anchors(parts)
                edges = np.searchsorted(part_of(heads, parts), np.arange(parts + 1))
                made = []
                for p in np.flatnonzero(np.diff(edges)):
                    some = slice(edges[p], edges[p + 1])
                    made.append({
                        "part": int(p), "batch": row["batch"], "heads": heads[some].tobytes(), "least": packed((least[some] - np.iinfo(np.int64).min).astype(np.uint64) if (least[some] < 0).any() else least[some]),
                        "low": bool((least[some] < 0).any()), "several": packed(several[some].astype(np.uint8)), "uses": packed(uses[some]),
                    })
                yield pa.RecordBatch.from_pylist(made, _ANCHORS)

    return batches.mapInArrow(of, "part int, batch bigint, heads binary, least binary, low boolean, several binary, uses binary")


_ANCHORS = pa.schema([("part", pa.int32()), ("batch", pa.int64()), ("heads", pa.binary()), ("least", pa.binary()), ("low", pa.bool_()), ("several", pa.binary()), ("uses", pa.binary())])


def _ids_of(data: bytes, low: bool) -> np.ndarray:
    values = unpacked(data)
    return (values.astype(np.uint64) + np.uint64(1 << 63)).view(np.int64) if low else values.astype(np.int64)


def _answer_anchors(hot: int):
    """Per asked anchor: 0 if one document has it, 1 if several do, 2 if there are very many of it."""

    def of(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        heads = [np.frombuffer(row["heads"], np.uint64) for row in rows]
        least = np.concatenate([_ids_of(row["least"], row["low"]) for row in rows])
        several = np.concatenate([unpacked(row["several"]) for row in rows])
        uses = np.concatenate([unpacked(row["uses"]).astype(np.int64) for row in rows])
        found, place = np.unique(np.concatenate(heads), return_inverse=True)
        low, high = np.full(len(found), _LAST), np.full(len(found), np.iinfo(np.int64).min)
        np.minimum.at(low, place, least)
        np.maximum.at(high, place, least)
        shared = low != high
        shared |= np.bincount(place, several, len(found)) > 0
        flag = np.where(shared, np.where(np.bincount(place, uses, len(found)) >= hot, 2, 1), 0)[place].astype(np.uint8)
        edges = np.cumsum([0, *map(len, heads)])
        made = [{"batch": row["batch"], "part": row["part"], "kind": 0, "data": packed(flag[a:b])} for row, a, b in zip(rows, edges, edges[1:])]
        return pa.Table.from_pylist(made, _ANSWERS)

    return of


_ANSWERS = pa.schema([("batch", pa.int64()), ("part", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
_ANSWER_SQL = "batch bigint, part int, kind int, data binary"


def _flags(answers: list[dict], n: int) -> np.ndarray:
    found = [unpacked(row["data"]) for row in sorted((row for row in answers if row["kind"] == 0), key=lambda row: row["part"])]
    return np.concatenate([np.zeros(0, np.uint8), *found])


def _ask_strings(parts: int):
    def of(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        batch = Batch(row["doc_ids"], row["sizes"], row["text"])
        heads, _, _, _, place = batch.anchors(parts)
        strings, key, least, _, _ = batch.strings(_flags(right.to_pylist(), len(heads)), place)
        target = part_of(key, parts)
        made = []
        order = np.lexsort((np.arange(len(key)), target))
        edges = np.searchsorted(target[order], np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(edges)):
            some = order[edges[p] : edges[p + 1]]
            chosen = [strings[at] for at in some.tolist()]
            low = bool((least[some] < 0).any())
            made.append({
                "part": int(p), "batch": row["batch"], "heads": key[some].tobytes(), "least": packed((least[some] - np.iinfo(np.int64).min).astype(np.uint64) if low else least[some]), "low": low,
                "sizes": packed(np.array([len(x) for x in chosen])), "text": zstandard.ZstdCompressor(level=1).compress(b"".join(chosen)),
            })
        return pa.Table.from_pylist(made, _STRINGS)

    return of


_STRINGS = pa.schema([("part", pa.int32()), ("batch", pa.int64()), ("heads", pa.binary()), ("least", pa.binary()), ("low", pa.bool_()), ("sizes", pa.binary()), ("text", pa.binary())])
_STRING_SQL = "part int, batch bigint, heads binary, least binary, low boolean, sizes binary, text binary"


def _pairs_refined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Identifiers of the buckets that two identifiers name together."""
    return np.unique(first.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64), return_inverse=True)[1]


def refine(text: np.ndarray) -> np.ndarray:
    """For each place with ``MATCH`` bytes after it, the identifier of its bucket at that depth; equal strings have equal ones."""
    grams = np.zeros(len(text) - 7, np.uint64)
    for at in range(8):
        grams |= text[at : len(text) - 7 + at].astype(np.uint64) << np.uint64(8 * at)
    at_8 = np.unique(grams, return_inverse=True)[1]
    at_16 = _pairs_refined(at_8[:-8], at_8[8:])
    at_32 = _pairs_refined(at_16[:-16], at_16[16:])
    return _pairs_refined(at_32[: -(MATCH - 32)], at_32[MATCH - 32 :])


def _answer_strings(table: pa.Table) -> pa.Table:
    """Per asked run: a bit for each start whose string a document with a smaller id has."""
    rows = table.to_pylist()
    number: dict[bytes, int] = {}
    place, key = [], []
    for row in rows:
        data = zstandard.ZstdDecompressor().decompress(row["text"])
        at = 0
        for head, size in zip(np.frombuffer(row["heads"], np.uint64).tolist(), unpacked(row["sizes"]).tolist()):
            found = number.setdefault(data[at : at + size], len(key))
            if found == len(key):
                key.append(head)
            place.append(found)
            at += size
    ids = np.concatenate([_ids_of(row["least"], row["low"]) for row in rows])
    place, key, strings = np.array(place, np.int64), np.array(key, np.uint64), list(number)
    least = np.full(len(key), _LAST)
    np.minimum.at(least, place, ids)
    masks = np.zeros(len(key), np.uint64)
    order = np.argsort(key, kind="stable")
    begins = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    groups = np.split(order, begins[1:])
    waiting: list[int] = []
    size = 0
    for group in groups:
        if len(group) > 1:
            waiting += group.tolist()
            size += sum(len(strings[at]) for at in group.tolist())
            if size >= REFINED_BYTES:
                _set_masks(waiting, strings, least, masks)
                waiting, size = [], 0
    if waiting:
        _set_masks(waiting, strings, least, masks)
    answer = np.where(ids > least[place], _ALL, masks[place])
    made, at = [], 0
    for row in rows:
        n = len(row["heads"]) // 8
        made.append({"batch": row["batch"], "part": row["part"], "kind": 1, "data": packed(answer[at : at + n])})
        at += n
    return pa.Table.from_pylist(made, _ANSWERS)


def _set_masks(chosen: list[int], strings: list[bytes], least: np.ndarray, masks: np.ndarray) -> None:
    """Fill in, for whole buckets, which starts of each run have their string in a smaller document's run too."""
    some = np.array(chosen, np.int64)
    sizes = np.array([len(strings[at]) for at in chosen], np.int64)
    starts = np.cumsum(sizes) - sizes
    bucket = refine(np.frombuffer(b"".join([strings[at] for at in chosen]), np.uint8))
    runs = sizes - MATCH + 1
    owner = np.repeat(np.arange(len(chosen)), runs)
    bit = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
    mine = bucket[starts[owner] + bit]
    smallest = np.full(int(bucket.max()) + 1, _LAST)
    np.minimum.at(smallest, mine, least[some[owner]])
    gone = smallest[mine] < least[some[owner]]
    np.bitwise_or.at(masks, some[owner[gone]], np.uint64(1) << bit[gone].astype(np.uint64))


def _cut(parts: int):
    """Apply the answers: per document its size, removed bytes, removed stretches, and what is left."""

    def of(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        batch = Batch(row["doc_ids"], row["sizes"], row["text"])
        answers = right.to_pylist()
        heads, _, _, _, place = batch.anchors(parts)
        _, key, least, index, member = batch.strings(_flags(answers, len(heads)), place)
        target = part_of(key, parts)
        order = np.lexsort((np.arange(len(key)), target))
        mask = np.zeros(len(key), np.uint64)
        found = [unpacked(x["data"]).astype(np.uint64) for x in sorted((x for x in answers if x["kind"] == 1), key=lambda x: x["part"])]
        mask[order] = np.concatenate([np.zeros(0, np.uint64), *found])
        # The answer is for the least document; a larger one in this batch loses the whole run.
        mask = np.where(batch.ids[batch.doc[index]] > least[member], _ALL, mask[member])
        # A run that was sent string by string has an entry for each start.
        nth = np.arange(len(index)) - np.searchsorted(index, index)
        split = np.bincount(index, minlength=len(batch.first))[index] > 1
        first, size = batch.first[index] + np.where(split, nth, 0), np.where(split, 1, batch.size[index])
        some = mask > 0
        first, size, mask = first[some], size[some], mask[some]
        change = np.zeros(len(batch.body) + 1, np.int32)
        for bit in range(int(size.max()) if len(size) else 0):
            starts = first[(size > bit) & ((mask >> np.uint64(bit)) & np.uint64(1) > 0)] + bit
            change[starts] += 1
            change[starts + MATCH] -= 1
        gone = np.cumsum(change[:-1], dtype=np.int32) > 0
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        inner = batch.offsets[:-1][batch.offsets[:-1] < len(gone)]
        opens[inner] = gone[inner]
        closes = gone.copy()
        closes[:-1] &= ~gone[1:]
        last = batch.offsets[1:][batch.offsets[1:] > 0] - 1
        closes[last] = gone[last]
        begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        edges = np.searchsorted(begin, batch.offsets)
        rows = defaultdict(list)
        for at, (a, b) in enumerate(zip(batch.offsets[:-1].tolist(), batch.offsets[1:].tolist())):
            spans = [{"start": int(x) - a, "end": int(y) - a} for x, y in zip(begin[edges[at] : edges[at + 1]], end[edges[at] : edges[at + 1]])]
            rows["doc_id"].append(batch.doc_ids[at])
            rows["n_bytes"].append(b - a)
            rows["n_removed"].append(sum(s["end"] - s["start"] for s in spans))
            rows["spans"].append(spans)
            text = batch.body[a:b]
            rows["kept_sha256"].append(hashlib.sha256(text[~gone[a:b]] if spans else text).hexdigest())
        return pa.table([pa.array(rows[name], kind) for name, kind in _RESULT], [name for name, _ in _RESULT])

    return of


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_RESULT = (("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", _SPANS), ("kept_sha256", pa.string()))


def repeated_passages(docs: DataFrame, hot: int = HOT_USES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans array<struct<start, end>>, kept_sha256`` of each row; spans are in bytes."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix-dedup")
    result = "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept_sha256 string"
    with freed_shuffles(spark):
        batches = scratch.keep(_batches(docs), "batches")
        size = batches.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PARTITION_BYTES + 1)
        flags = scratch.keep(_ask_anchors(batches, parts).groupBy("part").applyInArrow(_answer_anchors(hot), _ANSWER_SQL), "anchors")
        asked = batches.groupBy("batch").cogroup(flags.groupBy("batch")).applyInArrow(_ask_strings(parts), _STRING_SQL)
        masks = scratch.keep(asked.groupBy("part").applyInArrow(_answer_strings, _ANSWER_SQL), "strings")
        answers = flags.unionByName(masks)
        return scratch.keep(batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_cut(parts), result), "result")
