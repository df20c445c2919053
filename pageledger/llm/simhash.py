"""SimHash near-deduplication by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``r`` bits share a value that differs from one in at most ``floor(r/2)`` bits and from the
other in at most ``ceil(r/2)``.  Every distinct fingerprint emits all values within half the radius; equal values meet, and the
pairs found are kept once and checked by bit count.  The values are shuffled by their lowest ``key_bits`` bits: a
fingerprint is sent once to each of the ``1 + k + k(k-1)/2 + ...`` keys that its values can have there, and the values themselves are
made beyond the shuffle, 2,081 for a radius of four, where each key holds a bounded share of them.

All fingerprints that meet at a value are within ``r`` of each other, so a value links its members to the least of them and loses no connection;
the number of links grows with the number of fingerprints and not with the square of a group.  (With an odd radius one member must be within
``floor(r/2)`` of the value; the others are linked to the least of those.)

Components come from repeated minimum labels over the links, large-star and small-star in turns, written to the shared
folder between rounds.

Defined cases: a null or empty text, or one without words, has fingerprint zero and is linked like any other; equal texts have
equal fingerprints; repeated ids are one document; null ids get a fingerprint and a component, but never become its name unless
all ids of it are null; an empty table gives no rows; other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageledger.llm.common import Scratch, raw_hash, text_bytes

WORDS, RADIUS, SEED = 4, 4, 42
#: Values that one key should hold on average; the number of key bits follows from it and the number of fingerprints.
KEY_VALUES = 1 << 19
#: Values that are sorted at once within a key, and shingles that are counted at once.
SORTED_VALUES, _CHUNK = 1 << 22, 1 << 16


def fingerprint(text: bytes, words: int = WORDS) -> int:
    tokens = text.lower().split()
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    joined = memoryview(b" ".join(tokens))
    ends = np.cumsum([len(token) + 1 for token in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[min(words, len(tokens)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + _CHUNK], stops[at : at + _CHUNK])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, raw, fp``: a hash of the text, and the unsigned fingerprint as the long with the same bits."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(value.as_py(), words) for value in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(values.view(np.int64))], ["doc_id", "raw", "fp"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("body"), raw_hash().alias("raw"))
    return rows.mapInArrow(of, "doc_id bigint, raw bigint, fp bigint")


def _masks(bits: int, most: int, shift: int = 0) -> list[np.ndarray]:
    """By number of set bits up to ``most``: all masks over ``bits`` bits."""
    return [np.array([sum(1 << (at + shift) for at in chosen) for chosen in combinations(range(bits), size)], np.uint64) for size in range(most + 1)]


def key_bits_for(n: int, radius: int = RADIUS) -> int:
    values = n * sum(comb(64, size) for size in range(radius - radius // 2 + 1))
    return min(32, max(6, (values // KEY_VALUES).bit_length()))


def links(values: DataFrame, radius: int = RADIUS, key_bits: int = 10) -> DataFrame:
    """``a, b``: links between the distinct fingerprints ``fp`` that connect all pairs within ``radius`` bits."""
    half, other = radius // 2, radius - radius // 2
    low = _masks(key_bits, other)
    flips = [int(mask) for group in low for mask in group]
    keyed = values.select("fp", F.explode(F.array(*[F.lit(flip) for flip in flips])).alias("flip"))
    keyed = keyed.select(F.col("fp").bitwiseXOR(F.col("flip")).bitwiseAND(F.lit((1 << key_bits) - 1)).alias("key"), "fp")
    high = _masks(64 - key_bits, other, key_bits)

    def collide(table: pa.Table) -> pa.Table:
        key = np.uint64(table.column("key")[0].as_py())
        fps = table.column("fp").to_numpy().view(np.uint64)
        apart = np.bitwise_count((fps & np.uint64((1 << key_bits) - 1)) ^ key).astype(np.int64)
        total = sum(int((apart == lows).sum()) * sum(len(group) for group in high[: other - lows + 1]) for lows in range(other + 1))
        passes = -(-total // SORTED_VALUES) or 1
        found = [_met(fps, apart, high, other, half, radius, key_bits, at, passes) for at in range(passes)]
        pair = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pa.array(pair[:, 0].view(np.int64)), "b": pa.array(pair[:, 1].view(np.int64))})

    return keyed.groupBy("key").applyInArrow(collide, "a bigint, b bigint").distinct()


def _met(fps, apart, high, other, half, radius, key_bits, turn, passes) -> np.ndarray:
    """The links from those values of one key whose hash belongs to this pass."""
    cells, owners, far = [], [], []
    for lows in range(other + 1):
        rows = np.flatnonzero(apart == lows)
        for highs in range(other - lows + 1):
            step = max(1, SORTED_VALUES // len(high[highs]))
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                base = fps[some] >> np.uint64(key_bits) << np.uint64(key_bits)
                cell = (base[:, None] ^ high[highs][None, :]).ravel()
                owner = np.repeat(some, len(high[highs]))
                if passes > 1:
                    mine = (cell * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(passes) == turn
                    cell, owner = cell[mine], owner[mine]
                cells.append(cell)
                owners.append(owner)
                far.append(np.full(len(cell), lows + highs, np.int8))
    cell, owner, distance = np.concatenate(cells), np.concatenate(owners), np.concatenate(far)
    order = np.argsort(cell)
    cell = cell[order]
    meets = np.zeros(len(cell), bool)
    meets[1:] = cell[1:] == cell[:-1]
    meets[:-1] |= meets[1:]
    order = order[meets]  # only values that several fingerprints share
    cell, value, distance = cell[meets], fps[owner[order]], distance[order]
    if not len(cell):
        return np.zeros((0, 2), np.uint64)
    centre = distance <= half
    first = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1])
    sizes = np.diff(np.concatenate([first, [len(cell)]]))
    least = np.repeat(np.minimum.reduceat(np.where(centre, value, np.uint64(0xFFFFFFFFFFFFFFFF)), first), sizes)
    held = np.repeat(np.maximum.reduceat(centre, first), sizes)
    held &= (least != value) & (np.bitwise_count(least ^ value) <= radius)
    return np.unique(np.stack([least[held], value[held]], axis=1), axis=0)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, root``: the least node that each node of the links ``a, b`` can reach; nodes without links have no row."""
    now, turn, before = scratch.keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "links-0"), 0, None
    while True:
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.filter("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = large.filter("v <> u").distinct()  # v > u holds, as m <= v < u did
        smallest = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(smallest, "v").select(F.explode(F.array("v", "u")).alias("v"), F.col("m").alias("u")).filter("v <> u").distinct()
        turn += 1
        now = scratch.keep(small, f"links-{turn}")
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if state == before:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root"))
        before = state


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """``doc_id, raw, fp, component_id`` of each row; a component is named by its smallest ``doc_id``."""
    scratch = Scratch(docs.sparkSession, "simhash")
    slim = scratch.keep(fingerprints(docs, words), "fingerprints")
    named = scratch.keep(slim.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = scratch.keep(links(named.select("fp"), radius, key_bits_for(named.count(), radius)), "found")
    roots = components(found, scratch)
    # Roots are least fingerprints; each takes the least document of its members.
    member = named.join(roots, named["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = member.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = member.join(names, "root").select("fp", "component_id")
    return slim.join(by_fp, "fp").select("doc_id", "raw", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """The documents that stay, with all their columns: of each component the smallest id."""
    scratch = Scratch(docs.sparkSession, "simhash-rows")
    gone = near_duplicates(docs, words, radius).filter(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = scratch.keep(gone.select(F.col("doc_id").alias("__simhash_id"), F.col("raw").alias("__simhash_raw")).distinct(), "gone")
    return docs.join(gone, F.col("doc_id").cast("bigint").eqNullSafe(F.col("__simhash_id")) & (raw_hash() == F.col("__simhash_raw")), "left_anti")
