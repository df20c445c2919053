"""Periodic runs of words, found by string synchronising sets.

A run is a stretch of consecutive words with smallest period ``q`` that no neighbouring word extends, at least ``max(24, 3 q)`` words
long.  Words of many whole texts are numbered and laid end to end, with a number of its own after each text, and all of them are
searched at once:

* Periods below ``2 * FIRST_SCALE`` are read off directly, by comparing the words that far apart.  These are the small periods that
  highly periodic regions would otherwise hide.
* At each dyadic scale ``t`` the hashes of all windows of ``t`` words are known from those of half the length.  A place is selected
  when the least hash among the windows at it and at the next ``t`` places is its own or the last one's; windows inside a region
  with a period of at most ``t / 3`` do not count, and the last window of each such region is selected as well.  Whether a place
  is selected depends on the words after it only, so a run's selected places recur one period later.
* Periods from ``2 t`` to ``4 t`` are proposed by neighbouring selected places whose next ``C`` words are alike, for four lengths
  ``C``, each at least the period and short enough that every run of three periods holds such a pair.

A proposal is compared word by word, stretched as far as it holds, and kept if it is a run with its smallest period.  Hashes of
64 bits only propose: a false proposal is found out by comparing, and one is missed only where two different windows of one
text share a hash.

The search is one narrow pass without a shuffle.  A task holds about ``BATCH_BYTES`` of text at once, or one longer text.

Defined cases: a null text is empty and has no words; an empty text has no runs and collapses to an empty text; words are
compared as bytes; repeated rows are searched alike; null ids are kept; an empty table gives no rows; columns other than ``doc_id``
and ``text`` are passed over.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageledger.llm.common import buffers, mixed, slices

LEAST_WORDS, LEAST_PERIODS = 24, 3
FIRST_SCALE = 4
#: Bytes of text that are searched at once.
BATCH_BYTES = 2 << 20

_LEFT, _RIGHT, _NEVER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFFFFFFFFFFFFFFFF)

#: Runs as parallel arrays: first word, word after the last, smallest period.
Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of pairs; not a polynomial, so texts made against those do not collide."""
    return mixed(mixed(left * _LEFT) + right * _RIGHT)


def _ahead(values: np.ndarray, by: int) -> np.ndarray:
    """The values ``by`` places later; nothing beyond the end."""
    found = np.zeros_like(values)
    found[: len(values) - by] = values[by:]
    return found


def _spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the intervals, and the interval each belongs to."""
    which = np.repeat(np.arange(len(starts)), sizes)
    within = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return starts[which] + within, which


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each stretch of true values."""
    edges = np.diff(np.concatenate([[0], same.view(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _smallest(a: np.ndarray, b: np.ndarray, q: np.ndarray) -> Runs:
    """Each stretch once, with its smallest period.  Of two periods that both fit three times the smaller divides the larger, so the stretch is
    maximal for both."""
    order = np.lexsort((q, b, a))
    a, b, q = a[order], b[order], q[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[first], b[first], q[first]


def _direct(words: np.ndarray, periods: Iterable[int]) -> Runs:
    """All stretches of three or more of the given periods, by comparing words that far apart."""
    found = []
    for q in periods:
        if q < len(words):
            a, b = _stretches(words[q:] == words[:-q])
            long = b - a >= (LEAST_PERIODS - 1) * q
            found.append((a[long], b[long] + q, np.full(int(long.sum()), q)))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return _smallest(*map(np.concatenate, zip(*found)))


def _selected(hashes: np.ndarray, t: int, regions: Runs) -> np.ndarray:
    """The synchronising places of scale ``t``, rising."""
    n = len(hashes)
    a, b, q = regions
    inside = (q <= t // 3) & (b - a >= t)
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, a[inside], 1)
    np.add.at(marks, b[inside] - t + 1, -1)
    counted = np.where(np.cumsum(marks[:n]) > 0, _NEVER, np.minimum(hashes, _NEVER - np.uint64(1)))
    least, width = counted.copy(), 1
    while width < t + 1:  # windows of t + 1 places, doubled up
        step = min(width, t + 1 - width)
        least[: n - step] = np.minimum(least[: n - step], least[step:])
        width += step
    last = np.full(n, _NEVER)
    last[: n - t] = counted[t:]
    chosen = (least != _NEVER) & ((least == counted) | (least == last))
    chosen[b[inside] - t] = True
    return np.flatnonzero(chosen)


def _proposed(places: np.ndarray, hashes: np.ndarray, half: np.ndarray, t: int, halves: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring places alike for ``halves * t / 2`` words, and how far apart they are."""
    size = halves * t // 2
    places = places[places + size <= len(hashes)]
    context = hashes[places]
    for at in range(1, halves // 2):
        context = _joined(context, hashes[places + at * t])
    if halves % 2:
        context = _joined(context, half[places + halves // 2 * t])
    order = np.argsort(context, kind="stable")
    context, places = context[order], places[order]
    apart = places[1:] - places[:-1]
    near = (context[1:] == context[:-1]) & (apart <= size) & (apart >= size - t // 2)
    return places[:-1][near], apart[near]


def _grown(words: np.ndarray, end: np.ndarray, period: np.ndarray, step: int) -> np.ndarray:
    """How many more words keep the period, from ``end`` on (``step`` 1) or from before it (``step`` -1)."""
    width, n = 64, len(words)
    more = np.zeros(len(end), np.int64)
    going = np.arange(len(end))
    while len(going):
        at = (end[going] + step * more[going])[:, None] + step * np.arange(width)[None, :] - (step < 0)
        other = at - step * period[going][:, None]
        inside = (at >= 0) & (at < n)
        same = inside & (words[np.clip(at, 0, n - 1)] == words[np.clip(other, 0, n - 1)])
        run = np.where(same.all(axis=1), width, (~same).argmax(axis=1))
        more[going] += run
        going = going[run == width]
        width = min(2 * width, max(64, (1 << 20) // max(1, len(going))))
    return more


def _verified(words: np.ndarray, start: np.ndarray, period: np.ndarray, size: int) -> Runs:
    """The maximal stretches around proposals that are alike for ``size`` words."""
    order = np.lexsort((start, period))
    start, period = start[order], period[order]
    fresh = np.ones(len(start), bool)  # stretches of one period that share as many words are one
    fresh[1:] = (period[1:] != period[:-1]) | (start[1:] > start[:-1] + size)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(start)) - 1
    a, b, q = start[first], start[last] + period[last] + size, period[first]
    at, which = _spread(a, b - a - q)
    wrong = np.unique(which[words[at] != words[at + q[which]]])
    extra = []
    for bad in wrong:  # two different windows with one hash: compare this stretch itself
        lo = int(a[bad])
        x, y, z = _direct(words[lo : int(b[bad])], [int(q[bad])])
        extra.append((x + lo, y + lo, z))
    right = np.ones(len(a), bool)
    right[wrong] = False
    a, b, q = (np.concatenate([kept[right], *(e[k] for e in extra)]) for k, kept in enumerate((a, b, q)))
    b = b + _grown(words, b, q, 1)
    a = a - _grown(words, a, q, -1)
    return a, b, q


def find_runs(words: np.ndarray, lengths: np.ndarray) -> Runs:
    """All runs of texts laid end to end: ``words`` holds each text's word numbers and then one that occurs nowhere else, ``lengths`` the words
    of each text, without that one.  Sorted by start, then period."""
    regions = _direct(words, range(1, 2 * FIRST_SCALE))
    # a region keeps its smallest period already; shorter ones serve to exclude windows only
    found = [regions]
    hashes = mixed((words.astype(np.uint64) + np.uint64(1)) * _LEFT)
    where, t, half = np.arange(len(words)), 1, hashes
    while True:
        half, hashes, t = hashes, _joined(hashes, _ahead(hashes, t)), 2 * t
        if t < FIRST_SCALE:
            continue
        long = lengths >= 2 * LEAST_PERIODS * t
        if not long.any():
            break
        if not long.all():  # shorter texts hold no such periods
            keep = np.repeat(long, lengths + 1)
            slots = np.cumsum(keep) - 1
            inside = keep[regions[0]]
            regions = (slots[regions[0][inside]], slots[regions[1][inside] - 1] + 1, regions[2][inside])
            words, hashes, half, where, lengths = words[keep], hashes[keep], half[keep], where[keep], lengths[long]
        places = _selected(hashes, t, regions)
        made = []
        for halves in (5, 6, 7, 8):
            start, apart = _proposed(places, hashes, half, t, halves)
            if len(start):
                made.append(_verified(words, start, apart, halves * t // 2))
        if made:
            a, b, q = map(np.concatenate, zip(*made))
            enough = b - a >= LEAST_PERIODS * q
            a, b, q = _smallest(a[enough], b[enough], q[enough])
            found.append((where[a], where[b - 1] + 1, q))
            regions = _smallest(*(np.concatenate(pair) for pair in zip(regions, (a, b, q))))
    a, b, q = _smallest(*map(np.concatenate, zip(*found)))
    enough = b - a >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
    a, b, q = a[enough], b[enough], q[enough]
    order = np.lexsort((q, a))
    return a[order], b[order], q[order]


def _numbered(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """All words, their numbers with one of its own after each text, and the words of each text."""
    known: dict[bytes, int] = {}
    words: list[bytes] = []
    numbers: list[int] = []
    lengths = np.zeros(len(texts), np.int64)
    for at, text in enumerate(texts):
        split = text.split()  # of bytes: at the blank and at 09 to 0D only
        words += split
        numbers += [known.setdefault(word, len(known)) for word in split]
        numbers.append(-1 - at)
        lengths[at] = len(split)
    return words, np.array(numbers, np.int64), lengths


def _searched(texts: list[bytes]) -> tuple[list[list[dict]], list[str]]:
    """Runs and collapsed text of each of the texts."""
    words, numbers, lengths = _numbered(texts)
    a, b, q = find_runs(numbers, lengths)
    opens = np.cumsum(lengths + 1) - lengths - 1  # with the closing numbers
    owner = np.searchsorted(opens, a, "right") - 1
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, a + q - owner, 1)
    np.add.at(marks, b - owner, -1)
    dropped = np.cumsum(marks) > 0
    runs: list[list[dict]] = [[] for _ in texts]
    for doc, start, length, period in zip(owner.tolist(), (a - opens[owner]).tolist(), (b - a).tolist(), q.tolist()):
        runs[doc].append({"start": start, "length": length, "period": period})
    collapsed, at = [], 0
    for doc, n in enumerate(lengths.tolist()):
        kept = words[at : at + n]
        if runs[doc]:
            kept = [word for word, out in zip(kept, dropped[at : at + n].tolist()) if not out]
        collapsed.append(b" ".join(kept).decode())
        at += n
    return runs, collapsed


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, runs array<struct<start, length, period>>, collapsed``: runs by start, then period; ``collapsed`` is the text's words without
    those that a run repeats after its first period."""
    shape = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = buffers(batch.column(1))
            for a, b in slices(offsets, BATCH_BYTES):
                runs, collapsed = _searched(batch.column(1)[a:b].to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(runs, shape), pa.array(collapsed, pa.string())], ["doc_id", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(of, "doc_id bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
