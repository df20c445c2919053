"""Spelling variants by PartEnum signatures.

Two words are near if one inserted, deleted or replaced character makes one into the other.  A word's letters are a binary vector: one
dimension for each letter and each further use of it.  Near words of equal length differ in two dimensions, near words whose lengths differ
by one in a single dimension.  The dimensions are partitioned, and a word has one signature for each way to leave out as many partitions as
dimensions may differ: two of ``REPLACED_PARTS`` for equal lengths, one of ``INSERTED_PARTS`` for others.  Near words share the signature that
leaves out the partitions in which they differ, so no pair is missed.

Vocabularies have many anagrams, which letters cannot tell apart.  A signature therefore also holds the place of the change: the
shorter word is divided into a few stretches, and the signature for a stretch holds all characters before and after it, counted from
the left and from the right end.  A changed character lies in some stretch, and outside of it near words are alike.

Signatures are hashed and joined with themselves by equality, each pair is verified by its edit distance, and pairs met under
several signatures are counted once.  The form of a word is its most frequent near word, if that is ``RATIO`` times as frequent; the
root is the last of the forms that follow one another, found by pointer doubling over the words that have a form.

Words are counted in the tasks that read the texts and combined before the shuffle, so a word that every text holds moves as a few sums.
From then on all tables are of distinct words.  The number of near words of a word is bounded by its length times the letters.
All joins sort and merge, as Spark sizes these tables by their compressed files and does not see that a word has twenty signatures: it
would send rows of far more than its broadcast threshold through the driver.

Defined cases: null and empty texts have no words; a null id is written as nothing where characters are taken out; repeated rows
count as often as they occur; ties between forms go to the smaller word; an empty table gives no rows; columns other than ``doc_id`` and
``text`` are passed over.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageledger.llm.common import Scratch, buffers, freed_shuffles, slices

LEAST_LENGTH, LEAST_USES, RATIO = 7, 2, 10
#: Partitions of the dimensions and stretches of the word: for words of equal length, and for those that differ by one.
REPLACED_PARTS, REPLACED_STRETCHES = 3, 4
INSERTED_PARTS, INSERTED_STRETCHES = 2, 2
#: Distinct words that a task counts before it hands them on, words signed at once, and texts cut into words as a whole.
COUNTED, SIGNED, TEXT_BYTES = 100_000, 4_000, 4 << 20
#: Words that one task signs; their rows are some twenty times as many.
TASK_WORDS = 1 << 15


def word_counts(docs: DataFrame, drop_every: int | None = None, least_length: int = LEAST_LENGTH) -> DataFrame:
    """``word, n``: runs of letters, A to Z in lower case, and how often each occurs.

    With ``drop_every``, a run loses one character where that number divides the checksum of the id, a colon and the run.
    """
    # a run that is too short stays too short, so only longer ones are looked at
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % least_length)

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
            counts.clear()
            return batch

        for batch in batches:
            _, offsets = buffers(batch.column(1))
            for a, b in slices(offsets, TEXT_BYTES):
                for doc_id, data in zip(batch.column(0)[a:b].to_pylist(), batch.column(1)[a:b]):
                    text = data.as_py().lower().decode()  # bytes: A to Z only
                    if len(text) <= TEXT_BYTES:
                        words: Iterable[str] = runs.findall(text)
                    else:
                        words = (match.group() for match in runs.finditer(text))
                    if drop_every:
                        start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                        words = _with_losses(words, start, drop_every, least_length)
                    counts.update(words)
                    if len(counts) > COUNTED:
                        yield counted()
        yield counted()

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    partial = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text).mapInArrow(of, "word string, n bigint")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def _with_losses(words: Iterable[str], start: int, every: int, least: int) -> Iterator[str]:
    crc32 = zlib.crc32
    for word in words:
        h = crc32(word.encode(), start)
        if h % every == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
            if len(word) < least:
                continue
        yield word


@lru_cache(1 << 12)
def _part(letter: str, use: int, parts: int) -> int:
    return zlib.crc32(f"{letter}{use}".encode()) % parts


def _projections(word: str, parts: int, left_out: int) -> list[str]:
    """The word's letters in all but ``left_out`` of the partitions, for each choice of these."""
    held: list[list[str]] = [[] for _ in range(parts)]
    used: Counter[str] = Counter()
    for letter in sorted(word):
        used[letter] += 1
        held[_part(letter, used[letter], parts)].append(letter)
    joined = ["".join(letters) for letters in held]
    found = []
    for out in combinations(range(parts), left_out):
        found.append("/".join("-" if at in out else joined[at] for at in range(parts)))
    return found


def _outside(word: str, length: int, stretches: int) -> list[str]:
    """What lies before and after each stretch of a word of ``length`` characters, or of one that holds one character more."""
    edges = [length * at // stretches for at in range(stretches + 1)]
    return [f"{at}|{word[:a]}|{word[len(word) - (length - b) :]}" for at, (a, b) in enumerate(zip(edges, edges[1:]))]


def signatures(word: str) -> Iterator[tuple[str, int]]:
    """Signatures with the word's part in them: 0 for words of equal length, 1 for the shorter and 2 for the longer word."""
    n = len(word)
    for kept in _projections(word, REPLACED_PARTS, 2):
        for around in _outside(word, n, REPLACED_STRETCHES):
            yield f"={n}|{around}|{kept}", 0
    for kept in _projections(word, INSERTED_PARTS, 1):
        for role, length in ((1, n), (2, n - 1)):
            for around in _outside(word, length, INSERTED_STRETCHES):
                yield f"+{length}|{around}|{kept}", role


def _signed(words: DataFrame) -> DataFrame:
    """``key, role, word, n``: a row for each signature, hashed."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            for at in range(0, batch.num_rows, SIGNED):
                part = batch.slice(at, SIGNED)
                keys, roles, rows = [], [], []
                for row, word in enumerate(part.column(0).to_pylist()):
                    for signature, role in signatures(word):
                        keys.append(digest(signature) - (1 << 63))
                        roles.append(role)
                        rows.append(row)
                taken = part.take(pa.array(rows, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(roles, pa.int8()), *taken.columns], ["key", "role", "word", "n"])

    return words.select("word", "n").mapInArrow(of, "key bigint, role tinyint, word string, n bigint")


def near_pairs(words: DataFrame) -> DataFrame:
    """``word, n, other, other_n``: each pair of near words once."""
    signed = _signed(words)
    a, b = signed.alias("a"), signed.alias("b").hint("merge")
    roles = ((F.col("a.role") == 0) & (F.col("b.role") == 0) & (F.col("a.word") < F.col("b.word"))) | ((F.col("a.role") == 1) & (F.col("b.role") == 2))
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & roles & (F.levenshtein("a.word", "b.word", 1) == 1))
    return met.select(F.col("a.word").alias("word"), F.col("a.n").alias("n"), F.col("b.word").alias("other"), F.col("b.n").alias("other_n")).distinct()


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """``word, root`` for words with a form, by pointer doubling.  Counts rise by ``RATIO`` with each step, so there are few rounds."""
    links, turn = scratch.keep(forms.select("word", F.col("form").alias("root")), "links-0"), 0
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        turn += 1
        moved = scratch.keep(links.join(onward.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"links-{turn}")
        if moved.filter("moved").isEmpty():
            return moved.select("word", "root")
        links = moved.select("word", "root")


def variants(counts: DataFrame, least_uses: int = LEAST_USES, ratio: int = RATIO) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for each word of ``counts (word, n)`` that is used often enough."""
    spark = counts.sparkSession
    scratch = Scratch(spark, "spelling")
    with freed_shuffles(spark):
        words = scratch.keep(counts.filter(F.col("n") >= least_uses), "words")
        spread = words.repartition(max(1, -(-words.count() // TASK_WORDS)), "word")
        pairs = scratch.keep(near_pairs(spread), "pairs")
        both = pairs.select("word", F.col("other").alias("near"), F.col("other_n").alias("near_n"))
        both = both.unionByName(pairs.select(F.col("other").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))
        best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
        found = words.join(best.hint("merge"), "word", "left")
        formed = -F.col("best.less") >= F.lit(ratio) * F.col("n")
        found = found.select(
            "word", "n",
            F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(formed, F.col("best.near")).alias("form"),
            F.when(formed, -F.col("best.less")).alias("form_n"),
        )
        found = scratch.keep(found, "forms")
        roots = _roots(found.filter(F.col("form").isNotNull()), scratch)
    return found.join(roots.hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def variant_groups(docs: DataFrame, drop_every: int | None = None) -> DataFrame:
    """The words of whole texts with their forms; words of one ``root`` are spelling variants of each other."""
    return variants(word_counts(docs, drop_every))
