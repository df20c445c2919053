"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is marked (spaces become ``▁``, one is put in front) and cut into words where a mark follows another character; no piece of
the vocabulary reaches over such a place, so the best segmentation of the text is that of its words.  In each batch the distinct
words are sorted, which lays them out as a trie in depth-first order: consecutive words share their common prefix, and the forward
scores of a prefix are computed once and kept for all words below it.  A character no piece covers costs ``UNKNOWN`` below the
worst score and is written as its UTF-8 bytes.  A worker
remembers a bounded number of words over its batches.

The scores are those stored in the vocabulary file.  For a vocabulary made by merging they rank the merges, and the segmentation
with the greatest sum is returned, which need not be the order of merges; decoding gives back the text in either case, but for a
literal ``▁`` in it, which comes back as a space.

Defined cases: null and empty texts have no ids; repeated rows are encoded alike; null ids are kept; words longer than
``LONG_WORD`` characters are encoded by the same recursion but not kept in the trie; an empty table gives no rows; columns other
than ``doc_id`` and ``text`` are passed over.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, filterfalse

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageledger.llm.common import buffers, slices

MODEL = "piece_bpe_32k.model"
MARK, UNKNOWN = "▁", 10.0
#: Longer words are not remembered; words that a worker remembers; bytes of text that are cut into words at once.
LONG_WORD, MEMO_WORDS, TEXT_BYTES = 64, 150_000, 3 << 20


class Vocabulary:
    def __init__(self, path: str | None = None):
        model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(MODEL))
        self.pieces: dict[str, tuple[float, int]] = {}
        self.bytes = [0] * 256
        self.plain: list[bytes] = []
        for at in range(model.get_piece_size()):
            piece = model.id_to_piece(at)
            if model.is_byte(at):
                self.bytes[int(piece[3:5], 16)] = at
                self.plain.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(at) or model.is_unknown(at) or model.is_unused(at):
                self.plain.append(b"")
            else:
                self.pieces[piece] = (model.get_score(at), at)
                self.plain.append(piece.replace(MARK, " ").encode())
        scores = [score for score, _ in self.pieces.values()]
        self.worst = min(scores) - UNKNOWN
        self.longest = max(map(len, self.pieces))
        self.single = {piece: score for piece, (score, _) in self.pieces.items() if len(piece) == 1}
        #: By the last three characters, the lengths of the longer pieces that end so: what else need not be looked up.
        tails: dict[str, set[int]] = {}
        for piece in self.pieces:
            if len(piece) > 2:
                tails.setdefault(piece[-3:], set()).add(len(piece))
        self.tails = {tail: tuple(sorted(sizes)) for tail, sizes in tails.items()}
        self.coded = {piece: np.array([at], "<u4").tobytes() for piece, (_, at) in self.pieces.items()}
        self.memo: dict[str, bytes] = {}

    def _of_bytes(self, character: str) -> bytes:
        return np.array([self.bytes[b] for b in character.encode()], "<u4").tobytes()

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """The ids of distinct words, which are taken in sorted order."""
        pieces, worst, tails, single, coded = self.pieces, self.worst, self.tails, self.single, self.coded
        best, path = [0.0], [b""]  # by prefix length: forward score, and the ids of the best way there
        before = ""
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del best[shared + 1 :], path[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                top, start = best[end - 1] + single.get(word[end - 1], worst), end - 1
                if end > 1:
                    piece = pieces.get(word[end - 2 : end])
                    if piece is not None and best[end - 2] + piece[0] > top:
                        top, start = best[end - 2] + piece[0], end - 2
                    for size in tails.get(word[end - 3 : end], ()) if end > 2 else ():
                        if size > end:
                            break
                        piece = pieces.get(word[end - size : end])
                        if piece is not None and best[end - size] + piece[0] > top:
                            top, start = best[end - size] + piece[0], end - size
                best.append(top)
                last = coded.get(word[start:end])
                path.append(path[start] + (self._of_bytes(word[start]) if last is None else last))
            yield word, path[-1]
            before = word

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of texts; words met before are remembered up to a bound."""
        cut, memo = [words_of(text) for text in texts], self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        fresh = set(filterfalse(memo.__contains__, chain.from_iterable(cut)))
        longer = dict(self.encode_words(word for word in fresh if len(word) > LONG_WORD))
        memo.update(self.encode_words(word for word in fresh if len(word) <= LONG_WORD))
        find = (lambda word: longer[word] if len(word) > LONG_WORD else memo[word]) if longer else memo.__getitem__
        return [b"".join(map(find, words)) for words in cut]

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.plain.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def words_of(text: str) -> list[str]:
    """The marked words of a text; joined they are the marked text."""
    if not text:
        return []
    parts = text.split(" ")
    if "" not in parts:
        words = [MARK + part for part in parts]
    else:  # marks that follow one another belong to the word after them
        words, marks = [], ""
        for part in parts:
            marks += MARK
            if part:
                words.append(marks + part)
                marks = ""
        if marks:
            words.append(marks)
    if MARK in text:
        return _recut("".join(words))
    return words


def _recut(marked: str) -> list[str]:
    cuts = [0, *(at for at in range(1, len(marked)) if marked[at] == MARK and marked[at - 1] != MARK), len(marked)]
    return [marked[a:b] for a, b in zip(cuts, cuts[1:])]


_VOCABULARIES: dict[str | None, Vocabulary] = {}


def vocabulary(path: str | None = None) -> Vocabulary:
    """This worker's vocabulary, read once."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids``: the ids as little-endian unsigned 32-bit numbers."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in batches:
            _, offsets = buffers(batch.column(1))
            for a, b in slices(offsets, TEXT_BYTES):
                made = known.encode(batch.column(1)[a:b].to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(made, pa.binary())], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(of, "doc_id bigint, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """All columns with ``text`` in the place of ``ids``."""
    names = [name for name in encoded.columns if name not in ("ids", "text")]

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in batches:
            texts = [known.decode(np.frombuffer(value.as_py() or b"", "<u4").tolist()) for value in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in names), pa.array(texts, pa.string())], [*names, "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name in names)
    return encoded.select(*names, "ids").mapInArrow(of, (schema + ", " if schema else "") + "text string")
