import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from pageledger.llm import pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary()


TEXTS = [
    "Hello world", " lead", "trail ", "two  spaces", "   ", "tabs\tand\nlines", "日本語 ünïcode 🙂", "▁ mark ▁▁x", "a", "x" * 300, "the theory then them", "…", "",
    "internationalisation of internationalised internationals",
]


def brute(vocabulary, text):
    """The best sum over all segmentations of the whole marked text."""
    marked = ("▁" + text.replace(" ", "▁")) if text else ""
    best = [0.0] + [float("-inf")] * len(marked)
    for end in range(1, len(marked) + 1):
        for size in range(1, min(end, vocabulary.longest) + 1):
            found = vocabulary.pieces.get(marked[end - size : end])
            cost = found[0] if found else vocabulary.worst if size == 1 else None
            if cost is not None:
                best[end] = max(best[end], best[end - size] + cost)
    return best[-1]


def total(vocabulary, ids):
    """The sum of an encoding; characters written as bytes cost the unknown score."""
    score, data = 0.0, b""
    by_id = {at: (score, piece) for piece, (score, at) in vocabulary.pieces.items()}
    for at in ids:
        if at in by_id:
            score += by_id[at][0]
        else:
            data += vocabulary.plain[at]
    return score + vocabulary.worst * len(data.decode())


def test_segmentations_are_best(vocabulary):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choices("theraison gé ", k=rng.randint(1, 50))) for _ in range(150)]
    for text, ids in zip(texts, vocabulary.encode(texts)):
        ids = np.frombuffer(ids, "<u4").tolist()
        assert total(vocabulary, ids) == pytest.approx(brute(vocabulary, text), rel=1e-12), text
        assert vocabulary.decode(ids) == text.replace("▁", " ")


def test_library_finds_no_better_sum(vocabulary):
    """Not even its own lattice, told to take the same scores."""
    data = open(public_tokenizers.path(pieces.MODEL), "rb").read()
    at = data.rfind(b"\x18\x02 \x80\xfa\x01")
    library = sentencepiece.SentencePieceProcessor(model_proto=data[: at + 1] + b"\x01" + data[at + 2 :])
    for word in "hello internationalisation thereafter reading tokens Spark quickly".split():
        ids = np.frombuffer(vocabulary.encode([word])[0], "<u4").tolist()
        assert total(vocabulary, ids) >= sum(map(library.get_score, library.encode(word)))


def test_documents(spark):
    rows = [(i, text) for i, text in enumerate(TEXTS)] + [(None, "null id"), (3, None), (4, "again"), (4, "again"), (5, "very long " * 5000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit("clash")).repartition(3)
    encoded = pieces.encode(frame)
    decoded = pieces.decode(encoded.withColumn("extra", F.lit(1)))
    assert decoded.columns == ["doc_id", "extra", "text"]
    found = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in decoded.collect())
    assert found == sorted((i is None, i or 0, (t or "").replace("▁", " ")) for i, t in rows)
    assert pieces.decode(pieces.encode(spark.createDataFrame([], "doc_id bigint, text string"))).count() == 0
