import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pageledger.llm import packing
from pageledger.llm.byte_bpe import Encoder


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


TEXTS = [
    "", "a", " ", "  ", "a b", " a", "a ", "a  b", "a   b", "a \n b", "a\n\n b", "tab\t x", "x  y", "don't we'll  I'm", "<|endoftext|> ok", "a<|endoftext|>b", "<|endoftext|><|endoftext|>", " <|endoftext|> \n<|endoftext|", "wo<|endoftext|>rd's  x",
    "é è 日本 語", "\r\n x", "12 345  6", "a\x1c b", "!!! ??? ...x", "  wide", "word " * 50, "x" * 200 + " " + "y" * 100,
]


def test_ids_are_those_of_the_tokenizers_library(tokenizer):
    rng = random.Random(4)
    encoder = Encoder()
    texts = TEXTS + ["".join(rng.choices([*"ab é.\n\t 1'sX", "<|endoftext|>"], k=rng.randint(1, 60))) for _ in range(400)]
    for text in texts * 2:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def check(rows, docs, tokenizer, sequence):
    """Pieces are the documents cut as agreed; sequences are gapless and no fuller than allowed."""
    ids = defaultdict(list)
    for doc_id, text in docs:
        ids[doc_id].append(tokenizer.encode(text or "", add_special_tokens=False).ids + [2])
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for doc_id, found in pieces.items():
        expected = []
        for tokens in ids[doc_id]:
            cuts = [0, *range(len(tokens) % sequence or sequence, len(tokens) + 1, sequence)]
            for at, (a, b) in enumerate(zip(cuts, cuts[1:])):
                expected.append((at, a, b - a, zlib.crc32(np.array(tokens[a:b], "<u4").tobytes())))
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == sorted(expected)
    for held in places.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= sequence
    return len(places), sum(r["length"] for r in rows)


def test_documents(spark, tokenizer):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choices(["alpha", "beta", "ga", "mma", "!"], k=rng.randint(0, 90)))) for i in range(300)]
    docs += [(400, None), (401, ""), (5, "again"), (5, "again"), (None, "null id"), (None, "null id"), (402, "long " * 1000)]
    docs += list(enumerate(TEXTS, 500))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("offset", F.lit("clash")).repartition(3)
    for block in (1 << 16, 40):
        rows = packing.pack(packing.pieces_of(frame, 64, with_ids=False), 64, block).collect()
        sequences, total = check(rows, docs, tokenizer, 64)
        assert sequences <= 1.06 * -(-total // 64) + 1


def test_ids_travel_with_their_pieces(spark):
    frame = spark.createDataFrame([(1, "some words here")], "doc_id bigint, text string")
    row = packing.pack(packing.pieces_of(frame)).first()
    assert zlib.crc32(row["ids"]) == row["ids_crc32"] and row["length"] * 4 == len(row["ids"])


def test_every_piece_keeps_its_own_ids(spark, tokenizer):
    """Full pieces, repeated rows and several rounds of blocks: the ids at each place are those of the document there."""
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choices(["alpha", "beta", "ga", "mma", "!"], k=rng.randint(0, 200)))) for i in range(200)] + [(5, "again"), (5, "again"), (None, None)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    for block in (1 << 16, 40):
        rows = packing.pack(packing.pieces_of(frame, 64), 64, block).collect()
        check(rows, docs, tokenizer, 64)
        assert all(len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)


def test_the_registered_uses_place_ids(spark, tmp_path, monkeypatch):
    """No use of packing turns the ids off; their checksum comes from the packed ids, and the pipeline ends with the ids."""
    import corpus_pipeline
    from pageledger.llm.registered import op9_best_fit_packing

    frame = spark.createDataFrame([(1, "some words here"), (2, "more words")], "doc_id bigint, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    place = packing.pack
    monkeypatch.setattr(packing, "pack", lambda pieces, *a: seen.append(pieces.columns) or place(pieces, *a))
    rows = op9_best_fit_packing(spark, str(tmp_path)).collect()
    ended = corpus_pipeline.packed(spark, frame, str(tmp_path)).collect()
    assert all("ids" in columns and "ids_crc32" not in columns for columns in seen) and len(seen) == 2
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in ended)
    assert {(r["doc_id"], r["ids_crc32"]) for r in rows} == {(r["doc_id"], r["ids_crc32"]) for r in ended}


def test_empty_table(spark):
    assert packing.pack(packing.pieces_of(spark.createDataFrame([], "doc_id bigint, text string"))).count() == 0


def test_each_placement_makes_the_sum_least():
    rng = np.random.default_rng(2)
    lengths = np.sort(rng.integers(1, 40, 300))[::-1].copy()
    bins, offsets, filled = packing.place(lengths, 40)
    level = {}
    for size, chosen, offset in zip(lengths.tolist(), bins.tolist(), offsets.tolist()):
        assert level.get(chosen, 0) == offset
        if offset:
            def total(target):
                gaps = defaultdict(int)
                for b, used in level.items():
                    gap = 40 - used - (size if b == target else 0)
                    gaps[gap] += gap > 0
                return sum(n * n for n in gaps.values())

            best = min(total(b) for b, used in level.items() if 40 - used >= size)
            assert total(chosen) == best
        else:
            assert all(40 - used < size for used in level.values())
        level[chosen] = offset + size
    assert dict(enumerate(filled.tolist())) == level
