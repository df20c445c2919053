"""The registered queries against DuckDB, and the pipeline against plain Python."""

import math
import os
import random
import re
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from compare import connect, difference
from pageledger.llm.registered import ORACLE, QUERIES
from test_simhash import brute_fingerprint, roots

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    assert difference(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLE[name]) is None


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - {"op12_spelling_variants"}))  # that one has a row for each word
def test_a_row_per_document(spark, name):
    documents = connect(FOLDER).execute("SELECT count(*) FROM documents").fetchone()[0]
    found = QUERIES[name](spark, FOLDER)
    assert found.select("doc_id").distinct().count() == documents


def corpus(folder, spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(400)]
    rows, labels = [], []
    for i in range(260):
        text = rng.choices(words, k=rng.randint(150, 260))
        toxic = int(i % 5 == 0)
        for _ in range(5 * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(["zorgish", "zorgle", "idiot"]))
        if i % 7 == 3:
            text.insert(3, f"user{i}@mail.org")
        rows.append((i, " ".join(text)))
        labels.append((i, toxic))
    clean = [(i, t) for i, t in rows if i % 5]
    for at, (_, text) in enumerate(clean[:20]):
        rows.append((1000 + at, text.upper() if at % 2 else text))
    for at, (_, text) in enumerate(clean[20:40]):
        rows.append((2000 + at, text + " changed"))
    rows += [(3000, None), (3001, ""), (7, rows[7][1])]
    full = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in rows]
    spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_pipeline(spark, tmp_path):
    rows = corpus(str(tmp_path), spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.without_toxic(spark, docs, str(tmp_path))
    assert kept.columns == columns
    texts = dict(rows)
    safe = {r["doc_id"] for r in kept.collect()}
    toxic = {i for i in texts if i < 260 and i % 5 == 0}
    assert not safe & toxic and len(safe) >= len(texts) - len(toxic) - 3
    once = {}
    for i in safe:
        key = (texts[i] or "").encode().lower()
        once[key] = max(once.get(key, -1), i)
    left = set(once.values())
    found = corpus_pipeline.without_copies(spark, kept, str(tmp_path))
    assert found.columns == columns and sorted(r["doc_id"] for r in found.collect()) == sorted(left)
    fps = {i: brute_fingerprint(texts[i]) for i in left}
    named = roots(set(fps.values()), lambda a, b: (a ^ b).bit_count() <= 4)
    groups = defaultdict(list)
    for i in left:
        groups[named[fps[i]]].append(i)
    left = {min(group) for group in groups.values()}
    found = corpus_pipeline.without_near_copies(spark, found, str(tmp_path))
    assert found.columns == columns and sorted(r["doc_id"] for r in found.collect()) == sorted(left)
    found = corpus_pipeline.without_personal_data(spark, found, str(tmp_path))
    assert found.columns == columns
    final = {r["doc_id"]: r["text"] for r in found.collect()}
    assert set(final) == left and not any("@mail.org" in t for t in final.values()) and any("[EMAIL]" in t for t in final.values())
    assert all(t == (texts[i] or "") for i, t in final.items() if "@" not in (texts[i] or ""))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    total = defaultdict(int)
    for r in packed:
        total[r["doc_id"]] += r["length"]
    assert total == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in final.items()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "pii_sanitisation", "best_fit_packing"]


def test_the_privacy_stage_counts_the_whole_corpus(spark):
    """A name is hidden as the whole corpus makes it rare; by one context in 16 of these lines, most by one template, it would stay."""
    rng = random.Random(5)
    common = [a + b + "o" for a in "bcdfghjk" for b in "aeiou"]
    say = lambda n: " ".join(rng.choices(common, k=n))
    unique = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:05d}")
    texts = [f"at noon the clerk of {unique(i)} has put his mark under a long deed of sale" for i in range(400)]
    texts += [f"{say(9)} Zebulon {say(9)}" for _ in range(11)]
    texts += [f"{say(9)} Zebulon mails jo@x.org {say(9)}" for _ in range(4)]
    stretches = {tuple(words[i : i + 16]) for words in (re.findall("[a-z]+", t.lower()) for t in texts) for i in range(0, len(words), 16)}
    share = 1 - math.log(15 / 4) / math.log(len(stretches) / 4)
    assert 0.7 <= share < 0.9
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, n_chars bigint").repartition(3)
    found = {r["doc_id"]: r for r in corpus_pipeline.without_personal_data(spark, docs, "").collect()}
    assert len(found) == len(texts) and all(found[i]["text"] == texts[i] for i in range(411))
    for i in range(411, 415):
        assert re.search(r"\[TERM\] .*\[EMAIL\]", found[i]["text"]), found[i]["text"]
        assert "Zebulon" not in found[i]["text"] and found[i]["n_chars"] == len(found[i]["text"])
