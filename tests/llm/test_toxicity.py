import random

from pyspark.sql import functions as F

from pageledger.llm import toxicity


def corpus(n, seed=1):
    rng = random.Random(seed)
    plain = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(300)]
    rude = ["zorgish", "zorgle", "zorgum", "blarf"]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.randint(5, 80))
        toxic = int(i % 6 == 0)
        for _ in range(4 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(rude))
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    return rows, labels


def frames(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("score", F.lit("clash")).repartition(3)
    return docs, spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_held_out_accuracy(spark):
    rows, labels = corpus(1600)
    rows += [(5000, None), (5001, ""), (None, "plain"), (3, rows[3][1])]
    docs, marks = frames(spark, rows, labels)
    score = toxicity.fit(docs.filter(~toxicity.held_out()), marks)
    found = score(docs, "doc_id").select("row.doc_id", toxicity.held_out("row.doc_id").alias("held_out"), "score", "predicted").collect()
    assert len(found) == len(rows)
    truth = dict(labels)
    judged = [r for r in found if r["held_out"] and r["doc_id"] in truth]
    assert len(judged) > 300
    assert sum(r["predicted"] != truth[r["doc_id"]] for r in judged) <= 0.03 * len(judged)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found)
    empty = [r["score"] for r in found if r["doc_id"] in (5000, 5001)]
    assert empty[0] == empty[1] < 0.3
    kept = toxicity.reject_toxic(docs, marks)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    clean = {i for i, t in labels if not t}
    assert len(clean - ids) <= 0.02 * len(clean) and len(ids & {i for i, t in labels if t}) <= 0.03 * len(labels)


def test_without_labels_the_lexicon_decides(spark):
    docs, marks = frames(spark, [(1, "you idiot"), (2, "fine"), (3, None)], [(1, None), (2, 0)])
    found = toxicity.fit(docs, marks)(docs, "doc_id").select("row.doc_id", "score").collect()
    assert {r["doc_id"]: r["score"] for r in found} == {1: 0.5, 2: 0.0, 3: 0.0}
    none, marks = frames(spark, [], [])
    assert toxicity.fit(none, marks)(none, "doc_id").count() == 0


def test_columns_of_any_name_are_kept(spark):
    docs = spark.createDataFrame([(1, "quiet words", "x", 2.0), (2, None, None, None)], "doc_id bigint, text string, `a.b` string, score double")
    kept = toxicity.reject_toxic(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert kept.columns == docs.columns
    assert sorted(tuple(row) for row in kept.collect()) == [(1, "quiet words", "x", 2.0), (2, None, None, None)]


def test_features():
    make = lambda text: dict(zip(toxicity.NAMES, toxicity.features(text, frozenset(toxicity.INSULTS), {"zorg": 3.0})))
    assert set(make("").values()) == {0.0}
    found = make("YOU are an IDIOT, an 1d10t and a m.o.r.o.n!! zorgish zorgle")
    assert found["hits"] == 1 and found["hidden"] == 2 and found["runs"] == 1 and found["same"] == 2
    assert found["near"] == 1 / 3 and found["weight"] == 6.0
    assert make("l" + "o" * 100_000)["hits"] == 0
