"""Spelling variants against plain Python over all pairs."""

import random
import re
import zlib
from collections import Counter

from pageledger.llm import spelling
from pageledger.llm.registered import op12_spelling_variants


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    at = 0
    while at < min(len(a), len(b)) and a[at] == b[at]:
        at += 1
    return a[at + (len(a) >= len(b)) :] == b[at + (len(b) >= len(a)) :]


def brute_counts(rows):
    counts = Counter()
    for doc_id, text in rows:
        lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for run in re.findall("[a-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def brute(counts):
    found = {}
    for word, n in counts.items():
        others = [(-m, w) for w, m in counts.items() if near(word, w)]
        form = min(others)[1] if others and -min(others)[0] >= 10 * n else None
        found[word] = (n, len(others), form, counts[form] if form else None)
    rows = set()
    for word, (n, n_near, form, form_n) in found.items():
        root = word
        while found[root][2]:
            root = found[root][2]
        rows.add((word, form, root, n, n_near, form_n))
    return rows


def changed(rng, word):
    letters, at = "abcÀéÿ", rng.randrange(len(word))
    return rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice(letters) + word[at:], word[:at] + rng.choice(letters) + word[at + 1 :]])


def corpus():
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdÄé", k=rng.randint(6, 10))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "abababab", "babababa", "Überraschung"]
    rows = []
    for i in range(400):
        said = []
        for _ in range(rng.randint(0, 40)):
            word = words[int(rng.random() ** 4 * len(words))]
            while rng.random() < 0.3:
                word = changed(rng, word)
            said.append(word.upper() if rng.random() < 0.1 else word)
        rows.append((i, " ".join(said)))
    chain = "verwandt"  # forms of forms
    for step, times in enumerate((2500, 210, 20, 2)):
        rows += [(1000 + step, " ".join([chain] * times))]
        chain = chain[:step] + "z" + chain[step + 1 :]
    return rows + [(2000, None), (2001, ""), (None, "Verwandt verwandt"), (3, rows[3][1]), (2002, "1234567 ab-cdefghi×jklmnopq÷rstuvwx")]


def test_query(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame([(i, t, "w", 3) for i, t in rows], "doc_id bigint, text string, word string, n int").write.parquet(f"{tmp_path}/documents.parquet")
    found = op12_spelling_variants(spark, str(tmp_path)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    expected = brute(brute_counts(rows))
    assert len(found) == len(expected)
    assert {tuple(row) for row in found} == expected
    depth = [word for word, form, root, *_ in expected if form and form != root]
    assert depth


def test_near_words_share_a_signature():
    rng = random.Random(9)
    for _ in range(3000):
        word = "".join(rng.choices("abcé", k=rng.randint(7, 15)))
        other = changed(rng, word)
        if other == word or len(other) < 7:
            continue
        assert near(word, other)
        roles = {(s, r) for s, r in spelling.signatures(other)}
        assert any((s, {0: 0, 1: 2, 2: 1}[r]) in roles for s, r in spelling.signatures(word))


def test_no_rows(spark):
    assert spelling.variant_groups(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_plan_joins_by_equality(spark):
    words = spark.createDataFrame([("abcdefg", 2), ("abcdefh", 30)], "word string, n bigint")
    pairs = spelling.near_pairs(words)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = spelling.near_pairs(words)
        assert plan.count() == 1
        text = plan._jdf.queryExecution().explainString(plan._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert pairs.collect()[0][:] == ("abcdefg", 2, "abcdefh", 30)


def test_nothing_is_broadcast(spark, monkeypatch):
    """Tables of words are small as compressed files, also where the rows made of them would fill the driver."""
    plans = {}

    def planned(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return df

    kept = spelling.Scratch.keep
    monkeypatch.setattr(spelling.Scratch, "keep", lambda self, df, name: kept(self, planned(df, name), name))
    words = spark.createDataFrame([("abcdefg", 2), ("abcdefh", 30), ("abcdeh", 300), ("abcdehh", 5)], "word string, n bigint")
    rows = {row.word: row.root for row in planned(spelling.variants(words), "variants").collect()}
    assert rows == {"abcdefg": "abcdeh", "abcdefh": "abcdeh", "abcdeh": "abcdeh", "abcdehh": "abcdeh"}
    for name in ("pairs", "forms", "links-1", "variants"):
        assert "SortMergeJoin" in plans[name], name
    assert not [name for name, plan in plans.items() if "Broadcast" in plan]
