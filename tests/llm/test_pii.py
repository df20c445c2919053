import math
import random
import re
import time

from pyspark.sql import functions as F

from pageledger.llm import pii


def luhn(digits):
    total = 0
    for at, c in enumerate(reversed(digits)):
        x = int(c) * (1 + at % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub(r"[^0-9]", "", m)) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub(r"[^0-9]", "", m)) <= 15),
)


def brute(text):
    found = [(m.start(), at, m.end(), kind) for at, (kind, pattern, fine) in enumerate(PATTERNS) for m in re.finditer(pattern, text or "") if fine(m[0])]
    return [(kind, start, end) for start, _, end, kind in sorted(found)]


TEXTS = [
    "", None, "mail jo.81@mail7.example.com now", "a@b.co_x@d.ef", "a@b.c.d.@e.f", "@a.b x@y", "é🙂 a+b%c@x-y.z 1.2.3.4.5.6.7.8", "300.1.1.1 001.02.3.4 1.2.3", "0000000000000000000001.2.3.4",
    "4111 1111 1111 1111 and 4111-1111-1111-1112", "4111111111111111", "+1 (386) 555-3733.", "+4 12", "+12345678901234567", "++1 555 555 5555 +", "1.1.1.256 9.9.9.9.", "5555 5555 5555 4444 1", "x@y.zz@w.v",
    "+1 (386) 555-3733 4111111111111111", "9" * 5000, "a" * 5000 + "@b.c", "1.2.3." * 400, "7-7 " * 3000, "a@b.c" * 50,
]


def spans(spark, rows, **options):
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("kind", F.lit("clash")).repartition(3)
    return pii.sanitise(frame, **options)


def test_base_spans_against_brute_force(spark):
    rng = random.Random(6)
    texts = TEXTS + ["".join(rng.choices(["1", "23", "255", ".", " ", "-", "+", "@", "a", "b.c", "(", ")", "é", "4111111111111111"], k=rng.randint(1, 60))) for _ in range(400)]
    rows = list(enumerate(texts)) + [(None, TEXTS[2]), (2, TEXTS[2])]
    found = spans(spark, rows, support=10**6).collect()
    assert len(found) == len(rows)
    for r in found:
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"]] == brute(r["text"]), r["text"]


def test_terms_that_give_an_entity_away(spark):
    """A rare word that stands by one address only is removed; common words and copies do not count."""
    rng = random.Random(7)
    common = [f"w{c}{d}" for c in "abcdefghij" for d in "abcdefghij"]
    say = lambda n: " ".join(rng.choices(common, k=n))
    rows = [(i, say(60)) for i in range(300)]
    rows += [(1000 + i, f"{say(20)} Zebulon mails jo@x.org {say(20)}") for i in range(5)]
    copy = f"{say(20)} quixote writes al@y.org {say(20)}"
    rows += [(2000 + i, copy) for i in range(9)]
    found = {r["doc_id"]: r for r in spans(spark, rows).collect()}
    assert all(not found[i]["spans"] and found[i]["sanitised"] == found[i]["text"] for i in range(300))
    for i in range(1000, 1005):
        kinds = [s["kind"] for s in found[i]["spans"]]
        assert kinds == ["term", "term", "email"]
        assert "Zebulon" not in found[i]["sanitised"] and "[EMAIL]" in found[i]["sanitised"] and "jo@x" not in found[i]["sanitised"]
    assert all([s["kind"] for s in found[i]["spans"]] == ["email"] for i in range(2000, 2009))
    assert found[2000]["sanitised"] == copy.replace("al@y.org", "[EMAIL]")


def test_copies_and_shared_passages_hide_no_term(spark):
    """What a name gives away is the same when a document that holds it is copied, or when a passage with it stands in many."""
    rng = random.Random(8)
    common = [a + b + c for a in "abcdefghij" for b in "klmno" for c in "pqrst"]
    say = lambda n: " ".join(rng.choices(common, k=n))
    rows = [(i, say(60)) for i in range(300)]
    rows += [(1000 + i, f"{say(20)} Zebulon mails jo@x.org {say(20)}") for i in range(5)]
    rows += [(2000 + i, f"{say(20)} Melchior mails al@y.org {say(20)}") for i in range(5)]
    passage = f"{say(12)} Melchior {say(12)}"
    rows += [(3000 + i, f"{say(6)} {passage} {say(6)}") for i in range(1000)]
    rows += [(5000 + i, rows[300][1]) for i in range(3000)]
    found = {r["doc_id"]: r for r in spans(spark, rows).collect()}
    for i in [*range(1000, 1005), *range(5000, 8000)]:
        assert "Zebulon" not in found[i]["sanitised"], found[i]["sanitised"]
    assert all("Melchior" not in found[i]["sanitised"] for i in range(2000, 2005))
    assert all("Melchior" in found[i]["sanitised"] for i in range(3000, 4000))


def test_contexts_against_brute_force(spark):
    texts = ["", None, "an ox", "one two three", "x one two three", " ".join("abc de fgh".split() * 20), "éa1bcd|Bcd"]
    expected = set()
    for text in texts:
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        expected |= {(w, *words[max(0, i - 8) : i], "|", *words[i : i + 9]) for i, w in enumerate(words) if len(w) >= 3}
    frame = spark.createDataFrame([(t,) for t in texts * 3], "text string").repartition(2)
    found = [r["term"] for r in pii.contexts(frame).distinct().collect()]
    assert sorted(found) == sorted(w for w, *_ in expected)
    assert pii.contexts(frame, 4).count() < pii.contexts(frame).count()


def test_shares_against_brute_force(spark):
    """``n_e``, ``n_et`` and ``n_t`` counted by plain Python; only ``N`` is taken from the sample of contexts."""
    rng = random.Random(12)
    common = [a + b + "o" for a in "bcdfghjk" for b in "aeiou"]
    say = lambda n: " ".join(rng.choices(common, k=n))
    rows = [(i, say(rng.randint(0, 50))) for i in range(200)]
    rows += [(500 + i, f"{say(9)} Zebulon mails jo@x.org {say(12)} +1 555 555 555{i % 3} Melchior {say(3)}") for i in range(12)]
    rows += [(600 + i, rows[200][1]) for i in range(5)] + [(700, None), (701, f"{say(3)} melchior {say(30)}")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    named = docs.select(F.coalesce("text", F.lit("")).alias("text")).select("text", pii.base_spans(F.col("text")).alias("spans")).filter(F.size("spans") > 0)
    total = pii.contexts(docs, 16).distinct().count()
    word = r"[^\W\d_]+"
    windows, uses = set(), set()
    for text in {t or "" for _, t in rows}:
        for kind, start, end in brute(text):
            value = text[start:end]
            entity = f"{kind}:{value.lower() if kind == 'email' else re.sub('[^0-9]', '', value)}"
            left, right = re.findall(word, text[max(0, start - 160) : start].lower()), re.findall(word, text[end : end + 160].lower())
            left, right = left[1:] if start > 160 else left, right[:-1] if len(text) > end + 160 else right
            windows.add((entity, *left[-8:], "|", *right[:8]))
        words = re.findall(word, text.lower())
        uses |= {(w, *words[max(0, i - 8) : i], "|", *words[i : i + 9]) for i, w in enumerate(words) if len(w) >= 3}
    expected = {}
    for entity in {w[0] for w in windows}:
        mine = [w for w in windows if w[0] == entity]
        for term in {t for w in mine for t in w[1:] if len(t) >= 3}:
            n_e, n_et, n_t = len(mine), sum(term in w[1:] for w in mine), sum(u[0] == term for u in uses)
            share = math.log(n_et * total / (n_e * max(n_t, n_et))) / max(math.log(total / n_e), 1e-9)
            if n_et >= 2 and share >= 0.7:
                expected[entity, term] = share
    found = {(r["entity"], r["term"]): r["share"] for r in pii.disclosing_terms(named, docs).collect()}
    assert found.keys() == expected.keys() and ("email:jo@x.org", "zebulon") in found
    assert all(abs(found[key] - expected[key]) < 1e-9 for key in found)


def shares(texts, generalise):
    """``entity, term`` to share, all counted by plain Python: ``N`` is the number of distinct stretches of 16 words."""
    word = r"[^\W\d_]+"
    stretches, windows, uses = set(), set(), set()
    for text in {t or "" for t in texts}:
        words = re.findall(word, text.lower())
        stretches |= {tuple(words[i : i + 16]) for i in range(0, len(words), 16)}
        uses |= {(w, *words[max(0, i - 8) : i], "|", *words[i : i + 9]) for i, w in enumerate(words) if len(w) >= 3}
        for kind, start, end in brute(text):
            value = text[start:end]
            left, right = re.findall(word, text[max(0, start - 160) : start].lower()), re.findall(word, text[end : end + 160].lower())
            left, right = left[1:] if start > 160 else left, right[:-1] if len(text) > end + 160 else right
            windows.add((f"{kind}:{value.lower() if kind == 'email' else re.sub('[^0-9]', '', value)}", *left[-8:], "|", *right[:8]))
    found, total = {}, max(2, len(stretches))
    for entity in {w[0] for w in windows}:
        mine = [w for w in windows if w[0] == entity]
        for term in {t for w in mine for t in w[1:] if len(t) >= 3}:
            n_e, n_et, n_t = len(mine), sum(term in w[1:] for w in mine), sum(u[0] == term for u in uses)
            share = math.log(n_et * total / (n_e * max(n_t, n_et))) / max(math.log(total / n_e), 1e-9)
            if n_et >= 2 and share >= generalise:
                found[entity, term] = share
    return total, found


def test_the_whole_corpus_is_counted(spark):
    """Lines by a template, of which all or no contexts have a given hash, and texts of any length beside them."""
    rng = random.Random(3)
    common = [a + b + "o" for a in "bcdfghjk" for b in "aeiou"]
    say = lambda n: " ".join(rng.choices(common, k=n))
    unique = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:05d}")
    texts = [f"at noon the clerk of {unique(i)} has put his mark under a long deed of sale" for i in range(400)]
    texts += [say(n) for n in range(70)] * 2 + [None, "", "x", f"{say(15)} a", f"{say(16)}", f"{say(17)}"]
    for n, name in enumerate(["zebulon", "melchior", "quixote", "ishmael", "barnaby"]):
        texts += [f"{say(9)} {name} mails {name}@x.org {say(12)}" for _ in range(4)] + [f"{say(9)} {name} {say(9)}" for _ in range(5 * n)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    named = docs.select(F.coalesce("text", F.lit("")).alias("text")).select("text", pii.base_spans(F.col("text")).alias("spans")).filter(F.size("spans") > 0)
    total, _ = shares(texts, 0)
    assert pii.contexts(docs, 16).distinct().count() == total
    for generalise in (0.3, 0.7):
        _, expected = shares(texts, generalise)
        found = {(r["entity"], r["term"]): r["share"] for r in pii.disclosing_terms(named, docs, generalise).collect()}
        assert found.keys() == expected.keys() and ("email:zebulon@x.org", "zebulon") in found
        assert all(abs(found[key] - expected[key]) < 1e-9 for key in found)


def test_many_spans_of_one_text(spark):
    """A list of 50,000 addresses and numbers with words between them; every third address is named twice and has a name of its own."""
    letters = "abcdefghij"
    name = lambda i: "".join(letters[int(c)] for c in f"{i:06d}")
    parts = []
    for i in range(25_000):
        parts.append(f"{name(i) if i % 3 else 'é🙂 ' + name(i // 3 * 3)} u{i if i % 3 else i // 3 % 900 * 3}@mail.org 1.2.3.{i % 300}")
    text = "\n".join(parts)
    start = time.time()
    row = spans(spark, [(1, text), (2, "a b")]).filter("doc_id = 1").first()
    assert time.time() - start < 60
    base = [(s["kind"], s["start"], s["end"]) for s in row["spans"] if s["kind"] != "term"]
    assert base == brute(text) and len(base) > 40_000
    out, at = [], 0
    for s in row["spans"]:
        out += [text[at : s["start"]], s["put"]]
        at = s["end"]
    assert row["sanitised"] == "".join(out) + text[at:]


def test_running_and_chunks(spark):
    rng = random.Random(2)
    lists = [[], [5], [1, 2], *[[rng.randint(0, 9) for _ in range(n)] for n in (3, 4, 5, 16, 17, 99, 100, 101)]]
    frame = spark.createDataFrame([(values,) for values in lists], "v array<bigint>")
    for r in frame.select("v", pii.running(F.col("v"), lambda a, b: a + b, F.lit(0).cast("bigint"), "bigint").alias("sums")).collect():
        assert r["sums"] == [sum(r["v"][:i]) for i in range(len(r["v"]))]
    text = "".join(rng.choices("ab\né🙂", k=5000))
    cuts = [(0, 0), (0, 1), (1023, 1025), (1024, 2048), (4999, 5000), (100, 4800), (0, 5000), (5000, 5000)]
    frame = spark.createDataFrame([(text, a, b) for a, b in cuts], "t string, a bigint, b bigint")
    assert [r[0] for r in frame.select(pii.taken(pii.chunks(F.col("t")), F.col("a"), F.col("b"))).collect()] == [text[a:b] for a, b in cuts]


def test_overlapping_spans_are_replaced_once(spark):
    row = spans(spark, [(1, "x 1.2.3.4@b.cc z 4111111111111111")]).first()
    assert [s["kind"] for s in row["spans"]] == ["email", "ip", "card"]
    assert row["sanitised"] == "x [EMAIL] z [CARD]"


def test_columns_stay_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "a@b.cc", "s")], "doc_id bigint, text string, spans string")
    assert pii.sanitise(frame).columns == ["doc_id", "text", "spans", "sanitised"]
    assert spans(spark, []).count() == 0


def test_the_plan_has_no_python(spark):
    plan = spans(spark, [(1, "a@b.cc")])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
