import hashlib

from pyspark.sql import functions as F

from pageledger.llm import chat

NASTY = ["\\### Assistant: </turn> ok", "\\", "\\b\\h", "####", "</turn>\n### user: x", "</part>", "", None, "é\n\n", "a: b", "</tu", "rn>", "##", "\\t</turn></part>"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit("clash"))


def read(spark, rows):
    formatted = chat.format_conversations(frame(spark, rows).repartition(3))
    found = formatted.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return {r["conv_id"]: r for r in found.collect()}


def test_round_trip(spark):
    rows = [(c, t, ["user", "assistant", "sys: #\\", None][(t * 7 + c) % 4], NASTY[(t + c) % len(NASTY)]) for c in range(8) for t in range(c * 3 + 1)]
    found = read(spark, rows)
    for c in range(8):
        turns = sorted(((t, r or "", x or "") for k, t, r, x in rows if k == c))
        assert [(r or "", x) for r, x in ((t["role"], t["text"]) for t in found[c]["turns"])] == [(r, x) for _, r, x in turns]
        assert found[c]["loss"] == "".join(x for _, r, x in turns if r == "assistant")


def test_adjacent_turns_of_a_role_share_a_block(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 2, "assistant", "c"), (None, None, "user", "x"), (None, 0, "user", "w")]
    found = read(spark, rows)
    assert found[1]["formatted"] == "### user: a</part>b</turn>\n### assistant: c</part>c</turn>\n"
    assert found[1]["n_blocks"] == 2 and found[1]["loss"] == "cc"
    assert [t["text"] for t in found[None]["turns"]] == ["x", "w"]


def test_long_conversation_and_empty_table(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(5000)]
    found = read(spark, rows)[1]
    assert len(found["turns"]) == 5000
    expected = "".join(f"turn {t}" for t in range(1, 5000, 2))
    assert hashlib.sha256(found["loss"].encode()).hexdigest() == hashlib.sha256(expected.encode()).hexdigest()
    assert read(spark, []) == {}


def test_spans_are_those_of_plain_python(spark):
    for n in (1, 2, 3, 10, 130):
        rows = [(1, t, ["user", "assistant", "assistant", "tool"][(t * t) % 4], NASTY[t % len(NASTY)]) for t in range(n)]
        text, spans, blocks, last = "", [], 0, None
        for _, _, role, body in rows:
            body = body or ""
            for plain, marked in chat.CONTROL:
                body = body.replace(plain, marked)
            if role == last:
                text = text.removesuffix(chat.TURN) + chat.PART
            else:
                text, blocks = text + f"{chat.HEAD}{role}{chat.MIDDLE}", blocks + 1
            if role == "assistant":
                spans.append((len(text), len(body)))
            text, last = text + body + chat.TURN, role
        found = read(spark, rows)[1]
        assert (found["formatted"], found["n_blocks"]) == (text, blocks)
        assert [tuple(s) for s in found["loss_spans"]] == spans


def test_plan_has_one_exchange_and_neither_windows_nor_python(spark):
    plan = chat.format_conversations(frame(spark, [(1, 0, "user", "a")]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Window" not in plan and "Python" not in plan and "Arrow" not in plan
