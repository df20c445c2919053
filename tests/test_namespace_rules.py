import random

from pyspark.sql import functions as F

from pageledger.operators import changeset
from pageledger.operators.changeset import Target
from pageledger.operators.namespace_rules import rule_index, with_tag_namespace

SCHEMA = "ord bigint, pattern string, ns string"


def found(spark, urls, rules, default="d", **options):
    pages = spark.createDataFrame([(url, "clash") for url in urls], "url string, gram string").repartition(3)
    rows = with_tag_namespace(pages, spark.createDataFrame(rules, SCHEMA), default, **options).collect()
    assert len(rows) == len(urls) and {row["gram"] for row in rows} <= {"clash"}
    return {row["url"]: row["tag_namespace"] for row in rows}


def plain(url, rules, default="d"):
    for _, pattern, ns in sorted((r for r in rules if r[1] is not None), key=lambda r: (r[0], r[1])):
        if url is not None and pattern in url:
            return default if ns is None else ns
    return default


def test_same_as_one_by_one(spark):
    draw = random.Random(5)
    letters = "ab/é😀"
    urls = ["".join(draw.choice(letters) for _ in range(draw.randrange(0, 30))) for _ in range(300)] + [None, "", "ab", "ab"]
    patterns = {"".join(draw.choice(letters) for _ in range(draw.randrange(1, 9))) for _ in range(120)}
    rules = [(at, pattern, f"n{at}" if at % 9 else None) for at, pattern in enumerate(draw.sample(sorted(patterns), len(patterns)))]
    for some in (rules, [r for r in rules if len(r[1]) > 4], [], [(7, None, "x")], [*rules, (-5, "", "all")]):
        assert found(spark, urls, some) == {url: plain(url, some) for url in urls}
    assert found(spark, urls, rules, salts=1, gram=2) == {url: plain(url, rules) for url in urls}


def test_same_as_the_literal_form(spark):
    rules = (("/a/", "/content/cq:tags/one"), ("/a/b", "/content/cq:tags/two"), ("x.", "/content/cq:tags/three"))
    urls = ["https://x/a/b", "https://x/c", "https://x.y/c"]
    table = [(at, *rule) for at, rule in enumerate(rules)]
    target = Target(tag_namespace="d", tag_namespace_map=rules)
    literal = spark.createDataFrame([(u,) for u in urls], "url string").select("url", changeset.tag_namespace(F.col("url"), target).alias("ns"))
    assert found(spark, urls, table) == {row["url"]: row["ns"] for row in literal.collect()}


def test_repeated_patterns_and_places(spark):
    rules = [(3, "aaaa", "late"), (1, "aaaa", "early"), (1, "aaab", "tie")]
    assert found(spark, ["xaaaab", "aaab", "zz"], rules) == {"xaaaab": "early", "aaab": "tie", "zz": "d"}


def test_patterns_are_kept_by_their_rarest_gram(spark):
    rules = [(at, f"https://{at:03d}", "n") for at in range(50)]
    grams = [row["gram"] for row in rule_index(spark.createDataFrame(rules, SCHEMA)).collect()]
    assert len(grams) == 50 and max(grams.count(gram) for gram in grams) == 1


def test_many_rules_meet_by_gram(spark):
    rules = spark.range(100_000).select(F.col("id").alias("ord"), F.concat(F.lit("/k"), F.col("id").cast("string"), F.lit("/")).alias("pattern"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("ns"))
    pages = spark.range(20_000).select(F.concat(F.lit("https://h.example/k"), (F.col("id") * 7).cast("string"), F.lit("/p")).alias("url"))
    ruled = with_tag_namespace(pages, rules, "d")
    plan = ruled._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    expected = F.when(F.col("key") < 100_000, F.concat(F.lit("n"), F.col("key").cast("string"))).otherwise("d")
    wrong = ruled.withColumn("key", F.regexp_extract("url", r"/k(\d+)/", 1).cast("bigint")).filter(~F.col("tag_namespace").eqNullSafe(expected))
    assert ruled.count() == 20_000 and wrong.count() == 0


def test_change_sets_take_the_namespace_of_the_rules(spark):
    records = spark.createDataFrame([("s", "https://s/a", "red, blue", "t", "d")], "site string, url string, suggested_keywords string, suggested_title string, suggested_description string")
    rules = spark.createDataFrame([(0, "/a", "/content/cq:tags/ruled")], SCHEMA)
    target = Target(author_url="https://author", property_map={"keywords": "cq:tags"}, tag_namespace="/content/cq:tags/n")
    rows = changeset.property_rows(with_tag_namespace(records, rules), target).collect()
    assert ["ruled:red", "ruled:blue"] in [row["values"] for row in rows]
    assert {row["namespace"] for row in changeset.wanted_tags(with_tag_namespace(records, rules), target).collect()} == {"/content/cq:tags/ruled"}
