import json

import pytest
from pyspark.sql import functions as F

from pageledger.operators import changeset
from pageledger.operators.changeset import Target
from pageledger.sources.tables import load_target, target_from_config

AUTHOR = "https://author"
RECORDS = "site string, seq bigint, url string, suggested_title string, suggested_description string, suggested_keywords string"


def test_paths(values):
    urls = ["/content/mysite/a.html", "/mysite/a.htm", "/mysitefoo", "/other", "/", "/a.html.html"]
    full = [f"https://x.org{path}?q#f" for path in urls] + ["no url"]
    assert values(lambda u: changeset.target_path(u, "/content/mysite"), full) == [
        "/content/mysite/a", "/content/mysite/a", "/content/mysitefoo", "/content/mysite/other", "/content/mysite/", "/content/mysite/a.html", None,
    ]
    assert values(lambda u: changeset.target_path(u, "/content/mysite/"), full[1:4]) == ["/content/mysite//a", "/content/mysite/foo", "/content/mysite/other"]
    assert values(lambda u: changeset.target_path(u, None), full[:2]) == ["/content/mysite/a", "/mysite/a"]
    assert values(changeset.content_path, ["/a", "/a/jcr:content"]) == ["/a/jcr:content", "/a/jcr:content"]


def test_tags(values):
    assert values(changeset.split_tags, [" a, ,B c,", ""]) == [["a", "B c"], []]
    assert values(changeset.tag_node, ["B  c!", "Été", "--x--", "?"]) == ["b-c", "t", "x", ""]
    target = Target(tag_namespace="/content/cq:tags/d", tag_namespace_map=(("/a/", "/content/cq:tags/one"), ("/a/b", "/content/cq:tags/two")))
    assert values(lambda u: changeset.tag_namespace(u, target), ["https://x/a/b", "https://x/c"]) == ["/content/cq:tags/one", "/content/cq:tags/d"]
    assert values(changeset.namespace_id, ["/content/cq:tags/one", "/plain"]) == ["one", None]


def test_wanted_fields():
    assert changeset.wanted_fields(Target()) == ["title", "description", "keywords"]
    assert changeset.wanted_fields(Target(property_map={"title": "t"}, update_fields=("title", "keywords"))) == ["title"]


def rows(spark, *records):
    return spark.createDataFrame([("s", at, *record) for at, record in enumerate(records)], RECORDS)


def test_property_rows(spark):
    frame = rows(spark, ("https://x/a.html", "T", "", "k1, K 2,"), ("https://x/b", None, None, None), ("bad", "T", None, None))
    target = Target(author_url=AUTHOR, replicate_after_update=True)
    found = [(r.url, r.path, r.property, r["values"], r.action) for r in changeset.change_set(frame, target).collect()]
    assert sorted(found, key=str) == sorted(
        [
            ("https://x/a.html", "/a/jcr:content", "jcr:title", ["T"], "set"),
            ("https://x/a.html", "/a/jcr:content", "cq:keywords@TypeHint", ["String[]"], "set"),
            ("https://x/a.html", "/a/jcr:content", "cq:keywords", ["k1, K 2"], "set"),
            ("https://x/a.html", "/a", ":operation", ["replicate"], "replicate"),
            ("bad", None, None, [], "error"),
        ],
        key=str,
    )


def test_tag_property_and_missing_tags(spark):
    target = Target(author_url=AUTHOR, property_map={"keywords": "cq:tags", "title": "t"}, tag_namespace="/content/cq:tags/n/")
    frame = rows(spark, ("https://x/a", "T", None, "Red Car, blue"), ("https://x/b", None, None, "red-car, Green"))
    tags = {r.url: r["values"] for r in changeset.change_set(frame, target).filter("property = 'cq:tags'").collect()}
    assert tags == {"https://x/a": ["n/:red-car", "n/:blue"], "https://x/b": ["n/:red-car", "n/:green"]}
    existing = spark.createDataFrame([("/content/cq:tags/n", "blue")], "namespace string, node string")
    created = changeset.tags_to_create(changeset.wanted_tags(frame, target), existing)
    assert sorted((r.namespace, r.node, r.label) for r in created.collect()) == [
        ("/content/cq:tags/n", "green", "Green"), ("/content/cq:tags/n", "red-car", "Red Car"),
    ]


def test_errors_and_shared_properties(spark):
    frame = rows(spark, ("https://x/a", "T", "D", None))
    assert changeset.change_set(frame, Target()).head().error == "authorUrl is required for AEM push"
    shared = Target(author_url=AUTHOR, property_map={"title": "p", "description": "p"})
    assert [r["values"] for r in changeset.change_set(frame, shared).collect()] == [["D"]]
    no_id = Target(author_url=AUTHOR, property_map={"keywords": "cq:tags"})
    assert changeset.change_set(rows(spark, ("https://x/a", None, None, "k")), no_id).head().action == "error"


def test_dispatch(spark):
    frame = rows(spark, ("https://x/a", "T", None, None))
    assert changeset.change_set(frame, Target(type="wordpress", author_url=AUTHOR)).count() == 0
    with pytest.raises(ValueError, match="Unsupported"):
        changeset.change_set(frame, Target(type="other"))


def test_config(spark, tmp_path):
    config = {"first": {"type": "drupal"}, "aem": {"type": "aem", "authorUrl": AUTHOR, "password": "x", "tagNamespaceMap": {"b": "2", "a": "1"}}}
    (tmp_path / "c.json").write_text(json.dumps(config, indent=1))
    target = load_target(spark, str(tmp_path / "c.json"))
    assert (target.type, target.author_url, target.tag_namespace_map) == ("aem", AUTHOR, (("b", "2"), ("a", "1")))
    assert target_from_config({"first": {"type": "drupal"}}).type == "drupal"


def test_has_changes(spark):
    frame = rows(spark, ("https://x/a", None, "D", None))
    asked = Target(update_fields=("title",))
    assert frame.filter(F.lit(True) & changeset.has_changes(asked)).count() == 0
    assert frame.filter(changeset.has_changes(Target())).count() == 1
