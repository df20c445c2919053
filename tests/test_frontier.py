import random
from collections import deque

import pytest

from pageledger.operators import frontier
from pageledger.operators.numbering import number_rows
from pageledger.plans.audit import AuditOptions, base_urls, site_audit


def queue_crawl(seeds, links, depth, limit, known=()):
    """First-in first-out reference for one site: visits as (url, depth), in order."""
    visited, visits, queue = set(known), [], deque((url, 0) for url in seeds)
    while queue and len(known) + len(visits) < limit:
        url, level = queue.popleft()
        if url in visited:
            continue
        visited.add(url)
        visits.append((url, level))
        if level < depth:
            queue.extend((link, level + 1) for link in links.get(url, ()))
    return visits


def run(spark, seeds, links, depth=3, limit=100, known=None, follow=True):
    start = spark.createDataFrame([("s", url, at) for at, url in enumerate(seeds)], "site string, url string, ord bigint")
    edges = spark.createDataFrame(
        [("s", source, target, at) for source, targets in links.items() for at, target in enumerate(targets)] or [("s", "", "", 0)],
        "site string, src string, dst string, pos int",
    )
    state = None if known is None else spark.createDataFrame([("s", url) for url in known], "site string, url string")
    rows = frontier.crawl(start, edges, depth, limit, follow, state).orderBy("seq").collect()
    first = 1 + len(known or ())
    assert [row.seq for row in rows] == list(range(first, first + len(rows)))
    return [(row.url, row.depth) for row in rows]


GRAPH = {"a": ["b", "c", "b", "a"], "b": ["d", "a"], "c": ["d", "e"], "d": ["f", "c"], "f": ["g"], "g": ["h"]}


@pytest.mark.parametrize(
    ("depth", "limit", "known"),
    [(3, 100, None), (1, 100, None), (0, 100, None), (3, 3, None), (3, 1, None), (3, 100, ["b"]), (3, 4, ["c", "z"]), (3, 2, ["x", "y", "z"])],
)
def test_matches_a_queue(spark, depth, limit, known):
    assert run(spark, ["a"], GRAPH, depth, limit, known) == queue_crawl(["a"], GRAPH, depth, limit, known or ())


def test_links_can_be_left_alone(spark):
    assert run(spark, ["a", "c", "a"], GRAPH, follow=False) == [("a", 0), ("c", 0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    chance = random.Random(seed)
    nodes = [f"n{n}" for n in range(60)]
    links = {node: chance.choices(nodes, k=chance.randrange(5)) for node in nodes}
    seeds = chance.sample(nodes, 4)
    for limit in (1000, 25):
        assert run(spark, seeds, links, 4, limit) == queue_crawl(seeds, links, 4, limit)


def test_links_of_a_page_are_not_gathered(spark, monkeypatch):
    """Edges of a hot page stay rows of their own; what is written of them has as many rows as there are edges."""
    written = {}

    def cut(df, name):
        assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString(), name
        out = kept(df, name)
        written.setdefault(name, out)
        return out

    kept = frontier.cut
    monkeypatch.setattr(frontier, "cut", cut)
    links = {"hot": [f"n{n}" for n in range(500)] + ["n3"], "n3": ["hot", "z"]}
    assert run(spark, ["hot"], links, 2, 1000) == queue_crawl(["hot"], links, 2, 1000)
    assert written["crawl-links"].count() == 503


def test_seeds_follow_the_listing_then_the_base(spark):
    listing = spark.createDataFrame(
        [("s", 1, "b"), ("s", 0, "c"), ("s", 2, "c"), ("t", 0, "base-t")],
        "site string, pos bigint, url string",
    ).selectExpr("*", "'' AS lastmod", "'' AS priority", "'' AS changefreq")
    bases = spark.createDataFrame([("s", "base-s"), ("t", "base-t")], "site string, url string")
    rows = frontier.seeds(listing, bases).orderBy("site", "ord").collect()
    assert [(row.site, row.url) for row in rows] == [("s", "c"), ("s", "b"), ("s", "base-s"), ("t", "base-t")]
    only = frontier.seeds(listing, bases, sitemap_only=True).orderBy("site", "ord").collect()
    assert [row.url for row in only] == ["c", "b", "base-t"]


def test_numbering_is_dense_whatever_the_partitions(spark):
    rows = spark.range(0, 5000).selectExpr("IF(id % 3 = 0, 'hot', concat('s', id % 7)) AS site", "(id * 7919) % 5000 AS place")
    numbered = number_rows(rows.repartition(9), ["site"], ["place"], "n", "test").collect()
    by_site = {}
    for row in sorted(numbered, key=lambda row: row.place):
        by_site.setdefault(row.site, []).append(row.n)
    assert len(numbered) == 5000
    assert all(numbers == list(range(1, len(numbers) + 1)) for numbers in by_site.values())


def page(*links):
    return "<title>A title that is long enough</title><h1>x</h1>" + "".join(f'<a href="{link}">x</a>' for link in links)


def audit_inputs(spark):
    pages = spark.createDataFrame(
        [
            ("x.org", "https://x.org", 200, page("/a", "/b/", "/gone")),
            ("x.org", "https://x.org/a", 200, page("/c", "https://y.org/")),
            ("x.org", "https://x.org/b", 500, page("/c")),
            ("x.org", "https://x.org/c", 200, page()),
            ("x.org", "https://x.org/listed/", 200, page("/a")),
            ("y.org", "https://y.org", 200, page()),
        ],
        "site string, url string, status int, html string",
    )
    listing = spark.createDataFrame(
        [("x.org", "d", 0, "https://x.org/listed/", "2024", "", "daily"), ("x.org", "d", 1, "https://x.org/b", "2023", "", "")],
        "site string, doc_url string, pos bigint, url string, lastmod string, priority string, changefreq string",
    )
    return pages, base_urls(spark.createDataFrame([("https://x.org",), ("y.org",)], "url string")), listing


def test_whole_audit(spark):
    pages, bases, listing = audit_inputs(spark)
    rows = site_audit(pages, bases, listing).orderBy("site", "seq").collect()
    visits = [(row.url, row.depth, row.error, row.in_sitemap, row.lastmod) for row in rows if row.site == "x.org"]
    assert visits == [
        ("https://x.org/listed/", 0, None, True, "2024"),
        ("https://x.org/b", 0, "HTTP error! Status: 500", False, None),
        ("https://x.org", 0, None, False, None),
        ("https://x.org/a", 1, None, False, None),
        ("https://x.org/gone", 1, "No snapshot for this URL", False, None),
        ("https://x.org/c", 2, None, False, None),
    ]
    assert [row.url for row in rows if row.site == "y.org"] == ["https://y.org"]


def test_audit_modes(spark):
    pages, bases, listing = audit_inputs(spark)
    single = site_audit(pages, bases, listing, AuditOptions(single_page=True)).collect()
    assert sorted((row.url, row.in_sitemap) for row in single) == [("https://x.org", False), ("https://y.org", False)]
    first = site_audit(pages, bases, listing, AuditOptions(depth=0, limit=2))
    again = site_audit(pages, bases, listing, AuditOptions(limit=4), state=first).filter("site = 'x.org'").orderBy("seq").collect()
    assert [(row.seq, row.url) for row in again] == [
        (1, "https://x.org/listed/"), (2, "https://x.org/b"), (3, "https://x.org"), (4, "https://x.org/a"),
    ]
    forced = site_audit(pages, bases, listing, AuditOptions(limit=1, force=True), state=first).filter("site = 'x.org'").collect()
    assert [row.seq for row in forced] == [1]


def test_reach_gives_the_depths_of_a_crawl(spark):
    edges = [("s", "a", "b"), ("s", "b", "a"), ("s", "a", "c"), ("s", "c", "d"), ("s", "b", "c"), ("s", "d", "e"), ("s", "a", "a"), ("t", "a", "x"), ("t", None, "y")]
    links = spark.createDataFrame([(*edge, at) for at, edge in enumerate(edges)], "site string, src string, dst string, pos int")
    start = spark.createDataFrame([("s", "a"), ("s", "a"), ("t", "a")], "site string, url string")
    for depth in (0, 1, 2, 3):
        visits = frontier.crawl(frontier.seeds(None, start.distinct()), links, depth=depth, limit=None)
        expected = {(row.site, row.url, row.depth) for row in visits.collect()}
        found = [tuple(row) for row in frontier.reach(start, links, depth).collect()]
        assert set(found) == expected and len(found) == len(expected)
    assert frontier.reach(start.limit(0), links, 2).collect() == []
