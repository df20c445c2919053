import itertools

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pageledger.functions import urls

BASE = "https://X.org:443/a/b?q=1#f"
RESOLVED = {
    "/x": "https://x.org/x", "x": "https://x.org/a/x", "../x": "https://x.org/x", "./": "https://x.org/a", "?z": "https://x.org/a/b?z",
    "#f": "https://x.org/a/b?q=1", "//h/p/": "https://h/p", "/": "https://x.org", "/für": "https://x.org/f%C3%BCr", "a b": "https://x.org/a/a%20b",
    "?a=/": "https://x.org/a/b?a=", "mailto:a@b": "mailto:a@b", "javascript:0": "javascript:0", "https://x.org:8080/p/": "https://x.org:8080/p",
    "http://": None, "": "https://x.org/a/b?q=1", "HTTPS:foo": "https://x.org/a/foo", "http:foo": "http://foo", "\\\\h\\x": "https://h/x",
    "a\tb": "https://x.org/a/ab", "/a/%2e%2E/c/..": "https://x.org", "http://u:p@H/": "http://u:p@h", "http://u:@H/": "http://u@h",
    "http://a b/": None, "http://x:99999/": None, "http://x:y/": None, "x?": "https://x.org/a/x?", "http://[::1]:80/": "http://[::1]",
    "http://ex%41mple.org/ü": "http://example.org/%C3%BC", "a/./b/../": "https://x.org/a/a", "http://h:080/": "http://h",
    "/a|b": "https://x.org/a|b", "/a//b": "https://x.org/a//b", "  /t\n": "https://x.org/t", "/x?a'b": "https://x.org/x?a%27b",
}


def test_resolution(values):
    resolved = values(lambda href: urls.normalize_url(href, F.lit(BASE)), list(RESOLVED))
    assert dict(zip(RESOLVED, resolved)) == RESOLVED


def test_invalid_base(values):
    assert values(lambda href: urls.normalize_url(href, F.lit("no url")), ["/x", "http://h/"]) == [None, "http://h"]


def test_hosts(values):
    given_urls = ["https://WWW.X.org:8080/p", "http://u:p@h.org/", "not a url", "https://x.org", "//x.org/", None, "https://x.org?q"]
    assert values(urls.hostname, given_urls) == ["www.x.org", "h.org", None, "x.org", None, None, "x.org"]
    assert values(lambda u: urls.is_same_domain(u, F.lit("x.org")), given_urls) == [False, False, False, True, False, False, True]
    assert values(urls.site_key, ["https://A_b.org/", "nope"]) == ["a_b.org", "site-cache"]


def test_site_addresses(values):
    assert values(urls.with_scheme, ["x.org", "HTTP://x.org", "http://x.org"]) == ["https://x.org", "https://HTTP://x.org", "http://x.org"]
    assert values(urls.default_sitemap, ["https://x.org:8080/a"]) == ["https://x.org/sitemap.xml"]
    assert values(urls.robots_url, ["https://x.org:8080/a?b"]) == ["https://x.org:8080/robots.txt"]


def test_short_way_for_plain_links_gives_the_same(spark):
    bases = [
        "https://x.org/a/b?q=1#f", "https://x.org", "https://x.org/a/", "https://x.org/é/b", "https://x.org/a/../b", "https://X.org/a/b",
        "http://x.org/a/b?c/d", "https://x.org:8443/p/q", "https://x.org?x=/y/z",
        "https://x.org/a/b/c/", "https://x.org/a?é", "https://x.org/a?'", "https://x.org/a//b/c", "https://x.org/a/?q#é", "https://x.org#top",
    ]
    links = [*RESOLVED, "x/y/", "é/ü", "x:y", "a.b", ".a", "x//y", "x/../y", "x/.y", "x;y", "a?b:c", "a/b:c", "%2e/x", "https://x.org/é",
             "../é/", "../../x", "../.x", "../x:y", "../?q", "./x?y", "./x/../y", "./x:y", "#é", "##", "#a?b", "../x/./y", "..", "../x//y"]
    frame = spark.createDataFrame(list(itertools.product(links, bases)), "link string, base string")
    general = urls.normalize_url(F.col("link"), F.col("base"))
    rows = frame.select("link", "base", general.alias("url"), urls.hostname(general).alias("host"),
                        urls.page_links(F.array("link"), F.col("base"), F.lit("x.org")).alias("links")).collect()
    for row in rows:
        expected = [row.url] if row.host == "x.org" and "mailto:" not in row.url else []
        assert row.links == expected, row


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab/.?#%2eEü :\\", max_size=12), min_size=20, max_size=60))
def test_normalising_twice_changes_nothing_more(values, links):
    """One trailing slash goes each time, so the fixed point is reached once no slash is left."""
    once = values(lambda href: urls.normalize_url(href, F.lit("https://x.org/a/b")), links)
    settled = [url for url in once if url and not url.endswith("/") and "/?" not in url]
    again = values(lambda href: urls.normalize_url(href, F.lit("https://other.org/")), settled)
    assert again == settled
