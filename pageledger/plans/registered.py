"""The registered queries: every operator over the warehouse tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageledger import fixed_values as fixed
from pageledger.functions import html, scores, text, urls
from pageledger.operators import changeset, frontier, keywords, report, sitemap, state, state_log, suggest, summary_log
from pageledger.operators.namespace_rules import with_tag_namespace
from pageledger.operators.pages import extract_content, fetch, link_edges, one_snapshot, page_links
from pageledger.operators.summary import audit_percentages, audit_summary
from pageledger.plans import inputs
from pageledger.plans.audit import AuditOptions, base_urls, site_audit, sitemap_listing
from pageledger.session import checkpoint_dir, cut, filter_in_place
from pageledger.sinks.tables import write_changes, write_json, write_state
from pageledger.sources.keyword_files import read_keyword_files
from pageledger.sources.sitemap_files import read_urlset_files
from pageledger.sources.tables import (
    read_pages,
    read_responses,
    read_robots,
    read_sitemap_docs,
    read_state,
    read_tags,
    read_text_docs,
    target_from_config,
)
from pageledger.streaming.audit_stream import audit_stream

Query = Callable[[SparkSession, str], DataFrame]

# --- fields of a page -------------------------------------------------------------------------


def _tokens(pages: DataFrame) -> DataFrame:
    return pages.withColumn("_tokens", html.raw_tokens(F.col("html"), html.RECORD_TAGS))


def title_scores(spark: SparkSession, folder: str) -> DataFrame:
    titled = inputs.table(spark, folder, "pages").select("page_id", html.title(F.col("html")).alias("title"))
    length = text.js_length(F.col("title"))
    return titled.select("page_id", "title", length.alias("title_length"), scores.title_score(length).alias("title_score"))


def h1_scores(spark: SparkSession, folder: str) -> DataFrame:
    tokens = _tokens(inputs.table(spark, folder, "pages"))
    counted = tokens.select(
        "page_id", html.h1_text(F.col("html")).alias("h1_text"), html.h1_count(F.col("_tokens")).alias("h1_count")
    )
    return counted.withColumn("h1_score", scores.h1_score(F.col("h1_count")))


def visible_text(spark: SparkSession, folder: str) -> DataFrame:
    body = inputs.table(spark, folder, "pages").select("page_id", html.visible_text(F.col("html")).alias("visible_text"))
    return body.withColumn("text_length", text.js_length(F.col("visible_text")))


def tag_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """How often each tag and attribute occurs."""
    tags = inputs.table(spark, folder, "pages").select(F.inline(html.tag_tokens(F.col("html"))))
    attributes = F.array_join(F.array_sort(F.map_keys("attrs")), ",")
    return tags.groupBy(F.col("name").alias("tag"), attributes.alias("attributes")).agg(F.count(F.lit(1)).alias("n"))


_CONTENT = ("p_partkey", "site", "url")


def meta_tags(spark: SparkSession, folder: str) -> DataFrame:
    content = extract_content(inputs.part_pages(spark, folder).drop("status"))
    return content.select("p_partkey", "title", "description", "keywords", "canonical_url", "robots", "h1_text", "h1_count")


def og_twitter_tags(spark: SparkSession, folder: str) -> DataFrame:
    content = extract_content(inputs.part_pages(spark, folder).drop("status"))
    return content.select(
        "p_partkey", "og_title", "og_description", "og_image",
        "twitter_card", "twitter_title", "twitter_description", "twitter_image",
    )


def desc_keyword_scores(spark: SparkSession, folder: str) -> DataFrame:
    content = extract_content(inputs.part_pages(spark, folder).drop("status"))
    return content.select(
        "p_partkey", "description_length", "description_score", "keywords_count", "keywords_score",
        scores.needs_suggestion().alias("needs_suggestion"),
    )


def error_records(spark: SparkSession, folder: str) -> DataFrame:
    content = extract_content(inputs.part_pages(spark, folder))
    return content.select(
        "p_partkey", "title", "title_length", "title_score", "h1_count", "h1_score", "keywords_score",
        F.size("links").alias("n_links"), "error",
    )


def escaped_titles(spark: SparkSession, folder: str) -> DataFrame:
    """HTML escaping of whole documents."""
    return inputs.table(spark, folder, "documents").select("doc_id", text.escape_html(F.col("text")).alias("escaped"))


def collapsed_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Whitespace handling and UTF-16 lengths of whole documents."""
    collapsed = inputs.table(spark, folder, "documents").select(
        "doc_id", text.js_trim(text.js_collapse(F.col("text"))).alias("collapsed")
    )
    return collapsed.withColumn("units", text.js_length(F.col("collapsed")))


# --- addresses ----------------------------------------------------------------------------------


def link_edges_query(spark: SparkSession, folder: str) -> DataFrame:
    return link_edges(extract_content(inputs.site_pages(spark, folder)))


def url_parts(spark: SparkSession, folder: str) -> DataFrame:
    pages = inputs.table(spark, folder, "pages")
    bare = F.regexp_replace("url", "^https?://", "")
    return pages.select(
        "page_id",
        urls.hostname(F.col("url")).alias("hostname"),
        urls.pathname(F.col("url")).alias("pathname"),
        urls.with_scheme(bare).alias("with_scheme"),
        urls.default_sitemap(F.col("url")).alias("default_sitemap"),
        urls.robots_url(F.col("url")).alias("robots_url"),
        urls.is_same_domain(F.col("url"), F.regexp_replace(bare, "^www[.]|/.*$", "")).alias("same_domain"),
    )


def site_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Site keys of proper addresses and of titles, which are none."""
    pages = inputs.table(spark, folder, "pages").select("page_id", "url", html.title(F.col("html")).alias("title"))
    return pages.select(
        "page_id", urls.site_key(F.col("url")).alias("url_key"), urls.site_key(F.col("title")).alias("title_key")
    )


_HREFS = {
    "root": "/x", "sibling": "x", "parent": "../x", "query": "?z=1", "fragment": "#f", "host": "//H.example.com/p/",
    "absolute": "HTTPS://Www.Example.org:443/A/../b", "encoded": "/für x", "mail": "mailto:a@b", "bad": "http://", "here": "./",
}


def url_resolution(spark: SparkSession, folder: str) -> DataFrame:
    forms = F.array(*[F.struct(F.lit(form).alias("form"), F.lit(href).alias("href")) for form, href in _HREFS.items()])
    pages = inputs.table(spark, folder, "pages").select("page_id", "url", F.inline(forms))
    return pages.select("page_id", "form", urls.normalize_url(F.col("href"), F.col("url")).alias("resolved"))


def host_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Other spellings of a host for each document: numbers as addresses, zero groups, letters beyond ASCII, and what is no host."""
    number, low = F.col("doc_id") + 70_000, F.col("doc_id").cast("string")
    digits = F.lower(F.hex(F.col("doc_id") % 65_536))
    named = {
        "hex": F.concat(F.lit("0x"), F.hex(number)),
        "decimal": number.cast("string"),
        "short": F.concat(F.lit("010.0x2."), F.pmod("doc_id", F.lit(65_536)).cast("string")),
        "large": F.concat(F.lit("1.2.3.4."), low),
        "zeros": F.concat(F.lit("[0:0::00"), F.substring(digits, 1, 2), F.lit("]")),
        "groups": F.concat(F.lit("[2001:DB8:0:0:1:0:0:"), digits, F.lit("]")),
        "wrong": F.concat(F.lit("[1::2::"), digits, F.lit("]")),
        "letters": F.concat(F.lit("D"), low, F.lit(".B\u00dcCHER.Example")),
        "wide": F.concat(F.lit("d"), low, F.lit("\u3002xn--bcher-KVA\uff0e\uff45xample")),
    }
    forms = F.array(*[F.struct(F.lit(form).alias("form"), F.concat(F.lit("http://"), host, F.lit(":80/x")).alias("url")) for form, host in named.items()])
    hosts = inputs.table(spark, folder, "documents").select("doc_id", F.inline(forms))
    return hosts.select("doc_id", "form", urls.hostname(F.col("url")).alias("host"))


# --- sitemaps and robots ------------------------------------------------------------------------


def robots_sitemaps(spark: SparkSession, folder: str) -> DataFrame:
    """A robots file per page, treated as a site of its own; those of https pages name a sitemap."""
    pages = inputs.table(spark, folder, "pages").select(F.col("page_id").cast("string").alias("site"), "url")
    names_one = F.col("url").startswith("https://")
    body = F.concat(
        F.lit("User-agent: *\n sitemap: indented\n"),
        F.when(names_one, F.concat(F.lit("SiteMap: \t"), "url", F.lit("sitemap:cut \r\nsitemap: second\n"))).otherwise("Allow: /\n"),
    )
    robots = pages.select("site", body.alias("body"))
    given = F.when(F.col("url").endswith("/"), F.concat("url", F.lit("given.xml"))).otherwise("")
    sites = pages.select("site", F.col("url").alias("base_url"), given.alias("sitemap"))
    return sitemap.choose_sitemap(sites, robots).select("site", "sitemap")


def _xml_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Four sitemap documents per page: an index, two url sets and an index that leads back to the first."""
    site = F.concat(F.lit("p"), F.col("page_id").cast("string"))
    address = F.replace("url", F.lit("&"), F.lit("&amp;"))

    def doc(name: str, *pieces: str | Column) -> Column:
        body = F.concat(*[F.lit(piece) if isinstance(piece, str) else piece for piece in pieces])
        return F.struct(F.lit(name).alias("doc_url"), body.alias("body"))

    head = '\n <?xml version="1.0" encoding="UTF-8"?>\n<!-- made -->'
    docs = F.array(
        doc("root.xml", head, "<sitemapindex><sitemap><loc>a.xml</loc></sitemap><sitemap><loc>gone.xml</loc></sitemap>",
            "<sitemap><loc>nested.xml</loc></sitemap><sitemap><loc>c.xml</loc></sitemap></sitemapindex>"),
        doc("a.xml", head, "<urlset><url><loc>", address, "</loc><lastmod>2024-05-01</lastmod><priority>0.5</priority></url>",
            "<url><lastmod>none</lastmod></url><url><loc><![CDATA[", F.col("url"), "&x]]></loc><changefreq></changefreq></url></urlset>"),
        doc("nested.xml", head, "<sitemapindex><sitemap><loc>root.xml</loc></sitemap><sitemap><loc>c.xml</loc></sitemap></sitemapindex>"),
        doc("c.xml", head, "<urlset><url><loc>", address, "/c</loc><changefreq>daily</changefreq></url></urlset>"),
        doc("broken.xml", "<urlset><url><loc>never</loc></url></urlset>"),
    )
    return inputs.table(spark, folder, "pages").select(site.alias("site"), F.inline(docs))


#: Pages are dealt to documents of at most 5,000 entries, as sitemaps are in practice.
_DOCUMENT_NUMBER = "page_id DIV 5000 AS doc"


def _in_documents(entries: DataFrame, keys: list[str]) -> DataFrame:
    """The entries of each document as one text, by page."""
    ordered = F.array_sort(F.collect_list(F.struct("page_id", "entry")))
    return entries.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda e: e["entry"]), "").alias("entries"))


def sitemap_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = _xml_documents(spark, folder)
    roots = inputs.table(spark, folder, "pages").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("site"), F.lit("root.xml").alias("doc_url")
    )
    return sitemap.expand_index(docs, roots)


def sitemap_kinds(spark: SparkSession, folder: str) -> DataFrame:
    docs = _xml_documents(spark, folder)
    kinds = docs.filter(sitemap.looks_like_xml(F.col("body"))).withColumn("kind", sitemap.sitemap_kind(F.col("body")))
    return kinds.groupBy("doc_url", "kind").agg(F.count(F.lit(1)).alias("n"))


def urlset_files(spark: SparkSession, folder: str) -> DataFrame:
    """Sitemap files of bounded size, in which pages without https are commented out; files that break off give nothing."""
    path = f"{checkpoint_dir(spark)}/urlsets-{uuid.uuid4().hex}"
    lastmod = F.when(F.contains("url", F.lit("#")), "<lastmod>2024-05-01</lastmod>").otherwise("")
    entry = F.concat(F.lit("<url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc>"), lastmod, F.lit("</url>\n"))
    shown = F.when(F.startswith("url", F.lit("https://")), entry).otherwise(F.concat(F.lit("<!-- "), entry, F.lit(" -->")))
    pages = inputs.table(spark, folder, "pages")
    docs = _in_documents(pages.select(F.expr(_DOCUMENT_NUMBER), "page_id", shown.alias("entry")), ["doc"])
    head = F.concat(F.lit('<?xml version="1.0"?>\n<urlset>'), "entries")
    whole = docs.select("doc", F.lit("whole").alias("form"), F.concat(head, F.lit("</urlset>")).alias("body"))
    whole.unionByName(docs.select("doc", F.lit("cut").alias("form"), head.alias("body"))).write.partitionBy("form", "doc").text(path)
    found = read_urlset_files(spark, [path])
    doc = F.regexp_extract("file", r"/doc=([0-9]+)/", 1).cast("bigint")
    return found.select(doc.alias("doc"), F.regexp_extract("file", "/form=([a-z]+)/", 1).alias("form"), "pos", "url", "lastmod")


def sitemap_membership(spark: SparkSession, folder: str) -> DataFrame:
    pages = inputs.site_pages(spark, folder)
    records = pages.select("page_id", "site", "url", F.lit(None).cast("string").alias("error"))
    return sitemap.with_sitemap(records, inputs.https_listing(pages)).select("page_id", "in_sitemap")


def sitemap_attrs(spark: SparkSession, folder: str) -> DataFrame:
    """Listed twice with different attributes: the first entry counts."""
    pages = inputs.site_pages(spark, folder)
    listing = inputs.https_listing(pages)
    again = listing.withColumns({"pos": F.col("pos") + (1 << 40), "lastmod": F.lit("later"), "priority": F.lit("1.0")})
    records = pages.select("page_id", "site", "url", F.lit(None).cast("string").alias("error"))
    joined = sitemap.with_sitemap(records, again.unionByName(listing))
    return joined.select("page_id", "lastmod", "priority", "changefreq")


# --- crawls -------------------------------------------------------------------------------------


def _visits(spark: SparkSession, folder: str, options: AuditOptions, resume: bool = False) -> DataFrame:
    pages = inputs.site_pages(spark, folder)
    content = one_snapshot(extract_content(pages.select("site", "url", "html")))
    options = options.effective()
    listing = None if options.single_page else inputs.https_listing(pages)
    start = frontier.seeds(listing, inputs.base_pages(pages), options.sitemap_only)
    earlier = inputs.earlier_pages(pages) if resume else None
    visits = frontier.crawl(start, page_links(content), options.depth, options.limit, options.follow_links, earlier)
    return fetch(visits, content).select("site", "url", "depth", "seq", "title", "error")


def crawl_levels(spark: SparkSession, folder: str) -> DataFrame:
    return _visits(spark, folder, AuditOptions(depth=2, limit=None))


def crawl_limit(spark: SparkSession, folder: str) -> DataFrame:
    return _visits(spark, folder, AuditOptions(depth=2, limit=7))


def crawl_resume(spark: SparkSession, folder: str) -> DataFrame:
    return _visits(spark, folder, AuditOptions(depth=2), resume=True)


def crawl_single(spark: SparkSession, folder: str) -> DataFrame:
    return _visits(spark, folder, AuditOptions(single_page=True))


def crawl_sitemap_only(spark: SparkSession, folder: str) -> DataFrame:
    return _visits(spark, folder, AuditOptions(sitemap_only=True, depth=1))


def crawl_no_links(spark: SparkSession, folder: str) -> DataFrame:
    return _visits(spark, folder, AuditOptions(follow_links=False))


def _shop_crawl(spark: SparkSession, folder: str, limit: int | None) -> DataFrame:
    start = frontier.seeds(None, inputs.shop_bases(spark, folder))
    return frontier.crawl(start, inputs.shop_edges(spark, folder), depth=3, limit=limit)


def graph_bfs(spark: SparkSession, folder: str) -> DataFrame:
    return _shop_crawl(spark, folder, None)


def graph_reach(spark: SparkSession, folder: str) -> DataFrame:
    """The depths of the first two levels of the shop graph, by a recursive query."""
    return frontier.reach(inputs.shop_bases(spark, folder), inputs.shop_edges(spark, folder), depth=2)


def graph_bfs_limit(spark: SparkSession, folder: str) -> DataFrame:
    return _shop_crawl(spark, folder, 100)


def graph_resume(spark: SparkSession, folder: str) -> DataFrame:
    """The shop graph with all finished orders recorded by an earlier run: they are neither visited nor followed."""
    start = frontier.seeds(None, inputs.shop_bases(spark, folder))
    return frontier.crawl(start, inputs.shop_edges(spark, folder), depth=3, limit=None, state=inputs.shop_finished(spark, folder))


def site_audit_records(spark: SparkSession, folder: str) -> DataFrame:
    """The whole audit: crawl, content, sitemap attributes, error records."""
    pages = inputs.site_pages(spark, folder)
    bases = base_urls(inputs.base_pages(pages).select("url"))
    records = site_audit(pages, bases, inputs.https_listing(pages), AuditOptions(depth=1, limit=50))
    return records.select(
        "site", "seq", "url", "depth", "title_score", "h1_score", "in_sitemap", "lastmod", "priority", "changefreq", "error"
    )


# --- summaries and reports ------------------------------------------------------------------------


def _records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the product pages; the sitemap lists those with a keyword of their own in the address."""
    pages = inputs.part_pages(spark, folder)
    listing = pages.filter(F.col("status") != 500).select(
        "site", F.lit("s").alias("doc_url"), F.col("p_partkey").alias("pos"), "url",
        F.lit("2024").alias("lastmod"), F.lit("").alias("priority"), F.lit("").alias("changefreq"),
    )
    records = sitemap.with_sitemap(extract_content(pages), listing)
    quoted = F.concat(F.lit('Say "'), "title", F.lit('", <now>'))
    return records.withColumns(
        {
            "seq": F.col("p_partkey"),
            "suggested_title": F.when(F.col("description_score") != fixed.GOOD, quoted),
            "suggested_description": F.lit(None).cast("string"),
            "suggested_keywords": F.lower("keywords"),
        }
    )


def audit_summary_query(spark: SparkSession, folder: str) -> DataFrame:
    return audit_summary(_records(spark, folder))


def audit_percentages_query(spark: SparkSession, folder: str) -> DataFrame:
    shares = audit_percentages(audit_summary(_records(spark, folder)))
    return shares.select("site", *[name for name in shares.columns if name.endswith(("completeness", "percentage"))])


def page_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Per site of the raw pages: how many pages, titles, title issues, headings, heading issues."""
    tokens = _tokens(inputs.site_pages(spark, folder))
    fields = tokens.select(
        "site", html.title_from_tokens(F.col("_tokens")).alias("title"), html.h1_count(F.col("_tokens")).alias("h1_count")
    )
    title_bad = scores.title_score(text.js_length(F.col("title"))) != fixed.GOOD
    return fields.groupBy("site").agg(
        F.count(F.lit(1)).alias("total_pages"),
        F.count_if(F.col("title") != "").alias("pages_with_title"),
        F.count_if(F.col("h1_count") > 0).alias("pages_with_h1"),
        F.count_if(title_bad).alias("pages_with_title_issues"),
        F.count_if(scores.h1_score(F.col("h1_count")) != fixed.GOOD).alias("pages_with_h1_issues"),
    )


def csv_report(spark: SparkSession, folder: str) -> DataFrame:
    return report.csv_view(_records(spark, folder))


def csv_lines(spark: SparkSession, folder: str) -> DataFrame:
    return report.csv_lines(report.csv_view(_records(spark, folder), keep=("seq",)), keep=("seq",))


def html_report_rows(spark: SparkSession, folder: str) -> DataFrame:
    return report.html_rows(_records(spark, folder))


def html_summary_rows(spark: SparkSession, folder: str) -> DataFrame:
    return report.html_summary(audit_percentages(audit_summary(_records(spark, folder))))


def complete_suggestions(spark: SparkSession, folder: str) -> DataFrame:
    records = _records(spark, folder).withColumn("suggested_description", F.col("og_description"))
    return filter_in_place(records, scores.suggestion_complete()).select("p_partkey", "suggested_title")


# --- keywords ---------------------------------------------------------------------------------------


def keyword_cleaning(spark: SparkSession, folder: str) -> DataFrame:
    """Cells as a spreadsheet export writes them: padded, with percent signs, exponents or nothing."""
    size = F.col("p_size").cast("string")
    cell = (
        F.when(F.col("p_type") == "ECONOMY", F.concat(size, F.lit("%")))
        .when(F.col("p_type") == "SMALL", F.concat(F.lit("  "), size, F.lit("\t")))
        .when(F.col("p_type") == "LARGE", F.concat(size, F.lit("e2")))
        .when(F.col("p_type") == "PROMO", F.concat(F.lit("1,"), size))
        .when(F.col("p_type") == "MEDIUM", F.concat(F.lit("-"), size, F.lit(".5")))
        .otherwise(F.lit(""))
    )
    padded = F.when(F.col("p_size") > 2, F.concat(F.lit("\t "), "p_name", F.lit(" "))).otherwise(" ")
    rows = inputs.table(spark, folder, "part").select("p_partkey", padded.alias("keyword"), cell.alias("cell"))
    return keywords.clean_keywords(rows).select("p_partkey", "keyword", keywords.metric("cell").alias("clicks"))


def keyword_top_n(spark: SparkSession, folder: str) -> DataFrame:
    return keywords.top_keywords(inputs.part_keywords(spark, folder))


def keyword_top_impressions(spark: SparkSession, folder: str) -> DataFrame:
    return keywords.top_by_impressions(keywords.top_keywords(inputs.part_keywords(spark, folder), 40), 10)


def keyword_top_clicks(spark: SparkSession, folder: str) -> DataFrame:
    return keywords.top_by_clicks(keywords.top_keywords(inputs.part_keywords(spark, folder), 40), 10)


def keyword_union_topk(spark: SparkSession, folder: str) -> DataFrame:
    ranked = keywords.top_keywords(inputs.part_keywords(spark, folder), 40)
    return keywords.union_first_wins(keywords.top_by_impressions(ranked, 10), keywords.top_by_clicks(ranked, 10))


def keyword_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of all metric rows, unknown and zero metrics among them."""
    rows = inputs.part_keywords(spark, folder)
    label = keywords.keyword_label(F.col("keyword"), F.col("clicks"), F.col("impressions"))
    return rows.select("row_pos", label.alias("label"))


def keyword_list(spark: SparkSession, folder: str) -> DataFrame:
    return keywords.keyword_list(keywords.top_keywords(inputs.part_keywords(spark, folder)))


# --- suggestions --------------------------------------------------------------------------------------


def _prompts(spark: SparkSession, folder: str) -> DataFrame:
    pages = inputs.site_pages(spark, folder)
    content = extract_content(pages.withColumn("page_text", F.col("html"))).withColumnRenamed("page_text", "html")
    listed = keywords.keyword_list(keywords.top_keywords(inputs.part_keywords(spark, folder)))
    return suggest.prompt(suggest.select_requests(content), listed, fixed.EXCLUDED_KEYWORDS)


def suggest_requests(spark: SparkSession, folder: str) -> DataFrame:
    return _prompts(spark, folder).select("page_id", "url", "prompt")


def request_records(spark: SparkSession, folder: str) -> DataFrame:
    return suggest.request_records(_prompts(spark, folder))


def response_parse(spark: SparkSession, folder: str) -> DataFrame:
    answers = inputs.document_responses(spark, folder)
    return answers.select("url", F.inline(F.array(suggest.parse_response(F.col("content")))))


def attached_suggestions(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with the answer for their id; pages beyond the documents get none."""
    pages = inputs.table(spark, folder, "pages").select(F.col("page_id").cast("string").alias("url"))
    return suggest.attach_suggestions(pages, inputs.document_responses(spark, folder))


# --- change sets ------------------------------------------------------------------------------------------

_CONFIG = {
    "other": {"type": "drupal"},
    "aem": {
        "type": "aem",
        "authorUrl": "https://author.example.com",
        "sitePathPrefix": "/content/en",
        "replicateAfterUpdate": True,
        "propertyMap": {"title": "jcr:title", "description": "cq:description", "keywords": "cq:tags"},
        "tagNamespace": "/content/cq:tags/site",
        "tagNamespaceMap": {"/en/": "/content/cq:tags/en", "example.org": "/content/cq:tags/org/", "/fr/": "/plain"},
    },
}


def _suggested(spark: SparkSession, folder: str) -> DataFrame:
    pages = inputs.site_pages(spark, folder)
    titled = pages.select("page_id", "site", "url", html.title(F.col("html")).alias("title"))
    return inputs.suggested_pages(titled, spark, folder)


def target_paths(spark: SparkSession, folder: str) -> DataFrame:
    pages = inputs.table(spark, folder, "pages")
    forms = {"none": None, "plain": "/content/en", "slashed": "/content/site/", "same": "/en"}
    paths = {f"path_{name}": changeset.target_path(F.col("url"), prefix) for name, prefix in forms.items()}
    content = changeset.content_path(changeset.target_path(F.col("url"), "/content/en"))
    return pages.select("page_id", *[path.alias(name) for name, path in paths.items()], content.alias("content_path"))


def target_tags(spark: SparkSession, folder: str) -> DataFrame:
    target = target_from_config(_CONFIG)
    namespace = changeset.tag_namespace(F.col("url"), target)
    tags = changeset.split_tags(F.col("suggested_keywords"))
    return _suggested(spark, folder).select(
        "page_id",
        namespace.alias("namespace"),
        F.array_join(tags, "|").alias("tags"),
        F.array_join(changeset.multi_value(tags, namespace), "|", "?").alias("tag_ids"),
        F.array_join(changeset.keyword_property(tags), "|").alias("keyword_property"),
    )


def ruled_namespaces(spark: SparkSession, folder: str) -> DataFrame:
    """Namespaces by a table of rules: paths of pages with a fragment, then hosts of later pages, then two letters of a path."""
    pages = inputs.table(spark, folder, "pages").select("page_id", "url")
    paths = pages.filter(F.contains("url", F.lit("#"))).select(F.col("page_id").cast("bigint").alias("ord"), F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1).alias("pattern"))
    hosts = pages.filter(F.contains("url", F.lit("?page"))).select((F.col("page_id") + (1 << 40)).alias("ord"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("pattern"))
    short = spark.range(1).select(F.lit(1 << 41).alias("ord"), F.lit("/e").alias("pattern"))
    rules = paths.unionByName(hosts).unionByName(short).withColumn("ns", F.concat(F.lit("/content/cq:tags/"), F.col("ord").cast("string")))
    return with_tag_namespace(pages, rules, "/content/cq:tags/site")


def tags_to_create(spark: SparkSession, folder: str) -> DataFrame:
    """Tags the pages want less those that exist: the link targets of the pages are tags of the first namespace."""
    target = target_from_config(_CONFIG)
    edges = link_edges(extract_content(inputs.site_pages(spark, folder)))
    node = changeset.tag_node(F.element_at(F.split("dst", "/"), -1))
    existing = edges.select(F.lit("/content/cq:tags/en").alias("namespace"), node.alias("node")).distinct()
    return changeset.tags_to_create(changeset.wanted_tags(_suggested(spark, folder), target), existing)


def change_set(spark: SparkSession, folder: str) -> DataFrame:
    changes = changeset.change_set(_suggested(spark, folder), target_from_config(_CONFIG))
    return changes.withColumn("values", F.array_join("values", "|"))


def change_set_defaults(spark: SparkSession, folder: str) -> DataFrame:
    """The default property map, no prefix and no replication; written out and read back."""
    target = changeset.Target(author_url="https://author.example.com", update_fields=("title", "keywords", "unknown"))
    path = f"{checkpoint_dir(spark)}/changes-{uuid.uuid4().hex}"
    changes = changeset.change_set(_suggested(spark, folder), target)
    write_changes(changes, path)
    return spark.read.parquet(path).withColumn("values", F.array_join("values", "|"))


# --- increments ----------------------------------------------------------------------------------------------


def incremental_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Pages not recorded earlier."""
    pages = inputs.site_pages(spark, folder)
    fresh = state.audit_increment(pages, inputs.earlier_pages(pages))
    return fresh.select("site", "url", "title", "title_score", F.size("links").alias("n_links"))


def state_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs over all pages into one state: the second adds nothing."""
    path = f"{checkpoint_dir(spark)}/state-{uuid.uuid4().hex}"
    pages = inputs.site_pages(spark, folder)
    for _ in range(2):
        earlier = read_state(spark, path)
        write_state(state.audit_increment(pages, earlier), path)
    return read_state(spark, path).select("site", "url", "title", "h1_count")


def _fields(spark: SparkSession, path: str) -> DataFrame:
    return read_state(spark, path).select("site", "url", "seq", "title")


def state_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs, a forced run over the https pages, whose titles have changed, and a rewrite of the log: each address once, with its first number."""
    path = f"{checkpoint_dir(spark)}/state-{uuid.uuid4().hex}"
    pages = inputs.site_pages(spark, folder)
    changed = pages.filter(F.col("url").startswith("https://")).withColumn("html", F.concat(F.lit("<title>again</title>"), "html"))
    for run, force in ((pages.filter(~F.col("url").contains("#")), False), (pages, False), (changed, True)):
        write_state(state.audit_increment(run, read_state(spark, path), force), path)
    state_log.compact(spark, path, many=2)
    return _fields(spark, path)


def state_replaced(spark: SparkSession, folder: str) -> DataFrame:
    """A state of all pages, then a forced run that starts anew for the sites that have a page with a fragment: of these only its records count."""
    path = f"{checkpoint_dir(spark)}/state-{uuid.uuid4().hex}"
    pages = inputs.site_pages(spark, folder)
    write_state(state.audit_increment(pages, None), path)
    listed = pages.join(inputs.earlier_pages(pages).select("site").distinct(), "site", "left_semi")
    options = AuditOptions(depth=0, limit=None, sitemap_only=True, force=True)
    records = site_audit(pages, inputs.base_pages(listed), inputs.https_listing(listed), options, read_state(spark, path))
    write_state(records, path, replaces=True)
    return _fields(spark, path)


def audit_resumed(spark: SparkSession, folder: str) -> DataFrame:
    """An audit of the https pages is recorded; the next one, of all pages, gives these records and then the new ones."""
    path = f"{checkpoint_dir(spark)}/state-{uuid.uuid4().hex}"
    pages = inputs.site_pages(spark, folder)
    bases = inputs.base_pages(pages)
    write_state(site_audit(pages, bases, inputs.https_listing(pages), AuditOptions(depth=0, limit=None, sitemap_only=True)), path)
    records = site_audit(pages, bases, _whole_listing(pages), AuditOptions(depth=0, limit=None), read_state(spark, path))
    return records.select("site", "seq", "url", "title", "lastmod")


def stream_audit(spark: SparkSession, folder: str) -> DataFrame:
    """The page file as a stream; each address is recorded once."""
    run = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = audit_stream(spark, f"{folder}/page[s].parquet", f"{run}/records", f"{run}/checkpoint")
    query.awaitTermination()
    return read_state(spark, f"{run}/records").select("site", "url", "title", "h1_count")


def json_report(spark: SparkSession, folder: str) -> DataFrame:
    """The JSON report, written and read back."""
    path = f"{checkpoint_dir(spark)}/report-{uuid.uuid4().hex}"
    records = _records(spark, folder)
    write_json(records, path, "https://example.com", {"depth": "3"})
    stored = spark.read.schema(records.select("url", "title", "links").schema).json(f"{path}/pages")
    return stored.select("url", "title", F.array_join("links", " ").alias("links"))


# --- untidy input and whole paths ---------------------------------------------------------------------------------


def untidy_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Product pages with stray quotes, quotes in unquoted values and a heading inside a frame."""
    key, name = F.col("p_partkey").cast("string"), F.col("p_name")
    body = F.concat(
        F.lit('<meta name="robots"" content="'), "p_type", F.lit("\"><p class=\"a\"b\">"), name, F.lit('</p><a href="/part/'), key,
        F.lit("\"\">x</a><p title=it's>"), "p_brand", F.lit("</p><a href=/q\"v>y</a><iframe src=f><h1>no</h1></iframe><h1 id='h''>"), name, F.lit("</h1>"),
    )
    host = F.lit("parts.example.com")
    pages = inputs.table(spark, folder, "part").select(
        "p_partkey", host.alias("site"), F.concat(F.lit("https://parts.example.com/p/"), key).alias("url"), body.alias("html"), body.alias("kept")
    )
    content = extract_content(pages)
    return content.select(
        "p_partkey", "robots", "h1_text", "h1_count", F.array_join("links", " ").alias("links"), html.visible_text(F.col("kept")).alias("visible_text")
    )


def template_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Product pages with nested, closed and unclosed templates, a template in a script and a drawing with a title of its own."""
    key, name = F.col("p_partkey").cast("string"), F.col("p_name")
    hidden = F.concat(F.lit("<template id='</template>'><title>no</title><h1>no "), name, F.lit("</h1><template><a href=/no>n</a></template><meta name=robots content=no></template>"))
    body = F.concat(
        hidden, F.lit("<script>'<template>'</script><title>"), name, F.lit("</title><meta name=robots content='"), "p_type", F.lit("'><body>"), hidden,
        F.lit("<svg><title>icon</title><template></svg><h1>"), "p_brand", F.lit("</h1><a href='/part/"), key, F.lit("'>x</a>"),
        F.when(F.col("p_size") > 25, F.concat(F.lit("<TEMPLATE>"), hidden, F.lit("<a href=/never>y</a><h1>z"))).otherwise(F.lit("</template><a href=/last>y</a>")),
    )
    pages = inputs.table(spark, folder, "part").select(
        "p_partkey", F.lit("parts.example.com").alias("site"), F.concat(F.lit("https://parts.example.com/p/"), key).alias("url"), body.alias("html"), body.alias("kept")
    )
    content = extract_content(pages)
    return content.select(
        "p_partkey", "title", "robots", "h1_text", "h1_count", F.array_join("links", " ").alias("links"), html.visible_text(F.col("kept")).alias("visible_text")
    )


def _snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Every page three times: as it is, later with a title in front, and latest of all but failed."""
    pages = inputs.site_pages(spark, folder).select("site", "url", "html")
    first = pages.select("*", F.lit(200).alias("status"), F.lit(1).alias("fetched_at"))
    later = pages.select("site", "url", F.concat(F.lit("<title>later</title>"), "html").alias("html"), F.lit(200).alias("status"), F.lit(2).alias("fetched_at"))
    failed = pages.select("*", F.lit(500).alias("status"), F.lit(3).alias("fetched_at"))
    return first.unionByName(later).unionByName(failed)


def _whole_listing(pages: DataFrame) -> DataFrame:
    none = F.lit("").alias
    return pages.select("site", F.lit("s").alias("doc_url"), F.col("page_id").alias("pos"), "url", none("lastmod"), none("priority"), none("changefreq"))


def repeated_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """The crawl and the increment take one snapshot of each address, the latest that was read."""
    pages, snapshots = inputs.site_pages(spark, folder), _snapshots(spark, folder)
    crawled = site_audit(snapshots, inputs.base_pages(pages), _whole_listing(pages), AuditOptions(depth=0, limit=None))
    added = state.audit_increment(snapshots, None)
    routes = [rows.select(F.lit(name).alias("route"), "url", "title", "error") for name, rows in (("crawl", crawled), ("increment", added))]
    return routes[0].unionByName(routes[1])


def increment_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Counts over a state that a stream and then a batch have written: every page is in or out of a sitemap, and has a number."""
    run = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    audit_stream(spark, f"{folder}/page[s].parquet", f"{run}/records", f"{run}/checkpoint", files=1).awaitTermination()
    pages = inputs.site_pages(spark, folder)
    write_state(state.audit_increment(pages, read_state(spark, f"{run}/records")), f"{run}/records")
    stored = read_state(spark, f"{run}/records")
    numbered = report.html_rows(stored).groupBy("site").agg(F.count("row_html").alias("rows"), F.countDistinct("seq").alias("numbers"))
    counts = audit_summary(stored).select("site", "total_pages", "pages_in_sitemap", "pages_not_in_sitemap")
    return counts.join(numbered, "site")


def kept_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Counts kept by differences over a stream, a rewriting of full buckets and a forced run over the pages with a fragment."""
    run = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    records, counts = f"{run}/records", f"{run}/counts"
    audit_stream(spark, f"{folder}/page[s].parquet", records, f"{run}/checkpoint", files=1, summary=counts).awaitTermination()
    state_log.compact(spark, records, many=1)
    again = inputs.site_pages(spark, folder).filter(F.contains("url", F.lit("#"))).withColumn("html", F.lit("<title>later</title>"))
    write_state(state.audit_increment(again, read_state(spark, records), force=True), records)
    summary_log.update(spark, records, counts)
    return summary_log.read(spark, counts).select("site", "total_pages", "pages_with_title", "pages_with_title_issues", "pages_with_h1", "pages_not_in_sitemap")


def audited_from_robots(spark: SparkSession, folder: str) -> DataFrame:
    """Robots files name indexes, these name sitemaps, which list the pages, and the audit visits them in their order."""
    pages = inputs.site_pages(spark, folder)
    entry = F.concat(F.lit("<url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    parts = _in_documents(pages.select("site", F.expr(_DOCUMENT_NUMBER), "page_id", entry.alias("entry")), ["site", "doc"])
    address = F.concat(F.lit("https://"), "site", F.lit("/map"))
    listed = F.concat(address, F.lit("-"), F.col("doc").cast("string"), F.lit(".xml"))
    sets = parts.select("site", listed.alias("doc_url"), F.concat(F.lit('<?xml version="1.0"?><urlset>'), "entries", F.lit("</urlset>")).alias("body"))
    child = F.concat(F.lit("<sitemap><loc>"), listed, F.lit("</loc></sitemap>"))
    indexes = _in_documents(parts.select("site", F.col("doc").alias("page_id"), child.alias("entry")), ["site"])
    body = F.concat(F.lit('<?xml version="1.0"?><sitemapindex>'), "entries", F.lit("</sitemapindex>"))
    root = indexes.select("site", F.concat(address, F.lit(".xml")).alias("doc_url"), body.alias("body"))
    robots = root.select("site", F.concat(F.lit("User-agent: *\nSitemap: "), "doc_url", F.lit("\n")).alias("body"))
    bases = inputs.base_pages(pages)
    listing = sitemap_listing(bases.select("site", F.col("url").alias("base_url"), F.lit("").alias("sitemap")), robots, sets.unionByName(root))
    records = site_audit(pages, bases, listing, AuditOptions(depth=0, limit=None))
    return records.select("site", "seq", "url", "in_sitemap")


def audit_with_suggestions(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of the model go into the records and from there into the change set."""
    pages = inputs.site_pages(spark, folder)
    answer = F.struct(
        F.concat(F.lit("Title "), "page_id").alias("suggestedTitle"), F.lit("").alias("suggestedDescription"), F.lit("Red, Blue").alias("suggestedKeywords")
    )
    responses = pages.select("url", F.to_json(answer).alias("content"))
    records = site_audit(pages, inputs.base_pages(pages), _whole_listing(pages), AuditOptions(depth=0, limit=None), responses=responses)
    changes = changeset.change_set(records, changeset.Target(author_url="https://author.example.com"))
    return changes.select("site", "url", "property", F.array_join("values", "|").alias("values"), "action")


def keyword_export_files(spark: SparkSession, folder: str) -> DataFrame:
    """Keyword files of two headers, one with a column named File, with line breaks inside quoted cells."""
    path = f"{checkpoint_dir(spark)}/keywords-{uuid.uuid4().hex}"
    part = inputs.table(spark, folder, "part")
    broken = F.concat("p_name", F.lit("\n"), "p_brand")
    one = part.select(F.lit("f").alias("File"), broken.alias("Search Term"), F.col("p_size").alias("Clicks"))
    two = part.select(F.col("p_size").alias("Impressions"), F.concat("p_brand", F.lit(', "big"')).alias("Keyword"))
    for name, rows in (("one", one), ("two", two)):
        rows.write.option("header", True).option("escape", '"').csv(f"{path}/{name}")
    found = read_keyword_files(spark, [f"{path}/one", f"{path}/two"])
    return found.groupBy("keyword").agg(F.count(F.lit(1)).alias("n"), F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))


def source_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Every input table written in its stored form and read by its reader: rows and characters."""
    path = f"{checkpoint_dir(spark)}/sources-{uuid.uuid4().hex}"
    pages = inputs.site_pages(spark, folder)
    robots = pages.select(F.col("page_id").cast("string").alias("site"), F.col("url").alias("body"))
    stored = {
        "pages": pages.select("site", "url", "html"),
        "docs": _xml_documents(spark, folder),
        "robots": robots,
        "tags": pages.select(F.lit("/content/cq:tags/en").alias("namespace"), F.col("url").alias("node")),
    }
    for name, rows in stored.items():
        rows.write.parquet(f"{path}/{name}")
    inputs.document_responses(spark, folder).write.json(f"{path}/responses")
    addresses = pages.select(F.expr(_DOCUMENT_NUMBER), "page_id", F.col("url").alias("entry"))
    lines = addresses.withColumn("entry", F.concat("entry", F.lit("\n")))
    _in_documents(lines, ["doc"]).write.partitionBy("doc").text(f"{path}/texts")
    read = {
        "pages": (read_pages(spark, f"{path}/pages"), "html"),
        "docs": (read_sitemap_docs(spark, f"{path}/docs"), "doc_url"),
        "robots": (read_robots(spark, f"{path}/robots"), "body"),
        "tags": (read_tags(spark, f"{path}/tags"), "node"),
        "responses": (read_responses(spark, f"{path}/responses"), "url"),
        "texts": (read_text_docs(spark, f"{path}/texts"), "body"),
    }
    counts = [
        rows.select(F.lit(name).alias("source"), F.col(column)).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(column)).alias("chars"))
        for name, (rows, column) in read.items()
    ]
    whole = counts[0]
    for more in counts[1:]:
        whole = whole.unionByName(more)
    return whole


QUERIES: dict[str, Query] = {
    "untidy_pages": untidy_pages,
    "template_pages": template_pages,
    "repeated_snapshots": repeated_snapshots,
    "increment_summary": increment_summary,
    "kept_summary": kept_summary,
    "audited_from_robots": audited_from_robots,
    "audit_with_suggestions": audit_with_suggestions,
    "keyword_export_files": keyword_export_files,
    "source_tables": source_tables,
    "title_scores": title_scores,
    "h1_scores": h1_scores,
    "visible_text": visible_text,
    "tag_tokens": tag_tokens,
    "meta_tags": meta_tags,
    "og_twitter_tags": og_twitter_tags,
    "desc_keyword_scores": desc_keyword_scores,
    "error_records": error_records,
    "escaped_titles": escaped_titles,
    "collapsed_documents": collapsed_documents,
    "link_edges": link_edges_query,
    "url_parts": url_parts,
    "site_keys": site_keys,
    "url_resolution": url_resolution,
    "host_forms": host_forms,
    "robots_sitemaps": robots_sitemaps,
    "sitemap_documents": sitemap_documents,
    "sitemap_kinds": sitemap_kinds,
    "urlset_files": urlset_files,
    "sitemap_membership": sitemap_membership,
    "sitemap_attrs": sitemap_attrs,
    "crawl_levels": crawl_levels,
    "crawl_limit": crawl_limit,
    "crawl_resume": crawl_resume,
    "crawl_single": crawl_single,
    "crawl_sitemap_only": crawl_sitemap_only,
    "crawl_no_links": crawl_no_links,
    "graph_bfs": graph_bfs,
    "graph_bfs_limit": graph_bfs_limit,
    "graph_reach": graph_reach,
    "graph_resume": graph_resume,
    "site_audit_records": site_audit_records,
    "audit_summary": audit_summary_query,
    "audit_percentages": audit_percentages_query,
    "page_summary": page_summary,
    "csv_report": csv_report,
    "csv_lines": csv_lines,
    "html_report_rows": html_report_rows,
    "html_summary_rows": html_summary_rows,
    "complete_suggestions": complete_suggestions,
    "keyword_cleaning": keyword_cleaning,
    "keyword_top_n": keyword_top_n,
    "keyword_top_impressions": keyword_top_impressions,
    "keyword_top_clicks": keyword_top_clicks,
    "keyword_union_topk": keyword_union_topk,
    "keyword_labels": keyword_labels,
    "keyword_list": keyword_list,
    "suggest_requests": suggest_requests,
    "request_records": request_records,
    "response_parse": response_parse,
    "attached_suggestions": attached_suggestions,
    "target_paths": target_paths,
    "target_tags": target_tags,
    "ruled_namespaces": ruled_namespaces,
    "tags_to_create": tags_to_create,
    "change_set": change_set,
    "change_set_defaults": change_set_defaults,
    "incremental_audit": incremental_audit,
    "state_round_trip": state_round_trip,
    "state_versions": state_versions,
    "state_replaced": state_replaced,
    "audit_resumed": audit_resumed,
    "stream_audit": stream_audit,
    "json_report": json_report,
}
