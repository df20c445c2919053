"""Schemas of the tables the library reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

_string, _int, _long, _double = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


PAGES = _schema(site=_string, url=_string, status=_int, html=_string)
SITEMAP_DOCS = _schema(site=_string, doc_url=_string, body=_string)
ROBOTS = _schema(site=_string, body=_string)
SITEMAP_URLS = _schema(
    site=_string, doc_url=_string, pos=_long, url=_string, lastmod=_string, priority=_string, changefreq=_string
)
LINK_EDGES = _schema(site=_string, src=_string, dst=_string, pos=_int)
KEYWORD_METRICS = _schema(
    file=_string, sheet_pos=_int, row_pos=_long, keyword=_string, clicks=_double, impressions=_double
)
RESPONSES = _schema(url=_string, content=_string)
EXISTING_TAGS = _schema(namespace=_string, node=_string)

# what a page says about itself, before any join
PAGE_CONTENT_FIELDS = (
    ("title", _string),
    ("title_length", _int),
    ("title_score", _string),
    ("description", _string),
    ("description_length", _int),
    ("description_score", _string),
    ("keywords", _string),
    ("keywords_count", _int),
    ("keywords_score", _string),
    ("h1_count", _int),
    ("h1_score", _string),
    ("h1_text", _string),
    ("canonical_url", _string),
    ("og_title", _string),
    ("og_description", _string),
    ("og_image", _string),
    ("twitter_card", _string),
    ("twitter_title", _string),
    ("twitter_description", _string),
    ("twitter_image", _string),
    ("robots", _string),
)
PAGE_METADATA = T.StructType(
    [T.StructField("site", _string), T.StructField("seq", _long), T.StructField("url", _string)]
    + [T.StructField(name, kind) for name, kind in PAGE_CONTENT_FIELDS]
    + [
        T.StructField("depth", _int),
        T.StructField("links", T.ArrayType(_string)),
        T.StructField("in_sitemap", T.BooleanType()),
        T.StructField("lastmod", _string),
        T.StructField("priority", _string),
        T.StructField("changefreq", _string),
        T.StructField("error", _string),
        T.StructField("suggested_title", _string),
        T.StructField("suggested_description", _string),
        T.StructField("suggested_keywords", _string),
    ]
)
CRAWL_STATE = T.StructType(PAGE_METADATA.fields + [T.StructField("crawl_date", T.TimestampType())])
