"""On-page fields read from raw HTML by regular expressions, one pass per page.

The patterns walk a page once and never backtrack: groups repeat possessively, so neither a huge tag nor an
unclosed one can exhaust the stack or the clock, and no tag is too large to read.  What an HTML parser does with
an unclosed comment, script or tag -- it swallows the rest of the page -- is done here too.

A quote opens a value only right after an equals sign; elsewhere it belongs to a name or an unquoted value, and the next
``>`` ends the tag.

The content of a ``template`` is no part of a page, however deep templates are nested; :func:`without_templates` takes it out before
anything is read.  A title inside ``svg`` is found like any other, as a selector by name finds it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageledger.functions.entities import decode_entities, decode_sql
from pageledger.functions.sqltext import apply, bind, fold, lower_sql, map_array, quote
from pageledger.functions.text import js_collapse, js_trim, let

_COMMENT = r"!--(?:-?>|(?:[^-]++|-(?!-!?>))*+(?:--!?>|\z))"


def _raw_element(name: str) -> str:
    """An element whose content is not markup, up to its end tag or the end of the page."""
    return rf"{name}[\s/>](?:[^<]++|<(?!/{name}[\s/>]))*+(?:</{name}[^>]*+>?|\z)"


_SCRIPT = _raw_element("script")
_STYLE = _raw_element("style")
_TEXTAREA = _raw_element("textarea")
_TITLE = _raw_element("title")
_IFRAME = _raw_element("iframe")
_NOSCRIPT = _raw_element("noscript")
# an attribute's name and value, and the inside of a tag after its name, up to its closing bracket
_NAME = r"[^\s/>][^\s/>=]*+"
_VALUE = r"(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]++)"
_TAG_REST = r"[^>=]*+(?:=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]*+)[^>=]*+)*+>"
_ANY_TAG = r"[a-z]" + _TAG_REST
_MARKUP = r"[!?/][^>]*+>?"
_UNCLOSED_TAG = r"[a-z].*+"

# attribute name (the tag's own name comes first) and value with its quotes
_ATTRIBUTE = rf"({_NAME})(?:\s*+=\s*+({_VALUE})?+)?+"

_FIRST_H1 = (
    "(?is)\\A(?:[^<]++|<(?!h1[\\s/>])(?:"
    + "|".join([_COMMENT, _SCRIPT, _STYLE, _TEXTAREA, _TITLE, _IFRAME, _ANY_TAG, _UNCLOSED_TAG])
    + r"|))*+<h1(?:[\s/]" + _TAG_REST + r"|>)((?:[^<]++|<" + _COMMENT + r"|(?!</?h[1-6][\s/>])<)*+)"
)
_IS_TITLE = r"(?i)\Atitle[\s/>]"

_REGION = r"(?:template|svg|math)"
# a stretch without a tag that opens or closes a region, or one such tag; one that is not closed swallows the rest
_STRETCH = (
    rf"(?is)(?:[^<]++|<(?!/?{_REGION}[\s/>])(?:"
    + "|".join([_COMMENT, _SCRIPT, _STYLE, _TEXTAREA, _TITLE, _IFRAME, _ANY_TAG, _UNCLOSED_TAG])
    + rf"|))++|<{_REGION}(?:[\s/]" + _TAG_REST + rf"|>)|</{_REGION}[^>]*+>?|<.*+"
)
_HAS_TEMPLATE = r"<[tT][eE][mM][pP][lL][aA][tT][eE][\s/>]"

# the tags the page record needs
RECORD_TAGS = ("a", "h1", "link", "meta")


def _token_pattern(tags: Sequence[str] | None) -> str:
    """Start tags and titles, less their bracket, land in group 1; all that is skipped leaves the group empty."""
    wanted = _ANY_TAG if tags is None else "(?:" + "|".join(tags) + r")(?:[\s/]" + _TAG_REST + "|>)"
    skipped = [_COMMENT, _SCRIPT, _STYLE, _TEXTAREA, _IFRAME]
    return "(?is)<(?:" + "|".join([*skipped, f"({_TITLE}|{wanted})", _ANY_TAG, _MARKUP, _UNCLOSED_TAG]) + ")"


def _step(piece: Column) -> Column:
    """What a stretch does to the depth: opens or closes a template or an element of another language, or nothing."""
    return (
        F.when(~piece.rlike(rf"(?i)\A</?{_REGION}[\s/>]"), "none")
        .when(piece.rlike(r"(?i)\A<template"), "open")
        .when(piece.rlike(r"(?i)\A</template"), "close")
        .when(F.startswith(piece, F.lit("</")), "leave")
        .when(F.endswith(piece, F.lit("/>")), "none")
        .otherwise("enter")
    )


def without_templates(html: Column) -> Column:
    """The page less the content of its templates, whose outermost tags stay.

    One pass cuts the page at the tags that matter and folds a depth over the pieces.  Inside ``svg`` and ``math`` a ``template`` is an
    element like others; a template's end also ends what is open inside of it; a template that is not closed reaches to the end of the
    page.  A fold copies the array that it appends to, so pieces are folded in stretches of the root of their number.  Pages without a
    template are passed through.
    """

    def walk(state: Column, piece: Column) -> Column:
        step, depth, foreign = piece["step"], state["depth"], state["foreign"]
        opens = (step == "open") & (foreign == 0)
        closes = (step == "close") & (depth > 0)
        deeper = depth + opens.cast("int") - closes.cast("int")
        stays = (depth == 0) | (deeper == 0)
        inside = (
            F.when(closes | opens, 0)
            .when(step == "enter", foreign + 1)
            .when(step == "leave", F.greatest(foreign - 1, F.lit(0)))
            .otherwise(foreign)
        )
        kept = F.when(stays, F.concat(state["kept"], F.array(piece["text"]))).otherwise(state["kept"])
        return F.struct(deeper.alias("depth"), inside.alias("foreign"), kept.alias("kept"))

    def state(depth: Column, foreign: Column, kind: str) -> Column:
        return F.struct(depth.alias("depth"), foreign.alias("foreign"), F.array().cast(kind).alias("kept"))

    def folded(pieces: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(pieces))).cast("int")
        starts = F.sequence(F.lit(1), F.size(pieces), width)

        def along(before: Column, start: Column) -> Column:
            part = F.aggregate(F.slice(pieces, start, width), state(before["depth"], before["foreign"], "array<string>"), walk)
            return F.aggregate(
                F.array(part), before, lambda _, p: F.struct(p["depth"].alias("depth"), p["foreign"].alias("foreign"), F.concat(before["kept"], F.array(F.array_join(p["kept"], ""))).alias("kept"))
            )

        return F.aggregate(starts, state(F.lit(0), F.lit(0), "array<string>"), along, lambda end: F.array_join(end["kept"], ""))

    pieces = F.transform(F.regexp_extract_all(html, F.lit(_STRETCH), F.lit(0)), lambda piece: F.struct(piece.alias("text"), _step(piece).alias("step")))
    return F.when(html.rlike(_HAS_TEMPLATE), let(pieces, folded)).otherwise(html)


def raw_tokens(html: Column, tags: Sequence[str] | None = None) -> Column:
    """Source text of the wanted start tags and of titles, in page order."""
    found = F.regexp_extract_all(without_templates(html), F.lit(_token_pattern(tags)), F.lit(1))
    return F.filter(found, lambda token: token != "")


_TAG = "STRUCT<pos:INT,name:STRING,attrs:MAP<STRING,STRING>>"
_PAGE_TAGS = "STRUCT<metas:ARRAY<STRUCT<name:STRING,property:STRING,content:STRING>>,canonical:STRING,hrefs:ARRAY<STRING>>"


@cache
def _parse_tag() -> str:
    """SQL lambda from a token and its position to ``struct<pos,name,attrs>``.

    Among duplicate attributes the first wins; the search for them is only paid by tags that have some.
    """
    pattern = quote(_ATTRIBUTE)
    unquoted = "CASE WHEN left(v, 1) IN ('\"', '\\'') THEN substring(v, 2, length(v) - 2) ELSE v END"
    value = bind(unquoted, "plain", decode_sql("plain", in_attribute=True))
    named = (
        f"named_struct('names', transform(regexp_extract_all(head, {pattern}, 1), n -> {lower_sql('n')}),"
        f" 'vals', transform(regexp_extract_all(head, {pattern}, 2), v -> {value}))"
    )
    rest = "greatest(size(cut.names) - 1, 0)"
    attributes = f"named_struct('k', slice(cut.names, 2, {rest}), 'v', slice(cut.vals, 2, {rest}))"
    firsts = (
        "map_from_entries(transform(filter(transform(a.k, (k, at) -> named_struct('k', k, 'v', get(a.v, at), 'at', at + 1)),"
        " e -> array_position(a.k, e.k) = e.at), e -> struct(e.k, e.v)))"
    )
    attrs = fold({"size(array_distinct(a.k)) = size(a.k)": "map_from_arrays(a.k, a.v)"}, firsts)
    attrs = bind(attributes, "a", attrs, "MAP<STRING,STRING>")
    tag = f"named_struct('pos', pos, 'name', get(cut.names, 0), 'attrs', {attrs})"
    head = f"CASE WHEN token RLIKE {quote(_IS_TITLE)} THEN 'title' ELSE token END"
    return f"(token, pos) -> {bind(head, 'head', bind(named, 'cut', tag, _TAG), _TAG)}"


def parse_tags(tokens: Column) -> Column:
    """Tokens to ``array<struct<pos,name,attrs>>``; titles keep their place but carry no attributes."""
    return map_array(tokens, _parse_tag())


def tag_tokens(html: Column) -> Column:
    """Every start tag outside comments, scripts, styles and text areas."""
    return parse_tags(raw_tokens(html))


def title_from_tokens(tokens: Column) -> Column:
    """Text of the first title element."""
    first = F.get(F.filter(tokens, lambda token: token.rlike(_IS_TITLE)), F.lit(0))
    inner = F.regexp_extract(first, r"(?is)\Atitle(?:[\s/][^>]*)?>(.*?)(?:</title[\s/>]|</title\z|\z)", 1)
    return F.coalesce(js_trim(decode_entities(inner)), F.lit(""))


def title(html: Column) -> Column:
    return title_from_tokens(raw_tokens(html, ("title",)))


def _strip_markup(text: Column) -> Column:
    return F.regexp_replace(text, "(?is)<(?:" + "|".join([_COMMENT, _ANY_TAG, _MARKUP, _UNCLOSED_TAG]) + ")", "")


def h1_text(html: Column) -> Column:
    """Text of the first heading, nested tags removed."""
    inner = F.regexp_extract(without_templates(html), _FIRST_H1, 1)
    return F.coalesce(js_trim(decode_entities(_strip_markup(inner))), F.lit(""))


def h1_count(tokens: Column) -> Column:
    return apply("t", "size(filter(t.tokens, token -> token RLIKE '(?i)^h1[ \\\\t\\\\n\\\\f\\\\r/>]'))", "int", tokens=tokens)


@cache
def _attribute_of(token: str, name: str) -> str:
    """SQL for one attribute of a token: skips the attributes before it and stops at the first of that name."""
    gap, assign = r"[\s/]*+", r"\s*+=\s*+"
    others = rf"(?:{gap}(?!{name}[\s=/>]){_NAME}(?:{assign}(?:{_VALUE})?+)?+)*+"
    found = f"regexp_extract({token}, {quote(rf'(?is)^[^\s/>]++{others}{gap}{name}{assign}({_VALUE})')}, 1)"
    unquoted = """CASE WHEN left(v, 1) IN ('"', '\\'') THEN substring(v, 2, length(v) - 2) ELSE v END"""
    return bind(found, "v", bind(unquoted, "plain", decode_sql("plain", in_attribute=True)))


def _of_kind(kind: str) -> str:
    return f"filter(t.tokens, token -> token RLIKE {quote(rf'(?i)^{kind}[\s/>]')})"


@cache
def _summary_sql() -> str:
    named = ", ".join(f"'{name}', {_attribute_of('token', name)}" for name in ("name", "property", "content"))
    metas = f"transform({_of_kind('meta')}, token -> named_struct({named}))"
    is_canonical = f"lower({_attribute_of('token', 'rel')}) = 'canonical'"
    canonical = f"get(filter({_of_kind('link')}, token -> {is_canonical}), 0)"
    href = bind(canonical, "token", f"CASE WHEN token IS NULL THEN '' ELSE {_attribute_of('token', 'href')} END")
    links = f"filter(transform({_of_kind('a')}, token -> {_attribute_of('token', 'href')}), href -> href <> '')"
    return f"named_struct('metas', {metas}, 'canonical', {href}, 'hrefs', {links})"


def page_tags(tokens: Column) -> Column:
    """What the record needs of its tags: ``struct<metas:array<struct<name,property,content>>,canonical,hrefs>``.

    Reads single attributes out of the token text, which is much cheaper than :func:`parse_tags` on every tag.
    """
    return apply("t", _summary_sql(), _PAGE_TAGS, tokens=tokens)


def _first_content(metas: Column, field: str, value: str) -> Column:
    first = f"get(filter(t.metas, meta -> meta.{field} = {quote(value)}), 0).content"
    return apply("t", f"coalesce({first}, '')", metas=metas)


def meta_name(metas: Column, value: str) -> Column:
    """Content of the first ``meta`` whose name is exactly ``value``."""
    return _first_content(metas, "name", value)


def meta_property(metas: Column, value: str) -> Column:
    return _first_content(metas, "property", value)


def visible_text(html: Column) -> Column:
    """Text of the body without scripts, styles and noscript, blanks collapsed."""
    removed = "(?is)<(?:" + "|".join([_COMMENT, _SCRIPT, _STYLE, _NOSCRIPT]) + ")"
    has_body = r"(?is)<body[\s/>]"
    body = r"(?is)<body(?:[\s/]" + _TAG_REST + r"|>)(.*)\z"
    head = "(?is)<(?:" + _raw_element("head") + "|" + _TITLE + ")"

    def text(clean: Column) -> Column:
        content = F.when(clean.rlike(has_body), F.regexp_extract(clean, body, 1)).otherwise(
            F.regexp_replace(clean, head, "")
        )
        return js_trim(js_collapse(decode_entities(_strip_markup(content))))

    return F.coalesce(let(F.regexp_replace(without_templates(html), removed, ""), text), F.lit(""))
