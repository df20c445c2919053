"""HTML character references decoded by Column expressions.

The names come from the standard library's HTML5 table, so nothing is transcribed here.  They are looked up in
a literal map keyed by first letter, which Catalyst folds once per plan.
"""

from __future__ import annotations

import json
from functools import cache
from html.entities import html5

from pyspark.sql import Column

from pageledger.functions.sqltext import apply, bind, fold, quote

_REFERENCE = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)"
_REPLACEMENT = "'�'"

# Fixed values of the HTML standard: code points 0x80-0x9F that stand for windows-1252 characters.
_C1_REMAP = {
    0x80: 0x20AC, 0x82: 0x201A, 0x83: 0x0192, 0x84: 0x201E, 0x85: 0x2026, 0x86: 0x2020, 0x87: 0x2021,
    0x88: 0x02C6, 0x89: 0x2030, 0x8A: 0x0160, 0x8B: 0x2039, 0x8C: 0x0152, 0x8E: 0x017D, 0x91: 0x2018,
    0x92: 0x2019, 0x93: 0x201C, 0x94: 0x201D, 0x95: 0x2022, 0x96: 0x2013, 0x97: 0x2014, 0x98: 0x02DC,
    0x99: 0x2122, 0x9A: 0x0161, 0x9B: 0x203A, 0x9C: 0x0153, 0x9E: 0x017E, 0x9F: 0x0178,
}


@cache
def _names() -> str:
    grouped: dict[str, dict[str, str]] = {}
    for name, text in html5.items():
        grouped.setdefault(name[0], {})[name] = text
    return f"from_json({quote(json.dumps(grouped, ensure_ascii=False))}, 'map<string,map<string,string>>')"


@cache
def _bare_pattern() -> str:
    bare = sorted((name for name in html5 if not name.endswith(";")), key=len, reverse=True)
    return "^(" + "|".join(bare) + ")"


def _lookup(name: str) -> str:
    return f"try_element_at(try_element_at({_names()}, left({name}, 1)), {name})"


def _rest(part: str, taken: str) -> str:
    return f"substring({part}, length({taken}) + 1)"


def _numeric(reference: str) -> str:
    remap = ", ".join(f"{low}, {high}" for low, high in _C1_REMAP.items())
    # more than nine digits can only be out of range once leading zeros are gone
    digits = rf"ltrim('0', regexp_extract({reference}, '^#[xX]?([0-9a-fA-F]+)', 1))"
    value = fold(
        {
            "length(digits) > 9": "CAST(NULL AS BIGINT)",
            f"lower(substring({reference}, 2, 1)) = 'x'": "CAST(conv(concat('0', digits), 16, 10) AS BIGINT)",
        },
        "CAST(concat('0', digits) AS BIGINT)",
    )
    bad = "code IS NULL OR code = 0 OR code > 1114111 OR code BETWEEN 55296 AND 57343"
    point = f"coalesce(try_element_at(map({remap}), CAST(code AS INT)), CAST(code AS INT))"
    text = fold({bad: _REPLACEMENT}, f"decode(unhex(lpad(hex({point}), 8, '0')), 'UTF-32')")
    return bind(digits, "digits", bind(value, "code", text))


def _piece(in_attribute: bool) -> str:
    """``part`` is the text after one ampersand."""
    known = "bare <> ''"
    if in_attribute:
        known += f" AND NOT {_rest('part', 'bare')} RLIKE '^[=A-Za-z0-9]'"
    untouched = "concat('&', part)"
    bare = fold({known: f"concat({_lookup('bare')}, {_rest('part', 'bare')})"}, untouched)
    named = fold(
        {"full IS NOT NULL": f"concat(full, {_rest('part', 'ref')})"},
        bind(f"regexp_extract(ref, {quote(_bare_pattern())}, 1)", "bare", bare),
    )
    decoded = fold(
        {
            "ref = ''": untouched,
            "startswith(ref, '#')": f"concat({_numeric('ref')}, {_rest('part', 'ref')})",
        },
        bind(f"CASE WHEN endswith(ref, ';') THEN {_lookup('ref')} END", "full", named),
    )
    return bind(f"regexp_extract(part, {quote(_REFERENCE)}, 1)", "ref", decoded)


@cache
def decode_sql(text: str, in_attribute: bool = False) -> str:
    """SQL that decodes the references in ``text``, the name of a column or lambda variable."""
    tail = "slice(parts, 2, greatest(size(parts) - 1, 0))"
    joined = f"concat(get(parts, 0), array_join(transform({tail}, part -> {_piece(in_attribute)}), ''))"
    return fold({f"contains({text}, '&')": bind(f"split({text}, '&')", "parts", joined)}, text)


def decode_entities(text: Column, in_attribute: bool = False) -> Column:
    """Replace character references; texts without an ampersand pass untouched."""
    return apply("raw", decode_sql("raw.text", in_attribute), text=text)
