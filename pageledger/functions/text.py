"""Strings as a web page sees them: UTF-16 lengths, the wide whitespace class, number texts.

Every function maps Columns to a Column and stays on the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageledger import fixed_values as fixed

# Whitespace as ECMAScript defines it, once as characters (for trim) and once as a regex class.
WIDE_SPACES = (
    "\t\n\x0b\f\r \u00a0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# The same as a regex class, less the blank.  The look-ahead lets ordinary characters fail on one range test.
_RARE_SPACES = r"\t-\r\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WIDE_SPACE_CLASS = f"[ {_RARE_SPACES}]"
_WIDE_RUN = (
    rf"(?![!-\x9F\xA1-\x{{167F}}])(?:[{_RARE_SPACES}]{WIDE_SPACE_CLASS}*+| {WIDE_SPACE_CLASS}++)"
)


def let(value: Column, body: Callable[[Column], Column], kind: str = "string") -> Column:
    """Evaluate ``value`` once and hand it to ``body``, a result of type ``kind``, however often it is mentioned."""
    return F.aggregate(F.array(value), F.lit(None).cast(kind), lambda _, bound: body(bound))


def js_trim(text: Column) -> Column:
    """Strip wide whitespace from both ends; linear, unlike an anchored regex."""
    return F.btrim(text, F.lit(WIDE_SPACES))


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def js_collapse(text: Column) -> Column:
    """Turn every run of wide whitespace into one blank; runs that are one blank already are not touched."""
    return F.regexp_replace(text, _WIDE_RUN, " ")


def js_length(text: Column) -> Column:
    """Length in UTF-16 units."""
    wide = F.floor(F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")
    return F.when(_is_ascii(text), F.char_length(text)).otherwise(wide)


def js_prefix(text: Column, units: int) -> Column:
    """The first ``units`` UTF-16 units; half of a cut surrogate pair becomes U+FFFD."""

    def cut(head: Column) -> Column:
        encoded = F.encode(head, "UTF-16BE")
        half = F.hex(F.substring(encoded, 2 * units - 1, 1)).between("D8", "DB")
        whole = F.decode(F.substring(encoded, 1, 2 * units), "UTF-16BE")
        short = F.decode(F.substring(encoded, 1, 2 * units - 2), "UTF-16BE")
        return (
            F.when(_is_ascii(head) | (js_length(head) <= units), head)
            .when(half, F.concat(short, F.lit("\ufffd")))
            .otherwise(whole)
        )

    return let(F.substring(text, 1, units), cut)


def keywords_count(keywords: Column) -> Column:
    """Number of comma-separated parts, empty parts included; an empty text has none."""
    return F.when(keywords == "", 0).otherwise(F.size(F.split(keywords, ",")))


def escape_html(text: Column) -> Column:
    for raw, escaped in fixed.HTML_ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


_DECIMAL = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
_INFINITE = r"^[+-]?Infinity$"
_RADIX = ((r"^0[xX][0-9a-fA-F]+$", 16), (r"^0[oO][0-7]+$", 8), (r"^0[bB][01]+$", 2))


def _digits_value(digits: Column, radix: int) -> Column:
    """Digits of any number as a double."""

    def add(value: Column, digit: Column) -> Column:
        return value * float(radix) + (F.instr(F.lit("0123456789abcdef"), digit) - 1).cast("double")

    return F.aggregate(F.filter(F.split(F.lower(digits), ""), lambda digit: digit != ""), F.lit(0.0), add)


def js_number(cell: Column) -> Column:
    """A spreadsheet cell as a number; blank, unreadable and NaN cells are 0."""

    def convert(text: Column) -> Column:
        number = F.when(text.rlike(_DECIMAL), text.try_cast("double"))
        number = number.when(text.rlike(_INFINITE), F.replace(text, F.lit("+"), F.lit("")).try_cast("double"))
        for pattern, radix in _RADIX:
            number = number.when(text.rlike(pattern), _digits_value(F.substring(text, 3, 1 << 30), radix))
        return F.coalesce(number, F.lit(0.0))

    return let(js_trim(cell), convert, "double")


def js_number_text(number: Column) -> Column:
    """A double as scripts write it: 91.0 is '91', 1.5E-5 is '0.000015', 1.0E21 is '1e+21'."""

    def write(value: Column) -> Column:
        size = F.abs(value)
        whole = (size < 1e21) & (value % 1.0 == 0.0)
        text = value.cast("string")
        plain = F.rtrim(value.cast("string").try_cast("decimal(38,20)").cast("string"), F.lit("0"))
        return (
            F.when(whole, value.try_cast("decimal(38,0)").cast("string"))
            .when(text.contains("E") & (size >= 1e-6) & (size < 1e18), plain)
            .when(text.contains("E"), F.regexp_replace(F.regexp_replace(text, r"(?:\.0)?E", "e"), "e(?=[0-9])", "e+"))
            .otherwise(text)
        )

    return let(number.cast("double"), write)
