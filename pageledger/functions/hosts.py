"""Host names in the one form that addresses of the same host share, as SQL text.

* Labels beyond ASCII are written in punycode, by the bootstring algorithm as a fold over code points: the places of a label are walked
  once for each of its distinct characters beyond ASCII, in rising order.
* A host whose last label is a number is an IPv4 address of one to four parts, decimal, octal or hexadecimal, the last of which
  fills the bytes that are left.  What is no such address is no host.
* IPv6 addresses are eight groups without leading zeros, the longest run of zero groups, the first of equals, written ``::``.

Names are lower-cased, full-width characters and ideographic full stops become the usual ones, and invisible characters that never
count are dropped; other compatibility forms and composition are left as they are.  Labels that are punycode already are taken as they are.
A label beyond ASCII that is longer than the name system allows makes no host.

The analyzer resolves one level of nested lambdas after the other, so expressions are written with few of them.
"""

from __future__ import annotations

from pageledger.functions.sqltext import bind, fold, quote

# Fixed values of the bootstring parameters for host names.
_BASE, _T_MIN, _T_MAX, _SKEW, _DAMP, _BIAS, _FIRST = 36, 1, 26, 38, 700, 72, 128
#: Characters of a label in the domain name system.
LONGEST_LABEL = 63

_FULL_WIDTH = "".join(map(chr, range(0xFF01, 0xFF5F)))
_HALF_WIDTH = "".join(chr(at - 0xFEE0) for at in range(0xFF01, 0xFF5F))
_FULL_STOPS = "\u3002\uff61"
_NEVER_COUNT = "\u00ad\u200b\u2060\ufeff"

_BEYOND_ASCII = quote(r"[^\x00-\x7F]")
#: Stands for a label that is none; no host may hold it.
_NO_LABEL = "' '"
_ZERO = "CAST(0 AS BIGINT)"


def usual_sql(host: str) -> str:
    """SQL for a host in lower case and usual characters."""
    plain = f"translate(lower({host}), {quote(_FULL_WIDTH + _FULL_STOPS + _NEVER_COUNT)}, {quote(_HALF_WIDTH + '..')})"
    return fold({f"{host} RLIKE '[^a-z0-9.:_-]'": f"lower({plain})"}, host)


def _adapted(delta: str, points: str, first: str) -> str:
    """SQL for the bias after a number: at most seven divisions bring a delta below the bound."""
    bound = ((_BASE - _T_MIN) * _T_MAX) // 2
    halved = f"({delta} div CASE WHEN {first} THEN {_DAMP} ELSE 2 END)"
    step = f"CASE WHEN s.d > {bound} THEN named_struct('d', s.d div {_BASE - _T_MIN}, 'k', s.k + {_BASE}) ELSE s END"
    end = f"s -> s.k + ({_BASE - _T_MIN + 1} * s.d) div (s.d + {_SKEW})"
    return f"aggregate(sequence(1, 7), named_struct('d', {halved} + {halved} div {points}, 'k', {_ZERO}), (s, _) -> {step}, {end})"


def _number(delta: str, bias: str) -> str:
    """SQL for a delta as a number of variable length; at most thirteen digits hold any that a label can have."""
    t = f"CAST(greatest({_T_MIN}, least({_T_MAX}, {_BASE} * place - {bias})) AS BIGINT)"
    digit = "substring('abcdefghijklmnopqrstuvwxyz0123456789', CAST({} + 1 AS INT), 1)"
    last = f"named_struct('q', CAST(-1 AS BIGINT), 'out', concat(u.out, {digit.format('u.q')}))"
    more = f"named_struct('q', (u.q - {t}) div ({_BASE} - {t}), 'out', concat(u.out, {digit.format(f'{t} + (u.q - {t}) % ({_BASE} - {t})')}))"
    step = f"CASE WHEN u.q < 0 THEN u WHEN u.q < {t} THEN {last} ELSE {more} END"
    return f"aggregate(sequence(1, 13), named_struct('q', {delta}, 'out', ''), (u, place) -> {step}, u -> u.out)"


def punycode_sql(label: str) -> str:
    """SQL for one label beyond ASCII in its ``xn--`` form; ``label`` is a plain name.  Too long a label becomes a blank."""

    def made(n: str, delta: str, bias: str, h: str, first: str, out: str) -> str:
        return f"named_struct('n', {n}, 'delta', {delta}, 'bias', {bias}, 'h', {h}, 'first', {first}, 'out', {out})"

    written = made("s.n", _ZERO, _adapted("s.delta", "(s.h + 1)", "s.first"), "s.h + 1", "false", f"concat(s.out, {_number('s.delta', 's.bias')})")
    walk = fold({"c < s.n": made("s.n", "s.delta + 1", "s.bias", "s.h", "s.first", "s.out"), "c = s.n": written}, "s")
    reached = made("m", "w.delta + (m - w.n) * (w.h + 1)", "w.bias", "w.h", "w.first", "w.out")
    around = f"aggregate(points, {reached}, (s, c) -> {walk}, s -> {made('s.n + 1', 's.delta + 1', 's.bias', 's.h', 's.first', 's.out')})"
    plain = f"regexp_replace({label}, {_BEYOND_ASCII}, '')"
    basic = f"CAST(length({plain}) AS BIGINT)"
    start = made(f"CAST({_FIRST} AS BIGINT)", _ZERO, f"CAST({_BIAS} AS BIGINT)", basic, "true", f"CASE WHEN {basic} > 0 THEN concat({plain}, '-') ELSE '' END")
    distinct = f"array_sort(array_distinct(filter(points, c -> c >= {_FIRST})))"
    name = f"w -> CASE WHEN length(w.out) <= {LONGEST_LABEL - 4} THEN concat('xn--', w.out) ELSE {_NO_LABEL} END"
    points = f"transform(regexp_extract_all({label}, '(?s).', 0), c -> CAST(ascii(c) AS BIGINT))"
    whole = bind(points, "points", f"aggregate({distinct}, {start}, (w, m) -> {around}, {name})")
    return fold({f"length({label}) <= {LONGEST_LABEL}": whole}, _NO_LABEL)


def _ascii_sql(host: str) -> str:
    label = fold({f"l RLIKE {_BEYOND_ASCII}": punycode_sql("l")}, "l")
    return f"array_join(transform(split({host}, '[.]', -1), l -> {label}), '.')"


_NUMBER = r"^(?:[0-9]+|0[xX][0-9A-Fa-f]*)$"
_OCTAL = r"^0[0-7]+$"
_ENDS_IN_NUMBER = r"(?:^|\.)(?:[0-9]+|0[xX][0-9A-Fa-f]*)\.?$"


def _part_sql(part: str) -> str:
    """SQL for the value of one part of an IPv4 address, NULL if it is none or too large for any."""
    digits = f"ltrim('0', regexp_replace({part}, '^0[xX]', ''))"
    radix = fold({f"{part} RLIKE '^0[xX]'": "16", f"{part} RLIKE {quote(_OCTAL)}": "8"}, "10")
    none = f"NOT {part} RLIKE {quote(_NUMBER)} OR {part} RLIKE '^0[0-9]*[89]' OR length({digits}) > 11"
    return fold({none: "CAST(NULL AS BIGINT)", f"{digits} = ''": _ZERO}, f"CAST(conv({digits}, {radix}, 10) AS BIGINT)")


def _ipv4_sql(host: str) -> str:
    """SQL for an IPv4 address in four decimal parts; NULL if the host is none."""
    parts = f"transform(split(regexp_replace({host}, '[.]$', ''), '[.]', -1), part -> {_part_sql('part')})"
    fine = "size(v) <= 4 AND forall(v, x -> x IS NOT NULL) AND forall(slice(v, 1, size(v) - 1), x -> x <= 255)"
    fine += " AND element_at(v, -1) < shiftleft(CAST(1 AS BIGINT), 8 * (5 - size(v)))"
    first = [f"CASE WHEN size(v) > {at + 1} THEN get(v, {at}) * {1 << 8 * (3 - at)} ELSE 0 END" for at in range(3)]
    total = f"(element_at(v, -1) + {' + '.join(first)})"
    quads = "concat_ws('.', " + ", ".join(f"shiftright({total}, {shift}) & 255" for shift in (24, 16, 8, 0)) + ")"
    return bind(parts, "v", fold({fine: quads}, "CAST(NULL AS STRING)"))


_QUAD = r"^(.*:)((?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3})$"


def _ipv6_sql(host: str) -> str:
    """SQL for an IPv6 address with its brackets in shortest form; NULL if the host is none."""
    inner = f"substring({host}, 2, length({host}) - 2)"
    numbers = f"split(regexp_extract({inner}, {quote(_QUAD)}, 2), '[.]')"
    pairs = [f"hex(256 * CAST(get({numbers}, {at}) AS INT) + CAST(get({numbers}, {at + 1}) AS INT))" for at in (0, 2)]
    # a tail of four decimal numbers is two groups
    whole = fold({f"{inner} RLIKE {quote(_QUAD)}": f"concat(regexp_extract({inner}, {quote(_QUAD)}, 1), {pairs[0]}, ':', {pairs[1]})"}, inner)
    bare = f"CASE WHEN NOT {inner} RLIKE '[0-9A-Fa-f]{{5}}|:::|::.*::' THEN regexp_replace(lower({whole}), '(^|:)0+(?=[0-9a-f])', '$1') ELSE '' END"
    left = "substring_index(bare, '::', 1)"
    right = f"substring(bare, length({left}) + 3)"

    def groups(text: str) -> str:
        return f"CASE WHEN {text} = '' THEN 0 ELSE size(split({text}, ':', -1)) END"

    zeros = f"8 - ({groups(left)}) - ({groups(right)})"
    joined = f"concat_ws(':', nullif({left}, ''), array_repeat('0', {zeros}), nullif({right}, ''))"
    filled = fold({"NOT contains(bare, '::')": "concat(':', bare, ':')", f"{zeros} > 0": f"concat(':', {joined}, ':')"}, "''")
    # the longest run of zero groups, the first of equals
    cuts = {}
    for size in range(8, 1, -1):
        run = ":" + "0:" * size
        before = f"substring_index(full, '{run}', 1)"
        cuts[f"contains(full, '{run}')"] = f"concat('[', substring({before}, 2), '::', rtrim(':', substring(full, length({before}) + {len(run) + 1})), ']')"
    written = fold(cuts, "concat('[', btrim(full, ':'), ']')")
    checked = fold({"full RLIKE '^:([0-9a-f]{1,4}:){8}$'": written}, "CAST(NULL AS STRING)")
    return bind(bare, "bare", bind(filled, "full", checked))


def canonical_sql(host: str) -> str:
    """SQL for a host of a web address in its one form; NULL for none.  ``host`` is a plain name of a host in usual characters."""
    return fold(
        {
            f"startswith({host}, '[')": _ipv6_sql(host),
            f"{host} RLIKE {quote(_ENDS_IN_NUMBER)}": _ipv4_sql(host),
            f"{host} RLIKE {_BEYOND_ASCII}": _ascii_sql(host),
        },
        host,
    )
