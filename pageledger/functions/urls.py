"""URL parsing and resolution as the web platform does it, as Column expressions.

``parse_url`` and friends of Spark keep the case of hosts and reject addresses a browser accepts, so the split is
done here.  A parsed URL is ``struct<scheme,userinfo,host,port,path,query>``; NULL stands for an invalid one.

Hosts are in the one form of ``functions/hosts.py``.  Known limit: ``file:`` is treated like any scheme without a host.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageledger import fixed_values as fixed
from pageledger.functions.hosts import canonical_sql, usual_sql
from pageledger.functions.sqltext import apply, bind, fold, lower_sql, only, quote

PARSED_TYPE = "struct<scheme:string,userinfo:string,host:string,port:string,path:string,query:string>"

# Fixed values of the URL standard: schemes with a host, and their default ports.
_SPECIAL_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}

_CONTROL_OR_BLANK = "".join(map(chr, range(0x21)))
_AUTHORITY = r"^(\[[0-9A-Fa-f:.]+\]|[^:\[\]]*)(?::([0-9]*))?$"
_BAD_HOST = r"[\x00-\x20#/:<>?@\[\\\]^|%\x7F]"
_DOT = r"^(?:\.|%2[eE])$"
_DOT_DOT = r"^(?:\.|%2[eE]){2}$"
_LAST_DOTS = r"^(?:\.|%2[eE]){1,2}$"
_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_HAS_DOTS = r"(?:^|/)(?:\.|%2[eE]){1,2}(?:/|$)"

# A host in plain form: lower case, no user, no port, not an address of numbers.
_PLAIN_HOST = r"^https?://([a-z0-9][a-z0-9.-]*+(?<=\.[a-z]{2,9}))(?=[/?#]|$)"

# Characters that stay as they are; everything else is percent-encoded.
_PATH_SAFE = r"!\x24-;=@-\]_a-z|~"
_QUERY_SAFE = r"!\x24-&\x28-;=?-~"
_USER_SAFE = r"!\x24-.0-:A-Z_a-z~"
_LINK_SAFE = r"!-~"
_OPAQUE_SAFE = r"\x20-~"


def _percent_encode(text: str, safe: str) -> str:
    """SQL that writes every character outside ``safe`` as percent-encoded UTF-8; ``text`` is a plain name."""
    run = fold({f"run RLIKE {quote(f'^[{safe}]')}": "run"}, "regexp_replace(hex(run), '(..)', '%$1')")
    runs = f"regexp_extract_all({text}, {quote(f'[{safe}]+|[^{safe}]+')}, 0)"
    return fold({f"{text} RLIKE {quote(f'[^{safe}]')}": f"array_join(transform({runs}, run -> {run}), '')"}, text)


def _remove_dots(path: str) -> str:
    """SQL that resolves ``.`` and ``..`` segments of an absolute path."""
    step = fold(
        {
            f"part RLIKE {quote(_DOT_DOT)}": "slice(done, 1, greatest(size(done) - 1, 0))",
            f"part RLIKE {quote(_DOT)}": "done",
        },
        "concat(done, array(part))",
    )
    kept = f"aggregate(segments, CAST(array() AS ARRAY<STRING>), (done, part) -> {step})"
    ends_in_dots = f"element_at(segments, -1) RLIKE {quote(_LAST_DOTS)}"
    walked = f"concat('/', array_join(CASE WHEN {ends_in_dots} THEN concat({kept}, array('')) ELSE {kept} END, '/'))"
    return fold({f"{path} RLIKE {quote(_HAS_DOTS)}": bind(f"split(substring({path}, 2), '/')", "segments", walked)}, path)


@cache
def _resolve_sql() -> str:
    """SQL over ``u.href`` and ``u.base``: each stage sees the fields of the one before."""
    special = "(" + ", ".join(f"'{scheme}'" for scheme in _SPECIAL_PORTS) + ")"
    authority = quote(_AUTHORITY)
    stripped = f"btrim(translate(u.href, '\\t\\n\\r', ''), {quote(_CONTROL_OR_BLANK)})"
    clean = f"substring_index(CASE WHEN u.href RLIKE '[\\\\x00-\\\\x20]' THEN {stripped} ELSE u.href END, '#', 1)"

    # cut off the scheme
    scan = f"""named_struct(
        'scheme', {lower_sql('head')},
        'rest', CASE WHEN head = '' THEN clean ELSE substring(clean, length(head) + 2) END)"""
    stage = "STRUCT<scheme:STRING,rest:STRING>"
    scan = bind(clean, "clean", bind(f"regexp_extract(clean, {quote(_SCHEME)}, 1)", "head", scan, stage), stage)

    # separate the query; backslashes count as slashes before it unless the scheme has no host
    divide = f"""named_struct(
        'scheme', s.scheme,
        'before', CASE WHEN s.scheme = '' OR s.scheme IN {special} THEN translate(path, '\\\\', '/') ELSE path END,
        'query', CASE WHEN contains(s.rest, '?') THEN substring(s.rest, length(path) + 2) END)"""
    divide = f"s -> {bind("substring_index(s.rest, '?', 1)", 'path', divide, 'STRUCT<scheme:STRING,before:STRING,query:STRING>')}"

    kind = fold(
        {
            "s.before IS NULL OR s.scheme = '' AND coalesce(u.base.host, '') = ''": "'invalid'",
            "s.scheme = '' AND NOT startswith(s.before, '//')": "'relative'",
            f"s.scheme IN {special} AND s.scheme <=> u.base.scheme AND NOT startswith(s.before, '//')": "'relative'",
            f"s.scheme = '' OR s.scheme IN {special}": "'host'",
            "startswith(s.before, '//')": "'foreign'",
        },
        "'opaque'",
    )
    # any number of slashes may precede a host
    body = fold({"kind = 'host'": "ltrim('/', s.before)", "kind = 'foreign'": "substring(s.before, 3)"}, "s.before")
    classify = f"""named_struct(
        'kind', kind,
        'scheme', CASE WHEN s.scheme = '' THEN u.base.scheme ELSE s.scheme END,
        'body', {body},
        'query', s.query)"""
    classify = f"s -> {bind(kind, 'kind', classify, 'STRUCT<kind:STRING,scheme:STRING,body:STRING,query:STRING>')}"

    # authority and path, still raw
    path = fold(
        {
            "s.kind IN ('host', 'foreign')": "substring(s.body, length(authority) + 1)",
            "s.kind = 'opaque' OR startswith(s.body, '/')": "s.body",
            "s.body = ''": "u.base.path",
        },
        "concat(regexp_extract(u.base.path, '(?s)^(.*/)', 1), s.body)",
    )
    locate = f"""named_struct(
        'kind', s.kind,
        'scheme', s.scheme,
        'userinfo', CASE WHEN contains(authority, '@')
            THEN substring(authority, 1, length(authority) - length(place) - 1) ELSE '' END,
        'place_ok', place RLIKE {authority},
        'host', regexp_extract(place, {authority}, 1),
        'port', regexp_extract(place, {authority}, 2),
        'path', {path},
        'query', CASE WHEN s.kind = 'relative' AND s.body = '' THEN coalesce(s.query, u.base.query) ELSE s.query END)"""
    stage = (
        "STRUCT<kind:STRING,scheme:STRING,userinfo:STRING,place_ok:BOOLEAN,host:STRING,port:STRING,path:STRING,query:STRING>"
    )
    locate = bind("substring_index(authority, '@', -1)", "place", locate, stage)
    authority_of = "CASE WHEN s.kind IN ('host', 'foreign') THEN substring_index(s.body, '/', 1) ELSE '' END"
    locate = f"s -> {bind(authority_of, 'authority', locate, stage)}"

    # decode and lower-case the host, drop the default port, encode path and query
    decoded = fold({"contains(s.host, '%')": "try_url_decode(replace(s.host, '+', '%2B'))"}, "s.host")
    host = fold({"s.kind = 'foreign'": "s.host"}, bind(usual_sql(f"({decoded})"), "name", canonical_sql("name")))
    defaults = " OR ".join(f"(s.scheme = '{scheme}' AND digits = '{port}')" for scheme, port in _SPECIAL_PORTS.items())
    port = fold({"s.port = ''": "''", "digits = ''": "'0'", defaults: "''"}, "digits")
    rooted = "CASE WHEN startswith(s.path, '/') OR (s.kind = 'foreign' AND s.path = '') THEN s.path ELSE concat('/', s.path) END"
    straight = bind(_remove_dots("rooted"), "straight", _percent_encode("straight", _PATH_SAFE))
    path = fold({"s.kind = 'opaque'": _percent_encode("s.path", _OPAQUE_SAFE)}, bind(rooted, "rooted", straight))
    user = _percent_encode("s.userinfo", _USER_SAFE)
    tidy = f"""s -> named_struct(
        'kind', s.kind,
        'scheme', s.scheme,
        'userinfo', regexp_replace({user}, ':$', ''),
        'place_ok', s.place_ok,
        'host', {host},
        'port', {bind("ltrim('0', s.port)", 'digits', port)},
        'path', {path},
        'query', {_percent_encode('s.query', _QUERY_SAFE)})"""

    host_ok = f"""s.place_ok AND coalesce(s.host, '') <> '' AND (s.port = '' OR length(s.port) <= 5 AND CAST(s.port AS INT) <= 65535)
        AND (startswith(s.host, '[') OR NOT s.host RLIKE {quote(_BAD_HOST)})"""

    def record(userinfo: str, host: str, port: str) -> str:
        return (
            f"named_struct('scheme', s.scheme, 'userinfo', {userinfo}, 'host', {host}, 'port', {port},"
            " 'path', s.path, 'query', s.query)"
        )

    check = "s -> " + fold(
        {
            f"s.kind IN ('host', 'foreign') AND {host_ok}": record("s.userinfo", "s.host", "s.port"),
            "s.kind = 'relative'": record("u.base.userinfo", "u.base.host", "u.base.port"),
            "s.kind = 'opaque'": record("''", "''", "''"),
        },
        "NULL",
    )
    stages = f"array({scan})"
    for stage in (divide, classify, locate, tidy, check):
        stages = f"transform({stages}, {stage})"
    return only(stages, PARSED_TYPE)


def resolve(href: Column, base: Column | None = None) -> Column:
    """Parse ``href``, relative to the parsed URL ``base`` when one is given.  The fragment is dropped."""
    if base is None:
        base = F.lit(None).cast(PARSED_TYPE)
    return apply("u", _resolve_sql(), PARSED_TYPE, href=href, base=base)


@cache
def _href_sql(parsed: str) -> str:
    """SQL that writes a parsed URL back as text."""
    user = f"CASE WHEN {parsed}.userinfo = '' THEN '' ELSE concat({parsed}.userinfo, '@') END"
    port = f"CASE WHEN {parsed}.port = '' THEN '' ELSE concat(':', {parsed}.port) END"
    place = f"CASE WHEN {parsed}.host = '' THEN '' ELSE concat('//', {user}, {parsed}.host, {port}) END"
    query = f"CASE WHEN {parsed}.query IS NULL THEN '' ELSE concat('?', {parsed}.query) END"
    return f"concat({parsed}.scheme, ':', {place}, {parsed}.path, {query})"


_DROP_SLASH = "CASE WHEN endswith(text, '/') THEN substring(text, 1, length(text) - 1) ELSE text END"


def href(parsed: Column) -> Column:
    return apply("w", _href_sql("w.url"), url=parsed)


def normalize_url(link: Column, base: Column) -> Column:
    """Resolve ``link`` against the URL ``base``, without fragment and without one trailing slash."""
    parsed = resolve(link, resolve(base))
    return apply("w", bind(_href_sql("w.url"), "text", _DROP_SLASH), url=parsed)


def hostname(url: Column) -> Column:
    """Lower-case host without port; NULL for an invalid URL.  Addresses in plain form skip the full parse."""
    plain = F.regexp_extract(url, _PLAIN_HOST, 1)
    return F.when(plain != "", plain).otherwise(resolve(url)["host"])


def is_same_domain(url: Column, host: Column) -> Column:
    return F.coalesce(hostname(url) == host, F.lit(False))


def site_key(url: Column) -> Column:
    return F.coalesce(F.regexp_replace(hostname(url), "[^a-zA-Z0-9.-]", "_"), F.lit(fixed.SITE_KEY_FALLBACK))


def with_scheme(url: Column) -> Column:
    has_scheme = F.startswith(url, F.lit("http://")) | F.startswith(url, F.lit("https://"))
    return F.when(has_scheme, url).otherwise(F.concat(F.lit("https://"), url))


def default_sitemap(url: Column) -> Column:
    """The usual sitemap address; a port is not carried over."""
    return apply("w", "concat(w.url.scheme, '://', w.url.host, '/sitemap.xml')", url=resolve(url))


def robots_url(url: Column) -> Column:
    return href(resolve(F.lit("/robots.txt"), resolve(url)))


def pathname(url: Column) -> Column:
    return resolve(url)["path"]


# Links in plain form, which need no resolving: from the root of the host, and absolute with a bare host.
_PLAIN_SEGMENT = r"[!\x24&(-\-0-;=@-Z_a-z~\x{80}-\x{10FFFF}][!\x24-&(-.0-;=@-Z_a-z~\x{80}-\x{10FFFF}]*+"
_PLAIN_PATH = f"(?:/{_PLAIN_SEGMENT})*+/?"
_PLAIN_QUERY = r"(?:\?[!\x24-&\x28-;=?-~]*+)?"
_ROOTED_LINK = f"^(?=/){_PLAIN_PATH}{_PLAIN_QUERY}$"
_ABSOLUTE_LINK = rf"^https?://([a-z0-9][a-z0-9.-]*+(?<=\.[a-z]{{2,9}}))(?=[/?]|$){_PLAIN_PATH}$"
_PLAIN_ORIGIN = _PLAIN_HOST.replace("https?://(", "(https?://")


_NESTED_LINK = rf"^(?![^/?]*:){_PLAIN_SEGMENT}{_PLAIN_PATH}{_PLAIN_QUERY}$"
_PLAIN_PAGE = rf"{_PLAIN_HOST.removesuffix('(?=[/?#]|$)')}{_PLAIN_PATH}(?:[?#].*)?$"
_PLAIN_SELF = rf"{_PLAIN_HOST.removesuffix('(?=[/?#]|$)')}(?=/){_PLAIN_PATH}{_PLAIN_QUERY}$"
_HERE_LINK = rf"^\./{_PLAIN_SEGMENT}{_PLAIN_PATH}{_PLAIN_QUERY}$"
_PARENT_LINK = rf"^\.\./{_PLAIN_SEGMENT}{_PLAIN_PATH}{_PLAIN_QUERY}$"
_DIRECTORY = r"^(https?://[^/]+/(?:.*/)?)"


@cache
def _page_links_sql() -> str:
    """Plain links take a short way; the rest is resolved in full, and only then is the page's own URL parsed."""
    encoded = _percent_encode("h", _LINK_SAFE)
    own_host = "substring_index(origin, '/', -1)"
    rooted = f"named_struct('host', {own_host}, 'url', concat(origin, {encoded}))"
    nested = f"named_struct('host', {own_host}, 'url', concat(directory, {encoded}))"
    here = f"named_struct('host', {own_host}, 'url', concat(directory, {bind('substring(h, 3)', 'h', encoded)}))"
    parent = f"CASE WHEN directory = concat(origin, '/') THEN directory ELSE regexp_replace(directory, '[^/]+/$', '') END"
    above = f"named_struct('host', {own_host}, 'url', concat({parent}, {bind('substring(h, 4)', 'h', encoded)}))"
    itself = f"named_struct('host', {own_host}, 'url', self)"
    absolute = f"named_struct('host', regexp_extract(h, {quote(_ABSOLUTE_LINK)}, 1), 'url', {encoded})"
    resolved = bind("named_struct('href', h, 'base', page)", "u", _resolve_sql(), PARSED_TYPE)
    general = bind(resolved, "p", f"named_struct('host', p.host, 'url', {_href_sql('p')})", "STRUCT<host:STRING,url:STRING>")
    conditions = {
        f"origin <> '' AND h RLIKE {quote(_ROOTED_LINK)}": rooted,
        f"h RLIKE {quote(_ABSOLUTE_LINK)}": absolute,
        "self <> '' AND startswith(h, '#')": itself,
        f"directory <> '' AND h RLIKE {quote(_NESTED_LINK)}": nested,
        f"directory <> '' AND h RLIKE {quote(_PARENT_LINK)}": above,
        f"directory <> '' AND h RLIKE {quote(_HERE_LINK)}": here,
    }
    one = fold(conditions, general)
    kept = f"filter(transform(w.hrefs, h -> {one}), link -> link.host <=> w.host AND NOT contains(link.url, 'mailto:'))"
    links = f"transform({kept}, link -> {bind('link.url', 'text', _DROP_SLASH)})"
    parsed = bind("named_struct('href', w.url, 'base', CAST(NULL AS " + PARSED_TYPE + "))", "u", _resolve_sql(), PARSED_TYPE)
    page = f"CASE WHEN exists(w.hrefs, h -> NOT ({' OR '.join(f'({c})' for c in conditions)})) THEN {parsed} END"
    path = "substring_index(substring_index(w.url, '#', 1), '?', 1)"
    slashed = f"CASE WHEN {path} = origin THEN concat(origin, '/') ELSE {path} END"
    directory = _percent_encode("folder", _LINK_SAFE)
    directory = bind(f"regexp_extract({slashed}, {quote(_DIRECTORY)}, 1)", "folder", directory)
    directory = f"CASE WHEN w.url RLIKE {quote(_PLAIN_PAGE)} THEN {directory} ELSE '' END"
    bare = bind("substring_index(w.url, '#', 1)", "bare", fold({f"bare RLIKE {quote(_PLAIN_SELF)}": _percent_encode("bare", _LINK_SAFE)}, "''"))
    whole = links
    for name, value in (
        ("page", page),
        ("self", bare),
        ("directory", directory),
        ("origin", f"regexp_extract(w.url, {quote(_PLAIN_ORIGIN)}, 1)"),
    ):
        whole = bind(value, name, whole, "ARRAY<STRING>")
    return whole


def page_links(page_hrefs: Column, page_url: Column, host: Column) -> Column:
    """Same-host links of a page, normalised, in page order; duplicates and self-links stay."""
    return apply("w", _page_links_sql(), "array<string>", hrefs=page_hrefs, url=page_url, host=host)
