"""Personal data, and information-theoretic sanitisation of the terms around it.  DataFrame expressions only.

Base spans are e-mail addresses, IPv4 addresses, card numbers and telephone numbers, by pattern and check.  Each
recurring value is a protected entity.  Over the whole corpus, the words in a window around an entity are counted against all
words: with ``N`` windows in the corpus, ``n_e`` distinct windows of the entity, ``n_et`` of them with the term and ``n_t`` distinct
contexts of the term, the entity's information is ``log(N / n_e)`` and what the term gives away of it ``log(n_et N / (n_e n_t))``.
A term whose share reaches ``generalise`` is replaced by a label, one whose share reaches ``remove`` is taken out, wherever it stands
as a word in a document that names the entity.  A term needs ``support`` windows.  Terms are words of letters only, of ``TERM_LENGTH`` or
more, so names of two letters and terms with digits are not among them, and nothing next to an entity with a single window is.

Windows and contexts are counted once, so copies of a text change neither side of a share, and those of a passage little but ``N``.  A
context is a word with the words on either side of it.  For ``N`` every text is cut into stretches of as many words as a window has, the last one shorter; each
word of the corpus is in one, and all distinct ones are counted.  So a passage that many texts share counts as often as the ways
in which it is cut differ, which are no more than a window has words.

A context of the word in the middle of a stretch holds the whole stretch, so a term has at least as many contexts as distinct stretches
around it.  One whose share is too small by these alone is left out, as all frequent words are; the contexts of the others are then
counted in full.

Only documents with a base span can hold such terms; they are written to the shared folder, all others are never moved.  Counts
combine map-side, and contexts are dealt by term and hash, so no value or word is gathered in one task.

Defined cases: a null text is empty; rows that repeat a document get the same spans; null ids are kept; very long runs of digits
or letters are scanned once (groups repeat possessively); an empty table gives no rows; other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageledger.functions.text import let
from pageledger.llm.common import Scratch
from pageledger.session import filter_in_place

KINDS = ("email", "ip", "card", "phone")
#: ``\\G`` lets an address begin inside a run of address characters only where the one before it ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
WORD, NOT_WORD = r"[\p{L}\p{M}]++", r"[^\p{L}\p{M}]++"
#: Words and characters of a window on either side, and the least length of a term.
WINDOW_WORDS, WINDOW_CHARS, TERM_LENGTH = 8, 160, 3
GENERALISE, REMOVE, SUPPORT = 0.7, 0.9, 2
#: Code points of the chunks in which a text is looked at by position, as finding one counts all those before it.
CHUNK = 1_024
_SPAN = "array<struct<start:bigint,end:bigint,value:string>>"
_WINDOWS = "array<struct<entity:string,words:array<string>>>"
_PUT = "array<struct<start:bigint,end:bigint,kind:string,put:string>>"


def running(values: Column, step: Callable[[Column, Column], Column], first: Column, kind: str) -> Column:
    """For each element what ``step``, which has to be associative, makes of all elements before it, from ``first`` on.

    An array is copied for each element that is added to it, so the elements are taken in stretches of as many as there are
    stretches: ``n`` elements cost ``n ** 1.5`` copies, not ``n ** 2``.
    """
    none = F.array().cast(f"array<{kind}>")

    def scan(part: Column, start: Column) -> Column:
        state = F.struct(start.alias("total"), none.alias("found"))

        def add(state: Column, value: Column) -> Column:
            return F.struct(step(state["total"], value).alias("total"), F.array_append(state["found"], state["total"]).alias("found"))

        return F.aggregate(part, state, add, lambda state: state["found"])

    def of(held: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(held))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(held) - 1) / width).cast("int")), lambda at: F.slice(held, at * width + 1, width))

        def of_parts(parts: Column) -> Column:
            starts = scan(F.transform(parts, lambda part: F.aggregate(part, first, step)), first)
            return F.flatten(F.zip_with(parts, starts, scan))

        return F.when(F.size(held) > 0, let(parts, of_parts, f"array<{kind}>")).otherwise(none)

    return let(values, of, f"array<{kind}>")


def chunks(text: Column) -> Column:
    """The text in pieces of ``CHUNK`` code points, for ``taken``."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}+" % CHUNK), F.lit(0))


def taken(parts: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` of a text in chunks.  Only the chunks that hold them are looked at."""

    def of(at: Column) -> Column:
        first = F.greatest(start - at * CHUNK, F.lit(0).cast("bigint"))
        size = F.least(end - at * CHUNK, F.lit(CHUNK).cast("bigint")) - first
        return F.substr(F.get(parts, at.cast("int")), (first + 1).cast("int"), size.cast("int"))

    held = F.sequence(F.floor(start / CHUNK), F.floor((end - 1) / CHUNK))
    return F.when(end > start, F.array_join(F.transform(held, of), "")).otherwise(F.lit(""))


def located(text: Column, pattern: Column) -> Column:
    """The matches of a pattern with their code point positions."""

    def of(pairs: Column) -> Column:
        sizes = F.transform(pairs, lambda p: (F.length(p["gap"]) + F.length(p["value"])).cast("bigint"))
        starts = running(sizes, lambda total, size: total + size, F.lit(0).cast("bigint"), "bigint")

        def span(pair: Column, before: Column) -> Column:
            start = before + F.length(pair["gap"])
            return F.struct(start.alias("start"), (start + F.length(pair["value"])).alias("end"), pair["value"].alias("value"))

        return F.zip_with(pairs, starts, span)

    def with_gaps(values: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(values))
        return let(F.arrays_zip(gaps.alias("gap"), values.alias("value")), of, _SPAN)

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), with_gaps, _SPAN)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def step(total: Column, at: Column) -> Column:
        digit = F.ascii(F.substr(digits, F.length(digits) - at, F.lit(1))) - 48
        doubled = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(at % 2 == 1, doubled).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def _fine_ip(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda part: F.length(F.regexp_replace(part, "^0++(?=[0-9])", "")).between(1, 3) & (F.coalesce(part.try_cast("int"), F.lit(999)) <= 255))


def base_spans(text: Column) -> Column:
    """``array<struct<start, at, end, kind, value>>`` in the order start, kind."""
    none = F.array().cast(_SPAN)
    number = F.contains(text, F.lit(".")) & F.rlike(text, F.lit(r"[0-9]\.[0-9]"))
    found = {
        "email": F.when(F.contains(text, F.lit("@")), located(text, F.lit(EMAIL))).otherwise(none),
        "ip": F.when(number, F.filter(located(text, F.lit(IP)), lambda s: _fine_ip(s["value"]))).otherwise(none),
        "card": F.when(
            F.rlike(text, F.lit("[0-9](?:[ -]?[0-9]){13}")),
            F.filter(located(text, F.lit(CARD)), lambda s: F.length(_digits(s["value"])).between(14, 19) & _luhn(_digits(s["value"]))),
        ).otherwise(none),
        "phone": F.when(
            F.contains(text, F.lit("+")), F.filter(located(text, F.lit(PHONE)), lambda s: F.length(_digits(s["value"])).between(10, 15))
        ).otherwise(none),
    }

    def named(kind: str) -> Column:
        at = F.lit(KINDS.index(kind))
        return F.transform(found[kind], lambda s: F.struct(s["start"].alias("start"), at.alias("at"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value")))

    return F.array_sort(F.concat(*[named(kind) for kind in KINDS]))


def _entity(span: Column) -> Column:
    plain = F.when(span["kind"] == "email", F.lower(span["value"])).when(span["kind"] == "ip", span["value"]).otherwise(_digits(span["value"]))
    return F.concat(span["kind"], F.lit(":"), plain)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _window(parts: Column, size: Column, span: Column) -> Column:
    """The whole words next to a span of a text in chunks, at most ``WINDOW_WORDS`` on either side, in order."""
    left_from = F.greatest(span["start"] - WINDOW_CHARS, F.lit(0).cast("bigint"))
    right_to = F.least(span["end"] + WINDOW_CHARS, size)

    def nearest(left: Column) -> Column:
        return F.slice(left, F.greatest(F.size(left) - WINDOW_WORDS + 1, F.lit(1)), F.lit(WINDOW_WORDS))

    def before(left: Column) -> Column:
        return let(F.when(left_from > 0, F.slice(left, F.lit(2), F.greatest(F.size(left) - 1, F.lit(0)))).otherwise(left), nearest, "array<string>")

    def after(right: Column) -> Column:
        whole = F.when(size > span["end"] + WINDOW_CHARS, F.slice(right, F.lit(1), F.greatest(F.size(right) - 1, F.lit(0)))).otherwise(right)
        return F.slice(whole, F.lit(1), F.lit(WINDOW_WORDS))

    left = let(_words(taken(parts, left_from, span["start"])), before, "array<string>")
    right = let(_words(taken(parts, span["end"], right_to)), after, "array<string>")
    return F.concat(left, F.array(F.lit("|")), right)


def _windows(text: Column, spans: Column) -> Column:
    """The entity of each span and the words around it."""
    size = F.length(text).cast("bigint")

    def of(parts: Column) -> Column:
        return let(size, lambda n: F.transform(spans, lambda s: F.struct(_entity(s).alias("entity"), _window(parts, n, s).alias("words"))), _WINDOWS)

    return let(chunks(text), of, _WINDOWS)


def contexts(docs: DataFrame, stretch: int = 1) -> DataFrame:
    """``term, context`` of every use of a term; ``context`` is a hash of the words around it and itself.

    With ``stretch``, of at most ``2 * WINDOW_WORDS``, texts are cut into stretches of so many words and each is a row: ``context`` is a hash
    of all its words, ``term`` the word in its middle whatever its length, null in a last one that ends before.
    """
    words = F.filter(F.split(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), NOT_WORD, -1), lambda word: word != "")
    hashed = docs.select(words.alias("words")).select("words", F.transform("words", lambda word: F.xxhash64(word)).alias("hashes"))

    def use(word: Column, at: Column) -> Column:
        before = F.least(at, F.lit(WINDOW_WORDS))
        around = F.slice("hashes", at - before + 1, before + 1 + WINDOW_WORDS)
        return F.when(F.length(word) >= TERM_LENGTH, F.struct(word.alias("term"), F.xxhash64(before, around).alias("context")))

    def whole(first: Column) -> Column:
        return F.struct(F.get("words", first + stretch // 2).alias("term"), F.xxhash64(F.slice("hashes", first + 1, stretch)).alias("context"))

    if stretch > 1:
        found = F.when(F.size("words") > 0, F.transform(F.sequence(F.lit(0), F.size("words") - 1, F.lit(stretch)), whole))
    else:
        found = F.filter(F.transform("words", use), lambda one: one.isNotNull())
    uses = hashed.select(F.explode_outer(found).alias("use"))
    return uses.filter(F.col("use").isNotNull()).select("use.term", "use.context")


def disclosing_terms(named: DataFrame, docs: DataFrame, generalise: float = GENERALISE, support: int = SUPPORT) -> DataFrame:
    """``entity, term, share`` of the terms that reach the threshold; ``named`` holds ``text, spans``."""
    windows = named.select(F.explode(_windows(F.col("text"), F.col("spans"))).alias("window")).select("window.entity", "window.words").distinct()
    entities = windows.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    pairs = windows.select("entity", F.explode(F.array_distinct("words")).alias("term")).filter(F.length("term") >= TERM_LENGTH)
    pairs = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_et")).filter(F.col("n_et") >= support)
    scratch = Scratch(docs.sparkSession, "pii-terms")
    pairs = scratch.keep(pairs.join(entities, "entity"), "pairs")
    stretches = contexts(docs, 2 * WINDOW_WORDS).distinct()
    at_least = scratch.keep(stretches.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")), "at-least")
    windows_all = max(2.0, float(at_least.agg(F.sum("n_t")).first()[0] or 0))

    def told(counts: DataFrame, how: str) -> DataFrame:
        known = F.greatest(F.log(F.lit(windows_all) / F.col("n_e")), F.lit(1e-9))
        given = F.log(F.col("n_et") * F.lit(windows_all) / (F.col("n_e") * F.greatest("n_t", "n_et")))
        return pairs.join(counts, "term", how).withColumn("share", given / known).filter(F.col("share") >= generalise)

    likely = scratch.keep(told(at_least, "left").select("term").distinct(), "likely")
    counts = contexts(docs).join(likely, "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    return told(scratch.keep(counts, "counts"), "inner").select("entity", "term", "share")


def sanitise(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, support: int = SUPPORT) -> DataFrame:
    """The documents with ``spans array<struct<start, end, kind, put>>`` and ``sanitised``; ``put`` stands in the span's place.

    Columns of the input with these names are replaced.
    """
    docs = docs.drop("spans", "sanitised")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = docs.select("*", base_spans(text).alias("spans"))
    kept = [F.col(f"`{name}`") for name in docs.columns]
    none = F.array().cast(_PUT)
    clean = filter_in_place(plain, F.size("spans") == 0).select(*kept, none.alias("spans"), text.alias("sanitised"))
    scratch = Scratch(docs.sparkSession, "pii")
    named = scratch.keep(filter_in_place(plain, F.size("spans") > 0), "named")
    terms = disclosing_terms(named.select(text.alias("text"), "spans"), docs, generalise, support)
    by_row = named.select(F.col("doc_id").alias("__pii_id"), F.xxhash64("text").alias("__pii_hash"), F.explode(F.array_distinct(F.transform("spans", _entity))).alias("entity"))
    told = by_row.join(terms, "entity").groupBy("__pii_id", "__pii_hash", "term").agg(F.max("share").alias("share"))
    told = told.groupBy("__pii_id", "__pii_hash").agg(F.collect_list(F.struct("term", "share")).alias("__pii_terms"))
    joined = named.join(told, F.col("doc_id").eqNullSafe(F.col("__pii_id")) & (F.xxhash64("text") == F.col("__pii_hash")), "left")
    base = F.transform("spans", lambda s: _placed(s, s["kind"], F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
    more = F.when(F.col("__pii_terms").isNotNull(), _term_spans(text, F.col("__pii_terms"), F.col("spans"), remove)).otherwise(none)
    changed = joined.select(*kept, let(F.concat(base, more), _in_order, _PUT).alias("spans"))
    return clean.unionByName(changed.select("*", _written(text, F.col("spans")).alias("sanitised")))


def _placed(s: Column, kind: Column, put: Column) -> Column:
    return F.struct(s["start"].alias("start"), s["end"].alias("end"), kind.alias("kind"), put.alias("put"))


def _in_order(spans: Column) -> Column:
    """Spans by start, then kind as listed, terms last."""
    order = {**{kind: at for at, kind in enumerate(KINDS)}, "term": len(KINDS)}
    rank = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("at"), s.alias("span")))
    return F.transform(F.array_sort(keyed), lambda s: s["span"])


def _term_spans(text: Column, terms: Column, spans: Column, remove: float) -> Column:
    """Uses of ``terms`` as words of the text, outside of ``spans``.

    Words and terms are sorted together, so a word that is a term follows it; then words and spans are, so those before and after a word
    are known.  No word is held against all terms or spans.
    """
    told = "struct<term:string,share:double>"
    word_type = f"array<struct<key:string,at:int,start:bigint,end:bigint,told:{told}>>"
    item_type = "array<struct<start:bigint,at:int,end:bigint,put:string>>"
    least, most = F.lit(0).cast("bigint"), F.lit((1 << 62)).cast("bigint")

    def named(items: Column) -> Column:
        """The words that are terms, as ``start, at, end, put``."""
        before = running(F.transform(items, lambda i: i["told"]), lambda total, value: F.coalesce(value, total), F.lit(None).cast(told), told)
        pairs = F.filter(F.arrays_zip(items.alias("item"), before.alias("told")), lambda p: (p["item"]["at"] == 1) & (p["told"]["term"] == p["item"]["key"]))
        put = lambda p: F.when(p["told"]["share"] >= remove, "").otherwise("[TERM]")
        return F.transform(pairs, lambda p: F.struct(p["item"]["start"].alias("start"), F.lit(1).alias("at"), p["item"]["end"].alias("end"), put(p).alias("put")))

    def apart(items: Column) -> Column:
        """The terms among spans and terms in order that meet no span."""
        ends = running(F.transform(items, lambda i: F.when(i["at"] == 0, i["end"]).otherwise(least)), lambda a, b: F.greatest(a, b), least, "bigint")
        later = F.reverse(F.transform(items, lambda i: F.when(i["at"] == 0, i["start"]).otherwise(most)))
        starts = F.reverse(running(later, lambda a, b: F.least(a, b), most, "bigint"))
        zipped = F.arrays_zip(items.alias("item"), ends.alias("ends"), starts.alias("starts"))
        free = F.filter(zipped, lambda z: (z["item"]["at"] == 1) & (z["ends"] <= z["item"]["start"]) & (z["starts"] >= z["item"]["end"]))
        return F.transform(free, lambda z: _placed(z["item"], F.lit("term"), z["item"]["put"]))

    def with_spans(uses: Column) -> Column:
        held = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("at"), s["end"].alias("end"), F.lit("").alias("put")))
        return let(F.array_sort(F.concat(uses, held)), apart, _PUT)

    nowhere = F.lit(None).cast("bigint")
    keys = F.transform(terms, lambda t: F.struct(t["term"].alias("key"), F.lit(0).alias("at"), nowhere.alias("start"), nowhere.alias("end"), F.struct(t["term"].alias("term"), t["share"].alias("share")).alias("told")))
    words = F.transform(located(text, F.lit(WORD)), lambda w: F.struct(F.lower(w["value"]).alias("key"), F.lit(1).alias("at"), w["start"].alias("start"), w["end"].alias("end"), F.lit(None).cast(told).alias("told")))
    found = let(F.array_sort(F.concat(keys.cast(word_type), words.cast(word_type))), named, item_type)
    return let(found, with_spans, _PUT)


def _written(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by the first one's ``put``."""
    nothing = F.lit(0).cast("bigint")

    def of(parts: Column, held: Column, ends: Column) -> Column:
        def piece(s: Column, before: Column) -> Column:
            return F.when(s["start"] >= before, F.concat(taken(parts, before, s["start"]), s["put"])).otherwise("")

        last = F.greatest(F.coalesce(F.try_element_at(ends, F.lit(-1)), nothing), F.coalesce(F.try_element_at(held, F.lit(-1))["end"], nothing))
        return F.concat(F.array_join(F.zip_with(held, ends, piece), ""), taken(parts, last, F.length(text).cast("bigint")))

    def with_ends(parts: Column, held: Column) -> Column:
        ends = running(F.transform(held, lambda s: s["end"]), lambda a, b: F.greatest(a, b), nothing, "bigint")
        return let(ends, lambda known: of(parts, held, known))

    return let(chunks(text), lambda parts: let(spans, lambda held: with_ends(parts, held)))


def span_text(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
