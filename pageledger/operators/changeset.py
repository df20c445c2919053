"""The change set for a content target: property rows, tags to create, replicate actions."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageledger import fixed_values as fixed
from pageledger.functions import urls
from pageledger.functions.text import js_trim, let
from pageledger.session import filter_in_place

_log = logging.getLogger(__name__)
_FIELDS = ("title", "description", "keywords")
_NO_NAMESPACE = "No tag namespace for this URL"


@dataclass(frozen=True)
class Target:
    """What a target configuration says; credentials are not read."""

    type: str = fixed.DEFAULT_TARGET
    author_url: str | None = None
    site_path_prefix: str | None = None
    replicate_after_update: bool = False
    property_map: dict[str, str] | None = None
    update_fields: tuple[str, ...] = ()
    tag_namespace: str | None = None
    tag_namespace_map: tuple[tuple[str, str], ...] = field(default=())

    @property
    def properties(self) -> dict[str, str]:
        return fixed.DEFAULT_PROPERTY_MAP if self.property_map is None else self.property_map


def wanted_fields(target: Target) -> list[str]:
    """Fields to update: the requested ones the map knows, or all of the map."""
    if target.update_fields:
        return [name for name in target.update_fields if target.properties.get(name)]
    return list(target.properties)


def target_path(url: Column, prefix: str | None) -> Column:
    """Path inside the target for a public URL; NULL for an invalid URL."""
    path = F.regexp_replace(urls.pathname(url), r"\.html?$", "")
    if not prefix:
        return path
    segments = [segment for segment in prefix.split("/") if segment]
    public = "/" + (segments[-1] if segments else "undefined")
    head = prefix.removesuffix("/")

    def place(inner: Column) -> Column:
        rooted = F.when(F.startswith(inner, F.lit("/")), inner).otherwise(F.concat(F.lit("/"), inner))
        return (
            F.when(F.startswith(inner, F.lit(prefix)), inner)
            .when(
                F.startswith(inner, F.lit(public)),
                F.concat(F.lit(prefix), F.substring(inner, F.lit(len(public) + 1), F.length(inner))),
            )
            .otherwise(F.concat(F.lit(head), rooted))
        )

    return let(path, place)


def content_path(path: Column) -> Column:
    node = F.lit(fixed.CONTENT_NODE)
    return F.when(F.endswith(path, node), path).otherwise(F.concat(path, node))


def split_tags(keywords: Column) -> Column:
    return F.filter(F.transform(F.split(keywords, ","), js_trim), lambda tag: tag != "")


def tag_node(label: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "-"), F.lit("-"))


def tag_namespace(url: Column, target: Target) -> Column:
    """First namespace whose pattern is part of the URL, else the default."""
    default = F.lit(target.tag_namespace).cast("string")
    if not target.tag_namespace_map:
        return default
    rules = F.array(*[F.struct(F.lit(p).alias("pattern"), F.lit(n).alias("ns")) for p, n in target.tag_namespace_map])
    matching = F.filter(rules, lambda rule: F.contains(url, rule["pattern"]))
    return F.coalesce(F.get(matching, F.lit(0))["ns"], default)


def namespace_id(namespace: Column) -> Column:
    return F.get(F.split(namespace, fixed.TAG_ROOT), F.lit(1))


def tag_id(namespace: Column, node: Column) -> Column:
    """``ns:node``; NULL when the namespace has no id."""
    return F.concat(namespace_id(namespace), F.lit(":"), node)


def multi_value(tags: Column, namespace: Column) -> Column:
    """One tag id per tag label, as the value of a multi-valued property."""
    return F.transform(tags, lambda label: tag_id(namespace, tag_node(label)))


def keyword_property(tags: Column) -> Column:
    """The value of a plain keyword property."""
    return F.array(F.array_join(tags, ", "))


def _given(name: str) -> Column:
    return F.coalesce(F.col(name) != "", F.lit(False))


def _row(name: Column, values: Column, error: Column) -> Column:
    return F.struct(name.cast("string").alias("property"), values.cast("array<string>").alias("values"), error.cast("string").alias("error"))


def _with_namespace(records: DataFrame, target: Target) -> DataFrame:
    """``records`` with ``_namespace``, worked out once a page: their own ``tag_namespace`` (``namespace_rules``), or the target's rules."""
    if "tag_namespace" in records.columns:
        return records.withColumn("_namespace", F.coalesce("tag_namespace", F.lit(target.tag_namespace).cast("string")))
    return records.withColumn("_namespace", tag_namespace(F.col("url"), target))


def _without_tag_id(target: Target) -> Column:
    """True for a page whose wanted tags cannot be written, as its ``_namespace`` has no id."""
    if "keywords" not in wanted_fields(target) or target.properties["keywords"] != fixed.TAG_PROPERTY:
        return F.lit(False)
    return _given("suggested_keywords") & namespace_id(F.col("_namespace")).isNull()


def property_rows(records: DataFrame, target: Target) -> DataFrame:
    """Rows ``(site, url, path, property, values, action, error)``, one per property to write.

    Narrow: every page makes its own rows.  A page that cannot be mapped yields one row with ``error``; a page whose tags
    have no namespace keeps its other properties and gets a row with ``error`` for the tags.
    """
    wanted = wanted_fields(target)
    entries: list[tuple[str, Column, Column]] = []
    for name in _FIELDS:
        if name not in wanted:
            continue
        prop, given = target.properties[name], _given(f"suggested_{name}")
        if name != "keywords":
            entries.append((prop, given, F.array(f"suggested_{name}")))
            continue
        tags = split_tags(F.col("suggested_keywords"))
        given = given & ~_without_tag_id(target)
        entries.append((prop + fixed.TYPE_HINT_SUFFIX, given, F.array(F.lit(fixed.TYPE_HINT))))
        if prop == fixed.TAG_PROPERTY:
            entries.append((prop, given, multi_value(tags, F.col("_namespace"))))
        else:
            entries.append((prop, given, keyword_property(tags)))
    path = target_path(F.col("url"), target.site_path_prefix)
    error = (
        F.when(F.lit(not target.author_url), fixed.MISSING_AUTHOR_URL)
        .when(F.col("_path").isNull(), F.concat(F.lit("Invalid URL: "), F.coalesce(F.col("url"), F.lit(""))))
    )
    rows: list[Column] = []
    for place, (prop, given, values) in enumerate(entries):
        # of two fields mapped to one property, the later wins
        for later_prop, later_given, _ in entries[place + 1 :]:
            if later_prop == prop:
                given = given & ~later_given
        rows.append(F.when(given, _row(F.lit(prop), values, F.lit(None))))
    rows.append(F.when(_without_tag_id(target), _row(F.lit(None), F.array(), F.lit(_NO_NAMESPACE))))
    kind = "array<struct<property:string,values:array<string>,error:string>>"
    properties = F.filter(F.array(*rows), lambda row: row.isNotNull()).cast(kind)
    failed = F.array(_row(F.lit(None), F.array(), F.col("_error")))
    return (
        _with_namespace(records, target)
        .withColumn("_path", path)
        .withColumn("_error", error)
        .withColumn("_rows", F.when(F.col("_error").isNotNull(), failed.cast(kind)).otherwise(properties))
        .select("site", "url", "_path", F.inline_outer("_rows"))
        .filter(F.col("property").isNotNull() | F.col("error").isNotNull())
        .select(
            "site",
            "url",
            F.when(F.col("error").isNull(), content_path(F.col("_path"))).alias("path"),
            "property",
            "values",
            F.when(F.col("error").isNull(), "set").otherwise("error").alias("action"),
            "error",
        )
    )


def has_changes(target: Target) -> Column:
    """True for a page with at least one property to write."""
    wanted = [name for name in wanted_fields(target) if name in _FIELDS]
    condition = F.lit(False)
    for name in wanted:
        condition = condition | _given(f"suggested_{name}")
    return condition


def replicate_rows(records: DataFrame, target: Target) -> DataFrame:
    """One replicate action per changed page without a failed write, when the target asks for it."""
    path = target_path(F.col("url"), target.site_path_prefix)
    active = bool(target.replicate_after_update and target.author_url)
    return (
        filter_in_place(_with_namespace(records, target), F.lit(active) & has_changes(target) & ~_without_tag_id(target))
        .withColumn("path", path)
        .filter(F.col("path").isNotNull())
        .select(
            "site",
            "url",
            "path",
            F.lit(fixed.REPLICATE_PROPERTY).alias("property"),
            F.array(F.lit(fixed.REPLICATE_VALUE)).alias("values"),
            F.lit("replicate").alias("action"),
            F.lit(None).cast("string").alias("error"),
        )
    )


def change_set(records: DataFrame, target: Target) -> DataFrame:
    """All changes for a target.  Known targets without an implementation give no rows; others are refused."""
    if target.type in fixed.SKIPPED_TARGETS:
        _log.warning("%s is not implemented; nothing to change", target.type)
        records = records.limit(0)
    elif target.type != fixed.DEFAULT_TARGET:
        raise ValueError(f"Unsupported target type: {target.type}")
    changes = property_rows(records, target)
    if not target.replicate_after_update:
        return changes
    return changes.unionByName(replicate_rows(records, target))


def wanted_tags(records: DataFrame, target: Target) -> DataFrame:
    """Every tag the pages ask for: ``(namespace, node, label, url, pos)``, and ``seq`` where the records have it."""
    place = [name for name in ("seq", "url") if name in records.columns]
    uses_tags = "keywords" in wanted_fields(target) and target.properties["keywords"] == fixed.TAG_PROPERTY
    asking = filter_in_place(_with_namespace(records, target), F.lit(uses_tags) & _given("suggested_keywords"))
    exploded = asking.select(
        *place,
        F.col("_namespace").alias("namespace"),
        F.posexplode_outer(split_tags(F.col("suggested_keywords"))).alias("pos", "label"),
    )
    return exploded.filter(F.col("namespace").isNotNull() & F.col("label").isNotNull()).select(
        F.regexp_replace("namespace", "/$", "").alias("namespace"), tag_node(F.col("label")).alias("node"), "label", *place, "pos"
    )


def tags_to_create(tags: DataFrame, existing: DataFrame) -> DataFrame:
    """Tags not there yet, once each, labelled as first asked for.  Copies are combined map-side."""
    order = [name for name in ("seq", "url", "pos") if name in tags.columns]
    first = tags.groupBy("namespace", "node").agg(F.min_by("label", F.struct(*order)).alias("label"))
    return missing_tags(first, existing)


def missing_tags(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    return wanted.join(existing.select("namespace", "node"), ["namespace", "node"], "left_anti")
