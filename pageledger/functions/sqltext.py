"""Small helpers to write long Column expressions as one piece of Spark SQL.

A resolver or a tag reader is a few hundred operators.  Built call by call they cost seconds of driver time per
query; as SQL text the same expression is parsed in milliseconds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quote(text: str) -> str:
    """A Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bind(value: str, name: str, body: str, kind: str = "STRING") -> str:
    """SQL for: evaluate ``value`` once, call it ``name`` and use it in ``body``, a result of type ``kind``.

    An aggregate over one element.  Unlike indexing into a transformed array it never asks the nested lambdas for
    their type again, which would be done row by row.
    """
    return f"aggregate(array({value}), CAST(NULL AS {kind}), (_, {name}) -> {body})"


def only(array: str, kind: str = "STRING") -> str:
    """SQL for the element of a one-element array."""
    return f"aggregate({array}, CAST(NULL AS {kind}), (_, one) -> one)"


def fold(text_cases: dict[str, str], otherwise: str) -> str:
    """SQL for a CASE over conditions in order."""
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in text_cases.items()) + f" ELSE {otherwise} END"


def lower_sql(name: str) -> str:
    """SQL for lower case that leaves the usual lower-case names alone; full case mapping is slow."""
    return f"CASE WHEN {name} RLIKE '[^a-z0-9.:_-]' THEN lower({name}) ELSE {name} END"


def map_array(values: Column, function: str) -> Column:
    """Apply a SQL lambda, given as text, to every element of an array."""
    return F.call_function("transform", values, F.expr(function))


def apply(name: str, body: str, kind: str = "STRING", **inputs: Column) -> Column:
    """Evaluate the SQL text ``body`` of type ``kind``, which sees the inputs as fields of ``name``."""
    packed = F.struct(*[column.alias(field) for field, column in inputs.items()])
    nothing = F.lit(None).cast(kind)
    return F.call_function("aggregate", F.array(packed), nothing, F.expr(f"(_, {name}) -> {body}"))
