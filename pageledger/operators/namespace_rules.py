"""Tag namespaces by a table of rules: the first rule whose pattern is part of an address.

For rules too many to be tested one by one.  Every pattern is known by one of its q-grams, the one that the fewest patterns hold; an address
meets the rules of its own q-grams by an equi-join, and what meets is tested in full.  Patterns shorter than a q-gram are known by
themselves, so addresses also show grams of those lengths, of which there are at most as many as a q-gram is long.

Defined cases: of rules with one pattern the first in order counts, as a later one can never win; of two rules with one place the least pattern
wins; an empty pattern is part of every address; a rule without a pattern is none; an address that is null or meets no rule, or whose first
rule names no namespace, gets the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageledger.session import cut

#: Code points of a q-gram.
GRAM = 4
#: Parts that the addresses of one gram are dealt into, so that a gram of all addresses is no single task.
SALTS = 16


def _grams(text: Column, length: int) -> Column:
    """All substrings of a length, by one pass of a pattern that looks ahead; ``length`` 0 has the empty one."""
    if length == 0:
        return F.array(F.lit(""))
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{length}}}))"), F.lit(1)))


def rule_index(rules: DataFrame, gram: int = GRAM) -> DataFrame:
    """``gram, pattern, ord, ns``: every pattern of ``rules (ord, pattern, ns)`` under its rarest gram, written once."""
    named = rules.filter(F.col("pattern").isNotNull()).select("pattern", F.struct("ord", "ns").alias("rule"))
    firsts = named.groupBy("pattern").agg(F.min("rule").alias("rule"))
    grams = _grams(F.col("pattern"), gram)
    own = F.when(F.length("pattern") < gram, F.array("pattern")).otherwise(grams)
    spread = firsts.select("pattern", "rule", F.explode(own).alias("gram"))
    uses = spread.groupBy("gram").agg(F.count(F.lit(1)).alias("uses"))
    rarest = spread.join(uses, "gram").groupBy("pattern", "rule").agg(F.min(F.struct("uses", "gram"))["gram"].alias("gram"))
    return cut(rarest.select("gram", "pattern", "rule.ord", "rule.ns"), "namespace-rules")


def with_tag_namespace(pages: DataFrame, rules: DataFrame, default: str | None = None, gram: int = GRAM, salts: int = SALTS) -> DataFrame:
    """``pages`` with ``tag_namespace``, by their ``url`` and ``rules (ord, pattern, ns)``.

    The index is a written table, so its size is known when the join is planned: a small one is sent to the addresses, a large one meets
    them by gram, dealt into ``salts`` parts.  Pages move once, by address; give them without their text.
    """
    index = rule_index(rules, gram)
    # lengths of at most one gram, so at most gram + 1 values
    lengths = sorted(row["length"] for row in index.select(F.length("gram").alias("length")).distinct().collect())
    urls = pages.select("url").filter(F.col("url").isNotNull()).distinct()
    shown = F.flatten(F.array(*[_grams(F.col("url"), length) for length in lengths])) if lengths else F.array().cast("array<string>")
    spread = urls.select("url", F.pmod(F.xxhash64("url"), F.lit(salts)).cast("int").alias("salt"), F.explode(shown).alias("gram"))
    dealt = index.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    met = spread.join(dealt, ["gram", "salt"]).filter(F.contains("url", "pattern"))
    found = met.groupBy("url").agg(F.min_by("ns", F.struct("ord", "pattern")).alias("ns"))
    rows = pages.drop("tag_namespace")
    rows = rows.select(F.col("url").alias("url"), F.struct("*").alias("page")).join(found, "url", "left")
    return rows.select("page.*", F.coalesce("ns", F.lit(default).cast("string")).alias("tag_namespace"))
