"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

The model is fitted on a bounded sample of labelled documents (``FIT_ROWS``), taken by hash and dealt into four parts by
hash: two give the learned lexicon (words, and stems of the first letters, that toxic documents hold far more often than
others), the third the trees, the fourth the calibration, so no part judges its own rows.  Features are densities of the
lexicon and of stems, how near insults stand to the second person, capitals, punctuation and obfuscation.  All documents are then
scored in one pass without a shuffle.

Defined cases: null and empty texts have all features zero and get the score of such a row; labels that are null are passed over, a
document with several labels is toxic if one says so; without labels of both kinds in each part the score is that of the
lexicon alone, ``1 - 2^-hits``; repeated rows get equal scores; null ids are scored and never trained on; an empty table gives no
rows.  ``lang``, ``source``, ids and labels are not features.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageledger.llm.common import Scratch

#: Labelled documents that the model is fitted on at most, and terms that the learned lexicon holds at most.
FIT_ROWS, LEXICON_TERMS = 18_000, 1_000
#: Letters of a stem, from and to; uses of a term that a document counts, that toxic documents need, least log ratio.
STEM, LONG_STEM, MOST_USES, LEAST_USES, LEAST_RATIO = 3, 7, 3, 6, 2.3
TREES, DEPTH, THRESHOLD = 20, 3, 0.3
#: Rows that leave a task together.
ROWS_AT_ONCE = 1_000
#: The lexicon that holds without any labels.
INSULTS = tuple("idiot idiots moron morons stupid scum loser losers worthless pathetic disgusting trash clown imbecile dumb filth vermin bastard hate".split())
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vuestro".split())
LEET = str.maketrans("013457@$!", "oieastasi")
NAMES = ("hits", "hit_rate", "kinds", "stems", "stem_rate", "stemmed", "weight", "weight_rate", "same", "second", "near", "crowd", "capitals", "shouted", "bangs", "runs", "hidden", "hidden_rate", "length")

_WORD = re.compile(r"[^\W\d_]+")
_ODD = re.compile(r"(?=[^\s]*[^\W\d_][0-9@$!*._-]+[^\W\d_])[^\s]{4,24}")
_RUN = re.compile(r"[!?]{2,}")


def _stemmed(words: list[str], stems: dict[str, float]) -> tuple[Counter, float, int]:
    """Words that begin with a stem and how often they stand, their summed weight, and the most uses of one stem."""
    if not stems:
        return Counter(), 0.0, 0
    heads = _heads(tuple(stems))
    found = Counter(word for word in words if word[:STEM] in heads and len(word) > STEM)
    weight, uses = 0.0, Counter()
    for word, n in list(found.items()):
        held = [word[:size] for size in range(STEM, min(LONG_STEM, len(word) - 1) + 1) if word[:size] in stems]
        if held:
            weight += n * max(stems[stem] for stem in held)
            uses.update({stem: n for stem in held})
        else:
            del found[word]
    return found, weight, max(uses.values(), default=0)


@lru_cache(4)
def _heads(stems: tuple[str, ...]) -> frozenset[str]:
    return frozenset(stem[:STEM] for stem in stems)


def features(text: str, lexicon: frozenset[str], stems: dict[str, float]) -> list[float]:
    if not text:
        return [0.0] * len(NAMES)
    lower = text.lower()
    words = _WORD.findall(lower)
    n = len(words) or 1
    hits = [at for at, word in enumerate(words) if word in lexicon]
    stemmed, weight, same = _stemmed(words, stems)
    stem_hits = sum(stemmed.values())
    second = [at for at, word in enumerate(words) if word in SECOND]
    near = 0.0
    if hits and second:
        places = np.array(second)
        right = np.searchsorted(places, hits)
        gaps = np.minimum(np.abs(places[np.minimum(right, len(places) - 1)] - hits), np.abs(places[np.maximum(right - 1, 0)] - hits))
        near = 1.0 / float(gaps.min())
    crowd = 0
    if hits:
        places = np.array(hits)
        crowd = int((np.searchsorted(places, places + 50) - np.arange(len(places))).max())
    capitals = sum(map(str.isupper, text))
    shouted = text.isupper() or 0
    hidden = 0
    if any(mark in lower for mark in "013457@$!*._-"):
        for token in _ODD.findall(lower):
            plain = token.translate(LEET)
            hidden += any(re.sub(r"[^a-z]", "", form) in lexicon for form in (token, plain)) and not any(w in lexicon for w in _WORD.findall(token))
    bangs = lower.count("!") + lower.count("?")
    runs = len(_RUN.findall(text)) if bangs else 0
    return [
        float(len(hits)), 1000.0 * len(hits) / n, float(len({words[at] for at in hits})), float(stem_hits), 1000.0 * stem_hits / n, float(len(stemmed)), weight, 1000.0 * weight / n, float(same),
        1000.0 * len(second) / n, near, float(crowd), capitals / len(text), float(shouted), 1000.0 * bangs / len(text), float(runs),
        float(hidden), 1000.0 * hidden / n, float(np.log1p(n)),
    ]


def with_features(docs: DataFrame, lexicon: frozenset[str], stems: dict[str, float]) -> DataFrame:
    """All columns of ``docs`` but the text, and ``features array<double>``."""
    names = [name for name in docs.columns if name != "text"]

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                some = batch.slice(at, ROWS_AT_ONCE)
                made = [features(text.as_py() or "", lexicon, stems) for text in some.column("text")]
                columns = [some.column(name) for name in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(made, pa.list_(pa.float64()))], [*names, "features"])

    kept = [field for field in docs.schema if field.name != "text"]
    return docs.mapInArrow(of, T.StructType([*kept, T.StructField("features", T.ArrayType(T.DoubleType()))]))


def _lexicon(sample: DataFrame) -> tuple[frozenset[str], dict[str, float]]:
    """Words, and stems with their log ratios, that toxic texts hold far more often; copies of a text count once.

    A document counts a term up to ``MOST_USES`` times.  Each task sums its batches before the shuffle.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = (Counter(), Counter())
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = Counter(word for word in _WORD.findall(text.lower()) if len(word) >= STEM)
                terms = Counter(words)
                for word, n in words.items():
                    for size in range(STEM, min(LONG_STEM, len(word) - 1) + 1):
                        terms["^" + word[:size]] += n
                sums[toxic].update({term: min(n, MOST_USES) for term, n in terms.items()})
            names = list(sums[1])
            yes, no = [sums[1][name] for name in names], [sums[0][name] for name in names]
            rest = [(name, n) for name, n in sums[0].items() if name not in sums[1]]
            columns = [names + [name for name, _ in rest], yes + [0] * len(rest), no + [n for _, n in rest]]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["term", "yes", "no"])

    texts = sample.dropDuplicates(["text"]).select(F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic"), "text")
    seen = texts.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    if not seen[0] or not seen[1]:
        return frozenset(), {}
    counts = texts.mapInArrow(count, "term string, yes bigint, no bigint").groupBy("term").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    ratio = F.round(F.log((F.col("yes") + 0.5) / float(seen[0])) - F.log((F.col("no") + 0.5) / float(seen[1])), 6)
    best = counts.withColumn("ratio", ratio).filter((F.col("yes") >= LEAST_USES) & (F.col("ratio") >= LEAST_RATIO))
    rows = best.orderBy(F.desc(F.round(F.col("yes") * F.col("ratio"), 3)), "term").limit(LEXICON_TERMS).collect()
    return frozenset(r["term"] for r in rows if r["term"][0] != "^"), {r["term"][1:]: r["ratio"] for r in rows if r["term"][0] == "^"}


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Callable[..., DataFrame]:
    """A scorer fitted on the labelled ``docs``: it takes rows with a ``text`` and the names of columns to keep."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    marks = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).join(marks, "doc_id").distinct()
    chosen = known.orderBy(F.xxhash64(F.col("doc_id")), "doc_id").limit(fit_rows)
    chosen = scratch.keep(chosen, "chosen")
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("part")), F.lit(4))
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    # At most fit_rows slim rows, so they can be sent to every task.
    sample = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text).join(F.broadcast(chosen), "doc_id").withColumn("part", part)
    sample = scratch.keep(sample, "sample")
    words, stems = _lexicon(sample.filter("part < 2"))
    lexicon = words | frozenset(INSULTS)
    made = scratch.keep(with_features(sample.filter("part >= 2"), lexicon, stems).coalesce(2), "features")
    made = made.withColumn("v", array_to_vector("features"))
    kinds = {(row["part"], row["toxic"]) for row in made.select("part", "toxic").distinct().collect()}
    trees = calibration = None
    if kinds >= {(2, 0), (2, 1), (3, 0), (3, 1)}:
        trees = GBTClassifier(featuresCol="v", labelCol="toxic", maxIter=TREES, maxDepth=DEPTH, seed=7, minInstancesPerNode=2).fit(made.filter("part = 2"))
        raw = trees.transform(made.filter("part = 3")).select("toxic", vector_to_array("probability")[1].alias("raw"))
        calibration = IsotonicRegression(featuresCol="raw", labelCol="toxic", predictionCol="score").fit(raw.withColumn("toxic", F.col("toxic").cast("double")))

    def score(rows: DataFrame, *columns: str) -> DataFrame:
        """``row``, the wanted columns as a struct, with ``score`` and ``predicted``."""
        found = with_features(rows.select(F.struct(*columns).alias("row"), text), lexicon, stems)
        if trees is None:
            found = found.withColumn("score", 1 - F.pow(F.lit(2.0), -F.col("features")[0]))
        else:
            found = trees.transform(found.withColumn("v", array_to_vector("features")))
            found = calibration.transform(found.withColumn("raw", vector_to_array("probability")[1]))
        found = found.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")))
        return found.select("row", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

    return score


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    score = fit(docs.filter(~held_out()), labels)
    return score(docs, "*").filter("predicted = 0").select("row.*")
