"""Language-model scores: Katz backoff over word pairs, with Good-Turing discounts.

Tokens are the words of the lower-cased text (A-Z only) and one end per document; the first word's context is the start.  Counts come
from training documents only.  The model is stored as two partitioned tables: word counts by hash of the word, pair counts by hash
of the context.  A pair seen ``c`` times has ``d(c) c / c(context)``; any other backs off to ``alpha(context) p(word)``, where the
word's probability is discounted in the same way and what is left goes to words never seen.  ``alpha`` divides exactly the mass that
a context's discounts leave by the mass that its unseen words have.

How it runs: texts are read once into batches, kept as tables: a batch's distinct words by 64-bit hash, and its tokens as places in that
list.  A batch asks each word partition for its words' counts, then sends its distinct pairs, combined, to the pair partitions, first for
counting, then with its documents for scoring, and gets back one sum per document.  What crosses the network is distinct words and pairs per batch,
so a frequent word costs one entry per batch.  Pairs are dealt by context; contexts so frequent that they would fill a partition are
dealt by pair, and their sums, at most twice as many as there are partitions, are added up by the driver.

Words are told apart by their hash; two different words meet with a chance of about ``V^2 / 2^65``.

Defined cases: null and empty texts hold the end token only; repeated rows count and are scored each; null ids are kept; without training
tokens every word is unseen; where Good-Turing counts give no proper discount, half a count is taken off instead; an empty table gives no
rows; columns other than ``doc_id``, ``text`` and ``train`` are passed over.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageledger.llm.common import Scratch, buffers, freed_shuffles, mixed, packed, part_of, powers, slices, text_bytes, unpacked

#: Counts up to this are discounted.
K = 5
#: Bytes of text in a batch, and those hashed at once.
BATCH_BYTES, HASH_BYTES = 6 << 20, 1 << 18
#: Distinct words or pairs that a partition should get on average.
PARTITION_WORDS = 1 << 18
_END = np.uint64(0x243F6A8885A308D3)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def token_hashes(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of texts that lie end to end, and how many words each text has."""
    size = int(offsets[-1] - offsets[0])
    if not size:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    text = _LOWER[body[offsets[0] : offsets[-1]]]
    ends_at = offsets - offsets[0]
    word = ~_SPACE[text]
    opens, closes = word.copy(), word.copy()
    opens[1:] &= ~word[:-1]
    closes[:-1] &= ~word[1:]
    inner = ends_at[(ends_at > 0) & (ends_at < size)]
    opens[inner] = word[inner]
    closes[inner - 1] = word[inner - 1]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes)
    up, down = powers(1 << (size - 1).bit_length())
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[:size], out=sums[1:])
    return mixed((sums[last + 1] - sums[first]) * down[first]), np.diff(np.searchsorted(first, ends_at))


def _batches(docs: DataFrame) -> DataFrame:
    """Texts as batches: distinct word hashes in order, their training counts, and the tokens as places among them.

    Each document's words are followed by the end token.
    """

    def of(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for part in parts:
            body, offsets = buffers(part.column(2))
            for a, b in slices(offsets, BATCH_BYTES):
                hashes, sizes = [], []
                for c, d in slices(offsets[a : b + 1], HASH_BYTES):
                    found, n = token_hashes(body, offsets[a + c : a + d + 1])
                    places = np.cumsum(n)
                    hashes.append(np.insert(found, places, _END))
                    sizes.append(n + 1)
                n_tokens = np.concatenate(sizes)
                words, place = np.unique(np.concatenate(hashes), return_inverse=True)
                train = part.column(1)[a:b].to_numpy(zero_copy_only=False).astype(bool)
                counts = np.bincount(place[np.repeat(train, n_tokens)], minlength=len(words))
                row = [number, part.column(0)[a:b].to_pylist(), train.tolist(), packed(n_tokens), words.tobytes(), packed(counts), packed(place)]
                number += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.binary()] * 4))],
                    ["batch", "doc_ids", "train", "n_tokens", "words", "counts", "place"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("train"), F.lit(False)).alias("train"), text_bytes().alias("body"))
    return rows.mapInArrow(of, "batch bigint, doc_ids array<bigint>, train array<boolean>, n_tokens binary, words binary, counts binary, place binary")


def _ask_words(batches: DataFrame, parts: int) -> DataFrame:
    def of(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows:
            for batch, words, counts in zip(*(row.column(name).to_pylist() for name in ("batch", "words", "counts"))):
                words, counts = np.frombuffer(words, np.uint64), unpacked(counts)
                edges = np.searchsorted(part_of(words, parts), np.arange(parts + 1))
                full = np.flatnonzero(np.diff(edges))
                made = [(int(p), batch, words[edges[p] : edges[p + 1]].tobytes(), packed(counts[edges[p] : edges[p + 1]])) for p in full]
                yield pa.RecordBatch.from_pylist([dict(zip(("part", "batch", "words", "counts"), m)) for m in made], _ASKED)

    return batches.select("batch", "words", "counts").mapInArrow(of, "part int, batch bigint, words binary, counts binary")


_ASKED = pa.schema([("part", pa.int32()), ("batch", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())])
_WORDS = pa.schema([("part", pa.int32()), ("batch", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary()), ("sums", pa.list_(pa.float64()))])


def _count_words(parts: int):
    """For one word partition: each batch's words by number and total count, and one row of sums (tokens, words, words by count)."""

    def of(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        words = [np.frombuffer(x, np.uint64) for x in table.column("words").to_pylist()]
        uses = np.concatenate([unpacked(x) for x in table.column("counts").to_pylist()]).astype(np.float64)
        _, place = np.unique(np.concatenate(words), return_inverse=True)
        totals = np.bincount(place, uses).astype(np.int64)
        edges = np.cumsum([0, *map(len, words)])
        rows = [
            {"part": part, "batch": batch, "ids": packed(place[a:b].astype(np.uint64) * parts + part), "counts": packed(totals[place[a:b]]), "sums": None}
            for batch, a, b in zip(table.column("batch").to_pylist(), edges, edges[1:])
        ]
        sums = [float(totals.sum()), float((totals > 0).sum()), *np.bincount(totals[(totals > 0) & (totals <= K + 1)], minlength=K + 2)[1:].astype(float)]
        return pa.Table.from_pylist([*rows, {"part": part, "batch": None, "ids": None, "counts": None, "sums": sums}], _WORDS)

    return of


def discounts(by_count: list[float]) -> np.ndarray:
    """``d[r]`` for r up to ``K``, from the numbers of items seen 1 to ``K + 1`` times; Katz's formula where it is proper."""
    n = [0.0, *by_count]
    found = np.ones(K + 1)
    if all(n[r] > 0 for r in range(1, K + 2)):
        rest = (K + 1) * n[K + 1] / n[1]
        if rest < 1:
            for r in range(1, K + 1):
                found[r] = ((r + 1) * n[r + 1] / (n[r] * r) - rest) / (1 - rest)
            if ((found[1:] > 0) & (found[1:] < 1)).all():
                return found
    found[1:] = [(r - 0.5) / r for r in range(1, K + 1)]
    return found


class Words:
    """The probability of a word from its training count; zero stands for all words never seen."""

    def __init__(self, tokens: float, by_count: list[float]):
        self.tokens, self.d = tokens, discounts(by_count)
        left = sum((1 - self.d[r]) * r * by_count[r - 1] for r in range(1, K + 1))
        if not left:
            self.d, self.tokens, left = np.ones(K + 1), tokens + 1, 1.0
        self.unseen = left / self.tokens

    def of(self, counts: np.ndarray) -> np.ndarray:
        counts = counts.astype(np.int64)
        factor = np.where(counts <= K, self.d[np.minimum(counts, K)], 1.0)
        return np.where(counts > 0, factor * counts / self.tokens, self.unseen)


def _pairs(model: Words, parts: int, hot: float, n_train: int, base: tuple[float, float], scoring: bool):
    """A batch's distinct pairs by pair partition, sorted by context and word; for scoring with their documents, else training pairs."""
    start = np.uint64((1 << 64) - 1)  # no word has this number

    def of(left: pa.Table, right: pa.Table) -> pa.Table:
        batch = left.column("batch")[0].as_py()
        n_tokens = unpacked(left.column("n_tokens")[0].as_py()).astype(np.int64)
        train = np.array(left.column("train")[0].as_py(), bool)
        place = unpacked(left.column("place")[0].as_py()).astype(np.int64)
        answers = sorted(zip(*(right.column(name).to_pylist() for name in ("part", "ids", "counts"))))
        ids = np.concatenate([*(unpacked(x).astype(np.uint64) for _, x, _ in answers), [start]])
        counts = np.concatenate([*(unpacked(x).astype(np.int64) for _, _, x in answers), [n_train]])
        doc = np.repeat(np.arange(len(n_tokens)), n_tokens)
        before = np.empty(len(place), np.int64)
        before[1:] = place[:-1]
        before[np.cumsum(n_tokens) - n_tokens] = len(ids) - 1
        rows = []
        if scoring:
            own = np.log10((counts[place] + 0.5) / base[0]) if base[0] > 0 else np.zeros(len(place))
            made = np.stack([n_tokens, np.bincount(doc, counts[place] > 0, len(n_tokens)).astype(np.int64)])
            rows.append({"part": batch % parts, "batch": batch, "docs": made.tobytes(), "sums": np.bincount(doc, own, len(n_tokens)).tobytes()})
        else:
            mine = train[doc]
            place, before, doc = place[mine], before[mine], doc[mine]
        spread = mixed(ids)
        target = part_of(np.where(counts[before] >= hot, mixed(spread[before] + ids[place]), spread[before]), parts)
        order = np.lexsort((ids[place], ids[before], target))
        place, before, doc, target = place[order], before[order], doc[order], target[order]
        fresh = np.ones(len(place), bool)
        fresh[1:] = (place[1:] != place[:-1]) | (before[1:] != before[:-1]) | (target[1:] != target[:-1])
        first = np.flatnonzero(fresh)
        uses = np.diff(np.append(first, len(place)))
        edges = np.searchsorted(target[first], np.arange(parts + 1))
        for part in np.flatnonzero(np.diff(edges)):
            a, b = edges[part], edges[part + 1]
            pair = first[a:b]
            context, word = before[pair], place[pair]
            new = np.ones(len(pair), bool)
            new[1:] = context[1:] != context[:-1]
            runs = np.flatnonzero(new)
            row = {
                "part": int(part), "batch": batch, "contexts": packed(ids[context[runs]]), "totals": packed(counts[context[runs]]),
                "sizes": packed(np.diff(np.append(runs, len(pair)))), "words": packed(ids[word]), "counts": packed(counts[word]), "uses": packed(uses[a:b]),
            }
            if scoring:
                row["docs"] = packed(doc[pair[0] : pair[-1] + uses[b - 1]])
            rows.append(row)
        return pa.Table.from_pylist(rows, _PAIRS)

    return of


_PAIRS = pa.schema([("part", pa.int64()), ("batch", pa.int64()), *((name, pa.binary()) for name in ("contexts", "totals", "sizes", "words", "counts", "uses", "docs", "sums"))])
_PAIR_SQL = "part bigint, batch bigint, contexts binary, totals binary, sizes binary, words binary, counts binary, uses binary, docs binary, sums binary"
_MODEL = pa.schema([("part", pa.int64()), ("contexts", pa.binary()), ("sizes", pa.binary()), ("words", pa.binary()), ("uses", pa.binary()), ("hot", pa.int64()), ("sums", pa.list_(pa.float64()))])
_MODEL_SQL = "part bigint, contexts binary, sizes binary, words binary, uses binary, hot bigint, sums array<double>"


def _read(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Context, context count, word and word count of each pair of a row."""
    sizes = unpacked(row["sizes"]).astype(np.int64)
    contexts, totals = unpacked(row["contexts"]).astype(np.uint64), unpacked(row["totals"]).astype(np.int64)
    return np.repeat(contexts, sizes), np.repeat(totals, sizes), unpacked(row["words"]).astype(np.uint64), unpacked(row["counts"]).astype(np.int64)


def _count_pairs(model: Words, hot: float):
    """One pair partition of the model: its pairs in order with their counts; and sums of its frequent contexts and of counts."""

    def of(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        read = [_read(row) for row in rows]
        context, total, word, count = (np.concatenate([x[at] for x in read]) for at in range(4))
        uses = np.concatenate([unpacked(row["uses"]) for row in rows]).astype(np.int64)
        order = np.lexsort((word, context))
        context, total, word, count, uses = context[order], total[order], word[order], count[order], uses[order]
        fresh = np.ones(len(context), bool)
        fresh[1:] = (context[1:] != context[:-1]) | (word[1:] != word[:-1])
        first = np.flatnonzero(fresh)
        uses = np.add.reduceat(uses, first)
        context, total, word, count = context[first], total[first], word[first], count[first]
        part = rows[0]["part"]
        heads, begins = np.unique(context, return_index=True)
        sizes = np.diff(np.append(begins, len(context)))
        made = [{"part": part, "contexts": packed(heads), "sizes": packed(sizes), "words": packed(word), "uses": packed(uses), "hot": None, "sums": None}]
        made.append({"part": None, "hot": None, "sums": np.bincount(uses[uses <= K + 1], minlength=K + 2)[1:].astype(float).tolist()})
        many = np.flatnonzero(total >= hot)
        if len(many):
            heads, at = np.unique(context[many], return_inverse=True)
            by_count = [np.bincount(at, uses[many] == r, len(heads)) for r in range(1, K + 1)]
            sums = np.stack([*by_count, np.bincount(at, model.of(count[many]), len(heads))], axis=1)
            made += [{"part": None, "hot": int(head.view(np.int64)), "sums": s.tolist()} for head, s in zip(heads, sums)]
        return pa.Table.from_pylist(made, _MODEL)

    return of


def _score_pairs(model: Words, d: np.ndarray, hot: float, sums: dict[int, list[float]]):
    """The log probability of each asked pair, summed by document."""

    def of(asked: pa.Table, stored: pa.Table) -> pa.Table:
        made = []
        tables = stored.to_pylist()
        known = tables[0] if tables else None
        empty = packed(np.zeros(0, np.uint64))
        known = known or dict.fromkeys(("contexts", "sizes", "words", "uses"), empty)
        heads, sizes = unpacked(known["contexts"]).astype(np.uint64), unpacked(known["sizes"]).astype(np.int64)
        word, uses = unpacked(known["words"]).astype(np.uint64), unpacked(known["uses"]).astype(np.int64)
        run = np.repeat(np.arange(len(heads)), sizes)
        context = heads[run] if len(heads) else heads
        rows = asked.to_pylist()
        mine = [row for row in rows if row["contexts"] is not None]
        made += [{"batch": row["batch"], "docs": row["docs"], "sums": row["sums"], "score": None} for row in rows if row["contexts"] is None]
        if not mine:
            return pa.Table.from_pylist(made, _SCORED)
        read = [_read(row) for row in mine]
        c, total, w, count = (np.concatenate([x[at] for x in read]) for at in range(4))
        # All pairs, stored and asked, take numbers in the order of (context, word).
        order = np.lexsort((np.concatenate([word, w]), np.concatenate([context, c])))
        both_c, both_w = np.concatenate([context, c])[order], np.concatenate([word, w])[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (both_c[1:] != both_c[:-1]) | (both_w[1:] != both_w[:-1])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(fresh) - 1
        table = np.zeros(int(number.max()) + 1, np.int64)
        table[number[: len(uses)]] = uses
        c_uses = table[number[len(uses) :]]
        # Word counts of stored pairs are those asked with them: a training pair is asked by the batch it comes from.
        word_count = np.zeros(len(table), np.int64)
        word_count[number[len(uses) :]] = count
        # By context, one more for those without a training pair here: sums of counts up to K, and the mass its seen words have.
        left = np.zeros((len(heads) + 1, K + 1))
        for r in range(1, K + 1):
            left[:-1, r - 1] = np.bincount(run, uses == r, len(heads))
        left[:-1, K] = np.bincount(run, model.of(word_count[number[: len(uses)]]), len(heads))
        head_at = np.minimum(np.searchsorted(heads, c), max(len(heads) - 1, 0))
        head_at = np.where(heads[head_at] == c, head_at, len(heads)) if len(heads) else np.zeros(len(c), np.int64)
        if sums:  # frequent contexts lie in several partitions
            named = np.array(list(sums), np.int64).view(np.uint64)
            frequent = np.flatnonzero(total >= hot)
            frequent = frequent[np.isin(c[frequent], named)]
            found, place = np.unique(c[frequent], return_inverse=True)
            head_at[frequent] = len(left) + place
            left = np.concatenate([left, np.array([sums[int(head.view(np.int64))] for head in found]).reshape(-1, K + 1)])
        mass = ((left[:, :K] * ((1 - d[1:]) * np.arange(1, K + 1))).sum(axis=1))[head_at]
        seen = left[head_at, K]
        none = (mass <= 0) & (total > 0)  # only counts above K: one more use is set aside for all others
        whole = np.where(none, total + 1, np.maximum(total, 1)).astype(float)
        mass = np.where(none, 1.0, mass) / whole
        factor = np.where(none | (c_uses > K), 1.0, d[np.minimum(c_uses, K)])
        alpha = np.where(total > 0, mass / np.maximum(1 - seen, 1e-12), 1.0)
        chance = np.where(c_uses > 0, factor * c_uses / whole, alpha * model.of(count))
        logs = np.log10(np.maximum(chance, 1e-300))
        at = 0
        for asked_row, (contexts, *_) in zip(mine, read):
            n = unpacked(asked_row["uses"]).astype(np.int64)
            docs = unpacked(asked_row["docs"]).astype(np.int64)
            found, place = np.unique(docs, return_inverse=True)
            score = np.bincount(place, np.repeat(logs[at : at + len(contexts)], n), len(found))
            made.append({"batch": asked_row["batch"], "docs": packed(found), "sums": None, "score": score.tobytes()})
            at += len(contexts)
        return pa.Table.from_pylist(made, _SCORED)

    return of


_SCORED = pa.schema([("batch", pa.int64()), ("docs", pa.binary()), ("sums", pa.binary()), ("score", pa.binary())])


def _by_document(tokens: int):
    def of(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, train = left.column("doc_ids")[0].as_py(), left.column("train")[0].as_py()
        score = np.zeros(len(ids))
        for row in sorted(right.to_pylist(), key=lambda row: (row["score"] is None, row["docs"])):
            if row["score"] is None:
                n_tokens, n_known = np.frombuffer(row["docs"], np.int64).reshape(2, -1)
                base = np.frombuffer(row["sums"])
            else:
                np.add.at(score, unpacked(row["docs"]).astype(np.int64), np.frombuffer(row["score"]))
        columns = (pa.array(ids, pa.int64()), pa.array(train), pa.array(n_tokens), pa.array(n_known), pa.array(np.full(len(ids), tokens)), pa.array(base), pa.array(score))
        return pa.table(columns, ["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return of


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, train, n_tokens, n_known, train_tokens, base_score, score`` of each row; ``train`` marks the rows to learn from."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "katz")
    result = "doc_id bigint, train boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    with freed_shuffles(spark):
        batches = scratch.keep(_batches(docs), "batches")
        n_words, n_train = batches.select(F.sum(F.octet_length("words") / 8), F.sum(F.size(F.filter("train", lambda t: t)))).first()
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int((n_words or 0) // PARTITION_WORDS) + 1)
        asked = _ask_words(batches, parts).groupBy("part").applyInArrow(_count_words(parts), "part int, batch bigint, ids binary, counts binary, sums array<double>")
        words = scratch.keep(asked, "words")
        totals = words.filter("sums IS NOT NULL").agg(*[F.sum(F.col("sums")[at]) for at in range(K + 3)]).first()
        tokens, types, *by_count = [float(x or 0) for x in totals]
        model = Words(tokens, by_count)
        base = (tokens + 0.5 * (types + 1), 0.0)
        hot = max(tokens / (2 * parts), 1000.0)
        answers = words.filter("batch IS NOT NULL").drop("sums").groupBy("batch")
        batches = scratch.keep(batches.drop("words", "counts"), "tokens")
        scratch.drop("batches")
        sides = batches.drop("doc_ids").groupBy("batch").cogroup(answers)
        made = sides.applyInArrow(_pairs(model, parts, hot, int(n_train or 0), base, False), _PAIR_SQL)
        pairs = scratch.keep(made.groupBy("part").applyInArrow(_count_pairs(model, hot), _MODEL_SQL), "pairs")
        # At most two frequent contexts per partition, and one row of counts.
        rest = pairs.filter("part IS NULL").groupBy("hot").agg(*[F.sum(F.col("sums")[at]).alias(f"s{at}") for at in range(K + 1)])
        sums = {row["hot"]: [float(row[f"s{at}"]) for at in range(K + 1)] for row in rest.collect()}
        d = discounts(sums.pop(None, [0.0] * (K + 1)))
        made = sides.applyInArrow(_pairs(model, parts, hot, int(n_train or 0), base, True), _PAIR_SQL)
        stored = pairs.filter("part IS NOT NULL").drop("hot", "sums").groupBy("part")
        scored = made.groupBy("part").cogroup(stored).applyInArrow(_score_pairs(model, d, hot, sums), "batch bigint, docs binary, sums binary, score binary")
        scored = scratch.keep(scored, "scored")
        slim = batches.select("batch", "doc_ids", "train").groupBy("batch")
        return scratch.keep(slim.cogroup(scored.groupBy("batch")).applyInArrow(_by_document(int(tokens)), result), "result")
