"""The registered queries of this subpackage and, where SQL can say it, their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageledger.llm import bpe_tree, chat, exact_dedup, katz, packing, periodic_runs, pieces, pii, simhash, spelling, suffix_dedup, topk, toxicity
from pageledger.llm.common import table


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, scored by a model of the labelled ones that are not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    score = toxicity.fit(docs.filter(~toxicity.held_out()), table(spark, folder, "labels").select("doc_id", "toxic"))
    return score(docs, "doc_id").select("row.doc_id", toxicity.held_out("row.doc_id").alias("held_out"), "score", "predicted")


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, folder, "documents")).drop("raw")


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup.repeated_passages(table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")


def op4_pii_sanitisation(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.sanitise(table(spark, folder, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] != "term")
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("bigint").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(pii.span_text(base), 256).alias("base_sha256"),
        pii.span_text(F.col("spans")).alias("spans"),
        F.sha2("sanitised", 256).alias("sanitised_sha256"),
    )


def op5_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and one whose texts hold control strings, read back from the formatted text."""
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(1).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.explode(F.array(*[F.struct(F.lit(at).cast("bigint").alias("turn"), F.lit(role).alias("role")) for at, role in enumerate(("user", "assistant"))])).alias("t"),
    )
    extra = extra.select("conv_id", "t.turn", "t.role", F.lit(said).alias("text"))
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    formatted = chat.format_conversations(turns)
    read = formatted.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said_all = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said_all, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op6_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Every text encoded, and what decoding gives back."""
    encoded = pieces.encode(table(spark, folder, "documents"))
    decoded = pieces.decode(encoded.select("*", (F.octet_length("ids") / 4).cast("bigint").alias("n_ids"), F.sha2("ids", 256).alias("ids_sha256")))
    return decoded.select("doc_id", "n_ids", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))


def op7_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Every text scored by a model of the texts that are not held out."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    found = katz.score(table(spark, folder, "documents").select("doc_id", "text", (~held_out).alias("train")))
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece and its place; the checksum is that of the packed ids."""
    packed = packing.pack(packing.pieces_of(table(spark, folder, "documents")).drop("ids_crc32"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op10_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The five best of all vectors for each vector whose id is divisible by 50."""
    vectors = topk.quantised(table(spark, folder, "embeddings"))
    return topk.exact_top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5)


def op11_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of every text, and the bytes that they decode to."""
    encoded = bpe_tree.encode(table(spark, folder, "documents"))
    listed = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    decoded = bpe_tree.decode(encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), listed.alias("ids_sha256"), "ids"))
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Every word of the texts, one character of some runs taken out, with its form and the root of its forms."""
    return spelling.variant_groups(table(spark, folder, "documents"), drop_every=31)


def _with_planted_repeats(docs: DataFrame) -> DataFrame:
    """Texts of ids whose checksum is divisible by ten repeat a block of their words from some word on."""
    words = F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    picked = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
    n, g = F.size("words").cast("bigint"), F.floor(F.col("h") / 10)
    at = picked.withColumn("n", n).withColumn("a", F.when(F.col("n") > 0, g % F.col("n")))
    at = at.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8)))
    a, p, rest = F.col("a").cast("int"), F.col("p").cast("int"), (F.col("n") - F.col("a")).cast("int")
    block = F.array_repeat(F.slice("words", a + 1, p), F.ceil(rest / p).cast("int"))
    repeated = F.concat(F.slice("words", F.lit(1), a), F.slice(F.flatten(block), F.lit(1), rest))
    return at.select("doc_id", F.when(F.col("n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The runs of every text; the greatest is compared as doubles, which are exact up to 10^8 words."""
    found = periodic_runs.periodic_runs(_with_planted_repeats(table(spark, folder, "documents")))
    ranked = F.transform("runs", lambda r: F.struct((-r["length"] / r["period"]).alias("least"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    found = found.select("doc_id", "runs", "collapsed", F.array_min(ranked).alias("best"), listed.alias("listed"))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        *[F.col(f"best.{name}").alias(name) for name in ("start", "length", "period")],
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_pii_sanitisation": op4_pii_sanitisation,
    "op6_sentencepiece": op6_sentencepiece,
    "op5_chat_formatting": op5_chat_formatting,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_exact_top_k": op10_exact_top_k,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_periodic_runs": op13_periodic_runs,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op2_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256,
               CAST(strlen(t) AS BIGINT) AS n_bytes
        FROM d JOIN g USING (t)""",
    "op5_chat_formatting": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        o AS (
            SELECT *, row_number() OVER w AS pos, coalesce(lag(role) OVER w <> role, true) AS opens
            FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
        s AS (
            SELECT *, length(replace(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t'), '</part>', '\p')) AS n
            FROM o)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(n + CASE WHEN opens THEN 4 + length(role) + 2 + 8 ELSE 7 END) AS BIGINT) AS formatted_chars
        FROM s GROUP BY conv_id""",
    "op10_exact_top_k": """
        WITH v AS (
            SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY rank <= 5""",
}
