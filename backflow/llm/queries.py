"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from backflow.llm import binpack, decontam, extract, neardup, packing, runs, secrets, sharding, tokens, toxicity, tries, urlrules, vectors
from backflow.llm.common import read


#: The listed rules of the url query.
URL_RULES = [("com/", urlrules.ALLOW), ("example.com/en/", urlrules.BLOCK), ("www.example.com/en/", urlrules.ALLOW), ("net/es/", urlrules.BLOCK), ("net/fr/", urlrules.BLOCK)]


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.url_verdicts(read(spark, sf_dir, "pages"), URL_RULES)


def op2_wrapper_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.main_texts(read(spark, sf_dir, "pages"))


def op3_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_along_curve(read(spark, sf_dir, "documents"), with_ids=False)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op6_packed_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binpack.packed_matrix(read(spark, sf_dir, "documents"))


def op7_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), with_spans=False)


def op9_pivot_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(read(spark, sf_dir, "embeddings"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read(spark, sf_dir, "documents"))


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digests(runs.word_runs(runs.with_planted_periods(read(spark, sf_dir, "documents"))))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tries.prefix_trie(tries.with_shared_heads(tries.numbered_turns(read(spark, sf_dir, "conversations"))))
    return found.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256",
    )


def op13_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = sharding.shard_slots(read(spark, sf_dir, "documents"), shards=40)
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {f.__name__: f for f in (op1_url_rules, op2_wrapper_texts, op3_curve_packing, op4_secret_scan, op5_toxicity, op6_packed_matrix, op7_lsh_forest, op8_decontamination, op9_pivot_permutations, op10_token_counts, op11_word_runs, op12_prefix_trie, op13_minimax_shards)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


#: SQL has no CRC-32: the reversed polynomial, a byte and eight bits at a time.
_BYTES = "list_transform(regexp_extract_all({hexed}, '..'), lambda p: CAST('0x' || p AS BIGINT))"
_CRC32 = f"xor(list_reduce({_BYTES}, lambda c, b: list_reduce(range(8), lambda r, i: xor(r >> 1, 3988292384 * (r & 1)), xor(c, b)), 4294967295), 4294967295)"


def _reached(links: str) -> str:
    """Recursive table of everything that links lead to, and the smallest id of each component."""
    return f"reach AS (SELECT DISTINCT x AS id, x AS seed FROM {links} UNION SELECT l.y, r.seed FROM reach r JOIN {links} l ON r.id = l.x), least_id AS (SELECT id, min(seed) AS least FROM reach GROUP BY id)"


_NEAR_DUPLICATES = f"""WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 shingles AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM texts WHERE len(w) > 0),
 sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
 shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
 links AS (SELECT x, y FROM shared JOIN sizes a ON x = a.doc_id JOIN sizes b ON y = b.doc_id WHERE 100 * k >= 75 * (a.n + b.n - k)), {_reached('links')}
 SELECT texts.doc_id, coalesce(n, 0) AS n_shingles, coalesce(least, texts.doc_id) AS component_id, coalesce(least, texts.doc_id) = texts.doc_id AS kept
 FROM texts LEFT JOIN sizes ON texts.doc_id = sizes.doc_id LEFT JOIN least_id ON texts.doc_id = id"""
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_DECONTAMINATION = f"""WITH texts AS (SELECT doc_id, {_WORDS} AS w FROM documents), items AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)),
 windows AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i+n-1], ' '))) AS g FROM items WHERE n > 0),
 places AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM texts, (SELECT DISTINCT n FROM windows)),
 hits AS (SELECT doc_id, i, p.n, item_id FROM places p JOIN windows v ON p.n = v.n AND array_to_string(w[i:i+p.n-1], ' ') = g),
 words_hit AS (SELECT doc_id, count(DISTINCT spot) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS spot FROM hits) GROUP BY doc_id),
 items_hit AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
 SELECT t.doc_id, len(w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
 FROM texts t LEFT JOIN words_hit h ON t.doc_id = h.doc_id LEFT JOIN items_hit i ON t.doc_id = i.doc_id"""
_NEAR_VECTORS = f"""WITH RECURSIVE usable AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98), {_reached('links')}
 SELECT e.vec_id, coalesce(n, 0) AS n_links, coalesce(least, e.vec_id) AS component_id, coalesce(least, e.vec_id) = e.vec_id AS kept
 FROM embeddings e LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY x) c ON e.vec_id = x LEFT JOIN least_id ON e.vec_id = id"""
ORACLE_SQL: dict[str, str] = {
    "op4_secret_scan": secrets.oracle(), "op7_lsh_forest": _NEAR_DUPLICATES, "op8_decontamination": _DECONTAMINATION, "op9_pivot_permutations": _NEAR_VECTORS,
    "op11_word_runs": runs.oracle(_CRC32.format(hexed="hexed")),
    "op12_prefix_trie": tries.oracle(_CRC32.format(hexed="hexed")),
    "op13_minimax_shards": sharding.oracle(_CRC32.format(hexed="hexed")),
}
