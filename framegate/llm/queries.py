"""The registered query of each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from framegate.llm import (
    audit,
    fingerprints,
    language,
    licenses,
    mixing,
    packing,
    quality,
    resampling,
    sharding,
    simhash,
    substring,
    tokens,
    vectors,
)
from framegate.llm.common import read, text_or_empty

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_json(name: str = "byte_bpe_50k.json") -> str:
    """The vocabulary's text, which travels to the executors with the job."""
    return Path(public_tokenizers.path(name)).read_text()


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(read(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a
), c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM p GROUP BY a)
SELECT c.vec_id, coalesce(n_links, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.classify(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.mix(read(spark, sf_dir, "documents"))
    names = {f"__{n}": n for n in ("tokens", "epoch", "block", "slot")}
    return drawn.withColumnsRenamed(names)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs)).select("doc_id", "held_out", "lang_pred", "score", "shares", "known")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_print().alias("fingerprint"), "component_id")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(read(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_json()).drop("ids")


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(read(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(read(spark, sf_dir, "documents"))
    words = F.filter(F.split("left", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.array_join(words, " "), 256).alias("kept_sha256"))


OP9_SQL = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents
), g AS (
  SELECT doc_id, i, md5(array_to_string(words[i : i + 49], ' ')) AS h FROM w, unnest(range(1, len(words) - 48)) AS t(i)
), r AS (
  SELECT g.doc_id, list(g.i ORDER BY g.i) AS starts FROM g JOIN (SELECT h, min(doc_id) AS first FROM g GROUP BY h) m USING (h)
  WHERE m.first < g.doc_id GROUP BY g.doc_id
), s AS (
  SELECT doc_id, list_distinct(flatten(list_transform(starts, lambda x: range(x, x + 50)))) AS gone FROM r
), k AS (
  SELECT w.doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed,
    CASE WHEN gone IS NULL THEN words ELSE list_select(words, list_sort(list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(gone, i)))) END AS kept
  FROM w LEFT JOIN s USING (doc_id)
)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(read(spark, sf_dir, "documents"))
    crc = F.crc32(text_or_empty()).alias("text_crc32")
    return placed.select("doc_id", "size", crc, F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP11_SQL = """
WITH texts AS (
  SELECT 0 AS target, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT 1, item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), words AS (
  SELECT target, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), features AS (
  SELECT target, id, unnest(w) AS f FROM words
  UNION ALL SELECT target, id, w[i] || ' ' || w[i + 1] FROM words, unnest(range(1, len(w))) AS p(i)
), counted AS (SELECT target, id, f, count(*) AS n FROM features GROUP BY ALL),
bytes AS (
  SELECT f, list_transform(range(1, 2 * strlen(f), 2), lambda i: ('0x' || substr(hex(encode(f)), i, 2))::BIGINT) AS b
  FROM (SELECT DISTINCT f FROM counted)
), hashed AS (
  SELECT f, xor(list_reduce(b, lambda c, x: list_reduce(range(8), lambda y, k: xor(y >> 1, 3988292384 * (y & 1)), xor(c, x)), 4294967295::BIGINT),
    4294967295::BIGINT) % 10000 AS bucket FROM bytes
), per_doc AS (SELECT target, id, bucket, sum(n)::BIGINT AS n FROM counted JOIN hashed USING (f) GROUP BY ALL),
raw AS (SELECT bucket, sum(n) AS s FROM per_doc WHERE target = 0 GROUP BY bucket),
wanted AS (SELECT bucket, sum(n) AS t FROM per_doc WHERE target = 1 GROUP BY bucket),
sums AS (SELECT coalesce((SELECT sum(s) FROM raw), 0)::DOUBLE AS s, coalesce((SELECT sum(t) FROM wanted), 0)::DOUBLE AS t),
gain AS (
  SELECT raw.bucket, floor(1000 * ln((coalesce(wanted.t, 0) + 1)::DOUBLE * (sums.s + 10000) / ((raw.s + 1)::DOUBLE * (sums.t + 10000))))::BIGINT AS g
  FROM raw LEFT JOIN wanted USING (bucket), sums
), weights AS (
  SELECT id, sum(n)::BIGINT AS n_features, (sum(n * g) - ((sum(n * g) % sum(n)) + sum(n)) % sum(n))::BIGINT // sum(n)::BIGINT AS weight
  FROM per_doc JOIN gain USING (bucket) WHERE target = 0 GROUP BY id
), scored AS (
  SELECT id AS doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (id) WHERE target = 0
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 25 * n // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_filters(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


OP12_SQL = """
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), marks AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), failing AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(w) < 50 AS a,
    100 * len(list_distinct(w)) < 65 * len(w) AS b, 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * len(t) AS c,
    regexp_matches(t, '[#$%&*|]') AS d, min(docs.doc_id) OVER (PARTITION BY t) < docs.doc_id AS e
  FROM docs LEFT JOIN marks USING (doc_id)
), masks AS (
  SELECT part, a, b, c, d, e, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failing GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS o FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), placed AS (
  SELECT masks.*, o, step, substr(o, step::INT, 1) AS f, least(
    CASE WHEN a THEN instr(o, 'A') ELSE 9 END, CASE WHEN b THEN instr(o, 'B') ELSE 9 END, CASE WHEN c THEN instr(o, 'C') ELSE 9 END,
    CASE WHEN d THEN instr(o, 'D') ELSE 9 END, CASE WHEN e THEN instr(o, 'E') ELSE 9 END) AS goes
  FROM masks, orders, unnest(range(1, 6)) AS u(step)
), judged AS (
  SELECT *, CASE f WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS fails,
    a::INT + b::INT + c::INT + d::INT + e::INT AS failed FROM placed
), summed AS (
  SELECT part, o, step, f, coalesce(sum(n) FILTER (goes > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (goes = step), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails AND goes < step), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails AND failed = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (goes = step), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (goes = step), 0)::BIGINT AS toxic_lost
  FROM judged GROUP BY part, o, step, f
)
SELECT part, o AS filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM summed
"""


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read(spark, sf_dir, "documents"), tokenizer_json("word_bpe_49k.json"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup,
        op2_quality_classifier,
        op3_source_mixing,
        op4_language_id,
        op5_simhash_near_dedup,
        op6_license_scan,
        op7_best_fit_packing,
        op8_document_fingerprints,
        op9_substring_dedup,
        op10_sharding,
        op11_importance_resampling,
        op12_filter_audit,
        op13_token_counts,
    )
}
ORACLES: dict[str, str] = {
    "op1_embedding_near_dedup": OP1_SQL,
    "op9_substring_dedup": OP9_SQL,
    "op11_importance_resampling": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
}
