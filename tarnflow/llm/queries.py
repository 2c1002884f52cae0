"""The subpackage's registered queries: whole tables, production parameters, whole results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .attribution import token_counts
from .classlm import score_documents
from .clustering import cluster_vectors
from .common import read_table
from .exact import exact_duplicates
from .mips import top_inner_products
from .mixing import mix
from .packing import pack_documents
from .pii import KINDS, personal_data
from .resampling import resample
from .simhash import near_duplicates
from .substring import remove_repeats
from .toxicity import toxicity


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op2_top_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(read_table(spark, sf_dir, "embeddings"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest are the base patterns' alone, which the contract fixes; `spans` has the tagger's too."""
    found = personal_data(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(F.col(f"n_base_{k}").alias(f"n_{k}") for k in KINDS), "base_sha256", "spans", "n_added")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read_table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(read_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_top_inner_products": op2_top_inner_products,
    "op3_mixing": op3_mixing,
    "op4_nearest": op4_nearest,
    "op5_packing": op5_packing,
    "op6_personal_data": op6_personal_data,
    "op7_simhash": op7_simhash,
    "op8_class_lm": op8_class_lm,
    "op9_toxicity": op9_toxicity,
    "op10_token_counts": op10_token_counts,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_centroid_clustering": op13_centroid_clustering,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _clustering_sql(rounds: int = 10) -> str:
    """Rounds written out one after the other; vectors as rows (vec_id, pos, x)."""
    parts = ["""
WITH kept AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
x AS MATERIALIZED (SELECT vec_id, p AS pos, v[p] AS x FROM kept, range(1, 65) r(p)),
seeds AS (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS cluster, v FROM (SELECT v, sha256('3:' || vec_id) AS h FROM kept ORDER BY h LIMIT 8)),
c0 AS MATERIALIZED (SELECT cluster, p AS pos, v[p] AS c FROM seeds, range(1, 65) r(p))"""]
    for n in range(rounds + 1):
        parts.append(f"""
d{n} AS (SELECT vec_id, cluster, sum((x - c) * (x - c)) AS d FROM x JOIN c{n} USING (pos) GROUP BY vec_id, cluster),
a{n} AS MATERIALIZED (SELECT vec_id, arg_min(cluster, d * 1000 + cluster) AS cluster, min(d) AS d FROM d{n} GROUP BY vec_id)""")
        if n < rounds:
            parts.append(f"""
m{n} AS (SELECT cluster, pos, sum(x) AS s, count(*) AS n FROM x JOIN a{n} USING (vec_id) GROUP BY cluster, pos),
c{n + 1} AS MATERIALIZED (SELECT c{n}.cluster, c{n}.pos, CASE WHEN n IS NULL THEN c ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS c FROM c{n} LEFT JOIN m{n} USING (cluster, pos))""")
    return ",".join(parts) + f""",
about AS (SELECT cluster, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY pos)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
SELECT vec_id, cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{rounds} JOIN about USING (cluster)"""


_WORDS = r"[^\x20\x09-\x0D]+"

#: Where SQL can express the whole result.  (Trained models, token ids, XXH64 and random rounding are beyond it.)
ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
first AS (SELECT k, min(doc_id) AS least FROM windows GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM windows JOIN first USING (k), range(13) r(j) WHERE least < doc_id),
placed AS (SELECT doc_id, p, list_extract(ws, p) AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op2_top_inner_products": """
WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op11_exact_dedup": f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM t JOIN g USING (t)""",
    # CRC-32 by its table of 256 registers, byte by byte.
    "op12_importance_resampling": rf"""
WITH registers AS (SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
w AS (SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
  UNION ALL SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (SELECT side, id, unnest(list_concat(ws, [ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))])) AS f FROM w),
n AS MATERIALIZED (SELECT side, id, f, count(*) AS n FROM f GROUP BY side, id, f),
h AS (SELECT f, xor(list_reduce(list_prepend(4294967295, [CAST('0x' || hex(encode(f))[i : i + 1] AS BIGINT) FOR i IN range(1, 2 * strlen(f), 2)]), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM n), registers),
s AS (SELECT bucket, sum(n) FILTER (WHERE side = 'd') AS s, sum(n) FILTER (WHERE side = 'b') AS t FROM n JOIN h USING (f) GROUP BY bucket),
total AS (SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) AS s_all, CAST(coalesce(sum(t), 0) AS DOUBLE) AS t_all FROM s),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (s_all + 10000) / ((coalesce(s, 0) + 1.0::DOUBLE) * (t_all + 10000)))) AS BIGINT) AS gain FROM s, total),
weights AS (SELECT id, sum(gain * n) AS g, sum(n) AS n FROM n JOIN h USING (f) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY id),
scored AS (SELECT w.id AS doc_id, len(ws) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce((g - ((g % n) + n) % n) // n, 0) AS BIGINT) AS weight,
  CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('7:' || w.id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS noise FROM w LEFT JOIN weights USING (id) WHERE side = 'd'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY weight + noise DESC, doc_id) AS r, 25 * count(*) FILTER (WHERE n_words >= 20) OVER () // 100 AS taken FROM scored)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN n_words >= 20 AND r <= taken THEN r END AS rank FROM ranked""",
    "op13_centroid_clustering": _clustering_sql(),
}
