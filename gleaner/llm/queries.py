"""Queries over whole tables, one for each operator of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import bpe, centroids, decontaminate, jaccard, langid, language_model, licenses, multi_index, neighbours, periodic, quality, suffix_dedup, toxicity
from gleaner.llm.textops import table

#: Files of the installed tokenizers; a parameter of the operators.
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), VOCABULARY)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.report(table(spark, sf_dir, "embeddings"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.clusters(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.report(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(table(spark, sf_dir, "documents"))


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.report(table(spark, sf_dir, "embeddings"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_quality": op2_quality,
    "op3_nearest": op3_nearest,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_decontaminate": op6_decontaminate,
    "op7_language_id": op7_language_id,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_language_model": op9_language_model,
    "op10_toxicity": op10_toxicity,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_near_vectors": op12_near_vectors,
    "op13_centroids": op13_centroids,
}
#: Shingle sets, links and components of op8 in DuckDB's SQL.
JACCARD_SQL = """WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s), e AS (SELECT doc_id, hash(unnest(s)) AS g FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id WHERE 100 * x.n >= 75 * y.n AND 100 * y.n >= 75 * x.n GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
both_ AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(id, r) AS (SELECT doc_id, doc_id FROM n UNION SELECT both_.b, reach.r FROM reach JOIN both_ ON both_.a = reach.id)
SELECT n.doc_id, n.n AS n_shingles, min(reach.r) AS component_id FROM n JOIN reach ON reach.id = n.doc_id GROUP BY n.doc_id, n.n"""

#: Runs of op11: matches of all lags, islands among those with enough, and what no smaller period covers.
PERIODIC_SQL = """WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
  CAST(xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS UBIGINT)), lambda crc, b: list_reduce(list_transform(range(8), lambda i: CAST(i AS UBIGINT)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS UBIGINT)) ELSE c // 2 END, xor(crc, b)), CAST(4294967295 AS UBIGINT)), CAST(4294967295 AS UBIGINT)) AS BIGINT) AS h FROM documents),
e AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
f AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM e),
x AS MATERIALIZED (SELECT doc_id, n, i, w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END] AS word FROM (SELECT *, unnest(range(n)) AS i FROM f)),
m AS MATERIALIZED (SELECT s.doc_id, s.i, t.i - s.i AS p FROM x s JOIN x t ON s.doc_id = t.doc_id AND s.word = t.word AND t.i > s.i AND t.i - s.i <= s.n // 3),
y AS (SELECT doc_id, p FROM m GROUP BY doc_id, p HAVING count(*) >= greatest(24 - p, 2 * p)),
z AS (SELECT m.doc_id, m.p, m.i, m.i - row_number() OVER (PARTITION BY m.doc_id, m.p ORDER BY m.i) AS grp FROM m SEMI JOIN y ON m.doc_id = y.doc_id AND m.p = y.p),
c AS MATERIALIZED (SELECT doc_id, p AS period, min(i) AS start, count(*) + p AS length FROM z GROUP BY doc_id, p, grp HAVING count(*) >= greatest(24 - p, 2 * p)),
r AS MATERIALIZED (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.doc_id = c.doc_id AND o.period < c.period AND c.period % o.period = 0 AND o.start <= c.start AND o.start + o.length >= c.start + c.length)),
q AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS listed, arg_min(struct_pack(s := start, l := length, p := period), struct_pack(x := -CAST(length AS HUGEINT) * 1000000000000000 // period, s := start, p := period)) AS best FROM r GROUP BY doc_id),
k AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) AS kept FROM x ANTI JOIN r ON r.doc_id = x.doc_id AND x.i >= r.start + r.period AND x.i < r.start + r.length GROUP BY x.doc_id)
SELECT d.doc_id, coalesce(q.n_runs, 0) AS n_runs, CAST(q.best.s AS BIGINT) AS start, CAST(q.best.l AS BIGINT) AS length, CAST(q.best.p AS BIGINT) AS period, CAST(1000 * q.best.l // q.best.p AS BIGINT) AS exponent_milli, sha256(coalesce(q.listed, '')) AS runs_sha256, sha256(coalesce(k.kept, '')) AS collapsed_sha256
FROM d LEFT JOIN q ON q.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id"""

#: All pairs of a label, and their components.
NEAR_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(id, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, reach.r FROM reach JOIN l ON l.a = reach.id),
c AS (SELECT id, min(r) AS c FROM reach GROUP BY id), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.c AS component_id, vec_id = c.c AS kept FROM embeddings JOIN c ON c.id = vec_id LEFT JOIN n ON n.a = vec_id"""


def _rounds(rounds: int) -> str:
    """Plain clustering: every round measures all distances."""
    parts = [
        "v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256(concat('3:', vec_id))) - 1 AS INTEGER) AS c, x AS y FROM v ORDER BY sha256(concat('3:', vec_id)) LIMIT 8)",
    ]
    for r in range(rounds + 1):
        far = "CAST(list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(x) AS x, min(struct_pack(d := {far}, c := c)) AS n FROM v, c{r} GROUP BY vec_id)")
        if r < rounds:
            parts.append(f"s{r} AS (SELECT c, i, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM (SELECT n.c AS c, unnest(x) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY c, i)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT o.c AS c, coalesce(l.y, o.y) AS y FROM c{r} o LEFT JOIN (SELECT c, list(m ORDER BY i) AS y FROM s{r} GROUP BY c) l ON l.c = o.c)")
    return "WITH " + ",\n".join(parts)


CENTROIDS_SQL = _rounds(centroids.ROUNDS) + f"""
SELECT vec_id, n.c AS cluster, n.d AS distance, CAST(sum(n.d) OVER (PARTITION BY n.c) AS BIGINT) AS cluster_inertia, CAST(sum(n.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(y, ',')) AS centroid_sha256
FROM a{centroids.ROUNDS} JOIN c{centroids.ROUNDS} f ON f.c = n.c"""

ORACLES: dict[str, str] = {"op8_jaccard_join": JACCARD_SQL, "op11_periodic_runs": PERIODIC_SQL, "op12_near_vectors": NEAR_SQL, "op13_centroids": CENTROIDS_SQL}
