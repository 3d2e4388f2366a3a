"""All queries of the library by name, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.functions import geometry as G
from gleaner.functions import hashing as H
from gleaner.functions import text as X
from gleaner.operators import collect as C
from gleaner.operators import corpus as O
from gleaner.operators import documents as D
from gleaner.operators import layout as L
from gleaner.operators.components import connected, unions
from gleaner.operators.storage import shared_folder, written
from gleaner.sources import files, html, labelstudio, layouts, versions
from gleaner.sources.tables import table
from gleaner.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


#: Text functions in DuckDB's dialect.
S_SPACE = re.sub(r"\\u([0-9a-f]{4})", r"\\x{{\1}}", X.SPACE).replace("\\x85\\xa0", "\\x{{85}}\\x{{a0}}")
S_STRIP = f"regexp_replace({{}}, '^[{S_SPACE}]+|[{S_SPACE}]+$', '', 'g')"
S_PREP = f"regexp_replace(regexp_replace(regexp_replace(lower({{}}), '[{S_SPACE}]+', ' ', 'g'), '[^\\p{{{{L}}}}\\p{{{{N}}}}_ ]', '', 'g'), '^ +| +$', '', 'g')"
S_WORDS = f"list_filter(string_split_regex({{}}, '[{S_SPACE}]+'), lambda w: w <> '')"
S_WORD3 = f"""CASE WHEN len({{w}}) = 0 THEN CAST([] AS VARCHAR[]) WHEN len({{w}}) < 3 THEN [array_to_string({{w}}, ' ')]
  ELSE list_distinct(list_transform(range(1, len({{w}}) - 1), lambda i: array_to_string(list_slice({{w}}, i, i + 2), ' '))) END"""

PERM, BANDS, SIMILAR = 128, 16, 0.7


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


# --- exact duplicates, text preparation -------------------------------------------------------------------------------

@query("exact_dedup", "SELECT doc_id, kept AS kept_id, doc_id > kept AS dropped FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS kept FROM documents)")
def exact_dedup(spark, d):
    rows = O.first_of_equal(docs(spark, d), O.content_key(F.col("text")), "doc_id")
    return rows.select("doc_id", F.col("kept").alias("kept_id"), (F.col("doc_id") > F.col("kept")).alias("dropped"))


@query("dedup_metrics", "SELECT count(*) AS processed, count(*) - count(DISTINCT md5(text)) AS duplicates, round((count(*) - count(DISTINCT md5(text))) / count(*), 6) AS dedup_ratio FROM documents")
def dedup_metrics(spark, d):
    rows = exact_dedup(spark, d)
    gone = F.count_if("dropped")
    return rows.agg(F.count("*").alias("processed"), gone.alias("duplicates"), F.round(F.coalesce(F.try_divide(gone, F.count("*")), F.lit(0.0)), 6).alias("dedup_ratio"))


@query("fingerprint_dedup", "SELECT min(doc_id) AS first_id, sha256(text) AS fingerprint, count(*) AS copies FROM documents GROUP BY 2")
def fingerprint_dedup(spark, d):
    return docs(spark, d).groupBy(F.sha2("text", 256).alias("fingerprint")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


@query("preprocess_text", f"SELECT doc_id, md5({S_PREP.format('text')}) AS prepared FROM documents")
def preprocess_text(spark, d):
    return docs(spark, d).select("doc_id", F.md5(X.preprocess(F.col("text"))).alias("prepared"))


@query("char_shingle_count", f"""WITH t AS MATERIALIZED (SELECT doc_id, {S_STRIP.format('lower(text)')} AS s FROM documents)
SELECT doc_id, CAST(CASE WHEN length(s) = 0 THEN 0 WHEN length(s) < 5 THEN 1 ELSE (SELECT count(DISTINCT substring(s, i, 5)) FROM range(1, length(s) - 3) r(i)) END AS BIGINT) AS n FROM t""")
def char_shingle_count(spark, d):
    return docs(spark, d).select("doc_id", F.size(X.char_shingles(F.col("text"), 5)).cast("long").alias("n"))


@query("word_shingle_count", f"WITH t AS (SELECT doc_id, {S_WORDS.format('lower(text)')} AS w FROM documents) SELECT doc_id, len({S_WORD3.format(w='w')}) AS n FROM t")
def word_shingle_count(spark, d):
    return docs(spark, d).select("doc_id", F.size(X.word_shingles(F.col("text"), 3)).cast("long").alias("n"))


@query("jaccard_pairs", f"""WITH t AS (SELECT doc_id, {S_WORDS.format('lower(text)')} AS w FROM documents), s AS (SELECT doc_id, {S_WORD3.format(w='w')} AS g FROM t)
SELECT a.doc_id AS a, b.doc_id AS b, round(CASE WHEN len(a.g) = 0 AND len(b.g) = 0 THEN 1.0 WHEN len(a.g) = 0 OR len(b.g) = 0 THEN 0.0 ELSE len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) END, 6) AS jaccard
FROM s a JOIN s b ON b.doc_id = a.doc_id + 1""")
def jaccard_pairs(spark, d):
    s = docs(spark, d).select("doc_id", X.word_shingles(F.col("text"), 3).alias("g"))
    a, b = s.select(F.col("doc_id").alias("a"), F.col("g").alias("ga")), s.select(F.col("doc_id").alias("b"), F.col("g").alias("gb"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(X.jaccard(F.col("ga"), F.col("gb")), 6).alias("jaccard"))


# --- MinHash ----------------------------------------------------------------------------------------------------------

def _perm_values() -> str:
    a, b = H.permutations(PERM)
    return ", ".join(f"({i}, {x}, {y})" for i, (x, y) in enumerate(zip(a, b)))


def _sig_sql(source: str, id: str) -> str:
    return f"""perms(p, a, b) AS (VALUES {_perm_values()}),
w AS (SELECT {id} AS id, {S_WORDS.format(S_PREP.format('text'))} AS w FROM {source}),
g AS (SELECT id, unnest({S_WORD3.format(w='w')}) AS s FROM w),
v AS (SELECT DISTINCT id, CAST(CAST('0x' || substr(sha1(s), 1, 16) AS UBIGINT) AS HUGEINT) AS v FROM g),
sig AS (SELECT id, p, CAST(min(((CAST(a AS HUGEINT) * v + b) % 2305843009213693951) % 4294967296) AS BIGINT) AS m FROM v, perms GROUP BY id, p),
full_sig AS (SELECT w.id, perms.p, coalesce(sig.m, 4294967295) AS m FROM w CROSS JOIN perms LEFT JOIN sig ON sig.id = w.id AND sig.p = perms.p)"""


_BAND_SQL = """bands AS (SELECT id, p // 8 AS band, string_agg(m::VARCHAR, ',' ORDER BY p) AS k FROM full_sig GROUP BY id, p // 8)"""
_PAIR_SQL = """cand AS (SELECT DISTINCT l.id AS a, r.id AS b FROM bands l JOIN bands r USING (band, k) WHERE l.id < r.id),
pairs AS (SELECT a, b, count(*) FILTER (WHERE x.m = y.m) / 128 AS sim FROM cand JOIN full_sig x ON x.id = a JOIN full_sig y ON y.id = b AND y.p = x.p GROUP BY a, b HAVING count(*) FILTER (WHERE x.m = y.m) / 128 >= 0.7)"""
_CLASS_SQL = """rep AS (SELECT id, min(id) OVER (PARTITION BY k) AS rep FROM (SELECT id, string_agg(m::VARCHAR, ',' ORDER BY p) AS k FROM full_sig GROUP BY id))"""
_CLUSTER_SQL = """reach(id, r) AS (SELECT id, id FROM w UNION SELECT e.y, reach.r FROM reach JOIN (SELECT a AS x, b AS y FROM pairs UNION ALL SELECT b, a FROM pairs) e ON e.x = reach.id),
clusters AS (SELECT id, min(r) AS label FROM reach GROUP BY id)"""


def _shingles(text: Column) -> Column:
    return X.word_shingles(X.preprocess(text), 3, distinct=False)  # minima of a set don't need its items once


def _sigs(spark, d) -> DataFrame:
    return O.signatures(docs(spark, d), "text", _shingles, "doc_id", PERM)


def _written_sigs(spark, d) -> DataFrame:
    return written(_sigs(spark, d), "signatures")[0]


@query("minhash_signature", f"WITH {_sig_sql('documents', 'doc_id')} SELECT id AS doc_id, md5(string_agg(m::VARCHAR, ',' ORDER BY p)) AS signature FROM full_sig GROUP BY id")
def minhash_signature(spark, d):
    return _sigs(spark, d).select(F.col("id").alias("doc_id"), F.md5(F.array_join(F.col("sig").cast("array<string>"), ",")).alias("signature"))


@query("lsh_bands", f"WITH {_sig_sql('documents', 'doc_id')}, {_BAND_SQL} SELECT band, md5(k) AS bucket, count(*) AS members FROM bands GROUP BY band, k")
def lsh_bands(spark, d):
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.md5(F.array_join(F.slice(F.col("sig"), i * 8 + 1, 8).cast("array<string>"), ",")))
    return _sigs(spark, d).select(F.posexplode(keys).alias("band", "bucket")).groupBy(F.col("band").cast("long").alias("band"), "bucket").agg(F.count("*").alias("members"))


@query("lsh_index_stats", f"WITH {_sig_sql('documents', 'doc_id')}, {_BAND_SQL} SELECT (SELECT count(*) FROM w) AS documents, (SELECT count(*) FROM (SELECT DISTINCT band, k FROM bands)) AS total_buckets, round((SELECT count(*) FROM w) / (SELECT count(*) FROM (SELECT DISTINCT band, k FROM bands)), 6) AS avg_bucket_size")
def lsh_index_stats(spark, d):
    b = O.bands(_sigs(spark, d), PERM, BANDS).groupBy("band", "bucket").agg(F.count("*").alias("n"))
    t = b.agg((F.sum("n") / BANDS).cast("long").alias("documents"), F.count("*").alias("total_buckets"))
    return t.withColumn("avg_bucket_size", F.round(F.try_divide("documents", "total_buckets"), 6))


@query("lsh_similar_pairs", f"WITH {_sig_sql('documents', 'doc_id')}, {_BAND_SQL}, {_PAIR_SQL}, {_CLASS_SQL} SELECT a, b, sim FROM pairs JOIN rep x ON x.id = a AND x.rep = a JOIN rep y ON y.id = b AND y.rep = b UNION ALL SELECT rep, id, 1.0 FROM rep WHERE rep <> id")
def lsh_similar_pairs(spark, d):
    return O.similar_pairs(_written_sigs(spark, d), SIMILAR, PERM, BANDS).orderBy(F.desc("sim"), "a", "b")


@query("near_dup_clusters", f"WITH RECURSIVE {_sig_sql('documents', 'doc_id')}, {_BAND_SQL}, {_PAIR_SQL}, {_CLUSTER_SQL} SELECT id AS doc_id, label AS cluster_id FROM clusters")
def near_dup_clusters(spark, d):
    out = O.near_duplicate_clusters(docs(spark, d), "text", _shingles, "doc_id", SIMILAR, PERM, BANDS)
    return out.select(F.col("id").alias("doc_id"), F.col("label").alias("cluster_id"))


@query("near_dup_keep_first", f"WITH RECURSIVE {_sig_sql('documents', 'doc_id')}, {_BAND_SQL}, {_PAIR_SQL}, {_CLUSTER_SQL} SELECT label AS doc_id, count(*) AS cluster_size FROM clusters GROUP BY label")
def near_dup_keep_first(spark, d):
    return near_dup_clusters(spark, d).groupBy(F.col("cluster_id").alias("doc_id")).agg(F.count("*").alias("cluster_size"))


@query("greedy_near_dup", f"""WITH RECURSIVE {_sig_sql('documents', 'doc_id')}, {_BAND_SQL}, {_PAIR_SQL}, n AS (SELECT b, list(a) AS earlier FROM pairs GROUP BY b),
o AS (SELECT w.id, row_number() OVER (ORDER BY w.id) AS r, coalesce(earlier, CAST([] AS BIGINT[])) AS earlier FROM w LEFT JOIN n ON n.b = w.id),
steps(r, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT o.r, CASE WHEN list_has_any(steps.kept, o.earlier) THEN steps.kept ELSE list_append(steps.kept, o.id) END FROM steps JOIN o ON o.r = steps.r + 1)
SELECT id AS doc_id, list_contains((SELECT kept FROM steps ORDER BY r DESC LIMIT 1), id) AS kept FROM w""")
def greedy_near_dup(spark, d):
    return O.greedy_near_duplicates(_written_sigs(spark, d), SIMILAR, PERM, BANDS).select(F.col("id").alias("doc_id"), "kept")


@query("near_dup_metrics", f"SELECT count(*) AS processed, count(*) FILTER (WHERE NOT kept) AS duplicates_found, round(count(*) FILTER (WHERE NOT kept) / count(*), 6) AS dedup_ratio FROM ({ORACLES['greedy_near_dup']})")
def near_dup_metrics(spark, d):
    gone = F.count_if(~F.col("kept"))
    return greedy_near_dup(spark, d).agg(F.count("*").alias("processed"), gone.alias("duplicates_found"), F.round(F.coalesce(F.try_divide(gone, F.count("*")), F.lit(0.0)), 6).alias("dedup_ratio"))


@query("lsh_topk_query", f"""WITH {_sig_sql('documents', 'doc_id')}, {_BAND_SQL},
hits AS (SELECT DISTINCT q.id AS q, r.id AS id FROM bands q JOIN bands r USING (band, k) WHERE q.id % 20 = 0 AND q.id <> r.id),
scored AS (SELECT q, hits.id, count(*) FILTER (WHERE x.m = y.m) / 128 AS sim FROM hits JOIN full_sig x ON x.id = q JOIN full_sig y ON y.id = hits.id AND y.p = x.p GROUP BY q, hits.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, id) AS rank FROM scored)
SELECT q AS query_id, id AS doc_id, sim, rank FROM ranked WHERE rank <= 3""")
def lsh_topk_query(spark, d):
    sigs = _written_sigs(spark, d)
    got = O.query_index(sigs.where("id % 20 = 0"), sigs, 3, PERM, BANDS)
    return got.select("query_id", F.col("id").alias("doc_id"), "sim", F.col("rank").cast("long").alias("rank"))


@query("idempotent_add", "SELECT id, text FROM (SELECT user_id AS id, event_type AS text, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r = 1")
def idempotent_add(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("text"), "event_id")
    return O.add_once(e, "id", "event_id").select("id", "text")


@query("minhash_accuracy")
def minhash_accuracy(spark, d):
    """Estimates of neighbouring documents' similarity against the exact one, by signature size; the hash family has no SQL form."""
    t = docs(spark, d).select("doc_id", "text")
    return O.accuracy_study(t, "text", _shingles, F.floor(F.col("doc_id") / 2), "doc_id", [16, 64], range(2))


@query("lsh_probability", f"SELECT a, b, round(1 - pow(1 - pow(jaccard, 8), 16), 6) AS probability FROM ({ORACLES['jaccard_pairs']})")
def lsh_probability(spark, d):
    """How likely it is that neighbouring documents, by their exact similarity, share a bucket."""
    s = F.col("jaccard")
    return jaccard_pairs(spark, d).select("a", "b", F.round(1 - F.pow(1 - F.pow(s, F.lit(8)), F.lit(16)), 6).alias("probability"))


# --- Bloom ------------------------------------------------------------------------------------------------------------

BLOOM_M, BLOOM_K = H.bloom_size(20_000, 0.01)


def _md5_sql(item: str, m: int) -> str:
    h = f"md5(i::VARCHAR || ':' || {item})"
    value = "0"
    for k in range(4):
        value = f"(({value}) * 4294967296 % {m} + CAST('0x' || substr({h}, {8 * k + 1}, 8) AS BIGINT)) % {m}"
    return value


_BITS_SQL = f"SELECT DISTINCT {_md5_sql('url', BLOOM_M)} AS p FROM pages, range(0, {BLOOM_K}) r(i)"


@query("bloom_positions", f"SELECT page_id, i AS hash, {_md5_sql('url', BLOOM_M)} AS pos FROM pages, range(0, {BLOOM_K}) r(i)")
def bloom_positions(spark, d):
    return table(spark, d, "pages").select("page_id", F.posexplode(H.bloom_positions(F.col("url"), BLOOM_M, BLOOM_K)).alias("hash", "pos")).withColumn("hash", F.col("hash").cast("long"))


@query("bloom_contains", f"""WITH bits AS ({_BITS_SQL}), probes AS (SELECT DISTINCT url AS item FROM pages UNION SELECT DISTINCT lower(url) || '/' FROM pages)
SELECT item, bool_and(bits.p IS NOT NULL) AS maybe FROM (SELECT item, {_md5_sql('item', BLOOM_M)} AS q FROM probes, range(0, {BLOOM_K}) r(i)) LEFT JOIN bits ON bits.p = q GROUP BY item""")
def bloom_contains(spark, d):
    pages = table(spark, d, "pages")
    bloom = O.bloom_build(pages, "url", BLOOM_M, BLOOM_K)
    probes = pages.select(F.col("url").alias("item")).union(pages.select(F.concat(F.lower("url"), F.lit("/")))).distinct()
    return O.bloom_contains(probes, "item", bloom, BLOOM_M, BLOOM_K)


@query("bloom_stats", f"""WITH bits AS ({_BITS_SQL}), n AS (SELECT count(*) AS n FROM pages)
SELECT {BLOOM_M} AS bits, {BLOOM_K} AS hashes, n AS inserted, (SELECT count(*) FROM bits) AS ones, round((SELECT count(*) FROM bits) / {BLOOM_M}, 6) AS fill_ratio, round(pow(1 - exp(-{BLOOM_K} * n / {BLOOM_M}), {BLOOM_K}), 6) AS estimated_fpr, {(BLOOM_M + 7) // 8} AS memory_bytes FROM n""")
def bloom_stats(spark, d):
    pages = table(spark, d, "pages")
    return O.bloom_stats(O.bloom_build(pages, "url", BLOOM_M, BLOOM_K), pages.count(), BLOOM_M, BLOOM_K)


@query("safe_lookup", """WITH probes AS (SELECT DISTINCT url AS item FROM pages UNION SELECT DISTINCT lower(url) || '/' FROM pages) SELECT item, item IN (SELECT url FROM pages WHERE page_id % 3 = 0) AS found FROM probes""")
def safe_lookup(spark, d):
    pages = table(spark, d, "pages")
    store = pages.where("page_id % 3 = 0")
    probes = pages.select(F.col("url").alias("item")).union(pages.select(F.concat(F.lower("url"), F.lit("/")))).distinct()
    return O.safe_lookup(probes, "item", O.bloom_build(store, "url", BLOOM_M, BLOOM_K), BLOOM_M, BLOOM_K, store, "url").select("item", "found")


@query("bloom_capacity", f"SELECT n AS inserted, pow(1 - exp(-{BLOOM_K} * n / {BLOOM_M}), {BLOOM_K}) <= 0.1 AS ok FROM (SELECT count(*) AS n FROM pages)")
def bloom_capacity(spark, d):
    pages = table(spark, d, "pages")
    return O.has_capacity(O.bloom_stats(O.bloom_build(pages, "url", BLOOM_M, BLOOM_K), pages.count(), BLOOM_M, BLOOM_K)).select("inserted", "ok")


@query("counting_bloom_results", f"""WITH up_all AS (SELECT DISTINCT {_md5_sql('url', BLOOM_M)} AS pos FROM pages, range(0, {BLOOM_K}) r(i) WHERE page_id % 2 = 0),
asked AS (SELECT DISTINCT url AS item FROM pages) SELECT item, bool_and(pos IS NOT NULL) AS removed FROM (SELECT item, {_md5_sql('item', BLOOM_M)} AS q FROM asked, range(0, {BLOOM_K}) r(i)) LEFT JOIN up_all ON pos = q GROUP BY item""")
def counting_bloom_results(spark, d):
    pages = table(spark, d, "pages")
    _, asked = O.counting_removals(pages.where("page_id % 2 = 0"), pages.select("url").distinct(), "url", BLOOM_M, BLOOM_K)
    return asked.select("item", "removed")


@query("counting_bloom_remove", f"""WITH up AS (SELECT {_md5_sql('url', BLOOM_M)} AS pos, count(*) AS c FROM pages, range(0, {BLOOM_K}) r(i) GROUP BY 1),
down AS (SELECT {_md5_sql('url', BLOOM_M)} AS pos, count(*) AS c FROM (SELECT DISTINCT url FROM pages WHERE url LIKE 'https%'), range(0, {BLOOM_K}) r(i) GROUP BY 1)
SELECT up.pos, greatest(0, up.c - coalesce(down.c, 0)) AS cnt FROM up LEFT JOIN down USING (pos) WHERE up.c - coalesce(down.c, 0) > 0""")
def counting_bloom_remove(spark, d):
    pages = table(spark, d, "pages")
    return O.counting_bloom(pages, pages.where("url LIKE 'https%'").select("url").distinct(), "url", BLOOM_M, BLOOM_K)


SMALL_M, SMALL_K = H.bloom_size(150, 0.1)


@query("bloom_first_seen", f"""WITH RECURSIVE u AS MATERIALIZED (SELECT page_id, row_number() OVER (ORDER BY page_id) AS r, list_distinct(list_transform(range({SMALL_K}), lambda i: {_md5_sql("regexp_replace(lower(url), '/+$', '')", SMALL_M)})) AS q FROM (SELECT page_id, url FROM pages UNION ALL SELECT page_id + 1000000000, upper(url) || '/' FROM pages)),
steps(r, bits, page_id, seen) AS (SELECT CAST(0 AS BIGINT), list_transform(range({SMALL_M}), lambda i: 0), CAST(NULL AS BIGINT), false
UNION ALL SELECT u.r, CASE WHEN list_min(list_transform(u.q, lambda p: s.bits[p + 1])) = 1 THEN s.bits ELSE list_transform(s.bits, lambda x, i: CASE WHEN list_contains(u.q, i - 1) THEN 1 ELSE x END) END, u.page_id, list_min(list_transform(u.q, lambda p: s.bits[p + 1])) = 1 FROM steps s JOIN u ON u.r = s.r + 1)
SELECT page_id, seen FROM steps WHERE r > 0""")
def bloom_first_seen(spark, d):
    """Probe, then add: a filter too small for its items, so that some new ones count as seen."""
    p = table(spark, d, "pages")
    u = p.select("page_id", "url").union(p.select(F.col("page_id") + 1000000000, F.concat(F.upper("url"), F.lit("/"))))
    return O.bloom_first_seen(u.withColumn("url", X.normalize_url(F.col("url"))), "url", "page_id", SMALL_M, SMALL_K).select("page_id", "seen")


@query("url_dedup", "WITH u AS (SELECT page_id AS ord, url FROM pages UNION ALL SELECT page_id + 1000000000, upper(url) || '/' FROM pages) SELECT regexp_replace(lower(url), '/+$', '') AS url, min(ord) AS first_ord, count(*) AS seen FROM u GROUP BY 1")
def url_dedup(spark, d):
    p = table(spark, d, "pages")
    u = p.select(F.col("page_id").alias("ord"), "url").union(p.select(F.col("page_id") + 1000000000, F.concat(F.upper("url"), F.lit("/"))))
    return u.groupBy(X.normalize_url(F.col("url")).alias("url")).agg(F.min("ord").alias("first_ord"), F.count("*").alias("seen"))


# --- substrings, words, vocabularies ----------------------------------------------------------------------------------

@query("word_freq_topk", f"SELECT w AS word, count(*) AS cnt FROM (SELECT unnest({S_WORDS.format('lower(text)')}) AS w FROM documents) GROUP BY w ORDER BY cnt DESC, w LIMIT 50")
def word_freq_topk(spark, d):
    return docs(spark, d).select(F.explode(X.words(F.lower("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "word").limit(50)


@query("bigram_top", """WITH b AS (SELECT doc_id, i, substring(text, i, 2) AS bigram FROM documents, range(1, 200000) r(i) WHERE i < length(text)),
c AS (SELECT doc_id, bigram, count(*) AS cnt, min(i) AS f FROM b WHERE NOT contains(bigram, ' ') GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, f) AS n FROM c)
SELECT d.doc_id, bigram, cnt FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id AND n = 1""")
def bigram_top(spark, d):
    return O.frequent_bigram(docs(spark, d), "doc_id")


@query("repeated_substrings", """WITH p AS (SELECT item_id, text, unnest(range(1, length(text))) AS i FROM benchmark WHERE length(text) > 1), q AS (SELECT item_id, text, i, unnest(range(2, least(length(text) - i + 2, length(text)))) AS k FROM p)
SELECT item_id, substring(text, i, k) AS substring, count(*) AS cnt FROM q GROUP BY 1, 2 HAVING count(*) >= 2""")
def repeated_substrings(spark, d):
    got = O.repeated_substrings(table(spark, d, "benchmark"), "item_id", "text", 2)
    return got.orderBy("item_id", F.desc("cnt"), F.desc(F.length("substring")), "substring")


def _sa_sql(source: str, key: str, text: str) -> str:
    return f"""s AS (SELECT {key}, {text} AS t, pos, substring({text}, pos + 1) AS s FROM (SELECT *, unnest(range(0, length({text}))) AS pos FROM {source})),
o AS (SELECT {key}, t, pos, s, row_number() OVER w - 1 AS sa_rank, lag(s) OVER w AS b, lag(pos) OVER w AS before FROM s WINDOW w AS (PARTITION BY {key} ORDER BY s)),
sa AS (SELECT {key}, t, pos, s, sa_rank, before, CASE WHEN b IS NULL THEN 0 ELSE len(list_filter(range(1, least(length(s), length(b)) + 1), lambda k: substring(s, 1, k) = substring(b, 1, k))) END AS lcp FROM o)"""


@query("suffix_array_lcp", f"WITH {_sa_sql('benchmark', 'item_id', 'text')} SELECT item_id, sa_rank, pos, lcp FROM sa")
def suffix_array_lcp(spark, d):
    return O.suffix_array(table(spark, d, "benchmark"), "item_id")


@query("longest_repeated_substring", f"WITH {_sa_sql('benchmark', 'item_id', 'text')}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY lcp DESC, sa_rank) AS n FROM sa) SELECT item_id, substring(s, 1, lcp) AS lrs FROM r WHERE n = 1")
def longest_repeated_substring(spark, d):
    return O.longest_repeated_substring(table(spark, d, "benchmark"), "item_id")


@query("longest_repeat_of_documents")
def longest_repeat_of_documents(spark, d):
    """Over whole documents SQL would need a row for every suffix with its text; tests compare with brute force."""
    return O.longest_repeated_substring(docs(spark, d), "doc_id")


@query("common_substrings", f"""WITH c AS (SELECT a.item_id, length(a.text) AS n, a.text || '#' || b.text || '$' AS t FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1), {_sa_sql('c', 'item_id, n', 't')},
f AS (SELECT item_id, substring(s, 1, lcp) AS x, sa_rank FROM sa WHERE lcp >= 6 AND (before < n) <> (pos < n))
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY sa_rank) - 1 AS ord, x AS substring FROM f WHERE NOT contains(x, '#') AND NOT contains(x, '$')""")
def common_substrings(spark, d):
    b = table(spark, d, "benchmark")
    pairs = b.withColumnRenamed("text", "a").join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("b")), "item_id")
    return O.common_substrings(pairs, "item_id", "a", "b", 6)


def _grams_sql(source: str, id: str) -> str:
    later = ", ".join(f"lead(x, {k}) OVER v" for k in range(1, 8))
    return f"""SELECT DISTINCT {id}, g FROM (SELECT {id}, concat_ws(' ', x, {later}) AS g, lead(x, 7) OVER v IS NOT NULL AS whole
FROM (SELECT {id}, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM (SELECT {id}, {S_WORDS.format('lower(text)')} AS w FROM {source})) WINDOW v AS (PARTITION BY {id} ORDER BY i)) WHERE whole"""


@query("ngram_containment", f"WITH g AS ({_grams_sql('benchmark', 'item_id')}), t AS ({_grams_sql('documents', 'doc_id')}) SELECT item_id, doc_id, count(*) AS shared FROM g JOIN t USING (g) GROUP BY 1, 2")
def ngram_containment(spark, d):
    grams = lambda df, k: df.select(k, X.words(F.lower("text")).alias("w")).where(F.size("w") >= 8).select(k, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 7), lambda i: F.array_join(F.slice(F.col("w"), i, 8), " ")))).alias("g"))
    return grams(table(spark, d, "benchmark"), "item_id").join(grams(docs(spark, d), "doc_id"), "g").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"))


@query("bpe_pair_counts", f"""WITH w AS (SELECT w, count(*) AS freq FROM (SELECT unnest({S_WORDS.format('text')}) AS w FROM documents) GROUP BY w),
s AS (SELECT freq, list_concat(list_transform(range(1, length(w) + 1), lambda i: substring(w, i, 1)), ['</w>']) AS s FROM w),
p AS (SELECT freq, s[i] AS l, s[i + 1] AS r FROM s, range(1, 200) q(i) WHERE i < len(s))
SELECT l, r, CAST(sum(freq) AS BIGINT) AS cnt FROM p GROUP BY l, r""")
def bpe_pair_counts(spark, d):
    return O.pair_counts(O.word_table(docs(spark, d), "doc_id")).select("l", "r", "cnt")


@query("bpe_train")
def bpe_train(spark, d):
    merges, _ = O.train_bpe(O.word_table(table(spark, d, "benchmark"), "item_id"), 10)
    return spark.createDataFrame([(i, *m) for i, m in enumerate(merges)], "step long, l string, r string, cnt long")


@query("bpe_train_documents")
def bpe_train_documents(spark, d):
    merges, _ = O.train_bpe(O.word_table(docs(spark, d), "doc_id"), 10)
    return spark.createDataFrame([(i, *m) for i, m in enumerate(merges)], "step long, l string, r string, cnt long")


@query("bpe_pretokenized")
def bpe_pretokenized(spark, d):
    """Training on words that come as symbols: the letters of the parts' first words and an underscore."""
    spaced = F.concat(F.regexp_replace(F.split("p_name", " ")[0], "(.)", "$1 "), F.lit("_"))
    merges, _ = O.train_bpe(O.symbol_table(table(spark, d, "part").select("p_partkey", spaced.alias("symbols")), "p_partkey"), 10)
    return spark.createDataFrame([(i, *m) for i, m in enumerate(merges)], "step long, l string, r string, cnt long")


_VOCAB_SQL = "vocab AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS token FROM part UNION SELECT DISTINCT p_name FROM part WHERE p_name LIKE 'b%')"


def _vocab(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.split("p_name", " ")[0].alias("token")).union(p.where("p_name LIKE 'b%'").select("p_name")).distinct()


@query("vocab_search", f"WITH {_VOCAB_SQL} SELECT p_partkey, p_name IN (SELECT token FROM vocab) AS known FROM part")
def vocab_search(spark, d):
    v = _vocab(spark, d).withColumn("hit", F.lit(True))
    p = table(spark, d, "part")
    return p.join(v, p["p_name"] == v["token"], "left").select("p_partkey", F.coalesce("hit", F.lit(False)).alias("known"))


@query("vocab_starts_with", f"WITH {_VOCAB_SQL} SELECT DISTINCT substring(p_name, 1, k) AS prefix, EXISTS (SELECT 1 FROM vocab WHERE starts_with(token, substring(p_name, 1, k))) AS known FROM part, range(0, 12) r(k)")
def vocab_starts_with(spark, d):
    p = table(spark, d, "part").select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.substring("p_name", 1, k))).alias("prefix")).distinct()
    return O.starts_with(p, "prefix", _vocab(spark, d))


@query("vocab_prefixes", f"""WITH {_VOCAB_SQL} SELECT p_partkey, coalesce((SELECT string_agg(token, '|' ORDER BY length(token)) FROM vocab WHERE starts_with(p_name, token)), '') AS all_prefixes,
(SELECT token FROM vocab WHERE starts_with(p_name, token) ORDER BY length(token) DESC LIMIT 1) AS longest_prefix FROM part""")
def vocab_prefixes(spark, d):
    out = O.vocabulary_prefixes(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", _vocab(spark, d))
    return out.select("p_partkey", F.array_join("all_prefixes", "|").alias("all_prefixes"), "longest_prefix")


@query("vocab_words", f"WITH {_VOCAB_SQL} SELECT token FROM vocab")
def vocab_words(spark, d):
    return _vocab(spark, d)


#: Words and endings that the vocabulary takes from the documents, besides all their letters.
MOST_PIECES = 2000


@query("wordpiece_tokens", f"""WITH RECURSIVE f AS MATERIALIZED (SELECT w, count(*) AS cnt FROM (SELECT unnest({S_WORDS.format('lower(text)')}) AS w FROM documents) GROUP BY w),
v AS MATERIALIZED (SELECT p FROM (SELECT w AS p FROM f WHERE length(w) < 20 ORDER BY cnt DESC, w LIMIT {MOST_PIECES}) UNION SELECT p FROM (SELECT '##' || substring(w, -3) AS p FROM f WHERE length(w) > 3 GROUP BY 1 ORDER BY sum(cnt) DESC, 1 LIMIT {MOST_PIECES})
UNION SELECT substring(w, i, 1) FROM f, range(1, 20) r(i) WHERE i <= length(w) UNION SELECT '##' || substring(w, i, 1) FROM f, range(1, 20) r(i) WHERE i <= length(w)),
c AS MATERIALIZED (SELECT w, count(*) AS cnt FROM (SELECT unnest({S_WORDS.format('lower(text)')}) AS w FROM conversations) GROUP BY w),
m AS MATERIALIZED (SELECT w, i, max(k) AS k FROM (SELECT w, i, k, CASE WHEN i > 1 THEN '##' ELSE '' END || substring(w, i, k) AS p FROM (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM c), range(1, 20) r(k) WHERE i + k <= length(w) + 1) JOIN v USING (p) GROUP BY w, i),
t(w, here, pieces) AS (SELECT w, CAST(1 AS BIGINT), CAST([] AS VARCHAR[]) FROM c UNION ALL
SELECT t.w, t.here + m.k, list_append(t.pieces, CASE WHEN t.here > 1 THEN '##' ELSE '' END || substring(t.w, t.here, m.k)) FROM t JOIN m ON m.w = t.w AND m.i = t.here)
SELECT c.w AS word, cnt, coalesce(array_to_string(pieces, ' '), '[UNK]') AS pieces FROM c LEFT JOIN t ON t.w = c.w AND t.here > length(c.w)""")
def wordpiece_tokens(spark, d):
    """The words of conversations in pieces: frequent words and endings of the documents, and their letters."""
    f = docs(spark, d).select(F.explode(X.words(F.lower("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("cnt"))
    f, _ = written(f, "frequencies")
    whole = f.where("length(w) < 20").orderBy(F.desc("cnt"), "w").limit(MOST_PIECES).select(F.col("w").alias("p"))
    ends = f.where("length(w) > 3").groupBy(F.concat(F.lit("##"), F.substring("w", -3, 3)).alias("p")).agg(F.sum("cnt").alias("cnt")).orderBy(F.desc("cnt"), "p").limit(MOST_PIECES).select("p")
    letters = f.select(F.explode(X.characters(F.substring("w", 1, 19))).alias("p")).distinct()
    vocab = whole.union(ends).union(letters).union(letters.select(F.concat(F.lit("##"), "p"))).distinct()
    words = table(spark, d, "conversations").select(F.explode(X.words(F.lower("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("cnt"))
    # a few thousand pieces, bounded by the parameter and the alphabet
    return words.select("word", "cnt", F.array_join(O.wordpiece(F.col("word"), [r[0] for r in vocab.collect()]), " ").alias("pieces"))


@query("longest_palindrome", """WITH p AS (SELECT item_id, text, unnest(range(1, length(text) + 1)) AS i FROM benchmark), q AS (SELECT item_id, i, k, substring(text, i, k) AS s FROM (SELECT *, unnest(range(1, length(text) - i + 2)) AS k FROM p)),
r AS (SELECT item_id, s, row_number() OVER (PARTITION BY item_id ORDER BY k DESC, i) AS n FROM q WHERE s = reverse(s)) SELECT b.item_id, coalesce(s, b.text) AS palindrome FROM benchmark b LEFT JOIN r ON r.item_id = b.item_id AND n = 1""")
def longest_palindrome(spark, d):
    return table(spark, d, "benchmark").select("item_id", X.longest_palindrome("text").alias("palindrome"))


@query("longest_palindrome_documents")
def longest_palindrome_documents(spark, d):
    """Over whole documents; SQL would need every substring of them.  Tests compare with brute force."""
    return docs(spark, d).select("doc_id", X.longest_palindrome("text").alias("palindrome"))


# --- statistics and collection ----------------------------------------------------------------------------------------

@query("lang_distribution", "SELECT lang, count(*) AS cnt, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM documents GROUP BY lang")
def lang_distribution(spark, d):
    return C.distribution(docs(spark, d), "lang")


@query("label_distribution", "SELECT toxic, count(*) AS cnt, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM labels GROUP BY toxic")
def label_distribution(spark, d):
    return C.distribution(table(spark, d, "labels"), "toxic")


@query("source_length_stats", "SELECT source, count(*) AS docs, min(n_chars) AS least, max(n_chars) AS largest, round(avg(n_chars), 6) AS mean, median(n_chars) AS median FROM documents GROUP BY source")
def source_length_stats(spark, d):
    return docs(spark, d).groupBy("source").agg(F.count("*").alias("docs"), F.min("n_chars").alias("least"), F.max("n_chars").alias("largest"), F.round(F.avg("n_chars"), 6).alias("mean"), F.median("n_chars").alias("median"))


@query("element_counts", f"SELECT lang, source, grouping(source) = 1 AS total, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(len({S_WORDS.format('text')})) AS BIGINT) AS words FROM documents GROUP BY GROUPING SETS ((lang, source), (lang))")
def element_counts(spark, d):
    t = docs(spark, d).select("lang", "source", F.length("text").alias("c"), F.size(X.words(F.col("text"))).alias("w"))
    return t.groupingSets([["lang", "source"], ["lang"]], "lang", "source").agg((F.grouping("source") == 1).alias("total"), F.count("*").alias("docs"), F.sum("c").alias("chars"), F.sum("w").alias("words"))


@query("distinct_sources", "SELECT count(*) AS total, count(DISTINCT source) AS sources, string_agg(DISTINCT source, ',' ORDER BY source) AS names FROM documents")
def distinct_sources(spark, d):
    return docs(spark, d).groupBy("source").agg(F.count("*").alias("n")).agg(F.sum("n").alias("total"), F.count("*").alias("sources"), F.array_join(F.array_sort(F.collect_list("source")), ",").alias("names"))


@query("collection_stats", """WITH f AS (SELECT l_suppkey AS f, avg(l_quantity) AS q, avg(l_discount) AS s FROM lineitem GROUP BY 1)
SELECT 'l_quantity' AS measure, count(*) AS files, round(min(q), 6) AS least, round(max(q), 6) AS largest, round(avg(q), 6) AS mean, round(median(q), 6) AS median FROM f
UNION ALL SELECT 'l_discount', count(*), round(min(s), 6), round(max(s), 6), round(avg(s), 6), round(median(s), 6) FROM f""")
def collection_stats(spark, d):
    return C.collection_statistics(table(spark, d, "lineitem"), "l_suppkey", ["l_quantity", "l_discount"])


@query("role_counts", "SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY role")
def role_counts(spark, d):
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.count_distinct("conv_id").alias("conversations"), F.sum(F.length("text")).alias("chars"))


@query("quota_sample", """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, min(doc_id) OVER (PARTITION BY source) AS g FROM documents)
SELECT doc_id, source FROM (SELECT *, row_number() OVER (ORDER BY CASE WHEN r <= 3 THEN 0 ELSE 1 END, CASE WHEN r <= 3 THEN g ELSE r END, CASE WHEN r <= 3 THEN r ELSE g END) AS n FROM r) WHERE n <= 200""")
def quota_sample(spark, d):
    return C.quota_sample(docs(spark, d).select("doc_id", "source"), "source", "doc_id", 3, 200)


@query("sequence_names", """WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) + CASE WHEN source = 'src1' THEN 98 ELSE 0 END AS n FROM documents)
SELECT doc_id, source || '_' || CASE WHEN n < 10 THEN '0' ELSE '' END || n::VARCHAR || '.pdf' AS file_name FROM r""")
def sequence_names(spark, d):
    t = docs(spark, d).select("doc_id", "lang", "source")
    taken = t.where("source = 'src1'").select("lang", "source").distinct().withColumn("seq", F.lit(98))
    return C.sequence_names(t, ["lang", "source"], "doc_id", taken).select("doc_id", "file_name")


@query("early_stop", "WITH p AS (SELECT l_suppkey AS page, count(*) AS n FROM lineitem GROUP BY 1) SELECT page, n FROM (SELECT *, coalesce(sum(n) OVER (ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM p) WHERE s < 7500")
def early_stop(spark, d):
    pages = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("page")).agg(F.count("*").alias("n"))
    return C.early_stop(pages, "page", "n", 5000)


@query("new_reports", "WITH p AS (SELECT page_id AS ord, lower(url) AS pdf_url FROM pages UNION ALL SELECT page_id + 1000000000, lower(url) FROM pages), k AS (SELECT lower(url) AS pdf_url FROM pages WHERE url LIKE 'http://%') SELECT pdf_url, min(ord) AS ord FROM p WHERE pdf_url NOT IN (SELECT pdf_url FROM k) GROUP BY 1")
def new_reports(spark, d):
    p = table(spark, d, "pages").select("page_id", "url")
    rows = p.select(F.col("page_id").alias("ord"), F.lower("url").alias("pdf_url")).union(p.select(F.col("page_id") + 1000000000, F.lower("url")))
    return C.new_reports(rows, p.where("url LIKE 'http://%'").select(F.lower("url").alias("pdf_url")))


@query("content_status", """WITH k AS (SELECT 'md5:' || md5(text) AS h, max('store/' || doc_id::VARCHAR) AS p FROM documents WHERE source = 'src2' GROUP BY 1),
f AS (SELECT 'md5:' || md5(text) AS h, min(doc_id) AS f FROM documents WHERE source <> 'src2' GROUP BY 1)
SELECT doc_id, CASE WHEN k.p IS NOT NULL THEN 'duplicate_content:' || k.p WHEN doc_id > f THEN 'duplicate_content:new/' || f::VARCHAR ELSE 'new' END AS status
FROM documents JOIN f ON f.h = 'md5:' || md5(text) LEFT JOIN k ON k.h = f.h WHERE source <> 'src2'""")
def content_status(spark, d):
    t = docs(spark, d).select("doc_id", "source", O.content_key(F.col("text")).alias("file_hash"))
    path = lambda at: F.concat(F.lit(at), F.col("doc_id").cast("string")).alias("local_path")
    got = C.content_status(t.where("source <> 'src2'").select("doc_id", "file_hash", path("new/")), t.where("source = 'src2'").select("file_hash", path("store/")), "doc_id")
    return got.select("doc_id", "status")


@query("union_merged", f"""WITH RECURSIVE {_sig_sql('documents', 'doc_id')}, {_BAND_SQL}, {_PAIR_SQL}, {_CLASS_SQL},
e AS MATERIALIZED (SELECT a, b, row_number() OVER (ORDER BY sim DESC, a, b) AS r FROM (SELECT a, b, sim FROM pairs JOIN rep x ON x.id = a AND x.rep = a JOIN rep y ON y.id = b AND y.rep = b UNION ALL SELECT rep, id, 1.0 FROM rep WHERE rep <> id)),
ends AS (SELECT list(i ORDER BY i) AS ids FROM (SELECT a AS i FROM e UNION SELECT b FROM e)),
steps(r, label, a, b, merged) AS (SELECT CAST(0 AS BIGINT), ids, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), false FROM ends
UNION ALL SELECT e.r, list_transform(s.label, lambda x: CASE WHEN x = s.label[list_position(ends.ids, e.b)] THEN s.label[list_position(ends.ids, e.a)] ELSE x END), e.a, e.b, s.label[list_position(ends.ids, e.a)] <> s.label[list_position(ends.ids, e.b)] FROM steps s JOIN e ON e.r = s.r + 1, ends)
SELECT a, b, merged FROM steps WHERE r > 0""")
def union_merged(spark, d):
    """Similar pairs united one after the other, the most similar first: which of them join two sets."""
    pairs = O.similar_pairs(_written_sigs(spark, d), SIMILAR, PERM, BANDS)
    ordered = pairs.withColumn("at", F.struct((-F.col("sim")).alias("less"), "a", "b"))
    return unions(ordered, "at").select("a", "b", "merged")


@query("connected_pairs", f"""WITH RECURSIVE {_sig_sql('documents', 'doc_id')}, {_BAND_SQL}, {_PAIR_SQL}, {_CLUSTER_SQL}, p AS (SELECT doc_id AS a, lag(doc_id) OVER (PARTITION BY lang, substring(text, 1, 20) ORDER BY doc_id) AS b FROM documents)
SELECT p.a, p.b, x.label = y.label AS connected FROM p JOIN clusters x ON x.id = p.a JOIN clusters y ON y.id = p.b""")
def connected_pairs(spark, d):
    """Whether a document is in one cluster with the one before it that begins alike."""
    w = W.partitionBy("lang", F.substring("text", 1, 20)).orderBy("doc_id")
    pairs = docs(spark, d).select(F.col("doc_id").alias("a"), F.lag("doc_id").over(w).alias("b")).where("b IS NOT NULL")
    labels = O.near_duplicate_clusters(docs(spark, d), "text", _shingles, "doc_id", SIMILAR, PERM, BANDS)
    return connected(pairs, labels).select("a", "b", "connected")


@query("collector_counters", """WITH s AS (SELECT source, doc_id > min(doc_id) OVER (PARTITION BY md5(text)) AS dup FROM documents)
SELECT source, count(*) FILTER (WHERE NOT dup) AS downloaded, count(*) FILTER (WHERE dup) AS skipped FROM s GROUP BY source""")
def collector_counters(spark, d):
    rows = O.first_of_equal(docs(spark, d).select("doc_id", "source", "text"), O.content_key(F.col("text")), "doc_id")
    again = F.col("doc_id") > F.col("kept")
    return rows.groupBy("source").agg(F.count_if(~again).alias("downloaded"), F.count_if(again).alias("skipped"))


@query("metadata_upsert", "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def metadata_upsert(spark, d):
    return C.upsert(table(spark, d, "events").select("event_id", "user_id", "event_type", "value"), "user_id", "event_id").drop("event_id")


@query("union_distinct", "SELECT (SELECT count(DISTINCT s_nationkey) FROM supplier WHERE s_suppkey < 20) AS existing, (SELECT count(DISTINCT c_nationkey) FROM customer WHERE c_custkey < 30) AS session, (SELECT count(*) FROM (SELECT s_nationkey FROM supplier WHERE s_suppkey < 20 UNION SELECT c_nationkey FROM customer WHERE c_custkey < 30)) AS total")
def union_distinct(spark, d):
    before = table(spark, d, "supplier").where("s_suppkey < 20").select(F.col("s_nationkey").alias("n"))
    return C.union_distinct(before, table(spark, d, "customer").where("c_custkey < 30").select(F.col("c_nationkey").alias("n")), "n")


@query("store_lookup", "WITH r AS (SELECT lower(url) AS u, min(page_id) AS p FROM pages WHERE page_id % 2 = 0 GROUP BY 1) SELECT page_id, u IS NOT NULL AS known, 'store/' || p AS local_path FROM pages LEFT JOIN r ON u = lower(url)")
def store_lookup(spark, d):
    p = table(spark, d, "pages")
    held = O.add_once(p.where("page_id % 2 = 0").select("page_id", F.lower("url").alias("pdf_url")), "pdf_url", "page_id")
    store = held.select("pdf_url", F.concat(F.lit("store/"), F.col("page_id").cast("string")).alias("local_path"))
    return files.lookup(p.select("page_id", F.lower("url").alias("u")), "u", store, "pdf_url").select("page_id", "known", F.col("report.local_path").alias("local_path"))


@query("running_count", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS ordinal FROM events")
def running_count(spark, d):
    return C.running_count(table(spark, d, "events").select("event_id", "ts"), [F.col("ts"), F.col("event_id")]).select("event_id", "ordinal")


@query("report_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'undated' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS report_date FROM orders")
def report_dates(spark, d):
    raw = F.when(F.col("o_orderkey") % 10 == 0, "undated").otherwise(F.date_format("o_orderdate", "yyyy.M.d"))
    return table(spark, d, "orders").select("o_orderkey", X.report_date(raw).alias("report_date"))


@query("readable_sizes", """SELECT o_orderkey, CASE WHEN v < 1024 THEN printf('%.1f', round_even(v, 1)) || ' B' WHEN v < 1048576 THEN printf('%.1f', round_even(v / 1024, 1)) || ' KB' ELSE printf('%.1f', round_even(v / 1048576, 1)) || ' MB' END AS size FROM (SELECT o_orderkey, o_orderkey * 64.0::DOUBLE AS v FROM orders)""")
def readable_sizes(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.readable_size(F.col("o_orderkey") * F.lit(64.0)).alias("size"))


@query("cell_preview", f"WITH t AS (SELECT conv_id, turn, regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS f, text FROM conversations) SELECT conv_id, turn, CASE WHEN length(f) > 20 THEN substring(f, 1, 18) || '..' ELSE f END AS cell, CASE WHEN length(text) > 50 THEN substring(text, 1, 50) || '...' ELSE text END AS preview FROM t")
def cell_preview(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.truncate_cell(F.col("text"), 20).alias("cell"), X.preview(F.col("text")).alias("preview"))


# --- HTML -------------------------------------------------------------------------------------------------------------

@query("html_links", "SELECT page_id, len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS n, coalesce(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)[1], '') AS first_link FROM pages")
def html_links(spark, d):
    l = html.links(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.size(l).cast("long").alias("n"), F.coalesce(F.get(l, F.lit(0)), F.lit("")).alias("first_link"))


@query("pagination", "SELECT page_id, 1 + page_id % 90 AS pages FROM pages")
def pagination(spark, d):
    made = F.concat(F.col("html"), F.lit('<td class="pgRR"><a href="/list?x=1&page='), (1 + F.col("page_id") % 90).cast("string"), F.lit('">last</a></td>'))
    return table(spark, d, "pages").select("page_id", html.total_pages(made).cast("long").alias("pages"))


@query("report_list", "SELECT page_id, 0::BIGINT AS ord, 'T' || page_id AS title, 'broker' AS broker, 'S' || page_id AS stock_name, '25.01.15' AS date, 'http://x/' || page_id || '.pdf' AS pdf_url FROM pages")
def report_list(spark, d):
    i = F.col("page_id").cast("string")
    row = F.concat(F.lit('<table class="type_1"><tr><th>h</th></tr><tr><td class="blank_07"></td></tr><tr><td><a class="stock_item"> S'), i, F.lit('</a></td><td><a href="r">T'), i, F.lit('</a></td><td>broker</td><td class="file"><a href="http://x/'), i, F.lit('.pdf">p</a></td><td class="date">25.01.15</td></tr></table>'))
    got = html.report_list(table(spark, d, "pages").select("page_id", F.concat("html", row).alias("html")))
    return got.withColumn("ord", F.col("ord").cast("long"))


# --- boxes ------------------------------------------------------------------------------------------------------------

_KEYS = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
_BOX_SQL = f"boxes AS (SELECT l_orderkey AS page, (l_partkey % 100)::DOUBLE AS x0, (l_suppkey % 100)::DOUBLE AS y0, (l_partkey % 100) + 20 + l_quantity AS x1, (l_suppkey % 100) + 10 + l_quantity AS y1, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_KEYS}) AS ord, l_returnflag AS label FROM lineitem)"
_IOU_SQL = """pairs AS (SELECT page, i, j, w * h / (a1 + a2 - w * h) AS iou FROM (SELECT a.page, a.ord AS i, b.ord AS j, least(a.x1, b.x1) - greatest(a.x0, b.x0) AS w, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS h, (a.x1 - a.x0) * (a.y1 - a.y0) AS a1, (b.x1 - b.x0) * (b.y1 - b.y0) AS a2
FROM boxes a JOIN boxes b ON a.page = b.page AND a.ord < b.ord) WHERE w > 0 AND h > 0)"""


def boxes(spark, d) -> DataFrame:
    t = table(spark, d, "lineitem")
    w = W.partitionBy("l_orderkey").orderBy(*_KEYS.split(", "))
    x, y = (F.col("l_partkey") % 100).cast("double"), (F.col("l_suppkey") % 100).cast("double")
    return t.select(F.col("l_orderkey").alias("page"), x.alias("x0"), y.alias("y0"), (x + 20 + F.col("l_quantity")).alias("x1"), (y + 10 + F.col("l_quantity")).alias("y1"), F.row_number().over(w).cast("long").alias("ord"), F.col("l_returnflag").alias("label"))


@query("box_geometry", f"WITH {_BOX_SQL} SELECT page, ord, x1 - x0 AS width, y1 - y0 AS height, (x1 - x0) * (y1 - y0) AS area, round(x0 / 612 * 100, 6) AS px, round((y1 - y0) / 792 * 100, 6) AS ph, 792 - y1 AS flipped FROM boxes")
def box_geometry(spark, d):
    b = G.corners()
    p = G.to_percent(b, F.lit(612.0), F.lit(792.0))
    return boxes(spark, d).select("page", "ord", (b[2] - b[0]).alias("width"), (b[3] - b[1]).alias("height"), G.area(b).alias("area"), F.round(p[0], 6).alias("px"), F.round(p[3], 6).alias("ph"), G.flip_y(b, F.lit(792.0))[1].alias("flipped"))


@query("iou_pairs", f"WITH {_BOX_SQL}, {_IOU_SQL} SELECT page, i, j, round(iou, 9) AS iou FROM pairs WHERE iou > 0.3")
def iou_pairs(spark, d):
    return L.overlapping(boxes(spark, d), ["page"], "ord", 0.3).withColumn("iou", F.round("iou", 9))


@query("box_merge", f"""WITH RECURSIVE {_BOX_SQL}, {_IOU_SQL}, e AS (SELECT page, i AS x, j AS y FROM pairs WHERE iou > 0.3 UNION ALL SELECT page, j, i FROM pairs WHERE iou > 0.3),
reach(page, ord, r) AS (SELECT page, ord, ord FROM boxes UNION SELECT e.page, e.y, reach.r FROM reach JOIN e ON e.page = reach.page AND e.x = reach.ord),
lab AS (SELECT page, ord, min(r) AS label FROM reach GROUP BY 1, 2),
k AS (SELECT b.page, b.ord, row_number() OVER (PARTITION BY b.page, l.label ORDER BY (x1 - x0) * (y1 - y0) DESC, b.ord) AS n FROM boxes b JOIN lab l ON l.page = b.page AND l.ord = b.ord)
SELECT page, ord FROM k WHERE n = 1""")
def box_merge(spark, d):
    return L.merge_boxes(boxes(spark, d), ["page"], "ord", 0.3).select("page", "ord")


@query("containment_flag", f"""WITH {_BOX_SQL}, t AS (SELECT * FROM boxes WHERE ord % 3 = 0) SELECT b.page, b.ord, EXISTS (SELECT 1 FROM t WHERE t.page = b.page AND least(b.x1, t.x1) > greatest(b.x0, t.x0) AND least(b.y1, t.y1) > greatest(b.y0, t.y0)
AND (least(b.x1, t.x1) - greatest(b.x0, t.x0)) * (least(b.y1, t.y1) - greatest(b.y0, t.y0)) / ((b.x1 - b.x0) * (b.y1 - b.y0)) > 0.5) AS in_table FROM boxes b WHERE b.ord % 3 <> 0""")
def containment_flag(spark, d):
    b = boxes(spark, d)
    return L.inside_table(b.where("ord % 3 <> 0"), b.where("ord % 3 = 0"), ["page"], "ord").select("page", "ord", "in_table")


@query("page_counts", f"WITH {_BOX_SQL} SELECT page, count(*) AS tables, max(ord) - 1 AS last_index FROM boxes GROUP BY page")
def page_counts(spark, d):
    return boxes(spark, d).groupBy("page").agg(F.count("*").alias("tables"), (F.max("ord") - 1).alias("last_index"))


@query("page_sizes", """SELECT kind, count(*) AS cnt FROM (SELECT CASE WHEN abs(w - 595) < 10 AND abs(h - 842) < 10 THEN 'A4 Portrait' WHEN abs(w - 842) < 10 AND abs(h - 595) < 10 THEN 'A4 Landscape' WHEN abs(w - 612) < 10 AND abs(h - 792) < 10 THEN 'Letter Portrait' WHEN abs(w - 792) < 10 AND abs(h - 612) < 10 THEN 'Letter Landscape'
ELSE 'Other (' || round_even(w, 0)::BIGINT || 'x' || round_even(h, 0)::BIGINT || ')' END AS kind FROM (SELECT 590 + p_partkey % 220 / 2.0 AS w, 838 - p_partkey % 110 / 2.0 AS h FROM part)) GROUP BY kind""")
def page_sizes(spark, d):
    p = table(spark, d, "part").select((590 + F.col("p_partkey") % 220 / 2.0).alias("w"), (838 - F.col("p_partkey") % 110 / 2.0).alias("h"))
    return p.groupBy(G.page_size_class(F.col("w"), F.col("h")).alias("kind")).agg(F.count("*").alias("cnt"))


@query("box_intersections", f"WITH {_BOX_SQL} SELECT a.page, a.ord AS i, b.ord AS j, least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0) AS meet, CASE WHEN meet THEN greatest(a.x0, b.x0) END AS x0, CASE WHEN meet THEN greatest(a.y0, b.y0) END AS y0, CASE WHEN meet THEN least(a.x1, b.x1) END AS x1, CASE WHEN meet THEN least(a.y1, b.y1) END AS y1 FROM boxes a JOIN boxes b ON b.page = a.page AND b.ord = a.ord + 1")
def box_intersections(spark, d):
    b = boxes(spark, d)
    cols = ["x0", "y0", "x1", "y1"]
    l = b.select("page", F.col("ord").alias("i"), *(F.col(c).alias(f"l_{c}") for c in cols))
    r = b.select("page", F.col("ord").alias("j"), *(F.col(c).alias(f"r_{c}") for c in cols))
    both = l.join(r, (l["page"] == r["page"]) & (r["j"] == l["i"] + 1)).select(l["page"], "i", "j", G.intersection(G.corners("l_"), G.corners("r_")).alias("box"))
    return both.select("page", "i", "j", F.col("box").isNotNull().alias("meet"), *(F.col(f"box.{c}").alias(c) for c in cols))


@query("overlap_groups", f"""WITH RECURSIVE {_BOX_SQL}, {_IOU_SQL}, e AS (SELECT page, i AS x, j AS y FROM pairs WHERE iou >= 0.5 UNION ALL SELECT page, j, i FROM pairs WHERE iou >= 0.5),
reach(page, ord, r) AS (SELECT page, ord, ord FROM boxes UNION SELECT e.page, e.y, reach.r FROM reach JOIN e ON e.page = reach.page AND e.x = reach.ord)
SELECT page, ord, min(r) AS "group" FROM reach GROUP BY 1, 2""")
def overlap_groups(spark, d):
    return L.overlap_groups(boxes(spark, d), ["page"], "ord", 0.5).select("page", "ord", "group")


# --- documents --------------------------------------------------------------------------------------------------------

def _page_items(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Orders as pages (four to a file) and their line items as tables, text blocks and images."""
    b = boxes(spark, d).select(F.concat(F.lit("f"), F.floor(F.col("page") / 4).cast("string")).alias("file"), "page", "ord", F.col("x1").alias("x0"), "y0", F.col("x0").alias("x1"), "y1", "label")
    o = table(spark, d, "orders").select(F.concat(F.lit("f"), F.floor(F.col("o_orderkey") / 4).cast("string")).alias("file"), F.col("o_orderkey").alias("page"), F.when(F.col("o_orderkey") % 5 > 0, F.lit(595.0)).alias("width"), F.when(F.col("o_orderkey") % 5 > 0, F.lit(842.0)).alias("height"))
    blocks = b.where("ord % 3 = 1").select("*", F.concat_ws("-", "page", "ord").alias("id"), F.concat(F.lit("t"), F.col("ord").cast("string")).alias("text")).withColumn("label", F.when(F.col("label") != "A", F.col("label")))
    return o, b.where("ord % 3 = 0"), blocks, b.where("ord % 3 = 2")


_PAGES_SQL = f"""{_BOX_SQL}, tb AS (SELECT * FROM boxes WHERE ord % 3 = 0), bl AS (SELECT b.page, b.ord, coalesce(nullif(b.label, 'A'), 'text') AS label, EXISTS (SELECT 1 FROM tb t WHERE t.page = b.page AND least(b.x1, t.x1) > greatest(b.x0, t.x0) AND least(b.y1, t.y1) > greatest(b.y0, t.y0)
AND (least(b.x1, t.x1) - greatest(b.x0, t.x0)) * (least(b.y1, t.y1) - greatest(b.y0, t.y0)) / ((b.x1 - b.x0) * (b.y1 - b.y0)) > 0.5) AS in_table FROM boxes b WHERE b.ord % 3 = 1),
pg AS (SELECT 'f' || o_orderkey // 4 AS file, o_orderkey AS page, CASE WHEN o_orderkey % 5 > 0 THEN 595.0 ELSE 612.0 END::DOUBLE AS width, CASE WHEN o_orderkey % 5 > 0 THEN 842.0 ELSE 792.0 END::DOUBLE AS height, (SELECT count(*) FROM bl WHERE bl.page = o_orderkey) AS texts, (SELECT count(*) FROM boxes b WHERE b.page = o_orderkey AND ord % 3 = 2) AS images FROM orders)"""


@query("assembled_pages", f"WITH {_PAGES_SQL} SELECT file, page, width, height, coalesce((SELECT string_agg('t' || ord || ' ' || label || ' ' || in_table, ';' ORDER BY ord) FROM bl WHERE bl.page = pg.page), '') AS blocks, images FROM pg")
def assembled_pages(spark, d):
    text = F.array_join(F.transform("text_blocks", lambda b: F.concat_ws(" ", b["text"], b["label"], b["in_table"].cast("string"))), ";")
    return D.assemble_pages(*_page_items(spark, d)).select("file", "page", "width", "height", text.alias("blocks"), F.size("images").cast("long").alias("images"))


@query("document_info", f"WITH {_PAGES_SQL} SELECT file, count(*) AS page_count, string_agg(page || ':' || width::INT || 'x' || height::INT || ':' || texts || ':' || images, ' ' ORDER BY page) AS summaries FROM pg GROUP BY file")
def document_info(spark, d):
    text = F.array_join(F.transform("page_summaries", lambda p: F.concat(p["page_number"].cast("string"), F.lit(":"), p["width"].cast("int").cast("string"), F.lit("x"), p["height"].cast("int").cast("string"), F.lit(":"), p["text_block_count"].cast("string"), F.lit(":"), p["image_count"].cast("string"))), " ")
    return D.document_info(D.assemble_pages(*_page_items(spark, d))).select("file", "page_count", text.alias("summaries"))


@query("file_statistics", f"WITH {_PAGES_SQL} SELECT file, count(*) AS page_count, CAST(sum(texts) AS BIGINT) AS text_blocks, CAST(sum(images) AS BIGINT) AS images, (SELECT count(*) FROM tb WHERE 'f' || tb.page // 4 = pg.file) AS tables FROM pg GROUP BY file")
def file_statistics(spark, d):
    pages, tables, blocks, images = _page_items(spark, d)
    return D.file_statistics(D.document_info(D.assemble_pages(pages, tables, blocks, images)), tables)


@query("page_filter", f"WITH {_BOX_SQL} SELECT page, ord FROM boxes WHERE page IN (3, 8, 21)")
def page_filter(spark, d):
    pages, *_ = _page_items(spark, d)
    return D.on_pages(boxes(spark, d), [8, 3, 21, 3], pages).select("page", "ord")


def _detected(spark, d) -> tuple[DataFrame, DataFrame]:
    """Orders as files, some of which failed, and their line items as tables."""
    failed = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("cannot open a file of priority "), F.col("o_orderpriority")))
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("file"), (F.col("o_orderkey") % 7).cast("int").alias("pages"), failed.alias("error"))
    b = boxes(spark, d).select(F.col("page").cast("string").alias("file"), (F.col("ord") % 7).cast("int").alias("page"), "ord", F.col("label").alias("category"), F.lit(0.5).alias("confidence"))
    return o, b


_DETECTED_SQL = f"""{_BOX_SQL}, n AS (SELECT page, label, count(*) AS n, min(ord) AS f FROM boxes GROUP BY 1, 2), cat AS (SELECT page, CAST(sum(n) AS BIGINT) AS tables, string_agg(label || ':' || n, ', ' ORDER BY f, label) AS categories, string_agg('"' || label || '":' || n, ',' ORDER BY f, label) AS json FROM n GROUP BY page),
fl AS (SELECT o_orderkey, o_orderkey % 7 AS pages, CASE WHEN o_orderstatus = 'P' THEN 'cannot open a file of priority ' || o_orderpriority END AS error FROM orders)"""


@query("categories_per_file", f"WITH {_DETECTED_SQL} SELECT page::VARCHAR AS file, tables AS tables_detected, categories FROM cat")
def categories_per_file(spark, d):
    return D.categories_per_file(_detected(spark, d)[1]).select("file", "tables_detected", D.category_text(F.col("categories")).alias("categories"))


@query("detection_summary", f"""WITH {_DETECTED_SQL}, r AS (SELECT CASE WHEN error IS NULL THEN 'file' ELSE 'error' END AS kind, o_orderkey::VARCHAR AS file, CASE WHEN error IS NULL THEN pages END AS pages, CASE WHEN error IS NULL THEN coalesce(tables, 0) END AS tables, CASE WHEN error IS NULL THEN coalesce(categories, '-') ELSE 'Error: ' || substring(error, 1, 30) || '...' END AS categories FROM fl LEFT JOIN cat ON page = o_orderkey)
SELECT * FROM r UNION ALL SELECT 'total', NULL, CAST(coalesce(sum(pages), 0) AS BIGINT), CAST(coalesce(sum(tables), 0) AS BIGINT), '' FROM r WHERE kind = 'file'""")
def detection_summary(spark, d):
    return D.detection_summary(*_detected(spark, d))


@query("result_json", f"""WITH {_DETECTED_SQL}, t AS (SELECT page, string_agg('{{"page":' || ord % 7 || ',"category":"' || label || '","confidence":0.5}}', ',' ORDER BY ord) AS tables FROM boxes GROUP BY page)
SELECT o_orderkey::VARCHAR AS file, '{{"pdf_path":"' || o_orderkey || '","pages":' || pages || ',"tables_detected":' || coalesce(cat.tables, 0) || ',"categories":{{' || coalesce(json, '') || '}},"tables":[' || coalesce(t.tables, '') || ']' || coalesce(',"error":"' || error || '"', '') || '}}' AS json FROM fl LEFT JOIN cat ON cat.page = o_orderkey LEFT JOIN t ON t.page = o_orderkey""")
def result_json(spark, d):
    return D.result_json(*_detected(spark, d))


@query("page_raster", f"""WITH {_BOX_SQL}, it AS (SELECT page, ord % 3 AS z, least(greatest(floor(x0 / 200 * 20), 0), 19)::BIGINT AS a, least(greatest(floor(x1 / 200 * 20), 0), 19)::BIGINT AS b, least(greatest(floor((200 - y1) / 200 * 10), 0), 9)::BIGINT AS c, least(greatest(floor((200 - y0) / 200 * 10), 0), 9)::BIGINT AS e FROM boxes),
g AS (SELECT o_orderkey AS page, x, y FROM orders, range(0, 20) r(x), range(0, 10) q(y)), m AS (SELECT g.page, x, y, max(z) AS z FROM g LEFT JOIN it ON it.page = g.page AND x BETWEEN a AND b AND y BETWEEN c AND e GROUP BY 1, 2, 3),
l AS (SELECT page, y, string_agg(CASE z WHEN 0 THEN '.' WHEN 1 THEN '#' WHEN 2 THEN '@' ELSE ' ' END, '' ORDER BY x) AS s FROM m GROUP BY 1, 2) SELECT page, string_agg(s, chr(10) ORDER BY y) AS raster FROM l GROUP BY page""")
def page_raster(spark, d):
    kind = F.element_at(F.array(F.lit("text"), F.lit("table"), F.lit("image")), (F.col("ord") % 3 + 1).cast("int"))
    items = boxes(spark, d).withColumns({"file": F.lit("f"), "kind": kind})
    pages = table(spark, d, "orders").select(F.lit("f").alias("file"), F.col("o_orderkey").alias("page"), F.lit(200.0).alias("width"), F.lit(200.0).alias("height"))
    return D.page_raster(items, pages, 20, 10).select("page", "raster")


def _layouts(spark, d) -> str:
    """Layout documents of 500 orders each as JSON files: orders are pages, line items their tables, some of them without an area."""
    b = boxes(spark, d).select("page", "ord", F.when(F.col("ord") == 4, F.col("x0")).otherwise(F.col("x1")).alias("x1"), "x0", "y0", "y1", F.when(F.col("label") != "A", F.col("label")).alias("label"))
    t = F.struct(F.array("x1", "y0", "x0", "y1").alias("box"), F.col("ord").alias("rows"), F.col("label").alias("text"))
    tables = b.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", t.alias("t")))), lambda x: x["t"]).alias("tables"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("page")).join(tables, "page", "left")
    page = F.struct((F.col("page") % 500 + 1).alias("number"), F.lit(595).alias("width"), F.lit(842).alias("height"), "tables")
    files_ = o.groupBy(F.floor(F.col("page") / 500).alias("part")).agg(F.sort_array(F.collect_list(page)).alias("pages"))
    path = shared_folder(spark, "layouts")
    files_.select("part", F.to_json(F.struct("pages")).alias("value")).write.partitionBy("part").text(path)
    return path


@query("layout_scan", f"""WITH {_BOX_SQL}, t AS (SELECT page // 500 AS part, page % 500 + 1 AS number, x0, y0, x1, y1, ord AS row_count, nullif(label, 'A') AS text_content, row_number() OVER (PARTITION BY page ORDER BY ord) - 1 AS place FROM boxes WHERE ord <> 4)
SELECT part, number AS page, place AS ord, x0, y0, x1, y1, row_count, text_content FROM t WHERE number BETWEEN 100 AND 300""")
def layout_scan(spark, d):
    """Tables on some pages of layout files; the page filter reaches the scan."""
    found = layouts.scan(spark, _layouts(spark, d), suffix=".txt").where("page BETWEEN 100 AND 300 AND error IS NULL")
    part = F.regexp_extract("file", "part=([0-9]+)", 1).cast("long")
    return found.select(part.alias("part"), F.col("page").cast("long").alias("page"), F.col("ord").cast("long").alias("ord"), "x0", "y0", "x1", "y1", F.col("row_count").cast("long").alias("row_count"), "text_content")


@query("versioned_store", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def versioned_store(spark, d):
    """A store that takes the first half of the events, then rows appended, then the upserted whole in place of them."""
    versions.register(spark)
    path = shared_folder(spark, "store")
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    stored = lambda: spark.read.format("versions").schema(e.schema).load(path)
    save = lambda rows, mode: rows.write.format("versions").mode(mode).save(path)
    save(C.upsert(e.where("event_id % 2 = 0"), "user_id", "event_id"), "append")
    save(C.upsert(e.where("event_id % 2 = 1"), "user_id", "event_id"), "append")
    save(C.upsert(stored(), "user_id", "event_id"), "overwrite")
    return stored()


@query("first_rows", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 20")
def first_rows(spark, d):
    return D.shown(table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")), [F.desc("n"), F.col("user_id")])


def _sides(spark, d) -> tuple[DataFrame, DataFrame]:
    b = boxes(spark, d).select(F.col("page").alias("image_id"), F.col("ord").alias("det_idx"), "label", F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"))
    return b.where("det_idx % 2 = 1"), b.where("det_idx % 2 = 0")


_MATCH_SQL = """mp AS (SELECT a.page, a.ord AS p, b.ord AS g, a.label = b.label AS same, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS o, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS s
FROM boxes a JOIN boxes b ON a.page = b.page AND a.ord % 2 = 1 AND b.ord % 2 = 0 WHERE least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0)),
ms AS (SELECT page, list([{'p': p, 'g': g, 'iou': o / (s - o), 'same': same}] ORDER BY o / (s - o) DESC, p, g) AS l FROM mp WHERE o / (s - o) >= 0.3 GROUP BY page),
mm AS (SELECT page, unnest(list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.p = x[1].p OR y.g = x[1].g)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS m FROM ms),
matches AS (SELECT page, m.p AS p, m.g AS g, m.iou AS iou, m.same AS same FROM mm)"""


@query("greedy_match", f"WITH {_BOX_SQL}, {_MATCH_SQL} SELECT page AS image_id, p, g, round(iou, 9) AS iou, same AS same_label FROM matches")
def greedy_match(spark, d):
    return L.match_detections(*_sides(spark, d), threshold=0.3).withColumn("iou", F.round("iou", 9))


@query("detection_metrics", f"""WITH {_BOX_SQL}, {_MATCH_SQL}, t AS (SELECT (SELECT count(*) FROM matches) AS tp, (SELECT count(*) FROM boxes WHERE ord % 2 = 1) AS np, (SELECT count(*) FROM boxes WHERE ord % 2 = 0) AS ng, (SELECT count(*) FROM matches WHERE same) AS same)
SELECT tp, np - tp AS fp, ng - tp AS fn, round(tp / np, 9) AS precision, round(tp / ng, 9) AS recall, round(2 * tp / (np + ng), 9) AS f1, round(same / tp, 9) AS category_accuracy FROM t""")
def detection_metrics(spark, d):
    p, g = _sides(spark, d)
    m = L.metrics(L.detection_counts(p, g, L.match_detections(p, g, threshold=0.3)))
    return m.select("tp", "fp", "fn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "category_accuracy")))


@query("label_studio_round_trip", f"WITH {_BOX_SQL} SELECT '/data/local-files/?d=set/' || page || '.png' AS image_id, ord - 1 AS det_idx, label, x0 AS x, y0 AS y, x1 - x0 AS width, y1 - y0 AS height FROM boxes")
def label_studio_round_trip(spark, d):
    b = boxes(spark, d).select(F.concat(F.lit("pages/"), F.col("page").cast("string"), F.lit(".png")).alias("image"), "ord", "label", F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"))
    tasks = labelstudio.export_tasks(b.select("image").distinct(), b, "set")
    files = tasks.select(F.concat(F.lit("["), "task", F.lit("]")).alias("value"))
    return labelstudio.detections(labelstudio.read_tasks(files), "predictions").select("image_id", F.col("det_idx").cast("long").alias("det_idx"), "label", "x", "y", "width", "height")


# --- classification ---------------------------------------------------------------------------------------------------

RULES = [("articles", 1.0, 2, ["the ", "and ", " der ", " la "]), ("connectives", 0.8, 2, [" of ", " que ", " und ", " et "]), ("marks", 0.5, 1, ["###", "$$$", "!!"])]


def _rules_sql() -> str:
    cases = []
    for at, (name, weight, least, words) in enumerate(RULES):
        hits = "len(list_filter([" + ", ".join(f"'{w}'" for w in words) + "], lambda k: contains(text, k)))"
        cases.append(f"SELECT doc_id, '{name}' AS category, {at} AS place, {hits} * {weight}::DOUBLE AS score FROM documents WHERE {hits} >= {least}")
    return " UNION ALL ".join(cases)


@query("keyword_score", f"WITH s AS ({_rules_sql()}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) AS n FROM s) SELECT doc_id, category, round(least(score / 6, 1), 9) AS confidence FROM r WHERE n = 1")
def keyword_score(spark, d):
    k = docs(spark, d).select("doc_id", L.keyword_score(F.col("text"), RULES).alias("k")).where("k IS NOT NULL")
    return k.select("doc_id", F.col("k.category").alias("category"), F.round("k.confidence", 9).alias("confidence"))


@query("numeric_density", f"WITH t AS (SELECT doc_id, {S_WORDS.format('text')} AS w FROM documents) SELECT doc_id, round(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda t: regexp_full_match(t, '[0-9,.\\-+()%]+'))) / len(w) ELSE 0 END, 9) AS density FROM t")
def numeric_density(spark, d):
    return docs(spark, d).select("doc_id", F.round(X.numeric_density(F.col("text")), 9).alias("density"))


@query("temporal_evidence", "SELECT doc_id, " + " + ".join(f"len(list_distinct(regexp_extract_all(text, '{p}')))" for p in L.TEMPORAL) + " AS evidence FROM documents")
def temporal_evidence(spark, d):
    return docs(spark, d).select("doc_id", L.temporal_evidence(F.col("text")).cast("long").alias("evidence"))


_CLASS_RULES_SQL = f"""s AS ({_rules_sql()}), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) AS n FROM s),
t AS (SELECT doc_id, text, {S_WORDS.format('text')} AS w, {" + ".join(f"len(list_distinct(regexp_extract_all(text, '{p}')))" for p in L.TEMPORAL)} AS evidence FROM documents),
c AS (SELECT doc_id, category, least(score / 6, 1) + CASE WHEN evidence >= 1 THEN 0.1 ELSE 0 END AS c FROM k JOIN t USING (doc_id) WHERE n = 1 AND len(list_filter(w, lambda x: regexp_full_match(x, '[0-9,.\\-+()%]+'))) / len(w) >= 0.001)"""


@query("classify_tables", f"WITH {_CLASS_RULES_SQL} SELECT doc_id, category, round(least(c, 1), 9) AS confidence FROM c WHERE least(c, 1) >= 0.3")
def classify_tables(spark, d):
    c = docs(spark, d).select("doc_id", F.col("text").alias("text_content"))
    return L.classify_tables(c, rules=RULES, density=0.001, temporal=1).select("doc_id", "category", F.round("confidence", 9).alias("confidence"))


@query("financial_tables", f"""WITH RECURSIVE {_BOX_SQL}, {_IOU_SQL}, e AS (SELECT page, i AS x, j AS y FROM pairs WHERE iou > 0.3 UNION ALL SELECT page, j, i FROM pairs WHERE iou > 0.3),
reach(page, ord, r) AS (SELECT page, ord, ord FROM boxes UNION SELECT e.page, e.y, reach.r FROM reach JOIN e ON e.page = reach.page AND e.x = reach.ord),
lab AS (SELECT page, ord, min(r) AS label FROM reach GROUP BY 1, 2),
m AS (SELECT b.page, b.ord, row_number() OVER (PARTITION BY b.page, l.label ORDER BY (x1 - x0) * (y1 - y0) DESC, b.ord) AS n FROM boxes b JOIN lab l ON l.page = b.page AND l.ord = b.ord),
{_CLASS_RULES_SQL} SELECT page, ord, category, round(least(c, 1), 9) AS confidence, row_number() OVER (ORDER BY least(c, 1) DESC, page, ord) AS place FROM m JOIN c ON c.doc_id = m.page WHERE n = 1 AND least(c, 1) >= 0.3
ORDER BY place""")
def financial_tables(spark, d):
    """Boxes as candidates without a text of their own: each takes that of the document which is its page."""
    b = boxes(spark, d).withColumn("text_content", F.lit(None).cast("string"))
    texts = docs(spark, d).select(F.col("doc_id").alias("page"), F.col("text").alias("page_text"))
    got = L.financial_tables(b, ["page"], "ord", texts, rules=RULES, density=0.001, temporal=1)
    w = [F.desc("confidence"), F.col("page"), F.col("ord")]
    return C.running_count(got, w).select("page", "ord", "category", F.round("confidence", 9).alias("confidence"), F.col("ordinal").alias("place"))


# --- sequences --------------------------------------------------------------------------------------------------------

_RUN_SQL = """p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events),
r AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS island FROM p WHERE value > 120 * 0.8)"""


@query("anomaly_windows", f"WITH {_RUN_SQL} SELECT user_id, min(pos) AS first_pos, max(pos) AS last_pos, max(value) AS peak FROM r GROUP BY user_id, island HAVING max(value) > 120")
def anomaly_windows(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "value")
    out = L.anomaly_windows(e, "user_id", ["event_id"], "value", 120.0)
    return out.select("user_id", F.col("first_pos").cast("long").alias("first_pos"), F.col("last_pos").cast("long").alias("last_pos"), "peak")


@query("seed_windows", f"WITH {_RUN_SQL}, b AS (SELECT user_id, island, min(pos) AS first_pos, max(pos) AS last_pos FROM r GROUP BY 1, 2) SELECT r.user_id, r.pos AS seed_pos, first_pos, last_pos FROM r JOIN b USING (user_id, island) WHERE value > 120")
def seed_windows(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "value")
    out = L.seed_windows(e, "user_id", ["event_id"], "value", 120.0)
    return out.select("user_id", *(F.col(c).cast("long").alias(c) for c in ("seed_pos", "first_pos", "last_pos")))


@query("entity_spans", """WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events), r AS (SELECT user_id, pos, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS island FROM p WHERE value >= 20),
b AS (SELECT user_id, island, min(pos) AS first_pos, max(pos) AS last_pos FROM r GROUP BY 1, 2)
SELECT p.user_id, p.pos AS center_pos, first_pos, last_pos FROM p LEFT JOIN r ON r.user_id = p.user_id AND r.pos = p.pos LEFT JOIN b ON b.user_id = r.user_id AND b.island = r.island WHERE event_type = 'click'""")
def entity_spans(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "value", "event_type")
    out = L.entity_spans(e, "user_id", ["event_id"], "value", F.col("event_type") == "click", 20.0)
    return out.select("user_id", *(F.col(c).cast("long").alias(c) for c in ("center_pos", "first_pos", "last_pos")))


@query("first_seen_events", "SELECT user_id, event_type, min(event_id) AS first_event FROM events GROUP BY 1, 2")
def first_seen_events(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_event"))


@query("streaming_first_seen", "SELECT DISTINCT user_id, event_type FROM events")
def streaming_first_seen(spark, d):
    s = streams.in_files(table(spark, d, "events").select("event_id", "user_id", "event_type"), "event_id")
    return streams.drain(streams.first_seen(s.select("user_id", "event_type"), ["user_id", "event_type"]), "first_seen")


@query("streaming_windowed_counts", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS cnt FROM events GROUP BY 1, 2")
def streaming_windowed_counts(spark, d):
    """Three batches by time; windows that a cut divides are counted on."""
    e = table(spark, d, "events").withColumn("second", F.unix_timestamp(F.col("ts").cast("timestamp")))
    s = streams.windowed_counts(streams.in_files(e, "second"), "ts", "event_type")
    got = streams.drain(s, "windowed_counts", ["window_start", "event_type"])
    return got.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "cnt")


@query("streaming_upsert", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def streaming_upsert(spark, d):
    path = shared_folder(spark, "upserted")
    s = streams.in_files(table(spark, d, "events").select("user_id", "event_id", "event_type", "value"), "event_id")
    streams.upsert_into(s, path, "user_id", "event_id", f"{path}-progress").awaitTermination()
    return streams.stored(spark, path, "user_id", "event_id")


@query("streaming_near_dup", f"SELECT * FROM ({ORACLES['greedy_near_dup']}) WHERE kept")
def streaming_near_dup(spark, d):
    """Documents arrive in three batches, in order of their ids, so the rows are those of the greedy loop."""
    path = shared_folder(spark, "kept")
    s = streams.in_files(docs(spark, d).select("doc_id", "text"), "doc_id")
    streams.keep_distinct(s, path, f"{path}-progress", "text", _shingles, "doc_id", SIMILAR, PERM, BANDS).awaitTermination()
    return streams.stored(spark, path).select(F.col("id").alias("doc_id"), F.lit(True).alias("kept"))


@query("semantic_chunks", """WITH l AS (SELECT vec_id, label, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings),
c AS (SELECT vec_id, label, b IS NOT NULL AND list_cosine_similarity(embedding::DOUBLE[], b::DOUBLE[]) < 0.1 AS cut FROM l)
SELECT vec_id, label, CAST(sum(cut::INT) OVER (PARTITION BY label ORDER BY vec_id) AS BIGINT) AS chunk FROM c""")
def semantic_chunks(spark, d):
    return L.semantic_chunks(table(spark, d, "embeddings"), "vec_id", "embedding", "label", 0.1).select("vec_id", "label", F.col("chunk").cast("long").alias("chunk"))
