"""Corpus operators: exact and near duplicates, Bloom filters, substrings, vocabularies, subword training."""

from __future__ import annotations

import functools
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gleaner.functions import hashing as H
from gleaner.functions import suffixes as S
from gleaner.functions import text as X
from gleaner.operators.collect import join_same
from gleaner.operators.components import components, groups
from gleaner.operators.storage import remove, written


# --- exact duplicates -------------------------------------------------------------------------------------------------

def first_of_equal(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """Adds ``kept``: the first row (by ``order``) with the same key; rows without a key share one.

    Aggregated before the join, so a hot key costs one row a task.
    """
    keyed = rows.withColumn("_key", key)
    first = keyed.groupBy("_key").agg(F.min(order).alias("kept"))
    return join_same(keyed, first, ["_key"]).drop("_key")


def content_key(text: Column) -> Column:
    return F.concat(F.lit("md5:"), F.md5(text))


# --- MinHash and LSH --------------------------------------------------------------------------------------------------

def spread(rows: DataFrame) -> DataFrame:
    """The rows over all cores if their scan has fewer partitions (a single file is one); else as they are, without a shuffle."""
    if rows.isStreaming:
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def signatures(docs: DataFrame, text: str, shingles: Callable[[Column], Column], id: str = "doc_id", num_perm: int = 128, seed: int = 42) -> DataFrame:
    """(id, sig) of every document.  Shingling and SHA-1 stay in the JVM; of a set only 16 hexadecimal digits an item cross to the kernel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digits = batch.column("digits")
            words = np.frombuffer(bytes.fromhex("".join(digits.to_pylist())), ">u8").astype(np.uint64)
            ends = np.cumsum(pc.binary_length(digits).to_numpy(zero_copy_only=False).astype(np.int64) // 16)
            sigs = H.minhash_sets(words.view(np.int64), np.append(0, ends), num_perm, seed)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(sigs) + 1, dtype=np.int32) * num_perm), pa.array(sigs.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), flat], ["id", "sig"])

    rows = spread(docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")))
    words = rows.select("id", H.sha1_words(F.coalesce(shingles(F.col("text")), F.array().cast("array<string>"))).alias("digits"))
    return words.mapInArrow(run, "id long, sig array<long>")


def bands(sigs: DataFrame, num_perm: int = 128, num_bands: int = 16) -> DataFrame:
    H.band_threshold(num_perm, num_bands)
    r = num_perm // num_bands
    keys = F.transform(F.sequence(F.lit(0), F.lit(num_bands - 1)), lambda i: F.xxhash64(F.slice(F.col("sig"), i * r + 1, r)))
    return sigs.select("id", "sig", F.posexplode(keys).alias("band", "bucket"))


def signature_classes(sigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, sig) of one document for each distinct signature, its least id; and (a, b) for every other document b of that signature.

    Aggregated before any join, so a signature that a third of all documents share costs one row a task.
    """
    keyed = sigs.withColumns({"k1": F.xxhash64("sig"), "k2": F.xxhash64(F.reverse("sig"))})
    reps = keyed.groupBy("k1", "k2").agg(F.min("id").alias("a"), F.first("sig").alias("sig"))
    copies = keyed.join(reps.select("k1", "k2", "a"), ["k1", "k2"]).where(F.col("id") != F.col("a")).select("a", F.col("id").alias("b"))
    return reps.select(F.col("a").alias("id"), "sig"), copies


def class_pairs(reps: DataFrame, threshold: float | None = None, num_perm: int = 128, num_bands: int = 16) -> DataFrame:
    """(a, b, sim), a < b, of all distinct signatures that share a bucket and reach the threshold."""
    threshold = H.band_threshold(num_perm, num_bands) if threshold is None else threshold
    b = bands(reps, num_perm, num_bands).select("id", "band", "bucket")
    left, right = (b.select("band", "bucket", F.col("id").alias(x)) for x in "ab")
    candidates = left.join(right, ["band", "bucket"]).where("a < b").select("a", "b").distinct()
    s1, s2 = (reps.select(F.col("id").alias(r), F.col("sig").alias(f"s{r}")) for r in "ab")
    return candidates.join(s1, "a").join(s2, "b").select("a", "b", H.similarity(F.col("sa"), F.col("sb"), num_perm).alias("sim")).where(F.col("sim") >= threshold)


def similar_pairs(sigs: DataFrame, threshold: float | None = None, num_perm: int = 128, num_bands: int = 16) -> DataFrame:
    """(a, b, sim), a < b: all similar pairs of different signatures, each by its first document, and one row (first document, copy, 1)
    for each further document of a signature.  The copies' other pairs follow from these rows and aren't written out.

    ``sigs`` is read several times: give it as a table.
    """
    reps, copies = signature_classes(sigs)
    return class_pairs(reps, threshold, num_perm, num_bands).unionByName(copies.withColumn("sim", F.lit(1.0)))


def near_duplicate_clusters(docs: DataFrame, text: str, shingles: Callable[[Column], Column], id: str = "doc_id", threshold: float | None = None, num_perm: int = 128, num_bands: int = 16) -> DataFrame:
    """``id`` and ``label``: the least id of the cluster, for every document."""
    sigs, _ = written(signatures(docs, text, shingles, id, num_perm), "signatures")
    return groups(sigs.select("id"), similar_pairs(sigs, threshold, num_perm, num_bands))


#: Components with more links than this are judged in rounds over the whole cluster instead of one task each.
GREEDY_LINKS = 100_000


def greedy_near_duplicates(sigs: DataFrame, threshold: float | None = None, num_perm: int = 128, num_bands: int = 16) -> DataFrame:
    """Keeps, in order of id, every document that is similar to no document kept before; ``kept`` marks them.

    A copy of an earlier signature never stays: its first document stays, or went because of one that excludes the copy as well.
    Only documents of one component can exclude each other (``excluded``).
    """
    reps, copies = signature_classes(sigs)
    gone = excluded(class_pairs(reps, threshold, num_perm, num_bands).select("a", "b"))
    gone = gone.unionAll(copies.select(F.col("b").alias("id"))).withColumn("gone", F.lit(True))
    return sigs.select("id").join(gone, "id", "left").select("id", F.col("gone").isNull().alias("kept"))


def excluded(pairs: DataFrame) -> DataFrame:
    """(id) of what goes if, in order of the numbers, everything stays that is in no pair (a, b), a < b, with an ``a`` that stays.

    Small components of the pairs are judged in one task each, large ones in rounds: who has no undecided one before it stays, and those
    after it go.
    """
    pairs, _ = written(pairs, "pairs")
    labels = components(pairs)
    edges = pairs.join(labels, pairs["a"] == labels["id"]).select("label", "a", "b")
    small = edges.groupBy("label").count().where(F.col("count") <= GREEDY_LINKS).select("label")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        before: dict[int, list[int]] = {}
        for a, b in zip(group["a"], group["b"]):
            before.setdefault(b, []).append(a)
        gone: set[int] = set()
        for d in sorted(before):
            if any(o not in gone for o in before[d]):
                gone.add(d)
        return pd.DataFrame({"id": sorted(gone)}, dtype="int64")

    gone = edges.join(small, "label", "left_semi").groupBy("label").applyInPandas(run, "id long")
    left, _ = written(edges.join(small, "label", "left_anti").select("a", "b"), "undecided")
    while not left.isEmpty():
        kept = left.select("a").distinct().join(left.select(F.col("b").alias("a")), "a", "left_anti")
        out, _ = written(left.join(kept, "a", "left_semi").select(F.col("b").alias("id")).distinct(), "dropped")
        gone = gone.unionAll(out)
        done = kept.select(F.col("a").alias("id")).unionAll(out)
        left, _ = written(left.join(done.withColumnRenamed("id", "a"), "a", "left_anti").join(done.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b"), "undecided")
    return gone


def query_index(queries: DataFrame, index: DataFrame, k: int | None = None, num_perm: int = 128, num_bands: int = 16) -> DataFrame:
    """(query_id, id, sim, rank) of index rows that share a bucket with a query, best first (ties to the smaller id), ``k`` at most.

    A query's own id isn't an answer to it.
    """
    qb, ib = bands(queries, num_perm, num_bands), bands(index, num_perm, num_bands)
    hits = qb.select(F.col("id").alias("query_id"), "band", "bucket").join(ib.select("id", "band", "bucket"), ["band", "bucket"]).where("query_id <> id").select("query_id", "id").distinct()
    scored = hits.join(queries.select(F.col("id").alias("query_id"), F.col("sig").alias("qs")), "query_id").join(index.select("id", "sig"), "id")
    out = scored.select("query_id", "id", H.similarity(F.col("qs"), F.col("sig"), num_perm).alias("sim"))
    ranked = out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("sim"), "id")))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def accuracy_study(docs: DataFrame, text: str, shingles: Callable[[Column], Column], pair: Column, id: str, sizes: Sequence[int], seeds: Sequence[int]) -> DataFrame:
    """(num_perm, pairs, mean_error): mean absolute error of estimated similarities, over two documents a pair and all seeds."""
    out = None
    sets = docs.select(pair.alias("pair"), id, shingles(F.col(text)).alias("set"))
    both = sets.groupBy("pair").agg(F.array_sort(F.collect_list(F.struct(id, "set"))).alias("d")).where(F.size("d") == 2)
    exact = both.select("pair", X.jaccard(F.col("d")[0]["set"], F.col("d")[1]["set"]).alias("exact"))
    of_pair = docs.select(pair.alias("pair"), F.col(id).cast("long").alias("id"))
    for n in sizes:
        for seed in seeds:
            sigs = signatures(docs, text, shingles, id, n, seed).join(of_pair, "id")
            met = sigs.groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("id", "sig"))).alias("s")).where(F.size("s") == 2)
            one = met.select("pair", F.lit(n).alias("num_perm"), H.similarity(F.col("s")[0]["sig"], F.col("s")[1]["sig"], n).alias("estimate"))
            out = one if out is None else out.unionAll(one)
    return out.join(exact, "pair").groupBy("num_perm").agg(F.count_distinct("pair").alias("pairs"), F.avg(F.abs(F.col("estimate") - F.col("exact"))).alias("mean_error"))


# --- Bloom filters ----------------------------------------------------------------------------------------------------

#: Bits of the largest filter that is broadcast (32 MB).
BROADCAST_BITS = 1 << 28


def bloom_build(items: DataFrame, item: str, m: int, k: int) -> DataFrame:
    """Bit array as (bucket, bitmap) rows of 32768 bits."""
    at = items.select(F.explode(H.bloom_positions(F.col(item), m, k)).alias("p"))
    return at.groupBy(F.bitmap_bucket_number(F.col("p") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("p") + 1)).alias("bitmap"))


def bloom_contains(probes: DataFrame, item: str, bloom: DataFrame, m: int, k: int) -> DataFrame:
    """Adds ``maybe``: whether all k bits of the item are set.

    A filter of up to ``BROADCAST_BITS`` bits goes to every task; a larger one is cut into pieces of 2048 bits, so that probes meet many keys.
    """
    asked = probes.select(F.col(item).alias("_item")).distinct()
    bits = asked.select("_item", F.explode(F.array_distinct(H.bloom_positions(F.col("_item"), m, k))).alias("p"))
    bits = bits.withColumn("bucket", F.bitmap_bucket_number(F.col("p") + 1)).withColumn("bit", F.bitmap_bit_position(F.col("p") + 1))
    if m <= BROADCAST_BITS:
        met = bits.join(F.broadcast(bloom), "bucket", "left")
    else:
        cut = bloom.select("bucket", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.substring("bitmap", i * 256 + 1, F.lit(256)))).alias("piece", "bitmap"))
        met = bits.withColumn("piece", F.floor(F.col("bit") / 2048).cast("int")).withColumn("bit", F.col("bit") % 2048).join(cut, ["bucket", "piece"], "left")
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = met.groupBy("_item").agg(F.bool_and(F.coalesce(F.expr("1 << CAST(bit % 8 AS INT)").bitwiseAND(byte) != 0, F.lit(False))).alias("maybe"))
    return probes.join(found, probes[item] == found["_item"], "left").drop("_item").withColumn("maybe", F.coalesce("maybe", F.lit(False)))


def _is_set(bitmap: Column, bit: Column) -> Column:
    """Whether a bit of a bitmap is set; not where the bitmap is null."""
    byte = F.conv(F.hex(F.substring(bitmap, (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    mask = F.element_at(F.array(*(F.lit(1 << i) for i in range(8))), (bit % 8 + 1).cast("int"))
    return F.coalesce(mask.bitwiseAND(byte) != 0, F.lit(False))


def bloom_first_seen(items: DataFrame, item: str, order: str, m: int, k: int, bloom: DataFrame | None = None) -> DataFrame:
    """Adds ``seen``: what a filter answers if every item is probed in turn and added if it wasn't seen, false positives included.

    Adding an item whose bits are all set changes nothing, so before each item the filter holds the bits of all earlier ones, whether
    they were added or not.  An item is therefore new exactly if it is the first one with one of its bits, which is one minimum for
    each bit; no step waits for the one before.  ``order`` is unique; ``bloom`` is a filter that holds items already (as from
    ``bloom_build``).  A null item is never looked at: ``seen`` is null.
    """
    first = items.where(F.col(item).isNotNull()).groupBy(F.col(item).alias("_item")).agg(F.min(order).alias("_at"))
    bits = first.select("_at", F.explode(F.array_distinct(H.bloom_positions(F.col("_item"), m, k))).alias("p"))
    if bloom is not None:
        asked = bits.withColumns({"bucket": F.bitmap_bucket_number(F.col("p") + 1), "bit": F.bitmap_bit_position(F.col("p") + 1)})
        held = F.broadcast(bloom) if m <= BROADCAST_BITS else bloom
        bits = asked.join(held.select("bucket", "bitmap"), "bucket", "left").where(~_is_set(F.col("bitmap"), F.col("bit"))).select("_at", "p")
    new = bits.groupBy("p").agg(F.min("_at").alias("_new")).select("_new").distinct()
    return items.join(new, items[order] == new["_new"], "left").withColumn("seen", F.when(F.col(item).isNotNull(), F.col("_new").isNull())).drop("_new")


def safe_lookup(probes: DataFrame, item: str, bloom: DataFrame, m: int, k: int, store: DataFrame, key: str) -> DataFrame:
    """Adds ``maybe`` (the filter's answer) and ``found``: items that the filter doesn't know are absent, only the others are looked up."""
    asked = bloom_contains(probes, item, bloom, m, k)
    known = store.select(F.col(key).alias("_key")).distinct()
    hits = asked.where("maybe").select(item).distinct().join(known, F.col(item) == F.col("_key"), "left_semi").select(F.col(item).alias("_hit"))
    return asked.join(hits, asked[item] == hits["_hit"], "left").withColumn("found", F.col("_hit").isNotNull()).drop("_hit")


def has_capacity(stats: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Adds ``ok``: whether the estimated false-positive rate is at most the threshold."""
    return stats.withColumn("ok", F.col("estimated_fpr") <= threshold)


def add_once(rows: DataFrame, id: str, order: str) -> DataFrame:
    """The first row of every id: a second one with an id that is there changes nothing; rows without an id share one."""
    first = rows.groupBy(id).agg(F.min(order).alias(order))
    return join_same(rows, first, [id, order], "left_semi").dropDuplicates([id]).select(*rows.columns)


def bloom_stats(bloom: DataFrame, inserted: int, m: int, k: int) -> DataFrame:
    import math

    rate = 0.0 if inserted == 0 else (1 - math.exp(-k * inserted / m)) ** k
    ones = F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0))
    return bloom.agg(F.lit(m).cast("long").alias("bits"), F.lit(k).cast("long").alias("hashes"), F.lit(inserted).cast("long").alias("inserted"), ones.cast("long").alias("ones"), F.round(ones / m, 6).alias("fill_ratio"), F.lit(round(rate, 6)).alias("estimated_fpr"), F.lit((m + 7) // 8).cast("long").alias("memory_bytes"))


def counting_removals(added: DataFrame, removed: DataFrame, item: str, m: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(pos, cnt) after all additions, and (item, positions, removed): whether each item that is to go was there."""
    up = added.select(F.explode(H.bloom_positions(F.col(item), m, k)).alias("pos")).groupBy("pos").agg(F.count("*").alias("cnt"))
    asked = removed.select(F.col(item).alias("item")).withColumn("positions", H.bloom_positions(F.col("item"), m, k))
    hit = asked.select("item", F.explode(F.array_distinct("positions")).alias("pos")).distinct().join(up, "pos", "left")
    there = hit.groupBy("item").agg(F.bool_and(F.col("cnt").isNotNull()).alias("removed"))
    return up, asked.join(there, "item", "left")


def counting_bloom(added: DataFrame, removed: DataFrame, item: str, m: int, k: int) -> DataFrame:
    """(pos, cnt) after all additions and then all removals; a removal of an item that isn't there changes nothing."""
    up, asked = counting_removals(added, removed, item, m, k)
    down = asked.where("removed").select(F.explode("positions").alias("pos")).groupBy("pos").agg(F.count("*").alias("gone"))
    return up.join(down, "pos", "left").select("pos", F.greatest(F.lit(0), F.col("cnt") - F.coalesce("gone", F.lit(0))).alias("cnt")).where("cnt > 0")


def counting_contains(probes: DataFrame, item: str, counts: DataFrame, m: int, k: int) -> DataFrame:
    """(item, maybe): whether all of an item's counters are above zero."""
    asked = probes.select(F.col(item).alias("item")).distinct().select("item", F.explode(F.array_distinct(H.bloom_positions(F.col("item"), m, k))).alias("pos"))
    return asked.join(counts, "pos", "left").groupBy("item").agg(F.bool_and(F.coalesce(F.col("cnt") > 0, F.lit(False))).alias("maybe"))


# --- substrings and suffixes ------------------------------------------------------------------------------------------

def _per_text(docs: DataFrame, columns: list[str], kernel: Callable, schema: T.StructType) -> DataFrame:
    """Rows that ``kernel`` makes of each row's values; a batch of results ends after some 100,000 of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(schema)
        for batch in batches:
            held, n = [[] for _ in schema.fields], 0
            for values in zip(*(batch.column(c).to_pylist() for c in columns)):
                made = kernel(*values)
                for column, field, part in zip(held, target, made):
                    column.append(pa.array(part, field.type))
                n += len(made[0])
                if n > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in held], schema=target)
                    held, n = [[] for _ in schema.fields], 0
            if n:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in held], schema=target)

    return spread(docs.select(*columns)).mapInArrow(run, schema)


def repeated_substrings(docs: DataFrame, id: str, text: str = "text", least: int = 2) -> DataFrame:
    """(id, substring, cnt): every substring of ``least`` to n - 1 characters that occurs twice or more; overlaps count.

    Suffix sorting tells how far each position repeats, so only strings that repeat are written out.
    """
    reach = F.pandas_udf(lambda t: t.map(lambda s: S.repeated_reach(s or "")), "array<int>")
    at = spread(docs.select(id, text)).select(id, text, F.posexplode(reach(F.col(text))).alias("at", "reach")).where(F.col("reach") >= least)
    subs = at.select(id, F.explode(F.transform(F.sequence(F.lit(least), F.col("reach")), lambda k: F.substring(F.col(text), F.col("at") + 1, k))).alias("substring"))
    return subs.groupBy(id, "substring").agg(F.count("*").alias("cnt"))


def suffix_array(docs: DataFrame, id: str, text: str = "text") -> DataFrame:
    """(id, sa_rank, pos, lcp): suffixes in code-point order, 0-based, and the common prefix with the one before."""

    def one(key, value: str | None):
        order, common = S.sort_suffixes(S.code_points(value or ""))
        return [[key] * len(order), np.arange(len(order)), order, common]

    schema = T.StructType([docs.schema[id], *(T.StructField(c, T.LongType()) for c in ("sa_rank", "pos", "lcp"))])
    return _per_text(docs, [id, text], one, schema)


def longest_repeated_substring(docs: DataFrame, id: str, text: str = "text") -> DataFrame:
    """(id, lrs) of every row; empty where nothing repeats."""
    longest = F.pandas_udf(lambda t: t.map(lambda s: S.longest_repeat(s or "")), "string")
    return spread(docs.select(id, text)).select(id, longest(F.col(text)).alias("lrs"))


def common_substrings(pairs: DataFrame, id: str, a: str, b: str, least: int = 10) -> DataFrame:
    """(id, ord, substring): common substrings of two texts of a row, in suffix order; null counts as empty."""

    def one(key, x: str | None, y: str | None):
        found = S.common_runs(x or "", y or "", least)
        return [[key] * len(found), np.arange(len(found)), found]

    schema = T.StructType([pairs.schema[id], T.StructField("ord", T.LongType()), T.StructField("substring", T.StringType())])
    return _per_text(pairs, [id, a, b], one, schema)


def frequent_bigram(docs: DataFrame, id: str, text: str = "text") -> DataFrame:
    """Most frequent pair of neighbouring characters without a space; the earlier first occurrence wins ties."""
    two = lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.concat(F.get(c, i - 1), F.get(c, i)))
    pairs = docs.where(F.length(text) >= 2).select(id, F.posexplode(X.let(X.characters(F.col(text)), two)).alias("pos", "bigram")).where("NOT contains(bigram, ' ')")
    counted = pairs.groupBy(id, "bigram").agg(F.count("*").alias("cnt"), F.min("pos").alias("first"))
    best = counted.groupBy(id).agg(F.max(F.struct("cnt", (-F.col("first")).alias("f"), "bigram")).alias("b"))
    return docs.select(id).join(best, id, "left").select(id, F.col("b.bigram").alias("bigram"), F.col("b.cnt").alias("cnt"))


# --- subword training -------------------------------------------------------------------------------------------------

def word_table(docs: DataFrame, order: str, text: str = "text") -> DataFrame:
    """Distinct white-space words with frequency, first place of occurrence, and characters plus an end mark as symbols."""
    w = docs.select(order, F.posexplode(X.words(F.col(text))).alias("p", "word"))
    counted = w.groupBy("word").agg(F.count("*").alias("freq"), F.min(F.struct(order, "p")).alias("first"))
    return counted.select("word", "freq", "first", F.concat(F.filter(F.split("word", ""), lambda c: c != ""), F.array(F.lit("</w>"))).alias("symbols"))


def symbol_table(rows: DataFrame, order: str, symbols: str = "symbols") -> DataFrame:
    """As ``word_table``, for text that is cut into symbols already: every row is one word, with white space between its symbols."""
    return rows.select(F.col(symbols).alias("word"), F.lit(1).cast("long").alias("freq"), F.struct(F.col(order), F.lit(0).alias("p")).alias("first"), X.words(F.col(symbols)).alias("symbols"))


def pair_counts(words: DataFrame) -> DataFrame:
    """Weighted counts of neighbouring symbols, with the first place of each pair for ties."""
    s = F.col("symbols")
    pairs = words.where(F.size(s) > 1).select("freq", "first", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.struct(F.element_at(s, i).alias("l"), F.element_at(s, i + 1).alias("r")))).alias("at", "pair"))
    return pairs.groupBy("pair.l", "pair.r").agg(F.sum("freq").alias("cnt"), F.min(F.struct("first", "at")).alias("seen"))


def merge_pair(symbols: Column, left: str, right: str) -> Column:
    """Left-to-right, non-overlapping merges of one pair."""
    def step(acc: Column, x: Column) -> Column:
        join = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) == left) & (x == right)
        return F.when(join, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.lit(left + right)))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(symbols, F.array().cast("array<string>"), step)


def _merged(symbols: list[str], steps: dict[tuple[str, str], list[int]], begin: int = 0) -> list[str]:
    """One word's symbols after the merges from number ``begin`` on, in order; ``steps`` has the numbers of each pair's merges."""
    while True:
        coming = [steps[p][bisect_left(steps[p], begin)] for p in set(zip(symbols, symbols[1:])) if p in steps and steps[p][-1] >= begin]
        if not coming:
            return symbols
        begin = min(coming)
        pair = next(p for p in zip(symbols, symbols[1:]) if begin in steps.get(p, ()))
        out, k = [], 0
        while k < len(symbols):
            wide = 2 if k + 1 < len(symbols) and (symbols[k], symbols[k + 1]) == pair else 1
            out.append("".join(symbols[k : k + wide]))
            k += wide
        symbols, begin = out, begin + 1


def _steps(merges: Sequence[tuple]) -> dict[tuple[str, str], list[int]]:
    out: dict[tuple[str, str], list[int]] = {}
    for k, m in enumerate(merges):
        out.setdefault((m[0], m[1]), []).append(k)
    return out


def _per_word(words: DataFrame, results: Callable[[list[str], int], list[tuple]], columns: str) -> DataFrame:
    """``results`` of each word's first symbols and frequency, beside the word."""
    schema = T.StructType([*words.schema.fields, *T.StructType.fromDDL(columns).fields])
    added = [f.name for f in schema.fields[len(words.schema.fields) :]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [f.type for f in to_arrow_schema(schema)][-len(added) :]
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                rows = [(i, *r) for i, (s, f) in enumerate(zip(part.column("symbols").to_pylist(), part.column("freq").to_pylist())) for r in results(s, f)]
                own = part.take(pa.array([r[0] for r in rows], pa.int64()))
                new = [pa.array([r[k + 1] for r in rows], t) for k, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*own.columns, *new], [f.name for f in schema.fields])

    return words.mapInArrow(run, schema)


def _any_of(pairs: Sequence[tuple]) -> Column:
    return functools.reduce(Column.__or__, [(F.col("l") == p[0]) & (F.col("r") == p[1]) for p in pairs])


class _PairIndex:
    """Which words have had a pair, and how often each pair occurs now.

    Entries (pair, word as it was cut at first) are written in order of the pair, so that a filter on pairs reads few row
    groups.  They are never taken back: what a word looks like now follows from its first symbols and the merges so far.
    Words of more than ``INLINE`` symbols are kept beside the entries.  A merge reads the entries of its pair, adds entries
    for the pairs that it makes and the changes to the counts; the other words aren't read.
    """

    INLINE = 64
    HEAD = 64

    def __init__(self, words: DataFrame):
        self.spark = words.sparkSession
        words, path = written(words.where(F.size("symbols") > 1).groupBy("first", "symbols").agg(F.sum("freq").alias("freq")), "words")
        s, short = F.col("symbols"), F.size("symbols") <= self.INLINE
        both = F.transform(F.slice(s, 2, F.size(s)), lambda r, i: F.struct(F.get(s, i).alias("l"), r.alias("r")))
        entries = words.withColumn("pair", F.explode(F.array_distinct(both))).withColumn("symbols", F.when(short, s))
        counts, counts_path = written(pair_counts(words).select("l", "r", "cnt"), "pairs")
        entries = entries.select("pair.*", "freq", "first", "symbols", F.lit(0).cast("long").alias("change"), F.lit(True).alias("fresh"))
        entries, entries_path = written(entries.transform(self.sorted), "entries")
        self.long, long_path = written(words.where(~short).select("freq", "first", "symbols"), "words")
        self.counts, self.counts_path, self.entries, self.paths = counts, counts_path, [entries_path], [path, counts_path, entries_path, long_path]
        self.schema = entries.schema
        self.learned: list[tuple[str, str, int]] = []

    @staticmethod
    def sorted(entries: DataFrame) -> DataFrame:
        """In order of the pair; a pair of very many words is cut by their places."""
        return entries.repartitionByRange("l", "r", "first").sortWithinPartitions("l", "r")

    def words_of(self, entries: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The words of some entries, each once, with their first symbols."""
        now = self.spark.read.schema(self.schema).parquet(*self.entries).where("fresh")
        hits = entries(now).select("freq", "first", "symbols").distinct()
        far = hits.where("symbols IS NULL").select("first")
        return hits.where("symbols IS NOT NULL").unionByName(self.long.join(far, "first", "left_semi"))

    def by_place(self, tied: DataFrame, found: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The pairs with the place where each stands first now: the word's first place, then the character in it."""
        steps = _steps(self.learned)

        def places(symbols: list[str], _: int) -> list[tuple]:
            first, at = {}, 0
            now = _merged(symbols, steps)
            for left, right in zip(now, now[1:]):
                first.setdefault((left, right), at)
                at += len(left)
            return [(*pair, at) for pair, at in first.items()]

        seen = _per_word(self.words_of(found), places, "l string, r string, at long").join(tied, ["l", "r"], "left_semi")
        return seen.groupBy("l", "r").agg(F.min(F.struct("first", "at")).alias("seen"))

    def ranking(self) -> list[tuple[str, str, int]]:
        """The first pairs by count, then place: all of them or at least one, at most ``HEAD``."""
        often = self.counts.where("cnt >= 2")
        head = [tuple(r) for r in often.orderBy(F.desc("cnt"), "l", "r").limit(self.HEAD + 1).collect()]
        if len(head) > self.HEAD:
            least = head[-1][2]
            if head[0][2] == least:  # more ties than fit: place them all as a table
                tied = often.where(F.col("cnt") == least)
                placed = self.by_place(tied, lambda e: e.join(tied, ["l", "r"], "left_semi"))
                return [(r["l"], r["r"], least) for r in placed.orderBy("seen").limit(self.HEAD).collect()]
            head = [h for h in head if h[2] > least]
        ties = Counter(h[2] for h in head)
        tied = [h for h in head if ties[h[2]] > 1]
        if tied:
            rows = self.by_place(self.spark.createDataFrame(tied, "l string, r string, cnt long"), lambda e: e.where(_any_of(tied))).orderBy("seen").collect()
            order = {(r["l"], r["r"]): k for k, r in enumerate(rows)}
            head.sort(key=lambda h: (-h[2], order.get(h[:2], 0)))
        return head

    def next_merges(self, most: int) -> list[tuple[str, str, int]]:
        """The next merges, as many as the present counts decide.

        While the first pairs of the ranking share no symbol, merging one neither changes the next one's count nor makes a pair
        that goes before it: a new pair occurs at most as often as one that ranks behind, and not before its place.  That ends
        with a merge that makes a symbol which exists already.
        """
        out, used = [], set()
        for h in self.ranking()[:most]:
            symbols = {h[0], h[1], h[0] + h[1]}
            if symbols & used:
                break
            out.append(h)
            used |= symbols
        made = [h[0] + h[1] for h in out]
        there = {r[0] for r in self.counts.where(F.col("l").isin(made)).select("l").union(self.counts.where(F.col("r").isin(made)).select("r")).distinct().collect()}
        stop = next((k + 1 for k, m in enumerate(made) if m in there), len(out))
        return out[:stop]

    def merge(self, batch: list[tuple[str, str, int]]) -> None:
        begin, self.learned = len(self.learned), self.learned + batch
        before, after = _steps(self.learned[:begin]), _steps(self.learned)

        def changes(symbols: list[str], freq: int) -> list[tuple]:
            old = _merged(symbols, before)
            new = _merged(old, after, begin)
            had, has = Counter(zip(old, old[1:])), Counter(zip(new, new[1:]))
            return [(*p, (has[p] - had[p]) * freq, p not in had) for p in had | has if has[p] != had[p]]

        changed = _per_word(self.words_of(lambda e: e.where(_any_of(batch))), changes, "l string, r string, change long, fresh boolean")
        changed = changed.withColumn("symbols", F.when(F.size("symbols") <= self.INLINE, F.col("symbols")))
        changed, path = written(changed.select(*self.schema.names).sortWithinPartitions("l", "r"), "entries")
        moved = self.counts.unionByName(changed.select("l", "r", F.col("change").alias("cnt"))).groupBy("l", "r").agg(F.sum("cnt").alias("cnt")).where("cnt > 0")
        counts, counts_path = written(moved, "pairs")
        remove(self.spark, self.counts_path)
        self.counts, self.counts_path = counts, counts_path
        self.entries.append(path)
        self.paths += [path, counts_path]
        if len(self.entries) > 16:  # put the small tables of past merges together
            _, path = written(self.spark.read.schema(self.schema).parquet(*self.entries[1:]).where("fresh").transform(self.sorted), "entries")
            self.entries = [self.entries[0], path]
            self.paths.append(path)


def train_bpe(words: DataFrame, merges: int = 10) -> tuple[list[tuple[str, str, int]], DataFrame]:
    """Learned merges (left, right, count) in order, and the words with their last symbols.

    Counts are kept from merge to merge: a round reads the words of the pairs that it merges and adds up what changes.
    A round takes all merges that the counts decide.  Stops when no pair occurs twice; of equally frequent pairs the one met
    first is taken.  The merges travel with the tasks: their number is a parameter.
    """
    index = _PairIndex(words)
    while len(index.learned) < merges:
        batch = index.next_merges(merges - len(index.learned))
        if not batch:
            break
        index.merge(batch)
    steps = _steps(index.learned)
    kept = words.withColumnRenamed("symbols", "_cut").withColumn("symbols", F.col("_cut"))
    last = _per_word(kept, lambda s, _: [(_merged(s, steps) if s else s,)], "_last array<string>")
    learned = index.learned
    remove(index.spark, *index.paths)
    return learned, last.select(*[F.col("_last").alias(c) if c == "symbols" else c for c in words.columns])


def tokenize_bpe(word: Column, merges: Sequence[tuple[str, str]]) -> Column:
    symbols = F.concat(F.filter(F.split(word, ""), lambda c: c != ""), F.array(F.lit("</w>")))
    for left, right in merges:
        symbols = merge_pair(symbols, left, right)
    return symbols


# --- vocabulary -------------------------------------------------------------------------------------------------------

def prefixes_of(c: Column) -> Column:
    return F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.substring(c, F.lit(1), i))).otherwise(F.array().cast("array<string>"))


def vocabulary_prefixes(texts: DataFrame, text: str, vocab: DataFrame, token: str = "token") -> DataFrame:
    """Adds ``all_prefixes`` (vocabulary tokens that start the text, shortest first) and ``longest_prefix`` (null if none)."""
    distinct = texts.select(F.col(text).alias("_t")).distinct()
    long = vocab.agg(F.max(F.length(token))).first()[0] or 0
    exploded = distinct.select("_t", F.explode(prefixes_of(F.substring("_t", 1, long))).alias("p"))
    hits = exploded.join(vocab.select(F.col(token).alias("p")).distinct(), "p").groupBy("_t").agg(F.array_sort(F.collect_list(F.struct(F.length("p").alias("n"), "p"))).alias("h"))
    out = texts.join(hits, texts[text] == hits["_t"], "left").drop("_t")
    found = F.coalesce(F.col("h.p"), F.array().cast("array<string>"))
    return out.withColumn("all_prefixes", found).withColumn("longest_prefix", F.try_element_at(found, F.lit(-1))).drop("h")


def starts_with(prefixes: DataFrame, prefix: str, vocab: DataFrame, token: str = "token") -> DataFrame:
    known = vocab.select(F.explode(prefixes_of(F.col(token))).alias("_p")).distinct()
    known = known.unionAll(vocab.sparkSession.createDataFrame([("",)], "_p string")).withColumn("_hit", F.lit(True))
    return prefixes.join(known, prefixes[prefix] == known["_p"], "left").drop("_p").withColumn("known", F.coalesce("_hit", F.lit(False))).drop("_hit")


def wordpiece(word: Column, vocab: Sequence[str], longest: int = 100) -> Column:
    """Greedy longest match with ## continuations; a word that can't be split whole is [UNK].

    The vocabulary is a parameter of at most a million tokens; a bare ## is skipped, since it would match without end.
    """
    if len(vocab) > 1_000_000:
        raise ValueError("the vocabulary has over a million tokens")
    starts = frozenset(t for t in vocab if t and not t.startswith("##"))
    inner = frozenset(t[2:] for t in vocab if t.startswith("##") and len(t) > 2)
    reach = max((len(t) for t in vocab), default=0)

    @F.pandas_udf("array<string>")
    def split(words: pd.Series) -> pd.Series:
        def one(w: str | None) -> list[str] | None:
            if w is None:
                return None
            if not w or len(w) > longest:
                return ["[UNK]"] if w else []
            out, at = [], 0
            while at < len(w):
                known, mark = (inner, "##") if at else (starts, "")
                end = next((e for e in range(min(len(w), at + reach), at, -1) if w[at:e] in known), None)
                if end is None:
                    return ["[UNK]"]
                out.append(mark + w[at:end])
                at = end
            return out

        return words.map(one)

    return split(word)


def vocabulary_tree(tokens: Sequence[str], depth: int = 5) -> str:
    """The trie of a small vocabulary as indented lines; a star marks the end of a token."""
    lines = []
    for p in sorted({t[:k] for t in tokens for k in range(1, min(len(t), depth) + 1)}):
        lines.append("  " * (len(p) - 1) + p[-1] + ("*" if p in set(tokens) else ""))
    return "\n".join(lines)
