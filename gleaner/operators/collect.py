"""Collection operators: deduplicated, balanced sampling of reports and their metadata; group statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.operators.storage import written


def join_same(rows: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joins rows whose keys are equal, null being equal to null; the keys come once."""
    renamed = other.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_same_{k}")) for k in keys))
    return rows.join(renamed, same, how).drop(*(f"_same_{k}" for k in keys))


def running_total(rows: DataFrame, order: list[Column], value: Column, into: str, buckets: int | None = None) -> DataFrame:
    """Adds ``into``: the sum of ``value`` over the whole table up to each row, without sending all rows to one task.

    Rows are sorted by range into partitions and written with the number of theirs: each plan over a range partitioning samples bounds of
    its own, so the sums inside the partitions and the sums of whole partitions (one row each) must come from one and the same table.
    Rows that tie by ``order`` come by a hash of their columns, which also spreads many ties over partitions.
    """
    buckets = buckets or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ties = F.xxhash64(*(F.col(f"`{f.name}`") for f in rows.schema if "map" not in f.dataType.simpleString()))
    placed = rows.withColumn("_v", value).repartitionByRange(buckets, *order, ties).withColumn("_p", F.spark_partition_id())
    part, _ = written(placed, "ranges")
    inner = part.withColumn("_n", F.sum("_v").over(W.partitionBy("_p").orderBy(*order, ties).rowsBetween(W.unboundedPreceding, 0)))
    sizes = part.groupBy("_p").agg(F.sum("_v").alias("_size"))
    before = sizes.select("_p", F.coalesce(F.sum("_size").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    # one row a partition
    return inner.join(F.broadcast(before), "_p").withColumn(into, F.col("_n") + F.col("_before")).select(*(f"`{c}`" for c in rows.columns), into)


def running_count(rows: DataFrame, order: list[Column], buckets: int | None = None) -> DataFrame:
    """Adds ``ordinal``: the place of each row, from 1."""
    return running_total(rows, order, F.lit(1).cast("long"), "ordinal", buckets)


def quota_sample(rows: DataFrame, group: str, order: str, minimum: int, target: int) -> DataFrame:
    """``minimum`` rows of every group in turn, then round-robin, ``target`` rows in all; groups in order of their first row.

    Rows without a group are a group.
    """
    first = rows.groupBy(group).agg(F.min(order).alias("_g"))
    # no group can give more than the target, which bounds what the window has to rank
    ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(order))).where(F.col("_r") <= target).transform(join_same, first, [group])
    early = F.col("_r") <= minimum
    key = [F.when(early, 0).otherwise(1), F.when(early, F.col("_g")).otherwise(F.col("_r")), F.when(early, F.col("_r")).otherwise(F.col("_g"))]
    return ranked.orderBy(*key).limit(target).select(*rows.columns)


def new_reports(reports: DataFrame, known: DataFrame, url: str = "pdf_url", order: str = "ord") -> DataFrame:
    """Reports whose URL isn't known yet, each URL once (its first row); reports without a URL can't be fetched and go."""
    fresh = reports.join(known.select(url).distinct(), url, "left_anti")
    first = fresh.groupBy(url).agg(F.min(order).alias(order))
    return fresh.join(first, [url, order], "left_semi").select(*reports.columns)


def content_status(downloads: DataFrame, known: DataFrame, order: str = "ord") -> DataFrame:
    """Adds ``status``: new, or duplicate_content:<path> of the stored or earlier file with the same hash.

    A file without a hash is new: nothing says that it equals another.
    """
    stored = known.groupBy("file_hash").agg(F.max("local_path").alias("_stored"))
    first = downloads.groupBy("file_hash").agg(F.min(F.struct(order, "local_path")).alias("_f"))
    out = downloads.join(stored, "file_hash", "left").join(first, "file_hash", "left")
    path = F.coalesce("_stored", F.when(F.col(order) > F.col(f"_f.{order}"), F.col("_f.local_path")))
    return out.withColumn("status", F.when(path.isNull(), "new").otherwise(F.concat(F.lit("duplicate_content:"), path))).drop("_stored", "_f")


def sequence_names(rows: DataFrame, group: list[str], order: str, taken: DataFrame) -> DataFrame:
    """Adds ``file_name`` {date}_{seq}.pdf; the numbers go on from the largest one taken (``group``, seq)."""
    top = taken.groupBy(*group).agg(F.max("seq").alias("_top"))
    seq = F.row_number().over(W.partitionBy(*group).orderBy(order)) + F.coalesce("_top", F.lit(0))
    text = seq.cast("string")
    return rows.join(top, group, "left").withColumn("file_name", F.concat(F.col(group[-1]), F.lit("_"), F.lpad(text, F.greatest(F.lit(2), F.length(text)), F.lit("0")), F.lit(".pdf"))).drop("_top")


def early_stop(pages: DataFrame, order: str, new: str, target: int, factor: float = 1.5) -> DataFrame:
    """Pages that are read: the first, and others while fewer than ``factor * target`` new rows were seen before."""
    seen = running_total(pages, [F.col(order)], F.coalesce(F.col(new), F.lit(0)), "_seen")
    return seen.where(F.col("_seen") - F.coalesce(F.col(new), F.lit(0)) < int(factor * target)).drop("_seen")


def union_distinct(existing: DataFrame, session: DataFrame, column: str) -> DataFrame:
    """(existing, session, total): distinct values before, in this session, and of both together."""
    sides = existing.select(column, F.lit(1).alias("e"), F.lit(0).alias("s")).unionAll(session.select(column, F.lit(0), F.lit(1))).where(F.col(column).isNotNull())
    seen = sides.groupBy(column).agg(F.max("e").alias("e"), F.max("s").alias("s"))
    return seen.agg(F.coalesce(F.sum("e"), F.lit(0)).alias("existing"), F.coalesce(F.sum("s"), F.lit(0)).alias("session"), F.count("*").alias("total"))


def upsert(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of every key; rows without a key share one."""
    last = rows.groupBy(key).agg(F.max(order).alias(order))
    return join_same(rows, last, [key, order], "left_semi").select(*rows.columns)


def distribution(rows: DataFrame, column: str) -> DataFrame:
    """Counts and their percentage of all rows."""
    n = rows.groupBy(column).agg(F.count("*").alias("cnt"))
    total = n.agg(F.sum("cnt").alias("_total"))
    return n.join(F.broadcast(total)).select(column, "cnt", F.round(100.0 * F.col("cnt") / F.col("_total"), 4).alias("percent"))


def collection_statistics(pages: DataFrame, file: str, measures: list[str]) -> DataFrame:
    """Per measure: least, largest, mean and exact median over the files of the file's mean per page."""
    per_file = pages.groupBy(file).agg(*(F.avg(m).alias(m) for m in measures))
    out = []
    for m in measures:
        out.append(per_file.agg(F.lit(m).alias("measure"), F.count("*").alias("files"), *(F.round(F.coalesce(f(m), F.lit(0.0)), 6).alias(n) for n, f in (("least", F.min), ("largest", F.max), ("mean", F.avg), ("median", F.median)))))
    result = out[0]
    for o in out[1:]:
        result = result.unionAll(o)
    return result
