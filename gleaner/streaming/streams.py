"""Streaming forms of the incremental loops: deduplicated streams, an upserted store, windowed counts, near duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import hashing as H
from gleaner.operators import corpus
from gleaner.operators.collect import upsert
from gleaner.operators.storage import remove, shared_folder, written


def in_files(rows: DataFrame, order: str, n: int = 3) -> DataFrame:
    """A table as a stream of ``n`` batches by ranges of ``order``, the smallest first."""
    path = shared_folder(rows.sparkSession, "arrivals")
    cuts = rows.approxQuantile(order, [i / n for i in range(1, n)], 0.01)
    part = sum((F.when(F.col(order) > c, 1).otherwise(0) for c in cuts), F.lit(0))
    for i in range(n):
        rows.where(part == i).coalesce(1).write.mode("append").parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet*")


def first_seen(stream: DataFrame, key: list[str], time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Each key once; with a time column its state is dropped once the watermark has passed."""
    if time is None:
        return stream.dropDuplicates(key)
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def windowed_counts(stream: DataFrame, time: str, group: str, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return timed.groupBy(F.window(time, width).alias("w"), group).count().select(F.col("w.start").alias("window_start"), group, F.col("count").alias("cnt"))


def _folder(spark: SparkSession, path: str):
    """A path of the cluster's file systems, and the file system."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    return top, top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def batches(spark: SparkSession, path: str, but: str | None = None) -> list[str]:
    """Folders of a table's whole batches, ``but`` one."""
    top, fs = _folder(spark, path)
    if not fs.exists(top):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(top) if s.isDirectory())
    whole = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))
    return [f"{path}/{n}" for n in names if n != but and not n.startswith(("_", ".")) and whole(n)]


def add_batches(stream: DataFrame, path: str, checkpoint: str, make=None, mode: str = "append"):
    """Runs a stream over all input that is there; every batch adds a folder to the table and touches no other.

    The folder is named by the stream's identity and the batch's number: a batch that comes again after a failure replaces its own
    folder, another stream's batches lie beside.  ``make(rows, name)`` gives what a batch adds, the rows themselves without it.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        meta, fs = _folder(spark, f"{checkpoint}/metadata")
        name = f"{spark.read.text(meta.toString()).first()[0].split('"')[3]}-{number:010d}"
        (rows if make is None else make(rows, name)).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/{name}")

    return stream.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored(spark: SparkSession, path: str, key: str | None = None, order: str | None = None) -> DataFrame | None:
    """All rows of a table of batches; with ``key`` the last row by ``order`` of each.  None before the first batch."""
    known = batches(spark, path)
    if not known:
        return None
    rows = spark.read.parquet(*known)
    return rows.drop("batch") if key is None else upsert(rows.drop("batch").distinct(), key, order)


def drain(stream: DataFrame, name: str, keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over all input that is there and returns its result as a written table.

    With ``keys`` the stream gives updates, and the last one of each key counts.
    """
    path = shared_folder(stream.sparkSession, name)
    add_batches(stream, path, f"{path}-progress", mode="append" if keys is None else "update").awaitTermination()
    known = batches(stream.sparkSession, path)
    rows = stream.sparkSession.read.parquet(*known) if known else stream.sparkSession.createDataFrame([], stream.schema.add("batch", "int"))
    if keys is None:
        return rows.drop("batch")
    values = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_last")).select(*keys, "_last.*")


def upsert_into(stream: DataFrame, path: str, key: str, order: str, checkpoint: str):
    """Keeps the last row of every key: a batch adds its own last rows, ``stored`` with the key takes the last of all."""
    return add_batches(stream, path, checkpoint, lambda rows, _: upsert(rows.distinct(), key, order))


def keep_distinct(stream: DataFrame, path: str, checkpoint: str, text: str, shingles, id: str = "doc_id", threshold: float | None = None, num_perm: int = 128, num_bands: int = 16):
    """Keeps the ids of documents that are similar to none kept before: earlier batches first, then smaller ids.

    Only documents that stay exclude others, so the table of kept ids with their signatures is all that a batch needs from those before:
    what shares a bucket with one of them and is similar goes, the rest is decided inside the batch in order.  Joins do both, so a batch
    reads the signatures kept before it, but no text again.  A batch adds its kept rows to the table and rewrites nothing.  A document
    whose id is kept already is passed over.  Of those of one id in one batch, the one of the least mark of its signature counts.
    Documents without an id aren't kept.
    """
    spark = stream.sparkSession
    least = H.band_threshold(num_perm, num_bands) if threshold is None else threshold

    def decide(rows: DataFrame, name: str) -> DataFrame:
        # from here on the stream's own session plans the joins, with sizes as they are: a batch's session doesn't adapt its plans
        # a batch's file is often one task's, however long its texts are, so its rows are dealt out
        rows = rows.repartition(4 * spark.sparkContext.defaultParallelism)
        _, sigs = written(corpus.signatures(rows, text, shingles, id, num_perm).where("id IS NOT NULL"), "signatures")
        new = spark.read.parquet(sigs).withColumn("mark", F.xxhash64("sig"))
        known = batches(spark, path, but=name)
        if known:
            before = spark.read.parquet(*known).select(F.col("id").alias("other"), F.col("sig").alias("of_other"))
            new = new.join(before.select(F.col("other").alias("id")), "id", "left_anti")
        # a copy of a signature goes with its first document, or because of what that one goes for
        first, _ = corpus.signature_classes(new.groupBy("id").agg(F.min_by("sig", "mark").alias("sig")))
        open_, fresh = written(first, "new")
        used = [sigs, fresh]
        if known:
            held = corpus.bands(before.select(F.col("other").alias("id"), F.col("of_other").alias("sig")), num_perm, num_bands).select("band", "bucket", F.col("id").alias("other"))
            hits = corpus.bands(open_, num_perm, num_bands).select("band", "bucket", "id").join(held, ["band", "bucket"]).select("id", "other").distinct()
            near = hits.join(open_, "id").join(before, "other").where(H.similarity(F.col("sig"), F.col("of_other"), num_perm) >= least)
            open_, left = written(open_.join(near.select("id").distinct(), "id", "left_anti"), "open")
            remove(spark, *used)
            used = [left]
        gone = corpus.excluded(corpus.class_pairs(open_, least, num_perm, num_bands).select("a", "b"))
        kept, _ = written(open_.join(gone, "id", "left_anti").select("id", F.xxhash64("sig").alias("mark"), "sig"), "kept")
        remove(spark, *used)
        return kept

    return add_batches(stream.select(id, text), path, checkpoint, decide)
