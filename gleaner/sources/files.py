"""File discovery, the metadata store, and the places where external parsers plug in.

Parsing and rendering of PDF files and fetching over HTTP need libraries and networks that aren't part of the engine.  A
detector is a function from discovered files to candidate rows; results of several are put together with failures kept as rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.storage import remove, written

REPORTS = "pdf_url STRING, broker STRING, stock_name STRING, title STRING, date STRING, local_path STRING, file_hash STRING, downloaded_at STRING"
CANDIDATES = "file STRING, page INT, ord INT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, detector STRING, row_count INT, col_count INT, text_content STRING, error STRING"
#: A store is saved after so many new reports (fixed value).
CHECKPOINT_EVERY = 10
Detector = Callable[[DataFrame], DataFrame]


def discover(spark: SparkSession, paths: str | Sequence[str], limit: int | None = None) -> DataFrame:
    """(path, modificationTime, length, content, ord) of the PDF files below some paths or globs, each file once.

    ``ord`` is the place of the first path that finds the file; files come in order of that and of their names, ``limit`` of them at
    most.  Contents are read only where a column asks for them.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]")
    found = None
    for at, path in enumerate([paths] if isinstance(paths, str) else paths):
        some = read.load(path).withColumn("ord", F.lit(at))
        found = some if found is None else found.unionByName(some)
    first = found.groupBy("path").agg(F.min("ord").alias("ord"))
    out = found.join(first, ["path", "ord"], "left_semi").orderBy("ord", "path")
    return out if limit is None else out.limit(limit)


def detect(files: DataFrame, detectors: dict[str, Detector]) -> DataFrame:
    """Candidates of all detectors; boxes without area are dropped, corners put in order, a failing detector gives an error row.

    Every detector runs once, its candidates are written below the shared checkpoint folder: one that fails while it runs, not only one
    that can't be planned, doesn't stop the others.
    """
    spark = files.sparkSession
    out = spark.createDataFrame([], CANDIDATES)
    for name, run in detectors.items():
        try:
            some, _ = written(run(files).withColumn("detector", F.lit(name)), "candidates")
        except Exception as e:
            some = spark.createDataFrame([(name, str(e).split("\n")[0])], "detector string, error string")
        out = out.unionByName(some, allowMissingColumns=True)
    lo, hi = F.least, F.greatest
    boxed = out.withColumns({"x0": lo("x0", "x1"), "x1": hi("x0", "x1"), "y0": lo("y0", "y1"), "y1": hi("y0", "y1")})
    return boxed.where("error IS NOT NULL OR (x1 > x0 AND y1 > y0)")


def successful(results: DataFrame) -> DataFrame:
    """Rows without an error."""
    return results.where("error IS NULL OR error = ''").drop("error")


# --- metadata store ---------------------------------------------------------------------------------------------------

def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole versions of a store, in order."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(top)]
    whole = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and whole(n))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of the metadata store; one that is missing or can't be read is empty."""
    known = _versions(spark, path)
    if not known:
        return spark.createDataFrame([], REPORTS)
    return spark.read.schema(REPORTS + ", _corrupt STRING").option("columnNameOfCorruptRecord", "_corrupt").json(f"{path}/v{known[-1]}").where("_corrupt IS NULL").drop("_corrupt").where("pdf_url IS NOT NULL")


def write_reports(reports: DataFrame, path: str, keep: int = 2) -> None:
    """Writes a new version of the store beside the one that may be being read; the last ``keep`` versions stay."""
    spark = reports.sparkSession
    known = _versions(spark, path)
    reports.write.json(f"{path}/v{known[-1] + 1 if known else 0}")
    remove(spark, *(f"{path}/v{n}" for n in known[: len(known) + 1 - keep]))


def checkpoints(reports: DataFrame, order: str, every: int = CHECKPOINT_EVERY) -> DataFrame:
    """Adds ``batch``: the number of the save that first has the report, one after each ``every`` new ones."""
    from gleaner.operators.collect import running_count

    return running_count(reports, [F.col(order)]).withColumn("batch", F.floor((F.col("ordinal") - 1) / every)).drop("ordinal")


def lookup(probes: DataFrame, item: str, reports: DataFrame, key: str) -> DataFrame:
    """Adds ``known`` and ``report`` (the first report by URL with that value of ``key``, null without one)."""
    held = reports.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*reports.columns), "pdf_url").alias("report"))
    return probes.join(held, probes[item] == held["_key"], "left").withColumn("known", F.col("_key").isNotNull()).drop("_key")
