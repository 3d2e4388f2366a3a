"""Table detectors as data sources: scans of files whose partitions, page filters and failures Spark sees.

A detector is a subclass of ``TableSource`` with a name and a ``parse`` method; ``register`` makes it a format of the session.
``LayoutSource`` reads layouts as JSON, one document a file, as a converter writes them beside its PDF files:
``{"pages": [{"number": 1, "width": 595, "height": 842, "tables": [{"box": [x0, y0, x1, y1], "rows": 3, "columns": 2, "text": "..."}]}]}``.

Files are packed into partitions by size.  Comparisons of ``page`` and ``file`` with constants are pushed: of ``file`` they decide which
files are opened, of ``page`` which tables a file gives.  The option ``pages`` (``1,3``) asks for pages as well, but keeps what the
filters drop: a row with the error of every file that can't be read or hasn't the page.

Tables without a box or with a box without area are left out; corners come in order; a table without text has null; ``ord`` is the place
among the tables of its page that the file has.
"""

from __future__ import annotations

import json
from abc import abstractmethod
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as S

from gleaner.sources.paths import listed, packed, resolve

SCHEMA = "file STRING, page INT, ord INT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, width DOUBLE, height DOUBLE, row_count INT, col_count INT, text_content STRING, error STRING"
ARROW = pa.schema([("file", pa.string()), ("page", pa.int32()), ("ord", pa.int32()), *((c, pa.float64()) for c in ("x0", "y0", "x1", "y1", "width", "height")), ("row_count", pa.int32()), ("col_count", pa.int32()), ("text_content", pa.string()), ("error", pa.string())])
#: Rows that a batch has, or somewhat more: files come whole.
BATCH = 10_000
#: Bytes of files that a task reads, unless the option ``partitionBytes`` says otherwise.
PARTITION_BYTES = 32 << 20
_COMPARE = {S.EqualTo: lambda v, x: v == x, S.GreaterThan: lambda v, x: v > x, S.GreaterThanOrEqual: lambda v, x: v >= x, S.LessThan: lambda v, x: v < x, S.LessThanOrEqual: lambda v, x: v <= x, S.In: lambda v, x: v in x, S.IsNotNull: lambda v, x: True, S.StringContains: lambda v, x: x in v, S.StringEndsWith: lambda v, x: v.endswith(x), S.StringStartsWith: lambda v, x: v.startswith(x)}


@dataclass
class Files(S.InputPartition):
    files: list[tuple[str, int]]


@dataclass
class Table:
    """What a detector finds: a table (or, without a box, nothing but the page's size)."""

    page: int
    box: tuple[float, float, float, float] | None = None
    width: float | None = None
    height: float | None = None
    rows: int | None = None
    columns: int | None = None
    text: str | None = None


class TableSource(S.DataSource):
    #: Ending of the files that the detector reads.
    suffix = ""

    @classmethod
    @abstractmethod
    def name(cls) -> str:
        """The format's name, which is the detector's."""

    @staticmethod
    @abstractmethod
    def parse(content: bytes) -> Iterable[Table]:
        """Tables of one file, page by page; every page comes at least once."""

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> S.DataSourceReader:
        options = self.options
        pages = [int(p) for p in options["pages"].split(",")] if options.get("pages") else None
        if pages and min(pages) < 1:
            raise ValueError("pages are counted from 1")
        return TableReader(options["path"], options.get("suffix", self.suffix), int(options.get("partitionBytes", PARTITION_BYTES)), pages, type(self).parse)


class TableReader(S.DataSourceReader):
    def __init__(self, path: str, suffix: str, most: int, pages: list[int] | None, parse):
        self.path, self.suffix, self.most, self.pages, self.parse = path, suffix, most, pages, parse
        self.kept: dict[str, list[tuple[type, object]]] = {"file": [], "page": []}

    def pushFilters(self, filters: list[S.Filter]) -> Iterator[S.Filter]:
        for f in filters:
            column = f.attribute[0] if type(f) in _COMPARE and len(f.attribute) == 1 else None
            if column in self.kept:
                self.kept[column].append((type(f), getattr(f, "value", None)))
            else:
                yield f

    def _fits(self, column: str, value) -> bool:
        return all(value is not None and _COMPARE[kind](value, x) for kind, x in self.kept[column])

    def partitions(self) -> list[Files]:
        return [Files(group) for group in packed([f for f in listed(self.path, self.suffix) if self._fits("file", f.path)], self.most)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = resolve(self.path)
        held: list[tuple] = []
        for path, _ in partition.files:
            try:
                with system.open_input_stream(path) as content:
                    rows = list(self._rows(path, self.parse(content.read())))
            except Exception as e:
                # a file that can't be read doesn't stop the others; its row has no page
                rows = [self._failed(path, f"{type(e).__name__}: {e}")] if self._fits("page", None) else []
            held += rows
            if len(held) > BATCH:
                yield self._batch(held)
                held = []
        if held:
            yield self._batch(held)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)

    def _failed(self, path: str, error: str) -> tuple:
        return (path, *[None] * 11, error)

    def _rows(self, path: str, tables: Iterable[Table]) -> Iterator[tuple]:
        place: dict[int, int] = {}
        for t in tables:
            n = place.setdefault(t.page, 0)
            if t.box is None:
                continue
            (x0, x1), (y0, y1) = sorted(map(float, t.box[0::2])), sorted(map(float, t.box[1::2]))
            if x0 == x1 or y0 == y1:
                continue
            place[t.page] = n + 1
            if (self.pages is None or t.page in self.pages) and self._fits("page", t.page):
                yield (path, t.page, n, x0, y0, x1, y1, t.width, t.height, t.rows, t.columns, t.text, None)
        for missing in sorted(set(self.pages or ()) - set(place)):
            if self._fits("page", None):
                yield self._failed(path, f"ValueError: page {missing} of {len(place)}")


class LayoutSource(TableSource):
    suffix = ".json"

    @classmethod
    def name(cls) -> str:
        return "layout"

    @staticmethod
    def parse(content: bytes) -> Iterator[Table]:
        for page in json.loads(content)["pages"]:
            size = {k: None if page.get(k) is None else float(page[k]) for k in ("width", "height")}
            yield Table(page["number"], **size)
            for t in page.get("tables", ()):
                yield Table(page["number"], t.get("box"), **size, rows=t.get("rows"), columns=t.get("columns"), text=t.get("text"))


def register(spark: SparkSession, *sources: type[TableSource]) -> None:
    """Makes detectors formats of the session, and lets Spark push filters to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in sources:
        spark.dataSource.register(source)


def scan(spark: SparkSession, path: str, source: type[TableSource] = LayoutSource, pages: list[int] | None = None, **options) -> DataFrame:
    """Tables that a detector finds below a path, as candidates with the detector's name."""
    from pyspark.sql import functions as F

    register(spark, source)
    read = spark.read.format(source.name()).options(**options)
    read = read if pages is None else read.option("pages", ",".join(map(str, pages)))
    return read.load(path).withColumn("detector", F.lit(source.name()))
