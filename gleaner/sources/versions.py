"""A versioned store as a data source: writes that appear as a whole or not at all, and reads of any version that is kept.

``register(spark)``, then ``rows.write.format("versions").mode("append" or "overwrite").save(path)`` and
``spark.read.format("versions").schema(...).load(path)``.

A task writes one file below ``data`` under a name of its own and reports it in its commit message.  Once all tasks have ended, the driver
writes the list of the version's files (those of the version before and the new ones for ``append``) beside its place and renames it into
it, which is the moment at which readers see the version.  If a task fails, the files of the others are removed, and the version before
stays.  Files of repeated attempts are in no list and go with the next write.  One writer at a time, as the save loops of a collector are.

Options of a write: ``layout`` is ``lines`` (JSON lines, the default) or ``array`` (a JSON array in each file, as annotation tools
import it); ``raw`` names a string column whose values are the JSON documents themselves; ``keep`` is how many versions stay (2).
Of a read: ``version``, a number; the newest without it.  A store without a version is empty.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as S
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gleaner.sources.paths import packed, resolve

PARTITION_BYTES = 32 << 20


@dataclass
class Written(S.WriterCommitMessage):
    file: str | None
    rows: int
    size: int


@dataclass
class Part(S.InputPartition):
    files: list[tuple[str, int]]


def _manifest(number: int) -> str:
    return f"v{number:010d}.json"


def versions(path: str) -> list[int]:
    """Numbers of the versions that can be read, in order."""
    system, at = resolve(path)
    if system.get_file_info(at).type == fs.FileType.NotFound:
        return []
    names = [f.base_name for f in system.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File]
    return sorted(int(n[1:-5]) for n in names if n[:1] == "v" and n.endswith(".json") and n[1:-5].isdigit())


def _files(path: str, number: int) -> list[dict]:
    system, at = resolve(path)
    with system.open_input_stream(f"{at}/{_manifest(number)}") as f:
        return json.loads(f.read())["files"]


class VersionSource(S.DataSource):
    @classmethod
    def name(cls) -> str:
        return "versions"

    def reader(self, schema: StructType) -> S.DataSourceReader:
        return VersionReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> S.DataSourceWriter:
        return VersionWriter(self.options, schema, overwrite)


class VersionReader(S.DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.schema = options["path"], schema
        self.number = int(options["version"]) if options.get("version") else None
        self.most = int(options.get("partitionBytes", PARTITION_BYTES))

    def partitions(self) -> list[Part]:
        known = versions(self.path)
        if self.number is not None and self.number not in known:
            raise ValueError(f"version {self.number} isn't one of {known}")
        if not known:
            return [Part([])]
        files = [fs.FileInfo(f["file"], fs.FileType.File, size=f["size"]) for f in _files(self.path, known[-1] if self.number is None else self.number)]
        return [Part(group) for group in packed(files, self.most)] or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        import pyarrow.json as pj

        system, at = resolve(self.path)
        target = to_arrow_schema(self.schema)
        for name, _ in partition.files:
            with system.open_input_stream(f"{at}/data/{name}") as f:
                content = f.read()
            if name.endswith(".array.json"):
                content = "\n".join(json.dumps(row, ensure_ascii=False) for row in json.loads(content)).encode()
            if content.strip():
                table = pj.read_json(pa.BufferReader(content), parse_options=pj.ParseOptions(explicit_schema=target, unexpected_field_behavior="ignore"))
                yield from table.select(target.names).cast(target).to_batches(max_chunksize=10_000)


class VersionWriter(S.DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.overwrite, self.raw = options["path"], overwrite, options.get("raw")
        self.layout, self.keep = options.get("layout", "lines"), int(options.get("keep", 2))
        if self.layout not in ("lines", "array"):
            raise ValueError("a layout is lines or array")
        if self.raw and self.raw not in schema.fieldNames():
            raise ValueError(f"no column is named {self.raw}")
        if self.keep < 1:
            raise ValueError("the newest version has to stay")

    def _documents(self, batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
        for batch in batches:
            if self.raw:
                yield from (" ".join(x.splitlines()) for x in batch.column(self.raw).to_pylist() if x is not None)
            else:
                # null fields are left out
                yield from (json.dumps({k: v for k, v in row.items() if v is not None}, ensure_ascii=False, default=str) for row in batch.to_pylist())

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, at = resolve(self.path)
        system.create_dir(f"{at}/data", recursive=True)
        name = f"{uuid.uuid4()}.{self.layout}.json"
        n = 0
        with system.open_output_stream(f"{at}/data/{name}") as out:
            for document in self._documents(iterator):
                lead = "" if self.layout == "lines" else ",\n" if n else "[\n"
                out.write(f"{lead}{document}{'\n' if self.layout == 'lines' else ''}".encode())
                n += 1
            if self.layout == "array":
                out.write(b"\n]\n" if n else b"[]\n")
        return Written(name, n, system.get_file_info(f"{at}/data/{name}").size)

    def commit(self, messages: list[Written | None]) -> None:
        system, at = resolve(self.path)
        system.create_dir(f"{at}/data", recursive=True)
        known = versions(self.path)
        before = [] if self.overwrite or not known else _files(self.path, known[-1])
        files = [*before, *({"file": m.file, "rows": m.rows, "size": m.size} for m in messages if m is not None and m.rows)]
        number = known[-1] + 1 if known else 0
        beside = f"{at}/_{uuid.uuid4()}"
        with system.open_output_stream(beside) as out:
            out.write(json.dumps({"version": number, "files": files}, ensure_ascii=False, indent=2).encode())
        system.move(beside, f"{at}/{_manifest(number)}")
        self._clean(system, at, [*known, number])

    def _clean(self, system: fs.FileSystem, at: str, known: list[int]) -> None:
        """Removes versions beyond those to keep, and files that are in no list."""
        for n in known[: -self.keep]:
            system.delete_file(f"{at}/{_manifest(n)}")
        held = {f["file"] for n in known[-self.keep :] for f in _files(self.path, n)}
        for f in system.get_file_info(fs.FileSelector(f"{at}/data")):
            if f.base_name not in held:
                system.delete_file(f.path)

    def abort(self, messages: list[Written | None]) -> None:
        system, at = resolve(self.path)
        for m in messages:
            if m is not None and system.get_file_info(f"{at}/data/{m.file}").type == fs.FileType.File:
                system.delete_file(f"{at}/data/{m.file}")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VersionSource)
