"""Detectors and stores as data sources: partitions, pushed filters, failures as rows, writes that are whole or absent."""

import json
import os

import pytest
from pyspark.sql import functions as F

from gleaner.sources import layouts, paths, versions


# --- detectors --------------------------------------------------------------------------------------------------------

def layout(pages):
    return json.dumps({"pages": pages}, ensure_ascii=False)


@pytest.fixture()
def folder(tmp_path):
    table = {"box": [10, 20, 110, 70], "rows": 3, "columns": 2, "text": "매출액 1"}
    files = {
        "a.json": layout([{"number": 1, "width": 595, "height": 842, "tables": [table, {"box": [5, 5, 5, 9]}, {"rows": 1}, {"box": [90, 80, 20, 10]}]}, {"number": 2, "tables": []}]),
        "sub/b.json": layout([{"number": 1}, {"number": 2, "width": 100, "height": 50.5, "tables": [table]}, {"number": 3, "tables": [table, table]}]),
        "broken.json": "{\"pages\": [",
        "empty.json": layout([]),
        "no_number.json": layout([{"tables": [table]}]),
        "_hidden.json": "x",
        "other.txt": "x",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text, encoding="utf-8")
    return tmp_path


def short(rows, top):
    return sorted((os.path.relpath(r["file"], top), r["page"], r["ord"], r["x0"], r["y1"], r["error"] and r["error"].split(":")[0]) for r in rows)


WHOLE = [("a.json", 1, 0, 10.0, 70.0, None), ("a.json", 1, 1, 20.0, 80.0, None), ("sub/b.json", 2, 0, 10.0, 70.0, None), ("sub/b.json", 3, 0, 10.0, 70.0, None), ("sub/b.json", 3, 1, 10.0, 70.0, None)]
FAILED = [("broken.json", None, None, None, None, "JSONDecodeError"), ("no_number.json", None, None, None, None, "KeyError")]


def test_tables_of_all_files_and_failures_as_rows(spark, folder):
    got = layouts.scan(spark, str(folder))
    rows = got.collect()
    assert short(rows, folder) == sorted([*WHOLE, *FAILED], key=lambda r: (r[0], r[1] or 0, r[2] or 0))
    first = next(r for r in rows if r["file"].endswith("a.json") and r["ord"] == 0)
    assert (first["width"], first["height"], first["row_count"], first["col_count"], first["text_content"], first["detector"]) == (595.0, 842.0, 3, 2, "매출액 1", "layout")
    by_uri = layouts.scan(spark, f"file:{folder}")
    assert short(by_uri.collect(), folder) == short(rows, folder)


def test_filters_reach_the_scan(spark, folder):
    scan = layouts.scan(spark, str(folder))
    for condition, keep in [("page = 3", lambda p: p == 3), ("page IN (1, 3)", lambda p: p in (1, 3)), ("page > 1 AND page <= 2", lambda p: p == 2), ("page >= 2 AND x0 < 15", lambda p: p >= 2)]:
        got = scan.where(condition)
        assert short(got.collect(), folder) == [r for r in WHOLE if keep(r[1]) and ("x0" not in condition or r[3] < 15)]
        above = got._jdf.queryExecution().executedPlan().toString()
        left = [line for line in above.splitlines() if " Filter (" in line]
        # nothing of the page is left to be filtered above the scan
        assert not any("page" in line for line in left), above
    one = scan.where(F.col("file").endswith("b.json") & (F.col("page") == 2))
    assert short(one.collect(), folder) == [WHOLE[2]]
    assert scan.where("error IS NOT NULL").count() == 2


def test_files_that_a_filter_excludes_are_not_opened(spark, folder):
    reader = layouts.LayoutSource({"path": str(folder)}).reader(None)
    assert len(reader.partitions()) == 1 and len(reader.partitions()[0].files) == 5
    kept = list(reader.pushFilters([layouts.S.StringEndsWith(("file",), "b.json"), layouts.S.EqualTo(("x0",), 1.0), layouts.S.Not(layouts.S.EqualTo(("page",), 1))]))
    assert [type(f).__name__ for f in kept] == ["EqualTo", "Not"]
    assert [os.path.basename(p) for part in reader.partitions() for p, _ in part.files] == ["b.json"]
    small = layouts.LayoutSource({"path": str(folder), "partitionBytes": "1"}).reader(None)
    assert [len(p.files) for p in small.partitions()] == [1] * 5


def test_pages_that_are_asked_for(spark, folder):
    """Unlike a filter, the option keeps failures, and pages that a file hasn't got are one."""
    got = layouts.scan(spark, str(folder / "sub"), pages=[3, 9])
    assert short(got.where("error IS NULL").collect(), folder / "sub") == [("b.json", 3, 0, 10.0, 70.0, None), ("b.json", 3, 1, 10.0, 70.0, None)]
    errors = [r["error"] for r in got.collect() if r["error"]]
    assert errors == ["ValueError: page 9 of 3"]
    with pytest.raises(Exception, match="counted from 1"):
        layouts.scan(spark, str(folder), pages=[0]).collect()
    with pytest.raises(Exception, match="FileNotFound"):
        layouts.scan(spark, str(folder / "absent")).collect()


def test_a_detector_of_ones_own(spark, tmp_path):
    class LineSource(layouts.TableSource):
        """A detector of one's own: a line ``page x0 y0 x1 y1`` is a table."""

        suffix = ".txt"

        @classmethod
        def name(cls):
            return "lines_of_boxes"

        @staticmethod
        def parse(content):
            from gleaner.sources.layouts import Table

            for line in content.decode().splitlines():
                page, *box = line.split()
                yield Table(int(page), tuple(map(float, box)))

    (tmp_path / "x.txt").write_text("1 0 0 5 5\n2 1 1 4 4\n")
    (tmp_path / "y.txt").write_text("one 0 0\n")
    rows = layouts.scan(spark, str(tmp_path), LineSource).collect()
    assert sorted((os.path.basename(r["file"]), r["page"], r["x1"], r["error"] is None, r["detector"]) for r in rows) == sorted([("x.txt", 1, 5.0, True, "lines_of_boxes"), ("x.txt", 2, 4.0, True, "lines_of_boxes"), ("y.txt", None, None, False, "lines_of_boxes")])


# --- the store --------------------------------------------------------------------------------------------------------

SCHEMA = "id long, name string, tags array<string>, at struct<x: double>"


def rows_of(df):
    return sorted((r["id"], r["name"], r["tags"], r["at"] and r["at"]["x"]) for r in df.collect())


FIRST = [(1, "é 한", ["a", "b"], 0.5), (2, None, [], None), (3, "c\n\"d\"", None, 2.0)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, n, t, None if x is None else (x,)) for i, n, t, x in rows], SCHEMA).repartition(parts)


def read(spark, path, **options):
    return spark.read.format("versions").schema(SCHEMA).options(**options).load(path)


def test_versions_append_and_overwrite(spark, tmp_path):
    versions.register(spark)
    path = str(tmp_path / "store")
    assert read(spark, path).count() == 0 and versions.versions(path) == []
    frame(spark, FIRST).write.format("versions").mode("append").save(path)
    assert rows_of(read(spark, path)) == FIRST
    frame(spark, [(4, "d", [], None)]).write.format("versions").mode("append").save(path)
    assert rows_of(read(spark, path)) == [*FIRST, (4, "d", [], None)]
    # the version before can still be read
    assert versions.versions(path) == [0, 1] and rows_of(read(spark, path, version=0)) == FIRST
    frame(spark, [(9, "z", [], None)]).write.format("versions").mode("overwrite").option("keep", 1).save(path)
    assert rows_of(read(spark, path)) == [(9, "z", [], None)] and versions.versions(path) == [2]
    assert len(os.listdir(tmp_path / "store" / "data")) == 1
    with pytest.raises(Exception, match="isn't one of"):
        read(spark, path, version=0).collect()
    frame(spark, []).write.format("versions").mode("overwrite").save(path)
    assert read(spark, path).count() == 0


def test_a_failed_write_leaves_the_version_before(spark, tmp_path):
    versions.register(spark)
    path = str(tmp_path / "store")
    frame(spark, FIRST).write.format("versions").mode("append").save(path)
    files = set(os.listdir(tmp_path / "store" / "data"))
    bad = frame(spark, [(i, "n", [], None) for i in range(50)], 4).withColumn("name", F.when(F.col("id") == 33, F.raise_error(F.lit("no such row")).cast("string")).otherwise(F.col("name")))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception):
            bad.write.format("versions").mode(mode).save(path)
        assert rows_of(read(spark, path)) == FIRST and versions.versions(path) == [0]
    frame(spark, FIRST).write.format("versions").mode("append").save(path)
    # what failed attempts left went with the next write
    left = set(os.listdir(tmp_path / "store" / "data"))
    assert files <= left and len(left) <= len(files) + 3 and rows_of(read(spark, path)) == sorted(FIRST * 2, key=lambda r: r[0])


def test_a_version_without_its_list_is_not_seen(spark, tmp_path):
    """Files of tasks whose driver was lost before the commit."""
    versions.register(spark)
    path = str(tmp_path / "store")
    frame(spark, FIRST).write.format("versions").mode("append").save(path)
    writer = versions.VersionWriter({"path": path}, frame(spark, FIRST).schema, False)
    message = writer.write(iter(frame(spark, FIRST).toArrow().to_batches()))
    assert message.rows == 3 and rows_of(read(spark, path)) == FIRST
    writer.abort([message, None])
    assert not os.path.exists(tmp_path / "store" / "data" / message.file)


def test_annotation_tasks_as_arrays(spark, tmp_path):
    from gleaner.sources import labelstudio

    versions.register(spark)
    path = str(tmp_path / "tasks")
    pages = spark.createDataFrame([("p/1.png",), ("p/2.png",)], "image string")
    tables = spark.createDataFrame([("p/1.png", 0, "표", 1.0, 2.0, 3.0, 4.0)], "image string, ord int, label string, x double, y double, width double, height double")
    labelstudio.export_tasks(pages, tables, "set").write.format("versions").mode("append").option("raw", "task").option("layout", "array").save(path)
    parts = [json.loads((tmp_path / "tasks" / "data" / f).read_text("utf-8")) for f in os.listdir(tmp_path / "tasks" / "data")]
    tasks = sorted((t for p in parts for t in p), key=lambda t: t["data"]["image"])
    assert [t["data"]["image"] for t in tasks] == ["/data/local-files/?d=set/1.png", "/data/local-files/?d=set/2.png"]
    assert "predictions" not in tasks[1] and tasks[0]["predictions"][0]["result"][0]["value"]["rectanglelabels"] == ["표"]
    files = spark.read.text(str(tmp_path / "tasks" / "data"), wholetext=True)
    assert labelstudio.detections(labelstudio.read_tasks(files), "predictions").where("det_idx IS NOT NULL").count() == 1
    back = spark.read.format("versions").schema("data struct<image: string>").load(path)
    assert back.count() == 2
    with pytest.raises(Exception, match="no column is named"):
        pages.write.format("versions").mode("append").option("raw", "absent").save(path)


def test_paths_and_packing():
    info = [paths.fs.FileInfo(f"f{i}", paths.fs.FileType.File, size=s) for i, s in enumerate([5, 5, 20, 1, 9, 1])]
    assert [[p for p, _ in g] for g in paths.packed(info, 10)] == [["f0", "f1"], ["f2"], ["f3", "f4"], ["f5"]]
    assert paths.resolve("file:/a/b")[1] == paths.resolve("/a/b")[1] == "/a/b"
