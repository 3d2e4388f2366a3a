"""Annotation JSON: tasks with predictions and annotations become detections, and tables become tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_VALUE = "STRUCT<x: DOUBLE, y: DOUBLE, width: DOUBLE, height: DOUBLE, rectanglelabels: ARRAY<STRING>>"
TASKS = f"ARRAY<STRUCT<data: STRUCT<image: STRING>, predictions: ARRAY<STRUCT<result: ARRAY<STRUCT<type: STRING, value: {_VALUE}>>>>, annotations: ARRAY<STRUCT<result: ARRAY<STRUCT<type: STRING, value: {_VALUE}>>>>>>"

def read_tasks(files: DataFrame, json: str = "value") -> DataFrame:
    """(image_id, task_ord, predictions, annotations); of tasks with the same image the last one counts, tasks without one don't."""
    tasks = files.select(F.posexplode(F.from_json(json, TASKS)).alias("task_ord", "t")).select(F.col("t.data.image").alias("image_id"), "task_ord", "t.predictions", "t.annotations").where("image_id IS NOT NULL AND image_id <> ''")
    return tasks.withColumn("_r", F.row_number().over(W.partitionBy("image_id").orderBy(F.desc("task_ord")))).where("_r = 1").drop("_r")


def detections(tasks: DataFrame, source: str, strict: bool = False) -> DataFrame:
    """(image_id, det_idx, source, label, x, y, width, height) of ``source`` predictions or annotations.

    Other result types and incomplete boxes are skipped; a box without label is ``unknown``; an image without boxes keeps one
    row with null det_idx.  Negative sizes raise an error if ``strict``, else they are skipped.
    """
    rows = tasks.select("image_id", F.explode_outer(source).alias("g")).select("image_id", F.posexplode_outer("g.result").alias("n", "r"))
    v = F.col("r.value")
    whole = (F.col("r.type") == "rectanglelabels") & v["x"].isNotNull() & v["y"].isNotNull() & v["width"].isNotNull() & v["height"].isNotNull()
    negative = (v["width"] < 0) | (v["height"] < 0)
    ok = whole & (F.when(negative, F.raise_error(F.lit("a box has a negative size")).cast("boolean")).otherwise(F.lit(True)) if strict else ~negative)
    boxes = rows.where(ok).select("image_id", F.coalesce(F.get(v["rectanglelabels"], F.lit(0)), F.lit("unknown")).alias("label"), *(v[c].alias(c) for c in ("x", "y", "width", "height")), "n")
    numbered = boxes.withColumn("det_idx", F.row_number().over(W.partitionBy("image_id").orderBy("n", "x", "y")) - 1).drop("n")
    return tasks.select("image_id").join(numbered, "image_id", "left").withColumn("source", F.lit("prediction" if source == "predictions" else "ground_truth"))


def export_tasks(pages: DataFrame, tables: DataFrame, dataset: str, version: str = "detector") -> DataFrame:
    """One JSON task per page (image, page); pages without tables have no predictions key.  Boxes are in percent."""
    name = F.element_at(F.split("image", "/"), -1)
    path = F.concat(F.lit(f"/data/local-files/?d={dataset}/"), name)
    value = F.struct("x", "y", "width", "height", F.lit(0).alias("rotation"), F.array("label").alias("rectanglelabels"))
    item = F.struct("ord", F.struct(F.concat_ws("_", "image", "ord").alias("id"), F.lit("rectanglelabels").alias("type"), F.lit("label").alias("from_name"), F.lit("image").alias("to_name"), value.alias("value")).alias("r"))
    results = tables.groupBy("image").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["r"]).alias("result"))
    predictions = F.when(F.col("result").isNotNull(), F.array(F.struct(F.lit(version).alias("model_version"), "result")))
    return pages.join(results, "image", "left").select("image", F.to_json(F.struct(F.struct(path.alias("image")).alias("data"), predictions.alias("predictions"))).alias("task"))


def unknown_labels(found: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(label, cnt) of labels outside the annotation interface's vocabulary."""
    return found.where(F.col("label").isNotNull() & ~F.col("label").isin(vocabulary)).groupBy("label").agg(F.count("*").alias("cnt"))
