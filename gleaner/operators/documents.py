"""Analysed documents: pages put together from their tables, text blocks and images; summaries and results of detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.layout import inside_table

#: Points of a page whose size isn't known (fixed values).
WIDTH, HEIGHT = 612.0, 792.0


def ordered_box(prefix: str = "") -> dict[str, Column]:
    """Corner columns in order, whichever corners a source gives."""
    x0, y0, x1, y1 = (F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1"))
    return {"x0": F.least(x0, x1), "y0": F.least(y0, y1), "x1": F.greatest(x0, x1), "y1": F.greatest(y0, y1)}


def on_pages(rows: DataFrame, numbers: Sequence[int], pages: DataFrame, file: str = "file", page: str = "page") -> DataFrame:
    """The rows on pages with these numbers; a number that no file has raises an error."""
    wanted = sorted(set(numbers))
    there = {r[0] for r in pages.select(page).where(F.col(page).isin(wanted)).distinct().collect()}
    if missing := [n for n in wanted if n not in there]:
        raise ValueError(f"no page has the number {missing[0]}")
    return rows.where(F.col(page).isin(wanted))


def assemble_pages(pages: DataFrame, tables: DataFrame, blocks: DataFrame, images: DataFrame) -> DataFrame:
    """(file, page, width, height, text_blocks, images) of every page.

    ``pages`` has file, page, width, height; the others file, page, ord and corners in any order, blocks also id, text and label.  Blocks
    tell whether most of them lies in one of the page's tables; items without a page of the file are dropped; pages without a size
    get the default one.  The arrays hold one page's items, in order.
    """
    key = ["file", "page"]
    placed = inside_table(blocks.withColumns(ordered_box()), tables.withColumns(ordered_box()), key, "id")
    listed = lambda rows, *fields: rows.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(*fields).alias("item")))), lambda x: x["item"]).alias("items"))
    corners = ["x0", "y0", "x1", "y1"]
    texts = listed(placed, "text", F.coalesce("label", F.lit("text")).alias("label"), *corners, "in_table").withColumnRenamed("items", "text_blocks")
    pictures = listed(images.withColumns(ordered_box()), *corners).withColumnRenamed("items", "images")
    out = pages.join(texts, key, "left").join(pictures, key, "left")
    none = lambda c: F.coalesce(F.col(c), F.array().cast(out.schema[c].dataType)).alias(c)
    return out.select(*key, F.coalesce("width", F.lit(WIDTH)).alias("width"), F.coalesce("height", F.lit(HEIGHT)).alias("height"), none("text_blocks"), none("images"))


def document_info(pages: DataFrame) -> DataFrame:
    """(file, page_count, page_summaries) of assembled pages: number, size and counts of each page, in order."""
    summary = F.struct(F.col("page").alias("page_number"), "width", "height", F.size("text_blocks").alias("text_block_count"), F.size("images").alias("image_count"))
    return pages.groupBy("file").agg(F.count("*").alias("page_count"), F.array_sort(F.collect_list(summary)).alias("page_summaries"))


def analyze_page(pages: DataFrame, file: str, number: int) -> DataFrame:
    """One assembled page; a number that the file doesn't have raises an error."""
    own = pages.where(F.col("file") == file)
    found = own.where(F.col("page") == number)
    if found.isEmpty():
        raise ValueError(f"page {number} is out of range, the document has {own.count()} pages")
    return found


def file_statistics(info: DataFrame, tables: DataFrame) -> DataFrame:
    """(file, page_count, text_blocks, images, tables) of every file."""
    n = tables.groupBy("file").agg(F.count("*").alias("tables"))
    total = lambda f: F.aggregate("page_summaries", F.lit(0).cast("long"), lambda s, x: s + x[f])
    out = info.join(n, "file", "left")
    return out.select("file", "page_count", total("text_block_count").alias("text_blocks"), total("image_count").alias("images"), F.coalesce("tables", F.lit(0)).alias("tables"))


def categories_per_file(tables: DataFrame, file: str = "file", category: str = "category", order: str = "ord") -> DataFrame:
    """(file, tables_detected, categories): a map from category to its number of tables, in order of first occurrence."""
    n = tables.groupBy(file, category).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    entries = F.transform(F.array_sort(F.collect_list(F.struct("first", F.col(category).alias("c"), "n"))), lambda x: F.struct(x["c"], x["n"]))
    return n.groupBy(file).agg(F.sum("n").alias("tables_detected"), F.map_from_entries(entries).alias("categories"))


def category_text(categories: Column) -> Column:
    """``name:number`` of each entry; a dash without entries."""
    text = F.array_join(F.transform(F.map_entries(categories), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ", ")
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("-")).otherwise(text)


def detection_summary(files: DataFrame, tables: DataFrame) -> DataFrame:
    """(kind, file, pages, tables, categories): a row for each file, one that tells the error of a failed one, and the total of the others.

    ``files`` has file, pages, error; ``tables`` file, category, ord.
    """
    out = files.join(categories_per_file(tables), "file", "left")
    failed = F.col("error").isNotNull()
    n = F.coalesce("tables_detected", F.lit(0))
    said = F.when(failed, F.concat(F.lit("Error: "), F.substring("error", 1, 30), F.lit("..."))).otherwise(category_text(F.col("categories")))
    rows = out.select(F.when(failed, "error").otherwise("file").alias("kind"), "file", F.when(~failed, F.col("pages")).cast("long").alias("pages"), F.when(~failed, n).alias("tables"), said.alias("categories"))
    total = rows.where("kind = 'file'").agg(F.lit("total").alias("kind"), F.lit(None).cast("string").alias("file"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"), F.coalesce(F.sum("tables"), F.lit(0)).alias("tables"), F.lit("").alias("categories"))
    return rows.unionByName(total)


def result_json(files: DataFrame, tables: DataFrame, page_results: DataFrame | None = None) -> DataFrame:
    """(file, json): path, pages, tables and their categories; page results and the error only where there are some.

    ``files`` has file, pages, error; ``tables`` file, page, ord, category, confidence; ``page_results`` file, page, image.
    """
    listed = tables.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "page", "category", "confidence"))), lambda x: F.struct(x["page"].alias("page"), x["category"].alias("category"), x["confidence"].alias("confidence"))).alias("tables"))
    out = files.join(categories_per_file(tables), "file", "left").join(listed, "file", "left")
    pages = F.lit(None).cast("array<struct<page:int,image:string>>").alias("page_results")
    if page_results is not None:
        of_file = page_results.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("page", "image"))).alias("page_results"))
        out, pages = out.join(of_file, "file", "left"), F.col("page_results")
    none = F.coalesce(F.col("tables"), F.array().cast(listed.schema["tables"].dataType))
    value = F.struct(F.col("file").alias("pdf_path"), "pages", F.coalesce("tables_detected", F.lit(0)).alias("tables_detected"), F.coalesce(F.col("categories"), F.create_map().cast("map<string,bigint>")).alias("categories"), none.alias("tables"), pages, "error")
    return out.select("file", F.to_json(value).alias("json"))


#: Marks of the raster, later ones cover earlier ones.
MARKS = (("text", "."), ("table", "#"), ("image", "@"))


def page_raster(items: DataFrame, pages: DataFrame, columns: int = 60, lines: int = 30) -> DataFrame:
    """(file, page, raster): pages as lines of characters; images cover tables, tables cover text.

    ``items`` has file, page, kind and corners in points from the lower left; ``pages`` file, page, width, height.  Boxes are scaled, turned
    upside down and cut at the page's edge; every box covers one cell at least.
    """
    key = ["file", "page"]
    level = F.coalesce(*(F.when(F.col("kind") == k, i) for i, (k, _) in enumerate(MARKS)))
    cell = lambda v, size, n: F.least(F.greatest(F.floor(v / size * n), F.lit(0)), F.lit(n - 1))
    boxed = items.withColumns(ordered_box()).join(pages.select(*key, "width", "height"), key).withColumn("z", level).where("z IS NOT NULL")
    w, h = F.col("width"), F.col("height")
    spans = boxed.select(*key, "z", F.sequence(cell(F.col("x0"), w, columns), cell(F.col("x1"), w, columns)).alias("xs"), F.sequence(cell(h - F.col("y1"), h, lines), cell(h - F.col("y0"), h, lines)).alias("ys"))
    cells = spans.select(*key, "z", F.explode("xs").alias("x"), "ys").select(*key, "z", "x", F.explode("ys").alias("y")).groupBy(*key, "x", "y").agg(F.max("z").alias("z"))
    mark = F.element_at(F.array(*(F.lit(m) for _, m in MARKS)), F.col("z").cast("int") + 1)
    # a page's cells are bounded by the raster
    drawn = cells.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct((F.col("y") * columns + F.col("x")).cast("int").alias("at"), mark.alias("m")))).alias("marks"))
    row = lambda y: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda x: F.coalesce(F.try_element_at(F.col("marks"), (y * columns + x).cast("int")), F.lit(" "))), "")
    return pages.select(*key).join(drawn, key, "left").select(*key, F.array_join(F.transform(F.sequence(F.lit(0), F.lit(lines - 1)), row), "\n").alias("raster"))


def shown(rows: DataFrame, order: Sequence[Column], most: int = 20) -> DataFrame:
    """The first rows by an order, for display."""
    return rows.orderBy(*order).limit(most)
