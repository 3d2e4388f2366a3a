"""Layout operators: box joins and merges, table classification, matching and metrics, page statistics."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.functions import geometry as G
from gleaner.functions import text as X
from gleaner.operators.collect import running_count, running_total
from gleaner.operators.components import components, least_labels
from gleaner.operators.storage import freed_shuffles, written

#: Rules of the five statement categories, in order of preference on ties (fixed values).
CATEGORIES = [
    ("income_statement", 1.0, 2, ["매출액", "매출원가", "매출총이익", "영업이익", "영업외손익", "세전순이익", "법인세", "당기순이익", "지배주주순이익", "순이익"]),
    ("balance_sheet", 1.0, 2, ["자산총계", "부채총계", "자본총계", "유동자산", "비유동자산", "유동부채", "비유동부채", "이익잉여금", "자본금"]),
    ("cash_flow", 1.0, 2, ["영업활동", "투자활동", "재무활동", "현금흐름", "현금증감", "FCF", "CAPEX"]),
    ("valuation", 0.8, 3, ["EPS", "BPS", "CFPS", "PER", "PBR", "PCR", "P/E", "P/B", "P/CF", "ROE", "ROA", "ROIC", "EBITDA", "EV/EBITDA", "EV/EBIT", "배당수익률", "DPS"]),
    ("performance", 0.5, 2, ["YoY", "QoQ", "전년비", "성장률", "증감률", "전분기비"]),
]
#: Patterns of year and quarter headings (fixed values).
TEMPORAL = [r"20\d{2}[EFef]?", r"[1-4][Qq]\d{2}", r"\d{1,2}[분반]기", r"FY\d{2,4}", r"\d{4}년"]


#: Boxes of a page that are compared with each other; those of larger pages, and of pages with a null, meet in the cells of grids.
PAGE_BOXES = 64
_CORNERS = ["x0", "y0", "x1", "y1"]


def overlapping(boxes: DataFrame, page: list[str], order: str, least: float = 0.0) -> DataFrame:
    """(page.., i, j, iou) with i < j for pairs of boxes on a page whose IoU exceeds ``least``.

    Boxes of small pages are compared with each other, so they travel with their page only.  On others every box lies on the grid whose
    cells are the least power of two that is as wide and high as the box, so it touches four cells at most, whatever sizes the other
    boxes have.  It looks for larger boxes in the grids of their sizes, where it touches four cells too.
    A pair is made only in the cell with the upper left corner of its intersection, so no pair comes twice.  Boxes without an area
    overlap nothing; boxes without a page share one.
    """
    return _overlapping(boxes, page, order, least, _large_pages(boxes, page)).select(*page, "i", "j", "iou")


def _large_pages(boxes: DataFrame, page: list[str]) -> DataFrame | None:
    """Struct ``_page`` of the pages whose boxes aren't all compared, None if there are none."""
    null = reduce(or_, (F.col(p).isNull() for p in page))
    counts = boxes.groupBy(*page).agg(F.count("*").alias("_n")).where((F.col("_n") > PAGE_BOXES) | null)
    with freed_shuffles(boxes.sparkSession):
        large, _ = written(counts.select(F.struct(*page).alias("_page")), "pages")
        return None if large.isEmpty() else large


def _overlapping(boxes: DataFrame, page: list[str], order: str, least: float, large: DataFrame | None) -> DataFrame:
    """(page.., i, j, iou, area_i, area_j) of the pairs."""
    sized = boxes.where("x1 > x0 AND y1 > y0").select(*page, F.col(order).alias("k"), *_CORNERS)
    small = sized if large is None else sized.withColumn("_page", F.struct(*page)).join(large, "_page", "left_anti").drop("_page")
    pairs = _on_small_pages(small, page)
    if large is not None:
        pairs = pairs.unionByName(_on_grids(sized.select(F.struct(*page).alias("_page"), "k", *_CORNERS).join(large, "_page", "left_semi"), page))
    a, b = G.corners("l_"), G.corners("r_")
    pairs = pairs.withColumn("iou", G.iou(a, b)).where(F.col("iou") > least)
    left = F.col("l_k") < F.col("r_k")
    areas = [F.when(left, G.area(x)).otherwise(G.area(y)).alias(n) for x, y, n in ((a, b, "area_i"), (b, a, "area_j"))]
    return pairs.select(*page, F.least("l_k", "r_k").alias("i"), F.greatest("l_k", "r_k").alias("j"), "iou", *areas)


def _sides(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    return tuple(rows.select(*(F.col(c).alias(f"{s}_{c}") for c in [*keys, "k", *_CORNERS])) for s in "lr")


def _on_small_pages(sized: DataFrame, page: list[str]) -> DataFrame:
    l, r = _sides(sized, page)
    same_page = reduce(and_, (F.col(f"l_{p}") == F.col(f"r_{p}") for p in page))
    level = lambda s: _level(G.corners(f"{s}_"))
    once = (F.col("l_k") < F.col("r_k")) | ((F.col("l_k") == F.col("r_k")) & (level("l") < level("r")))
    pairs = l.join(r, same_page & once & (G.overlap_area(G.corners("l_"), G.corners("r_")) > 0))
    return pairs.select(*(F.col(f"l_{p}").alias(p) for p in page), *(c for side in "lr" for c in (f"{side}_k", *(f"{side}_{x}" for x in _CORNERS))))


def _level(b) -> Column:
    return F.ceil(F.log2(F.greatest(b[2] - b[0], b[3] - b[1]))).cast("int")


def _on_grids(boxes: DataFrame, page: list[str]) -> DataFrame:
    sized = boxes.withColumn("level", _level(G.corners()))
    levels = sized.groupBy("_page").agg(F.collect_set("level").alias("levels"))

    def on_grid(rows: DataFrame) -> DataFrame:
        cell = lambda v: F.floor(F.col(v) / F.pow(F.lit(2.0), "grid"))
        return rows.withColumn("cx", F.explode(F.sequence(cell("x0"), cell("x1")))).withColumn("cy", F.explode(F.sequence(cell("y0"), cell("y1"))))

    home = on_grid(sized.withColumn("grid", F.col("level"))).select("_page", "grid", "cx", "cy", F.col("k").alias("r_k"), *(F.col(c).alias(f"r_{c}") for c in _CORNERS))
    asks = sized.join(levels, "_page").withColumn("grid", F.explode(F.filter("levels", lambda g: g >= F.col("level"))))
    asks = on_grid(asks).select("_page", "grid", "cx", "cy", "level", F.col("k").alias("l_k"), *(F.col(c).alias(f"l_{c}") for c in _CORNERS))
    corner = lambda c: F.floor(F.greatest(f"l_{c}", f"r_{c}") / F.pow(F.lit(2.0), "grid"))
    once = (F.col("level") < F.col("grid")) | (F.col("l_k") < F.col("r_k"))
    meet = G.overlap_area(G.corners("l_"), G.corners("r_")) > 0
    pairs = asks.join(home, ["_page", "grid", "cx", "cy"]).where(once & (corner("x0") == F.col("cx")) & (corner("y0") == F.col("cy")) & meet)
    return pairs.select(*(F.col(f"_page.{p}").alias(p) for p in page), *(c for side in "lr" for c in (f"{side}_k", *(f"{side}_{x}" for x in _CORNERS))))


#: Edges of one page that a task links at once; pages with more are linked by rounds over all tasks.
PAGE_EDGES = 1_000_000


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page hash, box, least box linked with it) of a task's edges, which come page by page."""

    def close(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        page, i, j = (rows[c].to_numpy() for c in ("_h", "i", "j"))
        ends = np.stack([np.append(page, page), np.append(i, j)], 1)
        # by page and box, so the least vertex of a group is its least box
        vertices, at = np.unique(ends, axis=0, return_inverse=True)
        at = at.reshape(-1)
        label = least_labels(at[: len(page)], at[len(page) :], len(vertices))
        return pa.RecordBatch.from_arrays([pa.array(vertices[:, 0]), pa.array(vertices[:, 1]), pa.array(vertices[label, 1])], ["_h", "_k", "group"])

    held, n = [], 0
    for batch in batches:
        page = batch.column("_h").to_numpy()
        if n + len(page) > PAGE_EDGES and len(page):
            # up to the last page that ends for sure
            cut = int(np.flatnonzero(page != page[-1])[-1]) + 1 if (page != page[-1]).any() else 0
            if cut or (held and held[-1].column("_h")[-1].as_py() != page[0]):
                yield close([*held, batch.slice(0, cut)] if cut else held)
                held, n, batch = [], 0, batch.slice(cut)
        held.append(batch)
        n += batch.num_rows
    if n:
        yield close(held)


def overlap_groups(boxes: DataFrame, page: list[str], order: str, threshold: float = 0.5, inclusive: bool = True) -> DataFrame:
    """Adds ``group``: the least box (by ``order``, a whole number) of those that overlap, directly or through others, by the threshold or more.

    Boxes alone are their own group; with ``inclusive`` false the overlap must exceed the threshold.  Links never leave a page, so pages
    are dealt over the tasks, which link each at once; only pages with more than ``PAGE_EDGES`` overlaps take rounds over all tasks.
    """
    linked, _ = _linked_boxes(boxes, page, order, threshold, inclusive)
    named = boxes.withColumns({"_h": F.xxhash64(*page), "_k": F.col(order).cast("long")}).join(linked, ["_h", "_k"], "left")
    return named.select(*boxes.columns, F.coalesce("group", "_k").cast(boxes.schema[order].dataType).alias("group"))


def _linked_boxes(boxes: DataFrame, page: list[str], order: str, threshold: float, inclusive: bool, large: DataFrame | None = None, known: bool = False) -> tuple[DataFrame, DataFrame]:
    """(_h, _k, group) of the boxes that overlap another one, and the overlaps (_h, page.., i, j, area_i, area_j); ``known``: ``large`` tells the large pages."""
    pairs = _overlapping(boxes, page, order, 0.0, large if known else _large_pages(boxes, page))
    pairs = pairs.where(F.col("iou") >= threshold if inclusive else F.col("iou") > threshold)
    with freed_shuffles(boxes.sparkSession):
        edges, _ = written(pairs.select(F.xxhash64(*page).alias("_h"), *page, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "area_i", "area_j"), "edges")
        large = edges.groupBy("_h").count().where(F.col("count") > PAGE_EDGES).select("_h")
        few = edges.select("_h", "i", "j").join(large, "_h", "left_anti").repartition("_h").sortWithinPartitions("_h")
        linked = few.mapInArrow(_linked, "_h long, _k long, group long")
        many = edges.join(large, "_h", "left_semi")
        if not many.isEmpty():
            # structs of page and box, as text whose order is that of the numbers within a page
            name = lambda c: F.concat_ws(":", F.col("_h").cast("string"), F.lpad(F.conv(F.col(c).cast("string"), 10, 16), 16, "0"))
            labels = components(many.select(name("i").alias("a"), name("j").alias("b")))
            part = lambda c, at: F.element_at(F.split(c, ":"), at)
            number = lambda c: F.conv(part(c, 2), 16, -10).cast("long")
            linked = linked.unionByName(labels.select(part("id", 1).cast("long").alias("_h"), number("id").alias("_k"), number("label").alias("group")))
        return linked, edges


def merge_boxes(boxes: DataFrame, page: list[str], order: str, threshold: float = 0.3) -> DataFrame:
    """The largest box (first on ties) of every group that overlaps, directly or through others, by more than the threshold.

    Only boxes that overlap others take part in more than the split by pages; those that aren't the best of their group go.
    """
    large = _large_pages(boxes, page)
    linked, edges = _linked_boxes(boxes, page, order, threshold, False, large, known=True)
    ends = edges.select("_h", *page, F.explode(F.array(*(F.struct(F.col(c).alias("_k"), F.col(f"area_{c}").alias("area")) for c in "ij"))).alias("e"))
    ends = linked.join(ends.select("_h", *page, "e.*").distinct(), ["_h", "_k"])
    best = ends.groupBy("_h", "group").agg(F.max(F.struct("area", (-F.col("_k")).alias("at")))["at"].alias("at"))
    with freed_shuffles(boxes.sparkSession):
        gone, _ = written(ends.join(best, ["_h", "group"]).where(F.col("_k") != -F.col("at")).select("_h", F.struct(*page).alias("_page"), "_k"), "gone")
    # pages are whole already, and a small one has few boxes
    few = gone if large is None else gone.join(large, "_page", "left_anti")
    of_page = few.groupBy(*(F.col(f"_page.{p}").alias(p) for p in page)).agg(F.collect_set("_k").alias("_gone"))
    left = boxes.join(of_page, page, "left").where(F.col("_gone").isNull() | ~F.array_contains("_gone", F.col(order).cast("long")))
    if large is not None:
        many = gone.join(large, "_page", "left_semi").select("_h", "_k")
        left = left.withColumns({"_h": F.xxhash64(*page), "_k": F.col(order).cast("long")}).join(many, ["_h", "_k"], "left_anti")
    return left.select(*boxes.columns)


def inside_table(blocks: DataFrame, tables: DataFrame, page: list[str], id: str, threshold: float = 0.5) -> DataFrame:
    """Adds ``in_table``: more than half of the block lies in one of the page's tables."""
    cols = ["x0", "y0", "x1", "y1"]
    t = tables.select(*page, *(F.col(c).alias(f"t_{c}") for c in cols))
    hit = blocks.join(t, page).where(G.mostly_inside(G.corners(), G.corners("t_"), threshold)).select(*page, id).distinct().withColumn("in_table", F.lit(True))
    return blocks.join(hit, [*page, id], "left").withColumn("in_table", F.coalesce("in_table", F.lit(False)))


# --- classification ---------------------------------------------------------------------------------------------------

def keyword_score(c: Column, rules=CATEGORIES) -> Column:
    """Struct(category, confidence, keywords) of the best category, null if none has enough keywords.

    A keyword counts once if it is a substring; the confidence is the weighted count over 6, 1 at most.
    """
    best = []
    for at, (name, weight, least, keywords) in enumerate(rules):
        hits = F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(c, k))
        score = F.size(hits) * F.lit(float(weight))
        best.append(F.when(F.size(hits) >= least, F.struct(score.alias("score"), F.lit(-at).alias("at"), F.lit(name).alias("category"), hits.alias("keywords"))))
    top = F.array_max(F.array(*best))
    return F.when(top.isNotNull(), F.struct(top["category"].alias("category"), F.least(top["score"] / 6, F.lit(1.0)).alias("confidence"), top["keywords"].alias("keywords")))


def temporal_evidence(c: Column) -> Column:
    """Sum over the patterns of how many different strings each matches."""
    out = F.lit(0)
    for p in TEMPORAL:
        out = out + F.size(F.array_distinct(F.regexp_extract_all(c, F.lit(p), 0)))
    return out


def classify_tables(candidates: DataFrame, text: str = "text_content", rules=CATEGORIES, density: float = 0.2, temporal: int = 2, size_ok: Column | None = None) -> DataFrame:
    """Candidates that are financial tables, with category, confidence and keywords; candidates without text never are."""
    out = candidates.where(F.length(F.coalesce(text, F.lit(""))) > 0)
    out = out if size_ok is None else out.where(size_ok)
    out = out.withColumn("_k", keyword_score(F.col(text), rules)).where("_k IS NOT NULL").where(X.numeric_density(F.col(text)) >= (density or 0.2))
    sure = F.when(temporal_evidence(F.col(text)) >= (temporal or 2), F.least(F.col("_k.confidence") + 0.1, F.lit(1.0))).otherwise(F.col("_k.confidence"))
    return out.select(*candidates.columns, F.col("_k.category").alias("category"), sure.alias("confidence"), F.col("_k.keywords").alias("keywords")).where("confidence >= 0.3")


def text_or_page(candidates: DataFrame, page_texts: DataFrame, page: list[str], text: str = "text_content") -> DataFrame:
    """Candidates without text take that of their whole page (``page_texts``: page.., page_text)."""
    out = candidates.join(page_texts.select(*page, "page_text"), page, "left")
    own = F.when(F.length(F.coalesce(F.col(text), F.lit(""))) > 0, F.col(text)).otherwise(F.col("page_text"))
    return out.withColumn(text, own).drop("page_text")


def financial_tables(candidates: DataFrame, page: list[str], order: str, page_texts: DataFrame | None = None, overlap: float = 0.3, **rules) -> DataFrame:
    """Financial tables among the candidates of all detectors: overlapping ones merged, texts filled in, classified, most confident first.

    Rows that carry an error take no part; ties go to the earlier page and place.
    """
    good = candidates.where("error IS NULL") if "error" in candidates.columns else candidates
    if page_texts is None:
        return classify_tables(merge_boxes(good, page, order, overlap), **rules).orderBy(F.desc("confidence"), *page, order)
    # a page's text is classified once, and pages without any text that could count aren't merged
    text, size_ok = rules.pop("text", "text_content"), rules.pop("size_ok", None)
    columns = [*page, *(c for c in good.columns if c not in page)]
    bare = F.length(F.coalesce(F.col(text), F.lit(""))) == 0
    with freed_shuffles(candidates.sparkSession):
        hits, _ = written(classify_tables(page_texts.select(*page, F.col("page_text").alias(text)), text, **rules), "page_texts")
        pages, _ = written(hits.select(*page).union(good.where(~bare).select(*page)).distinct(), "pages")
    of_pages = pages.select(*(F.col(p).alias(f"_{p}") for p in page))
    wanted = good.join(of_pages, reduce(and_, (F.col(p).eqNullSafe(F.col(f"_{p}")) for p in page)), "left_semi")
    merged = merge_boxes(wanted, page, order, overlap).select(*columns)
    merged = merged if size_ok is None else merged.where(size_ok)
    added = ["category", "confidence", "keywords"]
    filled = merged.where(bare).drop(text).join(hits, page).select(*columns, *added)
    return classify_tables(merged.where(~bare), text, **rules).unionByName(filled).orderBy(F.desc("confidence"), *page, order)


# --- matching and metrics ---------------------------------------------------------------------------------------------

def match_detections(predictions: DataFrame, truths: DataFrame, image: str = "image_id", idx: str = "det_idx", threshold: float = 0.5) -> DataFrame:
    """Greedy one-to-one pairs per image: larger IoU first, then smaller indices.  Boxes in percent form.

    Matching is local to an image, whose boxes are few; labels play no part.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold must lie in [0, 1]")
    cols = ["x", "y", "width", "height", "label"]
    p = predictions.select(image, F.col(idx).alias("p"), *(F.col(c).alias(f"p_{c}") for c in cols))
    g = truths.select(image, F.col(idx).alias("g"), *(F.col(c).alias(f"g_{c}") for c in cols))
    box = lambda s: G.from_xywh(*(F.col(f"{s}_{c}") for c in cols[:4]))
    pairs = p.join(g, image).withColumn("iou", G.iou(box("p"), box("g"))).where(F.col("iou") >= threshold)
    sorted_ = pairs.groupBy(image).agg(F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("o"), "p", "g", "p_label", "g_label"))).alias("s"))
    chosen = F.aggregate("s", F.slice("s", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda y: (y["p"] == x["p"]) | (y["g"] == x["g"])), acc).otherwise(F.concat(acc, F.array(x))))
    return sorted_.select(image, F.explode(chosen).alias("m")).select(image, F.col("m.p").alias("p"), F.col("m.g").alias("g"), (-F.col("m.o")).alias("iou"), (F.col("m.p_label") == F.col("m.g_label")).alias("same_label"))


def detection_counts(predictions: DataFrame, truths: DataFrame, matches: DataFrame, image: str = "image_id") -> DataFrame:
    """tp, fp, fn and same-label matches per image; an image on one side only counts too."""
    n = lambda df, name: df.groupBy(image).agg(F.count("*").alias(name))
    m = matches.groupBy(image).agg(F.count("*").alias("tp"), F.count_if("same_label").alias("same"))
    both = n(predictions, "np").join(n(truths, "ng"), image, "full").join(m, image, "left").fillna(0, ["np", "ng", "tp", "same"])
    return both.select(image, "tp", (F.col("np") - F.col("tp")).alias("fp"), (F.col("ng") - F.col("tp")).alias("fn"), "same")


def metrics(counts: DataFrame) -> DataFrame:
    t = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn", "same")))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    t = t.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return t.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn("category_accuracy", F.try_divide(F.col("same"), F.col("tp")))


# --- sequences --------------------------------------------------------------------------------------------------------

def islands(rows: DataFrame, partition: str, order: list[str], inside: Column) -> DataFrame:
    """Runs of neighbouring rows for which ``inside`` holds: adds ``pos`` (from 0) and ``island`` (null outside)."""
    w = W.partitionBy(partition).orderBy(*order)
    out = rows.withColumn("pos", F.row_number().over(w) - 1).withColumn("_in", inside)
    out = out.withColumn("_n", F.row_number().over(W.partitionBy(partition, "_in").orderBy("pos")))
    return out.withColumn("island", F.when(F.col("_in"), F.col("pos") - F.col("_n"))).drop("_n", "_in")


def anomaly_windows(rows: DataFrame, partition: str, order: list[str], score: str, threshold: float, expand: float = 0.8) -> DataFrame:
    """First and last position of every run above ``expand * threshold`` that rises over the threshold (which is positive)."""
    runs = islands(rows, partition, order, F.col(score) > threshold * expand).where("island IS NOT NULL")
    return runs.groupBy(partition, "island").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.max(score).alias("peak")).where(F.col("peak") > threshold).drop("island")


def seed_windows(rows: DataFrame, partition: str, order: list[str], score: str, threshold: float, expand: float = 0.8) -> DataFrame:
    """As ``anomaly_windows``, but one window for every row over the threshold."""
    runs = islands(rows, partition, order, F.col(score) > threshold * expand).where("island IS NOT NULL")
    bounds = runs.groupBy(partition, "island").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    return runs.where(F.col(score) > threshold).select(partition, "island", F.col("pos").alias("seed_pos")).join(bounds, [partition, "island"]).drop("island")


def entity_spans(rows: DataFrame, partition: str, order: list[str], probability: str, center: Column, threshold: float = 0.5) -> DataFrame:
    """For every row that ``center`` marks: first and last position of the run of probabilities of at least the threshold around it.

    Both are null where the centre itself lies below.
    """
    runs = islands(rows.withColumn("_center", center), partition, order, F.col(probability) >= threshold)
    bounds = runs.where("island IS NOT NULL").groupBy(partition, "island").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    return runs.where("_center").select(partition, "island", F.col("pos").alias("center_pos")).join(bounds, [partition, "island"], "left").drop("island")


def semantic_chunks(rows: DataFrame, order: str, vector: str, partition: str | None = None, threshold: float = 0.7) -> DataFrame:
    """Adds ``cosine`` and ``chunk``: a new one starts where the cosine with the row before is below the threshold.

    Without a partition the whole table is one sequence: rows are numbered over all tasks and meet their neighbour in a join.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    if partition is None:
        placed = running_count(rows, [F.col(order)])
        out = placed.join(placed.select((F.col("ordinal") + 1).alias("ordinal"), F.col(vector).alias("_b")), "ordinal", "left").drop("ordinal")
    else:
        w = W.partitionBy(partition).orderBy(order)
        out = rows.withColumn("_b", F.lag(vector).over(w))
    cosine = dot(F.col("_b"), F.col(vector)) / (F.sqrt(dot(F.col("_b"), F.col("_b"))) * F.sqrt(dot(F.col(vector), F.col(vector))))
    out = out.withColumn("cosine", cosine)
    cut = F.when(F.col("_b").isNotNull() & (F.col("cosine") < threshold), 1).otherwise(0).cast("long")
    if partition is None:
        return running_total(out, [F.col(order)], cut, "chunk").drop("_b")
    return out.withColumn("chunk", F.sum(cut).over(w)).drop("_b")
