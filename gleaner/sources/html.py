"""HTML sources: report lists, links and pagination, parsed with the standard library in Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class _Report(HTMLParser):
    """Collects the rows of the first table of class type_1: cells with text, links and classes."""

    def __init__(self) -> None:
        super().__init__()
        self.depth, self.done, self.rows, self.row, self.cell, self.link = 0, False, [], None, None, None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "table" and not self.done:
            self.depth += bool(self.depth) or "type_1" in a.get("class", "").split()
        elif not self.depth:
            return
        elif tag == "tr":
            self.row = {"cells": [], "head": False}
            self.rows.append(self.row)
        elif tag == "th" and self.row is not None:
            self.row["head"] = True
        elif tag == "td" and self.row is not None:
            self.cell = {"class": a.get("class", "").split(), "text": [], "links": []}
            self.row["cells"].append(self.cell)
        elif tag == "a" and self.cell is not None:
            self.link = {"class": a.get("class", "").split(), "href": a.get("href", ""), "text": []}
            self.cell["links"].append(self.link)

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.depth:
            self.depth -= 1
            self.done = not self.depth
        elif tag == "a":
            self.link = None
        elif tag == "td":
            self.cell = None
        elif tag == "tr":
            self.row = None

    def handle_data(self, data: str) -> None:
        for part in (self.cell, self.link):
            if part is not None:
                part["text"].append(data.strip())


def _reports(html: str | None) -> list[dict]:
    p = _Report()
    p.feed(html or "")
    found = []
    for row in p.rows:
        cells = row["cells"]
        if row["head"] or len(cells) < 5 or any({"blank_07", "blank_08"} & set(c["class"]) for c in cells):
            continue
        stock = next((x for x in cells[0]["links"] if "stock_item" in x["class"]), None)
        title = cells[1]["links"][0] if cells[1]["links"] else None
        pdf = cells[3]["links"][0]["href"] if cells[3]["links"] else ""
        broker, date = "".join(cells[2]["text"]), "".join(cells[4]["text"])
        if stock and title and broker and pdf.endswith(".pdf") and date:
            found.append({"title": "".join(title["text"]), "broker": broker, "stock_name": "".join(stock["text"]), "date": date, "pdf_url": pdf})
    return found


REPORT = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("title", "broker", "stock_name", "date", "pdf_url")]))


@F.pandas_udf(REPORT)
def parse_reports(html: pd.Series) -> pd.Series:
    return html.map(_reports)


def report_list(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """One row for each report of a listing page, in order."""
    return pages.select(key, F.posexplode(parse_reports(html)).alias("ord", "r")).select(key, "ord", "r.*")


def total_pages(html: Column) -> Column:
    """Number in the last pagination link, 1 if there is none."""
    last = F.regexp_extract(html, r'(?s)class="pgRR".*?page=(\d+)', 1)
    return F.coalesce(F.try_to_number(F.nullif(last, F.lit("")), F.lit("9999999999")).cast("int"), F.lit(1))


def links(html: Column) -> Column:
    """Targets of all links of a page, in order."""
    return F.regexp_extract_all(html, F.lit(r'<a href="([^"]*)"'), 1)
