"""HTML documents to text lines: a table row stays on one line as 'a | b'."""

from __future__ import annotations

import re
from collections.abc import Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Cells that carry no value of their own, elements that end a line, elements without text.
BARE_CELLS = ("$", "%", ")")
BLOCKS = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "title", "br", "article", "section", "table", "ul", "ol"}
SILENT = {"script", "style"}
# A cell of figures and marks only, entities in table cells (the ampersand last).
NO_LABEL = r"^[\s\d$(),.%\-\u2014]*$"
ENTITIES = (("&nbsp;", " "), ("&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#8217;", "\u2019"), ("&#8212;", "\u2014"), ("&amp;", "&"))


class _Lines(HTMLParser):
    """Text lines of one document. A table inside a cell gives lines of its own; the outer row goes on afterwards."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.text, self.quiet = [], [], 0
        self.rows: list[list[str]] = []  # open rows, outermost first
        self.cells: list[tuple[int, list[str]]] = []  # open cells with the depth of their row
        self.tables: list[int] = []  # rows open where each open table began

    def _flush(self):
        t = " ".join("".join(self.text).split())
        self.text = []
        if t:
            self.lines.append(t)

    def _in_cell(self):
        return bool(self.cells) and self.cells[-1][0] == len(self.rows)

    def _end_cell(self):
        if self._in_cell():
            t = " ".join("".join(self.cells.pop()[1]).split())
            if t and t not in BARE_CELLS:
                self.rows[-1].append(t)

    def _end_row(self):
        self._end_cell()
        if self.rows:
            cells = self.rows.pop()
            if cells:
                self.lines.append(" | ".join(cells))

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.quiet += 1
        elif tag == "table":
            if not self.cells:
                self._flush()
            self.tables.append(len(self.rows))
        elif tag == "tr":
            if len(self.rows) > (self.tables[-1] if self.tables else 0):
                self._end_row()  # the row before was not closed
            if not self.rows:
                self._flush()
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self._end_cell()
            self.cells.append((len(self.rows), []))
        elif tag in BLOCKS:
            self._break()

    def _break(self):
        if self.cells:
            self.cells[-1][1].append(" ")
        else:
            self._flush()

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.quiet = max(0, self.quiet - 1)
        elif tag in ("td", "th"):
            self._end_cell()
        elif tag == "tr":
            self._end_row()
        elif tag == "table" and self.tables:
            base = self.tables.pop()
            while len(self.rows) > base:
                self._end_row()
            self._break()
        elif tag in BLOCKS:
            self._break()

    def handle_data(self, data):
        if not self.quiet:
            (self.cells[-1][1] if self.cells else self.text).append(data)

    def finish(self):
        while self.rows:
            self._end_row()
        self._flush()


def lines_of(body: str | None) -> list[str]:
    if not body:
        return []
    if not re.search(r"<(html|table|p|div)", body, re.I):
        return [s for s in body.splitlines() if s.strip()]
    p = _Lines()
    p.feed(body)
    p.close()
    p.finish()
    return p.lines


@F.pandas_udf(T.ArrayType(T.StringType()))
def html_lines(body: pd.Series) -> pd.Series:
    return body.map(lines_of)


def to_lines(docs: DataFrame, key: str, body: str) -> DataFrame:
    """One row per text line: (key, line_no, line)."""
    return docs.select(key, F.posexplode(html_lines(F.col(body))).alias("line_no", "line"))


def row_labels(lines: DataFrame, key: str) -> DataFrame:
    """First text cell of each table row with the row's numbers, for matching facts to printed labels."""
    from tidemark.functions.text import numbers

    cells = F.split(F.col("line"), r" \| ")
    v = numbers(F.array_join(F.slice(cells, F.lit(2), F.size(cells)), " | "))
    d = lines.where(F.col("line").contains(" | ")).select(key, cells[0].alias("label"), F.explode(v).alias("value"))
    return d.where(~F.col("label").rlike(NO_LABEL))


def fact_row_labels(docs: DataFrame, key: str, body: str, concepts: Sequence[str]) -> DataFrame:
    """Printed row label of every tagged figure of an inline-XBRL document: key, context, value in millions, label.

    The label is the first cell before the figure, in its table row, that holds more than figures and marks. Scale and
    sign attributes count; figures that are no number, and figures outside a row, are left out.
    """
    rows = F.regexp_extract_all(F.col(body), F.lit(r"(?is)<tr\b(?:(?!<tr\b).)*"), F.lit(0))
    d = docs.select(key, F.posexplode(rows).alias("row_no", "row"))
    # Each tagged figure with what stands before it in its row.
    tags = F.regexp_extract_all("row", F.lit(r"(?is)<ix:nonFraction\b[^>]*>[^<]*<"), F.lit(0))
    before = F.split("row", r"(?is)<ix:nonFraction\b[^>]*>[^<]*<", -1)
    d = d.select(key, "row_no", F.posexplode(F.arrays_zip(tags.alias("tag"), before.alias("gap"))).alias("i", "x"), before.alias("gaps"), tags.alias("tags"))
    d = d.where(F.col("x.tag").isNotNull())
    lead = F.concat_ws("", F.zip_with(F.slice("gaps", F.lit(1), F.col("i") + 1), F.slice("tags", F.lit(1), F.col("i")), lambda g, t: F.concat(F.coalesce(g, F.lit("")), F.coalesce(t, F.lit("")), F.lit("/x>"))))
    cells = F.transform(F.regexp_extract_all(lead, F.lit(r"(?is)<td\b[^>]*>(.*?)</td\s*>"), F.lit(1)), _plain)
    label = F.get(F.filter(cells, lambda c: ~c.rlike(NO_LABEL)), F.lit(0))
    tag = F.col("x.tag")
    attr = lambda name: F.regexp_extract(tag, rf'(?i)\b{name}="([^"]*)"', 1)
    number = F.replace(F.trim(F.regexp_extract(tag, r"(?s)>([^<]*)<$", 1)), F.lit(","), F.lit("")).try_cast("double")
    value = number * F.pow(F.lit(10.0), F.coalesce(attr("scale").try_cast("int"), F.lit(0))) / 1e6 * F.when(attr("sign") == "-", -1).otherwise(1)
    d = d.where(F.regexp_extract(attr("name"), r"([^:]+)$", 1).isin(*concepts))
    d = d.select(key, attr("contextRef").alias("context"), F.round(value, 3).alias("value"), label.alias("label"), "row_no", "i")
    d = d.where((F.col("context") != "") & F.col("value").isNotNull() & F.col("label").isNotNull())
    return d.groupBy(key, "context", "value").agg(F.max_by("label", F.struct("row_no", "i")).alias("label"))


def _plain(cell: Column) -> Column:
    """Text of a cell: tags off, the entities that tables use, blanks collapsed."""
    x = F.regexp_replace(cell, "<[^>]*>", " ")
    for name, char in ENTITIES:
        x = F.replace(x, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(x, r"[\s\u00a0]+", " "))
