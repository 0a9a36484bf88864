"""Text of a page from its glyphs: lines, paragraphs and spaces follow from geometry.

A page is an array of glyphs in reading order - character, box and baseline.  Thresholds scale with the page's
median glyph height; medians are upper ones over finite values.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

GLYPH = "struct<ch: string, left: float, right: float, top: float, bottom: float, baseline: float>"

# Height where none is known, and thresholds in heights (or gaps) with their least values.
HEIGHT = 8.0
LINE, LEAST_LINE = 0.8, 1.0
PARAGRAPH, LINES_A_PARAGRAPH = 1.8, 1.5
GAP, LEAST_GAP, GAP_SHARE = 0.45, 0.75, 0.8


def upper_median(values: list[float]) -> float | None:
    known = sorted(v for v in values if math.isfinite(v))
    return known[len(known) // 2] if known else None


def render(glyphs: list[dict] | None) -> str:
    """The text of one page; empty for a page without glyphs."""
    shown = [g for g in glyphs or [] if g["ch"] and g["ch"] not in "\0\r"]
    if not shown:
        return ""
    heights = [h for g in shown if (h := abs(g["top"] - g["bottom"])) > 0]
    height = upper_median(heights) or HEIGHT
    line = max(LINE * height, LEAST_LINE)
    paragraph = max(PARAGRAPH * height, LINES_A_PARAGRAPH * line)
    steps = [(abs(b["baseline"] - a["baseline"]), b["left"] - a["right"]) for a, b in zip(shown, shown[1:], strict=False)]
    usual = max(GAP * height, LEAST_GAP)
    middle = upper_median([gap for drop, gap in steps if drop <= line and gap > 0])
    space = usual if middle is None else max(middle, GAP_SHARE * usual)
    out = [shown[0]["ch"]]
    for before, glyph, (drop, gap) in zip(shown, shown[1:], steps, strict=False):
        last = out[-1][-1]
        if glyph["ch"] == "\n":
            if last != "\n":
                out.append("\n")
            continue
        if before["ch"] != "\n":
            if drop > line:
                out.append("\n\n" if drop > paragraph else "\n")
            elif gap > space and not before["ch"].isspace() and not glyph["ch"].isspace():
                out.append(" ")
        out.append(glyph["ch"])
    return "".join(out)


@pandas_udf(StringType())
def page_text(glyphs: pd.Series) -> pd.Series:
    return glyphs.map(lambda g: render(None if g is None else list(g)))


def document_text(pages: DataFrame, doc: str, page: str, glyphs: str) -> DataFrame:
    """(doc, text): pages in order, joined by blank lines, empty ones left out."""
    from sedge.operators.payload import join_pages

    return join_pages(pages.select(doc, page, page_text(F.col(glyphs)).alias("_text")), doc, page, "_text")
