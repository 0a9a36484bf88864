"""Result pages of search portals: HTML and JSON parsing, and a paged Python data source."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition, LessThanOrEqual, SimpleDataSourceStreamReader
from pyspark.sql.functions import pandas_udf

from sedge.functions.scalars import nth_int

# Labels of a result item and columns of a result.
DOCKET_LABEL, TYPE_LABEL = "Sygnatura", "Rodzaj dokumentu"
ITEM = T.StructType([T.StructField(n, T.StringType()) for n in ("href", "doc_id", "docket", "decision_type")])
API_PAGE = "items array<struct<id: bigint, judgmentType: string, courtCases: array<struct<caseNumber: string>>>>, info struct<totalResults: bigint>"
API_DETAIL = "data struct<judgmentDate: string, source: struct<judgmentId: string>>"
PAGE_SIZE, API_PAGE_SIZE = 10, 100
#: Judgments dated later are not asked for.
LAST_DATE = "2020-12-31"


class _Links(HTMLParser):
    """All ``<a href>`` in order, with their text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.open = False

    def handle_starttag(self, tag, attrs):
        if tag == "a" and (href := dict(attrs).get("href")) is not None:
            self.found.append({"href": href, "text": ""})
            self.open = True

    def handle_endtag(self, tag):
        self.open = self.open and tag != "a"

    def handle_data(self, data):
        if self.open:
            self.found[-1]["text"] += data


class _Results(HTMLParser):
    """Items of a result page, and the value of its result counter."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.counts: str | None = None
        self.items: list[dict] = []
        self.depth = 0
        self.paragraph: str | None = None
        self.label: str | None = None
        self.in_label = False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        classes = (a.get("class") or "").split()
        if tag == "input" and a.get("id") == "resultCounts":
            self.counts = a.get("value")
        if tag == "div":
            if self.depth:
                self.depth += 1
            elif "search-list-item" in classes:
                self.depth = 1
                self.items.append({"href": None, "docket": None, "decision_type": None})
        if not self.depth:
            return
        if tag == "a" and "link-details" in classes:
            self.items[-1]["href"] = a.get("href")
        elif tag == "p":
            self.paragraph, self.label = "", None
        elif tag == "label":
            self.in_label, self.label = True, ""

    def handle_endtag(self, tag):
        if tag == "div" and self.depth:
            self.depth -= 1
        elif tag == "label":
            self.in_label = False
        elif tag == "p" and self.paragraph is not None:
            if self.label is not None and self.items:
                label = self.label.strip().rstrip(":").strip()
                value = strip_label(" ".join(self.paragraph.split()), label)
                if label == DOCKET_LABEL:
                    self.items[-1]["docket"] = value
                elif label == TYPE_LABEL:
                    self.items[-1]["decision_type"] = value
            self.paragraph = None

    def handle_data(self, data):
        if self.in_label and self.label is not None:
            self.label += data
        if self.paragraph is not None:
            self.paragraph += data


def strip_label(text: str, label: str) -> str:
    """The value behind a label that may be repeated."""
    while label and text.startswith(label):
        text = text[len(label) :].lstrip(": \t\n")
    return re.sub(r"^[:\s]+|[:\s]+$", "", text)


def document_id(href: str) -> str:
    return href.rstrip("/").rsplit("/", 1)[-1]


@pandas_udf(T.ArrayType(T.StructType().add("href", T.StringType()).add("text", T.StringType())))
def links(html: pd.Series) -> pd.Series:
    def of(page):
        p = _Links()
        p.feed(page or "")
        return p.found

    return html.map(of)


@pandas_udf(T.StructType().add("counts", T.StringType()).add("items", T.ArrayType(ITEM)).add("error", T.StringType()))
def result_page(html: pd.Series) -> pd.DataFrame:
    """Items of each page; a page with an item without link has ``error``."""
    rows = []
    for page in html:
        p = _Results()
        p.feed(page or "")
        missing = any(i["href"] is None for i in p.items)
        items = [] if missing else [{"href": i["href"], "doc_id": document_id(i["href"]), "docket": i["docket"], "decision_type": i["decision_type"]} for i in p.items]
        rows.append((p.counts, items, "an item has no link" if missing else None))
    return pd.DataFrame(rows, columns=["counts", "items", "error"])


def result_items(pages: DataFrame, html: str) -> DataFrame:
    """One row per item with the page's total (the second number of its counter)."""
    parsed = pages.withColumn("_page", result_page(F.col(html)))
    return parsed.select(*[c for c in pages.columns if c != html], nth_int(F.col("_page.counts"), 2).alias("total_available"), F.col("_page.error").alias("error"), F.explode_outer("_page.items").alias("item")).select("*", "item.*").drop("item")


def api_tasks(pages: DataFrame, body: str) -> DataFrame:
    """Rows of a JSON result page: doc_id, case_number (first known), total."""
    parsed = pages.select(F.from_json(F.col(body), API_PAGE).alias("p"))
    item = parsed.select(F.col("p.info.totalResults").alias("total"), F.explode("p.items").alias("i"))
    return item.select(F.concat(F.lit("saos-"), F.col("i.id").cast("string")).alias("doc_id"), first_known(F.col("i.courtCases.caseNumber")).alias("case_number"), "total")


def first_known(values: Column) -> Column:
    return F.try_element_at(F.filter(values, lambda x: x.isNotNull()), F.lit(1))


def api_details(pages: DataFrame, body: str) -> DataFrame:
    """judgment_id, judgment_date, error where either is missing."""
    d = pages.select(F.from_json(F.col(body), API_DETAIL).alias("d"))
    out = d.select(F.col("d.data.source.judgmentId").alias("judgment_id"), F.col("d.data.judgmentDate").alias("judgment_date"))
    return out.withColumn("error", F.when(F.col("judgment_id").isNull(), "no judgment id").when(F.col("judgment_date").isNull(), "no judgment date"))


def discovery_target(limit: Column, total: Column) -> Column:
    """The smaller of limit and total; whichever is known; null for no bound."""
    return F.least(limit, total)


def page_counts(html: str) -> tuple[int, int | None]:
    """(items of a result page, total by the counter that only page 1 shows)."""
    p = _Results()
    p.feed(html or "")
    numbers = re.findall(r"\d+", p.counts or "")
    return len(p.items), int(numbers[1]) if len(numbers) > 1 else None


class PortalSource(DataSource):
    """Pages of a portal as a table or a stream (page, html, seen, target), from page 1.

    ``fetch`` (set with ``PortalSource.use``) maps a page number to its HTML.  ``seen`` is the number of items on the pages before,
    ``target`` how many are wanted: the smaller of option ``limit`` and the portal's counter, null where neither is known.

    As a table: one input partition per page; option ``pages`` says how many, without it page 1's counter; without a counter one
    partition walks on to the first empty page.  As a stream: ``maxPagesPerTrigger`` pages a batch (1) until the target is reached
    or a page is empty.  The offset carries all that, so a restart goes on behind the last finished batch.
    """

    fetcher: Callable[[int], str] | None = None

    @classmethod
    def name(cls) -> str:
        return "portal"

    @classmethod
    def use(cls, fetch: Callable[[int], str]) -> type[PortalSource]:
        return type("PortalSource", (cls,), {"fetcher": staticmethod(fetch)})

    def schema(self) -> str:
        return "page int, html string, seen long, target long"

    def _limit(self) -> int | None:
        return int(self.options["limit"]) if "limit" in self.options else None

    def reader(self, schema) -> DataSourceReader:
        pages = self.options.get("pages")
        return _PortalReader(self.fetcher, int(pages) if pages else None, self._limit())

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _PortalStream(self.fetcher, int(self.options.get("maxPagesPerTrigger", 1)), self._limit())


def _smaller(limit: int | None, total: int | None) -> int | None:
    known = [x for x in (limit, total) if x is not None]
    return min(known) if known else None


class _PortalReader(DataSourceReader):
    """Partitions are (first page, last page or None for the first empty one, HTML of the first page if it is at hand, target)."""

    def __init__(self, fetch, pages: int | None, limit: int | None):
        self.fetch, self.pages, self.limit = fetch, pages, limit

    def partitions(self) -> list[InputPartition]:
        if self.pages is not None:
            return [InputPartition((i, i, None, self.limit)) for i in range(1, self.pages + 1)]
        html = self.fetch(1)
        items, total = page_counts(html)
        target = _smaller(self.limit, total)
        if target is None or not items:
            return [InputPartition((1, None, html, target))]
        many = max(1, -(-target // PAGE_SIZE))
        return [InputPartition((i, i, html if i == 1 else None, target)) for i in range(1, many + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        page, last, html, target = partition.value
        seen = (page - 1) * PAGE_SIZE
        while last is None or page <= last:
            html = html if html is not None else self.fetch(page)
            items = page_counts(html)[0]
            if last is None and not items:
                return
            yield page, html, seen, target
            page, seen, html = page + 1, seen + items, None


class _PortalStream(SimpleDataSourceStreamReader):
    """Offsets: the next page, the items seen before it, the target (-1 unknown), and whether the end was reached."""

    def __init__(self, fetch, most: int, limit: int | None):
        self.fetch, self.most, self.limit = fetch, most, limit

    def initialOffset(self) -> dict:  # noqa: N802
        return {"page": 1, "seen": 0, "target": -1 if self.limit is None else self.limit, "done": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, at = [], dict(start)
        while not at["done"] and len(rows) < self.most:
            html = self.fetch(at["page"])
            items, total = page_counts(html)
            if total is not None:
                at["target"] = _smaller(self.limit, total)
            if not items:
                at["done"] = 1
                break
            rows.append((at["page"], html, at["seen"], at["target"] if at["target"] >= 0 else None))
            at["page"], at["seen"] = at["page"] + 1, at["seen"] + items
            if 0 <= at["target"] <= at["seen"]:
                at["done"] = 1
        return iter(rows), at

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        """A batch that was planned but not finished, again."""
        seen = start["seen"]
        for page in range(start["page"], end["page"]):
            html = self.fetch(page)
            yield page, html, seen, end["target"] if end["target"] >= 0 else None
            seen += page_counts(html)[0]


class JudgmentSource(DataSource):
    """Result pages of a JSON portal as rows (judgment_id, judgment_date, body), one partition per page, from page 0.

    ``fetch(page, until)`` (set with ``use``) gives a page's rows of judgments dated ``until`` at the latest; a
    condition ``judgment_date <= '...'`` on the table reaches it (with filter push-down of Python sources on), and
    option ``until`` is its default.  ``total(until)`` tells how many rows there are (``info.totalResults`` of a page), which makes a
    partition of each page; without it, and without option ``pages``, one partition walks on to the first empty page.
    """

    fetcher: Callable[[int, str], list[tuple]] | None = None
    counter: Callable[[str], int] | None = None

    @classmethod
    def name(cls) -> str:
        return "judgments"

    @classmethod
    def use(cls, fetch: Callable[[int, str], list[tuple]], total: Callable[[str], int] | None = None) -> type[JudgmentSource]:
        return type("JudgmentSource", (cls,), {"fetcher": staticmethod(fetch), "counter": staticmethod(total) if total else None})

    def schema(self) -> str:
        return "judgment_id string, judgment_date string, body string"

    def reader(self, schema) -> DataSourceReader:
        pages = self.options.get("pages")
        return _JudgmentReader(self.fetcher, self.counter, int(pages) if pages else None, self.options.get("until", LAST_DATE))


class _JudgmentReader(DataSourceReader):
    def __init__(self, fetch, total, pages: int | None, until: str):
        self.fetch, self.total, self.pages, self.until = fetch, total, pages, until

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, LessThanOrEqual) and f.attribute == ("judgment_date",) and isinstance(f.value, str):
                self.until = min(self.until, f.value)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        many = self.pages
        if many is None and self.total is not None:
            many = -(-self.total(self.until) // API_PAGE_SIZE)
        return [InputPartition(None)] if many is None else [InputPartition(i) for i in range(many)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is not None:
            yield from self.fetch(partition.value, self.until)
            return
        page = 0
        while rows := list(self.fetch(page, self.until)):
            yield from rows
            page += 1
