"""Staging readers: CSV exports, JSON pages, and a paged REST source with pushed filters."""

from __future__ import annotations

import csv
import json
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, In, InputPartition

from ..schema import RENAMED_FIELDS, STAGING, STAGING_COLUMNS

PAGE = 50_000


class HeaderError(ValueError):
    """The file doesn't have the agreed number of columns."""


def check_header(spark: SparkSession, path: str) -> None:
    """Columns are taken by position, so their number must agree. Only the first line is read."""
    first = spark.read.text(path).limit(1).collect()
    found = len(next(csv.reader([first[0][0]]))) if first else 0
    if found != len(STAGING_COLUMNS):
        raise HeaderError(f"the header has {found} columns, expected {len(STAGING_COLUMNS)}")


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """An export as staging rows, all strings, by position."""
    check_header(spark, path)
    return spark.read.schema(STAGING).option("header", True).option("enforceSchema", True).option("multiLine", True).option("escape", '"').csv(path)


def stage_fields(rows: DataFrame) -> DataFrame:
    """Source records as staging rows, matched by name; absent fields are null and the raw location is never set."""
    source = {new: old for old, new in RENAMED_FIELDS.items()}
    pick = lambda c: F.col(source.get(c, c)).cast("string") if source.get(c, c) in rows.columns and c != "location_raw" else F.lit(None).cast("string")
    return rows.select(*[pick(c).alias(c) for c in STAGING_COLUMNS])


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Saved JSON-lines pages as staging rows; the schema is given, not inferred."""
    fields = {v: k for k, v in RENAMED_FIELDS.items()}
    schema = ", ".join(f"`{fields.get(c, c)}` string" for c in STAGING_COLUMNS if c != "location_raw")
    return stage_fields(spark.read.schema(schema).json(path))


class PagedSource(DataSource):
    """``spark.read.format("paged_rest")``: options url, token, page, pages, order.

    Filters on created_date and agency go to the service, for which the session
    needs spark.sql.python.filterPushdown.enabled; each task reads a run
    of pages by offset until a short or empty one. ``pages`` above one splits
    the offsets over that many tasks, each of which takes every pages-th page.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_rest"

    def schema(self):
        fields = {v: k for k, v in RENAMED_FIELDS.items()}
        return ", ".join(f"{fields.get(c, c)} string" for c in STAGING_COLUMNS if c != "location_raw")

    def reader(self, schema):
        return PagedReader(dict(self.options), schema)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.options, self.names, self.where = options, [f.name for f in schema.fields], []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column == "created_date" and isinstance(f, GreaterThan):
                self.where.append(f"created_date > {_quoted(f.value)}")
            elif column == "agency" and isinstance(f, In):
                self.where.append(f"agency IN ({', '.join(map(_quoted, f.value))})")
            elif column == "agency" and isinstance(f, EqualTo):
                self.where.append(f"agency = {_quoted(f.value)}")
            yield f  # Spark checks them again

    def partitions(self):
        return [InputPartition(i) for i in range(int(self.options.get("pages", "1")))]

    def read(self, partition) -> Iterator[tuple]:
        size, tasks = int(self.options.get("page", PAGE)), int(self.options.get("pages", "1"))
        at = partition.value * size
        while rows := self._fetch(size, at):
            for r in rows:
                yield tuple(None if r.get(n) is None else str(r[n]) for n in self.names)
            if len(rows) < size:
                break
            at += size * tasks

    def _fetch(self, limit: int, offset: int) -> list[dict]:
        query = {"$order": self.options.get("order", "created_date ASC"), "$limit": limit, "$offset": offset}
        if self.where:
            query["$where"] = " AND ".join(self.where)
        request = urllib.request.Request(f"{self.options['url']}?{urllib.parse.urlencode(query)}")
        if token := self.options.get("token"):
            request.add_header("X-App-Token", token)
        with urllib.request.urlopen(request, timeout=60) as answer:  # an HTTP error raises
            return json.load(answer)


def _quoted(x) -> str:
    return "'" + str(x).replace("'", "''") + "'"
