"""Paginated JSON over HTTP as a Spark data source.

Numbered pages with a known last page are read in parallel, a block of pages in
each partition. Unbounded pages, offsets and cursors depend on the answer
before, and are one partition.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..errors import ConfigError
from .http import Client, Retry

NAME = "flowkit_rest"
PAGES_PER_PARTITION = 8


def at_path(value: Any, path: str | None) -> Any:
    """The value at a dotted path; empty parts count for nothing. KeyError if it is not there."""
    for part in (path or "").split("."):
        if part:
            if not isinstance(value, dict) or part not in value:
                raise KeyError(part)
            value = value[part]
    return value


def records(body: bytes, path: str | None) -> tuple[list[dict], Any]:
    """The list of records at the path, and the whole answer; null is an empty list."""
    whole = json.loads(body)
    try:
        found = at_path(whole, path)
    except KeyError:
        raise ValueError(f"no {path!r} in the answer; it begins {body[:200]!r}") from None
    if found is None:
        return [], whole
    if not isinstance(found, list):
        raise ValueError(f"{path or 'the answer'!r} is no list; the answer begins {body[:200]!r}")
    return found, whole


class _Pages(InputPartition):
    def __init__(self, first: int, count: int | None):
        super().__init__((first, count))
        self.first, self.count = first, count


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, Any]):
        self.fields, self.options = schema, options
        self.pages = options.get("pagination") or {"type": "none"}

    def partitions(self) -> list[InputPartition]:
        first, most = self.pages.get("start", 1), self.pages.get("max_pages")
        if self.pages["type"] == "page" and most:
            return [_Pages(first + i, min(PAGES_PER_PARTITION, most - i)) for i in range(0, most, PAGES_PER_PARTITION)]
        return [_Pages(first, most)]

    def read(self, partition: _Pages) -> Iterator[tuple]:
        names = [(f.name, f.dataType) for f in self.fields]
        for batch in self.batches(partition):
            for record in batch:
                yield tuple(_fitting(record.get(n), t) for n, t in names)

    def batches(self, partition: _Pages) -> Iterator[list[dict]]:
        o, kind = self.options, self.pages["type"]
        rate = o.get("rate_limit_per_second")
        client = Client(Retry(**o.get("retry", {})), o.get("timeout_ms", 30_000), rate / len(self.partitions()) if rate else None, o.get("headers"))
        offset, cursor, sent = 0, None, 0
        while partition.count is None or sent < partition.count:
            extra = {"page": lambda: {self.pages["param"]: partition.first + sent}, "offset": lambda: {self.pages["param"]: offset}, "cursor": lambda: {self.pages["param"]: cursor} if cursor else {}, "none": dict}[kind]()
            found, whole = records(client.send(o.get("method", "GET"), o["url"], o.get("query", {}) | extra), o.get("records_path"))
            sent, offset = sent + 1, offset + len(found)
            if found:
                yield found
            if kind == "none" or kind in ("page", "offset") and not found:
                return
            if kind == "cursor":
                try:
                    cursor = at_path(whole, self.pages["next_path"])
                except KeyError:
                    return
                if cursor in (None, ""):
                    return


def _fitting(value: Any, kind: Any) -> Any:
    """JSON values as what the column type takes."""
    import datetime

    if value is None:
        return None
    name = kind.typeName()
    if name == "string":
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    if name in ("double", "float"):
        return float(value)
    if name == "date":
        return datetime.date.fromisoformat(value)
    if name == "timestamp_ntz":
        return datetime.datetime.fromisoformat(value).replace(tzinfo=None)
    return value


class RestSource(DataSource):
    """Registered as NAME; options travel as one JSON text."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, json.loads(self.options["config"]))


def rest(spark: SparkSession, url: str, schema: StructType | None = None, **options: Any) -> DataFrame:
    """Records of an API: method, headers, query, records_path, pagination, timeout_ms, rate_limit_per_second, retry.

    pagination is {type: none}, {type: page, param, start=1, max_pages},
    {type: offset, param, max_pages} or {type: cursor, param, next_path,
    max_pages}. Numbered and offset pages end at the first empty one, cursors
    when next_path is absent, null or empty. Without a schema it is inferred
    from the first page.
    """
    known = {"method", "headers", "query", "records_path", "pagination", "timeout_ms", "rate_limit_per_second", "retry"}
    if unknown := set(options) - known:
        raise ConfigError(f"unknown options: {', '.join(sorted(unknown))}")
    pages = options.get("pagination") or {"type": "none"}
    needs = {"none": (), "page": ("param",), "offset": ("param",), "cursor": ("param", "next_path")}
    if pages.get("type") not in needs or any(k not in pages for k in needs[pages["type"]]):
        raise ConfigError(f"pagination must be one of {needs}")
    config = options | {"url": url}
    if schema is None:
        reader = _Reader(StructType(), config)
        first = next(reader.batches(_Pages(pages.get("start", 1), 1)), [])
        schema = spark.read.json(spark.sparkContext.parallelize([json.dumps(r) for r in first], 1)).schema
    spark.dataSource.register(RestSource)
    return spark.read.format(NAME).schema(schema).option("config", json.dumps(config)).load()
