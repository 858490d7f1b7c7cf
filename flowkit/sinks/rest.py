"""Rows posted as JSON."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..errors import ConfigError
from ..sources.http import Client, Retry

NAME = "flowkit_rest_sink"
KEY = "Idempotency-Key"


def body(lines: list[str], form: str, wrap_in: str | None) -> bytes:
    """JSON records as one request body: an array, a wrapped array, or lines."""
    if form == "ndjson":
        return ("\n".join(lines) + "\n").encode()
    array = f"[{','.join(lines)}]"
    return (f"{{{json.dumps(wrap_in)}:{array}}}" if wrap_in else array).encode()


@dataclass
class _Posted(WriterCommitMessage):
    """What a partition posted."""

    rows: int
    chunks: int


class _Writer(DataSourceWriter):
    def __init__(self, config: dict):
        self.config = config

    def write(self, rows: Iterator) -> _Posted:
        c = self.config
        client = Client(Retry(**c["retry"]), c["timeout_ms"], c["share"], c["headers"])
        posted, part = _Posted(0, 0), TaskContext.get().partitionId()
        while chunk := [r[0] for r in islice(rows, c["rows_per_request"])]:
            sent = body(chunk, c["form"], c["wrap_in"])
            # a repeated task gives equal chunks equal keys; equal chunks of other places have keys of their own
            client.headers = c["headers"] | {KEY: hashlib.sha256(f"{c['write_id']} {part} {posted.chunks} ".encode() + sent).hexdigest()}
            client.send(c["method"], c["url"], c["query"], sent, c["kind"])
            posted = _Posted(posted.rows + len(chunk), posted.chunks + 1)
        return posted


class RestSink(DataSource):
    """Registered as NAME; options travel as one JSON text."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(json.loads(self.options["config"]))


def rest(
    df: DataFrame, url: str, method: str = "POST", headers: dict[str, str] | None = None, query: dict[str, str] | None = None, rows_per_request: int = 500, form: str = "json_array", wrap_in: str | None = None, retry: dict | None = None, rate_limit_per_second: float | None = None, timeout_ms: int = 30_000, write_id: str | None = None
) -> None:
    """Post all rows, ``rows_per_request`` at a time from each partition; null fields are written as null.

    A partition that is retried sends its requests again, each with the
    Idempotency-Key it had: a receiver that heeds keys takes each chunk once.
    Keys are of the write, the partition, the chunk's number and its content, so
    a retry whose rows come in another order has others. Give ``write_id`` to
    repeat a whole write that failed under the same keys. The rate is shared
    among the partitions.
    """
    if form not in ("json_array", "ndjson"):
        raise ConfigError("form must be json_array or ndjson")
    if wrap_in and form == "ndjson":
        raise ConfigError("lines cannot be wrapped")
    if rows_per_request < 1:
        raise ConfigError("rows_per_request must be 1 or more")
    lines = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))
    share = rate_limit_per_second / max(1, lines.rdd.getNumPartitions()) if rate_limit_per_second else None
    kind = "application/x-ndjson" if form == "ndjson" else "application/json"

    config = {"url": url, "method": method, "headers": headers or {}, "query": query, "rows_per_request": rows_per_request, "form": form, "wrap_in": wrap_in, "retry": retry or {}, "share": share, "timeout_ms": timeout_ms, "kind": kind, "write_id": write_id or uuid.uuid4().hex}
    df.sparkSession.dataSource.register(RestSink)
    lines.write.format(NAME).mode("append").option("config", json.dumps(config)).save()
