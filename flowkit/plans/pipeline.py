"""Pipelines: a graph of sources, transforms and sinks as lazy DataFrames, and runs with a report.

Building a pipeline is validating it: Spark analyses every DataFrame at once,
so absent columns, inputs of different shapes and broken SQL fail before any
row is read. A whole pipeline is one plan for Catalyst: filters and projections
reach the scans through any number of nodes.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter
from pathlib import PurePosixPath
from typing import Any

import yaml
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..operators import basic, plugins
from ..schema import declared
from ..sinks import files as sink_files
from ..sinks import jdbc as sink_jdbc
from ..sinks import rest as sink_rest
from ..sources import files, jdbc, rest
from . import steps


def _one(inputs: dict[str, DataFrame], op: str) -> DataFrame:
    if len(inputs) != 1:
        raise ConfigError(f"{op} takes one input, not {len(inputs)}")
    return next(iter(inputs.values()))


def _given(function: Callable, config: dict, *first: Any) -> Any:
    """Call with the config as keywords; unknown or missing ones are the config's fault."""
    import inspect

    try:
        inspect.signature(function).bind(*first, **config)
    except TypeError as e:
        raise ConfigError(str(e)) from None
    return function(*first, **config)


def _rest(spark: SparkSession, schema: list[dict] | None = None, **config: Any) -> DataFrame:
    return _given(rest.rest, config | {"schema": declared(schema) if schema else None}, spark)


def _sql(inputs: dict[str, DataFrame], query: str, table: str = "input", memory_limit_mb: int | None = None) -> DataFrame:
    return basic.sql(inputs, query, table)  # Spark spills; a node has no memory limit of its own


def _filter(df: DataFrame, where: str) -> DataFrame:
    return basic.where(df, where)


def standard_registry() -> plugins.Registry:
    """The built-in components by name."""
    r = plugins.Registry()
    for label, made in (("csv", files.csv), ("parquet", files.parquet), ("generator", files.generator), ("jdbc", jdbc.jdbc), ("rest", _rest)):
        r.add("source", label, lambda spark, config, made=made: _given(made, config, spark))
    for label, made in (("select", basic.select), ("rename", basic.rename), ("limit", basic.limit)):
        r.add("transform", label, lambda inputs, config, made=made: _given(made, config, basic.stack(inputs)))
    for label, made in (("filter", _filter), ("derive", basic.derive), ("aggregate", basic.aggregate)):
        r.add("transform", label, lambda inputs, config, made=made, label=label: _given(made, config, _one(inputs, label)))
    r.add("transform", "sql", lambda inputs, config: _given(_sql, config, inputs))
    r.add_plugin("identity", plugins.Identity)
    r.add_plugin("upper_case", plugins.UpperCase)
    for label, made in (("csv", sink_files.csv), ("parquet", sink_files.parquet), ("null", sink_files.null), ("jdbc", sink_jdbc.jdbc), ("rest", sink_rest.rest)):
        r.add("sink", label, lambda df, config, made=made: _given(made, config, df))
    return r


@dataclass
class Node:
    id: str
    type: str
    component: str
    config: dict[str, Any] = field(default_factory=dict)
    after: list[str] = field(default_factory=list)


@dataclass
class Edge:
    source: str
    target: str
    port: str


@dataclass
class NodeReport:
    node: str
    kind: str
    component: str
    position: int
    status: str
    rows_in: int | None = None
    rows_out: int | None = None
    elapsed_ms: int | None = None
    error: str | None = None


@dataclass
class RunReport:
    pipeline: str
    nodes: list[NodeReport]

    @property
    def succeeded(self) -> bool:
        return all(n.status == "succeeded" for n in self.nodes)

    def to_frame(self, spark: SparkSession, run_id: str) -> DataFrame:
        """The report as rows of a node_runs table."""
        schema = "run_id string, node string, kind string, component string, position int, status string, rows_in long, rows_out long, elapsed_ms long, error string"
        return spark.createDataFrame([(run_id, n.node, n.kind, n.component, n.position, n.status, n.rows_in, n.rows_out, n.elapsed_ms, n.error) for n in self.nodes], schema)


def _texts(config: Any) -> Iterator[str]:
    """Every text in a node's settings."""
    if isinstance(config, str):
        yield config
    elif isinstance(config, dict | list):
        for x in config.values() if isinstance(config, dict) else config:
            yield from _texts(x)


class Pipeline:
    """A checked graph. ``tables`` gives DataFrames to sources of the component "table"."""

    def __init__(self, spec: dict[str, Any], registry: plugins.Registry | None = None, base: str | None = None, tables: dict[str, DataFrame] | None = None):
        if unknown := set(spec) - {"version", "name", "description", "nodes", "edges", "settings", "schedule", "alerts", "layout"}:
            raise ConfigError(f"unknown keys: {', '.join(sorted(unknown))}")
        self.name, self.registry, self.tables = spec.get("name", "pipeline"), registry or standard_registry(), tables or {}
        self.nodes = {}
        for n in spec.get("nodes") or []:
            node = Node(n["id"], n["type"], n.get("connector") or n.get("op") or n.get("plugin", ""), dict(n.get("config") or {}), list(n.get("after") or []))
            if node.id in self.nodes:
                raise ConfigError(f"two nodes are called {node.id!r}")
            if base and "path" in node.config and "://" not in node.config["path"]:
                node.config["path"] = str(PurePosixPath(base) / node.config["path"])
            self.nodes[node.id] = node
        self.edges = [Edge(e["from"], e["to"], e.get("port") or e["from"]) for e in spec.get("edges") or []]
        self.order = self._checked()

    @classmethod
    def from_yaml(cls, text: str, base: str | None = None, **more: Any) -> Pipeline:
        """From YAML text; relative paths are taken from the folder ``base``."""
        return cls(yaml.safe_load(text), base=base, **more)

    def _checked(self) -> list[str]:
        if not self.nodes:
            raise ConfigError("a pipeline needs a node")
        pairs, ports = set(), set()
        for e in self.edges:
            for end in (e.source, e.target):
                if end not in self.nodes:
                    raise ConfigError(f"an edge names {end!r}, which is no node")
            if e.source == e.target:
                raise ConfigError(f"{e.source!r} feeds itself")
            if (e.source, e.target) in pairs:
                raise ConfigError(f"two edges lead from {e.source!r} to {e.target!r}")
            if (e.target, e.port) in ports:
                raise ConfigError(f"two inputs of {e.target!r} are called {e.port!r}")
            pairs.add((e.source, e.target))
            ports.add((e.target, e.port))
        fed, feeds = {e.target for e in self.edges}, {e.source for e in self.edges}
        for n in self.nodes.values():
            if n.type not in ("source", "transform", "sink"):
                raise ConfigError(f"{n.id!r} has the unknown type {n.type!r}")
            if n.type == "source" and n.id in fed:
                raise ConfigError(f"source {n.id!r} has an input")
            if n.type == "sink" and n.id in feeds:
                raise ConfigError(f"sink {n.id!r} has an output")
            if n.type != "source" and n.id not in fed:
                raise ConfigError(f"{n.id!r} has no input")
            if n.type != "sink" and n.id not in feeds:
                raise ConfigError(f"the output of {n.id!r} is not used")
            if absent := [a for a in n.after if a not in self.nodes]:
                raise ConfigError(f"{n.id!r} waits for {', '.join(absent)}, which is no node")
            if not (n.type == "source" and n.component == "table"):
                self.registry.find(n.type, n.component)
        before = {i: {e.source for e in self.edges if e.target == i} | set(n.after) for i, n in self.nodes.items()}
        try:
            return list(TopologicalSorter(before).static_order())
        except CycleError as e:
            raise ConfigError(f"nodes form a cycle: {' -> '.join(e.args[1])}") from None

    def inputs(self, node: str, frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
        return {e.port: frames[e.source] for e in self.edges if e.target == node}

    def made(self, spark: SparkSession, node: str, frames: dict[str, DataFrame]) -> DataFrame:
        """The DataFrame of a source or transform."""
        n = self.nodes[node]
        try:
            if n.type == "source" and n.component == "table":
                return basic.select(self.tables[n.config["name"]], n.config["columns"]) if "columns" in n.config else self.tables[n.config["name"]]
            if n.type == "source":
                return self.registry.find("source", n.component)(spark, n.config)
            return self.registry.find("transform", n.component)(self.inputs(node, frames), n.config)
        except ConfigError as e:
            raise ConfigError(f"node {node!r}: {e}") from e

    def build(self, spark: SparkSession) -> dict[str, DataFrame]:
        """All nodes lazily; for a sink, the rows that it would write. Sources behind a barrier must exist already."""
        frames: dict[str, DataFrame] = {}
        for i in self.order:
            frames[i] = basic.stack(self.inputs(i, frames)) if self.nodes[i].type == "sink" and self.nodes[i].component != "null" else frames.get(i) if self.nodes[i].type == "sink" else self.made(spark, i, frames)
        return {k: v for k, v in frames.items() if v is not None}

    def lineage(self, spark: SparkSession) -> DataFrame:
        """One-hop column edges of every node, as ``operators.lineage`` takes them. Nothing is read but schemas."""
        frames, found = self.build(spark), []
        for i in self.order:
            n = self.nodes[i]
            ins = {e.port: (e.source, frames[e.source]) for e in self.edges if e.target == i}
            out = frames[i].columns if i in frames else None
            found += [(self.name, i, *edge) for edge in steps.edges(n.component if n.type == "transform" else n.type, n.config, ins, out)]
        return spark.createDataFrame(sorted(set(found)), steps.SCHEMA)

    def _doomed(self, node: str, failed: dict[str, str]) -> str | None:
        """The failed or skipped node that this one needs, if any."""
        need = [e.source for e in self.edges if e.target == node] + self.nodes[node].after
        return next((x for x in need if x in failed), None)

    def _above(self, node: str) -> set[str]:
        """The nodes whose rows reach this one."""
        found = {e.source for e in self.edges if e.target == node}
        for i in reversed(self.order):
            if i in found:
                found |= {e.source for e in self.edges if e.target == i}
        return found

    def _at_fault(self, node: str, error: Exception) -> str:
        """The node that an error in a node's job comes from: the first transform above with the SQL that Spark names, at the place it names."""
        contexts = [c for c in error.getQueryContext() or [] if c.contextType().name == "SQL" and c.fragment()] if isinstance(error, PySparkException) else []
        above = self._above(node)
        for i in self.order:
            if i in above and self.nodes[i].type == "transform":
                for text in _texts(self.nodes[i].config):
                    if any(text.startswith(c.fragment(), max(c.startIndex(), 0)) for c in contexts):
                        return i
        return node

    def run(self, spark: SparkSession) -> RunReport:
        """Run every sink in order. A node that fails, and what needs it, leaves other branches alone.

        Nodes with several consumers are kept in memory or on disk until the
        last sink has run. Row counts are what the sinks' jobs pulled through. A
        sink's job that fails in the SQL of a node before it counts against that
        node; errors without a place in any SQL count against the sink.
        """
        frames: dict[str, DataFrame] = {}
        bad: dict[str, str] = {}
        watch: dict[str, Observation] = {}
        reports: dict[str, NodeReport] = {}
        kept: list[DataFrame] = []
        sinks = [i for i in self.order if self.nodes[i].type == "sink"]
        for at, i in enumerate(self.order):
            n = self.nodes[i]
            reports[i] = NodeReport(i, n.type, n.component, at, "succeeded")
            if cause := self._doomed(i, bad):
                bad[i], reports[i].status, reports[i].error = "skipped", "skipped", f"{cause} {bad[cause]}"
                continue
            began = time.monotonic()
            try:
                if n.type != "sink":
                    df = self.made(spark, i, frames)
                    watch[i] = Observation(f"{i}-{id(self)}-{at}")
                    df = df.observe(watch[i], F.count(F.lit(1)).alias("rows"))
                    if sum(e.source == i for e in self.edges) > 1 and len(sinks) > 1:
                        df = df.persist()
                        kept.append(df)
                    frames[i] = df
                else:
                    ins = self.inputs(i, frames)
                    sink = self.registry.find("sink", n.component)
                    if n.component == "null":
                        for df in ins.values():
                            sink(df, n.config)
                    else:
                        df = basic.stack(ins)
                        sink(df, n.config)
                    reports[i].elapsed_ms = round((time.monotonic() - began) * 1000)
            except Exception as e:
                at_fault = self._at_fault(i, e)
                bad[at_fault], reports[at_fault].status, reports[at_fault].error = "failed", "failed", (str(e).splitlines() or [type(e).__name__])[0][:500]
                for x in self.order[: at + 1]:  # a sink's job failed in a node before it: what lies between made nothing
                    if x in reports and reports[x].status == "succeeded" and x != at_fault and self._doomed(x, bad) and (x == i or self.nodes[x].type != "sink"):
                        bad[x], reports[x].status, reports[x].error = "skipped", "skipped", f"{at_fault} failed"
        for df in kept:
            df.unpersist()
        self._tell(reports, bad, watch)
        return RunReport(self.name, list(reports.values()))

    def _tell(self, reports: dict[str, NodeReport], bad: dict[str, str], watch: dict[str, Observation]) -> None:
        ran = {e.source for e in self.edges if e.target not in bad and self.nodes[e.target].type == "sink"}
        for i in reversed(self.order):  # what feeds a node that ran has run
            if i in ran:
                ran |= {e.source for e in self.edges if e.target == i}
        read = {x for i in bad if bad[i] == "failed" and self.nodes[i].type == "transform" for x in self._above(i)}  # until it failed
        for i, r in reports.items():
            if i in watch and i in ran:
                r.rows_out = watch[i].get.get("rows", 0)
            elif i in watch and r.status == "succeeded" and i not in read:
                r.status, r.error = "skipped", "no sink of it ran"
        for e in self.edges:
            if reports[e.source].rows_out is not None:
                reports[e.target].rows_in = (reports[e.target].rows_in or 0) + reports[e.source].rows_out
