"""Where a node's columns come from, one hop back, from plans over empty inputs that Spark has analysed."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import basic
from .traces import AGGREGATED, COMPUTED, COPY, UNKNOWN, attributes_read, trace

SCHEMA = "pipeline string, node string, column string, in_node string, in_column string, derivation int, edge string"

Inputs = dict[str, tuple[str, DataFrame]]
Step = tuple[str, str, str, int, str]


def _empty(df: DataFrame) -> DataFrame:
    """No rows and df's columns."""
    return df.sparkSession.createDataFrame([], df.schema)


def read_by(df: DataFrame, *expressions: str) -> list[str]:
    """The columns of df that SQL expressions read; none for ``count(*)``."""
    df = _empty(df)
    leaf = df._jdf.queryExecution().analyzed()
    read = attributes_read(df.select(*map(F.expr, expressions))._jdf.queryExecution().analyzed(), leaf)
    output = leaf.output()
    return list(dict.fromkeys(c for i, c in enumerate(df.columns) if output.apply(i).exprId().id() in read))


def _is_column(df: DataFrame, expression: str) -> bool:
    return expression.strip().strip("`").lower() in {c.lower() for c in df.columns}


def _copies(ins: Inputs, names: dict[str, str]) -> Iterator[Step]:
    """Output names with the input columns that they copy, from every stacked input."""
    for new, old in names.items():
        for source, _ in ins.values():
            yield new, source, old, COPY, "direct"


def _values(column: str, ins: Inputs, reads: list[tuple[str, str]], derivation: int) -> Iterator[Step]:
    for port, old in reads:
        yield column, ins[port][0], old, derivation, "direct"


def _decides(out: list[str], ins: Inputs, reads: list[tuple[str, str]]) -> Iterator[Step]:
    """Columns that decide about rows reach every output indirectly."""
    for column in out:
        for port, old in reads:
            yield column, ins[port][0], old, COPY, "indirect"


def _expressions(kind: str, config: dict, ins: Inputs, out: list[str]) -> Iterator[Step]:
    """A node with one input: filter, derive or aggregate."""
    (port, (_, df)), made = next(iter(ins.items())), {}
    at = lambda columns: [(port, c) for c in columns]
    if kind == "filter":
        yield from _decides(out, ins, at(read_by(df, config["where"])))
        kept = out
    elif kind == "derive":
        made, kept = config["columns"], df.columns
    else:
        made, kept = config["aggregates"], config.get("group_by") or []
        yield from _decides(out, ins, at(kept))
    yield from _copies(ins, {c: c for c in kept})
    for column, expression in made.items():
        derivation = AGGREGATED if kind == "aggregate" else COPY if _is_column(df, expression) else COMPUTED
        yield from _values(column, ins, at(read_by(df, expression)), derivation)


def _query(config: dict, ins: Inputs) -> Iterator[Step]:
    """Free SQL, by the analysed plan. A column may come directly from a column and be decided by it too."""
    frames = {port: _empty(df) for port, (_, df) in ins.items()}
    lone = config.get("table", "input")
    views = {port: df.columns for port, df in frames.items()}
    if len(frames) == 1:
        views.setdefault(lone, next(iter(views.values())))
    port_of = {v: v if v in frames else next(iter(frames)) for v in views}
    df = basic.sql(frames, config["query"], lone)
    found = trace(df, views)
    yield from _decides(df.columns, ins, sorted({(port_of[v], c) for v, c in found.decides}))
    for column, origins in zip(df.columns, found.columns, strict=True):
        for (view, old), derivation in origins.items():
            yield column, ins[port_of[view]][0], old, derivation, "direct"


def edges(kind: str, config: dict, ins: Inputs, out: list[str] | None) -> Iterator[Step]:
    """(column, in_node, in_column, derivation, edge) of a node with the columns ``out``.

    ``kind`` is the transform's name, "source" or "sink"; ``ins`` gives by port the
    node it comes from and its DataFrame. A sink without columns of its own has
    those of its inputs. Plugins and unknown transforms: every column may come from every one.
    """
    if kind == "source":
        return
    if kind == "sink" and out is None:
        for port, (source, df) in ins.items():
            yield from _copies({port: (source, df)}, {c: c for c in df.columns})
    elif kind in ("select", "limit", "sink"):
        yield from _copies(ins, {c: c for c in out})
    elif kind == "rename":
        yield from _copies(ins, {config["columns"].get(c, c): c for c in next(iter(ins.values()))[1].columns})
    elif kind in ("filter", "derive", "aggregate"):
        yield from _expressions(kind, config, ins, out)
    elif kind == "sql":
        yield from _query(config, ins)
    else:
        every = [(port, c) for port, (_, df) in ins.items() for c in df.columns]
        for column in out:
            yield from _values(column, ins, every, UNKNOWN)
