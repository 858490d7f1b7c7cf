"""User code as operators: batch transforms through Arrow, and a registry of sources, transforms and sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any, Protocol

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..schema import require
from .basic import name


class Plugin(Protocol):
    """A batch transform: made from a config, fed batches, asked for the rest at the end."""

    def process(self, batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]: ...

    def finish(self) -> Iterable[pa.RecordBatch]: ...


def batch_udf(df: DataFrame, plugin: Callable[[dict], Plugin], config: dict[str, Any], schema: str | None = None, scope: str = "partition", keys: list[str] | None = None) -> DataFrame:
    """``plugin`` over the batches of ``df``; ``schema`` is the result's, by default the input's.

    Its state lives for a partition. With scope "key" the rows of a key meet in
    one partition; with "global" there is one partition, which does not scale.
    The config is tried on the driver, so a bad one fails before anything runs.
    """
    if scope not in ("partition", "key", "global") or (scope == "key") != bool(keys):
        raise ConfigError('scope is "partition", "global", or "key" with keys')
    try:
        plugin(config)
    except Exception as e:
        raise ConfigError(f"plugin rejects its config: {e}") from e
    if scope == "key":
        require(df, keys)
        df = df.repartition(*map(name, keys))
    elif scope == "global":
        df = df.repartition(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = plugin(config)
        for batch in batches:
            yield from state.process(batch)
        yield from state.finish()

    return df.mapInArrow(run, schema or df.schema)


class Identity:
    """Gives back what it gets."""

    def __init__(self, config: dict):
        if config:
            raise ValueError(f"no option is known, got {', '.join(config)}")

    def process(self, batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        return [batch]

    def finish(self) -> Iterable[pa.RecordBatch]:
        return []


class UpperCase:
    """Upper-cases the text column ``column``; nulls stay."""

    def __init__(self, config: dict):
        if set(config) != {"column"}:
            raise ValueError("the option is column")
        self.column = config["column"]

    def process(self, batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        at = batch.schema.get_field_index(self.column)
        return [pa.RecordBatch.from_arrays([pc.utf8_upper(c) if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)]

    def finish(self) -> Iterable[pa.RecordBatch]:
        return []


def upper(df: DataFrame, column: str) -> DataFrame:
    """The same natively."""
    require(df, [column])
    return df.withColumn(column, F.upper(name(column)))


class Registry:
    """Names for sources (spark, config) -> df, transforms (inputs, config) -> df and sinks (df, config) -> None."""

    def __init__(self) -> None:
        self.kinds: dict[str, dict[str, Callable]] = {"source": {}, "transform": {}, "sink": {}}

    def add(self, kind: str, label: str, made: Callable) -> None:
        """Register; a name that is taken cannot be taken again."""
        if kind not in self.kinds:
            raise ConfigError(f"kind must be one of {', '.join(self.kinds)}")
        if label in self.kinds[kind]:
            raise ConfigError(f"{kind} {label!r} exists already")
        self.kinds[kind][label] = made

    def add_plugin(self, label: str, plugin: Callable[[dict], Plugin], schema: str | None = None) -> None:
        """Register a plugin as a transform of one input."""

        def transform(inputs: dict[str, DataFrame], config: dict) -> DataFrame:
            if len(inputs) != 1:
                raise ConfigError(f"{label} takes one input")
            return batch_udf(next(iter(inputs.values())), plugin, config, schema)

        self.add("transform", label, transform)

    def find(self, kind: str, label: str) -> Callable:
        if label not in self.kinds[kind]:
            raise ConfigError(f"no {kind} {label!r}; there are {', '.join(sorted(self.kinds[kind]))}")
        return self.kinds[kind][label]
