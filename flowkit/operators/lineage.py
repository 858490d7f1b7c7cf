"""Column lineage as joins over edge tables.

edges(pipeline, node, column, in_node, in_column, derivation, edge): column of
node comes from in_column of in_node; derivation is 0 copy, 1 computed, 2
aggregated, 3 unknown; edge is "direct" or "indirect" (the column only filters,
joins, groups or orders). A column without incoming edges is an origin.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..session import shared_dir

KEYS = ["pipeline", "node", "column"]
FROM = ["pipeline", "from_node", "from_column"]
#: Steps of a walk whose results are read one by one before they are put together.
STEPS = 8
#: Rows of either side of a join over chains that go to one task.
TASK_ROWS = 250_000
#: Where a chain, or a hop, ends: at a column with no hop in, with one, or with several.
ORIGIN, ONWARD, BRANCHING = 1, 0, 2


class _Folder:
    """Tables written to the folder that the cluster shares, each with a number that its rows add up to."""

    def __init__(self, spark):
        self.spark, self.path, self.n = spark, f"{shared_dir(spark)}/lineage-{uuid.uuid4().hex[:12]}", 0

    def write(self, df: DataFrame, number: Column | None = None) -> tuple[DataFrame, int]:
        self.n += 1
        seen = Observation()
        number = F.count(F.lit(1)) if number is None else F.coalesce(F.sum(number), F.lit(0))
        df.observe(seen, number.alias("number")).write.parquet(f"{self.path}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{self.n}"), seen.get["number"]


def _parts(rows: int) -> int:
    return rows // TASK_ROWS + 1


def _joined(left: DataFrame, right: DataFrame, on: list[str], how: str, parts: int) -> DataFrame:
    """A join dealt out to ``parts`` tasks, so that each holds some TASK_ROWS of either side, whatever their bytes say."""
    return left.repartition(parts, *on).join(right.repartition(parts, *on).hint("merge"), on, how)


def _from(columns: DataFrame, *others: Column) -> DataFrame:
    """Columns (KEYS) as those that a hop comes from."""
    return columns.select("pipeline", F.col("node").alias("from_node"), F.col("column").alias("from_column"), *others)


def _chained(hops: DataFrame, values: dict, folder: _Folder, parts: int, cyclic: bool = False) -> tuple[DataFrame, DataFrame]:
    """Columns with one hop in, each with the end of its chain; and the hops of the others, from such ends.

    (KEYS, from_node, from_column, values, end): a chain goes up from a column
    while there is one hop in, to a column with none (``end`` ORIGIN) or several
    (BRANCHING). Each round doubles the hops that a row covers, so a chain of n
    takes the logarithm of n rounds. Only rows that are not at an end yet
    (ONWARD) go on, and only they are joined: rows that have met at one origin
    never come together in a task. ``values`` says how what two stretches carry
    is put together. Chains that end in a cycle come from nowhere and are
    dropped, unless ``cyclic``: they then carry what the whole cycle does.
    """
    hops = hops.repartition(parts, *KEYS).distinct()
    several = hops.groupBy(*KEYS).agg((F.count("*") > 1).alias("several"))
    above = _from(several, F.when(F.col("several"), F.lit(BRANCHING)).otherwise(F.lit(ONWARD)).alias("above"))
    known = _joined(hops.join(several.hint("merge"), KEYS), above, FROM, "left", parts)
    known, n = folder.write(known.select(*KEYS, *FROM[1:], *values, F.coalesce("above", F.lit(ORIGIN)).alias("end"), "several"), (~F.col("several") & F.col("end").eqNullSafe(F.lit(ONWARD))).cast("int"))
    front = known.filter("not several").drop("several")
    chains, front = front.filter(F.col("end") != ONWARD), front.filter(F.col("end") == ONWARD)

    def further(rows: DataFrame, up: DataFrame, how: str) -> DataFrame:
        up = _from(up, F.struct(*FROM[1:], *values, "end").alias("up"))
        here = _joined(rows, up, FROM, how, parts)
        moved = [F.coalesce(F.col(f"up.{c}"), c).alias(c) for c in FROM[1:]]
        carried = [F.when(F.col("up").isNull(), F.col(c)).otherwise(put(F.col(c), F.col(f"up.{c}"))).alias(c) for c, put in values.items()]
        return here.select(*KEYS, *moved, *carried, F.coalesce("up.end", "end").alias("end"))

    for _ in range(n.bit_length() + 1):
        if not n:
            break
        moved, n = folder.write(further(front, chains.union(front), "inner"), (F.col("end") == ONWARD).cast("int"))
        chains, front = chains.union(moved.filter(F.col("end") != ONWARD)), moved.filter(F.col("end") == ONWARD)
    chains = chains.union(front) if cyclic else chains
    branching = known.filter("several").drop("several")
    on = branching.filter(F.col("end") == ONWARD)
    return chains, folder.write(branching.filter(F.col("end") != ONWARD).union(further(on, chains, "left")))[0]


def _walk(first: DataFrame, hop: DataFrame, key: list[str], stepped: dict[str, Column], best: Column, better: str, folder: _Folder) -> DataFrame:
    """Everything that ``first`` reaches along ``hop``, a join a hop: ``key`` and the best ``value``.

    A row of first is a column (KEYS) with what it carries; ``stepped`` says what
    is carried on over a hop, whose own columns are called k and d. Each step
    goes on from what is new, or now ``better`` than it ``was``. Cycles end when
    nothing is. Every STEPS steps what is known is put together.
    """

    def known(tables: list[DataFrame]) -> DataFrame:
        every = tables[0]
        for t in tables[1:]:
            every = every.union(t)
        return every.groupBy(*key).agg(best.alias("value"))

    front, rows = folder.write(first.groupBy(*key).agg(best.alias("value")))
    tables = [front]
    while rows:
        here = front.withColumnsRenamed({"node": "from_node", "column": "from_column"})
        there = here.join(hop, FROM).select(*KEYS, *(c.alias(n) for n, c in stepped.items()))
        there = there.groupBy(*key).agg(best.alias("value"))
        front, rows = folder.write(there.join(known(tables).withColumnRenamed("value", "was"), key, "left").filter(f"was is null or {better}").drop("was").select(front.columns))
        tables.append(front)
        if len(tables) > STEPS:
            tables = [folder.write(known(tables).select(front.columns))[0]]
    return known(tables)


def _hops(edges: DataFrame) -> DataFrame:
    return edges.select(*KEYS, F.col("in_node").alias("from_node"), F.col("in_column").alias("from_column"), (F.col("edge") == "indirect").cast("int").alias("k"), F.col("derivation").alias("d"))


def _derived(hops: DataFrame, origin: Column | None = None) -> DataFrame:
    """(KEYS, in_node, in_column, kind, derivation): the origins of columns, or of those that come from ``origin`` that one.

    A path's derivation is its largest, its kind 1 as soon as one hop is
    indirect. Chains are contracted first; what is walked then is the columns
    with several hops in, from origins, so that pairs of two columns in between
    are never made.
    """
    folder = _Folder(hops.sparkSession)
    hops, n = folder.write(hops)
    chains, branching = _chained(hops, {"k": F.greatest, "d": F.greatest}, folder, _parts(n))
    first = branching.filter(F.col("end") == ORIGIN).withColumns({"in_node": F.col("from_node"), "in_column": F.col("from_column")})
    ended = chains.filter(F.col("end") == ORIGIN).select(*KEYS, F.col("from_node").alias("in_node"), F.col("from_column").alias("in_column"), F.col("k").alias("kind"), F.col("d").alias("derivation"))
    if origin is not None:
        first, ended = first.filter(origin), ended.filter(origin)
    if branching.isEmpty():
        return ended
    start = first.select(*KEYS, "in_node", "in_column", F.col("k").alias("kind"), F.col("d").alias("value"))
    stepped = {"in_node": F.col("in_node"), "in_column": F.col("in_column"), "kind": F.greatest("kind", "k"), "value": F.greatest("value", "d")}
    walked = _walk(start, branching, [*KEYS, "in_node", "in_column", "kind"], stepped, F.max("value"), "value > was", folder)
    walked = folder.write(walked.withColumnRenamed("value", "derivation"))[0]
    below = chains.filter(F.col("end") == BRANCHING).join(walked.withColumnsRenamed({"node": "from_node", "column": "from_column"}), FROM)
    below = below.select(*KEYS, "in_node", "in_column", F.greatest("kind", "k").alias("kind"), F.greatest("derivation", "d").alias("derivation"))
    return ended.union(walked.select(ended.columns)).union(below)


def resolve(edges: DataFrame) -> DataFrame:
    """(pipeline, node, column, in_node, in_column, derivation): every column's origins over direct edges."""
    return _derived(_hops(edges.filter("edge = 'direct'"))).drop("kind")


def indirect(edges: DataFrame) -> DataFrame:
    """(pipeline, node, column, in_node, in_column): origins that reach a column through an indirect edge."""
    return _derived(_hops(edges)).filter("kind = 1").select(*KEYS, "in_node", "in_column")


def normalised_path(path):
    """Paths with doubled and trailing slashes and "." parts removed."""
    path = F.regexp_replace(F.regexp_replace(path, r"/(\./)+", "/"), "/+", "/")
    return F.regexp_replace(F.regexp_replace(path, r"^\./", ""), "(?<=.)/$", "")


def file_edges(sinks: DataFrame, sources: DataFrame) -> DataFrame:
    """Copy edges from a sink's columns to a source that reads its file, in any pipeline.

    sinks and sources (pipeline, node, column, path). The result carries
    in_pipeline; ``across`` folds it into the node names.
    """
    wrote = sinks.select(F.col("pipeline").alias("in_pipeline"), F.col("node").alias("in_node"), "column", normalised_path(F.col("path")).alias("p"))
    reads = sources.select("pipeline", "node", "column", normalised_path(F.col("path")).alias("p"))
    joined = reads.join(wrote, ["p", "column"])
    return joined.select("pipeline", "node", "column", "in_pipeline", "in_node", F.col("column").alias("in_column"), F.lit(0).alias("derivation"), F.lit("direct").alias("edge"))


def across(edges: DataFrame, files: DataFrame) -> DataFrame:
    """All pipelines as one graph: nodes are named pipeline:node."""
    full = lambda p, n: F.concat(F.col(p).cast("string"), F.lit(":"), F.col(n).cast("string"))
    inside = edges.select(F.lit("").alias("pipeline"), full("pipeline", "node").alias("node"), "column", full("pipeline", "in_node").alias("in_node"), "in_column", "derivation", "edge")
    between = files.select(F.lit("").alias("pipeline"), full("pipeline", "node").alias("node"), "column", full("in_pipeline", "in_node").alias("in_node"), "in_column", "derivation", "edge")
    return inside.unionByName(between)


def impact(edges: DataFrame, in_node, in_column) -> DataFrame:
    """(pipeline, node, column, derivation, kind): what is derived from, or indirectly uses, a column.

    Hops into the column itself are left out, so that it counts as an origin:
    of itself, by way of a cycle, it is not said to be derived.
    """
    here = (F.col("node") == in_node) & (F.col("column") == in_column)
    hops = _hops(edges).filter(~here)
    return _derived(hops, (F.col("in_node") == in_node) & (F.col("in_column") == in_column)).select(*KEYS, "kind", "derivation")


def unknown_at(edges: DataFrame) -> DataFrame:
    """(pipeline, node, column, unknown_at): the first node, by name, at which a column's chain is cut."""
    folder = _Folder(edges.sparkSession)
    edges, n = folder.write(edges.select(*KEYS, F.col("in_node").alias("from_node"), F.col("in_column").alias("from_column"), (F.col("edge") == "direct").alias("direct"), (F.col("derivation") == 3).alias("cut")))
    parts = _parts(n)
    cuts = edges.filter("cut").select(*KEYS, F.col("node").alias("value")).repartition(parts, *KEYS).distinct()
    hops = edges.filter("direct").select(*KEYS, *FROM[1:]).repartition(parts, *KEYS).distinct()
    # a hop carries the cut of the column that it leads to and of the one that it comes from
    hops = _joined(hops.join(cuts.hint("merge"), KEYS, "left"), _from(cuts, F.col("value").alias("above")), FROM, "left", parts)
    hops = hops.select(*KEYS, *FROM[1:], F.least("value", "above").alias("value"))
    chains, branching = _chained(hops, {"value": F.least}, folder, parts, cyclic=True)
    carried = branching.select(*KEYS, *FROM[1:], F.col("value").alias("d"))
    walked = _walk(branching.select(*KEYS, "value").filter("value is not null"), carried, KEYS, {"value": F.least("value", "d")}, F.min("value"), "value < was", folder)
    walked = folder.write(walked)[0]
    above = _from(walked, F.col("value").alias("above"))
    below = chains.filter(F.col("end") == BRANCHING).join(above, FROM, "left").select(*KEYS, F.least("value", "above").alias("value"))
    every = cuts.union(walked.select(cuts.columns)).union(chains.filter(F.col("end") != BRANCHING).select(cuts.columns)).union(below).filter("value is not null")
    return every.repartition(parts, *KEYS).groupBy(*KEYS).agg(F.min("value").alias("unknown_at"))
