import subprocess
import sys
from pathlib import Path

import pytest

from flowkit.errors import ConfigError
from flowkit.operators import lineage, plugins
from flowkit.plans import steps as columns
from flowkit.plans.pipeline import Pipeline, standard_registry

BUOYS = "buoy,coast,depth\n4,west,12.5\n9,east,3\n12,west,40\n30,south,8\n"
WAVES = "at,at_buoy,metres,sensor\n100,4,1.25,good\n101,4,9.5,worn\n102,12,2.5,good\n103,77,0.5,good\n104,9,0.75,good\n105,12,3,good\n"
JOIN = """
version: 1
name: waves by coast
nodes:
  - {id: buoys, type: source, connector: csv, config: {path: buoys.csv}}
  - {id: waves, type: source, connector: csv, config: {path: waves.csv}}
  - {id: trusted, type: transform, op: filter, config: {where: "sensor = 'good'"}}
  - id: joined
    type: transform
    op: sql
    config:
      memory_limit_mb: 256
      query: SELECT b.coast, count(DISTINCT b.buoy) AS buoys, max(w.metres) AS highest, avg(w.metres) AS mean FROM b JOIN w ON b.buoy = w.at_buoy GROUP BY b.coast
  - {id: out, type: sink, connector: csv, config: {path: out, single_file: true}}
edges:
  - {from: buoys, to: joined, port: b}
  - {from: waves, to: trusted}
  - {from: trusted, to: joined, port: w}
  - {from: joined, to: out}
"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "buoys.csv").write_text(BUOYS)
    (tmp_path / "waves.csv").write_text(WAVES)
    return str(tmp_path)


def nodes(*specs):
    return [dict(zip(("id", "type", "op", "config"), (*s, {}), strict=False)) for s in specs]


def edges(*pairs):
    return [{"from": a, "to": b} for a, b in pairs]


def test_join_pipeline(spark, folder, rows):
    p = Pipeline.from_yaml(JOIN, base=folder)
    assert rows(p.build(spark)["joined"]) == [("east", 1, 0.75, 0.75), ("west", 2, 3.0, 2.25)]
    report = p.run(spark)
    by = {n.node: n for n in report.nodes}
    assert report.succeeded and by["waves"].rows_out == 6 and by["trusted"].rows_out == 5 and by["joined"].rows_in == 9 and by["out"].rows_in == 2
    assert spark.read.csv(f"{folder}/out", header=True).count() == 2
    assert report.to_frame(spark, "r1").filter("kind = 'sink'").first().rows_in == 2


G = ("g", "source", "generator", {"rows": 10})


@pytest.mark.parametrize(
    "n, e, what",
    [
        ([], [], "needs a node"),
        (nodes(G, G), [], "two nodes"),
        (nodes(G, ("s", "sink", "null")), edges(("g", "s"), ("g", "s")), "two edges"),
        (nodes(G, ("s", "sink", "null")), edges(("g", "x")), "no node"),
        (nodes(G, ("s", "sink", "null")), edges(("g", "g"), ("g", "s")), "feeds itself"),
        (nodes(G, ("h", "source", "generator", {"rows": 1}), ("s", "sink", "null")), edges(("g", "h"), ("h", "s")), "has an input"),
        (nodes(G, ("s", "sink", "null"), ("t", "sink", "null")), edges(("g", "s"), ("s", "t")), "has an output"),
        (nodes(G), [], "not used"),
        (nodes(G, ("a", "transform", "identity"), ("b", "transform", "identity"), ("s", "sink", "null")), edges(("a", "b"), ("b", "a"), ("g", "s"), ("g", "a")), "cycle"),
        (nodes(G, ("s", "sink", "nope")), edges(("g", "s")), "no sink 'nope'"),
    ],
)
def test_broken_graphs(n, e, what):
    with pytest.raises(ConfigError, match=what):
        Pipeline({"nodes": n, "edges": e})


def test_validation_reads_nothing(spark):
    bad = {"nodes": nodes(G, ("x", "transform", "select", {"columns": ["nope"]}), ("s", "sink", "null")), "edges": edges(("g", "x"), ("x", "s"))}
    with pytest.raises(ConfigError, match="node 'x': no column nope"):
        Pipeline(bad).build(spark)
    two = {"nodes": nodes(G, ("h", "source", "generator", {"rows": 1, "with_text": False}), ("s", "sink", "parquet", {"path": "/tmp/x"})), "edges": edges(("g", "s"), ("h", "s"))}
    with pytest.raises(ConfigError, match="differ"):
        Pipeline(two).build(spark)
    unknown = {"nodes": nodes(("g", "source", "generator", {"rows": 1, "what": 2}), ("s", "sink", "null")), "edges": edges(("g", "s"))}
    with pytest.raises(ConfigError, match="what"):
        Pipeline(unknown).build(spark)


def test_fan_out_and_failure_isolation(spark, tmp_path):
    spec = {
        "nodes": nodes(
            G,
            ("bad", "transform", "derive", {"columns": {"z": "CASE WHEN id = 5 THEN raise_error('stop') ELSE id END"}}),
            ("s1", "sink", "parquet", {"path": f"{tmp_path}/a"}),
            ("s2", "sink", "parquet", {"path": f"{tmp_path}/b"}),
            ("s3", "sink", "parquet", {"path": f"{tmp_path}/c"}),
        ),
        "edges": edges(("g", "bad"), ("bad", "s1"), ("g", "s2"), ("g", "s3")),
    }
    spec["nodes"][3]["after"] = ["s1"]
    report = {n.node: n for n in Pipeline(spec).run(spark).nodes}
    assert report["s1"].status == "failed" and "stop" in report["s1"].error
    assert report["s2"].status == "skipped" and report["s3"].status == "succeeded"
    assert spark.read.parquet(f"{tmp_path}/c").count() == 10


def test_a_failure_is_the_nodes_that_made_it(spark, tmp_path):
    """A division by zero in the job of a sink: the derive failed, what comes after it was skipped, what it read succeeded."""
    spec = {
        "nodes": nodes(
            G,
            ("half", "transform", "derive", {"columns": {"h": "id / 2"}}),
            ("bad", "transform", "derive", {"columns": {"ok": "id + 1", "z": "10 / (id - 5)"}}),
            ("kept", "transform", "filter", {"where": "z > 0"}),
            ("s1", "sink", "parquet", {"path": f"{tmp_path}/a"}),
            ("s2", "sink", "parquet", {"path": f"{tmp_path}/b"}),
            ("q", "transform", "sql", {"query": "SELECT CAST(label AS INT) AS n FROM half"}),
            ("s3", "sink", "parquet", {"path": f"{tmp_path}/c"}),
            ("s4", "sink", "parquet", {"path": f"{tmp_path}/d"}),
        ),
        "edges": edges(("g", "half"), ("half", "bad"), ("bad", "kept"), ("kept", "s1"), ("half", "s2"), ("half", "q"), ("q", "s3"), ("bad", "s4")),
    }
    report = {n.node: n for n in Pipeline(spec).run(spark).nodes}
    status = {i: n.status for i, n in report.items()}
    assert status == {"g": "succeeded", "half": "succeeded", "bad": "failed", "kept": "skipped", "s1": "skipped", "s2": "succeeded", "q": "failed", "s3": "skipped", "s4": "skipped"}
    assert "DIVIDE_BY_ZERO" in report["bad"].error and report["s4"].error == "bad failed" and report["s1"].error == "kept skipped" and "CAST_INVALID_INPUT" in report["q"].error


def test_plugins(spark, rows):
    r = standard_registry()
    with pytest.raises(ConfigError, match="exists already"):
        r.add_plugin("identity", plugins.Identity)
    df = spark.createDataFrame([(1, "á"), (2, None)], "id long, t string")
    assert rows(plugins.batch_udf(df, plugins.UpperCase, {"column": "t"})) == [(1, "Á"), (2, None)] == rows(plugins.upper(df, "t"))
    with pytest.raises(ConfigError, match="rejects its config"):
        plugins.batch_udf(df, plugins.UpperCase, {"col": "t"})

    class Count:
        def __init__(self, config):
            self.n = 0

        def process(self, batch):
            self.n += batch.num_rows
            return []

        def finish(self):
            import pyarrow as pa

            return [pa.RecordBatch.from_pydict({"n": [self.n]})]

    assert rows(plugins.batch_udf(spark.range(100).repartition(3), Count, {}, "n long", scope="global")) == [(100,)]


def steps(frame):
    """(node, column): the direct ones as (in_node, in_column, derivation), and the names of the indirect ones."""
    direct, indirect = {}, {}
    for r in frame.collect():
        if r.edge == "direct":
            direct.setdefault((r.node, r.column), set()).add((r.in_node, r.in_column, r.derivation))
        else:
            indirect.setdefault((r.node, r.column), set()).add(r.in_column)
    return direct, indirect


def linked(spark, *middle, ends="null"):
    """The edges of a chain: ten generated rows (id, value, label), ``middle``, a sink."""
    spec = {"nodes": nodes(G, *middle, ("s", "sink", ends)), "edges": edges(*zip(("g", *(m[0] for m in middle)), (*(m[0] for m in middle), "s"), strict=True))}
    return steps(Pipeline(spec).lineage(spark))


def test_lineage_of_projections(spark):
    direct, indirect = linked(spark, ("r", "transform", "rename", {"columns": {"id": "value", "value": "id"}}), ("p", "transform", "select", {"columns": ["value"]}), ("l", "transform", "limit", {"rows": 3}))
    assert direct["r", "value"] == {("g", "id", 0)} and direct["r", "id"] == {("g", "value", 0)} and direct["r", "label"] == {("g", "label", 0)}
    assert direct["p", "value"] == {("r", "value", 0)} and direct["l", "value"] == {("p", "value", 0)} and direct["s", "value"] == {("l", "value", 0)}
    assert not indirect and not any(node == "g" for node, _ in direct)


def test_lineage_of_expressions(spark):
    derived = {"both": "id + length(label)", "same": "`VALUE`", "one": "1"}
    direct, indirect = linked(spark, ("f", "transform", "filter", {"where": "value > 3 OR label = 'x'"}), ("d", "transform", "derive", {"columns": derived}), ("a", "transform", "aggregate", {"group_by": ["same"], "aggregates": {"n": "count(*)", "most": "max(both) - min(id)"}}))
    assert indirect["f", "id"] == {"value", "label"} and direct["f", "id"] == {("g", "id", 0)}
    assert direct["d", "both"] == {("f", "id", 1), ("f", "label", 1)} and direct["d", "same"] == {("f", "VALUE".lower(), 0)} and ("d", "one") not in direct
    assert direct["a", "most"] == {("d", "both", 2), ("d", "id", 2)} and ("a", "n") not in direct
    assert indirect["a", "n"] == {"same"} and direct["a", "same"] == {("d", "same", 0)}


def test_lineage_of_sql(spark):
    query = "WITH x AS (SELECT id AS i, label FROM g WHERE value > 1) SELECT i, upper(label) AS big, 5 AS five FROM x"
    direct, indirect = linked(spark, ("q", "transform", "sql", {"query": query}))
    assert direct["q", "i"] == {("g", "id", 0)} and indirect["q", "i"] == {"value"}
    assert direct["q", "big"] == {("g", "label", 1)} and ("q", "five") not in direct
    direct, _ = linked(spark, ("q", "transform", "sql", {"query": "SELECT id AS x FROM g UNION ALL SELECT length(label) FROM g"}))
    assert direct["q", "x"] == {("g", "id", 0), ("g", "label", 1)}  # by branch
    direct, indirect = linked(spark, ("q", "transform", "sql", {"query": "SELECT value, id, 'union' AS u FROM g WHERE value > 1 ORDER BY label"}))
    assert direct["q", "value"] == {("g", "value", 0)} and direct["q", "id"] == {("g", "id", 0)} and indirect["q", "value"] == {"value", "label"}  # copied, and filtered by


A, B = "id long, value double, label string, user string, xs array<int>", "id long, value double, label string"


@pytest.mark.parametrize(
    ("query", "direct", "decides"),
    [
        ("WITH t AS (SELECT id, value FROM a UNION ALL SELECT id, value * 2 FROM b) SELECT sum(value) OVER (ORDER BY id) AS x FROM t WHERE id > 0", {("x", "A", "id", 2), ("x", "A", "value", 2), ("x", "B", "id", 2), ("x", "B", "value", 2)}, {("A", "id"), ("B", "id")}),
        ("SELECT user, concat(user, label) AS x FROM a", {("user", "A", "user", 0), ("x", "A", "user", 1), ("x", "A", "label", 1)}, set()),
        ("SELECT label, max(value) - min(id) AS m FROM a GROUP BY ROLLUP(label) HAVING count(user) > 1", {("label", "A", "label", 0), ("m", "A", "value", 2), ("m", "A", "id", 2)}, {("A", "label"), ("A", "user")}),
        ("SELECT y.label FROM a x JOIN b y ON x.id = y.value", {("label", "B", "label", 0)}, {("A", "id"), ("B", "value")}),
        ("SELECT label FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.value = a.value) AND id IN (SELECT id FROM b)", {("label", "A", "label", 0)}, {("A", "value"), ("B", "value"), ("A", "id"), ("B", "id")}),
        ("SELECT (SELECT max(value) FROM b WHERE b.id = a.id) AS v FROM a", {("v", "B", "value", 2)}, {("A", "id"), ("B", "id")}),
        ("SELECT m FROM a, LATERAL (SELECT max(b.value) AS m FROM b WHERE b.id = a.id)", {("m", "B", "value", 2)}, {("A", "id"), ("B", "id")}),
        ("SELECT e FROM a LATERAL VIEW explode(xs) t AS e", {("e", "A", "xs", 1)}, set()),
        ("SELECT id FROM a EXCEPT SELECT id FROM b WHERE value > 2", {("id", "A", "id", 0)}, {("B", "id"), ("B", "value")}),
        ("SELECT id FROM a INTERSECT SELECT id FROM b", {("id", "A", "id", 0), ("id", "B", "id", 0)}, set()),
        ("WITH RECURSIVE r(n) AS (SELECT id FROM a UNION ALL SELECT n + 1 FROM r WHERE n < 5) SELECT n FROM r", {("n", "A", "id", 3)}, set()),
        ("SELECT * FROM VALUES (1), (2) AS t(x)", set(), set()),
        ("SELECT count(*) AS n FROM a", set(), set()),
    ],
)
def test_trace_of_a_query(spark, query, direct, decides):
    ins = {port: (port.upper(), spark.createDataFrame([], schema)) for port, schema in (("a", A), ("b", B))}
    found = list(columns.edges("sql", {"query": query}, ins, None))
    assert {(c, node, old, how) for c, node, old, how, edge in found if edge == "direct"} == direct
    assert {(node, old) for _, node, old, _, edge in found if edge == "indirect"} == decides


def test_columns_named_like_functions_are_traced(spark):
    df = spark.createDataFrame([], "user string, current_date int, b int")
    assert columns.read_by(df, "user") == ["user"] and columns.read_by(df, "concat(user, b)", "current_date + 1") == ["user", "current_date", "b"]
    assert columns.read_by(df, "count(*)") == [] and columns.read_by(df, "sum(b) OVER (PARTITION BY USER)") == ["user", "b"]


def test_errors_stay_what_they_are_after_lineage(tmp_path):
    """In a new process, lineage comes before any error that PySpark has logged."""
    code = """
from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from flowkit.plans.pipeline import Pipeline
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
nodes = [{"id": "g", "type": "source", "connector": "generator", "config": {"rows": 1}}, {"id": "f", "type": "transform", "op": "filter", "config": {"where": "id > 0"}}, {"id": "s", "type": "sink", "connector": "null"}]
Pipeline({"name": "p", "nodes": nodes, "edges": [{"from": "g", "to": "f"}, {"from": "f", "to": "s"}]}).lineage(spark).collect()
try:
    spark.range(1).selectExpr("nope")
except AnalysisException:
    print("as it should be")
"""
    ran = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).parents[1], timeout=300)
    assert "as it should be" in ran.stdout, ran.stderr[-2000:]


def test_lineage_of_fan_in_and_plugins(spark):
    spec = {"nodes": nodes(G, ("h", "source", "generator", {"rows": 1}), ("p", "transform", "identity"), ("s", "sink", "parquet", {"path": "/tmp/x"})), "edges": edges(("g", "s"), ("h", "p"), ("p", "s"))}
    direct, _ = steps(Pipeline(spec).lineage(spark))
    assert direct["s", "id"] == {("g", "id", 0), ("p", "id", 0)} and direct["p", "id"] == {("h", c, 3) for c in ("id", "value", "label")}


def test_lineage_across_pipelines(spark, folder):
    first = Pipeline.from_yaml(JOIN.replace("memory_limit_mb: 256", "memory_limit_mb: 64"), base=folder)
    assert first.run(spark).succeeded
    second = Pipeline({"name": "report", "nodes": nodes(("again", "source", "csv", {"path": f"{folder}//out/"}), ("twice", "transform", "derive", {"columns": {"double": "highest * 2"}}), ("s", "sink", "null")), "edges": edges(("again", "twice"), ("twice", "s"))})
    schema = "pipeline string, node string, column string, path string"
    wrote = spark.createDataFrame([(first.name, "out", c, f"{folder}/out") for c in ("coast", "highest")], schema)
    reads = spark.createDataFrame([(second.name, "again", c, f"{folder}//out/") for c in ("coast", "highest")], schema)
    graph = lineage.across(first.lineage(spark).unionByName(second.lineage(spark)), lineage.file_edges(wrote, reads))
    found = {(r.column, r.in_column): (r.in_node, r.derivation) for r in lineage.resolve(graph).filter("node = 'report:s'").collect()}
    assert found["coast", "coast"] == ("waves by coast:buoys", 0) and found["double", "metres"] == ("waves by coast:waves", 2)
    assert {r.node for r in lineage.impact(graph, "waves by coast:waves", "sensor").collect()} >= {"waves by coast:trusted", "waves by coast:joined", "report:twice", "report:s"}
