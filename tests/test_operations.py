"""Known answers for history, events, lineage, diffs and JSON; properties against plain Python."""

import datetime
import json
import os
import time
from statistics import median

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowkit.errors import ConfigError
from flowkit.operators import diff, history, jsonrecords, lineage
from flowkit.streaming import events as ev

FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
RUNS = "run_id string, pipeline string, started_at_us long, status string, elapsed_ms long"


def test_throughput(spark):
    n = spark.createDataFrame([("r", "a", 0, "source", 0, 1000, 100, 5, 15), ("r", "b", 1, "sink", 500, 0, 0, 0, 9)], "run_id string, node string, position int, kind string, rows_in long, rows_out long, elapsed_ms long, stalled_in_ms long, stalled_out_ms long")
    a, b = history.throughput(n).orderBy("position").collect()
    assert (a.busy_ms, float(a.busy_pct), float(a.rows_per_s)) == (80, 80.0, 10_000.0)
    assert (b.rows, b.busy_ms, b.rows_per_s, b.busy_pct) == (500, 0, None, None)
    assert history.bottleneck(n).first().node == "a"


@pytest.mark.parametrize("ms, typical", [([1000, 2000, 90000], 2000), ([1000, 2000], None)])
def test_typical(spark, ms, typical):
    runs = [(str(i), "p", i, "succeeded", x) for i, x in enumerate(ms)] + [("f", "p", 9, "failed", 500)]
    assert history.typical_duration(spark.createDataFrame(runs, RUNS)).first().typical_ms == typical


@FEW
@given(st.lists(st.tuples(st.sampled_from(["succeeded", "failed"]), st.integers(0, 9)), min_size=1, max_size=20))
def test_slow_agrees_with_a_loop(spark, data):
    runs = spark.createDataFrame([(f"{i:03d}", "p", i, s, ms) for i, (s, ms) in enumerate(data)], RUNS)
    expected = set()
    for i, (_, ms) in enumerate(data):
        last = [x for s, x in data[:i] if s == "succeeded"][-10:]
        if len(last) >= 3 and ms > 2 * median(last):
            expected.add(f"{i:03d}")
    assert {r.run_id for r in ev.slow(runs, 2).collect()} == expected


@FEW
@given(st.lists(st.tuples(st.sampled_from(["p", "q"]), st.sampled_from(["succeeded", "failed"]), st.integers(0, 9), st.integers(0, 3)), min_size=1, max_size=40), st.integers(1, 5))
def test_slow_over_many_buckets(spark, data, bucket):
    """Runs of two pipelines at uneven times: what is carried over borders of buckets changes nothing."""
    runs, at = [], 0
    for i, (p, s, ms, gap) in enumerate(data):
        at += gap
        runs.append((f"{i:03d}", p, at, s, ms if i % 9 else None))
    expected = set()
    for i, p, _, _, ms in runs:
        last = [x for j, o, _, s, x in runs if o == p and j < i and s == "succeeded" and x is not None][-4:]
        if ms is not None and len(last) >= 2 and ms > 1.5 * median(last):
            expected.add((i, float(median(last))))
    found = ev.slow(spark.createDataFrame(runs, RUNS), 1.5, last=4, least=2, bucket_us=bucket)
    assert {(r.run_id, float(r.typical_ms)) for r in found.collect()} == expected


TOLD = "pipeline string, run_id string, elapsed_ms long, typical_ms double, running boolean"
PACE = "pipeline string, run_id string, seq long, at long, kind string, elapsed_ms long, succeeded boolean"


def paced(spark, folder, checkpoint, out):
    stream = ev.slow_stream(spark.readStream.schema(PACE).json(folder), 2.0)
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime="500 milliseconds").start(out)


def test_slow_in_a_stream(spark, tmp_path, rows):
    """A run is told while it runs, by its timer and once; ended runs are told as the batch form tells them."""
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    runs = [(f"r{i:02d}", "p", i, "succeeded" if i % 4 else "failed", ms) for i, ms in enumerate([400, 300, 500, 400, 450, 900, 400, 5000, 100, 300, 300])]
    ended = [e for i, (run, p, at, status, ms) in enumerate(runs) for e in ((p, run, 2 * i, 10 * at, "run_started", None, None), (p, run, 2 * i + 1, 10 * at + 5, "run_finished", ms, status == "succeeded"))]
    going = [("p", "now", 900, 9000, "run_started", None, None), ("new", "first", 901, 9001, "run_started", None, None), (None, "x", 902, 9002, "run_started", None, None)]
    spark.createDataFrame(ended, PACE).coalesce(1).write.mode("append").json(folder)
    batch = ev.slow(spark.createDataFrame(runs, RUNS), 2.0)
    told = len(batch.collect())

    def wait(which, n):
        """Timers keep the query busy, so its end is no sign; rows are."""
        until = time.monotonic() + 60
        while time.monotonic() < until:
            if os.path.exists(f"{out}/_spark_metadata") and spark.read.schema(TOLD).parquet(out).filter(which).count() >= n:
                return
            time.sleep(0.5)

    q = paced(spark, folder, f"{tmp_path}/c", out)
    try:
        wait("not running", told)
        spark.createDataFrame(going, PACE).coalesce(1).write.mode("append").json(folder)
        wait("running", 1)
        spark.createDataFrame([("p", "now", 903, 9900, "run_finished", 9999, True)], PACE).coalesce(1).write.mode("append").json(folder)
        time.sleep(4)
    finally:
        q.stop()
    found = spark.read.schema(TOLD).parquet(out)
    assert rows(found.filter("not running").select("run_id", "elapsed_ms", F.col("typical_ms").cast("double"))) == rows(batch.select("run_id", "elapsed_ms", F.col("typical_ms").cast("double"))) != []
    now = found.filter("running").collect()
    assert [(r.run_id, r.typical_ms) for r in now] == [("now", 400.0)] and now[0].elapsed_ms > 800


def test_upsert_prune_versions(spark, rows):
    old = spark.createDataFrame([("a", "p", 1, "succeeded", 5), ("b", "p", 2, "succeeded", 5), ("c", "p", 9, "succeeded", 5)], RUNS)
    new = spark.createDataFrame([("a", "p", 1, "failed", 6)], RUNS)
    merged = history.upsert(old, new, ["run_id"])
    assert merged.count() == 3 and merged.filter("run_id = 'a'").first().status == "failed"
    v = spark.createDataFrame([("a", "x", "h1"), ("b", "x", "h2"), ("c", "x", "h2")], "run_id string, path string, hash string")
    kept = history.prune(old, 5, {"run_versions": v}, spark.createDataFrame([("h1", "t1"), ("h2", "t2")], "hash string, text string"))
    assert rows(kept["texts"]) == [("h2", "t2")] and kept["runs"].count() == 1
    ran = {r.hash: r for r in history.versions_that_ran(old, v).collect()}
    assert (ran["h2"].runs, ran["h2"].last_run) == (2, "c")
    commits = spark.createDataFrame([("k1", 1, "h2")], "commit string, position int, hash string")
    found = {(r.bucket, r.commit): r.runs for r in history.attribution(commits, history.versions_that_ran(old, v), current="h1").collect()}
    assert found == {("commits", "k1"): 2, ("current", None): 1}


def test_prefix(spark):
    df = spark.createDataFrame([("abc",), ("abd",)], "id string")
    assert history.by_prefix(df, "id", "abc").count() == 1
    for p in ("ab", "x"):
        with pytest.raises(ConfigError):
            history.by_prefix(df, "id", p)


def line(kind, **more):
    return (json.dumps({"event": kind, "run_id": "r"} | more),)


def test_events(spark, rows):
    side = {"rows": 1, "bytes": 2, "stalled_ms": 3}
    samples = [line("progress", elapsed_ms=250 * i, nodes=[{"node": "n", "input": side | {"rows": i * 1000}, "output": side}]) for i in range(1, 11)]
    lines = spark.createDataFrame([line("run_started", pipeline="p", nodes=[]), line("node_failed", node="x", error="boom", will_retry=False), ("not json",), *samples], "value string")
    found = ev.classify(lines)
    assert ("r", "node_failed", "x", "boom") in rows(found.filter("kind <> 'progress'").select("run_id", "kind", "node", "detail")) and found.count() == 12
    kept = ev.progress_rows(ev.downsample(found.filter("kind = 'progress'"))).orderBy("at_ms").collect()
    assert [(r.at_ms, r.rows_in) for r in kept] == [(250, 1000), (1000, 4000), (2000, 8000)]


def test_stall_is_told_once(spark):
    t = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    df = spark.createDataFrame([("r", 1, t(1), "p"), ("r", 2, t(3), "p"), ("r", 3, t(9), "p"), ("r", 4, t(20), "end")], "run_id string, seq long, at timestamp_ntz, kind string")
    (r,) = ev.stalls(df, 5_000_000, end=F.col("kind") == "end").collect()
    assert (r.at, r.gap_us) == (t(3), 6_000_000)


def test_failure_names_the_first_final_failure(spark):
    rows = [("r", 1, 1, "node_failed", "a", True, None), ("r", 2, 2, "node_failed", "b", False, None), ("r", 3, 3, "node_failed", "c", False, None), ("r", 4, 4, "run_finished", None, None, False), ("ok", 5, 5, "run_finished", None, None, True)]
    (r,) = ev.failures(spark.createDataFrame(rows, "run_id string, seq long, at long, kind string, node string, will_retry boolean, succeeded boolean")).collect()
    assert (r.run_id, r.node, r.seq) == ("r", "b", 4)


def test_event_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join([line("node_failed", seq=1, node="b", error="e", will_retry=False)[0], line("run_finished", seq=2, succeeded=False)[0]]) + "\n")
    stream = spark.readStream.text(f"{tmp_path}/in")
    ev.ingest(stream, f"{tmp_path}/out", f"{tmp_path}/c1").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    ev.deliver(ev.alerts_stream(ev.classify(stream), 3_600_000), f"{tmp_path}/alerts", f"{tmp_path}/c2").awaitTermination(120)
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/alerts").collect()] == [("r", "failed", "b")]


def test_downsample_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"run_id": "r", "elapsed_ms": m, "at": f"2024-01-01T00:00:{m // 1000:02d}"}) for m in (250, 500, 1000, 1250, 2000)))
    stream = spark.readStream.schema("run_id string, elapsed_ms long, at timestamp").json(f"{tmp_path}/in")
    q = ev.downsample_stream(stream, "at").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


EDGES = "pipeline string, node string, column string, in_node string, in_column string, derivation int, edge string"


def test_lineage(spark, rows):
    e = spark.createDataFrame(
        [("A", "mul", "total", "read", "spend", 1, "direct"), ("A", "out", "total", "mul", "total", 0, "direct"), ("A", "out", "total", "read", "city", 0, "indirect"), ("B", "sum", "spent", "again", "total", 2, "direct")], EDGES
    )
    files = lineage.file_edges(spark.createDataFrame([("A", "out", "total", "/d/./x/")], "pipeline string, node string, column string, path string"), spark.createDataFrame([("B", "again", "total", "/d//x")], "pipeline string, node string, column string, path string"))
    graph = lineage.across(e, files)
    found = {(r.node, r.column): (r.in_node, r.in_column, r.derivation) for r in lineage.resolve(graph).collect()}
    assert found["B:sum", "spent"] == ("A:read", "spend", 2) and found["A:out", "total"] == ("A:read", "spend", 1)
    assert {(r.node, r.in_column) for r in lineage.indirect(graph).collect()} == {("A:out", "city"), ("B:again", "city"), ("B:sum", "city")}
    assert {r.node for r in lineage.impact(graph, "A:read", "spend").collect()} == {"A:mul", "A:out", "B:again", "B:sum"}


def test_lineage_cycle_ends(spark):
    e = spark.createDataFrame([("p", "a", "c", "b", "c", 0, "direct"), ("p", "b", "c", "a", "c", 1, "direct"), ("p", "x", "c", "b", "c", 0, "direct")], EDGES)
    assert lineage.resolve(e).count() == 0


def test_diff(spark, rows):
    before = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3), (4, None, 4)], "id long, s string, n int")
    after = spark.createDataFrame([(1, "a", 1), (2, "B", 2), (9, "c", 3), (4, None, 4)], "id long, s string, n int")
    assert rows(diff.keyed(before, after, "id")) == sorted([(2, "changed", "s", "b", "B"), (3, "removed", None, None, None), (9, "added", None, None, None)], key=repr)
    assert rows(diff.renames(before, after, "id")) == [(3, 9)]
    nested = spark.createDataFrame([((1, ("x", [1, 2])),)], "c struct<a:int,b:struct<d:string,e:array<int>>>")
    assert diff.flatten_struct(nested).columns == ["c.a", "c.b.d", "c.b.e"]


REC = T.StructType([T.StructField("id", T.LongType()), T.StructField("ok", T.BooleanType())])


def test_json_records(spark, rows):
    df = spark.createDataFrame([(1, '{"data":{"items":[{"id":7,"ok":true},{"id":8}]}}'), (2, '{"data":{"items":null}}'), (3, None)], "k long, p string")
    assert rows(jsonrecords.json_records(df, "p", ".data..items", REC, ["k"])) == [(1, 7, True), (1, 8, None)]
    for bad in ('{"tides":[]}', '{"data":{"items":5}}', "x"):
        other = spark.createDataFrame([(4, bad)], "k long, p string")
        with pytest.raises(Exception, match="no list at"):
            jsonrecords.json_records(other, "p", "data.items", REC).collect()
        assert jsonrecords.json_records(other, "p", "data.items", REC, on_error="drop").count() == 0
    top = spark.createDataFrame([('[{"id":1}]',)], "p string")
    assert rows(jsonrecords.json_records(top, "p", "", REC)) == [(1, None)]


def test_json_values_and_chunks(spark):
    df = spark.createDataFrame([('{"a":{"b":"x"}}',), ('{"a":{"b":5}}',), ('{"a":{"b":[1]}}',), ("nope",), (None,)], "p string")
    assert [r.v for r in df.select(jsonrecords.json_string_at("p", "a.b").alias("v")).collect()] == ["x", "5", None, None, None]
    chunks = jsonrecords.json_chunks(spark.range(5), 2, ["id"], wrap_in="rows").orderBy("chunk").collect()
    assert [c.n_rows for c in chunks] == [2, 2, 1] and json.loads(chunks[2].body) == {"rows": [{"id": 4}]}
    assert jsonrecords.json_chunks(spark.range(3), 5, ["id"], form="ndjson").first().body == '{"id":0}\n{"id":1}\n{"id":2}\n'


def test_a_known_renaming_pairs_rows_of_one_body_by_their_keys(spark, rows):
    before = spark.createDataFrame([(10, "a"), (11, "a"), (22, "a"), (33, "b"), (44, None)], "id long, s string")
    after = spark.createDataFrame([(1011, "a"), (1022, "a"), (1033, "B"), (1044, None), (22, "a")], "id long, s string")
    assert rows(diff.renames(before, after, "id")) == [(10, 1011), (11, 1022), (44, 1044)]
    assert rows(diff.renames(before, after, "id", lambda old: old + 1000)) == [(11, 1011), (22, 1022)]
