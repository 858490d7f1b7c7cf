"""Sources, sinks, transforms, JSON, plugins and pipelines over the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import basic, jsonrecords, lineage, plugins
from ..operators.history import dedup_by_hash
from ..plans.pipeline import Pipeline
from ..schema import declared
from ..sinks import files as sinks
from ..sources import files
from .common import Query, scratch, table
from .relational import money

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(made: Query) -> Query:
        QUERIES[name] = made
        if oracle:
            ORACLE_SQL[name] = oracle
        return made

    return add


@query("src_csv", "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def src_csv(spark, sf):
    path = scratch(spark, "csv")
    sinks.csv(table(spark, sf, "customer"), path, delimiter=";")
    return files.csv(spark, path, delimiter=";")


@query("src_parquet_projection", "SELECT l_shipdate, l_orderkey, l_quantity FROM lineitem")
def src_parquet_projection(spark, sf):
    return files.parquet(spark, f"{sf}/lineitem.parquet", ["l_shipdate", "l_orderkey", "l_quantity"])


@query("src_generator", "SELECT i AS id, i * 1.5::DOUBLE AS value, 'row-' || i AS label FROM range((SELECT count(*) FROM lineitem)) AS t(i)")
def src_generator(spark, sf):
    return files.generator(spark, table(spark, sf, "lineitem").count())


@query("csv_line_breaks", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_line_breaks(spark, sf):
    """Whole texts, with their quotes, delimiters and line breaks, written as CSV and read back."""
    path = scratch(spark, "csv")
    sinks.csv(table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars"), path)
    return files.csv(spark, path)


@query("snk_csv_roundtrip", "SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part")
def snk_csv_roundtrip(spark, sf):
    path = scratch(spark, "csv")
    sinks.csv(table(spark, sf, "part"), path)
    return files.csv(spark, path, infer_rows=0)


@query("snk_parquet_roundtrip", "SELECT * FROM orders")
def snk_parquet_roundtrip(spark, sf):
    path = scratch(spark, "parquet")
    sinks.parquet(table(spark, sf, "orders"), path, compression="zstd")
    return files.parquet(spark, path)


@query("op_select", "SELECT o_totalprice, o_orderkey FROM orders")
def op_select(spark, sf):
    return basic.select(table(spark, sf, "orders"), ["o_totalprice", "o_orderkey"])


@query("op_rename", "SELECT n_nationkey AS n_regionkey, n_name AS nation, n_regionkey AS n_nationkey FROM nation")
def op_rename(spark, sf):
    return basic.rename(table(spark, sf, "nation"), {"n_nationkey": "n_regionkey", "n_regionkey": "n_nationkey", "n_name": "nation"})


@query("op_filter", "SELECT * FROM lineitem WHERE l_discount > 0.05 AND l_returnflag = 'R'")
def op_filter(spark, sf):
    return basic.where(table(spark, sf, "lineitem"), "l_discount > 0.05 AND l_returnflag = 'R'")


@query("op_derive", "SELECT *, l_extendedprice * (1 - l_discount) AS net, l_quantity * 2 AS twice FROM lineitem")
def op_derive(spark, sf):
    return basic.derive(table(spark, sf, "lineitem"), {"twice": "l_quantity * 2", "net": "l_extendedprice * (1 - l_discount)"})


@query("op_aggregate", f"SELECT c_mktsegment, c_nationkey, {money('c_acctbal')} AS balance, count(*) AS n FROM customer GROUP BY c_mktsegment, c_nationkey")
def op_aggregate(spark, sf):
    return basic.aggregate(table(spark, sf, "customer"), {"n": "count(*)", "balance": money("c_acctbal")}, ["c_mktsegment", "c_nationkey"])


@query("op_aggregate_global", f"SELECT {money('l_extendedprice')} AS price, count(*) AS n FROM lineitem")
def op_aggregate_global(spark, sf):
    return basic.aggregate(table(spark, sf, "lineitem"), {"n": "count(*)", "price": money("l_extendedprice")})


@query("op_aggregate_empty", "SELECT count(*) AS n, max(o_totalprice) AS most FROM orders WHERE o_totalprice < 0")
def op_aggregate_empty(spark, sf):
    return basic.aggregate(basic.where(table(spark, sf, "orders"), "o_totalprice < 0"), {"n": "count(*)", "most": "max(o_totalprice)"})


@query("op_limit")
def op_limit(spark, sf):
    return basic.limit(table(spark, sf, "lineitem"), 100)


@query("op_limit_rows", "SELECT least(count(*), 100) AS n, true AS given FROM lineitem")
def op_limit_rows(spark, sf):
    """How many rows a limit gives, and whether all are rows of the table."""
    lineitem = table(spark, sf, "lineitem")
    found = basic.limit(lineitem, 100)
    seen = found.select(F.lit(False).alias("stray")).union(found.exceptAll(lineitem).select(F.lit(True)))
    return seen.agg(F.count_if(~F.col("stray")).alias("n"), (F.count_if("stray") == 0).alias("given"))


@query("set_fan_in", "SELECT c_custkey AS k, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def set_fan_in(spark, sf):
    one = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"))
    other = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("balance"))
    return basic.stack({"customers": one, "suppliers": other})


@query("fan_out_counts", "SELECT 'all' AS branch, count(*) AS n FROM orders UNION ALL SELECT 'final', count(*) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'large', count(*) FROM orders WHERE o_totalprice > 100000")
def fan_out_counts(spark, sf):
    orders = table(spark, sf, "orders")
    branches = {"all": orders, "final": basic.where(orders, "o_orderstatus = 'F'"), "large": basic.where(orders, "o_totalprice > 100000")}
    return basic.stack({k: df.agg(F.count("*").alias("n")).select(F.lit(k).alias("branch"), "n") for k, df in branches.items()})


def payloads(spark, sf):
    """One JSON payload per conversation: {"data": {"items": [{turn, role}, ..]}}."""
    items = F.sort_array(F.collect_list(F.struct("turn", "role")))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.struct(items.alias("items")).alias("data"))).alias("payload"))


@query("json_records", "SELECT conv_id, turn, role FROM conversations")
def json_records(spark, sf):
    schema = T.StructType([T.StructField("turn", T.LongType()), T.StructField("role", T.StringType())])
    return jsonrecords.json_records(payloads(spark, sf), "payload", "data.items", schema, ["conv_id"])


@query("json_string_at", "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS absent FROM events")
def json_string_at(spark, sf):
    return table(spark, sf, "events").select("event_id", jsonrecords.json_string_at("props", "k").alias("k"), jsonrecords.json_string_at("props", "x.y").alias("absent"))


@query("json_infer", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_infer(spark, sf):
    events = table(spark, sf, "events")
    schema = jsonrecords.infer_schema(events, "props", sample_rows=None)
    return events.select("event_id", F.from_json("props", schema).alias("p")).select("event_id", "p.*")


@query("json_chunks", "SELECT conv_id, CAST((n - 1) // 2 AS BIGINT) AS chunk, count(*) AS n_rows, '[' || string_agg('{\"conv_id\":' || conv_id || ',\"turn\":' || turn || '}', ',' ORDER BY n) || ']' AS body FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM (SELECT conv_id, turn FROM conversations)) GROUP BY conv_id, (n - 1) // 2")
def json_chunks(spark, sf):
    return jsonrecords.json_chunks(table(spark, sf, "conversations").select("conv_id", "turn"), 2, ["turn"], ["conv_id"])


@query("dedup_by_hash", "SELECT sha256(text) AS hash, text, min(doc_id) AS first, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text")
def dedup(spark, sf):
    return dedup_by_hash(table(spark, sf, "documents"), "text", "doc_id")


@query("udf_upper", "SELECT c_custkey, upper(c_mktsegment) AS c_mktsegment FROM customer")
def udf_upper(spark, sf):
    return plugins.upper(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")


@query("udf_batch", "SELECT p_partkey, upper(p_type) AS p_type FROM part")
def udf_batch(spark, sf):
    return plugins.batch_udf(table(spark, sf, "part").select("p_partkey", "p_type"), plugins.UpperCase, {"column": "p_type"})


@query("flatten_struct", 'SELECT o_orderkey, o_custkey AS "who.customer", o_orderstatus AS "what.status", o_totalprice AS "what.price.total" FROM orders')
def flatten(spark, sf):
    from ..operators.diff import flatten_struct

    nested = table(spark, sf, "orders").select("o_orderkey", F.struct(F.col("o_custkey").alias("customer")).alias("who"), F.struct(F.col("o_orderstatus").alias("status"), F.struct(F.col("o_totalprice").alias("total")).alias("price")).alias("what"))
    return flatten_struct(nested)


BILLED = f"SELECT c_mktsegment, count(DISTINCT c_custkey) AS customers, count(*) AS orders, {money('o_totalprice')} AS billed FROM customer JOIN {{}} ON c_custkey = o_custkey GROUP BY c_mktsegment ORDER BY billed DESC"


@query("pipeline_join", BILLED.format("(SELECT * FROM orders WHERE o_orderstatus = 'F') AS o"))
def pipeline_join(spark, sf):
    spec = {
        "name": "orders by segment",
        "nodes": [
            {"id": "customers", "type": "source", "connector": "parquet", "config": {"path": f"{sf}/customer.parquet"}},
            {"id": "orders", "type": "source", "connector": "parquet", "config": {"path": f"{sf}/orders.parquet"}},
            {"id": "final", "type": "transform", "op": "filter", "config": {"where": "o_orderstatus = 'F'"}},
            {"id": "billed", "type": "transform", "op": "sql", "config": {"query": BILLED.format("paid")}},
            {"id": "out", "type": "sink", "connector": "null"},
        ],
        "edges": [{"from": "customers", "to": "billed", "port": "customer"}, {"from": "orders", "to": "final"}, {"from": "final", "to": "billed", "port": "paid"}, {"from": "billed", "to": "out"}],
    }
    return Pipeline(spec).build(spark)["billed"]


@query("pipeline_two_phase", f"SELECT o_orderpriority, count(*) AS n, {money('o_totalprice')} AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority")
def pipeline_two_phase(spark, sf):
    middle, end = scratch(spark, "phase"), scratch(spark, "phase")
    spec = {
        "name": "write, then read again",
        "nodes": [
            {"id": "orders", "type": "source", "connector": "parquet", "config": {"path": f"{sf}/orders.parquet"}},
            {"id": "final", "type": "transform", "op": "filter", "config": {"where": "o_orderstatus = 'F'"}},
            {"id": "write", "type": "sink", "connector": "parquet", "config": {"path": middle}},
            {"id": "again", "type": "source", "connector": "parquet", "config": {"path": middle, "columns": ["o_orderpriority", "o_totalprice"]}, "after": ["write"]},
            {"id": "sums", "type": "transform", "op": "aggregate", "config": {"group_by": ["o_orderpriority"], "aggregates": {"n": "count(*)", "total": money("o_totalprice")}}},
            {"id": "out", "type": "sink", "connector": "parquet", "config": {"path": end}},
        ],
        "edges": [{"from": "orders", "to": "final"}, {"from": "final", "to": "write"}, {"from": "again", "to": "sums"}, {"from": "sums", "to": "out"}],
    }
    report = Pipeline(spec).run(spark)
    if not report.succeeded:
        raise RuntimeError("; ".join(f"{n.node}: {n.error}" for n in report.nodes if n.error))
    return spark.read.parquet(end)


#: Sink columns, their origins in lineitem and the most that happens to them on the way.
TRACED = [("l_returnflag", "l_returnflag", 0), ("latest", "l_shipdate", 2), ("net", "l_extendedprice", 2), ("net", "l_discount", 2)]


@query("lineage_edges", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{origin}' AS in_column, {rank} AS derivation, count({origin}) AS filled FROM lineitem" for c, origin, rank in TRACED))
def lineage_edges(spark, sf):
    """Which columns of lineitem reach the sink of a pipeline, and how many values of each there are."""
    path = f"{sf}/lineitem.parquet"
    spec = {
        "name": "net by flag",
        "nodes": [
            {"id": "items", "type": "source", "connector": "parquet", "config": {"path": path}},
            {"id": "shipped", "type": "transform", "op": "filter", "config": {"where": "l_linestatus = 'F'"}},
            {"id": "priced", "type": "transform", "op": "derive", "config": {"columns": {"net": "l_extendedprice * (1 - l_discount)"}}},
            {"id": "named", "type": "transform", "op": "rename", "config": {"columns": {"l_shipdate": "shipped_on"}}},
            {"id": "sums", "type": "transform", "op": "aggregate", "config": {"group_by": ["l_returnflag"], "aggregates": {"net": "sum(net)", "latest": "max(shipped_on)"}}},
            {"id": "out", "type": "sink", "connector": "null"},
        ],
        "edges": [{"from": a, "to": b} for a, b in (("items", "shipped"), ("shipped", "priced"), ("priced", "named"), ("named", "sums"), ("sums", "out"))],
    }
    found = lineage.resolve(Pipeline(spec).lineage(spark)).filter("node = 'out'").select("column", "in_column", "derivation")
    items = files.parquet(spark, path)
    counts = items.agg(*(F.count(c).alias(c) for c in items.columns)).unpivot([], items.columns, "in_column", "filled")
    return found.join(counts, "in_column")


@query("run_report", "SELECT 'orders' AS node, 'source' AS kind, 'succeeded' AS status, CAST(NULL AS BIGINT) AS rows_in, count(*) AS rows_out FROM orders UNION ALL SELECT 'final', 'transform', 'succeeded', (SELECT count(*) FROM orders), count(*) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'out', 'sink', 'succeeded', count(*), NULL FROM orders WHERE o_orderstatus = 'F'")
def run_report(spark, sf):
    spec = {
        "nodes": [
            {"id": "orders", "type": "source", "connector": "parquet", "config": {"path": f"{sf}/orders.parquet"}},
            {"id": "final", "type": "transform", "op": "filter", "config": {"where": "o_orderstatus = 'F'"}},
            {"id": "out", "type": "sink", "connector": "null"},
        ],
        "edges": [{"from": "orders", "to": "final"}, {"from": "final", "to": "out"}],
    }
    return Pipeline(spec).run(spark).to_frame(spark, "run").select("node", "kind", "status", "rows_in", "rows_out")


@query("snk_publish", "SELECT * FROM orders")
def snk_publish(spark, sf):
    """A sink that fails half way leaves what was published before as it was."""
    path = scratch(spark, "published")
    orders = table(spark, sf, "orders")
    sinks.parquet(orders, path)
    last = orders.agg(F.max("o_orderkey")).first()[0]
    broken = orders.withColumn("o_orderstatus", F.when(F.col("o_orderkey") == last, F.raise_error(F.lit("stop")).cast("string")).otherwise(F.col("o_orderstatus")))
    try:
        sinks.parquet(broken, path)
    except Exception as e:
        if "stop" not in str(e):
            raise
        return files.parquet(spark, path)
    raise RuntimeError("a broken write was published")


@query("sql_ports", "SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def sql_ports(spark, sf):
    text = "SELECT who.n_name, count(*) AS customers FROM buyers JOIN who ON c_nationkey = n_nationkey GROUP BY who.n_name"
    return basic.sql({"buyers": table(spark, sf, "customer"), "who": table(spark, sf, "nation")}, text)


@query("json_declared", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_declared(spark, sf):
    schema = declared([{"name": "k", "type": "int64"}])
    return table(spark, sf, "events").select("event_id", F.from_json("props", schema).alias("p")).select("event_id", "p.*")


def generated(spark, sf, times: int):
    """Generated rows, ``times`` as many as line items."""
    return files.generator(spark, table(spark, sf, "lineitem").count() * times, with_text=False)


@query("bench_chained", f"SELECT i % 100 AS bucket, count(*) AS n, CAST(sum(CAST(i * 3.0 AS DECIMAL(28,1))) AS DOUBLE) AS total FROM range((SELECT count(*) * 10 FROM lineitem)) AS t(i) WHERE i * 2 >= (SELECT count(*) FROM lineitem) GROUP BY i % 100")
def bench_chained(spark, sf):
    rows = table(spark, sf, "lineitem").count()
    kept = basic.where(generated(spark, sf, 10), f"id * 2 >= {rows}")
    derived = basic.derive(kept, {"bucket": "id % 100", "twice": "value * 2"})
    return basic.aggregate(derived, {"n": "count(*)", "total": "CAST(sum(CAST(twice AS DECIMAL(28,1))) AS DOUBLE)"}, ["bucket"])
