"""Analytics over run-history tables of any size.

runs(run_id, pipeline, started_at_us, finished_at_us, status, elapsed_ms, nodes);
node_runs(run_id, node, position, kind, component, status, rows_in, bytes_in,
stalled_in_ms, rows_out, bytes_out, stalled_out_ms, elapsed_ms, error);
events(run_id, seq, at_us, kind, node, detail, payload); node_progress(run_id,
node, at_ms, rows_out, ..); run_versions(run_id, path, hash, ..).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import ConfigError
from ..functions.dialect import at_micros
from .keysets import of_keys, written


def run_history(runs: DataFrame, run_versions: DataFrame) -> DataFrame:
    """Runs with times as timestamps and the version that ran, if known."""
    versions = run_versions.select("run_id", "path", "hash")
    return runs.join(versions, "run_id", "left").select("run_id", "pipeline", at_micros(F.col("started_at_us")).alias("started_at"), "status", "elapsed_ms", "path", "hash")


def event_log(events: DataFrame) -> DataFrame:
    """Events with their time as a timestamp."""
    return events.withColumn("at", at_micros(F.col("at_us"))).drop("at_us")


def throughput(node_runs: DataFrame) -> DataFrame:
    """Rows and bytes a second, busy milliseconds and percent of each node; nulls where nothing elapsed.

    Sinks count what came in, others what went out. Busy is the time not
    spent waiting for neighbours, never below 0.
    """
    sink = F.col("kind") == "sink"
    some = F.col("elapsed_ms") > 0
    rows = F.when(sink, F.col("rows_in")).otherwise(F.col("rows_out"))
    out = node_runs.withColumn("busy_ms", F.greatest(F.col("elapsed_ms") - F.col("stalled_in_ms") - F.col("stalled_out_ms"), F.lit(0)))
    found = {"rows": rows, "rows_per_s": F.when(some, rows * 1000.0 / F.col("elapsed_ms")), "busy_pct": F.when(some, F.col("busy_ms") * 100.0 / F.col("elapsed_ms"))}
    if {"bytes_in", "bytes_out"} <= set(node_runs.columns):
        found["bytes_per_s"] = F.when(some, F.when(sink, F.col("bytes_in")).otherwise(F.col("bytes_out")) * 1000.0 / F.col("elapsed_ms"))
    return out.withColumns(found)


def bottleneck(node_runs: DataFrame) -> DataFrame:
    """The node of each run that was busy longest, over 0 ms; of equals the last in the pipeline."""
    best = F.max_by(F.struct("node", "position", "busy_ms"), F.struct("busy_ms", "position"))
    return throughput(node_runs).filter("busy_ms > 0").groupBy("run_id").agg(best.alias("b")).select("run_id", "b.node", "b.position", "b.busy_ms")


def _latest(runs: DataFrame, n: int, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("started_at_us").desc(), F.col("run_id").desc())
    return runs.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= n).drop("__n")


def typical_duration(runs: DataFrame, n: int = 10, least: int = 3) -> DataFrame:
    """(pipeline, typical_ms): the rounded median of its last ``n`` successes; null if fewer than ``least``."""
    last = _latest(runs.filter("status = 'succeeded' and elapsed_ms is not null"), n, ["pipeline"])
    median = F.round(F.expr("percentile(elapsed_ms, 0.5)")).cast("long")
    return last.groupBy("pipeline").agg(F.when(F.count("*") >= least, median).alias("typical_ms"))


def recent(runs: DataFrame, node_runs: DataFrame, n: int) -> DataFrame:
    """The latest ``n`` runs with their number of failed nodes."""
    last = runs.orderBy(F.col("started_at_us").desc(), F.col("run_id").desc()).limit(n)
    failed = node_runs.filter("status = 'failed'").join(last.select("run_id"), "run_id", "left_semi").groupBy("run_id").agg(F.count("*").alias("failed_nodes"))
    return last.join(failed, "run_id", "left").withColumn("failed_nodes", F.coalesce("failed_nodes", F.lit(0).cast("long")))


def nodes_of(node_runs: DataFrame, run: Column | int | str) -> DataFrame:
    """The nodes of a run in pipeline order, with their throughput."""
    return throughput(node_runs.filter(F.col("run_id") == run)).orderBy("position")


def events_of(events: DataFrame, run: Column | int | str, n: int) -> DataFrame:
    """The first ``n`` events of a run."""
    return events.filter(F.col("run_id") == run).orderBy("seq").limit(n)


def progress_of(progress: DataFrame, run: Column | int | str) -> DataFrame:
    return progress.filter(F.col("run_id") == run).orderBy("at_ms", "node")


def progress_rate(progress: DataFrame) -> DataFrame:
    """Cumulative rows_out as rows a second between samples of a node; null for the first and for no time."""
    order = Window.partitionBy("run_id", "node").orderBy("at_ms", "rows_out")
    rows, ms = (F.col(c) - F.lag(c).over(order) for c in ("rows_out", "at_ms"))
    return progress.withColumn("rows_per_s", F.when(ms > 0, rows * 1000.0 / ms))


def versions_that_ran(runs: DataFrame, run_versions: DataFrame) -> DataFrame:
    """(hash, runs, last_started_us, last_status, last_run) of each version."""
    when = F.struct("started_at_us", "run_id")
    joined = runs.join(run_versions.select("run_id", "hash"), "run_id")
    return joined.groupBy("hash").agg(F.count("*").alias("runs"), F.max("started_at_us").alias("last_started_us"), F.max_by("status", when).alias("last_status"), F.max_by("run_id", when).alias("last_run"))


def alerts_recent(alerts: DataFrame, n: int, run: Column | int | str | None = None) -> DataFrame:
    """The latest ``n`` alerts, of one run or of all."""
    found = alerts if run is None else alerts.filter(F.col("run_id") == run)
    return found.orderBy(F.col("at_us").desc(), "run_id", "kind").limit(n)


def prune(runs: DataFrame, cutoff_us: int, children: dict[str, DataFrame], texts: DataFrame | None = None) -> dict[str, DataFrame]:
    """Runs started at or after the cutoff, their children, and the texts that some kept version still has.

    Nothing is written: publish the results to make it so.
    """
    kept = runs.filter(F.col("started_at_us") >= cutoff_us)
    out = {"runs": kept} | {name: df.join(kept.select("run_id"), "run_id", "left_semi") for name, df in children.items()}
    if texts is not None:
        out["texts"] = texts.join(out["run_versions"].select("hash"), "hash", "left_semi")
    return out


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key is not in it."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def dedup_by_hash(df: DataFrame, column: str, first_by: str) -> DataFrame:
    """(hash, text, first, copies): every text once, by its SHA-256, with the smallest ``first_by``; nulls are dropped.

    The text itself is not shuffled: equal hashes are counted, then the first row gives the text.
    """
    hashed = df.filter(F.col(column).isNotNull()).withColumn("hash", F.sha2(column, 256))
    counted = hashed.groupBy("hash").agg(F.min(first_by).alias("first"), F.count("*").alias("copies"))
    texts = hashed.select(F.col(first_by).alias("first"), "hash", F.col(column).alias("text")).dropDuplicates(["hash", "first"])
    return texts.join(counted, ["hash", "first"]).select("hash", "text", "first", "copies")


def new_texts(store: DataFrame, df: DataFrame, column: str, first_by: str) -> DataFrame:
    """As ``dedup_by_hash``, of the texts whose hash ``store`` (hash, ..) does not have: what an insert-or-ignore adds.

    Only hashes are compared. The store is searched for the hashes that came and is
    not shuffled while those are few; a text is handed on only if it is new, so a
    second load of the same texts moves none. Null texts add nothing; neither does
    an empty table; an empty store takes every text.
    """
    hashed = df.filter(F.col(column).isNotNull()).select(F.col(first_by).alias("first"), F.sha2(column, 256).alias("hash"), F.col(column).alias("text"))
    came = written(hashed.groupBy("hash").agg(F.min("first").alias("first"), F.count("*").alias("copies")), "came")
    known = written(of_keys(store.select("hash"), came, ["hash"]).distinct(), "known")
    fresh = written(of_keys(came, known, ["hash"], "left_anti"), "fresh")
    texts = of_keys(hashed, fresh, ["hash", "first"], nulls=True).dropDuplicates(["hash", "first"])
    return texts.join(fresh.select("hash", "copies"), "hash").select("hash", "text", "first", "copies")


def by_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """The rows of the only value that begins with ``prefix``; several values or none are an error."""
    found = df.filter(F.startswith(F.col(column), F.lit(prefix)))
    values = [r[0] for r in found.select(column).distinct().limit(2).collect()]
    if len(values) != 1:
        raise ConfigError(f"{prefix!r} fits {'several values, such as ' + ', '.join(map(str, values)) if values else 'no value'} of {column}")
    return found.filter(F.col(column) == values[0])


def rows_written(node_runs: DataFrame) -> DataFrame:
    """(run_id, rows_written by sinks that succeeded, failed_nodes)."""
    wrote = F.when((F.col("kind") == "sink") & (F.col("status") == "succeeded"), F.col("rows_in")).otherwise(0)
    return node_runs.groupBy("run_id").agg(F.sum(wrote).alias("rows_written"), F.count(F.when(F.col("status") == "failed", 1)).alias("failed_nodes"))


def attribution(commits: DataFrame, versions: DataFrame, current: str | None = None) -> DataFrame:
    """(bucket, commit, runs, last_run): which commit's text each version is.

    commits(commit, position, hash): the newest commit with a text claims it.
    versions as from ``versions_that_ran``. Versions of no commit are "current"
    if their hash is ``current``, else "others".
    """
    newest = commits.groupBy("hash").agg(F.max_by("commit", "position").alias("commit"))
    joined = versions.join(newest, "hash", "left")
    bucket = F.when(F.col("commit").isNotNull(), "commits").when(F.col("hash") == F.lit(current), "current").otherwise("others")
    return joined.groupBy(bucket.alias("bucket"), "commit").agg(F.sum("runs").alias("runs"), F.max_by("last_run", F.struct("last_started_us", "last_run")).alias("last_run"))
