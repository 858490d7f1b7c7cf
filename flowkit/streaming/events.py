"""Run events: parsing, thinning of progress samples, and alerts, on tables and on streams.

Events are (run_id, seq, at, kind, ...) rows, or JSON lines with the tag
``event``. The batch forms replay a table of any size; the stream forms keep
their state by run, bounded by a watermark or by timers.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import median

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

#: Fields of a JSON event that become columns; the whole line is kept beside them.
EVENT = "event string, run_id string, seq long, pipeline string, node string, kind string, component string, error string, reason string, attempt int, will_retry boolean, succeeded boolean, elapsed_ms long, nodes array<struct<node:string,input:struct<rows:long,bytes:long,stalled_ms:long>,output:struct<rows:long,bytes:long,stalled_ms:long>>>"


def detail(kind: Column) -> Column:
    """What an event says in a few words."""
    return (
        F.when(kind == "run_started", F.col("pipeline"))
        .when(kind == "node_started", F.concat_ws(" ", "kind", "component"))
        .when(kind == "node_failed", F.concat(F.col("error"), F.when(F.col("will_retry"), " (retried)").otherwise("")))
        .when(kind == "node_skipped", F.col("reason"))
        .when(kind == "run_finished", F.when(F.col("succeeded"), "succeeded").otherwise("failed"))
    )


def classify(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON lines -> (run_id, seq, kind, node, detail, elapsed_ms, nodes, payload); lines without an event tag are dropped. Works on streams."""
    parsed = lines.select(F.col(column).alias("payload"), F.from_json(column, EVENT).alias("e")).filter("e.event is not null").select("payload", "e.*")
    return parsed.select("run_id", "seq", F.col("event").alias("kind"), "node", detail(F.col("event")).alias("detail"), "elapsed_ms", "will_retry", "succeeded", "nodes", "payload")


def ingest(lines: DataFrame, path: str, checkpoint: str):
    """Append the classified events of a stream to Parquet, each exactly once; returns the running query."""
    return classify(lines).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def downsample(samples: DataFrame, run: str = "run_id", elapsed: str = "elapsed_ms", order: str | None = None) -> DataFrame:
    """The first sample of each second of each run."""
    second = F.floor(F.col(elapsed) / 1000)
    first = Window.partitionBy(run, second).orderBy(elapsed, *([order] if order else []))
    return samples.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")


def downsample_stream(samples: DataFrame, at: str, delay: str = "10 seconds", run: str = "run_id", elapsed: str = "elapsed_ms") -> DataFrame:
    """The same on a stream: the first sample to arrive of each run and second, remembered for ``delay``."""
    return samples.withColumn("second", F.floor(F.col(elapsed) / 1000)).withWatermark(at, delay).dropDuplicatesWithinWatermark([run, "second"])


def progress_rows(samples: DataFrame) -> DataFrame:
    """(run_id, at_ms, node, rows_in, rows_out, ...): a row for each node of each progress event."""
    n = samples.select("run_id", F.col("elapsed_ms").alias("at_ms"), F.explode("nodes").alias("n"))
    fields = {f"{short}_{end}": F.col(f"n.{side}.{name}") for side, end in (("input", "in"), ("output", "out")) for name, short in (("rows", "rows"), ("bytes", "bytes"))}
    return n.select("run_id", "at_ms", "n.node", *(c.alias(a) for a, c in fields.items()), F.col("n.input.stalled_ms").alias("stalled_in_ms"), F.col("n.output.stalled_ms").alias("stalled_out_ms"))


def failures(events: DataFrame) -> DataFrame:
    """(run_id, at, seq, node): each run that finished without success, and its first node that failed for good.

    events(run_id, seq, at, kind, node, will_retry, succeeded); the node is
    null if none failed before the end.
    """
    ends = events.filter("kind = 'run_finished' and not succeeded").groupBy("run_id").agg(F.min(F.struct("seq", "at")).alias("e"))
    fails = events.filter("kind = 'node_failed' and not will_retry").select("run_id", F.col("seq").alias("s"), F.col("node").alias("n"))
    joined = ends.join(fails, "run_id", "left").groupBy("run_id", "e").agg(F.min_by(F.when(F.col("s") < F.col("e.seq"), F.col("n")), F.when(F.col("s") < F.col("e.seq"), F.col("s"))).alias("node"))
    return joined.select("run_id", "e.at", "e.seq", "node")


def stalls(events: DataFrame, threshold_us: int, key: str = "run_id", at: str = "at", seq: str = "seq", end: Column | None = None) -> DataFrame:
    """(key, at, gap_us): the first silence of ``threshold_us`` or more after an event of each key, once a key.

    ``end`` marks events that finish a key: silence after them is none.
    """
    order = Window.partitionBy(key).orderBy(at, seq)
    gap = F.timestamp_diff("MICROSECOND", F.col(at), F.lead(at).over(order))
    quiet = events.withColumn("gap_us", gap).filter(F.col("gap_us") >= threshold_us)
    quiet = quiet.filter(~end) if end is not None else quiet
    first = F.min_by(F.struct(F.col(at).alias("at"), "gap_us"), F.struct(at, seq))
    return quiet.groupBy(key).agg(first.alias("f")).select(key, "f.at", "f.gap_us")


#: Runs of one pipeline are judged a day at a time.
DAY_US = 86_400_000_000


def slow(runs: DataFrame, factor: float, last: int = 10, least: int = 3, bucket_us: int = DAY_US) -> DataFrame:
    """(run_id, pipeline, elapsed_ms, typical_ms): runs over ``factor`` times the median of the ``last`` successes before them.

    Fewer than ``least`` successes before a run judge nothing. A success counts
    for the runs that start after it, by (started_at_us, run_id). A pipeline's
    runs are split by the time of their start into buckets, each with the last
    successes before it carried in; only those few rows of a bucket go through a
    window over the whole pipeline.
    """
    keys, order = ["pipeline", "__bucket"], ["started_at_us", "run_id"]
    runs = runs.select("run_id", "pipeline", "started_at_us", "elapsed_ms", "status").withColumn("__bucket", F.expr(f"started_at_us div {bucket_us}"))
    good = runs.filter("status = 'succeeded' and elapsed_ms is not null").select(*keys, *order, "elapsed_ms")
    newest = Window.partitionBy(*keys).orderBy(F.desc("started_at_us"), F.desc("run_id"))
    tails = good.withColumn("__n", F.row_number().over(newest)).filter(F.col("__n") <= last).drop("__n")
    ranked = tails.withColumn("__rank", F.row_number().over(Window.partitionBy("pipeline").orderBy(*order)))
    passed = F.coalesce(F.sum("__kept").over(Window.partitionBy("pipeline").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = runs.select(*keys).distinct().join(tails.groupBy(*keys).agg(F.count("*").alias("__kept")), keys, "left").select(*keys, passed.cast("int").alias("__passed"))
    # the tail of rank r is among the last ones of a bucket that r to r + last - 1 tails come before
    carried = ranked.withColumn("__passed", F.explode(F.sequence("__rank", F.col("__rank") + last - 1))).select("pipeline", *order, "elapsed_ms", "__passed")
    carried = carried.join(buckets, ["pipeline", "__passed"]).select("pipeline", "__bucket", *order, "elapsed_ms", F.lit(None).cast("string").alias("status"))

    every = runs.select(*keys, *order, "elapsed_ms", "status", F.lit(False).alias("__carried")).union(carried.withColumn("__carried", F.lit(True)).select(*keys, *order, "elapsed_ms", "status", "__carried"))
    counts = (F.col("__carried") | (F.col("status") == "succeeded")) & F.col("elapsed_ms").isNotNull()
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = every.withColumn("__rank", F.count(F.when(counts, 1)).over(before)).filter("not __carried")
    history = every.filter(counts).select(*keys, F.col("elapsed_ms").alias("__ms"), F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).alias("__at"))
    around = F.sort_array(F.collect_list("__ms").over(Window.partitionBy(*keys).orderBy("__at").rowsBetween(-(last - 1), 0)))
    middle = (F.element_at("__w", F.floor((F.size("__w") + 1) / 2).cast("int")) + F.element_at("__w", F.floor(F.size("__w") / 2).cast("int") + 1)) / 2
    medians = history.select(*keys, F.col("__at").alias("__rank"), around.alias("__w")).select(*keys, "__rank", F.size("__w").alias("__k"), middle.alias("typical_ms"))
    joined = numbered.join(medians, [*keys, "__rank"]).filter((F.col("__k") >= least) & (F.col("elapsed_ms") > F.lit(float(factor)) * F.col("typical_ms")))
    return joined.select("run_id", "pipeline", "elapsed_ms", "typical_ms")


class _Watch(StatefulProcessor):
    """Per run: remembers the first final failure, and whether a stall was told; timers find silence."""

    def __init__(self, threshold_ms: int):
        self.threshold_ms = threshold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", "node string, told boolean")

    def _rearm(self, now: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(now + self.threshold_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        node, told = self.state.get() if self.state.exists() else (None, False)
        events = pd.concat(list(rows)).sort_values("seq")
        out, ended = [], False
        for e in events.itertuples():
            if e.kind == "node_failed" and not e.will_retry and node is None:
                node = e.node
            elif e.kind == "run_finished":
                ended = True
                if not e.succeeded:
                    out.append((key[0], "failed", node))
        if ended:
            self.state.clear()
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
        else:
            self.state.update((node, told))
            self._rearm(timerValues.getCurrentProcessingTimeInMs())
        if out:
            yield pd.DataFrame(out, columns=["run_id", "kind", "node"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        node, told = self.state.get() if self.state.exists() else (None, True)
        if not told:
            self.state.update((node, True))
            yield pd.DataFrame([(key[0], "stalled", node)], columns=["run_id", "kind", "node"])

    def close(self) -> None:
        pass


def alerts_stream(events: DataFrame, stalled_after_ms: int) -> DataFrame:
    """(run_id, kind, node) of runs that failed or fell silent, from a stream of events (run_id, seq, kind, node, will_retry, succeeded).

    Silence is measured in processing time; a run's state goes when it ends.
    """
    needed = events.select("run_id", "seq", "kind", "node", F.coalesce("will_retry", F.lit(False)).alias("will_retry"), F.coalesce("succeeded", F.lit(False)).alias("succeeded"))
    return needed.groupBy("run_id").transformWithStateInPandas(_Watch(stalled_after_ms), "run_id string, kind string, node string", "append", "processingTime")


class _Pace(StatefulProcessor):
    """Per pipeline: how long its last successes took, and its open runs with a timer each that goes off when one is slow."""

    COLUMNS = ["pipeline", "run_id", "elapsed_ms", "typical_ms", "running"]

    def __init__(self, factor: float, last: int, least: int, forget_ms: int):
        self.factor, self.last, self.least, self.forget_ms = factor, last, least, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.took = handle.getValueState("took", "ms array<long>")
        self.open = handle.getMapState("open", "run_id string", "since long, typical double, told boolean", self.forget_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        took = list(self.took.get()[0]) if self.took.exists() else []
        now, out = timerValues.getCurrentProcessingTimeInMs(), []
        for e in pd.concat(list(rows)).sort_values(["at", "run_id", "seq"]).itertuples():
            run = (e.run_id,)
            if e.kind == "run_started":
                typical = float(median(took)) if len(took) >= self.least else None
                self.open.updateValue(run, (now, typical, False))
                if typical is not None:
                    self.handle.registerTimer(now + int(self.factor * typical) + 1)
            elif e.kind == "run_finished" and self.open.containsKey(run):
                _, typical, told = self.open.getValue(run)
                self.open.removeKey(run)
                if typical is not None and not told and e.elapsed_ms > self.factor * typical:
                    out.append((key[0], e.run_id, int(e.elapsed_ms), typical, False))
                if e.succeeded:
                    took = [*took, int(e.elapsed_ms)][-self.last :]
        self.took.update((took,))
        if out:
            yield pd.DataFrame(out, columns=self.COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentProcessingTimeInMs(), []
        late = [(run, *state) for run, state in self.open.iterator() if state[1] is not None and not state[2] and now - state[0] > self.factor * state[1]]
        for run, since, typical, _ in late:
            self.open.updateValue(run, (since, typical, True))
            out.append((key[0], run[0], now - since, typical, True))
        if out:
            yield pd.DataFrame(out, columns=self.COLUMNS)

    def close(self) -> None:
        pass


def slow_stream(events: DataFrame, factor: float, last: int = 10, least: int = 3, forget_ms: int = 7 * 86_400_000) -> DataFrame:
    """(pipeline, run_id, elapsed_ms, typical_ms, running): runs that take over ``factor`` times what is typical, once each, while they run.

    events(pipeline, run_id, seq, at, kind, elapsed_ms, succeeded): starts and
    ends of runs, each with its pipeline; other kinds and rows without a
    pipeline or run are passed over. Typical is the median of the ``last``
    successes that ended before the start was seen, ``least`` of them at least.
    A run is told by a timer, in processing time since its start was seen, with
    ``running`` true; one that ended before its timer went off, by its end. Runs
    without an end are forgotten after ``forget_ms``.
    """
    needed = events.filter("kind in ('run_started', 'run_finished') and pipeline is not null and run_id is not null")
    needed = needed.select("pipeline", "run_id", "seq", "at", "kind", F.coalesce("elapsed_ms", F.lit(0)).cast("long").alias("elapsed_ms"), F.coalesce("succeeded", F.lit(False)).alias("succeeded"))
    return needed.groupBy("pipeline").transformWithStateInPandas(_Pace(factor, last, least, forget_ms), "pipeline string, run_id string, elapsed_ms long, typical_ms double, running boolean", "append", "processingTime")


def deliver(alerts: DataFrame, path: str, checkpoint: str, webhook: str | None = None, **http):
    """Append each micro-batch of alerts to a table and, independently, post it; returns the running query."""
    from ..sinks.rest import rest

    def one(batch: DataFrame, _: int) -> None:
        batch.persist()
        try:
            batch.write.mode("append").parquet(path)
            if webhook:
                try:
                    rest(batch.coalesce(1), webhook, **http)
                except Exception as e:  # the table must not depend on the hook
                    print(f"alerts were not posted: {e}")
        finally:
            batch.unpersist()

    return alerts.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
