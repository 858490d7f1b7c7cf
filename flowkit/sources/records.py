"""Records of CSV files whose quoted fields hold line breaks, read in parallel splits.

A split is read as lines. A line begins outside quotes or within, so what a line
or a split does to that is one of four functions, found for both beginnings
without knowing which is true. Composing those of a file's splits in order tells
how each split begins; then all of them glue their lines to records at once. A
record that goes over the end of a split leaves pieces, which are put together
by the split in which it begins.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ends_quoted(line: str, quoted: bool, delimiter: str) -> bool:
    """Whether a line that begins within quotes, or not, ends within. A quote is one only where a field begins; doubled ones within quotes stand for themselves."""
    at = 0
    while True:
        if not quoted:
            if line.startswith('"', at):
                quoted, at = True, at + 1
                continue
        else:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('"', at + 1):
                at += 2
                continue
            quoted, at = False, at + 1
        ends = [i for i in (line.find(delimiter, at), line.find("\r", at)) if i >= 0]
        if not ends:
            return False
        at = min(ends) + 1


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, file, split): lines end with \\n alone, so that what is within quotes stays as it is. Files go by a hash of their path."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("line"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))


def _effects(delimiter: str):
    """Lines (null: without quotes) -> a row for each split: see the schema below."""

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list[bool]] = {}
        for batch in batches:
            file, split = np.asarray(batch.column(1)), np.asarray(batch.column(2))
            begins = np.flatnonzero(np.r_[True, (file[1:] != file[:-1]) | (split[1:] != split[:-1])])
            for i in begins.tolist():
                found.setdefault((int(file[i]), int(split[i])), [False, True, False, False])
            for i in np.flatnonzero(np.asarray(batch.column(0).is_valid())).tolist():
                ends, line = found[int(file[i]), int(split[i])], batch.column(0)[i].as_py()
                after = ends_quoted(line, False, delimiter), ends_quoted(line, True, delimiter)
                ends[:2] = after[ends[0]], after[ends[1]]
                ends[2] |= not ends[1]
                ends[3] |= ends[0]
        keys, ends = zip(*found, strict=True) if found else ((), ()), zip(*found.values(), strict=True) if found else ((),) * 4
        yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.int64()) for k in keys), *(pa.array(e, pa.bool_()) for e in ends)], ["file", "split", "open", "shut", "closes", "breaks"])

    return effects


#: open: ends within quotes if it begins outside; shut: if it begins within; closes: leaves the record in which it began; breaks: holds a line that ends within.
_EFFECTS = "file long, split long, open boolean, shut boolean, closes boolean, breaks boolean"


def _inside(effects: list) -> dict[tuple[int, int], int]:
    """The splits that begin within a record, with the split in which that record begins; effects are in order."""
    inside, since, file = {}, None, None
    for e in effects:
        since, file = (since, file) if e["file"] == file else (None, e["file"])
        if since is not None:
            inside[e["file"], e["split"]] = since
        if not (e["open"] if since is None else e["shut"]):
            since = None
        elif since is None or e["closes"]:
            since = e["split"]
    return inside


def _glued(inside: dict[tuple[str, int], int], has_header: bool, delimiter: str):
    """Lines -> (record) or, of records that splits cut, (file, since, split, piece); the first record of a file is its header."""

    def glued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, since, first, waiting = None, None, False, []
        records: list[str] = []
        pieces: list[tuple] = []

        def left():
            """What the split leaves open belongs to the record that began here, or further back."""
            if waiting:
                pieces.append((now[0], since if since is not None else now[1], now[1], "\n".join(waiting), since is None and first))

        def taken():
            out = pa.RecordBatch.from_pydict({"record": pa.array(records + [None] * len(pieces), pa.string()), **{n: pa.array([None] * len(records) + [p[i] for p in pieces], t) for i, (n, t) in enumerate((("file", pa.int64()), ("since", pa.int64()), ("split", pa.int64()), ("piece", pa.string()), ("header", pa.bool_())))}})
            records.clear()
            pieces.clear()
            return out

        for batch in batches:
            lines, files, splits = batch.columns
            quotes = pc.match_substring(lines, '"').to_pylist()
            for line, file, split, quote in zip(lines.to_pylist(), files.to_pylist(), splits.to_pylist(), quotes, strict=True):
                if (file, split) != now:
                    left()
                    now, waiting = (file, split), []
                    since, first = inside.get(now), has_header and split == 0
                quoted = bool(waiting) or since is not None
                quoted = ends_quoted(line, quoted, delimiter) if quote else quoted
                if quoted:
                    waiting.append(line)
                    continue
                line = line.removesuffix("\r")
                if since is not None:
                    pieces.append((file, since, split, "\n".join([*waiting, line]), False))
                    since, waiting = None, []
                else:
                    if not first:
                        records.append("\n".join([*waiting, line]) if waiting else line)
                    first, waiting = False, []
            yield taken()
        left()
        yield taken()

    return glued


def broken_records(spark: SparkSession, path: str, has_header: bool, delimiter: str) -> DataFrame | None:
    """(record) of CSV files some of whose records hold line breaks, without their headers; None if no record does.

    Reads all files once to learn how their splits begin; a row for each split
    comes to the driver, as its list of files does. The result reads them twice:
    for whole records, and for the pieces of cut ones.
    """
    lines = _lines(spark, path)
    effects = lines.select(F.when(F.contains("line", F.lit('"')), F.col("line")).alias("line"), "file", "split").mapInArrow(_effects(delimiter), _EFFECTS)
    effects = effects.groupBy("file", "split").agg(*(F.max(c).alias(c) for c in ("open", "shut", "closes", "breaks"))).orderBy("file", "split").collect()
    if not any(e["breaks"] for e in effects):
        return None
    glued = lines.mapInArrow(_glued(_inside(effects), has_header, delimiter), "record string, file long, since long, split long, piece string, header boolean")
    pieces = glued.filter("piece is not null").groupBy("file", "since").agg(F.max("header").alias("header"), F.sort_array(F.collect_list(F.struct("split", "piece"))).alias("pieces"))
    cut = pieces.filter("not header").select(F.array_join("pieces.piece", "\n").alias("record"))
    return glued.filter("record is not null").select("record").union(cut)


def header(spark: SparkSession, path: str, delimiter: str) -> list[str]:
    """The names in the first record of a file, whatever it holds."""
    text = ""
    for row in spark.read.option("lineSep", "\n").text(path).toLocalIterator():
        text += row[0]
        if not ends_quoted(text, False, delimiter):
            break
        text += "\n"
    return next(csv.reader([text.rstrip("\r")], delimiter=delimiter), [])
