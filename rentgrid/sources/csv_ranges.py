"""Quoted CSV read by ranges: fields may hold line breaks, and large files are still split.

A first pass counts the quotes of every byte range of a file. Whether a range begins
inside a quoted field follows from the parity of all quotes before it, so every task knows where the
first record of its range begins. A record that runs over the end of its range comes
out in fragments, one a range, and only those are put together by a shuffle.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentgrid.session import shared_table

#: Where a row of ``pieces`` stands: a whole record, or a fragment that begins one, continues one or ends one.
WHOLE, FIRST, INNER, LAST = 0, 1, 2, 3
PIECES = "file string, start long, place long, part int, record string"


def lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``file, start, value``: the physical lines; ``start`` is that of the range that holds the line's first byte."""
    meta = F.col("_metadata")
    return spark.read.text(path, lineSep="\n").select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("start"), F.coalesce("value", F.lit("")).alias("value"))


def open_ranges(rows: DataFrame) -> DataFrame:
    """``file, start``: the ranges that begin inside a quoted field. One row per range at most (128 MB of input by default)."""
    quotes = F.length("value") - F.length(F.translate("value", '"', ""))
    counted = rows.groupBy("file", "start").agg(F.sum(quotes).alias("n"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("odd", F.sum("n").over(before) % 2 == 1).where("odd").select("file", "start", "odd")


def range_records(values: pa.Array, is_open: bool) -> tuple[list[tuple[int, int]], bool]:
    """``(spans, ends open)``: the lines ``from, to`` of every record or fragment of a range's lines."""
    n = len(values)
    quotes = pc.count_substring(values, '"').to_numpy(zero_copy_only=False).astype(np.int64)
    inside = (np.cumsum(quotes) + is_open) % 2 == 1           # after the line
    ends = np.flatnonzero(~inside) + 1
    starts = np.append(0, ends[:-1])
    spans = list(zip(starts.tolist(), ends.tolist())) if len(ends) else []
    last = spans[-1][1] if spans else 0
    return spans + ([(last, n)] if last < n else []), bool(n and inside[-1])


def _ranges(batches: Iterator[pa.RecordBatch]):
    """The batches of a task regrouped by range, in the order of the file."""
    held, at = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = batch.column("start").to_numpy()
        files = batch.column("file").dictionary_encode()
        codes = files.indices.to_numpy()
        cuts = np.flatnonzero((starts[1:] != starts[:-1]) | (codes[1:] != codes[:-1])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(starts)]):
            name = (batch.column("file")[lo].as_py(), int(starts[lo]))
            if at is not None and name != at:
                yield at, held
                held = []
            at = name
            held.append(batch.slice(lo, hi - lo))
    if at is not None:
        yield at, held


def cut_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``file, start, value, odd`` in file order to ``PIECES``. A record within one batch of lines is not copied."""
    for (file, start), parts in _ranges(batches):
        is_open = bool(parts[0].column("odd")[0].as_py())
        place, pending, begun = 0, [], is_open                 # lines of a record that goes on in the next batch
        for k, part in enumerate(parts):
            values = part.column("value")
            spans, ends_open = range_records(values, is_open)
            records, kinds = [], []
            for lo, hi in spans:
                done = hi < len(values) or not ends_open
                if hi - lo == 1 and not pending and done:
                    text = values[lo].as_py()
                else:
                    pending += values.slice(lo, hi - lo).to_pylist()
                    if not done and k + 1 < len(parts):
                        continue
                    text, pending = "\n".join(pending), []
                records.append(text)
                kinds.append((INNER if begun else FIRST) if not done else LAST if begun else WHOLE)
                begun = False if done else begun
            is_open = ends_open
            if records:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * len(records)), pa.array([start] * len(records), pa.int64()),
                     pa.array(np.arange(place, place + len(records))), pa.array(kinds, pa.int32()), pa.array(records, pa.string())],
                    names=["file", "start", "place", "part", "record"])
                place += len(records)


def joined_fragments(pieces: DataFrame) -> DataFrame:
    """Records that run over several ranges, put together in the order of their ranges."""
    order = Window.partitionBy("file").orderBy("start", "place")
    owner = F.last(F.when(F.col("part") == FIRST, F.struct("start", "place")), ignorenulls=True).over(order)
    owned = pieces.where(F.col("part") != WHOLE).select("file", owner.alias("owner"), "start", "place", "record")
    texts = F.array_sort(F.collect_list(F.struct("start", "place", "record")))
    return owned.groupBy("file", "owner").agg(texts.alias("parts")).select(
        "file", F.col("owner.start").alias("start"), F.col("owner.place").alias("place"), F.lit(WHOLE).alias("part"),
        F.concat_ws("\n", F.col("parts.record")).alias("record"))


def records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``file, start, place, record``: every record of the files, headers too, with its place in the file."""
    rows = lines(spark, path)
    odd = shared_table(open_ranges(rows), "open-ranges")
    pieces = rows.join(F.broadcast(odd), ["file", "start"], "left").select(
        "file", "start", "value", F.coalesce("odd", F.lit(False)).alias("odd")).mapInArrow(cut_records, PIECES)
    whole = pieces.where(F.col("part") == WHOLE)
    torn = shared_table(pieces.where(F.col("part") != WHOLE), "torn-records")
    if torn.first() is not None:
        whole = whole.unionByName(joined_fragments(torn))
    return whole.drop("part")


def checked_header(names: Sequence[str]) -> Column:
    """For the first record of a file: true where it names the columns of the schema, an error otherwise."""
    expected = [n.strip() for n in names]

    def same(headers):
        import pandas as pd
        return pd.Series([[c.strip() for c in next(csv.reader(io.StringIO(h.lstrip("﻿").rstrip("\r"))), [])] == expected for h in headers])

    return F.pandas_udf(same, T.BooleanType())("record")


def read_quoted_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str, row: str = "_row") -> DataFrame:
    """CSV with a header and quoted fields, read in any number of tasks, with the order of rows in ``row``.

    Quotes are doubled inside quoted fields and stand nowhere else, as CSV has it; an
    unquoted field with a single quote in it needs the one-task reader. Blank records are skipped, a header that does not
    name the columns of ``schema`` in order is an error, and a quote that never closes ends with its file.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    found = records(spark, path)
    headers = shared_table(found.where("start = 0 AND place = 0"), "csv-headers")
    wrong = headers.where(~checked_header(schema.names)).select("file", "record").first()
    if wrong is not None:
        raise ValueError(f"the header of {wrong['file']} is {wrong['record']!r}, not {','.join(schema.names)}")
    body = found.where("NOT (start = 0 AND place = 0)").withColumn("record", F.regexp_replace("record", "\r$", "")).where("trim(record) <> ''")
    options = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    parsed = F.from_csv("record", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields), options)
    return body.select(parsed.alias("__r"), F.struct("file", "start", "place").alias(row)).select("__r.*", row)
