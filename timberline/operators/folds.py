"""Rows of files rewritten one after the other by a machine, in blocks that run side by side.

A block of order numbers needs the state that the blocks before it leave. A file's first block begins with the
machine's start, so a file that is one block is rewritten at once. Of longer files each block but the last is run ahead:
the first from the start, others from all beginnings (most fall together within a few rows). What they leave
is put in a row per file, and then each block is rewritten from its known beginning. Rows are sorted by Spark and go by
in Arrow batches, so a task holds no block, and a small file costs no call of its own.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.plans.shared import block_of, join_counted, materialise, ship


class Machine(Protocol):
    """States must be what JSON can hold; lists and tuples are the same."""

    reads: tuple[str, ...]
    writes: str
    start: Any
    beginnings: list

    def run(self, rows: list[tuple], state: Any) -> tuple[list, list[bool], Any]:
        """The written column's values, whether each row stays, and the state behind the rows."""

    def ends(self, rows: list[tuple], states: list) -> list:
        """The states behind the rows, for each of the states before them."""

    def behind(self, ends: list, state: Any) -> Any:
        """The state behind a block that was begun with ``state``, by what its beginnings lead to."""


def _runs(batch: pa.RecordBatch, group: str) -> Iterator[tuple[tuple, int, int]]:
    """Successive rows of the same block: key, first row, row behind the last."""
    at = 0
    for key, same in itertools.groupby(zip(batch.column(group).to_pylist(), batch.column("_block").to_pylist())):
        n = sum(1 for _ in same)
        yield key, at, at + n
        at += n


def _rows(batch: pa.RecordBatch, names: tuple[str, ...]) -> list[tuple]:
    return list(zip(*(batch.column(c).to_pylist() for c in names)))


def folded(x: DataFrame, machine: Machine, group: str = "file_id", order: str = "line_no", bits: int = 14) -> DataFrame:
    """``x`` with the machine's column rewritten, without the rows that go. ``x`` is read up to three times: a written table."""
    ship(x.sparkSession)
    names, kind = x.columns, x.schema[group].dataType.simpleString()
    x = x.withColumn("_block", block_of(F.col(order), bits))
    in_file = Window.partitionBy(group).orderBy("_block")
    ahead = x.select(group, "_block").distinct().select(group, "_block", F.lead("_block").over(in_file).alias("_next"), F.lag("_block").over(in_file).isNull().alias("_first"))
    ahead = materialise(ahead.where("_next IS NOT NULL"))

    def run_ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, states, following, file_type = None, [], None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], file_type), pa.array([following], pa.int64()), pa.array([json.dumps(states)])], [group, "_next", "_ends"])

        for b in batches:
            file_type, rows, first, after, done = b.schema.field(group).type, _rows(b, machine.reads), b.column("_first").to_pylist(), b.column("_next").to_pylist(), []
            for k, lo, hi in _runs(b, group):
                if k != key:
                    if key is not None:
                        done.append(row())
                    key, states, following = k, [machine.start] if first[lo] else list(machine.beginnings), after[lo]
                states = machine.ends(rows[lo:hi], states)
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if key is not None:
            yield row()

    def put_in_a_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, state = None, None
        for b in batches:
            states = []
            for f, ends in zip(b.column(group).to_pylist(), map(json.loads, b.column("_ends").to_pylist())):
                state = machine.behind(ends, state) if f == file else ends[0]
                file = f
                states.append(json.dumps(state))
            yield pa.RecordBatch.from_arrays([b.column(group), b.column("_next"), pa.array(states, pa.string())], [group, "_block", "_state"])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            rows, known, out, stays = _rows(b, machine.reads), b.column("_state").to_pylist(), [], []
            for k, lo, hi in _runs(b, group):
                if k != key:
                    key, state = k, machine.start
                    if known[lo] is not None:
                        # a block's state is sorted before its rows
                        state, lo = json.loads(known[lo]), lo + 1
                        out.append(None)
                        stays.append(False)
                o, s, state = machine.run(rows[lo:hi], state)
                out += o
                stays += s
            columns = [pa.array(out, b.schema.field(n).type) if n == machine.writes else b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(stays, pa.bool_()))

    rows = x.withColumn("_state", F.lit(None).cast("string"))
    if n := ahead.count():
        long = join_counted(x, ahead, [group, "_block"], rows=n).select(group, "_block", order, "_next", "_first", *[c for c in machine.reads if c not in (group, order)])
        ends = long.repartition(group, "_block").sortWithinPartitions(group, "_block", order).mapInArrow(run_ahead, f"{group} {kind}, _next long, _ends string")
        begins = ends.repartition(group).sortWithinPartitions(group, "_next").mapInArrow(put_in_a_row, f"{group} {kind}, _block long, _state string")
        rows = rows.unionByName(materialise(begins), allowMissingColumns=True)
    rows = rows.repartition(group, "_block").sortWithinPartitions(F.col(group), F.col("_block"), F.col("_state").desc_nulls_last(), F.col(order))
    return rows.mapInArrow(rewrite, x.select(*names).schema)
