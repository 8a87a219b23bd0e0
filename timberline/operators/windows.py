"""Sliding windows that begin at records: closed, and over once one reaches the last record."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.plans.shared import materialise, ship


def elapsed(records: DataFrame, group: str, time: str, name: str = "elapsed") -> DataFrame:
    """Adds the time since the earliest record of the group, in the unit of ``time`` (an integer)."""
    first = records.groupBy(group).agg(F.min(time).alias("_first"))
    return records.join(first, group).withColumn(name, F.col(time) - F.col("_first")).drop("_first")


def _keyed(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """The rows of each key of a sorted partition, whatever batches they come in."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if len(b) == 0:
            continue
        k = [b[c].to_numpy() for c in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in k], axis=0)) + 1
        for i, j in zip([0, *cuts], [*cuts, len(b)]):
            part = b.iloc[i:j]
            if held and any(held[0][c].iloc[0] != part[c].iloc[0] for c in keys):
                whole = held[0] if len(held) == 1 else pd.concat(held)
                yield tuple(whole[c].iloc[0] for c in keys), whole
                held = []
            held.append(part)
    if held:
        whole = held[0] if len(held) == 1 else pd.concat(held)
        yield tuple(whole[c].iloc[0] for c in keys), whole


def _frames(rows: Iterator[tuple], columns: list[str], at_once: int = 2000) -> Iterator[pd.DataFrame]:
    out: list[tuple] = []
    for r in rows:
        out.append(r)
        if len(out) >= at_once:
            yield pd.DataFrame(out, columns=columns)
            out = []
    yield pd.DataFrame(out, columns=columns)


def sliding_windows(records: DataFrame, group: str, time: str, size: int, step: int, blocks: int = 64) -> DataFrame:
    """Windows of each group: group, window_no (from 0), start_t, end_t (times of the first and last record in it).

    Window 0 starts at the first record, the next at the first record at or after start + step; a window ends with
    the last record at or before start + size; the window that reaches the last record is the last.

    Starts form a chain, but it needn't be walked from its beginning. Time is cut into blocks of ``blocks`` sizes. A chain
    can enter a block only at its first times, those less than a step behind its beginning and the one after; for each
    of these it is found, in each block on its own, where the chain leaves it and after how many windows. These short
    rows put in a row give every block's true entry, and each block then makes its own windows. So a group of any size is
    many tasks; one task only sees the entries of a group.
    """
    if not 0 < step <= size + 1:
        raise ValueError("step must be from 1 to size + 1, or windows could be empty")
    ship(records.sparkSession)
    kind, span = records.schema[group].dataType.simpleString(), blocks * max(size, step)
    x = records.where(F.col(group).isNotNull() & F.col(time).isNotNull()).select(F.col(group).alias("g"), F.col(time).cast("long").alias("t")).distinct()
    x = materialise(x.withColumn("block", F.expr(f"(t - pmod(t, {span})) div {span}")))

    def chain(t: np.ndarray) -> np.ndarray:
        return np.searchsorted(t, t + step, "left")

    def leave(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for (g, block), b in _keyed(batches, ["g", "block"]):
                t = b["t"].to_numpy("int64")
                n = len(t)
                # pointers and counts, doubled until all have left; the last start is what they leave from
                to, count, last = np.append(chain(t), n), np.append(np.ones(n, "int64"), 0), np.append(np.arange(n), n)
                while (to[:n] < n).any():
                    inside = to[:n] < n
                    last[:n] = np.where(inside, last[to[:n]], last[:n])
                    count, to = count + np.where(to < n, count[to], 0), to[to]
                k = min(n, int(np.searchsorted(t, block * span + step, "left")) + 1)
                yield g, block, int(t[-1]), t[:k].tolist(), t[last[:k]].tolist(), count[:k].tolist()

        yield from _frames(rows(), ["g", "block", "final", "entries", "lasts", "counts"], 50)

    def enter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for (g,), b in _keyed(batches, ["g"]):
                before, number, z = None, 0, int(b["final"].iloc[-1])
                for block, entries, lasts, counts in zip(b["block"], b["entries"], b["lasts"], b["counts"]):
                    i = 0 if before is None else int(np.searchsorted(entries, before + step, "left"))
                    if i < len(entries):
                        yield g, block, int(entries[i]), number, before, z
                        before, number = int(lasts[i]), number + int(counts[i])

        for f in _frames(rows(), ["g", "block", "entry", "number", "before", "z"]):
            yield f.astype({"before": "Int64"})

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (g, _), b in _keyed(batches, ["g", "home"]):
            # the block's own times, and behind them the first ones of the next
            t, own = b["t"].to_numpy("int64"), int((b["block"] == b["home"]).sum())
            entry, number, before, z = int(b["entry"].iloc[0]), int(b["number"].iloc[0]), b["before"].iloc[0], int(b["z"].iloc[0])
            to, at, starts = np.searchsorted(t[:own], t[:own] + step, "left"), int(np.searchsorted(t[:own], entry)), []
            if not (before == before and before is not None and before + size >= z):
                while at < own:
                    starts.append(at)
                    if t[at] + size >= z:
                        break
                    at = int(to[at])
            s = t[starts]
            ends = t[np.searchsorted(t, s + size, "right") - 1] if len(s) else s
            yield pd.DataFrame({"g": [g] * len(s), "window_no": number + np.arange(len(s)), "start_t": s, "end_t": ends})

    left = x.repartition("g", "block").sortWithinPartitions("g", "block", "t").mapInPandas(leave, f"g {kind}, block long, final long, entries array<long>, lasts array<long>, counts array<long>")
    entered = left.repartition("g").sortWithinPartitions("g", "block").mapInPandas(enter, f"g {kind}, block long, entry long, number long, before long, z long")
    # a block also gets the times that its last windows reach into the next one
    near = F.when(F.col("t") <= F.col("block") * span + size, F.array(F.col("block"), F.col("block") - 1)).otherwise(F.array("block"))
    y = x.withColumn("home", F.explode(near)).join(entered.withColumnRenamed("block", "home"), ["g", "home"])
    y = y.repartition("g", "home").sortWithinPartitions("g", "home", "t").select("g", "home", "block", "t", "entry", "number", "before", "z")
    return y.mapInPandas(make, f"g {kind}, window_no long, start_t long, end_t long").withColumnRenamed("g", group)


def window_records(records: DataFrame, windows: DataFrame, group: str, time: str, size: int) -> DataFrame:
    """Records with each window that holds them: an equi-join on slices of ``size``, not a range over the group.

    A window touches at most two slices, so a hot group is spread over its slices.
    """
    w = windows.withColumn("_slice", F.explode(F.sequence(F.floor(F.col("start_t") / size), F.floor(F.col("end_t") / size))))
    r = records.withColumn("_slice", F.floor(F.col(time) / size))
    return r.join(w, [group, "_slice"]).where(F.col(time).between(F.col("start_t"), F.col("end_t"))).drop("_slice")


def window_labels(members: DataFrame, group: str, label: str) -> DataFrame:
    """Label of each window (any abnormal record, its event known or not) and its records."""
    return members.groupBy(group, "window_no").agg(F.max(F.coalesce(F.col(label), F.lit(0))).alias("label"), F.count(F.lit(1)).alias("records"))


def first_last_times(windows: DataFrame, flagged: DataFrame, group: str) -> DataFrame:
    """The time ranges of flagged windows."""
    return windows.join(flagged.select(group, "window_no"), [group, "window_no"]).select(group, "window_no", "start_t", "end_t")


def synthetic_times(records: DataFrame, order: str, start_micros: int, step_micros: int = 100_000) -> DataFrame:
    """Adds micros: an invented time per record, one step after the other, in ``order``."""
    from timberline.operators.islands import numbered

    x = numbered(records.withColumn("_all", F.lit(0)), "_all", order, "_k")
    return x.withColumn("micros", F.lit(start_micros) + (F.col("_k") - 1) * step_micros).drop("_all", "_k")


