"""Logs as streams: the stateless parts of washing, entries joined as lines arrive, event counts with a watermark.

Windows of a stream are aligned to the clock and half open; they are another thing than the windows that begin at
records (operators.windows), and named so.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from timberline.functions.text import mask, split_apart, template_id
from timberline.logtypes import LogType
from timberline.operators.wash import is_empty, take_head
from timberline.plans.shared import ship

JOINED = "file_id int, line_no long, ts_text string, lines int, content string"
_STATE = "line_no long, ts_text string, lines int, content string"


def stream_lines(spark: SparkSession, folder: str, schema: str = "file_id int, line_no long, value string") -> DataFrame:
    """Lines as they arrive in parquet files of a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def washed(lines: DataFrame, log: LogType) -> DataFrame:
    """Washing that needs no other line: head off, noise out, words split."""
    if log.scan:
        raise ValueError(f"lines of {log.name} depend on each other; wash them in batches")
    body = F.regexp_replace("body", log.clean, "")
    x = take_head(lines, log).withColumn("body", log.normalise(body) if log.normalise else body).where(~is_empty(F.col("body")))
    return x.withColumn("body", split_apart(F.col("body"), log.split_left, log.split_right))


def joined(lines: DataFrame, quiet_ms: int = 60_000) -> DataFrame:
    """Records of washed lines: a file's open record is its state, and leaves when the next one begins.

    A record also leaves when its file was quiet for so long. Nested lines that come later still are its own: they leave as
    one more row of the same line_no (all rows of a line_no in their order are the record), so no line is lost. Lines of a
    file must arrive in order over batches; within a batch they are sorted.
    """
    ship(lines.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cols = ["file_id", "line_no", "ts_text", "lines", "content"]
        if state.hasTimedOut:
            no, ts, n, content = state.get
            # what has left stays known by its number, without text
            state.update((no, ts, 0, None))
            yield pd.DataFrame([(key[0], no, ts, n, content)] if n else [], columns=cols)
            return
        held, out = (tuple(state.get) if state.exists else None), []
        for no, ts, body in pd.concat(list(batches)).sort_values("line_no")[["line_no", "ts_text", "body"]].itertuples(index=False):
            if body[:1] in (" ", "\t"):
                if held:
                    text = f"{held[3].rstrip(' ')}, {body.strip()}" if held[2] else body.strip()
                    held = (held[0], held[1], held[2] + 1, text)
                continue
            if held and held[2]:
                out.append((key[0], *held))
            held = (int(no), ts, 1, body)
        if held:
            state.update(held)
            if held[2]:
                state.setTimeoutDuration(quiet_ms)
        yield pd.DataFrame(out, columns=cols)

    return lines.select("file_id", "line_no", "ts_text", "body").groupBy("file_id").applyInPandasWithState(step, JOINED, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def identified(records: DataFrame, log: LogType) -> DataFrame:
    """Adds masked and its id: the id of the template for contents whose parameters are all masked."""
    return records.withColumn("masked", mask(F.col("content"), log.masks)).withColumn("eventid", template_id(F.col("masked")))


def clock_window_counts(events: DataFrame, time: str, event: str, size: str = "10 seconds", step: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """Counts of events in windows aligned to the clock; later than the watermark is too late."""
    x = events.withWatermark(time, late).groupBy(F.window(time, size, step), event).agg(F.count(F.lit(1)).alias("n"))
    return x.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), event, "n")
