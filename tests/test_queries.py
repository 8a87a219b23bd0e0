"""Registered queries over small folders."""

import hashlib
import subprocess
import sys
from pathlib import Path

import pandas as pd

from timberline import queries, queries_logs
from timberline.logtypes import cm

REPO = Path(__file__).resolve().parents[1]


def _folder(path, rows):
    """A data folder with only the log: lineid, time, content."""
    pd.DataFrame(rows, columns=["lineid", "time", "content"]).to_parquet(f"{path}/train_norm_structured.parquet")
    return str(path)


def test_mining_covers_entries_without_a_component(spark, tmp_path):
    t = "2024-01-01 00:00:00"
    contents = ["Info: QueueWarden:: queue depth now 5", "queue depth now 6", "spool one busy", "Info: QueueWarden:: queue depth now 7", "spool two busy"]
    folder = _folder(tmp_path, [(i, t, c) for i, c in enumerate(contents)])
    got = {r["eventtemplate"]: r["occurrences"] for r in queries.q_mining(spark, folder).collect()}
    assert sum(got.values()) == len(contents) and got["spool <*> busy"] == 2


def test_channel_rows_of_sessions_over_many_blocks(spark, tmp_path):
    # five sessions, three of them long and mixed with each other, so that tables cross blocks of 64 lines
    log = pd.DataFrame({"lineid": range(1, 3001)})
    log["session_id"] = [n % 3 if n < 2900 else 3 + n % 2 for n in log["lineid"]]
    log = log.assign(file_id=1, time="", content="", eventid="e", eventtemplate="t", label=0, eventidold="o").astype({"file_id": "int32", "label": "int32"})
    log.to_parquet(f"{tmp_path}/train_norm_structured.parquet")
    want = []
    for f, x in log.groupby("session_id"):
        numbers = sorted(x["lineid"])
        lines = [queries_logs.CONSOLE[int(hashlib.md5(str(n).encode()).hexdigest()[:6], 16) % len(queries_logs.CONSOLE)] for n in numbers]
        want += [(f, n, v) for n, v in zip(numbers, cm.rewrite(lines, cm.START)) if v and v[1:].startswith("S channel status")]
    got = queries_logs.q_cm_channels(spark, str(tmp_path))
    assert [tuple(r) for r in got.sort("file_id", "line_no").collect()] == want and want
    assert "InPandas" not in got._jdf.queryExecution().executedPlan().toString()


def test_queries_are_listed_before_there_is_a_session():
    # in a process of its own, as the session of the tests would hide a column that is made while a module is imported
    code = """
import importlib, pkgutil
import __spark_entry__ as e, timberline
for m in pkgutil.walk_packages(timberline.__path__, "timberline."):
    if not m.name.endswith("__main__"):
        importlib.import_module(m.name)
from pyspark import SparkContext
assert SparkContext._active_spark_context is None
assert set(e.oracle_sql()) <= set(e.queries())
print(*e.queries())
"""
    said = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr[-800:]
    assert {"p3_found", "p4_sessions", "q_mining", "q_folder_files"} <= set(said.stdout.split())
