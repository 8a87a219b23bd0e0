"""The queries of this subpackage over a data folder, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm import distinctive, mixing, runs, subjects, subsequences, tokens
from timberline.plans.tables import log_records, table
from timberline.queries import time_sql

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return distinctive.outstanding_events(log_records(spark, folder)).select("session_id", "eventid")


def p1_scores(spark: SparkSession, folder: str) -> DataFrame:
    x = distinctive.session_scores(log_records(spark, folder))
    return x.select("session_id", "eventid", "tf", "length", "df", "collection_tf", "n_records", F.round("score", 6).alias("score"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    x = subsequences.session_patterns(log_records(spark, folder))
    return x.where(F.col("maximal") & (F.size("steps") >= 3)).select(F.array_join("steps", " ").alias("pattern"))


def p2_patterns(spark: SparkSession, folder: str) -> DataFrame:
    x = subsequences.session_patterns(log_records(spark, folder))
    return x.select(F.array_join("steps", " ").alias("pattern"), F.size("steps").alias("n_steps"), "sequences", "maximal")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return runs.session_runs(log_records(spark, folder)).select("session_id", "lineid_first", "lineid_last")


def p5_events(spark: SparkSession, folder: str) -> DataFrame:
    return runs.collapsed_sessions(log_records(spark, folder))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_documents(table(spark, folder, "documents"))


def p6_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The texts decoded from their ids, to be held against the texts themselves."""
    x = table(spark, folder, "documents").select("doc_id", tokens.token_ids(spark, F.col("text")).alias("ids"))
    return x.select("doc_id", F.md5(tokens.texts_of(spark, F.col("ids"))).alias("text_md5"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


def _subjects(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return subjects.assign(documents, subjects.train(documents, table(spark, folder, "subject_labels"), table(spark, folder, "subjects")))


def p7_limits(spark: SparkSession, folder: str) -> DataFrame:
    """Per target source the documents that can be drawn, and what must be nowhere: repeats beyond the cap, tokens beyond the
    budget, documents that are not the source's."""
    documents, targets = table(spark, folder, "documents"), table(spark, folder, "mix_targets")
    drawn, report = mixing.mix(documents, targets)
    have = documents.where("text <> ''").select("doc_id", mixing.source_name().alias("source")).distinct()
    x = have.join(drawn.select("doc_id", F.col("source").alias("drawn_as"), "times", "n_tokens"), "doc_id", "full")
    x = x.withColumn("source", F.coalesce("drawn_as", "source")).join(report.select("source", "max_repeat", "target_tokens"), "source", "right")
    x = x.groupBy("source", "max_repeat", "target_tokens").agg(
        F.count("doc_id").alias("documents"), F.count(F.when(F.col("times") > F.col("max_repeat"), 1)).alias("beyond_cap"), F.coalesce(F.sum(F.col("times") * F.col("n_tokens")), F.lit(0)).alias("tokens"),
    )
    return x.select("source", "documents", "beyond_cap", (F.col("tokens") > F.col("target_tokens")).cast("long").alias("beyond_budget"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _subjects(spark, folder)


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share of each subject in documents, and of those without any."""
    documents = table(spark, folder, "documents").select("doc_id")
    x = documents.join(_subjects(spark, folder), "doc_id", "left").groupBy(F.coalesce("subject", F.lit("none")).alias("subject")).agg(F.count_distinct("doc_id").alias("documents"))
    return x.select("subject", "documents", F.round(F.col("documents") / documents.distinct().count(), 6).alias("share"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_scores, p2_found, p2_patterns, p5_found, p5_events, p6_ids, p6_round_trip, p7_mix, p7_shares, p7_limits, p8_found, p8_shares)}


#: Distinct records that have an event, of sessions.
_RECORDS = """records AS (
  SELECT DISTINCT session_id, lineid, eventid FROM train_norm_structured
  WHERE session_id IS NOT NULL AND lineid IS NOT NULL AND trim(eventid) <> '')"""

_SCORES = f"""WITH {_RECORDS},
tf AS (SELECT session_id, eventid, count(*) AS tf FROM records GROUP BY ALL),
sized AS (SELECT *, CAST(sum(tf) OVER (PARTITION BY session_id) AS BIGINT) AS length FROM tf),
total AS (SELECT count(DISTINCT session_id) AS n, sum(tf) AS total FROM tf),
stats AS (SELECT eventid, count(*) AS df, CAST(sum(tf) AS BIGINT) AS collection_tf FROM tf GROUP BY ALL),
x AS (SELECT *, collection_tf / CAST(n AS DOUBLE) AS rate, tf * log2(1 + (total / CAST(n AS DOUBLE)) / length) AS tfn
      FROM sized JOIN stats USING (eventid), total)
SELECT session_id, eventid, tf, length, df, collection_tf, n AS n_records,
  round((log2(1 + rate) - tfn * log2(rate / (1 + rate))) / (tfn + 1), 6) AS score FROM x"""

_RUN_NUMBERS = f"""WITH r AS (
  SELECT DISTINCT session_id, lineid, eventid, {time_sql("time")} AS ts,
    nullif(regexp_replace(replace(lower(eventtemplate), '<*>', chr(1)), '[^\\p{{L}}\\p{{N}}\\x01]+', '', 'g'), '') AS said
  FROM train_norm_structured WHERE session_id IS NOT NULL AND lineid IS NOT NULL AND trim(eventid) <> ''),
m AS (SELECT *, coalesce(eventid = lag(eventid) OVER w, false) OR coalesce(said = lag(said) OVER w, false) AS same
      FROM r WINDOW w AS (PARTITION BY session_id ORDER BY lineid)),
g AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY lineid) AS run FROM m)"""

_RUNS = f"{_RUN_NUMBERS} SELECT session_id, min(lineid) AS lineid_first, max(lineid) AS lineid_last FROM g GROUP BY session_id, run HAVING count(*) >= 2"
_EVENTS = f"""{_RUN_NUMBERS} SELECT session_id, min(lineid) AS lineid_first, max(lineid) AS lineid_last, arg_min(eventid, lineid) AS eventid, count(*) AS n, max(ts) - min(ts) AS duration_ms
FROM g GROUP BY session_id, run"""

# all frequent patterns, level by level: the earliest end of each pattern in each session that holds it
_PATTERNS = f"""WITH RECURSIVE {_RECORDS}, total AS (SELECT count(DISTINCT session_id) AS n FROM records),
items AS (SELECT eventid FROM (SELECT eventid, count(DISTINCT session_id) AS c FROM records GROUP BY eventid), total WHERE c >= 0.04 * n AND c < 0.30 * n),
pos AS MATERIALIZED (SELECT session_id, lineid, eventid FROM records SEMI JOIN items USING (eventid)),
ends AS (SELECT [eventid] AS steps, session_id, min(lineid) AS e FROM pos GROUP BY ALL
  UNION ALL SELECT steps, session_id, e FROM (SELECT steps, session_id, e, count(*) OVER (PARTITION BY steps) AS c FROM (
    SELECT list_append(x.steps, p.eventid) AS steps, x.session_id, min(p.lineid) AS e FROM ends x JOIN pos p ON p.session_id = x.session_id AND p.lineid > x.e
    WHERE NOT list_contains(x.steps, p.eventid) GROUP BY ALL)) WHERE c >= (SELECT 0.04 * n FROM total)),
patterns AS (SELECT steps, count(*) AS sequences FROM ends GROUP BY steps),
held AS (SELECT DISTINCT list_filter(steps, lambda s, i: i <> k) AS steps FROM (SELECT steps, unnest(range(1, len(steps) + 1)) AS k FROM patterns WHERE len(steps) > 1)),
judged AS (SELECT array_to_string(patterns.steps, ' ') AS pattern, len(patterns.steps)::INT AS n_steps, sequences, held.steps IS NULL AS maximal FROM patterns LEFT JOIN held USING (steps))"""

_LIMITS = """WITH d AS (SELECT DISTINCT doc_id, regexp_replace(lower(trim(coalesce(source, ''))), '[\\s-]+', '_', 'g') AS source FROM documents WHERE text <> ''),
t AS (SELECT DISTINCT regexp_replace(lower(trim(source)), '[\\s-]+', '_', 'g') AS source FROM mix_targets WHERE source IS NOT NULL)
SELECT t.source, count(doc_id) AS documents, 0::BIGINT AS beyond_cap, 0::BIGINT AS beyond_budget FROM t LEFT JOIN d USING (source) GROUP BY t.source"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"""WITH {_RECORDS},
tf AS (SELECT session_id, eventid, count(*) AS tf FROM records GROUP BY ALL),
df AS (SELECT eventid, count(*) AS df FROM tf GROUP BY ALL)
SELECT session_id, eventid FROM tf JOIN df USING (eventid)
WHERE tf >= 3 AND df < 0.03 * (SELECT count(DISTINCT session_id) FROM tf)""",
        "p1_scores": _SCORES,
        "p2_found": f"{_PATTERNS} SELECT pattern FROM judged WHERE maximal AND n_steps >= 3",
        "p2_patterns": f"{_PATTERNS} SELECT pattern, n_steps, sequences, maximal FROM judged",
        "p5_found": _RUNS,
        "p5_events": _EVENTS,
        "p7_limits": _LIMITS,
        "p6_round_trip": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents",
    }
