"""The queries of the core over a data folder, and the SQL that says the same.

The log queries run over the distinct records of train_norm_structured (one lineid is one record), the window queries
over the events table (groups are users, time is microseconds).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timberline.functions import text
from timberline.functions.times import time_millis
from timberline.logtypes import FTP
from timberline.logtypes.base import CTIME, IPV4, MAC
from timberline.logtypes.ftp import common_response
from timberline.models import bayes, scores
from timberline.operators import context, features, heads, layouts, matrix, mining, normalise, rules, sequences, tools, vocabulary, wash, windows
from timberline.operators.rules import Context, Rule, RuleBook
from timberline.plans.shared import materialise
from timberline.plans.tables import log_records, table
from timberline.sources import readers

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Vocabulary places, window size and step (microseconds), sequence width, rank that is still normal, context width.
SIZE, SPAN, STEP, WIDTH, TOP, NEAR = 500, 6 * 3_600_000_000, 2 * 3_600_000_000, 3, 5, 3


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, with the SQL that says the same if there is one."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def time_sql(c: str) -> str:
    """SQL for a stated time in milliseconds: ISO, 13 digits, compact in brackets, or as web servers write it."""
    web = f"""epoch_ms(strptime(substr({c}, 1, 20), '%d/%b/%Y:%H:%M:%S')) + coalesce(try_cast(nullif(regexp_extract({c}, '^[^ ]*[.]([0-9]{{3}}) ', 1), '') AS BIGINT), 0)
  - (CASE WHEN regexp_matches({c}, ' -[0-9]{{4}}$') THEN -60000 ELSE 60000 END) * (60 * substr(right({c}, 4), 1, 2)::BIGINT + right({c}, 2)::BIGINT)"""
    return f"""CASE WHEN regexp_matches({c}, '^[0-9]{{4}}-') THEN epoch_ms({c}::TIMESTAMP) WHEN regexp_matches({c}, '^[0-9]{{13}}$') THEN try_cast({c} AS BIGINT)
  WHEN regexp_matches({c}, '^[[][0-9]{{8}}-') THEN epoch_ms(strptime({c}, '[%Y%m%d-%H:%M:%S.%g]')) WHEN regexp_matches({c}, '^[0-9]{{2}}/') THEN {web} END"""


# ---- relations that several queries start from

_COLUMNS = ["file_id", "session_id", "lineid", "time", "content", "eventid", "eventtemplate", "label"]
_REC = "rec AS (SELECT file_id, session_id, lineid, time, content, eventid, eventtemplate, label, max(eventidold) AS eventidold FROM train_norm_structured GROUP BY ALL)"


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct records; of copies that differ in the old id the greatest counts."""
    return log_records(spark, folder).groupBy(*_COLUMNS).agg(F.max("eventidold").alias("eventidold"))


#: A content without the process numbers and level in front, which then has the words of its template.
_BARE = r"^(?:\d+ \d+ )?[A-Z][a-z]+: "
_TEMPLATED = rf"""templated AS (SELECT * REPLACE (regexp_replace(content, '{_BARE}', '') AS content) FROM rec WHERE eventid IS NOT NULL AND content IS NOT NULL)"""


def templated(spark: SparkSession, folder: str) -> DataFrame:
    return records(spark, folder).where("eventid IS NOT NULL AND content IS NOT NULL").withColumn("content", F.regexp_replace("content", _BARE, ""))


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Records as lines of their files: file_id, line_no, body."""
    return records(spark, folder).select("file_id", F.col("lineid").alias("line_no"), F.coalesce("content", F.lit("")).alias("body"))


_LINES = "lines AS (SELECT file_id, lineid AS line_no, coalesce(content, '') AS body FROM rec)"


def timed(spark: SparkSession, folder: str) -> DataFrame:
    """events: user_id, event_id, event_type, t (microseconds), label (1 for errors)."""
    # without the session's time zone: microseconds between two times that have none
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    return table(spark, folder, "events").select("user_id", "event_id", "event_type", micros.alias("t"), (F.col("event_type") == "error").cast("int").alias("label"))


_TIMED = "timed AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS t, CAST(event_type = 'error' AS INT) AS label FROM events)"


@query(f"WITH {_REC} SELECT lineid, {time_sql('time')} AS millis FROM rec")
def q_times(spark: SparkSession, folder: str) -> DataFrame:
    """The stated times of all records, whatever form their program gave them."""
    return records(spark, folder).select("lineid", time_millis(F.col("time")).alias("millis"))


# ---- the training-data problems of the core


@query()
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return layouts.entries_found(log_records(spark, folder))


@query()
def p3_entries(spark: SparkSession, folder: str) -> DataFrame:
    return layouts.log_entries(log_records(spark, folder))


@query()
def p4_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return features.event_features(log_records(spark, folder), table(spark, folder, "template_lib"), "session_id")


@query()
def p4_files(spark: SparkSession, folder: str) -> DataFrame:
    return features.event_features(log_records(spark, folder), table(spark, folder, "template_lib"), "file_id")


def _long_features(entity: str) -> Query:
    """The wide table unpivoted again: one row per entity and type it has, which SQL can state."""

    def f(spark: SparkSession, folder: str) -> DataFrame:
        library = table(spark, folder, "template_lib")
        wide = features.event_features(log_records(spark, folder), library, entity)
        cells = F.array(*[F.struct(F.lit(t).alias("eventid"), F.col(f"n_{t}").alias("n"), F.col(f"last_{t}").alias("last"), F.col(f"chars_{t}").alias("chars")) for t in features.event_types(library)])
        return wide.select(entity, F.explode(cells).alias("c")).select(entity, "c.eventid", "c.n", "c.last", "c.chars").where("n > 0")

    return f


for _entity, _name in (("session_id", "p4_session_cells"), ("file_id", "p4_file_cells")):
    _QUERIES[_name] = _long_features(_entity)
    _SQL[_name] = f"""WITH {_REC}
    SELECT {_entity}, eventid, count(*) AS n, max(lineid) AS "last", CAST(sum(coalesce(length(content), 0)) AS BIGINT) AS chars
    FROM rec WHERE eventid IN (SELECT eventid FROM template_lib) GROUP BY ALL"""


def _totals(entity: str) -> Query:
    """Totals over all records, and how many types are counted 0 and have no last line."""

    def f(spark: SparkSession, folder: str) -> DataFrame:
        library = table(spark, folder, "template_lib")
        wide, types = features.event_features(log_records(spark, folder), library, entity), features.event_types(library)
        none = F.size(F.filter(F.array(*[F.col(f"n_{t}") for t in types]), lambda n: n == 0))
        unseen = F.size(F.filter(F.array(*[F.col(f"last_{t}") for t in types]), lambda n: n.isNull()))
        empty = F.size(F.filter(F.array(*[F.col(f"chars_{t}") for t in types]), lambda n: n.isNull()))
        return wide.select(entity, "records", "events", "last_line", "chars", "abnormal", none.alias("types_none"), unseen.alias("types_unseen"), empty.alias("null_totals"))

    return f


for _entity, _name in (("session_id", "p4_session_totals"), ("file_id", "p4_file_totals")):
    _QUERIES[_name] = _totals(_entity)
    _SQL[_name] = f"""WITH {_REC}, lib AS (SELECT DISTINCT eventid FROM template_lib WHERE trim(eventid) <> '')
    SELECT {_entity}, count(*) AS records, count(lib.eventid) AS events, max(lineid) AS last_line, CAST(sum(coalesce(length(content), 0)) AS BIGINT) AS chars, CAST(sum(coalesce(label, 0)) AS BIGINT) AS abnormal,
      ((SELECT count(*) FROM lib) - count(DISTINCT lib.eventid))::INT AS types_none, ((SELECT count(*) FROM lib) - count(DISTINCT lib.eventid))::INT AS types_unseen, 0 AS null_totals
    FROM rec LEFT JOIN lib USING (eventid) WHERE {_entity} IS NOT NULL GROUP BY {_entity}"""


# ---- sources


@query("""SELECT doc_id AS file_id, u.n AS line_no, u.v AS "value" FROM (
  SELECT doc_id, unnest(list_transform(string_split_regex(coalesce(text, ''), '\\r?\\n'), lambda x, i: {'n': i, 'v': x})) AS u FROM documents)""")
def q_line_explode(spark: SparkSession, folder: str) -> DataFrame:
    return readers.exploded_lines(table(spark, folder, "documents"), "doc_id", "text")


@query("""SELECT source_no, doc_id, "value", row_number() OVER (ORDER BY source_no, doc_id) AS line_id FROM (
  SELECT 0 AS source_no, doc_id, title AS "value" FROM documents UNION ALL SELECT 1, doc_id, text FROM documents)""")
def q_concat_ordered(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    return readers.concatenated([d.select("doc_id", F.col("title").alias("value")), d.select("doc_id", F.col("text").alias("value"))], ["doc_id"])


@query("SELECT file_id, nullif(regexp_extract(file_path, '(?:^|/)(c[0-9]{3})/', 1), '') AS class_label FROM log_files")
def q_class_paths(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "log_files").select("file_id", readers.class_of_path(F.col("file_path")).alias("class_label"))


@query(f"""WITH {_REC}, {_LINES} SELECT file_id, line_no, line_no = min(line_no) OVER (PARTITION BY file_id) AS session_start FROM lines""")
def q_session_starts(spark: SparkSession, folder: str) -> DataFrame:
    x = lines(spark, folder)
    first = x.groupBy("file_id").agg(F.min("line_no").alias("first"))
    return x.join(first, "file_id").select("file_id", "line_no", (F.col("line_no") == F.col("first")).alias("session_start"))


# ---- washing and normalising


@query(f"""WITH {_REC}, {_LINES},
p AS (SELECT *, max(CASE WHEN regexp_matches(body, '^( +|\\t+)') OR body = '' THEN 0 ELSE 1 END) OVER (PARTITION BY file_id ORDER BY line_no) AS seen FROM lines)
SELECT file_id, line_no, body FROM p WHERE seen = 1""")
def q_head_clean(spark: SparkSession, folder: str) -> DataFrame:
    return wash.clean_head(lines(spark, folder)).select("file_id", "line_no", "body")


@query(f"""WITH {_REC}, {_LINES},
k AS (SELECT *, regexp_matches(body, '^[ \\t]*$') AS gone, sum(CASE WHEN regexp_matches(body, '^[ \\t]*$') THEN 0 ELSE 1 END) OVER (PARTITION BY file_id ORDER BY line_no) AS kept FROM lines)
SELECT file_id, max(CASE WHEN NOT gone THEN line_no END) AS line_no, sum(CASE WHEN gone THEN 1 ELSE 0 END)::BIGINT AS empty_before
FROM (SELECT *, CASE WHEN gone THEN kept + 1 ELSE kept END AS g FROM k) GROUP BY file_id, g HAVING max(CASE WHEN NOT gone THEN line_no END) IS NOT NULL""")
def q_empty_runs(spark: SparkSession, folder: str) -> DataFrame:
    return wash.without_empty(lines(spark, folder)).select("file_id", "line_no", "empty_before")


@query(f"""WITH {_REC} SELECT lineid, regexp_replace(regexp_replace(regexp_replace(regexp_replace(content,
  '=([^= \\r\\n])', '= \\1', 'g'), '::([a-zA-Z_]{{3,}})', ':: \\1', 'g'), '\\(([\\w+-])', '( \\1', 'g'), '(\\w)\\)', '\\1 )', 'g') AS body FROM rec""")
def q_token_split(spark: SparkSession, folder: str) -> DataFrame:
    return records(spark, folder).select("lineid", text.split_apart(F.col("content"), FTP.split_left, FTP.split_right).alias("body"))


@query(f"""WITH {_REC}, r AS (SELECT lineid, 'Response: ' || (CASE lineid % 5 WHEN 0 THEN '211-' WHEN 1 THEN '213 ' WHEN 2 THEN '220 ' WHEN 3 THEN '421 ' ELSE '550 ' END) || content AS c FROM rec)
SELECT lineid, CASE WHEN c LIKE 'Response: 211_%' THEN 'Response: 211 System status, or system help' WHEN c LIKE 'Response: 213 %' THEN 'Response: 213 File status'
  WHEN c LIKE 'Response: 220 %' THEN 'Response: 220 FTP server is ready' WHEN c LIKE 'Response: 421 %' THEN 'Response: 421 Service not available, closing connection' ELSE c END AS body FROM r""")
def q_response_normalise(spark: SparkSession, folder: str) -> DataFrame:
    code = F.element_at(F.array(*[F.lit(x) for x in ("211-", "213 ", "220 ", "421 ", "550 ")]), (F.pmod(F.col("lineid"), F.lit(5)) + 1).cast("int"))
    return records(spark, folder).select("lineid", common_response(F.concat(F.lit("Response: "), code, F.col("content"))).alias("body"))


@query(f"""WITH {_REC}, {_LINES}, m AS (SELECT *, sum(CASE WHEN regexp_matches(body, '^( +|\\t+)') THEN 0 ELSE 1 END) OVER (PARTITION BY file_id ORDER BY line_no) AS g FROM lines),
r AS (SELECT *, row_number() OVER (PARTITION BY file_id, g ORDER BY line_no) AS k, count(*) OVER (PARTITION BY file_id, g) AS n FROM m WHERE g > 0)
SELECT file_id, min(line_no) AS line_no, count(*)::INT AS lines, md5(string_agg(CASE WHEN n = 1 THEN body WHEN k = 1 THEN rtrim(body, chr(9) || ' ' || chr(10) || chr(13))
  WHEN k = n THEN ltrim(body, chr(9) || ' ' || chr(10) || chr(13)) ELSE trim(body, chr(9) || ' ' || chr(10) || chr(13)) END, ', ' ORDER BY line_no)) AS body FROM r GROUP BY file_id, g""")
def q_nested_join(spark: SparkSession, folder: str) -> DataFrame:
    return normalise.join_nested(lines(spark, folder)).withColumn("body", F.md5("body"))


@query(f"""WITH {_REC}, r AS (SELECT lineid, CASE WHEN label = 1 THEN 'abn: ' ELSE '' END || content AS c FROM rec)
SELECT lineid, CAST(c[1:5] = 'abn: ' AS INT) AS label, CASE WHEN c[1:5] = 'abn: ' THEN c[6:] ELSE c END AS content FROM r""")
def q_label_extract(spark: SparkSession, folder: str) -> DataFrame:
    c = F.concat(F.when(F.col("label") == 1, "abn: ").otherwise(""), F.col("content"))
    label, rest = normalise.label_of(c)
    return records(spark, folder).select("lineid", label.alias("label"), rest.alias("content"))


@query(f"""WITH {_REC}, s AS (SELECT file_id, lineid, sum(CASE WHEN eventtemplate LIKE '%greeted%' THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY lineid) AS session_no FROM rec)
SELECT file_id, session_no::BIGINT AS session_no, min(lineid) AS "first", count(*) AS n FROM s GROUP BY ALL""")
def q_session_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return normalise.session_sizes(records(spark, folder), "file_id", "lineid", F.col("eventtemplate").like("%greeted%"))


# ---- masks, tokens, templates

_MASKS = [(CTIME, "<*>"), (IPV4, "<*>"), (MAC, "<*>"), (r" \d+ ", " <*> ")]


def _masked_sql(c: str) -> str:
    for p, r in _MASKS:
        c = f"regexp_replace({c}, '{p}', '{r}', 'g')"
    return c


@query(f"WITH {_REC} SELECT lineid, {_masked_sql('content')} AS masked FROM rec")
def q_mask(spark: SparkSession, folder: str) -> DataFrame:
    return records(spark, folder).select("lineid", text.mask(F.col("content"), _MASKS).alias("masked"))


_FORMAT = r"^(.*?)\s+(.*?)\s+(.*?)$"


@query(f"""WITH {_REC}, r AS (SELECT lineid, time || ' ' || translate(content, chr(13) || chr(10), '  ') AS c FROM rec)
SELECT lineid, regexp_extract(c, '{_FORMAT}', 1) AS date_part, regexp_extract(c, '{_FORMAT}', 2) AS time_part, regexp_extract(c, '{_FORMAT}', 3) AS content_part FROM r WHERE regexp_matches(c, '{_FORMAT}')""")
def q_format_split(spark: SparkSession, folder: str) -> DataFrame:
    x = records(spark, folder).select("lineid", F.concat("time", F.lit(" "), F.translate("content", "\r\n", "  ")).alias("c"))
    return normalise.split_format(x, FTP.fields, "c").drop("c")


@query(f"""WITH {_REC} SELECT lineid, len(string_split_regex(trim(eventtemplate, ' '), '\\s+'))::INT AS n, string_split_regex(trim(eventtemplate, ' '), '\\s+')[1] AS head,
  regexp_extract(eventtemplate, '(\\S+\\s*)$', 1) AS tail FROM rec WHERE eventtemplate IS NOT NULL""")
def q_tokens(spark: SparkSession, folder: str) -> DataFrame:
    x = records(spark, folder).where("eventtemplate IS NOT NULL").select("lineid", text.tokens(F.col("eventtemplate")).alias("w"))
    return x.select("lineid", F.size("w").alias("n"), F.element_at("w", 1).alias("head"), F.element_at("w", -1).alias("tail"))


@query("SELECT eventid, md5(eventtemplate)[1:8] AS computed FROM template_lib")
def q_template_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "template_lib").select("eventid", text.template_id(F.col("eventtemplate")).alias("computed"))


@query(f"""WITH {_REC} SELECT md5(eventtemplate)[1:8] AS eventid, max(eventidold) AS eventidold, min(eventtemplate) AS eventtemplate, count(*) AS occurrences FROM rec WHERE eventtemplate IS NOT NULL GROUP BY 1""")
def q_template_occurrences(spark: SparkSession, folder: str) -> DataFrame:
    return mining.template_counts(records(spark, folder))


_PARAMS = """CASE WHEN len(string_split_regex(trim(content, ' '), '\\s+')) = len(string_split_regex(trim(eventtemplate, ' '), '\\s+')) THEN
  list_filter(string_split_regex(trim(content, ' '), '\\s+'), lambda x, i: contains(string_split_regex(trim(eventtemplate, ' '), '\\s+')[i], '<*>')) END"""
_WITH_PARAMS = f"{_REC}, {_TEMPLATED}, params AS (SELECT *, {_PARAMS} AS p FROM templated)"


@query(f"WITH {_WITH_PARAMS} SELECT lineid, array_to_string(p, '|') AS params FROM params")
def q_template_params(spark: SparkSession, folder: str) -> DataFrame:
    return templated(spark, folder).select("lineid", F.array_join(text.parameters(F.col("content"), F.col("eventtemplate")), "|").alias("params"))


@query(f"""WITH {_REC}, r AS (SELECT lineid, substr(coalesce(time, '') || ' ', 1, 24) AS h, eventtemplate AS t FROM rec WHERE eventtemplate IS NOT NULL),
cuts AS (SELECT lineid, h || t AS c, unnest(range(0, 51)) AS cut FROM r),
good AS (SELECT lineid, min(cut) AS cut, any_value(c) AS c FROM cuts WHERE cut < length(c) AND md5(substr(c, cut + 1))[1:8] IN (SELECT eventid FROM template_lib) GROUP BY lineid),
w AS (SELECT lineid, CASE WHEN cut = 0 THEN 0 ELSE strpos(c, string_split_regex(ltrim(substr(c, cut + 1), ' '), '\\s+')[1] || ' ') - 1 END AS width FROM good)
SELECT arg_min(width, lineid)::INT AS width, min(lineid) AS line FROM w WHERE width >= 0""")
def q_learn_width(spark: SparkSession, folder: str) -> DataFrame:
    head = F.substring(F.concat(F.coalesce("time", F.lit("")), F.lit(" ")), 1, 24)
    x = records(spark, folder).where("eventtemplate IS NOT NULL").select("lineid", F.concat(head, F.col("eventtemplate")).alias("c"))
    return heads.learn_width(x.withColumn("t", F.col("c")), table(spark, folder, "template_lib"), "lineid", "c", "t")


def _messages(spark: SparkSession, folder: str) -> DataFrame:
    """Component and message of each entry, as templates have them; of entries that state no component the message alone."""
    x = layouts.log_entries(log_records(spark, folder))
    stated = F.when(F.col("component") != "", F.concat("component", F.lit(":: "), "message"))
    return x.select("lineid", F.coalesce(stated, "message").alias("content"))


@query()
def q_mining(spark: SparkSession, folder: str) -> DataFrame:
    """Templates mined from the entries' messages; order-dependent clustering, which SQL can't state."""
    return mining.mine(_messages(spark, folder), FTP)[1]


@query()
def q_mining_on_library(spark: SparkSession, folder: str) -> DataFrame:
    return mining.mine(_messages(spark, folder), FTP, table(spark, folder, "template_lib"))[1]


# ---- rules and reports

_DRIFT = [f"{c}:: clock drift of <*> ms corrected" for c in ("BlobMover", "ClockAligner", "MapLoader")]
_QUEUE = "QueueWarden:: queue depth now <*>"


def _id(template: str) -> str:
    import hashlib

    return hashlib.md5(template.encode()).hexdigest()[:8]


#: Rules with parameters for the test log: a large drift is a warning, worse after a deep queue.
BOOK = RuleBook(
    [r for t in _DRIFT for r in (Rule(_id(t), "try_cast(p[0] AS INT) > 5000 AND ctx > 1000", "error", "Set the clock while the queue is short."), Rule(_id(t), "try_cast(p[0] AS INT) > 5000", "warning", "Set the clock."))],
    context=Context(_id(_QUEUE), "try_cast(p[0] AS INT) >= 0", "try_cast(p[0] AS INT)"),
)
_DRIFT_IDS = "(" + ", ".join(f"'{_id(t)}'" for t in _DRIFT) + ")"
_JUDGED = f"""{_WITH_PARAMS},
kb AS (SELECT eventid, max(severity) AS s, max(contxt) AS c, max(descpt) AS d FROM kb_no_para GROUP BY eventid),
ctx AS (SELECT *, coalesce(last_value(CASE WHEN eventid = '{_id(_QUEUE)}' AND try_cast(p[1] AS INT) >= 0 THEN try_cast(p[1] AS INT) END IGNORE NULLS)
  OVER (PARTITION BY file_id ORDER BY lineid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS ctx FROM params),
judged AS (SELECT ctx.*, CASE WHEN s IS NOT NULL THEN s WHEN eventid IN {_DRIFT_IDS} AND try_cast(p[1] AS INT) > 5000 AND ctx > 1000 THEN 'error'
  WHEN eventid IN {_DRIFT_IDS} AND try_cast(p[1] AS INT) > 5000 THEN 'warning' ELSE 'info' END AS severity, coalesce(c, true) AS has_context,
  CASE WHEN s IS NOT NULL THEN d WHEN eventid IN {_DRIFT_IDS} AND try_cast(p[1] AS INT) > 5000 AND ctx > 1000 THEN 'Set the clock while the queue is short.'
  WHEN eventid IN {_DRIFT_IDS} AND try_cast(p[1] AS INT) > 5000 THEN 'Set the clock.' END AS advice FROM ctx LEFT JOIN kb USING (eventid))"""


def judged(spark: SparkSession, folder: str) -> DataFrame:
    return rules.judged(templated(spark, folder), table(spark, folder, "kb_no_para"), BOOK)


@query(f"WITH {_REC} SELECT lineid, coalesce(k.severity, 'info') AS severity, coalesce(k.contxt, true) AS has_context, k.descpt AS advice FROM rec LEFT JOIN kb_no_para k USING (eventid) WHERE rec.eventid IS NOT NULL AND content IS NOT NULL")
def q_kb_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return rules.judged(templated(spark, folder), table(spark, folder, "kb_no_para")).select("lineid", "severity", "has_context", "advice")


@query(f"WITH {_JUDGED} SELECT lineid, severity, has_context, advice FROM judged WHERE eventid IN {_DRIFT_IDS}")
def q_kb_params(spark: SparkSession, folder: str) -> DataFrame:
    return judged(spark, folder).where(F.col("eventid").isin([_id(t) for t in _DRIFT])).select("lineid", "severity", "has_context", "advice")


@query(f"WITH {_JUDGED} SELECT severity, count(*) AS n, min(lineid) AS first_line FROM judged GROUP BY ALL")
def q_kb_context(spark: SparkSession, folder: str) -> DataFrame:
    return judged(spark, folder).groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.min("lineid").alias("first_line"))


@query(f"WITH {_JUDGED} SELECT lineid, coalesce(time, lineid::VARCHAR) AS place, severity, content AS description, advice FROM judged WHERE severity <> 'info'")
def q_expert_report(spark: SparkSession, folder: str) -> DataFrame:
    return rules.expert_report(judged(spark, folder))


@query(f"""WITH {_JUDGED}, a AS (SELECT advice, min(lineid) AS first_line FROM judged WHERE severity <> 'info' AND advice <> '' GROUP BY advice)
SELECT (row_number() OVER (ORDER BY first_line, advice))::INT AS "number", advice, first_line FROM a""")
def q_top_advice(spark: SparkSession, folder: str) -> DataFrame:
    return rules.top_advice(judged(spark, folder))


# ---- vocabularies

_STATIC = "voc AS (SELECT eventid, (row_number() OVER (ORDER BY md5(eventid || 'seed'), eventid) - 1)::INT AS idx FROM (SELECT DISTINCT eventid FROM template_lib))"
_VOCAB = f"""pool AS (SELECT DISTINCT eventid, 0 AS free FROM template_lib WHERE eventid <> '0' UNION ALL SELECT 'free' || i, 1 FROM range(0, {SIZE - 1}) r(i)),
taken AS (SELECT *, row_number() OVER (ORDER BY free, md5(eventid || 'seed'), eventid) AS k FROM pool),
vocab AS (SELECT CASE WHEN free = 1 THEN '0' ELSE eventid END AS eventid, (row_number() OVER (ORDER BY md5(eventid || 'seed'), eventid) - 1)::INT AS idx FROM taken WHERE k < {SIZE}
  UNION ALL SELECT 'ffffffff', {SIZE - 1})"""


@query(f"WITH {_VOCAB} SELECT eventid, idx FROM vocab")
def q_vocab(spark: SparkSession, folder: str) -> DataFrame:
    return vocabulary.build(table(spark, folder, "template_lib"), SIZE)


@query(f"WITH {_STATIC} SELECT eventid, idx FROM voc")
def q_vocab_static(spark: SparkSession, folder: str) -> DataFrame:
    return vocabulary.static(table(spark, folder, "template_lib"))


@query(f"""WITH {_VOCAB}, lacking AS (SELECT eventid AS new, row_number() OVER (ORDER BY md5(eventid || 'seed'), eventid) AS k FROM (SELECT DISTINCT md5(event_type)[1:8] AS eventid FROM events) WHERE eventid NOT IN (SELECT eventid FROM vocab)),
free AS (SELECT idx, row_number() OVER (ORDER BY md5(idx::VARCHAR || 'seed'), idx) AS k FROM vocab WHERE eventid = '0')
SELECT coalesce(new, eventid) AS eventid, idx FROM vocab LEFT JOIN (SELECT idx, new FROM free JOIN lacking USING (k)) USING (idx)""")
def q_vocab_insert(spark: SparkSession, folder: str) -> DataFrame:
    new = table(spark, folder, "events").select(F.substring(F.md5("event_type"), 1, 8).alias("eventid"))
    return vocabulary.insert(vocabulary.build(table(spark, folder, "template_lib"), SIZE), new)


@query(f"""WITH {_VOCAB}, changed AS (SELECT eventidold AS eventid, min(eventid) AS new FROM template_lib WHERE eventidold IS NOT NULL AND eventidold <> '0' AND eventidold <> eventid GROUP BY 1)
SELECT coalesce(new, vocab.eventid) AS eventid, idx FROM vocab LEFT JOIN changed USING (eventid)""")
def q_vocab_rename(spark: SparkSession, folder: str) -> DataFrame:
    library = table(spark, folder, "template_lib")
    return vocabulary.rename(vocabulary.build(library, SIZE), library)


@query(f"WITH {_REC} SELECT eventid, count(*) AS records FROM rec WHERE eventid IS NOT NULL AND eventid NOT IN (SELECT eventid FROM kb_no_para) GROUP BY ALL")
def q_unknown_events(spark: SparkSession, folder: str) -> DataFrame:
    return vocabulary.unknown_events(records(spark, folder), table(spark, folder, "kb_no_para"))


@query(f"WITH {_REC}, {_VOCAB} SELECT lineid, coalesce(idx, {SIZE - 1}) AS idx FROM rec LEFT JOIN (SELECT * FROM vocab WHERE eventid <> '0') v USING (eventid) WHERE rec.eventid IS NOT NULL")
def q_event_index(spark: SparkSession, folder: str) -> DataFrame:
    v = vocabulary.build(table(spark, folder, "template_lib"), SIZE)
    return vocabulary.indexed(records(spark, folder).where("eventid IS NOT NULL"), v, SIZE - 1).select("lineid", "idx")


# ---- time windows and matrices


@query(f"WITH {_TIMED} SELECT user_id, event_id, t - min(t) OVER (PARTITION BY user_id) AS elapsed FROM timed")
def q_elapsed(spark: SparkSession, folder: str) -> DataFrame:
    return windows.elapsed(timed(spark, folder), "user_id", "t").select("user_id", "event_id", "elapsed")


def _windows(spark: SparkSession, folder: str) -> DataFrame:
    return windows.sliding_windows(timed(spark, folder), "user_id", "t", SPAN, STEP)


# the next window's start and the end of a window, per distinct time, then the chain from the first
_CHAIN = f"""{_TIMED}, d AS (SELECT DISTINCT user_id, t FROM timed), top AS (SELECT user_id, min(t) AS a, max(t) AS z FROM d GROUP BY user_id),
nx AS (SELECT user_id, t, min(t) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN {STEP} FOLLOWING AND UNBOUNDED FOLLOWING) AS further, max(t) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN CURRENT ROW AND {SPAN} FOLLOWING) AS end_t FROM d),
chain AS (SELECT user_id, 0::BIGINT AS window_no, a AS start_t, nx.end_t, nx.further, z FROM top JOIN nx USING (user_id) WHERE nx.t = a
  UNION ALL SELECT c.user_id, c.window_no + 1, n.t, n.end_t, n.further, c.z FROM chain c JOIN nx n ON n.user_id = c.user_id AND n.t = c.further WHERE c.end_t < c.z)"""
_MEMBERS = f"""{_CHAIN}, members AS (SELECT r.*, c.window_no FROM timed r JOIN chain c ON r.user_id = c.user_id AND r.t BETWEEN c.start_t AND c.end_t)"""
_CELLS = f"{_MEMBERS}, cells AS (SELECT user_id, window_no, event_type, count(*) AS n FROM members GROUP BY ALL), total AS (SELECT count(*)::DOUBLE AS n_windows FROM chain)"


@query(f"WITH RECURSIVE {_CHAIN} SELECT user_id, window_no, start_t, end_t FROM chain")
def q_sliding_windows(spark: SparkSession, folder: str) -> DataFrame:
    return _windows(spark, folder)


def _members(spark: SparkSession, folder: str, w: DataFrame | None = None) -> DataFrame:
    return windows.window_records(timed(spark, folder), _windows(spark, folder) if w is None else w, "user_id", "t", SPAN)


@query(f"WITH RECURSIVE {_MEMBERS} SELECT user_id, window_no, max(label) AS label, count(*) AS records FROM members GROUP BY ALL")
def q_window_labels(spark: SparkSession, folder: str) -> DataFrame:
    return windows.window_labels(_members(spark, folder), "user_id", "label")


def _cells(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """The cells, and the number of windows; windows and cells are written once, as several steps read them."""
    w = materialise(_windows(spark, folder))
    return materialise(matrix.count_matrix(_members(spark, folder, w), ["user_id", "window_no"], "event_type")), w.count()


@query(f"WITH RECURSIVE {_CELLS} SELECT * FROM cells")
def q_ecm(spark: SparkSession, folder: str) -> DataFrame:
    return matrix.count_matrix(_members(spark, folder), ["user_id", "window_no"], "event_type")


_IDF = "idf AS (SELECT event_type, count(*) AS df, ln(any_value(n_windows) / (count(*) + 1e-8)) AS idf FROM cells, total GROUP BY event_type)"


@query(f"WITH RECURSIVE {_CELLS}, {_IDF} SELECT event_type, df, round(idf, 6) AS idf FROM idf")
def q_idf(spark: SparkSession, folder: str) -> DataFrame:
    return matrix.idf(*_cells(spark, folder), "event_type").withColumn("idf", F.round("idf", 6))


@query(f"WITH RECURSIVE {_CELLS}, {_IDF} SELECT user_id, window_no, event_type, round(n * idf, 6) AS value FROM cells JOIN idf USING (event_type)")
def q_tfidf(spark: SparkSession, folder: str) -> DataFrame:
    cells, n = _cells(spark, folder)
    x = matrix.tf_idf(cells, matrix.idf(cells, n, "event_type"), "event_type")
    return x.select("user_id", "window_no", "event_type", F.round("value", 6).alias("value"))


@query(f"""WITH RECURSIVE {_CELLS}, m AS (SELECT event_type, sum(n) / any_value(n_windows) AS mean FROM cells, total GROUP BY event_type)
SELECT user_id, window_no, event_type, round(n - mean, 6) AS centred FROM cells JOIN m USING (event_type)""")
def q_zero_mean(spark: SparkSession, folder: str) -> DataFrame:
    x = matrix.zero_mean(*_cells(spark, folder), "event_type")
    return x.select("user_id", "window_no", "event_type", F.round("centred", 6).alias("centred"))


@query(f"WITH RECURSIVE {_CELLS} SELECT user_id, window_no, event_type, round(1 / (1 + exp(-n)), 6) AS squashed FROM cells")
def q_sigmoid(spark: SparkSession, folder: str) -> DataFrame:
    return matrix.sigmoid(_cells(spark, folder)[0]).select("user_id", "window_no", "event_type", F.round("squashed", 6).alias("squashed"))


@query(f"WITH RECURSIVE {_MEMBERS} SELECT user_id, window_no, start_t, end_t FROM chain SEMI JOIN (SELECT user_id, window_no FROM members GROUP BY ALL HAVING max(label) = 1) USING (user_id, window_no)")
def q_anomaly_ranges(spark: SparkSession, folder: str) -> DataFrame:
    flagged = windows.window_labels(_members(spark, folder), "user_id", "label").where("label = 1")
    return windows.first_last_times(_windows(spark, folder), flagged, "user_id")


# ---- context features

_NEAR = f"""{_JUDGED}, pos AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY lineid) AS pos, severity <> 'info' AND p IS NOT NULL AS typical FROM judged),
near AS (SELECT *, coalesce(max(CASE WHEN typical AND has_context THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN {NEAR} PRECEDING AND {NEAR} FOLLOWING), 0) = 1 AS near,
  CASE severity WHEN 'fatal' THEN 3.0 WHEN 'error' THEN 3.0 WHEN 'warning' THEN 2.0 ELSE 1.0 END AS weight FROM pos),
own AS (SELECT session_id, eventid, count(*) AS n, coalesce(arg_max(weight, pos) FILTER (WHERE typical), 1.0)::DOUBLE AS weight FROM near WHERE typical OR near GROUP BY ALL),
span AS (SELECT session_id, least(max(pos) FILTER (WHERE typical) + {NEAR}, max(pos)) - greatest(min(pos) FILTER (WHERE typical) - {NEAR}, 1) + 1 AS full_span, count(*) FILTER (WHERE typical OR near) AS part_span FROM near GROUP BY ALL)"""


@query(f"WITH {_NEAR} SELECT session_id, eventid, weight AS value FROM own")
def q_context_bin(spark: SparkSession, folder: str) -> DataFrame:
    return context.binary_features(judged(spark, folder), "session_id", "lineid", NEAR)


@query(f"WITH {_NEAR} SELECT session_id, eventid, n, round(n / full_span + weight, 6) AS value FROM own JOIN span USING (session_id)")
def q_context_cnt_full(spark: SparkSession, folder: str) -> DataFrame:
    return context.count_features(judged(spark, folder), "session_id", "lineid", NEAR, "FULL").withColumn("value", F.round("value", 6))


@query(f"WITH {_NEAR} SELECT session_id, eventid, n, round(n / part_span + weight, 6) AS value FROM own JOIN span USING (session_id)")
def q_context_cnt_part(spark: SparkSession, folder: str) -> DataFrame:
    return context.count_features(judged(spark, folder), "session_id", "lineid", NEAR, "PART").withColumn("value", F.round("value", 6))


# ---- sequences


def _sequences(spark: SparkSession, folder: str) -> DataFrame:
    x = vocabulary.indexed(records(spark, folder).where("eventid IS NOT NULL"), vocabulary.static(table(spark, folder, "template_lib")))
    return sequences.event_sequences(x, "session_id", "lineid", WIDTH, "label")


_SEQ = f"""{_REC}, {_STATIC}, ev AS (SELECT session_id, lineid, idx, coalesce(label, 0) AS label FROM rec JOIN voc USING (eventid)),
sq AS (SELECT session_id, lineid, row_number() OVER w AS pos, list(idx) OVER (w ROWS BETWEEN {WIDTH} PRECEDING AND 1 PRECEDING) AS event_seq, idx AS target, max(label) OVER (w ROWS BETWEEN {WIDTH} PRECEDING AND CURRENT ROW) AS label
  FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY lineid)),
seqs AS (SELECT session_id, lineid, pos, array_to_string(event_seq, ' ') AS event_seq, target, label FROM sq WHERE pos > {WIDTH})"""


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("event_seq", F.array_join("event_seq", " "))


@query(f"WITH {_SEQ} SELECT session_id, lineid, pos, event_seq, target FROM seqs")
def q_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(_sequences(spark, folder).drop("label"))


@query(f"WITH {_SEQ} SELECT session_id, lineid, label FROM seqs")
def q_sequence_labels(spark: SparkSession, folder: str) -> DataFrame:
    return _sequences(spark, folder).select("session_id", "lineid", "label")


_RANKS = f"{_SEQ}, nx AS (SELECT event_seq, target, count(*) AS n FROM seqs GROUP BY ALL), ranks AS (SELECT *, (row_number() OVER (PARTITION BY event_seq ORDER BY n DESC, target))::INT AS rank FROM nx)"


@query(f"WITH {_RANKS} SELECT event_seq, target, n, rank FROM ranks WHERE rank <= {TOP}")
def q_next_event_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(sequences.ranked(sequences.next_event_counts(_sequences(spark, folder))).where(F.col("rank") <= TOP))


def _anomalies(spark: SparkSession, folder: str) -> DataFrame:
    x = _flat(_sequences(spark, folder))
    return sequences.rank_anomalies(x, sequences.ranked(sequences.next_event_counts(x)), 1)


_ANOMALIES = f"{_RANKS}, odd AS (SELECT session_id, lineid, label, rank, CASE WHEN rank > 1 THEN 1 ELSE 0 END AS anomalous FROM seqs JOIN ranks USING (event_seq, target))"


@query(f"WITH {_ANOMALIES} SELECT session_id, lineid, rank, anomalous FROM odd")
def q_seq_anomaly(spark: SparkSession, folder: str) -> DataFrame:
    return _anomalies(spark, folder).select("session_id", "lineid", "rank", "anomalous")


@query(f"""WITH {_ANOMALIES}, j AS (SELECT lineid, coalesce(k.severity, 'info') AS severity FROM rec LEFT JOIN kb_no_para k USING (eventid))
SELECT odd.lineid, CASE WHEN anomalous = 1 OR severity <> 'info' THEN 1 ELSE 0 END AS anomalous FROM odd JOIN j USING (lineid)""")
def q_param_anomaly(spark: SparkSession, folder: str) -> DataFrame:
    """A record that follows its sequence is still anomalous if its rule says so."""
    j = rules.judged(records(spark, folder), table(spark, folder, "kb_no_para"))
    return sequences.parameter_anomalies(_anomalies(spark, folder), j).select("lineid", "anomalous")


# ---- models and scores


@query(f"""WITH {_ANOMALIES}, c AS (SELECT count(*) FILTER (WHERE label = 1 AND anomalous = 1) AS tp, count(*) FILTER (WHERE label <> 1 AND anomalous = 1) AS fp,
  count(*) FILTER (WHERE label <> 1 AND anomalous = 0) AS tn, count(*) FILTER (WHERE label = 1 AND anomalous = 0) AS fn FROM odd),
s AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM c)
SELECT tp, fp, tn, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM s""")
def q_confusion(spark: SparkSession, folder: str) -> DataFrame:
    x = scores.confusion(_anomalies(spark, folder), predicted="anomalous")
    return x.select("tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def _session_cells(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    r = records(spark, folder).where("eventid IS NOT NULL AND session_id IS NOT NULL")
    cells = r.groupBy("session_id", "eventid").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return cells, r.groupBy("session_id").agg(F.coalesce(F.max("label"), F.lit(0)).alias("label"))


_BAYES = f"""{_REC}, cells AS (SELECT session_id, eventid, count(*)::DOUBLE AS value FROM rec WHERE eventid IS NOT NULL AND session_id IS NOT NULL GROUP BY ALL),
inst AS (SELECT session_id, coalesce(max(label), 0) AS label FROM rec WHERE eventid IS NOT NULL AND session_id IS NOT NULL GROUP BY ALL),
n AS (SELECT label, count(*) AS n FROM inst GROUP BY label), total AS (SELECT sum(n)::DOUBLE AS total FROM n),
sums AS (SELECT label, eventid, sum(value) AS s, sum(value * value) AS ss FROM cells JOIN inst USING (session_id) GROUP BY ALL),
st AS (SELECT n.label, e.eventid, n.n, coalesce(s, 0.0) AS s, coalesce(ss, 0.0) AS ss FROM n, (SELECT DISTINCT eventid FROM cells) e LEFT JOIN sums ON sums.label = n.label AND sums.eventid = e.eventid)"""


@query(f"WITH {_BAYES} SELECT label, eventid, n, s, ss FROM st")
def q_gnb_stats(spark: SparkSession, folder: str) -> DataFrame:
    cells, instances = _session_cells(spark, folder)
    return bayes.statistics(cells, instances, event="eventid")


@query(f"""WITH {_BAYES}, whole AS (SELECT max(ss / total - (s / total) * (s / total)) AS top FROM (SELECT eventid, sum(s) AS s, sum(ss) AS ss FROM st GROUP BY eventid), total),
model AS (SELECT label, eventid, n / total AS prior, s / n AS mean, greatest(ss / n - (s / n) * (s / n), 0) + greatest(1e-9 * top, 1e-12) AS var FROM st, total, whole),
base AS (SELECT label, ln(max(prior)) + sum(-0.5 * ln(2 * pi() * var) - mean * mean / (2 * var)) AS base FROM model GROUP BY label),
more AS (SELECT session_id, model.label, sum(mean * mean / (2 * var) - (value - mean) * (value - mean) / (2 * var)) AS more FROM cells JOIN model USING (eventid) GROUP BY ALL),
sc AS (SELECT session_id, base.label, base + more AS score FROM more JOIN base USING (label))
SELECT session_id, (row_number() OVER (PARTITION BY session_id ORDER BY score DESC, label))::INT AS k, label AS predicted FROM sc QUALIFY k = 1""")
def q_gnb_predict(spark: SparkSession, folder: str) -> DataFrame:
    cells, instances = _session_cells(spark, folder)
    model = bayes.fitted(bayes.statistics(cells, instances, event="eventid"), event="eventid")
    return bayes.predicted(cells, instances, model, event="eventid").select("session_id", F.lit(1).alias("k"), "predicted")


@query(f"""WITH {_REC}, c AS (SELECT eventid, class_label, count(*) AS n FROM rec JOIN log_files USING (file_id) WHERE eventid IS NOT NULL AND class_label <> '' GROUP BY ALL),
p AS (SELECT *, n / sum(n) OVER (PARTITION BY eventid) AS probability FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY eventid ORDER BY probability DESC, class_label) AS rank FROM p)
SELECT eventid, class_label, round(probability, 6) AS probability, rank::INT AS rank, class_desc FROM k LEFT JOIN classes_loglab USING (class_label) WHERE rank <= 3""")
def q_topk_classes(spark: SparkSession, folder: str) -> DataFrame:
    """The most probable classes of the files of each event, with their descriptions."""
    from timberline.models.estimators import top_classes

    files = table(spark, folder, "log_files").where("class_label <> ''").select("file_id", "class_label")
    c = records(spark, folder).where("eventid IS NOT NULL").join(files, "file_id").groupBy("eventid", "class_label").agg(F.count(F.lit(1)).alias("n"))
    p = c.withColumn("probability", F.col("n") / F.sum("n").over(Window.partitionBy("eventid"))).withColumn("class_index", F.col("class_label"))
    x = top_classes(p, ["eventid"], 3).join(F.broadcast(table(spark, folder, "classes_loglab")), "class_label", "left")
    return x.select("eventid", "class_label", F.round("probability", 6).alias("probability"), "rank", "class_desc")


def _fitted(name: str) -> Query:
    """A classifier of abnormal sessions fitted and applied: how sessions fall; there is no SQL for it."""

    def f(spark: SparkSession, folder: str) -> DataFrame:
        from timberline.models.estimators import estimator

        cells, instances = _session_cells(spark, folder)
        v = vocabulary.static(table(spark, folder, "template_lib"))
        size = v.count()
        data = matrix.vectors(vocabulary.indexed(cells, v), instances, ["session_id"], size, value="value")
        model = estimator(name, data.count()).fit(data)
        return model.transform(data).groupBy("label", F.col("prediction").cast("int").alias("predicted")).agg(F.count(F.lit(1)).alias("sessions"))

    return f


for _name in ("logistic", "tree"):
    _QUERIES[f"q_fit_{_name}"] = _fitted(_name)


# ---- tools


@query("""SELECT md5(text) AS text_md5, count(*) AS copies, array_to_string(list(doc_id ORDER BY doc_id), ' ') AS positions FROM documents GROUP BY text HAVING count(*) > 1""")
def q_dup_groups(spark: SparkSession, folder: str) -> DataFrame:
    x = tools.duplicate_groups(table(spark, folder, "documents"), ["text"], "doc_id")
    return x.select(F.md5("text").alias("text_md5"), "copies", F.array_join("positions", " ").alias("positions"))


@query("""SELECT md5(text) AS text_md5, n AS copies, doc_id FROM (SELECT text, doc_id, count(*) OVER (PARTITION BY text) AS n FROM documents WHERE text IS NOT NULL AND trim(text) NOT IN ('', '0')) WHERE n > 1""")
def q_dup_members(spark: SparkSession, folder: str) -> DataFrame:
    return tools.duplicate_members(table(spark, folder, "documents"), ["text"], "doc_id").select(F.md5("text").alias("text_md5"), "copies", "doc_id")


@query(f"WITH {_REC} SELECT lineid, coalesce(time, lineid::VARCHAR) AS place FROM rec WHERE eventid = '{_id(_QUEUE)}'")
def q_find_event(spark: SparkSession, folder: str) -> DataFrame:
    return tools.records_of(records(spark, folder), _id(_QUEUE))


@query(f"WITH {_REC} SELECT lineid, 1672531200000000 + 100000 * (row_number() OVER (ORDER BY lineid) - 1) AS micros FROM rec")
def q_synth_ts(spark: SparkSession, folder: str) -> DataFrame:
    return windows.synthetic_times(records(spark, folder).select("lineid"), "lineid", 1_672_531_200_000_000).select("lineid", "micros")


@query("SELECT eventidold, eventid, eventtemplate FROM template_lib ORDER BY eventid")
def q_sort_templates(spark: SparkSession, folder: str) -> DataFrame:
    return tools.sorted_library(table(spark, folder, "template_lib"))


