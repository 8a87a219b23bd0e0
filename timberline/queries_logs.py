"""Queries of the operators on raw logs, over logs made of the test tables, and the SQL that says the same.

The tables hold a structured log, not raw lines. So each query first writes its records as lines of some kind of log
(timestamps, labels, noise and blocks chosen by line number or by a hash of it), in the same way here and in SQL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timberline.logtypes import CM, FTP, cm
from timberline.logtypes.base import CTIME, IPV4, IPV6, MAC, SNMP_MIB
from timberline.operators import heads, mining, normalise, rules, wash
from timberline.functions import text
from timberline.plans.shared import join_counted
from timberline.plans.tables import table
from timberline.queries import _REC, query, records

# ---- lines of an FTP trace

_ONE_LINE = "translate(coalesce(content, ''), chr(13) || chr(10), '  ')"
#: Bodies by lineid % 17; the rest is the record's content.
_BODIES = {0: "Response: 220-Welcome to you", 1: "", 2: "Trace: CControlSocket::SendNextCommand() x=(1)", 5: "Status: Disconnected from server", 6: " \t", 7: "Response: 421 late"}

_RAW = f"""raw AS (SELECT file_id, lineid AS line_no, (CASE WHEN lineid % 13 = 0 THEN '' ELSE strftime(TIMESTAMP '2023-01-01' + to_seconds(lineid), '%Y-%m-%d %H:%M:%S ')
  || CASE WHEN label = 1 THEN 'abn: ' ELSE '' END || CASE WHEN lineid % 9 = 1 THEN 'segsign: ' ELSE '' END || CASE WHEN lineid % 11 = 1 THEN 'c00' || (lineid % 3) || ' ' ELSE '' END END)
  || CASE WHEN lineid % 4 = 0 THEN lineid || ' 1 ' ELSE '' END || CASE lineid % 17 {" ".join(f"WHEN {k} THEN '{v}'" for k, v in _BODIES.items())} WHEN 3 THEN '  ' || {_ONE_LINE} ELSE 'Status: ' || {_ONE_LINE} END AS "value" FROM rec)"""


def raw_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Records as lines of FTP traces: file_id, line_no, value."""
    n, content = F.col("lineid"), F.translate(F.coalesce("content", F.lit("")), "\r\n", "  ")
    stamp = F.timestamp_add("SECOND", n, F.lit("2023-01-01 00:00:00").cast("timestamp_ntz")).cast("string")
    labels = F.concat(
        F.when(F.col("label") == 1, "abn: ").otherwise(""), F.when(n % 9 == 1, "segsign: ").otherwise(""), F.when(n % 11 == 1, F.concat(F.lit("c00"), n % 3, F.lit(" "))).otherwise("")
    )
    body = F.when(n % 17 == 3, F.concat(F.lit("  "), content))
    for k, v in _BODIES.items():
        body = body.when(n % 17 == k, v)
    head = F.when(n % 13 == 0, "").otherwise(F.concat(stamp, F.lit(" "), labels))
    pid = F.when(n % 4 == 0, F.concat(n, F.lit(" 1 "))).otherwise("")
    return records(spark, folder).select("file_id", n.alias("line_no"), F.concat(head, pid, body.otherwise(F.concat(F.lit("Status: "), content))).alias("value"))


_HEADED = f"""{_REC}, {_RAW}, headed AS (SELECT file_id, line_no, "value"[1:19] AS ts_text, contains(h, 'abn: ') AS abnormal, contains(h, 'segsign: ') AS marked,
  nullif(regexp_extract(h, '(c[0-9]{{3}}) $', 1), '') AS class_label, "value"[length(h) + 1:] AS body
  FROM (SELECT *, regexp_extract("value", '^[0-9-]{{10}} [0-9:]{{8}} (abn: )?(segsign: )?(c[0-9]{{3}} )?', 0) AS h FROM raw) WHERE h <> '')"""


@query(f"WITH {_HEADED} SELECT * FROM headed")
def q_take_head(spark: SparkSession, folder: str) -> DataFrame:
    return wash.take_head(raw_lines(spark, folder), FTP)


@query(f"""WITH {_REC}, {_RAW} SELECT file_id, line_no, trim("value"[1:20]) AS ts_text, "value"[21:] AS body FROM raw
WHERE length("value") >= 20 AND regexp_matches("value"[1:20], '[0-5][0-9][^a-zA-Z0-9 ][0-5][0-9][^a-zA-Z0-9 ][0-5][0-9]')""")
def q_fixed_head(spark: SparkSession, folder: str) -> DataFrame:
    """Heads of a learnt width; what has no time in it goes."""
    return wash.take_head(raw_lines(spark, folder), FTP, 20).select("file_id", "line_no", "ts_text", "body")


def _split_sql(c: str, more: bool = True) -> str:
    c = f"regexp_replace(regexp_replace({c}, '=([^= \\r\\n])', '= \\1', 'g'), '::([a-zA-Z_]{{3,}})', ':: \\1', 'g')"
    return f"regexp_replace(regexp_replace({c}, '\\(([\\w+-])', '( \\1', 'g'), '(\\w)\\)', '\\1 )', 'g')"


_CLEANED = "regexp_replace(body, '(?i)[0-9]+ [0-9] ([A-Z][a-z]+: )', '\\1', 'g')"
_COMMON = """CASE WHEN c LIKE 'Response: 220-%' THEN 'Response: 220 FTP server is ready' WHEN c LIKE 'Response: 421 %' THEN 'Response: 421 Service not available, closing connection' ELSE c END"""
_WASHED = f"""{_HEADED}, top AS (SELECT file_id, min(line_no) AS first FROM headed WHERE NOT regexp_matches(body, '^( +|\\t+)') AND body <> '' GROUP BY file_id),
clean AS (SELECT headed.* EXCLUDE (body), {_COMMON} AS body, line_no >= coalesce(first, line_no + 1) AND NOT regexp_matches(c, '^[ \\t]*$') AS kept
  FROM (SELECT *, {_CLEANED} AS c FROM headed) headed LEFT JOIN top USING (file_id)),
given AS (SELECT *, CASE WHEN NOT kept THEN min(CASE WHEN kept THEN line_no END) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) END AS heir FROM clean),
lost AS (SELECT file_id, heir AS line_no, bool_or(marked) AS m, arg_max(class_label, line_no) FILTER (WHERE class_label IS NOT NULL) AS c FROM given WHERE heir IS NOT NULL GROUP BY ALL),
washed AS (SELECT file_id, line_no, ts_text, abnormal, marked OR coalesce(m, false) OR regexp_matches(b, '^(Trace: CControlSocket::[ ]?SendNextCommand\\(\\)|Trace: CRealControlSocket::[ ]?OnSocketError|Status: Disconnected from server$)') AS marked,
  coalesce(k.class_label, lost.c) AS class_label, b AS body FROM (SELECT *, {_split_sql("body")} AS b FROM clean WHERE kept) k LEFT JOIN lost USING (file_id, line_no))"""


@query(f"WITH {_WASHED} SELECT * FROM washed")
def q_wash_ftp(spark: SparkSession, folder: str) -> DataFrame:
    """Washing as a whole: heads, labels handed over, noise, responses, empty lines, words split, sessions marked."""
    return wash.wash(raw_lines(spark, folder), FTP)


@query(f"WITH {_WASHED} SELECT file_id, line_no, body FROM washed WHERE marked")
def q_session_marks(spark: SparkSession, folder: str) -> DataFrame:
    return wash.wash(raw_lines(spark, folder), FTP).where("marked").select("file_id", "line_no", "body")


_FIRST = 30_000


@query(f"""WITH {_REC}, {_RAW}, c AS (SELECT file_id, line_no, regexp_replace("value", '(?i)[0-9]+ [0-9] ([A-Z][a-z]+: )', '\\1', 'g') AS c FROM raw WHERE line_no <= {_FIRST})
SELECT file_id, line_no, {_split_sql("c")} AS body FROM c WHERE NOT regexp_matches(c, '^[ \\t]*$')""")
def q_wash_lite(spark: SparkSession, folder: str) -> DataFrame:
    """The short form of washing for learning a timestamp: so many first lines are what it is about."""
    return wash.wash(raw_lines(spark, folder), FTP, lite=True, max_line=_FIRST)


@query(f"""WITH {_WASHED}, m AS (SELECT *, NOT regexp_matches(body, '^( +|\\t+)') AS head, sum(CASE WHEN regexp_matches(body, '^( +|\\t+)') THEN 0 ELSE 1 END) OVER (PARTITION BY file_id ORDER BY line_no) AS g FROM washed),
j AS (SELECT file_id, g, count(*)::INT AS lines FROM m WHERE g > 0 GROUP BY ALL)
SELECT file_id, line_no, ts_text, abnormal::INT AS label, (sum(marked::INT) OVER (PARTITION BY file_id ORDER BY line_no))::BIGINT AS session_no, class_label, lines FROM m JOIN j USING (file_id, g) WHERE head""")
def q_normalise(spark: SparkSession, folder: str) -> DataFrame:
    """Records of washed lines with label, session and class of their first line."""
    x = normalise.normalise(wash.wash(raw_lines(spark, folder), FTP, text=False))
    return x.select("file_id", "line_no", "ts_text", "label", "session_no", "class_label", "lines")


# ---- lines of a cable modem's console

#: Lines of the console, one or more for each kind that the scan knows.
CONSOLE = [
    "| This image is built using remote flash as nonvol.", "Downloading LEAP image", ">>>AP dload time 3", ">>>>ChipID=0x33901", "Automatically stopping at console", ">>>AP dload time 4",
    "    tap values: 1 2", "=== Default Router List ===", "*****", "BCM33901", "RCC-> 5", "12*", "msg 0x12", "===== Read Leap AIF Status =====", "== Beginning initial ranging for Docsis UCID 3",
    "Using clamped minimum transmit power", "TCC ranging parameters specified power offset of 2", "MSG PDU: 4", "Load Address: 0x10", "Active Downstream Channel Diagnostics:", "  ----  ----", "  ----",
    "  1     2   308000000    y     y   34   4   Qam256", "  2     3   314000000    y     n   33   3   Qam6x", "  3     4   320000000    n     y   30   2   OFDM PLC", "  4     5   326000000    n     y   30   2   Zzz", "  5  6  7",
    "* indicates currently configured", "* indicates currently configured", "Active Upstream Channels:", "  1  2  3  4  38.5  17.8  5.12  TDMA  y", "  2  3  4  5  40.0  18.0  -  22.0  1.6  OFDMA  n",
    "  3  4  5  6  41.0  19.0  2.56  TDMA  3 yes", "  4  5  6  7  41.0  19.0  2.56  TDMA  3 q", "  sgid  size  member", "     US chan ID     Tx Power (dBmV)", "  Plant power is 3", " Reason = 5", "  nested words",
    "\tnested by tab", "  Ranging state info: x", "", "", "", "", "   ", "Logging event: up", "Scanning DS Channel 7",
]


def picked(order: Column, n: int, salt: str = "") -> Column:
    """A number from 0 to n - 1 by the hash of a line number."""
    return F.conv(F.substring(F.md5(F.concat(order.cast("string"), F.lit(salt))), 1, 6), 16, 10).cast("long") % n


def picked_sql(order: str, n: int, salt: str = "") -> str:
    return f"(('0x' || md5({order}::VARCHAR || '{salt}')[1:6])::BIGINT % {n})"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _listed(items: list[str]) -> str:
    return "[" + ", ".join(map(_quoted, items)) + "]"


def _strings(items: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in items])


def _is(kind: str) -> str:
    return f"regexp_matches(body, {_quoted(f'^(?:{cm.CLASSES[kind]})')}) AS is_{kind}"


_WORDS = "string_split_regex(trim(body), '\\s+')"
_DS = f"""(SELECT CASE WHEN len(w) < 8 OR m IS NULL THEN NULL ELSE 'DS channel status rxid ' || w[1] || ' dcid ' || w[2] || ' freq ' || w[3] || ' qam ' || w[4] || ' fec ' || w[5] || ' snr ' || w[6] || ' power ' || w[7] || ' mod ' || m END
  FROM (SELECT w, CASE WHEN r IN ('Qam64', 'Qam256', 'Unknown') THEN r WHEN r = 'OFDM PLC' THEN 'OFDM_PLC' WHEN r[4] = '6' THEN 'Qam64' WHEN r[4] = '2' THEN 'Qam256' WHEN r[1] = 'O' THEN 'OFDM_PLC' WHEN r[1] = 'U' THEN 'Unknown' END AS m
    FROM (SELECT {_WORDS} AS w, array_to_string({_WORDS}[8:], ' ') AS r)))"""
_US = f"""(SELECT CASE WHEN len(w) < 9 OR (w[7] = '-' AND len(w) < 11) OR t IS NULL THEN NULL ELSE 'US channel status txid ' || w[1] || ' ucid ' || w[2] || ' dcid ' || w[3] || ' rngsid ' || w[4] || ' power ' || w[5]
  || ' freqstart ' || w[6] || ' freqend ' || (CASE WHEN w[7] = '-' THEN w[8] ELSE w[6] END) || ' symrate ' || w[7 + o] || ' phytype ' || w[8 + o] || ' txdata ' || t END
  FROM (SELECT w, o, CASE WHEN r IN ('y', 'n') THEN r WHEN contains(r, ' ') AND string_split(r, ' ')[2][1] IN ('y', 'n') THEN string_split(r, ' ')[2][1] END AS t
    FROM (SELECT w, o, array_to_string(w[9 + o:], ' ') AS r FROM (SELECT {_WORDS} AS w, CASE WHEN {_WORDS}[7] = '-' THEN 2 ELSE 0 END AS o))))"""

# one line after the other: which case a line falls under, what becomes of it, and the state behind it
_SCAN = f"""{_REC}, con AS (SELECT session_id::INT AS file_id, lineid AS line_no, {_listed(CONSOLE)}[1 + {picked_sql("lineid", len(CONSOLE))}] AS body FROM rec WHERE session_id IS NOT NULL),
cl AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS n, {", ".join(_is(k) for k in cm.CLASSES)} FROM con),
rows_of AS MATERIALIZED (SELECT body, {_DS} AS ds, {_US} AS us FROM (SELECT DISTINCT body FROM con)),
st AS (SELECT DISTINCT file_id, 0::BIGINT AS n, 0::BIGINT AS line_no, '' AS block, '' AS tab, false AS hdr, false AS emp, 0 AS cnt, NULL::VARCHAR AS body FROM con
UNION ALL SELECT file_id, n, line_no, nblock, ntab, nhdr, void, CASE WHEN NOT void THEN cnt WHEN emp THEN least(2, cnt + 1) ELSE 1 END, CASE WHEN void THEN NULL ELSE out END
FROM (SELECT *, trim(coalesce(out, body), ' ' || chr(9)) = '' AS void,
  CASE WHEN arm = 1 THEN 'to_end' WHEN arm = 4 THEN 'to_primary' WHEN arm = 8 THEN 'indent' WHEN arm = 11 THEN 'indent_to_end' WHEN arm = 30 THEN 'table' WHEN arm IN (2, 5, 9, 12, 31) THEN '' ELSE block END AS nblock,
  CASE WHEN arm = 15 THEN 'ds' WHEN arm = 16 THEN 'us' WHEN arm = 20 THEN '' ELSE tab END AS ntab, CASE WHEN arm = 20 THEN false WHEN arm = 22 THEN true ELSE hdr END AS nhdr
  FROM (SELECT *, CASE WHEN arm IN (1, 3, 4, 6, 7, 15, 16, 22, 23, 30, 32, 33) THEN NULL WHEN arm IN (10, 12, 13, 14) THEN ' ' || body WHEN arm IN (34, 35) THEN ltrim(body, ' ' || chr(9)) WHEN arm = 25 THEN ds WHEN arm = 26 THEN us ELSE body END AS out
    FROM (SELECT cl.*, st.block, st.tab, st.hdr, st.emp, st.cnt, rows_of.ds, rows_of.us, CASE WHEN is_block_start THEN 1 WHEN block = 'to_end' THEN CASE WHEN is_block_end THEN 2 ELSE 3 END WHEN is_block_to_primary THEN 4
      WHEN block = 'to_primary' THEN CASE WHEN NOT is_nested AND cl.body <> '' THEN 5 ELSE 6 END WHEN is_dropped THEN 7 WHEN is_indent THEN 8 WHEN block = 'indent' THEN CASE WHEN cl.body = '' THEN 9 ELSE 10 END
      WHEN is_indent_to_end THEN 11 WHEN block = 'indent_to_end' THEN CASE WHEN is_indent_end THEN 12 ELSE 13 END WHEN is_to_nested THEN 14 WHEN is_ds_table THEN 15
      WHEN tab = 'ds' THEN CASE WHEN is_ds_end THEN 20 WHEN NOT is_nested AND cl.body <> '' THEN 21 WHEN is_rule THEN 22 WHEN NOT hdr THEN 23 WHEN cl.body = '' THEN 24 ELSE 25 END WHEN is_us_table THEN 16
      WHEN tab = 'us' THEN CASE WHEN is_us_end THEN 20 WHEN NOT is_nested AND cl.body <> '' THEN 21 WHEN is_rule THEN 22 WHEN NOT hdr THEN 23 WHEN cl.body = '' THEN 24 ELSE 26 END
      WHEN is_rule THEN 30 WHEN block = 'table' THEN CASE WHEN cl.body = '' THEN 31 ELSE 32 END WHEN is_title THEN 33 WHEN is_to_primary THEN 34 WHEN is_nested AND emp AND cnt >= 2 AND NOT is_stays_nested THEN 35 ELSE 36 END AS arm
      FROM st JOIN cl ON cl.file_id = st.file_id AND cl.n = st.n + 1 JOIN rows_of ON rows_of.body = cl.body)))),
scanned AS (SELECT file_id, line_no, body FROM st WHERE n > 0 AND body IS NOT NULL)"""


def console_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Records as lines of a console, a session as a file: file_id, line_no, body."""
    body = F.element_at(_strings(CONSOLE), (picked(F.col("lineid"), len(CONSOLE)) + 1).cast("int"))
    return records(spark, folder).where("session_id IS NOT NULL").select(F.col("session_id").cast("int").alias("file_id"), F.col("lineid").alias("line_no"), body.alias("body"))


@query(f"WITH RECURSIVE {_SCAN} SELECT * FROM scanned")
def q_cm_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The console's blocks, tables, indents and drops, line after line; in SQL one step per line of a session."""
    return cm.scan(console_lines(spark, folder))


@query(f"WITH RECURSIVE {_SCAN} SELECT * FROM scanned WHERE body LIKE '_S channel status%'")
def q_cm_channels(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the channel tables as records."""
    return cm.scan(console_lines(spark, folder), bits=6).where("body LIKE '_S channel status%'")


_NOISE = ["CM> ", "[00:00:01 01/01/2023] ", "[Receiver thread] ", "+++ ", "Logging event:  (CmThread/7) ", "words 00:00:01 01/01/2023  ", "cm/Ping> [01/02/2023 10:11:12] - ", ""]
_NOISY = f"noisy AS (SELECT lineid AS line_no, {_listed(_NOISE)}[1 + {picked_sql('lineid', len(_NOISE))}] || {_ONE_LINE} AS body FROM rec)"
_HMS = "([01][0-9]|2[0-3]):([0-5][0-9]):([0-5][0-9])"
_INNER = f"\\[?({_HMS}|24:00:00(.000)?) [0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}\\]?  ?"


@query(f"""WITH {_REC}, {_NOISY}, g AS (SELECT line_no, body, regexp_extract(body, '^(?s).{{2}}.*({_INNER}.*)$', 1) AS l FROM noisy),
k AS (SELECT line_no, CASE WHEN NOT regexp_matches(body, '^( +|\\t+)') AND NOT regexp_matches(body, '^ *----') AND l <> '' THEN l ELSE body END AS body FROM g)
SELECT line_no, regexp_replace(regexp_replace(body, '(?i)CM[/a-z_ -]*> |\\[?({_HMS}(.[0-9][0-9][0-9])?|24:00:00(.000)?) [0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}\\]?  ?|\\[[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}} ({_HMS}|24:00:00)\\] (- )?|\\[ ?[a-z][a-z0-9 -]*\\] |[+]{{3}} ', '', 'g'),
  '(?i):  \\([a-z0-9/ ]+\\) ', ':  ', 'g') AS body FROM k""")
def q_cm_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts, inner times, thread tags and class names off; of glued records the last one stays."""
    n = F.col("lineid")
    noise = F.element_at(_strings(_NOISE), (picked(n, len(_NOISE)) + 1).cast("int"))
    body = F.concat(noise, F.translate(F.coalesce("content", F.lit("")), "\r\n", "  "))
    return records(spark, folder).select(n.alias("line_no"), wash.cleaned(body, CM).alias("body"))


_ADDRESSES = [" 1.3.6.1.2.1 x", " fe80::1 y", " 10.0.0.1:80 z", " aa:bb:cc:dd:ee:ff", " a::", " 2001:db8:0:1:2:3:4:5/64 to", " Mon Jan 02 10:11:12 2023", " ::1"]
_CM_MASKS = [(CTIME, "<*>"), (SNMP_MIB, "<*>"), (IPV4, "<*>"), (IPV6, " <*>"), (MAC, "<*>")]


@query(f"""WITH {_REC} SELECT lineid, {reduce(lambda c, m: f"regexp_replace({c}, {_quoted(m[0])}, '{m[1]}', 'g')", _CM_MASKS, f"coalesce(content, '') || {_listed(_ADDRESSES)}[1 + {picked_sql('lineid', len(_ADDRESSES))}]")} AS masked FROM rec""")
def q_mask_addresses(spark: SparkSession, folder: str) -> DataFrame:
    """Times, object ids and addresses of all kinds, as consoles write them."""
    more = F.element_at(_strings(_ADDRESSES), (picked(F.col("lineid"), len(_ADDRESSES)) + 1).cast("int"))
    return records(spark, folder).select("lineid", text.mask(F.concat(F.coalesce("content", F.lit("")), more), _CM_MASKS).alias("masked"))


# ---- rules of the two kinds of logs

#: Words that the rules ask for, and some they don't.
_VALUES = [
    "n", "y", "0", "Abort", "Continue", "Qam64", "Qam256", "21", "27", "28", "16", "-16", "51", "17", "30", "FAILED", "550", "530", "incorrect.", "T2NoInitMaintTimeout", "T4NoStationMaintTimeout", "MaxT3NoRngRspTimeouts",
    "RngRspAbortStatus", "kT2NoInitMaint", "kT3NoRngRsp", "kCmIsUpstreamPartialService", "kCmIsNotUpstreamPartialService", "NoMddTimeout", "DsLockFail", "kCmEvDsOfdmProfLockFail", "kCmEvNonPriDsMddFail", "BogusUsTarget",
]
_CM_IDS = ["bd6df2e3", "2f06ae53", "6e45cf29", "33de59d1", "24b26703", "430b6239", "51c5ad8f", "755bd6ed", "ec4a6237", "89db902a", "81cbcac8", "b2079e76"]
_FTP_IDS = ["8b23502c", "52dbb961"]
_PLACES = 10


def _ruled(ids: list[str]) -> str:
    words = " || ' ' || ".join(f"{_listed(_VALUES)}[1 + {picked_sql('lineid', len(_VALUES), f'v{i}')}]" for i in range(_PLACES))
    return f"""{_REC}, ruled AS MATERIALIZED (SELECT file_id, lineid, {_listed(ids)}[1 + {picked_sql("lineid", len(ids), "id")}] AS eventid, string_split({words}, ' ') AS p FROM rec)"""


def _ruled_records(spark: SparkSession, folder: str, ids: list[str]) -> DataFrame:
    n = F.col("lineid")
    word = lambda i: F.element_at(_strings(_VALUES), (picked(n, len(_VALUES), f"v{i}") + 1).cast("int"))
    return records(spark, folder).select(
        "file_id", "lineid", F.element_at(_strings(ids), (picked(n, len(ids), "id") + 1).cast("int")).alias("eventid"), F.concat_ws(" ", *[word(i) for i in range(_PLACES)]).alias("content"),
        F.lit(" ".join(["<*>"] * _PLACES)).alias("eventtemplate"),
    )


def _judged(spark: SparkSession, folder: str, ids: list[str], book: rules.RuleBook) -> DataFrame:
    """Severity of each record, and how long its advice is."""
    x = rules.judged(_ruled_records(spark, folder, ids), table(spark, folder, "kb_no_para"), book)
    return x.select("lineid", "severity", F.coalesce(F.length("advice"), F.lit(0)).alias("advice_length"))


def _advice_length(book: rules.RuleBook, event: str, k: int) -> int:
    return len([r for r in book.rules if r.event == event][k].advice)


def _a(event: str, k: int) -> int:
    return _advice_length(rules.CM_RULES, event, k)


_FAIL4 = "CASE {c} WHEN 'T2NoInitMaintTimeout' THEN 1 WHEN 'T4NoStationMaintTimeout' THEN 2 WHEN 'MaxT3NoRngRspTimeouts' THEN 3 WHEN 'RngRspAbortStatus' THEN 4 END"
_REINIT_K = "CASE p[2] WHEN 'T4NoStationMaintTimeout' THEN 1 WHEN 'NoMddTimeout' THEN 2 WHEN 'NegOrBadRegRsp' THEN 3 WHEN 'MaxT3NoRngRspTimeouts' THEN 4 WHEN 'RngRspAbortStatus' THEN 5 WHEN 'BogusUsTarget' THEN 6 WHEN 'DsLockFail' THEN 7 WHEN 'T1NoUcdTimeout' THEN 8 END"


def _lengths(event: str) -> str:
    return "[" + ", ".join(str(len(r.advice)) for r in rules.CM_RULES.rules if r.event == event) + "]"


@query(f"""WITH {_ruled(_FTP_IDS)} SELECT lineid, CASE WHEN eventid = '8b23502c' OR (p[1] = '530' AND p[2] = 'incorrect.') THEN 'error' ELSE 'info' END AS severity,
CASE WHEN eventid = '8b23502c' THEN CASE WHEN p[1] = '550' THEN {_advice_length(rules.FTP_RULES, "8b23502c", 0)} ELSE {_advice_length(rules.FTP_RULES, "8b23502c", 1)} END
  WHEN p[1] = '530' AND p[2] = 'incorrect.' THEN {_advice_length(rules.FTP_RULES, "52dbb961", 0)} ELSE 0 END AS advice_length FROM ruled""")
def q_rules_ftp(spark: SparkSession, folder: str) -> DataFrame:
    return _judged(spark, folder, _FTP_IDS, rules.FTP_RULES)


@query(f"""WITH {_ruled(_CM_IDS)},
ctx AS (SELECT *, coalesce(last_value(CASE WHEN eventid = 'b2079e76' AND p[3] = 'Continue' THEN try_cast(p[2] AS INT) END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY lineid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS power FROM ruled),
r AS (SELECT *, p[4] = 'n' OR p[5] = 'n' AS unlocked, coalesce((p[8] = 'Qam64' AND try_cast(p[6] AS INT) <= 21) OR (p[8] = 'Qam256' AND try_cast(p[6] AS INT) <= 27), false) AS noisy, coalesce(abs(try_cast(p[7] AS INT)) > 15, false) AS off,
  coalesce(try_cast(p[5] AS DOUBLE) <= 17 OR try_cast(p[5] AS DOUBLE) >= 51, false) AS strong, {_FAIL4.format(c="p[4]")} AS f4, {_FAIL4.format(c="p[2]")} AS f2, {_REINIT_K} AS k FROM ctx)
SELECT lineid, CASE eventid WHEN 'bd6df2e3' THEN CASE WHEN off THEN 'warning' WHEN unlocked OR noisy THEN 'error' ELSE 'info' END WHEN '2f06ae53' THEN CASE WHEN p[1] = '0' THEN 'fatal' ELSE 'info' END
  WHEN '6e45cf29' THEN CASE WHEN p[10] = 'n' THEN 'error' WHEN strong THEN 'warning' ELSE 'info' END WHEN '33de59d1' THEN CASE WHEN p[2] = 'Abort' THEN 'error' ELSE 'info' END
  WHEN '24b26703' THEN CASE WHEN f4 IS NOT NULL THEN 'error' ELSE 'info' END WHEN '430b6239' THEN CASE WHEN f2 IS NOT NULL THEN 'error' ELSE 'info' END
  WHEN '51c5ad8f' THEN CASE p[3] WHEN 'kT2NoInitMaint' THEN 'error' WHEN 'kT3NoRngRsp' THEN 'warning' ELSE 'info' END
  WHEN '755bd6ed' THEN CASE p[3] WHEN 'kCmIsUpstreamPartialService' THEN 'warning' WHEN 'kCmIsNotUpstreamPartialService' THEN 'notice' ELSE 'info' END
  WHEN 'ec4a6237' THEN CASE WHEN k IS NULL THEN 'info' WHEN k = 2 THEN 'warning' ELSE 'fatal' END WHEN '89db902a' THEN CASE WHEN p[3] IN ('kCmEvDsOfdmProfNcpLockFail', 'kCmEvDsOfdmProfLockFail', 'kCmEvNonPriDsMddFail') THEN 'error' ELSE 'info' END
  WHEN '81cbcac8' THEN CASE WHEN p[1] IN ('FAILED', 'failed') THEN 'error' ELSE 'info' END ELSE 'info' END AS severity,
coalesce(CASE eventid WHEN 'bd6df2e3' THEN CASE WHEN unlocked THEN {_a("bd6df2e3", 0)} ELSE 0 END + CASE WHEN noisy THEN {_a("bd6df2e3", 1)} ELSE 0 END + CASE WHEN off THEN {_a("bd6df2e3", 2)} ELSE 0 END
  WHEN '2f06ae53' THEN CASE WHEN p[1] = '0' THEN {_a("2f06ae53", 0)} END WHEN '6e45cf29' THEN CASE WHEN strong THEN {_a("6e45cf29", 0)} ELSE 0 END + CASE WHEN p[10] = 'n' THEN {_a("6e45cf29", 1)} ELSE 0 END
  WHEN '33de59d1' THEN CASE WHEN p[2] = 'Abort' THEN CASE WHEN power >= 0 THEN {_a("33de59d1", 0)} ELSE {_a("33de59d1", 1)} END END WHEN '24b26703' THEN {_lengths("24b26703")}[f4] WHEN '430b6239' THEN {_lengths("430b6239")}[f2]
  WHEN '51c5ad8f' THEN CASE p[3] WHEN 'kT2NoInitMaint' THEN {_a("51c5ad8f", 0)} WHEN 'kT3NoRngRsp' THEN {_a("51c5ad8f", 1)} END
  WHEN '755bd6ed' THEN CASE p[3] WHEN 'kCmIsUpstreamPartialService' THEN {_a("755bd6ed", 0)} WHEN 'kCmIsNotUpstreamPartialService' THEN {_a("755bd6ed", 1)} END WHEN 'ec4a6237' THEN {_lengths("ec4a6237")}[k]
  WHEN '89db902a' THEN CASE WHEN p[3] IN ('kCmEvDsOfdmProfNcpLockFail', 'kCmEvDsOfdmProfLockFail') THEN {_a("89db902a", 0)} WHEN p[3] = 'kCmEvNonPriDsMddFail' THEN {_a("89db902a", 1)} END
  WHEN '81cbcac8' THEN CASE WHEN p[1] IN ('FAILED', 'failed') THEN {_a("81cbcac8", 0)} END END, 0)::INT AS advice_length FROM r""")
def q_rules_cm(spark: SparkSession, folder: str) -> DataFrame:
    return _judged(spark, folder, _CM_IDS, rules.CM_RULES)


# ---- torn records

_TORN = f"""{_REC}, lib AS (SELECT eventid, eventtemplate, row_number() OVER (ORDER BY eventid) - 1 AS k FROM template_lib), size AS (SELECT count(*) AS n FROM template_lib),
torn AS (SELECT session_id::INT AS file_id, lineid AS line_no, {picked_sql("lineid", 7, "kind")} AS kind, eventtemplate AS t FROM (SELECT session_id, lineid, {picked_sql("lineid", 100_000, "t")} % (SELECT n FROM size) AS k FROM rec WHERE session_id IS NOT NULL) r JOIN lib USING (k)),
rows_t AS (SELECT file_id, line_no, CASE WHEN kind < 4 THEN '0' ELSE 'known' END AS eventidold, CASE kind WHEN 0 THEN 'Lx ' || t WHEN 1 THEN 'Cab' || t WHEN 2 THEN 'Lost words ' || line_no WHEN 3 THEN 'tail <*> of ' || line_no ELSE t END AS t,
  row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS at FROM torn),
cuts AS (SELECT file_id, line_no, min(i) AS cut FROM (SELECT file_id, line_no, t, unnest(range(1, length(t))) AS i FROM rows_t WHERE eventidold = '0') WHERE md5(t[i + 1:])[1:8] IN (SELECT eventid FROM template_lib) GROUP BY ALL),
un AS MATERIALIZED (SELECT rows_t.*, cut, row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS k FROM rows_t LEFT JOIN cuts USING (file_id, line_no) WHERE eventidold = '0'),
st AS (SELECT DISTINCT file_id, 0::BIGINT AS k, 0::BIGINT AS line_no, NULL::VARCHAR AS pending, 0::BIGINT AS since, NULL::VARCHAR AS out FROM un
UNION ALL SELECT un.file_id, un.k, un.line_no, CASE WHEN pending IS NOT NULL OR t[1] NOT IN ('L', 'C') THEN NULL WHEN cut IS NULL THEN t WHEN md5(t[cut + 1:])[1:8] = 'b9c1fdb1' THEN t[1:cut - 1] ELSE t[1:cut] END, un.at,
  CASE WHEN pending IS NOT NULL THEN CASE WHEN un.at - since <= 20 THEN pending || t ELSE t END WHEN t[1] NOT IN ('L', 'C') THEN t WHEN cut IS NULL THEN NULL ELSE t[cut + 1:] END FROM st JOIN un ON un.file_id = st.file_id AND un.k = st.k + 1)"""


def torn_records(spark: SparkSession, folder: str) -> DataFrame:
    library = table(spark, folder, "template_lib")
    library = library.select(F.col("eventtemplate").alias("t"), (F.row_number().over(Window.orderBy("eventid")) - 1).cast("long").alias("k"))
    n, kind, size = F.col("lineid"), picked(F.col("lineid"), 7, "kind"), library.count()
    x = join_counted(records(spark, folder).where("session_id IS NOT NULL").withColumn("k", picked(n, 100_000, "t") % size), library, ["k"], rows=size)
    made = F.when(kind == 0, F.concat(F.lit("Lx "), "t")).when(kind == 1, F.concat(F.lit("Cab"), "t")).when(kind == 2, F.concat(F.lit("Lost words "), n)).when(kind == 3, F.concat(F.lit("tail <*> of "), n)).otherwise(F.col("t"))
    return x.select(F.col("session_id").cast("int").alias("file_id"), n.alias("line_no"), F.when(kind < 4, "0").otherwise("known").alias("eventidold"), made.alias("eventtemplate"))


@query(f"""WITH RECURSIVE {_TORN} SELECT file_id, line_no, eventidold, t AS eventtemplate FROM rows_t WHERE eventidold <> '0'
UNION ALL SELECT file_id, line_no, '0', out FROM st WHERE k > 0 AND out IS NOT NULL""")
def q_repair_torn(spark: SparkSession, folder: str) -> DataFrame:
    """Records torn by concurrent writers put together again, a session as a file."""
    return heads.repair_torn(torn_records(spark, folder), table(spark, folder, "template_lib"), CM)


# ---- mining of lines that are made of templates

_SHOWN = ["{n}", "unit{n}", "10.1.{n}.7", "part_{n}.dat", "0x{n}f"]


#: Templates that differ in blanks or letter case only are one: else their lines can't be told apart.
_PLAIN = "regexp_replace(trim(lower(eventtemplate), ' '), ' +', ' ', 'g')"
_MADE_OF = f"{_REC}, made AS (SELECT lineid, {_PLAIN} AS eventtemplate FROM rec WHERE eventid IS NOT NULL AND eventtemplate IS NOT NULL)"


def _plain(template: str) -> Column:
    return F.regexp_replace(F.trim(F.lower(template)), " +", " ")


def _filled_records(spark: SparkSession, folder: str) -> DataFrame:
    """Two lines for each record, made of its template with words for the wildcards: line_no, lineid, content."""
    x = records(spark, folder).where("eventid IS NOT NULL AND eventtemplate IS NOT NULL").select("lineid", _plain("eventtemplate").alias("t"))
    x = x.withColumn("line_no", F.explode(F.array(2 * F.col("lineid"), 2 * F.col("lineid") + 1)))
    n = F.col("line_no")
    shown = lambda i: F.replace(F.element_at(_strings(_SHOWN), ((i + F.crc32("t")) % len(_SHOWN) + 1).cast("int")), F.lit("{n}"), ((n * 7 + i * 31) % 251).cast("string"))
    return x.select("line_no", "lineid", F.array_join(F.transform(F.split("t", " "), lambda w, i: F.when(w == "<*>", shown(i)).otherwise(w)), " ").alias("content"))


@query(f"WITH {_MADE_OF} SELECT md5(eventtemplate)[1:8] AS eventidold, md5(eventtemplate)[1:8] AS eventid, eventtemplate, 2 * count(*) AS occurrences FROM made GROUP BY ALL")
def q_mining_known(spark: SparkSession, folder: str) -> DataFrame:
    """Lines made of templates, mined with a library of them: every line is given its template again."""
    log = records(spark, folder).where("eventtemplate IS NOT NULL").select(_plain("eventtemplate").alias("eventtemplate"))
    library = table(spark, folder, "template_lib").select(_plain("eventtemplate").alias("eventtemplate")).union(log).distinct()
    library = library.withColumn("eventid", text.template_id(F.col("eventtemplate")))
    return mining.mine(_filled_records(spark, folder), FTP, library, "line_no")[1].where("occurrences > 0")


@query(f"WITH {_MADE_OF} SELECT '0' AS eventidold, md5(eventtemplate)[1:8] AS eventid, eventtemplate, 2 * count(*) AS occurrences FROM made GROUP BY ALL")
def q_mining_anew(spark: SparkSession, folder: str) -> DataFrame:
    """The same lines mined without a library: the templates they are made of are found again, with their records."""
    return mining.mine(_filled_records(spark, folder), FTP, order="line_no")[1]


@query(f"WITH {_MADE_OF} SELECT lineid, md5(eventtemplate)[1:8] AS eventid, eventtemplate, 2::BIGINT AS lines FROM made")
def q_mining_records(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with the final templates of their clusters, and how many lines of each record have it."""
    x = _filled_records(spark, folder)
    assigned, _ = mining.mine(x, FTP, order="line_no")
    x = mining.structured(x.select("lineid", "content"), FTP, assigned)
    return x.groupBy("lineid", "eventid", "eventtemplate").agg(F.count(F.lit(1)).alias("lines"))
