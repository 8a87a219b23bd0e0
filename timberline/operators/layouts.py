"""Semi-structured log lines into entries of timestamp, level, component and message.

Every line is collapsed into a *shape signature*: quoted text, words, numbers and blanks become one character
each and the plain tail is cut to one mark, so that millions of lines share a few dozen signatures. Each distinct
signature is resolved to an extraction rule once; the table of them goes to all tasks (at most MAX_SIGNATURES
short rows; a signature beyond that is resolved by the same rules where it occurs). A batch then takes one
expression over all lines of a rule at once, with Arrow's compiled kernels. Rows that state no time, or are
indented, are attached backward to the entry before them by block-wise windows, so no group grows with the log.

Defined results: a row with null or blank content, or without a line number, is no entry and belongs to none; equal
copies of a line number count once, of unequal ones the one that starts an entry (then the greatest) is kept; a
continuing row with no entry before it starts one without a time; a head that fits no rule, or whose level word is
not known, is all message; an empty table gives no entry; further columns of the input are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions.times import time_millis, utc_text
from timberline.operators.islands import carried
from timberline.plans.shared import join_counted, materialise, ship

#: Rows of the signature table at most, and their length.
MAX_SIGNATURES = 20_000
MAX_SIGNATURE_LENGTH = 300
#: Blocks of 2**BLOCK_BITS line numbers, how many of them one task gets on average, and tasks at most (then larger ones).
BLOCK_BITS = 14
TASK_BLOCKS = 8
MAX_TASKS = 50_000

#: Spellings of the levels.
LEVELS = {
    "TRACE": ["T", "TRC", "TRACE"],
    "DEBUG": ["D", "DBG", "DEBUG"],
    "INFO": ["I", "INF", "INFO"],
    "NOTICE": ["N", "NTC", "NOTICE"],
    "WARNING": ["W", "WRN", "WARN", "WARNING"],
    "ERROR": ["E", "ERR", "ERROR"],
    "FATAL": ["F", "FTL", "FATAL", "CRIT", "CRITICAL"],
}

#: Keys of structured lines.
TIME_KEYS = ["t", "ts", "time", "at", "timestamp"]
LEVEL_KEYS = ["lvl", "level", "sev", "severity"]
COMPONENT_KEYS = ["comp", "component", "mod", "module", "unit"]
MESSAGE_KEYS = ["msg", "message", "text"]

BLANKS = " \t\r\n\f\x0b"
_DATE = r"\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])[T ](?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:[.,]\d{1,9})?(?: ?(?:Z|[+-]\d\d:?\d\d))?"

#: Form of the signature, and the expression that takes the line apart.
RULES = {
    "json": (r"^\{", ""),
    "pairs": (r"^a=", ""),
    "leveled": (r"^(?:9 9 )?a: a::", r"^(?:\d+ +\d+ +)?(?P<level>\w+): (?P<component>[\w.-]+)::[ \t]*(?P<message>.*)$"),
    "tagged_level": (r"^\[[^\]]*\] a a:", r"^\[[^\]]*\] +(?P<level>\w+) +(?P<component>[\w.-]+):[ \t]*(?P<message>.*)$"),
    "tagged": (r"^\[[^\]]*\] a:", r"^\[[^\]]*\] +(?P<component>[\w.-]+):[ \t]*(?P<message>.*)$"),
    "worker": (r"^a \[[^\]]*\]", r"^(?P<level>\w+) +\[[^\]]*\] +(?P<component>[\w.-]+) +-[ \t]+(?P<message>.*)$"),
    "program": (r"^9-9-9", rf"^(?P<time>{_DATE}) +(?P<component>[\w.-]+?)(?:\[\d+\])?:? +<(?P<level>\w+)>[ \t]*(?P<message>.*)$"),
    "pipe_pid": (r"^a\|a\|9\|", r"^(?P<level>\w+)\|(?P<component>[\w.-]+)\|\d+\|(?P<message>.*)$"),
    "pipe": (r"^a\|a\|", r"^(?P<component>[\w.-]+)\|(?P<level>\w+)\|(?P<message>.*)$"),
}
FIELDS = ["time", "level", "component", "message"]

_LEVEL_OF = {word: level for level, words in LEVELS.items() for word in words}
_SPELLINGS = pa.array(sorted(_LEVEL_OF), pa.string())


def signatures(lines: pa.Array) -> pa.Array:
    """The shapes of lines: quoted text to ", words to a, numbers to 9, blanks to one, the plain tail to ~."""
    s = pc.replace_substring_regex(lines, r'"[^"]*"', '"')
    s = pc.replace_substring_regex(s, r"[\p{L}_][\p{L}\p{N}_]*", "a")
    s = pc.replace_substring_regex(s, r"\p{N}[\p{L}\p{N}_]*", "9")
    s = pc.replace_substring_regex(s, r"[ \t]+", " ")
    return pc.replace_substring_regex(s, r"[a9 .,;!?/()_-]+$", "~")


#: Fields of a head as a signature shows them, with the expression for their text: a time, a word in brackets, another
#: bracket, a name, a number.
_HEAD_FIELDS = [
    ("time", r"9-9-9[^ |\]]*(?: 9:9:9[^ |\]]*)?(?: [+-]9)?", rf"(?P<time>{_DATE})"),
    ("boxed", r"\[a\]|<a>|\(a\)", r"[\[<(]NAME[\]>)]"),
    ("other", r"\[[^\]]*\]|<[^>]*>", r"(?:\[[^\]]*\]|<[^>]*>)"),
    ("name", r"a(?:[.-]a)*", "NAME"),
    ("number", r"9", r"\d+"),
]
#: What stands between fields; the plain tail of a signature may follow at once, with the blank before it.
_BETWEEN = re.compile(r" - | ?\| ?|:: ?|: |:(?=~)|, | |(?=\[|<|~)")


def infer(signature: str) -> str:
    """Expressions for a head that a signature shows, one per line; '' if it shows none.

    The head's first fields are read off the signature. One word in brackets, or between bars, or behind a time may be
    the level, one other name the component, and the message begins behind the later of both. Which word it is can't be
    seen from shapes: the expressions are tried in order, and one holds for a line if its level is one.
    """
    fields, at = [], 0
    while len(fields) < 6:
        kind, seen, text = next(((k, m, t) for k, p, t in _HEAD_FIELDS if (m := re.match(p, signature[at:]))), ("", None, ""))
        if seen is None:
            break
        sep = _BETWEEN.match(signature, at + seen.end())
        if sep is None:
            break
        fields.append((kind, text, sep.group() or signature[sep.end()]))
        at = sep.end()
    timed, out = any(k == "time" for k, _, _ in fields), []
    for i, (level, _, after_level) in enumerate(fields):
        barred = "|" in after_level or (i > 0 and "|" in fields[i - 1][2])
        if level != "boxed" and not (level == "name" and (barred or timed)):
            continue
        for j in sorted(range(len(fields)), key=lambda j: (abs(j - i), -j)):
            last = max(i, j)
            closed = fields[last][2] not in " ~[<" or fields[last][0] == "boxed"
            if j == i or fields[j][0] not in ("name", "boxed") or not closed or abs(j - i) > 2:
                continue
            line = "^"
            for k, (_, text, sep) in enumerate(fields[: last + 1]):
                name = r"(?P<level>\w+)" if k == i else r"(?P<component>[\w.-]*\w)" if k == j else r"[\w.-]+"
                line += text.replace("NAME", name) + (r"[ \t]*" if sep in "[<" else r"[ \t]+" if sep in " ~" else rf"[ \t]*{re.escape(sep.strip())}[ \t]*")
            out.append(line + r"(?P<message>.*)$")
    return "\n".join(out)


def resolve(signature: str) -> str:
    """The extraction rule of a signature: a form known by name, then inferred expressions; '' where the line is all message."""
    known = next((name for name, (form, _) in RULES.items() if re.match(form, signature)), "")
    return known if known in ("json", "pairs") else "\n".join(x for x in (known, infer(signature)) if x)


def first_lines(content: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(content, r"(?s)[\r\n].*$", "") if pc.any(pc.match_substring_regex(content, r"[\r\n]")).as_py() else content


def flat(text: pa.Array) -> pa.Array:
    """The lines of each text, each trimmed, joined by a comma and a blank; lines without text fall out."""
    t = pc.utf8_trim(text, BLANKS)
    return pc.replace_substring_regex(t, r"[ \t\f\v]*[\r\n][ \t\r\n\f\v]*", ", ")


def _pair(lines: pa.Array, unquoted: pa.Array, keys: list[str]) -> pa.Array:
    k = "|".join(keys)
    bare = pc.struct_field(pc.extract_regex(unquoted, rf'(?:^|[\s,])(?:{k})=(?P<v>[^\s"]+)'), "v")
    quoted = pc.struct_field(pc.extract_regex(lines, rf'(?:^|[\s,])(?:{k})="(?P<v>[^"\\]*(?:\\.[^"\\]*)*)"'), "v")
    return pc.coalesce(bare, pc.replace_substring_regex(quoted, r'\\(["\\])', r"\1"))


def _json(lines: pa.Array) -> list[pa.Array]:
    import json

    rows = []
    for line in lines.to_pylist():
        try:
            d = json.loads(line)
        except ValueError:
            d = None
        if not isinstance(d, dict):
            rows.append((None,) * 4)
            continue
        rows.append(tuple(next((str(d[k]) for k in keys if d.get(k) is not None), None) for keys in (TIME_KEYS, LEVEL_KEYS, COMPONENT_KEYS, MESSAGE_KEYS)))
    return [pa.array(list(c), pa.string()) for c in zip(*rows)]


def _extracted(lines: pa.Array, pattern: str) -> list[pa.Array]:
    found = pc.extract_regex(lines, pattern)
    names = [found.type.field(i).name for i in range(found.type.num_fields)]
    return [pc.struct_field(found, n) if n in names else pa.nulls(len(lines), pa.string()) for n in FIELDS]


def take_apart(rule: str, lines: pa.Array) -> list[pa.Array]:
    """Time, level, component and message of lines of one rule; null where a line hasn't got them."""
    if rule == "json":
        parts = _json(lines)
    elif rule == "pairs":
        unquoted = pc.replace_substring_regex(lines, r'"[^"]*"', '""')
        parts = [_pair(lines, unquoted, keys) for keys in (TIME_KEYS, LEVEL_KEYS, COMPONENT_KEYS, MESSAGE_KEYS)]
    elif rule:
        known, *inferred = rule.split("\n") if not rule.startswith("^") else ("", *rule.split("\n"))
        parts = _extracted(lines, RULES[known][1]) if known else [pa.nulls(len(lines), pa.string())] * 4
        for pattern in inferred:
            new = _extracted(lines, pattern)
            better = pc.and_(pc.is_null(parts[3]), pc.fill_null(pc.is_in(pc.utf8_upper(new[1]), value_set=_SPELLINGS), False))
            parts = [pc.if_else(better, a, b) for a, b in zip(new, parts)]
    else:
        parts = [pa.nulls(len(lines), pa.string())] * 4
    if rule in ("json", "pairs"):
        valid = pc.match_substring_regex(parts[0], rf"^(?:{_DATE}|\d{{13}}|\d{{10}})$")
        parts[0] = pc.if_else(pc.fill_null(valid, False), parts[0], pa.scalar(None, pa.string()))
    # a level word that is no level: the head isn't one
    words = pc.dictionary_encode(pc.utf8_upper(parts[1]))
    level = pa.array([_LEVEL_OF.get(w) for w in words.dictionary.to_pylist()], pa.string()).take(words.indices)
    good = pc.and_(pc.is_valid(parts[3]), pc.or_(pc.is_valid(level), pc.or_kleene(pc.is_null(parts[1]), pc.equal(parts[1], ""))))
    good = pc.fill_null(good, False)
    none = pa.scalar(None, pa.string())
    return [pc.if_else(good, x, none) for x in (parts[0], level, parts[2], parts[3])]


def parse_batch(b: pa.RecordBatch, rules: dict[str, str]) -> pa.RecordBatch:
    """Columns lineid, content, ts of a batch into lineid, starts, ts, stated, level, component, message."""
    content, timed = b.column("content"), pc.is_valid(b.column("ts"))
    indented = pc.match_substring_regex(content, r"^\s")
    lines = first_lines(content)
    shapes = pc.dictionary_encode(signatures(lines))
    names = pa.array([rules.get(s) if s in rules else resolve(s) for s in shapes.dictionary.to_pylist()], pa.string())
    rule = pc.if_else(indented, pa.scalar(""), names.take(shapes.indices))
    order, pieces = [], []
    for name in pc.unique(rule).to_pylist():
        at = pc.indices_nonzero(pc.equal(rule, name))
        order.append(at)
        pieces.append(take_apart(name, lines.take(at)))
    back = pc.sort_indices(pa.concat_arrays(order)) if order else pa.array([], pa.uint64())
    stated, level, component, message = ([pa.concat_arrays([p[k] for p in pieces]).take(back) for k in range(4)]) if order else [pa.array([], pa.string())] * 4
    starts = pc.and_(pc.invert(indented), pc.or_(timed, pc.is_valid(stated)))
    known = pc.and_(starts, pc.is_valid(message))
    longer = pc.less(pc.binary_length(lines), pc.binary_length(content))
    if pc.any(longer).as_py():
        rest = flat(pc.if_else(longer, pc.replace_substring_regex(content, r"^[^\r\n]*", "", max_replacements=1), ""))
    else:
        rest = pa.array([""] * len(content), pa.string())
    head = pc.utf8_trim(message, BLANKS)
    head = pc.if_else(pc.equal(rest, ""), head, pc.binary_join_element_wise(head, rest, ", "))
    text = pc.if_else(known, head, flat(content))
    blank = lambda x: pc.fill_null(pc.if_else(known, x, ""), "")
    return pa.RecordBatch.from_arrays(
        [b.column("lineid"), starts, b.column("ts"), pc.if_else(starts, stated, pa.scalar(None, pa.string())), blank(level), blank(component), text],
        ["lineid", "starts", "ts", "stated", "level", "component", "message"],
    )


def parse_lines(df: DataFrame, order: str = "lineid", time: str = "time", content: str = "content") -> DataFrame:
    """One row per row with text: lineid, starts, ts (milliseconds), level, component, message.

    ``starts`` tells whether the row begins an entry; of other rows the message is the whole text.
    """
    base = (
        df.select(F.col(order).cast("long").alias("lineid"), F.col(content).alias("content"), F.col(time).alias("time"))
        .where(F.col("lineid").isNotNull() & (F.btrim("content", F.lit(BLANKS)) != ""))
    )

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for b in batches:
            new = set(pc.unique(signatures(first_lines(b.column("content")))).to_pylist()) - seen
            if len(seen) < MAX_SIGNATURES:
                seen |= new
            yield pa.RecordBatch.from_arrays([pa.array([s for s in new if len(s) <= MAX_SIGNATURE_LENGTH], pa.string())], ["sig"])

    ship(df.sparkSession)
    found = base.select("content").mapInArrow(shapes, "sig string").distinct().limit(MAX_SIGNATURES).collect()
    rules = {r["sig"]: resolve(r["sig"]) for r in found}
    shared = df.sparkSession.sparkContext.broadcast(rules)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield parse_batch(b, shared.value)

    x = base.select("lineid", "content", time_millis(F.col("time")).alias("ts"))
    x = x.mapInArrow(parse, "lineid long, starts boolean, ts long, stated string, level string, component string, message string")
    return x.select("lineid", "starts", F.when(F.col("starts"), F.coalesce("ts", time_millis(F.col("stated")))).alias("ts"), "level", "component", "message")


def log_entries(df: DataFrame, order: str = "lineid", time: str = "time", content: str = "content") -> DataFrame:
    """Entries: lineid, lineid_last, ts_text, level, component, message. See the module's text for odd cases."""
    # parsed once and written: blocks are read from it first, then the rows
    rows = materialise(parse_lines(df, order, time, content).withColumn("block", F.shiftright("lineid", BLOCK_BITS)))
    began = F.when(F.col("starts"), F.col("lineid"))
    blocks = rows.groupBy("block").agg(F.min(began).alias("first_start"), F.max(began).alias("last_start"), F.min("lineid").alias("first_row"))
    blocks = materialise(blocks)
    n_blocks, very_first = blocks.agg(F.count(F.lit(1)), F.min("first_row")).first()
    # the latest entry that began before a block: asked at odd numbers, told at even ones behind the block
    told = blocks.select(F.lit(0).alias("all"), (2 * F.col("block") + 2).alias("at"), F.col("last_start").alias("start"), F.lit(None).cast("long").alias("block"), F.lit(None).cast("long").alias("first_start"))
    asked = blocks.select(F.lit(0).alias("all"), (2 * F.col("block") + 1).alias("at"), F.lit(None).cast("long").alias("start"), "block", "first_start")
    ahead = carried(told.unionByName(asked), "all", "at", F.col("start"), "carried").where("block IS NOT NULL")
    ahead = ahead.select("block", "first_start", F.coalesce("carried", F.lit(very_first).cast("long")).alias("ahead"))
    x = join_counted(rows, ahead, ["block"], rows=n_blocks)
    # rows before their block's first entry go where the entry ahead of them is
    early = F.coalesce(F.col("lineid") < F.col("first_start"), F.lit(True))
    x = x.select("lineid", "starts", "ts", "level", "component", "message", F.when(early, F.col("ahead")).alias("ahead"), F.when(early, F.shiftright("ahead", BLOCK_BITS)).otherwise(F.col("block")).alias("route"))
    parts = min(MAX_TASKS, math.ceil(n_blocks / TASK_BLOCKS))
    if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        x = x.repartition(parts, "route")
    w = Window.partitionBy("route").orderBy("lineid", F.desc("starts"), F.desc("ts"), F.desc("message"), F.desc("level"), F.desc("component"))
    x = x.select(
        "route", "lineid", "starts", "ts", "level", "component", "message", F.lag("lineid").over(w).alias("before"),
        F.coalesce(F.last(began, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("ahead")).alias("entry"),
    ).where(F.col("before").isNull() | (F.col("before") != F.col("lineid")))
    first = F.col("lineid") == F.col("entry")
    x = x.groupBy("route", "entry").agg(
        F.max("lineid").alias("lineid_last"),
        F.max(F.when(first, F.struct("ts", "level", "component", "message"))).alias("head"),
        F.collect_list(F.when(~first, F.struct("lineid", "message"))).alias("more"),
    )
    text = F.when(F.size("more") == 0, F.col("head.message")).otherwise(
        F.concat(F.col("head.message"), F.lit(", "), F.array_join(F.transform(F.array_sort("more"), lambda m: m["message"]), ", "))
    )
    return x.select(
        F.col("entry").alias("lineid"), "lineid_last", F.coalesce(utc_text(F.col("head.ts")), F.lit("")).alias("ts_text"), F.col("head.level").alias("level"),
        F.col("head.component").alias("component"), text.alias("message"),
    )


def entries_found(df: DataFrame) -> DataFrame:
    """The entries with the first eight hex digits of the MD5 of the message in its place."""
    return log_entries(df).select("lineid", "lineid_last", "ts_text", "level", "component", F.substring(F.md5("message"), 1, 8).alias("msg_id"))
