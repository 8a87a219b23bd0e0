"""Rules on records: severity, whether the context counts, and advice.

Rules without parameters are a table, joined by event. Rules with parameters are rows of (event, condition, severity, advice)
in order, compiled to one CASE expression over the parameter array ``p`` and a context value ``ctx``: for an event either the
first rule that holds counts, or (``together``) all that hold, where the last gives the severity and the advice is joined.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions.text import parameters
from timberline.operators.islands import carried
from timberline.plans.shared import join_counted

#: Severities from worst to none, and their usual weights.
SEVERITIES = ["fatal", "error", "warning", "notice", "info"]
WEIGHTS = {"fatal": 3.0, "error": 3.0, "warning": 2.0, "notice": 1.0, "info": 1.0}


@dataclass(frozen=True)
class Rule:
    """If ``when`` (SQL on p and ctx) holds for a record of ``event``."""

    event: str
    when: str
    severity: str
    advice: str = ""


@dataclass(frozen=True)
class Context:
    """The latest ``value`` (SQL on p) of records of ``event`` for which ``when`` holds; ``initial`` before."""

    event: str
    when: str
    value: str
    initial: int = 0


@dataclass(frozen=True)
class RuleBook:
    rules: list[Rule] = field(default_factory=list)
    together: frozenset[str] = frozenset()
    context: Context | None = None

    def _by_event(self) -> dict[str, list[Rule]]:
        out: dict[str, list[Rule]] = {}
        for r in self.rules:
            out.setdefault(r.event, []).append(r)
        return out

    def severity(self) -> Column:
        """The severity that the rules with parameters give; null where none holds."""
        return self._case(lambda r: r.severity, last=True)

    def advice(self) -> Column:
        return self._case(lambda r: r.advice, last=False)

    def _case(self, value, last: bool) -> Column:
        out = F.lit(None).cast("string")
        for event, rules in self._by_event().items():
            whens = [(F.coalesce(F.expr(r.when), F.lit(False)), value(r)) for r in rules]
            if event in self.together and not last:
                mine = F.nullif(F.concat(*[F.when(c, v).otherwise("") for c, v in whens]), F.lit(""))
            else:
                mine = None
                for c, v in whens[::-1] if event in self.together else whens:
                    mine = F.when(c, v) if mine is None else mine.when(c, v)
            out = F.when(F.col("eventid") == event, mine).otherwise(out)
        return out


def judged(records: DataFrame, table: DataFrame, book: RuleBook | None = None, group: str = "file_id", order: str = "lineid") -> DataFrame:
    """Adds params, severity ('info' by default), has_context (true by default) and advice to records.

    The table's rules go first, as those without parameters; the book's context runs within each group.
    """
    book = book or RuleBook()
    known = table.where("eventid IS NOT NULL").groupBy("eventid").agg(F.max("severity").alias("_s"), F.max("contxt").alias("_c"), F.max("descpt").alias("_d"))
    x = join_counted(records.withColumn("params", parameters(F.col("content"), F.col("eventtemplate"))), known, ["eventid"], "left")
    x = x.withColumn("p", F.col("params"))
    if book.context:
        c = book.context
        hit = (F.col("eventid") == c.event) & F.coalesce(F.expr(c.when), F.lit(False))
        x = carried(x, group, order, F.when(hit, F.expr(c.value).cast("long")), "ctx")
        x = x.withColumn("ctx", F.coalesce("ctx", F.lit(c.initial)))
    else:
        x = x.withColumn("ctx", F.lit(0))
    severity = F.coalesce("_s", book.severity(), F.lit("info"))
    advice = F.when(F.col("_s").isNotNull(), F.col("_d")).otherwise(book.advice())
    return x.withColumns({"severity": severity, "has_context": F.coalesce("_c", F.lit(True)), "advice": advice}).drop("_s", "_c", "_d", "p", "ctx")


def expert_report(judged_records: DataFrame, where: str = "time") -> DataFrame:
    """Records that matter: lineid, place (time or line), severity, description, advice."""
    x = judged_records.where("severity <> 'info'")
    return x.select("lineid", F.coalesce(F.col(where).cast("string"), F.col("lineid").cast("string")).alias("place"), "severity", F.col("content").alias("description"), "advice")


def top_advice(judged_records: DataFrame) -> DataFrame:
    """Distinct advice in the order it is first given, numbered. One row per advice, few by nature."""
    x = judged_records.where("severity <> 'info' AND advice <> ''").groupBy("advice").agg(F.min("lineid").alias("first_line"))
    return x.select(F.row_number().over(Window.orderBy("first_line", "advice")).alias("number"), "advice", "first_line")


#: The rules of FTP traces.
FTP_RULES = RuleBook(
    [
        Rule("8b23502c", "try_cast(p[0] AS INT) = 550", "error", "Requested action not taken. File unavailable, e.g., file not found, no access."),
        Rule("8b23502c", "true", "error", "Not defined."),
        Rule("52dbb961", "try_cast(p[0] AS INT) = 530 AND p[1] = 'incorrect.'", "error", "Login incorrect."),
    ]
)

#: Advice that several rules of cable modem consoles share, and their reasons.
_NO_T2 = "CMTS does not broadcast ranging opportunities in MAPs, or this kind of MAPs cannot be received by CM."
_T4 = "Usually downstream or upstream has big issues and mac reset might happen."
_T3 = "Usually happens when the US channel is broken down. E.g. US RF cut, noise / distortion on US channel because of some external spliter / combiner / filter."
_ABORT = "Usually US attenuation is too high, low or other reasons that CMTS is not happy with the RNG-REQ."
_RANGING = [("T2NoInitMaintTimeout", _NO_T2), ("T4NoStationMaintTimeout", _T4), ("MaxT3NoRngRspTimeouts", _T3), ("RngRspAbortStatus", _ABORT)]
_REINIT = [
    ("T4NoStationMaintTimeout", "fatal", _T4),
    ("NoMddTimeout", "warning", "Usually CM scans and locks a non-primary DS channel. If every DS channel has this MDD timeout, most probably CMTS has issues. Then try to reboot CMTS."),
    ("NegOrBadRegRsp", "fatal", "Some incorrect settings on CM like diplexer might introduce the wrong values in REG-RSP."),
    ("MaxT3NoRngRspTimeouts", "fatal", "It usually happens when no unicast RNG-RSP on all US channels. E.g. upstream cable is broken."),
    ("RngRspAbortStatus", "fatal", "It usually happens when CMTS is not happy with RNG-REQ although NO T3 timeout on all US channels. E.g. US Tx power reaches the max or min."),
    ("BogusUsTarget", "fatal", "It usually happens when no usable UCDs exist."),
    ("DsLockFail", "fatal", "It usually happens when CM tries to lock DS but RF cut off."),
    ("T1NoUcdTimeout", "fatal", "It usually happens when no usable UCDs collected on CM."),
]

#: The rules of cable modem consoles.
CM_RULES = RuleBook(
    [
        Rule("bd6df2e3", "p[3] = 'n' OR p[4] = 'n'", "error", "Low power, big noise. QAM/FEC unlocked. "),
        Rule("bd6df2e3", "(p[7] = 'Qam64' AND try_cast(p[5] AS INT) <= 21) OR (p[7] = 'Qam256' AND try_cast(p[5] AS INT) <= 27)", "error", "Low power, noise or bad board design all contribute to low SNR. "),
        Rule("bd6df2e3", "abs(try_cast(p[6] AS INT)) > 15", "warning", "Adjust the attanuator on DS link. The DS power at 0dBmV is better. It is out of the +/-15dBmV range now."),
        Rule("2f06ae53", "p[0] = '0'", "fatal", "Cable disconnected, or no any signals on the cable."),
        Rule("6e45cf29", "try_cast(p[4] AS DOUBLE) <= 17 OR try_cast(p[4] AS DOUBLE) >= 51", "warning", "Adjust the attanuator on US link. The US Tx power within 20~50 dBmV is better. "),
        Rule("6e45cf29", "p[9] = 'n'", "error", "Data path on upstream is not OK."),
        Rule("33de59d1", "p[1] = 'Abort' AND ctx >= 0", "error", "Attanuation of upstream is large. Decrease the upstream attnuation."),
        Rule("33de59d1", "p[1] = 'Abort'", "error", "Attanuation of upstream is small. Increase the upstream attnuation."),
        *[Rule("24b26703", f"p[3] = '{v}'", "error", a) for v, a in _RANGING],
        *[Rule("430b6239", f"p[1] = '{v}'", "error", a) for v, a in _RANGING],
        Rule("51c5ad8f", "p[2] = 'kT2NoInitMaint'", "error", _NO_T2),
        Rule("51c5ad8f", "p[2] = 'kT3NoRngRsp'", "warning", "CMTS does not send back RNG-RSP or the RNG-REQ is not sent correctly from CM."),
        Rule("755bd6ed", "p[2] = 'kCmIsUpstreamPartialService'", "warning", "Some upstream channels are impaired or filtered."),
        Rule("755bd6ed", "p[2] = 'kCmIsNotUpstreamPartialService'", "notice", "Just recovered from upstream partial service."),
        *[Rule("ec4a6237", f"p[1] = '{v}'", s, a) for v, s, a in _REINIT],
        Rule("89db902a", "p[2] IN ('kCmEvDsOfdmProfNcpLockFail', 'kCmEvDsOfdmProfLockFail')", "error", "Usually downstream channel quality is poor."),
        Rule("89db902a", "p[2] = 'kCmEvNonPriDsMddFail'", "error", "CM cannot receive MDD on non-primary DS. Either CMTS does not send or CM DS channel quality is poor."),
        Rule("81cbcac8", "p[0] IN ('FAILED', 'failed')", "error", "Check DHCP Server behind CMTS, or DS/US signal quality."),
    ],
    together=frozenset({"bd6df2e3", "6e45cf29"}),
    context=Context("b2079e76", "p[2] = 'Continue'", "try_cast(p[1] AS INT)"),
)
