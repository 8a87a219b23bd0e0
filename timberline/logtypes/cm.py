"""Console of a cable modem: blocks, tables and glued records are taken apart by one scan per block of lines.

The scan is a finite state machine over line classes, which runs over blocks of lines (``folds``): a file of any length
is many independent blocks.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from timberline.logtypes.base import CLOCK, CLOCK_WORD, CTIME, IPV4, IPV6, LABELS, MAC, SNMP_MIB, LogType
from timberline.operators.folds import folded
from timberline.plans.shared import materialise

#: Lines by their beginning. Order is that of the tests.
CLASSES = {
    "block_start": r"\| This image is built using remote flash as nonvol.|Downloading LEAP image|Initializing DS Docsis 3.0 MAC",
    "block_end": r">>>>ChipID=0x339\d+|>>>AP dload time|(Running the system...)|(Automatically stopping at console)",
    "block_to_primary": r" {4}tap values:| *Trimmed Downstream Ambiguity Resolution Frequency List|=== Default Router List ===",
    "dropped": r"\*+$|BCM3390\d+|RAM Windows size \d+ mb|\+{10}|\+-{5}|BCM339[0-9]+[a-zA-Z]*[0-9] Bootloader version|RCC->|TCC->|\d+\*|Readback Test pkt:"
    r"|DHCPc:  Timed out waiting for offers for lease|fUsSetsState = |( {7}munged error type: T=)|( {5}munged error type =)|( {5}partial svc dcid\(s\): T=)|Type 'help' or"
    r"| {24}dsid: | {24}DSID: | {24}CMIM: |={18}|Suboption \d:|eptAsyncCmd: Ept not initialized|\([a-zA-Z0-9]+\)|<<<<<<<<<<<<< rpc_dump_msg |msg 0x|Len: \d+ |( {2}([0-9a-f]{2} ){1,4}){1,4} {1,52}\| ",
    "indent": r"===== Read Leap AIF Status =====",
    "indent_to_end": r"== Beginning initial ranging for Docsis UCID",
    "indent_end": r"Using clamped minimum transmit power|Using bottom of DRW initial upstream power|Using per transmitter stored initial upstream power|TCC ranging parameters specified power offset of",
    "to_nested": r"Assigned OFDMA Data Profile IUCs|fDestSingleTxTargetUsChanId|fTmT4NoUnicastRngOpStdMlsec|MSG PDU:|to a CM prior to sending|Load Address: |[0-9]+ uncorrectable FEC errors|Refresh period is |We will refresh at |req = 0x",
    "ds_table": r"Active Downstream Channel Diagnostics:",
    "ds_end": r"\* indicates currently configured",
    "us_table": r"Active Upstream Channels:",
    "us_end": r"\S",
    "rule": r" *----",
    "title": r" *Trimmed Candidate Downstream Service Group| *sgid +size +member| *Downstream Active Channel Settings| *dcid +type +frequency| *Upstream Active Channel Settings| *ucid +rpt enable"
    r"| *BcmCmUsTargetMset \(a.k.a. usable UCDs| *us +config| *phy +change| *type +ucid +dcid +count| *REG-RSP-MP Summary:| *TCC commands->| *ucid +action +ranging strategy| *Service Flow settings->"
    r"| *sfid +sid +ucids| *DSID settings->| *dsid +action +reseq| {5}US chan ID {5}Tx Power \(dBmV\)",
    "to_primary": r" +DOWNSTREAM STATUS| +CM Upstream channel info| +Receive Channel Config:| Reason = |\t{7}Storing to device...|\t{7}Loading from server...|  CmSnmpAgent::|  DefaultSnmpAgentClass::"
    r"|  Special case: don't disable|  [DU]S: +\d+ SC-QAM \(0x|  Plant power is",
    "nested": r" +|\t+",
    "stays_nested": r" +Ranging state info:",
}
_IS = {k: re.compile(p) for k, p in CLASSES.items()}
#: Modulations of downstream channels, by how a torn word may still be told.
MODULATIONS = ["Qam64", "Qam256", "OFDM PLC", "Unknown"]

#: State: block kind, table, table header done, last line empty, empty lines in a row (2 stands for more).
State = tuple[str, str, bool, bool, int]
START: State = ("", "", False, False, 0)
STATES: list[State] = [(b, t, h, e, c) for b in ("", "to_end", "to_primary", "indent", "indent_to_end", "table") for t in ("", "ds", "us") for h in (False, True) for e in (False, True) for c in (0, 1, 2)]


def downstream_row(line: str) -> str | None:
    """A row of the downstream channel table as a record; None if it is broken."""
    w = line.split(None, 7)
    if len(w) < 8:
        return None
    last = w[7].rstrip("\r\n")
    if last not in MODULATIONS:
        told = next((m for m, at, c in (("Qam64", 3, "6"), ("Qam256", 3, "2"), ("OFDM PLC", 0, "O"), ("Unknown", 0, "U")) if last[at : at + 1] == c), None)
        if told is None:
            return None
        last = told
    names = ("rxid", "dcid", "freq", "qam", "fec", "snr", "power", "mod")
    return "DS channel status " + " ".join(f"{n} {v}" for n, v in zip(names, [*w[:7], last.replace("OFDM PLC", "OFDM_PLC")]))


def upstream_row(line: str) -> str | None:
    """A row of the upstream channel table as a record; None if it is broken."""
    w = line.split(None, 8)
    if len(w) < 9:
        return None
    if w[6] == "-":
        w = line.split(None, 10)
        if len(w) < 11:
            return None
        low, high, rate, phy, data = w[5], w[7], w[8], w[9], w[10]
    else:
        low, high, rate, phy, data = w[5], w[5], w[6], w[7], w[8]
    if data.rstrip("\r\n") not in ("y", "n"):
        # older tables have one more column before it
        more = data.split(None, 2)
        if len(more) < 2 or more[1][0] not in "yn":
            return None
        data = more[1][0]
    names = ("txid", "ucid", "dcid", "rngsid", "power", "freqstart", "freqend", "symrate", "phytype", "txdata")
    return "US channel status " + " ".join(f"{n} {v}" for n, v in zip(names, [*w[:5], low, high, rate, phy, data.rstrip("\r\n")]))


class Line:
    """A line and its classes, each looked up once."""

    __slots__ = ("text", "known")

    def __init__(self, text: str) -> None:
        self.text, self.known = text, {}

    def __getitem__(self, kind: str) -> bool:
        if kind not in self.known:
            self.known[kind] = bool(_IS[kind].match(self.text))
        return self.known[kind]


def step(line: Line, state: State) -> tuple[str | None, State]:
    """What becomes of a line (None: it goes) and the next state. The first case that holds is taken."""
    block, table, header, empty, count = state
    text, out = line.text, line.text

    def in_table(end: bool, row) -> tuple[str | None, str, bool]:
        if end:
            return text, "", False
        if not line["nested"] and text:
            return text, table, header
        if line["rule"]:
            return None, table, True
        if not header:
            return None, table, header
        return (row(text) if text else text), table, header

    if line["block_start"]:
        block, out = "to_end", None
    elif block == "to_end":
        block, out = ("", text) if line["block_end"] else (block, None)
    elif line["block_to_primary"]:
        block, out = "to_primary", None
    elif block == "to_primary":
        block, out = ("", text) if not line["nested"] and text else (block, None)
    elif line["dropped"]:
        out = None
    elif line["indent"]:
        block = "indent"
    elif block == "indent":
        block, out = ("", text) if not text else (block, " " + text)
    elif line["indent_to_end"]:
        block = "indent_to_end"
    elif block == "indent_to_end":
        block, out = "" if line["indent_end"] else block, " " + text
    elif line["to_nested"]:
        out = " " + text
    elif line["ds_table"]:
        table, out = "ds", None
    elif table == "ds":
        out, table, header = in_table(line["ds_end"], downstream_row)
    elif line["us_table"]:
        table, out = "us", None
    elif table == "us":
        out, table, header = in_table(line["us_end"], upstream_row)
    elif line["rule"]:
        block, out = "table", None
    elif block == "table":
        block, out = ("", text) if not text else (block, None)
    elif line["title"]:
        out = None
    elif line["to_primary"]:
        out = text.lstrip()
    elif line["nested"] and empty and count >= 2 and not line["stays_nested"]:
        out = text.lstrip()
    # what the line is after the case decides whether it counts as empty
    if (text if out is None else out).strip(" \t") == "":
        return None, (block, table, header, True, min(2, count + 1) if empty else 1)
    return out, (block, table, header, False, count)


#: Lines of which a task remembers what becomes of them.
REMEMBERED = 1 << 14


class Console:
    """The scan as a machine over column body. A state is its number in STATES; lines that come again are looked up."""

    reads, writes = ("body",), "body"

    def __init__(self) -> None:
        self.start, self.beginnings = STATES.index(START), list(range(len(STATES)))
        self.numbers, self.known = {s: i for i, s in enumerate(STATES)}, {}

    def after(self, text: str, state: int) -> tuple[str | None, int]:
        if text not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[text] = (Line(text), {})
        line, seen = self.known[text]
        if state not in seen:
            out, then = step(line, STATES[state])
            seen[state] = (out, self.numbers[then])
        return seen[state]

    def run(self, rows: list[tuple], state: int) -> tuple[list, list[bool], int]:
        out = []
        for (text,) in rows:
            new, state = self.after(text, state)
            out.append(new)
        return out, [x is not None for x in out], state

    def ends(self, rows: list[tuple], states: list[int]) -> list[int]:
        for (text,) in rows:
            to = {s: self.after(text, s)[1] for s in set(states)}
            states = [to[s] for s in states]
        return states

    def behind(self, ends: list[int], state: int) -> int:
        return ends[state]


def rewrite(lines: list[str], state: State) -> list[str | None]:
    out = []
    for text in lines:
        new, state = step(Line(text), state)
        out.append(new)
    return out


def scan(lines: DataFrame, bits: int = 14) -> DataFrame:
    """Rewrites column body of lines (file_id, line_no, body, ...); lines that go are left out."""
    return folded(materialise(lines), Console(), bits=bits)


#: Parameters of this kind of log, and the times within its lines.
_DIGITS = (
    r"(?<=value=)(( [a-f0-9]{2}){6,14})|(?<=HEX:)([A-F0-9]{2} )+|( \( \d+\.?(\d+)?-\d+\.?(\d+)? \))+|( \d+){2,}|0x[A-Fa-f0-9]+"
    r"|(?<=[^A-Za-z0-9\.])(\-?\+?\d+\.?(\d+)?\*?)|(?<=\.\.)(\d+)"
)
_NAMED = rf"(?<= Filename: )\S+|C[hH]\d{{2}}|(?<= )((QAM|FEC) lock failure)|(?<=([Dd]cid= )|(prof= ))\[[^\]]*\]|{CLOCK_WORD}"
_REASONS = (
    r"\( k[A-Z]\w+ \)|\( [du]cid \)|\( ErrorRecovery \)|\( ConsoleCmdOverride \)|\( T4NoStationMaintTimeout \)|\( T2NoInitMaintTimeout \)|\( not specified \)|\( no action \)|\( bcast or ucast \)"
)
_INNER = rf"\[?({CLOCK}|24:00:00(.000)?) \d{{2}}/\d{{2}}/\d{{4}}\]?  ?"

#: The patterns of this kind of log.
CM = LogType(
    name="cm",
    timestamp=rf"^\[\d{{4}}\d{{2}}\d{{2}}-({CLOCK}\.(\d{{3}})|24:00:00\.000)\] {LABELS}",
    width=24,
    clean=r"(?i)CM[/a-z-_ ]*> |"
    rf"\[?({CLOCK}(.\d\d\d)?|24:00:00(.000)?) \d{{2}}/\d{{2}}/\d{{4}}\]?  ?|"
    rf"\[\d{{2}}/\d{{2}}/\d{{4}} ({CLOCK}|24:00:00)\] (- )?|"
    r"\[ ?[a-z][a-z0-9\- ]*\] |(?<=:  )\([a-zA-Z0-9/ ]+\) |\+{3} ",
    session=r"^(Loading compressed image \d|Moving to Downstream Frequency)",
    masks=[
        (CTIME, "<*>"), (SNMP_MIB, "<*>"), (IPV4, "<*>"), (IPV6, " <*>"), (MAC, "<*>"), (_NAMED, "<*>"), (_DIGITS, " <*>"), (_REASONS, "( <*> )"),
        (r"Stat= (Continue|Success|Abort)", "Stat= <*>"), (r"qam [yn] fec [yn] snr", "qam <*> fec <*> snr"), (r"txdata [yn]", "txdata <*>"),
    ],
    special=[r"[a-zA-Z]+[0-9]*[a-zA-Z]*:", r"[a-zA-Z]+=", r"\(", r"\)"],
    split_left=[r"=(?=[^= \r\n])", r"::(?=[A-Z][a-z0-9]|[a-z][A-Z])", r";(?! )", r"#(?=[0-9]+)", r"address:(?=[0-9a-fA-F])", r"\((?=(?:\w|[-+]))", r"\[(?=(?:\w|[-+]))", r"\d+(?=(?:ms))", r"CMSTATUS:(?=\w)"],
    split_right=[r"(?<=\w)\)", r"(?<=\w)\]"],
    lite_left=[r"=(?=[^= \r\n])", r"::(?=[A-Z][a-z0-9]|[a-z][A-Z])", r";(?! )", r"\((?=(?:\w|[-+]))", r"\d+(?=(?:ms))", r"CMSTATUS:(?=\w)"],
    lite_right=[r"(?<=\w)\)"],
    glued=_INNER,
    torn_heads=("L", "C"),
    torn_special=("b9c1fdb1",),
    scan=scan,
)
