"""Traces of an FTP client."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from timberline.logtypes.base import CLOCK, CLOCK_WORD, CTIME, IPV4, LABELS, MAC, LogType

#: Responses that servers word in their own way, and their common text.
RESPONSES = [
    (r"^Response: 211[ \-]", "Response: 211 System status, or system help"),
    (r"^Response: 213 ", "Response: 213 File status"),
    (r"^Response: 220[ \-]", "Response: 220 FTP server is ready"),
    (r"^Response: 421 ", "Response: 421 Service not available, closing connection"),
]


def common_response(line: Column) -> Column:
    """The common text of a customised response; other lines as they are."""
    out = None
    for pattern, text in RESPONSES:
        out = F.when(line.rlike(pattern), text) if out is None else out.when(line.rlike(pattern), text)
    return out.otherwise(line)


#: The patterns of this kind of log.
FTP = LogType(
    name="ftp",
    timestamp=rf"^\d{{4}}-\d{{2}}-\d{{2}} ({CLOCK}|24:00:00) {LABELS}",
    width=20,
    clean=r"(?i)\d+ \d (?=[A-Z][a-z]+: )",
    session=r"^(Trace: CControlSocket::\s?SendNextCommand\(\)|Trace: CRealControlSocket::\s?OnSocketError|Status: Disconnected from server$)",
    masks=[(CTIME, "<*>"), (IPV4, "<*>"), (MAC, "<*>"), (CLOCK_WORD, "<*>"), (r" \d+ ", " <*> ")],
    special=[r"[a-zA-Z_]+::", r"[a-zA-Z_]+\(\)", r"[a-zA-Z_]+\("],
    split_left=[r"=(?=[^= \r\n])", r"::(?=[a-zA-Z_]{3,})", r"\((?=(?:\w|[-+]))"],
    split_right=[r"(?<=\w)\)"],
    lite_left=[r"=(?=[^= \r\n])", r"::(?=[a-zA-Z_]{3,})", r"\((?=(?:\w|[-+]))"],
    lite_right=[r"(?<=\w)\)"],
    fields=("Date", "Time", "Content"),
    normalise=common_response,
)
