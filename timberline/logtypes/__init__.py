"""Kinds of logs. A new kind is a LogType: patterns as values, and a scan if its lines depend on each other."""

from timberline.logtypes.base import LogType
from timberline.logtypes.cm import CM
from timberline.logtypes.ftp import FTP

#: By the names that tables of files use.
LOG_TYPES: dict[str, LogType] = {t.name: t for t in (FTP, CM)}
