"""Times written by different programs, as milliseconds since 1970 in UTC, without the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English month names as web servers write them, three letters each.
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"

def _millis(iso: Column) -> Column:
    return F.unix_millis(iso.try_cast("timestamp"))


def time_millis(text: Column) -> Column:
    """Milliseconds of a stated time; null for null, blank or anything that states none.

    Forms: ISO date and time with blank or T, optional fraction and zone; [YYYYMMDD-HH:MM:SS.mmm]; web server
    (01/Aug/2023:14:37:06.123 +0200); 13 digits of milliseconds or 10 of seconds. UTC where no zone is stated.
    The form is told by single characters and lengths, not by regular expressions; the cast decides.
    """
    t = F.btrim(text, F.lit(" \t[]"))
    n = F.length(t)
    tail = F.replace(F.replace(F.substring(t, 20, 40), F.lit(","), F.lit(".")), F.lit(" "), F.lit(""))
    zoned = (F.instr(tail, "Z") + F.instr(tail, "+") + F.instr(tail, "-")) > 0
    iso = F.concat(F.substring(t, 1, 19), tail, F.when(zoned, "").otherwise("Z"))
    compact = F.concat(F.substring(t, 1, 4), F.lit("-"), F.substring(t, 5, 2), F.lit("-"), F.substring(t, 7, 2), F.lit("T"), F.substring(t, 10, 30), F.lit("Z"))
    month = F.lpad(((F.instr(F.lit(MONTHS), F.substring(t, 4, 3)) + 2) / 3).cast("int").cast("string"), 2, "0")
    clock, zone = F.substring_index(F.substring(t, 13, 40), " ", 1), F.when(F.instr(t, " ") > 0, F.substring_index(t, " ", -1)).otherwise("+0000")
    web = F.concat(F.substring(t, 8, 4), F.lit("-"), month, F.lit("-"), F.substring(t, 1, 2), F.lit("T"), clock, F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, 4, 2))
    return (
        F.when((n >= 19) & (F.substring(t, 5, 1) == "-") & (F.substring(t, 14, 1) == ":"), _millis(iso))
        .when((n >= 17) & (F.substring(t, 9, 1) == "-") & (F.substring(t, 12, 1) == ":"), _millis(compact))
        .when((n >= 20) & (F.substring(t, 3, 1) == "/"), _millis(web))
        .when(n == 13, t.try_cast("long"))
        .when(n == 10, t.try_cast("long") * 1000)
    )


def utc_text(millis: Column) -> Column:
    """YYYY-MM-DD HH:MM:SS.mmm in UTC, whatever the session's time zone."""
    whole, rest = F.floor(millis / 1000), F.pmod(millis, F.lit(1000))
    clock = F.timestamp_add("SECOND", whole, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).cast("string")
    return F.concat(clock, F.lit("."), F.lpad(rest.cast("string"), 3, "0"))
