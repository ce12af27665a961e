"""Dates and intervals. ``now`` is always an argument; the zone is the session's (UTC)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: accepted forms and unit sizes. --------------------------------
SHORT_TS = r"\A(\d\d)(\d\d)(\d\d) +(\d+):(\d+):(\d+)(\.\d+)?\z"
FULL_TS = r"\A(\d{4})-(\d\d)-(\d\d)[T ](\d\d):(\d\d):(\d\d)(\.\d+)?\z"
AGO = r"\A(\d{1,5})([shmd]?)\z"
AGO_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}
TIMESPEC = r"\A([-+]?)(\d+)([hdwmqy])(?:[\s.](startof))?\z"
TIMESPEC_UNITS = {"h": "hour", "d": "day", "w": "week", "m": "month", "q": "quarter", "y": "year"}
RETENTION_UNITS = {"d": "days", "w": "weeks", "m": "months", "y": "years"}
COMPOUND_SECONDS = {
    "y": 31536000, "M": 2592000, "w": 604800, "d": 86400, "h": 3600, "m": 60, "s": 1,
}
STRFTIME = {
    "%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss",
    "%y": "yy", "%j": "DDD", "%b": "MMM", "%B": "MMMM", "%R": "HH:mm",
    "%F": "yyyy-MM-dd", "%T": "HH:mm:ss",
}
# -----------------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def epoch(ts) -> Column:
    """Seconds since 1970 with fraction, from any timestamp column."""
    return F.unix_micros(_c(ts).cast("timestamp")) / F.lit(1000000.0)


def parse_timestamp(text) -> Column:
    """``YYMMDD H:M:S[.us]`` to ``20YY-MM-DD HH:MM:SS``; other text is unchanged."""
    text = _c(text)
    part = [F.regexp_extract(text, SHORT_TS, i) for i in range(1, 8)]
    day = F.concat(F.lit("20"), part[0], F.lit("-"), part[1], F.lit("-"), part[2], F.lit(" "))
    clock = F.concat(
        F.lpad(part[3], 2, "0"), F.lit(":"), F.lpad(part[4], 2, "0"), F.lit(":"), F.lpad(part[5], 2, "0")
    )
    fraction = F.when(part[6] != "", F.rpad(F.substring(part[6], 1, 7), 7, "0")).otherwise("")
    return F.when(text.rlike(SHORT_TS), F.concat(day, clock, fraction)).otherwise(text)


def unix_timestamp(text) -> Column:
    """Seconds since 1970, fraction kept, of ``YYYY-MM-DD[T ]HH:MM:SS[.us]``; else NULL."""
    text = _c(text)
    return F.when(text.rlike(FULL_TS), epoch(F.try_to_timestamp(F.replace(text, F.lit("T"), F.lit(" ")))))


def any_unix_timestamp(text, now) -> Column:
    """``N[shmd]`` ago, short dates and full dates to seconds since 1970."""
    text = _c(text)
    amount = F.regexp_extract(text, AGO, 1).try_cast("long")
    suffix = F.regexp_extract(text, AGO, 2)
    scale = F.lit(1)
    for letter, seconds in AGO_SECONDS.items():
        scale = F.when(suffix == letter, F.lit(seconds)).otherwise(scale)
    short = F.when(text.rlike(r"\A\d{6}\z"), F.concat(text, F.lit(" 00:00:00"))).otherwise(text)
    full = F.when(text.rlike(r"\A\d{4}-\d\d-\d\d\z"), F.concat(text, F.lit(" 00:00:00"))).otherwise(text)
    return (
        F.when(text.rlike(AGO), epoch(_c(now)) - amount * scale)
        .when(text.rlike(r"\A\d{6}"), unix_timestamp(parse_timestamp(short)))
        .when(text.rlike(r"\A\d{4}-\d\d-\d\d"), unix_timestamp(full))
    )


def seconds_ago(text, now) -> Column:
    """``N[hdwm]`` (hours, days, weeks, 30-day months are calendar months) before ``now``."""
    text, now = _c(text), _c(now).cast("timestamp")
    n = F.regexp_extract(text, r"(\d+)[hdwm]", 1).try_cast("int")
    unit = F.regexp_extract(text, r"\d+([hdwm])", 1)
    return (
        F.when(unit == "h", now - F.make_dt_interval(hours=n))
        .when(unit == "d", now - F.make_dt_interval(days=n))
        .when(unit == "w", now - F.make_dt_interval(days=n * 7))
        .when(unit == "m", now - F.make_ym_interval(months=n))
    )


def secs_to_time(secs) -> Column:
    """``d+hh:mm:ss``, ``hh:mm:ss`` or ``mm:ss`` by size."""
    s = F.floor(_c(secs)).cast("long")
    hours = F.floor((s % 86400) / 3600).cast("long")
    minutes = F.floor((s % 3600) / 60).cast("long")
    return (
        F.when(s.isNull() | (_c(secs) == 0), F.lit("00:00"))
        .when(
            _c(secs) >= 86400,
            F.format_string("%d+%02d:%02d:%02d", F.floor(s / 86400).cast("long"), hours, minutes, s % 60),
        )
        .when(_c(secs) >= 3600, F.format_string("%02d:%02d:%02d", hours, minutes, s % 60))
        .otherwise(F.format_string("%02d:%02d", minutes, s % 60))
    )


def timespec(spec: str, ref) -> Column:
    """``[+-]N{h,d,w,m,q,y}[ startof]`` from ``ref``: truncate first, then shift."""
    ref = _c(ref).cast("timestamp")
    if re.fullmatch(r"\d+", spec):
        return F.timestamp_seconds(F.lit(int(spec)))
    if spec == "now":
        return ref
    m = re.match(TIMESPEC.replace(r"\z", r"\Z"), spec)
    if not m:
        full = F.try_to_timestamp(F.lit(spec))
        if not re.match(r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d", spec):
            raise ValueError(f"unknown timespec: {spec!r}")
        return full
    sign, amount, unit, startof = m.groups()
    n = int(amount) * (-1 if sign == "-" else 1)
    base = F.date_trunc(TIMESPEC_UNITS[unit], ref) if startof else ref
    if unit in ("m", "q", "y"):
        months = n * {"m": 1, "q": 3, "y": 12}[unit]
        return base + F.make_ym_interval(months=F.lit(months))
    hours = n * {"h": 1, "d": 24, "w": 168}[unit]
    return base + F.make_dt_interval(hours=F.lit(hours))


def spark_pattern(pattern: str) -> str:
    """A strftime pattern as a Spark datetime pattern; literals are quoted."""
    out = ""
    for piece in re.findall(r"%.|[^%]+", pattern):
        if piece.startswith("%"):
            if piece not in STRFTIME:
                raise ValueError(f"unsupported date field {piece}")
            out += STRFTIME[piece]
        else:
            out += "'" + piece.replace("'", "''") + "'"
    return out


def age_from_name(name, pattern: str) -> Column:
    """The date coded in a table name, NULL when the name does not fit."""
    return F.try_to_timestamp(_c(name), F.lit(spark_pattern(pattern)))


def rotated_name(name, date, pattern: str) -> Column:
    """``name`` with a formatted date appended; ``%V`` is the ISO week."""
    date = _c(date).cast("timestamp")
    parts = [_c(name)]
    for piece in re.findall(r"%.|[^%]+", pattern):
        if piece == "%V":
            parts.append(F.lpad(F.weekofyear(date).cast("string"), 2, "0"))
        elif piece.startswith("%"):
            parts.append(F.date_format(date, STRFTIME[piece]))
        else:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def retention_cutoff(retention: str, now) -> Column:
    """``Nd``, ``Nw``, ``Nm`` or ``Ny`` before ``now``."""
    m = re.search(r"(\d+)([dwmy])", retention, re.IGNORECASE)
    if not m:
        raise ValueError(f"unknown retention: {retention!r}")
    return timespec(f"-{m.group(1)}{m.group(2).lower()}", now)


def compound_seconds(text) -> Column:
    """``1y2M3w4d5h6m7s`` as seconds (years of 365, months of 30 days)."""
    text = _c(text)
    total = F.lit(0).cast("long")
    for unit, seconds in COMPOUND_SECONDS.items():
        n = F.regexp_extract(text, rf"(\d+){unit}", 1)
        total = total + F.coalesce(F.when(n != "", n).try_cast("long"), F.lit(0)) * seconds
    return total


def clock_difference(start, end) -> Column:
    """Seconds between two packet times; an earlier end is past one midnight."""
    diff = epoch(end) - epoch(start)
    return F.when(diff < 0, diff + 86400).otherwise(diff)
