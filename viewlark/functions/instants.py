"""Nanosecond instants as ISO-8601 text and back, whatever the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_text(nanos: Column) -> Column:
    seconds, rest = F.floor(nanos / F.lit(10**9).cast("decimal(20,0)")).cast("long"), F.pmod(nanos, F.lit(10**9))
    at = F.expr("timestamp_ntz'1970-01-01'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
    digits = F.lpad(rest.cast("string"), 9, "0")
    short = F.when(digits.endswith("000000"), digits.substr(1, 3)).when(digits.endswith("000"), digits.substr(1, 6)).otherwise(digits)
    fraction = F.when(rest == 0, F.lit("")).otherwise(F.concat(F.lit("."), short))
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z"))


def from_text(text: Column) -> Column:
    """Of UTC instants only (a final Z); anything else is an error."""
    pattern = r"^(\d{4}-\d\d-\d\dT\d\d:\d\d)(:\d\d)?(?:\.(\d{1,9}))?Z$"
    day = F.concat(F.regexp_extract(text, pattern, 1), F.when(F.regexp_extract(text, pattern, 2) == "", ":00").otherwise(F.regexp_extract(text, pattern, 2)))
    since = F.to_timestamp_ntz(F.replace(day, F.lit("T"), F.lit(" "))) - F.expr("timestamp_ntz'1970-01-01'")
    seconds = F.extract(F.lit("DAY"), since).cast("long") * 86400 + F.extract(F.lit("HOUR"), since).cast("long") * 3600
    seconds = seconds + F.extract(F.lit("MINUTE"), since).cast("long") * 60 + F.floor(F.extract(F.lit("SECOND"), since)).cast("long")
    nanos = F.coalesce(F.rpad(F.regexp_extract(text, pattern, 3), 9, "0").cast("long"), F.lit(0))
    bad = F.raise_error(F.concat(F.lit("no instant: "), text)).cast("long")
    return F.when(text.isNull(), F.lit(None)).when(~text.rlike(pattern), bad).otherwise(seconds * 10**9 + nanos)
