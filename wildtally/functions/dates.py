"""Times are epoch milliseconds; days are UTC days. The session zone has to be UTC."""

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MILLIS = 24 * 60 * 60 * 1000
# The first and the last millisecond of the years 0000 to 9999: only these have a day partition.
FIRST_MILLIS, LAST_MILLIS = -62167219200000, 253402300799999

# Year, month or day, then perhaps a time with or without a zone.
_ISO = r"^\d{4}(-\d{1,2}(-\d{1,2}(T\d{1,2}:\d{1,2}(:\d{1,2}(\.\d+)?)?(Z|[+-]\d{1,2}:?\d{2})?)?)?)?$"


def iso_millis(millis: Column) -> Column:
    """``1970-01-01T00:00:00.123Z``; years of five digits have no sign."""
    text = F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    return F.when(millis > LAST_MILLIS, F.ltrim(text, F.lit("+"))).otherwise(text)


def parse_utc(text: Column) -> Column:
    """ISO date or date-time; UTC where the text has no zone. Other text fails the query, also if a cast takes it."""
    # The cast wants seconds before a zone.
    full = F.regexp_replace(text, r"(T\d{1,2}:\d{1,2})(Z|[+-][0-9:]+)$", "$1:00$2")
    bad = F.raise_error(F.concat(F.lit("not an ISO date or date-time: "), text)).cast("timestamp")
    return F.when(text.isNull() | text.rlike(_ISO), full.cast("timestamp")).otherwise(bad)


def day_of(millis: Column) -> Column:
    return F.date_from_unix_date(F.floor(millis / DAY_MILLIS).cast("int"))


def in_days(millis: Column) -> Column:
    """Whether the time has a day partition."""
    return millis.between(FIRST_MILLIS, LAST_MILLIS)


def day_partitions(millis: Column) -> dict[str, Column]:
    """Zero-padded ``y``, ``m`` and ``d`` of the UTC day; null outside the years 0000 to 9999."""
    day = day_of(F.when(in_days(millis), millis))
    return {
        "y": F.lpad(F.year(day).cast("string"), 4, "0"),
        "m": F.lpad(F.month(day).cast("string"), 2, "0"),
        "d": F.lpad(F.dayofmonth(day).cast("string"), 2, "0"),
    }
