"""Small text helpers shared by the other expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character up to U+0020 counts as blank; Spark's own trim drops spaces only.
BLANK = r"[\x00-\x20]"
NOT_BLANK = r"[^\x00-\x20]"


def strip(text: Column) -> Column:
    """Drop blanks and control characters at both ends."""
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+\z", "")


def or_empty(value: Column) -> Column:
    """The value as text, with null as the empty text."""
    return F.coalesce(value.cast("string"), F.lit(""))


def tabbed(*values: Column) -> Column:
    """Values joined by TAB, nulls as empty text, nothing quoted or escaped."""
    return F.concat_ws("\t", *[or_empty(v) for v in values])


def stripped_parts(text: Column) -> Column:
    """The distinct parts between bars, each stripped, without the empty ones; none for null.

    Most texts have no blanks to strip, which plain searches tell faster than one pattern does (any control
    character counts, as they are rare); and a plain bar, unlike a pattern, is not compiled again for each row
    by ``split``.
    """
    text = F.coalesce(text, F.lit(""))
    bare = F.regexp_replace(strip(text), rf"{BLANK}*\|{BLANK}*", "|")
    spaced = text.startswith(" ") | text.endswith(" ") | text.contains("| ") | text.contains(" |")
    padded = spaced | text.rlike(r"[\x00-\x1f]")
    parts = F.split(F.when(padded, bare).otherwise(text), r"\|", -1)
    return F.array_except(parts, F.array(F.lit("")))
