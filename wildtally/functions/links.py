"""Links from an occurrence to the page of the archive it came from."""

from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F

# One link prefix and suffix per archive.
LINKS = {
    "gbif": ("http://www.gbif.org/occurrence/search?OCCURRENCE_ID=", ""),
    "idigbio": ("http://portal.idigbio.org/search?rq=%7B%22occurrenceid%22:%22", "%22%7D"),
}

# Characters that a URI query cannot hold as they are: the ASCII controls and space, a few
# printable ones, and the controls and spaces beyond ASCII. "%" comes first, so that the
# quotes put in by the later steps stay.
_CONTROLS = [chr(c) for c in [*range(0x00, 0x21), 0x7F, *range(0x80, 0xA1)]]
_PRINTABLE = list('"<>#\\^`{|}')
_SPACES = [chr(c) for c in [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]]
QUOTED = ["%", *_CONTROLS, *_PRINTABLE, *_SPACES]

_PLAIN = r"^[A-Za-z0-9,:;/?@&=+$\[\]_.!~*'()-]*\z"


def quote_query(text: Column) -> Column:
    """Quote as in the query part of a URI; this is not form encoding.

    Most ids hold plain characters only and skip the replacements.
    """
    quoted = text
    for char in QUOTED:
        quoted = F.replace(quoted, F.lit(char), F.lit(quote(char, safe="")))
    return F.when(text.rlike(_PLAIN), text).otherwise(quoted)


def occurrence_url(source: Column, occurrence_id: Column) -> Column:
    """Null for archives without a known page, and for a null id."""
    quoted = quote_query(occurrence_id)
    before, after = F.lit(None).cast("string"), F.lit(None).cast("string")
    for archive, (prefix, suffix) in LINKS.items():
        before = F.when(source == archive, F.lit(prefix)).otherwise(before)
        after = F.when(source == archive, F.lit(suffix)).otherwise(after)
    return F.concat(before, quoted, after)
