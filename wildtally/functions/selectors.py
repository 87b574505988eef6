"""Selectors: (taxon list, area in WKT, trait list) and their identifiers."""

import uuid as _uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from wildtally.functions.shapes import valid_wkt
from wildtally.functions.text import or_empty, stripped_parts

# Fixed value: the name space of selector identifiers.
NAMESPACE = _uuid.UUID("40d05094-803d-5bfa-b1e1-48975d2035fc")

UUID_PATTERN = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\\z"


def normalize_list(selector: Column) -> Column:
    """Commas and bars both separate the terms of a taxon or trait list."""
    return F.translate(selector, ",", "|")


def selector_uuid(taxa: Column, wkt: Column, traits: Column) -> Column:
    """Name-based (version 5) UUID of the exact text of the three strings; null counts as empty."""
    named = [("taxonSelector", taxa), ("wktString", wkt), ("traitSelector", traits)]
    name = F.concat_ws("&", *[F.concat(F.lit(f"{k}="), F.url_encode(or_empty(v))) for k, v in named])
    digest = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE.hex)), F.encode(name, "UTF-8")))
    # The first hex digit of the fourth group keeps its two low bits below the variant bits 10.
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def selector_partitions(uuid: Column) -> dict[str, Column]:
    """Partition columns that spread the selectors over three levels of folders."""
    return {
        "u0": F.substring(uuid, 1, 2),
        "u1": F.substring(uuid, 3, 2),
        "u2": F.substring(uuid, 5, 2),
        "uuid": uuid,
    }


def selector_path(uuid: Column) -> Column:
    parts = selector_partitions(uuid)
    return F.concat_ws("/", *[F.concat(F.lit(f"{k}="), v) for k, v in parts.items()])


def valid_uuid(uuid: Column) -> Column:
    return F.coalesce(uuid.rlike(UUID_PATTERN), F.lit(False))


def pick_uuid(uuid: Column, taxa: Column, wkt: Column, traits: Column) -> Column:
    """The given UUID if there is one, else that of the normalised values.

    Null where the UUID does not have the full form, or where neither a UUID nor an area is given.
    """
    by_values = F.when(wkt.isNotNull(), selector_uuid(normalize_list(taxa), wkt, normalize_list(traits)))
    return F.when(uuid.isNull(), by_values).when(valid_uuid(uuid), F.lower(uuid))


def valid_taxa(taxa: Column) -> Column:
    """Letters, commas, bars and white space only; an empty list is valid."""
    # Fixed value: the form of a list.
    return F.coalesce(taxa.rlike(r"^[a-zA-Z,|\s]*\z"), F.lit(False))


def valid_selector(taxa: str, wkt: str) -> Column:
    """By the names of the two columns. The trait list is not checked."""
    return valid_taxa(F.col(taxa)) & valid_wkt(wkt)


def terms(selector: Column) -> Column:
    """The distinct stripped terms of a list, commas or bars between them."""
    return stripped_parts(normalize_list(selector))
