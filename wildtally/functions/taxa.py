"""Taxon paths such as ``Animalia|Chordata|Aves``."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from wildtally.functions.text import NOT_BLANK, strip, stripped_parts

RANKS = ["kingdom", "phylum", "class", "order", "family", "genus", "species"]


def path_parts(taxon: Column) -> Column:
    return F.split(taxon, r"\|", -1)


def _last(parts: Column) -> Column:
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))


def taxon_name(taxon_path: Column) -> Column:
    """Last part that is not blank, as it stands (checklists)."""
    return _last(F.filter(path_parts(taxon_path), lambda part: part.rlike(NOT_BLANK)))


def last_taxon(taxon_path: Column) -> Column:
    """Last part that is not empty, then stripped (occurrences)."""
    return strip(_last(F.filter(path_parts(taxon_path), lambda part: part != "")))


def path_elements(taxon_path: Column) -> Column:
    """The distinct stripped parts of a path; no parts for a null path."""
    return stripped_parts(taxon_path)


def rank_path(*ranks: Column) -> Column:
    """Taxon path from one column per rank; absent ranks are left out."""
    return F.concat_ws("|", *(ranks or [F.col(rank) for rank in RANKS]))
