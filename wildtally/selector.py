"""A selector as a caller writes it, and what the plans need to know about it."""

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wildtally import schemas
from wildtally.functions import selectors as S
from wildtally.functions import shapes


class Selector(NamedTuple):
    taxonSelector: str = ""
    wktString: str = ""
    traitSelector: str = ""


class InvalidSelector(ValueError):
    """A taxon list or an area that is not well-formed, or an incomplete UUID."""


@dataclass(frozen=True)
class Resolved:
    uuid: str
    selector: Selector | None
    taxa: list
    traits: list
    supported: bool
    boxes: list
    edges: list


def selectors_frame(spark: SparkSession, selectors) -> DataFrame:
    """Literal selectors as a DataFrame."""
    return spark.createDataFrame([tuple(s) for s in selectors], schemas.SELECTOR)


def normalized(selectors: DataFrame) -> DataFrame:
    """Commas to bars, nulls to empty text, and the UUID; one row per UUID."""
    lists = {c: S.normalize_list(S.or_empty(F.col(c))) for c in ("taxonSelector", "traitSelector")}
    rows = selectors.select(
        lists["taxonSelector"].alias("taxonSelector"),
        S.or_empty(F.col("wktString")).alias("wktString"),
        lists["traitSelector"].alias("traitSelector"),
    )
    return with_uuid(rows).dropDuplicates(["uuid"])


def with_uuid(selectors: DataFrame) -> DataFrame:
    uuid = S.selector_uuid(F.col("taxonSelector"), F.col("wktString"), F.col("traitSelector"))
    return selectors.withColumn("uuid", uuid)


def valid_only(selectors: DataFrame) -> DataFrame:
    return selectors.filter(S.valid_selector("taxonSelector", "wktString"))


def resolve(spark: SparkSession, selector=None, uuid=None) -> Resolved:
    """Check and parse one selector: a single row, by the same expressions as for many.

    A UUID, if given, wins over the values.
    """
    if uuid is not None:
        row = spark.range(1).select(S.pick_uuid(F.lit(uuid), *[F.lit("")] * 3).alias("uuid")).first()
        if row.uuid is None:
            raise InvalidSelector(f"not a complete UUID: {uuid!r}")
        return Resolved(row.uuid, None, [], [], False, [], [])
    row = (
        normalized(selectors_frame(spark, [Selector(*selector)]))
        .select(
            "*",
            S.valid_taxa(F.col("taxonSelector")).alias("validTaxa"),
            S.terms(F.col("taxonSelector")).alias("taxa"),
            S.terms(F.col("traitSelector")).alias("traits"),
            shapes.area("wktString").alias("area"),
        )
        .select("*", "area.*")
        .first()
    )
    if not (row.validTaxa and row.valid):
        raise InvalidSelector(f"invalid selector: {selector!r}")
    return Resolved(
        row.uuid,
        Selector(row.taxonSelector, row.wktString, row.traitSelector),
        row.taxa,
        row.traits,
        row.supported,
        row.boxes or [],
        row.edges or [],
    )
