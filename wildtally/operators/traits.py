"""Trait selectors.

Grammar (our decision): terms separated by bars or commas, any of which qualifies; a term is a
trait name (the taxon has the trait, with or without a value) or a trait name, one of
``< <= = >= >`` and a number. A record qualifies if any element of its taxon path is a
qualifying taxon. No terms mean no restriction.

For one selector the terms are a filter on the table of traits. For many, each taxon's values of a trait
are reduced to their smallest and largest, which decide all terms with an inequality, and to those values
that some term asks for by ``=``. So nothing is paired with terms before records are: however many
selectors ask for one trait, there is one row per taxon and trait.
"""

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wildtally.functions.selectors import terms
from wildtally.functions.taxa import path_elements
from wildtally.functions.text import strip
from wildtally.operators.sizes import BROADCAST_BYTES, fits, measured, small_side
from wildtally.session import checkpoint

_TERM = r"^(.*?)\s*(?:(<=|>=|<|>|=)\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?))?\z"
# How a taxon's range decides a term with an inequality.
_COMPARED = {"<": "f.lo < t.number", "<=": "f.lo <= t.number", ">": "f.hi > t.number", ">=": "f.hi >= t.number"}


def _parsed(term):
    number = F.regexp_extract(term, _TERM, 3)
    return F.struct(
        strip(F.regexp_extract(term, _TERM, 1)).alias("trait"),
        F.regexp_extract(term, _TERM, 2).alias("op"),
        F.when(number != "", number.cast("double")).alias("number"),
    )


def wanted_traits(selectors: DataFrame) -> DataFrame:
    """(traitSelector, wanted): the terms of each distinct trait selector that has any."""
    rows = selectors.select("traitSelector").distinct()
    rows = rows.withColumn("wanted", F.transform(terms(F.col("traitSelector")), _parsed))
    return rows.filter(F.size("wanted") > 0)


def parsed_terms(selectors: DataFrame) -> DataFrame:
    """One row per distinct trait selector and term: name, operator (or '') and number."""
    return wanted_traits(selectors).select("traitSelector", F.explode("wanted").alias("t")).select("traitSelector", "t.*")


def trait_ranges(traits: DataFrame, asked: DataFrame, small: bool) -> DataFrame:
    """(element, trait, lo, hi, hits): what decides the terms (trait, op, number), one row per taxon and trait in use."""
    side = F.broadcast if small else lambda rows: rows
    names = side(asked.select("trait").distinct())
    equal = side(asked.filter("op = '='").select(F.col("trait").alias("_trait"), F.col("number").alias("hit")).distinct())
    rows = traits.select(strip(F.col("taxon")).alias("element"), "trait", "value").join(names, "trait", "left_semi")
    found = rows.join(equal, (F.col("trait") == F.col("_trait")) & (F.col("value") == F.col("hit")), "left")
    return found.groupBy("element", "trait").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.collect_set("hit").alias("hits")
    )


def path_facts(occurrences: DataFrame, ranges: DataFrame) -> DataFrame:
    """(taxon, facts): the ranges of the elements of each distinct taxon path that has any."""
    paths = occurrences.select("taxon").distinct()
    elements = paths.select("taxon", F.explode(path_elements(F.col("taxon"))).alias("element"))
    fact = F.struct("trait", "lo", "hi", "hits")
    return elements.join(ranges, "element").groupBy("taxon").agg(F.collect_list(fact).alias("facts"))


def _qualifies(wanted: str, facts: str) -> str:
    compared = " ".join(f"WHEN '{op}' THEN {test}" for op, test in _COMPARED.items())
    decided = f"CASE t.op WHEN '' THEN true WHEN '=' THEN array_contains(f.hits, t.number) {compared} END"
    return f"exists({wanted}, t -> exists({facts}, f -> f.trait = t.trait AND {decided}))"


class TraitRanges(NamedTuple):
    """(traitSelector, wanted), and what decides its terms, both written; whether the first is small, and the limit for broadcasts."""

    wanted: DataFrame
    ranges: DataFrame
    few: bool
    limit: int


class TraitFacts(NamedTuple):
    """(traitSelector, wanted) and (taxon, facts), both written; whether the first is small, and the limit for broadcasts."""

    wanted: DataFrame
    facts: DataFrame
    few: bool
    limit: int


def wanted_ranges(traits: DataFrame, wanted: DataFrame, limit: int = BROADCAST_BYTES) -> TraitRanges:
    """The part of ``trait_facts`` that needs no occurrences."""
    wanted = checkpoint(wanted)
    # The terms, their traits and their numbers are all smaller than this.
    text = F.expr("octet_length(traitSelector) + aggregate(wanted, 0L, (n, t) -> n + octet_length(t.trait) + 96)")
    size = wanted.agg(F.count("*").alias("n"), F.coalesce(F.sum(text), F.lit(0)).alias("bytes")).first()
    few = fits(size.n, size.bytes, limit)
    ranges = trait_ranges(traits, wanted.select(F.explode("wanted").alias("t")).select("t.*"), few)
    return TraitRanges(wanted, measured(checkpoint(ranges), "element", "trait", limit=limit), few, limit)


def trait_facts(occurrences: DataFrame, known: TraitRanges) -> TraitFacts:
    """``occurrences`` is any table that holds every taxon path in question."""
    return TraitFacts(known.wanted, checkpoint(path_facts(occurrences, known.ranges)), known.few, known.limit)


def with_traits(rows: DataFrame, known: TraitFacts) -> DataFrame:
    """Rows of (taxon, traitSelector, ...) whose path qualifies; a null list lets a row pass."""
    held = F.expr("aggregate(facts, 0L, (n, f) -> n + octet_length(f.trait) + 96 + 8 * size(f.hits))")
    size = known.facts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("taxon") + held), F.lit(0)).alias("bytes")).first()
    listed = small_side(known.facts, size.n, size.bytes, known.limit)
    asked = known.wanted.select(F.col("traitSelector").alias("_asked"), "wanted")
    asked = F.broadcast(asked) if known.few else asked
    joined = rows.join(asked, F.col("traitSelector") == F.col("_asked"), "left").join(listed, "taxon", "left")
    kept = joined.filter(F.col("traitSelector").isNull() | F.coalesce(F.expr(_qualifies("wanted", "facts")), F.lit(False)))
    return kept.select(*rows.columns)


class TraitPasses(NamedTuple):
    """Which profiles (distinct lists of facts of a taxon path) which trait selectors take, worked out before the match."""

    taxa: DataFrame
    pairs: DataFrame

    def profiled(self, rows: DataFrame) -> DataFrame:
        """Rows of (taxon, ...) with the profile of their path; -1 without any facts."""
        taxa = self.taxa.select(F.col("taxon").alias("_path"), F.col("_profile").alias("_known"))
        rows = rows.join(taxa, F.col("taxon") == F.col("_path"), "left").withColumn("_profile", F.coalesce("_known", F.lit(-1)))
        return rows.drop("_path", "_known")

    def passed(self, rows: DataFrame) -> DataFrame:
        """Those rows of (traitSelector, _profile, ...) whose profile qualifies; a null list lets a row pass."""
        asks = F.coalesce("traitSelector", F.lit("")) == F.col("_asked")
        return rows.join(self.pairs, asks & (F.col("_profile") == F.col("_taken")), "left_semi")


def trait_passes(known: TraitFacts) -> TraitPasses | None:
    """None if the pairs of profile and trait selector could be many: then matched rows are tested one by one."""
    in_order = F.array_sort(F.transform("facts", lambda f: f.withField("hits", F.array_sort(f["hits"]))))
    facts = known.facts.select("taxon", in_order.alias("facts"))
    profiles = checkpoint(facts.select("facts").distinct().withColumn("_profile", F.monotonically_increasing_id()))
    size = known.wanted.agg(F.count("*").alias("n"), F.coalesce(F.max(F.octet_length("traitSelector")), F.lit(0)).alias("most")).first()
    # Every profile takes the rows without a list, and every pair may qualify.
    count = (profiles.count() + 1) * (size.n + 1)
    if not fits(count, count * size.most):
        return None
    free = profiles.select("_profile").unionByName(profiles.sparkSession.range(1).select(F.lit(-1).cast("long").alias("_profile")))
    pairs = profiles.crossJoin(known.wanted).filter(F.expr(_qualifies("wanted", "facts"))).select("traitSelector", "_profile")
    pairs = checkpoint(pairs.unionByName(free.withColumn("traitSelector", F.lit(""))).toDF("_asked", "_taken"))
    taxa = measured(checkpoint(facts.join(profiles, "facts").select("taxon", "_profile")), "taxon", limit=known.limit)
    return TraitPasses(taxa, F.broadcast(pairs) if fits(count, count * size.most, known.limit) else pairs)


def _condition(term):
    """A term as a filter on the table of traits."""
    named = F.col("trait") == term["trait"]
    if not term["op"]:
        return named
    value, number = F.col("value"), F.lit(term["number"])
    tests = {"<": value < number, "<=": value <= number, "=": value == number, ">=": value >= number, ">": value > number}
    return named & tests[term["op"]]


def trait_filter(
    occurrences: DataFrame, traits: DataFrame, trait_selector: str, limit: int = BROADCAST_BYTES
) -> DataFrame:
    """Records of taxa that have any of the listed traits: one semi join on the taxon path.

    The terms reach the scan of the traits; records are read once more for their taxon paths.
    """
    spark = occurrences.sparkSession
    one = spark.createDataFrame([(trait_selector,)], "traitSelector string")
    found = one.select(F.transform(terms(F.col("traitSelector")), _parsed).alias("wanted")).first().wanted
    if not found:
        return occurrences
    condition = F.lit(False)
    for term in found:
        condition = condition | _condition(term)
    elements = traits.filter(condition).select(strip(F.col("taxon")).alias("element")).distinct()
    taxa = measured(checkpoint(elements), "element", limit=limit)
    paths = occurrences.select("taxon").distinct().select("taxon", F.explode(path_elements(F.col("taxon"))).alias("element"))
    paths = checkpoint(paths.join(taxa, "element", "left_semi").select("taxon").distinct())
    return occurrences.join(measured(paths, "taxon", limit=limit), "taxon", "left_semi").select(*occurrences.columns)
