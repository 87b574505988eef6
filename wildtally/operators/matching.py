"""Occurrences matched with many selectors at once.

Every selector is spread over the grid cells that cover its area (large inside, small along the rim), once
per taxon term (or once under the empty term if it takes all taxa). Every occurrence looks up its own cell,
at each cell size in use, under each element of its taxon path and under the empty term. So the match is an
equi-join on a hash of (cell, term), which the join checks, and never compares all pairs:

* cells that no selector uses are dropped before terms are looked at: a semi join with the cells in use, of
  which there is a fixed number;
* pairs of cell and term that no selector uses are dropped in the same pass: by the join itself if selectors are
  broadcast, else by a semi join with the hashes in use, as long as these are few enough; so an occurrence is copied
  for its hits only;
* selectors that fit the broadcast limit are broadcast, and the occurrences are not shuffled; beyond it both
  sides are shuffled and AQE splits hot keys.

What the key leaves open is decided by the exact area test: the box, or for polygons the edges that matter
for the cell. It is left out where a whole cell is inside the area. Rim cells with many edges are joined apart,
so that the join of all others is compiled code: as many pairs as the result has rows go through it. Few records
are in such cells, so their paths are taken apart after the cells in use are known.

Counts of many selectors never shuffle pairs: records go to the task of their taxon, what its path asks of terms and
traits is worked out once per taxon, and selectors come to the records, as numbers, in blocks that can be broadcast.
"""

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wildtally.functions import cells, shapes
from wildtally.functions.selectors import terms
from wildtally.functions.taxa import path_elements
from wildtally.operators.sizes import BROADCAST_BYTES, fits, measured
from wildtally.operators.traits import TraitPasses, TraitRanges, trait_facts, trait_passes, wanted_ranges, wanted_traits, with_traits
from wildtally.selector import InvalidSelector, normalized, valid_only
from wildtally.session import checkpoint

# Selectors whose covers one task works out, beyond one task per core.
_SPREAD_ROWS = 256
# A key row in memory: its fixed columns, the heads of its arrays and the entry of the hash table.
_KEY_BYTES = 256
# The same with numbers in place of the selector and its trait list.
_NUMBERED_BYTES = 192
# The number of the empty term; all others count from 0.
_ANY_TAXON = -1
# Blocks of selectors that records are counted by in turn, at most.
_MOST_BLOCKS = 8
# From so many keys on, it pays to work out which taxa have the traits in question before the match.
_MANY_KEYS = 10_000
# Records of one task that counts them by taxon, and those that one taxon may add to it.
_TASK_RECORDS, _HOT_RECORDS = 500_000, 100_000
# Up to this many edges of a rim cell are tested by an expression written out; code for more is too long for the JVM to compile.
_FEW_EDGES = 3


def _areas(selectors: DataFrame) -> DataFrame:
    """One row per box of a selector, or per polygon with all its edges."""
    # A trait list without a term restricts nothing: it is null from here on.
    restricting = F.when(F.size(terms(F.col("traitSelector"))) > 0, F.col("traitSelector"))
    parsed = selectors.select(
        "uuid",
        restricting.alias("traitSelector"),
        terms(F.col("taxonSelector")).alias("terms"),
        shapes.area("wktString").alias("a"),
    )
    areas = parsed.select("uuid", "traitSelector", "terms", "a.*").filter("supported")
    return areas.select("uuid", "traitSelector", "terms", F.explode("boxes").alias("box"), "edges")


def _key(cell: str, term: str) -> str:
    return f"xxhash64({cell}, {term})"


def selector_keys(selectors: DataFrame) -> DataFrame:
    """One row per selector, cell and taxon term, with the terms before it and what is left to test there."""
    # An outer explode: Spark would work out the cover twice to leave out empty ones, and there are none but of flat shapes.
    covered = _areas(selectors).withColumn("c", F.explode_outer(F.expr(cells.cover("box", "edges")))).filter("c IS NOT NULL")
    rows = covered.selectExpr(
        "uuid",
        "traitSelector",
        "c.level AS level",
        "c.cell AS cell",
        "posexplode(CASE WHEN size(terms) = 0 THEN array('') ELSE terms END) AS (at, term)",
        "terms",
        "c.whole AS whole",
        "CASE WHEN NOT c.whole AND edges IS NULL THEN box END AS box",
        f"CASE WHEN NOT c.whole THEN {shapes.sloped('c.edges')} END AS edges",
    )
    rows = rows.withColumn("before", F.expr("CASE WHEN at > 0 THEN slice(terms, 1, at) END")).drop("terms", "at")
    return rows.withColumn("key", F.expr(_key("cell", "term")))


def _measure(keys: DataFrame):
    text = F.octet_length("uuid") + F.coalesce(F.octet_length("traitSelector"), F.lit(0))
    listed = F.coalesce(F.octet_length(F.array_join("before", "")) + F.lit(24) * F.size("before"), F.lit(0))
    shape = F.coalesce(F.lit(56) * F.size("edges"), F.lit(0))
    numbered = F.octet_length("term") + listed + shape
    return keys.agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(text + numbered), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum(numbered), F.lit(0)).alias("numbered"),
        F.count_distinct("key").alias("keys"),
        F.collect_set("level").alias("levels"),
        (F.count("traitSelector") > 0).alias("traits"),
        F.coalesce(F.max(F.size("edges")), F.lit(0)).alias("edges"),
        F.collect_set(F.when(F.size("edges") > _FEW_EDGES, F.col("level"))).alias("many_edges"),
    ).first()


class SelectorIndex(NamedTuple):
    """Selectors as keys to match with, and what was measured on them."""

    selectors: DataFrame
    keys: DataFrame
    levels: list
    has_traits: bool
    has_edges: bool
    many_edges: list
    many: bool
    small: bool
    few_keys: bool
    limit: int
    blocks: int


def selector_index(selectors: DataFrame, broadcast_limit: int = BROADCAST_BYTES) -> SelectorIndex:
    """Of selectors from ``prepared``."""
    keys = checkpoint(selector_keys(selectors))
    size = _measure(keys)
    small = fits(size.n, size.bytes, broadcast_limit, _KEY_BYTES)
    few_keys, many = fits(size["keys"], 0), size.n >= _MANY_KEYS
    # As many as it takes for each to fit; none if nothing may be broadcast.
    blocks = -(-(_NUMBERED_BYTES * size.n + size.numbered) // broadcast_limit) if broadcast_limit else 0
    return SelectorIndex(
        selectors, keys, sorted(size.levels), size.traits, size.edges > 0, sorted(size.many_edges), many, small, few_keys, broadcast_limit, blocks
    )


def prepared(selectors: DataFrame) -> DataFrame:
    """The valid selectors, normalised, with their UUID, each once and spread over many tasks."""
    rows = checkpoint(valid_only(normalized(selectors)))
    # A small table comes out of a shuffle in one partition; covers are worth a task per core.
    parts = rows.sparkSession.sparkContext.defaultParallelism + rows.count() // _SPREAD_ROWS
    return rows.repartition(parts, "uuid")


def match_selectors(
    occurrences: DataFrame,
    selectors: DataFrame,
    traits: DataFrame | None = None,
    broadcast_limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Each occurrence once per selector it belongs to: its columns, with ``uuid``.

    Selectors that are not valid, or whose area has no inside, match nothing. Trait lists need
    ``traits``; without it a selector with a trait list is refused.
    """
    return match_index(occurrences, selector_index(prepared(selectors), broadcast_limit), traits)


def count_taxa(occurrences: DataFrame, index: SelectorIndex, traits: DataFrame | None = None) -> DataFrame:
    """(uuid, taxon, n): records per selector and taxon path.

    Pairs with many selectors are counted in the task of their taxon. Where the match needs a shuffle, equal
    records at equal points are counted before it.
    """
    rows, ranges = occurrences.select("taxon", "lat", "lng"), index_traits(index, traits)
    in_blocks = 0 < index.blocks <= _MOST_BLOCKS
    if index.many and (in_blocks or index.small):
        taxa = checkpoint(rows.groupBy("taxon").agg(F.count("*").alias("n")))
        known = trait_facts(taxa, ranges) if ranges else None
        passes = trait_passes(known) if known else None
        if in_blocks and (passes is not None or not known):
            return _at_taxa(rows, taxa, _counter_of_blocks(taxa, index, passes))
    if index.small:
        if not index.many:
            return _counted(match_known(rows, index, ranges))
        return _at_taxa(rows, taxa, lambda some: _counted(match_known(some, index, ranges)))
    points = rows.groupBy("taxon", "lat", "lng").agg(F.count("*").alias("_n"))
    return match_known(points, index, ranges).groupBy("uuid", "taxon").agg(F.sum("_n").alias("n"))


def _counted(matched: DataFrame) -> DataFrame:
    return matched.groupBy("uuid", "taxon").agg(F.count("*").alias("n"))


def _at_taxa(rows: DataFrame, taxa: DataFrame, counted: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Records counted in the task of their taxon: nearly as many pairs as there are need no shuffle then. Hot taxa stay where they are."""
    parts, hot = _spread_of_taxa(taxa)
    is_hot = F.coalesce(F.col("taxon").isin([t for t in hot if t is not None]), F.lit(None in hot))
    # The counts of one taxon after the other stay in the cache of the processor.
    found = counted(rows.filter(~is_hot).repartition(parts, "taxon").sortWithinPartitions("taxon"))
    return found.unionByName(counted(rows.filter(is_hot))) if hot else found


def _spread_of_taxa(taxa: DataFrame):
    """How many tasks to spread taxa over, and the taxa with too many records for one of them: fewer than tasks."""
    total = taxa.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(4 * taxa.sparkSession.sparkContext.defaultParallelism, -(-total // _TASK_RECORDS))
    return parts, [row.taxon for row in taxa.filter(F.col("n") * parts > total).filter(F.col("n") > _HOT_RECORDS).collect()]


def _counter_of_blocks(taxa: DataFrame, index: SelectorIndex, passes: TraitPasses | None) -> Callable[[DataFrame], DataFrame]:
    """Counts records by selector and taxon; numbers stand for selectors, trait lists and taxon terms, so pairs carry and compare no text."""
    number, block = F.monotonically_increasing_id(), F.expr(f"pmod(xxhash64(_selector), {index.blocks})").alias("block")
    uuids = checkpoint(index.keys.select("uuid").distinct().withColumn("_selector", number).select("*", block))
    keys = index.keys.join(uuids, "uuid").drop("uuid")
    taken = None
    if passes is not None:
        lists = checkpoint(index.keys.select(F.coalesce("traitSelector", F.lit("")).alias("_asked")).distinct().withColumn("_ask", number))
        keys = keys.join(lists, F.coalesce("traitSelector", F.lit("")) == F.col("_asked"))
        # One number is the fastest key here too.
        taken = checkpoint(passes.pairs.join(lists, "_asked").selectExpr("xxhash64(_ask, _taken) AS _pass", "_ask AS _asked", "_taken"))
        taken = measured(taken, limit=index.limit)
    carried = ["_selector"] if taken is None else ["_selector", "_ask"]
    any_taxon = F.lit(_ANY_TAXON).cast("long")
    numbered = index.keys.select("term").distinct().withColumn("_number", F.when(F.col("term") == "", any_taxon).otherwise(number))
    numbered = measured(checkpoint(numbered), "term", limit=index.limit)
    keys = keys.join(numbered, "term").withColumn("term", F.col("_number")).drop("_number")
    lists_before = index.keys.filter("before IS NOT NULL").select("before").distinct()
    listed = lists_before.select("before", F.explode("before").alias("term")).join(numbered, "term")
    listed = checkpoint(listed.groupBy("before").agg(F.collect_list("_number").alias("_before")))
    keys = keys.join(listed, "before", "left").withColumn("before", F.col("_before")).withColumn("key", F.expr(_key("cell", "term")))
    keys = keys.select("block", *carried, "level", "cell", "term", "before", "whole", "box", "edges", "key")
    # Rows of a key side by side: a record goes through them in the order they have in memory.
    keys = checkpoint(keys.repartition(index.blocks, "key").sortWithinPartitions("key"))

    elements = taxa.select("taxon", F.explode(path_elements(F.col("taxon"))).alias("term")).join(numbered, "term")
    elements = elements.groupBy("taxon").agg(F.collect_list("_number").alias("_used"))
    paths = taxa.select("taxon").join(elements, "taxon", "left")
    paths = paths.withColumn("_used", F.concat(F.array(any_taxon), F.coalesce("_used", F.array().cast("array<long>"))))
    paths = checkpoint((paths if passes is None else passes.profiled(paths)).withColumnRenamed("taxon", "_path"))
    # The elements in use are no longer than the path.
    paths = measured(paths, "_path", "_path", limit=index.limit)

    def counted(rows: DataFrame) -> DataFrame:
        rows = rows.join(paths, F.col("taxon") == F.col("_path"), "left")
        profile = [] if taken is None else [F.coalesce("_profile", F.lit(-1)).alias("_profile")]
        rows = rows.select("taxon", "lat", "lng", *profile, F.coalesce("_used", F.array(any_taxon)).alias("_terms"))
        return reduce(DataFrame.unionByName, [in_block(rows, at) for at in range(index.blocks)])

    def in_block(rows: DataFrame, at: int) -> DataFrame:
        pairs = _pairs(rows, index._replace(keys=keys.filter(F.col("block") == at), small=True), carried)
        if taken is not None:
            same = F.expr("CASE WHEN _ask = _asked AND _profile = _taken THEN true END")
            pairs = pairs.withColumn("_paired", F.expr("xxhash64(_ask, _profile)")).join(taken, (F.col("_paired") == F.col("_pass")) & same, "left_semi")
        counts = pairs.groupBy("taxon", "_selector").agg(F.count("*").alias("n"))
        return counts.join(F.broadcast(uuids.filter(F.col("block") == at)), "_selector").select("uuid", "taxon", "n")

    return counted


def index_traits(index: SelectorIndex, traits: DataFrame | None = None) -> TraitRanges | None:
    """What the trait lists of an index ask of ``traits``, to match any number of tables with; nothing if there are none."""
    if not index.has_traits:
        return None
    if traits is None:
        raise InvalidSelector("a trait list needs a table of traits")
    return wanted_ranges(traits, wanted_traits(index.selectors), index.limit)


def match_index(occurrences: DataFrame, index: SelectorIndex, traits: DataFrame | None = None) -> DataFrame:
    """The same with an index; jobs run here already, but nothing is written before traits are known to be there."""
    return match_known(occurrences, index, index_traits(index, traits))


def match_known(occurrences: DataFrame, index: SelectorIndex, ranges: TraitRanges | None) -> DataFrame:
    """The same with what is known of the traits."""
    rows = occurrences
    known = trait_facts(occurrences, ranges) if ranges else None
    passes = trait_passes(known) if known and index.many else None
    if passes is not None:
        rows = passes.profiled(rows)
    matched = _pairs(rows, index, ["uuid", "traitSelector"])
    if passes is not None:
        matched = passes.passed(matched)
    elif known:
        matched = with_traits(matched, known)
    return matched.select(*occurrences.columns, "uuid")


def _pairs(rows: DataFrame, index: SelectorIndex, carried: list) -> DataFrame:
    """The rows with the columns ``carried`` of each key of the index they meet, inside its area; traits are not looked at."""
    # A test of any number of edges is not compiled, and neither is a join that has one: so it is a join of its own.
    few, box = shapes.inside_few_edges("lat", "lng", "_of_ends", _FEW_EDGES), shapes.in_corners("lat", "lng", "_of_corners")
    tested = f"CASE WHEN _of_ends IS NULL THEN {box} ELSE {few} END" if index.has_edges else box
    with_terms = rows if "_terms" in rows.columns else _with_terms(rows)
    matched = _matched(with_terms, index.keys.filter(f"edges IS NULL OR size(edges) <= {_FEW_EDGES}"), index, index.levels, tested, carried)
    # Without such keys it sees no records: the plan drops it as soon as its side of keys is known to be empty.
    if index.has_edges:
        inside = shapes.inside_edges("lat", "lng", "_of_edges")
        matched = matched.unionByName(_matched(rows, index.keys.filter(f"size(edges) > {_FEW_EDGES}"), index, index.many_edges, inside, carried))
    return matched


def _with_terms(rows: DataFrame) -> DataFrame:
    """What each row is looked up under: the elements of its path, and the empty term of selectors that take all taxa."""
    return rows.withColumn("_terms", F.concat(F.array(F.lit("")), path_elements(F.col("taxon"))))


def _matched(rows: DataFrame, keys: DataFrame, index: SelectorIndex, sizes: list, in_area: str, carried: list) -> DataFrame:
    """The rows with the columns ``carried`` of each key they meet, where a cell is wholly inside or ``in_area`` holds.

    ``sizes`` are the levels of the cells of ``keys``. Rows without ``_terms`` get them where their cell is in use.
    """
    levels = [F.expr(cells.cell_of("lat", "lng", level)) for level in sizes] or [F.lit(None).cast("int")]
    kept = [c for c in rows.columns if c != "_terms"]
    rows = rows.select("*", F.explode(F.array(*levels)).alias("_cell"))
    # At most one row per grid cell there is.
    rows = rows.join(F.broadcast(keys.select(F.col("cell").alias("_cell")).distinct()), "_cell", "left_semi")
    if "_terms" not in rows.columns:
        rows = _with_terms(rows)
    rows = rows.select("*", F.explode("_terms").alias("_term"))
    rows = rows.withColumn("_key", F.expr(_key("_cell", "_term")))
    # Keys that are broadcast drop the rest in their own join.
    if index.few_keys and not index.small:
        rows = rows.join(F.broadcast(keys.select(F.col("key").alias("_key")).distinct()), "_key", "left_semi")

    # Plain numbers are read without an object for each box and edge.
    shape = [F.expr(shapes.corners("box")).alias("_of_corners"), F.expr(shapes.ends("edges")).alias("_of_ends"), F.col("edges").alias("_of_edges")]
    named = keys.select(*carried, *[F.col(c).alias(f"_of_{c}") for c in ("key", "cell", "term", "before", "whole")], *shape)
    candidates = rows.join(F.broadcast(named) if index.small else named, F.col("_key") == F.col("_of_key"))
    # A path may hold several terms of one selector: only the first of them in its list counts.
    earlier = "CASE WHEN size(_of_before) = 1 THEN array_contains(_terms, get(_of_before, 0)) ELSE arrays_overlap(_terms, _of_before) END"
    first_term = f"(_of_before IS NULL OR NOT {earlier})"
    # One number is the fastest key; as a CASE, what it stands for is compared after the join and not as part of the key.
    same = "CASE WHEN _cell = _of_cell AND _term = _of_term THEN"
    return candidates.filter(f"{same} {first_term} AND (_of_whole OR {in_area}) END").select(*kept, *carried)
