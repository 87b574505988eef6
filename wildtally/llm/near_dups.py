"""Near duplicates by bottom-k sketches.

A document's set holds the hashes of its distinct word shingles (one hash function); its sketch is the
K smallest of them. Documents with equal sets form a class and only one of a class goes on. Inverted
lists of the retained values bring documents together, a Jaccard estimate from the sketch of the union
filters the pairs, and full sets confirm them. Links become components.

Which values are listed: a linked pair shares most of both sketches, so it is enough to list each
document under its rarest values (as many as the pair may differ in, and one more). Passages that a
large part of the corpus shares thus make no lists, unless a document consists mostly of them.

Within a list nobody is compared with everybody. The list's most central document, the one whose
values are most common, is compared with all others. Members of one component then need no further
comparison; those outside the list's largest component are compared with the members of other
components, as long as they are few. Documents of lists where they are not (the documents share a
passage that is everywhere, and it makes up half of them) are listed again by their full sets. There the
rule is exact: two sets are alike only if they meet among the rarest quarter of the larger and the
rarest seventh of the smaller.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wildtally.llm.components import connected
from wildtally.llm.tables import settings, written
from wildtally.llm.tokens import Words, blobs, slices
from wildtally.operators.sizes import measured

SHINGLE = 5
PERCENT = 75
# Sketch size, and how many values two linked documents share at least if both sketches are full.
# The number shared is at least binomial (K, 0.75): below SHARED with a chance of about 1e-10.
K, SHARED = 128, 64
# Members outside its largest component that a list may have to be settled by comparisons.
OUTSIDERS = 16
# Full sets that are checked against one centre in one group.
CHUNK = 128


def _sets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of all set members, sorted by row and value, without repeats."""
    at, values = words.windows(SHINGLE)
    rows = words.rows()[at]
    counts = words.counts()
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        rows, values = np.concatenate([rows, short]), np.concatenate([values, words.whole()[short]])
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return rows[new], values[new]


_SKETCHED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set_key", pa.binary()), ("sketch", pa.list_(pa.int64()))])


def _sketched(batches):
    for batch in slices(batches):
        rows, values = _sets(Words(batch.column(1), folded=True))
        bounds = np.searchsorted(rows, np.arange(batch.num_rows + 1))
        odd = values * np.uint64(0x9FB21C651E98DF25)
        odd ^= odd >> np.uint64(29)
        one, two = (np.concatenate([[np.uint64(0)], np.cumsum(x)]) for x in (values, odd * odd))
        keys = np.stack([x[bounds[1:]] - x[bounds[:-1]] for x in (one, two)], axis=1)
        tops = np.minimum(bounds[:-1] + K, bounds[1:])
        offsets = np.concatenate([[0], np.cumsum(tops - bounds[:-1])])
        first = np.repeat(bounds[:-1] - offsets[:-1], np.diff(offsets)) + np.arange(offsets[-1])
        signed = (values[first] ^ np.uint64(1 << 63)).view(np.int64)  # Spark sorts them in the order in which they were taken
        sketch = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(signed))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds)), blobs(keys), sketch], schema=_SKETCHED)


def sketched(docs: DataFrame) -> DataFrame:
    """``doc_id, n`` (set size), ``set_key`` (equal for equal sets), ``sketch`` (its K smallest values)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sketched, "doc_id long, n long, set_key binary, sketch array<long>")


_SET = pa.schema([("doc_id", pa.int64()), ("values", pa.binary())])


def _full(batches):
    for batch in slices(batches):
        rows, values = _sets(Words(batch.column(1), folded=True))
        bounds = np.searchsorted(rows, np.arange(batch.num_rows + 1))
        parts = [values[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), blobs(parts)], schema=_SET)


_MEMBERS = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("members", pa.list_(pa.int64()))])


def _members(batches):
    for batch in slices(batches):
        rows, values = _sets(Words(batch.column(1), folded=True))
        bounds = np.searchsorted(rows, np.arange(batch.num_rows + 1))
        members = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds)), members], schema=_MEMBERS)


def _listed(values: DataFrame, full: bool) -> DataFrame:
    """The lists ``v, id, n, score, low`` of ``values`` (id, n, v): each document under its rarest values.

    ``score``: how common a document's values are in all; ``low``: whether the value is among those
    that it has to share with a larger set.
    """
    often = written(values.groupBy("v").agg(F.count("*").alias("often")).filter("often > 1"), "often")
    size, needed = F.col("n"), F.ceil(F.lit(PERCENT) * F.col("n") / 100)
    if not full:
        size = F.least(F.col("n"), F.lit(K))
        needed = F.when(F.col("n") < K, F.least(needed, F.lit(SHARED))).otherwise(F.lit(SHARED))  # a larger set's sketch holds a part of it only
    per_doc = values.join(often, "v").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("often", "v"))).alias("have"))
    alone = size - F.size("have")  # values found only here come first and need no list
    kept = per_doc.withColumn("room", (size - needed + 1 - alone).cast("int")).filter("room > 0")
    short = size - F.ceil(F.lit(2 * PERCENT) * size / (100 + PERCENT)) + 1 - alone if full else F.col("room")
    score = F.expr("aggregate(have, 0L, (s, x) -> s + x.often)")
    kept = kept.select("id", "n", score.alias("score"), short.alias("short"), F.posexplode(F.slice("have", 1, F.col("room"))).alias("at", "have"))
    return kept.selectExpr("have.v AS v", "id", "n", "score", "at < short AS low")


def _alike(a: str, b: str, slack: bool):
    """Whether sizes allow the similarity; with ``slack``, whether the sketch of the union does."""
    if not slack:
        return F.expr(f"100 * least({a}, {b}) >= {PERCENT} * greatest({a}, {b})")
    shared = f"array_intersect({a}.sketch, {b}.sketch)"
    union = f"slice(array_sort(array_union({a}.sketch, {b}.sketch)), 1, {K})"
    return F.expr(f"size(array_intersect({union}, {shared})) >= IF(least({a}.n, {b}.n) < {K}, 0.3, {SHARED / K}) * size({union})")


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _confirmed(batches):
    """Rows sorted by key, the centre's set first: exact Jaccard of each further set with it."""
    key, centres = None, []
    for batch in batches:
        centre_of, part, rank, doc, sets = (batch.column(i) for i in range(5))
        found = []
        for i in range(batch.num_rows):
            now = (centre_of[i].as_py(), part[i].as_py())
            if now != key:
                key, centres = now, []
            values = np.frombuffer(sets[i].as_buffer(), dtype=np.uint64)
            if rank[i].as_py() == 0:
                centres.append(values)
                continue
            for centre in centres:
                shared = _shared(centre, values)
                if 100 * shared >= PERCENT * (len(centre) + len(values) - shared):
                    found.append((now[0], doc[i].as_py()))
                    break
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], schema=_LINK)


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    if not len(a) or not len(b):
        return 0
    at = np.searchsorted(a, b)
    return int(np.count_nonzero(a[np.minimum(at, len(a) - 1)] == b))


def _links(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a: centre, b) that the sketches let through and full sets confirm."""
    pairs = written(pairs.distinct(), "pairs")
    sketches = classes.select("id", F.struct("n", "sketch").alias("s"))
    pairs = sketches.selectExpr("id AS a", "s AS x").join(pairs, "a")
    pairs = sketches.selectExpr("id AS b", "s AS y").join(pairs, "b")
    pairs = written(pairs.filter(_alike("x", "y", True)).select("a", "b"), "alike")
    parts = pairs.groupBy("a").agg(F.count("*").alias("many")).withColumn("parts", F.ceil(F.col("many") / CHUNK))
    wanted = written(pairs.select(F.col("b").alias("doc_id")).unionAll(parts.select("a")).distinct(), "wanted")
    sets = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(measured(wanted), "doc_id", "left_semi")
    sets = written(sets.mapInArrow(_full, "doc_id long, values binary"), "sets")
    mine = pairs.join(parts, "a").selectExpr("a", "pmod(xxhash64(b), parts) AS part", "1 AS rank", "b AS doc_id")
    centres = parts.selectExpr("a", "explode(sequence(0L, parts - 1)) AS part", "0 AS rank", "a AS doc_id")
    rows = mine.unionAll(centres).join(sets, "doc_id").select("a", "part", "rank", "doc_id", "values")
    return rows.repartition("a", "part").sortWithinPartitions("a", "part", "rank").mapInArrow(_confirmed, "a long, b long")


def _may_be():
    """Whether sizes and places in the lists let ``id`` and ``a`` be alike."""
    return _alike("n", "an", False) & F.expr("IF(n < an, low, IF(n > an, alow, low AND alow))")


def _stars(lists: DataFrame) -> DataFrame:
    """Pairs (a, b) of the most central member of each list and each other one that may be alike."""
    centre = F.max_by(F.struct(F.col("id").alias("a"), F.col("n").alias("an"), F.col("low").alias("alow")), F.struct("score", -F.col("id")))
    picked = written(lists.groupBy("v").agg(centre.alias("c"), F.count("*").alias("many")).filter("many > 1").select("v", "c.*"), "centres")
    return lists.join(picked, "v").filter(F.expr("id != a") & _may_be()).select("a", F.col("id").alias("b"))


def _across(lists: DataFrame, component: DataFrame, limit: int | None) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) across the components of each list, and the ids of lists with more than ``limit`` outsiders."""
    now = lists.join(component.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    now = written(now, "current")
    sizes = now.groupBy("v", "component").agg(F.count("*").alias("c")).groupBy("v")
    sizes = sizes.agg((F.sum("c") - F.max("c")).alias("outside"), F.max_by("component", F.struct("c", -F.col("component"))).alias("main")).filter("outside > 0")
    hard = F.lit(False) if limit is None else F.col("outside") > limit
    sizes = written(sizes.select("v", "main", hard.alias("hard")), "open")
    rows = written(now.join(sizes, "v"), "members")
    outside = rows.filter("NOT hard AND component != main")
    others = rows.filter("NOT hard").selectExpr("v", "id AS a", "n AS an", "low AS alow", "component AS ac")
    pairs = outside.join(others, "v").filter(F.expr("component != ac AND (ac = main OR component < ac)") & _may_be())
    return pairs.selectExpr("greatest(a, id) AS a", "least(a, id) AS b"), rows.filter("hard").select("id").distinct()


def components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (doc_id, text).

    Words are folded to lower case (A-Z). A null or blank text has an empty set and no links. Rows that
    share a doc_id are one document: a link of one holds for all of them. Rows without a doc_id are
    linked with nothing, have no component and are kept. An empty table gives no rows. Other columns
    of ``docs`` are not looked at.

    Runs jobs while it is called: lists, links and components are written to the shared folder.
    """
    settings(docs.sparkSession)
    rows = written(sketched(docs), "sketches")
    known = rows.filter("n > 0 AND doc_id IS NOT NULL")
    classes = known.groupBy("set_key", "n").agg(F.min("doc_id").alias("id"), F.min_by("sketch", "doc_id").alias("sketch"))
    classes = written(classes, "classes")
    lists = written(_listed(classes.select("id", "n", F.explode("sketch").alias("v")), False), "lists")
    links = written(_links(_stars(lists), classes, docs), "links")
    component = connected(links)
    pairs, hard = _across(lists, component, OUTSIDERS)
    links = written(links.unionAll(_links(pairs, classes, docs)), "links")
    hard = measured(written(hard, "hard"))
    if not hard.isEmpty():
        texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(hard, "id", "left_semi")
        sets = texts.mapInArrow(_members, "id long, n long, members array<long>")
        values = written(sets.select("id", "n", F.explode("members").alias("v")).distinct(), "values")
        pairs, _ = _across(_listed(values, True), connected(links), None)
        links = written(links.unionAll(_links(pairs, classes, docs)), "links")
    # Documents of one class, and rows of one doc_id, hang together without a comparison.
    same = known.join(classes.select("set_key", "n", "id"), ["set_key", "n"]).selectExpr("doc_id AS a", "id AS b").filter("a != b")
    component = connected(links.unionAll(same))
    out = rows.select("doc_id", F.col("n").alias("n_shingles")).join(component.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.expr("coalesce(component, doc_id) <=> doc_id").alias("kept"))


def without_near_dups(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` of which no near duplicate has a smaller doc_id; all columns stay."""
    gone = written(components(docs).filter("NOT kept").select("doc_id").distinct(), "gone")
    return docs.join(measured(gone), "doc_id", "left_anti").select(*docs.columns)
