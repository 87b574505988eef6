"""The prefix trie of conversations, with totals over the subtree of every node.

Turns are digested once; texts go no further. A prefix is known by its length and the sum of hashes of
(place, turn), so prefixes of a conversation of any length are sums along it: a range sort cuts long
conversations across tasks and the sums of the ranges are added up. A node is (smallest member, depth),
its parent (smallest member of the prefix before, depth - 1); sorted by these, parents come before children.

Totals go up by time-forward processing. Nodes are cut into shards, ranges of that order. Each shard reads
its nodes in reverse level order (Spark sorts them, on disk if need be); a node takes what its children
sent from a spilling priority queue, adds its own and sends the sum to its parent. What is addressed to
another shard leaves as a message. The nodes that get such messages, and the nodes where the ways up from
two of them meet, make up a smaller tree of the ways between shards, whose totals are found in the same
way; with them, a second run over the shards gives the totals of all nodes.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wildtally.llm.ranks import ranked
from wildtally.llm.spilling_queue import HELD, SpillingQueue
from wildtally.llm.tables import settings, written
from wildtally.operators.sizes import measured

# Nodes of a shard; twice as many on each smaller tree, so that these come to an end.
SHARD_NODES = 1 << 15
# Members whose ids are put together as one text.
END_CHUNK = 4096
BLOCK, HEADS = 100, 6

_LIMBS = ["h0", "h1", "h2", "h3"]
_NODE = "conv_id long, depth long, up_conv long, up_depth long"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, chars): role and text as a digest, null as empty; rows without conv_id are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    both = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), F.md5(both.cast("binary")).alias("digest"), F.length(text).cast("long").alias("chars")
    )
    return rows.filter("conv_id IS NOT NULL")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations (conv_id, size), and their turns after the rebuilding (conv_id, place, digest, chars)."""
    given = ranked(turns(conversations), "conv_id", ["turn", "digest"])
    own = given.filter("idx = 0").selectExpr("conv_id", "n", f"conv_id - conv_id % {BLOCK} AS base", f"crc32(CAST(CAST(conv_id AS STRING) AS BINARY)) % {HEADS} AS h")
    bases = own.selectExpr("conv_id AS base", "n AS base_n")
    convs = own.join(bases, "base", "left").withColumn("head", F.expr("least(h, coalesce(base_n, 0L))"))
    convs = written(convs.selectExpr("conv_id", "base", "h", "head", "head + greatest(n - h, 0L) AS size"), "convs")
    # A conversation takes at most five turns from its base, and a base serves at most 199 conversations.
    heads = given.filter(f"idx < {HEADS - 1}").selectExpr("conv_id AS base", "idx AS place", "digest", "chars")
    taken = convs.filter("head > 0").select("conv_id", "base", "head").join(heads, "base").filter("place < head")
    kept = given.join(measured(convs.select("conv_id", "h", "head")), "conv_id").filter("idx >= h")
    columns = ["conv_id", "place", "digest", "chars"]
    return convs.select("conv_id", "size"), taken.select(columns).unionAll(kept.withColumn("place", F.expr("idx - h + head")).select(columns))


def _summed(batches):
    """Sums of the hashes along each conversation, within one range."""
    last, carry = None, np.zeros(4, dtype=np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column(0).to_numpy()
        value = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=">u4").reshape(-1, 4).astype(np.int64)
        first = np.append(True, conv[1:] != conv[:-1])
        total = np.cumsum(value, axis=0)
        starts = np.flatnonzero(first)
        before = total[starts] - value[starts]
        if conv[0] == last:
            before[0] -= carry
        total -= np.repeat(before, np.diff(np.append(starts, len(conv))), axis=0)
        last, carry = conv[-1], total[-1]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), *[pa.array(value[:, i]) for i in range(4)], *[pa.array(total[:, i]) for i in range(4)], batch.column(4)],
            names=["conv_id", "place", "chars", *[f"v{i}" for i in range(4)], *_LIMBS, "part"],
        )


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, chars, key, up): each prefix of each conversation under its key, and the one before it."""
    value = F.unhex(F.md5(F.concat(F.col("place").cast("string"), F.lit(":"), F.col("digest")).cast("binary")))
    spread = rows.select("conv_id", "place", "chars", value.alias("value"))
    ordered = spread.repartitionByRange("conv_id", "place").sortWithinPartitions("conv_id", "place").withColumn("part", F.spark_partition_id())
    longs = ", ".join(f"{c} long" for c in [*[f"v{i}" for i in range(4)], *_LIMBS])
    sums = written(ordered.mapInArrow(_summed, f"conv_id long, place long, chars long, {longs}, part int"), "sums")
    runs = sums.groupBy("part", "conv_id").agg(*[F.max(c).alias(c) for c in _LIMBS])
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = runs.select("part", "conv_id", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"s_{c}") for c in _LIMBS]).filter("s_h0 > 0")
    joined = sums.join(measured(shifts), ["part", "conv_id"], "left")
    limbs = [F.col(c) + F.coalesce(F.col(f"s_{c}"), F.lit(0)) for c in _LIMBS]
    key = lambda depth, parts: F.md5(F.concat_ws(",", depth, *parts).cast("binary"))
    up = [limb - F.col(f"v{i}") for i, limb in enumerate(limbs)]
    return joined.select("conv_id", (F.col("place") + 1).alias("depth"), "chars", key(F.col("place") + 1, limbs).alias("key"), key(F.col("place"), up).alias("up"))


def _digested(batches):
    """SHA-256 over the texts of a node's chunks, one after another."""
    import hashlib

    held, state = None, None
    for batch in batches:
        keys, texts = [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key != held:
                if state is not None:
                    keys.append(held)
                    texts.append(state.hexdigest())
                held, state = key, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(texts, pa.string())], names=["key", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([held]), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])


def _ends(ended: DataFrame) -> DataFrame:
    """(key, ends_sha256) of (key, conv_id): ids are put together in chunks, and chunks are read in order."""
    chunks = ranked(ended, "key", ["conv_id"]).groupBy("key", F.expr(f"idx DIV {END_CHUNK}").alias("chunk"))
    texts = chunks.agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("text"))
    return texts.repartition("key").sortWithinPartitions("key", "chunk").select("key", "text").mapInArrow(_digested, "key string, ends_sha256 string")


def _shards(batches):
    """Runs of rows of one shard, as (shard, iterator of rows)."""
    from itertools import groupby

    rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
    return groupby(rows, key=lambda row: row[0])


def _emitted(rows, names, types):
    from itertools import islice

    rows = iter(rows)
    while part := list(islice(rows, 10_000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types)], names=names)


def _plus(one, other):
    return one[0] + other[0], one[1] + other[1]


def _summing(foreign: bool, held: int):
    """Totals up a shard: those of its nodes, or (``foreign``) what is addressed to other shards."""

    def go(batches):
        for _, nodes in _shards(batches):
            queue = SpillingQueue(held, _plus)

            def leave(limit):
                # Addressees that the order has passed without meeting them are in another shard.
                while (key := queue.first()) is not None and (limit is None or key < limit):
                    message = queue.pop(key)
                    if foreign:
                        yield (-key[1], -key[0], *message)

            for _, conv, depth, up_conv, up_depth, leaves, saved in nodes:
                key = (-depth, -conv)
                yield from leave(key)
                total = _plus((leaves, saved), queue.pop(key) or (0, 0))
                if up_conv is not None:
                    queue.push((-up_depth, -up_conv), total)
                if not foreign:
                    yield (conv, depth, *total)
            yield from leave(None)

    names = ["conv_id", "depth", "leaves", "saved"]
    return lambda batches: _emitted(go(batches), names, [pa.int64()] * 4)


def _contracting(held: int):
    """The tree of the ways between shards: nodes that get messages, nodes where their ways meet, and who is next above.

    A node hands up the last such node below it; where two come together, the node is one itself.
    """

    def go(batches):
        for _, nodes in _shards(batches):
            queue = SpillingQueue(held)

            def leave(limit):
                while (key := queue.first()) is not None and (limit is None or key < limit):
                    for below in queue.pop(key):
                        yield (*below, -key[1], -key[0], True)

            for _, conv, depth, up_conv, up_depth, entered in nodes:
                key = (-depth, -conv)
                yield from leave(key)
                below = queue.pop(key) or []
                if entered or len(below) > 1:
                    for node in below:
                        yield (*node, conv, depth, False)
                    below = [(conv, depth)]
                if below and up_conv is None:
                    yield (*below[0], None, None, False)
                elif below:
                    queue.push((-up_depth, -up_conv), below)
            yield from leave(None)

    names = ["conv_id", "depth", "up_conv", "up_depth", "crosses"]
    return lambda batches: _emitted(go(batches), names, [pa.int64()] * 4 + [pa.bool_()])


def subtree_totals(nodes: DataFrame, shard_nodes: int = SHARD_NODES, held: int = HELD) -> DataFrame:
    """(conv_id, depth, leaves, saved) summed over the subtree of each node.

    ``nodes``: (conv_id, depth, up_conv, up_depth, leaves, saved) of one tree, with nulls above its root.
    """
    count = nodes.count()
    parts = -(-count // shard_nodes) or 1
    spread = nodes.repartitionByRange(parts, "conv_id", "depth").withColumn("shard", F.spark_partition_id())
    sharded = written(spread.select("shard", "conv_id", "depth", "up_conv", "up_depth", "leaves", "saved"), "shards")
    run = lambda rows, work, schema: (
        rows.repartition(parts, "shard").sortWithinPartitions("shard", F.desc("depth"), F.desc("conv_id")).mapInArrow(work, schema)
    )
    sums = "conv_id long, depth long, leaves long, saved long"
    if parts == 1:
        return run(sharded, _summing(False, held), sums)
    place = ["conv_id", "depth"]
    messages = run(sharded, _summing(True, held), sums)
    entries = written(messages.groupBy(*place).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "entries")
    entered = sharded.join(entries.select(*place, F.lit(True).alias("entered")), place, "left")
    entered = entered.select("shard", *place, "up_conv", "up_depth", F.coalesce("entered", F.lit(False)).alias("entered"))
    ways = written(run(entered, _contracting(held), f"{_NODE}, crosses boolean"), "ways")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("leaves", "saved")]
    smaller = ways.join(entries, place, "left").select(*place, "up_conv", "up_depth", *zero)
    above = written(subtree_totals(smaller, shard_nodes * 2, held), "above")
    crossing = ways.filter("crosses").join(above, place).selectExpr("up_conv AS conv_id", "up_depth AS depth", "leaves", "saved")
    given = entries.unionByName(crossing).groupBy(*place).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    own = sharded.join(given, place, "left")
    plus = [(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")]
    return run(own.select("shard", *place, "up_conv", "up_depth", *plus), _summing(False, held), sums)


def trie(conversations: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """One row per node: members, children, leaves and saved code points of its subtree, digest of its ends.

    Turns are in order of ``turn``, null first, then by a digest of role and text. Null roles and texts are
    empty; rows without a ``conv_id`` belong to no conversation; repeated rows are turns of their own. No
    conversation, no node. Further columns are not looked at.
    """
    settings(conversations.sparkSession)
    convs, rows = rebuilt(conversations)
    steps = written(prefixes(rows), "prefixes")
    root = F.md5(F.lit("0,0,0,0,0").cast("binary"))
    found = steps.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("up").alias("up"), F.count("*").alias("n_convs"), F.first("chars").alias("chars")
    )
    tops = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    zero = F.lit(0).cast("long")
    tops = tops.select(root.alias("key"), "conv_id", zero.alias("depth"), F.lit(None).cast("string").alias("up"), "n_convs", zero.alias("chars"))
    nodes = written(found.unionByName(tops), "nodes")
    parents = nodes.select(F.col("key").alias("up"), F.col("conv_id").alias("up_conv"))
    children = nodes.groupBy(F.col("up").alias("key")).agg(F.count("*").alias("n_children"))
    linked = nodes.join(parents, "up", "left").join(children, "key", "left")
    linked = written(linked.withColumn("n_children", F.coalesce("n_children", zero)), "linked")
    own = linked.selectExpr(
        "conv_id", "depth", "up_conv", "CASE WHEN up_conv IS NOT NULL THEN depth - 1 END AS up_depth",
        "IF(n_children = 0, 1L, 0L) AS leaves", "(n_convs - 1) * chars AS saved",
    )
    totals = subtree_totals(own, shard_nodes).selectExpr("conv_id", "depth", "leaves AS n_leaves", "saved AS saved_tokens")
    last = steps.join(convs, (steps.conv_id == convs.conv_id) & (steps.depth == convs["size"])).select("key", steps.conv_id)
    ended = last.unionByName(convs.filter("size = 0").select(root.alias("key"), "conv_id"))
    result = linked.join(totals, ["conv_id", "depth"]).join(_ends(ended), "key", "left")
    none = F.sha2(F.lit("").cast("binary"), 256)
    return result.select(
        "conv_id",
        "depth",
        F.col("up_conv").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )


# Sequences of turns themselves are the keys; each node adds to all its prefixes.
TRIE_SQL = """
WITH RECURSIVE crcs AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i::UBIGINT], range(8)::UBIGINT[]),
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS crc
), given AS (
  SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said, turn FROM conversations WHERE conv_id IS NOT NULL
), original AS (
  SELECT conv_id, list(said ORDER BY turn NULLS FIRST, md5(strlen(said.role)::VARCHAR || ':' || said.role || said.text)) AS said FROM given GROUP BY conv_id
), headed AS (
  SELECT conv_id, said, (xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::UBIGINT)),
    lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 6)::BIGINT AS h
  FROM original, crcs
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.said, [])[1:c.h], c.said[c.h + 1:]) AS said
  FROM headed c LEFT JOIN original b ON b.conv_id = c.conv_id - c.conv_id % 100
), steps AS (
  SELECT conv_id, d AS depth, said[1:d] AS node, len(said) = d AS ends FROM rebuilt, unnest(range(len(said) + 1)) AS u(d)
), nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM steps GROUP BY node, depth
), children AS (
  SELECT node[1:depth - 1] AS node, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL
), full_nodes AS (
  SELECT v.*, coalesce(c.n, 0) AS n_children, CASE WHEN v.depth = 0 THEN 0 ELSE (v.n_convs - 1) * length(v.node[v.depth].text) END AS saved
  FROM nodes v LEFT JOIN children c ON c.depth = v.depth AND c.node = v.node
), totals AS (
  SELECT node[1:d] AS node, d AS depth, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM full_nodes, unnest(range(depth + 1)) AS u(d) GROUP BY ALL
)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, t.n_leaves, t.saved_tokens, v.ends_sha256
FROM full_nodes v JOIN totals t ON t.depth = v.depth AND t.node = v.node
LEFT JOIN nodes p ON p.depth = v.depth - 1 AND p.node = v.node[1:v.depth - 1]"""
