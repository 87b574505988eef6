"""Bulk-synchronous best-fit packing of token sequences.

Texts become ids once; of each piece only its length goes further. Pieces of full length are sequences
of their own. All others are packed in rounds over the whole table:

1. Pieces that no gap takes open sequences: one for each piece over half the limit, else as many as their
   tokens or their number need at least. So no round opens a sequence that could be spared.
2. Each gap offers one slot, or several where many short pieces wait (all of them at least as long as the
   longest piece). Pieces and slots are range-sorted together by size.
3. Each range is swept: a slot takes the longest waiting piece before it. What a range leaves over, first
   slots and then pieces, meets across ranges: the sweep goes on over the counts of the ranges, and the
   n-th slot of a stretch gets the n-th piece from its end, joined by that rank. So one slot, one piece.
4. Gaps shrink by what they got, and the next round has the pieces that are left.

Each round places the longest pieces first, and rounds are about as many as the halvings of the longest
remaining piece. The driver sees a few counts a round and two counts a range.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wildtally.llm.tables import settings, written
from wildtally.llm.tokens import slices
from wildtally.llm.word_ids import WordIds

LIMIT = 2048
# Rows of one range of the sweep.
RANGE_ROWS = 1 << 17
# Slots made from one gap at most in one round; the gap stays, so this costs rounds at most.
SLOTS = 256

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_SWEPT = "kind int, id long, size long, mate long, part int, place long"


def pieces(docs: DataFrame, vocabulary: str, limit: int = LIMIT, end_id: int = 0) -> DataFrame:
    """The ids of each whole text, then ``end_id``, cut into pieces of ``limit`` ids; the last may be shorter.

    ``vocabulary`` is the JSON text of the tokenizer. Null and empty texts have the end id only. Rows are
    kept apart as they are: a null or repeated ``doc_id`` makes pieces like any other.
    """
    settings(docs.sparkSession)

    def run(batches):
        import zlib

        encode = WordIds(vocabulary)
        for batch in slices(batches):
            at, number, length, crc = [], [], [], []
            for row, ids in enumerate(encode(batch.column(1))):
                ids = np.append(ids, end_id).astype("<u4")
                for start in range(0, len(ids), limit):
                    part = ids[start : start + limit]
                    at.append(row)
                    number.append(start // limit)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            number = pa.array(number, pa.int32())
            start = pa.array(np.array(number, dtype=np.int64) * limit)
            docs = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [docs, number, start, pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PIECES)


def _sweep(batches):
    """One range: slots that meet a piece (kind 2, with the piece as ``mate``), and what is left over.

    A piece opens and a slot closes a bracket; brackets on one level take turns, so the match of a piece is
    the next event on its level.
    """
    part = TaskContext.get().partitionId()
    batches = list(batches)
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    kind, ids, size = (table.column(n).to_numpy() for n in ("kind", "id", "size"))
    step = np.where(kind == 0, 1, -1)
    depth = np.cumsum(step)
    level = np.where(kind == 0, depth, depth + 1)
    order = np.argsort(level, kind="stable")
    pair = np.flatnonzero((level[order[1:]] == level[order[:-1]]) & (step[order[:-1]] > 0) & (step[order[1:]] < 0))
    piece, slot = order[pair], order[pair + 1]
    alone = np.ones(len(kind), dtype=bool)
    alone[piece] = alone[slot] = False
    rest = np.flatnonzero(alone)
    first = kind[rest] == 1
    place = np.where(first, np.cumsum(first), np.cumsum(~first)) - 1
    n, m = len(slot), len(rest)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([np.full(n, 2), kind[rest]]).astype(np.int32)),
            pa.array(np.concatenate([ids[slot], ids[rest]])),
            pa.array(np.concatenate([size[piece], size[rest]])),
            pa.array(np.concatenate([ids[piece], np.full(m, -1)])),
            pa.array(np.full(n + m, part, dtype=np.int32)),
            pa.array(np.concatenate([np.full(n, -1), place])),
        ],
        names=["kind", "id", "size", "mate", "part", "place"],
    )


def stretches(counts):
    """Of (range, slots left, pieces left) in order: (piece range, last place, slot range, first place, how many).

    Slots of a range come before its pieces. They take pieces of earlier ranges, the last ones first.
    """
    waiting, found = [], []
    for part, slots, left in counts:
        at = 0
        while at < slots and waiting:
            origin, have = waiting.pop()
            n = min(have, slots - at)
            found.append((origin, have - 1, part, at, n))
            if have > n:
                waiting.append((origin, have - n))
            at += n
        if left:
            waiting.append((part, left))
    return found


def _ranked(found):
    """Number the places of the stretches: a slot and its piece get the same number."""
    sides = {0: {}, 1: {}}
    done = 0
    for origin, last, part, at, n in found:
        # Pieces count down from ``last`` while slots count up from ``at``.
        sides[0].setdefault(origin, []).append((last - n + 1, last, last + done, -1))
        sides[1].setdefault(part, []).append((at, at + n - 1, done - at, 1))
        done += n
    table = {
        (kind, part): [np.array(c) for c in zip(*sorted(rows))] for kind, parts in sides.items() for part, rows in parts.items()
    }

    def run(batches):
        for batch in batches:
            kind, part, place = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("kind", "part", "place"))
            rank = np.full(len(kind), -1, dtype=np.int64)
            for key in np.unique(np.stack([kind, part], axis=1), axis=0):
                rows = np.flatnonzero((kind == key[0]) & (part == key[1]))
                if tuple(key.tolist()) not in table:
                    continue
                low, high, shift, sign = table[tuple(key.tolist())]
                i = np.searchsorted(low, place[rows], "right") - 1
                hit = (i >= 0) & (place[rows] <= high[i])
                rank[rows[hit]] = shift[i[hit]] + sign[i[hit]] * place[rows[hit]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank)], names=[*batch.schema.names, "rank"])

    return run


def _round(waiting: DataFrame, gaps: DataFrame, facts, limit: int):
    """Slots of the gaps matched with waiting pieces: (piece, sequence) pairs, and the pieces left."""
    spark = waiting.sparkSession
    usable = f"gap >= {facts.low}"
    offered = gaps.filter(usable)
    wanted = max(facts.pieces // max(facts.usable, 1), 1)
    count = f"greatest(1, least({SLOTS}, {wanted}, gap DIV {facts.high}))"
    slots = offered.selectExpr("bin", "gap", f"{count} AS k").selectExpr(
        "1 AS kind", "bin AS id", "gap", "k", "explode(sequence(1, k)) AS i"
    ).selectExpr("kind", "id", "gap DIV k + CASE WHEN i = 1 THEN gap % k ELSE 0 END AS size")
    events = waiting.selectExpr("0 AS kind", "id", "size").unionAll(slots)
    parts = max(spark.sparkContext.defaultParallelism, (facts.pieces * 2 + facts.usable) // RANGE_ROWS + 1)
    ordered = events.repartitionByRange(parts, "size", "kind", "id").sortWithinPartitions("size", "kind", "id")
    swept = written(ordered.mapInArrow(_sweep, _SWEPT), "swept")
    over = swept.filter("kind < 2")
    counts = over.groupBy("part").agg(F.count_if(F.col("kind") == 1).alias("slots"), F.count_if(F.col("kind") == 0).alias("pieces")).collect()
    ranks = _ranked(stretches(sorted(map(tuple, counts))))
    ranked = written(over.mapInArrow(ranks, _SWEPT + ", rank long"), "ranked")
    met = ranked.filter("rank >= 0")
    across = met.filter("kind = 0").selectExpr("rank", "id AS piece", "size").join(
        met.filter("kind = 1").selectExpr("rank", "id AS bin"), "rank"
    )
    pairs = swept.filter("kind = 2").selectExpr("mate AS piece", "size", "id AS bin").unionAll(across.select("piece", "size", "bin"))
    return pairs, ranked.filter("kind = 0 AND rank < 0").select("id", "size")


def packed(cut: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The rows of ``cut`` (with a ``length`` from 1 to ``limit``) with ``sequence_id`` and ``offset``.

    Sequences hold at most ``limit`` tokens without holes. No rows give no rows.
    """
    spark = cut.sparkSession
    rows = written(cut.withColumn("_id", F.monotonically_increasing_id()), "pieces")
    waiting = rows.filter(F.col("length") < limit).select(F.col("_id").alias("id"), F.col("length").alias("size"))
    gaps = spark.createDataFrame([], "bin long, gap long")
    placed, opened, top = [], 0, 0
    while True:
        half = limit // 2
        facts = waiting.agg(
            F.count("*").alias("pieces"),
            F.min("size").alias("low"),
            F.max("size").alias("high"),
            F.count_if(F.col("size") > max(top, half)).alias("large"),
            F.count_if(F.col("size") > top).alias("many"),
            F.coalesce(F.sum(F.when(F.col("size") > top, F.col("size"))), F.lit(0)).alias("tokens"),
            F.min(F.when(F.col("size") > top, F.col("size"))).alias("least"),
        ).first()
        if not facts.pieces:
            break
        new = 0
        if facts.many:
            new = facts.large or max(-(-facts.tokens // limit), -(-facts.many // (limit // facts.least)))
            fresh = spark.range(opened, opened + new).selectExpr("id AS bin", f"{limit}L AS gap")
            gaps = gaps.unionAll(fresh)
            opened += new
        usable = gaps.filter(F.col("gap") >= facts.low).count()
        pairs, waiting = _round(waiting, gaps, _Facts(facts, usable), limit)
        pairs = written(pairs.withColumn("round", F.lit(len(placed))), "pairs")
        placed.append(pairs)
        used = pairs.groupBy("bin").agg(F.sum("size").alias("used"))
        gaps = written(gaps.join(used, "bin", "left").selectExpr("bin", "gap - coalesce(used, 0) AS gap").filter("gap > 0"), "gaps")
        top = gaps.agg(F.coalesce(F.max("gap"), F.lit(0)).alias("top")).first().top
    columns = cut.columns
    full = rows.filter(F.col("length") >= limit).select(*columns, (-1 - F.col("_id")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if not placed:
        return full
    every = placed[0]
    for pairs in placed[1:]:
        every = every.unionAll(pairs)
    # At most ``limit`` pieces share a sequence.
    before = Window.partitionBy("bin").orderBy("round", "piece").rowsBetween(Window.unboundedPreceding, -1)
    spots = every.select(F.col("piece").alias("_id"), F.col("bin").alias("sequence_id"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    return full.unionAll(rows.join(spots, "_id").select(*columns, "sequence_id", "offset"))


class _Facts:
    def __init__(self, facts, usable: int):
        self.pieces, self.low, self.high, self.usable = facts.pieces, facts.low, facts.high, usable


def pack(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """All documents packed: per piece its place in its document and in its sequence, and a sum over its ids.

    Null texts are empty (one end id); an empty table gives no rows; repeated rows are packed once each;
    further columns, whatever their names, are not looked at.
    """
    return packed(pieces(docs, vocabulary, limit), limit)
