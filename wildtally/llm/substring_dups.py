"""Removal of repeated passages: windows of WINDOW words that also start earlier in the corpus.

Every window is hashed (Rabin-Karp over word hashes) and dealt to a bucket by a second hash, so two
windows are taken as equal if both agree. Hashes travel as packed blocks, one per buffer of documents
and bucket: within a buffer only the earliest of equal windows is sent, so a passage that is everywhere
arrives once per buffer; the others, late already, are dealt evenly over all buckets. The task of a bucket finds the earliest window of each hash; the others are
sent back, packed again, to the groups of their documents, where covered words merge into maximal
intervals.

Documents with the same word sequence are settled before: only the first of them sends windows.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wildtally.llm.tables import settings, written
from wildtally.llm.tokens import SECOND_BASE, WORD_BASE, Words, mixed, slices
from wildtally.operators.sizes import measured

WINDOW = 20
# Windows that one task of a bucket sorts at a time, and windows that a mapper holds before it sends.
BUCKET_WINDOWS, BUFFER_WINDOWS = 500_000, 600_000

_SEEN = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("text_key", pa.int64()), ("second_key", pa.int64()), ("kept_sha256", pa.string())])


def _texts(words: Words):
    """Each row's words."""
    data = words.data.tobytes()
    for a, b in zip(words.offsets[:-1], words.offsets[1:]):
        yield data[a:b].split()


def _seen(batches):
    for batch in slices(batches):
        words = Words(batch.column(1))
        digests = [hashlib.sha256(b" ".join(parts)).hexdigest() for parts in _texts(words)]
        keys = [pa.array(words.whole(base).view(np.int64)) for base in (WORD_BASE, SECOND_BASE)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words.counts()), *keys, pa.array(digests)], schema=_SEEN)


# bucket; and for each window: document (id as the difference to the one before, key), start, hash
_BLOCK = pa.schema([("bucket", pa.int64()), ("docs", pa.binary()), ("hashes", pa.binary())])
_REPEATS = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("starts", pa.binary())])


def _runs(owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal owners begins, and its length."""
    first = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]])) if len(owners) else np.zeros(0, dtype=np.int64)
    return first, np.diff(np.concatenate([first, [len(owners)]]))


def _packed(own: np.ndarray, starts: np.ndarray) -> bytes:
    """Documents (id, key) and starts of windows that are sorted by these."""
    parts = np.diff(own[:, 0], prepend=0).tobytes(), own[:, 1].tobytes(), starts.astype(np.int64).tobytes()
    return len(own).to_bytes(8, "little") + pa.compress(b"".join(parts), codec="zstd", asbytes=True)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    steps, keys, starts = np.frombuffer(pa.decompress(blob[8:], 24 * n, codec="zstd", asbytes=True), dtype=np.int64).reshape(3, n)
    return np.column_stack([np.cumsum(steps), keys]), starts


def anywhere(turn: int, buckets: int) -> int:
    """A bucket for windows that need no judging: another one for each task and buffer, the same if a task is run again."""
    task = TaskContext.get()
    place = np.array([(task.partitionId() if task else 0), turn], dtype=np.uint64)
    return int(mixed(mixed(place[:1]) + place[1:])[0] % np.uint64(buckets))


def _blocks(buckets: int):
    def flush(held, turn):
        ids = np.concatenate([x[0] for x in held])
        shift = np.cumsum([0] + [len(x[0]) for x in held[:-1]])
        owners = np.concatenate([x[1] + s for x, s in zip(held, shift)])
        starts, hashes, seconds = (np.concatenate([x[k] for x in held]) for k in (2, 3, 4))
        rank = np.empty(len(ids), dtype=np.int64)
        rank[np.lexsort((ids[:, 1], ids[:, 0]))] = np.arange(len(ids))
        if np.any(rank != np.arange(len(ids))):
            order = np.lexsort((starts, rank[owners]))
            owners, starts, hashes, seconds = owners[order], starts[order], hashes[order], seconds[order]
        bucket = (seconds % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(hashes, kind="stable")
        again = np.zeros(len(order), dtype=bool)
        again[order[1:]] = (hashes[order[1:]] == hashes[order[:-1]]) & (bucket[order[1:]] == bucket[order[:-1]])
        # A row given twice is no repeat of itself.
        same = np.zeros(len(order), dtype=bool)
        a, b = order[1:], order[:-1]
        same[a] = np.all(ids[owners[a]] == ids[owners[b]], axis=1) & (starts[a] == starts[b])
        again &= ~same
        rows = []
        if again.any():
            rows.append((anywhere(turn, buckets), _packed(ids[owners[again]], starts[again]), b""))
        fresh = np.flatnonzero(~again)
        fresh = fresh[np.argsort(bucket[fresh], kind="stable")]
        cuts = np.searchsorted(bucket[fresh], np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(cuts)):
            some = fresh[cuts[k] : cuts[k + 1]]
            rows.append((int(k), _packed(ids[owners[some]], starts[some]), hashes[some].tobytes()))
        return pa.RecordBatch.from_pylist([dict(zip(_BLOCK.names, r)) for r in rows], schema=_BLOCK)

    def blocks(batches):
        held, size, turn = [], 0, 0
        for batch in slices(batches):
            words = Words(batch.column(1))
            at, hashes = words.windows(WINDOW)
            _, seconds = words.windows(WINDOW, SECOND_BASE)
            owners = words.rows()[at]
            ids = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2)])
            held.append((ids, owners, at - words.bounds[:-1][owners], hashes, seconds))
            size += len(at)
            if size >= BUFFER_WINDOWS:
                yield flush(held, turn)
                held, size, turn = [], 0, turn + 1
        if size:
            yield flush(held, turn)

    return blocks


_LATE = pa.schema([("part", pa.int64()), ("docs", pa.binary())])


def _judged(parts: int):
    def judge(table: pa.Table) -> pa.Table:
        """The windows of one bucket that are not the earliest of their hash, by the part of their document."""
        fresh, out = [], []
        for docs, block in zip(table.column("docs"), table.column("hashes")):
            own, begin = _unpacked(docs.as_py())
            values = np.frombuffer(block.as_buffer(), dtype=np.uint64)
            (fresh if len(values) else out).append((own, begin, values))
        if fresh:
            own, begin, values = (np.concatenate([x[k] for x in fresh]) for k in range(3))
            order = np.lexsort((begin, own[:, 0], values))
            own, begin, values = own[order], begin[order], values[order]
            first, lengths = _runs(values)
            lead = np.repeat(first, lengths)
            late = (own[:, 0] != own[lead, 0]) | (begin != begin[lead])
            out.append((own[late], begin[late]))
        own, begin = (np.concatenate([x[k] for x in out]) for k in range(2))
        part = (mixed(own[:, 0].astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((begin, own[:, 1], own[:, 0], part))
        own, begin, part = own[order], begin[order], part[order]
        rows = []
        for a, n in zip(*_runs(part)):
            rows.append({"part": int(part[a]), "docs": _packed(own[a : a + n], begin[a : a + n])})
        return pa.Table.from_pylist(rows, schema=_LATE)

    return judge


def _merged(table: pa.Table) -> pa.Table:
    """The late windows of each document of one part."""
    own, begin = (np.concatenate(x) for x in zip(*(_unpacked(docs.as_py()) for docs in table.column("docs"))))
    order = np.lexsort((begin, own[:, 1], own[:, 0]))
    own, begin = own[order], begin[order]
    first, lengths = _runs_of_pairs(own)
    starts = [begin[a : a + n].astype(np.uint32).tobytes() for a, n in zip(first, lengths)]
    return pa.Table.from_arrays([pa.array(own[first, 0]), pa.array(own[first, 1]), pa.array(starts, pa.binary())], schema=_REPEATS)


def _runs_of_pairs(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(own):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    change = np.concatenate([[True], np.any(own[1:] != own[:-1], axis=1)])
    first = np.flatnonzero(change)
    return first, np.diff(np.concatenate([first, [len(own)]]))


def intervals(starts: np.ndarray, width: int = WINDOW) -> list[tuple[int, int]]:
    """Maximal runs of words [from, to) that windows at ``starts`` cover."""
    starts = np.unique(starts.astype(np.int64))
    if not len(starts):
        return []
    gap = np.flatnonzero(starts[1:] > starts[:-1] + width)
    lo = starts[np.concatenate([[0], gap + 1])]
    hi = starts[np.concatenate([gap, [len(starts) - 1]])] + width
    return list(zip(lo.tolist(), hi.tolist()))


_CUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("text_key", pa.int64()),
        ("n_removed", pa.int64()),
        ("kept_sha256", pa.string()),
        ("kept", pa.string()),
        ("removed", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))),
    ]
)


def _cut(batches):
    for batch in batches:
        out = []
        for doc, key, text, starts in zip(*(batch.column(i) for i in range(4))):
            words = (text.as_py() or "").encode().split()
            spans = intervals(np.frombuffer(starts.as_buffer(), dtype=np.uint32))
            keep, at = [], 0
            for a, b in spans:
                keep += words[at:a]
                at = b
            kept = b" ".join(keep + words[at:])
            removed = sum(b - a for a, b in spans)
            out.append((doc.as_py(), key.as_py(), removed, hashlib.sha256(kept).hexdigest(), kept.decode(), [{"from": a, "to": b} for a, b in spans]))
        yield pa.RecordBatch.from_pylist([dict(zip(_CUT.names, r)) for r in out], schema=_CUT)


_KEYED = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("text_key", pa.int64())])


def _keyed(batches):
    for batch in slices(batches):
        keys = Words(batch.column(1)).whole().view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys)], schema=_KEYED)


def remove_repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What every row of ``docs`` (doc_id, text) keeps, and the kept text of those that lose words.

    The first frame has ``doc_id, n_words, n_removed, kept_sha256`` for each row; the second ``doc_id,
    n_removed, kept, removed`` (word intervals) for the rows that lose a part.

    A null or blank text has no words. Texts shorter than a window lose none. Rows without a doc_id
    come after all others, together as one document. A row given twice under one doc_id is the same
    window twice and no repeat. An empty table gives no rows; other columns are not looked at.

    Runs jobs while it is called and writes to the shared folder.
    """
    settings(docs.sparkSession)
    last = F.lit(2**63 - 1)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), last).alias("doc_id"), "text")
    seen = written(texts.mapInArrow(_seen, "doc_id long, n_words long, text_key long, second_key long, kept_sha256 string"), "seen")
    firsts = seen.filter(F.col("n_words") >= WINDOW).groupBy("text_key", "second_key").agg(F.min("doc_id").alias("first"), F.count("*").alias("many")).filter("many > 1")
    copies = written(seen.join(firsts, ["text_key", "second_key"]).filter("doc_id != first").select("doc_id", "text_key").distinct(), "copies")
    total = seen.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).first().n
    buckets = max(1, -(-total // BUCKET_WINDOWS))
    several = written(seen.groupBy("doc_id").agg(F.min("text_key").alias("lo"), F.max("text_key").alias("hi")).filter("lo != hi").select("doc_id"), "several")
    if several.isEmpty():  # then the id alone tells a document, and its key travels as 0
        key = lambda rows: rows.withColumn("text_key", F.lit(0).cast("long"))
        texts = key(texts).select("doc_id", "text", "text_key")
        seen, copies = key(seen), key(copies)
    else:
        texts = texts.mapInArrow(_keyed, "doc_id long, text string, text_key long")
    sending = texts.join(measured(copies), ["doc_id", "text_key"], "left_anti").select("doc_id", "text", "text_key")
    blocks = sending.mapInArrow(_blocks(buckets), "bucket long, docs binary, hashes binary")
    late = blocks.groupBy("bucket").applyInArrow(_judged(buckets), "part long, docs binary")
    repeats = written(late.groupBy("part").applyInArrow(_merged, "doc_id long, text_key long, starts binary"), "repeats")
    touched = measured(written(repeats.select("doc_id").distinct(), "touched"))
    cut = texts.join(touched, "doc_id", "left_semi").join(repeats, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "starts").mapInArrow(
        _cut, "doc_id long, text_key long, n_removed long, kept_sha256 string, kept string, removed array<struct<from: long, to: long>>"
    )
    cut = written(cut, "cut")
    gone = copies.select("doc_id", "text_key", F.lit(True).alias("copy"))
    partly = cut.select("doc_id", "text_key", F.col("n_removed").alias("some"), F.col("kept_sha256").alias("rest")).distinct()
    out = seen.join(gone, ["doc_id", "text_key"], "left").join(partly, ["doc_id", "text_key"], "left")
    given = F.when(F.col("doc_id") != last, F.col("doc_id")).alias("doc_id")
    out = out.select(
        given,
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("some", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("rest", "kept_sha256")).alias("kept_sha256"),
    )
    return out, cut.select(given, "n_removed", "kept", "removed")

