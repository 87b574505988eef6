"""A hashed maximum-entropy language model with class-factored softmax, next to a unigram base.

The words before a token make its features: the last one, the last two, and the last but one (a skip).
They are hashed into FEATURES rows of weights, one weight for each class of words; a softmax over the
classes gives the class of the token, and within its class a token has its smoothed frequency. Classes
are ranges of the training count: each of the most frequent counts alone, below them powers of two, and
the unseen. Without any weight the model equals the base.

Tokens are gathered in chunks of documents with a vocabulary each. The chunks' counts are dealt to
buckets by the words' hashes, summed there, and sent back to each chunk for its own words: no table of
all words is ever held in one place. Training reads all training tokens in every round: each task sums
its gradient, blocks of the sums are added up in a tree (at most FAN of them in a group), and the new
weights, of fixed size, are broadcast.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wildtally.llm.tables import settings, written
from wildtally.llm.tokens import Words, mixed, slices

FEATURES, CLASSES = 1 << 14, 32
BANDS = 14  # classes by powers of two; the others are for the most frequent counts
ROUNDS, STEP, SHRINK, LARGEST = 2, 0.5, 10.0, 2.0
CHUNK_TOKENS, BUCKET_WORDS, BATCH_TOKENS = 1_500_000, 400_000, 16_384
BLOCKS, FAN = 16, 64
END = np.uint64(0x5851F42D4C957F2D)
_CODEC = "zstd"


def _packed(values: np.ndarray) -> bytes:
    return values.size.to_bytes(8, "little") + pa.compress(np.ascontiguousarray(values).tobytes(), codec=_CODEC, asbytes=True)


def _unpacked(blob: bytes, kind) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    return np.frombuffer(pa.decompress(blob[8:], n * np.dtype(kind).itemsize, codec=_CODEC, asbytes=True), dtype=kind)


# docs: for each document id, whether held out, number of tokens; words: sorted hashes; counts: of the
# training tokens; tokens: places in words; codes: what of a word enters the features
_CHUNK = pa.schema([("chunk", pa.int64()), ("docs", pa.binary()), ("words", pa.binary()), ("counts", pa.binary()), ("tokens", pa.binary()), ("codes", pa.binary()), ("n_words", pa.int64())])
_CHUNK_DDL = "chunk long, docs binary, words binary, counts binary, tokens binary, codes binary, n_words long"


def _chunks(batches):
    def flush():
        ids, flags, lengths, hashes = (np.concatenate([h[k] for h in held]) for k in range(4))
        words, tokens = np.unique(hashes, return_inverse=True)
        counts = np.bincount(tokens[np.repeat(flags == 0, lengths)], minlength=len(words))
        docs = np.column_stack([ids, flags, lengths]).astype(np.int64)
        codes = (words >> np.uint64(48)).astype(np.uint16)
        row = [number, _packed(docs), _packed(words), _packed(counts.astype(np.uint32)), _packed(tokens.astype(np.uint32)), _packed(codes), len(words)]
        return pa.RecordBatch.from_pylist([dict(zip(_CHUNK.names, row))], schema=_CHUNK)

    held, size, number = [], 0, TaskContext.get().partitionId() << 24
    for batch in slices(batches):
        words = Words(batch.column(2), folded=True)
        ends = words.bounds[1:] + np.arange(batch.num_rows)
        hashes = np.insert(words.hashes, words.bounds[1:], END)
        flags = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        held.append((batch.column(0).to_numpy(zero_copy_only=False), flags, words.counts() + 1, hashes))
        size += int(ends[-1]) + 1
        if size >= CHUNK_TOKENS:
            yield flush()
            held, size, number = [], 0, number + 1
    if held:
        yield flush()


_ASK = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())])


def _bucket(words: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(words) % np.uint64(buckets)).astype(np.int64)


def _asked(buckets: int):
    def ask(batches):
        for batch in batches:
            for chunk, words, counts in zip(*(batch.column(k) for k in range(3))):
                words, counts = _unpacked(words.as_py(), np.uint64), _unpacked(counts.as_py(), np.uint32)
                bucket = _bucket(words, buckets)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                rows = [(k, chunk.as_py(), words[order[a:b]].tobytes(), _packed(counts[order[a:b]])) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if a < b]
                yield pa.RecordBatch.from_pylist([dict(zip(_ASK.names, r)) for r in rows], schema=_ASK)

    return ask


_ANSWER = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("counts", pa.binary()), ("values", pa.list_(pa.int64())), ("words", pa.list_(pa.int64()))])


def _answered(table: pa.Table) -> pa.Table:
    """To each chunk the training counts of its words of this bucket, and once how many words have which count."""
    words = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table.column("words")]
    counts = [_unpacked(x.as_py(), np.uint32) for x in table.column("counts")]
    known, place = np.unique(np.concatenate(words), return_inverse=True)
    total = np.bincount(place, weights=np.concatenate(counts).astype(np.float64), minlength=len(known)).astype(np.int64)
    values, many = np.unique(total[total > 0], return_counts=True)
    bucket, at, rows = table.column("bucket")[0].as_py(), 0, []
    for chunk, own in zip(table.column("chunk"), words):
        rows.append({"chunk": chunk.as_py(), "bucket": bucket, "counts": _packed(total[place[at : at + len(own)]])})
        at += len(own)
    rows.append({"chunk": None, "bucket": bucket, "values": values, "words": many})
    return pa.Table.from_pylist(rows, schema=_ANSWER)


class Model:
    """Ranges of counts, their masses, the base's denominator and the weights."""

    def __init__(self, starts, masses, tokens: int, types: int):
        # Class i holds the counts from starts[i] up to the next start; class 0 the unseen.
        self.starts, self.masses = np.asarray(starts, dtype=np.int64), np.asarray(masses, dtype=np.float64)
        self.tokens, self.types = tokens, types
        self.whole = tokens + types + 1
        self.bias = np.log(np.maximum(self.masses, 1e-9) / self.whole).astype(np.float32)
        self.weights = np.zeros((FEATURES, len(self.starts)), dtype=np.float32)

    def classes(self, counts: np.ndarray) -> np.ndarray:
        return (np.searchsorted(self.starts, counts, side="right") - 1).astype(np.uint8)


# classes, codes: of each token; docs: id, held out, tokens; and for each document what needs no weights
_READY = pa.schema([("docs", pa.binary()), ("sums", pa.binary()), ("classes", pa.binary()), ("codes", pa.binary())])


def _ready(model: Model, buckets: int):
    def make(batches):
        for batch in batches:
            for docs, words, tokens, codes, answers in zip(*(batch.column(k) for k in range(5))):
                docs, tokens, codes = _unpacked(docs.as_py(), np.int64).reshape(-1, 3), _unpacked(tokens.as_py(), np.uint32), _unpacked(codes.as_py(), np.uint16)
                bucket = _bucket(_unpacked(words.as_py(), np.uint64), buckets)
                counts = np.empty(len(codes), dtype=np.int64)
                told = sorted((a["bucket"], a["counts"]) for a in answers.as_py())
                counts[np.argsort(bucket, kind="stable")] = np.concatenate([_unpacked(c, np.int64) for _, c in told])
                kinds = model.classes(counts)
                base = np.log10((counts + 1.0) / model.whole)
                within = np.log10((counts + 1.0) / model.masses[kinds])
                first = np.concatenate([[0], np.cumsum(docs[:, 2])[:-1]]).astype(np.int64)
                sums = np.column_stack([np.add.reduceat(x[tokens].astype(np.float64), first) for x in (counts > 0, base, within)])
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (_packed(docs.reshape(-1)), _packed(sums.reshape(-1)), _packed(kinds[tokens]), _packed(codes[tokens]))], schema=_READY)

    return make


def _rows(batches):
    for batch in batches:
        for docs, sums, kinds, codes in zip(*batch.columns):
            docs = _unpacked(docs.as_py(), np.int64).reshape(-1, 3)
            yield docs, _unpacked(sums.as_py(), np.float64).reshape(-1, 3), _unpacked(kinds.as_py(), np.uint8), _unpacked(codes.as_py(), np.uint16)


def _features(docs: np.ndarray, codes: np.ndarray) -> list[np.ndarray]:
    """The rows of weights of each token: last word, last two words, last but one."""
    n = len(codes)
    starts = np.concatenate([[0], np.cumsum(docs[:, 2])[:-1]]).astype(np.int64)
    one, two = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
    one[1:], two[2:] = codes[:-1] + np.uint64(1), codes[:-2] + np.uint64(1)
    one[starts] = 0
    two[starts] = 0
    seconds = starts[docs[:, 2] > 1] + 1
    two[seconds] = 0
    keys = (one << np.uint64(2), (two << np.uint64(20) | one) << np.uint64(2) | np.uint64(1), two << np.uint64(2) | np.uint64(2))
    return [(mixed(k) % np.uint64(FEATURES)).astype(np.int32) for k in keys]


def _likely(bias, weights, features, some) -> np.ndarray:
    """Class probabilities of some tokens."""
    z = weights[features[0][some]]
    z += weights[features[1][some]]
    z += weights[features[2][some]]
    z += bias
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


_SUM = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("slope", pa.binary()), ("bend", pa.binary())])
_SUM_DDL = "part long, block long, slope binary, bend binary"


def _slopes(bias: np.ndarray, shared):
    """The sums over a task's training tokens of what was seen less what was expected, and of the curvature."""

    def run(batches):
        kinds_many = len(bias)
        slope = np.zeros(FEATURES * kinds_many, dtype=np.float64)
        bend = np.zeros(FEATURES * kinds_many, dtype=np.float64)
        weights = None if shared is None else shared.value
        prior = np.exp(bias)
        any_row = False
        for docs, _, kinds, codes in _rows(batches):
            any_row = True
            features = _features(docs, codes)
            train = np.flatnonzero(np.repeat(docs[:, 1] == 0, docs[:, 2]))
            for f in features:
                slope += np.bincount(f[train].astype(np.int64) * kinds_many + kinds[train], minlength=len(slope))
            if weights is None:  # every token expects the prior
                for f in features:
                    seen = np.bincount(f[train], minlength=FEATURES).astype(np.float64)
                    slope -= np.outer(seen, prior).reshape(-1)
                    bend += np.outer(seen, prior * (1 - prior)).reshape(-1)
                continue
            expected, curved = slope.reshape(FEATURES, -1), bend.reshape(FEATURES, -1)
            for at in range(0, len(train), BATCH_TOKENS):
                some = train[at : at + BATCH_TOKENS]
                p = _likely(bias, weights, features, some)
                for f in features:
                    order = np.argsort(f[some], kind="stable")
                    sorted_f = f[some][order]
                    first = np.flatnonzero(np.concatenate([[True], sorted_f[1:] != sorted_f[:-1]]))
                    added = np.add.reduceat(p[order], first, axis=0)
                    expected[sorted_f[first]] -= added
                    curved[sorted_f[first]] += added * (1 - np.minimum(1, added / np.diff(np.append(first, len(order)))[:, None]))
        if any_row:
            parts = [np.array_split(x.astype(np.float32), BLOCKS) for x in (slope, bend)]
            task = pa.array([TaskContext.get().partitionId()] * BLOCKS, pa.int64())
            yield pa.RecordBatch.from_arrays([task, pa.array(range(BLOCKS), pa.int64()), *(pa.array([p.tobytes() for p in x], pa.binary()) for x in parts)], schema=_SUM)

    return run


def _added(table: pa.Table) -> pa.Table:
    sums = [sum(np.frombuffer(x.as_buffer(), dtype=np.float32).astype(np.float64) for x in table.column(c)) for c in ("slope", "bend")]
    keys = [table.column(c).combine_chunks()[:1] for c in ("part", "block")]
    return pa.Table.from_arrays([*keys, *(pa.array([x.astype(np.float32).tobytes()], pa.binary()) for x in sums)], schema=_SUM)


def summed(sums: DataFrame, tasks: int) -> DataFrame:
    """``sums`` (part, block, slope, bend) of parts 0 to ``tasks`` - 1 as one row for each block.

    Each level adds up the rows of at most FAN parts, so no group holds a row for every task.
    """
    while tasks > 1:
        sums = sums.withColumn("part", F.expr(f"part DIV {FAN}")).groupBy("part", "block").applyInArrow(_added, _SUM_DDL)
        tasks = -(-tasks // FAN)
    return sums


_SCORES = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
)


def _scored(bias: np.ndarray, shared, tokens: int):
    def run(batches):
        weights = shared.value
        for docs, sums, kinds, codes in _rows(batches):
            features = _features(docs, codes)
            logs = np.empty(len(kinds), dtype=np.float64)
            for at in range(0, len(kinds), BATCH_TOKENS):
                some = slice(at, at + BATCH_TOKENS)
                p = _likely(bias, weights, features, some)
                logs[some] = np.log10(np.maximum(p[np.arange(len(p)), kinds[some]], 1e-30))
            first = np.concatenate([[0], np.cumsum(docs[:, 2])[:-1]]).astype(np.int64)
            score = np.add.reduceat(logs, first) + sums[:, 2]
            ids = pa.array(docs[:, 0], mask=docs[:, 0] == NO_ID)
            columns = [ids, docs[:, 1] == 1, docs[:, 2], sums[:, 0].astype(np.int64), np.full(len(docs), tokens), sums[:, 1], score]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_SCORES)

    return run


NO_ID = -(2**63)


def train_and_score(docs: DataFrame, held_out: int = 2, modulus: int = 7) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs`` (doc_id, text).

    Rows whose crc32(doc_id as text) modulo ``modulus`` is ``held_out`` are scored only, all others are
    trained on as well; a row without a doc_id is trained on. Every text ends in an end token, so a null
    or empty text has one token. Repeated rows count repeatedly. Without training rows all tokens are
    unknown and the scores are those of a single unknown type. An empty table gives no rows; other
    columns are not looked at.

    Runs jobs while it is called: chunks, counts and gradients go through the shared folder.
    """
    spark = settings(docs.sparkSession)
    out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == held_out, F.lit(False))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), out.alias("held_out"), "text")
    chunks = written(rows.mapInArrow(_chunks, _CHUNK_DDL), "chunks")
    size = chunks.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).first().n
    buckets = max(1, -(-size // BUCKET_WORDS))
    asked = chunks.select("chunk", "words", "counts").mapInArrow(_asked(buckets), "bucket long, chunk long, words binary, counts binary")
    answers = written(asked.groupBy("bucket").applyInArrow(_answered, "chunk long, bucket long, counts binary, values array<long>, words array<long>"), "counts")
    model = _classes(answers)
    told = answers.filter("chunk IS NOT NULL").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "counts")).alias("answers"))
    joined = chunks.select("chunk", "docs", "words", "tokens", "codes").join(told, "chunk").select("docs", "words", "tokens", "codes", "answers")
    ready = written(joined.mapInArrow(_ready(model, buckets), "docs binary, sums binary, classes binary, codes binary"), "ready")
    shared = None
    for _ in range(ROUNDS):
        sums = ready.mapInArrow(_slopes(model.bias, shared), _SUM_DDL)
        blocks = sorted(summed(sums, sums.rdd.getNumPartitions()).collect(), key=lambda r: r.block)  # BLOCKS rows of fixed size
        if blocks:
            slope, bend = (np.concatenate([np.frombuffer(r[k], dtype=np.float32) for r in blocks]) for k in (2, 3))
            step = (STEP * slope / (bend + SHRINK)).reshape(model.weights.shape)
            model.weights = np.clip(model.weights + step, -LARGEST, LARGEST).astype(np.float32)
        shared = spark.sparkContext.broadcast(model.weights)
    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return ready.mapInArrow(_scored(model.bias, shared, model.tokens), ddl)


def _classes(answers: DataFrame) -> Model:
    """Classes from how many words have which count; the driver sees one row for each class."""
    histogram = answers.filter("chunk IS NULL").select(F.explode(F.arrays_zip("values", "words")).alias("x")).groupBy(F.col("x.values").alias("value")).agg(F.sum("x.words").alias("words"))
    histogram = written(histogram, "histogram")
    total = histogram.agg(F.coalesce(F.sum(F.expr("value * words")), F.lit(0)).alias("tokens"), F.coalesce(F.sum("words"), F.lit(0)).alias("types")).first()
    top = sorted(r.value for r in histogram.orderBy(F.desc("value")).limit(CLASSES - BANDS).collect())
    low = [2**i for i in range(BANDS - 1) if not top or 2**i < top[0]]
    starts = [0, *low, *top]
    kind = F.lit(0)
    for i, start in enumerate(starts):
        kind = F.when(F.col("value") >= start, i).otherwise(kind)
    masses = {r.kind: r.mass for r in histogram.groupBy(kind.alias("kind")).agg(F.sum(F.expr("(value + 1) * words")).alias("mass")).collect()}
    return Model(starts, [1.0] + [float(masses.get(i, 0)) for i in range(1, len(starts))], total.tokens, total.types)
