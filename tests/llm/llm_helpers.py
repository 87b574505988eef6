"""Plain Python counterparts of the text operators, and documents with every odd case."""

import hashlib
import re
import zlib

from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, fold=False):
    text = text or ""
    return WORD.findall(text.translate(FOLD) if fold else text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def odd_rows():
    """(doc_id, text): nulls, blanks, ties, copies, near copies, a passage that many share, a long text."""
    import random

    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    some = lambda n: [r.choice(vocabulary) for _ in range(n)]
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one two three"), (5, "One TWO  three"), (6, "a b c d e"), (7, "é" * 5 + "　x y")]
    base = some(120)
    for i in range(10, 30):  # near copies around a base that is not among them, and exact copies
        mine = list(base)
        for _ in range(i % 5):
            mine[r.randrange(len(mine))] = "changed"
        rows.append((i, " ".join(mine)))
    rows += [(i, " ".join(base).upper()) for i in range(30, 33)]
    passage = some(60)
    for i in range(40, 60):
        rows.append((i, " ".join(some(r.randrange(8, 40)) + passage + some(r.randrange(8, 40)))))
    rows += [(i, " ".join(passage[: 12 + i % 7])) for i in range(60, 75)]
    rows += [(80, " ".join(some(20_000))), (81, " ".join(some(19))), (82, " ".join(["again"] * 100)), (83, " ".join(some(25) * 4))]
    rows += [(84, " ".join(base[:60] + some(2) + base[62:])), (85, " ".join(base[:60]))]
    return rows


def frame(spark, rows):
    """As documents with further columns whose names the operators use inside."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("n", "id", "v", "hash", "raw", "place", "band", "chunk", "score", "license", "starts", "component", "key"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))


def tuples(rows, *names):
    return [tuple(r[n] for n in names) for r in rows.collect()]
