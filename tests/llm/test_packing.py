"""Packing against the library's ids, a plain best-fit-decreasing count and the rules of a packing."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import frame, odd_rows, tuples
from tokenizers import Tokenizer

from wildtally.llm import packing, registry, word_ids

ODD = ["", " ", "don't I'VE it'll 'S'", "a<|endoftext|>b <|startoftext|> <|end", "x1.5,234--;;é.É ΣΑΣ ΣΑΣ. İstanbul ǅ", "é é́ ́a a ́",
       "ÉCOLE. île×3 a÷b İ. Éa.é, ǅ.x ŉ.a ſ.b ß.1 éı.2 ÅA-ɏb- ẞ.", "\x1c\x1d a\x00b\x7f c\x85d e f　g", "日本語テキスト。x 12３４ ½ ²", "A" * 3000, "1" * 300,
       "≠ ≮ ≯ x", "가각 각", "..a..'s 's't", "tab\tnew\nline\x0b\x0c\r", "-" * 500 + "a", None, "`^~|{}[]\\\"#$%&*+", "word " * 300]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_str(registry.word_vocabulary())


@pytest.mark.parametrize("step", [40, 1 << 20])
def test_ids_like_the_library(library, monkeypatch, step):
    monkeypatch.setattr(word_ids, "STEP_BYTES", step)
    monkeypatch.setattr(word_ids, "REMEMBERED", 50)
    encode = word_ids.WordIds(registry.word_vocabulary())
    texts = ODD + [t for _, t in odd_rows()]
    for _ in range(2):
        for text, ids in zip(texts, encode(pa.array(texts))):
            assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def best_fit_decreasing(lengths, limit):
    gaps, opened = np.zeros(limit + 1, dtype=int), 0
    for size in sorted(lengths, reverse=True):
        fits = np.flatnonzero(gaps[size:])
        gap = size + fits[0] if len(fits) else limit
        opened += not len(fits)
        gaps[gap] -= bool(len(fits))
        gaps[gap - size] += 1
    return opened


def check(rows, lengths, limit):
    """Every piece once, sequences without holes or overlaps, about as few as best fit decreasing."""
    assert sorted(r.length for r in rows) == sorted(lengths)
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= limit
    assert len(held) <= best_fit_decreasing(lengths, limit) * 1.01 + 1


@pytest.mark.parametrize("ranges", [1 << 17, 40])
def test_documents(spark, library, monkeypatch, ranges):
    monkeypatch.setattr(packing, "RANGE_ROWS", ranges)
    texts = list(enumerate(ODD)) + [(i + 100, t) for i, t in odd_rows()] + [(None, "no id"), (5, "again"), (5, "again")]
    rows = packing.pack(frame(spark, texts), registry.word_vocabulary()).collect()
    expected = []
    for doc, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        for i in range(0, len(ids), 2048):
            part = ids[i : i + 2048]
            expected.append((doc, i // 2048, i, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    assert sorted(map(repr, expected)) == sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    check(rows, [e[3] for e in expected], 2048)
    assert packing.pack(frame(spark, []), registry.word_vocabulary()).collect() == []


CASES = {
    "uniform": lambda r: r.integers(1, 101, 3000),
    "full": lambda r: np.full(300, 100),
    "mixed": lambda r: np.concatenate([np.full(1000, 2), r.integers(45, 56, 500)]),
    "short": lambda r: r.integers(1, 30, 900),
}


@pytest.mark.parametrize("name", CASES)
def test_few_sequences(spark, monkeypatch, name):
    monkeypatch.setattr(packing, "RANGE_ROWS", 300)
    lengths = [int(x) for x in CASES[name](np.random.default_rng(3))]
    cut = spark.createDataFrame([(i % 7, n) for i, n in enumerate(lengths)], "doc_id long, length long")
    check(packing.packed(cut, 100).collect(), lengths, 100)


def test_stretches():
    # Ranges 0 and 1 leave 3 and 2 pieces; slots of range 2 take the last ones first, range 3 the rest.
    assert packing.stretches([(0, 1, 3), (1, 0, 2), (2, 3, 0), (3, 9, 1)]) == [(1, 1, 2, 0, 2), (0, 2, 2, 2, 1), (0, 1, 3, 0, 2)]


def test_query(spark):
    rows = registry.queries()["op13_best_fit_packing"](spark, "/root/testdata/sf0.001")
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(rows.columns)
    rows = rows.collect()
    check(rows, [r.length for r in rows], 2048)
    assert len(set(tuples(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "doc_id"))) == len({r.doc_id for r in rows})
