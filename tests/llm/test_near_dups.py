"""Near duplicates against brute force over all pairs."""

import pytest
from llm_helpers import frame, odd_rows, tuples, words

from wildtally.llm import near_dups
from wildtally.llm.components import connected


def brute(rows):
    sets = {}
    for doc, text in rows:
        w = words(text, fold=True)
        sets[doc] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d), root(d) == d) for d in ids}


def told(found):
    return {d: tuple(rest) for d, *rest in tuples(found, "doc_id", "n_shingles", "component_id", "kept")}


# With a small sketch, and no outsiders allowed, all goes through the full sets.
@pytest.mark.parametrize("limits", [{}, {"OUTSIDERS": 0, "K": 32, "SHARED": 8}])
def test_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(near_dups, name, value)
    rows = odd_rows()
    assert told(near_dups.components(frame(spark, rows))) == brute(rows)


def lost(spark, sizes):
    """Of pairs of documents, one the beginning of the other, with set ``sizes``: those alike by 0.75 and not linked."""
    rows, expected = [], []
    for i, (a, b) in enumerate(sizes):
        text = [f"p{i}w{j}" for j in range(b + near_dups.SHINGLE - 1)]
        rows += [(2 * i, " ".join(text[: a + near_dups.SHINGLE - 1])), (2 * i + 1, " ".join(text))]
        expected.append(100 * a >= 75 * b)
    component = dict(tuples(near_dups.components(frame(spark, rows)), "doc_id", "component_id"))
    linked = [component[2 * i] == component[2 * i + 1] for i in range(len(sizes))]
    assert not any(y and not x for x, y in zip(expected, linked))
    return [s for s, x, y in zip(sizes, expected, linked) if x and not y]


def test_smaller_than_the_sketch(spark):
    sizes = [(a, b) for a in range(110, 128) for b in range(128, 176) if 0.74 * b <= a <= 0.8 * b]
    assert lost(spark, sizes * 3) == []


def test_sketches_past_half_of_the_values(spark):
    sizes = [(a, b) for a in range(128, 200, 3) for b in range(170, 261) if 0.75 * b <= a <= 0.76 * b]
    assert lost(spark, sizes * 10) == []


def test_odd_ids(spark):
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (7, "x y z"), (9, "X y z"), (None, "a b c d e f"), (None, None)]
    found = tuples(near_dups.components(frame(spark, rows)), "doc_id", "n_shingles", "component_id", "kept")
    assert sorted(found, key=repr) == sorted([(7, 2, 7, True)] * 2 + [(7, 1, 7, True), (9, 1, 7, False), (None, 2, None, True), (None, 0, None, True)], key=repr)
    kept = near_dups.without_near_dups(frame(spark, rows))
    assert kept.count() == 5 and kept.columns == frame(spark, rows).columns


def test_empty(spark):
    assert near_dups.components(frame(spark, [])).collect() == []


def test_connected(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100, 7), (200, 201), (200, 201), (300, 300)]
    found = dict(tuples(connected(spark.createDataFrame(chain, "a long, b long")), "node", "component"))
    assert found == {**{i: 0 for i in range(31)}, 100: 0, 200: 200, 201: 200}
