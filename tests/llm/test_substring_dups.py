"""Repeated passages against a plain scan in order."""

from types import SimpleNamespace

import numpy as np
import pytest
from llm_helpers import frame, odd_rows, sha, tuples, words

from wildtally.llm import substring_dups as S


def brute(rows):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        w = words(text)
        covered = [False] * len(w)
        for i in range(len(w) - S.WINDOW + 1):
            window = tuple(w[i : i + S.WINDOW])
            if window in seen:
                covered[i : i + S.WINDOW] = [True] * S.WINDOW
            seen.add(window)
        kept = [x for x, c in zip(w, covered) if not c]
        out[doc] = len(w), len(w) - len(kept), sha(" ".join(kept))
    return out


@pytest.mark.parametrize("limits", [{}, {"BUCKET_WINDOWS": 500, "BUFFER_WINDOWS": 50}])
def test_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(S, name, value)
    rows = odd_rows()
    rows += [(i + 200, t) for i, t in rows if i % 3 == 0]
    rows.reverse()
    out, cut = S.remove_repeats(frame(spark, rows))
    expected = brute(rows)
    assert {d: tuple(r) for d, *r in tuples(out, "doc_id", "n_words", "n_removed", "kept_sha256")} == expected
    for doc, n, kept, removed in tuples(cut, "doc_id", "n_removed", "kept", "removed"):
        assert (n, sha(kept)) == expected[doc][1:] and n == sum(r.to - r["from"] for r in removed)
        assert all(a.to < b["from"] for a, b in zip(removed, removed[1:]))


def test_repeats_within_buffers_are_spread(monkeypatch):
    hits = np.zeros(100, dtype=int)
    for task in range(200):
        monkeypatch.setattr(S.TaskContext, "get", lambda task=task: SimpleNamespace(partitionId=lambda: task))
        for turn in range(20):
            hits[S.anywhere(turn, 100)] += 1
    assert hits.sum() == 4_000 and hits.min() > 10 and hits.max() < 80


def test_odd_ids(spark):
    text = " ".join(f"t{i}" for i in range(25))
    rows = [(3, text), (3, text), (None, text), (3, "other " + text), (5, text + " more")]
    out = sorted(tuples(S.remove_repeats(frame(spark, rows))[0], "doc_id", "n_words", "n_removed"), key=repr)
    # A row given twice is no repeat of itself; a null id comes last; two texts of one id compare by their places.
    assert (3, 25, 0) in out and (None, 25, 25) in out and (5, 26, 25) in out
    assert S.remove_repeats(frame(spark, []))[0].collect() == []
