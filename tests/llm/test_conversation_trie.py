"""The trie against plain Python and against its SQL."""

import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from llm_helpers import sha, tuples

from wildtally.llm import conversation_trie, registry
from wildtally.llm.spilling_queue import SpillingQueue

SCHEMA = "conv_id long, turn long, role string, text string, depth string, n string, idx string, key string, up string, h string, base string, shard string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
FOLDER = "/root/testdata/sf0.001"


def brute(rows):
    import hashlib

    said = defaultdict(list)
    for conv, turn, role, text in (r[:4] for r in rows):
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            said[conv].append((turn is not None, turn or 0, tie, role, text))
    original = {c: [t[3:] for t in sorted(turns)] for c, turns in said.items()}
    nodes, parent = defaultdict(list), {}
    ends = defaultdict(list)
    for c in sorted(original):
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        whole = tuple(original.get(base, [])[:h] + original[c][h:])
        for d in range(len(whole) + 1):
            nodes[whole[:d]].append(c)
        ends[whole].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in nodes:
        if node:
            children[node[:-1]] += 1
    for node, members in nodes.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(members) - 1) * len(node[-1][1]) if node else 0
    found = []
    for node, members in nodes.items():
        parent = min(nodes[node[:-1]]) if node else None
        found.append((min(members), len(node), parent, len(members), children[node], leaves[node], saved[node], sha(",".join(map(str, ends[node])))))
    return sorted(map(repr, found))


def rows_of():
    r = random.Random(4)
    rows = []
    for c in range(-130, 450, 3):
        for t in range(r.randrange(0, 9)):
            common = r.random() < 0.6
            rows.append((c, t if r.random() < 0.95 else None, r.choice(["user", "assistant", None]), f"same {t}" if common else r.choice(["", None, "é😀", f"own {c}"])))
    rows += [(c, t, "user", "greeting" if t == 0 else f"step {t}") for c in range(1000, 1080) for t in range(1 + c % 6)]
    rows += [(700, t, "user", f"long {t}") for t in range(300)] + [(7000, t, "user", "hot") for t in range(250)] + [(7101, t, "user", "hot") for t in range(260)]
    rows += [(1003, 1, "user", "step 1"), (1003, 1, "user", "step 1"), (None, 0, "user", "nobody"), (2**61, 0, "x", "y")]
    r.shuffle(rows)
    return [(*row, *["clash"] * 8) for row in rows]


@pytest.mark.parametrize("size", [7, 100, conversation_trie.SHARD_NODES])
def test_like_plain_python(spark, size):
    rows = rows_of()
    found = conversation_trie.trie(spark.createDataFrame(rows, SCHEMA), size)
    assert sorted(map(repr, tuples(found, *NAMES))) == brute(rows)


def test_few_rows(spark):
    assert conversation_trie.trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert conversation_trie.trie(spark.createDataFrame([(None, *["1"] * 11)], "conv_id long, " + SCHEMA.split(", ", 1)[1].replace("turn long", "turn string"))).collect() == []
    for row in ((5, 0, None, None), (101, None, "a", "b")):
        rows = [(*row, *["clash"] * 8)]
        assert sorted(map(repr, tuples(conversation_trie.trie(spark.createDataFrame(rows, SCHEMA)), *NAMES))) == brute(rows)


def test_totals_through_spilled_queues(spark):
    """A tree of long ways across many shards, with queues that hold two keys."""
    r = random.Random(9)
    up, children = {(0, 0): None}, defaultdict(list)
    for i in range(1, 400):
        parent = r.choice([*list(up)[-3:], *r.sample(list(up), min(3, len(up)))])
        node = (i if r.random() < 0.5 else parent[0], parent[1] + 1)
        if node not in up:
            up[node] = parent
    value = {v: (r.randrange(9), r.randrange(9)) for v in up}
    expected = {v: list(value[v]) for v in up}
    for v in up:
        w = up[v]
        while w:
            expected[w] = [a + b for a, b in zip(expected[w], value[v])]
            w = up[w]
    rows = [(*v, *(up[v] or (None, None)), *value[v]) for v in up]
    nodes = spark.createDataFrame(rows, "conv_id long, depth long, up_conv long, up_depth long, leaves long, saved long")
    for size in (20, 1000):
        found = conversation_trie.subtree_totals(nodes, size, 2).collect()
        assert {(x.conv_id, x.depth): [x.leaves, x.saved] for x in found} == expected


def test_queue():
    r = random.Random(1)
    queue, sums = SpillingQueue(5), defaultdict(int)
    for _ in range(500):
        key, n = r.randrange(60), r.randrange(10)
        queue.push(key, n)
        sums[key] += n
    assert queue.pop(-1) is None
    found = {}
    while (key := queue.first()) is not None:
        found[key] = queue.pop(key)
    assert list(found) == sorted(sums) and found == sums


def test_ends_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "END_CHUNK", 3)
    rows = rows_of()
    assert sorted(map(repr, tuples(conversation_trie.trie(spark.createDataFrame(rows, SCHEMA)), *NAMES))) == brute(rows)


def test_query_and_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{FOLDER}/conversations.parquet'")
    out = db.execute(registry.oracle_sql()["op12_conversation_trie"])
    assert [c[0] for c in out.description] == NAMES
    expected = sorted(map(repr, out.fetchall()))
    rows = registry.queries()["op12_conversation_trie"](spark, FOLDER)
    assert rows.columns == NAMES and sorted(map(repr, tuples(rows, *NAMES))) == expected
    given = spark.createDataFrame(rows_of(), SCHEMA).toArrow()  # noqa: F841
    db.execute("DROP VIEW conversations; CREATE TABLE conversations AS SELECT * FROM given")
    assert sorted(map(repr, db.execute(conversation_trie.TRIE_SQL).fetchall())) == brute(rows_of())
