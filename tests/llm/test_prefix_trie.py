"""The trie of rebuilt conversations against a plain Python version."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from pairwright.llm.prefix_trie import DoubleArray, prefix_trie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            own[conv_id].append((turn is not None, turn or 0, digest, role, text))
    for turns in own.values():
        turns.sort()
    members = defaultdict(set)
    ends = defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c > 0 else -1)
        path = tuple(t[3:] for t in [*own.get(base, [])[:h], *own[c][h:]])
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
        ends[path].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[c] for c in below) if below else 1
        saved[node] = sum(saved[c] for c in below) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    out = set()
    for node, mine in members.items():
        up = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
        out.add((min(mine), len(node), up, len(mine), len(children[node]), leaves[node], saved[node], digest))
    return out


def found(spark, rows, **options):
    frame = spark.createDataFrame([(*row, b"k", 1) for row in rows], "conv_id long, turn long, role string, text string, key binary, n long")
    out = [tuple(row) for row in prefix_trie(frame, **options).select(*COLUMNS).collect()]
    assert len(set(out)) == len(out)
    return set(out)


def conversations(seed, n=240):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-150, 1_500), n):
        same = rng.random() < 0.4
        for turn in range(rng.choice([1, 2, 3, 6, 9])):
            text = "hello" if same else rng.choice(["a", "bb", "ccc", "é" * 4, None, ""])
            rows.append((c, turn, "user" if turn % 2 else None, text))
    rows += [(700, turn, "user", f"deep {turn}") for turn in range(300)] + [(701, turn, "user", f"deep {turn}") for turn in range(300)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_turns", [10**6, 200, 20])
def test_equals_plain_python(spark, shard_turns):
    rows = conversations(shard_turns)
    assert found(spark, rows, shard_turns=shard_turns) == brute(rows)


def test_odd_rows(spark):
    long = "words of a long text " * 5_000
    rows = [(None, 1, "user", "x"), (1, None, "user", "first"), (1, 0, None, None), (1, 0, None, None), (1, 0, "a", "b"), (1, 0, "", "ab")]
    rows += [(100, 1, "user", long), (100, 2, "user", long), (101, 1, "user", long), (2, 5, "user", "x"), (3, None, None, None)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == set()
    assert found(spark, [(None, 1, "user", "x")]) == set()


def test_copies_over_many_shards(spark):
    rows = [(c, turn, "user", f"t{turn}") for c in range(1_500) for turn in range(3)]
    rows += [(c, 3, "user", f"own {c}") for c in range(0, 1_500, 2)]
    assert found(spark, rows, shard_turns=300) == brute(rows)


def test_double_array_is_walked_exactly():
    rng = random.Random(5)
    children, nodes = [[]], [[]]
    for n in range(1, 3_000):
        up = rng.choice([0, rng.randrange(n), n - 1])
        turn = rng.randrange(5_000)
        if turn in children[up]:
            up, turn = n - 1, 7
        children[up].append(turn)
        nodes[up].append(n)
        children.append([])
        nodes.append([])
    array = DoubleArray(children, nodes)
    assert len(set(array.slot)) == len(array.slot)
    for n, (ids, below) in enumerate(zip(children, nodes, strict=True)):
        held = dict(zip(ids, below, strict=True))
        for turn in [*ids, *rng.sample(range(5_000), 20)]:
            assert array.child(array.slot[n], turn) == (array.slot[held[turn]] if turn in held else -1)
    assert len(array.check) < 5 * len(children)
