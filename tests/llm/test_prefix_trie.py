"""The trie of conversation prefixes against a plain version."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from strandwise.llm import conversations, prefix_trie, queries

from ..compare import connect, same

SMALL = "/root/testdata/sf0.001"
DDL = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(conv, []).append((turn is not None, turn or 0, digest, (role, text)))
    turns = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(c - c % 5, [])[:h] + turns[c][h:]
    return out


def plain(paths):
    nodes, below = {}, {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    for key in nodes:
        if key:
            below.setdefault(key[:-1], []).append(key)
    saved, leaves = {}, {}
    for key in sorted(nodes, key=len, reverse=True):
        mine = (len(nodes[key]) - 1) * len(key[-1][1].encode()) if key else 0
        saved[key] = mine + sum(saved[k] for k in below.get(key, []))
        leaves[key] = sum(leaves[k] for k in below[key]) if key in below else 1
    out = []
    for key, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(paths[c]) == len(key))
        out.append((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), len(below.get(key, [])), leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    random.seed(9)
    shared = [("user", f"shared {i}") for i in range(30)]
    out = []
    for c in range(150):
        n = random.randint(1, 10)
        path = shared[: random.choice([0, 1, 2, n])] + [(random.choice(["user", "assistant", None]), random.choice([None, "", "é", f"{c} {i}"])) for i in range(n)]
        out += [(c, i if i else None, *turn) for i, turn in enumerate(path[:n])]
    out += [(c, i, *shared[i]) for c in range(200, 260) for i in range(12)]  # copies
    out += [(c, i, *shared[i]) for c in (300, 301, 302) for i in range(30)]
    out += [(303, i, "user", f"long {i % 7}") for i in range(80)] + [(304, i, "user", f"long {i % 7}") for i in range(60)]
    out += [(None, 0, "user", "nobody's"), (401, 1, "user", "alone"), (405, 3, "a", "tie"), (405, 3, "b", "tie"), (405, 3, "b", "tie"), (500, 0, "user", "x" * 200_000)]
    return out


@pytest.mark.parametrize(("piece", "cells"), [(4096, 1 << 27), (8, 64), (3, 1 << 27)])
def test_against_a_plain_version(spark, rows, monkeypatch, piece, cells):
    """Also with conversations in many pieces, and a sketch that proves next to nothing."""
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    frame = spark.createDataFrame(rows, DDL).withColumns({c: F.lit("x") for c in ("place", "digest", "n", "length", "part")}).repartition(5)
    got = prefix_trie.prefix_trie(*conversations.rebuilt(frame), most=cells).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rebuilt(rows))


def test_without_turns(spark):
    assert prefix_trie.prefix_trie(*conversations.rebuilt(spark.createDataFrame([], DDL))).count() == 0
    # both lie wholly in heads of conversations that are not there
    lost = [c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 3][:2]
    found = prefix_trie.prefix_trie(*conversations.rebuilt(spark.createDataFrame([(c, 0, "user", "t") for c in lost], DDL))).collect()
    assert [tuple(r) for r in found] == [(lost[0], 0, None, 2, 0, 1, 0, hashlib.sha256(f"{lost[0]},{lost[1]}".encode()).hexdigest())]


def test_screen_never_counts_too_few(spark):
    random.seed(2)
    digests = [random.getrandbits(63) - (1 << 62) for _ in range(3000)]
    twice = digests[:500]
    frame = spark.createDataFrame([(d,) for d in digests + twice], "d0 long").repartition(7)
    bits, cells = prefix_trie.screen(frame, 3500)
    import numpy as np

    def shared(d):
        at = [int(prefix_trie._cells(np.array([d], np.int64), row, cells)[0]) for row in range(2)]
        return all(bits[row][a >> 3] >> (a & 7) & 1 for row, a in enumerate(at))

    assert all(shared(d) for d in twice)
    assert sum(shared(d) for d in digests[500:]) < 100


def test_matches_sql(spark):
    same(queries.QUERIES["op11_prefix_trie"](spark, SMALL).toPandas(), connect(SMALL).sql(conversations.TRIE_SQL).df())
