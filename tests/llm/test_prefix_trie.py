"""The trie of conversations against plain dictionaries."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lattisym.llm import prefix_trie

TURNS = "conv_id long, turn long, role string, text string, depth string, fp int, part int"


def table(spark, rows):
    """Conversations with columns whose names clash with those that the operator uses."""
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], TURNS)


def rebuilt(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    own = {c: [(r, x) for _, r, x in sorted(v, key=lambda v: (v[0], v[1], v[2][:32], hashlib.sha256(f"{len(v[1])}:{v[1]}{v[2]}".encode()).digest()))] for c, v in own.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = own.get(base, [])[:h] + v[h:]
    return out


def plain(rows):
    convs, members, finals = rebuilt(rows), {}, {}
    for c, v in convs.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
        finals.setdefault(tuple(v), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out, leaves, saved = [], {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in kids.get(p, [])) or 1
        saved[p] = sum(saved[x] for x in kids.get(p, [])) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
        ends = ",".join(map(str, sorted(finals.get(p, []))))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def some_rows(seed, convs=60):
    rng = random.Random(seed)
    texts = ["", "a", "é𝄞", "yes", "no", "x" * 50, "x" * 40 + "y", "x" * 40 + "z", None]
    rows = []
    for c in rng.sample(range(-150, 450), convs) + [0, 100, 200, -100]:
        kind = rng.random()
        n = rng.randrange(1, 12)
        pool = texts if kind < 0.5 else ["yes"]
        for t in range(n):
            rows.append((c, None if rng.random() < 0.1 else t // 2, rng.choice(["user", "bot", None, ""]) if kind < 0.3 else "user", rng.choice(pool)))
    rows += rng.sample(rows, 10)
    rows += [(None, 0, "user", "lost")] * 3
    rng.shuffle(rows)
    return rows


def found(spark, rows, **how):
    return [tuple(x) for x in prefix_trie.prefix_trie(table(spark, rows), **how).collect()]


@pytest.mark.parametrize("seed", range(3))
def test_trie(spark, seed):
    rows = some_rows(seed)
    assert sorted(found(spark, rows), key=str) == sorted(plain(rows), key=str)


@pytest.mark.parametrize("moduli", [(3, 5), (101, 103)])
def test_collisions_are_split(spark, moduli):
    rows = [r for r in some_rows(7, 12) if r[0] is not None]
    assert sorted(found(spark, rows, moduli=moduli), key=str) == sorted(plain(rows), key=str)


def test_long_conversations_and_many_copies(spark, monkeypatch):
    """A conversation over many ranges, running sums of several runs, ids of copies in several pieces."""
    monkeypatch.setattr(prefix_trie, "RUN", 50)
    monkeypatch.setattr(prefix_trie, "PIECE", 200)
    rows = [(c, t, "user", f"turn {t % 3}") for c in (5, 6) for t in range(400)] + [(7, t, "user", f"turn {t % 3}" if t < 300 else "other") for t in range(400)]
    rows += [(1000 + c, t, "bot", f"copy {t}") for c in range(300) for t in range(3)]
    rows += [(9, 0, "user", "same")] * 500
    assert sorted(found(spark, rows), key=str) == sorted(plain(rows), key=str)


def test_texts_and_empty_table(spark):
    rows = some_rows(4, 20)
    convs = table(spark, rows)
    trie = prefix_trie.build(convs)
    got = sorted((x.conv_id, x.depth, x.role, x.text) for x in prefix_trie.node_texts(trie.nodes, convs).collect())
    want = set()
    for c, v in sorted(rebuilt(rows).items()):
        for d in range(1, len(v) + 1):
            want.add((min(k for k, w in rebuilt(rows).items() if w[:d] == v[:d]), d, *v[d - 1]))
    assert got == sorted(want)
    assert trie.members.groupBy("conv_id").agg(F.max("depth").alias("d")).count() == len(rebuilt(rows))
    none = table(spark, [(None, 0, "user", "lost")])
    assert prefix_trie.prefix_trie(none).count() == 0 and prefix_trie.prefix_trie(none.limit(0)).count() == 0
