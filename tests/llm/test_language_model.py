"""The language model against plain counts, plain gradients and sums of probabilities."""

import math
import tracemalloc
import pickle
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattisym.llm import language_model as lm

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, score string, h int"


def frame(spark, texts, ids=None):
    """Documents with columns whose names clash with those that the operator uses."""
    return spark.createDataFrame([(k if ids is None else ids[k], t, "en", "s", 0, 1, "x", 2) for k, t in enumerate(texts)], DOCS)


def plain_tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def plain(texts, ids):
    count = Counter(w for k, t in zip(ids, texts, strict=True) if not held(k) for w in plain_tokens(t))
    n, v = sum(count.values()), len(count)
    out = []
    for k, t in zip(ids, texts, strict=True):
        w = plain_tokens(t)
        out.append((k, held(k), len(w), sum(x in count for x in w), n, sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)))
    return out


def chain_texts(n=400, seed=1):
    """Texts in which a word often decides the next one, with rare words, odd spaces and capitals."""
    rng = random.Random(seed)
    follow = {k: rng.sample(range(60), 3) for k in range(60)}
    out = []
    for _ in range(n):
        w, words = rng.randrange(60), []
        for _ in range(rng.randrange(5, 80)):
            words.append(rng.choice((f"w{w}", f"W{w}")) if rng.random() < 0.95 else f"rare{rng.randrange(10**6)}é")
            w = rng.choice(follow[w]) if rng.random() < 0.9 else rng.randrange(60)
        out.append(rng.choice((" ", "\n", " \t ")).join(words))
    return [*out, None, "", " \x0b", "end", "x" * 50_000, "long " * 30_000]


def test_counts_and_base_score(spark, monkeypatch):
    monkeypatch.setattr(lm, "GATHER", 500)
    texts = chain_texts(120)
    texts += [texts[0], texts[3], "only here", "null id"]
    ids = [*range(len(texts) - 4), 0, 3, -7, None]
    got = lm.score(frame(spark, texts, ids), 30).collect()
    want = plain(texts, ids)
    monkeypatch.setattr(lm, "FREQUENT", 3)  # nearly all words meet their counts in the join, those with classes don't
    key = lambda x: (str(x.doc_id), x.n_tokens, x.score)
    again = sorted(lm.score(frame(spark, texts, ids), 30).collect(), key=key)
    for a, b in zip(sorted(got, key=key), again, strict=True):
        assert a[:5] == b[:5] and abs(a.base_score - b.base_score) < 1e-6 * max(1, abs(a.base_score)) and abs(a.score - b.score) < 1e-6 * max(1, abs(a.score))
    assert got[0].__fields__ == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    order = lambda rows: sorted(rows, key=lambda x: (x[0] is None, x[0] or 0))
    for a, b in zip(order([tuple(x) for x in got]), order(want), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5])) and a[6] <= 0
    by = {}
    for x in got:
        by.setdefault(x.doc_id, set()).add(x.score)
    assert len(by[0]) == len(by[3]) == 1


def test_model_beats_counts_on_held_out_texts(spark):
    texts = chain_texts(3000)[:3000]
    got = [x for x in lm.score(frame(spark, texts)).collect() if x.held_out]
    assert len(got) > 400
    score, base, n = (sum(getattr(x, c) for x in got) for c in ("score", "base_score", "n_tokens"))
    assert score / n > base / n + 0.15


def test_odd_tables(spark):
    assert lm.score(frame(spark, ["x"]).limit(0)).count() == 0
    only = next(k for k in range(100) if held(k))
    (x,) = lm.score(frame(spark, ["a b"], [only])).collect()
    assert x.held_out and (x.n_tokens, x.n_known, x.train_tokens, x.base_score) == (3, 0, 0, 0.0) and math.isfinite(x.score) and x.score <= 0


def test_probabilities_sum_to_one(spark):
    docs = frame(spark, chain_texts(200))
    rows = lm.rows_of(docs)
    counts = lm.word_counts(rows)
    vocabulary = lm.Vocabulary(counts, words=20)
    assert b"lattisym" not in pickle.dumps(vocabulary.plain())  # executors may have no copy of the package
    flat = lm.fit(rows, vocabulary)
    tables = lm.Tables(flat)
    every = np.arange(lm.CLASSES)
    for near, far in np.random.default_rng(1).integers(0, lm.CLASSES, (30, 2)):
        p = 10.0 ** tables.score(np.full(lm.CLASSES, near), np.full(lm.CLASSES, far), every).astype(float)
        assert abs(p.sum() - 1) < 1e-3 and p[lm.START] == 0
        m = lm.Model(flat.astype(np.float64))
        s = m.outputs @ (m.near.T @ m.inputs[near] + m.far.T @ m.inputs[far]) + m.bias
        s[lm.START] = -np.inf
        assert np.allclose(np.log(p[1:]), (s - np.log(np.exp(s).sum()))[1:], atol=1e-3)
    # within each group the words that were seen and one that wasn't have all of it
    words = counts.where("c > 0").toPandas()
    own = set(zip(vocabulary.keys.tolist(), vocabulary.checks.tolist(), strict=True))
    share = Counter({k: 0.5 / 10.0 ** vocabulary.group_share[k] for k in range(lm.TAILS)})
    seen = 0
    for h, g, tail, c in words[["h", "g", "tail", "c"]].itertuples(index=False):
        key = (int(np.int64(h).view(np.uint64)), int(np.int32(g).view(np.uint32)))
        if key not in own and key != (int(lm._END_HASH[0]), int(lm._END_HASH[1])):
            share[tail] += (c + 0.5) / 10.0 ** vocabulary.group_share[tail]
            seen += 1
    assert seen > 100 and all(abs(x - 1) < 1e-9 for x in share.values())


def test_step_against_plain_gradients():
    """The first step of a learner against sums over single words and noise."""
    rng = np.random.default_rng(5)
    noise = lm.noise_of(rng.integers(0, 50, lm.CLASSES).astype(float))
    start = lm.Model.fresh(noise)
    near, far, target = rng.integers(0, lm.CLASSES, (3, 40))
    target = np.maximum(target, 1)
    learner = lm.Learner(start.flat, noise)
    drawn = np.searchsorted(learner.steps, np.random.default_rng(34).random(lm.NOISE) * learner.steps[-1]).clip(1, lm.CLASSES - 1)
    g = lm.Model(np.zeros(len(start.flat)))
    m = lm.Model(start.flat.astype(np.float64))
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    for a, b, w in zip(near, far, target, strict=True):
        q = m.inputs[a] @ m.near + m.inputs[b] @ m.far
        for x, up in ((w, 1), *((y, 0) for y in drawn)):
            d = (up - sigmoid(q @ m.outputs[x] + m.bias[x] - math.log(lm.NOISE * noise[x]))) / 40
            g.outputs[x] += d * q
            g.bias[x] += d
            g.near[:] += d * np.outer(m.inputs[a], m.outputs[x])
            g.far[:] += d * np.outer(m.inputs[b], m.outputs[x])
            g.inputs[a] += d * (m.near @ m.outputs[x])
            g.inputs[b] += d * (m.far @ m.outputs[x])
    learner.step(near, far, target)
    step = g.flat * math.sqrt(40)
    want = start.flat + lm.RATE * step / np.sqrt(1e-3 + step * step)
    assert np.allclose(learner.model.flat, want, atol=2e-4)


def test_steps_reuse_their_arrays():
    """A step maps no fresh arrays of the model's size, and a longer minibatch after a shorter one is as good as alone."""
    rng = np.random.default_rng(6)
    noise = lm.noise_of(rng.integers(0, 50, lm.CLASSES).astype(float))
    learner = lm.Learner(lm.Model.fresh(noise).flat, noise)
    short, full = rng.integers(1, lm.CLASSES, (3, 10)), rng.integers(1, 700, (3, lm.BATCH))
    learner.step(*short)
    after, state = learner.model.flat.copy(), learner.rng.bit_generator.state
    learner.step(*full)
    other = lm.Learner(after, noise)
    other.rng.bit_generator.state = state
    first = lm.Learner(lm.Model.fresh(noise).flat, noise)
    first.step(*short)
    other.squares.flat[:] = first.squares.flat
    other.step(*full)
    assert np.array_equal(other.model.flat, learner.model.flat)
    tracemalloc.start()
    learner.step(*full)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < learner.model.flat.nbytes


def test_equal_hashes_are_told_apart():
    keys, checks = np.array([3, 7, 7, 7, 9], np.uint64), np.array([1, 1, 2, 3, 1], np.uint32)
    at, good = lm._find(keys, checks, np.array([7, 7, 7, 7, 9, 4], np.uint64), np.array([1, 3, 2, 4, 1, 1], np.uint32))
    assert good.tolist() == [True, True, True, False, True, False] and at[:3].tolist() == [1, 3, 2] and at[4] == 4


def test_tokens():
    texts = ["The the, É\x0bx", None, "", "a  b"]
    key, check, tail, owner = lm.tokens(pa.array(texts))
    assert owner.tolist() == [0, 0, 0, 0, 0, 1, 2, 3, 3, 3]
    words = [w for t in texts for w in plain_tokens(t)]
    names = {}
    for w, k, c in zip(words, key.tolist(), check.tolist(), strict=True):
        assert names.setdefault(w, (k, c)) == (k, c)
    assert len(set(names.values())) == len(names) == len({k for k, _ in names.values()}) == len({c for _, c in names.values()})
    assert 0 <= tail.min() and tail.max() < lm.TAILS


def test_rows_keep_null_ids(spark):
    rows = {x.doc_id: x for x in lm.rows_of(frame(spark, ["a"] * 40, [None, *range(39)])).collect()}
    assert rows[None].held_out is False and rows[None].part == 0
    assert {k for k, x in rows.items() if x.held_out} == {k for k in range(39) if held(k)}
    assert lm.rows_of(frame(spark, ["a"])).withColumn("x", F.lit(1)).columns[:4] == ["doc_id", "text", "held_out", "part"]
