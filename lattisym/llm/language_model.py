"""Scores of texts by a log-bilinear language model, trained with noise-contrastive estimation.

Counts of all words of all documents are taken in Spark, so what is gathered grows with the corpus. The WORDS most frequent training words and the end of a text have classes of
their own; every other word belongs to one of TAILS classes by a hash of its last three bytes, and in it has the share that its training count gives (half a count is added
to each word of the class, and to one that was never seen).

The model predicts the class of a token from the classes of the two before it (Mnih and Hinton, "Three new graphical models for statistical language modelling", 2007): each class
has a vector, each of the two places a matrix, their products add up to a predicted vector, and its product with each class's output vector plus a bias is that
class's score. Training is noise-contrastive (Mnih and Teh, 2012): words are told from noise drawn from the classes' frequencies, the same noise for all words of
a minibatch, so a step is a few matrix products. Every training document teaches once. In each of a few rounds the tasks start from the same model and train on what they read; the model
after the round is the mean of theirs, weighted by tokens and summed block by block in Spark.

Probabilities are normalised exactly: exp(score) is a product of one factor for each place, so the sums over all classes for all pairs of contexts are one matrix product. With it and
two tables of scores, all made once per worker by matrix products, a token's log-probability is three look-ups.

Counts of words with a class of their own, and of words that are frequent somewhere (more than one in FREQUENT tokens, so fewer than FREQUENT words), are broadcast; all others meet their counts in a join, after each document has
counted its own. Words are told apart by 96 bits of hash.

Defined cases: null and empty texts have one token, the end; a null doc_id is scored, learnt from and not held out; repeated rows come back each, and each counts; an empty table gives no rows;
without training rows every word has the share of one that was never seen; other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, cache, chunks, lower_ascii, mix, span_hash, stored, text_bytes, word_spans

#: Classes: a start (context only), the end, words, and groups of all other words.
WORDS, TAILS = 1022, 1024
START, END, FIRST = 0, 1, 2
CLASSES = FIRST + WORDS + TAILS
WIDTH, BATCH, NOISE, RATE = 32, 2048, 64, 0.03
#: Eighths of the documents that each round of training reads.
ROUNDS = ((0,), (1, 2), (3, 4), (5, 6, 7))
#: A word with more than one in so many tokens has its count broadcast.
FREQUENT = 1 << 18
#: Rows that a task gathers before it counts them together; numbers of a block of the model.
GATHER, BLOCK = 1 << 20, 4096

_END_HASH = (np.uint64(0x6A09E667F3BCC908), np.uint32(0xBB67AE85))


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, check, tail, text number) of every token of the texts, each text's end last. tail is the group of a word that has no class of its own."""
    data, at = text_bytes(column)
    n = len(at) - 1
    starts, ends, counts = word_spans(data, at)
    low = lower_ascii(data)
    owner = np.repeat(np.arange(n), counts + 1)
    last = np.cumsum(counts + 1) - 1
    word = np.ones(len(owner), bool)
    word[last] = False
    key, check, tail = np.full(len(owner), _END_HASH[0]), np.full(len(owner), _END_HASH[1]), np.zeros(len(owner), np.int32)
    if len(starts):
        key[word] = span_hash(low, starts, ends)
        check[word] = (span_hash(low ^ np.uint8(0x5A), starts, ends) >> U64(32)).astype(np.uint32)
        final = np.zeros(len(starts), np.uint64)
        for j in (1, 2, 3):
            final = final << U64(8) | np.where(ends - j >= starts, low[np.maximum(ends - j, 0)], 0).astype(np.uint64)
        tail[word] = (mix(final + U64(1)) % U64(TAILS)).astype(np.int32)
    return key, check, tail, owner


def _counted(key, check, *sums):
    """Equal (key, check) once, and sums of the other arrays; the first of them is kept as it is."""
    order = np.argsort(key, kind="stable")
    key, check = key[order], check[order]
    new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (check[1:] != check[:-1])))[: len(key)])
    return key[new], check[new], sums[0][order][new], *(np.add.reduceat(x[order], new) for x in sums[1:])


def _counter(batches):
    """Words with their counts in all documents and in training documents."""
    kept, size = [], 0

    def out():
        key, check, tail, every, taught = _counted(*(np.concatenate(x) for x in zip(*kept, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(check.view(np.int32)), pa.array(tail), pa.array(every), pa.array(taught)], names=["h", "g", "tail", "n", "c"])

    for batch in batches:
        for part in chunks(batch, "text"):
            key, check, tail, owner = tokens(part.column("text"))
            teaches = ~part.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            kept.append(_counted(key, check, tail, np.ones(len(key), np.int64), teaches[owner].astype(np.int64)))
            size += len(kept[-1][0])
            if size > GATHER:
                yield out()
                kept, size = [], 0
    if kept:
        yield out()


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, text, held_out, part: in which eighth of the documents a row is."""
    crc = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", "text", F.coalesce(crc % 5 == 1, F.lit(False)).alias("held_out"), F.coalesce(F.floor(crc / 5) % 8, F.lit(0)).cast("int").alias("part"))


def word_counts(rows: DataFrame) -> DataFrame:
    """h, g (hashes), tail, n (all tokens), c (training tokens) of every word."""
    found = rows.select("text", "held_out").mapInArrow(_counter, "h long, g int, tail int, n long, c long")
    return stored(found.groupBy("h", "g").agg(F.min("tail").alias("tail"), F.sum("n").alias("n"), F.sum("c").alias("c")))


class Vocabulary:
    """Numbers of bounded size about the words: totals, classes, shares of groups, counts of frequent words."""

    def __init__(self, counts: DataFrame, words: int = WORDS):
        groups = counts.groupBy("tail", ((F.col("h") == F.lit(int(_END_HASH[0].view(np.int64)))) & (F.col("g") == F.lit(int(_END_HASH[1].view(np.int32))))).alias("end"))
        groups = groups.agg(F.sum("n").alias("n"), F.sum("c").alias("c"), F.count_if(F.col("c") > 0).alias("v")).collect()
        self.total, self.distinct = sum(x.c for x in groups), sum(x.v for x in groups)
        tail_n, tail_v, self.ends = np.zeros(TAILS, np.int64), np.zeros(TAILS, np.int64), 0
        for x in groups:
            if x.end:
                self.ends += x.c
            else:
                tail_n[x.tail] += x.c
                tail_v[x.tail] += x.v
        known = counts.where("c > 0").orderBy(F.desc("c"), "h", "g").limit(words + 1).toArrow()
        h, g = known["h"].to_numpy().view(np.uint64), known["g"].to_numpy().view(np.uint32)
        own = np.flatnonzero((h != _END_HASH[0]) | (g != _END_HASH[1]))[:words]
        np.subtract.at(tail_n, known["tail"].to_numpy()[own], known["c"].to_numpy()[own])
        np.subtract.at(tail_v, known["tail"].to_numpy()[own], 1)
        order = own[np.argsort(h[own], kind="stable")]
        self.keys, self.checks, count = h[order], g[order], known["c"].to_numpy()[order]
        #: how often each class was seen
        self.seen = np.zeros(CLASSES)
        self.seen[END], self.seen[FIRST : FIRST + len(order)], self.seen[FIRST + WORDS :] = self.ends, count, tail_n
        self.group_share = np.log10(tail_n + 0.5 * (tail_v + 1))
        often = counts.where(F.col("n") > sum(x.n for x in groups) / FREQUENT).select("h", "g", "c").toArrow()
        end = {"h": _END_HASH[0].view(np.int64), "g": _END_HASH[1].view(np.int32), "c": np.int64(self.ends)}
        both = [np.concatenate((often[c].to_numpy(), known[c].to_numpy()[own], [end[c]])) for c in ("h", "g", "c")]
        #: hashes, checks and training counts of frequent words and of those with classes, the end among them
        self.often = _counted(both[0].view(np.uint64), both[1].view(np.uint32), both[2])

    def plain(self) -> dict:
        """What tasks need, as arrays and numbers: broadcasts are unpickled where this module may not be."""
        return {"keys": self.keys, "checks": self.checks, "seen": self.seen, "group_share": self.group_share, "often": self.often, "total": self.total, "distinct": self.distinct}


def classes_of(v: dict, key: np.ndarray, check: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """The class of each token, by the keys and checks of a vocabulary."""
    out = FIRST + WORDS + tail
    at, good = _find(v["keys"], v["checks"], key, check)
    out[good] = FIRST + at[good]
    out[(key == _END_HASH[0]) & (check == _END_HASH[1])] = END
    return out


def _find(keys, checks, key, check):
    """Where each (key, check) is among the sorted ones, and whether it is there."""
    if not len(keys):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    good = (keys[at] == key) & (checks[at] == check)
    if len(keys) > 1 and (keys[1:] == keys[:-1]).any():  # equal hashes, told apart by the check
        for k in np.flatnonzero((keys[at] == key) & ~good):
            for j in range(at[k] + 1, len(keys)):
                if keys[j] != key[k]:
                    break
                if checks[j] == check[k]:
                    at[k], good[k] = j, True
    return at, good


def contexts(classes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes one and two places before each token; the start before the first ones of a text."""
    out = []
    for gap in (1, 2):
        c = np.full(len(classes), START, classes.dtype)
        c[gap:] = np.where(owner[gap:] == owner[:-gap], classes[:-gap], START)
        out.append(c)
    return out[0], out[1]


class Model:
    """Vectors of contexts and of predicted classes, a matrix for each place, biases."""

    shapes = ((CLASSES, WIDTH), (CLASSES, WIDTH), (WIDTH, WIDTH), (WIDTH, WIDTH), (CLASSES,))

    def __init__(self, flat: np.ndarray):
        at, parts = 0, []
        for shape in self.shapes:
            size = int(np.prod(shape))
            parts.append(flat[at : at + size].reshape(shape))
            at += size
        self.flat = flat
        self.inputs, self.outputs, self.near, self.far, self.bias = parts

    @classmethod
    def fresh(cls, noise: np.ndarray) -> Model:
        rng = np.random.default_rng(12)
        model = cls(np.zeros(sum(int(np.prod(x)) for x in cls.shapes), np.float32))
        model.inputs[:] = rng.normal(0, 0.3, model.inputs.shape)
        model.outputs[:] = rng.normal(0, 0.1, model.outputs.shape)
        model.near[:], model.far[:] = np.eye(WIDTH), 0.5 * np.eye(WIDTH)
        model.bias[:] = np.log(noise)
        return model


def noise_of(seen: np.ndarray) -> np.ndarray:
    """Shares of the classes, half a count added to each; the start is never predicted."""
    share = seen + 0.5
    share[START] = 1e-9
    return share / share.sum()


class Learner:
    """Noise-contrastive steps with per-coordinate rates. Arrays are kept from step to step: fresh ones of this size would take longer to be mapped than to be filled."""

    def __init__(self, flat: np.ndarray, noise: np.ndarray):
        self.model = Model(flat.copy())
        self.squares = Model(np.full(len(flat), 1e-3, np.float32))
        self.rng, self.steps = np.random.default_rng(34), np.cumsum(noise)
        self.offset = np.log(NOISE * noise).astype(np.float32)
        self.grown, self.work = Model(np.zeros(len(flat), np.float32)), np.empty(len(flat), np.float32)
        self.ways, self.rows, self.odds = np.empty((2, CLASSES, WIDTH), np.float32), np.empty((4, 0, WIDTH), np.float32), np.empty((0, NOISE), np.float32)

    def _sums(self, index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct numbers in index, and the sums of their rows of values."""
        order = np.argsort(index.astype(np.uint16), kind="stable")
        index = index[order]
        new = np.flatnonzero(np.concatenate(([True], index[1:] != index[:-1])))
        return index[new], np.add.reduceat(np.take(values, order, 0, self.rows[3][: len(order)], "clip"), new)

    def step(self, near: np.ndarray, far: np.ndarray, target: np.ndarray) -> None:
        m, g, n = self.model, self.grown, len(target)
        if self.rows.shape[1] < max(n, NOISE):
            self.rows, self.odds = np.empty((4, max(n, NOISE), WIDTH), np.float32), np.empty((max(n, NOISE), NOISE), np.float32)
        drawn = np.searchsorted(self.steps, self.rng.random(NOISE) * self.steps[-1]).clip(1, CLASSES - 1)
        predicted, wanted, d_predicted = (self.rows[k][:n] for k in range(3))
        np.take(np.matmul(m.inputs, m.near, out=self.ways[0]), near, 0, predicted, "clip")
        predicted += np.take(np.matmul(m.inputs, m.far, out=self.ways[1]), far, 0, wanted, "clip")
        np.take(m.outputs, target, 0, wanted, "clip")
        other, scale = m.outputs[drawn], np.float32(1 / n)
        good = 1 / (1 + np.exp(-(np.einsum("ij,ij->i", predicted, wanted) + m.bias[target] - self.offset[target]).clip(-30, 30)))
        down = np.matmul(predicted, other.T, out=self.odds[:n])
        down += (m.bias - self.offset)[drawn]
        np.exp(np.negative(np.clip(down, -30, 30, out=down), out=down), out=down)
        down += 1
        np.divide(-scale, down, out=down)
        up = (1 - good) * scale
        np.matmul(down, other, out=d_predicted)
        wanted *= up[:, None]
        d_predicted += wanted
        g.flat.fill(0)
        where, sums = self._sums(target, np.multiply(predicted, up[:, None], out=wanted))
        g.outputs[where] = sums
        where, sums = self._sums(drawn, down.T @ predicted)
        g.outputs[where] += sums
        g.bias += np.bincount(target, up, CLASSES)
        g.bias += np.bincount(drawn, down.sum(0), CLASSES)
        where, sums = self._sums(near, d_predicted)
        g.inputs[where] = sums @ m.near.T
        np.matmul(m.inputs[where].T, sums, out=g.near)
        where, sums = self._sums(far, d_predicted)
        g.inputs[where] += sums @ m.far.T
        np.matmul(m.inputs[where].T, sums, out=g.far)
        g, s = g.flat, self.squares.flat
        g *= np.float32(np.sqrt(n))
        s += np.multiply(g, g, out=self.work)
        g /= np.sqrt(s, out=self.work)
        g *= np.float32(RATE)
        m.flat += g


def _trainer(vocabulary, shared):
    def train(batches):
        from pyspark import TaskContext

        learner, done, rest, v = None, 0, None, vocabulary.value
        for batch in batches:
            for part in chunks(batch, "text"):
                if learner is None:
                    learner = Learner(shared.value, noise_of(v["seen"]))
                key, check, tail, owner = tokens(part.column("text"))
                classes = classes_of(v, key, check, tail)
                new = np.stack((*contexts(classes, owner), classes))
                rest = new if rest is None else np.concatenate((rest, new), 1)
                whole = rest.shape[1] // BATCH * BATCH
                for at in range(0, whole, BATCH):
                    learner.step(*rest[:, at : at + BATCH])
                done, rest = done + whole, rest[:, whole:]
        if learner is None:
            return
        if rest.shape[1]:
            learner.step(*rest)
            done += rest.shape[1]
        flat, task = learner.model.flat, TaskContext.get().partitionId()
        blocks = range(0, len(flat), BLOCK)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k // BLOCK for k in blocks], pa.int32()), pa.array([task] * len(blocks), pa.int32()), pa.array([done] * len(blocks), pa.int64()), pa.array([flat[k : k + BLOCK].tobytes() for k in blocks], pa.binary())], names=["block", "task", "tokens", "numbers"]
        )

    return train


def _averager(batches):
    """The mean of the blocks of all tasks, weighted by their tokens; sorted by block, one block held at a time."""
    block, total, weight = None, None, 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())], names=["block", "numbers"])

    for batch in batches:
        for k, n, numbers in zip(*(batch.column(c).to_pylist() for c in ("block", "tokens", "numbers")), strict=True):
            if k != block:
                if block is not None:
                    yield out()
                block, total, weight = k, 0.0, 0
            total = total + n * np.frombuffer(numbers, np.float32).astype(np.float64)
            weight += n
    if block is not None:
        yield out()


def fit(rows: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """The model's numbers after all rounds over the training rows of rows(text, held_out, part)."""
    sc = rows.sparkSession.sparkContext
    known, flat = sc.broadcast(vocabulary.plain()), Model.fresh(noise_of(vocabulary.seen)).flat
    for parts in ROUNDS:
        taught = rows.where(~F.col("held_out") & F.col("part").isin(*parts)).select("text").mapInArrow(_trainer(known, sc.broadcast(flat)), "block int, task int, tokens long, numbers binary")
        found = taught.repartition("block").sortWithinPartitions("block", "task").mapInArrow(_averager, "block int, numbers binary").toArrow().sort_by("block")
        if found.num_rows:  # a model has a fixed number of blocks
            flat = np.frombuffer(b"".join(found["numbers"].to_pylist()), np.float32).copy()
    return flat


class Tables:
    """log10 of the probability of each class after each pair of contexts, as near[c1, w] + far[c2, w] - whole[c1, c2]."""

    def __init__(self, flat: np.ndarray):
        m = Model(flat)
        near, far = (m.inputs @ m.near) @ m.outputs.T, (m.inputs @ m.far) @ m.outputs.T + m.bias
        near[:, START] = -np.inf
        top = near[:, 1:].max(1, keepdims=True), far.max(1, keepdims=True)
        sums = np.exp(near - top[0]) @ np.exp(far - top[1]).T
        whole = np.log(np.maximum(sums, np.float32(1e-38))) + top[0] + top[1].T
        self.near, self.far, self.whole = (x / np.float32(np.log(10)) for x in (near, far, whole))

    def score(self, near: np.ndarray, far: np.ndarray, target: np.ndarray) -> np.ndarray:
        return self.near[near, target] + self.far[far, target] - self.whole[near, far]


_TAIL = pa.list_(pa.struct([("h", pa.int64()), ("g", pa.int32()), ("k", pa.int32())]))


def _scorer(vocabulary, shared, name):
    def score(batches):
        v, kept = vocabulary.value, cache()
        if kept.get("language_model", (None,))[0] != name:
            kept["language_model"] = name, Tables(shared.value)
        tables = kept["language_model"][1]
        unit, often = np.log10(v["total"] + 0.5 * (v["distinct"] + 1)), v["often"]
        for batch in batches:
            for part in chunks(batch, "text"):
                n = part.num_rows
                key, check, tail, owner = tokens(part.column("text"))
                classes = classes_of(v, key, check, tail)
                value = tables.score(*contexts(classes, owner), classes).astype(np.float64)
                grouped = classes >= FIRST + WORDS
                value[grouped] -= v["group_share"][classes[grouped] - FIRST - WORDS]
                at, known = _find(often[0], often[1], key, check)
                count = np.where(known, often[2][at] if len(often[2]) else 0, 0)
                own = np.where(known, np.log10(count + 0.5), 0.0)
                value[grouped] += own[grouped]
                sums = lambda x: np.bincount(owner, weights=x, minlength=n)
                rare = np.flatnonzero(~known)
                mine = mix(key[rare] ^ (owner[rare].astype(np.uint64) * U64(0x9E3779B97F4A7C15)))
                order = rare[np.lexsort((check[rare], mine, owner[rare]))]
                same = np.concatenate(([True], (owner[order][1:] != owner[order][:-1]) | (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])))[: len(order)]
                new = np.flatnonzero(same)
                times = np.diff(np.append(new, len(order)))
                edges = np.searchsorted(owner[order][new], np.arange(n + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays([pa.array(key[order][new].view(np.int64)), pa.array(check[order][new].view(np.int32)), pa.array(times.astype(np.int32))], names=["h", "g", "k"]))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in ("row", "doc_id", "held_out")), pa.array(np.bincount(owner, minlength=n)), pa.array(sums(known & (count > 0)).astype(np.int64)),
                        pa.array(sums(own - unit)), pa.array(sums(value)), lists,
                    ],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"],
                )

    return score


def score(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. At most `words` words have classes of their own."""
    rows, sc = rows_of(docs), docs.sparkSession.sparkContext
    counts = word_counts(rows)
    vocabulary = Vocabulary(counts, words)
    flat = fit(rows, vocabulary)
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "held_out")
    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<struct<h:long,g:int,k:int>>"
    scored = stored(numbered.mapInArrow(_scorer(sc.broadcast(vocabulary.plain()), sc.broadcast(flat), uuid.uuid4().hex), schema))
    # words that are frequent nowhere: each document's own count meets the corpus's
    own = scored.select("row", F.explode("rare").alias("x")).select("row", "x.*")
    more = own.join(counts.select("h", "g", "c"), ["h", "g"]).groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("more"), F.sum(F.col("k") * F.log10(F.col("c") + 0.5)).alias("logs"))
    logs, found = F.coalesce("logs", F.lit(0.0)), F.coalesce("more", F.lit(0))
    return scored.drop("rare").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + found).alias("n_known"), F.lit(vocabulary.total).cast("long").alias("train_tokens"), (F.col("base_score") + logs).alias("base_score"), (F.col("score") + logs).alias("score")
    )
