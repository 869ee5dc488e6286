"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text, each counted once: its words, the stems of longer words (their first four and five bytes, for inflected forms), pairs of
neighbouring words, and pairs with one word between (letters, digits and all non-ASCII bytes make words; A-Z lower-cased), hashed to 32 bits. The learner keeps
per-coordinate learning rates and an L1 penalty (McMahan et al., "Ad click prediction", 2013), so few weights
differ from zero; only those are sent to the executors.

Labels are learnt from at most `sample` labelled rows (a documented bound: 7,500 by default, a third of them toxic), the first
of each label by a hash of doc_id among those whose crc32(doc_id) mod 4 is not 2. Each teaches with all features of its whole text. What the driver gets is
bounded by `most` bytes of features as well (96 MB by default): with long texts fewer rows are taken, by the same order. Every row of the input is scored on its whole text.

Defined cases: null and empty texts have the score of the bias alone; a null doc_id is scored and not held out;
several labels of one doc_id count as their maximum; null labels are ignored; without a toxic label to learn from every score is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, affordable, chunks, cut, mix, span_hash, text_bytes

ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 10.0, 0.5, 6
#: Rows to learn from, and bytes of their features.
SAMPLE, MOST = 7_500, 96 << 20
#: 1 for every score from here on.
THRESHOLD = 0.3

#: Bytes of a longer word that are a feature of their own, and a number that tells it from a word.
STEMS = ((4, 0xA0761D6478BD642F), (5, 0xE7037ED1A0B428DB))

_LETTER = np.zeros(256, bool)
_LETTER[128:] = True
for _a, _z in ((48, 57), (65, 90), (97, 122)):
    _LETTER[_a : _z + 1] = True


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(text number, feature) of every occurrence, and how many texts there are."""
    data, at = text_bytes(column)
    n = len(at) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint32), n
    word = _LETTER[data]
    first = np.zeros(len(data), bool)
    first[at[:-1][at[:-1] < at[1:]]] = True
    before = np.concatenate(([False], word[:-1])) & ~first
    after = np.concatenate((word[1:] & ~first[1:], [False]))
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    words = span_hash(low, starts, ends)
    doc = np.searchsorted(at, starts, side="right") - 1
    owner, found = [doc], [words]
    for length, salt in STEMS:
        long = np.flatnonzero(ends - starts > length)
        found.append(mix(span_hash(low, starts[long], starts[long] + length) * U64(salt)))
        owner.append(doc[long])
    for gap, salt in ((1, 0x8CB92BA72F3D8DD7), (2, 0xC2B2AE3D27D4EB4F)):
        if len(words) > gap:
            same = doc[gap:] == doc[:-gap]
            found.append(mix(words[:-gap] * U64(salt) + words[gap:])[same])
            owner.append(doc[gap:][same])
    return np.concatenate(owner), (np.concatenate(found) >> U64(32)).astype(np.uint32), n


def _featurise(batches):
    for batch in batches:
        for part in chunks(batch, "text"):
            doc, feature, n = features(part.column("text"))
            both = np.unique((doc.astype(np.uint64) << U64(32)) | feature)
            at = np.searchsorted(both >> U64(32), np.arange(n + 1, dtype=np.uint64))
            low = (both & U64(0xFFFFFFFF)).astype(np.uint32)
            rows = [low[at[k] : at[k + 1]].tobytes() for k in range(n)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.array(rows, pa.binary())], names=["doc_id", "toxic", "features"])


class Model:
    """Sorted feature hashes with weights other than zero, and a bias."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float):
        self.hashes, self.weights, self.bias = hashes, weights, bias


def fit(examples: list[tuple[int, bytes]]) -> Model:
    """Train on (label, packed features) in the given order."""
    if not any(label for label, _ in examples):
        return Model(np.zeros(0, np.uint32), np.zeros(0), -np.inf)
    rows = [np.frombuffer(x, dtype=np.uint32) for _, x in examples]
    every = np.concatenate(rows)
    every.sort()
    again = every[1:][every[1:] == every[:-1]]  # L1 leaves a feature of a single example at zero
    hashes = again[np.concatenate((np.ones(min(1, len(again)), bool), again[1:] != again[:-1]))]
    del every, again
    z, n = np.zeros(len(hashes) + 1), np.zeros(len(hashes) + 1)
    where = []
    for x in rows:
        k = np.searchsorted(hashes, x)
        k = k[hashes[np.minimum(k, len(hashes) - 1)] == x] if len(hashes) else k[:0]
        where.append(np.append(k, len(hashes)).astype(np.int32))  # the last coordinate is the bias
    penalty = np.full(len(z), L1)
    penalty[-1] = 0.0

    def weights(at):
        size = np.abs(z[at]) - penalty[at]
        return np.where(size > 0, -np.sign(z[at]) * size / ((BETA + np.sqrt(n[at])) / ALPHA + L2), 0.0)

    order = np.arange(len(rows))
    for epoch in range(EPOCHS):
        for k in np.random.default_rng(epoch).permutation(order):
            at = where[k]
            w = weights(at)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - examples[k][0]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = weights(np.arange(len(z)))
    keep = np.flatnonzero(w[:-1])
    return Model(hashes[keep], w[keep], float(w[-1]))


def training_rows(docs: DataFrame, known: DataFrame, shares: dict[int, int], most: int = MOST) -> pa.Table:
    """doc_id, toxic, features of the rows to learn from: so many of each label, all features of each, `most` bytes at most."""
    chosen = None
    for label, rows in shares.items():
        part = known.where((F.col("toxic") > 0) == F.lit(label == 1)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    # bounded: at most so many rows of two numbers, which makes the broadcast safe
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    # one row per chosen id, so what the driver gets is bounded even if ids repeat
    got = rows.select("doc_id", "toxic", "text").mapInArrow(_featurise, "doc_id long, toxic int, features binary").groupBy("doc_id").agg(F.min(F.struct("features", "toxic")).alias("x"))
    got = cut(got.select("doc_id", "x.toxic", "x.features"))
    sizes, ids = got.select("doc_id", "toxic", F.octet_length("features").cast("long").alias("n")).toArrow(), []
    for label, rows in shares.items():
        own = sizes.filter(pc.equal(pc.greater(sizes["toxic"], 0), label == 1))
        ids += affordable(own["doc_id"].to_numpy(), own["n"].to_numpy(), most * rows // max(1, sum(shares.values())))
    return (got if len(ids) == sizes.num_rows else got.where(F.col("doc_id").isin(ids))).toArrow().sort_by("doc_id")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = MOST) -> Model:
    """Fit on at most `sample` labelled rows of docs(doc_id, text) that are not held out, with at most `most` bytes of features."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null and crc32(cast(doc_id as string)) % 4 <> 2")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    found = training_rows(docs, known, {1: sample // 3, 0: sample - sample // 3}, most)
    label = np.array(found.column("toxic").to_pylist(), int) > 0
    model = fit([(int(t), f) for t, f in zip(label, found.column("features").to_pylist(), strict=True)])
    total = known.agg(F.count_if(F.col("toxic") > 0).alias("toxic"), F.count_if(F.col("toxic") <= 0).alias("clean")).first()
    # the rarer class is sampled more densely; this puts the odds of all labelled rows back
    model.bias += np.log(max(1, total.toxic) / max(1, label.sum())) - np.log(max(1, total.clean) / max(1, (~label).sum()))
    return model


def _scorer(hashes: bytes, weights: bytes, bias: float):
    def score(batches):
        known, weight = np.frombuffer(hashes, dtype=np.uint32), np.frombuffer(weights)
        maybe = np.zeros(1 << 16, bool)
        maybe[known >> np.uint32(16)] = True
        for batch in batches:
            for part in chunks(batch, "text"):
                doc, feature, n = features(part.column("text"))
                total = np.full(n, bias)
                hit = np.flatnonzero(maybe[feature >> np.uint32(16)])
                if len(known) and len(hit):
                    at = np.minimum(np.searchsorted(known, feature[hit]), len(known) - 1)
                    good = known[at] == feature[hit]
                    pair = np.unique(doc[hit][good].astype(np.int64) * len(known) + at[good])
                    total += np.bincount(pair // len(known), weights=weight[pair % len(known)], minlength=n)
                with np.errstate(over="ignore"):
                    p = 1.0 / (1.0 + np.exp(-total))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names if c != "text"), pa.array(p)], names=[*(c for c in part.schema.names if c != "text"), "score"])

    return score


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted."""
    model = train(docs, labels, sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(_scorer(model.hashes.tobytes(), model.weights.tobytes(), model.bias), "doc_id long, score double")
    held = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 4 = 2"), F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, all columns, that are not predicted toxic. One pass over the texts: the model is applied row by row."""
    model = train(docs, labels, sample)
    known, weights, bias = model.hashes.tobytes(), model.weights.tobytes(), model.bias
    inner = _scorer(known, weights, bias)

    def keep(batches):
        for batch in batches:
            slim = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(batch.schema.names.index("text"))], names=["row", "text"])
            scores = np.concatenate([x.column("score").to_numpy(zero_copy_only=False) for x in inner([slim])] or [np.zeros(0)])
            yield batch.filter(pa.array(scores < THRESHOLD))

    return docs.mapInArrow(keep, docs.schema)
