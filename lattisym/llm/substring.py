"""Substring deduplication with difference-cover anchors.

A window is WINDOW consecutive words. It would be costly to hash every window of a corpus, so only ANCHOR-word runs that start at
cover positions modulo PERIOD are hashed. COVER is a perfect difference set: for any two positions there is a shift below PERIOD
that puts both on it. As PERIOD - 1 + ANCHOR <= WINDOW, whenever two documents share a window they share an aligned anchor
inside it, although only six of 31 positions are hashed.

Anchors that documents of different word sequences share mark where windows can repeat; there, and only there, the match is extended:
every full window around a shared anchor is hashed (128 bits) and its least doc_id found. Words of windows that start in a smaller document go.
Documents of equal word sequences are settled as a whole. No step lists pairs; grouped minima are combined before each shuffle,
and joins are against one row per hash.

Defined cases: a null or empty text has no words; a null doc_id is neither smaller nor larger than any: nothing of it is removed, and it
removes nothing; rows of one doc_id are judged each by their own text, and not against each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, chunks, cut, key_filter, mix, passes, sequence_hash, signed, span_hash, stored, text_bytes, texts_of, word_spans

WINDOW, PERIOD, ANCHOR = 50, 31, 20
#: A perfect difference set modulo 31: every difference occurs.
COVER = (1, 5, 11, 24, 25, 27)


def _words(column: pa.Array):
    data, at = text_bytes(column)
    starts, ends, counts = word_spans(data, at)
    return data, at, starts, ends, counts, span_hash(data, starts, ends)


def _digests(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash of each text's sequence of words."""
    first = np.concatenate(([0], np.cumsum(counts)))
    inner = (np.arange(len(words)) - np.repeat(first[:-1], counts)).astype(np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(words + mix(inner + U64(1))), dtype=np.uint64)))
    return mix(sums[first[1:]] - sums[first[:-1]] + counts.astype(np.uint64))


def _joined(data: np.ndarray, at: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Each text's words joined by one space."""
    keep = np.zeros(len(data) + 1, np.int8)
    np.add.at(keep, starts, 1)
    np.add.at(keep, ends, -1)
    word = np.cumsum(keep[:-1]).astype(bool)
    take = word.copy()
    last = np.zeros(len(ends), bool)
    last[np.cumsum(counts)[counts > 0] - 1] = True
    take[ends[~last]] = True
    out = np.where(word, data, np.uint8(32))[take]
    where = np.concatenate(([0], np.cumsum(take)))[at]
    raw = out.tobytes()
    return [raw[a:b] for a, b in zip(where[:-1], where[1:], strict=True)]


def _summary(batches):
    for batch in batches:
        for part in chunks(batch, "text"):
            data, at, starts, ends, counts, words = _words(part.column("text"))
            sha = [hashlib.sha256(x).hexdigest() for x in _joined(data, at, starts, ends, counts)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts.astype(np.int64)), pa.array(signed(_digests(words, counts))), pa.array(sha, pa.string())], names=["doc_id", "n_words", "digest", "whole_sha256"])


def _anchors(only=None):
    """Anchor hashes: (digest, hash) of all, or (doc_id, digest, at, hash) of those that the broadcast filter lets through."""

    def emit(batches):
        on = np.zeros(PERIOD, bool)
        on[list(COVER)] = True
        for batch in batches:
            for part in chunks(batch, "text"):
                *_, counts, words = _words(part.column("text"))
                first = np.concatenate(([0], np.cumsum(counts)))
                doc = np.repeat(np.arange(len(counts)), counts)
                inner = np.arange(len(words)) - first[doc]
                runs = sequence_hash(words, ANCHOR)
                at = np.flatnonzero((on[inner % PERIOD] & (inner + ANCHOR <= counts[doc]) & (counts[doc] >= WINDOW))[: len(runs)])
                digest = signed(_digests(words, counts))
                if only is None:
                    yield pa.RecordBatch.from_arrays([pa.array(digest[doc[at]]), pa.array(signed(runs[at]))], names=["digest", "hash"])
                else:
                    at = at[passes(runs[at], *only.value)]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc[at])), pa.array(digest[doc[at]]), pa.array(inner[at].astype(np.int32)), pa.array(signed(runs[at]))], names=["doc_id", "digest", "at", "hash"])

    return emit


def _windows(batches):
    """Hashes (128 bits: hash and twin) of the windows that hold an anchor of the row's list."""
    for batch in batches:
        for part in chunks(batch, "text"):
            *_, counts, words = _words(part.column("text"))
            first = np.concatenate(([0], np.cumsum(counts)))
            runs = sequence_hash(words, WINDOW)
            twins = sequence_hash(mix(words ^ U64(0xC2B2AE3D27D4EB4F)), WINDOW)
            lists = part.column("at")
            size = np.diff(np.concatenate(([0], np.cumsum([len(x) for x in lists]))))
            doc = np.repeat(np.arange(len(size)), size)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            mark = np.zeros(len(words) + 1, np.int64)
            low = np.maximum(flat - (PERIOD - 1), 0)
            high = np.minimum(flat, counts[doc] - WINDOW) + 1
            good = high > low
            np.add.at(mark, first[doc[good]] + low[good], 1)
            np.add.at(mark, first[doc[good]] + high[good], -1)
            at = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
            owner = np.searchsorted(first, at, side="right") - 1
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(take), part.column("digest").take(take), pa.array((at - first[owner]).astype(np.int32)), pa.array(signed(runs[at])), pa.array(signed(twins[at]))], names=["doc_id", "digest", "at", "hash", "twin"])


def _covered(starts: list[int], n: int) -> np.ndarray:
    mark = np.zeros(n + 1, np.int64)
    s = np.array(starts, np.int64)
    np.add.at(mark, s, 1)
    np.add.at(mark, np.minimum(s + WINDOW, n), -1)
    return np.cumsum(mark)[:-1] > 0


def _remover(full: bool):
    """full: the kept text itself, else its SHA-256."""

    def remove(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                data, at, starts, ends, counts, _ = _words(part.column("text"))
                raw, first = data.tobytes(), np.concatenate(([0], np.cumsum(counts)))
                gone, kept = [], []
                for k, (n, list_) in enumerate(zip(counts, part.column("at").to_pylist(), strict=True)):
                    out = _covered(list_ or [], n)
                    stay = first[k] + np.flatnonzero(~out)
                    gone.append(int(out.sum()))
                    text = b" ".join([raw[s:e] for s, e in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)])
                    kept.append(text.decode("utf-8", "replace") if full else hashlib.sha256(text).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("digest"), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "digest", "gone", "kept"])

    return remove


def _digester(batches):
    for batch in batches:
        for part in chunks(batch, "text"):
            *_, counts, words = _words(part.column("text"))
            yield part.append_column("digest", pa.array(signed(_digests(words, counts))))


def repeated_windows(docs: DataFrame, info: DataFrame) -> DataFrame:
    """(doc_id, digest, at): starts (word numbers) of the windows to remove, of one document of each word sequence."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text").where("doc_id is not null")
    every = rows.mapInArrow(_anchors(), "digest long, hash long").groupBy("hash").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi"))
    shared = stored(every.where("lo <> hi").select("hash"))
    # few anchors are shared: a filter of bounded size keeps the others from being shuffled again; the join decides
    only = spark.sparkContext.broadcast(key_filter(shared, "hash"))
    spots = rows.mapInArrow(_anchors(only), "doc_id long, digest long, at int, hash long").join(shared, "hash", "left_semi")
    # places in one text, however many rows have its doc_id or repeat it
    spots = spots.groupBy("doc_id", "digest").agg(F.collect_set("at").alias("at"))
    spots = cut(spots.join(info.where("first").select("doc_id", "digest").distinct(), ["doc_id", "digest"]))
    near = texts_of(rows, spots.select("doc_id").distinct()).mapInArrow(_digester, "doc_id long, text string, digest long").join(spots, ["doc_id", "digest"])
    windows = stored(near.select("doc_id", "digest", "text", "at").mapInArrow(_windows, "doc_id long, digest long, at int, hash long, twin long"))
    # cut off before the join, so that Spark can split a window that very many documents share
    least = stored(windows.groupBy("hash", "twin").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("hash", "twin", "least"))
    return windows.join(least, ["hash", "twin"]).where("doc_id > least").select("doc_id", "digest", "at")


def remove_repeats(docs: DataFrame, output: str = "text") -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_words, n_removed and kept_text, or (output="sha256") kept_sha256 of the kept text.

    A word goes if a window that covers it also starts in a document with a smaller doc_id; windows are judged on the input.
    The kept words are joined by one space.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    info = cut(rows.mapInArrow(_summary, "doc_id long, n_words long, digest long, whole_sha256 string"))
    # equal word sequences, by the SHA-256 of their joined words: the least doc_id stands for all, the others go as a whole
    least = cut(info.where("doc_id is not null").groupBy("whole_sha256").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most"))
    own = F.col("doc_id").isNotNull() & (F.col("least").isNull() | (F.col("doc_id") == F.col("least")))
    info = cut(info.join(least, "whole_sha256", "left").withColumn("first", own).drop("least"))
    starts = repeated_windows(rows, info).groupBy("doc_id", "digest").agg(F.collect_set("at").alias("at"))
    copy = F.col("doc_id").isNotNull() & ~F.col("first") & (F.col("n_words") >= WINDOW)
    if output == "text":
        keyed = rows.mapInArrow(_digester, "doc_id long, text string, digest long")
        done = keyed.join(starts, ["doc_id", "digest"], "left").select("doc_id", "digest", "text", "at").mapInArrow(_remover(True), "doc_id long, digest long, gone long, kept string")
        flags = info.select("doc_id", "digest", "n_words", copy.alias("copy")).distinct()
        return (
            done.withColumnRenamed("doc_id", "d").join(flags, F.col("d").eqNullSafe(flags.doc_id) & (done.digest == flags.digest))
            .select(F.col("d").alias("doc_id"), "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(F.col("gone")).alias("n_removed"), F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept")).alias("kept_text"))
        )
    some = cut(starts)
    texts = texts_of(rows.where("doc_id is not null"), some.select("doc_id").distinct()).mapInArrow(_digester, "doc_id long, text string, digest long").join(some, ["doc_id", "digest"])
    done = texts.select("doc_id", "digest", "text", "at").mapInArrow(_remover(False), "doc_id long, digest long, gone long, kept string").dropDuplicates(["doc_id", "digest"])
    out = info.join(done, ["doc_id", "digest"], "left")
    return out.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "whole_sha256")).alias("kept_sha256"),
    )
