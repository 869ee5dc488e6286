"""Quality selection by importance resampling (after DSIR, Xie et al., 2023).

Two generative models of hashed n-grams (words and pairs of words, 2**16 buckets) are counted: one over the target text, one over all of
the raw text. A document's weight is the mean log ratio of its n-grams under the two, times SHARPNESS; adding Gumbel noise and
keeping the k largest draws k documents without replacement with probabilities proportional to the weights.

Counts are one number per bucket, combined in each task before they are shuffled. Every wanted document counts: only those whose doc_id passes a
filter of bounded size are counted one by one, and their counts, not their texts, are shuffled to the join that decides. The k-th largest place is found by counting in
ever finer ranges, first of the value, among equal ones of a hash, then of the row number, so no task sorts all rows. Noise comes from a hash of doc_id and text, so a run can be repeated.
The exponent (mean log ratio times SHARPNESS, not the sum over all n-grams) keeps long documents from being certain to be drawn or left.

Defined cases: null and empty texts have the weight 0 of no evidence; a null doc_id is weighed and drawn like others; labels that are null
count for nothing; without target rows every weight is 0 and the draw is even. Rows that repeat have equal values;
exactly k rows are kept: of equal values those with the larger tie (a hash of doc_id and text, then the row's number in the stored table of values).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, chunks, cut, lower_ascii, mix, span_hash, text_bytes, texts_of, word_spans

BUCKETS = 1 << 16
SHARE, SHARPNESS, SMOOTHING = 0.5, 40.0, 50.0


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(text number, bucket) of every word and pair of words, and how many texts there are."""
    data, at = text_bytes(column)
    starts, ends, counts = word_spans(data, at)
    words = span_hash(lower_ascii(data), starts, ends)
    doc = np.repeat(np.arange(len(counts)), counts)
    pairs = mix(words[:-1] * U64(0x9FB21C651E98DF25) + words[1:])
    same = doc[1:] == doc[:-1]
    return np.concatenate((doc, doc[1:][same])), (np.concatenate((words, pairs[same])) >> U64(48)).astype(np.int64), len(counts)


def _bucket_rows(counts: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(counts)
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["bucket", "n"])


def _counter(batches):
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for part in chunks(batch, "text"):
            total += np.bincount(grams(part.column("text"))[1], minlength=BUCKETS)
    yield _bucket_rows(total)


def _single_counter(batches):
    """Per text: its buckets (two bytes each) and their counts (four bytes each)."""
    for batch in batches:
        for part in chunks(batch, "text"):
            doc, bucket, n = grams(part.column("text"))
            found, counts = np.unique(doc * BUCKETS + bucket, return_counts=True)
            edges = np.searchsorted(found, np.arange(n + 1) * BUCKETS)
            at, many = (found % BUCKETS).astype("<u2"), counts.astype("<u4")
            spans = list(zip(edges[:-1], edges[1:], strict=True))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([at[s:e].tobytes() for s, e in spans], pa.binary()), pa.array([many[s:e].tobytes() for s, e in spans], pa.binary())], names=["doc_id", "at", "many"]
            )


def _adder(batches):
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for at, many in zip(batch.column("at"), batch.column("many"), strict=True):
            total[np.frombuffer(at.as_py(), "<u2")] += np.frombuffer(many.as_py(), "<u4")
    yield _bucket_rows(total)


def _collected(parts: DataFrame) -> np.ndarray:
    out = np.zeros(BUCKETS)
    for x in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[x.bucket] = x.n
    return out


def log_ratios(rows: DataFrame, ids: DataFrame) -> np.ndarray:
    """log p_target - log p_raw of each bucket, from rows(doc_id, text) and distinct ids(doc_id) of the target. The driver gets one row per bucket, whatever the input."""
    single = texts_of(rows.where("doc_id is not null"), ids).mapInArrow(_single_counter, "doc_id long, at binary, many binary")
    # one plan at all sizes: ids are as many as the wanted documents, so they're never broadcast
    target = _collected(single.join(ids.hint("merge"), "doc_id").select("at", "many").mapInArrow(_adder, "bucket int, n long"))
    if not target.sum():
        return np.zeros(BUCKETS)
    raw = _collected(rows.select("text").mapInArrow(_counter, "bucket int, n long"))
    # both models get the same prior, in proportion to their size: a bucket of few n-grams says little, so target rows aren't favoured for being known
    share = target.sum() / raw.sum()
    return np.log((target + SMOOTHING * share) / ((raw + SMOOTHING) * share))


def _weigher(ratios: bytes):
    def weigh(batches):
        table = np.frombuffer(ratios)
        for batch in batches:
            for part in chunks(batch, "text"):
                doc, bucket, n = grams(part.column("text"))
                total = np.bincount(doc, weights=table[bucket], minlength=n)
                size = np.bincount(doc, minlength=n)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("noise"), part.column("tie"), pa.array(SHARPNESS * total / np.maximum(size, 1))], names=["doc_id", "noise", "tie", "log_weight"])

    return weigh


def _cutoff(rows: DataFrame, column: str, k: int) -> tuple:
    """(x, larger, equal): the k-th largest x of a column of numbers, how many rows are larger than x and how many equal. By counting in ever finer ranges."""
    low, high, equal = rows.agg(F.min(column), F.max(column), F.count("*")).first()
    above = 0
    while low < high:
        # the least and the largest are never in one range, so ranges shrink; whole numbers are divided as such: doubles couldn't tell neighbours apart
        step = max((high - low) / 4096, 5e-324) if isinstance(low, float) else (high - low) // 4096 + 1
        place = F.floor((F.col(column) - F.lit(low)) / F.lit(step)) if isinstance(low, float) else F.expr(f"cast((cast({column} as decimal(38,0)) - {low}) div {step} as long)")
        inside = rows.where(F.col(column).between(low, high)).groupBy(F.least(place, F.lit(4095)).alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"))
        for x in sorted(inside.collect(), key=lambda x: -x.b):
            if above + x.n >= k:
                low, high, equal = x.lo, x.hi, x.n
                break
            above += x.n
    return low, above, equal


def resample(docs: DataFrame, wanted: DataFrame, share: float = SHARE, seed: int = 7) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, log_weight, value (with noise), kept. wanted(doc_id) names the target documents; share is k over rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = cut(wanted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct())
    ratios = log_ratios(rows, ids).tobytes()
    uniform = (F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    scored = rows.withColumn("noise", -F.log(-F.log(uniform))).withColumn("tie", F.xxhash64("doc_id", "text", F.lit(seed + 1)))
    scored = scored.mapInArrow(_weigher(ratios), "doc_id long, noise double, tie long, log_weight double")
    # rows are numbered once, as they are checkpointed
    scored = cut(scored.select("doc_id", "log_weight", (F.col("log_weight") + F.col("noise")).alias("value"), "tie", F.monotonically_increasing_id().alias("row")))
    k = round(share * scored.count())
    kept, level, open_ = F.lit(False), F.lit(k > 0), scored
    for column in ("value", "tie", "row"):  # one after another: only rows that are equal so far are looked at
        if k <= 0:
            break
        limit, larger, equal = _cutoff(open_, column, k)
        kept = kept | (level & (F.col(column) > F.lit(limit)))
        level = level & (F.col(column) == F.lit(limit))
        open_ = open_.where(F.col(column) == F.lit(limit))
        k -= larger
        if equal == k:
            break
    return scored.select("doc_id", "log_weight", "value", (kept | level).alias("kept"))
