"""Shared pieces of the corpus operators: byte-level word scanning, hashing, checkpoints.

Everything here works on whole Arrow batches with numpy: the UTF-8 bytes of many texts are
scanned at once, so Python touches a text only where an operator really needs its characters.
"""

from __future__ import annotations

import hashlib
import sys
import tempfile
import types
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; a longer single text is a step of its own.
CHUNK_BYTES = 1 << 20

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * U64(0xD1342543DE82EF95))


def cache() -> dict:
    """State of this Python process that outlives a task. Functions are shipped by value, so it lives in a module of its own that each process makes at first use."""
    name = "lattisym_worker_state"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name, "Tables that a Python worker keeps between tasks.")
    return sys.modules[name].__dict__.setdefault("kept", {})


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    got = cache().get("powers")
    if got is None or len(got[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        out = []
        for base in (_BASE, _BASE_INV):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        got = (out[0], out[1])
        if size <= 8 * CHUNK_BYTES:
            cache()["powers"] = got
    return got[0][:n], got[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums of the bytes, modulo 2**64, for runs of a short fixed length."""
    power, _ = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    values = _byte_values()[data]
    values *= power[: len(data)]
    np.cumsum(values, out=sums[1:])
    return sums


#: Spans of more bytes than this are hashed one by one.
LONG_SPAN = 256


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes: eight bytes at a time, mixed after each, so no pair of spans collides by construction (as it can in a polynomial modulo 2**64)."""
    size = ends - starts
    out = mix(size.astype(np.uint64) * U64(0xD1342543DE82EF95) + U64(1))
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    left = np.flatnonzero(size <= LONG_SPAN)
    at, rest = starts[left], size[left]
    while len(left):
        block = eight[at]
        short = rest < 8
        block[short] &= (U64(1) << (rest[short].astype(np.uint64) * U64(8))) - U64(1)
        out[left] = mix((out[left] ^ block) * U64(0x9FB21C651E98DF25) + U64(0x2545F4914F6CDD1D))
        more = rest > 8
        left, at, rest = left[more], at[more] + 8, rest[more] - 8
    for k in np.flatnonzero(size > LONG_SPAN):
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8).digest(), "little")
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts of a string column, one after another, and each text's start (one more at the end). A null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(where, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES):
    """Slices of the batch whose texts have about `limit` bytes; no text is ever cut."""
    _, at = text_bytes(batch.column(column))
    n, first = batch.num_rows, 0
    while first < n:
        last = int(np.searchsorted(at, at[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield batch.slice(first, last - first)
        first = last


def is_word_byte(data: np.ndarray) -> np.ndarray:
    return ~((data == 32) | ((data >= 9) & (data <= 13)))


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (bytes) of every run of `[^\\x20\\x09-\\x0D]` inside one text, and how many each text has."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at) - 1, np.int64)
    word = is_word_byte(data)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    cut = at[:-1][at[:-1] < at[1:]]
    before[cut] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    after[cut[1:] - 1] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    edges = np.searchsorted(starts, at)
    return starts, ends, np.diff(edges)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def sequence_hash(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every `length` consecutive word hashes (across text ends too; the caller masks those)."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if length <= 8:
        out = words[:n].copy()
        for k in range(1, length):
            out = mix(out * U64(0x9FB21C651E98DF25) + words[k : k + n])
        return mix(out)
    power, inverse = _powers(len(words) + 1)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * power[: len(words)], out=sums[1:])
    return mix((sums[length:] - sums[:n]) * inverse[:n] + U64(length))


def shingle_sets(column: pa.Array, width: int, lower: bool = True) -> list[np.ndarray]:
    """Sorted distinct hashes of the `width`-word shingles of each text; fewer words make one shingle, no words none."""
    data, at = text_bytes(column)
    starts, ends, counts = word_spans(data, at)
    if lower:
        data = lower_ascii(data)
    words = span_hash(data, starts, ends)
    grams = sequence_hash(words, width)
    first = np.concatenate(([0], np.cumsum(counts)))
    out = []
    for k, n in enumerate(counts):
        s = first[k]
        if n >= width:
            out.append(np.unique(grams[s : s + n - width + 1]))
        elif n:
            short = words[s : s + 1]
            for x in words[s + 1 : s + n]:
                short = mix(short * U64(0x9FB21C651E98DF25) + x)
            out.append(mix(short ^ U64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a temporary one, on a single machine only."""
    sc = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or cache().get("own_dir")
    if not place:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        place = cache()["own_dir"] = "file://" + tempfile.mkdtemp(prefix="lattisym-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(place)
    return place


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a checkpoint in the shared folder: survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows and bytes of a batch that goes to Python. Texts are long: Spark's default of 10,000 rows can be hundreds of megabytes.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def bound_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once, unless the session says otherwise."""
    for key, value in BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def affordable(ids: np.ndarray, sizes: np.ndarray, most: int) -> list[int]:
    """The ids that come first by a hash, up to the first with which the sizes exceed `most` together."""
    order = np.argsort(mix(ids.astype(np.int64).view(np.uint64)), kind="stable")
    return ids[order][np.cumsum(sizes[order]) <= most].tolist()


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage with a compressed table in the shared folder: for large intermediate results, which a checkpoint would write uncompressed."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


#: A key filter has at most so many bits (32 MB when broadcast), whatever the input; with more keys it only lets more through.
FILTER_BITS = 1 << 28


def key_filter(keys: DataFrame, column: str) -> tuple[int, np.ndarray]:
    """(bits, words) of a one-hash Bloom filter of the long column. Bits are set in Spark; the driver gets one row per 64 bits, of a bounded number."""
    n = keys.count()
    bits = 1 << min(FILTER_BITS.bit_length() - 1, max(16, (16 * n).bit_length()))
    at = F.col(column).bitwiseAND(F.lit(bits - 1))
    rows = keys.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    found = rows.toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[found.column("w").to_numpy()] = found.column("b").to_numpy()
    return bits, words.view(np.uint64)


def passes(keys: np.ndarray, bits: int, words: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter."""
    return (words[(keys & U64(bits - 1)) >> U64(6)] >> (keys & U64(63))) & U64(1) == 1


def _chooser(only, keep):
    def choose(batches):
        bits, words = only.value
        for batch in batches:
            ids = batch.column(batch.schema.names.index("doc_id")).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            yield batch.filter(pa.array(passes(ids, bits, words) == keep))

    return choose


def texts_of(texts: DataFrame, ids: DataFrame, keep: bool = True) -> DataFrame:
    """The rows of texts(doc_id, text) whose doc_id may be in ids(doc_id): a filter of bounded size, applied where texts are read, so that few are shuffled by the join that decides; without keep all others. No null doc_ids."""
    only = texts.sparkSession.sparkContext.broadcast(key_filter(ids, "doc_id"))
    return texts.mapInArrow(_chooser(only, keep), texts.schema)
