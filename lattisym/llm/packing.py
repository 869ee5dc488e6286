"""Packing token sequences by best-fit decreasing.

A document is the ids of its whole text and an end id (0). Documents longer than a window are first cut into full
windows, each a sequence of its own; what remains of every document is packed, longest first, into the open window
with the least room that still holds it. A segment tree over remaining capacities finds that window in log(window) steps.

Remainders are dealt by a hash of their row number into groups of about GROUP pieces, each packed by one task, so the
work is spread evenly whatever the documents are, and a group's few last windows are all the padding there is. Only
numbers are shuffled, never ids or texts.

Tokens are those that the `tokenizers` library gives with `add_special_tokens=False` for a public tokenizer file (a JSON with byte-level BPE):
the string of an added token in a text becomes its one id. The file's ranks are loaded into the faster `tiktoken` engine, which gives the same
ids (property tests compare them); texts that its regular expressions give up on, with very long runs of white space, go to `tokenizers` itself.

Defined cases: a null or empty text is the end id alone; repeated rows are each packed; a null doc_id stays null.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cache, chunks, cut

WINDOW, GROUP, END = 1024, 20_000, 0


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 for itself, the others from U+0100 on in byte order."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


def load_ranks(text: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Token bytes and ids of a `tokenizers` JSON file; its added tokens and their ids."""
    model = json.loads(text)
    added = {x["content"]: x["id"] for x in model.get("added_tokens", ())}
    table = byte_characters()
    return {bytes(table[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in added}, added


def encoder(name: str, text: str, pattern: str):
    """A function from a text to its ids."""
    found = cache().get(("encoder", name))
    if found is None:
        import tiktoken
        from tokenizers import Tokenizer

        ranks, added = load_ranks(text)
        engine, library = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens=added), []

        def found(x: str) -> list[int]:
            try:
                return engine.encode(x, allowed_special="all")
            except ValueError:  # its regular expressions keep a place for each character of a run of white space, up to a limit
                if not library:
                    library.append(Tokenizer.from_str(text))
                return library[0].encode(x, add_special_tokens=False).ids

        cache()[("encoder", name)] = found
    return found


def _cutter(shared, pattern: str, window: int):
    def pieces(batches):
        name, text = shared.value
        encode = encoder(name, text, pattern)
        for batch in batches:
            for part in chunks(batch, "text"):
                owner, start, length, crc, total = [], [], [], [], []
                for k, x in enumerate(part.column("text").to_pylist()):
                    ids = np.array([*encode(x or ""), END], dtype="<u4")
                    raw, n = ids.tobytes(), len(ids)
                    for s in range(0, n, window):
                        e = min(n, s + window)
                        owner.append(k)
                        start.append(s)
                        length.append(e - s)
                        crc.append(zlib.crc32(raw[4 * s : 4 * e]))
                        total.append(n)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(owner, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )

    return pieces


class RoomTree:
    """Counts of open windows by remaining capacity; finds the least capacity of at least a given size."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, change: int) -> None:
        k = room + self.size
        while k:
            self.count[k] += change
            k >>= 1

    def tightest(self, need: int) -> int:
        """The least room >= need of an open window, or -1."""
        k, count = need + self.size, self.count
        if count[k]:
            return need
        while k > 1:
            if not k & 1 and count[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if count[2 * k] else 2 * k + 1
                return k - self.size
            k >>= 1
        return -1


def best_fit(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """Window number and offset of each piece, in the given (decreasing) order."""
    tree, open_ = RoomTree(window), [[] for _ in range(window + 1)]
    made, where, offset = 0, [], []
    for n in lengths:
        room = tree.tightest(n)
        if room < 0:
            w, room = made, window
            made += 1
        else:
            w = open_[room].pop()
            tree.add(room, -1)
        where.append(w)
        offset.append(window - room)
        if room > n:
            open_[room - n].append(w)
            tree.add(room - n, 1)
    return where, offset


def _packer(window: int):
    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("row", "ascending")])
        where, offset = best_fit(group.column("length").to_pylist(), window)
        base = group.column("bucket")[0].as_py() << 32
        # odd ids: even ones are full windows
        sequence = pa.array([2 * (base + w) + 1 for w in where], pa.int64())
        return group.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"]).append_column("sequence_id", sequence).append_column("offset", pa.array(offset, pa.int64()))

    return pack


def pack(docs: DataFrame, tokenizer: str, pattern: str, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """Per piece of docs(doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. `tokenizer` is the path of a file on the driver."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        text = f.read()  # one vocabulary: of fixed size, whatever the input
    shared = spark.sparkContext.broadcast((f"{tokenizer}:{zlib.crc32(text.encode())}", text))
    columns = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = cut(rows.mapInArrow(_cutter(shared, pattern, window), columns).withColumn("row", F.monotonically_increasing_id()))
    full = pieces.where(F.col("length") == window).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (2 * F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < window)
    buckets = max(1, -(-rest.count() // group))
    rest = rest.withColumn("bucket", F.expr(f"pmod(xxhash64(row), {buckets}L)"))
    packed = rest.groupBy("bucket").applyInArrow(_packer(window), columns + ", sequence_id long, offset long")
    return full.unionByName(packed)
