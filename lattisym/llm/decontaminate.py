"""Benchmark decontamination by the q-gram lemma.

An occurrence of an item of m characters with at most k = floor(budget * m) edits shares at least
m + 1 - q * (k + 1) of the item's q-grams with the document, all on diagonals that differ by at most k.
Shared q-grams are therefore counted (per distinct place in the item) in diagonal bands of width 2 (k + 1)
that overlap by half; bands that reach the bound are verified by banded alignment of the whole item.

A q-gram that stands in an item at more than FEW places (rows of underscores, repeated words) isn't counted place by place: each band that
it can reach is given all of its places at once, never fewer than it has. Regions of equal characters are verified once. A text
that still gives very many hits is searched in segments that overlap by more than any occurrence, so memory follows the benchmark, not the text.

q is 16, or the largest of 8, 4, 2, 1 for which the bound of a shorter item is positive. Characters are code
points, A-Z lower-cased. The items are broadcast in blocks of at most BLOCK_CHARS characters (a longer item is a block of its own), one
block at a time, so neither the driver nor a task ever holds a larger benchmark as a whole. Each block is one pass over the texts.

Defined cases: null and empty texts and null and empty items match nothing; repeated items each match; a null
item_id is reported as -1; rows that repeat a doc_id are each judged by their own text. Without items or documents nothing matches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, _powers, chunks, mix, stored, text_bytes

BUDGET = 0.05
#: At most so many characters of items are in one broadcast.
BLOCK_CHARS = 4_000_000
SIZES = (16, 8, 4, 2, 1)
#: Places of a q-gram in one item up to which they are counted one by one.
FEW = 4
#: Hits that are listed at once; a text with more is searched in segments.
HITS = 1 << 21


def edits(m: int, budget: float) -> int:
    return int(budget * m + 1e-9)


def gram_size(m: int, budget: float) -> int:
    k = edits(m, budget)
    return next((q for q in SIZES if m + 1 - q * (k + 1) >= 1), 1)


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, A-Z lower-cased, and each text's start."""
    data, at = text_bytes(column)
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    text = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    return np.where((text >= 65) & (text <= 90), text + np.uint32(32), text), heads[at]


def gram_hashes(text: np.ndarray, q: int, sums: np.ndarray | None = None) -> np.ndarray:
    n = len(text) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = sum_of(text) if sums is None else sums
    return mix((sums[q:] - sums[:n]) * _powers(len(text) + 1)[1][:n] + U64(q))


def sum_of(text: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(mix(text.astype(np.uint64) + U64(0x51ED270B)) * _powers(len(text) + 1)[0][: len(text)], out=sums[1:])
    return sums


def best_alignment(item: np.ndarray, region: np.ndarray, most: int, shift: int, width: int) -> int:
    """Least edits between the whole item and any part of the region, up to most + 1.

    Only cells whose diagonal (place in region minus place in item) is in [shift, shift + width) are computed.
    """
    m, n = len(item), len(region)
    far = most + 1
    d = np.arange(width)
    row = np.where((shift + d >= 0) & (shift + d <= n), 0, far)
    for i in range(1, m + 1):
        j = shift + i + d
        inside = (j >= 0) & (j <= n)
        same = np.zeros(width, bool)
        ok = (j >= 1) & (j <= n)
        same[ok] = region[j[ok] - 1] == item[i - 1]
        step = np.where(ok, row + ~same, far)
        step = np.minimum(step, np.append(row[1:] + 1, far))
        step = np.where(inside, np.minimum(step, far), far)
        row = np.minimum(np.minimum.accumulate(step - d) + d, far)
        row = np.where(inside, row, far)
        if row.min() > most:
            return far
    return int(row.min())


def _spread(low: np.ndarray, many: np.ndarray) -> np.ndarray:
    """low[k], low[k] + 1, ... many[k] numbers for each k, one after another."""
    return np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)


class Items:
    """The benchmark's q-grams: for each q the sorted hashes, and for each the items and places that it stands for."""

    def __init__(self, items: list[tuple[int, str]], budget: float):
        self.ids = [i for i, _ in items]
        self.texts = [code_points(pa.array([t]))[0] for _, t in items]
        self.edits = np.array([edits(len(t), budget) for t in self.texts], np.int64)
        self.overlap = max((len(t) + int(k) for t, k in zip(self.texts, self.edits, strict=True)), default=0)
        size = np.array([gram_size(len(t), budget) for t in self.texts], np.int64)
        self.need = np.array([len(t) + 1 - q * (k + 1) for t, q, k in zip(self.texts, size, self.edits, strict=True)], np.int64)
        self.grams = {}
        for q in sorted(set(size.tolist())):
            hs, owner, place = [], [], []
            for x in np.flatnonzero(size == q):
                h = gram_hashes(self.texts[x], q)
                hs.append(h)
                owner.append(np.full(len(h), x))
                place.append(np.arange(len(h)))
            h, owner, place = np.concatenate(hs), np.concatenate(owner), np.concatenate(place)
            order = np.lexsort((place, owner, h))
            h, owner, place = h[order], owner[order], place[order]
            # the places of one gram in one item are a group: first and last place, and how many
            new = np.concatenate(([True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])))[: len(h)]
            head = np.flatnonzero(new)
            n = np.diff(np.append(head, len(h)))
            tail = head + n - 1
            few = np.repeat(n <= FEW, n)
            heavy = n > FEW
            seen = np.zeros(1 << 22, bool)
            seen[h >> U64(42)] = True
            self.grams[q] = (seen, (h[few], owner[few], place[few]), (h[head][heavy], owner[head][heavy], place[head][heavy], place[tail][heavy], n[heavy]))

    def _hits(self, known: np.ndarray, h: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the text whose gram is known, the first entry of each, and how many entries."""
        if not len(known):
            return where[:0], where[:0], where[:0]
        lo = np.searchsorted(known, h[where])
        hit = known[np.minimum(lo, len(known) - 1)] == h[where]
        where, lo = where[hit], lo[hit]
        return where, lo, np.searchsorted(known, h[where], side="right") - lo

    def regions(self, text: np.ndarray, at: np.ndarray, most: int | None = None) -> list[tuple[int, int, int]] | None:
        """(text, item, band) whose count of shared q-grams reaches the bound; None if that would list more than `most` hits."""
        found = []
        sums = sum_of(text)
        for q, (seen, light, heavy) in self.grams.items():
            h = gram_hashes(text, q, sums)
            where = np.flatnonzero(seen[h >> U64(42)])
            doc = np.searchsorted(at, where, side="right") - 1
            where = where[where + q <= at[doc + 1]]
            keys = []  # (text, item, band, what is counted once, how much it counts)
            w, lo, many = self._hits(light[0], h, where)
            if most is not None and many.sum() > most:
                return None
            doc = np.repeat(np.searchsorted(at, w, side="right") - 1, many)
            take, w = _spread(lo, many), np.repeat(w, many)
            item, inner = light[1][take], light[2][take]
            band = (w - at[doc] - inner) // (self.edits[item] + 1)
            # each hit counts in the two bands that its diagonal lies in
            for shift in (0, 1):
                keys.append(np.stack((doc, item, band - shift, inner, np.ones_like(inner))))
            w, lo, many = self._hits(heavy[0], h, where)
            if len(w):
                if most is not None and many.sum() > 16 * most:
                    return None
                doc = np.repeat(np.searchsorted(at, w, side="right") - 1, many)
                take, w = _spread(lo, many), np.repeat(w, many)
                step = self.edits[heavy[1][take]] + 1
                cell = np.unique(np.stack((doc, take, (w - at[doc]) // step)), axis=1)
                doc, take, cell = cell
                item = heavy[1][take]
                step = self.edits[item] + 1
                first = (cell * step - heavy[3][take]) // step - 1
                last = (cell * step + step - 1 - heavy[2][take]) // step
                many = last - first + 1
                if most is not None and many.sum() > most:
                    return None
                keys.append(np.stack([*(np.repeat(x, many) for x in (doc, item)), _spread(first, many), np.repeat(-1 - take, many), np.repeat(heavy[4][take], many)]))
            key = np.concatenate(keys, axis=1)
            if not key.shape[1]:
                continue
            key = key[:, np.lexsort(key[3::-1])]
            once = np.concatenate(([True], np.any(key[:4, 1:] != key[:4, :-1], axis=0)))
            key = key[:, once]
            first = np.flatnonzero(np.concatenate(([True], np.any(key[:3, 1:] != key[:3, :-1], axis=0))))
            count = np.add.reduceat(key[4], first)
            good = first[count >= self.need[key[1, first]]]
            found += map(tuple, key[:3, good].T.tolist())
        return found

    def occurs(self, text: np.ndarray, item: int, band: int, known: dict) -> bool:
        """Whether an occurrence of the item within its edit budget starts in the band. `known` keeps verdicts by item and region."""
        target, k = self.texts[item], int(self.edits[item])
        low = band * (k + 1)
        start = max(0, low - k)
        region = text[start : max(0, low + 3 * (k + 1) + len(target))]
        key = item, low - start, hashlib.blake2b(region.tobytes(), digest_size=16).digest()
        if key not in known:
            known[key] = self._occurs(target, region, k, low - start)
        return known[key]

    def _occurs(self, target: np.ndarray, region: np.ndarray, k: int, shift: int) -> bool:
        if k == 0 or target.tobytes() in region.tobytes():
            places = np.lib.stride_tricks.sliding_window_view(region, len(target)) if len(region) >= len(target) else np.zeros((0, len(target)), np.uint32)
            if bool((places == target).all(axis=1).any()):
                return True
        return k > 0 and best_alignment(target, region, k, shift - k, 4 * k + 2) <= k

    def search(self, text: np.ndarray, at: np.ndarray) -> list[set[int]]:
        """Numbers of the items that occur in each text (its characters from at[k] to at[k + 1])."""
        found: list[set[int]] = [set() for _ in range(len(at) - 1)]
        known: dict = {}
        # a part: whole texts, or a segment of one; those with too many hits are divided
        parts = [(0, len(at) - 1, 0, len(text))] if self.ids else []
        while parts:
            a, b, s, e = parts.pop()
            edge = at[a : b + 1] - s if b - a > 1 else np.array([0, e - s])
            smallest = b - a == 1 and e - s <= 4 * self.overlap
            regions = self.regions(text[s:e], edge, None if smallest else HITS)
            if regions is None:
                if b - a > 1:
                    half = (a + b) // 2
                    parts += [(a, half, at[a], at[half]), (half, b, at[half], at[b])]
                else:
                    half = (s + e) // 2
                    parts += [(a, b, s, half + self.overlap), (a, b, half, e)]
                continue
            for doc, item, band in regions:
                if item not in found[a + doc] and self.occurs(text[s + edge[doc] : s + edge[doc + 1]], item, band, known):
                    found[a + doc].add(item)
        return found


def _matcher(shared, budget: float):
    def match(batches):
        bench = Items(shared.value, budget)
        for batch in batches:
            for part in chunks(batch, "text", 1 << 19):
                hits = bench.search(*code_points(part.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k, c in enumerate(part.schema.names) if c != "text"), pa.array([sorted({bench.ids[x] for x in found}) for found in hits], pa.list_(pa.int64()))],
                    names=[*(c for c in part.schema.names if c != "text"), "items"],
                )

    return match


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """The items in blocks of bounded size, and whether a block is the last; the driver holds two blocks at a time, never documents. One empty block if there are none."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item_id"), F.col("text").cast("string").alias("text")).where("length(text) > 0")
    block: list[tuple[int, str]] = []
    size = 0
    for x in rows.orderBy("item_id", "text").toLocalIterator():
        if size + len(x.text) > block_chars and block:
            yield block, False
            block, size = [], 0
        block.append((x.item_id, x.text))
        size += len(x.text)
    yield block, True


def contamination(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per row of docs: doc_id, n_items, items (sorted ids of the items that occur in it), contaminated."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    share, every = docs.sparkSession.sparkContext.broadcast, None
    for block, last in item_blocks(benchmark, block_chars):
        if last and every is None:
            out = rows.mapInArrow(_matcher(share(block), budget), "doc_id long, items array<long>")
            break
        if every is None:  # rows are numbered once; a row's answers, one per block, meet again by its number
            rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
        part = stored(rows.mapInArrow(_matcher(share(block), budget), "doc_id long, row long, items array<long>"))
        every = part if every is None else every.unionByName(part)
    else:
        out = every.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return out.select("doc_id", F.size("items").cast("long").alias("n_items"), "items", (F.size("items") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, all columns, in which no item occurs. One pass over the texts per block of items, no shuffle."""

    def keep(shared):
        def run(batches):
            bench = Items(shared.value, budget)
            for batch in batches:
                slim = pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index("text"))], names=["text"])
                clean = [not x for part in chunks(slim, "text", 1 << 19) for x in bench.search(*code_points(part.column("text")))]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    out = docs
    for block, last in item_blocks(benchmark, block_chars):
        out = out.mapInArrow(keep(docs.sparkSession.sparkContext.broadcast(block)), docs.schema)
        out = out if last else stored(out)
    return out
