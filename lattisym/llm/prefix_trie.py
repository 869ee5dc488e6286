"""Prefix trie of conversations: equal beginnings are one node, whatever number of conversations share them.

Turns are identified by the SHA-256 of role and text, computed where the text is read; texts aren't shuffled. Rows are sorted by conversation and turn in ranges, so that a
conversation with a third of all rows is cut into many ranges; numpy scans each range into polynomial prefix fingerprints modulo two primes of 31 bits,
and what one conversation brings from one range to the next (a count and two sums, a row or two per range) is added afterwards.

Conversations are then rebuilt (`splice`): a conversation begins with the first turns of the first conversation of its block. As fingerprints are sums, the rebuilt
ones follow from those of the parts, without another scan.

Rows of equal depth and fingerprint are candidates for one node. Each candidate is verified turn by turn against its representative, the least conversation: its
turn must have the same SHA-256, and the node before must be the same, which covers all turns before by induction. Where that fails two beginnings have collided, and
what differs from the representative is split off, with all that follows it, until everything holds.

The rollup to the parents needs no walk by levels, so deep conversations cost no rounds. Each node's cost belongs to its representative, and each leaf to its own. A conversation that
represents a node represents all deeper nodes on its way, so the sum over a subtree is that of its members' totals less what the representative
has above the node: one sum per node, and one running sum along each representative.

Defined cases: a null role or text is empty; null turns come first; rows of equal turns are ordered by role, the first 32 characters of the text and the SHA-256; rows that repeat are
turns of their own; rows without conv_id belong to no conversation and are left out; an empty table has no nodes, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, stored, text_bytes

#: Primes of the fingerprints. Their product bounds how many are told apart before verification.
MODULI = ((1 << 31) - 1, (1 << 31) - 19)
_SEEDS = (1_181_783_497, 914_723_761)
#: Conversations of a block share the beginning of the first; of so many lengths at most (0 to MOST - 1).
BLOCK, MOST = 100, 6
#: Rows of a running sum, and bytes of the ids that one step hashes.
RUN, PIECE = 1 << 16, 1 << 20

_WORDS = ("w0", "w1", "w2", "w3")
_SCANNED = "conv_id long, part int, first boolean, pos long, w0 long, w1 long, w2 long, w3 long, n_chars long, s0 long, s1 long, e0 long, e1 long"


def bases(moduli: tuple[int, int]) -> tuple[int, int]:
    return tuple(2 + seed % (p - 2) for seed, p in zip(_SEEDS, moduli, strict=True))


def _power(base: int, exponents: np.ndarray, p: int) -> np.ndarray:
    """base ** exponents modulo p, by squaring."""
    out, square, e = np.ones(len(exponents), np.uint64), base % p, exponents.copy()
    while len(e) and e.max() > 0:
        out[e & 1 == 1] = out[e & 1 == 1] * np.uint64(square) % np.uint64(p)
        square, e = square * square % p, e >> 1
    return out


def _scanner(moduli: tuple[int, int]):
    both = tuple(zip(moduli, bases(moduli), strict=True))

    def scan(batches):
        """Places and fingerprints of rows sorted by conversation, counted from the first row of the partition."""
        from pyspark import TaskContext

        part, opening = TaskContext.get().partitionId(), None
        last, count, sums = None, 0, [0, 0]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids = batch.column("conv_id").to_numpy(zero_copy_only=False)
            opening = ids[0] if opening is None else opening
            turn = np.ascontiguousarray(text_bytes(batch.column("turn_hash"))[0].reshape(n, 32)).view(">u8").astype(np.uint64)
            start = np.concatenate(([True], ids[1:] != ids[:-1]))
            at = np.maximum.accumulate(np.where(start, np.arange(n), 0))
            goes_on = (at == 0) & (ids[0] == last)
            pos = np.arange(n) - at + np.where(goes_on, count, 0)
            columns = []
            for k, (p, base) in enumerate(both):
                step = turn[:, k] % np.uint64(p) * _power(base, pos + 1, p) % np.uint64(p)
                total = np.cumsum(step, dtype=np.uint64)
                s = (total - (total - step)[at] + np.where(goes_on, np.uint64(sums[k]), np.uint64(0))) % np.uint64(p)
                columns.append((s, (s + np.uint64(p) - step) % np.uint64(p)))
                sums[k] = int(s[-1])
            last, count = ids[-1], int(pos[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"), pa.array(np.full(n, part, np.int32)), pa.array(ids == opening), pa.array(pos.astype(np.int64)),
                    *(pa.array(np.ascontiguousarray(turn[:, j]).view(np.int64)) for j in range(4)), batch.column("n_chars"),
                    *(pa.array(x.astype(np.int64)) for pair in zip(*columns, strict=True) for x in pair),
                ],
                names=[x.split()[0] for x in _SCANNED.split(", ")],
            )

    return scan


def turns(conversations: DataFrame, moduli: tuple[int, int] = MODULI) -> DataFrame:
    """Per turn: conv_id, pos (from 0), w0 to w3 (the SHA-256), n_chars, and the fingerprints with it (s0, s1) and before it (e0, e1)."""
    spark = conversations.sparkSession
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).where("conv_id is not null")
    named = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    # the last key tells equal rows apart, so that any number of them can be cut into ranges
    rows = rows.select("conv_id", "turn", "role", F.substring("text", 1, 32).alias("head"), named.alias("turn_hash"), F.length("text").cast("long").alias("n_chars"), F.monotonically_increasing_id().alias("row"))
    order = ("conv_id", "turn", "role", "head", "turn_hash", "row")
    scanned = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn_hash", "n_chars").mapInArrow(_scanner(moduli), _SCANNED))
    # a conversation that goes on from the range before is the first of its range: a row or two per range
    crossing = scanned.join(F.broadcast(scanned.where("first").select("conv_id").distinct()), "conv_id", "left_semi")
    ends = crossing.groupBy("conv_id", "part").agg(F.max(F.struct("pos", "s0", "s1")).alias("x")).select("conv_id", "part", "x.*").collect()
    carry, last, count, sums = [], None, 0, [0, 0]
    for x in sorted(ends, key=lambda x: (x.conv_id, x.part)):
        if x.conv_id != last:
            last, count, sums = x.conv_id, 0, [0, 0]
        weight = [pow(b, count, p) for p, b in zip(moduli, bases(moduli), strict=True)]
        if count:
            carry.append((x.conv_id, x.part, count, *sums, *weight))
        sums = [(s + w * y) % p for s, w, y, p in zip(sums, weight, (x.s0, x.s1), moduli, strict=True)]
        count += x.pos + 1
    rows = scanned.select("conv_id", "part", "pos", *_WORDS, "n_chars", "s0", "s1", "e0", "e1")
    if carry:
        more = spark.createDataFrame(carry, "conv_id long, part int, before long, c0 long, c1 long, m0 long, m1 long")
        later = lambda k, x: ((F.coalesce(f"c{k}", F.lit(0)) + F.coalesce(f"m{k}", F.lit(1)) * F.col(f"{x}{k}")) % moduli[k]).alias(f"{x}{k}")
        rows = rows.join(F.broadcast(more), ["conv_id", "part"], "left").select("conv_id", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), *_WORDS, "n_chars", *(later(k, x) for x in "se" for k in (0, 1)))
    return rows.drop("part")


def _joined(a, b):
    """One number of the two fingerprints."""
    return F.shiftleft(a, 31).bitwiseOR(b)


def splice(rows: DataFrame, moduli: tuple[int, int] = MODULI, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """Rebuilt conversations: the first h turns of conversation c - c % block, then c's own without its first h; h is crc32(c) % most.

    Per turn and for the root (depth 0): conv_id, depth, fp, parent (fingerprints), w0 to w3, n_chars, last (whether the conversation ends there).
    """
    fields = ("pos", *_WORDS, "n_chars", "s0", "s1", "e0", "e1")
    # at most `most` - 1 turns of a conversation are kept here
    heads = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("pos") < most - 1, F.struct(*fields)))).alias("heads"))
    heads = cut(heads.withColumn("h", F.expr(f"cast(crc32(cast(conv_id as string)) % {most} as int)")))
    first = heads.select(F.col("conv_id").alias("base"), F.col("heads").alias("opening"))
    info = heads.withColumn("base", F.col("conv_id") - F.col("conv_id") % block).join(first, "base", "left").withColumn("opening", F.slice(F.coalesce("opening", F.array().cast(first.schema["opening"].dataType)), F.lit(1), F.col("h")))
    info = info.withColumn("k", F.size("opening")).withColumn("length", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    ending = lambda turns, n, s: F.when(F.col(n) > 0, F.try_element_at(turns, F.col(n))[s]).otherwise(F.lit(0))
    skipped, begun = ([ending(F.col(c), n, f"s{j}").alias(f"{name}{j}") for j in (0, 1)] for c, n, name in (("heads", "h", "skip"), ("opening", "k", "open")))
    info = cut(info.select("conv_id", "h", "k", "length", "opening", *skipped, *begun))
    root = info.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("fp"), F.lit(-1).cast("long").alias("parent"), *(F.lit(0).cast("long").alias(w) for w in _WORDS), F.lit(0).cast("long").alias("n_chars"), (F.col("length") == 0).alias("last"))
    shared = info.select("conv_id", "length", F.explode("opening").alias("x")).select("conv_id", (F.col("x.pos") + 1).alias("depth"), _joined(F.col("x.s0"), F.col("x.s1")).alias("fp"), _joined(F.col("x.e0"), F.col("x.e1")).alias("parent"), *(f"x.{w}" for w in _WORDS), "x.n_chars", (F.col("x.pos") + 1 == F.col("length")).alias("last"))
    shift = [F.element_at(F.array(*(F.lit(pow(b, -j, p)) for j in range(most))), F.col("h") - F.col("k") + 1) for p, b in zip(moduli, bases(moduli), strict=True)]

    def moved(x: str, j: int):
        p = moduli[j]
        return (F.col(f"open{j}") + shift[j] * F.pmod(F.col(f"{x}{j}") - F.col(f"skip{j}"), F.lit(p))) % p

    depth = F.col("pos") - F.col("h") + F.col("k") + 1
    own = rows.join(info.drop("opening"), "conv_id").where("pos >= h").select("conv_id", depth.alias("depth"), _joined(moved("s", 0), moved("s", 1)).alias("fp"), _joined(moved("e", 0), moved("e", 1)).alias("parent"), *_WORDS, "n_chars", (depth == F.col("length")).alias("last"))
    return stored(root.unionByName(shared).unionByName(own))


_SAME = ("parent", *_WORDS)


def _groups(members: DataFrame) -> DataFrame:
    """One row per depth and fingerprint; lo_ and hi_ of what must be equal."""
    sure = [f(c).alias(f"{name}_{c}") for c in _SAME for f, name in ((F.min, "lo"), (F.max, "hi"))]
    return cut(members.groupBy("depth", "fp").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.max("n_chars").alias("n_chars"), F.count_if("last").alias("n_ends"), F.min(F.when(F.col("last"), F.col("conv_id"))).alias("one_end"), *sure))


def _split(members: DataFrame, doubtful: DataFrame) -> DataFrame:
    """The members of doubtful(depth, fp, conv_id) whose turn or node before isn't that of the representative get fingerprints of their own from there on."""
    suspects = members.join(doubtful.withColumnRenamed("conv_id", "rep"), ["depth", "fp"])
    own = suspects.where("conv_id = rep").select("depth", "fp", *(F.col(c).alias(f"rep_{c}") for c in _SAME))
    differs = ~F.expr(" and ".join(f"{c} = rep_{c}" for c in _SAME))
    moves = suspects.join(own, ["depth", "fp"]).where(differs).groupBy("conv_id").agg(F.min(F.struct("depth", "fp", *_SAME)).alias("x"))
    moves = moves.select("conv_id", F.col("x.depth").alias("since"), F.xxhash64("x").alias("salt"))
    new = lambda c, when: F.when(when, F.xxhash64(c, "salt")).otherwise(F.col(c)).alias(c)
    here, below = (F.coalesce(x, F.lit(False)) for x in (F.col("depth") >= F.col("since"), F.col("depth") > F.col("since")))
    return stored(members.join(moves, "conv_id", "left").select("conv_id", "depth", new("fp", here), new("parent", below), *_WORDS, "n_chars", "last"))


def _id_pieces(batches):
    """Ids of equal (depth, fp), sorted, as comma-joined pieces of bounded size."""
    key, first, kept, size = None, 0, [], 0
    rows: list[tuple] = []

    def flush():
        nonlocal kept, size
        if kept:
            rows.append((*key, first, ",".join(kept)))
            kept, size = [], 0

    def out():
        nonlocal rows
        done, rows = rows, []
        return pa.RecordBatch.from_arrays([pa.array(x, pa.string() if i == 3 else pa.int64()) for i, x in enumerate(zip(*done, strict=True))], names=["depth", "fp", "first", "ids"])

    for batch in batches:
        for depth, fp, conv in zip(*(batch.column(c).to_pylist() for c in ("depth", "fp", "conv_id")), strict=True):
            if (depth, fp) != key or size > PIECE:
                flush()
                key, first = (depth, fp), conv
            kept.append(str(conv))
            size += 12
        if rows:
            yield out()
    flush()
    if rows:
        yield out()


def _hash_pieces(batches):
    """SHA-256 of the joined pieces of each (depth, fp), taken in order, a piece at a time."""
    key, digest = None, None
    for batch in batches:
        done = []
        for depth, fp, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "fp", "ids")), strict=True):
            if (depth, fp) == key:
                digest.update(b"," + ids.encode())
            else:
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = (depth, fp), hashlib.sha256(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["depth", "fp", "ends"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, digest.hexdigest())], names=["depth", "fp", "ends"])


def ends(members: DataFrame, groups: DataFrame) -> DataFrame:
    """depth, fp, ends: SHA-256 of the ascending ids of the conversations that end at a node, for nodes where several do."""
    several = groups.where("n_ends > 1").select("depth", "fp")
    ids = members.where("last").select("depth", "fp", "conv_id").join(several, ["depth", "fp"])
    order = ("depth", "fp", "conv_id")
    pieces = ids.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_id_pieces, "depth long, fp long, first long, ids string")
    # a digest is sequential by nature: a task reads a node's pieces one by one and holds one
    return pieces.repartition("depth", "fp").sortWithinPartitions("depth", "fp", "first").select("depth", "fp", "ids").mapInArrow(_hash_pieces, "depth long, fp long, ends string")


@dataclass
class Trie:
    """nodes: one row per node; members: one row per conversation and node on its way (depth, fp name the node)."""

    nodes: DataFrame
    members: DataFrame


def rollup(members: DataFrame, groups: DataFrame) -> DataFrame:
    """The nodes of verified groups, with their parents and sums over their subtrees."""
    cost = F.when(F.col("depth") > 0, (F.col("n") - 1) * F.col("n_chars")).otherwise(F.lit(0))
    # what a conversation represents: costs, a leaf, and the depth from which it is alone
    own = groups.groupBy("conv_id").agg(F.sum(cost).alias("cost"), F.max((F.col("n_ends") == F.col("n")).cast("long")).alias("leaf"), F.min(F.when(F.col("n") == 1, F.col("depth"))).alias("alone"))
    own = own.where("cost > 0 or leaf > 0")
    below = members.select("conv_id", "depth", "fp").join(own, "conv_id").where("alone is null or depth < alone").groupBy("depth", "fp").agg(F.sum("leaf").alias("leaves"), F.sum("cost").alias("cost"))
    # running costs along each representative, in runs of bounded length
    shared = groups.where("n > 1").select("depth", "fp", "conv_id", cost.alias("cost"), F.floor(F.col("depth") / RUN).alias("run"))
    run = Window.partitionBy("conv_id", "run").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    runs = shared.groupBy("conv_id", "run").agg(F.sum("cost").alias("total"))
    runs = runs.select("conv_id", "run", F.sum("total").over(Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    above = shared.withColumn("above", F.coalesce(F.sum("cost").over(run), F.lit(0))).join(runs, ["conv_id", "run"]).select("depth", "fp", (F.col("above") + F.coalesce("before", F.lit(0))).alias("above"))
    children = groups.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("lo_parent").alias("fp")).agg(F.count("*").alias("children"))
    base = groups.select("depth", "fp", "conv_id", F.col("lo_parent").alias("parent"), *(F.col(f"lo_{w}").alias(w) for w in _WORDS), "n", "n_ends", "one_end")
    every = base
    for more in (below, above, children, ends(members, groups)):
        every = every.unionByName(more, allowMissingColumns=True)
    # every part has at most one row of a node
    keys = ("conv_id", "parent", *_WORDS, "n", "n_ends", "one_end", "leaves", "cost", "above", "children", "ends")
    merged = every.groupBy("depth", "fp").agg(*(F.max(c).alias(c) for c in keys))
    hashes = F.when(F.col("n_ends") == 0, F.sha2(F.lit(""), 256)).when(F.col("n_ends") == 1, F.sha2(F.col("one_end").cast("string"), 256)).otherwise(F.col("ends"))
    nodes = merged.select(
        "depth", "fp", "parent", "conv_id", *_WORDS, F.col("n").alias("n_convs"), F.coalesce("children", F.lit(0)).cast("long").alias("n_children"),
        F.when(F.col("n") == 1, F.lit(1)).otherwise(F.col("leaves")).cast("long").alias("n_leaves"), F.when(F.col("n") == 1, F.lit(0)).otherwise(F.coalesce("cost", F.lit(0)) - F.col("above")).cast("long").alias("saved_tokens"), hashes.alias("ends_sha256"),
    )
    root = groups.where("depth = 0").select("conv_id").first()
    names = groups.where("depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("fp").alias("parent"), F.col("conv_id").alias("parent_conv"))
    found = F.when(F.col("depth") == 1, F.lit(root.conv_id if root else None).cast("long")).otherwise(F.col("parent_conv"))
    return nodes.join(names, ["depth", "parent"], "left").withColumn("parent_conv_id", found).drop("parent_conv")


def build(conversations: DataFrame, moduli: tuple[int, int] = MODULI, block: int = BLOCK, most: int = MOST) -> Trie:
    """The trie of the rebuilt conversations of conversations(conv_id, turn, role, text)."""
    members = splice(turns(conversations, moduli), moduli, block, most)
    while True:
        groups = _groups(members)
        doubtful = groups.where(F.expr(" or ".join(f"lo_{c} <> hi_{c}" for c in _SAME))).select("depth", "fp", "conv_id")
        if doubtful.isEmpty():
            return Trie(rollup(members, groups), members)
        members = _split(members, doubtful)


def prefix_trie(conversations: DataFrame, moduli: tuple[int, int] = MODULI) -> DataFrame:
    """Per node: conv_id (the least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    return build(conversations, moduli).nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def node_texts(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, role, text: each shared turn once. Texts are found by the SHA-256 of their turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    known = conversations.where("conv_id is not null").select(role, text).distinct()
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    of = F.unhex(F.concat(*(F.lpad(F.hex(F.col(w)), 16, "0") for w in _WORDS)))
    return nodes.withColumn("key", of).join(known.withColumn("key", digest), "key").select("conv_id", "depth", "parent_conv_id", "n_convs", "role", "text")
