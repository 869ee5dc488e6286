"""Each operator against a plain version on small tables, with nulls, empty and long texts, ties, repeated rows and extra columns."""

import gzip
import hashlib
import heapq
import itertools
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattisym.llm import common, components, decontaminate, fingerprint, html_text, near_dedup, packing, pii, queries, resample, substring, toxicity, warc

SPACE = r"[^\x20\x09-\x0D]+"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, bucket int, key string"


def frame(spark, texts, ids=None):
    """Documents with columns whose names clash with those that operators use."""
    rows = [(k if ids is None else ids[k], t, "en", "s", None if t is None else len(t), "x", 1, "k") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n, size=60):
    return [f"w{rng.randrange(size)}é" if rng.random() < 0.1 else f"w{rng.randrange(size)}" for _ in range(n)]


def corpus(seed=1, n=40):
    """Random texts with exact and near copies, shared passages, nulls, blanks, short and repeated texts."""
    rng = random.Random(seed)
    passage = " ".join(words(rng, 70, 1000))
    out = [None, "", "  \t\n ", "one", "One", "one two", "a\x0bb\x0cc", " x y z"]
    for _ in range(n):
        w = words(rng, rng.choice((3, 20, 60, 150)), 400)
        out.append(" ".join(w))
        if rng.random() < 0.5:
            v = list(w)
            for _ in range(max(1, len(v) // 30)):
                v[rng.randrange(len(v))] = "edit"
            out.append("\n".join(v))
        if rng.random() < 0.3:
            out.append(" ".join(w))
        if rng.random() < 0.3:
            out.append(" ".join(w[: len(w) // 2]) + "  " + passage + "\t" + " ".join(w[len(w) // 2 :]))
    return out


def shingles(text, n):
    w = re.findall(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def linked_components(sets, percent):
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


@settings(max_examples=30, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB1é  \t\x0b\n", max_size=20)), max_size=6))
def test_word_spans(texts):
    data, at = common.text_bytes(pa.array(texts, pa.string()))
    starts, ends, counts = common.word_spans(data, at)
    got = [data[s:e].tobytes().decode() for s, e in zip(starts, ends, strict=True)]
    want = [re.findall(SPACE, t or "") for t in texts]
    assert got == [w for x in want for w in x] and counts.tolist() == [len(x) for x in want]
    seen = {}
    for w, h in zip(got, common.span_hash(data, starts, ends).tolist(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize(("width", "small"), [(2, 32), (2, 1), (5, 32), (5, 0)])
def test_near_duplicates(spark, monkeypatch, width, small):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    texts = corpus(width)
    rng = random.Random(5)
    base = words(rng, 100, 10**6)
    for _ in range(30):  # a crowd of near copies, some alike enough and some not
        v = list(base)
        for _ in range(rng.randrange(1, 22)):
            v[rng.randrange(len(v))] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(v))
    got = {x.doc_id: x for x in near_dedup.near_duplicates(frame(spark, texts), width).collect()}
    sets = {k: shingles(t, width) for k, t in enumerate(texts)}
    want = linked_components(sets, 80)
    assert {k: x.component_id for k, x in got.items()} == want
    assert all(x.n_shingles == len(sets[k]) and x.kept == (want[k] == k) for k, x in got.items())
    kept = near_dedup.deduplicate(frame(spark, texts), width)
    assert kept.columns == frame(spark, [""]).columns and {x.doc_id for x in kept.collect()} == {k for k in want if want[k] == k}


def test_near_duplicates_odd_rows(spark):
    text = "the same few words in every one of these rows"
    df = frame(spark, [text, text, text, None, "other"], [None, 3, 3, 3, None])
    got = sorted((str(x.doc_id), x.n_shingles, str(x.component_id), x.kept) for x in near_dedup.near_duplicates(df, 2).collect())
    assert got == [("3", 0, "3", True), ("3", 9, "3", True), ("3", 9, "3", True), ("None", 1, "None", True), ("None", 9, "None", True)]


def test_near_duplicates_of_a_repeated_id(spark):
    """Two texts under one id: each is linked by its own set."""
    rng = random.Random(6)
    a, b = (" ".join(words(rng, 60, 5000)) for _ in range(2))
    df = frame(spark, [a, b, a + " more", b + " more", "alone"], [5, 5, 7, 8, 9])
    got = {(x.doc_id, x.component_id) for x in near_dedup.near_duplicates(df, 2).collect()}
    assert got == {(5, 5), (7, 5), (8, 5), (9, 9)}


def thue_morse(n):
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_structured_words_are_told_apart(spark):
    """Thue-Morse words collide in polynomial hashes modulo 2**64, whatever the values of bytes."""
    a, b = thue_morse(11)
    x, y = common.shingle_sets(pa.array([a, b]), 2)
    assert x.tolist() != y.tolist()
    filler = " ".join(f"f{k}" for k in range(60))
    df = frame(spark, [a, b, a, f"{a} {filler}", f"{b} {filler}", f"{filler} {a}"])
    assert [x.component_id for x in near_dedup.near_duplicates(df, 2).orderBy("doc_id").collect()][:3] == [0, 1, 0]
    ids = list(range(6))
    want = [(i, n, g) for i, n, g, _ in plain_removal(list(zip(ids, [x.text for x in df.orderBy("doc_id").collect()], strict=True)))]
    assert [(x.doc_id, x.n_words, x.n_removed) for x in substring.remove_repeats(df).orderBy("doc_id").collect()] == want


def test_registers_and_estimates():
    rng = np.random.default_rng(1)
    factors = near_dedup.multipliers(4000)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = near_dedup.registers(x[:2000], factors), near_dedup.registers(x[1000:], factors)
    assert abs(near_dedup.estimate(a[None], b[None])[0] - 1 / 3) < 0.03
    assert near_dedup.estimate(a[None], near_dedup.registers(rng.integers(0, 1 << 63, 2000, dtype=np.uint64), factors)[None])[0] < 0.01


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)] + [(7, 7)]
    got = {x.node: x.component for x in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    sets = linked_components({k: {k} for k in range(341)}, 100)
    for a, b in pairs:
        x, y = sorted((sets[a], sets[b]))
        sets = {k: x if v == y else v for k, v in sets.items()}
    assert got == {k: sets[k] for a, b in pairs for k in (a, b) if a != b}
    assert got == {x.node: x.component for x in components.components(spark.createDataFrame(pairs, "a long, b long"), small=0).collect()}
    for small in (0, 10):
        assert components.components(spark.createDataFrame([], "a long, b long"), small=small).count() == 0


def plain_removal(rows):
    starts = {}
    for i, t in rows:
        w = re.findall(SPACE, t or "")
        for k in range(len(w) - 49):
            q = tuple(w[k : k + 50])
            if i is not None:
                starts[q] = min(starts.get(q, i), i)
    out = []
    for i, t in rows:
        w = re.findall(SPACE, t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if i is not None and starts[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def test_substring_dedup(spark):
    texts = corpus(9, 50)
    ids = list(range(len(texts)))
    texts += [texts[-1], texts[-1], texts[-2], "loop " * 130, "loop " * 130]
    ids += [None, ids[-1], 4, 900, 901]
    want = sorted(map(str, plain_removal(list(zip(ids, texts, strict=True)))))
    df = frame(spark, texts, ids)
    got = substring.remove_repeats(df, "sha256").collect()
    assert sorted((str(x.doc_id), x.n_words, x.n_removed, x.kept_sha256) for x in got) == sorted((i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in ((str(a), *b) for a, *b in plain_removal(list(zip(ids, texts, strict=True)))))
    assert sorted(str((x.doc_id, x.n_words, x.n_removed, x.kept_text)) for x in substring.remove_repeats(df).collect()) == want
    assert {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER} == set(range(substring.PERIOD))
    assert substring.PERIOD - 1 + substring.ANCHOR <= substring.WINDOW


def test_substring_dedup_of_one_doc_id(spark):
    """Many rows of one doc_id, repeated ones among them, cost what they have: anchors are kept per text, not per id."""
    rng = random.Random(5)
    passage = " ".join(words(rng, 60, 1000))
    texts = [" ".join(words(rng, 12, 900)) + f" {passage} " + " ".join(words(rng, 8, 900)) for _ in range(300)]
    texts += texts[:50]
    ids = [7] * 350
    rows = list(zip([*ids, 3, 9], [*texts, passage + " end", "start " + passage], strict=True))
    df = frame(spark, [t for _, t in rows], [i for i, _ in rows])
    got = sorted((x.doc_id, x.n_words, x.n_removed) for x in substring.remove_repeats(df, "sha256").collect())
    assert got == sorted((i, len(t.split()), 0 if i == 3 else 60) for i, t in rows)
    info = spark.createDataFrame([(7, 1, True)], "doc_id long, digest long, first boolean").limit(0)
    assert substring.repeated_windows(df.select("doc_id", "text"), info).count() == 0


def test_fingerprints(spark):
    texts = corpus(4, 30)
    ids = [3 * k - 20 for k in range(len(texts))]
    got = {x.doc_id: x for x in fingerprint.compare_edited(frame(spark, texts, ids)).collect()}
    rows = sorted(zip(ids, (t or "" for t in texts), strict=True))
    for k, (i, t) in enumerate(rows):
        n, after = len(t) // 4, rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - n] + after[:n]
        x = got[i]
        assert x.n_chars == len(t) and x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = (fingerprint.sketches(pa.array([y]))[0] for y in (t, edited, after))
        assert x.fingerprint == fingerprint.text_of(a) and x.near_edited == fingerprint.likeness(a, b) and x.near_next == fingerprint.likeness(a, c)
        size, digest, kept = fingerprint.parse(x.fingerprint)
        assert (size, digest) == a[:2] and kept.tolist() == a[2].tolist()
    whole = fingerprint.sketches(pa.array(["".join(random.Random(1).choices("abcdefgh ", k=40000))]))[0]
    part = fingerprint.sketches(pa.array(["".join(random.Random(1).choices("abcdefgh ", k=4000))]))[0]
    assert fingerprint.containment(part, whole) == 1 and 0.07 < fingerprint.likeness(part, whole) < 0.13
    assert fingerprint.merge(part, whole).tolist() == whole[2].tolist()
    # against plain sets of runs of 12 bytes: exact where the sketch keeps everything, else near the share that a sample gives
    for x, (_, t) in zip((got[i] for i, _ in rows), rows, strict=True):
        raw = t.encode()
        assert fingerprint.parse(x.fingerprint)[0] == len({raw[k : k + 12] for k in range(max(1, len(raw) - 11))} if raw else ())
    rng = random.Random(11)
    for share in (0.1, 0.5, 0.9):
        a = "".join(rng.choices("abcdefgh ", k=60_000))
        b = a[: int(share * 60_000)] + "".join(rng.choices("abcdefgh ", k=60_000 - int(share * 60_000)))
        x, y = ({t[k : k + 12] for k in range(len(t) - 11)} for t in (a, b))
        assert abs(fingerprint.likeness(*fingerprint.sketches(pa.array([a, b]))) - len(x & y) / len(x | y)) < 0.04
    one = fingerprint.compare_edited(frame(spark, ["abcdefgh"])).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()


def test_neighbours_of_many_hot_keys(spark):
    """Many ids on very many rows each, some next to each other: a small table, not a condition for each; buckets follow the rows alone."""
    rng = random.Random(2)
    ids = [k for k in (*range(40), *range(1 << 40, (1 << 40) + 60, 3)) for _ in range(25)] + [5000 + k for k in range(100)] + [-(1 << 62), (1 << 62) + 1, None, None]
    texts = [" ".join(words(rng, 3)) for _ in ids]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "200")
        df = frame(spark, texts, ids)
        dealt = fingerprint.neighbours(df, 10).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    hashed = {x.text: x.h for x in df.select("text", F.xxhash64("text").alias("h")).collect()}
    rows = sorted((i if i is not None else (1 << 63) - 1, hashed[t], t) for i, t in zip(ids, texts, strict=True))
    runs = {}
    for x in dealt:
        runs.setdefault(x.bucket, []).append((x.extra, x.key, x.hash, x.text))
    inside = [(k, h, t) for b in sorted(runs) for e, k, h, t in sorted(runs[b]) if not e]
    # 2,048 neighbouring ids without a hot one among them are not divided
    assert inside == rows and max(len(part) for part in runs.values() if part[0][1] < 5000) < 60
    for b, part in runs.items():
        (last,) = [x[1:] for x in part if x[0]]
        assert last == min(x[1:] for x in runs[(b + 1) % len(runs)] if not x[0])


@pytest.mark.parametrize("hot", [None, 7, (1 << 53) + 1])
def test_neighbours_of_a_hot_key(spark, hot):
    """A doc_id, or null, on most rows is divided among buckets; every row still meets its next."""
    rng = random.Random(1)
    texts = [" ".join(words(rng, 5)) for _ in range(120)]
    ids = [hot if k % 3 else rng.choice([k, (1 << 53) + k % 4]) for k in range(120)]
    df = frame(spark, texts, ids)
    dealt = fingerprint.neighbours(df, 5).collect()
    size = {}
    for x in dealt:
        size[x.bucket] = size.get(x.bucket, 0) + 1
    assert max(size.values()) < 60 and len(dealt) - len(size) == 120
    hashed = {x.text: x.h for x in df.select("text", F.xxhash64("text").alias("h")).collect()}
    rows = sorted(((i if i is not None else (1 << 63) - 1, hashed[t], t) for i, t in zip(ids, texts, strict=True)))
    want = []
    for k, (_, _, t) in enumerate(rows):
        n = len(t) // 4
        want.append(hashlib.sha256((t[: len(t) - n] + rows[(k + 1) % len(rows)][2][:n]).encode()).hexdigest())
    assert sorted(x.edited_sha256 for x in fingerprint.compare_edited(df).collect()) == sorted(want)


def test_warc_round_trip(spark, tmp_path):
    big, other = "é" * 600, "x\r\n\r\nWARC/1.1\r\n" * 80
    html = [big, big, other, other, "small", "small", None, "", other + "!", big, big]
    ids = [5, 9, 1, None, 2, 3, 4, 6, 7, 9, -3]
    urls = ["http://b.org/x y", "http://www.a.org/1", None, "no url", *["https://a.org/%d?Q#f" % k for k in range(7)]]
    pages = spark.createDataFrame(list(zip(ids, urls, html, strict=True)), "page_id long, url string, html string").withColumn("run", F.lit(1))
    warc.write_archives(pages, str(tmp_path / "a"), file_bytes=500)
    index = warc.capture_index(common.cut(warc.read_archives(spark, str(tmp_path / "a"))), range_rows=4)
    rows = index.collect()
    key = [(x.urlkey, x.stamp, x.page_id is not None, x.page_id or 0) for x in rows]
    assert key == sorted(key) and len(rows) == len(ids)
    last = {}
    for i, h in zip(ids, html, strict=True):
        if len((h or "").encode()) >= 1000:
            last[h] = max(last.get(h, -(10**9)), i if i is not None else -(10**9))
    want = []
    for i, h in zip(ids, html, strict=True):
        raw = (h or "").encode()
        again = h in last and i != last[h]
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", last[h] if again else None))
    assert sorted(map(str, want)) == sorted(str((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to)) for x in rows)
    assert warc.url_key("http://www.Example.com:80/A?b#c") == "com,example)/a?b"
    files = {x.run: open(x.run.removeprefix("file:"), "rb").read() for x in rows}
    assert len(files) > 4
    for x in rows:  # any gzip reader can read a whole archive, or seek to one record
        record = gzip.decompress(files[x.run][x.offset : x.offset + x.length])
        assert record in gzip.decompress(files[x.run]) and f"<urn:capture:{'none' if x.page_id is None else x.page_id}>".encode() in record


def test_warc_of_a_large_record(spark, tmp_path):
    """A record over 16 MB: the last byte of its gzip member isn't zero."""
    rng = random.Random(2)
    big = "".join(rng.choices("abcdef", k=1 << 16)) * 300
    pages = spark.createDataFrame([(1, "http://a.org/1", big), (2, "http://a.org/2", "x"), (3, "http://a.org/3", big)], "page_id long, url string, html string")
    got = warc.archive_and_index(pages, str(tmp_path / "a")).collect()
    digest = hashlib.sha1(big.encode()).hexdigest()
    assert [(x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in got] == [
        (1, len(big), digest, "revisit", 3), (2, 1, hashlib.sha1(b"x").hexdigest(), "response", None), (3, len(big), digest, "response", None)
    ]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9)), max_size=9))
def test_loser_tree(runs):
    runs = [sorted(r) for r in runs]
    assert list(warc.LoserTree(runs, key=lambda x: x)) == list(heapq.merge(*runs))
    mixed = [x for r in runs for x in r]
    pieces = warc.natural_runs(iter(mixed), key=lambda x: x)
    assert [x for p in pieces for x in p] == mixed and all(p == sorted(p) for p in pieces) and len(pieces) <= len(runs)
    assert list(warc.LoserTree(pieces, key=lambda x: x)) == sorted(mixed)


def plain_spans(text):
    out = [(0, *m.span()) for m in re.finditer(pii.EMAIL, text)]
    out += [(1, *m.span()) for m in re.finditer(pii.IP, text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(pii.CARD, text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(pii.PHONE, text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a.@-+1245(0) é9", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_pii(spark):
    rng = random.Random(2)
    texts = [None, "", "no data here", "mail a.b@c.de, a@b.c@d.e", "ip 10.0.0.256 1.2.3.4.5", "é 4111 1111 1111 1111 x", "call +1 (555) 123-4567 now", "9" * 5000, "0001.2.3.4"]
    texts += [f"write to user{k}@mail{k % 7}.org or +49 30 {rng.randrange(10**6, 10**7)}" for k in range(60)]
    got = {x.doc_id: x for x in pii.detect(frame(spark, texts)).collect()}
    for k, t in enumerate(texts):
        base = plain_spans(t or "")
        joined = ",".join(f"{pii.KINDS[a]}:{s}:{e}" for a, s, e in sorted(base))
        assert got[k].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [got[k][f"n_{x}"] for x in pii.KINDS] == [sum(b[0] == j for b in base) for j in range(4)]
        assert {x for x in joined.split(",") if x} <= set(got[k].spans.split(","))
    out = pii.redact(frame(spark, texts))
    rows = {x.doc_id: x for x in out.collect()}
    assert out.columns == frame(spark, [""]).columns and rows[0].text is None and rows[3].text == "mail <EMAIL>, <EMAIL>@d.e"
    assert rows[5].text == "é <CARD> x" and rows[5].n_chars == len(rows[5].text) and rows[2].text == "no data here"


def test_skip_edges_carry_labels():
    chain, skip = np.zeros((pii.LABELS, pii.LABELS)), np.eye(pii.LABELS) * 3
    unary = np.zeros((3, pii.LABELS))
    unary[0, 1] = 30
    p = pii.marginals(unary, [(0, 2)], skip[None])
    assert p[2].argmax() == 1 and p[2, 1] > 0.8 and abs(p[1] - 1 / pii.LABELS).max() < 1e-9
    assert pii.marginals(np.zeros((0, pii.LABELS)), [], chain[None][:0]).shape == (0, pii.LABELS)
    # a word that looks a little like a phone is completed by a far repetition that is one
    text = "call 5551234567 " + "and so on " * 20 + "+5551234567"
    spans = pii.suspicious_words(pa.array([text]))[0]
    assert pii.edges_of(text, spans) == ([], [(0, 1)])
    weights = np.zeros((pii.FEATURES, pii.LABELS))
    assert pii.added_spans(text, spans, pii.base_spans(text), (weights, chain, skip * 3)) == [(3, 5, 15)]


def test_marginals_are_exact_on_trees():
    """Messages against the sum over all labellings, on random forests."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 4, 5, 6):
        unary = rng.normal(size=(n, 3))
        edges = [(int(rng.integers(k)), k) for k in range(1, n) if rng.random() < 0.8]
        potentials = rng.normal(size=(len(edges), 3, 3))
        want = np.zeros((n, 3))
        for labels in itertools.product(range(3), repeat=n):
            weight = np.exp(sum(unary[k, x] for k, x in enumerate(labels)) + sum(p[labels[a], labels[b]] for p, (a, b) in zip(potentials, edges, strict=True)))
            for k, x in enumerate(labels):
                want[k, x] += weight
        assert np.allclose(pii.marginals(unary, edges, potentials, settled=1e-9), want / want.sum(axis=1, keepdims=True), atol=1e-5)


def pii_text(rng, distract=True):
    """A text with personal data and numbers that are none."""
    fill = lambda: " ".join(rng.choice(("the", "of", "and", "house", "green", "is", "was", "page 12", "v1.2.", "1999")) for _ in range(rng.randrange(5, 30)))
    card = "".join(str(rng.randrange(10)) for _ in range(15))
    card += next(str(x) for x in range(10) if pii.luhn(card + str(x)))
    wrong = "".join(str(rng.randrange(10)) for _ in range(16))
    some = [f"u{rng.randrange(1000)}.x@mail{rng.randrange(9)}.example.org", f"{rng.randrange(1, 256)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}", card, f"+{rng.randrange(1, 99)} ({rng.randrange(100, 1000)}) {rng.randrange(100, 1000)}-{rng.randrange(1000, 10000)}"]
    parts = [fill()]
    for x in rng.sample(some, rng.randrange(1, 5)):
        parts += [x, fill()]
    if distract and not pii.luhn(wrong):
        parts += [wrong, fill()]
    return " ".join(parts)


def test_hidden_data_is_found(spark):
    """Precision and recall of added spans on matches hidden in texts that taught nothing; numbers that only look like cards are left alone."""
    rng = random.Random(12)
    model = pii.fit([x for x in (pii.example(pii_text(rng)) for _ in range(1500)) if x])
    right = wrong = missed = 0
    for _ in range(400):
        text, marks = pii.hide(pii_text(rng), "test")
        base = pii.base_spans(text)
        marks = [m for m in marks if not any(s < m[2] and m[1] < e for _, s, e in base)]
        got = pii.added_spans(text, pii.suspicious_words(pa.array([text]))[0], base, model)
        meets = lambda a, b: a[0] == b[0] and a[1] < b[2] and b[1] < a[2]
        missed += sum(not any(meets(g, m) for g in got) for m in marks)
        for g in got:
            ok = any(meets(g, m) for m in marks)
            right, wrong = right + ok, wrong + (not ok)
    assert right / (right + missed) >= 0.9 and right / (right + wrong) >= 0.95
    for _ in range(300):  # nothing hidden: nothing added, but phones that the pattern loses because more digits follow them
        text = pii_text(rng)
        lost = [m.span(1) for m in re.finditer(r"(\+\d+ \(\d+\) \d+-\d+) 1999", text)]
        for kind, s, e in pii.added_spans(text, pii.suspicious_words(pa.array([text]))[0], pii.base_spans(text), model):
            assert pii.KINDS[kind] == "phone" and any(s < b and a < e for a, b in lost)


def form_of(kind, match, new):
    """Which of the ways of `disguise` made new of match."""
    if kind == 0:
        return "a @ b" if " @ " in new else "no domain"
    mark = next((c for c in "-_,./" if c in new), "")
    return mark if kind in (1, 2) else mark or ("no plus" if new == match.lstrip("+") and not new.isdigit() else "digits" if len(new) > 10 else "last ten")


def left_out(kind, form, n=600):
    """Recall and wrong spans on matches hidden in one way that the training never used."""
    real = pii.disguise

    def without(k, match, rng):
        while True:
            new = real(k, match, rng)
            if k != kind or form_of(k, match, new) != form:
                return new

    def only(k, match, rng):
        if k != kind:
            return match
        while True:
            new = real(k, match, rng)
            if form_of(k, match, new) == form:
                return new

    rng = random.Random(21)
    try:
        pii.disguise = without
        model = pii.fit([x for x in (pii.example(pii_text(rng)) for _ in range(1500)) if x])
        pii.disguise = only
        right = missed = wrong = 0
        for _ in range(n):
            text, marks = pii.hide(pii_text(rng), "test")
            base = pii.base_spans(text)
            marks = [m for m in marks if m[0] == kind and not any(s < m[2] and m[1] < e for _, s, e in base)]
            got = pii.added_spans(text, pii.suspicious_words(pa.array([text]))[0], base, model)
            meets = lambda a, b: a[0] == b[0] and a[1] < b[2] and b[1] < a[2]
            hit = sum(any(meets(g, m) for g in got) for m in marks)
            right, missed = right + hit, missed + len(marks) - hit
            wrong += sum(not any(meets(g, m) for m in marks) for g in got)
    finally:
        pii.disguise = real
    return right, missed, wrong


@pytest.mark.parametrize(("kind", "form"), [(1, ","), (2, "/")])
def test_forms_that_were_never_taught(kind, form):
    """What the field finds of a form that its training left out; forms without their at sign or plus sign are found less often (README)."""
    right, missed, _ = left_out(kind, form, 150)
    assert right / (right + missed) >= 0.85


def edit(rng, text, k):
    y = list(text)
    for _ in range(k):
        p = rng.randrange(len(y))
        match rng.randrange(3):
            case 0:
                y[p] = "#"
            case 1:
                del y[p]
            case 2:
                y.insert(p, "#")
    return "".join(y)


def plain_distance(item, text):
    row = [0] * (len(text) + 1)
    for a in item:
        old, row = row, [row[0] + 1]
        for j, b in enumerate(text):
            row.append(min(old[j] + (a != b), old[j + 1] + 1, row[j] + 1))
    return min(row)


def test_decontamination(spark):
    rng = random.Random(8)
    items = [" ".join(words(rng, n, 500)) for n in (6, 12, 20, 40)] + ["", None, "ab", "Short one", "x" * 50]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(None, "null id")], "item_id long, text string").withColumn("doc_id", F.lit(1))
    texts = [None, "", "nothing of it", "has NULL ID in it", "...short ONE...", "x" * 200]
    for k in range(60):
        t = rng.choice(items[:4])
        m = edit(rng, t, rng.randrange(0, int(0.09 * len(t)) + 2))
        texts.append(" ".join(words(rng, 15, 500)) + " " + m + " " + " ".join(words(rng, 10, 500)))
    got = {x.doc_id: x for x in decontaminate.contamination(frame(spark, texts), bench).collect()}
    for k, t in enumerate(texts):
        want = [j for j, x in [(-1, "null id"), *enumerate(items)] if x and plain_distance(x.lower(), (t or "").lower()) <= int(0.05 * len(x))]
        assert got[k]["items"] == want and got[k].n_items == len(want) and got[k].contaminated == bool(want)
    assert {x.doc_id: x["items"] for x in decontaminate.contamination(frame(spark, texts), bench, block_chars=100).collect()} == {k: x["items"] for k, x in got.items()}
    kept = decontaminate.decontaminate(frame(spark, texts), bench)
    assert {x.doc_id for x in kept.collect()} == {k for k, x in got.items() if not x.contaminated} and kept.columns == frame(spark, [""]).columns
    assert {x.doc_id for x in decontaminate.decontaminate(frame(spark, texts), bench, block_chars=100).collect()} == {x.doc_id for x in kept.collect()}
    assert decontaminate.contamination(frame(spark, texts), bench.limit(0)).where("contaminated").count() == 0


@pytest.mark.parametrize("hits", [decontaminate.HITS, 50])
def test_decontamination_of_low_complexity(monkeypatch, hits):
    """Repetitive texts and items: the same verdicts as without a filter, in pieces too."""
    monkeypatch.setattr(decontaminate, "HITS", hits)
    rng = random.Random(3)
    items = ["_" * 120, "Name: " + "_" * 40, "ab" * 30, "abc" * 25 + "the end", "-=" * 20 + "x" * 20, "ha ha ha ha ha ha", "aaaa"]
    bench = decontaminate.Items(list(enumerate(items)), 0.05)
    texts = ["_" * 300, "_" * 110, "_" * 115, "ab" * 500, "name: " + "_" * 38 + " ok", "abc" * 200, "abc" * 60 + "the end" + "abc" * 40, "x" * 60, "-=" * 90 + "x" * 90, ""]
    texts += ["".join(rng.choices(("_" * 30, "ab" * 9, "abc" * 7, "the end", "name: ", "ha ", "x" * 9, "-=" * 8), k=rng.randrange(1, 30))) for _ in range(60)]
    want = [{j for j, x in enumerate(items) if plain_distance(x.lower(), t) <= int(0.05 * len(x))} for t in texts]
    text, at = decontaminate.code_points(pa.array(texts))
    assert bench.search(text, at) == want
    for t, w in zip(texts, want, strict=True):
        assert bench.search(*decontaminate.code_points(pa.array([t]))) == [w]


def test_decontamination_of_a_megabyte_of_underscores():
    bench = decontaminate.Items([(1, "_" * 120), (2, "Put your answer in here, please: " + "_" * 120), (3, "no such words in it at all")], 0.05)
    peak = 0
    for n in (1 << 18, 1 << 20):
        tracemalloc.start()
        began = time.perf_counter()
        assert bench.search(*decontaminate.code_points(pa.array(["_" * n]))) == [{0}]
        took, (_, peak) = time.perf_counter() - began, tracemalloc.get_traced_memory()
        tracemalloc.stop()
        assert took < 60 and peak < 1500 << 20


def test_packing(spark):
    from tokenizers import Tokenizer

    path, pattern = queries.tokenizer_file()
    texts = [*corpus(6, 25), "a" * 3000, "word " * 2500, "<|endoftext|> x", "a<|endoftext|><|endoftext|>b <|endoftext", " " * 1_500_000 + "x \n" * 3, "x" * 100, "日本語のテキスト🙂 \u0000"]
    ids = [*range(len(texts) - 1), None]
    df = frame(spark, texts, ids)
    rows = packing.pack(df, path, pattern, group=20).collect()
    real = Tokenizer.from_file(path)
    for i, t in zip(ids, texts, strict=True):
        want = np.array([*real.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted((x for x in rows if x.doc_id == i), key=lambda x: x.start)
        assert [x.start for x in own] == np.cumsum([0, *(x.length for x in own)])[:-1].tolist() and sum(x.length for x in own) == len(want)
        assert all(x.ids_crc32 == zlib.crc32(want[x.start : x.start + x.length].tobytes()) and x.doc_tokens == len(want) for x in own)
    sequences = {}
    for x in rows:
        sequences.setdefault(x.sequence_id, []).append(x)
    for s in sequences.values():
        s.sort(key=lambda x: x.offset)
        assert [x.offset for x in s] == np.cumsum([0, *(x.length for x in s)])[:-1].tolist() and sum(x.length for x in s) <= 1024


def test_ids_are_those_of_the_library():
    from tokenizers import Tokenizer

    path, pattern = queries.tokenizer_file()
    real, own = Tokenizer.from_file(path), packing.encoder("test", open(path, encoding="utf-8").read(), pattern)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.one_of(st.sampled_from(["<|endoftext|>", "<|endof", "text|>", " " * 3000, "\n\t" * 50, "'re", "it's", "١٢", "\u2003", "\x85", "e\u0301", "🙂"]), st.text(max_size=8)), max_size=8).map("".join))
    def same(text):
        assert own(text) == real.encode(text, add_special_tokens=False).ids

    same()
    assert own("a<|endoftext|>") == [64, 50256]
    for text in (" " * 2_000_000, "a" + " \n" * 700_000 + "<|endoftext|>b"):
        assert own(text) == real.encode(text, add_special_tokens=False).ids


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(0)
    lengths = sorted((rng.randrange(1, 100) for _ in range(500)), reverse=True)
    where, offset = packing.best_fit(lengths, 100)
    room = []
    for n, w, o in zip(lengths, where, offset, strict=True):
        fits = [r for r in room if r >= n]
        if not fits:
            assert w == len(room)
            room.append(100)
        assert room[w] == (min(fits) if fits else 100) and o == 100 - room[w]
        room[w] -= n


def test_whole_documents_teach_and_settle(monkeypatch):
    """Late words and pairs of words far apart are learnt from; a label reaches repeats over more than six skip edges."""
    monkeypatch.setattr(pii, "hide", lambda text: (text, []))
    text = "1.2.3.4 " + " ".join(f"x{k}" for k in range(400)) + " 1.2.3.4 late@mail.example.org"
    words = pii.suspicious_words(pa.array([text]))[0]
    (got,) = [row["example"] for batch in pii._teacher(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=["doc_id", "text"])])) for row in batch.to_pylist()]
    features, labels, _, skip = pii.pickle.loads(got)
    assert len(features) == len(labels) == len(words) == 403 and skip == [((2, 2), 1)]
    assert labels[-1] == 1 and features[-1].tolist() == pii.word_features(text, *words[-1])
    n = 40
    unary = np.zeros((n, pii.LABELS))
    unary[0, 1] = 30.0
    potential = np.full((pii.LABELS, pii.LABELS), -3.0) + 6 * np.eye(pii.LABELS)
    p = pii.marginals(unary, [(k, k + 1) for k in range(n - 1)], np.repeat(potential[None], n - 1, axis=0))
    q, step = np.eye(pii.LABELS)[1], np.exp(potential) / np.exp(potential).sum(axis=1, keepdims=True)
    for k in range(n):
        assert np.allclose(p[k], q, atol=1e-3)
        q = q @ step


def test_resampling(spark):
    rng = random.Random(1)
    good = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=40)) for _ in range(60)]
    bad = [" ".join(rng.choices(["junk", "spam", "noise", "alpha"], k=40)) for _ in range(60)]
    df = frame(spark, good + bad + [None, ""])
    wanted = spark.createDataFrame([(k,) for k in range(30)] + [(None,)], "doc_id long")
    rows = resample.resample(df, wanted).collect()
    kept = {x.doc_id for x in rows if x.kept}
    assert len(rows) == 122 and len(kept) == 61 and len(kept & set(range(60))) >= 55
    assert kept == {x.doc_id for x in sorted(rows, key=lambda x: -x.value)[:61]}
    for copies, share in ((10, 0.5), (11, 0.3), (1, 0.5)):  # ties: exactly k rows, whatever repeats
        same = resample.resample(frame(spark, ["alpha beta"] * copies + ["x"], [3] * copies + [4]), wanted, share).collect()
        assert sum(x.kept for x in same) == round(share * (copies + 1)) and len(same) == copies + 1
    all_ = resample.resample(df, wanted, 1.0).collect()
    assert all(x.kept for x in all_) and not any(x.kept for x in resample.resample(df, wanted, 0.0).collect())
    assert {x.log_weight for x in rows if x.doc_id in (120, 121)} == {0.0}
    assert kept == {x.doc_id for x in resample.resample(df, wanted).collect() if x.kept}
    even = resample.resample(df, wanted.limit(0)).collect()
    assert sum(x.kept for x in even) == 61 and {x.log_weight for x in even} == {0.0}


@pytest.mark.parametrize("kind", ["double", "long"])
def test_places_of_close_numbers(spark, kind):
    """The k-th largest of neighbours that differ in their last bit, of extremes and of equal ones."""
    values = [1.0, np.nextafter(1.0, 2), np.nextafter(1.0, 0), 1.0, -5.0, 1e300, 0.0, 5e-324, 7.0, 7.0] if kind == "double" else [-(1 << 63), (1 << 63) - 1, 0, 1, 2, 2, (1 << 62), (1 << 62) + 1, -1, 2]
    rows = spark.createDataFrame([(float(v) if kind == "double" else v,) for v in values], f"x {kind}").cache()
    order = sorted(values, reverse=True)
    for k in range(1, len(values) + 1):
        assert resample._cutoff(rows, "x", k) == (order[k - 1], sum(v > order[k - 1] for v in values), values.count(order[k - 1]))


def test_resampling_counts_every_wanted_document(spark):
    n = 20_300  # the first 150 ids have the only texts of their kind
    texts = [f"alpha beta {'delta' if k < 150 else 'gamma'}" for k in range(n)] + ["junk spam", "junk spam", None]
    ids = [*range(n), n, 5, None]
    wanted = spark.createDataFrame([(k,) for k in range(n)] + [(3,), (None,)], "doc_id long")
    rows = resample.resample(frame(spark, texts, ids), wanted).collect()
    raw, target = np.zeros(resample.BUCKETS), np.zeros(resample.BUCKETS)
    per = {t: resample.grams(pa.array([t]))[1] for t in set(texts) - {None}}
    for k, t in zip(ids, texts, strict=True):
        if t:
            np.add.at(raw, per[t], 1)
            if k is not None and k < n:
                np.add.at(target, per[t], 1)
    share = target.sum() / raw.sum()
    ratio = np.log((target + resample.SMOOTHING * share) / ((raw + resample.SMOOTHING) * share))
    want = {t: round(resample.SHARPNESS * ratio[b].mean(), 9) for t, b in per.items()} | {None: 0.0}
    assert sorted((x.doc_id, round(x.log_weight, 9)) for x in rows if x.doc_id is not None) == sorted((k, want[t]) for k, t in zip(ids, texts, strict=True) if k is not None)


def test_resampling_weights_against_plain_counts(spark):
    """Weights from counts of words and pairs in dicts; the fixture's n-grams have a bucket each."""
    rng = random.Random(8)
    texts = [" ".join(rng.choices(["Alpha", "beta", "gamma", "delta"] if k < 30 else ["junk", "spam", "noise", "alpha"], k=rng.randrange(1, 12))) for k in range(60)]
    plain = lambda t: [*(w := t.lower().split()), *zip(w, w[1:], strict=False)]
    every = {g for t in texts for g in plain(t)}
    assert len({int(b) for t in texts for b in resample.grams(pa.array([t]))[1]}) == len(every)
    raw, target = ({g: sum(plain(t).count(g) for t in some) for g in every} for some in (texts, texts[:15]))
    share = sum(target.values()) / sum(raw.values())
    rows = resample.resample(frame(spark, texts), spark.createDataFrame([(k,) for k in range(15)], "doc_id long")).collect()
    for x in rows:
        own = plain(texts[x.doc_id])
        want = sum(np.log((target[g] + resample.SMOOTHING * share) / ((raw[g] + resample.SMOOTHING) * share)) for g in own) / len(own)
        assert abs(x.log_weight - resample.SHARPNESS * want) < 1e-9


def test_very_long_texts(spark):
    """Texts of megabytes, words of a megabyte and texts without words among short ones."""
    rng = random.Random(13)
    long = " ".join(f"w{rng.randrange(10**5)}" for _ in range(100_000))
    texts = [long, long + " more", "x" * (1 << 20), "x" * (1 << 20) + "y", " " * 300_000, "short text", long[: len(long) // 2]]
    df = frame(spark, texts)
    assert [x.component_id for x in near_dedup.near_duplicates(df, 2).orderBy("doc_id").collect()] == [0, 0, 2, 3, 4, 5, 6]
    want = [(i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in plain_removal(list(enumerate(texts)))]
    assert [tuple(x) for x in substring.remove_repeats(df, "sha256").orderBy("doc_id").select("doc_id", "n_words", "n_removed", "kept_sha256").collect()] == want
    assert fingerprint.compare_edited(df).count() == 7 and pii.detect(df).where("spans <> ''").count() == 0


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    frame(spark, ["x"]).drop("score", "bucket", "key").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def page(main, k=0, nav=True):
    menu = "<nav><ul><li><a href='/'>Home</a><li>About</ul></nav>" if nav else ""
    return f"<html><head><title>t</title><style>p{{}}</style></head><body>{menu}<div class='ad'>Buy</div>{main}<footer>f{k}</footer></body></html>"


def test_html(spark):
    cases = [
        (page("<article><h1>A &amp; B</h1><p>One\n <b>two</b><br>three<p>Fo&#117;r&nbsp;x<aside>no</aside><div class='comments'>troll</div></article>"), "A & B\n\nOne two three\n\nFour x"),
        (page("<main><div>Plain <i>text</i></div>tail<script>var a='</p>';</script></main>"), "Plain text\n\ntail"),
        ("<p>only<!-- c --> text<p title='a>b'>second", "only text\n\nsecond"),
        ("<div id='cookie-notice'>We use</div><form>q<input></form><p>body", "body"),
        ("<body class='has-sidebar'><div class='layout with-header'><p>kept<div class='sidebarBox'>gone</div><section id='userComments'>gone</section></div>", "kept"),
        ("<article><p>a<script>never ends <p>b", "a"),
        (None, ""),
        ("", ""),
        ("<p></p>", ""),
    ]
    rows = [(k, f"http://h{k}.org/", h) for k, (h, _) in enumerate(cases)]
    rows += [(100 + k, "http://site.org/%d" % k, f"<div><p>Same box on all pages</p></div><p>Text number {k}</p>") for k in range(8)] + [(100, "http://site.org/0", "<div><p>Same box on all pages</p></div><p>Text number 0</p>")]
    rows += [(None, None, "<p>null")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    assert len(got) == len(rows)
    by = {x.page_id: x for x in got}
    for k, (_, want) in enumerate(cases):
        assert by[k].text == want and by[k].n_chars == len(want)
    assert [by[100 + k].text for k in range(8)] == [f"Text number {k}" for k in range(8)] and by[None].text == "null"


def test_html_templates_of_large_hosts(spark):
    """What six pages share goes, whatever their share of the host; null and repeated rows come back."""
    rows = [(k, f"http://site.org/{k}", f"<div><p>Text number {k}</p></div>" + ("<ul><li>Section menu</ul>" if k < 6 else "")) for k in range(1200)]
    rows += [rows[0], (7, "http://other.org/", "<p>Text number 7</p><ul><li>Section menu</ul>"), (None, "http://site.org/x", None), (None, "http://site.org/x", "<ul><li>Section menu</ul>")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want = [(k, f"Text number {k}") for k in [*range(1200), 0]] + [(7, "Text number 7\n\nSection menu"), (-1, ""), (-1, "Section menu")]  # all that the last one has
    assert sorted((-1 if x.page_id is None else x.page_id, x.text) for x in got) == sorted(want)


def test_html_copies_of_a_page_are_one_witness(spark):
    """Equal pages and repeated rows keep their text, with and without a marked article; so do near copies of a page that has nothing else."""
    article = "<h1>Title</h1><p>First part</p><div><p>Second part</p></div>"
    text = "Title\n\nFirst part\n\nSecond part"
    rows = []
    for host, n in (("five", 5), ("fifty", 50)):
        for kind, body in (("plain", article), ("marked", f"<article>{article}</article>")):
            rows += [(len(rows), f"http://{host}.{kind}.org/{k}", f"<nav>Menu</nav>{body}") for k in range(n)]
            rows += [(len(rows) + 1000, f"http://rows.{host}.{kind}.org/", body)] * n
    near = [(5000 + k, f"http://near.org/{k}", f"<nav>Menu {k}</nav><div>{article}</div><footer>{k}</footer>") for k in range(9)]
    few = [(6000 + k, f"http://few.org/{k}", f"<p>Text {k}</p>" + ("<h2>Summary</h2><ul><li>One<li>More</ul>" if k < 5 else "") + ("<p>All of them</p>")) for k in range(100)]
    got = html_text.extract(spark.createDataFrame(rows + near + few, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) + 109
    for x in got:
        k = x.page_id - 6000
        want = text if k < 0 else f"Text {k}" + ("\n\nSummary" if k < 5 else "")
        assert x.text == want, x.page_id


def test_html_templates_of_any_size(spark):
    """Bare text of a container of many blocks, a very long block and a long box of links in an article recur like others."""
    rows = []
    for k in range(8):
        many = "".join(f"<p>Text {k} {i}</p>" for i in range(70))
        rows.append((k, f"http://a.org/{k}", f"<div>Bare words{many}<p>{'long ' * 14_000}</p></div>"))
        box = "".join(f"<p><a href='/{i}'>Link {i}</a></p>" for i in range(70)) if k < 5 else ""
        rows += [(100 + k, f"http://b.org/{k}", f"<main><div>{box}</div><p>Text {k}</p></main>"), (200 + k, f"http://b.org/{100 + k}", f"<main><p>Text {k} b</p></main>")]
    got = {x.page_id: x.text for x in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(8):
        assert got[k] == "\n\n".join(f"Text {k} {i}" for i in range(70))
        assert got[100 + k] == f"Text {k}" and got[200 + k] == f"Text {k} b"


def test_html_boxes_in_articles(spark):
    """A box on all pages of the host goes from their articles; a passage that five of twelve share stays."""
    shared = "<p>A passage of some articles</p>"
    rows = [(k, f"http://site.org/{k}", f"<main><div><p>Join our club</p></div><p>Text number {k}</p>{shared if k < 5 else ''}</main>") for k in range(12)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {x.page_id: x.text for x in got} == {k: f"Text number {k}" + ("\n\nA passage of some articles" if k < 5 else "") for k in range(12)}


def test_html_names():
    """The name of a category or tag says nothing about an article; an article in a named box stays unless the page has another."""
    kept = lambda page: [b[0] for b in html_text.blocks(page) if b[3] == html_text.KEPT]
    for name in ("post category-social", "hentry tag-search-engines", "post-type-notice format-status", "comment"):
        assert kept(f"<div>x<article class='{name}'><p>Main text</article></div>") == ["Main text"]
    assert kept("<div class='widget-container'><main><p>Main text</main></div>") == ["Main text"]
    assert kept("<main><p>Main text</main><div class='related'><article><p>Teaser</article></div>") == ["Main text"]
    assert kept("<div class='category-nav'><p>a</div><div class='no-sidebar'><p>b</div><div class='post-comments'><p>c</div>") == ["b"]


def random_page(rng, host, k, article):
    """A page and its main text: boxes of the host, boxes that no template can find, and paragraphs of its own."""
    own, main = [], []
    for j in range(rng.randrange(1, 6)):
        text = f"Page {host} {k} part {j} " + " ".join(rng.choice(("a &amp; b", "<b>bold</b>", "x&#33;", "<!-- no -->", "<i>it", "two\n words", "<script>if (a<b) {}</script>")) for _ in range(rng.randrange(4)))
        own.append(rng.choice(("<p>%s</p>", "<p>%s", "<div>%s</div>", "<blockquote>%s</blockquote>", "<ul><li>%s</ul>")) % text)
        plain = re.sub(r"(?s)<script>.*?</script>|<!--.*?-->|<[^>]*>", "", text).replace("&amp;", "&").replace("&#33;", "!")
        main.append(" ".join(plain.split()))
    boxes = [f"<div><p>Host {host} says hello</p></div>", f"<section><h3>Club of {host}</h3><div>Join<p>today</div></section>", f"<ul><li><a href='/'>Home {host}</a><li><a href='/b'>More</a></ul>"]
    noise = [f"<nav>Menu {k}</nav>", f"<div class='ad-slot'>Buy {k} now</div>", f"<aside>See {k} too</aside>", f"<div id='userComments'><p>Reader {k}</div>", f"<form>Ask {k}<input></form>"]
    rest = [*boxes, *rng.sample(noise, rng.randrange(4))]
    rng.shuffle(rest)
    cut = rng.randrange(len(rest) + 1)
    body = "".join(own)
    return f"<html><body>{''.join(rest[:cut])}{'<article>' + body + '</article>' if article else body}{''.join(rest[cut:])}<footer>End {k}</footer></body></html>", "\n\n".join(main)


def test_html_against_pages_of_known_text(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for h in range(8):
        for k in range(6 + h):
            html, main = random_page(rng, h, k, h % 2)
            rows.append((len(rows), f"https://h{h}.org/{k}", html))
            want[len(want)] = main
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {x.page_id: x.text for x in html_text.extract(df).collect()} == want
    report = {x.rule: (x.pages, x.blocks) for x in html_text.rule_report(df).collect()}
    assert report["template"][0] == len(rows) and report["template"][1] > 5 * len(rows) and report["element"][0] == len(rows)
    off = {x.page_id: x.text for x in html_text.extract(df, min_pages=10**9).collect()}
    assert sum(off[k] != want[k] for k in want) == sum(1 for i, u, _ in rows if int(u[9]) % 2 == 0)  # all pages without a marked article


@pytest.mark.parametrize("part", ["<a", "a<b ", "<a '\">", "<!--x", "<!", "&amp", "</script ", "<p>a", "<ul><b>", "<title>x</titl", "<div class=\"'"])
def test_html_of_broken_markup_takes_linear_time(part):
    page = part * ((1 << 20) // len(part))
    began = time.perf_counter()
    html_text.blocks(page)
    html_text.blocks(page + ">")
    html_text.blocks(page + "</i>" * (1 << 16))
    assert time.perf_counter() - began < 30


def test_toxicity(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choices(vocabulary, k=40) + (["vile"] if k % 4 == 0 else [])) for k in range(400)] + [None, ""]
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(400)] + [(400, 1, None), (None, 1, 1), (1, 0, 0)], "doc_id long, quality int, toxic int")
    df = frame(spark, [*texts, "vile null"], [*range(402), None])
    rows = {x.doc_id: x for x in toxicity.score(df, labels).collect()}
    assert len(rows) == 403
    for k in range(402):
        x = rows[k]
        assert x.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3)
    held = [k for k in range(400) if rows[k].held_out]
    assert sum(rows[k].predicted == (k % 4 == 0) for k in held) / len(held) > 0.97
    assert rows[None].held_out is False and rows[None].predicted == 1 and rows[400].predicted == 0
    kept = toxicity.reject(df, labels)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == {k for k, x in rows.items() if not x.predicted}
    none = toxicity.score(df, labels.limit(0)).collect()
    assert len(none) == 403 and {x.score for x in none} == {0.0}
    flipped = toxicity.score(df, labels.withColumn("toxic", F.when(F.expr("crc32(cast(doc_id as string)) % 4 = 2"), 1 - F.col("toxic")).otherwise(F.col("toxic")))).collect()
    assert {(x.doc_id, x.score) for x in flipped} == {(k, x.score) for k, x in rows.items()}  # held-out labels are never seen


def plain_features(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode()
    w = re.findall(rb"[0-9a-z\x80-\xff]+", low)
    return {("w", x) for x in w} | {(n, x[:n]) for x in w for n in (4, 5) if len(x) > n} | {(g, *p) for g in (1, 2) for p in zip(w, w[g:], strict=False)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcABC1é .,\n", max_size=40), min_size=1, max_size=5))
def test_toxicity_features(texts):
    doc, feature, n = toxicity.features(pa.array(texts))
    assert n == len(texts)
    names = {}
    for k, t in enumerate(texts):
        got = set(feature[doc == k].tolist())
        want = plain_features(t)
        assert len(got) == len(want)
        one = set(toxicity.features(pa.array([t]))[1].tolist())
        assert one == got
        names[k] = got, want
    for a, x in names.values():
        for b, y in names.values():
            assert len(a & b) == len(x & y)


def test_ftrl_against_a_plain_version():
    """Weights of the learner against the published update, one coordinate at a time in a dict."""
    rng = random.Random(2)
    examples = []
    for _ in range(300):
        label = int(rng.random() < 0.3)
        x = {rng.randrange(200) for _ in range(12)} | ({500 + rng.randrange(3)} if label and rng.random() < 0.9 else set())
        examples.append((label, np.array(sorted(x), np.uint32).tobytes()))
    model = toxicity.fit(examples)
    a, b, l1, l2 = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2
    z, n = {}, {}

    def weight(f):
        size = abs(z.get(f, 0.0)) - (0.0 if f == "bias" else l1)
        return -np.sign(z.get(f, 0.0)) * size / ((b + n.get(f, 0.0) ** 0.5) / a + l2) if size > 0 else 0.0

    for epoch in range(toxicity.EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(examples)):
            label, packed = examples[k]
            x = [*np.frombuffer(packed, np.uint32).tolist(), "bias"]
            w = {f: weight(f) for f in x}
            g = 1 / (1 + np.exp(-sum(w.values()))) - label
            for f in x:
                old = n.get(f, 0.0)
                z[f] = z.get(f, 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / a * w[f]
                n[f] = old + g * g
    want = {f: weight(f) for f in z if f != "bias" and weight(f)}
    got = dict(zip(model.hashes.tolist(), model.weights.tolist(), strict=True))
    assert set(got) == set(want) and {500, 501, 502} <= set(got) and len(got) < 100
    assert all(abs(got[f] - want[f]) < 1e-9 for f in want) and abs(model.bias - weight("bias")) < 1e-9


def test_toxicity_ties_and_long_texts(spark):
    """Rows that repeat have equal scores; a very long text teaches and is scored as a whole."""
    rng = random.Random(9)
    long = " ".join(f"x{rng.randrange(10**6)}" for _ in range(60_000))
    texts = [f"calm words {k % 7}" + (" vile" if k % 3 == 0 else "") for k in range(300)] + [long + " vile", long]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(300)] + [(300, 1), (301, 0)], "doc_id long, toxic int")
    df = frame(spark, [*texts, texts[0], texts[0]], [*range(302), 0, 0])
    rows = toxicity.score(df, labels).collect()
    assert len({x.score for x in rows if x.doc_id == 0}) == 1 and sum(x.doc_id == 0 for x in rows) == 3
    by = {x.doc_id: x.score for x in rows}
    assert by[300] > by[301] and by[0] >= 0.3 > by[1]
    assert toxicity.train(df, labels, most=0).hashes.size == 0


def test_toxicity_learns_whole_rows_within_bytes(spark):
    """Every feature of a row teaches; a bound on their bytes takes fewer rows, not parts of texts."""
    rng = random.Random(3)
    texts = [" ".join(f"x{rng.randrange(10**6)}" for _ in range(9_000 if k < 3 else 20)) for k in range(40)]
    df = frame(spark, [*texts, *texts], [*range(40), *range(40)])
    known = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    sizes = {k: 4 * len(set(toxicity.features(pa.array([t]))[1].tolist())) for k, t in enumerate(texts)}

    def taken(most):
        got = toxicity.training_rows(df, known, {1: 10, 0: 20}, most)
        for k, x in zip(got.column("doc_id").to_pylist(), got.column("features").to_pylist(), strict=True):
            assert len(x) == sizes[k]
        return {k: sizes[k] for k in got.column("doc_id").to_pylist()}, [sum(x % 2 == label for x in got.column("doc_id").to_pylist()) for label in (1, 0)]

    rows, each = taken(1 << 30)
    assert each == [10, 20] and max(rows.values()) > 4 * 8192
    some, _ = taken(30_000)
    assert 0 < len(some) < 30 and sum(some.values()) <= 30_000 and set(some) <= set(rows)
    assert taken(0)[0] == {}


def test_empty_tables(spark):
    docs = frame(spark, ["x"]).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (
        near_dedup.near_duplicates(docs),
        near_dedup.deduplicate(docs),
        substring.remove_repeats(docs),
        substring.remove_repeats(docs, "sha256"),
        fingerprint.compare_edited(docs),
        fingerprint.fingerprints(docs),
        warc.archive_and_index(pages),
        pii.detect(docs),
        pii.redact(docs),
        decontaminate.contamination(docs, bench),
        packing.pack(docs, *queries.tokenizer_file()),
        resample.resample(docs, labels),
        html_text.extract(pages),
        toxicity.score(docs, labels),
        toxicity.reject(docs, labels),
    ):
        assert df.count() == 0


def test_key_filter(spark):
    keys = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 5000)
    bits, table = common.key_filter(spark.createDataFrame([(int(k),) for k in keys], "h long"), "h")
    others = np.random.default_rng(2).integers(-(1 << 62), 1 << 62, 5000)
    assert common.passes(keys.view(np.uint64), bits, table).all() and common.passes(others.view(np.uint64), bits, table).mean() < 0.15


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(7)
    item = " ".join(words(rng, 30, 900))
    texts = [" ".join(words(rng, 80, 900)) + (" vile" if k % 5 == 0 else "") for k in range(100)]
    texts += [texts[1] + " more", texts[2], texts[3] + " " + item, "mail me at a@b.org " + " ".join(words(rng, 40, 900)), None]
    df = frame(spark, texts).drop("score", "bucket", "key")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, at = df, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        at[name] = docs
        if name != "packing":
            assert docs.columns == df.columns
    ids = {n: {x.doc_id for x in d.collect()} for n, d in at.items()}
    clean = {k for k in range(100) if k % 5}
    assert ids["toxicity"] == clean | set(range(100, 105)) and ids["near_duplicates"] == clean | {102, 103, 104}
    assert ids["decontamination"] == ids["near_duplicates"] - {102}
    assert "<EMAIL>" in at["personal_data"].where("doc_id = 103").first().text and ids["packing"] == ids["decontamination"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == at["packing"].count()


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls, empty and repeated rows and columns with clashing names go through every stage; what no stage rejects is packed."""
    import corpus_pipeline

    rng = random.Random(8)
    texts = [" ".join(words(rng, 40, 900)) for _ in range(30)] + [None, "", " \n ", None]
    ids = [*range(30), 30, 31, None, None]
    df = frame(spark, [*texts, texts[0], texts[0]], [*ids, 0, 0]).withColumns({"component_id": F.lit(1), "kept": F.lit(False), "toxic": F.lit(1), "start": F.lit(2), "place": F.lit("x")})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, None, 1), (3, 1, None), (3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, None), (None, "x"), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "packing":
            assert docs.columns == df.columns
            assert sorted((str(x.doc_id), str(x.text)) for x in docs.collect()) == sorted((str(x.doc_id), str(x.text)) for x in df.collect()), name
    assert {x.doc_id for x in docs.collect()} == {*range(32), None}
