"""Personal data: fixed patterns, completed by a skip-chain conditional random field.

Nodes of the field are the words of a document that hold a digit or an at sign (any other word cannot be part of the
four kinds, so its label is fixed and it separates the chain). Neighbouring nodes share a chain potential, and repeated or
similar nodes, however far apart in the document, a skip potential: each is tied to the next word with the same digits, the same last
digits or the same lower-case text. Words inside a pattern match are observed. Loopy sum-product messages spread labels along both
kinds of edges; words whose marginal for a kind reaches CERTAIN become further spans, those next to each other one. A card number is added only if
its digits pass the check sum or a word that a skip edge ties to it is an observed card.

Potentials are fitted piecewise (Sutton and McCallum, 2005) on at most `sample` documents (8,000 by default, the first by a hash of
doc_id). What the patterns find there would teach nothing that they miss, so matches are hidden: some are rewritten in forms that no pattern takes
(`disguise`: other separators, no plus sign, no top-level domain), in their place or as a later mention, and keep their labels. Node potentials come from softmax regression over shapes and
contexts of all words of these documents, edge potentials are smoothed log ratios of all their label pairs. What the driver gets is bounded by `most` bytes as well (64 MB by default): with long documents
fewer are taken. All documents are labelled, on their whole texts.

Spans are counted in code points, the end exclusive. Defined cases: null and empty texts have no spans; rows that repeat come back each.
"""

from __future__ import annotations

import hashlib
import pickle
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import affordable, chunks, cut, text_bytes, word_spans

KINDS = ("email", "ip", "card", "phone")
# The patterns that the contract of the query names.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: A match of the address pattern always starts where its run of local characters starts, one of the others where its run of digits does.
_EMAIL, _LOCAL = re.compile(EMAIL), re.compile(r"[A-Za-z0-9._%+-]")
_IP, _CARD, _PHONE = re.compile(r"(?<![0-9])" + IP), re.compile(CARD), re.compile(PHONE)
_NOT_DIGIT = re.compile(r"[^0-9]+")

CERTAIN, FEATURES = 0.9, 4096
#: Documents to learn from, and bytes of what they teach.
SAMPLE, MOST = 8_000, 64 << 20
#: Messages have settled once none changes by more than this. Where they circle, they're slowed down after they had time to cross the document.
SETTLED = 1e-4
#: Pairs of equal labels that the skip potential is fitted with besides those seen.
PRIOR = 20
LABELS = len(KINDS) + 1  # 0: none of them


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of EMAIL, found from the at signs so that a long run of letters is read once."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        s = at
        while s > free and _LOCAL.match(text, s - 1):
            s -= 1
        m = _EMAIL.match(text, s) if s < at else None
        free = m.end() if m else at + 1
        if m:
            out.append((s, free))
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns' matches that pass, by kind, then start."""
    out = [(0, s, e) for s, e in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((3, *m.span()))
    return out


def suspicious_words(column: pa.Array) -> list[list[tuple[int, int]]]:
    """Code-point spans of the words that hold a digit or an at sign, for each text."""
    data, at = text_bytes(column)
    starts, ends, _ = word_spans(data, at)
    hit = np.concatenate(([0], np.cumsum(((data >= 48) & (data <= 57)) | (data == 64))))
    some = hit[ends] > hit[starts]
    starts, ends = starts[some], ends[some]
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    edges = np.searchsorted(starts, at)
    out = []
    for k in range(len(at) - 1):
        a, b = edges[k], edges[k + 1]
        zero = heads[at[k]]
        out.append(list(zip((heads[starts[a:b]] - zero).tolist(), (heads[ends[a:b]] - zero).tolist(), strict=True)))
    return out


def _hash(feature: str) -> int:
    return int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=4).digest(), "little") % FEATURES


def word_features(text: str, start: int, end: int) -> list[int]:
    """Hashed shape and context features of one word."""
    word = text[start:end]
    digits = _NOT_DIGIT.sub("", word)
    short = re.sub(r"(.)\1+", r"\1+", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"[0-9]", "9", word[:48]))))
    before = re.sub(r"[0-9]", "9", text[max(0, start - 24) : start].rpartition("\n")[2].split(" ")[-2:][0].lower())
    after = re.sub(r"[0-9]", "9", (text[end : end + 24].split() or [""])[0].lower())
    names = ["bias", f"shape={short}", f"digits={min(len(digits), 20)}", f"length={min(len(word), 32)}", f"first={word[0]}", f"before={before}", f"after={after}"]
    names += [f"has{c}={min(word.count(c), 4)}" for c in "@.+-():="]
    names += [f"rest={bool(re.search('[A-Za-z]', word))}", f"digits,length={min(len(digits), 20)},{min(len(word), 32)}"]
    return [_hash(x) for x in names]


def edges_of(text: str, words: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges (nothing but white space between) and skip edges (the next word with the same digits, last seven digits or text)."""
    chain = [(k, k + 1) for k in range(len(words) - 1) if text[words[k][1] : words[k + 1][0]].isspace()]
    skip: dict[tuple[int, int], None] = {}
    last: dict[str, int] = {}
    for k, (s, e) in enumerate(words):
        word = text[s:e].strip(".,;:!?()[]{}<>\"'").lower()
        digits = _NOT_DIGIT.sub("", word)
        for key in {f"text {word}"} | ({f"digits {digits}"} if len(digits) >= 6 else set()) | ({f"end {digits[-7:]}"} if len(digits) >= 7 else set()):
            if key in last:
                skip[last[key], k] = None
            last[key] = k
    return chain, list(skip)


def observed(words: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[int]:
    """Label of each word: the kind of a span that it meets, or none."""
    labels, k = [0] * len(words), 0
    order = sorted((s, e, kind) for kind, s, e in spans)
    for s, e, kind in order:
        while k < len(words) and words[k][1] <= s:
            k += 1
        j = k
        while j < len(words) and words[j][0] < e:
            labels[j] = labels[j] or kind + 1
            j += 1
    return labels


def disguise(kind: int, match: str, rng: random.Random) -> str:
    """A match rewritten so that no pattern takes it, as people write such things."""
    digits = _NOT_DIGIT.sub("", match)
    if kind == 0:
        return match.rpartition(".")[0].replace(".", "_") if rng.random() < 0.5 else match.replace("@", " @ ")
    if kind == 1:
        return match.replace(".", rng.choice(("-", "_", ",")))
    if kind == 2:
        mark = rng.choice((".", "/", "_"))
        return mark.join(digits[k : k + 4] for k in range(0, len(digits), 4))
    local = digits[-10:]
    return rng.choice((digits, local, f"{local[:3]}.{local[3:6]}.{local[6:]}", f"{local[:3]}/{local[3:]}", match.lstrip("+")))


def hide(text: str, seed: str = "") -> tuple[str, list[tuple[int, int, int]]]:
    """The text with its matches hidden, in place or by a further mention behind them, and where they are now: (kind, start, end)."""
    rng = random.Random(f"{seed} {len(text)} {text[:64]} {text[-64:]}")
    spans = base_spans(text)
    changes: list[tuple[int, int, str, int]] = []  # start, end, new text, kind
    for kind, s, e in rng.sample(spans, len(spans)):
        new = disguise(kind, text[s:e], rng)
        if rng.random() < 0.5:
            changes.append((s, e, new, kind))
        else:
            gaps = [m.start() for m in re.compile(r"\s").finditer(text, e)]
            at = rng.choice(gaps) if gaps else len(text)
            changes.append((at, at, f" {new}", kind))
    out, marks, free, size = [], [], 0, 0
    for s, e, new, kind in sorted(changes):
        if s < free:
            continue
        out += [text[free:s], new]
        size += s - free
        marks.append((kind, size + len(new) - len(new.lstrip()), size + len(new)))
        size += len(new)
        free = e
    return "".join([*out, text[free:]]), marks


def example(text: str) -> bytes | None:
    """What a document teaches: features and labels of its words; how often each pair of labels is at the ends of a chain and a skip edge. Its matches are hidden first."""
    text, marks = hide(text)
    words = suspicious_words(pa.array([text]))[0]
    if not words:
        return None
    labels = observed(words, base_spans(text) + marks)
    pairs = [list(Counter((labels[a], labels[b]) for a, b in x).items()) for x in edges_of(text, words)]
    return pickle.dumps((np.array([word_features(text, *w) for w in words], np.int16), np.array(labels, np.int8), *pairs))


def _teacher(batches):
    for batch in batches:
        for part in chunks(batch, "text"):
            rows = [example(text) if words else None for text, words in zip(part.column("text").to_pylist(), suspicious_words(part.column("text")), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, pa.binary())], names=["doc_id", "example"])


def fit(examples: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node weights (feature, label), chain and skip potentials (label, label), all logarithms."""
    # before any is seen, a repeated word is expected to keep its label
    features, labels, counts = [], [], [np.ones((LABELS, LABELS)), 1 + PRIOR * np.eye(LABELS)]
    for x in examples:
        f, y, *pairs = pickle.loads(x)
        features.append(f)
        labels.append(y)
        for c, found in zip(counts, pairs, strict=True):
            for (a, b), n in found:
                c[a, b] += n
                c[b, a] += n
    potentials = []
    for c in counts:
        p = c / c.sum()
        potentials.append(np.clip(np.log(p / np.outer(p.sum(1), p.sum(0))), -3, 3))
    w = np.zeros((FEATURES, LABELS))
    if features:
        x, y = np.concatenate(features), np.concatenate(labels)
        grads = np.full_like(w, 1e-8)
        rng = np.random.default_rng(0)
        for _ in range(8):
            for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
                score = w[x[rows]].sum(axis=1)
                p = np.exp(score - score.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(rows)), y[rows]] -= 1
                g = np.zeros_like(w)
                np.add.at(g, x[rows].ravel(), np.repeat(p, x.shape[1], axis=0) / len(rows))
                g += 1e-5 * w
                grads += g * g
                w -= 0.5 * g / np.sqrt(grads)
    return w, *potentials


def marginals(unary: np.ndarray, edges: list[tuple[int, int]], potentials: np.ndarray, settled: float = SETTLED) -> np.ndarray:
    """Label marginals by loopy sum-product, run until messages settle. unary: (node, label) logarithms; potentials: one (label, label) matrix per edge."""
    n = len(unary)
    belief = unary.copy()
    if edges:
        e = np.array(edges)
        source, target = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]])
        phi = np.exp(np.concatenate([potentials, potentials.transpose(0, 2, 1)]))
        m, half = np.zeros((2 * len(e), unary.shape[1])), len(e)
        back = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
        step, turn, moved = 0.5, 0, np.inf
        while moved > settled:
            out = belief[source] - m[back]
            out -= out.max(axis=1, keepdims=True)
            new = np.log(np.maximum(np.einsum("ka,kab->kb", np.exp(out), phi), 1e-300))
            new -= new.max(axis=1, keepdims=True)
            moved = step * np.abs(new - m).max()
            m = (1 - step) * m + step * new
            turn += 1
            if turn > 4 * n + 100:
                step *= 0.95
            belief = unary.copy()
            np.add.at(belief, target, m)
    p = np.exp(belief - belief.max(axis=1, keepdims=True)) if n else belief
    return p / p.sum(axis=1, keepdims=True) if n else p


def added_spans(text: str, words: list[tuple[int, int]], base: list[tuple[int, int, int]], model) -> list[tuple[int, int, int]]:
    """Spans of the words that the field labels with certainty and that meet no base span."""
    weights, chain_potential, skip_potential = model
    labels = observed(words, base)
    if all(labels):
        return []
    unary = np.stack([weights[word_features(text, s, e)].sum(axis=0) for s, e in words])
    known = np.array(labels)
    for k in np.flatnonzero(known):
        unary[k] = -30.0
        unary[k, known[k]] = 0.0
    chain, skip = edges_of(text, words)
    potentials = np.concatenate([np.repeat(p[None], len(x), axis=0) for p, x in ((chain_potential, chain), (skip_potential, skip))])
    p = marginals(unary, chain + skip, potentials)
    tied = np.zeros(len(words), bool)
    for a, b in skip:
        tied[a] |= known[b] == 1 + KINDS.index("card")
        tied[b] |= known[a] == 1 + KINDS.index("card")
    beside = {b for _, b in chain}
    runs: list[list[int]] = []  # kind, start, end, number of the last word, whether an observed card is tied to it
    for k in np.flatnonzero((p[:, 1:].max(axis=1) >= CERTAIN) & (known == 0)).tolist():
        kind = int(p[k, 1:].argmax())
        if runs and runs[-1][0] == kind and runs[-1][3] == k - 1 and k in beside:
            runs[-1][2:] = [words[k][1], k, runs[-1][4] or tied[k]]
        else:
            runs.append([kind, *words[k], k, tied[k]])
    out = []
    for kind, s, e, _, repeats in runs:
        while s < e and text[s] in "\"'([{<":
            s += 1
        while e > s and text[e - 1] in ".,;:!?)]}>\"'":
            e -= 1
        digits = _NOT_DIGIT.sub("", text[s:e])
        if s < e and (KINDS[kind] != "card" or repeats or (16 <= len(digits) <= 19 and luhn(digits))):
            out.append((kind, s, e))
    return out


def _join(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def find(column: pa.Array, model):
    """For each text: its characters, base spans and added spans."""
    for text, words in zip(column.to_pylist(), suspicious_words(column), strict=True):
        base = base_spans(text) if words else []
        yield text or "", base, added_spans(text, words, base, model) if words else []


def _labeller(model):
    def label(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                found = [(base, more) for _, base, more in find(part.column("text"), model)]
                count = [pa.array([sum(k == x[0] for x in base) for base, _ in found], pa.int64()) for k in range(len(KINDS))]
                digest = [hashlib.sha256(_join(base).encode()).hexdigest() for base, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *count, pa.array(digest, pa.string()), pa.array([_join(base + more) for base, more in found], pa.string()), pa.array([len(x[1]) for x in found], pa.int64())],
                    names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
                )

    return label


def train(docs: DataFrame, sample: int = SAMPLE, most: int = MOST):
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    # bounded: at most `sample` ids, which makes the broadcast safe
    chosen = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()
    # one row per chosen id, so what the driver gets is bounded even if ids repeat
    got = cut(rows.join(F.broadcast(chosen), "doc_id").mapInArrow(_teacher, "doc_id long, example binary").where("example is not null").groupBy("doc_id").agg(F.min("example").alias("example")))
    sizes = got.select("doc_id", F.octet_length("example").cast("long").alias("n")).toArrow()
    ids = affordable(sizes["doc_id"].to_numpy(), sizes["n"].to_numpy(), most)
    return fit((got if len(ids) == sizes.num_rows else got.where(F.col("doc_id").isin(ids))).toArrow().sort_by("doc_id").column("example").to_pylist())


def detect(docs: DataFrame, sample: int = SAMPLE, most: int = MOST) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, counts and digest of the base spans, all spans, n_added."""
    model = train(docs, sample, most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_labeller(model), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first and longest names the hole."""
    out, free = [], 0
    for s, e, kind in sorted(((s, e, k) for k, s, e in spans), key=lambda x: (x[0], -x[1])):
        if s >= free:
            out += [text[free:s], f"<{KINDS[kind].upper()}>"]
        free = max(free, e)
    return "".join([*out, text[free:]])


def redact(docs: DataFrame, sample: int = SAMPLE, most: int = MOST) -> DataFrame:
    """docs with all columns, the texts masked and n_chars (if there) counted anew. A null text stays null."""
    model = train(docs, sample, most)
    names = docs.columns

    def masked(batches):
        for batch in batches:
            column = batch.column(names.index("text"))
            slim = pa.RecordBatch.from_arrays([column], names=["text"])
            new = [mask(t, base + more) for part in chunks(slim, "text") for t, base, more in find(part.column("text"), model)]
            new = [x if ok else None for ok, x in zip(column.is_valid().to_pylist(), new, strict=True)]
            arrays = []
            for k, name in enumerate(names):
                if name == "text":
                    arrays.append(pa.array(new, batch.schema.field(k).type))
                elif name == "n_chars":
                    arrays.append(pa.array([None if x is None else len(x) for x in new], batch.schema.field(k).type))
                else:
                    arrays.append(batch.column(k))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.mapInArrow(masked, docs.schema)
