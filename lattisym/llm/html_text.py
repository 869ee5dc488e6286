"""Main text of web pages by site template removal.

Every page is read once into its block elements, whatever will become of them. Subtrees are hashed bottom up from the hashes of their parts,
whatever their size, the hashes are counted per host in Spark (once per distinct page, so copies of a page are one witness; counts are combined before the shuffle, so a host with a third of all
pages is no hot spot), and subtrees that recur on at least MIN_PAGES distinct pages of their host are deleted, however many pages it has. A paragraph, heading or list item is
deleted with the least box around it, by itself only if it is on over half of the distinct pages of the host. A page that would be left without text keeps what
templates would take. Templates meet the pages' subtrees in an equi-join. This comes first. Of what is left goes what templates cannot find, because it differs from page to page or because the host
has too few pages: elements that are never main text, boxes named so by a word of their class, id or role (but not an article or main, nor by the name of a category or tag), and, if a page
marks its article (article, main, role=main), all outside; without one, boxes made of links. `rule_report` counts what each rule takes.

In a marked article a list or box made of links is deleted like any other subtree, the rest only if it is on over half of the distinct pages of
its host: some articles may share a passage.

Character references are decoded, white space inside a block becomes one space, blocks are joined by an empty line.

Reading takes time in proportion to the page, however broken its markup is: nothing is looked for twice, and the open elements are found by name.

Defined cases: null or empty html, and html without text, give an empty text; a url without a host counts as one host; repeated rows come back
each and count once; markup that never closes is closed by what follows it or by the end; a comment, script or style that never ends hides the rest; after
a quotation mark that never ends, tags end at their first angle bracket; a tag that never ends is text.
"""

from __future__ import annotations

import hashlib
import html
import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, stored, texts_of

#: A subtree is a template if it is on at least so many distinct pages of a host.
MIN_PAGES = 5
#: In a marked article, a subtree that isn't made of links is a template only if it is on more than this share of the host's distinct pages too; so is a paragraph, heading or list item by itself.
ARTICLE_SHARE = 0.5

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("aside audio button canvas datalist dialog footer form head iframe map menu meter nav noscript object picture progress script search select style svg template textarea title video".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre article main body html".split())
ITEMS = frozenset("li dt dd".split())
CLOSED_BY_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
HOLDS = frozenset("article aside body div footer form header html li main nav ol section table td th ul".split())
# Words of a class, id or role that mark what is not main text.
NOISE = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies disqus footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion recommended related replies reply responses search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription toc toolbar topbar widget widgets complementary alert alertdialog dialog".split()
)

# What a class that names a category, tag, type or author of an article starts with.
TAXONOMY = frozenset("author category cat format post status tag tax term topic type".split())
#: What takes a block: nothing, its element, the name of a box, its place outside the marked article, its links.
KEPT, ELEMENT, NAMED, OUTSIDE, LINKS = range(5)
#: A block of an article that stands in a named box: taken like the box unless the page has no other article.
BOXED = 5

RULES = ((ELEMENT, "element"), (NAMED, "named"), (OUTSIDE, "outside"), (LINKS, "links"))

_NAME = re.compile(r"/?([A-Za-z][^\s/>]*)")
_QUOTED_END = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
_COMMENT_END = re.compile(r"--!?>")
_NAMES = re.compile(r"(?:^|[\s\"'])(class|id|role|hidden|aria-hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")


def is_noise(attributes: str) -> bool:
    for name, *values in _NAMES.findall(attributes):
        value = "".join(values)
        if name.lower() == "aria-hidden":
            if value.lower() == "true":
                return True
            continue
        for token in value.split():
            parts = [x.lower() for x in _PART.findall(token)]
            if len(parts) > 1 and parts[0] in TAXONOMY and parts[1] not in ("comments", "nav", "navigation"):
                continue
            if any(x in NOISE and before not in ("has", "with", "no", "without") for before, x in itertools.pairwise(["", *parts])):
                return True
    return False


def subtree_hash(markup: str) -> int:
    return int.from_bytes(hashlib.blake2b(" ".join(markup.split()).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


class _Open:
    """An open element: whether it drops what it holds, by its element (1) or by its name (2); whether it is a marked article."""

    __slots__ = ("name", "drop", "root", "first", "kids", "size", "linked")

    def __init__(self, name: str, drop: int, root: bool, first: int):
        self.name, self.drop, self.root, self.first = name, drop, root, first
        self.kids, self.size, self.linked = [], 0, 0


def tags(page: str):
    """(start, end, name, closing, attributes) of each piece of markup, in order; the name of a comment or declaration is empty. `send` a place to go on from there."""
    at, n, quoted = 0, len(page), True
    last = page.rfind(">")
    while (at := page.find("<", at)) >= 0:
        start, c = at, page[at + 1 : at + 2]
        if page.startswith("<!--", at):
            end = at + 5 if page.startswith(">", at + 4) else at + 6 if page.startswith("->", at + 4) else None
            if end is None:
                m = _COMMENT_END.search(page, at + 4)
                end = m.end() if m else n
            name, closing, attributes = "", False, ""
        elif m := _NAME.match(page, at + 1):
            if at > last:  # no tag can end any more
                return
            end = None
            if quoted:
                if q := _QUOTED_END.match(page, m.end()):
                    end = q.end()
                else:
                    quoted = False
            if end is None:
                end = page.find(">", m.end()) + 1
                if not end:
                    return
            name, closing, attributes = m[1].lower(), c == "/", page[m.end() : end - 1]
        elif c and c in "!?/":
            end = page.find(">", at + 1) + 1 or n
            name, closing, attributes = "", False, ""
        else:
            at += 1
            continue
        at = (yield start, end, name, closing, attributes) or end


def blocks(page: str) -> list[tuple[str, list[int], list[int], int]]:
    """(text, hashes that make it a template if they recur, hashes that do only on a large share of the pages, what else takes it) of all blocks, in page order. Texts only of blocks that can be kept.

    A larger subtree recurs only if its parts do, so they stand for it: a block has the hash of its own text and that of the least box around it (in an article, of the least box of links).
    """
    done: list[list] = []  # text, hash, rule, whether in an article, share of link characters, hash of the box, whether it is a paragraph or item
    free: list[int] = []  # blocks in an article without a box of links
    loose: list[int] = []  # paragraphs and items outside articles without a box
    stack: list[_Open] = []
    where: dict[str, list[int]] = {}  # places of open elements by name
    block_at: list[int] = [-1]
    holds_at: list[int] = [-1]
    pieces: list[str] = []
    linked = [0]
    span = [0, 0]
    dropped, named, roots, boxed = 0, 0, 0, 0  # how many open elements drop by element, by name, mark an article, mark one inside a named box

    def put(piece: str, start: int, end: int):
        if not pieces:
            span[0] = start
        span[1] = end
        pieces.append(piece)

    def flush():
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                within = stack[block_at[-1]].name if len(block_at) > 1 else ""
                own = subtree_hash(f"<{within}> {page[span[0] : span[1]]}")
                rule = ELEMENT if dropped else (BOXED if boxed else NAMED) if named else KEPT
                part = not within or within in PROSE or within in ITEMS
                if roots:
                    free.append(len(done))
                elif part:
                    loose.append(len(done))
                done.append([text if rule in (KEPT, BOXED) else "", own, rule, roots > 0, linked[0] / len(text), None, part])
                if stack:
                    x = stack[-1]
                    x.kids.append(own)
                    x.size += len(text)
                    x.linked += linked[0]
        linked[0] = 0

    def close(upto: int):
        nonlocal dropped, named, roots, boxed
        if block_at[-1] >= upto:
            flush()
        while len(stack) > upto:
            x = stack.pop()
            where[x.name].pop()
            if x.name in BLOCK:
                block_at.pop()
            if x.name in HOLDS:
                holds_at.pop()
            dropped -= x.drop == 1
            named -= x.drop == 2
            roots -= x.root
            boxed -= x.root and named > 0
            if not x.kids:
                continue
            mark = subtree_hash(f"<{x.name}> {' '.join(map(str, x.kids))}")
            if x.name in BLOCK and x.name not in PROSE and x.name != "head" and not x.root:
                if x.linked > 0.5 * x.size:
                    while free and free[-1] >= x.first:
                        done[free.pop()][5] = mark
                if x.name not in ITEMS:
                    while loose and loose[-1] >= x.first:
                        done[loose.pop()][5] = mark
            if stack:
                stack[-1].kids.append(mark)
                stack[-1].size += x.size
                stack[-1].linked += x.linked

    at, n, last = 0, len(page), page.rfind(">") + 1
    markup, go = tags(page), None
    while True:
        try:
            start, end, name, closing, attributes = markup.send(go)
        except StopIteration:
            break
        go = None
        if start > at:
            put(page[at:start], at, start)
            if any(x.name == "a" for x in stack[-3:]):
                linked[0] += start - at
        at = end
        if not name:
            continue
        if closing:
            k = where[name][-1] if where.get(name) else -1
            if name not in BLOCK and k < block_at[-1] or name not in HOLDS and k < holds_at[-1]:
                k = -1
            if k >= 0:
                close(k)
            elif name in BLOCK:
                flush()
            continue
        if name == "br":
            put(" ", start, at)
            continue
        if name in RAW:
            m = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at, max(at, last))
            if name in BLOCK:
                flush()
            at = go = m.end() if m else n
            continue
        if name in BLOCK:
            flush()
            if name != "option" and where.get("p") and where["p"][-1] > holds_at[-1]:  # a block ends an open paragraph
                close(where["p"][-1])
            if name in CLOSED_BY_SIBLING:
                while len(block_at) > 1 and stack[block_at[-1]].name in CLOSED_BY_SIBLING[name]:
                    close(block_at[-1])
        if name in VOID or attributes.endswith("/") and name not in BLOCK:
            continue
        mark = name in ("article", "main") or 'role="main"' in attributes
        drop = 0
        if name in DROPPED or name == "header" and not roots:
            drop = 1
        elif not mark and name not in ("html", "body", "header") and is_noise(attributes):
            drop = 2
        root = mark and not drop and not dropped
        stack.append(_Open(name, drop, root, len(done)))
        where.setdefault(name, []).append(len(stack) - 1)
        if name in BLOCK:
            block_at.append(len(stack) - 1)
        if name in HOLDS:
            holds_at.append(len(stack) - 1)
        boxed += root and named > 0
        dropped += drop == 1
        named += drop == 2
        roots += root
    if at < n:
        put(page[at:], at, n)
    close(0)
    flush()
    own_article = any(rule == KEPT and inside for _, _, rule, inside, *_ in done)
    boxed_article = not own_article and any(rule == BOXED for _, _, rule, *_ in done)
    out = []
    for text, own, rule, inside, links, box, part in done:
        if rule == BOXED:
            rule = KEPT if boxed_article else NAMED
        elif rule == KEPT and (boxed_article or own_article and not inside):
            rule = OUTSIDE
        elif rule == KEPT and not own_article and links > 0.5:
            rule = LINKS
        shared = rule == KEPT and inside or not inside and part
        out.append((text if rule == KEPT else "", ([] if box is None else [box]) if shared else [own], [own] if shared else [], rule))
    return out


KEYS = ("page_id", "url", "host", "doc_id", "twin", "same")


def _parser(batches):
    kind = pa.list_(pa.struct([("text", pa.string()), ("marks", pa.list_(pa.int64())), ("inner", pa.list_(pa.int64())), ("rule", pa.int32())]))
    for batch in batches:
        for part in chunks(batch, "html"):
            found = [blocks(x) if x else [] for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(x) for x in KEYS), pa.array([[{"text": t, "marks": m, "inner": i, "rule": r} for t, m, i, r in x] for x in found], kind)], names=[*KEYS, "blocks"]
            )


def host_of(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def parsed(rows: DataFrame) -> DataFrame:
    return rows.mapInArrow(_parser, "page_id long, url string, host string, doc_id long, twin long, same long, blocks array<struct<text:string,marks:array<long>,inner:array<long>,rule:int>>")


def templates(read: DataFrame, min_pages: int, share: float) -> DataFrame:
    """host, mark, inner: the templates of each host, with inner those that are deleted in articles too."""
    marks = read.select("host", "same", F.explode(F.array_distinct(F.flatten(F.transform("blocks", lambda b: F.concat(b["marks"], b["inner"]))))).alias("mark"))
    # both are cut off before they are joined, so that Spark can split a hot host
    often = cut(marks.groupBy("host", "mark").agg(F.count_distinct("same").alias("n")).where(F.col("n") >= min_pages))
    size = cut(read.groupBy("host").agg(F.count_distinct("same").alias("pages")))
    common = F.when(F.col("n") > F.lit(share) * F.col("pages"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    return cut(often.join(size, "host").select("host", "mark", F.explode(common).alias("inner")))


def judged(pages: DataFrame, min_pages: int, share: float) -> tuple[DataFrame, DataFrame]:
    """The pages read once, and for each page (doc_id, twin) that holds templates: their hashes (often; common for those that count in articles) and whether one of its kept blocks is one (changes)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host_of())
    # two hashes name a row by all that it holds; rows that repeat have equal verdicts
    rows = rows.withColumn("doc_id", F.xxhash64("page_id", "url", "html")).withColumn("twin", F.xxhash64("html", "url", "page_id", F.lit(1))).withColumn("same", F.xxhash64("html"))
    read = stored(parsed(rows))
    found = templates(read, min_pages, share)
    some = lambda name, keep: F.array_distinct(F.flatten(F.transform(F.filter("blocks", lambda b: (b["rule"] == KEPT) == F.lit(keep)), lambda b: b[name])))
    kinds = F.array(*(F.struct(F.lit(name == "inner").alias("inner"), F.lit(keep).alias("kept"), some(name, keep).alias("marks")) for name, keep in (("marks", True), ("marks", False), ("inner", True))))
    held = read.select("host", "doc_id", "twin", F.explode(kinds).alias("k")).select("host", "k.inner", "k.kept", F.explode("k.marks").alias("mark"), "doc_id", "twin")
    # templates are few: Spark broadcasts them if they turn out to be small, and merges otherwise
    hits = held.join(found, ["host", "mark", "inner"]).groupBy("doc_id", "twin")
    return read, cut(hits.agg(F.collect_set(F.when(~F.col("inner"), F.col("mark"))).alias("often"), F.collect_set(F.when(F.col("inner"), F.col("mark"))).alias("common"), F.max("kept").alias("changes")))


def _left(read: DataFrame, hits: DataFrame) -> DataFrame:
    """Pages without the blocks that are templates; a page of which nothing would be kept stays as it is."""
    gone = lambda b: F.coalesce(F.arrays_overlap(b["marks"], F.col("often")) | F.arrays_overlap(b["inner"], F.col("common")), F.lit(False))
    rest = F.filter("blocks", lambda b: ~gone(b))
    return read.join(hits, ["doc_id", "twin"], "left").withColumn("blocks", F.when(F.exists(rest, lambda b: b["rule"] == KEPT), rest).otherwise(F.col("blocks")))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = ARTICLE_SHARE) -> DataFrame:
    """Per row of pages(page_id, url, html): page_id, url, text, n_chars."""
    read, hits = judged(pages, min_pages, share)
    kept = F.filter("blocks", lambda b: b["rule"] == KEPT).alias("blocks")
    slim, changed = read.select("page_id", "url", "doc_id", "twin", kept), hits.where("changes")
    # pages whose templates would have gone by other rules too keep the same text: only the others are shuffled
    some, rest = texts_of(slim, changed.select("doc_id")), texts_of(slim, changed.select("doc_id"), keep=False)
    left = _left(some, changed).select("page_id", "url", "blocks").unionByName(rest.select("page_id", "url", "blocks"))
    text = F.array_join(F.transform("blocks", lambda b: b["text"]), "\n\n")
    return left.select("page_id", "url", text.alias("text")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def rule_report(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = ARTICLE_SHARE) -> DataFrame:
    """(rule, pages, blocks): on how many pages each rule takes blocks, in the order of the rules, and how many. No texts are shuffled."""
    read, hits = judged(pages, min_pages, share)
    slim = read.withColumn("blocks", F.transform("blocks", lambda b: F.struct(b["marks"].alias("marks"), b["inner"].alias("inner"), b["rule"].alias("rule"))))
    left = _left(slim.withColumn("n", F.size("blocks")), hits)
    counts = F.array(F.struct(F.lit("template").alias("rule"), (F.col("n") - F.size("blocks")).alias("n")), *(F.struct(F.lit(name).alias("rule"), F.size(F.array_compact(F.transform("blocks", _is(r)))).alias("n")) for r, name in RULES))
    return left.select(F.explode(counts).alias("x")).groupBy("x.rule").agg(F.count_if(F.col("x.n") > 0).alias("pages"), F.sum("x.n").alias("blocks"))


def _is(rule: int):
    """Of a block: true if the rule takes it, else null."""
    return lambda b: F.when(b["rule"] == rule, F.lit(True))
