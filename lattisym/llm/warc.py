"""WARC archives of pages, and a capture index by external merge.

Record heads are built by column expressions; each record becomes a gzip member of its own, so a reader can seek to any offset of the index. The members
go through Spark's text sink (any file system that Spark can write; a lost executor's files are written again), into archives of about FILE_BYTES.
Payloads that occur more than once are stored once: the capture with the largest page_id is the response, the others are revisits that refer to it.
Only payloads whose digest may be repeated, by a filter of bounded size, are shuffled to find that out.

Reading unpacks one record after another and checks every stored payload against its digest. Each archive gives a run of captures that is
sorted on its own; runs are dealt by ranges of (URL key, timestamp, page), as many as the captures need, and in each range a loser tree merges the sorted
pieces that arrive, without another sort. So the index is globally ordered. Ranges are cut by the whole key: captures of one URL, however many, are spread over ranges by time.

Defined cases: null html is an empty payload; a null url becomes an empty target; a null page_id is smaller than any other and stays null
(of equal payloads without any page_id all are responses); rows that repeat with the largest page_id are all responses.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, key_filter, passes, shared_dir

#: Payloads below this size are never revisits.
LEAST_SHARED = 1000
#: Bytes (compressed) after which an archive is closed; one record may go beyond.
FILE_BYTES = 32 << 20
#: Captures that one task merges.
RANGE_ROWS = 200_000
#: Time of the capture of page 0; each page is one second after the page before.
FIRST_CAPTURE = "2024-01-01 00:00:00"
END = "\r\n\r\n"

SCHEMA = "run string, offset long, length long, urlkey string, stamp string, url string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def payloads(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) as page_id, url, payload, payload_bytes, payload_digest."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    return rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1(F.col("payload").cast("binary")))


def _digest_key():
    return F.xxhash64("payload_digest", "payload_bytes")


def repeated(rows: DataFrame) -> DataFrame:
    """payload_digest, payload_bytes, last: payloads of at least LEAST_SHARED bytes that occur more than once, and the largest page_id of each."""
    slim = rows.where(F.col("payload_bytes") >= LEAST_SHARED).select("payload_digest", "payload_bytes", "page_id")
    # cut off before it is joined, so that Spark can split a payload with very many captures
    return cut(slim.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n"))


def typed(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows with record_type and refers_to."""
    rows = rows.join(keys.hint("merge"), ["payload_digest", "payload_bytes"], "left")
    again = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    # a revisit's payload isn't stored
    return rows.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("last"))).drop("last")


def _identity(page: str):
    return F.concat(F.lit("<urn:capture:"), F.coalesce(F.col(page).cast("string"), F.lit("none")), F.lit(">"))


def records(rows: DataFrame) -> DataFrame:
    """Head and payload of one WARC record per capture; the payload of a revisit is empty."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = F.col("record_type") == "revisit"
    target = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    seconds = F.coalesce(F.col("page_id"), F.lit(0)) % F.lit(3_000_000_000)
    date = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(FIRST_CAPTURE)) + seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    size = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _identity("page_id")),
        line("WARC-Date", date),
        line("WARC-Target-URI", target),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(revisit, F.concat(line("WARC-Refers-To", _identity("refers_to")), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", size.cast("string")),
        F.lit("\r\n"),
        http,
    )
    return rows.select(head.alias("head"), F.when(revisit, F.lit("")).otherwise(F.col("payload")).alias("payload"))


def member(record: bytes) -> bytes:
    """A record as a gzip member without its last byte, which is always zero: it is the separator that the text sink puts between members.

    That byte is the highest of the record's size. A record of 16 MB or more is followed by an empty member, which readers skip.
    """
    out = gzip.compress(record, 6, mtime=0)
    return (out if out[-1] == 0 else out + gzip.compress(b"", 6, mtime=0))[:-1]


def _packer(file_bytes: int):
    def pack(batches):
        part = held = 0
        for batch in batches:
            made = []
            for head, payload in zip(batch.column("head"), batch.column("payload"), strict=True):
                made.append(member(head.as_py().encode() + payload.as_py().encode() + END.encode()))
            parts = []
            for x in made:
                if held >= file_bytes:
                    part, held = part + 1, 0
                held += len(x)
                parts.append(part)
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), pa.array(parts, pa.int32())], names=["value", "part"])

    return pack


def _chooser(only, keep: bool):
    def choose(batches):
        for batch in batches:
            ids = batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            yield batch.filter(pa.array(passes(ids, *only.value) == keep))

    return choose


def write_archives(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Write one WARC record per row of pages(page_id, url, html) into archives below path: gzip members, one per record."""
    rows = payloads(pages)
    keys = repeated(rows)
    only = pages.sparkSession.sparkContext.broadcast(key_filter(keys.select(_digest_key().alias("key")), "key"))
    keyed = rows.withColumn("key", _digest_key())
    # payloads that no other capture has stay where they are
    some, rest = (keyed.mapInArrow(_chooser(only, keep), keyed.schema).drop("key") for keep in (True, False))
    rest = rest.withColumn("record_type", F.lit("response")).withColumn("refers_to", F.lit(None).cast("long"))
    for name, part in (("shared", typed(some, keys)), ("single", rest)):
        made = records(part).mapInArrow(_packer(file_bytes), "value binary, part int")
        made.select(F.col("value").cast("string").alias("value"), "part").write.option("lineSep", "\0").partitionBy("part").text(f"{path}/{name}")


def url_key(url: str) -> str:
    """Sort-friendly form of a URL: host labels reversed, without scheme and www, the rest in lower case."""
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)(.*)", url, re.S)
    if not m:
        return url.lower()
    host = re.sub(r"^www\d*\.", "", m[1].lower().partition(":")[0])
    return ",".join(reversed(host.split("."))) + ")" + (m[2].partition("#")[0].lower() or "/")


def members(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, unpacked bytes) of each gzip member, one at a time; empty ones are left out."""
    view, at = memoryview(content), 0
    while at < len(view):
        engine, out, s = zlib.decompressobj(31), [], at
        while not engine.eof:
            if s >= len(view):
                raise ValueError(f"member at {at} has no end")
            out.append(engine.decompress(view[s : s + (1 << 16)]))
            s += 1 << 16
        end = min(s, len(view)) - len(engine.unused_data)
        if any(out):
            yield at, end - at, b"".join(out)
        at = end


def parse_archive(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of every record of an archive; offsets are those of the gzip members in the file."""
    mark = END.encode()
    for at, length, record in members(content):
        head = record.find(mark)
        if head < 0 or not record.startswith(b"WARC/"):
            raise ValueError(f"no record at {at}")
        lines = record[:head].decode("utf-8", "replace").split("\r\n")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        start = head + len(mark)
        stop = start + int(headers["content-length"])
        if record[stop:] != mark:
            raise ValueError(f"record at {at} has no end")
        yield at, length, headers, record[start:stop]


def _page(identity: str | None) -> int | None:
    m = re.fullmatch(r"<urn:capture:(-?\d+)>", identity or "")
    return int(m[1]) if m else None


def capture(run: str, offset: int, length: int, headers: dict[str, str], block: bytes) -> tuple:
    """The index entry of a record; a stored payload must have the digest that its record claims."""
    http, _, payload = block.partition(END.encode())
    digest = headers["warc-payload-digest"].partition(":")[2]
    if headers["warc-type"] == "response":
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"payload of {headers['warc-record-id']} differs from its digest")
        size = len(payload)
    else:
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    url = headers["warc-target-uri"]
    return run, offset, length, url_key(url), re.sub(r"\D", "", headers["warc-date"]), url, _page(headers["warc-record-id"]), size, digest, headers["warc-type"], _page(headers.get("warc-refers-to"))


def _key(x: tuple) -> tuple:
    return x[3], x[4], x[6] is not None, x[6] or 0, x[0], x[1]


def _reader(batches):
    """A sorted run of captures for each archive."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64() if x.endswith("long") else pa.string() for x in SCHEMA.split(", ")]
    for batch in batches:
        for k in range(batch.num_rows):
            run, content = batch.column("path")[k].as_py(), batch.column("content")[k].as_py()
            rows = sorted((capture(run, *x) for x in parse_archive(content)), key=_key)
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives below path; those of one archive are a sorted run."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path).select("path", "content").mapInArrow(_reader, SCHEMA)


class LoserTree:
    """k-way merge of sorted sequences: inner nodes keep the loser of their match, so each row costs one path of comparisons."""

    def __init__(self, runs: list, key=_key):
        self.runs = [iter(r) for r in runs]
        self.key = key
        self.k = max(1, len(runs))
        self.heads: list = [None] * self.k
        self.keys: list = [None] * self.k  # None: this run is at its end
        for i in range(len(runs)):
            self._pull(i)
        self.losers = [-1] * self.k
        self.winner = self._build(1) if self.k > 1 else 0

    def _pull(self, i: int) -> None:
        self.heads[i] = next(self.runs[i], None)
        self.keys[i] = None if self.heads[i] is None else self.key(self.heads[i])

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        winner, self.losers[node] = (a, b) if self._beats(a, b) else (b, a)
        return winner

    def __iter__(self):
        while self.runs and self.keys[self.winner] is not None:
            yield self.heads[self.winner]
            self._pull(self.winner)
            now, node = self.winner, (self.winner + self.k) // 2
            while node:
                if not self._beats(now, self.losers[node]):
                    now, self.losers[node] = self.losers[node], now
                node //= 2
            self.winner = now


def natural_runs(rows: Iterator[tuple], key=_key) -> list[list[tuple]]:
    """The rows cut where the order breaks: each piece is sorted."""
    runs: list[list[tuple]] = []
    last = None
    for row in rows:
        now = key(row)
        if last is None or now < last:
            runs.append([])
        runs[-1].append(row)
        last = now
    return runs


def _merger(batches):
    """Merge the sorted pieces of one range, which holds about RANGE_ROWS captures."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64() if x.endswith("long") else pa.string() for x in SCHEMA.split(", ")]
    rows = (row for batch in batches for row in zip(*(batch.column(n).to_pylist() for n in names), strict=True))
    merged = iter(LoserTree(natural_runs(rows)))
    while some := [x for _, x in zip(range(10_000), merged, strict=False)]:
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*some, strict=True), kinds, strict=True)], names=names)


def capture_index(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures in the order of (urlkey, stamp, page_id): a partition's rows are in order, and all after those of the partition before."""
    n = max(1, -(-runs.count() // range_rows))
    return runs.repartitionByRange(n, "urlkey", "stamp", "page_id", "run", "offset").mapInArrow(_merger, SCHEMA)


def archive_and_index(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write pages to archives (below path, or a new folder of the shared one), read them back and give the merged index."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return capture_index(cut(read_archives(spark, path)))
