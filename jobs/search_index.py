"""Keep a word index over a folder of texts to which files are added, for full-text search.

    python jobs/search_index.py --config jobs/search_index.toml --input FOLDER --output FOLDER --checkpoint FOLDER [--find "WORDS"]

A run takes the files that are new since the last one (a file stream with a checkpoint), indexes the documents in them whose text is new or changed, and ends. A document that comes
again replaces the one before; the same text again changes nothing, an empty or null text takes the document out. What is written:

* postings/batch=N/shard=S: doc_id, token, n. Sorted by token; a word is in one shard, so a search opens one folder of each batch.
* versions/batch=N: doc_id, content_hash, lang, n_tokens. The last batch of a document says which postings count.

Every micro-batch writes partitions of its own, postings first, and compares with earlier batches only. A run that dies is repeated by Spark from its checkpoint
with the same files and overwrites the same partitions, so nothing is lost or counted twice. Work and output follow the new files; of what is stored, only ids and hashes are read.

Defined cases: of several rows of one doc_id in a batch the one of the newest file counts, in a file the greatest text; rows without doc_id are left out; an empty folder writes nothing;
other columns are ignored.
"""

from __future__ import annotations

import argparse
import logging
import sys
import tomllib
from pathlib import Path

if (_root := str(Path(__file__).resolve().parent.parent)) not in sys.path:
    sys.path.insert(0, _root)

from pyspark.sql import DataFrame, Observation, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from lattisym.functions.text import content_hash  # noqa: E402
from lattisym.operators.search import phrases, tokens  # noqa: E402

log = logging.getLogger("jobs.search_index")

#: Folders that words are dealt into. Part of the layout: an index is read with the number that it was written with.
SHARDS = 32
#: Parts, by hash of the document, that a shard's postings of a batch are sorted and written in, so a word of nearly every document is no hot spot.
DEALS = 8
INPUT = "doc_id long, text string, lang string"
POSTINGS, VERSIONS = "doc_id long, token string, n long, batch long, shard int", "doc_id long, content_hash string, lang string, n_tokens long, batch long"


def _shard(token):
    return F.pmod(F.xxhash64(token), F.lit(SHARDS)).cast("int")


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What is stored; nothing before the first write."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def versions(spark: SparkSession, target: str, before: int | None = None, only: DataFrame | None = None) -> DataFrame:
    """doc_id, content_hash, lang, n_tokens, batch of the last version of every document, of those before a batch if it is given, and of only(doc_id)."""
    rows = _stored(spark, f"{target}/versions", VERSIONS)
    rows = rows if before is None else rows.where(F.col("batch") < before)
    rows = rows if only is None else rows.join(only, "doc_id", "left_semi")
    return rows.groupBy("doc_id").agg(F.max(F.struct("batch", "content_hash", "lang", "n_tokens")).alias("v")).select("doc_id", "v.content_hash", "v.lang", "v.n_tokens", "v.batch")


def _index(rows: DataFrame, batch: int, target: str) -> None:
    """Write the postings and versions of one micro-batch; again with the same rows, the same."""
    spark = rows.sparkSession
    seen, wrote, changed = Observation(), Observation(), Observation()
    rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("doc_id").isNull()).alias("without_id")).where("doc_id is not null")
    # counted and compared before the shuffle, so a doc_id on very many rows is no hot spot
    last = rows.groupBy("doc_id").agg(F.max(F.struct("changed", "file", F.coalesce("text", F.lit("")).alias("text"), "lang")).alias("x")).select("doc_id", "x.text", "x.lang")
    last = last.withColumn("content_hash", content_hash(F.col("text")))
    # of the stored ids only those of this batch are shuffled or compared; Spark broadcasts a side only if it is small
    known = versions(spark, target, batch, rows.select("doc_id").distinct()).select("doc_id", F.col("content_hash").alias("known"))
    new = last.join(known, "doc_id", "left").where("known is null or known <> content_hash").drop("known").persist()
    try:
        words = new.select("doc_id", F.explode(tokens(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))
        postings = words.withColumn("batch", F.lit(batch).cast("long")).withColumn("shard", _shard(F.col("token"))).observe(wrote, F.count(F.lit(1)).alias("rows"))
        # dealt by hash: ranges would have all texts split and counted once more, for a sample
        dealt = postings.repartition("shard", F.pmod(F.xxhash64("doc_id"), F.lit(DEALS)))
        _write(dealt.sortWithinPartitions("shard", "token", "doc_id"), f"{target}/postings", "batch", "shard")
        of = new.select("doc_id", "content_hash", "lang", F.size(tokens(F.col("text"))).cast("long").alias("n_tokens"), F.lit(batch).cast("long").alias("batch")).observe(changed, F.count(F.lit(1)).alias("rows"))
        _write(of, f"{target}/versions", "batch")
    finally:
        new.unpersist()
    log.info("batch %d: read %s rows (%s without doc_id), indexed %s documents, wrote %s postings", batch, seen.get["rows"], seen.get["without_id"], changed.get["rows"], wrote.get["rows"])


def _write(rows: DataFrame, path: str, *parts: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def _folder(spark: SparkSession, source: str) -> tuple[str, str]:
    """The folder to watch, and which of its files: all, or the one that source is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    status = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    if status is not None and len(status) == 1 and status[0].isFile():
        return source[: -len(path.getName()) - 1], path.getName()
    return source, "*"


def run(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 200) -> int:
    """Index the files of source (a folder of Parquet files, or one file) that are new since the last run with this checkpoint; the number of micro-batches that it took."""
    folder, names = _folder(spark, source.rstrip("/"))
    files = spark.readStream.schema(INPUT).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", names).parquet(folder)
    rows = files.select("doc_id", "text", "lang", F.col("_metadata.file_modification_time").alias("changed"), F.col("_metadata.file_path").alias("file"))
    done: list[int] = []

    def take(batch: DataFrame, number: int) -> None:
        _index(batch, number, target)
        done.append(number)

    rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    log.info("%d micro-batches from %s into %s", len(done), source, target)
    return len(done)


def current(spark: SparkSession, target: str) -> DataFrame:
    """doc_id, lang, token, n of the last version of every document."""
    # few bytes a document against all its words: hashed in each partition, so the postings need no sort
    last = versions(spark, target).select("doc_id", "lang", "batch").hint("shuffle_hash")
    return _stored(spark, f"{target}/postings", POSTINGS).join(last, ["doc_id", "batch"]).select("doc_id", "lang", "token", "n")


def find(spark: SparkSession, target: str, query: str, limit: int | None = 20) -> DataFrame:
    """doc_id, n: documents that hold all words of the query, those with most of them first. Only the shards of the words are opened."""
    words = sorted({w for p in phrases(query, stemmed=False) for w in p})
    if not words:
        return spark.createDataFrame([], "doc_id long, n long")
    shards = [x.s for x in spark.createDataFrame([(w,) for w in words], "w string").select(_shard(F.col("w")).alias("s")).distinct().collect()]
    rows = _stored(spark, f"{target}/postings", POSTINGS).where(F.col("shard").isin(shards) & F.col("token").isin(words))
    hits = rows.join(versions(spark, target).select("doc_id", "batch"), ["doc_id", "batch"]).groupBy("doc_id").agg(F.count("*").alias("words"), F.sum("n").alias("n"))
    out = hits.where(F.col("words") == len(words)).select("doc_id", "n").orderBy(F.desc("n"), "doc_id")
    return out if limit is None else out.limit(limit)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Index the new files of a folder of texts.")
    for name in ("--config", "--input", "--output", "--checkpoint", "--find"):
        parser.add_argument(name)
    args = parser.parse_args(argv)
    settings = tomllib.loads(Path(args.config).read_text()) if args.config else {}
    at = lambda name: getattr(args, name) or settings.get(name) or parser.error(f"--{name} is missing")
    source, target, checkpoint = at("input"), at("output"), at("checkpoint")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("search_index").getOrCreate()
    try:
        run(spark, source, target, checkpoint, settings.get("files_per_batch", 200))
        if args.find:
            for x in find(spark, target, args.find, settings.get("show", 20)).collect():
                print(x.doc_id, x.n)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
