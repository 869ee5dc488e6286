"""Keeping a stored graph fresh from a stream of file versions. An extension: the batch refresh is the operator, this runs it per micro-batch.

`effective` keeps, per file, the version and the hash that it last let through, as state of the stream: versions that arrive late and texts that don't differ go no further, whatever
micro-batch they come in, and a restart goes on from the state in the checkpoint.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.extract import upsert
from ..plans import store


#: The state store that such state needs.
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
CHANGES = "file_path string, source string, version long"


class _Newest(StatefulProcessor):
    """State of a file: the version and content hash that were let through last; the hash of a deleted file is empty."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "version long, hash string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        version, known = self.last.get() if self.last.exists() else (None, None)
        newest = None
        for part in rows:  # one row is kept, however many versions of the file come at once
            for v, text in zip(part["version"].tolist(), part["source"].tolist(), strict=True):
                text = text if isinstance(text, str) else None
                if newest is None or (v, text or "", text is not None) > (newest[0], newest[1] or "", newest[1] is not None):
                    newest = (v, text)
        if newest is None or version is not None and newest[0] <= version:
            return
        digest = "" if newest[1] is None else hashlib.sha256(newest[1].encode("utf-8", "replace")).hexdigest()
        self.last.update((int(newest[0]), digest))
        if digest != (known or ""):
            yield pd.DataFrame({"file_path": [key[0]], "source": [newest[1]], "version": [int(newest[0])]})

    def close(self) -> None:
        pass


def effective(changes: DataFrame) -> DataFrame:
    """Of a streaming (file_path, source, version) what changes a file: no version that is older than one let through before, no text equal to it. A null source deletes. Needs ROCKS when the stream starts."""
    rows = changes.selectExpr("file_path", "source", "cast(version as long) as version").where("file_path is not null and version is not null")
    return rows.groupBy("file_path").transformWithStateInPandas(_Newest(), CHANGES, "Update", "None")


def apply_changes(spark, changes: DataFrame, place: str) -> None:
    """Apply file versions (file_path, source, version; a null source deletes) to the stored graph at place; the last version of a path counts."""
    last = store._cut(upsert(changes.select("file_path", "source", "version"), ["file_path"], "version").drop("version"))
    kept = last.where("source is not null")
    if store.current(spark, place) is None:
        store.save(spark, store.build(kept), place)
        return
    store.migrate(spark, place)

    def change(old: store.Graph) -> store.Graph:
        # only the files of the batch are compared, parsed and hashed; of the stored ones their hashes are looked up in their buckets
        known = store._part(old, "files", store._buckets_of(last, old.held["buckets"])).join(last, "file_path", "left_semi")
        found = store._cut(store.diff(known, store.hashes(kept)).where("status <> 'same'"))
        return old if found.isEmpty() else store.apply(old, found, kept)

    store.update(spark, place, change)


def stream_into(changes: DataFrame, place: str, checkpoint: str, stateful: bool = False) -> StreamingQuery:
    """Run apply_changes for each micro-batch of a streaming (file_path, source, version); with `stateful`, only for what `effective` lets through."""
    spark = changes.sparkSession
    key, store_class = ROCKS
    before = spark.conf.get(key, None)
    if stateful:
        changes = effective(changes)
        spark.conf.set(key, store_class)
    try:  # a stream has its own copy of the settings once it is started
        out = changes.writeStream.outputMode("update") if stateful else changes.writeStream
        return out.foreachBatch(lambda df, _: apply_changes(df.sparkSession, df, place)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if stateful:
            spark.conf.unset(key) if before is None else spark.conf.set(key, before)
