"""Substring dedup over a log-structured fingerprint index.

A window is `window` consecutive words of one document. Each window picks one
fingerprint, the least hash of its `gram`-word grams; equal windows pick equal
fingerprints. A document's windows that pick the same fingerprint and stand next to each
other are a run. The index keeps every run content once, with the first document that had
it. Contents and windows are told by 128-bit cryptographic digests of the words
themselves; the hashes of grams only choose what is looked at.

The index is a log of immutable sorted files, bucketed by content. `lookup` merge-joins a
batch with every file: contents that the history has are repeats at once; for contents
that only share a fingerprint with others (a passage in other surroundings) the windows
themselves are compared, over the texts of the historical documents concerned. `append`
writes the batch's new contents as one more file, and `compact` merges the files into one
when there are more than `fan_in`. The index survives the session: `open` finds it again,
so that the next batch is held against all before it.

Arrival decides: a batch loses the windows that an earlier batch has, and those that a
smaller doc_id of the same batch has. `removal_spans` deals a table in ranges of rising
doc_id, so there arrival and doc_id are one order.

Results for special rows: null or empty text has no words; a text under `window` words
loses nothing; rows with equal doc_id are taken as one document, whose spans are those of
any of its texts; a null doc_id matches nothing and loses nothing. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import Slab, gram_hashes, halves, mix, slabs, sliding_min
from .workspace import Workspace

WINDOW = 50
GRAM = 10
#: Ranges of doc_id that enter the index one after the other, files kept before they are merged, and buckets of a file.
BATCHES = 3
FAN_IN = 1
BUCKETS = 32

RUN_SCHEMA = "fp long, c1 long, c2 long, doc_id long, start int, len int, again boolean"
ENTRY_SCHEMA = "c1 long, c2 long, fp long, doc_id long, start int, len int"
WINDOW_SCHEMA = "w1 long, w2 long, doc_id long, start int"
RESULT_SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"
CONTENT = ["c1", "c2"]


def _window_minima(slab: Slab, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of whole windows in the slab's words, and the fingerprint each picks."""
    least = sliding_min(gram_hashes(slab.hashes, gram), window - gram + 1)
    at = np.flatnonzero(slab.same_row(window))
    return at, least[at]


def run_rows(window: int, gram: int):
    """mapInArrow function: documents (doc_id, text) to their runs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for slab in slabs(batch.column("text")):
                at, fp = _window_minima(slab, window, gram)
                if not len(at):
                    continue
                row = slab.row_of(at)
                begin = np.flatnonzero(np.concatenate([[True], (fp[1:] != fp[:-1]) | (row[1:] != row[:-1])]))
                length = np.diff(np.append(begin, len(at)))
                start = at[begin]
                c1, c2 = halves(slab.digests(start, start + length + window - 1))
                again = np.ones(len(begin), bool)  # its document has had such a run before
                again[np.unique(mix(c1.view(np.uint64) ^ mix(row[begin].astype(np.uint64))), return_index=True)[1]] = False
                yield pa.record_batch(
                    [
                        pa.array(fp[begin].view(np.int64)), pa.array(c1), pa.array(c2), pa.array(ids[slab.rows[row[begin]]].astype(np.int64)),
                        pa.array((start - slab.first[row[begin]]).astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(again),
                    ],
                    names=["fp", "c1", "c2", "doc_id", "start", "len", "again"],
                )

    return rows


def window_rows(window: int):
    """mapInArrow function: (doc_id, text, spans) to the windows that start in the spans."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            spans = batch.column("spans").to_pylist()
            for slab in slabs(batch.column("text")):
                wanted = np.zeros(len(slab.at), bool)
                for row, first in zip(slab.rows, slab.first):
                    for span in spans[row]:
                        wanted[first + span["start"] : first + span["end"]] = True
                same = slab.same_row(window)
                at = np.flatnonzero(wanted[: len(same)] & same)
                row = slab.row_of(at)
                yield pa.record_batch(
                    [*map(pa.array, halves(slab.digests(at, at + window))), pa.array(ids[slab.rows[row]].astype(np.int64)), pa.array((at - slab.first[row]).astype(np.int32))],
                    names=["w1", "w2", "doc_id", "start"],
                )

    return rows


def removal_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (doc_id, text, spans) to the digest of what is kept."""
    for batch in batches:
        counts, removed, digests = [], [], []
        for text, spans in zip(batch.column("text").cast(pa.large_binary()), batch.column("spans")):
            words, spans = (text.as_py() or b"").split(), spans.as_py() or ()
            counts.append(len(words))
            if spans:
                kept = np.ones(len(words), bool)
                for span in spans:
                    kept[span["start"] : span["end"]] = False
                words = [words[i] for i in np.flatnonzero(kept).tolist()]
            removed.append(counts[-1] - len(words))
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.record_batch(
            [batch.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"],
        )


class FingerprintIndex:
    """A log of immutable files of run contents (c1, c2, fp, doc_id, start, len) under one folder.

    Each file is bucketed and sorted by content, so that a lookup joins it with a batch
    without shuffling history; raise `buckets` with the history, to about 1 GB a bucket.
    A content stands in one file only. `manifest` rows name the files that count; a file
    whose write was lost is in no manifest and is never read.
    """

    def __init__(self, spark: SparkSession, folder: str, fan_in: int = FAN_IN, window: int = WINDOW, gram: int = GRAM, buckets: int = BUCKETS):
        self.spark, self.folder, self.fan_in, self.window, self.gram, self.buckets = spark, folder, fan_in, window, gram, buckets
        self.version, self.files = 0, []  # (table, path, buckets)

    @staticmethod
    def open(spark: SparkSession, folder: str, fan_in: int = FAN_IN) -> FingerprintIndex:
        """The index as the last append or compaction left it."""
        rows = spark.read.schema("version int, position int, path string, buckets int, window int, gram int").json(f"{folder}/manifest")
        last = rows.filter(F.col("version") == rows.agg(F.max("version")).first()[0]).orderBy("position").collect()  # a row a file
        index = FingerprintIndex(spark, folder, fan_in, last[0]["window"], last[0]["gram"], last[0]["buckets"])
        index.version = last[0]["version"]
        for r in last:
            table = f"fingerprints_{uuid.uuid4().hex}"
            spark.sql(f"CREATE TABLE {table} (c1 BIGINT, c2 BIGINT, fp BIGINT, doc_id BIGINT, start INT, len INT) USING parquet CLUSTERED BY (c1, c2) SORTED BY (c1, c2) INTO {r['buckets']} BUCKETS LOCATION '{r['path']}'")
            index.files.append((table, r["path"], r["buckets"]))
        return index

    def _write(self, entries: DataFrame, name: str) -> tuple[str, str, int]:
        table, path = f"fingerprints_{uuid.uuid4().hex}", f"{self.folder}/{name}-{uuid.uuid4().hex}"
        entries = entries.select(*[c.split()[0] for c in ENTRY_SCHEMA.split(", ")]).repartition(self.buckets, *CONTENT)  # one file a bucket
        entries.write.format("parquet").option("path", path).bucketBy(self.buckets, *CONTENT).sortBy(*CONTENT).saveAsTable(table)
        return table, path, self.buckets

    def _commit(self) -> None:
        self.version += 1
        rows = [(self.version, i, path, buckets, self.window, self.gram) for i, (_, path, buckets) in enumerate(self.files)]
        self.spark.createDataFrame(rows, "version int, position int, path string, buckets int, window int, gram int").coalesce(1).write.mode("append").json(f"{self.folder}/manifest")

    def entries(self) -> DataFrame | None:
        """All contents of history."""
        out = None
        for table, _, _ in self.files:
            one = self.spark.table(table)
            out = one if out is None else out.unionByName(one)
        return out

    def append(self, entries: DataFrame) -> None:
        """Writes contents that no file has yet as one more sorted file."""
        self.files.append(self._write(entries, "file"))
        old = self.files[:]
        if len(self.files) > self.fan_in:
            self.files = [self._write(self.entries(), "compacted")]
        self._commit()
        if len(old) > len(self.files):  # after the manifest names the new file alone
            self._forget(old)

    def compact(self) -> None:
        """Merges all files into one."""
        if len(self.files) > 1:
            old, self.files = self.files, [self._write(self.entries(), "compacted")]
            self._commit()
            self._forget(old)

    def _forget(self, files: list[tuple[str, str, int]]) -> None:
        for table, path, _ in files:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            Workspace.delete(self.spark, path)

    def close(self) -> None:
        """Takes the tables' names out of the session; the files stay."""
        for table, _, _ in self.files:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def lookup(self, batch: DataFrame, history: DataFrame | None, workspace: Workspace) -> tuple[DataFrame, DataFrame]:
        """batch and history (doc_id, text) to (spans (doc_id, start, end) of repeats, new contents to append).

        history holds the documents of the batches before; only those that share a
        fingerprint with a new content are read.
        """
        window = self.window
        runs = workspace.save(batch.mapInArrow(run_rows(window, self.gram), RUN_SCHEMA), "runs")
        # one row for each content of the batch: its smallest document's first such run
        folded = runs.groupBy(*CONTENT).agg(F.min(F.struct("doc_id", "start", "len")).alias("first"), F.first("fp").alias("fp"), F.count("*").alias("n"))
        if self.files:
            folded = workspace.save(folded, "batch")
        for table, _, _ in self.files:  # a merge join with each sorted file
            folded = folded.join(self.spark.table(table).select(*CONTENT, F.lit(True).alias("had")), CONTENT, "left")
            folded = folded.withColumn("known", F.coalesce("known", "had") if "known" in folded.columns else F.col("had")).drop("had")
        if not self.files:
            folded = folded.withColumn("known", F.lit(None).cast("boolean"))
        folded = workspace.save(folded.select(*CONTENT, "fp", "first", "n", F.coalesce("known", F.lit(False)).alias("known")), "folded")
        repeated = folded.filter("known or n > 1").select(*CONTENT, F.when(~F.col("known"), F.col("first.doc_id")).alias("owner"))
        whole = runs.select(*CONTENT, "doc_id", "start", "len").join(repeated, CONTENT).filter("owner is null or doc_id > owner").select("doc_id", "start", (F.col("start") + F.col("len") + window - 1).alias("end"))

        new = folded.filter("not known").select(*CONTENT, "fp", "first.doc_id", "first.start", "first.len")
        prints, held = new.select("fp"), self.entries()
        if held is not None:
            before = workspace.save(held.join(prints, "fp", "left_semi").select("fp", "doc_id", "start", "len"), "before")
            prints = prints.unionByName(before.select("fp"))
        shared = workspace.save(prints.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select("fp"), "shared")
        places = ["doc_id", "start", "len"]
        open_runs = new.join(shared, "fp", "left_semi").select(*places).unionByName(runs.filter("again").join(shared, "fp", "left_semi").select(*places))
        windows = workspace.save(self._windows(batch, open_runs), "windows")
        seen = windows.select("w1", "w2", "doc_id", F.lit(False).alias("old"))
        if held is not None:
            old = self._windows(history, before.select(*places))  # each shares its fingerprint with a new content
            seen = seen.unionByName(old.select("w1", "w2", F.lit(None).cast("long").alias("doc_id"), F.lit(True).alias("old")))
        least = seen.groupBy("w1", "w2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.bool_or("old").alias("old"))
        # a table of its own, so that a hot window's rows can be split at run time
        least = workspace.save(least.filter("owner is not null and (old or owner < last)").select("w1", "w2", F.when(~F.col("old"), F.col("owner")).alias("owner")), "least")
        part = windows.join(least, ["w1", "w2"]).filter("owner is null or doc_id > owner").select("doc_id", "start", (F.col("start") + window).alias("end"))
        return whole.unionByName(part), new

    def _windows(self, documents: DataFrame, runs: DataFrame) -> DataFrame:
        by_doc = runs.groupBy("doc_id").agg(F.collect_list(F.struct("start", (F.col("start") + F.col("len")).alias("end"))).alias("spans"))
        return documents.join(by_doc, "doc_id").mapInArrow(window_rows(self.window), WINDOW_SCHEMA)


def removal_spans(documents: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, workspace: Workspace | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, spans array<struct<start,end>>: the words that a smaller document also has.

    Documents enter the index in `batches` ranges of doc_id; each is looked up before it
    is appended.
    """
    spark = documents.sparkSession
    workspace = workspace or Workspace(spark, "substring")
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    low, high = documents.agg(F.min("doc_id"), F.max("doc_id")).first()
    low, high = (low, high) if low is not None else (0, 0)
    cuts = sorted({low + (high - low + 1) * i // batches for i in range(batches)} | {high + 1})
    index = FingerprintIndex(spark, f"{workspace.root}/index-{uuid.uuid4().hex}", fan_in, window, gram)
    found = []
    for a, b in zip(cuts, cuts[1:]):
        batch = documents.filter((F.col("doc_id") >= a) & (F.col("doc_id") < b))
        inner = workspace.inner("batch")
        spans, new = index.lookup(batch, documents.filter(F.col("doc_id") < a), inner)
        found.append(workspace.save(spans, "spans"))
        if b <= high:  # no batch follows the last
            index.append(new)
        inner.release()
    index.close()
    Workspace.delete(spark, index.folder)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def substring_dedup(documents: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, workspace: Workspace | None = None) -> DataFrame:
    """One row per document: words, words removed, and the digest of the words kept."""
    spans = removal_spans(documents, window, gram, batches, workspace)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.join(spans, "doc_id", "left").mapInArrow(removal_rows, RESULT_SCHEMA)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
