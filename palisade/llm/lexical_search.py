"""Ranked lexical search by windowed bucket scoring over an inverted index.

Documents are numbered by their doc_id; a window is `WINDOW` consecutive numbers. One pass
over the texts gives each document its length and its counts of the query items' terms;
rows are dealt by window, and each window becomes one row of an index: its documents'
lengths and, term by term, the postings (place in the window, count). The index gives the
statistics (documents, words, document frequencies). A second job reads it: window by
window, an item's postings are scatter-added into an array of the window's size that stays
in the processor's cache, a bitset tells which places were met, and those above the least
score of the item's heap are harvested into it. Each task returns its heaps, which are
merged. Scores are whole numbers of 64 bits, so that they do not depend on any order.

Items are taken in blocks of at most `QUERY_BYTES` of text, or of one item that is longer;
each block is a pass over the documents, so that what is sent to tasks is bounded.

Results for special rows: a null or empty text has no terms, and neither counts as a
document nor as an item; rows with equal doc_id are one document, the one with the fewest
words; rows with equal item_id are one item, the one with the least text; null ids take no
part; an empty table on either side gives an empty result; terms in every document may
weigh nothing; very sparse doc_ids are right but slow, as each window is visited; other
columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .kernels import bytes_of, cuts, slab_of
from .workspace import Workspace

TOP = 20
#: Numbers of a window: its scores take 16 KB.
WINDOW = 2048
#: Bytes of query text whose terms are sent to the tasks at once.
QUERY_BYTES = 8 << 20
#: The scoring formula: a document's length counts a quarter, saturation at 1.2 (fixed values).
SHARE, UNIT, SATURATION, FULL = 25, 100, 12, 1_000_000_000

#: A-Z in lower case, bytes that part terms as spaces.
_TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))

FORWARD = "window long, doc_id long, n long, terms array<int>, tfs array<int>"
INDEX = "window long, n_docs long, n_words long, slots array<int>, lengths array<long>, terms array<int>, counts array<int>, places array<int>, tfs array<int>"
HITS = "item int, doc_id long, score long"


def _lists(sizes: np.ndarray, values: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def forward_rows(vocabulary: list[bytes]):
    """mapInArrow function: (doc_id, text) to each document's length and its counts of the vocabulary's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, v = pa.array([w + b" " for w in vocabulary], pa.large_binary()), max(1, len(vocabulary))
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            texts = [t.translate(_TERMS) for t in bytes_of(batch.column("text"))]
            for a, b in cuts([len(t) for t in texts]):
                slab = slab_of(texts[a:b])
                # a slab's words keep the space behind them
                words = pa.Array.from_buffers(pa.large_binary(), len(slab.at) - 1, [None, pa.py_buffer(slab.at.astype(np.int64)), pa.py_buffer(slab.data)]).dictionary_encode()
                terms = pc.index_in(words.dictionary, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
                terms = terms[words.indices.to_numpy(zero_copy_only=False)] if len(terms) else np.zeros(0, np.int32)
                hits = np.flatnonzero(terms >= 0)
                keys, tfs = np.unique(slab.row_of(hits) * v + terms[hits], return_counts=True)
                sizes = np.diff(np.searchsorted(keys, np.arange(b - a + 1) * v))
                yield pa.record_batch(
                    [pa.array(ids[a:b] // WINDOW), pa.array(ids[a:b]), pa.array(slab.n_words), _lists(sizes, keys % v), _lists(sizes, tfs)], names=["window", "doc_id", "n", "terms", "tfs"]
                )

    return run


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _block(window: int, parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """A window's row of the index."""
    slots, lengths, sizes, terms, tfs = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(terms, kind="stable")
    names, counts = np.unique(terms, return_counts=True)
    lists = [[slots, pa.int32()], [lengths, pa.int64()], [names, pa.int32()], [counts, pa.int32()], [np.repeat(slots, sizes)[order], pa.int32()], [tfs[order], pa.int32()]]
    columns = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x).cast(kind)) for x, kind in lists]
    heads = [pa.array([x], pa.int64()) for x in (window, int(np.count_nonzero(lengths)), int(lengths.sum()))]
    return pa.record_batch(heads + columns, names=["window", "n_docs", "n_words", "slots", "lengths", "terms", "counts", "places", "tfs"])


def index_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: documents sorted by window and doc_id to a row of the index for each window."""
    window, parts, last = None, [], None
    for batch in batches:
        ids, windows, lengths = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "window", "n"))
        sizes = pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False)
        terms, tfs, ends = _flat(batch.column("terms")), _flat(batch.column("tfs")), np.concatenate([[0], np.cumsum(sizes)])
        new = np.ones(len(ids), bool)
        new[1:] = ids[1:] != ids[:-1]
        if len(ids) and last is not None:
            new[0] = ids[0] != last
        last = ids[-1] if len(ids) else last
        edges = [0, *(np.flatnonzero(windows[1:] != windows[:-1]) + 1).tolist(), len(ids)] if len(ids) else []
        for a, b in zip(edges, edges[1:]):
            if parts and windows[a] != window:
                yield _block(window, parts)
                parts = []
            window, keep = int(windows[a]), new[a:b]
            postings = np.repeat(keep, sizes[a:b])
            parts.append(((ids[a:b] - window * WINDOW)[keep], lengths[a:b][keep], sizes[a:b][keep], terms[ends[a] : ends[b]][postings], tfs[ends[a] : ends[b]][postings]))
    if parts:
        yield _block(window, parts)


def score_windows(items: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, n_docs: int, n_words: int, top: int):
    """mapInArrow function: rows of the index to the task's best documents of each item, given as (terms, repeats)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list[tuple[int, int]]] = [[] for _ in items]
        scores, met, norm = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, bool), np.zeros(WINDOW, np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                window = batch.column("window")[row].as_py()
                slots, lengths, terms, counts, places, tfs = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in ("slots", "lengths", "terms", "counts", "places", "tfs"))
                norm[slots] = UNIT - SHARE + (SHARE * lengths * n_docs) // max(1, n_words)
                tf = tfs.astype(np.int64)
                impacts = np.repeat(weights[terms], counts) * ((FULL * tf) // (1000 * tf + SATURATION * norm[places]))
                start, end = np.zeros(len(weights), np.int64), np.zeros(len(weights), np.int64)
                end[terms] = np.cumsum(counts)
                start[terms] = end[terms] - counts
                for heap, (names, repeats) in zip(heaps, items):
                    scores.fill(0), met.fill(False)
                    for a, b, r in zip(start[names].tolist(), end[names].tolist(), repeats):
                        if a < b:
                            at = places[a:b]
                            scores[at] += impacts[a:b] * r if r > 1 else impacts[a:b]
                            met[at] = True
                    found = np.flatnonzero(met & (scores >= (heap[0][0] if len(heap) == top else 1)))
                    for slot in found[np.argsort(-scores[found], kind="stable")[:top]].tolist():  # equal scores by ascending place
                        entry = (int(scores[slot]), -(window * WINDOW + slot))
                        if len(heap) < top:
                            heapq.heappush(heap, entry)
                        elif entry > heap[0]:
                            heapq.heapreplace(heap, entry)
        rows = [(i, -d, s) for i, heap in enumerate(heaps) for s, d in heap]
        yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["item", "doc_id", "score"])

    return run


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _block_hits(documents: DataFrame, queries: list, top: int, workspace: Workspace) -> DataFrame:
    """The best documents of each task for the items (item_id, text) of one block."""
    spark = documents.sparkSession
    bags = [(q["item_id"], Counter(q["text"].encode().translate(_TERMS).split())) for q in queries]
    bags = [(i, bag) for i, bag in bags if bag]
    vocabulary = sorted({w for _, bag in bags for w in bag})
    number = {w: i for i, w in enumerate(vocabulary)}
    forward = documents.mapInArrow(forward_rows(vocabulary), FORWARD).repartition("window").sortWithinPartitions("window", "doc_id", "n", "terms", "tfs")
    index = workspace.save(forward.mapInArrow(index_windows, INDEX), "index")
    totals = index.agg(F.sum("n_docs"), F.sum("n_words")).first()
    n_docs, n_words = totals[0] or 0, totals[1] or 0
    weights = np.zeros(max(1, len(vocabulary)), np.int64)
    held = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("df"))
    for r in held.collect():  # at most a row for each term of the block
        weights[r["terms"]] = weight(n_docs, r["df"])
    items = []
    for _, bag in bags:
        terms = np.array([number[w] for w in bag], np.int64)
        items.append((terms[weights[terms] > 0], [r for w, r in bag.items() if weights[number[w]] > 0]))
    hits = index.mapInArrow(score_windows(items, weights, n_docs, n_words, top), HITS)
    names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(bags)], "item int, item_id long")
    return hits.join(F.broadcast(names), "item").select("item_id", "doc_id", "score")  # names: one row for each item of the block


def ranked_search(documents: DataFrame, items: DataFrame, top: int = TOP, query_bytes: int = QUERY_BYTES, workspace: Workspace | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: the best documents of each item."""
    spark = documents.sparkSession
    workspace = workspace or Workspace(spark, "lexical")
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    items = workspace.save(items, "items")
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // query_bytes))
    out = None
    for block in range(blocks):
        queries = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()  # about query_bytes
        found = _block_hits(documents, queries, top, workspace)
        out = found if out is None else out.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _terms_sql(table: str, key: str) -> str:
    lower = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return rf"SELECT {key}, unnest(regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM {table} WHERE text IS NOT NULL"


ORACLE = f"""
WITH words AS ({_terms_sql("documents", "doc_id")}), wanted AS ({_terms_sql("benchmark", "item_id")}),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM lengths),
postings AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM wanted) GROUP BY doc_id, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, totals GROUP BY term, docs),
impacts AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))) AS impact
  FROM postings JOIN weights USING (term) JOIN lengths USING (doc_id), totals
),
scores AS (SELECT item_id, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM wanted JOIN impacts USING (term) GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
