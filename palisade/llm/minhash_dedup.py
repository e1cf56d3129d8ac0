"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

The set of a document is its distinct word shingles, five words each unless said otherwise. The sketch has `bands * rows`
coordinates. Round i of 2t throws every shingle into one coordinate by a hash of its
own; rounds t to 2t - 1 throw all shingles into coordinate i - t, so every coordinate
fills. A coordinate keeps the least (round, hash). Sets of similarity s agree in a
coordinate with chance s, with strong concentration, so that 40 bands of 4 rows miss a
pair of similarity 0.8 with chance 7e-10.

Texts of the same words in the same order (lower-cased; told by a 128-bit cryptographic
digest of their bytes) are one class at once. In a bucket of equal bands every class is
held against the bucket's least class on the full sets of shingles, which are compared
word by word and not by hashes. Buckets that still span several components
are taken up again: some classes outside the main component become pivots and are held
against the bucket, until each bucket's classes are linked or compared. Pivots and
classes meet in cells of a bounded size, a large bucket being many cells; a cell gives
back only the links that join components it has not yet seen joined, never its pairs.

Results for special rows: null or empty text and text without words has no shingles and
stays alone; rows with equal doc_id are one document; a null doc_id is linked with
nothing and kept. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .kernels import BYTE_BASE, Slab, bytes_of, cuts, gram_hashes, halves, mix, shingle_numbers, slab_of, slabs
from .workspace import Workspace

SHINGLE = 5
PERCENT = 80
BANDS = 40
ROWS = 4
#: Classes outside a bucket's main component that are held against the bucket in the first round, and times more in each next one.
PIVOTS = 64
GROWTH = 16
#: Bytes of text, about, that a cell has on either side, besides one text that is longer.
CELL_BYTES = 1 << 19

EMPTY = np.uint64(2**64 - 1)
SKETCH_SCHEMA = "doc_id long, n_shingles long, d1 long, d2 long, n_bytes long, bands array<long>"


def round_seeds(t: int) -> np.ndarray:
    return mix(np.arange(1, 2 * t + 1, dtype=np.uint64) * np.uint64(BYTE_BASE))


def sketch(shingles: np.ndarray, t: int, seeds: np.ndarray) -> np.ndarray:
    """The t coordinates of a non-empty set of 64-bit hashes."""
    out = np.full(t, EMPTY)
    at, chunk = 0, max(1, min(2 * t, math.ceil(t * (math.log(t) + 2) / len(shingles))))
    while at < 2 * t:
        to = min(2 * t, at + chunk)
        rounds = np.arange(at, to, dtype=np.uint64)[:, None]
        hashes = mix(shingles[None, :] ^ seeds[at:to, None])
        bins = ((hashes >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
        if to > t:
            bins = np.where(rounds < t, bins, rounds - np.uint64(t))
        values = (rounds << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))
        np.minimum.at(out, bins.ravel().astype(np.intp), values.ravel())
        if out.max() != EMPTY:  # later rounds can't lower a filled coordinate
            break
        at = to
    return out


def shingle_hashes(slab: Slab, k: int) -> Iterator[np.ndarray]:
    """One 64-bit hash for each distinct shingle of each row; fewer than k words are one shingle."""
    hashes, numbers = gram_hashes(slab.hashes, k), shingle_numbers(slab.numbers, k)
    for a, b in zip(slab.first.tolist(), slab.first[1:].tolist()):
        if b - a >= k:
            yield hashes[a + np.unique(numbers[a : b - k + 1], return_index=True)[1]]
        elif b > a:
            yield gram_hashes(slab.hashes[a:b], b - a)
        else:
            yield slab.hashes[:0]


def shingle_sets(slab: Slab, k: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each row, by their numbers; fewer than k words are one shingle."""
    numbers, short, out = shingle_numbers(slab.numbers, k), {}, []
    for a, b in zip(slab.first.tolist(), slab.first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(numbers[a : b - k + 1]))
        else:
            whole = tuple(slab.numbers[a:b].tolist())
            out.append(np.full(1, -1 - short.setdefault(whole, len(short))) if whole else numbers[:0])
    return out


def sketch_rows(k: int, bands: int, rows: int):
    """mapInArrow function: (doc_id, text) to set size, digest of the words in order, and band keys."""
    t = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = round_seeds(t)
        salt = mix(np.arange(bands, dtype=np.uint64) + np.uint64(7))
        for batch in batches:
            sizes, digests, keys = [], [], []
            for slab in slabs(batch.column("text"), lower=True):
                digests += slab.digests(slab.first[:-1], slab.first[1:])
                for s in shingle_hashes(slab, k):
                    sizes.append(len(s))
                    keys.append((gram_hashes(sketch(s, t, seeds), rows)[::rows] ^ salt).view(np.int64) if len(s) else [])
            yield pa.record_batch(
                [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), *map(pa.array, halves(digests)), pc.binary_length(batch.column("text")).cast(pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "d1", "d2", "n_bytes", "bands"],
            )

    return run


def similar_rows(k: int, percent: int):
    """mapInArrow function: (a, b, text_a, text_b) to the pairs whose full sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (bytes_of(batch.column(c)) for c in ("text_a", "text_b"))
            linked = []
            for i, j in cuts([len(x) + len(y) for x, y in zip(left, right)]):
                sets = shingle_sets(slab_of(left[i:j] + right[i:j], lower=True), k)
                for x, y in zip(sets, sets[j - i :]):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    union = len(x) + len(y) - both
                    linked.append(bool(union) and 100 * both >= percent * union)
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return run


def cell_links(k: int, percent: int):
    """applyInArrow function: a cell's classes and pivots to the links that join two components."""

    def run(classes: pa.Table, pivots: pa.Table) -> pa.Table:
        if not len(pivots) or not len(classes):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        texts = [t for side in (pivots, classes) for t in bytes_of(side.column("text"))]
        found = shingle_sets(slab_of(texts, lower=True), k)  # one slab, so that both sides' shingles have the same numbers
        sets, others = found[: len(pivots)], found[len(pivots) :]
        sizes, labels = np.array([len(s) for s in sets]), np.array(pivots.column("label"), np.int64)
        shingles, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(shingles, kind="stable")
        shingles, owners = shingles[order], owners[order]
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while x in root:
                x = root[x]
            return x

        links = []
        for s, label in zip(others, classes.column("label").to_pylist()):
            low, high = np.searchsorted(shingles, s, "left"), np.searchsorted(shingles, s, "right")
            n = high - low
            at = np.repeat(high - np.cumsum(n), n) + np.arange(n.sum())  # the places low..high of every shingle, in a row
            both = np.bincount(owners[at], minlength=len(sets))
            for other in np.unique(labels[100 * both >= percent * (len(s) + sizes - both)]).tolist():
                x, y = sorted((top(label), top(other)))
                if x != y:
                    root[y] = x
                    links.append((label, other))
        return pa.table([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def _star_links(pairs: DataFrame, texts: DataFrame, k: int, percent: int, workspace: Workspace) -> DataFrame:
    """The similar ones of the pairs (a, b) of a class and a bucket's least class."""
    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    rows = pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b")
    return workspace.save(rows.mapInArrow(similar_rows(k, percent), "a long, b long, linked boolean").filter("linked").select("a", "b"), "verified")


def _relabelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with the label that labels (id, label) has for theirs."""
    return rows.join(labels.select(F.col("id").alias("label"), F.col("label").alias("_to")), "label", "left").withColumn("label", F.coalesce("_to", "label")).drop("_to")


def near_duplicates(
    documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, workspace: Workspace | None = None, pivots: int = PIVOTS, cell_bytes: int = CELL_BYTES
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document."""
    spark = documents.sparkSession
    workspace = workspace or Workspace(spark, "minhash")
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = workspace.save(documents.mapInArrow(sketch_rows(shingle, bands, rows), SKETCH_SCHEMA), "sketches")

    lasting, workspace = workspace, workspace.inner("rounds")
    classes = sketches.filter("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("owner"))
    classes = workspace.save(classes, "classes")
    owners = sketches.join(classes.select(F.col("owner").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    members = workspace.save(owners.select("doc_id", "n_bytes", F.explode("bands").alias("band")), "members")
    full = members.groupBy("band").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).filter("least < last").select("band", "least")
    # two tables, and nothing grouped above the join, so that a hot bucket's rows can be split at run time
    buckets = workspace.save(members.join(workspace.save(full, "full"), "band").select("band", "doc_id", "least", "n_bytes"), "buckets")

    texts = workspace.save(documents.join(buckets.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")
    pairs = buckets.filter("doc_id <> least").select(F.col("doc_id").alias("a"), F.col("least").alias("b")).distinct()
    maps = [components(_star_links(pairs, texts, shingle, percent, workspace), workspace)]

    # a least class has been held against all others of its bucket; what is left must be linked without it
    open_ = _relabelled(buckets.filter("doc_id <> least").select("band", "doc_id", "n_bytes", F.col("doc_id").alias("label")), maps[0])
    while True:
        open_ = workspace.save(open_, "open")
        parts = open_.groupBy("band", "label").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("bytes"))
        stats = parts.groupBy("band").agg(
            F.max_by("label", F.struct("n", "label")).alias("main"), (F.sum("n") - F.max("n")).alias("n_out"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count("*").alias("parts")
        )
        stats = stats.filter("parts > 1").select(
            "band", "main", "n_out", F.ceil(F.col("bytes") / cell_bytes).alias("chunks"), F.ceil(F.least("n_out", F.lit(pivots)) * F.col("bytes") / F.col("n") / cell_bytes).alias("blocks")
        )
        stats = workspace.save(stats, "stats")  # a table, so that a hot bucket's rows can be split at run time
        place = lambda seed, of: F.pmod(F.xxhash64("doc_id", F.lit(seed)), of)
        chosen = (F.col("label") != F.col("main")) & (place(len(maps), F.lit(1 << 20)) * F.col("n_out") < pivots * (1 << 20))
        spread = workspace.save(open_.join(stats, "band").withColumn("chosen", chosen), "spread")
        if spread.limit(1).count() == 0:
            break
        steps = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
        left = spread.select("band", "label", "doc_id", place(-1, F.col("chunks")).alias("chunk"), steps(F.col("blocks")).alias("block"))
        right = spread.filter("chosen").select("band", "label", "doc_id", steps(F.col("chunks")).alias("chunk"), place(-2, F.col("blocks")).alias("block"))
        cell = ["band", "chunk", "block"]
        right = right.join(texts, "doc_id")
        right = right.select(*(F.col(c).alias(c) for c in right.columns))  # columns of their own, else the two sides can't be told apart
        held = left.join(texts, "doc_id").groupBy(*cell).cogroup(right.groupBy(*cell))
        links = workspace.save(held.applyInArrow(cell_links(shingle, percent), "a long, b long").distinct(), "links")
        open_ = spread.filter("not chosen").select("band", "doc_id", "n_bytes", "label")
        if links.limit(1).count():
            maps.append(components(links, workspace))
            open_ = _relabelled(open_, maps[-1])
        pivots *= GROWTH

    group = classes.withColumn("label", F.col("owner"))
    for labels in maps:
        group = _relabelled(group, labels)
    group = lasting.save(group.select("d1", "d2", "label"), "components")
    workspace.release()
    found = sketches.join(group.select("d1", "d2", F.col("label").alias("component")), ["d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=2)
