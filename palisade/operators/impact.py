"""Sparse search by an impact index: blocks of postings with bounds, scored only where they can matter.

Points are put in the order of their weight, the sum of their counts times the terms' idf,
and cut into blocks of `BLOCK_POINTS`; a block is one row with its postings by term and each
term's greatest count. A query's score in a block is at most the sum of its weights times
these; a block below the query's k-th best score so far is skipped. In the others the
terms that can bring the most are added first, as far as a point that has none of them
can't get over the k-th best; the rest is added to the points met, and only if that can
lift one of them so far. A first look at the `PROBE`
heaviest blocks gives every task a k-th best to begin with. So no term is the key of a
join of postings, however frequent it is, and light points are not scored against queries
that they can't serve. Heavy blocks are most of the work: they are dealt to tasks, come first
in each, and where many queries look into one its counts become a table of terms by points.

The index holds all terms, by numbers that are hashes of them (another seed is taken if two
terms share one), so that points meet the vocabulary in no join, and is built once.
Queries are sent to tasks in blocks of at most `QUERY_BYTES`; each is a pass over the
index, of which a task takes the block's terms. Results for special rows: null ids, terms and counts take no part; repeated
(id, term) rows add up; a query without matches has no rows; ties go to the smaller
point; empty sides give none.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.sources.scratch import Scratch

from .diffs import use_small_batches
from .names import top_per

BLOCK_POINTS = 128
QUERY_BYTES = 48 << 20
#: Bytes of a query's term and what comes with it.
ROW_BYTES = 32
PROBE = 8
#: A block that so many queries look into is made a table, if that has no more cells than this; queries go by it so many at a time.
DENSE_FROM, DENSE_CELLS, DENSE_QUERIES = 64, 8 << 20, 1024
#: Terms whose idf is told apart when points are put in order; the others count as the rarest of them.
COMMON = 1 << 16
#: Places that scores are rounded to before they are compared.
PLACES = 9
SLACK = 2e-9
#: Sums in another order differ by so much of a score; what is that near a bound is not left out.
RELATIVE = 1e-12
#: Blocks of the index are long rows: few are read at once.
SHORT_GROUPS = {"parquet.block.size": str(4 << 20), "parquet.page.size.row.check.min": "4", "parquet.page.size.row.check.max": "16"}

INDEX = "weight double, points array<long>, terms array<long>, counts array<int>, most array<double>, places array<int>, tfs array<double>"
SCORED = "query_id long, point_id long, score double"


def idf(points: int, holding: int) -> float:
    return math.log(1 + (points - holding + 0.5) / (holding + 0.5))


def index_blocks(size: int):
    """mapInArrow function: (point_id, weight, terms, tfs) in order to the blocks of the index."""

    def block(rows: pa.RecordBatch) -> pa.RecordBatch:
        points, sizes = rows.column("point_id"), pc.list_value_length(rows.column("terms")).to_numpy(zero_copy_only=False)
        terms, tfs = (rows.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("terms", "tfs"))
        order = np.argsort(terms, kind="stable")
        names, starts, counts = np.unique(terms[order], return_index=True, return_counts=True)
        columns = [(points, pa.int64()), (names, pa.int64()), (counts, pa.int32()), (np.maximum.reduceat(tfs[order], starts), pa.float64()), (np.repeat(np.arange(len(points)), sizes)[order], pa.int32()), (tfs[order], pa.float64())]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x).cast(kind)) for x, kind in columns]
        return pa.record_batch([rows.column("weight")[:1], *lists], names=["weight", "points", "terms", "counts", "most", "places", "tfs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from (block(batch.slice(at, size)) for at in range(0, batch.num_rows, size))

    return run


class Queries:
    """Some queries' weights by term, in one row after the other, and what each has found."""

    def __init__(self, weights: dict[int, dict[int, float] | tuple[np.ndarray, np.ndarray]], least: dict[int, float], k: int, own: bool):
        self.ids, self.k, self.own = list(weights), k, own
        each = [w if isinstance(w, tuple) else (np.fromiter(w, np.int64, len(w)), np.fromiter(w.values(), float, len(w))) for w in weights.values()]
        self.terms, self.weights = [terms for terms, _ in each], [w for _, w in each]
        self.flat_terms, self.flat_weights = np.concatenate(self.terms), np.concatenate(self.weights)
        self.starts = np.concatenate([[0], np.cumsum([len(t) for t in self.terms])[:-1]])
        self.least = np.array([least[q] for q in self.ids])
        self.best: list[list[tuple[float, int]]] = [[] for _ in self.ids]
        self._names = np.array(self.ids, np.int64)
        self.scored = 0  # postings, or cells of a block's table

    @staticmethod
    def _low(least: np.ndarray) -> np.ndarray:
        return least - SLACK - RELATIVE * np.abs(least)

    def add(self, q: int, scores: np.ndarray, points: np.ndarray) -> None:
        found = sorted([*self.best[q], *((-s, p) for s, p in zip(scores.tolist(), points.tolist()))])[: self.k]
        self.best[q] = found
        if len(found) == self.k:
            self.least[q] = max(self.least[q], -found[-1][0])

    def _postings(self, q: int, which: np.ndarray, ends: np.ndarray, size: np.ndarray, places: np.ndarray, tfs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the postings of some of a query's terms."""
        terms = self.terms[q][which]
        n = size[terms]
        at = np.repeat(ends[terms] - np.cumsum(n), n) + np.arange(n.sum())
        return places[at], np.repeat(self.weights[q][which], n) * tfs[at]

    def _score_many(self, which: np.ndarray, low: np.ndarray, points: np.ndarray, terms: np.ndarray, of: np.ndarray, places: np.ndarray, tfs: np.ndarray, width: int) -> None:
        """Adds what a block has for many queries: its counts as a table, of which a query takes its terms' rows."""
        table = np.zeros((len(terms) + 1, len(points)))  # the last row is of terms that the block has not
        table[of, places] = tfs
        row = np.full(width, len(terms))
        row[terms] = np.arange(len(terms))
        for part in np.split(which, range(DENSE_QUERIES, len(which), DENSE_QUERIES)):
            rounded = np.round(np.array([self.weights[q] @ table[row[self.terms[q]]] for q in part.tolist()]), PLACES)
            found = (rounded > 0) & (rounded >= low[part, None])
            if not self.own:
                found &= points != self._names[part, None]
            self.scored += rounded.size
            for i in np.flatnonzero(found.any(1)).tolist():
                self._add_best(part[i], rounded[i], points, found[i])

    def _add_best(self, q: int, scores: np.ndarray, points: np.ndarray, found: np.ndarray) -> None:
        at = np.flatnonzero(found)
        if len(at) > self.k:
            at = at[np.lexsort((points[at], -scores[at]))[: self.k]]
        self.add(q, scores[at], points[at])

    def score(self, points: np.ndarray, terms: np.ndarray, counts: np.ndarray, most: np.ndarray, places: np.ndarray, tfs: np.ndarray, width: int) -> None:
        """Adds what a block has for the queries."""
        top, ends = np.zeros(width), np.zeros(width, np.int64)
        top[terms], ends[terms] = most, np.cumsum(counts)
        size = np.zeros(width, np.int64)
        size[terms] = counts
        bounds = np.add.reduceat(self.flat_weights * top[self.flat_terms], self.starts)
        n, low = len(points), self._low(self.least)
        which = np.flatnonzero((bounds > 0) & (bounds >= low))
        if len(which) >= DENSE_FROM and (len(terms) + 1) * n <= DENSE_CELLS:
            self._score_many(which, low, points, terms, np.repeat(np.arange(len(terms)), counts), places, tfs, width)
            return
        for q in which.tolist():
            brings = self.weights[q] * top[self.terms[q]]
            order = np.argsort(-brings, kind="stable")[: np.count_nonzero(brings)]
            rest = np.cumsum(brings[order][::-1])[::-1]
            first = np.count_nonzero(rest >= low[q])  # terms that can still bring in a new point
            at, add = self._postings(q, order[:first], ends, size, places, tfs)
            total = np.bincount(at, add, n)
            met = total > 0
            if first < len(order) and (total[met] + rest[first] >= low[q]).any():
                more, gain = self._postings(q, order[first:], ends, size, places, tfs)
                seen = met[more]
                total += np.bincount(more[seen], gain[seen], n)
                at = np.concatenate([at, more[seen]])
            self.scored += len(at)
            rounded = np.round(total, PLACES)
            found = met & (rounded >= low[q])
            if not self.own:
                found &= points != self.ids[q]
            self._add_best(q, rounded, points, found)


def score_blocks(weights: dict[int, tuple[np.ndarray, np.ndarray]], least: dict[int, float], vocabulary: np.ndarray, k: int, own: bool):
    """mapInArrow function: blocks of the index to the task's k best points of each query.

    weights: places in the vocabulary, which are the queries' terms in order, and what they weigh.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = Queries(weights, least, k, own)
        for batch in batches:
            for row in range(batch.num_rows):
                points, terms, counts, most, places, tfs = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in ("points", "terms", "counts", "most", "places", "tfs"))
                at = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
                asked = vocabulary[at] == terms
                of = np.repeat(asked, counts)
                queries.score(points, at[asked], counts[asked], most[asked], places[of], tfs[of], len(vocabulary))
        rows = [(q, p, -s) for q, found in zip(queries.ids, queries.best) for s, p in found]
        yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "point_id", "score"])

    return run


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (id, terms), with repeats, to bags (id, terms, tfs), each term once; none without terms."""
    for batch in batches:
        lists = batch.column("terms")
        of = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(lists).fill_null(0)))
        coded = lists.flatten().dictionary_encode()
        kinds = max(1, len(coded.dictionary))
        found, tfs = np.unique(of * kinds + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        some, starts = np.unique(found // kinds, return_index=True)
        ends = pa.array([*starts.tolist(), len(found)], pa.int32())
        columns = [coded.dictionary.take(pa.array(found % kinds)), pa.array(tfs.astype(float))]
        yield pa.record_batch([batch.column(0).take(pa.array(some)), *(pa.ListArray.from_arrays(ends, c) for c in columns)], names=[batch.schema.names[0], "terms", "tfs"])


def bags_of(lists: DataFrame, id_: str) -> DataFrame:
    """(id, terms), with repeats and several rows an id, to (id, terms, tfs): one bag an id, each term once.

    Without repeated ids nothing is shuffled. Arrow batches of the session are set to 4 MB, unless they are smaller.
    """
    use_small_batches(lists.sparkSession)
    rows = lists.select(F.col(id_).cast("long").alias(id_), "terms").filter(F.col(id_).isNotNull())
    if rows.groupBy(id_).count().filter("count > 1").head(1):
        rows = rows.groupBy(id_).agg(F.flatten(F.collect_list("terms")).alias("terms"))
    return rows.mapInArrow(summed, f"{id_} long, terms array<string>, tfs array<double>")


def _bags(rows: DataFrame, id_: str) -> DataFrame:
    """(id, term, tf) in any number of rows to bags, with one shuffle."""
    rows = rows.select(F.col(id_).cast("long").alias(id_), "term", F.col("tf").cast("double").alias("tf")).filter(f"{id_} is not null and term is not null and tf > 0")
    counts = rows.repartition(id_).groupBy(id_, "term").agg(F.sum("tf").alias("tf"))
    return counts.groupBy(id_).agg(F.collect_list(F.col("term").cast("string")).alias("terms"), F.collect_list("tf").alias("tfs"))


def number(term: Column, seed: int) -> Column:
    return F.xxhash64(term, F.lit(seed))


def _numbered(corpus: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """Every term with its number and the points that hold it, and the seed by which no two terms have one number."""
    held = corpus.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    held = scratch.save(held, "vocabulary")
    for seed in itertools.count():
        out = held.withColumn("number", number(F.col("term"), seed))
        if not out.groupBy("number").count().filter("count > 1").head(1):
            return out, seed


def weigh(numbers: np.ndarray, idfs: np.ndarray, rare: float):
    """mapInArrow function: (point_id, terms, tfs), terms by number, with the points' weights; rare: idf of terms not among the numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, tfs = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("terms", "tfs"))
            at = np.minimum(np.searchsorted(numbers, terms), len(numbers) - 1)
            of = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(batch.column("terms"))))
            weight = np.bincount(of, tfs * np.where(numbers[at] == terms, idfs[at], rare), batch.num_rows)
            yield pa.record_batch([*batch.columns, pa.array(weight)], names=["point_id", "terms", "tfs", "weight"])

    return run


def build_index(corpus: DataFrame, vocabulary: DataFrame, points: int, seed: int, block_points: int = BLOCK_POINTS) -> DataFrame:
    """corpus (point_id, terms, tfs), one bag a point, and vocabulary (n, number) to the blocks of the index, dealt to tasks."""
    common = vocabulary.select("number", "n").orderBy(F.desc("n"), "number").limit(COMMON).toArrow()  # a bounded table, which only puts points in order
    numbers, held = (common.column(c).to_numpy() for c in ("number", "n"))
    order = np.argsort(numbers)
    idfs = np.log(1 + (points - held + 0.5) / (held + 0.5))
    numbered = corpus.select("point_id", F.transform("terms", lambda t: number(t, seed)).alias("terms"), "tfs")
    weighed = numbered.mapInArrow(weigh(numbers[order], idfs[order], float(idfs.max(initial=0.0))), "point_id long, terms array<long>, tfs array<double>, weight double")
    parts = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = weighed.repartitionByRange(parts, F.desc("weight"), "point_id").sortWithinPartitions(F.desc("weight"), "point_id")
    blocks = ordered.select("point_id", "weight", "terms", "tfs").mapInArrow(index_blocks(block_points), INDEX)
    # heavy blocks are most of the work: they are dealt out, and come first in each task
    return blocks.repartition(parts).sortWithinPartitions(F.desc("weight"))


def _block_top_k(weights: DataFrame, index: DataFrame, first: DataFrame, points: int, k: int, least: float, own: bool) -> DataFrame | None:
    """weights (query_id, number, tf, n) of a block of queries to their k best of the index; first: its heaviest blocks."""
    rows = weights.toArrow()  # a block of queries
    ids, numbers, tfs, held = (rows.column(c).to_numpy() for c in ("query_id", "number", "tf", "n"))
    if not len(ids):
        return None
    order = np.lexsort((numbers, held, ids))
    vocabulary, places = np.unique(numbers[order], return_inverse=True)
    kinds, which = np.unique(held[order], return_inverse=True)
    weigh = tfs[order] * np.array([idf(points, n) for n in kinds.tolist()])[which]
    names, starts = np.unique(ids[order], return_index=True)
    asked = dict(zip(names.tolist(), zip(np.split(places, starts[1:]), np.split(weigh, starts[1:]))))
    best = lambda blocks, floor: top_per(blocks.mapInArrow(score_blocks(asked, floor, vocabulary, k, own), SCORED).filter(F.col("score") >= float(least)), ["query_id"], [F.desc("score"), "point_id"], k)
    floor = dict.fromkeys(asked, float(least))
    for r in best(first, floor).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth")).filter(F.col("n") == k).collect():
        floor[r["query_id"]] = max(floor[r["query_id"]], r["kth"])  # a row for each query of the block
    return best(index, floor)


def sparse_top_k(queries: DataFrame, corpus: DataFrame, k: int, least: float = 0.0, own: bool = True, query_bytes: int = QUERY_BYTES, block_points: int = BLOCK_POINTS) -> DataFrame:
    """queries (query_id, term, tf), corpus (point_id, term, tf) to (query_id, point_id, score): each query's k best by the summed tf * tf * idf.

    idf is ln(1 + (N - n + 0.5) / (n + 0.5)) over the corpus; counts are not negative.
    """
    return search(_bags(queries, "query_id"), _bags(corpus, "point_id"), k, least, own, query_bytes, block_points)


def search(queries: DataFrame, corpus: DataFrame, k: int, least: float = 0.0, own: bool = True, query_bytes: int = QUERY_BYTES, block_points: int = BLOCK_POINTS) -> DataFrame:
    """sparse_top_k of bags: queries (query_id, terms, tfs), corpus (point_id, terms, tfs), one an id and each term once."""
    scratch = Scratch(corpus.sparkSession, "impact")
    corpus = scratch.save(corpus, "point_id")
    points = corpus.count()
    vocabulary, seed = _numbered(corpus, scratch)
    asked = queries.select("query_id", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("query_id", F.col("t.terms").alias("term"), F.col("t.tfs").alias("tf"))
    weights = scratch.save(asked.join(vocabulary, "term").select("query_id", "number", "tf", "n"), "weights")
    index = scratch.save(build_index(corpus, vocabulary, points, seed, block_points), "index", **SHORT_GROUPS)
    first = scratch.save(index.orderBy(F.desc("weight")).limit(PROBE), "first", **SHORT_GROUPS).repartition(PROBE)
    blocks, out = max(1, -(-weights.count() * ROW_BYTES // query_bytes)), None
    for block in range(blocks):
        found = _block_top_k(weights.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block), index, first, points, k, least, own)
        if found is not None:
            out = found if out is None else out.unionByName(found)
    return corpus.sparkSession.createDataFrame([], SCORED) if out is None else out
