"""Similarity retrieval: filtered top-k, gates, fusion, votes, ranking, dedupe.

Queries are a stated set; all rows are scored against them, in blocks. Results for special
rows: a null vector scores null and is no match, a vector without length scores 0; a query
without matches has no rows; repeated points are matches of their own; ties go to the
smaller point_id; points of equal id and other columns of any name are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions.scalars import SENIORITY, SUPPRESS_AT, bucket, cosine, identifiers, logistic, lookup, recency, vote_multiplier

from . import impact
from .names import fresh, ranked, top_per

SIMILARITY, CANDIDATES, TOP_K, RRF = 0.25, 10, 3, 2
RERANK_LEAST, SPARSE_LEAST = 0.0, 10.0
#: Bytes of query vectors up to which they are sent to every task; beyond, queries and corpus meet in cells of so many.
BLOCK_BYTES = 32 << 20
#: Pairs of a query and a point whose scores are held at once.
TILE = 1 << 20

_PAIRS = "query_id long, point_id long, score double"


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit rows of a column of vectors; a shorter one is filled with zeros, one without length stays zero."""
    size = np.asarray(pc.list_value_length(column), np.int64)
    out = np.zeros((len(size), size.max(initial=0)))
    out[np.arange(out.shape[1]) < size[:, None]] = np.asarray(pc.list_flatten(column), float)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def _scores(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    width = min(queries.shape[1], points.shape[1])
    return queries[:, :width] @ points[:, :width].T


class Best:
    """The k best points of each query so far, ties to the smaller point."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.scores, self.points = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)

    def add(self, scores: np.ndarray, points: np.ndarray, first: int = 0) -> None:
        """Scores of the points for as many queries, from the `first` one on."""
        old, k = slice(first, first + len(scores)), self.k
        floor = self.scores[old, -1]
        near = (scores >= floor[:, None]) & (scores > -np.inf)
        if scores.shape[1] > k and np.count_nonzero(near) > 4 * k * len(scores):
            # no point under the k-th best of these can stay; NaN stands last
            kth = -np.partition(np.where(near, -scores, np.inf), k - 1, axis=1)[:, k - 1]
            near &= scores >= kth[:, None]
        rows, at = np.nonzero(near)
        changed = np.unique(rows)
        if not len(changed):
            return
        rows = np.concatenate([rows, np.repeat(changed, k)])
        found = np.concatenate([scores[near], self.scores[old][changed].ravel()])
        names = np.concatenate([points[at], self.points[old][changed].ravel()])
        order = np.lexsort((names, -found, rows))
        starts = np.searchsorted(rows[order], changed)
        order = order[starts[:, None] + np.arange(k)]  # a row holds k places from before
        self.scores[first + changed], self.points[first + changed] = found[order], names[order]

    def scan(self, queries: np.ndarray, vectors: np.ndarray, points: np.ndarray, threshold: float | None, own: bool) -> None:
        """Scores points for the queries, a tile of at most `TILE` pairs at a time."""
        high = max(1, min(len(queries), int(TILE**0.5)))
        wide = max(1, TILE // high)
        for a in range(0, len(queries), high):
            ids = self.ids[a : a + high]
            for b in range(0, len(points), wide):
                scores = _scores(queries[a : a + high], vectors[b : b + wide])
                self.add(_masked(scores, ids, points[b : b + wide], threshold, own), points[b : b + wide], a)

    def rows(self) -> pa.RecordBatch:
        real = self.scores.ravel() > -np.inf
        ids = np.repeat(self.ids, self.scores.shape[1])
        return pa.record_batch([pa.array(ids[real], pa.int64()), pa.array(self.points.ravel()[real], pa.int64()), pa.array(self.scores.ravel()[real], pa.float64())], names=["query_id", "point_id", "score"])


def _masked(scores: np.ndarray, ids: np.ndarray, points: np.ndarray, threshold: float | None, own: bool) -> np.ndarray:
    if threshold is not None:
        scores = np.where(scores >= threshold, scores, -np.inf)
    for j in () if own else np.flatnonzero(np.isin(points, ids)):
        scores[ids == points[j], j] = -np.inf
    return scores


def nearest_points(queries: DataFrame, corpus: DataFrame, k: int = CANDIDATES, threshold: float | None = None, own: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """queries (query_id, vector), corpus (point_id, vector) to (query_id, point_id, score): each query's k best.

    own: whether a point with the query's id may match. A task keeps k rows a query, which
    are merged by query; of scores it holds a tile at a time.
    """
    queries = queries.filter("vector is not null and query_id is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
    corpus = corpus.filter("vector is not null and point_id is not null").select(F.col("point_id").cast("long").alias("point_id"), F.col("vector").cast("array<double>").alias("vector"))
    size = lambda df: df.agg(F.sum(16 + 8 * F.size("vector"))).first()[0] or 0
    asked = size(queries)
    if asked <= block_bytes:  # proven to fit
        table = queries.toArrow()
        sent = corpus.sparkSession.sparkContext.broadcast((np.array(table.column("query_id"), np.int64), _matrix(table.column("vector"))))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vectors = sent.value
            best = Best(ids, k)
            for batch in batches:
                best.scan(vectors, _matrix(batch.column("vector")), np.array(batch.column("point_id"), np.int64), threshold, own)
            yield best.rows()

        found = corpus.mapInArrow(scan, _PAIRS)
    else:
        blocks, chunks = -(-asked // block_bytes), max(1, -(-size(corpus) // block_bytes))
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(int(n) - 1)))
        q = queries.withColumn("b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("c", spread(chunks))
        p = corpus.withColumn("c", F.pmod(F.xxhash64("point_id"), F.lit(chunks)).cast("int")).withColumn("b", spread(blocks))

        def cell(left: pa.Table, right: pa.Table) -> pa.Table:
            ids, points = np.array(left.column("query_id"), np.int64), np.array(right.column("point_id"), np.int64)
            best = Best(ids, k)
            if len(ids) and len(points):
                best.scan(_matrix(left.column("vector")), _matrix(right.column("vector")), points, threshold, own)
            return pa.Table.from_batches([best.rows()])

        found = q.groupBy("b", "c").cogroup(p.groupBy("b", "c")).applyInArrow(cell, _PAIRS)
    return top_per(found, ["query_id"], [F.desc("score"), "point_id"], k)


def top_k(queries: DataFrame, corpus: DataFrame, k: int = CANDIDATES, threshold: float | None = None, language: str | None = None, own: bool = True) -> DataFrame:
    """queries (query_id, vector), corpus (point_id, vector, …) to the k most similar points per query, with score and rank.

    language: only points of it; null or empty for all.
    """
    if language:
        corpus = corpus.filter(F.col("language") == language)
    found = ranked(nearest_points(queries, corpus, k, threshold, own), ["query_id"], [F.desc("score"), "point_id"], "rank")
    return found.join(corpus, "point_id")  # k rows a query


def twin_margin(matches: DataFrame, queries: DataFrame) -> DataFrame:
    """Adds sim_fixed and twin_margin = cos(query, fixed) - cos(query, vector); null if either is missing."""
    name = fresh("_q", matches)
    q = queries.select("query_id", F.col("vector").alias(name))
    out = matches.join(q, "query_id").withColumn("sim_fixed", cosine(F.col(name), F.col("fixed")))
    return out.withColumn("twin_margin", F.col("sim_fixed") - cosine(F.col(name), F.col("vector"))).drop(name)


def passes_twin(matches: DataFrame, least: float | None) -> DataFrame:
    """A missing margin passes, and so does everything when the gate is off."""
    return matches if least is None else matches.filter(F.col("twin_margin").isNull() | (F.col("twin_margin") >= least))


def sparse_terms(texts: DataFrame, id_: str, text: str, hashed: bool = True) -> DataFrame:
    """(id, term, tf): identifiers and the parts of snake_case ones, by bucket number or as they are."""
    tokens = texts.select(id_, F.explode(identifiers(F.col(text))).alias("token"))
    return tokens.groupBy(id_, (bucket(F.col("token")) if hashed else F.col("token")).alias("term")).agg(F.count("*").alias("tf"))


def sparse_bags(texts: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, terms, tfs): a row for each id with what `sparse_terms` gives in a row a term, as they are; none without terms."""
    return impact.bags_of(texts.select(id_, identifiers(F.col(text)).alias("terms")), id_)


def sparse_top_k(queries: DataFrame, corpus: DataFrame, k: int = CANDIDATES, least: float = 0.0, own: bool = True) -> DataFrame:
    """queries (query_id, term, tf), corpus (point_id, term, tf) to each query's k best with score and rank, by the impact index."""
    return ranked(impact.sparse_top_k(queries, corpus, k, least, own), ["query_id"], [F.desc("score"), "point_id"], "rank")


def sparse_search(queries: DataFrame, corpus: DataFrame, k: int = CANDIDATES, least: float = 0.0, own: bool = True) -> DataFrame:
    """sparse_top_k of bags: queries (query_id, terms, tfs), corpus (point_id, terms, tfs)."""
    return ranked(impact.search(queries, corpus, k, least, own), ["query_id"], [F.desc("score"), "point_id"], "rank")


def reciprocal_rank_fusion(lists: list[DataFrame], k: int = TOP_K, constant: int = RRF) -> DataFrame:
    """Lists of (query_id, point_id, rank from 1) to the k best by summed 1 / (constant + rank - 1)."""
    rows = lists[0].select("query_id", "point_id", "rank")
    for more in lists[1:]:
        rows = rows.unionByName(more.select("query_id", "point_id", "rank"))
    fused = rows.groupBy("query_id", "point_id").agg(F.sum(1.0 / (constant + F.col("rank") - 1)).alias("fused"))
    return ranked(fused, ["query_id"], [F.desc(F.round("fused", 9)), "point_id"], "rank").filter(F.col("rank") <= k)


def reranked(matches: DataFrame, scores: DataFrame, k: int = 1, hybrid: bool = False) -> DataFrame:
    """matches (query_id, point_id, score, rank, …) by injected pair scores (query_id, point_id, logit), k a query.

    The probability is the logistic of the score; a match without one stands behind those
    that have it, by similarity or, in hybrid mode, by its fused rank.
    """
    out = matches.join(scores, ["query_id", "point_id"], "left").withColumn("rerank_prob", logistic(F.col("logit"))).drop("logit")
    order = [F.desc_nulls_last("rerank_prob"), *([] if hybrid else [F.desc("score")]), "rank"]
    place = fresh("place", out)
    out = ranked(out, ["query_id"], order, place).filter(F.col(place) <= k)
    return out.drop("rank").withColumnRenamed(place, "rank")


def relevance() -> Column:
    """The rerank probability where there is one, else the similarity."""
    return F.coalesce("rerank_prob", "score", F.lit(0.0))


def team_score(created: Column, association: Column, now: Column) -> Column:
    """Relevance by recency (times are UTC; a null one is as good as new) and the author's standing."""
    days = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(created)) / 86_400_000_000.0)
    return relevance() * F.coalesce(recency(days), F.lit(1.0)) * lookup(SENIORITY, F.coalesce(association, F.lit("")), 1.0)


def latest_votes(votes: DataFrame) -> DataFrame:
    """One vote per (point_id, finding_id): the last by (ts, id)."""
    return top_per(votes, ["point_id", "finding_id"], [F.desc("ts"), F.desc("id")])


def net_votes(votes: DataFrame) -> DataFrame:
    return votes.groupBy("point_id").agg(F.sum("vote").alias("net"))


def finalize(matches: DataFrame, votes: DataFrame, k: int = TOP_K, base_score: Column | None = None, least: float = RERANK_LEAST) -> DataFrame:
    """Suppress at a net of -2 or less, gate what was reranked, score, downweight, order, keep k per query.

    base_score: what is weighted by the votes, the relevance unless said otherwise; a match
    that votes do not name counts as net 0.
    """
    if "rerank_prob" not in matches.columns:
        matches = matches.withColumn("rerank_prob", F.lit(None).cast("double"))
    out = matches.join(net_votes(votes), "point_id", "left").filter(F.coalesce("net", F.lit(0)) > SUPPRESS_AT)
    out = out.filter(F.col("rerank_prob").isNull() | (F.col("rerank_prob") >= least))
    out = out.withColumn("final", (relevance() if base_score is None else base_score) * vote_multiplier(F.col("net")))
    return ranked(out, ["query_id"], [F.desc("final"), "rank", "point_id"], "place").filter(F.col("place") <= k)


def operating_points(scored: DataFrame, similarity: float, rerank: float, margin: float | None, k: int = TOP_K) -> DataFrame:
    """Matches past three gates, the k best of each query; ties keep their rank."""
    kept = scored.filter((F.col("score") >= similarity) & (F.col("rerank_prob").isNull() | (F.col("rerank_prob") >= rerank)))
    return top_per(passes_twin(kept, margin), ["query_id"], [F.desc(relevance()), "rank"], k)


def best_per_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by the order."""
    return top_per(rows, keys, order)


def anchored(matches: DataFrame, units: DataFrame) -> DataFrame:
    """Matches of units (unit, path, name, start_line) with where they belong, the best of each (point, path, name)."""
    out = matches.join(units, matches["query_id"] == units["unit"])
    return top_per(out, ["point_id", "path", "name"], [F.desc("final"), "unit"])


def first_at(rows: DataFrame, lookup_rows: DataFrame, location: list[str], either: list[str], position: str) -> DataFrame:
    """rows with the first lookup row of equal location that agrees in one of the `either` columns."""
    names = {c: f"_r_{c}" for c in lookup_rows.columns}
    other = lookup_rows.select(*[F.col(c).alias(n) for c, n in names.items()])
    id_ = fresh("_row", rows)
    # a row is known by its content, which is all that is asked of it
    marked = rows.withColumn(id_, F.xxhash64(F.to_json(F.struct(*rows.columns))))
    same = [F.col(c).eqNullSafe(F.col(names[c])) for c in location]
    agree = F.lit(False)
    for c in either:
        agree = agree | F.coalesce(F.col(c) == F.col(names[c]), F.lit(False))
    found = top_per(marked.join(other, same).filter(agree).select(id_, *names.values()), [id_], [names[position]])
    return marked.join(found, id_, "left").drop(id_, *[names[c] for c in location])
