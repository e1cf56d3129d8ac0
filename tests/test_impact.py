"""Sparse search by the impact index against brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from palisade.operators import impact, retrieval


def made(seed=2):
    """Frequent words in all points, rare ones in few, some points much heavier, and twins."""
    rng = random.Random(seed)
    word = lambda: f"w{int(400 ** rng.random())}"
    points = {i * 7 - 50: Counter(word() for _ in range(rng.choice([5, 20, 20, 300]))) for i in range(300)}
    for i in range(12):
        points[5000 + i] = points[-50]
    return points


def brute(queries, points, k, least=0.0, own=True):
    holding = Counter(t for p in points.values() for t in p)
    idf = {t: math.log(1 + (len(points) - n + 0.5) / (n + 0.5)) for t, n in holding.items()}
    out = []
    for q, terms in queries.items():
        scores = [(-round(sum(n * p[t] * idf[t] for t, n in terms.items() if t in p), 9), i) for i, p in points.items() if own or i != q]
        out += [(q, i, -s) for s, i in sorted(s for s in scores if s[0] < 0 and -s[0] >= least)[:k]]
    return sorted(out)


def rows(bags):
    return [(i, t, n) for i, bag in bags.items() for t, n in bag.items()]


@pytest.mark.parametrize("k,least,own,more", [(5, 0.0, False, {}), (3, 40.0, True, {}), (7, 0.0, True, {"query_bytes": 3000}), (1, 0.0, False, {"block_points": 1})])
def test_impact_search_equals_brute_force(spark, k, least, own, more):
    points = made()
    queries = {q: points[q] for q in list(points)[::23]} | {-1: Counter({"w1": 3, "unknown": 2}), -2: Counter({"unknown": 1})}
    corpus = spark.createDataFrame(rows(points) + [(None, "w1", 9), (3, None, 9), (4, "w1", None)], "point_id long, term string, tf long")
    split = [(i, t, 1) for i, t, n in rows(queries) for _ in range(n)]  # repeated rows add up
    asked = spark.createDataFrame(split, "query_id long, term string, tf long")
    got = impact.sparse_top_k(asked, corpus, k, least, own, **({"block_points": 16} | more))
    assert sorted((r.query_id, r.point_id, round(r.score, 9)) for r in got.collect()) == brute(queries, points, k, least, own)
    if not more and own:
        assert {r["rank"] for r in retrieval.sparse_top_k(asked, corpus, k, least, own).collect()} == set(range(1, k + 1))


def test_impact_search_of_nothing(spark):
    corpus = spark.createDataFrame(rows(made()), "point_id long, term string, tf long")
    none = spark.createDataFrame([], "query_id long, term string, tf long")
    assert impact.sparse_top_k(none, corpus, 3).count() == 0
    asked = spark.createDataFrame([(1, "w1", 1)], "query_id long, term string, tf long")
    assert impact.sparse_top_k(asked, corpus.filter("false"), 3).count() == 0


def test_blocks_that_cannot_matter_are_not_scored():
    points = made()
    numbers = defaultdict(lambda: len(numbers))
    order = sorted(points, key=lambda i: -sum(points[i].values()))
    table = pa.record_batch([
        pa.array(order), pa.array([float(sum(points[i].values())) for i in order]),
        pa.array([[numbers[t] for t in points[i]] for i in order], pa.list_(pa.int32())), pa.array([[float(n) for n in points[i].values()] for i in order], pa.list_(pa.float64())),
    ], names=["point_id", "weight", "terms", "tfs"])
    queries = {i: {numbers[t]: float(n) for t, n in points[i].items()} for i in order[::10]}
    found = impact.Queries(queries, dict.fromkeys(queries, 0.0), 3, False)
    for block in impact.index_blocks(16)(iter([table])):
        found.score(*(block.column(c)[0].values.to_numpy(zero_copy_only=False) for c in ("points", "terms", "counts", "most", "places", "tfs")), len(numbers))
    every = sum(len(set(queries[q]) & {numbers[t] for t in p}) for q in queries for p in points.values())
    assert 0 < found.scored < 0.8 * every  # these points have few blocks
    best = {q: [p for _, p in sorted((-sum(w * points[p][t] for t, w in ((t, queries[q][numbers[t]]) for t in points[q])), p) for p in points if p != q)[:3]] for q in queries}
    assert {q: [p for _, p in b] for q, b in zip(found.ids, found.best)} == best
    assert np.all(np.isfinite(found.least))


def test_index_is_built_once_for_all_blocks_of_queries(spark, monkeypatch):
    points, built = made(), []
    queries = {q: points[q] for q in list(points)[::9]}
    monkeypatch.setattr(impact, "build_index", lambda *a, build=impact.build_index, **b: built.append(1) or build(*a, **b))
    corpus, asked = (spark.createDataFrame(rows(bags), f"{name} long, term string, tf long") for bags, name in ((points, "point_id"), (queries, "query_id")))
    got = impact.sparse_top_k(asked, corpus, 3, own=False, query_bytes=6000, block_points=16)
    assert sorted((r.query_id, r.point_id, round(r.score, 9)) for r in got.collect()) == brute(queries, points, 3, own=False)
    assert len(built) == 1


def test_a_bound_from_another_order_of_the_sum_leaves_nothing_out():
    # the k-th best was found to be greater by one in the ninth place
    queries = impact.Queries({1: {0: 561137.34038}}, {1: 561137.34038 + 1e-9}, 3, True)
    block = next(impact.index_blocks(4)(iter([pa.record_batch([pa.array([5]), pa.array([1.0]), pa.array([[0]], pa.list_(pa.int64())), pa.array([[1.0]])], names=["point_id", "weight", "terms", "tfs"])])))
    queries.score(*(block.column(c)[0].values.to_numpy(zero_copy_only=False) for c in ("points", "terms", "counts", "most", "places", "tfs")), 1)
    assert [p for _, p in queries.best[0]] == [5]


def test_heavy_blocks_are_dealt_to_tasks(spark, monkeypatch):
    from pyspark.sql import functions as F

    points, built = made(), []
    monkeypatch.setattr(impact, "build_index", lambda *a, build=impact.build_index, **b: built.append(build(*a, **b)) or built[0])
    corpus = spark.createDataFrame(rows(points), "point_id long, term string, tf long")
    impact.sparse_top_k(corpus.filter("point_id % 3 = 0").withColumnRenamed("point_id", "query_id"), corpus, 3, block_points=16)
    heavy = sorted(((r.weight, r.task) for r in built[0].select("weight", F.spark_partition_id().alias("task")).collect()), reverse=True)[:4]
    assert len({task for _, task in heavy}) > 2


def test_table_of_a_block_and_numbers_that_two_terms_would_share(spark, monkeypatch):
    from pyspark.sql import functions as F

    points, seeds = made(), set()
    texts = [(i, " ".join(t for t in bag.elements())) for i, bag in points.items()]
    texts += [(i, text[:0]) for i, text in texts[:3]] + [(8000, None), (None, "w1"), (8001, "1 2")]
    halves = [(-50, text[: len(text) // 2].rpartition(" ")[0]) for i, text in texts if i == -50]  # an id of two rows
    texts = [(i, text[len(halves[0][1]) :] if i == -50 and text else text) for i, text in texts] + halves
    df = spark.createDataFrame(texts, "id long, text string")
    number = lambda t, seed: seeds.add(seed) or (F.crc32(t.cast("binary")) % 8 if seed < 1 else F.xxhash64(t, F.lit(seed)))
    monkeypatch.setattr(impact, "number", number)
    monkeypatch.setattr(impact, "DENSE_FROM", 1)
    monkeypatch.setattr(impact, "DENSE_QUERIES", 5)
    bags = retrieval.sparse_bags(df, "id", "text")
    assert {r.id: Counter(dict(zip(r.terms, r.tfs))) for r in bags.collect()} == points
    got = impact.search(bags.filter("id % 3 = 0").withColumnRenamed("id", "query_id"), bags.withColumnRenamed("id", "point_id"), 4, own=False, block_points=16)
    assert sorted((r.query_id, r.point_id, round(r.score, 9)) for r in got.collect()) == brute({q: p for q, p in points.items() if q % 3 == 0}, points, 4, own=False)
    assert seeds == {0, 1}


def test_many_queries_take_a_block_as_a_table():
    points = made()
    numbers = defaultdict(lambda: len(numbers))
    order = sorted(points, key=lambda i: -sum(points[i].values()))
    bags = {i: {numbers[t]: float(n) for t, n in points[i].items()} for i in order}
    table = pa.record_batch([pa.array(order), pa.array([float(sum(points[i].values())) for i in order]), pa.array([list(bags[i]) for i in order], pa.list_(pa.int64())), pa.array([list(bags[i].values()) for i in order])], names=["point_id", "weight", "terms", "tfs"])
    found = impact.Queries(bags, dict.fromkeys(bags, 0.0), 3, True)
    postings = impact.Queries._postings
    impact.Queries._postings = lambda *a: pytest.fail("postings were taken query by query")
    try:
        block = next(impact.index_blocks(128)(iter([table])))
        found.score(*(block.column(c)[0].values.to_numpy(zero_copy_only=False) for c in ("points", "terms", "counts", "most", "places", "tfs")), len(numbers))
    finally:
        impact.Queries._postings = postings
    scores = lambda q: sorted((-round(sum(w * bags[p].get(t, 0) for t, w in bags[q].items()), 9), p) for p in order[:128])
    assert dict(zip(found.ids, found.best)) == {q: scores(q)[:3] for q in bags}
