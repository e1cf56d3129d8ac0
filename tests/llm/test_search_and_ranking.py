"""Vector search, lexical search and grouped places against brute force, and their special rows."""

import math
import random
import re
import string
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import grouped_ranking, lexical_search, queries, vector_search

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@pytest.mark.parametrize("name", ["op12_lexical_search", "op13_grouped_ranking"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "sale_lines"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    out = queries.QUERIES[name](spark, SF)
    sql = con.sql(queries.ORACLES[name])
    assert sorted(out.columns) == sorted(sql.columns)
    got = sorted((tuple(r[c] for c in out.columns) for r in out.collect()), key=str)
    places = [sql.columns.index(c) for c in out.columns]
    assert got == sorted((tuple(r[i] for i in places) for r in sql.fetchall()), key=str)


# places


def brute_places(rows, places):
    first = lambda x: (x is not None, x or 0)
    last = lambda x: (x is None, x or 0)
    groups = {}
    for g, a, b, t in rows:
        groups.setdefault(g, []).append((first(a), first(b), last(t), (g, a, b, t)))
    out = []
    for members in groups.values():
        members.sort(key=lambda m: m[:3])
        pairs = [m[:2] for m in members]
        for pos, m in enumerate(members, 1):
            place = 1 + sum(p < m[:2] for p in pairs)
            if place <= places:
                out.append((*m[3], pos, place, pairs.count(m[:2])))
    return Counter(out)


@pytest.mark.parametrize("salt_rows", [10, 1_000_000])
def test_places_with_hot_groups_ties_nulls_and_repeated_rows(spark, salt_rows):
    rng = random.Random(3)
    null = lambda x: None if rng.random() < 0.1 else x
    rows = [(rng.choice(["hot", "hot", "a", "b", None]), null(rng.randrange(4)), null(rng.randrange(4)), null(rng.randrange(5))) for _ in range(400)]
    rows += [("twins", 1, 1, 1)] * 60 + [("twins", 2, 1, 1)] * 3 + [("one", None, None, None)]
    df = spark.createDataFrame(rows, "g string, a int, b int, t int").repartition(4)
    extra = df.select("g", "a", "b", "t", F.lit("x").alias("pos"), F.lit(1).alias("row"), F.lit(2).alias("salt"), F.lit(3).alias("a.b"), F.lit(4).alias("g0"))
    out = grouped_ranking.top_places(extra, [F.col("g")], [F.col("a"), F.col("b")], [F.col("t")], salt_rows=salt_rows)
    assert out.columns == ["g", "a", "b", "t", "row", "salt", "a.b", "g0", "pos", "place", "tied"]
    got = Counter((r.g, r.a, r.b, r.t, r.pos, r.place, r.tied) for r in out.collect())
    assert got == brute_places(rows, 3)
    many = grouped_ranking.top_places(df, [F.col("g")], [F.col("a"), F.col("b")], [F.col("t")], places=50, salt_rows=salt_rows)
    assert Counter(tuple(r) for r in many.collect()) == brute_places(rows, 50)


def test_places_of_nothing(spark):
    df = spark.createDataFrame([], "g string, a int, t int")
    assert grouped_ranking.top_places(df, [F.col("g")], [F.col("a")], [F.col("t")]).count() == 0


# lexical search


def brute_search(documents, items, top):
    bags = {d: Counter(TERM.findall(t.translate(LOWER))) for d, t in documents.items()}
    bags = {d: b for d, b in bags.items() if b}
    n, words = len(bags), sum(b.total() for b in bags.values())
    df = Counter(t for b in bags.values() for t in b)
    out = []
    for item, text in items.items():
        scores = []
        for d, bag in bags.items():
            m, score = 75 + (25 * bag.total() * n) // words, 0
            for t in TERM.findall(text.translate(LOWER)):
                if bag[t]:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 12 * m))
            if score > 0:
                scores.append((-score, d))
        out += [(item, k, d, -s) for k, (s, d) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out)


def searched(spark, documents, items, **more):
    docs = spark.createDataFrame(documents, "doc_id long, text string, n long, score string").repartition(3)
    return sorted(tuple(r) for r in lexical_search.ranked_search(docs, spark.createDataFrame(items, "item_id long, text string, rank int"), **more).collect())


def test_lexical_search_equals_brute_force(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdéß漢09") for _ in range(rng.randrange(1, 4))) for _ in range(60)] + ["The", "THE", "the", "Ünder", "x" * 3000]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "\n", "-", "\x00", "...", " "]) for _ in range(n))
    texts = {rng.choice([1, 3000, -5000]) * 100 + i: text(rng.randrange(0, 60)) for i in range(150)} | {7: "", 9: "!?", 11: "the " * 20_000, 2**40: text(30)}
    texts |= {20_000 + i: texts[11] for i in range(30)}  # equal scores
    items = {i: text(rng.randrange(1, 30)) for i in range(8)} | {50: "", 51: "the THE", 52: "nowhere"}
    rows = [(d, t, 0, "clash") for d, t in texts.items()]
    rows += [rows[0], rows[3], rows[3], (99_999, None, 0, ""), (None, "the the", 0, "")]
    asked = [(i, t, 0) for i, t in items.items()] + [(0, items[0], 1), (60, None, 0), (None, "the", 0)]
    want = brute_search(texts, items, 20)
    assert len(want) > 150
    assert searched(spark, rows, asked) == want
    assert searched(spark, rows, asked, query_bytes=40) == want  # many blocks
    assert searched(spark, rows, asked, top=3) == brute_search(texts, items, 3)


def test_lexical_search_of_nothing(spark):
    assert searched(spark, [], [(1, "a", 0)]) == []
    assert searched(spark, [(1, "a", 0, "")], []) == []
    assert searched(spark, [(1, "a", 0, "")], [(1, "a", 0)]) == brute_search({1: "a"}, {1: "a"}, 20)


# vector search


def brute_nearest(rows, queries_, top):
    x = np.zeros((len(rows), max(len(v) for _, v in rows)))
    for i, (_, v) in enumerate(rows):
        x[i, : len(v)] = v
    ids = np.array([i for i, _ in rows])
    out = set()
    for q in queries_:
        for at in np.flatnonzero(ids == q):
            score = (x * x[at]).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((x[at] * x[at]).sum()))
            others = sorted((-s, i) for s, i in zip(score.round(12).tolist(), ids.tolist()) if i != q)[:top]
            out |= {(int(q), k, i, -s) for k, (s, i) in enumerate(others, 1)}
    return out


def found(spark, rows, queries_, relax=1.0, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(3)
    df = df.filter(F.col("vec_id").isNotNull() & vector_search.usable(F.col("embedding"))).select("vec_id", "embedding")
    index = vector_search.build_index(df, **more)
    out = vector_search.nearest(df.filter(F.col("vec_id").isin(queries_)), index, relax, query_rows=7)
    return {(r.query_id, r["rank"], r.vec_id, round(r.score, 12)) for r in out.collect()}


def test_vector_search_with_factor_one_is_exact(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8)) * 2
    rows = [(int(i), (centres[i % 6] + rng.normal(size=8)).tolist()) for i in range(400)]
    hot = rows[5][1]
    rows += [(1000 + i, hot) for i in range(150)] + [(2000, [2 * v for v in hot]), (3, [4 * v for v in hot]), (-50, rows[7][1][:5]), (5000, [1e-30, 0.0]), (5001, [1e30] * 8)]
    odd = [(6000, None), (6001, []), (6002, [0.0] * 8), (6003, [1.0, None]), (6004, [float("nan")] * 8), (6005, [float("inf")] * 8), (None, hot), rows[0], rows[0]]
    asked = [0, 5, 7, 50, 100, 150, 399, 1000, 1149, 2000, -50, 5000]
    want = brute_nearest(rows, asked, 5)
    every = [(i, v, "clash") for i, v in rows + odd]
    assert found(spark, every, asked, shard_rows=40, leaf_rows=6) == want
    assert found(spark, every, asked, shard_rows=40, leaf_rows=6, sample=40) == want  # several shards a region
    assert found(spark, every, asked) == want


def test_vector_search_of_few_rows(spark):
    assert found(spark, [], [0]) == set()
    assert found(spark, [(0, [1.0, 0.0], "")], [0]) == set()
    rows = [(0, [1.0, 0.0], ""), (1, [0.0, 1.0], ""), (2, [0.0, 1.0], "")]
    assert found(spark, rows, [0]) == {(0, 1, 1, 0.0), (0, 2, 2, 0.0)}


def test_vector_search_query_recall_and_scores(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = brute_nearest(rows, [i for i, _ in rows if i % 50 == 0], 5)
    got = {(r.query_id, r["rank"], r.vec_id, round(r.score, 12)) for r in vector_search.op11_vector_search(spark, SF).collect()}
    pairs = lambda x: {(q, i): s for q, _, i, s in x}
    both = pairs(want).keys() & pairs(got).keys()
    assert len(got) == len(want) and len(both) >= 0.9 * len(want)
    assert all(abs(pairs(want)[k] - pairs(got)[k]) < 1e-11 for k in both)


def test_relaxed_search_keeps_its_recall_and_prunes(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 16)) * 3
    x = vector_search.directions(np.repeat(centres, 50, axis=0) + rng.normal(size=(2000, 16)))
    tree = vector_search.Tree.fit(x, 16)
    order = np.concatenate(tree.leaves)
    place = np.argsort(order)
    tree.vantage = place[tree.vantage].tolist()
    points, starts = x[order], np.concatenate([[0], np.cumsum([len(leaf) for leaf in tree.leaves])])
    asked = x[::50]
    true = np.sort(vector_search.chords(asked, x), axis=1)[:, :6]
    for relax, least in ((1.0, 1.0), (2.5, 0.9)):
        best, _ = vector_search.nearest_in_tree(asked, points, tree, starts, np.full(len(asked), np.inf), 6, 10, relax)
        assert (best[:, :6] <= true + 1e-7).mean() >= least
