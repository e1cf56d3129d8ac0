"""Operators that SQL does not express: invariants and round trips."""

import random

import pytest

from palisade.operators import diffs, features, packing
from palisade.sources import tables
from palisade.streaming import jobs


def test_patches_round_trip():
    rng = random.Random(3)
    for _ in range(60):
        a = [rng.choice("abcde") for _ in range(rng.randrange(0, 14))]
        b = [x for x in a if rng.random() > 0.3] + [rng.choice("xyz") for _ in range(rng.randrange(3))]
        old, new = "\n".join(a), "\n".join(b)
        patch = diffs.make(old, new, rng.randrange(0, 4))
        assert diffs.apply(old, patch) == new and diffs.apply(new, patch, True) == old


def test_bad_patch_is_an_error():
    with pytest.raises(diffs.BadPatch):
        diffs.apply("a\nb", "@@ -1,2 +1,1 @@\n a\n-c")
    with pytest.raises(diffs.BadPatch):
        list(diffs.hunks("@@ -1,3 +1,3 @@\n a"))


def test_touched_lines_hold_deletion_points():
    patch = diffs.make("a\nb\nc\nd", "a\nd", 1)
    assert diffs.touched(patch) == [1, 2] and diffs.added(patch) == []
    assert diffs.map_line(patch, 4) == 2


def test_guard_changes_flip_with_the_sides(spark):
    strong = "def f(u, x):\n    if not u.is_admin:\n        raise PermissionError\n    return yaml.safe_load(x)\n"
    weak = "def f(u, x):\n    return yaml.load(x)\n"
    rows = spark.createDataFrame([(1, strong, weak), (2, weak, strong), (3, weak, weak), (4, "def (", weak[:3])], "id long, old string, new string")
    out = {r.id: r for r in features.risk(features.changes(features.features(rows))).collect()}
    assert out[1].risk == "weakened" and out[1].alert and out[2].risk == "strengthened" and 3 not in out and 4 not in out
    assert out[1].neg == out[2].pos


def test_first_fit_packing(spark):
    rows = spark.createDataFrame([(1, i, 1.0, s) for i, s in enumerate([4000, 3000, 2000, 7000, 3000, 100])], "scan long, unit long, priority double, size long")
    out = {r.unit: (r.batch, r.reason) for r in packing.pack(rows, "scan", calls=2).collect()}
    # 4000 opens batch 0, 3000 batch 1; 2000 fills batch 0, 3000 batch 1; 7000 fits nowhere, 100 finds both full
    assert out == {0: (0, None), 1: (1, None), 2: (0, None), 3: (None, "too_large"), 4: (1, None), 5: (None, "budget")}


def test_files_after_a_misfit_may_fit(spark):
    rows = spark.createDataFrame([(1, "a", 3.0, 1500), (1, "b", 2.0, 900), (1, "c", 1.0, 400)], "pr long, path string, priority double, changed long")
    assert [r.kept for r in packing.select_files(rows, "pr").orderBy("path").collect()] == [True, False, True]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "id long, old string, new string")
    assert features.risk(features.changes(features.features(empty))).count() == 0
    assert diffs.with_patch(empty.select("old", "new")).count() == 0


def test_upsert_keeps_new_rows(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    new = spark.createDataFrame([("b", 3)], "id string, n int")
    assert {(r.id, r.n) for r in tables.upsert(old, new, "id").collect()} == {("a", 1), ("b", 3)}


def test_stream_of_votes(spark, tmp_path):
    rows = spark.createDataFrame([("x", 1, 1), ("x", 2, -1), ("y", 1, 1)], "key string, at long, vote int")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.writeStream.foreachBatch(jobs.upsert_buckets(str(tmp_path / "out"), "key", ["at"], 2)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.key, r.vote) for r in jobs.read_buckets(spark, str(tmp_path / "out"), "key string, at long, vote int").collect()} == {("x", -1), ("y", 1)}


def test_nearest_rank_cuts_ranges_once(spark, monkeypatch):
    import random

    from pyspark.sql import functions as F

    from palisade.operators import metrics

    # a sketch that comes out otherwise each time, as one does whose parts are merged in another order
    cut = F.udf(lambda most: sorted(random.SystemRandom().uniform(0, most) for _ in range(15)), "array<double>").asNondeterministic()
    monkeypatch.setattr(F, "percentile_approx", lambda c, *_: cut(F.max(c)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
        out = {r.g: (r.n, r.p50, r.p90) for r in metrics.nearest_rank(df, ["g"], "v", {"p50": 0.5, "p90": 0.9}).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    of = {g: sorted(float(i) for i in range(5000) if i % 3 == g) for g in range(3)}
    assert out == {g: (len(v), v[-(-len(v) // 2) - 1], v[-(-9 * len(v) // 10) - 1]) for g, v in of.items()}


def test_cost_rollup_cuts_ranges_once(spark, monkeypatch):
    import random

    from pyspark.sql import functions as F

    from palisade.operators import evaluation

    cut = F.udf(lambda most: sorted(random.SystemRandom().uniform(0, most) for _ in range(15)), "array<double>").asNondeterministic()
    monkeypatch.setattr(F, "percentile_approx", lambda c, *_: cut(F.max(c)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(3000).select((F.col("id") % 2).alias("g"), F.col("id").alias("a"), (F.col("id") * 2).alias("b"))
        out = {(r.g, r.measure): (r.n, r.p90) for r in evaluation.cost_rollup(df, ["g"], ["a", "b"]).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert out == {(g, m): (1500, float(k * (2 * 1349 + g))) for g in (0, 1) for m, k in (("a", 1), ("b", 2))}


def test_fisher_of_large_counts(spark):
    import math
    import threading

    from pyspark.sql import functions as F

    from palisade.functions import exact

    a, b, c, d = 1310, 4020, 12100, 38900
    watch = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    watch.start()
    try:
        p = spark.createDataFrame([(a, b, c, d)], "a long, b long, c long, d long").select(exact.fisher(*map(F.col, "abcd")).alias("p")).first().p
    finally:
        watch.cancel()
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    logs = [choose(a + c, i) + choose(b + d, a + b - i) - choose(a + b + c + d, a + b) for i in range(a + b + 1)]
    assert abs(p - sum(math.exp(x) for x in logs if x <= logs[a] + 1e-9)) < 1e-6


def test_dense_scores_are_held_in_tiles(spark):
    import resource

    import numpy as np
    import pyarrow as pa

    from palisade.operators import retrieval

    rng = np.random.default_rng(5)
    best, ids, points = retrieval.Best(np.arange(70), 4), rng.integers(0, 4, (70, 3)).astype(float), rng.integers(0, 4, (900, 3)).astype(float)
    names = rng.permutation(900)
    for at in range(0, 900, 250):  # many ties
        best.scan(ids, points[at : at + 250], names[at : at + 250], None, False)
    scores = ids @ points.T
    scores[np.arange(70)[:, None] == names] = -np.inf
    order = np.lexsort((np.broadcast_to(names, scores.shape), -scores), axis=1)[:, :4]
    assert (best.points == names[order]).all() and (best.scores == np.take_along_axis(scores, order, 1)).all()

    def most(batches):
        for _ in batches:
            yield pa.record_batch([pa.array([resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10])], names=["mb"])

    vectors = "transform(sequence(1, 16), x -> sin(id * x + x)) AS vector"
    queries, corpus = spark.range(12000).selectExpr("id AS query_id", vectors), spark.range(0, 40000, 1, 4).selectExpr("id AS point_id", vectors)
    assert retrieval.nearest_points(queries, corpus, 3, own=False).count() == 36000
    assert max(r.mb for r in spark.range(0, 16, 1, 8).mapInArrow(most, "mb long").collect()) < 1000


def test_packing_goes_on_over_batches(spark):
    from palisade.operators import packing

    rows = spark.createDataFrame([(s, u, 1.0 - u / 100, None if u == 0 else 2000) for s in (1, 2, None) for u in range(9)], "scan long, unit long, priority double, size long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        out = packing.pack(rows, "scan", tokens=6000, most_units=4, calls=2)
        got = {(r.scan, r.unit): (r["size"], r.batch, r.reason) for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    # a null size counts as 0, and no scan is a Python group of its own
    want = {0: (None, 0, None), **{u: (2000, 0, None) for u in (1, 2, 3)}, **{u: (2000, 1, None) for u in (4, 5, 6)}, **{u: (2000, None, "budget") for u in (7, 8)}}
    assert got == {(s, u): x for s in (1, 2, None) for u, x in want.items()} and "FlatMapGroups" not in plan


def test_candidates_are_pruned_by_bitmaps(spark):
    from palisade.operators import sets

    # two tokens in common of sixty stand first in both: they are candidates by place, not by what they lack
    rows = [(i, ["x", "y"] + [f"{i % 7}-{k}" if k < 40 + i // 7 else f"{i}-{k}" for k in range(60)]) for i in range(28)]
    links = sets.near_duplicate_links(spark.createDataFrame(rows, "id long, tokens array<string>"))
    got = {(r.a, r.b): round(r.jaccard, 9) for r in links.collect()}
    want = {(a, b): round(len(set(x) & set(y)) / len(set(x) | set(y)), 9) for a, x in rows for b, y in rows if a < b}
    assert got == {p: j for p, j in want.items() if j >= 0.7} and "bit_count" in links._jdf.queryExecution().optimizedPlan().toString()


def test_security_texts_are_those_of_the_pattern(spark):
    import random

    from pyspark.sql import functions as F

    from palisade.operators import corpus

    rng = random.Random(5)
    parts = ["", " ", "_", "-", "1", "\n", "\u212a", "\u0130", "\u017f", "\u00e9", "x", "cve", "CWE", "rce", "Dos", "auth", "zip", "slip", "cross", "site", "To\u212aen", "sou", "CSP", "e", "vuln", "remote", "code", "eval", "constant", "time", "ssl", "tls", "xss"]
    texts = [(i, "".join(rng.choice(parts) for _ in range(6))) for i in range(3000)]
    texts += [(9000 + i, f"a {w}!") for i, w in enumerate(corpus.SECURITY.removeprefix("(?i)").replace("\\b", "").replace("\\d", "7").replace(".?", "").replace(".", " ").upper().split("|"))] + [(9999, None)]
    df = spark.createDataFrame(texts, "id long, text string")
    rows = df.select("id", corpus.security_text(F.col("text")).alias("is"), F.coalesce(F.col("text").rlike(corpus.SECURITY), F.lit(False)).alias("want")).collect()
    assert all(r["is"] == r["want"] for r in rows)
    assert 100 < sum(r["is"] for r in rows if r.id < 9000) < 2900 and all(r["is"] for r in rows if 9000 <= r.id < 9999)


def test_security_texts_do_not_try_every_word_at_every_character(spark):
    import time

    from pyspark.sql import functions as F

    from palisade.operators import corpus

    text = F.repeat(F.concat(F.lit("The source of this force is a Dose of calm prose "), F.col("id")), F.lit(4000))
    df = spark.range(24).select(text.alias("text")).localCheckpoint()

    def seconds(flag):
        start = time.time()
        assert df.filter(flag).count() == 0
        return time.time() - start

    mine, theirs = corpus.security_text(F.col("text")), F.col("text").rlike(corpus.SECURITY)
    seconds(mine)
    assert seconds(mine) < seconds(theirs) / 2
