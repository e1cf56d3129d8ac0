"""Values carried between ranges against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from palisade.operators import evaluation, funnel, intervals
from palisade.operators.carry import running


def made(n, seed=1):
    rng = random.Random(seed)
    null = lambda x: None if rng.random() < 0.3 else x
    return [(rng.choice(["hot"] * 6 + ["a", "b", None]), i, null(rng.randrange(100)), "clash") for i in range(n)]


def brute(rows):
    out = []
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: r[1])
        for i, r in enumerate(mine):
            upto = [x[2] for x in mine[: i + 1] if x[2] is not None]
            on = [x[2] for x in mine[i:] if x[2] is not None]
            out.append((*r[:3], i + 1, sum(upto) if upto else None, mine[i - 1][2] if i else None, upto[-1] if upto else None, on[0] if on else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("ranges", [1, 7, 60])
def test_running_values(spark, ranges):
    rows = made(300)
    df = spark.createDataFrame(rows, "key string, i int, v int, row string").repartition(3)
    v = F.col("v")
    out = running(df, ["key"], ["i"], place="place", sums={"total": v}, lags={"before": v}, lasts={"last": v}, nexts={"next": v}, ranges=ranges)
    assert out.columns == ["key", "i", "v", "row", "place", "total", "before", "last", "next"]
    assert sorted(((r.key, r.i, r.v, r.place, r.total, r.before, r["last"], r.next) for r in out.collect()), key=str) == brute(rows)
    down = running(df, ["key"], [-F.col("i")], place="row", ranges=ranges)
    assert down.columns == ["key", "i", "v", "row"] and {r.row for r in down.filter("i = 299").collect()} == {1}
    assert running(df.filter("false"), ["key"], ["i"], place="n").count() == 0


def test_users_of_carries(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    rng = random.Random(4)
    left = [(rng.choice([1, 1, 1, 2, None]), i, rng.choice([None, *range(50)])) for i in range(200)]
    right = [(rng.choice([1, 1, 1, 3, None]), i, rng.choice([None, *range(60)])) for i in range(40)]
    a, b = spark.createDataFrame(left, "k int, id int, at int"), spark.createDataFrame(right, "k int, pos int, to int")
    want = set()
    for k, i, at in left:
        near = sorted((abs(t - at), p) for k2, p, t in right if k2 == k is not None and t is not None and at is not None)
        if near:
            want.add((i, near[0][1]))
    assert {(r.id, r.pos) for r in intervals.nearest(a, b, ["k"], ["id"], "at", "to", "pos").collect()} == want
    calls = [("x", i, i % 7) for i in range(100)] + [("y", 0, None), ("y", 1, 5)]
    got = {r.run: (r.calls, r.tokens, r.seconds) for r in evaluation.pacing(spark.createDataFrame(calls, "run string, i int, t int"), "run", "i", "t", 2.0, 60, 1.5).collect()}
    assert got == {"x": (100, sum(i % 7 for i in range(100)), sum(max(2.0, 60.0 * (i % 7) / 60) for i in range(99)) + 150), "y": (2, 5, 2.0 + 3)}
    within = evaluation.within_budget(spark.createDataFrame(calls, "run string, i int, t int"), ["run"], ["i"], "t", 20)
    assert {r.running_total for r in within.filter("run = 'x' and within").collect()} == {0, 1, 3, 6, 10, 15}
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_comments_without_a_marker_are_matched(spark):
    have = spark.createDataFrame([(1, None, "same"), (2, "m", "old"), (3, "m", "twin"), (4, "gone", None)], "comment_id int, marker string, body string")
    want = spark.createDataFrame([(None, "same"), ("m", "new"), ("n", None)], "marker string, body string")
    got = {(r.marker, r.comment_id, r.op) for r in funnel.comment_plan(have, want).collect()}
    assert got == {(None, 1, "keep"), ("m", 2, "update"), ("m", 3, "delete"), ("gone", 4, "delete"), ("n", None, "create")}
