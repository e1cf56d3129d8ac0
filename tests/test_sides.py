"""Sides of components: the sequence on small splits, close to it in parts."""

import random

import pytest

from palisade.operators import sides

DDL = "split long, component long, cell string, n long"
TARGETS = {"dev": {"x": 6.0, "y": 4.0, "z": 3.0}, "test": {"x": 3.0, "y": 4.0, "z": 2.0}}


def sequence(parts, targets):
    """The rule, component by component."""
    out = {}
    for split in {p[0] for p in parts}:
        cells = {}
        for s, c, cell, n in parts:
            if s == split:
                mine = cells.setdefault(c, {})
                mine[cell] = mine.get(cell, 0) + (n or 0)
        filled = {s: {} for s in targets}
        for c in sorted(cells, key=lambda c: (-sum(cells[c].values()), c is not None, c or 0)):
            cost = {s: round(sum(n * (filled[s].get(k, 0) + n) / targets[s].get(k, 1.0) for k, n in cells[c].items()), 9) for s in targets}
            side = out[split, c] = min(cost, key=lambda s: (cost[s], s))
            for k, n in cells[c].items():
                filled[side][k] = filled[side].get(k, 0) + n
    return out


def cost(parts, side_of, targets):
    """Sum over sides and cells of filled squared by target, as the rule weighs it."""
    filled = {}
    for s, c, cell, n in parts:
        filled[side_of[s, c], cell] = filled.get((side_of[s, c], cell), 0) + (n or 0)
    return sum(f * f / targets[s].get(cell, 1.0) for (s, cell), f in filled.items())


def assigned(df, targets=TARGETS, **how):
    rows = sides.assign_sides(df, targets, **how).collect()
    out = {(r["split"], r["component"]): r["side"] for r in rows}
    assert len(out) == len(rows)
    return out


def test_small_splits_follow_the_sequence(spark):
    rng = random.Random(8)
    # few sizes, so that ties are common; a third split has one cell and equal sizes alone
    parts = [(s, c, cell, rng.randrange(1, 5)) for s in (0, 1) for c in range(40) for cell in rng.sample(["x", "y", "z", "w"], 2)] + [(2, c, "x", 3) for c in range(9)]
    assert assigned(spark.createDataFrame(parts, DDL)) == sequence(parts, TARGETS)


def test_special_rows(spark):
    parts = [(0, None, "x", 4), (0, 1, None, 4), (0, 2, "x", None), (None, 1, "x", 1), (None, 1, "x", 1), (None, 1, "y", 0), (0, 3, "q", 2)]
    df = spark.createDataFrame([(*p, "other", "more") for p in parts], f"{DDL}, side string, size string")
    assert assigned(df) == sequence(parts, TARGETS)
    many = parts * 2 + [(s, c, "x", 1) for s in (0, None) for c in range(10, 90)]
    got = assigned(spark.createDataFrame(many, DDL), rows=10)
    assert got.keys() == {(s, c) for s, c, _, _ in many}
    assert assigned(spark.createDataFrame([], DDL)) == {} and assigned(spark.createDataFrame([], DDL), rows=1) == {}


@pytest.fixture(scope="module")
def heavy():
    """6,000 components: sizes by a power law, one holds a third of all, cells go with sizes."""
    rng = random.Random(3)
    parts = []
    for c in range(6000):
        size = int(rng.paretovariate(1.1))
        for cell in rng.sample(["x", "y", "z"], 1 + (size > 3) + (size > 20)):
            parts.append((7, c, cell, max(1, size + rng.randrange(3))))
    third = sum(p[3] for p in parts) // 2
    return parts + [(7, 6000, "x", third)]


@pytest.mark.parametrize("rows", [3000, 300])
def test_parts_come_close_to_the_sequence(spark, heavy, rows):
    df = spark.createDataFrame(heavy, DDL).repartition(5)
    got, want = assigned(df, rows=rows), sequence(heavy, TARGETS)
    assert got.keys() == want.keys()
    assert cost(heavy, got, TARGETS) <= 1.01 * cost(heavy, want, TARGETS)
    # the order of the input and the number of tasks say nothing
    assert assigned(df.orderBy("n").coalesce(1), rows=rows) == got


def test_no_task_has_all_rows(spark, heavy):
    held = sides.dealt(spark.createDataFrame(heavy, DDL), rows=300).groupBy("class", "part").agg({"cells": "count"}).collect()
    assert len(held) >= len(heavy) / 300 and max(r[2] for r in held) <= 450
    assert sum(r[2] for r in held) == 6001


def test_many_splits_without_a_broadcast(spark, heavy, monkeypatch):
    df = spark.createDataFrame(heavy, DDL)
    want = assigned(df, rows=300)
    monkeypatch.setattr(sides, "BROADCAST_CLASSES", 0)
    assert assigned(df, rows=300) == want
