"""Set and multiset operators, near-duplicate links and connected components.

Null keys are equal to each other. Empty sides give what the operation on empty sets gives;
repeated rows count as often as they stand there; columns of any name are kept where rows
are kept; ties are broken by the order columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.sources.scratch import Scratch

from .names import fresh, top_per
from .similar import near_duplicate_classes, near_duplicate_links  # noqa: F401


def occurrence(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def multiset_minus(left: DataFrame, right: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Left rows after as many rows of each key are taken away as the right side has."""
    place, taken = fresh("place", left), fresh("taken", left)
    gone = right.groupBy(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias(taken))
    numbered = left.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    on = [numbered[k].eqNullSafe(gone[f"_key{i}"]) for i, k in enumerate(keys)]
    out = numbered.join(gone, on, "left").filter(F.col(place) > F.coalesce(taken, F.lit(0)))
    return out.select(*[numbered[c] for c in left.columns])


def net_counts(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose count changed, with the signed change; equal parts cancel."""
    both = old.select(*keys, F.lit(-1).alias("net")).unionByName(new.select(*keys, F.lit(1).alias("net")))
    return both.groupBy(*keys).agg(F.sum("net").alias("net")).filter("net <> 0")


def representatives(old: DataFrame, new: DataFrame, keys: list[str], group: list[str], order: list[str], n: str) -> DataFrame:
    """For each group the `n` (a column) old rows that best stand for its loss: keys whose count really fell first, then from the end."""
    fell = net_counts(old, new, keys).filter("net < 0").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    marked = old.join(fell.withColumn("_fell", F.lit(True)), on, "left").drop(*[f"_k{i}" for i in range(len(keys))])
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(F.coalesce("_fell", F.lit(False))), *[F.desc(c) for c in order]))
    return marked.withColumn("_i", place).filter(F.col("_i") <= F.col(n)).drop("_i", "_fell")


def new_helpers(old: Column, new: Column, common: Column) -> Column:
    """Names passed to callees that only one side has. old and new: maps of callee to an array of names."""
    only = F.filter(F.array_except(F.map_keys(new), F.map_keys(old)), lambda c: ~F.coalesce(F.array_contains(common, c), F.lit(False)))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(only, lambda c: F.element_at(new, c)))))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (id), edges (a, b) to (id, component): the smallest id that can be reached.

    Rounds of label propagation with pointer jumping; each is a Parquet table in the
    session's shared checkpoint folder, so that lineage stays short. A round's tables are
    deleted when the next one is written; the last one stays for the result.
    """
    scratch = Scratch(nodes.sparkSession, "components")
    keep, drop = scratch.save, scratch.drop
    both = keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    linked = keep(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")), "labels-0")
    for i in range(1, 1 << 20):
        near = both.join(linked, both.b == linked.id).groupBy("a").agg(F.min("component").alias("near"))
        step = keep(linked.join(near, linked.id == near.a, "left").select("id", "component", F.least("component", "near").alias("next")), f"step-{i}")
        jump = step.select(F.col("id").alias("next"), F.col("next").alias("top"))
        after = keep(step.join(jump, "next", "left").select("id", F.coalesce("top", "next").alias("component"), F.col("component").alias("old")), f"labels-{i}")
        linked = after.drop("old")
        done = after.filter("component <> old").limit(1).count() == 0
        drop(f"step-{i}", f"labels-{i - 1}")
        if done:
            break
    drop("edges")
    return nodes.select("id").distinct().join(linked, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def leaks(rows: DataFrame, key: str, side: str) -> DataFrame:
    """Keys that stand on more than one side; a null key is none."""
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(side).alias("sides"), F.count("*").alias("n")).filter("sides > 1")


def straddling(rows: DataFrame, group: str, side: str) -> DataFrame:
    """Groups with the one side all their members have, null if they have none or several (`sides` of them)."""
    return rows.groupBy(group).agg(F.when(F.count_distinct(side) == 1, F.max(side)).alias("side"), F.count_distinct(side).alias("sides"))


def first_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return top_per(rows, keys, order)
