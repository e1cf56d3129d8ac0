"""Seeded sampling: holdouts, quotas and apportionment.

Orders come from a hash of the seed and the keys, so they are the same for any input order
or partitioning, and a larger quota keeps all that a smaller one took. A null group or key
is one like any other. Empty tables give empty tables; repeated rows are sampled apart.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions.scalars import seeded

from .names import fresh, top_per


def _key(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("\0null"))


def smallest(rows: DataFrame, order: list[str], n: Column, prefix: str = "_h") -> DataFrame:
    """rows (with a seeded hash in `prefix`) and whether each is among the first n by (hash, order).

    Hashes are uniform: rows are counted by the hash's first characters, and only rows of
    the one prefix in which the n-th falls are numbered.
    """
    head = fresh("head", rows)
    marked = rows.withColumn(head, F.left(F.col(prefix), F.lit(3)))
    counts = marked.groupBy(head).agg(F.count("*").alias("_c"))  # 4096 rows at most
    before = counts.withColumn("_b", F.coalesce(F.sum("_c").over(Window.orderBy(head).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(head, "_b")
    placed = marked.join(F.broadcast(before), head).withColumn("_i", F.row_number().over(Window.partitionBy(head).orderBy(prefix, *order)))
    return placed.withColumn("_first", F.col("_b") + F.col("_i") <= n).drop(head, "_b", "_i")


def group_holdout(rows: DataFrame, group: str, fraction: float, seed: int) -> DataFrame:
    """Adds held_out: the first round(groups * fraction) groups in seeded order, whole groups only."""
    groups = rows.select(F.col(group).alias("_g")).distinct().withColumn("_h", seeded(seed, _key("_g")))
    n = groups.agg(F.bround(F.count("*") * F.lit(fraction), 0).cast("long").alias("_take"))
    chosen = smallest(groups.crossJoin(n), ["_g"], F.col("_take")).select("_g", F.col("_first").alias("held_out"))  # n is one row
    return rows.join(chosen, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def stratified(rows: DataFrame, stratum: list[str], id_: str, quota: int, seed: int) -> DataFrame:
    """The first `quota` rows of each stratum in seeded order."""
    return top_per(rows, stratum, [seeded(seed, *[F.col(c).cast("string") for c in stratum], F.col(id_).cast("string")), id_], quota)


def round_robin(rows: DataFrame, group: str, id_: str, n: int, cap: int, seed: int) -> DataFrame:
    """n rows, dealt over groups in seeded order, at most `cap` of a group."""
    turn = fresh("turn", rows)
    order = Window.partitionBy(group).orderBy(seeded(seed, F.col(id_).cast("string")), id_)
    dealt = rows.withColumn(turn, F.row_number().over(order)).filter(F.col(turn) <= cap)
    return dealt.orderBy(turn, seeded(seed, F.col(group).cast("string")), group).limit(n).drop(turn)


def largest_remainder(pools: DataFrame, key: str, size: str, n: int, capped: bool = False, weight: str | None = None) -> DataFrame:
    """Quotas that sum to n, in proportion to the pools' sizes or weights (one row per pool).

    capped: at most the pools together, and never more than a pool holds.
    """
    of = weight or size
    total = pools.agg(F.sum(of).alias("_total"), F.sum(size).alias("_pool"))
    target = F.least(F.lit(n), F.col("_pool")) if capped and not weight else F.lit(n)
    share = pools.crossJoin(total).withColumn("_n", target).withColumn("_share", F.coalesce(F.try_divide(F.col(of) * F.col("_n"), F.col("_total")), F.lit(0.0))).withColumn("_floor", F.floor("_share"))  # total is one row
    left = share.agg(F.max("_n").alias("_all"), F.sum("_floor").alias("_given"))
    order = Window.orderBy(F.desc(F.round(F.col("_share") - F.col("_floor"), 9)), key)
    out = share.withColumn("_i", F.row_number().over(order)).crossJoin(left)
    quota = (F.col("_floor") + F.when((F.col("_i") <= F.col("_all") - F.col("_given")) & (F.col("_total") > 0), 1).otherwise(0)).cast("long")
    return out.select(key, size, (F.least(quota, F.col(size).cast("long")) if capped else quota).alias("quota"))


# --- greedy choices over groups: one row a group, one task a pool ----------------------

def atomic_by_kind(items: DataFrame, pool: str, group: str, kind: str, id_: str, quotas: dict[str, int], seed: int) -> DataFrame:
    """Items of whole groups, in seeded order with complete pairs first, while every kind stays within its quota.

    Greedy: a group is taken if all its kinds fit. Per pool, groups are reduced to counts of
    their kinds before they are gone through, and no more of them than quotas could take of
    each make-up are kept.
    """
    kinds = sorted(quotas)
    wanted = items.filter(F.col(kind).isin(*kinds))
    counts = wanted.groupBy(pool, group).agg(*[F.count_if(F.col(kind) == k).alias(f"k{i}") for i, k in enumerate(kinds)])
    cols = [f"k{i}" for i in range(len(kinds))]
    makeup = counts.withColumn("_pair", sum((F.col(c) > 0).cast("int") for c in cols) > 1).withColumn("_h", seeded(seed, _key(pool), _key(group)))
    # of groups alike, the first that could be taken are as many as the least quota allows
    few = top_per(makeup, [pool, *cols], ["_h", group], max(quotas.values(), default=0) or 1)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_pair", "_h", group], ascending=[False, True, True], kind="stable")
        left, taken = [quotas[k] for k in kinds], []
        for need in rows[cols].itertuples(index=False):
            take = all(n <= have for n, have in zip(need, left))
            left = [have - n * take for n, have in zip(need, left)]
            taken.append(take)
        return rows[[pool, group]][taken]

    schema = f"{few.select(pool).schema[0].simpleString().replace(':', ' ')}, {few.select(group).schema[0].simpleString().replace(':', ' ')}"
    chosen = few.groupBy(pool).applyInPandas(run, schema)
    return wanted.join(chosen.select(F.col(pool).alias("_p"), F.col(group).alias("_g")), F.col(pool).eqNullSafe(F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")), "left_semi")


def balanced(items: DataFrame, pool: str, group: str, positive: str, n: int, seed: int) -> DataFrame:
    """At most n items of whole groups per pool, in seeded order, whose two labels never differ by more than one."""
    counts = items.groupBy(pool, group).agg(F.count_if(F.col(positive)).alias("v"), F.count_if(~F.col(positive)).alias("s"))
    few = top_per(counts.withColumn("_h", seeded(seed, _key(pool), _key(group))), [pool, "v", "s"], ["_h", group], n)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        a = b = 0
        taken = []
        for v, s in rows.sort_values(["_h", group], kind="stable")[["v", "s"]].itertuples(index=False):
            take = a + b + v + s <= n and abs(a + v - b - s) <= 1
            a, b = a + v * take, b + s * take
            taken.append(take)
        return rows.sort_values(["_h", group], kind="stable")[[pool, group]][taken]

    schema = f"{few.select(pool).schema[0].simpleString().replace(':', ' ')}, {few.select(group).schema[0].simpleString().replace(':', ' ')}"
    chosen = few.groupBy(pool).applyInPandas(run, schema)
    return items.join(chosen.select(F.col(pool).alias("_p"), F.col(group).alias("_g")), F.col(pool).eqNullSafe(F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")), "left_semi")


def preferred(items: DataFrame, by: list[str], first: str, id_: str, cap: int, seed: int) -> DataFrame:
    """Up to `cap` items of each group: those with a flag first, then the others, each in seeded order."""
    return top_per(items, by, [F.desc(F.coalesce(F.col(first), F.lit(False))), seeded(seed, F.col(id_).cast("string")), id_], cap)


def ordered_repos(repos: DataFrame, split: str, repo: str, seed: int, splits: tuple[str, ...] = ("dev", "test", "reserve")) -> DataFrame:
    """Adds place from 1: split by split, seeded within each. One row a repository."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, splits)), F.col(split)), F.lit(0))
    out = repos.withColumn("_rank", F.when(rank == 0, len(splits) + 1).otherwise(rank))
    sizes = out.groupBy("_rank").agg(F.count("*").alias("_c"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    place = F.row_number().over(Window.partitionBy("_rank").orderBy(seeded(seed, F.col(repo)), repo))
    return out.withColumn("_i", place).join(F.broadcast(before), "_rank").withColumn("place", F.col("_b") + F.col("_i")).drop("_rank", "_i", "_b")
