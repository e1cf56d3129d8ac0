"""Evaluation analytics. A null prediction means "not scored" and is never a miss.

Empty tables give no groups, or one row of zeros without a group; a null group is a group;
repeated rows count as often as they stand there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions.scalars import precision_at, wilson
from palisade.sources.scratch import Scratch

#: Ranges of a group's values that are sorted apart; raise it with the distinct values of a group.
RANGES = 64


def confusion(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """rows (label, pred booleans) to counts, precision, recall and F1 (0 where undefined)."""
    n = lambda c: F.count_if(c)
    out = rows.groupBy(*by).agg(
        n(F.col("label") & F.col("pred")).alias("tp"), n(~F.col("label") & F.col("pred")).alias("fp"),
        n(F.col("label") & ~F.col("pred")).alias("fn"), n(~F.col("label") & ~F.col("pred")).alias("tn"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def rates(rows: DataFrame, by: list[str], flag: str) -> DataFrame:
    """k, n, rate and its Wilson interval of a boolean; nulls are left out."""
    out = rows.groupBy(*by).agg(F.count_if(F.col(flag)).alias("k"), F.count(flag).alias("n"))
    low, high = wilson(F.col("k").cast("double"), F.col("n").cast("double"))
    return out.select(*by, "k", "n", F.try_divide("k", "n").alias("rate"), low.alias("low"), high.alias("high"))


def sweep(scored: DataFrame, grid: list[float]) -> DataFrame:
    """Confusion at every threshold of a grid, in one pass over the scores."""
    at = scored.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in grid])))
    return confusion(at.withColumn("pred", F.col("score") >= F.col("threshold")), ["threshold"])


def base_rate_precision(tpr: Column, fpr: Column, rows: DataFrame, base_rates: list[float]) -> DataFrame:
    out = rows.select("*", F.explode(F.array(*[F.lit(b) for b in base_rates])).alias("base_rate"))
    return out.withColumn("precision_at_base_rate", precision_at(tpr, fpr, F.col("base_rate")))


def paired(first: DataFrame, second: DataFrame) -> DataFrame:
    """(id, pred) of two runs to the 2 x 2 table of ids scored in both, and ids only in one."""
    both = first.filter("pred is not null").select("id", F.col("pred").alias("a")).join(second.filter("pred is not null").select("id", F.col("pred").alias("b")), "id", "full_outer")
    return both.agg(
        F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(~F.col("a") & F.col("b")).alias("only_b"),
        F.count_if(~F.col("a") & ~F.col("b")).alias("neither"), F.count_if(F.col("b").isNull()).alias("missing_b"), F.count_if(F.col("a").isNull()).alias("missing_a"),
    )


def flip_rate(rows: DataFrame, repeats: int) -> DataFrame:
    """Share of ids whose prediction differs between repeats, of those scored in all."""
    by_id = rows.groupBy("id").agg(F.count_distinct("pred").alias("kinds"), F.count("pred").alias("n")).filter(F.col("n") == repeats)
    return by_id.agg(F.count_if(F.col("kinds") > 1).alias("flips"), F.count("*").alias("items")).withColumn("rate", F.try_divide("flips", "items"))


def nearest_rank(rows: DataFrame, by: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """Quantiles at place ceil(p * n) of the sorted values; nulls are left out.

    Equal values are counted first; then the ranges of values of a group, by its quantiles of a
    sketch, are numbered apart and only the range that holds the place is looked into, so
    that a group is never sorted in one task.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    key = lambda i: f"_key{i}"
    keys = [F.col(c).alias(key(i)) for i, c in enumerate(by)]
    on = [F.col(c).eqNullSafe(F.col(key(i))) for i, c in enumerate(by)]
    drop = [key(i) for i in range(len(by))]
    cuts = counts.groupBy(*keys).agg(F.sum("_n").alias("n"), F.percentile_approx("_v", F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)]), F.lit(10 * RANGES)).alias("_cuts"))
    # which range a value is in: as many cuts as are below it
    # a sketch depends on the order in which parts of it are merged: it is kept, so that both uses below cut at the same places
    cuts = Scratch(rows.sparkSession, "ranks").save(cuts, "cuts")
    placed = (counts.join(cuts, on) if by else counts.crossJoin(cuts)).drop(*drop)  # without a group the cuts are one row
    placed = placed.withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    parts = placed.groupBy(*keys, F.col("_part").alias("_p")).agg(F.sum("_n").alias("_in"))
    # RANGES rows a group
    before = parts.withColumn("_before", F.coalesce(F.sum("_in").over(Window.partitionBy(*drop).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_in")
    both = placed.join(before, [*on, F.col("_part") == F.col("_p")]).drop(*drop, "_p")
    upto = both.withColumn("_to", F.col("_before") + F.sum("_n").over(Window.partitionBy(*by, "_part").orderBy("_v")))
    picks = [F.min(F.when(F.col("_to") >= F.ceil(F.lit(p) * F.col("n")), F.col("_v"))).alias(name) for name, p in ps.items()]
    return upto.groupBy(*by).agg(F.max("n").alias("n"), *picks)


def bounds(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rates if all unknown predictions were negative, or positive."""
    out = rows.groupBy(*by).agg(F.count_if("pred").alias("k"), F.count_if(F.col("pred").isNull()).alias("unknown"), F.count("*").alias("n"))
    return out.withColumn("low", F.col("k") / F.col("n")).withColumn("high", (F.col("k") + F.col("unknown")) / F.col("n"))
