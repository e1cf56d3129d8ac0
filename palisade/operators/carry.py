"""Running values within a key of any size, by carries between ranges.

Rows are sorted into ranges by key and order, paying no heed to where a key ends, and
written. Each range's summary of each of its keys (a row) says what it adds: how many rows,
what sums, the last and the first value. A window over the summaries gives what each range
starts from, and a window within the range the rest. So one key's rows run in as many
tasks as there are ranges; a summary has a row for each key and range that meet.

Results for special rows: nulls of key columns are equal; order columns ascend, nulls
first, and rows that tie go in one fixed but arbitrary order, so give a column that tells
them apart; repeated rows are rows of their own; an empty table gives an empty one; columns
of any name go through, but for those that a result replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.sources.scratch import Scratch

BEFORE = (Window.unboundedPreceding, -1)
SO_FAR = (Window.unboundedPreceding, 0)
FROM_HERE = (0, Window.unboundedFollowing)
BEHIND = (1, Window.unboundedFollowing)


def running(
    rows: DataFrame, keys: list[str], order: list[Column | str], place: str | None = None, sums: dict[str, Column] | None = None,
    lags: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, nexts: dict[str, Column] | None = None, ranges: int | None = None,
) -> DataFrame:
    """rows with columns that depend on the rows before them, or behind them, in the order of their key.

    place: the number from 1. sums: the total up to the row, null while there is nothing to
    add. lags: the value of the row before. lasts and nexts: the last value up to the row,
    and the first from the row on, that is not null.
    """
    spark = rows.sparkSession
    sums, lags, lasts, nexts = (x or {} for x in (sums, lags, lasts, nexts))
    own = {*([place] if place else []), *sums, *lags, *lasts, *nexts}
    kept = [F.col(f"`{c.replace('`', '``')}`") for c in rows.columns if c not in own]
    values = {f"v{i}": value for i, value in enumerate([*sums.values(), *lags.values(), *lasts.values(), *nexts.values()])}
    sorts = {f"o{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(order)}
    # structs compare nulls as equal
    flat = rows.select(F.struct(*keys).alias("key"), F.struct(*kept).alias("row"), *(v.alias(n) for n, v in (values | sorts).items()), F.monotonically_increasing_id().alias("uid"))
    by = ["key", *sorts, "uid"]
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = flat.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("cell", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    # a row's place in its range is its order from here on
    dealt = Scratch(spark, "carry").save(dealt.drop("uid", *sorts), "ranges")

    names = list(values)
    n_sums, n_lags, n_lasts = names[: len(sums)], names[len(sums) : len(sums) + len(lags)], names[len(sums) + len(lags) : len(sums) + len(lags) + len(lasts)]
    n_nexts = names[len(sums) + len(lags) + len(lasts) :]
    there = lambda v: F.when(F.col(v).isNotNull(), F.col("at"))
    summary = dealt.groupBy("key", "cell").agg(
        F.count("*").alias("n"), *(F.sum(v).alias(v) for v in n_sums), *(F.max_by(F.struct(v), "at").alias(v) for v in n_lags),
        *(F.max_by(v, there(v)).alias(v) for v in n_lasts), *(F.min_by(v, there(v)).alias(v) for v in n_nexts),
    )
    over = lambda frame: Window.partitionBy("key").orderBy("cell").rowsBetween(*frame)
    carried = summary.select(
        "key", "cell", F.coalesce(F.sum("n").over(over(BEFORE)), F.lit(0)).alias("n0"), *(F.sum(v).over(over(BEFORE)).alias(f"{v}0") for v in n_sums),
        *(F.last(v, True).over(over(BEFORE)).alias(f"{v}0") for v in n_lags + n_lasts), *(F.first(v, True).over(over(BEHIND)).alias(f"{v}0") for v in n_nexts),
    )
    within = lambda frame: Window.partitionBy("key", "cell").orderBy("at").rowsBetween(*frame)
    number = F.row_number().over(Window.partitionBy("key", "cell").orderBy("at"))
    both = dealt.join(carried, ["key", "cell"])
    out = [(F.col("n0") + number).alias(place)] if place else []
    for name, v in zip(sums, n_sums):
        here = F.sum(v).over(within(SO_FAR))
        out.append(F.coalesce(here + F.col(f"{v}0"), here, F.col(f"{v}0")).alias(name))
    for name, v in zip(lags, n_lags):
        # the first row of a range looks at the last of the range before
        out.append(F.when(number == 1, F.col(f"{v}0")[v]).otherwise(F.lag(v).over(Window.partitionBy("key", "cell").orderBy("at"))).alias(name))
    out += [F.coalesce(F.last(v, True).over(within(SO_FAR)), F.col(f"{v}0")).alias(name) for name, v in zip(lasts, n_lasts)]
    out += [F.coalesce(F.first(v, True).over(within(FROM_HERE)), F.col(f"{v}0")).alias(name) for name, v in zip(nexts, n_nexts)]
    return both.select("row.*", *out)
