"""Places within groups of any size, ties included, by salted two-stage windows.

Rows of a group are ordered by the columns of a pair; a row's place is one more than the
group's rows with an earlier pair, so equal pairs share a place. First, groups above
`salt_rows` rows are dealt into subgroups of about that size, and a row goes when its own
subgroup already has `places` earlier rows; what is left holds every row of the places
asked for and every row before them. Then survivors are sorted into ranges that pay no
heed to groups, so that no group is ever gathered in one task: counts of each cell (group,
pair, range) are carried on from cell to cell, which gives the places, the tied rows (the
sum of the partial counts of a pair) and the first position of each cell, and rows are
numbered within cells.

Results for special rows: nulls of group columns are equal to each other, and so are
those of pairs, which come first; nulls of the columns that order ties come last; repeated
rows are ranked separately; an empty table gives an empty one; columns of any name go
through, but for those named pos, place and tied, which the results replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import Workspace

PLACES = 3
#: Rows of a subgroup, about.
SALT_ROWS = 200_000
#: Groups with subgroups (of under 100 bytes) up to which their list is broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 20_000
OWN = ("pos", "place", "tied")


def _named(prefix: str, columns: list[Column]) -> list[Column]:
    return [c.alias(f"{prefix}{i}") for i, c in enumerate(columns)]


def _salted(flat: DataFrame, group: list[str], salt_rows: int, workspace: Workspace) -> DataFrame:
    """flat with the column salt: 0, or the subgroup in a group of more than salt_rows rows."""
    sizes = flat.groupBy(*group).agg(F.count("*").alias("n")).filter(F.col("n") > salt_rows)
    large = workspace.save(sizes.select(*(F.col(c).alias(f"of_{c}") for c in group), F.ceil(F.col("n") / salt_rows).alias("salts")), "large")
    n = large.limit(BROADCAST_GROUPS + 1).count()
    if not n:
        return flat.withColumn("salt", F.lit(0).cast("long"))
    same = None
    for c in group:
        same = F.col(c).eqNullSafe(F.col(f"of_{c}")) & (F.lit(True) if same is None else same)
    # repeated rows of different tasks get different salts
    joined = flat.withColumn("at", F.spark_partition_id()).join(F.broadcast(large) if n <= BROADCAST_GROUPS else large, same, "left")
    deal = F.pmod(F.xxhash64(*(c for c in flat.columns if c != "row"), "at"), F.col("salts"))
    return joined.select(*flat.columns, F.coalesce(deal, F.lit(0)).alias("salt"))


def top_places(
    rows: DataFrame, group: list[Column], pair: list[Column], then: list[Column], places: int = PLACES, salt_rows: int = SALT_ROWS, workspace: Workspace | None = None
) -> DataFrame:
    """The rows whose place in their group is at most `places`, with pos, place and tied.

    pos counts a group's rows from 1 by the pair and then by `then`; tied counts the
    group's rows that have a row's pair.
    """
    spark = rows.sparkSession
    workspace = workspace or Workspace(spark, "places")
    kept = [F.col(f"`{c.replace('`', '``')}`") for c in rows.columns if c not in OWN]
    g, p, t = ([f"{x}{i}" for i in range(len(c))] for x, c in (("g", group), ("p", pair), ("t", then)))
    flat = rows.select(*_named("g", group), *_named("p", pair), *_named("t", then), F.struct(*kept).alias("row"))

    local = F.rank().over(Window.partitionBy(*g, "salt").orderBy(*p))
    pruned = _salted(flat, g, salt_rows, workspace).withColumn("local", local).filter(F.col("local") <= places)
    # structs compare nulls as equal, so that groups and pairs with nulls can be joined
    survivors = workspace.save(pruned.select(F.struct(*g).alias("g"), F.struct(*p).alias("p"), *t, "row", F.monotonically_increasing_id().alias("uid")), "survivors")

    order = [*(F.col(c).asc_nulls_last() for c in t), F.col("uid")]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a table, as the bounds of ranges are sampled and must not change on a second look
    ranged = workspace.save(survivors.repartitionByRange(ranges, "g", "p", *order).withColumn("cell", F.spark_partition_id()), "ranged")

    cells = ranged.groupBy("g", "p", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("g").orderBy("p", "cell").rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("g", "p")
    cells = cells.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    cells = cells.withColumn("place", F.min("start").over(same) + 1).withColumn("tied", F.sum("n").over(same)).filter(F.col("place") <= places)

    within = F.row_number().over(Window.partitionBy("g", "p", "cell").orderBy(*order))
    out = ranged.join(cells.drop("n"), ["g", "p", "cell"])
    return out.select("row.*", (F.col("start") + within).alias("pos"), "place", "tied")


def op13_grouped_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/sale_lines.parquet")
    joint = F.coalesce(F.crc32(F.col("sale_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    own = lambda column: F.when(joint, F.lit(-1)).otherwise(column).cast("long")
    rows = lines.select(
        own(F.col("vendor_id")).alias("vendor_id"),
        own(F.coalesce(F.col("item_id") % 10, F.lit(-1))).alias("part"),
        own(F.coalesce(100 * F.year("shipped_at") + F.month("shipped_at"), F.lit(-1))).alias("month"),
        F.col("sale_id").cast("long").alias("sale_id"), F.col("line_no").cast("long").alias("line_no"), F.col("quantity").cast("long").alias("quantity"),
        F.floor(100 * F.col("discount") + 0.5).alias("percent"), F.floor(100 * F.col("amount") + 0.5).alias("amount_cents"),
    )
    found = top_places(
        rows, [F.col("vendor_id"), F.col("part"), F.col("month")], [-F.floor(F.col("quantity") / 10), F.col("percent")], [F.col(c) for c in ("sale_id", "line_no", "quantity", "amount_cents")]
    )
    return found.select("vendor_id", "part", "month", "pos", "place", "sale_id", "line_no", "quantity", "percent", "amount_cents", "tied")


#: CRC-32 of a number's decimal text, digit by digit through a table made from its polynomial.
ORACLE = """
WITH crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t
), sales AS (
  SELECT sale_id, xor(list_reduce(list_transform(string_split(CAST(sale_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT)),
    lambda c, d: xor(c >> 8, t[(xor(c, d) & 255) + 1]), 4294967295), 4294967295) AS crc
  FROM (SELECT DISTINCT sale_id FROM sale_lines WHERE sale_id IS NOT NULL), crc_table
), lines AS (
  SELECT CASE WHEN crc % 5 = 0 THEN -1 ELSE vendor_id END AS vendor_id,
    CASE WHEN crc % 5 = 0 THEN -1 ELSE coalesce(item_id % 10, -1) END AS part,
    CASE WHEN crc % 5 = 0 THEN -1 ELSE coalesce(100 * year(shipped_at) + month(shipped_at), -1) END AS month,
    sale_id, CAST(line_no AS BIGINT) AS line_no, CAST(quantity AS BIGINT) AS quantity, CAST(floor(quantity / 10.0) AS BIGINT) AS tens,
    CAST(floor(100 * discount + 0.5) AS BIGINT) AS percent, CAST(floor(100 * amount + 0.5) AS BIGINT) AS amount_cents
  FROM sale_lines LEFT JOIN sales USING (sale_id)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY vendor_id, part, month ORDER BY tens DESC NULLS FIRST, percent ASC NULLS FIRST,
      sale_id ASC NULLS LAST, line_no ASC NULLS LAST, quantity ASC NULLS LAST, amount_cents ASC NULLS LAST) AS pos,
    rank() OVER (PARTITION BY vendor_id, part, month ORDER BY tens DESC NULLS FIRST, percent ASC NULLS FIRST) AS place,
    count(*) OVER (PARTITION BY vendor_id, part, month, tens, percent) AS tied
  FROM lines
)
SELECT CAST(vendor_id AS BIGINT) AS vendor_id, CAST(part AS BIGINT) AS part, CAST(month AS BIGINT) AS month, CAST(pos AS BIGINT) AS pos, CAST(place AS BIGINT) AS place,
  sale_id, line_no, quantity, percent, amount_cents, CAST(tied AS BIGINT) AS tied
FROM ranked WHERE place <= 3
"""
