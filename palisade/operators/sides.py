"""Assignment of components to sides, such as dev and test, in tasks of a bounded size.

Components go the largest first, each to the side that has least, measured against its
targets, of the cells that the component is in. In full that is a sequence, and it is
followed only where it matters: by the largest components of a split, up to `rows` rows,
in one task. The others are dealt by size, within a factor of two, and by hash into parts
of about `rows` rows. A part goes through its components by the same rule, against its
share of each cell's targets and of what the largest have filled, and so makes up for
them in proportion; what its last component leaves uneven is small, as like sizes meet.
A split of at most `rows` rows is assigned exactly as by the sequence.

Results for special rows: null sizes count as 0, sizes below 0 as they are; repeated rows
of a component and cell add up; null splits, components and cells are values of their own;
ties of size go by component, nulls first, and ties of cost to the first side by name; a
cell without a target has the target 1 on each side; empty tables give empty tables;
other columns are ignored. A component's cells are one row.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.sources.scratch import Scratch

ROWS = 50_000
#: Rows of sizes and splits (of some 40 bytes) up to which they are broadcast; more are joined by salted keys.
BROADCAST_CLASSES = 200_000

Targets = dict[str, dict[str, float]]


def _greedy(components: Iterable[tuple], targets: Targets, share: dict, filled: dict[str, dict]) -> list[str]:
    """A side for each of the components (component, size, cells), in the order given; `filled` is carried on."""
    sides, out = sorted(targets), []
    for _, _, cells in components:
        cost = {s: sum(n * (filled[s].get(c, 0) + n) / max(targets[s].get(c, 1.0) * share.get(c, 1.0), 1e-9) for c, n in cells) for s in sides}
        side = min(sides, key=lambda s: (round(cost[s], 9), s))
        for c, n in cells:
            filled[side][c] = filled[side].get(c, 0) + n
        out.append(side)
    return out


def _assign(rows: pa.Table, split: str, targets: Targets, share: dict, filled: dict[str, dict]) -> pa.Table:
    order = sorted(zip(rows["component"].to_pylist(), rows["size"].to_pylist(), rows["cells"].to_pylist()), key=lambda r: (-r[1], r[0] is not None, r[0] or 0))
    sides = _greedy([(c, n, [(x["cell"], x["n"]) for x in cells]) for c, n, cells in order], targets, share, filled)
    splits = rows[split].combine_chunks().slice(0, 1).to_pylist() * len(order)
    columns = [pa.array(splits, pa.int64()), pa.array([c for c, _, _ in order], pa.int64()), pa.array([n for _, n, _ in order], pa.int64()), pa.array(sides, pa.string())]
    return pa.Table.from_arrays(columns, names=[split, "component", "n", "side"])


def dealt(parts: DataFrame, split: str = "split", rows: int = ROWS) -> DataFrame:
    """parts (split, component, cell, n) as a row per component: its size, cells, class of size, and part; part -1 is the split's largest."""
    cells = parts.groupBy(F.col(split).cast("long").alias(split), F.col("component").cast("long").alias("component"), F.col("cell").cast("string").alias("cell")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))
    one = cells.groupBy(split, "component").agg(F.sum("n").alias("size"), F.array_sort(F.collect_list(F.struct("cell", "n"))).alias("cells"))  # a row's cells
    one = one.withColumn("class", F.when(F.col("size") > 0, F.floor(F.log2("size"))).otherwise(-1).cast("int"))
    classes = one.groupBy(split, "class").agg(F.sum(F.size("cells")).alias("held"))  # at most 64 rows a split
    so_far = F.sum("held").over(Window.partitionBy(split).orderBy(F.desc("class")))
    classes = classes.select(F.col(split).alias("_split"), F.col("class").alias("_class"), F.when(so_far > rows, F.ceil(F.col("held") / rows)).otherwise(0).cast("int").alias("_parts"))
    spark = parts.sparkSession
    place = F.pmod(F.xxhash64("component"), F.lit(1 << 30))
    if classes.limit(BROADCAST_CLASSES + 1).count() <= BROADCAST_CLASSES:
        joined = one.join(F.broadcast(classes), F.col(split).eqNullSafe(F.col("_split")) & (F.col("class") == F.col("_class")))
    else:
        salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        many = classes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = one.join(many, F.col(split).eqNullSafe(F.col("_split")) & (F.col("class") == F.col("_class")) & (F.pmod(place, F.lit(salts)) == F.col("_salt")))
    # another hash than the salt's, or the parts of a salt would be few
    part = F.when(F.col("_parts") == 0, -1).otherwise(F.pmod(F.xxhash64("component", F.lit("part")), F.greatest("_parts", F.lit(1)))).cast("int")
    return joined.select(split, "component", "size", "cells", F.when(F.col("_parts") == 0, -2).otherwise(F.col("class")).alias("class"), part.alias("part"))


def assign_sides(parts: DataFrame, targets: Targets, split: str = "split", rows: int = ROWS) -> DataFrame:
    """parts (split, component, cell, n) to (split, component, n, side).

    A side's cost is the sum over a component's cells of n * (filled + n) / target; the
    lowest wins. `rows` bounds the rows of a task.
    """
    sides, scratch = sorted(targets), Scratch(parts.sparkSession, "sides")
    schema = f"`{split}` long, component long, n long, side string"
    components = scratch.save(dealt(parts, split, rows), "components")
    largest, others = components.filter("part = -1"), components.filter("part <> -1")
    first = largest.groupBy(split).applyInArrow(lambda t: _assign(t, split, targets, {}, {s: {} for s in sides}), schema)
    first = scratch.save(first, "largest")
    if others.isEmpty():
        return first
    each = lambda df: df.select(*[c for c in df.columns if c != "cells"], F.explode("cells").alias("c")).select("*", "c.cell", "c.n")
    # what the largest fill of each cell, by side, and what the others hold of it: a row per split and cell
    took = largest.join(first.select(F.col(split).alias("_split"), F.col("component").alias("_component"), "side"), F.col(split).eqNullSafe(F.col("_split")) & F.col("component").eqNullSafe(F.col("_component"))).select(split, "side", "cells")
    fills = each(took).groupBy(split, "cell").pivot("side", sides).agg(F.sum("n")).na.fill(0, sides)
    fills = fills.select(F.col(split).alias("_split"), F.col("cell").alias("_cell"), F.array(*[F.col(f"`{s}`").cast("double") for s in sides]).alias("filled"))
    local = scratch.save(each(others).groupBy(split, "class", "part", "cell").agg(F.sum("n").alias("n")), "cells")
    total = local.groupBy(F.col(split).alias("_s"), F.col("cell").alias("_c")).agg(F.sum("n").alias("total"))
    known = local.join(total, F.col(split).eqNullSafe(F.col("_s")) & F.col("cell").eqNullSafe(F.col("_c"))).join(fills, F.col(split).eqNullSafe(F.col("_split")) & F.col("cell").eqNullSafe(F.col("_cell")), "left")
    known = known.select(split, "class", "part", "cell", F.when(F.col("total") != 0, F.col("n") / F.col("total")).otherwise(0.0).alias("share"), "filled")

    def run(rows: pa.Table, cells: pa.Table) -> pa.Table:
        names, shares, before = (cells[c].to_pylist() for c in ("cell", "share", "filled"))
        share = dict(zip(names, shares))
        filled = {s: {c: b[i] * share[c] for c, b in zip(names, before) if b} for i, s in enumerate(sides)}
        return _assign(rows, split, targets, share, filled)

    keys = [split, "class", "part"]
    return first.unionByName(others.groupBy(*keys).cogroup(known.groupBy(*keys)).applyInArrow(run, schema))
