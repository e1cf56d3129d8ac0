"""Joins of lines and closed line intervals, by bins instead of nested loops.

A span is entered in the bins of a width of its own order of magnitude, so that it has
two or three of them whatever its length; a point is looked up once for each width that
occurs. Rows with a null key, place or end match nothing; a span that ends before it
starts holds nothing; repeated rows match each; columns of any name are kept, those of the
points first; empty sides give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .carry import running
from .names import fresh, top_per

#: Bins are powers of this; the least width is the base itself.
BASE = 32
#: Widths: up to BASE ** LEVELS lines.
LEVELS = 6


def overlaps(a1, b1, a2, b2):
    return (a1 <= b2) & (a2 <= b1)


def _level(length: Column) -> Column:
    """The least width, as a power of BASE, that is at least as long as the span."""
    out = F.lit(LEVELS)
    for i in range(LEVELS - 1, 0, -1):
        out = F.when(length <= BASE**i, i).otherwise(out)
    return out


def containing(points: DataFrame, spans: DataFrame, key: str | list[str], at: str, start: str, end: str) -> DataFrame:
    """All (point, span) with equal key and start <= at <= end."""
    keys = [key] if isinstance(key, str) else key
    level, place = fresh("level", points, spans), fresh("bin", points, spans)
    width = F.pow(F.lit(float(BASE)), F.col(level))
    s = spans.filter(F.col(start) <= F.col(end)).withColumn(level, _level(F.col(end) - F.col(start) + 1))
    s = s.withColumn(place, F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    p = points.filter(F.col(at).isNotNull()).withColumn(level, F.explode(F.array(*map(F.lit, range(1, LEVELS + 1)))))
    p = p.withColumn(place, F.floor(F.col(at) / width))
    return p.join(s, [*keys, level, place]).filter((F.col(start) <= F.col(at)) & (F.col(at) <= F.col(end))).drop(level, place)


def innermost(points: DataFrame, spans: DataFrame, key: str, point: list[str], at: str, start: str, end: str, position: str, outermost: bool = False) -> DataFrame:
    """The smallest (or largest) span around each point; the first position wins ties."""
    length = F.col(end) - F.col(start)
    return top_per(containing(points, spans, key, at, start, end), point, [length.desc() if outermost else length.asc(), position])


def outermost_within(points: DataFrame, spans: DataFrame, walls: DataFrame, key: str, point: list[str], at: str, start: str, end: str, position: str) -> DataFrame:
    """The largest span around each point that no wall (start, end) inside it shuts off from the point."""
    length = F.col(end) - F.col(start)
    inner = top_per(containing(points, walls.select(key, F.col(start).alias("_ws"), F.col(end).alias("_we")), key, at, "_ws", "_we"), point, [F.col("_we") - F.col("_ws")]).select(*point, "_ws", "_we")
    both = containing(points, spans, key, at, start, end).join(inner, point, "left")
    open_ = F.col("_ws").isNull() | ((F.col(start) >= F.col("_ws")) & (F.col(end) <= F.col("_we")))
    return top_per(both.filter(open_).drop("_ws", "_we"), point, [length.desc(), position])


def nearest(left: DataFrame, right: DataFrame, keys: list[str], row: list[str], at: str, to: str, position: str) -> DataFrame:
    """For each left row the right row of equal keys with the smallest distance; the first position wins ties.

    Left and right are merged in the order of the key and place; a left row sees the last
    right row before it and the first one behind it, carried from range to range, so that
    no pairs are made and no key is in one task.
    """
    mine, theirs = [c for c in left.columns if c not in keys], [c for c in right.columns if c not in keys]
    # of equal places only the first position counts
    r = top_per(right.filter(F.col(to).isNotNull()), [*keys, to], [position])
    none = lambda df, cols: F.lit(None).cast(df.select(F.struct(*cols)).schema[0].dataType)
    inner = [f"k{i}" for i in range(len(keys))]
    named = [F.col(k).alias(n) for k, n in zip(keys, inner)]
    known = lambda df: df.dropna(subset=keys)
    rows = known(left).filter(F.col(at).isNotNull()).select(*named, F.lit(1).alias("side"), F.col(at).alias("place"), F.struct(*mine).alias("l"), none(r, theirs).alias("r"))
    rows = rows.unionByName(known(r).select(*named, F.lit(0).alias("side"), F.col(to).alias("place"), none(left, mine).alias("l"), F.struct(*theirs).alias("r")))
    rows = running(rows, inner, ["place", "side"], lasts={"before": F.col("r")}, nexts={"behind": F.col("r")}).filter("side = 1")
    far = lambda c: F.abs(F.col("place") - F.col(c)[to])
    a, b = F.col("before"), F.col("behind")
    pick = F.when(a.isNull() | (far("behind") < far("before")) | ((far("behind") == far("before")) & (b[position] < a[position])), b).otherwise(a)
    out = rows.withColumn("r", pick).filter("r is not null")
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, inner)], *[F.col("l")[c].alias(c) for c in mine], *[F.col("r")[c].alias(c) for c in theirs])


def within(left: DataFrame, right: DataFrame, keys: list[str], at: str, to: str, distance: int) -> DataFrame:
    """All pairs of equal keys whose places differ by at most `distance`, met in bins of twice that."""
    place = fresh("bin", left, right)
    size = 2 * distance + 1
    a = left.withColumn(place, F.explode(F.array_distinct(F.array(F.floor((F.col(at) - distance) / size), F.floor((F.col(at) + distance) / size)))))
    return a.join(right.withColumn(place, F.floor(F.col(to) / size)), [*keys, place]).filter(F.abs(F.col(at) - F.col(to)) <= distance).drop(place)


def corroborated(findings: DataFrame, hits: DataFrame, key: str, finding: str, line: str, hit_line: str, source: str, distance: int = 3) -> DataFrame:
    """Each finding with the sorted sources that hit its unit within `distance` lines; a missing line fits any.

    Where a line is missing a unit's sources are first made one row each.
    """
    hit = hits.select(key, hit_line, F.col(source).alias("_source")).distinct()
    near = within(findings.filter(F.col(line).isNotNull()).select(finding, key, line), hit.filter(F.col(hit_line).isNotNull()), [key], line, hit_line, distance).select(finding, "_source")
    any_line = findings.select(finding, key).join(hit.filter(F.col(hit_line).isNull()).select(key, "_source").distinct(), key).select(finding, "_source")
    lost = findings.filter(F.col(line).isNull()).select(finding, key).join(hit.select(key, "_source").distinct(), key).select(finding, "_source")
    found = near.unionByName(any_line).unionByName(lost).groupBy(finding).agg(F.array_join(F.array_sort(F.collect_set("_source")), ",").alias("sources"))
    return findings.join(found, finding, "left")
