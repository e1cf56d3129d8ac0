"""Nearest neighbours by cosine with vantage-point trees, one per shard.

Vectors are compared by the chord between their directions, sqrt(2 - 2 cos), which is a
metric. Equal vectors are one class, of which the least ids are kept. A tree fitted on a
sample of at most `SAMPLE` classes deals all classes to regions, and a region to shards of
about `SHARD_ROWS` classes; every class is in one shard, and every shard has a tree of its
own over all its classes, built in one task and stored as one row of the index.

A query first searches the shards of its own region, which bounds the chord of its last
neighbour, then those of all other regions that the triangle inequality does not rule out.
Within a shard it descends to the nearest leaf, then visits each branch once unless its
bound rules it out. A branch at a chord of at least b is ruled out if relax * b is above
the query's bound; with relax 1 the search is exact, greater factors are faster and may
miss. Queries of a shard are taken in blocks of about `QUERY_ROWS`.

Results for special rows: vectors that are null, empty, zero, or hold nulls or numbers
that are not finite take no part, nor do null ids; shorter vectors count as padded with zeros;
repeated rows are one; rows with one id and several vectors are candidates and queries of
their own but never neighbours of each other; of equal scores the smaller ids come first;
a query with fewer candidates gets them all; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import Workspace

TOP = 5
EVERY = 50
#: Factor on the triangle bound; measured recall is in the README.
RELAX = 2.5
#: Classes that the tree of regions is fitted on, and those it needs for each region.
SAMPLE, SAMPLE_PER_REGION = 4096, 16
SHARD_ROWS = 4096
LEAF_ROWS = 128
QUERY_ROWS = 4096
#: Vantage points that are tried for a node, and points that they are tried on.
TRIES, TRIED_ON = 8, 64
#: Classes kept beyond those asked for, so that rounding of chords settles nothing.
SPARE = 4
ROUNDING = 1e-7

SHARD = "region int, chunk long, vectors array<double>, classes array<long>, ids array<long>, n_ids array<int>, leaves array<int>, vantage array<int>, child array<int>, low array<double>, high array<double>"
FOUND = "query long, class_id long, ids array<long>, chord double, score double"


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of doubles, padded with zeros; rows too large or small to square are scaled."""
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = values
    size = norms(out)
    odd = ~((size > 1e-150) & (size < 1e150))
    if odd.any():
        out[odd] /= np.abs(out[odd]).max(axis=1, keepdims=True)
    return out


def directions(x: np.ndarray) -> np.ndarray:
    return x / norms(x)[:, None]


def chords(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (a @ b.T)))


@dataclass
class Tree:
    """Node i has the vantage point vantage[i], and children 2i and 2i + 1: a node, or ~leaf."""

    vantage: list[int] = field(default_factory=list)
    child: list[int] = field(default_factory=list)
    low: list[float] = field(default_factory=list)
    high: list[float] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    @staticmethod
    def fit(units: np.ndarray, leaf_rows: int, tight: bool = True) -> Tree:
        """tight: children are bounded by the chords that occur, else by the median alone, which holds for points to come."""
        tree, rng = Tree(), np.random.default_rng(len(units))
        todo = [(np.arange(len(units)), -1)]
        while todo:
            rows, at = todo.pop()
            split = None
            if len(rows) > leaf_rows:
                tried = rng.choice(rows, min(TRIES, len(rows)), replace=False)
                spread = chords(units[tried], units[rng.choice(rows, min(TRIED_ON, len(rows)), replace=False)]).std(axis=1)
                vantage = int(tried[spread.argmax()])
                d = chords(units[rows], units[vantage : vantage + 1])[:, 0]
                middle = float(np.median(d))
                inside = d <= middle
                split = (inside, d, middle) if inside.any() and not inside.all() else None
            if split is None:  # few points, or all at one distance
                tree.leaves.append(rows)
                name = ~(len(tree.leaves) - 1)
            else:
                name = len(tree.vantage)
                tree.vantage.append(vantage)
                tree.child += [0, 0]
                tree.low += [float(d[inside].min()), float(d[~inside].min())] if tight else [0.0, middle]
                tree.high += [float(d[inside].max()), float(d[~inside].max())] if tight else [middle, 2.0]
                todo += [(rows[inside], 2 * name), (rows[~inside], 2 * name + 1)]
            if at >= 0:
                tree.child[at] = name
        return tree


@dataclass
class Regions:
    """The tree that deals vectors to regions; a single region has no node."""

    points: np.ndarray
    tree: Tree

    @staticmethod
    def fit(units: np.ndarray, regions: int) -> Regions:
        tree = Tree.fit(units, max(1, len(units) // max(1, regions)), tight=False) if len(units) else Tree(leaves=[np.zeros(0, int)])
        return Regions(units[tree.vantage], Tree(tree.vantage, tree.child, tree.low, tree.high, [np.zeros(0, int)] * len(tree.leaves)))

    def bounds(self, units: np.ndarray) -> np.ndarray:
        """The least chord at which each region's points can be, for each vector; its own region's is 0."""
        out = np.zeros((len(units), len(self.tree.leaves)))
        todo = [(0, np.zeros(len(units)))] if self.tree.vantage else []
        while todo:
            node, bound = todo.pop()
            d = chords(units, self.points[node : node + 1])[:, 0]
            for c in (2 * node, 2 * node + 1):
                below = np.maximum(bound, np.maximum(self.tree.low[c] - d, d - self.tree.high[c]))
                if self.tree.child[c] < 0:
                    out[:, ~self.tree.child[c]] = below
                else:
                    todo.append((self.tree.child[c], below))
        return out

    def home(self, units: np.ndarray) -> np.ndarray:
        at = np.zeros(len(units), np.int64) if self.tree.vantage else np.full(len(units), -1)
        child = np.array(self.tree.child, np.int64)
        while (at >= 0).any():
            for node in np.unique(at[at >= 0]).tolist():
                rows = np.flatnonzero(at == node)
                outside = chords(units[rows], self.points[node : node + 1])[:, 0] > self.tree.high[2 * node]
                at[rows] = child[2 * node + outside]
        return ~at


def placed_rows(regions: Regions, width: int):
    """mapInArrow function: adds each vector's own region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = regions.home(directions(matrix(batch.column("embedding"), width))) if batch.num_rows else np.zeros(0)
            yield pa.record_batch([*batch.columns, pa.array(home, pa.int32())], names=[*batch.schema.names, "region"])

    return run


def far_rows(regions: Regions, width: int, relax: float):
    """mapInArrow function: queries with their bounds to a row for each other region that isn't ruled out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            units = directions(matrix(batch.column("embedding"), width))
            bound = batch.column("bound").fill_null(np.inf).to_numpy(zero_copy_only=False)
            visit = relax * regions.bounds(units) <= bound[:, None] + ROUNDING
            visit[np.arange(len(units)), batch.column("region").to_numpy(zero_copy_only=False)] = False
            row, region = np.nonzero(visit)
            taken = batch.select(["query", "embedding", "bound"]).take(pa.array(row))
            yield pa.record_batch([*taken.columns, pa.array(region, pa.int32())], names=["query", "embedding", "bound", "region"])

    return run


def build_shard(width: int, leaf_rows: int):
    """applyInArrow function: a shard's classes to its row of the index, in the order of its tree's leaves."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        x = matrix(rows.column("embedding").chunk(0), width)
        tree = Tree.fit(directions(x), leaf_rows)
        order = np.concatenate(tree.leaves)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        ids = rows.column("ids").chunk(0).take(pa.array(order))
        columns = [
            (x[order].ravel(), pa.float64()), (rows.column("class_id").to_numpy()[order], pa.int64()), (ids.flatten().to_numpy(), pa.int64()), (pc.list_value_length(ids).to_numpy(), pa.int32()),
            ([len(leaf) for leaf in tree.leaves], pa.int32()), (place[tree.vantage] if tree.vantage else [], pa.int32()), (tree.child, pa.int32()), (tree.low, pa.float64()), (tree.high, pa.float64()),
        ]
        lists = [pa.array([np.asarray(v)], pa.list_(kind)) for v, kind in columns]
        heads = [pa.array([rows.column("region")[0].as_py()], pa.int32()), pa.array([rows.column("chunk")[0].as_py()], pa.int64())]
        return pa.table(heads + lists, names=["region", "chunk", "vectors", "classes", "ids", "n_ids", "leaves", "vantage", "child", "low", "high"])

    return run


def nearest_in_tree(units: np.ndarray, points: np.ndarray, tree: Tree, starts: np.ndarray, bound: np.ndarray, need: int, keep: int, relax: float) -> tuple[np.ndarray, np.ndarray]:
    """Chords and places of the `keep` nearest points of each query; bound: of its need-th nearest so far, lowered in place."""
    best, place = np.full((len(units), keep), np.inf), np.full((len(units), keep), -1, np.int64)

    def take(leaf: int, rows: np.ndarray) -> None:
        a, b = starts[leaf], starts[leaf + 1]
        both = np.concatenate([best[rows], chords(units[rows], points[a:b])], axis=1)
        names = np.concatenate([place[rows], np.broadcast_to(np.arange(a, b), (len(rows), b - a))], axis=1)
        order = np.argsort(both, axis=1, kind="stable")[:, :keep]
        best[rows], place[rows] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)
        bound[rows] = np.minimum(bound[rows], best[rows, need - 1])

    home = np.full(len(units), -1)
    todo = [(0 if tree.vantage else -1, np.flatnonzero(np.isinf(bound)))]
    while todo:  # to the nearest leaf
        node, rows = todo.pop()
        if not len(rows):
            continue
        if node < 0:
            home[rows] = ~node
            take(~node, rows)
            continue
        d = chords(units[rows], points[tree.vantage[node]][None])[:, 0]
        outside = d > tree.high[2 * node]
        todo += [(tree.child[2 * node], rows[~outside]), (tree.child[2 * node + 1], rows[outside])]

    todo = [(0 if tree.vantage else -1, np.arange(len(units)))]
    while todo:  # every branch that isn't ruled out, once
        node, rows = todo.pop()
        if node < 0:
            rows = rows[home[rows] != ~node]
            if len(rows):
                take(~node, rows)
            continue
        d = chords(units[rows], points[tree.vantage[node]][None])[:, 0]
        for c in (2 * node, 2 * node + 1):
            below = np.maximum(tree.low[c] - d, d - tree.high[c])
            near = rows[relax * below <= bound[rows] + ROUNDING]
            if len(near):
                todo.append((tree.child[c], near))
    return best, place


def search_shard(width: int, need: int, relax: float):
    """Cogrouped applyInArrow function: a block of queries and a shard to the nearest classes of each query."""

    def run(queries: pa.Table, shard: pa.Table) -> pa.Table:
        names = ["query", "class_id", "ids", "chord", "score"]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.float64(), pa.float64()]
        if not len(queries) or not len(shard):
            return pa.table([pa.array([], k) for k in kinds], names=names)
        get = lambda c: shard.column(c)[0].values.to_numpy(zero_copy_only=False)
        queries = queries.combine_chunks()
        q, x = matrix(queries.column("embedding").chunk(0), width), get("vectors").reshape(-1, width)
        tree = Tree(get("vantage").tolist(), get("child").tolist(), get("low").tolist(), get("high").tolist())
        starts = np.concatenate([[0], np.cumsum(get("leaves"))])
        bound = queries.column("bound").chunk(0).fill_null(np.inf).to_numpy(zero_copy_only=False).copy()
        points = directions(x)
        best, place = nearest_in_tree(directions(q), points, tree, starts, bound, need, need + SPARE, relax)
        row, k = np.nonzero(place >= 0)
        at = place[row, k]
        # each pair's products are added up in one order, whatever else is in the block
        score = (q[row] * x[at]).sum(axis=1) / (norms(q)[row] * norms(x)[at])
        ends = np.concatenate([[0], np.cumsum(get("n_ids"))])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(get("ids"))).take(pa.array(at))
        return pa.table([pa.array(queries.column("query").to_numpy()[row]), pa.array(get("classes")[at]), lists, pa.array(best[row, k]), pa.array(score)], names=names)

    return run


def usable(vector: Column) -> Column:
    """Whether a vector has a direction."""
    number = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    return F.coalesce(F.forall(vector, number) & F.exists(vector, lambda x: x != 0), F.lit(False))


@dataclass
class Index:
    """Shards' rows, the classes in them, and the tree of regions."""

    shards: DataFrame
    classes: DataFrame
    regions: Regions
    width: int
    top: int


def build_index(vectors: DataFrame, top: int = TOP, shard_rows: int = SHARD_ROWS, sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS, workspace: Workspace | None = None) -> Index:
    """vectors: vec_id and embedding, all usable."""
    workspace = workspace or Workspace(vectors.sparkSession, "vectors")
    # of a class, the least ids: enough for the query's own and as many others as are asked for
    least = F.dense_rank().over(Window.partitionBy("embedding").orderBy("vec_id"))
    members = vectors.withColumn("least", least).filter(F.col("least") <= top + 1)
    classes = members.groupBy("embedding").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).select(F.col("ids")[0].alias("class_id"), "ids", "embedding")
    classes = workspace.save(classes, "classes")
    n, width = classes.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    chosen = classes.orderBy(F.xxhash64("class_id"), "class_id").limit(sample).select("embedding").toArrow()  # bounded
    units = directions(matrix(chosen.column(0).combine_chunks(), width)) if len(chosen) else np.zeros((0, width))
    regions = Regions.fit(units, min(-(-n // shard_rows), len(units) // SAMPLE_PER_REGION))

    placed = workspace.save(classes.mapInArrow(placed_rows(regions, width), classes.withColumn("region", F.lit(0)).schema), "placed")
    sizes = placed.groupBy("region").agg(F.ceil(F.count("*") / shard_rows).alias("chunks"))
    sizes = F.broadcast(sizes)  # at most sample / SAMPLE_PER_REGION rows, about
    dealt = placed.join(sizes, "region").withColumn("chunk", F.pmod(F.xxhash64("class_id"), F.col("chunks"))).drop("chunks")
    shards = workspace.save(dealt.groupBy("region", "chunk").applyInArrow(build_shard(width, leaf_rows), SHARD), "shards")
    return Index(shards, classes, regions, width, top)


def _searched(visits: DataFrame, index: Index, need: int, relax: float, blocks: int, workspace: Workspace, name: str) -> DataFrame:
    """The nearest classes of each query in each shard of the regions that it visits."""
    shards = index.shards.select("region", "chunk")
    visits = visits.join(shards, "region").withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)))
    visits = workspace.save(visits.select("region", "chunk", "block", "query", "embedding", "bound"), f"visits-{name}")
    key = ["region", "chunk", "block"]
    held = index.shards.join(visits.select(*key).distinct(), ["region", "chunk"])
    held = held.select(*(F.col(c).alias(c) for c in held.columns))
    found = visits.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(search_shard(index.width, need, relax), FOUND)
    first = F.row_number().over(Window.partitionBy("query").orderBy("chord", "class_id"))
    return workspace.save(found.withColumn("first", first).filter(F.col("first") <= need + SPARE), f"found-{name}")


def nearest(queries: DataFrame, index: Index, relax: float = RELAX, query_rows: int = QUERY_ROWS, workspace: Workspace | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for queries (vec_id, embedding) that are rows of the index."""
    workspace = workspace or Workspace(queries.sparkSession, "nearest")
    need = index.top + 1  # classes, the query's own included
    classes = index.classes.select("class_id", "embedding")
    named = workspace.save(queries.join(classes, "embedding").select(F.col("vec_id").alias("query_id"), F.col("class_id").alias("query")), "named")
    asked = classes.join(named.select(F.col("query").alias("class_id")).distinct(), "class_id").select(F.col("class_id").alias("query"), "embedding")
    asked = asked.mapInArrow(placed_rows(index.regions, index.width), asked.withColumn("region", F.lit(0)).schema)
    asked = workspace.save(asked, "asked")
    blocks = max(1, -(-asked.count() // query_rows))

    near = _searched(asked.withColumn("bound", F.lit(None).cast("double")), index, need, relax, blocks, workspace, "near")
    bounds = near.filter(F.col("first") == need).select("query", F.col("chord").alias("bound"))
    far = asked.join(bounds, "query", "left").mapInArrow(far_rows(index.regions, index.width, relax), asked.withColumn("bound", F.lit(0.0)).select("query", "embedding", "bound", "region").schema)
    both = near.unionByName(_searched(far, index, need, relax, blocks, workspace, "far"))

    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "class_id"))
    best = both.withColumn("place", place).filter(F.col("place") <= need + SPARE)
    member = lambda x: F.transform(x["ids"], lambda i: F.struct((-x["score"]).alias("away"), i.alias("vec_id")))
    best = best.groupBy("query").agg(F.array_sort(F.flatten(F.transform(F.collect_list(F.struct("ids", "score")), member))).alias("best"))
    best = workspace.save(best, "best")
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, index.top)
    out = named.join(best, "query").select("query_id", F.posexplode(others).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.away")).alias("score"))


def op11_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    vectors = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    return nearest(vectors.filter(F.col("vec_id") % EVERY == 0), build_index(vectors))
