"""Shards by a hierarchical weighted hash tree: region, rack, shard.

At each level a document draws -ln(u) / weight for every child, u hashed from its key,
the level and the child; the least draw wins. A child whose weight grows can only win
draws, so rows move into the subtree that changed and nowhere else. A tree is founded with
`base` shards, dealt to regions of racks; each shard that comes later is a region of its
own, so from any count on one more shard takes rows only into itself. A count below the
base is an error: it would be another tree. The law is `key`: doc_id and the shard count
decide.

A slot is a row's place in its shard: counts of (shard, cell) give each cell's offset and
rows are numbered within cells, so that no shard is ever gathered in one task.

Results for special rows: a null text has no bytes and the checksum of none (0); a null
doc_id is a key of its own; repeated rows get the same shard and slots of their own; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .kernels import BYTE_BASE, mix

SHARDS = 40
RACKS_PER_REGION = 2
SHARDS_PER_RACK = 4
#: Cells of a shard in which slots are numbered apart; raise it with the rows per shard.
CELLS = 256
ROW_BYTES = 16


@dataclass(frozen=True)
class Tree:
    """Shard numbers by region and rack; a node weighs what its shards weigh together, a shard 1 unless said otherwise."""

    regions: tuple[tuple[tuple[int, ...], ...], ...]
    weights: tuple[tuple[int, float], ...] = ()

    @staticmethod
    def of(shards: int, base: int = SHARDS, weights: dict[int, float] | None = None) -> Tree:
        if not 0 < base <= shards:
            raise ValueError(f"a tree of {base} shards can't have {shards}")
        racks = [tuple(range(r, min(base, r + SHARDS_PER_RACK))) for r in range(0, base, SHARDS_PER_RACK)]
        regions = [tuple(racks[i : i + RACKS_PER_REGION]) for i in range(0, len(racks), RACKS_PER_REGION)]
        return Tree(tuple(regions + [((s,),) for s in range(base, shards)]), tuple(sorted((weights or {}).items())))


def weight(node, weights: dict[int, float]) -> float:
    return weights.get(node, 1.0) if isinstance(node, int) else sum(weight(c, weights) for c in node)


def _draw(key: np.ndarray, name: str, w: float) -> np.ndarray:
    seed = np.uint64((zlib.crc32(name.encode()) + 1) * BYTE_BASE % (1 << 64))
    u = ((mix(key ^ mix(np.array([seed]))) >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)
    return -np.log(u) / w if w > 0 else np.full(len(key), np.inf)


def _descend(key: np.ndarray, node, weights: dict[int, float], name: str) -> np.ndarray:
    if isinstance(node, int):
        return np.full(len(key), node, np.int32)
    won = np.argmin([_draw(key, f"{name}/{i}", weight(c, weights)) for i, c in enumerate(node)], axis=0)
    out = np.zeros(len(key), np.int32)
    for i, child in enumerate(node):
        mine = won == i
        out[mine] = _descend(key[mine], child, weights, f"{name}/{i}")
    return out


def descend(key: np.ndarray, tree: Tree) -> np.ndarray:
    """The shard in which each key's descent ends."""
    return _descend(key, tree.regions, dict(tree.weights), "")


def shard_rows(trees: list[Tree], cells: int):
    """mapInArrow function: adds shard, grown_shard and cell to the rows' columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            key = mix(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) + np.uint64(1))
            key[ids.is_null().to_numpy(zero_copy_only=False)] = np.uint64(0)
            shards = [pa.array(descend(key, tree)) for tree in trees]
            cell = pa.array((mix(key ^ np.uint64(BYTE_BASE)) % np.uint64(cells)).astype(np.int32))
            yield pa.record_batch([*batch.columns, *shards, cell], names=[*batch.schema.names, "shard", "grown_shard", "cell"])

    return run


def shard_documents(documents: DataFrame, shards: int = SHARDS, cells: int = CELLS, base: int | None = None, weights: dict[int, float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    trees = [Tree.of(n, base or shards, weights) for n in (shards, shards + 1)]
    rows = rows.mapInArrow(shard_rows(trees, cells), "doc_id long, size long, text_crc32 long, law string, shard int, grown_shard int, cell int")
    counts = rows.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each shard and cell, whatever the rows: 40 x 256
    offsets = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size"))
    placed = rows.withColumn("place", place).join(F.broadcast(offsets), ["shard", "cell"])
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", (F.col("offset") + F.col("place") - 1).cast("long").alias("slot"), "grown_shard")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
