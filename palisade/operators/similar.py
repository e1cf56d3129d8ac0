"""Exact near-duplicate links between sets of tokens: numbers are dealt out, never the sets of all rows.

A set of n tokens is known by 32-bit hashes of its rarest tokens (its prefix) and by a
bitmap of 2 n to 4 n bits. Sets that share a prefix hash are candidates, bitmaps rule
out nearly all that are far apart, and the rest are compared by their tokens' strings. Equal
hashes of different tokens and a coarse order of rarity cost work, never a link.

Null ids link nothing; repeated ids count once, by one of their sets; empty tables give empty ones.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.sources.scratch import Scratch

from .diffs import use_small_batches

#: Rows of one token up to which its sets are paired in one place; more are dealt over cells.
CELL = 2000
#: Counters of tokens by hash, and the parts that they are added up in.
COUNTERS, SLICES = 1 << 22, 64
#: Candidates that a task holds before it puts repeated ones together.
HELD = 1 << 19
#: Heads whose bitmaps, bytes of tokens and candidates that make one block of the two in a task.
BLOCK_HEADS, BLOCK_BYTES, BLOCK_PAIRS = 32000, 32 << 20, 1 << 20
#: Slack for products with the threshold: too many candidates, never too few.
EPS = 1e-9


def _arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of an array of lists of numbers."""
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(_starts(lengths)), pa.array(values)).cast(pa.list_(pa.from_numpy_dtype(values.dtype)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h) to one row a slice: how often a hash fell on each of its counters."""
    counts = np.zeros(COUNTERS, np.uint32)
    for batch in batches:
        np.add.at(counts, _arrays(batch.column("h"))[0] & (COUNTERS - 1), 1)
    yield pa.record_batch([pa.array(range(SLICES), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in np.split(counts, SLICES)])], names=["slice", "counts"])


def _added(table: pa.Table) -> pa.Table:
    """A slice's counters added up, as eighths of powers of two; 0 is a count of one at most."""
    total = np.zeros(COUNTERS // SLICES, np.int64)
    for x in table["counts"]:
        total += np.frombuffer(zlib.decompress(x.as_py()), np.uint32)
    eighths = np.ceil(8 * np.log2(np.maximum(total, 1))).clip(0, 255).astype(np.uint8)
    return pa.table({"slice": table["slice"].slice(0, 1), "counts": pa.array([zlib.compress(eighths.tobytes(), 1)])})


def _rarity(hashed: DataFrame) -> np.ndarray:
    """How frequent a counter's tokens are: a byte each, whatever the number of rows or tokens."""
    parts = hashed.select("h").mapInArrow(_counted, "slice int, counts binary").groupBy("slice").applyInArrow(_added, "slice int, counts binary").collect()
    found = {r["slice"]: np.frombuffer(zlib.decompress(r["counts"]), np.uint8) for r in parts}
    return np.concatenate([found.get(i, np.zeros(COUNTERS // SLICES, np.uint8)) for i in range(SLICES)])


def _signed(rarity: np.ndarray, threshold: float, least: int) -> Callable:
    """mapInArrow function: (id, digest, h) to (id, digest, n, prefix, bits); sets that link nothing have neither."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n = _arrays(batch.column("h"))
            links = (n >= max(least, 1)) & batch.column("id").is_valid().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((h, rarity[h & (COUNTERS - 1)], row))
            most = np.where(links, n - np.ceil(n * threshold - EPS).astype(np.int64) + 1, 0)
            near = np.arange(len(h)) - np.repeat(_starts(n)[:-1], n) < np.repeat(most, n)
            size = np.where(links, _size(n), 0)
            bits = np.zeros(int(size.sum()) * 8, bool)
            at = np.repeat(_starts(size)[:-1] * 8, n) + (h & np.repeat(np.maximum(size * 8, 1) - 1, n))
            bits[at[np.repeat(links, n)]] = True
            packed, ends = np.packbits(bits).tobytes(), _starts(size)
            yield pa.record_batch(
                [batch.column("id"), batch.column("digest"), pa.array(n.astype(np.int32)), _lists(h[order][near], most), pa.array([packed[a:b] for a, b in zip(ends, ends[1:])], pa.binary())],
                names=["id", "digest", "n", "prefix", "bits"],
            )

    return run


def _size(n: np.ndarray) -> np.ndarray:
    """Bytes of the bitmap of a set: a power of two, 2 n to 4 n bits."""
    return 1 << np.ceil(np.log2(np.clip(n, 32, 1 << 20) / 4)).astype(np.int64)


def _posted(rarity: np.ndarray, cell: int) -> Callable:
    """mapInArrow function: (key, n, prefix) to a row for each prefix hash and cell that it meets others in.

    `place` is the hash, mixed with the cell, over n; `way` is the hash before it in the
    set, the position, and 2 if all in the cell may meet, else the side that this one is on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, length = _arrays(batch.column("prefix"))
            key, n = (np.repeat(batch.column(c).to_numpy().astype(np.int64), length) for c in ("key", "n"))
            at = np.arange(len(h)) - np.repeat(_starts(length)[:-1], length)
            rare, before = rarity[h & (COUNTERS - 1)], np.append(h[:1], h[:-1])
            some = rare > 0  # a token that one set has alone links nothing
            h, key, n, at, rare, before = (x[some].astype(np.int64) for x in (h, key, n, at, rare, before))
            parts = np.ceil(2 ** (np.arange(256) / 8) / cell).astype(np.int64)[rare]
            mine = (key * 0x9E3779B1 >> 16) % parts
            # cell (i, j), i <= j: a set of part p is in all cells that name p
            row = np.repeat(np.arange(len(h)), parts)
            other = np.arange(len(row)) - np.repeat(_starts(parts)[:-1], parts)
            mine, many = mine[row], parts[row] > 1
            i, j = np.minimum(mine, other), np.maximum(mine, other)
            mixed = np.where(many, (h[row] ^ (i * 0x85EBCA6B + j * 0xC2B2AE35 + 0x27D4EB2F)).astype(np.int32).astype(np.int64), h[row])
            way = np.where(i == j, 2, np.where(mine == i, 0, 1))
            yield pa.record_batch([pa.array(mixed << 32 | n[row]), pa.array(key[row]), pa.array(before[row] << 32 | at[row] << 2 | way)], names=["place", "key", "way"])

    return run


def _met(place: np.ndarray, key: np.ndarray, way: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys of rows of one hash that may be near by their sizes and positions. Rows are sorted by hash and size.

    Two whose hashes before are equal as well have met there.
    """
    h, n, before, at, way = place >> 32, place & 0xFFFFFFFF, way >> 32, (way & 0xFFFFFFFF) >> 2, way & 3
    last = np.append(np.flatnonzero(h[1:] != h[:-1]) + 1, len(h))
    end = np.repeat(last, np.diff(last, prepend=0))
    room, share = n - at, threshold / (1 + threshold)
    # the smaller set of a pair needs room for the overlap with one of its own size at least
    rows = np.flatnonzero(room >= 2 * n * share - EPS)
    for lag in range(1, len(h)):
        rows = rows[rows + lag < end[rows]]
        rows = rows[n[rows] >= threshold * n[rows + lag] - EPS]
        if not rows.size:
            return
        other = rows + lag
        fits = (np.minimum(room[rows], room[other]) >= (n[rows] + n[other]) * share - EPS) & ((way[rows] == 2) | (way[rows] != way[other])) & (key[rows] != key[other])
        fits &= (before[rows] != before[other]) | (at[rows] == 0) | (at[other] == 0)
        a, b = key[rows[fits]], key[other[fits]]
        yield np.minimum(a, b), np.maximum(a, b)


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _candidates(threshold: float, blocks: int) -> Callable:
    """mapInArrow function: sorted rows of _posted to the candidates of each two blocks of keys."""

    def dealt(found: list) -> Iterator[pa.RecordBatch]:
        if not found:
            return
        a, b = _distinct(*(np.concatenate(x) for x in zip(*found)))
        block = np.minimum(a % blocks, b % blocks) * blocks + np.maximum(a % blocks, b % blocks)
        order = np.argsort(block, kind="stable")
        names, lengths = np.unique(block, return_counts=True)
        yield pa.record_batch([pa.array(names.astype(np.int32)), _lists(a[order], lengths), _lists(b[order], lengths)], names=["block", "a", "b"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        """Rows with all those of their hashes."""
        rest = None
        for batch in batches:
            now = [x.to_numpy() for x in batch.columns]
            rest = now if rest is None else [np.concatenate(x) for x in zip(rest, now)]
            if len(rest[0]):
                h = rest[0] >> 32
                cut = np.searchsorted(h, h[-1])  # the last hash may go on
                yield [x[:cut] for x in rest]
                rest = [x[cut:] for x in rest]
        if rest:
            yield rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for rows in runs(batches):
            for pair in _met(*rows, threshold):
                found.append(pair)
                held += len(pair[0])
                if held >= HELD:
                    yield from dealt(found)
                    found, held = [], 0
        yield from dealt(found)

    return run


def _pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of columns a and b, of keys or of lists of keys."""
    found = [np.zeros(0, np.int64)] * 2
    for batch in table.to_batches():
        now = ((x.flatten() if pa.types.is_list(x.type) else x).to_numpy(zero_copy_only=False) for x in (batch.column("a"), batch.column("b")))
        found = _distinct(*(np.concatenate(x) for x in zip(found, now)))
    return tuple(found)


def _unruled(threshold: float) -> Callable:
    """Cogrouped function: candidates and bitmaps of two blocks to the candidates whose bitmaps leave room for the overlap.

    A bit that only one of two bitmaps has stands for a token that the other set lacks; the
    larger of two bitmaps is folded.
    """

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        if not pairs.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        a, b = _pairs(pairs)
        key, first = np.unique(sets["key"].to_numpy(), return_index=True)
        n, bits = sets["n"].to_numpy()[first].astype(np.int64), sets["bits"].combine_chunks().take(pa.array(first))
        size = _size(n)
        flat, start = np.frombuffer(b"".join(bits.to_pylist()), np.uint8), _starts(size)[:-1]
        left, right = np.searchsorted(key, a), np.searchsorted(key, b)
        kept = np.zeros(len(a), bool)
        kinds = size[left] << 32 | size[right]
        for kind in np.unique(kinds):
            x, y = int(kind) >> 32, int(kind) & 0xFFFFFFFF
            rows, step = np.flatnonzero(kinds == kind), max(1, (4 << 20) // max(x, y))
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                p, q = (_folded(flat[start[side[some], None] + np.arange(z)], min(x, y)) for side, z in ((left, x), (right, y)))
                na, nb = n[left[some]], n[right[some]]
                need = (na + nb) * (threshold / (1 + threshold)) - EPS
                lacks = lambda u, v: np.bitwise_count(u & ~v).sum(axis=1, dtype=np.int64)
                kept[some] = (na - lacks(p, q) >= need) & (nb - lacks(q, p) >= need)
        return pa.table({"a": a[kept], "b": b[kept]})

    return run


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_or.reduce(bits.reshape(len(bits), -1, size), axis=1)


def _compared(threshold: float) -> Callable:
    """Cogrouped function: candidates and the tokens of two blocks to the pairs at the threshold."""

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        if not pairs.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "jaccard": pa.array([], pa.float64())})
        a, b = _pairs(pairs)
        key, first = np.unique(sets["key"].to_numpy(), return_index=True)
        tokens = sets["tokens"].combine_chunks().take(pa.array(first))
        n = tokens.value_lengths().to_numpy().astype(np.int64)
        start, codes = _starts(n), tokens.flatten().dictionary_encode()
        marked = np.zeros(len(codes.dictionary) + 1, bool)
        codes = codes.indices.fill_null(len(marked) - 1).to_numpy()
        left, right, both = np.searchsorted(key, a), np.searchsorted(key, b), np.zeros(len(a), np.int64)
        edges = np.flatnonzero(np.append(left[1:] != left[:-1], True)) + 1
        for low, high in zip(np.concatenate([[0], edges]), edges):  # pairs are sorted by their left key
            own = codes[start[left[low]] : start[left[low] + 1]]
            marked[own] = True
            for at in range(low, high, 1000):
                some = right[at : min(at + 1000, high)]
                hits = np.concatenate([marked[codes[start[i] : start[i + 1]]] for i in some])
                both[at : at + len(some)] = np.add.reduceat(hits, _starts(n[some])[:-1], dtype=np.int64)
            marked[own] = False
        jaccard = both / (n[left] + n[right] - both)
        near = jaccard >= threshold
        return pa.table({"a": a[near], "b": b[near], "jaccard": jaccard[near]})

    return run


def _digest() -> Column:
    return F.unhex(F.sha2(F.array_join(F.sort_array("tokens"), "\0"), 256)).alias("digest")


def _signatures(scratch: Scratch, sets: DataFrame, threshold: float, least: int) -> tuple[DataFrame, np.ndarray]:
    """(key, id, digest, n, prefix, bits) of all rows, numbered by key, and the rarity of hashes."""
    use_small_batches(sets.sparkSession)
    h = F.transform("tokens", lambda x: F.hash(x)).alias("h")
    rarity = _rarity(sets.select(h))
    kind = sets.schema["id"].dataType.simpleString()
    signed = sets.select("id", _digest(), h).mapInArrow(_signed(rarity, threshold, least), f"id {kind}, digest binary, n int, prefix array<int>, bits binary")
    return scratch.save(signed.select(F.monotonically_increasing_id().alias("key"), "*"), "signatures"), rarity


def _among(ids: DataFrame) -> Callable:
    """A filter of 1 MB by the ids' hashes, which lets all of them through and few others."""
    place = lambda column: F.pmod(F.xxhash64(column), F.lit(8 << 20))
    words = ids.select(place("id").alias("p")).groupBy(F.expr("p div 64").alias("i")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("w")).toPandas()
    bits = np.zeros(1 << 17, np.int64)
    bits[words["i"].to_numpy(np.int64)] = words["w"].to_numpy(np.int64)
    seen = F.pandas_udf(lambda x: pd.Series((bits[x.to_numpy() >> 6] >> (x.to_numpy() & 63) & 1).astype(bool)), "boolean")
    return lambda column: seen(place(column))


def _links(scratch: Scratch, sets: DataFrame, signatures: DataFrame, rarity: np.ndarray, heads: DataFrame, threshold: float, cell: int) -> DataFrame:
    """Pairs (a, b, jaccard) of ids whose keys among the signatures are `heads`."""
    heads = scratch.save(heads, "heads")
    signed = signatures.join(heads, "key", "left_semi")
    blocks = max(4, math.ceil(math.sqrt(heads.count() / BLOCK_HEADS)))
    posted = signed.select("key", "n", "prefix").mapInArrow(_posted(rarity, cell), "place long, key long, way long")
    dealt = posted.repartition(F.shiftright("place", 32)).sortWithinPartitions("place")
    candidates = dealt.mapInArrow(_candidates(threshold, blocks), "block int, a array<long>, b array<long>")
    mine, other = F.pmod("key", F.lit(blocks)), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    bitmaps = signed.select("key", "n", "bits", other).select(_block(mine, F.col("other"), blocks), "key", "n", "bits")
    near = scratch.save(candidates.groupBy("block").cogroup(bitmaps.groupBy("block")).applyInArrow(_unruled(threshold), "a long, b long"), "near")

    ends = near.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("pairs"))
    ends = scratch.save(ends.join(signatures.select("key", "id", "digest", "n"), "key"), "ends")
    size = ends.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs")).first()
    blocks = max(3, math.ceil(size.n * 8 / BLOCK_BYTES), math.ceil(math.sqrt(size.pairs / BLOCK_PAIRS)))
    pairs = near.select(_block(F.pmod("a", F.lit(blocks)), F.pmod("b", F.lit(blocks)), blocks), "a", "b")
    wanted = pairs.select("block", F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.collect_set("block").alias("blocks"))
    wanted = wanted.join(ends.select("key", "id", "digest"), "key")
    tokens = sets.filter(_among(ends)("id")).select("id", _digest(), "tokens").join(wanted, ["id", "digest"]).select("key", F.explode("blocks").alias("block"), "tokens")
    links = scratch.save(pairs.groupBy("block").cogroup(tokens.groupBy("block")).applyInArrow(_compared(threshold), "a long, b long, jaccard double"), "links")
    x, y = (ends.select(F.col("key").alias(k), F.col("id").alias(name)) for k, name in (("a", "x"), ("b", "y")))
    return links.join(x, "a").join(y, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard")


def _block(a: Column, b: Column, blocks: int) -> Column:
    return (F.least(a, b) * blocks + F.greatest(a, b)).cast("int").alias("block")


def near_duplicate_links(sets: DataFrame, threshold: float = 0.7, least: int = 5, cell: int = CELL) -> DataFrame:
    """(id, tokens array of distinct strings) to exact pairs (a, b, jaccard) of sets at the threshold.

    Hashes are put in the order of rising frequency; similar sets share one of their first
    n - ceil(t * n) + 1, and the first one that they share stands where sizes and
    positions leave room for the overlap. Sets under a frequent hash meet in cells, so
    that no hash's sets are in one task.
    """
    scratch = Scratch(sets.sparkSession, "similar")
    sets = sets.select("id", "tokens")
    signatures, rarity = _signatures(scratch, sets, threshold, least)
    heads = signatures.filter((F.col("n") >= max(least, 1)) & F.col("id").isNotNull()).groupBy("id").agg(F.min_by("key", "digest").alias("key"))
    return _links(scratch, sets, signatures, rarity, heads.select("key"), threshold, cell)


def near_duplicate_classes(sets: DataFrame, threshold: float = 0.7, least: int = 5) -> tuple[DataFrame, DataFrame]:
    """(id, class_id, n) of all sets, and the pairs (a, b, jaccard) of different classes: no link of copies is written out.

    Sets that are equal have the least id of them as their class.
    """
    scratch = Scratch(sets.sparkSession, "similar")
    sets = sets.select("id", "tokens")
    signatures, rarity = _signatures(scratch, sets, threshold, least)
    least_of = signatures.groupBy("digest").agg(F.min("id").alias("class_id"))
    member = scratch.save(signatures.select("key", "id", "digest", "n").join(least_of, "digest"), "member")
    heads = member.filter((F.col("n") >= max(least, 1)) & (F.col("id") == F.col("class_id"))).groupBy("id").agg(F.min_by("key", F.struct("digest", "key")).alias("key"))
    links = _links(scratch, sets, signatures, rarity, heads.select("key"), threshold, CELL)
    scratch.drop("signatures")
    return member.select("id", "class_id", "n"), links
