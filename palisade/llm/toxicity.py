"""Toxicity by maximum-scoring segments of token log-odds.

Tokens of a text are its words and their beginnings of 4 and 5 characters. The texts of
labelled training rows, each once, that have a token give its log-odds with an
informative Dirichlet prior (the pooled counts); those whose z-score is high, with no cap
on their number, form the lexicon. A word with lexicon tokens scores the greatest of
their log-odds, less two standard errors; any other word scores a small loss. One linear
scan finds every maximal-scoring segment of a text.

Segments are judged by extreme-value statistics: lambda solves sum p(s) exp(lambda s) = 1
over the words of non-toxic rows, so that a segment of score S in a text of n words has
the normalised score lambda * S - log(n), and its significance is the chance
1 - exp(-exp(-normalised)) that a text without toxic passages has one as good. All
segments whose significance is at most `SIGNIFICANT` are a text's toxic passages; their
normalised scores are added up (the sum of the r best has a tail like that of one, less
log(r!), by which it is corrected). A logistic curve over that value, fitted on the
training rows, gives the score; a text without a significant segment has its best one.

Rows with crc32(doc_id as text) mod 3 = 1 are held out: their labels are never read into
the fit. All other labelled rows count, with no cap on them.

Results for special rows: a null or empty text has no words and gets the curve's least
score; labels that are null or of no document are unused; several labels of a document
count as the greatest, and so do those of equal texts; without labels of both kinds the
lexicon is empty and all score 0; equal texts get equal scores, whatever their doc_id;
other columns are ignored.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace

WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
HELD_OUT = 1
#: The least z-score of a lexicon token.
LEAST_Z = 3.0
#: Bytes of lexicon that are sent with a scan; a larger one is dealt into parts, each with a scan of its own.
LEXICON_BYTES = 64 << 20
#: Weight of the pooled counts in the prior, in tokens, and what each token has besides.
PRIOR_TOKENS, FLOOR = 1000.0, 0.5
#: The prior weighs at most this share of the labelled tokens, so that short texts can outweigh it.
PRIOR_SHARE = 0.1
#: Characters of a word's beginnings that are tokens too, and the least score of a lexicon token.
BEGINNINGS = (4, 5)
LEAST_SCORE = 1.0
#: Words whose scores a worker remembers.
REMEMBERED = 300_000
#: Chance up to which a segment is significant.
SIGNIFICANT = 0.05
#: Labelled rows (of 16 bytes) up to which labels are broadcast; more are joined by a shuffle.
BROADCAST_LABELS = 1_000_000
#: Loss of a word outside the lexicon.
OTHER = -0.2
#: Bins of a calibrated value, and the greatest one.
STEP, MOST = 0.25, 60.0
PREDICT = 0.7

SCORE_SCHEMA = "doc_id long, best double, n_segments int, start int, end int, passages array<struct<start:int,end:int,score:double>>"
PASSAGES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


@dataclass(frozen=True)
class Lexicon:
    """Tokens and their scores, in a table (word, score, part) where they are too many to be sent at once."""

    words: tuple[str, ...] = ()
    scores: tuple[float, ...] = ()
    table: DataFrame | None = None
    parts: int = 1

    def part(self, i: int) -> dict[str, float]:
        if self.table is None:
            return dict(zip(self.words, self.scores))
        return {r["word"]: float(r["score"]) for r in self.table.filter(F.col("part") == i).collect()}  # about LEXICON_BYTES


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    scale: float  # lambda
    slope: float
    middle: float

    def curve(self, value: float) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.slope * (value - self.middle)))))


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == HELD_OUT, F.lit(False))


def segments(places: list[int], scores: list[float], other: float = OTHER) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of a text with hits at `places`.

    A candidate keeps its cumulative score before and after, and a link to the last
    candidate before it that began lower; a new one joins with that one as long as it
    also ends lower. Links are followed, never the list, so the scan is linear.
    """
    out: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, link
    total, last = 0.0, 0
    for place, score in zip(places, scores):
        total += (place - last) * other
        low, total, last = total, total + score, place + 1
        start, j = place, len(out) - 1
        while True:
            while j >= 0 and out[j][2] >= low:
                j = out[j][4]
            if j < 0 or out[j][3] >= total:
                out.append((start, last, low, total, j))
                break
            start, low, link = out[j][0], out[j][2], out[j][4]
            del out[j:]
            j = link
    return [(a, b, y - x) for a, b, x, y, _ in out]


def judged(found: list[tuple[int, int, float]], n: int, scale: float) -> tuple[float, list[tuple[int, int, float]]]:
    """A text's value, and its significant segments (start, end, normalised score)."""
    if not found:
        return -MOST, []
    scored = sorted(((scale * s - math.log(n), a, b) for a, b, s in found), reverse=True)
    good = [x for x in scored if -math.expm1(-math.exp(-max(-50.0, x[0]))) <= SIGNIFICANT]
    value, total = scored[0][0], 0.0
    for r, (x, _, _) in enumerate(good, 1):
        total += x
        value = max(value, total - math.lgamma(r + 1))
    return min(MOST, max(-MOST, value)), sorted((a, b, x) for x, a, b in good)


class Scores(dict):
    """Scores of words: the greatest of the lexicon's for the word and its beginnings, 0 if there is none."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon

    def __missing__(self, word: bytes) -> float:
        text = word.decode("utf-8", "replace")
        value = max(0.0, *(self.lexicon.get(t, 0.0) for t in (text, *(text[:k] for k in BEGINNINGS))))
        if len(self) < REMEMBERED and len(word) <= 64:
            self[word] = value
        return value


# Bytes that words are parted at, as spaces, and A-Z in lower case.
_BETWEEN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def hit_rows(lexicon: dict[str, float]):
    """mapInArrow function: (row, doc_id, text) to each text's number of words, and the places and scores of those in the lexicon."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(lexicon)
        for batch in batches:
            sizes, places, hits = [], [], []
            for text in batch.column("text").cast(pa.large_binary()):
                words = (text.as_py() or b"").translate(_BETWEEN).split()
                values = list(map(scores.__getitem__, words)) if lexicon else []
                at = [i for i, v in enumerate(values) if v]
                sizes.append(len(words)), places.append(at), hits.append([values[i] for i in at])
            columns = [batch.column("row"), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(places, pa.list_(pa.int32())), pa.array(hits, pa.list_(pa.float64()))]
            yield pa.record_batch(columns, names=["row", "doc_id", "n", "places", "hits"])

    return run


def judged_rows(scale: float):
    """mapInArrow function: texts' hits to their values and significant segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, counts, starts, ends, passages = [], [], [], [], []
            for n, places, hits in zip(*(batch.column(c).to_pylist() for c in ("n", "places", "hits"))):
                found = segments(places, hits)
                value, good = judged(found, n, scale)
                top = max(found, key=lambda s: s[2], default=(0, 0, 0.0))
                best.append(value), counts.append(len(good)), starts.append(top[0]), ends.append(top[1])
                passages.append([{"start": a, "end": b, "score": x} for a, b, x in good])
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(best, pa.float64()), pa.array(counts, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(passages, PASSAGES)],
                names=["doc_id", "best", "n_segments", "start", "end", "passages"],
            )

    return run


def scored(documents: DataFrame, lexicon: Lexicon, scale: float) -> DataFrame:
    """(doc_id, best, n_segments, start, end, passages) of each row.

    With a lexicon in parts a word's score is the greatest that any part has for it, so each
    part's hits are joined by row; a row has as many as there are parts.
    """
    schema = "row long, doc_id long, n long, places array<int>, hits array<double>"
    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    judge = judged_rows(scale)
    if lexicon.parts == 1:
        hits = hit_rows(lexicon.part(0))
        return rows.mapInArrow(lambda batches: judge(hits(batches)), SCORE_SCHEMA)
    rows = Workspace(documents.sparkSession, "toxicity").save(rows, "rows")
    some = [rows.mapInArrow(hit_rows(lexicon.part(i)), schema) for i in range(lexicon.parts)]
    both = reduce(DataFrame.unionByName, some).groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n").alias("n"), F.flatten(F.collect_list(F.arrays_zip("places", "hits"))).alias("found"))
    # in order of place, and of equal places the greatest score last
    found = F.array_sort("found")
    kept = F.filter(found, lambda x, i: F.coalesce(F.get(found, i + 1)["places"] != x["places"], F.lit(True)))
    merged = both.select("row", "doc_id", "n", kept["places"].alias("places"), kept["hits"].alias("hits"))
    return merged.mapInArrow(judge, SCORE_SCHEMA)


def _scale(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive lambda of a score distribution with a negative mean."""
    rest = 1 - shares.sum()
    total = lambda x: float(np.sum(shares * np.exp(x * scores)) + rest * math.exp(x * OTHER))
    if np.sum(shares * scores) + rest * OTHER >= 0:
        return 0.05
    low, high = 0.0, 1.0
    while total(high) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if total(mid) < 1 else (low, mid)
    return high


def _logistic(values: np.ndarray, label: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and middle of a logistic curve over binned values, by ridge-bound Newton steps."""
    center = values.mean()
    x = np.stack([values - center, np.ones(len(values))], 1)
    beta = np.array([0.1, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (n * (label - p)) - np.array([0.1, 0.001]) * beta
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag([0.1, 0.001])
        step = np.linalg.solve(hess, grad)
        beta = beta + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    slope = max(1e-3, beta[0])
    return float(slope), float(center - beta[1] / slope)


def fit(documents: DataFrame, labels: DataFrame, lexicon_bytes: int = LEXICON_BYTES) -> Model:
    """The model from all labelled rows that are not held out."""
    known = labels.filter("toxic is not null and doc_id is not null").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if known.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    rows = documents.select("doc_id", "text").filter("text is not null").join(known, "doc_id")
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    words = F.array_distinct(F.array_remove(F.split(lower, WORD_BREAK), ""))
    tokens = F.array_distinct(F.concat("words", *[F.transform("words", lambda w, k=k: F.substring(w, 1, k)) for k in BEGINNINGS]))
    # equal texts once, with the greatest label; told by a cryptographic digest
    once = rows.groupBy(F.sha2("text", 256).alias("key")).agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    texts = once.select("toxic", words.alias("words"))
    counts = texts.select("toxic", F.explode(tokens).alias("word")).groupBy("word")
    counts = counts.agg(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 1, 0).otherwise(1)).alias("b"))
    total = counts.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    c = counts.crossJoin(F.broadcast(total))  # total is one row
    weight = F.least(F.lit(PRIOR_TOKENS), PRIOR_SHARE * F.least("na", "nb"))
    prior = FLOOR + weight * (F.col("a") + F.col("b")) / (F.col("na") + F.col("nb"))
    odds = lambda x, n: F.log((F.col(x) + prior) / F.greatest(F.lit(FLOOR), F.col(n) + weight - F.col(x) - prior))
    delta = odds("a", "na") - odds("b", "nb")
    error = F.sqrt(1 / (F.col("a") + prior) + 1 / (F.col("b") + prior))
    weighed = c.filter("a > 0 and na > 0 and nb > 0").select("word", (delta - 2 * error).alias("score"), (delta / error).alias("z"), ((F.col("b") + 0.5) / (F.col("nb") + 1)).alias("share"))
    chosen = weighed.filter((F.col("z") >= LEAST_Z) & (F.col("score") >= LEAST_SCORE))
    workspace = Workspace(documents.sparkSession, "lexicon")
    chosen = workspace.save(chosen, "lexicon")
    size = chosen.agg(F.sum(F.octet_length("word") + 64)).first()[0] or 0
    if not size:
        workspace.release()
        return Model(Lexicon(), 1.0, 1.0, 2 * MOST)
    # like scores are put together, so that the sum has some ten thousand terms at most
    shared = F.sum("share")
    sums = chosen.groupBy(F.round("score", 3).alias("bin")).agg(shared.alias("share"), (F.sum(F.col("share") * F.col("score")) / shared).alias("score")).orderBy("bin").collect()
    parts = -(-size // lexicon_bytes)
    if parts > 1:
        lexicon = Lexicon(table=chosen.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(parts))), parts=parts)
    else:
        held = sorted(chosen.collect(), key=lambda r: r["word"])  # its size is known
        workspace.release()
        lexicon = Lexicon(tuple(r["word"] for r in held), tuple(float(r["score"]) for r in held))
    scale = _scale(np.array([r["score"] for r in sums], float), np.array([r["share"] for r in sums], float))
    best = scored(rows, lexicon, scale)
    # at most 2 * MOST / STEP bins
    binned = best.join(known, "doc_id").groupBy((F.round(F.col("best") / STEP) * STEP).alias("value")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    bins = np.array([(r["value"], r["n"], r["toxic"]) for r in binned.collect()], float)
    slope, middle = _logistic(np.repeat(bins[:, 0], 2), np.tile([1.0, 0.0], len(bins)), np.stack([bins[:, 2], bins[:, 1] - bins[:, 2]], 1).ravel())
    return Model(lexicon, scale, slope, middle)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, n_segments, start, end (words of the best segment), passages (all significant ones)."""
    best = scored(documents, model.lexicon, model.scale)
    value = F.greatest(F.lit(-50.0), F.least(F.lit(50.0), model.slope * (F.col("best") - model.middle)))
    out = best.withColumn("score", 1 / (1 + F.exp(-value))).withColumn("held_out", held_out())
    return out.select("doc_id", "held_out", "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"), "n_segments", "start", "end", "passages")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(documents, fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))).drop("passages")
