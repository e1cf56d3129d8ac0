"""Benchmark decontamination by winnowing.

A window is ten consecutive words of a benchmark item, or a shorter item as a whole.
Training texts and items keep, for every window, the least hash of its five-word grams,
so equal windows keep equal fingerprints. Fingerprints are joined; a hit is extended from
its place in the document to the windows around it that hold its gram, which are compared
as text. Shorter items have one gram, the whole item, and documents keep all grams of the
lengths that occur.

Results for special rows: a null or empty text has no words and no hits; an item without
words has no window; rows with equal doc_id are one document; repeated items count once
by item_id; an empty benchmark hits nothing; an item with a null id is one of the items
but not named among them; a null doc_id has its own result row without hits; other columns
are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace

WINDOW = 10
GRAM = 5
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes up to which fingerprints, windows or document ids are broadcast; more are shuffled.
BROADCAST_BYTES = 24 << 20
#: Bytes of a row besides those of its strings.
ROW_BYTES = 48


def words_of(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, WORD_BREAK), "")


def _grams(words: str, k: int) -> Column:
    w, n = F.col(words), F.size(words)
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)])))


def _least(grams: str, span: int) -> Column:
    g, n = F.col(grams), F.size(grams)
    return F.when(n >= span, F.transform(F.sequence(F.lit(0), n - span), lambda i: F.least(*[F.get(g, i + j) for j in range(span)])))


def with_fingerprints(rows: DataFrame, window: int, gram: int, short: list[int]) -> DataFrame:
    """Adds `prints`: distinct fingerprints of the windows and the grams of the short lengths."""
    none = F.array().cast("array<bigint>")
    rows = rows.withColumn("_grams", _grams("words", gram))
    prints = [F.coalesce(F.array_distinct(_least("_grams", window - gram + 1)), none)]
    prints += [F.coalesce(F.array_distinct(_grams("words", k)), none) for k in short]
    rows = rows.withColumn("prints", F.concat(*prints) if short else prints[0])
    return rows.drop("_grams")


def _windows(words: str, k: int) -> Column:
    w, n = F.col(words), F.size(words)
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.struct(i.alias("at"), F.lit(k).alias("len"), F.array_join(F.slice(w, i + 1, k), " ").alias("window"))))


def _small(df: DataFrame, strings: Column | None = None) -> DataFrame:
    """df, marked for a broadcast if all its bytes are few; strings: the column whose bytes vary."""
    size = F.sum(ROW_BYTES + (F.octet_length(strings) if strings is not None else F.lit(0)))
    return F.broadcast(df) if (df.agg(size).first()[0] or 0) <= BROADCAST_BYTES else df


def _around(words: str, hit: str, window: int, gram: int, short: list[int]) -> Column:
    """The windows (at, len, window) of a document that hold a gram of `hit`, fingerprints it shares with an item."""
    w, n, none = F.col(words), F.size(words), F.array().cast("array<struct<at:int,len:int,window:string>>")
    texts = lambda starts, k: F.transform(starts, lambda at: F.struct(at.alias("at"), F.lit(k).alias("len"), F.array_join(F.slice(w, at + 1, k), " ").alias("window")))
    places = lambda k: F.filter(F.transform(_grams(words, k), lambda g, i: F.when(F.array_contains(hit, g), i)), lambda i: i.isNotNull())
    # a gram at p lies in the windows that start at p - (window - gram) up to p
    starts = F.array_distinct(F.flatten(F.transform(places(gram), lambda p: F.sequence(F.greatest(F.lit(0), p - (window - gram)), F.least(p, n - window)))))
    parts = [F.when(n >= window, texts(starts, window))] + [F.when(n >= k, texts(places(k), k)) for k in short]
    return F.concat(*[F.coalesce(x, none) for x in parts])


def hits(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, workspace: Workspace | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_words) of all documents, and (doc_id, at, len, item_id) of every occurrence."""
    workspace = workspace or Workspace(documents.sparkSession, "winnow")
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(window))
    items = workspace.save(items.withColumn("len", length), "items")
    # at most window - 1 values
    short = sorted(r["len"] for r in items.filter(F.col("len") < window).select("len").distinct().collect())
    none = F.array().cast("array<struct<at:int,len:int,window:string>>")
    cases = F.when(F.col("len") == window, _windows("words", window))
    for k in short:
        cases = cases.when(F.col("len") == k, _windows("words", k))
    item_windows = items.select("item_id", F.explode(F.coalesce(cases, none)).alias("w")).select("item_id", "w.len", "w.window").distinct()
    item_windows = workspace.save(item_windows, "item_windows")
    # a window's own words give its fingerprint: the winnowed one, or the whole short item
    prints = item_windows.select("len", F.split("window", " ").alias("words"))
    prints = prints.withColumn("_grams", _grams("words", gram))
    own = F.when(F.col("len") == window, F.array_min("_grams"))
    for k in short:
        own = own.when(F.col("len") == k, F.get(_grams("words", k), F.lit(0)))
    prints = workspace.save(prints.select(own.alias("fp")).distinct(), "item_prints")

    docs = documents.select("doc_id", "text")
    scanned = with_fingerprints(docs.select("doc_id", words_of(F.col("text")).alias("words")), window, gram, short)
    scanned = workspace.save(scanned.select("doc_id", F.size("words").cast("long").alias("n_words"), "prints"), "prints")
    found = scanned.filter("doc_id is not null").select("doc_id", F.explode("prints").alias("fp")).join(_small(prints), "fp")
    found = workspace.save(found.groupBy("doc_id").agg(F.collect_set("fp").alias("hit")), "found")  # a document's own prints

    texts = docs.join(_small(found, F.array_join("hit", "")), "doc_id").select("doc_id", words_of(F.col("text")).alias("words"), "hit")
    placed = texts.select("doc_id", F.explode(_around("words", "hit", window, gram, short)).alias("w")).select("doc_id", "w.at", "w.len", "w.window")
    return scanned.select("doc_id", "n_words"), placed.join(_small(item_windows, F.col("window")), ["len", "window"]).select("doc_id", "at", "len", "item_id")


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, workspace: Workspace | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    words, found = hits(documents, benchmark, window, gram, workspace)
    # a document's own occurrences: bounded by its words and the items
    by_doc = found.groupBy("doc_id").agg(
        F.collect_set(F.sequence("at", F.col("at") + F.col("len") - 1)).alias("spans"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items")
    )
    by_doc = by_doc.select("doc_id", F.size(F.array_distinct(F.flatten("spans"))).cast("long").alias("n_hit"), "items")
    out = words.join(by_doc, "doc_id", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, words, least(len(words), {WINDOW}) AS n FROM (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark) WHERE len(words) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(words, i, i + n - 1), ' ') AS w FROM (SELECT item_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM b)),
dw AS (SELECT doc_id, i, n, array_to_string(list_slice(words, i, i + n - 1), ' ') AS w
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM b))),
h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.w = bw.w),
k AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k ON d.doc_id = k.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
