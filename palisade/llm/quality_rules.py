"""Quality rules: a threshold table compiled into one projection, without user functions.

Results for special rows: a null or empty text has no words and fails the base rule;
repeated rows and null ids give results of their own; other columns are kept by
`with_quality`, whatever their names (its own columns replace others of those names), and
ignored by `quality_report`; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_BREAK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

# Frequent words of the corpus's languages (fixed values).
STOP_WORDS = (
    "the of and to in a is that it was for on are with as be at by this from or an have not but",
    "de la le et les des en un du une que est pour qui dans par plus pas au sur avec",
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es",
    "el que y los del se las por con para no una su al lo como más o pero sus le",
)

#: Measure, least and most allowed value; null is no bound. All are ratios of whole-text counts.
THRESHOLDS = (
    ("mean_word_length", 2.0, 12.0),
    ("symbols_per_word", None, 0.25),
    ("stop_word_share", 0.005, None),
    ("dup_line_share", None, 0.5),
)
LEAST_WORDS = 50
#: Columns of `with_quality`.
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
MOST_REPEAT_PERCENT = 50


def _blank_free(text: Column) -> Column:
    return F.translate(text, " \t\n\x0b\x0c\r", "")


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more in the array.

    Windows are hashed, sorted with their places, and those with an equal neighbour give
    the covered places; every step is linear but for the sort.
    """
    n = F.size(words)
    return F.when(
        n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    )


def with_quality(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    keep = [c for c in docs.columns if c.lower() not in ADDED]
    # the documents' columns stand in one struct while names of the operator's own are used
    row = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in keep]).alias("_row")
    text = F.coalesce(docs["text"], F.lit(""))
    at = docs.select(row, text.alias("_text"), F.array_remove(F.split(text, WORD_BREAK), "").alias("_words"), F.split(text, "\n").alias("_lines"))
    text = F.col("_text")
    at = at.withColumn("_windows", F.sort_array(F.coalesce(repeat_words(F.col("_words")), F.array().cast("array<struct<h:bigint,i:int>>"))))
    m, w = F.size("_windows"), F.col("_windows")
    twice = F.when(
        m >= 2,
        F.filter(F.sequence(F.lit(0), m - 1), lambda j: (F.get(w, j)["h"] == F.get(w, j - 1)["h"]) | (F.get(w, j)["h"] == F.get(w, j + 1)["h"])),
    )
    at = at.withColumn("_twice", twice)
    at = at.withColumn("_places", F.sort_array(F.transform("_twice", lambda j: F.get(F.col("_windows"), j)["i"])))
    p = F.col("_places")
    covered = F.aggregate(
        p, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")),
    )["n"]
    full = F.filter("_lines", lambda line: F.length(_blank_free(line)) > 0)
    stop = [x for line in STOP_WORDS for x in line.split()]
    counts = F.struct(
        F.size("_words").cast("long").alias("n_words"),
        F.length(_blank_free(text)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_full").alias("_n_lines"),
        F.size(F.filter("_words", lambda x: x.isin(stop))).alias("_n_stop"),
    )
    # a generator of one row: a filter on the verdict is not pushed below it, which would repeat the counts' expressions
    at = at.withColumn("_full", full).select("_row", F.inline(F.array(counts)))
    n = F.col("n_words")
    base = (n < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * n)
    # counts to the thousand, so that each comparison is one of integers
    measures = {
        "mean_word_length": (F.col("word_chars"), n),
        "symbols_per_word": (F.col("n_symbols"), n),
        "stop_word_share": (F.col("_n_stop").cast("long"), n),
        "dup_line_share": (F.col("n_dup_lines"), F.col("_n_lines").cast("long")),
    }
    good = F.lit(True)
    for name, least, most in THRESHOLDS:
        count, of = measures[name]
        if least is not None:
            good &= 1000 * count >= int(1000 * least) * of
        if most is not None:
            good &= 1000 * count <= int(1000 * most) * of
    at = at.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & good)
    return at.select(*[F.col("_row")[c].alias(c) for c in keep], *ADDED)


def quality_report(documents: DataFrame) -> DataFrame:
    """doc_id and the columns of `with_quality`."""
    return with_quality(documents.select("doc_id", "text")).drop("text")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    checks = []
    measures = {"mean_word_length": ("word_chars", "n_words"), "symbols_per_word": ("n_symbols", "n_words"), "stop_word_share": ("n_stop", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines")}
    for name, least, most in THRESHOLDS:
        count, of = measures[name]
        checks += [f"1000 * {count} >= {int(1000 * least)} * {of}"] if least is not None else []
        checks += [f"1000 * {count} <= {int(1000 * most)} * {of}"] if most is not None else []
    stop = ", ".join(f"'{x}'" for line in STOP_WORDS for x in line.split())
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) >= 2),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
  len(lines)::BIGINT AS n_lines, len(list_filter(words, lambda x: x IN ({stop})))::BIGINT AS n_stop
  FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(checks)} AS kept FROM b
"""


ORACLE = _oracle()
