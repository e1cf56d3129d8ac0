"""Sources and sinks: JSON arrays and lines, zips of JSON, folders of code, keyed stores, Parquet upserts.

Special rows: an unreadable file, or one that is not what its kind says, gives no rows and
stops nothing, but for manifests and versions, which fail; repeated keys are told by
`duplicate_ids`; null keys are of one key; empty folders need a schema, which all take.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_json_arrays(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Every *.json of a folder, each one JSON array (or object)."""
    return spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)


def read_json_lines(spark: SparkSession, paths: list[str], schema: str, ids: DataFrame | None = None, drop_torn: bool = False) -> DataFrame:
    """JSON lines of several files; `ids` (id) keeps only those; torn lines are dropped on request."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED" if drop_torn else "PERMISSIVE").json(paths)
    return rows if ids is None else rows.join(ids.select("id").distinct(), "id", "left_semi")


def duplicate_ids(rows: DataFrame, key: str = "id") -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def read_zip_json(spark: SparkSession, path: str) -> DataFrame:
    """(member, position, record) of zips of JSON files; a list gives a row per element, bad members none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                try:
                    z = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    continue
                for name in z.namelist():
                    try:
                        found = json.loads(z.read(name)) if name.endswith(".json") else []
                    except (ValueError, zipfile.BadZipFile):
                        continue
                    found = found if isinstance(found, list) else [found]
                    yield pd.DataFrame([(name, i, json.dumps(x)) for i, x in enumerate(found)], columns=["member", "position", "record"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "member string, position int, record string")


def zip_members(spark: SparkSession, path: str, suffix: str = ".json") -> DataFrame:
    """(id): names of the members of zips without their suffix; no member is read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                try:
                    names = zipfile.ZipFile(io.BytesIO(content)).namelist()
                except zipfile.BadZipFile:
                    continue
                yield pd.DataFrame({"id": [n.removesuffix(suffix) for n in names if n.endswith(suffix)]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "id string")


def read_code(spark: SparkSession, folder: str, extensions: tuple[str, ...] = (".py", ".js", ".ts"), ignored: tuple[str, ...] = ("node_modules", ".git", "__pycache__", "venv", ".venv", "dist", "build")) -> DataFrame:
    """(path, content) of a folder's code, its folders included but for those to ignore; text that is no UTF-8 is left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    files = files.filter(F.col("path").rlike("(?i)(" + "|".join(e.replace(".", r"\.") for e in extensions) + ")$")).filter(~F.col("path").rlike("/(" + "|".join(i.replace(".", r"\.") for i in ignored) + ")/"))
    return files.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("content")).filter("content is not null")


def responses(cache: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (url) with the cached response (key, status, body) of their address; `offline_miss` where there is none.

    A cached 404 is an answer: a null body that is no miss.
    """
    have = cache.select(F.col("key").alias("_key"), "status", "body").dropDuplicates(["_key"])
    out = requests.join(have, F.sha2("url", 256) == F.col("_key"), "left")
    return out.withColumn("offline_miss", F.col("_key").isNull()).withColumn("body", F.when(F.col("status") == 404, None).otherwise(F.col("body"))).drop("_key")


def read_versioned(spark: SparkSession, path: str, rows: str, version: int) -> DataFrame:
    """Rows of a JSON file {version, rows}; fails on another version."""
    raw = spark.read.schema(f"version int, rows array<struct<{rows}>>").option("multiLine", True).json(path)
    checked = raw.withColumn("_ok", F.assert_true(F.coalesce(F.col("version") == version, F.lit(False)), "the file has another version")).filter("_ok is null")
    return checked.select(F.explode("rows").alias("r")).select("r.*")


def read_pages(pages: DataFrame, order: str, items: str) -> DataFrame:
    """Rows of a paged source (order, array of items) up to its first empty page."""
    end = pages.filter(F.size(items) == 0).agg(F.coalesce(F.min(order), F.lit(1 << 62)).alias("_end"))
    return pages.crossJoin(end).filter(F.col(order) < F.col("_end")).select(order, F.explode(items).alias("item"))  # end is one row


def kept_files(files: DataFrame, most_bytes: int) -> DataFrame:
    """Changed files (path, status, size) to look at: a known language, not removed, not too large."""
    from palisade.functions.text import language_of

    return files.filter(language_of(F.col("path")).isNotNull() & (F.coalesce(F.col("status"), F.lit("")) != "removed") & (F.coalesce(F.col("size"), F.lit(0)) <= most_bytes))


def prepared(records: DataFrame, position: str) -> DataFrame:
    """Records (id, code, fixed, …) as they are stored: with an id and code, the fixed side null if empty or the same but for space, the last of an id."""
    from palisade.functions.scalars import canonical

    from palisade.operators.names import top_per

    whole = records.filter("coalesce(id, '') <> '' and coalesce(trim(code), '') <> ''")
    fixed = F.when((F.trim("fixed") != "") & (canonical(F.col("fixed")) != canonical(F.col("code"))), F.col("fixed"))
    return top_per(whole.withColumn("fixed", fixed), ["id"], [F.desc(position)])


def rewrite(rows: DataFrame, path: str) -> None:
    """Drops what is stored and writes the rows in its place."""
    rows.write.mode("overwrite").parquet(path)


def quotas_of(spec: str) -> dict[str, int]:
    """'kind=n,…' to quotas; an unknown form, a repeated kind or a number below 1 is an error."""
    out: dict[str, int] = {}
    for part in spec.split(","):
        kind, equals, n = part.strip().partition("=")
        if not equals or not kind or kind in out or not n.isdigit() or int(n) < 1:
            raise ValueError(f"not a quota: {part!r}")
        out[kind] = int(n)
    return out


def grid(spec: str) -> list[float]:
    """'low:high:step' to the numbers of the range, the high end included."""
    low, high, step = map(float, spec.split(":"))
    if step <= 0:
        raise ValueError("the step must be above 0")
    return [round(low + i * step, 10) for i in range(int((high - low) / step + 1e-9) + 1)]


def read_split(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """(id, side) of a split manifest; fails on another version or an id on both sides."""
    raw = spark.read.schema("version int, dev struct<ids:array<string>>, test struct<ids:array<string>>").option("multiLine", True).json(path)
    sides = F.array(F.struct(F.lit("dev").alias("side"), F.col("dev.ids").alias("ids")), F.struct(F.lit("test").alias("side"), F.col("test.ids").alias("ids")))
    bad = (F.col("version") != version) | F.arrays_overlap("dev.ids", "test.ids")
    rows = raw.withColumn("_ok", F.assert_true(~F.coalesce(bad, F.lit(True)), "the manifest has another version, or an id on both sides"))
    return rows.filter("_ok is null").select(F.explode(sides).alias("s")).select(F.explode("s.ids").alias("id"), "s.side")


def last_per_key(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """An append-only store's current rows: the last write of each key wins."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(position)))).filter("_n = 1").drop("_n")


def put_many(cache: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key the cache lacks, one per key."""
    return rows.dropDuplicates([key]).join(cache.select(key), key, "left_anti")


def get_many(cache: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return cache.join(keys.select(key).distinct(), key, "left_semi")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows over old ones of the same key; null vectors are kept as nulls."""
    rows = new.withColumn("_new", F.lit(1)).unionByName(old.withColumn("_new", F.lit(0)), allowMissingColumns=True)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_new")))).filter("_n = 1").drop("_n", "_new")


def advance_cursor(old: DataFrame, seen: DataFrame) -> DataFrame:
    """(repo, last_pr, run_at): cursors never go back."""
    return old.unionByName(seen).groupBy("repo").agg(F.max("last_pr").alias("last_pr"), F.max("run_at").alias("run_at"))


def write_split(rows: DataFrame, folder: str, kept: str = "kept") -> None:
    """JSON lines of kept rows, and of rejected ones in a folder below."""
    rows.filter(F.col(kept)).drop(kept, "reason").write.mode("overwrite").json(f"{folder}/kept")
    rows.filter(~F.coalesce(F.col(kept), F.lit(False))).drop(kept).write.mode("overwrite").json(f"{folder}/rejected")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), "length", F.sha2("content", 256).alias("sha256"))
