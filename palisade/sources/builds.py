"""Versions of a set of tables that show up whole or not at all.

A build writes its tables to a folder of its own, reads them back for its checks and for
their digests, and only then writes one manifest that names them. Readers go by manifests:
a build that was killed, or whose checks found rows, shows nothing, and readers keep the
version before. A manifest is one file, put in its place by the commit of the job that
writes it.

Digests add up a hash of each row, so they do not depend on files, order or partitions, and
copies count. Two builds that end as the same version are both void, and each says so; the
next one takes a new number. Results for special rows: empty tables are tables; nulls
differ from empty strings; column order does not count. What a killed build wrote stays
until `sweep`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

MANIFEST = "build string, tables array<struct<name:string,rows:long,digest:string>>, inputs array<struct<name:string,rows:long,digest:string>>"
Check = Callable[[dict[str, DataFrame]], DataFrame]


class Rejected(ValueError):
    """A check found rows, an input is not what its manifest says, or two builds met."""


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _folders(spark: SparkSession, path: str) -> list[str]:
    fs, at = _hadoop(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()] if fs.exists(at) else []


def digest(rows: DataFrame) -> Row:
    """(rows, digest): the count, and the sum of two parts of each row's SHA-256."""
    whole = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in sorted(rows.columns)])
    hashed = rows.select(F.sha2(F.to_json(whole, {"ignoreNullFields": "false"}), 256).alias("h"))
    part = lambda at: F.coalesce(F.sum(F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
    return hashed.agg(F.count("*").alias("rows"), F.concat_ws("-", part(1), part(16)).alias("digest")).first()


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """(version, build, tables, inputs) of each version that has just one manifest."""
    schema = f"{MANIFEST}, version long"
    if not _folders(spark, f"{folder}/manifests"):
        return spark.createDataFrame([], schema)
    named = spark.read.schema(schema).json(f"{folder}/manifests")
    return named.groupBy("version").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("build", "tables", "inputs")]).filter("n = 1").drop("n")


def offenders(written: dict[str, DataFrame], checks: dict[str, Check]) -> DataFrame:
    """(check, n, example) of each check that finds rows; a check gives a column `key`."""
    found = [check(written).select(F.lit(name).alias("check"), F.col("key").cast("string").alias("key")) for name, check in checks.items()]
    return reduce(DataFrame.unionAll, found).groupBy("check").agg(F.count("*").alias("n"), F.min("key").alias("example"))


def build(spark: SparkSession, folder: str, tables: dict[str, DataFrame], checks: dict[str, Check], inputs: dict[str, DataFrame] | None = None) -> int:
    """Writes and checks the tables and commits them as the next version, which it gives."""
    name = uuid.uuid4().hex
    root, written = f"{folder}/data/{name}", {}
    for table, rows in tables.items():
        rows.write.parquet(f"{root}/{table}")
        written[table] = spark.read.schema(rows.schema).parquet(f"{root}/{table}")
    bad = sorted(offenders(written, checks).collect()) if checks else []  # one row a check
    if bad:
        fs, at = _hadoop(spark, root)
        fs.delete(at, True)
        raise Rejected("; ".join(f"{r.check}: {r.n} rows, such as {r.example}" for r in bad))
    facts = lambda of: [(table, *digest(rows)) for table, rows in of.items()]
    version = 1 + max([0] + [int(v.partition("=")[2]) for v in _folders(spark, f"{folder}/manifests")])
    manifest = spark.createDataFrame([(name, facts(written), facts(inputs or {}))], MANIFEST)
    manifest.coalesce(1).write.mode("errorifexists").json(f"{folder}/manifests/version={version}")
    if versions(spark, folder).filter((F.col("version") == version) & (F.col("build") == name)).isEmpty():
        raise Rejected(f"another build ended as version {version}; both are void")
    return version


def read(spark: SparkSession, folder: str, version: int | None = None, verify: bool = True) -> dict[str, DataFrame]:
    """The tables of a version, or of the last one; verify: their digests must be those of the manifest."""
    held = versions(spark, folder)
    row = (held if version is None else held.filter(F.col("version") == version)).orderBy(F.desc("version")).first()
    if row is None:
        raise Rejected(f"no version {version or ''} in {folder}")
    out = {}
    for name, rows, at in row.tables:
        out[name] = spark.read.parquet(f"{folder}/data/{row.build}/{name}")
        if verify and tuple(digest(out[name])) != (rows, at):
            raise Rejected(f"{name} is not what the manifest of version {row.version} says")
    return out


def sweep(spark: SparkSession, folder: str) -> list[str]:
    """Deletes what no manifest names; no build may run meanwhile."""
    named = {r.build for r in versions(spark, folder).select("build").collect()}  # one row a version
    gone = sorted(set(_folders(spark, f"{folder}/data")) - named)
    for name in gone:
        fs, at = _hadoop(spark, f"{folder}/data/{name}")
        fs.delete(at, True)
    return gone


def keys_of(table: str, key: str | Column, bad: Column) -> Check:
    """Rows of a table for which `bad` holds."""
    return lambda written: written[table].filter(F.coalesce(bad, F.lit(False))).select((F.col(key) if isinstance(key, str) else key).alias("key"))


def repeated(table: str, key: str) -> Check:
    """Keys that a table holds more than once; null is no key."""
    return lambda written: written[table].filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).count().filter("count > 1").select("key")


def shared(one: str, other: str, key: str) -> Check:
    """Keys that both tables hold; null is no key."""
    return lambda written: written[one].select(F.col(key).alias("key")).join(written[other].select(F.col(key).alias("key")), "key", "left_semi").distinct()
