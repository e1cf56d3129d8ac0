"""Stateful behaviours on Structured Streaming: job states, sliding budgets, read-through caches.

Rows with a null key are of one key; a null time or amount adds nothing; empty inputs give
empty results; ties go to the smaller id; repeated rows count each; columns of any name
are kept where rows are kept.
"""

from __future__ import annotations

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from palisade.operators.names import fresh, top_per

#: Seconds of a key that are summed in one task, and buckets of a store.
SLAB, BUCKETS = 3600, 64
ORDER = {"queued": 0, "running": 1, "completed": 2, "failed": 2}


def latest_state(events: DataFrame, key: str = "job", state: str = "state", ts: str = "ts", id_: str = "id") -> DataFrame:
    """The state of each job after all its events; an end state is final, and a job runs only after it was queued."""
    rank = F.coalesce(*[F.when(F.col(state) == s, F.lit(r)) for s, r in ORDER.items()])
    return top_per(events.filter(rank.isNotNull()), [key], [F.desc(rank), ts, id_]).select(key, state, ts)


def after_restart(states: DataFrame, state: str = "state") -> DataFrame:
    """Running jobs failed with the process; queued ones run again."""
    return states.withColumn("action", F.when(F.col(state) == "running", "fail").when(F.col(state) == "queued", "rerun").otherwise("keep"))


def sliding_load(rows: DataFrame, key: str, ts: str, amount: str, seconds: int = 60, slab: int = SLAB) -> DataFrame:
    """Adds `load`: the amount within the last `seconds` seconds of a key, itself included.

    A key's time is cut into slabs; what the first seconds of a slab look back to is dealt
    to it as well, so that no key is in one task.
    """
    at, part, own = (fresh(n, rows) for n in ("at", "slab", "own"))
    out = rows.withColumn(at, F.unix_seconds(F.col(ts).cast("timestamp")))
    mine = F.floor(F.col(at) / slab)
    parts = F.filter(F.array_distinct(F.array(mine, F.floor((F.col(at) + seconds - 1) / slab))), lambda x: x.isNotNull())
    out = out.withColumn(part, F.explode_outer(parts)).withColumn(own, F.coalesce(F.col(part) == F.floor(F.col(at) / slab), F.lit(True)))
    order = Window.partitionBy(key, part).orderBy(at).rangeBetween(-(seconds - 1), 0)
    return out.withColumn("load", F.sum(amount).over(order)).filter(own).drop(at, part, own)


class Budget:
    """Tokens of one client in the last seconds, first in first out."""

    def __init__(self, limit: int, seconds: int = 60, most_wait: float | None = None, held: list | None = None, last: float = float("-inf"), blocked: float = float("-inf")):
        self.limit, self.seconds, self.most_wait = limit, seconds, most_wait
        self.held, self.last, self.blocked = held or [], last, blocked  # (start, tokens) in order of start

    def block(self, until: float) -> None:
        self.blocked = max(self.blocked, until)

    def start(self, when: float, need: int) -> float | None:
        """When a call may begin, which it then does; None if it would wait too long or is too large."""
        at = max(when, self.last, self.blocked)
        held = [h for h in self.held if h[0] > at - self.seconds]
        used = sum(n for _, n in held)
        for t, n in held:
            if used + need <= self.limit:
                break
            used, at = used - n, t + self.seconds
        if need > self.limit or self.most_wait is not None and at - when > self.most_wait:
            return None
        self.held, self.last = [h for h in held if h[0] > at - self.seconds] + [(at, need)], at
        return at


def paced(calls: DataFrame, key: str, order: list[str], at: str, tokens: str, limit: int, seconds: int = 60, most_wait: float | None = None) -> DataFrame:
    """calls with the `start` each gets, first in first out, so that no `seconds` of a key hold more than `limit` tokens.

    start is null for a call that would wait longer than `most_wait`, or is larger than the
    limit. A key's calls are one sequence by nature; they are gone through in order, with
    those of the last `seconds` kept.
    """
    schema = f"{calls.schema.simpleString()[7:-1]},start double".replace(":", " ").replace(",", ", ")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group, budget = group.sort_values(order, kind="stable"), Budget(limit, seconds, most_wait)
        starts = [budget.start(when, need) for when, need in zip(group[at].astype(float), group[tokens].fillna(0).astype(int))]
        return group.assign(start=pd.array(starts, "Float64"))

    return calls.groupBy(key).applyInPandas(run, schema)


def final_outcomes(attempts: DataFrame, call: list[str], client: str, order: str, outcome: str) -> DataFrame:
    """One row a call: `answered` if a client's last attempt is ok, else the outcomes that its clients ended with."""
    last = attempts.groupBy(*call, client).agg(F.max_by(outcome, order).alias("_o"))
    out = last.groupBy(*call).agg(F.bool_or(F.col("_o") == "ok").alias("answered"), F.array_sort(F.collect_set("_o")).alias("outcomes"))
    return out.withColumn("bad_output", ~F.col("answered") & F.forall("outcomes", lambda o: o == "bad_output"))


def claimable(jobs: DataFrame, job: str, state: str, order: list[str], slots: int) -> DataFrame:
    """Queued jobs that may start: as many, in order, as the slots that running ones leave."""
    running = jobs.agg(F.count_if(F.col(state) == "running").alias("_r"))
    queue = jobs.filter(F.col(state) == "queued").orderBy(*order).limit(slots)
    place = F.row_number().over(Window.orderBy(*order))  # of `slots` rows at most
    return queue.withColumn("_i", place).crossJoin(running).filter(F.col("_i") + F.col("_r") <= slots).drop("_i", "_r")


def read_through(requests: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Requests with the cached value of their key, the last written one; misses stay as `not_run`."""
    kept = top_per(cache, [key], [F.desc("written")]).select(F.col(key).alias("_key"), "value", F.lit(True).alias("_hit"))
    out = requests.join(kept, F.col(key) == F.col("_key"), "left")
    return out.withColumn("status", F.when(F.col("value").isNull(), "not_run").otherwise("cached")).drop("_key", "_hit")


def filled(requests: DataFrame, cache: DataFrame, key: str, text: str, compute, kind: str = "double") -> tuple[DataFrame, DataFrame]:
    """requests with the cached or computed value of their key, and the rows to add to the cache.

    compute: a function of a pandas Series of texts, which gets each missing key once.
    """
    have = cache.select(F.col(key).alias("_key"), "value").dropDuplicates(["_key"])
    missing = requests.filter(F.col(key).isNotNull()).join(have, F.col(key) == F.col("_key"), "left_anti").groupBy(key).agg(F.min(text).alias("_text"))
    new = missing.select(key, F.pandas_udf(lambda x: compute(x), kind)(F.col("_text")).alias("value"))
    both = have.unionByName(new.select(F.col(key).alias("_key"), "value"))
    return requests.join(both, F.col(key) == F.col("_key"), "left").drop("_key"), new


def upsert_buckets(path: str, key: str, order: list[str], buckets: int = BUCKETS):
    """A foreachBatch function that keeps each key's last row; a batch rewrites the buckets of its keys alone.

    Bucket b of epoch e lies in `path`/data/b=…/v=e, and `path`/current/v=e names the
    versions that hold after it. A batch that is run again reads what held before it, and
    writes the same again. Versions that no later one names are deleted one epoch on.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)  # it is read twice, and what made it may keep state
        try:
            put(batch, epoch)
        finally:
            batch.unpersist()

    def put(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        held = _versions(spark, path, epoch)
        rows = batch.withColumn("b", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = [r["b"] for r in rows.select("b").distinct().collect()]  # at most `buckets`
        old = [f"{path}/data/b={b}/v={held[b]}" for b in touched if b in held]
        if old:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(*old).withColumn("b", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")))
        last = top_per(rows, [key], [F.desc(c) for c in order]).withColumn("v", F.lit(epoch))
        spark_conf = {"partitionOverwriteMode": "dynamic"}
        last.repartition(max(1, len(touched)), "b").write.options(**spark_conf).mode("overwrite").partitionBy("b", "v").parquet(f"{path}/data")
        now = held | dict.fromkeys(touched, epoch)
        if now:
            spark.createDataFrame([(b, v) for b, v in sorted(now.items())], "b int, v int").coalesce(1).write.mode("overwrite").parquet(f"{path}/current/v={epoch}")
        before = _versions(spark, path, epoch - 1)
        for b in touched:
            if b in before and before[b] != held.get(b):
                at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data/b={b}/v={before[b]}")
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    return run


def _versions(spark: SparkSession, path: str, before: int) -> dict[int, int]:
    """Bucket to version as they held before an epoch."""
    try:
        rows = spark.read.option("basePath", f"{path}/current").parquet(f"{path}/current")
    except AnalysisException:  # nothing has been written yet
        return {}
    rows = spark.read.schema("b int, v int").option("recursiveFileLookup", True).parquet(f"{path}/current").select("b", "v", F.regexp_extract(F.col("_metadata.file_path"), r"/v=(\d+)/", 1).cast("int").alias("epoch")).filter(F.col("epoch") < before)
    last = rows.agg(F.max("epoch")).first()[0]
    return {} if last is None else {r["b"]: r["v"] for r in rows.filter(F.col("epoch") == last).collect()}  # a row a bucket


def read_buckets(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows that hold now."""
    now = _versions(spark, path, 1 << 30)
    paths = [f"{path}/data/b={b}/v={v}" for b, v in now.items()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def windowed_counts(events: DataFrame, ts: str, by: str, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts per time window under a watermark; works on a stream and on a table."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), by).agg(F.count("*").alias("n"))
