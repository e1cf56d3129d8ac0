"""Streams with state: restarts from a checkpoint, repeated and late events, timers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from palisade.streaming import jobs, live


def at(second):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=second)


@pytest.fixture
def run(spark, tmp_path):
    """Writes each list of rows as a file and runs the stream anew on one checkpoint; gives all rows so far."""

    def go(make, schema, rows):
        n = len(list(tmp_path.glob("in/*"))) if (tmp_path / "in").exists() else 0
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={n}"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "part=*"))
        query = make(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(240)
        assert query.exception() is None
        return spark.read.parquet(str(tmp_path / "out")).collect()

    return go


def test_job_states_after_restarts_equal_the_batch(spark, run):
    rng = random.Random(2)
    states = ["queued", "running", "completed", "failed", "odd", None]
    events = [(rng.randrange(30), rng.choice(states), at(rng.randrange(500)), i) for i in range(200)] + [(99, "running", None, 1)]
    schema, out = "job long, state string, ts timestamp, id long", []
    for part in (events[:70], events[50:140] + events[:5], events[140:]):  # some events come twice
        out = run(lambda s: live.job_states(s), schema, part)
    worth = lambda r: (-jobs.ORDER[r.state], r.ts)
    last = {job: min((r for r in out if r.job == job), key=worth) for job in {r.job for r in out}}
    want = {r.job: (r.state, r.ts) for r in jobs.latest_state(spark.createDataFrame(events, schema).filter("ts is not null")).collect()}
    assert {j: (r.state, r.ts) for j, r in last.items()} == want
    assert {r.why for r in out} == {"event"}


def test_leases_end(run):
    schema = "job string, state string, ts timestamp, id long"
    make = lambda s: live.job_states(s, lease=100, keep=1000, delay="0 seconds")
    run(make, schema, [("lost", "queued", at(0), 1), ("lost", "running", at(10), 2), ("waiting", "queued", at(5), 3), ("done", "running", at(6), 4), ("done", "completed", at(20), 5)])
    run(make, schema, [("clock", "queued", at(150), 9)])
    out = run(make, schema, [("lost", "completed", at(160), 10), ("clock", "running", at(170), 11)])
    seen = {(r.job, r.state, r.why) for r in out}
    assert {("lost", "failed", "orphaned"), ("waiting", "queued", "rerun"), ("done", "completed", "event")} <= seen
    assert ("lost", "completed", "event") not in seen  # an end state is final
    assert not any(r.job == "done" and r.why != "event" for r in out)


def test_pacing_after_restarts_equals_the_batch(spark, run):
    rng = random.Random(7)
    calls, clock = [], 0.0
    for i in range(120):
        clock += rng.random() * 5
        calls.append((rng.choice(["a", "b"]), i, clock, rng.randrange(0, 400), None))
    schema, out = "client string, id long, at double, tokens long, block double", []
    for part in (calls[:50], calls[50:51], calls[51:]):
        out = run(lambda s: live.paced(s, 1000, most_wait=90.0), schema, part)
    want = jobs.paced(spark.createDataFrame(calls, schema), "client", ["at"], "at", "tokens", 1000, most_wait=90.0)
    assert {(r.client, r.id): r.start for r in out} == {(r.client, r.id): r.start for r in want.collect()}
    assert any(r.start is None for r in out)


def test_blocked_clients(run):
    schema = "client string, id long, at double, tokens long, block double"
    out = run(lambda s: live.paced(s, 1000), schema, [("a", 1, 0.0, 10, None), ("a", 2, 1.0, 0, 30.0), ("a", 3, 2.0, 10, None), ("b", 4, 2.0, 10, None), ("b", 5, 2.0, 5000, None)])
    assert {r.id: r.start for r in out} == {1: 0.0, 3: 31.0, 4: 2.0, 5: None}


def test_outcomes_of_calls(spark, run):
    schema = "call long, client string, attempt int, outcome string, ts timestamp"
    attempts = [
        (1, "a", 0, "rate_limit", at(0)), (1, "a", 1, "ok", at(9)), (2, "a", 0, "bad_output", at(1)), (2, "b", 0, "bad_output", at(3)),
        (3, "a", 0, "rate_limit", at(2)), (3, "a", 1, "failed", at(4)), (3, "b", 0, "bad_output", at(5)), (2, "a", 0, "bad_output", at(1)),
    ]
    make = lambda s: live.final_outcomes(s, patience=60)
    run(make, schema, attempts[:3])
    run(make, schema, attempts[3:])
    run(make, schema, [(9, "a", 0, "ok", at(500))])
    out = run(make, schema, [(10, "a", 0, "ok", at(501))])
    got = {r.call: (r.answered, r.outcomes, r.bad_output) for r in out if r.call < 9}
    want = jobs.final_outcomes(spark.createDataFrame(attempts, schema), ["call"], "client", "attempt", "outcome").collect()
    assert got == {r.call: (r.answered, r.outcomes, r.bad_output) for r in want}
    assert len([r for r in out if r.call == 2]) == 1


def test_a_batch_of_a_stream_is_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def once(i):
        seen.add(1)
        return i

    batch = spark.range(40).select(F.udf(once, "long")("id").alias("job"), F.lit("queued").alias("state"), F.lit(0).alias("epoch"))
    jobs.upsert_buckets(str(tmp_path / "out"), "job", ["epoch"], 4)(batch, 0)
    assert seen.value == 40
    assert jobs.read_buckets(spark, str(tmp_path / "out"), "job long, state string").count() == 40
