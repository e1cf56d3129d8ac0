"""Live services as streams with state: job states with leases, token budgets, final outcomes of calls.

Each is keyed (by job, client, call), keeps a few rows a key, and takes up where it
stopped when it is started again on its checkpoint. Events of one key may be repeated or
come in any order within the watermark's delay: states and outcomes depend on the set of
events alone, and equal those of the batch functions in `jobs`. What is later than the
watermark is dropped. Timers are of event time, so that a replay gives what the live run
gave; they fire once the watermark has passed them.

Results for special rows: null keys are one key; events with an unknown state or without a
time are dropped; an empty stream gives no rows. Columns other than those named are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .jobs import ORDER, Budget

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Seconds for which an end state is kept, so that late events of the job change nothing.
KEEP = 86_400
END = 2


def use_state_store(spark: SparkSession) -> None:
    """Streams with timers need the store that keeps state on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _millis(at) -> int:
    return int(pd.Timestamp(at).timestamp() * 1000)


class _Timed(StatefulProcessor):
    """Keeps one timer a key, and its time as state: to have the handle list a key's timers takes tens of milliseconds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "at long")

    def _set(self, at: int) -> None:
        if old := self.due.get():
            self.handle.deleteTimer(old[0])
        self.handle.registerTimer(at)
        self.due.update((at,))

    def _unset(self, fired: bool = False) -> None:
        if old := self.due.get():
            if not fired:
                self.handle.deleteTimer(old[0])
            self.due.clear()

    def close(self) -> None:
        pass


class JobStates(_Timed):
    """queued, running, then an end state; the first to say so counts, and nothing goes back."""

    def __init__(self, lease: int | None, keep: int):
        self.lease, self.keep = lease, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held = handle.getValueState("job", "state string, us long, id long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        worth = lambda x: (-ORDER[x[0]], x[1], x[2])
        before = self.held.get()
        events = [*([tuple(before)] if before else []), *((r.state, r.us, r.id) for r in rows)]
        best = min(events, key=worth)
        if before and worth(best) == worth(tuple(before)):
            return
        self.held.update(best)
        wait = self.keep if ORDER[best[0]] == END else self.lease
        if wait is None:
            self._unset()
        else:
            self._set(best[1] // 1000 + 1000 * wait)
        yield Row(job=key[0], state=best[0], us=best[1], why="event")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state, us, id_ = self.held.get()
        at = expiredTimerInfo.getExpiryTimeInMs()
        if ORDER[state] == END:
            self.held.clear()
            self._unset(fired=True)
        elif state == "running":  # its process has not been heard of since
            self.held.update(("failed", 1000 * at, id_))
            self._set(at + 1000 * self.keep)
            yield Row(job=key[0], state="failed", us=1000 * at, why="orphaned")
        else:  # nobody took it
            self._set(at + 1000 * self.lease)
            yield Row(job=key[0], state=state, us=1000 * at, why="rerun")


def job_states(events: DataFrame, lease: int | None = None, keep: int = KEEP, delay: str = "10 minutes") -> DataFrame:
    """events (job, state, ts, id), a stream, to (job, state, ts, why): each change of a job's state.

    lease: seconds after which a running job that was not heard of has failed
    (`orphaned`), and a queued one is to be run again (`rerun`, each time).
    """
    use_state_store(events.sparkSession)
    rows = events.filter(F.col("state").isin(*ORDER) & F.col("ts").isNotNull()).select("job", "state", "ts", F.coalesce("id", F.lit(0)).cast("long").alias("id"))
    rows = rows.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    job = rows.schema["job"].dataType.simpleString()
    # a row at a time: a job has few, and pandas takes milliseconds a job
    out = rows.withWatermark("ts", delay).groupBy("job").transformWithState(JobStates(lease, keep), f"job {job}, state string, us long, why string", "Append", "EventTime")
    return out.select("job", "state", F.timestamp_micros("us").alias("ts"), "why")


class Pacer(_Timed):
    def __init__(self, limit: int, seconds: int, most_wait: float | None):
        self.of = (limit, seconds, most_wait)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.calls = handle.getListState("calls", "start double, tokens long")
        self.at = handle.getValueState("at", "last double, blocked double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, blocked = self.at.get() if self.at.exists() else (float("-inf"), float("-inf"))
        budget = Budget(*self.of, [(s, n) for s, n in self.calls.get()] if self.calls.exists() else [], last, blocked)
        batch = pd.concat(list(rows)).sort_values(["at", "id"], kind="stable")
        starts = []
        for r in batch.itertuples():
            if pd.notna(r.block):
                budget.block(r.at + r.block)
                starts.append(None)
            else:
                starts.append(budget.start(r.at, int(r.tokens)))
        self.at.update((budget.last, budget.blocked))
        self.calls.put(budget.held) if budget.held else self.calls.clear()
        out = pd.DataFrame({"client": [key[0]] * len(batch), "id": batch["id"].to_numpy(), "start": pd.array(starts, "Float64")})
        yield out[batch["block"].isna().to_numpy()]


def paced(calls: DataFrame, limit: int, seconds: int = 60, most_wait: float | None = None) -> DataFrame:
    """calls (client, id, at, tokens, block), a stream, to (client, id, start): when each may begin.

    As `jobs.paced`, for calls as they come: those of one batch in the order of (at, id),
    and none before one of an earlier batch. A row with `block` is no call: it says that
    the client answers nobody for so many seconds. A call without a start is to go to the
    next client.
    """
    use_state_store(calls.sparkSession)
    rows = calls.select("client", F.col("id").cast("long").alias("id"), F.col("at").cast("double").alias("at"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), F.col("block").cast("double").alias("block"))
    client = rows.schema["client"].dataType.simpleString()
    return rows.filter("at is not null").groupBy("client").transformWithStateInPandas(Pacer(limit, seconds, most_wait), f"client {client}, id long, start double", "Append", "None")


class Outcomes(_Timed):
    def __init__(self, patience: int, keep: int):
        self.patience, self.keep = patience, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.ends = handle.getMapState("ends", "client string", "attempt int, outcome string")
        self.told = handle.getValueState("told", "answered boolean")

    def _row(self, key, ends: dict[str, tuple[int, str]], answered: bool) -> pd.DataFrame:
        names = sorted({o for _, o in ends.values()})
        bad = not answered and all(o == "bad_output" for o in names)
        return pd.DataFrame({"call": [key[0]], "answered": [answered], "outcomes": [names], "bad_output": [bad]})

    def _held(self) -> dict[str, tuple[int, str]]:
        return {k[0]: tuple(v) for k, v in self.ends.iterator()} if self.ends.exists() else {}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.told.exists():
            return
        ends, latest = self._held(), 0
        for batch in rows:
            for r in batch.itertuples():
                latest = max(latest, _millis(r.ts))
                if r.client not in ends or ends[r.client][0] < r.attempt:
                    ends[r.client] = (int(r.attempt), r.outcome)
                    self.ends.updateValue((r.client,), ends[r.client])
        answered = any(o == "ok" for _, o in ends.values())
        if answered:
            yield self._end(key, ends, True, latest)
        else:
            self._set(latest + 1000 * self.patience)

    def _end(self, key, ends, answered: bool, at: int) -> pd.DataFrame:
        self.told.update((answered,))
        self.ends.clear()
        self._set(at + 1000 * self.keep)
        return self._row(key, ends, answered)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.told.exists():
            self.told.clear()
            self._unset(fired=True)
        else:
            yield self._end(key, self._held(), False, expiredTimerInfo.getExpiryTimeInMs())


def final_outcomes(attempts: DataFrame, patience: int = 300, keep: int = KEEP, delay: str = "1 minute") -> DataFrame:
    """attempts (call, client, attempt, outcome, ts), a stream, to one row a call: (call, answered, outcomes, bad_output).

    A call is told as soon as a client's last attempt is ok; else `patience` seconds after
    its last attempt it has failed, with the outcomes its clients ended with.
    """
    use_state_store(attempts.sparkSession)
    rows = attempts.filter("ts is not null and client is not null").select("call", F.col("client").cast("string").alias("client"), F.coalesce("attempt", F.lit(0)).cast("int").alias("attempt"), F.coalesce("outcome", F.lit("failed")).alias("outcome"), "ts")
    call = rows.schema["call"].dataType.simpleString()
    schema = f"call {call}, answered boolean, outcomes array<string>, bad_output boolean"
    return rows.withWatermark("ts", delay).groupBy("call").transformWithStateInPandas(Outcomes(patience, keep), schema, "Append", "EventTime")
