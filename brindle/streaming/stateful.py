"""Keyed state machines over streams: leases of messages, retries with backoff, live alerts.

A machine is a few pure functions over one key's state. `InOrder` runs it in event time: rows wait in state until the watermark has passed
them and are then taken in order, so that a result doesn't depend on how rows fell into micro-batches. What a machine does
of itself after a while (`due`) has its place in that order too. States live in RocksDB, one entry a key, and can be read
back as a table with `ledger`; `finish` runs what still waits in a checkpoint, as a batch.
"""

import contextlib
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from brindle.operators import graph

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Seconds that a delivered message may be idle before another consumer can claim it, and milliseconds that an acknowledged one is remembered.
IDLE_S, REMEMBERED_MS = 60.0, 86_400_000
#: Alerts that a key's history holds.
HISTORY = 1000


class Machine:
    """One key's state and its rows. ROW, STATE and OUT are schemas; a row and an output begin with us, microseconds since 1970."""

    ROW, STATE, OUT = "", "", ""

    def start(self) -> tuple:
        raise NotImplementedError

    def due(self, state: tuple) -> int | None:
        """When the machine acts of itself next."""
        return None

    def on_time(self, state: tuple, us: int) -> tuple[tuple | None, list[tuple]]:
        """The state after acting of itself, None to forget the key, and outputs."""
        return state, []

    def on_row(self, state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError

    def run(self, state: tuple | None, rows: list[tuple], until: int) -> tuple[tuple | None, list[tuple]]:
        """The state after all rows, which are sorted, and what falls due up to `until`; a row comes before what is due at its time."""
        out, at = [], 0
        while True:
            due = self.due(state) if state is not None else None
            if at < len(rows) and (due is None or rows[at][0] <= due):
                state, told = self.on_row(self.start() if state is None else state, rows[at])
                at += 1
            elif due is not None and (due <= until or at < len(rows)):
                state, told = self.on_time(state, due)
            else:
                return state, out
            out += told


class InOrder(StatefulProcessor):
    def __init__(self, machine: Machine, keys: list[str], columns: list[str]):
        self.machine, self.keys, self.columns = machine, keys, columns

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.machine.ROW)
        self.ledger = handle.getValueState("ledger", self.machine.STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        whole = [i for i, x in enumerate(self.machine.ROW.split(", ")) if x.endswith((" long", " int"))]  # pandas has whole numbers beside missing ones as floats
        new = [plain(r) for b in rows for r in b[self.columns].itertuples(index=False, name=None)]
        yield from self._go(key, [tuple(int(x) if i in whole and x is not None else x for i, x in enumerate(r)) for r in new], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._go(key, [], timerValues)

    def _go(self, key, new: list[tuple], timers) -> Iterator[pd.DataFrame]:
        passed = timers.getCurrentWatermarkInMs() * 1000
        waiting = sorted([*(plain(x) for x in self.waiting.get()), *new], key=order)
        ready = [x for x in waiting if x[0] <= passed]
        later = waiting[len(ready) :]
        before = plain(self.ledger.get()) if self.ledger.exists() else None
        state, out = self.machine.run(before, ready, passed)
        if len(ready) or new:
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
        if state is None:
            self.ledger.clear()
        elif state != before:
            self.ledger.update(state)
        due = self.machine.due(state) if state is not None else None
        times = [x for x in (later[0][0] if later else None, due) if x is not None]
        if times:
            self.handle.registerTimer(-(-min(times) // 1000))  # rounded up to whole milliseconds
        if out:
            yield pd.DataFrame([(*key, *x) for x in out], columns=[*self.keys, *names(self.machine.OUT)], dtype=object)

    def close(self) -> None:
        pass


def names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def plain(row: tuple) -> tuple:
    """The row as Python's own values; what pandas has as missing is None."""
    one = lambda x: x if isinstance(x, (list, str)) or x is None else None if pd.isna(x) else x.item() if hasattr(x, "item") else x
    return tuple(list(map(int, x)) if hasattr(x, "tolist") and getattr(x, "ndim", 0) else one(x) for x in row)


def order(row: tuple) -> tuple:
    return tuple((x is not None, x) for x in row)


def machine_stream(stream: DataFrame, machine: Machine, keys: list[str], time: str, columns: dict[str, Column], delay: str) -> DataFrame:
    """The outputs of a machine for each key of a stream; rows more than `delay` late are left out."""
    us = F.unix_micros(F.col(time).cast("timestamp")).alias("us")
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).select(*keys, time, us, *(c.alias(n) for n, c in columns.items()))
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + machine.OUT
    return rows.groupBy(*keys).transformWithStateInPandas(InOrder(machine, keys, ["us", *columns]), schema, "append", "EventTime")


@contextlib.contextmanager
def rocks(spark: SparkSession):
    """These streams need the RocksDB state store; what was set before is set again after they have started."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def to_files(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts writing a stream's rows as Parquet files, up to what has landed by now."""
    with rocks(rows.sparkSession):
        return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)


def ledger(spark: SparkSession, checkpoint: str, variable: str = "ledger") -> DataFrame:
    """The keys and their states as of the last micro-batch, through the state data source."""
    with rocks(spark):
        return spark.read.format("statestore").option("stateVarName", variable).load(checkpoint).drop("partition_id")


def finish(spark: SparkSession, checkpoint: str, machine: Machine, schema: str) -> tuple[DataFrame, DataFrame]:
    """The outputs, and the ledger, as they are once all rows that still wait in a checkpoint are taken in order; schema is that of the keys."""
    keys, state, row = names(schema), names(machine.STATE), names(machine.ROW)
    waiting = ledger(spark, checkpoint, "waiting").groupBy("key").agg(F.collect_list("list_element").alias("rows"))
    all_ = ledger(spark, checkpoint).join(waiting, "key", "full").select(*(F.col(f"key.{k}").alias(k) for k in keys), F.col("value").alias("state"), "rows")

    def run(batches: Iterator[pd.DataFrame], ended: bool) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = []
            for key, before, rows in zip(b[keys].itertuples(index=False, name=None), b["state"], b["rows"], strict=True):
                before = None if before is None else plain(tuple(before[c] for c in state))  # values in structs are Python's own
                after, out = machine.run(before, sorted([plain(tuple(x[c] for c in row)) for x in rows] if rows is not None else [], key=order), 0)
                done += [(*key, *after)] if ended and after is not None else [(*key, *x) for x in out] if not ended else []
            yield pd.DataFrame(done, columns=[*keys, *(state if ended else names(machine.OUT))], dtype=object)

    outputs = all_.mapInPandas(lambda b: run(b, False), f"{schema}, {machine.OUT}")
    return outputs, all_.mapInPandas(lambda b: run(b, True), f"{schema}, {machine.STATE}")


# ---- leases


class Lease(Machine):
    """A message in a consumer group: ready, pending with an owner, or acknowledged.

    Commands: publish; read, which a ready message takes; claim, which a pending one takes that has been idle for `idle` microseconds;
    ack, by any consumer of the group. What can't be done is refused. A pending message that has been idle for idle_s is told once
    after each delivery, so that a consumer may claim it; an acknowledged one is forgotten after a day.
    """

    ROW = "us long, kind string, consumer string, idle long"
    STATE = "status string, owner string, deliveries int, since long, told boolean"
    OUT = "us long, event string, owner string, deliveries int"

    def __init__(self, idle_s: float = IDLE_S):
        self.idle = round(idle_s * 1e6)

    def start(self) -> tuple:
        return ("new", None, 0, 0, False)

    def due(self, state: tuple) -> int | None:
        status, _, _, since, told = state
        if status == "pending" and not told:
            return since + self.idle
        return since + REMEMBERED_MS * 1000 if status == "acked" else None

    def on_time(self, state: tuple, us: int) -> tuple[tuple | None, list[tuple]]:
        status, owner, n, since, _ = state
        if status == "acked":
            return None, []
        return (status, owner, n, since, True), [(us, "idle", owner, n)]

    def on_row(self, state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        status, owner, n, since, _ = state
        us, kind, consumer, idle = row
        if kind == "publish":
            return (("ready", None, 0, us, False), [(us, "published", None, 0)]) if status == "new" else (state, [(us, "refused", consumer, n)])
        if kind == "read" and status == "ready" or kind == "claim" and status == "pending" and us - since >= (self.idle if idle is None else idle):
            return ("pending", consumer, n + 1, us, False), [(us, "delivered" if kind == "read" else "claimed", consumer, n + 1)]
        if kind == "ack" and status == "pending":
            return ("acked", owner, n, us, False), [(us, "acked", consumer, n)]
        return state, [(us, "refused", consumer, n)]


def for_groups(messages: DataFrame, groups: DataFrame) -> DataFrame:
    """A row of messages (topic, ...) for each consumer group (topic, group) of its topic; a group that is created twice is one."""
    return messages.join(groups.select("topic", "group").distinct(), "topic")


def leases(commands: DataFrame, time: str = "at", idle_s: float = IDLE_S, delay: str = "10 seconds") -> DataFrame:
    """What became of each command on the messages of consumer groups: group, message_id, us, event, owner and deliveries.

    commands is a stream of group, message_id, kind, consumer, idle (microseconds; null: idle_s) and a time.
    """
    columns = {"kind": F.col("kind"), "consumer": F.col("consumer"), "idle": F.col("idle").cast("long")}
    return machine_stream(commands, Lease(idle_s), ["group", "message_id"], time, columns, delay)


def pending(spark: SparkSession, checkpoint: str) -> DataFrame:
    """group, message_id, owner, deliveries and since (microseconds) of the messages that are out and not acknowledged."""
    rows = ledger(spark, checkpoint).where("value.status = 'pending'")
    return rows.select("key.group", "key.message_id", "value.owner", "value.deliveries", "value.since")


# ---- alerts


class Alert(Machine):
    """A rule on one key: it fires once in a run of rows that hold, at the first one `duration` or more after the run's start, and is resolved by the first row that doesn't hold."""

    ROW = "us long, ok boolean"
    STATE = "start long, fired long, last long, starts array<long>, fireds array<long>, ends array<long>"
    OUT = "us long, event string, start long, fired long, last long"

    def __init__(self, duration_s: float = 0.0, history: int = HISTORY):
        self.duration, self.history = round(duration_s * 1e6), history

    def start(self) -> tuple:
        return (None, None, None, [], [], [])

    def on_row(self, state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        start, fired, last, *past = state
        us, ok = row
        if ok:
            start = us if start is None else start
            if fired is None and us - start >= self.duration:
                return (start, us, us, *past), [(us, "fired", start, us, us)]
            return (start, fired, us, *past), []
        if fired is None:
            return (None, None, None, *past), []
        past = [[*x, y][-self.history :] for x, y in zip(past, (start, fired, last), strict=True)]
        return (None, None, None, *past), [(us, "resolved", start, fired, last)]


def live_alerts(metrics: DataFrame, by: list[str], time: str, ok: Column, duration_s: float = 0.0, delay: str = "1 hour") -> DataFrame:
    """by, us, event (fired, resolved), start, fired and last of a rule over a stream, in the order of time for each key. Null conditions do not hold."""
    return machine_stream(metrics, Alert(duration_s), by, time, {"ok": F.coalesce(ok, F.lit(False))}, delay)


def alert_runs(events: DataFrame, rest: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    """by, start, fired_at and end of all alerts: those resolved in a stream's events or in the rest that finish() gave, and those that are still active."""
    over = events.unionByName(rest).where("event = 'resolved'").select(*by, "start", "fired", "last")
    open_ = state.where("fired IS NOT NULL").select(*by, "start", "fired", "last")
    time = lambda c: F.timestamp_micros(c)
    return over.unionByName(open_).select(*by, time("start").alias("start"), time("fired").alias("fired_at"), time("last").alias("end"))


def replayed_alerts(metrics: DataFrame, by: list[str], time: str, ok: Column, duration_s: float, delay: str) -> DataFrame:
    """by, start, fired_at and end of all alerts of what has landed: the stream's events, then those of the rows that still waited when it ended."""
    spark, schema = metrics.sparkSession, ", ".join(f"{c} {dict(metrics.dtypes)[c]}" for c in by)
    events = live_alerts(metrics, by, time, ok, duration_s, delay)
    folder = f"{graph.shared_folder(spark)}/alerts-{uuid.uuid4().hex}"
    to_files(events, f"{folder}/events", f"{folder}/state").awaitTermination()
    rest, state = finish(spark, f"{folder}/state", Alert(duration_s), schema)
    return alert_runs(spark.read.schema(events.schema).parquet(f"{folder}/events"), rest, state, by)


# ---- retries


class Retry(StatefulProcessor):
    """Handles each message by itself: a failure is tried again after delay * 2^attempt seconds of processing time, and after `retries` of them the message is dead."""

    STATE = "payload string, attempt int, due long"
    OUT = "id string, outcome string, retry_count int, error string, payload string, at timestamp"

    def __init__(self, handle: Callable[[str], object], retries: int, delay_s: float):
        self.handle_one, self.retries, self.delay = handle, retries, delay_s

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("ledger", self.STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        payloads = [p for b in rows for p in b["payload"]]
        if not self.state.exists():  # a repeat of a message that is being tried again changes nothing
            yield self._try(key[0], payloads[0], 0, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        payload, attempt, _ = self.state.get()
        yield self._try(key[0], payload, attempt, timerValues)

    def _try(self, name: str, payload: str, attempt: int, timers) -> pd.DataFrame:
        now, error = timers.getCurrentProcessingTimeInMs(), None
        try:
            if not self.handle_one(payload):
                error = "refused"
        except Exception as e:  # any failure of the caller's code counts
            error = f"{type(e).__name__}: {e}"[:500]
        if error is None or attempt == self.retries:
            self.state.clear()
            outcome = "acked" if error is None else "dead"
        else:
            due = now + round(self.delay * 1000 * 2**attempt)
            self.state.update((payload, attempt + 1, due))
            self.handle.registerTimer(due)
            outcome = "retrying"
        return pd.DataFrame({"id": [name], "outcome": [outcome], "retry_count": [attempt], "error": [error], "payload": [payload], "at": [pd.Timestamp(now, unit="ms", tz="UTC")]})

    def close(self) -> None:
        pass


def handled(messages: DataFrame, handle: Callable[[str], object], retries: int = 3, delay_s: float = 1.0) -> DataFrame:
    """id, outcome (acked, retrying, dead), retry_count, error, payload and at: every try of every message of a stream (id, payload).

    handle gets a payload on an executor; a false result or an exception fails that message only. State holds what waits for its
    next try, and nothing else. Handling is at least once: a micro-batch that is run again handles its messages again.
    """
    rows = messages.select(F.col("id").cast("string").alias("id"), F.col("payload").cast("string").alias("payload"))
    return rows.groupBy("id").transformWithStateInPandas(Retry(handle, retries, delay_s), Retry.OUT, "update", "ProcessingTime")


def dead_letters(tries: DataFrame, topic: str) -> DataFrame:
    """id, topic and headers (the original message, its topic, its retries, when it failed and why) of messages that are dead."""
    headers = F.create_map(F.lit("original_message_id"), F.col("id"), F.lit("original_topic"), F.lit(topic), F.lit("retry_count"), F.col("retry_count").cast("string"), F.lit("failed_at"), F.col("at").cast("string"), F.lit("error"), F.col("error"))
    return tries.where("outcome = 'dead'").select(F.sha2("id", 256).alias("id"), F.lit(f"{topic}.dead").alias("topic"), headers.alias("headers"), "payload")
