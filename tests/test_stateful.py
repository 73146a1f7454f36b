"""Stateful streams by replay: results must not depend on how rows fell into micro-batches, and equal a plain sequential run."""

import random
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from brindle.operators import monitoring
from brindle.streaming import stateful


T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def land(spark, rows, schema, path, sizes):
    """Writes rows as files of these sizes, whose names give their order."""
    at, n = 0, 0
    while at < len(rows):
        k = sizes()
        spark.createDataFrame(rows[at : at + k], schema).coalesce(1).write.mode("append").parquet(path)
        at, n = at + k, n + 1
        time.sleep(0.01)
    return n


def stream_of(spark, path):
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def sequential(rows, idle=60_000_000):
    """Leases by a plain loop over all commands in order of time: events and what is pending."""
    held, out = {}, []

    def tell(until):
        for key, m in held.items():
            if m["status"] == "pending" and not m["told"] and m["since"] + idle < until:
                m["told"] = True
                out.append((*key, m["since"] + idle, "idle", m["owner"], m["n"]))

    for group, message, kind, consumer, wait, us in sorted(rows, key=lambda r: (r[5], r[2], r[3] or "")):
        tell(us)
        m = held.setdefault((group, message), {"status": None, "n": 0, "since": 0, "owner": None, "told": False})
        event = "refused"
        if kind == "publish" and m["status"] is None:
            m.update(status="ready", since=us)
            event = "published"
        elif kind == "read" and m["status"] == "ready":
            m.update(status="pending", owner=consumer, n=1, since=us, told=False)
            event = "delivered"
        elif kind == "claim" and m["status"] == "pending" and us - m["since"] >= (idle if wait is None else wait):
            m.update(owner=consumer, n=m["n"] + 1, since=us, told=False)
            event = "claimed"
        elif kind == "ack" and m["status"] == "pending":
            m.update(status="acked", since=us)
            event = "acked"
        out.append((group, message, us, event, consumer if event != "published" else None, m["n"]))
    return sorted(out, key=repr), {k: (m["owner"], m["n"], m["since"]) for k, m in held.items() if m["status"] == "pending"}


COMMANDS = "group string, message_id string, kind string, consumer string, idle long, at timestamp"


@pytest.mark.parametrize("seed", [1, 2])
def test_leases_equal_a_sequential_run(spark, tmp_path, seed):
    r = random.Random(seed)
    rows, us = [], 0
    for i in range(6):
        rows += [("g", f"m{i}", "publish", None, None, i), ("h", f"m{i}", "publish", None, None, i)]
    for _ in range(150):
        us += r.choice([1_000, 2_000_000, 31_000_000])
        rows.append((r.choice("gh"), f"m{r.randrange(6)}", r.choice(["read", "claim", "claim", "ack"]) if r.random() < 0.8 else "read", r.choice("xyz"), r.choice([None, 5_000_000]), 10 + us))
    want, held = sequential(rows)
    stamped = [(*x[:5], T0 + timedelta(microseconds=x[5])) for x in rows]
    start = int(T0.timestamp() * 1e6)
    for i in range(0, len(stamped), 4):  # out of order, within the delay
        stamped[i : i + 4] = r.sample(stamped[i : i + 4], len(stamped[i : i + 4]))
    land(spark, stamped, COMMANDS, f"{tmp_path}/in", lambda: r.choice([20, 40, 60]))
    events = stateful.leases(stream_of(spark, f"{tmp_path}/in"), delay="130 seconds")
    stateful.to_files(events, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    rest, state = stateful.finish(spark, f"{tmp_path}/cp", stateful.Lease(), "group string, message_id string")
    got = [tuple(x) for df in (spark.read.parquet(f"{tmp_path}/out"), rest) for x in df.select("group", "message_id", F.col("us") - start, "event", "owner", "deliveries").collect()]
    last = {x[:2]: x[2] for x in sorted(got, key=lambda x: x[2])}
    assert sorted((x for x in want if x[3] != "idle"), key=repr) == sorted((x for x in got if x[3] != "idle"), key=repr)
    assert {x for x in got if x[3] == "idle"} <= {x for x in want if x[3] == "idle"} and all(x in got for x in want if x[3] == "idle" and x[2] <= last[x[:2]])
    assert {(x["group"], x["message_id"]): (x["owner"], x["deliveries"], x["since"] - start) for x in state.where("status = 'pending'").collect()} == held


def test_a_dead_consumers_message_is_claimed_and_handled_once_more(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    groups = spark.createDataFrame([("posts", "g"), ("posts", "g"), ("posts", "h")], "topic string, group string")
    assert stateful.for_groups(spark.createDataFrame([("posts", "m1"), ("other", "m2")], "topic string, message_id string"), groups).count() == 2
    steps = [[("g", "m1", "publish", None, None, at(0)), ("g", "m1", "read", "dies", None, at(1))], [("g", "m1", "claim", "lives", None, at(30))], [("g", "x", "publish", None, None, at(100))], [("g", "m1", "claim", "lives", None, at(101)), ("g", "x", "publish", None, None, at(300))], [("g", "m1", "ack", "lives", None, at(301)), ("g", "x", "publish", None, None, at(600))]]
    seen = []
    for part in steps:
        spark.createDataFrame(part, COMMANDS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        events = stateful.leases(stream_of(spark, f"{tmp_path}/in"), delay="1 second")
        stateful.to_files(events, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
        seen.append({(x["message_id"], x["owner"], x["deliveries"]) for x in stateful.pending(spark, f"{tmp_path}/cp").collect()})
    story = [x["event"] for x in spark.read.parquet(f"{tmp_path}/out").where("message_id = 'm1'").orderBy("us").collect()]
    assert story == ["published", "delivered", "refused", "idle", "claimed", "idle", "acked"]
    assert ("m1", "dies", 1) in seen[2] and ("m1", "lives", 2) in seen[3] and not seen[4]


@pytest.mark.parametrize("seed", [1])
def test_live_alerts_equal_the_batch_rule(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = [(u, T0 + timedelta(seconds=i * 60 + r.randrange(50), microseconds=i), r.choice([0.0, 5.0, 9.0, 9.0, 9.0, None])) for i in range(150) for u in ("a", "b", "c")]
    for i in range(0, len(rows), 6):
        rows[i : i + 6] = r.sample(rows[i : i + 6], len(rows[i : i + 6]))
    land(spark, rows, "u string, at timestamp, v double", f"{tmp_path}/in", lambda: r.choice([40, 90, 150]))
    for duration in (200.0,):
        events = stateful.live_alerts(stream_of(spark, f"{tmp_path}/in"), ["u"], "at", monitoring.condition(F.col("v"), ">", 4.0), duration, "10 minutes")
        stateful.to_files(events, f"{tmp_path}/out{duration}", f"{tmp_path}/cp{duration}").awaitTermination()
        rest, state = stateful.finish(spark, f"{tmp_path}/cp{duration}", stateful.Alert(duration), "u string")
        got = stateful.alert_runs(spark.read.schema(events.schema).parquet(f"{tmp_path}/out{duration}"), rest, state, ["u"])
        want = monitoring.alerts(spark.read.parquet(f"{tmp_path}/in"), ["u"], "at", "v", ">", 4.0, duration)
        columns = ["u", "start", "fired_at", "end"]
        assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect())) != []
    assert spark.read.parquet(f"{tmp_path}/out200.0").count() > 0  # most was told while the stream ran
    machine_state = None
    for i in range(10):
        machine_state, _ = stateful.Alert(0.0, history=2).run(machine_state, [(i, i % 2 == 0)], 0)
    assert machine_state[3:] == ([6, 8], [6, 8], [6, 8])


def test_only_poisoned_messages_die(spark, tmp_path):
    spark.createDataFrame([(f"m{i}", "poison" if i in (3, 50, 77) else "once" if i == 9 else f"{i}") for i in range(100)], "id string, payload string").repartition(2).write.parquet(f"{tmp_path}/in")

    def handle(payload):
        import pathlib

        if payload == "poison":
            raise ValueError("bad")
        if payload == "once":  # fails the first time
            flag = pathlib.Path(f"{tmp_path}/flag")
            there = flag.exists()
            flag.touch()
            return there
        return True

    tries = stateful.handled(stream_of(spark, f"{tmp_path}/in"), handle, retries=2, delay_s=0.5)
    with stateful.rocks(spark):
        q = tries.writeStream.format("memory").queryName("tries").outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="100 milliseconds").start()
    until = time.time() + 150
    while time.time() < until and spark.table("tries").where("outcome <> 'retrying'").count() < 100:
        time.sleep(0.5)
    q.stop()
    rows = spark.table("tries").collect()
    done = {x["id"]: x for x in rows if x["outcome"] != "retrying"}
    assert len(done) == 100 and {k for k, x in done.items() if x["outcome"] == "dead"} == {"m3", "m50", "m77"}
    assert (done["m9"]["outcome"], done["m9"]["retry_count"], done["m3"]["retry_count"]) == ("acked", 1, 2)
    for k in ("m3", "m50", "m77"):
        at = sorted(x["at"] for x in rows if x["id"] == k)
        assert len(at) == 3 and (at[1] - at[0]).total_seconds() >= 0.5 and (at[2] - at[1]).total_seconds() >= 1.0
    letters = stateful.dead_letters(spark.table("tries"), "posts").collect()
    assert {x["headers"]["original_message_id"] for x in letters} == {"m3", "m50", "m77"} and {x["headers"]["retry_count"] for x in letters} == {"2"} and "bad" in letters[0]["headers"]["error"]
