"""Metrics over trailing windows, alert rules as gaps and islands, rate limits, retention of history."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators import graph
from brindle.sources import adapters as A


def condition(value: Column, op: str, threshold: float) -> Column:
    """One of > >= < <= == != ; any other never holds."""
    t = F.lit(threshold)
    known = {">": value > t, ">=": value >= t, "<": value < t, "<=": value <= t, "==": value == t, "!=": value != t}
    return F.coalesce(known.get(op, F.lit(False)), F.lit(False))


def alerts(metrics: DataFrame, by: list[str], time: str, value: str, op: str, threshold: float, duration: float = 0.0) -> DataFrame:
    """start, fired_at and end of each run in which the condition held for at least `duration` seconds; it fires once, at the first tick so long after the start. With a duration over 0 the first tick never fires."""
    w = Window.partitionBy(*by).orderBy(time)
    us = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    marked = metrics.withColumn("_ok", condition(F.col(value), op, threshold)).withColumn("_t", us)
    runs = marked.withColumn("_run", F.sum(F.when(F.col("_ok"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_ok")
    starts = runs.withColumn("_first", F.min("_t").over(Window.partitionBy(*by, "_run")))
    out = starts.groupBy(*by, "_run").agg(F.min(time).alias("start"), F.min(F.when(F.col("_t") - F.col("_first") >= duration, F.col(time))).alias("fired_at"), F.max(time).alias("end"))
    return out.where("fired_at IS NOT NULL").drop("_run")


def window_metrics(events: DataFrame, time: str, ok: Column, latency: Column, user: str, seconds: int = 300) -> DataFrame:
    """Per window: success rate in percent, mean latency in ms of positive ones, events a minute, distinct users."""
    return events.groupBy(F.window(time, f"{seconds} seconds").alias("w")).agg(
        (F.avg(F.when(ok, 1.0).otherwise(0.0)) * 100).alias("success_rate"), F.coalesce(F.avg(F.when(latency > 0, latency)) * 1000, F.lit(0.0)).alias("latency_ms"), (F.count("*") / (seconds / 60)).alias("per_minute"), F.countDistinct(user).alias("active_users")
    ).select(F.col("w.start").alias("start"), "success_rate", "latency_ms", "per_minute", "active_users")


def last_of_each(metrics: DataFrame, name: str, time: str, k: int, tie: str) -> DataFrame:
    return metrics.withColumn("_n", F.row_number().over(Window.partitionBy(name).orderBy(F.desc(time), F.desc(tie)))).where(F.col("_n") <= k).drop("_n")


def health(checks: DataFrame, by: list[str], status: str = "status") -> DataFrame:
    """unhealthy if any check is, degraded if any is, healthy if all are, else unknown."""
    any_ = lambda s: F.bool_or(F.col(status) == s)
    return checks.groupBy(*by).agg(F.when(any_("unhealthy"), "unhealthy").when(any_("degraded"), "degraded").when(F.bool_and(F.col(status) == "healthy"), "healthy").otherwise("unknown").alias("health"))


def prometheus(name: Column, value: Column, help_: Column) -> Column:
    return F.concat(F.lit("# HELP "), name, F.lit(" "), help_, F.lit("\n"), name, F.lit(" "), value.cast("string"))


def _units(rate: float, capacity: float, cost: float) -> tuple[int, int, int]:
    """Refill a microsecond, capacity and cost in whole numbers: of microseconds of refill, or of millionths of a token if nothing is refilled."""
    scale = 1e6 / rate if rate else 1e6
    return (1 if rate else 0), round(capacity * scale), round(cost * scale)


class Effect:
    """What a run of requests does to a bucket, as a function of its level before: min(top, level + shift) on each of a few ranges of levels.

    A request cuts a range in two at most, where levels above pay and those below don't. As a fuller bucket lets through no more
    than capacity / cost requests beyond what an empty one does, and ranges that have come to the same are joined, there are about so
    many ranges however long the run is; so runs can be put one after the other without going through their requests again.
    """

    def __init__(self, capacity: int, cost: int):
        self.capacity, self.cost = capacity, cost
        self.ranges = [(0, capacity, capacity, 0)]  # first level, last level, top, shift

    def request(self, refill: int) -> None:
        out = []
        for lo, hi, top, shift in self.ranges:
            top, shift = min(self.capacity, top + refill), shift + refill
            if min(top, lo + shift) >= self.cost:
                out.append((lo, hi, top - self.cost, shift - self.cost))
            elif min(top, hi + shift) < self.cost:
                out.append((lo, hi, top, shift))
            else:
                at = self.cost - shift
                out += [(lo, at - 1, top, shift), (at, hi, top - self.cost, shift - self.cost)]
        joined = out[:1]
        for r in out[1:]:
            lo, hi, top, shift = joined[-1]
            if shift == r[3] and (top == r[2] or hi + shift <= min(top, r[2])):  # the first top is out of reach, or the same
                joined[-1] = (lo, r[1], r[2], shift)
            elif top == r[2] and lo + shift >= top and r[0] + r[3] >= top:  # both are full in any case
                joined[-1] = (lo, r[1], top, max(shift, r[3], top - lo))
            else:
                joined.append(r)
        self.ranges = joined

    def after(self, level: int) -> int:
        return next(min(top, level + shift) for lo, hi, top, shift in self.ranges if lo <= level <= hi)


def _bucket(rows: DataFrame, units: tuple[int, int, int]) -> DataFrame:
    """rows (_k, _us, _ok, in order within its partitions, which ranges of keys and times make) with _ok as one bucket leaves it; rows that aren't _ok ask for nothing.

    First each partition tells the effect of its first key's run on a bucket of any level, and the level that its last key ends with: one
    row. The driver goes through these rows, one a partition, and every partition then knows the level that it begins with.
    """
    refill, capacity, cost = units
    first, last = "first_key long, first_us long, ranges array<array<long>>, ended_us long", "last_key long, last_us long, level long"

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        effect, begun, ended, at, key, level, alone = Effect(capacity, cost), None, None, None, None, 0, True
        for b in batches:
            for k, us, ok in zip(b.column("_k").to_pylist(), b.column("_us").to_pylist(), b.column("_ok").to_pylist(), strict=True):
                if not ok:
                    continue
                if begun is None:
                    begun, key, at = (k, us), k, us
                if alone and k == key:
                    effect.request(max(us - at, 0) * refill)
                    ended = at = us
                    continue
                alone = False
                level = capacity if k != key else min(capacity, level + max(us - at, 0) * refill)
                key, at = k, us
                level -= cost * (level >= cost)
        if begun is not None:
            row = {"part": TaskContext.get().partitionId(), "first_key": begun[0], "first_us": begun[1], "ranges": [list(r) for r in effect.ranges], "ended_us": ended}
            yield pa.RecordBatch.from_pylist([row | {"last_key": None if alone else key, "last_us": None if alone else at, "level": None if alone else level}], schema=pa.schema([("part", pa.int64()), ("first_key", pa.int64()), ("first_us", pa.int64()), ("ranges", pa.list_(pa.list_(pa.int64()))), ("ended_us", pa.int64()), ("last_key", pa.int64()), ("last_us", pa.int64()), ("level", pa.int64())]))

    begins, carried = {}, None
    for r in sorted(rows.select("_k", "_us", "_ok").mapInArrow(told, f"part long, {first}, {last}").collect(), key=lambda r: r["part"]):
        level = capacity
        if carried is not None and carried[0] == r["first_key"]:
            level = min(capacity, carried[1] + max(r["first_us"] - carried[2], 0) * refill)
        begins[r["part"]] = level
        effect = Effect(capacity, cost)
        effect.ranges = [tuple(x) for x in r["ranges"]]
        carried = (r["first_key"], effect.after(level), r["ended_us"]) if r["last_key"] is None else (r["last_key"], r["level"], r["last_us"])

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, level, begun = None, 0, 0, False
        for b in batches:
            out = []
            for k, us, ok in zip(b.column("_k").to_pylist(), b.column("_us").to_pylist(), b.column("_ok").to_pylist(), strict=True):
                if not ok:
                    out.append(False)
                    continue
                if not begun:
                    level, begun = begins[TaskContext.get().partitionId()], True
                elif k != key:
                    level = capacity
                else:
                    level = min(capacity, level + max(us - at, 0) * refill)
                key, at = k, us
                out.append(level >= cost)
                level -= cost * out[-1]
            yield b.set_column(b.schema.get_field_index("_ok"), pa.field("_ok", pa.bool_()), pa.array(out, pa.bool_()))

    return rows.mapInArrow(settled, rows.schema)


def multi_bucket(requests: DataFrame, key: str, time: str, order: str, levels: list[tuple[float, float]], cost: float = 1.0) -> DataFrame:
    """requests with `allowed`: every level's bucket (rate, capacity) must pass, in order; those before the one that refuses keep their spend.

    A level only sees what those before it let through, so each is a token bucket of its own. Requests are dealt out by ranges of key
    and time, so that a key of any number of requests is spread over tasks (see _bucket). Times count in microseconds, and
    so do levels, exactly. Null keys are one key; requests at the same time go by `order`; one without a time comes first.
    """
    rows = requests.withColumn("_k", F.xxhash64(key)).withColumn("_us", F.coalesce(F.unix_micros(F.col(time).cast("timestamp")), F.lit(0))).withColumn("_ok", F.lit(True))
    rows = graph.pinned(rows.repartitionByRange("_k", "_us", order).sortWithinPartitions("_k", "_us", order))
    for rate, capacity in levels:
        rows = graph.pinned(_bucket(rows, _units(rate, capacity, cost)))
    return rows.withColumn("allowed", F.col("_ok")).drop("_k", "_us", "_ok")


def token_bucket(requests: DataFrame, key: str, time: str, order: str, rate: float, capacity: float, cost: float = 1.0) -> DataFrame:
    """requests with `allowed`: each key's bucket refills at `rate` a second up to `capacity`, with which it begins; a request takes `cost` if it is there. As multi_bucket with one level."""
    return multi_bucket(requests, key, time, order, [(rate, capacity)], cost)


def detection_rate(events: DataFrame, detected: Column) -> DataFrame:
    """One row: the share of events that were detected, in percent; none: 0."""
    return events.agg(F.coalesce(F.avg(F.when(detected, 1.0).otherwise(0.0)) * 100, F.lit(0.0)).alias("anomaly_detection_rate"))


def proxy_weight(quality: Column, success: Column, latency: Column) -> Column:
    return 0.4 * quality + 0.4 * success + 0.2 / (1 + latency)


def proxy_stats(proxies: DataFrame) -> DataFrame:
    """One row over (is_healthy, quality_score, success_rate, country): counts, means and the countries, sorted."""
    return proxies.agg(F.count("*").alias("total"), F.count_if("is_healthy").alias("healthy"), F.count_if(~F.col("is_healthy")).alias("unhealthy"), F.coalesce(F.avg("quality_score"), F.lit(0.0)).alias("avg_quality"), F.coalesce(F.avg("success_rate"), F.lit(0.0)).alias("avg_success_rate"), F.sort_array(F.collect_set(F.nullif("country", F.lit("")))).alias("countries"))


class Registry:
    """Named one-row metrics: each is a function that gives a DataFrame with the column value."""

    def __init__(self):
        self.collectors: dict[str, tuple] = {}

    def register(self, name: str, collector, description: str = "", unit: str = "") -> None:
        """Replaces a metric of the same name."""
        self.collectors[name] = (collector, description, unit)

    def collect(self) -> DataFrame:
        """name, value, description and unit of all metrics, in the order of names."""
        rows = [c().select(F.lit(n).alias("name"), F.col("value").cast("double").alias("value"), F.lit(d).alias("description"), F.lit(u).alias("unit")) for n, (c, d, u) in sorted(self.collectors.items())]
        if not rows:
            raise ValueError("no metric is registered")
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out

    def export_prometheus(self) -> str:
        """The text exposition of all metrics, one row each."""
        return "\n".join(r["line"] for r in self.collect().orderBy("name").select(prometheus(F.col("name"), F.col("value"), F.col("description")).alias("line")).collect()) + "\n"

    def export_json(self) -> str:
        """All metrics as a JSON list, one row each."""
        return "[" + ",".join(r["j"] for r in self.collect().orderBy("name").select(F.to_json(F.struct("*")).alias("j")).collect()) + "]"


#: Runs of rows over 40 of each user that last an hour or longer.
ALERT_SQL = "SELECT user_id, start, min(t) FILTER (epoch_us(t) - epoch_us(start) >= 3600000000) AS fired_at, max(t) AS \"end\" FROM (SELECT user_id, g, posted_at AS t, min(posted_at) OVER (PARTITION BY user_id, g) AS start FROM (SELECT *, sum(CASE WHEN value > 40 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY posted_at ROWS UNBOUNDED PRECEDING) AS g FROM activity) WHERE value > 40) GROUP BY user_id, g, start HAVING count(*) FILTER (epoch_us(t) - epoch_us(start) >= 3600000000) > 0"


def _bucket_sql(levels: list[tuple[int, int]], key: str = "user_id") -> str:
    """Request after request of each key by recursion; levels are (cost, capacity) in microseconds of refill."""
    n = range(len(levels))
    pays = [" AND ".join(f"y{j} >= {levels[j][0]}" for j in range(i + 1)) for i in n]
    refilled = ", ".join(f"least({levels[i][1]}, s.l{i} + r.us - s.us) AS y{i}" for i in n)
    spent = ", ".join(f"y{i} - CASE WHEN {pays[i]} THEN {levels[i][0]} ELSE 0 END AS l{i}" for i in n)
    full = ", ".join(f"CAST({c - x} AS BIGINT) AS l{i}" for i, (x, c) in enumerate(levels))
    return f"""SELECT event_id, allowed FROM (WITH RECURSIVE r AS (SELECT event_id, {key} AS k, epoch_us(posted_at) AS us, row_number() OVER (PARTITION BY {key} ORDER BY posted_at, event_id) AS n FROM activity),
 s AS (SELECT event_id, k, us, n, {full}, TRUE AS allowed FROM r WHERE n = 1
 UNION ALL SELECT event_id, k, us, n, {spent}, {pays[-1]} AS allowed FROM (SELECT r.*, {refilled} FROM s JOIN r ON r.k = s.k AND r.n = s.n + 1)) SELECT * FROM s)"""


def register(add, r6) -> None:
    act = A.activity
    add("alert_islands", lambda s, d: alerts(act(s, d), ["user_id"], "posted_at", "value", ">", 40.0, 3600.0), ALERT_SQL, A.ACTIVITY)
    add("window_metrics", lambda s, d: r6(window_metrics(act(s, d), "posted_at", F.col("platform") != "error", F.col("value") / 100, "user_id", 3600)), "SELECT time_bucket(INTERVAL 1 HOUR, posted_at) AS start, round(avg(CASE WHEN platform <> 'error' THEN 1.0 ELSE 0 END) * 100, 6) AS success_rate, round(coalesce(avg(value / 100) FILTER (value > 0) * 1000, 0), 6) AS latency_ms, round(count(*) / 60, 6) AS per_minute, count(DISTINCT user_id) AS active_users FROM activity GROUP BY 1", A.ACTIVITY)
    add("metric_history", lambda s, d: last_of_each(act(s, d), "platform", "posted_at", 50, "event_id").select("event_id", "platform"), "SELECT event_id, platform FROM (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY posted_at DESC, event_id DESC) AS n FROM activity) WHERE n <= 50", A.ACTIVITY)
    add("health_status", lambda s, d: health(A.posts(s, d).withColumn("status", F.when(F.col("likes_count") == 0, "unhealthy").when(F.col("likes_count") < 9, "degraded").otherwise("healthy")), ["user_id"]), "SELECT user_id, CASE WHEN min(likes_count) = 0 THEN 'unhealthy' WHEN min(likes_count) < 9 THEN 'degraded' ELSE 'healthy' END AS health FROM posts GROUP BY 1", A.POSTS)
    add("prometheus_lines", lambda s, d: A.table(s, d, "nation").select(prometheus(F.lower("n_name"), F.col("n_nationkey"), F.lit("key")).alias("line")), "SELECT '# HELP ' || lower(n_name) || ' key' || chr(10) || lower(n_name) || ' ' || n_nationkey AS line FROM nation")
    add("token_bucket", lambda s, d: token_bucket(act(s, d), "user_id", "posted_at", "event_id", 1 / 7200, 2.0).select("event_id", "allowed"), _bucket_sql([(7_200_000_000, 14_400_000_000)]), A.ACTIVITY)
    add("multi_bucket_refill", lambda s, d: multi_bucket(act(s, d), "platform", "posted_at", "event_id", [(1 / 600, 3.0), (1 / 1800, 9.0)]).select("event_id", "allowed"), _bucket_sql([(600_000_000, 1_800_000_000), (1_800_000_000, 16_200_000_000)], "platform"), A.ACTIVITY)
