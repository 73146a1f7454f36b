"""Structured Streaming forms of the message queue and the live metrics."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: The envelope of a queue message.
MESSAGE = "id string, topic string, payload string, timestamp timestamp, headers map<string, string>, priority string, status string, retry_count int, message_type string, correlation_id string, source string"


def envelope(rows: DataFrame, topic: str, message_type: str, key: str, priority: str = "normal") -> DataFrame:
    """key and value (JSON) of one message a row, ready for a Kafka or file sink."""
    body = F.struct(F.sha2(F.to_json(F.struct(*rows.columns)), 256).alias("id"), F.lit(topic).alias("topic"), F.to_json(F.struct(*rows.columns)).alias("payload"), F.lit(priority).alias("priority"), F.lit("pending").alias("status"), F.lit(0).alias("retry_count"), F.lit(message_type).alias("message_type"), F.col(key).cast("string").alias("correlation_id"))
    return rows.select(F.col(key).cast("string").alias("key"), F.to_json(body).alias("value"))


def messages(raw: DataFrame, column: str = "value") -> DataFrame:
    """Messages of JSON lines; what is no message is left out (see `rejected`)."""
    return raw.select(F.from_json(column, MESSAGE).alias("m")).where("m.id IS NOT NULL").select("m.*")


def rejected(raw: DataFrame, column: str = "value", most_retries: int = 3) -> DataFrame:
    """The dead letters: lines that are no message, and messages out of retries, with the reason."""
    m = F.from_json(column, MESSAGE)
    why = F.when(m["id"].isNull(), "not a message").when(m["retry_count"] > most_retries, "out of retries")
    return raw.select(F.col(column).alias("value"), why.alias("reason")).where("reason IS NOT NULL")


def subscribe(spark: SparkSession, path: str, files_a_batch: int = 10) -> DataFrame:
    """A stream of the lines of files that land in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(path)


def subscribe_kafka(spark: SparkSession, servers: str, topic: str, offsets_a_batch: int = 10_000) -> DataFrame:
    """The same from a Kafka topic, from its beginning; needs Spark's Kafka package on the class path."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "maxOffsetsPerTrigger": str(offsets_a_batch)}
    return spark.readStream.format("kafka").options(**options).load().select(F.col("value").cast("string"))


def publish(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return rows.select("value").writeStream.format("text").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def first_seen(stream: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """Drops repeats of a key that come within the delay; the state is bounded by it."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, time: str, by: list[str], width: str = "5 minutes", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts and distinct users (approximate) of each window; late rows beyond the delay are left out."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, delay).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users")).select(F.col("w.start").alias("start"), *by, "n", "users")


def sessions(stream: DataFrame, time: str, user: str, gap: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Per user the sessions that end with a gap."""
    s = stream.withWatermark(time, delay).groupBy(user, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def consume(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, dead_letters: str, retries: int = 3) -> StreamingQuery:
    """At-least-once handling of micro-batches: a batch that fails `retries` + 1 times is written to dead_letters and passed over. handle must be idempotent by batch id."""

    def run(batch: DataFrame, batch_id: int) -> None:
        for attempt in range(retries + 1):
            try:
                return handle(batch, batch_id)
            except Exception as error:  # any failure of the caller's code counts
                last = error
                if attempt == retries:
                    batch.withColumn("error", F.lit(str(last)[:500])).write.mode("overwrite").json(f"{dead_letters}/batch={batch_id}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
