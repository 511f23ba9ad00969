"""Job 2: a journal of the numbered messages of sessions, kept up to date from a growing folder.

    python -m jobs.session_journal MESSAGES OUT CHECKPOINT [--config FILE]

Sessions send numbered messages on topics; what was delivered twice, lost or sent under a number in use has to be
told. MESSAGES is a folder, or a pattern of files and folders. Here a session is a conversation, its messages are the turns, topics are roles and bodies are texts. A stream takes
the files that are new since the last run (``availableNow``), and ends.

Output, Parquet under OUT:

* ``records/batch=.../bucket=.../``: each delivered message once (session, sequence, topic, digest and length of the body);
* ``sessions/bucket=.../``: for each session its messages, numbers that are missing, messages under a number in use, topics.

The checkpoint holds the files that were taken and, in a RocksDB store, the digests of what was delivered, dealt by key over the
cluster. A batch overwrites the folder of its own number, so a batch that is repeated after a failure leaves the same
records. Sessions are derived from the records: buckets with records of a later batch than their sessions know are counted again,
reading the narrow columns of those buckets only, and replaced by dynamic partition overwrite; a run that was killed in between is made up for
by the next. Messages without a number are kept; they belong to no gap. Null sessions are one session, null topics one topic, a null body is
another body than an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pointloom.session import materialise
from pointloom.streaming import live

from .common import command_line, existing, log, read_config, settings

DEFAULTS = {"session": "conv_id", "sequence": "turn", "topic": "role", "body": "text", "buckets": 16, "files_per_bucket": 1, "files_per_batch": 64}
RECORD = "session_id long, sequence long, topic string, chars long, digest string, batch int, bucket int"
SESSION = "session_id long, messages long, first_sequence long, last_sequence long, missing long, conflicting long, topics long, chars_sent long, last_batch int, bucket int"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def records_of(messages: DataFrame, config: dict) -> DataFrame:
    """What the journal keeps of each message."""
    session, body = F.col(config["session"]).cast("long"), F.col(config["body"])
    return messages.select(session.alias("session_id"), F.col(config["sequence"]).cast("long").alias("sequence"), F.col(config["topic"]).alias("topic"),
        F.length(body).cast("long").alias("chars"), F.sha2(body.cast("binary"), 256).substr(1, 16).alias("digest"),
        F.pmod(F.xxhash64(session), F.lit(config["buckets"])).cast("int").alias("bucket"))


def run(spark: SparkSession, messages: str, out: str, checkpoint: str, config: dict | None = None) -> dict:
    """Take what is new, bring the sessions up to date; returns what was read and written."""
    config = DEFAULTS | (config or {})
    with settings(spark, **{"spark__sql__streaming__stateStore__providerClass": ROCKSDB, "spark__sql__sources__partitionOverwriteMode": "dynamic"}):
        schema = spark.read.parquet(messages).schema
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(messages)

        def put(batch: DataFrame, n: int) -> None:
            # a batch replaces all of its own folder, whichever buckets an earlier try had
            share = F.pmod(F.xxhash64("sequence", "digest"), F.lit(config["files_per_bucket"]))  # a long session is written by several tasks
            batch.repartition("bucket", share).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{out}/records/batch={n}")

        kept = live.delivered_once(records_of(stream, config), ["session_id", "sequence", "topic", "digest", "chars"])
        balance = live.Balance()
        spark.streams.addListener(balance)
        try:
            query = kept.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
            query.awaitTermination()
            found = balance.of(query)
        finally:
            spark.streams.removeListener(balance)
        log.info("%s: %d messages read in %d batches, %d kept, %d delivered again", messages, found["received"], found["batches"], found["written"], found["dropped"])
        sessions = summarise(spark, out)
    log.info("%s: %d records and %d sessions written", out, found["written"], sessions)
    return found | {"sessions": sessions}


def summarise(spark: SparkSession, out: str) -> int:
    """Count the sessions of buckets that have later records; returns how many sessions were written."""
    records, told = existing(spark, f"{out}/records", RECORD), existing(spark, f"{out}/sessions", SESSION)
    have = records.groupBy("bucket").agg(F.max("batch").alias("have"))
    known = told.groupBy("bucket").agg(F.max("last_batch").alias("known"))
    behind = [r.bucket for r in have.join(known, "bucket", "left").where("known is null or known < have").select("bucket").collect()]  # a number for each bucket
    if not behind:
        return 0
    own = records.where(F.col("bucket").isin(behind))
    sessions = own.groupBy("bucket", "session_id").agg(F.count(F.lit(1)).alias("messages"), F.min("sequence").alias("first_sequence"),
        F.max("sequence").alias("last_sequence"), F.countDistinct("sequence").alias("numbers"), F.count("sequence").alias("numbered"),
        F.countDistinct(F.coalesce("topic", F.lit(""))).alias("topics"), F.sum(F.coalesce("chars", F.lit(0))).alias("chars_sent"), F.max("batch").alias("last_batch"))
    missing = F.coalesce(F.col("last_sequence") - F.col("first_sequence") + 1 - F.col("numbers"), F.lit(0))
    sessions = sessions.select("session_id", "messages", "first_sequence", "last_sequence", missing.alias("missing"), (F.col("numbered") - F.col("numbers")).alias("conflicting"),
        "topics", "chars_sent", "last_batch", "bucket")
    sessions = materialise(sessions, "sessions")
    sessions.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/sessions")
    return sessions.count()


def output(spark: SparkSession, out: str) -> DataFrame:
    """Every record with the numbers of its session; folders and batches are left out, as they tell how it came, not what."""
    records = existing(spark, f"{out}/records", RECORD).drop("batch")
    sessions = existing(spark, f"{out}/sessions", SESSION).drop("last_batch").withColumnRenamed("session_id", "own")
    same = (records.bucket == sessions.bucket) & records.session_id.eqNullSafe(sessions.own)
    return records.join(sessions, same).drop("own", "bucket")


if __name__ == "__main__":
    command_line(__doc__.splitlines()[0], [("messages", "folder of messages"), ("out", "output folder"), ("checkpoint", "folder of the stream's checkpoint")],
        lambda spark, a: run(spark, a.messages, a.out, a.checkpoint, read_config(spark, a.config, DEFAULTS)))
