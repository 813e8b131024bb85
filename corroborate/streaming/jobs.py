"""Structured Streaming jobs over the batch operators.

Pages become an append-only envelope log: parsing is stateless, a value state
per message drops unchanged posts, and the file sink makes the log exactly
once. The stored posts are that log folded by the batch operator, on whatever
schedule suits; nothing is rewritten per micro-batch. Nothing is dropped for
being late, because an edit may arrive at any time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from corroborate.config import LIMITS
from corroborate.functions.timefn import day_key
from corroborate.operators.posts import normalize_posts, upsert_raw_posts
from corroborate.operators.quota import admit_calls
from corroborate.schemas import PAGES
from corroborate.session import cut_lineage
from corroborate.sources.pages import cap_pages, page_warnings, parse_pages, to_envelopes
from corroborate.sources.store import PostStore

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def page_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Landed pages as a stream."""
    reader = spark.readStream.schema(PAGES)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return cap_pages(reader.parquet(path))


class Fingerprints(StatefulProcessor):
    """Remembers the last fingerprint of a message; lets changed posts through."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("hash", StructType([StructField("hash", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("seq", kind="stable")
        last = self.last.get()[0] if self.last.exists() else None
        before = frame["content_hash"].shift(1)
        before.iloc[0] = last
        changed = frame[frame["content_hash"] != before]
        self.last.update((frame["content_hash"].iloc[-1],))
        yield changed

    def close(self) -> None:
        pass


def changed_stream(posts: DataFrame) -> DataFrame:
    """Posts whose fingerprint differs from the last one seen.

    State is one hash per message, kept in RocksDB and spread over all
    messages; a message polled many times in one micro-batch is one small
    group. ``seq`` orders the posts of a message.
    """
    posts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return posts.groupBy("source_id", "message_id").transformWithStateInPandas(
        statefulProcessor=Fingerprints(), outputStructType=posts.schema, outputMode="Append", timeMode="None"
    )


def changed_log(posts: DataFrame) -> DataFrame:
    """The batch form of :func:`changed_stream`, over a whole log."""
    from corroborate.operators.blocks import id_block, previous_value

    paired = previous_value(
        posts, ["source_id", "message_id"], ["seq"], id_block(F.col("seq")), F.col("content_hash"), "_before"
    )
    return paired.filter(~F.col("content_hash").eqNullSafe(F.col("_before"))).drop("_before")


def dedupe_stream(posts: DataFrame, delay: str) -> DataFrame:
    """At-least-once duplicates with the same key and fingerprint, within ``delay``."""
    return posts.withWatermark("observed_at", delay).dropDuplicatesWithinWatermark(
        ["source_id", "message_id", "content_hash"]
    )


def _write(df: DataFrame, path: str, checkpoint: str, once: bool, partition_by: str | None = None) -> StreamingQuery:
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")
    return writer.start(path)


def ingest_stream(pages: DataFrame, sources: DataFrame, out: str, once: bool = False) -> list[StreamingQuery]:
    """Pages to the envelope log (by day) and the quarantine.

    ``out`` must be a shared folder; it also holds the checkpoints.
    """
    posts = parse_pages(pages).withColumn("seq", F.unix_micros("observed_at"))
    envelopes = to_envelopes(changed_stream(posts), sources).withColumn("day", day_key(F.col("observed_at")))
    return [
        _write(envelopes, f"{out}/envelopes", f"{out}/_checkpoints/envelopes", once, "day"),
        _write(page_warnings(pages).drop("html"), f"{out}/quarantine", f"{out}/_checkpoints/quarantine", once),
    ]


def fold_log(snapshot: DataFrame, envelopes: DataFrame) -> DataFrame:
    """Stored posts after the envelopes of a log; run it over the new days only."""
    return normalize_posts(upsert_raw_posts(snapshot, envelopes))


def per_batch(stream: DataFrame, job: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Run a batch job for every micro-batch. Jobs write to a folder named by
    the batch id, so a repeated batch overwrites its own output only."""
    writer = stream.writeStream.foreachBatch(job).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def store_stream(pages: DataFrame, sources: DataFrame, store: PostStore, out: str, once: bool = False) -> StreamingQuery:
    """Every micro-batch of pages merged into the stored posts; pages that are none go to the quarantine.

    A micro-batch is one version of the store, and reads and writes only the
    buckets of its own messages. A batch that broke off is run again by the
    stream and starts from the version before it.
    """
    sources = cut_lineage(sources)  # every batch needs them

    def ingest(rows: DataFrame, batch_id: int) -> None:
        posts = parse_pages(rows).withColumn("seq", F.unix_micros("observed_at"))
        store.merge(to_envelopes(posts, sources), batch_id + 1, changed_only=True)
        page_warnings(rows).drop("html").write.mode("overwrite").parquet(f"{out}/quarantine/batch_id={batch_id}")

    return per_batch(pages, ingest, f"{out}/_checkpoints/store", once)


def counter_stream(log: DataFrame, out: str, once: bool = False) -> StreamingQuery:
    """Counter deltas per micro-batch; readers add them up."""

    def deltas(rows: DataFrame, batch_id: int) -> None:
        day = day_key(F.col("ts")).alias("counter_date")
        sums = rows.groupBy(day, "metric").agg(F.sum("amount").alias("value"))
        sums.write.mode("overwrite").parquet(f"{out}/deltas/batch_id={batch_id}")

    return per_batch(log, deltas, f"{out}/_checkpoints/counters", once)


def read_counters(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/deltas").groupBy("counter_date", "metric").agg(F.sum("value").alias("value"))


def admission_stream(calls: DataFrame, caps: Column, out: str, once: bool = False) -> StreamingQuery:
    """Daily caps on a stream of calls, in arrival order of micro-batches.

    What earlier batches admitted is a small table of (day, stage) counts,
    stored by day: a batch reads the days of its own calls only, so its cost
    does not grow with the run. Positions inside the batch come from the blocked batch operator, so a busy
    stage is not one task's work.
    """

    def admit(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        used = spark.createDataFrame([], "day string, stage string, n bigint, batch_id int")
        if batch_id > 0:
            days = [r["day"] for r in rows.select("day").distinct().collect()]  # a micro-batch spans few days
            used = spark.read.schema(used.schema).parquet(f"{out}/usage")
            used = used.filter(F.col("day").isin(days) & (F.col("batch_id") < batch_id))
        before = used.groupBy("day", "stage").agg(F.sum("n").alias("_used"))
        rest = rows.withColumn("_cap", caps).join(before, ["day", "stage"], "left")
        left = F.greatest(F.lit(0), F.col("_cap") - F.coalesce("_used", F.lit(0)))
        decided = admit_calls(rest.withColumn("_left", left), F.col("_left")).drop("_cap", "_used", "_left", "position")
        decided.write.mode("overwrite").parquet(f"{out}/calls/batch_id={batch_id}")
        stored = spark.read.parquet(f"{out}/calls/batch_id={batch_id}")
        counts = stored.filter("admitted").groupBy("day", "stage").agg(F.count("*").alias("n"))
        counts.write.mode("overwrite").partitionBy("day").parquet(f"{out}/usage/batch_id={batch_id}")

    return per_batch(calls, admit, f"{out}/_checkpoints/admissions", once)


class Leases(StatefulProcessor):
    """Remembers when a post was leased, and lets it back when the lease has run out."""

    def __init__(self, minutes: int):
        self.width = minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", StructType([StructField("millis", LongType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = None
        for row in rows:  # of equal instants the later row counts
            if last is None or row["at"] >= last["at"]:
                last = row
        if self.lease.exists():  # a timer stands only beside a lease
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.lease.clear()
        if last["kind"] == "lease":
            self.lease.update((last["millis"],))
            self.handle.registerTimer(last["millis"] + self.width)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.lease.exists():
            self.lease.clear()
            yield Row(post_id=key[0], expired_at=expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def requeue_stream(events: DataFrame, minutes: int = LIMITS.stale_minutes, delay: str = "0 seconds") -> DataFrame:
    """Posts whose lease ran out, once the event time has passed its end.

    ``events`` has post_id, ts, kind (``lease`` or anything that ends one) and
    leased_at. State is one instant for each leased post, cleared when the
    lease ends either way. A lease without an instant has run out already.
    Posts have a row or two each, so rows are handled as they are: a data frame
    for each post would cost more than its state.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    millis = F.coalesce(F.unix_millis("leased_at"), F.lit(0)).alias("millis")
    rows = events.withWatermark("ts", delay).select("post_id", "ts", F.unix_micros("ts").alias("at"), "kind", millis)
    return rows.groupBy("post_id").transformWithState(
        statefulProcessor=Leases(minutes), outputStructType="post_id bigint, expired_at bigint", outputMode="Append", timeMode="EventTime"
    )


def rate_stream(log: DataFrame, out: str, delay_minutes: int, once: bool = False) -> StreamingQuery:
    """Publications per five-minute window, with the rows that come behind the watermark kept apart.

    The watermark of a micro-batch is the latest ``ts`` of all batches before
    it less the delay. Spark's own drops what is behind it; here nothing may be dropped, so a batch
    writes what it adds to each window, and says of which rows the window was
    closed. Windows need no state: what a batch adds is a few rows, and a
    repeated batch replaces its own.
    """

    def add(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        seen = spark.createDataFrame([], "latest timestamp, batch_id int")
        if batch_id > 0:
            seen = spark.read.schema(seen.schema).parquet(f"{out}/seen").filter(F.col("batch_id") < batch_id)
        latest = seen.agg(F.max("latest")).first()[0]
        mark = F.lit(latest).cast("timestamp") - F.make_dt_interval(mins=F.lit(delay_minutes))
        window = F.window("ts", f"{LIMITS.window_minutes} minutes")
        late = F.coalesce(F.col("window_end") <= mark, F.lit(False))
        placed = rows.select(window.start.alias("window_start"), window.end.alias("window_end")).withColumn("late", late)
        counts = placed.groupBy("window_start", "late").agg(F.count("*").alias("n"))
        counts.write.mode("overwrite").parquet(f"{out}/counts/batch_id={batch_id}")
        rows.agg(F.max("ts").alias("latest")).write.mode("overwrite").parquet(f"{out}/seen/batch_id={batch_id}")

    return per_batch(log, add, f"{out}/_checkpoints/rates", once)


def read_rates(spark: SparkSession, out: str) -> DataFrame:
    """Publications of each window so far, and how many of them came after it was closed."""
    counts = spark.read.parquet(f"{out}/counts").groupBy("window_start")
    return counts.agg(F.sum("n").alias("publications"), F.sum(F.when(F.col("late"), F.col("n")).otherwise(0)).alias("late"))
