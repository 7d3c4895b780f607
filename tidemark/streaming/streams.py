"""Running counts, last quotes and daily snapshots as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import snapshots

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, path: str, files_at_once: int = 1) -> DataFrame:
    """A stream of event files, from a folder or of one file. Event time has to be a TIMESTAMP, so local times are read as UTC (the
    session's zone)."""
    reader = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(p) and fs.getFileStatus(p).isFile():  # a stream watches folders
        reader, path = reader.option("pathGlobFilter", p.getName()), p.getParent().toString()
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counts(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts by day and kind; a day is final (append mode) once the watermark has passed it."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.to_date("window.start").alias("d"), "event_type", "n")


def user_sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    s = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


#: Parts of a snapshot that `keep_last` keeps; a batch rewrites those that its keys fall into.
PARTS = 64


def keep_last(stream: DataFrame, path: str, keys: list[str], order: str, checkpoint: str, trigger: dict | None = None, parts: int = PARTS, mode: str = "append") -> StreamingQuery:
    """Keeps in the snapshot `path` the last row of each key, by `order`; of equal ones the largest by the other columns, in their order,
    and a null order is the least. A replayed batch changes nothing, and a crash leaves the snapshot of the batch before. Keys are
    dealt over `parts` parts, of which a batch reads and writes those it has keys for. One query a checkpoint guards overlap."""

    def batch(df: DataFrame, _: int) -> None:
        df = df.withColumn("part__", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
        touched = [f"part__={r[0]}" for r in df.select("part__").distinct().collect()]  # at most `parts`

        def step() -> None:
            base, rows = snapshots.newest(df.sparkSession, path)[1], df
            old = snapshots.current(df.sparkSession, path, parts=touched, base=base)
            if old is not None:
                rows = rows.unionByName(old.withColumn("part__", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")))
            others = [order, *[c for c in rows.columns if c not in (*keys, order, "part__")]]
            last = rows.groupBy("part__", *keys).agg(F.max(F.struct(*others)).alias("r"))
            snapshots.replace(last.select("part__", *keys, *[F.col(f"r.{c}").alias(c) for c in others]), path, by="part__", base=base)

        if touched:
            snapshots.retried(step)

    return stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def late_aside(stream: DataFrame, path: str, checkpoint: str, delay: str = "1 day", trigger: dict | None = None) -> StreamingQuery:
    """Parts a stream in two tables of files below `path`: `late` has the rows whose day had ended `delay` before the newest row of the
    batches before, `kept` the others. Counts by day over `kept` with a watermark of that delay drop nothing, since their watermark never is
    ahead of this one: each row is either in a day's count or in `late`.

    A batch writes its folders once; a replayed one finds them there. What it needs from those before is one row, the newest time."""

    def batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        before = spark.read.schema("newest timestamp").parquet(f"{path}/newest/batch={n - 1}").first()[0] if n else None
        ends = F.date_trunc("day", "ts") + F.expr("INTERVAL 1 DAY")
        late = ends <= F.lit(before) - F.expr(f"INTERVAL {delay}") if before else F.lit(False)
        for name, rows in (("kept", df.where(~late | F.col("ts").isNull())), ("late", df.where(late))):
            if not _there(spark, f"{path}/{name}/batch={n}/_SUCCESS"):
                rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={n}")
        if not _there(spark, f"{path}/newest/batch={n}/_SUCCESS"):
            newest = df.agg(F.greatest(F.max("ts"), F.lit(before).cast("timestamp")).alias("newest"))
            newest.write.mode("overwrite").parquet(f"{path}/newest/batch={n}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def appended(rows: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Rows that are final, as files, each once."""
    return rows.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def first_of_day(stream: DataFrame, day: str = "d", late: str = "1 day") -> DataFrame:
    """The first row of each day wins; later ones are dropped, by the state as long as it is kept and as late rows after that."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([day])


LAST = "user_id long, event_id long, event_type string, value double, expired boolean"
_STORE = "spark.sql.streaming.stateStore.providerClass"


class LastOrExpired(StatefulProcessor):
    """Keeps the last event of a user, by event_id, and forgets a user who has been silent for `silent` milliseconds of event time."""

    def __init__(self, silent: int):
        self.silent = silent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "event_id long, event_type string, value double, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get() if self.last.exists() else None
        until = was = last[3] if last else 0
        for batch in rows:
            until = max(until, int(batch["ms"].max()) + self.silent)
            top = batch.loc[batch["event_id"].idxmax()]
            if last is None or top["event_id"] > last[0]:
                last = (int(top["event_id"]), top["event_type"], None if pd.isna(top["value"]) else float(top["value"]), until)
        if until != was:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(until)
        self.last.update((*last[:3], until))
        yield self._row(key, last, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()
        self.last.clear()
        yield self._row(key, last, True)

    @staticmethod
    def _row(key, last, expired: bool) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *last[:3], expired)], columns=[c.split()[0] for c in LAST.split(", ")])

    def close(self) -> None:
        pass


def last_with_state(stream: DataFrame, path: str, checkpoint: str, silent: str = "7 days", late: str = "1 day", trigger: dict | None = None) -> StreamingQuery:
    """The last event of each user as keyed state: a batch touches the users it has, and no snapshot is rewritten. Below `path` a row for each
    user whenever the last event changes, and one with `expired` when the state is forgotten; state is bounded by the users seen within
    `silent`. Rows without a user, a time or an id have no place in it and are left out."""
    spark = stream.sparkSession
    ms = int(spark.sql(f"SELECT unix_millis(timestamp'1970-01-01 00:00:00Z' + INTERVAL {silent})").first()[0])
    rows = stream.where("user_id IS NOT NULL AND ts IS NOT NULL AND event_id IS NOT NULL").withWatermark("ts", late)
    rows = rows.select("user_id", "ts", "event_id", "event_type", "value", F.unix_millis("ts").alias("ms"))
    out = rows.groupBy("user_id").transformWithStateInPandas(LastOrExpired(ms), LAST, "Append", "EventTime")
    had = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # which keyed state needs
    try:
        return appended(out, path, checkpoint, trigger)
    finally:
        spark.conf.unset(_STORE) if had is None else spark.conf.set(_STORE, had)


def last_known(spark: SparkSession, path: str) -> DataFrame:
    """From what `last_with_state` wrote: each user's last event, and whether it has expired since."""
    r = F.max_by(F.struct("event_type", "value", "expired"), F.struct("event_id", "expired")).alias("r")
    return spark.read.schema(LAST).parquet(path).groupBy("user_id").agg(F.max("event_id").alias("event_id"), r).select("user_id", "event_id", "r.event_type", "r.value", "r.expired")
