"""Live operators: per-second decisions, K-of-N alarms, false-alarm budgets, sessions, dedup, side inputs, campaign labels.

Inputs are streaming score tables (sensor, channel, ts, score, …). The same functions accept batch frames where Spark
allows it. State is kept per sensor and is a few numbers; rows reach it after the per-second aggregation, so a busy
sensor costs one row per second and channel.
"""
from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def decisions_per_second(scores: DataFrame, keys: list[str], ts: str, score: str, threshold: float, delay: str = "10 seconds", every: str = "1 second") -> DataFrame:
    """One row per (keys, second): mean and peak score, number of tiles, and the decision ``mean > threshold``."""
    g = scores.withWatermark(ts, delay).groupBy(F.window(ts, every).alias("w"), *keys)
    return (g.agg(F.avg(score).alias("mean_score"), F.max(score).alias("peak_score"), F.count("*").alias("tiles"))
            .select(*keys, F.col("w.start").alias("second"), F.col("w.end").alias("second_end"), "mean_score", "peak_score", "tiles", (F.col("mean_score") > threshold).alias("flagged")))


class KOfNAlarm(StatefulProcessor):
    """Alarms of one key. State is one row: the flags up to the watermark that wait for their turn, the last n flags that had
    it, whether the alarm was on, and the timer that is set.

    A row waits until the watermark has passed it, so rows come in event-time order whatever the micro-batches were. The key's
    next rows release those that are due; the timer waits for the first pending row or, if none is left, for the end of the
    idle time, when the state goes. So a key with rows in a micro-batch has one turn in it, and a silent one has its timer's.
    """

    def __init__(self, k: int, n: int, idle: int | None, tie_type: str):
        self.k, self.n, self.idle, self.tie_type = k, n, idle, tie_type         # idle in microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", f"at array<long>, ties array<{self.tie_type}>, flags array<int>, recent array<int>, active boolean, last long, timer long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r.alarm_at, r.alarm_tie, r.alarm_flag) for r in rows]
        return self._turn(key, self.memory.get(), new, 1000 * timerValues.getCurrentWatermarkInMs(), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self.memory.get()
        return iter(()) if known is None else self._turn(key, known, [], 1000 * timerValues.getCurrentWatermarkInMs(), True)

    def _turn(self, key, known: tuple | None, new: list, mark: int, expired: bool) -> Iterator[Row]:
        """Take in the new rows and let go of those that the watermark has passed. Spark hands over all rows of a key and
        micro-batch at once and drops what is not after the watermark before, so nothing can follow that belongs earlier."""
        at, ties, flags, recent, active, last, timer = known or ([], [], [], [], False, None, None)
        rows, recent, starts = sorted([*zip(at, ties, flags), *new], key=lambda r: r[0]), list(recent), []
        n_due = bisect_right(rows, mark, key=lambda r: r[0])
        for moment, tie, flag in sorted(rows[:n_due], key=lambda r: r[:2]):
            if self.idle is not None and last is not None and moment - last > self.idle:
                recent, active = [], False
            recent, last = (recent + [int(flag)])[-self.n:], int(moment)
            now = sum(recent) >= self.k
            if now and not active:
                starts.append(Row(alarm_key=key[0], alarm_at=last, alarm_tie=tie))
            active = now
        self._wait(rows[n_due:], recent, active, last, None if expired else timer, mark)
        return iter(starts)

    def _wait(self, left: list, recent: list, active: bool, last: int | None, timer: int | None, mark: int) -> None:
        over = not left and (last is None or self.idle is not None and last + self.idle < mark)
        wanted = None if over else left[0][0] if left else None if self.idle is None else last + self.idle + 1
        wanted = None if wanted is None else -(-int(wanted) // 1000)
        if wanted != timer:                                         # every call goes to the JVM and back
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        if over:
            self.memory.clear()
        else:
            self.memory.update(([int(r[0]) for r in left], [r[1] for r in left], [int(r[2]) for r in left], recent, bool(active), last, wanted))

    def close(self) -> None:
        pass


def alarm_onsets(flags: DataFrame, key: str, ts: str, tie: str, flag: str, k: int = 2, n: int = 3, delay: str = "10 seconds", idle_seconds: float | None = None) -> DataFrame:
    """(key, ts, tie): rows at which a K-of-N alarm starts, the same ones however the stream is cut into micro-batches.

    Rows are taken in order of (ts, tie) once the watermark, ``delay`` behind the latest row of the stream, has passed them; rows
    that come later than that are dropped by Spark, and the last ``delay`` of a stream waits for more. A key that is silent
    for more than ``idle_seconds`` begins anew, and its state is freed; without, it is kept. A null flag counts as no; rows
    without ts are left out. State per key is one row, with one entry per row of the last ``delay``: feed it
    decisions_per_second, and a busy sensor has one a second. Start the query with run_to_table, or with the RocksDB state store set.
    """
    kinds = {f.name: f.dataType for f in flags.schema}
    rows = (flags.where(F.col(ts).isNotNull()).withWatermark(ts, delay)
            .select(F.col(key).alias("alarm_key"), F.col(ts).alias("alarm_time"), F.unix_micros(F.col(ts).cast("timestamp")).alias("alarm_at"), F.col(tie).alias("alarm_tie"), F.coalesce(F.col(flag).cast("int"), F.lit(0)).alias("alarm_flag")))
    out = T.StructType([T.StructField("alarm_key", kinds[key]), T.StructField("alarm_at", T.LongType()), T.StructField("alarm_tie", kinds[tie])])
    alarm = KOfNAlarm(k, n, None if idle_seconds is None else round(idle_seconds * 1e6), kinds[tie].simpleString())
    found = rows.groupBy("alarm_key").transformWithState(alarm, out, "append", "EventTime")
    return found.select(F.col("alarm_key").alias(key), F.timestamp_micros("alarm_at").cast(kinds[ts]).alias(ts), F.col("alarm_tie").alias(tie))


def onsets_per_hour(onsets: DataFrame, keys: list[str], ts: str, budget: float, delay: str = "10 minutes", length: str = "1 hour", slide: str = "5 minutes") -> DataFrame:
    """(keys, window, onsets, over_budget) in sliding windows; late rows beyond the watermark are dropped by Spark."""
    g = onsets.withWatermark(ts, delay).groupBy(F.window(ts, length, slide).alias("w"), *keys).agg(F.count("*").alias("onsets"))
    return g.select(*keys, F.col("w.start").alias("from_ts"), F.col("w.end").alias("to_ts"), "onsets", (F.col("onsets") > budget).alias("over_budget"))


def live_sessions(rows: DataFrame, keys: list[str], ts: str, pause: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Recording blocks on a live feed; a pause of exactly the limit keeps the block, a longer one ends it."""
    g = rows.withWatermark(ts, delay).groupBy(F.session_window(ts, pause).alias("w"), *keys)
    return g.agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")).select(*keys, "first_ts", "last_ts", "n")


def without_resends(artifacts: DataFrame, digest: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """Drop artifacts whose content was already seen within the watermark."""
    return artifacts.withWatermark(ts, delay).dropDuplicatesWithinWatermark([digest])


def over_site_floor(cells: DataFrame, site_floor: DataFrame, keys: list[str], power: str, factor: float) -> DataFrame:
    """Live cells against a slowly changing calibrated floor (keys, floor); the table is read anew per micro-batch."""
    return cells.join(site_floor, keys).where(F.col(power) > F.lit(factor) * F.col("floor"))


def campaign_labels(scores: DataFrame, segments: DataFrame, session: str, ts: str) -> DataFrame:
    """Scores with the block label of their own session. segments: (session, from_ts, to_ts, label), half-open."""
    s = segments.select(F.col(session).alias("_s"), "from_ts", "to_ts", F.col("label").alias("block_label"))
    inside = (F.col(session) == F.col("_s")) & (F.col(ts) >= F.col("from_ts")) & (F.col(ts) < F.col("to_ts"))
    return scores.join(s, inside).drop("_s", "from_ts", "to_ts")


def replay(spark: SparkSession, folder: str, file: str, schema: T.StructType, bytes_per_batch: int = 64 << 30, files_per_batch: int | None = None) -> DataFrame:
    """A stored table as a stream of files, oldest first. The trigger limits bound a micro-batch, and with it what one key can hold."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file)
    return (reader.option("maxFilesPerTrigger", str(files_per_batch)) if files_per_batch else reader.option("maxBytesPerTrigger", str(bytes_per_batch))).parquet(folder)


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process everything available now into a Parquet table and return it. Exactly once: the sink keeps a commit log.

    The query runs with the RocksDB state store, which timers need; the session's own setting is as before afterwards.
    """
    conf = stream.sparkSession.conf
    before = conf.get(STATE_STORE, None)
    conf.set(STATE_STORE, ROCKS_DB)
    try:                                                            # a query keeps the settings it was started with
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    finally:
        conf.set(STATE_STORE, before) if before else conf.unset(STATE_STORE)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
