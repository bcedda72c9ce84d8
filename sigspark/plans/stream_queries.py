"""Registered streaming queries: a stored table is replayed as a file stream, processed to the end, and the sink's table
returned. The SQL gives the rows whose windows the final watermark has closed."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..streaming import alarms
from .tables import load, r6

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f
    return add


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a live feed; event time becomes an instant."""
    schema = load(spark, sf_dir, "events").schema
    return alarms.replay(spark, sf_dir, "events.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))


def drained(spark, stream: DataFrame, name: str) -> DataFrame:
    at = scratch_path(spark, name)
    out = alarms.run_to_table(stream, f"{at}/table", f"{at}/log")
    return out.select(*[F.col(f.name).cast("timestamp_ntz").alias(f.name) if f.dataType.simpleString() == "timestamp" else F.col(f.name) for f in out.schema])


def _mark(delay: str) -> str:
    return f"(SELECT date_trunc('millisecond', max(ts)) - INTERVAL {delay} FROM events)"


@register("stream_decisions", f"""SELECT event_type, s AS second, s + INTERVAL 10 MINUTE AS second_end, round(avg(value), 6) AS mean_score, max(value) AS peak_score, count(*) AS tiles, avg(value) > 25 AS flagged
FROM (SELECT event_type, value, time_bucket(INTERVAL 10 MINUTE, ts) AS s FROM events) WHERE s + INTERVAL 10 MINUTE <= {_mark('10 SECOND')} GROUP BY 1, 2""")
def stream_decisions(spark, sf_dir):
    out = alarms.decisions_per_second(feed(spark, sf_dir), ["event_type"], "ts", "value", 25, every="10 minutes")
    return drained(spark, out, "decisions").withColumn("mean_score", r6(F.col("mean_score")))


@register("stream_alarm_onsets", """WITH f AS (SELECT user_id, ts, event_id, (value > 100)::INT AS fl FROM events),
a AS (SELECT *, sum(fl) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 2 AS active FROM f)
SELECT user_id, ts, event_id FROM (SELECT *, lag(active, 1, false) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM a) WHERE active AND NOT before""")
def stream_alarm_onsets(spark, sf_dir):
    f = feed(spark, sf_dir).withColumn("flag", F.col("value") > 100)
    return drained(spark, alarms.alarm_onsets(f, "user_id", "ts", "event_id", "flag", delay="0 seconds"), "onsets")


@register("stream_alarms_out_of_order", f"""WITH f AS (SELECT user_id, ts, event_id, (value > 60)::INT AS fl FROM events WHERE ts <= {_mark('2 DAY')}),
g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 30 HOUR AS gap FROM f), r AS (SELECT *, sum(coalesce(gap, false)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM g),
a AS (SELECT *, sum(fl) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 2 AS active FROM r)
SELECT user_id, ts, event_id FROM (SELECT *, lag(active, 1, false) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS before FROM a) WHERE active AND NOT before""")
def stream_alarms_out_of_order(spark, sf_dir):
    """Events landed in files of a day and two thirds each, every row in its own or the file after, one file a micro-batch;
    alarms begin anew after 30 hours of silence."""
    events, at = load(spark, sf_dir, "events"), scratch_path(spark, "landed")
    hours = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    part = F.floor(hours / 40) + F.pmod(F.xxhash64("event_id"), F.lit(2))
    events.withColumn("part", part).repartition("part").write.partitionBy("part").parquet(f"{at}-parts")                # the table is read once
    parts = spark.read.parquet(f"{at}-parts")
    for number in [r[0] for r in parts.select("part").distinct().orderBy("part").collect()]:                # one landing after another, as files arrive
        parts.where(F.col("part") == number).drop("part").coalesce(1).write.parquet(f"{at}/{number:06d}")
    rows = alarms.replay(spark, f"{at}/*", "*.parquet", events.schema, files_per_batch=1).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("flag", F.col("value") > 60)
    return drained(spark, alarms.alarm_onsets(rows, "user_id", "ts", "event_id", "flag", delay="2 days", idle_seconds=30 * 3600), "onsets")


@register("stream_onset_budget", f"""WITH e AS (SELECT event_type, ts FROM events WHERE value > 100), w AS (SELECT event_type, time_bucket(INTERVAL 5 MINUTE, ts) - k * INTERVAL 5 MINUTE AS s FROM e, (SELECT unnest(range(12)) AS k))
SELECT event_type, s AS from_ts, s + INTERVAL 1 HOUR AS to_ts, count(*) AS onsets, count(*) > 1 AS over_budget FROM w WHERE s + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM e) GROUP BY 1, 2""")
def stream_onset_budget(spark, sf_dir):
    hits = feed(spark, sf_dir).where("value > 100")
    return drained(spark, alarms.onsets_per_hour(hits, ["event_type"], "ts", 1), "budget")


@register("stream_sessions", f"""WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), b AS (SELECT *, sum(CASE WHEN p IS NULL OR ts > p + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM l)
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM b GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR <= {_mark('10 MINUTE')}""")
def stream_sessions(spark, sf_dir):
    return drained(spark, alarms.live_sessions(feed(spark, sf_dir).select("user_id", "ts"), ["user_id"], "ts", "6 hours"), "sessions")


@register("stream_resends", "SELECT min(user_id) AS user_id, count(*) AS kept FROM (SELECT DISTINCT user_id FROM events) GROUP BY user_id")
def stream_resends(spark, sf_dir):
    e = feed(spark, sf_dir).select("user_id", "ts")
    out = drained(spark, alarms.without_resends(e, "user_id", "ts", "60 days"), "resends")
    return out.groupBy("user_id").agg(F.count("*").alias("kept"))


@register("stream_site_floor", """WITH f AS (SELECT event_type, quantile_cont(value, 0.5) AS floor FROM events GROUP BY 1)
SELECT event_id, event_type, value FROM events JOIN f USING (event_type) WHERE value > 10 * floor""")
def stream_site_floor(spark, sf_dir):
    from ..operators.ranks import exact_quantiles
    floor = exact_quantiles(load(spark, sf_dir, "events"), "value", {"floor": 0.5}, ["event_type"]).select("event_type", "floor")
    cells = feed(spark, sf_dir).select("event_id", "event_type", "value")
    return drained(spark, alarms.over_site_floor(cells, floor, ["event_type"], "value", 10.0).drop("floor"), "floor")


@register("stream_campaign_labels", """WITH s AS (SELECT event_type AS session, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1), g AS (SELECT session, a AS from_ts, a + (b - a) / 2 AS to_ts, 'background' AS label FROM s)
SELECT event_id, event_type, 'first day' AS block_label FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-02' AND event_type <> 'view'
UNION ALL SELECT event_id, event_type, 'third day' FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-04' AND event_type <> 'view'""")
def stream_campaign_labels(spark, sf_dir):
    kinds = load(spark, sf_dir, "events").select(F.col("event_type")).distinct().where("event_type <> 'view'")
    blocks = F.array(*[F.struct(F.lit(a).cast("timestamp").alias("from_ts"), F.lit(b).cast("timestamp").alias("to_ts"), F.lit(n).alias("label"))
                       for a, b, n in (("2024-01-01", "2024-01-02", "first day"), ("2024-01-03", "2024-01-04", "third day"))])
    segments = kinds.select("event_type", F.explode(blocks).alias("b")).select("event_type", "b.*")
    scores = feed(spark, sf_dir).select("event_id", "event_type", "ts")
    return drained(spark, alarms.campaign_labels(scores, segments, "event_type", "ts").drop("ts"), "labels")
