"""Streaming jobs run over the given tables until all is read; their SQL is that of the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_path
from ..streaming import jobs
from . import adapters as A
from .history_queries import DAYS, WIN
from .operations_queries import L, X

CHANGED = ("offer_id", "us", "seq", "price")
COOLDOWN = 60 * A.SLOT_US * 48
DEAD_HOURS = 3


class _Streamed:
    """Stands in for a session where an adapter reads a table: its files come as a stream."""

    def __init__(self, spark: SparkSession):
        self.spark, self.read = spark, self

    def parquet(self, path: str) -> DataFrame:
        folder, _, name = path.rpartition("/")
        return self.spark.readStream.schema(self.spark.read.parquet(path).schema).option("pathGlobFilter", name).parquet(folder)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return A.observations(_Streamed(spark), d)


def _fetches(spark: SparkSession, d: str) -> DataFrame:
    return A.health(_Streamed(spark), d).withColumn("ts", F.timestamp_micros("us"))


def stream_observations(spark: SparkSession, d: str) -> DataFrame:
    obs = _events(spark, d).select(*CHANGED).withColumn("ts", F.timestamp_micros("us"))
    corrected = obs.filter("seq % 3 > 0").withColumn("price", F.round(F.col("price") * 1.01, 4)).withColumn("seq", F.col("seq") + 1_000_000_000)
    schema = "offer_id string, us long, seq long, price double"
    table = jobs.LogTable(spark, shared_path(spark, "stream-observations"), schema, ["offer_id", "us"], "seq", mark="us")
    late = jobs.LogTable(spark, shared_path(spark, "stream-late"), schema)
    jobs.stream_observations(obs.union(obs).union(corrected).withWatermark("ts", "40 days"), table, late, 40 * 86_400_000_000)
    return table.read()


def stream_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Offers and watches of one remainder belong together; an offer has some watches, or none."""
    number = lambda c: F.substring(c, 2, 9).cast("int")
    w = A.watches(spark, d).filter("enabled").select((number("watch_id") % 40).alias("k"), "watch_id", F.col("atl_policy").alias("policy"), F.col("target_price").alias("target"), F.col("min_drop_percent").alias("min_drop"))
    offers = A.observations(spark, d).select("offer_id", (number("offer_id") % 40).alias("k")).distinct()
    groups = A.observations(spark, d).agg(F.approx_count_distinct("offer_id")).first()[0] // jobs.GROUP_OFFERS + 1
    return jobs.drain(jobs.stream_alerts(_events(spark, d), offers.join(w, "k").drop("k"), groups, DAYS), "stream-alerts")


def stream_health_windows(spark: SparkSession, d: str) -> DataFrame:
    return jobs.drain(jobs.stream_health_windows(_fetches(spark, d)), "stream-health")


def stream_dead_man(spark: SparkSession, d: str) -> DataFrame:
    return jobs.drain(jobs.stream_dead_man(_fetches(spark, d), DEAD_HOURS), "stream-dead-man")


def stream_feedback(spark: SparkSession, d: str) -> DataFrame:
    delivered = A.label_log(spark, d).filter("alert_id % 3 <> 0").select("alert_id")
    return jobs.drain(jobs.stream_feedback(A.label_log(_Streamed(spark), d), delivered), "stream-feedback").select("seq", "outcome")


def stream_cooldown(spark: SparkSession, d: str) -> DataFrame:
    return jobs.drain(jobs.stream_cooldown(A.outbox(_Streamed(spark), d).select("dedup_key", "channel", "us", "seq"), COOLDOWN), "stream-cooldown")


QUERIES = {f.__name__: f for f in (stream_observations, stream_alerts, stream_health_windows, stream_dead_man, stream_feedback, stream_cooldown)}

TWO_HOURS, TEN_MINUTES = 7_200_000_000, 600_000_000
SQL = {
    "stream_observations": f"""WITH {A.OBS}, b AS (SELECT offer_id, us, seq, price FROM obs UNION ALL SELECT offer_id, us, seq + 1000000000, round(price * 1.01, 4) FROM obs WHERE seq % 3 > 0)
      SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY offer_id, us ORDER BY seq DESC) = 1""",
    "stream_alerts": f"""WITH {WIN}, {A.WATCHES}, on_ AS (SELECT *, substr(watch_id, 2)::INT % 40 AS k FROM watches WHERE enabled),
      g AS (SELECT *, substr(offer_id, 2)::INT % 40 AS k, price < previous_price AND stock_status <> 'out_of_stock' AS falls, previous_price - price >= 5 AND (previous_price - price) / nullif(previous_price, 0) * 100 >= 2 AS floor_ FROM win)
      SELECT seq, watch_id, previous_price, thirty_day_low, history_days::BIGINT AS history_days, verdict,
        coalesce(watch_id IS NOT NULL AND falls AND ((price < prior_low AND (atl_policy = 'aggressive' OR (atl_policy = 'conservative' AND floor_)))
          OR (floor_ AND NOT coalesce(price > target_price, false) AND NOT coalesce((previous_price - price) / nullif(previous_price, 0) * 100 < min_drop_percent, false))), false) AS alerts
      FROM g LEFT JOIN (SELECT seq, verdict FROM judged) USING (seq) LEFT JOIN on_ USING (k)""",
    "stream_health_windows": f"""WITH {A.HEALTH}, w AS (SELECT us // {TWO_HOURS} * {TWO_HOURS} AS slot_us, store, count(*) AS requested, count(*) FILTER (WHERE kind = 'view') AS parsed, count(*) FILTER (WHERE kind = 'error') AS failures FROM fetches GROUP BY ALL)
      SELECT * FROM w WHERE slot_us + {TWO_HOURS} <= ((SELECT max(us) FROM fetches) - {TEN_MINUTES}) // 1000 * 1000""",
    "stream_dead_man": f"""WITH {A.HEALTH}, g AS (SELECT store, us, lead(us) OVER (PARTITION BY store ORDER BY us) AS nxt FROM fetches WHERE kind = 'view')
      SELECT store, us AS last_good_us, 'closed' AS kind FROM g WHERE nxt - us > {DEAD_HOURS} * 3600000000
      UNION ALL SELECT store, us, 'open' FROM g WHERE nxt IS NULL AND (us + {DEAD_HOURS} * 3600000000) // 1000 + 1 < ((SELECT max(us) FROM fetches) - {TEN_MINUTES}) // 1000""",
    "stream_feedback": f"""WITH {L} SELECT seq, CASE WHEN row_number() OVER (PARTITION BY callback_id ORDER BY seq) > 1 THEN 'duplicate' WHEN alert_id % 3 <> 0 THEN 'stored' ELSE 'rejected' END AS outcome FROM label_log""",
    "stream_cooldown": f"""WITH RECURSIVE {X}, o AS (SELECT dedup_key, channel, us, min(seq) AS seq FROM outbox GROUP BY ALL), r AS (SELECT dedup_key, channel, min(us) AS us FROM o GROUP BY ALL
      UNION ALL SELECT r.dedup_key, r.channel, (SELECT min(o.us) FROM o WHERE o.dedup_key = r.dedup_key AND o.channel = r.channel AND o.us >= r.us + {COOLDOWN}) FROM r WHERE r.us IS NOT NULL)
      SELECT dedup_key, channel, us, seq FROM r JOIN o USING (dedup_key, channel, us)""",
}
