"""Queries of store health, delivery and feedback, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import deals, delivery, feedback, health
from . import adapters as A

DAYS = 7
#: The moment that queries over the given logs call now: the end of January 2024, and of 1998 for orders.
NOW = 1_706_745_600_000_000
ORDERS_NOW = 915_148_800_000_000
WEEK = 7 * 86_400_000_000


def _health(spark: SparkSession, d: str) -> DataFrame:
    """With a row of zeros for each run in which a store has no record."""
    h = health.store_run_health(A.health(spark, d))
    stores = h.agg(F.collect_set("store").alias("stores"))  # a small dimension: one row of it goes to each run
    spine = h.select("run").distinct().join(F.broadcast(stores)).select("run", F.explode("stores").alias("store"))
    zeros = ("requested", "parsed", "matched", "failures", "rate_limit_hits", "skipped", "blocked", "attempts")
    return spine.join(h, ["store", "run"], "left").na.fill(0, list(zeros)).na.fill(False, ["challenge_detected", "challenge_wait_entered"]).withColumn("started_us", F.coalesce("started_us", F.col("run") * A.SLOT_US))


def store_run_health(spark: SparkSession, d: str) -> DataFrame:
    return _health(spark, d).withColumn("latency", F.round("latency", 6))


def last_known_good(spark: SparkSession, d: str) -> DataFrame:
    return health.last_known_good(_health(spark, d)).select("store", "run", F.col("last_good_us").cast("string").alias("last_good_us"))


def quarantined_stores(spark: SparkSession, d: str) -> DataFrame:
    return health.quarantined_stores(_cut(spark, d)).select("store")


def _cut(spark: SparkSession, d: str) -> DataFrame:
    """Each store's records up to a time of its own, so that stores end in different states."""
    h = _health(spark, d)
    return h.filter(F.col("run") <= F.lit(947_400) + F.substring("store", 7, 1).cast("int") * 31)


def outage_start(spark: SparkSession, d: str) -> DataFrame:
    return health.outage_start(_cut(spark, d))


def probe_due(spark: SparkSession, d: str) -> DataFrame:
    return health.probe_due(_cut(spark, d), F.lit(NOW)).select("store", "last_us")


def rate_limited_stores(spark: SparkSession, d: str) -> DataFrame:
    return health.rate_limited_stores(_cut(spark, d), F.lit(947_500 * A.SLOT_US), minutes=3000).select("store", "attempts", "rate_limit_hits")


def health_alerts(spark: SparkSession, d: str) -> DataFrame:
    """For each store the run after its cut is the new one; stores in quarantine before are probed, but for store_2."""
    before = _cut(spark, d)
    cut = before.groupBy("store").agg(F.max("run").alias("cut"))
    new = _health(spark, d).join(cut, "store").filter("run = cut + 1").drop("cut")
    probed = health.quarantined_stores(before).filter("store <> 'store_2'")
    return health.health_alerts(before, new, probed, F.lit(NOW))


def health_summary(spark: SparkSession, d: str) -> DataFrame:
    return health.health_summary(_health(spark, d))


def store_status(spark: SparkSession, d: str) -> DataFrame:
    return health.store_status(_cut(spark, d))


def dedup_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys and ids of alerts on each observation, with the event on a second channel and the decision that it leads back to."""
    o = A.observations(spark, d)
    price = F.when(F.col("seq") % 4 == 0, F.floor("price").cast("double")).otherwise(F.col("price"))
    keyed = o.select("seq", delivery.dedup_key(F.col("offer_id"), delivery.price_text(price), F.col("retailer")).alias("dedup_key"), delivery.candidate_decision_ids(F.col("offer_id"), price, F.col("retailer")).alias("ids"))
    decision = delivery.decision_id(F.col("dedup_key"))
    event = delivery.channel_event_id(decision, F.when(F.col("seq") % 3 == 0, "email").otherwise("telegram"))
    out = keyed.withColumn("decision_id", decision).withColumn("event_id", event).withColumn("of_event", delivery.decision_of_event(F.col("event_id")))
    return out.select("seq", "dedup_key", "decision_id", "event_id", "of_event", F.array_join("ids", ",").alias("ids"), delivery.decision_of_event(F.col("dedup_key")).alias("of_health"))


def route_channels(spark: SparkSession, d: str) -> DataFrame:
    w = A.watches(spark, d).withColumn("n", F.substring("watch_id", 2, 9).cast("int"))
    offers = A.read(spark, d, "part").select(F.col("p_partkey").alias("offer_id"), (F.col("p_partkey") % 40).alias("k"))
    matches = offers.join(w.select((F.col("n") % 40).alias("k"), "watch_id", F.when(F.col("enabled"), F.col("channels")).alias("channels")), "k")
    return delivery.route_channels(matches).select("offer_id", F.array_join("channels", ",").alias("channels"))


def site_cooldowns(spark: SparkSession, d: str) -> DataFrame:
    return delivery.site_cooldowns(A.watches(spark, d))


def dedupe_in_run(spark: SparkSession, d: str) -> DataFrame:
    log = A.outbox(spark, d).withColumn("run", F.floor(F.col("us") / WEEK))
    return delivery.dedupe_in_run(log, "run").select("run", "dedup_key", "seq")


def effective_outbox(spark: SparkSession, d: str) -> DataFrame:
    return delivery.effective_outbox(A.outbox(spark, d)).select("event_id", "seq", "status", "channel")


def replayable_events(spark: SparkSession, d: str) -> DataFrame:
    channels = A.watches(spark, d).select(F.explode("channels").alias("channel"))
    return delivery.replayable_events(A.outbox(spark, d), channels, F.lit(ORDERS_NOW)).select("event_id", "seq", "channel", "action")


def _alert_sites(log: DataFrame) -> DataFrame:
    return log.withColumn("site", F.concat(F.lit("store_"), (F.col("seq") % 5).cast("string")))


def cooldown_suppress(spark: SparkSession, d: str) -> DataFrame:
    """Days stand for hours: the given log has a record every few weeks."""
    log = A.outbox(spark, d)
    cooldowns = delivery.site_cooldowns(A.watches(spark, d)).withColumn("cooldown_hours", F.col("cooldown_hours") * 24 + 24)
    return delivery.cooldown_suppress(_alert_sites(log.filter("seq % 4 = 0")), log.filter("seq % 4 <> 0"), cooldowns, default_hours=8 * 7 * 24).select("seq", "dedup_key", "channel")


def allocate_attempts(spark: SparkSession, d: str) -> DataFrame:
    rows = A.outbox(spark, d).select(F.col("event_id").alias("decision"), F.col("seq").alias("id"))
    stored = rows.filter("id % 3 = 0").withColumn("attempt", F.lit(1))
    stored = delivery.allocate_attempts(stored.limit(0), stored.drop("attempt"))
    return delivery.allocate_attempts(stored, rows.filter("id % 3 <> 1"))


def build_decisions(spark: SparkSession, d: str) -> DataFrame:
    rows = deals.reference_price_verdict(A.observations(spark, d), DAYS).withColumn("suspect", F.col("reference_price") > 1.25 * F.col("thirty_day_low"))
    return delivery.build_decisions(rows).select("seq", "decision_id", "dedup_key", "verdict", F.array_join("reasons", ",").alias("reasons"), F.array_join("evidence", ",").alias("evidence"))


def dedupe_health_alerts(spark: SparkSession, d: str) -> DataFrame:
    log = A.outbox(spark, d).filter("source = 'health'").select(F.concat_ws(" ", "channel", "status", (F.col("event_id") % 300).cast("string")).alias("message"), "seq")
    return delivery.dedupe_health_alerts(log.filter("seq % 2 = 0").select("message"), log.filter("seq % 3 = 0 and seq % 2 = 1").select("message"))


def classify_feedback(spark: SparkSession, d: str) -> DataFrame:
    e = A.read(spark, d, "events")
    i = F.col("event_id")
    code = F.substring(F.lit("upfwd"), (i % 5 + 1).cast("int"), F.lit(1))
    data = F.concat_ws(":", F.when(i % 13 == 0, "fb0").otherwise("fb1"), F.md5(i.cast("string")), code)
    message = F.struct(i.alias("message_id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("date"), F.struct(F.when(i % 17 != 0, F.col("user_id") % 3).alias("id")).alias("chat"))
    q = F.struct(F.when(i % 19 != 0, i.cast("string")).alias("id"), F.struct((F.col("user_id") % 20).alias("id")).alias("from"), message.alias("message"), data.alias("data"))
    value = F.when(i % 23 == 0, "{not json").otherwise(F.to_json(F.struct(i.alias("update_id"), q.alias("callback_query"))))
    out = feedback.classify_feedback(e.select(value.alias("value")), [0, 1], list(range(15)), F.lit(NOW // 1_000_000), days=20)
    return out.groupBy("reason", "label").agg(F.count("*").alias("n"))


def pseudonymize(spark: SparkSession, d: str) -> DataFrame:
    c = A.read(spark, d, "customer")
    return c.select("c_custkey", feedback.pseudonymize("salt of the export", "user", F.col("c_custkey")).alias("ref"))


def _ingested(spark: SparkSession, d: str) -> DataFrame:
    log = A.label_log(spark, d)
    return feedback.ingest_feedback(log.filter("seq < 2000"), log.filter("seq >= 2000"), log.filter("alert_id % 3 <> 0").select("alert_id"))


def ingest_feedback(spark: SparkSession, d: str) -> DataFrame:
    return _ingested(spark, d).select("seq", "outcome")


def list_feedback(spark: SparkSession, d: str) -> DataFrame:
    log = A.label_log(spark, d)
    return feedback.list_feedback(log, F.lit(NOW - 2 * WEEK)).select("alert_id", "rater", "label", "seq")


def current_labels(spark: SparkSession, d: str) -> DataFrame:
    return feedback.current_labels(A.label_log(spark, d)).select("alert_id", "rater", "label", "seq")


def feedback_summary(spark: SparkSession, d: str) -> DataFrame:
    return feedback.feedback_summary(A.label_log(spark, d))


def audit_metrics(spark: SparkSession, d: str) -> DataFrame:
    return feedback.audit_metrics(_ingested(spark, d).withColumn("answered", F.when(F.col("seq") % 7 > 0, F.col("seq") % 11 > 0)))


def export_labels(spark: SparkSession, d: str) -> DataFrame:
    return feedback.export_labels(A.label_log(spark, d))


def erase_feedback(spark: SparkSession, d: str) -> DataFrame:
    return feedback.erase_feedback(A.label_log(spark, d), F.lit(NOW - 2 * WEEK), 3).select("seq", "alert_id", "rater", "label")


def vote_labels(spark: SparkSession, d: str) -> DataFrame:
    return feedback.vote_labels(A.label_log(spark, d))


QUERIES = {f.__name__: f for f in (
    store_run_health, last_known_good, quarantined_stores, outage_start, probe_due, rate_limited_stores, health_alerts, health_summary, store_status, dedup_keys, route_channels, site_cooldowns,
    dedupe_in_run, effective_outbox, replayable_events, cooldown_suppress, allocate_attempts, build_decisions, dedupe_health_alerts, classify_feedback, pseudonymize, ingest_feedback,
    list_feedback, current_labels, feedback_summary, audit_metrics, export_labels, erase_feedback, vote_labels,
)}

from .history_queries import WIN  # noqa: E402

L, X, W = A.LABEL_LOG, A.OUTBOX, A.WATCHES
H = A.HEALTH + f""",
seen AS (SELECT store, run, count(*) AS requested, count(*) FILTER (WHERE kind = 'view') AS parsed, count(*) FILTER (WHERE kind = 'purchase') AS matched, count(*) FILTER (WHERE kind = 'error') AS failures,
  count(*) FILTER (WHERE kind = 'click') AS rate_limit_hits, bool_or(is_challenge) AS challenge_detected, bool_or(is_wait) AS challenge_wait_entered, avg(latency) AS latency, min(us) AS started_us,
  count(*) FILTER (WHERE is_skipped) AS skipped, count(*) FILTER (WHERE is_blocked) AS blocked, sum(tries)::BIGINT AS attempts FROM fetches GROUP BY ALL),
h AS (SELECT s.store, r.run, coalesce(requested, 0) AS requested, coalesce(parsed, 0) AS parsed, coalesce(matched, 0) AS matched, coalesce(failures, 0) AS failures, coalesce(rate_limit_hits, 0) AS rate_limit_hits,
  coalesce(skipped, 0) AS skipped, coalesce(blocked, 0) AS blocked, coalesce(attempts, 0) AS attempts, coalesce(challenge_detected, false) AS challenge_detected, coalesce(challenge_wait_entered, false) AS challenge_wait_entered, latency, coalesce(started_us, r.run * {A.SLOT_US}) AS started_us
  FROM (SELECT DISTINCT run FROM seen) r CROSS JOIN (SELECT DISTINCT store FROM seen) s LEFT JOIN seen x ON x.store = s.store AND x.run = r.run),
c AS (SELECT * FROM h WHERE run <= 947400 + substr(store, 7, 1)::INT * 31)"""


def uuid5(name: str) -> str:
    """SQL for the version 5 id of a name."""
    h = f"sha1(unhex('{T.URL_SPACE}') || encode({name}))"
    return f"list_transform([{h}], lambda h: h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || printf('%02x', (('0x' || h[17:18])::INT & 63) | 128) || h[19:20] || '-' || h[21:32])[1]"


def _bad(of: str) -> str:
    return f"""(SELECT DISTINCT store FROM (SELECT store, run, count(*) OVER (PARTITION BY store) AS n, max(parsed) OVER (PARTITION BY store) AS most FROM
      (SELECT * FROM {of} QUALIFY row_number() OVER (PARTITION BY store ORDER BY run DESC) <= 2)) WHERE n = 2 AND most = 0 AND run IN (SELECT run FROM {of} WHERE parsed > 0))"""


INGEST = L + """,
old AS (SELECT DISTINCT callback_id FROM label_log WHERE seq < 2000), sent AS (SELECT DISTINCT alert_id FROM label_log WHERE alert_id % 3 <> 0),
ing AS (SELECT n.seq, CASE WHEN n.callback_id IN (SELECT callback_id FROM old) OR row_number() OVER (PARTITION BY n.callback_id ORDER BY n.seq) > 1 THEN 'duplicate'
  WHEN n.alert_id IN (SELECT alert_id FROM sent) THEN 'stored' ELSE 'rejected' END AS outcome FROM label_log n WHERE n.seq >= 2000)"""
CUR = L + ", cur AS (SELECT * FROM label_log QUALIFY row_number() OVER (PARTITION BY alert_id, rater ORDER BY seq DESC) = 1)"
EFF = X + ", eff AS (SELECT * FROM outbox QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY seq DESC) = 1)"
_SALT = b"salt of the export".ljust(64, b"\0")
IPAD, OPAD = (bytes(b ^ x for b in _SALT).hex() for x in (0x36, 0x5C))
SQL = {
    "pseudonymize": f"SELECT c_custkey, sha256(unhex('{OPAD}') || unhex(sha256(unhex('{IPAD}') || encode('user:' || c_custkey)))) AS ref FROM customer",
    "store_run_health": f"WITH {H} SELECT store, run, requested, parsed, matched, failures, rate_limit_hits, skipped, blocked, attempts, challenge_detected, challenge_wait_entered, round(latency, 6) AS latency, started_us FROM h",
    "last_known_good": f"WITH {H} SELECT store, run, (max(CASE WHEN parsed > 0 THEN started_us END) OVER (PARTITION BY store ORDER BY run))::VARCHAR AS last_good_us FROM h",
    "quarantined_stores": f"WITH {H} SELECT store FROM {_bad('c')}",
    "outage_start": f"WITH {H} SELECT store, min(run) AS outage_run, min(started_us) AS outage_us FROM c WHERE run > coalesce((SELECT max(run) FROM c g WHERE g.store = c.store AND g.parsed > 0), -1) GROUP BY store",
    "probe_due": f"WITH {H} SELECT store, max(started_us) AS last_us FROM c WHERE store IN {_bad('c')} GROUP BY store HAVING {NOW} - max(started_us) >= 21600000000",
    "rate_limited_stores": f"""WITH {H}, l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY store ORDER BY run DESC) = 1)
      SELECT store, attempts, rate_limit_hits FROM l WHERE attempts > 0 AND rate_limit_hits / attempts > 0.05 AND 947500::BIGINT * {A.SLOT_US} - started_us < 180000000000""",
    "health_alerts": f"""WITH {H}, n AS (SELECT h.* FROM h JOIN (SELECT store, max(run) AS cut FROM c GROUP BY store) k ON h.store = k.store AND h.run = k.cut + 1), a AS (SELECT * FROM c UNION ALL SELECT * FROM n),
      was AS {_bad('c')}, now_ AS {_bad('a')}, probed AS (SELECT store FROM was WHERE store <> 'store_2')
      SELECT store, 'quarantined' AS kind, 'run ' || (SELECT min(run) FROM a x WHERE x.store = now_.store AND run > coalesce((SELECT max(run) FROM a g WHERE g.store = now_.store AND g.parsed > 0), -1)) AS outage FROM now_ WHERE store NOT IN (SELECT store FROM was)
      UNION ALL SELECT store, 'recovered', 'run ' || run FROM n WHERE store IN (SELECT store FROM probed) AND parsed > 0 AND store NOT IN (SELECT store FROM now_)
      UNION ALL SELECT store, 'dead_man', 'since ' || max(started_us) FROM a WHERE parsed > 0 AND store IN (SELECT store FROM n) AND NOT (store IN (SELECT store FROM probed) AND store IN (SELECT store FROM now_)) GROUP BY store HAVING {NOW} - max(started_us) > 86400000000""",
    "health_summary": f"WITH {H} SELECT run, store, sum(requested)::BIGINT AS requested, sum(parsed)::BIGINT AS parsed, sum(failures)::BIGINT AS failures, grouping(run, store)::INT AS level FROM h GROUP BY ROLLUP (run, store)",
    "store_status": f"""WITH {H}, l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY store ORDER BY run DESC) = 1)
      SELECT store, run, CASE WHEN store IN {_bad('c')} THEN 'QUARANTINED' WHEN parsed = 0 THEN 'NO PRODUCTS' WHEN challenge_detected THEN 'CHALLENGED' ELSE 'OK' END AS status,
        CASE WHEN challenge_detected THEN 'blocked' WHEN challenge_wait_entered THEN 'cleared' ELSE 'none' END AS challenge FROM l""",
    "dedup_keys": f"""WITH {A.OBS}, o AS (SELECT seq, offer_id, retailer, CASE WHEN seq % 4 = 0 THEN floor(price) ELSE price END AS price FROM obs),
      k AS (SELECT seq, sha256(offer_id || ':' || price::VARCHAR || ':' || retailer) AS dedup_key, CASE WHEN price = floor(price) THEN sha256(offer_id || ':' || price::BIGINT || ':' || retailer) END AS whole FROM o),
      i AS (SELECT *, {uuid5("'alert-decision:' || dedup_key")} AS decision_id, CASE WHEN whole IS NOT NULL THEN {uuid5("'alert-decision:' || whole")} END AS other FROM k)
      SELECT seq, dedup_key, decision_id, decision_id || CASE WHEN seq % 3 = 0 THEN ':email' ELSE '' END AS event_id, decision_id AS of_event, concat_ws(',', decision_id, other) AS ids, {uuid5("dedup_key")} AS of_health FROM i""",
    "route_channels": f"""WITH {W}, m AS (SELECT p_partkey AS offer_id, watch_id, CASE WHEN enabled THEN channels ELSE [] END AS channels FROM part JOIN watches ON substr(watch_id, 2)::INT % 40 = p_partkey % 40),
      f AS (SELECT offer_id, watch_id, unnest(channels) AS ch, generate_subscripts(channels, 1) AS pos FROM m), g AS (SELECT offer_id, ch, min((watch_id, pos)) AS place FROM f GROUP BY ALL)
      SELECT offer_id, coalesce(string_agg(ch, ',' ORDER BY place), 'telegram') AS channels FROM (SELECT DISTINCT offer_id FROM m) LEFT JOIN g USING (offer_id) GROUP BY offer_id""",
    "site_cooldowns": f"WITH {W} SELECT site, coalesce(min(cooldown_hours), 24) AS cooldown_hours FROM watches WHERE enabled GROUP BY site",
    "dedupe_in_run": f"WITH {X} SELECT us // {WEEK} AS run, dedup_key, min(seq) AS seq FROM outbox GROUP BY ALL",
    "effective_outbox": f"WITH {EFF} SELECT event_id, seq, status, channel FROM eff",
    "replayable_events": f"""WITH {EFF}, {W} SELECT event_id, seq, channel, CASE WHEN channel IN (SELECT unnest(channels) FROM watches) THEN 'RETRY' ELSE 'DEAD_LETTER' END AS action
      FROM eff WHERE status = 'PENDING' AND {ORDERS_NOW} - us > 300000000""",
    "cooldown_suppress": f"""WITH {X}, {W}, cool AS (SELECT site, coalesce(min(cooldown_hours), 24) * 24 + 24 AS hours FROM watches WHERE enabled GROUP BY site),
      st AS (SELECT * FROM outbox WHERE seq % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY seq DESC) = 1)
      SELECT seq, dedup_key, channel FROM outbox a LEFT JOIN cool ON cool.site = 'store_' || (a.seq % 5) WHERE seq % 4 = 0
        AND NOT EXISTS (SELECT 1 FROM st s WHERE s.status = 'SENT' AND s.dedup_key = a.dedup_key AND s.channel = a.channel AND s.us <= a.us AND a.us - s.us < coalesce(hours, {8 * 7 * 24}) * 3600000000)
        AND NOT EXISTS (SELECT 1 FROM st s WHERE s.status = 'PENDING' AND s.dedup_key = a.dedup_key AND s.channel = a.channel)""",
    "allocate_attempts": f"""WITH {X} SELECT event_id AS decision, seq AS id, (row_number() OVER (PARTITION BY event_id ORDER BY seq % 3 <> 0, seq))::INT AS attempt FROM outbox WHERE seq % 3 <> 1""",
    "build_decisions": f"""WITH {WIN}, k AS (SELECT *, sha256(offer_id || ':' || price::VARCHAR || ':' || retailer) AS dedup_key FROM judged)
      SELECT seq, {uuid5("'alert-decision:' || dedup_key")} AS decision_id, dedup_key, verdict, concat_ws(',', verdict, CASE WHEN reference_price > 1.25 * thirty_day_low THEN 'FAKE_DISCOUNT_SUSPECT' END) AS reasons, 'obs:' || seq AS evidence FROM k""",
    "dedupe_health_alerts": f"""WITH {X}, m AS (SELECT channel || ' ' || status || ' ' || (event_id % 300) AS message, seq FROM outbox WHERE source = 'health')
      SELECT DISTINCT message, sha256(message) AS message_id FROM m WHERE seq % 2 = 0 AND message NOT IN (SELECT message FROM m WHERE seq % 3 = 0 AND seq % 2 = 1)""",
    "classify_feedback": f"""WITH r AS (SELECT CASE WHEN event_id % 23 = 0 THEN 'malformed' WHEN event_id % 19 = 0 THEN 'not_callback' WHEN event_id % 17 = 0 THEN 'unknown_chat' WHEN user_id % 3 = 2 THEN 'unauthorized_chat'
        WHEN user_id % 20 >= 15 THEN 'unauthorized_user' WHEN event_id % 13 = 0 THEN 'payload' WHEN {NOW // 1_000_000} - floor(epoch(ts)) > 20 * 86400 THEN 'expired' END AS reason,
        ['useful','purchased','fake_discount','wrong_price','duplicate'][event_id % 5 + 1] AS label FROM events)
      SELECT reason, CASE WHEN reason IS NULL THEN label END AS label, count(*) AS n FROM r GROUP BY ALL""",
    "ingest_feedback": f"WITH {INGEST} SELECT seq, outcome FROM ing",
    "list_feedback": f"WITH {CUR} SELECT alert_id, rater, label, seq FROM cur WHERE us >= {NOW - 2 * WEEK}",
    "current_labels": f"WITH {CUR} SELECT alert_id, rater, label, seq FROM cur",
    "feedback_summary": f"WITH {CUR} SELECT label, count(*) AS n FROM cur GROUP BY label",
    "audit_metrics": f"WITH {INGEST} SELECT count(*) AS received, count(*) FILTER (WHERE outcome = 'stored') AS stored, count(*) FILTER (WHERE outcome = 'duplicate') AS duplicate, count(*) FILTER (WHERE outcome = 'rejected') AS rejected, count(*) FILTER (WHERE seq % 7 > 0 AND seq % 11 > 0) AS answered, count(*) FILTER (WHERE seq % 7 > 0 AND seq % 11 = 0) AS failed FROM ing",
    "export_labels": f"WITH {CUR}, n AS (SELECT rater, 'rater_' || row_number() OVER (ORDER BY min(seq)) AS name FROM label_log GROUP BY rater) SELECT alert_id, name, label, seq FROM cur JOIN n USING (rater)",
    "erase_feedback": f"WITH {L} SELECT seq, alert_id, rater, label FROM label_log WHERE us >= {NOW - 2 * WEEK} AND rater <> 3",
    "vote_labels": f"""WITH {CUR}, v AS (SELECT alert_id, sum(CASE WHEN label IN ('useful','purchased') THEN 1 WHEN label IN ('fake_discount','wrong_price') THEN -1 ELSE 0 END) AS balance,
      count(*) FILTER (WHERE label <> 'duplicate') AS votes FROM cur GROUP BY alert_id) SELECT alert_id, (balance > 0)::INT AS label, votes FROM v WHERE balance <> 0""",
}
