"""Alert suppression and the delivery log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .history import newest


#: What ids of decisions are named after, and the channel whose events bear the bare id.
DECISION, BARE_CHANNEL = "alert-decision:", "telegram"
DEFAULT_COOLDOWN_HOURS = 24


def price_text(price: Column) -> Column:
    """A price as the logs spell it: the shortest decimals, one at least."""
    plain = F.regexp_replace(price.cast("decimal(38,4)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when(F.abs(price) < 10_000_000, price.cast("double").cast("string")).otherwise(plain)


def dedup_key(url: Column, price: Column, site: Column) -> Column:
    """Hash of address, price (a number, or text as the log spells it) and site."""
    return F.sha2(F.concat_ws(":", url, price, site).cast("binary"), 256)


def decision_id(key: Column) -> Column:
    return T.uuid5(F.concat(F.lit(DECISION), key))


def candidate_decision_ids(url: Column, price: Column, site: Column) -> Column:
    """The ids that the decision of an observation can have: whole prices are spelled with and without a decimal."""
    spelled = F.array_compact(F.array(price_text(price), F.when(price == F.floor(price), price.cast("decimal(38,0)").cast("string"))))
    return F.transform(spelled, lambda text: decision_id(dedup_key(url, text, site)))


def channel_event_id(decision: Column, channel: Column) -> Column:
    """Each decision is an event of its own on each channel."""
    return F.when(channel == BARE_CHANNEL, decision).otherwise(F.concat_ws(":", decision, channel))


def decision_of_event(event_id: Column) -> Column:
    """The decision of an event on any channel; events that are none, such as those of store health, get an id of their own."""
    bare = F.substring_index(event_id, ":", 1)
    return F.when(F.rlike(bare, F.lit("(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")), F.lower(bare)).otherwise(T.uuid5(bare))


def route_channels(matches: DataFrame, default: str = "telegram") -> DataFrame:
    """Union of the channels of all watches of an offer, in the order of watches; the default where there is none."""
    rows = matches.groupBy("offer_id").agg(F.array_sort(F.collect_list(F.struct("watch_id", "channels"))).alias("w"))
    flat = F.array_distinct(F.flatten(F.transform("w", lambda x: F.coalesce(x["channels"], F.array().cast("array<string>")))))
    return rows.select("offer_id", F.when(F.size(flat) > 0, flat).otherwise(F.array(F.lit(default))).alias("channels"))


def site_cooldowns(watches: DataFrame, default: int = DEFAULT_COOLDOWN_HOURS) -> DataFrame:
    return watches.filter("enabled").groupBy("site").agg(F.coalesce(F.min("cooldown_hours"), F.lit(default)).alias("cooldown_hours"))


def dedupe_in_run(alerts: DataFrame, run: str) -> DataFrame:
    return newest(alerts, [run, "dedup_key"], [F.col("seq")])


def effective_outbox(log: DataFrame) -> DataFrame:
    """The newest record of each event. max_by needs no sort and combines before the shuffle."""
    rest = [c for c in log.columns if c != "event_id"]
    return log.groupBy("event_id").agg(F.max_by(F.struct(*rest), "seq").alias("l")).select("event_id", "l.*")


def replayable_events(log: DataFrame, channels: DataFrame, now_us: Column, seconds: int = 300) -> DataFrame:
    """Pending events older than ``seconds``: RETRY, or DEAD_LETTER where their channel is not set up."""
    due = effective_outbox(log).filter((F.col("status") == "PENDING") & (now_us - F.col("us") > seconds * 1_000_000))
    known = channels.select("channel", F.lit(True).alias("known")).distinct()
    return due.join(known, "channel", "left").withColumn("action", F.when(F.col("known"), "RETRY").otherwise("DEAD_LETTER")).drop("known")


def cooldown_suppress(alerts: DataFrame, log: DataFrame, cooldowns: DataFrame, default_hours: int = DEFAULT_COOLDOWN_HOURS) -> DataFrame:
    """Alerts (dedup_key, channel, site, us, ...) whose key was not sent on their channel within their site's cooldown before them, and
    that are not in flight. An event counts by its newest record alone: one that was sent and then failed suppresses nothing.
    cooldowns: site, cooldown_hours; sites without one have the default."""
    state = effective_outbox(log).select(F.col("dedup_key").alias("k"), F.col("channel").alias("c"), F.col("status").alias("state"), F.col("us").alias("t"))
    hours = cooldowns.select("site", F.col("cooldown_hours").alias("_hours"))
    alerts = alerts.join(hours, "site", "left").withColumn("_us", F.coalesce("_hours", F.lit(default_hours)).cast("long") * 3_600_000_000)
    same = (F.col("dedup_key") == F.col("k")) & (F.col("channel") == F.col("c"))
    within = (F.col("state") == "SENT") & (F.col("t") <= F.col("us")) & (F.col("us") - F.col("t") < F.col("_us"))
    return alerts.join(state, same & (within | (F.col("state") == "PENDING")), "left_anti").drop("_hours", "_us")


def allocate_attempts(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Numbers incoming attempts of a decision from the largest stored number on. A known id keeps its number."""
    known = stored.select("decision", "id", "attempt")
    most = known.groupBy("decision").agg(F.max("attempt").alias("most"))
    new = incoming.join(known.select("id"), "id", "left_anti").join(most, "decision", "left")
    at = F.row_number().over(Window.partitionBy("decision").orderBy("id"))
    return known.unionByName(new.select("decision", "id", (F.coalesce("most", F.lit(0)) + at).alias("attempt")))


def build_decisions(rows: DataFrame) -> DataFrame:
    """Decision rows: id, key, reasons (verdict, and a suspicion), evidence."""
    reasons = F.array_compact(F.array(F.col("verdict"), F.when(F.col("suspect"), "FAKE_DISCOUNT_SUSPECT")))
    key = dedup_key(F.col("offer_id"), price_text(F.col("price")), F.col("retailer"))
    return rows.select("seq", decision_id(key).alias("decision_id"), key.alias("dedup_key"), F.col("verdict"), reasons.alias("reasons"), F.array(F.concat(F.lit("obs:"), F.col("seq").cast("string"))).alias("evidence"))


def dedupe_health_alerts(messages: DataFrame, sent: DataFrame) -> DataFrame:
    """Messages whose content hash was not sent yet, once each."""
    made = messages.withColumn("message_id", F.sha2(F.col("message").cast("binary"), 256)).dropDuplicates(["message_id"])
    return made.join(sent.select(F.sha2(F.col("message").cast("binary"), 256).alias("message_id")).distinct(), "message_id", "left_anti")
