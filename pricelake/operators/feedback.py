"""Labels that users press on alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.ranking import with_rank
from .history import newest

CODES = {"u": "useful", "p": "purchased", "f": "fake_discount", "w": "wrong_price", "d": "duplicate"}
GOOD, BAD = ("useful", "purchased"), ("fake_discount", "wrong_price")
UPDATE = "update_id long, callback_query struct<id: string, from: struct<id: long>, message: struct<message_id: long, date: long, chat: struct<id: long>>, data: string>"


def classify_feedback(raw: DataFrame, chats: list[int], users: list[int], now_s: Column, days: int = 30) -> DataFrame:
    """Raw updates (column ``value``) to a label or the first rule that they break."""
    u = F.from_json("value", UPDATE)
    q = u["callback_query"]
    parts = F.split(q["data"], ":")
    codes = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
    payload = (F.size(parts) == 3) & (F.try_element_at(parts, F.lit(1)) == "fb1") & F.rlike(F.try_element_at(parts, F.lit(2)), F.lit("^[0-9a-f]{32}$"))
    label = F.try_element_at(codes, F.try_element_at(parts, F.lit(3)))
    # A struct of nulls is what from_json makes of text that is no object.
    reason = (
        F.when(u.isNull() | u["update_id"].isNull(), "malformed")
        .when(q["id"].isNull(), "not_callback")
        .when(q["message"]["chat"]["id"].isNull(), "unknown_chat")
        .when(~q["message"]["chat"]["id"].isin(chats), "unauthorized_chat")
        .when(q["from"]["id"].isNull() | ~q["from"]["id"].isin(users), "unauthorized_user")
        .when(~F.coalesce(payload, F.lit(False)) | label.isNull(), "payload")
        .when(now_s - q["message"]["date"] > days * 86_400, "expired")
    )
    return raw.select(u["update_id"].alias("update_id"), q["id"].alias("callback_id"), q["from"]["id"].alias("user"), F.try_element_at(parts, F.lit(2)).alias("alert"), F.when(reason.isNull(), label).alias("label"), reason.alias("reason"))


def pseudonymize(salt: str, kind: str, id_: Column) -> Column:
    return T.hmac_sha256(salt, F.concat(F.lit(f"{kind}:"), id_.cast("string")))


def ingest_feedback(stored: DataFrame, incoming: DataFrame, delivered: DataFrame) -> DataFrame:
    """incoming with ``outcome``: stored (first press of its id on a delivered alert), duplicate, or rejected."""
    seen = stored.select("callback_id", F.lit(True).alias("seen")).distinct()
    sent = delivered.select("alert_id", F.lit(True).alias("sent")).distinct()
    at = F.row_number().over(Window.partitionBy("callback_id").orderBy("seq"))
    rows = incoming.join(sent, "alert_id", "left").join(seen, "callback_id", "left").withColumn("at", at)
    outcome = F.when(F.col("seen") | (F.col("at") > 1), "duplicate").when(F.col("sent"), "stored").otherwise("rejected")
    return rows.withColumn("outcome", outcome).drop("seen", "sent", "at")


def list_feedback(log: DataFrame, since_us: Column, full: bool = False) -> DataFrame:
    return (log if full else current_labels(log)).filter(F.col("us") >= since_us)


def current_labels(log: DataFrame) -> DataFrame:
    return newest(log, ["alert_id", "rater"], [F.desc("seq")])


def feedback_summary(log: DataFrame) -> DataFrame:
    return current_labels(log).groupBy("label").agg(F.count("*").alias("n"))


def audit_metrics(outcomes: DataFrame) -> DataFrame:
    """Presses by outcome, and how many got an answer (answered: true, false, or null where none was tried)."""
    kinds = ("stored", "duplicate", "rejected")
    return outcomes.agg(F.count("*").alias("received"), *[F.count_if(F.col("outcome") == k).alias(k) for k in kinds], F.count_if("answered").alias("answered"), F.count_if(~F.col("answered")).alias("failed"))


def export_labels(log: DataFrame) -> DataFrame:
    """Raters become rater_1, rater_2, ... by their first press."""
    first = log.groupBy("rater").agg(F.min("seq").alias("first"))
    names = with_rank(first, "at", "first", "rater").select("rater", F.concat(F.lit("rater_"), F.col("at").cast("string")).alias("name"))
    return current_labels(log).join(names, "rater").select("alert_id", "name", "label", "seq")


def erase_feedback(log: DataFrame, before_us: Column, rater: int) -> DataFrame:
    return log.filter((F.col("us") >= before_us) & ~F.col("rater").eqNullSafe(F.lit(rater)))


def vote_labels(log: DataFrame) -> DataFrame:
    """Majority of the current labels of each alert; ties and alerts without a judged label are left out."""
    vote = F.when(F.col("label").isin(*GOOD), 1).when(F.col("label").isin(*BAD), -1).otherwise(0)
    votes = current_labels(log).groupBy("alert_id").agg(F.sum(vote).alias("balance"), F.count_if(vote != 0).alias("votes"))
    return votes.filter("balance <> 0").select("alert_id", (F.col("balance") > 0).cast("int").alias("label"), "votes")
