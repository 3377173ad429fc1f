"""The given tables as the engine's inputs: observations, offers, watches, health records, logs. Each with its SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense price series: an offer per user of events. seq is the order of arrival, day a day number, us microseconds."""
    e = read(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    stock = F.create_map(*[F.lit(x) for x in ("error", "out_of_stock", "click", "limited_stock", "signup", "supplier_stock", "purchase", "unknown", "view", "in_stock")])
    return e.select(
        F.concat(F.lit("o"), F.col("user_id").cast("string")).alias("offer_id"),
        F.concat(F.lit("store_"), (F.col("user_id") % 4).cast("string")).alias("retailer"),
        F.col("event_id").alias("seq"),
        F.unix_micros(ts).alias("us"),
        F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).alias("day"),
        F.col("value").alias("price"),
        stock[F.col("event_type")].alias("stock_status"),
        F.when(F.col("event_id") % 3 == 0, F.col("value") * 1.3).alias("reference_price"),
        (F.col("event_id") % 5 != 0).alias("is_known_seller"),
    )


OBS = """
obs AS (SELECT 'o' || user_id AS offer_id, 'store_' || (user_id % 4) AS retailer, event_id AS seq, epoch_us(ts) AS us,
  (ts::DATE - DATE '1970-01-01')::INT AS day, value AS price,
  CASE event_type WHEN 'error' THEN 'out_of_stock' WHEN 'click' THEN 'limited_stock' WHEN 'signup' THEN 'supplier_stock'
                  WHEN 'purchase' THEN 'unknown' ELSE 'in_stock' END AS stock_status,
  CASE WHEN event_id % 3 = 0 THEN value * 1.3 END AS reference_price, event_id % 5 <> 0 AS is_known_seller FROM events)"""


def sparse_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse series over years: an offer per part and supplier of lineitem."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("offer_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).alias("day"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_orderkey").alias("run"),
    )


SPARSE = """
sparse AS (SELECT l_partkey || '-' || l_suppkey AS offer_id, l_orderkey * 10 + l_linenumber AS seq,
  (l_shipdate::DATE - DATE '1970-01-01')::INT AS day, l_extendedprice / l_quantity AS price, l_orderkey AS run FROM lineitem)"""


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers of parts by suppliers, with titles and addresses."""
    pairs = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_type", "p_size")
    store = F.concat(F.lit("store_"), (F.col("l_suppkey") % 4).cast("string"))
    return pairs.join(part, "l_partkey").select(
        F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("offer_id"),
        store.alias("retailer"),
        F.col("l_partkey").cast("string").alias("sku"),
        F.concat_ws(" ", "p_name", "p_brand", F.lower("p_type"), F.concat(F.col("p_size").cast("string"), F.lit(" gb"))).alias("title"),
        F.concat(F.lit("https://www."), store, F.lit(".example.com/p/"), F.col("l_partkey").cast("string"), F.lit("/?utm_source=x&b=2&a="), F.col("l_suppkey").cast("string"), F.lit("#top")).alias("url"),
    )


OFFERS = """
offers AS (SELECT l_partkey || '-' || l_suppkey AS offer_id, 'store_' || (l_suppkey % 4) AS retailer, l_partkey::VARCHAR AS sku,
  p_name || ' ' || p_brand || ' ' || lower(p_type) || ' ' || p_size || ' gb' AS title,
  'https://www.store_' || (l_suppkey % 4) || '.example.com/p/' || l_partkey || '/?utm_source=x&b=2&a=' || l_suppkey || '#top' AS url
  FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN part ON p_partkey = l_partkey)"""


def watches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standing queries: one per part name and store of the first parts of a name, some for all stores."""
    p = read(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"), F.avg("p_retailprice").alias("mean"))
    k = F.col("k")
    return p.select(
        F.concat(F.lit("w"), k.cast("string")).alias("watch_id"),
        F.when(k % 3 == 0, "all").otherwise(F.concat(F.lit("store_"), (k % 4).cast("string"))).alias("site"),
        F.when(k % 7 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("query"),
        F.when(k % 2 == 0, F.round(F.col("mean") * 0.98, 2)).alias("target_price"),
        F.when(k % 5 == 0, 10.0).alias("min_drop_percent"),
        F.element_at(F.array(F.lit("aggressive"), F.lit("conservative"), F.lit("off")), (k % 3 + 1).cast("int")).alias("atl_policy"),
        (k % 4 * 12).cast("int").alias("cooldown_hours"),
        (k % 11 != 0).alias("enabled"),
        F.when(k % 4 == 0, F.array(F.lit("email"), F.lit("telegram"))).when(k % 4 == 1, F.array(F.lit("telegram"))).otherwise(F.array(F.lit("email"))).alias("channels"),
    )


WATCHES = """
watches AS (SELECT 'w' || k AS watch_id, CASE WHEN k % 3 = 0 THEN 'all' ELSE 'store_' || (k % 4) END AS site,
  CASE WHEN k % 7 = 0 THEN upper(p_name) ELSE p_name END AS query, CASE WHEN k % 2 = 0 THEN round(mean * 0.98, 2) END AS target_price,
  CASE WHEN k % 5 = 0 THEN 10.0::DOUBLE END AS min_drop_percent,
  CASE k % 3 WHEN 0 THEN 'aggressive' WHEN 1 THEN 'conservative' ELSE 'off' END AS atl_policy,
  (k % 4 * 12)::INT AS cooldown_hours, k % 11 <> 0 AS enabled,
  CASE k % 4 WHEN 0 THEN ['email','telegram'] WHEN 1 THEN ['telegram'] ELSE ['email'] END AS channels
  FROM (SELECT p_name, min(p_partkey) AS k, avg(p_retailprice) AS mean FROM part GROUP BY p_name))"""

SLOT_US = 1_800_000_000


def health(spark: SparkSession, sf_dir: str, slot_us: int = SLOT_US) -> DataFrame:
    """Raw fetch records: events by store and run (a slot of time)."""
    e = read(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(
        F.concat(F.lit("store_"), (F.col("user_id") % 4).cast("string")).alias("store"),
        F.floor(us / slot_us).cast("long").alias("run"),
        us.alias("us"),
        F.col("event_type").alias("kind"),
        F.col("value").alias("latency"),
        F.col("event_id").alias("seq"),
        ((F.col("event_type") == "signup") & (F.col("event_id") % 3 == 0)).alias("is_challenge"),
        ((F.col("event_type") == "signup") & (F.col("event_id") % 5 > 0)).alias("is_wait"),
        (F.col("event_id") % 31 == 0).alias("is_skipped"),
        (F.col("event_id") % 37 == 0).alias("is_blocked"),
        (F.col("event_id") % 3 + 1).alias("tries"),
        F.when(F.col("event_type") == "error", F.element_at(F.array(F.lit("timeout"), F.lit("no_price"), F.lit("changed_markup")), (F.col("event_id") % 3 + 1).cast("int"))).alias("reason"),
    )


HEALTH = f"""
fetches AS (SELECT 'store_' || (user_id % 4) AS store, (epoch_us(ts) // {SLOT_US})::BIGINT AS run, epoch_us(ts) AS us, event_type AS kind,
  value AS latency, event_id AS seq, event_type = 'signup' AND event_id % 3 = 0 AS is_challenge, event_type = 'signup' AND event_id % 5 > 0 AS is_wait, event_id % 31 = 0 AS is_skipped, event_id % 37 = 0 AS is_blocked, event_id % 3 + 1 AS tries,
  CASE WHEN event_type = 'error' THEN ['timeout', 'no_price', 'changed_markup'][event_id % 3 + 1] END AS reason FROM events)"""

LABELS = ("useful", "purchased", "fake_discount", "wrong_price", "duplicate")


def label_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presses of label buttons: several per alert and rater."""
    kinds = ("view", "purchase", "error", "click", "signup")
    label = F.create_map(*[F.lit(x) for pair in zip(kinds, LABELS, strict=True) for x in pair])
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), (F.col("event_id") % 200).alias("alert_id"), (F.col("user_id") % 10).alias("rater"),
        label[F.col("event_type")].alias("label"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.concat(F.lit("cb"), (F.col("event_id") % 4000).cast("string")).alias("callback_id"),
    )


LABEL_LOG = """
label_log AS (SELECT event_id AS seq, event_id % 200 AS alert_id, user_id % 10 AS rater,
  CASE event_type WHEN 'view' THEN 'useful' WHEN 'purchase' THEN 'purchased' WHEN 'error' THEN 'fake_discount'
                  WHEN 'click' THEN 'wrong_price' ELSE 'duplicate' END AS label, epoch_us(ts) AS us, 'cb' || (event_id % 4000) AS callback_id FROM events)"""


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only log of alert deliveries: event_id's latest record is its state."""
    status = F.create_map(*[F.lit(x) for x in ("F", "SENT", "O", "PENDING", "P", "DEAD_LETTER")])
    return read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("event_id"), F.col("o_orderkey").alias("seq"), status[F.col("o_orderstatus")].alias("status"),
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"), F.element_at(F.array(F.lit("telegram"), F.lit("email"), F.lit("sms")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("channel"),
        F.when(F.col("o_orderpriority") < "3", "deal").otherwise("health").alias("source"), F.col("o_totalprice").alias("price"),
        F.concat(F.lit("k"), (F.col("o_custkey") % 500).cast("string")).alias("dedup_key"),
    )


OUTBOX = """
outbox AS (SELECT o_custkey AS event_id, o_orderkey AS seq, CASE o_orderstatus WHEN 'F' THEN 'SENT' WHEN 'O' THEN 'PENDING' WHEN 'P' THEN 'DEAD_LETTER' END AS status,
  epoch_us(o_orderdate) AS us, CASE o_orderkey % 3 WHEN 0 THEN 'telegram' WHEN 1 THEN 'email' ELSE 'sms' END AS channel,
  CASE WHEN o_orderpriority < '3' THEN 'deal' ELSE 'health' END AS source, o_totalprice AS price, 'k' || (o_custkey % 500) AS dedup_key FROM orders)"""
