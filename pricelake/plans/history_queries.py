"""Queries of the observation history and of deal decisions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import deals, history
from ..sources.scratch import written
from . import adapters as A

#: The given events span 30 days, so queries over them use windows of 7 days.
DAYS = 7


def _obs(spark: SparkSession, d: str, step: float | None = None) -> DataFrame:
    obs = A.observations(spark, d)
    return obs.withColumn("price", F.ceil(F.col("price") / step) * F.lit(step)) if step else obs


def upsert_observations(spark: SparkSession, d: str) -> DataFrame:
    obs = A.observations(spark, d).select("offer_id", "us", "seq", "price")
    stored = obs.filter("seq % 3 < 2")
    incoming = obs.filter("seq % 3 > 0").withColumn("price", F.round(F.col("price") * 1.01, 4)).withColumn("seq", F.col("seq") + 1_000_000_000)
    return history.upsert_observations(stored, incoming.unionByName(incoming))


def upsert_dimensions(spark: SparkSession, d: str) -> DataFrame:
    part = A.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("category"))
    stored = part.filter("id % 3 <> 0")
    incoming = part.filter("id % 2 = 0").select("id", F.upper("title").alias("title"), F.when(F.col("id") % 4 == 0, F.lower("category")).alias("category"))
    return history.upsert_dimension(stored, incoming, "id", keep_if_null=("category",))


def latest_price(spark: SparkSession, d: str) -> DataFrame:
    return history.latest_price(A.observations(spark, d))


def latest_price_of_products(spark: SparkSession, d: str) -> DataFrame:
    obs = A.observations(spark, d)
    p = A.read(spark, d, "part")
    ids = obs.select("offer_id").distinct().select(F.col("offer_id").alias("id"), F.substring("offer_id", 2, 9).cast("int").alias("k"))
    offers = ids.unionByName(p.select(F.concat(F.lit("never"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_partkey").cast("int").alias("k")))
    offers = offers.select("id", F.concat(F.lit("p"), (F.col("k") % 97).cast("string")).alias("product_id"), F.concat(F.lit("sku"), F.col("k").cast("string")).alias("sku"))
    products = p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("category"))
    return history.latest_with_products(obs, offers, products)


def price_history(spark: SparkSession, d: str) -> DataFrame:
    obs = A.observations(spark, d)
    as_of = F.lit(1_706_659_200_000_000)  # 2024-01-31
    return history.price_history(obs, as_of, DAYS).select("offer_id", "us", "price")


def prune_history(spark: SparkSession, d: str) -> DataFrame:
    return history.prune_history(A.sparse_observations(spark, d)).select("offer_id", "seq", "day", "price")


def lifetime_stats(spark: SparkSession, d: str) -> DataFrame:
    return history.lifetime_stats(A.observations(spark, d))


def previous_price(spark: SparkSession, d: str) -> DataFrame:
    rows = history.with_prior(A.observations(spark, d))
    return rows.select("seq", "previous_price", "prior_low", F.round("drop_value", 4).alias("drop_value"), F.round("drop_percent", 4).alias("drop_percent"))


def reference_window(spark: SparkSession, d: str) -> DataFrame:
    rows = history.reference_window(A.observations(spark, d), DAYS)
    return rows.select("seq", "thirty_day_low", "window_n", "history_days")


def reference_window_sparse(spark: SparkSession, d: str) -> DataFrame:
    obs = A.sparse_observations(spark, d).groupBy("offer_id", "seq").agg(F.min("day").alias("day"), F.min("price").alias("price"))
    obs = obs.withColumn("us", F.col("day") * F.lit(86_400_000_000))
    return history.reference_window(obs, 365).select("offer_id", "seq", "thirty_day_low", "window_n")


def window_provenance(spark: SparkSession, d: str) -> DataFrame:
    rows = history.reference_window(A.observations(spark, d), 1)
    n = F.when(F.col("seq") % 10 != 0, F.col("window_n"))
    return rows.select(history.window_provenance(n).alias("provenance")).groupBy("provenance").agg(F.count("*").alias("n"))


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = A.sparse_observations(spark, d).select("offer_id", "day", "price", "seq", "run")
    s = s.withColumn("us", F.when(F.col("run") % 3 > 0, F.col("day") * F.lit(86_400_000_000) + F.col("run") % 5 * 3_600_000_000))
    s = s.withColumn("stock_status", F.when(F.col("run") % 2 == 0, "in_stock").when(F.col("run") % 3 == 0, "out_of_stock"))
    return s.filter("run % 4 <> 0"), s.filter("run % 4 <> 1 and run % 7 <> 0"), s.filter("run % 5 <> 0")


def merge_aliases(spark: SparkSession, d: str) -> DataFrame:
    a, b, _ = _sides(spark, d)
    return history.merge_aliases(a.drop("run"), b.drop("run"))


def _documents(spark: SparkSession, d: str) -> tuple[history.History, ...]:
    """Base, incoming and tip. Of parts by number: every 9th product is new in incoming, every 8th is unknown to incoming, every 7th to
    the tip, and every 6th has no row left in incoming."""
    part = F.substring_index("offer_id", "-", 1).cast("int")
    base, incoming, tip = (x.withColumn("k", part).withColumnRenamed("offer_id", "product_id") for x in _sides(spark, d))
    all_ids = written(A.sparse_observations(spark, d).select(F.col("offer_id").alias("product_id"), part.alias("k")).distinct(), "products")
    knows = {"base": F.col("k") % 9 > 0, "incoming": F.col("k") % 8 > 0, "tip": (F.col("k") % 7 > 0) & (F.col("k") % 9 > 0)}

    def document(name: str, rows: DataFrame) -> history.History:
        rows = rows.filter(knows[name])
        low = rows.groupBy("product_id").agg(F.min("price").alias("all_time_low"), F.max("price").alias("all_time_high"), F.min("day").alias("first_seen"))
        products = all_ids.filter(knows[name]).join(low, "product_id", "left").select("product_id", F.lit(1).alias("schema_version"), F.lit(name).alias("title"), "all_time_low", "all_time_high", "first_seen")
        return history.History(products, rows.filter("k % 6 > 0") if name == "incoming" else rows)

    return document("base", base), document("incoming", incoming), document("tip", tip)


def three_way_merge(spark: SparkSession, d: str) -> DataFrame:
    return history.three_way_merge(*_documents(spark, d)).rows.withColumnRenamed("product_id", "offer_id")


def three_way_merge_products(spark: SparkSession, d: str) -> DataFrame:
    """The products of the same merge, with the number of rows that each has."""
    base, incoming, tip = _documents(spark, d)
    rows = history.merged_copies(base, incoming, tip).groupBy("product_id").agg(F.sum("copies").alias("n"))
    return history.merge_products(incoming.products, tip.products).join(rows, "product_id", "left").select("product_id", "title", "all_time_low", "all_time_high", "first_seen", F.coalesce("n", F.lit(0)).alias("n"))


def merge_products(spark: SparkSession, d: str) -> DataFrame:
    def of(rows: DataFrame, title: str) -> DataFrame:
        return rows.groupBy(F.col("offer_id").alias("product_id")).agg(F.concat(F.lit(title), F.max("run").cast("string")).alias("title"), F.min("price").alias("all_time_low"), F.max("price").alias("all_time_high"), F.min("day").alias("first_seen"))

    base, incoming, tip = _sides(spark, d)
    return history.merge_products(of(incoming, "new "), of(tip, "old "))


def daily_series(spark: SparkSession, d: str) -> DataFrame:
    s = history.daily_series(A.observations(spark, d))
    text = F.array_join(F.transform("series", lambda x: F.concat_ws("=", x["day"].cast("string"), F.format_string("%.2f", x["price"]))), ";")
    return s.select("offer_id", "points", "drops", "low", "high", text.alias("series"))


def expand_watches(spark: SparkSession, d: str) -> DataFrame:
    stores = A.observations(spark, d).select(F.col("retailer").alias("store"), F.lit(False).alias("is_placeholder"))
    return deals.expand_watches(A.watches(spark, d), stores).select("watch_id", "store")


def _gated(spark: SparkSession, d: str) -> DataFrame:
    rows = history.with_prior(A.observations(spark, d))
    policy = F.element_at(F.array(*map(F.lit, deals.POLICIES)), (F.col("seq") % 3 + 1).cast("int"))
    target = F.when(F.col("seq") % 2 == 0, 60.0)
    least = F.when(F.col("seq") % 5 == 0, 30.0)
    gate = deals.alert_gate(F.col("previous_price"), F.col("price"), F.col("stock_status"), F.col("prior_low"), policy, target, least)
    return rows.withColumn("alerts", gate)


def alert_gate(spark: SparkSession, d: str) -> DataFrame:
    return _gated(spark, d).select("seq", "alerts")


def seller_policy_filter(spark: SparkSession, d: str) -> DataFrame:
    obs = A.observations(spark, d)
    policy = F.when(F.col("seq") % 2 == 0, "trusted").otherwise("any")
    marketplace = F.when(F.col("is_known_seller"), F.col("seq") % 3 == 0)
    return obs.withColumn("ok", deals.seller_allowed(policy, marketplace)).groupBy("retailer").agg(F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("blocked"))


def reference_price_verdict(spark: SparkSession, d: str) -> DataFrame:
    rows = deals.reference_price_verdict(A.observations(spark, d), DAYS)
    return rows.select("seq", "verdict", "discount_vs_old_pct", "discount_vs_30d_pct")


def verdict_counts(spark: SparkSession, d: str) -> DataFrame:
    return deals.reference_price_verdict(A.observations(spark, d), DAYS).groupBy("retailer", "verdict").agg(F.count("*").alias("n"))


def quarantine_invalid_baseline(spark: SparkSession, d: str) -> DataFrame:
    rows = history.reference_window(A.observations(spark, d), DAYS).withColumn("previous_price", F.when(F.col("seq") % 9 == 0, 0.0).otherwise(F.col("previous_price")))
    good, bad = deals.quarantine(rows)
    return good.select("retailer", F.lit("usable").alias("part")).unionByName(bad.select("retailer", F.lit("quarantined").alias("part"))).groupBy("retailer", "part").agg(F.count("*").alias("n"))


def window_statistics(spark: SparkSession, d: str) -> DataFrame:
    rows = deals.window_statistics(A.observations(spark, d), DAYS)
    r = lambda c: F.round(c, 6).alias(c)
    return rows.select("seq", "n", *[r(c) for c in ("median", "mean", "stdev", "p25", "p75", "trimmed_mean", "mad", "z_score")])


def genuine_savings(spark: SparkSession, d: str) -> DataFrame:
    rows = deals.window_median(A.observations(spark, d), DAYS)
    return rows.select("seq", F.round("genuine_savings", 6).alias("savings"), deals.legal_discount(F.col("genuine_savings")).alias("is_legal"))


def fake_discount(spark: SparkSession, d: str) -> DataFrame:
    rows = deals.window_median(A.observations(spark, d), DAYS)
    reasons = deals.fake_discount_reasons(F.col("price"), F.col("previous_price"), F.col("reference_price"), F.col("median"), F.col("window_low"))
    return rows.select("seq", F.array_join(reasons, ",").alias("reasons"))


def days_at_current_price(spark: SparkSession, d: str) -> DataFrame:
    return deals.days_at_current_price(_obs(spark, d, 50.0), DAYS).select("seq", F.col("days_at_price").cast("long").alias("days_at_price"))


def deal_badges(spark: SparkSession, d: str) -> DataFrame:
    rows = deals.window_median(A.observations(spark, d), DAYS)
    b = deals.badges(F.col("price") < F.col("prior_low"), deals.legal_discount(F.col("genuine_savings")), F.col("previous_price") > F.col("median") * deals.INFLATED, F.col("stock_status"))
    return rows.select("seq", F.array_join(b, ",").alias("badges"))


def rule_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = deals.reference_price_verdict(A.observations(spark, d), DAYS)
    text, score, good = deals.rule_summary(F.col("verdict"), F.col("discount_vs_30d_pct"), F.when(F.col("window_n") > 0, "genuine").otherwise("confirmed_empty"))
    return rows.select("seq", text.alias("summary"), score.alias("score"), good.alias("recommended"))


QUERIES = {f.__name__: f for f in (
    upsert_observations, upsert_dimensions, latest_price, latest_price_of_products, price_history, prune_history, lifetime_stats, previous_price, reference_window, reference_window_sparse, window_provenance,
    merge_aliases, three_way_merge, three_way_merge_products, merge_products, daily_series, expand_watches, alert_gate, seller_policy_filter, reference_price_verdict, verdict_counts, quarantine_invalid_baseline, window_statistics,
    genuine_savings, fake_discount, days_at_current_price, deal_badges, rule_summary,
)}

O, S, W = A.OBS, A.SPARSE, A.WATCHES
#: Each row with its window of earlier rows, by a self-join.
WIN = O + f""",
prior AS (SELECT a.seq, a.offer_id, a.retailer, a.us, a.day, a.price, a.stock_status, a.reference_price,
   lag(a.price) OVER w AS previous_price, min(a.price) OVER (PARTITION BY a.offer_id ORDER BY a.us, a.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_low,
   min(a.day) OVER (PARTITION BY a.offer_id) AS first_day FROM obs a WINDOW w AS (PARTITION BY a.offer_id ORDER BY a.us, a.seq)),
win AS (SELECT a.*, coalesce(b.window_low, a.previous_price) AS thirty_day_low, b.window_low, b.window_n, b.prices,
   CASE WHEN a.previous_price IS NULL THEN 0 ELSE a.day - a.first_day END AS history_days
   FROM prior a JOIN (SELECT a.seq, min(b.price) AS window_low, count(b.price) AS window_n, list(b.price ORDER BY b.price) FILTER (WHERE b.price IS NOT NULL) AS prices
     FROM obs a LEFT JOIN obs b ON b.offer_id = a.offer_id AND (b.us, b.seq) < (a.us, a.seq) AND b.day >= a.day - {DAYS} GROUP BY a.seq) b USING (seq)),
judged AS (SELECT *, round((previous_price - price) / previous_price * 100, 2) AS discount_vs_old_pct, round((thirty_day_low - price) / thirty_day_low * 100, 2) AS discount_vs_30d_pct,
   CASE WHEN history_days < 14 THEN 'INSUFFICIENT_HISTORY' WHEN price >= thirty_day_low THEN 'FALSE_DISCOUNT' WHEN reference_price > thirty_day_low * 1.25 THEN 'INFLATED_REFERENCE'
        WHEN round((thirty_day_low - price) / thirty_day_low * 100, 2) >= 5 THEN 'GENUINE_DEAL' ELSE 'NORMAL_DROP' END AS verdict FROM win WHERE previous_price > 0 AND thirty_day_low > 0),
stats AS (SELECT *, list_aggregate(prices, 'median') AS median, list_avg(prices) AS mean, (1 - price / nullif(window_low, 0)) * 100 AS savings FROM win)"""

SIDES = S + """,
both_ AS (SELECT offer_id, day, price, seq, run, split_part(offer_id, '-', 1)::INT AS k, CASE WHEN run % 3 > 0 THEN day * 86400000000::BIGINT + run % 5 * 3600000000 END AS us,
  CASE WHEN run % 2 = 0 THEN 'in_stock' WHEN run % 3 = 0 THEN 'out_of_stock' END AS stock_status FROM sparse),
s1 AS (SELECT * FROM both_ WHERE run % 4 <> 0), s2 AS (SELECT * FROM both_ WHERE run % 4 <> 1 AND run % 7 <> 0), s3 AS (SELECT * FROM both_ WHERE run % 5 <> 0)"""

#: Product by product: one that only one side has is taken whole; else tip rows that incoming did not remove, and incoming rows that are not in the base.
MERGED = SIDES + """,
known AS (SELECT offer_id, k % 8 > 0 AS of_incoming, k % 7 > 0 AND k % 9 > 0 AS of_tip FROM (SELECT DISTINCT offer_id, k FROM both_)),
b AS (SELECT DISTINCT offer_id, day, us, price, stock_status FROM s1 WHERE k % 9 > 0),
i AS (SELECT offer_id, day, us, price, stock_status FROM s2 WHERE k % 8 > 0 AND k % 6 > 0),
t AS (SELECT offer_id, day, us, price, stock_status FROM s3 WHERE k % 7 > 0 AND k % 9 > 0),
removed AS (SELECT * FROM b EXCEPT SELECT * FROM i),
added AS (SELECT i.* FROM i JOIN known USING (offer_id) WHERE of_tip AND NOT EXISTS (SELECT 1 FROM b WHERE b.offer_id = i.offer_id AND b.day = i.day AND b.price = i.price
  AND b.us IS NOT DISTINCT FROM i.us AND b.stock_status IS NOT DISTINCT FROM i.stock_status)),
merged AS (
  SELECT i.* FROM i JOIN known USING (offer_id) WHERE NOT of_tip
  UNION ALL SELECT t.* FROM t JOIN known USING (offer_id) WHERE NOT of_incoming
  UNION ALL SELECT * FROM added
  UNION ALL SELECT * FROM ((SELECT t.* FROM t JOIN known USING (offer_id) WHERE of_incoming EXCEPT SELECT * FROM removed) EXCEPT SELECT * FROM added))"""

SQL = {
    "upsert_observations": f"""WITH {O}, both_ AS (SELECT offer_id, us, seq, price FROM obs WHERE seq % 3 < 2
      UNION ALL SELECT offer_id, us, seq + 1000000000, round(price * 1.01, 4) FROM obs WHERE seq % 3 > 0)
      SELECT offer_id, us, seq, price FROM both_ QUALIFY row_number() OVER (PARTITION BY offer_id, us ORDER BY seq DESC) = 1""",
    "upsert_dimensions": """WITH s AS (SELECT p_partkey AS id, p_name AS title, p_type AS category FROM part WHERE p_partkey % 3 <> 0),
      n AS (SELECT p_partkey AS id, upper(p_name) AS title, CASE WHEN p_partkey % 4 = 0 THEN lower(p_type) END AS category FROM part WHERE p_partkey % 2 = 0)
      SELECT coalesce(n.id, s.id) AS id, CASE WHEN n.id IS NULL THEN s.title ELSE n.title END AS title, coalesce(n.category, s.category) AS category FROM s FULL JOIN n ON s.id = n.id""",
    "latest_price": f"WITH {O} SELECT offer_id, retailer, seq, us, price, stock_status FROM obs QUALIFY row_number() OVER (PARTITION BY offer_id ORDER BY us DESC, seq DESC) = 1",
    "latest_price_of_products": f"""WITH {O}, l AS (SELECT *, substr(offer_id, 2)::INT AS k FROM obs QUALIFY row_number() OVER (PARTITION BY offer_id ORDER BY us DESC, seq DESC) = 1)
      SELECT retailer, 'sku' || k AS sku, 'p' || (k % 97) AS product_id, p_name AS title, p_type AS category, us, price, stock_status FROM l JOIN part ON p_partkey = k % 97""",
    "price_history": f"WITH {O} SELECT offer_id, us, price FROM obs WHERE us >= 1706659200000000 - {DAYS} * 86400000000",
    "prune_history": f"""WITH {S}, r AS (SELECT *, max(day) OVER (PARTITION BY offer_id) AS m, row_number() OVER (PARTITION BY offer_id ORDER BY day DESC, seq DESC) AS back FROM sparse)
      SELECT offer_id, seq, day, price FROM r WHERE m - day <= 90 OR back <= 2""",
    "lifetime_stats": f"WITH {O} SELECT offer_id, min(price) AS all_time_low, max(price) AS all_time_high, min(day) AS first_seen, count(*) AS n FROM obs GROUP BY offer_id",
    "previous_price": f"WITH {WIN} SELECT seq, previous_price, prior_low, round(previous_price - price, 4) AS drop_value, round((previous_price - price) / nullif(previous_price, 0) * 100, 4) AS drop_percent FROM prior",
    "reference_window": f"WITH {WIN} SELECT seq, thirty_day_low, window_n, history_days FROM win",
    "reference_window_sparse": f"""WITH {S}, one AS (SELECT offer_id, seq, min(day) AS day, min(price) AS price FROM sparse GROUP BY ALL), prev AS (SELECT *, lag(price) OVER (PARTITION BY offer_id ORDER BY day, seq) AS p FROM one)
      SELECT a.offer_id, a.seq, coalesce(min(b.price), any_value(a.p)) AS thirty_day_low, count(b.price) AS window_n
      FROM prev a LEFT JOIN one b ON b.offer_id = a.offer_id AND (b.day, b.seq) < (a.day, a.seq) AND b.day >= a.day - 365 GROUP BY a.offer_id, a.seq""",
    "window_provenance": f"""WITH {O}, w AS (SELECT a.seq, count(b.seq) AS n FROM obs a LEFT JOIN obs b ON b.offer_id = a.offer_id AND (b.us, b.seq) < (a.us, a.seq) AND b.day >= a.day - 1 GROUP BY a.seq)
      SELECT CASE WHEN seq % 10 = 0 THEN 'unknown' WHEN n = 0 THEN 'confirmed_empty' ELSE 'genuine' END AS provenance, count(*) AS n FROM w GROUP BY 1""",
    "merge_aliases": f"""WITH {SIDES}, b AS (SELECT *, 0 AS side FROM s1 UNION ALL SELECT *, 1 FROM s2)
      SELECT offer_id, day, us, price, stock_status, seq FROM b QUALIFY row_number() OVER (PARTITION BY offer_id, day, us, price, stock_status ORDER BY side, seq) = 1""",
    "three_way_merge": f"WITH {MERGED} SELECT offer_id, day, us, price, stock_status FROM merged",
    "three_way_merge_products": f"""WITH {MERGED}, n AS (SELECT offer_id, count(*) AS n FROM merged GROUP BY offer_id),
      life AS (SELECT offer_id, 1 AS side, price, day FROM s2 WHERE k % 8 > 0 UNION ALL SELECT offer_id, 2, price, day FROM s3 WHERE k % 7 > 0 AND k % 9 > 0),
      ends AS (SELECT offer_id, min(price) AS all_time_low, max(price) AS all_time_high, min(day) AS first_seen FROM life GROUP BY offer_id)
      SELECT p.offer_id AS product_id, CASE WHEN of_incoming THEN 'incoming' ELSE 'tip' END AS title, all_time_low, all_time_high, first_seen, coalesce(n.n, 0) AS n
      FROM known p LEFT JOIN ends USING (offer_id) LEFT JOIN n ON n.offer_id = p.offer_id WHERE of_incoming OR of_tip""",
    "merge_products": f"""WITH {SIDES}, i AS (SELECT offer_id, 'new ' || max(run) AS title, min(price) AS lo, max(price) AS hi, min(day) AS d FROM s2 GROUP BY offer_id), t AS (SELECT offer_id, 'old ' || max(run) AS title, min(price) AS lo, max(price) AS hi, min(day) AS d FROM s3 GROUP BY offer_id)
      SELECT coalesce(i.offer_id, t.offer_id) AS product_id, coalesce(i.title, t.title) AS title, least(i.lo, t.lo) AS all_time_low, greatest(i.hi, t.hi) AS all_time_high, least(i.d, t.d) AS first_seen FROM i FULL JOIN t ON i.offer_id = t.offer_id""",
    "daily_series": f"""WITH {O}, l AS (SELECT offer_id, day, price FROM obs QUALIFY row_number() OVER (PARTITION BY offer_id, day ORDER BY us DESC, seq DESC) = 1),
      x AS (SELECT *, coalesce(price < lag(price) OVER (PARTITION BY offer_id ORDER BY day), false) AS is_drop FROM l)
      SELECT offer_id, count(*) AS points, count(*) FILTER (WHERE is_drop) AS drops, min(price) AS low, max(price) AS high,
        string_agg(day || '=' || printf('%.2f', price), ';' ORDER BY day) AS series FROM x GROUP BY offer_id HAVING count(*) >= 3""",
    "expand_watches": f"WITH {O}, {W}, stores AS (SELECT DISTINCT retailer AS store FROM obs) SELECT watch_id, site AS store FROM watches WHERE enabled AND site <> 'all' UNION ALL SELECT watch_id, store FROM watches, stores WHERE enabled AND site = 'all'",
    "alert_gate": f"""WITH {WIN}, g AS (SELECT *, CASE seq % 3 WHEN 0 THEN 'aggressive' WHEN 1 THEN 'conservative' ELSE 'off' END AS policy, previous_price - price >= 5 AND (previous_price - price) / nullif(previous_price, 0) * 100 >= 2 AS floor_ FROM prior)
      SELECT seq, CASE WHEN previous_price IS NULL OR price >= previous_price OR stock_status = 'out_of_stock' THEN false
        WHEN coalesce(price < prior_low, false) AND policy = 'aggressive' THEN true WHEN coalesce(price < prior_low, false) AND policy = 'conservative' AND floor_ THEN true
        WHEN NOT floor_ THEN false WHEN seq % 2 = 0 AND price > 60 THEN false WHEN seq % 5 = 0 AND (previous_price - price) / nullif(previous_price, 0) * 100 < 30 THEN false ELSE true END AS alerts FROM g""",
    "seller_policy_filter": f"""WITH {O}, m AS (SELECT retailer, seq % 2 <> 0 OR CASE WHEN is_known_seller THEN seq % 3 = 0 END IS NOT DISTINCT FROM false AS ok FROM obs)
      SELECT retailer, count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE NOT ok) AS blocked FROM m GROUP BY retailer""",
    "reference_price_verdict": f"WITH {WIN} SELECT seq, verdict, discount_vs_old_pct, discount_vs_30d_pct FROM judged",
    "verdict_counts": f"WITH {WIN} SELECT retailer, verdict, count(*) AS n FROM judged GROUP BY ALL",
    "quarantine_invalid_baseline": f"""WITH {WIN} SELECT retailer, CASE WHEN coalesce(CASE WHEN seq % 9 = 0 THEN 0 ELSE previous_price END > 0 AND thirty_day_low > 0, false) THEN 'usable' ELSE 'quarantined' END AS part, count(*) AS n FROM win GROUP BY ALL""",
    "window_statistics": f"""WITH {WIN}, x AS (SELECT *, floor(window_n * 0.05)::INT AS cut FROM stats)
      SELECT seq, window_n::INT AS n, round(median, 6) AS median, round(mean, 6) AS mean, round(list_aggregate(prices, 'stddev_samp'), 6) AS stdev, round(list_aggregate(prices, 'quantile_cont', 0.25), 6) AS p25,
        round(list_aggregate(prices, 'quantile_cont', 0.75), 6) AS p75, round(list_avg(prices[cut + 1 : window_n - cut]), 6) AS trimmed_mean,
        round(list_aggregate(list_transform(prices, lambda p: abs(p - median)), 'median'), 6) AS mad,
        round(CASE WHEN list_aggregate(prices, 'stddev_samp') > 0 THEN (price - mean) / list_aggregate(prices, 'stddev_samp') END, 6) AS z_score FROM x""",
    "genuine_savings": f"WITH {WIN} SELECT seq, round(savings, 6) AS savings, savings > 0 AS is_legal FROM stats",
    "fake_discount": f"""WITH {WIN} SELECT seq, concat_ws(',', CASE WHEN price >= window_low AND reference_price > median * 1.25 THEN 'ADVERTISED_ORIGINAL_INFLATED' END,
        CASE WHEN price >= window_low AND previous_price > median * 1.25 AND price < previous_price THEN 'OBSERVED_PRE_SALE_HIKE' END) AS reasons FROM stats""",
    "days_at_current_price": f"""WITH {O}, p AS (SELECT seq, offer_id, us, day, ceil(price / 50) * 50.0 AS price FROM obs),
      brk AS (SELECT a.seq, max_by(struct_pack(us := b.us, seq := b.seq), struct_pack(us := b.us, seq := b.seq)) FILTER (WHERE b.price <> a.price) AS other
        FROM p a LEFT JOIN p b ON b.offer_id = a.offer_id AND (b.us, b.seq) < (a.us, a.seq) GROUP BY a.seq)
      SELECT a.seq, (a.day - coalesce(min(b.day), a.day))::BIGINT AS days_at_price FROM p a JOIN brk USING (seq)
      LEFT JOIN p b ON b.offer_id = a.offer_id AND (b.us, b.seq) < (a.us, a.seq) AND b.day >= a.day - {DAYS} AND (brk.other IS NULL OR (b.us, b.seq) > (brk.other.us, brk.other.seq))
      GROUP BY a.seq, a.day""",
    "deal_badges": f"""WITH {WIN} SELECT seq, concat_ws(',', CASE WHEN price < prior_low THEN 'all_time_low' END, CASE WHEN savings > 0 THEN 'legal_discount' END,
        CASE WHEN previous_price > median * 1.25 THEN 'pre_sale_hike' END, CASE WHEN stock_status = 'limited_stock' THEN 'limited_stock' END) AS badges FROM stats""",
    "rule_summary": f"""WITH {WIN} SELECT seq, printf('%s: %.2f%% against the %s', verdict, discount_vs_30d_pct, CASE WHEN window_n > 0 THEN '30-day low' ELSE 'last price (no rows in 30 days)' END) AS summary,
        CASE WHEN verdict = 'GENUINE_DEAL' THEN 8 ELSE 4 END AS score, verdict = 'GENUINE_DEAL' AS recommended FROM judged""",
}
