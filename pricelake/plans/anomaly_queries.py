"""Queries of the anomaly pipeline, with their SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import anomaly, delivery, feedback
from ..sources.scratch import written
from . import adapters as A
from .operations_queries import CUR, uuid5


def causal_features(spark: SparkSession, d: str) -> DataFrame:
    rows = anomaly.causal_features(A.observations(spark, d))
    return rows.select("seq", *[F.round(c, 6).alias(c) for c in anomaly.FEATURES])


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Alerts were decided on every third observation, some with their price spelled whole; raters labelled those of the first 200
    observations, even ones."""
    obs = A.observations(spark, d).withColumn("price", F.when(F.col("seq") % 4 == 0, F.floor("price").cast("double")).otherwise(F.col("price")))
    rows = anomaly.causal_features(obs)
    ids = delivery.candidate_decision_ids(F.col("offer_id"), F.col("price"), F.col("retailer"))
    spelled = F.when(F.col("seq") % 8 == 0, F.col("price").cast("long").cast("string")).otherwise(delivery.price_text(F.col("price")))
    alerts = obs.select("seq", delivery.decision_id(delivery.dedup_key(F.col("offer_id"), spelled, F.col("retailer"))).alias("id"))
    votes = feedback.vote_labels(A.label_log(spark, d)).filter("alert_id % 2 = 0").select(F.col("alert_id").alias("seq"), "label")
    labels = alerts.join(votes, "seq").groupBy("id").agg(F.max("label").alias("label"))  # one offer can alert twice at one price
    return anomaly.attach_outcomes(rows, ids, alerts.filter("seq % 3 = 0").select("id"), labels)


def attach_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return _outcomes(spark, d).select("seq", "deterministic_alert", F.col("label").cast("string").alias("label"))


def chronological_split(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.chronological_split(anomaly.causal_features(A.observations(spark, d))).select("seq", "part")


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    """A flag and a score that SQL can state too."""
    rows = _outcomes(spark, d)
    return rows.withColumn("forest", F.col("drop_pct") > 50).withColumn("pelt_flag", F.col("relative_to_30d_median") < -0.5).withColumn("score", -F.round(F.greatest(F.col("drop_pct"), F.lit(0.0)), 2) / 200)


def ensemble_volumes(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.ensemble_volumes(_flagged(spark, d))


def retailer_slices(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.ensemble_volumes(_flagged(spark, d), "retailer")


def labelled_metrics(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.labelled_metrics(_flagged(spark, d).filter("label is not null").withColumn("flag", F.col("forest") | F.col("pelt_flag")))


def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.average_precision(_flagged(spark, d).filter("label is not null"))


def bootstrap_intervals(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.bootstrap_intervals(_flagged(spark, d).filter("label is not null").withColumn("flag", F.col("forest") | F.col("pelt_flag")))


def top_flagged(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.top_flagged(_flagged(spark, d)).select("seq", "score")


def select_threshold(spark: SparkSession, d: str) -> DataFrame:
    """What the best F1 threshold flags; no gate, so that few labels give a threshold too."""
    rows = written(_flagged(spark, d).select("score", "label"), "scored")
    best = anomaly.best_f1(rows.filter("label is not null")).withColumnRenamed("score", "best")
    return rows.join(F.broadcast(best)).groupBy((F.col("score") <= F.col("best")).alias("flagged")).agg(F.count("*").alias("n"))


def select_threshold_quantile(spark: SparkSession, d: str) -> DataFrame:
    rows = _flagged(spark, d)
    cut = anomaly.select_threshold(rows, "quantile", quantile=0.25)
    return rows.groupBy((F.col("score") <= cut).alias("flagged")).agg(F.count("*").alias("n"))


def data_profile(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.data_profile(A.observations(spark, d))


def isolation_forest(spark: SparkSession, d: str) -> DataFrame:
    rows = anomaly.chronological_split(written(anomaly.causal_features(A.observations(spark, d)).select("seq", "us", *anomaly.FEATURES), "features"))
    model = anomaly.fit_forest(rows.filter("part = 'train'"))
    return anomaly.score_rows(rows.select("seq", "part", *anomaly.FEATURES), model).select("seq", "part", "score")


def pelt_drop_flag(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.pelt_drop_flag(A.observations(spark, d))


QUERIES = {f.__name__: f for f in (
    causal_features, attach_outcomes, chronological_split, ensemble_volumes, retailer_slices, labelled_metrics, average_precision, bootstrap_intervals, top_flagged, select_threshold, select_threshold_quantile, data_profile,
    isolation_forest, pelt_drop_flag,
)}

D = anomaly.DAY
FEAT = A.OBS + f""",
s AS (SELECT *, lag(price) OVER w AS prev, row_number() OVER w AS rn, CASE WHEN row_number() OVER w = 1 OR price <> lag(price) OVER w THEN us END AS changed FROM obs WINDOW w AS (PARTITION BY offer_id ORDER BY us, seq)),
feat AS (SELECT a.seq, a.offer_id, a.retailer, a.us, a.price, any_value(a.prev) AS prev, median(b.price) FILTER (WHERE b.us < a.us AND b.us >= a.us - 30 * {D}) AS med, count(*) FILTER (WHERE b.us >= a.us - 7 * {D}) AS n7,
  avg(b.price) FILTER (WHERE b.us >= a.us - 7 * {D}) AS mean7, stddev_pop(b.price) FILTER (WHERE b.us >= a.us - 7 * {D}) AS sd7, max(b.changed) FILTER (WHERE b.us < a.us) AS since
  FROM s a JOIN s b ON b.offer_id = a.offer_id AND b.us <= a.us WHERE a.rn > 1 GROUP BY a.seq, a.offer_id, a.retailer, a.us, a.price),
f AS (SELECT seq, offer_id, retailer, us, price, CASE WHEN prev > 0 THEN (prev - price) / prev * 100 ELSE 0 END AS drop_pct, CASE WHEN med > 0 THEN price / med - 1 ELSE 0 END AS relative_to_30d_median,
  CASE WHEN n7 >= 2 AND mean7 > 0 THEN sd7 / mean7 ELSE 0 END AS volatility_score_7d, (us // 3600000000 % 24)::DOUBLE AS hour_of_day, (us - since) / {D} AS days_since_last_change FROM feat)"""
#: The same with whole prices at every fourth row.
STAGED = FEAT.replace("FROM obs WINDOW", "FROM (SELECT * REPLACE (CASE WHEN seq % 4 = 0 THEN floor(price) ELSE price END AS price) FROM obs) WINDOW")
OUT = STAGED + ", " + CUR + f""",
v AS (SELECT alert_id AS id, (sum(CASE WHEN label IN ('useful','purchased') THEN 1 WHEN label IN ('fake_discount','wrong_price') THEN -1 ELSE 0 END) > 0)::INT AS label FROM cur WHERE alert_id % 2 = 0 GROUP BY alert_id
  HAVING sum(CASE WHEN label IN ('useful','purchased') THEN 1 WHEN label IN ('fake_discount','wrong_price') THEN -1 ELSE 0 END) <> 0),
al AS (SELECT seq, {uuid5("'alert-decision:' || sha256(offer_id || ':' || CASE WHEN seq % 8 = 0 THEN price::BIGINT::VARCHAR ELSE price::VARCHAR END || ':' || retailer)")} AS id
  FROM (SELECT seq, offer_id, retailer, CASE WHEN seq % 4 = 0 THEN floor(price) ELSE price END AS price FROM obs)),
dec AS (SELECT DISTINCT id FROM al WHERE seq % 3 = 0), lab AS (SELECT al.id, max(v.label) AS label FROM al JOIN v ON v.id = al.seq GROUP BY al.id),
fi AS (SELECT *, {uuid5("'alert-decision:' || sha256(offer_id || ':' || price::VARCHAR || ':' || retailer)")} AS id1, CASE WHEN price = floor(price) THEN {uuid5("'alert-decision:' || sha256(offer_id || ':' || price::BIGINT || ':' || retailer)")} END AS id2 FROM f),
o AS (SELECT fi.*, coalesce(id1 IN (SELECT id FROM dec), false) OR coalesce(id2 IN (SELECT id FROM dec), false) AS deterministic_alert, coalesce(a.label, b.label) AS label,
  drop_pct > 50 AS forest, relative_to_30d_median < -0.5 AS pelt_flag, -round(greatest(drop_pct, 0), 2) / 200 AS score FROM fi LEFT JOIN lab a ON a.id = id1 LEFT JOIN lab b ON b.id = id2)"""
VOL = """count(*) AS rows, count(*) FILTER (WHERE forest) AS forest, count(*) FILTER (WHERE pelt_flag) AS pelt, count(*) FILTER (WHERE forest AND pelt_flag) AS confirmed, count(*) FILTER (WHERE forest <> pelt_flag) AS disagree,
  count(*) FILTER (WHERE forest AND pelt_flag AND NOT deterministic_alert) AS model_only, count(*) FILTER (WHERE NOT (forest AND pelt_flag) AND deterministic_alert) AS policy_only, count(label) AS labelled,
  round(count(*) FILTER (WHERE forest AND pelt_flag) / count(*), 6) AS flag_rate"""
SQL = {
    "causal_features": f"WITH {FEAT} SELECT seq, " + ", ".join(f"round({c}, 6) AS {c}" for c in anomaly.FEATURES) + " FROM f",
    "attach_outcomes": f"WITH {OUT} SELECT seq, deterministic_alert, label::VARCHAR AS label FROM o",
    "chronological_split": f"""WITH {FEAT}, r AS (SELECT *, row_number() OVER (ORDER BY us, offer_id) - 1 AS k, count(*) OVER () AS n FROM f), a AS (SELECT min(us) AS us FROM r WHERE k = least(floor(n * 0.6), n - 1)), b AS (SELECT min(us) AS us FROM r WHERE k = least(floor(n * (0.6 + 0.2)), n - 1))
      SELECT seq, CASE WHEN f.us < a.us THEN 'train' WHEN f.us < b.us THEN 'validation' ELSE 'test' END AS part FROM f, a, b""",
    "ensemble_volumes": f"WITH {OUT} SELECT {VOL} FROM o",
    "retailer_slices": f"WITH {OUT} SELECT retailer, {VOL} FROM o GROUP BY retailer",
    "labelled_metrics": f"""WITH {OUT}, x AS (SELECT forest OR pelt_flag AS flag, label FROM o WHERE label IS NOT NULL)
      SELECT count(*) AS labelled, round(count(*) FILTER (WHERE flag AND label = 1) / nullif(count(*) FILTER (WHERE flag), 0), 4) AS precision, round(count(*) FILTER (WHERE flag AND label = 1) / nullif(count(*) FILTER (WHERE label = 1), 0), 4) AS recall,
        CASE WHEN count(*) < 30 THEN 'too_few' WHEN count(DISTINCT label) < 2 THEN 'single_class' ELSE 'ok' END AS gate FROM x""",
    "average_precision": f"""WITH {OUT}, x AS (SELECT label, row_number() OVER w AS rank, sum(label) OVER (ORDER BY score, seq ROWS UNBOUNDED PRECEDING) AS hits FROM o WHERE label IS NOT NULL WINDOW w AS (ORDER BY score, seq))
      SELECT count(*) AS n, sum(label)::BIGINT AS positives, round(sum(CASE WHEN label = 1 THEN hits / rank END) / sum(label), 6) AS average_precision FROM x""",
    "top_flagged": f"WITH {OUT} SELECT seq, score FROM o WHERE forest AND pelt_flag ORDER BY score, seq LIMIT 20",
    "select_threshold": f"""WITH {OUT}, x AS (SELECT score, sum(label) AS pos, count(*) AS n FROM o WHERE label IS NOT NULL GROUP BY score), y AS (SELECT score, sum(pos) OVER (ORDER BY score) AS tp, sum(n) OVER (ORDER BY score) AS flagged, (SELECT sum(pos) FROM x) AS p FROM x),
      b AS (SELECT score FROM y ORDER BY 2 * tp / (flagged + p) DESC, score DESC LIMIT 1) SELECT o.score <= b.score AS flagged, count(*) AS n FROM o, b GROUP BY 1""",
    "select_threshold_quantile": f"WITH {OUT}, q AS (SELECT quantile_cont(score, 0.25) AS cut FROM o) SELECT score <= cut AS flagged, count(*) AS n FROM o, q GROUP BY 1",
    "data_profile": f"""WITH {A.OBS} SELECT count(*) AS rows, count(DISTINCT offer_id) AS offers, count(DISTINCT retailer) AS retailers, min(us) AS first_us, max(us) AS last_us, round(avg((us % {D} = 0)::INT), 6) AS at_midnight,
      sum(('0x' || substr(md5(offer_id || ':' || us || ':' || printf('%.6f', price)), 1, 12))::BIGINT)::VARCHAR AS fingerprint FROM obs""",
}
