"""Queries of prompts and answers, and of the joined observations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import anomaly, deals, responses
from . import adapters as A
from .history_queries import DAYS, WIN

TOKEN = "bot12345:" + "A" * 35
#: Answers of a model, by turns: (text, None if it is good, else what is wrong with it).
GOOD = '{"verdict": "GENUINE_DEAL", "verdict_score": 7, "summary": "Fine. ' + TOKEN + '", "is_recommended": true}'
ANSWERS: tuple[tuple[str | None, str | None], ...] = (
    (GOOD, None),
    (f"Sure:\n```json\n{GOOD}\n``` done", None),
    (f"Here you are {GOOD} bye", None),
    (None, ""),
    ("no object at all", "_malformed_output"),
    ('{"verdict": "GENUINE_DEAL", "verdict_score": 7, "summary": "x"}', "_malformed_output"),
    ('{"verdict": "GENUINE_DEAL", "verdict_score": 7, "summary": "x", ', "_malformed_output"),
    (GOOD.replace("7", "11"), "_schema_invalid"),
    (GOOD.replace("7", "0"), "_schema_invalid"),
    (GOOD.replace("GENUINE_DEAL", "SUPER_DEAL"), "_schema_invalid"),
    (GOOD.replace("Fine.", "<b>Fine</b>"), "_schema_invalid"),
    (GOOD.replace("Fine.", "Fine. " * 90), "_schema_invalid"),
    (GOOD.replace('"Fine. ' + TOKEN + '"', '""'), "_schema_invalid"),
    (GOOD.replace("true", '"maybe"'), "_schema_invalid"),
    (GOOD.replace("7", '"7"'), None),
    (GOOD.replace("GENUINE_DEAL", "FALSE_DISCOUNT").replace("true", "false"), None),
    ("[1, 2]", "_malformed_output"),
    (GOOD.replace("7", "7.5"), "_schema_invalid"),
)
HARD = "<b>javasc<ript:x</b> da<ta: jajavascript:vascript:y "


def build_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts of documents as titles that try to break out."""
    docs, k = A.read(spark, d, "documents"), F.col("doc_id")
    provenance = F.element_at(F.array(*map(F.lit, responses.BASIS)), (k % 3 + 1).cast("int"))
    price = (k % 900 + 100).cast("double")
    prompt = responses.build_prompt(F.concat(F.lit(HARD), "text"), F.col("source"), F.when(k % 4 == 0, "Some Seller"), price, price * 2, F.when(k % 5 > 0, price * 1.5), F.when(k % 2 == 0, price * 3), (k % 40).cast("int"), F.lit("NORMAL_DROP"), provenance)
    return docs.select("doc_id", prompt.alias("prompt"))


def _answered(spark: SparkSession, d: str) -> DataFrame:
    rows = deals.reference_price_verdict(A.observations(spark, d), DAYS)
    pick = (F.col("seq") % len(ANSWERS) + 1).cast("int")
    raw = F.element_at(F.array(*[F.lit(a).cast("string") for a, _ in ANSWERS]), pick)
    path = F.when(raw.isNull(), "both_failed").when(F.col("seq") % 2 == 0, "first").otherwise("second")
    provenance = F.when(F.col("window_n") > 0, "genuine").otherwise("confirmed_empty")
    rows = rows.withColumn("raw", raw).withColumn("provenance", provenance)
    return rows.withColumn("result", responses.validate_response(F.col("raw"), path, F.col("verdict"), F.col("discount_vs_30d_pct"), F.col("provenance")))


def validate_model_responses(spark: SparkSession, d: str) -> DataFrame:
    return _answered(spark, d).select("seq", "result.verdict", "result.verdict_score", "result.summary", "result.is_recommended", "result.fallback_path")


def response_audit(spark: SparkSession, d: str) -> DataFrame:
    return _answered(spark, d).select("seq", *responses.response_audit(F.concat_ws(":", F.lit("prompt"), "seq"), F.col("raw"), F.col("result")))


def redact_secrets(spark: SparkSession, d: str) -> DataFrame:
    """Texts of documents, with a secret planted in some."""
    k = F.col("doc_id")
    planted = F.when(k % 5 == 0, TOKEN).when(k % 5 == 1, "hf_" + "b1" * 12).when(k % 5 == 2, "6BA7B811-9dad-11d1-80b4-00c04fd430c8").when(k % 5 == 3, "bot1234:" + "A" * 35).otherwise("hf_short")
    text = F.concat_ws(" ", "text", F.concat(F.lit("("), planted, F.lit(")")))
    docs = A.read(spark, d, "documents").withColumn("text", text)
    return docs.select("doc_id", F.md5(T.redact_secrets(F.col("text")).cast("binary")).alias("clean"), *[c.cast("long").alias(n) for n, c in T.secret_hits(F.col("text")).items()])


def load_observations(spark: SparkSession, d: str) -> DataFrame:
    obs = A.observations(spark, d)
    at = F.timestamp_micros("us")
    said = F.when(F.col("seq") % 3 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).when(F.col("seq") % 3 == 1, F.concat(F.date_format(at + F.expr("interval 2 hours"), "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+02:00"))).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    said = F.when(F.col("seq") % 11 == 0, F.date_format(at, "yyyy-MM-dd")).otherwise(said)
    offers = obs.filter("seq % 4 > 0").select(F.col("offer_id").alias("id"), "retailer", F.concat(F.lit("https://example.com/"), "offer_id").alias("url")).distinct()
    return anomaly.load_observations(obs.select("offer_id", "price", said.alias("scraped_at")), offers)


QUERIES = {f.__name__: f for f in (build_prompts, validate_model_responses, response_audit, redact_secrets, load_observations)}

_q = lambda s: "NULL" if s is None else "'" + s.replace("'", "''") + "'"
CASES = f"""c AS (SELECT *, seq % {len(ANSWERS)} AS k FROM judged),
told AS (SELECT seq, verdict, list_extract([{', '.join(_q(a) for a, _ in ANSWERS)}], (k + 1)::INT) AS raw, list_extract([{', '.join(_q(w) for _, w in ANSWERS)}], (k + 1)::INT) AS wrong, k, verdict = 'GENUINE_DEAL' AS good,
  printf('%s: %.2f%% against the %s', verdict, discount_vs_30d_pct, CASE WHEN window_n > 0 THEN '30-day low' ELSE 'last price (no rows in 30 days)' END) AS rule FROM c),
judged2 AS (SELECT *, CASE WHEN raw IS NULL THEN 'both_failed' WHEN seq % 2 = 0 THEN 'first' ELSE 'second' END || coalesce(wrong, '') AS path, CASE WHEN wrong IS NULL THEN 7 WHEN good THEN 8 ELSE 4 END AS score,
  CASE WHEN wrong IS NULL THEN 'Fine. {TOKEN}' ELSE rule END AS summary FROM told)"""
_clean = f"'{HARD}' || text"
for _ in range(8):
    _clean = f"regexp_replace({_clean}, '(?i)[<>]|javascript:|data:', '', 'g')"
_n = lambda x: f"coalesce(printf('%.2f', {x}), 'none')"
_redacted = "t"
for _s in T.SECRETS.values():
    _redacted = f"regexp_replace({_redacted}, '{_s}', '[REDACTED]', 'g')"
SQL = {
    "build_prompts": f"""WITH x AS (SELECT *, (doc_id % 900 + 100)::DOUBLE AS p, substr(regexp_replace({_clean}, '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g'), 1, 200) AS title FROM documents)
      SELECT doc_id, 'Offer: ' || title || ' at ' || source || ', seller ' || CASE WHEN doc_id % 4 = 0 THEN 'Some Seller' ELSE 'not verified' END || chr(10)
        || 'New price ' || {_n('p')} || ', previous price ' || {_n('p * 2')} || chr(10)
        || CASE doc_id % 3 WHEN 0 THEN 'Lowest price of the last 30 days' WHEN 1 THEN 'Last price seen (no rows in the last 30 days)' ELSE 'Reference price (30-day history not confirmed)' END || ': ' || {_n('CASE WHEN doc_id % 5 > 0 THEN p * 1.5 END')} || chr(10)
        || 'Advertised price: ' || {_n('CASE WHEN doc_id % 2 = 0 THEN p * 3 END')} || '; days of history: ' || (doc_id % 40) || chr(10) || 'Verdict by rule: NORMAL_DROP' || chr(10)
        || 'Answer with one JSON object with the fields verdict, verdict_score, summary, is_recommended; the verdict is given, the score is 1 to 10, the summary is one or two sentences.' AS prompt FROM x""",
    "validate_model_responses": f"WITH {WIN}, {CASES} SELECT seq, verdict, score AS verdict_score, summary, good AS is_recommended, path AS fallback_path FROM judged2",
    "response_audit": f"""WITH {WIN}, {CASES} SELECT seq, sha256('prompt:' || seq) AS inputs_hash, sha256(raw) AS raw_output_hash,
      CASE WHEN wrong IS NULL THEN '{{"verdict":"' || verdict || '","verdict_score":7,"summary":"Fine. [REDACTED]","is_recommended":' || good || '}}' END AS parsed_result, path AS fallback_path, verdict AS final_verdict, good AS final_is_recommended FROM judged2""",
    "redact_secrets": f"""WITH x AS (SELECT doc_id, concat_ws(' ', text, '(' || CASE doc_id % 5 WHEN 0 THEN '{TOKEN}' WHEN 1 THEN 'hf_{"b1" * 12}' WHEN 2 THEN '6BA7B811-9dad-11d1-80b4-00c04fd430c8' WHEN 3 THEN 'bot1234:{"A" * 35}' ELSE 'hf_short' END || ')') AS t FROM documents)
      SELECT doc_id, md5({_redacted}) AS clean, {', '.join(f"len(regexp_extract_all(t, '{p}')) AS {n}" for n, p in T.SECRETS.items())} FROM x""",
    "load_observations": f"""WITH {A.OBS}, o AS (SELECT DISTINCT offer_id, retailer, 'https://example.com/' || offer_id AS url FROM obs WHERE seq % 4 > 0)
      SELECT o.offer_id, o.retailer, o.url, obs.price, CASE WHEN seq % 11 = 0 THEN us - us % 86400000000 ELSE us END AS us FROM obs JOIN o USING (offer_id)""",
}
