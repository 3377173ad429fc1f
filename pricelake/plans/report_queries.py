"""Queries of retrospective metrics and watchlist quality, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import deals, history, retro, watchlist
from ..sources.scratch import written
from . import adapters as A
from .history_queries import DAYS, WIN
from .operations_queries import CUR, EFF, H, L, NOW, W, WEEK, X, _health

START, END = 1_704_067_200_000_000, 1_706_659_200_000_000
SUFFIXES = ("example.com", "example.org")


def scrape_totals(spark: SparkSession, d: str) -> DataFrame:
    return retro.scrape_totals(retro.within(_health(spark, d), "started_us", START, END))


def slot_coverage(spark: SparkSession, d: str) -> DataFrame:
    return retro.slot_coverage(A.observations(spark, d).filter("price > 120"), START, END, A.SLOT_US)


def retailer_ranking(spark: SparkSession, d: str) -> DataFrame:
    return retro.retailer_ranking(_health(spark, d)).join(retro.failure_reasons(A.health(spark, d)), "store", "left")


def outbox_metrics(spark: SparkSession, d: str) -> DataFrame:
    return retro.outbox_metrics(A.outbox(spark, d))


def delivery_metrics(spark: SparkSession, d: str) -> DataFrame:
    return retro.delivery_metrics(A.outbox(spark, d))


def feedback_acceptance(spark: SparkSession, d: str) -> DataFrame:
    return retro.feedback_acceptance(A.label_log(spark, d))


def _savings(spark: SparkSession, d: str) -> DataFrame:
    rows = deals.window_median(A.observations(spark, d), DAYS).filter("seq % 7 <> 0")
    return retro.savings_estimate(rows, A.label_log(spark, d).filter("label = 'purchased'"))


def savings_estimate(spark: SparkSession, d: str) -> DataFrame:
    return _savings(spark, d)


def workflow_success(spark: SparkSession, d: str) -> DataFrame:
    o = A.read(spark, d, "orders")
    return retro.workflow_success(o.select(F.col("o_orderpriority").alias("event"), F.when(F.col("o_orderstatus") == "P", "running").otherwise("completed").alias("status"), F.when(F.col("o_orderkey") % 6 == 0, "failure").otherwise("success").alias("conclusion")))


def retro_report(spark: SparkSession, d: str) -> DataFrame:
    parts = {"scrape": scrape_totals(spark, d), "coverage": slot_coverage(spark, d), "feedback": feedback_acceptance(spark, d), "savings": _savings(spark, d), "none": retro.scrape_totals(_health(spark, d).filter("run < 0"))}
    out = None
    for name, df in parts.items():
        rows = retro.long_form(name, df)
        out = rows if out is None else out.unionByName(rows)
    inputs = {"fetches": A.health(spark, d), "labels": A.label_log(spark, d), "outbox": A.outbox(spark, d), "runs": None}
    return out.unionByName(retro.manifest(inputs)).unionByName(retro.evidence(out))


def _listing(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return A.watches(spark, d), A.offers(spark, d)


def match_titles_strict(spark: SparkSession, d: str) -> DataFrame:
    w, o = _listing(spark, d)
    return watchlist.match_titles(w, o)


def match_titles_loose(spark: SparkSession, d: str) -> DataFrame:
    """Queries of the watches as they are, hyphenated, or with a size in one of three spellings."""
    w, o = _listing(spark, d)
    k = F.substring("watch_id", 2, 9).cast("int")
    size = (k % 50).cast("string")
    hyphenated = F.regexp_replace("query", " ", "-")
    query = F.when(k % 5 == 0, F.col("query")).when(k % 5 == 1, hyphenated).when(k % 5 == 2, F.concat_ws(" ", "query", F.concat(size, F.lit("gb")))).when(k % 5 == 3, F.concat_ws(" ", "query", size, F.lit("GB"))).otherwise(F.concat_ws("-", hyphenated, F.concat(size, F.lit("gb"))))
    title = F.when(F.length("title") % 2 == 0, F.regexp_replace("title", " ", "-")).otherwise(F.col("title"))
    return watchlist.match_titles_loosely(w.withColumn("query", query), o.withColumn("title", title))


#: What the pages of a challenge, of a widget and of neither have.
MARKS = ("<script>window._CF_chl_opt = 1</script>", '<script src="/cdn-cgi/challenge-platform/h/b/orchestrate/jsch/v1"></script>', '<div class="cf-turnstile"></div>', '<script src="/cdn-cgi/challenge-platform/scripts/jsd/main.js"></script><script src="captcha.js"></script>')


def flag_blocked_pages(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    html = F.element_at(F.array(*[F.concat("html", F.lit(m)) for m in MARKS], F.concat(F.lit("<title>Just A Moment...</title>"), "html"), F.concat("html", F.lit(" " * 2000 + "just a moment")), F.col("html")), (k % 7 + 1).cast("int"))
    return watchlist.flag_blocked_pages(A.read(spark, d, "pages").withColumn("html", html)).select("page_id", "is_blocked", "has_widget")


SAID = ("In stoc", "Stoc epuizat", "Stoc magazin suficient", "Stoc magazin limitat", "ultimul produs in stoc", "în stoc furnizor", "pret nou")
CLASSES = ("box instock", "box insupplierstock", "outofstock", "stocky-txt in-stock", "limited-stock", "x supplier-stock", "bin-display", "is-out-of-stock", "")


def classify_stock(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    status = watchlist.classify_stock(pick(tuple(watchlist.STOCK_RULES), k), pick(SAID, F.floor(k / 4)), pick(CLASSES, F.floor(k / 28)), F.when(k % 5 < 4, (k % 5).cast("string")))
    return A.read(spark, d, "part").select("p_partkey", status.alias("status"))


def clean_search_offers(spark: SparkSession, d: str) -> DataFrame:
    li = A.read(spark, d, "lineitem").withColumn("k", F.col("l_orderkey") % 97)
    rows = li.select(
        F.concat(F.lit("q"), (F.col("l_partkey") % 50).cast("string")).alias("query"), F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string")).alias("shop"),
        F.concat(F.lit("https://www.S"), (F.col("l_suppkey") % 5).cast("string"), F.lit(".example.com/p/"), F.col("l_partkey").cast("string"), F.lit("/?utm_source=a")).alias("url"),
        F.when(F.col("k") != 0, F.concat(F.lit("part "), F.col("l_orderkey").cast("string"))).alias("title"), F.when(F.col("k") != 1, F.col("l_extendedprice")).alias("price"),
        F.when(F.col("l_returnflag") == "R", "out_of_stock").otherwise("in_stock").alias("stock_status"),
    )
    return watchlist.clean_search_offers(rows).select("query", "shop", "url", "title", "price", "rank")


def shop_answer_status(spark: SparkSession, d: str) -> DataFrame:
    e = A.read(spark, d, "events")
    is_ = lambda kind, more: ((F.col("event_type") == kind) & more).cast("int")
    value, shop = F.col("value"), F.col("event_id") % 200
    return watchlist.shop_answer_status(e.select(
        (F.col("user_id") % 30).alias("query"), shop.alias("shop"), (shop % 20 > 0).alias("is_supported"), is_("purchase", F.col("event_id") % 7 == 0).alias("offers"), is_("error", value > 60).alias("blocked"),
        is_("signup", value > 40).alias("missing"), is_("click", value > 30).alias("errors"), is_("view", value > 20).alias("answers"), is_("view", value > 80).alias("priceless"),
    ))


def _prices(spark: SparkSession, d: str) -> DataFrame:
    return A.sparse_observations(spark, d).groupBy("offer_id").agg(F.min("price").alias("price"))


def target_price_feasibility(spark: SparkSession, d: str) -> DataFrame:
    w, o = _listing(spark, d)
    return watchlist.target_price_feasibility(w, watchlist.match_titles(w, o, any_site=True), _prices(spark, d))


def duplicate_watches(spark: SparkSession, d: str) -> DataFrame:
    w = A.watches(spark, d).select("watch_id", F.when(F.col("site") == "all", "all").otherwise("store").alias("site"), F.concat(F.lit(" "), F.substring_index("query", " ", 1), F.lit("  x")).alias("query"))
    return watchlist.duplicate_watches(w).select("watch_id", F.array_join("others", ",").alias("others"))


def url_structure_check(spark: SparkSession, d: str) -> DataFrame:
    return watchlist.url_structure_check(A.read(spark, d, "pages"), SUFFIXES)


def _audit(spark: SparkSession, d: str) -> DataFrame:
    """Watches per store against listings that return the offers with a query's first word."""
    w, o = _listing(spark, d)
    stores = A.observations(spark, d).select(F.col("retailer").alias("store"), F.lit(False).alias("is_placeholder"))
    k = F.substring("watch_id", 2, 9).cast("int")
    each = deals.expand_watches(w.withColumn("enabled", F.lit(True)), stores)
    checks = each.select("watch_id", "store", F.when(k % 13 > 0, F.col("query")).alias("query"), (F.col("store") != "store_3").alias("is_supported"), F.concat(F.col("store"), F.lit(".example.com")).alias("host"), (k % 17 == 0).alias("failed"), (k % 19 == 0).alias("challenged"), (k % 2 == 0).alias("extraction_failed"))
    checks = written(checks, "checks")
    first = F.lower(F.substring_index(F.col("query"), " ", 1))
    asked = watchlist.sent(checks.filter((k % 23 > 0) & F.col("query").isNotNull()).select("watch_id", "store", first.alias("word")))[0]
    sku = F.col("sku").cast("int")
    listed = o.filter((sku % 3 == 0) & (F.col("retailer") != "store_2") | (sku % 29 == 0)).select(F.col("retailer").alias("store"), F.lower(F.substring_index("title", " ", 1)).alias("word"), F.col("offer_id").alias("at"), "title", F.when(sku % 87 == 0, F.concat(F.lit("https://other.example.org/p/"), "sku")).otherwise(F.col("url")).alias("url"))
    return watchlist.audit_watches(checks, listed.join(asked, ["store", "word"]).select("watch_id", "store", "at", "title", "url"))


def audit_watches(spark: SparkSession, d: str) -> DataFrame:
    return _audit(spark, d).select("watch_id", "store", "status", "n", F.array_join("samples", "|").alias("samples"))


def audit_acceptance(spark: SparkSession, d: str) -> DataFrame:
    return watchlist.audit_acceptance(_audit(spark, d), F.lit(1_706_738_400_000_000), "2024-02-01")


def apply_change_feed(spark: SparkSession, d: str) -> DataFrame:
    table, outcome = _feed(spark, d)
    return outcome


def change_feed_table(spark: SparkSession, d: str) -> DataFrame:
    return _feed(spark, d)[0]


def _feed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = A.read(spark, d, "part")
    k = F.col("p_partkey")
    on = (k % 26 != 4).cast("string")
    stored = p.filter("p_partkey % 3 <> 0").select(k.alias("id"), F.col("p_brand").alias("value"), (k % 26 != 4).alias("enabled"))
    op = F.when(k % 3 == 0, F.when(k % 9 == 0, "enable").otherwise("add")).when(k % 5 == 0, "delete").when(k % 13 == 4, "enable").otherwise("update")
    switch = op == "enable"
    old = F.when(switch, on).when(k % 3 == 0, F.lit(None)).when(k % 7 == 0, F.lit("other")).otherwise(F.col("p_brand"))
    new = F.when(switch, F.when(k % 4 == 0, "true").otherwise("false")).when(k % 11 == 0, F.col("p_brand")).otherwise(F.concat("p_brand", F.lit("+")))
    feed = p.filter("p_partkey % 2 = 0").select(k.alias("seq"), k.alias("id"), op.alias("op"), old.alias("old"), new.alias("new"))
    again = feed.filter("id % 10 = 0").withColumn("seq", F.col("seq") + 1_000_000_000)
    return watchlist.apply_change_feed(stored, feed.unionByName(again))


def product_report(spark: SparkSession, d: str) -> DataFrame:
    """One row per product: its newest observation with window, provenance, verdict and badges, and its daily series."""
    rows = deals.window_median(A.observations(spark, d), DAYS)
    rows = rows.withColumn("badges", deals.badges(F.col("price") < F.col("prior_low"), deals.legal_discount(F.col("genuine_savings")), F.col("previous_price") > F.col("median") * deals.INFLATED, F.col("stock_status")))
    last = history.newest(rows, ["offer_id"], [F.desc("us"), F.desc("seq")])
    v = deals.verdict(F.col("price"), F.col("thirty_day_low"), F.col("reference_price"), F.col("history_days"))
    provenance = F.when(F.col("window_n") > 0, "genuine").otherwise("confirmed_empty")
    series = history.daily_series(A.observations(spark, d), 1).select("offer_id", F.array_join(F.transform("series", lambda x: F.concat_ws("=", x["day"].cast("string"), F.format_string("%.2f", x["price"]))), ";").alias("series"))
    return last.select("offer_id", "price", "thirty_day_low", F.round("median", 6).alias("median"), v.alias("verdict"), provenance.alias("provenance"), F.array_join("badges", ",").alias("badges")).join(series, "offer_id")


def watch_coverage(spark: SparkSession, d: str) -> DataFrame:
    w, o = _listing(spark, d)
    return watchlist.watch_coverage(w, watchlist.match_titles(w, o), o)


QUERIES = {f.__name__: f for f in (
    scrape_totals, slot_coverage, retailer_ranking, outbox_metrics, delivery_metrics, feedback_acceptance, savings_estimate, workflow_success, retro_report, match_titles_strict, match_titles_loose,
    flag_blocked_pages, classify_stock, clean_search_offers, shop_answer_status, target_price_feasibility, duplicate_watches, url_structure_check, audit_watches, audit_acceptance, apply_change_feed,
    change_feed_table, product_report, watch_coverage,
)}

M = f"""{W}, {A.OFFERS},
matches AS (SELECT watch_id, offer_id FROM watches JOIN offers ON (site = 'all' OR site = retailer)
  AND len(list_filter(string_split_regex(lower(query), '\\s+'), lambda q: NOT list_contains(string_split_regex(lower(title), '\\s+'), q))) = 0)"""
TOTALS = f"tot AS (SELECT count(DISTINCT run) AS runs, count(*) AS store_runs, sum(parsed)::BIGINT AS parsed, sum(failures)::BIGINT AS failures FROM h WHERE started_us >= {START} AND started_us < {END})"
COVER = f"""{A.OBS}, slots AS (SELECT unnest(range({START // A.SLOT_US}, {END // A.SLOT_US})) AS slot), hit AS (SELECT DISTINCT us // {A.SLOT_US} AS slot FROM obs WHERE price > 120 AND us >= {START} AND us < {END}),
  miss AS (SELECT slot, slot - row_number() OVER (ORDER BY slot) AS g FROM slots WHERE slot NOT IN (SELECT slot FROM hit)),
  cov AS (SELECT (SELECT count(*) FROM slots) AS slots, (SELECT count(*) FROM slots) - (SELECT count(*) FROM miss) AS covered, (SELECT count(*) FROM miss) AS missed,
   coalesce((SELECT max(n) FROM (SELECT count(*) AS n FROM miss GROUP BY g)), 0) AS longest_gap, round(((SELECT count(*) FROM slots) - (SELECT count(*) FROM miss)) / (SELECT count(*) FROM slots) * 100, 2) AS uptime_percent)"""
ACC = """acc AS (SELECT count(*) AS labels, count(DISTINCT alert_id) AS alerts, count(DISTINCT rater) AS raters, count(*) FILTER (WHERE label <> 'duplicate') AS judged,
  round(count(*) FILTER (WHERE label IN ('useful','purchased')) / nullif(count(*) FILTER (WHERE label <> 'duplicate'), 0) * 100, 4) AS acceptance_percent FROM cur)"""
SAVE = """p AS (SELECT DISTINCT seq FROM label_log WHERE label = 'purchased'), f AS (SELECT p.seq, s.price, s.median, CASE WHEN median IS NOT NULL THEN greatest(median - price, 0) END AS saved FROM p LEFT JOIN stats s ON s.seq = p.seq AND p.seq % 7 <> 0),
  sav AS (SELECT count(*) AS purchased, count(*) FILTER (WHERE price IS NULL) AS unmatched, count(*) FILTER (WHERE price IS NOT NULL AND median IS NULL) AS no_reference, round(sum(saved), 4) AS total, round(median(saved), 4) AS median_saved FROM f)"""

AUDIT = f"""{W}, {A.OFFERS}, {A.OBS.strip()}, st AS (SELECT DISTINCT retailer AS store FROM obs),
chk AS (SELECT watch_id, store, substr(watch_id, 2)::INT AS k, CASE WHEN substr(watch_id, 2)::INT % 13 > 0 THEN query END AS query FROM watches JOIN st ON site = 'all' OR site = store),
lst AS (SELECT retailer AS store, offer_id AS ord, title, CASE WHEN sku::INT % 87 = 0 THEN 'https://other.example.org/p/' || sku ELSE url END AS url FROM offers WHERE sku::INT % 3 = 0 AND retailer <> 'store_2' OR sku::INT % 29 = 0),
res AS (SELECT c.watch_id, c.store, ord, title, url, len(list_filter(string_split_regex(lower(query), '\\s+'), lambda q: NOT list_contains(string_split_regex(lower(title), '\\s+'), q))) = 0 AS hit
  FROM chk c JOIN lst l ON c.store = l.store AND lower(split_part(query, ' ', 1)) = lower(split_part(title, ' ', 1)) WHERE k % 23 > 0),
top AS (SELECT *, row_number() OVER (PARTITION BY watch_id, store ORDER BY NOT hit, ord) AS nth FROM res),
agg AS (SELECT watch_id, store, count(*) AS results, count(*) FILTER (WHERE hit) AS n, count(*) FILTER (WHERE hit AND nth <= 5 AND url LIKE 'https://other%') AS odd, string_agg(title, '|' ORDER BY nth) FILTER (WHERE hit AND nth <= 5) AS samples FROM top GROUP BY ALL),
audit AS (SELECT c.watch_id, c.store, CASE WHEN c.store = 'store_3' THEN 'UNSUPPORTED' WHEN query IS NULL THEN 'MANUAL_REVIEW' WHEN k % 17 = 0 OR k % 19 = 0 THEN 'UNVERIFIED' WHEN results > 0 AND n = 0 THEN 'MISMATCH'
    WHEN n > 0 AND odd > 0 THEN 'MANUAL_REVIEW' WHEN n > 0 THEN 'PASS' WHEN k % 2 = 0 THEN 'UNVERIFIED' ELSE 'NO_RESULTS' END AS status,
  CASE WHEN c.store = 'store_3' OR query IS NULL OR k % 17 = 0 THEN 0 ELSE coalesce(n, 0) END AS n, CASE WHEN c.store = 'store_3' OR query IS NULL OR k % 17 = 0 THEN '' ELSE coalesce(samples, '') END AS samples
  FROM chk c LEFT JOIN agg USING (watch_id, store))"""

FEED = """f AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS value, p_brand AS b, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 9 = 0 THEN 'enable' ELSE 'add' END WHEN p_partkey % 5 = 0 THEN 'delete' WHEN p_partkey % 13 = 4 THEN 'enable' ELSE 'update' END AS op FROM part),
g AS (SELECT *, CASE WHEN op = 'enable' THEN CASE WHEN k % 4 = 0 THEN 'true' ELSE 'false' END WHEN op = 'delete' THEN NULL WHEN k % 11 = 0 THEN b ELSE b || '+' END AS wanted,
  CASE WHEN op = 'enable' THEN CASE WHEN k % 26 <> 4 THEN 'true' ELSE 'false' END WHEN k % 3 = 0 THEN NULL WHEN k % 7 = 0 THEN 'other' ELSE b END AS old,
  CASE WHEN op = 'enable' THEN CASE WHEN k % 3 > 0 THEN CASE WHEN k % 26 <> 4 THEN 'true' ELSE 'false' END END ELSE value END AS cur FROM f),
o AS (SELECT *, CASE WHEN op = 'enable' AND k % 3 = 0 THEN 'conflict' WHEN cur IS NOT DISTINCT FROM wanted THEN 'already_applied' WHEN cur IS NOT DISTINCT FROM old THEN 'applied' ELSE 'conflict' END AS outcome FROM g)"""


def _unpivot(section: str, table: str, columns: tuple[str, ...]) -> str:
    return " UNION ALL ".join(f"SELECT '{section}' AS section, '{c}' AS metric, {c}::DOUBLE AS value, CASE WHEN {c} IS NULL THEN 'no_data' ELSE 'ok' END AS status FROM {table}" for c in columns)


#: Words of a text parted by single spaces, numbers and their units as one: spaces are doubled, so that each word has its own two.
_UNITED = r"list_filter(string_split(regexp_replace(' ' || replace({0}, ' ', '  ') || ' ', ' (\d+(?:\.\d+)?)  (gb|tb|mb|ghz|mhz|hz|inch|w|mah) ', ' \1\2 ', 'g'), ' '), lambda w: w <> '')"

SQL = {
    "scrape_totals": f"WITH {H}, {TOTALS} SELECT * FROM tot",
    "slot_coverage": f"WITH {COVER} SELECT * FROM cov",
    "retailer_ranking": f"""WITH {H}, b AS (SELECT store, count(*) AS runs, count(*) FILTER (WHERE parsed = 0) AS zero_runs, round(sum(parsed) / nullif(sum(parsed) + sum(failures), 0), 6) AS success_rate,
      round(avg(challenge_detected::INT), 6) AS challenge_rate, round(avg(challenge_wait_entered::INT), 6) AS challenge_wait_rate, round(median(latency), 6) AS median_latency FROM h GROUP BY store)
      , rs AS (SELECT store, string_agg(reason || '=' || n, ',' ORDER BY n DESC, reason) AS reasons FROM (SELECT store, reason, count(*) AS n FROM fetches WHERE reason IS NOT NULL GROUP BY ALL) GROUP BY store)
      SELECT b.*, CASE WHEN success_rate IS NOT NULL THEN row_number() OVER (ORDER BY success_rate DESC NULLS LAST, challenge_rate, store)::INT END AS rank, reasons FROM b LEFT JOIN rs USING (store)""",
    "outbox_metrics": f"WITH {EFF} SELECT source, count(*) FILTER (WHERE status = 'SENT') AS sent, count(*) FILTER (WHERE status = 'PENDING') AS pending, count(*) FILTER (WHERE status = 'DEAD_LETTER') AS dead_letter FROM eff GROUP BY source",
    "delivery_metrics": f"WITH {X} SELECT status, channel, count(*) AS attempts, count(DISTINCT event_id) AS decisions FROM outbox GROUP BY GROUPING SETS ((status), (channel), ())",
    "feedback_acceptance": f"WITH {CUR}, {ACC} SELECT * FROM acc",
    "savings_estimate": f"WITH {WIN}, {L}, {SAVE} SELECT * FROM sav",
    "workflow_success": """SELECT o_orderpriority AS event, count(*) AS completed, count(*) FILTER (WHERE o_orderkey % 6 <> 0) AS succeeded, round(count(*) FILTER (WHERE o_orderkey % 6 <> 0) / count(*) * 100, 4) AS success_percent
      FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1""",
    "retro_report": f"WITH {H}, {TOTALS}, none_ AS (SELECT count(DISTINCT run) AS runs, count(*) AS store_runs, sum(parsed) AS parsed, sum(failures) AS failures FROM h WHERE run < 0), "
    + COVER + WIN.removeprefix(A.OBS) + f", {CUR}, {ACC}, {SAVE}, {X} "
    + " UNION ALL ".join(f"SELECT 'inputs' AS section, '{n}' AS metric, (SELECT count(*) FROM {t})::DOUBLE AS value, 'ok' AS status" for n, t in (("fetches", "fetches"), ("labels", "label_log"), ("outbox", "outbox")))
    + " UNION ALL SELECT 'inputs', 'runs', NULL, 'missing' UNION ALL SELECT 'evidence', 'has_event_data', 1, 'ok' UNION ALL "
    + " UNION ALL ".join((
        _unpivot("scrape", "tot", ("runs", "store_runs", "parsed", "failures")), _unpivot("coverage", "cov", ("slots", "covered", "missed", "longest_gap", "uptime_percent")),
        _unpivot("feedback", "acc", ("labels", "alerts", "raters", "judged", "acceptance_percent")), _unpivot("savings", "sav", ("purchased", "unmatched", "no_reference", "total", "median_saved")),
        _unpivot("none", "none_", ("runs", "store_runs", "parsed", "failures")),
    )),
    "match_titles_strict": f"WITH {M} SELECT * FROM matches",
    "match_titles_loose": f"""WITH {W}, {A.OFFERS},
      q AS (SELECT watch_id, site, CASE k % 5 WHEN 0 THEN query WHEN 1 THEN replace(query, ' ', '-') WHEN 2 THEN query || ' ' || (k % 50) || 'gb' WHEN 3 THEN query || ' ' || (k % 50) || ' GB' ELSE replace(query, ' ', '-') || '-' || (k % 50) || 'gb' END AS query
        FROM (SELECT *, substr(watch_id, 2)::INT AS k FROM watches)),
      o AS (SELECT offer_id, retailer, CASE WHEN length(title) % 2 = 0 THEN replace(title, ' ', '-') ELSE title END AS title FROM offers),
      tw AS (SELECT *, lower(title) AS low, regexp_extract_all(lower(title), '[\\pL\\pN]+(?:\\.[\\pL\\pN]+)*') AS words FROM o),
      t AS (SELECT offer_id, retailer, string_split_regex(low, '\\s+') AS plain,
        list_distinct(words || {_UNITED.format("array_to_string(words, ' ')")} || list_transform(regexp_extract_all(low, '[\\pL\\pN]+(?:-[\\pL\\pN]+)+'), lambda h: replace(h, '-', ''))) AS forms FROM tw),
      qw AS (SELECT watch_id, site, string_split_regex(lower(query), '\\s+') AS plain, list_transform({_UNITED.format("lower(query)")},
        lambda w: struct_pack(parts := regexp_extract_all(w, '[\\pL\\pN]+(?:\\.[\\pL\\pN]+)*'), word := w)) AS words FROM q)
      SELECT watch_id, offer_id, CASE WHEN list_has_all(t.plain, qw.plain) THEN 'strict' ELSE 'normalized' END AS how
      FROM qw JOIN t ON site = 'all' OR site = retailer
      WHERE list_has_all(t.plain, qw.plain) OR len(list_filter(words, lambda x: NOT (list_has_all(forms, x.parts) OR (contains(x.word, '-') AND list_contains(forms, array_to_string(x.parts, '')))))) = 0""",
    "flag_blocked_pages": """SELECT page_id, CASE WHEN page_id % 7 IN (0, 1, 4) THEN true ELSE contains(lower(html[1:2000]), 'just a moment') OR regexp_matches(lower(html), '_cf_chl_opt|/cdn-cgi/challenge-platform/h/[a-z]+/orchestrate/') END AS is_blocked,
      page_id % 7 = 2 OR contains(lower(html), 'cf-turnstile') OR contains(lower(html), 'challenges.cloudflare.com/turnstile/') AS has_widget FROM pages""",
    "classify_stock": f"""WITH x AS (SELECT p_partkey, p_partkey % 4 AS layout, lower({list(SAID)}[p_partkey // 4 % 7 + 1]) AS t, {list(CLASSES)}[p_partkey // 28 % 9 + 1] AS c, CASE WHEN p_partkey % 5 < 4 THEN p_partkey % 5 END AS a FROM part),
      y AS (SELECT *, replace(t, 'î', 'i') AS u, string_split(c, ' ') AS n FROM x)
      SELECT p_partkey, CASE layout
        WHEN 0 THEN CASE WHEN u LIKE '%stoc epuizat%' OR u LIKE '%indisponibil%' THEN 'out_of_stock' WHEN a = 2 OR u LIKE '%ultimul produs%' THEN 'limited_stock' WHEN a = 3 OR u LIKE '%in stoc%' THEN 'in_stock' ELSE 'unknown' END
        WHEN 1 THEN CASE WHEN list_contains(n, 'outofstock') THEN 'out_of_stock' WHEN list_contains(n, 'insupplierstock') THEN 'supplier_stock' WHEN list_contains(n, 'instock') THEN CASE WHEN u LIKE '%limitat%' THEN 'limited_stock' ELSE 'in_stock' END ELSE 'unknown' END
        WHEN 2 THEN CASE WHEN c LIKE '%out-of-stock%' OR c LIKE '%sold-out%' THEN 'out_of_stock' WHEN list_contains(n, 'limited-stock') THEN 'limited_stock' WHEN list_contains(n, 'supplier-stock') THEN 'supplier_stock' WHEN list_contains(n, 'in-stock') OR list_contains(n, 'bin-display') THEN 'in_stock' ELSE 'unknown' END
        ELSE CASE WHEN c LIKE '%outofstock%' OR u LIKE '%epuizat%' OR u LIKE '%indisponibil%' THEN 'out_of_stock' WHEN c LIKE '%insupplierstock%' OR u LIKE '%furnizor%' THEN 'supplier_stock' WHEN u LIKE '%limitat%' THEN 'limited_stock' WHEN c LIKE '%instock%' THEN 'in_stock' ELSE 'unknown' END END AS status FROM y""",
    "clean_search_offers": """WITH r AS (SELECT 'q' || (l_partkey % 50) AS query, 's' || (l_suppkey % 5) AS shop, 'https://s' || (l_suppkey % 5) || '.example.com/p/' || l_partkey AS url, 'part ' || l_orderkey AS title,
        l_extendedprice AS price, l_returnflag = 'R' AS gone FROM lineitem WHERE l_orderkey % 97 > 1),
      b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY shop, url ORDER BY price, title) = 1)
      SELECT query, shop, url, title, price, row_number() OVER (PARTITION BY query ORDER BY gone, price, shop, title, url)::INT AS rank FROM b""",
    "shop_answer_status": """WITH b AS (SELECT user_id % 30 AS query, event_id % 200 AS shop, bool_or(event_type = 'purchase' AND event_id % 7 = 0) AS offers, bool_or(event_type = 'error' AND value > 60) AS blocked,
        bool_or(event_type = 'signup' AND value > 40) AS missing, bool_or(event_type = 'click' AND value > 30) AS errors, bool_or(event_type = 'view' AND value > 20) AS answers, bool_or(event_type = 'view' AND value > 80) AS priceless FROM events GROUP BY ALL),
      s AS (SELECT query, shop, CASE WHEN shop % 20 = 0 THEN 'unsupported' WHEN offers THEN 'ok' WHEN blocked THEN 'blocked' WHEN missing THEN 'no_match' WHEN errors OR NOT answers OR priceless THEN 'error' ELSE 'no_match' END AS status FROM b)
      SELECT *, bool_or(status = 'ok') OVER (PARTITION BY query) AS answered FROM s""",
    "target_price_feasibility": f"""WITH {W}, {A.OFFERS}, {A.SPARSE},
      found AS (SELECT watch_id, offer_id FROM watches JOIN offers ON list_has_all(string_split_regex(lower(title), '\\s+'), string_split_regex(lower(query), '\\s+'))),
      low AS (SELECT watch_id, min(price) AS lowest FROM found JOIN sparse USING (offer_id) GROUP BY watch_id)
      SELECT watch_id, CASE WHEN target_price IS NOT NULL THEN lowest END AS lowest, CASE WHEN target_price IS NULL THEN 'not_set' WHEN lowest IS NULL THEN 'no_matching_history' WHEN target_price < lowest THEN 'below_observed_historical_low' ELSE 'within_observed_range' END AS state FROM watches LEFT JOIN low USING (watch_id)""",
    "duplicate_watches": f"""WITH {W}, k AS (SELECT watch_id, CASE WHEN site = 'all' THEN 'all' ELSE 'store' END AS site, lower(split_part(query, ' ', 1)) AS q FROM watches)
      SELECT a.watch_id, string_agg(b.watch_id, ',' ORDER BY b.watch_id) AS others FROM k a JOIN k b ON a.site = b.site AND a.q = b.q AND a.watch_id <> b.watch_id GROUP BY a.watch_id""",
    "url_structure_check": """WITH u AS (SELECT page_id, regexp_matches(lower(url), '^https?://') AS scheme_ok, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host, rtrim(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/') AS path FROM pages),
      v AS (SELECT page_id, scheme_ok, ends_with(host, 'example.com') OR ends_with(host, 'example.org') AS host_ok, path <> '' AS path_ok FROM u)
      SELECT *, scheme_ok AND host_ok AND path_ok AS valid FROM v""",
    "audit_watches": f"WITH {AUDIT} SELECT watch_id, store, status, n, samples FROM audit",
    "audit_acceptance": f"WITH {AUDIT} SELECT count(*) FILTER (WHERE status = 'PASS') AS passed, count(*) FILTER (WHERE status <> 'PASS') AS failed, bool_and(status = 'PASS') AS all_pass, true AS in_window FROM audit",
    "apply_change_feed": f"""WITH {FEED} SELECT k AS seq, k AS id, outcome FROM o WHERE k % 2 = 0 UNION ALL SELECT k + 1000000000, k, 'duplicate' FROM o WHERE k % 10 = 0""",
    "change_feed_table": f"""WITH {FEED} SELECT * FROM (SELECT k AS id, CASE WHEN k % 2 = 0 AND outcome = 'applied' AND op <> 'enable' THEN wanted ELSE value END AS value,
      CASE WHEN k % 2 = 0 AND outcome = 'applied' AND op = 'enable' THEN wanted = 'true' WHEN k % 3 = 0 THEN true ELSE k % 26 <> 4 END AS enabled FROM o) WHERE value IS NOT NULL""",
    "product_report": f"""WITH {WIN}, lst AS (SELECT offer_id, day, price FROM obs QUALIFY row_number() OVER (PARTITION BY offer_id, day ORDER BY us DESC, seq DESC) = 1),
      ser AS (SELECT offer_id, string_agg(day || '=' || printf('%.2f', price), ';' ORDER BY day) AS series FROM lst GROUP BY offer_id),
      rep AS (SELECT offer_id, CASE WHEN window_n > 0 THEN 'genuine' ELSE 'confirmed_empty' END AS provenance, price, thirty_day_low, round(median, 6) AS median,
      CASE WHEN history_days < 14 THEN 'INSUFFICIENT_HISTORY' WHEN price >= thirty_day_low THEN 'FALSE_DISCOUNT' WHEN reference_price > thirty_day_low * 1.25 THEN 'INFLATED_REFERENCE'
        WHEN round((thirty_day_low - price) / thirty_day_low * 100, 2) >= 5 THEN 'GENUINE_DEAL' ELSE 'NORMAL_DROP' END AS verdict,
      concat_ws(',', CASE WHEN price < prior_low THEN 'all_time_low' END, CASE WHEN savings > 0 THEN 'legal_discount' END, CASE WHEN previous_price > median * 1.25 THEN 'pre_sale_hike' END, CASE WHEN stock_status = 'limited_stock' THEN 'limited_stock' END) AS badges
      FROM stats QUALIFY row_number() OVER (PARTITION BY offer_id ORDER BY us DESC, seq DESC) = 1) SELECT rep.*, series FROM rep JOIN ser USING (offer_id)""",
    "watch_coverage": f"""WITH {M} SELECT watch_id, count(offer_id) AS n FROM watches LEFT JOIN matches USING (watch_id) GROUP BY watch_id UNION ALL SELECT NULL, count(*) FROM offers WHERE offer_id NOT IN (SELECT offer_id FROM matches)""",
}
