"""Queries of identity, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import identity as I
from ..sources.scratch import written
from . import adapters as A
from .operations_queries import uuid5

RULES = ("generic", "html_slug", "last_slug", "trailing_id")


def canonicalize_urls(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "pages").select("page_id", T.canonical_url(F.col("url")).alias("canonical"))


def url_aliases(spark: SparkSession, d: str) -> DataFrame:
    return I.group_aliases(A.read(spark, d, "pages"))


def extract_skus(spark: SparkSession, d: str) -> DataFrame:
    rule = F.element_at(F.array(*map(F.lit, RULES)), (F.col("page_id") % 4 + 1).cast("int"))
    sku, method = I.extract_sku(rule, F.col("url"))
    return A.read(spark, d, "pages").select("page_id", sku.alias("sku"), method.alias("method"))


def offer_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return A.offers(spark, d).select("offer_id", T.fingerprint(F.col("retailer"), F.col("sku")).alias("fingerprint"))


def deterministic_ids(spark: SparkSession, d: str) -> DataFrame:
    o = A.offers(spark, d)
    return o.select("offer_id", T.offer_uuid(F.col("retailer"), F.col("sku")).alias("id"), T.product_uuid(F.col("title")).alias("product_id"))


def normalize_prices(spark: SparkSession, d: str) -> DataFrame:
    p = A.read(spark, d, "part")
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    whole = F.regexp_replace((cents / 100).cast("long").cast("string"), r"(\d)(\d{3})$", "$1.$2")
    shown = F.concat(whole, F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit(" Lei"))
    raw = F.when(F.col("p_partkey") % 5 == 0, F.col("p_retailprice").cast("string")).when(F.col("p_partkey") % 7 == 0, "pret la cerere").when(F.col("p_partkey") % 11 == 0, "-5 RON").otherwise(shown)
    return p.select("p_partkey", T.machine_price(raw).alias("price"))


def normalize_titles(spark: SparkSession, d: str) -> DataFrame:
    rows = I.with_title_parts(A.offers(spark, d).select("title").distinct())
    return rows.select("title", F.array_join("tokens", " ").alias("tokens"), F.array_join("colors", " ").alias("colors"), F.array_join("capacities", " ").alias("capacities"))


def _titles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two shops' views of parts: one per part, and the other with colour or size changed for some."""
    p = A.read(spark, d, "part").filter("p_size is not null")
    code = F.concat(F.lit("mx"), F.lpad((F.col("p_partkey") % 90).cast("string"), 4, "0"), F.lit("q"))
    words = F.concat_ws(" ", "p_name", "p_brand", F.lower("p_type"), F.concat(F.col("p_size").cast("string"), F.lit(" gb")), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("ab"), F.lpad((F.col("p_partkey") % 90).cast("string"), 4, "0"), F.lit("q"))), F.when(F.col("p_partkey") % 2 == 0, code))
    left = p.select(F.concat(F.lit("l"), F.col("p_partkey").cast("string")).alias("offer_id"), F.lit("one").alias("retailer"), F.col("p_partkey").cast("string").alias("sku"), words.alias("title"))
    right = p.filter("p_partkey % 4 = 0").select(F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("offer_id"), F.lit("two").alias("retailer"), F.col("p_partkey").cast("string").alias("sku"), F.concat_ws(" ", F.when(F.col("p_partkey") % 8 == 0, F.upper(words)).otherwise(words), F.when(F.col("p_partkey") % 12 == 0, "black")).alias("title"))
    return left, right


def title_pairs(spark: SparkSession, d: str) -> DataFrame:
    left, right = _titles(spark, d)
    pairs = I.scored_pairs(left, right)
    return pairs.select("a_offer_id", "b_offer_id", "score", F.array_join("reasons", ",").alias("reasons"))


def resolve_offers(spark: SparkSession, d: str) -> DataFrame:
    left, right = _titles(spark, d)
    known = right.unionByName(left.filter("cast(sku as int) % 10 = 0").withColumn("offer_id", F.concat(F.lit("k"), F.col("sku"))))
    return I.resolve_offers(left, known)


def group_equivalent_offers(spark: SparkSession, d: str) -> DataFrame:
    left, right = _titles(spark, d)
    pairs = written(I.scored_pairs(left, right).drop("reasons"), "title-pairs")
    both = left.unionByName(right).withColumn("query", F.substring_index("title", " ", 1)).withColumn("query", F.lower("query")).withColumn("price", (F.col("sku").cast("int") % 17).cast("double"))
    links = pairs.join(both.select(F.col("offer_id").alias("a_offer_id"), "query"), "a_offer_id")
    return I.group_equivalent(both.select("query", "offer_id", F.col("retailer").alias("shop"), "price"), links.select("query", "a_offer_id", "b_offer_id", "score", "veto"))


def apply_cross_links(spark: SparkSession, d: str) -> DataFrame:
    e = A.read(spark, d, "events").select(F.concat(F.lit("f"), (F.col("event_id") % 701).cast("string")).alias("fp"), F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("product"), F.when(F.col("event_type") == "view", "fingerprint").otherwise("title").alias("method"), (F.col("value") / 500).alias("confidence"), F.col("event_id").alias("seq"))
    links, moved = I.apply_links(e.filter("seq % 10 < 7"), e.filter("seq % 10 >= 7"))
    return links.select("fp", "product", "seq", F.lit("link").alias("kind")).unionByName(moved.select("fp", F.concat_ws(">", "old_product", "product").alias("product"), "seq", F.lit("redirect").alias("kind")))


QUERIES = {f.__name__: f for f in (
    canonicalize_urls, url_aliases, extract_skus, offer_fingerprint, deterministic_ids, normalize_prices, normalize_titles, title_pairs, resolve_offers, group_equivalent_offers, apply_cross_links,
)}

TRACK = ", ".join(f"'{t}'" for t in T.TRACKING)
URLS = rf"""
cut AS (SELECT page_id, url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?', ['scheme','host','path','query']) AS u FROM pages),
canon AS (SELECT page_id, url, u, lower(u.scheme) || '://' || regexp_replace(lower(u.host), '^www\.', '') || CASE WHEN rtrim(u.path, '/') = '' THEN '/' ELSE rtrim(u.path, '/') END
  || coalesce((SELECT '?' || string_agg(p, '&' ORDER BY p) FROM (SELECT unnest(string_split(u.query, '&')) AS p)
     WHERE p <> '' AND NOT starts_with(lower(split_part(p, '=', 1)), 'utm_') AND lower(split_part(p, '=', 1)) NOT IN ({TRACK})), '') AS canonical FROM cut)"""
TOKENS = "list_distinct(regexp_extract_all(regexp_replace(lower({}), '([0-9]+) gb', '\\1gb', 'g'), '[a-z0-9.]+'))"
COLORS = ", ".join(f"'{c}'" for c in I.COLORS)
PAIRS = f"""parts AS (SELECT p_partkey AS p, concat_ws(' ', p_name, p_brand, lower(p_type), p_size || ' gb', CASE WHEN p_partkey % 3 = 0 THEN 'ab' || lpad((p_partkey % 90)::VARCHAR, 4, '0') || 'q' END, CASE WHEN p_partkey % 2 = 0 THEN 'mx' || lpad((p_partkey % 90)::VARCHAR, 4, '0') || 'q' END) AS w FROM part WHERE p_size IS NOT NULL),
l AS (SELECT 'l' || p AS a, {TOKENS.format('w')} AS t FROM parts),
r AS (SELECT 'r' || p AS b, {TOKENS.format("concat_ws(' ', w, CASE WHEN p % 12 = 0 THEN 'black' END)")} AS t FROM parts WHERE p % 4 = 0),
x AS (SELECT a, b, len(list_intersect(l.t, r.t)) AS both_, len(l.t) + len(r.t) AS sum_, list_filter(l.t, lambda w: regexp_full_match(w, 'ab[0-9]+q')) AS ca, list_filter(r.t, lambda w: regexp_full_match(w, 'ab[0-9]+q')) AS cb,
  list_filter(l.t, lambda w: w IN ({COLORS})) AS la, list_filter(r.t, lambda w: w IN ({COLORS})) AS lb, list_sort(list_filter(l.t, lambda w: regexp_full_match(w, '[0-9]+gb'))) AS sa, list_sort(list_filter(r.t, lambda w: regexp_full_match(w, '[0-9]+gb'))) AS sb FROM l, r),
y AS (SELECT *, both_ / (sum_ - both_) AS j, len(ca) > 0 AND len(cb) > 0 AS coded, len(ca) > 0 AND len(cb) > 0 AND NOT list_has_any(ca, cb) AS differ, len(la) > 0 AND len(lb) > 0 AND NOT list_has_any(la, lb) AS hue, len(sa) > 0 AND len(sb) > 0 AND sa <> sb AS size_ FROM x),
pairs AS (SELECT a, b, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN coded AND NOT differ THEN 0.6::DOUBLE + 0.4::DOUBLE * j WHEN differ THEN 0.4::DOUBLE * j ELSE 0.9::DOUBLE * j END - CASE WHEN hue THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END - 0.1::DOUBLE - CASE WHEN size_ THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END)), 4) AS score,
  concat_ws(',', CASE WHEN differ THEN 'MODEL_CODE_CONFLICT' WHEN coded THEN 'MODEL_CODE_MATCH' ELSE 'TOKEN_JACCARD_ONLY' END, CASE WHEN hue THEN 'COLOR_CONFLICT' END, 'SPEC_UNVERIFIED_CPU', CASE WHEN size_ THEN 'SPEC_CONFLICT_CAPACITY' END) AS reasons FROM y)"""
SQL = {
    "canonicalize_urls": f"WITH {URLS} SELECT page_id, canonical FROM canon",
    "url_aliases": f"WITH {URLS} SELECT canonical, count(*) AS n, min(url) AS first_url FROM canon GROUP BY canonical",
    "extract_skus": f"""WITH {URLS}, s AS (SELECT page_id, page_id % 4 AS k, list_filter(string_split(u.path, '/'), lambda x: x <> '') AS seg FROM canon),
      r AS (SELECT *, CASE k WHEN 1 THEN CASE WHEN ends_with(seg[-1], '.html') THEN lower(seg[-1]) ELSE '' END WHEN 2 THEN CASE WHEN len(seg) >= 2 THEN lower(seg[-1]) ELSE '' END
                        WHEN 3 THEN CASE WHEN len(seg) >= 2 THEN regexp_extract(seg[-1], '-([0-9]{{3,}})$', 1) ELSE '' END ELSE '' END AS by_rule FROM s)
      SELECT page_id, CASE WHEN coalesce(by_rule, '') <> '' THEN by_rule ELSE seg[-1] END AS sku,
        CASE WHEN coalesce(by_rule, '') <> '' THEN 'rule:' || ['generic','html_slug','last_slug','trailing_id'][k + 1] WHEN k = 0 THEN 'last_segment' ELSE 'legacy' END AS method FROM r""",
    "offer_fingerprint": f"WITH {A.OFFERS} SELECT offer_id, 'pid-v1:' || sha256(retailer || ':' || sku) AS fingerprint FROM offers",
    "deterministic_ids": f"""WITH {A.OFFERS} SELECT offer_id, {uuid5("'offer:' || retailer || ':' || sku")} AS id, {uuid5("'product:' || title")} AS product_id FROM offers""",
    "normalize_titles": f"""WITH {A.OFFERS}, x AS (SELECT DISTINCT title, list_sort({TOKENS.format('title')}) AS t FROM offers)
      SELECT title, array_to_string(t, ' ') AS tokens, array_to_string(list_filter(t, lambda w: w IN ({COLORS})), ' ') AS colors, array_to_string(list_filter(t, lambda w: regexp_full_match(w, '[0-9]+(gb|tb)')), ' ') AS capacities FROM x""",
    "title_pairs": f"WITH {PAIRS} SELECT a AS a_offer_id, b AS b_offer_id, score, reasons FROM pairs WHERE score >= 0.75",
    "resolve_offers": f"""WITH {PAIRS}, best AS (SELECT a, min_by(b, (-score, b)) AS b, max(score) AS s FROM pairs WHERE score >= 0.75 GROUP BY a)
      SELECT 'l' || p AS offer_id, CASE WHEN p % 10 = 0 THEN 'k' || p ELSE coalesce(b, 'l' || p) END AS product, CASE WHEN p % 10 = 0 THEN 'fingerprint' WHEN b IS NOT NULL THEN 'title' ELSE 'new' END AS method,
        CASE WHEN p % 10 = 0 THEN 1.0 ELSE coalesce(s, 1.0) END AS confidence FROM parts LEFT JOIN best ON a = 'l' || p""",
    "normalize_prices": """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_retailprice WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN NULL ELSE round(p_retailprice * 100) / 100 END AS price FROM part""",
    "apply_cross_links": """WITH e AS (SELECT 'f' || (event_id % 701) AS fp, 'p' || user_id AS product, CASE WHEN event_type = 'view' THEN 'fingerprint' ELSE 'title' END AS method, value / 500 AS confidence, event_id AS seq FROM events),
      l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY fp ORDER BY seq DESC) = 1),
      o AS (SELECT fp, product AS old_product FROM e WHERE seq % 10 < 7 QUALIFY row_number() OVER (PARTITION BY fp ORDER BY seq DESC) = 1)
      SELECT fp, product, seq, 'link' AS kind FROM l UNION ALL
      SELECT fp, old_product || '>' || product, seq, 'redirect' FROM l JOIN o USING (fp) WHERE (method = 'fingerprint' OR confidence >= 0.85) AND old_product <> product""",
}
