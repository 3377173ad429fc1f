"""Queries of sources and sinks: documents are written from the given tables and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import documents, pages
from ..sources.scratch import shared_path, written
from . import adapters as A


def _history(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    obs = A.observations(spark, d)
    url = F.concat(F.lit('https://x.example.com/"p"/'), "offer_id")
    rows = obs.select(url.alias("url"), F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd").alias("date"), F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("observed_at"), "price", F.when(F.col("seq") % 6 != 0, F.when(F.col("offer_id").endswith("7") & (F.col("seq") % 3 == 1), "strange").otherwise(F.col("stock_status"))).alias("stock_status"))
    products = obs.groupBy(url.alias("url")).agg(F.lit("a title").alias("title"), F.max("retailer").alias("site"), F.lit(None).cast("string").alias("seller"), F.lit(None).cast("boolean").alias("is_marketplace"), F.lit(None).cast("double").alias("reference_price"), F.min("price").alias("all_time_low"), F.max("price").alias("all_time_high"), F.date_format(F.timestamp_micros(F.min("us")), "yyyy-MM-dd").alias("first_seen"))
    return products, rows


def price_history_round_trip(spark: SparkSession, d: str) -> DataFrame:
    products, rows = _history(spark, d)
    path = shared_path(spark, "history-lines")
    documents.write_price_history(products, rows, path)
    # One document a line; each becomes a file of its own where runs write their own files.
    lines = spark.read.text(path)
    doc = F.explode(F.from_json("value", documents.BARE)).alias("url", "e")
    back = lines.select(doc).select("url", F.explode("e.history").alias("r"))
    return back.groupBy("url").agg(F.count("*").alias("n"), F.min("r.price").alias("low"), F.max("r.observed_at").alias("last"))


def read_price_history(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a site each, one file a document, some of the bare form, some entries broken."""
    products, rows = _history(spark, d)
    nested = documents.price_history_rows(products, rows)
    n = F.length("url")
    entry = F.struct(*[c for c in nested.columns if c not in ("url", "history")], F.when(~F.col("url").endswith("3"), F.col("history")).alias("history"))
    whole = nested.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("url", entry.alias("e")))).alias("products"))
    text = F.when(F.col("site") == "store_1", F.to_json("products")).otherwise(F.to_json(F.struct(F.lit(1).alias("schema_version"), "products")))
    path = shared_path(spark, "history-documents")
    whole.select(text.alias("value"), F.col("site").alias("part")).repartition("part").write.partitionBy("part").text(path)
    got, obs, rejected = documents.read_price_history(spark, path)
    a = obs.groupBy("url").agg(F.count("*").alias("n"), F.sum(F.col("stock_status").isNull().cast("int")).cast("long").alias("no_stock"))
    return a.unionByName(rejected.select("url", F.lit(-1).cast("long").alias("n"), F.lit(0).cast("long").alias("no_stock")))


def read_large_history(spark: SparkSession, d: str) -> DataFrame:
    """A document of each site, written entry by entry, so that no task holds one; read in blocks of its file."""
    products, rows = _history(spark, d)
    nested = documents.price_history_rows(products, rows)
    entry = F.to_json(F.struct(*[c for c in nested.columns if c not in ("url", "history")], F.when(~F.col("url").endswith("3"), F.col("history")).alias("history")))
    of_site = Window.partitionBy("site").orderBy("url")
    wrapped = F.col("site") != "store_1"
    first, last = F.row_number().over(of_site) == 1, F.lead("url").over(of_site).isNull()
    name = F.to_json(F.array("url")).substr(F.lit(2), F.length(F.to_json(F.array("url"))) - 2)
    # A document's end stands with its last entry: rows of a union need not meet in one file.
    line = F.concat(F.when(first, F.when(wrapped, '{"schema_version": 1, "products": {').otherwise("{")).otherwise(","), name, F.lit(": "), entry, F.when(last, F.when(wrapped, "\n}}").otherwise("\n}")).otherwise(""))
    path = shared_path(spark, "large-documents")
    nested.select("site", "url", line.alias("value")).repartition("site").sortWithinPartitions("site", "url").select("value", F.col("site").alias("part")).write.partitionBy("part").text(path)
    got, obs, rejected = documents.read_large_history(spark, path)
    a = obs.groupBy("url").agg(F.count("*").alias("n"), F.sum(F.col("stock_status").isNull().cast("int")).cast("long").alias("no_stock"))
    return a.unionByName(rejected.select("url", F.lit(-1).cast("long").alias("n"), F.lit(0).cast("long").alias("no_stock")))


def read_event_log(spark: SparkSession, d: str) -> DataFrame:
    e = A.read(spark, d, "events")
    line = F.when(F.col("event_id") % 50 == 0, "{broken").when(F.col("event_id") % 70 == 0, "[1, 2]").when(F.col("event_id") % 90 == 0, "   ").otherwise(F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), "value")))
    path = shared_path(spark, "log-lines")
    e.select(line.alias("value")).write.text(path)
    rows, counts = documents.read_event_log(spark, path, "id long, kind string, value double")
    total = counts.agg(F.sum("malformed").alias("n")).select(F.lit("malformed").alias("kind"), "n", F.lit(None).cast("double").alias("most"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.max("value").alias("most")).unionByName(total)


def load_watches(spark: SparkSession, d: str) -> DataFrame:
    w = A.watches(spark, d)
    k = F.substring("watch_id", 2, 9).cast("int")
    one = F.struct(F.when(k % 6 != 0, F.col("watch_id")).alias("id"), F.when(k % 13 != 0, F.col("site")).alias("site"), "query", F.when(k % 17 == 0, "https://x.example.com/p").alias("direct_url"), F.when(k % 5 == 0, -1.0).otherwise(F.col("target_price")).alias("target_price"), "min_drop_percent", F.when(k % 8 == 0, "other").otherwise(F.col("atl_policy")).alias("atl_policy"), "cooldown_hours", "enabled", F.when(k % 9 == 0, F.array(F.lit("email"), F.lit("email"))).otherwise(F.col("channels")).alias("channels"))
    docs = w.select((k % 4).alias("g"), one.alias("w")).groupBy("g").agg(F.collect_list("w").alias("watches"))
    text = F.when(F.col("g") == 0, F.to_json("watches")).otherwise(F.to_json(F.struct("watches")))
    good, bad = documents.load_watches(docs.select(text.alias("value")))
    reasons = bad.select(F.explode("errors").alias("e")).select(F.regexp_extract("e", r"\]\.(\w+):", 1).alias("what"))
    return good.select(F.lit("valid").alias("what")).unionByName(reasons).groupBy("what").agg(F.count("*").alias("n"))


def snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Two snapshots; the newer loses its files, so that the older one is read."""
    root = shared_path(spark, "snapshots")
    part = A.read(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    documents.publish_snapshot(spark, {"part": part.filter("p_partkey % 2 = 0")}, root, 1)
    documents.publish_snapshot(spark, {"part": part}, root, 2)
    part.limit(0).write.mode("overwrite").parquet(f"{root}/2/part")
    return documents.latest_valid_snapshot(spark, root)["part"]


def migrate_history(spark: SparkSession, d: str) -> DataFrame:
    products, rows = _history(spark, d)
    typed = rows.withColumn("date", F.to_date("date")).withColumn("observed_at", F.when(F.col("price") > 10, F.to_timestamp("observed_at")))
    typed = typed.withColumn("stock_status", F.when(F.col("stock_status") != "unknown", F.col("stock_status")))
    kept, skipped = documents.migrate_history(products, typed)
    a = kept.groupBy("retailer").agg(F.count("*").alias("n"), F.count_if("in_stock").alias("in_stock"), F.count_if(F.date_format("scraped_at", "HH:mm:ss.SSSSSS") == "00:00:00.000000").alias("midnight"))
    zero = F.lit(0).cast("long")
    return a.unionByName(skipped.agg(F.count("*").alias("n")).select(F.lit("skipped").alias("retailer"), "n", zero.alias("in_stock"), zero.alias("midnight")))


def reconcile_tables(spark: SparkSession, d: str) -> DataFrame:
    li = A.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("order"), F.col("l_partkey").alias("part"))
    source = li.unionByName(li.filter("order % 10 = 0"))
    target = li.filter("part % 100 <> 0").distinct()
    return documents.reconcile(source, target, A.read(spark, d, "orders").filter("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("order")), ["order", "part"], "order")


RULES = {f"store_{k}": {"card": f"card{k}", "title": f"t{k}", "price": f"p{k}", "reference": f"r{k}", "stock": f"s{k}"} for k in range(4)}


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """A page per part: a card, some with structured data, some with a semantic value, some without a price. A page is ten times the
    size of its row and slow to read, so the rows of a small file are dealt to all tasks first."""
    p, k = A.read(spark, d, "part").select("p_partkey", "p_name", "p_retailprice").repartition(8 * spark.sparkContext.defaultParallelism, "p_partkey"), F.col("p_partkey")
    q = (k % 4).cast("string")
    url = F.concat(F.lit("https://www.shop.example.com/p/"), k.cast("string"))
    price = F.format_string("%.2f", F.col("p_retailprice"))
    offer = F.to_json(F.struct(F.lit("Product").alias("@type"), F.col("p_name").alias("name"), F.when(k % 2 == 0, url).alias("url"), F.struct(price.alias("price"), F.when(k % 5 == 0, "https://schema.org/OutOfStock").otherwise("https://schema.org/InStock").alias("availability")).alias("offers")))
    ld = F.when(k % 3 == 0, F.concat(F.lit('<script type="application/ld+json">'), F.when(k % 6 == 0, F.concat(F.lit('{"@graph":['), offer, F.lit("]}"))).otherwise(offer), F.lit("</script>"))).otherwise("")
    shown = F.when(k % 7 == 0, "").otherwise(F.concat(F.lit('<span class="p'), q, F.lit('">'), F.when(k % 11 == 0, "la cerere").otherwise(F.concat(F.regexp_replace(F.format_string("%.2f", F.col("p_retailprice") + 1), r"\.", ","), F.lit(" Lei"))), F.lit("</span>")))
    semantic = F.when(k % 5 == 1, F.concat(F.lit(' data-price="'), F.format_string("%.2f", F.col("p_retailprice") + 2), F.lit('"'))).otherwise("")
    html = F.concat(F.lit("<html>"), ld, F.lit('<div class="card'), q, F.lit('"'), semantic, F.lit('><a href="'), url, F.lit('?utm_source=x"><h2 class="t'), q, F.lit('">'), "p_name", F.lit("</h2></a>"), shown, F.lit("</div></html>"))
    return p.select(k.alias("page_id"), F.concat(F.lit("store_"), q).alias("retailer"), html.alias("html"))


def extract_jsonld(spark: SparkSession, d: str) -> DataFrame:
    return pages.extract_jsonld(_pages(spark, d))


def extract_listing_cards(spark: SparkSession, d: str) -> DataFrame:
    return pages.extract_cards(_pages(spark, d), RULES).select("page_id", "title", "url", "price_text", "semantic_price")


def resolve_layered_price(spark: SparkSession, d: str) -> DataFrame:
    src = written(_pages(spark, d), "pages")
    return pages.resolve_price(pages.extract_cards(src, RULES), pages.extract_jsonld(src)).select("page_id", F.round("price", 2).alias("price"), "price_layer")


def extraction_failures(spark: SparkSession, d: str) -> DataFrame:
    src = written(_pages(spark, d), "pages")
    failed = pages.extraction_failures(pages.resolve_price(pages.extract_cards(src, RULES), pages.extract_jsonld(src)))
    return pages.failures_by_store(failed, src)


QUERIES = {f.__name__: f for f in (
    price_history_round_trip, read_price_history, read_large_history, read_event_log, load_watches, snapshot, migrate_history, reconcile_tables, extract_jsonld, extract_listing_cards, resolve_layered_price, extraction_failures,
)}

HIST = A.OBS + """,
hist AS (SELECT 'https://x.example.com/"p"/' || offer_id AS url, retailer, us, price, CASE WHEN seq % 6 <> 0 THEN CASE WHEN ends_with(offer_id, '7') AND seq % 3 = 1 THEN 'strange' ELSE stock_status END END AS stock_status FROM obs)"""
PRICE = """SELECT p_partkey AS page_id, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice WHEN p_partkey % 5 = 1 THEN p_retailprice + 2 WHEN p_partkey % 7 = 0 OR p_partkey % 11 = 0 THEN NULL ELSE p_retailprice + 1 END AS price,
  CASE WHEN p_partkey % 3 = 0 THEN 'jsonld' WHEN p_partkey % 5 = 1 THEN 'semantic' WHEN p_partkey % 7 = 0 OR p_partkey % 11 = 0 THEN NULL ELSE 'text' END AS price_layer FROM part"""
SQL = {
    "price_history_round_trip": f"WITH {HIST} SELECT url, count(*) AS n, min(price) AS low, strftime(make_timestamp(max(us)), '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS last FROM hist GROUP BY url",
    "read_price_history": f"WITH {HIST} SELECT url, CASE WHEN ends_with(url, '3') THEN -1 ELSE count(*) END AS n, CASE WHEN ends_with(url, '3') THEN 0 ELSE count(*) FILTER (WHERE stock_status IS NULL) END AS no_stock FROM hist GROUP BY url",
    "read_event_log": """SELECT event_type AS kind, count(*) AS n, max(value) AS most FROM events WHERE event_id % 50 <> 0 AND event_id % 70 <> 0 AND event_id % 90 <> 0 GROUP BY 1
      UNION ALL SELECT 'malformed', count(*), NULL FROM events WHERE event_id % 50 = 0 OR event_id % 70 = 0""",
    "load_watches": f"""WITH {A.WATCHES}, e AS (SELECT substr(watch_id, 2)::INT AS k FROM watches), x AS (SELECT k, k % 13 = 0 AS a, k % 17 = 0 AS b, k % 5 = 0 AS c, k % 8 = 0 AS d, k % 9 = 0 AS f FROM e)
      SELECT what, n FROM (SELECT 'valid' AS what, count(*) FILTER (WHERE NOT (a OR b OR c OR d OR f)) AS n FROM x UNION ALL SELECT 'site', count(*) FILTER (WHERE a) FROM x UNION ALL SELECT 'query', count(*) FILTER (WHERE b) FROM x
        UNION ALL SELECT 'target_price', count(*) FILTER (WHERE c) FROM x UNION ALL SELECT 'atl_policy', count(*) FILTER (WHERE d) FROM x UNION ALL SELECT 'channels', count(*) FILTER (WHERE f) FROM x) WHERE n > 0""",
    "snapshot": "SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey % 2 = 0",
    "migrate_history": f"""WITH {HIST}, h AS (SELECT *, nullif(stock_status, 'unknown') AS st FROM hist), bad AS (SELECT DISTINCT url FROM h WHERE st = 'strange')
      SELECT retailer, count(*) AS n, count(*) FILTER (WHERE st IS DISTINCT FROM 'out_of_stock') AS in_stock, count(*) FILTER (WHERE price <= 10 OR us % 86400000000 = 0) AS midnight FROM h WHERE url NOT IN (SELECT url FROM bad) GROUP BY retailer
      UNION ALL SELECT 'skipped', count(*), 0, 0 FROM bad""",
    "reconcile_tables": """WITH s AS (SELECT l_orderkey AS o, l_partkey AS p FROM lineitem UNION ALL SELECT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey % 10 = 0), t AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_partkey % 100 <> 0)
      SELECT 'source_rows' AS "check", count(*) AS value FROM s UNION ALL SELECT 'expected_rows', count(*) FROM (SELECT DISTINCT * FROM s) UNION ALL SELECT 'target_rows', count(*) FROM t
      UNION ALL SELECT 'orphans', count(*) FROM t WHERE o NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0)
      UNION ALL SELECT 'sample_differs', count(*) FROM (SELECT o_orderkey AS o FROM orders WHERE o_orderkey % 7 <> 0 ORDER BY md5('7:' || o_orderkey), o_orderkey LIMIT 50)
        LEFT JOIN (SELECT o, count(DISTINCT p) AS a FROM s GROUP BY o) USING (o) LEFT JOIN (SELECT o, count(*) AS b FROM t GROUP BY o) USING (o) WHERE a IS DISTINCT FROM b""",
    "extract_jsonld": "SELECT p_partkey AS page_id, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN 'https://www.shop.example.com/p/' || p_partkey END AS url, round(p_retailprice, 2) AS price, p_partkey % 5 <> 0 AS in_stock FROM part WHERE p_partkey % 3 = 0",
    "extract_listing_cards": """SELECT p_partkey AS page_id, p_name AS title, 'https://www.shop.example.com/p/' || p_partkey || '?utm_source=x' AS url, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN 'la cerere' ELSE replace(printf('%.2f', p_retailprice + 1), '.', ',') || ' Lei' END AS price_text,
      CASE WHEN p_partkey % 5 = 1 THEN printf('%.2f', p_retailprice + 2) END AS semantic_price FROM part""",
    "resolve_layered_price": f"SELECT page_id, round(price, 2) AS price, price_layer FROM ({PRICE})",
    "extraction_failures": f"SELECT 'store_' || (page_id % 4) AS retailer, CASE WHEN page_id % 7 = 0 THEN 'no_price_element' ELSE 'unreadable_price' END AS reason, count(*) AS n FROM ({PRICE}) WHERE price IS NULL GROUP BY ALL",
}
SQL["read_large_history"] = SQL["read_price_history"]
