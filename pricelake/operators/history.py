"""Observation history: upserts, windows, lifetime values, merges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEEP_DAYS, KEEP_LEAST, REFERENCE_DAYS = 90, 2, 30
#: More rows than an offer has in a day.
DAY_ROWS = 1 << 31


def by_offer() -> WindowSpec:
    return Window.partitionBy("offer_id").orderBy("us", "seq")


def newest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each key that comes first in the order."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_at", at).filter("_at = 1").drop("_at")


def upsert_observations(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row per (offer_id, us): what came last. Applying the same rows again changes nothing."""
    return newest(stored.unionByName(incoming), ["offer_id", "us"], [F.desc("seq")])


def upsert_dimension(stored: DataFrame, incoming: DataFrame, key: str, keep_if_null: tuple[str, ...] = ()) -> DataFrame:
    """Incoming values win; columns named in keep_if_null keep the stored value where the new one is null."""
    new = incoming.select(F.col(key), *[F.col(c).alias(f"new_{c}") for c in incoming.columns if c != key], F.lit(True).alias("is_new"))
    values = [(F.coalesce(f"new_{c}", c) if c in keep_if_null else F.when(F.col("is_new"), F.col(f"new_{c}")).otherwise(F.col(c))).alias(c) for c in incoming.columns if c != key]
    return stored.join(new, key, "full_outer").select(key, *values)


def latest_price(obs: DataFrame) -> DataFrame:
    """The newest observation of each offer, without a sort."""
    last = F.max_by(F.struct("seq", "us", "price", "stock_status"), F.struct("us", "seq"))
    return obs.groupBy("offer_id", "retailer").agg(last.alias("l")).select("offer_id", "retailer", "l.*")


def latest_with_products(obs: DataFrame, offers: DataFrame, products: DataFrame) -> DataFrame:
    """The newest observation of each offer, active or not, with its product; offers never observed are left out. offers: id,
    product_id, sku; products: id, title, category."""
    own = offers.select(F.col("id").alias("offer_id"), "product_id", "sku")
    named = products.select(F.col("id").alias("product_id"), "title", "category")
    return latest_price(obs).join(own, "offer_id").join(named, "product_id").select("retailer", "sku", "product_id", "title", "category", "us", "price", "stock_status")


def price_history(obs: DataFrame, as_of_us: Column, days: int) -> DataFrame:
    return obs.filter(F.col("us") >= as_of_us - days * 86_400_000_000)


def prune_history(obs: DataFrame, keep_days: int = KEEP_DAYS, least: int = KEEP_LEAST) -> DataFrame:
    """Rows of the last ``keep_days`` before an offer's newest; at least the newest ``least``."""
    of = Window.partitionBy("offer_id")
    back = F.row_number().over(of.orderBy(F.desc("day"), F.desc("seq")))
    rows = obs.withColumn("_newest", F.max("day").over(of)).withColumn("_back", back)
    return rows.filter((F.col("_newest") - F.col("day") <= keep_days) | (F.col("_back") <= least)).drop("_newest", "_back")


def lifetime_stats(obs: DataFrame) -> DataFrame:
    return obs.groupBy("offer_id").agg(F.min("price").alias("all_time_low"), F.max("price").alias("all_time_high"), F.min("day").alias("first_seen"), F.count("*").alias("n"))


def with_prior(obs: DataFrame) -> DataFrame:
    """Adds previous price, drop and the all-time low before each row."""
    before = by_offer().rowsBetween(Window.unboundedPreceding, -1)
    prev = F.lag("price").over(by_offer())
    return obs.withColumn("previous_price", prev).withColumn("prior_low", F.min("price").over(before)).withColumn("drop_value", F.col("previous_price") - F.col("price")).withColumn("drop_percent", F.try_divide(F.col("previous_price") - F.col("price"), F.col("previous_price")) * 100)


def reference_window(obs: DataFrame, days: int = REFERENCE_DAYS, with_median: bool = False) -> DataFrame:
    """Adds thirty_day_low, window_n and history_days; with_median also the window's median.

    The window has earlier rows dated at most ``days`` before the row's date, earlier rows of the same date included. Rows that
    pruning would have dropped by then don't count for history_days.

    Rows are ordered by a number of their day, 2 * DAY_ROWS apart, plus their place in it, so that one frame of a fixed range holds
    the window: its lower end falls between two days.
    """
    by_day = Window.partitionBy("offer_id").orderBy("day")
    place = F.row_number().over(Window.partitionBy("offer_id", "day").orderBy("us", "seq"))
    rows = with_prior(obs).withColumn("_oldest", F.min("day").over(by_day.rangeBetween(-KEEP_DAYS, 0)))
    rows = rows.withColumn("_key", F.col("day").cast("long") * (2 * DAY_ROWS) + place)
    window = Window.partitionBy("offer_id").orderBy("_key").rangeBetween(-(2 * days + 1) * DAY_ROWS, -1)
    low, n = F.min("price").over(window), F.count("price").over(window)
    oldest = F.least(F.lag("_oldest").over(by_offer()), F.lag("day", KEEP_LEAST).over(by_offer()))
    rows = rows.withColumn("window_low", low).withColumn("window_n", n).withColumn("history_days", F.coalesce(F.col("day") - oldest, F.lit(0)))
    if with_median:
        rows = rows.withColumn("median", F.percentile("price", 0.5).over(window))
    return rows.withColumn("thirty_day_low", F.coalesce("window_low", "previous_price")).drop("_oldest", "_key")


def window_provenance(n: Column) -> Column:
    """By the number of prices in a window. null: unknown; 0: confirmed_empty; else genuine."""
    return F.when(n.isNull(), "unknown").when(n == 0, "confirmed_empty").otherwise("genuine")


#: What makes two rows of a history the same observation; the time and the stock status may be missing.
SIGNATURE = ["day", "us", "price", "stock_status"]


def merge_aliases(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union of two histories without repeated observations; where two are the same the first side's seq stays."""
    both = first.withColumn("_side", F.lit(0)).unionByName(second.withColumn("_side", F.lit(1)))
    return both.groupBy("offer_id", *SIGNATURE).agg(F.min_by("seq", F.struct("_side", "seq")).alias("seq"))


def merge_products(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row per product of either side: the first side's fields, the lowest and highest price and the earliest day of both."""
    merged = {"all_time_low": F.min, "all_time_high": F.max, "first_seen": F.min}
    both = first.withColumn("_side", F.lit(0)).unionByName(second.withColumn("_side", F.lit(1)))
    fields = [c for c in first.columns if c != "product_id" and c not in merged]
    return both.groupBy("product_id").agg(F.min_by(F.struct(*fields), "_side").alias("_f"), *[f(c).alias(c) for c, f in merged.items()]).select("product_id", "_f.*", *merged)


@dataclass
class History:
    """A document of price histories as tables: ``products`` (product_id, schema_version, all_time_low, all_time_high, first_seen and
    other fields) and ``rows`` (product_id and SIGNATURE). A product may have no row."""

    products: DataFrame
    rows: DataFrame


def one_version(*sides: DataFrame) -> None:
    """Refuses to merge documents of different schema versions (each side: schema_version)."""
    found = sorted({r["schema_version"] for s in sides for r in s.select("schema_version").distinct().limit(3).collect()})
    if len(found) > 1:
        raise ValueError(f"schema versions differ: {found}")


def three_way_merge(base: History | None, incoming: History, tip: History) -> History:
    """What two runs made of one base, both kept.

    A product that one side alone has stays as it is there; not having it does not remove it. Of a product that both have, the
    rows that incoming added stay, and the tip's rows (each once) unless incoming removed them; a row that the tip removed
    is gone. Incoming's fields win, lifetime values are those of both. No base is an empty one.
    """
    rows = merged_copies(base, incoming, tip).select("product_id", *SIGNATURE, F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_")).drop("_")
    return History(merge_products(incoming.products, tip.products), rows)


def merged_copies(base: History | None, incoming: History, tip: History) -> DataFrame:
    """product_id, SIGNATURE and copies: how often a row is in the merge of three_way_merge, 0 for one that is gone.

    All three sides are dealt by product in one exchange and counted there by signature; only the products' ids are joined to that.
    """
    one_version(incoming.products, tip.products)
    sides = {"in_base": base, "in_incoming": incoming, "in_tip": tip}
    counted = None
    for name, side in sides.items():
        if side is not None:
            rows = side.rows.select("product_id", *SIGNATURE, *[F.lit(int(name == n)).alias(n) for n in sides])
            counted = rows if counted is None else counted.unionByName(rows)
    counted = counted.repartition("product_id").groupBy("product_id", *SIGNATURE).agg(*[F.sum(n).alias(n) for n in sides])
    there = incoming.products.select("product_id", F.lit(True).alias("of_incoming")).join(tip.products.select("product_id", F.lit(True).alias("of_tip")), "product_id", "full_outer")
    once = F.least("in_tip", F.lit(1))
    both = F.when(F.col("in_base") == 0, F.when(F.col("in_incoming") > 0, F.col("in_incoming")).otherwise(once)).when(F.col("in_incoming") > 0, once).otherwise(0)
    copies = F.when(F.col("of_tip").isNull(), F.col("in_incoming")).when(F.col("of_incoming").isNull(), F.col("in_tip")).otherwise(both)
    return counted.join(there, "product_id").select("product_id", *SIGNATURE, copies.alias("copies"))


def daily_series(obs: DataFrame, least: int = 3) -> DataFrame:
    """Each offer's last price of a day as a sorted series, with its drops, from ``least`` days on."""
    last = obs.groupBy("offer_id", "day").agg(F.max_by("price", F.struct("us", "seq")).alias("price"))
    drop = F.col("price") < F.lag("price").over(Window.partitionBy("offer_id").orderBy("day"))
    series = last.withColumn("is_drop", F.coalesce(drop, F.lit(False)).cast("int"))
    return series.groupBy("offer_id").agg(
        F.array_sort(F.collect_list(F.struct("day", "price"))).alias("series"), F.count("*").alias("points"), F.sum("is_drop").alias("drops"), F.min("price").alias("low"), F.max("price").alias("high"),
    ).filter(F.col("points") >= least)
