"""Tests of the growth findings of round 3."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelake.functions import ranking
from pricelake.operators import anomaly, deals, history, watchlist
from pricelake.plans import source_queries, streaming_queries
from pricelake.streaming import jobs

from .conftest import SMALL

OBS = "offer_id string, day int, us long, seq long, price double, stock_status string, reference_price double"


def _offers(spark, offers: int, days: int):
    rows = [(f"o{k}", d, d * anomaly.DAY + k, k * days + d, float((k * 7 + d * 13) % 29 + 1), "in_stock", None) for k in range(offers) for d in range(days)]
    return spark.createDataFrame(rows, OBS)


def test_tasks_of_window_statistics_follow_the_rows(spark, monkeypatch):
    obs = _offers(spark, 40, 20)
    monkeypatch.setattr(deals, "TASK_ROWS", 50)
    got = deals.window_statistics(obs, 5)
    assert got.rdd.getNumPartitions() == 16 and got.count() == 800
    assert got.filter("n > 0").count() == 40 * 19


@pytest.mark.parametrize("n", [1, 2, 7, 9000])
def test_percentiles_are_those_of_spark_without_a_column_in_a_task(spark, n):
    k = F.col("id")
    rows = spark.range(n).select(F.when(k % 11 != 5, F.pmod(F.xxhash64(k), F.lit(1_000_003)) / 7).alias("a"), (k % 3).cast("double").alias("b"), F.lit(None).cast("double").alias("c"))
    shares = (0.0, 0.25, 0.5, 0.75, 1.0)
    want = rows.agg(*[F.percentile(c, list(shares)).alias(c) for c in "abc"]).first()
    assert ranking.percentiles(rows, ("a", "b", "c"), shares) == {c: want[c] or [None] * 5 for c in "abc"}


def test_complete_trees_reach_the_leaves_of_the_grown_ones():
    rng = np.random.default_rng(3)
    nodes = np.array([[0, 0.5, 1, 2, 0], [-1, 0, -1, -1, 1.25], [1, 0.3, 3, 4, 1], [-1, 0, -1, -1, 2.5], [2, 0.7, 5, 6, 2], [-1, 0, -1, -1, 3.5], [-1, 0, -1, -1, 3.75]])
    feature, cut, deep, levels = anomaly._complete(nodes)
    for x in [*rng.random((50, 3)), np.array([np.nan] * 3)]:
        at = place = 0
        while nodes[at, 0] >= 0:
            at = int(nodes[at, 2 if x[int(nodes[at, 0])] < nodes[at, 1] else 3])
        for _ in range(levels):
            place = 2 * place + 2 - int(x[feature[place]] < cut[place])
        assert deep[place] == nodes[at, 4]


def test_pages_of_one_small_file_are_made_and_read_in_many_tasks(spark):
    made = source_queries._pages(spark, SMALL)
    assert spark.read.parquet(f"{SMALL}/part.parquet").rdd.getNumPartitions() == 1
    sizes = made.groupBy(F.spark_partition_id()).count()
    assert made.rdd.getNumPartitions() >= 8 * spark.sparkContext.defaultParallelism and sizes.agg(F.max("count")).first()[0] < made.count() / 4


def test_an_audit_shuffles_the_first_matches_alone_and_counts_all(spark):
    checks = spark.createDataFrame([("w", "s", "laptop x", True, "example.com", False, False, False)], "watch_id string, store string, query string, is_supported boolean, host string, failed boolean, challenged boolean, extraction_failed boolean")
    url = "https://a.example.com/p"
    titles = [None, "laptop y", *[f"X  laptop {k}" for k in range(7)]]
    rows = spark.createDataFrame([("w", "s", k, t, "https://b.org/" if t == "X  laptop 6" else url) for k, t in enumerate(titles)], "watch_id string, store string, at int, title string, url string")
    audit = watchlist.audit_watches(checks, rows)
    r = audit.first()
    assert (r["status"], r["n"], r["samples"]) == ("PASS", 7, [f"X  laptop {k}" for k in range(5)])
    assert "WindowGroupLimit" in audit._jdf.queryExecution().toString()


def test_change_points_of_many_offers_are_found_together(spark):
    """Spans go over batches of seven rows, and some hold series longer than SHORT."""
    rng = np.random.default_rng(5)
    rows, want, seq = [], {}, 0
    for offer, n in enumerate((1, 5, 6, 30, 31, 400, 40, 2)):
        days = np.sort(rng.integers(0, 60, n))
        prices = np.round(rng.choice([50.0, 80.0, 100.0], n) + rng.integers(0, 5, n), 2)
        flags = anomaly.fallen(prices, days, np.ones(n, bool), 20)
        for k in range(n):
            rows.append((f"o{offer}", int(days[k]), seq, seq, float(prices[k])))
            want[seq], seq = bool(flags[k]), seq + 1
    obs = spark.createDataFrame(rows, "offer_id string, day int, us long, seq long, price double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        found = anomaly.pelt_drop_flag(obs, 20)
        assert {r["seq"]: r["pelt_flag"] for r in found.collect()} == want and any(want.values())
        assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_short_series_together_are_as_the_long_way_says(monkeypatch):
    rng = np.random.default_rng(6)
    prices, days = rng.choice([50.0, 80.0, 100.0], 300) + rng.integers(0, 5, 300), np.repeat(np.arange(60), 5)
    groups, own = np.repeat([0, 1, 2], 100), np.ones(300, bool)
    together = anomaly.fallen(prices, days, own, 20, groups)
    monkeypatch.setattr(anomaly, "SHORT", 0)
    apart = np.concatenate([anomaly.fallen(prices[k : k + 100], days[k : k + 100], own[:100], 20) for k in (0, 100, 200)])
    assert (together == apart).all() and together.any()


def test_copies_of_a_merge_count_its_rows_and_keep_what_is_gone(spark):
    def side(*rows):
        products = spark.createDataFrame([(p, 1, "t", 1.0, 1.0, 1) for p in sorted({r[0] for r in rows})], "product_id string, schema_version int, title string, all_time_low double, all_time_high double, first_seen int")
        return history.History(products, spark.createDataFrame(list(rows), "product_id string, day int, us long, price double, stock_status string"))

    a, b, c = ("p", 1, None, 1.0, None), ("p", 2, 5, 2.0, "in_stock"), ("q", 1, None, 3.0, None)
    docs = side(a, b), side(a, c, c), side(a, b)
    copies = {(r["product_id"], r["day"]): r["copies"] for r in history.merged_copies(*docs).collect()}
    assert copies == {("p", 1): 1, ("p", 2): 0, ("q", 1): 2}
    rows = history.three_way_merge(*docs).rows
    assert sorted((r["product_id"], r["day"]) for r in rows.collect()) == [("p", 1), ("q", 1), ("q", 1)]


def _drained(stream, at):
    """The table that a stream makes, and how many states it holds at its end."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"file://{at}/state").option("path", f"file://{at}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return stream.sparkSession.read.schema(stream.schema).parquet(f"file://{at}/out"), states[-1]


def test_offers_of_the_alert_query_share_calls_and_states(spark, tmp_path, monkeypatch):
    states = []

    def drain(stream, name):
        table, n = _drained(stream, tmp_path)
        states.append(n)
        return table

    monkeypatch.setattr(jobs, "drain", drain)
    monkeypatch.setattr(jobs, "GROUP_OFFERS", 4, raising=False)
    offers = spark.read.parquet(f"{SMALL}/events.parquet").select("user_id").distinct().count()
    assert streaming_queries.stream_alerts(spark, SMALL).select("seq").distinct().count() == 1000
    assert 1 <= states[0] <= offers // 4 + 1 < offers


@pytest.mark.parametrize("groups", [1, 7])
def test_offers_of_a_group_keep_their_own_state_over_batches(spark, tmp_path, monkeypatch, groups):
    """Three batches of twelve offers, one without an id; the last batch comes after a gap that pruning forgets. Rows are given in pieces of 50."""
    monkeypatch.setattr(jobs, "GIVEN_ROWS", 50)
    obs = _offers(spark, 12, 30).withColumn("offer_id", F.when(F.col("offer_id") != "o5", F.col("offer_id")))
    obs = obs.withColumn("day", F.col("day") + F.when(F.col("day") >= 20, 100).otherwise(0)).withColumn("us", F.col("day") * F.lit(anomaly.DAY) + F.col("seq"))
    obs = obs.withColumn("reference_price", F.when(F.col("seq") % 3 == 0, F.col("price") * 1.3))
    for first, until in ((0, 9), (9, 20), (20, 200)):
        obs.filter(f"day >= {first} and day < {until}").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    kinds = [("w1", "aggressive", None, None), ("w2", "off", 20.0, 10.0)]
    watches = spark.createDataFrame([(f"o{k}", *w) for k in range(0, 12, 2) for w in kinds], "offer_id string, watch_id string, policy string, target double, min_drop double")
    stream = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    got, states = _drained(jobs.stream_alerts(stream, watches, groups, 5), tmp_path)
    low = deals.alert_gate(F.col("previous_price"), F.col("price"), F.col("stock_status"), F.col("prior_low"), F.col("policy"), F.col("target"), F.col("min_drop"))
    rows = history.reference_window(obs, 5).join(deals.reference_price_verdict(obs, 5).select("seq", "verdict"), "seq", "left").join(watches, "offer_id", "left")
    want = rows.select("seq", "watch_id", "previous_price", "thirty_day_low", F.col("history_days").cast("long"), F.coalesce(F.col("watch_id").isNotNull() & low, F.lit(False)).alias("alerts"), "verdict")
    assert states <= groups and got.count() == want.count() == 12 * 30 + 6 * 30
    assert got.exceptAll(want).count() == 0 and want.filter("alerts").count() > 0
