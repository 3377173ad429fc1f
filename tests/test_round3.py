"""Tests of the findings of round 3."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from pricelake.operators import anomaly, deals, identity, watchlist
from pricelake.plans import history_queries, source_queries
from pricelake.sources import documents
from pricelake.streaming import jobs


def test_few_labels_have_a_best_threshold(spark):
    rows = spark.createDataFrame([(-0.9, 1), (-0.8, 1), (-0.5, 0), (-0.2, 1), (-0.1, None)], "score double, label int")
    assert [r["score"] for r in anomaly.best_f1(rows.filter("label is not null")).collect()] == [-0.2]
    assert anomaly.best_f1(rows.filter("label > 1")).count() == 0
    with pytest.raises(ValueError, match="only 4 labelled rows"):
        anomaly.select_threshold(rows, "best_f1")


@pytest.mark.parametrize("read", [documents.read_price_history, documents.read_large_history])
def test_a_price_of_zero_is_a_price(spark, tmp_path, read):
    row = lambda price: {"date": "2024-01-01", "observed_at": None, "price": price, "stock_status": "in_stock"}
    (tmp_path / "a.json").write_text(json.dumps({"u1": {"title": "t", "history": [row(0.0), row(2.5)]}, "u2": {"title": "t", "history": [row(None)]}}))
    _, rows, rejected = read(spark, str(tmp_path))
    assert sorted((r["url"], r["price"]) for r in rows.collect()) == [("u1", 0.0), ("u1", 2.5)]
    assert [(r["url"], r["reason"]) for r in rejected.collect()] == [("u2", "bad_observation")]


def test_a_large_document_is_one_file_whatever_its_size(spark, monkeypatch):
    """A small table is coalesced into one partition, so it would not show parts in different files."""
    files = []
    read = documents.read_large_history
    monkeypatch.setattr(documents, "read_large_history", lambda s, path: (files.append(s.read.text(path).select("_metadata.file_path").distinct().count()), read(s, path))[1])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        got = source_queries.read_large_history(spark, "/root/testdata/sf0.1").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert files == [4] and got["url"].notna().all()



def test_streamed_observations_keep_a_price_of_zero(spark, tmp_path):
    schema = "offer_id string, us long, seq long, price double"
    spark.createDataFrame([("a", 1, 1, 0.0), ("a", 2, 2, 5.0), ("a", 2, 2, 5.0)], schema).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in").withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", "1 day")
    table = jobs.LogTable(spark, f"file://{tmp_path}/table", schema, ["offer_id", "us"], "seq", mark="us")
    jobs.stream_observations(stream, table, jobs.LogTable(spark, f"file://{tmp_path}/late", schema), 86_400_000_000)
    assert sorted(map(tuple, table.read().collect())) == [("a", 1, 1, 0.0), ("a", 2, 2, 5.0)]


def test_watches_fan_out_to_every_given_store(spark):
    from .conftest import SMALL

    every = deals.expand_watches(history_queries.A.watches(spark, SMALL), spark.createDataFrame([(f"store_{k}", False) for k in range(4)], "store string, is_placeholder boolean"))
    assert sorted(map(tuple, history_queries.expand_watches(spark, SMALL).collect())) == sorted(map(tuple, every.select("watch_id", "store").collect()))


def test_keys_of_titles_lose_no_pair(spark):
    """Titles of 1 to 14 words, with and without codes and processors, against all pairs; copies of a title are one class."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(12)] + ["ab1234q", "cd5678r", "core i5-13420h", "16 gb", "black", "red"]
    make = lambda kind, shop: [(f"{kind}{k}", shop, " ".join(rng.sample(words, rng.choice((1, 2, 5, 8, 13, 14))))) for k in range(150)]
    schema = "offer_id string, retailer string, title string"
    left, right = make("l", "one"), make("r", "two")
    right += [(f"c{k}", "two", t) for k, (_, _, t) in enumerate(left[:40])] * 1 + [(f"d{k}", "two", t) for k, (_, _, t) in enumerate(left[:40])]
    left, right = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    parts = ("offer_id", "tokens", "codes", "colors", "cpus", "capacities")
    a, b = (identity.with_title_parts(df).select(*[F.col(c).alias(f"{x}_{c}") for c in parts]) for x, df in (("a", left), ("b", right)))
    want = {(r["a_offer_id"], r["b_offer_id"], r["score"]) for r in a.crossJoin(b).withColumn("score", identity.title_score()[0]).filter(F.col("score") >= identity.MATCH).collect()}
    got = [(r["a_offer_id"], r["b_offer_id"], r["score"]) for r in identity.scored_pairs(left, right).collect()]
    assert len(want) > 150 and len(got) == len(want) and set(got) == want


def test_candidates_of_few_words_are_near_the_matches(spark):
    """A code, and words, that thousands of titles share: candidates stay a small multiple of what is accepted."""
    title = F.concat_ws(" ", F.lit("ring brand ab1234q"), *[F.concat(F.lit(x), (F.floor(F.col("id") / d) % m).cast("string")) for x, d, m in (("a", 1, 9), ("b", 9, 8), ("c", 72, 25), ("d", 1800, 7))])
    left, right = (spark.range(n).select(F.concat(F.lit(x), "id").alias("offer_id"), F.lit(x).alias("retailer"), title.alias("title")) for x, n in (("l", 3000), ("r", 1000)))
    (_, a), (_, b) = identity.title_classes(left), identity.title_classes(right)
    assert identity.candidate_pairs(a, b).count() < 3 * identity.scored_classes(a, b).count()


@pytest.mark.parametrize("match", [watchlist.match_titles, watchlist.match_titles_loosely])
def test_few_queries_go_to_the_titles(spark, monkeypatch, match):
    """No exchange of the titles' words, and the same matches as by one."""
    w = spark.createDataFrame([("w1", "all", "red ring"), ("w2", "s1", "ring-16 gb"), ("w3", "all", "ring")], "watch_id string, site string, query string")
    o = spark.createDataFrame([(f"o{k}", f"s{k % 2}", ("Red ring 16 GB", "ring 16gb", "blue rod", "red-ring")[k % 4]) for k in range(40)], "offer_id string, retailer string, title string")
    few = match(w, o)
    want = sorted(map(tuple, few.collect()))
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert want and "BroadcastHashJoin [key" in plan and "hashpartitioning(key" not in plan and "hashpartitioning(form" not in plan
    monkeypatch.setattr(watchlist, "FEW", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert sorted(map(tuple, match(w, o).collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
