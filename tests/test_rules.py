"""Known values and properties of the rules."""

from __future__ import annotations

import hashlib
import hmac
import json
import random
import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelake.functions import text as T
from pricelake.operators import anomaly, deals, delivery, feedback, health, history, identity, responses, retro, watchlist
from pricelake.plans import identity_queries, response_queries
from pricelake.sources import documents
from pricelake.streaming import jobs

DAY = 86_400_000_000
TODAY = 20_000


def series(spark, rows: list[tuple[int, float]], new: float | None = None, offer: str = "o"):
    """rows: (days ago, price); new: the price now."""
    out = [(offer, "s", k, (TODAY - ago) * DAY, TODAY - ago, float(p), "in_stock") for k, (ago, p) in enumerate(sorted(rows, reverse=True))]
    if new is not None:
        out.append((offer, "s", len(out), TODAY * DAY + 5, TODAY, float(new), "in_stock"))
    return spark.createDataFrame(out, "offer_id string, retailer string, seq long, us long, day int, price double, stock_status string")


@pytest.mark.parametrize(("rows", "new", "low", "old", "days"), [
    ([(20, 120), (15, 110), (10, 80), (5, 100), (1, 130)], 90, 80, 130, 20),
    ([(45, 10), (29, 120), (3, 140)], 100, 120, 140, 45),
    ([(60, 90), (40, 150)], 100, 150, 150, 60),
    ([(20, 200), (2, 150)], 60, 150, 150, 20),
])
def test_reference_window(spark, rows, new, low, old, days):
    r = history.reference_window(series(spark, rows, new)).orderBy(F.desc("us")).first()
    assert (r["thirty_day_low"], r["previous_price"], r["history_days"]) == (low, old, days)


def test_window_excludes_own_row_and_keeps_same_day(spark):
    r = history.reference_window(series(spark, [(0, 50), (3, 70)], 40)).orderBy(F.desc("us")).first()
    assert (r["thirty_day_low"], r["window_n"]) == (50, 2)


def test_history_days_forget_what_pruning_drops(spark):
    r = history.reference_window(series(spark, [(400, 9), (300, 9), (95, 9), (4, 9)], 8)).orderBy(F.desc("us")).first()
    assert r["history_days"] == 95


def test_statistics(spark):
    rows = deals.window_statistics(series(spark, [(5, 100), (4, 102), (3, 98), (2, 100), (1, 500)], 100))
    r = rows.orderBy(F.desc("us")).first()
    assert (r["n"], r["median"], r["mad"], r["window_low"]) == (5, 100.0, 2.0, 98.0)
    r = deals.window_statistics(series(spark, [(2, 100), (1, 90)], 81)).orderBy(F.desc("us")).first()
    assert round(r["genuine_savings"], 6) == 10.0
    first = deals.window_statistics(series(spark, [(2, 100)])).first()
    assert (first["n"], first["median"], first["stdev"]) == (0, None, None)


@pytest.mark.parametrize(("new", "low", "ref", "days", "want"), [
    (80, 100, None, 13, "INSUFFICIENT_HISTORY"), (100, 100, None, 14, "FALSE_DISCOUNT"), (90, 100, 126.0, 30, "INFLATED_REFERENCE"), (95, 100, 125.0, 30, "GENUINE_DEAL"), (96, 100, None, 30, "NORMAL_DROP"),
])
def test_verdict(spark, new, low, ref, days, want):
    df = spark.createDataFrame([(float(new), float(low), ref, days)], "n double, l double, r double, d int")
    assert df.select(deals.verdict(F.col("n"), F.col("l"), F.col("r"), F.col("d"))).first()[0] == want


@pytest.mark.parametrize(("prev", "new", "stock", "low", "policy", "target", "least", "want"), [
    (None, 5, "in_stock", None, "off", None, None, False), (100, 97, "in_stock", 90, "off", None, None, False), (100, 90, "out_of_stock", 95, "aggressive", None, None, False),
    (100, 99, "in_stock", 99.5, "aggressive", None, None, True), (100, 99, "in_stock", 99.5, "conservative", None, None, False), (100, 90, "in_stock", 95, "conservative", 80, 50, True),
    (100, 90, "in_stock", 95, "off", 80, None, False), (100, 90, "in_stock", None, "off", None, 11, False), (100, 90, "in_stock", None, "off", 90, 10, True),
])
def test_alert_gate(spark, prev, new, stock, low, policy, target, least, want):
    row = tuple(float(x) if isinstance(x, int | float) else x for x in (prev, new, stock, low, policy, target, least))
    df = spark.createDataFrame([row], "p double, n double, s string, l double, o string, t double, m double")
    assert df.select(deals.alert_gate(*[F.col(c) for c in "pnslotm"])).first()[0] is want


def test_unknown_policy_is_an_error(spark):
    df = spark.createDataFrame([(10.0, 5.0)], "p double, n double")
    with pytest.raises(Exception, match="unknown all-time-low policy"):
        df.select(deals.alert_gate(F.col("p"), F.col("n"), F.lit("x"), F.lit(1.0), F.lit("other"), F.lit(1.0), F.lit(1.0))).collect()


def test_merge_properties(spark):
    s = "offer_id string, day int, us long, price double, stock_status string, seq long"
    a = spark.createDataFrame([("o", 1, 10, 5.0, "in_stock", 1), ("o", 2, 20, 6.0, None, 2)], s)
    b = spark.createDataFrame([("o", 2, 20, 6.0, None, 9), ("o", 3, None, 7.0, None, 3), ("o", 1, 10, 5.0, "out_of_stock", 4), ("o", 1, 11, 5.0, "in_stock", 5)], s)
    once = history.merge_aliases(a, b)
    assert sorted(r["seq"] for r in once.collect()) == [1, 2, 3, 4, 5]  # a day's rows of another time or stock are kept
    assert sorted(map(str, history.merge_aliases(once.select(*a.columns), b).collect())) == sorted(map(str, once.collect()))
    p = "product_id string, title string, site string, all_time_low double, all_time_high double, first_seen int"
    first, second = spark.createDataFrame([("o", None, "s", 5.0, 9.0, 3), ("x", "x", "s", 1.0, 1.0, 1)], p), spark.createDataFrame([("o", "t", "u", 4.0, 8.0, 2), ("y", "y", "u", 2.0, 2.0, 2)], p)
    got = {r["product_id"]: tuple(r)[1:] for r in history.merge_products(first, second).collect()}
    assert got == {"o": (None, "s", 4.0, 9.0, 2), "x": ("x", "s", 1.0, 1.0, 1), "y": ("y", "u", 2.0, 2.0, 2)}
    history.one_version(spark.createDataFrame([(1,)], "schema_version int"), spark.createDataFrame([(1,)], "schema_version int"))
    with pytest.raises(ValueError, match="schema versions differ"):
        history.one_version(spark.createDataFrame([(1,)], "schema_version int"), spark.createDataFrame([(2,)], "schema_version int"))


def document(spark, products, version=1):
    """products: id to (rows, fields); a row is (day, us, price) or (day, us, price, stock)."""
    fields = [(k, version, f.get("title"), f.get("low"), f.get("high"), f.get("seen")) for k, (_, f) in products.items()]
    rows = [(k, *r, *[None] * (4 - len(r))) for k, (own, _) in products.items() for r in own]
    return history.History(
        spark.createDataFrame(fields, "product_id string, schema_version int, title string, all_time_low double, all_time_high double, first_seen int"),
        spark.createDataFrame(rows, "product_id string, day int, us long, price double, stock_status string"),
    )


OLD, BASE, A, B, LEGACY = (1, 10, 31.0, "in_stock"), (9, 90, 29.0, "in_stock"), (9, 95, 28.0, "in_stock"), (10, 99, 27.0, None), (2, None, 30.0)


@pytest.mark.parametrize(("base", "incoming", "tip", "want"), [
    ({"k": [BASE]}, {"k": [BASE, B]}, {"k": [BASE, A]}, {"k": [BASE, A, B]}),  # two runs from one base
    (None, {"k": [BASE, B]}, {"k": [BASE, A]}, {"k": [BASE, A, B]}),  # no base: the union
    ({"k": [BASE]}, {"k": [BASE], "new": [B]}, {"k": [BASE], "old": [A]}, {"k": [BASE], "new": [B], "old": [A]}),
    ({"gone": [BASE], "new": [BASE]}, {"new": [BASE]}, {"gone": [BASE]}, {"gone": [BASE], "new": [BASE]}),  # absence on one side removes nothing
    ({"k": [BASE], "o": [BASE]}, {"k": [BASE, B]}, {"k": [BASE], "o": [BASE, A]}, {"k": [BASE, B], "o": [BASE, A]}),
    ({"k": [OLD, BASE]}, {"k": [BASE, B]}, {"k": [OLD, BASE]}, {"k": [BASE, B]}),  # pruned rows stay pruned
    ({"k": [OLD, BASE]}, {"k": [BASE, B]}, {"k": [OLD, BASE, A]}, {"k": [BASE, A, B]}),
    ({"k": [OLD, BASE]}, {"k": []}, {"k": [OLD, BASE, A]}, {"k": [A]}),  # there, but with nothing left
    ({"k": [LEGACY, BASE]}, {"k": [LEGACY, BASE, B]}, {"k": [LEGACY, BASE, A]}, {"k": [LEGACY, BASE, A, B]}),
    ({"k": [BASE]}, {"k": [BASE, B, B]}, {"k": [BASE, BASE, A]}, {"k": [BASE, A, B, B]}),  # what incoming repeats stays, what the tip repeats is kept once
    ({"k": [BASE, A]}, {"k": [BASE, A]}, {"k": [BASE]}, {"k": [BASE]}),
    ({"x": [BASE]}, {}, {}, {}), ({}, {"k": [B, B]}, {}, {"k": [B, B]}),
])
def test_three_way_merge(spark, base, incoming, tip, want):
    side = lambda x: None if x is None else document(spark, {k: (rows, {}) for k, rows in x.items()})
    merged = history.three_way_merge(side(base), side(incoming), side(tip))
    full = lambda x: sorted(((k, *r, *[None] * (4 - len(r))) for k, rows in x.items() for r in rows), key=str)
    rows = merged.rows.select("product_id", *history.SIGNATURE)
    assert sorted(map(tuple, rows.collect()), key=str) == full(want)
    assert {r["product_id"] for r in merged.products.collect()} == set(incoming) | set(tip)
    again = history.three_way_merge(side(base), side(incoming), history.History(merged.products, merged.rows))
    if all(len(set(v)) == len(v) for v in want.values()):
        assert sorted(map(tuple, again.rows.select("product_id", *history.SIGNATURE).collect()), key=str) == full(want)


def test_three_way_merge_of_fields_and_versions(spark):
    tip = document(spark, {"k": ([BASE], {"title": "old", "low": 15.0, "high": 40.0, "seen": 1}), "t": ([], {"title": "t"})})
    incoming = document(spark, {"k": ([BASE], {"title": None, "low": 20.0, "high": 99.0, "seen": 5}), "i": ([], {"title": "i"})})
    got = {r["product_id"]: (r["title"], r["all_time_low"], r["all_time_high"], r["first_seen"]) for r in history.three_way_merge(None, incoming, tip).products.collect()}
    assert got == {"k": (None, 15.0, 99.0, 1), "t": ("t", None, None, None), "i": ("i", None, None, None)}
    with pytest.raises(ValueError, match="schema versions differ"):
        history.three_way_merge(None, document(spark, {"k": ([BASE], {})}, version=2), tip)


def test_zero_prices_are_quarantined(spark):
    rows = series(spark, [(20, 100), (15, 0), (10, 80), (1, 0)], 40)
    obs = rows.withColumn("reference_price", F.lit(None).cast("double"))
    verdicts = {r["seq"]: r["verdict"] for r in deals.reference_price_verdict(obs).collect()}
    assert verdicts == {1: "INSUFFICIENT_HISTORY"}  # later rows have a low or a last price of 0
    drops = {r["seq"]: r["drop_percent"] for r in history.with_prior(rows).collect()}
    assert drops == {0: None, 1: 100.0, 2: None, 3: 100.0, 4: None}
    good, bad = deals.quarantine(history.reference_window(rows))
    assert (good.count(), bad.count()) == (1, 4)
    assert deals.window_statistics(rows).filter("genuine_savings is not null").count() == 1


@pytest.mark.parametrize(("target", "prices", "want"), [
    (None, [5.0], ("not_set", None)), (4.0, [], ("no_matching_history", None)), (4.0, [5.0, 6.0], ("below_observed_historical_low", 5.0)), (5.0, [5.0, 9.0], ("within_observed_range", 5.0)),
])
def test_target_price_feasibility(spark, target, prices, want):
    w = spark.createDataFrame([("w", target)], "watch_id string, target_price double")
    m = spark.createDataFrame([("w", "o")], "watch_id string, offer_id string")
    p = spark.createDataFrame([("o", x) for x in prices], "offer_id string, price double")
    r = watchlist.target_price_feasibility(w, m, p).first()
    assert (r["state"], r["lowest"]) == want


@pytest.mark.parametrize(("query", "supported", "failed", "challenged", "lost", "results", "want"), [
    ("laptop x", False, False, False, False, [("laptop x", "https://a.example.com/p")], ("UNSUPPORTED", 0)),
    (None, True, False, False, False, [], ("MANUAL_REVIEW", 0)),
    ("laptop x", True, True, False, False, [("laptop x", "https://a.example.com/p")], ("UNVERIFIED", 0)),
    ("laptop x", True, False, True, False, [("laptop x", "https://a.example.com/p")], ("UNVERIFIED", 1)),
    ("laptop x", True, False, False, False, [("laptop y", "https://a.example.com/p")], ("MISMATCH", 0)),
    ("laptop x", True, False, False, False, [("laptop y", "https://b.org/"), ("X laptop", "https://a.example.com/p")], ("PASS", 1)),
    ("laptop x", True, False, False, False, [("laptop x 1", "https://a.example.com/p"), ("laptop x 2", "https://a.example.com/")], ("MANUAL_REVIEW", 2)),
    ("laptop x", True, False, False, True, [], ("UNVERIFIED", 0)),
    ("laptop x", True, False, False, False, [], ("NO_RESULTS", 0)),
])
def test_audit(spark, query, supported, failed, challenged, lost, results, want):
    checks = spark.createDataFrame([("w", "s", query, supported, "example.com", failed, challenged, lost)], "watch_id string, store string, query string, is_supported boolean, host string, failed boolean, challenged boolean, extraction_failed boolean")
    rows = spark.createDataFrame([("w", "s", k, t, u) for k, (t, u) in enumerate(results)], "watch_id string, store string, at int, title string, url string")
    r = watchlist.audit_watches(checks, rows).first()
    assert (r["status"], r["n"]) == want


def test_blocked_pages_and_widgets(spark):
    pages = {"<title>Just a moment...</title>": (True, False), " " * 2000 + "just a moment": (False, False), "x _cf_chl_opt": (True, False), "/cdn-cgi/challenge-platform/h/g/orchestrate/x": (True, False),
             "/cdn-cgi/challenge-platform/scripts/jsd/main.js captcha.js": (False, False), '<div class="cf-turnstile">': (False, True), "challenges.cloudflare.com/turnstile/v0/api.js": (False, True)}
    got = watchlist.flag_blocked_pages(spark.createDataFrame([(h,) for h in pages], "html string")).collect()
    assert {r["html"]: (r["is_blocked"], r["has_widget"]) for r in got} == pages


@pytest.mark.parametrize(("layout", "text", "classes", "id_", "want"), [
    ("ids", "ultimul produs în stoc", "", "3", "limited_stock"), ("ids", "în stoc", "", None, "in_stock"), ("ids", "Stoc epuizat", "", "3", "out_of_stock"), ("ids", "pret", "", None, "unknown"), ("ids", "pret", "", "2", "limited_stock"),
    ("classes", "Stoc magazin suficient", "box instock", None, "in_stock"), ("classes", "Stoc magazin limitat", "instock", None, "limited_stock"), ("classes", "In stoc furnizor", "insupplierstock", None, "supplier_stock"), ("classes", "In stoc", "", None, "unknown"),
    ("marks", "Expus", "bin-display", None, "in_stock"), ("marks", "x", "is-sold-out", None, "out_of_stock"), ("labels", "in stoc depozit/furnizor", "instock", None, "supplier_stock"), ("labels", "in stoc limitat", "instock", None, "limited_stock"), ("other", "in stoc", "instock", None, "unknown"),
])
def test_stock_rules(spark, layout, text, classes, id_, want):
    df = spark.createDataFrame([(layout, text, classes, id_)], "l string, t string, c string, i string")
    assert df.select(watchlist.classify_stock(*[F.col(c) for c in "ltci"])).first()[0] == want


def test_secrets_are_redacted(spark):
    shapes = {"bot_token": "bot12345:" + "a" * 35, "provider_token": "hf_" + "Z" * 20, "uuid": str(uuid.UUID(int=77))}
    df = spark.createDataFrame([(f"x {v} y",) for v in shapes.values()], "t string")
    assert {r[0] for r in df.select(T.redact_secrets(F.col("t"))).collect()} == {"x [REDACTED] y"}
    for k, r in zip(shapes, df.select(*[c.alias(n) for n, c in T.secret_hits(F.col("t")).items()]).collect(), strict=True):
        assert r.asDict() == {n: int(n == k) for n in shapes}


def test_answers(spark):
    """Each golden answer's path, score and summary; the verdict is the rule's whatever the answer says."""
    for raw, wrong in response_queries.ANSWERS:
        df = spark.createDataFrame([(raw, "NORMAL_DROP", 3.5)], "raw string, v string, d double")
        r = df.select(responses.validate_response(F.col("raw"), F.lit("p"), F.col("v"), F.col("d"), F.lit("genuine")).alias("r")).first()["r"]
        assert (r["verdict"], r["is_recommended"], r["fallback_path"]) == ("NORMAL_DROP", False, "p" + (wrong or ""))
        assert (r["verdict_score"], r["parsed"]) == ((7, True) if wrong is None else (4, False)), raw
        assert r["summary"].startswith("Fine." if wrong is None else "NORMAL_DROP: 3.50%")


def test_naive_times_are_utc(spark):
    offers = spark.createDataFrame([("o", "s", "u")], "id string, retailer string, url string")
    rows = {"2024-01-01T10:00:00": 36_000, "2024-01-01 10:00:00+02:00": 28_800, "2024-01-01T10:00:00Z": 36_000, "2024-01-01": 0}
    obs = spark.createDataFrame([("o", 5, t) for t in rows] + [("unknown", 5, "2024-01-01")], "offer_id string, price int, scraped_at string")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        got = sorted(r["us"] // 1_000_000 - 1_704_067_200 for r in anomaly.load_observations(obs, offers).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == sorted(rows.values())


def test_offers_of_one_batch_see_each_other(spark):
    s = "offer_id string, retailer string, sku string, title string"
    title = "Laptop Acme ab1234q 16 GB silver intel core i5-13420h"
    new = spark.createDataFrame([("n1", "one", "1", title), ("n2", "two", "2", title + " pro"), ("n3", "three", "3", title), ("n4", "one", "4", "other thing"), ("n5", "one", "1", "renamed")], s)
    got = {r["offer_id"]: (r["product"], r["method"]) for r in identity.resolve_offers(new, new.limit(0)).collect()}
    assert got == {"n1": ("n1", "new"), "n2": ("n1", "title"), "n3": ("n1", "title"), "n4": ("n4", "new"), "n5": ("n1", "fingerprint")}
    known = spark.createDataFrame([("k", "two", "9", title)], s)
    got = {r["offer_id"]: r["product"] for r in identity.resolve_offers(new, known).collect()}
    assert got == {"n1": "k", "n2": "k", "n3": "k", "n4": "n4", "n5": "k"}


def test_vetoes(spark):
    s = "offer_id string, retailer string, title string"
    title = "Laptop Acme ab1234q intel core i5-13420h"
    left = spark.createDataFrame([("a", "s1", title + " 16 GB")], s)
    right = spark.createDataFrame([("b", "s2", title + " 16 GB resigilat"), ("c", "s2", title + " 8 GB"), ("d", "s2", title), ("e", "s2", title + " 16 GB")], s)
    got = {r["b_offer_id"]: r["veto"] for r in identity.scored_pairs(left, right).collect()}
    assert got == {"b": True, "c": True, "d": False, "e": False}


@pytest.mark.parametrize(("title", "want"), [
    ("Ryzen 5 7520U", ["7520u"]), ("AMD Ryzen R5-150", ["150"]), ("Core 3 304", ["304"]), ("Core i5-13420H / 16GB", ["13420h"]), ("i7 1255U", ["1255u"]), ("Intel N150, 8GB", ["150"]), ("Core Ultra 7 155H", ["155h"]),
    ("Ryzen AI 9 365", ["365"]), ("Celeron N4500", []), ("Laptop 15 8GB 512", []), ("i5 999", []), ("Pentium 6500Y x", ["500y"]), ("core 304", ["304"]), ("", []),
])
def test_processor_numbers(spark, title, want):
    assert spark.createDataFrame([(title,)], "t string").select(identity.cpu_codes(F.col("t"))).first()[0] == want


GOOD = '{"verdict": "NORMAL_DROP", "verdict_score": 5, "summary": "s", "is_recommended": false}'


@pytest.mark.parametrize(("raw", "found"), [
    (GOOD, True), ("Sure: " + GOOD + " done", True), ("```json\n" + GOOD + "\n```", True), ("see {x} first\n```\n" + GOOD + "\n``` and {y}", True), ("```json\nnot it\n```\n```" + GOOD + "```", True),
    ("no object", False), ("", False), (None, False), ("[1, 2]", False), ('{"verdict": "x"}', False), ("{broken", False), ("}{", False),
])
def test_answers_hold_one_object(spark, raw, found):
    got = spark.createDataFrame([(raw,)], "r string").select(responses.answer_object(F.col("r")).isNotNull()).first()[0]
    assert got is found


def test_components_of_long_chains_and_hubs(spark):
    from pricelake.functions.components import components

    chain = [(f"c{k:04}", f"c{k + 1:04}") for k in range(300)]
    hub = [("hub", f"leaf{k}") for k in range(500)] + [("leaf3", "leaf3"), ("leaf4", "hub")]
    got = {r["u"]: r["component"] for r in components(spark.createDataFrame(chain + hub, "a string, b string")).collect()}
    assert got == {**{f"c{k:04}": "c0000" for k in range(301)}, "hub": "hub", **{f"leaf{k}": "hub" for k in range(500)}}
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_fan_out_leaves_placeholders_out(spark):
    w = spark.createDataFrame([("w1", "all", True), ("w2", "soon", True), ("w3", "a", False), ("w4", "gone", True)], "watch_id string, site string, enabled boolean")
    stores = spark.createDataFrame([("a", False), ("b", False), ("b", False), ("soon", True)], "store string, is_placeholder boolean")
    assert sorted((r["watch_id"], r["store"]) for r in deals.expand_watches(w, stores).collect()) == [("w1", "a"), ("w1", "b"), ("w2", "soon"), ("w4", "gone")]


@pytest.mark.parametrize(("counts", "want"), [
    ((True, 1, 1, 1, 1, 1, 1), "ok"), ((True, 0, 1, 1, 1, 1, 0), "blocked"), ((True, 0, 0, 1, 1, 0, 0), "no_match"), ((True, 0, 0, 0, 1, 1, 0), "error"), ((True, 0, 0, 0, 0, 0, 0), "error"),
    ((True, 0, 0, 0, 0, 2, 1), "error"), ((True, 0, 0, 0, 0, 2, 0), "no_match"), ((False, 1, 0, 0, 0, 1, 0), "unsupported"),
])
def test_answers_of_shops(spark, counts, want):
    row = spark.createDataFrame([("q", "s", *counts)], "query string, shop string, is_supported boolean, offers int, blocked int, missing int, errors int, answers int, priceless int")
    assert watchlist.shop_answer_status(row).first()["status"] == want


def test_runs_of_a_streamed_table(spark, tmp_path):
    """Each batch as if after a restart, some twice; runs are merged by size, and the newest row of a key counts."""
    at, schema = f"file://{tmp_path}/table", "k long, v long, us long"
    table = lambda: jobs.LogTable(spark, at, schema, ["k"], "v", mark="us")
    assert table().read().count() == 0 and table().newest_mark() is None
    for batch in (0, 1, 1, 2, 3, 4, 4, 5, 2, 6):
        table().update(spark.createDataFrame([(batch, 0, batch * 10), (100, batch, 5), (100, -1, 5)], schema), batch)
    assert table().runs() == [(0, 3), (4, 4), (5, 5), (6, 6)] and table().newest_mark() == 60
    got = {r["k"]: r["v"] for r in table().read().collect()}
    assert got == {**dict.fromkeys(range(7), 0), 100: 6}
    assert not (tmp_path / "table" / "0-0").exists()  # merged, and out of use since the next update
    (tmp_path / "table" / "7-7").mkdir()  # a run that was not finished
    table().update(spark.createDataFrame([(7, 0, 1)], schema), 7)
    assert table().runs() == [(0, 3), (4, 7)] and table().newest_mark() == 60
    late = jobs.LogTable(spark, f"file://{tmp_path}/late", "k long")
    for batch in range(5):
        late.update(spark.createDataFrame([(1,)], "k long"), batch)
    assert late.read().count() == 5


def test_merging_writes_each_row_a_few_times_only():
    runs, written = [], 0
    for batch in range(256):
        runs.append((batch, batch))
        written += 1
        while len(group := jobs.LogTable._mergeable(runs)) > 1:
            written += group[-1][1] - group[0][0] + 1
            runs = [*runs[: -len(group)], (group[0][0], group[-1][1])]
    assert runs == [(0, 255)] and written == 256 * 5


def test_rank_over_partitions(spark):
    from pricelake.functions.ranking import with_rank

    rows = [(k * 7919 % 1009, k) for k in range(1000)]
    got = with_rank(spark.createDataFrame(rows, "a long, b long").repartition(7), "rank", "a", "b").collect()
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["rank"])] == sorted(rows) and {r["rank"] for r in got} == set(range(1, 1001))


def test_report_without_events_says_so(spark):
    empty = spark.createDataFrame([], "store string, run long, parsed long, failures long")
    rows = retro.long_form("scrape", retro.scrape_totals(empty))
    assert tuple(retro.evidence(rows).first()) == ("evidence", "has_event_data", 0.0, "no_data")
    got = {r["metric"]: (r["value"], r["status"]) for r in retro.manifest({"a": empty, "b": None}).collect()}
    assert got == {"a": (0.0, "ok"), "b": (None, "missing")}


def test_bootstrap_against_resampled_rows(spark):
    """The intervals of drawn counts against those of rows drawn one by one; resamples without a flagged row have no precision."""
    rng = np.random.default_rng(3)
    for n, share in ((60, 0.3), (12, 0.08)):
        flags, labels = rng.random(n) < share, (rng.random(n) < 0.6).astype(int)
        flags[0] = True
        table = spark.createDataFrame(list(zip(flags.tolist(), labels.tolist(), strict=True)), "flag boolean, label int")
        got = {r["statistic"]: r for r in anomaly.bootstrap_intervals(table, samples=4000).collect()}
        found = {"precision": [], "recall": [], "label_precision": []}
        for _ in range(4000):
            k = rng.integers(0, n, n)
            f, y = flags[k], labels[k]
            found["precision"] += [y[f].mean()] if f.any() else []
            found["recall"] += [f[y == 1].mean()] if y.any() else []
            found["label_precision"].append(y.mean())
        for name, values in found.items():
            values = np.sort(values)
            assert abs(got[name]["low"] - values[int(0.025 * (len(values) - 1))]) <= 0.06 and abs(got[name]["high"] - values[int(0.975 * (len(values) - 1))]) <= 0.06
        assert len(found["precision"]) < 4000 or n == 60
        assert got["precision"]["value"] == round(float(labels[flags].mean()), 4)
    none = {r["statistic"]: tuple(r)[1:] for r in anomaly.bootstrap_intervals(table.withColumn("flag", F.lit(False))).collect()}
    assert none["precision"] == (None, None, None) and none["recall"] == (0.0, 0.0, 0.0)
    assert {tuple(r)[1:] for r in anomaly.bootstrap_intervals(table.limit(0)).collect()} == {(None, None, None)}


def test_ids_of_decisions(spark):
    key = hashlib.sha256(b"https://x/p:1299.5:s").hexdigest()
    known = str(uuid.uuid5(uuid.NAMESPACE_URL, f"alert-decision:{key}"))
    prices = [1299.5, 1299.0, 0.07, 12345678.9, 99.99, 10000000.0]
    rows = spark.createDataFrame([("https://x/p", p, "s") for p in prices], "u string, p double, s string")
    price = delivery.price_text(F.col("p"))
    key_ = delivery.dedup_key(F.col("u"), price, F.col("s"))
    got = rows.select("p", price.alias("t"), delivery.decision_id(key_).alias("id"), delivery.candidate_decision_ids(F.col("u"), F.col("p"), F.col("s")).alias("ids")).collect()
    assert [r["t"] for r in got] == [str(p) for p in prices] and got[0]["id"] == known
    for r in got:
        spelled = [str(r["p"])] + ([str(int(r["p"]))] if r["p"].is_integer() else [])
        assert r["ids"] == [str(uuid.uuid5(uuid.NAMESPACE_URL, "alert-decision:" + hashlib.sha256(f"https://x/p:{t}:s".encode()).hexdigest())) for t in spelled]
    e = delivery.channel_event_id(F.lit(known), F.col("c"))
    back = spark.createDataFrame([("telegram",), ("email",)], "c string").select(e.alias("e"), delivery.decision_of_event(e).alias("d")).collect()
    assert [tuple(r) for r in back] == [(known, known), (f"{known}:email", known)]
    assert spark.range(1).select(delivery.decision_of_event(F.lit(key))).first()[0] == str(uuid.uuid5(uuid.NAMESPACE_URL, key))
    assert spark.range(1).select(T.offer_uuid(F.lit("s"), F.lit("1")), T.product_uuid(F.lit("t"))).first() == (str(uuid.uuid5(uuid.NAMESPACE_URL, "offer:s:1")), str(uuid.uuid5(uuid.NAMESPACE_URL, "product:t")))


def test_cooldowns_of_sites_and_effective_records(spark):
    hour = 3_600_000_000
    log = spark.createDataFrame([
        ("e1", 1, "SENT", 0, "telegram", "k1"), ("e2", 1, "SENT", 0, "telegram", "k2"), ("e2", 2, "DEAD_LETTER", hour, "telegram", "k2"), ("e3", 1, "PENDING", 0, "email", "k3"), ("e4", 1, "SENT", 0, "email", "k1"),
    ], "event_id string, seq long, status string, us long, channel string, dedup_key string")
    alerts = spark.createDataFrame([
        (1, "k1", "telegram", "short", 3 * hour), (2, "k1", "telegram", "long", 3 * hour), (3, "k1", "telegram", "other", 23 * hour), (4, "k1", "telegram", "other", 24 * hour), (5, "k2", "telegram", "long", 2 * hour),
        (6, "k3", "email", "short", 99 * hour), (7, "k3", "telegram", "long", hour), (8, "k1", "sms", "long", hour),
    ], "seq long, dedup_key string, channel string, site string, us long")
    cooldowns = spark.createDataFrame([("short", 2), ("long", 12)], "site string, cooldown_hours int")
    assert sorted(r["seq"] for r in delivery.cooldown_suppress(alerts, log, cooldowns).collect()) == [1, 4, 5, 7, 8]


def health_rows(spark, rows):
    """(store, run, parsed, ...) with runs an hour apart."""
    full = [(s, r, p, r * 3_600_000_000, a, h, d, w) for s, r, p, a, h, d, w in ((*x, *(10, 0, False, False)[len(x) - 3 :]) for x in rows)]
    return spark.createDataFrame(full, "store string, run long, parsed long, started_us long, attempts long, rate_limit_hits long, challenge_detected boolean, challenge_wait_entered boolean")


def test_alerts_of_a_run(spark):
    before = health_rows(spark, [("fine", 0, 5), ("fine", 1, 5), ("bad", 0, 3), ("bad", 1, 0), ("back", 0, 0), ("back", 1, 0), ("still", 0, 0), ("still", 1, 0), ("unprobed", 0, 0), ("unprobed", 1, 0), ("never", 1, 0)])
    new = health_rows(spark, [("fine", 2, 5), ("bad", 2, 0), ("back", 2, 4), ("still", 2, 0), ("unprobed", 2, 2), ("never", 2, 0)])
    probed = spark.createDataFrame([("back",), ("still",)], "store string")
    got = sorted((r["store"], r["kind"], r["outage"]) for r in health.health_alerts(before, new, probed, F.lit(3 * 3_600_000_000)).collect())
    assert got == [("back", "recovered", "run 2"), ("bad", "quarantined", "run 1"), ("never", "quarantined", "run 1")]
    late = sorted((r["store"], r["outage"]) for r in health.health_alerts(before, new, probed, F.lit(26 * 3_600_000_000)).filter("kind = 'dead_man'").collect())
    assert late == [("bad", "since 0")]  # the others have parsed since, or never have
    dead = health_rows(spark, [("fine", 0, 1), ("x", 0, 1), ("x", 1, 0), ("fine", 1, 1)])
    stays = health.health_alerts(dead, health_rows(spark, [("x", 2, 0), ("fine", 2, 1)]), spark.createDataFrame([("x",)], "store string"), F.lit(90 * 3_600_000_000))
    assert sorted(r["kind"] for r in stays.filter("store = 'x'").collect()) == ["quarantined"]


def test_limits_by_attempts_and_challenges(spark):
    h = health_rows(spark, [("a", 0, 5, 100, 5, False, False), ("b", 0, 5, 100, 6, False, True), ("c", 0, 5, 0, 0, True, True), ("d", 0, 0, 10, 9, True, False)])
    assert sorted(r["store"] for r in health.rate_limited_stores(h, F.lit(60_000_000)).collect()) == ["b", "d"]
    got = {r["store"]: (r["status"], r["challenge"]) for r in health.store_status(h).collect()}
    assert got == {"a": ("OK", "none"), "b": ("OK", "cleared"), "c": ("CHALLENGED", "blocked"), "d": ("NO PRODUCTS", "blocked")}


def test_upsert_is_idempotent(spark):
    obs = series(spark, [(2, 5), (1, 6)])
    again = history.upsert_observations(obs, obs)
    assert sorted(again.collect()) == sorted(obs.collect())


def test_text_functions(spark):
    names = ["a:1", "b:2", "ăîș"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(T.uuid5(F.col("n"))).collect()] == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]
    assert [r[0] for r in df.select(T.hmac_sha256("key", F.col("n"))).collect()] == [hmac.new(b"key", n.encode(), hashlib.sha256).hexdigest() for n in names]
    prices = {"1.234,56 Lei": 1234.56, "99 RON": 99.0, "0": None, "-5 Lei": None, "x": None, None: None, "1798.99": 1798.99}
    got = spark.createDataFrame([(k,) for k in prices], "p string").select(T.machine_price(F.col("p"))).collect()
    assert [r[0] for r in got] == list(prices.values())
    urls = {"HTTPS://WWW.Shop.ro/a/b/?utm_x=1&b=2&a=&fbclid=3#t": "https://shop.ro/a/b?a=&b=2", "http://x.com": "http://x.com/"}
    got = spark.createDataFrame([(k,) for k in urls], "u string").select(T.canonical_url(F.col("u"))).collect()
    assert [r[0] for r in got] == list(urls.values())
    hard = "<<b>javasc<ript:</b> java" + "javascript:" * 9 + "script:data:x" + "y" * 300
    clean = spark.createDataFrame([(hard,)], "t string").select(T.sanitize(F.col("t"))).first()[0]
    assert len(clean) <= 200 and not any(x in clean.lower() for x in ("<", ">", "javascript:", "data:"))


def test_title_parts_and_score(spark):
    df = spark.createDataFrame([("Notebook Intel® Core i5-13420H 15,6 inch 16 GB Negru E1504FAX12",)], "title string")
    r = identity.with_title_parts(df).first()
    assert {"laptop", "intel", "16gb", "15.6inch", "black", "e1504fax12"} <= set(r["tokens"])
    assert (r["codes"], r["colors"], r["capacities"], r["cpus"]) == (["e1504fax12"], ["black"], ["16gb"], ["13420h"])


def test_blocking_loses_no_pair(spark):
    left, right = identity_queries._titles(spark, "/root/testdata/sf0.001")
    left, right = (identity.with_title_parts(x).withColumn("title", F.col("title")) for x in (left, right))
    parts = ("offer_id", "retailer", "tokens", "codes", "colors", "cpus", "capacities")
    score, _ = identity.title_score()
    every = left.select(*[F.col(c).alias(f"a_{c}") for c in parts]).join(right.select(*[F.col(c).alias(f"b_{c}") for c in parts]), F.lit(True)).withColumn("score", score).filter(F.col("score") >= identity.MATCH)
    want = {(r["a_offer_id"], r["b_offer_id"]) for r in every.collect()}
    found = identity.scored_pairs(left.select("offer_id", "retailer", "title"), right.select("offer_id", "retailer", "title")).filter(F.col("score") >= identity.MATCH)
    assert want and {(r["a_offer_id"], r["b_offer_id"]) for r in found.collect()} == want


def test_complete_link_groups(spark):
    rows = spark.createDataFrame([("q", "a", "s1", 1.0), ("q", "b", "s2", 2.0), ("q", "c", "s3", 3.0), ("q", "d", "s1", 4.0)], "query string, offer_id string, shop string, price double")
    pairs = spark.createDataFrame([("q", "a", "b", 0.9, False), ("q", "b", "c", 0.8, False), ("q", "b", "d", 0.9, False)], "query string, a_offer_id string, b_offer_id string, score double, veto boolean")
    got = {r["offer_id"]: r["group_id"] for r in identity.group_equivalent(rows, pairs).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "d"}
    more = spark.createDataFrame([("q", "e", "s4", 5.0)], "query string, offer_id string, shop string, price double")
    links = spark.createDataFrame([("q", "a", "e", 0.8, False), ("q", "b", "e", 0.8, False), ("q", "c", "e", 0.95, False), ("q", "d", "e", 0.99, True)], "query string, a_offer_id string, b_offer_id string, score double, veto boolean")
    got = {r["offer_id"]: (r["group_id"], r["confidence"]) for r in identity.group_equivalent(rows.unionByName(more), pairs.unionByName(links)).collect()}
    assert got == {"a": ("a", "high"), "b": ("a", "high"), "c": ("c", "high"), "d": ("d", None), "e": ("c", "high")}  # the best weakest link counts


def test_features_are_causal(spark):
    rows = series(spark, [(9, 100), (8, 90), (7, 90), (6, 90), (5, 70), (4, 500), (3, 20)])
    full = {r["seq"]: r for r in anomaly.causal_features(rows).collect()}
    for r in anomaly.causal_features(rows.filter("seq <= 4")).collect():
        assert r == full[r["seq"]]
    r = full[4]
    assert (round(r["drop_pct"], 4), r["days_since_last_change"]) == (22.2222, 3.0)
    r = {x["seq"]: x for x in anomaly.causal_features(series(spark, [(3, 100), (2, 100), (1, 80)])).collect()}[2]
    assert (r["drop_pct"], round(r["relative_to_30d_median"], 6), r["days_since_last_change"]) == (20.0, -0.2, 2.0)


def test_split_keeps_equal_times_together(spark):
    rows = spark.createDataFrame([(k, (k // 4) * DAY // 3) for k in range(40)], "seq long, us long")
    parts = anomaly.chronological_split(rows).groupBy("us").agg(F.countDistinct("part").alias("n")).agg(F.max("n")).first()[0]
    assert parts == 1
    with pytest.raises(ValueError, match="empty"):
        anomaly.chronological_split(spark.createDataFrame([(k, 5) for k in range(9)], "seq long, us long"))


def test_forest_and_change_points(spark):
    rng = np.random.default_rng(1)
    rows = [(k, *map(float, rng.normal(0, 1, 5))) for k in range(600)] + [(1000 + k, 30.0, -9.0, 8.0, 3.0, 9.0) for k in range(5)]
    df = spark.createDataFrame(rows, "seq long, " + ", ".join(f"{f} double" for f in anomaly.FEATURES))
    model = anomaly.fit_forest(df, trees=40)
    scored = anomaly.score_rows(df, model).orderBy("score").limit(5).collect()
    assert {r["seq"] for r in scored} == {1000, 1001, 1002, 1003, 1004} and all(-1 <= r["score"] < 0 for r in scored)
    fell = lambda *prices: bool(anomaly.fallen(np.array(prices), np.zeros(len(prices), int), np.ones(len(prices), bool))[-1])
    assert fell(*[100.0] * 10, *[60.0] * 4) and not fell(*[60.0] * 10, *[100.0] * 4) and not fell(5.0, 5.0) and not fell(*[100.0] * 10, *[60.0] * 8)


def test_feedback_rules(spark):
    log = spark.createDataFrame([(1, 1, 1, "useful", "a"), (2, 1, 1, "fake_discount", "b"), (3, 1, 2, "useful", "c"), (4, 2, 1, "purchased", "d"), (5, 2, 2, "duplicate", "e"), (4, 3, 1, "duplicate", "f")], "seq long, alert_id long, rater long, label string, callback_id string")
    assert [tuple(r) for r in feedback.vote_labels(log).collect()] == [(2, 1, 1)]
    seen = feedback.ingest_feedback(log.limit(0), log.unionByName(log), log.filter("alert_id = 1"))
    got = {(r["outcome"], r["n"]) for r in seen.groupBy("outcome").agg(F.count("*").alias("n")).collect()}
    assert got == {("stored", 3), ("duplicate", 6), ("rejected", 3)}


def test_no_data_is_never_zero(spark):
    empty = spark.createDataFrame([], "store string, run long, parsed long, failures long")
    got = {r["metric"]: (r["value"], r["status"]) for r in retro.long_form("x", retro.scrape_totals(empty)).collect()}
    assert got["parsed"] == (None, "no_data") and got["runs"] == (0.0, "ok")


def test_sliding_statistics_against_whole_windows():
    rng = np.random.default_rng(11)
    for width, levels in ((3, 4), (7, 1000), (30, 1)):
        days = np.sort(rng.integers(0, 60, 150)).tolist()
        prices = [None if rng.random() < 0.05 else float(x) for x in np.round(rng.normal(50, 9, levels), 2)[rng.integers(0, levels, 150)]]
        own = [k % 10 > 0 for k in range(150)]
        got = iter(deals.sliding_statistics(days, prices, own, width))
        for k in np.flatnonzero(own):
            x = np.sort([p for d, p in zip(days[:k], prices[:k], strict=True) if p is not None and d >= days[k] - width])
            row = next(got)
            assert row[0] == len(x)
            if not len(x):
                assert set(row[1:]) == {None}
                continue
            cut = int(len(x) * deals.TRIM)
            want = [np.median(x), x.mean(), x.std(ddof=1) if len(x) > 1 else None, *np.quantile(x, [0.25, 0.75]), x[cut : len(x) - cut].mean(), np.median(np.abs(x - np.median(x)))]
            assert all((a is None and b is None) or a == pytest.approx(b, abs=1e-9) for a, b in zip(row[1:], want, strict=True))
            assert levels > 1 or row[3] in (None, 0.0)  # equal prices have no spread at all


def test_window_statistics_keep_all_columns_in_spans(spark):
    rows = [("o", k, k * 43_200_000_000, k // 2, None if k % 11 == 0 else 10.0 + k % 7, 2**60 + k if k % 3 else None, "x") for k in range(200)]
    obs = spark.createDataFrame(rows, "offer_id string, seq long, us long, day int, price double, big long, n2 string")
    got = {r["seq"]: r for r in deals.window_statistics(obs, 5).collect()}
    assert len(got) == 200 and all(got[r[1]]["big"] == r[5] for r in rows)
    assert all(got[k]["n"] == got[k]["window_n"] and got[k]["z_score"] is None or got[k]["stdev"] > 0 for k in range(200))


def tagged(spark, titles, queries):
    w = spark.createDataFrame([(q, "all", q) for q in queries], "watch_id string, site string, query string")
    o = spark.createDataFrame([(t, "s", t) for t in titles], "offer_id string, retailer string, title string")
    return {(r["offer_id"], r["watch_id"]): r["how"] for r in watchlist.match_titles_loosely(w, o).collect()}


LOOSE = [
    ("Căști Sony", "casti sony"), ("SSD Kingston 1 TB", "ssd 1tb"), ("SSD Kingston 1TB NVMe", "ssd 1 tb"), ("Laptop 15,6 inch", "laptop 15.6"), ("Router Wi-Fi 6", "router wifi"),
    ("Router WiFi 6", "router wi-fi"), ("iPhone 15, 128 GB", "iphone 15"), ("Core i5-13420H", "i5 13420h"), ("ﬁne Größe", "fine grösse"), ("Laptop-16-GB", "laptop 16gb"),
]
STRICT = [("LAPTOP Lenovo V15 G4 AMN", "lenovo laptop v15"), ("Acer Nitro V15", "nitro v15"), ("Xiaomi 15T", "xiaomi 15t"), ("Apple iPhone 15 128GB", "iphone 128gb"), ("Laptop 16 GB", "laptop 16"), ("SSD +", "ssd +")]
NEVER = [("Lenovo V15 G4", "lenovo v15 g5"), ("SSD Kingston 1 TB", "ssd 2tb"), ("Router Wi-Fi 6", "router bluetooth"), ("Laptop Lenovo", "laptop lenovo v15"), ("SSD plus", "ssd +")]


def test_loose_matching_by_forms_of_words(spark):
    pairs = LOOSE + STRICT + NEVER
    got = tagged(spark, {t for t, _ in pairs}, {q for _, q in pairs})
    assert [got.get(p) for p in pairs] == ["normalized"] * len(LOOSE) + ["strict"] * len(STRICT) + [None] * len(NEVER)


def test_loose_matches_contain_strict_ones_of_all_pairs(spark):
    """All pairs of random titles and queries against a plain matcher."""
    rng = np.random.default_rng(6)
    words = ["laptop", "16", "gb", "16gb", "wi-fi", "wifi", "1,5", "1.5", "tb", "1tb", "1", "é-x", "ex", "+", "a.b", "x-", "-", "V15"]
    texts = sorted({" ".join(rng.choice(words, rng.integers(1, 5))) for _ in range(150)})
    titles, queries = texts[::2], texts[1::2]

    def united(line):
        out = []
        for w in line:
            if w in watchlist.UNITS and out and re.fullmatch(r"\d+(\.\d+)?", out[-1]):
                out[-1] += w
            else:
                out.append(w)
        return out

    fold = lambda t: re.sub(r"(?<=\d),(?=\d)", ".", T.plain_letters(t))
    cut = lambda t: re.findall(r"[^\W_]+(?:\.[^\W_]+)*", t)

    def how(title, query):
        if set(query.lower().split()) <= set(title.lower().split()):
            return "strict"
        forms = {*cut(fold(title)), *united(cut(fold(title))), *(w.replace("-", "") for w in re.findall(r"[^\W_]+(?:-[^\W_]+)+", fold(title)))}
        held = [cut(w) and (set(cut(w)) <= forms or ("-" in w and "".join(cut(w)) in forms)) for w in united(fold(query).split())]
        return "normalized" if held and all(held) else None

    want = {(t, q): how(t, q) for t in titles for q in queries if how(t, q)}
    assert tagged(spark, titles, queries) == want and len(set(want.values())) == 2


def test_documents_of_older_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"schema_version": 1, "products": {"u1": {"title": "t", "history": [{"date": "2024-01-01", "price": 5}]}, "u2": {"title": "x"}}}')
    (tmp_path / "b.json").write_text('{"u3": {"history": [{"date": "2024-01-01", "observed_at": "2024-01-01T10:00:00Z", "price": 7.5, "stock_status": "in_stock"}, {"date": null, "price": 1}]}}')
    (tmp_path / "c.json").write_text("no json")
    products, rows, rejected = documents.read_price_history(spark, str(tmp_path))
    assert [r["url"] for r in products.collect()] == ["u1"] and rows.count() == 1
    assert sorted((r["url"] or "", r["reason"]) for r in rejected.collect()) == [("", "not_a_document"), ("u2", "no_history"), ("u3", "bad_observation")]


@pytest.mark.parametrize("block", ["64", "1000", "128m"])
def test_large_documents_read_as_small_ones(spark, tmp_path, block):
    """Blocks may start within strings, entries and escapes; both readers give the same."""
    rng = random.Random(5)
    odd = ["plain", 'say "hi"', "{", "}", "a } b { c", '"}', "\\\\", '\\"', '{"products": {', "é} 文字 {", "\n}\t{", "}}}}", "", "[{"]

    def entry(k):
        history = [{"date": f"2024-01-{d + 1:02d}", "observed_at": None, "price": rng.choice([5, 7.25, None]) if k % 9 == 0 else 5.5, "stock_status": rng.choice(["in_stock", rng.choice(odd)])} for d in range(rng.randrange(5))]
        return {"title": rng.choice(odd) * rng.randrange(1, 4), "site": "s", **({} if k % 7 == 0 else {"history": history})}

    for k in range(8):
        products = {f"https://x/{k}/{j}/{rng.choice(odd)}": entry(j) for j in range(rng.randrange(30) if k else 0)}
        document = [products, {"schema_version": 1, "products": products}, {"meta": {"a": {"b": {"c": 1}}}, "products": products, "after": {"z": {"y": 2}}}][k % 3 if k else 1]
        (tmp_path / f"{k}.json").write_text(json.dumps(document, indent=k % 3 or None, ensure_ascii=k % 2 == 0) + "\n" * (k % 2))
    for name, text in {"text": "no json", "list": '[{"u": {"title": "t"}}]', "cut": json.dumps({"u": {"title": "t", "history": []}})[:-1], "number": '{"schema_version": 1, "products": 5}', "bare": "{}"}.items():
        (tmp_path / f"{name}.json").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    want = documents.read_price_history(spark, str(tmp_path))
    try:
        want = [sorted(map(str, df.collect())) for df in want]
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        got = [sorted(map(str, df.collect())) for df in documents.read_large_history(spark, str(tmp_path))]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(want[0]) > 50 and len(want[2]) > 10
    for g, w in zip(got, want, strict=True):
        assert g == w


def test_prompts_are_cut_after_markup_is_gone(spark):
    titles = ["<" * 290 + "word " * 100, "java" * 30 + "javascript:" + "script:" * 30 + "end", "plain"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in titles], "t string").select(T.sanitize(F.col("t"))).collect()]
    assert len(got[0]) >= 199 and got[1] == "end" and got[2] == "plain"
    prompt = spark.range(1).select(responses.build_prompt(F.lit("a <b>"), F.lit("s"), F.lit(None).cast("string"), F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(None).cast("double"), F.lit(None).cast("int"), F.lit("NORMAL_DROP"), F.lit("unknown"))).first()[0]
    assert "Offer: a b at s, seller not verified" in prompt and responses.BASIS["unknown"] + ": 3.00" in prompt and "last 30 days" not in prompt


def whole_series_fell(prices):
    """The flag of one series by exact partitioning of the series divided by its median."""
    n, x = len(prices), np.array(prices) / np.median(prices)
    if n < 2 * anomaly.MIN_SIZE or np.isnan(prices).any():
        return False
    best, cuts = {0: -anomaly.PENALTY}, {0: []}
    for end in range(anomaly.MIN_SIZE, n + 1):
        cost = {a: best[a] + ((x[a:end] - x[a:end].mean()) ** 2).sum() + anomaly.PENALTY for a in best if end - a >= anomaly.MIN_SIZE}
        a = min(cost, key=cost.get)
        best[end], cuts[end] = cost[a], [*cuts[a], a]
    _, *found = cuts[n]
    return bool(found and n - found[-1] <= anomaly.ACTIVE and x[found[-1] :].mean() < x[cuts[n][-2] : found[-1]].mean())


@pytest.mark.parametrize("together", [128, 5])
def test_change_points_against_exact_partitioning(monkeypatch, together):
    monkeypatch.setattr(anomaly, "TOGETHER", together)
    rng = np.random.default_rng(8)
    steps = np.concatenate([rng.normal(100, 4, 50), rng.normal(55, 4, 25), rng.normal(100, 2, 25), rng.normal(80, 1, 20)])
    wild = rng.uniform(1, 200, 90)
    level = np.repeat([50.0, 40.0, 60.0, 30.0], 25)
    gap = np.where(np.arange(90) == 30, np.nan, steps[:90])
    for prices in (steps, wild, level, gap):
        for scale, keep in ((1, 1000), (40, 20)):
            days, own = np.arange(len(prices)) // 2, rng.random(len(prices)) < 0.8
            got = anomaly.fallen(prices * scale, days, own, keep)
            want = [bool(own[k]) and whole_series_fell((prices * scale)[np.searchsorted(days, days[k] - keep) : k + 1]) for k in range(len(prices))]
            assert got.tolist() == want
            assert any(want) or prices is gap


def test_change_points_of_level_series_are_found_in_linear_time(monkeypatch):
    widths, real = [], np.isinf
    monkeypatch.setattr(anomaly.np, "isinf", lambda cost: (widths.append(cost.shape[1]), real(cost))[1])
    prices = np.concatenate([np.full(400, 5.0), np.full(400, 4.0)])
    flags = anomaly.fallen(prices, np.zeros(800, int), np.arange(800) == 799)
    assert not flags.any() and np.mean(widths) < 12


def test_change_points_in_spans_are_those_of_the_kept_series(spark):
    rng = np.random.default_rng(9)
    prices = np.round(np.concatenate([rng.normal(100, 3, 80), rng.normal(60, 3, 60), rng.normal(90, 3, 60)]), 3)
    rows = [("o", k // 2, k * 10, k, float(p)) for k, p in enumerate(prices)]
    got = {r["seq"]: r["pelt_flag"] for r in anomaly.pelt_drop_flag(spark.createDataFrame(rows, "offer_id string, day int, us long, seq long, price double"), keep_days=15).collect()}
    assert got == {k: whole_series_fell([p for _, d, _, j, p in rows if k // 2 - 15 <= d and j <= k]) for k in range(200)} and any(got.values())
