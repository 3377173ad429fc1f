"""Retrospective metrics over logs in a window of time [start, end)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import feedback
from .delivery import effective_outbox


def within(df: DataFrame, us: str, start: int, end: int) -> DataFrame:
    return df.filter((F.col(us) >= start) & (F.col(us) < end))


def scrape_totals(health: DataFrame) -> DataFrame:
    return health.agg(F.countDistinct("run").alias("runs"), F.count("*").alias("store_runs"), F.sum("parsed").alias("parsed"), F.sum("failures").alias("failures"))


def slot_coverage(starts: DataFrame, start: int, end: int, slot_us: int) -> DataFrame:
    """Scheduled slots with at least one run, missed slots and the longest gap. starts has ``us``, one row per run."""
    slots = starts.sparkSession.range(start // slot_us, end // slot_us).select(F.col("id").alias("slot"))
    hit = within(starts, "us", start, end).select(F.floor(F.col("us") / slot_us).alias("slot")).distinct()
    missed = slots.join(hit, "slot", "left_anti")
    # A gap's slots have one difference of slot and rank. Ranks run over the missed slots of a day, gaps join at midnight.
    day = F.floor(F.col("slot") * slot_us / 86_400_000_000)
    ranked = missed.withColumn("day", day).withColumn("gap", F.col("slot") - F.row_number().over(Window.partitionBy("day").orderBy("slot")))
    parts = ranked.groupBy("day", "gap").agg(F.min("slot").alias("a"), F.max("slot").alias("b"))
    order = Window.orderBy("a")  # over gaps, not rows
    parts = parts.withColumn("new", (F.col("a") != F.coalesce(F.lag("b").over(order), F.lit(-2)) + 1).cast("int")).withColumn("g", F.sum("new").over(order))
    longest = parts.groupBy("g").agg((F.max("b") - F.min("a") + 1).alias("n")).agg(F.max("n").alias("longest_gap"), F.sum("n").alias("missed"))
    total = end // slot_us - start // slot_us
    hits = F.lit(total) - F.coalesce("missed", F.lit(0))
    return longest.select(F.lit(total).cast("long").alias("slots"), hits.alias("covered"), F.coalesce("missed", F.lit(0)).alias("missed"), F.coalesce("longest_gap", F.lit(0)).alias("longest_gap"), F.when(F.lit(total) > 0, F.round(hits / total * 100, 2)).alias("uptime_percent"))


def failure_reasons(fetches: DataFrame) -> DataFrame:
    """store and reasons: counts by reason, the most frequent first, as ``reason=n`` joined by commas."""
    counts = fetches.filter("reason is not null").groupBy("store", "reason").agg(F.count("*").alias("n"))
    by = counts.groupBy("store").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "reason"))).alias("r"))
    return by.select("store", F.array_join(F.transform("r", lambda x: F.concat(x["reason"], F.lit("="), (-x["less"]).cast("string"))), ",").alias("reasons"))


def retailer_ranking(health: DataFrame) -> DataFrame:
    """Stores by extraction success rate (desc), challenge rate (asc), name; stores without a try have no rate and no rank."""
    tried = F.sum("parsed") + F.sum("failures")
    by = health.groupBy("store").agg(
        F.count("*").alias("runs"), F.count_if(F.col("parsed") == 0).alias("zero_runs"), F.when(tried > 0, F.round(F.sum("parsed") / tried, 6)).alias("success_rate"),
        F.round(F.avg(F.col("challenge_detected").cast("int")), 6).alias("challenge_rate"), F.round(F.avg(F.col("challenge_wait_entered").cast("int")), 6).alias("challenge_wait_rate"), F.round(F.percentile("latency", 0.5), 6).alias("median_latency"),
    )
    at = F.row_number().over(Window.partitionBy(F.col("success_rate").isNull()).orderBy(F.desc("success_rate"), "challenge_rate", "store"))
    return by.withColumn("rank", F.when(F.col("success_rate").isNotNull(), at))


def outbox_metrics(log: DataFrame, statuses: tuple[str, ...] = ("SENT", "PENDING", "DEAD_LETTER")) -> DataFrame:
    counts = effective_outbox(log).groupBy("source").pivot("status", list(statuses)).count()
    return counts.na.fill(0).select("source", *[F.col(s).alias(s.lower()) for s in statuses])


def delivery_metrics(attempts: DataFrame) -> DataFrame:
    """Attempts and decisions by final state, by channel, and in all."""
    by = attempts.groupingSets([[F.col("status")], [F.col("channel")], []], F.col("status"), F.col("channel"))
    return by.agg(F.count("*").alias("attempts"), F.countDistinct("event_id").alias("decisions"))


def feedback_acceptance(log: DataFrame) -> DataFrame:
    cur = feedback.current_labels(log)
    good, judged = F.col("label").isin(*feedback.GOOD), F.col("label").isin(*feedback.GOOD, *feedback.BAD)
    rate = F.when(F.count_if(judged) > 0, F.round(F.count_if(good) / F.count_if(judged) * 100, 4))
    return cur.agg(F.count("*").alias("labels"), F.countDistinct("alert_id").alias("alerts"), F.countDistinct("rater").alias("raters"), F.count_if(judged).alias("judged"), rate.alias("acceptance_percent"))


def savings_estimate(rows: DataFrame, purchased: DataFrame) -> DataFrame:
    """rows with seq, price, median (of the prior window); purchased with seq. Savings are never below 0."""
    found = purchased.select("seq").distinct().join(rows.select("seq", "price", "median"), "seq", "left")
    saved = F.when(F.col("median").isNotNull(), F.greatest(F.col("median") - F.col("price"), F.lit(0.0)))
    found = found.withColumn("saved", saved)
    return found.agg(
        F.count("*").alias("purchased"), F.count_if(F.col("price").isNull()).alias("unmatched"), F.count_if(F.col("price").isNotNull() & F.col("median").isNull()).alias("no_reference"),
        F.round(F.sum("saved"), 4).alias("total"), F.round(F.percentile("saved", 0.5), 4).alias("median_saved"),
    )


def workflow_success(runs: DataFrame) -> DataFrame:
    """Completed runs by event: totals and share of successes. runs: event, status, conclusion."""
    done = runs.filter("status = 'completed'")
    good = F.count_if(F.col("conclusion") == "success")
    return done.groupBy("event").agg(F.count("*").alias("completed"), good.alias("succeeded"), F.round(good / F.count("*") * 100, 4).alias("success_percent"))


def long_form(section: str, df: DataFrame) -> DataFrame:
    """A one-row table as (section, metric, value, status); a null is no_data, never 0."""
    parts = ", ".join(f"'{c}', cast(`{c}` as double)" for c in df.columns)
    rows = df.selectExpr(f"stack({len(df.columns)}, {parts}) as (metric, value)")
    return rows.select(F.lit(section).alias("section"), "metric", "value", F.when(F.col("value").isNull(), "no_data").otherwise("ok").alias("status"))


def manifest(inputs: dict[str, DataFrame | None]) -> DataFrame:
    """Rows of each input in long form; an input that was not given is missing, not empty."""
    out = None
    for name, df in inputs.items():
        spark = next(x for x in inputs.values() if x is not None).sparkSession
        rows = spark.range(1).select(F.lit(None).cast("double").alias("value")) if df is None else df.agg(F.count("*").cast("double").alias("value"))
        rows = rows.select(F.lit("inputs").alias("section"), F.lit(name).alias("metric"), "value", F.lit("missing" if df is None else "ok").alias("status"))
        out = rows if out is None else out.unionByName(rows)
    return out


def evidence(report: DataFrame, metrics: tuple[str, ...] = ("store_runs", "labels", "attempts")) -> DataFrame:
    """Whether any section of a long-form report rests on events at all."""
    some = F.max(F.when(F.col("metric").isin(*metrics) & (F.col("section") != "none") & (F.col("value") > 0), 1.0).otherwise(0.0))
    value = F.coalesce(some, F.lit(0.0))
    return report.agg(value.alias("value")).select(F.lit("evidence").alias("section"), F.lit("has_event_data").alias("metric"), "value", F.when(F.col("value") > 0, "ok").otherwise("no_data").alias("status"))
