"""Store health from fetch records and per-run health rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def store_run_health(fetches: DataFrame) -> DataFrame:
    """One row per store and run: records by kind, mean latency, first record; whether a challenge was waited for, and whether one
    stood in the way to the end."""
    return fetches.groupBy("store", "run").agg(
        F.count("*").alias("requested"), F.count_if(F.col("kind") == "view").alias("parsed"), F.count_if(F.col("kind") == "purchase").alias("matched"), F.count_if(F.col("kind") == "error").alias("failures"),
        F.count_if(F.col("kind") == "click").alias("rate_limit_hits"), F.bool_or("is_challenge").alias("challenge_detected"), F.bool_or("is_wait").alias("challenge_wait_entered"), F.avg("latency").alias("latency"), F.min("us").alias("started_us"),
        F.count_if("is_skipped").alias("skipped"), F.count_if("is_blocked").alias("blocked"), F.sum("tries").alias("attempts"),
    )


def _by_run() -> Window:
    return Window.partitionBy("store").orderBy("run")


def last_known_good(health: DataFrame) -> DataFrame:
    """Adds the start of the newest run so far that parsed anything."""
    good = F.when(F.col("parsed") > 0, F.col("started_us"))
    return health.withColumn("last_good_us", F.last(good, ignorenulls=True).over(_by_run()))


def _newest(health: DataFrame, n: int) -> DataFrame:
    back = F.row_number().over(Window.partitionBy("store").orderBy(F.desc("run")))
    return health.withColumn("back", back).filter(F.col("back") <= n)


def quarantined_stores(health: DataFrame) -> DataFrame:
    """Stores whose last two runs parsed nothing while another store succeeded in one of them."""
    last = _newest(health, 2)
    bad = last.groupBy("store").agg(F.count("*").alias("n"), F.max("parsed").alias("most"), F.collect_set("run").alias("runs")).filter("n = 2 and most = 0")
    worked = health.filter("parsed > 0").select("run").distinct()
    return bad.select("store", F.explode("runs").alias("run")).join(worked, "run", "left_semi").select("store").distinct()


def outage_start(health: DataFrame) -> DataFrame:
    """For stores that parse nothing now: the first run of that streak."""
    good = health.groupBy("store").agg(F.max(F.when(F.col("parsed") > 0, F.col("run"))).alias("last_good"))
    after = health.join(good, "store").filter(F.col("last_good").isNull() | (F.col("run") > F.col("last_good")))
    return after.groupBy("store").agg(F.min("run").alias("outage_run"), F.min("started_us").alias("outage_us"))


def probe_due(health: DataFrame, now_us: Column, hours: int = 6) -> DataFrame:
    last = health.groupBy("store").agg(F.max("started_us").alias("last_us")).filter(now_us - F.col("last_us") >= hours * 3_600_000_000)
    return quarantined_stores(health).join(last, "store")


def rate_limited_stores(health: DataFrame, now_us: Column, share: float = 0.05, minutes: int = 30) -> DataFrame:
    """Stores whose newest run met limits in more than this share of its attempts, until so long after its start."""
    last = health.groupBy("store").agg(F.max_by(F.struct("attempts", "rate_limit_hits", "started_us"), "run").alias("l")).select("store", "l.*")
    return last.filter((F.col("attempts") > 0) & (F.col("rate_limit_hits") / F.col("attempts") > share) & (now_us - F.col("started_us") < minutes * 60_000_000))


def health_alerts(before: DataFrame, new: DataFrame, probed: DataFrame, now_us: Column, dead_hours: int = 24) -> DataFrame:
    """What a run tells: newly quarantined stores, with the first run of their outage; probed stores that parse again, with this run; and
    stores of this run without a success for a day, with the last one. A probe that stays in quarantine is not told again, nor is a
    store that never had a success. before and new: health rows up to the run and of it; probed: store."""
    after = before.unionByName(new)
    was, is_ = quarantined_stores(before), quarantined_stores(after)
    told = lambda text, value: F.concat(F.lit(text), value.cast("string")).alias("outage")
    began = outage_start(after).select("store", told("run ", F.col("outage_run")))
    bad = is_.join(was, "store", "left_anti").select("store", F.lit("quarantined").alias("kind")).join(began, "store")
    back = new.filter("parsed > 0").join(probed.select("store"), "store", "left_semi").join(is_, "store", "left_anti").select("store", F.lit("recovered").alias("kind"), told("run ", F.col("run")))
    still = probed.select("store").join(is_, "store", "left_semi")
    good = after.groupBy("store").agg(F.max(F.when(F.col("parsed") > 0, F.col("started_us"))).alias("good")).filter(now_us - F.col("good") > dead_hours * 3_600_000_000)
    dead = new.select("store").join(good, "store").join(still, "store", "left_anti").select("store", F.lit("dead_man").alias("kind"), told("since ", F.col("good")))
    return bad.unionByName(back).unionByName(dead)


def health_summary(health: DataFrame) -> DataFrame:
    """Totals of each store in each run, of each run, and of all."""
    out = health.rollup("run", "store").agg(F.sum("requested").alias("requested"), F.sum("parsed").alias("parsed"), F.sum("failures").alias("failures"), F.grouping_id().alias("level"))
    return out.select("run", "store", "requested", "parsed", "failures", F.col("level").cast("int").alias("level"))


def store_status(health: DataFrame) -> DataFrame:
    last = health.groupBy("store").agg(F.max_by(F.struct("run", "parsed", "challenge_detected", "challenge_wait_entered"), "run").alias("l")).select("store", "l.*")
    bad = quarantined_stores(health).withColumn("bad", F.lit(True))
    status = F.when(F.col("bad"), "QUARANTINED").when(F.col("parsed") == 0, "NO PRODUCTS").when(F.col("challenge_detected"), "CHALLENGED").otherwise("OK")
    challenge = F.when(F.col("challenge_detected"), "blocked").when(F.col("challenge_wait_entered"), "cleared").otherwise("none")
    return last.join(bad, "store", "left").select("store", "run", status.alias("status"), challenge.alias("challenge"))
