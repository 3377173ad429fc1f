"""Deal decisions and statistics over reference windows."""

from __future__ import annotations

import math
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import history

#: Fixed values of the rules.
LEAST_DROP, LEAST_DROP_PERCENT = 5.0, 2.0
LEAST_HISTORY_DAYS, INFLATED, GENUINE_PERCENT = 14, 1.25, 5.0
TRIM = 0.05
POLICIES = ("aggressive", "conservative", "off")
#: Windows of days that a task holds of an offer at a time, besides the one before them.
SPAN = 8
#: Rows of offers in a task that sorts them several times.
TASK_ROWS = 100_000


def expand_watches(watches: DataFrame, stores: DataFrame) -> DataFrame:
    """Enabled watches, those of site ``all`` once for each store that is no placeholder; others keep their site, whatever it is.

    stores: store, is_placeholder; a small dimension, of which one row with all names goes to each watch.
    """
    on = watches.filter("enabled")
    one = on.filter("site <> 'all'").withColumn("store", F.col("site"))
    names = stores.filter(~F.col("is_placeholder")).agg(F.array_sort(F.collect_set("store")).alias("stores"))
    every = on.filter("site = 'all'").join(F.broadcast(names)).withColumn("store", F.explode("stores")).drop("stores")
    return one.unionByName(every)


def alert_gate(prev: Column, new: Column, stock: Column, low: Column, policy: Column, target: Column, min_drop: Column) -> Column:
    """Whether a price change alerts. An unknown policy is an error where it would be asked."""
    drop = prev - new
    percent = F.try_divide(drop, prev) * 100
    floor = (drop >= LEAST_DROP) & (percent >= LEAST_DROP_PERCENT)
    record = F.coalesce(new < low, F.lit(False))
    return (
        F.when(prev.isNull() | (new >= prev) | (stock == "out_of_stock"), False)
        .when(~policy.isin(*POLICIES), F.raise_error(F.concat(F.lit("unknown all-time-low policy "), policy)).cast("boolean"))
        .when(record & (policy == "aggressive"), True)
        .when(record & (policy == "conservative") & floor, True)
        .when(~floor, False)
        .when(new > target, False)
        .when(percent < min_drop, False)
        .otherwise(True)
    )


def seller_allowed(policy: Column, is_marketplace: Column) -> Column:
    """``trusted`` passes only rows known not to be of a marketplace."""
    return (policy != "trusted") | is_marketplace.eqNullSafe(F.lit(False))


def verdict(new: Column, low: Column, reference: Column, history_days: Column) -> Column:
    percent = F.round(F.try_divide(low - new, low) * 100, 2)
    return (
        F.when(history_days < LEAST_HISTORY_DAYS, "INSUFFICIENT_HISTORY")
        .when(new >= low, "FALSE_DISCOUNT")
        .when(reference > low * INFLATED, "INFLATED_REFERENCE")
        .when(percent >= GENUINE_PERCENT, "GENUINE_DEAL")
        .otherwise("NORMAL_DROP")
    )


def reference_price_verdict(obs: DataFrame, days: int = history.REFERENCE_DAYS) -> DataFrame:
    """Verdicts of the rows with an earlier price; rows without a usable baseline are left to ``quarantine``."""
    rows, _ = quarantine(history.reference_window(obs, days).filter("previous_price is not null"))
    return (
        rows.withColumn("discount_vs_old_pct", F.round((F.col("previous_price") - F.col("price")) / F.col("previous_price") * 100, 2))
        .withColumn("discount_vs_30d_pct", F.round((F.col("thirty_day_low") - F.col("price")) / F.col("thirty_day_low") * 100, 2))
        .withColumn("verdict", verdict(F.col("price"), F.col("thirty_day_low"), F.col("reference_price"), F.col("history_days")))
    )


def quarantine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a usable baseline, the others)."""
    good = (F.col("previous_price") > 0) & (F.col("thirty_day_low") > 0)
    good = F.coalesce(good & ~F.isnan("previous_price"), F.lit(False))
    return rows.filter(good), rows.filter(~good)


def window_statistics(obs: DataFrame, days: int = history.REFERENCE_DAYS) -> DataFrame:
    """Statistics of each row's window of earlier prices: n, median, p25, p75 (inclusive quantiles, interpolated), mean, stdev,
    trimmed_mean, mad, z_score, and genuine_savings against the window's low.

    An offer's rows are cut into spans of SPAN windows; a span also gets the rows of the ``days`` before it. So a task holds few
    windows of an offer at a time, and a row is sent twice at most, most once. Within a span one structure slides over the rows.
    The number of tasks follows the number of rows, so that what a task sorts does not grow with the table.
    """
    rows = history.reference_window(in_tasks(obs), days)
    names = rows.columns

    def slide(span_rows: pa.Table) -> pa.Table:
        span_rows = span_rows.sort_by([(c, "ascending") for c in ("day", "us", "seq")])
        own = span_rows["_own"]
        found = sliding_statistics(span_rows["day"].to_pylist(), span_rows["price"].to_pylist(), own.to_pylist(), days)
        out = span_rows.filter(own).select(names)
        for k, name in enumerate(STATISTICS):
            out = out.append_column(name, pa.array([x[k] for x in found], pa.int32() if name == "n" else pa.float64()))
        return out

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    made = ", ".join(f"{x} {'int' if x == 'n' else 'double'}" for x in STATISTICS)
    out = spans(rows, days).groupBy("offer_id", "_span").applyInArrow(slide, f"{kind}, {made}")
    return out.withColumn("z_score", F.when(F.col("stdev") > 0, (F.col("price") - F.col("mean")) / F.col("stdev"))).withColumn("genuine_savings", savings())


def in_tasks(obs: DataFrame) -> DataFrame:
    """The rows by offer, about TASK_ROWS in a task and at least one task for each core."""
    tasks = max(obs.sparkSession.sparkContext.defaultParallelism, -(-obs.count() // TASK_ROWS))
    return obs.repartition(tasks, "offer_id")


def spans(rows: DataFrame, days: int) -> DataFrame:
    """The rows in their own span (``_span``, ``_own``), and those of the last ``days`` days of a span once more in the next one, for
    which they come before."""
    width = SPAN * days
    span = F.floor(F.col("day") / width)
    late = F.pmod(F.col("day"), F.lit(width)) >= width - days
    at = lambda number, own: F.struct(number.alias("_span"), F.lit(own).alias("_own"))
    return rows.select("*", F.inline(F.when(late, F.array(at(span, True), at(span + 1, False))).otherwise(F.array(at(span, True)))))


def savings() -> Column:
    """How far a price is below its window's low, in percent."""
    return F.when(F.col("window_low") > 0, (1 - F.col("price") / F.col("window_low")) * 100)


def window_median(obs: DataFrame, days: int = history.REFERENCE_DAYS) -> DataFrame:
    """What most readers of window_statistics need, without Python: the window's median and genuine_savings."""
    return history.reference_window(obs, days, with_median=True).withColumn("genuine_savings", savings())


#: Columns that sliding_statistics returns for each row, all but n null for an empty window.
STATISTICS = ("n", "median", "mean", "stdev", "p25", "p75", "trimmed_mean", "mad")


class Ranks:
    """The prices of a window as counts by rank among the span's distinct prices, in Fenwick trees of counts and of sums: adding,
    taking away, the k-th price and the sum of the k lowest take logarithmic time. Sums are whole numbers, so they are exact."""

    def __init__(self, values: list[int]):
        self.values = values
        self.top = 1 << max(0, len(values).bit_length() - 1)
        self.counts, self.sums, self.n, self.total, self.squares = [0] * (len(values) + 1), [0] * (len(values) + 1), 0, 0, 0

    def add(self, rank: int, times: int) -> None:
        x = self.values[rank]
        self.n, self.total, self.squares = self.n + times, self.total + times * x, self.squares + times * x * x
        at = rank + 1
        while at < len(self.counts):
            self.counts[at] += times
            self.sums[at] += times * x
            at += at & -at

    def lowest(self, k: int) -> tuple[int, int]:
        """(the k-th lowest price from 0 on, the sum of the k lowest)."""
        at, left, total, step = 0, k, 0, self.top
        while step:
            to = at + step
            if to < len(self.counts) and self.counts[to] <= left:
                at, left, total = to, left - self.counts[to], total + self.sums[to]
            step >>= 1
        return (self.values[at], total + left * self.values[at]) if at < len(self.values) else (0, total)

    def below(self, rank: int) -> int:
        """How many prices have a lower rank."""
        n = 0
        while rank > 0:
            n += self.counts[rank]
            rank -= rank & -rank
        return n

    def kth_distance(self, centre2: int, k: int) -> int:
        """The k-th lowest of |2 * price - centre2|, by halving the number of those at or above the centre among the nearest k + 1."""
        split = self.below(bisect_left(self.values, (centre2 + 1) // 2))
        low, high = max(0, k + 1 - split), min(k + 1, self.n - split)
        while low < high:  # the least number from above with which those above are no farther than the next one below
            above = (low + high) // 2
            under = k + 1 - above
            nearest_above = 2 * self.lowest(split + above)[0] - centre2
            farthest_under = centre2 - 2 * self.lowest(split - under)[0]
            if nearest_above < farthest_under:
                low = above + 1
            else:
                high = above
        under = k + 1 - low
        ends = [2 * self.lowest(split + low - 1)[0] - centre2] if low else []
        ends += [centre2 - 2 * self.lowest(split - under)[0]] if under else []
        return max(ends)


def sliding_statistics(days: list[int], prices: list[float], own: list[bool], width: int) -> list[tuple]:
    """STATISTICS of the rows marked own, over the earlier rows (in the order given) of at most ``width`` days before. Rows without
    a price are in no window."""
    known = [None if p is None or p != p else p.as_integer_ratio() for p in prices]
    scale = max((x[1] for x in known if x), default=1)  # a power of two that makes all prices whole
    whole = [None if x is None else x[0] * (scale // x[1]) for x in known]
    values = sorted({x for x in whole if x is not None})
    rank = {x: k for k, x in enumerate(values)}
    held, first, out = Ranks(values), 0, []

    def quantile(q: float) -> float:
        pos = (held.n - 1) * q
        at = int(pos)
        low = held.lowest(at)[0] / scale
        return low + (pos - at) * (held.lowest(min(at + 1, held.n - 1))[0] / scale - low)

    for k, day in enumerate(days):
        while days[first] < day - width:
            if whole[first] is not None:
                held.add(rank[whole[first]], -1)
            first += 1
        if own[k]:
            n = held.n
            if not n:
                out.append((0, *[None] * 7))
            else:
                mean = held.total / (n * scale)
                spread = n * held.squares - held.total**2
                cut = int(n * TRIM)
                kept = held.lowest(n - cut)[1] - held.lowest(cut)[1]
                centre2 = held.lowest((n - 1) // 2)[0] + held.lowest(n // 2)[0]
                mad = (held.kth_distance(centre2, (n - 1) // 2) + held.kth_distance(centre2, n // 2)) / (4 * scale)
                out.append((n, quantile(0.5), mean, math.sqrt(spread / (n * (n - 1))) / scale if n > 1 else None, quantile(0.25), quantile(0.75), kept / ((n - 2 * cut) * scale), mad))
        if whole[k] is not None:
            held.add(rank[whole[k]], 1)
    return out


def legal_discount(savings: Column) -> Column:
    return savings > 0


def fake_discount_reasons(new: Column, old: Column, advertised: Column, median: Column, low: Column) -> Column:
    """Why a discount is suspect: only where the new price does not beat the low of the window."""
    limit, unreal = median * INFLATED, new >= low
    return F.array_compact(F.array(F.when(unreal & (advertised > limit), "ADVERTISED_ORIGINAL_INFLATED"), F.when(unreal & (old > limit) & (new < old), "OBSERVED_PRE_SALE_HIKE")))


def days_at_current_price(obs: DataFrame, days: int = history.REFERENCE_DAYS) -> DataFrame:
    """Days since the run of rows before this one, in its window, that have this row's price began; 0 if there is none."""
    rows = obs.withColumn("_change", F.coalesce((F.col("price") != F.lag("price").over(history.by_offer())).cast("int"), F.lit(1)))
    rows = rows.withColumn("_run", F.sum("_change").over(history.by_offer()))
    run = Window.partitionBy("offer_id", "_run").orderBy("day").rangeBetween(-days, 0)
    return rows.withColumn("days_at_price", F.col("day") - F.min("day").over(run)).drop("_change", "_run")


def badges(is_low: Column, legal: Column, hike: Column, stock: Column) -> Column:
    return F.array_compact(F.array(F.when(is_low, "all_time_low"), F.when(legal, "legal_discount"), F.when(hike, "pre_sale_hike"), F.when(stock == "limited_stock", "limited_stock")))


def rule_summary(verdict_: Column, discount: Column, provenance: Column) -> tuple[Column, Column, Column]:
    """(text, score, recommended) by fixed rules."""
    basis = F.when(provenance == "genuine", "30-day low").when(provenance == "confirmed_empty", "last price (no rows in 30 days)").otherwise("reference (basis unknown)")
    good = verdict_ == "GENUINE_DEAL"
    return F.format_string("%s: %.2f%% against the %s", verdict_, discount, basis), F.when(good, 8).otherwise(4), good
