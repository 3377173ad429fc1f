"""Watchlist quality, search answers and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import written
from .history import newest

#: What stands on pages that block the real content (the first within HEAD characters), and on pages with a mere widget.
WAIT, HEAD = "just a moment", 2000
CHALLENGE = r"_cf_chl_opt|/cdn-cgi/challenge-platform/h/[a-z]+/orchestrate/"
WIDGET = r"cf-turnstile|challenges\.cloudflare\.com/turnstile/"
#: For each layout of listings its ordered rules (status, what the availability id is, the class has, the text has).
STOCK_RULES = {
    "ids": (("out_of_stock", None, None, "stoc epuizat|indisponibil"), ("limited_stock", "2", None, "ultimul produs"), ("in_stock", "3", None, "in stoc")),
    "classes": (("out_of_stock", None, "outofstock", None), ("supplier_stock", None, "insupplierstock", None), ("limited_stock", None, "instock", "limitat"), ("in_stock", None, "instock", None)),
    "marks": (("out_of_stock", None, "*out-of-stock", None), ("out_of_stock", None, "*sold-out", None), ("limited_stock", None, "limited-stock", None), ("supplier_stock", None, "supplier-stock", None), ("in_stock", None, "in-stock", None), ("in_stock", None, "bin-display", None)),
    "labels": (("out_of_stock", None, None, "epuizat|indisponibil"), ("out_of_stock", None, "*outofstock", None), ("supplier_stock", None, None, "furnizor"), ("supplier_stock", None, "*insupplierstock", None), ("limited_stock", None, None, "limitat"), ("in_stock", None, "*instock", None)),
}
SAMPLES = 5
#: Queries that are sent to every task, counted first; more are joined by a shuffle of the titles' words.
FEW = 20_000


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


#: A word of a title: letters and digits, with single dots inside.
WORD = r"[\p{L}\p{N}]+(?:\.[\p{L}\p{N}]+)*"
#: Units that belong to the number before them.
UNITS = ("gb", "tb", "mb", "ghz", "mhz", "hz", "inch", "w", "mah")


def _with_units(words: Column) -> Column:
    """Words with each number and the unit after it as one word (``16 gb`` as ``16gb``)."""
    line = F.regexp_replace(F.array_join(words, " "), rf"(?<![^ ])(\d+(?:\.\d+)?) ({'|'.join(UNITS)})(?![^ ])", "$1$2")
    return F.filter(F.split(line, " "), lambda w: w != "")


def _folded(text: Column) -> Column:
    """Folded to plain letters, a comma between digits as a point."""
    return F.regexp_replace(T.fold_all(text), r"(?<=\d),(?=\d)", ".")


def _title_forms(title: Column) -> Column:
    """All forms in which a title holds a word: as it is, with its unit, and hyphenated words as one."""
    text = _folded(title)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    hyphenated = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)+"), F.lit(0))
    return F.array_distinct(F.concat(words, _with_units(words), F.transform(hyphenated, lambda w: F.replace(w, F.lit("-"), F.lit("")))))


def _query_forms(query: Column) -> Column:
    """Each word of a query with its alternatives: all of ``parts``, or ``joined`` (of a hyphenated word)."""
    words = _with_units(F.filter(F.split(_folded(query), r"\s+"), lambda w: w != ""))
    parts = lambda w: F.regexp_extract_all(w, F.lit(WORD), F.lit(0))
    return F.transform(words, lambda w: F.struct(parts(w).alias("parts"), F.when(F.contains(w, F.lit("-")), F.array_join(parts(w), "")).alias("joined")))


def _at_site(site: Column, retailer: Column, any_site: bool) -> Column:
    return F.lit(True) if any_site else (site == "all") | (site == retailer)


def sent(asked: DataFrame) -> tuple[DataFrame, bool]:
    """Queries with their keys, and whether they are few: then they go to the titles, which no shuffle moves and whose frequent words fill no task."""
    asked = written(asked, "asked")
    few = asked.count() <= FEW
    return F.broadcast(asked) if few else asked, few


def match_titles(watches: DataFrame, offers: DataFrame, any_site: bool = False) -> DataFrame:
    """watch_id, offer_id where every word of the query is a word of the title, at the watch's site or at any.

    The rarest word of each query is the join key, so titles meet only watches that share it; no pair is lost.
    """
    w = watches.select("watch_id", "site", F.array_distinct(_words(F.col("query"))).alias("q")).filter(F.size("q") > 0)
    o = offers.select("offer_id", "retailer", F.array_distinct(_words(F.col("title"))).alias("t"))
    often = o.select(F.explode("t").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    keyed = w.select("watch_id", "site", "q", F.explode("q").alias("word")).join(often, "word", "left")
    # A query with a word that no title has matches nothing.
    key = keyed.groupBy("watch_id").agg(F.min_by("word", F.struct("n", "word")).alias("key"), F.count_if(F.col("n").isNull()).alias("unknown")).filter("unknown = 0")
    w = sent(w.join(key.select("watch_id", "key"), "watch_id"))[0]
    hits = o.withColumn("key", F.explode("t")).join(w, "key")
    return hits.filter((F.size(F.array_except("q", "t")) == 0) & _at_site(F.col("site"), F.col("retailer"), any_site)).select("watch_id", "offer_id")


def match_titles_loosely(watches: DataFrame, offers: DataFrame, any_site: bool = False) -> DataFrame:
    """watch_id, offer_id, how: all strict matches (``strict``), and titles that hold every word of the query in one of its forms
    (``normalized``): without marks and hyphens, with decimal points, units joined to their numbers. No word is dropped; a query with
    a word of neither letters nor digits matches strictly alone.

    An inverted index of titles' forms is joined by the forms of one word a query: of each word the rarest part and the joined
    form, of the query the word whose forms are in the fewest titles. Every loose match has one of them.
    """
    w = watches.select("watch_id", "site", _query_forms(F.col("query")).alias("q")).filter((F.size("q") > 0) & ~F.exists("q", lambda x: F.size(x.parts) == 0))
    titles = written(offers.select("offer_id", "retailer", _title_forms(F.col("title")).alias("t")), "title-forms")
    index = titles.select("offer_id", F.explode("t").alias("form"))
    often = index.groupBy("form").agg(F.count("*").alias("n"))
    words = w.select("watch_id", F.posexplode("q").alias("at", "word"))
    forms = words.select("watch_id", "at", F.explode("word.parts").alias("form"), F.lit(False).alias("is_joined"))
    forms = forms.unionByName(words.filter("word.joined is not null").select("watch_id", "at", F.col("word.joined").alias("form"), F.lit(True).alias("is_joined")))
    counted = forms.join(often, "form", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = counted.groupBy("watch_id", "at", "is_joined").agg(F.min_by("form", F.struct("n", "form")).alias("form"), F.min("n").alias("n"))
    cost = rarest.groupBy("watch_id", "at").agg(F.sum("n").alias("n"), F.collect_list(F.when(F.col("n") > 0, F.col("form"))).alias("keys"))  # two at most
    best = cost.groupBy("watch_id").agg(F.min_by("keys", F.struct("n", "at")).alias("keys"))
    asked, few = sent(w.join(best, "watch_id").withColumn("form", F.explode(F.array_distinct("keys"))).drop("keys"))
    held = F.forall("q", lambda x: (F.size(F.array_except(x.parts, F.col("t"))) == 0) | F.coalesce(F.array_contains(F.col("t"), x.joined), F.lit(False)))
    held = held & _at_site(F.col("site"), F.col("retailer"), any_site)
    if few:
        found = titles.withColumn("form", F.explode("t")).join(asked, "form").filter(held).select("watch_id", "offer_id").distinct()
    else:
        found = asked.join(index, "form").select("watch_id", "site", "q", "offer_id").dropDuplicates(["watch_id", "offer_id"]).join(titles, "offer_id").filter(held)
    loose = found.select("watch_id", "offer_id", F.lit("normalized").alias("how"))
    both = loose.unionByName(match_titles(watches, offers, any_site).withColumn("how", F.lit("strict")))
    return both.groupBy("watch_id", "offer_id").agg(F.max("how").alias("how"))  # strict comes last


def flag_blocked_pages(pages: DataFrame) -> DataFrame:
    """Adds is_blocked (a page in place of the real content) and has_widget (the real content beside a challenge widget)."""
    low = F.lower("html")
    return pages.withColumn("is_blocked", F.contains(F.substring(low, 1, HEAD), F.lit(WAIT)) | F.rlike(low, F.lit(CHALLENGE))).withColumn("has_widget", F.rlike(low, F.lit(WIDGET)))


def classify_stock(layout: Column, text: Column, classes: Column, availability: Column) -> Column:
    """The first rule of the layout that holds. An id or a text is enough where a rule has both; a class and a text must both be there.
    A class with ``*`` may be part of a name. Romanian letters count without their marks as well."""
    said, names = F.lower(text), F.split(F.coalesce(classes, F.lit("")), " ")
    no = F.lit(False)
    out = F.lit("unknown")
    for kind, rules in STOCK_RULES.items():
        status = F.lit("unknown")
        for name, wanted, has, words in reversed(rules):
            by_text = F.coalesce(F.rlike(said, F.lit(words)) | F.rlike(T.fold(text), F.lit(words)), no) if words else None
            if has:
                own = F.contains(F.lower(F.coalesce(classes, F.lit(""))), F.lit(has[1:])) if has[0] == "*" else F.array_contains(names, has)
                hit = own & by_text if by_text is not None else own
            else:
                hit = by_text | F.coalesce(availability == wanted, no) if wanted else by_text
            status = F.when(hit, name).otherwise(status)
        out = F.when(layout == kind, status).otherwise(out)
    return out


def clean_search_offers(rows: DataFrame) -> DataFrame:
    """Usable rows with canonical address, the cheapest of each shop and address, ranked: in stock first, then price, shop, title."""
    good = rows.filter("price is not null and title is not null and title <> '' and url is not null").withColumn("url", T.canonical_url(F.col("url")))
    best = newest(good, ["shop", "url"], [F.col("price"), F.col("title")])
    order = Window.partitionBy("query").orderBy((F.col("stock_status") == "out_of_stock").cast("int"), "price", "shop", "title", "url")
    return best.withColumn("rank", F.row_number().over(order))


def shop_answer_status(counters: DataFrame) -> DataFrame:
    """Per query and shop its status, and whether the query has any ok. The first that holds of: unsupported (the shop is not one to
    ask), ok (offers), blocked, no_match (the listing never appeared), error (a fault, no answer at all, or cards that match and have
    no price), no_match.

    counters: query, shop, is_supported and counts: offers, blocked, missing, errors, answers, priceless.
    """
    counts = ("offers", "blocked", "missing", "errors", "answers", "priceless")
    by = counters.groupBy("query", "shop").agg(F.bool_and("is_supported").alias("is_supported"), *[F.sum(c).alias(c) for c in counts])
    some = lambda c: F.col(c) > 0
    status = (
        F.when(~F.col("is_supported"), "unsupported").when(some("offers"), "ok").when(some("blocked"), "blocked").when(some("missing"), "no_match")
        .when(some("errors") | ~some("answers") | some("priceless"), "error").otherwise("no_match")
    )
    return by.withColumn("status", status).withColumn("answered", F.bool_or(F.col("status") == "ok").over(Window.partitionBy("query"))).select("query", "shop", "status", "answered")


def target_price_feasibility(watches: DataFrame, matches: DataFrame, prices: DataFrame) -> DataFrame:
    """State of each watch's target against the lowest price ever observed of what its query matches."""
    low = matches.join(prices, "offer_id").groupBy("watch_id").agg(F.min("price").alias("lowest"))
    t, x = F.col("target_price"), F.col("lowest")
    state = F.when(t.isNull(), "not_set").when(x.isNull(), "no_matching_history").when(t < x, "below_observed_historical_low").otherwise("within_observed_range")
    return watches.join(low, "watch_id", "left").select("watch_id", F.when(t.isNotNull(), x).alias("lowest"), state.alias("state"))


def duplicate_watches(watches: DataFrame) -> DataFrame:
    """Watches of one site and normalised query, each with the others."""
    key = F.lower(F.trim(F.regexp_replace("query", r"\s+", " ")))
    rows = watches.withColumn("q", key)
    groups = rows.groupBy("site", "q").agg(F.array_sort(F.collect_set("watch_id")).alias("ids")).filter(F.size("ids") > 1)
    return groups.select("site", "q", F.explode("ids").alias("watch_id"), "ids").select("watch_id", F.array_remove("ids", F.col("watch_id")).alias("others"))


def _url_checks(url: Column, suffix: Column) -> tuple[Column, Column, Column]:
    """(scheme, host and path of the canonical address are as expected)."""
    c = T.canonical_url(url)
    host, path = F.regexp_extract(c, "^[a-z]+://([^/?]*)", 1), F.regexp_extract(c, "^[a-z]+://[^/?]*([^?]*)", 1)
    return F.rlike(c, F.lit("^https?://")), F.coalesce(F.endswith(host, suffix), F.lit(False)), ~path.isin("", "/")


def url_structure_check(pages: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """scheme_ok, host_ok (one of the suffixes), path_ok and valid of each page's address."""
    scheme, _, path = _url_checks(F.col("url"), F.lit(""))
    host = F.exists(F.array(*map(F.lit, suffixes)), lambda s: _url_checks(F.col("url"), s)[1])
    return pages.select("page_id", scheme.alias("scheme_ok"), host.alias("host_ok"), path.alias("path_ok"), (scheme & host & path).alias("valid"))


def audit_watches(checks: DataFrame, results: DataFrame) -> DataFrame:
    """Status of each watch and store from what a listing returned: the first that holds of UNSUPPORTED, MANUAL_REVIEW (no query),
    UNVERIFIED (error or challenge), MISMATCH (results, none matches), PASS or MANUAL_REVIEW (by the addresses of the
    first SAMPLES matches), UNVERIFIED (extraction failed), NO_RESULTS.

    checks: watch_id, store, query, is_supported, host, failed, challenged, extraction_failed; results: watch_id, store, at, title, url.
    """
    query = sent(checks.select("watch_id", "store", "host", _words(F.col("query")).alias("q")))[0]
    rows = results.join(query, ["watch_id", "store"]).withColumn("matches", F.size(F.array_except("q", F.split(F.lower("title"), r"\s+"))) == 0)
    counts = rows.groupBy("watch_id", "store").agg(F.count("*").alias("results"), F.count_if("matches").alias("n"))
    # Tasks keep the first matches of a watch before a shuffle; only their addresses are taken apart.
    nth = F.row_number().over(Window.partitionBy("watch_id", "store").orderBy("at"))
    first = rows.filter("matches").select("watch_id", "store", "at", "title", "url", "host", nth.alias("nth")).filter(F.col("nth") <= SAMPLES)
    valid = _url_checks(F.col("url"), F.col("host"))
    first = first.groupBy("watch_id", "store").agg(
        F.count_if(~(valid[0] & valid[1] & valid[2])).alias("odd"), F.transform(F.array_sort(F.collect_list(F.struct("nth", "title"))), lambda x: x["title"]).alias("samples"),
    )
    found = counts.join(first, ["watch_id", "store"], "left")
    out = checks.join(found, ["watch_id", "store"], "left")
    n, results_ = F.coalesce("n", F.lit(0)), F.coalesce("results", F.lit(0))
    query_ = F.coalesce(F.trim("query"), F.lit(""))
    status = (
        F.when(~F.col("is_supported"), "UNSUPPORTED").when(query_ == "", "MANUAL_REVIEW").when(F.col("failed") | F.col("challenged"), "UNVERIFIED").when((results_ > 0) & (n == 0), "MISMATCH")
        .when((n > 0) & (F.col("odd") > 0), "MANUAL_REVIEW").when(n > 0, "PASS").when(F.col("extraction_failed"), "UNVERIFIED").otherwise("NO_RESULTS")
    )
    asked = F.col("is_supported") & (query_ != "") & ~F.col("failed")
    return out.select("watch_id", "store", status.alias("status"), F.when(asked, n).otherwise(0).alias("n"), F.when(asked, F.coalesce("samples", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("samples"))


def audit_acceptance(audit: DataFrame, at_us: Column, first_day: str, days: int = 7, zone: str = "Europe/Bucharest") -> DataFrame:
    """Totals of an audit, whether all pass, and whether the local date lies in the event's days."""
    local = F.to_date(F.from_utc_timestamp(F.timestamp_micros(at_us), zone))
    inside = local.between(F.to_date(F.lit(first_day)), F.date_add(F.to_date(F.lit(first_day)), days - 1))
    ok = F.col("status").isin("PASS")
    return audit.agg(F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"), F.bool_and(ok).alias("all_pass")).withColumn("in_window", inside)


def apply_change_feed(stored: DataFrame, feed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new table, outcome per change). feed: seq, id, op (add, update, enable, delete), old, new; stored: id, value, enabled.
    ``enable`` sets the flag ``enabled`` to its new value (text) and keeps the rest; added rows are enabled.

    The first change of an id counts, later ones are duplicates. A change applies if the stored value is the expected old one; it is
    already applied if the stored value is the new one; else it conflicts.
    """
    at = F.row_number().over(Window.partitionBy("id").orderBy("seq"))
    both = feed.withColumn("at", at).join(stored.withColumn("is_there", F.lit(True)), "id", "full_outer")
    switch = F.coalesce(F.col("op") == "enable", F.lit(False))
    now = F.when(switch, F.col("enabled").cast("string")).otherwise(F.col("value"))
    wanted = F.when(F.col("op") == "delete", F.lit(None)).otherwise(F.col("new"))
    outcome = F.when(F.col("at") > 1, "duplicate").when(switch & F.col("is_there").isNull(), "conflict").when(now.eqNullSafe(wanted), "already_applied").when(now.eqNullSafe(F.col("old")), "applied").otherwise("conflict")
    judged = both.withColumn("switch", switch).withColumn("outcome", F.when(F.col("op").isNotNull(), outcome)).withColumn("wanted", wanted)
    first, applied = judged.filter("at is null or at = 1"), F.col("outcome").eqNullSafe(F.lit("applied"))
    table = first.select(
        "id", F.when(applied & ~F.col("switch"), F.col("wanted")).otherwise(F.col("value")).alias("value"),
        F.when(applied & F.col("switch"), F.col("wanted").cast("boolean")).otherwise(F.coalesce("enabled", F.lit(True))).alias("enabled"),
    ).filter("value is not null")
    return table, judged.filter("op is not null").select("seq", "id", "outcome")


def watch_coverage(watches: DataFrame, matches: DataFrame, offers: DataFrame) -> DataFrame:
    """Offers per watch, and one row (watch_id null) with the offers that match none."""
    per = watches.select("watch_id").join(matches.groupBy("watch_id").agg(F.count("*").alias("n")), "watch_id", "left").select("watch_id", F.coalesce("n", F.lit(0)).alias("n"))
    none = offers.join(matches.select("offer_id").distinct(), "offer_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit(None).cast("string").alias("watch_id"), "n")
    return per.unionByName(none)
