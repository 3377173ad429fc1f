"""Listing pages to product rows: structured data, cards by rules, price precedence."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

PRODUCT = "`@type`: string, name: string, url: string, offers: string"
BLOCK = r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"


def extract_jsonld(pages: DataFrame) -> DataFrame:
    """page_id, name, url, price, in_stock of every product in ``ld+json`` blocks: a bare object, a list, ``@graph`` or an ItemList."""
    blocks = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(BLOCK), F.lit(1))).alias("b"))
    items = F.coalesce(F.from_json(F.get_json_object("b", "$.@graph"), "array<string>"), F.from_json("b", "array<string>"), F.array(F.col("b")))
    items = blocks.select("page_id", F.explode(items).alias("i"))
    listed = F.from_json(F.get_json_object("i", "$.itemListElement"), "array<string>")
    items = items.select("page_id", F.explode(F.coalesce(F.transform(listed, lambda x: F.coalesce(F.get_json_object(x, "$.item"), x)), F.array("i"))).alias("i"))
    p = items.select("page_id", F.from_json("i", f"struct<{PRODUCT}>").alias("p")).filter(F.col("p.@type") == "Product")
    offer = F.coalesce(F.get_json_object("p.offers", "$[0]"), F.col("p.offers"))
    stock = F.regexp_extract(F.get_json_object(offer, "$.availability"), "([A-Za-z]+)$", 1)
    in_stock = F.when(stock.isin("InStock", "LimitedAvailability", "OnlineOnly"), True).when(stock.isin("OutOfStock", "SoldOut", "Discontinued"), False)
    return p.select("page_id", F.col("p.name").alias("name"), F.col("p.url").alias("url"), T.machine_price(F.get_json_object(offer, "$.price")).alias("price"), in_stock.alias("in_stock"))


class _Cards(HTMLParser):
    """Collects, for each element with the card class, the text of its fields by class, and the address of its link."""

    def __init__(self, rule: dict[str, str]):
        super().__init__()
        self.rule, self.cards, self.depth, self.field = rule, [], 0, None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("br", "img", "meta", "input", "link", "hr"):
            return
        a = {k: v or "" for k, v in attrs}
        classes = a.get("class", "").split()
        if self.depth:
            self.depth += 1
        elif self.rule["card"] in classes:
            self.depth = 1
            self.cards.append({})
        if self.depth:
            card = self.cards[-1]
            if tag == "a" and "href" in a:
                card.setdefault("url", a["href"])
            if "data-price" in a:
                card.setdefault("semantic", a["data-price"])
            self.field = next((f for f in ("title", "price", "reference", "stock") if self.rule[f] in classes), self.field)

    def handle_endtag(self, tag: str) -> None:
        if self.depth:
            self.depth -= 1
            self.field = None

    def handle_data(self, data: str) -> None:
        if self.depth and self.field and data.strip():
            self.cards[-1].setdefault(self.field, data.strip())


CARD = "page_id long, pos int, title string, url string, price_text string, reference_text string, stock_text string, semantic_price string"


def extract_cards(pages: DataFrame, rules: dict[str, dict[str, str]]) -> DataFrame:
    """Cards of listing pages (page_id, retailer, html) by a retailer's rule: the classes of card, title, price, reference, stock."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page, retailer, html in zip(batch["page_id"], batch["retailer"], batch["html"], strict=True):
                if retailer in rules and html:
                    parser = _Cards(rules[retailer])
                    parser.feed(html)
                    out += [(page, k, c.get("title"), c.get("url"), c.get("price"), c.get("reference"), c.get("stock"), c.get("semantic")) for k, c in enumerate(parser.cards)]
            yield pd.DataFrame(out, columns=[f.split()[0] for f in CARD.split(", ")])

    return pages.select("page_id", "retailer", "html").mapInPandas(run, CARD)


def resolve_price(cards: DataFrame, jsonld: DataFrame) -> DataFrame:
    """Adds price and price_layer: structured data (by canonical address, else by name), then the semantic value, then visible text."""
    j = jsonld.filter("price is not null")
    by_url = j.groupBy("page_id", T.canonical_url(F.col("url")).alias("key_url")).agg(F.min("price").alias("url_price"))
    by_name = j.groupBy("page_id", F.lower("name").alias("key_name")).agg(F.min("price").alias("name_price"))
    c = cards.withColumn("key_url", T.canonical_url(F.col("url"))).withColumn("key_name", F.lower("title"))
    c = c.join(by_url, ["page_id", "key_url"], "left").join(by_name, ["page_id", "key_name"], "left")
    c = c.withColumn("s", T.machine_price(F.col("semantic_price"))).withColumn("t", T.local_price(F.col("price_text")))
    structured = F.coalesce("url_price", "name_price")
    layer = F.when(structured.isNotNull(), "jsonld").when(F.col("s").isNotNull(), "semantic").when(F.col("t").isNotNull(), "text")
    return c.withColumn("price", F.coalesce(structured, "s", "t")).withColumn("price_layer", layer).drop("key_url", "key_name", "url_price", "name_price", "s", "t")


def extraction_failures(cards: DataFrame) -> DataFrame:
    """Cards without a price from any layer."""
    return cards.filter("price is null").withColumn("reason", F.when(F.col("price_text").isNull(), "no_price_element").otherwise("unreadable_price"))


def failures_by_store(failed: DataFrame, pages: DataFrame) -> DataFrame:
    """Failed cards counted by retailer and reason; pages: page_id, retailer."""
    return failed.select("page_id", "reason").join(pages.select("page_id", "retailer"), "page_id").groupBy("retailer", "reason").agg(F.count("*").alias("n"))
