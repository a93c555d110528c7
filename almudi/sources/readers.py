"""Readers with closed schemas: JSON lines, JSON documents, CSV, sitemaps, HTML cards."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a line that doesn't fit the schema fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_documents(spark: SparkSession, path: str, schema: str, quarantine: str = "_bad") -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined texts) of whole-file JSON documents."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": quarantine}
    df = spark.read.text(path, wholetext=True).select("value", F.from_json("value", f"{schema}, {quarantine} string", options).alias("x"))
    bad = F.col("x").isNull() | F.col(f"x.{quarantine}").isNotNull()
    return df.where(~bad).select("x.*").drop(quarantine), df.where(bad).select(F.col("value").alias(quarantine))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("escape", '"').option("multiLine", True).csv(path)


def sitemap_urls(spark: SparkSession, path: str) -> DataFrame:
    """Distinct locations of sitemap XML files."""
    df = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)
    return df.select(F.trim("loc").alias("loc")).where("loc is not null and loc <> ''").distinct()


class _Cards(HTMLParser):
    """Collects elements with data-product-id: their id, price attribute and text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.cards: list[tuple[str, str | None, str]] = []
        self.open: list | None = None
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if self.open is None and "data-product-id" in a:
            self.open, self.depth = [a["data-product-id"], a.get("data-price"), ""], 1
        elif self.open is not None and tag not in ("br", "img", "input", "meta", "link", "hr"):
            self.depth += 1

    def handle_endtag(self, tag):
        if self.open is not None and tag not in ("br", "img", "input", "meta", "link", "hr"):
            self.depth -= 1
            if self.depth == 0:
                self.cards.append((self.open[0], self.open[1], " ".join(self.open[2].split())))
                self.open = None

    def handle_data(self, data):
        if self.open is not None:
            self.open[2] += data


def product_cards(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, card_pos, product_id, price, title) of captured HTML; null pages give none."""

    def run(batches):
        for pdf in batches:
            rows = []
            for i, html in zip(pdf[id_col], pdf[html_col], strict=True):
                parser = _Cards()
                parser.feed(html or "")
                rows += [(i, k, *c) for k, c in enumerate(parser.cards)]
            yield pd.DataFrame(rows, columns=["page_id", "card_pos", "product_id", "price", "title"])

    return pages.select(F.col(id_col).cast("long").alias(id_col), html_col).mapInPandas(run, "page_id long, card_pos int, product_id string, price string, title string")
