"""Page-field extraction: the scraper re-aimed at a table of fetched pages.

The reference parses one page with an HTML tree library per run; here every
field is a regular expression over the ``html`` column (JVM-side, codegen),
so a table of billions of pages is one narrow map stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns of the reference's page: element with id "productTitle"; first span of class "a-price-whole".
PRODUCT_TITLE = r'(?is)id="productTitle"[^>]*>(.*?)</'
PRICE_SPAN = r'(?is)<span[^>]*class="[^"]*a-price-whole[^"]*"[^>]*>(.*?)</span>'
DOCUMENT_TITLE = r"(?is)<title[^>]*>(.*?)</title>"
HEADING = r"(?is)<h1[^>]*>(.*?)</h1>"
DOLLAR_AMOUNT = r"(?s)(\$\s*[0-9][0-9,]*(?:\.[0-9]+)?)"
LANG = r'(?is)<html[^>]*\blang="([^"]*)"'


def strip_text(c: Column) -> Column:
    """Python ``str.strip()``: drop leading/trailing whitespace; empty -> NULL."""
    return F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))


def element_text(html: Column, pattern: str) -> Column:
    """First capture of ``pattern`` (tags inside removed), stripped."""
    raw = F.regexp_extract(html, pattern, 1)
    return strip_text(F.regexp_replace(raw, r"<[^>]+>", ""))


def parse_price(text: Column) -> Column:
    """Price text to DECIMAL(10,2): currency sign and thousands separators removed; garbage -> NULL."""
    digits = F.regexp_replace(F.regexp_replace(text, r"^\s*[^0-9.\-]+", ""), ",", "")
    return F.nullif(digits, F.lit("")).try_cast("decimal(10,2)")


def extract_fields(pages: DataFrame, snapshot_date: str, title_pattern: str = PRODUCT_TITLE,
                   price_pattern: str = PRICE_SPAN) -> DataFrame:
    """(page_id, url, title, price, date) for every page; ``snapshot_date`` makes runs repeatable."""
    h = F.col("html")
    return pages.select(
        "page_id", "url",
        element_text(h, title_pattern).alias("title"),
        parse_price(element_text(h, price_pattern)).alias("price"),
        F.to_date(F.lit(snapshot_date)).alias("date"),
    )


def page_outline(pages: DataFrame) -> DataFrame:
    """Document title, first heading and language of each page."""
    h = F.col("html")
    return pages.select("page_id", "url", element_text(h, DOCUMENT_TITLE).alias("title"),
                        element_text(h, HEADING).alias("heading"),
                        F.nullif(F.regexp_extract(h, LANG, 1), F.lit("")).alias("lang"))
