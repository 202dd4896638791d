"""Declarative extraction from stored HTML pages with built-in expressions.

A layout names the elements that begin an item and, per field, the elements that hold it.
An item reaches from its opening tag to the opening tag of the next one; a field is the first
fitting element of the item, and its text ends at the first end tag of the same name, so an
element that holds another of its own name is cut there.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: character references that are read back, the ampersand last
REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def tag(name: str) -> str:
    """An element by its name."""
    return rf"(?i:{name})(?=[\s/>])"


def word(attribute: str, value: str, name: str = r"[\w-]+") -> str:
    """An element with ``value`` among the blank-separated words of an attribute (class, id)."""
    return rf"{name}\s[^>]*?\b{attribute}\s*=\s*[\"']?(?:[^\"'>]*\s)?{re.escape(value)}(?=[\s\"'>])"


def holds(attribute: str, value: str, name: str = r"[\w-]+") -> str:
    """An element with ``value`` anywhere in an attribute."""
    return rf"{name}\s[^>]*?\b{attribute}\s*=\s*[\"']?[^\"'>]*{re.escape(value)}"


def element(*forms: str) -> str:
    """Pattern of the opening tag of an element of one of the forms; group 1 is its name."""
    return rf"<(?={'|'.join(forms)})([\w-]+)[^>]*>"


def plain_text(markup: Column) -> Column:
    """Text without tags, the blanks around them and character references."""
    text = F.regexp_replace(markup, r"\s*<[^>]*>\s*", "")
    for reference, char in REFERENCES.items():
        text = F.replace(text, F.lit(reference), F.lit(char))
    return F.trim(text)


def first_text(markup: Column, opening: str) -> Column:
    """Text of the first fitting element, null without one."""
    whole = rf"(?s){opening}(.*?)</\1\s*>"
    return F.when(markup.rlike(whole), plain_text(F.regexp_extract(markup, whole, 2)))


def first_attribute(markup: Column, opening: str, attribute: str) -> Column:
    """An attribute's value in the first fitting element, null where it has none."""
    pattern = rf"(?s)\s{attribute}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
    start = F.regexp_extract(markup, rf"(?s){opening}", 0)
    value = F.concat(F.regexp_extract(start, pattern, 1), F.regexp_extract(start, pattern, 2))
    return F.when(start.rlike(pattern), plain_text(value))


def extract_pages(pages: DataFrame, base: str, fields: dict[str, tuple[str, str | None]], key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per item: key, item_idx and one string column per field.

    ``base`` and each field's pattern come from ``element``; a field with an attribute name
    gives that attribute, else the element's text. Null pages give no rows.
    """
    body = F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), r"(?is)<(script|style)\b.*?</\1\s*>", "")
    items = F.filter(F.split(body, f"(?={base})"), lambda x: x.rlike(f"^{base}"))
    d = pages.select(key, F.posexplode(items).alias("item_idx", "__item"))
    item = F.col("__item")
    return d.select(key, "item_idx", *[(first_text(item, p) if a is None else first_attribute(item, p, a)).alias(n) for n, (p, a) in fields.items()])


def first_nonempty(items: DataFrame, group: str, priority: str) -> DataFrame:
    """Items of the first page (by priority) of each group that gave any."""
    best = items.groupBy(group).agg(F.min(priority).alias(priority))
    return items.join(best, [group, priority], "left_semi")


def crawl_items(pages: DataFrame, platform: str, urls: list[str], base: str, fields: dict[str, tuple[str, str | None]]) -> DataFrame:
    """Items of a platform's stored pages, from the first of its ``urls`` that gave any."""
    order = F.array(*[F.lit(u) for u in urls])
    d = pages.where(F.col("url").isin(urls)).withColumn("page_rank", F.array_position(order, F.col("url")))
    items = extract_pages(d, base, fields, "page_rank").withColumn("platform", F.lit(platform))
    for name in ("title", "name", "text", "engagement", "tweet_count", "views", "hashtag", "url", "category"):
        if name not in items.columns:
            items = items.withColumn(name, F.lit(None).cast("string"))
    named = items.where(F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in ("title", "name", "text")]).isNotNull())
    return first_nonempty(named, "platform", "page_rank")
