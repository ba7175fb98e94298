"""Search and facets over snapshot items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteledger.functions.text import WIDE_SPACE, trim_wide
from siteledger.operators.common import ranked

SORTS = ("relevance", "title_asc", "title_desc", "price_asc", "price_desc")


def matches(items: DataFrame, query: str, category: str | None = None, attributes: dict[str, list[str]] | None = None, products_only: bool = False) -> DataFrame:
    """Items that hold every term, with their score: 10 for a term in the title, 1 for one in the body.

    items: id, title, body_text, is_product, category_ids, attributes, price_minor, currency, unit.
    """
    if len(query) > 200:
        raise ValueError("SEARCH_LIMIT")
    title = F.lower("title")
    haystack = F.concat(title, F.lit("\n"), F.lower(F.coalesce("body_text", F.lit(""))))
    terms = F.filter(F.split(F.lower(trim_wide(F.lit(query))), f"{WIDE_SPACE}+"), lambda t: t != "")
    keep = F.forall(terms, lambda t: F.contains(haystack, t))
    if products_only:
        keep &= F.col("is_product")
    if category is not None:
        keep &= F.array_contains("category_ids", category)
    for name, values in (attributes or {}).items():
        keep &= F.coalesce(F.arrays_overlap(F.try_element_at("attributes", F.lit(name)), F.array(*map(F.lit, values))), F.lit(False))
    score = F.aggregate(terms, F.lit(0), lambda a, t: a + F.when(F.contains(title, t), 10).otherwise(1))
    return items.filter(keep).withColumn("score", score)


def order_by(sort: str) -> list:
    tie = [F.lower("title"), F.col("id")]
    if sort == "title_desc":
        return [c.desc() for c in tie]
    if sort in ("price_asc", "price_desc"):
        price = F.col("price_minor")
        return [price.asc_nulls_last() if sort == "price_asc" else price.desc_nulls_last(), *tie]
    return tie if sort == "title_asc" else [F.col("score").desc(), *tie]


def page(found: DataFrame, sort: str = "relevance", number: int = 1, per_page: int = 20) -> DataFrame:
    """One page of hits with the total. Near pages are a top-k; deep ones are numbered range by range."""
    if sort not in SORTS or not 1 <= number <= 10_000 or not 1 <= per_page <= 100:
        raise ValueError("SEARCH_LIMIT")
    if sort.startswith("price_"):
        kinds = found.filter("price_minor is not null").select("currency", "unit").distinct().limit(2).count()
        if kinds > 1:
            raise ValueError("PRICE_SORT_INCOMPARABLE")
    order, last = order_by(sort), number * per_page
    near = found.orderBy(*order).limit(last) if last <= 10_000 else found
    rows = ranked(near, order, "position", buckets=1 if last <= 10_000 else 64).filter(F.col("position").between(last - per_page, last - 1))
    total = found.agg(F.count("*").alias("total"))  # one row
    return rows.join(F.broadcast(total))


def facets(items: DataFrame, names: int = 20, values: int = 200) -> DataFrame:
    """name, value, items, limited: the first attribute names and of each the first values, in byte order."""
    pairs = items.select(F.explode("attributes").alias("name", "all")).select("name", F.explode("all").alias("value"))
    counted = pairs.groupBy("name", "value").agg(F.count("*").alias("items"))
    chosen = counted.select("name").distinct().orderBy("name").limit(names)
    rows = counted.join(F.broadcast(chosen), "name")
    # Tasks keep their own first values of a name before any is ranked as a whole; the counts need no order.
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy("value"))).filter(F.col("n") <= values)
    sizes = rows.groupBy("name").agg(F.count("*").alias("distinct_values"))
    return first.join(F.broadcast(sizes), "name").select("name", "value", "items", (F.col("distinct_values") > values).alias("limited"))
