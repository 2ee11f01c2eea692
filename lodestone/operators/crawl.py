"""Breadth-first reading of a link graph that is at hand as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators.graph import cut


def crawl(pages: DataFrame, start: DataFrame, max_depth: int, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """(url, depth) of pages reached from ``start`` (url) over links of their own host, each at its least depth.

    ``pages`` has url and html. Links are normalised; a pattern to include or
    exclude is searched in them. Pages that aren't in the table end the way.
    """
    known = pages.select(text.normalised_url(F.col("url")).alias("url"), "html")
    links = known.select(F.col("url").alias("src"), F.explode(text.site_links(text.html_references(F.col("html")), F.col("url"))).alias("dst")).distinct()
    if include:
        links = links.where(F.col("dst").rlike(include))
    if exclude:
        links = links.where(~F.col("dst").rlike(exclude))
    frontier = start.select(text.normalised_url(F.col("url")).alias("url")).join(known, "url", "left_semi").distinct().withColumn("depth", F.lit(0))
    seen = frontier
    for depth in range(1, max_depth + 1):
        reached = frontier.join(links, frontier["url"] == links["src"]).select(F.col("dst").alias("url")).distinct()
        frontier = cut(reached.join(known, "url", "left_semi").join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.union(frontier)
    return seen
