"""Sitemap documents → location rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sitemap_locs(bodies: DataFrame) -> DataFrame:
    """Locations of every document ``(doc_url, body)`` in document order, each once; documents
    stay in their row."""
    body = F.col("body")
    found = F.regexp_extract_all(body, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))
    locs = F.array_distinct(F.filter(found, lambda loc: loc.rlike(r"(?i)^https?://")))
    return bodies.select(
        "doc_url", F.lower(body).contains("<sitemapindex").alias("is_index"),
        F.posexplode(locs).alias("pos", "loc"),
    )
