"""Line dedup: boilerplate by a line's frequency within its site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarazu.llm.common import materialise, unused


def boilerplate_lines(docs: DataFrame, site_col: str = "source", text_col: str = "text", max_ratio: float = 0.1, min_pages: int = 5) -> DataFrame:
    """(site, pages, lines): for each site with boilerplate its page count and the hashes of its boilerplate lines.

    A line (without the spaces around it, not blank; tabs and \\r count) is boilerplate on a site if at least `min_pages` pages and over `max_ratio` of
    the site's pages hold it; a page counts once. A site can have no more such lines than a page has lines on
    average over max_ratio, so each array is bounded whatever the size of the site. Only hashes are shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.array_distinct(F.transform(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.xxhash64(x)))
    d = docs.select(F.col(site_col).alias("site"), lines.alias("lines"))
    pages = d.groupBy("site").agg(F.count("*").alias("pages"))
    held = d.select("site", F.explode("lines").alias("line")).groupBy("site", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    bad = held.join(pages, held.site.eqNullSafe(pages.site)).where(F.col("n") > max_ratio * F.col("pages"))
    return bad.groupBy(held.site).agg(F.max("pages").alias("pages"), F.sort_array(F.collect_list("line")).alias("lines"))


def drop_boilerplate(docs: DataFrame, site_col: str = "source", text_col: str = "text", max_ratio: float = 0.1, min_pages: int = 5) -> DataFrame:
    """docs with boilerplate lines dropped from the text, and n_lines and n_dropped added (equal names are replaced).

    A null site is a site of its own. Null text: stays null, no lines. Blank lines are never boilerplate. A text of
    boilerplate alone becomes empty. A very long text is one array of its lines. Repeated rows are pages like others. An empty table stays empty. Texts move only
    if the sites' arrays are too large to broadcast (Spark decides by their size); a hot site is then a skewed join
    side that AQE splits.
    """
    bad, _ = materialise(boilerplate_lines(docs, site_col, text_col, max_ratio, min_pages), "boilerplate")  # so that its size is known to the join
    site, gone, all_lines, hit, kept = unused(docs, "site", "bad", "lines", "hit", "kept")
    bad = bad.select(F.col("site").alias(site), F.col("lines").alias(gone))
    d = docs.join(bad, docs[site_col].eqNullSafe(F.col(site)), "left")
    d = d.withColumn(all_lines, F.split(F.col(text_col), "\n", -1))
    # one hashed look-up for all lines; then lines are held only against those of the document itself that go
    d = d.withColumn(hit, F.array_intersect(F.transform(all_lines, lambda x: F.xxhash64(F.trim(x))), gone))
    left = F.filter(all_lines, lambda x: ~F.coalesce(F.array_contains(hit, F.xxhash64(F.trim(x))), F.lit(False)) | (F.trim(x) == ""))
    d = d.withColumn(kept, F.when(F.size(hit) > 0, left).otherwise(F.col(all_lines)))
    out = d.withColumn(text_col, F.array_join(kept, "\n"))
    n = F.when(F.col(all_lines).isNull(), 0).otherwise(F.size(all_lines)).cast("long")
    left = F.when(F.col(kept).isNull(), 0).otherwise(F.size(kept)).cast("long")
    return out.withColumn("n_lines", n).withColumn("n_dropped", n - left).drop(site, gone, all_lines, hit, kept)
