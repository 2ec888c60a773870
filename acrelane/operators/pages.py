"""Bid pages: links, scores, the best page of a site, and reach from a home page over stored pages."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acrelane.functions.text import page_text
from acrelane.shared import written

#: Words that speak for a page of grain bids, crops, the crops that count once more, and how prices are written.  Fixed values.
BID_WORDS = (
    "cash bid", "cash price", "cash grain", "grain bid", "grain price",
    "new crop", "new crop bid", "new crop price",
    "corn bid", "corn price", "corn cash",
    "milo bid", "milo price", "milo cash", "sorghum bid", "sorghum price",
    "wheat bid", "wheat price", "wheat cash",
    "grain prices", "commodity prices", "bid sheet", "price sheet",
    "daily bid", "daily price", "market price",
)
CROP_WORDS = ("corn", "milo", "sorghum", "wheat", "grain")
NAMED_CROPS = ("corn", "milo", "sorghum", "wheat")
PRICES = (r"\$\d+\.?\d*", r"\d+\.?\d*\s*/\s*(bu|bushel|cwt|ton)", r"\d+\.?\d*\s*per\s*(bushel|bu|cwt|ton)")
#: An anchor's address, in double or single quotes or in none.
HREF = r"""(?is)<a\b[^>]*?\shref\s*=\s*(["']?)((?<=")[^"]*|(?<=')[^']*|(?<=[=\s])[^\s"'>]+)"""
#: Links that are not followed.  Fixed values.
SKIP = r"(?i)\.(pdf|doc|docx|xls|xlsx|zip|jpg|jpeg|png|gif|css|js)$|#|mailto:|tel:|javascript:"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1))


def bare_url(url: Column) -> Column:
    """Without fragment."""
    return F.regexp_replace(url, "#.*$", "")


def resolve(base: Column, href: Column) -> Column:
    """An absolute URL for a link on a page."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    path = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", "")
    folder = F.regexp_replace(path, r"[^/]*$", "")
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(root, path, href))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), href))
    )


def page_links(pages: DataFrame, limit: int = 20) -> DataFrame:
    """(page_id, src_url, pos, dst_url): the first anchors of each page that lead to pages of the same host, in order; links with a fragment are not followed."""
    hrefs = F.slice(F.regexp_extract_all("html", F.lit(HREF), F.lit(2)), 1, limit)
    rows = pages.select("page_id", F.col("url").alias("src_url"), F.posexplode(hrefs).alias("pos", "href"))
    rows = rows.filter("href <> ''").withColumn("dst_url", resolve(F.col("src_url"), F.trim("href")))
    return rows.filter(~F.col("dst_url").rlike(SKIP)).filter(host(F.col("dst_url")) == host(F.col("src_url"))).select("page_id", "src_url", "pos", "dst_url")


def score_pages(pages: DataFrame, bid_words: Sequence[str] = BID_WORDS, crop_words: Sequence[str] = CROP_WORDS, least: int = 15) -> DataFrame:
    """(page_id, url, site, score, bid_found, crop_found) of pages with at least the given score.

    10 for each bid word and 5 for each crop word in the text; 20 for cash bid or cash price, 15 for new crop, 10 for a named crop, 5 for a table,
    10 for a price like $4.56, 4.56/bu or 4.56 per bushel.
    """
    def judged(text: Column) -> Column:
        def found(words):
            return F.filter(F.array(*map(F.lit, words)).cast("array<string>"), lambda w: F.contains(text, w))

        def has(*words: str) -> Column:
            return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])

        bids, crops = found(bid_words), found(crop_words)
        bonus = [(has("cash bid", "cash price"), 20), (has("new crop"), 15), (has(*NAMED_CROPS), 10), (text.rlike("|".join(PRICES)), 10)]
        return F.struct(bids.alias("bid_found"), crops.alias("crop_found"), reduce(lambda a, b: a + b, [F.size(bids) * 10, F.size(crops) * 5, *[F.when(c, n).otherwise(0) for c, n in bonus]]).alias("score"))

    # the text is taken out of the page once: the optimizer does not copy it through explode
    rows = pages.select("page_id", "url", F.when(F.lower("html").contains("<table"), 5).otherwise(0).alias("_table"), F.explode(F.transform(F.array(F.lower(page_text(F.col("html")))), judged)).alias("_x"))
    rows = rows.withColumn("score", F.col("_x.score") + F.col("_table")).filter(F.col("score") >= least)
    return rows.select("page_id", "url", host(F.col("url")).alias("site"), "score", "_x.bid_found", "_x.crop_found")


def best_page(scored: DataFrame, order: str = "page_id", least: int = 15) -> DataFrame:
    """The highest-scoring page of each site; of equal ones the first found."""
    w = Window.partitionBy("site").orderBy(F.desc("score"), order)
    return scored.filter(F.col("score") >= least).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def site_reach(pages: DataFrame, links: DataFrame, homes: DataFrame | None = None, max_pages: int = 50, found: DataFrame | Callable[[DataFrame], DataFrame] | None = None, enough: int = 10) -> DataFrame:
    """(site, page_id, level, rank) of the first max_pages pages of each site in breadth-first order from its home page.

    homes: (site, page_id); by default the lowest page id of each host.  Links to pages that are not stored are dropped.  A page's place is that
    of the earliest link to it.  Every level is written, so lineage stays short; sites stop at the cap, which is the feature.  found: (page_id) of pages
    that are looked for, or a function that gives those among the pages (page_id) of a level, so that only pages that are reached need be judged;
    links are followed only from pages up to which fewer than enough of them were met, the page itself included.
    """
    stored = pages.select("page_id", bare_url(F.col("url")).alias("_url"), host(F.col("url")).alias("site"))
    ids = stored.groupBy("_url").agg(F.min("page_id").alias("dst"), F.min("site").alias("_site"))
    arcs = written(links.join(ids, F.col("dst_url") == F.col("_url")).groupBy(F.col("page_id").alias("src"), "dst").agg(F.min("pos").alias("pos"), F.min("_site").alias("_site")), "arcs")
    start = homes if homes is not None else stored.groupBy("site").agg(F.min("page_id").alias("page_id"))
    good = F.lit(0).cast("int").alias("good")

    def marked(rows: DataFrame) -> DataFrame:
        if found is None:
            return rows.select("*", good)
        level = written(rows, "level")
        hits = found(level.select("page_id").distinct()) if callable(found) else found
        return level.join(hits.select("page_id", F.lit(1).alias("_good")).distinct(), "page_id", "left").withColumn("good", F.coalesce("_good", F.lit(0))).drop("_good")

    seen = written(marked(start.select("site", "page_id", F.lit(0).alias("level"), F.lit(1).alias("rank"))), "reach")
    so_far = F.sum("good").over(Window.partitionBy("site").orderBy("rank"))  # over max_pages rows at most
    for level in range(1, max_pages + 1):
        front = seen.withColumn("_met", so_far).filter((F.col("level") == level - 1) & (F.col("_met") < enough))
        met = front.select("site", F.col("page_id").alias("src"), "rank").join(arcs, "src").filter("site = _site")
        new = met.groupBy("site", F.col("dst").alias("page_id")).agg(F.min(F.struct("rank", "pos", "dst")).alias("o")).join(seen.select("site", "page_id"), ["site", "page_id"], "left_anti")
        sizes = seen.groupBy("site").agg(F.max("rank").alias("_n"))
        w = Window.partitionBy("site").orderBy("o")
        fresh = new.withColumn("_k", F.row_number().over(w)).join(sizes, "site").withColumn("rank", F.col("_k") + F.col("_n")).filter(F.col("rank") <= max_pages)
        fresh = written(marked(fresh.select("site", "page_id", F.lit(level).alias("level"), F.col("rank").cast("int").alias("rank"))), "front")
        if fresh.isEmpty():
            break
        seen = written(seen.unionByName(fresh), "reach")
    return seen.select("site", "page_id", "level", "rank")
