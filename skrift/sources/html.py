"""Pages as rows of elements: main text by density, anchors; sitemaps."""

import gzip
from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..tables import written
from .elements import HEADINGS, elements, inside, strings

#: Elements whose text is not the page's own, the most of a block's words that may be links, and the least words about a block of main text.
SKIP = ("nav", "footer", "header", "aside", "noscript", "form", "svg")
MOST_LINKED, LEAST_WORDS = 1 / 3, 10


def blocks(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """(keys, block, text, words, linked, skipped, heads, title) of pages (keys, html): blocks of text in order.

    words are those outside links, linked those inside; skipped blocks stand in
    an element whose text is not the page's own; title blocks are the page's title.
    """
    rows = elements(pages.select(*keys, html), html)
    for outer, name in ((F.col("tag") == "a", "in_link"), (F.col("tag").isin(*SKIP), "skipped"), (F.col("tag").isin(*HEADINGS), "heads"), (F.col("tag") == "title", "title")):
        rows = inside(rows, keys, outer, name)
    text = lambda only: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(only, F.struct("start", "text")))), lambda s: s["text"]), "")
    both = rows.where("tag = '#text'").groupBy(*keys, "block").agg(text(F.lit(True)).alias("text"), text(F.col("in_link")).alias("links"), *[F.max(c).alias(c) for c in ("skipped", "heads", "title")])
    count = lambda c: F.regexp_count(F.col(c), F.lit(r"(?U)\S+"))
    own = both.select(*keys, "block", T.clean(F.col("text")).alias("text"), (count("text") - count("links")).alias("words"), count("links").alias("linked"), "skipped", "heads", "title")
    return own.where("text <> ''")


def main_blocks(blocks: DataFrame, keys: list[str], linked: float = MOST_LINKED, least: int = LEAST_WORDS) -> DataFrame:
    """blocks with `main`: few of a block's words are links, and the words of it and its neighbours (a quarter, a half, a quarter) are many.

    A heading is main where the block after it is: it is short, but what follows is not.
    """
    order = Window.partitionBy(*keys).orderBy("block")
    own = blocks.where("NOT title").withColumn("plain", F.when(F.col("skipped"), 0).otherwise(F.col("words")))
    near = lambda f: F.coalesce(f("plain").over(order), F.lit(0))
    smooth = near(F.lag) + 2 * F.col("plain") + near(F.lead)
    dense = ~F.col("skipped") & (F.col("linked") <= linked * (F.col("words") + F.col("linked"))) & (smooth >= 4 * least)
    own = own.withColumn("dense", dense)
    return own.withColumn("main", F.col("dense") | (F.col("heads") & ~F.col("skipped") & F.coalesce(F.lead("dense").over(order), F.lit(False)))).drop("plain", "dense")


def main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with title and text: the lines of the main blocks. A page without any has empty ones."""
    rows = keyed(pages, html)
    own = written(blocks(rows.select("__page", html), ["__page"], html), "blocks")
    title = own.where("title").groupBy("__page").agg(F.min_by("text", "block").alias("__title"))
    lines = main_blocks(own, ["__page"]).where("main").groupBy("__page").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("__lines"))
    both = rows.drop(html).join(title, "__page", "left").join(lines, "__page", "left")
    text = F.coalesce(F.array_join(F.transform("__lines", lambda x: x["text"]), "\n"), F.lit(""))
    return both.select(*[c for c in pages.columns if c != html], F.coalesce("__title", F.lit("")).alias("title"), text.alias("text"))


def keyed(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages, written once, with a number of their own: urls and ids may be null or repeated."""
    return written(pages.withColumn("__page", F.monotonically_increasing_id()), "pages")


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, href, label): a row a link of each page, as it stands."""
    rows = elements(keyed(pages.select(F.col(url).alias("url"), F.col(html).alias("html"))))
    return strings(rows, ["__page", "url"], (F.col("tag") == "a") & F.col("href").isNotNull()).select("url", "href", T.clean(F.array_join("strings", "")).alias("label"))


def anchors(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, labels): absolute links without fragment, and the set of their labels."""

    @F.pandas_udf("string")
    def absolute(base: pd.Series, href: pd.Series) -> pd.Series:
        return pd.Series([urldefrag(urljoin(b or "", h))[0] for b, h in zip(base, href)])

    found = links(pages, url, html).select(absolute("url", "href").alias("url"), "label")
    return found.groupBy("url").agg(F.array_sort(F.collect_set(F.nullif(F.col("label"), F.lit("")))).alias("labels"))


SITEMAP = "url array<struct<loc:string,lastmod:string>>, sitemap array<struct<loc:string>>"


def sitemaps(saved: DataFrame) -> DataFrame:
    """saved files (url, content) with `map`, their sitemap by schema: url entries, or the sitemaps of an index; null where there is none.

    Bytes are repaired first: gzip, a byte order mark, junk before the document.
    """

    @F.pandas_udf("string")
    def repaired(col: pd.Series) -> pd.Series:
        def one(content):
            if content is None:
                return None
            try:
                content = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
            except (OSError, EOFError):
                return None
            text = content.decode("utf-8-sig", errors="replace")
            start = text.find("<?xml")
            return text[max(start if start >= 0 else text.find("<"), 0) :]

        return col.map(one)

    text = repaired(F.col("content"))
    return saved.select("url", F.from_xml(text, F.lit(SITEMAP), {"ignoreNamespace": "true", "mode": "PERMISSIVE"}).alias("map"))


def site_urls(saved: DataFrame, sites: DataFrame) -> DataFrame:
    """(party, url, lastmod) of each site (party, sitemap) from saved files (url, content): its sitemap's entries, or those of the children that an index names.

    One step down at most; of several entries of a URL the last counts, children
    in the order of their index. Files that were not saved or cannot be read are
    left out.
    """
    own = written(sitemaps(saved), "sitemaps")
    top = sites.select("party", F.col("sitemap").alias("url")).join(own, "url").select("party", "map")
    children = top.select("party", F.posexplode("map.sitemap").alias("child", "s")).select("party", "child", F.trim("s.loc").alias("url"))
    found = top.where("map.sitemap IS NULL").select("party", F.lit(0).alias("child"), "map").unionByName(children.join(own, "url").select("party", "child", "map"))
    urls = found.select("party", "child", F.posexplode("map.url").alias("at", "u")).select("party", "child", "at", F.trim("u.loc").alias("url"), F.nullif(F.left(F.trim("u.lastmod"), F.lit(10)), F.lit("")).alias("lastmod"))
    return urls.where("url <> ''").groupBy("party", "url").agg(F.max_by("lastmod", F.struct("child", "at")).alias("lastmod"))


def child_sitemaps(saved: DataFrame) -> DataFrame:
    """(url) of the sitemaps that saved files (url, content) name."""
    return sitemaps(saved).select(F.explode("map.sitemap").alias("s")).select(F.trim("s.loc").alias("url")).distinct()


def discovered(sitemap: DataFrame, index: DataFrame, pattern: str | None = None, index_only: bool = False) -> DataFrame:
    """URLs of sitemap (url, lastmod) and index (url, labels), where each comes from, in one full outer join."""
    keep = (lambda d: d.where(F.col("url").rlike(pattern))) if pattern else (lambda d: d)
    left = keep(sitemap).withColumn("in_sitemap", F.lit("sitemap"))
    right = keep(index).withColumn("in_index", F.lit("index"))
    both = left.join(right, "url", "right" if index_only else "full_outer")
    return both.select("url", "lastmod", "labels", F.array_compact(F.array("in_sitemap", "in_index")).alias("sources"))


def topic_pages(urls: DataFrame, sites: DataFrame) -> DataFrame:
    """Rows of urls (party, url, ...) that are topic pages of their site: those its pattern in sites (party, topics) is found in. A site without a pattern has none."""
    return urls.join(sites.select("party", F.col("topics").alias("__topics")), "party").where(F.expr("regexp_like(url, __topics)")).drop("__topics")


def slugs(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with a unique slug: the first of a slug keeps it, others get their parent's name before it, then a number."""
    own = pages.withColumn("slug", T.slug(F.col(url)))
    parent = F.coalesce(F.get(F.split(F.regexp_replace(F.col(url), "/+$", ""), "/"), F.size(F.split(F.regexp_replace(F.col(url), "/+$", ""), "/")) - 2), F.lit(""))
    nth = F.row_number().over(Window.partitionBy("slug").orderBy(url))
    own = own.withColumn("slug", F.when(nth > 1, F.concat(parent, F.lit("__"), F.col("slug"))).otherwise(F.col("slug")))
    again = F.row_number().over(Window.partitionBy("slug").orderBy(url))
    return own.withColumn("slug", F.when(again > 1, F.concat(F.col("slug"), F.lit("__"), again.cast("string"))).otherwise(F.col("slug")))
