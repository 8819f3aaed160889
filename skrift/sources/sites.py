"""Party sites: discovery of topic pages, polite resumable fetching, and extraction to the said layer.

The library makes no requests of its own: `get` (url to bytes, raising on
failure) is the caller's connector. Fetching is driver work by design, one site
after the other with a delay; what it saves is parsed as a table.
"""

import json
import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from . import html as H
from .motions import html_files

# Fixed value: where a cookie notice begins in the text of a page.
COOKIE_MARKER = "När du besöker en webbplats kan den lagra"


@dataclass(frozen=True)
class Site:
    code: str
    name: str
    topics: str  # pattern of a topic page's URL
    sitemap: str = ""
    index_urls: tuple[str, ...] = ()
    index_only: bool = False
    delay: float = 1.0
    robots_checked: str = ""


# The sites.
SITES = {
    s.code: s
    for s in (
        Site("V", "Vänsterpartiet", r"^https://www\.vansterpartiet\.se/var-politik/politik-a-o/[^/]+/?$", "https://www.vansterpartiet.se/page-sitemap.xml", ("https://www.vansterpartiet.se/var-politik/politik-a-o/",), robots_checked="2026-09-08"),
        Site("MP", "Miljöpartiet de gröna", r"^https://www\.mp\.se/politik/[^/]+/?$", "https://www.mp.se/sitemap.xml", ("https://www.mp.se/politik/",), robots_checked="2026-09-08"),
        Site("S", "Socialdemokraterna", r"^https://www\.socialdemokraterna\.se/var-politik/a-till-o/[^/]+/?$", "https://www.socialdemokraterna.se/rest-api/sitemapXml", robots_checked="2026-09-08"),
        Site("C", "Centerpartiet", r"^https://www\.centerpartiet\.se/centerpartiets-politik/centerpartiets-politik-a-o/[^/]+(/[^/]+)?/?$", "https://www.centerpartiet.se/sitemapindex.xml", ("https://www.centerpartiet.se/centerpartiets-politik/centerpartiets-politik-a-o",), robots_checked="2026-09-08"),
        Site("SD", "Sverigedemokraterna", r"^https://www\.sd\.se/a-till-o/[^/]+/?$", "https://www.sd.se/sitemap_index.xml", delay=10.0, robots_checked="2026-09-08"),
        Site("M", "Moderaterna", r"^https://moderaterna\.se/var-politik/[^/]+/?$", "https://moderaterna.se/sitemap_index.xml", ("https://moderaterna.se/var-politik/",), robots_checked="2026-09-09"),
        Site("KD", "Kristdemokraterna", r"^https://kristdemokraterna\.se/var-politik/politik-a-till-o/[^/]+/?$", "", ("https://kristdemokraterna.se/var-politik/politik-a-till-o",), robots_checked="2026-09-09"),
        Site("L", "Liberalerna", r"^https://www\.liberalerna\.se/politik/[^/]+/?$", "https://www.liberalerna.se/sitemap_index.xml", ("https://www.liberalerna.se/politik/",), robots_checked="2026-09-09"),
    )
}
PAGES = "party string, name string, fetched string, robots_checked string, crawl_delay double, index_only boolean, pages array<struct<slug:string,url:string,file:string,lastmod:string,sources:array<string>,labels:array<string>>>"

Get = Callable[[str], bytes]


def codes(argument: str) -> list[str]:
    """The sites an argument names: all, or one that exists."""
    if argument == "all":
        return list(SITES)
    if argument not in SITES:
        raise ValueError(f"unknown party {argument!r}; known: {', '.join(SITES)} (or 'all')")
    return [argument]


def saved(spark: SparkSession, urls, get: Get, delay: float, wait: Callable[[float], None]) -> DataFrame:
    """(url, content) of a few files, after a wait each; what cannot be had is left out."""
    rows = []
    for url in urls:
        wait(delay)
        try:
            rows.append((url, bytearray(get(url))))
        except Exception:  # noqa: BLE001 - a site without its sitemap still has its index
            continue
    return spark.createDataFrame(rows, "url string, content binary")


def sitemap_urls(spark: SparkSession, site: Site, get: Get, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """(url, lastmod) of a site's sitemap, or of the children that it names: a frontier of one step."""
    top = saved(spark, [site.sitemap] if site.sitemap else [], get, 0, lambda _: None)
    children = [r["url"] for r in H.child_sitemaps(top).orderBy("url").collect()]
    both = top.unionByName(saved(spark, children, get, site.delay, wait))
    return H.site_urls(both, spark.createDataFrame([(site.code, site.sitemap)], "party string, sitemap string")).select("url", "lastmod")


def discover(spark: SparkSession, site: Site, get: Get, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """(url, lastmod, labels, sources) of the site's topic pages, in order of URL."""
    pages = saved(spark, site.index_urls, get, site.delay, wait).select("url", F.decode("content", "utf-8").alias("html"))
    found = H.discovered(sitemap_urls(spark, site, get, wait), H.anchors(pages), site.topics, bool(site.index_urls and site.index_only))
    return found.withColumn("labels", F.coalesce("labels", F.array().cast("array<string>"))).orderBy("url")


def fetch(spark: SparkSession, site: Site, folder: str, get: Get, wait: Callable[[float], None] = time.sleep) -> dict:
    """Saves pages as they are, and their list as index.json; pages that are there are not fetched again, failed ones are left out."""
    own = Path(folder) / site.code
    own.mkdir(parents=True, exist_ok=True)
    done = []
    for page in H.slugs(discover(spark, site, get, wait)).orderBy("url").collect():
        path = own / f"{page.slug}.html"
        if not path.exists():
            wait(site.delay)
            try:
                path.write_bytes(get(page.url))
            except Exception:  # noqa: BLE001
                continue
        done.append({"slug": page.slug, "url": page.url, "file": path.name, "lastmod": page.lastmod, "sources": page.sources, "labels": page.labels})
    index = {"party": site.code, "name": site.name, "fetched": date.today().isoformat(), "robots_checked": site.robots_checked, "crawl_delay": site.delay, "index_only": bool(site.index_urls and site.index_only), "pages": done}
    (own / "index.json").write_text(json.dumps(index, ensure_ascii=False, indent=1), encoding="utf-8")
    return index


def page_list(spark: SparkSession, folder: str, party: str) -> DataFrame:
    """(party, name, fetched, slug, url, file, lastmod, sources, labels) of a saved index.json."""
    own = spark.read.schema(PAGES).option("multiLine", True).json(f"{folder}/{party}/index.json")
    return own.select("party", "name", "fetched", F.explode("pages").alias("p")).select("party", "name", "fetched", "p.*")


def heading_of(title, slug):
    """The page's title, or its slug in words with a capital."""
    words = F.lower(F.replace(slug, F.lit("-"), F.lit(" ")))
    return F.coalesce(F.nullif(title, F.lit("")), F.concat(F.upper(F.left(words, F.lit(1))), F.substring(words, 2, 10_000)))


def said_records(pages: DataFrame, least: int = K.MIN_TEXT_CHARS) -> DataFrame:
    """The said layer of pages (page list and html): main text up to a cookie notice; short ones go."""
    own = H.main_text(pages).withColumn("text", T.before_marker(F.col("text"), COOKIE_MARKER)).where(F.length("text") >= least)
    sources, labels = (F.coalesce(c, F.array().cast("array<string>")) for c in ("sources", "labels"))
    aliases = F.when(F.size(labels) > 0, F.concat(F.lit("("), F.array_join(labels, "; "), F.lit(")\n"))).otherwise("")
    heading = heading_of(F.col("title"), F.col("slug"))
    return own.select(
        F.concat("party", F.lit(":said:"), "slug").alias("chunk_id"), F.lit("said").alias("layer"), F.col("party").alias("parti"), F.col("name").alias("parti_namn"),
        F.col("slug").alias("sakfraga"), heading.alias("heading"), labels.alias("labels"), "text", F.concat(heading, F.lit("\n"), aliases, "text").alias("text_for_embedding"),
        "url", F.col("fetched").alias("hamtad"), "lastmod", sources.alias("sources"), F.array_contains(sources, "index").alias("in_index"), T.content_hash(F.col("text")).alias("content_hash"),
    )


def length_stats(records: DataFrame) -> DataFrame:
    """(parti, n, median, p90, largest) of text lengths, by place in order: n // 2 and n * 9 // 10, as counted from 0.

    Places are found among the counts of each length, so no group's texts are gathered.
    """
    own = records.select("parti", F.length("text").alias("l")).groupBy("parti", "l").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("parti").orderBy(F.asc_nulls_first("l")))
    own = own.withColumn("upto", upto).withColumn("n", F.sum("c").over(Window.partitionBy("parti")))
    at = lambda place: F.min(F.when(F.col("upto") > F.floor(place), F.col("l")))
    return own.groupBy("parti", "n").agg(at(F.col("n") / 2).alias("median"), at(F.col("n") * 9 / 10).alias("p90"), F.max("l").alias("largest"))


def extract(spark: SparkSession, folder: str, party: str, path: str) -> DataFrame:
    """Writes a party's said layer, over an older one, from its saved pages; returns its length figures."""
    raw = html_files(spark, f"{folder}/{party}").select(F.element_at(F.split("file", "/"), -1).alias("file"), "html")
    said_records(page_list(spark, folder, party).join(raw, "file")).write.mode("overwrite").json(path)
    return length_stats(spark.read.schema("parti string, text string").json(path))
