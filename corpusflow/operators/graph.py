"""Links: out of pages and lines of text, what they are for, where they lead, depth-limited crawls over a table of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, lexicon, text
from ..sources.scratch import saved

ANCHOR = r"""(?is)<a\b[^>]*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
DOWNLOADS = (".pdf", ".docx", ".doc", ".xlsx", ".xls")


def targets(html: Column) -> Column:
    """The href of each anchor, without quotes and entities for &, trimmed; empty ones left out."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(ANCHOR), F.lit(1))
    plain = F.transform(found, lambda h: F.trim(F.replace(F.regexp_replace(h, r"""^["']|["']$""", ""), F.lit("&amp;"), F.lit("&"))))
    return F.filter(plain, lambda h: h != "")


def absolute(base: Column, href: Column) -> Column:
    """href as seen from the page at base, without its fragment; dot segments are resolved."""
    clean = F.regexp_replace(href, "#.*$", "")
    scheme, origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1), F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    page = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.concat(origin, F.coalesce(F.nullif(F.regexp_extract(F.substr(page, F.length(origin) + 1), "^(.*/)", 1), F.lit("")), F.lit("/")))
    joined = (
        F.when(clean == "", F.regexp_replace(base, "#.*$", ""))
        .when(clean.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), clean)
        .when(clean.startswith("//"), F.concat(scheme, F.lit(":"), clean))
        .when(clean.startswith("/"), F.concat(origin, clean))
        .when(clean.startswith("?"), F.concat(page, clean))
        .otherwise(F.concat(folder, clean))
    )
    start, way, rest = (F.regexp_extract(joined, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)?([^?#]*)(.*)$", i) for i in (1, 2, 3))
    none = F.array().cast("array<string>")
    parts = F.aggregate(F.split(way, "/"), none, lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))).otherwise(F.concat(a, F.array(x))))
    dotted = (start != "") & way.rlike(r"(^|/)\.\.?(/|$)")
    return F.when(dotted, F.concat(start, F.array_join(parts, "/"), rest)).otherwise(joined)


def page_links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", excluded: list[str] = lexicon.EXCLUDED, same_host: bool = True) -> DataFrame:
    """(page_id, url): the distinct absolute targets of a page's anchors without fragments, those of excluded kinds and of other hosts left out."""
    rows = pages.select(F.col(id_col), F.col(url_col).alias("_base"), F.explode(F.array_distinct(targets(F.col(html_col)))).alias("_href"))
    rows = rows.select(id_col, "_base", absolute(F.col("_base"), F.col("_href")).alias("url")).where(~F.col("url").rlike("(?i)" + "|".join(excluded)))
    if same_host:
        rows = rows.where(text.host(F.col("url")) == text.host(F.col("_base")))
    return rows.select(id_col, "url").distinct()


def crawl(start: DataFrame, pages: DataFrame, depth: int = 2, excluded: list[str] = lexicon.EXCLUDED, downloads: tuple[str, ...] = DOWNLOADS) -> DataFrame:
    """(url, depth, kind) reached from start (url) over pages (url, html), each at its least depth.

    Links are followed on the page's own host up to `depth`; files to download are taken at any depth but not followed. Each level is
    saved, so the plan doesn't grow with depth. Pages that the table lacks are reached and lead nowhere.
    """
    is_file = lambda u: F.lower(text.path(u)).rlike("(" + "|".join(d.replace(".", r"\.") for d in downloads) + ")$")
    seen = saved(start.select("url").distinct().where(~F.col("url").rlike("(?i)" + "|".join(excluded))).select("url", F.lit(0).alias("depth"), F.when(is_file(F.col("url")), "file").otherwise("page").alias("kind")))
    front = seen
    for d in range(depth + 1):
        here = pages.join(front.where("kind = 'page'").select("url"), "url", "left_semi")
        found = page_links(here.withColumn("_id", F.col("url")), "_id").select("url").distinct().withColumn("kind", F.when(is_file(F.col("url")), "file").otherwise("page"))
        if d == depth:
            found = found.where("kind = 'file'")
        front = saved(found.join(seen.select("url"), "url", "left_anti").select("url", F.lit(d + 1).alias("depth"), "kind"))
        seen = seen.unionByName(front)
    return seen


def crawled_documents(pages: DataFrame, at: Column) -> DataFrame:
    """What a crawl saves of pages (url, html): name, digest, section and time."""
    u = F.col("url")
    return pages.select(u.alias("source_url"), F.concat(text.url_slug(u), F.lit(".html")).alias("filename"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("sha256"), F.lit("web_page").alias("source_type"), classify.section(u).alias("web_section"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("last_scraped"))


def line_links(texts: DataFrame, id_col: str, text_col: str, window: int = 1, most: int = 500) -> DataFrame:
    """(id, pos, at, url, context): each link on a line (at: its place among them), with the lines around, trimmed, in at most 500 characters."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), r"\r\n|[\n\r]")
    rows = texts.select(F.col(id_col).alias("id"), lines.alias("l")).select("id", "l", F.posexplode("l").alias("pos", "line"))
    around = F.slice("l", F.greatest(F.col("pos") + 1 - window, F.lit(1)), F.least(F.col("pos"), F.lit(window)) + window + 1)
    found = F.regexp_extract_all("line", F.lit(lexicon.LINE_LINK), F.lit(1))
    rows = rows.where(F.col("line").rlike(lexicon.LINE_LINK))
    context = F.substring(F.array_join(F.transform(around, text.strip), " "), 1, most)
    return rows.select("id", "pos", F.posexplode(F.transform(found, text.normalize_url)).alias("at", "url"), context.alias("context"))


def link_map(found: DataFrame, site: str = "portale", contexts: int = 5) -> DataFrame:
    """(url, domain, category, sources, contexts, frequency) of found (id, pos, at, url, context): every occurrence counts; the category
    is that of the first, whose place tells, as are the contexts the first five."""
    order = Window.partitionBy("url").orderBy("id", "pos", "at")
    first = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= contexts)
    said = first.groupBy("url").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "context"))), lambda x: x["context"]).alias("contexts"))
    counts = found.groupBy("url", "id").agg(F.count("*").alias("c")).groupBy("url").agg(F.sum("c").alias("frequency"), F.sort_array(F.collect_list("id")).alias("sources"))
    both = counts.join(said, "url")
    return both.select("url", text.host(F.col("url")).alias("domain"), classify.link_kind(F.col("url"), F.col("contexts")[0], site).alias("category"), "sources", "contexts", "frequency")


def by_frequency(links: DataFrame) -> DataFrame:
    return links.orderBy(F.desc("frequency"), "url")
