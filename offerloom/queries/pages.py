"""Stored pages: elements, headings, challenge pages, slugs, sitemaps, feeds."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.functions.codes import first_candidate_token
from offerloom.functions.stores import host_of, slug_to_name
from offerloom.functions.text import present, trim_all
from offerloom.operators.containers import page_elements
from offerloom.operators.dedupe import first_rows
from offerloom.operators.extract import extract_page_offers, split_blocked_pages
from offerloom.operators.slugs import (
    crawl_frontier,
    discover_slugs,
    first_nonempty,
    paged_frontier,
    slug_in,
)
from offerloom.fixed import FALLBACK_SLUGS
from offerloom.queries.common import SQL_HOST, dealt, quoted, sql_candidate, sql_trim, table
from offerloom.session import work_path
from offerloom.sources.pages import read_captures, read_feed, select_sources, sitemap_locs, write_captures
from offerloom.sources.profiles import PAGES, Discovery, PageProfile, Selector

WEB = {
    "web": PageProfile(
        card=Selector(tags=("article", "li")),
        blocked=(" of ", "&"),
        blocked_reason="marked",
    )
}


def web_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        F.lit("web").alias("source"), F.col("page_id").cast("string").alias("url"), F.col("url").alias("slug"), "html"
    )


def container_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First passing token of every article and list item, first row per page and code."""
    cards = page_elements(web_captures(spark, sf_dir), WEB).filter(F.col("kind") == "card")
    found = cards.select(
        "source", "url", "pos", present(first_candidate_token(F.col("text"))).alias("code"),
        F.left(trim_all(F.col("description")), F.lit(200)).alias("description"),
    )
    return first_rows(found, ["source", "url", "code"], [F.col("pos")]).select("url", "code", "description")


_UNESCAPE = "replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"


def _bare(html: str) -> str:
    return _UNESCAPE.format(f"regexp_replace({html}, '<[^>]+>', '', 'g')")


CONTAINER_TOKENS = rf"""
WITH c AS (
  SELECT page_id, 0 AS rank, unnest(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1)) AS body, '' AS note FROM pages
  UNION ALL
  SELECT page_id, 1, regexp_extract(html, '(?s)<article>(.*?)</article>', 1),
         regexp_extract(html, '(?s)<article>.*?<p>(.*?)(?:<p>|</p>|</article>)', 1) FROM pages),
 t AS (SELECT page_id, rank, note, list_filter(regexp_extract_all({_bare('body')}, '\b([A-Z0-9]{{3,20}})\b', 1),
       lambda x: {sql_candidate('x')} AND NOT regexp_matches(x, '^20\d{{2}}$'))[1] AS code FROM c)
SELECT CAST(page_id AS VARCHAR) AS url, code, arg_min(substr({sql_trim(_bare('note'))}, 1, 200), rank) AS description
FROM t WHERE code IS NOT NULL GROUP BY page_id, code
"""


def page_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = page_elements(web_captures(spark, sf_dir), WEB).filter(F.col("kind") == "page")
    fallback = slug_to_name(slug_in(F.col("slug"), r"/([^/?#]+)\z"))
    return pages.select("url", F.coalesce(trim_all(F.col("heading")), fallback).alias("heading"))


PAGE_HEADINGS = f"""
SELECT CAST(page_id AS VARCHAR) AS url, {sql_trim(_bare("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"))} AS heading FROM pages
"""


def blocked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    readable, errors = split_blocked_pages(web_captures(spark, sf_dir), WEB)
    ok = readable.select(F.lit("ok").alias("state"), F.col("slug").alias("page"))
    return ok.unionByName(errors.select(F.lit("blocked").alias("state"), F.col("error").alias("page")))


_TITLE = _bare("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")
BLOCKED_PAGES = f"""
WITH t AS (SELECT url, trim(regexp_replace({_TITLE}, '\\s+', ' ', 'g')) AS title FROM pages)
SELECT CASE WHEN contains(title, ' of ') OR contains(title, '&') THEN 'blocked' ELSE 'ok' END AS state,
       CASE WHEN contains(title, ' of ') OR contains(title, '&') THEN url || ': marked' ELSE url END AS page FROM t
"""

# -- offers on built pages ----------------------------------------------------------------------


def _code() -> Column:
    return F.concat(F.upper(F.replace("p_name", F.lit(" "), F.lit(""))), "p_size")


def built_captures(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """A page per part with one offer of each form the sources use."""
    name, size = F.col("p_name"), F.col("p_size").cast("string")
    html = F.concat(
        F.lit("<html><head><title>Codes</title></head><body><h1> "), name, F.lit(" discount codes</h1>"),
        F.lit("<div class='deal-card'><p>"), size, F.lit("% off "), name, F.lit("<p>more<button data-code='"), _code(),
        F.lit("'>Get</button></div>"),
        F.lit("<div class='offer'><span class='descr'>£"), size, F.lit(" off</span> use <b>PART"), F.col("p_partkey").cast("string"),
        F.lit("</b></div>"),
        F.lit("<ul><li>Free delivery<a href='#'>SHIP"), size, F.lit("</a><li class='coupon'><div class='title'>Buy 2 get 1</div><a> "),
        _code(), F.lit("</a></ul>"),
        F.lit("<section><p>Extra</p><button><div class='x-code-btn'>Get Code</div><span>hid</span><span> s"), size,
        F.lit("x</span></button></section></body></html>"),
    )
    slug = F.replace(name, F.lit(" "), F.lit("-"))
    parts = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"))
    return parts.select(
        F.lit(source).alias("source"), F.concat(F.lit("https://p/"), "p_partkey").alias("url"), slug.alias("slug"), html.alias("html")
    )


def faulty_captures(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """The built pages, of which one in fifty cannot be parsed and one in fifty was not delivered."""
    part = F.regexp_extract("url", "([0-9]+)$", 1).cast("long")
    html = F.when(part % 50 == 0, F.concat(F.lit("<![part["), part, F.lit("]]>"), "html")).otherwise(F.col("html"))
    return built_captures(spark, sf_dir, source).withColumns({"html": html, "status": F.when(part % 50 == 1, 503)})


def _page_offers(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    offers, _ = extract_page_offers(built_captures(spark, sf_dir, source))
    return offers.select("url", "code", "store_name", "store_domain", "description", "type")


def attribute_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_offers(spark, sf_dir, "myvouchercodes")


def button_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_offers(spark, sf_dir, "coupert")


def sibling_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_offers(spark, sf_dir, "vouchercodes")


_BUILT = """
WITH p AS (SELECT 'https://p/' || p_partkey AS url, p_partkey, p_size, p_name, upper(replace(p_name, ' ', '')) || p_size AS code,
                  replace(p_name, ' ', '-') AS slug FROM part)
"""
ATTRIBUTE_OFFERS = _BUILT + """
SELECT url, code, p_name AS store_name, slug || '.co.uk' AS store_domain, p_size || '% off ' || p_name AS description, 'percentage' AS type FROM p
UNION ALL SELECT url, 'PART' || p_partkey, p_name, slug || '.co.uk', '£' || p_size || ' off', 'fixed' FROM p
"""
BUTTON_OFFERS = _BUILT + """
SELECT url, code, p_name || ' discount codes' AS store_name, replace(slug, '-', '') || '.co.uk' AS store_domain,
       p_size || '% off ' || p_name AS description, 'percentage' AS type FROM p
UNION ALL SELECT url, 'SHIP' || p_size, p_name || ' discount codes', replace(slug, '-', '') || '.co.uk', '', 'unknown' FROM p
"""
SIBLING_OFFERS = _BUILT + """
SELECT url, 's' || p_size || 'x' AS code, p_name || ' discount codes' AS store_name, slug || '.co.uk' AS store_domain,
       'Extra' AS description, 'unknown' AS type FROM p
"""

def stored_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of each supplier on each of the nine page sources, through the capture table; one in five has no heading."""
    key = F.col("s_suppkey").cast("string")
    heading = F.when(F.col("s_suppkey") % 5 > 0, F.concat(F.lit("<h1>Shop "), key, F.lit(" voucher code</h1>"))).otherwise(F.lit(""))
    html = F.concat(
        F.lit("<html><head><title>Codes</title></head><body>"), heading,
        F.lit("<article class='deal'><p>"), key, F.lit("% off shoes at Nike</p> with <b>WIN"), key, F.lit("X</b> </article>"),
        F.lit("<div class='coupon offer' data-code='ATTR"), key, F.lit("'><h4 class='title'>£"), key, F.lit(" off at asos</h4></div>"),
        F.lit("<section><p>Extra</p><button><div class='code-btn'>Get Code</div><span>hid</span><span>S"), key,
        F.lit("B</span></button></section><table><tr><td><p>Buy 2 get 1 at Argos</p> <i>ROW"), key, F.lit("Z</i> </td></tr></table></body></html>"),
    )
    pages = dealt(table(spark, sf_dir, "supplier").select("s_suppkey")).select(
        F.explode(F.array(*(F.lit(source) for source in PAGES))).alias("source"), F.concat(F.lit("https://c/"), key).alias("url"),
        F.concat(F.lit("shop-"), key, F.lit("-discount-codes")).alias("slug"), html.alias("html"),
    )
    path = work_path(spark, "captures")
    write_captures(pages, path)
    parts = [extract_page_offers(read_captures(spark, path, [source]))[0] for source in PAGES]
    return functools.reduce(DataFrame.unionByName, parts).select("source", "url", "code", "store_name", "store_domain", "description", "type")


STORED_CAPTURES = """
WITH s AS (SELECT CAST(s_suppkey AS VARCHAR) AS k, s_suppkey % 5 > 0 AS headed FROM supplier),
     o AS (SELECT unnest(['codesuk', 'coupert', 'myvouchercodes', 'netvouchercodes', 'savoo', 'voucherbox']) AS source, 'ATTR' AS head, '' AS tail,
                  '£' AS lead, ' off at asos' AS words, 'fixed' AS type
           UNION ALL SELECT unnest(['codesuk', 'myvouchercodes', 'netvouchercodes', 'savoo', 'voucherbox', 'latestdeals', 'moneysavingexpert']),
                            'WIN', 'X', '', '% off shoes at Nike', 'percentage'
           UNION ALL SELECT 'vouchercodes', 'S', 'B', NULL, 'Extra', 'unknown'
           UNION ALL SELECT 'moneysavingexpert', 'ROW', 'Z', NULL, 'Buy 2 get 1 at Argos', 'bogo')
SELECT source, 'https://c/' || k AS url, head || k || tail AS code,
       CASE WHEN source IN ('latestdeals', 'moneysavingexpert') THEN CASE head WHEN 'ROW' THEN 'Argos' ELSE 'Nike' END
            WHEN source = 'myvouchercodes' THEN CASE WHEN headed THEN 'Shop ' ELSE 'shop ' END || k
            WHEN headed THEN 'Shop ' || k || ' voucher code'
            WHEN source = 'vouchercodes' THEN 'shop ' || k || ' discount codes'
            WHEN source = 'savoo' THEN 'Shop ' || k ELSE 'Shop ' || k || ' Discount Codes' END AS store_name,
       CASE WHEN source IN ('latestdeals', 'moneysavingexpert') THEN CASE head WHEN 'ROW' THEN 'argos.co.uk' ELSE 'nike.com' END
            WHEN source = 'savoo' THEN 'shop-' || k || '.co.uk' WHEN source = 'coupert' THEN 'shop' || k || 'discountcodes.co.uk'
            ELSE 'shop-' || k || '-discount-codes.co.uk' END AS store_domain,
       CASE WHEN lead IS NULL THEN words ELSE lead || k || words END AS description, type
FROM s, o
"""

# -- slugs and addresses ------------------------------------------------------------------------

LAST_SEGMENT = r"/([^/?#]+)\z"


def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    found = table(spark, sf_dir, "pages").select(host_of(url).alias("host"), present(slug_in(url, LAST_SEGMENT)).alias("slug"))
    return found.distinct()


SLUGS = f"""
SELECT DISTINCT {SQL_HOST} AS host, regexp_extract(url, '/([^/?#]+)$', 1) AS slug FROM pages WHERE regexp_matches(url, '/[^/?#]+$')
"""


def slugs_first_nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    rows = table(spark, sf_dir, "pages").select(
        host_of(url).alias("host"), F.col("page_id"), slug_in(url, LAST_SEGMENT).alias("slug")
    )
    return first_nonempty(rows, ["host"], "page_id", "slug").select("host", "page_id", "slug")


SLUGS_FIRST_NONEMPTY = f"""
WITH s AS (SELECT {SQL_HOST} AS host, page_id, nullif(regexp_extract(url, '/([^/?#]+)$', 1), '') AS slug FROM pages)
SELECT host, min(page_id) AS page_id, arg_min(slug, page_id) AS slug FROM s WHERE slug IS NOT NULL GROUP BY host
"""


def frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.concat(F.lit("https://"), F.col("host"), F.lit("/list/"), F.col("slug"))
    return slugs(spark, sf_dir).select(F.explode(paged_frontier(base, 5)).alias("url"))


FRONTIER = f"""
WITH s AS ({SLUGS}), n AS (SELECT unnest(range(1, 6)) AS n)
SELECT 'https://' || host || '/list/' || slug || CASE WHEN n = 1 THEN '' ELSE '?page=' || n END AS url FROM s, n
"""

SITEMAP_RULES = {
    "org": Discovery("union", r"/([^/?#]+)\z", ("spam", "th")),
    "net": Discovery("flat", r"/([^/?#]+)\z"),
    "com": Discovery("first", r"/([^/?#]+)\z", ("th",)),
    "savoo": Discovery("union", r"savoo\.co\.uk/brands/([^/?#]+)\z", ("merchant",)),
}


def sitemap_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page is a sitemap of its own address, listed by an index document of its own."""
    pages = table(spark, sf_dir, "pages").withColumn("host", host_of(F.col("url")))
    source = F.substring_index("host", ".", -1)
    listing = F.concat(F.lit("https://"), F.col("host"), F.lit("/map/"), F.col("page_id"))
    inner = pages.select(
        source.alias("source"),
        listing.alias("sitemap_url"),
        F.when(source == "net", F.col("page_id")).alias("sitemap_ord"),
        F.concat(F.lit("<urlset><url><loc>"), "url", F.lit("</loc></url></urlset>")).alias("body"),
    )
    index = pages.filter(source != "net").select(
        source.alias("source"),
        F.concat(F.lit("index"), "page_id").alias("sitemap_url"),
        F.col("page_id").alias("sitemap_ord"),
        F.concat(F.lit("<sitemapindex><sitemap><loc>"), listing, F.lit("</loc></sitemap></sitemapindex>")).alias("body"),
    )
    found = discover_slugs(sitemap_locs(inner.unionByName(index)), SITEMAP_RULES)
    return crawl_frontier(found, {"org": "https://o/{slug}", "savoo": "https://s/{slug}"}).select(
        "source", "slug", F.coalesce("url", F.lit("")).alias("url")
    )


SITEMAP_SLUGS = rf"""
WITH p AS (SELECT page_id, url, {SQL_HOST} AS host, nullif(regexp_extract(url, '/([^/?#]+)$', 1), '') AS slug FROM pages),
     q AS (SELECT *, split_part(host, '.', -1) AS source, 'https://' || host || '/map/' || page_id AS sm FROM p),
     f AS (SELECT DISTINCT source, slug FROM q WHERE slug IS NOT NULL AND (
             (source = 'org' AND (contains(sm, 'spam') OR contains(sm, 'th'))) OR source = 'net' OR
             (source = 'com' AND page_id = (SELECT min(page_id) FROM q WHERE source = 'com' AND slug IS NOT NULL AND contains(sm, 'th')))))
SELECT source, slug, CASE source WHEN 'org' THEN 'https://o/' || slug ELSE '' END AS url FROM f
UNION ALL
SELECT 'savoo', s, 'https://s/' || s FROM (SELECT unnest([{quoted(FALLBACK_SLUGS["savoo"])}]) AS s)
"""


def feed_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as feed items and read back through the XML source."""
    path = work_path(spark, "feed")
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    items = table(spark, sf_dir, "pages").select(
        title.alias("title"), F.col("url").alias("link"), F.col("html").alias("description")
    )
    items.write.format("xml").option("rootTag", "channel").option("rowTag", "item").save(path)
    return read_feed(spark, path).select("title", "link", "description")


FEED_ROUND_TRIP = f"""
SELECT {sql_trim("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title, url AS link, {sql_trim("html")} AS description FROM pages
"""


def selected_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = select_sources(docs, ["src1", "src3", "absent"])
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


SELECTED_SOURCES = "SELECT source, count(*) AS n FROM documents WHERE source IN ('src1', 'src3') GROUP BY source"

QUERIES = {
    "q_container_tokens": container_tokens,
    "q_page_heading": page_headings,
    "q_split_blocked": blocked_pages,
    "q_attr_offers": attribute_offers,
    "q_button_offers": button_offers,
    "q_sibling_offers": sibling_offers,
    "q_captures": stored_captures,
    "q_slugs": slugs,
    "q_slugs_first_nonempty": slugs_first_nonempty,
    "q_frontier": frontier,
    "q_sitemap": sitemap_slugs,
    "q_feed_source": feed_round_trip,
    "q_select_sources": selected_sources,
}

SQL = {
    "q_container_tokens": CONTAINER_TOKENS,
    "q_page_heading": PAGE_HEADINGS,
    "q_split_blocked": BLOCKED_PAGES,
    "q_attr_offers": ATTRIBUTE_OFFERS,
    "q_button_offers": BUTTON_OFFERS,
    "q_sibling_offers": SIBLING_OFFERS,
    "q_captures": STORED_CAPTURES,
    "q_slugs": SLUGS,
    "q_slugs_first_nonempty": SLUGS_FIRST_NONEMPTY,
    "q_frontier": FRONTIER,
    "q_sitemap": SITEMAP_SLUGS,
    "q_feed_source": FEED_ROUND_TRIP,
    "q_select_sources": SELECTED_SOURCES,
}
