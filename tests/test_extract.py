"""Hand-written pages, feeds and sitemaps of every form."""

from pyspark.sql import functions as F

from offerloom.operators.extract import dead_letters, dedupe_page, extract_feed_offers, extract_markdown_offers, extract_page_offers, line_blocks
from offerloom.operators.slugs import crawl_frontier, discover_slugs, paged_frontier
from offerloom.plans.collect import collect_all, collect_markdown, collect_pages, collect_sources
from offerloom.queries.pages import built_captures
from offerloom.sources.profiles import DISCOVERY
from offerloom.sources.pages import markdown_lines, read_captures, read_feed, read_markdown_pages, read_sitemaps, select_sources, sitemap_locs, write_captures

MARKDOWN = """# Deals

[![K4G.com](a.svg)![K4G.com](b.svg)](https://x)

14.1% off selected products

GG1410copy

Start:1h ago

[![Nowhere Shop](a.svg)](https://x)

[link](y)

![img](z)

9,03€ off games

SEALcopy
[![Steam](a.svg)](https://x)
mixedCasecopy
ABcopy
Extra discount
TWICE22copy
[![K4G](a.svg)](https://x)

5% off

GG1410copy
"""


def test_markdown(spark, tmp_path):
    (tmp_path / "page-2.md").write_text("[![GOG](x)](y)\n" + "\n" * 10 + "NEARcopy\n[![GOG](x)](y)\n" + "\n" * 11 + "FARAWAYcopy")
    (tmp_path / "page-1.md").write_text(MARKDOWN)
    (tmp_path / "skip.txt").write_text(MARKDOWN)
    pages = read_markdown_pages(spark, str(tmp_path), "cache/")
    assert markdown_lines(pages).filter("page = 'cache/page-1.md'").count() == len(MARKDOWN.split("\n"))
    rows = extract_markdown_offers(pages).orderBy("page_key", "pos").collect()
    got = [(r.page_key[-9:], r.code, r.store_domain, r.description, r.type) for r in rows]
    assert got == [
        ("page-1.md", "GG1410", "k4g.com", "14.1% off selected products — K4G.com", "percentage"),
        ("page-1.md", "SEAL", "nowhereshop.com", "9,03€ off games — Nowhere Shop", "unknown"),
        ("page-1.md", "TWICE22", "store.steampowered.com", "Extra discount — Steam", "extra_discount"),
        ("page-1.md", "GG1410", "k4g.com", "5% off — K4G", "percentage"),
        ("page-2.md", "NEAR", "gog.com", " — GOG", "unknown"),
    ]
    unique = collect_markdown(pages)
    assert unique.count() == 4 and unique.filter("code = 'GG1410'").first().pos == 2


def test_two_blocks_may_share_a_code_line(spark):
    page = spark.createDataFrame([("p", "[![A](x)\n[![B](x)\nnote\nCODE1copy")], "page string, text string")
    assert [(r.label, r.code, r.note) for r in line_blocks(page).orderBy("line_no").collect()] == [("A", "CODE1", "note"), ("B", "CODE1", "note")]


FEED = """<rss><channel><title>t</title>
<item><title><![CDATA[CODE: SAVE10 10% off at Argos - today]]></title><link>https://h/vouchers/john-lewis</link><description>d</description></item>
<item><title>£5 off on Very</title><link>https://h/x</link><description>use 'abc12' now</description></item>
<item><title>no deal words</title><link></link><description>nothing</description></item>
</channel></rss>"""


def test_feed(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(FEED)
    items = read_feed(spark, str(tmp_path / "feed.xml"))
    rows = extract_feed_offers(items).orderBy("pos").collect()
    got = [(r.code, r.store_name, r.store_domain, r.description, r.type, r.url) for r in rows]
    assert got == [
        ("SAVE10", "John Lewis", "johnlewis.com", "SAVE10 10% off at Argos", "percentage", "https://h/vouchers/john-lewis"),
        ("abc12", "Very", "very.co.uk", "£5 off on Very", "fixed", "https://h/x"),
    ]


CARD_PAGE = """<html><head><title>Shop  codes</title></head><body><h1>Asos Discount Codes</h1>
<div class="hot-deal"><p>20% off <b>shoes</b><p>second<ul><li data-code="SHOE20x">get</li><li data-code="" data-coupon=" two2two ">x</li></ul></div>
<article><h3>Head</h3><div class="x-desc">£5 off</div>Enter CODE then WINTER9 or LATER10</article>
<div class="offer-outer"><div class="offer">Use SHOE20x and NESTED7</div></div>
<span data-code="bad">no</span><span data-code="LONE123">no card</span>
<table><tr><td>ROWCODE1<td> x<tr><td>free delivery</table>
<li class="plain">ITEM777 <p>Item text</p></li></body></html>"""


def captures(spark, *rows):
    return spark.createDataFrame(rows, "source string, url string, slug string, html string")


def facts(frame):
    return sorted((r.source, r.code, r.store_name, r.store_domain, r.description, r.type) for r in frame.collect())


def test_cards_and_attributes(spark):
    page = captures(spark, ("myvouchercodes", "u1", "asos", CARD_PAGE), ("savoo", "u2", "asos-discount-codes", CARD_PAGE))
    offers, errors = extract_page_offers(page)
    # Card text runs together: the outer card repeats the inner one, whose first token is SHOE20-free.
    mine = [f for f in facts(offers) if f[0] == "myvouchercodes"]
    assert mine == [
        ("myvouchercodes", "LONE123", "Asos", "asos.co.uk", "", "unknown"),
        ("myvouchercodes", "NESTED7", "Asos", "asos.co.uk", "", "unknown"),
        ("myvouchercodes", "SHOE20x", "Asos", "asos.co.uk", "", "unknown"),
        ("myvouchercodes", "WINTER9", "Asos", "asos.co.uk", "£5 off", "fixed"),
        ("myvouchercodes", "two2two", "Asos", "asos.co.uk", "", "unknown"),
    ]
    assert {f[2:4] for f in facts(offers) if f[0] == "savoo"} == {("Asos Discount Codes", "asos.com")}
    assert errors.count() == 0


def test_attribute_description_comes_from_the_nearest_card(spark):
    html = "<div class='deal'><p>outer</p><div class='voucher'><h2 class='title'> inner </h2><b data-code='AA11'>x</b></div></div>"
    offers, _ = extract_page_offers(captures(spark, ("netvouchercodes", "u", "b-and-q", html)))
    assert facts(offers) == [("netvouchercodes", "AA11", "B And Q", "diy.com", "inner", "unknown")]


def test_mixed_pages(spark):
    offers, _ = extract_page_offers(
        captures(spark, ("latestdeals", "u", None, CARD_PAGE), ("moneysavingexpert", "u", None, CARD_PAGE.replace("Item text", "big argos item")))
    )
    got = facts(offers)
    assert ("latestdeals", "WINTER9", "Various", "unknown.co.uk", "Head", "unknown") in got
    assert ("moneysavingexpert", "ITEM777", "Argos", "argos.co.uk", "big argos item", "unknown") in got
    assert ("moneysavingexpert", "ROWCODE1", "Various", "unknown.co.uk", "", "unknown") in got


def test_buttons(spark):
    html = "<div class='coupon'><p>10% off</p><button> Save10now </button><a>two words1</a></div><a>ABC12</a><button>abcdef</button>"
    offers, _ = extract_page_offers(captures(spark, ("coupert", "u", "ebay-co-uk", html)))
    assert facts(offers) == [
        ("coupert", "ABC12", "Ebay Co Uk", "ebay.co.uk", "", "unknown"),
        ("coupert", "Save10now", "Ebay Co Uk", "ebay.co.uk", "10% off", "percentage"),
    ]


def test_siblings(spark):
    one = "<section><p>Free delivery</p><button><div class='a-code-btn'>Get Code</div><span>x</span><span> s5 </span></button></section>"
    bad = "<section><button><div class='code-btn'>b</div><span>View 5</span></button><button><i class='code-btn'></i><span>NODIGIT</span></button></section>"
    html = f"<div class='merchantName'> Shop </div><h1>other</h1>{one}{one}{bad}"
    offers, _ = extract_page_offers(captures(spark, ("vouchercodes", "u", "next", html)))
    assert facts(offers) == [("vouchercodes", "s5", "Shop", "next.co.uk", "Free delivery", "free_shipping")] * 2


def test_challenge_pages(spark):
    html = "<title>Just a\n moment...</title><article><p>5% off</p> GOOD12</article>"
    offers, errors = extract_page_offers(captures(spark, ("codesuk", "u", "asos", html), ("savoo", "u", "asos", html), ("netvouchercodes", "v", "x", html)))
    assert {r.source for r in offers.collect()} == {"savoo"}
    assert sorted((r.source, r.error) for r in errors.collect()) == [("codesuk", "asos: Cloudflare"), ("netvouchercodes", "x: Security checkpoint")]


def test_dedupe_page_prefers_attributes(spark):
    rows = spark.createDataFrame([("s", "u", "A", 5, "attribute"), ("s", "u", "A", 3, "attribute"), ("s", "v", "A", 9, "card")],
                                 "source string, url string, code string, pos long, kind string")
    assert sorted((r.url, r.pos) for r in dedupe_page(rows).collect()) == [("u", 3), ("v", 9)]


def index(*urls):
    return "<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in urls) + "</sitemapindex>"


def urlset(*urls):
    return "<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in urls) + "</urlset>"


def test_discovery(spark):
    rows = [
        ("savoo", "s", 0, index("m/merchant1", "m/merchant2", "m/other")),
        ("savoo", "m/merchant1", None, urlset("https://www.savoo.co.uk/brands/a", "https://www.savoo.co.uk/brands/a?x")),
        ("savoo", "m/merchant2", None, urlset("https://www.savoo.co.uk/brands/b", "https://www.savoo.co.uk/brands/a")),
        ("savoo", "m/other", None, urlset("https://www.savoo.co.uk/brands/c")),
        ("coupert", "i0", 0, index("p/store-0", "p/skip")), ("coupert", "p/store-0", None, urlset("https://x/none")),
        ("coupert", "i1", 1, index("p/store-1", "p/store-2")),
        ("coupert", "p/store-1", None, urlset("https://x/promo-code/one")), ("coupert", "p/store-2", None, urlset("https://x/promo-code/two")),
        ("codesuk", "c0", 0, urlset("https://codes.co.uk/q")), ("codesuk", "c1", 1, urlset("https://codes.co.uk/r")),
        ("voucherbox", "v", 0, urlset("https://www.voucherbox.co.uk/vouchers/z", "https://www.voucherbox.co.uk/other/y")),
        ("vouchercodes", "w", 0, index("w/unrelated")),
    ]
    locs = sitemap_locs(spark.createDataFrame(rows, "source string, sitemap_url string, sitemap_ord long, body string"))
    found = discover_slugs(locs)
    got = {}
    for r in found.collect():
        got.setdefault(r.source, set()).add(r.slug)
    assert got["savoo"] == {"a", "b"} and got["coupert"] == {"one"} and got["codesuk"] == {"q"} and got["voucherbox"] == {"z"}
    assert len(got["vouchercodes"]) == 29 and len(got["myvouchercodes"]) == 46 and len(got["netvouchercodes"]) == 40
    urls = {r.url for r in crawl_frontier(found).collect()}
    assert {"https://www.savoo.co.uk/brands/a", "https://uk.coupert.com/promo-code/one"} <= urls and None not in urls
    pages = spark.range(1).select(F.explode(paged_frontier(F.lit("b"), 3)).alias("u")).collect()
    assert [r.u for r in pages] == ["b", "b?page=2", "b?page=3"]


def test_sitemap_files_lead_to_slugs(spark, tmp_path):
    (tmp_path / "a.xml").write_text(index("https://m/merchant1", "https://m/other"))
    (tmp_path / "b.xml").write_text(urlset(" https://www.savoo.co.uk/brands/three "))
    (tmp_path / "c.xml").write_text(urlset("https://www.savoo.co.uk/brands/four"))
    (tmp_path / "unknown.xml").write_text(urlset("https://www.savoo.co.uk/brands/five"))
    manifest = spark.createDataFrame(
        [("a.xml", "savoo", "https://m/index", 0), ("b.xml", "savoo", "https://m/merchant1", None), ("c.xml", "savoo", "https://m/other", None)],
        "file string, source string, sitemap_url string, sitemap_ord long",
    )
    locs = read_sitemaps(spark, str(tmp_path), manifest)
    assert sorted((r.is_index, r.pos, r.loc) for r in locs.collect())[-2:] == [(True, 0, "https://m/merchant1"), (True, 1, "https://m/other")]
    assert [r.slug for r in discover_slugs(locs, {"savoo": DISCOVERY["savoo"]}).collect()] == ["three"]


def test_feed_items_are_numbered_by_file(spark, tmp_path):
    for n, name in enumerate(("b.xml", "a.xml")):
        items = "".join(f"<item><title>{name}{k}</title><link>l</link></item>" for k in range(30))
        (tmp_path / name).write_text(f"<rss><channel>{items}</channel></rss>")
    rows = read_feed(spark, str(tmp_path)).orderBy("item_no").collect()
    assert [r.title for r in rows] == [f"{name}{k}" for name in ("a.xml", "b.xml") for k in range(30)]


def test_sources(spark, tmp_path):
    path = str(tmp_path / "captures")
    captures(spark, ("savoo", "u", "asos-discount-codes", CARD_PAGE), ("coupert", "v", "x", "<a>AB12</a>")).write.parquet(path)
    assert read_captures(spark, path, ["savoo"]).count() == 1 and read_captures(spark, path).count() == 2
    assert select_sources(read_captures(spark, path), "nobody").count() == 0

    def broken():
        raise ValueError("no network\nmore")

    def broken_row():
        """Fails only when its rows are read."""
        page = extract_page_offers(read_captures(spark, path, "coupert"))[0]
        return page.withColumn("code", F.raise_error(F.lit("bad row")).cast("string"))

    got = collect_sources(
        spark, {"savoo": broken, "voucherbox": broken_row, "coupert": lambda: extract_page_offers(read_captures(spark, path, "coupert"))[0]}
    )
    assert [r.code for r in got.offers.collect()] == ["AB12"]
    errors = {r.source: r.error for r in got.errors.collect()}
    assert errors["savoo"] == "no network" and set(errors) == {"savoo", "voucherbox"}
    assert {r.source: (r.codesFound, len(r.errors)) for r in got.runs.collect()} == {"savoo": (0, 1), "voucherbox": (0, 1), "coupert": (1, 0)}
    assert all(r.duration >= 0 for r in got.runs.collect())
    both, challenge = collect_all(captures=read_captures(spark, path))
    assert {r.source for r in both.collect()} == {"savoo", "coupert"} and challenge.count() == 0


BAD_MARKUP = "<h1>Shop</h1><article><p>note</p>SAVE99NOW</article><![part[x]]>"
OFFER_PAGE = "<h1>Shop</h1><article class='deal'><p>5% off</p> <b>WINTER9</b> </article>"


def test_a_page_that_cannot_be_parsed_stops_no_other(spark):
    page = captures(spark, ("savoo", "u1", "bad", BAD_MARKUP), ("savoo", "u2", "good", OFFER_PAGE), ("savoo", "u3", None, BAD_MARKUP))
    pages = collect_pages(page)
    reason = "unknown status keyword 'part' in marked section"
    assert sorted(r.error for r in pages.errors.collect()) == [f"bad: {reason}", reason]
    assert [(r.url, r.code) for r in pages.offers.collect()] == [("u2", "WINTER9")]
    letters = dead_letters(pages.elements).collect()
    assert sorted((r.url, r.slug, r.reason) for r in letters) == [("u1", "bad", reason), ("u3", None, reason)]
    offers, errors = extract_page_offers(page)
    assert (offers.count(), errors.count()) == (1, 2)
    offers, errors = collect_all(captures=page)
    assert (offers.count(), errors.count()) == (1, 2)


def test_pages_that_were_not_delivered(spark):
    rows = [("savoo", f"u{k}", f"s{k}", OFFER_PAGE, status) for k, status in enumerate([200, 204, None, 199, 300, 404, 503])]
    page = spark.createDataFrame(rows, "source string, url string, slug string, html string, status int")
    pages = collect_pages(page)
    assert sorted(r.error for r in pages.errors.collect()) == ["s3: HTTP 199", "s4: HTTP 300", "s5: HTTP 404", "s6: HTTP 503"]
    assert sorted(r.url for r in pages.offers.collect()) == ["u0", "u1", "u2"]


def test_run_rows_name_the_first_page_errors(spark):
    rows = [("savoo", f"u{k}", f"s{k:03d}", BAD_MARKUP) for k in range(130)] + [("savoo", "ok", "ok", OFFER_PAGE)]
    page = captures(spark, *rows)
    got = collect_sources(spark, {"savoo": lambda: collect_pages(page), "none": lambda: 1 / 0})
    runs = {r.source: r for r in got.runs.collect()}
    assert runs["savoo"].codesFound == 1 and len(runs["savoo"].errors) == 101
    assert runs["savoo"].errors[0].startswith("s000: ") and runs["savoo"].errors[-1] == "and 30 more"
    assert runs["none"].errors == ["division by zero"]
    assert got.errors.groupBy("source").count().orderBy("source").collect() == [("none", 1), ("savoo", 130)]
    assert got.offers.count() == 1


def test_a_source_reads_its_own_folder_alone(spark, tmp_path):
    path = str(tmp_path / "captures")
    rows = [(source, f"u{k}", "s", OFFER_PAGE) for source in ("savoo", "coupert") for k in range(20)]
    write_captures(captures(spark, *rows), path)
    write_captures(captures(spark, ("2024", "u", "s", None)), path)
    plan = read_captures(spark, path, ["savoo"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source" in plan and "savoo" in plan.split("PartitionFilters")[1].split("]")[0]
    assert read_captures(spark, path, ["savoo"]).count() == 20 and read_captures(spark, path).count() == 41
    assert [tuple(r) for r in read_captures(spark, path, "2024").collect()] == [("2024", "u", "s", None, None)]


def test_built_pages_are_dealt_over_all_cores(spark, tmp_path):
    """One small file of parts is one task; the pages built of it cost far more than its bytes."""
    rows = [(i, f"part no {i}", i % 50) for i in range(400)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    pages = built_captures(spark, str(tmp_path), "coupert")
    tasks = [r.n for r in pages.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(tasks) >= spark.sparkContext.defaultParallelism and max(tasks) <= 40 and sum(tasks) == 400
    assert sorted(r.slug for r in pages.select("slug").collect()) == sorted(name.replace(" ", "-") for _, name, _ in rows)
