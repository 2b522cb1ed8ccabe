"""Rules on texts: codes, descriptions, kinds of offer, names and domains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom import fixed
from offerloom.functions.codes import candidate_tokens, feed_code, is_valid_code, norm_code
from offerloom.functions.descriptions import (
    clean_description,
    feed_description,
    min_spend,
    offer_type,
    offer_value,
)
from offerloom.functions.text import let, present
from offerloom.operators.extract import extract_feed_offers, extract_markdown_offers, line_blocks
from offerloom.operators.resolve import first_contained, resolve_domain_slug
from offerloom.plans.collect import collect_markdown
from offerloom.queries.common import (
    OFFER_TEXT_SQL,
    offer_text,
    quoted,
    sql_candidate,
    sql_clean,
    sql_first,
    sql_min_spend,
    sql_norm,
    sql_plain,
    sql_trim,
    sql_type,
    sql_valid_code,
    sql_value,
    table,
)
from offerloom.session import work_path
from offerloom.sources.pages import read_markdown_pages
from offerloom.sources.versions import file_system, names_in


def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = let(candidate_tokens(F.col("text")), lambda found: F.when(F.size(found) > 0, found))
    found = table(spark, sf_dir, "documents").select("doc_id", present(tokens).alias("tokens"))
    return found.select(
        "doc_id",
        F.get("tokens", F.lit(0)).alias("first_token"),
        F.size("tokens").cast("long").alias("n_tokens"),
    )


TEXT_TOKENS = rf"""
WITH t AS (
  SELECT doc_id, list_filter(regexp_extract_all(text, '\b([A-Z0-9]{{3,20}})\b', 1),
                             lambda x: {sql_candidate('x')} AND NOT regexp_matches(x, '^20\d{{2}}$')) AS tokens
  FROM documents)
SELECT doc_id, tokens[1] AS first_token, CAST(len(tokens) AS BIGINT) AS n_tokens FROM t WHERE len(tokens) > 0
"""


def valid_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"[ \n]+")).alias("word"))
    return words.filter(is_valid_code(F.col("word"))).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


VALID_CODES = rf"""
WITH w AS (SELECT unnest(string_split_regex(text, '[ \n]+')) AS raw FROM documents),
     c AS (SELECT raw, {sql_trim('raw')} AS word FROM w)
SELECT raw AS word, count(*) AS n FROM c
WHERE {sql_valid_code('word')} AND NOT regexp_matches(word, '^20\d{{2}}$') GROUP BY raw
"""


def norm_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    glue = F.element_at(F.array(F.lit("-"), F.lit("_"), F.lit(" "), F.lit("")), (F.col("p_partkey") % 4 + 1).cast("int"))
    raw = F.concat("p_brand", glue, "p_name")
    return part.select(raw.alias("raw"), norm_code(raw).alias("norm")).groupBy("norm").agg(
        F.count(F.lit(1)).alias("n"), F.min("raw").alias("least"), F.max("raw").alias("greatest")
    )


NORM_CODES = f"""
WITH r AS (SELECT p_brand || (CASE p_partkey % 4 WHEN 0 THEN '-' WHEN 1 THEN '_' WHEN 2 THEN ' ' ELSE '' END) || p_name AS raw FROM part)
SELECT {sql_norm('raw')} AS norm, count(*) AS n, min(raw) AS least, max(raw) AS greatest FROM r GROUP BY 1
"""


def offer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = offer_text()
    lines = table(spark, sf_dir, "lineitem")
    return (
        lines.select(
            offer_type(text).alias("kind"), offer_type(text, extra_discount=True).alias("kind_extra")
        )
        .groupBy("kind", "kind_extra")
        .agg(F.count(F.lit(1)).alias("n"))
    )


OFFER_TYPES = f"""
WITH t AS (SELECT {OFFER_TEXT_SQL} AS t FROM lineitem)
SELECT {sql_type('t')} AS kind, {sql_type('t', True)} AS kind_extra, count(*) AS n FROM t GROUP BY 1, 2
"""


def value_min_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", clean_description(offer_text(), intended=True).alias("text")
    )
    return (
        described.withColumn("kind", offer_type(F.col("text")))
        .select(
            "l_returnflag",
            "kind",
            offer_value(F.col("text"), F.col("kind")).alias("value"),
            min_spend(F.col("text")).alias("spend"),
        )
        .groupBy("l_returnflag", "kind")
        .agg(
            F.count("value").alias("n_value"),
            F.coalesce(F.floor(F.sum("value") * 100 + 0.5), F.lit(0)).alias("pence_value"),
            F.count("spend").alias("n_spend"),
            F.coalesce(F.floor(F.sum("spend") * 100 + 0.5), F.lit(0)).alias("pence_spend"),
        )
    )


VALUE_MIN_SPEND = f"""
WITH t AS (SELECT l_returnflag, {sql_plain('(' + OFFER_TEXT_SQL + ')')} AS p FROM lineitem),
     c AS (SELECT l_returnflag, CASE WHEN {sql_clean('p')} = '' THEN '' ELSE p END AS t FROM t),
     k AS (SELECT l_returnflag, t, {sql_type('t')} AS kind FROM c),
     v AS (SELECT l_returnflag, kind, {sql_value('t', 'kind')} AS value, {sql_min_spend('t')} AS spend FROM k)
SELECT l_returnflag, kind, count(value) AS n_value, coalesce(CAST(floor(sum(value) * 100 + 0.5) AS BIGINT), 0) AS pence_value,
       count(spend) AS n_spend, coalesce(CAST(floor(sum(spend) * 100 + 0.5) AS BIGINT), 0) AS pence_spend
FROM v GROUP BY 1, 2
"""


def clean_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(
        F.concat_ws(":", F.lit("turn"), "conv_id", "turn").alias("id"), F.col("text")
    )
    pages = table(spark, sf_dir, "pages").select(
        F.concat_ws(":", F.lit("page"), "page_id").alias("id"), F.col("html").alias("text")
    )
    return turns.unionByName(pages).select("id", clean_description(F.col("text")).alias("description"))


CLEAN_DESCRIPTIONS = f"""
WITH t AS (SELECT 'turn:' || conv_id || ':' || turn AS id, text FROM conversations
           UNION ALL SELECT 'page:' || page_id, html FROM pages),
     p AS (SELECT id, {sql_plain('text')} AS p FROM t)
SELECT id, {sql_clean('p')} AS description FROM p
"""


def feed_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    labelled = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("CODE: "), title)).otherwise(
        F.regexp_replace(title, "th", " - th")
    )
    return table(spark, sf_dir, "pages").select("page_id", feed_description(labelled).alias("description"))


FEED_DESCRIPTIONS = f"""
WITH t AS (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS t FROM pages),
     l AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'CODE: ' || t ELSE regexp_replace(t, 'th', ' - th', 'g') END AS t FROM t),
     s AS (SELECT page_id, regexp_replace(t, '(?i)^(?:CODE|Voucher|Promo)[:{fixed.SPACE_SET}]+', '') AS t FROM l),
     c AS (SELECT page_id, regexp_replace(t, '{fixed.SPACE}*[-–|]{fixed.NOT_NEWLINE}*$', '') AS t FROM s)
SELECT page_id, substr({sql_trim('t')}, 1, 200) AS description FROM c
"""


def feed_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cut = F.substring_index("text", "\n", 1)
    rest = F.expr("substring(text, length(substring_index(text, '\\n', 1)) + 1)")
    return docs.select("doc_id", present(feed_code(cut, rest)).alias("code"))


_COMMON = quoted(fixed.FEED_COMMON_WORDS)
FEED_CODES = rf"""
WITH t AS (SELECT doc_id, string_split(text, chr(10))[1] || ' ' || substr(text, length(string_split(text, chr(10))[1]) + 1) AS t FROM documents),
     m AS (SELECT doc_id,
       {sql_first('t', '(?i)(?:code|voucher|promo)[:' + fixed.SPACE_SET + ']+([A-Z0-9]{3,30})')} AS a,
       {sql_first('t', chr(92) + 'b([A-Z0-9]{5,20})' + chr(92) + 'b')} AS b,
       {sql_first('t', '''(?i)["']([A-Z0-9]{3,30})["']''')} AS c FROM t),
     r AS (SELECT doc_id, coalesce(
       CASE WHEN upper(a) NOT IN ({_COMMON}) THEN a END,
       CASE WHEN upper(b) NOT IN ({_COMMON}) AND (regexp_matches(b, '[0-9]') OR length(b) >= 6) THEN b END,
       CASE WHEN upper(c) NOT IN ({_COMMON}) THEN c END) AS code FROM m)
SELECT doc_id, code FROM r WHERE code IS NOT NULL
"""

BLOCK_LINE, CODE_LINE = "^([A-Z])", "^([A-Z][a-z]{2,25})\\."


def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    blocks = line_blocks(docs, block_line=BLOCK_LINE, code_line=CODE_LINE + r"\z")
    return blocks.select("doc_id", "line_no", "label", "code", "note")


TEXT_BLOCKS = f"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
     i AS (SELECT doc_id, l, unnest(range(len(l))) AS i FROM d),
     b AS (SELECT doc_id, l, i, list_filter(range(i + 1, least(i + 12, len(l))), lambda j: regexp_matches(l[j + 1], '{CODE_LINE}$')) AS js
           FROM i WHERE regexp_matches(l[i + 1], '{BLOCK_LINE}')),
     n AS (SELECT *, list_filter(range(i, js[1]), lambda k: NOT regexp_matches({sql_trim('l[k + 1]')}, '^(?:$|\\[|!\\[)')) AS ks
           FROM b WHERE len(js) > 0)
SELECT doc_id, i AS line_no, regexp_extract(l[i + 1], '{BLOCK_LINE}', 1) AS label,
       regexp_extract(l[js[1] + 1], '{CODE_LINE}$', 1) AS code,
       CASE WHEN len(ks) > 0 THEN {sql_trim('l[ks[len(ks)] + 1]')} ELSE '' END AS note
FROM n
"""


def part_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown page per part (p_partkey, text): a block with a code line, one whose code line has another form."""
    part = table(spark, sf_dir, "part")
    store = F.element_at(
        F.array(F.lit("K4G.com"), F.lit("Green Man Gaming"), F.lit("Unlisted Shop!")),
        (F.col("p_partkey") % 3 + 1).cast("int"),
    )
    size = F.col("p_size").cast("string")
    text = F.concat(
        F.lit("We found\n\n[!["), store, F.lit("](x.svg)](https://x)\n\n"),
        size, F.lit("% off "), F.col("p_name"),
        F.lit("\n\n"), F.upper(F.replace("p_name", F.lit(" "), F.lit(""))), size,
        F.lit("copy\n\nStart:1h ago\n\n[![Steam](y.svg)](https://y)\n\nExtra  discount\n\nmixedCase"),
        size, F.lit("copy\n"),
    )
    return part.select("p_partkey", text.alias("text"))


def markdown_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = part_pages(spark, sf_dir).select(F.concat(F.lit("page-"), "p_partkey").alias("page"), "text")
    return extract_markdown_offers(pages).select(
        F.col("page_key").alias("page"), "pos", "code", "store_name", "store_domain", "description", "type"
    )


MARKDOWN_OFFERS = """
WITH p AS (SELECT *, CASE p_partkey % 3 WHEN 0 THEN 'K4G.com' WHEN 1 THEN 'Green Man Gaming' ELSE 'Unlisted Shop!' END AS store FROM part)
SELECT 'page-' || p_partkey AS page, CAST(2 AS BIGINT) AS pos, upper(replace(p_name, ' ', '')) || p_size AS code, store AS store_name,
       CASE p_partkey % 3 WHEN 0 THEN 'k4g.com' WHEN 1 THEN 'greenmangaming.com' ELSE 'unlistedshop.com' END AS store_domain,
       p_size || '% off ' || p_name || ' — ' || store AS description, 'percentage' AS type
FROM p
"""


#: Markdown files that the pages are written to, and lines between pages: more than a block looks ahead.
MARKDOWN_FILES, GAP_LINES = 20, 12


def markdown_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as cached Markdown files, read back and reduced to the first of each code and domain."""
    path = work_path(spark, "markdown")
    rows = part_pages(spark, sf_dir).select(
        F.lpad((F.col("p_partkey") % MARKDOWN_FILES).cast("string"), 2, "0").alias("file"), "p_partkey",
        F.concat("text", F.lit("\n" * (GAP_LINES - 1))).alias("value"),
    )
    rows = rows.repartition("file").sortWithinPartitions("file", "p_partkey").select("file", "value")
    rows.write.partitionBy("file").text(f"{path}/written")
    system, folder, jvm = file_system(spark, f"{path}/cache")
    system.mkdirs(folder)
    for name in names_in(spark, f"{path}/written"):  # a folder for each of the few files
        for part in names_in(spark, f"{path}/written/{name}") if name.startswith("file=") else ():
            if part.startswith("part-"):
                old = jvm.org.apache.hadoop.fs.Path(f"{path}/written/{name}/{part}")
                system.rename(old, jvm.org.apache.hadoop.fs.Path(folder, f"pages-{name[5:]}.md"))
    offers = collect_markdown(read_markdown_pages(spark, f"{path}/cache", "cache/"))
    return offers.select(F.col("page_key").alias("page"), "pos", "code", "store_domain", "description")


MARKDOWN_SOURCE = f"""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_partkey % {MARKDOWN_FILES} ORDER BY p_partkey) - 1 AS nth,
                  CASE p_partkey % 3 WHEN 0 THEN 'K4G.com' WHEN 1 THEN 'Green Man Gaming' ELSE 'Unlisted Shop!' END AS store FROM part),
o AS (SELECT 'cache/pages-' || lpad(CAST(p_partkey % {MARKDOWN_FILES} AS VARCHAR), 2, '0') || '.md' AS page,
             CAST(nth * {15 + GAP_LINES} + 2 AS BIGINT) AS pos, upper(replace(p_name, ' ', '')) || p_size AS code,
             CASE p_partkey % 3 WHEN 0 THEN 'k4g.com' WHEN 1 THEN 'greenmangaming.com' ELSE 'unlistedshop.com' END AS store_domain,
             p_size || '% off ' || p_name || ' — ' || store AS description FROM p)
SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY code, store_domain ORDER BY page, pos) = 1
"""


def feed_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed item per part: store in the link, in the title, or nowhere."""
    name, size = F.col("p_name"), F.col("p_size").cast("string")
    code = F.concat(F.upper(F.replace(name, F.lit(" "), F.lit(""))), size)
    form = F.col("p_partkey") % 4
    title = (
        F.when(form == 0, F.concat(F.lit("CODE: "), code, F.lit(" 5% off now - ends soon")))
        .when(form == 1, F.concat(code, F.lit(" £"), size, F.lit(" off at "), name, F.lit(" - today")))
        .when(form == 2, F.concat(F.lit("Sale for Argos Shop with "), code))
        .otherwise(F.concat(F.lit("Only plain words about "), name))
    )
    link = F.when(
        form == 0, F.concat(F.lit("https://feed/vouchers/"), F.replace(name, F.lit(" "), F.lit("-")), F.lit("?a=1"))
    ).otherwise(F.lit("https://feed/deal/1"))
    items = table(spark, sf_dir, "part").select(
        title.alias("title"), link.alias("link"), F.lit("").alias("description"), F.col("p_partkey").alias("item_no")
    )
    return extract_feed_offers(items).select(
        F.col("pos").alias("item"), "code", "store_name", "store_domain", "description", "type"
    )


_NAME = "p_name"
_WORDS = f"string_split({_NAME}, ' ')"
_TITLED = (
    f"upper(substr({_WORDS}[1], 1, 1)) || substr({_WORDS}[1], 2) || ' ' || "
    f"upper(substr({_WORDS}[2], 1, 1)) || substr({_WORDS}[2], 2)"
)
# "new" ends a store name and is generic in front; no other name word is special to the rules,
# and no table key other than the parts of "gear"/"hot"... occurs; both are spelled out below.
FEED_OFFERS = rf"""
WITH k AS (SELECT unnest([{quoted(fixed.FEED_STORES)}]) AS key, unnest([{quoted(fixed.FEED_STORES.values())}]) AS domain,
                  unnest(range({len(fixed.FEED_STORES)})) AS ord),
     p AS (SELECT p_partkey, p_partkey % 4 AS form, p_size, p_name, upper(replace(p_name, ' ', '')) || p_size AS code FROM part),
     s AS (SELECT *, CASE form WHEN 0 THEN {_TITLED} WHEN 1 THEN p_name WHEN 2 THEN 'Argos Shop' END AS store FROM p WHERE form < 3),
     u AS (SELECT *, CASE WHEN strpos(lower(store), ' ') = 0 THEN store ELSE store END AS store_name FROM s),
     d AS (SELECT u.p_partkey, first(k.domain ORDER BY k.ord) AS domain FROM u JOIN k
           ON contains(lower(u.store_name), k.key) OR contains(k.key, lower(u.store_name)) GROUP BY 1)
SELECT u.p_partkey AS item, u.code, u.store_name,
       coalesce(d.domain, CASE WHEN u.p_name LIKE 'new %' THEN 'unknown.co.uk' ELSE replace(lower(u.store_name), ' ', '') || '.co.uk' END) AS store_domain,
       CASE form WHEN 0 THEN code || ' 5% off now' WHEN 1 THEN code || ' £' || p_size || ' off at ' || p_name ELSE 'Sale for Argos Shop with ' || code END AS description,
       CASE form WHEN 0 THEN 'percentage' WHEN 1 THEN 'fixed' ELSE 'unknown' END AS type
FROM u LEFT JOIN d USING (p_partkey)
"""


_SLUG_SOURCES = ("vouchercodes", "savoo", "coupert", "netvouchercodes", "voucherbox", "codesuk", "myvouchercodes")


def domains_by_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    dashed = F.replace("p_name", F.lit(" "), F.lit("-"))
    slug = (
        F.when(F.col("p_partkey") % 5 == 0, F.lit("b-and-q"))
        .when(F.col("p_partkey") % 5 == 1, F.lit("john-lewis-discount-codes"))
        .when(F.col("p_partkey") % 5 == 2, F.lit("ao-com"))
        .otherwise(dashed)
    )
    sources = F.array(*(F.lit(source) for source in _SLUG_SOURCES))
    source = F.element_at(sources, (F.col("p_size") % len(_SLUG_SOURCES) + 1).cast("int"))
    rows = part.select(slug.alias("slug"), source.alias("source"))
    return resolve_domain_slug(rows).groupBy("source", "slug", "store_domain").agg(F.count(F.lit(1)).alias("n"))


DOMAINS_BY_SLUG = f"""
WITH r AS (SELECT CASE p_partkey % 5 WHEN 0 THEN 'b-and-q' WHEN 1 THEN 'john-lewis-discount-codes' WHEN 2 THEN 'ao-com'
                  ELSE replace(p_name, ' ', '-') END AS slug, ([{quoted(_SLUG_SOURCES)}])[p_size % 7 + 1] AS source FROM part)
SELECT source, slug,
  CASE WHEN source NOT IN ('vouchercodes', 'myvouchercodes') AND slug = 'b-and-q' THEN 'diy.com'
       WHEN source NOT IN ('vouchercodes', 'myvouchercodes') AND slug = 'ao-com' THEN 'ao.com'
       WHEN source = 'savoo' AND slug = 'john-lewis-discount-codes' THEN 'johnlewis.com'
       WHEN source = 'coupert' THEN replace(slug, '-', '') || '.co.uk'
       ELSE slug || '.co.uk' END AS store_domain, count(*) AS n
FROM r GROUP BY 1, 2, 3
"""

NAME_TABLE = {"wid": "wid.example", "blue": "blue.example", "o": "o.example", "small anvil": "sa.example"}


def domains_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = first_contained(F.col("p_name"), NAME_TABLE, both_ways=True)
    rows = table(spark, sf_dir, "part").select("p_name", F.coalesce(hit["value"], F.lit("unknown.co.uk")).alias("domain"))
    return rows.groupBy("p_name", "domain").agg(F.count(F.lit(1)).alias("n"))


DOMAINS_BY_TEXT = f"""
WITH k AS (SELECT unnest([{quoted(NAME_TABLE)}]) AS key, unnest([{quoted(NAME_TABLE.values())}]) AS domain, unnest(range({len(NAME_TABLE)})) AS ord),
     d AS (SELECT p_name, first(k.domain ORDER BY k.ord) AS domain
           FROM (SELECT DISTINCT p_name FROM part) p JOIN k ON contains(p_name, key) OR contains(key, p_name) GROUP BY 1)
SELECT p.p_name, coalesce(d.domain, 'unknown.co.uk') AS domain, count(*) AS n FROM part p LEFT JOIN d USING (p_name) GROUP BY 1, 2
"""

QUERIES = {
    "q_text_tokens": text_tokens,
    "q_valid_codes": valid_codes,
    "q_norm_code": norm_codes,
    "q_offer_type": offer_types,
    "q_value_minspend": value_min_spend,
    "q_clean_description": clean_descriptions,
    "q_feed_description": feed_descriptions,
    "q_feed_code": feed_codes,
    "q_feed_offers": feed_offers,
    "q_line_blocks": text_blocks,
    "q_markdown_offers": markdown_offers,
    "q_markdown_source": markdown_source,
    "q_resolve_domain_exact": domains_by_slug,
    "q_resolve_domain_contains": domains_by_text,
}

SQL = {
    "q_text_tokens": TEXT_TOKENS,
    "q_valid_codes": VALID_CODES,
    "q_norm_code": NORM_CODES,
    "q_offer_type": OFFER_TYPES,
    "q_value_minspend": VALUE_MIN_SPEND,
    "q_clean_description": CLEAN_DESCRIPTIONS,
    "q_feed_description": FEED_DESCRIPTIONS,
    "q_feed_code": FEED_CODES,
    "q_feed_offers": FEED_OFFERS,
    "q_line_blocks": TEXT_BLOCKS,
    "q_markdown_offers": MARKDOWN_OFFERS,
    "q_markdown_source": MARKDOWN_SOURCE,
    "q_resolve_domain_exact": DOMAINS_BY_SLUG,
    "q_resolve_domain_contains": DOMAINS_BY_TEXT,
}
