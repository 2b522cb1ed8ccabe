"""Raw offers out of Markdown pages, feeds and stored HTML pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.functions.codes import feed_code, first_candidate_token, is_valid_code
from offerloom.functions.descriptions import DESCRIPTION_CHARS, feed_description, offer_type
from offerloom.functions.stores import clean_heading, feed_store, slug_to_name
from offerloom.functions.text import blank_to_null, collapse_space, let, present, trim_all
from offerloom.operators.containers import page_elements
from offerloom.operators.dedupe import first_rows
from offerloom.operators.resolve import (
    resolve_domain_feed,
    resolve_domain_name,
    resolve_domain_slug,
    resolve_domain_text,
)
from offerloom.schemas import RAW_OFFER
from offerloom.sources.pages import select_sources
from offerloom.sources.profiles import PAGES, SOURCE_RANK, PageProfile

STORE_LINE = r"\[!\[(.+?)\]"
CODE_LINE = r"^([A-Z0-9]{3,25})copy\z"
BLOCK_LINES = 11


def as_raw_offers(df: DataFrame) -> DataFrame:
    """The raw offer columns in their declared order and type, missing ones as null."""
    return df.select(
        *(
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in RAW_OFFER
        )
    )


def line_blocks(
    pages: DataFrame,
    text: str = "text",
    block_line: str = STORE_LINE,
    code_line: str = CODE_LINE,
    following: int = BLOCK_LINES,
    skip: Column | None = None,
) -> DataFrame:
    """Blocks of a text: a line that opens one, and the first code line after it.

    Adds ``line_no`` (0-based, of the opening line), ``label``, ``code`` and ``note`` (nearest line
    above the code line that is neither blank nor opens with a bracket).  A text is one row, so
    the look-ahead is array work inside that row and needs no shuffle.
    """
    lines = F.split(F.col(text), "\n")
    parsed = pages.withColumn(
        "_lines",
        F.transform(
            lines,
            lambda line: F.struct(
                F.regexp_extract(line, block_line, 1).alias("label"),
                F.regexp_extract(line, code_line, 1).alias("code"),
                trim_all(line).alias("note"),
            ),
        ),
    )
    numbered = F.transform(F.col("_lines"), lambda line, i: F.struct(i.alias("i"), line.alias("line")))
    openings = F.filter(numbered, lambda row: row["line"]["label"] != "")

    def with_code(opening: Column) -> Column:
        i = opening["i"]
        ahead = F.slice(F.col("_lines"), i + 2, F.lit(following))
        offset = F.array_position(F.transform(ahead, lambda line: line["code"] != ""), True)
        above = F.slice(F.col("_lines"), i + 1, F.greatest(offset, F.lit(1)).cast("int"))
        notes = F.filter(above, lambda line: ~line["note"].rlike(r"^(?:\[|!\[|\z)"))
        return F.struct(
            i.cast("long").alias("line_no"),
            opening["line"]["label"].alias("label"),
            F.when(offset > 0, F.get(ahead, (offset - 1).cast("int"))["code"]).alias("code"),
            F.coalesce(F.get(notes, F.size(notes) - 1)["note"], F.lit("")).alias("note"),
        )

    blocks = F.filter(F.transform(openings, with_code), lambda block: block["code"].isNotNull())
    return parsed.select(
        *(c for c in pages.columns if c != text), F.inline(blocks)
    )


def extract_markdown_offers(pages: DataFrame, source: str = "ggdeals") -> DataFrame:
    """Offers of Markdown pages (page, text)."""
    blocks = line_blocks(pages)
    named = blocks.select(
        F.lit(SOURCE_RANK[source]).alias("source_rank"),
        F.col("page").alias("page_key"),
        F.col("line_no").alias("pos"),
        "code",
        F.col("label").alias("store_name"),
        F.left(F.concat("note", F.lit(" — "), "label"), F.lit(DESCRIPTION_CHARS)).alias("description"),
        offer_type(F.col("note"), extra_discount=True).alias("type"),
        F.lit(source).alias("source"),
        F.col("page").alias("url"),
    )
    return as_raw_offers(resolve_domain_name(named, source))


def extract_feed_offers(items: DataFrame, source: str = "hotukdeals") -> DataFrame:
    """Offers of feed items (title, link, description, item_no); items without a code are dropped."""
    found = items.select(
        F.lit(SOURCE_RANK[source]).alias("source_rank"),
        F.lit("").alias("page_key"),
        F.col("item_no").alias("pos"),
        present(feed_code(F.col("title"), F.col("description"))).alias("code"),
        feed_store(F.col("title"), F.col("link")).alias("store_name"),
        feed_description(F.col("title")).alias("description"),
        offer_type(F.col("title")).alias("type"),
        F.lit(source).alias("source"),
        F.col("link").alias("url"),
    )
    return as_raw_offers(resolve_domain_feed(found))


def _per_source(sources: list[str], rule) -> Column:
    """``rule(source)`` chosen by the source column."""
    chosen = F
    for source in sources:
        chosen = chosen.when(F.col("source") == source, rule(source))
    return chosen.otherwise(F.lit(None))


_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def page_title(html: Column) -> Column:
    """Title of a stored page, read without parsing the page; white space counts as one space."""
    text = F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title", 1)
    for entity, letter in _ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(letter))
    return F.trim(collapse_space(text))


def is_blocked(title: Column, markers: tuple[str, ...]) -> Column:
    """True when a page title carries a challenge marker."""
    hits = [F.contains(title, F.lit(marker)) for marker in markers]
    return F.coalesce(reduce(lambda a, b: a | b, hits, F.lit(False)), F.lit(False))


def split_blocked_pages(
    captures: DataFrame, profiles: dict[str, PageProfile] = PAGES
) -> tuple[DataFrame, DataFrame]:
    """Readable captures (source, url, slug, html), and one error row (source, error) per challenge page.

    Only titles are looked at, so challenge pages are never parsed.
    """
    guarded = {source: p for source, p in profiles.items() if p.blocked}
    title = page_title(F.col("html"))
    blocked = F.coalesce(
        _per_source(list(guarded), lambda source: is_blocked(title, guarded[source].blocked)),
        F.lit(False),
    )
    reason = _per_source(list(guarded), lambda source: F.lit(guarded[source].blocked_reason))
    errors = captures.filter(F.col("source").isin(*guarded)).filter(blocked).select(
        "source", _page_error(reason)
    )
    return captures.filter(~blocked), errors


def page_heading(sources: list[str]) -> Column:
    """Store name of a page: its heading, else its slug in words."""

    def named(source: str) -> Column:
        heading = trim_all(F.col("heading"))
        if source == "vouchercodes":
            heading = blank_to_null(heading)
        return clean_heading(F.coalesce(heading, slug_to_name(F.col("slug"), source)), source)

    return _per_source(sources, named)


def element_code(sources: list[str], profiles: dict[str, PageProfile]) -> Column:
    """Code an element offers, or null when it offers none."""
    text = F.col("text")

    def attribute(source: str) -> Column:
        values = [blank_to_null(F.col("attrs")[name]) for name in profiles[source].attributes]
        return F.coalesce(*values, F.lit(None)) if values else F.lit(None)

    label = trim_all(text)
    unwanted = F.contains(F.lower(label), F.lit("get code")) | F.contains(F.lower(label), F.lit("view"))
    sibling = F.length(label).between(2, 25) & ~unwanted & label.rlike("[0-9]")
    return (
        F.when(F.col("kind") == "attribute", trim_all(_per_source(sources, attribute)))
        .when(F.col("kind") == "card", first_candidate_token(text, F.col("source")))
        .when((F.col("kind") == "button") & label.rlike(r"\A[A-Za-z0-9]{3,25}\z"), label)
        .when((F.col("kind") == "sibling") & sibling, label)
    )


def dedupe_page(offers: DataFrame) -> DataFrame:
    """First row of every code on a page; attribute rows come before text rows.

    The sibling form keeps repeats, so there the position is part of the key.
    """
    repeat = F.when(F.col("kind") == "sibling", F.col("pos"))
    return first_rows(offers.withColumn("_repeat", repeat), ["source", "url", "code", "_repeat"], [F.col("pos")])


def split_failed_pages(captures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delivered captures, and one error row (source, error) for each with an HTTP status that is none of 200 to 299.

    Captures without a ``status`` column, and a null status, count as delivered.
    """
    if "status" not in captures.columns:
        return captures, captures.limit(0).select("source", F.lit("").alias("error"))
    status = F.col("status").cast("int")
    failed = F.coalesce(~status.between(200, 299), F.lit(False))
    errors = captures.filter(failed).select("source", _page_error(F.concat(F.lit("HTTP "), status.cast("string"))))
    return captures.filter(~failed), errors


def _page_error(reason: Column) -> Column:
    return F.concat_ws(": ", "slug", reason).alias("error")


def dead_letters(elements: DataFrame) -> DataFrame:
    """Pages that could not be parsed, to be looked at again: source, url, slug, reason."""
    return elements.filter(F.col("kind") == "error").select("source", "url", "slug", F.col("text").alias("reason"))


def page_faults(elements: DataFrame) -> DataFrame:
    """One error row (source, error) for each page that could not be parsed."""
    return dead_letters(elements).select("source", _page_error(F.col("reason")))


def extract_page_offers(
    captures: DataFrame, profiles: dict[str, PageProfile] = PAGES
) -> tuple[DataFrame, DataFrame]:
    """Offers and error rows of stored pages (source, url, slug, html; status if there is one).

    Error rows tell of pages that were not delivered, that are challenges, or that could not be parsed. Offers and
    errors each parse the pages when they are run; ``plans.collect.collect_pages`` parses once for both.
    """
    readable, errors = readable_pages(captures, profiles)
    elements = page_elements(readable, profiles)
    return element_offers(elements, profiles), errors.unionByName(page_faults(elements))


def readable_pages(captures: DataFrame, profiles: dict[str, PageProfile] = PAGES) -> tuple[DataFrame, DataFrame]:
    """Pages worth parsing, and error rows of the others; nothing is parsed for it."""
    delivered, failed = split_failed_pages(captures)
    readable, blocked = split_blocked_pages(delivered, profiles)
    return readable, failed.unionByName(blocked)


def element_offers(elements: DataFrame, profiles: dict[str, PageProfile] = PAGES) -> DataFrame:
    """Raw offers of ``page_elements``."""
    sources = list(profiles)

    def usable(code: Column) -> Column:
        return F.when((F.col("kind") == "sibling") | is_valid_code(code), code)

    second_pass = F.when(F.col("kind") == "attribute", F.lit(0)).otherwise(F.lit(1))
    found = (
        elements.filter(~F.col("kind").isin("page", "error"))
        .withColumn("code", present(let(element_code(sources, profiles), usable)))
        .select(
            _per_source(sources, lambda source: F.lit(SOURCE_RANK.get(source, len(SOURCE_RANK)))).alias("source_rank"),
            F.coalesce("slug", F.lit("")).alias("page_key"),
            (second_pass.cast("long") * F.lit(1 << 40) + F.col("pos")).alias("pos"),
            "code",
            page_heading(sources).alias("store_name"),
            F.left(trim_all(F.col("description")), F.lit(DESCRIPTION_CHARS)).alias("description"),
            "source",
            "slug",
            "url",
            F.col("kind"),
        )
    )
    offers = dedupe_page(found).withColumn("type", offer_type(F.col("description")))
    return as_raw_offers(resolve_domain_text(resolve_domain_slug(offers)))
