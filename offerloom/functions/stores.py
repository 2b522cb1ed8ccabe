"""Rules on stores: names from feed entries and slugs, hosts, fallback domains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerloom import fixed
from offerloom.functions.text import any_of, first_group, let, title_words, trim_all, whole_word

UNKNOWN = "Unknown"
UNKNOWN_DOMAIN = "unknown.co.uk"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, f"{fixed.SPACE}+"), lambda word: word != "")


def clean_store_name(name: Column) -> Column:
    """At most three words before the first word that belongs to a description."""
    text = F.regexp_replace(F.replace(name, F.lit("]]>"), F.lit("")), r"(?i)<!\[CDATA\[", "")

    def before_description(whole: Column) -> Column:
        before = first_group(whole, f"(?is)^(.+?){whole_word(any_of(fixed.NAME_ENDINGS))}")
        opens = whole.rlike(f"(?i)^{whole_word(any_of(fixed.NAME_ENDINGS))}")
        return F.when(opens, whole).otherwise(F.coalesce(trim_all(before), whole))

    def three_words(cut: Column) -> Column:
        words = F.slice(_words(F.regexp_replace(cut, rf"[,;:{fixed.SPACE_SET}]+\z", "")), 1, 3)
        bare = F.transform(words, lambda w: F.regexp_replace(w, r"^[,;:!?()]+|[,;:!?()]+\z", ""))
        return F.filter(bare, lambda w: w != "")

    def named(words: Column) -> Column:
        own = F.exists(words, lambda w: ~F.lower(w).isin(*fixed.GENERIC_NAMES))
        return F.when(own, F.array_join(words, " ")).otherwise(F.lit(UNKNOWN))

    return let(three_words(let(trim_all(text), before_description)), named)


def name_in_text(text: Column) -> Column:
    """What follows the first 'at', 'for' or 'on' up to a dash or the end, or null."""
    pattern = rf"(?i)(?:at|for|on){fixed.SPACE}+({fixed.NOT_NEWLINE}+?)(?:{fixed.SPACE}*[-–]|\z)"
    found = text.rlike(pattern)
    return F.when(found, trim_all(F.regexp_extract(text, pattern, 1)))


def feed_store(title: Column, link: Column) -> Column:
    """Store name from the link, else from the title, else 'Unknown'."""
    slug = first_group(link, r"/vouchers/([^/?]+)")
    from_link = clean_store_name(title_words(F.replace(slug, F.lit("-"), F.lit(" "))))
    from_title = clean_store_name(name_in_text(title))

    def known(name: Column) -> Column:
        return F.nullif(name, F.lit(UNKNOWN))

    return F.coalesce(
        F.when(slug.isNotNull(), known(from_link)), known(from_title), F.lit(UNKNOWN)
    )


def generated_domain(store_name: Column) -> Column:
    """Domain made of the first two words of a store name that no table knows."""
    lowered = trim_all(F.lower(store_name))
    words = _words(lowered)
    usable = F.filter(words, lambda w: ~w.rlike(r"^[£€$0-9,.\-%]+\z") & (F.length(w) > 1))
    slug = F.regexp_replace(F.array_join(F.slice(usable, 1, 2), ""), "[^a-z0-9]", "")
    hopeless = (
        lowered.rlike(whole_word(any_of(fixed.NOT_A_STORE)))
        | lowered.rlike("^[£€$0-9]")
        | F.coalesce(F.get(words, F.lit(0)).isin(*fixed.GENERIC_FIRST_WORDS), F.lit(False))
        | (F.length(slug) < 2)
    )
    return F.when(hopeless, F.lit(UNKNOWN_DOMAIN)).otherwise(
        F.concat(F.left(slug, F.lit(30)), F.lit(".co.uk"))
    )


def slug_to_name(slug: Column, source: str | None = None) -> Column:
    """Readable store name of a slug."""
    if source == "savoo":
        slug = strip_slug_suffix(slug)
    spaced = F.replace(slug, F.lit("-"), F.lit(" "))
    return spaced if source in ("vouchercodes", "myvouchercodes") else title_words(spaced)


def strip_slug_suffix(slug: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(slug, r"-discount-codes\z", ""), r"-promo-codes\z", "")


def clean_heading(heading: Column, source: str | None = None) -> Column:
    """Page heading as a store name; one source appends its own label to it."""
    if source != "myvouchercodes":
        return heading
    text = F.regexp_replace(heading, r"(?i)discount codes?\z", "")
    return trim_all(F.regexp_replace(text, r"(?i)voucher codes?\z", ""))


def url_host(url: Column) -> Column:
    """Lower-case host of a URL, or null."""
    return F.lower(first_group(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"))


def host_of(url: Column) -> Column:
    """Host of a URL without a leading ``www.``."""
    return F.regexp_replace(url_host(url), r"^www\.", "")
