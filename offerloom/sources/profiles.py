"""What differs between sources, as data: selectors, discovery rules, domain rules."""

from __future__ import annotations

from dataclasses import dataclass

from offerloom.fixed import SOURCES

SOURCE_RANK = {source: rank for rank, source in enumerate(SOURCES)}


@dataclass(frozen=True)
class Selector:
    """Elements with one of ``tags`` or a class attribute holding one of ``classes``."""

    tags: tuple[str, ...] = ()
    classes: tuple[str, ...] = ()


@dataclass(frozen=True)
class PageProfile:
    """How offers lie on the stored pages of one source."""

    attributes: tuple[str, ...] = ()
    attribute_card: Selector = Selector()
    card: Selector = Selector()
    button: Selector = Selector()
    button_card: Selector = Selector()
    sibling: Selector = Selector()
    description: Selector = Selector(("p",), ("desc", "title"))
    heading: Selector = Selector(("h1",))
    blocked: tuple[str, ...] = ()
    blocked_reason: str = ""


@dataclass(frozen=True)
class Discovery:
    """How store slugs are found: ``union`` or ``first`` over listed sitemaps, or ``flat``."""

    policy: str
    slug: str
    listed: tuple[str, ...] = ()


_CARDS = Selector(("article",), ("deal", "offer", "voucher"))
_CARDS_AND_ITEMS = Selector(("article", "li"), ("deal", "offer", "voucher"))
_CHALLENGE = ("Just a moment", "Attention Required")

# Page layouts of the sources.
PAGES: dict[str, PageProfile] = {
    "vouchercodes": PageProfile(
        sibling=Selector(classes=("code-btn",)),
        heading=Selector(("h1",), ("merchantName", "store-name")),
    ),
    "myvouchercodes": PageProfile(
        attributes=("data-code", "data-voucher-code", "data-coupon"),
        attribute_card=_CARDS_AND_ITEMS,
        card=_CARDS,
    ),
    "savoo": PageProfile(
        attributes=("data-code", "data-voucher", "data-coupon"),
        attribute_card=_CARDS_AND_ITEMS,
        card=_CARDS,
    ),
    "coupert": PageProfile(
        attributes=("data-code", "data-coupon", "data-voucher"),
        attribute_card=Selector(classes=("deal", "offer", "coupon", "voucher")),
        button=Selector(("button", "a")),
        button_card=Selector(("article", "li"), ("deal", "offer", "coupon")),
        blocked=_CHALLENGE,
        blocked_reason="Cloudflare challenge",
    ),
    "netvouchercodes": PageProfile(
        attributes=("data-code", "data-voucher-code", "data-coupon"),
        attribute_card=Selector(classes=("deal", "offer", "voucher")),
        card=_CARDS,
        blocked=("Vercel Security", "Just a moment", "Checking"),
        blocked_reason="Security checkpoint",
    ),
    "voucherbox": PageProfile(
        attributes=("data-code", "data-voucher", "data-coupon"),
        attribute_card=_CARDS_AND_ITEMS,
        card=_CARDS,
        blocked=_CHALLENGE,
        blocked_reason="Cloudflare",
    ),
    "codesuk": PageProfile(
        attributes=("data-code", "data-voucher", "data-coupon"),
        attribute_card=_CARDS_AND_ITEMS,
        card=_CARDS,
        blocked=_CHALLENGE,
        blocked_reason="Cloudflare",
    ),
    "latestdeals": PageProfile(
        card=Selector(("article",), ("deal", "voucher", "code")),
        description=Selector(("p", "h3"), ("desc", "title")),
    ),
    "moneysavingexpert": PageProfile(
        card=Selector(("article", "li", "tr"), ("deal", "offer", "voucher")),
        description=Selector(("p", "h3", "h4"), ("desc", "title")),
    ),
}

# Where the sources list their stores.
DISCOVERY: dict[str, Discovery] = {
    "vouchercodes": Discovery("union", r"vouchercodes\.co\.uk/([^/?#]+)\z", ("sitemap-merchant",)),
    "myvouchercodes": Discovery("union", r"myvouchercodes\.co\.uk/([^/?#]+)\z", ("merchants",)),
    "savoo": Discovery("union", r"savoo\.co\.uk/brands/([^/?#]+)\z", ("merchant",)),
    "coupert": Discovery("first", r"promo-code/([^/?#]+)\z", ("promo-code", "merchant", "store")),
    "netvouchercodes": Discovery("first", r"netvouchercodes\.co\.uk/([^/?#]+)\z", ("merchant", "store")),
    "codesuk": Discovery("first", r"codes\.co\.uk/([^/?#]+)\z", ("merchant", "store", "brand")),
    "voucherbox": Discovery("flat", r"voucherbox\.co\.uk/vouchers/([^/?#]+)\z"),
}

# Page address of a store slug.
URL_TEMPLATES = {
    "vouchercodes": "https://www.vouchercodes.co.uk/{slug}",
    "myvouchercodes": "https://www.myvouchercodes.co.uk/{slug}",
    "savoo": "https://www.savoo.co.uk/brands/{slug}",
    "coupert": "https://uk.coupert.com/promo-code/{slug}",
    "netvouchercodes": "https://www.netvouchercodes.co.uk/{slug}",
    "voucherbox": "https://www.voucherbox.co.uk/vouchers/{slug}",
    "codesuk": "https://codes.co.uk/{slug}",
}
PAGED_URL = "https://gg.deals/vouchers/"
