"""One row per branch of every rule."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from offerloom.functions import codes, descriptions, ratings, stores, text
from offerloom.operators import contains
from offerloom.operators.resolve import resolve_domain_feed, resolve_domain_name, resolve_domain_slug, resolve_domain_text


def table(column, rule, cases, schema="t string"):
    rows = [case[:-1] for case in cases]
    assert list(zip(rows, column(rule, rows, schema))) == list(zip(rows, [case[-1] for case in cases]))


def test_offer_type(column):
    table(column, descriptions.offer_type, [
        ("Get 20%  OFF today", "percentage"), ("14.1% off", "percentage"), ("£5 back", "fixed"), ("spend £ 5", "unknown"),
        ("FREE Delivery", "free_shipping"), ("free shipping", "free_shipping"), ("buy 2 get 1", "bogo"),
        ("extra discount", "unknown"), (None, "unknown"), ("£5 and 5% off", "percentage"),
    ])
    table(column, lambda t: descriptions.offer_type(t, extra_discount=True), [
        ("extra  discount", "extra_discount"), ("buy 2 get 1", "unknown"),
    ])


def test_norm_code(column):
    table(column, codes.norm_code, [
        (" ab-c_1 2 ", "ABC12"), (None, ""), ("", ""), ("é-x", "ÉX"),
    ])


def test_valid_code(column):
    table(column, codes.is_valid_code, [
        ("SAVE20", True), ("ab1", True), ("AB", False), ("ABCDEF", True), ("ABCDE", False), ("abcdefg", False), ("12345", False),
        ("EXCLUSIVE", False), ("Verified", False), (" FREE10 ", True), ("A" * 31, False), ("A" * 30, True), (None, False), ("2024", False),
    ])


def test_candidate_token(column):
    def passes(t, s):
        return codes.is_candidate_token(t, s)

    table(column, passes, [
        ("SAVE20", "savoo", False), ("WINTER", "savoo", True), ("ABC1", "savoo", True), ("ABCDE", "savoo", False), ("ALLSAINTS20", "savoo", False),
        ("ARTICLES9", "savoo", False), ("ARTICLES9", "netvouchercodes", True), ("MORE99", "myvouchercodes", False), ("MORE99", "savoo", True),
        ("MSE10OFF", "moneysavingexpert", False), ("LIKES10", "latestdeals", False), ("2024", "savoo", False), ("123456", "savoo", False),
    ], "t string, s string")


def test_first_candidate_token(column):
    table(column, codes.first_candidate_token, [
        ("use CODE or éABC12 now", "ABC12"), ("nothing", None), ("THE WINTERSALE and SUMMER1", "WINTERSALE"), ("x_ABC123", None),
        ("A" * 21 + " XY9", "XY9"),
    ])


def test_feed_code(column):
    table(column, codes.feed_code, [
        ("Code: save10 now", "", "save10"), ("code expired", "", "expired"), ("the code VALID and GREAT5X", "", None), ("a code: the GREAT5X", "", "GREAT5X"),
        ("Deal HELLO", 'use "abc9"', "abc9"), ("ABCDEF first", "", "ABCDEF"), ("ORDER", "'code'", None), ("plain words", "only", None),
        ("ABCDE XY12345", "", None),
    ], "t string, d string")


def test_clean_description(column):
    table(column, descriptions.clean_description, [
        ("20% off orders over £50", "20% off orders over"), ("10% off", "10%"), ("<![CDATA[<b>Big</b>  deal here]]>", "Big deal"),
        ("Sponsored thing", ""), ("We use cookies here", ""), ("abc", ""), ("", ""), (None, ""), ("oneword", "oneword"),
        ("x" * 250, "x" * 200), ("a" * 150 + " " + "b" * 100, "a" * 150), ("a" * 200 + " b", "a" * 200), ("a" * 201 + " b", "a" * 200),
    ])
    table(column, lambda t: descriptions.clean_description(t, intended=True), [
        ("20% off orders over £50", "20% off orders over £50"), ("a" * 150 + " " + "b" * 100, "a" * 150),
    ])


def test_amounts(column):
    def pair(t, k):
        return F.struct(descriptions.offer_value(t, k).alias("v"), descriptions.min_spend(t).alias("m"))

    cases = [
        ("20% OFF", "percentage", 20.0, None), ("14.1% off", "percentage", 1.0, None), ("spend £50 save £10.50", "fixed", 50.0, 50.0),
        ("£10.555", "fixed", 10.55, None), ("nothing", "fixed", None, None), ("min spend of £25", "bogo", None, 25.0),
        ("minimum order £9.99", "unknown", None, 9.99), ("spend at least £30", "unknown", None, 30.0), ("5% on £40", "percentage", None, 40.0),
        ("orders over £50", "fixed", 50.0, None), ("min £5", "unknown", None, 5.0),
    ]
    got = column(pair, [case[:2] for case in cases], "t string, k string")
    assert [(v.v, v.m) for v in got] == [case[2:] for case in cases]
    assert column(lambda t: descriptions.offer_value(t, F.lit("percentage"), intended=True), [("14.1% off",)], "t string") == [14.1]


def test_feed_description(column):
    table(column, descriptions.feed_description, [
        ("CODE: 20% off – today", "20% off"), ("Voucher 5% next-day", "5% next"), ("plain | x", "plain"), ("a\nb - c", "a\nb"), ("x" * 300, "x" * 200),
    ])


def test_feed_store(column):
    table(column, stores.feed_store, [
        ("x", "https://h/vouchers/john-lewis?x", "John Lewis"), ("20% off at Argos - now", "https://h/", "Argos"), ("nothing here", "", "Unknown"),
        ("5% off at the", "", "Unknown"), ("10% on Very nice little shop today", None, "Very nice little"), ("at Boots with code X", None, "Boots"),
        ("x", "https://h/vouchers/b&q", "B&Q"), ("deal at (Tesco), today", None, "Tesco today"), ("bat shop", None, "shop"),
    ], "t string, l string")


def test_generated_domains(spark):
    rows = [("Amazon", "amazon.co.uk"), ("Unknown", "unknown.co.uk"), ("The Amazon Shop", "amazon.co.uk"), ("Fee Store", "ee.co.uk"),
            ("Galaxy Zzz", "unknown.co.uk"), ("£9 Zzz", "unknown.co.uk"), ("your Zyx", "unknown.co.uk"), ("Zyx' Qwrk Pd", "zyxqwrk.co.uk"), ("q!", "unknown.co.uk")]
    got = resolve_domain_feed(spark.createDataFrame(rows, "store_name string, want string")).collect()
    assert [(r.store_name, r.store_domain) for r in got] == rows


def test_slug_and_name_domains(spark):
    rows = [("savoo", "game-promo-codes", "game.co.uk"), ("savoo", "zzz-discount-codes", "zzz.co.uk"), ("coupert", "a-b", "ab.co.uk"),
            ("coupert", "ebay-co-uk", "ebay.co.uk"), ("myvouchercodes", "booking-com", "booking-com.co.uk"), ("codesuk", "ao-com", "ao.com"),
            ("vouchercodes", "newlook.co.uk", "newlook.com"), ("netvouchercodes", "hotels-com", "hotels.com"), ("voucherbox", "x", "x.co.uk")]
    frame = spark.createDataFrame(rows, "source string, slug string, want string")
    assert [(r.source, r.slug, r.store_domain) for r in resolve_domain_slug(frame).collect()] == rows
    names = [("K4G", "k4g.com"), ("Eneba & Co", "enebaco.com"), ("Unknown", "unknown.com")]
    frame = spark.createDataFrame(names, "store_name string, want string")
    assert [(r.store_name, r.store_domain) for r in resolve_domain_name(frame).collect()] == names


def test_text_domains(spark):
    rows = [("latestdeals", "5% off at Tesco - x", "Tesco", "tesco.com"), ("latestdeals", "5% off", "Various", "unknown.co.uk"),
            ("latestdeals", "x at John Lewis", "John Lewis", "unknown.co.uk"), ("moneysavingexpert", "big b&q sale", "B&Q", "diy.com"),
            ("moneysavingexpert", "nothing", "Various", "unknown.co.uk"), ("savoo", "at Tesco", "Own", "own.co.uk")]
    frame = spark.createDataFrame([(s, d, "Own", "own.co.uk") for s, d, _, _ in rows], "source string, description string, store_name string, store_domain string")
    got = resolve_domain_text(frame).collect()
    assert [(r.source, r.description, r.store_name, r.store_domain) for r in got] == rows


def test_names_and_hosts(column):
    table(column, text.title_words, [("b&q store", "B&Q Store"), ("o'neil x_y", "O'Neil X_y"), ("", "")])
    table(column, lambda t: stores.slug_to_name(t, "savoo"), [("john-lewis-discount-codes", "John Lewis")])
    table(column, lambda t: stores.slug_to_name(t, "vouchercodes"), [("john-lewis", "john lewis")])
    table(column, lambda t: stores.clean_heading(t, "myvouchercodes"), [("Asos Discount Codes", "Asos"), ("Asos voucher code", "Asos")])
    table(column, stores.host_of, [("https://WWW.Shop.co.uk:80/a", "shop.co.uk"), ("http://u@x.y?z", "x.y"), ("nothing", None)])


def test_ratings(column):
    def rated(w, t):
        return F.concat_ws(":", ratings.rate(w, t).cast("string"), ratings.rate_class(ratings.rate(w, t)))

    table(column, rated, [(7, 10, "70:green"), (4, 10, "40:yellow"), (1, 8, "13:red"), (0, 0, ""), (0, 5, "0:red")], "w long, t long")
    now = datetime(2024, 1, 10, 12)
    table(column, ratings.age_label, [
        (datetime(2024, 1, 10, 1), now, "today"), (datetime(2024, 1, 9, 12), now, "1 day ago"), (datetime(2024, 1, 1, 13), now, "8 days ago"),
        (None, now, None), (datetime(2024, 1, 11), now, "today"),
    ], "t timestamp, a timestamp")
    table(column, ratings.outcome, [
        ("Your CODE applied", "success"), ("invalid code", "failure"), ("Invalid code. Coupon applied", "success"), ("hello", "unknown"),
    ])


def test_money(column):
    table(column, lambda t: descriptions.parse_amount(t), [("12.5abc", 12.5), (" -3", -3.0), ("x", None), (".5", 0.5), (None, None)])
    assert column(lambda a: descriptions.money(a), [(3.5,)], "a double") == ["£3.50"]


@pytest.mark.parametrize("word", ["", "a", "abcab", "abcabcabcd", "äöüäöüß"])
def test_grams(column, word):
    """Every piece of up to six characters, each once; a needle's first gram is one of them if it is contained."""
    want = {word[i:j] for i in range(len(word) + 1) for j in range(i, min(i + contains.GRAM, len(word)) + 1)}
    got = column(contains.grams, [(word,)], "t string")[0]
    assert set(got) == want and len(got) == len(want)
    needles = sorted({word[i:j] for i in range(len(word) + 1) for j in range(i, len(word) + 1)})
    assert set(column(contains.first_gram, [(n,) for n in needles], "t string")) <= want


def test_containment_takes_a_text_apart_once_and_broadcasts_no_side(spark):
    """Pieces are many times the rows they come from, so the size of the stored texts must not have them broadcast."""
    haystacks = [(f"s{n}.example.com", str(k)) for n in range(40) for k in range(4)] + [(None, "1"), ("", "2")]
    needles = [(i, text, str(i % 4)) for i, text in enumerate(["s1", "s12", "", "example", "ample.com", "s39.exa", "s7x", None])]
    frame = spark.createDataFrame(haystacks, "domain string, code string")
    asked = spark.createDataFrame(needles, "n int, label string, code string")
    met = contains.join_containing(frame, "domain", asked, "label", ["code"])
    want = sorted((d, c, n) for d, c in haystacks for n, label, code in needles if d is not None and label is not None and c == code and label in d)
    assert sorted((r.domain, r.code, r.n) for r in met.collect()) == want
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("explode(") > 0
