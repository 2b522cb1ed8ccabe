"""Fixed values.

Word lists, store tables, phrases and patterns that results depend on.  They are facts of the
offer sites and of the rules, not logic; the code that uses them lives in ``functions``,
``operators`` and ``sources``.
"""


def _words(text: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(text.split()))


def _pairs(text: str) -> dict[str, str]:
    rows = (line.split(" = ") for line in text.strip().splitlines())
    pairs: dict[str, str] = {}
    for key, domain in rows:
        pairs.setdefault(key.strip(), domain.strip())
    return pairs


# The order in which sources are collected.
SOURCES = _words(
    """
    hotukdeals vouchercodes ggdeals myvouchercodes savoo coupert netvouchercodes voucherbox
    codesuk latestdeals moneysavingexpert
    """
)

# White space as browsers understand it (RE2 and Java both read this class).
SPACE_SET = r"\s\x0B\p{Z}\x{FEFF}"
SPACE = f"[{SPACE_SET}]"
SPACE_CHARS = (
    " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
NOT_NEWLINE = r"[^\n\r\x{2028}\x{2029}]"

# Offer kinds with a telling word and a pattern, tried in order on lower-cased text.
OFFER_KINDS = (
    ("percentage", "%", rf"\d%{SPACE}*off"),
    ("fixed", "£", r"£\d"),
    ("free_shipping", "free", rf"free{SPACE}+(delivery|shipping)"),
    ("bogo", "buy", rf"buy{SPACE}+\d+{SPACE}+get"),
)
EXTRA_KIND = ("extra_discount", "extra", rf"extra{SPACE}+discount")

# Amounts inside descriptions.
PERCENT_OFF = rf"(?i)(\d+)%{SPACE}*off"
PERCENT_OFF_DECIMAL = rf"(?i)(\d+(?:\.\d+)?)%{SPACE}*off"
POUNDS = r"£(\d+(?:\.\d{1,2})?)"
MIN_SPEND = (
    rf"(?i)(?:min(?:imum)?{SPACE}*(?:spend|order)?{SPACE}*(?:of{SPACE}*)?"
    rf"|spend{SPACE}+(?:at{SPACE}+least{SPACE}+)?|on{SPACE}+)£(\d+(?:\.\d{{1,2}})?)"
)

# A description opening with one of these is noise.
NOISE_OPENINGS = (
    "sponsored",
    "we use cookies",
    "share this page",
    "view all",
    "travel",
    "newsletter",
    "subscribe",
    "follow us",
    "sign up",
    "login",
    "register",
    "cookie",
    "privacy",
    "terms",
)

# Words that are never a code (exact match).
COMMON_WORDS = _words(
    """
    THE AND FOR ARE BUT NOT YOU ALL CAN HER WAS ONE OUR OUT HAS HIS HOW ITS MAY NEW NOW OLD SEE
    WAY WHO DID GET LET SAY SHE TOO USE CODE FREE DEAL OFFER SAVE VIEW COPY EXCLUSIVE VERIFIED
    TESTED TODAY VALID SPONSORED ARTICLES MORE LESS BACK NEXT HOME SHOP SALE
    """
)

# Words that are never a code in a feed entry (exact match).
FEED_COMMON_WORDS = _words(
    """
    THAT THIS WITH FROM HAVE WILL BEEN THEIR WOULD COULD SHOULD ABOUT WHICH WHEN WHAT WHERE YOUR
    THEM THEN THEY SOME MORE MOST VERY ALSO JUST EACH MUCH MUST EVEN WELL CODE FOLLOWED ORIGINATES
    CDATA VALID FOR AND THE VIA WHEN BEST BLUE BOOK COME DEALS EVERY EXTRA FREE GREAT GROUP HAPPY
    HEART INDEX LARGE LEVEL LIMIT LOCAL MAJOR MATCH MATTER OFFER OTHER OFTEN ORDER PLACE POINT
    POWER PRESS PRICE PRINT PROMO PUSH RANGE READY REAL RIGHT ROUND RULES SALES SCENE SCOPE SCORE
    SENSE SERVE SHOWN SINCE SPACE SPEED SPEND STAGE START STATE STEEL STEPS STOCK STORE STORY STYLE
    TABLE TAKEN TEAMS THEME THIRD THOSE THREE THROW TOTAL TOUGH TRADE TRAIL TREAT TRUST TRUTH UNDER
    UNION UNITY UNTIL UPPER USAGE USUAL VALID VALUE VIDEO VISIT WASTE WATCH WATER WHITE WHOLE WOMAN
    WORLD WORRY WRITE YOURS AGAIN BEING BELOW CARRY FOUND HOUSE MIGHT NEVER OUGHT RIGHT SHALL SMALL
    SOUND STILL THING THINK
    """
)

# A card token opening with one of these is not a code.
STOP_PREFIXES = _words(
    """
    THE AND FOR ARE BUT NOT YOU ALL CAN GET CODE FREE DEAL OFFER SAVE VIEW COPY EXCLUSIVE VERIFIED
    TESTED TODAY VALID SPONSORED
    """
)
EXTRA_STOP_PREFIXES = {
    "myvouchercodes": _words("ARTICLES MORE LESS"),
    "savoo": _words("ARTICLES"),
    "voucherbox": _words("ARTICLES"),
    "codesuk": _words("ARTICLES"),
    "latestdeals": _words("ARTICLES POSTED COMMENTS LIKES"),
    "moneysavingexpert": _words(
        "ARTICLES MSE TIPS DEALS NEWSLETTER RECOMMENDED LINKS DISCLOSURE AFFILIATE"
    ),
}

# A store name in a feed entry ends before one of these words.
NAME_ENDINGS = _words(
    """
    with for using via by when if get save spend from code voucher discount free buy selected except
    per chance win register expected release etc minimum exclusive reward your new coupon fuel galaxy
    flip fold pixel interest worth litre exclusions exceptions
    """
)
GENERIC_NAMES = _words(
    """
    the a an in on at to for of and your new via per by instore online checkout all our get save up
    no etc
    """
)
GENERIC_FIRST_WORDS = tuple(word for word in GENERIC_NAMES if word != "etc")
NOT_A_STORE = _words(
    """
    flip fold galaxy pixel iphone expected release register interest chance voucher fuel coupon worth
    litre selected exclusion exception day week month
    """
)

# Phrases of a checkout page after a code was tried.
SUCCESS_PHRASES = (
    "code applied",
    "coupon applied",
    "discount applied",
    "promo applied",
    "voucher applied",
    "code successfully",
    "coupon successfully",
    "discount successfully",
)
FAILURE_PHRASES = (
    "invalid code",
    "expired code",
    "code not found",
    "coupon invalid",
    "coupon expired",
    "promo invalid",
    "promo expired",
    "voucher invalid",
    "voucher expired",
    "code does not exist",
    "coupon does not exist",
    "not a valid code",
    "not a valid coupon",
)

# Domains tried last when a host matches no store.
PRIORITY_DOMAINS = _words(
    """
    driffle.com player.land kinguin.net g2a.com gamivo.com k4g.com g2play.com yuplay.com
    greenmangaming.com fanatical.com gamesplanet.com gamersgate.com gamebillet.com 2game.com
    allyouplay.com loaded.com gameboost.com difmark.com hrkgame.com lootbar.gg eldorado.gg
    gameseal.com premiumcdkeys.com keycense.com playsum.com joybuggy.com nuuvem.com wingamestore.com
    store.ubisoft.com ea.com epicgames.com gog.com humblebundle.com store.steampowered.com game.co.uk
    shopto.net razerzone.com
    """
)
POOL_NAME = "Gaming Store"

# Shops most sources know, as written in running text.
SHOPS = _pairs(
    """
    amazon = amazon.co.uk
    argos = argos.co.uk
    asos = asos.com
    boohoo = boohoo.com
    currys = currys.co.uk
    john lewis = johnlewis.com
    next = next.co.uk
    very = very.co.uk
    tesco = tesco.com
    sainsburys = sainsburys.co.uk
    morrisons = morrisons.co.uk
    marks and spencer = marksandspencer.com
    new look = newlook.com
    hm = hm.com
    zara = zara.com
    sports direct = sportsdirect.com
    nike = nike.com
    adidas = adidas.co.uk
    just eat = just-eat.co.uk
    dominos = dominos.co.uk
    uber eats = ubereats.com
    deliveroo = deliveroo.co.uk
    ebay = ebay.co.uk
    shein = shein.co.uk
    dunelm = dunelm.com
    wayfair = wayfair.co.uk
    wickes = wickes.co.uk
    b&q = diy.com
    boots = boots.com
    superdrug = superdrug.com
    lookfantastic = lookfantastic.com
    myprotein = myprotein.co.uk
    halfords = halfords.com
    tui = tui.co.uk
    debenhams = debenhams.com
    samsung = samsung.com
    ao = ao.com
    booking.com = booking.com
    expedia = expedia.co.uk
    """
)

# Shops whose slug is not simply the hyphenated name.
SLUG_FORMS = {
    "b&q": "b-and-q",
    "dominos": "dominos-pizza",
    "ao": "ao-com",
    "booking.com": "booking-com",
}

# Store names of the feed, in lookup order.
FEED_STORES = _pairs(
    """
    amazon = amazon.co.uk
    argos = argos.co.uk
    asos = asos.com
    boohoo = boohoo.com
    currys = currys.co.uk
    john lewis = johnlewis.com
    next = next.co.uk
    very = very.co.uk
    tesco = tesco.com
    sainsburys = sainsburys.co.uk
    sainsbury = sainsburys.co.uk
    morrisons = morrisons.co.uk
    marks and spencer = marksandspencer.com
    m&s = marksandspencer.com
    new look = newlook.com
    hm = hm.com
    zara = zara.com
    sports direct = sportsdirect.com
    nike = nike.com
    adidas = adidas.co.uk
    just eat = just-eat.co.uk
    dominos = dominos.co.uk
    uber eats = ubereats.com
    deliveroo = deliveroo.co.uk
    ebay = ebay.co.uk
    shein = shein.co.uk
    dunelm = dunelm.com
    wayfair = wayfair.co.uk
    wickes = wickes.co.uk
    b&q = diy.com
    boots = boots.com
    superdrug = superdrug.com
    lookfantastic = lookfantastic.com
    myprotein = myprotein.co.uk
    halfords = halfords.com
    game = game.co.uk
    tui = tui.co.uk
    samsung = samsung.com
    ao = ao.com
    wowcher = wowcher.com
    groupon = groupon.co.uk
    booking = booking.com
    expedia = expedia.co.uk
    ikea = ikea.com
    apple = apple.com
    google store = store.google.com
    nintendo = nintendo.co.uk
    playstation = store.playstation.com
    xbox = microsoft.com
    steam = store.steampowered.com
    g2a = g2a.com
    kinguin = kinguin.net
    green man gaming = greenmangaming.com
    humble bundle = humblebundle.com
    fanatical = fanatical.com
    gog = gog.com
    epic games = epicgames.com
    ubisoft = store.ubisoft.com
    ea = ea.com
    razer = razer.com
    scan = scan.co.uk
    overclockers = overclockers.co.uk
    aria = aria.co.uk
    ccl = cclonline.com
    novatech = novatech.co.uk
    box = box.co.uk
    laptops direct = laptopsdirect.co.uk
    tv village = tvvillage.co.uk
    beds = beds.co.uk
    dreams = dreams.co.uk
    dfs = dfs.co.uk
    habitat = habitat.co.uk
    waitrose = waitrose.com
    ocado = ocado.com
    coop = coop.co.uk
    aldi = aldi.co.uk
    lidl = lidl.co.uk
    poundland = poundland.co.uk
    home bargains = homebargains.co.uk
    b&m = bmstores.co.uk
    primark = primark.com
    tk maxx = tkmaxx.com
    jd sports = jdsports.co.uk
    footasylum = footasylum.com
    size? = size.co.uk
    asda = asda.co.uk
    iceland = iceland.co.uk
    farmfoods = farmfoods.co.uk
    travelodge = travelodge.co.uk
    ryanair = ryanair.com
    easyjet = easyjet.com
    british airways = britishairways.com
    trainline = thetrainline.com
    national rail = nationalrail.co.uk
    hotels.com = hotels.com
    tripadvisor = tripadvisor.co.uk
    sky = sky.com
    bt = bt.com
    virgin media = virginmedia.com
    vodafone = vodafone.co.uk
    ee = ee.co.uk
    three = three.co.uk
    o2 = o2.co.uk
    giffgaff = giffgaff.com
    """
)

# Slugs of the sibling-button source.
VOUCHERCODES_STORES = _pairs(
    """
    amazon = amazon.co.uk
    asos = asos.com
    boohoo = boohoo.com
    currys = currys.co.uk
    johnlewis.com = johnlewis.com
    next = next.co.uk
    argos = argos.co.uk
    very.co.uk = very.co.uk
    tesco = tesco.com
    sainsburys = sainsburys.co.uk
    ocado = ocado.com
    morrisons = morrisons.co.uk
    marksandspencer.com = marksandspencer.com
    newlook.co.uk = newlook.com
    hm = hm.com
    zara = zara.com
    primark = primark.com
    sportsdirect.com = sportsdirect.com
    nike = nike.com
    adidas = adidas.co.uk
    booking.com = booking.com
    expedia = expedia.co.uk
    just-eat = just-eat.co.uk
    dominos.co.uk = dominos.co.uk
    ubereats.com = ubereats.com
    deliveroo = deliveroo.co.uk
    game-co-uk = game.co.uk
    shopto-net = shopto.net
    razerzone-com = razerzone.com
    ebay = ebay.co.uk
    shein = shein.co.uk
    dunelm = dunelm.com
    wayfair = wayfair.co.uk
    boots = boots.com
    superdrug = superdrug.com
    halfords = halfords.com
    ikea = ikea.com
    apple = apple.com
    samsung = samsung.com
    sky = sky.com
    bt = bt.com
    vodafone = vodafone.co.uk
    ee = ee.co.uk
    three = three.co.uk
    o2 = o2.co.uk
    """
)
# Slugs used when that source lists none.
VOUCHERCODES_SLUGS = _words(
    """
    amazon asos boohoo currys johnlewis.com next argos very.co.uk tesco sainsburys ocado morrisons
    marksandspencer.com newlook.co.uk hm zara primark sportsdirect.com nike adidas booking.com expedia
    just-eat dominos.co.uk ubereats.com deliveroo game-co-uk shopto-net razerzone-com
    """
)

# Display names of the Markdown source.
GAME_STORES = _pairs(
    """
    Driffle = driffle.com
    Player.land = player.land
    GamersGate = gamersgate.com
    K4G.com = k4g.com
    K4G = k4g.com
    G2Play = g2play.com
    Kinguin = kinguin.net
    Planetplay = planetplay.com
    Green Man Gaming = greenmangaming.com
    G2A = g2a.com
    G2A UK = g2a.com
    Ubisoft Store = store.ubisoft.com
    Yuplay = yuplay.com
    Gamebillet = gamebillet.com
    WinGameStore = wingamestore.com
    Fanatical = fanatical.com
    Gamesplanet UK = gamesplanet.com
    Gamesplanet US = gamesplanet.com
    Gamesplanet FR = gamesplanet.com
    Gamesplanet DE = gamesplanet.com
    Loaded = loaded.com
    Loaded (formerly CDKeys) = loaded.com
    GameBoost = gameboost.com
    Difmark = difmark.com
    HRKGame = hrkgame.com
    LootBar = lootbar.gg
    Eldorado.gg = eldorado.gg
    GameSeal = gameseal.com
    PremiumCDKeys = premiumcdkeys.com
    Keycense = keycense.com
    Playsum = playsum.com
    JoyBuggy = joybuggy.com
    Nuuvem = nuuvem.com
    2Game = 2game.com
    Allyouplay = allyouplay.com
    Epic Games Store = epicgames.com
    GOG = gog.com
    Humble Store = humblebundle.com
    Steam = store.steampowered.com
    EA.com Origin = ea.com
    EA Origin = ea.com
    Ubisoft = store.ubisoft.com
    GAMIVO = gamivo.com
    GameStop = gamestop.com
    Play-Asia = play-asia.com
    """
)

# Slugs used when the source without a store table lists none.
MYVOUCHERCODES_SLUGS = _words(
    """
    amazon asos boohoo currys john-lewis next argos very tesco sainsburys ocado morrisons
    marks-and-spencer new-look hm zara sports-direct nike adidas booking-com expedia just-eat
    dominos-pizza uber-eats deliveroo ebay shein dunelm wayfair wickes b-and-q boots superdrug
    lookfantastic myprotein halfords game-co-uk tui jet2holidays lastminute-com premier-inn travelodge
    ryanair easyjet samsung ao-com
    """
)


def slug_of(name: str) -> str:
    return SLUG_FORMS.get(name, name.replace(" ", "-"))


_SLUGS = {slug_of(name): domain for name, domain in SHOPS.items()}
_REGIONAL = {"amazon": "amazon-co-uk", "ebay": "ebay-co-uk"}

#: Store table per source, built from the lists above; key order is lookup order.
STORE_TABLES: dict[str, dict[str, str]] = {
    "hotukdeals": FEED_STORES,
    "vouchercodes": VOUCHERCODES_STORES,
    "ggdeals": GAME_STORES,
    "savoo": {**_SLUGS, "game": "game.co.uk", "wowcher": "wowcher.com", "groupon": "groupon.co.uk"},
    "coupert": {
        **{_REGIONAL.get(slug, slug): domain for slug, domain in _SLUGS.items()},
        "hotels-com": "hotels.com",
    },
    "netvouchercodes": {**_SLUGS, "hotels-com": "hotels.com"},
    "voucherbox": _SLUGS,
    "codesuk": _SLUGS,
    "latestdeals": {
        slug: domain for slug, domain in _SLUGS.items() if slug not in ("booking-com", "expedia")
    },
    "moneysavingexpert": SHOPS,
}

#: Slugs visited when discovery finds none.
FALLBACK_SLUGS: dict[str, tuple[str, ...]] = {
    "vouchercodes": VOUCHERCODES_SLUGS,
    "myvouchercodes": MYVOUCHERCODES_SLUGS,
    "savoo": tuple(
        f"{slug}-promo-codes" if slug == "game" else f"{slug}-discount-codes"
        for slug in STORE_TABLES["savoo"]
    ),
    "coupert": tuple(STORE_TABLES["coupert"]),
    "netvouchercodes": tuple(STORE_TABLES["netvouchercodes"]),
    "voucherbox": tuple(STORE_TABLES["voucherbox"]),
    "codesuk": tuple(STORE_TABLES["codesuk"]),
}
