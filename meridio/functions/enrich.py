"""Enrichment at ingest: attribution from URLs, channels, locales, devices, places, cookieless ids."""

from __future__ import annotations

import base64
import hashlib
import hmac
import re
from urllib.parse import parse_qsl, unquote, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names and domains of traffic sources, mediums, and channel names.
SEARCH_DOMAINS = ["bing.com", "duckduckgo.com", "yahoo.com", "yahoo.co.jp", "baidu.com", "yandex.com", "yandex.ru", "ecosia.org", "search.brave.com", "startpage.com", "perplexity.ai", "qwant.com", "kagi.com"]
SEARCH_SOURCES = ["google", "bing", "duckduckgo", "ddg", "yahoo", "baidu", "yandex", "ecosia", "brave", "startpage", "perplexity", "qwant", "kagi"]
SOCIAL_DOMAINS = [
    "facebook.com", "fb.com", "fb.me", "messenger.com", "instagram.com", "twitter.com", "x.com", "t.co", "linkedin.com", "lnkd.in", "tiktok.com", "pinterest.com",
    "pin.it", "reddit.com", "redd.it", "threads.net", "bsky.app", "news.ycombinator.com", "mastodon.social", "whatsapp.com", "telegram.org", "t.me",
]
SOCIAL_SOURCES = ["facebook", "fb", "instagram", "ig", "twitter", "x", "linkedin", "tiktok", "pinterest", "reddit", "threads", "bluesky", "bsky", "hackernews", "hn", "whatsapp", "telegram", "mastodon"]
VIDEO_DOMAINS = ["youtube.com", "youtu.be", "vimeo.com", "twitch.tv", "dailymotion.com"]
VIDEO_SOURCES = ["youtube", "yt", "vimeo", "twitch", "dailymotion"]
DISPLAY_MEDIUMS = ["display", "banner", "expandable", "interstitial", "cpm"]
SOCIAL_MEDIUMS = ["social", "social-network", "social-media", "sm"]
EMAIL_TOKENS = ["email", "e-mail", "e_mail", "newsletter"]
GOOGLE = r"(^google$)|((^|\.)google\.[a-z]{2,3}(\.[a-z]{2,3})?$)"
PAID = r"cp|^ppc$|^retargeting$|^paid"


def in_domain(host: Column, domains: list[str]) -> Column:
    """The host is one of the domains or under one."""
    return host.rlike(r"(^|\.)(" + "|".join(re.escape(d) for d in domains) + r")$")


def channel(referrer_domain: Column, source: Column, medium: Column, any_signal: Column) -> Column:
    """The channel, by ordered rules, of a page view; inputs are never null."""
    src, med = F.lower(source), F.lower(medium)
    search = src.isin(SEARCH_SOURCES) | in_domain(src, SEARCH_DOMAINS) | src.rlike(GOOGLE) | in_domain(referrer_domain, SEARCH_DOMAINS) | referrer_domain.rlike(GOOGLE)
    social = src.isin(SOCIAL_SOURCES) | in_domain(src, SOCIAL_DOMAINS) | in_domain(referrer_domain, SOCIAL_DOMAINS)
    video = src.isin(VIDEO_SOURCES) | in_domain(src, VIDEO_DOMAINS) | in_domain(referrer_domain, VIDEO_DOMAINS)
    paid = med.rlike(PAID)
    rules = [
        (paid & search, "Paid Search"),
        (paid & social, "Paid Social"),
        (paid & video, "Paid Video"),
        (med.isin(DISPLAY_MEDIUMS), "Display"),
        (paid, "Paid Other"),
        (search | (med == "organic"), "Organic Search"),
        (social | med.isin(SOCIAL_MEDIUMS), "Organic Social"),
        (video | (med == "video"), "Organic Video"),
        (src.isin(EMAIL_TOKENS) | med.isin(EMAIL_TOKENS), "Email"),
        (med == "affiliate", "Affiliate"),
        (referrer_domain != "", "Referral"),
        (any_signal, "Unassigned"),
    ]
    out = F.when(*rules[0])
    for condition, name in rules[1:]:
        out = out.when(condition, name)
    return out.otherwise("Direct")


UTM = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content")
DERIVED = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("pathname", "hostname", *UTM, "referrer_domain")] + [T.StructField(n, T.BooleanType()) for n in ("unresolved", "is_page")]
)
BAD_ESCAPE = re.compile(r"%(?![0-9A-Fa-f]{2})")
CONTROL = re.compile(r"[\x00-\x1f\x7f]")


def split_url(raw: str):
    """The parts of a URL, or None where it is malformed."""
    if not raw or CONTROL.search(raw):
        return None
    try:
        u = urlsplit(raw)
        _ = u.port
        host = u.hostname or ""
    except ValueError:
        return None
    if BAD_ESCAPE.search(u.path) or " " in u.netloc or BAD_ESCAPE.search(u.netloc):
        return None
    return u, host


def query_values(query: str) -> dict[str, str]:
    """First value of each parameter; parts with a bad escape or a semicolon are left out."""
    good = [p for p in query.split("&") if p and ";" not in p and not BAD_ESCAPE.search(p)]
    out: dict[str, str] = {}
    for k, v in parse_qsl("&".join(good), keep_blank_values=True, errors="surrogateescape"):
        out.setdefault(k, v.encode("utf-8", "replace").decode())
    return out


def attribution(url: str, referrer: str, pathname: str = "", hostname: str = "", utm: dict[str, str] | None = None) -> tuple:
    """Fields derived from a page's URL and referrer; given ones stay."""
    parts = split_url(url or "")
    page = parts if parts and parts[0].scheme in ("http", "https") and parts[1] else None
    values = dict(utm or {})
    host = page[1].lower() if page else ""
    path = pathname or ((unquote(page[0].path) or "/") if page else "")
    if page and page[0].query:
        found = query_values(page[0].query)
        for name in UTM:
            values[name] = values.get(name) or found.get(name, "")
    own = host if page else hostname
    domain, unresolved = "", False
    if referrer:
        r = split_url(referrer)
        domain = r[1].lower().removeprefix("www.") if r else ""
        unresolved = not domain
        if domain and own and domain == own.lower().removeprefix("www."):
            domain = ""
    return (path, hostname or host, *[values.get(n, "") or "" for n in UTM], domain, unresolved, page is not None)


@F.pandas_udf(DERIVED)
def derive_udf(url: pd.Series, referrer: pd.Series, pathname: pd.Series, hostname: pd.Series) -> pd.DataFrame:

    rows = [attribution(u or "", r or "", p or "", h or "") for u, r, p, h in zip(url, referrer, pathname, hostname, strict=True)]
    return pd.DataFrame(rows, columns=["pathname", "hostname", *UTM, "referrer_domain", "unresolved", "is_page"])


def derive(rows: DataFrame, url: str = "url", referrer: str = "referrer") -> DataFrame:
    """rows with pathname, hostname, utm columns, referrer_domain and channel ('' where the URL is no page)."""
    empty = F.lit("")
    have = lambda c: F.coalesce(F.col(c), empty) if c in rows.columns else empty
    d = rows.withColumn("__d", derive_udf(have(url), have(referrer), have("pathname"), have("hostname")))
    utm = {n: F.coalesce(F.nullif(have(n), empty), F.col(f"__d.{n}")) for n in UTM}
    d = d.withColumns({"pathname": F.col("__d.pathname"), "hostname": F.col("__d.hostname"), "referrer_domain": F.col("__d.referrer_domain")} | utm)
    signal = F.col("__d.unresolved")
    for n in UTM:
        signal = signal | (F.col(n) != "")
    return d.withColumn("channel", F.when(F.col("__d.is_page"), channel(F.col("referrer_domain"), F.col("utm_source"), F.col("utm_medium"), signal)).otherwise("")).drop("__d")


#: Derived keys and their columns in derive(), and those that only the server sets.
ATTRIBUTED = {
    "$pathname": "pathname", "$hostname": "hostname", "$referrerDomain": "referrer_domain", "$channel": "channel", "$screenSize": "screen_size",
    "$utmSource": "utm_source", "$utmMedium": "utm_medium", "$utmCampaign": "utm_campaign", "$utmTerm": "utm_term", "$utmContent": "utm_content", "$locale": "locale",
}
SERVER_ONLY = ("$referrerDomain", "$channel")


def attribute(events: DataFrame) -> DataFrame:
    """events with the derived keys in `auto` (map<string,variant>): the server's own replace the client's, the locale is written
    anew or goes, and others are written where something was derived."""
    strings = lambda k: F.coalesce(F.when(F.schema_of_variant(F.col("auto")[k]) == "STRING", F.try_variant_get(F.col("auto")[k], "$", "string")), F.lit(""))
    number = lambda k: F.coalesce(F.try_variant_get(F.col("auto")[k], "$", "bigint"), F.lit(0))
    given = {column: strings(key) for key, column in ATTRIBUTED.items() if key not in (*SERVER_ONLY, "$locale", "$screenSize")}
    work = events.select(F.struct("*").alias("__e"), "auto", strings("$url").alias("url"), strings("$referrer").alias("referrer"), *[c.alias(n) for n, c in given.items()])
    work = work.withColumns({"screen_size": screen_size(strings("$screenSize"), number("$screenWidth"), number("$screenHeight")), "locale": locale(strings("$locale"))})
    work = derive(work)
    every = F.array(*[F.struct(F.lit(key).alias("key"), F.col(column).alias("value")) for key, column in ATTRIBUTED.items()])
    written = F.map_from_entries(F.transform(F.filter(every, lambda e: F.coalesce(e["value"], F.lit("")) != ""), lambda e: F.struct(e["key"], e["value"].cast("variant"))))
    goes = lambda k, v: k.isin(*SERVER_ONLY) | ((k == "$locale") & F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False)))
    work = work.withColumn("__written", written)
    stays = F.map_filter("auto", lambda k, v: ~goes(k, v) & ~F.map_contains_key("__written", k))
    return work.withColumn("__auto", F.map_concat(stays, "__written")).select("__e.*", "__auto").drop("auto").withColumnRenamed("__auto", "auto").select(*events.columns)


def locale(raw: Column) -> Column:
    """en_us becomes en-US, zh-hans-cn becomes zh-Hans-CN."""
    parts = F.split(F.replace(F.trim(raw), F.lit("_"), F.lit("-")), "-")
    cased = F.transform(parts, lambda p, i: F.when(i == 0, F.lower(p)).when(F.length(p) == 2, F.upper(p)).when(F.length(p) == 4, F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 3)))).otherwise(F.lower(p)))
    return F.when(F.trim(raw) == "", "").otherwise(F.array_join(cased, "-"))


def screen_size(given: Column, width: Column, height: Column) -> Column:
    return F.when(given != "", given).when((width > 0) & (height > 0), F.concat_ws("x", width.cast("string"), height.cast("string"))).otherwise("")


def user_agent(ua: Column) -> Column:
    """struct(browser, browser_version, os, device, mobile) by a few patterns; unknown ones are empty."""
    rules = [("Edge", r"Edg(?:e|A|iOS)?/(\d+)"), ("Opera", r"OPR/(\d+)"), ("Samsung Internet", r"SamsungBrowser/(\d+)"), ("Firefox", r"(?:Firefox|FxiOS)/(\d+)"), ("Chrome", r"(?:Chrome|CriOS)/(\d+)"), ("Safari", r"Version/(\d+).*Safari")]
    browser, version = F.lit(""), F.lit("")
    for name, pattern in reversed(rules):
        browser = F.when(ua.rlike(pattern), name).otherwise(browser)
        version = F.when(ua.rlike(pattern), F.regexp_extract(ua, pattern, 1)).otherwise(version)
    system = F.when(ua.rlike("iPhone|iPad|iPod"), "iOS").when(ua.contains("Android"), "Android").when(ua.contains("Windows"), "Windows").when(ua.rlike("Mac OS X|Macintosh"), "macOS").when(ua.rlike("Linux|X11"), "Linux").otherwise("")
    device = F.when(ua.contains("iPad"), "iPad").when(ua.contains("iPhone"), "iPhone").when(ua.contains("Macintosh"), "Mac").otherwise("")
    mobile = ((system == "iOS") & ~ua.contains("iPad")) | ((system == "Android") & ua.contains("Mobile"))
    return F.struct(browser.alias("browser"), version.alias("browser_version"), system.alias("os"), device.alias("device"), mobile.alias("mobile"))


def geo(country: Column, region: Column, city: Column) -> Column:
    """struct(country, region, city) from a CDN's headers; codes for unknown places are empty."""
    known = F.when(F.upper(country).isin("XX", "T1") | (country == "Unknown"), "").otherwise(F.coalesce(country, F.lit("")))
    return F.struct(known.alias("country"), F.when(region == "Unknown", "").otherwise(F.coalesce(region, F.lit(""))).alias("region"), F.when(city == "Unknown", "").otherwise(F.coalesce(city, F.lit(""))).alias("city"))


def bot_score(header: Column) -> Column:
    """The server's score, 0 to 255, or null; a client's value is never used."""
    x = header.try_cast("int")
    return F.when(x.between(0, 255), x.cast("short"))


def cookieless_id(salt: bytes, project: str, ip: str, agent: str) -> str:
    mac = hmac.new(salt, "\0".join([project, ip, agent]).encode(), hashlib.sha256).digest()[:16]
    return "cookieless-" + base64.urlsafe_b64encode(mac).decode().rstrip("=")


def cookieless_ids(rows: DataFrame, salts: dict[str, bytes], now_day: str, yesterday: str) -> DataFrame:
    """Rows without a distinct_id get that of their day's salt; days but today and yesterday are dropped with a reason."""
    held = {d: s for d, s in salts.items() if d in (now_day, yesterday)}

    @F.pandas_udf("string")
    def of(day: pd.Series, project: pd.Series, ip: pd.Series, agent: pd.Series) -> pd.Series:

        return pd.Series([cookieless_id(held[d], p, i or "", a or "") if d in held else None for d, p, i, a in zip(day, project, ip, agent, strict=True)])

    day = F.date_format("occur_time", "yyyy-MM-dd")
    named = rows.withColumn("distinct_id", F.when(F.coalesce("distinct_id", F.lit("")) != "", F.col("distinct_id")).otherwise(of(day, "project_id", "ip", "user_agent")))
    return named.withColumn("drop_reason", F.when(F.col("distinct_id").isNull(), "salt_unavailable"))


def coerce(properties: Column, numbers: tuple[str, ...] = ("$bot_score",), booleans: tuple[str, ...] = ("$mobile", "$verified_bot")) -> Column:
    """map<string,string> to map<string,variant>: some keys are typed where their string parses."""
    def typed(k, v):
        as_int, as_bool = v.try_cast("bigint"), F.when(v.isin("true", "false"), v == "true")
        return F.when(k.isin(*numbers) & as_int.isNotNull(), as_int.cast("variant")).when(k.isin(*booleans) & as_bool.isNotNull(), as_bool.cast("variant")).otherwise(v.cast("variant"))

    return F.transform_values(properties, typed)
