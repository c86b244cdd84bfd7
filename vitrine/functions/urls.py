"""Column functions on addresses: parts, resolution, image address rules and gates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.functions.text import contains_any, text

# ---- fixed values ------------------------------------------------------------------------------

COMMON_MARKERS = ["logo", "favicon", "sprite", "placeholder"]
THUMBNAIL_MARKERS = ["thumb", "thumbnail", "/small/", "_small"]
TRACKING_MARKERS = ["tracking", "pixel."]
ASSET_MARKERS = [".svg", "/header/", "/icons/", "/w48", "/w64", "/w96", "/w184"]
JUNK_MARKERS = [
    *COMMON_MARKERS, *THUMBNAIL_MARKERS, *TRACKING_MARKERS, *ASSET_MARKERS, "avatar", "icon-", "/icon/", "/flags/", "locale-flag", "/blogs/", "/category/icons/", "banner",
]
DOCUMENT_EXTENSIONS = ["pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "zip", "rar", "7z", "csv", "xml", "json"]
NON_GALLERY_HOSTS = ["psref.lenovo.com", "energystar.gov", "support.lenovo.com", "pcsupport.lenovo.com"]
NON_GALLERY_PARTS = ["/support/", "/drivers/", "/manual", "spec.pdf", "datasheet", "certificate"]
SIZE_PARAMETERS = ["width", "height", "w", "h", "quality", "q", "fit"]
IMAGE_EXTENSION = r"\.(?:jpe?g|png|webp|avif)"
NON_IMAGE_EXTENSION = r"(?i)\.(?:svg|gif|ico|pdf|html?|json|xml)(?:$|[?#])"
NON_PHOTO_MEDIA = r"(?i)(?:^|[/_.?&=-])(?:video|poster|spin|360(?:view|degree)?)(?:[/_.?&=-]|$)"
NON_PHOTO_WORDS = r"(?i)(?:logo|icon|sprite|badge|avatar|tracking|pixel|oldiemessage|/images/fb/|favicon|social)"
ACCESS_GATE_PHRASES = [
    "click the button below to continue shopping", "captcha page", "enter the characters you see below", "sorry, we just need to make sure you're not a robot", "robot check", "access denied",
]


# ---- parts -------------------------------------------------------------------------------------


def part(url: Column, name: str) -> Column:
    """A part of an address, or null where there is none or the address is malformed."""
    return F.try_parse_url(url, F.lit(name))


def raw_host(url: Column) -> Column:
    return F.lower(part(url, "HOST"))


def host(url: Column) -> Column:
    """Lower-case host, from behind its first ``www.``; empty if there is none."""
    return F.coalesce(F.regexp_replace(raw_host(url), r"^.*?www\.", ""), F.lit(""))


def origin(url: Column) -> Column:
    """Scheme, host and port."""
    return F.concat(part(url, "PROTOCOL"), F.lit("://"), part(url, "AUTHORITY"))


def extension(url: Column) -> Column:
    return F.lower(F.regexp_extract(text(part(url, "PATH")), r"\.([^./]+)$", 1))


def absolute(candidate: Column, base: Column) -> Column:
    """An address on a page made whole: as it is, by scheme, by host or by folder; no folding of ``..``."""
    scheme, place = F.coalesce(part(base, "PROTOCOL"), F.lit("https")), text(part(base, "AUTHORITY"))
    path = F.coalesce(F.nullif(part(base, "PATH"), F.lit("")), F.lit("/"))
    root = F.concat(scheme, F.lit("://"), place)
    return (
        F.when(candidate.rlike("(?i)^https?://"), candidate)
        .when(candidate.startswith("//"), F.concat(scheme, F.lit(":"), candidate))
        .when(candidate.startswith("/"), F.concat(root, candidate))
        .otherwise(F.concat(root, F.regexp_replace(path, "[^/]*$", ""), candidate))
    )


def decoded(url: Column) -> Column:
    return F.coalesce(F.try_url_decode(url), url)


# ---- gates -------------------------------------------------------------------------------------


def has_marker(url: Column, markers: list[str]) -> Column:
    return contains_any(F.lower(text(url)), markers)


def is_junk(url: Column) -> Column:
    return has_marker(url, JUNK_MARKERS)


def is_catalog_image(url: Column) -> Column:
    """An image by its extension or a size of 300 or more in its path, free of decorative markers."""
    low = F.lower(text(decoded(url)))
    return ~contains_any(low, [*COMMON_MARKERS, *ASSET_MARKERS]) & (low.rlike(IMAGE_EXTENSION + r"(?:\?|$)") | low.rlike(r"/(?:w[3-9]\d{2,}|h[3-9]\d{2,})(?:\?|/|$)"))


def is_document(url: Column) -> Column:
    return extension(url).isin(DOCUMENT_EXTENSIONS)


def is_html_source(url: Column) -> Column:
    """A page that may hold a gallery: no document, no support host, no manual."""
    low, path = F.lower(text(decoded(url))), F.lower(text(part(url, "PATH")))
    return (text(url) != "") & ~path.rlike(r"\.(?:pdf|docx?|xlsx?|csv|zip)(?:\?|$)") & ~contains_any(text(raw_host(url)), NON_GALLERY_HOSTS) & ~contains_any(low, NON_GALLERY_PARTS)


def is_html_body(body: Column, content_type: Column) -> Column:
    """Whether a response is a page: by its first 1024 signs, then by its content type."""
    prefix = F.lower(F.regexp_replace(F.substring(text(body), 1, 1024), r"^[﻿\x00\t\n\r ]+", ""))
    kind = F.lower(text(content_type))
    binary = prefix.startswith("%pdf-") | prefix.startswith('{"') | prefix.startswith("[") | prefix.startswith("pk\x03\x04")
    unsure = (kind == "") | kind.contains("application/octet-stream") | kind.contains("text/plain")
    return F.when(binary, False).when(kind.contains("text/html") | kind.contains("application/xhtml+xml"), True).when(~unsure, False).otherwise(prefix.rlike(r"^\s*(?:<!doctype\s+html|<html\b|<head\b|<body\b)"))


def is_access_gate(html: Column) -> Column:
    return contains_any(F.lower(F.regexp_replace(text(html), "<[^>]*>", "")), ACCESS_GATE_PHRASES)


def access_signal(status: Column, body: Column) -> Column:
    """Why a browser was kept out, from the status and the first 20,000 signs; null if it was not."""
    head = F.lower(F.substring(text(body), 1, 20_000))
    return F.when(status == 403, "http_403").when(head.rlike("captcha|not a robot|robot check"), "captcha").when(head.rlike("access denied|forbidden|request blocked"), "access_denied").when(head.rlike("just a moment|checking your browser|cf-challenge"), "challenge")


def octets(name: Column) -> Column:
    """The four numbers of an IPv4 literal; null for any other host."""
    ok = name.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$")
    return F.when(ok, F.transform(F.split(name, r"\."), lambda x: x.cast("int")))


def is_blocked_ipv4(name: Column) -> Column:
    """Whether an IPv4 literal lies in a private, local or reserved range."""
    o = octets(name)
    a, b = o[0], o[1]
    private = a.isin(0, 10, 127) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & b.isin(0, 168)) | ((a == 198) & b.isin(18, 19)) | (a >= 224)
    return F.coalesce(private, F.lit(False))


def is_public(url: Column) -> Column:
    """http or https on a host that is neither local nor a private address; names are not resolved."""
    name = text(raw_host(url))
    bare = F.regexp_replace(name, r"^\[|\]$", "")
    local6 = bare.rlike(r"^(?:::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|::ffff:.*)$")
    good = F.lower(text(part(url, "PROTOCOL"))).isin("http", "https") & (name != "") & (name != "localhost") & ~name.endswith(".localhost") & ~is_blocked_ipv4(name) & ~local6
    return F.coalesce(good, F.lit(False))


#: What a style selector may not hold.
UNSAFE_SELECTOR = r"(?i)(?:javascript:|https?:|file:|xpath|script\b|iframe\b)"


def is_safe_selector(selector: Column) -> Column:
    """A selector that says something and names no script, frame or address."""
    return (F.trim(text(selector)) != "") & ~text(selector).contains("\x00") & ~text(selector).rlike(UNSAFE_SELECTOR)


# ---- image addresses ---------------------------------------------------------------------------


def upgraded(url: Column) -> Column:
    """A content network's address of the large picture instead of the thumbnail."""
    u, h = F.trim(url), text(raw_host(F.trim(url)))
    scene = F.regexp_replace(F.regexp_replace(u, r"(?i)([?&])(wid|hei)=\d+", "$1$2=1500"), r"(?i)[?&]scl=\d+", "")
    return (
        F.when(h.contains("dlcdnwebimgs.asus.com"), F.regexp_replace(u, r"(?i)//w(?:48|64|96|184)(?:\?|$)", "//w800"))
        .when((h == "m.media-amazon.com") | h.endswith(".media-amazon.com"), F.regexp_replace(u, r"(?i)\._[^/]+(?=\.(?:jpe?g|png|webp)(?:$|\?))", ""))
        .when(text(part(u, "PATH")).rlike("(?i)/is/image/"), scene)
        .otherwise(u)
    )


def canonical_page(url: Column) -> Column:
    """A marketplace's product page by its ten-sign id; other addresses as they are."""
    found = F.upper(F.regexp_extract(text(part(url, "PATH")), r"(?i)/(?:dp|gp/product)/([a-z0-9]{10})(?:/|$)", 1))
    return F.when(text(raw_host(url)).rlike(r"(^|\.)amazon\.[a-z.]+$") & (found != ""), F.concat(part(url, "PROTOCOL"), F.lit("://"), part(url, "HOST"), F.lit("/dp/"), found)).otherwise(url)


def srcset_urls(srcset: Column) -> Column:
    """Addresses of a srcset, last one first."""
    return F.filter(F.transform(F.reverse(F.split(text(srcset), ",")), lambda x: F.split(F.trim(x), r"\s+")[0]), lambda x: x != "")


def image_candidate(candidate: Column, page: Column) -> Column:
    """A page's image address made whole; null for anchors, inline data and marked addresses."""
    c = F.trim(F.replace(F.replace(text(candidate), F.lit("\\/"), F.lit("/")), F.lit("&amp;"), F.lit("&")))
    low = F.lower(c)
    bad = (c == "") | c.startswith("#") | low.startswith("data:") | low.startswith("blob:") | contains_any(low, [*COMMON_MARKERS, *THUMBNAIL_MARKERS, *TRACKING_MARKERS])
    return F.when(~bad, absolute(c, page))


def browser_candidate(candidate: Column, page: Column) -> Column:
    """The same by the browser's rules: no credentials, photo size 200 or more, no other media."""
    raw = absolute(F.replace(text(candidate), F.lit("&amp;"), F.lit("&")), page)
    big = F.replace(F.replace(raw, F.lit("/multiple_images/thumbnails/"), F.lit("/multiple_images/images500x500/")), F.lit("/images/smallimages/"), F.lit("/images/images500x500/"))
    out = F.when(text(raw_host(raw)).endswith("bhphoto.com"), big).otherwise(raw)
    size = F.coalesce(F.regexp_extract(out, r"(?i)images(\d+)x\d+", 1).try_cast("int"), F.lit(0))
    ok = F.lower(text(part(out, "PROTOCOL"))).isin("http", "https") & part(out, "USERINFO").isNull() & ~((size > 0) & (size < 200)) & ~out.rlike(NON_IMAGE_EXTENSION) & ~out.rlike(NON_PHOTO_MEDIA) & ~out.rlike(NON_PHOTO_WORDS)
    return F.when(F.coalesce(ok, F.lit(False)), out)


def without_parameters(url: Column, names: list[str]) -> Column:
    """An address without some of its query parameters."""
    pattern = "|".join(map(re.escape, names))
    out = F.regexp_replace(url, rf"(?<=[?&])(?:{pattern})=[^&#]*(?:&|(?=#|$))", "")
    return F.regexp_replace(out, r"[?&](?=#|$)", "")


def asset_key(url: Column) -> Column:
    """Equal for one picture in several sizes."""
    h, path = text(raw_host(url)), text(part(url, "PATH"))
    return (
        F.when(h.endswith("bhphoto.com"), F.concat(F.lit("bh:"), F.lower(F.regexp_extract(path, "([^/]*)$", 1))))
        .when(h.endswith("media-amazon.com"), F.concat(F.lit("amazon:"), F.lower(F.regexp_replace(path, r"\._[^/]+(?=\.[^./]+$)", ""))))
        .when(path.contains("/is/image/"), F.concat(F.lit("dynamic-image:"), h, F.lower(path)))
        .otherwise(without_parameters(url, SIZE_PARAMETERS))
    )


def quality_score(url: Column) -> Column:
    """The largest picture size an address names."""
    path = text(part(url, "PATH"))
    query = lambda *names: F.coalesce(*[F.try_parse_url(url, F.lit("QUERY"), F.lit(n)).try_cast("int") for n in names], F.lit(0))
    number = lambda pattern: F.coalesce(F.regexp_extract(path, pattern, 1).try_cast("int"), F.lit(0))
    return F.greatest(number(r"(?i)images(\d+)x\d+"), query("width", "w"), query("height", "h"), number(r"\._(?:AC_)?S(?:L|X|Y)(\d+)"))


def script_image_urls(script: Column) -> Column:
    """Distinct picture addresses in script or JSON text."""
    plain = F.replace(F.replace(text(script), F.lit("\\/"), F.lit("/")), F.lit("\\u002F"), F.lit("/"))
    found = F.regexp_extract_all(plain, F.lit(r"(?i)https?://[^\"'<>\s\\]+?\.(?:jpe?g|png|webp|avif)(?:\?[^\"'<>\s\\]*)?"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda u: ~contains_any(F.lower(u), [*COMMON_MARKERS, *TRACKING_MARKERS])))


def background_urls(style: Column) -> Column:
    """Addresses in ``url(...)`` of a style."""
    return F.regexp_extract_all(text(style), F.lit(r"(?i)url\(\s*[\"']?([^\"')]+?)[\"']?\s*\)"), F.lit(1))


def media_url(disk: Column, path: Column, url: Column) -> Column:
    """Address of a stored picture: below /storage for the public disk, else the given one."""
    return F.when((disk == "public") & path.isNotNull(), F.concat(F.lit("/storage/"), F.replace(path, F.lit("\\"), F.lit("/")))).otherwise(url)
