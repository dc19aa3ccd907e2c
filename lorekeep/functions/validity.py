"""Whether names, URLs, dates and texts are valid, and keys and hashes of them. Conditions are Columns; null is not valid."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Hosts that media may come from, and image types that browsers show.
MEDIA_HOSTS = ("upload.wikimedia.org", "thumb.wikimedia.org")
WEB_RASTER = ("image/gif", "image/jpeg", "image/png", "image/webp")
SVG = "image/svg+xml"
OFFLINE_WIDTH = 1280
MOST_IMAGE_BYTES = 8 << 20
MOST_SVG_BYTES = 4 << 20
MOST_NAME_BYTES = 4096
_LABEL = "[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
# Characters that show nothing or turn the direction of text, joiners not among them.
_INVISIBLE = r"[\p{Cntrl}\x{61c}\x{200b}\x{200e}\x{200f}\x{2028}-\x{202e}\x{2060}\x{2066}-\x{206f}\x{feff}]"
_BLANK_END = r"^[\s\x{85}\p{Z}]|[\s\x{85}\p{Z}]$"
_ROLE = re.compile(r"[A-Za-z][-+./A-Za-z0-9]*")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def valid_ipv6(address: Column | str) -> Column:
    """Eight groups of up to four hex digits, the last two as an IPv4 address if so written; ``::`` once for groups of zeros."""
    a = _col(address)
    number = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    plain = F.regexp_replace(a, rf"(?<=:){number}(\.{number}){{3}}$", "0:0")
    groups = F.size(F.filter(F.split(plain, ":"), lambda g: g != ""))
    shape = plain.rlike("^(([0-9A-Fa-f]{1,4}(:[0-9A-Fa-f]{1,4})*)?::([0-9A-Fa-f]{1,4}(:[0-9A-Fa-f]{1,4})*)?|[0-9A-Fa-f]{1,4}(:[0-9A-Fa-f]{1,4}){7})$")
    return _holds(shape & F.when(plain.contains("::"), groups <= 7).otherwise(groups == 8))


def valid_external_url(url: Column | str) -> Column:
    """HTTP(S) with a host of ASCII labels or an IPv6 address, a port of 1 to 65535 if any, no user, blank, control or backslash."""
    u = _col(url)
    authority = F.regexp_extract(u, "^https?://([^/?#]*)", 1)
    bracketed = authority.startswith("[")
    host = F.when(bracketed, F.regexp_extract(authority, r"^\[([^\]]*)\](:.*)?$", 1)).otherwise(F.regexp_extract(authority, "^([^:]*(:.*(?=:))?)(:[^:]*)?$", 1))
    port = F.when(bracketed, F.regexp_extract(authority, r"^\[[^\]]*\](:.*)?$", 1)).otherwise(F.regexp_extract(authority, "(:[^:]*)?$", 1))
    name = (F.octet_length(host) <= 253) & host.rlike(rf"^{_LABEL}(\.{_LABEL})*$")
    number = F.regexp_extract(port, "^:0*([0-9]{1,5})$", 1)
    right_port = (port == "") | (port.rlike("^:[0-9]+$") & F.coalesce(F.when(number != "", number.cast("int")).between(1, 65535), F.lit(False)))
    whole = F.when(bracketed, authority.rlike(r"^\[[^\]]*\](:.*)?$") & valid_ipv6(host)).otherwise(name)
    return _holds(
        u.rlike("^https?://") & ~u.rlike(r"[\s\x{85}\p{Z}\p{Cntrl}\\]") & (authority != "") & ~authority.rlike("[@%]") & whole & right_port
    )


def valid_mime(mime: Column | str) -> Column:
    return _holds(_col(mime).rlike(r"^[A-Za-z0-9-]+/[A-Za-z0-9._+-]+$"))


def valid_label(label: Column | str) -> Column:
    """A category's label: some text of at most 4096 bytes, trimmed, nothing invisible."""
    v = _col(label)
    return _holds((F.length(v) > 0) & (F.octet_length(v) <= MOST_NAME_BYTES) & ~v.rlike(_BLANK_END) & ~v.rlike(_INVISIBLE))


def category_title(label: Column | str) -> Column:
    """``Category:`` and the label with spaces for underscores; null if that is not valid."""
    v = _col(label)
    name = F.replace(F.regexp_replace(v, "^Category:", ""), F.lit("_"), F.lit(" "))
    return F.when(valid_label(v) & ~v.contains("#") & (name != "") & ~name.rlike(_BLANK_END), F.concat(F.lit("Category:"), name))


def valid_dump_date(date: Column | str) -> Column:
    """A day of the calendar as YYYY-MM-DD, from the year 1 on."""
    d = _col(date)
    shaped = F.when(d.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & ~d.startswith("0000"), d)
    return F.try_to_date(shaped, "yyyy-MM-dd").isNotNull() & (F.date_format(F.try_to_date(shaped, "yyyy-MM-dd"), "yyyy-MM-dd") == shaped)


def media_url_allowed(url: Column | str) -> Column:
    """HTTPS on a media host, a path below /wikipedia/ of safe characters, nothing else."""
    u = _col(url)
    path = F.regexp_extract(u, "^https://[^/]*(/.*)$", 1)
    host = F.regexp_extract(u, "^https://([^/]*)/", 1)
    safe = path.rlike(r"^/wikipedia/[A-Za-z0-9/%\-_.,()!~']*$") & (F.length(path) <= 1024)
    return _holds(host.isin(*MEDIA_HOSTS) & safe & ~path.contains("//") & ~path.rlike(r"(?i)/(\.|%2e){1,2}(/|$)"))


def canonical_media_url(url: Column | str) -> Column:
    """An allowed media URL without its query and fragment; null for others."""
    bare = F.regexp_replace(_col(url), r"[?#].*$", "")
    return F.when(media_url_allowed(bare), bare)


def file_title_key(title: Column | str) -> Column:
    """``File:Some name.svg`` as ``Some_name.svg``."""
    return F.replace(F.trim(F.regexp_replace(_col(title), "^(File:)+", "")), F.lit(" "), F.lit("_"))


def valid_xml_text(text: Column | str) -> Column:
    """Only characters that XML 1.0 allows."""
    return _holds(~_col(text).rlike(r"[^\t\n\r\x{20}-\x{d7ff}\x{e000}-\x{fffd}\x{10000}-\x{10ffff}]"))


def has_unresolved_visual(html: Column | str) -> Column:
    """Whether a start tag has a ``background`` or a style with a CSS URL, which a sanitiser would drop without a trace."""
    tags = F.regexp_extract_all(F.lower(_col(html)), F.lit(r"<\s*([^<>!/\s][^<>]*)>"), F.lit(1))

    def hides(tag: Column) -> Column:
        bare = F.regexp_replace(tag, r"[ \t\n\r\f]", "")
        return bare.contains("background=") | (bare.contains("style=") & bare.contains("url("))

    return _holds(F.exists(tags, hides))


def attribute(tag: Column | str, name: str) -> Column:
    """A double-quoted attribute's value in a start tag, ``&quot;`` and ``&amp;`` decoded; null without it."""
    found = F.regexp_extract(_col(tag), rf'^.*? {name}="([^"]*)"', 1)
    there = _col(tag).rlike(rf' {name}="[^"]*"')
    return F.when(there, F.replace(F.replace(found, F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&")))


def interactive_maps(html: Column | str) -> Column:
    """The map frames of a page in order: lat, lon, zoom (null out of bounds), width, height (300 without a size), groups."""
    tags = F.regexp_extract_all(_col(html), F.lit(r'<a [^>]*class="(?:[^"]*\s)?mw-kartographer-map(?:\s[^"]*)?"[^>]*>'), F.lit(0))

    def frame(tag: Column) -> Column:
        lat, lon, zoom = (attribute(tag, f"data-{n}") for n in ("lat", "lon", "zoom"))
        sides = (attribute(tag, f"data-{n}").try_cast("int") for n in ("width", "height"))
        groups = F.filter(F.from_json(attribute(tag, "data-overlays"), "array<string>"), lambda g: g.rlike("^_[0-9a-f]{40}$"))
        degrees = [F.when(F.abs(v.try_cast("double")) <= most, v.try_cast("double")) for v, most in ((lat, 85.0), (lon, 180.0))]
        size = [F.when(s.between(32, 2000), s).otherwise(F.lit(300)) for s in sides]
        return F.struct(
            degrees[0].alias("lat"), degrees[1].alias("lon"), F.when(zoom.try_cast("int").between(0, 19), zoom.try_cast("int")).alias("zoom"),
            size[0].alias("width"), size[1].alias("height"), F.coalesce(groups, F.array().cast("array<string>")).alias("groups"),
        )

    return F.transform(tags, frame)


def _base36(raw: bytes) -> str:
    n, out = int.from_bytes(raw, "big"), ""
    while n:
        n, d = divmod(n, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
    return out.zfill(31)


@F.pandas_udf(StringType())
def sha1_base36(texts: pd.Series) -> pd.Series:
    """SHA-1 of a text in base 36, 31 characters: 160 bits are beyond the JVM's number functions."""
    return texts.map(lambda t: None if t is None else _base36(hashlib.sha1(t.encode()).digest()))


@F.pandas_udf(StringType())
def slots_sha1(slots: pd.Series) -> pd.Series:
    """The hash of a revision of several slots (role, text): from the first role in order on, the hash of hashes.

    Null without slots, or where a role is missing, repeated or malformed."""

    def one(rows) -> str | None:
        pairs = sorted((r["role"], r["text"]) for r in rows if r["role"] is not None) if rows is not None else []
        roles = [r for r, _ in pairs]
        if not pairs or len(set(roles)) < len(rows) or not all(_ROLE.fullmatch(r) and len(r) <= 128 for r in roles) or any(t is None for _, t in pairs):
            return None
        out = None
        for _, text in pairs:
            own = _base36(hashlib.sha1(text.encode()).digest())
            out = own if out is None else _base36(hashlib.sha1((out + own).encode()).digest())
        return out

    return slots.map(one)


def occurs_as_words(text: Column | str, claim: Column | str) -> Column:
    """Whether ``claim`` occurs in ``text`` without cutting a word at either end."""
    escaped = F.regexp_replace(_col(claim), r"([\\.\[\]{}()*+?^$|#\-&~ ])", r"\\$1")
    word = r"[\p{IsAlphabetic}\p{N}_]"
    left = F.when(_col(claim).rlike(f"^{word}"), F.lit(f"(?<!{word})")).otherwise(F.lit(""))
    right = F.when(_col(claim).rlike(f"{word}$"), F.lit(f"(?!{word})")).otherwise(F.lit(""))
    return _holds(F.regexp_like(_col(text), F.concat(left, escaped, right)))


def availability(pack_owners: Column | str, saved: Column | str, cached: Column | str, network: Column | str) -> Column:
    """Where an article is to be had: of a pack, saved, cached, online, or nowhere."""
    return (
        F.when(_col(pack_owners) > 0, "pack").when(_col(saved), "saved").when(_col(cached), "cached")
        .when(_col(network), "online").otherwise("missing")
    )


def download_choice(info: Column) -> Column:
    """(url, mime, sha1, size, fallback, fault) from an imageinfo struct (mime, width, url, thumburl, sha1, size).

    Small web images are taken as they are, and their digest is expected; small drawings too, with
    the rendering to fall back on; of all others the rendering."""
    own, thumb = canonical_media_url(info["url"]), canonical_media_url(info["thumburl"])
    sha1 = F.when(info["sha1"].rlike("^[0-9A-Fa-f]{40}$"), F.lower(info["sha1"]))
    raster = _holds(info["mime"].isin(*WEB_RASTER) & info["width"].between(1, OFFLINE_WIDTH))
    right_size = _holds(info["size"].between(1, MOST_IMAGE_BYTES))
    rendered = F.when(thumb.rlike(r"(?i)\.(png|jpe?g|gif|webp)$"), thumb)
    drawing = _holds((info["mime"] == SVG) & info["size"].between(1, MOST_SVG_BYTES) & own.rlike(r"(?i)\.svg$") & sha1.isNotNull())
    none = F.lit(None).cast("string")

    def row(url, mime=none, digest=none, size=F.lit(None).cast("long"), fallback=none, fault=none) -> Column:
        names = ("url", "mime", "sha1", "size", "fallback", "fault")
        return F.struct(*(c.alias(n) for c, n in zip((url, mime, digest, size, fallback, fault), names)))

    kept = row(own, info["mime"], sha1, info["size"])
    return (
        F.when(raster & (own.isNull() | sha1.isNull()), row(none, fault=F.lit("no usable url")))
        .when(raster & ~right_size, row(none, fault=F.lit("too large")))
        .when(raster, kept)
        .when(rendered.isNull(), row(none, fault=F.lit("no usable url")))
        .when(drawing, row(own, F.lit(SVG), sha1, info["size"], rendered))
        .otherwise(row(rendered))
    )
