"""Exact URL identities, request targets, query parameters and stable ids.

Identities are never folded: no sorting of queries, decoding of slashes or merging of spellings. A URL that has no
identity gives null with an error code, and stays in the data for review.
"""

from __future__ import annotations

import re
from unicodedata import category, normalize
from urllib.parse import quote, unquote_to_bytes

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteledger.functions.steps import bound
from siteledger.functions.text import WIDE_SPACE, let

ABSOLUTE = r"(?i)^https?://"
FORBIDDEN = r"[\x00-\x20\x7f\\]"
# Extensions of media and of page resources.
MEDIA = r"(?i)\.(?:jpe?g|png|gif|webp|avif|svg|ico|css|js|woff2?|ttf|zip|mp4|webm|pdf|docx?|xlsx?)$"
RESOURCE = r"(?i)\.(?:jpe?g|png|gif|webp|avif|svg|ico|css|js|woff2?|ttf|zip|mp4|webm)$"

# Path segments, query names and routes that act on a shop or lead to an account.
ACTION_SEGMENTS = ("cart", "checkout", "payment", "payments", "order", "orders", "wishlist", "compare", "api", "add", "remove", "delete")
ACCOUNT_SEGMENTS = ("admin", "local", "login", "logout", "register", "account")
ACTION_KEYS = ("action", "do", "act", "add", "remove", "delete", "submit", "checkout", "logout", "login", "payment", "order", "quantity", "cart", "token", "sessid", "csrf", "csrf_token")
ACTION_ROUTES = ("account", "checkout", "payment", "api", "tool", "cart", "compare", "wishlist")
#: Path roots that no route may take; callers add those of their own target.
RESERVED_ROOTS = ("local", "upload", ".well-known")


def alternatives(words: tuple[str, ...]) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


SAFE_PATH_BAR = rf"(?i)(?:^|/)(?:{alternatives(ACTION_SEGMENTS)}|{alternatives(ACCOUNT_SEGMENTS)})(?:[/.]|$)"
PROTECTED_PATH = rf"(?i)(?:^|/)(?:{alternatives(ACCOUNT_SEGMENTS)}|auth|private)(?:[/.]|$)"
ACTION_PATH = rf"(?i)(?:^|/)(?:{alternatives(ACTION_SEGMENTS)}|\.write_feed)(?:[/.]|$)"


def origin_of(url: Column) -> Column:
    """scheme://host[:port] of an absolute URL: lower case, default port dropped; null without a host or with user info."""
    return let(url, _origin)


def _origin(url: Column) -> Column:
    scheme = F.lower(F.regexp_extract(url, r"(?i)^(https?)://", 1))
    host = F.lower(F.regexp_extract(url, r"(?i)^https?://([^/?#]*)", 1))
    bare = F.regexp_replace(F.regexp_replace(host, F.when(scheme == "http", ":80$").otherwise(":443$"), ""), ":$", "")
    fits = lambda b: b.rlike(r"^[^@:\s]+(:\d{1,5})?$") & ~b.rlike(r"[^\x21-\x7e]")
    return F.when(url.rlike(ABSOLUTE), let(bare, lambda b: F.when(fits(b), F.concat(scheme, F.lit("://"), b))))


def encode_target(target: Column) -> Column:
    """Characters outside printable ASCII become UTF-8 percent escapes; everything else keeps its spelling."""
    letters = F.transform(F.split(target, ""), lambda c: F.when(c.rlike(r"[^\x21-\x7e]"), F.url_encode(c)).otherwise(c))
    return F.when(target.rlike(r"[^\x21-\x7e]"), F.concat_ws("", letters)).otherwise(target)


def identity(raw: Column) -> Column:
    """struct(raw_url, origin, request_target, crawl_key, fragment, error) of an absolute URL, without Python.

    Each part is worked out once a URL, however often the others use it.
    """
    return let(raw, _identity)


def _identity(raw: Column) -> Column:
    suffix = F.regexp_extract(raw, r"(?i)^https?://[^/?#]+([^#]*)", 1)
    rooted = lambda s: F.when(s == "", F.lit("/")).when(s.startswith("?"), F.concat(F.lit("/"), s)).otherwise(s)
    target = let(let(suffix, rooted), encode_target)
    bad = raw.isNull() | raw.rlike(FORBIDDEN) | ~raw.rlike(ABSOLUTE)

    def named(p: Column) -> Column:
        ok = lambda c: F.when(~p["bad"] & p["origin"].isNotNull(), c)
        error = F.when(p["bad"] | p["origin"].isNull(), F.lit("INVALID_URL"))
        return F.struct(ok(raw).alias("raw_url"), ok(p["origin"]).alias("origin"), ok(p["target"]).alias("request_target"), ok(F.concat(p["origin"], p["target"])).alias("crawl_key"), ok(F.regexp_extract(raw, "(#.+)$", 1)).alias("fragment"), error.alias("error"))

    return let(F.struct(bad.alias("bad"), origin_of(raw).alias("origin"), target.alias("target")), named)


#: The authority of an absolute URL that is not plain ASCII, or holds an escape.
WIDE_HOST = r"(?i)^https?://([^/?#]*(?:[^\x00-\x7f]|%)[^/?#]*)"
# What no host may hold, what a host is read without, and what is read as a full stop.
_HOST_BARS = re.compile(r"[\x00-\x20#/:<>?@\[\]\\^`{|}%\x7f]")
_HOST_DROPS = re.compile("[\u00ad\u034f\u180b-\u180d\u200b\u2060\u2064\ufe00-\ufe0f\ufeff]")
_HOST_STOPS = re.compile("[\u3002\uff0e\uff61]")


def ascii_host(host: str | None) -> str | None:
    """A host in lower-case ASCII: compatibility forms are mapped and each wide label is written in Punycode; None if it has none."""
    if host is None:
        return None
    try:
        wide = unquote_to_bytes(host).decode()
        wide = _HOST_STOPS.sub(".", normalize("NFKC", normalize("NFKC", _HOST_DROPS.sub("", wide)).lower()))
        labels = []
        for label in wide.split("."):
            if label.startswith("xn--"):
                plain = label[4:].encode().decode("punycode")
                if plain.isascii() or normalize("NFKC", plain.lower()) != plain:
                    return None
            elif not label.isascii():
                if category(label[0])[0] == "M" or any(category(c) in ("Cc", "Cn", "Co", "Cs") for c in label):
                    return None
                label = "xn--" + label.encode("punycode").decode()
            labels.append(label)
    except (UnicodeError, ValueError, OverflowError):
        return None
    out = ".".join(labels)
    return None if not out.strip(".") or _HOST_BARS.search(out) else out


@F.pandas_udf(T.StringType())
def _ascii_hosts(host: pd.Series) -> pd.Series:
    return pd.Series([ascii_host(h) for h in host], dtype=object)


def with_identity(rows: DataFrame, url: str, name: str = "identity") -> DataFrame:
    """Adds the identity of a URL column, international hosts included; raw_url stays as it was spelled.

    Only the distinct hosts outside ASCII pass through Python; each is mapped once and joined to the rows that have it.
    """
    authority = F.when(F.col(url).rlike(WIDE_HOST), F.regexp_extract(url, WIDE_HOST, 1))
    wide = rows.select(authority.alias("_authority")).filter("_authority is not null").distinct()
    # Rows of plain hosts match nothing; each gets a key of its own, so that they are dealt evenly.
    plain = F.concat(F.lit("/"), F.pmod(F.xxhash64(url), F.lit(4096)).cast("string"))
    port = F.regexp_extract("_authority", r"(:[0-9]*)$", 1)
    bare = F.when(~F.col("_authority").contains("@"), F.regexp_replace("_authority", r":[0-9]*$", ""))
    mapped = wide.select("_authority", F.concat(_ascii_hosts(bare), port).alias("_ascii"))
    joined = rows.withColumn("_authority", F.coalesce(authority, plain)).join(mapped, "_authority", "left")
    rest = F.regexp_extract(url, r"(?i)^https?://[^/?#]*(.*)$", 1)
    spelled = F.when(authority.isNull(), F.col(url)).otherwise(F.concat(F.regexp_extract(url, "(?i)^(https?://)", 1), F.col("_ascii"), rest))
    me = identity(spelled)
    me = F.when(me["error"].isNull(), me.withField("raw_url", F.col(url))).otherwise(me.withField("error", F.lit("INVALID_URL")))
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], me.alias(name))


def remove_dot_segments(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")[1:]
    for k, part in enumerate(parts):
        low, last = part.lower().replace("%2e", "."), k == len(parts) - 1
        if low == "..":
            if out:
                out.pop()
            if last:
                out.append("")
        elif low == ".":
            if last:
                out.append("")
        else:
            out.append(part)
    return "/" + "/".join(out)


def resolve_one(raw: str | None, base: str | None) -> str | None:
    """A reference against an absolute base, as browsers do it for HTTP(S); None if that gives no HTTP(S) URL."""
    if raw is None or base is None or "://" not in base:
        return None
    scheme, _, rest = base.partition("://")
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    authority, tail = rest[:cut], rest[cut:].split("#")[0]
    path, mark, query = tail.partition("?")
    path = path or "/"
    head = raw.split("/")[0].split("?")[0].split("#")[0]
    if ":" in head:
        return raw if raw.lower().startswith(("http://", "https://")) else None
    body, hash_, fragment = raw.partition("#")
    if body.startswith("//"):
        return f"{scheme}:{raw}"
    if not body:
        new = path + mark + query
    elif body.startswith("?"):
        new = path + body
    else:
        own, mark, query = body.partition("?")
        new = remove_dot_segments(own if own.startswith("/") else path.rpartition("/")[0] + "/" + own) + mark + query
    encoded = quote(new, safe="/?:@!$&'()*+,;=%[]~-._|^`{}<>\"") if not new.isascii() else new
    return f"{scheme}://{authority}{encoded}{hash_}{fragment}"


@F.pandas_udf(T.StringType())
def resolve_relative(raw: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([resolve_one(r, b) for r, b in zip(raw, base, strict=True)], dtype=object)


def resolve(raw: Column, base: Column) -> Column:
    """The absolute spelling of a reference: built-in for absolute and plain rooted ones, the helper for the others."""
    rooted = raw.rlike(r"^/(?!/)") & ~raw.rlike(r"(?i)/(?:\.|%2e){1,2}(?:[/?#]|$)")
    origin = F.regexp_extract(base, r"(?i)^(https?://[^/?#]*)", 1)
    return F.when(raw.rlike(FORBIDDEN), F.lit(None).cast("string")).when(raw.rlike(ABSOLUTE), raw).when(rooted & (origin != ""), F.concat(origin, raw)).otherwise(resolve_relative(raw, base))


def hash_route(url: Column) -> Column:
    return F.regexp_extract(url, "(#.*)$", 1).rlike("^#[/!]")


def path_of(target: Column) -> Column:
    return F.substring_index(target, "?", 1)


def decode_path(path: Column) -> Column:
    """Percent decoding of a path: '+' stays, and what is not valid UTF-8 gives null."""
    got = F.try_url_decode(F.regexp_replace(path, r"\+", "%2B"))
    return F.when(got.contains("�") & ~path.rlike("(?i)%ef%bf%bd"), F.lit(None)).otherwise(got)


def query_parameters(target: Column) -> Column:
    """array<struct(raw, name, class)> in order, repeats kept."""
    query = F.when(target.contains("?"), F.substring_index(F.regexp_replace(target, r"^[^?]*\?", ""), "#", 1)).otherwise("")

    def one(raw: Column) -> Column:
        written = F.substring_index(raw, "=", 1)
        decoded = F.try_url_decode(written)
        name = F.when(decoded.isNull() | decoded.contains("�"), written).otherwise(decoded)
        kind = (
            F.when(name.rlike(r"(?i)^(utm_.+|gclid|yclid|fbclid)$"), "tracking")
            .when(name.rlike(r"(?i)^(page|p|PAGEN_\d+)$"), "pagination")
            .when(name.rlike(r"(?i)^(sort|order)$"), "sort")
            .when(name.rlike(r"(?i)^(variant|offer|color|size)$"), "variant")
            .otherwise("unknown-preserved")
        )
        return F.struct(raw.alias("raw"), name.alias("name"), kind.alias("class"))

    return F.when(query == "", F.array().cast("array<struct<raw:string,name:string,class:string>>")).otherwise(F.transform(F.split(query, "&"), one))


def target_error(target: Column, reserved_roots: tuple[str, ...] = RESERVED_ROOTS) -> Column:
    """Why a request target cannot be a route; null if it can."""
    decoded = decode_path(path_of(target))
    return (
        F.when(target.isNull() | (F.length(target) > 8192) | ~target.startswith("/") | target.startswith("//") | target.rlike(r"[\x00-\x20\x7f#\\]"), "INVALID_REQUEST_TARGET")
        .when(decoded.isNull() | path_of(target).rlike("%(?![0-9A-Fa-f]{2})"), "INVALID_PERCENT_ENCODING")
        .when(decoded.rlike(r"(?:^|/)\.{1,2}(?:/|$)") | decoded.rlike(r"[\x00-\x1f\\]"), "UNSAFE_ROUTE")
        .when(decoded.rlike(rf"(?i)^/(?:{alternatives(reserved_roots)})(?:/|$)") | (decoded == "/robots.txt"), "RESERVED_ROUTE_COLLISION")
    )


def acts(target: Column) -> Column:
    """Whether a query parameter names an action."""
    pairs = F.transform(F.split(F.when(target.contains("?"), F.regexp_replace(target, r"^[^?]*\?", "")).otherwise(""), "&"), lambda p: F.struct(F.try_url_decode(F.substring_index(p, "=", 1)).alias("k"), F.when(p.contains("="), F.try_url_decode(F.regexp_replace(p, "^[^=]*=", ""))).otherwise("").alias("v")))
    return F.exists(pairs, lambda p: F.coalesce(p["k"].rlike(rf"(?i)^(?:{alternatives(ACTION_KEYS)})$") | ((F.lower(p["k"]) == "route") & p["v"].rlike(rf"(?i)(?:^|/)(?:{alternatives(ACTION_ROUTES)})(?:/|$)")), F.lit(False)))


def safe_target(absolute: Column, raw: Column, origin: Column) -> Column:
    """The request target of a link that may be followed without side effects, else null. absolute: raw resolved."""
    me = identity(absolute)
    path = decode_path(path_of(me["request_target"]))
    fine = (F.regexp_replace(raw, WIDE_SPACE, "") != "") & ~raw.startswith("#") & ~raw.rlike(r"[\x00-\x20\\]") & (me["origin"] == origin) & ~F.regexp_replace(me["raw_url"], "[?#].*$", "").rlike(MEDIA) & path.isNotNull() & ~path.rlike(SAFE_PATH_BAR) & ~acts(me["request_target"])
    return F.when(fine, me["request_target"])


def with_safe_target(rows: DataFrame, href: str, page: str = "url", name: str = "request_target") -> DataFrame:
    """Adds the safe target of a reference on its page, in steps, so that no part is worked out more than once a row."""
    kept = [F.col(f"`{c}`") for c in rows.columns]
    rows = bound(rows, _absolute=resolve(F.col(href), F.col(page)), _origin=origin_of(F.col(page)))
    rows = bound(rows, _me=identity(F.col("_absolute")))
    rows = bound(rows, _path=decode_path(path_of(F.col("_me.request_target"))), _acts=acts(F.col("_me.request_target")))
    raw, path = F.col(href), F.col("_path")
    plain = (F.regexp_replace(raw, WIDE_SPACE, "") != "") & ~raw.startswith("#") & ~raw.rlike(r"[\x00-\x20\\]") & (F.col("_me.origin") == F.col("_origin"))
    fine = plain & ~F.regexp_replace(F.col("_me.raw_url"), "[?#].*$", "").rlike(MEDIA) & path.isNotNull() & ~path.rlike(SAFE_PATH_BAR) & ~F.col("_acts")
    return rows.select(*kept, F.when(fine, F.col("_me.request_target")).alias(name))


def is_media(url: Column) -> Column:
    return F.regexp_replace(url, "[?#].*$", "").rlike(MEDIA)


def stable_id(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{kind}_"), F.substring(F.sha2(key, 256), 1, 24))


def entity_key(project: Column, kind: Column, source: Column) -> Column:
    """sha256 of the JSON array of the three."""
    return F.sha2(F.to_json(F.array(project, kind, source)), 256)


def route_key(target: Column) -> Column:
    return F.sha2(target, 256)
