"""Predicates over responses, headers, addresses and bytes."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteledger.functions.text import WIDE_SPACE, compact, trim_wide

# The known interstitial's title, and address blocks that are not public.
CHALLENGE_TITLE = r"(?i)^KillBot user verification(?:\s+\[[^\]\r\n]*\])*(?:\.{3})?$"
DENIED_V6 = ("2001::/23", "2001:db8::/32", "2002::/16")
GLOBAL_V6 = "2000::/3"
CSP_DIRECTIVES = "default-src base-uri object-src frame-ancestors form-action script-src style-src"


def public_ipv4(ip: Column) -> Column:
    part = F.split(ip, r"\.")
    a, b, c = (F.try_element_at(part, F.lit(i)).cast("int") for i in (1, 2, 3))
    denied = (
        a.isin(0, 10, 127)
        | (a >= 224)
        | ((a == 100) & b.between(64, 127))
        | ((a == 169) & (b == 254))
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & ((b == 168) | ((b == 0) & c.isin(0, 2))))
        | ((a == 198) & (b.isin(18, 19) | ((b == 51) & (c == 100))))
        | ((a == 203) & (b == 0) & (c == 113))
    )
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    return F.when(ip.rlike(rf"^{octet}(?:\.{octet}){{3}}$"), ~denied).otherwise(False)


@F.pandas_udf(T.BooleanType())
def public_ipv6(ip: pd.Series) -> pd.Series:
    inside, denied = ipaddress.ip_network(GLOBAL_V6), [ipaddress.ip_network(n) for n in DENIED_V6]

    def one(text: str | None) -> bool:
        try:
            address = ipaddress.IPv6Address(text)
        except ValueError:
            return False
        return address in inside and not any(address in n for n in denied)

    return ip.map(one).astype(bool)


def public_address(ip: Column) -> Column:
    return F.when(ip.contains(":"), public_ipv6(ip)).otherwise(public_ipv4(ip))


def access_challenge(headers: Column, title: Column) -> Column:
    """struct(provider, reason, signal) of a recognised challenge, else null."""
    mitigated = F.lower(F.trim(headers["cf-mitigated"])) == "challenge"
    reason = F.lit("ACCESS_CHALLENGE").alias("reason")
    return F.when(mitigated, F.struct(F.lit("Cloudflare").alias("provider"), reason, F.lit("cf-mitigated: challenge").alias("signal"))).when(
        trim_wide(title).rlike(CHALLENGE_TITLE), F.struct(F.lit("KillBot").alias("provider"), reason, F.lit("known KillBot user verification document title").alias("signal"))
    )


def is_html(content_type: Column, body: Column) -> Column:
    typed = F.coalesce(content_type, F.lit("")).rlike(r"(?i)\b(?:text/html|application/xhtml\+xml)\b")
    marked = F.substring(body, 1, 65_536).rlike(rf"(?is)^{WIDE_SPACE}*(?:<!--.*?-->{WIDE_SPACE}*)*<(?:!doctype\s+html\b|[a-z][a-z0-9:-]*(?:\s|/?>))")
    return typed | F.coalesce(marked, F.lit(False))


def sniff_mime(content: Column) -> Column:
    """The MIME type that the first bytes stand for, else null."""
    h = F.hex(F.substring(content, 1, 16))
    at = lambda byte, n: F.substring(h, 2 * byte + 1, 2 * n)
    return (
        F.when(at(0, 8) == "89504E470D0A1A0A", "image/png")
        .when(at(0, 2) == "FFD8", "image/jpeg")
        .when(at(0, 6).isin("474946383761", "474946383961"), "image/gif")
        .when((at(0, 4) == "52494646") & (at(8, 4) == "57454250"), "image/webp")
        .when((at(4, 4) == "66747970") & at(8, 4).isin("61766966", "61766973"), "image/avif")
        .when(at(0, 5) == "255044462D", "application/pdf")
    )


def mime_of(content_type: Column) -> Column:
    bare = F.lower(trim_wide(F.substring_index(content_type, ";", 1)))
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit("application/octet-stream"))


def privacy_failures(headers: Column) -> Column:
    """Names of the rules that a demo response's headers (lower-case names) break."""
    tokens = lambda name: F.transform(F.split(F.lower(F.coalesce(headers[name], F.lit(""))), ","), lambda t: F.trim(t))
    directives = F.filter(F.transform(F.split(F.coalesce(headers["content-security-policy"], F.lit("")), ";"), lambda d: F.lower(F.substring_index(F.trim(d), " ", 1))), lambda d: d != "")
    return compact(
        F.when(~(F.array_contains(tokens("x-robots-tag"), "noindex") & F.array_contains(tokens("x-robots-tag"), "nofollow")), F.lit("robots")),
        F.when(~F.array_contains(tokens("cache-control"), "no-store"), F.lit("no-store")),
        F.when(~F.array_contains(tokens("x-content-type-options"), "nosniff"), F.lit("nosniff")),
        F.when(~F.array_contains(tokens("referrer-policy"), "no-referrer"), F.lit("referrer")),
        F.when(F.size(F.array_distinct(directives)) != F.size(directives), F.lit("csp-duplicate")),
        *[F.when(~F.array_contains(directives, name), F.lit(f"csp:{name}")) for name in CSP_DIRECTIVES.split()],
    )
