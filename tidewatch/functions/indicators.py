"""Indicators in text: bring masked ones back, mask them, tell their kind, find them; and names that imitate brands."""

from __future__ import annotations

import ipaddress
import itertools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ip, names

#: Rewrites that undo the masking of indicators, in order.
REFANG = (
    (r"(?i)\bh(?:xx|\*\*)p(s?)\b", "http$1"),
    (r"(?i)\bfxp\b", "ftp"),
    (r"(?i)\s?[\[({]\s?(?:\.|dot)\s?[\])}]\s?", "."),
    (r"(?i)\s?[\[({]\s?(?:@|at)\s?[\])}]\s?", "@"),
    (r"[\[({]\s?:\s?[\])}]", ":"),
    (r"[\[({]\s?://\s?[\])}]", "://"),
    (r"[\[({]\s?/\s?[\])}]", "/"),
)


def refang(text: Column) -> Column:
    for pattern, put in REFANG:
        text = F.regexp_replace(text, pattern, put)
    return text


def defang(text: Column, kind: Column) -> Column:
    """The indicator such that nothing makes a link of it."""
    dotted = F.regexp_replace(text, r"\.", "[.]")
    url = F.regexp_replace(F.regexp_replace(text, r"^(?i)http", "hxxp"), r"\.", "[.]")
    return F.when(kind == "url", url).when(kind == "email", F.regexp_replace(dotted, "@", "[@]")).when(kind.isin("ipv4", "ipv6", "domain"), F.when(kind == "ipv6", F.regexp_replace(text, ":", "[:]")).otherwise(dotted)).otherwise(text)


#: Kinds in the order in which they are tested; each expression must match the whole.
KINDS = (
    ("url", r"(?i)^(?:https?|ftp)://[^\s]+$"),
    ("email", r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$"),
    ("ipv4", ip.IPV4),
    ("ipv6", r"(?i)^(?=.*:.*:)[0-9a-f:]{2,39}$"),
    ("cve", r"(?i)^CVE-[0-9]{4}-[0-9]{4,7}$"),
    ("asn", r"(?i)^AS[0-9]{1,10}$"),
    ("md5", r"(?i)^[0-9a-f]{32}$"),
    ("sha1", r"(?i)^[0-9a-f]{40}$"),
    ("sha256", r"(?i)^[0-9a-f]{64}$"),
    ("domain", r"(?i)^(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,24}$"),
)
#: Ends of file names that look like domains.
NOT_ZONES = ("exe", "dll", "yaml", "yml", "json", "txt", "pdf", "png", "jpg", "gif", "html", "js", "css", "zip", "log", "py", "sh", "conf")


def kind_of(text: Column) -> Column:
    """url, email, ipv4, ipv6, cve, asn, md5, sha1, sha256, domain, or null."""
    out = None
    for kind, pattern in KINDS:
        test = text.rlike(pattern)
        if kind == "domain":
            test = test & ~F.lower(F.substring_index(text, ".", -1)).isin(*NOT_ZONES)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out


_TOKEN = r"(?i)(?:https?|ftp)://[^\s\"'<>]+|[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|CVE-[0-9]{4}-[0-9]{4,7}|[A-Za-z0-9][A-Za-z0-9.:-]*[A-Za-z0-9]"


def find(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows without the text, one row per distinct indicator of it: place (from 0), kind, value.

    The text is unmasked first. Tokens are taken from left to right, the longer kinds first, so that a domain inside a
    URL or an address is no indicator of its own. Hosts of URLs are not listed apart.
    """
    tokens = F.regexp_extract_all(refang(F.coalesce(F.col(text), F.lit(""))), F.lit(_TOKEN), F.lit(0))
    trimmed = F.array_distinct(F.transform(tokens, lambda t: F.regexp_replace(t, r"[.,;:!?)]+$", "")))
    typed = F.filter(F.transform(trimmed, lambda t: F.struct(kind_of(t).alias("kind"), t.alias("value"))), lambda x: x["kind"].isNotNull())
    return rows.select(*(c for c in rows.columns if c != text), F.posexplode(typed).alias("place", "x")).select("*", "x.*").drop("x")


#: Kinds of spans in the order in which they claim their places. Expressions read alike in Python, Java and RE2.
CLAIMS = (
    ("url", r"\b(?:[Hh][Tt][Tt][Pp][Ss]?|[Ff][Tt][Pp])://[^\s<>\"'`{}|^\\]+"),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("hash", r"\b[0-9A-Fa-f]{32,128}\b"),
    ("cve", r"\b[Cc][Vv][Ee]-[0-9]{4}-[0-9]{4,7}\b"),
    ("ipv4", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"),
    ("ipv6", r"\b[0-9A-Fa-f]{1,4}:[0-9A-Fa-f:]{3,34}\b"),
    ("domain", r"\b(?:[A-Za-z0-9][A-Za-z0-9-]{0,62}\.)+[A-Za-z]{2,24}\b"),
)
#: Kinds of hashes by length.
HASHES = {32: "md5", 40: "sha1", 64: "sha256"}
MOST_CLAIMS = 500


def _named(kind: str, text: str) -> tuple[str, str] | None:
    """Kind and value of a claimed span, or nothing where it claims its place only."""
    if kind == "url":
        text = text.rstrip(".,;:!?)]")
        return (kind, text) if len(text.partition("://")[2]) else None
    if kind == "hash":
        return (HASHES[len(text)], text.lower()) if len(text) in HASHES else None
    if kind == "email":
        local, _, host = text.rpartition("@")
        return kind, f"{local}@{host.lower()}"
    if kind == "ipv4":
        return (kind, ".".join(str(int(x)) for x in text.split("."))) if max(map(int, text.split("."))) < 256 else None
    if kind == "ipv6":
        try:
            return kind, ipaddress.IPv6Address(text).compressed
        except ValueError:
            return None
    return (kind, text.upper()) if kind == "cve" else (kind, text.lower())


def claimed(text: str, most: int = MOST_CLAIMS) -> list[dict]:
    """place, kind and value of the distinct indicators of a text, by place."""
    taken, found = bytearray(len(text)), []
    for kind, pattern in _PATTERNS:
        for m in pattern.finditer(text):
            at, end = m.span()
            if kind == "domain" and m[0].rpartition(".")[2].lower() in NOT_ZONES:
                continue
            if not any(taken[at:end]):
                taken[at:end] = b"\1" * (end - at)
                if named := _named(kind, m[0]):
                    found.append((at, *named))
    first: dict[tuple[str, str], int] = {}
    for at, kind, value in sorted(found):
        first.setdefault((kind, value), at)
    return [{"place": at, "kind": kind, "value": value} for (kind, value), at in itertools.islice(first.items(), most)]


_PATTERNS = [(kind, re.compile(pattern, re.ASCII)) for kind, pattern in CLAIMS]


def claims(rows: DataFrame, text: str = "text", most: int = MOST_CLAIMS) -> DataFrame:
    """rows without the text, one row per distinct indicator of it: place (of its first character), kind, value.

    The text is unmasked first. Spans of all kinds are found in the whole text; in the order of CLAIMS each takes its place
    unless a part of it is taken, so that a domain inside a URL, or an address inside a longer number, is none of its own.
    Spans that turn out to be no indicator still hold their place; names of files hold none. Of equal indicators the
    first counts, and of all the first `most` by place: a parameter, as readers take so many. Null texts have none.
    """
    columns = [c for c in rows.columns if c != text]
    schema = T.StructType([*(rows.schema[c] for c in columns), T.StructField("place", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [claimed(t, most) if t else [] for t in b.column("_text").to_pylist()]
            place = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
            new = [pa.array([x[n] for f in found for x in f], k) for n, k in (("place", pa.int32()), ("kind", pa.string()), ("value", pa.string()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(place) for c in columns), *new], names=[*columns, "place", "kind", "value"])

    return rows.select(*columns, refang(F.col(text)).alias("_text")).mapInArrow(run, schema)


BRANDS = ("paypal", "google", "amazon", "microsoft", "apple", "netflix", "facebook", "instagram", "linkedin", "dropbox", "github", "spotify")
_LIKE = ("013$@", "olesa")


def skeleton(token: Column) -> Column:
    """The token with characters that look alike folded."""
    return F.regexp_replace(F.regexp_replace(F.translate(F.lower(token), *_LIKE), "rn", "m"), "vv", "w")


def _near(brand: str) -> Callable[[Column], Column]:
    head, tail = brand[: len(brand) // 2], brand[len(brand) // 2 :]  # one edit leaves one of them as it is
    return lambda t: (t["folded"] == brand) | ((F.length(t["text"]) > 4) & (t["text"].startswith(head) | t["text"].endswith(tail)) & (F.levenshtein(t["text"], F.lit(brand), 1) == 1))


def imitated_brand(host: Column) -> Column:
    """The brand that a part of a host's registered name imitates: folded or one edit away, but not the brand's own; or null."""

    def imitated(own: Column) -> Column:
        tokens = F.transform(F.split(own, "-"), lambda t: F.struct(t.alias("text"), skeleton(t).alias("folded")))
        return names.once(tokens, lambda ts: F.coalesce(*(F.when(F.exists(ts, _near(brand)) & (own != brand), brand) for brand in BRANDS)))

    return names.once(host, lambda h: names.once(F.split(names.registered_domain(h), r"\.")[0], imitated))


#: Hosts that only forward, by the parameter that holds the true address.
REDIRECTORS = (("www.google.com", "q"), ("l.facebook.com", "u"), ("out.reddit.com", "url"), ("slack-redir.net", "url"), ("safelinks.protection.outlook.com", "url"))


def unwrap(url: Column) -> Column:
    """The address that a forwarding link leads to, or the link itself."""

    def led(host: Column) -> Column:
        out = url
        for end, key in REDIRECTORS:
            inner = F.try_url_decode(F.regexp_extract(url, rf"[?&]{key}=([^&#]+)", 1))
            out = F.when(((host == end) | host.endswith("." + end)) & (inner != ""), inner).otherwise(out)
        return out

    return names.once(names.host_of(url), led)


def link_flags(url: Column) -> Column:
    """What speaks against a link: ip_literal, userinfo, punycode, lookalike, shortener, unwrapped."""

    def flags(host: Column) -> Column:
        return F.array_compact(
            F.array(
                F.when(host.rlike(ip.IPV4), "ip_literal"),
                F.when(url.rlike(r"^[A-Za-z]+://[^/?#]*@"), "userinfo"),
                F.when(host.rlike(r"(^|\.)xn--"), "punycode"),
                F.when(imitated_brand(host).isNotNull(), "lookalike"),
                F.when(host.isin("bit.ly", "t.co", "tinyurl.com", "goo.gl", "is.gd", "ow.ly"), "shortener"),
                F.when(unwrap(url) != url, "unwrapped"),
            )
        )

    return names.once(names.host_of(url), flags)
