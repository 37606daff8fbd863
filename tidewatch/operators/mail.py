"""Forensics of messages: routing, identity, authentication, links, hidden content and attachments, as columns and windows.

Messages are the parts of sources.mail; headers are looked up in the part that has part_id 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import indicators, ip, names
from tidewatch.sources import archives, pages

#: Beginnings of files by type: fixed values of those formats.
MAGIC = (
    ("exe", "4d5a"), ("elf", "7f454c46"), ("macho", "cffaedfe"), ("macho", "cafebabe"), ("pdf", "25504446"), ("zip", "504b0304"), ("ole", "d0cf11e0a1b11ae1"), ("rtf", "7b5c727466"), ("rar", "526172211a07"),
    ("7z", "377abcaf271c"), ("gz", "1f8b"), ("png", "89504e470d0a1a0a"), ("jpg", "ffd8ff"), ("gif", "474946383961"), ("gif", "474946383761"), ("bmp", "424d"), ("lnk", "4c00000001140200"), ("cab", "4d534346"), ("iso", "4344303031"),
)
#: Ends of names that run when opened, that hold macros, and that pack others: fixed values.
RUNS = ("exe", "scr", "com", "pif", "bat", "cmd", "js", "jse", "vbs", "vbe", "wsf", "hta", "ps1", "msi", "jar", "lnk", "iso", "img", "app", "dmg", "pkg")
MACROS, PACKS = ("docm", "xlsm", "pptm", "dotm", "xlam"), ("zip", "rar", "7z", "gz", "cab", "ace", "tar")
INVISIBLE = "[​-‏ -‮⁠-⁤⁦-⁩﻿­]"
_LINK = r"""(?is)<(?:a|area|link|base|form|iframe|frame|script|img|embed|source|object|body|input|button)\b[^>]*?\b(?:href|src|action|data|background|formaction)\s*=\s*["']?([^"'\s>]+)"""


def header(name: str) -> Column:
    """The first value of a header, unfolded, or null."""
    found = F.get(F.filter("headers", lambda h: h["name"] == name), F.lit(0))["value"]
    return F.trim(F.regexp_replace(found, r"\r?\n[ \t]+", " "))


def address(value: Column) -> Column:
    """The address in a header's value, in lower case, or null."""
    found = F.regexp_extract(value, r"([A-Za-z0-9._%+'=-]+@[A-Za-z0-9.-]+)>?[^<]*$", 1)
    return F.when(found != "", F.lower(found))


def identities(parts: DataFrame) -> DataFrame:
    """Per message: sender, where answers and errors go, their domains, and the name that is shown."""
    top = parts.filter("part_id = 0")
    who = {c: address(header(h)) for c, h in (("sender", "from"), ("reply_to", "reply-to"), ("return_path", "return-path"))}
    out = top.select("mail_id", *(v.alias(c) for c, v in who.items()), F.trim(F.regexp_replace(F.regexp_replace(header("from"), r"<[^>]*>", ""), '"', "")).alias("shown"), header("subject").alias("subject"), header("message-id").alias("message_id"))
    return out.withColumns({f"{c}_domain": names.registered_domain_by_zone(F.substring_index(c, "@", -1)) for c in who})


def hops(parts: DataFrame) -> DataFrame:
    """The way of each message: hop (from 0, the first server), by, from, ip, ts_us, and the delay since the last known time."""
    top = parts.filter("part_id = 0").select("mail_id", F.posexplode(F.reverse(F.filter("headers", lambda h: h["name"] == "received"))).alias("hop", "h"))
    line = F.regexp_replace("h.value", r"\s+", " ")
    part = lambda p: F.nullif(F.regexp_extract(line, p, 1), F.lit(""))
    when = F.regexp_extract(line, r";\s*(?:[A-Za-z]{3},\s*)?([0-9]{1,2} [A-Za-z]{3} [0-9]{4} [0-9:]{8} [+-][0-9]{4})", 1)
    rows = top.select("mail_id", "hop", part(r"(?i)\bfrom ([^\s;()]+)").alias("from"), part(r"(?i)\bby ([^\s;()]+)").alias("by"), part(r"\[(?:IPv6:)?([0-9A-Fa-f.:]+)\]").alias("ip"), F.unix_micros(F.try_to_timestamp(when, F.lit("d MMM yyyy HH:mm:ss Z"))).alias("ts_us"))
    before = Window.partitionBy("mail_id").orderBy("hop").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("delay_us", F.col("ts_us") - F.last("ts_us", ignorenulls=True).over(before))


def authentication(parts: DataFrame) -> DataFrame:
    """Per message: the results of spf, dkim and dmarc that the last server wrote, and the domain that signed."""
    top = parts.filter("part_id = 0").withColumn("said", F.lower(header("authentication-results")))
    result = lambda m: F.nullif(F.regexp_extract("said", rf"\b{m}\s*=\s*([a-z]+)", 1), F.lit(""))
    signed = F.str_to_map(F.regexp_replace(header("dkim-signature"), r"\s+", ""), F.lit(";"), F.lit("="))
    return top.select("mail_id", *(result(m).alias(m) for m in ("spf", "dkim", "dmarc")), F.element_at(signed, "d").alias("signed_by"), F.element_at(signed, "s").alias("selector"))


def page_features(html: Column) -> Column:
    """What a page or a message's HTML has: counts of links, forms, scripts, frames, hidden elements, counting pixels, refreshes."""
    count = lambda p: F.regexp_count(html, F.lit(p)).cast("int")
    return F.struct(
        F.size(F.regexp_extract_all(html, F.lit(_LINK), F.lit(1))).alias("links"),
        count(r"(?i)<form\b").alias("forms"),
        count(r"(?i)<script\b").alias("scripts"),
        count(r"(?i)<i?frame\b").alias("frames"),
        count(r"(?i)<[^>]+\bstyle\s*=\s*[\"'][^\"'>]*(?:display\s*:\s*none|visibility\s*:\s*hidden|font-size\s*:\s*0)").alias("hidden"),
        count(r"(?i)<img\b(?=[^>]*\bwidth\s*=\s*[\"']?1\b)(?=[^>]*\bheight\s*=\s*[\"']?1\b)").alias("pixels"),
        count(r"(?i)<meta\b[^>]*http-equiv\s*=\s*[\"']?refresh").alias("refreshes"),
    )


def links(parts: DataFrame) -> DataFrame:
    """Distinct links of each message: url (without forwarding), host, and what speaks against it. Those of pages are taken
    from their elements (see sources.pages), others from the text."""
    plain = F.regexp_extract_all("text", F.lit(r"""(?i)(https?://[^\s<>"']+)"""), F.lit(1))
    said = parts.filter("text is not null").select("mail_id", "content_type", "text")
    html = pages.with_page(said.filter("content_type = 'text/html'"), "text").select("mail_id", F.explode(F.transform("page.links", lambda x: x["url"])).alias("link"))
    each = said.select("mail_id", F.explode(plain).alias("link")).unionByName(html)
    each = each.filter(F.lower("link").rlike(r"^(?:https?|ftp|data|javascript):")).distinct()
    return each.select("mail_id", "link", indicators.unwrap(F.col("link")).alias("url")).select("*", names.host_of(F.col("url")).alias("host"), indicators.link_flags(F.col("link")).alias("flags"))


#: Bytes beyond which a member that shrinks to a hundredth is one to fill a disk.
MOST_UNPACKED = 100 << 20


def file_type(content: Column) -> Column:
    """What a file is by its first bytes, or null."""
    head = F.lower(F.hex(F.substring(content, 1, 16)))
    return reduce(lambda out, kv: out.when(head.startswith(kv[1]), kv[0]), MAGIC[1:], F.when(head.startswith(MAGIC[0][1]), MAGIC[0][0]))


def attachments(parts: DataFrame) -> DataFrame:
    """Files of each message: name, type by content, digest, and what speaks against them.

    What is packed in a file is read from its directory (see sources.archives), without unpacking it.
    """
    end = F.lower(F.regexp_extract("filename", r"\.([A-Za-z0-9]+)\s*$", 1))
    kind = file_type(F.col("content"))
    pdf = F.decode("content", "ISO-8859-1")
    found = parts.filter("filename is not null").select("mail_id", "part_id", "filename", "content", "content_type", end.alias("end"), kind.alias("kind"), pdf.alias("_text"))
    found = archives.with_contents(found)
    has = lambda test: F.coalesce(F.exists("packed.entries", test), F.lit(False))
    programs = r"(?i)\.(?:" + "|".join(RUNS) + r")$"
    flags = F.array_compact(
        F.array(
            F.when(F.col("end").isin(*RUNS) | F.col("kind").isin("exe", "elf", "macho", "lnk"), "runs"),
            F.when(F.col("end").isin(*MACROS) | has(lambda x: x["macros"]), "macros"),
            F.when(F.col("filename").rlike(r"(?i)\.[a-z]{2,4}\.(?:" + "|".join(RUNS) + r")\s*$"), "double_extension"),
            F.when(F.col("filename").rlike(INVISIBLE), "invisible_characters"),
            F.when(F.col("kind").isin("exe", "elf", "macho") & ~F.col("end").isin(*RUNS), "disguised"),
            F.when((F.col("kind") == "pdf") & F.col("_text").rlike(r"/(?:JavaScript|JS|OpenAction|Launch|EmbeddedFile)\b"), "active_pdf"),
            F.when(has(lambda x: x["name"].rlike(programs)), "packed_program"),
            F.when(has(lambda x: x["encrypted"]), "encrypted"),
            F.when(has(lambda x: (x["size"] > MOST_UNPACKED) & (x["size"] > 100 * x["packed"])), "unpacks_to_much"),
            F.when(has(lambda x: (x["depth"] > 0) | x["name"].rlike(r"(?i)\.(?:" + "|".join(PACKS) + r")$")), "archive_in_archive"),
            F.when(F.col("packed.broken"), "broken_archive"),
            F.when((F.col("kind") == "rtf") & F.col("_text").rlike(r"(?i)\\objdata|\\objupdate"), "embedded_object"),
            F.when(F.col("end").isin("html", "htm", "svg") & F.col("_text").rlike(r"(?i)<script|atob\("), "script_page"),
        )
    )
    return found.select("mail_id", "part_id", "filename", "kind", F.sha2("content", 256).alias("sha256"), flags.alias("flags"))


#: Findings by what they rest on: (code, level 1 low to 3 high).
LEVELS = {"reply_elsewhere": 2, "errors_elsewhere": 1, "lookalike_sender": 3, "address_shown": 2, "spf_failed": 2, "dkim_failed": 2, "dmarc_failed": 3, "bad_link": 2, "bad_file": 3, "hidden_text": 2, "form": 2, "defects": 1, "slow_hop": 1}


def findings(parts: DataFrame) -> DataFrame:
    """(mail_id, code, level, detail): what speaks against a message, each once."""
    who, auth = identities(parts), authentication(parts)
    differs = lambda c: F.col(f"{c}_domain").isNotNull() & F.col("sender_domain").isNotNull() & (F.col(f"{c}_domain") != F.col("sender_domain"))
    seen = who.join(auth, "mail_id", "left")
    tests = F.array_compact(
        F.array(
            F.when(differs("reply_to"), F.struct(F.lit("reply_elsewhere").alias("code"), F.col("reply_to").alias("detail"))),
            F.when(differs("return_path"), F.struct(F.lit("errors_elsewhere").alias("code"), F.col("return_path").alias("detail"))),
            F.when(indicators.imitated_brand(F.substring_index("sender", "@", -1)).isNotNull(), F.struct(F.lit("lookalike_sender").alias("code"), F.col("sender").alias("detail"))),
            F.when(address(F.col("shown")).isNotNull() & (address(F.col("shown")) != F.col("sender")), F.struct(F.lit("address_shown").alias("code"), F.col("shown").alias("detail"))),
            *(F.when(F.col(m).isin("fail", "softfail", "permerror"), F.struct(F.lit(f"{m}_failed").alias("code"), F.col(m).alias("detail"))) for m in ("spf", "dkim", "dmarc")),
        )
    )
    out = seen.select("mail_id", F.explode(tests).alias("x")).select("mail_id", "x.*")
    row = lambda df, code, detail: df.select("mail_id", F.lit(code).alias("code"), detail.cast("string").alias("detail"))
    html = parts.filter("content_type = 'text/html' and text is not null").select("mail_id", "text")
    seen_pages = pages.with_page(html, "text").select("mail_id", F.col("page.hidden_chars").alias("hidden"), F.size("page.forms").alias("forms"))
    more = [
        row(links(parts).filter(F.size("flags") > 0), "bad_link", F.col("link")),
        row(attachments(parts).filter(F.size("flags") > 0), "bad_file", F.col("filename")),
        row(seen_pages.filter("hidden > 0"), "hidden_text", F.col("hidden")),
        row(seen_pages.filter("forms > 0"), "form", F.col("forms")),
        row(parts.filter(F.size("defects") > 0), "defects", F.array_join("defects", ",")),
        row(hops(parts).filter(F.col("delay_us") > 3_600_000_000), "slow_hop", F.col("by")),
    ]
    every = reduce(DataFrame.unionByName, more, out).distinct()
    level = F.element_at(F.create_map(*(F.lit(x) for kv in LEVELS.items() for x in kv)), F.col("code"))
    return every.select("mail_id", "code", level.alias("level"), "detail")


def risk(found: DataFrame) -> DataFrame:
    """Per message: findings of each level and the risk: high, medium, low; messages without findings are not among them."""
    by = found.groupBy("mail_id").agg(*(F.count_if(F.col("level") == n).alias(c) for n, c in ((3, "high"), (2, "medium"), (1, "low"))))
    return by.withColumn("risk", F.when(F.col("high") > 0, "high").when(F.col("medium") > 0, "medium").otherwise("low"))


def invisible(text: Column) -> Column:
    """How many characters of a text take no room or turn its direction."""
    return F.regexp_count(text, F.lit(INVISIBLE)).cast("int")


def strings(content: Column, least: int = 6) -> Column:
    """Runs of at least so many printable characters in a file."""
    return F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(rf"[\x20-\x7e]{{{least},}}"), F.lit(0))


def sender_public(hop_rows: DataFrame) -> DataFrame:
    """The first public address on each message's way."""
    return hop_rows.filter(ip.is_global(F.col("ip"))).groupBy("mail_id").agg(F.min_by("ip", "hop").alias("ip"))
