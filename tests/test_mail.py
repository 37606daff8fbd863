from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import mail
from tidewatch.sources import mail as source

SIMPLE = b"""Return-Path: <bounce@mailer.example.net>
Received: from b.example (b.example [8.8.4.4]) by c.example; Mon, 1 Jan 2024 12:30:00 +0000
Received: from unknown by b.example
Received: from a.example ([10.0.0.1]) by b.example; Mon, 1 Jan 2024 10:00:00 +0000
Authentication-Results: c.example; spf=fail smtp.mailfrom=x; dkim=pass; dmarc=fail
DKIM-Signature: v=1; a=rsa-sha256; d=example.net;
 s=key1; b=abc
From: "Support help@paypal.com" <help@paypa1.com>
Reply-To: other@evil.example.org
Subject: Your
 account
Content-Type: multipart/mixed; boundary=B

--B
Content-Type: text/html; charset=utf-8

<p style="display:none">x</p><form action="http://10.1.2.3/x"></form><a href="https://www.google.com/url?q=https%3A%2F%2Fbit.ly%2Fz">paypal.com</a><img src="http://t.example/p.gif" width=1 height=1>
--B
Content-Type: application/octet-stream
Content-Disposition: attachment; filename="invoice.pdf.exe"
Content-Transfer-Encoding: base64

TVqQAAMAAAAEAAAA
--B--
"""
PLAIN = b"From: a@example.org\nSubject: hi\n\nsee https://example.org/x\n"


def parts(spark):
    rows = [("m1", bytearray(SIMPLE)), ("m2", bytearray(PLAIN)), ("m3", bytearray(b"")), ("m4", None), ("m5", bytearray(b"\xff\xfe\0 no mail"))]
    return source.decoded(spark.createDataFrame(rows, "mail_id string, content binary"))


def test_parts_are_rows(spark):
    p = parts(spark)
    got = [(r.mail_id, r.part_id, r.parent_id, r.content_type, r.filename) for r in p.orderBy("mail_id", "part_id").collect()]
    assert got[:3] == [("m1", 0, None, "multipart/mixed", None), ("m1", 1, 0, "text/html", None), ("m1", 2, 0, "application/octet-stream", "invoice.pdf.exe")]
    assert {g[0] for g in got} == {"m1", "m2", "m3", "m5"}
    assert p.filter("part_id = 2").first().content[:2] == b"MZ"


def test_the_way_and_its_delays(spark):
    got = [(r["hop"], r["from"], r["ip"], r["delay_us"]) for r in mail.hops(parts(spark)).filter("mail_id = 'm1'").orderBy("hop").collect()]
    assert got == [(0, "a.example", "10.0.0.1", None), (1, "unknown", None, None), (2, "b.example", "8.8.4.4", 9_000_000_000)]
    assert [r.ip for r in mail.sender_public(mail.hops(parts(spark))).collect()] == ["8.8.4.4"]


def test_identity_authentication_and_links(spark):
    p = parts(spark)
    who = mail.identities(p).filter("mail_id = 'm1'").first()
    assert (who.sender, who.reply_to, who.return_path, who.subject) == ("help@paypa1.com", "other@evil.example.org", "bounce@mailer.example.net", "Your account")
    auth = mail.authentication(p).filter("mail_id = 'm1'").first()
    assert (auth.spf, auth.dkim, auth.dmarc, auth.signed_by, auth.selector) == ("fail", "pass", "fail", "example.net", "key1")
    flags = {r.host: set(r.flags) for r in mail.links(p).filter("mail_id = 'm1'").collect()}
    assert "ip_literal" in flags["10.1.2.3"] and "unwrapped" in flags["bit.ly"]
    a = mail.attachments(p).first()
    assert a.kind == "exe" and {"runs", "double_extension"} <= set(a.flags)


def test_findings_and_risk(spark):
    p = parts(spark)
    found = mail.findings(p)
    codes = {r.code for r in found.filter("mail_id = 'm1'").collect()}
    assert codes >= {"reply_elsewhere", "errors_elsewhere", "lookalike_sender", "address_shown", "spf_failed", "dmarc_failed", "bad_link", "bad_file", "hidden_text", "form", "slow_hop"} and "dkim_failed" not in codes
    assert {r.mail_id: r.risk for r in mail.risk(found).collect()}["m1"] == "high"
    assert found.filter("mail_id = 'm2'").collect() == []
    assert mail.findings(p.limit(0)).collect() == []


def test_pages_files_and_invisible_characters(spark):
    page = '<a href=x><IFRAME src="y"></iframe><img width="1" height="1" src=z><meta http-equiv="refresh" content="0">'
    r = spark.createDataFrame([(page,)], "h string").select(mail.page_features(F.col("h")).alias("p")).first().p
    assert (r.links, r.frames, r.pixels, r.refreshes, r.scripts) == (3, 1, 1, 1, 0)
    df = spark.createDataFrame([(bytearray(b"%PDF-1.4 /JavaScript"), "a​b‮"), (bytearray(b"ab\0hello world\1"), "x")], "c binary, t string")
    got = df.select(mail.file_type(F.col("c")).alias("k"), mail.invisible(F.col("t")).alias("n"), mail.strings(F.col("c")).alias("s")).collect()
    assert [(x.k, x.n) for x in got] == [("pdf", 2), (None, 0)] and got[1].s == ["hello world"]
