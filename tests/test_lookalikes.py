"""Hosts that imitate brands, against a comparison of every part with every brand."""

from __future__ import annotations

import pytest

from tidewatch.operators import lookalikes


def encoded(text):
    return ".".join("xn--" + p.encode("punycode").decode() if not p.isascii() else p for p in text.split("."))


CASES = {
    "paypal.com": None, "www.paypal.com": None, "paypa1-secure.com": "paypal.com", "paypal.evil.io": "paypal.com", "paypai.com": "paypal.com", "paypall.net": "paypal.com", "pypal.net": "paypal.com", "paayypal.net": None,
    "login.rnicrosoft.com": "microsoft.com", "g00gle.info": "google.com", "amazon_pay.shop": "amazon.com", "vvalmart.biz": "walmart.com", "ebey.com": None, "ebay.example": "ebay.com", "dhl.evil.com": None, "example.org": None, "com": None, "": None, None: None,
    encoded("раураl.com"): "paypal.com", encoded("аррӏе.net"): "apple.com", encoded("gооglе.com"): "google.com", encoded("fàcebook.com"): "facebook.com", encoded("münchen.de"): None, "xn--zzzz-\u00e9.com": None, "xn--.com": None,
    "раураl.com": "paypal.com", "PAYPA1.COM": "paypal.com", "micros0ft-facebook.net": "facebook.com",
}


def test_imitations(spark):
    rows = spark.createDataFrame([(i, h, "old") for i, h in enumerate(CASES)], "id int, host string, brand string")
    got = {r.id: r.brand for r in lookalikes.imitated(rows.unionByName(rows), "host").collect()}
    assert got == dict(enumerate(CASES.values()))
    assert lookalikes.imitated(rows, "host").count() == len(CASES) and lookalikes.imitated(rows.limit(0), "host").collect() == []


def test_brands_of_ones_own(spark):
    rows = spark.createDataFrame([("my-cornpany.net",), ("mycompany.org",), ("paypa1.com",)], "host string")
    brands = spark.createDataFrame([("Company.org",), ("company.org",), ("abc.org",)], "domain string")
    assert [r.brand for r in lookalikes.imitated(rows, "host", brands).orderBy("host").collect()] == ["company.org", None, None]


@pytest.mark.parametrize(("host", "plain"), [("раураl.com", "paypal.com"), (encoded("аррӏе.net"), "apple.net"), ("xn--\u00e9", "xn--e"), ("plain.org", "plain.org")])
def test_what_is_shown(host, plain):
    assert lookalikes.shown(host) == plain
