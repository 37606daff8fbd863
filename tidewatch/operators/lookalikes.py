"""Hosts that imitate brands: parts of names that read like a brand's, or are one edit away from it.

Names and brands meet by keys: what a part folds to, and what it is with one character less. Two texts are one edit apart
only if they share such a key, so that no part is compared with a brand that it has nothing to do with, and the number of
brands does not show in the plan. What meets is then tested exactly.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import names

from . import joins

#: Domains of brands that reports on phishing name; a table of one's own may be given.
BRANDS = (
    "adobe.com", "aliexpress.com", "allegro.pl", "amazon.com", "americanexpress.com", "apple.com", "bankofamerica.com", "binance.com", "booking.com", "chase.com", "citibank.com",
    "coinbase.com", "dhl.com", "discord.com", "docusign.com", "dropbox.com", "ebay.com", "facebook.com", "fedex.com", "github.com", "google.com", "icloud.com",
    "instagram.com", "linkedin.com", "mastercard.com", "metamask.io", "microsoft.com", "netflix.com", "office.com", "outlook.com", "paypal.com", "santander.com", "shopify.com",
    "slack.com", "spotify.com", "steampowered.com", "stripe.com", "telegram.org", "tiktok.com", "twitter.com", "walmart.com", "wellsfargo.com", "whatsapp.com", "yahoo.com",
)
#: Characters and pairs that read like others, in the order in which they are folded.
SINGLE = ("0135!|@$", "olesilas")
PAIRS = (("rn", "m"), ("vv", "w"), ("cl", "d"), ("ii", "u"))
#: Letters of other alphabets with the Latin letter that they read like, from Unicode's table of confusables (UTS 39).
CONFUSABLE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ո": "n", "ս": "u", "օ": "o", "ɑ": "a", "ɡ": "g", "ı": "i", "ł": "l", "ø": "o",
}
#: Parts with fewer characters imitate by reading alike only, and brands with fewer are not looked for.
LEAST_EDITED, LEAST_BRAND = 5, 4


def folded(label: Column) -> Column:
    """A part of a name as it reads: look-alike characters and pairs made one."""
    out = F.translate(F.lower(label), *SINGLE)
    for pair, one in PAIRS:
        out = F.regexp_replace(out, pair, one)
    return out


def shown(host: str) -> str:
    """A host as a browser may show it: its encoded labels decoded (RFC 3492), and letters of other alphabets, and those
    with marks, as the Latin ones that they read like. What does not decode stays."""
    labels = []
    for label in host.lower().split("."):
        if label.startswith("xn--"):
            try:
                label = label[4:].encode("ascii").decode("punycode")
            except UnicodeError:
                pass
        plain = unicodedata.normalize("NFKD", "".join(CONFUSABLE.get(c, c) for c in label))
        labels.append("".join(CONFUSABLE.get(c, c) for c in plain if not unicodedata.combining(c)))
    return ".".join(labels)


def _shown(hosts: DataFrame) -> DataFrame:
    """host and shown, for hosts with encoded labels or letters beyond ASCII."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(shown, b.column(0).to_pylist()), pa.string())], names=["_host", "_shown"])

    return hosts.filter(F.col("_host").rlike(r"(^|\.)xn--|[^\x00-\x7F]")).mapInArrow(run, "_host string, _shown string")


def _parts(host: Column) -> Column:
    """The parts of a host's labels, without the last."""
    every = F.split(host, r"[.\-_]")
    return F.filter(F.slice(every, 1, F.greatest(F.size(every) - 1, F.lit(0))), lambda p: p != "")


def _neighbours(text: Column) -> Column:
    """A text, and each that is left when one of its characters goes."""
    n = F.length(text)
    less = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substr(text, F.lit(1), i - 1), F.substr(text, i + 1, n)))
    return F.array_distinct(F.concat(F.array(text), less))


def brand_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d,) for d in BRANDS], "domain string").coalesce(1)


def imitated(rows: DataFrame, host: str, brands: DataFrame | None = None) -> DataFrame:
    """rows with brand: the domain of the brand that a host imitates, the least of several, or null.

    A host imitates a brand if a part of it is the first label of the brand's domain, folds to it (see folded), or, with
    LEAST_EDITED characters or more, is one edit away; for hosts with encoded labels the parts count as they are shown,
    too. A brand's own domain, and names under it, imitate nothing. brands has domain. Each distinct host is judged once.
    """
    dim = (brands if brands is not None else brand_table(rows.sparkSession)).select(F.lower("domain").alias("_brand")).distinct()
    dim = dim.withColumn("_name", F.substring_index("_brand", ".", 1)).filter(F.length("_name") >= LEAST_BRAND)
    keyed = dim.select("*", F.explode(_neighbours(F.col("_name"))).alias("_key"))
    hosts = rows.select(names.clean(F.col(host)).alias("_host")).filter("_host <> ''").distinct()
    own = joins.sized(dim.select(F.col("_brand").alias("_registered")))
    hosts = hosts.withColumn("_registered", names.registered_domain(F.col("_host"))).join(own, "_registered", "left_anti").select("_host")
    raw = hosts.select("_host", F.explode(_parts(F.col("_host"))).alias("_part"))
    # as they are shown, parts are folded first; as they are written, they are tried both ways
    read = _shown(hosts).select("_host", F.explode(_parts(F.col("_shown"))).alias("_part")).withColumn("_part", folded(F.col("_part")))
    ways = raw.unionByName(read).unionByName(raw.select("_host", folded(F.col("_part")).alias("_part"))).withColumn("_edits", F.lit(0))
    ways = ways.unionByName(raw.unionByName(read).filter(F.length("_part") >= LEAST_EDITED).withColumn("_edits", F.lit(1))).distinct()
    keys = F.when(F.col("_edits") == 0, F.array("_part")).otherwise(_neighbours(F.col("_part")))
    met = ways.select("*", F.explode(keys).alias("_key")).join(joins.sized(keyed), "_key")
    sure = F.when(F.col("_edits") == 0, F.col("_part") == F.col("_name")).otherwise(F.levenshtein("_part", "_name", 1) == 1)
    found = met.filter(sure).groupBy("_host").agg(F.min("_brand").alias("brand"))
    keep = [c for c in rows.columns if c != "brand"]
    return rows.select(*keep, names.clean(F.col(host)).alias("_host")).join(found, "_host", "left").select(*keep, "brand")
