"""Threat intelligence, allowlists, names of addresses and encrypted name lookups: what packets and alerts are held against.

Dimensions are loaded tables; each meets the facts by an equi-join on derived keys (see joins).
"""

from __future__ import annotations

from collections import deque
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions import ip, names

from . import folds, joins

#: Feeds by name: what they hold, the category and severity of their entries.
FEEDS = {
    "block_addresses": ("ip", "malicious", 3),
    "hijacked_networks": ("drop", "hijacked", 4),
    "control_servers": ("ip", "c2", 4),
    "malware_hosts": ("hosts", "malware", 4),
    "phishing_domains": ("domains", "phishing", 3),
}
ENTRY = ["indicator", "category", "severity", "description"]
#: Kinds of alerts for which a name that only the client claimed counts for nothing: fixed values.
SECURITY_KINDS = ("threat", "attack", "beacon", "host")


def union(*loads: tuple[DataFrame, str, str, int]) -> DataFrame:
    """Entries of several loads: indicator, category, severity, description. The last load that has an indicator counts.

    A load is (its rows, the column of the indicator, the category, the severity); rows may have those columns instead.
    """
    every = []
    for no, (rows, column, category, severity) in enumerate(loads):
        own = lambda c, other: F.coalesce(F.col(c), F.lit(other)) if c in rows.columns else F.lit(other)  # noqa: B023, E731
        every.append(rows.select(F.lower(F.trim(F.col(column))).alias("indicator"), own("category", category).alias("category"), own("severity", severity).cast("int").alias("severity"), own("description", "").alias("description"), F.lit(no).alias("_no")))
    rows = reduce(DataFrame.unionByName, every).filter("indicator <> ''")
    return rows.groupBy("indicator").agg(F.max(F.struct("_no", "category", "severity", "description")).alias("x")).select("indicator", "x.category", "x.severity", "x.description")


def entries_of(spark: SparkSession, kind: str, listed: list[dict], severity: int = 3) -> DataFrame:
    """A list of entries read from a file (mappings with indicator or the kind's own key) as a table."""
    key = {"ip": "ip", "domain": "domain"}[kind]
    rows = [(str(e.get("indicator") or e.get(key) or "").strip(), e.get("category", "malicious"), int(e.get("severity", severity)), e.get("description", "")) for e in listed if isinstance(e, dict)]
    return spark.createDataFrame([r for r in rows if r[0]], "indicator string, category string, severity int, description string")


def checks(packets: DataFrame, addresses: DataFrame, domains: DataFrame) -> DataFrame:
    """One row for each way in which a packet touches a known indicator: seq, ts_us, src_ip, dst_ip, field, value, and the entry.

    Fields are src_ip, dst_ip, query_name, sni (if it is not the query) and host (of requests, if it is neither). Packets
    have the columns of those that there are. Values of all fields meet a dimension together, each distinct one once.
    """
    have = lambda c: F.col(c) if c in packets.columns else F.lit(None).cast("string")
    low = lambda c: names.clean(have(c))
    host = names.clean(F.regexp_replace(F.when(F.length(F.regexp_replace(have("host"), "[^:]", "")) == 1, F.substring_index(have("host"), ":", 1)).otherwise(have("host")), r"^\[|\]$", ""))
    sni = F.when(~low("sni").eqNullSafe(low("query_name")), low("sni"))
    asked = F.when(~host.eqNullSafe(low("query_name")) & ~host.eqNullSafe(low("sni")), host)

    def rows(fields: list[tuple[str, Column]]) -> DataFrame:
        each = F.explode(F.filter(F.array(*(F.struct(F.lit(n).alias("field"), v.alias("value")) for n, v in fields)), lambda x: x["value"].isNotNull()))
        return packets.select("seq", "ts_us", "src_ip", "dst_ip", each.alias("x")).select("seq", "ts_us", "src_ip", "dst_ip", "x.*")

    by_ip = joins.longest_prefix(rows([("src_ip", F.col("src_ip")), ("dst_ip", F.col("dst_ip"))]), "value", addresses.withColumnRenamed("indicator", "cidr").withColumn("indicator", F.col("cidr")), ENTRY)
    by_name = joins.domain_suffix(rows([("query_name", low("query_name")), ("sni", sni), ("host", asked)]), "value", domains.withColumnRenamed("indicator", "domain").withColumn("indicator", F.col("domain")), ENTRY)
    return by_ip.unionByName(by_name).filter("indicator is not null")


#: Rules up to which an allowlist is one expression over the alert.
MOST_COMPILED = 200
#: What of an alert a rule can name.
DECIDING = ["kind", "rule_id", "app", "_host", "src_ip", "dst_ip"]


def allowed(alerts: DataFrame, rules: DataFrame) -> DataFrame:
    """alerts with allowed_by, the first rule by rule_no that fits, or null.

    rules has rule_no, kind, rule_id, app, host and ip; a null field fits all, and a rule of nulls alone fits nothing. A
    host fits itself and its sub-domains; ip may be either end. Alerts have kind, rule_id, app, remote_host, query_name,
    unverified (whether remote_host is only claimed), src_ip, dst_ip; rows that repeat are each judged. A few rules
    (MOST_COMPILED) become one column, so that alerts stay where they are. With more, each distinct combination of what
    rules can name is judged once and joined back by value: rules with a host meet by name and its parents, others by
    their most telling field, and what is left of the conditions is tested on what met, never on all pairs.
    """
    claimed = F.coalesce(F.col("unverified"), F.lit(False)) & F.col("kind").isin(*SECURITY_KINDS)
    host = names.clean(F.when(claimed, F.col("query_name")).otherwise(F.coalesce("remote_host", "query_name")))
    rows = alerts.withColumn("_host", host)
    dim = rules.select("rule_no", *(F.col(c).alias(f"r_{c}") for c in ("kind", "rule_id", "app", "host", "ip"))).withColumn("r_host", names.clean(F.col("r_host")))
    few = dim.limit(MOST_COMPILED + 1).collect()
    if len(few) <= MOST_COMPILED:
        return rows.withColumn("allowed_by", _compiled(few).cast(dim.schema["rule_no"].dataType)).drop("_host")
    seen = rows.select(*DECIDING).distinct()
    on = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in DECIDING]
    same = joins.sized(_judged(seen, dim).select(*(F.col(c).alias(f"_of_{c}") for c in DECIDING), "allowed_by"))
    return rows.join(same, on, "left").select(*alerts.columns, "allowed_by")


def _compiled(rules: list) -> Column:
    """The least rule_no of those that fit, as one column."""
    suffixes = names.suffixes(F.col("_host"))
    tests = {
        "kind": lambda v: F.col("kind") == v,
        "rule_id": lambda v: F.upper("rule_id") == v.upper(),
        "app": lambda v: F.col("app") == v,
        "host": lambda v: F.array_contains(suffixes, v),
        "ip": lambda v: F.coalesce(F.col("src_ip") == v, F.lit(False)) | F.coalesce(F.col("dst_ip") == v, F.lit(False)),
    }
    numbers = [F.lit(None).cast("long"), F.lit(None).cast("long")]
    for r in rules:
        stated = [test(r[f"r_{c}"]) for c, test in tests.items() if r[f"r_{c}"] is not None]
        if stated:
            numbers.append(F.when(reduce(lambda a, b: a & b, stated), F.lit(r["rule_no"]).cast("long")))
    return F.least(*numbers)


def _judged(seen: DataFrame, dim: DataFrame) -> DataFrame:
    """DECIDING and allowed_by: the distinct combinations that a rule fits."""
    key = F.when(F.col("r_host").isNotNull(), F.concat(F.lit("h:"), "r_host")).when(F.col("r_ip").isNotNull(), F.concat(F.lit("i:"), "r_ip")).when(F.col("r_rule_id").isNotNull(), F.concat(F.lit("r:"), F.upper("r_rule_id")))
    key = key.when(F.col("r_app").isNotNull(), F.concat(F.lit("a:"), "r_app")).when(F.col("r_kind").isNotNull(), F.concat(F.lit("k:"), "r_kind"))
    dim = dim.withColumn("_key", key).filter("_key is not null")
    mine = F.concat(
        F.transform(F.coalesce(names.suffixes(F.col("_host")), F.array().cast("array<string>")), lambda x: F.concat(F.lit("h:"), x)),
        F.array(F.concat(F.lit("i:"), "src_ip"), F.concat(F.lit("i:"), "dst_ip"), F.concat(F.lit("r:"), F.upper("rule_id")), F.concat(F.lit("a:"), "app"), F.concat(F.lit("k:"), "kind")),
    )
    fits = lambda c, test: F.col(f"r_{c}").isNull() | F.coalesce(test, F.lit(False))
    keyed = seen.select(*DECIDING, F.explode(F.array_distinct(F.array_compact(mine))).alias("_key"))
    met = keyed.join(joins.sized(dim), "_key").filter(
        fits("kind", F.col("kind") == F.col("r_kind")) & fits("rule_id", F.upper("rule_id") == F.upper("r_rule_id")) & fits("app", F.col("app") == F.col("r_app"))
        & fits("ip", F.coalesce(F.col("r_ip") == F.col("src_ip"), F.lit(False)) | F.coalesce(F.col("r_ip") == F.col("dst_ip"), F.lit(False)))
    )
    return met.groupBy(*DECIDING).agg(F.min("rule_no").alias("allowed_by"))


def learned_names(sightings: DataFrame) -> DataFrame:
    """What each address is called from a sighting on: ip, ts_us, seq, name, verified.

    Sightings have ip, ts_us, seq, name and from_dns. A name from an answer is verified, and so is a claim that an answer
    has vouched for before; an unverified claim does not displace another name that is verified.
    """
    rows = sightings.filter("ip is not null").withColumn("name", names.clean(F.col("name"))).filter("name is not null")
    before = Window.partitionBy("ip", "name").orderBy("ts_us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("verified", F.col("from_dns") | F.max("from_dns").over(before))
    # the name stands that was last set; a mere claim only sets it while no verified name stands, or repeats that name
    w = Window.partitionBy("ip").orderBy("ts_us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    sure = F.last(F.when(F.col("verified"), F.col("name")), ignorenulls=True).over(w)
    return rows.withColumn("name", F.coalesce(sure, F.col("name"))).withColumn("verified", sure.isNotNull()).select("ip", "ts_us", "seq", "name", "verified")


#: Resolvers that take lookups over encrypted channels, by name and by address; a list of one's own may be given.
RESOLVERS = ("dns.google", "cloudflare-dns.com", "one.one.one.one", "dns.quad9.net", "doh.opendns.com", "dns.nextdns.io", "dns.adguard-dns.com", "doh.mullvad.net")
RESOLVER_ADDRESSES = ("1.1.1.1", "1.0.0.1", "8.8.8.8", "8.8.4.4", "9.9.9.9", "149.112.112.112", "208.67.222.222", "208.67.220.220")
RELAYS = ("mask.icloud.com", "mask-h2.icloud.com", "mask-api.icloud.com")


def encrypted_lookups(packets: DataFrame, hosts: DataFrame | None = None, addresses: DataFrame | None = None) -> DataFrame:
    """The first contact of each source with each encrypted resolver by each method: relay, doh, dot, doq or bootstrap.

    Packets have src_ip, dst_ip, dst_port, protocol, sni, query_name (of queries) and is_response. hosts (host) and
    addresses (ip) are lists beside the built-in ones. The tests are made in this order, the first that holds counts.
    """
    spark = packets.sparkSession
    known = spark.createDataFrame([(h,) for h in RESOLVERS], "host string").coalesce(1)
    dots = spark.createDataFrame([(a,) for a in RESOLVER_ADDRESSES], "ip string").coalesce(1)
    known = known.unionByName(hosts.select(names.clean(F.col("host")).alias("host"))) if hosts is not None else known
    dots = dots.unionByName(addresses.select("ip")) if addresses is not None else dots
    rows = packets.filter(F.col("protocol").isin("tcp", "udp") & F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull())
    rows = rows.withColumns({"_sni": names.clean(F.col("sni")), "_asked": names.clean(F.when(~F.coalesce("is_response", F.lit(False)), F.col("query_name")))})
    for key, side, dim, column in (("_by_sni", "_sni", known, "host"), ("_by_name", "_asked", known, "host"), ("_by_ip", "dst_ip", dots, "ip")):
        own = joins.sized(dim.select(F.col(column).alias(f"{key}_of")).distinct())
        rows = rows.join(own, F.col(side) == F.col(f"{key}_of"), "left").withColumn(key, F.col(f"{key}_of").isNotNull()).drop(f"{key}_of")
    relay = lambda c: reduce(lambda a, b: a | b, (F.coalesce(F.col(c).endswith(r), F.lit(False)) for r in RELAYS))
    secure = F.col("dst_port") == 853
    method = (
        F.when(relay("_sni") | relay("_asked"), "relay")
        .when(F.col("_by_sni"), F.when(secure, "dot").otherwise("doh"))
        .when(secure, F.when(F.col("protocol") == "tcp", "dot").otherwise("doq"))
        .when((F.col("dst_port") == 443) & F.col("_by_ip"), "doh")
        .when(F.col("_by_name"), "bootstrap")
    )
    resolver = F.when(F.col("method") == "relay", "relay").when(F.col("_by_sni"), F.col("_sni")).when(F.col("method") == "bootstrap", F.col("_asked")).otherwise(F.col("dst_ip"))
    found = rows.withColumn("method", method).filter("method is not null").withColumn("resolver", resolver)
    first = found.groupBy("src_ip", "resolver", "method").agg(F.min(F.struct("ts_us", "seq", "dst_ip")).alias("x")).select("src_ip", "resolver", "method", "x.*")
    return first.withColumn("severity", F.when(F.col("method").isin("bootstrap", "relay"), 1).otherwise(2))


def lookup_indicators(indicators: DataFrame, domains: DataFrame, addresses: DataFrame) -> DataFrame:
    """indicators (kind, value) with the entry that knows them: addresses by network, names and hosts of links by parent."""
    host = F.when(F.col("kind") == "url", names.host_of(F.col("value"))).when(F.col("kind") == "email", F.substring_index("value", "@", -1)).when(F.col("kind") == "domain", F.col("value"))
    rows = indicators.withColumn("_name", names.clean(host)).withColumn("_at", F.when(F.col("kind") == "ipv4", F.col("value")).when(F.col("_name").rlike(ip.IPV4), F.col("_name")))
    nets = addresses.withColumnRenamed("indicator", "cidr").withColumn("indicator", F.col("cidr"))
    zones = domains.withColumn("domain", F.concat(F.lit("."), F.regexp_replace("indicator", r"^\.", "")))
    by_ip = joins.longest_prefix(rows, "_at", nets, ENTRY).select("*", F.struct(*ENTRY).alias("_a")).drop(*ENTRY)
    both = joins.domain_suffix(by_ip, "_name", zones, ENTRY)
    known = F.col("indicator").isNotNull()
    return both.select(*indicators.columns, *(F.when(known, F.col(c)).otherwise(F.col(f"_a.{c}")).alias(c) for c in ENTRY))


#: Verdicts from the least to the gravest: fixed values.
VERDICTS = ("unknown", "info", "clean", "suspicious", "malicious")


def verdict_rank(verdict: Column) -> Column:
    return F.greatest(F.array_position(F.array(*map(F.lit, VERDICTS)), verdict).cast("int") - 1, F.lit(0))


def verdicts(lookups: DataFrame) -> DataFrame:
    """Per indicator: the gravest verdict of its sources (source, verdict, ts_us), how many looked it up, and when last."""
    worst = F.max(verdict_rank(F.col("verdict")))
    by = lookups.groupBy("kind", "value").agg(worst.alias("rank"), F.count(F.lit(1)).alias("n"), F.max("ts_us").alias("last_us"))
    return by.select("kind", "value", F.element_at(F.array(*map(F.lit, VERDICTS)), F.col("rank") + 1).alias("verdict"), "n", "last_us")


#: Which kinds of indicators a source answers: fixed values of those sources' interfaces.
SOURCE_KINDS = {"addresses": ("ipv4", "ipv6"), "names": ("domain", "url", "email"), "files": ("md5", "sha1", "sha256"), "flaws": ("cve",)}


def lookups_due(indicators: DataFrame, cache: DataFrame, now: int, ttl: int = 86_400_000_000, per_minute: int = 30) -> DataFrame:
    """(source, kind, value) to ask for: kinds that the source answers, no private address, nothing answered within ttl,
    links without query and fragment; minute is when, per_minute of each source in order. Nothing is sent here."""
    spark = indicators.sparkSession
    dim = spark.createDataFrame([(s, k) for s, ks in SOURCE_KINDS.items() for k in ks], "source string, kind string").coalesce(1)
    value = F.when(F.col("kind") == "url", F.regexp_replace("value", r"[?#].*$", "")).otherwise(F.col("value"))
    public = (F.col("kind") != "ipv4") | ip.is_global(F.col("value"))
    asked = indicators.filter(public).select("kind", value.alias("value")).distinct().join(F.broadcast(dim), "kind")  # a row per source and kind
    fresh = cache.filter(F.col("fetched_us") > now - ttl).select("source", "kind", "value")
    due = asked.join(fresh, ["source", "kind", "value"], "left_anti")
    place = F.row_number().over(Window.partitionBy("source").orderBy("kind", "value")) - 1
    return due.withColumn("minute", F.floor(place / per_minute).cast("long")).select("source", "kind", "value", "minute")


def dns_bursts(packets: DataFrame, least: int, window: int, cooldown: int) -> DataFrame:
    """Failed lookups of many registered domains: client, ts_us, seq, distinct, and HIGH (3) where the names look made up.

    packets has client, name, ts_us, seq; a name's first label counts. mean entropy of at least 3 and mean length of at
    least 10 over the client's names of the window make it HIGH.
    """
    said = folds.fold(looked_up(packets), ["client"], ["ts_us", "seq"], ["ts_us", "domain", "entropy", "size"], bursts(window, least, cooldown), "burst", BURST)
    return said.filter("burst is not null").select("client", "ts_us", "seq", "burst.distinct", burst_severity().alias("severity"))


BURST = "struct<distinct:int,entropy:double,size:double>"


def looked_up(packets: DataFrame) -> DataFrame:
    """client, ts_us, seq and domain of names, with entropy and size of their first labels."""
    first = F.split("name", r"\.")[0]
    rows = packets.withColumn("domain", names.registered_domain(F.col("name"))).filter("domain is not null")
    return rows.select("client", "ts_us", "seq", "domain", names.entropy(first).alias("entropy"), F.length(first).alias("size"))


def burst_severity() -> Column:
    return F.when((F.col("burst.entropy") >= 3.0) & (F.col("burst.size") >= 10), 3).otherwise(2)


def bursts(window: int, least: int, cooldown: int):
    return lambda: _Bursts(window, least, cooldown)


class _Bursts:
    """As folds.sliding_distinct(), with the mean entropy and size of the names of the window where it says something."""

    def __init__(self, window: int, least: int, cooldown: int):
        self.window, self.count = window, folds.sliding_distinct(window, least, cooldown)()
        self.names: deque[tuple[int, float, int]] = deque()
        self.idle = self.count.idle

    def run(self, at, domains, entropies, sizes) -> list:
        out: list = []
        for said, t, h, n in zip(self.count.run(at, domains), at, entropies, sizes, strict=True):
            self.names.append((t, h, n))
            while t - self.names[0][0] > self.window:
                self.names.popleft()
            k = len(self.names)
            out.append(said and {"distinct": said, "entropy": sum(x[1] for x in self.names) / k, "size": sum(x[2] for x in self.names) / k})
        return out


def in_traffic(indicators: DataFrame, traffic: DataFrame) -> DataFrame:
    """indicator, src_ip and host, each once: sources that used a name which an indicator (domain) is, or is a parent of.

    Every parent of a name is met, not only the nearest: one name answers all indicators that it lies under.
    """
    seen = traffic.select("src_ip", names.clean(F.col("host")).alias("host")).filter("host <> ''").distinct()
    wanted = indicators.select(names.clean(F.col("domain")).alias("indicator")).filter("indicator <> ''").distinct()
    walked = seen.select("src_ip", "host", F.explode(names.suffixes(F.col("host"))).alias("indicator"))
    return walked.join(joins.sized(wanted), "indicator").select("indicator", "src_ip", "host").distinct()


def explained(alerts: DataFrame, explanations: DataFrame) -> DataFrame:
    """alerts with explanation, the latest that is stored for their id, or null. explanations has alert_id, ts_us, text."""
    latest = explanations.groupBy("alert_id").agg(F.max_by("text", F.struct("ts_us", "text")).alias("explanation"))
    return alerts.join(latest, "alert_id", "left")


def certificates(*lists: DataFrame) -> DataFrame:
    """Certificates of several lists (id and what else they have), each id once: the entry of the first list that has it."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (x.withColumn("_no", F.lit(i)) for i, x in enumerate(lists)))
    columns = [c for c in every.columns if c != "_no"]
    first = every.groupBy("id").agg(F.min(F.struct("_no", F.struct(*columns).alias("row"))).alias("x"))
    return first.select("x.row.*")
