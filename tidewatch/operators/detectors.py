"""Detectors over packets: each takes and returns a DataFrame, one row per alert.

Those whose answer is a function of a frame of rows are windows; those whose answer decides what comes next are folds
by key (see folds). Packets have seq, ts_us, src_ip, dst_ip, dst_port, protocol and bytes. Filters run before the
shuffle, which is on the detector's own key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import host, ip, names

from . import folds


def _sliding(by: list[str], window: int):
    return Window.partitionBy(*by).orderBy("ts_us").rangeBetween(-window, 0)


def brute_force(attempts: DataFrame, least: int = 10, window: int = 30_000_000) -> DataFrame:
    """Attempts at which the number in the last window of (src_ip, dst_ip, dst_port) rises to `least`.

    It fires again only after the number has fallen under `least`. Attempts of one time are counted together.
    """
    by = ["src_ip", "dst_ip", "dst_port"]
    c = F.count(F.lit(1)).over(_sliding(by, window)).alias("attempts")
    counted = attempts.select(*by, "ts_us", "seq", c)
    before = F.coalesce(F.lag("attempts").over(Window.partitionBy(*by).orderBy("ts_us", "seq")), F.lit(0))
    return counted.withColumn("before", before).filter((F.col("attempts") >= least) & (F.col("before") < least)).drop("before")


def beacons(packets: DataFrame, least: int = 6, history: int = 30, longest_gap: int = 3_600_000_000, shortest_mean: int = 1_000_000, most_cv: float = 0.2) -> DataFrame:
    """The first packet of each (src_ip, dst_ip, dst_port) whose gaps are regular.

    Regular: of the last `history` times there are `least` at least, one gap fewer of them is at most longest_gap, and
    those gaps have a mean of shortest_mean or more and a coefficient of variation of most_cv or less.
    """
    by = ["src_ip", "dst_ip", "dst_port"]
    order = Window.partitionBy(*by).orderBy("ts_us", "seq")
    frame = order.rowsBetween(-(history - 2), 0)
    gap = F.col("ts_us") - F.lag("ts_us").over(order)
    gaps = packets.select(*by, "ts_us", "seq", gap.alias("gap")).withColumn("gap", F.when(F.col("gap") <= longest_gap, F.col("gap") / 1e6))
    stats = gaps.select("*", F.count("gap").over(frame).alias("n_gaps"), F.avg("gap").over(frame).alias("mean_s"), F.stddev_pop("gap").over(frame).alias("sd_s"))
    regular = stats.filter((F.col("n_gaps") >= least - 1) & (F.col("mean_s") >= shortest_mean / 1e6)).withColumn("cv", F.col("sd_s") / F.col("mean_s")).filter(F.col("cv") <= most_cv)
    first = regular.groupBy(*by).agg(F.min(F.struct("ts_us", "seq", "n_gaps", "mean_s", "cv")).alias("x")).select(*by, "x.*")
    return first.withColumn("confidence", F.greatest(F.lit(0.0), 1 - F.col("cv") / most_cv))


def exfiltration(packets: DataFrame, most_bytes: int) -> DataFrame:
    """The packet at which a flow has sent most_bytes, once for each flow."""
    by = ["src_ip", "dst_ip", "dst_port", "protocol"]
    upto = Window.partitionBy(*by).orderBy("ts_us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    sent = packets.select(*by, "ts_us", "seq", "bytes").withColumn("sent", F.sum("bytes").over(upto))
    return sent.filter((F.col("sent") >= most_bytes) & (F.col("sent") - F.coalesce("bytes", F.lit(0)) < most_bytes)).groupBy(*by).agg(F.min(F.struct("ts_us", "seq", "sent")).alias("x")).select(*by, "x.*")


def horizontal_scan(packets: DataFrame, least: int = 20, window: int = 60_000_000) -> DataFrame:
    """Distinct destinations of one (src_ip, dst_port) in anchored windows, when they reach `least`; once a window."""
    return _scan(packets, ["src_ip", "dst_port"], "dst_ip", least, window)


def vertical_scan(packets: DataFrame, least: int = 15, window: int = 60_000_000) -> DataFrame:
    """Distinct ports of one (src_ip, dst_ip) in anchored windows, when they reach `least`; once a window."""
    return _scan(packets, ["src_ip", "dst_ip"], "dst_port", least, window)


def _scan(packets: DataFrame, by: list[str], value: str, least: int, window: int) -> DataFrame:
    rows = packets.filter(F.col(value).isNotNull()).select(*by, value, "ts_us", "seq")
    said = folds.fold(rows, by, ["ts_us", "seq"], ["ts_us", value], folds.anchored_distinct(window, least), "targets", "int")
    return said.filter("targets is not null").select(*by, "ts_us", "seq", "targets")


def burst(packets: DataFrame, by: list[str], value: str, least: int, window: int, cooldown: int, strict: bool = True) -> DataFrame:
    """Distinct values of a key in a sliding window, when they reach `least` and the cooldown is over.

    Bursts of failed lookups (strict), of ports on one host and of name lookups before use (not strict) are this.
    """
    rows = packets.filter(F.col(value).isNotNull()).select(*by, value, "ts_us", "seq")
    said = folds.fold(rows, by, ["ts_us", "seq"], ["ts_us", value], folds.sliding_distinct(window, least, cooldown, strict), "distinct", "int")
    return said.filter("distinct is not null").select(*by, "ts_us", "seq", "distinct")


def rate_spikes(packets: DataFrame, window: int = 10_000_000, alpha: float = 0.3, sigma: float = 4.0, least_rate: float = 100.0, least_count: int = 5) -> DataFrame:
    """Packets at which the rate of a source passes its average by sigma deviations, with the figures of that moment."""
    rows = packets.select("src_ip", "ts_us", "seq")
    kind = "struct<rate:double,average:double,deviation:double,spike:boolean>"
    said = folds.fold(rows, ["src_ip"], ["ts_us", "seq"], ["ts_us"], folds.rate_spike(window, alpha, sigma, least_rate, least_count), "now", kind)
    return said.filter("now.spike").select("src_ip", "ts_us", "seq", "now.rate", "now.average", "now.deviation")


def repeats(events: DataFrame, by: list[str], cooldown: int) -> DataFrame:
    """The first event of a key, and each one `cooldown` or more after the last that was reported; how many between."""
    said = folds.fold(events, by, ["ts_us", "seq"], ["ts_us"], folds.cooled(cooldown), "now", "struct<fires:boolean,suppressed:int>")
    return said.filter("now.fires").select(*events.columns, F.col("now.suppressed").alias("suppressed"))


def first_seen(events: DataFrame, by: list[str], learning: int, start: int | None = None) -> DataFrame:
    """Keys first seen after the learning time, which runs from `start` or else from the first event of all."""
    firsts = events.groupBy(*by).agg(F.min(F.struct("ts_us", "seq")).alias("x")).select(*by, "x.ts_us", "x.seq")
    if start is not None:
        return firsts.filter(F.col("ts_us") - start > learning)
    since = events.agg(F.min("ts_us").alias("_since"))
    return firsts.crossJoin(F.broadcast(since)).filter(F.col("ts_us") - F.col("_since") > learning).drop("_since")  # one row


def new_countries(events: DataFrame, learning: int) -> DataFrame:
    """(app, country) first seen more than `learning` after the app itself, with the countries known until then."""
    firsts = events.filter("country is not null").groupBy("app", "country").agg(F.min("ts_us").alias("first_us"))
    w = Window.partitionBy("app").orderBy("first_us", "country")  # as many rows as there are countries
    known = firsts.withColumn("usual", F.sort_array(F.collect_list("country").over(w.rowsBetween(Window.unboundedPreceding, -1)))).withColumn("app_us", F.first("first_us").over(w))
    return known.filter(F.col("first_us") - F.col("app_us") > learning).select("app", "country", "first_us", "usual")


def encoded_names(queries: DataFrame, longest: int = 50) -> DataFrame:
    """Queries whose name tunnels data: a label that looks encoded, or a long part before the registered domain."""
    domain = names.registered_domain(F.col("name"))
    sub = F.regexp_replace(F.substr(names.clean(F.col("name")), F.lit(1), F.length(names.clean(F.col("name"))) - F.length(domain)), r"\.$", "")
    q = queries.withColumn("domain", domain).withColumn("sub", sub)
    encoded = F.exists(F.split("sub", r"\."), names.looks_encoded)
    return q.withColumn("reason", F.when(encoded, "encoded").when(F.length("sub") >= longest, "long")).filter("reason is not null").drop("sub")


def many_subdomains(queries: DataFrame, least: int = 50, window: int = 60_000_000) -> DataFrame:
    """Registered domains of which `least` different names are asked for in an anchored window; once a window.

    queries has name, ts_us and seq. All who ask count together.
    """
    # names are taken apart once each, as that costs most; the join leaves out what has none
    known = queries.groupBy("name").agg(F.max("name").alias("_name"))  # of _name, so that no filter on it runs before
    known = known.select("name", names.registered_domain(F.col("_name")).alias("domain"), names.clean(F.col("_name")).alias("_clean"))
    rows = queries.select("name", "ts_us", "seq").join(known, "name").filter("domain is not null and _clean <> domain").select("domain", F.col("_clean").alias("name"), "ts_us", "seq")
    said = folds.fold(rows, ["domain"], ["ts_us", "seq"], ["ts_us", "name"], folds.anchored_distinct(window, least), "names", "int")
    return said.filter("names is not null").select("domain", "ts_us", "seq", "names")


def first_contacts(packets: DataFrame, by: list[str]) -> DataFrame:
    """The first packet of each value of by: greetings of a name, uses of a protocol, programs on the network."""
    return packets.groupBy(*by).agg(F.min(F.struct("ts_us", "seq")).alias("x")).select(*by, "x.ts_us", "x.seq")


def quic_sessions(packets: DataFrame, greetings: DataFrame | None = None) -> DataFrame:
    """The first greeting of each source by QUIC, by name or else by place: src_ip, target, ts_us, seq.

    packets are those of sources.dissect; what servers send first (from port 443) is no greeting. Names are those of
    greetings, as sources.quic gives them, by the ends of the connection; without them all targets are places.
    """
    ends = ["src_ip", "src_port", "dst_ip", "dst_port"]
    rows = packets.filter((F.col("quic.packet_type") == "Initial") & (F.coalesce("src_port", F.lit(0)) != 443))
    place = F.concat_ws(":", "dst_ip", F.col("dst_port").cast("string"))
    if greetings is not None:
        named = greetings.groupBy(*ends).agg(F.min_by(F.lower("tls.sni"), F.struct("ts_us", "seq")).alias("_sni"))
        rows = rows.join(named, ends, "left")
        place = F.coalesce(F.col("_sni"), place)
    return first_contacts(rows.withColumn("target", place), ["src_ip", "target"])


def greeted_names(*greetings: DataFrame) -> DataFrame:
    """src_ip, dst_ip, ts_us, seq and host: the names of greetings of several protocols, to look them up by."""
    rows = [g.select("src_ip", "dst_ip", "ts_us", "seq", F.lower("tls.sni").alias("host")) for g in greetings]
    return reduce(DataFrame.unionByName, rows).filter("host <> ''")


def web_upgrades(packets: DataFrame) -> DataFrame:
    """Requests that turn into a socket, and those by which a page reports: what (websocket, beacon), of dissected packets."""
    what = F.when(F.col("http.websocket_upgrade"), "websocket").when(F.col("http.beacon_suspect"), "beacon")
    return packets.withColumn("what", what).filter("what is not null").select("seq", "ts_us", "src_ip", "dst_ip", "what", F.col("http.host").alias("host"), F.col("http.uri").alias("uri"))


def risky_programs(packets: DataFrame) -> DataFrame:
    """The first packet to the outside of each program of an odd place or without a signature: exe, risk, flags.

    packets has exe, status, dst_ip, ts_us and seq; programs of the system are passed over.
    """
    rows = packets.filter(ip.is_global(F.col("dst_ip")) & (F.col("exe") != "") & ~host.is_system(F.col("exe"))).withColumn("a", host.assess(F.col("exe"), F.col("status"))).filter("a.risk > 0")
    first = rows.groupBy("exe").agg(F.min(F.struct("ts_us", "seq", "a")).alias("x"))
    return first.select("exe", "x.ts_us", "x.seq", F.col("x.a.risk").alias("risk"), F.col("x.a.flags").alias("flags"))


def tracker_hits(packets: DataFrame, trackers: DataFrame, host: str = "host") -> DataFrame:
    """The first contact of each source with each host whose domain, or parent domain, is a tracker."""
    from .joins import domain_suffix

    met = domain_suffix(packets, host, trackers, ["category"]).filter("category is not null")
    return met.groupBy("src_ip", host).agg(F.min(F.struct("ts_us", "seq", "category")).alias("x")).select("src_ip", host, "x.*")


def flow_sessions(packets: DataFrame, gap: int = 60_000_000) -> DataFrame:
    """Flows without connections: one row per session of a pair of endpoints, in either direction.

    A session goes on as long as no more than gap passes between packets. The initiator is the source of the first.
    """
    a, b = (F.struct(F.coalesce(f"{x}_ip", F.lit("")).alias("ip"), F.coalesce(f"{x}_port", F.lit(0)).alias("port")) for x in ("src", "dst"))
    rows = packets if "src_port" in packets.columns else packets.withColumn("src_port", F.lit(None).cast("int"))
    rows = rows.withColumn("lo", F.least(a, b)).withColumn("hi", F.greatest(a, b))
    by = ["protocol", "lo", "hi"]
    w = Window.partitionBy(*by).orderBy("ts_us", "seq")
    new = F.when(F.col("ts_us") - F.lag("ts_us").over(w) <= gap, 0).otherwise(1)
    cut = rows.withColumn("new", new).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    flows = cut.groupBy(*by, "session").agg(
        F.min(F.struct("ts_us", "seq", "src_ip", "dst_ip", "dst_port")).alias("x"), F.max("ts_us").alias("last_us"), F.count(F.lit(1)).alias("packets"), F.sum("bytes").alias("bytes")
    )
    return flows.select("protocol", "x.src_ip", "x.dst_ip", "x.dst_port", F.col("session").cast("long"), F.col("x.ts_us").alias("first_us"), "last_us", "packets", "bytes")


def web_attacks(requests: DataFrame) -> DataFrame:
    """Requests whose address, decoded, carries an attack: one row per kind, with its severity.

    requests has uri and, if there are, user_agent and body, which is read whole.
    """
    plain = F.coalesce(F.try_url_decode("uri"), F.col("uri"))
    body = F.col("body") if "body" in requests.columns else F.lit("")
    text = F.concat_ws(" ", plain, body)
    agent = F.col("user_agent") if "user_agent" in requests.columns else F.lit(None).cast("string")
    kinds = (
        ("sql_injection", 4, text.rlike(r"(?i)\bunion\s+(all\s+)?select\b|'\s*or\s+'?\d+'?\s*=\s*'?\d|;\s*drop\s+table\b|\bsleep\s*\(\s*\d")),
        ("script_injection", 3, text.rlike(r"(?i)<script\b|javascript:|\bon(error|load|click)\s*=")),
        ("path_traversal", 3, F.concat_ws(" ", F.col("uri"), plain).rlike(r"(?i)\.\./|\.\.\\|%2e%2e(%2f|/)|/etc/passwd")),
        ("scanner", 1, agent.rlike(r"(?i)sqlmap|nikto|nmap|masscan|gobuster|dirbuster|wpscan|zgrab")),
    )
    hits = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(k).alias("attack"), F.lit(s).alias("severity"))) for k, s, c in kinds)))
    return requests.withColumn("hit", F.explode(hits)).select(*requests.columns, "hit.*")


def address_leaks(mapped: DataFrame) -> DataFrame:
    """Addresses that a peer connection gave away: private ones are leaks, others show the public address."""
    kind = ip.classify(F.col("address"))
    return mapped.withColumn("finding", F.when(kind.isin("private", "loopback", "link_local"), "leak").otherwise("reflexive")).withColumn("severity", F.when(F.col("finding") == "leak", 3).otherwise(1))
