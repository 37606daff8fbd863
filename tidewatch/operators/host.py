"""The inspector of a host: its sockets, programs, listeners, launch items and neighbours, as joins and aggregations.

Sockets have pid, proto, local_ip, local_port, remote_ip, remote_port, listening, exe, app and status (of the signature).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import host, ip

from . import joins

#: Ports on which every host announces itself; listeners there do not count as exposed.
DISCOVERY_PORTS = (5353, 1900, 5355)
#: Tags of outside scans that speak of control servers: fixed values.
CONTROL_TAGS = ("c2", "malware", "botnet")


def merged(sockets: DataFrame, more: DataFrame) -> DataFrame:
    """sockets and the rows of more whose (proto, local_port) sockets do not have."""
    extra = more.join(sockets.select("proto", "local_port").distinct(), ["proto", "local_port"], "left_anti")
    return sockets.unionByName(extra, allowMissingColumns=True)


def _assessed(sockets: DataFrame) -> DataFrame:
    return sockets.withColumn("_a", F.when(F.col("exe") != "", host.assess(F.col("exe"), F.col("status")))).withColumns({"flags": F.coalesce("_a.flags", F.array().cast("array<string>")), "risk": F.coalesce("_a.risk", F.lit(0))}).drop("_a")


def connections(sockets: DataFrame, remotes: DataFrame, alerts: DataFrame, intel: DataFrame, tags: DataFrame, with_local: bool = False) -> DataFrame:
    """Connected sockets with what is known of the other end: name and country, alerts, intelligence, outside tags; flags, risk.

    remotes: remote_ip, remote_host, country; alerts: ip, n, worst, beacon, c2 (see live.alert_index), both a row for each
    address; intel: ip, category; tags: ip, tag. What is known of an address is put together first, so that sockets meet
    it in one join: a broadcast where it is measured to be small, else a shuffle in which a busy remote can be split.
    """
    rows = _assessed(sockets.filter("not listening and remote_ip <> ''")).withColumn("scope", host.scope(F.col("remote_ip")))
    rows = rows if with_local else rows.filter("scope <> 'loopback'")
    rows = rows.join(joins.sized(_known(remotes, alerts, intel, tags)), "remote_ip", "left").select("*", "_named.*", "_alerted.*").drop("_named", "_alerted")
    beacon, c2, infra_ = (F.coalesce(c, F.lit(False)) for c in ("beacon", "c2", "_infra"))
    known = F.col("intel").isNotNull() & ip.is_global(F.col("remote_ip"))
    flags = F.concat("flags", F.array_compact(F.array(F.when(known, "intel"), F.when(beacon, "beacon"), F.when(c2, "c2"), F.when(infra_, "c2_infra"))))
    calls = F.when(beacon, F.when((F.col("risk") > 0) | F.col("remote_host").isNull(), 2).otherwise(1)).otherwise(0)
    risk = F.when(known | c2 | infra_, 3).otherwise(F.greatest("risk", calls))
    return rows.select(*(c for c in sockets.columns), "scope", "remote_host", "country", F.when(known, F.col("intel")).alias("intel"), F.coalesce("n", F.lit(0)).alias("alerts"), "worst", flags.alias("flags"), risk.alias("risk"))


def _known(remotes: DataFrame, alerts: DataFrame, intel: DataFrame, tags: DataFrame) -> DataFrame:
    """remote_ip and what is known of it, in one aggregation of all that says something of an address."""
    said = [
        remotes.select("remote_ip", F.struct("remote_host", "country").alias("_named")),
        alerts.select(F.col("ip").alias("remote_ip"), F.struct("n", "worst", "beacon", "c2").alias("_alerted")),
        intel.select(F.col("ip").alias("remote_ip"), F.col("category").alias("intel")),
        tags.filter(F.lower("tag").isin(*CONTROL_TAGS)).select(F.col("ip").alias("remote_ip"), F.lit(True).alias("_infra")),
    ]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), said).filter("remote_ip is not null")
    return every.groupBy("remote_ip").agg(F.max("_named").alias("_named"), F.max("_alerted").alias("_alerted"), F.min("intel").alias("intel"), F.max("_infra").alias("_infra"))


def listeners(sockets: DataFrame) -> DataFrame:
    """Listening services, one for each program, protocol and port however many addresses, with the widest exposure."""
    rows = _assessed(sockets.filter("listening")).withColumn("_rank", host.exposure_rank(host.exposure(F.col("local_ip"))))
    by = rows.groupBy(F.coalesce(F.col("pid").cast("string"), F.col("exe"), F.lit("")).alias("program"), "proto", "local_port").agg(
        F.array_sort(F.collect_set("local_ip")).alias("addresses"), F.max("_rank").alias("_rank"), F.max("risk").alias("risk"), F.max(F.struct("risk", "flags")).alias("_x")
    )
    exposure = F.element_at(F.array(*map(F.lit, host.EXPOSURES)), F.col("_rank") + 1)
    by = by.withColumn("exposure", exposure)
    exposed = F.col("exposure").isin("lan", "all_networks") & ~F.coalesce(F.col("local_port").isin(*DISCOVERY_PORTS), F.lit(False))
    return by.select("program", "proto", "local_port", "addresses", "exposure", F.when(exposed, F.array_append("_x.flags", F.lit("exposed"))).otherwise(F.col("_x.flags")).alias("flags"), "risk")


def programs(sockets: DataFrame, connected: DataFrame) -> DataFrame:
    """Programs, helpers of one bundle together: processes, binaries, connections, listeners, remotes, flags, worst risk and
    the binary that has it. connected is what connections() gave."""
    both = _assessed(sockets.filter("listening")).select("pid", "exe", "app", "flags", "risk", F.lit(1).alias("l"), F.lit(None).cast("string").alias("remote_ip"))
    both = both.unionByName(connected.select("pid", "exe", "app", "flags", "risk", F.lit(0).alias("l"), "remote_ip"))
    key = F.coalesce(host.bundle(F.col("exe")), F.when(F.col("exe") != "", F.col("exe")), F.concat(F.lit("pid:"), F.col("pid").cast("string")))
    return both.groupBy(key.alias("program")).agg(
        F.max_by("exe", F.struct("risk", "exe")).alias("riskiest"), F.min("app").alias("app"), F.countDistinct("pid").alias("pids"), F.countDistinct(F.when(F.col("exe") != "", F.col("exe"))).alias("binaries"),
        F.sum(1 - F.col("l")).alias("connections"), F.sum("l").alias("listening"), F.countDistinct("remote_ip").alias("remotes"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("flags")))).alias("flags"), F.max("risk").alias("risk"),
    )


def summary(connected: DataFrame, listening: DataFrame, programs_: DataFrame) -> DataFrame:
    """One row of counts over the three."""
    a = connected.agg(F.count(F.lit(1)).alias("connections"), F.count_if(F.col("scope") == "internet").alias("internet"))
    b = listening.agg(F.count_if(F.array_contains("flags", "exposed")).alias("exposed_ports"))
    c = programs_.agg(F.count(F.lit(1)).alias("programs"), F.count_if(F.col("risk") >= 2).alias("flagged_programs"))
    return a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))  # one row each


def started_by(programs_: DataFrame, items: DataFrame, most: int = 3) -> DataFrame:
    """(program, label) of the launch items that start a program, or one of its bundle: `most` at most, by label."""
    key = lambda c: F.coalesce(host.bundle(F.col(c)), F.col(c))
    met = programs_.select("program").distinct().join(items.withColumn("program", key("path")), "program")
    place = F.row_number().over(Window.partitionBy("program").orderBy("label"))
    return met.withColumn("r", place).filter(F.col("r") <= most).select("program", "label")


def launch_items(items: DataFrame, files: DataFrame) -> DataFrame:
    """Launch items (label, path, status, modified_us) with flags and risk; missing_program where files (path) has none."""
    there = files.select("path").distinct().withColumn("_there", F.lit(True))
    rows = items.join(there, "path", "left").withColumn("_a", host.assess(F.col("path"), F.col("status")))
    missing = (F.col("path") != "") & F.col("_there").isNull()
    return rows.select(*items.columns, F.when(missing, F.array_append("_a.flags", F.lit("missing_program"))).otherwise(F.col("_a.flags")).alias("flags"), F.col("_a.risk").alias("risk"))


def devices(seen: DataFrame, now: int, since: int, learning: int = 3_600_000_000) -> DataFrame:
    """Neighbours by hardware address: address, times, whether it is online, new (in the last day, after learning) or made up."""
    by = seen.withColumn("mac", host.mac(F.col("mac"))).groupBy("mac").agg(F.max_by("ip", F.struct("ts_us", "ip")).alias("ip"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))
    return by.select(
        "*", (now - F.col("last_us") < 600_000_000).alias("online"), ((now - F.col("first_us") < 86_400_000_000) & (F.col("first_us") - since >= learning)).alias("new"), host.is_random_mac(F.col("mac")).alias("random_mac")
    )


def dossier(address: str, devices_: DataFrame, sockets: DataFrame, remotes: DataFrame, alerts: DataFrame, most: int = 20) -> DataFrame:
    """One row about an address: its device, name, country, the apps that talk to it, and its latest alerts."""
    one = remotes.sparkSession.createDataFrame([(address,)], "ip string").coalesce(1)
    apps = sockets.filter(F.col("remote_ip") == address).groupBy(F.col("remote_ip").alias("ip")).agg(F.array_sort(F.collect_set("app")).alias("apps"))
    mine = alerts.filter((F.col("src_ip") == address) | (F.col("dst_ip") == address)).orderBy(F.desc("ts_us"), F.desc("alert_id")).limit(most)
    listed = mine.groupBy(F.lit(address).alias("ip")).agg(F.reverse(F.array_sort(F.collect_list(F.struct("ts_us", "alert_id")))).alias("x")).select("ip", F.transform("x", lambda a: a["alert_id"]).alias("alert_ids"))
    known = remotes.filter(F.col("remote_ip") == address).select(F.col("remote_ip").alias("ip"), "remote_host", "country")
    device = devices_.filter(F.col("ip") == address).select("ip", "mac", "online")
    return one.join(device, "ip", "left").join(known, "ip", "left").join(apps, "ip", "left").join(listed, "ip", "left")


def mentions(alerts: DataFrame, addresses: DataFrame) -> DataFrame:
    """(ip, alert_id) for each of addresses (ip) and alert of which it is an end: two equi-joins, each alert once."""
    ends = [alerts.join(addresses.select(F.col("ip").alias(f"{s}_ip")).distinct(), f"{s}_ip").select(F.col(f"{s}_ip").alias("ip"), "alert_id") for s in ("src", "dst")]
    return ends[0].unionByName(ends[1]).distinct()


#: How lists of the inspector are ordered, by name: columns, those with a minus from the greatest.
ORDERS = {
    "connections": ("-risk", "app", "remote_ip", "remote_port"),
    "launch_items": ("-risk", "-modified_us", "label"),
    "listeners": ("-risk", "local_port", "program"),
    "programs": ("-risk", "-connections", "program"),
}


def ordered(rows: DataFrame, what: str) -> DataFrame:
    """Rows of the inspector in the order in which they are shown: the riskiest first."""
    return rows.orderBy(*(F.desc_nulls_last(c[1:]) if c[0] == "-" else F.asc_nulls_last(c) for c in ORDERS[what]))


def asked(connected: DataFrame, flagged: bool = False, internet: bool = False, app: str | None = None, most: int = 80) -> DataFrame:
    """What connections() gave, for a question: only those with flags, or to the Internet, or of apps whose name holds a text
    in whatever case; the riskiest first, `most` at most."""
    rows = connected.filter(F.size("flags") > 0) if flagged else connected
    rows = rows.filter("scope = 'internet'") if internet else rows
    rows = rows.filter(F.contains(F.lower("app"), F.lit(app.lower()))) if app else rows
    return ordered(rows, "connections").limit(most)
