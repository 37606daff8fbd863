"""What a live view shows, as aggregations: traffic by app and remote, rates, kinds of alerts, detections, flows.

Every count is exact. Traffic has ts_us, seq, bytes, direction (outbound, inbound, transit; others take no part), app,
remote_ip, remote_host and country; alerts are those of operators.alerts with tags (an array), technique and remote_ip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of alerts in the order in which views show them: fixed values.
KINDS = ("threat", "attack", "webrtc", "localhost", "doh", "tracker", "beacon", "websocket", "quic", "prefetch", "host", "other")
#: Kinds that a tag or the beginning of a rule's name makes, in the order of the test: fixed values.
BY_TAG = (
    ("webrtc", ("webrtc",), "STEALTH-WEBRTC"),
    ("localhost", ("localhost_probe", "localhost_scan"), "STEALTH-LOCALHOST"),
    ("doh", ("doh", "encrypted_dns"), "STEALTH-ENCRYPTED-DNS"),
    ("quic", ("quic",), "STEALTH-QUIC"),
    ("websocket", ("websocket",), "STEALTH-WEBSOCKET"),
    ("tracker", ("tracker",), "STEALTH-TRACKER"),
    ("beacon", ("beacon",), "STEALTH-BEACON"),
    ("prefetch", ("dns_prefetch",), "STEALTH-DNS-PREFETCH"),
    ("host", ("host_risk", "new_program", "baseline", "new_device"), None),
)
#: Tags that name a detector, the first one that an alert has counts: fixed values.
LABELS = ("beaconing", "dga", "dns_tunneling", "brute_force", "host_sweep", "vertical_scan", "volumetric", "sqli", "xss", "path_traversal", "scanner", "exfiltration", "correlation", "threat_intel")
NO_APP = "Unattributed"


def kind(rule_id: Column, tags: Column, alert_type: Column) -> Column:
    """The kind of an alert, for every view the same: one of KINDS."""
    rule, has = F.upper(F.coalesce(rule_id, F.lit(""))), lambda *names: F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, names))), F.lit(False))
    out = F.when((alert_type == "threat_intel") | has("likely_c2"), "threat")
    for name, marks, prefix in BY_TAG:
        exact = name == "doh"  # one rule, not a family of them
        out = out.when(has(*marks) | ((rule == prefix) if exact else rule.startswith(prefix) if prefix else F.lit(False)), name)
    return out.when(alert_type.isin("signature", "anomaly", "behavioral", "correlation"), "attack").otherwise("other")


def label(rule_id: Column, tags: Column, alert_type: Column) -> Column:
    """The rule of an alert, or else the detector that its tags name."""
    known = F.get(F.filter(F.array(*map(F.lit, LABELS)), lambda x: F.array_contains(tags, x)), F.lit(0))
    return F.coalesce(F.when(rule_id != "", rule_id), F.concat(F.lit("detector:"), F.coalesce(known, F.get(tags, F.lit(0)), alert_type)))


def _seen(traffic: DataFrame) -> DataFrame:
    return traffic.filter(F.col("direction").isin("outbound", "inbound", "transit")).withColumn("app", F.coalesce("app", F.lit(NO_APP)))


def _top(rows: DataFrame, by: str, value: str, most: int, name: str) -> DataFrame:
    """For each of by, the values with the most bytes, in order, ties to the smaller: an array of at most `most`."""
    sums = rows.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.sum("bytes").alias("_b"))
    ranked = sums.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("_b"), value))).filter(F.col("_r") <= most)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_r", value))), lambda x: x[value])
    return ranked.groupBy(by).agg(listed.alias(name))


def apps(traffic: DataFrame, alerts: DataFrame | None = None, most: int = 6) -> DataFrame:
    """Per app: bytes in and out, packets, distinct remotes, alerts, its hosts and countries with the most bytes, times."""
    rows = _seen(traffic)
    by_remote = rows.groupBy("app", "remote_ip").agg(
        F.sum(F.when(F.col("direction") == "outbound", F.col("bytes")).otherwise(0)).alias("o"), F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi")
    )
    out = by_remote.groupBy("app").agg(
        F.sum("o").alias("bytes_out"), (F.sum("b") - F.sum("o")).alias("bytes_in"), F.sum("n").alias("packets"), F.count("remote_ip").alias("remotes"), F.min("lo").alias("first_us"), F.max("hi").alias("last_us")
    )
    out = out.join(_top(rows, "app", "remote_host", most, "top_hosts"), "app", "left").join(_top(rows, "app", "country", most, "countries"), "app", "left")
    if alerts is None:
        return out.withColumn("alerts", F.lit(0).cast("long"))
    n = alerts.filter("app is not null").groupBy("app").agg(F.count(F.lit(1)).alias("alerts"))
    return out.join(n, "app", "left").withColumn("alerts", F.coalesce("alerts", F.lit(0)))


def remotes(traffic: DataFrame, alerts: DataFrame | None = None, latest: tuple[str, ...] = ("remote_host", "country")) -> DataFrame:
    """Per remote address: bytes, packets, its apps, alerts, times, and the latest known of what is said of it."""
    rows = _seen(traffic).filter("remote_ip is not null")
    known = [F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.struct("ts_us", "seq"))).alias(c) for c in latest]
    out = rows.groupBy("remote_ip").agg(
        F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("packets"), F.array_sort(F.collect_set("app")).alias("apps"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), *known
    )
    if alerts is None:
        return out.withColumn("alerts", F.lit(0).cast("long"))
    n = alerts.filter("remote_ip is not null").groupBy("remote_ip").agg(F.count(F.lit(1)).alias("alerts"))
    return out.join(n, "remote_ip", "left").withColumn("alerts", F.coalesce("alerts", F.lit(0)))


def rates(traffic: DataFrame, now: int, step: int = 1_000_000, n: int = 60) -> DataFrame:
    """Packets and bytes of each of the n steps before the one that holds now, 0 where there were none."""
    last = now // step
    found = traffic.filter((F.col("ts_us") >= (last - n) * step) & (F.col("ts_us") < last * step))
    counted = found.groupBy(F.floor(F.col("ts_us") / step).cast("long").alias("step")).agg(F.count(F.lit(1)).alias("packets"), F.sum("bytes").alias("bytes"))
    every = traffic.sparkSession.range(last - n, last).withColumnRenamed("id", "step")
    return every.join(counted, "step", "left").select("step", F.coalesce("packets", F.lit(0)).alias("packets"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def rate_now(series: DataFrame, step: int = 1_000_000, last: int = 5) -> DataFrame:
    """Packets and bits a second, the mean of the last steps of rates()."""
    at = F.col("step") > F.max("step").over(Window.partitionBy()) - last  # as many rows as the series has steps
    seconds = last * step / 1e6
    tail = series.withColumn("_in", at).filter("_in")
    return tail.agg(F.round(F.sum("packets") / seconds, 1).alias("pps"), F.round(F.sum("bytes") * 8 / seconds).cast("long").alias("bps"))


def summary(alerts: DataFrame) -> DataFrame:
    """Counts by kind and by severity, with 0 for those without alerts: dimension, value, n."""
    spark = alerts.sparkSession
    every = [("kind", k) for k in KINDS] + [("severity", str(s)) for s in range(1, 5)]
    dim = spark.createDataFrame(every, "dimension string, value string").coalesce(1)
    both = alerts.select(F.explode(F.array(F.struct(F.lit("kind").alias("dimension"), F.col("kind").alias("value")), F.struct(F.lit("severity").alias("dimension"), F.col("severity").cast("string").alias("value")))).alias("x"))
    counted = both.groupBy("x.dimension", "x.value").agg(F.count(F.lit(1)).alias("n"))
    return dim.join(counted, ["dimension", "value"], "left").select("dimension", "value", F.coalesce("n", F.lit(0)).alias("n"))


def by_detection(alerts: DataFrame) -> DataFrame:
    """Per detection (see label): count, worst severity, times, and the last message."""
    named = alerts.withColumn("name", label(F.col("rule_id"), F.col("tags"), F.col("alert_type")))
    return named.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.max("severity").alias("worst"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.max_by("message", F.struct("ts_us", "alert_id")).alias("example"))


def by_offender(alerts: DataFrame, most: int = 100, latest: tuple[str, ...] = ("remote_host", "country")) -> DataFrame:
    """Who keeps setting off alerts of threats, attacks and hosts: the remote address, or else the source."""
    rows = alerts.filter(F.col("kind").isin("threat", "attack", "host")).withColumn("ip", F.coalesce("remote_ip", "src_ip")).filter("ip is not null")
    known = [F.max_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.struct("ts_us", "alert_id"))).alias(c) for c in latest]
    rows = rows.withColumn("name", label(F.col("rule_id"), F.col("tags"), F.col("alert_type")))
    by = rows.groupBy("ip").agg(F.count(F.lit(1)).alias("n"), F.max("severity").alias("worst"), F.array_sort(F.collect_set("name")).alias("detections"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), *known)
    return by.orderBy(F.desc("worst"), F.desc("n"), "ip").limit(most)


def alert_index(alerts: DataFrame) -> DataFrame:
    """Per remote address (or else destination): count, worst severity, whether it beacons or is likely a control server."""
    rows = alerts.withColumn("ip", F.coalesce("remote_ip", "dst_ip")).filter("ip is not null")
    has = lambda tag: F.coalesce(F.bool_or(F.array_contains("tags", tag)), F.lit(False))
    return rows.groupBy("ip").agg(F.count(F.lit(1)).alias("n"), F.max("severity").alias("worst"), has("beaconing").alias("beacon"), has("likely_c2").alias("c2"))


def flow_counts(flows: DataFrame) -> DataFrame:
    """Flows by protocol and by state: dimension, value, n."""
    both = flows.select(F.explode(F.array(F.struct(F.lit("protocol").alias("dimension"), F.col("protocol").alias("value")), F.struct(F.lit("state").alias("dimension"), F.col("state").alias("value")))).alias("x"))
    return both.groupBy("x.dimension", "x.value").agg(F.count(F.lit(1)).alias("n"))


#: Orders of flow_list() and the column that each sorts by, the greatest first.
ORDERS = {"recent": "last_us", "bytes": "bytes", "duration": "duration_us", "packets": "packets"}


def flow_list(flows: DataFrame, order: str = "recent", text: str | None = None, state: str | None = None, most: int = 100) -> DataFrame:
    """Flows in one of ORDERS, with ties to the smaller id; text must be in one of their fields, state is theirs or
    their outcome."""
    if order not in ORDERS:
        raise ValueError(f"order must be one of {sorted(ORDERS)}")
    rows = flows.withColumn("duration_us", F.col("last_us") - F.col("first_us"))
    if text:
        fields = [c for c in ("src_ip", "dst_ip", "src_port", "dst_port", "protocol", "state", "outcome", "app", "server_name", "country") if c in rows.columns]
        rows = rows.filter(F.contains(F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c in fields))), F.lit(text.lower())))
    if state:
        rows = rows.filter((F.lower("state") == state.lower()) | (F.lower("outcome") == state.lower()))
    return rows.orderBy(F.desc(ORDERS[order]), "flow_id", "flow").limit(most)


def flow_names(flows: DataFrame, remotes_: DataFrame, keep: tuple[str, ...] = ("remote_host", "country")) -> DataFrame:
    """flows with what is known of their destination, or else of their source."""
    out = flows
    for side in ("dst", "src"):
        known = remotes_.select(F.col("remote_ip").alias(f"_{side}"), F.struct(*keep).alias(f"_of_{side}"))
        out = out.join(known, F.col(f"{side}_ip") == F.col(f"_{side}"), "left").drop(f"_{side}")
    return out.select(*flows.columns, *(F.coalesce(F.col(f"_of_dst.{c}"), F.col(f"_of_src.{c}")).alias(c) for c in keep))


def annotated(packets: DataFrame, by: list[str], names: tuple[str, ...] = ("app_proto", "server_name", "app")) -> DataFrame:
    """Per flow, the first known value of each name in order of time: what a flow is taken to be."""
    first = [F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.struct("ts_us", "seq"))).alias(c) for c in names]
    return packets.groupBy(*by).agg(*first)


def engine_stats(traffic: DataFrame, flows: DataFrame, rules: int) -> DataFrame:
    """One row: packets, seconds between the first and the last, packets a second, flows, rules."""
    seen = traffic.agg(F.count(F.lit(1)).alias("packets"), ((F.max("ts_us") - F.min("ts_us")) / 1e6).alias("seconds"))
    n = flows.agg(F.count(F.lit(1)).alias("flows"))
    rate = F.when(F.col("seconds") > 0, F.round(F.col("packets") / F.col("seconds"), 6)).otherwise(0.0)
    return seen.crossJoin(F.broadcast(n)).select("packets", F.round("seconds", 3).alias("seconds"), rate.alias("pps"), "flows", F.lit(rules).alias("rules"))  # one row each
