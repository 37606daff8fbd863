"""From raw alerts to those that are shown: gate, suppress, drop duplicates, correlate; and what is asked of them.

Alerts have alert_id, ts_us, rule_id, alert_type, severity (1 low to 4 critical), src_ip, dst_ip, dst_port. All times
are those of the events, so that a replay gives what the live stream gave.
"""

from __future__ import annotations

import re
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import ip

from . import folds, joins

SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), rank.cast("int"))


def gate(alerts: DataFrame, least: int) -> DataFrame:
    return alerts.filter(F.col("severity") >= least)


def dedup_key() -> Column:
    """What two alerts of one kind between the same ends share; nulls count as a value."""
    kind = F.when(F.col("rule_id") != "", F.col("rule_id")).otherwise(F.col("alert_type"))
    return F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("None")) for c in (kind, F.col("src_ip"), F.col("dst_ip"), F.col("dst_port"))))


def without_duplicates(alerts: DataFrame, window: int = 60_000_000, order: str = "alert_id") -> DataFrame:
    """The first alert of a key and each one `window` or more after the last that stayed, with duplicate_count: how many
    were dropped for it. A window of 0 keeps all.

    Of alerts of one time the least by order, and then by all columns, is the first. An alert that comes again, under its
    own name or without one, is a duplicate like any other; one without a time stays as it is. Columns must have an order.
    """
    none = F.lit(0).cast("long").alias("duplicate_count")
    if window <= 0:
        return alerts.select("*", none)
    rows = alerts.filter("ts_us is not null").select(dedup_key().alias("_key"), "ts_us", F.col(order).alias("_name"), F.struct(*(F.col(f"`{c}`") for c in alerts.columns)).alias("_row"))
    at = folds.fold(rows, ["_key"], ["ts_us", "_name"], ["ts_us"], folds.anchored(window - 1, inclusive=True), "_anchor", "long")
    first = at.groupBy("_key", "_anchor").agg(F.min(F.struct("ts_us", "_name", "_row")).alias("x"), (F.count(F.lit(1)) - 1).alias("duplicate_count"))
    return first.select("x._row.*", "duplicate_count").unionByName(alerts.filter("ts_us is null").select("*", none))


def correlated(alerts: DataFrame, least: int = 3, window: int = 120_000_000, cooldown: int = 120_000_000, least_severity: int = 2) -> DataFrame:
    """Sources with `least` distinct kinds of alerts in a sliding window, at most once in each cooldown.

    Kinds are rules, or types where there is no rule. Correlations themselves take no part.
    """
    said = folds.fold(kinds_of(alerts, least_severity), ["src_ip"], ["ts_us", "seq"], ["ts_us", "kind"], folds.sliding_distinct(window, least, cooldown, strict=False), "kinds", "int")
    return said.filter("kinds is not null").select("src_ip", "ts_us", F.col("seq").alias("alert_id"), "kinds")


def kinds_of(alerts: DataFrame, least_severity: int) -> DataFrame:
    """What correlation looks at: src_ip, ts_us, seq, kind."""
    return gate(alerts, least_severity).filter("alert_type <> 'correlation'").select("src_ip", "ts_us", F.col("alert_id").alias("seq"), F.coalesce("rule_id", "alert_type").alias("kind"))


def likely_control(signals: DataFrame, least: int = 2, window: int = 21_600_000_000, strong: tuple[str, ...] = ("beacon", "intel", "c2_infra"), weak: tuple[str, ...] = ("bare_ip",)) -> DataFrame:
    """(app, remote_ip) with `least` kinds of signals besides the weak ones, a strong one among them, within the window;
    at most one alert in each window. Signals have app, remote_ip, kind, ts_us and seq."""

    said = folds.fold(signals, ["app", "remote_ip"], ["ts_us", "seq"], ["ts_us", "kind"], lambda: _Signals(least, window, strong, weak), "signals", "array<string>")
    found = said.filter("signals is not null")
    n = F.size(F.array_except("signals", F.array(*map(F.lit, weak))))
    return found.select("app", "remote_ip", "ts_us", "seq", "signals", F.least(F.lit(0.95), 0.5 + 0.15 * n).alias("confidence"))


#: Remotes that an app met beyond which its pairs are split.
MOST_PAIRS = 1000


def control_pairs(alerts: DataFrame, infra: DataFrame | None = None, least: int = 2, window: int = 21_600_000_000, strong: tuple[str, ...] = ("beacon", "intel", "c2_infra"), weak: tuple[str, ...] = ("bare_ip",), most_pairs: int = MOST_PAIRS) -> DataFrame:
    """Likely control: app, remote_ip, ts_us, seq, signals, confidence, by pairs of an app and a remote that met.

    alerts has seq, ts_us, app, remote_ip, and the kinds of signals that it is for the app (app_signals) and for the remote
    (remote_signals); either end may be null, and an alert without signals says nothing. A pair has met where an alert
    with signals names both. It is judged at each such alert, and at each alert with a signal of its app for as long as
    the window since it met. Of the app's and the remote's signals of the last window, whoever they came with, `least`
    kinds must not be weak and one must be strong; infra (remote_ip) lists remotes that have c2_infra besides. A pair is
    told of once in a window. Remotes without an app are pairs of their own.

    In a cell of time, which is as long as the window, a signal of one kind and end counts from its first alert until a
    window after its last, so that signals are a row for each end, cell and kind. A remote's meet the pairs that met in
    their own and the two next cells. An app's pairs are judged side by side, by the app's alerts as they are; where it
    met more than most_pairs remotes, its pairs are split and its alerts copied to each part.
    """
    rows = alerts.select("seq", "ts_us", "app", "remote_ip", *(F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("app_signals", "remote_signals")))
    rows = rows.filter(((F.size("app_signals") > 0) | (F.size("remote_signals") > 0)) & F.col("ts_us").isNotNull()).withColumn("cell", F.floor(F.col("ts_us") / window))
    key = F.when(F.col("app").isNull(), "").otherwise(F.concat(F.lit("+"), "app")).alias("_key")
    met = rows.filter("remote_ip is not null")
    pairs = met.select("app", key, "remote_ip", "cell").distinct()
    parts = pairs.groupBy("_key").agg(F.ceil(F.count_distinct("remote_ip") / most_pairs).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("remote_ip"), F.col("parts")).cast("int").alias("part")
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    columns = {"remote_ip": "string", "kind": "string", "until": "long", "listed": "boolean"}

    def events(df: DataFrame, order: int, to: Column) -> DataFrame:
        """Rows of one kind for the parts of their app: remotes' or apps' signals (0), meetings (1), what apps say (2)."""
        own = [F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()]
        return df.join(parts, "_key").select("app", to, "ts_us", "seq", F.lit(order).alias("ord"), *own)

    def signals(side: str, end: str) -> DataFrame:
        """The kinds of a side's signals, once for each end and cell."""
        own = rows.filter((F.size(side) > 0) & F.col(end).isNotNull()).select(end, "cell", "ts_us", "seq", F.explode(side).alias("kind")).filter("kind is not null")
        own = own.groupBy(end, "cell", "kind").agg(F.min(F.struct("ts_us", "seq")).alias("x"), (F.max("ts_us") + window).alias("until"))
        return own.select(end, "cell", "x.ts_us", "x.seq", "kind", "until")

    near = pairs.select("app", "_key", "remote_ip", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell")).distinct()
    meetings = met.select("app", key, "remote_ip", "ts_us", "seq")
    if infra is not None:
        meetings = meetings.join(joins.sized(infra.select("remote_ip", F.lit(True).alias("listed")).distinct()), "remote_ip", "left")
    every = events(signals("remote_signals", "remote_ip").join(near, ["remote_ip", "cell"]), 0, part).unionByName(events(meetings, 1, part))
    every = every.unionByName(events(signals("app_signals", "app").withColumn("_key", key), 0, each))
    every = every.unionByName(events(rows.filter((F.size("app_signals") > 0) & F.col("app").isNotNull()).select("app", key, "ts_us", "seq"), 2, each))
    said = folds.fold(every, ["app", "part"], ["ts_us", "seq", "ord"], ["ts_us", "ord", *columns], lambda: _Pairs(least, window, strong, weak), "found", "array<struct<remote_ip:string,signals:array<string>>>")
    found = said.filter("found is not null").select("app", "ts_us", "seq", F.inline("found"))
    return found.select("app", "remote_ip", "ts_us", "seq", "signals", F.least(F.lit(0.95), 0.5 + 0.15 * F.size("signals")).alias("confidence"))


class _Pair:
    """A remote that the app met: until when its signals count, when they met last and when that was told."""

    __slots__ = ("until", "met", "fired", "listed")

    def __init__(self):
        self.until: dict[str, int] = {}
        self.met: int | None = None
        self.fired: int | None = None
        self.listed = False


class _Pairs:
    """What the signals of an app and its remotes have come to, asked at meetings and at the app's signals.

    A pair that was not told of when it was asked need not be asked again before something is new of it: a signal, a
    meeting, or the end of the window since it was told of. So a row costs no more with many pairs.
    """

    def __init__(self, least: int, window: int, strong: tuple[str, ...], weak: tuple[str, ...]):
        self.least, self.window, self.strong, self.weak = least, window, frozenset(strong), frozenset(weak)
        self.until: dict[str, int] = {}
        self.pairs: dict[str, _Pair] = {}
        self.due: set[str] = set()
        self.asleep: deque[tuple[int, str]] = deque()  # all sleep for as long
        self.idle = 1 << 62

    def run(self, at, orders, remotes, kinds, untils, listed) -> list:
        out: list = []
        for t, order, remote, kind, until, infra in zip(at, orders, remotes, kinds, untils, listed, strict=True):
            said = []
            if order == 2:
                while self.asleep and self.asleep[0][0] <= t:
                    self.due.add(self.asleep.popleft()[1])
                said = [x for r in self.due if (x := self._ask(t, r))]
                self.due.clear()
            elif remote is None:
                if self.until.get(kind, t - 1) < t:
                    self.due.update(self.pairs)
                self.until[kind] = max(self.until.get(kind, until), until)
            else:
                pair = self.pairs.get(remote)
                if pair is None:
                    pair = self.pairs[remote] = _Pair()
                if order == 0:
                    pair.until[kind] = max(pair.until.get(kind, until), until)
                    self.due.add(remote)
                else:
                    pair.met, pair.listed = t, pair.listed or bool(infra)
                    self.due.add(remote)
                    said = [x] if (x := self._ask(t, remote)) else []
            out.append(said or None)
        return out

    def _ask(self, t: int, remote: str) -> dict | None:
        pair = self.pairs[remote]
        if pair.met is None or t - pair.met > self.window or (pair.fired is not None and t - pair.fired < self.window):
            return None
        fresh = {k for held in (self.until, pair.until) for k, end in held.items() if end >= t} | ({"c2_infra"} if pair.listed else set())
        if len(fresh - self.weak) < self.least or not fresh & self.strong:
            return None
        pair.fired = t
        self.asleep.append((t + self.window, remote))
        return {"remote_ip": remote, "signals": sorted(fresh)}


def with_context(alerts: DataFrame) -> DataFrame:
    """alerts whose context holds what is known of their packet too: a map of texts, with the alert's own entries first.

    alerts has context and packet_context (maps, or null), flow (as flows.with_flow() gives it, or null), flow_id and
    dst_ip. An alert with a dst_ip or a flow_id gets the flow's id where it has none, and its facts, as JSON, under flow
    where its context has none. The columns packet_context and flow go.
    """
    none = F.create_map().cast("map<string,string>")
    own, packet = F.coalesce("context", none), F.coalesce("packet_context", none)
    merged = F.map_concat(own, F.map_filter(packet, lambda k, v: ~F.map_contains_key(own, k)))
    about = F.col("flow").isNotNull() & (F.col("dst_ip").isNotNull() | F.col("flow_id").isNotNull())
    added = F.when(about & ~F.map_contains_key(merged, "flow"), F.create_map(F.lit("flow"), F.to_json("flow"))).otherwise(none)
    return alerts.withColumns({"context": F.map_concat(merged, added), "flow_id": F.when(about, F.coalesce("flow_id", "flow.flow_id")).otherwise(F.col("flow_id"))}).drop("packet_context", "flow")


class _Signals:
    """Kinds of signals of the last window, when enough of them are there."""

    def __init__(self, least: int, window: int, strong: tuple[str, ...], weak: tuple[str, ...]):
        self.least, self.window, self.strong, self.weak = least, window, frozenset(strong), frozenset(weak)
        self.latest: dict[str, int] = {}
        self.fired: int | None = None
        self.idle = window + 1

    def run(self, at, kinds) -> list:
        out: list = []
        for t, kind in zip(at, kinds, strict=True):
            self.latest[kind] = t
            fresh = {k for k, since in self.latest.items() if t - since <= self.window}
            if len(fresh - self.weak) < self.least or not fresh & self.strong or (self.fired is not None and t - self.fired < self.window):
                out.append(None)
            else:
                self.fired = t
                out.append(sorted(fresh))
        return out


def stats(alerts: DataFrame, most: int = 10) -> DataFrame:
    """Counts in one pass: in all, by severity, type, source and technique; sources and techniques the most frequent.

    dimension, value, n, first_us, last_us; ties go to the smaller value.
    """
    cubes = alerts.select(F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), v.cast("string").alias("value")) for d, v in (
        ("total", F.lit("")), ("severity", F.col("severity")), ("type", F.col("alert_type")), ("source", F.col("src_ip")), ("technique", F.col("technique")))))).alias("x"), "ts_us")
    counted = cubes.groupBy("x.dimension", "x.value").agg(F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))
    long_ = F.col("dimension").isin("source", "technique")
    top = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("n"), "value"))
    return counted.filter(~long_).unionByName(counted.filter(long_).withColumn("r", top).filter(F.col("r") <= most).drop("r"))


def detections(alerts: DataFrame, techniques: DataFrame) -> DataFrame:
    """Per tactic and technique: count, worst severity, last message; unknown ones count as Other, last in the chain."""
    from .joins import with_parent

    named = with_parent(alerts, "technique", techniques, "technique_id", ["name", "tactic", "place"])
    named = named.withColumns({"tactic": F.coalesce("tactic", F.lit("Other")), "place": F.coalesce("place", F.lit(99)), "name": F.coalesce("name", "technique")})
    return named.groupBy("tactic", "place", "name").agg(F.count(F.lit(1)).alias("n"), F.max("severity").alias("worst"), F.max_by("message", F.struct("ts_us", "alert_id")).alias("last_message"))


def offenders(alerts: DataFrame, most: int = 100) -> DataFrame:
    """Sources by worst severity and then count: their rules and first and last time."""
    by = alerts.groupBy("src_ip").agg(
        F.count(F.lit(1)).alias("n"), F.max("severity").alias("worst"), F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("rules"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us")
    )
    return by.orderBy(F.desc("worst"), F.desc("n"), "src_ip").limit(most)


def attention(alerts: DataFrame, now: int, span: int = 3_600_000_000, least: int = 2, most: int = 8) -> DataFrame:
    """What to look at first: of the last span, one alert for each rule and source, the worst and then the newest."""
    fresh = alerts.filter((F.col("ts_us") > now - span) & (F.col("ts_us") <= now) & (F.col("severity") >= least))
    best = fresh.groupBy("rule_id", "src_ip").agg(F.max(F.struct("severity", "ts_us", "alert_id")).alias("x"))
    return best.select("rule_id", "src_ip", "x.*").orderBy(F.desc("severity"), F.desc("ts_us"), F.desc("alert_id")).limit(most)


def threat_level(alerts: DataFrame, now: int, span: int = 600_000_000) -> DataFrame:
    """One row: ok, notice, warning or critical, by the worst severity of the last span."""
    worst = alerts.filter((F.col("ts_us") > now - span) & (F.col("ts_us") <= now)).agg(F.max("severity").alias("worst"))
    return worst.select(F.when(F.col("worst") == 4, "critical").when(F.col("worst") == 3, "warning").when(F.col("worst") == 2, "notice").otherwise("ok").alias("level"))


def search(alerts: DataFrame, text: str | None = None, least_severity: int | None = None, since: int | None = None, until: int | None = None, rule: str | None = None, app: str | None = None, most: int = 1000) -> DataFrame:
    """Alerts that meet every given condition, newest first. Of text, each word must be a word of the message, the
    addresses or the tag; its first eight words count. since is inclusive, until is not."""
    out = alerts
    if least_severity is not None:
        out = out.filter(F.col("severity") >= least_severity)
    if since is not None:
        out = out.filter(F.col("ts_us") >= since)
    if until is not None:
        out = out.filter(F.col("ts_us") < until)
    if rule is not None:
        out = out.filter(F.col("rule_id") == rule)
    if app is not None:
        out = out.filter(F.col("app") == app)
    for word in re.findall(r"[\w.:\-]+", (text or "").lower())[:8]:
        words = F.regexp_extract_all(F.lower(F.concat_ws(" ", "message", "src_ip", "dst_ip", "tag")), F.lit(r"(?U)[\w.:\-]+"), F.lit(0))
        out = out.filter(F.array_contains(words, word))
    return out.orderBy(F.desc("ts_us"), F.desc("alert_id")).limit(min(most, 1000))


def timeline(alerts: DataFrame, now: int, minutes: int = 60, threat: int = 3) -> DataFrame:
    """Events and threats of each of the last minutes, 0 where there were none."""
    minute = 60_000_000
    last = now // minute
    found = alerts.filter((F.col("ts_us") >= (last - minutes + 1) * minute) & (F.col("ts_us") < (last + 1) * minute))
    counted = found.groupBy(F.floor(F.col("ts_us") / minute).cast("long").alias("minute")).agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("severity") >= threat).alias("threats"))
    every = alerts.sparkSession.range(last - minutes + 1, last + 1).withColumnRenamed("id", "minute")
    return every.join(counted, "minute", "left").select("minute", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("threats", F.lit(0)).alias("threats"))


def block_decisions(alerts: DataFrame, protected: DataFrame, never: tuple[str, ...] = (), ttl: int = 3_600) -> DataFrame:
    """Addresses to block, with the alert that says so and when the block ends; nothing is blocked here.

    Critical alerts of intelligence and correlation count. Addresses that are not global, are protected (a column ip)
    or lie in a network of never stay open. ttl is held between a minute and a week.
    """
    worst = alerts.filter(F.col("alert_type").isin("threat_intel", "correlation") & (F.col("severity") >= 4))
    target = worst.withColumn("ip", F.when(F.col("alert_type") == "correlation", F.col("src_ip")).otherwise(F.when(ip.is_global(F.col("dst_ip")), F.col("dst_ip")).otherwise(F.col("src_ip"))))
    open_ = target.filter(ip.is_global(F.col("ip")) & ~ip.within(ip.number(F.col("ip")), *never)).join(protected.select("ip"), "ip", "left_anti")
    return open_.groupBy("ip").agg(F.min(F.struct("ts_us", "alert_id")).alias("x")).select("ip", "x.alert_id", "x.ts_us", (F.col("x.ts_us") + min(max(ttl, 60), 604_800) * 1_000_000).alias("expires_us"))


def rule_stats(rules: DataFrame, alerts: DataFrame) -> DataFrame:
    """Every rule with its hits and last time; status is disabled, active or quiet."""
    hits = alerts.groupBy("rule_id").agg(F.count(F.lit(1)).alias("hits"), F.max("ts_us").alias("last_us"))
    met = rules.join(hits, "rule_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return met.withColumn("status", F.when(~F.col("enabled"), "disabled").when(F.col("hits") > 0, "active").otherwise("quiet"))
