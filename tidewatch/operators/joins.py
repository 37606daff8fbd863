"""Joins that Spark has no operator for: longest prefix, domain suffix, as-of, ranges and conditions with wildcards.

Each is an equi-join on keys that are derived from both sides, so that it shuffles or broadcasts like any other.
Dimensions are broadcast only where Spark's own size check or a stated bound says so.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions import ip, names

#: Bounds under which a dimension that was measured is broadcast: bytes, as text, and rows, of which one more is read.
MOST_BYTES, MOST_BROADCAST = 32 << 20, 200_000


def sized(dim: DataFrame, most: int = MOST_BROADCAST, most_bytes: int = MOST_BYTES) -> DataFrame:
    """dim, marked for broadcast if it has at most so many rows and bytes."""
    some = dim.limit(most + 1).select(F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in dim.columns)))).alias("n"))
    n, size = some.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return F.broadcast(dim) if n <= most and size <= most_bytes else dim


#: Networks that are looked up length by length in broadcast tables made here; more of them meet the addresses by shuffle.
MOST_LOCAL = 20_000


def longest_prefix(rows: DataFrame, address: str, networks: DataFrame, keep: list[str]) -> DataFrame:
    """rows with the columns `keep` of the most specific network that holds the address, or null.

    networks has cidr text, of IPv4 or IPv6; the later load_no wins where a network comes twice, if there is such a
    column. A network is a text of leading bits, so that there is a key to meet for each length that occurs and no row is
    compared with a range. Few networks (MOST_LOCAL) are broadcast, a table for each length, and rows stay where they
    are; with more, addresses are matched once each and joined back, which also evens out frequent ones.
    """
    no = F.col("load_no") if "load_no" in networks.columns else F.lit(0)
    nets = networks.select(ip.network_bits(F.col("cidr")).alias("_key"), F.struct(*keep).alias("_net"), no.alias("_no")).filter("_key is not null")
    nets = nets.groupBy("_key").agg(F.max_by("_net", "_no").alias("_net"))
    few = nets.limit(MOST_LOCAL + 1).collect()
    if len(few) > MOST_LOCAL:
        return _by_shuffle(rows, address, nets, keep)
    by_length: dict[tuple[str, int], list] = {}
    for r in few:
        by_length.setdefault((r["_key"][0], len(r["_key"])), []).append((r["_key"], r["_net"]))
    kind = nets.schema["_net"].dataType
    out, found = rows.select(*(rows[c] for c in rows.columns), ip.bits(F.col(address)).alias("_bits")), []
    for i, (version, size) in enumerate(sorted(by_length, key=lambda k: -k[1])):
        shape = T.StructType([T.StructField(f"_k{i}", T.StringType()), T.StructField(f"_n{i}", kind)])
        dim = rows.sparkSession.createDataFrame(by_length[version, size], shape)
        out = out.join(F.broadcast(dim), F.substr("_bits", F.lit(1), F.lit(size)) == F.col(f"_k{i}"), "left")
        found.append(F.col(f"_n{i}"))
    best = F.coalesce(*found) if found else F.lit(None).cast(kind)
    return out.withColumn("_net", best).select(*rows.columns, *(F.col(f"_net.{c}").alias(c) for c in keep))


def _by_shuffle(rows: DataFrame, address: str, nets: DataFrame, keep: list[str]) -> DataFrame:
    lengths = nets.agg(F.sort_array(F.collect_set(F.struct(F.substring("_key", 1, 1).alias("v"), F.length("_key").alias("n"))))).first()[0]  # 33 and 129 at most
    seen = rows.select(F.col(address).alias("_ip")).filter("_ip is not null").distinct().withColumn("_bits", ip.bits(F.col("_ip")))
    keys = F.array_compact(F.array(*(F.when(F.col("_bits").startswith(x["v"]), F.substr("_bits", F.lit(1), F.lit(x["n"]))) for x in lengths)))
    best = seen.select("_ip", F.explode(keys).alias("_key")).join(nets, "_key").groupBy("_ip").agg(F.max_by("_net", F.length("_key")).alias("_net"))
    return rows.join(best, F.col(address) == F.col("_ip"), "left").select(*(rows[c] for c in rows.columns), *(F.col(f"_net.{c}").alias(c) for c in keep))


def domain_suffix(rows: DataFrame, host: str, domains: DataFrame, keep: list[str]) -> DataFrame:
    """rows with the columns `keep` of the entry that names the host itself or else its nearest parent, or null.

    domains has domain text; one with a leading dot stands for a zone, with the zone's own name. Names are compared in
    lower case without a final dot. An exact entry goes before a zone of the same name.
    """
    dim = domains.select(names.clean(F.regexp_replace("domain", r"^\.", "")).alias("_suffix"), F.col("domain").startswith(".").alias("_zone"), F.struct(*keep).alias("_entry"))
    dim = dim.groupBy("_suffix").agg(F.min_by("_entry", F.struct("_zone", F.col("_entry"))).alias("_entry"), F.max("_zone").alias("_any_zone"), F.min_by("_entry", F.when(F.col("_zone"), F.struct("_entry"))).alias("_zone_entry"))
    seen = rows.select(F.col(host).alias("_host")).filter("_host is not null").distinct()
    walked = seen.select("_host", F.posexplode(names.suffixes(F.col("_host"))).alias("_up", "_suffix"))
    met = walked.join(sized(dim), "_suffix").withColumn("_hit", F.when(F.col("_up") == 0, F.col("_entry")).when(F.col("_any_zone"), F.col("_zone_entry"))).filter("_hit is not null")
    best = met.groupBy("_host").agg(F.min_by("_hit", "_up").alias("_hit"))
    return rows.join(best, F.col(host) == F.col("_host"), "left").select(*(rows[c] for c in rows.columns), *(F.col(f"_hit.{c}").alias(c) for c in keep))


def as_of(rows: DataFrame, facts: DataFrame, by: list[str], time: str, keep: list[str], within: int | None = None, order: str = "seq") -> DataFrame:
    """rows with the latest values `keep` of the facts at or before their time, at most `within` units older, or null.

    Both have the columns `by` and `time` (a long). One union and one window: no row meets more than one fact. Facts
    of the same time as a row count; of facts of one time the greatest by value counts.
    """
    values = F.struct(F.col(time).alias("_at"), *keep)
    facts = facts.groupBy(*by, time).agg(F.max(values).alias("_fact"))
    left = rows.select(*by, time, F.struct(*rows.columns).alias("_row"), F.lit(1).alias("_kind"), F.col(order).alias("_order"))
    both = left.unionByName(facts.withColumns({"_kind": F.lit(0), "_order": F.lit(None).cast("long")}), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(time, "_kind", "_order").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_fact", F.last("_fact", ignorenulls=True).over(w)).filter("_kind = 1")
    fresh = F.col("_fact._at").isNotNull() if within is None else F.col("_fact._at") >= F.col(time) - within
    return found.select("_row.*", *(F.when(fresh, F.col(f"_fact.{c}")).alias(c) for c in keep))


def in_range(rows: DataFrame, value: Column, ranges: DataFrame, lo: str, hi: str, keep: list[str], bits: int = 16) -> DataFrame:
    """rows with the columns `keep` of the range lo..hi (both inclusive, not overlapping) that holds a long value, or null.

    Ranges are cut at multiples of 2 ** bits, and rows meet those of their own cell only.
    """
    cells = ranges.select(F.explode(F.sequence(F.shiftright(lo, bits), F.shiftright(hi, bits))).alias("_cell"), F.struct(F.col(lo).alias("_lo"), F.col(hi).alias("_hi"), *keep).alias("_range"))
    cells = cells.groupBy("_cell").agg(F.sort_array(F.collect_list("_range")).alias("_ranges"))  # 2 ** bits at most, as they don't overlap
    with_value = rows.withColumn("_value", value).withColumn("_cell", F.shiftright("_value", bits))
    met = with_value.join(sized(cells), "_cell", "left")
    hit = F.get(F.filter("_ranges", lambda r: F.col("_value").between(r["_lo"], r["_hi"])), F.lit(0))
    return met.withColumn("_hit", hit).select(*(with_value[c] for c in rows.columns), *(F.col(f"_hit.{c}").alias(c) for c in keep))


def covered(ranges: DataFrame, lo: str, hi: str) -> DataFrame:
    """ranges with cidr, a row for each network of the least set that covers a range of addresses exactly, and width, the
    number of its addresses as a text that sorts. A range has 254 networks at most. What is no range (ends of two
    versions, or none, or the wrong way round) has none."""
    columns = [c for c in ranges.columns if c not in ("cidr", "width")]
    schema = T.StructType([*(ranges.schema[c] for c in columns), T.StructField("cidr", T.StringType()), T.StructField("width", T.StringType())])

    def networks(a: str | None, b: str | None) -> tuple[list[str], int]:
        try:
            first, last = ipaddress.ip_address((a or "").strip()), ipaddress.ip_address((b or "").strip())
            return [str(n) for n in ipaddress.summarize_address_range(first, last)], int(last) - int(first) + 1
        except (TypeError, ValueError):
            return [], 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [networks(*x) for x in zip(b.column(lo).to_pylist(), b.column(hi).to_pylist(), strict=True)]
            place = pa.array([i for i, (nets, _) in enumerate(found) for _ in nets], pa.int64())
            cidr, width = pa.array([n for nets, _ in found for n in nets], pa.string()), pa.array([f"{w:033x}" for nets, w in found for _ in nets], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(place) for c in columns), cidr, width], names=[*columns, "cidr", "width"])

    return ranges.select(*columns).mapInArrow(run, schema)


def in_address_range(rows: DataFrame, address: str, ranges: DataFrame, lo: str, hi: str, keep: list[str]) -> DataFrame:
    """rows with the columns `keep` of the narrowest range lo..hi (texts of IPv4 or IPv6, both inclusive) that holds the
    address, or null; of equally narrow ones the least by keep counts.

    Ranges become the networks that cover them. A network is given the narrowest of all ranges that cover it, whichever
    network of theirs does, so that the longest network that holds an address has the answer; no address meets a range.
    """
    best = F.struct("width", *keep)
    nets = covered(ranges, lo, hi).withColumn("_key", ip.network_bits(F.col("cidr"))).filter("_key is not null").groupBy("_key").agg(F.min("cidr").alias("cidr"), F.min(best).alias("_own"))
    above = nets.select("_key", F.explode(F.transform(F.sequence(F.lit(1), F.length("_key")), lambda n: F.substr("_key", F.lit(1), n))).alias("_above"))
    narrowest = above.join(nets.select(F.col("_key").alias("_above"), "_own"), "_above").groupBy("_key").agg(F.min("_own").alias("_best"))
    answers = nets.select("_key", "cidr").join(narrowest, "_key").select("cidr", *(F.col(f"_best.{c}").alias(c) for c in keep))
    return longest_prefix(rows, address, answers, keep)


def with_parent(rows: DataFrame, key: str, dim: DataFrame, dim_key: str, keep: list[str], sep: str = ".") -> DataFrame:
    """rows with the columns `keep` of the dimension's entry, or of the entry of the key up to the first sep."""
    own, up = (dim.select(F.col(dim_key).alias(k), F.struct(*keep).alias(v)) for k, v in (("_own_key", "_own"), ("_up_key", "_up")))
    met = rows.join(own, F.col(key) == F.col("_own_key"), "left").join(up, F.substring_index(key, sep, 1) == F.col("_up_key"), "left")
    return met.select(*(rows[c] for c in rows.columns), *(F.coalesce(F.col(f"_own.{c}"), F.col(f"_up.{c}")).alias(c) for c in keep))


def not_suppressed(alerts: DataFrame, rules: DataFrame) -> DataFrame:
    """alerts for which no row of rules (rule_id or *, cidr or *) holds; addresses are those of the source.

    Rules for all addresses meet by rule, rules for networks by leading bits, one join for each length; no pair is formed.
    """
    star = rules.filter("cidr = '*'").select("rule_id").distinct()
    if star.filter("rule_id = '*'").limit(1).count():
        return alerts.limit(0)
    out = alerts.join(sized(star), "rule_id", "left_anti").select(*alerts.columns).withColumn("_bits", ip.bits(F.col("src_ip")))
    nets = rules.filter("cidr <> '*'").select(ip.network_bits(F.col("cidr")).alias("_key"), F.col("rule_id").alias("_rule")).filter("_key is not null").distinct()
    for size in sorted(r[0] for r in nets.select(F.length("_key")).distinct().collect()):  # 33 and 129 at most
        own = sized(nets.filter(F.length("_key") == size))
        out = out.join(own, (F.substr("_bits", F.lit(1), F.lit(size)) == F.col("_key")) & ((F.col("_rule") == "*") | (F.col("_rule") == F.col("rule_id"))), "left_anti")
    return out.drop("_bits")
