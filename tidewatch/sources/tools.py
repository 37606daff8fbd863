"""What system tools and outside services say, as tables: neighbours, sockets, scans, signatures, launch items, registries.

Texts are lines with a source and a line number, parsed by built-in functions; nothing here runs a tool or asks a service.
"""

from __future__ import annotations

import plistlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions import host


def neighbours(lines: DataFrame) -> DataFrame:
    """ip, mac, iface and permanent of each line of a neighbour table (value); broadcast and multicast entries are left out."""
    part = lambda i: F.regexp_extract("value", r"\(([0-9.]+)\) at ([0-9A-Fa-f:]{11,17}) on (\S+)", i)
    rows = lines.select(part(1).alias("ip"), host.mac(part(2)).alias("mac"), part(3).alias("iface"), F.contains("value", F.lit("permanent")).alias("permanent")).filter("ip <> ''")
    return rows.filter(~F.col("mac").startswith("01:00:5e") & (F.col("mac") != "ff:ff:ff:ff:ff:ff") & ~F.col("ip").endswith(".255") & ~F.col("ip").rlike(r"^(?:224|239)\.|^169\.254\.255"))


def sockets(lines: DataFrame, by: str = "source", order: str = "line_no") -> DataFrame:
    """Sockets of a traffic listing (source, line_no, value): a line of a program, name.pid, holds for the sockets below it."""
    head = F.trim(F.split("value", ",")[0])
    kind = F.regexp_extract("head", r"^((?:tcp|udp|quic)[46]?) ", 1)
    owner = F.struct(F.regexp_extract("head", r"^(.+)\.([0-9]+)$", 1).alias("process"), F.regexp_extract("head", r"^(.+)\.([0-9]+)$", 2).try_cast("int").alias("pid"))
    rows = lines.select(by, order, head.alias("head")).filter("head <> ''").withColumn("kind", kind).withColumn("owner", F.when(F.col("kind") == "", owner))
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    known = rows.withColumn("owner", F.last("owner", ignorenulls=True).over(w)).filter((F.col("kind") != "") & F.col("owner.pid").isNotNull() & F.contains("head", F.lit("<->")))
    ends = F.split(F.regexp_replace("head", r"^\S+ ", ""), "<->")

    def end(i: int, name: str) -> list[Column]:
        text = F.trim(ends[i])
        at, port = F.regexp_extract(text, r"^(.*)[.:]([0-9*]+)$", 1), F.regexp_extract(text, r"^(.*)[.:]([0-9*]+)$", 2)
        return [F.nullif(F.regexp_replace(at, "%.*$|^[*]$", ""), F.lit("")).alias(f"{name}_ip"), port.try_cast("int").alias(f"{name}_port")]

    proto = F.when(F.col("kind").startswith("tcp"), "tcp").otherwise("udp")
    return known.select(by, proto.alias("proto"), F.when(F.col("kind").startswith("quic"), "quic").alias("transport"), *end(0, "local"), *end(1, "remote"), "owner.process", "owner.pid")


SCAN = "struct<host:array<struct<status:struct<_state:string>,hostnames:struct<hostname:array<struct<_name:string>>>,ports:struct<port:array<struct<_portid:int,_protocol:string,state:struct<_state:string>,service:struct<_name:string,_product:string,_version:string>>>>,os:struct<osmatch:array<struct<_name:string>>>>>>"


def scans(documents: DataFrame, xml: str = "xml") -> DataFrame:
    """Open ports of scans, a document each: source, up, hostnames, os, and ports (port, proto, state, service, product)."""
    parsed = documents.select("source", F.from_xml(F.col(xml), SCAN[7:-1].replace(":", " ", 1)).alias("x"))
    first = F.get("x.host", F.lit(0))
    text = lambda c: F.coalesce(c, F.lit(""))
    shown = lambda p: F.struct(p["_portid"].alias("port"), p["_protocol"].alias("proto"), p["state"]["_state"].alias("state"), p["service"]["_name"].alias("service"), F.nullif(F.trim(F.concat(text(p["service"]["_product"]), F.lit(" "), text(p["service"]["_version"]))), F.lit("")).alias("product"))
    ports = F.transform(F.filter(first["ports"]["port"], lambda p: p["state"]["_state"].isin("open", "open|filtered")), shown)
    return parsed.select("source", F.coalesce(first["status"]["_state"] == "up", F.lit(False)).alias("up"), F.transform(first["hostnames"]["hostname"], lambda h: h["_name"]).alias("hostnames"), F.get(first["os"]["osmatch"], F.lit(0))["_name"].alias("os"), F.coalesce(ports, F.array()).alias("ports"))


def signature(text: Column, failed: Column) -> Column:
    """Status and names in what a signature tool says: apple, app_store, developer_id, development, adhoc, unsigned, unknown."""
    line = lambda name: F.nullif(F.regexp_extract(text, rf"(?m)^{name}=(.+)$", 1), F.lit(""))
    leaf, flags = line("Authority"), F.split(F.regexp_extract(text, r"flags=0x[0-9a-f]+\(([^)]*)\)", 1), ",")
    loose = F.contains(text, F.lit("Signature=adhoc")) | F.array_contains(flags, "adhoc")
    status = (
        F.when(F.contains(text, F.lit("not signed at all")), "unsigned")
        .when(failed & leaf.isNull() & ~F.contains(text, F.lit("Signature=adhoc")), "unknown")
        .when(loose, "adhoc")
        .when(leaf.startswith("Developer ID Application"), "developer_id")
        .when(leaf.isin("Apple Mac OS Application Signing", "Apple iPhone OS Application Signing"), "app_store")
        .when(leaf.rlike("^(?:Apple Development|Mac Developer|Apple Distribution)"), "development")
        .when(leaf.isin("Software Signing", "macOS Software Signing") | leaf.startswith("Apple "), "apple")
        .otherwise("unknown")
    )
    return F.struct(status.alias("status"), leaf.alias("authority"), F.nullif(line("TeamIdentifier"), F.lit("not set")).alias("team"), line("Identifier").alias("identifier"), F.array_contains(flags, "runtime").alias("hardened"))


ITEMS = "path string, label string, program string, arguments array<string>, run_at_load boolean, keep_alive boolean, interval long, disabled boolean, modified_us long"


def launch_files(spark: SparkSession, path: str) -> DataFrame:
    """Launch items of property lists under path; what is no property list is left out."""
    files = spark.read.format("binaryFile").load(path).select("path", F.unix_micros("modificationTime").alias("modified_us"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.schema([("path", pa.string()), ("label", pa.string()), ("program", pa.string()), ("arguments", pa.list_(pa.string())), ("run_at_load", pa.bool_()), ("keep_alive", pa.bool_()), ("interval", pa.int64()), ("disabled", pa.bool_()), ("modified_us", pa.int64())])
        for b in batches:
            rows = [r for x in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True) if (r := _item(*x))]
            yield pa.RecordBatch.from_pylist(rows, schema=shape)

    return files.mapInArrow(run, ITEMS)


def _item(path: str, modified: int, content: bytes) -> dict | None:
    try:
        data = plistlib.loads(content)
    except Exception:  # noqa: BLE001  (the parser raises many kinds for what is no list)
        return None
    if not isinstance(data, dict):
        return None
    given = [str(a) for a in data.get("ProgramArguments") or []]
    interval = data.get("StartInterval")
    return {
        "path": path, "label": str(data.get("Label") or path.rpartition("/")[2].removesuffix(".plist")), "program": data.get("Program") or (given[0] if given else None), "arguments": given[1:8],
        "run_at_load": bool(data.get("RunAtLoad")), "keep_alive": bool(data.get("KeepAlive")), "interval": interval if isinstance(interval, int) else None, "disabled": bool(data.get("Disabled")), "modified_us": modified,
    }


#: An entity of a registry's answer; its card is read as text.
_ENTITY = "roles:array<string>,vcardArray:string"
RDAP = f"struct<name:string,handle:string,country:string,startAddress:string,endAddress:string,type:string,cidr0_cidrs:array<struct<v4prefix:string,v6prefix:string,length:int>>,events:array<struct<eventAction:string,eventDate:string>>,entities:array<struct<{_ENTITY},entities:array<struct<{_ENTITY}>>>>>"


def registry(answer: Column) -> Column:
    """Network, range, owner, abuse contact and dates in a registry's answer about an address or a name."""
    x = F.from_json(answer, RDAP)
    every = F.concat(F.transform(x["entities"], lambda e: F.struct(e["roles"].alias("roles"), e["vcardArray"].alias("card"))), F.flatten(F.transform(x["entities"], lambda e: F.coalesce(F.transform(e["entities"], lambda i: F.struct(i["roles"].alias("roles"), i["vcardArray"].alias("card"))), F.array().cast("array<struct<roles:array<string>,card:string>>")))))
    card = lambda role, field: F.nullif(F.regexp_extract(F.get(F.filter(every, lambda e: F.array_contains(e["roles"], role)), F.lit(0))["card"], rf'\["{field}",\{{[^}}]*\}},"[a-z]+","([^"]*)"\]', 1), F.lit(""))
    day = lambda action: F.substring(F.get(F.filter(x["events"], lambda e: e["eventAction"] == action), F.lit(0))["eventDate"], 1, 10)
    net = F.get(x["cidr0_cidrs"], F.lit(0))
    return F.struct(x["name"].alias("network"), F.concat_ws("/", F.coalesce(net["v4prefix"], net["v6prefix"]), net["length"].cast("string")).alias("cidr"), x["country"].alias("country"), card("registrant", "fn").alias("owner"), card("abuse", "email").alias("abuse"), day("registration").alias("registered"), day("last changed").alias("updated"))


def exposure(answer: Column) -> Column:
    """listed, ports, hostnames, tags and flaws in a scan service's answer about an address."""
    x = F.from_json(answer, "detail string, ports array<int>, hostnames array<string>, tags array<string>, vulns array<string>")
    there = x.isNotNull() & x["detail"].isNull() & x["ports"].isNotNull()
    return F.struct(there.alias("listed"), x["ports"].alias("ports"), F.slice(x["hostnames"], 1, 10).alias("hostnames"), x["tags"].alias("tags"), F.slice(x["vulns"], 1, 25).alias("vulns"))


#: Categories of a tracker list that count: fixed values of that list's format.
TRACKER_KINDS = ("Advertising", "Analytics", "Social", "Content", "Cryptomining", "FingerprintingInvasive", "FingerprintingGeneral", "Email", "EmailAggressive")


def trackers(documents: DataFrame) -> DataFrame:
    """domain and category ("company (kind)") of tracker lists in JSON (column value); the first kind of a domain counts."""
    sites = "map<string,array<map<string,map<string,string>>>>"
    lists = documents.select(F.explode(F.from_json(F.get_json_object("value", "$.categories"), sites)).alias("kind", "companies")).filter(F.col("kind").isin(*TRACKER_KINDS))
    by = lists.select("kind", F.explode("companies").alias("c")).select("kind", F.explode("c").alias("company", "sites")).select("kind", "company", F.explode("sites").alias("site", "names"))
    each = by.select("kind", "company", F.explode(F.from_json("names", "array<string>")).alias("domain")).filter("domain <> ''")
    place = F.array_position(F.array(*map(F.lit, TRACKER_KINDS)), F.col("kind"))
    return each.groupBy(F.lower("domain").alias("domain")).agg(F.min_by(F.format_string("%s (%s)", "company", "kind"), F.struct(place, "company")).alias("category"))


def resolvers(lines: DataFrame) -> DataFrame:
    """host or ip of a list of resolvers, a line each (value)."""
    v = F.lower(F.trim(F.regexp_replace("value", "#.*$", "")))
    return lines.select(v.alias("v")).filter("v <> ''").select(F.when(~F.col("v").rlike("^[0-9.]+$|:"), F.col("v")).alias("host"), F.when(F.col("v").rlike("^[0-9.]+$|:"), F.col("v")).alias("ip"))


def merged_config(*layers: dict) -> dict:
    """Settings in layers: a later one wins, mappings are merged, lists are replaced."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = merged_config(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


#: Where to read on about an indicator, by kind: address patterns.
PIVOTS = (("ipv4", "https://www.shodan.io/host/%s"), ("ipv4", "https://www.abuseipdb.com/check/%s"), ("domain", "https://urlscan.io/domain/%s"), ("domain", "https://crt.sh/?q=%s"), ("sha256", "https://www.virustotal.com/gui/file/%s"), ("md5", "https://www.virustotal.com/gui/file/%s"), ("cve", "https://nvd.nist.gov/vuln/detail/%s"), ("asn", "https://bgp.tools/as/%s"))


def pivots(found: DataFrame) -> DataFrame:
    """kind, value and link: where to read on about indicators (kind, value)."""
    dim = found.sparkSession.createDataFrame(list(PIVOTS), "kind string, pattern string").coalesce(1)
    value = F.when(F.col("kind") == "asn", F.regexp_replace("value", "(?i)^AS", "")).otherwise(F.url_encode("value"))
    return found.select("kind", "value").distinct().join(F.broadcast(dim), "kind").select("kind", "value", F.replace(F.col("pattern"), F.lit("%s"), value).alias("link"))  # a row per kind and pattern


def model_verdict(text: Column) -> Column:
    """The verdict that the first line of an explanation names: benign, suspicious, malicious or unknown."""
    found = F.lower(F.regexp_extract(text, r"(?i)verdict\W+(benign|suspicious|malicious|unknown)\b", 1))
    return F.when(found != "", found).otherwise("unknown")


#: How outside sources' figures become verdicts: (source, path of the figure, least figure, verdict), the first that holds.
FIGURES = (("files", "$.malicious", 3, "malicious"), ("files", "$.malicious", 1, "suspicious"), ("files", "$.harmless", 1, "clean"), ("abuse", "$.score", 75, "malicious"), ("abuse", "$.score", 25, "suspicious"), ("abuse", "$.reports", 0, "clean"), ("pulses", "$.count", 1, "suspicious"))


def verdict(source: Column, answer: Column) -> Column:
    """What a source's answer (JSON) amounts to; unknown where no figure says anything."""
    out = F.when(F.lit(False), F.lit(""))
    for name, path, least, means in FIGURES:
        out = out.when((source == name) & (F.get_json_object(answer, path).try_cast("double") >= least), means)
    return out.otherwise("unknown")
