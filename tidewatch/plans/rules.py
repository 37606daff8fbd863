"""A predicate language for packets, compiled to Spark columns.

A rule is a mapping: id, description, severity, match, and optionally threshold, message, tags, enabled. ``match`` is a
tree of ``all``, ``any``, ``not`` and leaves ``{field, op, value}``; a plain mapping stands for equal fields. Predicates
are two-valued: on a missing field ``ne`` and ``eq`` null hold and every other test fails, and ``not`` is a plain
negation. All rules of a set become one expression over a row, so that packets are read once however many rules there
are, and no row is joined with a rule.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions import ip
from tidewatch.operators import folds

OPERATORS = ("eq", "ne", "lt", "gt", "lte", "gte", "in", "not_in", "contains", "not_contains", "startswith", "endswith", "regex", "cidr", "exists")
KEYS = frozenset({"id", "description", "severity", "match", "when", "threshold", "message", "tags", "enabled", "technique", "mitre", "confidence", "why", "response", "action"})
SEVERITY = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
TRACK = {"src_ip": ["src_ip"], "dst_ip": ["dst_ip"], "pair": ["src_ip", "dst_ip"], "flow": ["flow_id"], "global": []}
#: Flags that make Java's expressions read as the language says: case does not count, and classes are Unicode's.
FLAGS = "(?idU)"


class RuleError(ValueError):
    """A rule that does not compile; the text says why."""


#: Flags of a TCP packet by name, as tcp.syn, tcp.ack, ...: bits fixed by the protocol.
TCP_FLAGS = {"fin": 1, "syn": 2, "rst": 4, "psh": 8, "ack": 16, "urg": 32, "ece": 64, "cwr": 128, "ns": 256}


def _tcp(schema: T.StructType, name: str) -> tuple[Column, T.DataType | None]:
    """A flag of a TCP packet; xmas and null stand for all of FIN, PSH and URG, and for no flag."""
    flags = F.when(F.col("protocol") == "tcp", F.coalesce("tcp_flags", F.lit(0)))
    if "tcp_flags" not in schema.names or (name not in TCP_FLAGS and name not in ("xmas", "null", "flags")):
        return F.lit(None).cast("boolean"), None
    if name == "flags":
        return flags, T.IntegerType()
    bits = 41 if name == "xmas" else 511 if name == "null" else TCP_FLAGS[name]
    return flags.bitwiseAND(F.lit(bits)) == (0 if name == "null" else bits), T.BooleanType()


def unescaped(text: str) -> str:
    """Text in which \\xNN stands for the character of that number; expressions have it of their own."""
    return re.sub(r"\\x([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), text)


def _field(schema: T.StructType, name: str) -> tuple[Column, T.DataType | None]:
    """A field, with dots for the fields of structs; unknown ones are null.

    payload_len, src_scope, dst_scope and tcp.* are made from others; direction is that of context where packets have none.
    layer7.x is x, and payload_bytes is payload. A name after a map is one of its keys.
    """
    name = "payload" if name == "payload_bytes" else name.removeprefix("layer7.") if "layer7" not in schema.names else name
    if name == "direction" and "direction" not in schema.names and "context" in schema.names:
        name = "context.direction"
    if name.startswith("tcp."):
        return _tcp(schema, name[4:])
    if name == "payload_len":
        return F.length("payload"), T.IntegerType()
    if name in ("src_scope", "dst_scope"):
        return ip.classify(F.col(name[:3] + "_ip")), T.StringType()
    at: T.DataType = schema
    parts = name.split(".")
    for i, part in enumerate(parts):
        if isinstance(at, T.MapType):
            return F.try_element_at(F.col(".".join(parts[:i])), F.lit(".".join(parts[i:]))), at.valueType
        if not isinstance(at, T.StructType) or part not in at.names:
            return F.lit(None).cast("string"), None
        at = at[part].dataType
    return F.col(name), at


def _text(x: Column, kind: T.DataType | None) -> Column:
    return F.decode(x, "ISO-8859-1") if isinstance(kind, T.BinaryType) else x.cast("string")


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _number(x: Column, kind: T.DataType | None) -> Column:
    return x if isinstance(kind, T.NumericType) else x.cast("string").try_cast("double")


def leaf(schema: T.StructType, field: str, op: str, value: Any) -> Column:
    if op not in OPERATORS:
        raise RuleError(f"unknown operator {op!r}")
    x, kind = _field(schema, field)
    listed = list(value) if isinstance(value, (list, tuple, set)) else [value]
    if op == "exists":
        return x.isNotNull() if value in (True, None) else x.isNull()
    if op in ("eq", "ne"):
        number = isinstance(value, (int, float)) and not isinstance(value, bool) and not isinstance(kind, T.NumericType)
        same = x.isNull() if value is None else _sure(_number(x, kind) == value) if number else x.eqNullSafe(F.lit(value))
        return same if op == "eq" else ~same
    if op in ("lt", "gt", "lte", "gte"):
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise RuleError(f"{op} needs a number")
        n = _number(x, kind)
        return _sure({"lt": n < value, "gt": n > value, "lte": n <= value, "gte": n >= value}[op])
    if op in ("in", "not_in"):
        hit = _sure(x.isin(*listed))
        return hit if op == "in" else x.isNotNull() & ~hit
    if op in ("contains", "not_contains"):
        hit = F.array_contains(x, value) if isinstance(kind, T.ArrayType) else reduce(or_, (F.contains(_text(x, kind), F.lit(unescaped(str(v)))) for v in listed))
        return _sure(hit) if op == "contains" else x.isNotNull() & ~_sure(hit)
    if op in ("startswith", "endswith"):
        test = F.startswith if op == "startswith" else F.endswith
        return _sure(reduce(or_, (test(_text(x, kind), F.lit(unescaped(str(v)))) for v in listed)))
    if op == "regex":
        return _sure(F.coalesce(_text(x, kind), F.lit("")).rlike(FLAGS + value)) if isinstance(kind, T.BinaryType) else _sure(_text(x, kind).rlike(FLAGS + value))
    try:
        return ip.within(ip.number(x), *listed)
    except (ValueError, AttributeError) as e:
        raise RuleError(f"bad network in {listed}") from e


def compile_match(schema: T.StructType, node: Any) -> Column:
    """The predicate of a tree, never null."""
    if isinstance(node, list):
        return reduce(and_, (compile_match(schema, x) for x in node), F.lit(True))
    if not isinstance(node, dict) or not node:
        raise RuleError("a match must be a mapping or a list")
    if "field" in node:
        return leaf(schema, node["field"], node.get("op", "eq"), node.get("value"))
    parts = []
    for key, value in node.items():
        if key == "all":
            parts.append(reduce(and_, (compile_match(schema, x) for x in value), F.lit(True)))
        elif key == "any":
            parts.append(reduce(or_, (compile_match(schema, x) for x in value), F.lit(False)))
        elif key == "not":
            parts.append(~compile_match(schema, value))
        else:
            parts.append(leaf(schema, key, "eq", value))
    return reduce(and_, parts)


def leaves(schema: T.StructType, node: Any) -> list[tuple[str, str, Any]]:
    """(field, op, value) of the tests of a tree that are not under a `not`, in order."""
    if isinstance(node, list):
        return [x for n in node for x in leaves(schema, n)]
    if "field" in node:
        return [(node["field"], node.get("op", "eq"), node.get("value"))]
    out = []
    for key, value in node.items():
        if key in ("all", "any"):
            out += [x for n in value for x in leaves(schema, n)]
        elif key != "not":
            out.append((key, "eq", value))
    return out


def evidence(schema: T.StructType, node: Any, most: int = 12) -> Column:
    """The tests of a tree that hold, `most` at most: what a rule saw, as field, op, expected, actual (text)."""
    items = []
    for field, op, value in leaves(schema, node):
        x, kind = _field(schema, field)
        shown = excerpt(_text(x, kind), value if op in ("contains", "startswith") else None) if isinstance(kind, T.BinaryType) else x.cast("string")
        items.append(F.when(leaf(schema, field, op, value), F.struct(F.lit(field).alias("field"), F.lit(op).alias("op"), F.lit(str(value)).alias("expected"), shown.alias("actual"))))
    return F.slice(F.array_compact(F.array(*items)), 1, most)


def excerpt(text: Column, around: Any = None, before: int = 24, size: int = 136) -> Column:
    """A piece of a payload that can be shown: from shortly before what was found, other characters as dots."""
    found = F.lit(1) if around is None else F.greatest(F.instr(text, unescaped(str(around))) - before, F.lit(1))
    return F.regexp_replace(F.substr(text, found, F.lit(size)), r"[^\x20-\x7e]", ".")


def needs_data(node: Any) -> bool:
    """Whether a tree can only hold for packets with a payload or something read from one."""
    if isinstance(node, list):
        return any(map(needs_data, node))
    if "field" in node:
        said = node["field"].partition(".")[0] in ("payload", "layer7", "dns", "tls", "http", "ssh", "smtp", "stun", "quic")
        return said and not (node.get("op", "eq") in ("ne", "not_in", "not_contains") or node.get("value") is None or node.get("value") is False)
    if "any" in node and len(node) == 1:
        return bool(node["any"]) and all(map(needs_data, node["any"]))
    return any(needs_data(value) if key == "all" else all(map(needs_data, value)) if key == "any" else key != "not" and needs_data({"field": key, "value": value}) for key, value in node.items())


def from_when(when: dict) -> dict:
    """The older form of a rule, a mapping of fields, as a tree; payload_contains is a test of the payload."""
    tests = [{"field": "payload", "op": "contains", "value": v} if k == "payload_contains" else {"field": k, "op": "in" if isinstance(v, list) else "eq", "value": v} for k, v in when.items()]
    return {"all": tests}


def load(*paths: str) -> list[dict]:
    """Rules of YAML files, merged; a file that cannot be read or is no list is passed over."""
    import yaml

    files = []
    for path in paths:
        try:
            with open(path, encoding="utf-8") as f:
                found = yaml.safe_load(f)
        except (OSError, yaml.YAMLError):
            continue
        files.append(found.get("rules", []) if isinstance(found, dict) else found if isinstance(found, list) else [])
    return merge(*files)


def message(schema: T.StructType, template: str) -> Column:
    """A template with {fields}: ? for null, 120 characters of each at most."""
    out, rest = [], template
    while "{" in rest and "}" in rest.split("{", 1)[1]:
        before, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        x, kind = _field(schema, name)
        shown = F.regexp_replace(F.substring(_text(x, kind), 1, 120), r"[^\x20-\x7e]", ".")
        out += [F.lit(before), F.coalesce(shown, F.lit("?"))]
    return F.concat(*out, F.lit(rest))


@dataclass(frozen=True)
class Rule:
    id: str
    severity: int
    match: Any
    message: str
    threshold: tuple[int, int, str] | None = None  # count, seconds, what is tracked
    tags: tuple[str, ...] = ()


def merge(*files: list[dict]) -> list[dict]:
    """Rules by id; a later one replaces an earlier one, or only its given keys where it has no match."""
    out: dict[str, dict] = {}
    for rule in (r for rules in files for r in rules if isinstance(r, dict) and r.get("id")):
        out[rule["id"]] = {**out.get(rule["id"], {}), **rule} if "match" not in rule and "when" not in rule else dict(rule)
    return list(out.values())


def validate(rules: list[dict], schema: T.StructType) -> tuple[list[Rule], list[str]]:
    """The rules that compile, and what is wrong with the others; one bad rule stops no other. Disabled ones are left out."""
    good, problems, seen = [], [], set()
    for n, raw in enumerate(rules):
        name = raw.get("id") if isinstance(raw, dict) else None
        try:
            if not name:
                raise RuleError("no id")
            if name in seen:
                raise RuleError("the id is taken")
            if unknown := sorted(set(raw) - KEYS):
                raise RuleError(f"unknown keys {unknown}")
            if raw.get("severity", "MEDIUM") not in SEVERITY:
                raise RuleError(f"unknown severity {raw['severity']!r}")
            limit = raw.get("threshold")
            if limit and (limit.get("track_by", "src_ip") not in TRACK or int(limit["count"]) < 1 or float(limit["seconds"]) <= 0):
                raise RuleError("bad threshold")
            match = from_when(raw["when"]) if "match" not in raw and "when" in raw else raw.get("match")
            compile_match(schema, match)
            seen.add(name)
            if raw.get("enabled", True):
                rule = Rule(name, SEVERITY[raw.get("severity", "MEDIUM")], match, raw.get("message", raw.get("description", name)), limit and (int(limit["count"]), int(float(limit["seconds"]) * 1e6), limit.get("track_by", "src_ip")), tuple(raw.get("tags", ())))
                good.append(rule)
        except (RuleError, KeyError, TypeError, AttributeError) as e:
            problems.append(f"{name or f'rule {n}'}: {e}")
    return good, problems


def hits(packets: DataFrame, rules: list[Rule], with_evidence: bool = False) -> DataFrame:
    """One row for each packet and rule that holds: the packet's columns, rule_id, severity, message and, if asked, evidence.

    Rules that need data are not tried on packets without a payload, where packets have one.
    """
    schema = packets.schema
    has_data = F.length("payload") > 0 if "payload" in schema.names else F.lit(True)

    def hit(r: Rule) -> Column:
        test = compile_match(schema, r.match)
        said = [F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"), message(schema, r.message).alias("message")]
        said += [evidence(schema, r.match).alias("evidence")] if with_evidence else []
        return F.when(has_data & test if needs_data(r.match) else test, F.struct(*said))

    if not rules:
        return packets.withColumns({"rule_id": F.lit(None).cast("string"), "severity": F.lit(None).cast("int"), "message": F.lit(None).cast("string")}).limit(0)
    return packets.withColumn("_hit", F.explode(F.array_compact(F.array(*map(hit, rules))))).select(*packets.columns, "_hit.*")


def alerts(packets: DataFrame, rules: list[Rule]) -> DataFrame:
    """hits(), with the rules that have a threshold only when it is reached, with how many hits made it.

    Packets are read twice, once for the rules without and once for those with a threshold, however many there are; the
    latter share one shuffle and one fold, by rule and by what the rule tracks.
    """
    limited = [r for r in rules if r.threshold]
    out = hits(packets, [r for r in rules if not r.threshold]).withColumn("hits", F.lit(None).cast("int"))
    if not limited:
        return out
    own = hits(packets, limited)
    have = {c: F.col(c) if c in packets.columns else F.lit(None).cast("string") for c in ("src_ip", "dst_ip", "flow_id")}
    tracked = {"src_ip": [have["src_ip"]], "dst_ip": [have["dst_ip"]], "pair": [have["src_ip"], have["dst_ip"]], "flow": [have["flow_id"]], "global": []}
    by_rule = lambda f: F.element_at(F.create_map(*(x for r in limited for x in (F.lit(r.id), f(r)))), F.col("rule_id"))
    key = by_rule(lambda r: F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in tracked[r.threshold[2]])))
    own = own.withColumns({"_key": key, "_window": by_rule(lambda r: F.lit(r.threshold[1]).cast("long")), "_least": by_rule(lambda r: F.lit(r.threshold[0]))})
    said = folds.fold(own, ["rule_id", "_key"], ["ts_us", "seq"], ["ts_us", "_window", "_least"], folds.threshold(), "hits", "int")
    return out.unionByName(said.filter("hits is not null").drop("_key", "_window", "_least"))


#: A small set of our own over the fields of packets.
DEFAULT_RULES = [
    {"id": "REC-EMPTY", "description": "Connection without data to a low port", "severity": "LOW", "match": {"all": [{"field": "bytes", "op": "eq", "value": 0}, {"field": "dst_port", "op": "lt", "value": 1024}]}},
    {"id": "EXF-LARGE", "description": "Large transfer to the outside", "severity": "HIGH", "match": {"all": [{"field": "bytes", "op": "gte", "value": 20000}, {"not": {"field": "dst_ip", "op": "cidr", "value": ["10.0.0.0/8"]}}]}, "message": "{src_ip} sent {bytes} bytes to {dst_ip}"},
    {"id": "POL-UDP", "description": "Datagram to a public address", "severity": "LOW", "match": {"protocol": "udp", "dst_scope": "public"}},
    {"id": "CRED-BURST", "description": "Many attempts on a server", "severity": "HIGH", "match": {"field": "app", "op": "eq", "value": "error"}, "threshold": {"count": 3, "seconds": 172800, "track_by": "pair"}, "message": "{src_ip} keeps failing on {dst_ip}"},
]
