"""Connections: packets between two endpoints, cut into flows, with the state, history and outcome of each.

Where a flow ends follows from counts alone: a fresh SYN opens a new flow if a FIN or RST has come since the last fresh
SYN or silence. So the cut is a window over one shuffle and one sort by endpoints, and the rest is a hash aggregation of
numbers, without Python or state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIN, SYN, RST, ACK = 1, 2, 4, 16
_BY = ["protocol", "lo", "hi"]


def _tcp() -> Column:
    return F.col("protocol") == "tcp"


def _has(flags: int) -> Column:
    return _tcp() & (F.col("tcp_flags").bitwiseAND(F.lit(flags)) != 0)


def _fresh() -> Column:
    return _has(SYN) & ~_has(ACK)


def sided(packets: DataFrame, *keep: Column) -> DataFrame:
    """Packets with their endpoints in order, which of them sent, and whether from a port of services to another."""
    src, dst = (F.struct(F.col(f"{x}_ip").alias("ip"), F.coalesce(f"{x}_port", F.lit(0)).alias("port")) for x in ("src", "dst"))
    served = src["port"].between(1, 1023) & (dst["port"] >= 1024)
    return packets.filter("protocol <> '' and src_ip <> '' and dst_ip <> ''").select(
        "seq", "ts_us", "protocol", F.least(src, dst).alias("lo"), F.greatest(src, dst).alias("hi"), (src <= dst).alias("from_lo"), served.alias("served"),
        F.coalesce("tcp_flags", F.lit(0)).alias("tcp_flags"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"), *keep,
    )


def cut(packets: DataFrame, gap: int = 60_000_000, idle: int = 300_000_000, *keep: Column) -> DataFrame:
    """Packets with their endpoints in order (lo, hi), the place in them (nth), the flow's number, and what opened it.

    packets has seq, ts_us, src_ip, dst_ip, src_port, dst_port, protocol, tcp_flags and bytes (of payload). Rows without
    protocol or address take no part; a null port is 0, as are null flags and bytes. A flow goes on as long as no more
    than `gap` passes between packets (TCP: `idle`) and no fresh SYN follows an end. Columns to keep stay beside these.
    """
    rows = sided(packets, *keep)
    order = Window.partitionBy(*_BY).orderBy("ts_us", "seq")
    upto, before = (order.rowsBetween(Window.unboundedPreceding, x) for x in (0, -1))
    pause = F.when(_tcp(), F.lit(idle)).otherwise(F.lit(gap))
    rows = rows.select(
        "*",
        F.row_number().over(order).cast("long").alias("nth"),
        F.coalesce(F.col("ts_us") - F.lag("ts_us").over(order) > pause, F.lit(True)).alias("silent"),
        F.coalesce(F.sum(F.when(_has(FIN | RST), 1).otherwise(0)).over(before), F.lit(0)).alias("ended"),
    )
    mark = F.coalesce(F.max(F.when(F.col("silent") | _fresh(), F.col("ended"))).over(before), F.lit(0))
    rows = rows.withColumn("opens", F.col("silent") | (_fresh() & (F.col("ended") > mark)))
    return rows.withColumn("flow", F.sum(F.col("opens").cast("long")).over(upto)).drop("silent", "ended")


def _letters() -> dict[str, tuple[int, Column]]:
    """What a packet adds to its side's history: place within the packet, and when."""
    data = F.col("bytes") > 0
    spoke = _tcp() & (F.col("tcp_flags") != 0)
    return {
        "S": (0, _fresh()),
        "H": (0, _has(SYN) & _has(ACK)),
        "A": (0, _has(ACK) & ~_has(SYN | FIN | RST) & ~data),
        "D": (1, spoke & data),
        "F": (2, _has(FIN)),
        "R": (3, _has(RST)),
    }


def connections(packets: DataFrame, gap: int = 60_000_000, idle: int = 300_000_000) -> DataFrame:
    """One row per flow (see cut): flow_id of the endpoints, initiator and responder, state, outcome, history, counts.

    The initiator sent the first packet, unless that is a SYN-ACK, or comes from a port under 1024 to one above, without
    a SYN; then it is inferred to be the other side. In the history S, H, A, D, F and R (SYN, SYN-ACK, bare ACK, data,
    FIN, RST) stand once for each side, in order of appearance, small for the responder.
    """
    return described(_summed(cut(packets, gap, idle)))


def _summed(packets: DataFrame) -> DataFrame:
    """What cut() gives, a row for each flow."""
    lo = F.col("from_lo")
    reply = F.when(_has(SYN), _has(ACK)).otherwise(F.col("served"))
    ends = F.when(_has(FIN | RST), F.col("nth") * 2 + _has(RST).cast("int"))
    sides = {"lo": lo, "hi": ~lo}
    places = [
        F.min(F.when(when & side, F.col("nth") * 4 + at)).alias(f"{letter}_{name}") for letter, (at, when) in _letters().items() for name, side in sides.items()
    ]
    return packets.groupBy(*_BY, "flow").agg(
        F.max(F.when(F.col("opens"), lo != reply)).alias("lo_opened"),
        F.max(F.when(F.col("opens"), reply)).alias("inferred"),
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
        F.count(F.lit(1)).alias("packets"),
        F.sum("bytes").alias("bytes"),
        F.sum(F.when(lo, 1).otherwise(0)).alias("packets_lo"),
        F.sum(F.when(lo, F.col("bytes")).otherwise(0)).alias("bytes_lo"),
        F.bit_or(F.when(_tcp(), F.col("tcp_flags")).otherwise(0)).alias("flags"),
        F.max(ends).alias("end"),
        *(F.max(_has(FIN) & ~_has(RST) & side).alias(f"fin_{name}") for name, side in sides.items()),
        F.max(F.when(_fresh(), F.col("nth"))).alias("asked"),
        F.max(F.when(_has(ACK), F.col("nth"))).alias("answered"),
        *places,
    )


def described(flows: DataFrame) -> DataFrame:
    """The rows of connections(), from what _summed() gives."""
    sides = ("lo", "hi")
    # An endpoint that talks to itself sends everything as the initiator.
    opened = F.col("lo_opened") | (F.col("lo") == F.col("hi"))
    flows = flows.withColumn("lo_opened", opened)
    said = F.array(*(
        F.struct(F.col(f"{letter}_{name}").alias("at"), F.when(F.col("lo_opened") == (name == "lo"), letter).otherwise(letter.lower()).alias("letter"))
        for letter in _letters() for name in sides
    ))
    history = F.array_join(F.transform(F.array_sort(F.filter(said, lambda x: x["at"].isNotNull())), lambda x: x["letter"]), "")
    here, there = (F.when(F.col("lo_opened") == x, F.col("lo")).otherwise(F.col("hi")) for x in (True, False))
    named = flows.select("*", _state().alias("state"), history.alias("history"), here.alias("src"), there.alias("dst")).select(
        "*",
        F.when(F.col("lo_opened"), F.col("packets_lo")).otherwise(F.col("packets") - F.col("packets_lo")).alias("packets_out"),
        F.when(F.col("lo_opened"), F.col("bytes_lo")).otherwise(F.col("bytes") - F.col("bytes_lo")).alias("bytes_out"),
    )
    ends_of = (F.col(f"{x}.{y}").cast("string") for x in ("lo", "hi") for y in ("ip", "port"))
    return named.select(
        F.md5(F.concat_ws(":", "protocol", *ends_of).cast("binary")).alias("flow_id"),
        "flow", "protocol", F.col("src.ip").alias("src_ip"), F.col("src.port").alias("src_port"), F.col("dst.ip").alias("dst_ip"), F.col("dst.port").alias("dst_port"),
        "state", _outcome().alias("outcome"), "history", "first_us", "last_us", "packets", "packets_out", "bytes", "bytes_out", "inferred",
    )


def _state() -> Column:
    """closed: reset, or ended by both sides; closing: ended by one; established: answered since the last fresh SYN; new."""
    closed = (F.col("end") % 2 == 1) | (F.col("fin_lo") & F.col("fin_hi"))
    return (
        F.when(F.col("end").isNotNull(), F.when(closed, "closed").otherwise("closing"))
        .when(F.col("answered") > F.coalesce("asked", F.lit(0)), "established")
        .otherwise("new")
    )


#: What is known of a flow at each of its packets; bytes_from_src is another name of bytes_out, duration is in seconds.
RUNNING = "flow_id string, new boolean, packets long, bytes long, bytes_out long, bytes_in long, bytes_from_src long, packets_from_src long, duration double, state string, initiator string, responder string, inferred boolean"


def with_flow(packets: DataFrame, gap: int = 60_000_000, idle: int = 300_000_000) -> DataFrame:
    """packets with the column flow (RUNNING): what their flow has come to with each, this packet included.

    Flows are those of cut(), and the frames run along them, so that rows of one pair of endpoints are shuffled and sorted
    once. Packets without protocol or address have no flow. packets must not have a column flow of their own.
    """
    lo = F.col("from_lo")
    rows = cut(packets, gap, idle, F.struct(*(F.col(f"`{c}`") for c in packets.columns)).alias("_row"))
    along = Window.partitionBy(*_BY, "flow").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    upto = lambda f, x: f(x).over(along)
    reply = F.when(_has(SYN), _has(ACK)).otherwise(F.col("served"))
    rows = rows.select(
        *_BY, "_row", "ts_us",
        upto(F.max, F.when(F.col("opens"), (lo != reply) | (F.col("lo") == F.col("hi")))).alias("lo_opened"), upto(F.max, F.when(F.col("opens"), reply)).alias("inferred"),
        upto(F.min, F.col("ts_us")).alias("first_us"), upto(F.count, F.lit(1)).alias("packets"), upto(F.sum, F.col("bytes")).alias("bytes"),
        upto(F.sum, F.when(lo, 1).otherwise(0)).alias("packets_lo"), upto(F.sum, F.when(lo, F.col("bytes")).otherwise(0)).alias("bytes_lo"),
        upto(F.max, F.when(_has(FIN | RST), F.col("nth") * 2 + _has(RST).cast("int"))).alias("end"),
        *(upto(F.max, _has(FIN) & ~_has(RST) & side).alias(f"fin_{name}") for name, side in (("lo", lo), ("hi", ~lo))),
        upto(F.max, F.when(_fresh(), F.col("nth"))).alias("asked"), upto(F.max, F.when(_has(ACK), F.col("nth"))).alias("answered"),
    )
    sent = lambda c: F.when(F.col("lo_opened"), F.col(f"{c}_lo")).otherwise(F.col(c) - F.col(f"{c}_lo"))
    ends_of = (F.col(f"{x}.{y}").cast("string") for x in ("lo", "hi") for y in ("ip", "port"))
    first, other = (F.when(F.col("lo_opened") == x, F.col("lo.ip")).otherwise(F.col("hi.ip")) for x in (True, False))
    fields = {
        "flow_id": F.md5(F.concat_ws(":", "protocol", *ends_of).cast("binary")), "new": F.col("packets") <= 1, "packets": F.col("packets"), "bytes": F.col("bytes"), "bytes_out": sent("bytes"), "bytes_in": F.col("bytes") - sent("bytes"),
        "bytes_from_src": sent("bytes"), "packets_from_src": sent("packets"), "duration": (F.col("ts_us") - F.col("first_us")) / 1e6, "state": _state(), "initiator": first, "responder": other, "inferred": F.col("inferred"),
    }
    with_ = rows.select("_row.*", F.struct(*(v.alias(k) for k, v in fields.items())).cast(f"struct<{RUNNING.replace(', ', ',').replace(' ', ':')}>").alias("flow"))
    rest = packets.filter("coalesce(protocol, '') = '' or coalesce(src_ip, '') = '' or coalesce(dst_ip, '') = ''")
    return with_.unionByName(rest.withColumn("flow", F.lit(None).cast(with_.schema["flow"].dataType)))


def _outcome() -> Column:
    """attempt: no answer; rejected: a reset for an answer; reset, closed, closing, established; active: none of these."""
    h = F.col("history")
    has = h.contains
    unanswered = has("S") & ~has("h")
    return (
        F.when(F.col("flags") == 0, "active")
        .when(has("r") & unanswered & ~has("d") & ~has("D"), "rejected")
        .when(has("R") | has("r"), "reset")
        .when(F.col("state").isin("closed", "closing"), F.col("state"))
        .when(unanswered & (F.col("packets") == F.col("packets_out")), "attempt")
        .when(F.col("state") == "established", "established")
        .otherwise("active")
    )


#: What a stream knows of a flow when it ends: the columns of _summed() beside the key.
SUMMED = "flow long, lo_opened boolean, inferred boolean, first_us long, last_us long, packets long, bytes long, packets_lo long, bytes_lo long, flags int, end long, fin_lo boolean, fin_hi boolean, asked long, answered long, " + ", ".join(
    f"{letter}_{side} long" for letter in "SHADFR" for side in ("lo", "hi")
)


class Tracked:
    """The flow between two endpoints, packet by packet, for streams: where one ends, its sums as _summed() has them."""

    def __init__(self, gap: int, idle: int):
        self.gap, self.tcp_idle, self.idle = gap, idle, max(gap, idle)
        self.nth = self.flow = self.ended = self.mark = 0
        self.now: dict | None = None

    def run(self, at, protocols, flags, sizes, from_lo, served) -> list:
        return [self._on(*x) for x in zip(at, protocols, flags, sizes, from_lo, served, strict=True)]

    def end(self) -> dict | None:
        return self.now

    def _on(self, at: int, protocol: str, flags: int, size: int, lo: bool, served: bool) -> dict | None:
        tcp = protocol == "tcp"
        self.idle = self.tcp_idle if tcp else self.gap
        bits = flags if tcp else 0
        syn, ack, fin, rst = (bool(bits & x) for x in (SYN, ACK, FIN, RST))
        fresh, closing = syn and not ack, fin or rst
        silent = self.now is None or at - self.now["last_us"] > self.idle
        opens, said = silent or (fresh and self.ended > self.mark), None
        self.nth += 1
        if opens:
            said, self.flow = self.now, self.flow + 1
            reply = ack if syn else served
            self.now = {"flow": self.flow, "lo_opened": lo != reply, "inferred": reply, "first_us": at, "fin_lo": False, "fin_hi": False, "packets": 0, "bytes": 0, "packets_lo": 0, "bytes_lo": 0, "flags": 0}
        if silent or fresh:
            self.mark = max(self.mark, self.ended)
        self.ended += closing
        x, side = self.now, "lo" if lo else "hi"
        x["last_us"] = at
        x["packets"] += 1
        x["bytes"] += size
        x["packets_lo"] += lo
        x["bytes_lo"] += size if lo else 0
        x["flags"] |= bits
        if closing:
            x["end"] = max(x.get("end", 0), self.nth * 2 + rst)
        x[f"fin_{side}"] |= fin and not rst
        if fresh:
            x["asked"] = self.nth
        if ack:
            x["answered"] = self.nth
        letters = {"S": (0, fresh), "H": (0, syn and ack), "A": (0, ack and not syn and not closing and not size), "D": (1, bits != 0 and size > 0), "F": (2, fin), "R": (3, rst)}
        for letter, (place, when) in letters.items():
            if when:
                x.setdefault(f"{letter}_{side}", self.nth * 4 + place)
        return said
