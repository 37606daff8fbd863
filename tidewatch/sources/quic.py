"""The greetings of QUIC connections: what a client's first packets say once their protection is taken off.

The keys of first packets follow from the connection id that the client has chosen (RFC 9001, section 5.2), so that anyone
on the path can read them. Python takes datagrams apart, derives keys and reads frames; both passes of AES, the mask of
the header and the content itself, are Spark's own functions between these steps. The pieces of a greeting, which may come
in several packets and in any order, are then put together by offset.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import folds
from tidewatch.operators.intervals import Intervals

from . import dissect

#: Salts and label prefixes of first packets by version: values fixed by RFC 9001, RFC 9369 and draft 29.
SALTS = {
    0x00000001: (bytes.fromhex("38762cf7f55934b34d179ae6a4c80cadccbb7f0a"), "quic"),
    0x6B3343CF: (bytes.fromhex("0dede3def700a6db819381be6e269dcbf9bd2ed9"), "quicv2"),
    0xFF00001D: (bytes.fromhex("afbfec289993d24c9e9786f19c6111e04390a899"), "quic"),
}
#: What the two type bits of a first packet are, by version.
FIRST = {0x6B3343CF: 1}
BY = ["src_ip", "src_port", "dst_ip", "dst_port", "dcid"]
#: Bytes of a greeting beyond which it is given up, and microseconds for which its pieces wait.
MOST, WAIT = 1 << 16, 10_000_000


def expand_label(secret: bytes, label: str, size: int) -> bytes:
    """HKDF-Expand-Label of TLS 1.3 with an empty context, for at most one block."""
    name = b"tls13 " + label.encode()
    info = size.to_bytes(2) + bytes([len(name)]) + name + b"\0"
    return hmac.new(secret, info + b"\x01", hashlib.sha256).digest()[:size]


def client_keys(version: int, dcid: bytes) -> tuple[bytes, bytes, bytes]:
    """Key, initialisation vector and header key of a client's first packets."""
    salt, prefix = SALTS[version]
    secret = expand_label(hmac.new(salt, dcid, hashlib.sha256).digest(), "client in", 32)
    return expand_label(secret, f"{prefix} key", 16), expand_label(secret, f"{prefix} iv", 12), expand_label(secret, f"{prefix} hp", 16)


def varint(r: dissect.Reader) -> int:
    """A number whose first two bits say its size."""
    first = r.number(1)
    n = 1 << (first >> 6)
    return ((first & 0x3F) << 8 * (n - 1)) | (r.number(n - 1) if n > 1 else 0)


def first_packets(datagram: bytes) -> Iterator[dict]:
    """The first packets of a datagram that hold enough to be read: dcid, keys, the place of the packet number, the bytes."""
    at = 0
    while at < len(datagram):
        r = dissect.Reader(datagram, at)
        try:
            kind, version = r.number(1), r.number(4)
            if kind & 0xC0 != 0xC0 or version not in SALTS:
                return
            dcid = r.take(r.number(1))
            r.take(r.number(1))
            is_first = kind >> 4 & 3 == FIRST.get(version, 0)
            if is_first:
                r.take(varint(r))
            size = varint(r)
        except IndexError:
            return
        end = r.at + size
        if is_first and size >= 20 and end <= len(datagram):
            key, iv, header = client_keys(version, dcid)
            yield {"dcid": dcid, "key": key, "iv": iv, "header_key": header, "number_at": r.at - at, "packet": datagram[at:end], "sample": datagram[r.at + 4 : r.at + 20]}
        at = max(end, at + 1)


def unmasked(packet: bytes, number_at: int, mask: bytes, iv: bytes) -> tuple[bytes, bytes, bytes]:
    """Nonce, header in the clear, and what is still encrypted."""
    first = packet[0] ^ (mask[0] & 0x0F)
    n = (first & 3) + 1
    number = bytes(a ^ b for a, b in zip(packet[number_at : number_at + n], mask[1 : 1 + n], strict=True))
    nonce = bytes(a ^ b for a, b in zip(iv, number.rjust(12, b"\0"), strict=True))
    return nonce, bytes([first]) + packet[1:number_at] + number, packet[number_at + n :]


def crypto_pieces(content: bytes) -> list[tuple[int, bytes]]:
    """Offsets and bytes of the CRYPTO frames of a packet, as far as its frames can be read."""
    r, out = dissect.Reader(content), []
    try:
        while r.left():
            kind = varint(r)
            if kind in (0x00, 0x01):  # padding, ping
                continue
            if kind in (0x02, 0x03):  # acknowledgements: largest, delay, ranges; then, for one of the two, three counts
                varint(r), varint(r)
                ranges = varint(r)
                for _ in range(1 + 2 * ranges + 3 * (kind == 0x03)):
                    varint(r)
            elif kind == 0x06:
                offset = varint(r)
                out.append((offset, r.take(varint(r))))
            else:
                break
    except IndexError:
        pass
    return out


class Pieces:
    """A message put together from pieces by offset, in any order, repeated or overlapping: its bytes once it is whole.

    The first bytes say its size (a type, and three bytes of length). Of overlapping pieces the one that came first
    counts. What is not whole WAIT after its first piece, or would grow beyond MOST, is given up.
    """

    def __init__(self, wait: int = WAIT, most: int = MOST):
        self.wait, self.most, self.since, self.done, self.held = wait, most, None, False, Intervals()
        self.idle = wait + 1

    def run(self, at, offsets, pieces) -> list:
        return [self._on(*x) for x in zip(at, offsets, pieces, strict=True)]

    def _on(self, at: int, offset: int, piece: bytes) -> bytes | None:
        if self.since is not None and at - self.since > self.wait:
            self.since, self.done, self.held = None, False, Intervals()
        if self.since is None:
            self.since = at
        if self.done or not piece or offset + len(piece) > self.most:
            return None
        self.held.put(offset, piece)
        head = self.held.after(0)
        size = 4 + int.from_bytes(head[1:4])
        if len(head) < max(size, 4):
            return None
        self.done, self.held = True, Intervals()
        return head[:size]


def _rows(make: Callable[[dict], list[dict]], keep: list[str], names: dict[str, pa.DataType]):
    """A function over Arrow batches: each row becomes what make() gives for it, beside the columns to keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, place = [], []
            for i, row in enumerate(batch.to_pylist()):
                new = make(row)
                made += new
                place += [i] * len(new)
            kept = [batch.column(c).take(pa.array(place, pa.int64())) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array([m[n] for m in made], t) for n, t in names.items())], names=[*keep, *names])

    return run


def greetings(packets: DataFrame) -> DataFrame:
    """The greetings of clients' QUIC connections: src_ip, src_port, dst_ip, dst_port, dcid, ts_us, seq and tls, as
    dissect.tls() reads them, one row for each that is whole.

    packets needs ts_us, seq, src_ip, src_port, dst_ip, dst_port, protocol and payload. Datagrams of other versions, other
    packets, cut ones and such as do not decrypt are passed over. Pieces of a greeting may come in any order, repeat and
    overlap; a greeting that is sent again with another connection id is another one.
    """
    ends, when = BY[:4], ["ts_us", "seq"]
    rows = packets.filter((F.col("protocol") == "udp") & (F.length("payload") >= 40) & (F.ascii(F.substring("payload", 1, 1).cast("string")) != 0)).select(*ends, *when, "payload")
    found = {"dcid": pa.binary(), "key": pa.binary(), "iv": pa.binary(), "header_key": pa.binary(), "number_at": pa.int32(), "packet": pa.binary(), "sample": pa.binary()}
    shape = ", ".join(f"{c} {packets.schema[c].dataType.simpleString()}" for c in (*ends, *when))
    opened = rows.mapInArrow(_rows(lambda r: list(first_packets(r["payload"])), [*ends, *when], found), f"{shape}, dcid binary, key binary, iv binary, header_key binary, number_at int, packet binary, sample binary")
    masked = opened.withColumn("mask", F.substring(F.aes_encrypt("sample", "header_key", F.lit("ECB")), 1, 16))
    bare = lambda r: [dict(zip(("nonce", "header", "sealed"), unmasked(r["packet"], r["number_at"], r["mask"], r["iv"]), strict=True))]
    clear = masked.mapInArrow(_rows(bare, [*ends, *when, "dcid", "key"], {n: pa.binary() for n in ("nonce", "header", "sealed")}), f"{shape}, dcid binary, key binary, nonce binary, header binary, sealed binary")
    content = F.try_aes_decrypt(F.concat("nonce", "sealed"), "key", F.lit("GCM"), F.lit("NONE"), "header")
    read = clear.withColumn("content", content).filter("content is not null")
    pieces = read.mapInArrow(_rows(lambda r: [{"offset": o, "piece": p} for o, p in crypto_pieces(r["content"])], [*BY, *when], {"offset": pa.int64(), "piece": pa.binary()}), f"{shape}, dcid binary, offset long, piece binary".replace(", ts_us", ", dcid binary, ts_us").replace(", dcid binary, offset", ", offset"))
    told = folds.fold(pieces, BY, [*when, "offset"], ["ts_us", "offset", "piece"], Pieces, "greeting", "binary").filter("greeting is not null and length(greeting) < 65536")
    size = F.unhex(F.lpad(F.hex(F.length("greeting")), 4, "0"))
    record = F.concat(F.unhex(F.lit("160301")), size, F.col("greeting"))
    as_tcp = told.select(*ends, "dcid", *when, F.lit("tcp").alias("protocol"), record.alias("payload"), F.col("dst_port").alias("_port"))
    seen = dissect.dissected(as_tcp.withColumn("dst_port", F.lit(443)))
    return seen.filter("tls.tls_version is not null").select("src_ip", "src_port", "dst_ip", F.col("_port").alias("dst_port"), F.hex("dcid").alias("dcid"), *when, "tls")
