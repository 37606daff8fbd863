"""Packet captures and feeds as DataFrames.

Captures are a data source of their own: a file is cut into ranges of bytes, and a task seeks to its range, finds the
border of a record there and reads on in bounded pieces, so that files may have any size. Streams of captures take whole
files, which rotation keeps small. Feeds are text files, parsed with built-in functions.
"""

from __future__ import annotations

import io
import ipaddress
import itertools
import os
import struct
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PACKETS = "path string, seq long, ts_us long, protocol string, src_ip string, dst_ip string, src_port int, dst_port int, tcp_flags int, tcp_seq long, ip_ttl int, ip_tos int, packet_len int, payload binary, malformed boolean"
_NAMES = [c.split(" ")[0] for c in PACKETS.split(", ")]
#: Bytes before the network header by link type (none: Ethernet, whose tags are read): loopback, raw, cooked, cooked v2.
_LINKS = {1: None, 0: 4, 108: 4, 12: 0, 14: 0, 101: 0, 228: 0, 229: 0, 113: 16, 276: 20}
_TAGS = (0x8100, 0x88A8, 0x9100)
#: IPv6 headers that another one follows; of fragments the length is fixed, of authentication it counts in words.
_OPTIONS, _FRAGMENT, _AUTH, _MOST_HEADERS = (0, 43, 60, 135), 44, 51, 16


#: Byte order and units of time in a second, by a classic file's first four bytes: values fixed by the format.
_CLASSIC = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}
_SECTION = b"\x0a\x0d\x0d\x0a"
#: Bytes that are read at once, records that must follow each other where a border is sought, and the largest record.
PIECE, CHAIN, LARGEST = 1 << 20, 16, 1 << 24
#: Bytes before a range from where on its border is sought and walked to, so that many records vouch for it.
BEFORE = 1 << 20


class Window:
    """A file seen through one piece of PIECE bytes or more: at() gives bytes from anywhere, without holding the rest."""

    def __init__(self, file: BinaryIO, size: int):
        self.file, self.size, self.start, self.data = file, size, 0, b""

    def at(self, place: int, n: int) -> bytes:
        """n bytes from a place, fewer at the end of the file."""
        if not self.start <= place <= place + n <= self.start + len(self.data):
            self.file.seek(place)
            self.start, self.data = place, self.file.read(max(n, PIECE))
        return self.data[place - self.start : place - self.start + n]


def records(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Link type, time in microseconds and frame of each record of a capture file, classic or of blocks; a cut one ends it."""
    for _, link, ts_us, frame in records_between(Window(io.BytesIO(data), len(data)), 0, len(data)):
        yield link, ts_us, frame


def records_between(file: Window, start: int, end: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Place, link type, time and frame of each record that begins from start to end. A file of blocks, whose blocks
    depend on those before, gives all of them to the range that begins with it."""
    head = file.at(0, 24)
    if head[:4] == _SECTION:
        if start == 0:
            yield from _blocks(file)
        return
    if len(head) < 24 or head[:4] not in _CLASSIC:
        return
    order, unit = _CLASSIC[head[:4]]
    link = struct.unpack(order + "I", head[20:24])[0] & 0xFFFF
    at = max(start - BEFORE, 24)
    at = border(file, at, order, unit) if at > 24 else 24
    while at < start and len(head := file.at(at, 16)) == 16:
        at += 16 + struct.unpack(order + "I", head[8:12])[0]
    while at < end and len(head := file.at(at, 16)) == 16:
        seconds, part, size, _ = struct.unpack(order + "4I", head)
        frame = file.at(at + 16, size) if size <= LARGEST else b""
        if len(frame) < size:
            return
        yield at, link, seconds * 1_000_000 + part // unit, frame
        at += 16 + size


def border(file: Window, start: int, order: str, unit: int) -> int:
    """The first place from start on at which a record of a classic file begins; the file's end if there is none.

    A record has no mark. A place is taken for one's beginning if the header there can be one, and so can those of the
    CHAIN records that would follow, each within a day of the one before; at the end of a file a quarter of them must do,
    or fewer that end with it.
    """

    def fits(at: int) -> bool:
        before = None
        for n in range(CHAIN):
            head = file.at(at, 16)
            if len(head) < 16:  # the end, or a last record that is cut
                return n >= CHAIN // 4 or (n > 0 and at == file.size)
            seconds, part, size, whole = struct.unpack(order + "4I", head)
            if part >= 1_000_000 * unit or not size <= whole <= LARGEST or (before is not None and abs(seconds - before) > 86_400):
                return False
            before, at = seconds, at + 16 + size
        return True

    while start < file.size and not fits(start):
        start += 1
    return start


def _blocks(file: Window) -> Iterator[tuple[int, int, int, bytes]]:
    """Records of a file of blocks: each section has its byte order, each interface its link type and unit of time."""
    at, order, links, units = 0, "<", [], []
    while len(head := file.at(at, 12)) == 12:
        if head[:4] == _SECTION:
            order, links, units = "<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">", [], []
        kind, size = struct.unpack(order + "2I", head[:8])
        if not 12 <= size <= LARGEST or at + size > file.size:
            return
        body = file.at(at + 8, size - 12)
        if kind == 1:
            links.append(struct.unpack(order + "H", body[:2])[0])
            units.append(_ticks(body[8:], order))
        elif kind == 6 and len(body) >= 20:
            which, high, low, held, _ = struct.unpack(order + "5I", body[:20])
            if which < len(links):
                yield at, links[which], ((high << 32) | low) * 1_000_000 // units[which], body[20 : 20 + held]
        at += size


def _ticks(options: bytes, order: str) -> int:
    """Units of time in a second, from an interface's options; a millionth is what goes without saying."""
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack(order + "2H", options[at : at + 4])
        if code == 0:
            break
        if code == 9 and size >= 1:
            power = options[at + 4]
            return 2 ** (power & 127) if power & 128 else 10**power
        at += 4 + (size + 3) // 4 * 4
    return 1_000_000


def decode(link: int, frame: bytes) -> dict:
    """The fields of a frame; what is cut short keeps what could be read, what cannot be right is malformed, and what is
    neither IPv4 nor IPv6 has only its length."""
    out: dict = {"packet_len": len(frame), "payload": b"", "malformed": False, "tcp_flags": 0}
    if link not in _LINKS:
        return out
    at = _LINKS[link]
    if at is None:
        at = 14
        while len(frame) >= at + 4 and int.from_bytes(frame[at - 2 : at]) in _TAGS:
            at += 4
        if frame[at - 2 : at] not in (b"\x08\x00", b"\x86\xdd"):
            return out
    ip = frame[at:]
    if not ip or ip[0] >> 4 not in (4, 6):
        return out
    return _version_4(ip, out) if ip[0] >> 4 == 4 else _version_6(ip, out)


def _version_4(ip: bytes, out: dict) -> dict:
    head = (ip[0] & 15) * 4
    if len(ip) < 20 or head < 20 or len(ip) < head:
        return out | {"malformed": True}
    total = int.from_bytes(ip[2:4])
    body = ip[head : total if total >= head else len(ip)]
    out = out | {"ip_ttl": ip[8], "ip_tos": ip[1], "src_ip": ".".join(map(str, ip[12:16])), "dst_ip": ".".join(map(str, ip[16:20])), "protocol": "other"}
    if int.from_bytes(ip[6:8]) & 0x1FFF:  # a later fragment has no ports
        return out | {"payload": body}
    return _transport(ip[9], body, out)


def _version_6(ip: bytes, out: dict) -> dict:
    if len(ip) < 40:
        return out | {"malformed": True}
    size = int.from_bytes(ip[4:6])
    body = ip[40 : 40 + size if size else len(ip)]
    out = out | {"ip_ttl": ip[7], "ip_tos": int.from_bytes(ip[:2]) >> 4 & 0xFF, "src_ip": str(ipaddress.IPv6Address(ip[8:24])), "dst_ip": str(ipaddress.IPv6Address(ip[24:40])), "protocol": "other"}
    kind = ip[6]
    for _ in range(_MOST_HEADERS):
        if kind not in (*_OPTIONS, _FRAGMENT, _AUTH):
            return _transport(kind, body, out)
        if len(body) < 8:
            return out
        if kind == _FRAGMENT:
            later, kind, body = int.from_bytes(body[2:4]) >> 3, body[0], body[8:]
            if later:
                return out | {"payload": body}
        else:
            kind, body = body[0], body[(body[1] + 2) * 4 if kind == _AUTH else (body[1] + 1) * 8 :]
    return {"packet_len": out["packet_len"], "payload": b"", "malformed": True, "tcp_flags": 0}


def _transport(kind: int, body: bytes, out: dict) -> dict:
    if kind in (6, 17):
        if len(body) < (20 if kind == 6 else 8):
            return out | {"malformed": True}
        out = out | {"src_port": int.from_bytes(body[:2]), "dst_port": int.from_bytes(body[2:4])}
        if kind == 17:
            return out | {"protocol": "udp", "payload": body[8:]}
        offset = (body[12] >> 4) * 4
        if offset < 20:
            return out | {"malformed": True}
        return out | {"protocol": "tcp", "tcp_flags": body[13] | (body[12] & 1) << 8, "tcp_seq": int.from_bytes(body[4:8]), "payload": body[offset:]}
    if kind == 1:
        return out | {"protocol": "icmp", "payload": body[8:] if body[:1] in (b"\x00", b"\x08") else b""}
    if kind == 58 and body[:1] == b"\x80":
        return out | {"protocol": "icmpv6", "payload": body[8:]}
    return out


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class _Reader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[_Range]:
        system, root = pafs.FileSystem.from_uri(self.path) if "://" in self.path else pafs.FileSystem.from_uri(f"file://{os.path.abspath(self.path)}")
        info = system.get_file_info(root)
        files = [info] if info.is_file else [f for f in system.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)) if f.is_file and not f.base_name.startswith((".", "_"))]
        return [_Range(f.path, at, min(at + self.split, f.size)) for f in sorted(files, key=lambda f: f.path) for at in range(0, f.size, self.split)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        system, _ = pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), None)
        with system.open_input_file(partition.path) as file:
            rows = records_between(Window(file, file.size()), partition.start, partition.end)
            yield from _batches(({"path": partition.path, "seq": at, "ts_us": ts_us, **decode(link, frame)} for at, link, ts_us, frame in rows), 10_000)


class CaptureSource(DataSource):
    """Format tidewatch_captures: path, and split, the bytes of a range."""

    @classmethod
    def name(cls) -> str:
        return "tidewatch_captures"

    def schema(self) -> str:
        return PACKETS

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("split", 64 << 20)))


def read_captures(spark: SparkSession, path: str, split: int = 64 << 20) -> DataFrame:
    """The packets of a capture file, or of all files under a folder, each cut into ranges of split bytes that tasks read by
    themselves; seq is the place of a record in its file, in bytes. path is one that pyarrow's file systems can open. Files
    of blocks are read by one task each, in pieces. What is no capture gives no rows, and a cut record ends its file."""
    spark.dataSource.register(CaptureSource)
    return spark.read.format(CaptureSource.name()).option("split", split).load(path)


def _batches(rows: Iterator[dict], most: int) -> Iterator[pa.RecordBatch]:
    shape = pa.schema(list(zip(_NAMES, _KINDS, strict=True)))
    while some := list(itertools.islice(rows, most)):
        yield pa.RecordBatch.from_pylist(some, schema=shape)


def _decoded(files: DataFrame, batch: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                file = Window(io.BytesIO(data.as_buffer()), len(data.as_buffer()))
                yield from _batches(({"path": name, "seq": at, "ts_us": ts_us, **decode(link, frame)} for at, link, ts_us, frame in records_between(file, 0, file.size)), batch)

    return files.mapInArrow(run, PACKETS)


_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]


def stream_captures(spark: SparkSession, path: str, files: int = 4) -> DataFrame:
    """The packets of capture files as they are put into a folder, so many files at a time."""
    read = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return _decoded(read.option("maxFilesPerTrigger", files).load(path).select("path", "content"), 10_000)


def read_feed(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Indicators of a feed: one column, cidr for kinds ip and drop, domain for kinds hosts and domains.

    ip: an address or network a line; drop: a JSON object a line with cidr; hosts: lines of a hosts file; domains: a name
    a line. Comments start with # or ;.
    """
    if kind == "drop":
        return spark.read.schema("cidr string").json(path).filter("cidr is not null")
    line = F.trim(F.regexp_replace("value", r"[#;].*$", ""))
    lines = spark.read.text(path).select(line.alias("line")).filter("line <> ''")
    words = F.split("line", r"[\s,]+")
    if kind == "ip":
        return lines.select(words[0].alias("cidr"))
    name = F.get(words, F.lit(1)) if kind == "hosts" else words[0]
    out = lines.select(F.lower(name).alias("domain")).filter("domain is not null and domain like '%.%'")
    return out.filter("domain <> '0.0.0.0'").distinct()
